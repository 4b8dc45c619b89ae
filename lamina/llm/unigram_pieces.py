"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, whitespace markers.

The pieces and their log scores are read from a model file given by path (vocabularies are never trained here). The
best segmentation is the one with the highest sum of scores; a character without a piece of its own costs the lowest
score minus 10 and becomes its UTF-8 bytes. Spaces are written as the marker U+2581, with one in front of the text.
Decoding is exact for every text: a marker that stands in the text itself is encoded as bytes.

No piece has a marker after another character (checked when the model is read), so the best segmentation of a text
is that of its runs, each from a marker to the next; runs are remembered in a bounded table per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PENALTY = 10.0


class DoubleArray:
    """A trie of byte strings in two arrays: the child of s by byte c is t = base[s] + c + 1 if check[t] == s; value[t] is a key's number or -1."""

    def __init__(self, keys: list[bytes]) -> None:
        order = sorted(range(len(keys)), key=keys.__getitem__)
        sorted_keys = [keys[i] for i in order]
        self.base, self.check, self.value = [0], [-1], [-1]
        self._reserve(1 << 10)
        self.check[0] = 0
        todo, free, start = [(0, 0, len(keys), 0)], 257, 257  # so that every byte can reach the first free cell
        while todo:
            s, lo, hi, depth = todo.pop()
            while lo < hi and len(sorted_keys[lo]) == depth:
                self.value[s] = order[lo]
                lo += 1
            if lo == hi:
                continue
            kids, at = [], lo
            while at < hi:
                c, begin = sorted_keys[at][depth], at
                while at < hi and sorted_keys[at][depth] == c:
                    at += 1
                kids.append((c, begin, at))
            if len(kids) == 1:  # fits any free cell
                while free < len(self.check) and self.check[free] >= 0:
                    free += 1
                b = max(0, free - kids[0][0] - 1)
            else:
                b = max(0, start - kids[0][0] - 1)
            tries = 0
            while True:
                self._reserve(b + 258)
                if all(self.check[b + c + 1] < 0 for c, _, _ in kids):
                    break
                b += 1
                tries += 1
            if tries > 64 and len(kids) > 1:  # the cells before are nearly full: later searches begin here
                start = b + kids[0][0] + 1
            self.base[s] = b
            for c, i, j in kids:
                self.check[b + c + 1] = s
                todo.append((b + c + 1, i, j, depth + 1))

    def _reserve(self, n: int) -> None:
        if (more := n - len(self.check)) > 0:
            more = max(more, len(self.check))
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more


class Unigram:
    """Encoder and decoder over (piece, score) pairs; byte pieces are written <0xHH>, control pieces are never matched."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], most_kept: int = 400_000) -> None:
        self.byte_id = [-1] * 256
        self.as_bytes: list[bytes] = []
        normal: list[int] = []
        for i, (p, kind) in enumerate(zip(pieces, kinds)):
            if kind == "byte":
                self.byte_id[int(p[1:-1], 16)] = i
                self.as_bytes.append(bytes([int(p[1:-1], 16)]))
            elif kind == "normal":
                normal.append(i)
                self.as_bytes.append(p.replace(MARK, " ").encode())
            else:
                self.as_bytes.append(b"")
        self.trie = DoubleArray([pieces[i].encode() for i in normal])
        self.trie.value = [normal[v] if v >= 0 else -1 for v in self.trie.value]
        self.scores = scores
        self.unknown = min((scores[i] for i in normal), default=0.0) - PENALTY
        self.by_runs = not any(re.search(f"[^{MARK}]{MARK}", pieces[i]) for i in normal)
        lines = not any("\n" in pieces[i] for i in normal)
        self.runs = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if lines else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.most_kept, self.kept = most_kept, {}

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Unigram:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        kind = lambda i: "byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal"
        return cls([m.id_to_piece(i) for i in n], [m.get_score(i) for i in n], [kind(i) for i in n])

    def viterbi(self, run: str) -> tuple[int, ...]:
        """Best pieces of a run of escaped text. Of equal sums the first found stays: shorter last pieces lose to earlier ones."""
        data = run.encode()
        n = len(data)
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        size = len(check)
        i = 0
        while i < n:
            first = data[i]
            step = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            here, s, j, single = best[i], 0, i, False
            while j < n:
                t = base[s] + data[j] + 1
                if t >= size or check[t] != s:
                    break
                s = t
                j += 1
                if (v := value[s]) >= 0:
                    if (x := here + scores[v]) > best[j]:
                        best[j], back[j] = x, (i, v)
                    if j == i + step:
                        single = True
            if not single and (x := here + self.unknown) > best[i + step]:
                best[i + step], back[i + step] = x, (i, -1)
            i += step
        out: list[int] = []
        j = n
        while j:
            i, v = back[j]
            out += [v] if v >= 0 else [self.byte_id[b] for b in reversed(data[i:j])]
            j = i
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; [] for the empty text."""
        if not text:
            return []
        out: list[int] = []
        kept = self.kept
        for k, part in enumerate(text.split(MARK)):
            if k:
                out += [self.byte_id[b] for b in MARK.encode()]
            part = part.replace(" ", MARK)
            if not k:
                part = MARK + part
            for run in self.runs.findall(part) if self.by_runs else [part] if part else []:
                ids = kept.get(run)
                if ids is None:
                    ids = self.viterbi(run)
                    if len(run) <= 64:
                        if len(kept) >= self.most_kept:
                            kept.clear()
                        kept[run] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces with markers as spaces, byte pieces as bytes, the space in front taken off. Bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.as_bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, keep_columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids, n_ids, n_bytes (byte pieces among them), round_trip (decoding the ids gives the text) and keep_columns of every row, whole texts.

    Null text gives null ids, n_ids 0 and round_trip null; the empty text gives no ids. Repeated rows come back repeated.
    The model is read on the driver and broadcast: its size is the vocabulary's.
    """
    model = docs.sparkSession.sparkContext.broadcast(Unigram.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        is_byte = set(m.byte_id)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                ids = [None if t is None else m.encode(t) for t in texts]
                same = [None if t is None else m.decode(x) == t for t, x in zip(texts, ids)]
                n = [len(x or ()) for x in ids]
                fall = [sum(map(is_byte.__contains__, x or ())) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(fall, pa.int64()), pa.array(same, pa.bool_()), *part.columns[2:]], ["doc_id", "ids", "n_ids", "n_bytes", "round_trip", *keep_columns])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep_columns)
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in d.schema.fields[2:])
    return d.mapInArrow(run, f"doc_id long, ids array<int>, n_ids long, n_bytes long, round_trip boolean{more}")


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, text from (doc_id, ids): null ids give null text."""
    model = tokens.sparkSession.sparkContext.broadcast(Unigram.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else model.value.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
