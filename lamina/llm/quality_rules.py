"""Quality rules: a decision list learned by sequential covering from labelled statistics, all in Spark expressions.

Statistics of a text are built-in array functions. Learning reads only counts of labelled rows per cell of binned
statistics; each step is one aggregate that returns one row. The list becomes an ordered F.when chain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, keep

SYMBOLS = "#*$%&|<>"
#: Statistics that rules may test: name -> SQL over the columns of statistics().
TESTED = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(n_words, 1)",
    "bang_share": "n_bang / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "n_words": "cast(n_words as double)",
}
QUANTILES = [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each text (null: all zero): words, their code points, symbols, capitals, lines, repeated lines and words.

    n_repeat_words counts words that lie in a 3-word window found twice or more; windows are matched by a 64-bit hash
    within one text: sorting (hash, place) puts equal windows together, so the cost is n log n for any text length.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), t.alias("t"))
    without, blank = F.col("t"), F.col("t")
    for x in SYMBOLS:
        without = F.replace(without, F.lit(x), F.lit(""))
    for x in "\t\n\v\f\r":
        blank = F.replace(blank, F.lit(x), F.lit(" "))
    d = d.select(
        "doc_id",
        F.filter(F.split(blank, " "), lambda x: x != "").alias("w"),
        (F.octet_length("t") - F.octet_length(without)).alias("n_symbols"),
        (F.octet_length("t") - F.octet_length(F.replace("t", F.lit("!"), F.lit("")))).alias("n_bang"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n = F.size("w")
    window = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    d = d.select(
        "*", n.cast("long").alias("n_words"), F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window)).alias("h"),
        F.char_length(F.array_join("w", "")).alias("word_chars"), F.size(F.filter("w", lambda x: (F.upper(x) == x) & (F.lower(x) != x))).alias("n_upper"),
    ).drop("w")
    # Most texts repeat no window: only the others are sorted.
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    twin = lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"])
    places = F.transform(F.filter("s", lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["p"])
    d = d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_bang",
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.sort_array(places).alias("r"),
    )
    covered = F.aggregate(
        F.transform("r", lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("r", i - 1)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return d.select(
        "doc_id",
        "n_words",
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_upper").cast("long").alias("n_upper"),
        F.col("n_bang").cast("long").alias("n_bang"),
    )


@dataclass(frozen=True)
class Literal:
    name: str
    at_least: bool
    cut: float

    def sql(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<'} {self.cut!r}D"


Rule = tuple[Literal, ...]


def condition(rule: Rule) -> str:
    return " and ".join(f"({x.sql()})" for x in rule)


def learn(rows: DataFrame, max_rules: int = 6, max_literals: int = 3, precision: float = 0.97, least: int = 8) -> list[Rule]:
    """Rules for bad = true from rows(doc_id, the columns of TESTED, bad). Rows with null bad are left out; too few rows give no rule.

    Two thirds of the rows grow a rule by the literal of best information gain, one third prunes its tail; a rule stays
    if it covers `least` rows that earlier rules do not, and `precision` of those are bad.
    """
    rows = rows.where("bad is not null")
    cuts: dict[str, list[float]] = {}
    q = rows.groupBy().agg(
        *[F.expr(f"percentile_approx({c}, array({', '.join(map(str, QUANTILES))}), 1000)").alias(f"{c}_all") for c in TESTED],
        *[F.expr(f"percentile_approx({c}, array({', '.join(map(str, QUANTILES))}), 1000) filter (where bad)").alias(f"{c}_bad") for c in TESTED],
    ).first()
    for c in TESTED:
        cuts[c] = sorted({float(f"{x:.3g}") for part in ("all", "bad") for x in q[f"{c}_{part}"] or []} - {0.0})
    literals = [Literal(c, up, x) for c, xs in cuts.items() for x in xs for up in (True, False)]
    part = (crc_mod(F.col("doc_id"), 3) == 0).alias("prune")
    true = F.array_compact(F.array(*[F.when(F.expr(x.sql()), F.lit(i)) for i, x in enumerate(literals)])).alias("true")
    cells = keep(rows.select(part, "bad", true).groupBy("prune", "bad", "true").count()) if literals else None

    def within(ks: list[int]) -> Column:
        out = F.lit(True)
        for k in ks:
            out = out & F.array_contains("true", F.lit(k))
        return out

    def counts(table: DataFrame, which: Column, n: int) -> list[list[int]]:
        """For each index in `which`: good and bad rows to grow on, good and bad rows to prune on."""
        out = [[0] * 4 for _ in range(n)]
        for r in table.select(F.explode(which).alias("k"), "prune", "bad", "count").groupBy("k", "prune", "bad").agg(F.sum("count").alias("n")).collect():
            out[r["k"]][2 * r["prune"] + r["bad"]] = r["n"]
        return out

    from math import log2

    rules: list[Rule] = []
    free = cells
    while literals and len(rules) < max_rules:
        rule: list[int] = []
        ((g, b, _, _),) = counts(free, F.array(F.lit(0)), 1)
        while b and len(rule) < max_literals and b < precision * (g + b):
            found = counts(free.where(within(rule)), F.col("true"), len(literals))
            gain = [n[1] * (log2(n[1] / (n[0] + n[1])) - log2(b / (g + b))) if n[1] else 0.0 for n in found]
            k = max(range(len(gain)), key=gain.__getitem__)
            if gain[k] <= 0:
                break
            rule.append(k)
            g, b = found[k][:2]
        if not rule:
            break
        heads = counts(free, F.array_compact(F.array(*[F.when(within(rule[: i + 1]), F.lit(i)) for i in range(len(rule))])), len(rule))
        worth = [(n[3] - n[2]) / (n[2] + n[3]) if n[2] + n[3] else -1.0 for n in heads]
        n = max(range(len(rule)), key=lambda i: (worth[i], -i))
        good, bad = heads[n][0] + heads[n][2], heads[n][1] + heads[n][3]
        if good + bad < least or bad < precision * (good + bad):
            break
        rules.append(tuple(literals[k] for k in rule[: n + 1]))
        free = free.where(~within(rule[: n + 1]))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that fires, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(F.expr(condition(rule)), F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base_failed, fired (the rule's number), rule (its text) and kept of every document.

    labels(doc_id, quality) teaches on rows that pass the base test; quality 0 is bad, ids labelled twice take the smaller value. Without labels the
    base test decides alone. Null text has no words and fails it.
    """
    stats = keep(statistics(docs, id_col, text_col))
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    tested = stats.select("*", *[F.expr(e).alias(f"x_{c}") for c, e in TESTED.items()])
    rows = tested.where("not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)").join(known, "doc_id").select("doc_id", "bad", *[F.col(f"x_{c}").alias(c) for c in TESTED])
    rules = learn(rows)
    plain = tested.select("doc_id", F.struct(*[c for c in stats.columns if c != "doc_id"]).alias("s"), *[F.col(f"x_{c}").alias(c) for c in TESTED])
    base = F.expr("s.n_words < 50 or 100 * s.n_repeat_words > 50 * s.n_words")
    texts = F.array(*[F.lit(condition(r)) for r in rules]) if rules else F.array().cast("array<string>")
    return plain.select("doc_id", "s.*", base.alias("base_failed"), verdict(rules).alias("fired")).select(
        "*", F.get(texts, F.col("fired") - 1).alias("rule"), (~F.col("base_failed") & F.col("fired").isNull()).alias("kept")
    )
