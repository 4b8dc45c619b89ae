"""Licence scans: ordered signature rules behind a keyword prefilter, with priority and interval containment.

Texts are brought to one form (words in lower case, one space before each) in which a rule is a regular expression
over words. Strings that every match of a rule holds are read off the rule itself: a text that holds none of the gates
made from them is done at once, the others try only rules all of whose strings they hold. Neither can lose a match.
Detections are word intervals: one that lies inside another is suppressed, and of equal intervals the rule that comes
first (higher priority) stays. All of it is built-in functions on one row; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Gates that serve many rules; gates() adds one for each rule that can match a text without any of these.
GATES = ("licen", " spdx", " public domain", "copyleft", " rights reserved", " gpl", " lgpl", " agpl", " creativecommons")

#: Label; name as words (regex); versions (regex, empty: none); SPDX words.
FAMILIES = (
    ("mit", "mit", "", "mit"),
    ("mit-0", "mit no attribution", "", "mit 0"),
    ("apache", "apache(?: software)?", "1 0|1 1|2 0|2", "apache"),
    ("gpl", "(?:gnu )?(?:general public|gpl)", "1|2|3|1 0|2 0|3 0", "gpl"),
    ("lgpl", "(?:gnu )?(?:(?:lesser|library) general public|lgpl)", "2|2 0|2 1|3|3 0", "lgpl"),
    ("agpl", "(?:gnu )?(?:affero general public|agpl)", "1|1 0|3|3 0", "agpl"),
    ("gfdl", "(?:gnu )?(?:free documentation|gfdl)", "1 1|1 2|1 3", "gfdl"),
    ("bsd", "(?:(?:new|modified|simplified|revised|2 clause|3 clause|4 clause) )?bsd", "2 clause|3 clause|4 clause", "bsd"),
    ("0bsd", "zero clause bsd", "", "0bsd"),
    ("isc", "isc", "", "isc"),
    ("mpl", "(?:mozilla public|mpl)", "1 0|1 1|2 0", "mpl"),
    ("epl", "(?:eclipse public|epl)", "1 0|2 0", "epl"),
    ("edl", "(?:eclipse distribution|edl)", "1 0", "edl"),
    ("cddl", "(?:common development and distribution|cddl)", "1 0|1 1", "cddl"),
    ("cpl", "common public", "1 0", "cpl"),
    ("cpal", "common public attribution", "1 0", "cpal"),
    ("ipl", "ibm public", "1 0", "ipl"),
    ("eupl", "(?:european union public|eupl)", "1 0|1 1|1 2", "eupl"),
    ("artistic", "artistic", "1 0|2 0", "artistic"),
    ("zlib", "zlib(?: libpng)?", "", "zlib"),
    ("bsl", "boost software", "1 0", "bsl"),
    ("busl", "(?:business source|busl)", "1 1", "busl"),
    ("python", "python software foundation", "2|2 0", "psf"),
    ("php", "php", "3 0|3 01", "php"),
    ("ruby", "ruby", "", "ruby"),
    ("perl", "perl", "", "perl"),
    ("unlicense", "unlicense", "", "unlicense"),
    ("wtfpl", "do what the fuck you want to public", "2", "wtfpl"),
    ("ofl", "(?:sil )?open font", "1 0|1 1", "ofl"),
    ("odbl", "(?:open (?:data commons open )?database|odbl)", "1 0", "odbl"),
    ("osl", "open software", "1 0|2 0|2 1|3 0", "osl"),
    ("afl", "academic free", "1 2|2 0|2 1|3 0", "afl"),
    ("ecl", "educational community", "1 0|2 0", "ecl"),
    ("ms-pl", "microsoft public", "", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "", "ms rl"),
    ("ncsa", "university of illinois(?: ncsa)?(?: open source)?", "", "ncsa"),
    ("upl", "universal permissive", "1 0", "upl"),
    ("openssl", "openssl", "", "openssl"),
    ("postgresql", "postgresql", "", "postgresql"),
    ("cecill", "cecill(?: free software)?", "1 0|1 1|2 0|2 1", "cecill"),
    ("mulan", "mulan (?:permissive|psl)(?: software)?", "1|2", "mulanpsl"),
    ("sspl", "(?:server side public|sspl)", "1", "sspl"),
    ("elastic", "elastic", "2 0", "elastic"),
    ("cc-by-nc-sa", "(?:cc by nc sa|(?:creative commons )?attribution non ?commercial share ?alike)", "1 0|2 0|2 5|3 0|4 0", "cc by nc sa"),
    ("cc-by-nc-nd", "(?:cc by nc nd|(?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?)", "2 0|2 5|3 0|4 0", "cc by nc nd"),
    ("cc-by-nc", "(?:cc by nc|(?:creative commons )?attribution non ?commercial)", "1 0|2 0|2 5|3 0|4 0", "cc by nc"),
    ("cc-by-nd", "(?:cc by nd|(?:creative commons )?attribution no ?deriv(?:ative)?s?(?: works)?)", "1 0|2 0|2 5|3 0|4 0", "cc by nd"),
    ("cc-by-sa", "(?:cc by sa|(?:creative commons )?attribution share ?alike)", "1 0|2 0|2 5|3 0|4 0", "cc by sa"),
    ("cc-by", "(?:cc by|creative commons attribution)", "1 0|2 0|2 5|3 0|4 0", "cc by"),
    ("cc0", "(?:cc0|creative commons zero)", "1 0", "cc0"),
    ("proprietary", "proprietary", "", "licenseref proprietary"),
)

#: Names that stand for a licence together with a version alone, such as "GPL v2".
ACRONYMS = {
    "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "gfdl": "gfdl", "mpl": "mpl", "epl": "epl", "edl": "edl", "cddl": "cddl", "cpl": "cpl", "eupl": "eupl", "odbl": "odbl", "sspl": "sspl", "osl": "osl", "afl": "afl", "ofl": "ofl",
    "cc-by": "cc by", "cc-by-sa": "cc by sa", "cc-by-nc": "cc by nc", "cc-by-nd": "cc by nd", "cc-by-nc-sa": "cc by nc sa", "cc-by-nc-nd": "cc by nc nd",
}
#: Fixed values of the phrase templates: confidence; words around {n} (name) and {v} (version), {l} is the word licence; what they need.
TEMPLATES = (
    (0.98, "licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{n}(?: {l})? (?:version |v ?)(?:{v})(?: or (?:any )?later(?: version)?)?", "version"),
    (0.95, "licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{n}(?: {l})?(?: (?:{v}))?", ""),
    (0.95, "released under (?:the )?(?:terms of (?:the )?)?{n}(?: {l})?(?: (?:version |v ?)?(?:{v}))?", ""),
    (0.9, "(?:distributed|available|published|provided|covered|governed) (?:under|by) (?:the )?(?:terms of (?:the )?)?{n} {l}(?: (?:version |v ?)?(?:{v}))?", ""),
    (0.9, "{n} {l} (?:version |v ?)?(?:{v})(?: or (?:any )?later(?: version)?)?", "version"),
    (0.85, "{a} (?:{l} )?(?:version |v ?)?(?:{v})(?: only| or (?:any )?later(?: version)?)?", "acronym"),
    (0.8, "{n}(?: (?:{v}))? {l}", ""),
)
LICENCE = "licen[sc]es?"
#: Other signatures: label, confidence, words.
SINGLE = (
    ("public-domain", 0.8, "(?:dedicated to|released into|in|into) the public domain"),
    ("all-rights-reserved", 0.6, "all rights reserved"),
    ("mit", 0.9, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", 0.9, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", 0.9, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", 0.9, "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl", 0.9, "boost software license version 1 0 17 august 2003"),
    ("apache", 0.9, "www apache org licenses license 2 0"),
    ("gpl", 0.9, "www gnu org licenses gpl(?: 2 0| 3 0)?(?: html| txt)?"),
    ("lgpl", 0.9, "www gnu org licenses lgpl(?: 2 1| 3 0)?(?: html| txt)?"),
    ("agpl", 0.9, "www gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("cc-by", 0.9, "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", 0.9, "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", 0.9, "creativecommons org licenses by nc [1-4] [05]"),
    ("cc0", 0.9, "creativecommons org publicdomain zero 1 0"),
    ("mit", 0.8, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", 0.8, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 0.8, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 0.8, "neither the name of (?:the )?(?:copyright holder|university|author|project) nor the names of its contributors may be used to endorse or promote products"),
    ("zlib", 0.8, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("apache", 0.9, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", 0.9, "you may not use this file except in compliance with the license"),
    ("gpl", 0.9, "is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 0.9, "is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", 0.9, "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", 0.8, "either version (?:1|2|3) of the license or at your option any later version"),
    ("mpl", 0.9, "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", 0.8, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", 0.9, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", 0.9, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("artistic", 0.9, "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", 0.9, "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this license establishes the terms under which a given free software package may be copied"),
    ("bsl", 0.9, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("isc", 0.8, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", 0.9, "this is free and unencumbered software released into the public domain"),
    ("unlicense", 0.8, "(?:the )?unlicense"),
    ("wtfpl", 0.9, "you just do what the fuck you want to"),
    ("cc-by", 0.9, "this work is licensed under (?:a|the) creative commons attribution(?: [1-4] [05])?(?: international| unported)? license"),
    ("cc-by-sa", 0.9, "this work is licensed under (?:a|the) creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)? license"),
    ("cc-by-nc", 0.9, "this work is licensed under (?:a|the) creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)? license"),
    ("cc0", 0.9, "to the extent possible under law the (?:author|person who associated cc0 with this work) (?:has|have) waived all copyright"),
    ("ofl", 0.9, "this font software is licensed under the sil open font license"),
    ("gpl", 0.8, "gplv?[123](?: or later)?"),
    ("lgpl", 0.8, "lgplv?[23](?: 1)?(?: or later)?"),
    ("agpl", 0.8, "agplv?3(?: or later)?"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    confidence: float
    pattern: str


Groups = list[tuple[str, ...]]


def needs(pattern: str) -> Groups:
    """Groups of strings read off a pattern: ' match ' holds a string of every group, whatever way it matches.

    Patterns are literals, sets [..], alternatives (?:..|..) and the sign ? after any of them; other signs are refused.
    """
    text = f" {pattern} "

    def sequence(i: int) -> tuple[Groups, int]:
        groups, run = [], ""
        while i < len(text) and text[i] not in "|)":
            inner: Groups = []
            literal = ""
            if text.startswith("(?:", i):
                inner, i = alternatives(i + 3)
            elif text[i] == "[":
                i = text.index("]", i) + 1
            elif text[i].isalnum() or text[i] == " ":
                literal, i = text[i], i + 1
            else:
                raise ValueError(f"{text[i]!r} in {pattern!r}")
            maybe = text[i : i + 1] == "?"
            i += maybe
            if literal and not maybe:
                run += literal
            else:
                groups, run = [*groups, (run,), *([] if maybe else inner)], ""
        return [g for g in [*groups, (run,)] if all(g)], i

    def alternatives(i: int) -> tuple[Groups, int]:
        ways = []
        while True:
            groups, i = sequence(i)
            ways.append(groups)
            if text[i] == ")":
                break
            i += 1
        if len(ways) == 1:
            return ways[0], i + 1
        return ([tuple(x for w in ways for x in max(w, key=shortest))] if all(ways) else []), i + 1

    groups, end = sequence(0)
    if end < len(text):
        raise ValueError(f"alternatives outside (?:..) in {pattern!r}")
    return groups


def shortest(group: tuple[str, ...]) -> int:
    return min(map(len, group))


def gated(group: tuple[str, ...], words: tuple[str, ...]) -> bool:
    """Whether every string of the group holds one of the words."""
    return all(any(w in x for w in words) for x in group)


def gates(table: list[Rule]) -> tuple[str, ...]:
    """Strings of which every match of every rule holds one."""
    out = GATES
    for groups in (needs(r.pattern) for r in table):
        if not any(gated(g, out) for g in groups):
            out += max(groups, key=shortest)
    return out


def keywords(r: Rule) -> Groups:
    """The groups of a rule that are worth a look: those of three letters or more, gates last, the longest first."""
    groups = needs(r.pattern)
    long = [g for g in groups if shortest(g) >= 3] or [max(groups, key=shortest)]
    return sorted(long, key=lambda g: (gated(g, GATES), -shortest(g)))


def rules() -> list[Rule]:
    """All rules in order of priority: SPDX tags, then each family's templates from the most to the least exact, then single signatures."""
    out = [Rule(x, 1.0, f"spdx license identifier {tag}(?: (?:{v}))?(?: only| or later)?" if v else f"spdx license identifier {tag}") for x, _, v, tag in FAMILIES]
    for confidence, words, needed in TEMPLATES:
        for x, name, versions, _ in FAMILIES:
            if (needed and not versions) or (needed == "acronym" and x not in ACRONYMS):
                continue
            with_version = words if versions else words.replace("(?: (?:version |v ?)?(?:{v}))?", "").replace("(?: (?:{v}))?", "")
            out.append(Rule(x, confidence, with_version.replace("{n}", name).replace("{a}", ACRONYMS.get(x, "")).replace("{l}", LICENCE).replace("{v}", versions)))
    return out + [Rule(x, c, w) for x, c, w in SINGLE]


def spaced(text: Column) -> Column:
    """' word word ... ' with words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the A-Z-lower-cased text; ' ' if there is none. Null is empty."""
    t = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD, " ")
    t = F.when(t.startswith(" "), t).otherwise(F.concat(F.lit(" "), t))
    return F.when(t.endswith(" "), t).otherwise(F.concat(t, F.lit(" ")))


def spaces(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row although body names it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, join, chunk: int = 256) -> Column:
    """join over items[0..i] at each i (an associative join of two longs), in time that grows with the array's length.

    Chunks are folded by themselves, then joined to what stands before them; no fold carries the whole array.
    """
    none = F.array().cast("array<bigint>")
    fold = lambda xs: F.aggregate(xs, none, lambda a, x: F.array_append(a, let(F.get(a, F.size(a) - 1), lambda last: F.when(last.isNull(), x).otherwise(join(last, x)))))

    def whole(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / chunk).cast("int"))
        local = F.transform(starts, lambda c: fold(F.slice(xs, c * chunk + 1, F.lit(chunk))))
        after = lambda parts: let(fold(F.transform(parts, lambda p: F.element_at(p, -1))), lambda ends: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(let(F.get(ends, i - 1), lambda e: F.transform(p, lambda v: join(e, v)))))))
        return F.when(F.size(xs) == 0, none).otherwise(let(local, after))

    return let(items, whole)


def intervals(norm: Column, pattern: Column) -> Column:
    """Word intervals [s, e) of a pattern's matches, from the words before, in and between them."""
    whole = F.concat(F.lit(" (?:"), pattern, F.lit(")(?= )"))

    def places(hits: Column) -> Column:
        gaps = F.slice(F.split(norm, whole, -1), F.lit(1), F.size(hits))
        ends = running(F.zip_with(gaps, hits, lambda g, h: (spaces(g) + spaces(h)).cast("long")), lambda a, b: a + b)
        return F.zip_with(ends, hits, lambda e, h: F.struct((e - spaces(h)).alias("s"), e.alias("e")))

    return let(F.regexp_extract_all(norm, whole, F.lit(0)), places)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections of every document.

    detections: array of (label, rule, confidence, s, e) that stand, words s to e-1. base_labels and n_base count the
    phrases of BASE wherever their words stand consecutively, suppressed or not. score is the best confidence of a
    detection, 0 without one. Null and empty texts have no words and empty labels. Repeated rows come back repeated.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), spaced(F.col(text_col)).alias("norm"))
    d = d.select("doc_id", "norm", F.greatest(spaces(F.col("norm")) - 1, F.lit(0)).cast("long").alias("n_words"))
    pieces = []
    for i, phrase in enumerate(BASE):
        here = F.contains("norm", F.lit(f" {phrase} "))
        pieces.append(F.when(here, F.split("norm", f" {phrase}(?= )", -1)).alias(f"p{i}"))
    table = rules()
    gate = F.lit(False)
    for g in gates(table):
        gate = gate | F.contains("norm", F.lit(g))
    d = d.select("*", *pieces, gate.alias("gate"))
    count = [F.coalesce(F.size(f"p{i}") - 1, F.lit(0)) for i in range(len(BASE))]
    count = [F.when(F.col(f"p{i}").isNull(), F.lit(0)).otherwise(c) for i, c in enumerate(count)]
    firsts = [spaces(F.get(f"p{i}", F.lit(0))) for i in range(len(BASE))]
    lasts = [F.col("n_words") + 1 - len(p.split()) - spaces(F.element_at(f"p{i}", -1)) for i, p in enumerate(BASE)]
    base = F.array_compact(F.array(*[F.when(F.col(f"p{i}").isNotNull(), F.lit(x)) for i, x in enumerate(BASE.values())]))
    quoted = lambda g: "array(" + ", ".join(f"'{x}'" for x in g) + ")"
    literal = F.expr("array(" + ", ".join(f"named_struct('i', {i}, 'label', '{r.label}', 'c', {r.confidence}D, 'k', array({', '.join(map(quoted, keywords(r)))}), 'p', '{r.pattern}')" for i, r in enumerate(table)) + ")")
    tried = F.filter(literal, lambda r: F.forall(r["k"], lambda g: F.exists(g, lambda x: F.contains(F.col("norm"), x))))
    found = F.flatten(
        F.transform(
            tried,
            lambda r: F.transform(
                intervals(F.col("norm"), r["p"]),
                lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("minus_e"), r["i"].alias("rule"), r["label"].alias("label"), r["c"].alias("confidence")),
            ),
        )
    )
    d = d.select(
        "doc_id", "n_words", sum(count, F.lit(0)).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.sort_array(base).alias("base"), F.when(F.col("gate"), F.sort_array(found)).alias("found"),
    )
    # In order of start, then longest, then priority, a detection lies inside an earlier one exactly if it ends no later than some earlier one.
    def standing(found: Column, reach: Column) -> Column:
        return F.transform(found, lambda x, i: F.when((i == 0) | (F.get(reach, i - 1) < -x["minus_e"]), F.struct(
            x["label"].alias("label"), x["rule"].alias("rule"), x["confidence"].alias("confidence"), x["s"].alias("s"), (-x["minus_e"]).alias("e"))))

    hull = let(F.col("found"), lambda found: let(running(F.transform(found, lambda x: -x["minus_e"]), F.greatest), lambda reach: standing(found, reach)))
    d = d.withColumn("detections", F.coalesce(F.array_compact(hull), F.array().cast("array<struct<label:string,rule:int,confidence:double,s:bigint,e:bigint>>")))
    labels = F.sort_array(F.array_distinct(F.concat("base", F.transform("detections", lambda x: x["label"]))))
    score = F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "detections")
