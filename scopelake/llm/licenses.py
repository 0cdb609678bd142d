"""License scan: ordered signature rules over normalised words, gated by keywords, with containment suppression.

A text's words ([0-9a-z] and all beyond ASCII, A-Z lower-cased) are joined by single spaces. Rules are regular
expressions over that form: hand-written signatures of texts, notices and names (license_texts, NOTICES), and hand-written
names of license families in each of the hand-written frames in which a name stands ("licensed under the ...", "spdx
license identifier ..."). A rule runs only on texts that hold its keyword. Its
matches are intervals of the text with a priority (0 strongest). Matches are taken by start, longest first, then by
priority and order of the rules; one that lies within an earlier one of the same or a stronger priority is suppressed.

Everything is one expression per row: no join, no shuffle, no Python. The few base phrases of the contract are counted
by themselves and their labels always stay.

Edge cases: null and empty texts have no words, no labels and score 0.0. Repeated rows and further columns are harmless;
an empty table gives an empty one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import SIGNATURES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases and labels of the base scan.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Families as (label, keyword, name as a regular expression over normalised words).
FAMILIES = (
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl(?: version| ?v)? ?1(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?: version| ?v)? ?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?: version| ?v)? ?3(?: 0)?(?: only| or later)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl-2.0", "gnu general public", r"gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2(?: 0)?"),
    ("gpl-3.0", "gnu general public", r"gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)?"),
    ("gpl", "gnu general public", r"gnu general public licen[cs]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: version| v|v(?= ?[23]))?(?: ?[23](?: [01])?)?(?: only| or later)?"),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public licen[cs]e(?: version [23](?: [01])?)?"),
    ("lgpl", "library general public", r"(?:gnu )?library general public licen[cs]e"),
    ("agpl", "agpl", r"(?:gnu )?agpl(?: version| v|v(?= ?3))?(?: ?3(?: 0)?)?(?: only| or later)?"),
    ("agpl", "affero general public", r"(?:gnu )?affero general public licen[cs]e(?: version 3)?"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e (?:version |v ?)?1 1"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e (?:version |v ?)?2(?: 0)?"),
    ("apache-2.0", "apache", r"apache 2 0"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("mit", "mit", r"(?:the )?mit(?: expat| x11)? licen[cs]e"),
    ("mit-0", "mit 0", r"mit 0"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[cs]e)?"),
    ("bsd-2-clause", "freebsd", r"freebsd(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd licen[cs]e"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v ?)?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?"),
    ("mpl-2.0", "mpl", r"mpl ?(?:version |v ?)?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[cs]e(?: (?:version |v ?)?[12](?: 0)?)?"),
    ("cddl", "cddl", r"cddl(?: 1 [01])?"),
    ("cddl", "common development", r"common development and distribution licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("boost", "boost", r"boost software licen[cs]e(?: (?:version )?1 0)?"),
    ("artistic", "artistic", r"artistic licen[cs]e(?: (?:version )?[12] 0)?"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("python", "python", r"python software foundation licen[cs]e(?: version 2)?"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("eupl", "european union public", r"european union public licen[cs]e(?: (?:version |v ?)?1 [12])?"),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e(?: (?:version )?1 1)?"),
    ("odbl", "open database", r"open database licen[cs]e(?: (?:version |v ?)?1 0)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e(?: version 1 [123])?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1234] [05])?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1234] [05])?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1234] [05])?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1234] [05])?"),
    ("cc-by", "cc by", r"cc by(?: [1234] [05])?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1234] [05])?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1234] [05])?(?: international)?(?: licen[cs]e)?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1234] [05])?(?: international)?(?: licen[cs]e)?"),
)
#: Frames as (priority, confidence, expression with {} for the name).
FRAMES = (
    (0, 1.0, r"spdx licen[cs]e identifier {}"),
    (0, 0.98, r"(?:is |are )?(?:re)?(?:licen[cs]ed|released|distributed|published|available|provided|made available)(?: to you)? under(?: the)?(?: terms of)?(?: the)? {}"),
    (0, 0.95, r"(?:subject to|governed by|covered by|in accordance with|see|under) the (?:terms (?:and conditions )?of the )?{}"),
    (1, 0.9, r"{} licen[cs]e (?:agreement|text|notice|file)"),
    (1, 0.85, r"(?:licen[cs]e|licen[cs]ed?) (?:is )?{}"),
    (2, 0.7, r"{}"),
)
#: Notices that stand by themselves, as (label, keyword, priority, confidence, expression).
NOTICES = (
    ("mit", "spdx", 0, 1.0, r"spdx licen[cs]e identifier mit"),
    ("mit", "permission is hereby granted", 0, 0.97, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy", 0, 0.95, r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", 0, 0.95, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name", 1, 0.9, r"neither the name of .{1,80}? nor the names of its contributors"),
    ("zlib", "this software is provided as is", 1, 0.8, r"this software is provided as is without any express or implied warranty in no event"),
    ("gpl", "this program is free software", 0, 0.97, r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("unlicense", "free and unencumbered", 0, 0.97, r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", 1, 0.85, r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain"),
    ("proprietary", "all rights reserved", 2, 0.6, r"(?:copyright )(?:c )?(?:\d{4} )?.{0,60}?all rights reserved"),
    ("proprietary", "proprietary and confidential", 1, 0.8, r"proprietary and confidential"),
)


def rules() -> list[tuple[str, str, int, float, str]]:
    """All rules in order: (label, keyword, priority, confidence, regular expression)."""
    made = [(label, keyword, priority, sure, frame.replace("{}", f"(?:{name})")) for priority, sure, frame in FRAMES for label, keyword, name in FAMILIES]
    return [*NOTICES, *(rule[:5] for rule in SIGNATURES), *made]


def _needs_license(regex: str) -> bool:
    """Whether every match holds the letters "licen": what is optional, or one of several, does not count."""
    needed = regex
    while (less := re.sub(r"\((?:\?:)?[^()]*\)\??", "", needed)) != needed:
        needed = less
    return "licen" in needed and "|" not in needed


def gates(base: dict[str, str]) -> list[str]:
    """Strings of which every text that any rule or base phrase matches holds one, few as they are tried on every text."""
    # Folding may change what lies beyond ASCII, so a phrase with such characters lets every text through.
    found = {f" {p}" if p.isascii() else "" for p in base}
    for keyword, regex in [*((k, r) for _, k, _, _, r in NOTICES), *((k, r) for _, k, _, _, r, _ in SIGNATURES), *((k, r) for _, k, r in FAMILIES)]:
        found.add("licen" if _needs_license(regex) else f" {keyword}")
    return sorted(g for g in found if not any(h != g and h in g for h in found))


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __words: the lower-cased words joined by spaces, with a space at either end (" " if there are none)."""
    joined = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    return docs.withColumn("__words", F.when(joined == "", " ").otherwise(F.concat(F.lit(" "), joined, F.lit(" "))))


def _any(col: F.Column, phrases) -> F.Column:
    found = F.lit(False)
    for p in phrases:
        found = found | col.contains(p)
    return found


def _places(words: F.Column, phrase: str) -> F.Column:
    """Starts, in words from 0, at which the phrase stands in the array of words."""
    parts = phrase.split()

    def here(i):
        same = F.get(words, i) == parts[0]
        for k, w in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == w)
        return F.coalesce(same, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def _hits(words: F.Column, rule: F.Column) -> F.Column:
    """The matches of a rule in the words, as intervals with what the rule says."""
    pattern = rule["pattern"]
    gaps, found = F.split(words, pattern, -1), F.regexp_extract_all(words, pattern, F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        stop = begin + F.length(pair["hit"])
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), stop.alias("stop")))).alias("spans"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    spans = F.aggregate(pairs, start, step)["spans"]
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), rule["priority"].alias("priority"), rule["order"].alias("order"), rule["label"].alias("label"), rule["sure"].alias("sure")))


def _kept(hits: F.Column) -> F.Column:
    """Distinct labels and the highest confidence of the hits that no earlier one suppresses."""
    start = F.struct(F.array(F.lit(-1), F.lit(-1), F.lit(-1)).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).alias("n"))

    def step(acc, x):
        stop = -x["back"]
        hidden = F.exists(F.slice(acc["reach"], F.lit(1), x["priority"] + 1), lambda r: r >= stop)
        reach = F.transform(acc["reach"], lambda r, i: F.when(i == x["priority"], F.greatest(r, stop)).otherwise(r))
        return F.struct(
            reach.alias("reach"),
            F.when(hidden, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(x["label"]))).alias("labels"),
            F.when(hidden, acc["score"]).otherwise(F.greatest(acc["score"], x["sure"])).alias("score"),
            (acc["n"] + F.when(hidden, 0).otherwise(1)).alias("n"),
        )

    return F.aggregate(F.array_sort(hits), start, step)


def scan(docs: DataFrame, text: str = "text", base: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    base = BASE if base is None else base
    table = rules()
    by_key: dict[str, list[F.Column]] = {}
    for k, (label, key, priority, sure, regex) in enumerate(table):
        by_key.setdefault(f" {key}", []).append(F.struct(F.lit(k).alias("order"), F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(sure).alias("sure"), F.lit(f"(?<= )(?:{regex})(?= )").alias("pattern")))
    literal = F.array(*(F.struct(F.lit(key).alias("keyword"), F.array(*own).alias("rules")) for key, own in by_key.items()))
    # lower() may fold more than A-Z; it only decides which rows are looked at with A-Z lowered exactly.
    df = with_words(docs.select("doc_id", F.col(text).alias("text"))).select("doc_id", "__words").withColumn("__folded", F.lower("__words"))
    gated = _any(F.col("__folded"), gates(base))
    df = df.select("doc_id", (F.length("__words") - F.length(F.replace("__words", F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"), F.when(gated, F.translate("__words", UPPER, LOWER)).alias("__low"))
    # A column of its own: inside a lambda, Spark would split the text again for every word.
    df = df.withColumn("__list", F.split(F.trim("__low"), " "))
    words = F.col("__list")
    based = F.array(*(F.struct(F.lit(label).alias("label"), F.when(F.col("__low").contains(f" {phrase} "), _places(words, phrase)).otherwise(F.array().cast("array<int>")).alias("at")) for phrase, label in base.items()))
    chosen = F.flatten(F.transform(F.filter(literal, lambda r: F.col("__low").contains(r["keyword"])), lambda r: r["rules"]))
    matching = F.filter(chosen, lambda r: F.rlike(F.col("__low"), r["pattern"]))
    hits = F.flatten(F.transform(matching, lambda r: _hits(F.col("__low"), r)))
    df = df.select("doc_id", "n_words", F.when(F.col("__low").isNotNull(), F.struct(based.alias("base"), _kept(hits).alias("kept"))).alias("__found"))
    starts = F.flatten(F.transform("__found.base", lambda b: b["at"]))
    of_base = F.transform(F.filter("__found.base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    df = df.select("doc_id", "n_words", starts.alias("__at"), of_base.alias("__base"), F.col("__found.kept").alias("__kept"))
    none = F.array().cast("array<string>")
    return df.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("__at"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("__at").cast("long").alias("first_word"),
        F.array_max("__at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.coalesce("__base", none))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("__base", none), F.coalesce("__kept.labels", none))), ",").alias("labels"),
        F.coalesce(F.greatest(F.col("__kept.score"), F.when(F.size("__base") > 0, 0.7)), F.lit(0.0)).alias("score"),
        F.coalesce("__kept.n", F.lit(0)).alias("n_detections"),
    )
