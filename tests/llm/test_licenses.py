import re

from scopelake.llm import licenses
from scopelake.llm.license_texts import SIGNATURES

TEXTS = [
    None,
    "",
    " .,! ",
    "Plain words, nothing more.",
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3. Copies: MIT License; MIT-license!",
    "Licensed under CC BY-NC 4.0.\ncc by cc by CC_BY",
    "unlicensed ccby ccc by gnu general public licenses apache licensed",
    "SPDX-License-Identifier: MIT license",
    "É Äpache license Ünïcode 北京 apache LİCENSE apache license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this",
    ("word " * 500 + "mit license. ") * 40,
    "mit license " * 3000,
    "x\x00mit\x7flicense\x1fy",
]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    low = f" {' '.join(words)} " if words else " "
    hits = []
    for k, (label, key, priority, sure, regex) in enumerate(licenses.rules()):
        if f" {key}" in low:
            hits += [(m.start(), -m.end(), priority, k, label, sure) for m in re.finditer(f"(?<= )(?:{regex})(?= )", low, re.A)]
    hits.sort()
    kept = []
    for i, h in enumerate(hits[:400]):
        if not any(g[2] <= h[2] and g[1] <= h[1] for g in hits[:i]):
            kept.append(h)
    score = max([h[5] for h in kept] + ([0.7] if at else []), default=0.0)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {h[4] for h in kept})), score


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], "x", 9)], "doc_id long, text string, labels string, n_words long")
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want = brute(TEXTS[4 if r.doc_id is None else r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == want, r.doc_id
    assert licenses.scan(docs.limit(0)).count() == 0


def test_suppression(spark):
    docs = spark.createDataFrame([(1, "Licensed under the GNU General Public License version 3"), (2, "released under CC BY-NC-SA 4.0")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.n_detections) for r in licenses.scan(docs).collect()}
    assert got == {1: ("gpl,gpl-3.0", 1), 2: ("cc-by,cc-by-nc-sa", 1)}


def test_rules_and_plan(spark):
    assert len(licenses.rules()) > 200
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licenses.scan(docs.repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1


def unfiltered(text, base):
    """Labels by every rule, whatever its keyword."""
    low = f" {' '.join(re.findall('[0-9a-z]+', text.lower()))} "
    hits = sorted((m.start(), -m.end(), priority, k, label) for k, (label, _, priority, _, regex) in enumerate(licenses.rules()) for m in re.finditer(f"(?<= )(?:{regex})(?= )", low, re.A))
    kept = {h[4] for i, h in enumerate(hits) if not any(g[2] <= h[2] and g[1] <= h[1] for g in hits[:i])}
    return ",".join(sorted(kept | {label for phrase, label in base.items() if f" {phrase} " in low}))


def test_keywords_hide_no_rule(spark):
    base = {"sesame phrase": "sesame"}
    short = {"GPLv1": "gpl-1.0", "GPLv2": "gpl-2.0", "GPLv3+": "gpl-3.0", "LGPLv2.1": "lgpl", "LGPLv3": "lgpl", "AGPLv3": "agpl", "MPLv2": "mpl-2.0", "MPL-2.0": "mpl-2.0", "gpl v2": "gpl-2.0", "LGPL": "lgpl"}
    texts = {"Licensed under the FreeBSD license": "bsd-2-clause", "FreeBSD License.": "bsd-2-clause", "a sesame phrase": "sesame", "lgplv agplv": ""}
    texts |= {name: label for name, label in short.items()} | {f"licensed under the {name}.": label for name, label in short.items()}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.labels for x in licenses.scan(docs, base=base).collect()}
    for i, (text, label) in enumerate(texts.items()):
        assert got[i] == unfiltered(text, base) == label, text
    odd = spark.createDataFrame([(1, "Zur \u00c9tude"), (2, "nothing")], "doc_id long, text string")
    assert {x.doc_id: x.labels for x in licenses.scan(odd, base={"\u00c9tude": "x"}).collect()} == {1: "x", 2: ""}


def test_each_signature(spark):
    """Every hand-written signature finds its example, by its keyword too, and nothing where other letters surround each word."""
    written = [*SIGNATURES]
    assert len(written) + len(licenses.NOTICES) + len(licenses.FAMILIES) > 200 and len({x[4] for x in written}) == len(written)
    for label, keyword, _, _, regex, example in written:
        whole = f"(?<= )(?:{regex})(?= )"
        for text in {example, example.replace("license", "licence")}:
            if re.search(whole, f" {text} "):
                assert f" {keyword}" in f" {text} ", (label, keyword, text)
        assert re.search(whole, f" {example} ") and not re.search(whole, f" {' '.join(f'x{w}x' for w in example.split())} "), example
    docs = spark.createDataFrame([(i, "Note: " + x[5].upper() + ".") for i, x in enumerate(written)], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(docs).collect()}
    for i, x in enumerate(written):
        assert got[i] == unfiltered("note " + x[5], licenses.BASE).split(","), x[5]
    assert sum(x[0] in got[i] for i, x in enumerate(written)) > 0.9 * len(written)  # others lie within a stronger one
