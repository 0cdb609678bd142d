import json
import math
import random

import pytest
from pyspark.sql import functions as F

from scopelake.plans.catalog import TableDef
from scopelake.plans.filters import OPERATORS, compile_filter, parse_filter, serialize_filter
from scopelake.plans.query import schema

TABLE = TableDef("t", schema(n="double", text="string", flag="boolean", tags="array<string>"))


def same(a, b):
    return (a is None and b is None) or (type(a) is type(b) or isinstance(a, float) and isinstance(b, int) and not isinstance(b, bool)) and a == b


def below(a, b):
    """-1, 0, 1, or None if either is not a number."""
    if a is None or b is None:
        return (a is not None) - (b is not None)
    if isinstance(a, float) and math.isnan(a):
        return None
    return (a > b) - (a < b)


def holds(row, spec):
    for k, v in spec.items():
        if k == "OR":
            ok = any(holds(row, x) for x in v)
        elif k == "AND":
            ok = all(holds(row, x) for x in v)
        elif k == "NOT":
            ok = not holds(row, v)
        else:
            ok = all(leaf(row[k], op, x) for op, x in (v.items() if isinstance(v, dict) else [("eq", v)]))
        if not ok:
            return False
    return True


def leaf(a, op, v):
    if op in ("eq", "ne"):
        return same(a, v) == (op == "eq")
    if op in ("in", "nin"):
        return any(same(a, x) for x in v) == (op == "in")
    if op in ("contains", "overlaps"):
        return isinstance(a, list) and any(same(x, y) for x in a for y in (v if op == "overlaps" else [v]))
    c = below(a, v)
    return c is None or {"lt": c < 0, "lte": c <= 0, "gt": c > 0, "gte": c >= 0}[op]


def tree(r, depth=2):
    out = {}
    for _ in range(r.randint(0, 3)):
        kind = r.random()
        if kind < 0.3 and depth:
            name = r.choice(["AND", "OR", "NOT"])
            out[name] = tree(r, depth - 1) if name == "NOT" else [tree(r, depth - 1) for _ in range(r.randint(0, 3))]
            continue
        col = r.choice(["n", "text", "flag", "tags"])
        values = {"n": [None, 0, 1, 2.5, -3], "text": [None, "", "a", "B", "b"], "flag": [None, True, False], "tags": [None, "x", "y", "z"]}[col]
        if col == "tags":
            op = r.choice(["contains", "overlaps"])
        else:
            op = r.choice([o for o in OPERATORS if o not in ("contains", "overlaps")])
        v = [r.choice(values) for _ in range(r.randint(0, 3))] if op in ("in", "nin", "overlaps") else r.choice(values)
        out[col] = v if op == "eq" and r.random() < 0.5 and not isinstance(v, list) else {op: v}
    return out


def test_random_trees_against_a_row_evaluator(spark):
    r = random.Random(0x5EED)
    rows = [(i, r.choice([None, 0.0, 1.0, 2.5, -3.0, float("nan")]), r.choice([None, "", "a", "B", "b", "c"]), r.choice([None, True, False]), r.choice([None, [], ["x"], ["y", None], ["z", "x"]])) for i in range(160)]
    df = spark.createDataFrame(rows, "id int, n double, text string, flag boolean, tags array<string>").cache()
    specs = [tree(r) for _ in range(160)]
    for i in range(0, len(specs), 40):
        part = specs[i : i + 40]
        got = df.select("id", *(compile_filter(s, TABLE).alias(f"f{k}") for k, s in enumerate(part))).collect()
        for g in got:
            row = dict(zip(("n", "text", "flag", "tags"), rows[g.id][1:]))
            for k, s in enumerate(part):
                assert g[f"f{k}"] is holds(row, s), (row, s)


def test_types_and_malformed_parts(spark):
    df = spark.createDataFrame([(1.0, "1", True, ["x"])], "n double, text string, flag boolean, tags array<string>")
    cases = [({"n": "1"}, False), ({"text": 1}, False), ({"text": {"ne": 1}}, True), ({"n": {"wat": 1}}, False), ({"n": {}}, False), ({"n": {"in": 5}}, False), ({"n": {"nin": 5}}, False), ({"OR": {}}, False), ({"AND": [5]}, False), ({"NOT": []}, False), ({}, True), ({"OR": []}, False), ({"AND": []}, True), ({"n": {"contains": 1}}, False), ({"tags": ["x"]}, False), ({"flag": {"gt": False}}, True), ({"n": {"lte": "1"}}, True)]
    got = df.select(*(compile_filter(s, TABLE).alias(f"c{i}") for i, (s, _) in enumerate(cases))).first()
    assert list(got) == [w for _, w in cases]
    with pytest.raises(KeyError):
        compile_filter({"nope": 1}, TABLE)


def test_parse_and_serialize():
    for text, code, path in [("not JSON", "invalid_json", "$"), ("[]", "invalid_filter", "$"), ('{"status":{"wat":1}}', "invalid_operator", "$.status.wat"), ('{"status":{"in":"open"}}', "invalid_operand", "$.status.in"), ('{"OR":{}}', "invalid_operand", "$.OR"), ('{"NOT":[]}', "invalid_filter", "$.NOT"), ('{"AND":[{"a":{"in":[1,[2]]}}]}', "invalid_operand", "$.AND[0].a.in[1]"), ('{"a":{}}', "invalid_operator", "$.a")]:
        spec, error = parse_filter(text)
        assert spec is None and (error.code, error.path) == (code, path)
    good = {"a": {"gte": 1, "nin": [None, 2]}, "OR": [{"b": None}, {"NOT": {"c": True}}]}
    assert parse_filter(serialize_filter(good)) == (good, None) and json.loads(serialize_filter(good)) == good
    loop = {}
    loop["NOT"] = loop
    for bad in (loop, {"a": float("nan")}, {"a": {"eq": [1]}}):
        with pytest.raises(TypeError):
            serialize_filter(bad)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(F.col("id").cast("double").alias("n"), F.lit("a").alias("text"), F.lit(True).alias("flag"), F.array(F.lit("x")).alias("tags")).write.parquet(path)
    plan = spark.read.parquet(path).filter(compile_filter({"text": {"lt": "b"}, "flag": True}, TABLE))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "LessThan(text,b)" in pushed and "EqualNullSafe(flag,true)" in pushed
