import random

import pytest
from pyspark.sql import functions as F

from scopelake.functions import keys, ranks
from scopelake.functions.text import tokenize
from scopelake.operators import search
from scopelake.plans.catalog import TableDef
from scopelake.plans.query import schema

T = TableDef("t", schema(title="string", body="string", updated_at="double", w="string"), search_fields=("title", "body"))


def test_tokenize(spark):
    cases = [("Fix the Login-Bug, now!", "fix the login bug now"), ("Café déjà-vu", "café déjà vu"), ("北京 city", "北京 city"), ("a < b", "a b"), ("<p>Hi&nbsp;<b>you</b> &amp;lt; &copy;x &frac12;</p>", "hi you lt x frac12"), (None, ""), ("", "")]
    got = spark.createDataFrame([(c,) for c, _ in cases], "c string").select(F.array_join(tokenize(F.col("c")), " ")).collect()
    assert [r[0] for r in got] == [w for _, w in cases]
    from pyspark.sql import types as Ty

    assert spark.range(1).select(tokenize(F.lit(1234.0), Ty.DoubleType())).first()[0] == ["1234"]
    assert spark.range(1).select(tokenize(F.array(F.lit("a b"), F.lit(None), F.lit("c")), Ty.ArrayType(Ty.StringType()))).first()[0] == ["a", "b", "c"]


def rows(spark, *r):
    return spark.createDataFrame(r, "_id string, title string, body string, updated_at double, w string")


def found(df, text, **kw):
    return [r.id for r in search.search(T, df, search.index(T, df), text, **kw).collect()]


def test_ranking(spark):
    df = rows(spark, ("body-hit", "x", "urgent", None, "a"), ("title-hit", "urgent", "y", None, "a"))
    assert found(df, "urgent") == ["title-hit", "body-hit"]
    assert found(df, "urgent", within=F.col("_id") == "body-hit") == ["body-hit"]
    df = rows(spark, ("prefix", "issues galore", "", None, "a"), ("exact", "issue", "", None, "a"))
    assert found(df, "issue") == ["exact", "prefix"] and found(df, "issue ") == ["exact", "prefix"]
    df = rows(spark, ("one", "issue alone", "", None, "a"), ("many", "issue issues issuer", "", None, "a"))
    assert found(df, "iss") == ["many", "one"]
    df = rows(spark, ("both", "login bug", "", None, "a"), ("half", "login", "", None, "a"), ("two", "bug", "login", None, "a"))
    assert found(df, "login bug") == ["both", "two"]
    df = rows(spark, ("none2", "q", "", None, "a"), ("old", "q", "", 100.0, "a"), ("new", "q", "", 200.0, "a"), ("none1", "q", "", None, "a"))
    assert found(df, "q") == ["new", "old", "none1", "none2"] and found(df, "q", limit=1) == ["new"] and found(df, "q", limit=0) == [] and len(found(df, "q", limit=-1)) == 4
    assert search.search(T, df, search.index(T, df), "q", limit=1).first().total == 4
    assert found(df, "") == [] and found(df, "  !") == []


def test_index_follows_changes(spark):
    df = rows(spark, ("a", "red", "", None, "w"), ("b", "blue", "", None, "w"))
    after = rows(spark, ("a", "green", "", None, "w")).withColumn("_deleted", F.lit(False)).union(rows(spark, ("b", "blue", "", None, "w")).withColumn("_deleted", F.lit(True)))
    got = search.update_index(T, search.index(T, df), after).collect()
    assert [(r.id, r.token) for r in got] == [("a", "green")]


def test_ranks(spark):
    r, held = random.Random(0), ["V"]
    for _ in range(300):
        i = r.randrange(len(held) + 1)
        new = ranks.rank_between(held[i - 1] if i else None, held[i] if i < len(held) else None, r)
        assert ranks.is_valid_rank(new)
        held.insert(i, new)
    assert held == sorted(held) and len(set(held)) == len(held)
    for n in (0, 1, 2, 63, 1000):
        out = ranks.rebalance(n)
        assert out == sorted(out) and len(set(out)) == n and all(map(ranks.is_valid_rank, out)) and ranks.rebalance(n) == out
    assert max(map(len, ranks.rebalance(1000))) <= 4
    for a, b in (("B", "A"), ("A", "A"), ("A0", None), ("", "B"), ("a!", "b")):
        with pytest.raises(ValueError):
            ranks.rank_between(a, b)
    df = spark.createDataFrame([("A", "B"), (None, "1"), ("z", None), (None, None)], "a string, b string")
    for x in df.select("a", "b", ranks.rank_between_column(F.col("a"), F.col("b")).alias("m")).collect():
        assert (x.a is None or x.a < x.m) and (x.b is None or x.m < x.b)
    valid = spark.createDataFrame([("A",), ("A0",), ("",), ("a-",), (None,), ("0z",), ("A\n",)], "r string").select(ranks.is_valid_rank_column(F.col("r"))).collect()
    assert [v[0] for v in valid] == [True, False, False, False, False, True, False]


def test_keys(spark):
    row = spark.range(1).select(keys.change_id(F.lit(7)).alias("c"), keys.scope_key("byUser", F.lit("me")).alias("u"), keys.scope_value(F.lit("byWorkspace:a:b")).alias("v"), keys.scope_kind(F.lit("byWorkspace:a:b")).alias("k"), keys.row_key(F.lit("t"), F.lit("i")).alias("r")).first()
    assert tuple(row) == ("000000000007", "u:me", "a:b", "byWorkspace", "t:i")


def test_ranks_by_position():
    for n in (1, 2, 7, 100):
        assert [ranks.rank_at(i, n) for i in range(n)] == ranks.rebalance(n)


def test_postings_are_not_moved(spark, tmp_path):
    """Each row makes its postings by itself; stored ones are sorted within the slices that rows were dealt to."""
    df = rows(spark, ("a", "red red blue", "blue green", None, "w"), ("b", None, "red", None, "w"))
    made = search.index(T, df)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = [("a", "blue", 0), ("a", "green", 1), ("a", "red", 0), ("b", "red", 1)]
    assert sorted((r.id, r.token, r.field) for r in made.collect()) == want
    stored = search.store(search.index(T, search.sliced(df)), str(tmp_path / "p"))
    assert sorted((r.id, r.token, r.field) for r in stored.collect()) == want


def test_ranks_in_whole_numbers(spark, tmp_path):
    """between() against fractions; the query spreads the rows of one small file over the cores."""
    from fractions import Fraction

    from scopelake.queries import QUERIES

    value = lambda s: sum(Fraction(ranks.DIGITS.index(c), 62 ** (i + 1)) for i, c in enumerate(s))

    def plain(low, high):
        a, b, scale = value(low or ""), value(high) if high else Fraction(1), 1
        while True:
            scale *= 62
            first, last = int(a * scale) + 1, int(b * scale) - (b * scale == int(b * scale))
            if first <= last:
                return Fraction((first + last + 1) // 2, scale)

    r = random.Random(4)
    for _ in range(3000):
        low, high = ("".join(r.choices("01Azz", k=r.randrange(7))) or None for _ in range(2))
        if high and value(low or "") >= value(high):
            with pytest.raises(ValueError):
                ranks.between(low, high)
        else:
            assert value(ranks.between(low, high)) == plain(low, high)
    spark.range(10).selectExpr("id as p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    made = QUERIES["rank_between"](spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and made.filter("above and below").count() == 10
