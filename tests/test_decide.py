"""Which operations of a push are decided together."""

from pyspark.sql import functions as F

from scopelake.operators import decide


def facts(spark, ops):
    """(seq, row, kind, group) over rows of which those that begin with `live` are stored."""
    rows = spark.createDataFrame(ops, "seq int, __row string, __kind string, group_id string").withColumns({"user_id": F.lit("u"), "__fixed": F.lit(None).cast("string"), "__known": F.col("__row").startswith("live"), "__live": F.col("__row").startswith("live")})
    none = {c: F.lit(None).cast(t) for c, t in (("__holder", "string"), ("__asked", "string"), ("__moved", "string"), ("__may", "map<string,int>"))}
    return rows.withColumns({"__label": F.col("__row"), "__mine": F.lit(False), **none})


def test_a_row_that_nothing_changes_ties_no_groups(spark):
    """Groups that patch one row, drop one that is not there and add one that is: each is a component of its own."""
    ops = [o for g in range(40) for o in ((4 * g, f"own{g}", "insert", f"g{g}"), (4 * g + 1, "none", "patch", f"g{g}"), (4 * g + 2, "gone", "delete", f"g{g}"), (4 * g + 3, "live", "insert", f"g{g}"))]
    placed = decide.with_component(decide.in_units(facts(spark, ops)))
    assert placed.select("__component").distinct().count() == 40
    got = {r.seq: r.reject_reason for r in decide.decide(facts(spark, ops)).collect()}
    assert set(got.values()) == {"groupRejected: Cannot patch none"} and len(got) == 160


def test_only_rows_of_several_units_make_edges(spark, monkeypatch):
    """Of a hundred groups with rows of their own two share one; a single operation goes where its row goes."""
    seen, whole = [], decide.components
    monkeypatch.setattr(decide, "components", lambda edges: seen.append(edges.count()) or whole(edges))
    ops = [(3 * g + k, f"r{g}.{k}", "insert", f"g{g:03}") for g in range(100) for k in range(3)] + [(1000, "r7.1", "delete", "g099"), (1001, "r7.1", "patch", None), (1002, "r8.0", "patch", None), (1003, "alone", "patch", None)]
    at = dict(decide.with_component(decide.in_units(facts(spark, ops))).select("seq", "__component").collect())
    assert seen == [1] and len(set(at.values())) == 100
    assert at[21] == at[22] == at[297] == at[1000] == at[1001] and at[24] == at[1002] and at[1003] not in (at[21], at[24])
    got = {r.seq: (r.reject_reason, r.no_op) for r in decide.decide(facts(spark, ops)).filter("seq >= 1000").collect()}
    assert got == {1000: (None, False), 1001: ("Cannot patch r7.1", False), 1002: (None, False), 1003: ("Cannot patch alone", False)}
