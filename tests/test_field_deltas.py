"""How often patches are read where they become deltas, and where deltas are merged."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scopelake.operators import push
from scopelake.plans.catalog import TableDef
from scopelake.plans.query import schema

TABLE = TableDef("t", schema(labels="array<string>", n="bigint"), set_fields=("labels",), counter_fields=("n",))


def test_what_compares_elements_reads_no_text(spark):
    """The wanted elements are a column by then, and were read again for each element before."""
    ops = spark.createDataFrame([("o", "a", "patch", '{"labels":["x","z"],"n":9}')], "op_id string, id string, kind string, patch string")
    rows = spark.createDataFrame([("a", ["x", "y"], 4)], "_id string, labels array<string>, n bigint")
    made = push.field_deltas(TABLE, ops, rows)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not any("from_json" in part.split(")", 1)[0] for part in plan.split("exists(")[1:])
    assert [r.patch for r in made.collect()] == ['{"labels":{"__lfSet":{"add":["z"],"remove":["y"]}},"n":{"__lfCounter":5}}']


def test_deltas_and_values_side_by_side(spark):
    """A delta reads null as a value, and a value beside it is read."""
    texts = spark.createDataFrame([('{"labels":{"__lfSet":{"add":["z"]}},"n":3}',), ('{"labels":["q"],"n":{"__lfCounter":2}}',), ('{"labels":{"__lfSet":null},"n":null}',), (None,)], "t string")
    got = texts.select(push._row(TABLE, F.col("t")).alias("r")).select("r.*")
    assert got.schema["labels"].dataType == T.ArrayType(T.StringType()) and [tuple(r) for r in got.collect()] == [(None, 3), (["q"], None), (None, None), (None, None)]
