import pytest
from pyspark.sql import functions as F

from scopelake.operators import relations
from scopelake.plans.catalog import Manifest, TableDef, by_user, by_workspace, many, many_to_many, one, via_ids
from scopelake.plans.query import Database, Query, indexed, schema, server_indexed

ISSUES = TableDef("issues", schema(workspaceId="string", title="string", status="string", rank="double", projectId="string", tag_ids="array<string>"), by_workspace("workspaceId"), relations={"project": one("projects", "projectId"), "labels": via_ids("labels", "tag_ids"), "comments": many("comments", "issueId"), "linked": many_to_many("labels", "issue_labels", "issueId", "labelId")}, indexes={"byStatusRank": ("workspaceId", "status", "rank"), "byRank": ("workspaceId", "rank")})
TODOS = TableDef("todos", schema(ownerId="string", listId="string", createdAt="double"), by_user("ownerId"), indexes={"byList": ("ownerId", "listId", "createdAt")})


@pytest.fixture(scope="module")
def frames(spark):
    return {
        "issues": spark.createDataFrame([("i1", "w1", "one", "open", 1.0, "p1", ["l2", "l1", "ghost", "l2"], False), ("i2", "w1", "two", "open", 2.0, "gone", None, False), ("i3", "w1", "three", None, None, None, [], False), ("i4", "w2", "four", "closed", 0.0, "p1", None, False), ("i5", "w1", "five", "closed", 3.0, "p1", None, None), ("i6", "w1", "dead", "open", 9.0, None, None, True)], "_id string, workspaceId string, title string, status string, rank double, projectId string, tag_ids array<string>, _deleted boolean"),
        "projects": spark.createDataFrame([("p1", "w1", "alpha")], "_id string, workspaceId string, name string"),
        "labels": spark.createDataFrame([("l1", "w1", "urgent"), ("l2", "w1", "later")], "_id string, workspaceId string, name string"),
        "comments": spark.createDataFrame([("c2", "w1", "i1", "b", 2), ("c1", "w1", "i1", "a", 3), ("c3", "w2", "i1", "foreign", 1)], "_id string, workspaceId string, issueId string, body string, _seq int"),
        "issue_labels": spark.createDataFrame([("k1", "i1", "l2"), ("k2", "i1", "l1"), ("k3", "i1", "l2"), ("k4", "i1", "ghost")], "_id string, issueId string, labelId string"),
        "todos": spark.createDataFrame([("t1", "u1", "a", 2.0), ("t2", "u1", "a", 1.0), ("t3", "u2", "a", 0.0), ("t4", "u1", "b", 0.0)], "_id string, ownerId string, listId string, createdAt double"),
    }


def ids(df):
    return [r._id for r in df.collect()]


def test_scope_order_limit(frames):
    q = Query(ISSUES).scope(workspaceId="w1")
    assert ids(q.order("rank").to_df(frames)) == ["i3", "i1", "i2", "i5"]
    assert ids(q.order("rank", "desc").to_df(frames)) == ["i5", "i2", "i1", "i3"]
    assert ids(q.order("rank", "desc").limit(2).to_df(frames)) == ["i5", "i2"]
    assert ids(q.limit(-1).to_df(frames)) == [] and ids(q.limit(5).limit(1).order("title").to_df(frames)) == ["i5"]
    assert ids(Query(ISSUES).to_df(frames)) == [] and ids(Query(ISSUES).scope(workspaceId=None).to_df(frames)) == []
    assert sorted(ids(Query(TODOS).to_df(frames, user="u1"))) == ["t1", "t2", "t4"] and len(ids(Query(TODOS).to_df(frames))) == 4
    assert ids(q.where("status", "open").where(F.col("rank") > 1).to_df(frames)) == ["i2"]
    assert ids(q.where(lambda r: r["title"] == "five").to_df(frames)) == ["i5"]
    with pytest.raises(KeyError):
        q.order("nope")


def test_collation(spark):
    t = TableDef("t", schema(s="string"))
    rows = {"t": spark.createDataFrame([("1", "B"), ("2", "a"), ("3", "A"), ("4", "b")], "_id string, s string")}
    assert ids(Query(t).order("s").to_df(rows)) == ["3", "1", "2", "4"]
    assert ids(Query(t).order("s").collate("UNICODE").to_df(rows)) == ["2", "3", "4", "1"]


def test_relations(frames):
    q = Query(ISSUES).scope(workspaceId="w1").with_("project", "labels", "comments", "linked")
    assert q.reads == ["issues", "projects", "labels", "comments", "issue_labels"]
    rows = {r._id: r for r in q.to_df(frames).collect()}
    assert len(rows) == 4
    assert rows["i1"].project.name == "alpha" and rows["i2"].project is None
    assert [x.name for x in rows["i1"].labels] == ["later", "urgent", "later"] and rows["i2"].labels == [] and rows["i3"].labels == []
    assert [x.body for x in rows["i1"].comments] == ["b", "a"] and rows["i2"].comments == []
    assert [x.name for x in rows["i1"].linked] == ["later", "urgent"]
    assert len({r._id: r for r in q.to_df(frames, target_scope=False).collect()}["i1"].comments) == 3
    with pytest.raises(KeyError):
        q.with_("nope")


def test_groups_and_counts(frames):
    q = Query(ISSUES).scope(workspaceId="w1").order("rank", "desc")
    got = {r.key: [x._id for x in r.rows] for r in q.group_by("status").groups(frames).collect()}
    assert got == {"open": ["i2", "i1"], "closed": ["i5"], None: ["i3"]}
    firsts = [r.key for r in q.group_by("status").groups(frames).orderBy(F.col("first.o").desc_nulls_last()).collect()]
    assert firsts == ["closed", "open", None]
    assert {r.key: len(r.rows) for r in q.limit(2).group_by("status").groups(frames).collect()} == {"open": 1, "closed": 1}
    assert {r.key: r.n for r in q.limit(1).group_by("status").counts(frames).collect()} == {"open": 2, "closed": 1, None: 1}
    assert {r.key for r in q.group_by("rank").counts(frames).collect()} == {"1", "2", "3", None}
    assert q.counts(frames).first().n == 4


def test_indexed(frames):
    assert ids(indexed(TODOS, frames["todos"], "byList", ["u1", "a"], user="u1")) == ["t2", "t1"]
    assert ids(indexed(TODOS, frames["todos"], "byList", ["u1", "a"], descending=True)) == ["t1", "t2", "t3"]
    assert ids(server_indexed(TODOS, frames["todos"], "byList", ["u1"], "u1")) == ["t2", "t1", "t4"]
    with pytest.raises(PermissionError):
        server_indexed(TODOS, frames["todos"], "byList", ["u2"], "u1")


def test_explain(spark, tmp_path, frames):
    q = Query(ISSUES).scope(workspaceId="w1")
    assert q.fingerprint == Query(ISSUES).scope(workspaceId="w1").fingerprint != q.limit(1).fingerprint
    frames["issues"].write.parquet(str(tmp_path / "issues"))
    stored = {"issues": spark.read.parquet(str(tmp_path / "issues"))}
    e = q.filter({"status": "open", "rank": {"gt": 1}}).where(lambda r: True).order("rank").limit(3).explain(stored)
    assert (e["order"], e["limit"], e["predicates"], e["opaque"], e["scope_satisfied"]) == (("rank", False), 3, 1, 1, True)
    assert all(f"{c}" in e["pushed"][0] for c in ("EqualNullSafe(workspaceId,w1)", "EqualNullSafe(status,open)", "GreaterThan(rank"))
    assert not Query(ISSUES).explain(stored)["scope_satisfied"]


def test_order_survives_relations(spark, frames):
    """Joins that shuffle keep no order; the plan's order holds all the same."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = Query(ISSUES).scope(workspaceId="w1").with_("project", "labels", "comments", "linked")
        assert ids(q.order("rank", "desc").to_df(frames)) == ["i5", "i2", "i1", "i3"]
        assert ids(q.order("rank", "desc").limit(3).to_df(frames)) == ["i5", "i2", "i1"]
        assert ids(q.limit(2).to_df(frames)) == ["i1", "i2"]
        shadow = Query(ISSUES).scope(workspaceId="w1").related("rank", one("projects", "projectId"))
        assert ids(shadow.order("rank", "desc").to_df(frames)) == ["i5", "i2", "i1", "i3"]  # a relation in place of the sort column
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_database_and_manifest(frames):
    m = Manifest(1, [ISSUES, TODOS])
    db = Database(m, frames, "u1")
    assert sorted(ids(db.run(db.todos))) == ["t1", "t2", "t4"]
    assert ids(db.get("issues", "i6")) == [] and ids(db.get("issues", "i1")) == ["i1"]
    m.query("all", lambda tables, **_: tables["todos"])
    assert sorted(ids(db.call("all"))) == ["t1", "t2", "t4"]
    with pytest.raises(ValueError):
        m.add(TableDef("issues", schema(a="string")))
    with pytest.raises(ValueError):
        m.merge(Manifest(2))
    with pytest.raises(ValueError):
        TableDef("x", schema(a="string"), search_fields=("b",))


def test_membership(spark, frames):
    members = spark.createDataFrame([("u1", "w1", 20), ("u1", "w2", None), ("u2", "w2", 5)], "user_id string, scope_value string, role int")
    assert "i4" not in ids(relations.members_only(frames["issues"], "workspaceId", members, "u1"))
    assert {r.role for r in relations.with_role(frames["issues"], "workspaceId", members, "u2").collect()} == {None, 5}
