"""Views, counts and postings that deltas keep up to date, against a rebuild after random deltas."""

import random

import pytest

from scopelake.operators import search
from scopelake.operators.view import row_deltas
from scopelake.plans.catalog import TableDef
from scopelake.plans.query import Query, schema
from scopelake.sources import segments
from scopelake.sources.store import Store
from scopelake.streaming import live

T = TableDef("t", schema(status="string", rank="double", text="string"), search_fields=("text",))
ROW = "_id string, status string, rank double, text string, _version bigint, _deleted boolean"


def table(spark, rows):
    return spark.createDataFrame([(i, *r, 1, False) for i, r in rows.items()], ROW)


def steps(seed, n=60, rounds=4, size=6):
    """Tables by time: each a few random writes after the one before."""
    rng = random.Random(seed)
    make = lambda: (rng.choice(["open", "shut", None, "wait"]), rng.choice([None, 1.0, 2.5, float(rng.randrange(50))]), " ".join(rng.choices(["alpha", "alps", "beta", "gamma"], k=2)))
    rows = {f"r{k:03d}": make() for k in range(n)}
    yield dict(rows)
    for _ in range(rounds):
        for _ in range(size):
            i = f"r{rng.randrange(n + 20):03d}"
            if rng.random() < 0.4:
                rows.pop(i, None)
            else:
                rows[i] = make()
        yield dict(rows)


@pytest.mark.parametrize(
    "query",
    [
        lambda: Query(T).filter({"status": "open"}).order("rank").limit(5),
        lambda: Query(T).order("status", "desc").limit(30),
        lambda: Query(T).filter({"rank": {"gte": 2}}),
        lambda: Query(T).group_by("status").order("rank", "desc"),
    ],
)
def test_views_equal_a_rebuild(spark, tmp_path, query):
    query = query()
    s = Store(spark, str(tmp_path), "v")
    view, counts = live.LiveQuery(s, "q", query, range_rows=4), live.LiveCounts(s, "q", query)
    past = None
    for rows in steps(3, rounds=2, size=9):
        now = table(spark, rows)
        if past is None:
            view.reset(now), counts.reset(now)
        else:
            deltas = row_deltas(past, now).persist()
            before = s._folders("views/q#")
            touched = view.apply(deltas)
            counts.apply(deltas)
            after = s._folders("views/q#")
            assert len(before.items() - after.items()) == len(touched)  # the others lie where they were
        if query.group_field:
            want = query.group_positions({"t": now}).collect()
            assert [r._id for r in view.result().collect()] == [r._id for r in want]
            for key in ("open", None, "none such"):
                assert [r._id for r in view.group(key).collect()] == [r._id for r in want if r.key == key]
        else:
            assert [r._id for r in view.result().collect()] == [r._id for r in query.to_df({"t": now}).collect()]
        assert {tuple(r) for r in counts.result().collect()} == {tuple(r) for r in query.counts({"t": now}).collect()}
        past = now
    assert len(view._held()) > 2


def test_one_delta_touches_one_range(spark, tmp_path):
    """Twenty views and a delta of one row: only those that show it write, one range each; a freed place is filled."""
    s, rows = Store(spark, str(tmp_path), "n"), {f"r{k:03d}": ("open" if k % 2 else "shut", float(k), "x") for k in range(60)}
    now = table(spark, rows).persist()
    views = [live.LiveQuery(s, f"v{k}", Query(T).filter({"status": "open"} if k < 15 else {"status": "shut"}).order("rank").limit(3 + k), range_rows=6) for k in range(20)]
    for v in views[:2] + views[18:]:
        v.reset(now)
    del rows["r001"]
    deltas = row_deltas(now, table(spark, rows)).persist()
    assert [v.apply(deltas) for v in views[:2] + views[18:]] == [[0], [0], [], []]
    assert [r._id for r in views[0].result().collect()] == ["r003", "r005", "r007"]
    every = table(spark, {})
    gone = row_deltas(table(spark, rows), every)
    assert len(views[0].apply(gone)) > 1 and views[0].result().count() == 0
    assert views[0].apply(row_deltas(every, now)) and views[0].rows().count() == 30


def test_grouped_views_have_no_limit(spark, tmp_path):
    with pytest.raises(ValueError):
        live.LiveQuery(Store(spark, str(tmp_path), "g"), "g", Query(T).group_by("status").limit(3))


def test_segments_equal_a_new_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SEGMENTS", 3)
    s, past = Store(spark, str(tmp_path), "s"), None
    for rows in steps(5, rounds=3):
        now = table(spark, rows)
        deltas = row_deltas(past if past is not None else now.limit(0), now)
        before = s._folders("postings/t#")
        live.reindex(s, T, deltas)
        after = s._folders("postings/t#")
        assert len(before) > 2 or before.items() <= after.items()  # an update adds one segment, or many become one
        key = lambda df: sorted(map(tuple, df.collect()))
        assert key(segments.postings(s, T)) == key(search.index(T, now))
        past = now
    assert len(s._folders("postings/t#")) <= 3


def test_a_search_is_asked_only_if_it_is_concerned(spark, tmp_path):
    s, seen = Store(spark, str(tmp_path), "l"), []
    rows = {"a": ("open", 1.0, "alpha beta"), "b": ("open", 1.0, "gamma")}
    found = live.LiveSearch(s, T, "beta al")
    past = table(spark, {})

    def step(rows):
        nonlocal past
        now = table(spark, rows)
        deltas = row_deltas(past, now).persist()
        live.reindex(s, T, deltas)
        s.replace_all({}, None, lambda: s._stage(T, now.select(*Store.row_schema(T).fieldNames()), list(range(s.buckets))))
        past = now
        return found.refresh(lambda df: seen.append(sorted(r.id for r in df.collect())), deltas)

    assert step(rows) and seen == [["a"]] and found.asked == 1
    assert not step(rows | {"b": ("open", 1.0, "alpha gamma")}) and found.asked == 1
    assert step(rows | {"b": ("open", 1.0, "alps beta")}) and seen[-1] == ["a", "b"]
    assert step({"b": ("open", 1.0, "alps beta")}) and seen[-1] == ["b"] and found.asked == 3


def test_words_of_a_search_are_decoded():
    assert search.words("<b>a&amp;b</b> x&eacute;y &lt;q") == ["a", "b", "x", "y", "q"] and search.words(None) == []


def test_deltas_tell_the_row_before(spark):
    past, now = table(spark, {"a": ("open", 1.0, "x"), "b": ("open", 1.0, "x")}), table(spark, {"a": ("shut", 1.0, "x"), "c": ("open", 1.0, "x")})
    got = {r._id: (r.kind, r.was and r.was.status, r.row and r.row.status) for r in row_deltas(past, now).collect()}
    assert got == {"a": ("upsert", "open", "shut"), "b": ("delete", "open", None), "c": ("upsert", None, "open")}


def test_many_ranges_are_found_by_sorting(spark, tmp_path, monkeypatch):
    """Places are not looked up in an expression that lists all ranges, and a view of more ranges than sorted partitions is
    whole."""
    from scopelake.streaming import views

    monkeypatch.setattr(views, "PARTITIONS", 2)
    s, rows = Store(spark, str(tmp_path), "m"), {f"r{k:03d}": ("open", float(k % 7) if k % 9 else None, "x") for k in range(90)}
    now = table(spark, rows).persist()
    q = Query(T).filter({"status": "open"}).order("rank", "desc")
    view = live.LiveQuery(s, "a view", q, range_rows=5)
    view.reset(now)
    held = view._held()
    assert len(held) >= 18 and sum(r.n for r in held) == 90
    assert len(view._place(now, held)._jdf.queryExecution().optimizedPlan().toString()) < 4000
    placed = {r._id: r["__range"] for r in view._place(now, held).collect()}
    lies = {r._id: r["__range"] for r in view._ranged_rows(held, list(range(len(held)))).collect()}
    assert placed == lies and len(lies) == 90
    after = table(spark, {i: (r if int(i[1:]) % 3 else ("open", 3.0, "y")) for i, r in rows.items() if i > "r004"} | {"r900": ("open", None, "z")})
    assert view.apply(row_deltas(now, after))
    assert [r._id for r in view.result().collect()] == [r._id for r in q.to_df({"t": after}).collect()]
