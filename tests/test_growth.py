"""That work grows with what it is about, not with whole rows."""

from pyspark.sql import functions as F

from millrace import schema
from millrace.operators import synonyms
from millrace.plans.remote import REMOTE_TYPES, schema_problems
from millrace.plans.store import PostingStore
from millrace.sources.json_board import JsonBoard


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_schema_problems_join_nothing(spark):
    rows = [(1, p, t) for p, t in REMOTE_TYPES.items()] + [(2, "Name", "url"), (2, "Name", "title"), (2, "Name", None), (2, "Odd", "x"), (3, None, None), (None, "Name", "url")]
    found = schema_problems(spark.createDataFrame(rows, "k int, property string, type string"), "k")
    plan = _plan(found)
    assert "Join" not in plan and "Sort" not in plan
    want = [(2, "Name", "title", "url"), (2, "Name", "title", None)] + [(k, p, t, None) for k in (2, 3, None) for p, t in REMOTE_TYPES.items() if (k, p) != (2, "Name")]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert schema_problems(spark.createDataFrame([], "property string, type string")).count() == len(REMOTE_TYPES)


def test_a_store_shuffles_no_postings(spark, tmp_path, monkeypatch):
    """Only keys are; rows are written where they are."""
    plans, add = [], PostingStore._add

    def seen(self, wire, *args, **kw):
        plans.append(_plan(wire))
        return add(self, wire, *args, **kw)

    monkeypatch.setattr(PostingStore, "_add", seen)

    def rows(*keys):
        df = spark.createDataFrame([(f"https://x.example/{u}", i, p) for u, i, p in keys], "url string, id string, place int")
        df = df.withColumns({"title": F.concat(F.lit("t"), F.col("place")), "company": F.lit("c"), "source": F.lit("s"), "status": F.lit("new"), "work_mode": F.lit("unknown"), "fetched_at": F.lit("2026-01-01").cast("timestamp"), "description_raw": F.lit("x"), "raw_url": F.col("url")})
        own = {c: F.array().cast("array<string>") if c in schema.LISTS else F.lit(None).cast(schema.POSTING_SCHEMA[c].dataType) for c in schema.COLUMNS if c not in df.columns}
        return df.withColumns(own).withColumn("row", F.lit(1))

    store = PostingStore(spark, str(tmp_path / "s"))
    held = lambda: sorted((r["url"][-1], r["id"], r["title"]) for r in store.rows().collect())
    assert store.save(rows(("a", "1", 1), ("b", "2", 2)), "place") == 2
    # Of one url, and then of one id, the first; what is stored by url or by id stays.
    assert store.save(rows(("c", "3", 5), ("c", "4", 4), ("d", "4", 6), ("a", "7", 7), ("e", "2", 8), ("f", "9", 9)), "place") == 2
    assert held() == [("a", "1", "t1"), ("b", "2", "t2"), ("c", "4", "t4"), ("f", "9", "t9")]
    assert store.save(rows(("a", "1", 1)), "place") == 0
    assert store.update(rows(("a", "1", 3), ("z", "0", 4)).withColumn("status", F.lit("closed")), ["status"]) == 1
    assert [r["status"] for r in store.rows().orderBy("url").collect()] == ["closed", "new", "new", "new"]
    assert len(plans) == 4 and not [p for p in plans if "hashpartitioning" in p or "SortMergeJoin" in p]


def test_synonym_rounds_are_of_numbers(spark, monkeypatch):
    seen, find = [], synonyms.components

    def rounds(edges):
        seen.extend(t for _, t in edges.dtypes)
        return find(edges)

    monkeypatch.setattr(synonyms, "components", rounds)
    pairs = [("b", "c"), ("c", "b"), ("c", "a"), ("x", "x"), ("y", None), (None, "z"), (None, None), ("q", "p"), ("q", "p")]
    found = synonyms.synonym_classes(spark.createDataFrame(pairs, "left string, right string"))
    assert {r["term"]: r["class"] for r in found.collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "y", "z": "z", "p": "p", "q": "p"}
    assert seen == ["bigint", "bigint"] and found.count() == 8


def test_boards_in_lines(spark, tmp_path):
    job = '{"absolute_url": "https://x.example/%s", "title": "t"}'
    (tmp_path / "some.json").write_text("\n".join(['{"company": "one", "jobs": [%s, %s]}' % (job % 1, job % 2), '{"company": "two", "jobs": [%s]}' % (job % 3), "odd"]))
    source = JsonBoard({"path": str(tmp_path), "lines": True})
    found = source.fetch(spark).select("unit", "raw_url", "company").collect()
    assert sorted((r["unit"], r["raw_url"][-1], r["company"]) for r in found) == [("one", "1", "One"), ("one", "2", "One"), ("two", "3", "Two")]
    assert source.errors == ["some: the answer is not an object with a list of jobs"]
    assert len(JsonBoard({"path": str(tmp_path), "lines": True, "companies": ["two"]}).fetch(spark).collect()) == 1
