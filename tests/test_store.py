"""The store: inserts, updates, scopes, pages, unreadable rows, versions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace import schema
from millrace.functions.urls import normalize_url, posting_id
from millrace.operators import filters
from millrace.operators.filters import Scope, applied_at, order, resolve, resolve_languages, with_places
from millrace.operators.runs import backfill_ids, limit_kept, within_budget
from millrace.plans import store as stores
from millrace.plans.store import PostingStore, Store, StoreConflict, StoreError, StoreUnreachable, open_store, register_store, store_names

NOW = dt.datetime(2026, 1, 2, 3, 4, 5)


def make(spark, rows):
    """Postings of (url, title, other fields)."""
    full = []
    for url, title, more in rows:
        own = {"url": url, "raw_url": url, "title": title, "company": "C", "source": "s", "description_raw": "", "work_mode": "unknown", "fetched_at": NOW, "status": "new"} | more
        full.append(tuple(own.get(c, [] if c in schema.LISTS else None) for c in schema.COLUMNS))
    df = spark.createDataFrame(full, schema.POSTING_SCHEMA).withColumn("url", normalize_url(F.col("url")))
    return df.withColumn("id", posting_id(F.col("url"))).coalesce(1)


@pytest.fixture
def store(spark, tmp_path):
    return PostingStore(spark, str(tmp_path / "store"))


def test_insert_once(spark, store):
    a = make(spark, [("https://h/1?utm_term=a", "first", {"score": 5}), ("https://h/1?gclid=b", "second", {})])
    assert store.save(a) == 1
    kept = store.get("https://h/1/").first()["title"]
    assert kept == "second"  # by raw_url, as both were fetched at one time
    assert store.save(make(spark, [("https://h/1", "third", {}), ("https://h/2", "t", {}), ("https://h/3", "t", {})])) == 2
    assert (store.get("https://h/1").first()["title"], store.count()) == (kept, 3)
    assert store.save(a) == 0
    placed = make(spark, [("https://h/9#a", "one", {}), ("https://h/9#b", "two", {})]).withColumn("n", F.when(F.col("title") == "two", 1).otherwise(2))
    assert store.save(placed, "n") == 1 and store.get("https://h/9").first()["title"] == "two"


def test_round_trip(spark, store):
    lists = ['a "b"', "c; d", "é"]
    store.save(make(spark, [("https://h/1", "t", {"matched_skills": lists, "location_match": False, "applied_at": NOW, "score": 0})]))
    row = store.get("https://h/1").first()
    assert (row["matched_skills"], row["penalized_skills"], row["location_match"], row["work_mode_match"], row["applied_at"], row["score"]) == (lists, [], False, None, NOW, 0)


def test_updates(spark, store):
    store.save(make(spark, [("https://h/1", "t", {}), ("https://h/2", "u", {})]))
    new = make(spark, [("https://h/1", "changed", {"score": 40, "summary": "s", "matched_skills": ["a"]}), ("https://h/9", "t", {"score": 1})])
    assert store.update_scores(new) == 1
    row = store.get("https://h/1").first()
    assert (row["score"], row["title"], row["matched_skills"]) == (40, "t", ["a"])
    assert store.update_status("https://h/2", "applied", F.lit(NOW)) is True
    assert store.get("https://h/2").first()["applied_at"] == NOW
    assert store.update_status("https://h/2", "closed") is True
    assert store.get("https://h/2").first()["applied_at"] is None
    assert store.update_status("https://h/8", "closed") is False
    with pytest.raises(ValueError):
        store.update_status("https://h/2", "on the moon")


def test_scopes_and_pages(spark, store):
    rows = [(f"https://h/{k}", f"t{k}", {"score": None if k == 0 else 20 * k, "detected_language": [None, "en", "fr", "en", "de"][k], "source": "ab"[k % 2], "work_mode": "remote" if k < 2 else "onsite"}) for k in range(5)]
    store.save(make(spark, rows))
    titles = lambda s: {r["title"] for r in store.list(s).collect()}
    assert titles(Scope(min_score=40)) == {"t2", "t3", "t4"}
    assert titles(Scope(max_score=40)) == {"t1", "t2"}
    assert titles(Scope(scored=False)) == {"t0"}
    assert titles(Scope(languages=("en",))) == {"t0", "t1", "t3"}
    assert titles(Scope(source="a", remote=True)) == {"t0"}
    assert store.count(Scope(scored=True)) == 4
    with pytest.raises(ValueError):
        Scope(scored=False, min_score=1)
    pages = [[r["id"] for r in store.list(limit=2, offset=k).collect()] for k in (0, 2, 4, 99)]
    assert [len(p) for p in pages] == [2, 2, 1, 0]
    assert sum(pages, []) == sorted(sum(pages, []))
    assert len(store.list(offset=3).collect()) == 2


def test_unreadable_rows(spark, store):
    bad = [("url", "h/1"), ("work_mode", "submarine"), ("status", "on the moon"), ("fetched_at", "half past nine"), ("published_at", "30 February"), ("eligible_locations", "[1, "), ("matched_skills", "}"), ("title", "\t")]
    store.save(make(spark, [(f"https://h/{k}", "t", {}) for k in range(len(bad) + 1)]))
    wire = store.wire().withColumn("k", F.regexp_extract("raw_url", r"(\d+)$", 1).cast("int"))
    for k, (c, v) in enumerate(bad):
        wire = wire.withColumn(c, F.when(F.col("k") == k, v).otherwise(F.col(c)))
    store._add(wire.drop("k"), whole=True)
    assert [r["raw_url"] for r in store.rows().collect()] == ["https://h/8"]
    assert (store.unreadable_rows, store.count()) == (8, 9)
    # They take the places of a page.
    assert sum(len(store.list(limit=3, offset=k).collect()) for k in (0, 3, 6)) == 1


def test_a_change_that_dies_leaves_nothing(spark, store, monkeypatch):
    """At each step of a change: while it writes, before and in the rename, and after it."""
    store.save(make(spark, [("https://h/1", "t", {})]))
    rows = make(spark, [("https://h/2", "u", {})])
    broken = rows.withColumn("title", F.when(F.rand() < 2, F.raise_error(F.lit("no"))).otherwise("x"))
    with pytest.raises(Exception, match="no"):
        store.save(broken)
    publish = store._publish

    def die(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "_publish", die)
    with pytest.raises(KeyboardInterrupt):
        store.save(rows)
    monkeypatch.setattr(store, "_publish", lambda *args: (publish(*args), die()))
    with pytest.raises(KeyboardInterrupt):
        store.save(rows)
    again = PostingStore(spark, store.path)
    assert again.count() == 2  # the last one had been done
    assert again.save(rows) == 0 and again.save(make(spark, [("https://h/3", "v", {})])) == 1
    assert PostingStore(spark, store.path).count() == 3


def test_two_writers(spark, store):
    store.save(make(spark, [("https://h/1", "t", {})]))
    number = len(store._batches())
    for name in ("_writing/a", "_writing/b"):
        store.wire().write.parquet(f"{store.path}/{name}")
    store._publish("_writing/a", f"format=4/batch={number:08d}-more", number, 4)
    with pytest.raises(StoreError):
        store._publish("_writing/b", f"format=4/batch={number:08d}-more", number, 4)
    assert store.count() == 1


def test_a_change_between_reading_and_writing(spark, store, monkeypatch):
    """The second writer has read rows that are no longer the latest: it fails, or is made again from those that are."""
    store.save(make(spark, [("https://h/1", "t", {}), ("https://h/2", "u", {})]))
    score = make(spark, [("https://h/1", "x", {"score": 40, "summary": "s"})])
    for tries in (1, 3):
        first, other = PostingStore(spark, store.path, tries), PostingStore(spark, store.path)
        add, status = first._add, ["applied", "closed"][tries > 1]

        def late(*args, **kwargs):
            if not late.done:  # another change comes first, once
                late.done = other.update_status("https://h/1", status)
            return add(*args, **kwargs)

        late.done = False
        monkeypatch.setattr(first, "_add", late)
        if tries == 1:
            with pytest.raises(StoreConflict):
                first.update_scores(score)
            assert store.get("https://h/1").first()["score"] is None
        else:
            assert first.update_scores(score) == 1
            assert store.get("https://h/1").first()["score"] == 40
        assert store.get("https://h/1").first()["status"] == status
    # An insert that was overtaken inserts nothing twice.
    rows = make(spark, [("https://h/3", "v", {}), ("https://h/4", "w", {})])
    first = PostingStore(spark, store.path)
    add, done = first._add, []
    monkeypatch.setattr(first, "_add", lambda *a, **k: (done or done.append(store.save(rows.limit(1))), add(*a, **k))[1])
    assert first.save(rows) == 1 and store.count() == 4


def test_an_insert_reads_batches_that_may_hold_its_keys(spark, store):
    for k in range(6):
        store.save(make(spark, [(f"https://h/{k}/{n}", "t", {}) for n in range(40)]))
    store.update_status("https://h/2/7", "applied")
    names = store._batches()
    wanted = make(spark, [("https://h/2/7", "t", {}), ("https://h/2/8", "t", {}), ("https://new/1", "t", {}), ("https://h/4/1", "t", {})])
    read = store.may_hold(wanted, names)
    assert {names[2], names[4]} <= set(read) and len(read) <= 3  # a filter may err, rarely
    files = store._rows(names=read).select("url", "id").inputFiles()
    assert {f.split("/")[-2] for f in files} == set(read)
    assert len(store.may_hold(make(spark, [(f"https://other/{n}", "t", {}) for n in range(30)]), names)) <= 2
    assert store.save(wanted) == 1 and store.count() == 241
    store._fs.delete(store._at("format=4", names[0], "_keys"), True)
    assert names[0] in store.may_hold(wanted, names)  # a batch without a filter is read


def test_no_posting_is_shuffled(spark, store, monkeypatch):
    store.save(make(spark, [(f"https://h/{k}", "t", {}) for k in range(20)]))
    store.update_scores(make(spark, [(f"https://h/{k}", "t", {"score": k}) for k in range(5)]))
    store.update_scores(make(spark, [(f"https://h/{k}", "t", {"score": 9}) for k in range(2)]))
    plan = store.rows()._jdf.queryExecution().executedPlan().toString()
    # Only urls and batches are exchanged.
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert sorted(r["score"] for r in store.rows().collect() if r["score"] is not None) == [2, 3, 4, 9, 9]
    monkeypatch.setattr(stores, "EDITS", 8)
    store.update_scores(make(spark, [("https://h/19", "t", {"score": 1}), ("https://h/18", "t", {"score": 1})]))
    assert [n.split("-")[1] for n in store._batches()] == ["all"]  # above the bound, so compacted
    assert sorted(r["score"] for r in store.rows().collect() if r["score"] is not None) == [1, 1, 2, 3, 4, 9, 9]


def test_compaction(spark, store):
    store.save(make(spark, [(f"https://h/{k}", "t", {}) for k in range(4)]))
    for k in range(3):
        store.update_status(f"https://h/{k}", "applied")
    before = sorted(map(str, store.rows().collect()))
    assert len(store._batches()) == 4
    store.compact()
    assert len(store._batches()) == 1 and sorted(map(str, store.rows().collect())) == before
    assert store.update_status("https://h/0", "closed") and store.get("https://h/0").first()["status"] == "closed"
    # A look-up reads the row groups that may have the id.
    plan = store.get("https://h/1")._jdf.queryExecution().toString()
    assert "EqualTo(id," in plan


def test_backends(spark, tmp_path):
    assert store_names() == ["parquet"] and isinstance(open_store(spark, {"path": str(tmp_path / "a")}), Store)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "notes.txt").write_text("x")
    (tmp_path / "file").write_text("x")
    for bad, kind in (({"backend": "paper"}, StoreError), ({"path": str(tmp_path / "b")}, StoreError), ({"typo": 1}, StoreError), ({"path": str(tmp_path / "file" / "c")}, StoreUnreachable)):
        with pytest.raises(kind):
            open_store(spark, bad)
    with pytest.raises(ValueError):
        register_store("parquet")(open_store)


def test_resolve(spark, store):
    store.save(make(spark, [("https://h/1", "t", {}), ("https://h/2", "u", {})]))
    own = store.get("https://h/1").first()["id"]
    store.update_status("https://h/1", "applied")
    assert [r["status"] for r in store.resolve(own[:6].upper()).collect()] == ["applied"]
    assert store.resolve("HTTP://H/2").first()["title"] == "u" and store.find(own[:4]).count() == 1
    assert resolve(store.rows(), own[:5]).count() == 1
    with pytest.raises(ValueError):
        store.resolve("zz")


def test_migration(spark, tmp_path):
    store = PostingStore(spark, str(tmp_path / "old"))
    old = schema.encode(make(spark, [("https://h/1", "t", {"unmatched_profile_skills": ["a"]})]).select(*schema.COLUMNS))
    old = old.drop("id", "detected_language", "missing_requirements", "penalized_skills", *schema.FLAGS).withColumnRenamed("unmatched_profile_skills", "missing_skills")
    store._add(old, version=2)
    again = PostingStore(spark, store.path)
    row = again.rows().first()
    assert (row["unmatched_profile_skills"], row["penalized_skills"], len(row["id"])) == (["a"], [], 12)
    assert again._versions() == [2, 4]
    assert PostingStore(spark, store.path).count() == 1
    again._add(again.wire(), version=9)
    with pytest.raises(StoreError):
        PostingStore(spark, store.path)


def test_backfill(spark):
    rows = spark.createDataFrame([("b", None), ("a", None), ("c", "k2"), ("d", None)], "url string, id string")
    new = F.when(F.col("url") == "d", "k2").otherwise("k1")
    assert {r["url"]: r["id"] for r in backfill_ids(rows, new).collect()} == {"a": "k1", "b": None, "c": "k2", "d": None}


def test_limits(spark):
    items = spark.createDataFrame([("s", k, k % 2 == 1) for k in range(8)], "unit string, seq int, ok boolean")
    assert sorted(r["seq"] for r in limit_kept(items, "unit", "seq", F.col("ok"), 2).collect()) == [0, 1, 2, 3]
    budget = within_budget(items.withColumn("cost", F.lit(2)), [F.asc("seq")], F.col("cost"), 5, "seq")
    assert [(r["outcome"], r["spent_before"]) for r in budget.orderBy("seq").collect()] == [("scored", 0), ("scored", 2), ("stopped", 4)] + [("pending", None)] * 5
    two = items.unionByName(items.withColumn("unit", F.lit("t")).withColumn("seq", F.col("seq") + 10))
    got = within_budget(two.withColumn("place", F.lit(1)), [F.desc("seq")], 1 + F.col("seq") % 3, 6, "seq", "unit").orderBy("seq")
    want = {}
    for unit in ("s", "t"):
        spent, done = 0, False
        for r in sorted((r for r in two.collect() if r["unit"] == unit), key=lambda r: -r["seq"]):
            cost = 1 + r["seq"] % 3
            want[r["seq"]] = "pending" if done else "scored" if spent + cost <= 6 else "stopped"
            spent, done = spent + cost, done or spent + cost > 6
    assert {r["seq"]: r["outcome"] for r in got.collect()} == want and "place" in got.columns
    assert within_budget(two, [F.asc("seq")], F.lit(1), 0, "seq", "unit").filter("outcome = 'stopped'").count() == 2


def test_places(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.lit(1).alias("Part"), F.lit(2).alias("number"), F.lit(3).alias("before"))
    got = with_places(rows, [F.desc("k")]).collect()
    assert sorted((r["place"], r["k"]) for r in got) == [(n + 1, 499 - n) for n in range(500)]
    assert with_places(rows.limit(0), [F.desc("k")]).count() == 0


def test_places_are_one_write(spark, monkeypatch):
    """Of rows that differ from pass to pass, too, each has a place of its own."""
    written = []
    monkeypatch.setattr(filters, "stage", lambda df, label, keep=filters.stage: (written.append(label), keep(df, label))[1])
    got = with_places(spark.range(300).withColumn("k", F.rand()), [F.asc("k")]).collect()
    assert written == ["ordered"] and sorted(r["place"] for r in got) == list(range(1, 301))
    assert [r["k"] for r in sorted(got, key=lambda r: r["place"])] == sorted(r["k"] for r in got)


def test_deep_pages(spark, store, monkeypatch):
    monkeypatch.setattr(filters, "DEEP", 3)
    store.save(make(spark, [(f"https://h/{k}", f"t{k}", {}) for k in range(9)]))
    every = [r["id"] for r in store.list().collect()]
    assert every == sorted(every)
    assert [[r["id"] for r in store.list(limit=2, offset=k).collect()] for k in (0, 2, 6, 8, 20)] == [every[k : k + 2] for k in (0, 2, 6, 8, 20)]
    assert [r["id"] for r in store.list(offset=4).collect()] == every[4:]


def test_order_and_options(spark):
    rows = make(spark, [("https://h/1", "b", {"score": 0}), ("https://h/2", "B", {}), ("https://h/3", "a", {"score": 90}), ("https://h/4", "A", {"score": 0})])
    assert [r["title"] for r in rows.orderBy(*order("score")).collect()] == ["a", "A", "b", "B"]
    assert resolve_languages([], ["en"]) == ("en",)
    assert resolve_languages(["ALL"], ["en"]) == ()
    now, old = F.lit(NOW), dt.datetime(2020, 1, 1)
    at = lambda status, have, **k: spark.createDataFrame([(have,)], "applied_at timestamp").select(applied_at(status, now, **k)).first()[0]
    assert (at("applied", None), at("applied", old), at("closed", old), at("closed", old, clear=True)) == (NOW, old, old, None)
