"""Sources, whole runs, exports, remote services and the command line."""

import csv
import hashlib
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_store import make

from millrace.operators.filters import Scope
from millrace.operators.scoring import Profile
from millrace.plans.cli import main
from millrace.plans.config import EXAMPLE, ConfigError, load_config, parse_config
from millrace.plans.export import ExportError, Exporter, ExportResult, export, export_formats, register_exporter
from millrace.plans.remote import REMOTE_TYPES, BudgetExhausted, MeteredScorer, RemoteError, RemoteTable, ScoringError, classify, export_remote, python_verdict, schema_problems, verdict
from millrace.plans.run import Run, RunError
from millrace.plans.store import open_store
from millrace.sources.base import Fetcher, HttpPolicy, SourceConfigError, SourceUnavailableError, register_source, source_class, source_names
from millrace.sources.http import fetch_pages, http_get
from millrace.sources.json_board import JsonBoard
from millrace.sources.rss_feed import RssFeed
from millrace.streaming.closing import Closing
from millrace.streaming.ingest import ingest, stored

BOARD = {
    "jobs": [
        {"absolute_url": "https://boards.example/1", "title": "Dev", "updated_at": "2026-07-15T10:00:00-04:00", "location": {"name": "Remote - US"}, "content": "&lt;p&gt;R&amp;amp;D. Only candidates in United States&lt;/p&gt;"},
        {"id": 2},
        {"absolute_url": "https://boards.example/3", "title": "Ops", "location": {"name": "Berlin, Germany"}, "content": "&lt;p&gt;hybrid. Must be based in Germany.&lt;/p&gt;"},
    ]
}
FEED = """<?xml version="1.0"?><rss><channel>
<item><title>Acme: Dev</title><link>https://feed.example/1</link><pubDate>Wed, 15 Jul 2026 10:00:00 +0000</pubDate><description><![CDATA[<p>Hello</p>]]></description><region>Anywhere in the World</region></item>
<item><title>no company</title><link>https://feed.example/2</link></item>
<item><title>Acme: x</title></item>
<item><title>Beta: Ops</title><title>other</title><link>https://feed.example/4</link><region>Europe Only</region></item></channel></rss>"""


def test_json_board(spark, tmp_path):
    (tmp_path / "some-company.json").write_text(json.dumps(BOARD))
    (tmp_path / "broken.json").write_text("[1]")
    source = JsonBoard({"path": str(tmp_path)})
    rows = {r["sequence"]: r for r in source.fetch(spark).collect()}
    assert rows[1]["error_kind"] == "KeyError"
    one, three = rows[0], rows[2]
    assert (one["work_mode"], one["company"], one["eligible_locations"], one["description_clean"]) == ("remote", "Some Company", ["US", "United States"], "R&D. Only candidates in United States")
    assert (three["work_mode"], three["eligible_locations"], three["published_at"]) == ("hybrid", ["Germany"], None)
    assert [e.split(":")[0] for e in source.errors] == ["broken"]
    capped = JsonBoard({"path": str(tmp_path), "max_postings_per_company": 1})
    assert capped.fetch(spark).count() == 1
    for bad in ({}, {"companies": []}, {"companies": ["a"], "max_postings_per_company": 0}, {"companies": ["a"], "typo": 1}):
        with pytest.raises(SourceConfigError):
            JsonBoard(bad)


def test_rss_feed(spark, tmp_path):
    (tmp_path / "main.xml").write_text(FEED)
    rows = {r["sequence"]: r for r in RssFeed({"path": str(tmp_path)}).fetch(spark).collect()}
    assert [rows[k]["error_kind"] for k in range(4)] == [None, "ValueError", "KeyError", None]
    assert (rows[0]["company"], rows[0]["title"], rows[0]["description_clean"], rows[0]["eligible_locations"], rows[0]["location"]) == ("Acme", "Dev", "Hello", [], "Anywhere in the World")
    assert (rows[3]["title"], rows[3]["eligible_locations"], rows[3]["work_mode"]) == ("Ops", ["Europe Only"], "remote")
    details = spark.createDataFrame([("https://feed.example/1", '<div class="listing-container"><p>Whole</p></div>'), ("https://feed.example/4", "<p>other layout</p>")], "link string, html string")
    rows = {r["sequence"]: r for r in RssFeed({"path": str(tmp_path), "details": details}).fetch(spark).collect()}
    assert (rows[0]["description_clean"], rows[3]["description_clean"]) == ("Whole", "")


def test_http_policy():
    waits, answers = [], iter([(503, ""), OSError("reset"), (200, "ok")])

    def transport(url, timeout):
        a = next(answers)
        if isinstance(a, OSError):
            raise a
        return a

    assert Fetcher(transport, HttpPolicy(), waits.append, lambda: 0.0).get("u") == "ok"
    assert waits == [1.0, 2.0]
    with pytest.raises(SourceConfigError):
        Fetcher(lambda u, t: (404, "")).get("u")
    with pytest.raises(SourceUnavailableError):
        Fetcher(lambda u, t: (500, ""), HttpPolicy(max_retries=1), waits.append).get("u")
    paced = []
    slow = Fetcher(lambda u, t: (200, ""), HttpPolicy(min_request_interval=2.0), paced.append, iter([0.0, 0.5, 2.0]).__next__)
    slow.get("u")
    slow.get("u")
    assert paced == [1.5]
    with pytest.raises(SourceConfigError):
        HttpPolicy.of("x", {"timeout": 0})


def test_requested_board(spark):
    def transport(url, timeout):
        return (404, "") if "bad" in url else (200, json.dumps(BOARD))

    source = JsonBoard({"companies": ["good", "bad"], "url": "https://boards.example/{company}"}, Fetcher(transport))
    assert source.fetch(spark).filter("error_kind IS NULL").count() == 2
    assert len(source.errors) == 1


@pytest.fixture
def site():
    """A server on this machine; its answers by path, and when which path was asked on which host."""
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    asked, answers = [], {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.headers["Host"].split(":")[0], self.path, time.monotonic()))
            found = answers.get(self.path, (404, ""))
            status, body = found.pop(0) if isinstance(found, list) else found
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_port, answers, asked
    server.shutdown()


def test_tasks_fetch_by_host(spark, site):
    port, answers, asked = site
    board = '{"jobs": [{"absolute_url": "https://h/%s", "title": "Tester", "content": "&lt;p&gt;caf\u00e9&lt;/p&gt;"}]}'
    names = [f"c{k}" for k in range(6)]
    answers.update({f"/{c}": (200, board % c) for c in names})
    answers["/c1"], answers["/c3"] = [(503, ""), (200, board % "c1")], (404, "")
    block = {"companies": names, "url": f"http://127.0.0.1:{port}/{{company}}", "min_request_interval": 0.1, "backoff_base": 0.01, "max_retries": 2}
    source = JsonBoard(block)
    rows = source.fetch(spark).collect()
    assert sorted(r["unit"] for r in rows) == ["c0", "c1", "c2", "c4", "c5"] and {r["description_clean"] for r in rows} == {"café"}
    assert len(source.errors) == 1 and source.errors[0].startswith("c3: ") and "404" in source.errors[0]
    # Each once, but for the retry; in its pace.
    assert sorted(p for _, p, _ in asked) == ["/c0", "/c1", "/c1", "/c2", "/c3", "/c4", "/c5"]
    times = [t for _, _, t in asked]
    assert max(times) - min(times) > 0.4  # six in steps of 0.1, less what the first connection takes


def test_hosts_have_a_pace_each(spark, site):
    port, answers, asked = site
    answers.update({f"/{k}": (200, str(k)) for k in range(4)})
    urls = [(str(k), f"http://{host}:{port}/{k}") for host in ("127.0.0.1", "localhost") for k in range(4)] + [("none", None), ("odd", "ftp://h/1"), ("gone", f"http://127.0.0.1:{port}/9")]
    policy = HttpPolicy(min_request_interval=0.2, max_retries=0)
    got = fetch_pages(spark.createDataFrame(urls, "unit string, url string"), lambda: Fetcher(http_get, policy)).collect()
    assert len(got) == 11 and sorted(r["unit"] for r in got if r["error"]) == ["gone", "none", "odd"]
    assert all(r["body"] == r["unit"] for r in got if not r["error"])
    for host in ("127.0.0.1", "localhost"):
        times = [t for h, _, t in asked if h == host]
        assert max(times) - min(times) > 0.5


def test_detail_pages_are_fetched(spark, site):
    port, answers, _ = site
    item = "<item><title>A: {0}</title><link>http://127.0.0.1:%d/{0}</link><description>summary</description></item>" % port
    answers["/feed"] = (200, f"<rss><channel>{item.format('one')}{item.format('two')}</channel></rss>")
    answers["/one"] = (200, "<div>x</div><div class='a listing-container'><p title='1>0'>whole</p><div>text</div></div>")
    rows = RssFeed({"url": f"http://127.0.0.1:{port}/feed", "fetch_full_description": True, "max_retries": 0}).fetch(spark).collect()
    assert {r["title"]: r["description_clean"] for r in rows} == {"one": "whole\ntext", "two": "summary"}


def test_registry():
    assert source_class("replay") and source_class("none") is None
    assert source_names() == sorted(source_names())
    with pytest.raises(ValueError):
        register_source("replay")(type("Again", (), {}))


def config(tmp_path, **more):
    rows = [{"url": f"https://h/{k}", "title": f"Python {k}", "description": "python and the rest"} for k in range(3)]
    base = {"profile": {"role": "r", "skills": ["python", "spark"]}, "search": {"languages": []}, "sources": {"replay": {"postings": rows}, "gone": {}},
            "storage": {"path": str(tmp_path / "store")}, "exporters": {"csv": {"output_path": str(tmp_path / "out/a.csv")}}}
    return parse_config(base | more)


def phase(report, name):
    return {k: (n, said) for k, n, said in report.of(name)}


def test_run(spark, tmp_path):
    run = Run(spark, config(tmp_path))
    dry = Run(spark, config(tmp_path), run.store, dry_run=True).run()
    assert phase(dry, "fetch")["replay"][0] == {"yielded": 3, "skipped": 0, "kept": 3, "filtered_out": 0, "stored": 0, "duplicates": 0}
    assert (run.store.count(), phase(dry, "export")["csv"][0]["would_export"]) == (0, 0)
    report = run.run()
    assert phase(report, "fetch")["replay"][0]["stored"] == 3 and report.failed() == [("fetch", "gone")] and not report.ok
    assert phase(report, "score")["keyword"][0] == {"total": 3, "scored": 3, "failed": 0, "stopped_early": 0, "unreadable": 0}
    assert phase(report, "export")["csv"] == ({"unreadable": 0, "exported": 3}, [])
    assert report.table(spark).filter("counter = 'yielded'").first()["value"] == 3
    again = run.run(skip=["export"])
    assert (phase(again, "fetch")["replay"][0]["duplicates"], phase(again, "score")["keyword"][0]["scored"], phase(again, "export")) == (3, 0, {})
    assert phase(run.score(limit=2, rescore=True), "score")["keyword"][0]["total"] == 2
    with open(tmp_path / "out/a.csv") as f:
        assert [r["score"] for r in csv.DictReader(f)] == ["50"] * 3
    assert [phase(run.export([f]), "export")[f][1] != [] for f in ("json", "pdf", "csv")] == [True, True, False]
    assert phase(run.export(["csv"], output=str(tmp_path / "other.csv")), "export")["csv"][0]["exported"] == 3 and (tmp_path / "other.csv").exists()
    with pytest.raises(RunError):
        run.sources(["nope"])
    with pytest.raises(RunError):
        Run(spark, config(tmp_path, scoring={"backend": "guess"}), run.store).score()
    assert phase(run.fetch(["replay"], limit=2), "fetch")["replay"][0]["yielded"] == 2


def test_title_filter_in_run(spark, tmp_path):
    own = config(tmp_path, search={"title_keywords_include": ["PYTHON"], "title_keywords_exclude": ["1"], "languages": []})
    out = phase(Run(spark, own).fetch(["replay"]), "fetch")["replay"][0]
    assert (out["yielded"], out["kept"], out["filtered_out"], out["stored"]) == (3, 2, 1, 2)


def test_failing_source(spark, tmp_path):
    report = Run(spark, config(tmp_path, sources={"replay": {"postings": [{"url": "https://h/1", "title": "t"}], "fail": True}})).fetch()
    n, said = phase(report, "fetch")["replay"]
    assert (n["yielded"], len(said), report.ok) == (1, 1, True)


def test_metered_run(spark, tmp_path):
    replies = iter([(200, REPLY), (401, ""), (200, REPLY)])
    own = config(tmp_path, scoring={"backend": "metered", "max_requests_per_run": 2}, sources={"replay": config(tmp_path).sources["replay"]})
    run = Run(spark, own, given={"scoring": {"ask": lambda p, t: next(replies)}})
    run.fetch()
    n, _ = phase(run.score(), "score")["metered"]
    assert (n["scored"], n["failed"], n["stopped_early"], run.store.count(Scope(scored=True))) == (1, 1, 1, 1)
    assert run.store.list(Scope(scored=True)).first()["matched_skills"] == ["a"]
    with pytest.raises(RunError):
        Run(spark, own, run.store).score()


@register_exporter("lines")
class Lines(Exporter):
    options, needed = ("output_path", "limit"), ("output_path",)

    def export(self, postings):
        return ExportResult(postings.count(), "counted")


def test_exporters_are_registered(spark):
    rows = make(spark, [("https://h/1", "t", {})])
    assert {"csv", "json", "lines", "markdown", "remote"} <= set(export_formats())
    assert export(rows, "lines", {"output_path": "x", "limit": 1, "enabled": True}) == ExportResult(1, "counted")
    for bad in ({"output_path": "x", "typo": 1}, {}):
        with pytest.raises(ExportError):
            export(rows, "lines", bad)
    with pytest.raises(ValueError):
        register_exporter("csv")(type("Again", (Lines,), {}))


def test_exports(spark, tmp_path):
    rows = make(spark, [
        ("https://h/low", "Low", {"score": 20}), ("https://h/part(2)", "High [Remote]\nx", {"score": 90, "work_mode": "remote", "location": "EU [x]", "eligible_locations": ["EU", "Germany"]}),
        ("https://h/none", "@cmd", {}), ("https://h/mid", "Mïd", {"score": 55, "matched_skills": ["a", "b"]}),
    ])
    paths = {f: tmp_path / "new" / f for f in ("csv", "json", "markdown")}
    for fmt, path in paths.items():
        assert export(rows, fmt, {"output_path": str(path)}).exported == 4
    cells = list(csv.DictReader(paths["csv"].open(newline="")))
    assert [c["title"] for c in cells] == ["High [Remote]\nx", "Mïd", "Low", "'@cmd"]
    assert (cells[0]["eligible_locations"], cells[3]["score"], cells[1]["matched_skills"]) == ("EU; Germany", "", "a; b")
    found = json.loads(paths["json"].read_text())
    assert (found["count"], found["postings"][3]["title"], found["postings"][3]["score"], list(found["postings"][0])[0]) == (4, "@cmd", None, "score")
    assert "Mïd" in paths["json"].read_text()
    lines = paths["markdown"].read_text().splitlines()
    assert lines[4] == r"- **90** — [High \[Remote\] x — C](<https://h/part(2)>) · remote · EU \[x\] · eligible: EU, Germany"
    assert lines[-1].startswith("- **n/a** — ")
    empty = rows.limit(0)
    for fmt in paths:
        export(empty, fmt, {"output_path": str(tmp_path / fmt)})
    assert json.loads((tmp_path / "json").read_text()) == {"count": 0, "postings": []}
    assert "_No postings to export._" in (tmp_path / "markdown").read_text()
    assert len((tmp_path / "csv").read_text().splitlines()) == 1
    export(rows, "csv", {"output_path": str(tmp_path / "folder"), "parts": True})
    folder = "".join(p.read_text() for p in sorted((tmp_path / "folder").glob("part-*")))
    assert "\n".join([",".join(cells[0]), folder]) == paths["csv"].read_text()
    for bad in ({}, {"output_path": "x", "typo": 1}, {"output_path": str(tmp_path)}):
        with pytest.raises(ExportError):
            export(empty, "csv", bad)


REPLY = '```json\n{"score": 7, "summary": "s", "matched_skills": ["a"], "extra": 1}\n```'


def test_verdicts(spark):
    replies = [REPLY, '{"score": 101, "summary": "s"}', "no", '{"score": 1}', '{"score": 0, "summary": ""}']
    df = spark.createDataFrame([(r,) for r in replies], "r string").select(verdict(F.col("r")).alias("v"))
    assert [r["v"] and r["v"]["score"] for r in df.collect()] == [7, None, None, None, 0]
    assert [v and v["score"] for v in map(python_verdict, replies)] == [7, None, None, None, 0]


def test_metered_scorer(spark):
    answers = iter([(500, ""), (200, REPLY), (200, "bad"), (200, "bad"), (401, ""), (200, REPLY)])
    asked = []
    scorer = MeteredScorer(lambda p, t: (asked.append(p), next(answers))[1], max_requests_per_run=6, max_description_chars=10)
    got = scorer.score("p", Profile(skills=("a", "b", "b")))
    assert (got["score"], got["unmatched_profile_skills"]) == (7, ["b", "b"])
    for _ in range(2):
        with pytest.raises(ScoringError):
            scorer.score("p", Profile())
    scorer.score("p", Profile())
    with pytest.raises(BudgetExhausted):
        scorer.score("p", Profile())
    assert len(asked) == 6
    rows = make(spark, [("https://h/1", "t", {"description_clean": "0123456789abc"})])
    assert scorer.prompts(rows).first()["prompt"].endswith("012345678…")


class FakeTable:
    """A remote table in a folder, as tasks have no memory in common."""

    def __init__(self, folder, properties=None, fail_after=None):
        self.folder, self.fail_after = folder, fail_after
        folder.mkdir(parents=True, exist_ok=True)
        self.properties = properties if properties is not None else dict(REMOTE_TYPES)

    def rows(self):
        return {r["URL"]["url"]: r for r in (json.loads(p.read_text()) for p in self.folder.glob("*.json"))}

    def __call__(self, method, path, body):
        if method == "GET":
            return 200, {"properties": self.properties}
        if path.endswith("/query"):
            return 200, {"results": [{"id": body["url"]}] if body["url"] in self.rows() else []}
        if self.fail_after is not None and len(self.rows()) >= self.fail_after:
            return 429, {}
        url = body["properties"]["URL"]["url"]
        (self.folder / f"{hashlib.sha1(url.encode()).hexdigest()}.json").write_text(json.dumps(body["properties"]))
        return 200, {}


def test_remote_table(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import a test
    rows = make(spark, [("https://h/1", "t", {"score": 5}), ("https://h/2", "u", {})])
    fake = FakeTable(tmp_path / "a")
    table = RemoteTable(fake, "t", requests_per_second=0)
    assert export_remote(rows, table, tasks=2) == (2, 0)
    assert export_remote(rows, table) == (0, 2)
    assert fake.rows()["https://h/1"] == {
        "Name": {"title": [{"text": {"content": "t"}}]}, "URL": {"url": "https://h/1"}, "Status": {"select": {"name": "new"}}, "Company": {"rich_text": [{"text": {"content": "C"}}]},
        "Score": {"number": 5}, "Source": {"select": {"name": "s"}},
    }
    assert fake.rows()["https://h/2"]["Score"] == {"number": None}
    with pytest.raises(RemoteError, match="Score"):
        RemoteTable(FakeTable(tmp_path / "b", {"Name": "title"}), "t", 0).upsert([])
    with pytest.raises(RemoteError, match="1 created"):
        export_remote(rows, RemoteTable(FakeTable(tmp_path / "c", fail_after=1), "t", 0))
    waits = []
    RemoteTable(FakeTable(tmp_path / "d"), "t", 2.5, sleep=waits.append, clock=lambda: 0.0).upsert([("u", '{"URL": {"url": "u"}}')])
    assert waits == [0.4, 0.4]
    assert export(rows, "remote", {"table": "t", "transport": FakeTable(tmp_path / "e"), "requests_per_second": 0}).detail == "2 created, 0 updated"
    with pytest.raises(ExportError):
        export(rows, "remote", {"table": "t"})
    actual = spark.createDataFrame([("Name", "title"), ("URL", "text")], "property string, type string")
    assert {r["property"] for r in schema_problems(actual).collect()} == {"URL", "Status", "Company", "Score", "Source"}
    snapshot = spark.createDataFrame([("https://h/1", "p1")], "url string, page_id string")
    assert {r["title"]: r["action"] for r in classify(rows, snapshot).collect()} == {"t": "updated", "u": "created"}


def test_a_batch_that_is_run_again_inserts_nothing_twice(spark, tmp_path):
    kind = "url string, id string, sequence int"
    top = {k: str(tmp_path / k) for k in ("in", "out", "checkpoint")}

    def feed(*rows):
        spark.createDataFrame([(f"u{a}", f"i{b}", n) for n, (a, b) in enumerate(rows)], kind).coalesce(1).write.mode("append").parquet(top["in"])
        ingest(spark.readStream.schema(kind).parquet(top["in"]), top["out"], top["checkpoint"]).awaitTermination()

    held = lambda: sorted((r["url"], r["id"]) for r in stored(spark, top["out"], spark.read.schema(kind).parquet(top["in"]).schema).collect())
    feed((1, 1), (2, 2), (1, 3))
    feed((2, 9), (3, 3), (4, 1))
    assert held() == [("u1", "i1"), ("u2", "i2"), ("u3", "i3")]
    # As if the driver had died after the second batch was written and before its end was noted.
    (tmp_path / "checkpoint" / "commits" / "1").unlink()
    (tmp_path / "checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
    feed((5, 5))
    assert held() == [("u1", "i1"), ("u2", "i2"), ("u3", "i3"), ("u5", "i5")]


def test_a_stream_is_closed_between_batches(spark, tmp_path):
    kind = "url string, id string, sequence int"
    for k in range(5):
        spark.createDataFrame([(f"u{k}{n}", f"i{k}{n}", n) for n in range(3)] + [("u00", "i00", 9)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    first = Closing(lambda counters: counters["inserted"] >= 4)
    ingest(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint"), closing=first)
    counters = first.wait()
    # Two batches are done, whole; the third has not begun.
    assert first.batches == [0, 1] and counters == {"read": 8, "inserted": stored(spark, str(tmp_path / "out"), spark.read.parquet(str(tmp_path / "out")).schema).count()}
    assert not (tmp_path / "out" / "batch=2").exists()
    second = Closing()
    ingest(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint"), closing=second)
    assert second.wait()["read"] == 12 and second.batches == [2, 3, 4]
    assert spark.read.parquet(str(tmp_path / "out")).select("url").distinct().count() == spark.read.parquet(str(tmp_path / "out")).count() == 15


def test_config(tmp_path):
    at = tmp_path / "c.yaml"
    at.write_text(EXAMPLE)
    assert load_config(at).profile.skills == ("Python", "Spark", "SQL")
    for raw, said in (({"profil": {}}, "did you mean 'profile'"), ({"profile": {"role": "r", "skill": []}}, "did you mean 'skills'"), ([], "mapping"), ({"profile": {}}, "role"), ({"profile": {"role": "r", "work_mode": "x"}}, "work_mode")):
        with pytest.raises(ConfigError, match=said):
            parse_config(raw)
    with pytest.raises(ConfigError):
        load_config(tmp_path / "none.yaml")


def test_cli(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert main(["init"]) == 0 and main(["init"]) == 1 and main(["init", "--force"]) == 0
    postings = [{"url": f"https://h/{k}", "title": f"[Python] {k}", "description": "python"} for k in range(2)]
    (tmp_path / "config.yaml").write_text(json.dumps({"profile": {"role": "r", "skills": ["python"]}, "search": {"languages": ["en"]}, "sources": {"replay": {"postings": postings}}, "storage": {"path": str(tmp_path / "s")}, "exporters": {"markdown": {"output_path": str(tmp_path / "o.md")}}}))
    call = lambda *a: (main(list(a), spark), capsys.readouterr())
    assert call("score")[1].out == "nothing to score\n"
    assert call("fetch")[0] == 0
    code, said = call("score", "--limit", "5")
    assert code == 0 and said.out.startswith("2 to score\n")
    code, said = call("list", "--json")
    rows = json.loads(said.out)
    assert (code, len(rows), rows[0]["score"], rows[0]["title"]) == (0, 2, 100, "[Python] 0")
    assert call("status", rows[0]["id"][:8], "applied")[0] == 0
    assert "applied" in call("show", "https://h/0")[1].out
    assert call("show", "ffffffffffff")[0] == 1
    assert call("show", "ab")[0] == 1
    assert call("list", "--unscored", "--min-score", "1")[0] == 2
    assert call("status", rows[0]["id"], "on the moon")[0] == 2
    assert call("export", "markdown")[0] == 0 and (tmp_path / "o.md").read_text().count("\n- ") == 2
    assert call("run")[0] == 0
    assert "[Python] 0" in call("list")[1].out


def test_store_is_reused(spark, tmp_path):
    own = config(tmp_path)
    assert Run(spark, own).store.path == open_store(spark, own.storage).path
