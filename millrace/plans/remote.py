"""What talks to paid or foreign services: a metered scorer and an upsert of rows into a remote table.

Both take their transport as an argument, so they are tested with fakes. The metered scorer takes no more rows than its
budget has requests, on the driver one by one. The upsert is done by tasks, each with its share of the rate, and what they
did is a written table.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, fields, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import truncate
from millrace.operators.filters import page
from millrace.functions.places import location_match, work_mode_match
from millrace.operators.scoring import Profile, Scorer, ScorerConfigError, content, register_scorer
from millrace.plans.export import Exporter, ExportError, ExportResult, register_exporter
from millrace.schema import POSTING_SCHEMA, SCORE_COLUMNS
from millrace.scratch import stage
from millrace.sources.base import RETRYABLE


class ScoringError(RuntimeError):
    """One posting could not be scored."""


class BudgetExhausted(RuntimeError):
    """No request is left in this run."""


VERDICT = "score int, summary string, matched_skills array<string>, missing_requirements array<string>, penalized_skills array<string>"


def json_of_reply(reply: Column) -> Column:
    """The JSON of a reply that may be within a code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"(?is)^```\s*(json)?", ""), r"(?s)```.*$", ""))


def verdict(reply: Column) -> Column:
    """The checked verdict of a reply; null where it isn't one."""
    parsed = F.from_json(json_of_reply(reply), VERDICT)
    return F.when(parsed["score"].between(0, 100) & parsed["summary"].isNotNull(), parsed)


def python_verdict(reply: str) -> dict[str, Any] | None:
    body = re.sub(r"(?s)```.*$", "", re.sub(r"(?is)^```\s*(json)?", "", reply.strip())).strip()
    try:
        found = json.loads(body)
        score = found["score"]
        lists = {k: [str(x) for x in found.get(k) or []] for k in ("matched_skills", "missing_requirements", "penalized_skills")}
        good = isinstance(score, int) and not isinstance(score, bool) and 0 <= score <= 100 and isinstance(found["summary"], str)
        return {"score": score, "summary": found["summary"], **lists} if good else None
    except (ValueError, KeyError, TypeError):
        return None


#: (payload, timeout) -> (status, text of the reply); raises OSError where there is no answer.
Ask = Callable[[dict[str, Any], float], tuple[int, str]]


@dataclass
class MeteredScorer:
    """At most ``max_requests_per_run`` requests, failed ones and second attempts counted."""

    ask: Ask
    model: str = ""
    max_requests_per_run: int = 25
    max_description_chars: int = 4000
    timeout: float = 30.0
    used: int = 0

    def prompts(self, postings: DataFrame) -> DataFrame:
        """(url, prompt) of postings, as columns."""
        text = truncate(F.coalesce(content(), F.lit("")), self.max_description_chars)
        return postings.select("url", F.concat_ws("\n\n", "title", "company", text).alias("prompt"))

    def payload(self, prompt: str, profile: Profile) -> dict[str, Any]:
        system = "Score how well the posting fits the profile, 0 to 100. Answer with a JSON object: score, summary, matched_skills, missing_requirements, penalized_skills."
        own = json.dumps({"role": profile.role, "skills": list(profile.skills), "absent_skills": list(profile.absent_skills)}, ensure_ascii=False)
        return {"model": self.model, "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": f"{own}\n\n{prompt}"}]}

    def score(self, prompt: str, profile: Profile) -> dict[str, Any]:
        said = ""
        for _ in range(2):
            if self.used >= self.max_requests_per_run:
                raise BudgetExhausted(f"the budget of {self.max_requests_per_run} requests is used up")
            self.used += 1
            try:
                status, text = self.ask(self.payload(prompt, profile), self.timeout)
            except OSError as e:
                said = str(e)
                continue
            if not 200 <= status < 300:
                if status not in RETRYABLE:
                    raise ScoringError(f"the service answered {status}")
                said = f"status {status}"
            elif (found := python_verdict(text)) is not None:
                # Duplicates of the profile stay, so this is no set difference.
                return found | {"unmatched_profile_skills": [s for s in profile.skills if s not in set(found["matched_skills"])]}
            else:
                said = "a reply that is no verdict"
        raise ScoringError(f"not scored after two attempts: {said}")

    def run(self, postings: DataFrame, profile: Profile) -> tuple[list[dict[str, Any]], list[tuple[str, str]], str | None]:
        """(scores by url, failures, url at which the budget ended). No more rows are taken than the budget has requests."""
        scores, failures = [], []
        for row in self.prompts(postings).limit(self.max_requests_per_run + 1).collect():
            try:
                scores.append({"url": row["url"], **self.score(row["prompt"], profile)})
            except ScoringError as e:
                failures.append((row["url"], str(e)))
            except BudgetExhausted:
                return scores, failures, row["url"]
        return scores, failures, None


@register_scorer("metered")
class MeteredBackend(Scorer):
    """The metered scorer as a backend; ``ask`` is the transport, and of the postings the first in stored order are asked
    about. The two fits are never the service's."""

    def __init__(self, options: dict[str, Any]):
        options = dict(options)
        if (ask := options.pop("ask", None)) is None:
            raise ScorerConfigError("the metered scorer has no transport or key")
        if unknown := sorted(set(options) - {f.name for f in fields(MeteredScorer)} | set(options) & {"used"}):
            raise ScorerConfigError(f"scoring: unknown key {', '.join(unknown)}")
        self.scorer, self.stopped_early = MeteredScorer(ask, **options), False

    def score(self, postings: DataFrame, profile: Profile) -> DataFrame:
        found, failures, stopped = self.scorer.run(page(postings, self.scorer.max_requests_per_run + 1), profile)
        self.stopped_early = stopped is not None
        names = [c for c in SCORE_COLUMNS if not c.endswith("_match")]
        kinds = ", ".join(f"{c} {POSTING_SCHEMA[c].dataType.simpleString()}" for c in names)
        rows = [(f["url"], *[f[c] for c in names], None) for f in found] + [(url, *[None] * len(names), why) for url, why in failures]
        # At most as many rows as there are requests.
        answers = postings.sparkSession.createDataFrame(rows, f"url string, {kinds}, failure string")
        rest = [c for c in postings.columns if c not in (*SCORE_COLUMNS, "failure")]
        fits = {"location_match": location_match(F.col("location"), F.col("eligible_locations"), profile.locations), "work_mode_match": work_mode_match(F.col("work_mode"), profile.work_mode)}
        return postings.select(*rest).join(F.broadcast(answers), "url").withColumns(fits)


# -- remote table ------------------------------------------------------------------------------------------------------

# The properties that a remote table must have, and their types.
REMOTE_TYPES = {"Name": "title", "URL": "url", "Status": "select", "Company": "rich_text", "Score": "number", "Source": "select"}
_OWN = {"Name": "title", "URL": "url", "Status": "status", "Company": "company", "Score": "score", "Source": "source"}


class RemoteError(RuntimeError):
    """What a remote table did not do, with what to do about it."""


#: (method, path, body) -> (status, body); raises OSError where there is no answer.
Call = Callable[[str, str, dict[str, Any] | None], tuple[int, dict[str, Any]]]


def schema_problems(actual: DataFrame, table: str | None = None) -> DataFrame:
    """(property, expected, found) of what a remote table (property, type) lacks or has of another type; with ``table``, a
    column of ``actual``, of each of its tables."""
    by, wanted = [table] if table else [], list(REMOTE_TYPES)
    kinds = F.create_map(*[F.lit(x) for pt in REMOTE_TYPES.items() for x in pt])
    expected = F.when(F.col("property").isin(wanted), F.element_at(kinds, F.col("property")))
    # A row whose table is null is of no table, and a null table has nothing.
    known = F.col(table).isNotNull() if table else F.lit(True)
    differs = actual.filter(known & expected.isNotNull() & ~F.col("type").eqNullSafe(expected)).select(*by, "property", expected.alias("expected"), F.col("type").alias("found"))
    # A bit for each property that is there: one number a table is all that is shuffled.
    bit = F.lit(None).cast("int")
    for k, p in enumerate(wanted):
        bit = F.when(known & (F.col("property") == p), 1 << k).otherwise(bit)
    held = actual.groupBy(*by).agg(F.coalesce(F.bit_or(bit), F.lit(0)).alias("held"))
    lacks = F.explode(F.array(*[F.when(F.col("held").bitwiseAND(1 << k) == 0, F.struct(F.lit(p).alias("property"), F.lit(t).alias("expected"))) for k, (p, t) in enumerate(REMOTE_TYPES.items())]))
    missing = held.select(*by, lacks.alias("x")).filter("x IS NOT NULL").select(*by, "x.*", F.lit(None).cast("string").alias("found"))
    return differs.unionByName(missing)


def classify(postings: DataFrame, remote: DataFrame) -> DataFrame:
    """``postings`` with the page that a remote snapshot (url, page_id) has of them, and created or updated."""
    return postings.join(remote.select("url", "page_id"), "url", "left").withColumn("action", F.when(F.col("page_id").isNull(), "created").otherwise("updated"))


def properties(names: dict[str, str] | None = None) -> Column:
    """The payload of a posting, as JSON, each property in the form of its type; ``names`` renames properties."""
    text = lambda c: F.array(F.struct(F.struct(c.alias("content")).alias("text")))
    form = {"title": text, "rich_text": text, "select": lambda c: F.struct(c.alias("name")), "url": lambda c: c, "number": lambda c: c}
    typed = [F.struct(form[REMOTE_TYPES[p]](F.col(c)).alias(REMOTE_TYPES[p])).alias((names or {}).get(p, p)) for p, c in _OWN.items()]
    return F.to_json(F.struct(*typed), {"ignoreNullFields": "false"})


@dataclass
class RemoteTable:
    call: Call
    table: str
    requests_per_second: float = 2.5
    names: dict[str, str] = field(default_factory=dict)
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    last: float | None = None

    def _request(self, method: str, path: str, body: dict[str, Any] | None = None) -> dict[str, Any]:
        if self.requests_per_second and self.last is not None and (wait := self.last + 1 / self.requests_per_second - self.clock()) > 0:
            self.sleep(wait)
        self.last = self.clock()
        try:
            status, answer = self.call(method, path, body)
        except OSError as e:
            raise RemoteError(f"the remote table can't be reached: {e}") from e
        if 200 <= status < 300:
            return answer
        said = {401: "the token is not accepted", 404: "there is no such table, or it is not shared with this token", 429: "too many requests; lower requests_per_second"}
        raise RemoteError(said.get(status) or f"status {status}: {answer.get('message', 'the properties may not match')}")

    def check(self) -> None:
        """All problems at once, before anything is written."""
        actual = self._request("GET", f"tables/{self.table}").get("properties", {})
        wanted = {self.names.get(p, p): t for p, t in REMOTE_TYPES.items()}
        bad = [f"{p}: is missing, create it as {t}" if p not in actual else f"{p}: is {actual[p]}, must be {t}" for p, t in wanted.items() if actual.get(p) != t]
        if bad:
            raise RemoteError("the remote table does not fit: " + "; ".join(bad))

    def upsert(self, rows: Iterable[tuple[str, str]], checked: bool = False) -> tuple[int, int, str | None]:
        """(url, properties) rows in their order; how many were created and updated, and what stopped it."""
        if not checked:
            self.check()
        created = updated = 0
        for url, own in rows:
            try:
                found = self._request("POST", f"tables/{self.table}/query", {"url": url}).get("results", [])
                if found:
                    self._request("PATCH", f"pages/{found[0]['id']}", {"properties": json.loads(own)})
                    updated += 1
                else:
                    self._request("POST", "pages", {"table": self.table, "properties": json.loads(own)})
                    created += 1
            except RemoteError as e:
                return created, updated, f"at {url}: {e}"
        return created, updated, None


def export_remote(postings: DataFrame, table: RemoteTable, tasks: int = 1) -> tuple[int, int]:
    """Upsert by ``tasks`` tasks, dealt by url, each at its share of the pace; (created, updated) of all. A task stops at its
    first failure, and all failures are told together. A task that is run again updates what it had created."""
    table.check()
    share = replace(table, requests_per_second=table.requests_per_second / tasks)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        created, updated, said = share.upsert((r for b in batches for r in zip(b["url"], b["own"], strict=True)), checked=True)
        yield pd.DataFrame({"created": [created], "updated": [updated], "error": [said]})

    rows = postings.select("url", properties(table.names).alias("own")).repartition(tasks, "url")
    done = stage(rows.mapInPandas(send, "created long, updated long, error string"), "upserts")
    total = done.agg(F.sum("created"), F.sum("updated"), F.array_sort(F.collect_set("error"))).first()
    created, updated, errors = total[0] or 0, total[1] or 0, total[2]
    if errors:
        raise RemoteError(f"stopped after {created} created and {updated} updated: {'; '.join(errors)}")
    return created, updated


@register_exporter("remote")
class Remote(Exporter):
    """``transport`` is a Call that tasks can use; tokens are its own matter and no options."""

    options, needed = ("transport", "table", "requests_per_second", "names", "tasks"), ("table",)

    def export(self, postings: DataFrame) -> ExportResult:
        own = {k: v for k, v in self.block.items() if k in ("requests_per_second", "names")}
        if self.block.get("transport") is None:
            raise ExportError("the remote table has no transport or token")
        try:
            created, updated = export_remote(postings, RemoteTable(self.block["transport"], self.block["table"], **own), self.block.get("tasks", 1))
        except RemoteError as e:
            raise ExportError(str(e)) from e
        return ExportResult(created + updated, f"{created} created, {updated} updated")
