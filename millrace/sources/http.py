"""Pages by HTTP, fetched by tasks: urls are dealt by host, and each host has its own pace and retries.

No page and no unit passes through the driver, and a host is asked by one task only, so its pace holds on a cluster of any
size; hosts are asked beside each other. A host that has most of the urls takes as long as its pace says, wherever they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGENT = "millrace"


def http_get(url: str, timeout: float) -> tuple[int, str]:
    """(status, body) by the standard library's client, which follows redirects; OSError where there is no answer."""
    if urlsplit(url).scheme not in ("http", "https"):
        raise OSError(f"not a web address: {url}")
    try:
        with urlopen(Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as answer:  # noqa: S310
            return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except HTTPError as e:
        return e.code, ""
    except ValueError as e:
        raise OSError(str(e)) from e


def _asking(make: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``make``: a fetcher for a host, which keeps its pace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, object] = {}
        for b in batches:
            for unit, url, host in zip(*(b.column(c).to_pylist() for c in ("unit", "url", "host")), strict=True):
                body = error = None
                try:
                    body = (hosts.get(host) or hosts.setdefault(host, make())).get(url or "")
                except RuntimeError as e:  # what a fetcher says of one url
                    error = str(e)
                # One page at a time, as pages may be large.
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (unit, url, body, error)], ["unit", "url", "body", "error"])

    return run


def fetch_pages(urls: DataFrame, make: Callable) -> DataFrame:
    """(unit, url, body, error) of ``urls`` (unit, url), one of body and error null; to be written before it is used twice.

    Defined cases: a null or broken url is an error of its unit; units may repeat; a task that is run again asks again.
    """
    tasks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = urls.select("unit", "url", F.lower(F.coalesce(F.regexp_extract("url", r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit(""))).alias("host")).repartition(tasks, "host")
    return dealt.mapInArrow(_asking(make), "unit string, url string, body string, error string")
