"""URL keys: one normal form per posting, and a short id of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import strip

# Query parameters that only say where a visitor came from.
TRACKING_NAMES = ("fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "ref", "referrer", "source", "src")
TRACKING_PREFIX = "utm_"
ID_LENGTH = 12

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _decode(raw: Column) -> Column:
    plain = F.replace(raw, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(raw), plain)


def _encode(text: Column) -> Column:
    # The JVM's encoder leaves * and escapes ~; form encoding has it the other way round.
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_url(url: Column) -> Column:
    """https for http, lower-case scheme and host, no fragment, no trailing slash but the root's, and the query without
    tracking and empty parameters, sorted. Null where the URL is not absolute."""
    raw = F.regexp_replace(strip(url), r"[\t\r\n]", "")
    part = lambda k: F.regexp_extract(raw, _PARTS, k)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    path = F.regexp_replace(part(3), "/+$", "")
    pairs = F.transform(
        F.filter(F.split(part(4), "&"), lambda p: p != ""),
        lambda p: F.struct(_decode(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), _decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")),
    )
    wanted = F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(*TRACKING_NAMES) & ~F.startswith(F.lower(p["k"]), F.lit(TRACKING_PREFIX)))
    query = F.array_join(F.transform(F.array_sort(wanted), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    out = F.concat(
        F.when(scheme == "http", "https").otherwise(scheme), F.lit("://"), host,
        F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(raw.rlike(_PARTS) & (host != ""), out)


def posting_id(normal_url: Column) -> Column:
    return F.substring(F.sha2(normal_url, 256), 1, ID_LENGTH)
