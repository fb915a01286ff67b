"""Canonical addresses and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters, beside those that begin with ``utm_``, that never identify content.
TRACKING = "fbclid gclid dclid msclkid mc_cid mc_eid igshid ref ref_src cmpid at_medium at_campaign ocid smid smtyp partner rss cid".split()

_PARTS = r"(?i)^https?://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def host(url: Column) -> Column:
    """Lower case, without user, port and ``www.``; empty where there is none."""
    h = F.lower(F.regexp_extract(F.trim(url), _PARTS, 1))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(h, r"^.*@", ""), r":\d*$", ""), r"^www\.", "")


def canonical(url: Column) -> Column:
    """https, bare host, no fragment, no tracking parameters, the others sorted, no slash behind; null unless http or https."""
    u = F.trim(url)
    path = F.regexp_extract(u, _PARTS, 2)
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(F.lit("/"))
    key = lambda p: F.lower(F.element_at(F.split(p, "="), 1))
    kept = F.filter(F.split(F.regexp_extract(u, _PARTS, 3), "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(*TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when(u.rlike(_PARTS), F.concat(F.lit("https://"), host(u), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def article_id(canonical_url: Column) -> Column:
    return F.substring(F.sha2(canonical_url, 256), 1, 32)


def publisher(kind: Column, source: Column, url: Column) -> Column:
    """Aggregated sources carry many publishers, told by their host."""
    return F.when(kind == "SOURCE_KIND_GDELT", F.concat(source, F.lit(":"), host(url))).otherwise(source)


def sampled(url: Column, share: float) -> Column:
    """The same URLs each time: the first eight bytes of the hash as a fraction, below ``share``."""
    return F.conv(F.substring(F.sha2(url, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / 18446744073709551615.0 < share


def allowed(url: Column, domains: list[str]) -> Column:
    h = host(url)
    return F.lit(not domains) if not domains else F.exists(F.array(*[F.lit(d.lower()) for d in domains]), lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d)))
