"""URL functions. Where the URL has no query they are Catalyst expressions; only percent-encoding needs Python."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions._udf import vectorized

#: Query parameters that only track.
TRACKING_PREFIXES = ("utm_", "mc_", "_hs")
TRACKING_NAMES = ("gclid", "fbclid", "msclkid", "yclid", "wbraid", "gbraid")
MAX_URL, MAX_SEGMENT = 2048, 200


def host_of(url: Column) -> Column:
    """What stands between // and the next /, ? or #, in lower case; empty without one."""
    return F.lower(F.regexp_extract(url, r"^[^/?#]*//([^/?#]*)", 1))


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def connect_host(url: Column) -> Column:
    """The host that a client would connect to, without user and port; null for schemes other than http and https."""
    netloc = F.regexp_replace(host_of(url), r"^.*@", "")
    return F.when(scheme_of(url).isin("http", "https"), F.regexp_extract(netloc, r"^([^:]*)", 1))


def allowed(url: Column, hosts: list[str]) -> Column:
    return host_of(url).isin([h.lower() for h in hosts])


def malformed(url: Column) -> Column:
    """Too long, or several URLs glued together."""
    return (F.length(url) > MAX_URL) | url.contains("%20https:") | url.contains("%20http:")


def excluded(url: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern occurs in the path."""
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(p)
    return out


def segments(url: Column) -> Column:
    """The nonempty path segments."""
    return F.filter(F.split(path_of(url), "/"), lambda s: s != "")


def safe_segments(url: Column) -> Column:
    """Segments for file names: other characters become _, at most 200 characters each."""
    return F.transform(segments(url), lambda s: F.substring(F.regexp_replace(s, r"[^A-Za-z0-9._\-]", "_"), 1, MAX_SEGMENT))


def md_path(url: Column) -> Column:
    """The markdown path of a URL: the safe segments with the last suffix replaced; _root.md for the root."""
    joined = F.array_join(safe_segments(url), "/")
    stem = F.regexp_replace(joined, r"(?<=[^/.])\.[^./]+$", "")
    return F.when(joined == "", "_root.md").otherwise(F.concat(stem, F.lit(".md")))


def top_segment(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_element_at(segments(url), F.lit(1)), F.lit("")))


def _with_query(url: str) -> str:
    p = urlsplit(url.strip())
    path = p.path.split(";")[0] if ";" in p.path.rpartition("/")[2] else p.path
    path = (path.rstrip("/") if len(path) > 1 else path) or ("/" if not p.path else "")
    kept = sorted((k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not k.startswith(TRACKING_PREFIXES) and k not in TRACKING_NAMES)
    query = urlencode(kept)
    return f"{p.scheme.lower()}://{p.netloc.lower()}{path}" + (f"?{query}" if query else "") if p.netloc else url.strip()


@vectorized("string")
def _canonical_query(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: None if u is None else _with_query(u))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no trailing slash but the root's, sorted query without tracking.

    Only URLs whose query has parameters to re-encode, or whose path has parameters, go through Python.
    """
    clean = F.regexp_replace(F.trim(url), r"#.*$", "")
    path = path_of(clean)
    trimmed = F.when(F.length(path) > 1, F.regexp_replace(path, r"/+$", "")).when(path == "", "/").otherwise(path)
    names = F.regexp_extract(clean, r"\?(.*)$", 1)
    parts = F.filter(F.split(names, "&"), lambda p: p != "")
    kept = F.filter(parts, lambda p: ~_tracking(F.regexp_extract(p, r"^([^=]*)", 1)))
    pairs = F.transform(kept, lambda p: F.struct(F.regexp_extract(p, r"^([^=]*)", 1).alias("k"), F.regexp_extract(p, r"^[^=]*=?(.*)$", 1).alias("v")))
    query = F.array_join(F.transform(F.array_sort(pairs), lambda s: F.concat(s["k"], F.lit("="), s["v"])), "&")
    native = F.concat(scheme_of(clean), F.lit("://"), host_of(clean), trimmed, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    plain = names.rlike(r"^[A-Za-z0-9_.~=&-]*$") & ~path.contains(";") & host_of(clean).rlike(".")
    return F.when(url.isNull(), None).when(plain, native).otherwise(_canonical_query(url))


def _tracking(name: Column) -> Column:
    out = name.isin(*TRACKING_NAMES)
    for p in TRACKING_PREFIXES:
        out = out | name.startswith(p)
    return out


def api_url(url: Column) -> Column:
    """The record API of a vulnerability page with exactly one well-formed id; null otherwise."""
    ids = F.regexp_extract_all(url, F.lit(r"[?&]id=([^&#]*)"), F.lit(1))
    one = F.try_element_at(ids, F.lit(1))
    page = (host_of(url) == "www.cve.org") & (F.lower(F.regexp_replace(path_of(url), r"/+$", "")) == "/cverecord")
    return F.when(page & (F.size(ids) == 1) & one.rlike(r"(?i)^CVE-\d{4,}-\d+$"), F.concat(F.lit("https://cveawg.mitre.org/api/cve/"), F.upper(one)))


def join_links(base: str, links: list[str], hosts: set[str] | None) -> list[str]:
    """The links of a page that stay on the given hosts (None: any), made absolute and canonical, each once, sorted."""
    out = set()
    for link in links:
        link = link.strip()
        if not link or link.startswith(("#", "?")) or link.lower().startswith(("mailto:", "javascript:", "tel:", "data:")):
            continue
        try:
            p = urlsplit(full := urljoin(base, link))
        except ValueError:
            continue
        if p.scheme in ("http", "https") and (p.netloc if hosts is None else p.netloc.lower() in hosts):
            out.add(_with_query(full))
    return sorted(out)
