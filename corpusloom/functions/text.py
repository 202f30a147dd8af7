"""Text functions: normalisation and content hashes, slugs and anchors, front matter, element counts, fidelity."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions._udf import vectorized

#: Markers of challenge pages, of data embedded in a page, and of whole-page blocks.
CHALLENGE = (
    "just a moment", "attention required", "cf-browser-verification", "checking your browser before", "_incapsula_resource",
    "pardon our interruption", "please enable javascript", "enable javascript to run this app", "access denied",
    "request unsuccessful. incapsula", "px-captcha", "datadome", "verify you are human",
)
EMBEDDED = ("__next_data__", "application/ld+json", "window.__nuxt__", "__apollo_state__", "self.__next_f")
BLOCKS = ("cf-browser-verification", "cf-im-under-attack", "window._cf_chl_opt", "_incapsula_resource", "px-captcha", "captcha-delivery")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def visible_text(html: Column) -> Column:
    """A page without scripts, styles and tags, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def visible_text_len(html: Column) -> Column:
    return F.char_length(visible_text(html))


def contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | text.contains(m)
    return out


def looks_thin(body: Column, content_type: Column, threshold: int) -> Column:
    """Whether a response is an empty shell or a challenge page; the first rule that applies decides."""
    if threshold <= 0:
        return F.lit(False)
    kind, low = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(body)
    blob = F.regexp_extract(body, r'(?is)id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    return (
        F.when((kind != "") & ~kind.contains("html"), False)
        .when((kind == "") & ~low.contains("<html") & ~low.contains("<!doctype html"), False)
        .when(contains_any(low, CHALLENGE), True)
        .when(F.char_length(blob) >= max(2048, 2 * threshold), False)
        .when(contains_any(low, EMBEDDED) & (F.char_length(body) >= 12 * threshold), False)
        .otherwise(visible_text_len(body) < threshold)
    )


def admitted(raw: Column, extracted: Column, content_type: Column) -> Column:
    """False where the page, but not its extracted text, carries a block marker."""
    kind, low, text = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(raw), F.lower(extracted)
    blocked = F.lit(False)
    for m in BLOCKS:
        blocked = blocked | (low.contains(m) & ~text.contains(m))
    return F.when(F.coalesce(extracted, F.lit("")) == "", True).when((kind != "") & ~kind.contains("html"), True).otherwise(~blocked)


def body_kind(body: Column, url: Column, content_type: Column) -> Column:
    """The extraction route of a response: markdown, pdf, json or html."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(kind.contains("markdown") | F.lower(F.regexp_replace(url, r"[?#].*$", "")).endswith(".md"), "markdown")
        .when(F.substring(body, 1, 1024).rlike(r"^[\x00\s]*%PDF-"), "pdf")
        .when(kind.contains("json") | F.substring(body, 1, 512).rlike(r"^\x{FEFF}?\s*[\[{]"), "json")
        .otherwise("html")
    )


#: What counts as an element of each kind in HTML and in markdown.
HTML_ELEMENTS = {"heading": r"(?i)<h[1-6]\b", "table": r"(?i)<table\b", "list": r"(?i)<[uo]l\b", "code_block": r"(?i)<pre\b", "link": r"(?i)<a\b[^>]*\bhref\s*="}
MD_ELEMENTS = {"heading": r"(?m)^#{1,6}\s+\S", "table": r"(?m)^\|[^\n]+\|", "list": r"(?m)^\s*(?:[-*+]\s|\d+\.\s)\S", "code_block": r"(?m)^```", "link": r"\[[^\]]+\]\([^)]+\)"}


def html_elements(html: Column) -> dict[str, Column]:
    return {k: F.regexp_count(html, F.lit(p)) for k, p in HTML_ELEMENTS.items()}


def md_elements(md: Column) -> dict[str, Column]:
    """As above; code blocks are pairs of fences."""
    out = {k: F.regexp_count(md, F.lit(p)) for k, p in MD_ELEMENTS.items()}
    out["code_block"] = F.floor(out["code_block"] / 2).cast("int")
    return out


def preservation(html: Column, md: Column) -> dict[str, Column]:
    """For each kind the share of the page's elements that the markdown has, at most 1; 1 where the page has none."""
    h, m = html_elements(html), md_elements(md)
    return {k: F.when(h[k] == 0, 1.0).otherwise(F.least(F.lit(1.0), m[k] / h[k])) for k in h}


def normalize(text: str | None, patterns: tuple[tuple[str, str], ...] = ()) -> str:
    """What is hashed: NFC, boilerplate patterns replaced, LF line ends, no trailing blanks, at most one blank line in a row."""
    if not text:
        return ""
    text = unicodedata.normalize("NFC", text)
    for pattern, to in patterns:
        text = re.sub(pattern, to, text)
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in lines)).strip()


def normalized(text: Column, patterns: tuple[tuple[str, str], ...] = ()) -> Column:
    """normalize() of a column. Texts without characters beyond ASCII, where NFC changes nothing, stay in the JVM if there are no patterns."""

    @F.pandas_udf("string")
    def exact(s: pd.Series) -> pd.Series:
        return s.map(lambda t: normalize(t, patterns))

    if patterns:
        return exact(text)
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), r"[ \t\f\x0B\x1C-\x1F]+(?=\n|$)", "")
    native = F.regexp_replace(F.regexp_replace(F.regexp_replace(lines, r"[ \t\f\x0B\x1C-\x1F]+\n", "\n"), r"\n{3,}", "\n\n"), r"^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    return F.when(text.isNull(), "").when(text.rlike(r"^[\x00-\x7F]*$"), native).otherwise(exact(text))


def normalizer_version(patterns: tuple[tuple[str, str], ...] = ()) -> str:
    """The version of the normaliser; it names the patterns, as the content hash depends on them."""
    if not patterns:
        return "v2"
    found = [re.compile(p) for p, _ in patterns]
    text = json.dumps([[p.pattern, int(p.flags)] for p in found], ensure_ascii=True, separators=(",", ":"))
    return f"v2+{hashlib.sha256(text.encode()).hexdigest()[:12]}"


def content_hash(text: Column, patterns: tuple[tuple[str, str], ...] = ()) -> Column:
    return sha256_hex(normalized(text, patterns))


def slug(text: Column) -> Column:
    """The anchor of a heading: a-z, 0-9 and dashes, at most 80 characters."""
    kept = F.regexp_replace(F.trim(F.lower(text)), r"[^a-z0-9\s-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), r"^-+|-+$", ""), 1, 80)


def slug_text(text: str) -> str:
    kept = re.sub(r"[^a-z0-9\s-]", "", text.lower().strip())
    return re.sub(r"\s+", "-", kept).strip("-")[:80]


def anchored_text(md: str) -> tuple[str, list[str]]:
    """Markdown whose headings carry an anchor each, and the anchors given; equal slugs are numbered from 2."""
    seen: Counter[str] = Counter()
    out: list[str] = []

    def mark(m: re.Match) -> str:
        if re.search(r"\{#[^}]+\}\s*$", m[2]):
            return m[0]
        base = slug_text(m[2]) or "section"
        seen[base] += 1
        out.append(base if seen[base] == 1 else f"{base}-{seen[base]}")
        return f"{m[1]} {m[2]} {{#{out[-1]}}}"

    return re.sub(r"(?m)^(#{1,6})\s+(.+?)\s*$", mark, md), out


@vectorized("struct<md:string,anchors:array<string>>")
def anchored(md: pd.Series) -> pd.DataFrame:
    rows = [anchored_text(x) if x is not None else (None, None) for x in md]
    return pd.DataFrame({"md": [a for a, _ in rows], "anchors": [b for _, b in rows]})


#: The order of the front-matter keys.
FRONT_KEYS = ("url", "title", "fetched_at", "http_status", "sitemap_lastmod", "raw_hash", "content_hash", "crawler_version", "extractor_version", "normalizer_version", "tier", "parent_guide", "audience", "fy_years", "anchors")


def _quoted(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r'^\{"x":|\}$', "")


def front_matter(row: dict[str, Column]) -> Column:
    """The head of a page from columns by key: hashes get their prefix, titles and lists are JSON, missing values read null."""
    lines = [F.lit("---")]
    for key in FRONT_KEYS:
        v = row[key]
        if key in ("raw_hash", "content_hash"):
            v = F.concat(F.lit("sha256:"), v)
        elif key == "title":
            v = F.when(F.coalesce(v, F.lit("")) != "", _quoted(v)).otherwise("null")
        elif key in ("fy_years", "anchors"):
            v = F.concat(F.lit("["), F.array_join(F.transform(v, _quoted), ", "), F.lit("]"))
        lines.append(F.concat(F.lit(f"{key}: "), F.coalesce(v.cast("string"), F.lit("null"))))
    return F.concat_ws("\n", *lines, F.lit("---"), F.lit(""))


def split_front(page: Column) -> tuple[Column, Column]:
    """The head as map<string,string> (null without one) and the body."""
    head = F.regexp_extract(page, r"\A---\n((?s).*?\n)---\n", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")))
    # The last of equal keys counts.
    last = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
    return F.when(head != "", last), F.regexp_replace(page, r"\A---\n(?s).*?\n---\n", "")


def truncated(text: Column, limit: int) -> Column:
    """The text, cut at limit characters with a note."""
    note = F.concat(F.lit("\n… [truncated, "), (F.char_length(text) - limit).cast("string"), F.lit(" more chars]"))
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), note))


def tokens(text: Column) -> Column:
    """Words (letters, digits and _ of any script) in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Token-set similarity; two empty texts are alike."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def edit_similarity(a: Column, b: Column, cap: int = 50_000) -> Column:
    """1 less the edit distance over the longer length; of texts cut at cap characters."""
    x, y = F.substring(a, 1, cap), F.substring(b, 1, cap)
    longest = F.greatest(F.char_length(x), F.char_length(y))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(x, y) / longest)


def ngram_overlap(reference: Column, candidate: Column, n: int = 3) -> Column:
    """The share of the reference's token n-grams that the candidate has, with multiplicity."""

    def counts(text: Column) -> Column:
        t = tokens(text)
        grams = F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, n), " ")))
        return grams

    x, y = counts(reference), counts(candidate)
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(F.size(F.filter(x, lambda v: v == g)), F.size(F.filter(y, lambda v: v == g))))
    return F.when(F.size(x) == 0, F.when(F.size(y) == 0, 1.0).otherwise(0.0)).otherwise(common / F.size(x))


def fidelity(a: Column, b: Column) -> Column:
    """Half edit similarity, three tenths token overlap, two tenths n-gram overlap."""
    return 0.5 * edit_similarity(a, b) + 0.3 * jaccard(a, b) + 0.2 * ngram_overlap(a, b)


@vectorized("struct<diff:string,added:int,removed:int>")
def unified_diff(a: pd.Series, b: pd.Series, context: pd.Series) -> pd.DataFrame:
    """The unified diff of two texts with so many lines of context, and its counts."""
    import difflib

    rows = []
    for x, y, n in zip(a, b, context, strict=True):
        lines = list(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "from", "to", n=int(n), lineterm=""))
        plus = sum(s.startswith("+") and not s.startswith("+++") for s in lines)
        minus = sum(s.startswith("-") and not s.startswith("---") for s in lines)
        rows.append(("\n".join(lines), plus, minus))
    return pd.DataFrame(rows, columns=["diff", "added", "removed"])


#: Phrases by which an answer says that it has none.
REFUSALS = (
    "i don't have information", "i cannot answer", "i can't answer", "i'm unable to", "i am unable to",
    "i don't know", "i do not know", "no information available", "cannot determine",
)


def refusal(answer: Column) -> Column:
    return contains_any(F.lower(F.coalesce(answer, F.lit(""))), REFUSALS)


def urls_in(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(r"(?i)(https?://[^\s)>,]+)"), F.lit(1))
