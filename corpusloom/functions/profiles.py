"""Site profiles: per-site rules as data, whose methods give column expressions. A profile is passed on explicitly."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.html import Enricher, Strategy
from corpusloom.functions.text import body_kind
from corpusloom.functions.urls import api_url, host_of, path_of, segments

@dataclass(frozen=True)
class Profile:
    """A site without rules of its own: every page is LIVING and general."""

    name: str = "generic"
    host: str = ""
    excludes: tuple[str, ...] = ()
    #: (pattern, replacement) of what changes without a change of content.
    dynamic: tuple[tuple[str, str], ...] = ()
    #: (slug, audience, title) in the order of display.
    sections: tuple[tuple[str, str, str], ...] = ()
    schemas: dict[str, dict] = field(default_factory=dict)
    default_audience: str = "general"
    by_first_segment: dict[str, str] = field(default_factory=dict)
    #: (part of the path, audience), the first that occurs counts.
    by_part: tuple[tuple[str, str], ...] = ()
    browser: bool = False
    #: A year in the path; the first segments of news and of forms; words in the path of pages with facts: the first, and any of the others.
    year: str = ""
    news: str = ""
    forms: str = ""
    fact_parts: tuple[str, tuple[str, ...]] = ("", ())
    #: (part of the host, audience) and (part of the path, audience), before by_part.
    by_host: tuple[tuple[str, str], ...] = ()
    by_own_part: tuple[tuple[str, str], ...] = ()
    #: Plug-ins: ways to read bodies, changes of their markdown, and fact extractors (name, pages(url), rows to facts).
    strategies: tuple[Strategy, ...] = ()
    enrichers: tuple[Enricher, ...] = ()
    extractors: tuple[tuple[str, Callable[[Column], Column], Callable[[DataFrame], DataFrame]], ...] = ()

    def tier(self, url: Column, year: int) -> Column:
        return F.lit("LIVING")

    def fy_years(self, url: Column) -> Column:
        return F.array().cast("array<string>")

    def parent_guide(self, url: Column) -> Column:
        return F.lit(None).cast("string")

    def audience(self, url: Column) -> Column:
        out = F.lit(self.default_audience)
        for part, label in reversed(self.by_part):
            out = F.when(F.lower(path_of(url)).contains(part), label).otherwise(out)
        first = F.lower(F.try_element_at(segments(url), F.lit(1)))
        return choose(first, self.by_first_segment, out)

    def requires_browser(self, url: Column) -> Column:
        return F.lit(self.browser)

    def api_url(self, url: Column) -> Column:
        return F.lit(None).cast("string")

    def body_kind(self, body: Column, url: Column, content_type: Column) -> Column:
        return body_kind(body, url, content_type)

    def fact_pages(self, url: Column) -> Column:
        """Whether facts are looked for on a page."""
        return F.lit(False)


def choose(key: Column, table: dict[str, str], default: Column) -> Column:
    if not table:
        return default
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(m, F.coalesce(key, F.lit(""))), default)


class TaxOffice(Profile):
    def tier(self, url, year):
        path = path_of(url)
        found = F.regexp_extract(path, self.year, 1)
        return F.when((found != "") & (found.try_cast("int") < year), "FROZEN").when(path.startswith(f"/{self.news}/"), "NEWS").when(path.startswith(f"/{self.forms}/"), "CURRENT_FORMS").otherwise("LIVING")

    def fy_years(self, url):
        """Every year of the path as the start of a financial year, each once."""
        starts = F.regexp_extract_all(path_of(url), F.lit(self.year), F.lit(1))
        return F.array_distinct(F.transform(starts, lambda y: F.concat(y, F.lit("-"), F.lpad(((y.cast("int") + 1) % 100).cast("string"), 2, "0"))))

    def parent_guide(self, url):
        return F.when(path_of(url).startswith(f"/{self.forms}/"), F.try_element_at(segments(url), F.lit(2)))

    def requires_browser(self, url):
        return F.lower(path_of(url)).contains("/single-page-applications/")

    def fact_pages(self, url):
        path = F.lower(path_of(url))
        section, kinds = self.fact_parts
        return path.contains(section) & reduce(Column.__or__, (path.contains(k) for k in kinds))


class PythonDocs(Profile):
    def tier(self, url, year):
        return F.when(F.regexp_extract(path_of(url), r"^/(\d+)(?:\.\d+)?/", 1) == "2", "FROZEN").otherwise("LIVING")

    def audience(self, url):
        return choose(F.lower(F.regexp_extract(path_of(url), r"^/\d+(?:\.\d+)?/([^/]+)", 1)), self.by_first_segment, F.lit(self.default_audience))


class WebDocs(Profile):
    def audience(self, url):
        return choose(F.regexp_extract(path_of(url), r"^/[a-zA-Z-]+/docs/Web/([^/]+)", 1), self.by_first_segment, F.lit(self.default_audience))


class StateSite(Profile):
    def audience(self, url):
        rules = [(host_of(url).contains(part), label) for part, label in self.by_host]
        rules += [(F.lower(path_of(url)).rlike(part), label) for part, label in self.by_own_part]
        return F.coalesce(*(F.when(rule, label) for rule, label in rules), super().audience(url))


class Vulnerabilities(Profile):
    def api_url(self, url):
        return api_url(url)


# The rules of each site.
GENERIC = Profile()
GENERIC_BROWSER = Profile("generic-browser", browser=True)

_GOV_PARTS = (
    ("/individuals-and-families", "individuals"), ("/individuals", "individuals"), ("/people", "individuals"), ("/citizens", "individuals"), ("/families", "individuals"),
    ("/businesses-and-organisations", "businesses"), ("/business", "businesses"), ("/employers", "businesses"), ("/companies", "businesses"), ("/industry", "businesses"),
    ("/news", "news"), ("/media-centre", "news"), ("/media-releases", "news"), ("/media", "news"), ("/press-release", "news"), ("/announcements", "news"),
    ("/forms-and-instructions", "forms"), ("/forms", "forms"), ("/services", "services"),
    ("/consultations", "consultation"), ("/consultation", "consultation"), ("/events", "events"),
    ("/resources", "resources"), ("/publications", "resources"), ("/reports", "resources"),
    ("/legislation", "legal"), ("/legal-database", "legal"), ("/law", "legal"), ("/legal", "legal"),
    ("/governance", "about"), ("/about-us", "about"), ("/about-the-", "about"), ("/about", "about"),
    ("/regulatory-resources", "regulatory"), ("/regulation", "regulatory"),
)
_GOV = {
    "excludes": (r"^/sitemap(\.xml)?(/|$)", r"^/search(/|$)", r"^/api/", r"^/print(/|$)", r"^/_/", r"^/admin(/|$)", r"^/login(/|$)", r"^/user(/|$)", r"^/system/files/", r"^/cron(/|$)", r"^/feeds?(/|$)", r"^/rss(/|$)", r"^/node/\d+/edit"),
    "dynamic": (
        (r"(?im)^\s*Last\s+(?:modified|reviewed|updated|published|amended)\s*:?.*$", ""),
        (r"(?im)^\s*Page\s+last\s+(?:modified|reviewed|updated)\s*:?.*$", ""),
        (r"(©\s*Commonwealth\s+of\s+Australia)\s+\d{4}", r"\1"),
        (r"(©\s*(?:Government|State)\s+of\s+(?:South\s+Australia|New\s+South\s+Wales|Victoria|Queensland|Western\s+Australia|Tasmania|Northern\s+Territory))\s+\d{4}", r"\1"),
        (r"(?i)\bNode\s*(?:ID|id)\s*:?\s*\d+\b", ""),
        (r"(?i)\bBuild\s*(?:ID|version)\s*:?\s*[A-Za-z0-9_-]{6,}\b", ""),
    ),
    "by_part": _GOV_PARTS,
}
AU_GOV = Profile("au-gov", **_GOV)
SA_GOV = StateSite(
    "sa-gov", **_GOV,
    by_host=(("revenuesa", "tax"), ("plansa", "planning"), ("plan.sa.gov.au", "planning"), ("sahealth", "health"), ("police.sa.gov.au", "police"), ("sapol", "police")),
    by_own_part=(("/revenue", "tax"), ("/code-amendment", "planning"), ("/planning-and-design-code", "planning"), ("/development-applications", "planning"), ("^/das", "planning")),
)
_ATO_SECTIONS = (
    ("individuals-and-families", "individuals", "Individuals and families"), ("businesses-and-organisations", "businesses", "Businesses and organisations"),
    ("tax-and-super-professionals", "professionals", "Tax and super professionals"), ("forms-and-instructions", "forms", "Forms and instructions"),
    ("tax-rates-and-codes", "rates", "Tax rates and codes"), ("calculators-and-tools", "tools", "Calculators and tools"),
    ("law", "legal", "Law and rulings"), ("media-centre", "news", "Media centre"), ("about-ato", "ato", "About the ATO"),
)
_TEXT, _NUMBER = {"type": "string"}, {"type": "number"}


def _schema(name: str, required: tuple[str, ...], /, **properties) -> dict:
    return {"$id": name, "type": "object", "required": ["$schema", "source_url", "content_hash", *required], "properties": {"$schema": {"const": name}, "source_url": _TEXT, "content_hash": _TEXT, "extractor_version": _TEXT, "notes": _TEXT, **properties}}


_BRACKET = {"type": "object", "required": ["from", "rate"], "properties": {"from": {"type": "integer", "minimum": 0}, "to": {"type": ["integer", "null"], "minimum": 0}, "rate": {"type": "number", "minimum": 0, "maximum": 1}, "base": {"type": "number", "minimum": 0}}}
_ATO_SCHEMAS = {
    s["$id"]: s
    for s in (
        _schema(
            "ato-rate-table-v1", ("fy", "audience", "brackets", "effective_from", "effective_to"),
            content_hash={"type": "string", "pattern": "^(sha256:[0-9a-f]{64}|manual:.*)$"}, fy={"type": "string", "pattern": "^[0-9]{4}-[0-9]{2}$"},
            audience={"type": "string", "enum": ["individual_resident", "individual_foreign_resident", "individual_working_holiday_maker", "company"]},
            brackets={"type": "array", "items": _BRACKET}, effective_from=_TEXT, effective_to=_TEXT,
        ),
        _schema("ato-cap-threshold-v1", ("fy", "name", "amount", "unit"), fy=_TEXT, name=_TEXT, amount=_NUMBER, unit={"type": "string", "enum": ["AUD", "AUD_per_year", "percent", "count"]}),
        _schema("ato-deadline-v1", ("fy", "name", "due_date", "applies_to"), fy=_TEXT, name=_TEXT, due_date=_TEXT, applies_to=_TEXT),
        _schema("ato-eligibility-rule-v1", ("name", "criteria"), name=_TEXT, fy=_TEXT, criteria={"type": "array", "items": {"type": "object", "required": ["condition"], "properties": {"condition": _TEXT, "value": {}}}}),
    )
}
ATO = TaxOffice(
    "ato", "www.ato.gov.au",
    excludes=(r"^/sitemap(\.xml)?(/|$)", r"^/api/", r"^/print(/|$)", r"^/errors?(/|$)", r"^/page-unavailable(/|$)", r"^/whats-new(/|$)"),
    dynamic=(
        (r"(?im)^\s*Last\s+(?:modified|reviewed|updated)\s*:?.*$", ""), (r"(?im)^\s*Page\s+last\s+(?:modified|reviewed|updated)\s*:?.*$", ""),
        (r"\bQC\s*\d{3,7}\b", ""), (r"(?i)\bSession\s*ID\s*:?\s*[A-Z0-9\-]+\b", ""), (r"(?i)\bPage\s*ID\s*:?\s*\d+\b", ""),
        (r"(©\s*Commonwealth\s+of\s+Australia)\s+\d{4}", r"\1"),
    ),
    year=r"[/\-]((?:19|20)\d{2})(?=[/\-]|$)", news="media-centre", forms="forms-and-instructions",
    fact_parts=("tax-rates-and-codes", ("tax-rates-australian-residents", "resident-tax-rates", "individual-income-tax-rates", "tax-tables-for-", "previous-years-tax-tables")),
    sections=_ATO_SECTIONS, schemas=_ATO_SCHEMAS, by_first_segment={slug: label for slug, label, _ in _ATO_SECTIONS},
)
STRIPE = Profile(
    "stripe-docs", "docs.stripe.com", default_audience="developers",
    excludes=(r"^/blog(/|$)", r"^/jobs(/|$)", r"^/customers(/|$)", r"^/customer-references(/|$)", r"^/about(/|$)", r"^/legal(/|$)", r"^/privacy(/|$)", r"^/terms(/|$)", r"^/atlas/guides(/|$)", r"^/sitemap(\.xml)?(/|$)", r"^/search(/|$)"),
    dynamic=((r"(?i)build\s+id\s*:?\s*[A-Za-z0-9_-]{6,}", ""), (r"(?im)^\s*Updated\s*:?\s*\d{4}-\d{2}-\d{2}.*$", "")),
    sections=(
        ("api", "api-reference", "API Reference"), ("payments", "payments", "Payments"), ("billing", "billing", "Billing & Subscriptions"), ("checkout", "checkout", "Checkout"),
        ("elements", "elements", "Stripe Elements"), ("connect", "connect", "Connect (Platforms)"), ("terminal", "terminal", "Terminal (In-Person)"), ("treasury", "treasury", "Treasury"),
        ("issuing", "issuing", "Issuing"), ("identity", "identity", "Identity Verification"), ("webhooks", "webhooks", "Webhooks"), ("testing", "testing", "Testing"), ("cli", "cli", "Stripe CLI"), ("sdks", "sdks", "SDKs & Libraries"),
    ),
    by_first_segment={
        "api": "api-reference", "payments": "payments", "billing": "billing", "connect": "connect", "terminal": "terminal", "treasury": "treasury", "financial-connections": "data",
        "issuing": "issuing", "identity": "identity", "atlas": "atlas", "tax": "tax", "radar": "radar", "sigma": "sigma", "climate": "climate", "elements": "elements",
        "checkout": "checkout", "invoicing": "invoicing", "webhooks": "webhooks", "testing": "testing", "cli": "cli", "sdks": "sdks",
    },
)
MDN = WebDocs(
    "mdn", "developer.mozilla.org", default_audience="reference",
    excludes=(r"^/(?!en-US/|sitemap|api/)", r"^/contribute(/|$)", r"^/plus(/|$)", r"^/observatory(/|$)", r"^/play(/|$)", r"^/blog(/|$)", r"^/curriculum(/|$)", r"^/community(/|$)"),
    dynamic=((r"(?im)^\s*Page\s+last\s+modified\s*:?.*$", ""), (r"(?im)^\s*Last\s+modified\s*:?.*$", ""), (r"(?i)revision\s*:?\s*[a-f0-9]{6,}", "")),
    sections=(
        ("Web/JavaScript", "javascript", "JavaScript"), ("Web/CSS", "css", "CSS"), ("Web/HTML", "html", "HTML"), ("Web/API", "web-api", "Web APIs"), ("Web/HTTP", "http", "HTTP"),
        ("Web/Accessibility", "accessibility", "Accessibility"), ("Web/Performance", "performance", "Performance"), ("Web/Security", "security", "Security"), ("Web/SVG", "svg", "SVG"), ("Web/WebAssembly", "wasm", "WebAssembly"),
    ),
    by_first_segment={
        "JavaScript": "javascript", "CSS": "css", "HTML": "html", "API": "web-api", "HTTP": "http", "Accessibility": "accessibility", "Performance": "performance", "Privacy": "privacy", "Security": "security",
        "SVG": "svg", "MathML": "mathml", "WebAssembly": "wasm", "Manifest": "manifest", "Media": "media", "XPath": "xpath", "XSLT": "xslt", "Guide": "guide", "Tutorials": "tutorials",
    },
)
PYTHON_DOCS = PythonDocs(
    "python-docs", "docs.python.org", default_audience="reference",
    excludes=(r"^/sitemap(\.xml)?(/|$)", r"^/_sources/", r"^/_static/", r"^/_images/", r"^/objects\.inv$", r"^/search\.html$", r"^/searchindex\.js$", r"^/genindex-all\.html$", r"^/dev(/|$)"),
    dynamic=((r"(?im)^\s*Last\s+updated\s+on\s+.*$", ""), (r"(?i)Sphinx\s*\d+\.\d+\.\d+", ""), (r"(?i)build\s+from\s+commit\s+[a-f0-9]{6,}", "")),
    sections=(
        ("tutorial", "tutorial", "Tutorial"), ("library", "stdlib", "Standard Library Reference"), ("reference", "language-ref", "Language Reference"), ("howto", "howto", "HOWTOs"), ("whatsnew", "release-notes", "What's New"),
        ("c-api", "c-api", "C API Reference"), ("extending", "c-api", "Extending Python"), ("using", "tooling", "Using Python"), ("distributing", "packaging", "Distributing Modules"), ("installing", "packaging", "Installing Modules"), ("faq", "faq", "FAQs"),
    ),
    by_first_segment={
        "library": "stdlib", "reference": "language-ref", "tutorial": "tutorial", "howto": "howto", "faq": "faq", "whatsnew": "release-notes", "extending": "c-api", "c-api": "c-api",
        "using": "tooling", "distributing": "packaging", "installing": "packaging", "glossary": "glossary", "py-modindex": "index", "genindex": "index",
    },
)
CVE = Vulnerabilities("cve", "www.cve.org")
PROFILES = {p.name: p for p in (GENERIC, GENERIC_BROWSER, ATO, AU_GOV, SA_GOV, STRIPE, MDN, PYTHON_DOCS, CVE)}


def load(name: str) -> Profile:
    """A shipped profile by name, or any by module:object."""
    if name in PROFILES:
        return PROFILES[name]
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"no such profile: {name}")
    found = getattr(importlib.import_module(module), attribute, None)
    if found is None:
        raise ImportError(f"{module} has no {attribute}")
    found = found() if isinstance(found, type) else found
    if not isinstance(found, Profile):
        raise TypeError(f"{name} is no profile")
    return found
