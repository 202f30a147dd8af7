import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import facts, html, profiles, text, urls


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://x.com/a#b", "https://x.com/a"), ("https://WWW.X.COM/A", "https://www.x.com/A"), ("https://x.com/a/", "https://x.com/a"), ("https://x.com/", "https://x.com/"),
        ("https://x.com/a?b=2&a=1", "https://x.com/a?a=1&b=2"), ("https://x.com/a?utm_source=g&utm_medium=cpc&gclid=xxx&keep=1", "https://x.com/a?keep=1"),
        ("https://x.com/a?q=a%20b+c&k=", "https://x.com/a?k=&q=a+b+c"), ("HTTPS://X.com", "https://x.com/"), (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical_url(F.lit(url).cast("string"))) == want


def test_url_parts(spark):
    assert one(spark, F.array_join(urls.safe_segments(F.lit("https://x/a+b/c%20d")), "|")) == "a_b|c_20d"
    assert one(spark, F.length(urls.safe_segments(F.lit("https://x/" + "y" * 500))[0])) == 200
    assert one(spark, urls.malformed(F.lit("https://x/a%20https://x/b"))) and one(spark, urls.malformed(F.lit("https://x/" + "a" * 2100)))
    assert one(spark, urls.md_path(F.lit("https://x/a/b.html"))) == "a/b.md" and one(spark, urls.md_path(F.lit("https://x/"))) == "_root.md"
    assert one(spark, urls.connect_host(F.lit("https://u:p@H.com:8443/x"))) == "h.com" and one(spark, urls.connect_host(F.lit("ftp://h/x"))) is None
    assert one(spark, urls.api_url(F.lit("https://www.cve.org/CVERecord?id=cve-2021-44228"))).endswith("/CVE-2021-44228")
    assert one(spark, urls.api_url(F.lit("https://www.cve.org/CVERecord?id=CVE-2021-1&id=CVE-2021-2"))) is None


@pytest.mark.parametrize(
    ("path", "tier"),
    [
        ("/forms-and-instructions/foreign-income-2005/p1", "FROZEN"), ("/tax-rates-and-codes/2023-24-tax-rates", "FROZEN"), ("/forms-and-instructions/individual-tax-return-2025-instructions", "CURRENT_FORMS"),
        ("/forms-and-instructions/some-evergreen-form", "CURRENT_FORMS"), ("/media-centre/some-press-release", "NEWS"), ("/individuals-and-families/your-tax-return", "LIVING"), ("/", "LIVING"),
    ],
)
def test_tiers(spark, path, tier):
    assert one(spark, profiles.ATO.tier(F.lit("https://www.ato.gov.au" + path), 2025)) == tier


def test_profiles(spark):
    u = lambda x: F.lit(x)
    assert one(spark, profiles.PYTHON_DOCS.tier(u("https://docs.python.org/2.7/library/os.html"), 2025)) == "FROZEN"
    assert one(spark, profiles.PYTHON_DOCS.audience(u("https://docs.python.org/3/library/os.html"))) == "stdlib"
    assert one(spark, profiles.MDN.audience(u("https://developer.mozilla.org/en-US/docs/Web/CSS/x"))) == "css"
    assert one(spark, profiles.SA_GOV.audience(u("https://www.revenuesa.sa.gov.au/x"))) == "tax" and one(spark, profiles.AU_GOV.audience(u("https://x.gov.au/media/y"))) == "news"
    assert one(spark, profiles.ATO.fy_years(u("https://x/2025-26-tax-rates/foreign-2005"))) == ["2025-26", "2005-06"]
    assert profiles.load("mdn") is profiles.MDN and profiles.load("corpusloom.functions.profiles:CVE") is profiles.CVE
    with pytest.raises(ValueError):
        profiles.load("nothing")
    with pytest.raises(ImportError):
        profiles.load("corpusloom.functions.profiles:Nothing")
    with pytest.raises(TypeError):
        profiles.load("corpusloom.functions.profiles:choose")


@pytest.mark.parametrize(
    ("a", "b"),
    [("Café", "Café"), ("a\r\nb", "a\nb"), ("a  \nb\t", "a\nb"), ("a\n\n\n\nb", "a\n\nb"), ("a\rb", "a\nb"), (None, ""), ("  x \n", "x")],
)
def test_equal_content_hashes(spark, a, b):
    h = lambda t: one(spark, text.content_hash(F.lit(t).cast("string")))
    assert h(a) == h(b) == hashlib.sha256(text.normalize(a).encode()).hexdigest()


def test_patterns_and_versions(spark):
    p = profiles.ATO.dynamic
    h = lambda t: one(spark, text.content_hash(F.lit(t), p))
    assert h("x\nLast modified 1 May") == h("x\nLast modified 2 June") and h("© Commonwealth of Australia 2024") == h("© Commonwealth of Australia 2025")
    assert text.normalizer_version() == "v2" and text.normalizer_version(p).startswith("v2+") and text.normalizer_version(p) != text.normalizer_version(p[:2])
    once = text.normalize("a \r\n\n\n\n b", p)
    assert text.normalize(once, p) == once


def test_slugs_and_anchors(spark):
    assert one(spark, text.slug(F.lit("  Hello, World! It's 2024 "))) == text.slug_text("  Hello, World! It's 2024 ") == "hello-world-its-2024"
    md, anchors = text.anchored_text("# Foo\n## Foo\ntext\n### Foo\n# Kept {#mine}\n# ???")
    assert anchors == ["foo", "foo-2", "foo-3", "section"] and "# Kept {#mine}" in md
    assert one(spark, text.anchored(F.lit("# A b"))["md"]) == "# A b {#a-b}"


def test_front_matter_round_trip(spark):
    row = {k: F.lit(f"v-{k}") for k in text.FRONT_KEYS} | {"title": F.lit('A "title"'), "parent_guide": F.lit(None).cast("string"), "fy_years": F.array(F.lit("2025-26")), "anchors": F.array().cast("array<string>")}
    page = one(spark, F.concat(text.front_matter(row), F.lit("# body\nx: y")))
    assert page.startswith('---\nurl: v-url\ntitle: "A \\"title\\""\n') and 'fy_years: ["2025-26"]' in page and "raw_hash: sha256:v-raw_hash" in page and "parent_guide: null" in page
    head, body = text.split_front(F.lit(page))
    assert one(spark, head)["url"] == "v-url" and one(spark, body) == "# body\nx: y"
    assert one(spark, text.split_front(F.lit("no head"))[0]) is None


def test_thin_and_admitted(spark):
    thin = lambda b, t="text/html", n=200: one(spark, text.looks_thin(F.lit(b), F.lit(t).cast("string"), n))
    assert thin("<html><body>Just a moment...</body></html>") and thin("<html><p>short</p></html>") and not thin("<html>" + "word " * 100)
    assert not thin("<html></html>", "application/pdf") and not thin("plain", None) and not thin("<html></html>", n=0)
    assert not thin('<html><script id="__NEXT_DATA__" type="x">' + "y" * 2100 + "</script></html>")
    ok = lambda raw, md: one(spark, text.admitted(F.lit(raw), F.lit(md), F.lit("text/html")))
    assert not ok('<body class="cf-browser-verification">x</body>', "x") and ok("<p>about cf-browser-verification</p>", "about cf-browser-verification") and ok("<div id=px-captcha>", "")


def test_element_counts(spark):
    h = "<h1>a</h1><h2>b</h2><table><tr><td>1</td></tr></table><ul><li>x</ul><pre>c</pre><a href='x'>l</a><a class=z href=y>m</a>"
    assert [one(spark, c) for c in text.html_elements(F.lit(h)).values()] == [2, 1, 1, 1, 2]
    md = "# a\n\n## b\n| 1 | 2 |\n- x\n```\nc\n```\n[l](x)"
    assert [one(spark, c) for c in text.md_elements(F.lit(md)).values()] == [2, 1, 1, 1, 1]
    assert one(spark, text.preservation(F.lit(h), F.lit(md))["link"]) == 0.5


def test_fidelity_and_diff(spark):
    a, b = F.lit("The cat sat on the mat"), F.lit("the cat sat on a mat")
    assert one(spark, text.jaccard(a, b)) == pytest.approx(5 / 6) and one(spark, text.ngram_overlap(a, b)) == pytest.approx(2 / 4) and one(spark, text.fidelity(a, a)) == 1.0
    d = one(spark, text.unified_diff(F.lit("a\nb\nc"), F.lit("a\nx\nc"), F.lit(1)))
    assert (d["added"], d["removed"]) == (1, 1) and "-b\n+x" in d["diff"]
    assert one(spark, text.truncated(F.lit("abcdef"), 3)).startswith("abc\n") and one(spark, text.refusal(F.lit("Sorry, I don't know.")))
    assert one(spark, text.urls_in(F.lit("see https://a.b/c, (http://d)"))) == ["https://a.b/c", "http://d"]


def test_extraction():
    x = html.extract("<html><head><title>T</title></head><body><nav>menu</nav><article><h1>Head</h1><p>One <b>two</b> <a href='/x'>link</a></p><ol><li>i<li>j</ol><table><tr><th>A<th>B<tr><td>1<td>2</table><pre><code class='language-python'>print(1)</code></pre></article></body></html>", "html")
    assert x["ok"] and x["title"] == "T" and x["anchors"] == ["head"] and "menu" not in x["md"]
    for part in ("# Head {#head}", "One **two** [link](/x)", "1. i\n2. j", "| A | B |\n| --- | --- |\n| 1 | 2 |", "```py\nprint(1)\n```"):
        assert part in x["md"]
    assert not html.extract("", "html")["ok"] and html.extract("%PDF-1.4", "pdf")["reason"] == "extract-failed-pdf"
    assert html.extract("# Doc\ntext", "markdown")["title"] == "Doc"
    j = html.extract('{"title": "Rec", "body": "<p>Hello <b>you</b></p>", "meta": 1}', "json")
    assert j["title"] == "Rec" and j["md"] == "Hello **you**" and "```json" in html.extract('{"a": 1}', "json")["md"] and not html.extract("{}", "json")["ok"]
    state = 'self.__next_f.push([1,"1:[\\"$\\",\\"h2\\",null,{\\"children\\":\\"Setup\\"}]\\n2:[\\"$\\",\\"p\\",null,{\\"children\\":\\"A paragraph that is long enough to count.\\"}]"])'
    assert html.next_state(state) == [("heading", "Setup"), ("text", "A paragraph that is long enough to count.")]
    state = 'self.__next_f.push([1,"1:[\\"$\\",\\"div\\",null,{\\"children\\":[[\\"$\\",\\"p\\",null,{\\"children\\":[\\"One sentence \\",[\\"$\\",\\"b\\",null,{\\"children\\":\\"with a bold part\\"}],\\" in it.\\"]}],\\"short\\"]}]"])'
    assert html.next_state(state) == [("text", "One sentence with a bold part in it.")]


def test_links(spark):
    page = "<html><a href='/a'>1</a><a href='sub/b#x'>2</a><a href='https://other.com/c'>3</a><a href='#top'>4</a><a href='mailto:x@y'>5</a><a href='javascript:x'>6</a><a href='/a/'>7</a></html>"
    assert one(spark, html.links(F.lit(page), F.lit("https://h.com/d/e"), F.lit("h.com"))) == ["https://h.com/a", "https://h.com/d/sub/b"]
    assert one(spark, html.links(F.lit("just text"), F.lit("https://h.com/"), F.lit("h.com"))) == []


RATES = "<h1>Rates 2025–26</h1><table><tr><th>Taxable income</th><th>Tax on this income</th></tr>" + "".join(
    f"<tr><td>{a}</td><td>{b}</td></tr>"
    for a, b in (("0 – $18,200", "Nil"), ("$18,201 – $45,000", "16c for each $1 over $18,200"), ("$45,001 – $135,000", "$4,288 plus 30c for each $1 over $45,000"), ("$135,001 – $190,000", "$31,288 plus 37c for each $1 over $135,000"), ("$190,001 and over", "$51,638 plus 45c for each $1 over $190,000"))
) + "</table>"


def test_rate_tables(spark):
    facts_of = lambda html: facts.rate_facts(spark.createDataFrame([(html,)], "html string"), F.col("html")).first()["facts"]
    (f,) = facts_of(RATES)
    b = [x.asDict() for x in f["brackets"]]
    assert len(b) == 5 and b[0] == {"from": 0, "to": 18200, "rate": 0.0, "base": 0} and b[1]["rate"] == 0.16 and (b[-1]["to"], b[-1]["rate"], b[-1]["base"]) == (None, 0.45, 51638)
    assert (f["fy"], f["effective_from"], f["effective_to"]) == ("2025-26", "2025-07-01", "2026-06-30")
    assert one(spark, facts.looks_like_rates(F.lit(RATES)))
    assert not one(spark, facts.looks_like_rates(F.lit("<ul><li>news</ul>"))) and facts_of("<table></table>") == facts_of(None) == []
    assert one(spark, facts.dollars(F.lit("$18,200"))) == 18200 and one(spark, facts.rate(F.lit("30%"))) == 0.3 and one(spark, facts.rate(F.lit("Nil"))) == 0.0 and one(spark, facts.rate(F.lit("x"))) is None
    assert one(spark, facts.financial_year(F.lit("2025-27"))) is None


def test_rate_tables_by_caption_url_and_heading(spark):
    """The caption names the year, else the url, else a heading; a table without a year, or with one band, gives no fact."""
    table = "<table>{}<tr><th>Taxable income</th><th>Tax payable</th></tr><tr><td>$0 to 10,000.50</td><td>Nil</td></tr><tr><td>More than $10,000</td><td>$1,234.56 plus 30.5%</td></tr><tr><td>Total</td><td>9%</td></tr></table>"
    plain, named = table.format(""), table.format("<caption>Rates 2021-22</caption>")

    def facts_of(html, year=None):
        rows = spark.createDataFrame([(html, year)], "html string, year string")
        return [(f["fy"], [tuple(b) for b in f["brackets"]]) for f in facts.rate_facts(rows, F.col("html"), F.col("year")).first()["facts"]]

    bands = [(0, 10000, 0.0, 0.0), (10000, None, 0.305, 1234.56)]
    assert facts_of(plain) == [] and facts_of(plain, "2019-20") == [("2019-20", bands)]
    assert facts_of("<h2>2018-19</h2><h1>In 2017-18</h1>" + plain) == [("2017-18", bands)]
    assert facts_of("<h1>In 2017-18</h1>" + plain + named + plain, "2019-20") == [("2019-20", bands), ("2021-22", bands)]
    assert facts_of(plain.replace("More than", "About"), "2019-20") == []


def test_fact_schemas():
    schema = profiles.ATO.schemas["ato-rate-table-v1"]
    good = {"$schema": "ato-rate-table-v1", "source_url": "u", "content_hash": "sha256:" + "a" * 64, "fy": "2025-26", "audience": "company", "brackets": [{"from": 0, "to": None, "rate": 0.3}], "effective_from": "2025-07-01", "effective_to": "2026-06-30"}
    assert facts.validate(good, schema) == []
    assert len(facts.validate(good | {"fy": "2025", "brackets": [{"from": -1, "rate": 2}]}, schema)) == 3
    assert facts.validate({"x": "not-an-int"}, {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}) != []
