"""HTML: a small parser on the standard library, and what extraction takes from it. UDFs never raise: a row that fails says so."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions._udf import vectorized
from corpusloom.functions.text import anchored_text, normalize
from corpusloom.functions.urls import join_links

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CHROME = frozenset("script style noscript nav header footer aside form template svg iframe".split())
EXTRACTOR_VERSION = "loom-html-1"

#: Prefixes of code-language classes, and short names of languages.
LANGUAGE_PREFIXES = ("language-", "lang-", "highlight-source-", "highlight-", "brush:")
LANGUAGE_ALIASES = {"python": "py", "javascript": "js", "typescript": "ts", "shell": "bash", "sh": "bash", "console": "bash", "yml": "yaml", "golang": "go", "rust": "rs"}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def walk(self) -> Iterator["Node"]:
        todo = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, Node):
                yield n
                todo.extend(reversed(n.children))

    def find(self, *tags: str) -> list["Node"]:
        return [n for n in self.walk() if n.tag in tags]

    def text(self, skip: frozenset[str] = frozenset({"script", "style"})) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in skip:
                todo.extend(reversed(n.children))
        return "".join(out)


class _Builder(HTMLParser):
    #: Elements that end when one of the listed ones starts.
    ENDS = {"p": frozenset("p div ul ol table h1 h2 h3 h4 h5 h6 pre blockquote section article".split()), "li": frozenset({"li"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"})}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        while len(self.stack) > 1 and tag in self.ENDS.get(self.stack[-1].tag, ()):
            self.stack.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def one_line(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def title_of(root: Node) -> str | None:
    for tag in ("title", "h1"):
        for n in root.find(tag):
            if t := one_line(n.text()):
                return t
    return None


def main_content(root: Node) -> Node:
    """The article, main element or body: the first kind that has text."""
    for tag in ("article", "main", "body"):
        found = [n for n in root.find(tag) if one_line(n.text())]
        if found:
            return max(found, key=lambda n: len(n.text()))
    return root


def gfm_table(rows: list[list[str]]) -> str:
    """Rows as a markdown table; the first row is the head, short rows are filled up."""
    rows = [[one_line(c or "").replace("|", "\\|") for c in r] for r in rows if any((c or "").strip() for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


def language(node: Node) -> str:
    """The language of a code block, from its classes or its parent's."""
    for c in node.attrs.get("class", "").split():
        for p in LANGUAGE_PREFIXES:
            if c.startswith(p):
                name = c[len(p) :].lower()
                return LANGUAGE_ALIASES.get(name, name)
    return ""


def code_blocks(root: Node) -> list[tuple[str, str]]:
    """(language, code) of every pre element of four characters or more, each once by its first 60 characters."""
    out, seen = [], set()
    for pre in root.find("pre"):
        code = pre.text(frozenset()).strip("\n")
        key = code.strip()[:60]
        if len(code.strip()) >= 4 and key not in seen:
            seen.add(key)
            inner = next((n for n in pre.walk() if n.tag == "code"), pre)
            out.append((language(inner) or language(pre), code))
    return out


def markdown(node: Node) -> str:
    """The blocks of a node as markdown."""
    blocks: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        if text := one_line("".join(buffer)):
            blocks.append(text)
        buffer.clear()

    def inline(n) -> str:
        if isinstance(n, str):
            return n
        if n.tag in CHROME:
            return ""
        if n.tag == "br":
            return " "
        inner = "".join(map(inline, n.children))
        if n.tag in ("b", "strong") and inner.strip():
            return f"**{inner.strip()}**"
        if n.tag in ("i", "em") and inner.strip():
            return f"*{inner.strip()}*"
        if n.tag == "code" and inner.strip():
            return f"`{inner.strip()}`"
        if n.tag == "a" and n.attrs.get("href") and inner.strip():
            return f"[{one_line(inner)}]({n.attrs['href']})"
        return inner

    def block(n) -> None:
        if isinstance(n, str):
            buffer.append(n)
        elif n.tag in CHROME or n.tag in ("head", "title"):
            return
        elif re.fullmatch(r"h[1-6]", n.tag):
            flush()
            if text := one_line("".join(map(inline, n.children))):
                blocks.append("#" * int(n.tag[1]) + " " + text)
        elif n.tag == "pre":
            flush()
            inner = next((x for x in n.walk() if x.tag == "code"), n)
            blocks.append(f"```{language(inner) or language(n)}\n" + n.text(frozenset()).strip("\n") + "\n```")
        elif n.tag in ("ul", "ol"):
            flush()
            items = [one_line("".join(map(inline, li.children))) for li in n.children if isinstance(li, Node) and li.tag == "li"]
            blocks.append("\n".join(f"{i}. {t}" if n.tag == "ol" else f"- {t}" for i, t in enumerate(filter(None, items), 1)))
        elif n.tag == "table":
            flush()
            rows = [[c.text() for c in tr.find("td", "th")] for tr in n.find("tr")]
            if table := gfm_table(rows):
                blocks.append(table)
        elif n.tag in ("a", "b", "strong", "i", "em", "code", "span", "br", "img", "sub", "sup", "small", "mark", "u"):
            if n.tag in ("b", "strong", "i", "em", "span") and n.find("p", "div", "table", "ul", "ol", "pre"):
                for c in n.children:
                    block(c)
            else:
                buffer.append(inline(n))
        else:
            flush()
            for c in n.children:
                block(c)
            flush()

    block(node)
    flush()
    return "\n\n".join(b for b in blocks if b.strip())


#: Elements of a streamed page state whose text is one, with that of their children.
STATE_BLOCKS = ("p", "li", "td", "th", "dt", "dd", "blockquote", "figcaption")


def next_state(html: str) -> list[tuple[str, str]]:
    """(kind, text) of what a streamed page state holds: headings, code and text of its elements, each once."""
    lines = []
    for m in re.finditer(r"self\.__next_f\.push\(\[1,\s*(\"(?:[^\"\\]|\\.)*\")\]\)", html):
        try:
            lines += json.loads(m[1]).split("\n")
        except ValueError:
            continue
    out, seen = [], set()

    def say(kind: str, text: str) -> None:
        text = text.strip()
        if (kind != "text" or len(text) >= 24) and text and not text.startswith("$") and (kind, text[:60]) not in seen:
            seen.add((kind, text[:60]))
            out.append((kind, text))

    def joined(x, depth: int) -> str:
        """The text of an element with all its children."""
        if depth > 30:
            return ""
        if isinstance(x, list) and len(x) >= 4 and x[0] == "$" and isinstance(x[1], str):
            return joined(x[3].get("children") if isinstance(x[3], dict) else None, depth + 1)
        if isinstance(x, list):
            return "".join(joined(v, depth + 1) for v in x)
        return x if isinstance(x, str) and not x.startswith("$") else ""

    def visit(x, kind: str, depth: int) -> None:
        if depth > 30:
            return
        if isinstance(x, list) and len(x) >= 4 and x[0] == "$" and isinstance(x[1], str):
            tag, props = x[1], x[3] if isinstance(x[3], dict) else {}
            sub = "heading" if re.fullmatch(r"h[1-6]", tag) else "code" if tag in ("pre", "code") else "text"
            if sub != "text" or tag in STATE_BLOCKS:
                say(sub, joined(props.get("children"), depth + 1))
            else:
                visit(props.get("children"), sub, depth + 1)
            if sub == "code":
                visit(props.get("code"), sub, depth + 1)
        elif isinstance(x, list):
            for v in x:
                visit(v, kind, depth + 1)
        elif isinstance(x, dict):
            for v in x.values():
                visit(v, kind, depth + 1)
        elif isinstance(x, str):
            say(kind, x)

    for line in lines:
        head, _, body = line.partition(":")
        if re.fullmatch(r"[0-9a-z]+", head or ""):
            try:
                visit(json.loads(body), "text", 0)
            except ValueError:
                continue
    return out


#: JSON keys whose values are HTML, and keys that hold a title, in order.
JSON_HTML, JSON_TITLE = ("html", "content", "body", "rendered", "description"), ("title", "name", "headline")


def json_markdown(text: str) -> tuple[str | None, str | None]:
    """A JSON body as markdown: its HTML fields, or else the whole, pretty, in a fence; and the first title found."""
    try:
        data = json.loads(text)
    except ValueError:
        return None, None
    if data in ({}, [], "", None):
        return None, None
    found, title = [], None
    todo = [data]
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            for k in JSON_TITLE:
                if title is None and isinstance(x.get(k), str) and x[k].strip():
                    title = x[k].strip()
            for k, v in x.items():
                if isinstance(v, str) and k.lower() in JSON_HTML and re.search(r"<[a-z][^>]*>", v, re.I):
                    found.append(markdown(parse(v)))
            todo = [v for v in x.values() if isinstance(v, dict | list)] + todo
        elif isinstance(x, list):
            todo = [v for v in x if isinstance(v, dict | list)] + todo
    return ("\n\n".join(filter(None, found)) or "```json\n" + json.dumps(data, indent=2, ensure_ascii=False) + "\n```"), title


@dataclass(frozen=True)
class Strategy:
    """A way of its own to read some bodies: matches(body, kind), and read(body) to (markdown or None, title or None)."""

    name: str
    matches: Callable[[str, str], bool]
    read: Callable[[str], tuple[str | None, str | None]]


#: An enricher: (markdown, body) to (markdown, how many things it put in). Enrichers run one after the other, before anchors and the hash.
Enricher = Callable[[str, str], tuple[str, int]]


def extract(body: str, kind: str, patterns: tuple = (), strategies: tuple[Strategy, ...] = (), enrichers: tuple[Enricher, ...] = ()) -> dict:
    """Body to anchored markdown and its content hash: ok, reason, title, md, anchors, version. The first strategy that matches reads it, or else the kind's own."""
    import hashlib

    out = {"ok": False, "reason": f"extract-failed-{kind}", "title": None, "md": None, "anchors": [], "content_hash": None, "version": f"{EXTRACTOR_VERSION}-{kind}"}
    try:
        own = next((s for s in strategies if s.matches(body or "", kind)), None)
        if own is not None:
            out["version"] = f"{EXTRACTOR_VERSION}-{own.name}"
            md, title = own.read(body or "")
        elif kind == "markdown":
            md = (body or "").strip() or None
            found = re.search(r"(?m)^#\s+(.+?)\s*$", md or "")
            title = found[1] if found else None
        elif kind == "json":
            md, title = json_markdown(body)
        elif kind == "pdf":
            md = title = None
        else:
            root = parse(body)
            md, title = markdown(main_content(root)) or None, title_of(root)
            if md:
                missing = [(lang, code) for lang, code in code_blocks(root) if code.strip()[:30] not in md]
                md += "".join(f"\n\n```{lang}\n{code}\n```" for lang, code in missing)
            state = next_state(body or "") if "__next_f" in (body or "") else []
            more = [{"heading": f"## {t}", "code": f"```\n{t}\n```"}.get(k, t) for k, t in state if not md or t[:30] not in md]
            md = "\n\n".join(filter(None, [md, *more])) or None
        for enrich in enrichers if md else ():
            md, _ = enrich(md, body or "")
    except Exception as e:  # a row that cannot be read is a failed row
        return out | {"reason": f"extract-error:{type(e).__name__}"}
    if md is None:
        return out
    md, anchors = anchored_text(md)
    digest = hashlib.sha256(normalize(md, patterns).encode()).hexdigest()
    return out | {"ok": True, "reason": f"new-content-{kind}", "title": title, "md": md, "anchors": anchors, "content_hash": digest}


EXTRACTED = "ok boolean, reason string, title string, md string, anchors array<string>, content_hash string, version string"


def extractor(patterns: tuple = (), strategies: tuple[Strategy, ...] = (), enrichers: tuple[Enricher, ...] = ()):
    """A pandas UDF (body, kind) -> EXTRACTED under a profile's boilerplate patterns, strategies and enrichers."""

    @F.pandas_udf(f"struct<{EXTRACTED.replace(' ', ':').replace(',:', ',')}>")
    def run(body: pd.Series, kind: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(b, k, patterns, strategies, enrichers) for b, k in zip(body, kind, strict=True)], columns=[x.split()[0] for x in EXTRACTED.split(", ")])

    return run


@vectorized("array<string>")
def links(html: pd.Series, base: pd.Series, hosts: pd.Series) -> pd.Series:
    """The links of a page on its allowed hosts (comma-separated; null: any), canonical, each once, sorted; none of what is no HTML."""

    def one(h, b, allowed):
        head = (h or "").lstrip("﻿ \t\r\n")
        if not head.startswith("<") and "<html" not in (h or "")[:4096].lower():
            return []
        found = [n.attrs.get("href", "") for n in parse(h).find("a")]
        return join_links(b, found, None if allowed is None else set(allowed.split(",")))

    return pd.Series([one(*x) for x in zip(html, base, hosts, strict=True)])


@vectorized("struct<headings:int,tables:int,lists:int,code_blocks:int,links:int,chars:int>")
def content_counts(html: pd.Series) -> pd.DataFrame:
    """Elements and text length of a page without its chrome."""

    def strip(n: Node) -> Node:
        for x in n.walk():
            x.children = [c for c in x.children if not (isinstance(c, Node) and c.tag in CHROME)]
        return n

    rows = []
    for h in html:
        root = strip(parse(h))
        rows.append((len(root.find("h1", "h2", "h3", "h4", "h5", "h6")), len(root.find("table")), len(root.find("ul", "ol")), len(root.find("pre")), sum("href" in a.attrs for a in root.find("a")), len(one_line(root.text()))))
    return pd.DataFrame(rows, columns=["headings", "tables", "lists", "code_blocks", "links", "chars"])
