"""Operator 1: secret scans with a guess-cost dynamic programme over credential values.

Base spans are three patterns over the whole text. The method adds ``guess`` spans: every value in a credential
context (an assignment to a credential name, a bearer header, a password inside a URL) is segmented at least cost
into dictionary words, dates, repeats, keyboard walks and brute-force spans; values that need at least
10**min_log10 guesses are reported. Base spans always stay.

The costs, in log10 guesses: a segment after the first one costs ``SEGMENT``; a word its rank, more for capitals and replaced letters;
a date its year and day; a unit of at most ``UNIT`` characters that is repeated (twice or more; one character three times or
more) its brute-force cost and the number of times; a walk of four keys or more along rows, columns or the alphabet
its start, its length and each turn; any span its characters by brute force. The programme finds the least sum over
all segmentations in linear time: spans of bounded length are tried from every start, and the best start of a repeat or a
walk, whose cost grows with the logarithm of its length, is the top of a stack of starts that are still to be overtaken.

The dictionary is a fixed list of frequent passwords and the ``dictionary`` words that occur in most documents (five at least), by rank; they
are counted over all documents and are all that the driver holds.

Null texts are empty and have no spans. Rows are independent: repeated rows and ids repeat their results; columns
other than the id and the text are ignored. Texts and values of any length are scanned whole; of segmentations of equal
cost the one of the first kind in alphabetical order is reported. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._spark import ship
from corpusloom.llm._text import ALNUM, U, Words, buffer, mix, pieces

KINDS = ("assign", "access", "hex", "guess")
_I = re.IGNORECASE | re.ASCII
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _I)
#: Whole runs: a run of fewer characters holds no run of more.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|private_?key|credential|client_?secret|auth(?:orization)?)["']?\x20*[:=]\x20*(?:bearer\x20+|basic\x20+)?["']?([^\s"',;<>{}]+)|bearer\x20+([A-Za-z0-9+/_.=-]+)|://[^\s:/@]+:([^\s:/@]+)@""",
    _I,
)
#: A cheap test that every context needs.
_HINT = re.compile(r"[:=]|bearer", _I)

#: Frequent passwords and words, most frequent first; the rank is the guess count.
WORDS = (
    "password 123456 qwerty letmein admin welcome login abc123 monkey dragon master shadow football iloveyou sunshine princess secret "
    "token test guest root user changeme default pass hello love summer winter spring autumn monday friday example sample demo dummy "
    "placeholder your my the and for key api access private public server database db mysql postgres oracle prod dev staging company "
    "office home computer internet system service account super trust no one god jesus michael jordan batman superman star wars hunter "
    "ranger buster soccer hockey killer george charlie andrew michelle jessica pepper daniel thomas robert ginger freedom whatever "
    "cheese coffee orange purple yellow silver golden diamond flower cookie chocolate banana apple lemon tiger lion eagle falcon wolf"
).split()
#: Rows and columns of a keyboard, and the alphabet.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ("1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm", "8ik,", "9ol.", "0p;/")
#: The direction of a step from one key to the next.
STEP: dict[tuple[str, str], str] = {}
for _lines, _there, _back in ((ROWS, "right", "left"), (COLUMNS, "down", "up")):
    for _line in _lines:
        for _a, _b in zip(_line, _line[1:]):
            STEP.setdefault((_a, _b), _there)
            STEP.setdefault((_b, _a), _back)
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
_LEET = str.maketrans("4301$5@7", "aeoissat")
#: log10 costs: one more segment; the year and day of a date; the start and a turn of a walk.
SEGMENT, YEAR, DAY, WALK, TURN = math.log10(2.0), math.log10(120), math.log10(365), math.log10(47 * 4), 1.0
#: The longest repeated unit; the fewest keys of a walk.
UNIT, KEYS = 8, 4
#: Lengths of a word of the dictionary that is counted.
SHORTEST, LONGEST = 4, 24


class Ranks:
    """The rank of each word, 2 for the first."""

    def __init__(self, more=()):
        self.rank = {w: i + 2 for i, w in enumerate(dict.fromkeys([*WORDS, *more]))}
        self.longest = max(map(len, self.rank))


FIXED = Ranks()


class Starts:
    """Starts of spans that go on, each with a cost; the span's cost grows by the logarithm of its length.

    Of two starts the earlier one grows more slowly, so it overtakes the later one once and for all, unless the later one never
    costs more. The stack holds starts in the order in which they are overtaken: the top is the best one now.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[float, int, float]] = []  # cost, start, the end at which the start below overtakes

    def add(self, cost: float, start: int) -> None:
        stack, at = self.stack, math.inf
        while stack:
            below, first, until = stack[-1]
            if cost > below:
                at = start + (start - first) / math.expm1(min((cost - below) * math.log(10), 700.0))
                if at < until:
                    break
                at = math.inf
            stack.pop()
        stack.append((cost, start, at))

    def best(self, end: int) -> tuple[float, int]:
        while self.stack[-1][2] <= end:
            self.stack.pop()
        cost, start, _ = self.stack[-1]
        return cost + math.log10(end - start), start


def _space(c: str) -> float:
    """log10 of the size of the alphabet that a brute-force guesser needs for this character."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33) if c.isascii() else 2.0


def guess_cost(value: str, ranks: Ranks = FIXED) -> tuple[float, list[tuple[str, int, int]]]:
    """The least log10 number of guesses over all segmentations, and that segmentation as (kind, start, end)."""
    n = len(value)
    if not n:
        return 0.0, []
    low = value.lower()
    if len(low) != n:
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in value)
    leet = low.translate(_LEET)
    shapes = (low,) if leet == low else (low, leet)
    best, back = [0.0] + [math.inf] * n, [("", 0)] * (n + 1)
    after = lambda i: best[i] + SEGMENT * (i > 0)  # noqa: E731  the cost up to a segment that starts at i
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if low[i].isdigit():
            for size in (4, 8, 10):
                if i + size <= n and _DATE.fullmatch(low, i, i + size):
                    dates.setdefault(i + size, []).append(i)
    chars = [0.0]  # the brute-force cost of the first i characters
    for c in value:
        chars.append(chars[-1] + _space(c))
    brute, brute_at = math.inf, 0  # the cost so far of a brute-force span that ends here
    run = [0] * (UNIT + 1)  # how many characters up to here equal the one so many before
    repeats = [[Starts() for _ in range(m)] for m in range(UNIT + 1)]  # by unit length and place modulo it
    walk, walk_at = Starts(), 0
    turns = [0] * (n + 1)  # turns up to each character of the walk that goes on
    step = None
    for j in range(1, n + 1):
        opened = after(j - 1)
        if opened <= brute:
            brute, brute_at = opened, j - 1
        brute += chars[j] - chars[j - 1]
        options = [(brute, "brute", brute_at)]
        for m in range(1, min(UNIT, j - 1) + 1):
            if value[j - 1] != value[j - 1 - m]:
                if run[m]:
                    run[m] = 0
                    repeats[m] = [Starts() for _ in range(m)]
                continue
            run[m] += 1
            least = 3 if m == 1 else 2
            if run[m] >= (least - 1) * m:
                starts, i = repeats[m][j % m], j - least * m
                starts.add(after(i), i)
                cost, i = starts.best(j)
                options.append((cost - math.log10(m) + chars[j] - chars[j - m], "repeat", i))
        before, step = step, STEP.get((low[j - 2], low[j - 1])) if j > 1 else None
        if step is None:
            walk, walk_at = Starts(), j - 1
        else:
            turns[j - 1] = turns[j - 2] + (before is not None and before != step)
        if j - KEYS >= walk_at:
            i = j - KEYS
            walk.add(after(i) + WALK - TURN * turns[i + 1], i)
            cost, i = walk.best(j)
            options.append((cost + TURN * turns[j - 1], "walk", i))
        for start in range(max(0, j - ranks.longest), j - 1):
            for shape in shapes:
                rank = ranks.rank.get(shape[start:j])
                if rank:
                    upper = sum(x.isupper() for x in value[start:j])
                    extra = math.log10(2) * (upper > 0) + math.log10(j - start) * (1 < upper < j - start) + math.log10(2) * (shape is leet and leet[start:j] != low[start:j])
                    options.append((after(start) + math.log10(rank) + extra, "word", start))
        for start in dates.get(j, ()):
            options.append((after(start) + YEAR + (DAY if j - start > 4 else 0), "date", start))
        best[j], kind, start = min(options)
        back[j] = (kind, start)
    out, j = [], n
    while j:
        kind, start = back[j]
        out.append((kind, start, j))
        j = start
    return best[n], out[::-1]


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end) of the base spans, by start and kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str, min_log10: float, ranks: Ranks = FIXED) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, log10 guesses) of credential values that are hard to guess."""
    out = []
    if _HINT.search(text):
        for m in CONTEXT.finditer(text):
            k = m.lastindex
            cost, _ = guess_cost(m[k], ranks)
            if cost >= min_log10:
                out.append((m.start(k), 3, m.end(k), cost))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def vocabulary(docs: DataFrame, dictionary: int, least_docs: int = 5) -> list[str]:
    """The words of letters a-z (in lower case, no digit beside them) that stand in most texts and in least_docs or more, most frequent first; of equals the first in the alphabet."""

    def run(batches):
        seen: dict[bytes, int] = {}
        for b in pieces(batches):
            w = Words(*buffer(b.column("text")), ALNUM, lower=True)
            size = w.end - w.start
            other = np.concatenate(([0], np.cumsum((w.buf < 0x61) | (w.buf > 0x7A))))
            some = np.flatnonzero((size >= SHORTEST) & (size <= LONGEST) & (other[w.end] == other[w.start]))
            h, doc = w.hashes()[some], w.doc()[some]
            _, first = np.unique(mix(h ^ mix(doc.astype(U) + U(1))), return_index=True)  # once a text
            _, at, n = np.unique(h[first], return_index=True, return_counts=True)
            raw = w.buf.tobytes()
            for i, k in zip(some[first[at]].tolist(), n.tolist(), strict=True):
                word = raw[w.start[i] : w.end[i]]
                seen[word] = seen.get(word, 0) + k
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
                seen = {}
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs)
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(dictionary).collect()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10: float = 10.0, dictionary: int = 30_000) -> DataFrame:
    """One row per document with its spans: array of (kind, start, end, log10_guesses) by start, then kind; base spans have no guesses."""
    spark = ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = spark.sparkContext.broadcast(Ranks(vocabulary(docs, dictionary)))

    def run(batches):
        ranks = held.value
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                spans = sorted([(*x, None) for x in base_spans(text)] + guess_spans(text, min_log10, ranks), key=lambda x: x[:3])
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "log10_guesses": g} for s, k, e, g in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())])))], ["doc_id", "spans"])

    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,log10_guesses:double>>")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, all spans as text, and the hardest value's log10 guesses."""
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return scanned.select(
        "doc_id",
        *(n(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        n("guess").alias("n_guess"),
        F.array_max(F.transform("spans", lambda s: s["log10_guesses"])).alias("max_log10_guesses"),
    )

