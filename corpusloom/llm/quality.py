"""Operator 3: a quality classifier that is a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Boosting visits the features in turn; at each visit a shallow tree over the
bins of one feature fits the logistic loss and is added to that feature's lookup table, so a table is a sum of
trees. Then the pairs of features with the largest gain on the residual get two-dimensional tables in the same way.
A document's score is the logistic function of the sum of its bins' entries.

The model is fitted on at most ``fit_rows`` labelled ids, those with the least hash, and one row for each: of rows that
share an id, the one of the least text hash. So the fit does not depend on how rows are dealt. Everything else
runs over all rows. Features come from the text alone and are shares and logarithms over the whole of it, however long; ties
between cuts go to the first. Null texts are empty; an empty text has features like any
other. Rows are independent: repeated rows and ids repeat their results. A label table without rows, or of one
class, gives every document the class's (smoothed) share as score. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._spark import Scratch, held_out, row_key, ship
from corpusloom.llm._text import NOT_SPACE, U, Words, buffer, mix, pieces

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "stop_comma", "symbol", "pipe", "bang", "space", "wide",
    "distinct", "top_share", "adjacent", "log_lines", "line_bytes", "line_distinct", "short_word", "long_word", "ends_symbol", "at_slash",
)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.float32)
    t[list(chars)] = 1
    return t


_CLASSES = np.stack(
    [_table(bytes(range(65, 91))), _table(b"0123456789"), _table(b".,;:"), _table(b"#$%&*^~_=+<>{}[]\\|!"), _table(b"|"), _table(b"!"), _table(b" \t\r\n\x0b\x0c"), _table(bytes(range(0xC2, 0x100))), _table(b"@/")]
)
_ODD = np.zeros(256, bool)
_ODD[list(b"#$%&*!|=~")] = True


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[off[1:]] - total[off[:-1]]


def _runs(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: its distinct values, and the largest count of one."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.argsort(h ^ mix(doc.astype(U) + U(1)), kind="stable")
    a, d = h[order], doc[order]
    at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]))))
    count = np.diff(np.append(at, len(a)))
    top = np.zeros(n)
    np.maximum.at(top, d[at], count)
    return np.bincount(d[at], minlength=n).astype(float), top


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    buf, off = buffer(texts)
    n, size = len(off) - 1, np.diff(off).astype(float)
    w = Words(buf, off, NOT_SPACE)
    words, h, doc = w.counts.astype(float), w.hashes(), w.doc()
    length = (w.end - w.start).astype(float)
    share = np.stack([_sums(t[buf], off) for t in _CLASSES]) / np.maximum(size, 1)
    distinct, top = _runs(h, doc, n)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    not_break = np.ones(256, bool)
    not_break[10] = False
    lines = Words(buf, off, not_break)
    n_lines = lines.counts.astype(float)
    line_distinct, _ = _runs(lines.hashes(), lines.doc(), n)
    per = lambda v: _sums(v, w.first) / np.maximum(words, 1)
    last = buf[np.maximum(w.end - 1, 0)] if len(h) else np.zeros(0, np.uint8)
    return np.stack(
        [
            np.log1p(size), np.log1p(words), per(length), *share[:8],
            distinct / np.maximum(words, 1), top / np.maximum(words, 1), per(same), np.log1p(n_lines), size / np.maximum(n_lines, 1),
            line_distinct / np.maximum(n_lines, 1), per(length <= 2), per(length >= 16), per(_ODD[last]), share[8],
        ],
        axis=1,
    ).astype(np.float32)


@dataclass
class Gam:
    """Cut points and lookup tables; pairs holds (i, j, table)."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    main: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for i, t in enumerate(self.main):
            z += t[b[:, i]]
        for i, j, t in self.pairs:
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, least: float = 2.0) -> tuple[float, int]:
    """The best cut of a row of bins: gain, and the first bin to the right."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < least) | (hr < least)] = 0
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The values of a shallow tree over the bins."""
    gain, k = _split(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray, least: float = 2.0) -> tuple[float, np.ndarray]:
    """A tree over two features: the cut of the first, with a cut of the second on each side, that gains most together."""
    if min(g.shape) < 2:
        return 0.0, np.full(g.shape, _leaf(g.sum(), h.sum()))
    sides = []
    for left in (True, False):
        gs, hs = np.cumsum(g, 0)[:-1], np.cumsum(h, 0)[:-1]
        if not left:
            gs, hs = g.sum(0) - gs, h.sum(0) - hs
        gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
        gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
        value = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1)
        value[(hl < least) | (ht - hl < least)] = 0
        sides.append((value.max(1), value.argmax(1) + 1))
    gain = sides[0][0] + sides[1][0]
    k = int(gain.argmax())
    out = np.zeros_like(g)
    for rows, (_, cuts) in zip((slice(0, k + 1), slice(k + 1, None)), sides, strict=True):
        for cols in (slice(0, cuts[k]), slice(cuts[k], None)):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return float(gain[k] - g.sum() ** 2 / (h.sum() + 1)), out


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 24, rounds: int = 120, n_pairs: int = 8, rate: float = 0.15) -> Gam:
    """Cyclic boosting of main effects, then of the strongest pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(share / (1 - share))))
    if len(y) < 10 or y.min() == y.max():
        return model
    model.cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, n_bins + 1)[1:-1])) for i in range(x.shape[1])]
    b = model.bins(x)
    size = [len(c) + 1 for c in model.cuts]
    model.main = [np.zeros(s) for s in size]
    z = np.full(len(y), model.intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i, table in enumerate(model.main):
            g, h = slope()
            step = rate * _tree(np.bincount(b[:, i], g, size[i]), np.bincount(b[:, i], h, size[i]))
            table += step
            z += step[b[:, i]]
    g, h = slope()
    grid = lambda i, j, v: np.bincount(b[:, i] * size[j] + b[:, j], v, size[i] * size[j]).reshape(size[i], size[j])
    ranked = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(len(size)) for j in range(i)), reverse=True)[:n_pairs]
    model.pairs = [(i, j, np.zeros((size[i], size[j]))) for _, i, j in ranked]
    for _ in range(rounds // 4):
        for i, j, table in model.pairs:
            g, h = slope()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += step
            z += step[b[:, i], b[:, j]]
    return model


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the hash and the features of every text."""

    def run(batches):
        for b in pieces(batches):
            f = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), f.shape[1]).cast(pa.list_(pa.float32()))], ["doc_id", "th", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("th"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, th long, x array<float>")


def fit_sample(labels: DataFrame, label: str, fit_rows: int) -> DataFrame:
    """At most fit_rows labelled ids outside the held-out fifth, those of least hash; one row per id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)


def train(table: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = 20_000) -> Gam:
    """Fit on the bounded sample; its rows and features are what the driver holds."""
    rows = table.join(F.broadcast(fit_sample(labels, label, fit_rows)), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("th", "x")).alias("r")).select("doc_id", "y", "r.x").toPandas()
    if not len(rows):
        return Gam(0.0)
    rows = rows.sort_values("doc_id", kind="stable")
    return fit(np.stack(rows["x"].to_numpy()).astype(np.float32), rows["y"].to_numpy().astype(float))


def score_table(table: DataFrame, model: Gam) -> DataFrame:
    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return table.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: held_out, score, predicted."""
    spark = ship(docs.sparkSession)
    table = Scratch(spark).keep(feature_table(docs, id_col, text_col), "features")
    out = score_table(table, train(table, labels, fit_rows=fit_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts, all columns; each row is scored on its own text."""
    ship(docs.sparkSession)
    sample = fit_sample(labels, "quality", fit_rows).select("doc_id")
    model = train(feature_table(docs.join(F.broadcast(sample), "doc_id", "left_semi")), labels, fit_rows=fit_rows)

    def run(batches):
        for b in pieces(batches, "text"):
            yield b.filter(pa.array(model.score(features(b.column(b.schema.get_field_index("text")))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
