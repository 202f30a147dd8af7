"""Operator 8: toxic passages as maximum-scoring segments of token log-odds.

A text is lower-cased (A-Z and the two-byte Latin letters) and split at white space and ASCII punctuation. The units of a
word are the word and its byte prefixes of 4 to 8 bytes (word stems). Units get log-odds between toxic and clean labelled texts
with an informative Dirichlet prior; a word scores by its unit with the surest log-odds, if that is significant, and
by the (negative) log-odds of a word without significant unit otherwise. A linear-time scan finds every maximal scoring segment of a text. Under chance the
best segment of n words follows an extreme-value law; its location and scale are fitted on clean labelled texts.
The negative log of the p-value of a text's best segment, the log of the sum of all its segments and their share of its words are
calibrated to a probability by a logistic fit on labelled rows that the log-odds have not seen. The passages returned are
the segments whose own p-value is at most 0.01.

Log-odds and calibration are fitted on at most ``fit_rows`` labelled ids, those with the least hash, and one row for
each: of rows that share an id, the one of the least text hash. Every significant unit of that sample is used.
Scoring runs over all rows and whole texts; a longer text is held to a higher best segment, as its chance grows with its
words. Of units with equal significance the shortest prefix counts. Null texts are empty: no segment, the lowest score. Rows are
independent: repeated rows and ids repeat their results. Without labels of both classes every text gets the same score. Other
columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._spark import Scratch, held_out, row_key, ship
from corpusloom.llm._text import ALNUM, U, Words, buffer, lower_latin, mix, pieces
from corpusloom.llm.quality import fit_sample

PREFIXES = (4, 5, 6, 7, 8)


def units(texts: pa.Array) -> tuple[Words, list[np.ndarray]]:
    """The words of each text, and for each word the hashes of its units (0: the word has no such prefix)."""
    buf, off = buffer(texts)
    w = Words(lower_latin(buf), off, ALNUM)
    if not len(w):
        return w, [np.zeros(0, U)] * (1 + len(PREFIXES))
    size, out = w.end - w.start, [w.hashes()]
    for k in PREFIXES:
        h = mix(w.loads(w.start, np.full(len(w), k)) + U(1000 + k))
        out.append(np.where(size >= k, h, U(0)))
    return w, out


def unit_counts(rows: DataFrame) -> DataFrame:
    """For each unit: its weight in the toxic and in the clean texts of (y, text).

    A unit that a text holds c times weighs log2(1 + c) there, so that a word repeated without end in one text does
    not pass for a common one.
    """

    def run(batches):
        parts: list[np.ndarray] = []

        def flush():
            u, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            y, weight = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            toxic, clean = np.bincount(inverse, y * weight, len(u)), np.bincount(inverse, (1 - y) * weight, len(u))
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(toxic), pa.array(clean)], ["unit", "toxic", "clean"])

        held = 0
        for b in pieces(batches):
            w, hashes = units(b.column(1))
            y, doc = b.column(0).to_numpy(zero_copy_only=False).astype(float), w.doc()
            for h in hashes:
                has = h != 0
                key, d = h[has], doc[has]
                order = np.argsort(key ^ mix(d.astype(U) + U(1)))
                key, d = key[order], d[order]
                first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (d[1:] != d[:-1])))[: len(key)])
                parts.append((key[first], y[d[first]], np.log2(1 + np.diff(np.append(first, len(key))))))
                held += len(first)
            if held > 2_000_000:
                held = 0
                yield flush()
        if parts:
            yield flush()

    return rows.select("y", "text").mapInArrow(run, "unit long, toxic double, clean double").groupBy("unit").agg(*(F.round(F.sum(x), 6).alias(x) for x in ("toxic", "clean")))


def lexicon(counts: DataFrame, n_toxic: int, n_clean: int, prior: float = 20.0, least_z: float = 3.0, least_odds: float = 1.5) -> list[tuple[int, float, float]]:
    """(unit, log-odds, z) of the surest units: log-odds with a Dirichlet prior in proportion to a unit's share of all texts."""
    share = (F.col("toxic") + F.col("clean")) / F.lit(float(n_toxic + n_clean))
    a = share * prior + 0.01
    odds = lambda y, n: F.log((F.col(y) + a) / F.lit(float(n + prior)))  # noqa: E731  weights a text, which may exceed 1
    rows = counts.withColumn("delta", odds("toxic", n_toxic) - odds("clean", n_clean)).withColumn("z", F.col("delta") / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a)))
    return [tuple(r) for r in rows.where((F.col("z") >= least_z) & (F.col("delta") >= least_odds) & (F.col("toxic") >= 3)).select("unit", "delta", "z").collect()]


def segments(positions: list[int], scores: list[float], neutral: float) -> list[tuple[float, int, int]]:
    """Every maximal scoring segment, as (score, first word, last word), of a sequence whose other words score neutral.

    One pass over the positive words with a stack of candidate segments, each with the sum before and after it.
    """
    stack: list[tuple[float, float, int, int]] = []  # (sum before, sum after, first, last)
    total, at = 0.0, -1
    for p, s in zip(positions, scores, strict=True):
        before = total + neutral * (p - at - 1)
        total, at = before + s, p
        cand = (before, total, p, p)
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= cand[0]:
                j -= 1
            if j < 0 or stack[j][1] >= cand[1]:
                break
            cand = (stack[j][0], cand[1], stack[j][2], cand[3])
            del stack[j:]
        stack.append(cand)
    return [(after - before, a, b) for before, after, a, b in stack]


@dataclass
class Model:
    unit: np.ndarray  # sorted
    delta: np.ndarray
    z: np.ndarray
    neutral: float
    scale: float = 1.0  # of the extreme-value law
    place: float = 0.0
    weight: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def passages(self, texts: pa.Array) -> list[list[tuple[float, int, int]]]:
        """The maximal scoring segments of each text."""
        w, hashes = units(texts)
        delta, best = np.zeros(len(w)), np.zeros(len(w))
        if len(self.unit):
            for h in hashes:
                key = h.view(np.int64)
                i = np.minimum(np.searchsorted(self.unit, key), len(self.unit) - 1)
                hit = (self.unit[i] == key) & (self.z[i] > best)
                best = np.where(hit, self.z[i], best)
                delta = np.where(hit, self.delta[i], delta)
        hits = np.flatnonzero(delta > 0)
        owner = np.searchsorted(w.first, hits, "right") - 1
        at = np.searchsorted(owner, np.arange(len(w.first)))
        out = []
        self.hits = np.diff(at)
        for d in range(len(w.first) - 1):
            some = hits[at[d] : at[d + 1]]
            out.append(segments((some - w.first[d]).tolist(), delta[some].tolist(), self.neutral) if len(some) else [])
        self.sizes = w.counts
        return out

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """(best segment, words, sum of segments) of each text."""
        found = self.passages(texts)
        return np.array([(max((s for s, _, _ in x), default=0.0), n, sum(s for s, _, _ in x)) for x, n in zip(found, self.sizes.tolist(), strict=True)]).reshape(-1, 3)

    def surprise(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """-log10 of the chance that n clean words hold a segment this good."""
        z = (best - self.place - self.scale * np.log(np.maximum(n, 1))) / self.scale
        p = -np.expm1(-np.exp(np.clip(-z, -700, 50)))
        return np.where(best > 0, -np.log10(np.maximum(p, 1e-300)), 0.0)

    def inputs(self, e: np.ndarray) -> np.ndarray:
        return np.stack([np.minimum(self.surprise(e[:, 0], e[:, 1]), 30) / 3, np.log1p(e[:, 2]), np.sqrt(e[:, 2] / np.maximum(e[:, 1], 1))], axis=1)

    def score(self, e: np.ndarray) -> np.ndarray:
        x = self.inputs(e)
        z = self.weight[0] + x @ np.array(self.weight[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 60) -> tuple[float, ...]:
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - penalty @ w
        w = w + np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, g)
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000) -> Model:
    """Fit on a bounded sample: log-odds on two thirds of it, the extreme-value law and the calibration on the rest."""
    spark = docs.sparkSession
    sample = docs.select("doc_id", "text").join(F.broadcast(fit_sample(labels, "toxic", fit_rows)), "doc_id")
    sample = sample.groupBy("doc_id", "y").agg(F.min(F.struct(row_key(F.col("text")).alias("th"), "text")).alias("r")).select("doc_id", "y", "r.text")
    scratch = Scratch(spark)
    kept = scratch.keep(sample.withColumn("part", F.abs(F.xxhash64("doc_id", F.lit(7))) % 3), "sample")
    first = kept.where("part < 2")
    sizes = {r["y"]: r["n"] for r in first.groupBy("y").agg(F.count("*").alias("n")).collect()}
    found = lexicon(unit_counts(first), sizes.get(1, 0), sizes.get(0, 0)) if sizes.get(1) and sizes.get(0) else []
    found.sort()
    model = Model(np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found]), np.array([x[2] for x in found]), -0.02)

    def run(batches):
        for b in pieces(batches):
            e = model.evidence(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), *(pa.array(np.ascontiguousarray(v, dtype=float)) for v in (*e.T, model.hits))], ["y", "best", "n", "total", "hits"])

    schema = "y int, best double, n double, total double, hits double"
    seen = {r["y"]: r for r in first.select("y", "text").mapInArrow(run, schema).groupBy("y").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect()}
    if len(seen) == 2 and found:
        rest = [max(1e-6, 1 - (seen[y]["hits"] + 0.5) / (seen[y]["n"] + 1)) for y in (1, 0)]
        model.neutral = min(-0.002, float(np.log(rest[0] / rest[1])))
    rows = kept.where("part = 2").select("y", "text").mapInArrow(run, schema).toPandas()
    y = rows["y"].to_numpy().astype(float)
    e = rows[["best", "n", "total"]].to_numpy()
    if len(y) and y.min() != y.max():
        order = np.lexsort((e[:, 2], e[:, 1], e[:, 0], y))
        y, e = y[order], e[order]
        clean = e[(y == 0) & (e[:, 1] > 0)]
        # Moments of the extreme-value law of best - scale * log n over clean texts; a scale of at least one log-odds.
        scale = 1.0
        for _ in range(5):
            scale = max(1.0, float(np.std(clean[:, 0] - scale * np.log(np.maximum(clean[:, 1], 1)))) * np.sqrt(6) / np.pi if len(clean) else 1.0)
            scale = min(scale, 10.0)
        model.scale = scale
        model.place = float(np.mean(clean[:, 0] - scale * np.log(np.maximum(clean[:, 1], 1)))) - 0.5772 * scale if len(clean) else 0.0
        model.weight = _logistic(model.inputs(e), y)
    else:
        share = float((y.sum() + 1) / (len(y) + 2))
        model.weight = (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0)
    scratch.drop(kept)
    return model


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: held_out, score, predicted, and its significant passages as (first word, last word, score)."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = train(docs, labels, fit_rows)

    def run(batches):
        for b in pieces(batches):
            found = model.passages(b.column(1))
            n = model.sizes
            e = np.array([(max((s for s, _, _ in x), default=0.0), m, sum(s for s, _, _ in x)) for x, m in zip(found, n.tolist(), strict=True)]).reshape(-1, 3)
            sure = [[{"first_word": a, "last_word": z, "score": s} for s, a, z in x if model.surprise(np.array([s]), np.array([m]))[0] >= 2] for x, m in zip(found, n.tolist(), strict=True)]
            kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(e)), pa.array(sure, kind)], ["doc_id", "score", "passages"])

    out = docs.mapInArrow(run, "doc_id long, score double, passages array<struct<first_word:long,last_word:long,score:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
