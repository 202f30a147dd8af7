"""Operator 7: benchmark decontamination by BM25 over an inverted index of the test items, with block-max WAND.

The test items are the indexed side; every passage of every training text is a query. A passage is a window of
``2 * s`` words every ``s`` words, s being the longest item's length (``least_stride`` at least), so an item that stands in a text whole stands in
one passage whole. An item's BM25 score for a passage is divided by its score for its own text; all items at
``threshold`` or above are retrieved. Document frequencies, the number of items, their mean and greatest length are taken once over all
items. Postings are sorted by item and cut into blocks of items; the largest contribution of each
term overall and in each block bounds what an item can reach. Passages whose bound over all terms, or in every block, is below the
threshold are left out together. For the rest block-max WAND keeps a cursor in the posting list of each term of a passage, in the
order of the items that they stand at. The pivot is the item at which the largest contributions of the terms up to there
reach the threshold; if the block bounds of the pivot's block reach it too, the items of that block are scored in full; either way
the cursors skip to the end of the block, over whatever lies before. Many passages take such steps at once. All
bounds are upper bounds: nothing at the threshold is lost.

A retrieved pair is verified: of the item's question (its first two thirds) and of its answer (the rest), each, at
least ``overlap`` of the runs of three words must occur in the passage. One changed word takes up to three runs, so a part
of three words to nine (under eight runs) also passes if it stands in the passage with one word replaced, left out or put in.

Words are runs of digits, letters (A-Z and the capitals U+00C0 to U+00DE in lower case) and characters beyond ASCII. Postings are dealt to
shards of about ``shard_items`` items by a hash; shards change no score. As many shards as have at most ``pass_bytes`` together
are broadcast and meet the texts in one scan; more of them take further scans. The driver builds one shard at a time.
Null texts and items have no words and no hits; a text of any length is all its passages. Rows of documents are independent: repeated
rows and ids repeat their results; null ids are carried through. Equal rows of the benchmark are one item; of passages with equal scores
the first counts. Other columns are ignored. Empty tables give an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._spark import Scratch, ship
from corpusloom.llm._text import ALNUM, U, Words, buffer, lower_latin, pieces, rolling

K1, B, BLOCK, GRAM, SHORT = 1.2, 0.75, 8, 3, 9
#: Rounding that bounds allow for; how many (passage, block) sums are held at once.
SLACK, CELLS = 1e-6, 1 << 20


def words(texts: pa.Array) -> Words:
    buf, off = buffer(texts)
    return Words(lower_latin(buf), off, ALNUM)


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """The distinct runs of n words; of all words, if there are fewer."""
    return np.unique(rolling(h, min(n, len(h)))) if len(h) else np.zeros(0, U)


def _one_edit(part: np.ndarray, text: np.ndarray) -> bool:
    """Whether part stands in text with at most one word replaced, left out or put in."""
    n, m = len(part), len(text)
    head, tail = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)  # words of part that match from a place on, and up to it
    for k in range(n):
        head[:-1] = np.where(text == part[n - 1 - k], 1 + head[1:], 0)
        head[-1] = 0
        tail[1:] = np.where(text == part[k], 1 + tail[:-1], 0)
        tail[0] = 0
    return any(bool((head[: m + 1 - size] + tail[size:] >= least).any()) for size, least in ((n, n - 1), (n - 1, n - 1), (n + 1, n)) if size <= m)


@dataclass
class Statistics:
    """Over all items: their number, mean and greatest number of words; the terms (sorted hashes) and in how many items each stands."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many each, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Index:
    """The inverted index of (id, text) items. Contributions are shares of an item's score for its own text.

    Without statistics, the items are all there are.
    """

    def __init__(self, ids: list, texts: list[str | None], least_stride: int = 48, stats: Statistics | None = None):
        w = words(pa.array(texts, pa.string()))
        h, size = w.hashes(), w.counts
        self.ids, self.n = ids, len(ids)
        self.words = [h[w.first[i] : w.first[i + 1]] for i in range(self.n)]
        self.parts = []
        for x in self.words:
            cut = max(1, -(-2 * len(x) // 3)) if len(x) else 0
            self.parts.append([(min(GRAM, len(y)), _runs(y, GRAM), y) for y in (x[:cut], x[cut:])])
        self.terms, term = np.unique(h, return_inverse=True)
        key, tf = np.unique(term.astype(np.int64) * max(self.n, 1) + w.doc(), return_counts=True)
        t, item = key // max(self.n, 1), key % max(self.n, 1)
        if stats is None:
            stats = Statistics(self.n, float(size.mean()) if self.n else 1.0, int(size.max(initial=0)), self.terms, np.bincount(t, minlength=len(self.terms)))
        self.stride = max(least_stride, stats.longest)
        df = stats.df[np.searchsorted(stats.terms, self.terms)]
        idf = np.log(1 + (stats.n - df + 0.5) / (df + 0.5))
        score = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / max(stats.mean, 1)))
        own = np.bincount(item, score, self.n)
        self.share = score / own[item] if len(score) else score
        self.item, self.key = item, key  # sorted by term, then item
        self.end = np.searchsorted(t, np.arange(len(self.terms)), "right")
        self.start = np.searchsorted(t, np.arange(len(self.terms)))
        self.most = np.zeros(len(self.terms))
        np.maximum.at(self.most, t, self.share)
        self.blocks = -(-self.n // BLOCK)
        block = t * self.blocks + item // BLOCK
        self.block_key, at = np.unique(block, return_index=True)
        self.block_most = np.maximum.reduceat(self.share, at) if len(at) else np.zeros(0)
        self.block_start = np.searchsorted(self.block_key, np.arange(len(self.terms)) * self.blocks)
        self.block_end = np.searchsorted(self.block_key, (np.arange(len(self.terms)) + 1) * self.blocks)

    @property
    def nbytes(self) -> int:
        arrays = (self.terms, self.item, self.key, self.share, self.start, self.end, self.most, self.block_key, self.block_most, self.block_start, self.block_end)
        return sum(x.nbytes for x in arrays) + sum(3 * x.nbytes + 400 for x in self.words)

    def in_reach(self, query: np.ndarray, term: np.ndarray, n: int, threshold: float) -> np.ndarray:
        """For each of n queries, given as (query, term) pairs sorted by query, whether the block bounds of its terms reach the threshold in any block."""
        out = np.zeros(n, bool)
        step = max(1, CELLS // max(self.blocks, 1))
        for lo in range(0, n, step):
            i, j = np.searchsorted(query, [lo, lo + step])
            t = term[i:j]
            size = self.block_end[t] - self.block_start[t]
            at = _spread(self.block_start[t], size)
            cell = np.repeat((query[i:j] - lo) * self.blocks - t * self.blocks, size) + self.block_key[at]
            bound = np.bincount(cell, self.block_most[at], step * self.blocks)
            out[lo : lo + step] = (bound.reshape(step, self.blocks).max(1) >= threshold - SLACK)[: n - lo]
        return out

    def wand(self, term: np.ndarray, start: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, share) of every item that reaches the threshold for its query, by query and item; query i has the terms, all
        distinct, from start[i] on.
        """
        n = len(start)
        query = np.repeat(np.arange(n), np.diff(np.append(start, len(term))))
        cursor, found = self.start[term], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        while len(query):
            at = self.item[cursor]
            order = np.lexsort((at, query))
            query, term, cursor, at = query[order], term[order], cursor[order], at[order]
            # The pivot of a query: where the sum of the largest contributions, in the order of the cursors, reaches the threshold.
            new = np.concatenate(([True], query[1:] != query[:-1]))
            total = np.cumsum(self.most[term])
            before = (total - self.most[term])[new]
            reach = np.flatnonzero(total - np.repeat(before, np.diff(np.append(np.flatnonzero(new), len(query)))) >= threshold - SLACK)
            some, first = np.unique(query[reach], return_index=True)
            pivot = np.full(n, -1)
            pivot[some] = at[reach[first]] // BLOCK
            live = pivot[query] >= 0  # a query without a pivot is done
            query, term, cursor, at = query[live], term[live], cursor[live], at[live]
            block = pivot[query]
            near = np.flatnonzero(at // BLOCK <= block)
            key = term[near] * self.blocks + block[near]
            i = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            held = self.block_key[i] == key
            bound = np.bincount(query[near][held], self.block_most[i[held]], n)
            full = near[held][bound[query[near[held]]] >= threshold - SLACK]
            if len(full):
                base = term[full] * self.n + block[full] * BLOCK
                lo = np.searchsorted(self.key, base)
                size = np.minimum(np.searchsorted(self.key, base + BLOCK), self.end[term[full]]) - lo
                where = _spread(lo, size)
                rows, row = np.unique(query[full], return_inverse=True)
                score = np.bincount(np.repeat(row, size) * BLOCK + self.item[where] % BLOCK, self.share[where], len(rows) * BLOCK)
                good = np.flatnonzero(score >= threshold)
                q = rows[good // BLOCK]
                found.append((q, pivot[q] * BLOCK + good % BLOCK, score[good]))
            # All cursors up to the block skip to its end.
            cursor[near] = np.minimum(np.searchsorted(self.key, term[near] * self.n + np.minimum((block[near] + 1) * BLOCK, self.n)), self.end[term[near]])
            live = cursor < self.end[term]
            query, term, cursor = query[live], term[live], cursor[live]
        query, item, share = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((item, query))
        return query[order], item[order], share[order]

    def hits(self, texts: pa.Array, threshold: float, overlap: float) -> list[tuple[int, int, int, float, float, float]]:
        """(text, item, first word of the passage, share, question overlap, answer overlap) of the verified pairs, best passage each."""
        if not len(self.terms):
            return []
        w = words(texts)
        h = w.hashes()
        term = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[term] == h)
        if not len(known):
            return []
        # Passages by text: number 0 starts at word 0, number i at i strides; the last one may be short.
        count = np.maximum(1, -(-w.counts // self.stride) - 1)
        base = np.concatenate(([0], np.cumsum(count)))
        doc = np.searchsorted(w.first, known, "right") - 1
        number = (known - w.first[doc]) // self.stride
        later, earlier = number < count[doc], number > 0
        passage = np.concatenate([(base[doc] + number)[later], (base[doc] + number - 1)[earlier]])
        pair = np.unique(passage * len(self.terms) + np.concatenate([term[known][later], term[known][earlier]]))
        passage, term = pair // len(self.terms), pair % len(self.terms)
        bound = np.bincount(passage, self.most[term], int(base[-1]))
        live = bound[passage] >= threshold - SLACK
        passage, term = passage[live], term[live]
        if not len(passage):
            return []
        _, query = np.unique(passage, return_inverse=True)
        live = self.in_reach(query, term, int(query[-1]) + 1, threshold)[query]
        passage, term = passage[live], term[live]
        if not len(passage):
            return []
        start = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        best: dict[tuple[int, int], tuple] = {}
        runs: dict[tuple[int, int], np.ndarray] = {}
        for q, item, share in zip(*(x.tolist() for x in self.wand(term, start, threshold)), strict=True):
            p = int(passage[start[q]])
            d = int(np.searchsorted(base, p, "right") - 1)
            at = (p - int(base[d])) * self.stride
            shares, held = [], True
            span = h[w.first[d] + at : min(w.first[d] + at + 2 * self.stride, w.first[d + 1])]
            for n, part, whole in self.parts[item]:
                if n and (p, n) not in runs:
                    runs[p, n] = _runs(span, n)
                shares.append(float(np.isin(part, runs[p, n]).mean()) if len(part) else 1.0)
                held = held and (shares[-1] >= overlap or (GRAM <= len(whole) <= SHORT and _one_edit(whole, span)))
            if held and best.get((d, item), (-1, -1.0))[1] < share:
                best[d, item] = (at, share, *shares)
        return sorted((d, item, *v) for (d, item), v in best.items())


def statistics(items: DataFrame, scratch: Scratch) -> tuple[int, float, int, DataFrame]:
    """The number, mean and greatest length of the items (shard, i, t), and a table of shard, term and df of every term of a shard."""

    def run(batches):
        for b in pieces(batches, "t"):
            w = words(b.column("t"))
            order = np.lexsort((h := w.hashes(), doc := w.doc()))
            h, doc = h[order], doc[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))[: len(h)]
            size = pa.array(w.counts.astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("shard"), size, pa.ListArray.from_arrays(np.searchsorted(doc[new], np.arange(b.num_rows + 1)).astype(np.int32), pa.array(h[new].view(np.int64)))], ["shard", "size", "terms"])

    rows = scratch.keep(items.select("shard", "t").mapInArrow(run, "shard int, size long, terms array<long>"), "terms")
    n, total, longest = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    terms = rows.select("shard", F.explode("terms").alias("term")).groupBy("shard", "term").agg(F.count("*").alias("here"))
    df = terms.groupBy("term").agg(F.sum("here").alias("df"))
    return n, total / max(n, 1), longest, scratch.keep(terms.join(df, "term").select("shard", "term", "df"), "frequencies")


def passes(items: DataFrame, shard_items: int, pass_bytes: int, id_col: str = "item_id", text_col: str = "text"):
    """Lists of broadcast indexes, each list of at most pass_bytes (or of one index)."""
    spark = ship(items.sparkSession)
    scratch = Scratch(spark)
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).distinct()
    rows = scratch.keep(rows, "items")
    n_shards = max(1, -(-rows.count() // shard_items))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(n_shards)).cast("int"))
    if n_shards > 1:  # a single shard has all items, and so the statistics, itself
        n, mean, longest, frequencies = statistics(rows, scratch)
    group, size = [], 0
    for k in range(n_shards):
        part = sorted(((r["i"], r["t"]) for r in rows.where(F.col("shard") == k).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if not part:
            continue
        stats = None
        if n_shards > 1:
            known = frequencies.where(F.col("shard") == k).select("term", "df").toArrow()
            term, df = known["term"].to_numpy().view(U), known["df"].to_numpy()
            order = np.argsort(term)
            stats = Statistics(n, mean, longest, term[order], df[order])
        index = Index([i for i, _ in part], [t for _, t in part], stats=stats)
        if group and size + index.nbytes > pass_bytes:
            yield group
            group, size = [], 0
        group.append(spark.sparkContext.broadcast(index))
        size += index.nbytes
    if group:
        yield group


_HITS = "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double"
_NAMES = ["doc_id", "item_id", "first_word", "score", "question_overlap", "answer_overlap"]


def search(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.6, shard_items: int = 50_000, pass_bytes: int = 1 << 28, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text and item that it contains: the best passage's place, share and overlaps."""
    spark = ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def over(group):
        def run(batches):
            for b in pieces(batches):
                for held in group:
                    found = held.value.hits(b.column(1), threshold, overlap)
                    cols = list(zip(*found, strict=True)) if found else [()] * 6
                    ids = [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array([held.value.ids[i] for i in cols[1]], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(cols[2], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[3:])], _NAMES)

        return docs.mapInArrow(run, _HITS)

    parts = [over(x) for x in passes(items, shard_items, pass_bytes)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], _HITS)


def drop(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.6, shard_items: int = 50_000, pass_bytes: int = 1 << 28) -> DataFrame:
    """The documents that contain no test item, all columns; each row is judged by its own text."""
    for group in passes(items, shard_items, pass_bytes):

        def run(batches, group=group):
            for b in pieces(batches, "text"):
                clean = np.ones(b.num_rows, bool)
                for held in group:
                    clean[[x[0] for x in held.value.hits(b.column("text"), threshold, overlap)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
