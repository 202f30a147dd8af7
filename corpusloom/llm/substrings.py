"""Operator 2: substring deduplication with a count-min prefilter.

A window is ``size`` consecutive words of one document. A word goes if a window covers it whose word sequence also
starts in a document with a smaller id; windows are judged on the input.

Pass 1 sketches windows by their anchors. The anchor of a window is the smallest hash among its runs of ``size // 2``
words (the last of equals), so equal windows have equal anchors, and neighbouring windows mostly share one. Every
partition builds a count-min sketch of its anchors, a document counting once for each; partition sketches merge by
addition, block by block. A window's count, the documents that hold it, is at most its anchor's, which is at most the
smallest of the anchor's cells: the estimate never falls short. Only a bit a cell (two documents or more) leaves the
merge. The sketch has about eight cells for each anchor of the input, at any size. It stays a table of blocks, and the
anchors meet their blocks in a join, row by row of the sketch, so nothing is broadcast or held by the driver, and a frequent
anchor is split like any skewed key.

Pass 2 looks only at windows estimated repeated, and loses none of them. The windows of one occurrence of an anchor
form a segment. Equal segments meet first, so that copies of a passage shrink to one row; then, for anchors with
several different segments, single windows are grouped exactly (by the 64-bit hash of the anchor and the 64-bit hash
of the whole window together). Each group's smallest document id decides.

Null texts have no words. Rows without an id neither lose words nor make others lose any. Rows of one id never remove each
other's words; each is judged by itself. Documents of fewer words than a window stay whole. Other columns are ignored.
An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._spark import Scratch, plan_bytes, row_key, ship
from corpusloom.llm._text import U, Words, argmin_window, buffer, join, mix, pieces, rolling, starts_of

SIZE, DEPTH = 50, 2
#: Cells of a block of the sketch, as a power of two.
BLOCK = 16


def anchors(w: Words, size: int) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: owner text, first window, windows, word of the anchor, anchor hash; and the hash of every window."""
    k = size // 2
    h = w.hashes()
    runs = rolling(h, k)
    at = starts_of(w.first, size)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, U), np.zeros(0, U)
    whole = join(runs[:-k], runs[k:]) if size == 2 * k else rolling(h, size)
    place = argmin_window(runs, size - k + 1)[at].astype(np.int64)
    owner = np.searchsorted(w.first, at, "right") - 1
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]))))
    count = np.diff(np.append(new, len(at)))
    return owner[new], at[new], count, place[new], runs[place[new]], whole


def cells(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of the sketch."""
    return [(mix(anchor + U(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))) >> U(64 - bits)).astype(np.int64) for i in range(DEPTH)]


def sketch(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """The merged sketch: row, block, and a bit for each of its cells, as 64-bit words, set where the counts reach two; blocks without one are left out."""

    def run(batches):
        seen: list[np.ndarray] = []

        def flush():
            all_ = np.concatenate(seen)
            seen.clear()
            rows, keys, data = [], [], []
            for i, c in enumerate(cells(all_, bits)):
                cell, n = np.unique(c, return_counts=True)
                block, at = np.unique(cell >> BLOCK, return_index=True)
                local, twice = (cell & ((1 << BLOCK) - 1)).astype("<u4"), n > 1
                for j, lo, hi in zip(block.tolist(), at.tolist(), [*at[1:].tolist(), len(cell)], strict=True):
                    rows.append(i)
                    keys.append(j)
                    data.append((local[lo:hi][~twice[lo:hi]].tobytes(), local[lo:hi][twice[lo:hi]].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(keys, pa.int64()), pa.array([d[0] for d in data], pa.binary()), pa.array([d[1] for d in data], pa.binary())], ["row", "block", "once", "twice"])

        held = 0
        for b in pieces(batches):
            w = Words(*buffer(b.column(0)))
            owner, _, _, _, a, _ = anchors(w, size)
            order = np.lexsort((a, owner))
            o, a = owner[order], a[order]
            first = np.concatenate(([True], (a[1:] != a[:-1]) | (o[1:] != o[:-1])))[: len(a)]
            if len(a):
                seen.append(a[first])
                held += int(first.sum())
            if held > 2_000_000:
                held = 0
                yield flush()
        if seen:
            yield flush()

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BLOCK, np.uint8)
        for b in batches:
            for once, twice in zip(b.column("once"), b.column("twice"), strict=True):
                c = np.frombuffer(once.as_py(), "<u4")
                n[c] = np.minimum(n[c] + 1, 2)
                n[np.frombuffer(twice.as_py(), "<u4")] = 2
        if (n == 2).any():
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([np.packbits(n == 2, bitorder="little").view("<i8")], pa.list_(pa.int64()))], ["row", "block", "words"])

    parts = docs.select("text").mapInArrow(run, "row int, block long, once binary, twice binary")
    return parts.groupBy("row", "block").applyInArrow(merge, "row int, block long, words array<long>")


def segments(docs: DataFrame, size: int, bits: int | None = None) -> DataFrame:
    """doc_id, th, at (all places in the text), anchor, segment and n (windows) of every run of windows with one anchor.

    With bits, also the block and cell of the anchor in each row of a sketch of so many; without, the hashes of the windows.
    """

    def run(batches):
        for b in pieces(batches):
            w = Words(*buffer(b.column("text")))
            owner, at, count, place, anchor, whole = anchors(w, size)
            if not len(at):
                continue
            # Its first and its last window hold all words of a segment, as count <= size; and the anchor's place in it.
            segment = join(join(whole[at], whole[at + count - 1]), mix((place - at).astype(U) << U(32) | count.astype(U)))
            # A segment that a text repeats (one word over and over) is one row with all its places.
            order = np.lexsort((at, segment, anchor, owner))
            o, a, s = owner[order], anchor[order], segment[order]
            first = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (a[1:] != a[:-1]) | (s[1:] != s[:-1]))))
            one = order[first]
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array((at - w.first[owner])[order].astype(np.int32)))
            owner, at, count, anchor, segment = owner[one], at[one], count[one], anchor[one], segment[one]
            more = [pa.array(count.astype(np.int32))]
            if bits is None:
                off = np.concatenate(([0], np.cumsum(count)))
                index = np.arange(off[-1]) + np.repeat(at - off[:-1], count)
                more.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(whole[index].view(np.int64))))
            else:
                more += [x for c in cells(anchor, bits) for x in (pa.array(c >> BLOCK), pa.array((c & ((1 << BLOCK) - 1)).astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner)), b.column("th").take(pa.array(owner)), places, pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64)), *more], names)

    more = ["windows array<long>"] if bits is None else [f"{x}{i} {t}" for i in range(DEPTH) for x, t in (("block", "long"), ("cell", "int"))]
    shape = ["doc_id long", "th long", "at array<int>", "anchor long", "segment long", "n int", *more]
    names = [x.split()[0] for x in shape]
    return docs.where("doc_id IS NOT NULL").mapInArrow(run, ", ".join(shape))


def repeated(docs: DataFrame, size: int, scratch: Scratch, bits: int | None = None) -> DataFrame:
    """The segments estimated repeated: those whose anchors have their bits in every row of the sketch, a join a row, of those that passed the one before."""
    if bits is None:
        total = plan_bytes(docs)
        if total >= 1 << 60:  # not known
            total = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2
        bits = (total // 8).bit_length()
    bits = max(bits, BLOCK)
    table = scratch.keep(sketch(docs, size, bits), "sketch")
    rows = segments(docs, size, bits)
    for i in range(DEPTH):
        own = table.where(F.col("row") == i).select(F.col("block").alias(f"block{i}"), "words")
        bit = F.expr(f"shiftrightunsigned(get(words, cell{i} div 64), cell{i} % 64) & 1L")
        rows = scratch.keep(rows.join(own, f"block{i}").where(bit == 1).drop("words", f"block{i}", f"cell{i}"), "met")
    return rows


def windows_of(docs: DataFrame, open_: DataFrame, size: int) -> DataFrame:
    """The windows of some segments (anchor, segment, doc_id), read again from their texts."""
    ids = open_.select("doc_id").distinct()
    rows = segments(docs.join(ids, "doc_id", "left_semi").select("doc_id", "th", "text"), size)
    return rows.join(open_, ["anchor", "segment", "doc_id"], "left_semi")


def cuts(found: DataFrame, docs: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """doc_id, th, at (all places), and mask of the windows of each found segment of docs that a smaller document holds."""
    kinds = found.groupBy("anchor", "segment").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"))
    kinds = scratch.keep(kinds, "distinct")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    several = scratch.keep(several, "several")
    # The windows of the first occurrence of each segment whose anchor has other segments; equal rows only if one document repeats it.
    # Kept, so that the join stands alone and the segments of a frequent anchor can be split.
    open_ = scratch.keep(kinds.join(several, "anchor", "left_semi"), "open").select("anchor", "segment", F.col("least").alias("doc_id"))
    single = windows_of(docs, open_, size).groupBy("anchor", "segment", "doc_id").agg(F.max("windows").alias("windows"))
    single = scratch.keep(single.select("anchor", "segment", "doc_id", F.posexplode("windows").alias("i", "window")), "windows")
    least = single.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"))
    masks = single.join(least, ["anchor", "window"]).where("first < doc_id").groupBy("anchor", "segment").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    # Kept, so that the join below reads two shuffles and nothing else, and a segment of very many copies can be split.
    known = scratch.keep(kinds.join(masks, ["anchor", "segment"], "left").select("anchor", "segment", "least", "n", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")), "known")
    full = F.expr("shiftleft(1L, n) - 1L")
    hits = found.select("doc_id", "th", "at", "anchor", "segment").join(known, ["anchor", "segment"])
    return hits.select("doc_id", "th", "at", F.when(F.col("doc_id") > F.col("least"), full).otherwise(F.col("mask")).alias("mask")).where("mask <> 0")


def keep_flags(n: int, at: np.ndarray, mask: np.ndarray, size: int) -> np.ndarray:
    """True for each of n words that no cut window covers."""
    delta = np.zeros(n + 1, np.int64)
    for bit in range(size - size // 2 + 1):
        start = at[(mask >> bit) & 1 == 1] + bit
        np.add.at(delta, start, 1)
        np.add.at(delta, np.minimum(start + size, n), -1)
    return np.cumsum(delta[:n]) == 0


def dedupe(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by spaces), kept_sha256.

    bits: the cells of a row of the sketch, as a power of two, instead of those that the input asks for.
    """
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(F.col(text_col)).alias("th"))
    lists = cuts(repeated(rows, size, scratch, bits), rows, size, scratch).groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "mask")).alias("cuts"))
    joined = rows.join(lists, ["doc_id", "th"], "left").select("doc_id", "text", F.col("cuts.at").alias("at"), F.col("cuts.mask").alias("mask"))

    def run(batches):
        for b in pieces(batches):
            w = Words(*buffer(b.column("text")))
            raw, n, gone, kept, sha = w.buf.tobytes(), w.counts, [], [], []
            for i, (at, mask) in enumerate(zip(b.column("at"), b.column("mask"), strict=True)):
                lo, hi = w.first[i], w.first[i + 1]
                s, e = w.start[lo:hi], w.end[lo:hi]
                if at.is_valid:
                    n_at = pc.list_value_length(at.values).to_numpy(zero_copy_only=False)
                    ok = keep_flags(hi - lo, at.values.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(mask.values.to_numpy(zero_copy_only=False), n_at), size)
                    s, e = s[ok], e[ok]
                gone.append(int(hi - lo - len(s)))
                text = b" ".join([raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                kept.append(text.decode())
                sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(gone, pa.int64()), pa.array(kept, pa.large_string()).cast(pa.string()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


#: DuckDB SQL for dedupe's rows without the kept text, over ids that are not null.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {size} + 2)) AS i FROM d WHERE len(ws) >= {size}),
windows AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + {size} - 1], ' ')) AS k FROM starts),
first AS (SELECT k, min(doc_id) AS doc_id FROM windows GROUP BY k),
gone AS (SELECT DISTINCT w.doc_id, unnest(range(w.i, w.i + {size})) AS p FROM windows w JOIN first f ON f.k = w.k AND f.doc_id < w.doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS text, count(*) AS n FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
