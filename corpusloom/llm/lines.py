"""Operator 4: cross-site boilerplate lines, found by how many distinct sites a line occurs on.

A line is what stands between line breaks; its key is the line without white space (blank, tab, carriage return) at
either end. A line is boilerplate, and goes wherever it occurs, when its key has at least ``least_chars`` characters and
occurs in documents of at least ``least_sites`` distinct sites (the source column).

The pairs of line and site, each once a batch of texts, are written once and read for both steps. Every pair turns its site into a register and a rank; a sketch of a line hash is 64 registers of ranks up
to 8, held as eight 64-bit words with one bit a rank, so sketches merge by bitwise or, map-side first, and the highest bit
of a register is its HyperLogLog rank. Lines with too few bits to come near the threshold, which are most, are left out before the
estimate. Lines estimated above ``wide`` times the threshold are boilerplate, lines
below the threshold divided by ``wide`` are not; the lines between get exact counts of distinct sites. The decided
hashes are broadcast if there are at most ``most_broadcast`` of them, otherwise they meet the lines in a shuffled join.

Null texts have no lines and stay null. A null source is one site of its own. Rows are independent: repeated rows and
ids repeat their results (an id may be null); blank lines always stay; a text that loses all its lines is empty. All
columns are kept, and a line of any length is hashed whole; n_chars, where there is one, is the length of the new text. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._spark import Scratch, ship
from corpusloom.llm._text import U, Words, buffer, pieces

REGISTERS, RANKS, PLACES = 64, 8, 8
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 13]] = True
_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[10] = False


def line_keys(texts: pa.Array, least_chars: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """The nonempty lines of the texts, the hash of each line's key, and whether the key is long enough."""
    lines = Words(*buffer(texts), _NOT_BREAK)
    if not len(lines):
        return lines, np.zeros(0, U), np.zeros(0, bool)
    blank = _BLANK[lines.buf]
    solid = np.flatnonzero(~blank)
    first, last = np.searchsorted(solid, lines.start), np.searchsorted(solid, lines.end) - 1
    some = last >= first
    start = np.where(some, solid[np.minimum(first, max(len(solid) - 1, 0))], lines.start) if len(solid) else lines.start
    end = np.where(some, solid[np.maximum(last, 0)] + 1, start) if len(solid) else start
    key = Words.__new__(Words)
    key.buf, key.start, key.end, key.off = lines.buf, start, end, lines.off
    chars = np.concatenate(([0], np.cumsum((lines.buf & 0xC0) != 0x80)))
    return lines, key.hashes(), some & (chars[end] - chars[start] >= least_chars)


def occurrences(docs: DataFrame, site_col: str, text_col: str, least_chars: int) -> DataFrame:
    """line (hash) and site (hash), each pair once a batch."""

    def run(batches):
        for b in pieces(batches):
            lines, h, ok = line_keys(b.column("text"), least_chars)
            site = b.column("site").to_numpy(zero_copy_only=False)[lines.doc()][ok]
            pair = np.unique(np.stack([h[ok].view(np.int64), site.astype(np.int64)], axis=1), axis=0) if ok.any() else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1]))], ["line", "site"])

    return docs.select(F.xxhash64(site_col).alias("site"), F.col(text_col).alias("text")).mapInArrow(run, "line long, site long")


def sketches(pairs: DataFrame) -> DataFrame:
    """One sketch a line hash: words w0 to w7, merged by bitwise or."""
    h = F.xxhash64("site", F.lit(17))
    register = F.shiftrightunsigned(h, 58)
    low = F.shiftleft(h, 6)
    rank = F.least(F.lit(RANKS), 1 + sum(((F.shiftrightunsigned(low, 64 - i) == 0).cast("int") for i in range(1, RANKS)), F.lit(0)))
    bit = F.expr("shiftleft(1L, cast((register % 8) * 8 + rank - 1 as int))")
    rows = pairs.select("line", register.alias("register"), rank.alias("rank")).select("line", (F.col("register") / 8).cast("int").alias("word"), bit.alias("bit"))
    return rows.groupBy("line").agg(*(F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(PLACES)))


def estimate() -> Column:
    """The HyperLogLog estimate of w0 to w7, by linear counting while registers are empty."""
    ranks = []
    for i in range(PLACES):
        for j in range(8):
            byte = F.shiftrightunsigned(F.col(f"w{i}"), 8 * j).bitwiseAND(F.lit(255))
            ranks.append(byte)
    # The sum of 2**-rank and the number of empty registers, from the highest bit of each byte.
    top = lambda b: sum(((b >= (1 << k)).cast("int") for k in range(RANKS)), F.lit(0))
    harmonic = F.aggregate(F.array(*ranks), F.lit(0.0), lambda s, b: s + F.pow(F.lit(2.0), -top(b).cast("double")))
    empty = F.aggregate(F.array(*ranks), F.lit(0), lambda s, b: s + (b == 0).cast("int"))
    raw = F.lit(0.709 * REGISTERS * REGISTERS) / harmonic
    return F.when((empty > 0) & (raw <= 2.5 * REGISTERS), REGISTERS * F.log(F.lit(float(REGISTERS)) / empty)).otherwise(raw)


def least_bits(sites: float) -> int:
    """The fewest bits (registers that are not empty, at least) with which the estimate can reach so many sites.

    The estimate of full ranks passes 2.5 sites a register, up to which empty registers are counted, from 47 registers on.
    """
    return min(math.ceil(REGISTERS * (1 - math.exp(-sites / REGISTERS)) - 1e-9), 46)


def boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", least_sites: int = 10, least_chars: int = 12, wide: float = 2.0, scratch: Scratch | None = None) -> DataFrame:
    """The line hashes to remove, with how each was decided: line, sites (exact, or estimated), exact."""
    scratch = scratch or Scratch(ship(docs.sparkSession))
    pairs = scratch.keep(occurrences(docs, site_col, text_col, least_chars), "pairs")
    bits = sum((F.bit_count(f"w{i}") for i in range(PLACES)), F.lit(0))
    found = sketches(pairs).where(bits >= least_bits(least_sites / wide)).withColumn("sites", estimate()).where(F.col("sites") >= least_sites / wide).select("line", "sites")
    found = scratch.keep(found, "spread")
    near = found.where(F.col("sites") < least_sites * wide).select("line")
    exact = pairs.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").cast("double").alias("sites")).where(F.col("sites") >= least_sites)
    return scratch.keep(found.where(F.col("sites") >= least_sites * wide).select("line", "sites", F.lit(False).alias("exact")).union(exact.select("line", "sites", F.lit(True))), "boilerplate")


def _cut(text: bytes, spans: list[tuple[int, int]], gone: np.ndarray) -> bytes:
    """The text without the given lines: what is left of its lines, joined by line breaks."""
    out, at = [], 0
    for (s, e), g in zip(spans, gone.tolist(), strict=True):
        if g:
            out.append(text[at:s])
            at = min(e + 1, len(text))  # with the break that ends it
    out.append(text[at:])
    whole = b"".join(out)
    if spans and gone[-1] and spans[-1][1] == len(text) and whole.endswith(b"\n"):
        whole = whole[:-1]  # the last line took no break of its own
    return whole


def dedupe(docs: DataFrame, site_col: str = "source", text_col: str = "text", least_sites: int = 10, least_chars: int = 12, wide: float = 2.0, most_broadcast: int = 1_000_000, counted: str = "n_removed") -> DataFrame:
    """docs with boilerplate lines cut out of the text; all other columns as they are, and the lines cut as a column of the name counted (none, if empty)."""
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark)
    bad = boilerplate(docs, site_col, text_col, least_sites, least_chars, wide, scratch).select("line")
    kept = [c for c in docs.columns if c != counted]
    rows = docs.select(*kept)
    count = counted or f"_cut_{uuid.uuid4().hex}"
    if bad.limit(most_broadcast + 1).count() <= most_broadcast:
        hashes = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in bad.collect()], np.int64)))
        shape = rows.withColumn(count, F.lit(0).cast("long")).schema

        def run(batches):
            for b in pieces(batches, text_col):
                lines, h, ok = line_keys(b.column(text_col), least_chars)
                ok &= np.isin(h.view(np.int64), hashes.value)
                yield _rewrite(b, text_col, lines, ok, count)

        out = rows.mapInArrow(run, shape)
    else:
        out = _by_join(rows, bad, text_col, least_chars, count)
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.coalesce(F.char_length(text_col), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*kept, *([counted] if counted else []))


def _rewrite(b: pa.RecordBatch, text_col: str, lines: Words, gone: np.ndarray, counted: str) -> pa.RecordBatch:
    """The batch with the lines cut out, and how many."""
    index = b.schema.get_field_index(text_col)
    texts, count = b.column(index), np.bincount(lines.doc()[gone], minlength=b.num_rows)
    if gone.any():
        values = texts.to_pylist()
        for d in np.flatnonzero(count):
            lo, hi, base = lines.first[d], lines.first[d + 1], lines.off[d]
            spans = list(zip((lines.start[lo:hi] - base).tolist(), (lines.end[lo:hi] - base).tolist(), strict=True))
            values[d] = _cut(values[d].encode(), spans, gone[lo:hi]).decode()
        texts = pa.array(values, texts.type)
    arrays = [texts if i == index else b.column(i) for i in range(b.num_columns)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(count.astype(np.int64))], [*b.schema.names, counted])


def _by_join(rows: DataFrame, bad: DataFrame, text_col: str, least_chars: int, counted: str) -> DataFrame:
    """The same by joins: the hashes of each distinct text that are boilerplate, then the texts with them."""
    key, th, cut = F.xxhash64(text_col), f"_th_{uuid.uuid4().hex}", f"_bad_{uuid.uuid4().hex}"

    def hashes(batches):
        for b in pieces(batches):
            lines, h, ok = line_keys(b.column("text"), least_chars)
            at = lines.doc()[ok]
            yield pa.RecordBatch.from_arrays([b.column("th").take(pa.array(at)), pa.array(h[ok].view(np.int64))], ["th", "line"])

    hits = rows.select(key.alias("th"), F.col(text_col).alias("text")).mapInArrow(hashes, "th long, line long").join(bad, "line", "left_semi").distinct().groupBy("th").agg(F.collect_list("line").alias(cut))
    joined = rows.withColumn(th, key).join(hits.withColumnRenamed("th", th), th, "left").drop(th)
    shape = rows.withColumn(counted, F.lit(0).cast("long")).schema

    def run(batches):
        for b in pieces(batches, text_col):
            lines, h, ok = line_keys(b.column(text_col), least_chars)
            for d, x in enumerate(b.column(cut)):
                part = slice(lines.first[d], lines.first[d + 1])
                ok[part] &= np.isin(h[part].view(np.int64), x.values.to_numpy(zero_copy_only=False)) if x.is_valid else False
            yield _rewrite(b.drop_columns([cut]), text_col, lines, ok, counted)

    return joined.mapInArrow(run, shape)


def standard_error() -> float:
    return 1.04 / math.sqrt(REGISTERS)


#: DuckDB SQL for dedupe's rows: doc_id, n_removed, text.
SQL = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
), keyed AS (
  SELECT trim(line, ' ' || chr(9) || chr(13)) AS k, source FROM lines
), bad AS (
  SELECT k FROM keyed WHERE length(k) >= {least_chars}
  GROUP BY k HAVING count(DISTINCT coalesce(source, '')) >= {least_sites}
), names AS (SELECT coalesce(list(k), []) AS ks FROM bad), parts AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls, ks FROM documents, names
)
SELECT doc_id,
  coalesce(len(list_filter(ls, lambda x: list_contains(ks, trim(x, ' ' || chr(9) || chr(13))))), 0)::BIGINT AS n_removed,
  array_to_string(list_filter(ls, lambda x: NOT list_contains(ks, trim(x, ' ' || chr(9) || chr(13)))), chr(10)) AS text
FROM parts
"""
