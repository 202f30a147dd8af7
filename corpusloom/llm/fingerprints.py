"""Operator 6 [native]: homomorphic multiset hashes of documents.

A text is the multiset of its paragraphs: what stands between line breaks, as written, empty ones too. Each paragraph is
hashed (SHA-512) to an exact vector of 16 lanes of 32 bits; lanes add modulo 2**32. For likeness, each paragraph is also cut
into pieces of at most ``PIECE`` words, from its own start, and each piece is hashed to 62 lanes of one random bit, added
modulo 2**31 (two to a 64-bit sum). Sums do not depend on order, so the fingerprints of two texts add up to that of both,
joined by a line break, and a paragraph is put in or taken out by adding or subtracting its own fingerprint. Texts of the
same paragraphs, in any order, have equal fingerprints; others differ, but for collisions of the sums.

The likeness of two fingerprints is the cosine of their likeness vectors, each lane read as +1 or -1 per piece and so
of mean zero over unlike pieces, cut to [0, 1]; texts with equal fingerprints and two texts without pieces are alike (1),
a text with pieces and one without are unlike (0).

The next document is found without a join: rows are dealt to spans of consecutive keys of about equal bytes, and the first
row of each span also goes, as a guest, to the end of the span before it (that of the first span to the last one). So the texts are
shuffled once; all the rest happens inside the spans. The spans' first keys (at most ``SPANS``) are all that the driver sees.

Everything is DataFrame functions. Null texts are empty. The next document is the one that follows in ascending id;
rows without an id come first, rows of one id follow by the hash of their text, and rows that agree in both are one
document: each is returned with the same values. A single document is its own next one. A text of any length is one row of
one span. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm._spark import Scratch, row_key

PIECE, LANES, BITS, SPANS = 4, 16, 31, 1 << 20
_WORDS = rf"[^\x20\x09-\x0D]+(?:[\x20\x09\x0B\x0C]+[^\x20\x09-\x0D]+){{0,{PIECE - 1}}}"
_MASK = (1 << 32) - 1
EXACT = [f"e{i}" for i in range(LANES)]
LIKE = [f"s{i}" for i in range(BITS)]
VECTOR = ("paragraphs", "pieces", "exact", "like")
KEYS = ["some", "k", "th"]


def _lane(digest: Column, i: int) -> Column:
    """32 bits of a digest in hex."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _units(text: Column, form: int) -> list[Column]:
    """The paragraphs (kind 0) and the pieces (kind 1) of a text."""
    return [F.struct(F.lit(form).alias("form"), F.lit(kind).alias("kind"), units.alias("units")) for kind, units in ((0, F.split(text, "\n", -1)), (1, F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))))]


def _summed(units: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """The vectors of (keys, kind, unit) rows, and more aggregates of them."""
    whole, piece = F.col("kind") == 0, F.col("kind") == 1
    rows = units.select("*", F.when(whole, F.sha2("unit", 512)).alias("digest"), F.when(piece, F.xxhash64("unit")).alias("h"))
    two = F.lit((1 << BITS) | 1)
    sums = [F.sum(F.when(whole, _lane(F.col("digest"), i)).otherwise(0)).bitwiseAND(F.lit(_MASK)).alias(EXACT[i]) for i in range(LANES)]
    sums += [F.sum(F.when(piece, F.shiftrightunsigned("h", i).bitwiseAND(two)).otherwise(0)).alias(LIKE[i]) for i in range(BITS)]
    summed = rows.groupBy(*keys).agg(F.sum(whole.cast("long")).alias("paragraphs"), F.sum(piece.cast("long")).alias("pieces"), *sums, *more)
    lane = F.lit((1 << BITS) - 1)
    like = F.array(*(x.cast("int") for c in LIKE for x in (F.col(c).bitwiseAND(lane), F.shiftrightunsigned(c, BITS).bitwiseAND(lane))))
    kept = [c for c in summed.columns if c not in (*EXACT, *LIKE)]
    return summed.select(*kept, F.array(*EXACT).alias("exact"), like.alias("like"))


def text_form(vector: Column) -> Column:
    """The fingerprint as hex, 8 digits a lane: the number of paragraphs, the exact lanes; after a dash the number of pieces, the likeness lanes."""
    lanes = lambda n, a: F.array_join(F.transform(F.concat(F.array(n), a.cast("array<bigint>")), lambda x: F.lpad(F.hex(x), 8, "0")), "")
    return F.concat(lanes(vector["paragraphs"], vector["exact"]), F.lit("-"), lanes(vector["pieces"], vector["like"]))


def signed(vector: Column) -> Column:
    """The signed likeness lanes: twice the ones less the pieces."""
    return F.transform(vector["like"], lambda c: 2.0 * c - vector["pieces"])


def likeness(a: str, b: str) -> Column:
    """The likeness of two documents given as column prefixes: <p>_fp, <p>_n (pieces), <p>_v (signed lanes)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = F.col(f"{a}_v"), F.col(f"{b}_v")
    norm = F.sqrt(dot(x, x) * dot(y, y))
    none = (F.col(f"{a}_n") == 0).cast("int") + (F.col(f"{b}_n") == 0).cast("int")
    return F.when((F.col(f"{a}_fp") == F.col(f"{b}_fp")) | (none == 2), 1.0).when((none == 1) | (norm == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(x, y) / norm)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text (never null) and the keys that order and tell apart the documents: some (0 without an id), k, th."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select(F.col("doc_id").isNotNull().cast("int").alias("some"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("k"), row_key(F.col("text")).alias("th"), "text")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, paragraphs, fingerprint."""
    rows = _keyed(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    units = rows.select("row", "some", "k", F.explode(F.array(*_units(F.col("text"), 0))).alias("v")).select("row", "some", "k", "v.kind", F.explode("v.units").alias("unit"))
    return _summed(units, ["row", "some", "k"]).select(F.when(F.col("some") == 1, F.col("k")).alias("doc_id"), "paragraphs", text_form(F.struct(*VECTOR)).alias("fingerprint"))


def shifted(fp: str, other: str, sign: int) -> Column:
    """The fingerprint of a multiset after the one of another is added (sign 1: insertion) or subtracted (-1: deletion)."""

    def lanes(c: str, start: int, count: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.conv(F.substring(F.col(c), F.lit(start) + 8 * i, F.lit(8)), 16, 10).cast("long"))

    def moved(start: int, count: int, mask: int) -> Column:
        both = F.zip_with(lanes(fp, start, count), lanes(other, start, count), lambda x, y: (x + sign * y).bitwiseAND(F.lit(mask)))
        return F.array_join(F.transform(both, lambda x: F.lpad(F.hex(x), 8, "0")), "")

    return F.concat(moved(1, 1 + LANES, _MASK), F.lit("-"), moved(10 + 8 * LANES, 1 + 2 * BITS, (1 << BITS) - 1))


def spans(keys: DataFrame, span_bytes: int) -> DataFrame:
    """One row: heads, the sorted keys at which spans of about span_bytes start, from (KEYS, size, part) rows; parts are ranges of keys."""
    inside = W.partitionBy("part").orderBy(*KEYS)
    number = F.floor((F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")) / span_bytes)
    starts = keys.select(*KEYS, "part", number.alias("no")).withColumn("last", F.lag("no").over(inside)).where("last IS NULL OR last <> no")
    return starts.agg(F.sort_array(F.collect_list(F.struct(*KEYS))).alias("heads"))


def _dealt(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """rows with span and guest: each row in its span (guest 0), and the first row of a span at the end of the one before (1)."""
    found, key = F.col("heads"), F.struct(*KEYS)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(SPANS.bit_length()))))
    # How many heads are at or below the key, by bisection.
    below = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(found)) & (F.get(found, at + s - 1) <= key), at + s).otherwise(at))
    rows = rows.withColumn("heads", heads.scalar()).withColumn("span", below - 1)
    rows = rows.select(*KEYS, "text", "span", (F.get("heads", "span") == key).alias("is_head"), F.size("heads").alias("n"))
    own, before = F.struct(F.col("span").alias("span"), F.lit(0).alias("guest")), F.struct(F.pmod(F.col("span") - 1, F.col("n")).alias("span"), F.lit(1).alias("guest"))
    return rows.select(*KEYS, "text", F.explode(F.when(F.col("is_head"), F.array(own, before)).otherwise(F.array(own))).alias("v")).select(*KEYS, "text", "v.span", "v.guest")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span_bytes: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of the text's to the edited and the next one's."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = _keyed(docs, id_col, text_col)
    keys = scratch.keep(rows.select(*KEYS, F.octet_length("text").cast("long").alias("size")), "keys")
    keys = scratch.keep(keys.repartitionByRange(*KEYS).groupBy(*KEYS).agg(F.count("*").alias("m"), F.max("size").alias("size")).withColumn("part", F.spark_partition_id()), "order")
    total, most = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("m"), F.lit(0))).first()
    if span_bytes is None:
        span_bytes = max(1 << 20, min(1 << 26, total // 256), 2 * total // SPANS)
    # A number of its own: cutting and hashing cost far more than the bytes that adaptive execution would merge by.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(total >> 26, 100_000))
    heads = scratch.keep(spans(keys, span_bytes), "heads")
    if most > 1:
        rows = rows.groupBy(*KEYS).agg(F.max("text").alias("text"))
    rows = _dealt(rows, heads).repartition(parts, "span")
    after = F.lead("text").over(W.partitionBy("span").orderBy("guest", *KEYS))
    rows = rows.withColumn("after", after).withColumn("n_chars", F.char_length("text"))
    cut = F.expr("n_chars div 4").cast("int")
    changed = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - cut), F.substring("after", F.lit(1), cut))
    place = ["span", "guest", *KEYS]
    rows = rows.select(*place, F.col("n_chars").cast("long").alias("n_chars"), "text", F.when(F.col("guest") == 0, changed).alias("changed"))
    # Form 0: the text, form 1: its edited text; kind 2: the digest of the edited text, which travels as numbers.
    digest = F.struct(F.lit(1).alias("form"), F.lit(2).alias("kind"), F.array(F.sha2("changed", 256)).alias("units"))
    forms = F.array(*_units(F.col("text"), 0), *_units(F.col("changed"), 1), digest)
    units = rows.select(*place, "n_chars", F.explode(forms).alias("v")).where("guest = 0 OR v.form = 0").select(*place, "n_chars", "v.form", "v.kind", F.explode("v.units").alias("unit"))
    sha = [F.sum(F.when(F.col("kind") == 2, _lane(F.col("unit"), i)).otherwise(0)).alias(f"d{i}") for i in range(8)]
    table = _summed(units, [*place, "form"], F.max("n_chars").alias("n_chars"), *sha)
    # In a span a text, its edited text and the next text follow each other.
    order, vector = W.partitionBy("span").orderBy("guest", *KEYS, "form"), F.struct(*VECTOR)
    hexed = F.lower(F.array_join(F.array(*(F.lpad(F.hex(f"d{i}"), 8, "0") for i in range(8))), ""))
    out = table.select(*place, "form", "n_chars", vector.alias("d"), F.lead(vector, 1).over(order).alias("e"), F.lead(vector, 2).over(order).alias("x"), F.lead(hexed, 1).over(order).alias("edited_sha256")).where("guest = 0 AND form = 0")
    shown = [c for p in "dex" for c in (F.col(f"{p}.pieces").alias(f"{p}_n"), text_form(F.col(p)).alias(f"{p}_fp"), signed(F.col(p)).alias(f"{p}_v"))]
    out = out.select(*KEYS, "n_chars", "edited_sha256", *shown)
    if most > 1:
        out = out.join(keys.where("m > 1").select(*KEYS, "m"), KEYS, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("m", F.lit(1).cast("long")))))
    return out.select(
        F.when(F.col("some") == 1, F.col("k")).alias("doc_id"), "n_chars", "edited_sha256", F.col("d_fp").alias("fingerprint"), F.col("e_fp").alias("edited_fingerprint"),
        likeness("d", "e").alias("near_edited"), likeness("d", "x").alias("near_next"),
    )
