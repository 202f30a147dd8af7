"""Hash trees and hash chains: roots, inclusion proofs, chained change logs, and their checks."""

from __future__ import annotations

import bisect
import hashlib
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions._udf import vectorized

GENESIS = "sha256:" + "0" * 64
SCHEME, PROOF_VERSION = "loom-merkle-v1", "v1"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(url: Column, content_hash: Column) -> Column:
    return sha(F.concat(url, F.lit(":"), content_hash))


def leaves(pages: DataFrame) -> DataFrame:
    """The leaves of (url, content_hash) rows that have a hash."""
    return pages.where(F.coalesce("content_hash", F.lit("")) != "").select("url", leaf(F.col("url"), F.col("content_hash")).alias("leaf"))


def ranked(rows: DataFrame, column: str) -> DataFrame:
    """i: the place of each row in ascending order of column, from 0; first: whether no equal row comes before. No task sees more than its own range."""
    spans = rows.repartitionByRange(column).sortWithinPartitions(column)
    # Held, so that both uses below see the same ranges: in the checkpoint folder, which outlives lost executors, where there is one.
    spans = spans.withColumn("_p", F.spark_partition_id())
    spans = spans.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else spans.persist()
    sizes = spans.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    order = W.partitionBy("_p").orderBy(column)  # equal rows are in one range
    again = F.lag(column).over(order).eqNullSafe(F.col(column)) & (F.row_number().over(order) > 1)
    return spans.withColumn("_i", F.row_number().over(order) - 1).withColumn("first", ~again).join(F.broadcast(before), "_p").withColumn("i", F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


#: A chunk of the leaves is 2**CHUNK that follow each other; one task folds it.
CHUNK = 16


def tree_levels(level: list[str], height: int | None = None) -> list[list[str]]:
    """The levels over some hashes, bottom up: as many as height, or up to the root. The last of an odd level meets itself."""
    out = [level]
    while len(out) - 1 < height if height is not None else len(level) > 1:
        level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], level[1::2] + ([level[-1]] if len(level) % 2 else []), strict=True)]
        out.append(level)
    return out


def path_up(levels: list[list[str]], i: int) -> list[dict[str, str]]:
    """The siblings of place i from the lowest level to the one below the top."""
    steps = []
    for level in levels[:-1]:
        steps.append({"sibling": level[min(i ^ 1, len(level) - 1)], "position": "left" if i % 2 else "right"})
        i //= 2
    return steps


def chunks(hashed: DataFrame, height: int) -> DataFrame:
    """The leaves in order: chunk, i, leaf, first (whether no equal leaf comes before)."""
    rows = ranked(hashed.select("leaf"), "leaf")
    return rows.select(F.shiftright(F.col("i").cast("long"), height).alias("chunk"), F.col("i").cast("long").alias("i"), "leaf", "first")


def chunk_roots(rows: DataFrame, height: int) -> list[str]:
    """The root of every chunk, in order: one hash for 2**height leaves is what the driver holds."""

    def run(table: pa.Table) -> pa.Table:
        top = tree_levels(table.sort_by("i").column("leaf").to_pylist(), height)[-1][0]
        return pa.table({"chunk": table.column("chunk")[:1], "top": pa.array([top], pa.string())})

    tops = rows.select("chunk", "i", "leaf").groupBy("chunk").applyInArrow(run, "chunk long, top string").collect()
    return [r["top"] for r in sorted(tops, key=lambda r: r["chunk"])]


#: Up to so many leaves one task folds the tree; more are folded level by level.
SMALL_TREE = 200_000


@vectorized("string")
def fold_sorted(hashes: pd.Series) -> pd.Series:
    """The root of each array of leaves, sorted."""

    def root(level):
        level = sorted(level) if level is not None else []
        while len(level) > 1:
            level = [*level, level[-1]] if len(level) % 2 else level
            level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], level[1::2], strict=True)]
        return level[0] if level else None

    return hashes.map(root)


def merkle_root(hashed: DataFrame, small: int = SMALL_TREE, height: int = CHUNK) -> DataFrame:
    """One row: root (null of nothing) and leaf_count. Trees above small are folded chunk by chunk, and the chunks' roots by the driver."""
    spark = hashed.sparkSession
    n = hashed.count()
    if n <= small or n <= 1:
        return hashed.agg(fold_sorted(F.collect_list("leaf")).alias("root"), F.count("*").alias("leaf_count"))
    root = tree_levels(chunk_roots(chunks(hashed, height), height if n > 1 << height else None))[-1][0]
    return spark.createDataFrame([(root, n)], "root string, leaf_count long")


def _proofs_small(hashed: DataFrame, targets: DataFrame) -> DataFrame:
    """proofs() from a tree of at most SMALL_TREE leaves that every task holds."""
    held = hashed.sparkSession.sparkContext.broadcast(tree_levels(sorted(r["leaf"] for r in hashed.collect())))

    def run(batches):
        tree = held.value
        for b in batches:
            out = []
            for leaf_ in b.column(0).to_pylist():
                i = bisect.bisect_left(tree[0], leaf_) if leaf_ is not None else 0
                if leaf_ is not None and i < len(tree[0]) and tree[0][i] == leaf_:
                    out.append((leaf_, path_up(tree, i)))
            yield _proved(out, tree[-1][0] if tree[0] else None)

    return targets.select("leaf").distinct().mapInArrow(run, _PROOF)


_PROOF = "leaf string, proof array<struct<sibling:string,position:string>>, root string"


def _proved(rows: list[tuple[str, list]], root: str | None) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("sibling", pa.string()), ("position", pa.string())]))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], kind), pa.array([root] * len(rows), pa.string())], ["leaf", "proof", "root"])


def proofs(hashed: DataFrame, targets: DataFrame, small: int = SMALL_TREE, height: int = CHUNK) -> DataFrame:
    """For each target (leaf) in the tree: leaf, proof array of (sibling, position) bottom up, and the root.

    Trees above small are proved chunk by chunk: a chunk's task makes the lower steps, and the tree over the chunks' roots the upper ones.
    """
    n = hashed.count()
    if n <= small or n <= 1:
        return _proofs_small(hashed, targets)
    levels = height if n > 1 << height else None
    rows = chunks(hashed, height)
    over = hashed.sparkSession.sparkContext.broadcast(tree_levels(chunk_roots(rows, levels)))
    wanted = targets.select("leaf").distinct().withColumn("wanted", F.lit(True))
    marked = rows.join(wanted, "leaf", "left").select("chunk", "i", "leaf", (F.col("first") & F.coalesce("wanted", F.lit(False))).alias("wanted"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        tree, chunk = tree_levels(table.column("leaf").to_pylist(), levels), table.column("chunk")[0].as_py()
        upper = path_up(over.value, chunk)
        some = [k for k, w in enumerate(table.column("wanted").to_pylist()) if w]
        return pa.Table.from_batches([_proved([(tree[0][k], path_up(tree, k) + upper) for k in some], over.value[-1][0])])

    return marked.groupBy("chunk").applyInArrow(run, _PROOF)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda h, s: F.when(s["position"] == "left", sha(F.concat(s["sibling"], h))).otherwise(sha(F.concat(h, s["sibling"]))))


def verify_envelope(e: dict, root: str | None = None) -> tuple[bool, str]:
    """Check an exported proof without Spark: scheme and version, leaf, root, and the root that is expected."""
    if e.get("scheme") != SCHEME or e.get("integrity_version") != PROOF_VERSION:
        return False, "unknown scheme or version"
    if not e.get("included"):
        return False, "not included"
    if hashlib.sha256(f"{e['url']}:{e['content_hash']}".encode()).hexdigest() != e["leaf"]:
        return False, "leaf does not match url and content hash"
    h = e["leaf"]
    for s in e["proof"]:
        h = hashlib.sha256((s["sibling"] + h if s["position"] == "left" else h + s["sibling"]).encode()).hexdigest()
    if h != e["merkle_root"]:
        return False, "proof does not lead to the root"
    return (False, "root is not the expected one") if root is not None and h != root else (True, "")


def verified_leaves(sources: list[tuple[str, DataFrame]], stored_root: str | None) -> tuple[str, DataFrame]:
    """The first of the sources (name, pages) whose leaves give the stored root, and its pages. Nothing is proved (ValueError) without
    such a source, or if it has two content hashes for one url.
    """
    if not stored_root:
        raise ValueError("the snapshot has no root to prove against")
    tried = []
    for name, pages in sources:
        root = merkle_root(leaves(pages).select("leaf")).first()
        tried.append(f"{name}: {root['leaf_count']} leaves, root {str(root['root'])[:12]}")
        if root["root"] == stored_root:
            two = pages.where("content_hash <> ''").groupBy("url").agg(F.count_distinct("content_hash").alias("n")).where("n > 1").select("url").first()
            if two is not None:
                raise ValueError(f"{two['url']} has two content hashes in {name}")
            return name, pages
    raise ValueError(f"no leaf set gives the stored root ({'; '.join(tried)})")


def envelopes(pages: DataFrame, urls: DataFrame, run_id: str) -> DataFrame:
    """A proof for each asked url, by its canonical form or as it is; a url that is not there gets included = false."""
    from corpusloom.functions.urls import canonical_url

    have = leaves(pages).join(pages.select("url", "content_hash").distinct(), "url")
    asked = urls.select("url", canonical_url(F.col("url")).alias("canonical"))
    one = asked.join(have.select(F.col("url").alias("canonical"), F.col("content_hash").alias("h1"), F.col("leaf").alias("l1")), "canonical", "left")
    both = one.join(have.select("url", F.col("content_hash").alias("h2"), F.col("leaf").alias("l2")), "url", "left")
    found = both.select("url", F.when(F.col("l1").isNotNull(), F.col("canonical")).otherwise(F.col("url")).alias("proved_url"), F.coalesce("h1", "h2").alias("content_hash"), F.coalesce("l1", "l2").alias("leaf"))
    proved = proofs(leaves(pages).select("leaf"), found.where("leaf IS NOT NULL"))
    return found.join(proved, "leaf", "left").select(
        "url", "proved_url", "content_hash", "leaf", F.col("root").alias("merkle_root"), F.coalesce("proof", F.array()).alias("proof"), F.col("leaf").isNotNull().alias("included"),
        F.lit(run_id).alias("run_id"), F.lit(SCHEME).alias("scheme"), F.lit(PROOF_VERSION).alias("integrity_version"),
    )


CHAINED = ("ts", "url", "change_type", "old_hash", "new_hash", "run_id", "tier")


@vectorized("string")
def _canonical(rows: pd.DataFrame) -> pd.Series:
    return pd.Series([json.dumps({k: None if pd.isna(v) else v for k, v in r.items()}, sort_keys=True, separators=(",", ":")) for r in rows.to_dict("records")])


def canonical(columns: tuple[str, ...] = CHAINED) -> Column:
    """The canonical JSON of a row: sorted keys, no blanks, nulls kept. Rows of plain ASCII text stay in the JVM."""
    s = F.struct(*sorted(columns))
    plain = F.concat_ws("", *columns).rlike(r'^[\x20\x21\x23-\x5B\x5D-\x7E]*$')
    return F.when(plain, F.to_json(s, {"ignoreNullFields": "false"})).otherwise(_canonical(s))


def append(entries: DataFrame, last_hash: str | None = None, columns: tuple[str, ...] = CHAINED) -> DataFrame:
    """entries (seq and columns) with prev_hash and entry_hash. A chain has one order: one run's new entries are folded in one task, 64 bytes a step."""
    rows = entries.withColumn("_json", canonical(columns))

    def run(batches):
        prev = last_hash or GENESIS
        for b in batches:
            before, after = [], []
            for text in b.column("_json").to_pylist():
                before.append(prev)
                prev = "sha256:" + hashlib.sha256((prev.removeprefix("sha256:") + text).encode()).hexdigest()
                after.append(prev)
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["_json"]).columns, pa.array(before, pa.string()), pa.array(after, pa.string())], [*[n for n in b.schema.names if n != "_json"], "prev_hash", "entry_hash"])

    shape = entries.withColumn("prev_hash", F.lit("")).withColumn("entry_hash", F.lit("")).schema
    # A shuffle, not coalesce: reading and rendering the entries stays parallel, only the fold is one task.
    return rows.repartition(1).sortWithinPartitions("seq").mapInArrow(run, shape)


def verify(chain: DataFrame, columns: tuple[str, ...] = CHAINED, by: str | None = None) -> DataFrame:
    """(ok, first_bad_seq, reason) of a chain, or of each chain of column by. Every row is checked on its own; only hashes look at their neighbour."""
    own = F.concat(F.lit("sha256:"), sha(F.concat(F.regexp_replace("prev_hash", "^sha256:", ""), F.col("_json"))))
    rows = chain.withColumn("_json", canonical(columns)).withColumn("_own", own).select(*([by] if by else []), "seq", "prev_hash", "entry_hash", "_own")
    if by:
        rows = rows.withColumn("_prev", F.coalesce(F.lag("entry_hash").over(W.partitionBy(by).orderBy("seq")), F.lit(GENESIS)))
    else:
        rows = ranked(rows, "seq")
        rows = rows.join(rows.select((F.col("i") + 1).alias("i"), F.col("entry_hash").alias("_before")), "i", "left").withColumn("_prev", F.coalesce("_before", F.lit(GENESIS)))
    reason = F.when(F.col("prev_hash").isNull() | F.col("entry_hash").isNull(), "missing hash").when(F.col("prev_hash") != F.col("_prev"), "prev_hash mismatch").when(F.col("entry_hash") != F.col("_own"), "entry_hash mismatch")
    bad = rows.withColumn("reason", reason)
    out = [F.count_if(F.col("reason").isNotNull()).alias("n"), F.min(F.when(F.col("reason").isNotNull(), F.struct("seq", "reason"))).alias("bad")]
    found = bad.groupBy(by).agg(*out) if by else bad.agg(*out)
    return found.select(*([by] if by else []), (F.col("n") == 0).alias("ok"), F.col("bad.seq").alias("first_bad_seq"), F.col("bad.reason").alias("reason"))


def continuity(prior: Column, prior_total: Column, genesis: Column, total: Column) -> Column:
    """Whether a chain still starts where it did and has lost nothing; without a prior, or with an empty one, it does."""
    return F.when(prior.isNull() | prior_total.isNull() | (prior_total == 0), True).otherwise((prior == genesis) & (total >= prior_total))


def root_of(spark: SparkSession, rows: list[tuple[str, str]]) -> str | None:
    """The root of a few (url, content_hash) pairs."""
    return merkle_root(leaves(spark.createDataFrame(rows, "url string, content_hash string"))).first()["root"]
