"""Operator 5: near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct ``shingle``-word shingles (lower-cased A-Z, words between white space); with fewer
words, the whole sequence is the one shingle; without words the set is empty and linked with nothing. Two documents
are linked when 100 * intersection >= ``percent`` * union, confirmed on their full sets.

Documents of equal sets are one class, so a group of copies of any size is one row in what follows. Each class has a
signature of ``SKETCH`` minwise tokens, of which each of ``trees`` independent trees has its own share. In a tree a class starts at
the root; at a node the path so far selects two tokens of the tree's share, and the class goes on to one child for each, named
by the path, the token and its value. Two classes at similarity s share a child of a shared node with probability
1 - (1 - s)**2. At s = 0.8 they share a leaf of a tree with 0.937 at depth 3 and with 0.931 at depth 11, the deepest level (simulated
with these shares); four trees miss 1 such pair in 63,000 at depth 3 and 1 in 43,000 at depth 11.

A node of at most ``small`` classes is compared exhaustively, by sketches of one byte of each of ``SKETCH`` minwise tokens: classes
whose estimate is no more than 4.5 standard errors below the threshold are tied together, transitively. A larger
node branches on, two levels a round; if half of its classes resemble its first one, or after ``rounds`` rounds, it is tied
together as a whole. Ties only ever say what must be compared: linked classes that share a node are tied.
What is tied, directly or through others, is a block. In a block of up to ``BLOCK_DOCS`` sets all full sets are compared exactly, by a
matrix product over their tokens. In a larger block every set is first compared, exactly, with ``LEADERS`` of its sets; those that
links to leaders join are known to be one component, the block's core, whose pairs need no comparison. Only the rest is compared with the core
and with itself, part by part, each pair of parts in one task; a tight group of near copies of any size so takes a time in proportion
to it. The links found, not the ties, make the components.

Null texts have no words. Rows without an id are linked with nothing, have no component and are kept. Of rows that share an
id, the one of the least set hash stands for the document: there is one result row. Other columns are ignored. An
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._spark import Scratch, ship
from corpusloom.llm._text import U, Words, buffer, mix, pieces, rolling, starts_of

SKETCH, DEPTH = 192, 3
BLOCK_DOCS, BLOCK_TOKENS, LEADERS = 512, 1_000_000, 4
_FACTORS = mix(np.arange(1, SKETCH + 1, dtype=U)) | U(1)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every shingle, by text, not yet distinct."""
    h = w.hashes()
    counts = w.counts
    at = starts_of(w.first, size)
    owner = np.searchsorted(w.first, at, "right") - 1
    value = rolling(h, size)[at] if len(at) else np.zeros(0, U)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        more = np.array([int(rolling(h[w.first[d] : w.first[d + 1]], int(counts[d]))[0]) for d in short], U)
        owner, value = np.concatenate([owner, short]), np.concatenate([value, more ^ U(0x5BD1E995)])
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
    return owner, value


def distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each owner, sorted by owner and value."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    if not len(o):
        return o, v
    new = np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])))
    return o[new], v[new]


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row: id, set size, two set hashes, minwise tokens, one byte of each token of the sketch."""

    def run(batches):
        for b in pieces(batches):
            n = b.num_rows
            owner, value = distinct(*shingles(Words(*buffer(b.column(1)), lower=True), shingle))
            size = np.bincount(owner, minlength=n)
            first = np.concatenate(([0], np.cumsum(size)))
            sums = []
            for salt in (1, 2):
                total = np.concatenate((np.zeros(1, U), np.cumsum(mix(value + U(salt * 0x9E3779B9)))))
                sums.append(total[first[1:]] - total[first[:-1]])
            some = np.flatnonzero(size)
            sig, sketch = np.zeros((n, SKETCH), "<u4"), np.zeros((n, SKETCH), np.uint8)
            if len(some):
                for j, f in enumerate(_FACTORS):
                    least = np.minimum.reduceat(((value * f) >> U(32)).astype(np.uint32), first[some])
                    sig[some, j] = least
                    sketch[some, j] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array([r.tobytes() for r in sketch], pa.binary())],
                ["doc_id", "n", "f1", "f2", "sig", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sig binary, sketch binary")


def sets(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row: id and the full set, sorted, as 64-bit hashes."""

    def run(batches):
        for b in pieces(batches):
            owner, value = distinct(*shingles(Words(*buffer(b.column(1)), lower=True), shingle))
            at = np.searchsorted(owner, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([value[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], ["id", "members"])

    return docs.mapInArrow(run, "id long, members binary")


def standing(docs: DataFrame, sig: DataFrame, shingle: int) -> DataFrame:
    """The sets of the rows that stand for their ids, where rows share ids."""

    def run(batches):
        for b in pieces(batches):
            owner, value = distinct(*shingles(Words(*buffer(b.column(1)), lower=True), shingle))
            at = np.searchsorted(owner, np.arange(b.num_rows + 1))
            part = [value[at[i] : at[i + 1]] for i in range(b.num_rows)]
            f1 = [int(mix(v + U(0x9E3779B9)).sum(dtype=U).view(np.int64)) for v in part]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f1, pa.int64()), pa.array([v.tobytes() for v in part], pa.binary())], ["id", "f1", "members"])

    rows = docs.mapInArrow(run, "id long, f1 long, members binary")
    return rows.join(sig.select(F.col("doc_id").alias("id"), "f1"), ["id", "f1"], "left_semi").dropDuplicates(["id"]).select("id", "members")


def _children(node: np.ndarray, tree: np.ndarray, sig: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """The children of each row's nodes, and their trees: (rows, m) to (rows, 2 * m); a tree has share tokens of its own."""
    one = mix(node + U(0xA5A5A5A5)) % U(share)
    two = (one + U(1) + mix(node + U(0x3C3C3C3C)) % U(share - 1)) % U(share)
    out = [mix(node ^ mix((t << U(32)) | np.take_along_axis(sig, (tree * share + t.astype(np.int64)), axis=1))) for t in (one, two)]
    return np.concatenate(out, axis=1), np.concatenate((tree, tree), axis=1)


def branch(rows: DataFrame, levels: int, trees: int, roots: bool = False) -> DataFrame:
    """Go down so many levels from each row's node (or from the roots of all trees): node, tree, id."""
    share = SKETCH // trees

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u4").reshape(-1, SKETCH).astype(U)
                if roots:
                    tree = np.tile(np.arange(trees), (part.num_rows, 1))
                    node = mix(tree.astype(U) + U(1))
                else:
                    tree = part.column("tree").to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 1)
                    node = part.column("node").to_numpy(zero_copy_only=False).view(U).reshape(-1, 1)
                for _ in range(levels):
                    node, tree = _children(node, tree, sig, share)
                take = pa.array(np.repeat(np.arange(part.num_rows), node.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(node.ravel().view(np.int64)), pa.array(tree.ravel().astype(np.int32)), part.column("id").take(take)], ["node", "tree", "id"])

    return rows.mapInArrow(run, "node long, tree int, id long")


def _groups(batches, key: str):
    """The rows of each key of a sorted partition, whole, as (key, table)."""
    held, at = [], None
    for b in batches:
        k = b.column(key).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        cut = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if held and k[i] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = k[i]
            held.append(b.slice(i, j - i))
    if held:
        yield at, pa.Table.from_batches(held)


def _pairs_of_two(b: pa.RecordBatch, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are alone with the next row in their node, tied to it; (left, right) rows."""
    k = b.column("node").to_numpy(zero_copy_only=False)
    c = b.column("c").to_numpy(zero_copy_only=False)
    left = np.flatnonzero((c[:-1] == 2) & (k[1:] == k[:-1]))
    sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    n = b.column("n").to_numpy(zero_copy_only=False)
    ok = ((sketch[left] == sketch[left + 1]).sum(1) >= least) & (np.minimum(n[left], n[left + 1]) * 100 >= np.maximum(n[left], n[left + 1]) * percent)
    return left[ok], left[ok] + 1


def ties(live: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Ties (a, b) within nodes: of (node, id, n, c, sketch) rows, or, if whole, of every member with the node's first."""
    share = percent / 100
    least = int(SKETCH * (share - 4.5 * (share * (1 - share) / SKETCH) ** 0.5))

    def out(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

    def run(batches):
        for _, t in _groups(batches, "node"):
            ids, n = t.column("id").to_numpy(), t.column("n").to_numpy()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            rest, a, b = np.arange(len(ids)), [], []
            while len(rest):
                seed, queue, rest = rest[0], [rest[0]], rest[1:]
                while queue and len(rest):
                    u = queue.pop()
                    hit = (np.minimum(n[rest], n[u]) * 100 >= np.maximum(n[rest], n[u]) * percent) & ((sketch[rest] == sketch[u]).sum(1) >= least)
                    if hit.any():
                        new = rest[hit]
                        rest = rest[~hit]
                        queue += new.tolist()
                        a.append(np.full(len(new), ids[seed]))
                        b.append(ids[new])
            if a:
                yield out(a, b)

    def split(batches):
        """Nodes of two, which are most, many at a time; the others one by one."""

        def others():
            last = None
            for x in batches:
                x = x if last is None else pa.Table.from_batches([last, x]).combine_chunks().to_batches()[0]
                k = x.column("node").to_numpy(zero_copy_only=False)
                end = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last node may go on
                last = x.slice(end)
                if end:
                    yield x.slice(0, end)
            if last is not None and last.num_rows:
                yield last

        for x in others():
            left, right = _pairs_of_two(x, least, percent)
            ids = x.column("id").to_numpy(zero_copy_only=False)
            yield out([ids[left]], [ids[right]])
            more = x.filter(pa.array(x.column("c").to_numpy(zero_copy_only=False) > 2))
            if more.num_rows:
                yield from run(iter([more]))

    if whole:
        return live.select(F.col("first").alias("a"), F.col("id").alias("b")).where("a <> b")
    return live.select("node", "id", "n", "c", "sketch").repartition("node").sortWithinPartitions("node", "id").mapInArrow(split, "a long, b long")


def _links(sets_: list[np.ndarray], percent: int, half: int) -> list[tuple[int, int]]:
    """Links that join what linked sets there are into components; half > 0: only between the first half sets and the rest count."""
    n = np.array([len(x) for x in sets_])
    value = np.concatenate(sets_) if len(sets_) else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets_)), n)
    token, column, count = np.unique(value, return_inverse=True, return_counts=True)
    common = count[column] > 1
    owner, column = owner[common], column[common]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    column = np.cumsum(np.concatenate(([0], (column[1:] != column[:-1]).astype(int)))) if len(column) else column
    both = np.zeros((len(sets_), len(sets_)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((len(sets_), 4096), np.float32)
        part[owner[i:j], column[i:j] - lo] = 1
        both += part @ part.T
    linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    if half:
        linked[:half, :half] = linked[half:, half:] = False
    rest, out = np.arange(len(sets_)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            u = queue.pop()
            hit = linked[u, rest]
            out += [(int(u), int(v)) for v in rest[hit]]
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return out


def confirm(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within blocks, by exact comparison of the full sets in (block, i, j, side, id, members) rows."""

    def run(batches):
        for _, t in _groups(batches, "task"):
            t = t.sort_by([("side", "ascending"), ("id", "ascending")])
            ids, raw = t.column("id").to_pylist(), t.column("members").to_pylist()
            half = int((t.column("side").to_numpy() == 0).sum()) if t.column("cross")[0].as_py() else 0
            found = _links([np.frombuffer(x, U) for x in raw], percent, half)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], ["a", "b"])

    return members.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def tasks(blocks: DataFrame) -> DataFrame:
    """(id, block, members) rows dealt to tasks of bounded size: a block's parts, and every pair of its parts."""
    size = blocks.groupBy("block").agg(F.count("*").alias("docs"), F.sum(F.length("members") / 8).alias("tokens"))
    parts = F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("tokens") / BLOCK_TOKENS)).cast("int")
    rows = blocks.join(size.select("block", F.greatest(F.lit(1), parts).alias("parts")), "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j")))
    rows = rows.withColumn("p", F.explode(pair))
    return rows.select(F.xxhash64("block", "p.i", "p.j").alias("task"), (F.col("p.i") != F.col("p.j")).alias("cross"), (F.col("part") != F.col("p.i")).cast("int").alias("side"), "id", "members")


def _parts() -> list:
    """How many parts the rows of a block make, as an aggregate."""
    return [F.greatest(F.lit(1), F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum(F.length("members") / 8) / BLOCK_TOKENS))).cast("int")]


def core_tasks(rest: DataFrame, core: DataFrame) -> DataFrame:
    """Tasks, as of tasks(), that compare every part of a block's rest with every part of its core."""
    n = rest.groupBy("block").agg(*(x.alias("rests") for x in _parts())).join(core.groupBy("block").agg(*(x.alias("cores") for x in _parts())), "block")

    def dealt(rows: DataFrame, own: str, other: str, side: int) -> DataFrame:
        rows = rows.join(n, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        i, j = ("part", "k") if side == 0 else ("k", "part")
        return rows.select(F.xxhash64(F.lit("core"), "block", i, j).alias("task"), F.lit(True).alias("cross"), F.lit(side).alias("side"), "id", "members")

    return dealt(rest, "rests", "cores", 0).unionByName(dealt(core, "cores", "rests", 1))


def led(large: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(links of the sets of large blocks to their leaders, the sets with whether they are of their block's core)."""

    def run(batches):
        for b in batches:
            held = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                held.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(held, pa.bool_()))

    picks = F.array_distinct(F.array(*(F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(LEADERS))))
    leaders = large.groupBy("block").agg(picks.alias("ids")).select("block", F.explode("ids").alias("id"))
    leaders = scratch.keep(large.join(leaders, ["block", "id"]).select("block", F.col("id").alias("a"), F.col("members").alias("x")), "leaders")
    pairs = large.select("block", F.col("id").alias("b"), F.col("members").alias("y")).join(leaders, "block").where("a <> b").select("a", "b", "x", "y")
    links = scratch.keep(pairs.mapInArrow(run, "a long, b long"), "led")
    named = large.join(components(links, scratch), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    named = scratch.keep(named, "named")
    most = named.groupBy("block", "comp").agg(F.count("*").alias("n")).groupBy("block").agg(F.max_by("comp", F.struct("n", "comp")).alias("core"))
    return links, named.join(most, "block").select("id", "block", "members", (F.col("comp") == F.col("core")).alias("core"))


def confirmed(held: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join the linked sets of every block (id, members, block) into its components."""
    large = held.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_DOCS).select("block")
    large = scratch.keep(large, "large_blocks")
    if large.isEmpty():
        return confirm(tasks(held), percent)
    links, named = led(held.join(large, "block", "left_semi"), percent, scratch)
    named = scratch.keep(named, "cores")
    rest, core = named.where("NOT core").drop("core"), named.where("core").drop("core")
    whole = tasks(held.join(large, "block", "left_anti").select("id", "members", "block").unionByName(rest.select("id", "members", "block")))
    return links.unionByName(confirm(whole.unionByName(core_tasks(rest, core)), percent))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """For every id in links (a, b): the smallest id that it reaches. Labels spread to neighbours and jump ahead until none changes."""
    edges = scratch.keep(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct(), "edges")
    comp = scratch.keep(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("comp")).withColumnRenamed("x", "id"), "comp")
    while True:
        near = edges.join(comp.withColumnRenamed("id", "y"), "y").groupBy("x").agg(F.min("comp").alias("seen"))
        step = comp.join(near.withColumnRenamed("x", "id"), "id").select("id", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"))
        ahead = comp.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        new = scratch.keep(step.join(ahead, "comp", "left").select("id", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp")), "comp")
        changed = new.where("comp <> old").limit(1).count()
        comp = new.select("id", "comp")
        if not changed:
            return comp


def _docs_of(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """The rows of docs whose id is in ids: by broadcast if there are at most so many ids, by a shuffle otherwise."""
    return docs.join(F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids, "doc_id", "left_semi")


def link(docs: DataFrame, shingle: int = 2, percent: int = 80, trees: int = 4, small: int = 4096, rounds: int = 4, most_broadcast: int = 500_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures with class, confirmed links between class representatives, components of those)."""
    spark = ship(docs.sparkSession)
    scratch = Scratch(spark)
    sig = scratch.keep(signatures(docs.select("doc_id", "text"), shingle), "signatures")
    repeats = sig.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    if repeats:
        one = sig.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("f1", "f2", "n", "sig", "sketch")).alias("r")).select("doc_id", "r.n", "r.f1", "r.f2", "r.sig", "r.sketch")
        sig = scratch.keep(one.unionByName(sig.where("doc_id IS NULL")), "signatures")
    real = sig.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.keep(real.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id")), "classes")
    reps = scratch.keep(real.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n", "sig", "sketch"), "reps")
    rows, found = branch(reps.select("id", "sig"), DEPTH, trees, roots=True), []
    for turn in range(rounds + 1):
        rows = scratch.keep(rows.distinct() if turn else rows, "nodes")
        nodes = scratch.keep(rows.groupBy("node").agg(F.count("*").alias("c"), F.min("id").alias("first")).where("c > 1"), "shared")
        few = rows.join(nodes.where(F.col("c") <= small), "node").join(reps.select("id", "n", "sketch"), "id")
        found.append(scratch.keep(ties(few, percent, False).distinct(), "ties"))
        large = nodes.where(F.col("c") > small)
        if large.isEmpty():
            break
        many = scratch.keep(rows.join(large, "node"), "large")
        if turn == rounds:
            found.append(ties(many, percent, True))
            break
        alike = many.join(_near_first(many, reps, percent), "node")
        found.append(scratch.keep(ties(alike.where("2 * near >= c"), percent, True), "ties"))
        rows = branch(alike.where("2 * near < c").select("node", "tree", "id").join(reps.select("id", "sig"), "id"), 2, trees)
    tied = found[0]
    for x in found[1:]:
        tied = tied.union(x)
    block = components(tied, scratch).withColumnRenamed("comp", "block")
    texts = _docs_of(docs.select("doc_id", "text"), block.select(F.col("id").alias("doc_id")), most_broadcast)
    members = standing(texts, sig, shingle) if repeats else sets(texts, shingle)
    held = scratch.keep(members.join(block, "id"), "sets")
    links = scratch.keep(confirmed(held, percent, scratch), "links")
    return sig.join(classes, ["f1", "f2", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id")).alias("id")), links, components(links, scratch)


def _near_first(many: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """For each large node how many of its members resemble its first one: node, near."""
    share = percent / 100
    least = int(SKETCH * (share - 4.5 * (share * (1 - share) / SKETCH) ** 0.5))

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sketch", "other"))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(((x == y).sum(1) >= least).astype(np.int64))], ["node", "near"])

    firsts = many.select("node", "first").distinct().join(reps.select(F.col("id").alias("first"), F.col("sketch").alias("other")), "first").select("node", "other")
    both = many.select("node", "id").join(reps.select("id", "sketch"), "id").join(firsts, "node").select("node", "sketch", "other")
    return both.mapInArrow(run, "node long, near long").groupBy("node").agg(F.sum("near").alias("near"))


def dedupe(docs: DataFrame, shingle: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **method) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named, _, comp = link(docs, shingle, percent, **method)
    out = named.join(comp, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


#: DuckDB SQL for dedupe's rows with two-word shingles, over distinct ids that are not null: every pair that shares a shingle is counted.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM d WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= {percent} * (x.n + y.n - c.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(l.b, doc_id)) AS component_id, doc_id <= coalesce(l.b, doc_id) AS kept FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least l ON l.a = doc_id
"""
