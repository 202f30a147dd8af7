"""Operators 3, 7 and 8, and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import bpe, decontaminate, quality, toxicity

from .conftest import prose, table, thue_morse
from .test_dedup import brute_components


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_gam_learns_a_step_and_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=40)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9
    assert quality.fit(x[:5], y[:5]).score(x[:2]).shape == (2,)


def test_quality(spark):
    r = random.Random(0)
    rows = [(i, prose(i, 100) if i % 3 else "SPAM!! " * r.randint(20, 60)) for i in range(600)] + [(900, None), (901, ""), (5, "again"), (None, "x")]
    docs = table(spark, rows).selectExpr("*", "1 AS x", "2 AS score")
    labels = labelled(spark, [(i, int(i % 3 > 0), 0) for i in range(600)] + [(7, 1, 0), (None, 1, 0), (8, None, None)])
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= o.score <= 1 and o.predicted == int(o.score >= 0.3) for o in out)
    held = [o for o in out if o.held_out and o.doc_id is not None and o.doc_id < 600]
    assert all(o.held_out == (zlib.crc32(str(o.doc_id).encode()) % 5 == 0) for o in out if o.doc_id is not None)
    assert sum(o.predicted == int(o.doc_id % 3 > 0) for o in held) / len(held) > 0.97
    again = {(o.doc_id, o.score) for o in quality.classify(docs.repartition(7), labels).collect()}
    assert again == {(o.doc_id, o.score) for o in out}
    kept = {x.doc_id for x in quality.keep(table(spark, rows), labels).collect()}
    assert kept == {o.doc_id for o in out if o.predicted} or kept - {o.doc_id for o in out if o.predicted} <= {5}
    assert quality.classify(docs.limit(0), labels).collect() == []
    assert {o.score for o in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_segments_are_the_maximal_ones():
    """All maximal segments: the best one, and those of what is left on either side of it."""

    def brute(scores, lo, hi):
        spans = [(sum(scores[i:j]), i, j - 1) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
        best = max(spans, default=(0.0, 0, 0))
        return [*brute(scores, lo, best[1]), best, *brute(scores, best[2] + 1, hi)] if best[0] > 0 else []

    r = random.Random(1)
    for _ in range(400):
        dense = [r.choice([-0.5, -0.5, -0.5, r.uniform(0.1, 3)]) for _ in range(r.randint(0, 30))]
        at = [i for i, s in enumerate(dense) if s > 0]
        got = toxicity.segments(at, [dense[i] for i in at], -0.5)
        assert [(pytest.approx(s), a, b) for s, a, b in got] == brute(dense, 0, len(dense))


def test_a_tree_takes_the_best_cut_and_scores_are_sums_of_table_entries():
    r = np.random.default_rng(3)
    for _ in range(50):
        g, h = r.normal(size=9), r.random(9) * 3
        gain = lambda k: g[:k].sum() ** 2 / (h[:k].sum() + 1) + g[k:].sum() ** 2 / (h[k:].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
        cuts = [k for k in range(1, 9) if h[:k].sum() >= 2 and h[k:].sum() >= 2]
        assert quality._split(g, h)[0] == pytest.approx(max([0.0, *map(gain, cuts)]))
    x = r.random((400, 4)).astype(np.float32)
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.7).astype(float), rounds=20)
    for row, score in zip(x[:60], model.score(x[:60]), strict=True):
        b = [int((c <= v).sum()) for c, v in zip(model.cuts, row, strict=True)]
        z = model.intercept + sum(t[k] for t, k in zip(model.main, b, strict=True)) + sum(t[b[i], b[j]] for i, j, t in model.pairs)
        assert score == pytest.approx(1 / (1 + math.exp(-z)))


def test_models_do_not_depend_on_how_repeated_rows_are_dealt(spark):
    """Of rows that share an id the one of the least text hash is fitted on, whatever their number."""
    rows = [(i, prose(i, 60) if i % 2 else "SPAM!! vile " * (9 + i % 5)) for i in range(120)]
    more = [(i, f"again {prose(i, 30)}") for i in range(40)] * 3
    labels = labelled(spark, [(i, i % 2, 1 - i % 2) for i in range(120)])
    docs = table(spark, rows + more)
    for classify in (quality.classify, toxicity.classify):
        a, b = (sorted((r.doc_id, r.score) for r in classify(x, labels).collect()) for x in (docs.repartition(7), table(spark, more[::-1] + rows[::-1]).coalesce(1)))
        assert a == b


def test_a_very_long_text_is_scored_whole(spark):
    rows = [(i, prose(i, 60) if i % 2 else prose(i, 50) + " vile scumbag idiot" * 3) for i in range(300)]
    long = prose(5, 40_000, 3000)
    rows += [(1001, long + " vile scumbag idiot" * 9), (1002, long), (1003, "!" * 300_000)]
    labels = labelled(spark, [(i, i % 2, 1 - i % 2) for i in range(300)])
    got = {r.doc_id: r for r in toxicity.classify(table(spark, rows), labels).collect()}
    assert got[1001].passages[-1].first_word >= 40_000 and got[1002].passages == []
    assert {1001, 1002, 1003} <= {r.doc_id for r in quality.classify(table(spark, rows), labels).collect()}


def test_toxicity(spark):
    rows = []
    for i in range(900):
        w = prose(i, 80, 900).split(" ")
        if i % 4 == 0:
            for k in range(6):
                w.insert(5 + 9 * k, ["vile", "scumbag", "scumlord", "idiot"][(i + k) % 4])
        rows.append((i, " ".join(w)))
    rows += [(2000, None), (2001, ""), (3, "twice"), (None, "vile idiot")]
    docs = table(spark, rows).selectExpr("*", "1 AS y", "2 AS part")
    labels = labelled(spark, [(i, 1, int(i % 4 == 0)) for i in range(900)])
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= o.score <= 1 and o.predicted == int(o.score >= 0.5) for o in out)
    held = [o for o in out if o.held_out and o.doc_id is not None and o.doc_id < 900]
    assert sum(o.predicted == int(o.doc_id % 4 == 0) for o in held) / len(held) > 0.97
    hit = next(o for o in out if o.doc_id == 8)
    assert hit.passages and hit.passages[0].first_word <= hit.passages[0].last_word
    assert toxicity.classify(docs.limit(0), labels).collect() == []
    assert len({o.score for o in toxicity.classify(docs, labels.limit(0)).collect()}) == 1


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute_bm25(index, terms):
    out = {}
    for t in terms:
        for p in range(index.start[t], index.end[t]):
            out[int(index.item[p])] = out.get(int(index.item[p]), 0.0) + float(index.share[p])
    return out


def test_wand_finds_all_items_above_the_threshold():
    texts = [prose(i, 30, 60) for i in range(70)]
    index = decontaminate.Index(list(range(70)), texts)
    r = random.Random(2)
    for threshold in (0.2, 0.5, 0.8):
        for _ in range(20):
            queries = [np.array(sorted(r.sample(range(len(index.terms)), r.randint(1, 40)))) for _ in range(9)]
            start = np.cumsum([0, *map(len, queries)])
            want = [(q, i, pytest.approx(s)) for q, terms in enumerate(queries) for i, s in sorted(brute_bm25(index, terms).items()) if s >= threshold]
            assert list(zip(*(x.tolist() for x in index.wand(np.concatenate(queries), start[:-1], threshold)), strict=True)) == want
            reach = index.in_reach(np.repeat(np.arange(9), np.diff(start)), np.concatenate(queries), 9, threshold)
            assert {q for q, _, _ in want} <= set(np.flatnonzero(reach).tolist())


def brute_search(rows, bench, threshold=0.6, overlap=0.6):
    """Every passage of every text against every item: BM25 over all items, then the overlaps."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: word.findall(re.sub("[A-Z\u00c0-\u00d6\u00d8-\u00de]", lambda m: m[0].lower(), t or ""))
    bench = [(i, words(t)) for i, t in sorted({(i, t or "") for i, t in bench}, key=repr)]
    df = Counter(x for _, w in bench for x in set(w))
    mean, longest = sum(len(w) for _, w in bench) / len(bench), max(len(w) for _, w in bench)
    idf = {x: math.log(1 + (len(bench) - n + 0.5) / (n + 0.5)) for x, n in df.items()}

    def parts(w):
        cut = max(1, -(-2 * len(w) // 3)) if w else 0
        return w[:cut], w[cut:]

    runs = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    out, s = [], max(48, longest)
    for doc, text in rows:
        best, w = {}, words(text)
        for at in range(0, max(1, len(w) - s), s) if w else ():
            passage = w[at : at + 2 * s]
            held = set(passage)
            for i, item in enumerate(x for _, x in bench):
                tf = Counter(item)
                gain = {x: idf[x] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(item) / max(mean, 1))) for x, n in tf.items()}
                score = sum(v for x, v in gain.items() if x in held) / sum(gain.values()) if gain else 0
                if score >= threshold:
                    shares = [len(runs(p, min(3, len(p))) & runs(passage, min(3, len(p)))) / len(runs(p, min(3, len(p)))) if p else 1.0 for p in parts(item)]
                    if all(x >= overlap for x in shares) and score > best.get(i, (0, -1.0))[1] + 1e-12:
                        best[i] = (at, score, *shares)
        out += [(doc, bench[i][0], *v) for i, v in best.items()]
    return out


def test_search_equals_a_search_of_everything(spark):
    bench = [(i, prose(5000 + i, 31 + i % 23, 90)) for i in range(120)] + [(40, None), (41, ""), (3, prose(7, 34)), (7, prose(5007, 38, 90)), (None, prose(9, 40)), (200, "a " + thue_morse(2048, "xy"))]
    rows = [(i, prose(i, 230, 90)) for i in range(40)] + [(50, None), (51, ""), (52, bench[3][1]), (None, bench[5][1]), (52, "again " + bench[9][1])]
    rows += [(60 + i, prose(600 + i, 20 * i, 90) + " " + bench[2 * i][1].upper() + " " + prose(i, 70, 90) + " " + bench[2 * i + 1][1]) for i in range(30)]
    rows += [(100, " ".join(prose(800 + i, 300, 2000) + " " + bench[i][1] for i in range(60))), (101, "a " + thue_morse(2048, "yx"))]
    want = sorted(((*r[:3], *(round(x, 9) for x in r[3:])) for r in brute_search(rows, bench)), key=repr)
    docs = table(spark, rows).selectExpr("*", "1 AS item_id", "2 AS score", "3 AS shard").repartition(3)
    for shard_items, pass_bytes in ((2000, 1 << 28), (60, 1 << 28), (60, 1), (9, 1 << 28)):
        found = decontaminate.search(docs, items(spark, bench).selectExpr("*", "1 AS shard", "'x' AS i"), shard_items=shard_items, pass_bytes=pass_bytes)
        assert str(found._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == (1 if pass_bytes > 1 else 3)
        assert sorted(((*r[:3], *(round(x, 9) for x in r[3:])) for r in map(tuple, found.collect())), key=repr) == want
    assert len(want) > 100 and 101 not in {r[0] for r in want}


def test_decontamination(spark):
    bench = [(i, prose(5000 + i, 25 + i, 2000)) for i in range(30)] + [(40, None), (41, ""), (3, prose(7, 12))]
    rows = [(i, prose(i, 200, 2000)) for i in range(40)]
    rows += [(100 + i, prose(300 + i, 150, 2000) + " " + bench[i][1].upper() + " " + prose(400 + i, 90, 2000)) for i in range(30)]
    rows += [(200, None), (201, ""), (202, bench[0][1]), (None, bench[1][1]), (100, "again")]
    docs = table(spark, rows).selectExpr("*", "1 AS item_id", "2 AS score")
    got = {(r.doc_id, r.item_id) for r in decontaminate.search(docs, items(spark, bench)).collect()}
    assert got == {(100 + i, i) for i in range(30)} | {(202, 0), (None, 1)}
    sharded = {(r.doc_id, r.item_id) for r in decontaminate.search(docs, items(spark, bench), shard_items=8).collect()}
    assert sharded == got
    left = [r.doc_id for r in decontaminate.drop(table(spark, rows), items(spark, bench)).collect()]
    assert sorted(x for x in left if x is not None) == sorted([*range(40), 200, 201, 100])
    assert decontaminate.search(docs.limit(0), items(spark, bench)).collect() == []
    assert decontaminate.search(docs, items(spark, []).limit(0)).collect() == []


def test_pipeline(spark, tmp_path):
    import public_tokenizers

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    bench = [(i, prose(8000 + i, 40, 3000)) for i in range(5)]
    boiler = "Share this page with your friends"
    rows = [(i, (prose(i, 120, 1500) if i % 5 else "BUY!! " * (30 + i % 7)) + f"\n{boiler}", f"site{i % 13}") for i in range(260)]
    rows += [(1000 + i, prose(9 + 20 * i, 120, 1500) + f" extra\n{boiler}", "site1") for i in range(6)]
    rows += [(2000 + i, prose(3000 + i, 100, 1500) + " " + bench[i][1], "site2") for i in range(5)]
    rows += [(3000, None, "site3"), (3001, "", "site3")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, [(i, int(i % 5 > 0), 0) for i in range(260)]).write.parquet(f"{tmp_path}/labels.parquet")
    items(spark, bench).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = sorted(tuple(r) for r in out.collect())

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = {r.doc_id: r.predicted for r in quality.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    kept = [(i, t) for i, t, _ in rows if model[i]]
    assert {i for i, _ in kept if i < 260} == {i for i in range(260) if i % 5}
    kept = [(i, None if t is None else "\n".join(x for x in t.split("\n") if x != boiler)) for i, t in kept]
    whole = {i for i, _, _, first in brute_components(kept, 5, 80) if first}
    kept = [(i, t) for i, t in kept if i in whole]
    assert not {1000 + i for i in range(6)} & {i for i, _ in kept}
    kept = [(i, t) for i, t in kept if not any(b in (t or "") for _, b in bench)]
    enc = bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = sorted((i, len(ids := enc.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in kept)
    assert got == want
    docs_columns = docs.columns
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs_columns


CLASHES = ("th", "id", "n", "x", "node", "item_id", "score", "n_removed", "site", "line", "block", "members", "y", "shard")


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null and repeated ids, repeated rows, null, empty and very long texts, columns that clash, and empty tables, in each stage and in all."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    bench, long = [(1, prose(8000, 40, 3000)), (None, None)], prose(5, 30_000, 3000)
    near = prose(1, 200, 2000)
    rows = [(None, near), (None, near), (1, near), (1, near), (2, near + " more"), (3, None), (4, ""), (5, long), (6, long + " end"), (7, prose(3, 80, 2000) + " " + bench[0][1]), (None, bench[0][1]), (8, " \n\t\n ")]
    clash = [f"{i} AS {c}" for i, c in enumerate(CLASHES)]
    docs = table(spark, rows).selectExpr("*", *clash).repartition(3)
    for name, df in (("some", docs), ("none", docs.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labelled(spark, [(1, 1, 0)]).limit(1 if name == "some" else 0).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        items(spark, bench).limit(2 if name == "some" else 0).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        stage, kept = df, {}
        for key, f in corpus_pipeline.STAGES:
            stage = f(spark, stage, f"{tmp_path}/{name}")
            kept[key] = stage.collect()
            if key != "encoding":
                assert stage.columns == docs.columns and all(tuple(r)[5:] == tuple(range(len(CLASHES))) for r in kept[key])
        assert [tuple(r) for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").orderBy("doc_id", "n_tokens").collect()] == sorted((tuple(r) for r in kept["encoding"]), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        if name == "none":
            assert not any(kept.values())
        else:
            assert sorted(str(r.doc_id) for r in kept["quality"]) == sorted(str(r.doc_id) for r in kept["line_dedup"]) == sorted(str(i) for i, _ in rows)
            assert sorted(str(r.doc_id) for r in kept["near_dedup"]) == sorted(["None"] * 3 + ["1", "1", "3", "4", "5", "7", "8"])
            assert sorted(str(r.doc_id) for r in kept["encoding"]) == sorted(["None"] * 2 + ["1", "1", "3", "4", "5", "8"])


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
