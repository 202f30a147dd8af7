"""Operators 2, 4, 5 and 6 against brute force."""

import hashlib
import math
import os
import random
import re
from collections import defaultdict

import pytest
import xxhash

from corpusloom.llm import fingerprints, lines, neardup, substrings
from corpusloom.llm._spark import Scratch

from .conftest import prose, table, thue_morse

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_windows(rows, size):
    first, words = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[p : p + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        keep = [True] * len(w)
        for p in range(len(w) - size + 1):
            if i is not None and first[tuple(w[p : p + size])] < i:
                keep[p : p + size] = [False] * size
        text = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [50, 8])
def test_substrings(spark, corpus, size):
    rows = [*corpus, (3, prose(3, 90)), (None, corpus[3][1]), corpus[5]]
    docs = table(spark, rows).selectExpr("*", "1 AS th", "2 AS at", "3 AS anchor").repartition(5)
    got = substrings.dedupe(docs, size=size).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_windows(rows, size)


def test_unlike_texts_by_the_thue_morse_rule(spark):
    """Texts whose words, word orders or lines are Thue-Morse strings of two kinds: nothing is removed, nothing is linked."""
    rows = [(i, f"{' '.join(thue_morse(n, two))} {prose(i, 30)}") for i, (n, two) in enumerate((n, two) for n in (1024, 2048, 4096) for two in ("ab", "ba"))]
    rows += [(10 + i, prose(50, 60, 30).replace("a0", thue_morse(n, two))) for i, (n, two) in enumerate((n, two) for n in (1024, 2048, 4096) for two in ("ab", "ba"))]
    rows += [(20, thue_morse(1024, "ab")), (21, thue_morse(1024, "ba")), (22, "one two " + thue_morse(4096, "ab")), (23, "one two " + thue_morse(4096, "ba"))]
    docs = table(spark, rows)
    got = substrings.dedupe(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_windows(rows, 50)
    for shingle in (2, 5):
        assert sorted(tuple(r) for r in neardup.dedupe(docs, shingle=shingle).collect()) == brute_components(rows, shingle, 80)


def test_substrings_with_a_full_sketch(spark, corpus, monkeypatch):
    """A sketch without room estimates every window repeated; the result is the same, in one block or in many."""
    rows = [*corpus, (3, prose(3, 90)), (None, corpus[3][1]), corpus[5]]
    docs = table(spark, rows).repartition(5)
    want = brute_windows(rows, 50)
    monkeypatch.setattr(substrings, "BLOCK", 6)
    for bits in (6, 7, 12, 20):
        got = substrings.dedupe(docs, bits=bits).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted((tuple(r) for r in got), key=repr) == want, bits
    assert substrings.dedupe(docs.limit(0)).collect() == []


def test_a_sketch_lets_through_little_more_than_what_is_repeated(spark, monkeypatch):
    """Of windows that one text holds, a sketch of the proper size leaves few to the second pass; one without room leaves them all."""
    rows = [(i, prose(i, 120, 3000)) for i in range(200)] + [(300, prose(7, 120, 3000)), (301, prose(7, 120, 3000))]
    docs = table(spark, rows).selectExpr("doc_id", "xxhash64(text) AS th", "text")
    n = lambda **method: substrings.repeated(docs, 50, Scratch(spark), **method).count()
    few = [n(), n(bits=20)]
    monkeypatch.setattr(substrings, "BLOCK", 6)
    every = n(bits=6)
    assert every > 800 and all(every / 80 < x < every / 20 for x in few)


def brute_components(rows, shingle, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[p : p + shingle]) for p in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return sorted((i, len(x), find(i), find(i) == i) for i, x in sets.items())


@pytest.mark.parametrize(("shingle", "small"), [(2, 32), (2, 2), (5, 32)])
def test_near_duplicates(spark, corpus, shingle, small):
    docs = table(spark, corpus).selectExpr("*", "1 AS id", "2 AS n", "3 AS node", "4 AS comp")
    got = neardup.dedupe(docs, shingle=shingle, small=small).collect()
    assert sorted(tuple(r) for r in got) == brute_components(corpus, shingle, 80)


def test_large_blocks_are_compared_by_leaders(spark, monkeypatch):
    """Blocks far above the bound: a tight group, a chain whose ends are unlike, and sets tied but not linked."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 8)
    r, rows = random.Random(5), []
    base = [f"w{i}" for i in range(150)]
    for i in range(60):
        words = list(base)
        for k in r.sample(range(150), 2):
            words[k] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(150)]
    for i in range(60):
        chain = chain[4:] + [f"d{i}y{k}" for k in range(4)]
        rows.append((100 + i, " ".join(chain)))
    for i in range(60):
        words = [f"t{k}" for k in range(150)]
        for k in range(r.randrange(2), 150, r.choice([9, 17, 20, 33])):
            words[k] = f"z{r.randrange(10**9)}"
        rows.append((200 + i, " ".join(words)))
    got = sorted(tuple(x) for x in neardup.dedupe(table(spark, rows).repartition(3)).collect())
    assert got == brute_components(rows, 2, 80) and 3 < len({c for _, _, c, _ in got}) < 120


def test_recall_of_links_at_the_threshold(spark):
    """Pairs just above and just below the threshold, at production parameters: all but a few of the first, none of the second."""
    r, rows, near = random.Random(11), [], 0
    for i in range(0, 4000, 2):
        words = [f"w{r.randrange(200_000)}" for _ in range(r.randint(60, 200))]
        n, edited = len(words) - 1, list(words)
        # One replaced word changes two shingles of each text: 100 * (n - 2m) >= 80 * (n + 2m), or just not.
        m = n // 18 + (i % 8 == 0)
        for k in r.sample(range(1, len(words) - 1, 2), m):
            edited[k] = f"x{r.randrange(10**9)}"
        near += i % 8 > 0
        rows += [(i, " ".join(words)), (i + 1, " ".join(edited))]
    got = {x.doc_id: x.component_id for x in neardup.dedupe(table(spark, rows).repartition(6)).collect()}
    brute = {i: c for a in range(0, 4000, 2) for i, _, c, _ in brute_components(rows[a : a + 2], 2, 80)}
    want = {i for i in range(1, 4000, 2) if brute[i] == i - 1}
    assert len(want) == near == 1500
    found = {i for i, c in got.items() if c != i}
    assert found <= want and len(found) >= 0.998 * len(want) and all(got[i] == i - 1 for i in found)


def test_near_duplicates_edges(spark, corpus):
    assert neardup.dedupe(table(spark, corpus).limit(0)).collect() == []
    rows = [(1, "a b c"), (1, "a b c"), (2, "A B C"), (None, "a b c"), (None, None), (5, None)]
    got = sorted((tuple(r) for r in neardup.dedupe(table(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (None, 0, None, True), (5, 0, 5, True)], key=repr)


def test_lines(spark):
    boiler, common = "Subscribe to our newsletter today", "Only on nine sites, this line"
    rows = [(i, f"{prose(i, 20)}\n  {boiler}\t\r\n\nshort\nlast {i}", f"site{i % 14}") for i in range(60)]
    rows += [(100 + i, f"{common}\n{prose(200 + i, 10)}\n{common}", f"site{i % 9}") for i in range(40)]
    rows += [(200, None, None), (201, "", "x"), (202, boiler, "y"), (None, f"{boiler}\n{boiler}", None), (203, "long line " * 50_000, "z")]
    rows += [(300 + i, f"{thue_morse(n, 'ab')}\n{thue_morse(n, 'ba')}" if i == 4 else thue_morse(n, "ab"), f"site{i}") for n in (1024, 2048, 4096) for i in range(9)]
    rows += [(400, thue_morse(1024, "ba"), "site10"), (401, thue_morse(4096, "ba"), "site11")]
    docs = table(spark, rows).selectExpr("*", "1 AS line", "2 AS site", "3 AS n_removed")
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            sites[x.strip(" \t\r")].add(s)
    bad = {x for x, v in sites.items() if len(v) >= 10 and len(x) >= 12}
    assert bad == {boiler}
    want = sorted(((i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in bad)) for i, t, _ in rows), key=repr)
    for most in (10, 0):
        out = lines.dedupe(docs, most_broadcast=most).collect()
        assert sorted(((r.doc_id, r.text) for r in out), key=repr) == want
        assert all(r.n_chars == len(r.text or "") for r in out)
    spread = {r.sites: r.exact for r in lines.boilerplate(docs).collect()}
    assert list(spread.values()) == [True]
    assert lines.dedupe(docs.limit(0)).collect() == []


def test_lines_with_too_few_bits_cannot_reach_the_estimate():
    def estimate(ranks):
        raw, empty = 0.709 * 64 * 64 / sum(2.0**-r for r in ranks), ranks.count(0)
        return 64 * math.log(64 / empty) if empty and raw <= 160 else raw

    for sites in (1, 3, 5, 10, 50, 100, 159, 161, 300, 1000):
        n = lines.least_bits(sites)
        assert all(estimate([8] * k + [0] * (64 - k)) < sites and estimate([1] * k + [0] * (64 - k)) < sites for k in range(n)), (sites, n)


def test_line_sketches_estimate_sites(spark):
    pairs = spark.range(400).selectExpr("1 AS line", "id AS site").union(spark.range(3).selectExpr("2 AS line", "id AS site"))
    est = {r.line: r.e for r in lines.sketches(pairs.union(pairs)).withColumn("e", lines.estimate()).collect()}
    assert abs(est[1] - 400) < 400 * 4 * lines.standard_error() and 2.5 < est[2] < 3.5


def brute_vectors(text):
    """The paragraphs and pieces of a text, hashed and summed one by one."""
    text = text or ""
    exact, like, paragraphs = [0] * 16, [0] * 62, text.split("\n")
    pieces = []
    for p in paragraphs:
        digest = hashlib.sha512(p.encode()).digest()
        exact = [(x + int.from_bytes(digest[4 * i : 4 * i + 4])) % 2**32 for i, x in enumerate(exact)]
        words = WORD.findall(p)
        spots = [m.start() for m in WORD.finditer(p)] + [len(p)]
        pieces += [p[spots[i] : spots[min(i + 4, len(words))]].rstrip(" \t\x0b\x0c\r") for i in range(0, len(words), 4)]
    for p in pieces:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for i in range(31):
            like[2 * i] += h >> i & 1
            like[2 * i + 1] += h >> (i + 31) & 1
    return len(paragraphs), exact, len(pieces), like


def shown(v):
    paragraphs, exact, pieces, like = v
    return "".join(f"{x:08X}" for x in (paragraphs, *exact)) + "-" + "".join(f"{x:08X}" for x in (pieces, *like))


def brute_likeness(a, b):
    if shown(a) == shown(b) or (a[2] == 0 and b[2] == 0):
        return 1.0
    x, y = ([2 * c - v[2] for c in v[3]] for v in (a, b))
    norm = math.sqrt(sum(c * c for c in x) * sum(c * c for c in y))
    return min(1.0, max(0.0, sum(p * q for p, q in zip(x, y, strict=True)) / norm)) if norm and a[2] and b[2] else 0.0


@pytest.mark.parametrize("span_bytes", [None, 1, 2000])
def test_fingerprints(spark, corpus, span_bytes):
    rows = [(i, (t or "").replace("\r", "") if t else t) for i, t in corpus]
    docs = table(spark, rows).selectExpr("*", "1 AS some", "2 AS th", "3 AS k", "4 AS span", "5 AS guest", "6 AS form", "7 AS heads").repartition(5)
    got = {r.doc_id: r for r in fingerprints.compare(docs, span_bytes=span_bytes).collect()}
    assert len(got) == len(rows)
    texts = [t or "" for _, t in rows]
    for n, (i, t) in enumerate(rows):
        t, after = t or "", texts[(n + 1) % len(texts)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        own, changed, other = map(brute_vectors, (t, edited, after))
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (shown(own), shown(changed))
        assert got[i].near_edited == pytest.approx(brute_likeness(own, changed)) and got[i].near_next == pytest.approx(brute_likeness(own, other))
    assert fingerprints.compare(docs.limit(0)).collect() == []


def test_fingerprints_are_those_of_paragraphs(spark):
    """Where words, blanks, borders or blank lines differ, fingerprints do; the order of paragraphs alone does not count."""
    texts = ["a b c d e f g h", "e f g h a b c d", "a b c d\ne f g h", "a b c d\n\ne f g h", "a  b c d\ne f g h", "e f g h\na b c d", "", "\n"]
    fp = [r.fingerprint for r in sorted(fingerprints.fingerprint(table(spark, list(enumerate(texts)))).collect(), key=lambda r: r.doc_id)]
    assert fp[2] == fp[5] and len(set(fp)) == len(texts) - 1
    assert fp == [shown(brute_vectors(t)) for t in texts]


def test_fingerprints_repeats_and_null_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "c d e f"), (None, "c d e f"), (None, "g"), (2, None), (2, "")]
    for span_bytes in (None, 1):
        out = fingerprints.compare(table(spark, rows), span_bytes=span_bytes).collect()
        assert sorted((r.doc_id or -1) for r in out) == [-1, -1, -1, 1, 1, 1, 2, 2]
        assert len({r.fingerprint for r in out if r.doc_id == 1}) == 2
        assert {r.fingerprint for r in out} == {shown(brute_vectors(t)) for _, t in rows}
    one = fingerprints.compare(table(spark, [(7, "x y z")])).collect()
    assert one[0].near_next == 1.0


def test_fingerprints_are_homomorphic(spark):
    a, b = "first paragraph of five words\nsecond one", "a third paragraph with many more words than four"
    fp = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(table(spark, [(1, a), (2, b), (3, a + "\n" + b), (4, b + "\n" + a)])).collect()}
    assert fp[3] == fp[4]
    df = spark.createDataFrame([(fp[1], fp[2], fp[3])], "a string, b string, c string")
    r = df.select(fingerprints.shifted("a", "b", 1).alias("sum"), fingerprints.shifted("c", "b", -1).alias("rest")).first()
    assert r["sum"] == fp[3] and r["rest"] == fp[1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_equal_their_sql(spark):
    """Every query of this subpackage that SQL can express, on the smallest tables."""
    import duckdb

    from corpusloom.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert set(queries.ORACLE) == {"op2_substrings", "op4_lines", "op5_neardup", "op9_licenses"}
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, sf)
        got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
        res = con.execute(sql)
        names = [d[0] for d in res.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        assert sorted(names) == sorted(df.columns) and got == sorted((tuple(r[i] for i in order) for r in res.fetchall()), key=repr), name
