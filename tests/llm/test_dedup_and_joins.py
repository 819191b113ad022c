"""Exact dedup, shingle join and pivot index against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from quern.llm import common, exact_dedup, pivot_dedup, shingle_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# Exact dedup

TEXTS = ["", None, "a", "a", "A", "a ", "é", "é", "x" * 50_000, "x" * 50_000, "b", "c", "d", "e", "f", "g", "h", "a"]


def expected(rows):
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = by[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits, digest, capacity, hot", [(64, 256, 4096, 256), (64, 256, 2, 1), (3, 256, 2, 256), (2, 8, 1, 1), (1, 8, 2, 3)])
def test_exact_dedup(spark, bits, digest, capacity, hot):
    """Short keys and digests force chains and texts that agree in both; a low bound makes hot keys."""
    rows = list(enumerate(TEXTS)) + [(None, "a"), (None, "only here")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, key int, keep_id string")
    found = exact_dedup.exact_dedup(df, key_bits=bits, digest_bits=digest, capacity=capacity, hot_rows=hot)
    assert sorted([tuple(r) for r in found.collect()], key=str) == expected(rows)


def test_directory_doubles_and_owners_hold_ranges(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 2900) AS text").repartition(6)
    index = exact_dedup.Index(df, capacity=64)
    entries = index.entries.collect()
    assert len(entries) == 2900 and max(e.depth for e in entries) >= 6
    buckets = {}
    for e in entries:
        key = e.key & (1 << 64) - 1
        assert key >> (64 - e.depth) == e.bucket
        buckets.setdefault((e.depth, e.bucket), []).append(key)
    assert max(map(len, buckets.values())) <= 64
    # Every owner has a range of keys of its own, and every bucket one owner.
    ranges = {}
    owner = {}
    for m in index.members.collect():
        ranges.setdefault(m.owner, []).append(m.key & (1 << 64) - 1)
        assert owner.setdefault((m.depth, m.bucket), m.owner) == m.owner
    ordered = [(min(v), max(v)) for _, v in sorted(ranges.items())]
    assert len(ordered) > 1 and all(a[1] < b[0] for a, b in zip(ordered, ordered[1:], strict=False))


def test_the_index_answers(spark):
    """What the probe returns comes from the entries at bucket and chain: tampering with either shows."""
    df = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)], "doc_id long, text string")
    index = exact_dedup.Index(df, key_bits=1)
    right = sorted(tuple(r) for r in index.probe().collect())
    sound = index.entries
    assert sound.selectExpr("max(chain)").first()[0] > 1
    index.entries = sound.withColumn("chain", sound.chain % 3 + 1)
    assert sorted(tuple(r) for r in index.probe().collect()) != right
    index.entries = sound.withColumn("bucket", sound.bucket + 1)
    assert index.probe().count() < len(right)


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.dedup_stage(spark, empty, "").columns == empty.columns


def test_dedup_stage(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 1), (2, "a", "en", "s", 1), (3, None, "en", None, 0)], DOCS)
    assert sorted(r.doc_id for r in exact_dedup.dedup_stage(spark, df, "").collect()) == [2, 3]


# Components


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(5, 5), (200, 300)]
    df = spark.createDataFrame(pairs, "u long, v long")
    found = {r.node: r.component for r in common.components(df).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    want = union(pairs, {x for p in pairs for x in p})
    assert found == {n: want[n] for n in nodes}
    assert common.components(df.where("false")).count() == 0


# Shingles


def shingles(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def classes(rows):
    sets = {i: shingles(t) for i, t in rows}
    linked = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    comp = union(linked, list(sets))
    return sorted((i, len(s), comp[i]) for i, s in sets.items())


def mutated(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(words) for _ in range(rng.randint(3, 90))] for _ in range(12)]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(160):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.2:
            text += passage
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(text)))
    return rows


@pytest.mark.parametrize("seed, limit", [(1, 2_000_000), (2, 300), (3, 1)])
def test_shingle_classes(spark, seed, limit):
    """Small slices put the counts across slices to the test."""
    rows = mutated(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in shingle_join.shingle_classes(df, slice_shingles=limit).collect()) == classes(rows)


@pytest.mark.parametrize("copies", [shingle_join.COPIES, 3])
def test_shingle_family_and_copies(spark, monkeypatch, copies):
    """A family of near copies beside exact copies, repeated rows, a repeated id with two texts, and a very long text; copies in one task and in many."""
    monkeypatch.setattr(shingle_join, "COPIES", copies)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            text[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(text)))
    rows += [(2000 + i, "same words in every one of these copies") for i in range(80)]
    rows += [(3000, " ".join(f"l{i}" for i in range(60_000))), (3001, " ".join(f"l{i}" for i in range(59_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = classes(rows)
    assert sorted(tuple(r) for r in shingle_join.shingle_classes(df, slice_shingles=2000).collect()) == want
    twice = rows + rows[:40] + [(1000, "another text under an id that is taken")]
    found = sorted(tuple(r) for r in shingle_join.shingle_classes(spark.createDataFrame(twice, "doc_id long, text string")).collect())
    assert found == sorted(want + [w for r in rows[:40] for w in want if w[0] == r[0]] + [(1000, 4, 1000)])


def test_shingle_edges(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "a b c"), (4, ""), (5, None), (6, " \n"), (7, "É a"), (8, "é a"), (9, "a b c d e"), (10, "a b c d e f"), (11, "x" * 70), (12, "x" * 70), (13, "x" * 69 + "y"), (14, "a b")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int")
    assert sorted(tuple(r) for r in shingle_join.shingle_classes(df).collect()) == classes(rows)
    twice = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted([tuple(r) for r in shingle_join.shingle_classes(twice).collect()], key=str) == [(1, 1, 1), (1, 1, 1), (None, 1, None)]
    assert shingle_join.shingle_classes(df.where("false")).count() == 0


def test_long_words_and_texts_hash_apart():
    import pyarrow as pa

    texts = ["a" * 40 + "b", "a" * 40 + "c", "word " * 30_000, "ab", "ba", "abc" * 20, "acb" * 20]
    hashes, count = shingle_join.word_hashes(pa.array(texts))
    assert count.tolist() == [1, 1, 30_000, 1, 1, 1, 1] and len(set(hashes.tolist())) == 7
    thue, other = "a", "b"
    for _ in range(12):  # words on which every polynomial modulo a power of two agrees
        thue, other = thue + other, other + thue
        assert len(set(shingle_join.word_hashes(pa.array([thue, other]))[0].tolist())) == 2


def test_word_hashes_know_words_only():
    """Equal words have equal hashes wherever they stand, in whatever case; different words differ."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = ["".join(rng.choice("abAB\x00é \n\t\x0b\u2003日") for _ in range(rng.choice([0, 1, 7, 8, 9, 30, 200]))) for _ in range(400)] + [None, "x" * 64, "x" * 65, " ", ""]
    hashes, count = shingle_join.word_hashes(pa.array(texts))
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert count.tolist() == [len(w) for w in words]
    seen = {}
    for word, h in zip((w for ws in words for w in ws), hashes.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    part = pa.array(texts).slice(13, 200)
    assert shingle_join.word_hashes(part)[0].tolist() == hashes[sum(count[:13]) : sum(count[:213])].tolist()


def test_need():
    for n in range(1, 60):
        for m in range(1, 60):
            least = next(k for k in range(1, n + m) if 100 * k >= 80 * (n + m - k))
            assert shingle_join.need(n, m) == least


# Embeddings


def vectors(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = np.where(rng.random((n, 1)) < 0.6, centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.08, rng.normal(size=(n, dim)))
    x[5] = x[6]
    return x.astype(np.float32)


def brute(rows, least=0.98):
    sound = [i for i, (k, e, label) in enumerate(rows) if k is not None and label is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    links = []
    for a in sound:
        for b in sound:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links.append((a, b))
    comp = union([(rows[a][0], rows[b][0]) for a, b in links], [r[0] for r in rows if r[0] is not None])
    degree = [sum(i in p for p in links) for i in range(len(rows))]
    return [(r[0], degree[i], comp.get(r[0]), r[0] is not None and comp[r[0]] == r[0]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [1536, 16])
def test_pivots(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_dedup, "BLOCK", block)
    rows = [(i, [float(v) for v in e], i % 2) for i, e in enumerate(vectors(3))]
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [None] * 16, 0), (905, rows[5][1], None), (906, rows[5][1][:8], 1), (None, rows[5][1], 1), (907, rows[5][1], 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rep int")
    found = sorted([tuple(r) for r in pivot_dedup.near_vectors(df).collect()], key=str)
    want = sorted(brute(rows), key=str)
    linked = sum(w[1] for w in want)
    assert linked > 100 and sum(f[1] for f in found) >= 0.97 * linked
    assert all(f[1] <= w[1] for f, w in zip(found, want, strict=True)) and [f[0] for f in found] == [w[0] for w in want]


def test_recall_on_the_table(spark, small):
    found = pivot_dedup.op7_pivot_dedup(spark, small).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute(rows)
    assert sum(r.n_links for r in found) >= 0.9 * sum(w[1] for w in want) and len(found) == len(rows)
    assert pivot_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
