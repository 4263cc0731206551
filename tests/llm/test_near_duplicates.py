import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import embeddings, minhash, mixing, simhash
from veilspark.llm.components import connected_components


def groups(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_definition(spark, documents, odd_docs):
    for r in documents.limit(40).unionByName(odd_docs.where("doc_id != 10 or doc_id is null"), allowMissingColumns=True).select("text").collect():
        assert simhash.simhash(r["text"]) == plain_simhash(r["text"])
    assert spark.sql("select xxhash64('a b c') as h").first()["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_simhash_classes_equal_brute_force(spark, documents, odd_docs):
    docs = documents.select("doc_id", "text").unionByName(odd_docs.where("doc_id is not null").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    got = sorted((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    rows = sorted((r["doc_id"], plain_simhash(r["text"])) for r in docs.collect())
    close = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 3]
    assert close
    ids = groups(len(rows), close)
    assert got == sorted((d, f, rows[ids[i]][0]) for i, (d, f) in enumerate(rows))


def test_pigeonhole_misses_nothing(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 6), replace=False)) for b in base]
    fps = sorted({*map(int, base), *near})
    got = {(r["a"], r["b"]) for r in simhash.close_pairs(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3} and got


def test_deduplicate_keeps_one(odd_docs, no_docs):
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and not {2, 3, 5, 6} & set(ids)
    assert simhash.deduplicate(no_docs).count() == 0


@pytest.mark.parametrize(("few", "tile"), [(16, 1024), (1, 2)])
def test_deduplicate_by_likeness(spark, documents, monkeypatch, few, tile):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "TILE_ROWS", tile)
    rng, words = np.random.default_rng(5), [f"w{i}" for i in range(500)]
    made = []
    for g in range(12):
        base = [words[k] for k in rng.integers(0, 500, 120)]
        for c in range(5):  # from copy to copy one more word differs, so that the first and the last may be far apart
            made.append((5000 + 10 * g + c, " ".join(base)))
            base[int(rng.integers(0, 120))] = f"x{g}-{c}"
            base[int(rng.integers(0, 120))] = f"y{g}-{c}"
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id bigint, text string"))
    got = sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect())
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    fps = [plain_simhash(t) for _, t in rows]
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    alike = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b)
    strict = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    assert set(close) - set(strict)
    ids = groups(len(rows), strict + close)
    assert got == [rows[i][0] for i in range(len(rows)) if ids[i] == i]


def test_rows_without_id_stay(spark):
    texts = [(None, "alone and without a key"), (None, "alone and without a key"), (None, "another text that has no key"), (7, "with a key"), (None, "With a KEY"), (8, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id bigint, text string, source string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in simhash.deduplicate(docs).collect())
    assert got == [("7", "with a key"), ("8", None), ("None", "alone and without a key"), ("None", "another text that has no key")]
    mixed = mixing.resample(docs.where("doc_id is null"), weights=lambda i: 1.0).collect()
    assert {r["text"] for r in mixed} == {t for i, t in texts if i is None}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    got = {r["v"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert connected_components(edges.where("false")).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((6, 16))
    x = [centre[i % 6] + 0.08 * rng.standard_normal(16) for i in range(150)] + list(rng.standard_normal((60, 16)))
    rows = [(i, [float(v) for v in np.float32(x[i])], int(i % 2)) for i in range(len(x))]
    rows += [(1000 + i, rows[0][1], 0) for i in range(5)] + [(1010, [2 * v for v in rows[0][1]], 0)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [None] + [1.0] * 15, 0), (2003, [float("inf")] + [1.0] * 15, 0), (2004, rows[0][1], None), (2005, [float("nan")] * 16, 0), (2006, [1.0, 2.0], 0), (2007, [], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("n", F.lit("clash")).withColumn("rep", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()}
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    pairs = [(a, b) for a in range(len(good)) for b in range(a) if good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= 0.98]
    assert len(pairs) > 100
    ids = groups(len(good), pairs)
    want = {i: (0, i, True) for i, _, _ in rows}
    for k, (i, _, _) in enumerate(good):
        want[i] = (sum(k in p for p in pairs), good[ids[k]][0], good[ids[k]][0] == i)
    assert got == want


def test_embeddings_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    monkeypatch.setattr(embeddings, "SMALL", 4)
    rng = np.random.default_rng(3)
    x = np.float32(rng.standard_normal(8) + 0.02 * rng.standard_normal((90, 8)))
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = (u @ u.T >= 0.98).sum(1) - 1
    assert {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()} == dict(enumerate(links.tolist()))
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_embeddings_without_or_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (None, [1.0, 0.02], 0), (None, [-1.0, 0.0], 0), (None, [-1.0, 0.0], 0), (3, [0.0, 1.0], 1), (None, None, 0), (1, [1.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, cid string, n int")
    got = sorted(map(str, [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()]))
    want = [(1, 3, 1, True), (1, 0, 1, True), (2, 3, 1, False), (None, 3, 1, False), (None, 1, None, True), (None, 1, None, True), (3, 0, 3, True), (None, 0, None, True), (1, 3, 1, True)]
    assert got == sorted(map(str, want))


def test_recall_of_embeddings(spark):
    """Ids divisible by 50 against all rows, at the hardest cosines."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.standard_normal((3000, 64))
    away -= (away * x).sum(1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    cos = rng.uniform(0.9801, 0.984, 3000)[:, None]
    both = np.float32(np.concatenate([x, cos * x + np.sqrt(1 - cos * cos) * away]))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(both)], "vec_id bigint, embedding array<float>, label int")
    links = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    u = both.astype(float) / np.linalg.norm(both.astype(float), axis=1)[:, None]
    asked = range(0, 6000, 50)
    want = (u[::50] @ u.T >= 0.98).sum(1) - 1
    assert want.sum() >= 115 and sum(links[i] for i in asked) >= 0.99 * want.sum() and all(links[i] <= k for i, k in zip(asked, want, strict=True))


def test_unlike_vectors_hardly_meet():
    """Pairs that share a cell, all groups together, grow in proportion to the vectors."""
    rng = np.random.default_rng(8)
    met = []
    for n in (500, 4000, 32000):
        groups, lines = embeddings.shape(n)
        u = rng.standard_normal((n, 64))
        keys = embeddings.cells(u / np.linalg.norm(u, axis=1)[:, None], groups, lines)
        met.append(sum(int((c * (c - 1) // 2).sum()) for c in (np.unique(keys[:, g], return_counts=True)[1] for g in range(groups))) / n)
    assert max(met) <= 4 and met[2] <= 3 * met[0]
