import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.llm import mixing, packing, quality, toxicity


def auc(score, y):
    order = np.argsort(np.argsort(score))
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize(("model", "label", "threshold", "least"), [(quality, "quality", 0.7, 0.97), (toxicity, "toxic", 0.3, 0.9)])
def test_held_out_accuracy(spark, model, label, threshold, least, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = model.classify(docs.unionByName(odd_docs.withColumn("doc_id", F.col("doc_id") + 10**6), allowMissingColumns=True), labels).collect()
    assert len(rows) == docs.count() + odd_docs.count()
    y = {r["doc_id"]: r[label] for r in labels.collect()}
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    held = [(r["score"], y[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in y]
    assert auc(np.array([s for s, _ in held]), np.array([v for _, v in held])) >= least
    empty = {r["score"] for r in rows if r["doc_id"] in (10**6 + 4, 10**6 + 5, 10**6 + 6)}
    assert len(empty) == 1
    assert model.classify(no_docs, labels).count() == 0
    assert model.classify(docs.limit(3), labels.where("false")).count() == 3


def test_rejecting_keeps_columns(odd_docs, no_docs, labels):
    kept = toxicity.reject(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count() and toxicity.reject(no_docs, labels).count() == 0


def test_network_gradients():
    rng = np.random.default_rng(0)
    x, starts, y = rng.standard_normal((9, quality.N_FEATURES)), np.array([0, 4, 5, 9]), np.array([1.0, 0.0, 1.0])
    draw = lambda *s: 0.5 * rng.standard_normal(s)
    net = quality.Network({"E": draw(quality.N_FEATURES, 4), "e": draw(4), "V": draw(4, 3), "U": draw(4, 3), "w": draw(3), "c": draw(4), "b": draw(1), "mean": np.zeros(quality.N_FEATURES), "scale": np.ones(quality.N_FEATURES)})

    def loss():
        p = net.forward(x, starts)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, g in net.gradients(x, starts, y).items():
        flat = net.w[k].reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 5)):
            old, flat[i] = flat[i], flat[i] + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            assert abs((up - loss()) / 2e-5 - g.reshape(-1)[i]) < 1e-6
            flat[i] = old


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 30)), min_size=1, max_size=8), st.integers(0, 120))
def test_apportionment_equals_highest_quotients(parties, seats):
    votes, caps = [float(v) for v, _ in parties], [c for _, c in parties]
    want = [0] * len(votes)
    for _ in range(min(seats, sum(caps))):
        i = max((i for i in range(len(votes)) if want[i] < caps[i]), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
        want[i] += 1
    assert mixing.sainte_lague(votes, seats, caps) == want


def test_targets():
    assert mixing.targets([100, 100], [1, 3]) == [50.0, 150.0]
    assert mixing.targets([10, 190], [3, 1]) == [30.0, 170.0]
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [1, 1]) == [0.0, 5.0]


def test_mix(spark, odd_docs, no_docs, documents):
    for docs in (odd_docs, documents):
        rows = mixing.mix(docs).collect()
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect())) and len(rows) == docs.count()
        sums = {}
        for r in rows:
            assert 0 <= r["taken"] <= 3 * r["size"]
            key = (r["source_size"], r["target"])
            sums[key] = sums.get(key, 0) + r["taken"]
        if docs is documents:
            assert all(abs(v - t) <= 0.02 * t + 1 for (_, t), v in sums.items())
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(odd_docs).collect()}
    assert sizes[4] == sizes[5] == sizes[6] == 0 and sizes[8] == 2 and sizes[10] == 30_000
    assert mixing.mix(no_docs).count() == 0 and mixing.resample(no_docs).count() == 0
    assert mixing.resample(documents).columns == documents.columns


def test_hot_source_is_sharded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 10)
    docs = spark.createDataFrame([(i, "w " * (i % 40), "hot" if i % 3 else f"s{i % 2}") for i in range(300)], "doc_id bigint, text string, source string")
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["target"], []).append(r["taken"])
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(sum(v) - t) <= 0.02 * t + 8 for t, v in by.items())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary())


HARD = ["", " ", "\n\n word  two\t\tx \n", "don't 'LL <|endoftext|> 12345 +-=", "a\x1cb\x1d c\x85d\xa0e\u3000f \u2003 g", "éé e\u0301 ﬁ 日本語 😀😀  ", "x" * 300, " " * 40 + "y", "\r\n\r\n a\x0b\x0cb ", "١٢٣ ⅷ ²", "\u200b\ufeff z"]
HARD += ["a" + c * 150_000 + "b" for c in (" ", "\n", "x", "ab ", " \n", "\u3000")] + ["x" + " " * 2_000_000 + "y"]
HARD += ["hello <|endoftext|> there", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "in<|endoftext|>side", "ends <|endoftext|>", "  <|endoftext|>  ", "<|endoftext|", "<|<|endoftext|>|>", "<|ENDOFTEXT|>"]


def test_ids_equal_the_library(library, documents):
    for text in HARD + [r["text"] for r in documents.limit(60).collect()]:
        assert packing.encode(text, packing.vocabulary()).tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "  \n", "word", "<|"]), st.text(max_size=4)), max_size=8).map("".join)))
def test_ids_of_any_text(text):
    from tokenizers import Tokenizer

    global _LIBRARY
    if _LIBRARY is None:
        _LIBRARY = Tokenizer.from_file(packing.vocabulary())
    assert packing.encode(text, packing.vocabulary()).tolist() == _LIBRARY.encode(text, add_special_tokens=False).ids


_LIBRARY = None


def test_hilbert_is_a_walk():
    points = np.array([[a, b] for a in range(8) for b in range(8)])
    order = points[np.argsort(packing.hilbert(points, 3))]
    assert sorted(packing.hilbert(points, 3)) == list(range(64)) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_pack_is_an_exact_cover(spark, library, documents, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_CHARS", 60_000)
    docs = documents.select("doc_id", "text").unionByName(odd_docs.where("doc_id is not null and doc_id != 2").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = packing.pack(docs, packing.vocabulary()).collect()
    ids = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    pieces, sequences = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        part = np.array(own[r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(part.tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts, whole in [(sorted(p), len(ids[d])) for d, p in pieces.items()] + [(sorted(s), None) for s in sequences.values()]:
        at = 0
        for start, length in parts:
            assert start == at
            at += length
        assert at == whole if whole is not None else at <= 1024 and at & (at - 1) == 0
    assert set(pieces) == set(ids)
    assert packing.pack(no_docs, packing.vocabulary()).count() == 0


def test_taken_equals_blocks_laid_out(spark, monkeypatch):
    """Brute force: every shard's words in a list, cut into blocks, the selected ones counted word by word."""
    monkeypatch.setattr(mixing, "SHARD_DOCS", 25)
    docs = spark.createDataFrame([(i if i % 7 else None, f"w{i} " * (i * 7 % 90), ["a", "b", None, "hot"][min(3, i % 6)]) for i in range(300)], "doc_id bigint, text string, source string")
    docs = docs.unionByName(docs.where("doc_id % 50 = 1"))  # repeated rows
    rows = mixing._sized(docs)
    block = max(1, min(1024, min(r["s"] for r in rows.groupBy("mix_source").agg(F.sum("mix_size").alias("s")).collect()) // 512))
    laid, got_block = mixing._laid_out(rows, rows, lambda i: float(i % 3 + 1), 11, 1024)
    assert got_block == block
    want, times = [], []
    shards = {}
    for r in laid.withColumn("order", F.xxhash64(F.lit(11), "mix_key", "mix_size")).collect():
        shards.setdefault((r["sid"], r["mix_shard"]), []).append(r)
    for members in shards.values():
        members.sort(key=lambda r: (r["order"], r["mix_key"]))
        total = sum(r["mix_size"] for r in members)
        r0 = members[0]
        assert r0["mix_n"] == max(1, -(-total // block))
        chosen = {b for b in range(r0["mix_n"]) if ((b + 1) * r0["mix_rest"] + r0["mix_start"]) // r0["mix_n"] > (b * r0["mix_rest"] + r0["mix_start"]) // r0["mix_n"]}
        assert len(chosen) == r0["mix_rest"]
        at = 0
        for r in members:
            words = range(at, at + r["mix_size"])
            want.append((str(r["doc_id"]), r["mix_size"], r["mix_full"] * r["mix_size"] + sum(w // block in chosen for w in words)))
            if words:
                times += [(str(r["doc_id"]), r["text"])] * (r["mix_full"] + (words[len(words) // 2] // block in chosen))
            at += r["mix_size"]
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mixing.mix(docs).collect()) == sorted(want)
    assert sorted((str(r["doc_id"]), r["text"]) for r in mixing.resample(docs).collect()) == sorted(times)
