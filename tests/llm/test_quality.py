"""The quality network: gradients, plain evaluation, held-out accuracy, unusual rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsense.llm import quality as Q


def plain_probability(net, data):
    """One text, window by window and chunk by chunk."""
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    halves = max(1, -(-len(data) // Q.HALF))
    ids = list(data) + [Q.PAD] * (halves * Q.HALF - len(data) + Q.WIDTH)
    tops = []
    for h in range(halves):
        answers = []
        for i in range(Q.WINDOWS):
            at = h * Q.HALF + i * Q.STRIDE
            x = np.concatenate([w["bytes"][b] for b in ids[at:at + Q.WIDTH]])
            answers.append(x @ w["filters"] + w["filter_bias"])
        tops.append(np.max(answers, axis=0))
    chunks = [tops] if halves == 1 else [tops[i:i + 2] for i in range(halves - 1)]
    feats = [np.maximum(np.maximum(np.max(c, axis=0), 0) @ w["dense"] + w["dense_bias"], 0) for c in chunks]
    logit = np.concatenate([np.mean(feats, axis=0), np.max(feats, axis=0)]) @ w["out"] + w["out_bias"][0] + net.shift
    return 1 / (1 + np.exp(-logit))


TEXTS = [b"", b"a", b"Some words here. " * 9, bytes(range(256)) * 3, b"x" * 256, b"y" * 257, b"ab " * 400, "é ".encode() * 999]


def test_equals_plain_evaluation(monkeypatch):
    net = Q.Network.fresh(3)
    net.weights = {k: v * 3 + 0.05 for k, v in net.weights.items()}
    want = [plain_probability(net, t) for t in TEXTS]
    np.testing.assert_allclose(net.probabilities(TEXTS), want, rtol=1e-4)
    monkeypatch.setattr(Q, "PIECE_HALVES", 2)             # every longer text in pieces
    np.testing.assert_allclose(net.probabilities(TEXTS), want, rtol=1e-4)


def test_gradients_equal_differences():
    net = Q.Network.fresh(4)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rows, y = [Q.halves_of(t) for t in TEXTS[1:5]], np.array([1.0, 0, 1, 0])

    def loss():
        # float64 all the way: the stride trick reads 4-byte steps, so use the plain version
        p = np.array([plain_probability(net, t) for t in TEXTS[1:5]])
        return -np.mean(np.log(np.where(y == 1, p, 1 - p)))

    single = Q.Network({k: v.astype(np.float32) for k, v in net.weights.items()})
    found, grads = single.gradients(rows, y.astype(np.float32))
    assert abs(found - loss()) < 1e-5
    rng = np.random.default_rng(0)
    for name, g in grads.items():
        flat = net.weights[name].reshape(-1)
        strong = np.argsort(-np.abs(np.asarray(g).reshape(-1)))[:20]
        for i in rng.choice(strong, size=min(4, len(strong)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - np.asarray(g).reshape(-1)[i]) < 2e-4, name


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def reports(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    return Q.quality_report(docs, labels).join(labels, "doc_id").where("held_out").collect()


def test_held_out_accuracy(reports):
    good = [r["score"] for r in reports if r["quality"] == 1]
    bad = [r["score"] for r in reports if r["quality"] == 0]
    assert len(good) > 500 and len(bad) > 80
    auc = np.mean([(g > b) + 0.5 * (g == b) for b in bad for g in good])
    assert auc > 0.98
    assert np.mean([r["predicted"] for r in reports if r["quality"] == 1]) > 0.98
    assert np.mean([r["predicted"] for r in reports if r["quality"] == 0]) < 0.2
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in reports)


def test_learns_without_held_out_rows(tables, monkeypatch):
    docs, labels = tables
    seen = []
    monkeypatch.setattr(Q, "fit", lambda texts, y: seen.extend(zip(texts, y)) or Q.Network.fresh())
    Q.train(docs, labels)
    allowed = {(r["text"].encode(), r["quality"]) for r in docs.join(labels, "doc_id").collect()
               if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    assert seen and set(seen) <= allowed
    seen.clear()
    Q.train(docs, labels, per_label=10)
    assert sorted(y for _, y in seen) == [0] * 10 + [1] * 10
    # labels, language, source and id are no inputs: other values change nothing
    a = Q.score(docs, Q.Network.fresh()).select("score").collect()
    b = Q.score(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None)), Q.Network.fresh()).select("score")
    assert sorted(a) == sorted(b.collect())


def test_unusual_rows(docs_of, clashing, spark):
    net = Q.Network.fresh()
    rows = [(1, None), (2, ""), (3, "Words."), (3, "Words."), (None, "Words."), (4, "z" * 3_000_000), (5, " " * 1_000_000)]
    out = Q.score(clashing(docs_of(rows)), net).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[1] == by[2] and by[3] == by[None] and all(0 <= s <= 1 for s in by.values())
    assert Q.score(docs_of([]), net).count() == 0
    ids = "doc_id bigint, quality int"
    assert Q.train(docs_of([]), spark.createDataFrame([], ids)) == 0.5
    assert Q.train(docs_of([(1, "x")]), spark.createDataFrame([(1, None), (None, 1)], ids)) == 0.5
    known = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = docs_of([(i, "text") for i in range(20)])
    assert Q.train(docs, spark.createDataFrame([(i, 1) for i in known], ids)) == 1.0
    torn = [(known[0], 0), (known[0], 1), *[(i, 0) for i in known[1:]]]
    assert Q.train(docs, spark.createDataFrame(torn, ids)) == 0.0
    assert [r["predicted"] for r in Q.score(docs, 0.0).collect()] == [0] * 20
