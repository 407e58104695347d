"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and every second position starts a window of
``WIDTH`` bytes that all filters see. Each filter's largest answer within a chunk
of ``2 * HALF`` bytes counts (chunks overlap by half, the last window of a half
reads on into the next), a dense layer turns a chunk's maxima into chunk
features, and the mean and the maximum of these over all chunks give one
logit. The whole text is covered, in pieces of bounded size.

Trained here by Adam on a bounded, balanced sample of labelled rows; the
corpus's own share of each label then shifts the logit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsense.llm.common import bounded_batches, id_text

EMBEDDED, WIDTH, STRIDE, HALF, FILTERS, DENSE = 8, 8, 2, 256, 32, 16
WINDOWS = HALF // STRIDE
PAD = 256                      # stands after the end of a text
PER_LABEL = 1000               # rows learned from, each label
LONGEST_LEARNED = 1 << 16      # bytes; longer texts are scored whole but not learned from
EPOCHS, DOCS_A_STEP, RATE, SEED = 12, 32, 4e-3, 5
PIECE_HALVES = 2048            # halves computed at once
THRESHOLD = 0.7


def halves_of(data: bytes) -> np.ndarray:
    """Byte numbers, one row per half; the rest of the last row is padding."""
    n = max(1, -(-len(data) // HALF))
    out = np.full(n * HALF, PAD, dtype=np.int16)
    out[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, HALF)


def _windows(ids: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Byte numbers of every window: ``(halves, WINDOWS, WIDTH)``; ``follow``
    holds the bytes after each half."""
    wide = np.concatenate([ids, follow], axis=1)
    return np.lib.stride_tricks.sliding_window_view(wide, WIDTH, axis=1)[:, ::STRIDE][:, :WINDOWS]


def _follow(ids: np.ndarray, last: np.ndarray) -> np.ndarray:
    """First bytes of the next half of the same text, padding after its last."""
    out = np.full((len(ids), WIDTH), PAD, dtype=ids.dtype)
    out[:-1] = ids[1:, :WIDTH]
    out[last] = PAD
    return out


@dataclass
class Network:
    """Weights: byte embedding, filters, dense layer, output."""
    weights: dict[str, np.ndarray]
    shift: float = 0.0

    @classmethod
    def fresh(cls, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape, size):
            return (rng.standard_normal(shape) * size).astype(np.float32)
        fan = EMBEDDED * WIDTH
        return cls({"bytes": normal(PAD + 1, EMBEDDED, size=0.5), "filters": normal(fan, FILTERS, size=fan ** -0.5),
                    "filter_bias": np.zeros(FILTERS, np.float32),
                    "dense": normal(FILTERS, DENSE, size=FILTERS ** -0.5), "dense_bias": np.zeros(DENSE, np.float32),
                    "out": normal(2 * DENSE, size=0.1), "out_bias": np.zeros(1, np.float32)})

    def answers(self, ids: np.ndarray, follow: np.ndarray) -> np.ndarray:
        """Every filter at every window: ``(halves, WINDOWS, FILTERS)``."""
        w = self.weights
        n = len(ids)
        wide = w["bytes"][np.concatenate([ids, follow], axis=1)].reshape(n, -1)
        step, fan = STRIDE * EMBEDDED, WIDTH * EMBEDDED
        at = np.lib.stride_tricks.as_strided(wide, (n, WINDOWS, fan), (wide.strides[0], 4 * step, 4))
        return (at.reshape(n * WINDOWS, fan) @ w["filters"]).reshape(n, WINDOWS, FILTERS)

    def half_maxima(self, ids: np.ndarray, follow: np.ndarray) -> np.ndarray:
        return self.answers(ids, follow).max(axis=1) + self.weights["filter_bias"]

    def chunk_features(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        w = self.weights
        pooled = np.maximum(np.maximum(left, right), 0)
        return np.maximum(pooled @ w["dense"] + w["dense_bias"], 0)

    def logit(self, data: bytes) -> float:
        """One whole text, ``PIECE_HALVES`` halves at a time. Texts are computed one
        by one, so equal texts have equal scores to the last bit."""
        total, top, chunks, before = np.zeros(DENSE), np.full(DENSE, -np.inf), 0, None
        step = PIECE_HALVES * HALF
        for lo in range(0, max(len(data), 1), step):
            ids = halves_of(data[lo:lo + step])
            follow = _follow(ids, np.array([len(ids) - 1]))
            after = data[lo + step:lo + step + WIDTH]
            follow[-1, :len(after)] = np.frombuffer(after, dtype=np.uint8)
            maxima = self.half_maxima(ids, follow)
            run = maxima if before is None else np.vstack([before, maxima])
            if len(run) > 1 or len(data) <= HALF:           # a text of one half is one chunk, of m halves m - 1
                f = self.chunk_features(run[:max(1, len(run) - 1)], run[-max(1, len(run) - 1):])
                total, top, chunks = total + f.sum(axis=0, dtype=np.float64), np.maximum(top, f.max(axis=0)), chunks + len(f)
            before = maxima[-1:]
        w = self.weights
        return float(np.concatenate([total / chunks, top]) @ w["out"]) + float(w["out_bias"][0]) + self.shift

    def probabilities(self, texts: list[bytes]) -> list[float]:
        """The probability of label 1 of each whole text."""
        logits = np.array([self.logit(t) for t in texts])
        return (1 / (1 + np.exp(-np.clip(logits, -60, 60)))).tolist()

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of the texts (rows of halves) and its gradients."""
        w = self.weights
        ids, count = np.concatenate(texts), np.array([len(t) for t in texts])
        last = np.cumsum(count) - 1
        follow = _follow(ids, last)
        z = self.answers(ids, follow)
        arg = z.argmax(axis=1)
        top = np.take_along_axis(z, arg[:, None], axis=1)[:, 0] + w["filter_bias"]
        doc = np.repeat(np.arange(len(texts)), count)
        start = np.ones(len(ids), bool)
        start[last[count > 1]] = False
        left = np.nonzero(start)[0]
        right = np.minimum(left + 1, last[doc[left]])
        use_right = top[right] > top[left]
        pooled = np.maximum(np.where(use_right, top[right], top[left]), 0)
        pre = pooled @ w["dense"] + w["dense_bias"]
        features = np.maximum(pre, 0)
        chunks = np.maximum(count - 1, 1)
        begin = np.cumsum(chunks) - chunks
        best = np.stack([b + features[b:b + c].argmax(axis=0) for b, c in zip(begin, chunks)])
        seen = np.hstack([np.add.reduceat(features, begin) / chunks[:, None],
                          np.take_along_axis(features, best, axis=0)])
        p = 1 / (1 + np.exp(-np.clip(seen @ w["out"] + w["out_bias"], -30, 30)))
        loss = -np.mean(np.log(np.where(labels == 1, p, 1 - p) + 1e-12))
        # backwards
        d_logit = ((p - labels) / len(texts)).astype(np.float32)
        d_seen = d_logit[:, None] * w["out"]
        d_features = np.repeat(d_seen[:, :DENSE] / chunks[:, None], chunks, axis=0)
        np.add.at(d_features, (best, np.arange(DENSE)), d_seen[:, DENSE:])
        d_pre = d_features * (pre > 0)
        d_pooled = (d_pre @ w["dense"].T) * (pooled > 0)
        d_top = np.zeros_like(top)
        np.add.at(d_top, left, np.where(use_right, 0, d_pooled))
        np.add.at(d_top, right, np.where(use_right, d_pooled, 0))
        at = _windows(ids, follow)[np.arange(len(ids))[:, None], arg]        # (halves, FILTERS, WIDTH)
        vectors = w["bytes"][at].reshape(len(ids), FILTERS, -1)
        d_bytes = (d_top[:, :, None] * w["filters"].T).reshape(-1, EMBEDDED)
        flat = at.ravel()
        return float(loss), {
            "bytes": np.stack([np.bincount(flat, d_bytes[:, j], PAD + 1) for j in range(EMBEDDED)], axis=1),
            "filters": np.einsum("hf,hfk->kf", d_top, vectors), "filter_bias": d_top.sum(axis=0),
            "dense": pooled.T @ d_pre, "dense_bias": d_pre.sum(axis=0),
            "out": seen.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network trained with Adam; the rate falls to zero along a cosine."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    rows, y = [halves_of(t) for t in texts], np.array(labels, dtype=np.float32)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    steps, step = epochs * -(-len(rows) // DOCS_A_STEP), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), DOCS_A_STEP):
            pick = order[lo:lo + DOCS_A_STEP]
            _, grads = net.gradients([rows[i] for i in pick], y[pick])
            step += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * step / steps))
            for k, g in grads.items():
                g = g.astype(np.float32)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.weights[k] = net.weights[k] - (rate * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: CRC-32 of the id as text, modulo 4, is 2 (a NULL id counts as no text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Network | float:
    """Fit on at most ``per_label`` rows of each label: those of the smallest
    hash of the id, without held-out rows, ids with contradicting labels and texts
    over ``LONGEST_LEARNED`` bytes. The shares of the labels are counted over all
    rows that may be learned from. With rows of one label only the answer is that label,
    with none 0.5."""
    bounded_batches(docs.sparkSession)
    marked = (labels.select("doc_id", F.col("quality").cast("int").alias("label"))
              .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
              .where("label = most").select("doc_id", "label"))
    usable = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
                        & (F.octet_length(F.coalesce("text", F.lit(""))) <= LONGEST_LEARNED))
    known = marked.join(usable.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    # the smallest hashes of a label lie below a limit known from its count
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 32).cast("double")
    limit = F.when(F.col("label") == 1, counts[1]).otherwise(counts[0])
    near = known.withColumn("h", h).where(F.col("h") * limit < float(4 * per_label * (1 << 32)))
    picked = (near.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id")))
              .where(F.col("rn") <= per_label).select("doc_id", "label"))
    rows = (usable.select("doc_id", "text").join(F.broadcast(picked), "doc_id")        # at most 2 * per_label ids
            .select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
            .limit(4 * per_label).collect())
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    net = fit([r["text"].encode() for r in rows], [r["label"] for r in rows])
    learned = sum(r["label"] for r in rows)
    net.shift = float(np.log(counts[1] / counts[0]) - np.log(learned / (len(rows) - learned)))
    return net


def score(docs: DataFrame, network: Network | float, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` per row, from the whole text alone.

    NULL text is empty; an empty text is scored as padding alone and so has one
    score wherever it stands, as all equal texts have. Texts of any length are
    read to their end in pieces. Repeated rows stay, NULL ids stay, other columns
    are not read. An empty table gives no rows. A network that could not be
    trained (``train``) gives its constant.
    """
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            texts = [t.encode() for t in b.column("text").to_pylist()]
            found = [network] * len(texts) if isinstance(network, float) else network.probabilities(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(found, pa.float64())],
                                             schema=schema)

    return (id_text(docs).mapInArrow(run, "doc_id bigint, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` with a network learned from the
    labelled rows that are not held out."""
    return (score(docs, train(docs, labels))
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"))
