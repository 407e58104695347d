"""Lempel-Ziv phrase fingerprints.

A text is parsed into phrases: each phrase is the shortest piece not yet in
the dictionary, and enters it. The phrases follow each other without gaps, so
all of them are hashed in one pass over the code points. The hashed set is
summarised by minimum hashes: ``BINS`` bins by part of the hash, each holding
the smallest hash that fell into it (or none). Two signatures agree in about
the share of phrases both texts have, a likeness in the sense of compression:
what one dictionary already holds costs the other little.

Next-document edits: documents are dealt into ranges of the id, cut at ids of
the table itself; the first document of a range also goes to the range before
it (the very first to the last one), so each task sees every document with
its successor and the text moves once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsense.llm.common import bounded_batches, id_text

BINS = 128
EMPTY = 0xFFFF                     # mark of a bin no phrase fell into
_MULT = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 20
RANGE_BYTES = 128 << 20            # text that a range holds at most, documents larger than it apart


def parse(text: str, known: set, start: int = 0) -> list[int]:
    """Starts of the phrases of ``text[start:]``; the phrases join ``known``.

    The dictionary holds every prefix of its phrases, so whether a piece is
    known falls once as it grows: the search for its length begins at the last
    phrase's length and walks up or down.
    """
    starts, i, n, size = [], start, len(text), 4
    add = known.add
    while i < n:
        p = text[i:i + size]
        if p in known:
            size = len(p) + 1
            while i + size <= n and (p := text[i:i + size]) in known:
                size += 1
        else:
            size = len(p)
            while size > 1 and (q := text[i:i + size - 1]) not in known:
                p, size = q, size - 1
        add(p)
        starts.append(i)
        i += size
    return starts


def phrase_hashes(text: str, starts: list[int]) -> np.ndarray:
    """64-bit hash of each phrase: a polynomial of its code points, mixed."""
    if not starts:
        return np.zeros(0, dtype=np.uint64)
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    at = np.asarray(starts, dtype=np.int64)
    sizes = np.diff(np.append(at, len(points)))
    place = np.arange(len(points)) - np.repeat(at, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _MULT, dtype=np.uint64))
    with np.errstate(over="ignore"):
        h = np.add.reduceat((points + np.uint64(1)) * powers[place], at) ^ sizes.astype(np.uint64)
        for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(mult)
    return h ^ (h >> np.uint64(31))


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 mixed bits of the smallest hash in each bin, EMPTY where none."""
    sig = np.full(BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(sig, (hashes % np.uint64(BINS)).astype(np.int64), hashes // np.uint64(BINS))
    with np.errstate(over="ignore"):
        out = ((sig + np.uint64(1)) * _MULT >> np.uint64(48)).astype(np.int64)
    return np.where(sig == np.iinfo(np.uint64).max, EMPTY, np.minimum(out, EMPTY - 1)).astype(np.uint16)


def fingerprint(text: str) -> np.ndarray:
    return signature(phrase_hashes(text, parse(text, set())))


def to_hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those not empty in both; two empty texts: 1."""
    used = (a != EMPTY) | (b != EMPTY)
    return float((a[used] == b[used]).mean()) if used.any() else 1.0


def edited_fingerprint(text: str, starts: list[int], keep: int, tail: str) -> np.ndarray:
    """Fingerprint of ``text[:keep] + tail``, reusing the phrases of ``text``
    that end before the change (the last one may be cut short by the text's
    end and is read again)."""
    same = min(int(np.searchsorted(np.asarray(starts + [len(text)]), keep, side="right")) - 1, len(starts) - 1)
    same = max(same, 0)
    whole = text[:keep] + tail
    at = starts[:same]
    cut = starts[same] if same < len(starts) else len(text)
    known = {text[a:b] for a, b in zip(at, at[1:] + [cut])}
    return signature(phrase_hashes(whole, at + parse(whole, known, cut)))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()),
                  ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                  ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _pairs(batches):
    """Rows in order of (range, place): each document with the next one."""
    out: list[tuple] = []
    size = 0
    prev = None                         # (range, id, text, phrase starts, signature)

    def emit(nxt):
        rng, doc_id, text, starts, sig = prev
        n = len(text)
        half = n // 2
        tail = nxt[1][:half] if nxt else ""
        esig = edited_fingerprint(text, starts, n - half, tail)
        out.append((doc_id, n, text[:n - half] + tail, to_hex(sig), to_hex(esig), likeness(sig, esig),
                    likeness(sig, nxt[0]) if nxt else None))
        return n

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _OUT)], schema=_OUT)

    for b in batches:
        for rng, ahead, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("range", "ahead", "doc_id", "text"))):
            if ahead and (prev is None or prev[0] != rng):
                continue                # a further row of the next range's first id
            starts = parse(text, set())
            sig = signature(phrase_hashes(text, starts))
            if prev is not None:
                size += emit((sig, text) if prev[0] == rng >= 0 else None)      # below 0: rows without id
            prev = None if ahead else (rng, doc_id, text, starts, sig)
            if size > BLOCK or len(out) >= 2000:
                yield batch()
                out, size = [], 0
    if prev is not None:
        emit(None)
    if out:
        yield batch()


def cut_points(docs: DataFrame, ranges: int) -> tuple[list[int], int | None]:
    """Ids at which the ranges begin (the first one left out) and the smallest id."""
    steps = [i / ranges for i in range(1, ranges)]
    row = docs.agg(F.min("doc_id").alias("lo"),
                   F.percentile_approx("doc_id", steps, max(10000, 10 * ranges)).alias("cuts") if steps
                   else F.array().cast("array<bigint>").alias("cuts")).first()
    lo = row["lo"]
    return sorted({int(c) for c in row["cuts"] or [] if c > lo}), lo


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Every whole text with its edited text, both fingerprints and likenesses:
    ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next``.

    In the edited text the last half (rounded down) gives way to as many first
    characters of the next document by id (all of them if it has fewer); after
    the last comes the first. NULL text is empty; two empty texts are fully
    alike (1), an empty and a non-empty one not at all (0). Rows of one id
    follow each other in the order of their texts. A row without id has no
    next document: its second half is dropped and ``near_next`` is NULL. A
    single row is its own successor. Other columns are not read. An empty
    table gives no rows. Texts of any length are parsed whole.

    ``ranges`` is by default four times the shuffle partitions and more where the
    texts are too large for that (``RANGE_BYTES``).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = id_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    if ranges is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    cuts, lo = cut_points(rows.select("doc_id"), ranges)
    last = len(cuts)

    @F.arrow_udf("bigint")
    def placed(ids: pa.Array) -> pa.Array:
        """Twice the range of an id, plus one when the id begins it."""
        want = np.asarray(cuts, dtype=np.int64)
        x = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.searchsorted(want, x, side="right")
        begins = (at > 0) & (np.append(want, 0)[at - 1] == x)
        return pa.array(2 * at + begins, pa.int64())

    own = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(ranges))).otherwise(
        F.shiftright("place", 1))
    before = (F.when(F.col("doc_id") == F.lit(lo), F.lit(last).cast("bigint"))
              .when(F.col("doc_id").isNotNull() & (F.col("place") % 2 == 1), F.shiftright("place", 1) - 1))
    dealt = (rows.withColumn("place", placed("doc_id"))
             .withColumn("own", own).withColumn("before", before)
             .select("doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(
                 F.struct(F.col("own").alias("range"), F.lit(False).alias("ahead")))).otherwise(F.array(
                     F.struct(F.col("own").alias("range"), F.lit(False).alias("ahead")),
                     F.struct(F.col("before").alias("range"), F.lit(True).alias("ahead"))))).alias("to"))
             .select("to.range", "to.ahead", "doc_id", "text"))
    ordered = (dealt.repartition(ranges, "range").sortWithinPartitions("range", "ahead", "doc_id", "text"))
    return ordered.mapInArrow(_pairs, "doc_id bigint, n_chars bigint, edited string, fingerprint string, "
                                      "edited_fingerprint string, near_edited double, near_next double")


def lz_report(docs: DataFrame) -> DataFrame:
    """``with_next`` with the edited text as its SHA-256."""
    return (with_next(docs).withColumn("edited_sha256", F.sha2("edited", 256))
            .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                    "near_edited", "near_next"))
