"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint has bit i set when more than half of its shingle
hashes (XXH64, seed 42, of ``width`` lower-cased words) have it set. Distinct
fingerprints that differ in at most ``radius`` bits are linked and the
components of the links are the groups.

Candidates: the 64 bits are cut into blocks, of which two fingerprints within
the radius share all but ``radius``, so each fingerprint enters one bucket for
every choice of that many blocks. The more fingerprints there are, the more blocks
(``blocks_for``), hence the longer the shared key: the fingerprints that meet in a
bucket by chance stay few at any size. A bucket above ``split`` fingerprints is dealt
into parts, and every pair of parts is a unit of its own; no bucket meets in
one task and no candidate is left out. Inside a unit the fingerprints stand as
bit planes (plane p holds bit p of 64 fingerprints per word). One fingerprint
is compared with 64 others at a time: the differing planes go into a
carry-save counter of four bit planes whose top is sticky, and a word of 64 is
abandoned as soon as all of its distances exceed the radius. A unit gives
a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsense.llm.common import bounded_batches, id_text, keep_rows, saved

WIDTH = 4
RADIUS = 4
SEED = 42
SPLIT = 4096
CHANCE = 8                      # fingerprints that share a bucket's key by chance
MOST_BLOCKS = 9                 # 126 buckets a fingerprint, keys of 35 bits
SHINGLES_AT_ONCE = 1 << 15
ABANDON_EVERY = 8
ROWS_AT_ONCE = 1 << 16          # candidate rows a task gathers before comparing whole units


def simhash(text: str | None, width: int = WIDTH) -> int:
    """64-bit fingerprint; a text without words has 0."""
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lens + 1) - 1
    k = min(width, n)
    total = n - k + 1
    starts = (ends - lens)[:total].tolist()
    stops = ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, total, SHINGLES_AT_ONCE):
        hs = np.fromiter([digest(joined[a:b], SEED) for a, b in
                          zip(starts[lo:lo + SHINGLES_AT_ONCE], stops[lo:lo + SHINGLES_AT_ONCE])], dtype=">u8")
        ones += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_FP_ARROW = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _fingerprint_rows(width: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").cast(pa.int64()),
                pa.array([signed(simhash(t, width)) for t in b.column("text").to_pylist()], pa.int64())],
                schema=_FP_ARROW)
    return run


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, fp`` per row (fp as a signed 64-bit number)."""
    return id_text(docs).mapInArrow(_fingerprint_rows(width), "doc_id bigint, fp bigint")


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Blocks for ``n`` fingerprints: the fewest (two more than the radius at
    least) with which at most ``CHANCE`` random ones share a key."""
    blocks = radius + 2
    while blocks < MOST_BLOCKS and n > CHANCE << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def block_masks(radius: int, blocks: int | None = None) -> list[tuple[int, int]]:
    """For each choice of ``blocks - radius`` of the blocks: (number, mask)."""
    n = blocks or radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    return [(t, sum(masks[i] for i in pick)) for t, pick in enumerate(combinations(range(n), n - radius))]


class Forest:
    """Union-find over 0..n-1, vectorised; the root is the smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while True:
            ra, rb = p[a], p[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                q = p[p]
                if (q == p).all():
                    break
                p[:] = q


def close_links(fps: np.ndarray, ends: np.ndarray, radius: int = RADIUS, at_once: int = 1 << 16) -> np.ndarray:
    """Root of every row, linking rows i < j < ends[i] whose fingerprints
    (uint64) differ in at most ``radius`` (at most 7) bits."""
    n = len(fps)
    words = (n + 63) // 64
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)     # rows x planes
    padded = np.zeros((words * 64, 64), dtype=np.uint8)
    padded[:n] = bits
    planes = np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view("<u8").reshape(64, words)
    masks = (np.uint64(0) - bits.T.astype(np.uint64))                                  # planes x rows: all ones or 0
    i = np.arange(n)
    first, last = (i + 1) >> 6, (ends - 1) >> 6
    count = np.where(ends > i + 1, last - first + 1, 0)
    query = np.repeat(i, count)
    word = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(query))
    forest = Forest(n)
    full = ~np.uint64(0)
    lanes = np.arange(64, dtype=np.uint64)
    # the counter starts so that its sticky top is set by the (radius + 1)-th difference
    start = 8 - (radius + 1)
    for lo in range(0, len(query), at_once):
        q, w = query[lo:lo + at_once], word[lo:lo + at_once]
        c = [np.full(len(q), full if start >> k & 1 else 0, dtype=np.uint64) for k in range(3)]
        base = w << 6
        # lanes outside (q, end of q's unit) count as exceeded from the start
        low = np.clip(q + 1 - base, 0, 64).astype(np.uint64)
        high = np.clip(ends[q] - base, 0, 64).astype(np.uint64)
        below = np.where(low >= 64, full, (np.uint64(1) << (low % np.uint64(64))) - np.uint64(1))
        upto = np.where(high >= 64, full, (np.uint64(1) << (high % np.uint64(64))) - np.uint64(1))
        over = ~upto | below
        for p in range(64):
            carry = planes[p][w] ^ masks[p][q]
            for k in range(3):
                c[k], carry = c[k] ^ carry, c[k] & carry
            over |= carry
            if p % ABANDON_EVERY == ABANDON_EVERY - 1:
                alive = over != full
                if not alive.any():
                    q = q[:0]
                    break
                if not alive.all():
                    q, w, over = q[alive], w[alive], over[alive]
                    c = [x[alive] for x in c]
        if not len(q):
            continue
        near = ~over
        for part in range(0, len(q), 1 << 12):
            hit = (near[part:part + (1 << 12), None] >> lanes) & np.uint64(1)
            r, lane = np.nonzero(hit)
            forest.union(q[part + r], (w[part + r] << 6) + lane)
    return forest.parent


_LINK_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link_rows(radius: int):
    """Links of rows sorted by (bucket, unit); a unit may span batches."""
    def flush(bucket, unit, fp):
        change = np.nonzero((bucket[1:] != bucket[:-1]) | (unit[1:] != unit[:-1]))[0] + 1
        bounds = np.concatenate([change, [len(fp)]])
        ends = np.repeat(bounds, np.diff(np.concatenate([[0], bounds])))
        root = close_links(fp.view(np.uint64), ends, radius)
        moved = root != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], schema=_LINK_ARROW)

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "unit", "fp")])
            rows += b.num_rows
            if rows < ROWS_AT_ONCE:
                continue
            all_ = [np.concatenate(x) for x in zip(*held)]
            # the last unit may go on in the next batch
            cut = int(np.argmax((all_[0] == all_[0][-1]) & (all_[1] == all_[1][-1])))
            if cut:
                yield flush(*[x[:cut] for x in all_])
            held, rows = [[x[cut:] for x in all_]], len(all_[0]) - cut
        if rows:
            yield flush(*[np.concatenate(x) for x in zip(*held)])
    return run


def links(nodes: DataFrame, radius: int = RADIUS, split: int = SPLIT, blocks: int | None = None) -> DataFrame:
    """``a, b``: links that connect all fingerprints of ``nodes`` (distinct
    ``fp``) within the radius, as spanning forests of the candidate units."""
    masks = block_masks(radius, blocks or blocks_for(nodes.count(), radius))
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(signed(m)))) for t, m in masks])
    cand = nodes.select("fp", F.explode(keys).alias("bucket"))
    sizes = cand.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(split)).cast("int")
    dealt = (cand.join(sizes, "bucket").withColumn("parts", parts)
             .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
             .select("bucket", "fp", F.explode(F.transform(
                 F.sequence(F.lit(0), F.col("parts") - 1),
                 lambda j: F.least(j, F.col("part")) * F.col("parts") + F.greatest(j, F.col("part")))).alias("unit")))
    ordered = dealt.repartition("bucket", "unit").sortWithinPartitions("bucket", "unit", "fp")
    return ordered.mapInArrow(_link_rows(radius), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of every component, for nodes with an
    edge other than roots themselves.

    Alternates two steps until nothing changes: every node's larger
    neighbours are linked to its smallest neighbour, then its smaller ones
    are. Each step is one aggregate and one join (a hot node's edges may be
    split by the join); the edges are saved after each round, so lineage stays
    short and a lost executor costs one round at most. The end is reached when a
    round's edges are the very edges of the round before.
    """
    e = saved(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
              .where("hi > lo").distinct())

    n = e.count()
    while n:
        before, n_before = e, n
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # the minima are saved: a join of plain shuffles can split a hot node's edges
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(smallest, "hi")
        e = saved(small.select(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo")).where("hi > lo")
                  .unionByName(smallest.select("hi", F.col("m").alias("lo"))).distinct())
        n = e.count()
        # both are sets: of one size and without a new edge they are the same
        if n == n_before and e.join(before, ["hi", "lo"], "left_anti").isEmpty():
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def near_groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """``doc_id, fp, component_id, root`` per row of ``docs`` (``root`` is the
    smallest fingerprint of the group).

    ``component_id`` is the smallest id reachable over links, the row's own
    included; equal fingerprints are always linked. NULL and empty texts, and
    texts of white space only, have fingerprint 0 and are linked like any
    other. NULL ids are larger than any id (a group of NULL ids only has
    component NULL). Repeated rows are one group. Other columns are not read.
    An empty table gives no rows. Texts of any length are read whole, their
    shingles hashed ``SHINGLES_AT_ONCE`` at a time.
    """
    bounded_batches(docs.sparkSession)
    fps = saved(fingerprints(docs, width))
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    comp = components(links(nodes.select("fp"), radius, split))
    rooted = (nodes.join(comp, nodes["fp"] == comp["node"], "left")
              .select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    # saved, so that Spark can split a hot group in the join (both sides are plain shuffles)
    ids = saved(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    named = rooted.join(ids, "root").select("fp", "component_id", "root")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def simhash_near_dedup(docs: DataFrame, **kw) -> DataFrame:
    """``doc_id, fingerprint`` (16 lowercase hex digits) ``, component_id``."""
    return near_groups(docs, **kw).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                          "component_id")


def drop_near_copies(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """``docs`` with one document per group, the one of the smallest id (of
    rows that share this id, the one of the smallest fingerprint; of rows equal in
    both the smallest by all columns).

    Texts without words (NULL, empty, blank) are one group with whatever links to
    fingerprint 0. Rows without id stay only where their group has none with an id.
    Columns of any name are kept, an empty table stays empty, texts are read whole."""
    g = near_groups(docs, width, radius, split)
    rows = g.groupBy("doc_id", "fp", "root").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    first = rows.groupBy("root").agg(F.min(order).alias("first"))
    d = rows.join(first, "root").select("doc_id", F.col("fp").alias("key"), "n", (
        F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("fp") == F.col("first.fp"))).alias("kept"))

    @F.arrow_udf("bigint")
    def fp_of(text: pa.Array) -> pa.Array:
        return pa.array([signed(simhash(t, width)) for t in text.to_pylist()], pa.int64())

    return keep_rows(docs, saved(d), lambda r: r.withColumn("_key", fp_of("text")))
