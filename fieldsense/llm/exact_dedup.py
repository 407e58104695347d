"""Exact de-duplication with composable polynomial fingerprints.

A text is normalised (each run of ASCII white space becomes one space) and
its UTF-8 bytes are read as the digits of a polynomial. Two residues of it,
modulo two 31-bit primes, and the byte count form the fingerprint. Hashes of
pieces compose: ``H(ab) = H(a) * r^len(b) + H(b)``. Pieces of one text are
hashed as one matrix product; the pieces of a huge text travel as rows, are
hashed on many tasks and meet again as a sum of length-shifted hashes.

Documents with equal fingerprints are then compared piece by piece: the
distinct pieces at each position of each fingerprint are counted, with a
partial aggregate, so copies of one text collapse on the map side and a
group of any size never meets in one task. Where a position has two
different pieces the fingerprint has collided and its documents are separated
by the SHA-256 of the normalised text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsense.llm.common import bounded_batches, id_text, keep_rows, saved

PRIMES = (2147483647, 2147483629)        # 2^31 - 1 and 2^31 - 19
BASES = (1103515245, 1664525)
PIECE_BYTES = 1 << 14                    # bytes hashed as one piece
HUGE_BYTES = 1 << 16                     # texts above this are hashed as pieces on many tasks
SPACE = b" \t\n\x0b\x0c\r"


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with each run of ASCII white space as one space."""
    raw = (text or "").encode("utf-8")
    if not raw:
        return raw
    body = b" ".join(raw.split())
    if not body:
        return b" "
    return (b" " if raw[0] in SPACE else b"") + body + (b" " if raw[-1] in SPACE else b"")


class Polynomial:
    """Piecewise polynomial hash modulo the two primes."""

    def __init__(self, primes=PRIMES, bases=BASES, piece: int = PIECE_BYTES):
        self.primes, self.piece = primes, piece
        self.bases = tuple(b % p for b, p in zip(bases, primes))
        self.powers = []
        for base, p in zip(self.bases, primes):
            w = np.empty(piece, dtype=np.uint64)
            x = 1
            for i in range(piece - 1, -1, -1):
                w[i] = x
                x = x * base % p
            self.powers.append(w)

    def pieces(self, data: bytes) -> list[list[int]]:
        """Hash of every piece (per prime); digits are byte + 1."""
        a = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        full = len(a) // self.piece
        out = []
        for w, p in zip(self.powers, self.primes):
            hs = (a[:full * self.piece].reshape(full, self.piece) @ w % np.uint64(p)).tolist()
            tail = a[full * self.piece:]
            if len(tail):
                hs.append(int(tail @ w[self.piece - len(tail):]) % p)
            out.append(hs)
        return out

    def shift(self, length: int) -> tuple[int, ...]:
        return tuple(pow(b, length, p) for b, p in zip(self.bases, self.primes))

    def combine(self, left: int, right: int, right_len: int, which: int) -> int:
        """Hash of the concatenation from the hashes of its parts."""
        p = self.primes[which]
        return (left * pow(self.bases[which], right_len, p) + right) % p

    def hash(self, data: bytes) -> int:
        """Both residues of the whole as one 62-bit number."""
        per_prime = self.pieces(data)
        res = []
        for which, hs in enumerate(per_prime):
            h, left = 0, len(data)
            for x in hs:
                n = min(self.piece, left)
                h = self.combine(h, x, n, which)
                left -= n
            res.append(h)
        return (res[0] << 31) | res[1]


ENTRY = "doc_id bigint, sha binary, fp bigint, n_bytes bigint, m bigint"
_ENTRY_ARROW = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("fp", pa.int64()),
                          ("n_bytes", pa.int64()), ("m", pa.int64())])


def _hash_rows(poly_args: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Polynomial(*poly_args)
        for b in batches:
            norm = [normalise(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").cast(pa.int64()),
                pa.array([hashlib.sha256(x).digest() for x in norm], pa.binary()),
                pa.array([poly.hash(x) for x in norm], pa.int64()),
                pa.array([len(x) for x in norm], pa.int64()),
                pa.array([1] * len(norm), pa.int64())], schema=_ENTRY_ARROW)
    return run


_PIECE = ("doc_id bigint, sha binary, n_bytes bigint, n_pieces bigint, idx bigint, "
          "shift1 bigint, shift2 bigint, piece binary")
_PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("n_bytes", pa.int64()),
                          ("n_pieces", pa.int64()), ("idx", pa.int64()), ("shift1", pa.int64()),
                          ("shift2", pa.int64()), ("piece", pa.binary())])


def _cut_rows(poly_args: tuple):
    """Normalised text as one row per piece with the shift of what follows it."""
    def run(batches):
        poly = Polynomial(*poly_args)
        step = poly.piece
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                data = normalise(text)
                sha, n = hashlib.sha256(data).digest(), len(data)
                starts = list(range(0, n, step)) or [0]
                for lo in range(0, len(starts), 64):
                    part = starts[lo:lo + 64]
                    shifts = [poly.shift(n - min(s + step, n)) for s in part]
                    k = len(part)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([doc_id] * k, pa.int64()), pa.array([sha] * k, pa.binary()),
                        pa.array([n] * k, pa.int64()), pa.array([len(starts)] * k, pa.int64()),
                        pa.array([s // step for s in part], pa.int64()),
                        pa.array([s[0] for s in shifts], pa.int64()),
                        pa.array([s[1] for s in shifts], pa.int64()),
                        pa.array([data[s:s + step] for s in part], pa.binary())], schema=_PIECE_ARROW)
    return run


_SHIFTED = "doc_id bigint, sha binary, n_bytes bigint, n_pieces bigint, s1 bigint, s2 bigint"
_SHIFTED_ARROW = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("n_bytes", pa.int64()),
                            ("n_pieces", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])


def _hash_pieces(poly_args: tuple):
    def run(batches):
        poly = Polynomial(*poly_args)
        for b in batches:
            hs = [poly.pieces(x) for x in b.column("piece").to_pylist()]
            shifted = [[(h[w][0] if h[w] else 0) * s % poly.primes[w]
                        for h, s in zip(hs, b.column(f"shift{w + 1}").to_pylist())] for w in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "sha", "n_bytes", "n_pieces")]
                + [pa.array(s, pa.int64()) for s in shifted], schema=_SHIFTED_ARROW)
    return run


def fingerprints(docs: DataFrame, huge_bytes: int = HUGE_BYTES, poly_args: tuple = ()) -> DataFrame:
    """``doc_id, sha, fp, n_bytes, m`` per distinct (id, normalised text);
    ``m`` rows of the input have it."""
    rows = id_text(docs)
    huge = F.octet_length("text") > huge_bytes
    small = rows.where(~huge).mapInArrow(_hash_rows(poly_args), ENTRY)
    primes = Polynomial(*poly_args).primes
    pieces = rows.where(huge).mapInArrow(_cut_rows(poly_args), _PIECE)
    large = (pieces.repartition("sha", "idx").mapInArrow(_hash_pieces(poly_args), _SHIFTED)
             .groupBy("doc_id", "sha", "n_bytes", "n_pieces")
             .agg(F.count(F.lit(1)).alias("c"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
             # rows with equal id and text bring every piece several times
             .withColumn("m", F.expr("c div n_pieces"))
             .select("doc_id", "sha",
                     F.expr(f"shiftleft((s1 div m) % {primes[0]}, 31) | ((s2 div m) % {primes[1]})").alias("fp"),
                     "n_bytes", "m"))
    return (small.unionByName(large).groupBy("doc_id", "sha", "fp", "n_bytes")
            .agg(F.sum("m").alias("m")))


def _compare_rows(piece_bytes: int):
    """Pieces of the rows whose text has the wanted hash."""
    schema = pa.schema([("fp", pa.int64()), ("n_bytes", pa.int64()), ("idx", pa.int64()), ("piece", pa.binary())])

    def run(batches):
        for b in batches:
            for want, fp, n, text in zip(*(b.column(c).to_pylist() for c in ("sha", "fp", "n_bytes", "text"))):
                data = normalise(text)
                if len(data) != n or hashlib.sha256(data).digest() != want:
                    raise ValueError("a text was joined with another text's hash")
                for lo in range(0, len(data), piece_bytes * 64):
                    part = range(lo, min(lo + piece_bytes * 64, len(data)), piece_bytes)
                    k = len(part)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([fp] * k, pa.int64()), pa.array([n] * k, pa.int64()),
                        pa.array([s // piece_bytes for s in part], pa.int64()),
                        pa.array([data[s:s + piece_bytes] for s in part], pa.binary())], schema=schema)
    return run


def collided(docs: DataFrame, entries: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Fingerprints ``fp, n_bytes`` that stand for different texts, found by
    comparing the documents of equal fingerprint piece by piece.

    A row meets its own member by id and SHA-256 of its normalised text, so rows
    that share an id, or have none, meet one member each.
    """
    shared = (entries.groupBy("fp", "n_bytes").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    members = (entries.join(shared, ["fp", "n_bytes"])
               .select(F.col("doc_id").alias("_id"), "sha", "fp", "n_bytes"))
    texts = (text_key(id_text(docs)).join(members, F.col("doc_id").eqNullSafe(F.col("_id"))
                                          & (F.col("_key") == F.col("sha")))
             .select("sha", "fp", "n_bytes", "text"))
    pieces = texts.mapInArrow(_compare_rows(piece_bytes), "fp bigint, n_bytes bigint, idx bigint, piece binary")
    return (pieces.groupBy("fp", "n_bytes", "idx", "piece").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("fp", "n_bytes", "idx").agg(F.count(F.lit(1)).alias("versions"))
            .where("versions > 1").select("fp", "n_bytes").distinct())


def exact_groups(docs: DataFrame, huge_bytes: int = HUGE_BYTES, poly_args: tuple = ()) -> DataFrame:
    """One row per distinct (doc_id, normalised text): ``doc_id, sha, fp,
    n_bytes, m, keep_id, group_size, kept`` with ``m`` the number of input
    rows it stands for and ``sha`` the SHA-256 of the normalised text."""
    bounded_batches(docs.sparkSession)
    entries = saved(fingerprints(docs, huge_bytes, poly_args))
    bad = collided(docs, entries).withColumn("bad", F.lit(True))
    members = (entries.join(bad, ["fp", "n_bytes"], "left")
               .withColumn("variant", F.when(F.col("bad"), F.col("sha")).otherwise(F.lit(b"")))
               .drop("bad"))
    # saved, so the join below has plain shuffles on both sides and Spark can split a hot group
    groups = saved(members.groupBy("fp", "n_bytes", "variant")
                   .agg(F.min("doc_id").alias("keep_id"), F.sum("m").alias("group_size")))
    return (members.join(groups, ["fp", "n_bytes", "variant"])
            .select("doc_id", "sha", "fp", "n_bytes", "m", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")))


def exact_dedup(docs: DataFrame, huge_bytes: int = HUGE_BYTES, poly_args: tuple = ()) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256`` and the fingerprint ``fp, n_bytes``.

    The row with the smallest id of a group of equal texts stays. NULL text is
    the empty text; empty texts are equal to each other. A NULL id is larger
    than every id (a group of NULL ids only has ``keep_id`` NULL). Of rows
    with equal id and equal text exactly one is ``kept``. Other columns of the
    input are not read. An empty table gives no rows. Texts above ``HUGE_BYTES``
    are hashed piece by piece in several tasks and compared like all others.
    """
    g = exact_groups(docs, huge_bytes, poly_args)
    return (g.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))).alias("_k"))
            .select("doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
                    (F.col("kept") & (F.col("_k") == 1)).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256"), "fp", "n_bytes"))


def text_key(rows: DataFrame) -> DataFrame:
    """Add ``_key``: SHA-256 of the normalised ``text``."""
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return rows.withColumn("_key", F.unhex(F.sha2(norm, 256)))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without exact copies, all columns kept.

    Of equal texts (NULL and empty are equal) the row with the smallest id stays, of
    rows with equal id and text the smallest by all columns; rows without id stay only
    where their text has none with an id. Columns of any name are kept, an empty table
    stays empty, texts of any length are compared whole.
    """
    d = saved(exact_groups(docs).select("doc_id", F.col("sha").alias("key"), "kept", F.col("m").alias("n")))
    return keep_rows(docs, d, text_key)
