"""Exact token-length histogram with suffix sums.

Tasks encode whole texts with a byte-level BPE and count; documents are then
aggregated by encoded length. From the histogram, sums from the long end
answer for every context limit how many documents and tokens lie at or above
it and what truncating to it keeps, and counts from the short end give exact
quantiles. The sums run in two levels (inside blocks of lengths, and over
blocks), so no task sees the whole histogram.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldsense.llm.common import bounded_batches, id_text, saved

BLOCK = 1024          # lengths of one block of the histogram
LONG_BLANK = 1000     # white space from this length on does not go through the library's word pattern

# fixed values: what the word pattern takes for white space
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a rank file; special strings are ordinary text."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as fh:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, fh)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(enc, text: str) -> int:
    """Number of tokens of a text.

    A long run of white space overflows the stack of the library's pattern
    matcher. The pattern makes one word of such a run at the text's end, and
    elsewhere of all but its last character, and no other word reaches over its
    start; so the run is cut out, encoded as that word, and the rest goes on with
    its last character.
    """
    total, done = 0, 0
    for run in re.finditer(f"[{WHITE}]{{{LONG_BLANK},}}", text):
        end = run.end() - (run.end() < len(text))
        total += len(enc.encode_ordinary(text[done:run.start()]))
        total += len(enc._encode_single_piece(text[run.start():end]))
        done = end
    return total + len(enc.encode_ordinary(text[done:] if done else text))


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` per row; NULL and empty texts have 0 tokens."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        enc = encoder(path or default_path())
        for b in batches:
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").cast(pa.int64()),
                pa.array([token_count(enc, t) for t in b.column("text").to_pylist()], pa.int64())],
                schema=schema)

    return id_text(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def histogram(counted: DataFrame) -> DataFrame:
    """``n_tokens, n_docs`` from rows with ``n_tokens``."""
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per length of ``hist``, read as a context limit:

    ``docs_at_least, tokens_at_least`` (documents of that length or more),
    ``truncated_total`` (tokens left when every document is cut to it),
    ``docs_up_to`` and ``share_up_to`` (documents that fit), ``total_docs``,
    ``total_tokens``. Between two lengths ``truncated_total`` is linear.
    """
    h = hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn(
        "block", F.floor(F.col("n_tokens") / F.lit(block)))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"),
                           F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"),
                           F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    inside = (Window.partitionBy("block").orderBy(F.desc("n_tokens"))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    up = (h.withColumn("d", F.sum("n_docs").over(inside)).withColumn("t", F.sum("tokens").over(inside))
          .join(blocks, "block")
          .withColumn("docs_at_least", F.col("d") + F.col("later_docs"))
          .withColumn("tokens_at_least", F.col("t") + F.col("later_tokens")))
    return up.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"))
        .alias("truncated_total"),
        (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_up_to"),
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("share_up_to"),
        "total_docs", "total_tokens")


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``context_limit, docs_longer, truncated_total, lost_tokens`` for any
    limits, whether a document has that length or not. One pass that keeps one
    row per limit; an empty table gives zeros."""
    row = F.struct("n_tokens", "docs_at_least", "tokens_at_least", "n_docs", "total_tokens")

    def answer(limit: int):
        lim = F.lit(int(limit)).cast("bigint")
        at = F.min_by(F.when(F.col("n_tokens") >= lim, row), F.when(F.col("n_tokens") >= lim, F.col("n_tokens")))
        return F.struct(lim.alias("context_limit"), at.alias("at"), F.max("total_tokens").alias("total"))

    a = sums.agg(F.array(*[answer(x) for x in limits]).alias("a")).select(F.inline("a"))
    above = F.coalesce(F.col("at.docs_at_least"), F.lit(0))
    over = F.coalesce(F.col("at.tokens_at_least"), F.lit(0))
    total = F.coalesce(F.col("total"), F.lit(0))
    return a.select(
        "context_limit",
        (above - F.when(F.col("at.n_tokens") == F.col("context_limit"), F.col("at.n_docs")).otherwise(0))
        .alias("docs_longer"),
        (total - over + above * F.col("context_limit")).alias("truncated_total"),
        (over - above * F.col("context_limit")).alias("lost_tokens"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``share, n_tokens``: the smallest length that at least ``share`` of
    the documents do not exceed (NULL for an empty table)."""
    at = [F.struct(F.lit(float(q)).alias("share"),
                   F.min(F.when(F.col("share_up_to") >= F.lit(float(q)), F.col("n_tokens"))).alias("n_tokens"))
          for q in shares]
    return sums.agg(F.array(*at).alias("a")).select(F.inline("a"))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Histogram of encoded lengths of whole texts with its suffix sums.

    NULL and empty texts count with length 0; repeated rows count each time;
    ids play no part; other columns are not read. An empty table gives no rows.
    Texts of any length count, blank ones included (``token_count``). The
    histogram is saved once, so texts are encoded once.
    """
    return suffix_sums(saved(histogram(lengths(docs, path))))
