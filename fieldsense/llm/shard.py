"""Contiguous balanced shards by a global prefix sum of byte sizes (native).

Documents are range-partitioned by id and that order is saved once (ids and
sizes only, no text). Each partition's byte and row totals give its offsets;
a running sum inside the partition then gives every document its place in the
whole, and the places are cut at equal byte targets. The window over the
partition totals sees one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldsense.llm.common import saved

SHARDS = 8


def byte_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row.

    The shard of a document is the one that holds the middle of its bytes, so
    shards are contiguous in id order and differ from the equal target by at
    most one document. ``slot`` counts from 0 inside the shard in id order.
    NULL text has no bytes (size 1) and CRC 0, like the empty text. Rows
    without id come last; rows of equal id are ordered by CRC and size. An
    empty table gives no rows. A single document larger than the target leaves
    shards beside it short or empty. Groups of equal texts are not held
    together. Of a text of any length only size and CRC travel; other columns are
    not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
                       F.crc32(text).cast("bigint").alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    placed = saved(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_b0"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n0"),
                            F.sum("b").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = (placed
                .withColumn("_upto", F.sum("size").over(inside))
                .withColumn("_row", F.row_number().over(inside))
                .join(offsets, "_part")
                .select("doc_id", "size", "text_crc32",
                        (F.col("_n0") + F.col("_row") - 1).alias("_pos"),
                        F.expr(f"cast(((2 * (_b0 + _upto) - size) * {int(shards)}L) div (2 * _all) as int)")
                        .alias("shard")))
    # one row per shard
    starts = numbered.groupBy("shard").agg(F.min("_pos").alias("_first"))
    return (numbered.join(F.broadcast(starts), "shard")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("_pos") - F.col("_first")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
