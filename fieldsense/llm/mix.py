"""Mixing sources to target weights by systematic sampling (native).

Every source gets a target (words) from its weight, capped at ``max_repeat``
times its own size; what the caps cut off is shared again by weight. Within a
source every document has the same expected number of copies, target / size.
The expected copies are summed over the documents in a fixed order, one
random offset per source is added, and a document is emitted once for every
integer its interval of the sum crosses.

The order is by size class (bit length and leading bits of the size), so the
words taken follow the target closely, then by a hash bucket of the id, then
by id. The rank of a document in its source is the sum of three counts: of
smaller classes, of smaller buckets in its class, and of rows before it in
its bucket. Each is a window over few rows; no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsense.llm.common import packed, saved

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
BUCKETS = 256
SEED = 42
CLASS_BITS = 5


def words(text: Column) -> Column:
    """Number of words (runs of anything but ASCII white space); NULL: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts (52 bits)."""
    h = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(h, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources ordered by code point (NULL last) weigh ``weights`` in turn. The
    level all uncapped sources share per unit of weight is the largest of
    (total - capped before) / (weight not capped before) over the sources by
    ascending cap / weight. One row per source passes the two windows.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    capped = (sizes.withColumn("weight", w)
              .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat))))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    return (capped.withColumn("_level", level)
            .withColumn("_level", F.max("_level").over(everything))
            .select("source", "source_size",
                    F.least(F.col("cap"), F.col("_level") * F.col("weight")).alias("target")))


def systematic_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT,
                   seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """``_row`` (the whole input row), ``doc_id, source, _size, _source_size,
    _target, _copies``.

    Every run takes the same copies. NULL text has size 0, an empty text too;
    rows of size 0 take part with copies but no words. NULL sources form one
    source, the last. Rows without id come last in their bucket; rows equal in
    id, source and size are alike. An empty table gives no rows. A text's length
    only makes its size.
    """
    rows = packed(docs, F.col("doc_id"), F.col("source"), words(F.col("text")).alias("_size"))
    bits = F.when(F.col("_size") > 0, F.length(F.bin(F.col("_size")))).otherwise(F.lit(0))
    sized = (rows.withColumn("_bits", bits)
             .withColumn("_class", F.col("_bits") * 64 + F.expr(
                 f"shiftright(_size, greatest(_bits - {CLASS_BITS}, 0))").cast("int"))
             .withColumn("_bucket", F.floor(uniform(F.lit(str(seed)), F.coalesce(
                 F.col("doc_id").cast("string"), F.lit("null"))) * buckets).cast("int"))
             # NULL sources need a value to be joined on
             .withColumn("_src", F.struct(F.col("source").isNull().alias("none"),
                                          F.coalesce(F.col("source"), F.lit("")).alias("name"))))
    key = ["_src", "_class", "_bucket"]
    # saved, so the texts are read once for the counts and once for the copies
    counts = saved(sized.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("s")))
    in_class = Window.partitionBy("_src", "_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.withColumn("_before", F.coalesce(F.sum("n").over(in_class), F.lit(0)))
    classes = counts.groupBy("_src", "_class").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    in_source = Window.partitionBy("_src").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("_below", F.coalesce(F.sum("n").over(in_source), F.lit(0)))
    sources = (classes.groupBy("_src").agg(F.sum("s").alias("source_size"))
               .select(F.when(~F.col("_src.none"), F.col("_src.name")).alias("source"), "source_size", "_src"))
    aims = (targets(sources.select("source", "source_size"), weights, share, max_repeat)
            .select(F.struct(F.col("source").isNull().alias("none"),
                             F.coalesce(F.col("source"), F.lit("")).alias("name")).alias("_src"),
                    F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
                    F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                    .otherwise(F.lit(0.0)).alias("_rate"),
                    uniform(F.lit(f"offset {seed}"), F.coalesce(F.col("source"), F.lit("null"))).alias("_offset")))
    cells = (cells.join(classes.select("_src", "_class", "_below"), ["_src", "_class"])
             .join(aims, "_src")
             .select(*key, (F.col("_before") + F.col("_below")).alias("_start"),
                     "_source_size", "_target", "_rate", "_offset"))
    within = Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_last(), "_size")
    rank = F.col("_start") + F.row_number().over(within)
    upto = F.floor(F.col("_offset") + F.col("_rate") * F.col("_rank"))
    from_ = F.floor(F.col("_offset") + F.col("_rate") * (F.col("_rank") - 1))
    return (sized.join(cells, key).withColumn("_rank", rank)
            .withColumn("_copies", F.least(upto - from_, F.ceil(F.col("_rate"))).cast("int"))
            .select("_row", "doc_id", "source", "_size", "_source_size", "_target", "_copies"))


def mix_report(docs: DataFrame, **kw) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per document; ``taken``
    is the words the mix takes of it, repeats counted."""
    return (systematic_mix(docs.select("doc_id", "source", "text"), **kw)
            .select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                    F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken")))


def mixed_rows(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns of ``docs``
    (any names). Unusual rows as in ``systematic_mix``; a document that is taken no
    time is not there, one of no words may be. An empty table stays empty."""
    return (systematic_mix(docs, **kw).where("_copies > 0")
            .select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
            .select("_row.*"))
