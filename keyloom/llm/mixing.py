"""Mixing sources to target weights by capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stage

CYCLE = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 42
#: Hash cells per source: each holds 1/4096 of a source, whichever share of the rows the source has.
CELL_DIGITS = 3
#: A table of one row a source is broadcast up to this many sources (under 100 bytes each).
BROADCAST_SOURCES = 20_000


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets for a table source_key, source_size, weight (one row per source): adds target and ratio.

    A source's target is its weight times a common level, clamped at max_epochs times its size; the level is set so that
    targets sum to the size of everything. Redistributing the excess until no source is above its clamp ends at that
    level. Sorted by clamp per unit of weight, the clamped sources are a leading run, and the first source whose clamp
    isn't below the level left by those before it ends the run. Running sums over the source table find that level.
    """
    one = Window.partitionBy(F.lit(1))
    by = one.orderBy(F.col("cap") / F.col("weight"), "source_key")
    cap, weight, size = F.col("cap"), F.col("weight"), F.col("source_size")
    level = (F.col("total") - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum(
        "weight"
    ).over(by.rowsBetween(0, Window.unboundedFollowing))
    return (
        sources.withColumn("cap", size * max_epochs)
        .withColumn("total", F.sum("source_size").over(one))
        .withColumn("level", level)
        .withColumn("at", F.row_number().over(by))
        .withColumn("level", F.min_by(F.when(cap >= F.col("level") * weight, F.col("level")), F.when(cap >= F.col("level") * weight, F.col("at"))).over(one))
        .withColumn("target", F.least(cap.cast("double"), F.coalesce(F.col("level") * weight, F.lit(0.0))))
        .select("source_key", "source_size", "target", F.when(size > 0, F.col("target") / size).otherwise(F.lit(0.0)).alias("ratio"))
    )


def mix(docs: DataFrame, cycle: tuple = CYCLE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """How often each document enters a mix that is as large as the whole table.

    Reads doc_id, source and text; a size is a number of words (null text: 0). Sources in code-point order (null last)
    weigh `cycle`, repeating. With r = target / size of its source, every document is taken floor(r) times. The
    fraction of r is filled in the order of a seeded digest (md5 of seed and doc_id; a null doc_id leaves the seed
    alone): documents enter while they fit; then the one left whose size is nearest to what is still missing enters, if
    that brings the source nearer to its target. So a rerun takes the same documents, and a source misses its target by
    a fraction of one document. Rows with the same doc_id and size are interchangeable.

    A source is dealt over 16^CELL_DIGITS digest cells, and running sums start from per-cell totals, so a source that
    holds a third of all rows is spread evenly. One row per row of docs: doc_id, source, text_hash, size, source_size,
    target, copies, taken (= copies x size). An empty table gives no rows.
    """
    flat = stage(
        docs.select(
            "doc_id",
            "source",
            F.xxhash64("text").alias("text_hash"),
            n_words(F.col("text")).alias("size"),
            F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")).alias("source_key"),
            F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")).alias("key"),
        ).withColumn("cell", F.substring("key", 1, CELL_DIGITS)),
        "mix-sizes",
    )
    cells = stage(flat.groupBy("source_key", "cell").agg(F.sum("size").alias("cell_size")), "mix-cells")
    sources = cells.groupBy("source_key").agg(F.sum("cell_size").alias("source_size"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("source_key")) - 1
    targets = stage(water_fill(sources.withColumn("weight", F.get(F.lit(list(cycle)), (rank % len(cycle)).cast("int"))), max_epochs), "mix-targets")

    before = Window.partitionBy("source_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source_key", "cell", F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("before")).join(targets, "source_key")
    run = Window.partitionBy("source_key", "cell").orderBy("key", "size")
    room = (F.col("ratio") - F.floor("ratio")) * F.col("source_size")
    walked = stage(
        flat.join(cells, ["source_key", "cell"])
        .withColumn("end", F.col("before") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(run))
        .withColumn("room", room)
        .withColumn("fits", (F.col("room") > 0) & (F.col("end") <= F.col("room")))
        .drop("cell", "before"),
        "mix-walk",
    )
    missing = walked.groupBy("source_key").agg((F.first("room") - F.coalesce(F.max(F.when(F.col("fits"), F.col("end"))), F.lit(0))).alias("missing"))
    if targets.count() <= BROADCAST_SOURCES:
        missing = F.broadcast(missing)
    left = walked.filter(~F.col("fits") & (F.col("room") > 0)).join(missing, "source_key").filter(F.col("size") < 2 * F.col("missing"))
    last = left.groupBy("source_key").agg(F.min(F.struct(F.abs(F.col("size") - F.col("missing")), "key", "nth")).alias("last")).select("source_key", "last.key", "last.nth", F.lit(1).alias("is_last"))
    copies = (F.floor("ratio") + F.when(F.col("fits") | F.col("is_last").isNotNull(), 1).otherwise(0)).cast("long")
    return (
        walked.join(last, ["source_key", "key", "nth"], "left")
        .withColumn("copies", copies)
        .select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as mix() takes it, in the columns of docs.

    Rows that agree in doc_id, source and text count as one row that is taken as often as all of them together.
    """
    key = ["doc_id", "source", "text_hash"]
    taken = mix(docs, **options).groupBy(key).agg(F.sum("copies").alias("copies")).filter(F.col("copies") > 0)
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d"), F.col("source").alias("s"), F.xxhash64("text").alias("h")).dropDuplicates(["d", "s", "h"])
    same = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("h") == F.col("text_hash"))
    return own.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
