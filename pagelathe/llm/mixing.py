"""Mixing sources to target token weights by entropy balancing. DataFrame expressions throughout.

Each token is a unit with rate r. Minimising the entropy sum(r log r - r) under one token constraint a source
gives rates exp(lambda_source); the dual, sum(words exp(lambda)) - target lambda, is convex, and its Newton
iterations need the gradient and the Hessian, which are sums over documents. Documents of one source and size
class contribute alike, so the sums run over a cell table that one pass over the documents makes.

Rates are then rounded into whole copies. Within a source, documents of one size class are ranked by hash
and the class gets a whole number of copies; what rounding leaves over goes to the next smaller class. Classes
of up to EXACT_SIZES words hold one size each, so the last step is as fine as the smallest documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelathe.llm.common import as_long, ranked, scratch, table, written

WORD = r"[^\x20\x09-\x0D]+"
#: No source's target and no document's copies exceed so many times its words.
MOST_COPIES = 3
EXACT_SIZES = 2048
#: Larger documents share classes of this many to a doubling of the size.
CLASSES_PER_DOUBLING = 32
NEWTON_ROUNDS = 60
NEWTON_STEPS_A_JOB = 6
TOLERANCE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _class_of(size: Column) -> Column:
    """Size classes, monotone in the size: exact, then logarithmic. At most EXACT_SIZES + 64 * CLASSES_PER_DOUBLING."""
    fine = F.lit(EXACT_SIZES) + F.floor(F.log2(size / EXACT_SIZES) * CLASSES_PER_DOUBLING) + 1
    return F.when(size <= EXACT_SIZES, size).otherwise(fine).cast("int")


def _numbered_sources(sources: DataFrame) -> DataFrame:
    """sources with nth, their place by code point from 0, null last. Ranges of names are numbered by themselves and
    shifted by the counts of the ranges before, so that no task holds all names."""
    by_name = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    ranges = sources.repartitionByRange(*by_name).withColumn("_range", F.spark_partition_id())
    ranges = written(ranges, "mix-sources")  # the ranges are cut once
    sizes = sorted((r["_range"], r["count"]) for r in ranges.groupBy("_range").count().collect())  # one row a task
    shifts, before = [], 0
    for k, n in sizes:
        shifts.append((k, before))
        before += n
    shift = sources.sparkSession.createDataFrame(shifts, "_r int, _shift long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*by_name)) - 1
    return ranges.withColumn("_in", inside).join(F.broadcast(shift), F.col("_range") == F.col("_r")).withColumn("nth", F.col("_in") + F.col("_shift")).drop("_range", "_r", "_in", "_shift")


def source_targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the whole; a target stops at MOST_COPIES
    times its source's size, and what is over is shared again by weight. That is filling to a common level:
    target = min(cap, level * weight). The level starts as if nothing were capped and rises, a sum over the sources at a
    time, until no further source reaches its cap.
    """
    weighed = _numbered_sources(sources).withColumn("weight", (F.col("nth") % 3 + 1).cast("double")).withColumn("cap", (F.col("source_size") * MOST_COPIES).cast("double"))
    weighed = written(weighed.select("source", "source_size", "weight", "cap"), "mix-weights")
    total, weights = weighed.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level = (total or 0.0) / (weights or 1.0)
    while total:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        capped, free = weighed.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        higher = (total - capped) / free if free else level
        if higher <= level:
            break
        level = higher
    return weighed.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def balanced_rates(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, rate) after Newton iterations of the dual over the cell table (source, words).

    Each iteration sums gradient and Hessian over the cells of every source; NEWTON_STEPS_A_JOB of them make one
    job, whose result is written. Sources without words, or with target 0, get rate 0.
    """
    spark = cells.sparkSession
    goal = targets.where("source_size > 0 AND target > 0").select(F.col("source").alias("_s"), "target")
    cells = written(cells.join(F.broadcast(goal) if _few(targets) else goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-cells")
    multipliers = written(cells.groupBy("source").agg(F.lit(0.0).alias("lam")), "mix-dual")
    for _ in range(0, NEWTON_ROUNDS, NEWTON_STEPS_A_JOB):
        for _ in range(NEWTON_STEPS_A_JOB):
            multipliers = _newton_step(cells, multipliers)
        multipliers = written(multipliers, "mix-dual")
        if (multipliers.agg(F.max("residual")).first()[0] or 0.0) <= TOLERANCE:
            break
    else:
        raise RuntimeError("the mixing weights did not converge")
    return multipliers.select("source", F.exp("lam").alias("rate"))


def _few(targets: DataFrame, most: int = 10_000) -> bool:
    return targets.limit(most + 1).count() <= most


def _newton_step(cells: DataFrame, multipliers: DataFrame) -> DataFrame:
    now = multipliers.select(F.col("source").alias("_s"), "lam")
    sums = (
        cells.join(now, F.col("source").eqNullSafe(F.col("_s")))
        .groupBy("source")
        .agg(F.first("lam").alias("lam"), F.sum(F.col("words") * F.exp("lam")).alias("hessian"), F.first("target").alias("target"))
    )
    gradient = F.col("hessian") - F.col("target")
    # a full step down from far above the root is safe; up, the convex dual may be overshot by no more than e - 1
    step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gradient / F.col("hessian")))
    return sums.select("source", (F.col("lam") - step).alias("lam"), F.abs(gradient / F.col("target")).alias("residual"))


def _class_copies(cells: DataFrame) -> DataFrame:
    """(source, size_class, copies) of (source, size_class, n, words, rate): whole copies, largest class first.

    The state of the fold is what has been due so far less what was taken. A source has at most
    EXACT_SIZES + 64 * CLASSES_PER_DOUBLING classes, whatever the number of its documents.
    """
    ordered = cells.groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("size_class", "n", "words", "rate")), asc=False).alias("cells")
    )
    empty = F.array().cast("array<struct<size_class:int,copies:bigint>>")

    def give(state: Column, cell: Column) -> Column:
        mean = cell["words"] / cell["n"]
        due = state["due"] + cell["words"] * cell["rate"]
        copies = F.greatest(F.lit(0), F.least(cell["n"] * MOST_COPIES, F.round(due / mean).cast("long")))
        return F.struct(
            (due - copies * mean).alias("due"),
            F.concat(state["out"], F.array(F.struct(cell["size_class"].alias("size_class"), copies.alias("copies")))).alias("out"),
        )

    folded = F.aggregate("cells", F.struct(F.lit(0.0).alias("due"), empty.alias("out")), give)
    return ordered.select("source", F.inline(folded["out"]))


def mixed(docs: DataFrame) -> DataFrame:
    """docs plus size, source_size, target and copies, one row for each row of docs.

    docs has columns doc_id, source and text; a null text has size 0, a null source is a source of its own,
    documents without words get no copies. Rows alike in all three are one unit of the mix, of the size of all of
    them, and get the same copies. Columns of docs that bear the names of new ones are replaced. An empty table stays
    empty. Ranks and copies are worked out on narrow rows; the texts travel once, to meet their copies.
    """
    wide = docs.drop("size", "source_size", "target", "copies")
    key = F.xxhash64("text")
    rows = wide.select(as_long("doc_id").alias("_id"), F.col("source").cast("string").alias("_source"), key.alias("_key"), word_count(F.col("text").cast("string")).alias("_each"))
    with scratch(docs.sparkSession) as tables:
        units = rows.groupBy("_id", "_source", "_key").agg(F.sum("_each").alias("_size"), F.first("_each").alias("size"))
        units = written(units.withColumn("_class", _class_of(F.col("_size"))), "mix-units")
        plan = mix_plan(units, units).select(F.col("_id").alias("_i"), F.col("_source").alias("_s"), "_key", "size", "source_size", "target", "copies")
        plan = tables.keep(written(plan, "mix-plan"))
    same = as_long("doc_id").eqNullSafe(F.col("_i")) & F.col("source").cast("string").eqNullSafe(F.col("_s")) & (key == F.col("_key"))
    return wide.join(plan, same).drop("_i", "_s", "_key")


def mix_plan(sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with source_size, target and copies. sizes has _source, _size and _class of every row, rows also _id."""
    cells = written(
        sizes.groupBy(F.col("_source").alias("source"), F.col("_class").alias("size_class")).agg(F.count("*").alias("n"), F.sum("_size").alias("words")),
        "mix-cells",
    )
    targets = written(source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size"))), "mix-targets")
    rates = balanced_rates(cells.where("words > 0").groupBy("source", "size_class").agg(F.sum("words").alias("words")), targets)
    rated = cells.where("words > 0").join(rates.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    coarse = _class_copies(rated).select(F.col("source").alias("_cs"), F.col("size_class").alias("_cc"), "copies")
    goal = targets.select(F.col("source").alias("_ts"), "source_size", "target")
    given = written(
        cells.join(goal, F.col("source").eqNullSafe(F.col("_ts")))
        .join(coarse, F.col("source").eqNullSafe(F.col("_cs")) & (F.col("size_class") == F.col("_cc")), "left")
        .select(F.col("source").alias("_s"), F.col("size_class").alias("_c"), "source_size", "target", F.coalesce("copies", F.lit(0)).alias("_copies"), F.col("n").alias("_of")),
        "mix-copies",
    )
    numbered = ranked(rows, ["_source", "_class"], ["_id", "_size"], "_rank")
    each = F.floor(F.col("_copies") / F.col("_of")) + (F.col("_rank") < F.col("_copies") % F.col("_of")).cast("long")
    found = numbered.join(given, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")))
    return found.withColumn("copies", each.cast("long")).drop("_rank", "_s", "_c", "_copies", "_of")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(as_long("doc_id").alias("_id"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"))
    sized = written(sized.withColumn("_class", _class_of(F.col("_size"))), "mix-sizes")
    return mix_plan(sized, sized).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"), F.col("_source").alias("source"), "copies"
    )
