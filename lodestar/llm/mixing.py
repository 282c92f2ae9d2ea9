"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target over its size says how many copies its words get on average. The whole part is
given to every document. For the rest documents are drawn with unequal probabilities, in proportion
to their size: p = min(1, scale * size), where the scale makes the expected words, the sum of
p * size, what is wanted. Documents with p = 1 are certain. The others are ranked by their random odds over
their inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order while they fit, so
the sample's size in words is fixed: it ends within half a document of the target, and long
documents, which would miss it by much, are certain or come early.

All decisions are a row for each source (``plan``): whole copies, scale and the last rank that is taken. Documents
meet it once, in a join by source that sends the plan to all or else may be split, so texts need
not move and a hot source is no single task. The scale comes from the sizes' counts, and the last
rank from two rounds of bounded histograms; only the rows of one bin of bins are ever ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import durable, few, read

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BINS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size): one row a source, null a source of its own.

    Targets share the total by weight, are cut at ``cap`` times the source's size, and what is cut
    goes to the others by weight until none is above: with sources in order of cap over weight,
    the level is that of the first source that stays below its cap. The windows see a row a source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.select("source", "source_size", pick.cast("double").alias("w"), (F.lit(cap) * F.col("source_size")).cast("double").alias("most"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levels = ranked.withColumn("level", level)
    reached = levels.withColumn("level", F.min(F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(F.col("most") / F.col("w"), "level"))).over(every)["level"])
    return reached.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("w"), "most")).alias("target"))


def inclusion_scales(base: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, scale, most): what times a size gives the inclusion probability, and the largest size that may be drawn.

    If the sizes from s on are certain, the others' expected words are scale * (sum of their
    squares); s is the largest size at which scale * s reaches 1. The scale is null where nothing is
    wanted or all is certain. The windows see a row for each size of a source.
    """
    counts = base.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    met = _meet(counts, targets.select("source", "wanted")).where("wanted > 0")
    fitting = F.sum(F.when(F.col("size") <= F.col("wanted"), F.col("n") * F.col("size")).otherwise(0)).over(Window.partitionBy("source"))
    met = met.withColumn("most", F.when(fitting >= F.col("wanted"), F.floor("wanted")).otherwise(F.lit((1 << 62))).cast("long")).where(F.col("size") <= F.col("most"))
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    words, squares = F.col("n") * F.col("size").cast("double"), F.col("n") * F.col("size").cast("double") * F.col("size")
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    certain = F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # with all larger sizes certain, this size and the smaller ones share what is left
    placed = met.withColumn("scale", (F.col("wanted") - certain) / F.sum(squares).over(upto))
    fits = F.when((F.col("scale") * F.col("size") < 1) & (F.col("scale") > 0), F.struct("size", "scale"))
    return placed.groupBy("source").agg(F.max(fits)["scale"].alias("scale"), F.max("most").alias("most"))


def inclusion(size: Column, scale: Column, most: Column) -> Column:
    return F.when(scale.isNull() | (size <= 0) | (size > most), F.lit(0.0)).otherwise(F.least(F.lit(1.0), scale * size))


def pareto_rank(p: Column, seed: int, *identity: Column) -> Column:
    """The Pareto order statistic q of a document for inclusion probability ``p``, as q / (1 + q): the same order, within [0, 1)."""
    u = ((F.xxhash64(F.lit(seed), *identity).bitwiseAND(F.lit((1 << 52) - 1))) + 0.5) / float(1 << 52)
    p = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    q = (u / (1 - u)) * ((1 - p) / p)
    return q / (1 + q)


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join by source, null as a source."""
    right = right.withColumnRenamed("source", "source_")
    return left.join(right, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")


def plan(base: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES, seed: int = 7) -> DataFrame:
    """(source, source_size, target, whole, scale, most, wanted, last): a row for each source of (source, size, identity...).

    ``last`` is the greatest rank that is taken, null where none is.
    """
    identity = [c for c in base.columns if c not in ("source", "size")]
    targets = source_targets(base, weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(ratio + 1e-12).cast("long"))
    wanted = F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    targets = durable(targets.withColumn("wanted", F.when(wanted > 1e-6, wanted).otherwise(F.lit(0.0))))
    targets = durable(_meet(targets, inclusion_scales(base, targets)))
    rows = _meet(base, few(targets.select("source", "wanted", "scale", "most"))).withColumn("p", inclusion(F.col("size"), F.col("scale"), F.col("most"))).where("p > 0")
    place = F.when(F.col("p") >= 1, F.lit(0.0)).otherwise(pareto_rank(F.col("p"), seed, *map(F.col, identity)))
    rows = rows.select("source", "size", "wanted", place.alias("q")).withColumn("bin", F.floor(F.col("q") * BINS)).withColumn("sub", F.floor(F.col("q") * BINS * BINS))

    def cut(level: str, within: DataFrame, start: Column) -> DataFrame:
        """The first bin of each source whose words, after those before it, pass what is wanted."""
        sums = within.groupBy("source", level).agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"), F.first(start).alias("start"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy(level))
        sums = sums.withColumn("before", F.col("start") + upto - F.col("words"))
        passing = sums.where((F.col("before") <= F.col("wanted")) & (F.col("before") + F.col("words") > F.col("wanted")))
        return passing.groupBy("source").agg(F.max(F.struct(level, "before")).alias("at")).select("source", F.col("at")[level].alias(f"cut_{level}"), F.col("at")["before"].alias(f"before_{level}"))

    first = durable(cut("bin", rows, F.lit(0)))
    inside = _meet(rows, few(first)).where("bin = cut_bin")
    second = durable(cut("sub", inside, F.col("before_bin")))
    # what is left to order is one of 16 million slices of a source; equal ranks are taken or left together
    edge = _meet(rows, few(second)).where("sub = cut_sub").groupBy("source", "q").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"), F.first("before_sub").alias("before_sub"))
    upto = F.col("before_sub") + F.sum("words").over(Window.partitionBy("source").orderBy("q"))
    last = edge.withColumn("upto", upto).where(F.col("upto") - F.col("words") / 2.0 <= F.col("wanted")).groupBy("source").agg(F.max("q").alias("edge"))
    # without a row of the slice, all ranks before it
    told = _meet(_meet(targets, second), last)
    upper = F.when(F.col("edge").isNotNull(), F.col("edge")).when(F.col("cut_sub").isNotNull(), F.col("cut_sub") / float(BINS * BINS) - 1e-18).otherwise(F.lit(1.0))
    return durable(told.select("source", "source_size", "target", "whole", "scale", "most", "wanted", F.when(F.col("wanted") > 0, upper).alias("last")))


def mixed(docs: DataFrame, source: Column, size: Column, identity: list[Column], weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES, seed: int = 7, name: str = "mix") -> DataFrame:
    """``docs`` and a column ``name``: struct of size, source_size, target and copies, for every row.

    Rows of size 0 (null or empty texts) get the whole copies of their source and take no words.
    Equal rows draw the same number; null is a source of its own; an empty table gives an empty
    result; the columns of ``docs`` may have any names.
    """
    keys = [f"i{k}" for k in range(len(identity))]
    base = durable(docs.select(source.alias("source"), size.cast("long").alias("size"), *[c.alias(k) for c, k in zip(identity, keys)]))
    own = few(plan(base, weights, cap, seed).select(F.struct("*").alias(f"{name}_plan")))
    p = F.col(f"{name}_plan")
    met = docs.withColumn(f"{name}_size", size.cast("long")).withColumn(f"{name}_source", source)
    met = met.join(own, F.col(f"{name}_source").eqNullSafe(p["source"]))
    chance = inclusion(F.col(f"{name}_size"), p["scale"], p["most"])
    rank = F.when(chance >= 1, F.lit(0.0)).otherwise(pareto_rank(chance, seed, *identity))
    more = F.when((chance > 0) & p["last"].isNotNull() & (rank <= p["last"]), 1).otherwise(0)
    copies = F.least(p["whole"] + more, F.lit(cap)).cast("long")
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(F.col(f"{name}_size").alias("size"), p["source_size"].alias("source_size"), p["target"].alias("target"), copies.alias("copies")).alias(name))


def mix_documents(docs: DataFrame, name: str = "mix") -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with the column ``name`` of ``mixed``; sizes are words, texts tell rows of one doc_id apart."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0))
    return mixed(docs, F.col("source"), size, [F.col("doc_id"), F.xxhash64("text")], name=name)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    m = mix_documents(docs)
    return m.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))
