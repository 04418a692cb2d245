"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each source gets a word target; every document of a source has a hash, and
the mix takes a document ``copies`` times, plus once more if its hash is at
most the source's threshold. Thresholds nest: a larger budget takes every
document that a smaller one takes.

The threshold of a budget is found without sorting documents: sum words by
source and leading hash bits (4,096 buckets), find the bucket in which the
running sum passes the budget, refine that bucket alone by the next 12 bits,
and only the documents of that last cell (one in 16 million of a source) are
looked at hash by hash. Sums are partially aggregated before each shuffle, so
a source with a third of all rows costs no more than any other. Targets need the
order of the sources and running sums; both are taken range by range, so there
may be as many sources as documents.

Defined results: null or empty text has size 0 and is taken 0 times; a null
source is a source of its own, last in the order; rows that repeat both id
and text have hashes of their own, by their place in the written table, so they
are taken one by one however many there are; an empty table gives no rows;
other columns are carried by :func:`mixed` and never read.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sylvan.llm.common import WORD, materialise, small, spare, text_or_empty

BITS = 12
CELLS = 1 << BITS
#: Hash bits in use: 15 hex digits of an MD5.
HASH_BITS = 60


def doc_size(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def doc_hash(key: str = "doc_id", text: str = "text") -> Column:
    """60 bits from the id and the text."""
    ident = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.md5(text_or_empty(text).cast("binary")))
    return F.conv(F.substring(F.md5(ident.cast("binary")), 1, 15), 16, 10).cast("long")


def _ranges(spark: SparkSession, df: DataFrame, order: Column, name: str) -> DataFrame:
    """Written: ``df`` range-partitioned by ``order``, each row with its range (``__range``)."""
    return materialise(spark, df.repartitionByRange(order).withColumn("__range", F.spark_partition_id()), name)


def _before(ranges: DataFrame, **sums: Column) -> DataFrame:
    """(``__range``, sums over all earlier ranges): one row a partition, so it is broadcast and prefixed in one task."""
    earlier = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    parts = ranges.groupBy("__range").agg(*[c.alias(k) for k, c in sums.items()])
    return F.broadcast(parts.select("__range", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(k) for k in sums]))


def source_targets(by_source: DataFrame, weights=(5, 2, 1), share=(3, 2), cap: int = 2) -> DataFrame:
    """(source, source_size) -> + target, one row per source.

    Sources by code point (null last) weigh ``weights``, repeating, and share
    ``share`` of all words; no target passes ``cap`` times its source. With
    caps c and weights w the targets are min(c, level * w) for the level at
    which they add up to the budget: a source is capped when the sum at its
    own ratio c / w stays within the budget. That sum grows with the ratio, so
    the largest ratio within the budget settles every source.

    Sources may be many (hosts): their places in the order and the running sums
    over distinct ratios come from ranges and what earlier ranges add up to, so
    no task sees all of them; a few totals reach the driver. Sums are whole numbers.
    """
    spark = by_source.sparkSession
    num, den = share
    unit = lcm(*weights)
    exact = "decimal(38,0)"
    order = F.col("source").asc_nulls_last()
    named = _ranges(spark, by_source, order, "mix-sources")
    place = F.row_number().over(W.partitionBy("__range").orderBy(order)) + F.col("__before") - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (place % len(weights) + 1).cast("int")).cast("long")
    c = F.col("source_size") * cap
    t = materialise(spark, named.join(_before(named, __before=F.count(F.lit(1))), "__range")
                    .select("source", "source_size", w.alias("__w"), c.alias("__c"))
                    .withColumn("__ratio", F.col("__c") * (F.lit(unit) / F.col("__w")).cast("long")), "mix-weights")
    total = lambda k: F.coalesce(F.sum(F.col(k).cast(exact)), F.lit(0)).cast(exact)
    everything, w_all = (int(x) for x in t.agg(total("source_size"), total("__w")).first())

    ratios = _ranges(spark, t.groupBy("__ratio").agg(total("__c").alias("c"), total("__w").alias("w")), F.col("__ratio"), "mix-ratios")
    up = W.partitionBy("__range").orderBy("__ratio").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = (ratios.join(_before(ratios, c0=F.sum("c"), w0=F.sum("w")), "__range")
                 .select("__ratio", (F.col("c0") + F.sum("c").over(up)).cast(exact).alias("c"), (F.col("w0") + F.sum("w").over(up)).cast(exact).alias("w")))
    whole = lambda x: F.lit(str(x)).cast(exact)
    within = (F.col("c") * whole(den * unit) + F.col("__ratio").cast(exact) * ((whole(w_all) - F.col("w")) * whole(den))
              <= whole(num * everything * unit))
    last = run.where(within).agg(F.max_by(F.struct("__ratio", "c", "w"), "__ratio").alias("r")).first().r
    ratio, full, w_full = (int(last["__ratio"]), int(last.c), int(last.w)) if last else (-1, 0, 0)

    left, free = num * everything - den * full, den * (w_all - w_full)
    level = F.col("__w").cast("double") * F.lit(float(left)) / F.lit(float(free or 1))
    return t.select("source", "source_size", F.when(F.col("__ratio") <= ratio, F.col("__c").cast("double")).otherwise(level).alias("target"))


def _passing(hist: DataFrame, budget: DataFrame, level: str) -> DataFrame:
    """The cell of each source in which the running sum reaches what is left."""
    run = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    b = budget.withColumnRenamed("source", "__s")
    return (hist.withColumn("__upto", F.sum("words").over(run))
                .join(small(b), F.col("source").eqNullSafe(F.col("__s")))
                .where((F.col("__upto") >= F.col("left_over")) & (F.col("__upto") - F.col("words") < F.col("left_over")))
                .select("source", F.col("cell").alias(level),
                        (F.col("left_over") - (F.col("__upto") - F.col("words"))).alias("left_over")))


def _apart(spark: SparkSession, rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` (with hash and row) with a hash of its own for each row whose hash is repeated.

    The n-th of equal rows hashes with its number n, so which of them is the
    n-th changes nothing. A row's number is its rank within its partition (the
    upper bits of ``row``) plus the equal rows of earlier ones: no task ranks more
    than one partition's.
    """
    task = F.shiftright("row", 33)
    r = rows.select("hash", "row", task.alias("task")).join(small(repeated), "hash")
    r = r.withColumn("rank", F.row_number().over(W.partitionBy("hash", "task").orderBy("row")) - 1)
    earlier = W.partitionBy("hash").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = r.groupBy("hash", "task").agg(F.count(F.lit(1)).alias("n")).select("hash", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ident = F.concat(F.col("hash").cast("string"), F.lit("#"), (F.col("before") + F.col("rank")).cast("string"))
    own = F.conv(F.substring(F.md5(ident.cast("binary")), 1, 15), 16, 10).cast("long")
    named = materialise(spark, r.join(before, ["hash", "task"]).select(F.col("row").alias("__at"), own.alias("__own")), "mix-own")
    return (rows.join(small(named), F.col("row") == F.col("__at"), "left")
                .withColumn("hash", F.coalesce("__own", "hash")).drop("__at", "__own"))


def sized_documents(spark: SparkSession, docs: DataFrame, key="doc_id", text="text", source="source",
                    row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Written: (doc_id, source, size, hash, row), and the hashes that several rows had before they were told apart.

    ``row``: a column that numbers the rows; without it they are numbered as they are written.
    """
    place = F.monotonically_increasing_id() if row is None else F.col(row)
    sized = materialise(spark, docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), doc_size(text).alias("size"),
                                           doc_hash(key, text).alias("hash"), place.alias("row")), "mix-sized")
    repeated = materialise(spark, sized.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "mix-repeated")
    if repeated.count():
        sized = materialise(spark, _apart(spark, sized, repeated), "mix-apart")
    return sized, repeated


def mix_plan(spark: SparkSession, sized: DataFrame, weights=(5, 2, 1), share=(3, 2), cap: int = 2) -> DataFrame:
    """Sized documents -> source, source_size, target, copies, threshold (written, one row per source)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = source_targets(totals, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("copies", whole).withColumn("left_over", F.col("target") - F.col("copies") * F.col("source_size"))
    targets = materialise(spark, t, "mix-targets")

    open_ = targets.where("left_over > 0").select("source", "left_over")
    top = F.shiftright("hash", HASH_BITS - BITS)
    mid = F.shiftright("hash", HASH_BITS - 2 * BITS).bitwiseAND(CELLS - 1)
    first = materialise(spark, _passing(
        sized.groupBy("source", top.alias("cell")).agg(F.sum("size").alias("words")), open_, "c1"), "mix-cell1")
    # only documents of the passing bucket are summed again, by the next bits
    f = first.withColumnRenamed("source", "__s")
    inside = sized.join(small(f.select("__s", "c1")), F.col("source").eqNullSafe(F.col("__s")) & (top == F.col("c1"))).drop("__s")
    second = materialise(spark, _passing(
        inside.groupBy("source", mid.alias("cell")).agg(F.sum("size").alias("words")), first.drop("c1"), "c2")
        .join(small(f.select("__s", "c1")), F.col("source").eqNullSafe(F.col("__s"))).drop("__s"), "mix-cell2")
    s = second.withColumnRenamed("source", "__s")
    last = sized.join(small(s), F.col("source").eqNullSafe(F.col("__s")) & (top == F.col("c1")) & (mid == F.col("c2")))
    run = W.partitionBy("source").orderBy("hash").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = (last.groupBy("source", "hash", "left_over").agg(F.sum("size").alias("words"))
                .withColumn("upto", F.sum("words").over(run))
                .groupBy("source").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("left_over")).alias("miss"),
                                                      F.col("hash").alias("h"))).alias("best")))
    n = near.withColumnRenamed("source", "__s")
    below = F.shiftleft(F.col("c1").cast("long"), HASH_BITS - BITS) + F.shiftleft(F.col("c2").cast("long"), HASH_BITS - 2 * BITS) - 1
    cut = (second.join(n, F.col("source").eqNullSafe(F.col("__s")))
                 .select(F.col("source").alias("__s"),
                         F.when(F.col("best.miss") < F.col("left_over"), F.col("best.h")).otherwise(below).alias("threshold")))
    return materialise(spark, targets.join(cut, F.col("source").eqNullSafe(F.col("__s")), "left")
                       .select("source", "source_size", "target", "copies",
                               F.coalesce("threshold", F.lit(-1)).alias("threshold")), "mix-plan")


def with_copies(df: DataFrame, plan: DataFrame, source: str = "source", hash_: str = "hash") -> DataFrame:
    """Adds __copies (and the plan's columns as __plan_*): a filter by threshold, no sort."""
    p = plan.select(*[F.col(c).alias(f"__plan_{c}") for c in plan.columns])
    return (df.join(small(p), F.col(source).eqNullSafe(F.col("__plan_source")))
              .withColumn("__copies", F.col("__plan_copies") + (F.col(hash_) <= F.col("__plan_threshold")).cast("long")))


def mix_sizes(spark: SparkSession, docs: DataFrame, key="doc_id", text="text", source="source", **kw) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sized, _ = sized_documents(spark, docs, key, text, source)
    return with_copies(sized, mix_plan(spark, sized, **kw)).select(
        "doc_id", "size", F.col("__plan_source_size").alias("source_size"), F.col("__plan_target").alias("target"),
        (F.col("size") * F.col("__copies")).alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame, key="doc_id", text="text", source="source", **kw) -> DataFrame:
    """The mix itself: each document as often as it is taken, columns unchanged.

    Rows are written with their number only if some repeat id and text.
    """
    columns = docs.columns
    sized, repeated = sized_documents(spark, docs, key, text, source)
    crowded = repeated.count() > 0
    if crowded:
        row = spare(docs, "row")
        docs = materialise(spark, docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
        sized, repeated = sized_documents(spark, docs, key, text, source, row)
    plan = mix_plan(spark, sized, **kw)
    # the row travels as one struct, so no name of its columns meets the plan's
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    place = F.col(row) if crowded else F.lit(0)
    rows = docs.select(F.col(source).alias("source"), doc_hash(key, text).alias("hash"), place.alias("row"), whole.alias("doc"))
    out = with_copies(_apart(spark, rows, repeated) if crowded else rows, plan)
    return (out.where("__copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
               .select(*[F.col(f"doc.`{c}`") for c in columns]))
