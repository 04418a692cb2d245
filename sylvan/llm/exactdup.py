"""Exact dedup with a heavy-hitter split (DataFrame functions only).

Texts are equal when identical after white space is deleted; equality is
decided on the SHA-256 of what is left. One pass writes a narrow table (id,
length, digest, row number); a Misra-Gries summary (Spark's ``approx_top_k``
frequent-items sketch) over it proposes frequent digests; a second pass counts
these exactly, and the verified winners, at most ``k`` rows, are broadcast:
their copies are settled on the map side and never meet in one task. All other
digests take the ordinary aggregate and join by digest.

Defined results: null text counts as empty; of equal texts the row with most
code points, then smallest id (null last), stays; of rows that repeat even
that, exactly one stays; an empty table gives no rows; other columns are
carried by :func:`deduplicated` and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sylvan.llm.common import SPACES, materialise, spare, text_or_empty

#: Summary counters per task, and the most digests that may be broadcast.
COUNTERS, TOP = 8192, 256


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    t = text_or_empty(text)
    return docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.length(t).alias("chars"),
                       F.unhex(F.sha2(F.translate(t, SPACES, "").cast("binary"), 256)).alias("digest"))


def frequent(table: DataFrame, share: float = 1e-4) -> DataFrame:
    """Digests whose exact count is at least ``share`` of all rows (2 at least): <= TOP rows."""
    h = F.xxhash64("digest")
    summary = table.select(h.alias("h")).agg(F.expr(f"approx_top_k(h, {TOP}, {COUNTERS})").alias("top"),
                                             F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) * share)).alias("least"))
    candidates = (summary.select(F.explode("top").alias("x"), "least").where(F.col("x.count") >= F.col("least"))
                         .select(F.col("x.item").alias("h"), "least"))  # TOP rows at most
    return (table.withColumn("h", h).join(F.broadcast(candidates), "h")
                 .groupBy("digest").agg(*_stats(), F.first("least").alias("least"))
                 .where(F.col("group_size") >= F.col("least")).drop("least"))


def _stats():
    best = F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row")))
    return best.alias("best"), F.count(F.lit(1)).alias("group_size")


def decide(spark: SparkSession, table: DataFrame) -> DataFrame:
    """A written digest table -> doc_id, row, keep_id, group_size, kept, digest."""
    winners = materialise(spark, frequent(table), "dup-frequent")
    heavy = table.join(F.broadcast(winners), "digest")
    light = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = light.join(light.groupBy("digest").agg(*_stats()), "digest")
    return heavy.unionByName(light).select(
        "doc_id", "row", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest")


def dedup_report(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    table = materialise(spark, digests(docs, key, text), "dup-digests")
    return decide(spark, table).select("doc_id", "keep_id", "group_size", "kept",
                                       F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, columns unchanged."""
    row = spare(docs, "row")
    rows = materialise(spark, docs.withColumn(row, F.monotonically_increasing_id()), "dup-rows")
    t = text_or_empty(text)
    table = materialise(spark, rows.select(F.col(key).alias("doc_id"), F.col(row).alias("row"), F.length(t).alias("chars"),
                                           F.unhex(F.sha2(F.translate(t, SPACES, "").cast("binary"), 256)).alias("digest")), "dup-digests")
    gone = decide(spark, table).where("not kept").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
