"""Sharding over fixed virtual slots (DataFrame functions only).

Every record hashes into one of 8,192 virtual slots, for good. Bytes and rows
are summed per slot, and a small versioned table (version, vslot, shard, ...)
says which shard holds a slot. Rebalancing edits that table and moves whole
slots: version 0 deals slots out in turn; :func:`rebalance` goes through the
slots from the largest down and leaves each where it is while its shard stays
within the mean, else gives it to the shard with least bytes so far;
:func:`grow` moves slots only into one new shard. The law kept is ``bytes``.

A record's position is its rank within its slot plus the rows of the shard's
earlier slots, so no task ever ranks more than one slot.

Defined results: null text has 16 bytes and crc32 0; a null id hashes like any
other value; rows that repeat id and text are spread over the slots by their
place in the written records, so the law holds however many there are and no
task ranks them all; an empty table gives
no rows (and a map of empty slots); other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from sylvan.llm.common import materialise, small

SLOTS = 8192


def records(docs: DataFrame, key="doc_id", text="text", slots: int = SLOTS) -> DataFrame:
    b = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return (docs.select(F.col(key).alias("doc_id"), (F.octet_length(b).cast("long") + 16).alias("size"), F.crc32(b).alias("text_crc32"))
                .withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int")))


def _without_crowds(spark: SparkSession, recs: DataFrame, slots: int) -> DataFrame:
    """Written records in which rows equal in id, size and text checksum have slots of their own."""
    same = ["doc_id", "text_crc32", "size"]
    recs = materialise(spark, recs.withColumn("row", F.monotonically_increasing_id()), "shard-records")
    crowds = materialise(spark, recs.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shard-crowds")
    if not crowds.count():
        return recs.drop("row")
    c = small(crowds.select(*[F.col(k).alias(f"__{k}") for k in same]))
    met = recs.join(c, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("text_crc32") == F.col("__text_crc32"))
                    & (F.col("size") == F.col("__size")), "left")
    apart = F.pmod(F.xxhash64(*same, "row"), F.lit(slots)).cast("int")
    vslot = F.when(F.col("__size").isNotNull(), apart).otherwise(F.col("vslot")).alias("vslot")
    return materialise(spark, met.select(*same[:1], "size", "text_crc32", vslot), "shard-spread")


def slot_load(spark: SparkSession, recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """bytes and rows of every slot, empty ones included (``slots`` rows)."""
    have = recs.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return (spark.range(slots).select(F.col("id").cast("int").alias("vslot")).join(have, "vslot", "left")
                 .select("vslot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def first_map(load: DataFrame, shards: int) -> DataFrame:
    return load.select(F.lit(0).alias("version"), "vslot", (F.col("vslot") % shards).cast("int").alias("shard"), "bytes", "n")


def rebalance(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, its shards near equal in bytes.

    A fold over the sorted slots (one array of ``slots`` structs, whatever the
    data): state = bytes per shard and the shards given so far.
    """
    one = (slot_map.groupBy().agg(F.max("version").alias("v"), F.sum("bytes").alias("total"),
                                  F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "vslot", "shard", "n"))).alias("xs"))
                   .where(F.size("xs") > 0))
    mean = F.ceil(F.col("total") / shards).cast("long")
    empty = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("given"))

    def step(acc, x):
        here = F.get(acc["load"], x["shard"])
        least = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
        to = F.when(here - x["minus"] <= mean, x["shard"]).otherwise(least)
        # the one-element array binds the choice, so it is made once a step
        return F.get(F.transform(F.array(to), lambda s: F.struct(
            F.transform(acc["load"], lambda v, i: F.when(i == s, v - x["minus"]).otherwise(v)).alias("load"),
            F.concat(acc["given"], F.array(s)).alias("given"))), F.lit(0))

    given = F.aggregate("xs", empty, step, lambda a: a["given"])
    return (one.select((F.col("v") + 1).alias("version"), F.explode(F.arrays_zip("xs", given.alias("given"))).alias("p"))
               .select("version", F.col("p.xs.vslot").alias("vslot"), F.col("p.given").cast("int").alias("shard"),
                       (-F.col("p.xs.minus")).alias("bytes"), F.col("p.xs.n").alias("n")))


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version with one shard more (number ``shards``), which alone takes slots.

    Each old shard gives its smallest slots as long as it stays at or above the new mean.
    """
    run = W.partitionBy("shard").orderBy("bytes", "vslot").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = (slot_map.withColumn("__gone", F.sum("bytes").over(run)).withColumn("__own", F.sum("bytes").over(W.partitionBy("shard")))
                 .withColumn("__all", F.sum("bytes").over(W.partitionBy())))
    moves = F.col("__own") - F.col("__gone") >= F.col("__all") / (shards + 1)
    return t.select((F.col("version") + 1).alias("version"), "vslot",
                    F.when(moves, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", "n")


def sharded(spark: SparkSession, docs: DataFrame, shards: int = 40, key="doc_id", text="text", slots: int = SLOTS,
            slot_map: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with shard and position, the map with all its versions).

    ``slot_map``: an earlier map to edit (its bytes are measured anew).
    """
    recs = _without_crowds(spark, records(docs, key, text, slots), slots)
    load = materialise(spark, slot_load(spark, recs, slots), "shard-load")
    old = first_map(load, shards) if slot_map is None else slot_map.select("version", "vslot", "shard").join(load, "vslot")
    newest = old.where(F.col("version") == old.agg(F.max("version")).first()[0])
    versions = materialise(spark, old.unionByName(rebalance(newest, shards)), "shard-map")
    last = versions.where(F.col("version") == versions.agg(F.max("version")).first()[0])
    before = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    place = last.select("vslot", "shard", "version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    rank = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    out = recs.withColumn("__rank", rank).join(F.broadcast(place), "vslot")  # one row per virtual slot
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("__base") + F.col("__rank") - 1).alias("slot"),
                      "vslot", F.col("version").alias("map_version")), versions
