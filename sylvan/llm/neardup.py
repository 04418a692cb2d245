"""SimHash near-duplicates with pivot distance tables.

Fingerprint: 64 bits over the 3-word shingles of the ASCII-lower-cased text.
Documents whose fingerprints differ in at most ``radius`` (2) bits are linked,
and linked documents form groups.

Links are sought among *distinct* fingerprints only, so a group of equal texts
is one fingerprint however many rows it has. The pivot table holds each
fingerprint's Hamming distances to reference fingerprints, taken apart by four
16-bit segments: ``PIVOTS`` references give 4 x ``PIVOTS`` coordinates. By the
triangle inequality coordinates of two fingerprints differ by no more than
their bits do within that segment.

Candidates come from the table alone: two bits touch at most two segments, so a
link has equal coordinates in two whole segments, and pairs meet under the
coordinates of ``KEY_PIVOTS`` references in two segments (six choices of two).
Of these, pairs whose largest coordinate difference is over the radius cannot
be links and are dropped; the rest are verified bit by bit.

A key that more than ``crowd`` fingerprints share (one large family of near
copies) emits no pairs: its members go another exact way. Two fingerprints are
two bits apart or less just if one and the same value lies within one bit of
both; each member names its 65 such values, at most 65 members name the same
one, and all members naming it link to the least of them. Work is linear in
the members and no link is lost.

Defined results: null or wordless text has fingerprint 0, linked like any
other; texts of one or two words have their whole word sequence as the only
shingle; rows may repeat; a null id belongs to its group, whose id is the
least non-null one; an empty table gives no rows; other columns are carried by
:func:`unique_documents` and never read. A text is held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sylvan.llm.common import materialise, release, spare, workers_ready
from sylvan.llm.components import components

WIDTH, SEED, RADIUS = 3, 42, 2
#: Reference fingerprints of the pivot table, and those whose coordinates candidates must share in two segments.
PIVOTS, KEY_PIVOTS = 16, 6
SEGMENTS = 4
#: Fingerprints under one key beyond which the one-bit way is taken.
CROWD = 64


def simhash(words: list[bytes], width: int = WIDTH) -> int:
    from xxhash import xxh64_intdigest
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    h = np.array([xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 1 << 14):
        part = h[lo:lo + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def _simhash_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    release()
    for pdf in batches:
        # bytes.lower() changes A-Z only and bytes.split() cuts at U+0020 and U+0009..U+000D
        f = np.fromiter((simhash((t or b"").lower().split()) for t in pdf["text"]), dtype=np.uint64, count=len(pdf))
        yield pd.DataFrame({"id": pdf["id"], "f": f.view(np.int64)})


def fingerprints(spark: SparkSession, docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """Written: id, f (the 64 bits as a signed long)."""
    workers_ready(spark)
    kind = docs.schema[key].dataType.simpleString()
    out = (docs.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
               .mapInPandas(_simhash_batches, "id string, f long").withColumn("id", F.col("id").cast(kind)))
    return materialise(spark, out, "near-prints")


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints by a rule: n splitmix-spread 64-bit values, as signed longs."""
    out = []
    for j in range(1, n + 1):
        z = j * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        z = (z ^ z >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        out.append(z ^ z >> 31)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def _coordinate(f: str, pivot: int, segment: int):
    """Hamming distance of a fingerprint's segment to a reference's."""
    mask = 0xFFFF << 16 * segment
    mask -= (1 << 64) if mask >> 63 else 0
    return F.bit_count(F.col(f).bitwiseXOR(F.lit(pivot)).bitwiseAND(F.lit(mask)))


def links(spark: SparkSession, prints: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Distinct fingerprints f -> edges (u, v) that connect whatever lies within the radius."""
    if radius != 2:
        raise ValueError("segments and the one-bit way are laid out for a radius of 2")
    refs = pivots()
    two = [(a, b) for a in range(SEGMENTS) for b in range(a + 1, SEGMENTS)]
    # a segment's key: its coordinates to the first references, 0 to 16, five bits each
    seg = [sum(F.shiftleft(_coordinate("f", p, s).cast("long"), 5 * j) for j, p in enumerate(refs[:KEY_PIVOTS])) for s in range(SEGMENTS)]
    keys = F.array(*[F.shiftleft(seg[a], 5 * KEY_PIVOTS) + seg[b] + F.lit(i << 10 * KEY_PIVOTS) for i, (a, b) in enumerate(two)])
    keyed = prints.select("f", F.explode(keys).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialise(spark, keyed.join(shared, "key"), "near-keys")
    table = F.array(*[_coordinate("f", p, s).cast("tinyint") for p in refs for s in range(SEGMENTS)])
    side = met.where(F.col("n") <= crowd).select("key", "f", table.alias("d"))
    a, b = side.toDF("key", "u", "du"), side.toDF("key", "v", "dv")
    apart = F.zip_with("du", "dv", lambda x, y: F.abs(x - y).cast("int"))
    pairs = (a.join(b, (a["key"] == b["key"]) & (F.col("u") < F.col("v")))
              .where(F.array_max(apart) <= radius)
              .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).select("u", "v"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    crowded = met.where(F.col("n") > crowd).select("f").distinct()
    near = (crowded.select("f", F.explode(flips).alias("x")).select("f", F.col("f").bitwiseXOR(F.col("x")).alias("spot"))
                   .groupBy("spot").agg(F.sort_array(F.collect_list("f")).alias("fs")).where(F.size("fs") > 1)
                   .select(F.element_at("fs", 1).alias("u"), F.explode(F.slice("fs", 2, 64)).alias("v")))
    return pairs.union(near)


def near_groups(spark: SparkSession, table: DataFrame) -> DataFrame:
    """A written (id, f) table -> f, component_id (least id of the group)."""
    prints = materialise(spark, table.groupBy("f").agg(F.min("id").alias("least")), "near-distinct")
    roots = materialise(spark, components(spark, links(spark, prints.select("f"))), "near-roots")
    rooted = prints.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialise(spark, rooted.join(least, "root").select("f", "component_id"), "near-groups")


def near_duplicates(spark: SparkSession, docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    table = fingerprints(spark, docs, key, text)
    return (table.join(near_groups(spark, table), "f")
                 .select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"))


def unique_documents(spark: SparkSession, docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """One document of each group, the one with the least (id, row); columns unchanged."""
    row = spare(docs, "row")
    rows = materialise(spark, docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    table = fingerprints(spark, rows.select(F.col(row).alias("row"), F.col(text).alias("text")), "row", "text")
    ids = rows.select(F.col(row).alias("row"), F.struct(F.col(key).isNull().alias("no_id"), F.col(key).alias("k"), F.col(row).alias("row")).alias("id"))
    table = materialise(spark, table.join(ids, table["id"] == ids["row"]).select(ids["id"], "f"), "near-ranked")
    stay = near_groups(spark, table).select(F.col("component_id.row").alias(row)).distinct()
    return rows.join(stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
