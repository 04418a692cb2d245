"""Mixing, sharding and exact dedup against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from sylvan.llm import exactdup, mixing, neardup, sharding

import fixture

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")


def targets(sizes: dict, weights=(5, 2, 1)):
    """Share 150 % by weight; cap at twice the size; share what is over again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, out, open_ = Fraction(3, 2) * sum(sizes.values()), {}, set(order)
    while open_:
        share = {s: budget * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        out |= {s: Fraction(2 * sizes[s]) for s in over}
        budget -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return out


def test_mix_targets_and_takes(spark):
    data = fixture.rows()
    out = mixing.mix_sizes(spark, fixture.frame(spark)).collect()
    assert len(out) == len(data)
    sizes = Counter()
    for r in data:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    want = targets(dict(sizes))
    by_size = defaultdict(set)
    for s in sizes:
        by_size[sizes[s]].add(round(float(want[s]), 6))
    assert Counter(r.size for r in out) == Counter(len(WORDS.findall(r[1] or "")) for r in data)
    for r in out:
        assert round(r.target, 6) in by_size[r.source_size]
        assert r.taken in (0, r.size, 2 * r.size)
    longest = max(r.size for r in out)
    for n in by_size:
        if len(by_size[n]) == 1 and list(sizes.values()).count(n) == 1:
            assert abs(sum(r.taken for r in out if r.source_size == n) - by_size[n].copy().pop()) <= longest
    again = mixing.mix_sizes(spark, fixture.frame(spark).repartition(3)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


@pytest.mark.parametrize("n", [1, 2, 3000])
def test_targets_of_many_sources(spark, n):
    """Ranges and what stands before them give the targets of plain Python, with ties, empty sources and a null one."""
    sizes = {f"s{i * 7919 % 100003:06d}": [0, 1, 50, 50, 50, 1000, 10 ** 9][i % 7] + (i % 11 == 0) * i for i in range(n)} | {None: 40}
    want = targets(sizes)
    t = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(4)
    for parts in (1, 4):
        got = {r.source: r for r in mixing.source_targets(t.repartition(parts)).collect()}
        assert got.keys() == sizes.keys()
        for s, r in got.items():
            assert r.source_size == sizes[s] and r.target == pytest.approx(float(want[s]), rel=1e-12)
    none = mixing.source_targets(t.where("false"))
    assert none.columns == ["source", "source_size", "target"] and none.count() == 0


def test_mixed_repeats_documents_as_taken(spark):
    docs = fixture.frame(spark, fixture.rows(repeat_ids=False))
    got = mixing.mixed(spark, docs)
    assert got.columns == docs.columns
    n = Counter((r.doc_id, r.text) for r in got.collect())
    for r in mixing.mix_sizes(spark, docs).where("doc_id is not null and size > 0").collect():
        assert sum(v for (i, _), v in n.items() if i == r.doc_id) * r.size == r.taken


def test_mix_thresholds_nest(spark):
    docs = fixture.frame(spark)
    small = {(r.doc_id, r.size): r.taken for r in mixing.mix_sizes(spark, docs, share=(1, 2)).collect()}
    for r in mixing.mix_sizes(spark, docs, share=(5, 4)).collect():
        assert r.taken >= small[(r.doc_id, r.size)]


def test_exact_dedup(spark):
    data = fixture.rows()
    out = exactdup.dedup_report(spark, fixture.frame(spark)).collect()
    norm = lambda t: SPACE.sub("", t or "")
    groups = defaultdict(list)
    for r in data:
        groups[hashlib.sha256(norm(r[1]).encode()).hexdigest()].append(r)
    assert len(out) == len(data)
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert kept == Counter(groups.keys())
    for r in out:
        g = groups[r.text_sha256]
        best = min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        assert (r.group_size, r.keep_id) == (len(g), best[0])
        assert not r.kept or r.doc_id == best[0]
    docs = fixture.frame(spark)
    stay = exactdup.deduplicated(spark, docs)
    assert stay.columns == docs.columns
    assert Counter(hashlib.sha256(norm(r.text).encode()).hexdigest() for r in stay.collect()) == kept


@pytest.mark.parametrize("keep", [exactdup.deduplicated, mixing.mixed, neardup.unique_documents])
def test_kept_rows_are_rows_of_the_input(spark, keep):
    """Whatever an operator calls its own columns, the document's come back as they were."""
    docs = fixture.frame(spark)
    assert set(map(tuple, keep(spark, docs).collect())) <= set(fixture.rows())


def test_frequent_digests_are_split_off(spark):
    docs = fixture.frame(spark)
    table = exactdup.digests(docs).cache()
    top = exactdup.frequent(table, share=0.2).collect()
    assert len(top) == 1 and top[0].group_size >= 20


@pytest.mark.parametrize("shards", [40, 3])
def test_sharding_by_bytes(spark, shards):
    data = fixture.rows()
    out, versions = sharding.sharded(spark, fixture.frame(spark), shards)
    got = out.collect()
    raw = [(r[1] or "").encode() for r in data]
    assert Counter((r.size, r.text_crc32) for r in got) == Counter((len(b) + 16, crc32(b)) for b in raw)
    places = defaultdict(list)
    load = Counter()
    for r in got:
        places[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and set(places) <= set(range(shards))
    assert max(load.values()) <= sum(load.values()) / shards + max(len(b) + 16 for b in raw)
    per = versions.groupBy("version").agg(F.count("*").alias("n"), F.countDistinct("vslot").alias("d")).collect()
    assert sorted((r.version, r.n, r.d) for r in per) == [(0, 8192, 8192), (1, 8192, 8192)]


def test_grow_moves_only_into_the_new_shard(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))
    _, versions = sharding.sharded(spark, docs, 6)
    last = versions.where("version = 1")
    more = sharding.grow(last, 6)
    moved = last.join(more.select("vslot", F.col("shard").alias("to"), F.col("version").alias("v")), "vslot")
    assert moved.where("shard != to and to != 6").count() == 0 and moved.where("v != 2").count() == 0
    b = {r.to: r.b for r in moved.groupBy("to").agg(F.sum("bytes").alias("b")).collect()}
    assert len(b) == 7 and max(b.values()) < 1.2 * min(b.values())
    again, v2 = sharding.sharded(spark, docs, 7, slot_map=more)
    assert {r[0] for r in v2.select("version").distinct().collect()} == {2, 3} and again.count() == 3000


def test_empty_tables(spark):
    docs = fixture.empty(spark)
    assert mixing.mix_sizes(spark, docs).count() == 0 and mixing.mixed(spark, docs).count() == 0
    assert exactdup.dedup_report(spark, docs).count() == 0 and exactdup.deduplicated(spark, docs).count() == 0
    assert sharding.sharded(spark, docs, 40)[0].count() == 0


@pytest.mark.parametrize("plan", [lambda s, d: mixing.mix_sizes(s, d), lambda s, d: sharding.sharded(s, d)[0], lambda s, d: exactdup.dedup_report(s, d)])
def test_no_python_in_the_plans(spark, plan):
    text = plan(spark, fixture.frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


# --- one row repeated very often --------------------------------------------------

def crowded(spark, n=2000, copies=1000):
    """n documents, and one row ``copies`` times."""
    data = [(i, f"words of document {i} " * (i % 7 + 1), "abc"[i % 3]) for i in range(n)]
    data += [(77, "the same row again and again " * 3, "a")] * copies + [(None, None, None)] * (copies // 2)
    return spark.createDataFrame(data, "doc_id long, text string, source string").repartition(6)


def test_mix_takes_repeated_rows_one_by_one(spark):
    out = mixing.mix_sizes(spark, crowded(spark)).collect()
    taken, target, largest = Counter(), {}, Counter()
    total = Counter(r.source_size for r in out)
    for r in out:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        largest[r.source_size] = max(largest[r.source_size], r.size)
        assert r.taken <= 2 * r.size
    for s in total:
        assert abs(taken[s] - target[s]) <= largest[s], s
    again = mixing.mix_sizes(spark, crowded(spark).repartition(3)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    mixed = mixing.mixed(spark, crowded(spark))
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(WORDS.findall(r.text or ""))
    assert sorted(words.values()) == sorted(v for v in taken.values() if v)


def test_shards_stay_equal_with_a_repeated_row(spark):
    out, _ = sharding.sharded(spark, crowded(spark), 8)
    load, rows = Counter(), Counter()
    for r in out.collect():
        load[r.shard] += r.size
        rows[r.shard] += 1
    mean = sum(load.values()) / 8
    assert all(abs(v - mean) < 0.05 * mean for v in load.values())
    places = defaultdict(list)
    for r in out.collect():
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
