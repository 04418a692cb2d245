"""Substring dedup with a count-min prefilter.

A window is ``width`` (13) consecutive words of one document. Every word is
removed that lies in a window whose word sequence also starts in a document
with a smaller id, all judged on the input.

Pass 1 hashes every window into a count-min sketch of two rows. A task emits
its cells sorted and gap-coded (about a byte each); the parts of one block of
cells are added up, saturating at two, by a task that streams over them, and
what is kept of a block is one bit a cell: two or more. The sketch has a fixed
size: twice as many cells as there may be windows, at most ``2**MAX_BITS`` a
row, so at most 64 MB of bits are broadcast whatever the corpus. It never
underestimates; when the corpus outgrows it, more windows pass and the second
pass has more to group, and none is lost.

Pass 2 looks only at windows estimated repeated. Whether a window of a row is
removed depends on the window and the row's id alone. Inside a task all
documents but the least of a window are settled at once, so a window that a
third of all documents share leaves one entry a task; that entry goes to the
task of its window, which compares it with the other tasks' entries. Further
rows of the same least id (an id may hold any share of the rows) wait apart,
by the batch they came in, for the verdict on that entry.

What comes out is kept by (id, ``part``), part being a 32-bit hash of the row's
text: it spreads the rows of one id, and rows equal in both share one list, of
each window once. It is joined back by both, and the text is cut there. Two
texts of one id in one part only share a list, as their verdicts are the same.

Windows are told apart by a 64-bit hash of their 13 word hashes (two different
windows among n collide with probability about n * n / 2**65).

Defined results: null text has no words; texts under 13 words keep all; ids are
integers, a null id counts as the largest; rows that repeat an id never remove
each other's words; an empty table gives no rows; other columns are never read.
A text is held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sylvan.llm.common import held, workers_ready

WIDTH = 13
#: log2 of the cells of a sketch row: at most, and of one block of them.
MAX_BITS, BLOCK_BITS = 28, 16
#: Windows after which a task hands on what it has, so its memory stays bounded.
FLUSH = 2_000_000
#: Windows estimated repeated that one second-pass task should meet.
PER_BUCKET = 1_000_000
#: Second-pass groups at least, so that many tasks share them at any size.
LEAST_BUCKETS = 128
#: Words a worker remembers, and the longest of them (longer ones are hashed each time).
REMEMBERED, LONGEST = 150_000, 64
_LAST_ID = (1 << 63) - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROW2 = np.uint64(0xD6E8FEB86659FD93)


class _Known(dict):
    """word -> its 64-bit hash, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest
        h = xxh64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:  # also within a text
                self.clear()
            self[word] = h
        return h


def window_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    known = held("word hashes", _Known)
    a = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    h = a[:n].copy()
    for k in range(1, width):
        h *= _STEP
        h += a[k:k + n]
    h ^= h >> np.uint64(29)
    h *= _ROW2
    return h


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    x = h if row == 0 else (h ^ (h >> np.uint64(31))) * _STEP
    return (x >> np.uint64(64 - bits)).astype(np.uint32)


def encode_cells(cells: np.ndarray) -> bytes:
    """Sorted cell numbers, repeats as gap 0; a byte 255 is a gap of 255 with no cell."""
    gaps = np.diff(cells.astype(np.int64), prepend=0)
    over = gaps // 255
    out = np.full(len(gaps) + int(over.sum()), 255, dtype=np.uint8)
    out[np.cumsum(over + 1) - 1] = gaps % 255
    return out.tobytes()


def decode_cells(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, dtype=np.uint8)
    return np.cumsum(a, dtype=np.int64)[a != 255]


def _blocks(hs: list[np.ndarray], bits: int, block: int) -> pd.DataFrame:
    rows = []
    h = np.concatenate(hs)
    for r in (0, 1):
        c = np.sort(_cells(h, r, bits))
        if len(c) > 2:  # a count over two says no more than two
            c = c[np.concatenate(([True, True], c[2:] != c[:-2]))]
        which = c >> np.uint32(block)
        starts = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        for lo, hi in zip(starts, np.append(starts[1:], len(c))):
            b = int(which[lo])
            rows.append((r, b, encode_cells(c[lo:hi] - np.uint32(b << block))))
    return pd.DataFrame(rows, columns=["r", "block", "cells"])


def repeated_cells(spark: SparkSession, texts: DataFrame, bits: int, width: int) -> np.ndarray:
    """The merged sketch as (2, 2**bits / 8) bytes, a bit for each cell counted twice or more."""
    block = min(bits, max(BLOCK_BITS, bits - 8))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            for t in pdf["text"]:
                h = window_hashes((t or b"").split(), width)
                if len(h):
                    held.append(h)
                    n += len(h)
                if n >= FLUSH:
                    yield _blocks(held, bits, block)
                    held, n = [], 0
        if held:
            yield _blocks(held, bits, block)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, acc = None, None
        done = lambda: pd.DataFrame({"r": [at[0]], "block": [at[1]], "twice": [np.packbits(acc >= 2, bitorder="little").tobytes()]})
        for pdf in batches:
            for r, b, data in zip(pdf["r"], pdf["block"], pdf["cells"]):
                if (r, b) != at:
                    if at is not None:
                        yield done()
                    at, acc = (r, b), np.zeros(1 << block, dtype=np.uint8)
                c = decode_cells(data)
                again = np.concatenate(([False], c[1:] == c[:-1]))
                acc[c[~again]] += 1
                acc[c[again]] += 1
                np.minimum(acc, 2, out=acc)
        if at is not None:
            yield done()

    merged = (texts.select("text").mapInPandas(parts, "r int, block int, cells binary")
                   .repartition("r", "block").sortWithinPartitions("r", "block")
                   .mapInPandas(merge, "r int, block int, twice binary"))
    out = np.zeros((2, 1 << (bits - 3)), dtype=np.uint8)
    size = 1 << (block - 3)
    for row in merged.collect():  # 2 ** (bits - 2) bytes in all: 64 MB at most
        out[row.r, row.block * size:(row.block + 1) * size] = np.frombuffer(row.twice, dtype=np.uint8)
    return out


#: Rows of the second pass: windows to remove, windows waiting for a verdict, least windows of a batch, verdicts to remove.
GONE, WAITING, OPEN, VERDICT = range(4)
_FIELDS = ["slot", "kind", "batch", "doc", "part", "hs", "docs", "parts", "crowd"]
_PASS2 = "slot long, kind int, batch long, doc long, part int, hs binary, docs binary, parts binary, crowd binary"


def _cuts(*keys: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of each stretch of equal keys in parallel sorted arrays."""
    n = len(keys[0])
    if not n:
        return []
    starts = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), n]))


def _by_row(doc: np.ndarray, part: np.ndarray, h: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(document, part, its windows, each once) from parallel arrays."""
    o = np.lexsort((h, part, doc))
    doc, part, h = doc[o], part[o], h[o]
    if len(h):
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])))
        doc, part, h = doc[new], part[new], h[new]
    return [(int(doc[lo]), int(part[lo]), h[lo:hi].tobytes()) for lo, hi in _cuts(doc, part)]


def _piece(batch, h: np.ndarray):
    """What of a batch waits together: its windows in 16 pieces."""
    return batch * 16 + (h & np.uint64(15)).astype(np.int64)


def _spread(a: int, b: int, buckets: int) -> int:
    return ((a * int(_STEP) + b * int(_ROW2)) >> 32) % buckets


def _gone(doc: np.ndarray, part: np.ndarray, h: np.ndarray, buckets: int) -> list[tuple]:
    return [(_spread(d, p, buckets), GONE, 0, d, p, x, None, None, None) for d, p, x in _by_row(doc, part, h)]


def _joined(column: pd.Series, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype=dtype) for x in column])


def _settle(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by window; (the order, whether a smaller document has the window, in that order)."""
    o = np.argsort(h, kind="stable")
    h, doc = h[o], doc[o]
    first = np.concatenate(([True], h[1:] != h[:-1]))
    least = np.minimum.reduceat(doc, np.flatnonzero(first))
    return o, doc > least[np.cumsum(first) - 1]


def hand_on(held: list[tuple[int, int, np.ndarray]], batch: int, buckets: int) -> pd.DataFrame:
    """What a batch of (document, part, windows) leaves for the second pass."""
    sizes = [len(x) for *_, x in held]
    h = np.concatenate([x for *_, x in held])
    doc = np.repeat(np.array([d for d, *_ in held], dtype=np.int64), sizes)
    part = np.repeat(np.array([p for _, p, _ in held], dtype=np.int32), sizes)
    o, late = _settle(h, doc)
    h, doc, part = h[o], doc[o], part[o]
    rows = _gone(doc[late], part[late], h[late], buckets)
    h, doc, part = h[~late], doc[~late], part[~late]  # never empty: each window has its least
    keep = np.concatenate(([True], h[1:] != h[:-1]))
    nth = np.cumsum(keep) - 1
    waits = part != part[keep][nth]  # another row of the least id; equal rows share the entry
    crowd = np.zeros(int(nth[-1]) + 1, dtype=np.uint8)
    crowd[nth[waits]] = 1
    if waits.any():
        w = np.flatnonzero(waits)
        w = w[np.lexsort((part[w], h[w], _piece(batch, h[w])))]
        w = w[np.concatenate(([True], (h[w[1:]] != h[w[:-1]]) | (part[w[1:]] != part[w[:-1]])))]
        pieces = _piece(batch, h[w])
        for lo, hi in _cuts(pieces):
            g, x = int(pieces[lo]), w[lo:hi]
            rows.append((_spread(g, 0, buckets), WAITING, g, 0, 0, h[x].tobytes(), doc[x].tobytes(), part[x].tobytes(), None))
    h, doc, part = h[keep], doc[keep], part[keep]
    b = (h & np.uint64(buckets - 1)).astype(np.int64)
    o = np.lexsort((doc, b))
    h, doc, part, crowd, b = h[o], doc[o], part[o], crowd[o], b[o]
    for lo, hi in _cuts(b):
        rows.append((int(b[lo]), OPEN, batch, 0, 0, h[lo:hi].tobytes(), doc[lo:hi].tobytes(), part[lo:hi].tobytes(),
                     crowd[lo:hi].tobytes() if crowd[lo:hi].any() else None))
    return pd.DataFrame(rows, columns=_FIELDS)


def meet(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """The batches' least entries of some windows compared; what is no such entry goes on as it is."""
    open_ = pdf[pdf["kind"] == OPEN]
    rest = pdf[pdf["kind"] != OPEN]
    if not len(open_):
        return rest
    h, doc, part = _joined(open_["hs"], np.uint64), _joined(open_["docs"], np.int64), _joined(open_["parts"], np.int32)
    sizes = [len(x) // 8 for x in open_["hs"]]
    batch = np.repeat(open_["batch"].to_numpy(dtype=np.int64), sizes)
    crowd = np.concatenate([np.zeros(n, dtype=np.uint8) if x is None else np.frombuffer(x, dtype=np.uint8) for n, x in zip(sizes, open_["crowd"])])
    o, late = _settle(h, doc)
    o = o[late]
    rows = _gone(doc[o], part[o], h[o], buckets)
    o = o[crowd[o] == 1]
    pieces = _piece(batch[o], h[o])
    by = np.argsort(pieces, kind="stable")
    pieces, o = pieces[by], o[by]
    for lo, hi in _cuts(pieces):
        g = int(pieces[lo])
        rows.append((_spread(g, 0, buckets), VERDICT, g, 0, 0, h[o[lo:hi]].tobytes(), None, None, None))
    return pd.concat([rest, pd.DataFrame(rows, columns=_FIELDS)]) if rows else rest


def release(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """(doc, part, hs): windows to remove, with those that waited for a verdict."""
    gone = pdf[pdf["kind"] == GONE]
    rows = list(zip(gone["doc"], gone["part"], gone["hs"]))
    verdicts = pdf[pdf["kind"] == VERDICT].groupby("batch")["hs"].agg(lambda c: b"".join(c)).to_dict()
    for g, hs, docs, parts in pdf.loc[pdf["kind"] == WAITING, ["batch", "hs", "docs", "parts"]].itertuples(index=False):
        if g in verdicts:
            h = np.frombuffer(hs, dtype=np.uint64)
            hit = np.isin(h, np.frombuffer(verdicts[g], dtype=np.uint64))
            rows += _by_row(np.frombuffer(docs, dtype=np.int64)[hit], np.frombuffer(parts, dtype=np.int32)[hit], h[hit])
    # batches with equal rows name the same windows: each goes on once
    by_row: dict[tuple[int, int], set[bytes]] = {}
    for d, p, x in rows:
        by_row.setdefault((d, p), set()).add(x)
    out = [(d, p, np.frombuffer(xs.pop(), dtype=np.int64) if len(xs) == 1 else np.unique(np.frombuffer(b"".join(xs), dtype=np.int64)))
           for (d, p), xs in by_row.items()]
    return pd.DataFrame(out, columns=["doc", "part", "hs"])


def removable(spark: SparkSession, texts: DataFrame, twice: np.ndarray, bits: int, buckets: int, width: int) -> DataFrame:
    """(doc, part, hs): rows, and the windows of theirs that a smaller document has too."""
    shared = spark.sparkContext.broadcast(twice)

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        batch = TaskContext.get().partitionId() << 32  # and the place in the task
        bitmap, held, n = shared.value, [], 0
        seven = np.uint32(7)
        for pdf in batches:
            for d, p, t in zip(pdf["doc"], pdf["part"], pdf["text"]):
                h = window_hashes((t or b"").split(), width)
                for r in (0, 1):
                    if len(h):
                        c = _cells(h, r, bits)
                        h = h[(bitmap[r][c >> np.uint32(3)] >> (c & seven).astype(np.uint8)) & 1 == 1]
                if len(h):
                    held.append((d, p, h))
                    n += len(h)
                if n >= FLUSH:
                    yield hand_on(held, batch, buckets)
                    batch, held, n = batch + 1, [], 0
        if held:
            yield hand_on(held, batch, buckets)

    return (texts.mapInPandas(candidates, _PASS2)
                 .groupBy("slot").applyInPandas(lambda pdf: meet(pdf, buckets), _PASS2)
                 .groupBy("slot").applyInPandas(lambda pdf: release(pdf, buckets), "doc long, part int, hs array<long>"))


def _cut(width: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, hs in zip(pdf["text"], pdf["hs"]):
                words = (t or b"").split()
                n = len(words)
                if hs is not None and len(hs):
                    hit = np.isin(window_hashes(words, width), np.asarray(hs, dtype=np.int64).view(np.uint64))
                    edge = np.zeros(n + 1, dtype=np.int64)
                    edge[:len(hit)] += hit
                    edge[width:width + len(hit)] -= hit
                    gone = np.cumsum(edge[:n]) > 0
                    words = [w for w, g in zip(words, gone) if not g]
                out.append((n, n - len(words), b" ".join(words)))
            yield pd.DataFrame({"id": pdf["id"], "n_words": [o[0] for o in out], "n_removed": [o[1] for o in out], "kept": [o[2] for o in out]})
    return cut


def substring_dedup(spark: SparkSession, docs: DataFrame, key="doc_id", text="text", width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the text that is left, UTF-8 bytes)."""
    workers_ready(spark)
    raw = F.col(text).cast("string").cast("binary")
    row = [F.coalesce(F.col(key).cast("long"), F.lit(_LAST_ID)).alias("doc"), F.hash(raw).alias("part"), raw.alias("text")]
    texts = docs.select(*row)
    # a window needs a word and a space at least; about six bytes a word are usual
    may_be = (docs.select(F.sum(F.octet_length(raw))).first()[0] or 0) // 6 + 1
    bits = min(max_bits, max(12, (2 * may_be - 1).bit_length()))
    buckets = max(LEAST_BUCKETS, 1 << (may_be // (2 * PER_BUCKET)).bit_length())
    twice = repeated_cells(spark, texts, bits, width)
    # a row's windows at most, and those once for each batch that has an equal row
    gone = (removable(spark, texts, twice, bits, buckets, width).groupBy("doc", "part")
            .agg(F.array_distinct(F.flatten(F.collect_list("hs"))).alias("hs")))
    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).cast("string").alias("id"), *row).join(gone, ["doc", "part"], "left").select("id", "text", "hs")
                .mapInPandas(_cut(width), "id string, n_words long, n_removed long, kept binary")
                .select(F.col("id").cast(kind).alias("doc_id"), "n_words", "n_removed", "kept"))
