"""Packing by concatenate-and-cut.

The corpus is one long run of token ids, each document closed by an end id,
cut every ``width`` ids; only the last sequence is short, so there is no
padding but there. Two passes give global offsets: the first tokenizes every
document once and writes its ids with its offset inside its partition; the
partition totals (one row per partition) are summed up in partition order; the
second pass adds both and cuts each document at the window borders. A document
over a border leaves one piece on either side.

Words are encoded apart and remembered: the tokenizer drops white space and
never looks across it, so a text's ids are its words' ids in a row (tested
against whole-text encoding).

Defined results: null text counts as empty (one piece, the end id alone);
ids repeat freely (each row is packed); an empty table gives no rows; other
columns are never read. A document's ids are held by one task, as its text is.
"""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from sylvan.llm.common import held, materialise, text_or_empty, workers_ready

WIDTH, END_ID = 2048, 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes that the words a worker remembers take, about (half of them of words not used lately).
REMEMBERED = 160 << 20
#: Words of a text that are encoded together.
TOGETHER = 50_000
#: Marks that may end a word; the tokenizer parts them from the letters before.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_TAIL_BYTES = _TAIL.encode()


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class _Known(dict):
    """word (UTF-8) -> little-endian uint32 ids, encoded when first asked for.

    Most words are letters with marks after them. The tokenizer lower-cases
    these, parts letters from marks, and gives either to its model; asking the
    model for the letters alone skips the steps that change nothing. Every other
    word goes through the whole tokenizer.

    Memory is bounded by bytes: once half of it is full, what is known becomes
    ``old``, the old before it is dropped, and words still in use move over.
    """

    def __init__(self, tok):
        from tokenizers import pre_tokenizers
        self.tok, self.model = tok, tok.model
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.packed = [struct.pack("<I", i) for i in range(tok.get_vocab_size())]
        self.tails: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.used = 0

    def whole(self, word: str) -> bytes:
        return np.asarray(self.tok.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def tail(self, marks: bytes) -> bytes:
        if marks not in self.tails:
            if len(self.tails) > 1000:
                self.tails.clear()
            self.tails[marks] = self.whole(marks.decode())
        return self.tails[marks]

    def encoded(self, word: bytes) -> bytes:
        core = word.rstrip(_TAIL_BYTES)
        if core.isalpha():  # ASCII letters
            low = core.lower().decode()
        else:
            letters = core.decode()
            low = letters.lower()
            # a final sigma is lower-cased by its place, a decomposed letter is composed first
            if core.isascii() or not low.isalpha() or "\u03a3" in letters or not unicodedata.is_normalized("NFC", letters):
                return self.whole(word.decode())
            low = self.as_bytes.pre_tokenize_str(low)[0][0]
        packed = self.packed
        out = b"".join([packed[t.id] for t in self.model.tokenize(low)])
        if len(core) == len(word):
            return out
        marks = word[len(core):]
        return out + (self.tails.get(marks) or self.tail(marks))

    def __missing__(self, word: bytes) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self.encoded(word)
        self[word] = out
        self.used += len(word) + len(out) + 200  # two objects and their place in the table
        return out

    def trim(self, most: int) -> None:
        if self.used > most // 2:
            self.old = dict(self)
            self.clear()
            self.used = 0


class WordEncoder:
    """text (UTF-8) -> little-endian uint32 ids, a word at a time."""

    def __init__(self, name: str, remembered: int = REMEMBERED):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.known, self.remembered = _Known(Tokenizer.from_file(tokenizer_path(name))), remembered

    def __call__(self, text: bytes | str) -> bytes:
        if isinstance(text, str):
            text = text.encode()
        # bytes.split() cuts at U+0020 and U+0009..U+000D and nothing else
        words = text.split()
        out = []
        for lo in range(0, len(words), TOGETHER):
            out += map(self.known.__getitem__, words[lo:lo + TOGETHER])
            self.known.trim(self.remembered)
        return b"".join(out)


def encoder(name: str) -> WordEncoder:
    """One encoder per worker process."""
    return held(("encoder", name), lambda: WordEncoder(name))


def tokenized(spark: SparkSession, docs: DataFrame, key="doc_id", text="text", tokenizer=TOKENIZER, end_id=END_ID) -> DataFrame:
    """Written: doc_id, part, before (ids of earlier documents of the partition), n, ids (binary)."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                p = pdf.iloc[lo:lo + 500]
                ids = [enc(t or b"") + end for t in p["text"]]
                n = np.fromiter((len(b) // 4 for b in ids), dtype=np.int64, count=len(ids))
                ends = np.cumsum(n) + before
                yield pd.DataFrame({"doc_id": p["doc_id"].to_numpy(), "part": part, "before": ends - n, "n": n, "ids": ids})
                before = int(ends[-1])

    workers_ready(spark)
    src = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    # ids travel as text, so that a null among them stays a null and no long becomes a float
    kind = src.schema["doc_id"].dataType.simpleString()
    out = (src.withColumn("doc_id", F.col("doc_id").cast("string"))
              .mapInPandas(encode, "doc_id string, part int, before long, n long, ids binary")
              .withColumn("doc_id", F.col("doc_id").cast(kind)))
    return materialise(spark, out, "pack-ids")


def pack(spark: SparkSession, docs: DataFrame, key="doc_id", text="text", width: int = WIDTH,
         tokenizer=TOKENIZER, end_id=END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian uint32)."""
    rows = tokenized(spark, docs, key, text, tokenizer, end_id)
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    # one row per partition, so the running sum over them is small by construction
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    w = F.lit(width).cast("long")
    at = F.col("at")

    def piece(s):
        lo = F.greatest(s * w, at)
        hi = F.least((s + 1) * w, at + F.col("n"))
        start = lo - at
        return F.struct(start.alias("start"), (hi - lo).alias("length"), s.alias("sequence_id"), (lo - s * w).alias("offset"),
                        F.substring("ids", (start * 4 + 1).cast("int"), ((hi - lo) * 4).cast("int")).alias("ids"))

    cut = (rows.join(F.broadcast(base), "part").withColumn("at", F.col("base") + F.col("before"))
               .select("doc_id", F.col("n").alias("doc_tokens"),
                       F.explode(F.transform(F.sequence(F.floor(at / w), F.floor((at + F.col("n") - 1) / w)), piece)).alias("p")))
    return cut.select("doc_id", "p.start", "p.length", "doc_tokens", "p.sequence_id", "p.offset", "p.ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the pieces of each window put together (``width`` ids at most a group)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p"))
                  .select("sequence_id", "length", F.concat(F.lit(b""), F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("h"))
                  .select("sequence_id", "length", F.unhex(F.col("h").cast("string")).alias("ids")))
