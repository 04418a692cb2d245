"""Quality rules as a short-circuit cascade.

Each rule is a cheap or dear test of one document. On a bounded sample of
documents (``SAMPLE``, chosen by hash) every rule runs alone; its mean cost and
the share it rejects give the order: most rejections per second first. A
document is then tested in that order until a rule rejects it, and a statistic
is worked out only when a rule first asks for it: the dear ones (distinct pairs
of words, line endings) only for documents that the rules before them let pass.
The order changes the cost, never the verdict, which is that no rule rejects.

Defined results: null text has no words and is rejected; rows may repeat; an
empty table gives no rows (rules stay in their given order); ids and other
columns are never read. A text is held whole by one task.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sylvan.llm.common import SPACES, text_or_empty, workers_ready

_WORDS = re.compile("[^\x20\x09-\x0d]+").findall
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Documents on which cost and rejection of the rules are measured, about.
SAMPLE = 400


class Stats:
    """Statistics of one text, each worked out on first use."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return _WORDS(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        number: dict[str, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in self.words], dtype=np.int64)
        v = len(number)
        if v == n:
            return 0
        pair = ids[:-1] * v + ids[1:]
        if v > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        three = pair[:-1] * v + ids[2:]
        _, where, count = np.unique(three, return_inverse=True, return_counts=True)
        hit = count[where] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k:k + n - 2] |= hit
        return int(covered.sum())


    @cached_property
    def n_pairs(self) -> int:
        """Distinct pairs of neighbouring words."""
        return len(set(zip(self.words, self.words[1:])))

    @cached_property
    def n_cut_lines(self) -> int:
        """Lines that break off in dots."""
        return sum(x.rstrip(SPACES).endswith("...") for x in self.lines)


#: name -> whether the rule rejects. All limits are whole-number tests, so SQL states them exactly.
RULES: dict[str, Callable[[Stats], bool]] = {
    "few_words": lambda s: s.n_words < 50,
    "repeats": lambda s: 100 * s.n_repeat_words > 50 * s.n_words,
    "word_length": lambda s: not 2 * s.n_words <= s.word_chars <= 15 * s.n_words,
    "symbols": lambda s: 100 * s.n_symbols > 10 * s.n_words,
    "dup_lines": lambda s: 100 * s.n_dup_lines > 30 * len(s.lines),
    "few_pairs": lambda s: 10 * s.n_pairs < s.n_words - 1,
    "cut_lines": lambda s: 100 * s.n_cut_lines > 30 * len(s.lines),
}
BASE = ("few_words", "repeats")


def measure(spark: SparkSession, docs: DataFrame, text: str = "text", rules: tuple[str, ...] = tuple(RULES),
            sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected), the best rejection per second first."""
    n = docs.count()
    # by text and place, so copies of one text are not all taken or all left
    part = docs.select(F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    part = part.where(F.pmod(F.xxhash64("text", "place"), F.lit(max(1, n // sample))) == 0).select("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name in rules:
                t0 = time.perf_counter()
                rejected = sum(RULES[name](Stats(t)) for t in pdf["text"])
                rows.append((name, time.perf_counter() - t0, float(rejected), len(pdf)))
            yield pd.DataFrame(rows, columns=["rule", "s", "rejected", "n"])

    workers_ready(spark)
    got = {r.rule: r for r in part.mapInPandas(run, "rule string, s double, rejected double, n long")
           .groupBy("rule").agg(F.sum("s").alias("s"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()}
    rated = [(name, got[name].s / got[name].n, got[name].rejected / got[name].n) if name in got else (name, 0.0, 0.0) for name in rules]
    return sorted(rated, key=lambda r: -r[2] / max(r[1], 1e-9))


def cascade(s: Stats, order: list[str]) -> tuple[str | None, list[str]]:
    """(the rule that rejects, the rules that were run to find out)."""
    ran = []
    for r in order:
        ran.append(r)
        if RULES[r](s):
            return r, ran
    return None, ran


def passing(spark: SparkSession, docs: DataFrame, text: str = "text", rules: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """The documents that no rule rejects, columns unchanged; a document costs the rules up to the one that rejects it."""
    order = [r[0] for r in measure(spark, docs, text, rules)]

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        return pd.Series([cascade(s, order)[0] is None for s in map(Stats, texts)], dtype=bool)

    return docs.where(passes(F.col(text).cast("string")))


def judged(spark: SparkSession, docs: DataFrame, statistics: tuple[str, ...], key: str = "doc_id", text: str = "text",
           rules: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """doc_id, the wanted statistics, rejected_by (null: kept), rules_run. Statistics are shared with the rules."""
    order = [r[0] for r in measure(spark, docs, text, rules)]
    names = [*statistics, "rejected_by", "rules_run"]
    schema = ", ".join(["id string", *(f"{s} long" for s in statistics), "rejected_by string", "rules_run array<string>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                s = Stats(t)
                by, ran = cascade(s, order)
                rows.append((*(getattr(s, k) for k in statistics), by, ran))
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).cast("string").alias("id"), text_or_empty(text).alias("text")).mapInPandas(run, schema)
                .select(F.col("id").cast(kind).alias("doc_id"), *names))


def quality_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the five statistics, base_failed, kept."""
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged(spark, docs, stats).select("doc_id", *stats, base.alias("base_failed"), (~base & F.col("rejected_by").isNull()).alias("kept"))
