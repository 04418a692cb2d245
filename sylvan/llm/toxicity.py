"""Toxicity by maximum-scoring segments over token log-odds.

A token's score is its log-odds of standing in a toxic document against a
clean one, under a Dirichlet prior proportional to its share of all documents,
less one standard error; the token's first four and five letters are scored
the same way, so unseen forms of a known stem count. Tokens without evidence
cost a fixed amount. A linear-time scan (all maximal scoring subsequences)
finds every passage that scores, and extreme-value statistics say which are
significant: with lambda and K of the clean documents' score distribution a
segment of score S in n tokens has E = K n exp(-lambda S). A document's
evidence, its strongest segment and the sum over significant ones, is turned
into a probability by a logistic fit on cross-fitted evidence (each half of
the sample scored with the other half's lexicon).

The model is fitted on a bounded sample of labelled rows: about ``DOCS`` at
most, chosen by hash, one text of each id, equal texts once; the lexicon holds at most ``LEXICON``
tokens.

Defined results: null or empty text has no evidence and gets the score of
that; without labels of both kinds every score is the share of toxic labels
(0 if there are none); of several labels of one id the largest counts, null
labels and null ids of labels are passed over; rows may repeat; an empty table
gives no rows; other columns are never read. A text is held whole by one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sylvan.llm.common import id_crc32, materialise, text_or_empty, workers_ready
from sylvan.llm.langid import words_of

#: Bounds of the sample and of the lexicon.
DOCS, LEXICON = 12_000, 30_000
#: What a token without evidence costs, and the least |log-odds| / standard error of one with.
COST, LEAST_Z = 0.3, 2.2
CUT = 0.3
#: Words a worker remembers, and the longest of them (longer ones are looked up each time).
REMEMBERED, LONGEST = 100_000, 64


def token_features(w: str) -> tuple[str, ...]:
    """The token itself and its stems (marked with a digit, which no token has)."""
    return (w, "4" + w[:4], "5" + w[:5]) if len(w) > 5 else (w, "4" + w[:4]) if len(w) > 4 else (w,)


def log_odds(t: np.ndarray, n: np.ndarray, toxic: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, standard error) of features in t toxic of n documents, under the Dirichlet prior."""
    strength = total / 6
    a, clean = strength * np.maximum(n, 1e-9) / total, total - toxic
    y, c = t + a, n - t + a
    odds = np.log(y / np.maximum(toxic + strength - y, 1e-9)) - np.log(c / np.maximum(clean + strength - c, 1e-9))
    return odds, np.sqrt(1 / y + 1 / c)


def segments(at: np.ndarray, scores: np.ndarray, cost: float = COST) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a token row: ``scores`` at positions ``at``, -cost elsewhere."""
    out: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest earlier one that begins lower
    total = 0.0
    for i, (p, s) in enumerate(zip(at.tolist(), scores.tolist())):
        before = total - cost * (p - i)
        total += s
        start, end, left, right = p, p + 1, before, before + s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                out.append((start, end, left, right, j))
                break
            start, left = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, r - l) for a, b, l, r, _ in out]


class Scorer(dict):
    """Token scores of a lexicon, remembered per word in bounded space."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        s = max(self.lexicon.get(f, 0.0) for f in token_features(word))
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:  # also within a text
                self.clear()
            self[word] = s
        return s

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the tokens that have evidence."""
        s = np.fromiter(map(self.__getitem__, words), dtype=float, count=len(words))
        at = np.flatnonzero(s > 0)
        return at, s[at]


class Model:
    """lexicon, lambda, K, and the logistic's weights (constant, strongest, sum)."""

    def __init__(self, lexicon: dict[str, float], lam: float, k: float, weights: np.ndarray):
        self.lexicon, self.lam, self.k, self.weights = lexicon, lam, k, weights

    def evidence(self, n: int, scores: list[float]) -> tuple[float, float]:
        return evidence(n, scores, self.lam, self.k)

    def probability(self, strongest: float, total: float) -> float:
        z = float(self.weights @ np.array([1.0, strongest, total]))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def evidence(n: int, scores: list[float], lam: float, k: float) -> tuple[float, float]:
    """(strongest, sum over significant segments) of -ln E, on a log scale."""
    x = [v for s in scores if (v := lam * s - np.log(k * max(n, 1))) > 0]
    return (float(np.log1p(max(x))), float(np.log1p(sum(x)))) if x else (0.0, 0.0)


def solve_lambda(scores: np.ndarray, times: np.ndarray, n: int, cost: float = COST) -> float:
    """The positive root of E[exp(lambda s)] = 1 over n clean tokens, of which ``times`` have each of the positive ``scores``."""
    # one more, so rare hits do not make it infinite
    scores, times = np.append(scores, scores.max() if len(scores) else 5.0), np.append(times, 1)
    share = (n + 1 - times.sum()) / (n + 1)
    f = lambda x: (times * np.exp(np.minimum(x * scores, 60))).sum() / (n + 1) + share * np.exp(-x * cost) - 1
    lo, hi = 1e-4, 20.0
    if f(lo) >= 0:
        return lo
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)]) + 1e-6 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(key: str = "doc_id") -> Column:
    return id_crc32(key) % 4 == 2


def training_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, docs_bound: int = DOCS) -> DataFrame:
    """Written: text, toxic, fold; about ``docs_bound`` rows at most."""
    own = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
                 .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = own.count()
    picked = own.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(max(1, -(-n // docs_bound)))) == 0).limit(2 * docs_bound)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")  # bounded by the limit
    h = F.xxhash64("text")
    # one text an id: an id that holds a third of all rows adds one row to the sample
    rows = rows.groupBy("doc_id").agg(F.min_by("text", h).alias("text"), F.first("toxic").alias("toxic"))
    return materialise(spark, rows.groupBy(h.alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
                       .select("text", "toxic", F.pmod("h", F.lit(2)).cast("int").alias("fold")), "tox-sample")


def learn_lexicons(spark: SparkSession, sample: DataFrame) -> tuple[list[dict[str, float]], dict[str, float], int, int]:
    """([without fold 0, without fold 1], with both, toxic, total)."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c: Counter = Counter()
            for t, y, fold in zip(pdf["text"], pdf["toxic"], pdf["fold"]):
                c.update((f, fold, y) for f in {f for w in set(words_of(t)) for f in token_features(w)})
            yield pd.DataFrame([(f, fold, y, n) for (f, fold, y), n in c.items()], columns=["f", "fold", "y", "n"])

    sizes = {(r.fold, r.toxic): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, total = sum(n for (_, y), n in sizes.items() if y == 1), sum(sizes.values())
    if not 0 < toxic < total:
        return [{}, {}], {}, toxic, total
    cell = lambda fold, y: F.sum(F.when((F.col("fold") == fold) & (F.col("y") == y), F.col("n")).otherwise(0))
    t = F.col("t0") + F.col("t1")
    seen = (sample.mapInPandas(count, "f string, fold int, y int, n long").groupBy("f")
                  .agg(cell(0, 1).alias("t0"), cell(1, 1).alias("t1"), cell(0, 0).alias("c0"), cell(1, 0).alias("c1"))
                  .where((t >= 2) & (t * total > 2 * toxic * (t + F.col("c0") + F.col("c1"))))
                  .orderBy(F.desc(t * t / (t + F.col("c0") + F.col("c1"))), "f").limit(LEXICON).toPandas())

    def lexicon(t: np.ndarray, c: np.ndarray, folds: tuple[int, ...]) -> dict[str, float]:
        y = sum(sizes.get((f, 1), 0) for f in folds)
        n = y + sum(sizes.get((f, 0), 0) for f in folds)
        if not 0 < y < n:
            return {}
        odds, error = log_odds(t.astype(float), (t + c).astype(float), y, n)
        keep = (t > 1) & (odds > LEAST_Z * error)
        return dict(zip(seen["f"][keep], (odds - error)[keep].clip(0.1, 8.0)))

    t0, t1, c0, c1 = (seen[k].to_numpy() for k in ("t0", "t1", "c0", "c1"))
    return [lexicon(t1, c1, (1,)), lexicon(t0, c0, (0,))], lexicon(t0 + t1, c0 + c1, (0, 1)), toxic, total


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, docs_bound: int = DOCS) -> Model:
    workers_ready(spark)
    sample = training_sample(spark, docs, labels, docs_bound)
    crossed, lexicon, toxic, total = learn_lexicons(spark, sample)
    share = toxic / total if total else 0.0
    if not 0 < share < 1 or not lexicon:
        return Model({}, 1.0, 1.0, np.array([np.log((share + 1e-12) / (1 - share + 1e-12)), 0.0, 0.0]))
    lexicons = spark.sparkContext.broadcast(crossed)

    def found(pdf: pd.DataFrame, scorers: list[Scorer]) -> Iterator[tuple[int, int, np.ndarray, list[float]]]:
        for t, y, fold in zip(pdf["text"], pdf["toxic"], pdf["fold"]):
            words = words_of(t)
            at, s = scorers[fold](words)
            yield y, len(words), s, [x for _, _, x in segments(at, s)]

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of clean texts: (tokens, strongest segment) of each, and how many tokens have each score (n is null)."""
        scorers = [Scorer(x) for x in lexicons.value]
        for pdf in batches:
            rows, hits = [], Counter()
            for y, n, s, x in found(pdf, scorers):
                if y == 0:
                    hits.update(s.tolist())
                    rows.append((n, max(x, default=0.0), 1))
            yield pd.DataFrame(rows + [(None, v, k) for v, k in hits.items()], columns=["n", "x", "times"]).astype({"n": "Int64"})

    # one row for a clean text of the sample at most, and one for each score of the lexicons
    got = (sample.mapInPandas(clean, "n long, x double, times long").groupBy("n", "x").agg(F.sum("times").alias("times"))
                 .orderBy("n", "x").toPandas())
    hits, rows = got[got["n"].isna()], got[got["n"].notna()]
    n, best, many = rows["n"].to_numpy(dtype=float), rows["x"].to_numpy(), rows["times"].to_numpy()
    lam = solve_lambda(hits["x"].to_numpy(), hits["times"].to_numpy(), int((n * many).sum()))
    k = many.sum() / max(float((many * np.maximum(n, 1) * np.exp(-lam * best)).sum()), 1e-9)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(x) for x in lexicons.value]
        for pdf in batches:
            yield pd.DataFrame([(y, *evidence(n, x, lam, k)) for y, n, _, x in found(pdf, scorers)], columns=["y", "strongest", "total"])

    got = sample.mapInPandas(weigh, "y int, strongest double, total double").orderBy("y", "strongest", "total").toPandas()
    x = np.column_stack([np.ones(len(got)), got["strongest"], got["total"]])
    return Model(lexicon, lam, k, logistic(x, got["y"].to_numpy(dtype=float)))


def score(spark: SparkSession, docs: DataFrame, model: Model, key="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, score, passages (start and end word, end exclusive, and E of every significant one)."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        scorer = Scorer(m.lexicon)
        for pdf in batches:
            scores, passages = [], []
            for t in pdf["text"]:
                words = words_of(t)
                at, s = scorer(words)
                found = segments(at, s)
                scores.append(m.probability(*m.evidence(len(words), [x for _, _, x in found])))
                e = [(a, b, float(m.k * len(words) * np.exp(-m.lam * x))) for a, b, x in found]
                passages.append([{"start": a, "end": b, "e_value": v} for a, b, v in e if v < 1])
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "score": scores, "passages": passages})

    workers_ready(spark)
    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).cast("string").alias("id"), text_or_empty(text).alias("text"))
                .mapInPandas(run, "id string, score double, passages array<struct<start:int,end:int,e_value:double>>")
                .select(F.col("id").cast(kind).alias("doc_id"), "score", "passages"))


def toxicity_report(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, passages."""
    out = score(spark, docs, fit(spark, docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "passages")
