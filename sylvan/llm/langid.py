"""Language identification with a linear-chain conditional random field.

The labels of the chain are the languages; one label per word. A word's
features are its affixes, character n-grams, and the lexicon's word for it
(languages of frequent words), hashed into one weight table; transitions
between neighbouring words' labels have weights of their own. All weights are
learned by gradient steps on the conditional likelihood, computed by
forward-backward. Training sequences join runs of words from documents of
several languages, so the transitions learn how often and between which
languages a text switches.

Prediction runs forward-backward over all words of a text, whole, many texts
side by side; a text's language is the one with most posterior over its words,
its score that share.

The model is fitted on a bounded sample: at most about ``DOCS`` labelled
documents (chosen by hash), ``RUN_WORDS`` consecutive words of each.

Defined results: ``und`` with score 0 for null text or text without a letter
(also when nothing could be learned); words without a letter are passed over;
ties go to the language first in code point order; rows may repeat; a null id
hashes as the empty text; an empty table gives no rows; lang, source and id are
never inputs of a prediction. A text is held whole by one task.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sylvan.llm.common import held, id_crc32, release, text_or_empty, workers_ready

#: Bounds of the sample: documents, words of each.
DOCS, RUN_WORDS = 3000, 120
#: Training: words of a same-language run, runs of a sequence, passes, step.
SPAN, SPANS, EPOCHS, STEP = 12, 4, 8, 0.5
BUCKETS = 1 << 16
LEXICON_LEAST = 5
#: Bytes that the words a worker remembers take, about.
REMEMBERED = 48 << 20
#: Words of the padded batches in which texts are labelled side by side.
BATCH_WORDS = 400_000
#: Texts whose words a worker holds at once.
TEXTS = 1000
_WORDS = re.compile(r"[^\W\d_]+").findall
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case. The pattern takes number letters (a half, a raised two) too; they part words here."""
    found = _WORDS(text.lower()) if text else []
    if not found or text.isascii():
        return found
    out = []
    for w in found:
        if w.isalpha():
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed features of a lower-case word: affixes, bigrams and trigrams of its bytes, the lexicon's word.

    The second argument of crc32 keeps the kinds of feature apart.
    """
    b = word.encode()
    edged = b"^" + b + b"$"
    n = len(b)
    out = [crc32(b[:k], 1) for k in (1, 2, 3)] + [crc32(b[-k:], 2) for k in (1, 2, 3)]
    out += [crc32(edged[i:i + 3], 3) for i in range(n)]
    out += [crc32(b[i:i + 2], 4) for i in range(n - 1)]
    if word in lexicon:
        out += [crc32(b, 5), crc32(b"%d" % lexicon[word], 6)]
    return [x % BUCKETS for x in out]


class Crf:
    """labels, hashed emission weights (BUCKETS x L), start and transition weights, lexicon."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.weights = np.zeros((BUCKETS, n), dtype=np.float32)
        self.start = np.zeros(n, dtype=np.float64)
        self.moves = np.zeros((n, n), dtype=np.float64)
        self.lexicon: dict[str, int] = {}

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, L) emission scores."""
        lists = [features(w, self.lexicon) for w in words]
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        flat = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(sizes.sum()))
        return np.add.reduceat(self.weights[flat], at, axis=0) / np.sqrt(sizes)[:, None]


def _forward_backward(e: np.ndarray, start: np.ndarray, moves: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """e (T, B, L): positive emission factors; active[t]: the first so many of the B chains have a word t.

    Returns scaled alphas and betas whose normalised product is the posterior.
    """
    t_max = len(e)
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    a = e[0] * start
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, t_max):
        k = active[t]
        a = (alpha[t - 1, :k] @ moves) * e[t, :k]
        alpha[t, :k] = a / a.sum(axis=1, keepdims=True)
    back = np.ascontiguousarray(moves.T)
    for t in range(t_max - 2, -1, -1):
        k = active[t + 1]
        b = (beta[t + 1, :k] * e[t + 1, :k]) @ back
        beta[t, :k] = b / b.sum(axis=1, keepdims=True)
    return alpha, beta


def _factors(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(scores - scores.max(axis=-1, keepdims=True), -30, 0))


def learn_lexicon(runs: list[tuple[list[str], int]]) -> dict[str, int]:
    """Frequent words of the sample that one language has nine times in ten."""
    seen: dict[str, Counter] = defaultdict(Counter)
    for words, y in runs:
        for w in words:
            seen[w][y] += 1
    return {w: c.most_common(1)[0][0] for w, c in seen.items()
            if sum(c.values()) >= LEXICON_LEAST and 10 * max(c.values()) >= 9 * sum(c.values())}


def pieces_of(runs: list[tuple[list[str], int]]) -> list[tuple[list[str], int]]:
    """Runs cut into pieces of ``SPAN`` words; what is left of short runs is joined by language, its last piece
    filled up by repeating itself. At least as many pieces as a sequence has."""
    pieces, rest = [], defaultdict(list)
    for w, y in runs:
        whole = len(w) // SPAN * SPAN
        pieces += [(w[i:i + SPAN], y) for i in range(0, whole, SPAN)]
        rest[y] += w[whole:]
    for y, w in sorted(rest.items()):
        for i in range(0, len(w), SPAN):
            part = w[i:i + SPAN]
            pieces.append(((part * SPAN)[:SPAN], y))
    return pieces * -(-SPANS // len(pieces)) if 0 < len(pieces) < SPANS else pieces


def train(runs: list[tuple[list[str], int]], labels: list[str], seed: int = 7) -> Crf:
    """Fit the chain on runs of words with their language number, by AdaGrad on the log likelihood."""
    crf = Crf(labels)
    crf.lexicon = learn_lexicon(runs)
    rng = np.random.default_rng(seed)
    pieces = pieces_of(runs)
    table: dict[str, np.ndarray] = {w: np.array(features(w, crf.lexicon)) for ws, _ in pieces for w in ws}
    length, n_labels = SPAN * SPANS, len(labels)
    square_w = np.full((BUCKETS, n_labels), 1e-6, dtype=np.float32)
    square_m, square_s = np.full_like(crf.moves, 1e-6), np.full_like(crf.start, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(pieces))
        for lo in range(0, len(order) - SPANS + 1, SPANS * 64):
            chosen = order[lo:lo + SPANS * 64]
            chosen = chosen[:len(chosen) // SPANS * SPANS].reshape(-1, SPANS)
            if not len(chosen):
                continue
            words = [[w for k in row for w in pieces[k][0]] for row in chosen]
            y = np.array([[pieces[k][1] for k in row for _ in range(SPAN)] for row in chosen]).T
            flat = [table[w] for row in zip(*words) for w in row]
            sizes = np.array([len(f) for f in flat])
            idx, scale = np.concatenate(flat), np.repeat(1 / np.sqrt(sizes), sizes).astype(np.float32)
            at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            scores = np.add.reduceat(crf.weights[idx] * scale[:, None], at, axis=0).reshape(length, -1, n_labels)
            e, b = _factors(scores.astype(np.float64)), len(chosen)
            moves = np.exp(crf.moves)
            alpha, beta = _forward_backward(e, np.exp(crf.start), moves, np.full(length, b))
            post = alpha * beta
            post /= post.sum(axis=2, keepdims=True)
            truth = np.eye(n_labels)[y]
            pair = np.einsum("tbi,ij,tbj->tbij", alpha[:-1], moves, e[1:] * beta[1:])
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            g_moves = (np.einsum("tbi,tbj->ij", truth[:-1], truth[1:]) - pair.sum(axis=(0, 1))) / b
            g_start = (truth[0] - post[0]).sum(axis=0) / b
            g_words = np.repeat((truth - post).reshape(-1, n_labels), sizes, axis=0) * scale[:, None] / b
            g_weights = np.stack([np.bincount(idx, weights=g_words[:, j], minlength=BUCKETS) for j in range(n_labels)], axis=1)
            hit = np.unique(idx)
            g = g_weights[hit] - 1e-4 * crf.weights[hit]
            square_w[hit] += g ** 2
            crf.weights[hit] += (STEP * g / np.sqrt(square_w[hit])).astype(np.float32)
            square_m += g_moves ** 2
            square_s += g_start ** 2
            crf.moves += STEP / 2 * g_moves / np.sqrt(square_m)
            crf.start += STEP / 2 * g_start / np.sqrt(square_s)
    return crf


class _Numbers(dict):
    """word -> its row among the emission factors; new words wait in ``pending``."""

    def __init__(self):
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.pending.append(word)
        return k


class Labeller:
    """Language shares of texts under a chain; remembers words' factors in bounded space."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.start, self.moves = np.exp(crf.start).astype(np.float32), np.exp(crf.moves).astype(np.float32)
        self.reset()

    def reset(self) -> None:
        self.number, self.used = _Numbers(), 0
        self.rows = np.empty((0, len(self.crf.labels)), dtype=np.float32)

    def factors(self) -> np.ndarray:
        """The factors of every word numbered so far."""
        # a word, its number, its place in the table and its factors
        self.used += sum(map(len, self.number.pending)) + len(self.number.pending) * (200 + 4 * len(self.crf.labels))
        for lo in range(0, len(self.number.pending), 20_000):
            more = _factors(self.crf.emissions(self.number.pending[lo:lo + 20_000])).astype(np.float32)
            self.rows = np.concatenate([self.rows, more])
        self.number.pending.clear()
        return self.rows

    def shares(self, texts: list[list[str]]) -> np.ndarray:
        """(texts, L): mean posterior over the words of each text; zeros for no words."""
        out = np.zeros((len(texts), len(self.crf.labels)))
        order = sorted((i for i, w in enumerate(texts) if w), key=lambda i: -len(texts[i]))
        lo = 0
        while lo < len(order):
            longest = len(texts[order[lo]])
            group = order[lo:lo + max(1, min(512, BATCH_WORDS // longest))]
            lo += len(group)
            if self.used > REMEMBERED:
                self.reset()
            ids = np.zeros((longest, len(group)), dtype=np.int32)
            for j, i in enumerate(group):
                ids[:len(texts[i]), j] = np.fromiter(map(self.number.__getitem__, texts[i]), dtype=np.int32, count=len(texts[i]))
            lens = np.array([len(texts[i]) for i in group])
            active = np.searchsorted(-lens, -np.arange(longest), side="left")
            alpha, beta = _forward_backward(self.factors()[ids], self.start, self.moves, active)
            alpha *= beta
            alpha[np.arange(longest)[:, None] >= lens[None, :]] = 0
            sums = alpha.sum(axis=2, keepdims=True)
            np.divide(alpha, sums, out=alpha, where=sums > 0)
            out[group] = alpha.sum(axis=0) / lens[:, None]
        return out


def held_out(key: str = "doc_id") -> Column:
    return id_crc32(key) % 5 == 0


def fit(spark: SparkSession, docs: DataFrame, key="doc_id", text="text", lang="lang", docs_bound: int = DOCS) -> Crf | None:
    """Learn from rows with a language that are not held out; None if there are none with words."""
    rows = docs.where(F.col(lang).isNotNull() & ~held_out(key)).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).alias("id"))
    counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    labels = sorted(counts)
    if not labels:
        return None
    each = max(1, docs_bound // len(labels))
    want = F.create_map(*[F.lit(x) for k in labels for x in (k, max(1, counts[k] // each))])
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.element_at(want, F.col("lang"))) == 0)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()  # what an earlier operator's tasks remembered
        for pdf in batches:
            out = []
            for t, y in zip(pdf["text"], pdf["lang"]):
                w = words_of(t)
                lo = crc32((t or "").encode()) % (len(w) - RUN_WORDS) if len(w) > RUN_WORDS else 0
                out.append((" ".join(w[lo:lo + RUN_WORDS]), y))
            yield pd.DataFrame(out, columns=["words", "lang"])

    workers_ready(spark)
    # ordered by a hash, so that the bound takes the same rows in every run
    got = (sample.mapInPandas(runs, "words string, lang string").where("words != ''").distinct()
                 .orderBy(F.xxhash64("words", "lang"), "words", "lang").limit(2 * docs_bound).collect())
    seq = sorted((r.lang, r.words) for r in got)
    return train([(w.split(" "), labels.index(y)) for y, w in seq], labels) if seq else None


def predict(spark: SparkSession, docs: DataFrame, crf: Crf | None, key="doc_id", text="text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    mark = uuid.uuid4().hex
    model = spark.sparkContext.broadcast(crf)  # BUCKETS x languages weights and the sample's lexicon
    undecided = UNKNOWN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = model.value
        for pdf in batches:
            for lo in range(0, len(pdf), TEXTS):
                p = pdf.iloc[lo:lo + TEXTS]
                texts = [words_of(t) for t in p["text"]]
                if crf is None:
                    pred, score = [undecided] * len(p), [0.0] * len(p)
                else:
                    shares = held(mark, lambda: Labeller(crf)).shares(texts)
                    best = shares.argmax(axis=1)
                    pred = [crf.labels[k] if w else undecided for k, w in zip(best, texts)]
                    score = np.clip(shares.max(axis=1), 0.0, 1.0)
                yield pd.DataFrame({"id": p["id"].to_numpy(), "lang_pred": pred, "score": score})

    workers_ready(spark)
    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).cast("string").alias("id"), text_or_empty(text).alias("text"))
                .mapInPandas(run, "id string, lang_pred string, score double")
                .select(F.col("id").cast(kind).alias("doc_id"), "lang_pred", "score"))


def predictions(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return predict(spark, docs, fit(spark, docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(spark: SparkSession, docs: DataFrame, key="doc_id", text="text", lang="lang", least: float = 0.3) -> DataFrame:
    """Documents in a recognised language, columns unchanged.

    Rejected: texts without a letter, and texts in which no language has
    ``least`` of the posterior.
    """
    crf = fit(spark, docs, key, text, lang)
    if crf is None:
        return docs.where(F.lit(False))
    mark, model = uuid.uuid4().hex, spark.sparkContext.broadcast(crf)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # only the texts of one slice become Python objects
            for lo in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(lo, TEXTS)
                shares = held(mark, lambda: Labeller(model.value)).shares([words_of(t) for t in batch.column(batch.num_columns - 1).to_pylist()])
                yield batch.filter(pa.array(shares.max(axis=1) >= least)).select(list(range(batch.num_columns - 1)))

    workers_ready(spark)
    # columns go by place under names of their own: a table may hold one name twice in different cases
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    given = plain.withColumn("text", F.col(names[docs.columns.index(text)]).cast("string"))
    return given.mapInArrow(keep, plain.schema).toDF(*docs.columns)
