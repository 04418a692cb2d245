"""Language and toxicity models: held-out accuracy, brute-force inference, awkward rows."""

import itertools
import os
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sylvan.llm import langid, toxicity

import fixture

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    e, start, moves = rng.random((5, 2, 3)) + .1, rng.random(3) + .1, rng.random((3, 3)) + .1
    alpha, beta = langid._forward_backward(e, start, moves, np.array([2, 2, 2, 1, 1]))
    post = alpha * beta
    for chain, length in ((0, 5), (1, 3)):
        want = np.zeros((length, 3))
        for path in itertools.product(range(3), repeat=length):
            p = start[path[0]] * np.prod([e[t, chain, path[t]] for t in range(length)]) * np.prod([moves[a, b] for a, b in zip(path, path[1:])])
            for t, y in enumerate(path):
                want[t, y] += p
        got = post[:length, chain] / post[:length, chain].sum(axis=1, keepdims=True)
        assert np.allclose(got, want / want.sum(axis=1, keepdims=True))


def test_gradient_steps_raise_accuracy_on_switched_text():
    en, fr = "the of and to in is that".split(), "le de un et il ne je".split()
    rng = np.random.default_rng(1)
    runs = [([str(rng.choice(v)) for _ in range(40)], y) for y, v in enumerate((en, fr)) for _ in range(20)]
    crf = langid.train(runs, ["en", "fr"])
    shares = langid.Labeller(crf).shares([en * 3, fr * 3, en + fr, [], ["the"]])
    assert shares[0, 0] > .9 and shares[1, 1] > .9 and .3 < shares[2, 0] < .7 and not shares[3].any()
    assert crf.moves[0, 0] > crf.moves[0, 1] and crf.moves[1, 1] > crf.moves[1, 0]


def test_languages_held_out(spark):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    out = langid.predictions(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= .97 * len(held) and all(0 <= r.score <= 1 for r in out)


def test_language_of_awkward_rows(spark):
    docs = fixture.frame(spark)
    out = langid.predictions(spark, docs)
    assert out.count() == docs.count()
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (60, 61, 62, 65))
    assert all(got[i].lang_pred in ("en", "fr") for i in (63, 67, 68))
    stay = langid.accepted(spark, docs)
    assert stay.columns == docs.columns and {60, 61, 62, 65}.isdisjoint({r.doc_id for r in stay.collect()})
    assert stay.count() == docs.count() - 4
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predictions(spark, blank).collect()} == {"und"}
    assert langid.accepted(spark, blank).count() == 0
    none = fixture.empty(spark)
    assert langid.predictions(spark, none).count() == 0 and langid.accepted(spark, none).count() == 0


def all_segments(x):
    """The definition: segments whose every proper prefix and suffix sums above zero, maximal by inclusion, by recursion on the best one."""
    def best(lo, hi):
        top = max(((sum(x[a:b]), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), key=lambda s: (s[0], -(s[2] - s[1]), -s[1]), default=(0, 0, 0))
        return [] if top[0] <= 0 else best(lo, top[1]) + [top[1:]] + best(top[2], hi)
    return best(0, len(x))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([-1.0, -1.0, -1.0, 1.25, 2.5, 0.625, 3.1875]), max_size=14))
def test_segments_are_all_maximal_ones(x):
    at = np.array([i for i, v in enumerate(x) if v > 0], dtype=int)
    got = toxicity.segments(at, np.array([x[i] for i in at]), cost=1.0)
    assert [round(sum(x[a:b]), 9) for a, b in all_segments(x)] == [round(s, 9) for _, _, s in got]
    assert all(round(sum(x[a:b]), 9) == round(s, 9) for a, b, s in got)


def test_log_odds_prior_shrinks():
    odds, err = toxicity.log_odds(np.array([1.0, 30.0]), np.array([1.0, 30.0]), 100, 1000)
    assert odds[1] / err[1] > odds[0] / err[0] and 0 < odds[0]


def sample_rows():
    """Clean prose, and toxic documents that hold a word of a planted stem."""
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("ba", "ko", "li", "mu", "re", "to") for b in ("nda", "resi", "vok", "pil", "sam", "tu", "wen", "xor")]
    docs, labels = [], []
    for i in range(600):
        w = [str(x) for x in rng.choice(words, 80)]
        bad = i % 6 == 0
        if bad:
            w.insert(int(rng.integers(80)), f"zgrob{rng.choice(list('aeiou'))}{rng.choice(list('lmnr'))}")
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = sample_rows()
    extra = [(None, None), (1000, None), (1001, ""), (1002, "zgrobul " * 3), (1003, "ko " * 30000 + "zgrobim"), (0, docs[0][1])]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("toxic", F.lit("y"))
    lb = spark.createDataFrame([(*r, 0) for r in labels] + [(3, None, 0), (None, 1, 0), (0, 0, 0)], "doc_id long, toxic int, quality int")
    out = toxicity.toxicity_report(spark, d, lb).collect()
    assert len(out) == len(docs) + len(extra)
    truth = dict(labels)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= .3)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= .97 * len(held)
    got = {r.doc_id: r for r in out}
    assert got[1002].predicted == 1 and got[1000].predicted == got[1001].predicted == 0
    assert len(got[1002].passages) == 1 and (got[1002].passages[0].start, got[1002].passages[0].end) == (0, 3)


def test_toxicity_fit_brings_counts_not_lists(spark, monkeypatch):
    """One long clean text full of evidence adds no rows to what the driver gets; partitions change nothing."""
    docs, labels = sample_rows()
    docs[7] = (7, "ko zgrobul " * 40000)
    d, lb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got, frames = [], []
    whole = type(d).toPandas
    monkeypatch.setattr(type(d), "toPandas", lambda self: frames.append(whole(self)) or frames[-1])
    for n in (2, 7):
        got.append(toxicity.fit(spark, d.repartition(n), lb))
    assert got[0].lexicon == got[1].lexicon
    assert (got[0].lam, got[0].k) == (got[1].lam, got[1].k) and np.array_equal(got[0].weights, got[1].weights)
    assert all(len(f) <= len(docs) + 2 * len(got[0].lexicon) + 2000 for f in frames)
    assert not any(isinstance(v, (list, np.ndarray)) for f in frames for c in f for v in f[c].head(3))


def test_lambda_counts_equal_scores_together():
    s = np.array([.5, .5, .5, 2.0, 2.0, 3.1])
    v, n = np.unique(s, return_counts=True)
    assert toxicity.solve_lambda(v, n, 4000) == pytest.approx(toxicity.solve_lambda(s, np.ones(6), 4000), rel=1e-12)
    assert toxicity.solve_lambda(np.array([]), np.array([]), 100) > 0


def test_scorer_forgets_within_a_text(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 50)
    scorer = toxicity.Scorer({"w7": 1.5, "x" * 900: 2.0})
    words = [f"w{i}" for i in range(500)] + ["x" * 900, "w7"]
    at, s = scorer(words)
    assert at.tolist() == [7, 500, 501] and s.tolist() == [1.5, 2.0, 1.5]
    assert len(scorer) <= 50 and max(map(len, scorer)) <= toxicity.LONGEST


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)]])
def test_toxicity_without_both_kinds(spark, labels):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = toxicity.toxicity_report(spark, d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == 2 and {round(r.score, 6) for r in out} == {float(labels[0][1]) if labels else 0.0}
    none = toxicity.toxicity_report(spark, d.where("false"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert none.count() == 0


# --- language identification: letters, short texts, few pieces -------------------

def test_number_letters_are_no_letters(spark):
    assert langid.words_of("½ ² ③ Ⅷ x²y 3") == ["x", "y"]
    assert langid.words_of("Straße été 日本") == ["straße", "été", "日本"]
    data = [(i, "the cat sat on the mat " * 3, "en") for i in range(40)] + [(100, "½ ² ③", "en"), (101, "x²", "en")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predictions(spark, docs).collect()}
    assert got[100] == ("und", 0.0) and got[101][0] == "en"


def test_a_language_of_short_texts_is_learned(spark):
    data = [(i, "the cat sat on the mat and saw a dog by the door of a house", "en") for i in range(60)]
    data += [(100 + i, "le chat de un ami", "fr") for i in range(60)]  # no text reaches one piece
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = langid.predictions(spark, docs).where("held_out").collect()
    assert out and all(r.lang_pred == ("en" if r.doc_id < 100 else "fr") for r in out)


def test_pieces_keep_every_word():
    pieces = langid.pieces_of([(["a"] * 15, 0), (["b"] * 3, 1), (["c"] * 4, 1), ([], 0)])
    assert len(pieces) >= langid.SPANS and all(len(w) == langid.SPAN for w, _ in pieces)
    assert {y for _, y in pieces} == {0, 1} and {w for ws, y in pieces for w in ws if y == 1} == {"b", "c"}
    crf = langid.train([(["le", "de"], 0), (["the", "of"], 1)], ["fr", "en"])
    assert np.abs(crf.weights).max() > 0


def test_the_sample_is_the_same_in_every_run(spark):
    data = [(i, f"word{i} the cat number {i}", "en") for i in range(300)] + [(1000 + i, f"mot{i} le chat {i}", "fr") for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    a, b = (langid.fit(spark, docs.repartition(n), docs_bound=20) for n in (2, 7))
    assert a.lexicon == b.lexicon and np.array_equal(a.weights, b.weights)
