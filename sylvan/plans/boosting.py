"""Boosting queries: trees against a brute-force search in SQL, and what training must achieve."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.operators import score as S
from sylvan.operators.boost import BoostParams, boost, boost_sparse
from sylvan.operators.train import save_model, train_forest
from sylvan.plans.features import EVENT_FEATURES, event_features, sql_event_features
from sylvan.plans.registry import query
from sylvan.plans.training import SPARSE_WIDTH, _train_test, write_libsvm
from sylvan.session import scratch_path
from sylvan.sources.files import read_libsvm_long
from sylvan.sources.forests import load_forest

# Cut points of the brute-force searches.
_EVENT_CUTS = {"f0": [32.0, 64.0, 96.0, 128.0, 256.0], "f1": [3.0, 7.0, 11.0, 15.0, 19.0], "f3": [2.0, 5.0, 8.0, 11.0]}
_LENGTH_CUTS = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]
_POSITIVE = 2.0
_LEAST = 0.5


def sql_tree(rows: str, cuts: str, value: str, levels: int, positive: float, l2: float, least: float) -> str:
    """Brute force: every cut of every node of one tree on gradients at margin 0, level by level.

    ``rows``: SQL of (k, y, ...); ``value``: the value of feature c.f in a row x;
    ``cuts``: SQL of (f, b, t), the last cut of a feature with t null (present
    against missing).
    """
    def gain(side: str) -> str:
        return f"{side}g * {side}g / ({side}h + {l2!r})"

    parts = [f"x AS ({rows}), cuts AS ({cuts})",
             f"r0 AS (SELECT '' AS path, k, CASE WHEN y <> 0 THEN {positive!r} * -0.5 ELSE 0.5 END AS g, "
             f"CASE WHEN y <> 0 THEN {positive!r} * 0.25 ELSE 0.25 END AS h FROM x)"]
    for i in range(levels):
        goes = "(CASE WHEN v IS NULL OR isnan(v) THEN d WHEN t IS NULL THEN true ELSE v <= t END)"
        parts += [
            f"v{i} AS (SELECT r.path, r.k, r.g, r.h, c.f, c.b, c.t, {value} AS v FROM r{i} r JOIN x USING (k), cuts c)",
            f"c{i} AS (SELECT path, f, b, t, d, sum(g) FILTER (WHERE {goes}) AS lg, sum(h) FILTER (WHERE {goes}) AS lh, sum(g) AS tg, sum(h) AS th, "
            f"count(*) AS tn, sum(g) FILTER (WHERE NOT {goes}) AS rg, sum(h) FILTER (WHERE NOT {goes}) AS rh "
            f"FROM v{i}, (VALUES (false), (true)) s(d) GROUP BY path, f, b, t, d)",
            f"g{i} AS (SELECT *, 0.5 * ({gain('l')} + {gain('r')} - {gain('t')}) AS gain FROM c{i} WHERE lh >= {least!r} AND rh >= {least!r})",
            f"s{i} AS (SELECT * FROM g{i} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY gain DESC, f, b, d) = 1)",
            f"r{i + 1} AS (SELECT path || CASE WHEN {goes} THEN 'L' ELSE 'R' END AS path, v.k, v.g, v.h "
            f"FROM v{i} v JOIN (SELECT path, f, b, d FROM s{i}) s USING (path, f, b))"]
    union = " UNION ALL ".join(f"SELECT path, CAST(f AS INTEGER) AS feature, t AS threshold, d AS default_left, round(gain, 6) AS gain, "
                               f"CAST(tn AS BIGINT) AS n FROM s{i}" for i in range(levels))
    return f"WITH {', '.join(parts)} {union}"


def _splits(report: DataFrame) -> DataFrame:
    top = F.col("threshold") > 1e308
    return report.where("feature is not null").select("path", "feature", F.when(~top, F.col("threshold")).alias("threshold"), "default_left",
                                                      F.round("gain", 6).alias("gain"), "n")


_CUT_ROWS = ", ".join(f"({f}, {b}, CAST({t!r} AS DOUBLE))" for f, c in enumerate(_EVENT_CUTS.values()) for b, t in enumerate(c))
_CUT_ROWS += ", " + ", ".join(f"({f}, {len(c)}, NULL)" for f, c in enumerate(_EVENT_CUTS.values()))
_EVENT_ROWS = (f"SELECT event_id AS k, CAST(event_type = 'purchase' AS DOUBLE) AS y, f0, f1, f3 FROM ({sql_event_features(True, ', e.event_type')})")


@query("boost_splits", sql_tree(_EVENT_ROWS, f"SELECT * FROM (VALUES {_CUT_ROWS}) c(f, b, t)", "[x.f0, x.f1, x.f3][c.f + 1]", 3, _POSITIVE, 0.0, _LEAST))
def boost_splits(spark, sf_dir) -> DataFrame:
    """M3: the splits of one tree, positive rows weighted and a seventh of the values missing, are those of a search of all cuts."""
    x = event_features(spark, sf_dir, missing=True, keep=("event_type",)).withColumn("y", (F.col("event_type") == "purchase").cast("double"))
    p = BoostParams(n_trees=1, max_depth=3, l2=0.0, min_hessian=_LEAST, positive_weight=_POSITIVE, base=0.0)
    return _splits(boost(x, list(_EVENT_CUTS), "y", p, list(_EVENT_CUTS.values())).report)


def _sparse(spark, sf_dir):
    """(entries, labels) of the sparse file of documents; label: an odd document number."""
    long = read_libsvm_long(spark, write_libsvm(spark, sf_dir)).withColumn("label", F.col("label") % 2)
    labels = long.groupBy("row").agg(F.first("label").alias("label"))
    return long.where("feature is not null"), labels


_LENGTHS = ("SELECT doc_id AS k, CAST(doc_id % 2 AS DOUBLE) AS y, list_transform(regexp_extract_all(coalesce(text, ''), "
            f"'[^\\x20\\x09-\\x0D]+'), lambda w: least(length(w), {SPARSE_WIDTH})) AS ls FROM documents")
_LENGTH_ROWS = f"SELECT k, y, map_from_entries(list_transform(list_distinct(ls), lambda j: (j - 1, len(list_filter(ls, lambda z: z = j))))) AS m FROM ({_LENGTHS})"
_SEEN = f"(SELECT DISTINCT unnest(ls) - 1 AS f FROM ({_LENGTHS}))"
_LENGTH_CUT_ROWS = (f"SELECT f, b, t FROM {_SEEN}, (VALUES " + ", ".join(f"({b}, CAST({t!r} AS DOUBLE))" for b, t in enumerate(_LENGTH_CUTS))
                    + f", ({len(_LENGTH_CUTS)}, NULL)) c(b, t)")


@query("boost_sparse_splits", sql_tree(_LENGTH_ROWS, _LENGTH_CUT_ROWS, "CAST(x.m[c.f] AS DOUBLE)", 2, 1.0, 1.0, _LEAST))
def boost_sparse_splits(spark, sf_dir) -> DataFrame:
    """M4: one tree on the sparse file of documents, absent entries missing: the splits and learned branches of a search of all cuts."""
    entries, labels = _sparse(spark, sf_dir)
    cuts = entries.select("feature").distinct().withColumn("cuts", F.array(*map(F.lit, _LENGTH_CUTS)))
    p = BoostParams(n_trees=1, max_depth=2, min_hessian=_LEAST, base=0.0)
    return _splits(boost_sparse(entries, labels, "row", "label", params=p, cuts=cuts).report)


_BOOST_FITS = [("xgboost", "classification", 4, 3), ("lightgbm", "regression", 4, 3)]


@query("boost_learns", " UNION ALL ".join(
    f"SELECT '{a}' AS algorithm, '{t}' AS task, CAST({n} AS BIGINT) AS trees, true AS shape_ok, true AS better_than_constant, true AS loss_falls, "
    "true AS sums_ok, true AS saved_same" for a, t, n, _ in _BOOST_FITS))
def boost_learns(spark, sf_dir) -> DataFrame:
    """M3 by the libraries' names: on rows held out the model beats the best constant and every tree lowers the training loss;
    each split's sums are its children's; the saved model scores the same."""
    train, test = (x.withColumn("z", F.col("f1") * F.col("f3") / 4) for x in _train_test(spark, sf_dir))
    rows = []
    for a, t, n, d in _BOOST_FITS:
        label, feats = ("y" if t == "classification" else "z"), EVENT_FEATURES
        model = train_forest(train, feats, label, a, t, n_trees=n, max_depth=d)
        f, again = model.forest, load_forest(spark, save_model(model, scratch_path(spark, "boosted")))
        s = S.score(f, test, "event_id", feats, carry=[label]).join(
            S.score(again, test, "event_id", feats).select("event_id", F.col("prediction").alias("again")), "event_id")
        if t == "classification":
            right = F.avg((F.col("prediction") == F.col("y")).cast("double"))
            better = right >= F.greatest(F.avg("y"), 1 - F.avg("y"))
        else:
            better = F.avg((F.col("prediction") - F.col(label)) ** 2) <= F.var_pop(label)
        one = F.lit(1).alias("one")  # one row each
        held = s.agg(one, better.alias("better_than_constant"), (F.count_if(~F.col("prediction").eqNullSafe(F.col("again"))) == 0).alias("saved_same"))
        r = model.report
        kids = r.where("path != ''").groupBy("tree_id", F.expr("left(path, length(path) - 1)").alias("path")).agg(F.sum("n").alias("kn"), F.sum("hess").alias("kh"))
        sums = r.where("feature is not null").join(kids, ["tree_id", "path"], "left").agg(
            one, F.coalesce(F.every((F.col("n") == F.col("kn")) & (F.abs(F.col("hess") - F.col("kh")) <= 1e-9 * F.col("hess"))), F.lit(True)).alias("sums_ok"))
        # a tree's gains are what it takes off the loss (to second order, before the step): none is negative
        shape = r.agg(one, F.countDistinct("tree_id").alias("trees"), (F.max(F.length("path")) <= d).alias("shape_ok"),
                      (F.coalesce(F.min("gain"), F.lit(0.0)) >= 0).alias("loss_falls"))
        rows.append(shape.join(held, "one").join(sums, "one").select(
            F.lit(a).alias("algorithm"), F.lit(t).alias("task"), "trees", "shape_ok", "better_than_constant", "loss_falls", "sums_ok", "saved_same"))
    return reduce(DataFrame.unionByName, rows)
