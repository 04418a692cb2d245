"""Run-log queries.

The profiler's logs are derived from ``events`` by Spark: a sweep of 97
runs (run = user_id % 97), each event one resource sample line and one
timing line of its run, written as text under a folder per run in
(ts, event_id) order.  The number of log files stays fixed while the logs
grow with the data, as a profiler's sampling logs do.  The parsing plans then read
them back like the profiler's files, and the SQL twins compute the same
answers straight from ``events``.

Sample line (14 tokens with the process gauge, 13 without):
  [0] Tesla T4 | 34'C, <busy> % | <used> / 15109 MB | user:python/<pid>(<proc>M)
busy = 0 on 'error' events (idle), else int(value) % 100 + 1;
used = int(value * 10); proc = event_id % 1000, absent on 'signup' events.
Timing line per event type (first keyword wins: dataframe, predict, write, load):
  view -> "Time taken to read dataframe is <value>"
  purchase -> "Time taken to predict and write is <value>"
  signup -> "Time taken to write results is <value>"
  click -> "Time taken to load model is <value>"
  error -> "retry after error <value>"
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvan.operators import runlogs as R
from sylvan.plans.registry import query
from sylvan.session import scratch_path, shared_dir
from sylvan.sources.files import LINE_ORDER
from sylvan.sources.runlogs import resource_samples, stage_lines
from sylvan.sources.tables import table

# Number of derived runs and the names that label them.
N_RUNS = 97
DATASETS = ["events", "orders", "lineitem", "customer", "part", "embeddings", "labels"]
ALGOS = ["randomforest", "gbt", "grid"]
FRAMEWORKS = ["vectorised", "relational", "expression", "mllib"]
TREES = [10, 500, 1600]


def _pick(values, idx):
    return F.get(F.array(*[F.lit(v) for v in values]), idx)


def run_name_col(kind: str):
    u = F.col("user_id") % N_RUNS
    b = (F.lit(100) + u).cast("string")
    return F.concat(F.lit("run_scoring.py_-d_"), _pick(DATASETS, (u % 7).cast("int")),
                    F.lit("_-m_"), _pick(ALGOS, (u % 3).cast("int")),
                    F.lit("_-f_"), _pick(FRAMEWORKS, (u % 4).cast("int")),
                    F.lit("_-t_"), _pick([str(t) for t in TREES], (u % 3).cast("int")),
                    F.lit("_--batch_size_"), b, F.lit("_--query_size_"), b, F.lit(f"_{kind}_LOG.txt"))


def _write_logs(spark, sf_dir, kind: str, line) -> str:
    """Write one text log per run, lines in time order.  Rows are range
    partitioned on (run, ts, event_id), so a long run spans several files whose names
    follow the range order."""
    path = scratch_path(spark, f"logs_{kind}")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ev = table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    (ev.select(run_name_col(kind).alias("run"), F.col("ts"), F.col("event_id"), line.alias("line"))
     .repartitionByRange(n, "run", "ts", "event_id").sortWithinPartitions("run", "ts", "event_id")
     .select("line", "run").write.partitionBy("run").text(path))
    return path


def sample_line():
    busy = F.when(F.col("event_type") == "error", F.lit(0)).otherwise(
        (F.col("value").cast("int") % 100) + 1)
    used = (F.col("value") * 10).cast("int")
    head = F.format_string("[0] Tesla T4 | 34'C, %d %% | %d / 15109 MB |", busy, used)
    proc = F.format_string(" user:python/4242(%dM)", (F.col("event_id") % 1000).cast("int"))
    return F.when(F.col("event_type") == "signup", head).otherwise(F.concat(head, proc))


def timing_line():
    v = F.col("value").cast("string")
    t = F.col("event_type")
    return (F.when(t == "view", F.concat(F.lit("Time taken to read dataframe is "), v))
            .when(t == "purchase", F.concat(F.lit("Time taken to predict and write is "), v))
            .when(t == "signup", F.concat(F.lit("Time taken to write results is "), v))
            .when(t == "click", F.concat(F.lit("Time taken to load model is "), v))
            .otherwise(F.concat(F.lit("retry after error "), v)))


def write_resource_logs(spark, sf_dir) -> str:
    shared_dir(spark)
    return _write_logs(spark, sf_dir, "GPU", sample_line())


def write_timing_logs(spark, sf_dir) -> str:
    shared_dir(spark)
    return _write_logs(spark, sf_dir, "OUT", timing_line())


# --- SQL twins ----------------------------------------------------------------

def _sql_pick(values, idx: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{idx} + 1]"


_SQL_RUN_ATTRS = (
    f"{_sql_pick(DATASETS, 'r % 7')} AS dataset, {_sql_pick(ALGOS, 'r % 3')} AS algo, "
    f"{_sql_pick(FRAMEWORKS, 'r % 4')} AS framework, "
    f"CAST({_sql_pick([str(t) for t in TREES], 'r % 3')} AS INTEGER) AS trees, "
    "CAST(100 + r AS INTEGER) AS batch_size")

# events with their run and line number inside the run's log
_SQL_RUN_EVENTS = (
    f"SELECT *, user_id % {N_RUNS} AS r, "
    f"row_number() OVER (PARTITION BY user_id % {N_RUNS} ORDER BY ts, event_id) AS line_no FROM events")

_SQL_SAMPLES = (
    f"SELECT r, line_no, {_SQL_RUN_ATTRS}, "
    "CAST(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(trunc(value) AS INTEGER) % 100 + 1 END AS INTEGER) AS gpu, "
    "CAST(trunc(value * 10) AS INTEGER) AS mem, 15109 AS max_mem, "
    "CAST(CASE WHEN event_type = 'signup' THEN 0 ELSE event_id % 1000 END AS INTEGER) AS pyt "
    f"FROM ({_SQL_RUN_EVENTS}) re")


@query("runlog_samples",
       f"SELECT dataset, algo, framework, trees, batch_size, gpu, mem, max_mem, pyt FROM ({_SQL_SAMPLES})")
def runlog_samples(spark, sf_dir):
    s = resource_samples(spark, write_resource_logs(spark, sf_dir))
    return s.select("dataset", "algo", "framework", "trees", "batch_size", "gpu", "mem", "max_mem", "pyt")


@query("runlog_max",
       f"WITH s AS ({_SQL_SAMPLES}), f AS (SELECT r, min(line_no) FILTER (WHERE gpu = 0) AS l0 FROM s GROUP BY r) "
       "SELECT dataset, algo, framework, trees, batch_size, "
       "CAST(coalesce(max(gpu) FILTER (WHERE s.line_no >= f.l0), -1) AS INTEGER) AS max_gpu, "
       "CAST(coalesce(max(mem) FILTER (WHERE s.line_no >= f.l0), -1) AS INTEGER) AS max_mem, "
       "CAST(coalesce(max(pyt) FILTER (WHERE s.line_no >= f.l0), -1) AS INTEGER) AS max_pyt "
       "FROM s JOIN f USING (r) GROUP BY dataset, algo, framework, trees, batch_size")
def runlog_max(spark, sf_dir):
    """gauges' maxima from the first idle sample of each run on."""
    # two passes follow: parse the text once
    path = scratch_path(spark, "samples")
    resource_samples(spark, write_resource_logs(spark, sf_dir)).drop("file_path").write.parquet(path)
    s = spark.read.parquet(path)
    out = R.running_flag_max(s, ["run", "dataset", "algo", "framework", "trees", "batch_size"],
                             LINE_ORDER, F.col("gpu") == 0, ["gpu", "mem", "pyt"])
    return out.select("dataset", "algo", "framework", "trees", "batch_size",
                      F.col("max_gpu"), F.col("max_mem"), F.col("max_pyt"))


_SQL_STAGES = (
    f"SELECT {_SQL_RUN_ATTRS}, "
    "coalesce(arg_max(value, line_no) FILTER (WHERE event_type = 'view'), -1.0) AS read, "
    "coalesce(arg_max(value, line_no) FILTER (WHERE event_type = 'purchase'), -1.0) AS infer, "
    "coalesce(arg_max(value, line_no) FILTER (WHERE event_type = 'signup'), -1.0) AS write, "
    "coalesce(arg_max(value, line_no) FILTER (WHERE event_type = 'click'), -1.0) AS load "
    f"FROM ({_SQL_RUN_EVENTS}) re GROUP BY r")


@query("runlog_stage_times",
       f"SELECT *, read + write + infer AS total FROM ({_SQL_STAGES})")
def runlog_stage_times(spark, sf_dir):
    """Last value per stage and run, -1 when absent; total."""
    lines = stage_lines(spark, write_timing_logs(spark, sf_dir))
    g = ["run", "dataset", "algo", "framework", "trees", "batch_size"]
    last = R.last_value(lines, g + ["stage"], LINE_ORDER, "value", "value")
    wide = R.stage_table(last, g, "stage", "value", ["read", "infer", "write", "load"])
    return wide.drop("run")


@query("stage_totals",
       f"SELECT dataset, algo, framework, trees, batch_size, read + write + infer AS total FROM ({_SQL_STAGES})")
def stage_totals(spark, sf_dir):
    """Derived total = read + write + infer per run."""
    return runlog_stage_times(spark, sf_dir).select("dataset", "algo", "framework", "trees", "batch_size",
                                                    "total")


def _profile_sql() -> str:
    from sylvan.plans.registry import REGISTRY
    mx, st = REGISTRY["runlog_max"][1], REGISTRY["runlog_stage_times"][1]
    return (f"SELECT m.dataset, m.algo, m.framework, m.trees, m.batch_size, m.max_gpu, m.max_mem, m.max_pyt, "
            f"s.load, s.read, s.write, s.infer, s.total FROM ({mx}) m JOIN ({st}) s "
            f"USING (dataset, algo, framework, trees, batch_size)")


@query("run_profile", _profile_sql())
def run_profile(spark, sf_dir):
    """K10 wide profile table: per run the gauges' maxima next to the stage
    times and their total (one row per run)."""
    keys = ["dataset", "algo", "framework", "trees", "batch_size"]
    return runlog_max(spark, sf_dir).join(runlog_stage_times(spark, sf_dir), keys).select(
        *keys, "max_gpu", "max_mem", "max_pyt", "load", "read", "write", "infer", "total")


# --- the same operators straight on events -------------------------------------

@query("running_flag_max",
       "WITH f AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'error') AS t0 FROM events GROUP BY user_id) "
       "SELECT e.user_id, coalesce(max(e.value) FILTER (WHERE e.ts >= f.t0), -1.0) AS max_value "
       "FROM events e JOIN f USING (user_id) GROUP BY e.user_id")
def running_flag_max(spark, sf_dir):
    ev = table(spark, sf_dir, "events", ["user_id", "ts", "event_type", "value"])
    return R.running_flag_max(ev, "user_id", "ts", F.col("event_type") == "error", ["value"]) \
        .withColumnRenamed("max_value", "max_value")


@query("series_per_group",
       "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value FROM events")
def series_per_group(spark, sf_dir):
    """Each user's values as an ordered series (user_id, pos, value)."""
    ev = table(spark, sf_dir, "events", ["user_id", "ts", "event_id", "value"])
    return R.position_in_group(ev, "user_id", ["ts", "event_id"]).select("user_id", "pos", "value")
