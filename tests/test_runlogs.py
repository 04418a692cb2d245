"""Run logs: line order survives files split across tasks."""

from tools.oracle_check import rows_of

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


def test_run_maxima_with_logs_split_into_many_tasks(spark, request):
    from tools.oracle_check import duck
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 * 1024))
    spark.conf.set("spark.sql.files.openCostInBytes", str(256))
    try:
        for name in ("runlog_max", "runlog_stage_times"):
            sdf = E.queries()[name](spark, SF)
            rel = duck(SF).sql(E.oracle_sql()[name])
            assert rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) == rows_of(rel.columns, rel.fetchall())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _write(dirname, name, lines):
    import os
    with open(os.path.join(dirname, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_resource_log_edge_cases(spark, tmp_path):
    """never idle -> -1; idle first -> everything counts; a sample without
    the process token reads as 0 MB."""
    from pyspark.sql import functions as F
    from sylvan.operators.runlogs import running_flag_max
    from sylvan.sources.runlogs import resource_samples
    name = "run_scoring.py_-d_{d}_-m_gbt_-f_vectorised_-t_10_--batch_size_{b}_--query_size_{b}_GPU_LOG.txt"
    head = "[0] Tesla T4 | 34'C, {g} % | {m} / 15109 MB |"
    proc = " user:python/4242({p}M)"
    _write(tmp_path, name.format(d="never", b=100), [
        "header line", head.format(g=30, m=500) + proc.format(p=100), head.format(g=50, m=900) + proc.format(p=300)])
    _write(tmp_path, name.format(d="first", b=200), [
        head.format(g=0, m=10) + proc.format(p=5), head.format(g=70, m=800) + proc.format(p=200),
        head.format(g=20, m=300)])
    _write(tmp_path, name.format(d="later", b=300), [
        head.format(g=90, m=999) + proc.format(p=999), head.format(g=0, m=100),
        head.format(g=40, m=400) + proc.format(p=50)])
    s = resource_samples(spark, str(tmp_path))
    assert s.where(F.col("dataset") == "first").where(F.col("gpu") == 20).first()["pyt"] == 0
    out = {r["dataset"]: (r["max_gpu"], r["max_mem"], r["max_pyt"]) for r in running_flag_max(
        s, ["run", "dataset"], ["line_major", "line_minor"], F.col("gpu") == 0, ["gpu", "mem", "pyt"]).collect()}
    assert out == {"never": (-1, -1, -1), "first": (70, 800, 200), "later": (40, 400, 50)}
    assert {r["batch_size"] for r in s.select("batch_size").distinct().collect()} == {100, 200, 300}


def test_timing_log_first_keyword_wins_and_last_line_counts(spark, tmp_path):
    from sylvan.operators.runlogs import last_value, stage_table
    from sylvan.sources.runlogs import stage_lines
    name = "run_scoring.py_-d_x_-m_gbt_-f_relational_-t_10_--batch_size_7_--query_size_7_OUT_LOG.txt"
    _write(tmp_path, name, [
        "Time to load dataframe and predict 1.5",    # 'dataframe' wins -> read
        "Time to predict and write 2.0",             # 'predict' wins -> infer
        "Time to write results 0.5",
        "Time to predict 3.0",                       # last infer line counts
        "nothing here 9.9"])
    lines = stage_lines(spark, str(tmp_path))
    last = last_value(lines, ["run", "stage"], ["line_major", "line_minor"], "value", "value")
    row = stage_table(last, ["run"], "stage", "value", ["read", "infer", "write", "load"]).first()
    assert (row["read"], row["infer"], row["write"], row["load"]) == (1.5, 3.0, 0.5, -1.0)
    assert row["total"] == 1.5 + 0.5 + 3.0
