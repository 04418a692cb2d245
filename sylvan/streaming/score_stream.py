"""F12 stream form: score micro-batches as they arrive.

``readStream`` over a folder of Parquet feature files (``maxFilesPerTrigger``
files per micro-batch) -> stateless forest scoring (vectorised or compiled
plan) -> ``writeStream`` Parquet sink with its checkpoint in the shared
folder.  The relational plan, and any plan over a forest so large that it is
scored in tree groups, adds up sums per row; a stream would hold these as
state, so they run per micro-batch inside ``foreachBatch`` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvan.operators import score as S
from sylvan.operators.forest import Forest


def start_scoring_stream(spark: SparkSession, forest: Forest, source_dir: str, schema,
                         key: str, features, out_dir: str, checkpoint_dir: str,
                         strategy: str = "vectorised", files_per_trigger: int = 1,
                         available_now: bool = True):
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(source_dir))
    writer = None
    if strategy == "relational" or S.in_groups(forest, strategy):
        def each(batch: DataFrame, epoch: int) -> None:
            # a replayed micro-batch replaces its own folder
            S.STRATEGIES[strategy](forest, batch, key, features).write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")
        writer = stream.writeStream.foreachBatch(each)
    else:
        scored = S.STRATEGIES[strategy](forest, stream, key, features)
        writer = scored.writeStream.format("parquet").option("path", out_dir)
    writer = writer.option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def score_stream_to_end(spark: SparkSession, forest: Forest, source_dir: str, schema, key: str,
                        features, out_dir: str, checkpoint_dir: str, strategy: str = "vectorised",
                        files_per_trigger: int = 1) -> DataFrame:
    """Run the stream over everything available, then return the sink."""
    q = start_scoring_stream(spark, forest, source_dir, schema, key, features, out_dir, checkpoint_dir,
                             strategy, files_per_trigger, available_now=True)
    q.awaitTermination()  # raises what ended the stream, if it failed
    return spark.read.parquet(out_dir).drop("epoch")
