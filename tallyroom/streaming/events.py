"""Streams of job events: the newest state of each job, kept up by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.operators.jobs import current
from tallyroom.tables import new_path, shared_dir


def folded(spark: SparkSession, source: str, schema, key: str, *order: str, root: str | None = None) -> DataFrame:
    """Reads the Parquet files under source as a stream, all that is there, and folds them into the state of each key.

    The state is a stateful aggregate in the engine's own store, so a restart goes on where the checkpoint ends, also
    when there is nothing new. Each micro-batch writes the keys that it has changed, under its number; a batch that is
    run again replaces its own. The newest batch of a key has its state.
    """
    root = root or f"{shared_dir(spark)}/{new_path(spark, 'stream').rpartition('/')[2]}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    state = current(stream, key, *order)
    step = lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/state/batch={number}")
    query = state.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/state")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], state.schema)
    changes = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in state.schema)}, batch long").parquet(f"{root}/state")
    rest = [c for c in state.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(key, "s.*")


def assembled(deltas: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """The text of each message from its parts in order."""
    return deltas.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda x: x[text]), "").alias("message"))
