"""Row and chunk callbacks over a stream of files: the same masking plan on every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmask.operators.actions import Policy, transformed


def masked_stream(stream: DataFrame, policies: list[Policy], seed: int = 1) -> DataFrame:
    """A streaming projection: values depend on keys and the seed alone, so batches agree with a whole run."""
    whole = [p.column for p in policies if p.action == "RESAMPLE"]
    if whole:
        raise ValueError(f"RESAMPLE needs a whole table ({', '.join(whole)}): pass it to transformed() in a callback of each_chunk()")
    return transformed(stream, policies, seed=seed)


def each_chunk(spark: SparkSession, path: str, schema, callback: Callable[[DataFrame, int], None], checkpoint: str, files_per_chunk: int = 1, **options):
    """Call back with each chunk of files that has not been seen; stops when there are no more."""
    stream = spark.readStream.schema(schema).options(maxFilesPerTrigger=files_per_chunk, **options).parquet(path)
    return stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
