"""Streams: new shards into an index, and the token lifecycle as keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators.chunking import spans_of, explode_text
from rookery.sources.index_store import IndexStore


def chunk_shards(texts: DataFrame) -> DataFrame:
    """(shard_file, row, span_idx, char_start, char_end, text_chars) of (shard_file, row, text)."""
    fields = [("span_idx", "int"), ("char_start", "int"), ("char_end", "int"), ("text_chars", "int")]
    return explode_text(texts, ["shard_file", "row"], "text", lambda t, _: [(i, a, b, b - a) for i, (a, b) in enumerate(spans_of(t))], fields)


def index_new_files(spark: SparkSession, folder: str, store: IndexStore, checkpoint: str, encode: Callable[[DataFrame], DataFrame], model: str, dim: int, files_per_batch: int = 16) -> None:
    """Indexes every parquet file not seen before and stops (availableNow).

    The file source's checkpoint knows the files taken; a micro-batch repeated after a failure
    leaves out shards already committed, so rows are never doubled.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.join(store.manifest().select("shard_file"), "shard_file", "left_anti")
        if fresh.limit(1).count():
            store.commit(encode(chunk_shards(fresh)), model, dim)

    stream = (
        spark.readStream.schema("text string").option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        .select(F.col("_metadata.file_name").alias("shard_file"), F.col("_metadata.row_index").alias("row"), "text")
    )
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_latency(events: DataFrame, ts: str, group: str, value: str, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(window_start, group, n, mean_value, max_value) with late rows accepted up to `late`."""
    ready = events.withWatermark(ts, late) if events.isStreaming else events
    return ready.groupBy(F.window(ts, window).alias("w"), group).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value")).select(F.col("w.start").alias("window_start"), group, "n", "mean_value", "max_value")
