"""Readers and writers of the file kinds the engine takes."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def markdown_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of every *.md."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def parquet_texts(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """(shard_file, row, text), the text column alone being read; row counts within its file."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path).select(F.col("_metadata.file_name").alias("shard_file"), F.col("_metadata.row_index").alias("row"), text)


def shard_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(shard_file, path, size) of every parquet file below folder, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path", F.col("length").alias("size"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("shard_file"), "path", "size").orderBy("shard_file")


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object per non-blank line."""
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_json_document(df: DataFrame, path: str, most: int = 100_000) -> None:
    """One JSON array of all rows, indented, nulls kept, as a single file at path. It is written by the
    driver, so it's for reports: more than `most` rows raise. The file appears whole or not at all."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for one JSON document; use write_jsonl")
    text = json.dumps([json.loads(r.j) for r in rows], ensure_ascii=False, indent=2)
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line, UTF-8; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, split: str, path: str) -> None:
    """One folder of JSON lines per split."""
    df.write.mode("overwrite").partitionBy(split).option("ignoreNullFields", "false").json(path)


def tsv_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted: audio, text; rejected: line). Blank and # lines are skipped, a line without a TAB
    is rejected, the first TAB divides, both parts are trimmed."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    parts = F.split("value", "\t", 2)
    good = lines.where("contains(value, '\t')").select(F.trim(parts[0]).alias("audio"), F.trim(parts[1]).alias("text"))
    return good, lines.where("not contains(value, '\t')").select(F.col("value").alias("line"))


def image_captions(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, content, text): images with the captions of metadata.jsonl beside them."""
    captions = jsonl(spark, f"{folder}/metadata.jsonl", "file_name string, text string")
    images = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
    return images.join(captions, "file_name")


def image_geometry(width: Column, height: Column, size: int) -> Column:
    """struct(width, height, left, top): the scaled size at which the shorter side is `size`, and where
    the centred square is cut from it."""
    scale = size / F.least(width, height)
    w, h = F.bround(width * scale).cast("int"), F.bround(height * scale).cast("int")
    return F.struct(w.alias("width"), h.alias("height"), F.floor((w - size) / 2).cast("int").alias("left"), F.floor((h - size) / 2).cast("int").alias("top"))


def flips(key: Column, seed: int) -> Column:
    """Half of the keys, always the same ones for a seed: images to be mirrored."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2)) == 1


def square_pixels(rgb: np.ndarray, size: int, flip: bool) -> np.ndarray:
    """An RGB image (height, width, 3; 0..255) as a square of values in -1..1: scaled to `size` at its
    shorter side (bilinear), cut at the centre, mirrored on request."""
    h, w = rgb.shape[:2]
    scale = size / min(w, h)
    wide, high = round(w * scale), round(h * scale)

    def taps(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)

    x0, x1, fx = taps(w, wide)
    y0, y1, fy = taps(h, high)
    rows = rgb[y0].astype(np.float32) * (1 - fy)[:, None, None] + rgb[y1] * fy[:, None, None]
    scaled = rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]
    left, top = (wide - size) // 2, (high - size) // 2
    cut = scaled[top : top + size, left : left + size]
    return (cut[:, ::-1] if flip else cut) / 127.5 - 1


def prepared_images(images: DataFrame, decode: Callable[[bytes], np.ndarray], size: int = 512, seed: int = 0) -> DataFrame:
    """(file_name, text, pixels array<float>) of image_captions(): square_pixels in rows of three
    channels. decode turns a file into an RGB array; decoders aren't part of this package."""
    ready = images.select("file_name", "text", flips(F.col("file_name"), seed).alias("flip"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [square_pixels(decode(c), size, f).astype(np.float32).ravel() for f, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.list_(pa.float32()))], names=["file_name", "text", "pixels"])

    return ready.mapInArrow(run, "file_name string, text string, pixels array<float>")


def distractors(df: DataFrame, text: str, order: str, n: int, longer_than: int = 200, most: int = 1200) -> DataFrame:
    """The first n passages over longer_than characters in `order`, each cut to `most`."""
    return df.where(F.length(text) > longer_than).orderBy(order).limit(n).select(order, F.substring(text, 1, most).alias("body"))


def backoff_seconds(attempt: int, cap: float = 60.0) -> float:
    """The pause before a retry: doubling, at most cap."""
    return min(cap, float(2 ** min(attempt, 6)))


def read_document(root: str, name: str) -> str:
    """The text of a document under root; a path that leads outside raises."""
    base = os.path.realpath(root)
    path = os.path.realpath(os.path.join(base, name))
    if os.path.commonpath([base, path]) != base or not os.path.isfile(path):
        raise ValueError(f"no such document: {name}")
    with open(path, encoding="utf-8") as f:
        return f.read()
