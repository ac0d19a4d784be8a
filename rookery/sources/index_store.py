"""A vector index in shards, made visible by a manifest.

A shard is one partition folder of the data table; it counts once its manifest row exists, which
is written after the data. Readers only see rows of committed shards, so a run that died leaves
nothing visible and is repaired by writing its shards again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rookery.operators import dense
from rookery.session import drop, materialise

CALIBRATION = "lows array<double>, spans array<double>, dim int, n long"
MANIFEST = "shard_file string, n_chunks long, text_chars long, model string, dim int"


class IndexStore:
    """Data under path/data, the manifest under path/manifest, the int8 calibration under
    path/calibration. Rows may hold spans, the codes of their vectors (code1, code8: see
    dense.encode_codes) or both; readers prune to the columns they need."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> DataFrame:
        """One row per committed shard; empty before the first commit."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST)

    def todo(self, shards: DataFrame, most: int | None = None) -> DataFrame:
        """Listed shards without a commit, by name."""
        left = shards.join(self.manifest(), "shard_file", "left_anti").orderBy("shard_file")
        return left.limit(most) if most is not None else left

    def calibrate(self, vectors: DataFrame, vec: str, item: str) -> DataFrame:
        """The index's int8 calibration: fitted and stored on the first call, afterwards the stored one,
        so that all shards are encoded alike."""
        try:
            return self.calibration()
        except AnalysisException:
            dense.calibrate_int8(vectors, vec, item).coalesce(1).write.parquet(f"{self.path}/calibration")
            return self.calibration()

    def calibration(self) -> DataFrame:
        """One row (lows, spans, dim, n)."""
        return self.spark.read.schema(CALIBRATION).parquet(f"{self.path}/calibration")

    def commit(self, rows: DataFrame, model: str, dim: int) -> None:
        """Writes rows (shard_file, ...) and then their manifest entries. rows are worked out once: they
        are staged under the index, checked, and moved by a second write of what was staged; a
        text_chars column is summed up. Rewrites the folders of exactly these shards; shards
        already committed raise, as do vectors of another model or size."""
        known = self.manifest().select("model", "dim").limit(1).collect()
        if known and (known[0].model, known[0].dim) != (model, dim):
            raise ValueError(f"index was built with {known[0].model}, not {model}")
        staged = materialise(rows)
        chars = F.sum("text_chars") if "text_chars" in staged.columns else F.lit(0)
        entries = materialise(staged.groupBy("shard_file").agg(F.count("*").alias("n_chunks"), chars.cast("long").alias("text_chars")))
        again = entries.join(self.manifest(), "shard_file", "left_semi").limit(1).collect()
        if again:
            raise ValueError(f"shard already committed: {again[0].shard_file}")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard_file").parquet(f"{self.path}/data")
        entries.withColumn("model", F.lit(model)).withColumn("dim", F.lit(dim)).write.mode("append").parquet(f"{self.path}/manifest")
        drop(staged), drop(entries)

    def raw(self) -> DataFrame:
        """All rows on disk, committed or not."""
        return self.spark.read.parquet(f"{self.path}/data")

    def uncommitted(self) -> DataFrame:
        """(shard_file, rows) a crashed run left behind; they are invisible."""
        return self.raw().join(self.manifest(), "shard_file", "left_anti").groupBy("shard_file").agg(F.count("*").alias("rows"))

    def open(self, model: str | None = None, verify: bool = True) -> DataFrame:
        """The committed rows. Raises if there are none, if a shard has fewer rows than its entry, or
        if it was built with another model.

        The manifest decides what is read. verify compares its counts with those in the files'
        footers, for which no column is read; without it nothing but the manifest is.
        """
        entries = self.manifest()
        models = [r.model for r in entries.groupBy("model").count().limit(2).collect()]
        if not models:
            raise ValueError("the index is empty: no shard was committed")
        if model is not None and models != [model]:
            raise ValueError(f"the index was not built with {model}")
        if verify:
            have = self.raw().groupBy("shard_file").agg(F.count("*").alias("rows"))
            short = entries.join(have, "shard_file", "left").where("coalesce(rows, 0) < n_chunks").limit(1).collect()
            if short:
                raise ValueError(f"shard {short[0].shard_file} has fewer rows than its manifest entry")
        return self.raw().join(entries.select("shard_file"), "shard_file", "left_semi")

    def totals(self) -> DataFrame:
        """One row (shards, n_chunks, text_chars)."""
        return self.manifest().agg(F.count("*").alias("shards"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("text_chars"), F.lit(0)).alias("text_chars"))
