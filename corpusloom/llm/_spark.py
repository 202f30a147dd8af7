"""Spark helpers that the operators share: shipping this package, shared storage, key columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.shipping import ship  # noqa: F401  the operators take it from here


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own where it is unset and all run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_corpusloom_dir", None)
        if base is None:
            base = spark.sparkContext._corpusloom_dir = "file://" + tempfile.mkdtemp(prefix="corpusloom")
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if the session still runs."""
    if spark.sparkContext._jsc is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor loses none of them. Results read them, so they go when the program ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(remove, spark, self.root)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and read it back."""
        self.n += 1
        path = f"{self.root}/{self.n:02d}-{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in frames:
            for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
                if self.root.rpartition("/")[2] in top:
                    remove(self.spark, top)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that df scans."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id) -> "F.Column":
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def row_key(text_col) -> "F.Column":
    """A 64-bit hash of a row's text: with the id it tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text_col, F.lit("")))
