"""Intermediate tables in the shared folder, which cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir. Only a local session that names none gets a temporary folder; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly to as many tasks as a shuffle has. A small pressed table is one task's to read, however much work its rows make."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def by_shuffle(df: DataFrame) -> DataFrame:
    """Rows that a join shuffles. Spark plans by the size of files, where source text is a twentieth of its rows: what grows with the mappers would be sent whole through the driver.

    It holds for the next join, also after other steps with one input. Joins without a key that spreads the rows should do without.
    """
    return df.hint("merge")


class Workspace:
    """A folder of Parquet tables below the shared folder; it goes when the interpreter ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, f"{scratch_folder(spark)}/work-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self.drop)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write the rows and read them again."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_large(self, df: DataFrame) -> DataFrame:
        """``keep`` for rows that grow with the mappers or files; see ``by_shuffle``."""
        return by_shuffle(self.keep(df))

    def drop(self) -> None:
        try:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before
            pass
