"""Tables in the folder that all machines share: intermediate ones, and results kept by their parameters."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: shuffle files go when it is done.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir of the session; one of our own only where none is set, on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not set_before.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = set_before.get() if set_before.isDefined() else tempfile.mkdtemp(prefix="cellweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediate tables in the shared folder.

    A table cuts the lineage: an executor that is lost later costs a read, not the stages before.
    Leaving the block removes every table but those made by keep().  Kept tables back the frames
    that an operator returns, so they stay until the folder of the application is removed.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.mine = spark, []
        self.top = f"{shared_dir(spark)}/cellweave/{spark.sparkContext.applicationId}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.mine:
            remove(self.spark, path)

    def path(self, name: str) -> str:
        return f"{self.top}/{name}-{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        conf = self.spark.conf
        before = conf.get(_CLEAN_UP, None)
        conf.set(_CLEAN_UP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.unset(_CLEAN_UP) if before is None else conf.set(_CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame, name: str = "kept") -> DataFrame:
        return self._write(df, self.path(name))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        self.mine.append(path)
        return self._write(df, path)


def computed(spark: SparkSession, top: str, name: str, parameters: dict, make: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """A table kept under its name and parameters: read if it was finished before, else computed and written."""
    from cellweave.sources.rasters import exists

    key = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{top}/{name}-{key}"
    if again or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
