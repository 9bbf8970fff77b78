"""Tables that iterations leave behind: written to the folder all executors share and read back, so that a step's plan
does not hold the steps before and a lost executor costs its own tasks only."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


#: Whether shuffle files go with their query; else they stay until the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """A folder under spark.checkpoint.dir (set here only where it is unset and all runs on this machine)."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + os.path.join(tempfile.gettempdir(), "tabsonde-checkpoints")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.base, self.count = spark, f"{base.rstrip('/')}/steps-{uuid.uuid4().hex}", 0
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
        """The rows, computed once and in a folder for each value of `by`; what was kept under the same name before is
        removed."""
        self.count += 1
        path = f"{self.base}/{self.count}-{name}"
        before = self.spark.conf.get(SHUFFLES_GO, "false")
        self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            df.write.partitionBy(*by).parquet(path)
        finally:
            self.spark.conf.set(SHUFFLES_GO, before)
        if name in self.paths:
            self._remove(self.paths[name])
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.paths.pop(name))

    def drop_part(self, name: str, part: str) -> None:
        """Remove one folder of a table that is kept by a column, such as kind=1."""
        self._remove(f"{self.paths[name]}/{part}")

    def _remove(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
