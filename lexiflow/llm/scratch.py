"""Intermediate tables that go as soon as their readers are done."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..storage import materialize, release, scratch_path


class Scratch:
    """Tables in the shared scratch area, removed when the block ends.  Nothing
    lazy that reads them may leave the block."""

    def __init__(self):
        self.paths: dict[str, list[str]] = {}

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.paths)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        path = scratch_path(spark, name)
        df.write.mode("overwrite").parquet(path)
        self.paths.setdefault(name, []).append(path)
        return spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """A written table that outlives the block: the result."""
        return materialize(df, name)

    def drop(self, *names: str) -> None:
        """Remove these tables before the block ends."""
        for name in names:
            release(*self.paths.get(name, ()))
            self.paths[name] = []
