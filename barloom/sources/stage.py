"""Tables between jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from barloom.session import fresh_path


def stage(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write a frame that several plans read to the shared folder and read it back.

    Later plans start from the files, so a lost executor costs only its own tasks.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stage_path(df, name, by))


def stage_path(df: DataFrame, name: str, by: Sequence[str] = ()) -> str:
    path = fresh_path(df.sparkSession, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return path


class Steps:
    """Stored steps of one job that go once its result is stored."""

    def __init__(self) -> None:
        self._kept: list[tuple[DataFrame, str]] = []

    def stage(self, df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
        path = stage_path(df, name, by)
        self._kept.append((df, path))
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        """Delete the files. Frames that read them must not be run again."""
        while self._kept:
            df, path = self._kept.pop()
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
