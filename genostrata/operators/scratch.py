"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only in a local session without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="genostrata-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/genostrata-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Tables:
    """The written tables of one operator; at its end all go but those that were ``kept``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.places = spark, [], {}

    def __enter__(self) -> Tables:
        return self

    def written(self, df: DataFrame) -> DataFrame:
        table, path = _write(df)
        self.paths.append(path)
        self.places[path] = table
        return table

    def dropped(self, *tables: DataFrame | None) -> None:
        """Delete written tables that nothing reads any more, before the end."""
        gone = [path for path, table in self.places.items() if any(table is t for t in tables)]
        for path in gone:
            self._delete(path)
            self.paths.remove(path)
            del self.places[path]

    def kept(self, df: DataFrame) -> DataFrame:
        return _write(df)[0]

    def __exit__(self, *exc) -> None:
        for path in self.paths:
            self._delete(path)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
