"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows whose crc32(doc_id as text) mod HOLD_OUT_FOLDS is 0 are never learned from.
HOLD_OUT_FOLDS = 5

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session on one machine (a local test) gets a temporary folder where the setting is
    missing; on a cluster executors would write to their own disks, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="genostrata-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh(taken: Sequence[str], *names: str) -> list[str]:
    """``names``, each with as many underscores after it as it takes to differ from ``taken``."""
    had, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in had:
            name += "_"
        had.add(name.lower())
        out.append(name)
    return out


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, freezes row ids and gives
    the planner the true size of what follows.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/genostrata-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The written tables of one operator; at its end all go but those its result still reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, *, keep: bool = False) -> DataFrame:
        path = f"{shared_dir(self.spark)}/genostrata-{uuid.uuid4().hex}"
        if not keep:
            self.paths.append(path)
        return materialise(df, path)

    def __exit__(self, *exc) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def held_out(doc_id: Column) -> Column:
    """True for the rows kept out of all learning (null ids count as an empty text)."""
    digest = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(digest, F.lit(HOLD_OUT_FOLDS)) == 0


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that nearby inputs give unrelated values."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def ascii_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: bytes methods know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` hashes, order-sensitive; empty if too few."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def give_back() -> None:
    """Hand unused memory back to the system: a worker stays for a while when its task has ended."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


#: Arrow types of the columns that Python tasks add.
ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def add_text_columns(rows: DataFrame, text: str, make: Callable[[], Callable[[list], Sequence]], result: str, *, keep_text: bool = False, slice_bytes: int | None = None) -> DataFrame:
    """``rows`` without column ``text`` plus the columns of DDL ``result``, row by row.

    ``make`` is called once in each task; what it returns gets the texts of an Arrow batch
    (nulls as None) and returns one sequence for each result column. The kept columns
    pass through as Arrow data, so their types and nulls stay as they are. With
    ``keep_text`` the text passes too; with ``slice_bytes`` a batch is worked off in slices
    of about so many bytes of text, and no task holds more of it as Python strings.
    """
    added = StructType.fromDDL(result)
    types = [ARROW[f.dataType.simpleString()] for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        yield from worked_off(batches, apply)
        if slice_bytes is not None:
            del apply
            give_back()

    def worked_off(batches: Iterator[pa.RecordBatch], apply: Callable[[list], Sequence]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index(text)
            n = whole.num_rows
            step = n if slice_bytes is None else max(1, n * slice_bytes // max(1, whole.column(at).nbytes))
            for start in range(0, max(n, 1), max(step, 1)):
                batch = whole.slice(start, step)
                found = apply(batch.column(at).to_pylist())
                keep = [i for i in range(batch.num_columns) if keep_text or i != at]
                columns = [batch.column(i) for i in keep] + [pa.array(c, t) for c, t in zip(found, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[i] for i in keep] + added.names)

    kept = StructType([f for f in rows.schema if keep_text or f.name != text])
    return rows.mapInArrow(run, StructType(kept.fields + added.fields))
