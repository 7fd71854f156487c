"""What the training-data operators share: table reading, shared folders, Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
#: Paths in the shared folder that this process has made.
_made: list[str] = []


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers of the session's application, once."""
    context = spark.sparkContext
    if getattr(context, "_quarrystone_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    folder = Path(tempfile.mkdtemp(prefix="quarrystone-code-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "quarrystone.zip", "w") as archive:
        for file in sorted((root / "quarrystone").rglob("*.py")):
            archive.write(file, file.relative_to(root))
    context.addPyFile(str(folder / "quarrystone.zip"))
    context._quarrystone_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where none is named and all work is done on one machine (tests), a temporary folder is used.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="quarrystone-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    _made.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder by its own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that this process has made in the shared folder: to be called when the results that read it are saved."""
    while _made:
        drop_path(spark, _made.pop())


def replaced(df: DataFrame, added: dict[str, str]) -> DataFrame:
    """``df`` with the columns ``added`` (name: type) last, null as yet, in place of any that have their names."""
    lowered = {name.lower() for name in added}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in lowered), *(F.lit(None).cast(kind).alias(name) for name, kind in added.items()))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores behind it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def freed() -> None:
    """Gives back what Arrow's pool keeps for later: called where a task ends, since its worker lives on."""
    pa.default_memory_pool().release_unused()


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def texts_of(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each value of an Arrow string column, null as empty, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, ends = flat(column)
    view = memoryview(data)
    for i in range(len(column)):
        yield bytes(view[ends[i] : ends[i + 1]])


def sliced(batches: Iterator[pa.RecordBatch], at: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``size`` bytes of column ``at`` (or one row), so that what a task holds is bounded by bytes."""
    for b in batches:
        ends, row = flat(b.column(at))[1], 0
        while row < b.num_rows:
            to = max(row + 1, int(np.searchsorted(ends, ends[row] + size, "right")) - 1)
            yield b.slice(row, to - row)
            row = to
    freed()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column as one array and the n + 1 offsets into it; null is empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
