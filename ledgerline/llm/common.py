"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

_PACKAGE = Path(__file__).resolve().parents[1]

#: Texts of one Arrow batch are handled in runs of about this many bytes, so memory
#: stays bounded however long the documents of a batch are.
RUN_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors (once for each Spark context)."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerline_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(target))
    sc._ledgerline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


@cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='ledgerline-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; a folder of our own only in local mode with none set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            root = _own_dir()
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let shuffle files of finished plans go: they stay until the driver collects its garbage.

    Python lets go of the JVM's objects in the background, so the first round may miss some.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.1)
        spark._jvm.System.gc()


def drop_materialized(*frames: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm, jsc = spark._jvm, spark.sparkContext._jsc
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


_RESIDENT: dict[object, object] = {}


def resident(key: object, build: Callable[[], T]) -> T:
    """What ``build`` returns, kept in a Python worker until another key is asked for.

    Workers outlive their tasks; so at most one operator's model stays in memory.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        give_back()
        _RESIDENT[key] = build()
    return _RESIDENT[key]  # type: ignore[return-value]


def give_back() -> None:
    """Return freed memory to the system. Allocators keep it otherwise, and a worker's next
    model would stand beside what the tasks of earlier stages once needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def text_runs(batches: Iterable[pa.RecordBatch], text: str, run_bytes: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each piece stay near ``run_bytes``; gives memory back at the end."""
    for batch in batches:
        start = size = 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > run_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if len(lengths) > start:
            yield batch.slice(start)
    give_back()


def arrow_schema(batch_schema: pa.Schema, keep: list[str], extra: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([batch_schema.field(k) for k in keep] + [pa.field(n, t) for n, t in extra])


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores appended while ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of these names renamed to free ones, and the new name of each."""
    wanted = {n.lower() for n in names}
    renamed = {c: free_name(df, f"{c}_given") for c in df.columns if c.lower() in wanted}
    return df.withColumnsRenamed(renamed), renamed
