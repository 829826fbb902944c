"""Tables that are published whole: versioned folders and a pointer that is replaced in one step.

A writer fills a folder of its own and then renames a small file over the pointer. Readers follow the
pointer, so they see the old table or the new one, and a writer that fails leaves nothing
but a folder that nobody reads.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


def _places(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, place, place.getFileSystem(conf)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Hadoop's file systems: written beside, renamed over the old one in one step."""
    jvm, conf, target, fs = _places(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    # The local file system keeps checksums in a second file, which no rename takes along; its raw form has none.
    local = fs.getUri().getScheme() == "file"
    store = fs.getRaw() if local else fs
    out = store.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if local:
        store.rename(beside, target)
        return
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    whole = fs.makeQualified(target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), conf).rename(fs.makeQualified(beside), whole, over)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None where there is none."""
    _, _, place, fs = _places(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def publish(df: DataFrame, path: str, keep: int = 2, partition_by: list[str] = ()) -> str:
    """Write ``df`` as the next snapshot of ``path`` and point to it; returns the snapshot's name.

    The ``keep`` (1 or more) newest whole snapshots stay, so readers that followed the pointer before may finish.
    """
    spark = df.sparkSession
    name = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{name}")
    write_text(spark, f"{path}/{POINTER}", name)
    _, _, place, fs = _places(spark, path)
    within = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join((path, *parts)))
    names = sorted(n for s in fs.listStatus(place) if (n := s.getPath().getName()).startswith("v-") and n <= name)
    whole = [n for n in names if fs.exists(within(n, "_SUCCESS"))]
    # What a failed writer left goes too, once it is older than all that stays.
    for old in [n for n in names if n < whole[-keep:][0]]:
        fs.delete(within(old), True)
    return name


def current(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot that ``path`` points to; FileNotFoundError where nothing was published."""
    name = read_text(spark, f"{path}/{POINTER}")
    if name is None:
        raise FileNotFoundError(f"nothing was published at {path}")
    return spark.read.parquet(f"{path}/{name}")
