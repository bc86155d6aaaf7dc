"""Plumbing shared by the operators: shared-folder tables and Arrow loops."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of every contract here: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Lets Spark delete a write's shuffle files when it is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one is set only where none is configured and there is one process (tests)."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


@contextmanager
def _cleaning(spark: SparkSession):
    """Shuffle files of a write go when it is done: nothing reads them after."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Bucketed:
    """A table in the shared folder, dealt into buckets by a key: joins on that key do not shuffle it again."""

    def __init__(self, df: DataFrame, key: str, tag: str, buckets: int):
        self.spark, self.name = df.sparkSession, f"quire_{tag}_{uuid.uuid4().hex}"
        with _cleaning(self.spark):
            path = f"{shared_dir(self.spark)}/{self.name}"
            df.write.format("parquet").bucketBy(buckets, key).option("path", path).option("compression", "none").saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        drop_stored(self.df)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by stored() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def id_mod(col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def text_bytes(col: str) -> Column:
    """UTF-8 bytes of a text; null is the empty text."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def rows(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def by_bytes(batch: pa.RecordBatch, name: str, limit: int):
    """Slices of a batch holding about limit bytes of the binary column each (a longer value is alone)."""
    sizes = [len(x) for x in rows(batch, name)]
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
