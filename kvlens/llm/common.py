"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most 64-bit ids (16 MB) that are broadcast after their count has been checked.
BROADCAST_IDS = 2_000_000
#: Most rows and bytes of an Arrow batch, so that a task holds little of its partition at once, whatever its texts' lengths.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='kvlens-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Tables written to the shared folder.  A written table cuts the lineage and survives a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no result reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            for file in table.inputFiles()[:1]:
                path = jvm.org.apache.hadoop.fs.Path(file).getParent()
                if "/" + self.root.rsplit("/", 1)[1] + "/" in path.toString():
                    path.getFileSystem(conf).delete(path, True)


def keep_ids(df: DataFrame, ids: DataFrame, id_col: str, how: str, n_ids: int | None = None) -> DataFrame:
    """Semi or anti join on an id; the ids are broadcast only when their counted number is small."""
    n = ids.count() if n_ids is None else n_ids
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, id_col, how)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: str, text_col: str) -> Column:
    """The id, or for rows without one a large number from the text's hash (equal texts, equal numbers)."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(text_or_empty(text_col)), F.lit(1 << 61)))


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches kept small."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def map_rows(df: DataFrame, fn: Callable[..., dict], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow over slices of at most ``rows`` rows; ``fn`` gets one list per column and returns columns."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = fn(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip((made[f.name] for f in out), out, strict=True)], schema=out)

    return bounded(df).mapInArrow(run, schema)


WORD = r"[^\x20\x09-\x0D]+"
