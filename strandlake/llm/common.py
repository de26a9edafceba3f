"""Reading of the corpus tables, the shared folder for intermediate tables, Python over Arrow batches, and the train/held-out split."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, where the session doesn't say.
BATCH_BYTES = 4 << 20
#: Rows of two numbers that a broadcast may hold (about 16 bytes each); beyond it both sides are shuffled.
BROADCAST_ROWS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; on a local master, as in tests, one of our own where that is unset."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not held:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    The files are replicated as that folder's store does it, so a lost executor
    costs nothing that has been written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read any more: what was made from them has been stored itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``, unless the session asks for less: a worker holds one as it comes and one as it goes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key).rstrip("b")
    if held.isdigit() and int(held) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@lru_cache(1)
def _trim() -> Callable:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def tidied(results: Iterator) -> Iterator:
    """The results; at the end, what a worker has freed goes back to the system, since workers stay for further tasks."""
    try:
        yield from results
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        _trim()(0)


def _worked(batches: Iterator, work: Callable) -> Iterator:
    return tidied(work(batches))


def mapped(df: DataFrame, work: Callable, schema: object) -> DataFrame:
    """mapInArrow in small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(partial(_worked, work=work), schema)


def held_out(doc_id: Column) -> Column:
    """True for the rows no model may learn from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def text_hash(text: str | Column = "text") -> Column:
    """Tells rows of one doc_id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(df: DataFrame) -> Column:
    """All columns of a row as one, so that no name among them clashes; ``select("row.*")`` gives them back."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row")


def labelled_sample(labels: DataFrame, documents: DataFrame, rows: int, columns: list[str]) -> DataFrame:
    """At most ``rows`` labelled training documents (doc_id, columns, text).

    The ids are drawn from the labels by a hash of the id, so the draw is the
    same on every run; no held-out row is drawn. The drawn ids are at most
    ``rows`` long, which bounds the broadcast. Labels that contradict each other
    count by their greatest values, and of several documents of one id that of
    the least text hash is taken, so that rows are bounded and the same each time.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(*(F.max(c).alias(c) for c in columns))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(*(F.first(c).alias(c) for c in columns), F.min_by("text", text_hash()).alias("text"))
