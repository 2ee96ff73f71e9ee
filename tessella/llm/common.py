"""What the operators share: inputs, the shared folder, bounded Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.shipping import ship

#: Rows and bytes of an Arrow batch sent to Python: bound a task's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
#: A join key is hot if more than one row in so many has it, so fewer than so many keys are.
HOT_SHARE, LEAST_HOT = 500, 1_000

#: What a Python worker keeps from one task to the next, of one operator only.
_kept: dict[str, dict] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hand texts to Python in small batches, so that memory follows the longest text only,
    and let the workers import this package.

    Both bounds are settings of the session, read when a plan runs, so they stay set."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that setting is absent, a temporary folder is made for a local master (tests, a
    laptop); on a cluster, whose executors could not see it, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessella-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tessella_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialise`` that no plan reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.tessella_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """``left`` joined with ``right`` (one row a key), where a key may hold any share of
    ``left``, a table that was written.  Keys of more than one row in ``HOT_SHARE`` are fewer
    than that many, so their rows of ``right`` are broadcast; the others are shuffled."""
    most = max(LEAST_HOT, left.count() // HOT_SHARE)
    hot = materialise(left.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*on), "hot")
    few = F.broadcast(hot)
    warm = left.join(few, on, "left_semi").join(F.broadcast(right.join(few, on, "left_semi")), on, how)
    return left.join(few, on, "left_anti").join(right, on, how).unionByName(warm)


def inputs(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that other columns can
    have any name.  ``inputs(docs, doc_id="id", text="body")``."""
    return docs.select(*(docs[given].alias(own) for own, given in columns.items()))


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def give_back() -> None:
    """Return the memory that a worker has freed to the system.  A worker lives on between tasks,
    also through stages that run no Python, beside its executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc holds freed memory back; others may not have this
        ctypes.CDLL(None).malloc_trim(0)


def kept(operator: str) -> dict:
    """What tasks of ``operator`` keep in this worker for later ones.  Workers are handed from
    operator to operator, so the first task of another one drops what those before had kept."""
    own = _kept.get(operator)
    if own is None:
        own, had = {}, bool(_kept)
        _kept.clear()
        _kept[operator] = own
        if had:
            gc.collect()
            give_back()
    return own


def map_task(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose worker returns at its end what the task took, and drops at its start
    what other operators, known by the module of ``run``, had kept."""

    def freed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(run.__module__)
        yield from run(batches)
        give_back()

    return df.mapInArrow(freed, schema)


def map_batches(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with a set-up step: ``start()`` runs once a task and returns the function
    that turns a batch into a batch (None: nothing)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            if (out := step(batch)) is not None and out.num_rows:
                yield out

    run.__module__ = start.__module__
    return map_task(df, run, schema)
