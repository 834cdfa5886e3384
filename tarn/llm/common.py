"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete, mark, new_path, release

#: Rows of a few longs that may be broadcast: some 20 MB.
BROADCAST_ROWS = 150_000
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that a lost executor costs no earlier work.

    The folder goes when it is discarded or the process ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("error").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that no result reads any more."""
    for df in cuts:
        delete(df.sparkSession, df.cut_path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for each row in the column ``name``, written so that a row keeps it."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def without(rows: DataFrame, name: str, find: Callable[[], DataFrame]) -> DataFrame:
    """``rows`` as ``numbered`` wrote them but for those whose numbers the one column that ``find`` makes holds; what it writes on its way is deleted. Up to BROADCAST_ROWS numbers go to the rows,
    by their count; beyond that both are merged by number."""
    since = mark()
    gone = find()
    gone = cut(gone.select(F.col(gone.columns[0]).alias(name)), "gone")
    release(since, gone.cut_path)
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("merge")
    return rows.join(few, name, "left_anti").drop(name)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in batches of BATCH_ROWS rows, as rows are whole texts, with the memory of a task given back when it ends."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def whole_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole_task, schema)


def give_back() -> None:
    """Return free memory to the system: workers live on between tasks and would keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``limit`` bytes in one text column, or of one longer text: only a slice becomes Python objects."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        end, held = at + 1, int(sizes[at])
        while end < batch.num_rows and held + sizes[end] <= limit:
            held += int(sizes[end])
            end += 1
        yield batch.slice(at, end - at)
        at = end


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each behind as many underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def crc_part(id_col: str = "doc_id"):
    """crc32 of an id as text, modulo 4: the fold that training must not see is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def held_out(id_col: str = "doc_id"):
    """Whether a row is in the fold that training must not see; rows without an id are not."""
    return F.coalesce(crc_part(id_col) == 2, F.lit(False))
