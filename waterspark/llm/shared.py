"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - loads pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waterspark.session import new_shared_path

SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the folder that all executors share and read back.

    Cuts the lineage, fixes generated ids, and lets several passes share one computation;
    a lost executor costs no recomputation.
    """
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables from ``stored`` that nothing lazy reads any more, and let Spark's cleaner
    see which shuffles have no reader left."""
    gc.collect()
    for made in tables:
        spark = made.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(made._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark._jvm.System.gc()


def text_of(column: str) -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0).cast("bigint"))


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``chars`` characters of text, so that a worker's
    memory follows the piece and not the batch. One row is never split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > chars:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(size)
        yield batch.slice(start)


def map_slices(
    df: DataFrame, text: str, chars: int, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]
) -> DataFrame:
    """``fn`` over bounded slices of ``df``, inside the tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text, chars):
            made = fn(piece)
            if made is not None and made.num_rows:
                yield made

    return df.mapInArrow(work, schema)
