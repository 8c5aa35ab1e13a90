"""Many bounded groups per Arrow batch.

``applyInArrow`` crosses into Python once per group; with millions of small groups that
dominates. Here a group is packed into one row by a JVM aggregate and a batch holds many
groups. Use it only where a group is bounded by construction (a block, a cell, one part
of an outline).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from waterspark.operators.spatial_join import batch_column, list_offsets

GroupFn = Callable[[dict, dict[str, np.ndarray]], list[np.ndarray]]


def map_groups(df: DataFrame, keys: list[str], values: list[str], out: list[T.StructField], fn: GroupFn) -> DataFrame:
    """Apply ``fn(key values, value arrays)`` to each group; it returns the output columns
    as equally long arrays."""
    packed = df.groupBy(*keys).agg(F.collect_list(F.struct(*values)).alias("_v"))
    schema = T.StructType([*[df.schema[k] for k in keys], *out])
    kinds = [to_arrow_type(f.dataType) for f in out]
    names = [*keys, *[f.name for f in out]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch_column(batch, "_v")
            flat, off = column.flatten(), list_offsets(column)
            arrays = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in values}
            heads = {k: batch_column(batch, k).to_pylist() for k in keys}
            sizes, parts = np.zeros(batch.num_rows, dtype=np.int64), []
            for i in range(batch.num_rows):
                got = fn({k: heads[k][i] for k in keys}, {c: a[off[i] : off[i + 1]] for c, a in arrays.items()})
                sizes[i] = len(got[0])
                parts.append(got)
            take = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            cols = [pa.array(np.concatenate(c)).cast(k) for c, k in zip(zip(*parts), kinds)]
            yield pa.RecordBatch.from_arrays([*[batch_column(batch, k).take(take) for k in keys], *cols], names=names)

    return packed.mapInArrow(work, schema)
