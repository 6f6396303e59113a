"""A bitmap of fixed size over the low bits of a column, to drop rows before a shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of every bitmap (8 MB), whatever the size of the input: a fuller one keeps more rows, never fewer.
BITS = 1 << 26
#: Bits that Spark's bitmap aggregate holds in a row (fixed value).
ROW_BITS = 1 << 15


def spread(df: DataFrame, column: str) -> Broadcast:
    """The low bits of a bigint column of `df` of hashes, as a broadcast bitmap. Nulls are left out."""
    at = F.col(column).bitwiseAND(F.lit(BITS - 1))
    rows = df.where(F.col(column).isNotNull()).groupBy(F.floor(at / ROW_BITS).alias("row"))
    bits = np.zeros(BITS // 8, np.uint8)
    for found in rows.agg(F.bitmap_construct_agg(at % ROW_BITS).alias("bits")).collect():
        bits[found["row"] * ROW_BITS // 8 :][: ROW_BITS // 8] = np.frombuffer(found.bits, np.uint8)
    return df.sparkSession.sparkContext.broadcast(bits)


def marked(column: pa.Array, bitmap: Broadcast) -> pa.Array:
    """Whether each value of a bigint column without nulls may be among those of the bitmap."""
    at = column.to_numpy(zero_copy_only=False) & (BITS - 1)
    return pa.array((bitmap.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)


def holds(df: DataFrame, column: str, bitmap: Broadcast) -> DataFrame:
    """The rows of `df` whose bigint `column` may be among those of the bitmap; nulls go."""

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(marked(batch[column], bitmap))

    return df.where(F.col(column).isNotNull()).mapInArrow(keep, df.schema)
