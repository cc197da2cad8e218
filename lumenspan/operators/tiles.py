"""All pairs of two sides, in tiles of bounded size that are dealt over tasks.

The work is that of all pairs, but no task holds more than one block of each side, however
large a group is: a row goes to as many tiles as the other side has blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a block.
ROWS = 8192
#: Cells of a tile that are scored at once.
CELLS = 1 << 23


def most(rows: DataFrame, by: list[str]) -> int:
    """Rows of the largest group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def tiled(left: DataFrame, right: DataFrame, by: list[str], over: Callable[[pa.Table, pa.Table], pa.Table], schema: str, size: int = ROWS, together: tuple[list[str], list[str]] = ([], [])) -> DataFrame:
    """What over(rows of left, rows of right) gives for every tile of groups that both sides have.

    by: the columns that both must share, if any. together: for each side columns of
    which equal values go to as few blocks as their number of rows allows.
    """
    left, right = ((d.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by)) for d in (left, right)) if by else (left, right))
    counts = [max(1, -(-most(d, by) // size)) for d in (left, right)]

    def own(d: DataFrame, n: int, keys: list[str]):
        row = F.xxhash64(*(F.col(c) for c in d.columns))
        return F.pmod(F.xxhash64(*keys) % (1 << 30) + F.pmod(row, F.lit(max(1, -(-most(d, [*by, *keys]) // size)))), F.lit(n)).cast("int") if keys else F.pmod(row, F.lit(n)).cast("int")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = [*by, "_i", "_j"]
    groups = left.select(*by).distinct().count() if by else 1
    # a stated number of partitions: few bytes are much work here, so that they must not be put together
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(groups * counts[0] * counts[1], 4096))
    x = left.withColumn("_i", own(left, counts[0], together[0])).withColumn("_j", every(counts[1])).repartition(parts, *key)
    y = right.withColumn("_j", own(right, counts[1], together[1])).withColumn("_i", every(counts[0])).repartition(parts, *key)

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        # one side alone has no pairs
        return over(a, b) if a.num_rows and b.num_rows else pa.Table.from_pylist([], schema=wanted)

    wanted = to_arrow_schema(StructType.fromDDL(schema))
    return x.groupBy(*key).cogroup(y.groupBy(*key)).applyInArrow(tile, schema)


def vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix in double precision."""
    flat = column.combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
