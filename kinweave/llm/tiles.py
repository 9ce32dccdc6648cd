"""Groups too large for one task, dealt into tiles; and joins whose hot keys are split.

The rows of a group are dealt into blocks by a hash, and every two blocks, and each with
itself, make a tile: a task sees two blocks at most, and two rows of a group meet in one tile.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: A group gives up to SPREAD blocks of this many rows; beyond these, blocks hold up to
#: MOST_ROWS rows and MOST_BYTES bytes on average.
BLOCK_ROWS, SPREAD = 1024, 8
MOST_ROWS, MOST_BYTES = 8192, 16 << 20
#: A key with more than this share of all rows is hot, so there are at most HOT hot keys.
HOT = 1000


def blocks(rows: Column, size: Column) -> Column:
    """How many blocks a group of so many rows and bytes is dealt into."""
    few = F.least(F.ceil(rows / BLOCK_ROWS), F.lit(SPREAD))
    return F.greatest(few, F.ceil(rows / MOST_ROWS), F.ceil(size / MOST_BYTES)).cast("int")


def dealt(members: DataFrame, item: str) -> DataFrame:
    """Rows of ``members`` for each tile they are in: adds ``block``, ``lo`` and ``hi``.

    ``members`` has a column ``blocks``; ``item`` tells the rows of a group apart.
    """
    placed = members.withColumn("block", F.pmod(F.xxhash64(F.col(item), F.lit("block")), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return placed.withColumn("_other", other).select(
        "*", F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi")
    ).drop("_other", "blocks")


def spanning(first: np.ndarray, n: int, partners) -> list[tuple[int, int]]:
    """Links that connect what all links of a tile would.

    ``first`` are rows whose partners ``partners(i, labels)`` are to be asked for, of ``n``
    rows. A row that is linked to several parts found so far joins them.
    """
    labels, out = np.arange(n), []
    for i in first:
        found = partners(i, labels)
        found = found[labels[found] != labels[i]]
        if len(found):
            parts, at = np.unique(labels[found], return_index=True)
            out += [(int(i), int(j)) for j in found[at]]
            labels[np.isin(labels, np.append(parts, labels[i]))] = min(parts[0], labels[i])
    return out


def join_one(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join with a table that has one row for each key, none of them null.

    Keys that hold more than a share of 1 / HOT of all rows, at most HOT of them, meet the
    table in a broadcast, so that no task gets all rows of one.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = F.broadcast(counts.where(F.col("_n") > max(total / HOT, 1000)).select(key))
    at_hand = F.broadcast(table.join(hot, key, "left_semi"))
    return rows.join(at_hand, key).unionByName(rows.join(hot, key, "left_anti").join(table, key))
