"""Sharding along a Hilbert curve over several metadata columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import fresh_name, stored


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (row of coordinates of ``bits`` bits each) on the Hilbert curve (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, below = 1 << level, (1 << level) - 1
        for d in range(dims):
            on = (x[d] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & below)
            x[0] ^= np.where(on, below, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    index = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = index << 1 | (x[d] >> level & 1)
    return index


def weighted_cuts(df: DataFrame, column: str, cells: int) -> list[str]:
    """Up to ``cells - 1`` values that cut the rows, ordered by the whole value of a string column, into runs of near equal size.

    Rows are counted by value before they are dealt by range, so that a frequent value is one row; one number per task and
    the cuts come to the driver.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    dealt = stored(counts, "values").repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id())
    held = stored(dealt, "ordered")
    sums = {r["part"]: r["n"] for r in held.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts = np.cumsum([0, *[sums[p] for p in sorted(sums)]])
    before = {p: int(starts[k]) for k, p in enumerate(sorted(sums))}
    total = int(starts[-1])
    order = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    base = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.lit(None)
    if not total:
        return []
    low = base[F.col("part")] + F.coalesce(F.sum("n").over(order), F.lit(0))
    # The value that the next of the equal shares begins in.
    share = lambda c: F.floor(c * cells / F.lit(total))
    cut = held.withColumn("low", low).where(share(F.col("low") + F.col("n") - 1) > share(F.col("low") - 1))
    return sorted(r["value"] for r in cut.where("low > 0").select("value").collect())


def with_curve_index(df: DataFrame, dimensions: Sequence[str], bits: int = 5, name: str = "curve") -> DataFrame:
    """``df`` with the place of each row on the Hilbert curve through the cells of its ``dimensions``.

    Each dimension is cut into at most ``2**bits`` cells: strings at weighted quantiles of their whole values, others at
    approximate quantiles (a mergeable sketch of fixed size), so a skewed column still spreads. Null, NaN and values
    below all cuts are in the first cell. A column called ``name`` is replaced.
    """
    cells = 1 << bits
    if len(dimensions) * bits > 62:
        raise ValueError("dimensions times bits must not exceed 62")
    text = [d for d in dimensions if isinstance(df.schema[d].dataType, T.StringType)]
    other = [d for d in dimensions if d not in text]
    at = F.array(*[F.lit(k / cells) for k in range(1, cells)])
    cuts: dict[str, list] = {d: weighted_cuts(df, d, cells) for d in text}
    if other:
        number = [F.nanvl(F.col(d).cast("double"), F.lit(None)) for d in other]
        found = df.agg(*[F.percentile_approx(c, at, 2000).alias(f"d{k}") for k, c in enumerate(number)]).first()
        cuts |= {d: sorted(set(found[f"d{k}"] or [])) for k, d in enumerate(other)}

    def cell(d: str) -> Column:
        value = F.col(d) if d in text else F.nanvl(F.col(d).cast("double"), F.lit(None))
        steps = [F.when(value >= F.lit(c), 1).otherwise(0) for c in cuts[d]]
        return reduce(lambda a, b: a + b, steps, F.lit(0)).cast("bigint")

    @F.pandas_udf("bigint")
    def place(*values: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([v.to_numpy() for v in values], axis=1), bits))

    return df.withColumn(name, place(*[cell(d) for d in dimensions]))


def numbered(df: DataFrame, order: Sequence[str], name: str) -> tuple[DataFrame, int]:
    """``df`` with each row's rank from 0 in a total order, and the number of rows.

    Rows are dealt by range and sorted within their task; the rank is the number of rows in earlier tasks (one
    number per task on the driver) and the place in the own one. Stored in between, so ranks can't change.
    """
    part_name, at_name = fresh_name("__part", df), fresh_name("__at", df)
    dealt = df.repartitionByRange(*[F.asc_nulls_first(c) for c in order]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in order])
    schema = T.StructType([*df.schema.fields, T.StructField(part_name, T.IntegerType()), T.StructField(at_name, T.LongType())])

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            extra = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, part_name, at_name])
            at += n

    held = stored(dealt.mapInArrow(place, schema), "ranked")
    sizes = {r[0]: r[1] for r in held.groupBy(part_name).agg(F.count("*")).collect()}
    parts = sorted(sizes)
    starts = np.cumsum([0, *[sizes[p] for p in parts]])
    before = {p: int(starts[k]) for k, p in enumerate(parts)}

    @F.pandas_udf("bigint")
    def rank(part: pd.Series, at: pd.Series) -> pd.Series:
        return part.map(before).astype("int64") + at

    return held.withColumn(name, rank(part_name, at_name)).drop(part_name, at_name), int(starts[-1])


def hilbert_shards(df: DataFrame, dimensions: Sequence[str], shards: int, ties: Sequence[str], bits: int = 5) -> DataFrame:
    """Rows with ``curve``, ``shard`` and ``slot``: runs of the Hilbert order, of sizes at most one apart.

    ``ties`` orders rows within a cell. Rows that agree in all of that are interchangeable and spread over
    places as they come. Keep ``df`` narrow (keys and metadata); join texts afterwards, or pass them along to
    :func:`write_shards`. Columns of these three names are replaced, any other name is fine. An empty table gives an empty table; fewer rows than shards leave shards empty.
    """
    rank_name = fresh_name("__rank", df)
    ranked, n = numbered(with_curve_index(df, dimensions, bits), ["curve", *ties], rank_name)
    rank = F.col(rank_name)
    small, more = divmod(n, shards)
    cut = F.lit(more * (small + 1))
    early = rank < cut
    in_early = F.floor(rank / F.lit(small + 1))
    in_late = F.lit(more) + F.floor((rank - cut) / F.lit(max(small, 1)))
    shard = F.when(early, in_early).otherwise(in_late).cast("int")
    start = F.when(early, F.col("shard").cast("bigint") * (small + 1)).otherwise(cut + (F.col("shard").cast("bigint") - more) * small)
    return ranked.withColumn("shard", shard).withColumn("slot", rank - start).drop(rank_name)


def write_shards(df: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder per shard, rows in their order; a shard may be dealt to several tasks and files."""
    df.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
