"""Exact top-k inner products by branch and bound over blocks of dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.llm.common import stored

#: Bytes of query vectors that are sent to the executors at once; more queries take more passes.
BLOCK_BYTES = 32 << 20
_QUERIES = 128
#: Sums of whole numbers up to here are exact in doubles.
_EXACT = float(1 << 53)


def quantized(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``(id, v)``: floor(scale * x) of each component, as doubles that hold whole numbers.

    Vectors that are null or hold null or non-finite components, and rows without a key, take no part.
    """
    x = F.col(vector)
    sound = x.isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double"))
    return df.where(sound & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), v.alias("v"))


class _Search:
    """The best k of each query among the rows seen so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, step: int) -> None:
        self.ids, self.q, self.k, self.step = ids, queries, k, step
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(ids)
        self.least = np.full(len(ids), -np.inf)
        cuts = range(0, queries.shape[1], step)
        length = queries.astype(float)
        self.mass = np.stack([np.sqrt((length[:, c:] ** 2).sum(axis=1)) for c in cuts], axis=1) if cuts else np.zeros((len(ids), 0))

    def see(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """rows: one vector per row. They are laid out by dimension; a block of dimensions is added at a time."""
        columns = np.ascontiguousarray(rows.T)
        cuts = list(range(0, len(columns), self.step))
        length = columns.astype(float)
        mass = np.stack([np.sqrt((length[c:] ** 2).sum(axis=0)) for c in cuts]) if cuts else np.zeros((0, len(rows)))
        for first in range(0, len(self.ids), _QUERIES):
            part = slice(first, first + _QUERIES)
            alive = np.arange(len(rows))
            score = np.zeros((len(self.ids[part]), len(rows)), dtype=rows.dtype)
            for n, c in enumerate(cuts):
                if n:
                    # What the other dimensions can add is at most the product of both remaining lengths.
                    bound = score + self.mass[part, n, None] * mass[None, n, alive] * (1 + 1e-9)
                    keep = (bound >= self.least[part, None]).any(axis=0)
                    if not keep.all():
                        alive, score = alive[keep], score[:, keep]
                if not len(alive):
                    break
                score = score + self.q[part, c : c + self.step] @ columns[c : c + self.step, alive]
            for j in range(len(score)):
                self._keep(first + j, ids[alive], score[j])

    def _keep(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        good = np.flatnonzero((score >= self.least[q]).astype(bool) & (ids != self.ids[q]))
        if not len(good):
            return
        s, i = np.concatenate([self.best[q][0], score[good]]), np.concatenate([self.best[q][1], ids[good]])
        top = np.lexsort((i, -s))[: self.k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda t: (-s[t], i[t]))[: self.k])
        self.best[q] = s[top], i[top]
        if len(top) == self.k:
            self.least[q] = s[top[-1]]


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled up with zeros, longer ones cut (the rest meets zeros)."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v[:width]
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers."""
    return np.array([[int(c) for c in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def top_inner_products(queries: DataFrame, rows: DataFrame, k: int = 5, step: int = 16, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows of highest inner product of each query, ties to smaller ids.

    Both tables are ``(id, v)`` of :func:`quantized`. The rows with the query's own id are no candidates. Vectors
    of different lengths are compared as if filled up with zeros. Queries that repeat an id and a vector are one
    query; repeated rows are candidates each. Empty queries or rows give no result.

    Queries travel in blocks of at most ``block_bytes``, one after the other; every task runs its rows past the block in
    vertical layout, and drops a row as soon as its partial score and the remaining mass can't reach any query's
    k-th best. Each task returns k rows per query at most; these are merged by query.
    """
    spark = rows.sparkSession
    queries = queries.dropDuplicates(["id", "v"])
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w"), F.max(F.array_max(F.transform("v", F.abs))).alias("m")).first()
    width = size.w or 0
    largest = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    exact = (size.m or 0.0) * largest * max(width, 1) < _EXACT
    passes = max(1, -(-(size.n or 0) * (width + 1) * 8 // block_bytes))
    found = []
    for n in range(passes):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == n).toPandas()
        ids, q = block["id"].to_numpy(dtype=np.int64), _matrix(block["v"].tolist(), width)
        held = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            # Beyond the exact range of doubles whole numbers of any size are added.
            search = _Search(ids, q if exact else _whole(q), k, step if exact else width or 1)
            for batch in batches:
                if len(batch):
                    x = _matrix(batch["v"].tolist(), width)
                    search.see(batch["id"].to_numpy(dtype=np.int64), x if exact else _whole(x))
            for own, (score, i) in zip(ids.tolist(), search.best, strict=True):
                if len(i):
                    yield pd.DataFrame({"query_id": own, "vec_id": i, "score": [int(x) for x in score]})

        some = rows.mapInPandas(run, "query_id bigint, vec_id bigint, score bigint")
        if passes == 1:
            found.append(some)
            break
        # One block at a time: its results are stored and its queries leave the driver and the executors.
        found.append(stored(some, "block"))
        held.destroy()
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.union(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return all_found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
