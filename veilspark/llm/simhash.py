"""SimHash near-duplicates: fingerprints, and exact components at a small Hamming distance.

Method (Manku, Jain and Das Sarma; deletion variants after Liu, Shen and Torng): with at most ``distance``
differing bits cut the 64 bits into ``distance // 2 + 1`` segments; one of them differs in at most one bit.
Each segment is indexed once per bit with this bit blanked out, so that both fingerprints of a link meet in
an equality of one such variant, and the meeting is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import join_named, stored
from veilspark.llm.components import connected_components

BITS = 64
#: A bucket of up to this many fingerprints is compared at once in memory; a larger one is joined.
AT_ONCE = 256
_SLICE = 1 << 15


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned fingerprint: a bit is set if it is set in over half of the shingles' hashes."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    stops = ends[min(words, len(tokens)) - 1 :]
    hashes = np.array([digest(line[s:e], 42) for s, e in zip(starts[:n].tolist(), stops.tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, _SLICE):
        part = np.unpackbits(hashes[k : k + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """``(key, fp)``: the fingerprint of each row's whole text, as a signed long. A null text is empty: zero."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, fp bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({key: batch["key"], "fp": fps})

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, schema)


def segments(distance: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    n = distance // 2 + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(fps: DataFrame, distance: int) -> DataFrame:
    """``(variant, fp)``: each segment of a fingerprint once per bit, with this bit blanked out.

    A variant is the place of the blank and, behind it, the remaining bits of the segment.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = []
    for low, width in segments(distance):
        for bit in range(low, low + width):
            mask = ((1 << width) - 1) << low & ~(1 << bit)
            rest = F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(signed(mask))), low)
            # The widest segment has 64 bits; with it alone the place can't stand beside the bits.
            keys.append(F.xxhash64(F.lit(bit), rest) if width > 57 else rest.bitwiseOR(F.lit(signed(bit << 57 & (1 << 64) - 1))))
    return fps.select(F.explode(F.array(*keys)).alias("variant"), "fp")


def _near(fps: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance


def _forest(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links that join all fingerprints of one bucket which true links join: a spanning forest."""
    if len(fps) == 2:
        return ([0], [1]) if int(fps[0] ^ fps[1]).bit_count() <= distance else ([], [])
    near, seen, a, b = _near(fps, distance), np.zeros(len(fps), dtype=bool), [], []
    for root in range(len(fps)):
        todo = [root] if not seen[root] else []
        seen[root] = True
        while todo:
            x = todo.pop()
            new = np.flatnonzero(near[x] & ~seen)
            seen[new] = True
            todo += new.tolist()
            a += [x] * len(new)
            b += new.tolist()
    return a, b


def bucket_links(sorted_variants: DataFrame, distance: int) -> DataFrame:
    """Compares the buckets of a table that is placed by variant and sorted by (variant, fp).

    Returns ``(variant, a, b)``: a link of a spanning forest (variant null); or, of a bucket over ``AT_ONCE``,
    each fingerprint (b null, variant set) beside the true links between neighbours in the order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        hot = last = None

        def done(key: np.ndarray, fps: np.ndarray, final: bool) -> tuple[list, list, list, int]:
            """Rows of the complete buckets and of large ones; how many rows at the front are dealt with."""
            nonlocal hot, last
            if len(key) and key[0] != hot:
                hot = last = None
            v, a, b = [], [], []
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, dtype=np.int64)
            sizes = np.diff(cuts)
            over = cuts[-1]
            for k in np.flatnonzero((sizes > 1) | (key[cuts[:-1]] == hot if hot is not None else False)).tolist():
                s, e = int(cuts[k]), int(cuts[k + 1])
                open_end = e == len(key) and not final
                if hot == key[s] or e - s > AT_ONCE:
                    own = fps[s:e]
                    row = own if hot != key[s] else np.r_[np.uint64(last), own]
                    close = np.flatnonzero(np.bitwise_count(row[1:] ^ row[:-1]) <= distance)
                    v += [None] * len(close) + [int(key[s])] * len(own)
                    a += row[close].view(np.int64).tolist() + own.view(np.int64).tolist()
                    b += row[close + 1].view(np.int64).tolist() + [None] * len(own)
                    hot, last = (int(key[s]), own[-1]) if open_end else (None, None)
                elif not open_end:
                    own = fps[s:e]
                    x, y = _forest(own, distance)
                    v += [None] * len(x)
                    a += own[x].view(np.int64).tolist()
                    b += own[y].view(np.int64).tolist()
            if not final and len(sizes) and hot is None:
                over = cuts[-2]
            return v, a, b, int(over)

        def frame(v: list, a: list, b: list) -> pd.DataFrame:
            whole = lambda x: pd.array(x, dtype="Int64")
            return pd.DataFrame({"variant": whole(v), "a": whole(a), "b": whole(b)})

        for batch in batches:
            key = np.r_[key, batch["variant"].to_numpy(dtype=np.int64)]
            fps = np.r_[fps, batch["fp"].to_numpy(dtype=np.int64).view(np.uint64)]
            v, a, b, used = done(key, fps, False)
            key, fps = key[used:], fps[used:]
            yield frame(v, a, b)
        yield frame(*done(key, fps, True)[:3])

    return sorted_variants.mapInPandas(run, "variant bigint, a bigint, b bigint")


def linked(fps: DataFrame, distance: int = 4) -> DataFrame:
    """``(fp, root)``: of each fingerprint that has a link, the smallest one that links lead to.

    ``fps`` has a column ``fp`` of distinct signed longs. Buckets of equal variants that fit are compared in
    memory and give a spanning forest instead of all pairs. The members of larger ones are first joined by the
    links between neighbours in their order; then every fingerprint outside the largest component of its bucket
    is joined with those of other components there. So a crowd of near copies costs no square of its size,
    and no link between two components is lost.
    """
    placed = variants(fps, distance).repartition("variant").sortWithinPartitions("variant", "fp")
    found = stored(bucket_links(placed, distance), "buckets")
    links = found.where("variant is null").select("a", "b")
    roots = connected_components(links)
    crowd = found.where("variant is not null").select("variant", F.col("a").alias("fp"))
    if crowd.isEmpty():
        return roots.withColumnRenamed("node", "fp")
    roots = stored(roots, "roots")
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    labels = roots.join(sizes, "root").select(F.col("node").alias("fp"), "root", "n")
    crowd = crowd.join(labels, "fp", "left").select("variant", "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("n", F.lit(1)).alias("n"))
    crowd = stored(crowd, "crowd")
    main = crowd.groupBy("variant").agg(F.max(F.struct("n", "root")).alias("top"), F.min("root").alias("low"), F.max("root").alias("high"))
    main = main.where("low != high").select("variant", F.col("top.root").alias("top"))
    mixed = crowd.join(main, "variant")
    rest = mixed.where("root != top").select("variant", F.col("fp").alias("x"), F.col("root").alias("x_root"))
    near = F.expr(f"bit_count(fp ^ x) <= {int(distance)} and root != x_root")
    across = crowd.join(rest, "variant").where(near).select(F.col("root").alias("a"), F.col("x_root").alias("b")).distinct()
    merged = connected_components(across).select(F.col("node").alias("root"), F.col("root").alias("merged"))
    nodes = roots.select(F.col("node").alias("fp"), "root")
    lone = crowd.where("n = 1").select("fp", F.col("fp").alias("root")).distinct()
    return nodes.union(lone).join(merged, "root", "left").select("fp", F.coalesce("merged", "root").alias("root"))


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """``(key, fp, component_id)``: the fingerprint of each row and the smallest key that links lead to.

    Fingerprints that differ in at most ``distance`` bits are linked; rows with equal fingerprints are one class,
    so copies are never compared. Null or blank texts have fingerprint zero and are linked like others. Rows with
    a null key keep their fingerprint and take the component of their class (null if no row there has a key).
    Repeated rows are kept; other columns of ``docs`` are ignored. An empty table gives an empty table.
    """
    rows = stored(fingerprints(docs, key, text, words), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    roots = linked(rows.select("fp").distinct(), distance)
    rooted = stored(classes.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "classes")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(ids, "root").select("fp", "n", "component_id"), "named")
    return join_named(rows, named, "fp").select(key, "fp", "component_id")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest key. All columns stay.

    Rows that repeat a key are copies and keep one. Rows without a key can't be told apart and all stay.
    """
    found = simhash_components(docs, key, text, words, distance)
    kept = found.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("__kept")).distinct()
    rows = docs.join(kept, docs[key] == kept["__kept"], "left_semi")
    return rows.dropDuplicates([key]).unionByName(docs.where(docs[key].isNull()))
