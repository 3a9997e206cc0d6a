"""Near copies by the Jaccard similarity of word shingles: candidates by SimHash and by MinHash, each verified exactly.

Texts that SimHash links (``simhash.linked``) are candidates, each with the smallest of its component. SimHash misses most pairs
near the limit of similarity, so MinHash finds more (Broder; banding after Leskovec, Rajaraman and Ullman): two texts are candidates if all ``ROWS`` minima of one of
``BANDS`` bands agree. A pair of similarity 0.8 is missed with probability (1 - 0.8**5)**28, under 2 in 100,000.
A candidate is a link only if the whole shingle sets have the similarity.

In a bucket each class is first compared with one other. Buckets that this leaves in several components are searched by
prefix filtering (Chaudhuri, Ganti and Kaushik): of two sets of the similarity each holds, among its rarest
``(1 - s) n + 1`` shingles, one that the other holds there too. So pages of one template, which meet in all buckets and
are no copies, are told apart by their rare shingles and not pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import LOWER, as_bytes, fresh_name, gram_hashes, join_named, mixed, stored, word_hashes
from veilspark.llm.components import connected_components
from veilspark.llm.simhash import fingerprint, linked

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 5
#: Differing bits up to which two SimHash fingerprints are linked.
DISTANCE = 4
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_BAND_FACTORS = mixed(np.arange(1001, 1001 + ROWS, dtype=np.uint64)) | np.uint64(1)
_BAND_SEEDS = mixed(np.arange(2001, 2001 + BANDS, dtype=np.uint64))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted set of hashes of a text's shingles; a shorter text is one shingle, a blank one the shingle zero."""
    hashes = word_hashes(LOWER[as_bytes(text)])
    if not len(hashes):
        return np.zeros(1, dtype=np.uint64)
    return np.unique(gram_hashes(hashes, min(words, len(hashes))))


def bands(found: np.ndarray) -> np.ndarray:
    """One hash for each band of minima."""
    low = np.array([(found * f).min() for f in _FACTORS], dtype=np.uint64)
    return mixed((mixed(low).reshape(BANDS, ROWS) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64) ^ _BAND_SEEDS)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sets have the similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: the pairs of classes whose shingle sets have the similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sound = [similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), similarity) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.loc[np.array(sound, dtype=bool), ["a", "b"]]

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return stored(both.mapInPandas(run, "a bigint, b bigint"), "links")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, data in enumerate(batch.column("set").to_pylist()):
            found = np.frombuffer(data, dtype=np.int64)
            one = [np.full(len(found), batch.column(c)[k].as_py(), dtype=np.int64) for c in ("class", "root", "n")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, one), pa.array(found), pa.array(np.full(len(found), len(found), dtype=np.int32))], ["class", "root", "n", "shingle", "size"])


def rare_pairs(crowd: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(a, b)``: every pair of classes ``(class, root, n)`` of different roots that can have the similarity, and few others.

    ``n`` is the number of classes of the root. Shingles are counted over the crowd alone, where the text that all share is frequent, whatever it is elsewhere.
    Shingles of one class join nothing, and sizes are compared before a pair is made.
    """
    rows = sets.join(crowd, "class").select("class", "root", "n", "set").mapInArrow(_shingle_rows, "class bigint, root bigint, n bigint, shingle bigint, size int")
    rows = stored(rows, "shingles")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("f")).where("f > 1")
    order = Window.partitionBy("class").orderBy(F.asc_nulls_first("f"), "shingle")
    need = F.ceil(F.lit(similarity) * F.col("size") - 1e-9)
    ranked = rows.join(shared, "shingle", "left").withColumn("nth", F.row_number().over(order))
    prefix = stored(ranked.where((F.col("nth") <= F.col("size") - need + 1) & F.col("f").isNotNull()).select("class", "root", "n", "shingle", "size"), "prefix")
    # Of a shingle's classes those outside its largest component are joined with all of other components.
    split = prefix.groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("top"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    mixed_up = prefix.join(split.select("shingle", F.col("top.root").alias("top")), "shingle")
    rest = mixed_up.where("root != top").select("shingle", F.col("class").alias("x"), F.col("root").alias("x_root"), F.col("size").alias("x_size"))
    fits = F.expr(f"least(size, x_size) >= {similarity} * greatest(size, x_size) - 1e-9 and root != x_root")
    return mixed_up.join(rest, "shingle").where(fits).select(F.least("class", "x").alias("a"), F.greatest("class", "x").alias("b")).distinct()


def simhash_pairs(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(a, b)`` for ``(class, fp)``: the smallest class of each component of linked fingerprints with every other one there."""
    roots = linked(prints.select("fp").distinct(), distance)
    grouped = stored(prints.join(roots, "fp", "left").select("class", F.coalesce("root", "fp").alias("group")).distinct(), "groups")
    least = grouped.groupBy("group").agg(F.min("class").alias("a"), F.count("*").alias("n")).where("n > 1").select("group", "a")
    return grouped.join(least, "group").where("class != a").select("a", F.col("class").alias("b")).distinct()


def _rooted(docs: DataFrame, key: str, text: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows ``(row, class)``, and classes ``(class, n, first, component)``: see :func:`near_components`."""
    kind = docs.schema[key].dataType.simpleString()

    def told(t: str | None) -> tuple[int, np.ndarray, int]:
        """The class of a text, its bands and its fingerprint; its shingles aren't held."""
        found = shingles(t, words)
        whole = int(mixed(found).sum(dtype=np.uint64) ^ np.uint64(len(found)))
        signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
        return signed(whole), bands(found).view(np.int64), signed(fingerprint(t))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [told(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([c for c, _, _ in rows], pa.int64()), pa.array([b for _, b, _ in rows], pa.list_(pa.int64())), pa.array([f for _, _, f in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), *columns], ["row", "key", "class", "bands", "fp"])

    named = docs.select(F.xxhash64(key, text).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    rows = stored(named.mapInArrow(cut, f"row bigint, key {kind}, class bigint, bands array<bigint>, fp bigint"), "rows")
    first = F.struct(F.col("key").isNull().alias("last"), "key", "row")
    classes = stored(rows.groupBy("class").agg(F.min(first).alias("first"), F.first("bands").alias("bands"), F.count("*").alias("n")), "classes")
    placed = classes.select("class", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("a")).where("n > 1").select("bucket", "a")
    members = stored(placed.join(stored(shared, "shared"), "bucket"), "members")
    alike = stored(simhash_pairs(rows.select("class", "fp").distinct()), "alike")
    # The shingle sets of the classes that have a candidate, each from its first row.
    wanted = members.select("class").union(alike.select("a")).union(alike.select("b")).distinct().join(classes, "class").select("class", F.col("first.row").alias("row"))

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).tobytes() for t in texts], dtype=object)

    once = named.select("row", "text").join(stored(wanted, "wanted"), "row").dropDuplicates(["class"])
    sets = stored(once.select("class", packed("text").alias("set")), "sets")

    pairs = members.where("class != a").select("a", F.col("class").alias("b")).union(alike).distinct()
    links = _links(pairs, sets, similarity)
    roots = stored(connected_components(links), "roots")
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    labels = roots.join(sizes, "root").select(F.col("node").alias("class"), "root", "n")
    crowd = members.select("bucket", "class").join(labels, "class", "left").select("bucket", "class", F.coalesce("root", "class").alias("root"), F.coalesce("n", F.lit(1)).alias("n"))
    crowd = stored(crowd, "crowd")
    split = crowd.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket")
    apart = stored(crowd.join(split, "bucket", "left_semi").select("class", "root", "n").distinct(), "apart")
    # A pair with the smallest of a bucket that has no link yet was compared before.
    more = _links(rare_pairs(apart, sets, similarity).join(pairs, ["a", "b"], "left_anti"), sets, similarity)
    roots = stored(connected_components(links.union(more)), "roots")
    rooted = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "n", "first", F.coalesce("root", "class").alias("component"))
    return rows.select("row", "class"), stored(rooted, "rooted")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``(row, class, component, first)``: of each row the component that links lead to, and the first row of it.

    ``row`` is the hash of key and text. Rows with equal shingle sets are one class and are never compared. No link between
    components of a bucket is lost, and none is made all pairs of. Null, empty and blank texts are one class, told by no
    shingle; texts shorter than a shingle are one shingle. Keys may be null or repeated, other columns have any name,
    texts any length; an empty table gives no rows.
    """
    rows, rooted = _rooted(docs, key, text, words, similarity)
    firsts = rooted.groupBy("component").agg(F.min("first").alias("first"))
    named = stored(rooted.select("class", "n", "component").join(firsts, "component").select("class", "n", "component", F.col("first.row").alias("first")), "named")
    return join_named(rows, named, "class").select("row", "class", "component", "first")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest key (nulls last), then of the smallest hash. All columns stay.

    A row is told by key and text: rows that share only their key are different documents. All null and blank texts are
    copies of each other. An empty table gives an empty one; columns may have any name, texts any length.
    """
    row = fresh_name("__row", docs)
    _, rooted = _rooted(docs, key, text, words, similarity)
    kept = rooted.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    rows = docs.withColumn(row, F.xxhash64(key, text)).join(kept, row, "left_semi")
    return rows.dropDuplicates([row]).select(docs.columns)
