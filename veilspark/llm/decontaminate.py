"""Benchmark decontamination: passages within an edit budget of a benchmark item.

Method (q-gram lemma, as in SWIFT): text that holds an item of m characters with at most k edits shares at least
m - q + 1 - k q of its q-grams, all within k + 1 neighbouring diagonals. Shared q-grams are counted in bands of
diagonals that overlap by k; a band that meets the bound is verified by an alignment along it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import mixed

Q = 8
#: Edits per character of an item.
BUDGET = 0.1
#: Characters of items that are sent to the executors at once; more items take more passes.
BLOCK_CHARS = 2 << 20
_FILTER_BITS = 22
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def normalised(text: str | None) -> str:
    """Lower case, with one blank for any white space."""
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _grams(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    pairs = codes[:-1].astype(np.uint64) << np.uint64(32) | codes[1:]
    half = pairs[:-2] * _A + pairs[2:] * _B
    half ^= half >> np.uint64(29)
    return mixed(half[: n] * _B + half[Q - 4 :][:n] * _A) if Q == 8 else np.zeros(0, dtype=np.uint64)


class Items:
    """The q-grams of a block of items, ready to be looked up."""

    def __init__(self, ids: list, texts: list[str], budget: float = BUDGET) -> None:
        self.ids, self.texts = ids, texts
        self.codes = [_codes(t) for t in texts]
        sizes = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.edits = np.minimum(np.floor(sizes * budget).astype(np.int64), np.maximum(sizes - Q, 0) // Q)
        self.least = sizes - Q + 1 - self.edits * Q
        self.width = np.maximum(self.edits, 8)
        grams = [_grams(c) for c in self.codes]
        lengths = [len(g) for g in grams]
        keys = np.concatenate([np.zeros(0, dtype=np.uint64), *grams])
        sort = np.argsort(keys, kind="stable")
        self.keys = keys[sort]
        self.item = np.repeat(np.arange(len(texts)), lengths)[sort]
        self.place = np.concatenate([np.zeros(0, dtype=np.int64), *[np.arange(n) for n in lengths]])[sort]
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.short = [k for k, n in enumerate(sizes) if 0 < n < Q]

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Items and first diagonals of the bands that meet the bound."""
        grams = _grams(codes)
        at = np.flatnonzero(self.filter[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        low = np.searchsorted(self.keys, grams[at], side="left")
        n = np.searchsorted(self.keys, grams[at], side="right") - low
        if not n.sum():
            return
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        hit = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, diagonal = self.item[hit], np.repeat(at, n) - self.place[hit]
        width = self.width[item]
        band = diagonal // width
        # A band begins at each multiple of the width and has width + k + 1 diagonals: a hit is in one or two.
        also = diagonal - band * width <= self.edits[item]
        place = self.place[hit]
        item, band, place = np.concatenate([item, item[also]]), np.concatenate([band, band[also] - 1]), np.concatenate([place, place[also]])
        key, inverse, count = np.unique(item << 40 | (band + (1 << 39)), return_inverse=True, return_counts=True)
        near = count >= self.least[key >> 40]
        if not near.any():
            return
        # A q-gram of the item counts once, however often a repetitive text has it in the band.
        some = near[inverse]
        pairs = np.unique(inverse[some] << 32 | place[some])
        count = np.bincount(pairs >> 32, minlength=len(key))
        for k in key[count >= self.least[key >> 40]].tolist():
            item_ = k >> 40
            yield item_, ((k & (1 << 40) - 1) - (1 << 39)) * int(self.width[item_])

    def found(self, text: str | None) -> list[tuple[int, int, int]]:
        """Items in the text with their edits (the fewest) and the place behind them in the normalised text."""
        text = normalised(text)
        codes = _codes(text)
        best: dict[int, tuple[int, int]] = {}
        for item, low in self.candidates(codes):
            if best.get(item, (1,))[0] == 0:
                continue
            k = int(self.edits[item])
            edits, end = aligned(self.codes[item], codes, low, low + int(self.width[item]) + k, k)
            if edits <= k and (edits, end) < best.get(item, (k + 1, 0)):
                best[item] = edits, end
        for item in self.short:
            at = text.find(self.texts[item])
            if at >= 0:
                best[item] = 0, at + len(self.texts[item])
        return [(i, e, at) for i, (e, at) in sorted(best.items())]


def aligned(pattern: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int]:
    """Fewest edits that turn the pattern into a piece of the text along the diagonals low to high, and its end.

    An alignment that begins in the band leaves it by at most k diagonals, so this many more are followed.
    """
    m = len(pattern)
    for d in range(max(low, 0), min(high, len(text) - m) + 1):
        if text[d] == pattern[0] and np.array_equal(text[d : d + m], pattern):
            return 0, d + m
    low, high = low - k, high + k
    width = high - low + 1
    far = m + width
    step = np.arange(width)
    row = np.where((low + step >= 0) & (low + step <= len(text)), 0, far)
    padded = np.full(m + width + 1, 0xFFFFFFFF, dtype=np.uint32)
    a, b = max(low, 0), min(low + m + width, len(text))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    beside = low < 0 or low + m + width - 1 > len(text)
    for i in range(1, m + 1):
        new = row + (padded[i - 1 : i - 1 + width] != pattern[i - 1])
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        new -= step
        np.minimum.accumulate(new, out=new)
        new += step
        if beside:
            at = low + i + step
            new[(at < 0) | (at > len(text))] = far
        row = new
        if not i & 15 and row.min() > k:
            break
    at = int(np.argmin(row))
    return int(row[at]), low + m + at


def contaminations(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", budget: float = BUDGET) -> DataFrame:
    """``(key, item, edits, ends_at)``: the benchmark items that a document's whole text holds.

    An item is held if a piece of the text, lower-cased and with single blanks, is within ``budget`` edits per
    character of it (and at most (m - q) / q, so that the lemma binds; items under q characters must
    occur as they are). ``edits`` are the fewest of any place, ``ends_at`` the place behind it. Null and empty
    items are in no text, null texts hold none; rows with null or repeated keys are reported each; an item that
    is listed twice is reported twice. Nothing of the documents is shuffled. Items come from a table that is small
    beside the documents; they are sent out in blocks of about ``BLOCK_CHARS``, each in one pass over the documents.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.length(F.trim(item_text)) > 0).select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    passes = max(1, -(-int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    kinds = {n: df.schema[c].dataType.simpleString() for n, df, c in ((key, docs, key), (item, benchmark, item))}
    schema = f"`{key}` {kinds[key]}, `{item}` {kinds[item]}, edits int, ends_at bigint"
    found = None
    for n in range(passes):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == n).collect()
        held = spark.sparkContext.broadcast(([r["item"] for r in block], [normalised(r["text"]) for r in block]))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = Items(*held.value, budget)
            for batch in batches:
                rows = [(k, index.ids[i], e, at) for k, t in zip(batch["key"].astype(object), batch["text"], strict=True) for i, e, at in index.found(t)]
                if rows:
                    columns = [pd.Series(c, dtype=object) for c in zip(*rows, strict=True)]
                    yield pd.DataFrame(dict(zip((key, item, "edits", "ends_at"), columns, strict=True)))

        part = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, schema)
        found = part if found is None else found.union(part)
    return found


def _holds_none(held: Broadcast, budget: float) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Items(list(range(len(held.value))), held.value, budget)
        for part in parts:
            yield pd.Series([not index.found(t) for t in part], dtype=bool)

    return clean


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns stay. Rows without a key stay as well
    unless their own text holds one. Decided row by row, so nothing is shuffled."""
    spark = docs.sparkSession
    items = benchmark.where(F.length(F.trim(item_text)) > 0).select(F.col(item_text).alias("text")).distinct()
    passes = max(1, -(-int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    kept = docs
    for n in range(passes):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == n).collect()
        held = spark.sparkContext.broadcast([normalised(r["text"]) for r in block])

        kept = kept.where(_holds_none(held, budget)(F.col(text)))
    return kept
