"""Periodic runs: stretches of words that repeat with a period, and texts with each run cut to its first period.

Method: recursive frequency splitting. In a run of at least two periods every word occurs twice, so a word that
occurs once in its segment is in no run: it splits the segment. Words get rarer in the pieces, which are split again
until nothing changes. Surviving segments are scanned by lags. Short lags are compared word by word. A longer lag is
looked at where a gram of the segment occurs again at this distance: a run of a period in (K, 2K] holds an aligned gram
of K / 2 words that does, so no run is missed, and there are at most two such places a word for each K.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the shortest run.
LEAST = 12
#: Lags up to this one are compared word by word; a power of two.
DIRECT = 16
#: Splitting only narrows the search: after so many rounds a segment is scanned as it is.
ROUNDS = 64
_BLOCK = 1 << 20
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def word_numbers(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    """The text's words as numbers, and the word of each number. Blocks keep few words of a long text at once."""
    data, numbers, parts, at = (text or "").encode("utf-8", "surrogatepass"), _Numbers(), [np.zeros(0, dtype=np.int32)], 0
    while at < len(data):
        space = _SPACE.search(data, at + _BLOCK)
        end = space.end() if space else len(data)
        parts.append(np.fromiter(map(numbers.__getitem__, data[at:end].split()), dtype=np.int32))
        at = end
    return np.concatenate(parts), list(numbers)


def segments(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """The stretches of at least ``least`` words in which each word occurs twice, by splitting to stability."""
    at = np.arange(len(ids))
    segment = np.zeros(len(ids), dtype=np.int64)
    width = int(ids.max(initial=0)) + 1
    for _ in range(ROUNDS):
        if not len(at):
            break
        _, which, counts = np.unique(segment * width + ids[at], return_inverse=True, return_counts=True)
        often = counts[which] > 1
        before = len(at)
        # A gap, or another segment, starts a new one; short ones go.
        at, segment = at[often], segment[often]
        starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        starts = np.union1d(starts, np.flatnonzero(np.diff(segment, prepend=-1)))
        sizes = np.diff(starts, append=len(at))
        number = np.repeat(np.arange(len(starts)), sizes)
        long = sizes[number] >= least
        at, segment = at[long], number[long]
        if len(at) == before:
            break
    cuts = np.flatnonzero(np.diff(segment, prepend=-1))
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(cuts, np.append(cuts[1:], len(at)), strict=False)]


def _short_lags(part: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    for lag in range(1, min(DIRECT, len(part) // 2) + 1):
        same = np.zeros(len(part) - lag + 2, dtype=np.int8)
        same[1:-1] = part[lag:] == part[:-lag]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= max(lag, least - lag):
                yield a, b - a + lag, lag


def _names(part: np.ndarray) -> list[np.ndarray]:
    """Exact names of all grams of 1, 2, 4, ... words, up to the size at which all differ."""
    levels = [np.unique(part, return_inverse=True)[1]]
    size = 1
    while 2 * size <= len(part) and int(levels[-1].max()) + 1 < len(levels[-1]):
        low = levels[-1].astype(np.int64)
        pairs = low[:-size] * (int(low.max()) + 1) + low[size:]
        levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
        size *= 2
    return levels


def _extended(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and from the places x and y (x < y) are equal."""
    right, left = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        names, size = levels[level], 1 << level
        # The largest size that still has equal names can fit more than once.
        while True:
            fits = np.flatnonzero(y + right + size <= n)
            more = fits[names[x[fits] + right[fits]] == names[y[fits] + right[fits]]]
            right[more] += size
            back = np.flatnonzero(x - left >= size)
            less = back[names[x[back] - left[back] - size] == names[y[back] - left[back] - size]]
            left[less] += size
            if level < len(levels) - 1 or not len(more) and not len(less):
                break
    return left, right


def _long_lags(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    n = len(part)
    levels = _names(part)
    k = DIRECT
    while k < n // 2 and k.bit_length() - 2 < len(levels):
        # Lags in (k, 2k], by grams of k / 2 words at multiples of that.
        gram = k // 2
        names = levels[gram.bit_length() - 1].astype(np.int64)
        keys = np.sort(names * (n + 1) + np.arange(len(names)))
        anchors = np.arange(0, len(names), gram)
        base = names[anchors] * (n + 1) + anchors
        low, high = np.searchsorted(keys, base + k + 1), np.searchsorted(keys, base + 2 * k, side="right")
        # Keys of the next name can be within reach: those are no equal grams.
        high = np.minimum(high, np.searchsorted(keys, (names[anchors] + 1) * (n + 1)))
        found = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(anchors)), found)
        at = np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found) + low[which]
        x, y = anchors[which], keys[at] % (n + 1)
        left, right = _extended(levels, x, y, n)
        lag = y - x
        sound = left + right >= lag
        if sound.any():
            rows = np.unique(np.stack([(x - left)[sound], (left + right + lag)[sound], lag[sound]], axis=1), axis=0)
            yield from map(tuple, rows.tolist())
        k *= 2


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` by start and period: maximal stretches of at least two periods and ``least`` words."""
    found: dict[tuple[int, int], int] = {}
    for a, b in segments(ids, least):
        part = ids[a:b]
        lags = [_short_lags(part, least)] + ([_long_lags(part)] if len(part) > 2 * DIRECT else [])
        for start, length, lag in (run for some in lags for run in some):
            if length >= max(least, 2 * lag):
                # The same stretch with a multiple of its period is found there too: the smallest counts.
                stretch = (a + start, length)
                found[stretch] = min(lag, found.get(stretch, lag))
    return sorted((start, length, lag) for (start, length), lag in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if each run keeps its first period only."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, edit: Callable[[object, np.ndarray], np.ndarray] | None = None
) -> DataFrame:
    """``(key, n_words, runs, collapsed)``: the runs of each text by start and period, and the text without repeats.

    Words are separated by ASCII white space and compared as they are. A run is a maximal stretch of words that repeats
    with its smallest period, at least twice and over ``least`` words or more. ``collapsed`` are the words that no run
    holds behind its first period, joined by one space. ``edit`` may change the word numbers of a row before.

    One row per row of ``docs``, nothing is shuffled. A null or empty text has no words, no runs and an empty
    ``collapsed``; keys may be null or repeated; other columns are ignored, whatever their names; an empty table gives no
    rows. Time is near linear in the length of a text, memory some 100 bytes a word in its longest segment.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, left = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, words = word_numbers(t)
                if edit is not None:
                    ids = edit(k, ids)
                runs = runs_of(ids, least)
                sizes.append(len(ids))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                stay = ids[kept_words(len(ids), runs)] if runs else ids
                left.append(b" ".join(map(words.__getitem__, stay.tolist())).decode("utf-8", "surrogatepass"))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, _RUNS), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_words", "runs", "collapsed"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
