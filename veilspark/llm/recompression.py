"""Repeated windows of words, found by recompression and removed from all their places.

Method (recompression after Jez): in each round runs of one symbol get one name, then neighbours of which the first is
on the left side of a split of all names and the second on the right one. A name is computed from the names below it, so
that it is the same in all tasks. Each symbol knows its context: the words that its name and borders depend on.
Equal windows that hold a symbol's context hold the same symbol at the same place.

Spark counts the names over all documents. A name that occurs once rules out all windows that hold its context; what is
left are windows of shared symbols alone. These are verified: the windows' own hashes of 128 bits are counted,
and those that occur twice are removed. Errors of 64-bit names could only leave more to verify.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import as_bytes, byte_hashes, gram_hashes, mixed, stored, word_bounds

#: Words of a window, and rounds of naming: a symbol of round 6 is 5.6 words long and has a context of 17, at the median.
WINDOW, ROUNDS = 35, 6
#: Words of a text that are named at once; parts overlap by a window, so that every window is in one.
PART = 1 << 18
#: Bytes of short texts that are named together.
_TOGETHER = 1 << 21
_FAR = 1 << 40
_PAIR, _RUN = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)
_OTHER = np.uint64(0x1D8E4E27C47D124F)


class Symbols:
    """Symbols over ``words`` (hashes) of several parts: names, word ranges ``[start, end)`` and contexts ``[low, high)``."""

    def __init__(self, words: np.ndarray, part: np.ndarray) -> None:
        self.words = words
        at = np.arange(len(words), dtype=np.int64)
        self.name, self.part, self.start, self.end, self.low, self.high = words, part, at, at + 1, at, at + 1

    def _depend(self, low: np.ndarray, high: np.ndarray, which: np.ndarray, edge: np.ndarray, step: int) -> None:
        """The contexts ``which`` take in that of the symbol beside ``edge``; without one in the part they have no end."""
        near = edge + step
        inside = (near >= 0) & (near < len(self.part))
        to = np.where(inside, near, edge)
        inside &= self.part[to] == self.part[edge]
        low[which] = np.where(inside, np.minimum(low[which], self.low[to]), -_FAR)
        high[which] = np.where(inside, np.maximum(high[which], self.high[to]), _FAR)

    def name_runs(self) -> None:
        """Maximal runs of one symbol become one. Their borders depend on the next word, if it shows that a run ends there."""
        n = len(self.name)
        first = np.ones(n, dtype=bool)
        first[1:] = (self.name[1:] != self.name[:-1]) | (self.part[1:] != self.part[:-1])
        at = np.flatnonzero(first)
        size = np.diff(at, append=n)
        last = at + size - 1
        low, high = np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at)
        every = np.arange(len(at))
        # The word behind a run is not the one that its symbol begins with: no further symbol of the run.
        there = np.zeros(len(at), dtype=bool)
        there[:-1] = self.part[at[1:]] == self.part[at[:-1]]
        other = there.copy()
        other[:-1] &= self.words[self.start[at[1:]]] != self.words[self.start[at[:-1]]]
        high = np.where(other, np.maximum(high, self.end[last] + 1), high)
        self._depend(low, high, every[~other], last[~other], 1)
        there = np.zeros(len(at), dtype=bool)
        there[1:] = self.part[at[1:]] == self.part[at[:-1]]
        other = there.copy()
        other[1:] &= self.words[self.end[last[:-1]] - 1] != self.words[self.end[at[1:]] - 1]
        low = np.where(other, np.minimum(low, self.start[at] - 1), low)
        self._depend(low, high, every[~other], at[~other], -1)
        name = self.name[at]
        name = np.where(size > 1, mixed(name * _RUN + size.astype(np.uint64)), name)
        self.name, self.part, self.start, self.end, self.low, self.high = name, self.part[at], self.start[at], self.end[last], low, high

    def name_pairs(self, turn: int) -> None:
        """A left symbol and a right one behind it become one. One that stays alone depends on the neighbour it could have had."""
        left = mixed(self.name + np.uint64(turn)) >> np.uint64(63) == 1
        opens = np.zeros(len(left), dtype=bool)
        opens[:-1] = left[:-1] & ~left[1:] & (self.part[1:] == self.part[:-1])
        closes = np.zeros(len(left), dtype=bool)
        closes[1:] = opens[:-1]
        low, high = self.low.copy(), self.high.copy()
        alone = ~opens & ~closes
        for side, step in ((left, 1), (~left, -1)):
            which = np.flatnonzero(alone & side)
            self._depend(low, high, which, which, step)
        pair = np.flatnonzero(opens)
        name, end = self.name.copy(), self.end.copy()
        name[pair] = mixed(self.name[pair] * _PAIR + mixed(self.name[pair + 1]))
        end[pair] = self.end[pair + 1]
        low[pair], high[pair] = np.minimum(self.low[pair], self.low[pair + 1]), np.maximum(self.high[pair], self.high[pair + 1])
        stay = ~closes
        self.name, self.part, self.start, self.end, self.low, self.high = name[stay], self.part[stay], self.start[stay], end[stay], low[stay], high[stay]


def symbols(words: np.ndarray, part: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    """The symbols of the last round."""
    found = Symbols(words, part)
    for turn in range(rounds if len(words) else 0):
        found.name_runs()
        found.name_pairs(turn)
    return found


def _hashed(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Word hashes of each text; short texts are hashed together."""
    out, held, size = [], [], 0

    def flush() -> Iterator[np.ndarray]:
        joined = np.concatenate([x for t in held for x in (t, _BREAK)])
        starts, ends = word_bounds(joined)
        hashes = byte_hashes(joined, starts, ends)
        stops = np.cumsum([len(t) + 1 for t in held])
        yield from np.split(hashes, np.searchsorted(starts, stops[:-1]))

    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= _TOGETHER:
            out.extend(flush())
            held, size = [], 0
    return [*out, *flush()] if held else out


_BREAK = np.array([0x20], dtype=np.uint8)


def _parts(hashes: list[np.ndarray], window: int, size: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Groups of parts ``(text, first word, words)`` with ``size`` words or a little more each."""
    held, n = [], 0
    for k, words in enumerate(hashes):
        for at in range(0, max(len(words) - window + 1, 0), size):
            part = words[at : at + size + window - 1]
            held.append((k, at, part))
            n += len(part)
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def _named(hashes: list[np.ndarray], window: int, rounds: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(name, text, context)`` of the symbols whose context is in a window: each once, though parts overlap."""
    for group in _parts(hashes, window, size):
        lengths = np.array([len(w) for _, _, w in group])
        part = np.repeat(np.arange(len(group)), lengths)
        found = symbols(np.concatenate([w for _, _, w in group]), part, rounds)
        base = (np.cumsum(lengths) - lengths)[found.part]
        low = found.low - base
        fit = np.flatnonzero((found.high - found.low <= window) & (low < size))
        text = np.array([k for k, _, _ in group])[found.part[fit]]
        first = np.array([a for _, a, _ in group])[found.part[fit]]
        yield found.name[fit], text, (low[fit] + first) << 6 | (found.high - found.low)[fit]


def live_windows(n: int, dead: np.ndarray, window: int) -> np.ndarray:
    """Which windows of a text of n words hold none of the contexts ``dead``, each ``first word << 6 | words``."""
    starts = max(n - window + 1, 0)
    change = np.zeros(starts + 1, dtype=np.int64)
    if starts:
        low, size = dead >> 6, dead & 63
        np.add.at(change, np.maximum(low + size - window, 0), 1)
        np.add.at(change, np.minimum(low + 1, starts), -1)
    return np.cumsum(change[:starts]) == 0


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edges[::2].astype(np.int32), edges[1::2].astype(np.int32)


def _flags(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, np.asarray(starts, dtype=np.int64), 1)
    np.add.at(change, np.asarray(stops, dtype=np.int64), -1)
    return np.cumsum(change[:n]) > 0


def _alone(rows: DataFrame, by: list[str]) -> DataFrame:
    """``(row, places)``: of each text the places whose name occurs once. Counted before the shuffle; no name is gathered."""
    once = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("at").alias("at")).where("n = 1")
    return once.groupBy("row").agg(F.collect_list("at").alias("places"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS, part: int = PART) -> DataFrame:
    """``(key, n_words, n_removed, kept)``: each text without the words of windows that start anywhere else as well.

    A window is ``window`` (at most 60) consecutive words of one text, compared as they are; words are separated by ASCII white space.
    All its places lose it, the first included, overlapping ones of the same text too; windows are judged
    on the input. ``kept`` are the words left, joined by one space.

    One row per row of ``docs``: rows that repeat key and text are documents of their own, whose windows so occur
    twice. A null, empty or shorter text keeps all its words (``kept`` is then empty or its words). Keys may be null or
    repeated; other columns are ignored, whatever their names; an empty table gives no rows. Long texts are named in parts of ``part`` words.
    A text of which some window is left to verify moves twice, others once.
    """
    if not 1 < window <= 60:
        raise ValueError("window is 2 to 60")
    kind = docs.schema[key].dataType.simpleString()

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            row = batch["row"].to_numpy()
            hashes = _hashed([as_bytes(t) for t in batch["text"]])
            for names, texts, places in _named(hashes, window, rounds, part):
                yield pd.DataFrame({"name": names.view(np.int64), "row": row[texts], "at": places})

    rows = docs.select(F.xxhash64(key, text).alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = rows.select("row", "text").mapInPandas(name, "name bigint, row bigint, at bigint")
    dead = stored(_alone(names, ["name"]), "dead")

    @F.pandas_udf("n bigint, starts array<int>, stops array<int>")
    def live(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        sizes, found = [], []
        for t, p in zip(texts, places, strict=True):
            n = len(word_bounds(as_bytes(t))[0])
            sizes.append(n)
            found.append(_ranges(live_windows(n, np.asarray(p if p is not None else [], dtype=np.int64), window)))
        return pd.DataFrame({"n": sizes, "starts": pd.Series([a for a, _ in found], dtype=object), "stops": pd.Series([b for _, b in found], dtype=object)})

    held = rows.join(dead, "row", "left").withColumn("live", live("text", "places")).select("row", "key", "text", "live.n", "live.starts", "live.stops")
    held = stored(held, "held")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = _hashed([as_bytes(t) for t in batch["text"]])
            for row, words, starts, stops in zip(batch["row"], hashes, batch["starts"], batch["stops"], strict=True):
                at = np.flatnonzero(_flags(max(len(words) - window + 1, 0), starts, stops))
                one, two = gram_hashes(words, window), gram_hashes(words ^ _OTHER, window)
                yield pd.DataFrame({"one": one[at].view(np.int64), "two": two[at].view(np.int64), "row": row, "at": at.astype(np.int64)})

    open_ = held.where(F.size("starts") > 0)
    windows = open_.select("row", "text", "starts", "stops").mapInPandas(verify, "one bigint, two bigint, row bigint, at bigint")
    single = _alone(windows, ["one", "two"])
    schema = f"`{key}` {kind}, n_words bigint, n_removed bigint, kept string"
    columns = ["key", "text", "n", "starts", "stops", "places"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept = [], []
            for t, n, starts, stops, places in zip(*(batch.column(c).to_pylist() for c in columns[1:]), strict=True):
                words = t.encode("utf-8", "surrogatepass").split()
                if starts:
                    flags = _flags(max(n - window + 1, 0), starts, stops)
                    flags[np.asarray(places or [], dtype=np.int64)] = False
                    at = np.flatnonzero(flags)
                    words = list(compress(words, (~_flags(n, at, at + window)).tolist()))
                gone.append(n - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [key, "n_words", "n_removed", "kept"])

    closed = held.where(F.size("starts") == 0).withColumn("places", F.lit(None).cast("array<bigint>")).select(columns)
    return closed.unionByName(open_.join(single, "row", "left").select(columns)).mapInArrow(keep, schema)
