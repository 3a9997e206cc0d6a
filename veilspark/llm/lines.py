"""Line dedup: later repeats of passages are deleted, within and across documents.

Method (winnowing after Schleimer, Wilkerson and Aiken): the units are words; in scripts without blanks, characters.
Each run of ``UNITS`` units has a fingerprint, the least hash of its unit grams, which equal runs share for certain.
Runs around one fingerprint make a segment: from where it is the least to where a smaller one comes into reach. Only
fingerprints that occur twice lead on; their positions are joined by segment. Inside a match, however long, segments are
equal: a later one goes whole and costs one row. At the two ends of a match a fingerprint has segments of different
kinds; there the match is extended both ways unit by unit, by comparing the runs of the first segment of each kind.
Of equal runs the first stays and the later ones are marked; marked units that together have enough words are deleted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import BLOCK, IS_SPACE, LOWER, as_bytes, byte_hashes, fresh_name, gram_hashes, mixed, stored, word_bounds
from veilspark.llm.sharding import numbered

#: Units of a compared run, units of a gram, and grams of a window: UNITS = GRAM + WINDOW - 1.
UNITS, GRAM = 40, 10
WINDOW = UNITS - GRAM + 1
#: Bits for the place in a text, below the document's number in a place of the corpus.
AT_BITS = 28
#: Words that a repeated run has at least to be deleted.
MIN_WORDS = 40
#: Lengths of the characters that are units of their own, by their first two bytes: Thai, Lao, Burmese, Khmer, kana and Han.
_OWN = np.zeros((256, 256), dtype=np.uint8)
_OWN[0xE0, 0xB8:0xBC] = _OWN[0xE1, 0x80:0x83] = _OWN[0xE1, 0x9E:0xA0] = _OWN[0xE2, 0xBA:0xC0] = _OWN[0xE3:0xEA] = _OWN[0xEF, 0xA4:0xAC] = _OWN[0xEF, 0xBC:0xC0] = 3
_OWN[0xF0, 0xA0:0xB4] = 4


def unit_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, cut around each character of a script without blanks."""
    starts, ends = word_bounds(data)
    cuts = []
    for low in range(0, len(data) - 1, BLOCK):
        part = data[low : low + BLOCK + 1]
        sizes = _OWN[part[:-1], part[1:]] if part.max() >= 0xE0 else np.zeros(0, dtype=np.uint8)
        at = np.flatnonzero(sizes)
        cuts += [low + at, low + at + sizes[at]]
    cuts = np.unique(np.concatenate(cuts)) if cuts else np.zeros(0, dtype=np.int64)
    if not len(cuts):
        return starts, ends
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[~IS_SPACE[data[cuts - 1]] & ~IS_SPACE[data[cuts]]]
    return np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))


class Units:
    """Units of one or several texts: hashes, byte places, and which text each belongs to. The texts stand in ``data`` with a blank behind each."""

    def __init__(self, *texts: str | None) -> None:
        parts = [as_bytes(t) for t in texts]
        self.data = np.concatenate([x for p in parts for x in (p, _BLANK)]) if len(parts) > 1 else parts[0]
        low = LOWER[self.data]
        self.starts, self.ends = unit_bounds(low)
        self.hashes = byte_hashes(low, self.starts, self.ends)
        #: The first byte of each text; the first unit of each, and the end of the last.
        self.at = np.cumsum([0, *[len(p) + 1 for p in parts[:-1]]])
        self.bounds = np.append(np.searchsorted(self.starts, self.at), len(self.starts))

    def reach(self, text: int) -> tuple[int, int]:
        """The bytes of a text."""
        return int(self.at[text]), int(self.at[text + 1]) - 1 if text + 1 < len(self.at) else len(self.data) - (len(self.at) > 1)


_BLANK = np.array([0x20], dtype=np.uint8)


def together(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about a block: short texts are cut at once."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "") + 1
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Where the minimum of each window of n values stands: the first place of equal ones."""
    at, size = np.arange(len(x)), 1
    while size < n:
        step = min(size, n - size)
        smaller = x[step:] < x[:-step]
        at = np.where(smaller, at[step:], at[:-step])
        x = np.where(smaller, x[step:], x[:-step])
        size += step
    return at


class Segments:
    """The runs of ``UNITS`` units of texts, by their fingerprints: ``runs[start:stop]`` have the one at ``prints``.

    A run is told by its first unit; ``bounds`` are the first units of the texts, a run lies in one.
    """

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray | None = None) -> None:
        self.bounds = np.array([0, len(hashes)]) if bounds is None else bounds
        self.runs = gram_hashes(hashes, UNITS)
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        place = np.flatnonzero(text[: len(self.runs)] == text[UNITS - 1 :])
        grams = gram_hashes(hashes, GRAM)
        least = _least(grams, WINDOW)[place] if len(place) else place
        edge = np.flatnonzero(np.diff(least, prepend=-1))
        self.start, self.at = place[edge], least[edge]
        self.stop = place[np.append(edge[1:], len(place))[: len(edge)] - 1] + 1
        self.prints = grams[self.at]
        # The first and the last run of a segment overlap: with their distance they tell all of it.
        reach = (self.stop - self.start).astype(np.uint64)
        self.kinds = mixed(mixed(self.runs[self.start] + reach) + self.runs[self.stop - 1])
        #: The first segment of each text, and the end of the last.
        self.of = np.searchsorted(self.start, self.bounds)

    def flags(self, text: int, starts: list[int]) -> np.ndarray:
        """The runs of the segments of a text that start there, counted from the text's first unit."""
        low, high = int(self.bounds[text]), int(self.bounds[text + 1])
        which = np.searchsorted(self.start, np.asarray(starts, dtype=np.int64) + low)
        change = np.zeros(high - low + 1, dtype=np.int64)
        np.add.at(change, self.start[which] - low, 1)
        np.add.at(change, self.stop[which] - low, -1)
        return np.cumsum(change[:-1]) > 0


def fingerprints(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the grams that are the minimum of some window."""
    found = Segments(hashes)
    return found.prints, found.at


def later_runs(found: Segments, text: int, later: list[int], open_: list[int], first: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's runs that occurred before, and where in the same text the first of each stands, or -1.

    ``later`` and ``open_`` are starts of segments: of the former all runs occurred before, of the latter all but ``first``.
    """
    gone = found.flags(text, open_)
    gone[np.asarray(first, dtype=np.int64)] = False
    gone |= found.flags(text, later)
    at = np.flatnonzero(gone)
    low = int(found.bounds[text])
    runs = found.runs[low : low + len(gone)]
    # The earliest equal run of the text is the first of all if it occurred nowhere before.
    _, early, which = np.unique(runs, return_index=True, return_inverse=True)
    if len(early) == len(runs):
        return at, np.full(len(at), -1, dtype=np.int64)
    own = early[which[at]]
    return at, np.where(gone[own], -1, own)


def remaining(units: Units, found: Segments, text: int, later: list[int], open_: list[int], first: list[int], min_words: int = MIN_WORDS) -> tuple[str | None, int]:
    """A text without its repeated runs (:func:`later_runs`), and how many words went.

    Units that belong to the earlier of two overlapping runs stay. The wider of the gaps around a deleted run is kept.
    """
    places, own = later_runs(found, text, later, open_, first)
    low, high = int(units.bounds[text]), int(units.bounds[text + 1])
    starts, ends = units.starts[low:high], units.ends[low:high]
    if not len(starts) or not len(places):
        return None, 0
    change = np.zeros(high - low + 1, dtype=np.int64)
    np.add.at(change, np.where(own >= 0, np.maximum(places, own + UNITS), places), 1)
    np.add.at(change, places + UNITS, -1)
    gone = np.cumsum(change) > 0
    gone[-1] = False
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
    base, top = units.reach(text)
    data, parts, at, words = units.data[base:top].tobytes(), [], 0, 0
    starts, ends = starts - base, ends - base
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        n = b - a
        if n < min_words:
            continue
        words += n
        before_at = int(ends[a - 1]) if a else 0
        before = data[before_at : int(starts[a])]
        end = int(ends[b - 1])
        after = data[end : int(starts[b])] if b < len(starts) else data[end:]
        parts.append(data[at:before_at])
        if b < len(starts):
            parts.append(before if before.count(b"\n") >= after.count(b"\n") and a else after if a else b"")
        at = int(starts[b]) if b < len(starts) else len(data)
    parts.append(data[at:])
    return (b"".join(parts).decode("utf-8", "surrogatepass"), words) if words else (None, 0)


def marked_segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, number, later, open)`` for each text with runs that occurred before, or that have to be compared (:func:`later_runs`).

    ``row`` is the hash of key and text. Order is by key (nulls first), then by place. Rows that repeat key
    and text are one document. Null and empty texts have no runs.
    """
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in together(t.as_py() for t in batch.column("text")):
                units = Units(*texts)
                found = Segments(units.hashes, units.bounds)
                sizes = np.diff(found.of)
                own = batch.slice(done, len(texts)).select(["row", "key"]).take(pa.array(np.repeat(np.arange(len(texts)), sizes)))
                at = found.start - np.repeat(units.bounds[:-1], sizes)
                numbers = [pa.array(x) for x in (found.prints.view(np.int64), found.kinds.view(np.int64), at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*own.columns, *numbers], ["row", "key", "print", "kind", "at"])
                done += len(texts)

    rows = docs.select(F.xxhash64(key, text).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    anchors = stored(rows.mapInArrow(cut, f"row bigint, key {kind}, print bigint, kind bigint, at int"), "anchors")
    counts = anchors.groupBy("print").agg(F.count("*").alias("n"), (F.min("kind") != F.max("kind")).alias("open"))
    # Stored, so that the next join reads two plain exchanges and a frequent gram can be split between tasks.
    twice = stored(counts.where("n > 1").select("print", "open"), "prints")
    hits = stored(anchors.join(twice, "print").select("row", "key", "kind", "at", "open"), "hits")
    number, _ = numbered(hits.select("row", "key").distinct(), ["key", "row"], "number")
    place = F.shiftleft("number", AT_BITS) + F.col("at")
    placed = stored(hits.join(number.select("row", "number"), "row").select("row", "number", "kind", "at", "open", place.alias("place")), "placed")
    firsts = placed.groupBy("kind").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("stays"))
    stays = F.coalesce("stays", F.lit(False))
    told = placed.join(firsts, "place", "left").where(~stays | F.col("open"))
    some = lambda flag: F.collect_set(F.when(flag, F.col("at")))
    return stored(told.groupBy("row", "number").agg(some(~stays).alias("later"), some(stays).alias("open")), "marks")


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(text, number, open)`` to the runs of open segments: ``(run, place)``."""
    for batch in batches:
        numbers, opens, done = batch.column("number").to_pylist(), batch.column("open").to_pylist(), 0
        for texts in together(t.as_py() for t in batch.column("text")):
            units = Units(*texts)
            found = Segments(units.hashes, units.bounds)
            runs, places = [], []
            for k in range(len(texts)):
                at = np.flatnonzero(found.flags(k, opens[done + k]))
                runs.append(found.runs[at + units.bounds[k]])
                places.append((numbers[done + k] << AT_BITS) + at)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(runs).view(np.int64)), pa.array(np.concatenate(places))], ["run", "place"])
            done += len(texts)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, removed: str | None = None) -> DataFrame:
    """``docs`` with later repeats of runs of at least ``min_words`` words deleted from the texts.

    A run of ``UNITS`` words or more that occurred earlier (in a smaller key, or before in the same text) goes,
    wherever in a line it stands; its first occurrence stays. No row is dropped: a text of which all is repeated
    becomes empty. Comparison ignores the case of A-Z and the amount of white space. Null texts stay null. All columns stay,
    whatever their names; ``removed`` names a further one for the number of deleted words.

    Keys may be null (those come first) or repeated: rows of one key are told apart by their texts, and rows that repeat key
    and text are one document. An empty table gives an empty one. Texts are hashed by blocks; one of 2**28 units is too long.

    Equal runs are never paired up: each is compared with the first of its kind, and both the smallest place and
    the counts are combined before the shuffle. A text travels once to its marks, and once more if it has an open segment.
    """
    row, told, first, done = (fresh_name(n, docs) for n in ("__row", "__told", "__first", "__done"))
    marks = marked_segments(docs, key, text).select(F.col("row").alias(row), F.struct("number", "later", "open").alias(told))
    held = stored(docs.withColumn(row, F.xxhash64(key, text)).join(marks, row, "left").drop(row), "held")
    opened = F.size(F.col(told)["open"]) > 0
    around = held.where(opened).select(F.col(text).alias("text"), F.col(told)["number"].alias("number"), F.col(told)["open"].alias("open"))
    runs = around.mapInArrow(_extend, "run bigint, place bigint").groupBy("run").agg(F.min("place").alias("place"))
    at = F.col("place").bitwiseAND((1 << AT_BITS) - 1).cast("int")
    firsts = runs.select(F.shiftright("place", AT_BITS).alias(row), at.alias("at")).groupBy(row).agg(F.collect_list("at").alias(first))
    # Only texts with an open segment have runs to be told about.
    some = held.where(opened).withColumn(row, F.col(told)["number"]).join(firsts, row, "left").drop(row)
    rows = held.where(F.col(told).isNull() | ~opened).withColumn(first, F.lit(None).cast("array<int>")).unionByName(some)

    @F.pandas_udf("text string, removed bigint")
    def rest(texts: pd.Series, later: pd.Series, open_: pd.Series, first: pd.Series) -> pd.DataFrame:
        out: list[tuple[str | None, int]] = []
        marks = list(zip(later, open_, first, strict=True))
        for some in together(t if m[0] is not None else None for t, m in zip(texts, marks, strict=True)):
            units = Units(*some)
            found = Segments(units.hashes, units.bounds)
            for k, (a, b, c) in enumerate(marks[len(out) : len(out) + len(some)]):
                out.append((None, 0) if a is None else remaining(units, found, k, a, b, [] if c is None else c, min_words))
        return pd.DataFrame({"text": pd.Series([t for t, _ in out], dtype=object), "removed": [n for _, n in out]})

    # A text without marks, or of which nothing goes, stays as it is.
    marked = F.col(told).isNotNull()
    found = rest(F.when(marked, F.col(text)), F.col(told)["later"], F.col(told)["open"], F.col(first))
    rows = rows.withColumn(done, found)
    gone = F.coalesce(F.col(done)["removed"], F.lit(0).cast("bigint"))
    shown = [F.when(gone > 0, F.col(done)["text"]).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns]
    return rows.select(*shown, *([gone.alias(removed)] if removed else []))
