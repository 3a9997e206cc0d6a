"""Helpers of the corpus operators: inputs, stored steps and vectorised word hashing."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.session import ensure_checkpoint_dir

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_FIRST, _SECOND = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: Bytes that are hashed at once.
BLOCK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, compression: str = "zstd", rows: int = 0) -> DataFrame:
    """``df`` written once to the shared folder of the cluster and read back: its lineage ends here.

    ``rows`` bounds the rows of a file, where rows are large.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).option("maxRecordsPerFile", rows).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: A key that holds more than this share of the rows is joined where its rows lie; there are at most so many.
HOT_KEYS = 4096


def join_named(rows: DataFrame, named: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` joined with ``named``, which has a row for each key and the number ``n`` of its rows.

    The few keys that hold over one in ``HOT_KEYS`` of all rows, at most that many, are broadcast; so no key
    gathers its rows in one task. The others are dealt.
    """
    total = named.agg(F.sum(n)).first()[0] or 0
    crowded = F.col(n) * HOT_KEYS > total
    hot = F.broadcast(named.where(crowded).drop(n))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(named.where(~crowded).drop(n), key)
    return rows.join(hot, key).unionByName(rest)


def fresh_name(name: str, *frames: DataFrame) -> str:
    """The name, with underscores before it until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix over unsigned longs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random odd number for each byte, and the bytes that separate words.
BYTE_VALUE = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_STEP)) | np.uint64(1)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``values[start:end]``, the same for the same content wherever it stands."""
    up, down = _powers_to(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """:func:`span_hashes` of bytes, by blocks: a long text takes little more memory than its words' places.

    A span longer than a block has a hash of its own kind, wherever it stands.
    """
    out, at = np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        low = int(starts[at])
        stop = int(np.searchsorted(ends, low + BLOCK, side="right"))
        if stop == at:
            out[at] = int.from_bytes(hashlib.blake2b(data[low : ends[at]], digest_size=8).digest(), "little")
            at += 1
            continue
        high = int(ends[stop - 1])
        out[at:stop] = span_hashes(BYTE_VALUE[data[low:high]], starts[at:stop] - low, ends[at:stop] - low)
        at = stop
    return out


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n hashes, by doubling."""
    if n < 1 or len(hashes) < n:
        return hashes[:0]
    power, step, out, size = mixed(hashes), 1, None, 0
    while True:
        if n & step:
            if out is None:
                out = power
            else:
                k = len(hashes) - size - step + 1
                out = mixed(out[:k] * _FIRST + power[size : size + k] * _SECOND)
            size += step
        if size == n:
            return out
        power = mixed(power[:-step] * _FIRST + power[step:] * _SECOND)
        step *= 2


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) of UTF-8 bytes."""
    edges = np.ones(len(data) + 2, dtype=bool)
    edges[1:-1] = IS_SPACE[data]
    turns = np.flatnonzero(edges[1:] != edges[:-1])
    return turns[::2], turns[1::2]


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of lower-cased bytes, in order."""
    return byte_hashes(data, *word_bounds(data))
