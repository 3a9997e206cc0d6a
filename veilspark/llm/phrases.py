"""Phrase collocations: frequent word sequences, scored by how far they exceed chance at their weakest cut.

Method (SETM after Houtsma and Swami): an occurrence relation for each length, sorted by place and stored. A phrase of
k + 1 words stands where frequent phrases of k words stand at a place and at the next one, so the relation is
merge-joined with itself by adjacent places, its groups are counted over all chunks, and a semi-join with the frequent
groups comes before the next length. A group is the pair of the numbers of its two parts, so counts are exact:
nothing is hashed.

The relation is held in chunks: one row for about ``CHUNK`` words of one language, cut between pieces, with the places
and the chunk's own groups in order. A chunk counts its groups before anything is shuffled, so that a group, however
frequent, goes once for each chunk. Groups are dealt to buckets by their hashes; a chunk's groups of one bucket are one row
of packed arrays, in an order that both sides know. What returns to the chunk are a bit for each of them and the packed
numbers of the frequent ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import mixed, stored

#: Words of a chunk; a task holds chunks of all its languages open, with this many chunks' words at most.
CHUNK, OPEN = 1 << 19, 4
#: Chunks of a stored file: a reader holds the rows of a file at once.
_FILE_ROWS = 4
_BLOCK = 1 << 20
#: Parts of a language that are ranked apart.
_RANK_PARTS = 16
_BETWEEN = re.compile(rb"[ \n]")
#: Ends of pieces become line feeds, tabs become blanks.
_PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\x09", b"\n" * 9 + b" ")


class _Numbers(dict):
    """Words numbered as they come; the end of a piece is number 0."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Chunk:
    def __init__(self) -> None:
        self.numbers, self.parts, self.size = _Numbers(), [], 0

    def add(self, words: Iterator[bytes]) -> None:
        part = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int32)
        self.parts.append(part)
        self.size += len(part)

    def rest(self) -> tuple[np.ndarray, list[bytes]]:
        """The words behind the last end of a piece, which the next chunk begins with; they are taken off here."""
        groups = np.concatenate(self.parts)
        ends = np.flatnonzero(groups == 0)
        at = int(ends[-1]) + 1 if len(ends) else 0
        self.parts, words = [groups[:at]], list(self.numbers)
        return groups[at:], words


def _packed(numbers: np.ndarray) -> bytes:
    """Byte by byte: the first bytes of all numbers, then the second ones."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").reshape(-1)


def _row(chunk: int, lang: str, held: _Chunk) -> dict:
    """A chunk whose words are numbered in the order of their hashes, so that a bucket's words stand together."""
    groups = np.concatenate(held.parts)
    words = list(held.numbers)
    counts = np.bincount(groups, minlength=len(words))
    hashes = np.fromiter(map(zlib.crc32, words), dtype=np.int64)
    hashes[0], hashes[counts == 0] = -1, 1 << 32
    ends, counts[0] = int(counts[0]), 0
    order = np.argsort(hashes, kind="stable")
    number = np.empty(len(order), dtype=np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    at = order[1 : 1 + int(np.count_nonzero(counts))]
    n = len(groups) - ends
    listed = zstandard.ZstdCompressor(level=1).compress(b"\n".join(words[k] for k in at.tolist()))
    return {"chunk": chunk, "lang": lang, "n": n, "groups": _packed(number[groups]), "words": listed, "counts": _packed(counts[at])}


_FIRST = "chunk bigint, lang string, n bigint, groups binary, words binary, counts binary"
_NEXT = "chunk bigint, places binary, groups binary, buckets binary, lefts binary, rights binary, counts binary"
_WORDS = "chunk bigint, bucket int, lang string, words binary, counts binary"
_PAIRS = "chunk bigint, bucket int, lefts binary, rights binary, counts binary"
_FOUND = "chunk bigint, bucket int, size int, mask binary, ranks binary, ids array<bigint>, {}, fs array<bigint>"
_WORDS_FOUND = _FOUND.format("langs array<string>, words array<binary>")
_PAIRS_FOUND = _FOUND.format("lefts array<bigint>, rights array<bigint>")
_TYPES = {
    "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()),
}
#: Bits of a chunk's number that count the chunks of a task.
_CHUNK_BITS = 17
#: Buckets of groups: a power of two up to this, about one for each three chunks.
_MOST_BUCKETS = 1 << 12


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _TYPES[kind]) for c, kind in columns], [c for c, _ in columns])


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Texts ``(lang, text)`` to the relation of single words."""
    open_: dict[str, _Chunk] = {}
    made, part = 0, TaskContext.get().partitionId()

    def done(lang: str, held: _Chunk) -> pa.RecordBatch:
        nonlocal made
        made += 1
        return _batch([_row(part << _CHUNK_BITS | made, lang, held)], _FIRST)

    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
        for lang, value in zip(batch.column(0).to_pylist(), texts, strict=True):
            data, at = value.as_py(), 0
            held = open_.setdefault(lang, _Chunk())
            while at < len(data):
                found = _BETWEEN.search(data, at + _BLOCK)
                end = found.end() if found else len(data)
                block = data[at:end].lower().translate(_PLAIN).replace(b"\n", b" \n ")
                held.add(filter(None, block.split(b" ")))
                at = end
                if held.size >= size:
                    groups, words = held.rest()
                    if held.parts[0].size:
                        yield done(lang, held)
                    held = open_[lang] = _Chunk()
                    held.add(words[k] for k in groups.tolist())
            held.add([b"\n"])
            if sum(c.size for c in open_.values()) >= OPEN * size:
                largest = max(open_, key=lambda name: open_[name].size)
                yield done(largest, open_.pop(largest))
    for lang, held in open_.items():
        yield done(lang, held)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One after the other: a row is large."""
    return (batch.slice(row, 1).to_pylist()[0] for row in range(batch.num_rows))


def _bounds(buckets: np.ndarray) -> zip:
    """``(bucket, start, end)`` of each bucket of an ascending array."""
    starts = np.flatnonzero(np.diff(buckets, prepend=-1))
    return zip(buckets[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(buckets)], strict=True)


def _word_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """One row per chunk and bucket: its words and their counts, in the chunk's order."""
    for batch in batches:
        for one in _rows(batch):
            counts = _unpacked(one["counts"])
            if not len(counts):
                continue
            words = zstandard.ZstdDecompressor().decompress(one["words"]).split(b"\n")
            buckets = np.fromiter(map(zlib.crc32, words), dtype=np.int64) >> (32 - bits)
            packed = zstandard.ZstdCompressor(level=1).compress
            yield _batch(
                [
                    {"chunk": one["chunk"], "bucket": b, "lang": one["lang"], "words": packed(b"\n".join(words[i:j])), "counts": _packed(counts[i:j])}
                    for b, i, j in _bounds(buckets)
                ],
                _WORDS,
            )


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk and bucket: its pairs and their counts, in the chunk's order."""
    for batch in batches:
        for one in _rows(batch):
            buckets, lefts, rights, counts = (_unpacked(one[c]) for c in ("buckets", "lefts", "rights", "counts"))
            if not len(counts):
                continue
            yield _batch(
                [
                    {"chunk": one["chunk"], "bucket": b, "lefts": _packed(np.diff(lefts[i:j], prepend=0)), "rights": _packed(rights[i:j]), "counts": _packed(counts[i:j])}
                    for b, i, j in _bounds(buckets)
                ],
                _PAIRS,
            )


def _told(rows: list[dict], which: list[np.ndarray], sums: np.ndarray, bucket: int, least: int, bits: int) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """What each chunk learns of its groups, and the places and numbers of the bucket's frequent groups.

    A frequent group's number is its rank in the bucket and the bucket: numbers of all buckets are dense and differ.
    """
    often = sums >= least
    rank = np.cumsum(often) - 1
    ids = (np.arange(int(np.count_nonzero(often)), dtype=np.int64) << bits) | bucket
    if len(ids) and int(ids[-1]) >= 1 << 31:
        raise OverflowError("more frequent phrases of one length than 31 bits can number")
    out = []
    for row, own in zip(rows, which, strict=True):
        mask = often[own]
        ranks = rank[own[mask]]
        out.append({"chunk": row["chunk"], "bucket": bucket, "size": len(own), "mask": np.packbits(mask).tobytes(), "ranks": _packed(np.diff(ranks, prepend=0))})
    return out, np.flatnonzero(often), ids


def _sums(which: list[np.ndarray], counts: list[np.ndarray], size: int) -> np.ndarray:
    sums = np.zeros(size, dtype=np.int64)
    for own, n in zip(which, counts, strict=True):
        sums[own] += n
    return sums


def _count_words(table: pa.Table, least: int, bits: int) -> pa.Table:
    """The words of a bucket counted over all chunks. A chunk has a word once."""
    rows = table.to_pylist()
    numbers: dict[tuple[str, bytes], int] = {}
    which = []
    for row in rows:
        words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b"\n")
        which.append(np.fromiter((numbers.setdefault((row["lang"], w), len(numbers)) for w in words), dtype=np.int64, count=len(words)))
    sums = _sums(which, [_unpacked(row["counts"]) for row in rows], len(numbers))
    out, at, ids = _told(rows, which, sums, rows[0]["bucket"], least, bits)
    names = list(numbers)
    found = [names[k] for k in at.tolist()]
    out.append({"bucket": rows[0]["bucket"], "ids": ids, "langs": [x for x, _ in found], "words": [x for _, x in found], "fs": sums[at]})
    return pa.Table.from_batches([_batch(out, _WORDS_FOUND)])


def _count_pairs(table: pa.Table, least: int, bits: int) -> pa.Table:
    """The pairs of a bucket counted over all chunks. A chunk has a pair once."""
    rows = table.to_pylist()
    keys = [(np.cumsum(_unpacked(row["lefts"]), dtype=np.int64) << 32) | _unpacked(row["rights"]) for row in rows]
    named, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    which = np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])
    sums = _sums(which, [_unpacked(row["counts"]) for row in rows], len(named))
    out, at, ids = _told(rows, which, sums, rows[0]["bucket"], least, bits)
    out.append({"bucket": rows[0]["bucket"], "ids": ids, "lefts": named[at] >> 32, "rights": named[at] & 0xFFFFFFFF, "fs": sums[at]})
    return pa.Table.from_batches([_batch(out, _PAIRS_FOUND)])


def _join_adjacent(batches: Iterator[pa.RecordBatch], first: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(chunk, places, groups, found)`` to the next relation: semi-join, merge join by place, group and count.

    ``first`` is the number of a chunk's first group (the end of a piece is word 0).
    """
    for batch in batches:
        for one in _rows(batch):
            groups, found = _unpacked(one["groups"]), sorted(one["found"], key=lambda x: x["bucket"])
            number = np.full(first + sum(x["size"] for x in found), -1, dtype=np.int64)
            at = first
            for x in found:
                mask = np.unpackbits(np.frombuffer(x["mask"], dtype=np.uint8), count=x["size"]).astype(bool)
                number[at : at + x["size"]][mask] = (np.cumsum(_unpacked(x["ranks"]), dtype=np.int64) << bits) | x["bucket"]
                at += x["size"]
            places = np.arange(len(groups), dtype=np.int32) if one["places"] is None else np.cumsum(_unpacked(one["places"]), dtype=np.int32)
            ids = number[groups]
            stays = ids >= 0
            places, ids = places[stays], ids[stays]
            at = np.flatnonzero(places[1:] == places[:-1] + 1)
            named, which, counts = np.unique((ids[at] << 32) | ids[at + 1], return_inverse=True, return_counts=True)
            buckets = (mixed(named) >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(buckets, kind="stable")
            rank = np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            named = named[order]
            yield _batch([{
                "chunk": one["chunk"], "places": _packed(np.diff(places[at], prepend=0)), "groups": _packed(rank[which]),
                "buckets": _packed(buckets[order]), "lefts": _packed(named >> 32), "rights": _packed(named & 0xFFFFFFFF), "counts": _packed(counts[order]),
            }], _NEXT)


def _relation(df: DataFrame, label: str) -> DataFrame:
    return stored(df, label, rows=_FILE_ROWS)


def _frequent(each: DataFrame, count: Callable[..., pa.Table], schema: str, by: list[str], least: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Of rows per chunk and bucket the frequent groups ``(id, <by>, f)``, and per chunk what its buckets found."""

    def counted(rows: pa.Table) -> pa.Table:
        return count(rows, least, bits)

    told = stored(each.groupBy("bucket").applyInArrow(counted, schema), "frequent")
    held = told.where("chunk is not null").select("chunk", F.struct("bucket", "size", "mask", "ranks").alias("one")).groupBy("chunk").agg(F.collect_list("one").alias("found"))
    lists = ["ids", *[f"{c}s" for c in by], "fs"]
    frequent = told.where("chunk is null").select(F.inline(F.arrays_zip(*lists))).toDF("id", *by, "f")
    return frequent, held


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 100, longest: int = 5, chunk: int = CHUNK) -> tuple[list[DataFrame], DataFrame]:
    """Per length ``(id, lang, phrase, f, heads, tails, left, right)`` for phrases that occur ``least`` times, and ``(lang, n)``.

    ``heads`` and ``tails`` are the counts of the phrase's first and last 1, 2, ... words, itself included; ``left``
    and ``right`` are the numbers of the phrases without the last and the first word. See :func:`collocations`.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    relation = _relation(rows.mapInArrow(partial(_cut, size=chunk), _FIRST), "words")
    totals = relation.groupBy("lang").agg(F.sum("n").alias("n"))
    chunks = relation.count()
    bits = max(4, min(_MOST_BUCKETS, chunks // 3).bit_length())
    each = relation.select("chunk", "lang", "words", "counts").mapInArrow(partial(_word_rows, bits=bits), _WORDS)
    frequent, held = _frequent(each, _count_words, _WORDS_FOUND, ["lang", "word"], least, bits)
    one = F.array("f")
    none = F.lit(None).cast("bigint")
    phrases = [frequent.select("id", "lang", F.decode("word", "UTF-8").alias("phrase"), "f", one.alias("heads"), one.alias("tails"), none.alias("left"), none.alias("right"))]
    relation = relation.select("chunk", F.lit(None).cast("binary").alias("places"), "groups")
    for k in range(1, longest):
        joined = partial(_join_adjacent, first=1 if k == 1 else 0, bits=bits)
        relation = _relation(relation.join(held, "chunk").mapInArrow(joined, _NEXT), "phrases")
        each = relation.select("chunk", "buckets", "lefts", "rights", "counts").mapInArrow(_pair_rows, _PAIRS)
        frequent, held = _frequent(each, _count_pairs, _PAIRS_FOUND, ["left", "right"], least, bits)
        relation = relation.select("chunk", "places", "groups")
        head = phrases[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"), "heads")
        tail = phrases[-1].select(F.col("id").alias("right"), F.col("phrase").alias("end"), "tails")
        longer = frequent.join(head, "left").join(tail, "right").select(
            "id", "lang", F.concat_ws(" ", "begin", F.substring_index("end", " ", -1)).alias("phrase"), "f",
            F.concat("heads", one).alias("heads"), F.concat("tails", one).alias("tails"), "left", "right",
        )
        phrases.append(stored(longer, "longer"))
    return phrases, totals


def _cuts(k: int) -> Column:
    """The lowest-scoring cut of a phrase of k words, as ``(score, k, l, r)``; integers of up to 38 digits."""
    cuts = [
        f"struct(cast(1000 * f as decimal(20, 0)) * cast(n as decimal(18, 0)) div (cast(heads[{i - 1}] as decimal(19, 0)) * cast(tails[{k - i - 1}] as decimal(18, 0))) as score,"
        f" {i} as k, heads[{i - 1}] as l, tails[{k - i - 1}] as r)"
        for i in range(1, k)
    ]
    return F.expr(f"array_min(array({', '.join(cuts)}))")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 100, longest: int = 5, share: int = 100, top: int | None = 2000, chunk: int = CHUNK
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's best collocations of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and into words at blanks and tabs; a
    phrase doesn't cross pieces. ``a`` is how often the phrase occurs (``least`` times at least, overlaps included),
    ``n`` the number of words of its language. Of all cuts into two phrases, with ``l`` and ``r`` occurrences, the one
    with the lowest ``floor(1000 a n / (l r))`` counts, the earliest of equal ones. A phrase goes if a longer one
    that holds it occurs in ``share`` percent of its places (a phrase one word longer shows this: no longer one is more
    frequent). Order: score and ``a`` descending, then the phrase by its bytes; ``top`` rows of each language.

    Null texts are empty; a null language is ``und``; texts without words or of any length, repeated rows and other
    columns of any name are fine; an empty table gives no rows. ``top`` is the report's length: every phrase is counted.
    """
    phrases, totals = frequent_phrases(docs, lang, text, least, longest, chunk)
    scored = []
    for k, found in enumerate(phrases[1:], start=2):
        kept = found.join(totals, "lang").withColumn("cut", _cuts(k))
        if k < longest:
            above = phrases[k]
            cover = above.select(F.col("left").alias("id"), "f").union(above.select("right", "f")).groupBy("id").agg(F.max("f").alias("cover"))
            kept = kept.join(cover, "id", "left").where(F.col("cover").isNull() | (100 * F.col("cover") < share * F.col("f")))
        scored.append(kept.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score"))
    rows = reduce(DataFrame.unionByName, scored)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        # The best of each part of a language first, so that the last ranking has a bounded number of rows.
        part = F.pmod(F.xxhash64("phrase"), F.lit(_RANK_PARTS)).alias("part")
        parts = rows.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
        rows = parts.where(F.col("rank") <= top).drop("part", "rank")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    columns: Sequence[str] = ("phrase", "a", "l", "r", "n", "score")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), *columns)
