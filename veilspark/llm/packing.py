"""Packing: documents are tokenised, laid end to end and cut into fixed windows."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import stored

# Fixed value: how a byte-level BPE of this kind cuts a text before it merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers beyond this code point can differ between versions of Unicode.
BEYOND = re.compile("[^\\0-\u024f]")


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks of byte strings, if it is a plain byte-level BPE that merges in the order of its ids."""
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True)
    extra = spec.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
    if model.get("type") != "BPE" or not plain or extra or model.get("ignore_merges") or model.get("byte_fallback"):
        return None
    # Fixed rule: visible characters of Latin-1 stand for their byte, the other bytes follow from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [k for k in range(256) if k not in shown]
    byte_of = {chr(k): k for k in shown} | {chr(256 + n): k for n, k in enumerate(other)}
    ids = model["vocab"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    order = [ids.get(m, -1) for m in merged]
    if any(c not in ids for c in byte_of) or order != sorted(set(order)) or len(order) + 256 != len(ids) or set("".join(ids)) > set(byte_of):
        return None
    return {bytes(byte_of[c] for c in token): n for token, n in ids.items()}


class Encoder:
    """Ids of whole texts under a vocabulary file of the tokenizers library.

    A plain byte-level BPE is run by its faster twin, over the same file's vocabulary; texts that hold a special token, or
    characters that Unicode versions class differently, and vocabularies of other kinds go to the library itself.
    """

    def __init__(self, vocabulary: str) -> None:
        self.vocabulary, self.slow = vocabulary, None
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = re.compile("|".join(re.escape(t) for t in special)) if special else None
        ranks = _ranks(spec)
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> list[int]:
        if self.slow is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.vocabulary)
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        own = self.fast is None or not text.isascii() and BEYOND.search(text) or self.special and self.special.search(text)
        return array("I", self.whole(text) if own else self.fast(text)).tobytes()


#: Rows that are held as ids at once.
AT_ONCE = 512


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """One encoder a worker, whatever the number of its tasks."""
    return Encoder(vocabulary)


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """First pass: ``(key, part, start, n, ids)``, one row per document.

    ``ids`` are little-endian unsigned 32-bit ids with ``end_id`` behind them, ``part`` is the task that made
    the row, ``start`` how many ids stand before the document in this task. A null text is empty: one id.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, part int, start bigint, n bigint, ids binary"
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, total = encoder(vocabulary).ids, TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(low, AT_ONCE)
                ids = [ids_of(t.as_py() or "") + end for t in some.column("text")]
                n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
                ends = total + np.cumsum(n)
                parts = pa.array(np.full(len(n), part, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([some.column("key"), parts, pa.array(ends - n), pa.array(n), pa.array(ids, pa.binary())], [key, "part", "start", "n", "ids"])
                total = int(ends[-1])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """All documents end to end, cut every ``length`` ids: one row per piece of a document in a sequence.

    Columns: key, ``start`` (ids of the document before the piece), ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` (place in the sequence, gapless from 0), and ``ids`` (binary) if asked for. Only
    the last sequence can be shorter than ``length``. Null and empty texts are one piece of the end id; keys may
    be null or repeated, each row is packed; other columns are ignored; an empty table gives no rows.

    First pass: every task tokenises its rows and counts ids; the ids are stored, since tokenising is the
    costly part. The totals of the tasks (one number per task, nothing per document) are summed up on the
    driver. Second pass: the stored rows are cut where their global offsets cross a window.
    """
    rows = stored(tokenized(docs, vocabulary, end_id, key, text), "tokens")
    totals = rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    base, at = {}, 0
    for row in totals:
        base[row.part] = at
        at += row.n
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, AT_ONCE) for b in batches for low in range(0, b.num_rows, AT_ONCE)):
            n = batch.column("n").to_numpy()
            first = batch.column("start").to_numpy() + np.array([base[p] for p in batch.column("part").to_pylist()], dtype=np.int64)
            pieces = (first + n - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] // length + nth
            start = np.maximum(sequence * length - first[row], 0)
            stop = np.minimum((sequence + 1) * length - first[row], n[row])
            data = batch.column("ids").to_pylist()
            cut = [data[r][4 * s : 4 * e] for r, s, e in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True)]
            sums = pa.array([zlib.crc32(x) for x in cut], pa.int64())
            columns = [batch.column(0).take(pa.array(row)), *map(pa.array, (start, stop - start)), sums, *map(pa.array, (n[row], sequence, first[row] + start - sequence * length))]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())] if ids else columns, [*names, "ids"] if ids else names)

    return rows.mapInArrow(run, schema + ", ids binary" * ids)
