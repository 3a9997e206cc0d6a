"""Katz backoff language model: Good-Turing discounted n-gram counts and normalised backoff weights.

Counts are too many for a table of one row each: a chunk of documents packs its distinct n-grams, by hash bucket,
into one sorted array of keys with their counts. Each bucket adds up the arrays of all chunks and answers every
chunk with the totals of its own keys. The answers are partitioned tables in the shared folder (by order of the
n-gram, then by chunk); scores are evaluated from them token by token, longest n-gram first. So the words
are shuffled as compressed arrays twice, and nothing of the model passes through the driver but a few sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import LOWER, as_bytes, byte_hashes, mixed, stored, word_bounds

#: Text bytes after which a chunk is closed, and n-grams that a bucket holds about.
CHUNK_BYTES = 12 << 20
BUCKET_GRAMS = 1 << 20
#: Counts above this are not discounted.
LARGEST_DISCOUNTED = 5
_PRIME = np.uint64(0x9FB21C651E98DF25)
#: Keys of the end of a text (a token) and of its beginning (only a context).
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _packed(x: np.ndarray) -> bytes:
    """Bytes of equal rank together, compressed; sorted keys are given as differences."""
    return zstandard.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u8"), dtype=np.uint64)


def chunks(docs: DataFrame, key: str, text: str, trains: str, size: int = CHUNK_BYTES) -> DataFrame:
    """``(chunk, keys, trains, lengths, words, n)``: documents as word numbers, some MB of text per row.

    ``vocabulary`` holds the distinct word hashes of the chunk, ``words`` the tokens as their places there. Each
    text ends with the end token. Null texts are empty.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"chunk bigint, keys array<{kind}>, trains binary, lengths binary, vocabulary binary, words binary, n bigint"

    def row(n: int, keys: list, trains: list, hashes: list[np.ndarray]) -> dict:
        from pyspark import TaskContext

        lengths = np.fromiter((len(h) for h in hashes), dtype="<u4", count=len(hashes))
        vocabulary, words = np.unique(np.concatenate(hashes), return_inverse=True)
        return {
            "chunk": TaskContext.get().partitionId() << 32 | n, "keys": keys, "trains": np.array(trains, dtype=np.uint8).tobytes(),
            "lengths": lengths.tobytes(), "vocabulary": _pack_keys(vocabulary), "words": _packed(words.astype("<u4")), "n": int(lengths.sum()),
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, held, keys, trains, hashes = 0, 0, [], [], []
        for batch in batches:
            for k, t, on in zip(batch["key"].astype(object).where(batch["key"].notna(), None), batch["text"], batch["trains"], strict=True):
                data = LOWER[as_bytes(t)]
                starts, ends = word_bounds(data)
                hashes.append(np.append(byte_hashes(data, starts, ends), END))
                keys.append(k)
                trains.append(bool(on))
                held += len(data) + 1
                if held >= size:
                    yield pd.DataFrame([row(n, keys, trains, hashes)])
                    n, held, keys, trains, hashes = n + 1, 0, [], [], []
        if keys:
            yield pd.DataFrame([row(n, keys, trains, hashes)])

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.expr(trains), F.lit(False)).alias("trains"))
    return named.mapInPandas(run, schema)


class _Chunk:
    """The n-grams of one chunk: per order distinct keys, the place of each token's n-gram, and training counts."""

    def __init__(self, row: pd.Series | dict, order: int) -> None:
        self.lengths = np.frombuffer(row["lengths"], dtype="<u4").astype(np.int64)
        self.trains = np.frombuffer(row["trains"], dtype=np.uint8).astype(bool)
        vocabulary, words = _unpack_keys(row["vocabulary"]), _unpacked(row["words"], "<u4")
        on = np.repeat(self.trains, self.lengths)
        firsts = np.cumsum(self.lengths) - self.lengths
        self.firsts = firsts
        # The beginning is a word of order 1 that stands before each text and is no token.
        keys = np.append(vocabulary, BEGIN)
        counts = np.append(np.bincount(words[on], minlength=len(vocabulary)), self.trains.sum())
        sort = np.argsort(keys)
        place = np.empty(len(sort), dtype=np.int64)
        place[sort] = np.arange(len(sort))
        at = place[words]
        self.keys, self.counts, self.at = [keys[sort]], [counts[sort]], [at]
        self.context: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]  # of each distinct n-gram, in the order below
        self.lower: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
        begin = int(place[-1])
        tokens = keys[words]
        for n in range(2, order + 1):
            # The context of a token is the n-gram of the order below that ends before it.
            before = np.empty_like(at)
            before[1:] = self.at[-1][:-1]
            if n == 2:
                before[firsts] = begin
                context_keys, known = self.keys[0], before
            else:
                context_keys, known = self._with_begin(before, n)
            grams = mixed(context_keys[known] * _PRIME + tokens)
            uniq, first, inverse = np.unique(grams, return_index=True, return_inverse=True)
            self.keys.append(uniq)
            self.counts.append(np.bincount(inverse[on], minlength=len(uniq)))
            self.at.append(inverse)
            self.context.append(known[first])
            self.lower.append(self.at[-2][first])

    def _with_begin(self, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Contexts that reach over the beginning are n-grams of their own that no token ends."""
        key = _begin_keys(n - 1)[-1]
        keys, counts = self.keys[-1], self.counts[-1]
        place = int(np.searchsorted(keys, key))
        self.keys[-1], self.counts[-1] = np.insert(keys, place, key), np.insert(counts, place, self.trains.sum())
        shift = lambda x: x + (x >= place)
        self.at[-1] = shift(self.at[-1])
        self.context[-1], self.lower[-1] = np.insert(self.context[-1], place, 0), np.insert(self.lower[-1], place, 0)
        before = shift(before)
        before[self.firsts] = place
        return self.keys[-1], before


def _spans(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin and end: buckets are equal ranges of the hash."""
    edges = [(b << 64) // buckets for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, dtype=np.uint64)), [len(keys)]])


def _asked(chunk_rows: DataFrame, order: int, buckets: int) -> DataFrame:
    """Keys and training counts of each chunk by order and bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                c = _Chunk(row, order)
                for n in range(order):
                    cuts = _spans(c.keys[n], buckets)
                    rows = [(n + 1, b, _pack_keys(c.keys[n][s:e]), _packed(c.counts[n][s:e].astype("<u4"))) for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]
                    yield pd.DataFrame(rows, columns=["order", "bucket", "keys", "counts"]).assign(chunk=row["chunk"])[["chunk", "order", "bucket", "keys", "counts"]]

    return chunk_rows.mapInPandas(run, "chunk bigint, order int, bucket int, keys binary, counts binary")


def _merged(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Distinct keys of all rows, the place of each row's keys among them, and the rows' ends."""
    keys = [_unpack_keys(k) for k in frame["keys"]]
    uniq, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return uniq, inverse, np.cumsum([len(k) for k in keys]).tolist()


def _begin_keys(order: int) -> np.ndarray:
    """Keys of the beginning, twice the beginning, and so on."""
    found = [np.array([BEGIN])]
    for _ in range(order - 1):
        found.append(mixed(found[-1] * _PRIME + BEGIN))
    return np.concatenate(found)


def _totals(asked: DataFrame) -> DataFrame:
    """Answers ``(chunk, order, bucket, answer, stats)``: totals shifted left, the low bit on for the chunk that
    speaks for the n-gram; rows of chunk -1 hold sum, number, and numbers of n-grams by count."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk", kind="stable")
        uniq, inverse, ends = _merged(frame)
        counts = np.concatenate([_unpacked(c, "<u4") for c in frame["counts"]])
        total = np.bincount(inverse, weights=counts, minlength=len(uniq)).astype(np.uint64)
        speaks = np.zeros(len(inverse), dtype=np.uint64)
        speaks[np.unique(inverse, return_index=True)[1]] = 1
        answer = total[inverse] << np.uint64(1) | speaks
        real = total[~np.isin(uniq, _begin_keys(8))]
        stats = [float(real.sum()), float((real > 0).sum()), *[float((real == r).sum()) for r in range(1, LARGEST_DISCOUNTED + 2)]]
        parts = [_packed(answer[s:e].astype("<u8")) for s, e in zip([0, *ends], ends, strict=False)]
        head = frame[["order", "bucket"]].iloc[[0]].assign(chunk=-1, answer=None, stats=[stats])
        rows = frame[["chunk", "order", "bucket"]].assign(answer=parts, stats=None)
        return pd.concat([rows, head[rows.columns]], ignore_index=True)

    return asked.groupBy("order", "bucket").applyInPandas(add, "chunk bigint, order int, bucket int, answer binary, stats array<double>")


def discounts(numbers: list[float]) -> np.ndarray:
    """Katz's factors for counts 1 to LARGEST_DISCOUNTED (place 0 unused, the last is 1) from the numbers of
    n-grams seen once, twice and so on: d_r = (r*/r - A) / (1 - A) with r* = (r + 1) n_(r+1) / n_r and
    A = (k + 1) n_(k+1) / n_1. Where this isn't strictly between 0 and 1, as on small inputs, (r - 1/2) / r."""
    k, d = LARGEST_DISCOUNTED, np.ones(LARGEST_DISCOUNTED + 2)
    for r in range(1, k + 1):
        a = (k + 1) * numbers[k] / numbers[0] if numbers[0] else 1.0
        x = ((r + 1) * numbers[r] / (r * numbers[r - 1]) - a) / (1 - a) if numbers[r - 1] and a < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


class _Model:
    """Sums of the corpus: everything that isn't per n-gram."""

    def __init__(self, stats: dict[int, list[float]], order: int) -> None:
        self.order = order
        self.d = [discounts(stats.get(n, [0.0] * (LARGEST_DISCOUNTED + 3))[2:]) for n in range(1, order + 1)]
        self.tokens, self.distinct = (int(x) for x in stats.get(1, [0.0, 0.0])[:2])
        seen = stats.get(1, [0.0] * (LARGEST_DISCOUNTED + 3))[2:]
        kept = self.tokens - sum((1 - self.d[0][r]) * r * seen[r - 1] for r in range(1, LARGEST_DISCOUNTED + 1))
        self.unknown = 1 - kept / self.tokens if self.tokens else 1.0  # of the one token that stands for all unseen ones

    def discounted(self, n: int, count: np.ndarray) -> np.ndarray:
        return self.d[n - 1][np.minimum(count, LARGEST_DISCOUNTED + 1)] * count

    def first(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.discounted(1, count) / max(self.tokens, 1), self.unknown)


class _Answered:
    """A chunk with the totals, and the backoff weights so far, of its n-grams."""

    def __init__(self, row: dict, frame: pd.DataFrame, model: _Model, weights: pd.DataFrame | None, upto: int) -> None:
        self.c, self.model = _Chunk(row, model.order), model
        self.total, self.speaks = [], []
        for n in range(1, model.order + 1):
            rows = frame[frame["order"] == n].sort_values("bucket")
            answer = np.concatenate([_unpacked(a, "<u8") for a in rows["answer"]])
            self.total.append((answer >> np.uint64(1)).astype(np.int64))
            self.speaks.append((answer & np.uint64(1)).astype(bool))
        self.p = [model.first(self.total[0])]  # of each distinct n-gram's last token
        for n in range(2, upto + 1):
            rows = weights[weights["order"] == n].sort_values("bucket")
            self.p.append(self.seen_or_backed(n, self.alpha(n, rows)))

    def ratio(self, n: int) -> np.ndarray:
        context = self.total[n - 2][self.c.context[n - 1]]
        return self.model.discounted(n, self.total[n - 1]) / np.maximum(context, 1)

    def contexts(self, n: int) -> np.ndarray:
        """Places of the distinct contexts, in the order of their keys."""
        return np.unique(self.c.context[n - 1])

    def alpha(self, n: int, rows: pd.DataFrame) -> np.ndarray:
        places = self.contexts(n)
        weight = np.ones(len(self.total[n - 2]))
        weight[places] = np.concatenate([_unpacked(a, "<f8") for a in rows["answer"]])
        weight[self.total[n - 2] == 0] = 1.0
        return weight

    def seen_or_backed(self, n: int, weight: np.ndarray) -> np.ndarray:
        backed = weight[self.c.context[n - 1]] * self.p[n - 2][self.c.lower[n - 1]]
        return np.where(self.total[n - 1] > 0, self.ratio(n), backed)


def _with_answers(chunk_rows: DataFrame, answers: DataFrame, weights: list[DataFrame], run, schema: str) -> DataFrame:
    tables = [answers.where("chunk >= 0").select("chunk", "order", "bucket", "answer", F.lit(0).alias("kind"))]
    tables += [w.select("chunk", "order", "bucket", "answer", F.lit(1).alias("kind")) for w in weights]
    both = tables[0]
    for t in tables[1:]:
        both = both.union(t)
    return chunk_rows.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInPandas(run, schema)


def _weight_sums(chunk_rows: DataFrame, answers: DataFrame, weights: list[DataFrame], model: _Model, n: int, buckets: int) -> DataFrame:
    """The backoff weight of each context: what is left of 1 by the discounted probabilities of the tokens seen after
    it, over what is left by their lower ones."""

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.to_dict("records")[0]
        a = _Answered(row, right[right["kind"] == 0], model, right[right["kind"] == 1], n - 1)
        on = a.speaks[n - 1] & (a.total[n - 1] > 0) & ~np.isin(a.c.keys[n - 1], _begin_keys(model.order))
        context, lower = a.c.context[n - 1][on], a.c.lower[n - 1][on]
        size = len(a.total[n - 2])
        places = a.contexts(n)
        sums = np.stack([np.bincount(context, weights=a.ratio(n)[on], minlength=size), np.bincount(context, weights=a.p[n - 2][lower], minlength=size)], axis=1)[places]
        keys = a.c.keys[n - 2][places]
        cuts = _spans(keys, buckets)
        rows = [(b, _pack_keys(keys[s:e]), _packed(sums[s:e].reshape(-1))) for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]
        return pd.DataFrame(rows, columns=["bucket", "keys", "sums"]).assign(chunk=row["chunk"], order=n)[["chunk", "order", "bucket", "keys", "sums"]]

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk", kind="stable")
        uniq, inverse, ends = _merged(frame)
        own = np.concatenate([_unpacked(s, "<f8").reshape(-1, 2) for s in frame["sums"]])
        total = np.stack([np.bincount(inverse, weights=own[:, k], minlength=len(uniq)) for k in (0, 1)], axis=1)
        weight = (np.maximum(1 - total[:, 0], 1e-12) / np.maximum(1 - total[:, 1], 1e-12))[inverse]
        parts = [_packed(weight[s:e]) for s, e in zip([0, *ends], ends, strict=False)]
        return frame[["chunk", "order", "bucket"]].assign(answer=parts)

    asked = _with_answers(chunk_rows, answers, weights, ask, "chunk bigint, order int, bucket int, keys binary, sums binary")
    return asked.groupBy("order", "bucket").applyInPandas(add, "chunk bigint, order int, bucket int, answer binary")


def katz_scores(docs: DataFrame, trains: str, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """``(key, n_tokens, n_known, train_tokens, base_score, score)`` of each row of ``docs``.

    The model learns from the rows where the SQL condition ``trains`` holds (null: it doesn't). Tokens are the
    words of the text with A-Z lower-cased, and one end. ``score`` is the log10 probability under the backoff
    model of the given order; words that training has not seen are one token together, which gets the mass that
    discounting leaves. ``base_score`` is the add-one unigram score. Null and blank texts are the end token
    alone; repeated rows and null keys are scored row by row; other columns are ignored; without
    training rows every token has the probability 1 of that one token; an empty table gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()
    spark = docs.sparkSession
    rows = stored(chunks(docs, key, text, trains), "chunks")
    size = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-size // BUCKET_GRAMS)))
    answers = stored(_totals(_asked(rows, order, buckets)), "totals")
    width = LARGEST_DISCOUNTED + 3
    stats = answers.where("chunk = -1").groupBy("order").agg(*[F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(width)]).collect()
    model = _Model({r["order"]: [r[f"s{k}"] for k in range(width)] for r in stats}, order)
    weights: list[DataFrame] = []
    for n in range(2, order + 1):
        weights.append(stored(_weight_sums(rows, answers, weights, model, n, buckets), "weights"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.to_dict("records")[0]
        a = _Answered(row, right[right["kind"] == 0], model, right[right["kind"] == 1], order)
        count = a.total[0][a.c.at[0]]
        base = np.log10((count + 1) / (model.tokens + model.distinct + 1))
        own = np.log10(a.p[order - 1])[a.c.at[order - 1]]
        add = lambda x: np.add.reduceat(x, a.c.firsts)
        return pd.DataFrame({
            key: list(row["keys"]), "n_tokens": a.c.lengths, "n_known": add((count > 0).astype(np.int64)), "train_tokens": model.tokens,
            "base_score": add(base), "score": add(own),
        })

    return _with_answers(rows, answers, weights, score, f"`{key}` {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
