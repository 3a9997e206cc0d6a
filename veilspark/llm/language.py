"""Language identification as inference of a mixture of languages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of the hashed n-gram table: with the number of languages this bounds the size of the model.
CELLS = 1 << 16
#: Labelled rows per language that the model is fitted on (expected number of a sample by key hash).
FIT_ROWS = 5_000
_SMOOTH = 0.5
_ROUNDS = 30
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """Cells of the character trigrams of the whole lower-cased text; all that is no letter counts as one blank.

    Trigrams with a blank in the middle carry no word and are left out.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(codes):
        return np.zeros(0, dtype=np.int64)
    codes = np.where(_is_letter()[codes], codes, 32).astype(np.uint32)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    middle = np.flatnonzero(codes[1:-1] != 32)
    hashed = (codes[middle] * np.uint32(0x9E3779B1) ^ codes[middle + 1] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) ^ codes[middle + 2] * np.uint32(0x27D4EB2F)
    hashed ^= hashed >> np.uint32(15)
    return ((hashed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int64)


class Model:
    """Log likelihoods of n-gram cells by language."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        smooth = counts.astype(float) + _SMOOTH
        self.p = (smooth / smooth.sum(axis=1, keepdims=True)).T.copy() if len(languages) else np.zeros((CELLS, 0))

    def shares(self, text: str | None) -> tuple[list[int], np.ndarray] | None:
        """The chosen languages and their proportions; None for a text without letters or without a model.

        For a set of languages expectation maximisation finds the proportions of greatest likelihood. Sets grow
        from the best single language by the one that helps most, while twice the gain of log likelihood is
        more than log(n), the price of one more free proportion (Bayesian information criterion).
        """
        cells = grams(text)
        if not len(cells) or not self.languages:
            return None
        cells, n = np.unique(cells, return_counts=True)
        p = self.p[cells]
        chosen = [int(np.argmax(n @ np.log(p)))]
        value, share = float(n @ np.log(p[:, chosen[0]])), np.ones(1)
        while len(chosen) < len(self.languages):
            # The gain of a small share of each other language, to first order, finds the next one.
            mix = p[:, chosen] @ share
            slope = n @ (p / mix[:, None])
            slope[chosen] = -np.inf
            wider = [*chosen, int(np.argmax(slope))]
            new = self._fit(p[:, wider], n)
            gain = float(n @ np.log(p[:, wider] @ new)) - value
            if 2 * gain <= np.log(n.sum()):
                break
            chosen, share, value = wider, new, value + gain
        return chosen, share

    @staticmethod
    def _fit(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        share = np.full(p.shape[1], 1 / p.shape[1])
        total = n.sum()
        for _ in range(_ROUNDS):
            new = share * (n / (p @ share) @ p) / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share / share.sum()

    def predict(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        found = self.shares(text)
        if found is None:
            return UNKNOWN, 0.0, []
        chosen, share = found
        order = np.argsort(-share, kind="stable")
        mix = [(self.languages[chosen[k]], float(share[k])) for k in order]
        return mix[0][0], min(1.0, max(0.0, mix[0][1])), mix


def fit(spark: SparkSession, labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Model:
    """Learns n-gram counts per language from the labelled rows: all with a text and a language.

    A language with more than ``rows`` rows is sampled by a hash of the key to about that number; a rarer one is
    taken whole. Tasks count their rows and return one sparse table per language; these are summed by Spark. The
    model has ``CELLS`` numbers per language whatever the input. No labelled row: a model without languages.
    """
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, CELLS)))
    scale = 1 << 20
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(scale, -(-rows * scale // sizes[k])))])
    sample = usable.where(F.pmod(F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit(""))), F.lit(scale)) < share[F.col("lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text_, lang_ in zip(batch["text"], batch["lang"], strict=True):
                held.setdefault(lang_, np.zeros(CELLS, dtype=np.int64))
                held[lang_] += np.bincount(grams(text_), minlength=CELLS)
        for lang_, counts in held.items():
            cells = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang_, "cell": cells, "n": counts[cells]})

    counted = sample.mapInPandas(count, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), CELLS), dtype=np.int64)
    counts[counted["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(dtype=int), counted["cell"].to_numpy(dtype=int)] = counted["n"].to_numpy(dtype=np.int64)
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``lang_mix``, from the whole text alone.

    ``lang_pred`` is the language of the largest proportion, ``score`` this proportion, ``lang_mix`` all chosen
    languages with theirs. Null texts and texts without letters are ``und`` with score 0. Ties go to the language
    that was chosen first. Rows are neither dropped nor shuffled; columns with these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, lang_mix array<struct<lang:string,share:double>>")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = held.value
        for part in parts:
            rows = [own.predict(t) for t in part]
            yield pd.DataFrame({
                "lang_pred": pd.Series([r[0] for r in rows], dtype=object), "score": pd.Series([r[1] for r in rows], dtype=float),
                "lang_mix": pd.Series([[{"lang": a, "share": b} for a, b in r[2]] for r in rows], dtype=object),
            })

    names = ("lang_pred", "score", "lang_mix")
    rest = docs.withColumn("__lang", predict(F.col(text))).drop(*names)
    return rest.select("*", *[F.col(f"__lang.{n}").alias(n) for n in names]).drop("__lang")
