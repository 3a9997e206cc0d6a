"""Phrase mining, periodic runs and repeated windows against brute force, and their edge cases."""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import periods, phrases, queries, recompression

# --- phrases


def brute_phrases(rows, least, longest, share, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    frequent = {p: a for p, a in f.items() if a >= least}
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        inside = [b for (other, q), b in frequent.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= share * a for b in inside):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    found = []
    for lang, rows_ in out.items():
        for rank, (score, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):  # noqa: E741
            found.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(found)


def told(rng, n):
    words = ["ab", "Cd", "é", "x\x1c", "EF", "g"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b", " "]) for _ in range(n))


@pytest.mark.parametrize(("share", "top", "chunk"), [(100, 2000, 1 << 19), (60, 3, 40), (100, 5, 1)])
def test_phrases_against_brute_force(spark, share, top, chunk):
    rng = random.Random(share + top)
    rows = [(rng.choice(["en", "de", None, "und"]), told(rng, rng.randrange(60))) for _ in range(80)]
    rows += [(None, None), ("en", ""), ("fr", "..."), ("en", rows[0][1]), ("en", rows[0][1]), ("de", "a " * 300)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "lang string, text string, chunk int, id int, phrase string").repartition(3)
    got = phrases.collocations(df, least=4, share=share, top=top, chunk=chunk).collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, 4, 5, share, top)


def test_groups_of_a_chunk_move_packed(spark):
    """A chunk sends one row a bucket, not one a word, and every word and count arrives."""
    df = spark.createDataFrame([("en", " ".join(f"w{k} w{k // 3}" for k in range(900)))], "lang string, text string").coalesce(1)
    chunks = df.mapInArrow(functools.partial(phrases._cut, size=1 << 19), phrases._FIRST).select("chunk", "lang", "words", "counts")
    rows = chunks.mapInArrow(functools.partial(phrases._word_rows, bits=4), phrases._WORDS)
    assert rows.count() <= 16
    frequent, held = phrases._frequent(rows, phrases._count_words, phrases._WORDS_FOUND, ["lang", "word"], 4, 4)
    got = {bytes(r.word).decode(): r.f for r in frequent.collect()}
    assert got == {f"w{k}": 4 for k in range(300)} and frequent.select("id").distinct().count() == 300
    assert sum(x["size"] for x in held.head().found) == 900
    numbers = np.array([0, 5, 1 << 20, 7, -3, 1 << 30])
    assert phrases._unpacked(phrases._packed(numbers)).tolist() == numbers.tolist() and not len(phrases._unpacked(phrases._packed(numbers[:0])))


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(df).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, " \t.")], "lang string, text string")).count() == 0


def test_a_frequent_pair_is_one_row_a_chunk(spark):
    df = spark.createDataFrame([("en", "a b " * 500)] * 40, "lang string, text string").coalesce(2)
    found, totals = phrases.frequent_phrases(df, least=100, longest=3, chunk=4000)
    assert {r.phrase: r.f for r in found[1].collect()} == {"a b": 20000, "b a": 19960}
    assert totals.first().n == 40000


# --- periodic runs


def brute_runs(ids, least=12):
    n, out = len(ids), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out[i, j - i + q] = min(q, out.get((i, j - i + q), q))
            i = max(j, i + 1)
    return sorted((s, n_, q) for (s, n_), q in out.items())


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([1, 2, 3, 6, 40, 400]), st.integers(0, 260))
def test_runs_against_brute_force(seed, kinds, n):
    rng = random.Random(seed)
    ids = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4) if n else 0):
        at, period = rng.randrange(n), rng.randrange(1, 70)
        for i in range(at + period, min(n, at + period * rng.randrange(2, 6) + rng.randrange(period))):
            ids[i] = ids[i - period]
    assert periods.runs_of(np.array(ids, dtype=np.int32)) == brute_runs(ids)


def test_splitting_keeps_segments_of_repeated_words():
    ids = np.array([9, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 8, 3, 4, 3, 7, 5], dtype=np.int32)
    assert periods.segments(ids) == [(1, 13)]
    # Words that occur twice in the whole but once on each side of a cut go in the second round.
    half = list(range(100, 130))
    assert periods.segments(np.array([*half, 1, *reversed(half)], dtype=np.int32)) == []
    assert periods.segments(np.array([], dtype=np.int32)) == []


def test_long_texts_of_one_word_and_of_a_long_period():
    assert periods.runs_of(np.zeros(50_000, dtype=np.int32)) == [(0, 50_000, 1)]
    ids = np.random.default_rng(1).integers(0, 50, 30_000).astype(np.int32)
    ids[10_000:] = ids[10_000 + np.arange(20_000) % 7_001]
    assert (10_000, 20_000, 7_001) in periods.runs_of(ids)


def test_periods_edge_cases(spark):
    rows = [(None, None), (1, ""), (1, " \n"), (1, "a  b\n" * 6), (1, "a  b\n" * 6), (2, "é x é"), (3, "u " + "v " * 12)]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id bigint, text string, runs string, key int")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(df).collect()]
    want = [(None, 0, [], ""), (1, 0, [], ""), (1, 0, [], ""), (1, 12, [(0, 12, 2)], "a b"), (1, 12, [(0, 12, 2)], "a b"), (2, 3, [], "é x é"), (3, 13, [(1, 12, 1)], "u v")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periods.periodic_runs(df.limit(0)).count() == 0


def test_word_numbers_over_blocks(monkeypatch):
    monkeypatch.setattr(periods, "_BLOCK", 7)
    text = "aa bbbbbbbbbbbbbbb\tcc \x1c aa\n\n" * 30
    ids, words = periods.word_numbers(text)
    assert [words[k] for k in ids] == text.encode().split()


# --- repeated windows


def brute_repeats(rows, window):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(x[i : i + window]) for x in texts for i in range(len(x) - window + 1))
    out = []
    for (key, _), x in zip(rows, texts, strict=True):
        gone = {j for i in range(len(x) - window + 1) if seen[tuple(x[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((key, len(x), len(gone), b" ".join(w for j, w in enumerate(x) if j not in gone).decode()))
    return sorted(out, key=str)


def planted(rng, kinds):
    vocabulary = [f"w{i}" for i in range(kinds)]
    source = [rng.choice(vocabulary) for _ in range(2000)]
    rows = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(100))]
        for _ in range(rng.randrange(3)):
            at, n, to = rng.randrange(1900), rng.choice([20, 34, 35, 36, 60, 100]), rng.randrange(len(words) + 1)
            words[to:to] = source[at : at + n]
        if rng.random() < 0.2:
            words += [rng.choice("ab")] * rng.randrange(90)
        rows.append((k, "\n ".join(words)))
    return [*rows, rows[3], rows[4], (None, None), (None, ""), (200, rows[5][1]), (201, " é " * 36)]


@pytest.mark.parametrize(("kinds", "window", "rounds", "part"), [(2, 35, 6, 1 << 18), (2000, 35, 6, 1 << 18), (40, 35, 6, 50), (3, 12, 3, 7), (2000, 35, 0, 60)])
def test_repeats_against_brute_force(spark, kinds, window, rounds, part):
    rows = planted(random.Random(kinds + part), kinds)
    df = spark.createDataFrame([(*r, 5, "n") for r in rows], "doc_id bigint, text string, row int, name string").repartition(3)
    got = recompression.remove_repeats(df, window=window, rounds=rounds, part=part).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, window)


def test_repeats_of_nothing(spark):
    assert recompression.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_equal_contexts_have_equal_symbols():
    """The claim that pruning rests on: who holds a symbol's context holds the symbol."""
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 4, 400).astype(np.uint64)
    for _ in range(20):
        texts = [np.concatenate([rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint64), shared, rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint64)]) for _ in range(2)]
        offsets = [next(i for i in range(len(t)) if np.array_equal(t[i : i + 400], shared)) for t in texts]
        views = []
        for text, offset in zip(texts, offsets, strict=True):
            s = recompression.symbols(text, np.zeros(len(text), dtype=np.int64), 5)
            inside = (s.low >= offset) & (s.high <= offset + 400)
            views.append({(int(a), int(b), int(n)) for a, b, n in zip(s.start[inside] - offset, s.end[inside] - offset, s.name[inside], strict=True)})
        assert views[0] == views[1] and views[0]


def test_windows_around_a_unique_context_are_ruled_out():
    dead = np.array([10 << 6 | 5], dtype=np.int64)
    alive = recompression.live_windows(40, dead, 8)
    assert np.flatnonzero(~alive).tolist() == [7, 8, 9, 10]
    assert recompression.live_windows(7, dead, 8).tolist() == []


# --- the registered queries, on a small folder of tables


def test_queries_on_planted_documents(spark, tmp_path):
    rng = random.Random(11)
    rows = [(k, t, rng.choice(["en", None])) for k, t in planted(rng, 30)]
    rows += [(k, " ".join(rng.choice("abcdefgh") for _ in range(80)), "en") for k in range(300, 360)]
    rows += [(400, "Foo bar baz. qux foo bar " * 70, "en"), (401, "u Foo bar baz\n" * 60, None), (402, "u foo bar\n" * 60, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op13_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {(k, n, g, sha(t)) for k, n, g, t in brute_repeats([r[:2] for r in rows], 35)}
    got = sorted(map(tuple, queries.op12_periods(spark, str(tmp_path)).collect()), key=str)
    want = []
    for k, text, _ in rows:
        words = (text or "").split()
        ids = queries.planted_loop(k, np.arange(len(words))).tolist()
        words = [words[i] for i in ids]
        runs = brute_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((k, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert got == sorted(want, key=str)
    got = sorted(map(tuple, queries.op11_phrases(spark, str(tmp_path)).collect()))
    assert got == brute_phrases([(r[2], r[1]) for r in rows], 100, 5, 100, 2000) and got
