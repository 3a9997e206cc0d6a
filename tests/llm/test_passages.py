"""Repeated passages against brute force over words, wherever they start."""

from __future__ import annotations

import random

from veilspark.llm import lines


def brute_words(texts, n=40):
    """Words left of each text: words in a run of n that stood earlier go."""
    seen, left = {}, {}
    for key, text in texts:
        words = text.split()
        gone = set()
        for at in range(len(words) - n + 1):
            first = seen.setdefault(" ".join(words[at : at + n]).lower(), (key, at))
            if first != (key, at):
                gone.update(range(max(at, first[1] + n) if first[0] == key else at, at + n))
        left[key] = [w for k, w in enumerate(words) if k not in gone]
    return left


def test_passages_from_any_word(spark):
    rng = random.Random(8)
    prose = lambda n: [rng.choice("abcdefgh") * rng.randrange(1, 4) + str(rng.randrange(5000)) + rng.choice(["", "", "", ".", ","]) for _ in range(n)]
    source = prose(4000)
    texts = [(0, " ".join(source))]
    for k in range(1, 61):
        n, at = rng.choice([39, 40, 45, 51, 55, 80, 120]), rng.randrange(3800)
        texts.append((k, " ".join(prose(rng.randrange(60)) + source[at : at + n] + prose(rng.randrange(60)))))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: r.text.split() for r in lines.dedup_lines(df).collect()}
    assert got == brute_words(texts)


def test_passages_without_blanks(spark):
    rng = random.Random(9)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = han(60)
    texts = [(1, han(30) + passage + han(20)), (2, (a := han(25)) + passage + (b := han(31)))]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {1: texts[0][1], 2: a + b}
