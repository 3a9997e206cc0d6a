"""Near copies of the pipeline stage against brute force over all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
from veilspark.llm import near

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int"


def jaccard(a, b):
    sets = []
    for text in (a, b):
        words = (text or "").lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def brute_kept(rows):
    """Indices of the first row of each component; rows are in order of preference."""
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {k for k, r in enumerate(root) if r == k}


def test_near_dedup_stage_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for group in range(45):
        text = rng.choices(words, k=rng.choice([60, 120, 300]))
        rows.append((len(rows), " ".join(text)))
        for _ in range(3):
            near = list(text)
            for at in rng.sample(range(len(near)), max(1, len(near) * (group % 6) // 100)):
                near[at] = rng.choice(words)
            rows.append((len(rows), " ".join(near).upper() if group % 2 else "  ".join(near)))
    # Unrelated texts that share a key; copies without a key; blank texts; short texts.
    rows += [(900, " ".join(rng.choices(words, k=50))) for _ in range(5)] + [(901, "a b c"), (902, "A  b c"), (903, "a b"), (904, ""), (905, None)]
    rows += [(None, rows[0][1]), (None, "only here and nowhere else at all"), (None, "only here and nowhere else at all")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA)
    got = sorted(str((r.doc_id, (r.text or "").lower().split())) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    want = sorted(str((rows[k][0], (rows[k][1] or "").lower().split())) for k in brute_kept(rows))
    assert got == want and len(rows) - len(want) > 60
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def template_texts(rng, n, shared, own):
    """Texts of one template: ``shared`` words are the same in all, ``own`` words are their own."""
    head = [f"t{k}" for k in range(shared)]
    return [" ".join([*head, *(f"x{rng.randrange(10**9)}" for _ in range(own))]) for _ in range(n)]


def test_pages_of_one_template_are_not_paired_up(spark, monkeypatch):
    """Texts that share two thirds of their words meet in many buckets; candidates grow with their number, not its square."""
    counts = []
    real = near.rare_pairs

    def counted(crowd, sets, similarity):
        out = real(crowd, sets, similarity)
        counts.append((crowd.count(), out.count()))
        return out

    monkeypatch.setattr(near, "rare_pairs", counted)
    rng = random.Random(6)
    texts = template_texts(rng, 3000, 200, 100)
    rows = [(k, t) for k, t in enumerate(texts)]
    # Near copies among them, of which few words differ.
    rows += [(5000 + k, texts[k] + " and more") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id for r in near.drop_near_copies(docs).select("doc_id").collect()}
    assert got == set(range(3000))
    classes, pairs = counts[0]
    assert classes > 1000 and pairs < 3 * classes


def test_rare_pairs_lose_none(spark):
    """Every pair of the similarity whose classes have different roots is a candidate, whatever the crowd."""
    rng = random.Random(8)
    texts = template_texts(rng, 30, 60, 20)
    for t in list(texts):
        words = t.split()
        for share in (0.01, 0.03, 0.08):
            texts.append(" ".join(w if rng.random() > share else f"y{rng.randrange(99)}" for w in words))
    sets = {k: near.shingles(t) for k, t in enumerate(texts)}
    held = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in sets.items()], "class bigint, set binary")
    roots = {k: k % 50 for k in sets}
    crowd = spark.createDataFrame([(k, r, 1 + r % 3) for k, r in roots.items()], "class bigint, root bigint, n bigint")
    got = {(r.a, r.b) for r in near.rare_pairs(crowd, held).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and roots[a] != roots[b] and near.similar(sets[a], sets[b])}
    assert want <= got and want


def test_near_dedup_stage_takes_the_links_of_simhash(spark, monkeypatch):
    rng = random.Random(9)
    text = rng.choices([f"w{k}" for k in range(500)], k=400)
    copy = [*text[:-1], "other"]
    docs = spark.createDataFrame([(1, " ".join(text), "en", "s", 1), (2, " ".join(copy), "en", "s", 1), (3, "of its own", "en", "s", 1)], SCHEMA)
    # Without a common bucket of MinHash the copy is found by its fingerprint alone.
    real = near.bands
    monkeypatch.setattr(near, "bands", lambda found: real(found) + len(found) * 0 + found.sum())
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
