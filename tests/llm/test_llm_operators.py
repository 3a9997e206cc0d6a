"""The ten operators against brute force, round trips and edge cases."""

from __future__ import annotations

import difflib
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.llm import chat, decontaminate, katz, language, lines, packing, pages, sharding, simhash, topk
from veilspark.llm.components import connected_components

DOCS = "doc_id bigint, text string, lang string, key string, row int"
WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]


def said(n: int, seed: int, stops: bool = True) -> str:
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = rng.choice(WORDS) + rng.choice(WORDS)
        out.append(w + ("." if stops and rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.03 else " "))
    return "".join(out).strip()


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "k", 1) for i, t in texts], DOCS)


# --- 1 chat


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    pick = lambda parts: "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
    rows = [(pick(["<|", "\\", "\n", "\\n", "a", "|", "<"]), pick(["<|", "<", "|", "\\", "im_end", "|>", "\n", chat.END, chat.START])) for _ in range(800)]
    df = spark.createDataFrame(rows, "role string, text string")
    turn = F.concat(F.lit(chat.START), chat._role(F.col("role")), F.lit("\n"), chat.escaped(F.col("text")), F.lit(chat.END + "\n"))
    for row in df.select("role", "text", turn.alias("f")).select("*", chat.parsed(F.col("f")).alias("t")).collect():
        assert [(t.role, t.text) for t in row.t] == [(row.role, row.text)]
        assert row.f.count("<|") == 2


def test_chat_round_trip(spark):
    nasty = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", nasty), (1, 1, "assistant", nasty), (1, 2, None, None), (2, 5, "assistant", "<\\|x<<|"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = {r.tree_id: r for r in chat.formatted_trees(chat.chains(df)).withColumn("t", chat.parsed(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("t"))).collect()}
    assert set(out) == {1, 2}
    assert [tuple(t) for t in out[1].t] == [("user", "hi"), ("assistant", nasty), ("assistant", nasty), ("", "")]
    assert out[1].loss == nasty * 2
    assert out[2].loss == "<\\|x<<|"
    assert chat.formatted_trees(chat.chains(df.limit(0))).count() == 0


def test_reply_paths_against_recursion(spark):
    rng = random.Random(5)
    rows, parent = [], {}
    for tree in range(3):
        for n in range(40):
            p = None if n == 0 else rng.choice([n - 1, n - 1, rng.randrange(n)])
            parent[tree, n] = p
            rows.append((tree, n, p, float(rng.randrange(5))))
    rows += [(9, 1, 2, 1.0), (9, 2, 1, 1.0), (9, 3, 2, 1.0), (8, 1, 77, None), (7, 1, 1, 0.0), (6, None, None, 1.0)]
    nodes = spark.createDataFrame(rows, "tree_id bigint, node_id bigint, parent_id bigint, score double")
    score = {(t, n): s or 0.0 for t, n, _, s in rows}
    want = defaultdict(list)
    for tree in range(3):
        inner = {p for (t, _), p in parent.items() if t == tree}
        for leaf in (n for n in range(40) if n not in inner):
            path, at = [], leaf
            while at is not None:
                path.insert(0, at)
                at = parent[tree, at]
            want[tree].append((-sum(score[tree, n] for n in path) / len(path), leaf, path))
    got = defaultdict(dict)
    for r in chat.reply_paths(nodes).collect():
        got[r.tree_id].setdefault((r["rank"], r.leaf_id), {})[r.depth] = r.node_id
    for tree in range(3):
        assert {k: [v[d] for d in range(len(v))] for k, v in got[tree].items()} == {(i + 1, leaf): path for i, (_, leaf, path) in enumerate(sorted(want[tree]))}
    assert 9 not in got and 6 not in got
    assert set(got[8]) == {(1, 1)}
    assert {r["rank"] for r in chat.reply_paths(nodes, branches=1).collect()} == {1}


# --- 2 lines


def brute_lines(texts, min_words=lines.MIN_WORDS):
    """The same definition, with dictionaries: later runs of UNITS units go if marked units together have enough words."""
    first, marked = {}, defaultdict(set)
    for key, text in texts:
        u = lines.Units(text)
        pieces = [bytes(u.data[s:e]).lower().split() for s, e in zip(u.starts, u.ends)]
        for at in range(len(pieces) - lines.UNITS + 1):
            run = str(pieces[at : at + lines.UNITS])
            if run not in first:
                first[run] = key, at
            else:
                fk, fa = first[run]
                start = max(at, fa + lines.UNITS) if fk == key else at
                marked[key].update(range(start, at + lines.UNITS))
    left = {}
    for key, text in texts:
        u, out, at = lines.Units(text), [], 0
        while at < len(u.starts):
            stop = at
            while stop in marked[key]:
                stop += 1
            if stop > at and stop - at >= min_words:
                at = stop
                continue
            for k in range(at, max(stop, at + 1)):
                out += bytes(u.data[u.starts[k] : u.ends[k]]).decode().split()
            at = max(stop, at + 1)
        left[key] = out
    return left


def test_line_dedup_against_brute_force(spark):
    passage, line = said(60, 1), said(9, 2)
    texts = [(k, said(80, 10 + k) + " " + passage + (" " if k % 2 else "\n") + line + "\n" + said(50, 50 + k)) for k in range(12)]
    texts += [(20, texts[3][1]), (21, "Ha ha. " * 120), (22, said(60, 99) + "\n" + said(60, 99)), (23, ""), (24, passage.upper()), (25, "one two")]
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, texts), removed="gone").collect()}
    want = brute_lines(texts)
    for key, text in texts:
        assert got[key].text.split() == want[key], key
        assert got[key].gone == len(text.split()) - len(want[key])
    assert got[0].text == texts[0][1]
    assert got[20].text == "" and got[24].text == ""
    assert passage.split()[20] not in got[5].text.split()
    assert got[3].lang == "en" and got[3].row == 1


def test_line_dedup_edges(spark):
    long = said(100, 3)
    rows = [(None, long), (1, long), (1, long), (2, None), (3, "   \n\n")]
    got = sorted(lines.dedup_lines(frame(spark, rows)).collect(), key=str)
    assert Counter((r.doc_id, r.text) for r in got) == Counter({(None, long): 1, (1, ""): 2, (2, None): 1, (3, "   \n\n"): 1})
    assert lines.dedup_lines(frame(spark, rows).limit(0)).count() == 0


@given(st.integers(0, 10**6))
@settings(max_examples=30, deadline=None)
def test_equal_runs_share_a_fingerprint(seed):
    rng = np.random.default_rng(seed)
    own = rng.integers(0, 2**63, 40, dtype=np.uint64)
    shared = rng.integers(0, 2**63, lines.UNITS, dtype=np.uint64)
    a, b = np.r_[own[:13], shared, own[13:20]], np.r_[own[20:29], shared, own[29:]]
    assert set(lines.fingerprints(a)[0]) & set(lines.fingerprints(b)[0])


# --- 3 language


def test_language_learns_and_finds_mixtures(spark):
    def own(letters, n, seed):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))

    a, b = "abcdefgh", "mnopqrst"
    rows = [(k, own(a if k % 2 else b, 60, k), "aa" if k % 2 else "bb", "x", 1) for k in range(60)]
    docs = spark.createDataFrame([*rows, (100, None, "aa", "", 0), (101, "12 !", None, "", 0)], DOCS)
    model = language.fit(spark, docs.where("doc_id < 40 or doc_id >= 100"))
    mixed = own(a, 70, 900) + " " + own(b, 30, 901)
    tests = [*rows[40:], (200, mixed, None, "", 0), (201, None, None, "", 0), (202, "", None, "", 0), (203, "123 ?!", None, "", 0), (None, rows[1][1], None, "", 0)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(tests, DOCS).withColumn("score", F.lit("old")), model).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang, _, _ in rows[40:])
    assert got[200].lang_pred == "aa" and 0.6 < got[200].score < 0.8 and {m.lang for m in got[200].lang_mix} == {"aa", "bb"}
    assert [got[k].lang_pred for k in (201, 202, 203)] == ["und"] * 3
    assert got[None].lang_pred == "aa" and got[41].lang == "aa"
    nothing = language.fit(spark, docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


# --- 4 pages


def test_main_text_of_pages():
    long = "The house of the king was on the hill, and it is said that they were there for all of the summer with her."
    page = f"""<!doctype html><html><head><title>T</title><style>p {{}}</style></head><body><header><p>{long}</p></header>
    <nav><ul><li><a href=x>{long}</a></ul></nav><div class="cookie-notice"><p>{long} Accept</div>
    <article class=post><h1>Head &amp; <i>tail</i></h1><p>{long}<br>More&nbsp;text  here<p>Be.<script>if (a<b) {{ "</p>" }}</script>
    <aside><p>{long}</p></aside><p>Last&#33;</p><form><p>{long}</p></form><!-- <p>{long}</p> --></article>
    <div id="comments"><article><p>{long}</p></article></div><footer><p>{long}</p></footer>"""
    assert pages.main_text(page) == f"Head & tail\n\n{long} More text here\n\nBe.\n\nLast!"
    plain = f"<body><div><a href=/>Home</a> <a href=/b>News today</a></div><div><h2>Short head</h2>{long}<div>Yes.</div><p>{long}</div><div class=footer>(c) 2020</div>"
    assert pages.main_text(plain) == f"Short head\n\n{long}\n\nYes.\n\n{long}"
    assert [pages.main_text(x) for x in (None, "", "<", "<p", "<!--", "<script>x")] == ["", "", "<", "", "", ""]
    assert pages.main_text("a < b and <b>c</b>d") == "a < b and cd"


def test_main_text_keeps_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "old"), (1, "u", None, "old"), (None, None, "", None)], "page_id int, url string, html string, text string")
    got = pages.extract_main_text(df)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id or 0, r.text) for r in got.collect()) == [(0, ""), (1, ""), (1, "x")]


@given(st.text(alphabet="<>/apdiv!-\"'= &;#x1\n", max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_page_parses(page):
    assert "\n\n\n" not in pages.main_text(page)


# --- 5 decontamination


def brute_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def changed(text, edits, seed):
    rng, s = random.Random(seed), list(text)
    for _ in range(edits):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        s[at : at + 1] = ["z"] if kind == 0 else [] if kind == 1 else [s[at], "q"]
    return "".join(s)


def test_decontamination_against_brute_force(spark):
    items = [(k, said(rng_n, 700 + k, False)) for k, rng_n in enumerate((9, 14, 20, 5, 3))] + [(10, ""), (11, None), (12, "xyz")]
    texts = [(0, said(60, 1)), (1, ""), (2, None), (3, "w XYZ w")]
    n = 10
    for k, item in items[:5]:
        for share in (0.0, 0.04, 0.08, 0.12, 0.2, 0.3):
            texts.append((n, said(25, n) + " " + changed(item, int(share * len(item)), n) + " \n" + said(25, n + 900)))
            n += 1
    texts.append((99, items[0][1] + "\n\n" + items[1][1].upper().replace(" ", "  ")))
    docs = frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminations(docs, bench).collect()}
    want = {}
    for d, t in texts:
        for i, x in items:
            p = decontaminate.normalised(x)
            k = min(int(len(p) * decontaminate.BUDGET), max(len(p) - decontaminate.Q, 0) // decontaminate.Q)
            if p and (e := brute_edits(p, decontaminate.normalised(t))) <= k:
                want[d, i] = e
    assert got == want and len(want) > 15
    clean = {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()}
    assert clean == {d for d, _ in texts} - {d for d, _ in want}
    assert decontaminate.contaminations(docs.limit(0), bench).count() == 0
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == len(texts)


# --- 6 packing


def test_packing_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    texts = [(k, said(40 * k + 1, k)) for k in range(12)] + [(20, None), (21, ""), (22, "ñandú über 日本語 <|endoftext|> x"), (22, "again"), (None, "no key")]
    rows = packing.pack(frame(spark, texts).repartition(3), path, length=128).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 128 or s == len(sequences) - 1
    docs = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        docs[r.doc_id, r.doc_tokens].append(np.frombuffer(r.ids, "<u4"))
    for key, text in texts:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        assert np.concatenate(docs[key, len(ids)]).tolist() == ids
    assert packing.pack(frame(spark, texts).limit(0), path).count() == 0


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_pieces_are_the_tokenizer(text):
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")) if not _ENCODER else _ENCODER[0]
    _ENCODER[:] = [encoder]
    assert encoder.fast is not None
    for t in (text, text.encode("ascii", "ignore").decode(), f"it's {text}'ll  \n\n {text}", f"<|endoftext|>{text}", "\u0378\u1c89 " + text):
        t = t.encode("utf-8", "ignore").decode()
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == encoder.whole(t)


_ENCODER: list = []


# --- 7 simhash


def brute_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, near):
    root = {k: k for k in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in items}


@pytest.mark.parametrize(("at_once", "distance"), [(256, 4), (3, 4), (2, 3), (3, 5)])
def test_links_against_all_pairs(spark, monkeypatch, at_once, distance):
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    rng = random.Random(at_once * 10 + distance)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(25):
            x = base
            for _ in range(rng.randrange(1, 7)):
                x ^= 1 << rng.randrange(0, 64, rng.choice([1, 9]))
            fps.add(x)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
    own = sorted(signed.values())
    near = [(a, b) for i, a in enumerate(own) for b in own[:i] if (a ^ b & (1 << 64) - 1).bit_count() <= distance or ((a ^ b) & (1 << 64) - 1).bit_count() <= distance]
    want = brute_components(own, near)
    df = spark.createDataFrame([(x,) for x in own], "fp bigint")
    # The threshold is read in tasks, so it travels as a closure of the module's value there.
    got = {r.fp: r.root for r in simhash.linked(df, distance).collect()}
    assert {k: got.get(k, k) for k in own} == want


def test_simhash_of_documents(spark):
    base = said(300, 7)
    words = base.split()
    texts = [(k, " ".join([*words[:k], "x" * (k + 1), *words[k + 1 :]])) for k in range(30)] + [(40 + k, said(60, 40 + k)) for k in range(10)]
    texts += [(60, None), (61, ""), (62, " \n\t"), (63, "one"), (64, "ONE"), (65, "one two three"), (66, base.upper()), (None, "one"), (63, "one")]
    got = simhash.simhash_components(frame(spark, texts)).collect()
    fps = {(k, t): brute_fingerprint(t) for k, t in texts}
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == Counter((k, fps[k, t]) for k, t in texts)
    ids = {k: fps[k, t] for k, t in texts if k is not None}
    near = [(a, b) for a in ids for b in ids if b < a and (ids[a] ^ ids[b]).bit_count() <= 4]
    want = brute_components(ids, near)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    kept = [r.doc_id for r in simhash.drop_near_copies(frame(spark, texts)).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(want.values())) and kept.count(None) == 1
    assert simhash.simhash_components(frame(spark, texts).limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(500, 600)] + [(1000, k) for k in range(1001, 1100)]
    df = spark.createDataFrame([*edges, (None, 5), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(df).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == brute_components(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(df.limit(0)).count() == 0


# --- 8 language model


def brute_katz(rows):
    """Bigram model by dictionaries, from the definition."""
    begin = object()
    uni, pairs = Counter(), Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    for text, trains in rows:
        if trains:
            ws = tokens(text)
            uni.update(ws)
            pairs.update(zip([begin, *ws[:-1]], ws))
    n, v = sum(uni.values()), len(uni)
    histogram = lambda c: [sum(x == r for x in c.values()) for r in range(1, 7)]
    d1, d2 = katz.discounts(histogram(uni)), katz.discounts(histogram(pairs))
    low = lambda c: min(c, 6)
    p1 = {w: d1[low(c)] * c / n for w, c in uni.items()}
    unknown = 1 - sum(p1.values()) if n else 1.0
    context, after = Counter(), defaultdict(list)
    for (a, b), c in pairs.items():
        context[a] += c
        after[a].append(b)

    def p(a, b):
        if pairs[a, b]:
            return d2[low(pairs[a, b])] * pairs[a, b] / context[a]
        alpha = 1.0
        if context[a]:
            alpha = (1 - sum(d2[low(pairs[a, w])] * pairs[a, w] / context[a] for w in after[a])) / (1 - sum(p1[w] for w in after[a]))
        return alpha * p1.get(b, unknown)

    out = []
    for text, _ in rows:
        ws = tokens(text)
        base = sum(np.log10((uni[w] + 1) / (n + v + 1)) for w in ws)
        out.append((len(ws), sum(uni[w] > 0 for w in ws), n, base, sum(np.log10(p(a, b)) for a, b in zip([begin, *ws[:-1]], ws))))
    for a in [begin, *list(uni)[:20]]:
        assert abs(sum(p(a, w) for w in [*uni, b"never seen"]) - 1) < 1e-9
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_katz_against_definition(spark, monkeypatch, seed):
    rng = random.Random(seed)
    vocabulary = [WORDS[int(rng.paretovariate(0.6)) % 300] for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + [None, "", "unseen Words", texts_word := "The the THE"]
    rows = [(k, t) for k, t in enumerate(texts)]
    df = frame(spark, rows).repartition(3)
    got = {r.doc_id: r for r in katz.katz_scores(df, "doc_id % 7 != 2").collect()}
    want = brute_katz([(t, k % 7 != 2) for k, t in rows])
    for (k, _), (n, known, train, base, score) in zip(rows, want):
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(score, abs=1e-6), k


def test_katz_edges(spark):
    rows = [(None, "a b a"), (1, "a b a"), (1, "a b a"), (2, None)]
    got = katz.katz_scores(frame(spark, rows), "doc_id = 1").collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.train_tokens) for r in got) == [(0, 4, 8), (1, 4, 8), (1, 4, 8), (2, 1, 8)]
    nothing = katz.katz_scores(frame(spark, rows), "false").collect()
    assert {(r.n_known, r.base_score, r.score) for r in nothing} == {(0, 0.0, 0.0)}
    assert katz.katz_scores(frame(spark, rows).limit(0), "true").count() == 0
    three = katz.katz_scores(frame(spark, rows), "true", order=3).collect()
    assert all(r.score <= 0 for r in three)


def test_trigrams_add_up(spark):
    """Probabilities of all continuations of a context sum to one at order 3."""
    train = [(k, said(30, k % 4, False)) for k in range(12)]
    words = sorted({w for _, t in train for w in t.lower().split()})
    head = " ".join(train[0][1].split()[:2])
    tests = [(100 + k, f"{head} {w}") for k, w in enumerate([*words, "neverseen"])] + [(99, head)]
    got = {r.doc_id: r.score for r in katz.katz_scores(frame(spark, train + tests), "doc_id < 99", order=3).collect()}
    ends = {r.doc_id: r.score for r in katz.katz_scores(frame(spark, train + [(k, f"{t}") for k, t in tests]), "doc_id < 99", order=1).collect()}
    assert len(ends) == len(got)
    # Text scores hold the end token too: P(head, w, end) summed over all words and P(head, end) are at most P(head).
    total = sum(10 ** got[k] for k, _ in tests)
    assert 0 < total < 1


# --- 9 top-k


@pytest.mark.parametrize("big", [False, True])
def test_topk_against_all_pairs(spark, big):
    rng = np.random.default_rng(4)
    vectors = [(k, (rng.normal(size=20) * (2**19 if big else 1)).tolist()) for k in range(300)]
    vectors[7] = (7, vectors[100][1])
    vectors[50] = (50, [0.0] * 20)
    vectors += [(301, None), (302, [1.0, None]), (303, [float("nan")] * 20), (304, [float("inf")] * 20), (None, [1.0] * 20), (305, []), (306, [2.0, -3.0])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    rows = topk.quantized(df)
    got = defaultdict(list)
    for r in topk.top_inner_products(rows.where("id % 50 = 0"), rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    sound = {k: [int(np.floor(256 * x)) for x in v] for k, v in vectors if k is not None and k < 301 or k in (305, 306)}
    for q in range(0, 301, 50):
        if q not in sound:
            continue
        scores = sorted((-sum(a * b for a, b in zip(sound[q], v)), k) for k, v in sound.items() if k != q)[:5]
        if max(abs(s) for s, _ in scores) < 2**63:
            assert got[q] == [(i + 1, k, -s) for i, (s, k) in enumerate(scores)]
    assert topk.top_inner_products(rows.limit(0), rows).count() == 0 and topk.top_inner_products(rows, rows.limit(0)).count() == 0


# --- 10 sharding


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (1, 4)])
def test_hilbert_curve_is_continuous(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, rng.choice(["en", "fr", None]), f"src{rng.randrange(9)}", rng.choice([None, *range(50)])) for k in range(501)] + [(3, "en", "src1", 4)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, size bigint")
    got = sharding.hilbert_shards(df, ["lang", "source", "size"], 24, ["doc_id"])
    shards = defaultdict(list)
    for r in got.collect():
        shards[r.shard].append(r.slot)
    assert sorted(shards) == list(range(24)) and {len(s) for s in shards.values()} == {21}
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    sharding.write_shards(got, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and {r.shard for r in back.select("shard").distinct().collect()} == set(range(24))
    few = sharding.hilbert_shards(df.limit(5), ["lang", "size"], 24, ["doc_id"]).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(k, 0) for k in range(5)]
    assert sharding.hilbert_shards(df.limit(0), ["lang", "size"], 24, ["doc_id"]).count() == 0
