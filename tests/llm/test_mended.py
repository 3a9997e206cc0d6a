"""Forms around pages, whole values in shards, clashing names, the pipeline against brute force, and imports."""

from __future__ import annotations

import os
import random
import subprocess
import sys
import textwrap

import public_tokenizers
import pytest
import corpus_pipeline
from veilspark.llm import lines, pages, sharding, simhash, topk

LONG = "The house of the king was on the hill, and it is said that they were there for all of the summer with her."
NAMES = "Lamp chair table mirror carpet curtain pillow blanket sofa shelf drawer cabinet wardrobe mattress stool bench desk rack hook basket vase candle frame"


@pytest.mark.parametrize("wrapper", ["form id=aspnetForm", "main><form", "form action='/x'><div class=page", "div role=form"])
def test_a_form_around_the_page_keeps_its_text(wrapper):
    names = [p.split()[0] for p in wrapper.split("><")]
    page = f"<body><nav><a href=x>Home</a></nav><{wrapper}><h1>Head</h1><p>{LONG}</p><p>{LONG}</p>" + "".join(f"</{n}>" for n in reversed(names)) + "</body>"
    assert pages.main_text(page) == f"Head\n\n{LONG}\n\n{LONG}"


def test_a_form_beside_the_text_goes():
    page = f"<body><form><p>Search for all of the words that you want</p><input></form><article><p>{LONG}</p></article><form><p>{LONG}</p></form></body>"
    assert pages.main_text(page) == LONG
    assert pages.main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div><form><p>{LONG} Write to us</p></form>") == f"{LONG}\n\n{LONG}"


def test_long_lists_of_names_are_no_text():
    page = f"<div><p>{LONG} {LONG}</p><p>{LONG}</p></div><div>{NAMES}</div>"
    assert pages.main_text(page) == f"{LONG} {LONG}\n\n{LONG}"
    assert NAMES in pages.main_text(f"<article><p>{LONG} {LONG}</p><p>{NAMES}</p><p>{LONG}</p></article>")
    # Of a language whose stop words aren't known, long blocks are text.
    assert pages.main_text(f"<div><p>{NAMES}</p></div>") == NAMES


def test_shards_by_whole_values(spark):
    rng = random.Random(5)
    rows = [(k, f"https://example.org/source_{rng.randrange(64):03d}", rng.randrange(1000), "c", 1) for k in range(4096)]
    rows += [(5000 + k, None, None, "c", 1) for k in range(5)]
    df = spark.createDataFrame(rows, "id bigint, source string, size int, curve string, __rank int").repartition(5)
    cuts = sharding.weighted_cuts(df, "source", 8)
    counts = [sum(sum(s is not None and c <= s for c in cuts) == k for _, s, *_ in rows) for k in range(len(cuts) + 1)]
    assert len(cuts) == 7 and max(counts) < 4096 / 8 * 1.4
    done = sharding.hilbert_shards(df, ["source", "size"], 16, ["id"])
    assert "__rank" in done.columns
    sizes = [r["count"] for r in done.groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 1
    # A shard's files hold few sources: a filter on one reads a part of the shards.
    spread = done.where("source = 'https://example.org/source_017'").select("shard").distinct().count()
    assert spread <= 8
    one = spark.createDataFrame([(k, "same", k, "c", 1) for k in range(300)], df.schema)
    assert sharding.weighted_cuts(one, "source", 8) == [] and sharding.weighted_cuts(df.limit(0), "source", 8) == []
    assert sharding.hilbert_shards(one, ["source", "size"], 3, ["id"]).groupBy("shard").count().count() == 3


def test_line_dedup_with_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, 5, "a"), (2, f"x {text} y", 6, "b"), (2, f"x {text} y", 6, "b"), (None, None, 7, "c"), (3, "", 8, "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __row int, __told string")
    got = sorted(map(tuple, lines.dedup_lines(df, removed="gone").collect()), key=str)
    assert got == sorted([(1, text, 5, "a", 0), (2, "x y", 6, "b", 60), (2, "x y", 6, "b", 60), (None, None, 7, "c", 0), (3, "", 8, "d", 0)], key=str)


def words_of(rng, n):
    return " ".join(rng.choice("bcdfgklm") + rng.choice("aeiou") + rng.choice("nrst") + rng.choice(["", "a", "en", "or"]) for _ in range(n))


def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch):
    """Planted copies, passages, benchmark items and clean documents: which go, and what is left of the texts."""
    rng = random.Random(17)
    clean = {k: words_of(rng, 120) for k in range(40)}
    passage, item = words_of(rng, 70), words_of(rng, 50)
    docs = dict(clean)
    # A near copy: one word of 120 differs, so that over 0.9 of its shingles are shared.
    words = clean[3].split()
    docs[100] = " ".join([*words[:60], "other", *words[61:]])
    docs[101] = clean[5]
    docs[110] = words_of(rng, 40) + " " + passage + " " + words_of(rng, 40)
    docs[111] = (head := words_of(rng, 60)) + " " + passage + " " + (tail := words_of(rng, 60))
    docs[120] = words_of(rng, 80) + " " + item + " " + words_of(rng, 80)
    docs[130], docs[131], docs[132] = None, "", "123 456 ..."
    rows = [(k, t, "xx", "s", len(t or ""), 0.5, "keep") for k, t in docs.items()]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, lang_pred string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    held = corpus_pipeline.stored

    def watched(df, label):
        out = held(df, label)
        kept[label] = out
        return out

    monkeypatch.setattr(corpus_pipeline, "stored", watched)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    at = {name: {r.doc_id: r for r in kept[f"stage-{name}"].collect()} for name, _ in corpus_pipeline.STAGES[:-1]}
    assert set(at["language_id"]) == set(docs) - {130, 131, 132}
    assert all(r.score == 0.5 and r.lang_pred == "keep" for r in at["language_id"].values())
    # The second place of a passage goes; the copies' texts become empty or nearly so.
    texts = {k: r.text for k, r in at["line_dedup"].items()}
    assert texts[111].split() == (head + " " + tail).split() and passage in texts[110]
    assert all(texts[k] == t for k, t in clean.items()) and texts[101] == ""
    assert all(r.n_chars == len(r.text) for r in at["line_dedup"].values())
    assert set(clean) | {110, 111} <= set(at["near_dedup"])
    assert set(at["decontamination"]) == set(at["near_dedup"]) - {120}
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(path)
    n = {k: len(tokens.encode(r.text, add_special_tokens=False).ids) + 1 for k, r in at["decontamination"].items()}
    got: dict[int, int] = {}
    for r in pieces:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == n[r.doc_id]
    assert got == n


def test_other_queries_without_a_module_of_the_corpus_operators():
    """Without one of their modules the corpus operators are left out, and all other queries are there."""
    code = textwrap.dedent("""
        import sys
        class Missing:
            def find_spec(self, name, path=None, target=None):
                if name.split(".")[0] == "zstandard":
                    raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        sys.meta_path.insert(0, Missing())
        import __spark_entry__ as e
        assert "scan_rules" in e.queries() and "op1_chat" not in e.queries() and "pipeline" not in e.queries()
    """)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_the_line_of_a_20_mb_text_takes_bounded_memory():
    """Words are hashed by blocks: the helpers keep little more than the places of the words."""
    code = "import resource, numpy as np\nfrom veilspark.llm import lines\nt = 'abcde fghij ' * 1_700_000\nbefore = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nu = lines.Units(t)\nassert len(u.hashes) == 3_400_000\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120, capture_output=True, text=True)
    assert int(done.stdout) / 1024 < 500


def test_topk_in_several_blocks_is_that_of_one(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(k, [rng.uniform(-1, 1) for _ in range(12)]) for k in range(400)], "vec_id bigint, embedding array<double>")
    rows = topk.quantized(df)
    queries = rows.where("id % 5 = 0")
    one = topk.top_inner_products(queries, rows).collect()
    many = topk.top_inner_products(queries, rows, block_bytes=1500).collect()
    assert sorted(one) == sorted(many) and len(one) == 400


def test_simhash_of_a_crowd_of_copies(spark):
    """Copies that hold most of all rows are joined where they lie; the result is that of the plain definition."""
    rows = [(k, "one two three four five") for k in range(300)] + [(1000 + k, words_of(random.Random(k), 30)) for k in range(20)] + [(None, None), (2000, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.simhash_components(df).collect()}
    prints = {k: simhash.fingerprint(t) for k, t in rows}
    signed = {k: p - (1 << 64) if p >= 1 << 63 else p for k, p in prints.items()}
    assert {k for k, _ in got} == set(prints) and all(got[k, signed[k]] == 0 for k in range(300))
    assert got[None, 0] == got[2000, 0] == 2000
