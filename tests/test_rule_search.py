"""Rules of a table are found by their texts: brute force, blocks of rules, and a corpus that stays where it is."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from veilspark.functions.regex_check import required_sets
from veilspark.operators import rule_search, scan
from veilspark.operators.rule_search import TextSearch
from veilspark.rules import Rule, rule_index

PATTERNS = [
    "alpha +beta[a-z]*", "(?:alpha|gammas?) ?(?:beta|deltas)", "(?:with|beta)ing", "(?i)ALPHA[ =]+beta", r"x\Qa.b\Ey", "gamma.{0,9}delta", "(?:ab){2,}cd", "a{5}b+",
    r"\btoken=", "é漢xé+", "[0-9]{4}-[0-9]{2}", "alpha(?:beta|) (?:gamma|delta)?", "(?=alpha)alpha.beta",
]
WORDS = ["alpha", "Alpha", "beta", "betas", "gamma", "delta", "with", "ing", "xa.by", "abab", "cd", "aaaaabb", "token=", "é漢xé", "2024-01", "withing"]


def random_lines(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice(["", " ", "  ", "="]) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_a_match_holds_a_text_of_each_set():
    assert required_sets("cibo +seoses[a-z]*", 4) == [[" seoses"], ["cibo "]]
    assert required_sets("(?:with|that)ing", 4) == [["thating", "withing"]]
    assert required_sets(r"x\Qa.b\Ey", 4) == [["xa.by"]] and required_sets("[A-Z]{3}", 4) == required_sets("([", 4) == []
    for pattern in (p for p in PATTERNS if r"\Q" not in p):
        sets = required_sets(pattern, 4)
        for line in random_lines(500):
            low = "".join(c.lower() if c.isascii() else c for c in line)
            assert not re.search(pattern, line) or all(any(t in low for t in texts) for texts in sets), (pattern, line)


def test_the_search_finds_the_rules_whose_texts_a_line_holds(monkeypatch):
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("abcé ") for _ in range(rng.choice([4, 5, 8, 9, 12, 20])))
    rules = [[[text() for _ in range(rng.choice([1, 1, 3]))] for _ in range(rng.choice([1, 2, 3]))] for _ in range(300)]
    lines = ["".join(rng.choice("abcAB é") for _ in range(rng.randrange(90))) + rng.choice(rng.choice(rng.choice(rules))) for _ in range(300)]
    lines += ["".join(t for some in sets for t in some[:1]).upper().replace("É", "é") for sets in rules] + [None, "", "abc"]
    lines += ["c" * 1500 + "".join(t for some in rules[7] for t in some[:1]) + "c" * 1500]
    held = [{k for k, sets in enumerate(rules) if s is not None and all(any(t in s.lower().replace("É", "é") for t in some) for some in sets)} for s in lines]
    assert sum(map(len, held)) > 400
    for block, pairs in ((rule_search.BLOCK, rule_search.PAIRS), (64, 16)):
        monkeypatch.setattr(rule_search, "BLOCK", block)
        monkeypatch.setattr(rule_search, "PAIRS", pairs)
        search = TextSearch.of(vars(TextSearch(rules)))
        for found in (search.numbers(pa.array(lines)), search.numbers(pa.array(["abc", *lines])[1:])):
            found = found.to_pylist()
            assert all(own <= set(got) and got == sorted(set(got)) for own, got in zip(held, found, strict=True))
            assert sum(map(len, found)) < 1.3 * sum(map(len, held)) and found[-4] == []
    assert TextSearch([[["abcd"]]]).numbers(pa.array([], pa.string())).to_pylist() == []


def test_blocks_of_rules_find_what_unrolled_ones_do_and_move_no_line(spark, monkeypatch):
    lines = random_lines(300)
    rows = [(f"f{k % 40}", "\n".join(lines[k * 3 : k * 3 + 3])) for k in range(100)] + [(None, "alpha  betas\nalpha beta"), ("none", None)]
    df = spark.createDataFrame(rows, "path string, text string")
    # A pattern of many rules, rules of one id, and a null id.
    rules = [Rule(f"r{k}", p) for k, p in enumerate(PATTERNS)] + [Rule(f"same{k}", PATTERNS[0], "high") for k in range(40)] + [Rule("r0", "betas +[a-z]+")]
    table = spark.createDataFrame([(r.id, r.pattern, r.severity) for r in rules], "id string, pattern string, severity string")
    expected = sorted(map(str, scan.rule_matches(df, rules).collect()))
    assert len(expected) > 1000
    monkeypatch.setattr(scan, "RULE_BLOCK", 150)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = scan.table_matches(df, table)
        assert sorted(map(str, got.collect())) == expected
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    nameless = scan.scan_rule_table(df, spark.createDataFrame([(None, "alpha +betas"), (None, None)], "id string, pattern string"))
    assert {(r.severity, r.rule_id) for r in nameless.collect()} == {("medium", None)}


def test_rules_of_one_pattern_are_judged_by_all_cores(spark):
    table = spark.range(200).selectExpr("concat('r', id) AS id", "'alpha +beta' AS pattern").coalesce(1)
    index = rule_index(table.union(table))
    assert index.count() == 200
    assert index.select("id", F.spark_partition_id().alias("p")).select("p").distinct().count() >= spark.sparkContext.defaultParallelism
