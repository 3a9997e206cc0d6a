"""What the queries need on larger tables: work spread over tasks, errors looked for once, folders as tables."""

import os

from pyspark.sql import functions as F

from veilspark.operators import diff
from veilspark.operators.context import redact_file
from veilspark.operators.python_syntax import syntax_errors
from veilspark.operators.rename import private_definitions
from veilspark.operators.scan import UNROLLED, scan_rule_table
from veilspark.plans import inputs, registry
from veilspark.sources import corpus as src

SF = "/root/testdata/sf0.001"
# A piece of a pattern that the search for syntax errors uses once.
SIGN = r"\*\*=|//=?|<<=?"


def searches(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count(SIGN)


def test_syntax_errors_are_looked_for_once(spark, corpus):
    files = corpus(a__py="def f(x)\n    return 1\n", b__py="x = 1\n", c__js="f({")
    assert {r.path: r.error for r in syntax_errors(files).collect()} == {"a.py": "a header without a colon", "c.js": "unbalanced brackets"}
    assert searches(syntax_errors(files)) == 1
    assert searches(redact_file(files, strict=True)) == 1
    assert searches(private_definitions(files)) == 1


def test_edits_and_counts_are_not_sent_through_the_driver(spark, corpus, tmp_path):
    """A small file makes texts many times its size, so its size tells nothing of the sides of a join."""
    corpus(a__js="function f(x) { return x; }\n", b__py="def f(x):\n    return x\n").write.parquet(str(tmp_path / "code"))
    df = spark.read.parquet(str(tmp_path / "code"))
    for made in (redact_file(df, strict=True), diff.diff_counts(df, strict=True), diff.diff_context(df)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.path: r.function_bodies_redacted for r in diff.diff_counts(df, strict=True).collect()} == {"a.js": 1, "b.py": 1}


def test_rows_of_one_path_with_and_without_an_error_stay_apart(spark):
    rows = [("a.py", "def f(x):\n    return 1\n"), ("a.py", "def f(x)\n"), ("a.py", "def f(x)\n"), ("a.py", ""), ("a.py", None)]
    view = redact_file(spark.createDataFrame(rows, "path string, text string")).collect()
    got = sorted((r.text or "-", r.error or "", r.bodies) for r in view)
    colon = "a header without a colon"
    assert got == [("-", "", 0), ("-", colon, 0), ("-", colon, 0), ("-", "unreadable", 0), ("def f(x):\n    ...\n", "", 1)]
    assert sum(r.text == "" for r in view) == 1


def test_code_of_a_narrow_table_is_made_by_all_cores(spark):
    for files in (inputs.code_files, inputs.broken_files, inputs.faulty_files, inputs.repo_code):
        used = files(spark, SF).select(F.spark_partition_id().alias("p")).distinct().count()
        assert used >= spark.sparkContext.defaultParallelism, files.__name__


def test_a_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    rows = [(1, "mail a@b.org", "en", "s", 12), (2, "nothing", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.path for r in registry.scan_stream(spark, str(tmp_path)).collect()] == ["1"]


def test_files_are_written_by_many_tasks(spark, monkeypatch):
    read, roots = src.read_corpus, []
    monkeypatch.setattr(src, "read_corpus", lambda spark, root, **more: roots.append(root) or read(spark, root, **more))
    registry.read_corpus(spark, SF)
    writers = {name.split("-")[1] for _, _, names in os.walk(roots[0]) for name in names if name.endswith(".txt")}
    assert len(writers) > 1


def test_deliveries_are_written_by_many_tasks(spark, monkeypatch):
    fresh, folders = registry._fresh, {}
    monkeypatch.setattr(registry, "_fresh", lambda spark, name: folders.setdefault(name, fresh(spark, name)))
    assert registry.scan_changes(spark, SF).count() > 0
    written = [name for name in os.listdir(folders["deliveries"]) if name.endswith(".parquet")]
    assert len(written) >= 2 * spark.sparkContext.defaultParallelism


def test_a_pattern_of_many_rules_is_tried_once(spark, corpus):
    files = corpus(a="2024-01-02 a7b 1999-12-31", b="none")
    own = [(f"r{k}", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "low") for k in range(UNROLLED + 6)]
    dates = scan_rule_table(files, spark.createDataFrame(own, "id string, pattern string, severity string"))
    assert "r69" not in dates._jdf.queryExecution().optimizedPlan().toString()
    found = dates.collect()
    assert len(found) == 2 * len(own) and {r.rule_id for r in found} == {f"policy/{i}" for i, _, _ in own} and {r.severity for r in found} == {"low"}
    # More patterns than are unrolled, one of which the engine can't compile: the same findings by rows.
    each = [(f"q{k}", f"[{chr(97 + k % 26)}]{k // 26}|a[0-9]b", "high") for k in range(UNROLLED + 6)]
    many = scan_rule_table(files, spark.createDataFrame(each, "id string, pattern string, severity string")).collect()
    assert sorted(r.rule_id for r in many) == sorted(f"policy/{i}" for i, _, _ in each)
