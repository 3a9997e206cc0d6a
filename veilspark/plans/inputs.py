"""Corpora for the registered queries: the given tables and views derived from them.

The derived expressions are SQL that Spark and DuckDB read alike, so a query and its oracle see the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.rules import Rule
from veilspark.session import spread
from veilspark.sources.corpus import corpus_from_table

CODE_PATH = "concat('src/p', CAST(p_partkey AS string), CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '.js' END)"
CODE_TEXT = r"""CASE WHEN p_partkey % 2 = 0 THEN concat(
 '\"\"\"Part ', p_name, '.\"\"\"', chr(10), 'from enum import Enum', chr(10), chr(10),
 'class Size(str, Enum):', chr(10), '    SMALL = "S"', chr(10), '    LARGE = "L"', chr(10), chr(10),
 '_RATES_', CAST(p_partkey AS string), ' = {', chr(10), '    "base": ', CAST(p_size AS string), ',', chr(10), '}', chr(10), chr(10),
 'def _helper(x):', chr(10), '    \"\"\"Return the rate.\"\"\"', chr(10), '    if x:', chr(10), '        return x * ', CAST(p_size AS string), chr(10), chr(10),
 'class Part:', chr(10), '    \"\"\"A part.\"\"\"', chr(10), chr(10), '    def total(self, x):', chr(10), '        return _helper(x)', chr(10))
 ELSE concat(
 'const _TABLE_', CAST(p_partkey AS string), ' = { base: ', CAST(p_size AS string), ' };', chr(10),
 'if (go) { function _helper(x) { if (x) { return ', CAST(p_size AS string), '; } return obj._helper; } }', chr(10),
 'function _rate(x) { return x * ', CAST(p_size AS string), '; }', chr(10),
 'class A { m(a, b) { return _rate(a); } }', chr(10),
 'export const total = (x) => { return _rate(x) * obj._rate; };', chr(10)) END""".replace('\\"', '"')
REPO = "concat('repo', CAST(o_custkey AS string))"
REL = """concat(CASE o_orderkey % 5 WHEN 0 THEN 'src/' WHEN 1 THEN 'lib/' WHEN 2 THEN 'src/pricing/' WHEN 3 THEN '' ELSE 'build/' END,
 CASE WHEN o_orderkey % 11 = 0 THEN 'package.json' WHEN o_orderkey % 13 = 0 THEN 'pyproject.toml' WHEN o_orderkey % 17 = 0 THEN 'tsconfig.json'
 ELSE concat('f', CAST(o_orderkey AS string), CASE o_orderkey % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.TS' WHEN 3 THEN '.tsx'
 WHEN 4 THEN '.pyc' WHEN 5 THEN '.md' WHEN 6 THEN '.PY' ELSE '' END) END)"""
# Code of which a part has an unmatched bracket at its end.
BROKEN_TEXT = f"concat({CODE_TEXT}, CASE WHEN p_size > 40 THEN 'f({{' WHEN p_size > 30 THEN ')' ELSE '' END)"

# Code with a syntax error at its end, of a kind that the size tells.
FAULTY_TEXT = f"""concat({CODE_TEXT}, CASE p_size % 9 WHEN 0 THEN concat('def f(x)', chr(10), '    return 1', chr(10)) WHEN 1 THEN 'x = = 3'
 WHEN 2 THEN concat('class A', chr(10), '    pass') WHEN 3 THEN concat('if x:', chr(10), '        y = 1', chr(10), '    z = 2') WHEN 4 THEN 'total = 3 +'
 WHEN 5 THEN 'name = "abc' WHEN 6 THEN 'f(a, [b)' ELSE '' END)"""

RULES = (
    Rule("email", r"[A-Za-z0-9._]+@[A-Za-z0-9.-]+", "medium"),
    Rule("ipv4", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "low"),
    Rule("license", r"(?:Apache|MIT|General Public) License", "notice"),
)
BAD_RULE = Rule("broken", "([A-Z]+", "high")
IGNORE_LINES = ("# local rules", "", "*.md", "lib/*.js", "!lib/f1*", "/src/pricing/")
SENSITIVE_GLOBS = ("src/pricing/**", "*.toml", "lib/f?.js")
KEEP_NAMES = ("_RATES_1*", "_rate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return spread(corpus_from_table(table(spark, sf_dir, "documents"), "doc_id", "text", keep))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(corpus_from_table(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text"))


# Rules made of the documents: the first two longer words of each, as patterns of several kinds. One kind in thirty can't be
# run safely, one has a safe form, one has no text that a match must hold.
RULE_WORDS = "regexp_extract(text, '([a-z]{4,}) ([a-z]{4,})', 0)"
RULE_PATTERN = """CASE doc_id % 30 WHEN 7 THEN concat('(?:[a-z]+ )*', words) WHEN 8 THEN concat('[a-z]+-', words)
 WHEN 9 THEN concat('(?:', replace(words, ' ', '|'), ')ing') WHEN 10 THEN '[0-9]{4}-[0-9]{2}-[0-9]{2}'
 ELSE concat(replace(words, ' ', ' +'), '[a-z]*') END"""


def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of rules, one from each document that has two such words."""
    words = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{RULE_WORDS} AS words").where("words <> ''")
    return words.selectExpr("concat('w', CAST(doc_id AS string)) AS id", f"{RULE_PATTERN} AS pattern", "'low' AS severity")


def _parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the parts over all cores, before texts many times their size are made of them. A narrow table is few splits, whatever its rows."""
    return spread(table(spark, sf_dir, "part").select("p_partkey", *columns), "p_partkey", always=True)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "p_name", "p_size").selectExpr(f"{CODE_PATH} AS path", f"{CODE_TEXT} AS text")


def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "p_name", "p_size").selectExpr(f"{CODE_PATH} AS path", f"{BROKEN_TEXT} AS text")


def faulty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "p_name", "p_size").selectExpr(f"{CODE_PATH} AS path", f"{FAULTY_TEXT} AS text")


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(f"{REPO} AS repo", f"{REL} AS rel").distinct()


def repo_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_files(spark, sf_dir).selectExpr("concat(repo, '/', rel) AS path")


def repo_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code files grouped into repositories by part brand."""
    return _parts(spark, sf_dir, "p_name", "p_size", "p_brand").selectExpr(
        "replace(p_brand, '#', '') AS repo", f"{CODE_PATH} AS path", f"{CODE_TEXT} AS text"
    )
