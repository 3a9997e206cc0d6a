"""Scan rules: a small configuration value on the driver, unrolled into expressions by the operators."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.regex_check import Check, check_pattern, required_sets


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched line by line; ``group`` selects the part reported as the value.

    A value in which ``unless`` is found is no match.
    """

    id: str
    pattern: str
    severity: str = "medium"
    group: int = 0
    unless: str | None = None


# Characters of a setting's value without quotes, and those of them that are no digit.
_VALUE = r"[^ \t\"'()\[\]{}<>,;:=]"
_PLAIN = r"[^ \t\"'()\[\]{}<>,;:=0-9]"

# Public credential formats. No look-around, so that the same text works in RE2 engines; each
# begins with fixed text and has one way to match, so that a line of millions of characters is searched in linear time.
BUILTIN_PACK = "builtin"
BUILTIN_ACTION = "Rotate this credential and remove it from source."
BUILTIN_RULES = (
    Rule("aws-access-key", r"(?:AKIA|ASIA)[0-9A-Z]{16}", "high"),
    Rule("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "high"),
    Rule(
        "keyword",
        r"(?i)(?:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']([^\"' ]{8,})[\"']",
        "high",
        1,
    ),
    Rule("json-web-token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*", "high"),
    Rule("bearer-token", r"(?i)bearer +([A-Za-z0-9._~+/-]{20,}=*)", "high", 1),
    Rule("basic-auth", r"://[^ :/@]+:([^ :/@]+)@", "high", 1),
    # Settings without quotes, as in .env, YAML and INI files: a value of a digit and four more characters, so that
    # code like `token = other_name` is none, nor a call or a dotted name.
    Rule(
        "unquoted-keyword",
        r"(?i)(?:password|passwd|secret|token|api_?key)(?:_[A-Za-z0-9]+)? *[:=] *"
        rf"((?:{_PLAIN}{{4,}}[0-9]{_VALUE}*|{_PLAIN}{{3}}[0-9]{_VALUE}+|{_PLAIN}{{2}}[0-9]{_VALUE}{{2,}}|{_PLAIN}[0-9]{_VALUE}{{3,}}|[0-9]{_VALUE}{{4,}})=*)"
        r"(?:[ \t\"')\[\]{}<>,;:]|$)",
        "high",
        1,
        r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+$",
    ),
    # Token formats of public services, told by their fixed beginnings.
    Rule(
        "vendor-token",
        r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abpors]-[A-Za-z0-9-]{10,}"
        r"|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|AccountKey=[A-Za-z0-9+/]{40,}=*)",
        "high",
    ),
)


def java_pattern(pattern: str, unicode_classes: bool = True) -> str:
    """Policy patterns are written for Python; translate the few spellings Java does not share.

    The pattern runs in its safe form (:func:`check_pattern`). ``unicode_classes`` makes ``\\w`` and ``\\d``
    Unicode-aware as they are in Python.
    """
    pattern = check_pattern(pattern).pattern
    # Java names have no underscore, so one is spelled out.
    name = lambda m: m[1].replace("_", "U95")
    p = re.sub(r"\(\?P<([A-Za-z_]\w*)>", lambda m: f"(?<x{name(m)}>" if "_" in m[1] else f"(?<{m[1]}>", pattern)
    p = re.sub(r"\(\?P=([A-Za-z_]\w*)\)", lambda m: rf"\k<x{name(m)}>" if "_" in m[1] else rf"\k<{m[1]}>", p)
    p = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", p)
    needs_unicode = unicode_classes and re.search(r"\\[wWdDsSbB]", p)
    return ("(?U)" + p) if needs_unicode else p


def ignores_context(pattern: str) -> bool:
    """Does a match depend on the matched characters alone?

    True when the pattern has no anchors, boundaries, look-around, back-references, possessive or atomic
    parts. Such a pattern matches a text whenever it matches one of its lines, so the whole text can be
    tested first. Unsure cases give False.
    """
    p = re.sub(r"\\[^AzZbBGk0-9]", "x", pattern)
    p = re.sub(r"\[\^?\]?[^\]]*\]", "x", p)
    return not re.search(r"[\^$\\]|\(\?(?:[=!>]|<[=!])|[*+?}]\+", p)


def rules_from_frame(rules: DataFrame) -> list[Rule]:
    """Read a rule table ``(id, pattern[, severity])``. Rules are configuration: each becomes an expression."""
    sev = F.coalesce(F.col("severity"), F.lit("medium")) if "severity" in rules.columns else F.lit("medium")
    rows = rules.select("id", "pattern", sev.alias("severity")).toLocalIterator()
    return [Rule(r.id, r.pattern, r.severity) for r in rows]


def check_rules(spark: SparkSession, rules) -> tuple[list[Rule], list[Rule]]:
    """Split rules into (valid, rejected). Rejected are those that can't be read, or could stall or kill a task
    (:func:`rule_reasons` tells why); the others are compiled by the engine that will run them.

    All are tried at once; only if one fails they are tried one by one.
    """
    rules, rejected = list(rules), []
    ok = [r for r in rules if check_pattern(r.pattern).status != "refused"]
    try:
        if ok:
            spark.range(1).select([F.lit("x").rlike(java_pattern(r.pattern)) for r in ok]).head()
        return ok, [r for r in rules if r not in ok]
    except PySparkException:
        pass
    ok, tried = [], ok
    for rule in tried:
        try:
            # Folded by the optimizer: a bad pattern is refused before any task starts.
            spark.range(1).select(F.lit("x").rlike(java_pattern(rule.pattern))).head()
            ok.append(rule)
        except PySparkException:
            rejected.append(rule)
    return ok, [r for r in rules if r not in ok]


def rule_reasons(rules: DataFrame, pattern: str = "pattern") -> DataFrame:
    """``rules`` with ``status`` (ok, rewritten, slow or refused), ``reason`` and ``runs_as``, the pattern that is searched.

    A pattern is judged alone, in the row: a table of rules of any size is checked where it lies. A null pattern is refused.
    """

    @F.pandas_udf("status string, reason string, runs_as string")
    def judged(patterns: pd.Series) -> pd.DataFrame:
        found = [check_pattern(p) if p is not None else Check("refused", "malformed: no pattern", "") for p in patterns]
        return pd.DataFrame({"status": [c.status for c in found], "reason": [c.reason for c in found], "runs_as": [c.pattern for c in found]})

    return rules.withColumn("__judged", judged(pattern)).select(*[F.col(c) for c in rules.columns], "__judged.*")


#: Characters of a text that a rule is found by, at least; sets of such texts that are asked for, at most.
LEAST, SETS = 4, 3


def rule_index(rules: DataFrame, unicode_classes: bool = True) -> DataFrame:
    """``(id, severity, written, pattern, texts)`` for a table ``(id, pattern[, severity])`` of any size, each rule once.

    Every match of a rule holds one of each set in ``texts`` (:func:`required_sets`, the longest ones). A rule without a
    set of texts of ``LEAST`` characters has none: it has to be tried on every line. Refused rules (:func:`rule_reasons`) are left
    out. ``pattern`` is ready to run. Rules are judged in as many parts as a shuffle has, a pattern once in each.
    """
    spark = rules.sparkSession
    severity = F.coalesce(F.col("severity"), F.lit("medium")) if "severity" in rules.columns else F.lit("medium")

    @F.pandas_udf("array<struct<pattern:string,texts:array<array<string>>>>")
    def entries(patterns: pd.Series) -> pd.Series:
        known: dict[str | None, list[dict]] = {}
        for p in set(patterns):
            sound = p is not None and check_pattern(p).status != "refused"
            known[p] = [{"pattern": java_pattern(p, unicode_classes), "texts": required_sets(p, LEAST)[:SETS]}] if sound else []
        return pd.Series([known[p] for p in patterns], dtype=object)

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = rules.select(F.col("id").cast("string").alias("id"), severity.alias("severity"), F.col("pattern").alias("written"))
    return own.distinct().repartition(parts, *own.columns).withColumn("e", F.explode(entries("written"))).select("id", "severity", "written", "e.*")
