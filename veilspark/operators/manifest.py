"""Hashes, manifest and gates. Long form throughout: a manifest of any size is rows, not one map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.paths import language
from veilspark.operators.context import ENGINE
from veilspark.operators.js_code import reference_units
from veilspark.operators.rename import _python_references, rename_entries
from veilspark.operators.scan import has_match, has_secret
from veilspark.operators.files import route_files
from veilspark.operators.splicing import by_key
from veilspark.operators.text_tables import KEY, bracket_error
from veilspark.rules import Rule, check_rules


def hash_files(corpus: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``(path, sha256)`` of the bytes, or of the UTF-8 text where there is no ``content``."""
    source = "content" if "content" in corpus.columns else "text"
    return corpus.select(*key, F.sha2(F.col(source).cast("binary"), 256).alias("sha256"))


def manifest(
    before: DataFrame,
    after: DataFrame,
    renames: DataFrame,
    policy_text: str | None = None,
    ruleset_version: str = "1",
    checks: DataFrame | None = None,
) -> DataFrame:
    """The audit record as rows ``(section, name, value)``.

    Sections: ``meta`` (versions, time, policy hash and text), ``source_files`` and ``output_files``
    (path → sha-256), ``rename_map`` (path:original → new name) and ``checks`` (check → passed).
    """
    spark = before.sparkSession
    policy = F.lit(policy_text).cast("string")
    meta = {
        "engine_version": F.lit(ENGINE),
        "ruleset_version": F.lit(ruleset_version),
        "generated_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"),
        "policy_hash": F.sha2(policy.cast("binary"), 256),
        "policy_snapshot": policy,
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in meta.items()])
    head = spark.range(1).select(F.explode(pairs).alias("m")).select(F.lit("meta").alias("section"), "m.*")

    def section(name: str, df: DataFrame, a: str, b: str) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.col(a).alias("name"), F.col(b).cast("string").alias("value"))

    out = (
        head.unionByName(section("source_files", hash_files(before), "path", "sha256"))
        .unionByName(section("output_files", hash_files(after), "path", "sha256"))
        .unionByName(section("rename_map", rename_entries(renames), "entry", "renamed"))
    )
    return out if checks is None else out.unionByName(section("checks", checks, "check", "passed"))


def verify_manifest(record: DataFrame, corpus: DataFrame, section: str = "output_files") -> DataFrame:
    """``(path, status)``: ok, changed, missing (not in the corpus) or extra (not in the manifest)."""
    known = record.where(F.col("section") == section).select(F.col("name").alias("path"), F.col("value").alias("expected"))
    now = hash_files(corpus).withColumnRenamed("sha256", "actual")
    joined = known.join(now, "path", "full_outer")
    status = (
        F.when(F.col("expected").isNull(), "extra")
        .when(F.col("actual").isNull(), "missing")
        .when(F.col("expected") == F.col("actual"), "ok")
        .otherwise("changed")
    )
    return joined.select("path", status.alias("status"))


def verify_output(
    before: DataFrame,
    after: DataFrame,
    renames: DataFrame,
    rules: Sequence[Rule] = (),
    key: Sequence[str] = KEY,
    entropy: bool = True,
) -> DataFrame:
    """The gate as data: one row ``(check, failures, passed)`` per named predicate.

    ``rows_preserved`` compares the row counts; ``no_private_name`` counts references to original names left
    in the output; ``no_secret`` counts output rows in which a rule, a built-in detector or (``entropy``) a dense string
    is found; ``brackets_balanced`` counts rows that became unbalanced. Rules that ``check_rules`` rejects are left out. Each input is reduced to one row of sums. Pass the written output:
    it is read for the row checks and for the names.
    """
    k = list(key)
    rules = check_rules(before.sparkSession, rules)[0]
    secret = has_secret(F.col("text"), entropy) | has_match(F.col("text"), rules)
    lang, text = language(F.col("path")), F.col("text")
    error = F.when(lang == "python", bracket_error(text, True)).when(lang.isNotNull(), bracket_error(text, False))
    bad = error.isNotNull().cast("int")
    after_rows = route_files(after).where(F.col("text").isNotNull())
    py = by_key(after_rows.where("route = 'python'").select(*k, "text"), key)
    js = by_key(after_rows.where("route = 'js'").select(*k, "text"), key)
    left = _python_references(py, key).select(*k, "name").unionByName(
        reference_units(js, key).select(*k, "name")
    )
    # A new name may equal an original of the same file; only names that are no longer in use count.
    new = renames.select(*k, F.col("renamed").alias("name"))
    originals = renames.select(*k, F.col("original").alias("name")).join(new, [*k, "name"], "left_anti")
    residual = left.join(originals, [*k, "name"], "left_semi")

    def sums(df: DataFrame, **checks) -> DataFrame:
        row = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in checks.items()])
        pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in checks])
        return row.select(F.explode(pairs).alias("c")).select("c.*")

    votes = (
        sums(before, rows_preserved=F.lit(1), brackets_balanced=-bad)
        .unionByName(
            sums(
                after,
                rows_preserved=F.lit(-1),
                no_secret=F.coalesce(secret, F.lit(False)).cast("int"),
                brackets_balanced=bad,
            )
        )
        .unionByName(sums(residual, no_private_name=F.lit(1)))
    )
    # Fewer unbalanced rows than before is no failure; a row count that differs either way is.
    total = F.when(F.col("check") == "brackets_balanced", F.greatest("s", F.lit(0))).otherwise(F.abs("s"))
    summed = votes.groupBy("check").agg(F.sum("n").alias("s"))
    return summed.select("check", total.alias("failures")).withColumn("passed", F.col("failures") == 0)
