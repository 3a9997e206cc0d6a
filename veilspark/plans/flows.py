"""The three verbs end to end, as declarative plans over a corpus."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from veilspark.operators.context import context_document, redact_file, strip_docstrings
from veilspark.operators.diff import diff_context, diff_totals
from veilspark.operators.files import exclude_paths, with_language
from veilspark.operators.manifest import manifest, verify_output
from veilspark.operators.rename import apply_renames, private_definitions, rename_map, transform_counts
from veilspark.operators.scan import findings, scan_summary
from veilspark.rules import Rule
from veilspark.sources.corpus import write_corpus, write_manifest


@dataclass(frozen=True)
class Scan:
    findings: DataFrame
    summary: DataFrame


def _counted(metric: Observation) -> int:
    try:
        return metric.get["n"]
    except Py4JJavaError:
        # A plan that is known to be empty is folded away with its metrics.
        return 0


@dataclass(frozen=True)
class Observed:
    findings: DataFrame
    files: Observation
    found: Observation

    def summary(self) -> DataFrame:
        files, found = _counted(self.files), _counted(self.found)
        row = (files, found, "ok" if found == 0 else "findings")
        return self.findings.sparkSession.createDataFrame([row], "files_scanned bigint, findings bigint, status string")


@dataclass(frozen=True)
class Obfuscated:
    corpus: DataFrame
    renames: DataFrame


@dataclass(frozen=True)
class Release:
    corpus: DataFrame
    renames: DataFrame
    counts: DataFrame
    checks: DataFrame
    manifest: DataFrame


def scan(
    corpus: DataFrame,
    rules: Sequence[Rule] = (),
    ignore: Iterable[str] = (),
    key: Sequence[str] = ("path",),
    allow: DataFrame | Iterable[str] | None = None,
) -> Scan:
    """Ignored paths removed, all detectors run, summary attached. ``key`` names a text, as in ``findings``."""
    kept = exclude_paths(corpus, ignore)
    found = findings(kept, rules, key=key, allow=allow)
    return Scan(found, scan_summary(kept, findings(kept, rules, ordered=False, key=key, allow=allow)))


def observed_scan(
    corpus: DataFrame,
    rules: Sequence[Rule] = (),
    ignore: Iterable[str] = (),
    key: Sequence[str] = ("path",),
    allow: DataFrame | Iterable[str] | None = None,
) -> Observed:
    """``scan`` whose counts come with its findings: the corpus is read once, when the findings are first used.

    ``summary`` waits for that: it is the row of ``scan_summary``, from metrics that the tasks report as they go.
    """
    files, found = Observation(), Observation()
    kept = exclude_paths(corpus, ignore).observe(files, F.count(F.lit(1)).alias("n"))
    rows = findings(kept, rules, ordered=False, key=key, allow=allow).observe(found, F.count(F.lit(1)).alias("n"))
    return Observed(rows, files, found)


def write_scan(
    corpus: DataFrame,
    out: str,
    rules: Sequence[Rule] = (),
    ignore: Iterable[str] = (),
    key: Sequence[str] = ("path",),
    allow: DataFrame | Iterable[str] | None = None,
) -> Scan:
    """``scan`` with its findings stored in ``out``: texts are read once, the summary counts stored rows and paths."""
    kept = exclude_paths(corpus, ignore)
    findings(kept, rules, key=key, allow=allow).write.parquet(out)
    found = corpus.sparkSession.read.parquet(out)
    return Scan(found, scan_summary(kept, found))


def context(corpus: DataFrame, by: str | None = None, strict: bool = False, ignore: Iterable[str] = ()) -> DataFrame:
    """Ordered parts of the redacted document(s)."""
    key = [by, "path"] if by else ["path"]
    kept = exclude_paths(corpus, ignore)
    return context_document(redact_file(kept, strict, key=key), by, strict, listing=kept)


def diff(corpus: DataFrame, strict: bool = False, ignore: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Per-file statistics and their totals."""
    per_file = diff_context(exclude_paths(corpus, ignore), strict)
    return per_file, diff_totals(per_file)


def obfuscate(
    corpus: DataFrame, keep: Iterable[str] = (), drop_docstrings: bool = False, ignore: Iterable[str] = ()
) -> Obfuscated:
    """Renamed corpus and the rename map. Rows that cannot be transformed keep their text."""
    kept = exclude_paths(corpus, ignore)
    renames = rename_map(private_definitions(kept, keep))
    source = strip_docstrings(kept) if drop_docstrings else kept
    return Obfuscated(apply_renames(source, renames), renames)


def release(
    corpus: DataFrame,
    out: str,
    keep: Iterable[str] = (),
    rules: Sequence[Rule] = (),
    policy_text: str | None = None,
    drop_docstrings: bool = False,
    ignore: Iterable[str] = (),
) -> Release:
    """``obfuscate`` to its end: corpus, renames, checks and manifest are stored below ``out``.

    Each is computed from what is stored before it, so no plan runs twice and the gate reads what will leave.
    """
    spark = corpus.sparkSession
    kept = exclude_paths(corpus, ignore)
    rename_map(private_definitions(kept, keep)).write.parquet(f"{out}/renames")
    renames = spark.read.parquet(f"{out}/renames")
    source = strip_docstrings(kept) if drop_docstrings else kept
    write_corpus(with_language(apply_renames(source, renames)), f"{out}/corpus")
    after = spark.read.parquet(f"{out}/corpus")
    verify_output(source, after, renames, rules).write.parquet(f"{out}/checks")
    checks = spark.read.parquet(f"{out}/checks")
    write_manifest(manifest(kept, after, renames, policy_text, checks=checks), f"{out}/manifest")
    record = spark.read.schema("section string, name string, value string").json(f"{out}/manifest")
    transform_counts(kept, renames).withColumn("passed", F.lit(checks.where("not passed").isEmpty())).write.parquet(f"{out}/counts")
    return Release(after, renames, spark.read.parquet(f"{out}/counts"), checks, record)
