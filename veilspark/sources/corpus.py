"""Corpus sources and sinks. A corpus is a frame ``(path, text, ...)``; ``path`` names one text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.session import ensure_checkpoint_dir
from veilspark.sources.file_io import list_children, open_fs, read_bytes, read_ranges, write_folders

_LISTING_SCHEMA = "path string, is_dir boolean, length bigint"


def corpus_from_table(df: DataFrame, id: str | Sequence[str], text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Any table with an id and a text column as a corpus. Several id columns are joined with ``/``."""
    ids = [id] if isinstance(id, str) else list(id)
    path = F.concat_ws("/", *[F.col(c).cast("string") for c in ids])
    return df.select(path.alias("path"), F.col(text).alias("text"), *keep)


def list_files(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """``(path, length)`` of every regular file below ``root``, hidden files included; directory links are skipped.

    The tree is walked level by level on the executors. The driver learns only whether a level has
    directories left; each level is checkpointed, so no listing is repeated.
    """
    from pyarrow import fs

    store, inner = open_fs(root)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if info.type == fs.FileType.File:
        return spark.createDataFrame([(root, info.size)], "path string, length bigint")
    ensure_checkpoint_dir(spark)
    n = partitions or spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([(root.rstrip("/"),)], "path string")
    files: DataFrame | None = None
    while True:
        listed = level.repartition(n, "path").mapInArrow(partial(list_children, root=root), _LISTING_SCHEMA).checkpoint()
        found = listed.where(~F.col("is_dir")).select("path", "length")
        files = found if files is None else files.unionByName(found)
        level = listed.where("is_dir").select("path")
        if level.isEmpty():
            return files


def read_corpus(
    spark: SparkSession,
    root: str,
    hidden: bool = True,
    where: Column | None = None,
    partitions: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """``(path, content, length)`` of every regular file below ``root``, or of the single file ``root``.

    Spark's own file sources drop names that start with ``.`` or ``_`` (``.env``, ``__init__.py``), which a
    secret scan must see; ``hidden=False`` uses the built-in ``binaryFile`` source. ``where`` is a predicate
    on ``path`` applied before any content is read.

    ``max_bytes`` cuts files at line ends into ranges of about so many bytes, each a row ``(path, start, content,
    length)`` that any task can read: a file of any size is spread. ``findings(..., split="start")`` takes such rows.
    """
    if max_bytes is not None and (max_bytes < 1 or not hidden):
        raise ValueError("max_bytes is positive, and needs hidden files to be read")
    if not hidden:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        df = df.select("path", "content", "length")
        return df if where is None else df.where(where)
    paths = list_files(spark, root, partitions)
    if where is not None:
        paths = paths.where(where)
    n = partitions or spark.sparkContext.defaultParallelism
    if max_bytes is not None:
        last = F.greatest(F.col("length") - 1, F.lit(0))
        ranges = paths.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(max_bytes).cast("bigint"))).alias("start"), "length")
        reader = partial(read_ranges, root=root, max_bytes=max_bytes)
        return ranges.repartition(n, "path", "start").mapInArrow(reader, "path string, start bigint, content binary, length bigint")
    return paths.select("path").repartition(n, "path").mapInArrow(partial(read_bytes, root=root), "path string, content binary, length bigint")


def decode_utf8(df: DataFrame, content: str = "content") -> DataFrame:
    """Strict UTF-8: ``text`` is null and ``decodable`` false where the bytes are not valid."""
    valid = F.coalesce(F.is_valid_utf8(F.col(content)), F.lit(False))
    return df.withColumn("decodable", valid).withColumn(
        "text", F.when(valid, F.decode(F.col(content), "UTF-8"))
    )


def write_findings(findings: DataFrame, out: str, format: str = "json", mode: str = "errorifexists") -> None:
    """Findings as JSON lines (or another file format); the counts are ``scan_summary``."""
    findings.write.format(format).mode(mode).save(out)


def _refuse_non_empty(spark: SparkSession, out: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path) and len(store.listStatus(path)) > 0:
        raise FileExistsError(f"output folder is not empty: {out}")


def write_corpus(df: DataFrame, out: str, format: str = "parquet") -> None:
    """Transformed corpus at a new or empty location, laid out by language for pruned reads."""
    _refuse_non_empty(df.sparkSession, out)
    writer = df.write.format(format).mode("append")
    if "language" in df.columns:
        writer = writer.partitionBy("language")
    writer.save(out)


def write_texts(df: DataFrame, out: str, by: str, text: str = "text", partitions: int | None = None) -> int:
    """Texts as files in a folder ``by=value`` for each value, texts of one value as lines of one file; how many files.

    The layout is that of ``partitionBy(by).text(out)``, whose writer spends more on a file than a short text takes: this is for
    values as many as texts. A null value has the folder that Spark gives it; a null text is an empty line.
    """
    _refuse_non_empty(df.sparkSession, out)
    n = partitions or max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("name"), F.col(text).cast("binary").alias("content"))
    rows = rows.repartition(n, "name").sortWithinPartitions("name", "content")
    return rows.mapInArrow(partial(write_folders, root=out, by=by), "files bigint").agg(F.sum("files")).first()[0] or 0


def write_manifest(manifest: DataFrame, out: str) -> None:
    """Manifest entries as JSON lines."""
    manifest.write.mode("errorifexists").json(out)


def write_context(parts: DataFrame, out: str, by: str | None = None, partitions: int | None = None) -> None:
    """Context document(s) as text files whose concatenation in name order is the document.

    The parts are range-partitioned on their order, so a huge repository is spread over many files and no
    task sees more than its range. With ``by`` each value gets its own folder. Range partitioning samples its
    input first; the parts are checkpointed so that the view is not computed for that as well.
    """
    ensure_checkpoint_dir(parts.sparkSession)
    parts = parts.checkpoint()
    keys = ([by] if by else []) + ["rank", "path", "seq"]
    n = [partitions] if partitions else []
    ordered = parts.repartitionByRange(*n, *keys).sortWithinPartitions(*keys)
    writer = ordered.select("text", *([by] if by else [])).write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).text(out)
