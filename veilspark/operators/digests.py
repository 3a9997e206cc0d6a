"""Digests of directories, so that equal trees are told by one row and a change is found by descent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.session import ensure_checkpoint_dir

#: Hexadecimal digits of a hash in each of the sums that make a directory's digest.
_DIGITS, _SUMS = 15, 4


def _parent(path: Column) -> Column:
    """The directory of a path; that of a name at the top is ''."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _digest(entry: Column) -> Column:
    """A digest of the entries of a group, whatever their order: their hashes are summed in parts, the sums are hashed.

    Sums are combined before the shuffle, so a directory of millions of entries is no large group.
    """
    hashed = F.sha2(entry, 256)
    parts = [F.sum(F.conv(F.substring(hashed, 1 + k * _DIGITS, _DIGITS), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(_SUMS)]
    return F.sha2(F.concat_ws(",", *parts), 256)


def _files(hashes: DataFrame) -> DataFrame:
    """``(path, sha256, dir, level)`` of the rows with a path, stored: every later step reads them and none the table again."""
    ensure_checkpoint_dir(hashes.sparkSession)
    path = F.col("path")
    level = (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).alias("level")
    return hashes.where(path.isNotNull()).select("path", "sha256", _parent(path).alias("dir"), level).checkpoint()


def tree_digests(hashes: DataFrame) -> DataFrame:
    """``(dir, depth, files, digest)`` of every directory of ``(path, sha256)``; the root is '' at depth 0.

    A directory's digest covers the names and digests of all that is below it. One aggregation per level, from the
    deepest to the root; each level is checkpointed, since the next two steps read it. Repeated rows count as often as they
    stand; rows without a path are left out; a null hash is that of an unreadable file. An empty table gives no rows.
    """
    return _digests(_files(hashes))


def _digests(stored: DataFrame) -> DataFrame:
    """``tree_digests`` of stored files."""
    entry = F.concat(F.lit("file "), "path", F.lit(" "), F.coalesce("sha256", F.lit("unreadable"))).alias("entry")
    files = stored.select("dir", "level", entry, F.lit(1).cast("bigint").alias("files"))
    deepest = files.agg(F.max("level")).first()[0]
    out, below = None, None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        entries = files.where(F.col("level") == depth).select("dir", "entry", "files")
        if below is not None:
            own = F.concat(F.lit("dir "), F.col("dir"), F.lit(" "), F.col("digest")).alias("entry")
            entries = entries.unionByName(below.select(_parent(F.col("dir")).alias("dir"), own, "files"))
        below = entries.groupBy("dir").agg(F.sum("files").alias("files"), _digest(F.col("entry")).alias("digest")).checkpoint()
        found = below.select("dir", F.lit(depth).cast("bigint").alias("depth"), "files", "digest")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return stored.sparkSession.createDataFrame([], "dir string, depth bigint, files bigint, digest string")
    return out


def changed_directories(known: DataFrame, now: DataFrame) -> DataFrame:
    """``(dir, depth, status)`` where two trees differ: changed, missing or extra. Equal trees give no row.

    The descent goes from the root, level by level, into the children of what differs alone; a directory that one tree has not
    is told by its own row and not entered.
    """
    ensure_checkpoint_dir(known.sparkSession)
    deepest = known.unionByName(now).agg(F.max("depth")).first()[0]
    out, above = None, None
    for depth in range(-1 if deepest is None else deepest + 1):
        old, new = (t.where(F.col("depth") == depth).select("dir", F.col("digest").alias(n)) for t, n in ((known, "old"), (now, "new")))
        if above is not None:
            parents = above.where("status = 'changed'").select(F.col("dir").alias("parent"))
            old, new = (t.withColumn("parent", _parent(F.col("dir"))).join(parents, "parent", "left_semi").drop("parent") for t in (old, new))
        both = old.join(new, "dir", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
        status = F.when(F.col("old").isNull(), "extra").when(F.col("new").isNull(), "missing").otherwise("changed").alias("status")
        above = both.select("dir", F.lit(depth).cast("bigint").alias("depth"), status).checkpoint()
        out = above if out is None else out.unionByName(above)
        if above.where("status = 'changed'").isEmpty():
            break
    if out is None:
        return known.sparkSession.createDataFrame([], "dir string, depth bigint, status string")
    return out


def verify_tree(known: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, status)`` of the files of ``(path, sha256)`` that differ: changed, missing or extra; no row if the trees are equal.

    Only files in directories that differ, or that are below a directory of one tree alone, are compared. Which directories
    these are is told by the directories of the digests, not by the files.
    """
    stored = [_files(t) for t in (known, now)]
    trees = [_digests(t) for t in stored]
    dirs = changed_directories(*trees)
    alone = dirs.where("status <> 'changed'").select(F.col("dir").alias("top"))

    def within(files: DataFrame, tree: DataFrame, name: str) -> DataFrame:
        """Files straight in a changed directory, and all files below one that only one tree has."""
        parts = F.split("dir", "/")
        tops = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        below = tree.select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), tops))).alias("top")).join(alone, "top", "left_semi")
        inside = dirs.where("status = 'changed'").select("dir").unionByName(below.select("dir"))
        return files.join(inside, "dir", "left_semi").select("path", F.coalesce("sha256", F.lit("unreadable")).alias(name))

    old, new = (within(f, t, n) for f, t, n in zip(stored, trees, ("old", "new")))
    both = old.join(new, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    status = F.when(F.col("old").isNull(), "extra").when(F.col("new").isNull(), "missing").otherwise("changed")
    return both.select("path", status.alias("status"))
