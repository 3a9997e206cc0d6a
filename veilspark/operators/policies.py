"""Policy lookup by directory and project profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Files at a repository root that identify an ecosystem, and usual source folders.
PYTHON_MARKERS = ("pyproject.toml", "setup.py", "setup.cfg", "Pipfile", "poetry.lock")
NODE_MARKERS = ("package.json", "pnpm-lock.yaml", "yarn.lock", "package-lock.json")
TS_MARKERS = ("tsconfig.json",)
SRC_DIRS = ("src", "lib", "app", "packages")


def nearest_policy(paths: DataFrame, policies: DataFrame, salt: int = 16) -> DataFrame:
    """The policy of the closest ancestor directory of each path, null where there is none.

    ``paths`` has ``path``; ``policies`` has ``policy_dir`` ('' is the root) and ``policy``. Each path is
    matched with its ancestor directories by equality. Upper directories are shared by very many paths, so
    both sides carry a salt: the paths of one directory spread over ``salt`` tasks and the policies, one row
    per directory, are repeated that often. Below Spark's size threshold the policies are broadcast instead.
    """
    parts = F.split("path", "/")
    depths = F.sequence(F.lit(0), F.size(parts) - 1)
    rows = paths.select("path").distinct().select(
        "path",
        F.pmod(F.xxhash64("path"), F.lit(salt)).cast("int").alias("salt"),
        F.explode(
            F.transform(
                depths,
                lambda d: F.struct(
                    d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("policy_dir")
                ),
            )
        ).alias("a"),
    ).select("path", "salt", "a.depth", "a.policy_dir")
    spread = policies.select("policy_dir", "policy").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))
    )
    joined = rows.join(spread, ["policy_dir", "salt"], "left")
    depth = F.when(F.col("policy").isNotNull(), F.col("depth"))
    return joined.groupBy("path").agg(
        F.max_by("policy", depth).alias("policy"), F.max_by("policy_dir", depth).alias("policy_dir")
    )


def project_profile(files: DataFrame, repo: str = "repo", rel: str = "rel") -> DataFrame:
    """Per repository: ecosystems, source folders and a label.

    Every output is a boolean maximum, so the state per repository is fixed and each partition sends one
    row per repository to the shuffle, however many files it holds.
    """
    r = F.col(rel)
    top = ~r.contains("/")
    ext = F.regexp_extract(r, r"[^/.][^/]*(\.[^/.]+)$", 1)

    def seen(cond):
        return F.coalesce(F.bool_or(cond), F.lit(False))

    flags = files.groupBy(repo).agg(
        seen(r.isin(*PYTHON_MARKERS)).alias("py_marker"),
        seen(top & (ext == ".py")).alias("py_file"),
        seen(r.isin(*NODE_MARKERS)).alias("has_node"),
        seen(r.isin(*TS_MARKERS)).alias("ts_marker"),
        seen(top & ext.isin(".ts", ".tsx")).alias("ts_file"),
        *[seen(r.startswith(d + "/")).alias(f"dir_{d}") for d in SRC_DIRS],
    )
    has_python = F.col("py_marker") | F.col("py_file")
    has_ts = F.col("ts_marker") | (F.col("has_node") & F.col("ts_file"))
    label = F.concat_ws(
        " + ",
        F.when(has_python, "Python"),
        F.when(has_ts, "TypeScript").when(F.col("has_node"), "JavaScript"),
    )
    dirs = F.array_compact(F.array(*[F.when(F.col(f"dir_{d}"), F.lit(f"{d}/**")) for d in SRC_DIRS]))
    return flags.select(
        repo,
        has_python.alias("has_python"),
        "has_node",
        has_ts.alias("has_typescript"),
        dirs.alias("src_dirs"),
        F.when(label == "", "generic").otherwise(label).alias("label"),
    )
