"""Digests of directories against a plain tree walk."""

from __future__ import annotations

import random

from veilspark.operators.digests import changed_directories, tree_digests, verify_tree

SCHEMA = "path string, sha256 string"


def some_paths(rng):
    parts = ["a", "b", "c c", "ü"]
    return {"/".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) + f"/f{k}" if k % 5 else f"top{k}": f"h{k}" for k in range(120)}


def test_digests_tell_equal_trees_and_changes(spark):
    rng = random.Random(3)
    files = some_paths(rng)
    df = spark.createDataFrame(list(files.items()), SCHEMA)
    found = {r.dir: r for r in tree_digests(df.repartition(7)).collect()}
    dirs = {p.rsplit("/", k)[0] for p in files for k in range(1, p.count("/") + 1)} | {""}
    assert set(found) == dirs
    assert {d: r.files for d, r in found.items()} == {d: sum(p.startswith(d + "/") or d == "" for p in files) for d in dirs}
    # The order of rows doesn't matter; a change shows in all directories above and nowhere else.
    again = {r.dir: r.digest for r in tree_digests(df.orderBy("sha256")).collect()}
    assert again == {d: r.digest for d, r in found.items()}
    one = next(p for p in files if p.count("/") == 3)
    other = spark.createDataFrame([(p, h if p != one else "other") for p, h in files.items()], SCHEMA)
    differs = {r.dir for r in tree_digests(other).collect() if r.digest != again[r.dir]}
    assert differs == {one.rsplit("/", k)[0] for k in range(1, 4)} | {""}
    told = changed_directories(tree_digests(df), tree_digests(other)).collect()
    assert {(r.dir, r.status) for r in told} == {(d, "changed") for d in differs}
    assert changed_directories(tree_digests(df), tree_digests(df)).count() == 0
    assert verify_tree(df, df).count() == 0


def test_descent_finds_what_a_full_comparison_does(spark):
    rng = random.Random(5)
    old = some_paths(rng)
    for turn in range(4):
        new = {p: ("x" if rng.random() < 0.03 else h) for p, h in old.items() if rng.random() > 0.04}
        if turn % 2:
            new = {p: h for p, h in new.items() if not p.startswith("a/")} | {f"new/deep/er/f{k}": "n" for k in range(3)} | {"b/new": "n"}
        want = {(p, "extra" if p not in old else "missing" if p not in new else "changed") for p in old.keys() | new.keys() if old.get(p) != new.get(p)}
        frames = [spark.createDataFrame([*t.items(), (None, "x")], SCHEMA) for t in (old, new)]
        assert {tuple(r) for r in verify_tree(*frames).collect()} == want


def test_digests_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tree_digests(empty).count() == 0 and verify_tree(empty, empty).count() == 0
    assert [tuple(r) for r in verify_tree(empty, spark.createDataFrame([("a/b", None)], SCHEMA)).collect()] == [("a/b", "extra")]


def test_each_tree_is_read_once(spark, tmp_path):
    rows = [(f"r{k % 3}/d{k % 5}/f{k}", f"h{k}") for k in range(40)] + [("r0/d0/f0", "h0"), (None, "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/old")
    spark.createDataFrame([r for r in rows if r[0] != "r1/d1/f1"] + [("new/a/b", None)], SCHEMA).write.parquet(f"{tmp_path}/new")
    told = verify_tree(*(spark.read.parquet(f"{tmp_path}/{n}") for n in ("old", "new")))
    # Digests and comparison share the stored rows: no plan that is left goes back to the tables.
    assert told.inputFiles() == []
    assert {tuple(r) for r in told.collect()} == {("r1/d1/f1", "missing"), ("new/a/b", "extra")}
