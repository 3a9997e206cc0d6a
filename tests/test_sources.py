"""Sources, sinks and the registered queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from veilspark.plans.oracles import ORACLES
from veilspark.plans.registry import QUERIES
from veilspark.functions.paths import ignored
from veilspark.operators.files import exclude_paths, relative_path
from veilspark.operators.scan import scan_rules
from veilspark.rules import Rule
from veilspark.sources import corpus as src

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def tree(root):
    files = {"a.py": b"x = 1\n", ".env": b"K=1", "pkg/__init__.py": b"", "pkg/_priv.js": b"f()", ".cfg/deep/x.bin": b"\xff\xfe", "build/o.js": b"o"}
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return files


def test_reading_a_tree_sees_hidden_files(spark, tmp_path):
    files = tree(tmp_path)
    root = str(tmp_path)
    rows = relative_path(src.read_corpus(spark, root), root).collect()
    assert {r.path: bytes(r.content) for r in rows} == files
    assert all(r.length == len(r.content) for r in rows)
    kept = src.read_corpus(spark, root, where=~ignored(F.col("path"), ["build/"]))
    assert kept.count() == 5 and exclude_paths(src.read_corpus(spark, root)).count() == 5
    plain = src.read_corpus(spark, root, hidden=False)
    assert {r.path.rsplit("/", 1)[1] for r in plain.collect()} == {"a.py", "o.js"}
    assert src.read_corpus(spark, f"{root}/.env").head().content == b"K=1"
    with pytest.raises(FileNotFoundError):
        src.read_corpus(spark, f"{root}/nope")
    decoded = {r.path: (r.decodable, r.text) for r in relative_path(src.decode_utf8(src.read_corpus(spark, root)), root).collect()}
    assert decoded[".cfg/deep/x.bin"] == (False, None) and decoded["a.py"] == (True, "x = 1\n")


def test_reading_by_uri_with_odd_names_and_a_link_to_the_parent(spark, tmp_path):
    names = ["a#b.py", "a b.py", "100%.js", "p%41q.py", "dir x/#.txt"]
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "dir x" / "up").symlink_to(tmp_path, target_is_directory=True)
    for root in (str(tmp_path), f"file://{tmp_path}", f"file://{tmp_path}/"):
        rows = src.read_corpus(spark, root).collect()
        assert {r.path[len(root.rstrip("/")) + 1 :]: bytes(r.content).decode() for r in rows} == {n: n for n in names}


def test_writers(spark, corpus, tmp_path):
    df = corpus(a__py="SECRET-1", b__js="y").withColumn("language", F.lit("python"))
    out = str(tmp_path / "out")
    src.write_corpus(df, out)
    assert spark.read.parquet(out).where("language = 'python'").count() == 2
    with pytest.raises(FileExistsError):
        src.write_corpus(df, out)
    found = scan_rules(df, [Rule("s", "SECRET-[0-9]", "low")])
    src.write_findings(found, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).head().redacted_preview == "********"


def test_corpus_from_table(spark):
    df = spark.createDataFrame([(1, 2, "t", "k")], "a int, b int, c string, d string")
    assert src.corpus_from_table(df, ["a", "b"], "c", ["d"]).head().asDict() == {"path": "1/2", "text": "t", "d": "k"}


def _connection():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["scan_rules", "lines", "mask_preview", "nearest_policy", "redact_file", "rename_map", "project_profile", "hash_files"])
def test_queries_agree_with_their_oracle(spark, name):
    result = _connection().execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted(repr(r) for r in result.fetchall())
    got = entry_points.queries()[name](spark, SF).select(*names).collect()
    assert sorted(repr(tuple(r)) for r in got) == want


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())
    assert not set(entry_points.oracle_sql()) - set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
