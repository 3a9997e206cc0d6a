"""Texts written as many small files: the layout of Spark's writer, without a writer for each file."""

import hashlib
import os

import pytest

from veilspark.plans import registry
from veilspark.sources import corpus as src


def test_texts_are_written_as_files_of_their_values(spark, tmp_path):
    """The folders are those of Spark's own writer, and so are the contents; no file takes a writer of Spark."""
    values = ["a #1", "a #2", "x/y", "q'\"%:=?*{[]^\\ é", "tab\t", "dot.", None, ""]
    rows = [(v, f"text of {v}\nand more é") for v in values] + [("a #1", None), ("a #1", "twice"), ("a #1", "twice"), ("null", None)]
    df = spark.createDataFrame(rows, "name string, text string").repartition(3)
    mine, own = (f"{tmp_path}/{k}" for k in ("mine", "own"))
    # Spark's folder of null and of the empty value is one.
    assert src.write_texts(df, mine, "name") == len(values)
    df.repartition(4, "name").write.partitionBy("name").text(own)

    def contents(root):
        found = {}
        for folder in os.listdir(root):
            for name in os.listdir(f"{root}/{folder}") if os.path.isdir(f"{root}/{folder}") else []:
                if name.endswith(".txt"):
                    with open(f"{root}/{folder}/{name}", "rb") as f:
                        found.setdefault(folder, []).extend(f.read().split(b"\n"))
        return {k: sorted(x for x in v if x) for k, v in found.items()}

    assert contents(mine) == contents(own) and len(contents(mine)) == len(values)
    assert not [n for _, _, names in os.walk(mine) for n in names if not n.endswith(".txt")]
    assert [r.length for r in src.read_corpus(spark, mine).where("path like '%name=null/%'").collect()] == [1]
    with pytest.raises(FileExistsError):
        src.write_texts(df, mine, "name")


def test_documents_are_written_without_a_writer_for_each(spark, tmp_path, monkeypatch):
    rows = [(1, "one"), (1, "one"), (2, None), (None, "none"), (30, "é\n")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = f"{tmp_path}/files"
    monkeypatch.setattr(registry, "_fresh", lambda spark, name: out)
    got = {(r.path, r.length, r.sha256) for r in registry.read_corpus(spark, str(tmp_path)).collect()}
    want = {("1", b"one\none\n"), ("2", b"\n"), ("", b"none\n"), ("30", "é\n\n".encode())}
    assert got == {(path, len(data), hashlib.sha256(data).hexdigest()) for path, data in want}
    assert sorted(os.listdir(out)) == ["name=a %23", "name=a %231", "name=a %232", "name=a %2330"]
