"""The folder source on a real tree, with a folder that can't be read; JSON types of items."""

import os

from pyspark.sql import functions as F

from catalux.operators import checks, inventory
from catalux.sources import folders


def test_a_tree_with_a_bad_folder(spark, tmp_path, monkeypatch):
    root = tmp_path / "root"
    for d in ("a/b/c", "a/empty", "z", "gone/x"):
        os.makedirs(root / d)
    for f in ("top.txt", "a/one.jpg", "a/b/two.jpg", "a/b/c/three.jpg", "z/four.mov", "gone/five"):
        (root / f).write_bytes(b"x" * len(f))
    spark.dataSource.register(folders.FolderTree)
    df = spark.read.format("folder_tree").option("path", str(root)).load()
    rows = {r.item_id: r for r in df.collect()}
    assert {k for k, r in rows.items() if r.kind == "folder"} == {"", "a", "a/b", "a/b/c", "a/empty", "z", "gone", "gone/x"}
    assert {k: r.size for k, r in rows.items() if r.kind == "file"} == {f: len(f) for f in ("top.txt", "a/one.jpg", "a/b/two.jpg", "a/b/c/three.jpg", "z/four.mov", "gone/five")}
    assert rows["a/b/two.jpg"].parent_id == "a/b" and rows["a/b/two.jpg"].depth == 3 and rows["top.txt"].parent_id == "" and rows[""].parent_id is None
    assert df.rdd.getNumPartitions() == 4 and all(r.error is None for r in rows.values())
    # paths by the operator, from the edges that the source found
    edges = df.where("kind = 'folder' and item_id <> ''").select(F.col("parent_id").alias("parent"), F.col("item_id").alias("node"), "name")
    assert {r.node: r.path for r in inventory.folder_paths(edges, "").collect() if r.node} == {k: k for k, r in rows.items() if r.kind == "folder" and k}
    # what goes between listing the root and reading a folder is an error row of that folder, the others are read
    reader = folders.FolderReader(str(root))
    parts = reader.partitions()
    os.rename(root / "gone", tmp_path / "elsewhere")
    got = [row for p in parts for row in reader.read(p)]
    bad = [r for r in got if r[7]]
    assert [(r[0], r[3]) for r in bad] == [("gone", "folder")] and "FileNotFoundError" in bad[0][7]
    assert sum(r[3] == "file" for r in got) == 5


def test_empty_root(spark, tmp_path):
    spark.dataSource.register(folders.FolderTree)
    assert [r.kind for r in spark.read.format("folder_tree").option("path", f"file://{tmp_path}").load().collect()] == ["folder"]


def test_json_types_of_items(spark):
    items = ['{"file_id":"a","size":3}', '{"file_id":1,"size":"3","name":null}', '{"size":true}', '{"size":3.5}', '{"size":null,"web_view_link":{"x":1}}', "[1]", "{broken", None, "{}", '{"size":12345678901234567890123}', '{"size":-1,"other":[1]}']
    got = [r.w for r in spark.createDataFrame([(i,) for i in items], "raw string").select(checks.wrong_types("raw").alias("w")).collect()]
    assert got == [[], ["file_id", "size"], ["size"], ["size"], ["web_view_link"], None, None, None, [], ["size"], []]
