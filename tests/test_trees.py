from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from braidstone.operators import content, embeddings, text
from braidstone.sources import tables, trees

CACHE = "path string, size long, mtime_ns long, ctime_ns long, ino long, content_id string"
FILES = "path string, data binary, mtime_ns long, executable boolean"


def test_walk_leaves_out_what_must_not_be_shared(spark, tmp_path):
    for d in ("a/b/c", "empty", ".replica/tmp", "a/.replica", "con.d"):
        (tmp_path / d).mkdir(parents=True)
    for f in ("x", "a/y", "a/b/c/z", ".replica/r", "a/.replica/r", "con.d/w", "con", "dot.", os.fsdecode(b"\xff")):
        (tmp_path / f).write_bytes(f.encode(errors="replace"))
    (tmp_path / "x").chmod(0o755)
    (tmp_path / "link").symlink_to(tmp_path / "x")
    (tmp_path / "dirlink").symlink_to(tmp_path / "a")
    os.mkfifo(tmp_path / "pipe")
    got = {r.path: r for r in trees.walk(spark, f"file://{tmp_path}").collect()}
    assert {p: r.kind for p, r in got.items()} == {"a": "dir", "a/b": "dir", "a/b/c": "dir", "empty": "dir", "x": "file", "a/y": "file", "a/b/c/z": "file"}
    assert got["x"].executable and not got["a/y"].executable and got["a/y"].size == 3 and got["a/y"].ino == (tmp_path / "a/y").stat().st_ino
    assert trees.walk(spark, str(tmp_path / "empty")).count() == 0 and trees.walk(spark, str(tmp_path / "none")).count() == 0


def test_scan_hashes_what_the_cache_does_not_know(spark, tmp_path):
    data = {"a": b"", "b": b"x" * 3_000_000, "d/c": b"same"}
    (tmp_path / "d").mkdir()
    for p, x in data.items():
        (tmp_path / p).write_bytes(x)
        os.utime(tmp_path / p, ns=(10**18, 10**18))
    none, now = spark.createDataFrame([], CACHE), time.time_ns()
    first = trees.scan_tree(spark, str(tmp_path), none, now).collect()
    assert {r.path: r.content_id for r in first} == {"d": None, **{p: content.content_id(x) for p, x in data.items()}}
    assert {r.path: r.hit for r in first} == {"d": None, "a": False, "b": False, "d/c": False}
    cache = spark.createDataFrame([(r.path, r.size, r.mtime_ns, r.ctime_ns, r.ino, r.content_id) for r in first if r.kind == "file"], CACHE)
    hits = lambda now: {r.path: r.hit for r in trees.scan_tree(spark, str(tmp_path), cache, now).collect() if r.kind == "file"}
    assert hits(now) == dict.fromkeys(data, True)
    (tmp_path / "d/c").write_bytes(b"SAME")
    os.utime(tmp_path / "d/c", ns=(10**18, 10**18))  # as long and as old, but not written at that time
    assert hits(now) == {"a": True, "b": True, "d/c": False}
    assert hits(10**18 + 10**9) == dict.fromkeys(data, False)  # all changed just now


def test_files_are_written_whole(spark, tmp_path):
    (tmp_path / "old").write_bytes(b"before")
    rows = [("old", b"after", None, None), ("n/e/w", b"", 10**18, True), ("n/null", None, None, False)]
    got = trees.write_files(spark.createDataFrame(rows, FILES), str(tmp_path)).collect()
    assert {(r.path, r["size"]) for r in got} == {("old", 5), ("n/e/w", 0), ("n/null", 0)}
    assert (tmp_path / "old").read_bytes() == b"after" and (tmp_path / "n/e/w").stat().st_mtime_ns == 10**18
    assert os.access(tmp_path / "n/e/w", os.X_OK) and not os.access(tmp_path / "n/null", os.X_OK) and not os.listdir(tmp_path / ".replica/tmp")
    with pytest.raises(Exception, match="unsafe path"):
        trees.write_files(spark.createDataFrame([("../out", b"x", None, None)], FILES), str(tmp_path))
    assert not (tmp_path.parent / "out").exists()
    assert trees.write_files(spark.createDataFrame([], FILES), str(tmp_path)).count() == 0


def test_lists_of_pairs_and_vectors(spark, tmp_path):
    (tmp_path / "pairs.txt").write_text("word1\tword2\tPOS\tscore\nOld\tnew\tA\t1.58\nbig\tbag\tA\t2\nold\tbig\tA\t3.5\n")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    found = tables.word_pairs(spark, str(tmp_path / "pairs.txt"), words("old", "new", "big"), words("old", "big", "new", "bag"))
    assert sorted((r.w1, r.w2, r.human) for r in found.collect()) == [("old", "big", 3.5), ("old", "new", 1.58)]
    assert tables.word_pairs(spark, str(tmp_path / "pairs.txt"), max_pairs=2).count() == 2
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a_b.txt").write_text("1.0 2\n-3e-1\n")
    got = tables.vector_files(spark, spark.createDataFrame([("a b",), ("c",)], "name string"), str(tmp_path / "v"), 2)
    assert {r.name: r.vec for r in got.collect()} == {"a b": [1.0, 2.0, -0.3], "c": [0.0, 0.0]}


def test_tables_replaced_and_looked_up(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), path, 1)
    tables.append(spark.createDataFrame([("a", "3")], "key string, value string"), path, 2)
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    seen = lambda: {r.key: r.value for r in tables.looked_up(asked, spark.read.parquet(path), "key", "none").collect()}
    assert seen() == {"a": "3", "b": "2", "c": "none"}
    tables.replace(spark.read.parquet(path).filter("key = 'a'"), path)
    assert seen() == {"a": "3", "b": "none", "c": "none"}


def test_scores_by_method(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("a", "a", 2.0), ("a", "z", 3.0), ("a", "x", 4.0), ("a", "b", 5.0)], "w1 string, w2 string, human double")
    cells = spark.createDataFrame([("a", "p", 3.0), ("a", "q", 4.0), ("b", "p", 2.0), ("z", "p", 0.0)], "w string, c string, ppmi double")
    names = spark.createDataFrame([("a",), ("b",), ("z",)], "word string")
    got = {r.human: r.score for r in embeddings.similarity_scores(pairs, "ppmi", cells, names).collect()}
    assert got == pytest.approx({1.0: 0.6, 2.0: 1.0, 3.0: 0.0, 5.0: 0.6})
    with pytest.raises(ValueError):
        embeddings.similarity_scores(pairs, "other", cells)


def test_sparse_vectors_and_answers(spark):
    cells = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 2.0), ("a", 2, 0.5)], "name string, dim long, value double")
    got = embeddings.sparse_vectors(spark.createDataFrame([("a",), ("b",)], "name string"), cells, 3).collect()
    assert {r.name: r.vec for r in got} == {"a": [1.0, 0.0, 2.5], "b": [0.0, 0.0, 0.0]}
    found = spark.createDataFrame([(1, "Queen", 1), (1, "x", 2), (2, "no", 1)], "analogy long, answer string, rank long")
    want = spark.createDataFrame([(1, "queen"), (2, "swam"), (3, "N/A?")], "analogy long, expected string")
    assert {r.analogy: (r.answer, r.correct) for r in embeddings.checked_answers(found, want).collect()} == {1: ("Queen", True), 2: ("no", False), 3: ("N/A", False)}


def test_index_is_the_order_of_words(spark):
    words = [f"w{i * 7919 % 997}" for i in range(500)] + ["é", "Z", "\U0001f600"]
    got = text.indexed(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).orderBy("idx").collect()
    assert [r.idx for r in got] == [*range(len(words))] and [r.word for r in got] == sorted(words, key=str.encode)
    assert text.indexed(spark.createDataFrame([], "word string, n long")).count() == 0
