from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from braidstone.functions import paths
from braidstone.functions import version_vectors as VV
from braidstone.functions.vectors import cosine
from braidstone.operators import chars, content, embeddings, sync, text
from braidstone.sources import tables

NODE = "path string, kind string, content_id string, executable boolean"


def test_window_example(spark):
    words = spark.createDataFrame(list(enumerate("the cat sat on the mat".split())), "gpos long, word string")
    cells = text.window_counts(text.cooccurrence(words, text.vocabulary(words, 1), 2), 2)
    got = {(r.w, r.c): r.n for r in cells.collect()}
    assert {c: n for (w, c), n in got.items() if w == "sat"} == {"the": 2, "cat": 1, "on": 1}
    assert {c: n for (w, c), n in got.items() if w == "cat"} == {"the": 1, "sat": 1, "on": 1}
    assert all(got[c, w] == n for (w, c), n in got.items())


def test_unknown_words_keep_their_places(spark):
    words = spark.createDataFrame(list(enumerate("a x x b".split())), "gpos long, word string")
    vocab = spark.createDataFrame([("a",), ("b",)], "word string")
    assert text.cooccurrence(words, vocab, 2).count() == 0


def test_ppmi_worked_example(spark):
    half = [("cat", "dog", 8), ("cat", "fish", 2), ("dog", "fish", 1)]
    cells = spark.createDataFrame(half + [(c, w, n) for w, c, n in half], "w string, c string, n long")
    got = {(r.w, r.c): r.ppmi for r in text.ppmi(cells).collect()}
    assert got["cat", "dog"] == pytest.approx(math.log2(8 * 22 / 90))
    assert got["cat", "fish"] == pytest.approx(0.552541, abs=1e-6)
    assert got["dog", "fish"] == 0


def test_word_in_every_document_has_no_weight(spark):
    td = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 2)], "word string, doc string, tf long")
    got = {(r.word, r.doc): r.tfidf for r in text.tfidf(td, 2).collect()}
    assert got["a", "x"] == got["a", "y"] == 0 and got["b", "x"] == pytest.approx(2 * math.log10(2))


@pytest.mark.parametrize(("a", "b", "want"), [([1, 2], [1, 2], 1), ([1, 0], [0, 1], 0), ([1, 0], [-1, 0], -1), ([0, 0], [1, 1], 0), ([1, 1], [1, 0], 1 / math.sqrt(2))])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<double>, b array<double>")
    assert df.select(cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_characters_round_trip_and_shift(spark):
    docs = spark.createDataFrame([(0, "hello"), (1, ""), (2, "é\nz")], "doc_id long, text string")
    v = chars.char_vocabulary(docs)
    assert {r.doc_id: r.decoded for r in chars.decode(chars.encode(docs, v), v).collect()} == {0: "hello", 1: "", 2: "é\nz"}
    got = {r.start: (r.x, r.y) for r in chars.blocks(docs, 4, 1).collect()}
    assert got == {0: ("hell", "ello"), 1: ("ello", "lloé"), 2: ("lloé", "loé\n")}
    assert {r.doc_id: (r.n_train, r.n_val) for r in chars.train_val(docs, 0.8).collect()} == {0: (5, 0), 1: (0, 0), 2: (1, 2)}


def test_vectors_of_versions(spark):
    m = "map<string,bigint>"
    rows = [({"x": 2, "y": 1}, {"x": 1, "y": 1}, "newer"), ({"x": 2, "y": 1}, {"x": 1, "y": 2}, "concurrent"), ({"a": 0}, {}, "same"), ({}, {"q": 1}, "older")]
    df = spark.createDataFrame(rows, f"a {m}, b {m}, want string")
    a, b = VV.of(F.col("a")), VV.of(F.col("b"))
    for r in df.select(VV.compare(a, b).alias("got"), "want", VV.to_json(VV.merge(a, b)).alias("ab"), VV.to_json(VV.merge(b, a)).alias("ba"), VV.to_json(VV.from_json(VV.to_json(a))).alias("back"), VV.to_json(a).alias("text")).collect():
        assert r.got == r.want and r.ab == r.ba and r.back == r.text


def _plan(spark, local, base, remote, **more):
    row = lambda p, c, kind="file": (p, kind, c if kind == "file" else None, False)
    loc = spark.createDataFrame([row(*x) for x in local], NODE)
    entry = lambda rows: spark.createDataFrame([(*row(*x[:-1]), x[-1]) for x in rows], NODE + ", vv map<string,bigint>")
    return sync.reconcile(loc, entry(base), entry(remote), **more)


P1, PQ = {"p": 1}, {"p": 1, "q": 1}
CASES = [
    ([("a", "1")], [("a", "1", P1)], [("a", "1", P1)], set()),
    ([("a", "2")], [("a", "1", P1)], [("a", "1", P1)], {("PUSH", "a")}),
    ([("a", "1")], [("a", "1", P1)], [("a", "2", PQ)], {("PULL", "a")}),
    ([], [("a", "1", P1)], [("a", "1", P1)], {("DELETE_REMOTE", "a")}),
    ([], [], [("a", "1", P1)], {("PULL", "a")}),
    ([("a", "new")], [("a", "old", P1)], [("a", "new", PQ)], {("CONVERGE", "a")}),
    ([], [("a", "old", P1)], [("a", "new", PQ)], {("PULL", "a")}),
    ([("a", "mine")], [("a", "old", P1)], [("a", None, "deleted", PQ)], {("PUSH", "a")}),
    ([], [("a", "old", P1)], [("a", None, "deleted", PQ)], {("CONVERGE", "a")}),
    ([("a", "mine")], [("a", "old", P1)], [("a", "theirs", PQ)], {("CONFLICT_SPLIT", "a")}),
    ([], [], [("d", None, "dir", P1), ("d/f", "1", P1)], {("MKDIR_LOCAL", "d"), ("PULL", "d/f")}),
    ([("d", None, "dir")], [], [], {("MKDIR_REMOTE", "d")}),
    ([("a", "1")], [("a", "1", P1)], [("a", None, "deleted", PQ)], {("DELETE_LOCAL", "a")}),
]


@pytest.mark.parametrize(("local", "base", "remote", "want"), CASES)
def test_every_row_of_the_decision_table(spark, local, base, remote, want):
    assert {(r.op, r.path) for r in _plan(spark, local, base, remote).collect()} == want


def test_merge_when_asked(spark):
    got = _plan(spark, [("a", "m")], [("a", "o", P1)], [("a", "t", PQ)], merge_text=True)
    assert [r.op for r in got.collect()] == ["MERGE_TEXT"]


def test_rename_is_one_move_and_a_tombstone_blocks_it(spark):
    got = sync.detect_moves(_plan(spark, [("new/x", "c"), ("new", None, "dir")], [("old/x", "c", P1)], [("old/x", "c", P1)]))
    assert {(r.op, r.path, r.from_path) for r in got.collect()} == {("MOVE_REMOTE", "new/x", "old/x"), ("MKDIR_REMOTE", "new", None)}
    tombstone = [("b.txt", "same", {"three": 1, "two": 2}), ("dir/e.txt", None, "deleted", {"one": 1, "two": 1})]
    got = sync.detect_moves(_plan(spark, [("dir/e.txt", "same")], [("b.txt", "same", {"three": 1, "two": 2})], tombstone))
    assert {(r.op, r.path) for r in got.collect()} == {("DELETE_REMOTE", "b.txt"), ("PUSH", "dir/e.txt")}


def test_commits(spark):
    req = [("a", 1, "x1", "file", "c", {"p": 1}), ("a", 2, "x2", "file", "c", {"q": 1}), ("a", 3, "x1", "file", "c", {"p": 1}), ("a", 4, "x3", "file", "gone", {"p": 2}), ("b", 5, "y", "deleted", None, {"p": 1})]
    df = spark.createDataFrame(req, "path string, arrival long, op_id string, kind string, content_id string, vv map<string,bigint>")
    got = [(r.status, r.seq) for r in sync.cas_commit(df, spark.createDataFrame([("c",)], "content_id string")).orderBy("arrival").collect()]
    assert got == [("ok", 1), ("conflict", None), ("replay", None), ("missing", None), ("ok", 2)]


def test_tombstones_wait_for_every_replica(spark):
    e = spark.createDataFrame([("a", "deleted", 3), ("b", "file", 1)], "path string, kind string, seq long")
    at = lambda n: spark.createDataFrame([("fast", 9), ("slow", n)], "replica string, cursor long")
    known = spark.createDataFrame([("fast",), ("slow",), ("new",)], "replica string")
    assert sync.collect_tombstones(e, at(0)).count() == 0 and sync.collect_tombstones(e, at(9)).count() == 1
    assert sync.collect_tombstones(e, at(9), known).count() == 0


def test_feed_gives_current_state(spark):
    log = spark.createDataFrame([("a", i, f"p{i}") for i in range(1, 6)], "path string, seq long, who string")
    got = sync.change_feed(log, 0).collect()
    assert [(r.path, r.seq, r.truncated) for r in got] == [("a", 5, False)] and sync.change_feed(log, 5).count() == 0


def _rolling(data: bytes) -> list[int]:
    g, h, out, start = content._gear(), 0, [], 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(g[b])) % (1 << 64)
        n = i + 1 - start
        if n >= content.CHUNK_MIN and h >> (64 - content.CUT_BITS) == 0 or n >= content.CHUNK_MAX or i + 1 == len(data):
            out.append(i + 1)
            start, h = i + 1, 0
    return out


@pytest.mark.parametrize("n", [0, 1, 63, 64, 2048, 70_000, 200_000])
def test_chunk_ends_equal_the_rolling_definition(n):
    data = random.Random(n).randbytes(n)
    assert content.boundaries(data) == _rolling(data)


def test_chunks_survive_an_insert(spark):
    a = random.Random(7).randbytes(200_000)
    b = a[:90_000] + b"inserted!" + a[90_000:]
    rows = content.chunk_rows(spark.createDataFrame([("a", a), ("b", b)], "file string, data binary"))
    old, new = ({r.chunk for r in rows.filter(F.col("file") == f).collect()} for f in "ab")
    assert len(old & new) / len(new) > 0.8
    back = sync.reassemble(rows.select("file", "pos", "chunk"), rows.select("chunk", "data").dropDuplicates(["chunk"]))
    assert {r.file: bytes(r.data) for r in back.collect()} == {"a": a, "b": b}


def test_merges():
    assert content.merge_text(b"a\nb\nc\n", b"a\nb\nc\nd\n", b"A\nb\nc\n") == (b"A\nb\nc\nd\n", True, 0)
    assert content.merge_text(b"a\nb\n", b"a\nX\n", b"a\nY\n")[1:] == (False, 1)
    assert content.merge_text(b"a\nb\n", b"a\nX\n", b"a\nX\n") == (b"a\nX\n", True, 0)
    assert content.merge_text(b"\0", b"a", b"b") is None


@pytest.mark.parametrize("moves", [[("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a")], [("a", "b"), ("b", "c")]])
def test_moves_with_cycles(moves):
    tree = {s: s for s, _ in moves}
    for s, t in sync.move_order(moves):
        assert t not in tree
        tree[t] = tree.pop(s)
    assert tree == {t: s for s, t in moves}


def test_paths(spark):
    rows = [("../../etc/passwd", False), (".replica/state.db", False), ("CON.txt", False), ("dir/PRN", False), ("dir/console.txt", True), ("", False), ("C:/x", False), ("a/b ", False)]
    got = spark.createDataFrame(rows, "p string, want boolean").select(paths.is_safe(F.col("p")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    nfd = spark.createDataFrame([("cafe\u0301//x/../y",), ("/abs",)], "p string").select(paths.normalise("p").alias("p")).collect()
    assert [r.p for r in nfd] == ["caf\u00e9/y", "abs"]


def test_clusters(spark):
    rng = random.Random(1)
    rows = [(0, 10 * c + i, [c * 5 + rng.random(), rng.random()], c) for c in range(3) for i in range(6)]
    items = spark.createDataFrame(rows, "target long, vec_id long, embedding array<double>, label int")
    for auto in (False, True):
        found = embeddings.kmeans(items, "target", auto).join(items.select("vec_id", "label"), "vec_id")
        assert {r.k for r in found.collect()} == {3}
        assert embeddings.paired_fscore(found, "target", "predicted", "label").first().fscore == 1.0
    two = embeddings.kmeans(items.limit(2), "target", auto=True).collect()
    assert all(r.k is None and r.predicted is None for r in two)


def test_readers(spark, tmp_path):
    (tmp_path / "the_play.txt").write_text("To Be\nor")
    assert [(r.doc, r.text) for r in tables.text_corpus(spark, str(tmp_path)).collect()] == [("The Play", "to be\nor")]
    (tmp_path / "c.tsv").write_text("bank\t2\tfinancial::firm::0\triver::1\n\n")
    r = tables.sense_clusters(spark, str(tmp_path / "c.tsv")).first()
    assert (r.target, r.k, [(i.phrase, i.label) for i in r["items"]]) == ("bank", 2, [("financial::firm", 0), ("river", 1)])


def test_commit_stream(spark, tmp_path):
    from braidstone.streaming.commits import commit_stream

    schema = "path string, arrival long, op_id string, vv map<string,bigint>"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "x", {"p": 1}), ("a", 2, "y", {"q": 1})], schema).coalesce(1).write.mode("append").parquet(source)
    out = commit_stream(spark.readStream.schema(schema).parquet(source))
    q = out.writeStream.format("memory").queryName("commits").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    spark.createDataFrame([("a", 3, "x", {"p": 1}), ("a", 4, "z", {"p": 2})], schema).coalesce(1).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    assert [r.status for r in spark.table("commits").orderBy("arrival").collect()] == ["ok", "conflict", "replay", "ok"]


def _tau_b(pairs):
    sign = lambda a: (a > 0) - (a < 0)
    both = [(sign(a - c), sign(b - d)) for i, (a, b) in enumerate(pairs) for c, d in pairs[:i]]
    s, a, b = sum(x * y for x, y in both), sum(x * x for x, _ in both), sum(y * y for _, y in both)
    return s / math.sqrt(a * b) if a and b else None


@pytest.mark.parametrize("kind,n,block", [("free", 1500, 4096), ("ties", 1500, 100), ("free", 700, 64), ("few", 400, 30), ("one", 50, 7), ("none", 0, 7)])
def test_tau_takes_all_pairs(spark, monkeypatch, kind, n, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = random.Random(n + block)
    draw = {"free": rng.random, "ties": lambda: rng.randrange(40) - 20.0, "few": lambda: rng.choice([0.0, -0.0, 1.0]), "one": lambda: 3.0, "none": None}[kind]
    pairs = [(x, x + 20 * rng.random() if kind == "free" and i < n / 2 else draw()) for i in range(n) for x in [draw()]]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id long, x double, y double").repartition(3)
    got = embeddings.kendall_tau_b(df, "x", "y", "id").collect()
    want = _tau_b(pairs)
    assert len(got) == 1 and (got[0].tau is None if want is None else got[0].tau == pytest.approx(want, abs=1e-12))


def test_similar_words_ask_for_every_20th(spark):
    from braidstone.plans import text_queries

    d = "/root/testdata/sf0.001"
    want = {r.word for r in text_queries.word_count_min50(spark, d).filter("idx % 20 = 0").collect()}
    got = text_queries.similar_words_ppmi(spark, d).toPandas()
    assert want and set(got["word"]) == want and (got.groupby("word").size() == 10).all()


def test_merge_ranges_and_outcomes(spark):
    lines = lambda s: "".join(f"{x}\n" for x in s).encode()
    base = lines("abcdef")
    merged, clean, regions = content.merge_text(base, lines("af"), lines("abf"))  # both delete, over different ranges
    assert clean and regions == 0 and merged == lines("af")
    rows = [(1, base, lines("Xabcdef"), lines("abcdefY")), (2, base, lines("abXdef"), lines("abYdef")), (3, None, base, base), (4, base, b"\0", base)]
    got = content.merge_rows(spark.createDataFrame(rows, "id long, base binary, mine binary, theirs binary"), "id")
    assert {r.id: r.op for r in content.merge_outcome(got).collect()} == {1: "MERGED", 2: "CONFLICT_SPLIT", 3: "CONFLICT_SPLIT", 4: "CONFLICT_SPLIT"}
    assert {r.id: r.op for r in content.merge_outcome(got, markers=True).collect()}[2] == "MERGED"


def test_chunks_are_verified(spark):
    data = [("a", b"one" * 9000), ("b", b""), ("c", None)]
    files = spark.createDataFrame(data, "file string, data binary")
    ids = spark.createDataFrame([("a", content.content_id(data[0][1])), ("b", "b2:other")], "file string, content_id string")
    assert {r.file: r.intact for r in sync.verified(files, ids).collect()} == {"a": True, "b": False, "c": False}
    up = spark.createDataFrame([(content.content_id(b"x"), b"x"), (content.content_id(b"x"), b"x"), (content.content_id(b"y"), b"x"), (content.content_id(b"z"), b"z")], "chunk string, data binary")
    assert [bytes(r.data) for r in sync.accepted_chunks(up, up.filter(F.col("data") == b"z")).collect()] == [b"x"]
    assert sync.accepted_chunks(up, up.limit(0)).count() == 2 and sync.live_paths(spark.createDataFrame([], "path string, seq long, kind string")).count() == 0


def test_cooccurrence_across_documents(spark, monkeypatch):
    """Counted inside documents and across them as in the stream, whatever size the vocabulary has."""
    texts = ["the cat sat", "", None, "on", "the mat the cat", "a b c d e f g the", "sat"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    words = [w for t in texts for w in (t or "").split()]
    known = {"the", "cat", "sat", "on", "mat", "g"}
    vocab = spark.createDataFrame([(w,) for w in known], "word string")
    want = {}
    for i, w in enumerate(words):
        for j, c in enumerate(words):
            if 0 < abs(i - j) <= 3 and w in known and c in known:
                want[w, c, abs(i - j)] = want.get((w, c, abs(i - j)), 0) + 1
    for most in (200_000, 2):
        monkeypatch.setattr(text, "SENT_WORDS", most)
        assert {(r.w, r.c, r.d): r.n for r in text.document_cooccurrence(text.placed_arrays(df), vocab, 3).collect()} == want


def test_paths_checked(spark):
    df = spark.createDataFrame([("a/b",), ("1:/x",), (".replica/t",), (".own/t",)], "p string")
    assert [r[0] for r in df.select(paths.is_safe(F.col("p"))).collect()] == [True, False, False, True]
    assert [r[0] for r in df.select(paths.is_safe(F.col("p"), ".own")).collect()] == [True, False, True, False]
    with pytest.raises(Exception, match="unsafe path"):
        df.select(paths.check_safe(F.col("p"))).collect()
    assert spark.range(1).select(paths.short_id(F.lit("b2:0123456789ab"))).first()[0] == "01234567"
