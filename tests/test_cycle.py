from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidstone.functions import version_vectors as VV
from braidstone.operators import chars, cycle, models, sync

NODE = "path string, kind string, content_id string, executable boolean"
STAMP = "2024-01-02 030405"


def trees(spark, local=(), base=(), remote=()):
    tree = lambda rows, more="": spark.createDataFrame([(r[0], "deleted" if r[1] is None else "dir" if r[1] == "/" else "file", None if r[1] == "/" else r[1], False, *r[2:]) for r in rows], NODE + more)
    return tree(local), tree(base, ", vv map<string,bigint>"), tree(remote, ", vv map<string,bigint>")


def contents(tree):
    return {r.path: r.content_id for r in tree.filter("kind <> 'deleted'").collect()}


def test_a_conflict_keeps_both_versions_under_a_free_name(spark):
    taken = f"a (conflicted copy from p {STAMP}).txt"
    got = cycle.run_to_quiescence(*trees(spark, [("a.txt", "mine"), (taken, "old")], [("a.txt", "0", {"p": 1})], [("a.txt", "theirs", {"p": 1, "q": 1})]), "p", STAMP)
    want = {"a.txt": "theirs", taken: "old", f"a (conflicted copy from p {STAMP} #2).txt": "mine"}
    assert contents(got[0]) == contents(got[2]) == want and got[3] == 1
    assert sync.reconcile(*got[:3]).count() == 0


def test_nothing_to_do_takes_no_pass(spark):
    assert cycle.run_to_quiescence(*trees(spark), "p", STAMP)[3] == 0
    same = trees(spark, [("a", "1")], [("a", "1", {"p": 1})], [("a", "1", {"p": 1})])
    assert cycle.run_to_quiescence(*same, "p", STAMP)[3] == 0


def test_a_write_dominates_what_was_known(spark):
    _, base, remote, _ = cycle.run_to_quiescence(*trees(spark, [("a", "2")], [("a", "1", {"p": 1, "q": 2})], [("a", "1", {"p": 1, "q": 2})]), "p", STAMP)
    assert [r.vv for r in remote.collect()] == [r.vv for r in base.collect()] == [{"p": 2, "q": 2}]


def test_two_replicas_converge(spark):
    rng = random.Random(1)
    side = lambda: [(f"d/f{i}", str(rng.randrange(3))) for i in range(12) if rng.random() < 0.7]
    (lp, bp, remote), (lq, bq, _) = trees(spark, side()), trees(spark, side())
    kept = {x for t in (lp, lq) for x in contents(t).values()}
    for _ in range(2):
        lp, bp, remote, _ = cycle.run_to_quiescence(lp, bp, remote, "p", STAMP)
        lq, bq, remote, _ = cycle.run_to_quiescence(lq, bq, remote, "q", STAMP)
    lp, bp, remote, _ = cycle.run_to_quiescence(lp, bp, remote, "p", STAMP)
    assert contents(lp) == contents(lq) == contents(remote)
    assert set(contents(lp).values()) == kept


@pytest.mark.parametrize("seed", [1])
def test_moves_in_steps_reach_their_targets(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(40)]
    sources = rng.sample(names, 25)
    moves = dict(zip(sources, rng.sample([*sources[:20], *(f"x{i}" for i in range(5))], 25), strict=True))
    rows = cycle.move_steps(spark.createDataFrame(list(moves.items()), "source string, target string")).collect()
    at = {n: n for n in sources}
    for step in sorted({r.step for r in rows}):
        here = [(r.source, r.target) for r in rows if r.step == step]
        for s, t in here:
            assert s in at and t not in at, "a target must be free"
        for s, t in here:
            at[t] = at.pop(s)
    assert at == {t: s for s, t in moves.items()}
    assert cycle.move_steps(spark.createDataFrame([], "source string, target string")).count() == 0


def test_trash_and_folders(spark):
    t = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-02-20"), ("c", None)], "path string, d string").select("path", F.col("d").cast("timestamp").alias("deleted_at"))
    got = {r.path: r.purge for r in cycle.purge_trash(t, F.lit("2024-03-01").cast("timestamp")).collect()}
    assert got == {"a": True, "b": False, "c": False}
    tree = spark.createDataFrame([("a", "dir"), ("a/b", "dir"), ("c", "dir"), ("c/d", "dir"), ("c/x", "file"), ("a/b/y", "deleted")], "path string, kind string")
    assert {r.path for r in cycle.empty_folders(tree).collect()} == {"a", "a/b", "c/d"}


def test_uploads_ask_again(spark):
    chunk = lambda x, *more: spark.createDataFrame(x, "attempt long, chunk string") if more else spark.createDataFrame([(c,) for c in x], "chunk string")
    rows = cycle.upload_attempts(chunk("aabcd"), chunk("d"), chunk([(1, "a"), (1, "d"), (2, "a"), (2, "b")], True)).collect()
    assert sorted((r.attempt, r.arrived, r.wasted, r.left) for r in rows) == [(1, 1, 1, 2), (2, 1, 1, 1)]


def test_relations_of_vectors(spark):
    row = spark.range(1).select(VV.of(F.expr("map('b', 1L, 'a', 2L, 'z', 0L)")).alias("a"), VV.of(F.expr("map('a', 2L)")).alias("b"))
    r = row.select(VV.dominates(F.col("a"), F.col("b")), VV.dominates(F.col("a"), F.col("a")), VV.concurrent_with(F.col("a"), F.col("b")), VV.replicas(F.col("a"))).first()
    assert [*r] == [True, False, False, ["a", "b"]]


@pytest.mark.parametrize(("length", "batch"), [(5, 40), (60, 10)])
def test_random_windows_are_parts_of_the_stream(spark, length, batch):
    texts = ["abcdefg", "", None, "hé" * 40, "x", "0123456789"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stream = "".join(t or "" for t in texts)
    rows = chars.random_blocks(docs, length, batch, seed=3).collect()
    assert sorted(r.draw for r in rows) == list(range(batch))
    for r in rows:
        assert 0 <= r.start <= len(stream) - length - 2
        assert (r.x, r.y) == (stream[r.start : r.start + length], stream[r.start + 1 : r.start + length + 1])
    assert chars.random_blocks(docs, len(stream), 3).count() == 0


def by_hand(m, ids):
    """Logits of one sequence, place by place."""
    norm = lambda v: (v - v.mean()) / math.sqrt(((v - v.mean()) ** 2).mean() + 1e-5)
    xs = [m.embed[t] + m.place[i] for i, t in enumerate(ids)]
    for layer in m.layers:
        ns, size = [norm(x) for x in xs], len(xs[0]) // layer.heads
        out = []
        for i, x in enumerate(xs):
            heads = []
            for h in range(layer.heads):
                s = slice(h * size, (h + 1) * size)
                q = (ns[i] @ layer.q)[s]
                e = [math.exp(q @ (n @ layer.k)[s] / math.sqrt(size)) for n in ns[: i + 1]]
                heads.append(sum(w / sum(e) * (n @ layer.v)[s] for w, n in zip(e, ns, strict=False)))
            x = x + np.concatenate(heads) @ layer.proj
            out.append(x + np.maximum(norm(x) @ layer.up, 0) @ layer.down)
        xs = out
    return np.array([norm(x) @ m.out + m.bias for x in xs])


def strong(m):
    """Larger weights, so that every part has a say."""
    for part in (m, *m.layers):
        for name, w in vars(part).items():
            if isinstance(w, np.ndarray):
                setattr(part, name, w * 20)
    return m


def test_transformer_equals_place_by_place():
    m = strong(models.Transformer.random(11, size=8, heads=2, layers=2, block=6, seed=5))
    ids = np.array([[1, 4, 2, 10, 0, 3], [7, 7, 7, 1, 2, 9]])
    got = m.logits(ids)
    assert np.allclose(got, [by_hand(m, s) for s in ids])
    changed = ids.copy()
    changed[:, 4:] = 5  # the past does not see the future
    assert np.allclose(m.logits(changed)[:, :4], got[:, :4])


def test_losses(spark):
    seqs = [(1, [1, 2, 3, 4, 5, 6, 7]), (2, [3]), (3, []), (4, None), (5, [0] * 40)]
    rows = spark.createDataFrame(seqs, "key long, ids array<int>")
    m = strong(models.Transformer.random(8, size=8, heads=2, layers=1, block=4, seed=2))
    got = {r.key: (r.targets, r.loss) for r in models.losses(rows, "key", "ids", m).collect()}
    for k, s in seqs:
        s, total = s or [], 0.0
        for at in range(0, max(0, len(s) - 1), 4):
            z = by_hand(m, s[at : min(at + 4, len(s) - 1)])
            total += sum(math.log(sum(math.exp(a) for a in v)) - v[t] for v, t in zip(z, s[at + 1 : at + 5], strict=True))
        n = max(0, len(s) - 1)
        assert got[k][0] == n and (got[k][1] is None if n == 0 else got[k][1] == pytest.approx(total / n))
    flat = models.Recurrent.random(8, size=4)
    flat.out[:] = 0
    assert all(r.loss == pytest.approx(math.log(8)) for r in models.losses(rows, "key", "ids", flat).collect() if r.targets)


def test_recurrent_states_carry_on(spark):
    m = models.Recurrent.random(6, size=3, seed=4)
    m.embed, m.wx, m.wh = m.embed * 30, m.wx * 30, m.wh * 30
    s = [1, 5, 0, 2]
    h = [0.0] * 3
    for i in s:
        h = [math.tanh(sum(m.embed[i][a] * m.wx[a][j] for a in range(3)) + m.b[j] + sum(h[a] * m.wh[a][j] for a in range(3))) for j in range(3)]
    rows = spark.createDataFrame([(1, s), (2, None)], "key long, ids array<int>")
    got = {r.key: r.state for r in models.last_states(rows, "key", "ids", m).collect()}
    assert got[1] == pytest.approx(h) and got[2] == [0, 0, 0]
    assert m.states(np.array([s]))[0, -1] == pytest.approx(h)


def test_samples(spark):
    m = strong(models.Transformer.random(8, size=8, heads=2, layers=1, block=4, seed=2))
    rows = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6]), (2, [3]), (3, []), (None, None)], "key long, ids array<int>")
    run = lambda df, **how: {r.key: r.drawn for r in models.continued(df, "key", "ids", m, 6, **how).collect()}
    one = run(rows, temperature=0.7, seed=1)
    assert one == run(rows.repartition(3), temperature=0.7, seed=1) and one != run(rows, temperature=0.7, seed=2)
    now = [3, 4, 5, 6]
    for _ in range(6):
        now.append(int(by_hand(m, now[-4:])[-1].argmax()))
    assert run(rows, temperature=0)[1] == now[4:]
    free = run(spark.createDataFrame([(k, [1, 2]) for k in range(4000)], "key long, ids array<int>").repartition(4), seed=3)
    z = by_hand(m, [1, 2])[-1]
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert np.allclose(np.bincount([d[0] for d in free.values()], minlength=8) / 4000, p, atol=0.04)
