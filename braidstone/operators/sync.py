"""Replica reconciliation over relations: plans, moves, commits, feeds, tombstones, chunks, convergence.

A node: ``path, kind (file, dir, deleted), content_id, executable``; an entry also ``vv`` (version vector).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidstone.functions import version_vectors as VV
from braidstone.functions.paths import depth
from braidstone.operators.content import content_ids
from braidstone.operators.text import offsets

# The order in which operations may run: fixed values.
PHASES = {"CONFLICT_SPLIT": 1, "MERGE_TEXT": 1, "DELETE_LOCAL": 2, "MKDIR_LOCAL": 3, "MOVE_LOCAL": 4, "PULL": 5, "MKDIR_REMOTE": 6, "MOVE_REMOTE": 6, "PUSH": 6, "DELETE_REMOTE": 6, "CONVERGE": 7, "NOOP": 8}


def _live(n: str) -> Column:
    return F.col(f"{n}.kind").isNotNull() & (F.col(f"{n}.kind") != "deleted")


def _equal(a: str, b: str) -> Column:
    """Same kind, and for files the same content and executable bit; times do not matter."""
    same = F.col(f"{a}.content_id").eqNullSafe(F.col(f"{b}.content_id")) & F.col(f"{a}.executable").eqNullSafe(F.col(f"{b}.executable"))
    return F.col(f"{a}.kind").eqNullSafe(F.col(f"{b}.kind")) & ((F.col(f"{a}.kind") != "file") | same)


def same(a: str, b: str) -> Column:
    """Absent and deleted are alike."""
    return F.when(~_live(a) & ~_live(b), True).when(_live(a) != _live(b), False).otherwise(_equal(a, b))


def reconcile(local: DataFrame, base: DataFrame, remote: DataFrame, merge_text: bool = False) -> DataFrame:
    """``(path, op, local_cid, remote_cid, base_live, remote_live)``, one row per path that needs something.

    Local changes are judged by content against the base, remote ones by causality: the remote vector goes beyond the
    base's. Two full outer joins on the path, then the decision table in order.
    """
    node = lambda df, n: df.select("path", F.struct("kind", "content_id", "executable", *(["vv"] if "vv" in df.columns else [])).alias(n))
    j = node(local, "l").join(node(base, "b"), "path", "full_outer").join(node(remote, "r"), "path", "full_outer")
    ahead = ~VV.descends_from(VV.of(F.col("b.vv")), VV.of(F.col("r.vv")))
    j = j.withColumns({"lc": ~same("l", "b"), "rc": F.col("r").isNotNull() & (F.col("b").isNull() | ahead), "ll": _live("l"), "rl": _live("r"), "bl": F.col("b").isNotNull()})
    files = (F.col("l.kind") == "file") & (F.col("r.kind") == "file") & (F.col("b.kind") == "file")
    op = (
        F.when(~F.col("lc") & ~F.col("rc"), F.lit(None))
        .when(F.col("lc") & ~F.col("rc"), F.when(~F.col("ll"), "DELETE_REMOTE").when((F.col("l.kind") == "dir") & ~F.col("bl"), "MKDIR_REMOTE").when(F.col("l.kind") == "dir", "NOOP").otherwise("PUSH"))
        .when(~F.col("lc"), F.when(~F.col("rl"), F.when(F.col("l").isNull(), "CONVERGE").otherwise("DELETE_LOCAL")).when(F.col("r.kind") == "dir", F.when(F.col("l.kind") == "dir", "CONVERGE").otherwise("MKDIR_LOCAL")).otherwise("PULL"))
        .when(same("l", "r"), "CONVERGE")
        .when(~F.col("ll") & F.col("rl"), "PULL")
        .when(F.col("ll") & ~F.col("rl"), "PUSH")
        .when(F.lit(merge_text) & files, "MERGE_TEXT")
        .otherwise("CONFLICT_SPLIT")
    )
    cid = lambda n: F.when(F.col(f"{n}.kind") == "file", F.col(f"{n}.content_id"))
    return j.select("path", op.alias("op"), cid("l").alias("local_cid"), cid("r").alias("remote_cid"), cid("b").alias("base_cid"), F.col("bl").alias("in_base"), F.col("r").isNotNull().alias("in_remote")).filter(F.col("op").isNotNull())


def detect_moves(plan: DataFrame) -> DataFrame:
    """``(path, op, from_path)``: a deletion and a creation of one content become a move.

    Per content the last deletion by path and the first creation by path; the deletion leaves the plan.
    """

    def pairs(gone: str, gone_cid: str, made: str, made_cid: str, fresh: Column, move: str) -> DataFrame:
        d = plan.filter((F.col("op") == gone) & F.col(gone_cid).isNotNull()).groupBy(F.col(gone_cid).alias("cid")).agg(F.max("path").alias("from_path"))
        c = plan.filter((F.col("op") == made) & fresh & F.col(made_cid).isNotNull()).groupBy(F.col(made_cid).alias("cid")).agg(F.min("path").alias("path"))
        return d.join(c, "cid").select("path", F.lit(move).alias("move"), "from_path")

    remote = pairs("DELETE_REMOTE", "base_cid", "PUSH", "local_cid", ~F.col("in_base") & ~F.col("in_remote"), "MOVE_REMOTE")
    local = pairs("DELETE_LOCAL", "local_cid", "PULL", "remote_cid", ~F.col("in_base"), "MOVE_LOCAL")
    moves = remote.unionByName(local)
    left = plan.join(moves.select(F.col("from_path").alias("path")), "path", "left_anti").join(moves, "path", "left")
    return left.select("path", F.coalesce("move", "op").alias("op"), "from_path")


def phase(op: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in PHASES.items() for x in kv)), op)


def plan_order(plan: DataFrame) -> DataFrame:
    """``plan`` without NOOP, with the sort keys ``phase`` and ``level``: deletions deepest first, all else shallow first."""
    deep = depth(F.col("path"))
    return plan.filter("op <> 'NOOP'").withColumns({"phase": phase(F.col("op")), "level": F.when(F.col("op").isin("DELETE_LOCAL", "DELETE_REMOTE"), -deep).otherwise(deep)})


_COMMIT = "path string, arrival long, op_id string, status string, vv map<string,long>"


def cas_commit(requests: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """``(path, arrival, op_id, status, seq, vv)`` of ``requests(path, arrival, op_id, kind, content_id, vv)``.

    In order of arrival for each path: a repeated op_id gets its first OK again (``replay``), a file whose content is
    unknown is ``missing``, a vector that does not descend from the current one a ``conflict``, all else ``ok``. An
    equal vector is accepted and counts. A path's requests pass in order through one task, which keeps only its
    current vector and the ids it has accepted; ``seq`` numbers accepted rows over all paths by arrival.
    """
    known = requests.withColumn("has", F.lit(True))
    if contents is not None:
        known = requests.join(contents.select("content_id").distinct().withColumn("has", F.lit(True)), "content_id", "left")
    ready = known.select("path", "arrival", "op_id", (F.col("kind").eqNullSafe("file") & F.col("has").isNull()).alias("lacks"), VV.of(F.col("vv")).alias("vv"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, done = object(), {}, set()
        for b in batches:
            said = []
            for path, op_id, lacks, vv in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if path != at:
                    at, now, done = path, {}, set()
                vv = dict(vv)
                if op_id in done:
                    said.append("replay")
                elif lacks:
                    said.append("missing")
                elif any(vv.get(k, 0) < n for k, n in now.items()):
                    said.append("conflict")
                else:
                    said.append("ok")
                    now = vv
                    done.add(op_id)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(said, pa.string()), b.column(4)], ["path", "arrival", "op_id", "status", "vv"])

    folded = ready.repartition("path").sortWithinPartitions("path", "arrival").mapInArrow(fold, _COMMIT)
    return _numbered(folded)


def _numbered(results: DataFrame, block: int = 4096) -> DataFrame:
    """``results`` with ``seq``: the rank of an accepted row by arrival, counted in blocks of arrivals."""
    ok = F.when(F.col("status") == "ok", 1).otherwise(0)
    b = results.withColumns({"block": F.floor(F.col("arrival") / block), "is_ok": ok})
    sums = b.groupBy("block").agg(F.sum("is_ok").alias("n"))
    before = sums.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    inside = F.sum("is_ok").over(Window.partitionBy("block").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0))
    seq = F.when(F.col("status") == "ok", (F.col("inside") + F.col("before")).cast("long"))
    return b.withColumn("inside", inside).join(before, "block").select("path", "arrival", "op_id", "status", seq.alias("seq"), "vv")


def change_feed(log: DataFrame, cursor: int, limit: int = 1000) -> DataFrame:
    """The current state of each path that changed behind ``cursor``, by seq, one page; ``truncated`` if there is more."""
    latest = log.groupBy("path").agg(F.max(F.struct("seq", *[c for c in log.columns if c not in ("path", "seq")])).alias("e")).select("path", "e.*").filter(F.col("seq") > cursor)
    page = latest.orderBy("seq").limit(limit + 1)
    n = page.agg(F.count(F.lit(1)).alias("n"))
    return page.orderBy("seq").limit(limit).join(F.broadcast(n)).withColumn("truncated", F.col("n") > limit).drop("n")


def latest_cursors(reports: DataFrame) -> DataFrame:
    """``(replica, cursor)``: each replica's last report by arrival."""
    return reports.groupBy("replica").agg(F.max_by("cursor", "arrival").alias("cursor"))


def collect_tombstones(entries: DataFrame, cursors: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The deleted entries that may go: those every replica has seen. None while a known replica has not reported."""
    low = cursors.agg(F.min("cursor").alias("low"))
    out = entries.filter("kind = 'deleted'").join(F.broadcast(low)).filter(F.col("seq") <= F.col("low"))
    if known is not None:
        silent = known.join(cursors, "replica", "left_anti").agg(F.count(F.lit(1)).alias("silent"))
        out = out.join(F.broadcast(silent)).filter("silent = 0").drop("silent")
    return out.drop("low")


def missing_chunks(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """The distinct chunks of a manifest that a store lacks."""
    return manifest.select("chunk").distinct().join(store.select("chunk"), "chunk", "left_anti")


def chunk_similarity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``(key, shared, total, needed_bytes)``: chunks of b found in a, with repeats; bytes of the distinct others."""
    there = a.select(key, "chunk").distinct().withColumn("there", F.lit(1))
    marked = b.join(there, [key, "chunk"], "left")
    counts = marked.groupBy(key).agg(F.count("there").alias("shared"), F.count(F.lit(1)).alias("total"))
    need = marked.filter("there is null").select(key, "chunk", "size").distinct().groupBy(key).agg(F.sum("size").alias("needed_bytes"))
    return counts.join(need, key, "left").withColumn("needed_bytes", F.coalesce("needed_bytes", F.lit(0)).cast("long"))


def reassemble(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """``(file, data)`` of ``manifest(file, pos, chunk)`` and ``store(chunk, data)``; a file that lacks a chunk has null."""
    met = manifest.join(store, "chunk", "left").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("pos", "data"))).alias("p"), F.count_if(F.col("data").isNull()).alias("lost"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, F.coalesce(x["data"], F.lit(b""))))
    return met.select("file", F.when(F.col("lost") == 0, joined).alias("data"))


def verified(files: DataFrame, contents: DataFrame) -> DataFrame:
    """``files(file, data)`` with ``intact``: whether the data has the id that ``contents(file, content_id)`` says."""
    met = files.join(contents.select("file", "content_id"), "file", "left")
    return met.withColumn("intact", F.coalesce(content_ids(F.col("data")) == F.col("content_id"), F.lit(False))).drop("content_id")


def accepted_chunks(uploads: DataFrame, store: DataFrame) -> DataFrame:
    """``(chunk, data)`` of ``uploads`` that the store takes: the data has the id it came under, one row for each new id."""
    right = uploads.filter(content_ids(F.col("data").cast("binary")) == F.col("chunk")).dropDuplicates(["chunk"])
    return right.join(store.select("chunk"), "chunk", "left_anti").select("chunk", "data")


def complete_manifests(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """``(file, chunks, lacking, complete)``: a manifest may be put once the store has all its chunks."""
    there = store.select("chunk").distinct().withColumn("has", F.lit(1))
    return manifest.join(there, "chunk", "left").groupBy("file").agg(F.count(F.lit(1)).alias("chunks"), (F.count(F.lit(1)) - F.count("has")).alias("lacking")).withColumn("complete", F.col("lacking") == 0)


def snapshot(log: DataFrame) -> DataFrame:
    """The latest state of each path of ``log(path, seq, kind, ...)``."""
    rest = [c for c in log.columns if c not in ("path", "seq")]
    return log.groupBy("path").agg(F.max(F.struct("seq", *rest)).alias("e")).select("path", "e.*")


def live_paths(log: DataFrame) -> DataFrame:
    """``(path)``: the paths whose latest state is not a deletion, in order."""
    return snapshot(log).filter("kind <> 'deleted'").select("path").orderBy("path")


def feed_pages(log: DataFrame, cursor: int, limit: int = 1000) -> DataFrame:
    """``change_feed`` page after page until one is not truncated: each row with its ``page`` and the cursor after it.

    A page's cursor is saved after its rows, so a reader that stops in between reads the page again.
    """
    behind = snapshot(log).filter(F.col("seq") > cursor)
    numbered = offsets(behind.withColumn("one", F.lit(1)), "seq", "one").withColumn("page", F.floor(F.col("offset") / limit).cast("long")).drop("one", "offset")
    pages = numbered.groupBy("page").agg(F.max("seq").alias("cursor"))
    last = pages.agg(F.max("page").alias("last"))
    return numbered.join(pages, "page").join(F.broadcast(last)).withColumn("truncated", F.col("page") < F.col("last")).drop("last")


def next_vectors(known: DataFrame, replica: str) -> DataFrame:
    """``known(base_vv, remote_vv)`` with ``next_vv``, which dominates both and counts one more write of the replica."""
    return known.withColumn("next_vv", VV.bump(VV.merge(VV.of(F.col("base_vv")), VV.of(F.col("remote_vv"))), F.lit(replica)))


def commit_effects(results: DataFrame) -> DataFrame:
    """``results(path, op_id, status)`` with what a client does: which tables take the entry, what the journal notes.

    An accepted write goes to the remote mirror and the base, a rejected one leaves the server's entry in the mirror
    only; both are done. A write that lacks content stays in the journal with one more attempt.
    """
    ok, lost = F.col("status").isin("ok", "replay"), F.col("status") == "missing"
    return results.withColumns({"to_remote": ~lost, "to_base": ok, "journal": F.when(lost, "failed").otherwise("done"), "pass_again": F.col("status") == "conflict"})


def converged(trees: DataFrame) -> DataFrame:
    """``(replicas, paths, same)``: whether all trees ``(replica, path, content_id)`` are alike."""
    n = trees.agg(F.countDistinct("replica").alias("replicas"))
    per = trees.groupBy("path", "content_id").agg(F.countDistinct("replica").alias("r"))
    return per.join(F.broadcast(n)).agg(F.max("replicas").alias("replicas"), F.countDistinct("path").alias("paths"), F.coalesce(F.min(F.col("r") == F.col("replicas")), F.lit(True)).alias("same"))


def move_order(moves: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """An order for renames in which no target is still to be moved away; a cycle goes through one staged name."""
    todo, out, staged = dict(moves), [], 0
    while todo:
        free = sorted(s for s, t in todo.items() if t not in todo or t == s)
        if free:
            for s in free:
                out.append((s, todo.pop(s)))
            continue
        first = min(todo)
        staged += 1
        temp = f".staged-{staged}"
        out.append((first, temp))
        todo[temp] = todo.pop(first)
    return [(s, t) for s, t in out if s != t]


def debounce(events: DataFrame, key: str, ts: str, gap_seconds: float, capacity: int = 1024) -> DataFrame:
    """``(key, start, end, n, rescan)``: bursts with no pause of the gap or more; a burst at capacity asks for a rescan."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    new = F.when(us(ts) - F.lag(us(ts)).over(w) < int(gap_seconds * 1_000_000), 0).otherwise(1)
    burst = events.withColumn("new", new).withColumn("burst", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = burst.groupBy(key, "burst").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))
    return out.select(key, "start", "end", "n", (F.col("n") >= capacity).alias("rescan"))


def link_counters(log: DataFrame) -> DataFrame:
    """``(replica, requests, failures, retries, bytes_up, bytes_down)`` of ``log(replica, kind, outcome, bytes)``.

    Outcomes are ok, lost and offline; a lost request of an upload (kind ``up``) is tried again. Bytes count where they
    have arrived.
    """
    lost, ok = F.col("outcome") == "lost", F.col("outcome") == "ok"
    arrived = lambda kind: F.sum(F.when(ok & (F.col("kind") == kind), F.col("bytes")).otherwise(0))
    return log.groupBy("replica").agg(F.count(F.lit(1)).alias("requests"), F.count_if(lost).alias("failures"), F.count_if(lost & (F.col("kind") == "up")).alias("retries"), arrived("up").alias("bytes_up"), arrived("down").alias("bytes_down"))
