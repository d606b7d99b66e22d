"""A client's cycle over trees: the effects of a plan, passes until nothing is left, orders of moves, trash, uploads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidstone.functions import version_vectors as VV
from braidstone.functions.paths import ancestors, conflict_name
from braidstone.functions.staging import stage
from braidstone.operators import sync

NODE = ("kind", "content_id", "executable")


def _aside(split: DataFrame, local: DataFrame, replica: str, stamp: str) -> DataFrame:
    """``split(path, ...)`` with ``aside``: the first conflict name of each path that no local file has."""
    made = rf"^(.*) \(conflicted copy from {re.escape(replica)} {re.escape(stamp)}(?: #([0-9]+))?\)(\.[^./]*)?$"
    part = lambda i: F.regexp_extract("path", made, i)
    taken = local.filter(F.col("path").rlike(made)).select(F.concat(part(1), part(3)).alias("path"), F.coalesce(part(2).try_cast("int"), F.lit(1)).alias("n"))
    taken = taken.groupBy("path").agg(F.collect_set("n").alias("taken"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.coalesce(F.size("taken"), F.lit(0)) + 1), F.coalesce("taken", F.array().cast("array<int>"))))
    named = split.join(taken, "path", "left").withColumn("n", F.when(F.col("taken").isNull(), 1).otherwise(free))
    return named.withColumn("aside", conflict_name(F.col("path"), F.lit(replica), F.lit(stamp), F.col("n"))).drop("taken", "n")


def apply_plan(local: DataFrame, base: DataFrame, remote: DataFrame, plan: DataFrame, replica: str, stamp: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three trees after the operations of ``plan(path, op)``, as ``sync.reconcile`` gives them.

    What is written remotely gets the next vector of the replica; the base takes what both sides then agree on. In a
    conflict the remote version keeps the path and the local one goes aside under a name of its own, as a new file. A
    move leaves the trees as its deletion and creation do, so plans are applied without moves.
    """
    node = lambda df, n, *more: df.select("path", F.struct(*NODE, *more).alias(n))
    j = node(local, "l").join(node(base, "b", "vv"), "path", "full_outer").join(node(remote, "r", "vv"), "path", "full_outer").join(plan.select("path", "op"), "path", "left")
    known = VV.merge(VV.of(F.col("b.vv")), VV.of(F.col("r.vv")))
    op = lambda *names: F.coalesce(F.col("op").isin(*names), F.lit(False))
    entry = lambda kind, cid, flag: F.struct(kind.alias("kind"), cid.alias("content_id"), flag.alias("executable"), VV.bump(known, F.lit(replica)).alias("vv"))
    none, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    write = F.when(op("PUSH"), entry(F.col("l.kind"), F.col("l.content_id"), F.col("l.executable"))).when(op("MKDIR_REMOTE"), entry(F.lit("dir"), none, no)).when(op("DELETE_REMOTE"), entry(F.lit("deleted"), none, no))
    there = F.when(F.col("r").isNotNull() & (F.col("r.kind") != "deleted"), F.struct(*(F.col(f"r.{c}").alias(c) for c in NODE)))
    after = j.withColumns({"w": write, "there": there})
    new_local = F.when(op("PULL", "MKDIR_LOCAL", "CONFLICT_SPLIT"), F.col("there")).when(~op("DELETE_LOCAL"), F.col("l"))
    new_remote = F.coalesce("w", "r")
    new_base = F.when(op("PULL", "MKDIR_LOCAL", "DELETE_LOCAL", "CONVERGE", "CONFLICT_SPLIT"), F.coalesce("r", "b")).otherwise(F.coalesce("w", "b"))

    def tree(value: Column, *more: str) -> DataFrame:
        return after.select("path", value.alias("x")).filter("x is not null").select("path", *(F.col(f"x.{c}").alias(c) for c in (*NODE, *more)))

    split = after.filter(op("CONFLICT_SPLIT") & F.col("l").isNotNull() & (F.col("l.kind") != "deleted")).select("path", "l")
    first = F.create_map(F.lit(replica), F.lit(1).cast("bigint")).alias("vv")
    copies = _aside(split, local, replica, stamp).select(F.col("aside").alias("path"), *(F.col(f"l.{c}").alias(c) for c in NODE), first)
    return tree(new_local).unionByName(copies.drop("vv")), tree(new_base, "vv").unionByName(copies), tree(new_remote, "vv").unionByName(copies)


def run_to_quiescence(local: DataFrame, base: DataFrame, remote: DataFrame, replica: str, stamp: str, passes: int = 6) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The trees after passes of reconciling and applying until a plan is empty, ``passes`` at most, and how many were made."""
    for done in range(passes):
        plan = stage(sync.reconcile(local, base, remote).filter("op <> 'NOOP'").select("path", "op"), "plan")
        if plan.isEmpty():
            return local, base, remote, done
        after = apply_plan(local, base, remote, plan, replica, stamp)
        local, base, remote = (stage(t, n) for t, n in zip(after, ("local", "base", "remote"), strict=True))
    return local, base, remote, passes


def move_steps(moves: DataFrame) -> DataFrame:
    """``(source, target, step)``: an order of ``moves(source, target)`` in which no target is still to be moved away.

    Moves of one step are independent; of a chain its free end goes first. A cycle's smallest source goes to a staged
    name in step 0 and from there to its target in the cycle's last. Sources and targets are distinct, as paths are;
    moves onto themselves are left out. Pointers are doubled, so the rounds grow with the log of the longest chain.
    """
    edges = stage(moves.filter("source <> target").select("source", "target"), "moves")

    def followed(e: DataFrame, rounds: int) -> DataFrame:
        """``(source, at, steps, least)``: where following moves ends, after how many, and the smallest source on the way."""
        known = e.select(F.col("source").alias("k"))
        now = e.join(known, e["target"] == F.col("k"), "left").select("source", F.when(F.col("k").isNotNull(), F.col("target")).alias("at"), F.lit(0).cast("long").alias("steps"), F.col("source").alias("least"))
        for i in range(rounds):
            now = stage(now, f"followed-{i}")
            if now.filter("at is not null").isEmpty():
                return now
            far = now.select(F.col("source").alias("f"), F.col("at").alias("f_at"), F.col("steps").alias("f_steps"), F.col("least").alias("f_least"))
            open_ = now.filter("at is not null").join(far, F.col("at") == F.col("f"))
            step = open_.select("source", F.col("f_at").alias("at"), (F.col("steps") + F.col("f_steps") + 1).alias("steps"), F.least("least", "f_least").alias("least"))
            now = now.filter("at is null").unionByName(step)
        return stage(now, "followed")

    rounds = max(1, edges.count()).bit_length() + 1
    ways = followed(edges, rounds)
    rings = stage(ways.filter("at is not null").select("source", F.col("least").alias("ring")), "rings")
    staged = F.concat(F.lit(".staged-"), F.col("source"))
    cut = edges.join(rings, "source", "left").withColumn("head", F.coalesce(F.col("ring") == F.col("source"), F.lit(False)))
    opened = cut.select("source", F.when(F.col("head"), staged).otherwise(F.col("target")).alias("target"), "ring")
    order = followed(opened.select("source", "target"), rounds)
    first = opened.join(order.select("source", "steps"), "source").select("source", "target", F.col("steps").alias("step"), "ring")
    last = first.filter("ring is not null").groupBy("ring").agg((F.max("step") + 1).alias("step"))
    back = cut.filter("head").select("ring", staged.alias("source"), "target").join(last, "ring").select("source", "target", "step")
    return first.select("source", "target", "step").unionByName(back)


def purge_trash(trash: DataFrame, now: Column, keep_days: int = 30) -> DataFrame:
    """``trash(path, deleted_at)`` with ``purge``: whether it was put there more than ``keep_days`` before ``now``; never without a time."""
    return trash.withColumn("purge", F.coalesce(F.col("deleted_at") < now - F.make_interval(days=F.lit(keep_days)), F.lit(False)))


def empty_folders(tree: DataFrame) -> DataFrame:
    """``(path)`` of the folders of ``tree(path, kind)`` with no live file at any depth below."""
    live = tree.filter("kind not in ('dir', 'deleted')").select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return tree.filter("kind = 'dir'").select("path").distinct().join(live, "path", "left_anti")


def upload_attempts(manifest: DataFrame, store: DataFrame, sent: DataFrame) -> DataFrame:
    """``(attempt, arrived, wasted, left)`` of ``sent(attempt, chunk)``: chunks new to the store, sent again for nothing, and lacking after it.

    Each attempt asks anew which chunks lack, so a chunk that arrived is never needed again.
    """
    need = sync.missing_chunks(manifest, store)
    came = sent.join(need, "chunk", "left_semi").groupBy("chunk").agg(F.min("attempt").alias("attempt")).groupBy("attempt").agg(F.count(F.lit(1)).alias("arrived"))
    each = sent.groupBy("attempt").agg(F.count(F.lit(1)).alias("n")).join(came, "attempt", "left").withColumn("arrived", F.coalesce("arrived", F.lit(0)))
    total = need.agg(F.count(F.lit(1)).alias("total"))
    so_far = F.sum("arrived").over(Window.orderBy("attempt"))  # one row for each attempt
    return each.join(F.broadcast(total)).select("attempt", "arrived", (F.col("n") - F.col("arrived")).alias("wasted"), (F.col("total") - so_far).alias("left"))
