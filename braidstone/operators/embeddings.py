"""Dense vectors: neighbours, analogies, association scores, rank correlation, clusters and their evaluation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidstone.functions.ranks import placed
from braidstone.functions.staging import stage
from braidstone.functions.vectors import add, cosine, doubles, subtract
from braidstone.operators import text

#: Rows and queries of one block of a search.
BLOCK = 4096
#: Blocks a side of a grid of counts that the driver holds.
GRID = 1000


def _block(c: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, vec_id, sim, rank)``: the k rows of largest cosine for each query, itself left out.

    A stated query set against all rows, block by block; each block keeps its k best, a window the k best of those.
    """
    nr, nq = max(1, -(-rows.count() // BLOCK)), max(1, -(-queries.count() // BLOCK))
    r = rows.select("vec_id", doubles(F.col("embedding")).alias("v")).withColumn("rb", _block("vec_id", nr)).withColumn("qb", F.explode(F.array(*(F.lit(i) for i in range(nq)))))
    q = queries.select(F.col("vec_id").alias("query_id"), doubles(F.col("embedding")).alias("qv")).withColumn("q_qb", _block("query_id", nq)).withColumn("q_rb", F.explode(F.array(*(F.lit(i) for i in range(nr)))))

    def best(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "sim": np.zeros(0)})
        x, y = np.stack(b["qv"].to_list()), np.stack(a["v"].to_list())
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.nan_to_num(x @ y.T / (nx[:, None] * ny[None]), posinf=0, neginf=0)
        ids = a["vec_id"].to_numpy()
        sim[b["query_id"].to_numpy()[:, None] == ids[None]] = -np.inf
        order = np.lexsort((np.broadcast_to(ids, sim.shape), -np.round(sim, 6)), axis=1)[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), order.shape[1]), "vec_id": ids[order].ravel(), "sim": np.take_along_axis(sim, order, 1).ravel()})
        return out[np.isfinite(out["sim"])]

    found = r.groupBy("rb", "qb").cogroup(q.groupBy("q_rb", "q_qb")).applyInPandas(best, "query_id long, vec_id long, sim double")
    w = Window.partitionBy("query_id").orderBy(F.round("sim", 6).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def analogies(rows: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """``(analogy, vec_id, sim, rank)`` for ``asked(analogy, a, a_star, b)``: nearest to b - a + a_star, the three left out.

    The asked analogies are a list a person writes; their targets are broadcast. An unknown id gives no rows.
    """
    v = rows.select("vec_id", doubles(F.col("embedding")).alias("v"))
    side = lambda n: v.select(F.col("vec_id").alias(n), F.col("v").alias(f"v_{n}"))
    targets = asked.join(side("a"), "a").join(side("a_star"), "a_star").join(side("b"), "b")
    targets = targets.select("analogy", "a", "a_star", "b", add(subtract(F.col("v_b"), F.col("v_a")), F.col("v_a_star")).alias("t"))
    sims = v.join(F.broadcast(targets), ~F.col("vec_id").isin(F.col("a"), F.col("a_star"), F.col("b"))).select("analogy", "vec_id", cosine(F.col("v"), F.col("t")).alias("sim"))
    w = Window.partitionBy("analogy").orderBy(F.round("sim", 6).desc(), "vec_id")
    return sims.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def centroids(rows: DataFrame, group: str = "label") -> DataFrame:
    """``(group, pos, mean)``."""
    return rows.select(group, F.posexplode(doubles(F.col("embedding"))).alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("mean"))


def centroid_vectors(rows: DataFrame, group: str = "label") -> DataFrame:
    return centroids(rows, group).groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("centroid"))


def bias(rows: DataFrame, female: DataFrame, male: DataFrame) -> DataFrame:
    """``(vec_id, score, direction)``: cosine with the one group's mean less that with the other's."""
    f = centroid_vectors(female.withColumn("g", F.lit(1)), "g").select(F.col("centroid").alias("cf"))
    m = centroid_vectors(male.withColumn("g", F.lit(1)), "g").select(F.col("centroid").alias("cm"))
    v = doubles(F.col("embedding"))
    out = rows.join(F.broadcast(f)).join(F.broadcast(m)).select("vec_id", (cosine(v, F.col("cf")) - cosine(v, F.col("cm"))).alias("score"))
    return out.withColumn("direction", F.when(F.col("score") > 0.05, "FEMALE").when(F.col("score") < -0.05, "MALE").otherwise("neutral"))


def pair_scores(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs(w1, w2, human)`` with the cosine of their vectors; pairs with an unknown side go."""
    a = rows.select(F.col("vec_id").alias("w1"), doubles(F.col("embedding")).alias("x"))
    b = rows.select(F.col("vec_id").alias("w2"), doubles(F.col("embedding")).alias("y"))
    return pairs.join(a, "w1").join(b, "w2").select("w1", "w2", "human", cosine(F.col("x"), F.col("y")).alias("score"))


def similarity_scores(pairs: DataFrame, method: str, rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``pairs`` scored by a method: ``dense`` over ``rows(vec_id, embedding)``, ``ppmi`` over cells ``rows(w, c, ppmi)`` of the words ``names``."""
    if method == "dense":
        return pair_scores(pairs, rows)
    if method == "ppmi":
        return text.sparse_pair_scores(pairs, rows, "ppmi", names)
    raise ValueError(f"unknown method: {method}")


def checked_answers(found: DataFrame, expected: DataFrame) -> DataFrame:
    """``(analogy, answer, expected, correct)`` of ``found(analogy, answer, rank)``: the first answers, whatever the case of letters; ``N/A`` for none."""
    first = found.filter("rank = 1").select("analogy", "answer")
    return expected.join(first, "analogy", "left").select("analogy", F.coalesce("answer", F.lit("N/A")).alias("answer"), "expected").withColumn("correct", F.lower("answer") == F.lower("expected"))


def sparse_vectors(names: DataFrame, cells: DataFrame, size: int) -> DataFrame:
    """``(name, vec)`` of ``cells(name, dim, value)``, zeros in the other of ``size`` places; zeros alone for a name without cells."""
    held = cells.groupBy("name", F.col("dim").cast("int").alias("dim")).agg(F.sum(F.col("value").cast("double")).alias("value")).groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("held"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0.0)))
    return names.join(held, "name", "left").select("name", vec.alias("vec"))


def _inversions(a: np.ndarray) -> int:
    """Pairs of places whose values, all different, stand in falling order: bit by bit, ones before zeros among equal higher bits."""
    ranks, total = np.argsort(np.argsort(a)), 0
    for k in range(max(0, len(ranks) - 1).bit_length()):
        r = ranks[np.argsort(ranks >> (k + 1), kind="stable")]
        high, bit = r >> (k + 1), r >> k & 1
        ones = np.cumsum(bit)
        first = np.flatnonzero(np.append(True, high[1:] != high[:-1]))
        base = np.repeat((ones - bit)[first], np.diff(np.append(first, len(r))))
        total += int((ones - base)[bit == 0].sum())
    return total


def _discordant(rows: DataFrame, n: int) -> int:
    """Pairs of ``rows(p, q)``, two places of each, that stand in one order by p and in the other by q.

    Blocks of places make a grid of GRID x GRID counts at most. Pairs that differ in both blocks follow from the
    counts; those of one p block, and those of one q block but two p blocks, are counted within the block.
    """
    width = max(BLOCK, -(-n // GRID))
    cells = rows.select("p", "q", F.floor(F.col("p") / width).alias("pb"), F.floor(F.col("q") / width).alias("qb"))
    grid = np.zeros((-(-n // width),) * 2, np.int64)
    for pb, qb, c in cells.groupBy("pb", "qb").count().collect():
        grid[pb, qb] = c
    before = np.cumsum(grid, 0) - grid
    total = int((grid * (np.cumsum(before[:, ::-1], 1)[:, ::-1] - before)).sum())

    def within_p(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [_inversions(f.sort_values("p")["q"].to_numpy())]})

    def within_q(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("p")
        same = sum(_inversions(g["q"].to_numpy()) for _, g in f.groupby("pb"))
        return pd.DataFrame({"d": [_inversions(f["q"].to_numpy()) - same]})

    found = cells.groupBy("pb").applyInPandas(within_p, "d long").unionByName(cells.groupBy("qb").applyInPandas(within_q, "d long"))
    return total + (found.agg(F.sum("d")).first()[0] or 0)


def kendall_tau_b(scores: DataFrame, x: str, y: str, order: str, max_pairs: int | None = None) -> DataFrame:
    """``(tau)`` over all rows of ``scores``, or the first ``max_pairs`` by ``order`` (a parameter of the loader too).

    Values are taken as doubles. Rows without an x or a y are left out; a NaN makes the result NaN; no two different
    values of x or of y make it null.
    """
    spark = scores.sparkSession
    listed = scores.orderBy(order).limit(max_pairs) if max_pairs else scores
    value = lambda c: (F.col(c).cast("double") + 0.0)  # noqa: E731  one zero
    rows = stage(listed.select(F.col(order).alias("o"), value(x).alias("x"), value(y).alias("y")).dropna(subset=["x", "y"]), "scores")
    n, odd = rows.agg(F.count(F.lit(1)), F.max(F.isnan("x") | F.isnan("y"))).first()
    ties = lambda *k: int(rows.groupBy(*k).count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0] or 0)
    tau = float("nan") if odd else None
    if n and not odd:
        both, one, two = n * (n - 1) // 2, ties("x"), ties("y")
        if both > one and both > two:
            parts = max(1, -(-n // BLOCK))
            # equal values of y take the order of p, so that neither ties of x nor ties of y count as discordant
            p = placed(rows, ["x", "y", "o"], "p", parts)
            d = _discordant(placed(p.select("y", "p"), ["y", "p"], "q", parts), n)
            tau = (both - one - two + ties("x", "y") - 2 * d) / math.sqrt(float(both - one) * float(both - two))
    return spark.createDataFrame([(tau,)], "tau double")


def paired_fscore(items: DataFrame, target: str, predicted: str, gold: str) -> DataFrame:
    """``(target, precision, recall, fscore)`` over pairs of items, from contingency counts."""
    two = lambda n: F.col(n) * (F.col(n) - 1) / 2
    count = lambda *k: items.groupBy(target, *k).agg(F.count(F.lit(1)).alias("n"))
    tp = count(predicted, gold).groupBy(target).agg(F.sum(two("n")).alias("tp"))
    pp = count(predicted).groupBy(target).agg(F.sum(two("n")).alias("pp"))
    gp = count(gold).groupBy(target).agg(F.sum(two("n")).alias("gp"))
    p = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0)
    r = F.when(F.col("gp") > 0, F.col("tp") / F.col("gp")).otherwise(0.0)
    f = F.when(F.col("tp") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return tp.join(pp, target).join(gp, target).withColumn("precision", p).withColumn("recall", r).select(target, "precision", "recall", f.alias("fscore"))


def compare_scores(one: DataFrame, two: DataFrame, target: str, names: tuple[str, str] = ("sparse", "dense")) -> DataFrame:
    """``(target, <one>, <two>, winner)`` of two results ``(target, fscore)``; equal scores are a tie."""
    a, b = names
    met = one.select(target, F.col("fscore").alias(a)).join(two.select(target, F.col("fscore").alias(b)), target)
    return met.withColumn("winner", F.when(F.col(a) > F.col(b), a).when(F.col(b) > F.col(a), b).otherwise("tie"))


def score_summary(compared: DataFrame, names: tuple[str, str] = ("sparse", "dense")) -> DataFrame:
    """``(targets, mean_<one>, mean_<two>, wins_<one>, wins_<two>, ties)`` of ``compare_scores``."""
    count = lambda w: F.count_if(F.col("winner") == w)
    return compared.agg(F.count(F.lit(1)).alias("targets"), *(F.avg(n).alias(f"mean_{n}") for n in names), *(count(n).alias(f"wins_{n}") for n in names), count("tie").alias("ties"))


def silhouette(items: DataFrame, target: str, label: str) -> DataFrame:
    """``(target, silhouette)``: the mean over a target's items by Euclidean distance; a single item of a cluster counts 0."""
    one = items.select(target, F.col("vec_id").alias("i"), F.col(label).alias("li"), doubles(F.col("embedding")).alias("x"))
    two = items.select(target, F.col("vec_id").alias("j"), F.col(label).alias("lj"), doubles(F.col("embedding")).alias("y"))
    d = one.join(two, target).filter("i <> j").select(target, "i", "li", "lj", F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, z: acc + z)).alias("d"))
    mean = d.groupBy(target, "i", "li", "lj").agg(F.avg("d").alias("m"))
    each = mean.groupBy(target, "i").agg(F.max(F.when(F.col("li") == F.col("lj"), F.col("m"))).alias("a"), F.min(F.when(F.col("li") != F.col("lj"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.groupBy(target).agg(F.avg(s).alias("silhouette"))


def lloyd(x: np.ndarray, k: int, seed: int = 42, tries: int = 10, rounds: int = 100) -> np.ndarray:
    """Labels of the best of several k-means++ starts."""
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(x), np.int64))
    for _ in range(tries):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        label = None
        for _ in range(rounds):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            new = d.argmin(1)
            if label is not None and (new == label).all():
                break
            label = new
            c = np.array([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(k)])
        inertia = d[np.arange(len(x)), label].sum()
        if inertia < best[0]:
            best = (inertia, label)
    return best[1]


def _silhouette(x: np.ndarray, label: np.ndarray) -> float:
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, label == m].mean() for m in set(label) - {label[i]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def kmeans(items: DataFrame, target: str, auto: bool = False) -> DataFrame:
    """``(target, vec_id, k, predicted)``: each target's items clustered by themselves, k the number of gold labels.

    ``auto``: k from 2 to 10 by the best silhouette, the smallest on ties; below three items k and labels are null.
    """

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("vec_id")
        x = np.stack(f["v"].to_list())
        if not auto:
            k = int(f["label"].nunique())
            label = lloyd(x, k)
        else:
            found = [(-_silhouette(x, y), k, y) for k in range(2, min(len(x) - 1, 10) + 1) for y in [lloyd(x, k)] if len(set(y)) > 1]
            _, k, label = min(found, key=lambda t: t[:2]) if found else (0, None, np.full(len(x), None))
        return pd.DataFrame({target: f[target], "vec_id": f["vec_id"], "k": pd.array([k] * len(f), "Int64"), "predicted": pd.array(list(label), "Int64")})

    return items.select(target, "vec_id", "label", doubles(F.col("embedding")).alias("v")).groupBy(target).applyInPandas(run, f"{target} long, vec_id long, k long, predicted long")


def phrase_vectors(phrases: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """``(phrase, vec)`` of ``phrases(phrase, word)``: the mean of the known words' vectors, zeros if none is known."""
    known = phrases.join(rows.select("word", doubles(F.col("vec")).alias("v")), "word").select("phrase", F.posexplode("v").alias("pos", "x")).groupBy("phrase", "pos").agg(F.avg("x").alias("m"))
    vec = known.groupBy("phrase").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vec"))
    return phrases.select("phrase").distinct().join(vec, "phrase", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), size)))


