"""Embedding near-dedup over an inverted multi-index.

Unit vectors are split into halves, each with a codebook of its own; the product of the codebooks is a grid of cells.
The codebooks grow with the table, so that a cell holds about CELL vectors of a label. A multi-sequence traversal
visits, for each vector, cells in rising order of a distance (how far its halves must move to cross into the cell),
until the radius that the target recall asks. Vectors of the cells visited are verified by cosine in double precision.

The radius is calibrated: partners at exactly the threshold's cosine are drawn for vectors of the sample, in random
directions, in one half only, and along one axis; of each kind RECALL must be found, by the one side or the other. A
pair is linked when either vector visits the other's cell, and nearer pairs are found more surely. Beyond the radius
at which no pair can be lost the traversal never goes. README gives recall as measured against brute force.

Equal vectors of a label collapse first and count as many. Cells, their members and their visitors are split into
blocks of bounded size. A block returns counts and a spanning forest of its links, never all pairs.

Defined cases: a null label, id or vector, a vector with null or non-finite components or of length zero links with
nothing; an empty one too. Vectors of different sizes never link; those whose size is not the most common one of the
sample have one cell for their size. Rows that repeat an id are vectors of their own, with links of their own. An
empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidstone.functions.staging import stage
from braidstone.llm.common import attach, components, frugal

COSINE = 0.98
#: The share of pairs at the threshold that must be found, for each kind of partner drawn.
RECALL = 0.995
#: Vectors of the largest label in a cell on average; most centres a half; the bounded sample they are fitted on, and
#: that partners are drawn for. Every vector is indexed.
CELL, CENTRES_MOST, SAMPLE, DRAWN = 32, 1024, 20_000, 4_000
BLOCK = 1024
#: Numbers of a difference array held at once.
AT_ONCE = 4_000_000


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, row by row the same whatever rows are beside it."""
    step = max(1, AT_ONCE // max(1, c.size))
    return np.concatenate([((x[i : i + step, None, :] - c[None]) ** 2).sum(2) for i in range(0, len(x), step)]) if len(x) else np.zeros((0, len(c)))


def fit_codebook(half: np.ndarray, centres: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from a fixed seed."""
    rng = np.random.default_rng(11)
    c = half[rng.choice(len(half), min(centres, len(half)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin(((half**2).sum(1)[:, None] - 2 * half @ c.T) + (c**2).sum(1), axis=1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, half)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


class Grid:
    """Two codebooks, their product's cells, and the radius of the traversal (squared)."""

    def __init__(self, sample: np.ndarray, centres: int, cosine: float = COSINE, recall: float = RECALL):
        self.cut = sample.shape[1] // 2 or 1
        self.size = sample.shape[1]
        self.books = [fit_codebook(h, centres) for h in (sample[:, : self.cut], sample[:, self.cut :])]
        self.gaps = [np.sqrt(_squares(c, c)) for c in self.books]
        safe = 2 - 2 * cosine + 1e-9  # squared distance of unit vectors at the threshold: no pair is lost within it
        self.most = min(safe, self._radius(sample[:DRAWN], cosine, recall))

    def moves(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each half the squared move a row needs at least to be nearest to each centre; each row's own cell."""
        near, low = [], []
        for h, c, gap in zip((x[:, : self.cut], x[:, self.cut :]), self.books, self.gaps, strict=True):
            d = _squares(h, c)
            own = d.argmin(1)
            g = gap[own]
            move = np.maximum(0, (d - d[np.arange(len(d)), own][:, None]) / np.where(g > 0, 2 * g, 1))
            near.append(own)
            low.append(move * move)
        return low, self.cell(*near)

    def cell(self, a, b):
        return a * len(self.books[1]) + b

    def reach(self, low: list[np.ndarray], rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The traversal's distance from each of ``rows`` to each of ``cells``, one by one."""
        n = len(self.books[1])
        return low[0][rows, cells // n] + low[1][rows, cells % n]

    def _radius(self, x: np.ndarray, cosine: float, recall: float) -> float:
        rng, sine = np.random.default_rng(5), np.sqrt(1 - cosine**2)
        low, own = self.moves(x)
        noise = rng.normal(size=x.shape)
        one = noise.copy()
        one[:, self.cut :] = 0
        other = noise.copy()
        other[:, : self.cut] = 0
        axis = np.eye(x.shape[1])[rng.integers(x.shape[1], size=len(x))]
        worst, rows = 0.0, np.arange(len(x))
        for u in (noise, one, other, axis):
            u = u - (u * x).sum(1)[:, None] * x
            length = np.sqrt((u * u).sum(1))[:, None]
            y = cosine * x + sine * u / np.where(length > 0, length, 1)
            there, cell = self.moves(y)
            need = np.minimum(self.reach(low, rows, cell), self.reach(there, rows, own))
            worst = max(worst, float(np.quantile(need, recall, method="higher")))
        return worst + 1e-12


def multi_sequence(p: np.ndarray, q: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Index pairs of two rising sequences by rising sum, while it is ``most`` at the most."""
    heap, seen = [(p[0] + q[0], 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= most:
        _, i, j = heapq.heappop(heap)
        yield i, j
        for k, m in ((i + 1, j), (i, j + 1)):
            if k < len(p) and m < len(q) and (k, m) not in seen:
                seen.add((k, m))
                heapq.heappush(heap, (p[k] + q[m], k, m))


def visits(x: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's own cell, and (row, cell) of all cells the traversal visits, nearest first."""
    (p, q), own = grid.moves(x)
    op, oq = np.argsort(p, axis=1, kind="stable"), np.argsort(q, axis=1, kind="stable")
    p, q = np.take_along_axis(p, op, 1), np.take_along_axis(q, oq, 1)
    row, cell = [], []
    for r in range(len(x)):
        np_, nq = np.searchsorted(p[r], grid.most, "right"), np.searchsorted(q[r], grid.most, "right")
        for i, j in multi_sequence(p[r, :np_].tolist(), q[r, :nq].tolist(), grid.most):
            row.append(r)
            cell.append(grid.cell(op[r, i], oq[r, j]))
    return own, np.array(row, np.int64), np.array(cell, np.int64)


def _unit(blob: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blob), np.float64).reshape(len(blob), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(vec_id, label, vec)``; vec is null where the row links with nothing."""
    for b in batches:
        blobs = []
        for vec_id, label, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            good = vec_id is not None and label is not None and v and all(y is not None for y in v)
            x = np.array(v, np.float64) if good else np.zeros(0)
            with np.errstate(over="ignore", invalid="ignore"):
                good = good and bool(np.isfinite(x).all()) and bool(np.isfinite(x @ x)) and x @ x > 0
            blobs.append((x + 0.0).tobytes() if good else None)
        yield pa.record_batch([b.column(0), b.column(1), pa.array(blobs, pa.binary())], ["vec_id", "label", "vec"])


_VISITS = "node long, label string, m long, vec binary, home long, cell long"


def _visit_rows(grid):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(v) for v in b.column(3).to_pylist()])
            for width in np.unique(size):
                at = np.flatnonzero(size == width)
                for i in range(0, len(at), 2048):
                    part = b.take(pa.array(at[i : i + 2048]))
                    x = _unit(part.column(3).to_pylist())
                    if x.shape[1] == grid.value.size:
                        own, row, cell = visits(x, grid.value)
                    else:  # one cell for each odd size
                        row = np.arange(len(x))
                        own = cell = np.full(len(x), -x.shape[1])
                    yield pa.record_batch([*part.take(pa.array(row)).columns, pa.array(own[row].astype(np.int64)), pa.array(cell.astype(np.int64))], ["node", "label", "m", "vec", "home", "cell"])

    return run


def _match(grid, cosine: float):
    """Links between a cell's members and its visitors: counts for the visitors, and for members whose own visit misses the visitor."""

    def run(key, members: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        if members.empty or visitors.empty:
            return empty
        out, cell = [], key[1]
        y, ynode, ym = _unit(list(members["vec"])), members["node"].to_numpy(), members["m"].to_numpy()
        low = None
        for at in range(0, len(visitors), 2 * BLOCK):
            v = visitors.iloc[at : at + 2 * BLOCK]
            x, xnode, xm, home = _unit(list(v["v_vec"])), v["v_node"].to_numpy(), v["v_m"].to_numpy(), v["v_home"].to_numpy()
            linked = (x @ y.T >= cosine) & (xnode[:, None] != ynode[None])
            some = linked.any(1)
            if not some.any():
                continue
            linked, xnode, xm, home = linked[some], xnode[some], xm[some], home[some]
            lab = np.arange(len(ynode))
            while True:  # the smallest member label that each connected part of the block reaches
                lv = np.where(linked, lab[None], len(ynode)).min(1)
                new = np.minimum(lab, np.where(linked, lv[:, None], len(ynode)).min(0))
                if (new == lab).all():
                    break
                lab = new
            out.append(pd.DataFrame({"a": xnode, "b": ynode[lv], "links": (linked * ym[None]).sum(1)}))
            moved = np.flatnonzero((lab != np.arange(len(ynode))) & linked.any(0))
            out.append(pd.DataFrame({"a": ynode[moved], "b": ynode[lab[moved]], "links": np.zeros(len(moved), np.int64)}))
            away = np.flatnonzero(home != cell)
            i, j = np.nonzero(linked[away])
            if len(i):  # does the member visit the visitor's cell, and so count the link itself?
                low = grid.value.moves(y)[0] if low is None else low
                missed = grid.value.reach(low, j, home[away][i]) > grid.value.most
                n = np.bincount(j[missed], xm[away][i[missed]], len(ynode)).astype(np.int64)
                at_y = np.flatnonzero(n)
                out.append(pd.DataFrame({"a": ynode[at_y], "b": ynode[at_y], "links": n[at_y]}))
        return pd.concat(out) if out else empty

    return run


def build_grid(reps: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> Grid:
    """The grid for ``reps(label, vec)``, fitted on SAMPLE vectors at most, those of smallest hash."""
    total, largest = reps.count(), reps.groupBy("label").count().agg(F.max("count")).first()[0]
    low = reps.select("vec", F.pmod(F.xxhash64("vec"), F.lit(1 << 40)).alias("h"))
    sample = low.filter(F.col("h") * total <= F.lit(2.0 * SAMPLE) * (1 << 40)).orderBy("h", "vec").limit(SAMPLE).collect()
    blobs = [bytes(r[0]) for r in sample]
    width = max(sorted({len(b) for b in blobs}), key=[len(b) for b in blobs].count)
    return Grid(_unit([b for b in blobs if len(b) == width]), min(CENTRES_MOST, max(4, int(np.ceil(np.sqrt(largest / CELL))))), cosine, recall)


def near_classes(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors(vec_id, embedding, label)``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stage(rows.mapInArrow(_usable, "vec_id long, label string, vec binary"), "vectors")
    good = rows.filter(F.col("vec").isNotNull())
    reps = stage(good.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")).withColumn("node", F.monotonically_increasing_id()), "reps")
    alone = rows.filter(F.col("vec").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if reps.isEmpty():
        return alone
    grid = spark.sparkContext.broadcast(build_grid(reps, cosine, recall))
    seen = stage(reps.select("node", "label", "m", "vec").mapInArrow(_visit_rows(grid), _VISITS), "visits")
    home = F.col("cell") == F.col("home")
    cells = seen.groupBy("label", "cell").agg(F.sum(home.cast("long")).alias("nm"), F.count(F.lit(1)).alias("nv")).filter("nm > 0 and nv > 1")
    blocks = cells.select("label", "cell", F.ceil(F.col("nm") / BLOCK).cast("int").alias("bm"), F.ceil(F.col("nv") / (4 * BLOCK)).cast("int").alias("bv"))
    there = seen.join(blocks, ["label", "cell"])
    salt = lambda n: F.pmod(F.xxhash64("vec"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["label", "cell", "pm", "pv"]
    members = there.filter(home).withColumn("pm", salt("bm")).withColumn("pv", each("bv")).select(*keys, "node", "m", "vec")
    visitors = there.withColumn("pv", salt("bv")).withColumn("pm", each("bm")).select(*(F.col(c).alias(f"v_{c}") for c in (*keys, "node", "m", "vec", "home")))
    found = stage(members.groupBy(*keys).cogroup(visitors.groupBy(*(f"v_{k}" for k in keys))).applyInPandas(_match(grid, cosine), "a long, b long, links long"), "found")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(found.select("a", "b").filter("a <> b").distinct())
    of = stage(reps.select("node", "label", "vec", "rep", "m").join(counts, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "of")
    lowest = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    verdict = stage(of.join(lowest, "component").select("label", "vec", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"), "verdict")
    linked = attach(good, verdict, ["label", "vec"], "m", rows.count())
    return linked.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)
