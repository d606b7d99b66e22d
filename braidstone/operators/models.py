"""Character models at work: forward passes, loss and sampling over rows of ids. Weights are given, not trained here.

A row is one sequence, so a task needs its own rows and the weights only: no shuffle, and a lost task is run again with
the same draws, since each row's random numbers come from the seed and its key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _draw(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return rng.normal(0.0, 0.02, shape)


@dataclass
class Recurrent:
    """Embedding lookup, one tanh layer, a linear map to logits. Blocks of ``block`` ids begin with an empty state."""

    embed: np.ndarray
    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    block: int = 64

    @classmethod
    def random(cls, vocab: int, size: int = 32, block: int = 64, seed: int = 0) -> Recurrent:
        r = np.random.default_rng(seed)
        return cls(_draw(r, vocab, size), _draw(r, size, size), _draw(r, size, size), np.zeros(size), _draw(r, size, vocab), np.zeros(vocab), block)

    def states(self, ids: np.ndarray) -> np.ndarray:
        """Of ids ``(n, t)`` the states ``(n, t, size)``."""
        x = self.embed[ids] @ self.wx + self.b
        size = len(self.wh)
        h, out = np.zeros((len(ids), size)), np.empty((*ids.shape, size))
        for i in range(ids.shape[1]):
            h = np.tanh(x[:, i] + h @ self.wh)
            out[:, i] = h
        return out

    def logits(self, ids: np.ndarray) -> np.ndarray:
        return self.states(ids) @ self.out + self.bias


def _norm(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps)


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Layer:
    """A pre-norm block: causal attention of several heads, then a four times wider ReLU map, each added to its input."""

    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    proj: np.ndarray
    up: np.ndarray
    down: np.ndarray
    heads: int

    def attend(self, x: np.ndarray) -> np.ndarray:
        n, t, d = x.shape
        split = lambda w: (x @ w).reshape(n, t, self.heads, d // self.heads).transpose(0, 2, 1, 3)
        q, k, v = split(self.q), split(self.k), split(self.v)
        score = q @ k.transpose(0, 1, 3, 2) / np.sqrt(d // self.heads)
        score = np.where(np.tri(t, dtype=bool), score, -np.inf)
        return (_soft(score) @ v).transpose(0, 2, 1, 3).reshape(n, t, d) @ self.proj

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = x + self.attend(_norm(x))
        return x + np.maximum(_norm(x) @ self.up, 0.0) @ self.down


@dataclass
class Transformer:
    """Token and place embeddings, layers, a last norm and a linear map to logits."""

    embed: np.ndarray
    place: np.ndarray
    layers: list[Layer] = field(default_factory=list)
    out: np.ndarray | None = None
    bias: np.ndarray | None = None

    @property
    def block(self) -> int:
        return len(self.place)

    @classmethod
    def random(cls, vocab: int, size: int = 32, heads: int = 4, layers: int = 2, block: int = 64, seed: int = 0) -> Transformer:
        r = np.random.default_rng(seed)
        one = lambda: Layer(*(_draw(r, size, size) for _ in range(4)), _draw(r, size, 4 * size), _draw(r, 4 * size, size), heads)
        return cls(_draw(r, vocab, size), _draw(r, block, size), [one() for _ in range(layers)], _draw(r, size, vocab), np.zeros(vocab))

    def logits(self, ids: np.ndarray) -> np.ndarray:
        x = self.embed[ids] + self.place[: ids.shape[1]]
        for layer in self.layers:
            x = layer(x)
        return _norm(x) @ self.out + self.bias


#: Windows of a sequence that go through a model at once.
WINDOWS = 64


def sequence_loss(model: Recurrent | Transformer, ids: np.ndarray) -> tuple[int, float]:
    """How many ids follow another one, and the sum of their losses; the sequence goes through in whole blocks, then the rest."""
    n, total, b = max(0, len(ids) - 1), 0.0, model.block
    full = n // b

    def add(x: np.ndarray, y: np.ndarray) -> float:
        z = model.logits(x)
        top = z.max(-1)
        return float((np.log(np.exp(z - top[..., None]).sum(-1)) + top - np.take_along_axis(z, y[..., None], -1)[..., 0]).sum())

    for at in range(0, full, WINDOWS):
        lo, hi = at * b, min(full, at + WINDOWS) * b
        total += add(ids[lo:hi].reshape(-1, b), ids[lo + 1 : hi + 1].reshape(-1, b))
    if n > full * b:
        total += add(ids[None, full * b : n], ids[None, full * b + 1 :])
    return n, total


def losses(rows: DataFrame, key: str, ids: str, model: Recurrent | Transformer) -> DataFrame:
    """``(key, targets, loss)``: the mean loss of each sequence's ids but its first; null where it has no other. Null ids count as none."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [sequence_loss(shared.value, np.asarray(x if x is not None else [], np.int64)) for x in f["ids"]]
            yield pd.DataFrame({"key": f["key"], "targets": [n for n, _ in got], "loss": pd.array([s / n if n else None for n, s in got], "Float64")})

    out = rows.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids")).mapInPandas(run, "key long, targets long, loss double")
    return out.withColumnRenamed("key", key)


def continued(rows: DataFrame, key: str, ids: str, model: Recurrent | Transformer, steps: int, temperature: float = 1.0, seed: int = 0) -> DataFrame:
    """``(key, drawn)``: ``steps`` ids drawn one after another behind each sequence, from its last block of ids at a time.

    At temperature 0 the likeliest id, the smallest of equals. An empty or null sequence begins with id 0.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def one(k: int | None, x: np.ndarray) -> list[int]:
        m, rng = shared.value, np.random.default_rng([seed, 0 if pd.isna(k) else int(k) % (1 << 63)])
        now, out = [*x] or [0], []
        for _ in range(steps):
            z = m.logits(np.array([now[-m.block :]], np.int64))[0, -1]
            if temperature == 0:
                new = int(z.argmax())
            else:
                new = min(int(np.searchsorted(_soft(z / temperature).cumsum(), rng.random(), "right")), len(z) - 1)
            now.append(new)
            out.append(new)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "drawn": [one(k, x if x is not None else []) for k, x in zip(f["key"], f["ids"], strict=True)]})

    out = rows.select(F.col(key).cast("long").alias("key"), F.slice(F.col(ids), F.greatest(F.lit(1), F.size(ids) - model.block + 1), model.block).alias("ids")).mapInPandas(run, "key long, drawn array<long>")
    return out.withColumnRenamed("key", key)


def last_states(rows: DataFrame, key: str, ids: str, model: Recurrent) -> DataFrame:
    """``(key, state)``: the recurrent state behind the last id of each sequence, carried through all of it; zeros for none."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for f in frames:
            got = []
            for x in f["ids"]:
                h = np.zeros(m.wh.shape[0])
                for i in x if x is not None else ():
                    h = np.tanh(m.embed[i] @ m.wx + m.b + h @ m.wh)
                got.append(h.tolist())
            yield pd.DataFrame({"key": f["key"], "state": got})

    out = rows.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids")).mapInPandas(run, "key long, state array<double>")
    return out.withColumnRenamed("key", key)
