"""Language-model scoring: marginal likelihood over all segmentations into pieces of an existing vocabulary.

A word, behind the mark of a word's start, is a lattice of the vocabulary's pieces, weighted by the vocabulary's scores;
the forward recursion in log space sums over all its segmentations. The scores of the vocabulary at hand are ranks of
merges, no log probabilities, so Zipf's law turns them into some: a piece of score -r has a weight of 1 / (SHIFT + r).
Characters no piece covers are spelled in the vocabulary's bytes, which have no score of their own and the weight of
the last rank. The end of a text is the vocabulary's end piece.

What the corpus teaches are its words: a word of the training texts is one more edge of its lattice from its start to
its end, with the weight its count has beside an escape to the pieces (Witten and Bell). All this and the end make one
distribution, so a text's probability is the product over its words and the end.

Word counts come from the whole corpus. Words that hold 1 / HOT of the training tokens or more, HOT of them at most,
are looked up in a broadcast table; the others meet their counts in a shuffle, where no key can be hot.

Defined cases: a null or blank text is its end alone. Rows without an id are scored and taken as training rows (their
remainder is not 2). Repeated rows each get a result and each count in training. A long word is walked in windows of
its characters, a long text is one of many words. An empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidstone.functions.staging import stage
from braidstone.llm.common import frugal

HOT = 200_000
#: Distinct words that a task counts before it passes them on.
FLUSH = 300_000
ZIPF_SHIFT = 10
#: Characters of a word whose pieces are looked up at once.
STRETCH = 16_384
MARK = "▁"


def words(text: str | None) -> list[bytes]:
    """A-Z lowered, split at the six ASCII blanks."""
    return text.encode().lower().split() if text else []


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Lattice:
    """Pieces of a vocabulary as 64-bit keys of their characters, with log probabilities from its scores."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        kept = [i for i, p in enumerate(self.pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.byte, self.end = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]), sp.eos_id()
        self.longest = max(len(self.pieces[i]) for i in kept)
        keys = np.array([self.key(np.array([[ord(c) for c in self.pieces[i]]], np.uint64))[0] for i in kept], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(kept)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        score = np.array([sp.get_score(i) for i in range(len(self.pieces))], float)
        weight = np.zeros(len(score))
        weight[[*kept, self.end]] = 1 / (ZIPF_SHIFT - score[[*kept, self.end]])
        weight[self.byte] = weight[kept].min()
        with np.errstate(divide="ignore"):
            self.logp = np.log(weight / weight.sum())
        self.key_logp = self.logp[self.ids]

    @staticmethod
    def key(c: np.ndarray) -> np.ndarray:
        """Of rows of code points; a prefix's key extends to the next character's."""
        h = np.zeros(len(c), np.uint64)
        for j in range(c.shape[1]):
            h = Lattice.extend(h, c[:, j])
        return h

    @staticmethod
    def extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h + c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def edges(self, c: np.ndarray, starts: int) -> list[np.ndarray]:
        """By length less one: log probabilities of the edges from each row's first ``starts`` places; -inf where there is none."""
        out, h = [], np.zeros((len(c), starts), np.uint64)
        for size in range(1, min(self.longest, c.shape[1]) + 1):
            n = min(starts, c.shape[1] - size + 1)
            h = self.extend(h[:, :n], c[:, size - 1 : size - 1 + n])
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            lp = np.where(self.keys[at] == h, self.key_logp[at], -np.inf)
            if size == 1:
                for i, j in np.argwhere(np.isneginf(lp)):  # no piece: spelled in bytes
                    lp[i, j] = self.logp[self.byte[list(chr(int(c[i, j])).encode("utf-8", "surrogatepass"))]].sum()
            out.append(lp)
        return out

    def likelihood(self, c: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations, for rows of code points of one length."""
        n = c.shape[1]
        alpha = np.full((n + 1, len(c)), -np.inf)
        alpha[0] = 0
        for start in range(0, n, STRETCH):
            starts = min(STRETCH, n - start)
            for size, lp in enumerate(edges := self.edges(c[:, start : start + starts + self.longest - 1], starts)):
                edges[size] = lp.T.copy()
            for s in range(starts):
                for size, lp in enumerate(edges, 1):
                    if s < len(lp):
                        to = alpha[start + s + size]
                        np.logaddexp(to, alpha[start + s] + lp[s], out=to)
        return alpha[n]

    def by_length(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, code points) of marked words of one length at a time, in blocks of bounded size."""
        coded = [np.frombuffer((MARK + t).encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        size = np.array([len(x) for x in coded], np.int64)
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            step = max(1, 400_000 // int(n) // 8)
            for i in range(0, len(at), step):
                yield at[i : i + step], np.stack([coded[j] for j in at[i : i + step]]).astype(np.uint64)


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def _text(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


_COUNTS = "word binary, c long"


@frugal
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of training words; held-out words with 0, so that all words are in the table."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
        seen.clear()
        return batch

    for b in batches:
        for text, aside in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if aside:
                for w in words(text):
                    seen[w] += 0
            else:
                seen.update(words(text))
            if len(seen) > FLUSH:
                yield out()
    yield out()


def _likelihood(path: str, total: int, distinct: int):
    room = total + distinct + 1

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(path)
        for b in batches:
            texts, out = [_text(w) for w in b.column(0).to_pylist()], np.zeros(b.num_rows)
            for at, codes in lat.by_length(texts):
                out[at] = lat.likelihood(codes)
            with np.errstate(divide="ignore"):
                out = np.logaddexp(out + math.log((distinct + 1) / room), np.log(b.column(1).to_numpy() / room))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out / math.log(10))], ["word", "c", "lp"])

    return run


_OWN = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("held_out", pa.bool_())])
_TOKENS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("word", pa.binary()), ("tf", pa.int32()), ("own", _OWN)])
_TOKENS_SQL = "doc_id long, h long, word binary, tf int, own struct<n_tokens:long,n_known:long,base:double,score:double,held_out:boolean>"


def _look_up(hot, end: tuple[int, float, float], log_total: float):
    """Per text one row of what its frequent words and its end add up to, and one row for each other word."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names, c, lp = hot.value
        place = dict(zip(names, range(1, len(names) + 1), strict=True))
        known = np.concatenate(([0], c > 0))
        base, lp = np.concatenate(([0.0], np.log10(c + 1.0) - log_total)), np.concatenate(([0.0], lp))
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                ids, hs, row, word, tf, own = part.column(0), [], [], [], [], []
                for i, (text, aside) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    w = words(text)
                    at = np.fromiter(map(place.get, w, [0] * len(w)), np.int64, len(w))
                    hs.append(xxhash.xxh3_64_intdigest(text.encode() if text else b"") - (1 << 63))
                    row.append(i)
                    word.append(b" %x %d" % (hs[-1] & 0xFFFFFFFF, start + i))  # no word, as it has a blank; nearly each its own key
                    tf.append(0)
                    own.append((len(w) + 1, int(known[at].sum()) + (end[0] > 0), float(base[at].sum()) + end[1], float(lp[at].sum()) + end[2], aside))
                    rest = Counter([w[j] for j in np.flatnonzero(at == 0)])
                    row += [i] * len(rest)
                    word += rest
                    tf += rest.values()
                    own += [None] * len(rest)
                at = pa.array(row, pa.int32())
                own = pa.array([None if x is None else dict(zip(("n_tokens", "n_known", "base", "score", "held_out"), x, strict=True)) for x in own], _OWN)
                yield pa.record_batch([ids.take(at), pa.array(hs, pa.int64()).take(at), pa.array(word, pa.binary()), pa.array(tf, pa.int32()), own], schema=_TOKENS)

    return run


def score(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    counts = stage(rows.select("text", "held_out").mapInArrow(_count, _COUNTS).groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    ends = rows.filter(~F.col("held_out")).count()
    seen = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    total, distinct = seen[0] + ends, seen[1] + (ends > 0)
    log_total = math.log10(total + distinct + 1)

    escaped = math.exp(lattice(vocabulary).logp[lattice(vocabulary).end])
    end_lp = math.log10((ends + (distinct + 1) * escaped) / (total + distinct + 1))

    table = stage(counts.mapInArrow(_likelihood(vocabulary, total, distinct), "word binary, c long, lp double"), "word-likelihoods")
    hot = F.col("c") * HOT >= F.lit(max(total, HOT))
    top = table.filter(hot).toArrow()  # HOT words at most
    sent = spark.sparkContext.broadcast((top.column("word").to_pylist(), top.column("c").to_numpy(), top.column("lp").to_numpy()))
    tokens = rows.mapInArrow(_look_up(sent, (ends, math.log10(ends + 1) - log_total, end_lp), log_total), _TOKENS_SQL)
    cold = table.filter(~hot)
    met = tokens.join(cold, "word", "left")
    base = F.col("tf") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) - log_total)
    out = met.groupBy("doc_id", "h").agg(
        F.count("own").alias("times"), F.first("own.held_out", ignorenulls=True).alias("held_out"), F.sum("own.n_tokens").alias("n_tokens"),
        (F.sum("own.n_known") + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("tf"))), F.lit(0))).alias("n_known"),
        (F.sum("own.base") + F.coalesce(F.sum(F.when(F.col("own").isNull(), base)), F.lit(0.0))).alias("base_score"),
        (F.sum("own.score") + F.coalesce(F.sum(F.col("tf") * F.col("lp")), F.lit(0.0))).alias("score"),
    )
    share = lambda c: (F.col(c) / F.col("times")).alias(c)  # noqa: E731  rows that repeat an id and its text are one group
    out = out.withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("doc_id", "held_out", share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), share("base_score"), share("score"))
