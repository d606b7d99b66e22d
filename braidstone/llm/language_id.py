"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three lower-cased characters. Document frequencies count every training
document. The classifier is fitted on a bounded sample of them by follow-the-regularised-leader with L1 and L2
penalties: of each language the documents of smallest id hash, as many of each as make SAMPLE_DOCS together, however
the table is ordered. One part of the sample in five is kept from it and fixes the temperature of the softmax.

Defined cases: a null text or one without a letter (Unicode's categories L; digits, fractions and marks are none) is
``und`` with score 0. Training rows need a language, a text and an id; rows that repeat an id count once in the
sample. Without any training row all predictions are ``und``. Of languages with equal probability the first by name is
said. Repeated rows are predicted alike. Long texts are counted whole, a text at a time. Extra columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidstone.llm.common import frugal, hand_back

FEATURES = 1 << 14
#: The bound of the sample the classifier is fitted on.
SAMPLE_DOCS = 6_000
#: Texts held as Python strings at once.
CHUNK = 500
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-3, 1e-4, 4
_LETTER = re.compile(r"[^\W\d_]")
#: ``identified_rows`` rejects a text whose best probability is not this share of the way from chance (one over the
#: number of languages) to certainty. Of 51,282 documents of a table none was that low; the least had 0.14 of the way.
REJECT = 0.05
#: Id hashes are compared modulo this.
HASHES = 1 << 40


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))  # the class has fractions and the like too


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text, over FEATURES buckets."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint32)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    out, h = np.zeros(FEATURES, np.int64), np.zeros(len(c), np.uint32)
    for n in range(min(3, len(c))):
        h = (h[: len(c) - n] * np.uint32(0x01000193) + c[n:] + np.uint32(n)) * np.uint32(0x9E3779B1)
        out += np.bincount(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> shift, minlength=FEATURES)
    return out


def texts(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, as Python strings CHUNK at a time."""
    for at in range(0, len(column), CHUNK):
        yield from column.slice(at, CHUNK).to_pylist()


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit-length TF-IDF vector as positions and values; term frequencies are damped by a square root."""
    counts = ngram_counts(text)
    at = np.flatnonzero(counts)
    x = np.sqrt(counts[at]) * idf[at]
    norm = np.sqrt(x @ x)
    return at, x / norm if norm else x


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@frugal
def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(FEATURES, np.int64), 0
    for b in batches:
        for text in texts(b.column(0)):
            total[np.flatnonzero(ngram_counts(text))] += 1
            docs += 1
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs))], ["feature", "n"])


def _sparse(idf: np.ndarray):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = zip(*(vector(t, idf) for t in texts(b.column(0))), strict=True) if b.num_rows else ((), ())
            yield pa.record_batch([b.column(1), pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()), pa.array([v.astype(np.float32).tobytes() for v in x], pa.binary())], ["lang", "at", "x"])

    return run


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0
        at, x = vector(text, self.idf)
        p = _softmax((x @ self.weights[at] + self.bias) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])

    def accepts(self, text: str | None) -> bool:
        said, score = self.predict(text)
        chance = 1 / max(1, len(self.langs))
        return said != "und" and score >= chance + REJECT * (1 - chance)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by follow-the-regularised-leader; the last feature is the bias, without penalty."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n[at]
        l1 = np.where(at == FEATURES, 0.0, L1)[:, None]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((BETA + np.sqrt(nn)) / ALPHA + np.where(at == FEATURES, 0.0, L2)[:, None]))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, FEATURES), np.append(x.astype(float), 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            before = n[at]
            n[at] = before + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(before)) / ALPHA * w
    w = weights(np.arange(FEATURES + 1))
    return w[:-1], w[-1]


def training_sample(usable: DataFrame, lang: str, sample_docs: int) -> DataFrame:
    """``(text, lang)``: of each language of ``usable(text, lang, hash)`` the documents of smallest hash, alike many.

    Hashes under a bound that about twice as many meet as are wanted come first, so that no task ranks a language.
    """
    counts = usable.groupBy(lang).agg(F.count(F.lit(1)).alias("of"))
    languages = counts.count()  # the classes of the model
    each = max(1, sample_docs // max(1, languages))
    low = usable.withColumn("hash", F.pmod("hash", F.lit(HASHES))).join(F.broadcast(counts), lang).filter(F.col("hash") * F.col("of") < F.lit(2.0 * each + 64) * HASHES)
    one = low.groupBy(lang, "hash").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy(lang).orderBy("hash"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= each).select("text", lang)


def fit(docs: DataFrame, lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """``docs(text, lang, hash)``: training rows; ``hash`` orders them at random and alike at each run."""
    usable = docs.filter(F.col("text").isNotNull() & F.col(lang).isNotNull())
    found = {r[0]: r[1] for r in usable.select("text").mapInArrow(_document_frequency, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect()}  # FEATURES rows at most
    total = found.pop(-1, 0)
    df = np.zeros(FEATURES)
    df[list(found)] = list(found.values())
    idf = np.log((1 + total) / (1 + df)) + 1
    sample = training_sample(usable, lang, sample_docs)
    got = sample.mapInArrow(_sparse(idf), "lang string, at binary, x binary").toArrow()
    said = got.column("lang").to_pylist()
    langs = sorted(set(said))
    if not langs:
        return Model([], idf, np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    # Views of the collected buffers: the sample is in the driver's memory once.
    rows = [(np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(x.as_buffer(), np.float32), langs.index(y)) for y, a, x in zip(said, got.column("at"), got.column("x"), strict=True)]
    rows.sort(key=lambda r: (r[2], len(r[0]), r[1][:1].tolist(), r[1].sum(dtype=float)))  # alike for any order of arrival
    kept, fitted = rows[::5], [r for i, r in enumerate(rows) if i % 5] or rows
    w, b = ftrl(fitted, len(langs))
    scores, y = np.array([x @ w[at] + b for at, x, _ in kept]), np.array([r[2] for r in kept])
    grid = np.exp(np.linspace(np.log(0.05), np.log(10), 107))
    loss = [-np.log(np.maximum(_softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    del rows, kept, fitted, got
    hand_back()
    return Model(langs, idf, w, b, float(grid[int(np.argmin(loss))]))


def _predict(model):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            said = [m.predict(t) for t in texts(b.column(b.num_columns - 1))]
            yield pa.record_batch([*b.columns[:-1], pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` per row; learns from rows outside the held-out third."""
    train = docs.filter(~held_out(id_col) & F.col(id_col).isNotNull()).select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("hash"))
    model = docs.sparkSession.sparkContext.broadcast(fit(train))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def identified_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language.

    Those predicted ``und`` go, and those whose calibrated score is hardly above chance (REJECT).
    """
    train = docs.filter(~held_out(id_col) & F.col(id_col).isNotNull()).select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("hash"))
    model = docs.sparkSession.sparkContext.broadcast(fit(train))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            at = b.schema.names.index("text")
            yield b.filter(pa.array([m.accepts(t) for t in texts(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
