"""Characters: vocabulary, encoding, splits and shifted windows, causal attention, softmax, cross-entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidstone.functions.vectors import dot, doubles
from braidstone.operators.text import offsets


def _chars(text: Column) -> Column:
    return F.when(F.char_length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def char_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(_chars(F.col("text"))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


def char_vocabulary(docs: DataFrame) -> DataFrame:
    """``(ch, id)``: distinct characters by code point. There are at most as many as Unicode has."""
    return char_counts(docs).select("ch", (F.row_number().over(Window.orderBy("ch")) - 1).cast("int").alias("id"))


def _lookup(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.map_from_entries(F.collect_list(F.struct("ch", "id"))).alias("stoi"), F.map_from_entries(F.collect_list(F.struct("id", "ch"))).alias("itos"))


def encode(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``docs`` with ``ids``; a character outside the vocabulary raises an error."""
    known = lambda c: F.coalesce(F.try_element_at(F.col("stoi"), c), F.raise_error(F.concat(F.lit("not in the vocabulary: "), c)).cast("int"))
    return docs.join(F.broadcast(_lookup(vocab).select("stoi"))).withColumn("ids", F.transform(_chars(F.coalesce("text", F.lit(""))), known)).drop("stoi")


def decode(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """``encoded`` with ``decoded``."""
    return encoded.join(F.broadcast(_lookup(vocab).select("itos"))).withColumn("decoded", F.array_join(F.transform("ids", lambda i: F.element_at(F.col("itos"), i)), "")).drop("itos")


def placed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, size, offset)``: where each text begins in the stream of all characters by doc_id."""
    sized = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("size", F.char_length("text").cast("long"))
    return sized.join(offsets(sized.select("doc_id", "size"), "doc_id", "size").select("doc_id", "offset"), "doc_id")


def train_val(docs: DataFrame, share: float = 0.9) -> DataFrame:
    """``(doc_id, n_train, n_val)``: characters of each document before and behind the cut of the stream."""
    at = placed(docs)
    total = at.agg(F.floor(F.sum("size") * share).alias("cut"))
    train = F.least(F.col("size"), F.greatest(F.lit(0), F.col("cut") - F.col("offset")))
    return at.join(F.broadcast(total)).select("doc_id", train.cast("long").alias("n_train"), (F.col("size") - train).cast("long").alias("n_val"))


def blocks(docs: DataFrame, length: int = 64, stride: int | None = None) -> DataFrame:
    """``(start, x, y)``: windows of the stream at every ``stride`` characters and the same one further on.

    Each document contributes its part of a window by substring, never character by character; the last window that
    ends one short of the stream is left out, as the random sampler never draws it.
    """
    step = stride or length
    at = placed(docs).filter("size > 0")
    total = at.agg(F.sum("size").alias("total"))
    first = F.greatest(F.lit(0), F.ceil((F.col("offset") - length) / step)).cast("long")
    last = F.floor((F.col("offset") + F.col("size") - 1) / step).cast("long")
    parts = at.select("offset", "text", F.explode(F.sequence(first, last)).alias("b")).withColumn("start", F.col("b") * step)
    lo, hi = F.greatest(F.col("start") - F.col("offset"), F.lit(0)), F.col("start") + length + 1 - F.col("offset")
    parts = parts.filter(lo < hi).select("start", "offset", F.substring(F.col("text"), (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part")).filter("part <> ''")
    whole = parts.groupBy("start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "part"))), lambda s: s["part"]), "").alias("w"))
    kept = whole.join(F.broadcast(total)).filter(F.col("start") <= F.col("total") - length - 2)
    return kept.select("start", F.substring("w", 1, length).alias("x"), F.substring("w", 2, length).alias("y"))


def random_blocks(docs: DataFrame, length: int = 64, batch: int = 32, seed: int = 0) -> DataFrame:
    """``(draw, start, x, y)``: ``batch`` windows of the stream at random starts, and the same ones one further on.

    A draw's start depends on its number and the seed only. All starts, a few thousand at most, meet each document as
    one array, and only the parts that a window takes of a text leave its row.
    """
    at = placed(docs).filter("size > 0")
    total = at.agg(F.sum("size").alias("total"))
    starts = docs.sparkSession.range(batch).withColumnRenamed("id", "draw").join(F.broadcast(total)).filter(F.col("total") > length + 1)
    starts = starts.select("draw", F.pmod(F.xxhash64("draw", F.lit(seed)), F.col("total") - length - 1).alias("start"))
    every = starts.agg(F.collect_list(F.struct("draw", "start")).alias("starts"))
    here = lambda s: (s["start"] < F.col("offset") + F.col("size")) & (s["start"] + length + 1 > F.col("offset"))
    drawn = at.join(F.broadcast(every)).select("offset", "size", "text", F.explode(F.filter("starts", here)).alias("s")).select("offset", "size", "text", "s.*")
    lo = F.greatest(F.col("start") - F.col("offset"), F.lit(0))
    hi = F.least(F.col("start") + length + 1 - F.col("offset"), F.col("size"))
    parts = drawn.select("draw", "start", "offset", F.substring(F.col("text"), (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    whole = parts.groupBy("draw", "start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "part"))), lambda s: s["part"]), "").alias("w"))
    return whole.select("draw", "start", F.substring("w", 1, length).alias("x"), F.substring("w", 2, length).alias("y"))


def causal_attention(rows: DataFrame, seq: str, pos: str, vec: str) -> DataFrame:
    """``(seq, pos, dim, value)``: softmax(q k / sqrt(d)) over places up to one's own, applied to the vectors."""
    q = rows.select(F.col(seq).alias("seq"), F.col(pos).alias("qpos"), doubles(F.col(vec)).alias("q"))
    k = rows.select(F.col(seq).alias("seq"), F.col(pos).alias("kpos"), doubles(F.col(vec)).alias("k"))
    scores = q.join(k, "seq").filter("kpos <= qpos").withColumn("s", dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q")))
    w = Window.partitionBy("seq", "qpos")
    soft = scores.withColumn("e", F.exp(F.col("s") - F.max("s").over(w))).withColumn("weight", F.col("e") / F.sum("e").over(w))
    return soft.select("seq", F.col("qpos").alias("pos"), "weight", F.posexplode("k").alias("dim", "x")).groupBy("seq", "pos", "dim").agg(F.sum(F.col("weight") * F.col("x")).alias("value"))


def multi_head_attention(rows: DataFrame, seq: str, pos: str, vec: str, heads: int) -> DataFrame:
    """``causal_attention`` of each of ``heads`` equal slices of the vectors by itself; the slices' results side by side.

    Projections come before it, as ``functions.vectors.linear`` of the vectors.
    """
    size = F.size(vec) / heads
    cut = rows.select(F.col(seq).alias("seq"), F.col(pos).alias("pos"), F.col(vec).alias("v"), size.cast("int").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head"))
    part = cut.select(F.struct("seq", "head", "size").alias("s"), "pos", F.slice("v", F.col("head") * F.col("size") + 1, F.col("size")).alias("v"))
    out = causal_attention(part, "s", "pos", "v")
    return out.select(F.col("seq.seq").alias("seq"), "pos", (F.col("seq.head") * F.col("seq.size") + F.col("dim")).alias("dim"), "value")


def target_cross_entropy(rows: DataFrame, group: str, logit: str, is_target: Column) -> DataFrame:
    """``(rows, loss)``: the mean over groups of log(sum(exp(logits))) less the target's logit; groups without a target are left out."""
    w = Window.partitionBy(group)
    top = rows.withColumns({"top": F.max(logit).over(w), "t": is_target})
    each = top.groupBy(group).agg((F.log(F.sum(F.exp(F.col(logit) - F.col("top")))) + F.max("top") - F.max(F.when(F.col("t"), F.col(logit)))).alias("loss"))
    return each.filter(F.col("loss").isNotNull()).agg(F.count(F.lit(1)).alias("rows"), F.avg("loss").alias("loss"))


def softmax(rows: DataFrame, group: str, logit: str, temperature: float = 1.0) -> DataFrame:
    """``rows`` with ``p``."""
    w = Window.partitionBy(group)
    scaled = F.col(logit) / temperature
    return rows.withColumn("e", F.exp(scaled - F.max(scaled).over(w))).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def cross_entropy(counts: DataFrame) -> DataFrame:
    """``(vocab_size, uniform, unigram)`` over ``(ch, n)``: ln V, and the mean loss of the character frequencies."""
    total = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("v"))
    return counts.join(F.broadcast(total)).agg(F.max("v").alias("vocab_size"), F.log(F.max("v")).alias("uniform"), F.sum(-F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t"))).alias("unigram"))
