"""Text statistics as relations: tokens, vocabulary, sparse matrices in coordinate form, weights, similarity, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidstone.functions.ranks import placed
from braidstone.functions.staging import sized, stage
from braidstone.operators import neighbours

MIN_COUNT = 50
#: White space, that of Unicode too, in the syntax that Java and RE2 share.
BLANKS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Documents are numbered in blocks; offsets are summed over blocks first, so no task holds all documents.
OFFSET_BLOCK = 4096


def token_arrays(docs: DataFrame) -> DataFrame:
    """``docs`` with ``words``: lower-cased, split at white space, no empty ones."""
    return docs.withColumn("words", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), BLANKS), lambda w: w != ""))


def tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep..., pos, word``."""
    return token_arrays(docs).select(*keep, F.posexplode("words").alias("pos", "word"))


def offsets(rows: DataFrame, order: str, size: str) -> DataFrame:
    """``rows`` with ``offset``: the sum of ``size`` over all rows before it by the integer column ``order``."""
    block = F.floor(F.col(order) / OFFSET_BLOCK)
    blocks = rows.groupBy(block.alias("block")).agg(F.sum(size).alias("in_block"))
    before = blocks.select("block", (F.sum("in_block").over(Window.orderBy("block")) - F.col("in_block")).alias("before"))
    inside = F.sum(size).over(Window.partitionBy("block").orderBy(order)) - F.col(size)
    return rows.withColumn("block", block).withColumn("inside", inside).join(before, "block").withColumn("offset", (F.col("inside") + F.col("before")).cast("long")).drop("block", "inside", "before")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where their files make fewer partitions than there are cores; as they are otherwise."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def placed_arrays(docs: DataFrame) -> DataFrame:
    """``(doc_id, words, offset)``, stored: ``offset`` tokens of the stream of all documents by doc_id come before."""
    arrays = stage(token_arrays(spread(docs.select("doc_id", "text"))).select("doc_id", "words", F.size("words").cast("long").alias("size")), "words")
    at = offsets(arrays.select("doc_id", "size"), "doc_id", "size").select("doc_id", "offset")
    return arrays.drop("size").join(sized(at, arrays.count()), "doc_id")


def stream(docs: DataFrame) -> DataFrame:
    """``(gpos, word)``: all documents one after another by doc_id, every token in its place."""
    return placed_arrays(docs).select("offset", F.posexplode("words").alias("pos", "word")).select((F.col("offset") + F.col("pos")).alias("gpos"), "word")


def vocabulary(words: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of words that occur ``least`` times or more."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def indexed(vocab: DataFrame) -> DataFrame:
    """``vocab``, stored, with ``idx``, a word's rank in order."""
    return placed(stage(vocab, "vocabulary"), ["word"], "idx", int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def term_document(docs: DataFrame, unit: str = "source", least: int = MIN_COUNT) -> DataFrame:
    """``(word, doc, tf)``, only cells that are not zero; ``doc`` is the unit."""
    cells = tokens(docs, F.col(unit).alias("doc")).groupBy("word", "doc").agg(F.count(F.lit(1)).alias("tf"))
    kept = cells.groupBy("word").agg(F.sum("tf").alias("n")).filter(F.col("n") >= least).select("word")
    return cells.join(kept, "word")


def cooccurrence(words: DataFrame, vocab: DataFrame, window: int) -> DataFrame:
    """``(w, c, d, n)``: how often c stands d places from w, for d up to ``window``; both words are in the vocabulary.

    Words outside it keep their places. Each token is sent to the places it is a context of, and an equi-join on the
    place meets them: linear in tokens times window.
    """
    kept = words.join(vocab.select("word"), "word", "left_semi")
    shifted = kept.select(F.explode(F.array(*(F.lit(d).cast("long") for d in range(1, window + 1)))).alias("d"), (F.col("gpos") + F.col("d")).alias("gpos"), F.col("word").alias("c"))
    met = kept.withColumnRenamed("word", "w").join(shifted, "gpos")
    both = met.groupBy("w", "c", "d").agg(F.count(F.lit(1)).alias("n"))
    return both.unionByName(both.select(F.col("c").alias("w"), F.col("w").alias("c"), "d", "n")).groupBy("w", "c", "d").agg(F.sum("n").alias("n"))


#: A vocabulary up to this size is sent to the tasks; a larger one meets the tokens in joins.
SENT_WORDS = 2_000_000


def document_cooccurrence(arrays: DataFrame, vocab: DataFrame, window: int) -> DataFrame:
    """What ``cooccurrence`` of the stream of ``arrays(doc_id, words, offset)`` gives.

    Neighbours within a document are counted where it lies and added up before they are shuffled; only the first and
    last ``window`` tokens of a document meet those of others by their places.
    """
    if vocab.count() > SENT_WORDS:
        return cooccurrence(arrays.select("offset", F.posexplode("words").alias("pos", "word")).select((F.col("offset") + F.col("pos")).alias("gpos"), "word"), vocab, window)
    words, rings = neighbours.Words(vocab), tuple(range(1, window + 1))
    return neighbours.word_rows(neighbours.counts(arrays, neighbours.ends(arrays, window), words, rings), words, rings)


def corpus(docs: DataFrame, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, words)`` and the vocabulary, stored; without ``keep`` texts are split each time, which takes longer and less disk."""
    arrays = token_arrays(spread(docs.select("doc_id", "text"))).select("doc_id", "words")
    arrays = stage(arrays, "words") if keep else arrays
    return arrays, stage(vocabulary(arrays.select(F.explode("words").alias("word"))), "vocabulary")


def ring_counts(arrays: DataFrame, words: neighbours.Words, rings: tuple[int, ...]) -> DataFrame:
    """Packed counts of ``arrays(doc_id, words)`` as one stream by doc_id; of the documents only their ends are stored."""
    ended = offsets(stage(neighbours.ends(arrays, rings[-1]), "ends"), "doc_id", "size")
    return neighbours.counts(arrays, ended, words, rings)


def window_counts(cells: DataFrame, window: int) -> DataFrame:
    return cells.filter(F.col("d") <= window).groupBy("w", "c").agg(F.sum("n").alias("n"))


def tfidf(td: DataFrame, documents: int) -> DataFrame:
    """``td`` with ``tfidf``: raw count times log10(N / df)."""
    df = td.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return td.join(df, "word").withColumn("tfidf", F.col("tf") * F.log10(F.lit(documents) / F.col("df")))


def ppmi(counts: DataFrame) -> DataFrame:
    """``(w, c, n, ppmi)``: log2(n T / (row column)), at least 0. The counts are stored, as four sums read them."""
    counts = stage(counts, "counts")
    rows = counts.groupBy("w").agg(F.sum("n").alias("rw"))
    columns = counts.groupBy("c").agg(F.sum("n").alias("rc"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.join(rows, "w").join(columns, "c").join(F.broadcast(total)).select("w", "c", "n", F.greatest(F.lit(0.0), F.log2(F.col("n") * F.col("t") / (F.col("rw").cast("double") * F.col("rc")))).alias("ppmi"))


def sparse_cosine(cells: DataFrame, key: str, dim: str, value: str, targets: DataFrame | None = None) -> DataFrame:
    """``(a, b, sim)`` of sparse vectors in coordinate form, by an equi-join on the shared dimension.

    ``targets(key)``: vectors a is taken from; without it all, with a < b. Pairs that share no dimension are left out.
    """
    v = cells.select(F.col(key).alias("k"), F.col(dim).alias("dim"), F.col(value).cast("double").alias("v")).filter("v <> 0")
    norms = v.groupBy("k").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    left = v if targets is None else v.join(targets.select(F.col(key).alias("k")), "k", "left_semi")
    pairs = left.select(F.col("k").alias("a"), "dim", F.col("v").alias("va")).join(v.select(F.col("k").alias("b"), "dim", F.col("v").alias("vb")), "dim")
    pairs = pairs.filter("a < b" if targets is None else "a <> b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    na, nb = norms.select(F.col("k").alias("a"), F.col("norm").alias("na")), norms.select(F.col("k").alias("b"), F.col("norm").alias("nb"))
    return pairs.join(na, "a").join(nb, "b").select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("sim"))


def sparse_pair_scores(pairs: DataFrame, cells: DataFrame, value: str, names: DataFrame) -> DataFrame:
    """``pairs(w1, w2, human)`` with the cosine of their rows of ``cells(w, c, <value>)``; rows without a common column score 0.

    Pairs with a word that is not among ``names(word)`` go.
    """
    known = lambda side: names.select(F.col("word").alias(side))
    said = pairs.join(known("w1"), "w1", "left_semi").join(known("w2"), "w2", "left_semi")
    v = cells.select("w", "c", F.col(value).cast("double").alias("v")).filter("v <> 0")
    norms = v.groupBy("w").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    one, two = (v.select(F.col("w").alias(f"w{i}"), "c", F.col("v").alias(f"v{i}")) for i in (1, 2))
    dots = said.select("w1", "w2").distinct().join(one, "w1").join(two, ["w2", "c"]).groupBy("w1", "w2").agg(F.sum(F.col("v1") * F.col("v2")).alias("dot"))
    out = said.join(dots, ["w1", "w2"], "left")
    for i in (1, 2):
        out = out.join(norms.select(F.col("w").alias(f"w{i}"), F.col("norm").alias(f"n{i}")), f"w{i}", "left")
    return out.select("w1", "w2", "human", F.coalesce(F.col("dot") / (F.col("n1") * F.col("n2")), F.lit(0.0)).alias("score"))


def top(rows: DataFrame, group: str, by: str, name: str, k: int | None = None) -> DataFrame:
    """The k rows (None: all) of each group with the largest ``by`` (rounded to 6 places, ties by ``name``), with ``rank``."""
    w = Window.partitionBy(group).orderBy(F.round(by, 6).desc(), name)
    ranked = rows.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def ends(ranked: DataFrame, group: str, head: int, tail: int) -> DataFrame:
    """The first ``head`` and last ``tail`` rows of each group of ``ranked(group, rank)``."""
    last = ranked.groupBy(group).agg(F.max("rank").alias("last"))
    return ranked.join(last, group).filter((F.col("rank") <= head) | (F.col("rank") > F.col("last") - tail)).drop("last")


def similar(cells: DataFrame, value: str, targets: DataFrame, names: DataFrame, k: int = 10) -> DataFrame:
    """``(word, neighbour, sim, rank)``: for each target word the k most similar rows; words without overlap score 0."""
    sims = sparse_cosine(cells.withColumnRenamed("w", "word"), "word", "c", value, targets)
    got = sims.select(F.col("a").alias("word"), F.col("b").alias("neighbour"), "sim")
    # of k + 1 names one may be the word itself and each other one missing is a row already found
    spare = names.select(F.col("word").alias("neighbour")).orderBy("neighbour").limit(k + 1)
    zeros = targets.select("word").join(F.broadcast(spare)).filter("word <> neighbour").join(got, ["word", "neighbour"], "left_anti").withColumn("sim", F.lit(0.0))
    return top(got.unionByName(zeros), "word", "sim", "neighbour", k)


def group_pair_similarity(sims: DataFrame, groups: DataFrame) -> DataFrame:
    """``(group_a, group_b, mean_sim, pairs)`` over pairs ``(a, b, sim)`` and ``groups(unit, grp)``."""
    ga, gb = groups.select(F.col("unit").alias("a"), F.col("grp").alias("ga")), groups.select(F.col("unit").alias("b"), F.col("grp").alias("gb"))
    return sims.join(ga, "a").join(gb, "b").groupBy(F.least("ga", "gb").alias("group_a"), F.greatest("ga", "gb").alias("group_b")).agg(F.avg("sim").alias("mean_sim"), F.count(F.lit(1)).alias("pairs"))
