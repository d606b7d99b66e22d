"""Text and character queries over documents, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidstone.functions.staging import stage
from braidstone.operators import chars, embeddings, neighbours, text

WINDOWS = (1, 2, 5, 10)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded to six places, where sums in another order differ."""
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def word_count_min50(spark, d):
    return text.indexed(text.vocabulary(text.tokens(docs(spark, d))))


def term_document(spark, d):
    return text.term_document(docs(spark, d))


def doc_frequency(spark, d):
    return term_document(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def td_sparsity(spark, d):
    units = docs(spark, d).agg(F.countDistinct("source").alias("documents"))
    td = term_document(spark, d).agg(F.countDistinct("word").alias("words"), F.count(F.lit(1)).alias("nnz"), F.sum("tf").alias("total"))
    return r6(td.join(units).withColumn("sparsity", 100.0 * (1 - F.col("nnz") / (F.col("words") * F.col("documents")))), "sparsity")


def document_similarity(spark, d):
    return r6(text.sparse_cosine(term_document(spark, d), "doc", "word", "tf"), "sim")


def document_rank(spark, d):
    s = text.sparse_cosine(term_document(spark, d), "doc", "word", "tf")
    both = s.unionByName(s.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    return r6(text.top(both, "a", "sim", "b"), "sim")


def _tfidf(spark, d):
    return text.tfidf(term_document(spark, d), docs(spark, d).select("source").distinct().count())


def tfidf(spark, d):
    return r6(_tfidf(spark, d).select("word", "doc", "tf", "df", "tfidf"), "tfidf")


def top_terms_raw(spark, d):
    return text.top(term_document(spark, d), "doc", "tf", "word", 10)


def top_terms_tfidf(spark, d):
    return r6(text.top(_tfidf(spark, d).select("word", "doc", "tfidf"), "doc", "tfidf", "word", 10), "tfidf")


def _stream_cells(spark, d, vocab, window):
    return text.document_cooccurrence(stage(text.placed_arrays(docs(spark, d)), "placed"), vocab, window)


def _window_rows(spark, d, rings, name):
    """Counts of the distances up to each of ``rings``; None beside the vocabulary if that is too large to be sent."""
    arrays, vocab = text.corpus(docs(spark, d), keep=rings[-1] < 5)
    if vocab.count() > text.SENT_WORDS:
        return None, vocab
    words = neighbours.Words(vocab)
    return neighbours.word_rows(text.ring_counts(arrays, words, rings), words, rings, name, sums=True), vocab


def cooccurrence_w2(spark, d):
    rows, vocab = _window_rows(spark, d, (2,), None)
    return rows if rows is not None else text.window_counts(_stream_cells(spark, d, vocab, 2), 2)


def cooccurrence_sweep(spark, d):
    rows, vocab = _window_rows(spark, d, WINDOWS, "window")
    if rows is not None:
        return rows.select("window", "w", "c", "n")
    sizes = F.explode(F.array(*map(F.lit, WINDOWS))).alias("window")
    return _stream_cells(spark, d, vocab, max(WINDOWS)).select("*", sizes).filter("d <= window").groupBy("window", "w", "c").agg(F.sum("n").alias("n"))


def _cells(spark, d):
    """``(words, cells, vocabulary)``; for a vocabulary too large to be sent no words, and PPMI cells by word."""
    arrays, vocab = text.corpus(docs(spark, d))
    if vocab.count() > text.SENT_WORDS:
        return None, text.ppmi(text.window_counts(_stream_cells(spark, d, vocab, 2), 2)), vocab
    words = neighbours.Words(vocab)
    return words, neighbours.cells(text.ring_counts(arrays, words, (2,)), words), vocab


def ppmi(spark, d):
    words, cells, _ = _cells(spark, d)
    return r6(cells if words is None else neighbours.ppmi(cells, words), "ppmi")


def _similar(spark, d, value):
    """For each word of the vocabulary whose index is divisible by 20."""
    words, cells, vocab = _cells(spark, d)
    if words is None:
        targets = stage(text.indexed(vocab).filter("idx % 20 = 0").drop("idx"), "targets")
        return r6(text.similar(stage(cells, "cells"), value, targets, vocab), "sim")
    return r6(text.top(neighbours.similar(cells, words, value, np.arange(0, len(words), 20)), "word", "sim", "neighbour", 10), "sim")


def similar_words_raw(spark, d):
    return _similar(spark, d, "n")


def similar_words_ppmi(spark, d):
    return _similar(spark, d, "ppmi")


def pair_scores_ppmi(spark, d):
    """Each word of the vocabulary with the next one."""
    words, cells, vocab = _cells(spark, d)
    named = text.indexed(vocab)
    after = named.select((F.col("idx") - 1).alias("idx"), F.col("word").alias("w2"))
    pairs = named.select("idx", F.col("word").alias("w1")).join(after, "idx").select("w1", "w2", (F.col("idx") * 37 % 101).cast("double").alias("human"))
    if words is None:
        return r6(embeddings.similarity_scores(pairs, "ppmi", stage(cells, "cells"), named), "score")
    scores = neighbours.pair_scores(cells, words, pairs)
    return r6(pairs.join(scores, ["w1", "w2"], "left").select("w1", "w2", "human", F.coalesce("score", F.lit(0.0)).alias("score")), "score")


def rank_ends(spark, d):
    """The five most and three least similar units of each."""
    return text.ends(document_rank(spark, d), "a", 5, 3)


def group_pair_similarity(spark, d):
    units = docs(spark, d).withColumn("unit", F.concat_ws("/", "source", "lang"))
    sims = text.sparse_cosine(text.term_document(units, "unit"), "doc", "word", "tf")
    return r6(text.group_pair_similarity(sims, units.select("unit", F.col("lang").alias("grp")).distinct()), "mean_sim")


def char_vocab(spark, d):
    return chars.char_vocabulary(docs(spark, d))


def char_encode(spark, d):
    x = docs(spark, d)
    return chars.encode(x, chars.char_vocabulary(x)).select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


def char_decode(spark, d):
    x = docs(spark, d)
    v = chars.char_vocabulary(x)
    return chars.decode(chars.encode(x, v), v).select("doc_id", F.md5("decoded").alias("text_md5"))


def train_val_split(spark, d):
    return chars.train_val(docs(spark, d))


def char_blocks(spark, d):
    return chars.blocks(docs(spark, d)).select("start", F.md5("x").alias("x_md5"), F.md5("y").alias("y_md5"))


def uniform_cross_entropy(spark, d):
    return r6(chars.cross_entropy(chars.char_counts(docs(spark, d))), "uniform", "unigram")


QUERIES = {f.__name__: f for f in (word_count_min50, term_document, doc_frequency, td_sparsity, document_similarity, document_rank, tfidf, top_terms_raw, top_terms_tfidf, cooccurrence_w2, cooccurrence_sweep, ppmi, similar_words_raw, similar_words_ppmi, pair_scores_ppmi, rank_ends, group_pair_similarity, char_vocab, char_encode, char_decode, train_val_split, char_blocks, uniform_cross_entropy)}

_TOK = rf"""tok as (select doc_id, source, lang, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from (
  select doc_id, source, lang, list_filter(string_split_regex(lower(coalesce(text, '')), '{text.BLANKS}'), lambda x: x <> '') as w from documents))"""
_VOC = f"{_TOK}, voc as (select word, count(*) as n from tok group by word having count(*) >= 50)"
_TD = f"{_VOC}, td as (select word, source as doc, count(*)::bigint as tf from tok where word in (select word from voc) group by 1, 2)"
_SIM = """norms as (select k, sqrt(sum(v * v)) as norm from vec group by k),
sims as (select x.k as a, y.k as b, sum(x.v * y.v) / (any_value(nx.norm) * any_value(ny.norm)) as sim
  from vec x join vec y on x.dim = y.dim and x.k < y.k join norms nx on nx.k = x.k join norms ny on ny.k = y.k group by 1, 2)"""
_TDSIM = f"{_TD}, vec as (select doc as k, word as dim, tf::double as v from td), {_SIM}"
_TFIDF = f"{_TD}, dfs as (select word, count(*)::bigint as df from td group by word), tfs as (select td.*, df, tf * log10((select count(distinct source) from documents)::double / df) as tfidf from td join dfs using (word))"
_STREAM = f"{_VOC}, st as (select row_number() over (order by doc_id, pos) as gpos, word from tok), kept as (select * from st where word in (select word from voc))"


def _cooc(w: int) -> str:
    pairs = f"select x.word as w, y.word as c, abs(x.gpos - y.gpos) as d from kept x join (select gpos, word, unnest(range(-{w}, {w} + 1)) as o from kept) y on x.gpos = y.gpos + y.o and y.o <> 0"
    return f"{_STREAM}, co as ({pairs})"


_PPMI = f"{_cooc(2)}, cells as (select w, c, count(*)::bigint as n from co group by 1, 2), pp as (select w, c, n, greatest(0.0, log2(n * (sum(n) over ())::double / ((sum(n) over (partition by w))::double * (sum(n) over (partition by c))::double))) as ppmi from cells)"


def _similar_sql(value: str) -> str:
    return f"""with {_PPMI}, vec as (select w as k, c as dim, {value}::double as v from pp where {value} <> 0),
      norms as (select k, sqrt(sum(v * v)) as norm from vec group by k),
      tg as (select word from (select word, row_number() over (order by word) - 1 as idx from voc) where idx % 20 = 0),
      dots as (select x.k as word, y.k as neighbour, sum(x.v * y.v) / (any_value(nx.norm) * any_value(ny.norm)) as sim
        from vec x join vec y on x.dim = y.dim and x.k <> y.k join norms nx on nx.k = x.k join norms ny on ny.k = y.k where x.k in (select word from tg) group by 1, 2),
      al as (select tg.word, voc.word as neighbour, coalesce(sim, 0.0) as sim from tg join voc on tg.word <> voc.word left join dots on dots.word = tg.word and dots.neighbour = voc.word)
      select word, neighbour, round(sim, 6) as sim, rank from (select *, row_number() over (partition by word order by round(sim, 6) desc, neighbour) as rank from al) where rank <= 10"""


_CH = "ch as (select doc_id, unnest(c) as ch, unnest(range(1, len(c) + 1)) as pos from (select doc_id, string_split(text, '') as c from documents where text <> '')), cv as (select ch, (row_number() over (order by ch) - 1)::integer as id from (select distinct ch from ch))"
_AT = "pl as (select doc_id, coalesce(text, '') as text, length(coalesce(text, ''))::bigint as size, (sum(length(coalesce(text, ''))) over (order by doc_id) - length(coalesce(text, '')))::bigint as off from documents)"

ORACLES = {
    "word_count_min50": f"with {_VOC} select word, n::bigint as n, row_number() over (order by word) - 1 as idx from voc",
    "term_document": f"with {_TD} select * from td",
    "doc_frequency": f"with {_TD} select word, count(*)::bigint as df from td group by word",
    "td_sparsity": f"with {_TD} select *, round(100.0 * (1 - nnz::double / (words * documents)), 6) as sparsity from (select count(distinct word)::bigint as words, count(*)::bigint as nnz, sum(tf)::bigint as total, (select count(distinct source) from documents)::bigint as documents from td)",
    "document_similarity": f"with {_TDSIM} select a, b, round(sim, 6) as sim from sims",
    "document_rank": f"with {_TDSIM}, bo as (select a, b, sim from sims union all select b, a, sim from sims) select a, b, round(sim, 6) as sim, row_number() over (partition by a order by round(sim, 6) desc, b) as rank from bo",
    "tfidf": f"with {_TFIDF} select word, doc, tf, df, round(tfidf, 6) as tfidf from tfs",
    "top_terms_raw": f"with {_TD} select * from (select word, doc, tf, row_number() over (partition by doc order by tf desc, word) as rank from td) where rank <= 10",
    "top_terms_tfidf": f"with {_TFIDF} select * from (select word, doc, round(tfidf, 6) as tfidf, row_number() over (partition by doc order by round(tfidf, 6) desc, word) as rank from tfs) where rank <= 10",
    "cooccurrence_w2": f"with {_cooc(2)} select w, c, count(*)::bigint as n from co group by 1, 2",
    "cooccurrence_sweep": f"with {_cooc(10)} select win::integer as window, w, c, count(*)::bigint as n from co join (select unnest([1, 2, 5, 10]) as win) s on d <= win group by 1, 2, 3",
    "ppmi": f"with {_PPMI} select w, c, n, round(ppmi, 6) as ppmi from pp",
    "pair_scores_ppmi": f"with {_PPMI}, nv as (select word, row_number() over (order by word) - 1 as idx from voc), pr as (select x.word as w1, y.word as w2, (x.idx * 37 % 101)::double as human from nv x join nv y on y.idx = x.idx + 1), nm as (select w, sqrt(sum(ppmi * ppmi)) as norm from pp group by w), ds as (select w1, w2, sum(p.ppmi * q.ppmi) as dot from pr join pp p on p.w = w1 join pp q on q.w = w2 and q.c = p.c group by 1, 2) select w1, w2, human, round(coalesce(dot / nullif(x.norm * y.norm, 0), 0), 6) as score from pr left join ds using (w1, w2) left join nm x on x.w = w1 left join nm y on y.w = w2",
    "similar_words_raw": _similar_sql("n"),
    "similar_words_ppmi": _similar_sql("ppmi"),
    "rank_ends": f"with {_TDSIM}, bo as (select a, b, sim from sims union all select b, a, sim from sims), r as (select a, b, round(sim, 6) as sim, row_number() over (partition by a order by round(sim, 6) desc, b) as rank from bo) select * from r qualify rank <= 5 or rank > max(rank) over (partition by a) - 3",
    "group_pair_similarity": f"with {_VOC}, td as (select word, source || '/' || lang as doc, lang, count(*) as tf from tok where word in (select word from voc) group by 1, 2, 3), vec as (select doc as k, word as dim, tf::double as v from td), {_SIM}, g as (select distinct doc, lang from td) select least(x.lang, y.lang) as group_a, greatest(x.lang, y.lang) as group_b, round(avg(sim), 6) as mean_sim, count(*)::bigint as pairs from sims join g x on x.doc = a join g y on y.doc = b group by 1, 2",
    "char_vocab": f"with {_CH} select ch, id from cv",
    "char_encode": f"with {_CH}, e as (select doc_id, count(*)::bigint as n, md5(string_agg(id::varchar, ',' order by pos)) as ids_md5 from ch join cv using (ch) group by doc_id) select d.doc_id, coalesce(n, 0)::bigint as n, coalesce(ids_md5, md5('')) as ids_md5 from documents d left join e using (doc_id)",
    "char_decode": "select doc_id, md5(coalesce(text, '')) as text_md5 from documents",
    "train_val_split": f"with {_AT}, cut as (select floor(sum(size) * 0.9)::bigint as c from pl), t as (select doc_id, size, least(size, greatest(0, c - off)) as n_train from pl, cut) select doc_id, n_train::bigint as n_train, (size - n_train)::bigint as n_val from t",
    "char_blocks": f"with {_AT}, p as (select off, text, size, unnest(range(greatest(0, ceil((off - 64) / 64.0))::bigint, (off + size - 1) // 64 + 1)) * 64 as start from pl where size > 0), q as (select start, off, text, greatest(start - off, 0) as lo, start + 65 - off as hi from p), w as (select start, string_agg(substr(text, lo + 1, hi - lo), '' order by off) as w from q where lo < hi group by start) select start::bigint as start, md5(substr(w, 1, 64)) as x_md5, md5(substr(w, 2, 64)) as y_md5 from w where start <= (select sum(size) from pl) - 66",
    "uniform_cross_entropy": f"with {_CH}, f as (select ch, count(*) as n from ch group by ch) select count(*)::bigint as vocab_size, round(ln(count(*)), 6) as uniform, round(sum(-n / t * ln(n / t)), 6) as unigram from (select n::double as n, (sum(n) over ())::double as t from f)",
}
