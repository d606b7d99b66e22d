"""Vector queries over embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidstone.functions.staging import stage
from braidstone.functions.vectors import doubles, layer_norm, linear, norm, relu
from braidstone.operators import chars, embeddings
from braidstone.plans.text_queries import r6

#: Items of a target and places of a sequence, by id.
TARGET, SEQUENCE = 50, 8
ANALOGIES = [(i, 3 * i, 3 * i + 1, 3 * i + 2) for i in range(6)]


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def items(spark, d):
    return vectors(spark, d).withColumns({"target": F.floor(F.col("vec_id") / TARGET), "guess": F.floor(F.col("vec_id") * 7 % 50 / 10)})


def vector_norms(spark, d):
    return r6(vectors(spark, d).select("vec_id", norm(doubles(F.col("embedding"))).alias("norm")), "norm")


def knn_top10(spark, d):
    v = vectors(spark, d)
    return r6(embeddings.neighbours(v, v.filter("vec_id % 20 = 0")), "sim")


def analogy_top5(spark, d):
    asked = spark.createDataFrame(ANALOGIES, "analogy long, a long, a_star long, b long")
    return r6(embeddings.analogies(vectors(spark, d), asked), "sim")


def answer_check(spark, d):
    """Odd analogies expect the second answer; one analogy asks for a vector that is not there."""
    asked = spark.createDataFrame([*ANALOGIES, (6, -1, 1, 2)], "analogy long, a long, a_star long, b long")
    found = stage(embeddings.analogies(vectors(spark, d), asked).select("analogy", F.concat(F.lit("Vec"), "vec_id").alias("answer"), "rank"), "answers")
    expected = found.filter(F.col("rank") == 1 + F.col("analogy") % 2).select("analogy", F.upper("answer").alias("expected"))
    return embeddings.checked_answers(found, expected.unionByName(spark.createDataFrame([(6, "none")], "analogy long, expected string")))


def centroids(spark, d):
    return r6(embeddings.centroids(vectors(spark, d)).withColumn("pos", F.col("pos").cast("long")), "mean")


def bias_scores(spark, d):
    v = vectors(spark, d)
    return r6(embeddings.bias(v, v.filter("label = 0"), v.filter("label = 1")), "score")


def _pairs(spark, d):
    v = vectors(spark, d)
    return embeddings.pair_scores(v.select(F.col("vec_id").alias("w1"), (F.col("vec_id") + 1).alias("w2"), (F.col("vec_id") * 37 % 101).cast("double").alias("human")), v)


def pair_scores(spark, d):
    return r6(_pairs(spark, d), "score")


def kendall_tau(spark, d):
    return r6(embeddings.kendall_tau_b(_pairs(spark, d), "human", "score", "w1"), "tau")


def silhouette(spark, d):
    return r6(embeddings.silhouette(items(spark, d), "target", "label"), "silhouette")


def paired_fscore(spark, d):
    return r6(embeddings.paired_fscore(items(spark, d), "target", "guess", "label"), "precision", "recall", "fscore")


def _scored(found, spark, d):
    gold = items(spark, d).select("vec_id", "label")
    f = embeddings.paired_fscore(found.join(gold, "vec_id"), "target", "predicted", "label")
    return found.select("target", "k").distinct().join(f, "target")


def kmeans_gold_k(spark, d):
    return r6(_scored(embeddings.kmeans(items(spark, d), "target"), spark, d), "precision", "recall", "fscore")


def _sparse(spark, d):
    """Large components as cells; every seventh vector has none."""
    v = vectors(spark, d)
    cells = v.filter("vec_id % 7 > 0").select(F.col("vec_id").alias("name"), F.posexplode(doubles(F.col("embedding"))).alias("dim", "value")).filter("value > 0.1")
    return embeddings.sparse_vectors(v.select(F.col("vec_id").alias("name")), cells, 64).select(F.col("name").alias("vec_id"), F.col("vec").alias("embedding"))


def sparse_vectors(spark, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return r6(_sparse(spark, d).select("vec_id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nnz"), total.alias("total")), "total")


def kmeans_sparse(spark, d):
    return r6(_scored(embeddings.kmeans(items(spark, d).drop("embedding").join(_sparse(spark, d), "vec_id"), "target"), spark, d), "precision", "recall", "fscore")


def kmeans_auto_k(spark, d):
    return r6(_scored(embeddings.kmeans(items(spark, d), "target", auto=True), spark, d), "precision", "recall", "fscore")


def causal_attention(spark, d):
    rows = vectors(spark, d).withColumns({"seq": F.floor(F.col("vec_id") / SEQUENCE), "pos": F.col("vec_id") % SEQUENCE})
    return r6(chars.causal_attention(rows, "seq", "pos", "embedding").withColumn("dim", F.col("dim").cast("long")), "value")


def multi_head_attention(spark, d):
    rows = vectors(spark, d).withColumns({"seq": F.floor(F.col("vec_id") / SEQUENCE), "pos": F.col("vec_id") % SEQUENCE})
    return r6(chars.multi_head_attention(rows, "seq", "pos", "embedding", 4).withColumn("dim", F.col("dim").cast("long")), "value")


def feed_forward(spark, d):
    """Layer norm, then the first two numbers of a widening linear map, then ReLU."""
    weights = [[((i * 7 + j) % 5 - 2) / 10 for j in range(64)] for i in range(2)]
    normed = vectors(spark, d).select("vec_id", layer_norm(doubles(F.col("embedding"))).alias("z"))
    out = normed.select("vec_id", relu(linear(F.col("z"), weights, [0.1, -0.1])).alias("o"))
    return r6(out.select("vec_id", F.col("o")[0].alias("x"), F.col("o")[1].alias("y")), "x", "y")


def target_cross_entropy(spark, d):
    logits = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", "event_type").agg((F.avg("value") / 10).alias("logit"))
    return r6(chars.target_cross_entropy(logits, "user_id", "logit", F.col("event_type") == "click"), "loss")


def _compared(spark, d):
    rows = items(spark, d).withColumn("other", F.floor(F.col("vec_id") * 3 % 50 / 10))
    return embeddings.compare_scores(embeddings.paired_fscore(rows, "target", "guess", "label"), embeddings.paired_fscore(rows, "target", "other", "label"), "target")


def score_comparison(spark, d):
    return r6(_compared(spark, d), "sparse", "dense")


def score_summary(spark, d):
    return r6(embeddings.score_summary(_compared(spark, d)), "mean_sparse", "mean_dense")


def temperature_softmax(spark, d):
    logits = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", "event_type").agg((F.avg("value") / 10).alias("logit"))
    return r6(chars.softmax(logits, "user_id", "logit", 0.8), "logit", "p")


QUERIES = {f.__name__: f for f in (vector_norms, knn_top10, analogy_top5, answer_check, sparse_vectors, kmeans_sparse, centroids, bias_scores, pair_scores, kendall_tau, silhouette, paired_fscore, kmeans_gold_k, kmeans_auto_k, causal_attention, temperature_softmax, multi_head_attention, feed_forward, target_cross_entropy, score_comparison, score_summary)}

_V = "v as (select vec_id, embedding::double[] as e, label from embeddings)"
_ITEMS = f"{_V}, it as (select *, vec_id // 50 as target, (vec_id * 7 % 50) // 10 as guess from v)"
_PAIRS = f"{_V}, ps as (select x.vec_id as w1, y.vec_id as w2, (x.vec_id * 37 % 101)::double as human, list_cosine_similarity(x.e, y.e) as score from v x join v y on y.vec_id = x.vec_id + 1)"
_CENT = "ce as (select label, list(m order by pos) as c from (select label, pos, avg(x) as m from (select label, unnest(e) as x, unnest(range(0, len(e))) as pos from v) group by 1, 2) group by label)"



def _fscore(guess: str) -> str:
    return f"(select target, case when tp > 0 then 2 * (tp / pp) * (tp / gp) / (tp / pp + tp / gp) else 0 end as f from (select x.target, count(*) filter (x.{guess} = y.{guess} and x.label = y.label) as tp, count(*) filter (x.{guess} = y.{guess}) as pp, count(*) filter (x.label = y.label) as gp from it2 x join it2 y on x.target = y.target and x.vec_id < y.vec_id group by 1))"


_COMPARED = f"{_ITEMS}, it2 as (select *, (vec_id * 3 % 50) // 10 as other from it), cmp as (select a.target, a.f as sparse, b.f as dense, case when a.f > b.f then 'sparse' when b.f > a.f then 'dense' else 'tie' end as winner from {_fscore('guess')} a join {_fscore('other')} b using (target))"

ORACLES = {
    "multi_head_attention": f"with {_V}, r as (select (vec_id // 8) as seq, vec_id % 8 as pos, h, e[16 * h + 1 : 16 * h + 16] as e from v, range(0, 4) t(h)), s as (select q.seq, q.pos, q.h, k.e, list_inner_product(q.e, k.e) / 4.0 as s from r q join r k on q.seq = k.seq and q.h = k.h and k.pos <= q.pos), x as (select *, exp(s - max(s) over (partition by seq, pos, h)) as ex from s), w as (select seq, pos, h, e, ex / sum(ex) over (partition by seq, pos, h) as w from x) select seq, pos, (16 * h + i)::bigint as dim, round(sum(w * x), 6) as value from (select seq, pos, h, w, unnest(e) as x, unnest(range(0, 16)) as i from w) group by 1, 2, 3",
    "feed_forward": f"with {_V}, m as (select vec_id, e, list_avg(e) as mu from v), n as (select vec_id, list_transform(e, lambda x: (x - mu) / sqrt(list_avg(list_transform(e, lambda y: (y - mu) * (y - mu))) + 1e-5)) as z from m) select vec_id, round(greatest(0.0, list_sum(list_transform(range(1, 65), lambda j: z[j] * ((j - 1) % 5 - 2) / 10)) + 0.1), 6) as x, round(greatest(0.0, list_sum(list_transform(range(1, 65), lambda j: z[j] * ((7 + j - 1) % 5 - 2) / 10)) - 0.1), 6) as y from n",
    "target_cross_entropy": "with l as (select user_id, event_type, avg(value) / 10 as logit from events group by 1, 2), g as (select ln(sum(exp(logit))) - max(logit) filter (event_type = 'click') as loss from l group by user_id) select count(*)::bigint as rows, round(avg(loss), 6) as loss from g where loss is not null",
    "score_comparison": f"with {_COMPARED} select target, round(sparse, 6) as sparse, round(dense, 6) as dense, winner from cmp",
    "score_summary": f"with {_COMPARED} select count(*)::bigint as targets, round(avg(sparse), 6) as mean_sparse, round(avg(dense), 6) as mean_dense, count(*) filter (winner = 'sparse') as wins_sparse, count(*) filter (winner = 'dense') as wins_dense, count(*) filter (winner = 'tie') as ties from cmp",
    "vector_norms": f"with {_V} select vec_id, round(sqrt(list_inner_product(e, e)), 6) as norm from v",
    "knn_top10": f"with {_V}, s as (select q.vec_id as query_id, v.vec_id, list_cosine_similarity(q.e, v.e) as sim from v q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0) select query_id, vec_id, round(sim, 6) as sim, rank from (select *, row_number() over (partition by query_id order by round(sim, 6) desc, vec_id) as rank from s) where rank <= 10",
    "analogy_top5": f"with {_V}, g as (select unnest(range(0, 6)) as analogy), t as (select g.analogy, a.vec_id as a, s.vec_id as a_star, b.vec_id as b, list_transform(range(1, 65), lambda i: b.e[i] - a.e[i] + s.e[i]) as t from g join v a on a.vec_id = 3 * analogy join v s on s.vec_id = 3 * analogy + 1 join v b on b.vec_id = 3 * analogy + 2), s as (select analogy, vec_id, list_cosine_similarity(e, t) as sim from t join v on vec_id not in (a, a_star, b)) select analogy, vec_id, round(sim, 6) as sim, rank from (select *, row_number() over (partition by analogy order by round(sim, 6) desc, vec_id) as rank from s) where rank <= 5",
    "centroids": f"with {_V} select label, pos::bigint as pos, round(avg(x), 6) as mean from (select label, unnest(e) as x, unnest(range(0, len(e))) as pos from v) group by 1, 2",
    "bias_scores": f"with {_V}, {_CENT}, s as (select vec_id, list_cosine_similarity(e, (select c from ce where label = 0)) - list_cosine_similarity(e, (select c from ce where label = 1)) as score from v) select vec_id, round(score, 6) as score, case when score > 0.05 then 'FEMALE' when score < -0.05 then 'MALE' else 'neutral' end as direction from s",
    "pair_scores": f"with {_PAIRS} select w1, w2, human, round(score, 6) as score from ps",
    "kendall_tau": f"with {_PAIRS}, l as (select * from ps) select round(sum(sign(p.human - q.human) * sign(p.score - q.score)) / sqrt(sum(abs(sign(p.human - q.human)))::double * sum(abs(sign(p.score - q.score)))::double), 6) as tau from l p join l q on p.w1 < q.w1",
    "silhouette": f"with {_ITEMS}, dd as (select x.target, x.vec_id as i, x.label as li, y.label as lj, list_distance(x.e, y.e) as d from it x join it y on x.target = y.target and x.vec_id <> y.vec_id), m as (select target, i, li, lj, avg(d) as m from dd group by all), s as (select target, i, max(m) filter (li = lj) as a, min(m) filter (li <> lj) as b from m group by 1, 2) select target, round(avg(case when a is null or b is null then 0.0 else (b - a) / greatest(a, b) end), 6) as silhouette from s group by target",
    "paired_fscore": f"with {_ITEMS}, two as (select x.target, x.guess = y.guess as p, x.label = y.label as g from it x join it y on x.target = y.target and x.vec_id < y.vec_id), c as (select target, count(*) filter (p and g) as tp, count(*) filter (p) as pp, count(*) filter (g) as gp from two group by target) select target, round(case when pp > 0 then tp / pp else 0 end, 6) as precision, round(case when gp > 0 then tp / gp else 0 end, 6) as recall, round(case when tp > 0 then 2 * (tp / pp) * (tp / gp) / (tp / pp + tp / gp) else 0 end, 6) as fscore from c",
    "causal_attention": f"with {_V}, r as (select vec_id // 8 as seq, vec_id % 8 as pos, e from v), s as (select q.seq, q.pos, k.e, list_inner_product(q.e, k.e) / 8.0 as s from r q join r k on q.seq = k.seq and k.pos <= q.pos), x as (select *, exp(s - max(s) over (partition by seq, pos)) as ex from s), w as (select seq, pos, e, ex / sum(ex) over (partition by seq, pos) as w from x) select seq, pos, dim::bigint as dim, round(sum(w * x), 6) as value from (select seq, pos, w, unnest(e) as x, unnest(range(0, len(e))) as dim from w) group by 1, 2, 3",
    "temperature_softmax": "with l as (select user_id, event_type, avg(value) / 10 as logit from events group by 1, 2), x as (select *, exp(logit / 0.8 - max(logit / 0.8) over (partition by user_id)) as ex from l) select user_id, event_type, round(logit, 6) as logit, round(ex / sum(ex) over (partition by user_id), 6) as p from x",
}
ORACLES["answer_check"] = f"with r as ({ORACLES['analogy_top5']}), x as (select analogy, max(vec_id) filter (rank = 1) as a, max(vec_id) filter (rank = 1 + analogy % 2) as e from r group by 1) select analogy, 'Vec' || a as answer, 'VEC' || e as expected, a = e as correct from x union all select 6, 'N/A', 'none', false"
ORACLES["sparse_vectors"] = f"with {_V}, l as (select vec_id, case when vec_id % 7 > 0 then list_filter(e, lambda x: x > 0.1) else [] end as s from v) select vec_id, len(s)::bigint as nnz, round(coalesce(list_sum(s), 0), 6) as total from l"
