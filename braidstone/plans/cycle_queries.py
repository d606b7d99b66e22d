"""Queries over a client's cycle, keyed tables and models, from the driver's tables by rule, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from braidstone.functions import paths, version_vectors as VV
from braidstone.operators import chars, cycle, models
from braidstone.plans.sync_queries import _N, _PLAN, _VV, _lines, _trees, _vectors, docs, events
from braidstone.sources import tables


def vv_relations(spark, d):
    v = _vectors(spark, d)
    a, b = F.col("a"), F.col("b")
    return v.select("key", VV.dominates(a, b).alias("dominates"), VV.concurrent_with(a, b).alias("concurrent"), F.array_join(VV.replicas(a), ",").alias("replicas"))


def sync_cycle(spark, d):
    """Both sides once a replica's passes have left nothing to do."""
    local, _, remote, _ = cycle.run_to_quiescence(*_trees(spark, d), "p", "2024-01-02 030405")
    side = lambda t, n: t.filter("kind <> 'deleted'").select("path", F.col("content_id").alias(n))
    return side(local, "local_cid").join(side(remote, "remote_cid"), "path", "full_outer").select("path", *(F.coalesce(c, F.lit("")).alias(c) for c in ("local_cid", "remote_cid")))


def move_steps(spark, d):
    """Six documents each form a chain of moves, every third six a ring."""
    i = F.col("doc_id")
    name = lambda c: F.concat(F.lit("f"), F.lpad(c.cast("string"), 9, "0"))
    ring = (F.floor(i / 6) % 3 == 0) & (i % 6 == 5)
    return cycle.move_steps(docs(spark, d).select(name(i).alias("source"), name(F.when(ring, i - 5).when(i % 6 == 5, i + 500_000_000).otherwise(i + 1)).alias("target")))


def trash_purge(spark, d):
    e = events(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    latest = e.agg(F.max("ts").alias("latest"))
    bin_ = e.filter("event_type = 'error'").select(F.col("event_id").alias("path"), F.when(F.col("event_id") % 9 > 0, F.col("ts")).alias("deleted_at")).join(F.broadcast(latest))
    return cycle.purge_trash(bin_, F.col("latest"), 10).select("path", "purge")


def empty_folders(spark, d):
    local, _, _ = _trees(spark, d)
    dirs = local.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct().withColumn("kind", F.lit("dir"))
    files = local.filter(~F.col("path").rlike("^(d[456]|m1)/")).select("path", "kind")
    return cycle.empty_folders(files.unionByName(dirs))


def upload_attempts(spark, d):
    n = _lines(spark, d)
    sent = n.filter("doc_id % 2 = 1 and doc_id % 5 > 0").select((F.col("doc_id") % 3 + 1).alias("attempt"), "chunk")
    return cycle.upload_attempts(n.filter("doc_id % 2 = 1"), n.filter("doc_id % 2 = 0"), sent)


def journal_pending(spark, d):
    i = F.col("event_id")
    event = F.when(i % 4 < 2, "add").when((i % 4 == 2) | (i % 7 > 0), "failed").otherwise("done")
    return tables.journal(events(spark, d).select((F.floor(i / 4)).alias("op_id"), i.alias("seq"), event.alias("event")))


def keyed_table(spark, d):
    e = events(spark, d).select("user_id", F.col("event_id").alias("version"), F.round("value", 6).alias("value"), (F.col("event_type") == "error").alias("deleted"))
    return tables.current(e, "user_id")


def hash_cache_hits(spark, d):
    """A scan of documents as files, one written each second; some changed since the cache was kept, the last ones just now."""
    i = F.col("doc_id")
    scan = docs(spark, d).select(i.cast("string").alias("path"), F.char_length("text").alias("size"), F.timestamp_seconds(i).alias("mtime"), F.md5("text").alias("content_id"))
    cache = scan.withColumn("size", F.when(F.col("path").cast("long") % 7 == 0, -1).otherwise(F.col("size"))).filter(F.col("path").cast("long") % 5 > 0)
    return tables.hash_cache(scan.drop("content_id"), cache, "1970-01-01 00:03:00").select("path", F.coalesce("cached_id", F.lit("")).alias("cached_id"))


def short_ids(spark, d):
    cid = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("b2:"), F.md5("text")))
    return docs(spark, d).select("doc_id", paths.short_id(cid).alias("short"))


def checked_paths(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat(F.lit("a/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"))
    return p.select("page_id", paths.check_safe(F.col("path")).alias("path"))


def backoff_bounds(spark, d):
    attempt = F.col("event_id") % 12
    wait = events(spark, d).select("event_id", attempt.alias("attempt"), paths.backoff(attempt, 7).alias("wait"))
    return wait.select("event_id", ((F.col("wait") >= 0) & (F.col("wait") < F.least(F.lit(60.0), F.pow(F.lit(2.0), F.col("attempt") - 1)))).alias("within"))


#: Five ids, two numbers for each, a state of two.
TANH = models.Recurrent(np.array([[((i * 7 + j) % 5 - 2) / 10 for j in range(2)] for i in range(5)]), np.array([[0.5, -0.3], [0.2, 0.4]]), np.array([[0.1, 0.6], [-0.5, 0.2]]), np.array([0.05, -0.05]), np.zeros((2, 5)), np.zeros(5))


def recurrent_states(spark, d):
    ids = F.transform(F.sort_array(F.collect_list("event_id")), lambda e: e % 5)
    rows = events(spark, d).groupBy("user_id").agg(ids.alias("ids"))
    out = models.last_states(rows, "user_id", "ids", TANH)
    return out.select("user_id", *(F.round(F.col("state")[k], 6).alias(f"h{k + 1}") for k in range(2)))


def _turns(spark, d):
    """Conversation turns as ids of their characters, and how many characters there are."""
    t = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    vocab = chars.char_vocabulary(t)
    return chars.encode(t, vocab), vocab.count()


def transformer_losses(spark, d):
    rows, v = _turns(spark, d)
    return models.losses(rows, "key", "ids", models.Transformer.random(v)).withColumn("loss", F.round("loss", 6))


def recurrent_losses(spark, d):
    rows, v = _turns(spark, d)
    return models.losses(rows, "key", "ids", models.Recurrent.random(v)).withColumn("loss", F.round("loss", 6))


def sampled_ids(spark, d):
    rows, v = _turns(spark, d)
    return models.continued(rows, "key", "ids", models.Transformer.random(v), 8, 0.8, seed=1).withColumn("drawn", F.array_join(F.col("drawn").cast("array<string>"), ","))


def random_blocks(spark, d):
    return chars.random_blocks(docs(spark, d), 64, 32, seed=1)


QUERIES = {f.__name__: f for f in (vv_relations, sync_cycle, move_steps, trash_purge, empty_folders, upload_attempts, journal_pending, keyed_table, hash_cache_hits, short_ids, checked_paths, backoff_bounds, recurrent_states, transformer_losses, recurrent_losses, sampled_ids, random_blocks)}

_LI = "li as (select doc_id, md5(line) as chunk from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents))"

ORACLES = {
    "vv_relations": f"with {_VV} select key, bool_and(a >= b) and not bool_and(b >= a) as dominates, not bool_and(a >= b) and not bool_and(b >= a) as concurrent, coalesce(string_agg(r, ',' order by r) filter (a > 0), '') as replicas from n group by key",
    "sync_cycle": f"""with {_PLAN},
e as (select path, case when op in ('PULL', 'CONFLICT_SPLIT') then rc when op in ('DELETE_LOCAL', 'DELETE_REMOTE') then null else lc end as lx, case when op = 'PUSH' then lc when op in ('DELETE_LOCAL', 'DELETE_REMOTE') then null else rc end as rx from o
  union all select path || ' (conflicted copy from p 2024-01-02 030405)', lc, lc from o where op = 'CONFLICT_SPLIT')
select path, coalesce(lx, '') as local_cid, coalesce(rx, '') as remote_cid from e where lx is not null or rx is not null""",
    "move_steps": """with i as (select distinct doc_id, doc_id // 6 as g, doc_id % 6 as p, max(doc_id % 6) over (partition by doc_id // 6) as m from documents),
s as (select *, 'f' || lpad(doc_id::varchar, 9, '0') as source, g % 3 = 0 and m = 5 as ring, case when p < 5 then doc_id + 1 when g % 3 = 0 then doc_id - 5 else doc_id + 500000000 end as t from i),
n as (select *, 'f' || lpad(t::varchar, 9, '0') as target from s)
select source, case when ring and p = 0 then '.staged-' || source else target end as target, case when ring then (6 - p) % 6 else m - p end::bigint as step from n
union all select '.staged-' || source, target, 6 from n where ring and p = 0""",
    "trash_purge": "select event_id as path, event_id % 9 > 0 and ts < (select max(ts) from events) - interval 10 day as purge from events where event_type = 'error'",
    "empty_folders": f"with {_N}, l as (select case when k = 6 then moved else folder end as path from n where k not in (3, 5, 8)), a as (select path, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda x: array_to_string(string_split(path, '/')[1:x], '/'))) as dir from l) select distinct dir as path from a where dir not in (select dir from a where not regexp_matches(path, '^(d[456]|m1)/'))",
    "upload_attempts": f"with {_LI}, need as (select distinct chunk from li where doc_id % 2 = 1 and chunk not in (select chunk from li where doc_id % 2 = 0)), s as (select doc_id % 3 + 1 as attempt, chunk from li where doc_id % 2 = 1 and doc_id % 5 > 0), c as (select chunk, min(attempt) as attempt from s where chunk in (select chunk from need) group by 1), x as (select attempt, count(*)::bigint as n, (select count(*) from c where c.attempt = s.attempt)::bigint as arrived from s group by 1) select attempt, arrived, n - arrived as wasted, ((select count(*) from need) - sum(arrived) over (order by attempt))::bigint as left from x",
    "journal_pending": "with j as (select event_id // 4 as op_id, event_id as seq, case when event_id % 4 < 2 then 'add' when event_id % 4 = 2 or event_id % 7 > 0 then 'failed' else 'done' end as event from events) select op_id, min(seq) filter (event = 'add') as seq, count(*) filter (event = 'failed') as attempts from j group by 1 having count(*) filter (event = 'done') = 0 and count(*) filter (event = 'add') > 0",
    "keyed_table": "select user_id, round(value, 6) as value from (select *, row_number() over (partition by user_id order by event_id desc) as i from events) where i = 1 and event_type <> 'error'",
    "hash_cache_hits": "select doc_id::varchar as path, case when doc_id % 5 > 0 and doc_id % 7 > 0 and doc_id < 178 then md5(coalesce(text, '')) else '' end as cached_id from documents",
    "short_ids": "select doc_id, case when doc_id % 4 > 0 then substr(md5(coalesce(text, '')), 1, 8) else '-' end as short from documents",
    "checked_paths": "select page_id, 'a/' || page_id || '.html' as path from pages",
    "backoff_bounds": "select event_id, true as within from events",
    "recurrent_states": """with recursive e as (select user_id, row_number() over (partition by user_id order by event_id) as i, event_id % 5 as t from events),
x as (select user_id, i, (t * 7 % 5 - 2) / 10.0 as a, ((t * 7 + 1) % 5 - 2) / 10.0 as b from e),
s(user_id, i, p, q) as (select distinct user_id, 0::bigint, 0::double, 0::double from e union all
  select x.user_id, x.i, tanh((0.5 * a + 0.2 * b + 0.05)::double + 0.1::double * p - 0.5::double * q), tanh((-0.3 * a + 0.4 * b - 0.05)::double + 0.6::double * p + 0.2::double * q) from s join x on x.user_id = s.user_id and x.i = s.i + 1)
select user_id, round(arg_max(p, i), 6) as h1, round(arg_max(q, i), 6) as h2 from s group by user_id""",
}
