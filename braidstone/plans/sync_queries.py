"""Replica queries over trees, commits and paths made from the driver's tables by rule, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidstone.functions import paths, version_vectors as VV
from braidstone.operators import content, sync


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _vectors(spark, d):
    """Two vectors for each of 150 keys: counters of five replicas from events with even and odd ids."""
    e = events(spark, d).select(F.col("user_id").alias("key"), F.concat(F.lit("r"), F.col("event_id") % 5).alias("r"), (F.col("event_id") % 2).alias("side"))
    n = e.filter("not (side = 1 and key % 3 = 0 and r = 'r4')").groupBy("key", "side", "r").count()
    side = lambda s: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("r", "count")))))
    return n.groupBy("key").agg(side(0).alias("a"), side(1).alias("b"))


def vv_compare(spark, d):
    v = _vectors(spark, d)
    return v.select("key", VV.compare(F.col("a"), F.col("b")).alias("relation"), VV.compare(VV.merge(F.col("a"), F.col("b")), F.col("a")).alias("merged_to_a"))


def vv_merge(spark, d):
    v = _vectors(spark, d)
    return v.select("key", VV.to_json(VV.merge(F.col("a"), F.col("b"))).alias("merged"), VV.to_json(VV.bump(F.col("a"), F.lit("r0"))).alias("bumped"))


def _trees(spark, d):
    """local, base and remote: each document is a file; by id it is edited, deleted, moved or missing on a side."""
    n, i = docs(spark, d), F.col("doc_id")
    folder = F.concat(F.lit("d"), i % 7, F.lit("/f"), i.cast("string"))
    moved = F.concat(F.lit("m"), i % 3, F.lit("/sub/f"), i.cast("string"))
    cid, edited, other = F.md5("text"), F.md5(F.concat("text", F.lit("+l"))), F.md5(F.concat("text", F.lit("+r")))
    row = lambda df, path, c, kind, **more: df.select(path.alias("path"), kind.alias("kind"), c.alias("content_id"), F.lit(False).alias("executable"), *(v.alias(k) for k, v in more.items()))
    file = F.lit("file")
    local = row(n.filter(~(i % 11).isin(3, 5, 8)), F.when(i % 11 == 6, moved).otherwise(folder), F.when((i % 11).isin(1, 4, 9), edited).otherwise(cid), file)
    p1, q1 = F.create_map(F.lit("p"), F.lit(1).cast("bigint")), F.create_map(F.lit("p"), F.lit(1).cast("bigint"), F.lit("q"), F.lit(1).cast("bigint"))
    base = row(n.filter(i % 11 != 7), folder, cid, file, vv=p1)
    changed = (i % 11).isin(2, 4, 5, 8, 9)
    gone = (i % 11 == 8) | ((i % 11 == 2) & (i % 2 == 0)) | ((i % 11 == 9) & (i % 3 == 0))
    remote = row(n.filter(i % 11 != 10), folder, F.when(~gone, F.when((i % 11 == 4) & (i % 2 == 0), edited).when(changed, other).otherwise(cid)), F.when(gone, "deleted").otherwise("file"), vv=F.when(changed, q1).otherwise(p1))
    return local, base, remote


def reconcile_plan(spark, d):
    return sync.reconcile(*_trees(spark, d)).select("path", "op")


def reconcile_moves(spark, d):
    return sync.detect_moves(sync.reconcile(*_trees(spark, d))).select("path", "op", F.coalesce("from_path", F.lit("")).alias("from_path"))


def plan_order(spark, d):
    return sync.plan_order(sync.detect_moves(sync.reconcile(*_trees(spark, d)))).select("path", "op", F.col("phase").cast("long").alias("phase"), F.col("level").cast("long").alias("level"))


def _requests(spark, d):
    e, i = events(spark, d), F.col("event_id")
    path = F.concat(F.lit("p"), F.col("user_id") % 50)
    vv = F.create_map(F.lit("a"), F.floor(i / 97), F.lit("b"), F.floor(i * 7 % 1000 / 250), F.lit("c"), i * 3 % 4)
    kind = F.when(F.col("event_type") == "error", "deleted").otherwise("file")
    return e.select(path.alias("path"), i.alias("arrival"), F.concat(path, F.lit("-"), F.floor(i / 3).cast("string")).alias("op_id"), kind.alias("kind"), (F.col("user_id") % 13).cast("string").alias("content_id"), F.concat(F.lit("u"), F.col("user_id") % 5).alias("replica"), vv.alias("vv"))


def cas_commit(spark, d):
    known = spark.range(12).select(F.col("id").cast("string").alias("content_id"))
    return sync.cas_commit(_requests(spark, d), known).select("path", "arrival", "op_id", "status", F.coalesce("seq", F.lit(-1)).alias("seq"))


def _log(spark, d):
    return _requests(spark, d).select("path", F.col("arrival").alias("seq"), "kind", "replica")


def change_feed(spark, d):
    return sync.change_feed(_log(spark, d), cursor=100, limit=40)


def min_cursor_gc(spark, d):
    log = _log(spark, d)
    cursors = sync.latest_cursors(log.select("replica", (F.col("seq") - 500).alias("cursor"), F.col("seq").alias("arrival")))
    return sync.collect_tombstones(log.filter("kind = 'deleted'").groupBy("path").agg(F.max("seq").alias("seq")).withColumn("kind", F.lit("deleted")), cursors).select("path", "seq")


def _lines(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", F.md5("line").alias("chunk"), F.octet_length("line").cast("long").alias("size"))


def chunk_dedup(spark, d):
    """Even documents' lines against those of the document before."""
    n = _lines(spark, d)
    group = F.floor(F.col("doc_id") / 2).alias("grp")
    a, b = n.filter("doc_id % 2 = 0").select(group, "chunk", "size"), n.filter("doc_id % 2 = 1").select(group, "chunk", "size")
    return sync.chunk_similarity(a, b, "grp")


def have_need(spark, d):
    n = _lines(spark, d)
    return sync.missing_chunks(n.filter("doc_id % 2 = 1"), n.filter("doc_id % 2 = 0"))


def convergence_check(spark, d):
    n = docs(spark, d).select(F.explode(F.array(F.lit("p"), F.lit("q"), F.lit("r"))).alias("replica"), F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("content_id"))
    odd = n.withColumn("content_id", F.when((F.col("replica") == "r") & (F.col("path") == "7"), F.lit("x")).otherwise(F.col("content_id")))
    name = lambda df, x: sync.converged(df).withColumn("tree", F.lit(x))
    return name(n, "alike").unionByName(name(odd, "edited"))


def cdc_chunks(spark, d):
    return content.chunk_rows(docs(spark, d).select(F.col("doc_id").cast("string").alias("file"), F.col("text").cast("binary").alias("data"))).select("file", "pos", "chunk", "size")


def content_ids(spark, d):
    return docs(spark, d).select("doc_id", content.content_ids(F.col("text").cast("binary")).alias("content_id"))


def op_ids(spark, d):
    r = _requests(spark, d)
    return r.select("arrival", content.op_ids("replica", "kind", "path", F.when(F.col("kind") == "file", F.col("content_id")), VV.to_json(F.col("vv"))).alias("op_id"))


def three_way_merge(spark, d):
    t, line = docs(spark, d), F.col("text")
    rows = t.select("doc_id", line.alias("base"), F.concat(F.lit("mine\n"), line).alias("mine"), F.concat(line, F.when(F.col("doc_id") % 2 == 0, F.lit("\ntheirs\n")).otherwise(F.lit(""))).alias("theirs"))
    return content.merge_rows(rows, "doc_id").select("doc_id", F.md5("merged").alias("merged_md5"), "clean", "regions")


def path_safety(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    odd = F.when(F.col("page_id") % 5 == 1, F.concat(F.lit("../"), "path")).when(F.col("page_id") % 5 == 2, F.concat("path", F.lit("/CON.txt"))).when(F.col("page_id") % 5 == 3, F.concat("path", F.lit(" "))).otherwise(F.col("path"))
    return p.withColumn("path", odd).select("page_id", "path", paths.is_safe(F.col("path")).alias("safe"))


def path_parts(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    return p.select("page_id", paths.parent_of(F.col("path")).alias("parent"), paths.depth(F.col("path")).cast("long").alias("depth"), F.array_join(paths.ancestors(F.col("path")), "|").alias("ancestors"))


def conflict_names(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat(F.regexp_replace("url", "^https?://", ""), F.when(F.col("page_id") % 2 == 0, F.lit("/a.b.txt")).otherwise(F.lit("/.rc"))).alias("path"))
    return p.select("page_id", paths.conflict_name(F.col("path"), F.lit("p"), F.lit("2024-01-02 030405"), F.col("page_id") % 3).alias("name"))


def text_sniff(spark, d):
    i, raw = F.col("doc_id"), F.col("text").cast("binary")
    data = F.when(i % 3 == 0, F.concat(raw, F.unhex(F.lit("00")))).when(i % 3 == 1, F.concat(F.unhex(F.lit("FF")), raw)).otherwise(raw)
    return docs(spark, d).select("doc_id", paths.looks_like_text(data).alias("is_text"))


def debounced_events(spark, d):
    b = sync.debounce(events(spark, d), "user_id", "ts", 3600.0, 5)
    return b.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n", "rescan")


def _contents(spark, d):
    return docs(spark, d).select(F.col("doc_id").cast("string").alias("file"), F.col("text").cast("binary").alias("data"))


def reassembled(spark, d):
    """Each document cut into chunks, put together and verified; every 50th is said to have another id."""
    files = _contents(spark, d)
    rows = content.chunk_rows(files)
    whole = sync.reassemble(rows.select("file", "pos", "chunk"), rows.select("chunk", "data").dropDuplicates(["chunk"]))
    said = files.select("file", F.when(F.col("file").cast("long") % 50 == 0, "b2:0").otherwise(content.content_ids(F.col("data"))).alias("content_id"))
    return sync.verified(whole, said).select("file", F.md5("data").alias("md5"), "intact")


def complete_manifests(spark, d):
    """Manifests of lines against a store that has the even documents' lines."""
    n = _lines(spark, d).withColumn("file", F.col("doc_id"))
    return sync.complete_manifests(n, n.filter("doc_id % 2 = 0"))


def accepted_chunks(spark, d):
    """Uploads of whole documents under their ids, every third under a wrong one; the store has those of ids under 100."""
    up = _contents(spark, d).withColumn("chunk", F.when(F.col("file").cast("long") % 3 == 0, "b2:0").otherwise(content.content_ids(F.col("data"))))
    return sync.accepted_chunks(up, up.filter("file < 100")).select(F.md5("data").alias("md5"))


def live_paths(spark, d):
    return sync.live_paths(_log(spark, d))


def feed_pages(spark, d):
    return sync.feed_pages(_log(spark, d), cursor=100, limit=7)


def next_vectors(spark, d):
    v = _vectors(spark, d).select("key", F.col("a").alias("base_vv"), F.when(F.col("key") % 4 > 0, F.col("b")).alias("remote_vv"))
    return sync.next_vectors(v, "r1").select("key", VV.to_json(F.col("next_vv")).alias("next_vv"))


def commit_effects(spark, d):
    done = sync.commit_effects(cas_commit(spark, d))
    return done.groupBy("status", "to_remote", "to_base", "journal", "pass_again").agg(F.count(F.lit(1)).alias("n"))


def merge_outcomes(spark, d):
    t, line = docs(spark, d), F.col("text")
    base = F.when(F.col("doc_id") % 7 > 0, line)
    rows = t.select("doc_id", base.alias("base"), F.concat(F.lit("mine\n"), line).alias("mine"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("theirs\n"), F.substring(line, 2, 1 << 30))).otherwise(F.concat(line, F.lit(""))).alias("theirs"))
    return content.merge_outcome(content.merge_rows(rows, "doc_id")).select("doc_id", "op")


def result_counters(spark, d):
    return cas_commit(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


def link_counters(spark, d):
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "up").when(i % 3 == 1, "down").otherwise("commit")
    outcome = F.when(i % 7 == 0, "lost").when(i % 11 == 0, "offline").otherwise("ok")
    return sync.link_counters(events(spark, d).select((F.col("user_id") % 5).alias("replica"), kind.alias("kind"), outcome.alias("outcome"), (i % 1000).alias("bytes")))


QUERIES = {f.__name__: f for f in (link_counters, vv_compare, vv_merge, reconcile_plan, reconcile_moves, plan_order, cas_commit, change_feed, min_cursor_gc, chunk_dedup, have_need, convergence_check, cdc_chunks, content_ids, op_ids, three_way_merge, path_safety, path_parts, conflict_names, text_sniff, debounced_events, result_counters, reassembled, complete_manifests, accepted_chunks, live_paths, feed_pages, next_vectors, commit_effects, merge_outcomes)}

_VV = """n as (select user_id as key, 'r' || (event_id % 5) as r, count(*) filter (event_id % 2 = 0) as a, count(*) filter (event_id % 2 = 1 and not (user_id % 3 = 0 and event_id % 5 = 4)) as b from events group by 1, 2)"""
_N = "n as (select doc_id, doc_id % 11 as k, coalesce(text, '') as text, md5(coalesce(text, '')) as cid, md5(coalesce(text, '') || '+l') as el, md5(coalesce(text, '') || '+r') as er, 'd' || (doc_id % 7) || '/f' || doc_id as folder, 'm' || (doc_id % 3) || '/sub/f' || doc_id as moved from documents)"
_PLAN = f"""{_N},
l as (select case when k = 6 then moved else folder end as path, case when k in (1, 4, 9) then el else cid end as c from n where k not in (3, 5, 8)),
b as (select folder as path, cid as c from n where k <> 7),
r0 as (select *, k in (2, 4, 5, 8, 9) as changed, k = 8 or (k = 2 and doc_id % 2 = 0) or (k = 9 and doc_id % 3 = 0) as gone from n where k <> 10),
r as (select folder as path, case when gone then null when k = 4 and doc_id % 2 = 0 then el when changed then er else cid end as c, gone, changed from r0),
j as (select path, l.c as lc, b.c as bc, r.c as rc, b.path is not null as inb, r.path is not null as inr, coalesce(r.gone, false) as gone,
   l.c is distinct from b.c as lchg, coalesce(r.changed or b.path is null, false) as rchg
   from (select path from l union select path from b union select path from r) p left join l using (path) left join b using (path) left join r using (path)),
o as (select *, case when not lchg and not rchg then null
   when lchg and not rchg then case when lc is null then 'DELETE_REMOTE' else 'PUSH' end
   when not lchg then case when gone then case when lc is null then 'CONVERGE' else 'DELETE_LOCAL' end else 'PULL' end
   when lc is not distinct from rc then 'CONVERGE' when lc is null then 'PULL' when rc is null then 'PUSH' else 'CONFLICT_SPLIT' end as op from j),
plan as (select * from o where op is not null)"""
_MOVES = f"""{_PLAN},
mv as (select c.path, 'MOVE_REMOTE' as move, d.from_path from (select bc as cid, max(path) as from_path from plan where op = 'DELETE_REMOTE' group by 1) d join (select lc as cid, min(path) as path from plan where op = 'PUSH' and not inb and not inr group by 1) c using (cid)
  union all select c.path, 'MOVE_LOCAL', d.from_path from (select lc as cid, max(path) as from_path from plan where op = 'DELETE_LOCAL' group by 1) d join (select rc as cid, min(path) as path from plan where op = 'PULL' and not inb group by 1) c using (cid)),
moved as (select plan.path, coalesce(move, op) as op, coalesce(from_path, '') as from_path from plan left join mv using (path) where plan.path not in (select from_path from mv))"""
_REQ = "q as (select 'p' || (user_id % 50) as path, event_id as arrival, 'p' || (user_id % 50) || '-' || (event_id // 3) as op_id, case when event_type = 'error' then 'deleted' else 'file' end as kind, user_id % 13 as cid, 'u' || (user_id % 5) as replica, event_id // 97 as a, (event_id * 7 % 1000) // 250 as b, event_id * 3 % 4 as c from events)"
_CAS = f"""{_REQ}, s as (select *, row_number() over (partition by path order by arrival) as i, kind = 'file' and cid > 11 as lacks from q),
f(path, i, arrival, op_id, status, ca, cb, cc, done) as (
  select path, 0::bigint, null::bigint, null::varchar, null::varchar, 0::bigint, 0::bigint, 0::bigint, []::varchar[] from s group by path
  union all
  select path, i, arrival, op_id, st, case when st = 'ok' then a else ca end, case when st = 'ok' then b else cb end, case when st = 'ok' then c else cc end,
    case when st = 'ok' then list_append(done[-5:], op_id) else done end
  from (select s.*, ca, cb, cc, done, case when list_contains(done, s.op_id) then 'replay' when lacks then 'missing' when a < ca or b < cb or c < cc then 'conflict' else 'ok' end as st
    from f join s on s.path = f.path and s.i = f.i + 1)),
res as (select path, arrival, op_id, status, case when status = 'ok' then sum(case when status = 'ok' then 1 else 0 end) over (order by arrival) else -1 end::bigint as seq from f where i > 0)"""
_LINES = "li as (select doc_id, md5(line) as chunk, strlen(line)::bigint as size from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents))"
_PG = r"pg as (select page_id, regexp_replace(url, '^https?://', '') as path from pages)"
_RES = "con|prn|aux|nul|com[1-9]|lpt[1-9]"

ORACLES = {
    "reassembled": "select doc_id::varchar as file, md5(coalesce(text, '')) as md5, doc_id % 50 <> 0 as intact from documents where coalesce(text, '') <> ''",
    "complete_manifests": f"with {_LINES}, s as (select distinct chunk, 1 as has from li where doc_id % 2 = 0) select doc_id as file, count(*)::bigint as chunks, (count(*) - count(has))::bigint as lacking, count(*) = count(has) as complete from li left join s using (chunk) group by 1",
    "accepted_chunks": "with u as (select doc_id, md5(coalesce(text, '')) as md5 from documents where doc_id % 3 <> 0) select distinct md5 from u where md5 not in (select md5 from u where doc_id < 100)",
    "live_paths": f"with {_REQ}, t as (select path, arg_max(kind, arrival) as kind from q group by path) select path from t where kind <> 'deleted'",
    "feed_pages": f"with {_REQ}, t as (select path, max(arrival) as seq, arg_max(kind, arrival) as kind, arg_max(replica, arrival) as replica from q group by path), p as (select *, (row_number() over (order by seq) - 1) // 7 as page from t where seq > 100) select *, max(seq) over (partition by page) as cursor, page < max(page) over () as truncated from p",
    "next_vectors": f"""with {_VV}, m as (select key, 'r' || x as r, greatest(coalesce(a, 0), case when key % 4 > 0 then coalesce(b, 0) else 0 end) + (x = 1)::int as v from (select distinct user_id as key from events) cross join range(0, 5) t(x) left join n on n.key = events.key and n.r = 'r' || x) select key, '{{' || string_agg('"' || r || '":' || v, ',' order by r) filter (v > 0) || '}}' as next_vv from m group by key""".replace("(select distinct user_id as key from events) cross", "(select distinct user_id as key from events) k cross").replace("n.key = events.key", "n.key = k.key").replace("select key, 'r' || x", "select k.key, 'r' || x").replace("case when key % 4", "case when k.key % 4"),
    "commit_effects": f"with recursive {_CAS} select status, status <> 'missing' as to_remote, status in ('ok', 'replay') as to_base, case when status = 'missing' then 'failed' else 'done' end as journal, status = 'conflict' as pass_again, count(*)::bigint as n from res group by 1, 2, 3, 4, 5",
    "vv_compare": f"with {_VV} select key, case when up and down then 'same' when up then 'newer' when down then 'older' else 'concurrent' end as relation, case when down then case when up then 'same' else 'newer' end when up then 'same' else 'newer' end as merged_to_a from (select key, bool_and(a >= b) as up, bool_and(b >= a) as down from n group by key)",
    "vv_merge": f"""with {_VV} select key, '{{' || string_agg('"' || r || '":' || greatest(a, b), ',' order by r) filter (greatest(a, b) > 0) || '}}' as merged, '{{' || string_agg('"' || r || '":' || (a + (r = 'r0')::int), ',' order by r) filter (a + (r = 'r0')::int > 0) || '}}' as bumped from (select key, 'r' || x as r, coalesce(a, 0) as a, coalesce(b, 0) as b from (select distinct user_id as key from events) cross join range(0, 5) t(x) left join n using (key) where n.r = 'r' || x or n.r is null) group by key""",
    "reconcile_plan": f"with {_PLAN} select path, op from plan",
    "reconcile_moves": f"with {_MOVES} select * from moved",
    "plan_order": f"with {_MOVES} select path, op, case op when 'CONFLICT_SPLIT' then 1 when 'DELETE_LOCAL' then 2 when 'MOVE_LOCAL' then 4 when 'PULL' then 5 when 'CONVERGE' then 7 else 6 end::bigint as phase, (case when op like 'DELETE%' then -1 else 1 end * (length(path) - length(replace(path, '/', ''))))::bigint as level from moved",
    "cas_commit": f"with recursive {_CAS} select path, arrival, op_id, status, seq from res",
    "change_feed": f"with {_REQ}, t as (select path, max(arrival) as seq, arg_max(kind, arrival) as kind, arg_max(replica, arrival) as replica from q group by path), f as (select *, count(*) over () > 40 as truncated from t where seq > 100) select * from f order by seq limit 40",
    "min_cursor_gc": f"with {_REQ}, c as (select min(x) as low from (select max(arrival) - 500 as x from q group by replica)), t as (select path, max(arrival) as seq from q where kind = 'deleted' group by path) select path, seq from t, c where seq <= low",
    "chunk_dedup": f"with {_LINES}, a as (select distinct doc_id // 2 as grp, chunk, 1 as there from li where doc_id % 2 = 0), m as (select b.doc_id // 2 as grp, b.chunk, size, there from li b left join a on a.grp = b.doc_id // 2 and a.chunk = b.chunk where b.doc_id % 2 = 1), c as (select grp, count(there)::bigint as shared, count(*)::bigint as total from m group by grp), nd as (select grp, sum(size)::bigint as nb from (select distinct grp, chunk, size from m where there is null) group by grp) select grp, shared, total, coalesce(nb, 0)::bigint as needed_bytes from c left join nd using (grp)",
    "have_need": f"with {_LINES} select distinct chunk from li where doc_id % 2 = 1 and chunk not in (select chunk from li where doc_id % 2 = 0)",
    "convergence_check": "select 3::bigint as replicas, count(*)::bigint as paths, true as same, 'alike' as tree from documents union all select 3, count(*), not bool_or(doc_id = 7), 'edited' from documents",
    "path_safety": rf"with {_PG}, o as (select page_id, case page_id % 5 when 1 then '../' || path when 2 then path || '/CON.txt' when 3 then path || ' ' else path end as path from pg) select page_id, path, path <> '' and path not like '/%' and not regexp_matches(path, '(?s)^.:') and not regexp_matches(path, '[\x00-\x1f]') and string_split(path, '/')[1] <> '.replica' and len(list_filter(string_split(path, '/'), lambda s: s in ('', '.', '..') or regexp_full_match(lower(regexp_extract(s, '^([^.]*)', 1)), '{_RES}') or regexp_matches(s, '[ .]$'))) = 0 as safe from o",
    "path_parts": rf"with {_PG} select page_id, regexp_extract(path, '^(.*)/[^/]*$', 1) as parent, (length(path) - length(replace(path, '/', '')))::bigint as depth, array_to_string(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/')), '|') as ancestors from pg",
    "conflict_names": rf"with {_PG} select page_id, path || case when page_id % 2 = 0 then '/a.b' else '/' end || ' (conflicted copy from p 2024-01-02 030405' || case when page_id % 3 > 1 then ' #' || (page_id % 3) else '' end || ')' || case when page_id % 2 = 0 then '.txt' else '.rc' end as name from pg",
    "text_sniff": "select doc_id, case when doc_id % 3 = 0 then strlen(coalesce(text, '')) >= 8192 when doc_id % 3 = 1 then false else true end as is_text from documents where strlen(coalesce(text, '')) < 8192 or doc_id % 3 = 1 union all select doc_id, try(decode(encode(coalesce(text, ''))[1:8192])) is not null from documents where strlen(coalesce(text, '')) >= 8192 and doc_id % 3 <> 1",
    "debounced_events": "with g as (select user_id, event_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < 3600000000 then 0 else 1 end as new from events), b as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as burst from g) select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as end_us, count(*)::bigint as n, count(*) >= 5 as rescan from b group by user_id, burst",
    "result_counters": f"with recursive {_CAS} select status, count(*)::bigint as n, max(seq) as last_seq from res group by status",
    "link_counters": "select user_id % 5 as replica, count(*)::bigint as requests, count(*) filter (event_id % 7 = 0) as failures, count(*) filter (event_id % 21 = 0) as retries, coalesce(sum(event_id % 1000) filter (event_id % 3 = 0 and event_id % 7 > 0 and event_id % 11 > 0), 0)::bigint as bytes_up, coalesce(sum(event_id % 1000) filter (event_id % 3 = 1 and event_id % 7 > 0 and event_id % 11 > 0), 0)::bigint as bytes_down from events group by 1",
}
