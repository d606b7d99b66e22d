"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's Boolean trigram query is derived from its regex: the parsed pattern is walked for the strings a match must
hold, alternatives and optional or small classes make an OR, the trigrams of one way through the pattern an AND. An
inverted index holds the postings of the queried trigrams (trigram -> document). Postings are intersected per
alternative, and only candidates are verified with the regex. A rule with a way through it that has no mandatory
trigram (hex runs) scans all.

The candidates' ids and kinds meet the texts by broadcast while their counted number allows it, so that no text is
shuffled; beyond that by a join on the id.

Spans are code points, end exclusive; matches of a kind are leftmost and do not overlap.

Defined cases: a null text is empty; without spans the joined strings are empty. A null doc_id is an id of its own.
Rows that repeat a doc_id share postings and are verified one by one. Long texts are scanned whole. An empty table
gives an empty result. ``digest`` carries no extra columns, ``redact`` all of them, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidstone.functions.staging import BROADCAST_ROWS, stage


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java regex; a match counts when group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base kinds in their order, then kinds this method adds.
RULES = (
    Rule("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("bearer", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 1),
)
BASE = ("assign", "access", "hex")
#: A class of more characters, lower-cased, ends a string; so does whatever would make more ways through a pattern.
CLASS_MOST, WAYS_MOST = 8, 256


def trigrams(text: str) -> list[str]:
    return list(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2)))


def _one_of(items: list) -> set[str] | None:
    """The lower-cased characters of a class; none if there are too many or it is not a plain list."""
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < 2 * CLASS_MOST:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= CLASS_MOST else None


def _walk(items, ways: set[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """Every way through a parsed pattern as the lower-cased strings on it; the last is still growing."""
    ended = lambda ways: {w if w[-1] == "" else (*w, "") for w in ways}
    for op, value in items:
        before = ways
        if op is C.LITERAL:
            ways = {(*w[:-1], w[-1] + chr(value).lower()) for w in ways}
        elif op is C.IN and (some := _one_of(value)) is not None:
            ways = {(*w[:-1], w[-1] + c) for w in ways for c in some}
        elif op is C.SUBPATTERN:
            ways = _walk(value[3], ways)
        elif op is C.BRANCH:
            ways = set().union(*(_walk(x, ways) for x in value[1]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and tuple(value[:2]) == (0, 1):
            ways = ways | _walk(value[2], ways)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0]:
            ways = ended(_walk(value[2], ways))
        elif op is not C.AT:  # an anchor takes no character
            ways = ended(ways)
        if len(ways) > WAYS_MOST:
            ways = ended(before)
    return ways


def mandatory(pattern: str) -> list[list[str]]:
    """OR of ANDs of trigrams that a lower-cased text with a match holds; [] when nothing is mandatory."""
    try:
        ways = _walk(_parser.parse(pattern), {("",)})
    except (re.error, OverflowError):  # beyond what both dialects share
        return []
    each = {frozenset(g for part in w for g in trigrams(part)) for w in ways}
    if frozenset() in each:
        return []
    return sorted(sorted(x) for x in each if not any(y < x for y in each))


def queries(rules: tuple[Rule, ...] = RULES) -> dict[str, list[list[str]]]:
    """kind -> OR of ANDs of trigrams; [] when nothing is mandatory."""
    return {r.kind: mandatory(r.pattern) for r in rules}


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """The inverted index ``(trigram, doc_id)`` restricted to trigrams that some query asks for."""
    asked = sorted({g for alts in queries(rules).values() for alt in alts for g in alt})
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("__bs_low"), F.lit(g)), F.lit(g)) for g in asked)).cast("array<string>"))
    return docs.select(F.col(id_col), low.alias("__bs_low")).select(F.explode(held).alias("trigram"), F.col(id_col))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, kinds)``: the rules whose Boolean query the intersected postings of a document satisfy."""
    have = index.groupBy(id_col).agg(F.collect_set("trigram").alias("have"))  # one entry per queried trigram at most
    met = {k: [F.size(F.array_intersect(F.col("have"), F.array(*map(F.lit, alt)))) == len(alt) for alt in alts] for k, alts in queries(rules).items() if alts}

    def any_of(conditions: list[Column]) -> Column:
        out = conditions[0]
        for c in conditions[1:]:
            out = out | c
        return out

    kinds = F.array_compact(F.array(*(F.when(any_of(c), F.lit(k)) for k, c in met.items())).cast("array<string>"))
    return have.select(F.col(id_col), kinds.alias("kinds")).filter(F.size("kinds") > 0)


SPANS = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """Array of (start, ord, end, kind) of the rule's matches in ``text``, those too short left out.

    n matches part a text into n + 1 pieces; the i-th begins after i + 1 pieces and i matches.
    """
    none = F.array().cast(SPANS)
    pieces = F.zip_with(F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda s, m: F.struct(s.alias("s"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["s"])
        end = start + F.char_length(x["m"])
        value = F.regexp_extract(x["m"], rule.pattern, rule.group) if rule.group else x["m"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        more = F.when(F.char_length(value) >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.cast("bigint").alias("at"), more.cast(SPANS).alias("out")))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(pieces, first, step, lambda acc: acc["out"])).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """``(id, rest, text, spans)``: ``rest`` a struct of all columns but the text, spans by start, then the rules' order."""
    body = docs.select(F.col(f"`{id_col}`").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"), F.lit(0).alias("__bs")).alias("rest"), F.col("text"))
    found = stage(candidates(postings(body, rules, "id"), rules, "id").select(F.col("id").alias("of"), "kinds"), "candidates")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    text, none, asked = F.coalesce(F.col("text"), F.lit("")), F.array().cast(SPANS), queries(rules)
    lists = [F.when(F.array_contains("kinds", r.kind), _spans(r, i, text)).otherwise(none) if asked[r.kind] else _spans(r, i, text) for i, r in enumerate(rules)]
    spans = F.array_sort(F.flatten(F.array(*(F.coalesce(x, none) for x in lists))))
    return body.join(found, F.col("id").eqNullSafe(F.col("of")), "left").select("id", "rest", "text", spans.alias("spans"))


def _is(kind: str):
    return lambda x: x["kind"] == kind


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans joined."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    spans = F.col("spans")
    counts = [F.size(F.filter(spans, _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return scanned.select(F.col("id").alias(id_col), *counts, F.sha2(joined(F.filter(spans, lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"), joined(spans).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each span of its text, overlapping ones as one, replaced by ``mark``. A text without spans stays as it is, null too."""
    text, spans = F.col("text"), F.col("spans")
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        grown = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int")), F.when(x["start"] >= acc["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), grown.alias("out"))

    rest = F.aggregate(spans, first, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    clean = F.when(F.size(spans) > 0, rest).otherwise(text).alias("text")
    return scan(docs, rules, id_col).select(*(clean if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))


#: DuckDB SQL for digest(scan(documents)). RE2 folds letters beyond ASCII under (?i), so the classes are spelled out.
def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    parts = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        value = f"regexp_extract(m, '{p}', {r.group})" if r.group else "m"
        parts.append(f"""
          select doc_id, '{r.kind}' as kind, {i} as ord, a + j - 1 + len_before as start_at, a + j - 1 + len_before + length(m) as end_at from (
            select doc_id, 0 as a, 1 as j, m, {value} as value,
              list_sum(list_transform(s[1:k], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0)::bigint as len_before
            from (select doc_id, s, ms, unnest(ms) as m, unnest(range(1, len(ms) + 1)) as k from (
              select doc_id, regexp_extract_all(text, '{p}', 0) as ms, string_split_regex(text, '{p}') as s from d)))
          where length(value) >= {r.least}""")
    return f"""
      with d as (select doc_id, coalesce(text, '') as text from documents),
      f as ({' union all '.join(parts)}),
      g as (select doc_id,
          count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
          string_agg(kind || ':' || start_at || ':' || end_at, ',' order by start_at, ord) filter (kind in ('assign', 'access', 'hex')) as base,
          string_agg(kind || ':' || start_at || ':' || end_at, ',' order by start_at, ord) as spans
        from f group by doc_id)
      select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
        sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
      from d left join g using (doc_id)"""
