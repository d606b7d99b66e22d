"""Exact dedup by deterministic block naming, in DataFrame functions only.

Every text is cut into fixed-size blocks. The blocks are dealt out in ranges and sorted, and numbered in that order:
equal blocks get equal integer names, different blocks different ones. Adjacent names are paired and the pairs named in
turn, round after round, until one name is left; ``(rounds, name)`` identifies the text. No hash decides that texts
are equal or different: one takes part in the order of the sort only, behind a block's first characters and before
the block itself, so that blocks which begin alike do not all fall into one range.

Keys that hold 1/500 of the rows or more, 500 at most, are found first, named by themselves (below zero) and met by
broadcast, so that no range holds a common block.

Defined cases: a null text equals the empty text. Rows with one doc_id are rows of their own; of rows that repeat one
doc_id and text exactly one stays. A null doc_id sorts below all others. Very long texts are more blocks and rounds. An
empty table gives an empty result. Extra columns pass through, whatever their names; one called ``keep_id``,
``group_size`` or ``kept`` comes out of ``exact_dedup`` as ``input_`` and its name, of ``kept_rows`` as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidstone.functions.staging import sized, stage
from braidstone.llm.common import HOT_SHARE, attach

BLOCK_CHARS = 4096
#: Characters of a block that lead its place in the order.
LEAD = 12
SAID = ("keep_id", "group_size", "kept")


def _name(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``rows`` with the integer name of their ``keys`` in place of them, stored; larger keys in order get larger names."""
    lead = F.substring(keys[0], 1, LEAD) if len(keys) == 1 else F.col(keys[0])
    keyed = rows.withColumns({"__bs_lead": lead, "__bs_hash": F.xxhash64(*keys)})
    many = stage(keyed.groupBy("__bs_hash").agg(F.count(F.lit(1)).alias("n")), f"{what}-counts")
    total = many.agg(F.sum("n")).first()[0] or 0
    hot = stage(many.filter(F.col("n") * HOT_SHARE >= max(total, HOT_SHARE)).filter("n > 1").select("__bs_hash"), f"{what}-hot")  # HOT_SHARE rows at most
    common = not hot.isEmpty()
    rest = keyed.join(F.broadcast(hot), "__bs_hash", "left_anti") if common else keyed
    order = ["__bs_lead", "__bs_hash", *keys]
    placed = rest.repartitionByRange("__bs_lead", "__bs_hash").sortWithinPartitions(*order).withColumn("__bs_at", F.monotonically_increasing_id())
    named = placed.withColumn("__bs_name", F.min("__bs_at").over(Window.partitionBy(*order))).drop("__bs_at", "__bs_lead", "__bs_hash", *keys)
    if common:
        warm = keyed.join(F.broadcast(hot), "__bs_hash")
        names = warm.select(*keys).distinct().withColumn("__bs_name", (F.row_number().over(Window.orderBy(*keys)) - 1 - 2 * HOT_SHARE).cast("long"))
        named = named.unionByName(warm.join(F.broadcast(names), keys).drop("__bs_lead", "__bs_hash", *keys))
    return stage(named, what)


def identities(texts: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(__bs_uid, __bs_level, __bs_name)`` for a stored table ``(__bs_uid long, __bs_text string not null)``."""
    count = F.greatest(F.lit(1), F.ceil(F.char_length("__bs_text") / block_chars)).cast("int")
    cut = F.expr(f"transform(sequence(0, __bs_len - 1), i -> substring(__bs_text, i * {block_chars} + 1, {block_chars}))")
    blocks = texts.withColumn("__bs_len", count).select("__bs_uid", "__bs_len", F.posexplode(cut).alias("__bs_i", "__bs_block"))
    now = _name(blocks, ["__bs_block"], "names-0")
    done, level = [], 0
    while True:
        done.append(now.filter("__bs_len = 1").select("__bs_uid", F.lit(level).alias("__bs_level"), "__bs_name"))
        rest = now.filter("__bs_len > 1")
        if rest.isEmpty():
            break
        level += 1
        half = F.expr("__bs_i div 2").cast("int")
        left = F.max(F.when(F.col("__bs_i") % 2 == 0, F.col("__bs_name")))
        right = F.coalesce(F.max(F.when(F.col("__bs_i") % 2 == 1, F.col("__bs_name"))), F.lit(-1).cast("long"))
        pairs = rest.groupBy("__bs_uid", F.expr("(__bs_len + 1) div 2").cast("int").alias("__bs_len"), half.alias("__bs_i")).agg(left.alias("__bs_l"), right.alias("__bs_r"))
        now = _name(stage(pairs, f"pairs-{level}"), ["__bs_l", "__bs_r"], f"names-{level}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _verdict(docs: DataFrame, text: str, id_col: str, block_chars: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``__bs_uid`` (stored, columns as ``__bs_c0``...) and ``(__bs_uid, keep_id, group_size, kept)``."""
    own = [F.col(f"`{c}`").alias(f"__bs_c{i}") for i, c in enumerate(docs.columns)]
    rows = stage(docs.select(*own).withColumn("__bs_uid", F.monotonically_increasing_id()), "rows")
    body = F.coalesce(F.col(f"__bs_c{docs.columns.index(text)}").cast("string"), F.lit("")).alias("__bs_text")
    known = identities(rows.select("__bs_uid", body), block_chars)
    with_id = stage(known.join(rows.select("__bs_uid", F.col(f"__bs_c{docs.columns.index(id_col)}").alias("__bs_id")), "__bs_uid"), "identities")
    groups = stage(with_id.groupBy("__bs_level", "__bs_name").agg(F.max(F.struct("__bs_id", "__bs_uid")).alias("top"), F.count(F.lit(1)).alias("group_size")).withColumn("__bs_n", F.col("group_size")), "groups")
    verdict = attach(with_id, groups, ["__bs_level", "__bs_name"], "__bs_n", with_id.count())
    return rows, verdict.select("__bs_uid", F.col("top.__bs_id").alias("keep_id"), "group_size", (F.col("top.__bs_uid") == F.col("__bs_uid")).alias("kept"))


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All rows and columns of ``docs`` with ``keep_id``, ``group_size``, ``kept``: of equal texts the row with the largest id stays."""
    rows, verdict = _verdict(docs, text, id_col, block_chars)
    own = [F.col(f"__bs_c{i}").alias(f"input_{c}" if c in SAID else c) for i, c in enumerate(docs.columns)]
    return rows.join(verdict, "__bs_uid").select(*own, *SAID)


def kept_rows(docs: DataFrame, text: str = "text", id_col: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns. The dropped rows' numbers are broadcast while they are few."""
    rows, verdict = _verdict(docs, text, id_col, block_chars)
    gone = stage(verdict.filter("not kept").select("__bs_uid"), "dropped")
    kept = rows.join(sized(gone, gone.count()), "__bs_uid", "left_anti")
    return kept.select(*(F.col(f"__bs_c{i}").alias(c) for i, c in enumerate(docs.columns)))
