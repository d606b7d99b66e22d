"""The queries of this subpackage and the SQL that checks those which SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidstone.llm import chat_format, embedding_dedup, exact_dedup, language_id, lattice_lm, ngram_jaccard, packing, piece_codec, secret_scan, token_counts
from braidstone.llm.common import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_classes(documents(spark, sf_dir, "doc_id", "text"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), vocabulary("byte_bpe_50k.json"), literal=False)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(documents(spark, sf_dir, "doc_id", "text")))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(documents(spark, sf_dir, "doc_id", "text"), vocabulary("piece_bpe_32k.model"))


#: The conversation beside the table's: its texts hold the template's own control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = chat_format.canonical_turns(table.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")))
    return chat_format.read_back(chat_format.format_chat(turns))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(token_counts.sample_edits(documents(spark, sf_dir, "doc_id", "text")), vocabulary("byte_bpe_50k.json"))


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(documents(spark, sf_dir, "doc_id", "text"), vocabulary("piece_bpe_32k.model"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_packing, op3_secret_scan, op4_piece_codec, op5_chat_format, op6_token_counts, op7_lattice_lm, op8_exact_dedup, op9_language_id, op10_embedding_dedup, pipeline)}

ORACLES = {
    "op5_chat_format": chat_format.ORACLE_SQL,
    "op3_secret_scan": secret_scan.oracle_sql(),
    "op8_exact_dedup": """
      with g as (select coalesce(text, '') as t, max(doc_id) as keep_id, count(*)::bigint as group_size from documents group by 1)
      select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(coalesce(d.text, '')) as text_sha256
      from documents d join g on coalesce(d.text, '') = g.t""",
}
