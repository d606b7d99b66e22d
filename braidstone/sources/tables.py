"""Readers of corpora and evaluation lists; keyed tables on append-only Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidstone.functions.paths import META_DIR
from braidstone.functions.staging import stage


def text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc, text)`` of the ``.txt`` files of a folder; the name is the stem in title case. No files: an empty corpus."""
    read = spark.read.option("pathGlobFilter", "*.txt")
    try:
        raw = read.text(folder, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "doc string, text string")
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "")
    return raw.select(F.initcap(F.replace(stem, F.lit("_"), F.lit(" "))).alias("doc"), F.lower("value").alias("text"))


def sense_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``(target, k, items array<struct<phrase, label>>)`` of lines ``target, k, phrase::label ...``, parted by tabs."""
    f = F.split(F.col("value"), "\t")
    item = lambda x: F.struct(F.regexp_extract(x, r"^(.*)::(.*)$", 1).alias("phrase"), F.regexp_extract(x, r"^(.*)::(.*)$", 2).cast("int").alias("label"))
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(f[0].alias("target"), f[1].cast("int").alias("k"), F.transform(F.slice(f, 3, F.greatest(F.size(f) - 2, F.lit(0))), item).alias("items"))


def word_pairs(spark: SparkSession, path: str, *vocabularies: DataFrame, max_pairs: int | None = None) -> DataFrame:
    """``(place, w1, w2, human)`` of a list with a header, columns 0, 1 and 3; both words in every vocabulary; the first ``max_pairs``."""
    t = spark.read.option("sep", "\t").option("header", True).csv(path)
    c = t.columns
    out = t.select(F.monotonically_increasing_id().alias("place"), F.lower(F.col(f"`{c[0]}`")).alias("w1"), F.lower(F.col(f"`{c[1]}`")).alias("w2"), F.col(f"`{c[3]}`").cast("double").alias("human"))
    for v in vocabularies:
        for side in ("w1", "w2"):
            out = out.join(v.select(F.col("word").alias(side)), side, "left_semi")
    return out if max_pairs is None else out.orderBy("place").limit(max_pairs)


def vector_files(spark: SparkSession, names: DataFrame, folder: str, size: int = 500) -> DataFrame:
    """``(name, vec)``: numbers of one text file per name, blanks in names as underscores; zeros where there is no file."""
    raw = spark.read.text(folder, wholetext=True)
    vec = F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    found = raw.select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("file"), vec.alias("vec"))
    return names.withColumn("file", F.replace("name", F.lit(" "), F.lit("_"))).join(found, "file", "left").select("name", F.coalesce("vec", F.array_repeat(F.lit(0.0), size)).alias("vec"))


def folder_scan(spark: SparkSession, folder: str, meta: str = META_DIR) -> DataFrame:
    """``(path, size, mtime, data)`` of the files below a folder, its metadata folder left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rel = F.regexp_replace("path", F.concat(F.lit("^.*?"), F.regexp_replace(F.lit(folder.rstrip("/").removeprefix("file://")), r"([.+*?()\[\]{}|^$\\])", r"\\$1"), F.lit("/")), F.lit(""))
    return raw.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("content").alias("data")).filter(~F.col("path").startswith(f"{meta}/"))


def hash_cache(scan: DataFrame, cache: DataFrame, now: str, settle_seconds: int = 2) -> DataFrame:
    """``scan`` with ``cached_id``, null where the file must be hashed: size or time differ, or it changed just now."""
    hit = cache.select(F.col("path").alias("c_path"), F.col("size").alias("c_size"), F.col("mtime").alias("c_mtime"), F.col("content_id").alias("cached_id"))
    old = F.col("mtime") < F.lit(now).cast("timestamp") - F.expr(f"interval {settle_seconds} seconds")
    return scan.join(hit, (F.col("path") == F.col("c_path")) & (F.col("size") == F.col("c_size")) & (F.col("mtime") == F.col("c_mtime")) & old, "left").drop("c_path", "c_size", "c_mtime")


def append(rows: DataFrame, path: str, version: int) -> None:
    """Rows of a keyed table under a version; a row with ``deleted`` true removes its key."""
    rows.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(path)


def current(table: DataFrame, *keys: str) -> DataFrame:
    """The latest version of each key, deletions gone: upsert and delete on an append-only table."""
    w = Window.partitionBy(*keys).orderBy(F.desc("version"))
    latest = table.withColumn("__bs_rn", F.row_number().over(w)).filter("__bs_rn = 1").drop("__bs_rn", "version")
    return latest.filter(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in table.columns else latest


def looked_up(asked: DataFrame, table: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """``asked(<key>)`` with the latest ``value`` of ``table(<key>, value, version)``, or the default."""
    return asked.join(current(table, key).select(key, "value"), key, "left").withColumn("value", F.coalesce("value", F.lit(default)))


def replace(rows: DataFrame, path: str) -> None:
    """The table at ``path`` holds ``rows`` and nothing else; they may come from that table."""
    stage(rows, "replacement").write.mode("overwrite").parquet(path)


def journal(log: DataFrame) -> DataFrame:
    """``(op_id, seq, attempts)`` still pending, of ``log(op_id, seq, event)`` with events add, failed and done."""
    state = log.groupBy("op_id").agg(F.min(F.when(F.col("event") == "add", F.col("seq"))).alias("seq"), F.count_if(F.col("event") == "failed").alias("attempts"), F.count_if(F.col("event") == "done").alias("done"))
    return state.filter((F.col("done") == 0) & F.col("seq").isNotNull()).select("op_id", "seq", "attempts")
