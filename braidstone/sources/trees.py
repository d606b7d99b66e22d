"""Trees of files on a mount that every executor sees: walking, hashing in pieces, writing whole files at once."""

from __future__ import annotations

import hashlib
import os
import stat
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidstone.functions.paths import META_DIR, check_safe, is_safe, normalise
from braidstone.functions.staging import stage

#: Bytes of a file that are held at once while it is hashed.
PIECE = 1 << 20
#: A file that changed less than this before the scan may change again within one tick of its clock.
SETTLE_NS = 2_000_000_000

_NODE = ["raw", "kind", "size", "mtime_ns", "ctime_ns", "ino", "executable"]
_NODE_SQL = "raw string, kind string, size long, mtime_ns long, ctime_ns long, ino long, executable boolean"


def _local(folder: str) -> str:
    return folder.removeprefix("file://").rstrip("/") or "/"


def walk(spark: SparkSession, folder: str, meta: str = META_DIR) -> DataFrame:
    """``(path, raw, kind, size, mtime_ns, ctime_ns, ino, executable)`` of the folders and files below ``folder``.

    One level after another, each listed by all cores and stored. ``raw`` is the name on disk, ``path`` the normalised
    one. Links, other kinds of files, folders called ``meta``, unsafe names, names that are not UTF-8 and what is below
    such folders are left out, and so is what goes away meanwhile. Sizes of folders are 0.
    """
    root = _local(folder)

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for above in f["raw"]:
                try:
                    entries = list(os.scandir(os.path.join(root, above)))
                except OSError:
                    continue
                for e in entries:
                    try:
                        s, raw = e.stat(follow_symlinks=False), os.path.join(above, e.name)
                        raw.encode()
                    except (OSError, UnicodeEncodeError):
                        continue
                    if stat.S_ISDIR(s.st_mode) and e.name != meta:
                        rows.append((raw, "dir", 0, s.st_mtime_ns, s.st_ctime_ns, s.st_ino, False))
                    elif stat.S_ISREG(s.st_mode):
                        rows.append((raw, "file", s.st_size, s.st_mtime_ns, s.st_ctime_ns, s.st_ino, bool(s.st_mode & stat.S_IXUSR)))
            yield pd.DataFrame(rows, columns=_NODE)

    cores, levels = spark.sparkContext.defaultParallelism, []
    frontier = spark.createDataFrame([("",)], "raw string")
    while not levels or not frontier.isEmpty():
        found = frontier.repartition(cores).mapInPandas(listed, _NODE_SQL).withColumn("path", normalise("raw"))
        levels.append(stage(found.filter(is_safe(F.col("path"), meta)).select("path", *_NODE), "level"))
        frontier = levels[-1].filter("kind = 'dir'").select("raw")
    return reduce(DataFrame.unionByName, levels)


def hash_files(nodes: DataFrame, folder: str, piece: int = PIECE) -> DataFrame:
    """``(path, content_id)`` of the files among ``nodes(path, raw, kind)``, read piece by piece; one that cannot be read is left out."""
    root = _local(folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, raw in zip(f["path"], f["raw"], strict=True):
                h = hashlib.blake2b(digest_size=16)
                try:
                    with open(os.path.join(root, raw), "rb") as file:
                        while data := file.read(piece):
                            h.update(data)
                except OSError:
                    continue
                rows.append((path, f"b2:{h.hexdigest()}"))
            yield pd.DataFrame(rows, columns=["path", "content_id"])

    return nodes.filter("kind = 'file'").select("path", "raw").mapInPandas(run, "path string, content_id string")


def scan_tree(spark: SparkSession, folder: str, cache: DataFrame, now_ns: int, meta: str = META_DIR) -> DataFrame:
    """``walk`` with ``content_id`` and ``hit``: whether it came from ``cache(path, size, mtime_ns, ctime_ns, ino, content_id)``.

    A file is hashed unless all four agree and it has settled. ``hit`` is null for folders. The files of the result are
    the next cache.
    """
    nodes, known = walk(spark, folder, meta), ["path", "size", "mtime_ns", "ctime_ns", "ino"]
    settled = F.col("mtime_ns") <= now_ns - SETTLE_NS
    files = stage(nodes.filter("kind = 'file'").join(cache.select(*known, "content_id"), known, "left").withColumn("content_id", F.when(settled, F.col("content_id"))), "files")
    hits = files.filter("content_id is not null").withColumn("hit", F.lit(True))
    fresh = files.filter("content_id is null").drop("content_id")
    hashed = fresh.join(stage(hash_files(fresh, folder), "hashed"), "path").withColumn("hit", F.lit(False))
    none = nodes.filter("kind = 'dir'").withColumn("content_id", F.lit(None).cast("string")).withColumn("hit", F.lit(None).cast("boolean"))
    return hits.unionByName(hashed).unionByName(none)


def write_files(files: DataFrame, folder: str, meta: str = META_DIR) -> DataFrame:
    """Writes ``files(path, data, mtime_ns, executable)`` below ``folder`` and returns ``(path, size)`` of each, stored.

    A file is written aside, brought to the disk and put in its place at once, so readers see the old or the new one
    and a task that is run again does no harm. An unsafe path is an error before anything of its task is written.
    Null times and modes leave those of a new file.
    """
    root = _local(folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aside = os.path.join(root, meta, "tmp")
        os.makedirs(aside, exist_ok=True)
        for f in frames:
            for path, data, mtime, executable in zip(f["path"], f["data"], f["mtime_ns"], f["executable"], strict=True):
                target, temp = os.path.join(root, path), os.path.join(aside, uuid.uuid4().hex)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(temp, "wb") as file:
                    file.write(data or b"")
                    file.flush()
                    os.fsync(file.fileno())
                if executable is not None and not pd.isna(executable) and executable:
                    os.chmod(temp, 0o755)
                if not pd.isna(mtime):
                    os.utime(temp, ns=(int(mtime), int(mtime)))
                os.replace(temp, target)
                above = os.open(os.path.dirname(target), os.O_RDONLY)
                try:
                    os.fsync(above)
                finally:
                    os.close(above)
            yield pd.DataFrame({"path": f["path"], "size": [len(d or b"") for d in f["data"]]})

    safe = files.select(check_safe(F.col("path"), meta).alias("path"), "data", F.col("mtime_ns").cast("long").alias("mtime_ns"), F.col("executable").cast("boolean").alias("executable"))
    return stage(safe.mapInPandas(run, "path string, size long"), "written")
