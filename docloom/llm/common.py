"""Shared folder, written tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset on a single machine (local mode) a temporary folder stands in; on a cluster that would
    be another folder on each machine, so it is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="docloom-")
    return _FALLBACK["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there.

    The files outlive any executor; a later stage that fails reads them again instead
    of computing df anew.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._docloom_path = path
    return back


def discard(table: DataFrame) -> None:
    """Delete the files of a table that cut() wrote and nothing reads any more."""
    spark, path = table.sparkSession, getattr(table, "_docloom_path", None)
    if path:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores before it until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def publish(spark: SparkSession, data: bytes, kind: str) -> str:
    """Put data into the shared folder and have Spark fetch it to every executor; its name for SparkFiles."""
    name = f"{kind}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/docloom/{name}")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(p)
    try:
        for at in range(0, len(data), 1 << 24):
            stream.write(bytearray(data[at : at + (1 << 24)]))
    finally:
        stream.close()
    spark.sparkContext.addFile(fs.makeQualified(p).toString())
    return name


#: Parts that the rows of one key are dealt into where each needs its key's minimum.
SALTS = 64


def with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with the least value of their key, which must not be null, as name.

    A key's rows are dealt into SALTS parts by their value. Parts are reduced first, and each part
    gets its own copy of the key's minimum back, so a key with any share of all rows is no single task's work.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "_salt").agg(F.min(value).alias("_m"))
    low = parts.groupBy(key).agg(F.min("_m").alias(name), F.collect_list("_salt").alias("_salts")).select(key, name, F.explode("_salts").alias("_salt"))
    return salted.join(low, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (node, root).

    root is the smallest node reachable from node. Alternates the large-star and
    small-star steps (Kiveris et al., 2014) until the edges are stars around their
    smallest member. Each round is written to the shared folder; only a row count and a
    checksum reach the driver. A hub's edges are joined by sort-merge, which adaptive
    execution splits. Nodes without an edge to another node are not returned.
    """
    e = cut(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    seen = _mark(e)
    while seen[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        new = cut(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct(),
            "edges",
        )
        mark = _mark(new)
        discard(e)
        e, changed = new, mark != seen
        seen = mark
        if not changed:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())
