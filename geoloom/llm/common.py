"""Shared plumbing of the operators: tables, sizes, shared folders."""

from __future__ import annotations

import collections
import contextlib
import ctypes
import math
import re
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one block or bucket of a grouped pass holds on average.
BLOCK_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, set for checkpoints; a temporary one is made only where nothing is set and Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="geoloom-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared storage."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _jvm_trimmed(spark: SparkSession) -> str:
    """Have the driver's JVM return what its allocator holds free, as `jcmd System.trim_native_heap` does; its answer."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    # Through the interface: the server's own class is closed to reflection.
    named = jvm.java.lang.Class.forName
    kinds = [named(c) for c in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    return str(invoke.invoke(server, array(jvm.java.lang.Object, command, "systemTrimNativeHeap", array(jvm.java.lang.Object), array(jvm.java.lang.String))))


def given_back(spark: SparkSession) -> None:
    """Return memory that the driver's Python and JVM have freed to the system; their allocators keep it otherwise.

    A model's training in Python, and compilers and codecs in the JVM, leave some 100 MB each. Without
    glibc, or on a JVM without the command, that part does nothing.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, TypeError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    with contextlib.suppress(Py4JError):
        _jvm_trimmed(spark)


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder; survives lost executors."""
    shared(df.sparkSession)
    out = df.checkpoint(eager=True)
    given_back(df.sparkSession)
    return out


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """(df as a compressed table of the shared folder, that table's folder); cuts the lineage as `kept` does."""
    folder = f"{shared(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; one pass over one column."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0)).alias("b")).first()["b"]


def blocks_for(total: int, size: int = BLOCK_BYTES, least: int = 8) -> int:
    return max(least, math.ceil(total / size))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    had = {c.lower() for c in df.columns}
    while name.lower() in had:
        name = f"_{name}"
    return name


# ---- bounded samples of labelled rows ----------------------------------------------------------
def _within(keys: list, cap: int, max_bytes: int) -> list[int]:
    """Of (class, order, row hash, bytes): the first `cap` row hashes of each class whose texts fit into max_bytes together."""
    rows, size, out = collections.Counter(), collections.Counter(), []
    for value, _, u, n in sorted(keys, key=lambda k: (str(k[0]), k[1], k[2])):
        if rows[value] < cap and size[value] + n <= max_bytes:
            rows[value] += 1
            size[value] += n
            out.append(u)
    return out


def _fetched(keyed: DataFrame, chosen: list[int], columns: list[str]) -> list:
    """The rows of these hashes, each once, in the order of their values."""
    if not chosen:
        return []
    few = keyed.sparkSession.createDataFrame([(u,) for u in chosen], "u long")
    got = keyed.join(F.broadcast(few), "u").groupBy("u").agg(F.min(F.struct(*columns)).alias("r")).collect()
    return sorted((g["r"] for g in got), key=lambda r: tuple((x is not None, x) for x in r))


def _row_hash(seed: str):
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def drawn(rows: DataFrame, by: str, cap: int, max_bytes: int, seed: str) -> list:
    """At most `cap` different rows (doc_id, text, by) of each class, at most max_bytes of text a class.

    Rows are ordered by a hash of doc_id and text, so neither a hot id nor a repeated row floods the
    sample or keeps a class out; a text longer than max_bytes is passed over. About twice as many
    hashes as rows reach the driver.
    """
    keyed = rows.select("doc_id", "text", by, _row_hash(seed).alias("u"), F.octet_length("text").cast("long").alias("bytes"))
    sizes = keyed.groupBy(by).agg(F.approx_count_distinct("u", 0.02).alias("n")).collect()
    order, share = F.pmod(F.col("u"), F.lit(1 << 30)), F.lit(False)
    for r in sizes:
        share = share | ((F.col(by) == r[by]) & (order < int(min(1.0, 2 * cap / max(1, r["n"])) * (1 << 30))))
    few = keyed.where(share).groupBy(by, "u").agg(F.max("bytes").alias("n")).collect()
    chosen = _within([(r[by], r["u"] % (1 << 30), r["u"], r["n"]) for r in few], cap, max_bytes)
    return _fetched(keyed.where(share), chosen, ["doc_id", "text", by])


def drawn_labelled(docs: DataFrame, given: DataFrame, label: str, cap: int, max_bytes: int, seed: str, columns: tuple[str, ...] = ()) -> list:
    """At most `cap` rows (doc_id, text, label, columns) of each label, one text a doc_id, at most max_bytes of text a label.

    given: (doc_id, label) with each doc_id once. Ids are drawn by a hash, about twice as many as
    needed, and broadcast; of a repeated doc_id the text of smallest hash stands for all.
    """
    sizes = given.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    order, share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)), F.lit(False)
    for r in sizes:
        share = share | ((F.col(label) == r[label]) & (order < int(min(1.0, 2 * cap / r["n"]) * (1 << 30))))
    ids = given.where(share).select("doc_id", label, order.alias("order"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *columns).join(F.broadcast(ids), "doc_id")
    keyed = rows.select("doc_id", "text", label, "order", *columns, _row_hash(seed).alias("u"), F.octet_length("text").cast("long").alias("bytes"))
    few = keyed.groupBy(label, "order", "doc_id").agg(F.min(F.struct("u", "bytes")).alias("m")).collect()
    chosen = _within([(r[label], r["order"], r["m"]["u"], r["m"]["bytes"]) for r in few], cap, max_bytes)
    return _fetched(keyed, chosen, ["doc_id", "text", label, *columns])
