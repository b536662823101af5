"""Shared storage and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a folder of this machine is used, for local masters only.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='loomgraph-')}")
    return jsc.getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    FOLDERS.append(f"{shared_dir(spark).rstrip('/')}/loomgraph-{name}-{uuid.uuid4().hex}")
    return FOLDERS[-1]


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    trim_driver(df.sparkSession)
    return out


def trim_driver(spark: SparkSession) -> bool:
    """Gives native memory that the driver's JVM has freed back to the system; whether the JVM could be told to.

    Compiling the code of many plans leaves hundreds of MB in the allocator's
    arenas.  JVMs without the command, and other systems than Linux, keep it.
    """
    jvm = spark.sparkContext._jvm
    of = jvm.java.lang.Class.forName
    array = spark.sparkContext._gateway.new_array
    try:
        # By reflection: the server's own class is none that may be called from outside.
        kinds = array(jvm.Class, 4)
        kinds[0], kinds[1], kinds[2], kinds[3] = (of(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
        given = array(jvm.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        given[2], given[3] = array(jvm.Object, 0), array(jvm.String, 0)
        of("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table.  On a local master, Python workers are told where this package lies, whatever their folder."""
    if spark.sparkContext.master.startswith("local["):
        own = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        spark.sparkContext.environment.setdefault("PYTHONPATH", own)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, folder: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back with its schema."""
    df.write.parquet(folder)
    trim_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: A key with more than this share of all rows is hot, so at most its inverse are.
HOT_SHARE = 0.001


def joined_by_hot_key(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join of ``left`` with ``right`` (one row for each ``key``), whose rows of the keys in ``hot`` are broadcast.

    ``hot`` (``key``, without repeats) comes from ``hot_keys``, which bounds it by 1 / ``HOT_SHARE`` rows, so
    the rows of a key that holds much of ``left`` stay where they are.
    """
    hot = F.broadcast(hot)
    few = F.broadcast(right.join(hot, key, "left_semi"))
    return left.join(few, key).unionByName(left.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key))


def hot_keys(sizes: DataFrame, key: str, size: str = "size") -> DataFrame:
    """The keys of ``sizes`` (key, size) that hold more than ``HOT_SHARE`` of the sum of sizes, as a table that is kept."""
    total = sizes.agg(F.sum(size)).first()[0] or 0
    return cut(sizes.filter(F.col(size) > max(1000, total * HOT_SHARE)).select(key))


#: Folders that were made in this process and not dropped since.
FOLDERS: list[str] = []


def drop_folders(spark: SparkSession, made: list[str]) -> None:
    """Deletes folders whose rows nobody reads any more."""
    jvm = spark.sparkContext._jvm
    for folder in made:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if folder in FOLDERS:
            FOLDERS.remove(folder)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a path or URI, and the path in it."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    if uri.startswith("file:"):
        uri = uri[5:]
    return pafs.LocalFileSystem(), os.path.abspath(uri)


def publish(folder: str, name: str, data: bytes) -> None:
    """Writes a small file under a temporary name, then renames it."""
    files, path = filesystem(folder)
    files.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(temporary) as out:
        out.write(data)
    files.move(temporary, f"{path}/{name}")


#: What a Python worker keeps from task to task, by owner.
KEPT: dict[str, object] = {}


def release(keep: str = "") -> None:
    """Drops what other owners than ``keep`` have kept and gives freed memory back to the system; Python workers live on from stage to stage."""
    for owner in KEPT.keys() - {keep}:
        del KEPT[owner]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def crc_of_id(doc_id, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
