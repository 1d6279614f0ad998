"""Tables in the folder that the driver and all executors share, and files that only one writer can create."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_known: dict[tuple, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local master without that setting gets a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def once(spark: SparkSession, key: tuple, build: Callable[[str], None]) -> str:
    """Folder that `build` fills at the first call of a session; later calls find it."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _known:
        path = new_folder(spark, key[-1])
        build(path)
        _known[key] = path
    return _known[key]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file unless it exists; of several writers one succeeds."""
    fs, p = _fs(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:  # the JVM's FileAlreadyExistsException has no Python class
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def file_names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_file(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
