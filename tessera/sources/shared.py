"""Files that driver and executors share, through Spark's own file systems: any store that Spark reaches will do.

Tables that an operation writes for its own use go to the folder that the session names in spark.checkpoint.dir. They
are deleted by `forget`, or when the driver ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(path: str, spark: SparkSession | None = None):
    """(file system, path, JVM) of a path."""
    spark = spark or SparkSession.active()
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place, jvm


def _raw(fs, jvm):
    """Without the checksum files of a local file system, which an edited file would no longer fit."""
    return jvm.org.apache.hadoop.fs.FileSystem.getLocal(fs.getConf()).getRawFileSystem() if fs.getUri().getScheme() == "file" else fs


def exists(path: str, spark: SparkSession | None = None) -> bool:
    fs, place, _ = _fs(path, spark)
    return fs.exists(place)


def names(path: str, spark: SparkSession | None = None) -> list[str]:
    """Names of the files and folders in a folder, in order; none if there is no folder."""
    fs, place, _ = _fs(path, spark)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def size(path: str, spark: SparkSession | None = None) -> int:
    """Bytes of a file, or of all files in a folder."""
    fs, place, _ = _fs(path, spark)
    return fs.getContentSummary(place).getLength()


def read_bytes(path: str, most: int | None = None, spark: SparkSession | None = None) -> bytes:
    fs, place, jvm = _fs(path, spark)
    if not fs.exists(place):
        raise FileNotFoundError(path)
    n = fs.getFileStatus(place).getLen()
    f = _raw(fs, jvm).open(place)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(f, n if most is None else min(n, most)))
    finally:
        f.close()


def read_text(path: str, spark: SparkSession | None = None) -> str:
    return read_bytes(path, spark=spark).decode("utf-8")


def make_folder(path: str, spark: SparkSession | None = None) -> None:
    fs, place, _ = _fs(path, spark)
    fs.mkdirs(place)


def delete(path: str, spark: SparkSession | None = None) -> None:
    """A file, or a folder with what is in it; nothing, if it isn't there."""
    fs, place, _ = _fs(path, spark)
    fs.delete(place, True)


def move(old: str, new: str, spark: SparkSession | None = None) -> None:
    """One rename; a file that is there already is replaced in the same step."""
    fs, place, jvm = _fs(old, spark)
    how = SparkSession.active().sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(fs.makeQualified(place), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(new)), how)


def atomic_write(path: str, text: str, spark: SparkSession | None = None) -> None:
    """The whole text or nothing: written beside the path, flushed to disk, then renamed."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, place, jvm = _fs(beside, spark)
    f = _raw(fs, jvm).create(place, True)
    try:
        f.write(bytearray(text, "utf-8"))
        f.hsync()
    finally:
        f.close()
    move(beside, path, spark)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder. Without a setting there is none on a cluster (an error); a local session,
    whose executors are the driver, gets a temporary one."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or (known.get() if known.isDefined() else None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    if known.isEmpty():
        sc.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    fs, place, _ = _fs(path, spark)
    fs.deleteOnExit(place)
    return path


def kept(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: what follows starts from files, whatever becomes of executors."""
    path = shared_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a frame that `kept` has returned."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(path, spark)
