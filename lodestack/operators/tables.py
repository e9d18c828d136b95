"""Working tables in the folder all executors share, and files on any file system Spark can reach."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_marked: set[str] = set()


class Files:
    """Files by Spark's own file systems: local, HDFS, object stores."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none of a folder that isn't there."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def version(self, path: str) -> str:
        """Changes when a table's files do: a print of their names, sizes and times."""
        fs, p = self._at(path)
        rows, it = [], fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            rows.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
        return hashlib.md5("\n".join(sorted(rows)).encode()).hexdigest()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a file that isn't there yet; whether it was this call that did."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        try:
            stream = fs.create(p, False)
        except Exception as e:  # noqa: BLE001 - the JVM's exception of another writer that came first
            if "Exist" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        return True

    def move(self, source: str, target: str) -> bool:
        fs, a = self._at(source)
        return fs.rename(a, self.jvm.org.apache.hadoop.fs.Path(target))

    def place(self, source: str, target: str) -> None:
        """Moves a folder below another that may not be there yet."""
        fs, p = self._at(target)
        fs.mkdirs(p.getParent())
        if not self.move(source, target):
            raise OSError(f"could not move {source} to {target}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def delete_at_exit(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own serves a session on
    one machine; on a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="lodestack-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
    return _own[sc.applicationId]


def session_dir(spark: SparkSession) -> str:
    """The folder of this session's working tables; it is removed with the session."""
    at = f"{shared_dir(spark)}/lodestack-{spark.sparkContext.applicationId}"
    if at not in _marked:
        Files(spark).delete_at_exit(at)
        _marked.add(at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, which survives the loss of executors."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def built_once(spark: SparkSession, name: str, source: str, build: Callable[[str], None]) -> str:
    """The folder of what `build` makes of a table's files: built when first asked for, and anew when the files change. A
    build that is not whole is not seen; of two at the same time one counts."""
    files = Files(spark)
    path = f"{shared_dir(spark)}/{name}-{files.version(source)}"
    if not files.exists(path):
        part = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
        build(part)
        if not files.exists(path) and not files.move(part, path) and not files.exists(path):
            raise RuntimeError(f"could not put {path} in its place")
    return path


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where its files give fewer: a small file is one task's work
    otherwise. Larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() < cores else df
