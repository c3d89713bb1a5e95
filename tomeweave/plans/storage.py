"""Shared storage for intermediate tables.

Lineage is cut by writing Parquet into the folder named in ``spark.checkpoint.dir``, which
every executor sees, so a lost executor costs a re-read and not a re-computation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_MADE: list[str] = []
#: Without its native library Hadoop starts a chmod for every local file, also for those of checksums and marks. Until such a
#: process runs its program, it has the memory of its JVM, and what adds up processes counts that twice.
_FEW_PROCESSES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def work_dir(spark: SparkSession) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``.

    Where that is unset, the context's own checkpoint folder is used; else, on a local master, a
    temporary folder; else one below the SQL warehouse, which a cluster shares.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            base = "file://" + tempfile.mkdtemp(prefix="tomeweave-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base if base.startswith("/") else base
    _MADE.append(f"{base.rstrip('/')}/tomeweave-{uuid.uuid4().hex}")
    return _MADE[-1]


def file_system(uri: str):
    """(Arrow file system, path) of a URI below a shared folder, for files that Spark has no writer for."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def remove_work() -> int:
    """Delete all work folders that this process has made; returns how many were there.

    Results read from them: call it once they are consumed or written elsewhere.
    """
    from pyarrow.fs import FileType

    found = 0
    while _MADE:
        files, path = file_system(_MADE.pop())
        if files.get_file_info(path).type == FileType.Directory:
            files.delete_dir(path)
            found += 1
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    path = work_dir(df.sparkSession)
    df.write.options(**_FEW_PROCESSES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
