"""What a session needs around the queries: the package on its workers, and a shared folder."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
_folders: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once an application, unless PYTHONPATH already has it.

    Spark's own file server hands out the archive, so executors need no access to the driver's disk.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped or str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_ROOT.rglob("*.py")):
            z.write(path, str(path.relative_to(_ROOT.parent)))
    folder = tempfile.mkdtemp(prefix="tensorloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, f"{_ROOT.name}.zip")
    archive.write_bytes(packed.getvalue())
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, without a trailing slash.

    Only where the session names none (tests, notebooks on one machine) it is a folder of this
    process below the warehouse, removed at its end.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch-{os.getpid()}"
    local = own.removeprefix("file://") if own.startswith("file:///") else own.removeprefix("file:")
    if own not in _shipped and "://" not in local:
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        _shipped.add(own)
    return own


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one.

    It goes with all its tables when the process ends, or earlier by :func:`clear`.
    """
    context = spark.sparkContext
    if context.applicationId not in _folders:
        _folders[context.applicationId] = f"{shared_dir(spark)}/tensorloom-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        # The JVM outlives ``stop()``, so its file systems can be asked at the process's end.
        atexit.register(_remove, context._jvm, context._jsc.hadoopConfiguration(), _folders[context.applicationId])
    return _folders[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the application's folder: lineage ends here, lost executors or not."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove the application's intermediate tables; DataFrames that read them are spent."""
    context = spark.sparkContext
    if context.applicationId in _folders:
        _remove(context._jvm, context._jsc.hadoopConfiguration(), _folders[context.applicationId])


def _remove(jvm, conf, folder: str) -> None:
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(conf).delete(path, True)
