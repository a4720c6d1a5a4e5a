"""Where jobs put tables they write and read back."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new path below the shared folder the session names in ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary folder,
    which no other machine has to see. The folder goes when the session's JVM ends in order.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="defectloom-")
    path = f"{base.rstrip('/')}/defectloom/{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    system.deleteOnExit(folder)
    return path
