"""Session settings and shipping of this package to executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of one Arrow batch between the JVM and Python. Spark's 64 MB are held several times over beside the heap (a vector that grows, the message, the result)
#: and again in the worker, for each core. Sessions that set a size of their own keep it.
BATCH_BYTES_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

_shipped: set[str] = set()
_own_folder: str | None = None


def session(app: str = "cairn", **settings: str) -> SparkSession:
    """A session with the settings the operators are written for; further settings may follow."""
    builder = SparkSession.builder.appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.ui.showConsoleProgress": "false", BATCH_BYTES_KEY: BATCH_BYTES}
    return builder.config(map=base | settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package's code to the executors' Python workers, once for each application, and bound the batches they get."""
    if spark.conf.get(BATCH_BYTES_KEY, None) is None:
        spark.conf.set(BATCH_BYTES_KEY, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="cairn-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/cairn_code.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(f"{folder}/cairn_code.zip")
    _shipped.add(app)


def shared_folder(spark: SparkSession, label: str) -> str:
    """The name of a new folder that driver and executors share.

    It lies in `spark.checkpoint.dir`. Where that setting is missing and the session runs in one
    process (tests) a temporary folder is made once for it and removed at its end; on a cluster
    that would be another disk on each machine, so there it is an error.
    """
    global _own_folder
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="cairn-")
            atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
        root = f"file://{_own_folder}"
    return f"{root.rstrip('/')}/cairn/{label}-{uuid.uuid4().hex}"
