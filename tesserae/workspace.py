"""Shared scratch folder and written intermediate tables.

Iterative operators cut their lineage by writing a Parquet table into the folder that the cluster names in
``spark.checkpoint.dir``; every executor can read it again, so a lost executor costs a re-read and not a recomputation.
Written tables also give the planner true sizes, on which its broadcast decisions rest.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's setting, or one of our own where it is unset."""
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="tesserae-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="tesserae-code-")) / "tesserae.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may already be gone; the folder is scratch
        pass


class Workspace:
    """Tables written by one run of an operator.

    ``write`` materialises a frame and returns a scan of it; ``drop`` removes tables that no later frame reads.
    What is still there when Python ends is removed then. ``free_shuffles``: the shuffle files of a table are removed once it is
    written; else they stay until the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, name: str, free_shuffles: bool = False):
        ship(spark)
        self.free_shuffles = free_shuffles
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, self.root)

    @contextlib.contextmanager
    def freeing(self) -> Iterator[None]:
        """What is run inside leaves no shuffle files, if ``free_shuffles`` asks for that."""
        if not self.free_shuffles:
            yield
            return
        before = self.spark.conf.get(_FREE, "false")
        self.spark.conf.set(_FREE, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_FREE, before)

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.root}/{tag}-{uuid.uuid4().hex[:8]}"
        with self.freeing():
            df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._workspace_path = path  # type: ignore[attr-defined]
        return back

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            path = getattr(f, "_workspace_path", None)
            if path:
                _remove(self.spark, path)
