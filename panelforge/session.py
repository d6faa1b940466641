"""Session helpers: one builder for tests and benches, shipping of the package, the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_shipped: set[str] = set()
#: A writer's options for tables whose rows are blocks of about a megabyte. Spark's reader holds as many rows at once as a row
#: group has, up to 4,096, so without a limit a task holds all the blocks of its split, two or three times over.
BLOCKS = {"parquet.block.row.count.limit": "4"}
#: What the scratch around this thread's (or task's) work has to delete in the end; None outside of one.
_works: ContextVar[list[Work] | None] = ContextVar("works", default=None)


def build(cpus: int | str = "*", partitions: int = 8, name: str = "panelforge", **conf: str) -> SparkSession:
    """A local session with the settings that tests and benches share."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    return SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="spark-")) / "panelforge_ship.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, an own one if everything
    runs in this process; a cluster's executors would each write to their own disk, so there it must be set."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _own[app]


def plain_unions(spark: SparkSession) -> None:
    """Let no union claim its inputs' partitioning. Spark 4.1 zips the inputs then, and fails where adaptive execution
    has coalesced them into unequal numbers of partitions."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


class Work:
    """Tables written into the shared folder to cut a plan: they survive the loss of any executor."""

    def __init__(self, spark: SparkSession):
        plain_unions(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/panelforge/{uuid.uuid4().hex}"
        if (held := _works.get()) is not None:
            held.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str, partition_by: str | None = None, codec: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
        """Write df and read it back, so that nothing above recomputes it."""
        w = df.write.option("compression", codec).options(**options or {})
        (w.partitionBy(partition_by) if partition_by else w).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no live plan reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(n))
            p.getFileSystem(conf).delete(p, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Delete, in the end, what every Work made inside by this thread has written. What is read later must be written
    before that, by a Work from outside."""
    held: list[Work] = []
    before = _works.set(held)
    try:
        yield
    finally:
        _works.reset(before)
        for w in held:
            w.drop("")


@contextmanager
def kept() -> Iterator[None]:
    """What is written inside outlives any scratch around it."""
    before = _works.set(None)
    try:
        yield
    finally:
        _works.reset(before)
