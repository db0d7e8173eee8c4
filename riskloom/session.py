"""Session settings and durable storage used by multi-step jobs."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master: str | None = None, app: str = "riskloom", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, RocksDB state)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        # no call-site capture per Column: building a wide plan is several times faster
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The reliable folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the
    executors would not see it, so a missing setting is an error there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="riskloom-")
        context.setCheckpointDir(folder)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_meanwhile: ContextVar[list[str] | None] = ContextVar("_meanwhile", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; unique, so reruns never meet old data."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _meanwhile.get() is not None:
        _meanwhile.get().append(path)
    return path


@contextmanager
def cleared(spark: SparkSession):
    """Deletes at the end what steps inside have put into new folders, for jobs that go through such steps again and again."""
    token = _meanwhile.set([])
    try:
        yield
    finally:
        paths = _meanwhile.get()
        _meanwhile.reset(token)
        for path in paths:
            remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage, on whatever file system it is."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage without relying on executors, computes ``df`` once, and gives later
    joins real sizes to plan with.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` persisted in the partitions and the order it has without, so that sums over its rows stay what they are."""
    conf, name = df.sparkSession.conf, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return df.persist()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, partition by partition, for steps whose result depends on these."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
