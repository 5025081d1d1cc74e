"""Session settings the operators expect."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# A scan gives about one task per this many bytes; less input leaves cores idle.
_SPLIT_BYTES = 4 << 20


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kinfold")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only where none is set.

    Executors on other machines would not see the private one, so a session that
    is not local must name a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kinfold-"))
    return context.getCheckpointDir()


_open_scratch: dict[int, list[Scratch]] = {}  # by thread


class Scratch:
    """The tables written while it was open; see ``scratch``."""

    def __init__(self) -> None:
        self.written: list[tuple[DataFrame, str]] = []
        self.kept: list[tuple[DataFrame, str]] = []

    def __call__(self, table: DataFrame) -> DataFrame:
        """Keep a table that ``materialize`` returned."""
        self.kept += [entry for entry in self.written if entry[0] is table]
        return table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes, on leaving, the tables that ``materialize`` wrote inside, but those it was called with.

    For work whose results are numbers or one written table: what a loop writes on the
    way does not pile up in the shared folder. Kept tables belong to the scratch around
    it, if there is one. After an error everything is deleted.
    """
    own = Scratch()
    open_here = _open_scratch.setdefault(threading.get_ident(), [])
    open_here.append(own)
    try:
        yield own
    except BaseException:
        own.kept = []
        raise
    finally:
        open_here.remove(own)
        around = list(open_here)
        if not open_here:
            del _open_scratch[threading.get_ident()]
        for entry in own.written:
            if any(entry is kept for kept in own.kept):
                if around:
                    around[-1].written.append(entry)
            else:
                _delete(spark, entry[1])


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage, survives lost executors, and keeps column pruning and
    filter pushdown for the plans that read it several times. The table stays until
    the ``scratch`` it was written in ends, or for good where there is none.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/kinfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    for own in _open_scratch.get(threading.get_ident(), [])[-1:]:
        own.written.append((table, path))
    return table


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input to every core before costly per-row work.

    A table of few splits would run it on few cores. An input with more splits
    than cores, by the optimizer's size estimate, is returned as it is.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if size >= cores * _SPLIT_BYTES else df.repartition(cores)
