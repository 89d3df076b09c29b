"""Stage tables: intermediate results written once to the folder all executors share.

A stage table cuts the lineage (a lost executor costs no recomputation of earlier stages), is computed
once however often it is read, keeps column pruning and filter pushdown, and tells the planner its real
size, so that the choice between a broadcast and a shuffled join rests on a measured number.

Stage tables stay until the folder is emptied, or until the block ends that `stage_tables` opened:

    with stage_tables(spark):
        export_study(Study.of_accounts(...), folder)
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

_written: ContextVar[tuple[list[str], ...]] = ContextVar("stage_paths", default=())
_choosing_folder = Lock()


def stage_folder(spark: SparkSession) -> str:
    """The folder the session names; only a local session may fall back to a temporary one."""
    with _choosing_folder:
        folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="langshift-stages-")
            spark.conf.set(CHECKPOINT_SETTING, folder)
        return folder


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the stage folder."""
    path = f"{stage_folder(spark)}/langshift-{name}-{uuid.uuid4().hex}"
    for paths in _written.get():
        paths.append(path)
    return path


def materialise(frame: DataFrame, name: str = "stage") -> DataFrame:
    """Write the frame as a stage table and continue from the written rows."""
    spark = frame.sparkSession
    path = stage_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def together(*steps: Callable[[], DataFrame]) -> list[DataFrame]:
    """What the steps return; the jobs they run are submitted side by side.

    A stage leaves cores idle while its last tasks finish and its files are committed, and the other steps' tasks use them.
    The steps must not need the same table unless it is there already.
    """
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inherit(copy_context().run), step) for step in steps]
        return [result.result() for result in running]


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Remove the stage tables that are written inside the block when it ends; gives their paths.

    Nothing else in the folder is touched.  Frames built on them must have been used or written elsewhere by then.
    """
    paths: list[str] = []
    token = _written.set((*_written.get(), paths))
    try:
        yield paths
    finally:
        _written.reset(token)
        jvm, settings = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(settings).delete(place, True)
