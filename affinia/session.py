"""Sessions and shared storage.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which every executor shares. Without that
setting a folder of this machine is used where Spark runs on this machine alone, as in tests; a cluster is refused.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def local_session(cores: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    s = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("affinia")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or one of our own where the session names none and has no executors elsewhere."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="affinia-"))
    return _own[0]


def _mine(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/affinia/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_mine(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has put into the shared folder; results that still read it must be written first."""
    _delete(spark, _mine(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, on files that outlive any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._affinia_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files behind a table made by stored() that no later step reads."""
    path = getattr(df, "_affinia_path", None)
    if path:
        _delete(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Run:
    """A job in a thread of its own, which can be asked how far it is and told to stop."""

    def __init__(self, spark: SparkSession, tag: str, job: Callable[[], object]):
        from pyspark import InheritableThread

        self.spark, self.tag, self.result, self.error = spark, tag, None, None

        def work():
            sc = spark.sparkContext
            sc.addJobTag(tag)
            sc.setJobGroup(tag, tag, interruptOnCancel=True)
            try:
                self.result = job()
            except Exception as e:  # told by wait()
                self.error = e
            finally:
                sc.removeJobTag(tag)

        self._thread = InheritableThread(target=work)
        self._thread.start()

    def progress(self) -> tuple[int, int]:
        """(finished tasks, all tasks) of the stages that Spark knows of this run."""
        t = self.spark.sparkContext.statusTracker()
        jobs = [t.getJobInfo(j) for j in t.getJobIdsForGroup(self.tag)]
        stages = [t.getStageInfo(s) for j in jobs if j for s in j.stageIds]
        return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def wait(self):
        """The job's result, or its error."""
        self._thread.join()
        if self.error:
            raise self.error
        return self.result


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Arrow batches for Python workers, bounded by rows and by bytes, so that long texts cannot pile up.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's batch sizes to BATCH, once and alike for all operators: Spark reads them when a plan runs."""
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))
