"""Session helpers: building a session, the shared scratch folder, checked broadcasts.

Nothing here changes query semantics; it only decides *where* intermediate
tables live and *whether* a small side may be broadcast.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

# Rows and bytes above which a side is never broadcast.
DEFAULT_BROADCAST_MAX_ROWS = 2_000_000
DEFAULT_BROADCAST_MAX_BYTES = 256 << 20
# File bytes of an under-split source per partition.
BALANCED_BYTES = 16 << 20
# File bytes that a step shuffles at a time where it can go over a written table in passes, and how often it may.
PASS_BYTES = 64 << 20
MOST_PASSES = 8
# Spark drops an execution's shuffle files when it ends (4.1 on; earlier versions do not know the name).
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "skillsift",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Local/test session with the settings the operators assume (AQE on, UTC)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.driver.memory": os.environ.get("SKILLSIFT_DRIVER_MEMORY", "16g"),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, reading it from the session.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/...) folder and
    is used as is; without it a cluster session is refused, since each executor would write
    to a disk of its own. Only a local session without it gets a fresh temp folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="skillsift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_SHIPPED: set[str] = set()
_OWN: dict[str, list[str]] = {}               # application -> scratch folders it made


def ship_package(spark: SparkSession) -> None:
    """Make ``skillsift`` importable in executor Python workers (needed by the one pandas UDF).

    Zips the package once per SparkContext and registers it with ``addPyFile``,
    exactly what ``--py-files`` does at submit time (set SKILLSIFT_NO_SHIP=1 when the
    package is shipped that way). The zip goes under the checkpoint folder when
    that is a local path, else into a driver-side temp file that Spark
    distributes itself.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or os.environ.get("SKILLSIFT_NO_SHIP"):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = ensure_checkpoint_dir(spark)
    local = base[len("file:"):] if base.startswith("file:") else (base if "://" not in base else None)
    folder = os.path.join(local, "skillsift-py") if local else tempfile.mkdtemp(prefix="skillsift-py-")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"skillsift-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return own_scratch(spark, f"{base}/skillsift/{name}-{uuid.uuid4().hex[:12]}")


def own_scratch(spark: SparkSession, path: str) -> str:
    """Note a folder as this application's, for ``clean_scratch``."""
    _OWN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders this application made; returns how many were there.

    For the end of a job, when its results are written elsewhere: frames that read scratch
    tables fail afterwards. Folders of other applications are never touched."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for path in _OWN.pop(spark.sparkContext.applicationId, []):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(p.getFileSystem(conf).delete(p, True))
    return gone


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    """Delete a scratch table that was written by ``materialize`` and is read no more; other tables stay."""
    own = _OWN.get(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}       # scratch names are unique (``scratch_path``)
    for path in [o for o in own if o.rsplit("/", 1)[-1] in folders]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        own.remove(path)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes made inside leave no shuffle files behind: what they wrote is read from its table from then on."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def materialize(df: DataFrame, spark: SparkSession | None = None, name: str = "stage",
                path: str | None = None, mode: str = "overwrite") -> DataFrame:
    """Write ``df`` once to the shared folder (or to ``path``) as Parquet and read it back.

    Cuts lineage (a lost executor re-reads files instead of recomputing the
    upstream plan) and lets later stages see exact file statistics. The shuffle files of
    the write are dropped with its end, so the disk holds the shuffles of one step at a time.
    """
    spark = spark or df.sparkSession
    path = path or scratch_path(spark, name)
    with dropped_shuffles(spark):
        df.write.mode(mode).option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def passes_over(df: DataFrame, most: int = MOST_PASSES) -> int:
    """How many parts of a written table, taken one after the other, keep a step's shuffles small."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(most, -(-size // PASS_BYTES)))


def in_pass(key: str, i: int, passes: int) -> Column:
    """Rows of pass ``i``: a key's rows are in one pass, null is a key."""
    return F.pmod(F.xxhash64(key), F.lit(passes)) == i


def row_bytes(df: DataFrame):
    """Bytes of one row, estimated from its values: text and binary by length, nested values by their JSON."""
    total = F.lit(8 * len(df.columns) + 16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return total


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_MAX_ROWS,
                      known_rows: int | None = None, max_bytes: int = DEFAULT_BROADCAST_MAX_BYTES,
                      known_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only if it is proven to have at most ``max_rows`` rows and ``max_bytes`` bytes.

    One aggregate over at most ``max_rows + 1`` rows is the proof; pass ``known_rows`` (and
    ``known_bytes``) when the caller already has bounds. Rows alone are a proof only where every
    column has a fixed width or the caller's bound covers them. Returns ``(frame, broadcasted)``; beyond
    a bound the frame is returned untouched and the planner shuffles it.
    """
    if known_rows is None:
        n, size = df.limit(max_rows + 1).select(row_bytes(df).alias("b")).agg(
            F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    else:
        n, size = known_rows, known_bytes or 0
    if n <= max_rows and size <= max_bytes:
        return F.broadcast(df), True
    return df, False


def balance(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """Spread an under-split *source scan* over the cluster's task slots.

    A source made of fewer files than ``spark.default.parallelism`` (e.g. one
    large single-row-group Parquet file) would run all per-row work --
    tokenising, exploding, partial aggregation -- in one task. Such a source is
    hash-repartitioned on ``key`` (deterministic on task retry). A source of
    many files, as any large table on a cluster is, is returned unchanged. The
    file list comes from the driver-side listing; no job runs.

    The number of partitions grows with the source's bytes, so a task's share does not: per-row
    work that explodes and groups its rows then fits in memory at any size.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    want = max(min_partitions or spark.sparkContext.defaultParallelism, -(-size // BALANCED_BYTES))
    if len(df.inputFiles()) >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(want, key) if key else df.repartition(want)
