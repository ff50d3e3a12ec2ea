"""Session-level helpers: checkpoints, size-checked broadcasts, partition counts."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: A side is broadcast only when it was counted and has at most this many rows, and its rows at most this many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: The application whose workers have this package.
SHIPPED: dict[str, str] = {}
#: Bytes that a value of a type of fixed size takes in a row; texts and the like are measured.
FIXED_BYTES = 8


def session(app: str = "loomline", master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings this engine is tested with."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once a session; workers may have no copy on their path.

    The archive lies in the shared folder named by the cluster. Where none is named it is served by the
    driver from a folder of its own.
    """
    sc = spark.sparkContext
    if SHIPPED.get("app") == sc.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for at, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.join("loomline", os.path.relpath(os.path.join(at, f), root)))
    if sc._jsc.sc().getCheckpointDir().isDefined() or shared_conf(spark):
        path = f"{shared_folder(spark, 'code')}/loomline-{sc.applicationId}.zip"
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(data.getvalue()))
        out.close()
    else:
        folder = tempfile.mkdtemp(prefix="loomline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, f"loomline-{sc.applicationId}.zip")
        with open(path, "wb") as f:
            f.write(data.getvalue())
    sc.addPyFile(path)
    SHIPPED["app"] = sc.applicationId


def shared_conf(spark: SparkSession) -> str | None:
    return spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; a local folder only where none is set (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    shared = shared_conf(spark)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), f"loomline-checkpoints-{os.getuid()}")
    spark.sparkContext.setCheckpointDir(shared)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder beside the checkpoints, removed when the driver ends."""
    ensure_checkpoint_dir(spark)
    jvm, path = spark.sparkContext._jvm, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; it survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured(df: DataFrame) -> Column:
    """Bytes of a row: fixed-size columns by their count, the rest by the length of their text."""
    size = F.lit(FIXED_BYTES * (len(df.columns) + 1)).cast("long")
    for f in df.schema:
        if isinstance(f.dataType, (StringType, BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
    return size


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table may be broadcast. Reads no more than ``rows + 1`` of its rows."""
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(measured(df))).first()
    return n <= rows and (total or 0) <= size


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side that is usually small: broadcast if its counted rows and bytes allow, else by shuffle.

    The count stops after ``limit + 1`` rows, so it stays cheap however large ``right`` is. Beyond the
    limit the join is left to Catalyst, where AQE splits skewed keys of ``left``.
    """
    return left.join(F.broadcast(right) if is_small(right, limit) else right, on, how)
