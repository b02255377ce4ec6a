"""Session helpers: one place for the SparkSession settings and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: Bytes of generated code above which a stage runs operator by operator. The JVM compiles no method
#: above 8000 bytes: the wide projections (about 80 features) would run interpreted as one whole stage.
HUGE_METHOD = 8000


def limit_generated_code(spark: SparkSession) -> None:
    """The limit for a session made elsewhere; results don't depend on it."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(HUGE_METHOD))


def get_session(master: str | None = None, partitions: int = 8, app: str = "lodgeprice") -> SparkSession:
    """Return (or create) a session with AQE, skew-join handling and UTC time.

    On a cluster the master and the shuffle width come from spark-submit; the
    defaults here are for local tests.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", str(HUGE_METHOD))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", "16g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """URI of the shared folder for checkpoints and written intermediates.

    Uses the folder that the session already names (``spark.checkpoint.dir``).
    Only a local master, whose executors share the driver's disk, gets a fresh
    folder of its own; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="lodgeprice-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique URI inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
