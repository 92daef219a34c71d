"""Session settings shared by tests, bench and local use."""
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus="*", shuffle_partitions=8, app="sparkvane"):
    """A local session with the settings the operators are written for."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def workers(spark):
    """Let Python workers import this package where the launcher did not put it on their path."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    have = env.get("PYTHONPATH", "")
    if root not in have.split(":"):
        env["PYTHONPATH"] = f"{root}:{have}" if have else root


def spread(df, *keys):
    """Hash-spread rows by `keys` where a scan has fewer partitions than the cluster has cores, as costly expressions over few large splits
    would leave cores idle; with enough splits nothing is shuffled."""
    want = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, *keys)


def table(spark, sf_dir, name):
    """The parquet table `name` of a data folder."""
    workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark):
    """The folder that all executors share: spark.checkpoint.dir, else the checkpoint folder set by the caller. A local session without
    either gets a folder under the warehouse; a cluster does not, as its warehouse may be a machine's own folder."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if where is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if where.startswith("file:/") and "://" not in where:
        where = "file://" + where.removeprefix("file:")
    return where.rstrip("/")


def checkpoint(df):
    """Cut lineage through the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
