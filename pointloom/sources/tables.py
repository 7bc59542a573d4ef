"""Reading localization tables, and writing results, samples and reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.localizations import normalize


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests) gets a temporary folder; on a cluster that would lose tables, so there it
    is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pointloom-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage: executors that are lost later cost no more than the work that follows.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """``df``, a table of rows, as a side of a join that isn't broadcast.

    Spark takes a scanned table for as large as its files, which are compressed: rows of a few MB of files are many
    times that in the driver.
    """
    return df.hint("merge")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds ``name``, 0 to n - 1 in the order of the input's splits.

    Dense numbers leave room for ids made from them (a partition's is a million times a row's). Each split is counted
    and starts after those before it; what is broadcast is one row a split. Settle the result if it is read more than
    once by plans that may split the input differently.
    """
    m = df.withColumn("_m", F.monotonically_increasing_id()).withColumn("_split", F.shiftright("_m", 33))
    sizes = m.groupBy("_split").agg(F.count("*").alias("_n"))
    start = sizes.select("_split", (F.sum("_n").over(Window.orderBy("_split")) - F.col("_n")).alias("_start"))
    n = F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return m.join(F.broadcast(start), "_split").withColumn(name, n).drop("_split", "_m", "_start")


def read_locs(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """A localization table with the columns the operators need; rows without a loc_id are numbered."""
    df = normalize(spark.read.format(format).options(**options).load(path))
    return df if "loc_id" in df.columns else numbered(df, "loc_id")


EMITTER_CSV = {"x": "x_um", "y": "y_um", "sigma_x": "sigma_x_um", "sigma_y": "sigma_y_um", "sigma_xy": "sigma_xy", "n": "photons"}


def write_emitters_csv(emitters: DataFrame, path: str) -> None:
    emitters.select(*[F.col(a).alias(b) for a, b in EMITTER_CSV.items()]).write.csv(path, header=True)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """One flat record."""
    metrics.write.json(path)


def write_table_csv(table: DataFrame, path: str) -> None:
    table.write.csv(path, header=True)


def summary_lines(metrics: DataFrame) -> DataFrame:
    """A readable line for each metric of a one-row table."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("n/a"))).alias("value")) for i, c in enumerate(metrics.columns)])
    return metrics.select(F.explode(pairs).alias("p")).select("p.i", "p.value")


def write_summary(metrics: DataFrame, path: str) -> None:
    summary_lines(metrics).orderBy("i").select("value").write.text(path)


#: Folders of an archive that partitions are dealt to.
BUCKETS = 64


def _bucket(partition_id) -> Column:
    return F.pmod(F.xxhash64(partition_id), F.lit(BUCKETS)).cast("int")


def archive_samples(samples: DataFrame, hyper: DataFrame, path: str, spatial_model: str, sync: int) -> None:
    """Add samples and the shared parameters, with the spatial model they were drawn under.

    A write replaces what the archive has of ``sync`` (for samples: of the partitions that it has rows for), so a job
    that is run again leaves one copy of its samples. Partitions are kept in ``BUCKETS`` folders by a hash, sorted, so
    an archive has as many files however many partitions there are, and one partition is read from one folder.
    """
    spark, kept = samples.sparkSession, f"{path}/samples"
    put = lambda df, by, to: df.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{to}")
    new = samples.withColumns({"bucket": _bucket(F.col("partition_id")), "sync": F.lit(sync)})
    old = _table(spark, kept)
    if old is not None and (before := old.filter(F.col("sync") == sync)).take(1):
        # partitions that this write has no rows for stay
        rest = before.join(samples.select("partition_id").distinct(), "partition_id", "left_anti").select(*new.columns)
        new = settle(rest.unionByName(new), "archive")
    put(new.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "partition_id"), ["bucket", "sync"], "samples")
    put(hyper.withColumns({"spatial_model": F.lit(spatial_model), "sync": F.lit(sync)}), ["sync"], "hyper")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None if there isn't one yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def read_archive(spark: SparkSession, path: str, partition_id: int | None = None) -> DataFrame:
    """Samples of all partitions, or of one: then only its folder is read."""
    df = spark.read.parquet(f"{path}/samples")
    if partition_id is not None:
        kind = df.schema["partition_id"].dataType
        df = df.filter((F.col("bucket") == _bucket(F.lit(partition_id).cast(kind))) & (F.col("partition_id") == partition_id))
    return df.drop("bucket", "sync")


def replay(spark: SparkSession, path: str, aggregate, needs_spatial_model: bool = False, spatial_model: str | None = None) -> DataFrame:
    """Run an aggregation over archived samples. One that needs the spatial model must be given the archive's."""
    if needs_spatial_model:
        kept = {r["spatial_model"] for r in spark.read.parquet(f"{path}/hyper").select("spatial_model").distinct().collect()}
        if spatial_model is None or {spatial_model} != kept:
            raise ValueError(f"this aggregation needs the spatial model of the archive, one of {sorted(kept)}")
    return aggregate(read_archive(spark, path))
