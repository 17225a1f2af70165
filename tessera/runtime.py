"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a counted side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes of its long columns (texts, arrays) up to which it may be.
BROADCAST_BYTES = 64_000_000
_SHORT = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "decimal")


def session(app: str = "tessera", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each context, so that their Python finds it."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"{here.name}/{p.relative_to(here)}")
    sc.addPyFile(str(target))
    sc._tessera_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of parts) of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as the cluster runs tasks: files with few splits would leave cores idle."""
    parallel = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parallel) if df.rdd.getNumPartitions() < parallel else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder with a local master; an error on a cluster."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir()


_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors.

    The tables are deleted by clean(), at the latest when this process ends with its session still open.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(clean)
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(f"{path}/{name}")
    return spark.read.schema(df.schema).parquet(f"{path}/{name}")


def clean() -> None:
    """Deletes all tables that materialize has written; what was built on them can't be read any more."""
    sc = SparkContext._active_spark_context
    if sc is None or sc._jsc is None:
        return
    try:
        while _WRITTEN:
            path = sc._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the gateway may be gone when the interpreter ends
        _WRITTEN.clear()


def counted_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows and BROADCAST_BYTES bytes, else df as it is, so that the join shuffles.

    Rows are counted here unless given. Bytes are counted too where a column can be long; rows of
    numbers alone are bounded by their number.
    """
    long = [c for c, kind in df.dtypes if not kind.startswith(_SHORT)]
    if rows is not None and (rows > limit or not long):
        return F.broadcast(df) if rows <= limit else df
    size = F.sum(sum((F.coalesce(F.octet_length(F.to_json(F.struct(c)) if kind.startswith(("array", "map", "struct")) else F.col(c)), F.lit(0)) for c, kind in df.dtypes if c in long), F.lit(0))) if long else F.lit(0)
    n, size = df.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if n <= limit and size <= BROADCAST_BYTES else df


def running_total(df: DataFrame, by: list[str], order: str, n: str | None = None, out: str = "before") -> DataFrame:
    """df with the sum of n (or the number) of the rows before each one in its group, by `order`, which must not repeat within a group.

    Rows are dealt to ranges of (by, order); sums of whole ranges come from a table of one row a
    group and range, so no group is ever in one task.
    """
    add = F.col(n) if n else F.lit(1)
    dealt = materialize(df.repartitionByRange(*by, order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*by, "__range").agg(F.sum(add).alias("__sum"))
    w = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(w), F.lit(0))).drop("__sum")
    inner = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("__inner", F.coalesce(F.sum(add).over(inner), F.lit(0)))
    left, right = dealt.alias("l"), sums.alias("r")
    same = [F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}")) for b in [*by, "__range"]]
    cond = same[0]
    for x in same[1:]:
        cond = cond & x
    return left.join(F.broadcast(right) if by == [] else right, cond).select(*[f"l.{c}" for c in df.columns], (F.col("l.__inner") + F.col("r.__base")).cast("long").alias(out))


def first_delivery(df: DataFrame, keys: list[str], at: str = "ingested_at") -> DataFrame:
    """One row for each key: the earliest delivery (null times last, then by the row's hash, so the choice is fixed).

    Keys are counted first, on their own; only rows of repeated keys are shuffled and ranked, all
    others pass as they were read. A null key is a key like any other.
    """
    repeated = materialize(df.groupBy(*keys).count().where("count > 1").select(*[F.col(k).alias(f"__{k}") for k in keys]), "repeated")
    some = counted_broadcast(repeated)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    order = [F.col(at).asc_nulls_last()] if at in df.columns else []
    w = Window.partitionBy(*keys).orderBy(*order, F.xxhash64(*[F.col(c) for c in df.columns if c != at and "map" not in dict(df.dtypes)[c]]))
    again = df.join(some, same, "left_semi").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return spread(df.join(some, same, "left_anti").unionByName(again))
