"""Reading speeds and graphs, writing results and artifacts."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMPORTANCE = "variant string, horizon_min int, importance_type string, feature_group string, mean_importance double, sum_importance double, n_columns bigint, n_models_with_feature bigint, selected_count bigint, selected_count_norm double"
ARTIFACTS = ("gain", "params", "train_probs")


def sensor_columns(wide: DataFrame) -> list[str]:
    """Sensors of a wide frame: all columns but the first."""
    return wide.columns[1:]


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV (first column the time, whatever its name; then one column a sensor); empty cells are null."""
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField("ts", T.TimestampNTZType())] + [T.StructField(n, T.DoubleType()) for n in names[1:]])
    return spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def to_long(wide: DataFrame) -> DataFrame:
    """readings(ts, sid, speed) of a wide frame, empty cells included."""
    first = wide.columns[0]
    return wide.unpivot([first], sensor_columns(wide), "sid", "speed").withColumnRenamed(first, "ts")


def to_wide(readings: DataFrame, sids: list[str]) -> DataFrame:
    return readings.groupBy("ts").pivot("sid", sids).agg(F.first("speed"))


def write_wide(readings: DataFrame, sids: list[str], path: str) -> None:
    to_wide(readings, sids).write.option("header", True).csv(path)


def read_graph(spark: SparkSession, edges_path: str, sensors_path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame] | None:
    """(edges, sensors), or None if there is no graph at the path.

    The edge file is an edge list (src, dst, weight) or a dense matrix: a first column with
    the row's sensor, then a column for each sensor; zero weights are no edges.
    """
    try:
        edges = spark.read.format(fmt).option("header", True).option("inferSchema", True).load(edges_path)
        sensors = spark.read.format(fmt).option("header", True).option("inferSchema", True).load(sensors_path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if set(edges.columns) != {"src", "dst", "weight"}:
        edges = matrix_to_edges(edges)
    return edges.where("weight <> 0"), sensors


def matrix_to_edges(matrix: DataFrame) -> DataFrame:
    first = matrix.columns[0]
    long = matrix.unpivot([first], matrix.columns[1:], "dst", "weight").withColumnRenamed(first, "src")
    return long.select(F.col("src").cast("string").alias("src"), "dst", F.col("weight").cast("double").alias("weight")).where("weight <> 0")


def stamped(folder: str, name: str, now: datetime | None = None) -> str:
    """A path for one run's output."""
    return f"{folder}/{name}/run_ts={(now or datetime.now()):%Y%m%d_%H%M%S}"


def append_results(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    rows.write.mode("append").option("header", True).format(fmt).save(path)


def write_choices(rows: DataFrame, path: str) -> None:
    """Choices as JSON lines, fields in order of their names."""
    rows.select(*sorted(rows.columns)).write.mode("append").option("ignoreNullFields", False).json(path)


def save_artifacts(path: str, gain: DataFrame, params: DataFrame, train_probs: DataFrame, horizons: dict[str, DataFrame] | None = None) -> None:
    """What a transfer job needs of a global job, as tables partitioned by transition weight; horizons are tables on what its horizons have in common."""
    tables = dict(zip(ARTIFACTS, (gain, params, train_probs), strict=True)) | (horizons or {})
    for name, rows in tables.items():
        rows.write.mode("overwrite").partitionBy("transition_weight").parquet(f"{path}/{name}")


def load_artifacts(spark: SparkSession, path: str, weight: float | None = None) -> dict[str, DataFrame]:
    """The tables by name, of one weight if given; a missing table is an error."""
    out = {}
    for name in ARTIFACTS:
        try:
            rows = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as missing:
            raise FileNotFoundError(f"no {name} at {path}: run the global job first") from missing
        rows = rows.withColumn("transition_weight", F.col("transition_weight").cast("double")).withColumn("sid", F.col("sid").cast("string"))
        out[name] = rows if weight is None else rows.where(F.col("transition_weight") == weight)
    return out


def write_importance(rows: DataFrame | None, spark: SparkSession, path: str) -> None:
    """The importance report as CSV; without rows, a file with the header alone."""
    rows = spark.createDataFrame([], IMPORTANCE) if rows is None else rows
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
