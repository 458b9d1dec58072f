"""Saved calibration models and configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfsense.operators.calibrate import valid_models

MODEL_COLUMNS = ("device_id", "rank", "feature_idx", "feature", "weight", "feat_min", "feat_max", "threshold")


def save_model(mdl: DataFrame, summ: DataFrame, path: str, version: int = 1) -> None:
    """Write models that pass the storage gate, sorted by device so that a lookup reads few files."""
    ok = valid_models(mdl, summ).where("valid_stored").select("device_id")
    rows = mdl.join(summ.select("device_id", "threshold"), "device_id").join(ok, "device_id", "left_semi")
    rows.select(*MODEL_COLUMNS, F.lit(version).alias("version")).repartitionByRange("device_id").sortWithinPartitions(
        "device_id", "rank").write.parquet(path)


def load_model(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Models of this version that pass the apply gate."""
    rows = spark.read.parquet(path).where(F.col("version") == version)
    summ = rows.groupBy("device_id").agg(F.max("threshold").alias("threshold"))
    ok = valid_models(rows, summ).where("valid_applied").select("device_id")
    return rows.join(ok, "device_id", "left_semi")


def save_config(configs: DataFrame, path: str) -> None:
    configs.repartitionByRange("device_id").sortWithinPartitions("device_id").write.parquet(path)


def load_config(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    from rfsense.operators.control import repair

    return repair(spark.read.parquet(path), version).where("usable")
