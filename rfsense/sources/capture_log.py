"""Text capture log: one ``CSI|PHASE|v1,v2,...`` line per packet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rfsense import constants as K

PHASES = ("BASELINE", "MOVEMENT")


def parse(lines: DataFrame, col: str = "value") -> DataFrame:
    """Phase and values of well-formed lines; blank lines, other tags and other phases are skipped."""
    parts = F.split(F.trim(F.col(col)), r"\|")
    ok = (F.size("_p") == 3) & (F.col("_p")[0] == "CSI") & F.col("_p")[1].isin(*PHASES)
    others = [c for c in lines.columns if c != col]
    return lines.withColumn("_p", parts).where(ok).select(
        *others, F.col("_p")[1].alias("phase"),
        F.transform(F.split(F.col("_p")[2], ","), lambda v: F.trim(v).cast("int")).alias("iq"))


def line(phase: Column, iq: Column, values: int = K.CAPTURE_VALUES) -> Column:
    return F.concat_ws("|", F.lit("CSI"), phase, F.array_join(F.slice(iq, 1, values), ","))


def render(packets: DataFrame, enabled: bool = True) -> DataFrame:
    """One line per packet of the two calibration phases; nothing when capturing is off."""
    df = packets.where(F.col("phase").isin(*PHASES) & F.lit(enabled))
    return df.select(line(F.col("phase"), F.col("iq")).alias("value"))


def write(packets: DataFrame, path: str, enabled: bool = True) -> None:
    render(packets, enabled).write.text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.readStream.text(path))
