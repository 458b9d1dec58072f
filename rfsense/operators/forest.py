"""Segment classifier: random forest on segment features, or the count rule for too few segments."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rfsense.operators.evaluate import metrics
from rfsense.operators.segment import SEGMENT_FEATURES
from rfsense.session import materialise

SEED = 42


BINS = 1 << 16


def split(labelled: DataFrame, share: float = 0.3, by: str = "phase", keys: tuple[str, ...] = ("device_id", "phase", "start_pos")) -> DataFrame:
    """Stratified split: of every class exactly ``round(share * n)`` rows (one at least of two or more), those whose keys hash lowest.

    The hash is stable, so reruns of lost tasks agree. The class's limit is found in a histogram of the hashes, and only the rows of the bin it falls into are ranked: no class is
    sorted in one task. Adds ``is_test``. Rows of one key share a hash; ties in the last bin go by the keys.
    """
    hashed = labelled.withColumn("_h", F.xxhash64(*keys, F.lit(SEED))).withColumn("_bin", F.shiftrightunsigned("_h", 64 - BINS.bit_length() + 1))
    bins = hashed.groupBy(by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_n").over(Window.partitionBy(by))
    wanted = F.greatest(F.floor(total * share + 0.5), F.when(total > 1, 1).otherwise(0))
    # At most BINS rows of each class.
    limits = bins.select(by, "_bin", (wanted - F.coalesce(F.sum("_n").over(upto), F.lit(0))).alias("_left"), "_n")
    placed = hashed.join(limits, [by, "_bin"])
    whole = placed.where((F.col("_left") >= F.col("_n")) | (F.col("_left") <= 0)).withColumn("is_test", F.col("_left") > 0)
    rank = F.row_number().over(Window.partitionBy(by, "_bin").orderBy("_h", *keys))
    part = placed.where((F.col("_left") < F.col("_n")) & (F.col("_left") > 0)).withColumn("is_test", rank <= F.col("_left"))
    return whole.unionByName(part).select(*labelled.columns, "is_test")


def segment_forest(features: DataFrame, trees: int = 100, depth: int = 5) -> tuple[DataFrame, DataFrame] | None:
    """(metrics, importances), or None below four segments or with one class only.

    Trained on the rows that ``split`` does not hold out; each segment feature has its importance.
    """
    data = features.withColumn("label", (F.col("phase") == "MOVEMENT").cast("double"))
    n, classes = data.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if n < 4 or classes < 2:
        return None
    data = materialise(split(data), "segments")  # trained on and counted
    data = VectorAssembler(inputCols=list(SEGMENT_FEATURES), outputCol="x").transform(data)
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED).fit(
        data.where("not is_test"))
    spark = features.sparkSession
    pred = model.transform(data.where("is_test"))
    hit, pos = F.col("prediction") == F.col("label"), F.col("label") == 1.0
    counts = pred.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("tn"),
                      F.count_if(~hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"))
    tested = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    imp = spark.createDataFrame([(model.featureImportances,)], ["v"]).select(
        F.posexplode(vector_to_array("v")).alias("i", "importance"))
    names = F.array(*[F.lit(f) for f in SEGMENT_FEATURES])
    importances = imp.select(F.get(names, F.col("i")).alias("feature"), "importance")
    return metrics(counts).withColumn("n_test", tested).withColumn("n_train", F.lit(n) - tested), importances
