"""Single-feature classification study: threshold search, confusion metrics, rankings.

One histogram per device, feature and phase carries everything: the threshold candidates
are its bucket edges, so the search and the confusion counts are cumulative sums over at
most a hundred buckets, not passes over the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rfsense.operators.layout import BROADCAST_ROWS, Profile, arrange
from rfsense.session import materialise

STEPS = 100


def skip_warmup(feats: DataFrame, rows: int = 10, keys: tuple[str, ...] = ("device_id", "phase"),
                piece_rows: int | None = None, profile: Profile | None = None) -> DataFrame:
    """Drop the first rows of every phase."""
    lay = arrange(feats, keys=keys, piece_rows=piece_rows, profile=profile)
    return lay.done(lay.df.withColumn("_p", lay.pos())).where(F.col("_p") >= rows).drop("_p")


def bucket(v: Column, lo: Column, step: Column) -> Column:
    """How many of the candidates lo + i*step (i = 1..99) do not exceed v."""
    b = F.when(step > 0, F.floor((v - lo) / step)).otherwise(0)
    b = F.greatest(F.lit(0), F.least(b, F.lit(STEPS - 1)))
    # The quotient can be off by one next to an edge; the edge itself decides.
    b = F.when(v < lo + b * step, b - 1).otherwise(b)
    return F.when((b < STEPS - 1) & (v >= lo + (b + 1) * step), b + 1).otherwise(b)


def histogram(values: DataFrame, group: tuple[str, ...] = ("device_id", "feature_idx", "feature")) -> DataFrame:
    """Counts per phase and value sums per bucket. ``values``: group, phase, value."""
    group = list(group)
    edge = values.groupBy(*group).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    edge = edge.withColumn("step", (F.col("hi") - F.col("lo")) / STEPS)
    move = F.col("phase") == "MOVEMENT"
    return (
        values.join(edge, group)
        .withColumn("bucket", bucket(F.col("value"), F.col("lo"), F.col("step")).cast("int"))
        .groupBy(*group, "lo", "hi", "step", "bucket")
        .agg(F.count_if(move).alias("m"), F.count_if(~move).alias("b"), F.sum("value").alias("s"))
    )


def wide_histogram(feats: DataFrame, names: Sequence[str], key: str = "device_id") -> DataFrame:
    """``histogram`` of many feature columns at once, without a row per feature and value.

    One aggregate finds the ranges of all features. The rows of a device then go with its ranges, as arrays, through numpy, which counts all
    features' buckets of a batch together; only filled buckets go on, and their sums over all batches are the histogram.
    """
    cells = [f(F.col(n)).alias(f"{a}{i}") for i, n in enumerate(names) for a, f in (("_lo", F.min), ("_hi", F.max))]
    ranges = feats.groupBy(key).agg(*cells).select(key, *(F.array(*(F.col(f"{a}{i}") for i in range(len(names)))).alias(a) for a in ("_lo", "_hi")))
    ranges = materialise(ranges, "ranges")  # one row per device
    small = F.broadcast(ranges) if ranges.count() <= BROADCAST_ROWS else ranges
    kind = feats.schema[key].dataType
    schema = pa.schema([(key, to_arrow_type(kind)), ("feature_idx", pa.int32()), ("bucket", pa.int32()), ("m", pa.int64()), ("b", pa.int64()), ("s", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, lo, hi = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("_v", "_lo", "_hi"))
            step = (hi - lo) / STEPS
            with np.errstate(divide="ignore", invalid="ignore"):
                at = np.where(step > 0, np.floor((v - lo) / step), 0.0)
            at = np.clip(np.nan_to_num(at), 0, STEPS - 1)
            at = np.where(v < lo + at * step, at - 1, at)  # as in ``bucket``
            at = np.where((at < STEPS - 1) & (v >= lo + (at + 1) * step), at + 1, at).astype(np.int64)
            devices = batch.column(key).dictionary_encode()
            cell = ((devices.indices.to_numpy(zero_copy_only=False)[:, None].astype(np.int64) * v.shape[1] + np.arange(v.shape[1])) * (STEPS + 1) + at + 1).reshape(-1)
            filled, where = np.unique(cell, return_inverse=True)
            move = np.repeat(batch.column("_move").to_numpy(zero_copy_only=False).astype(bool), v.shape[1])
            m, n = np.bincount(where, move, len(filled)).astype(np.int64), np.bincount(where, minlength=len(filled))
            rest, bucket_ = np.divmod(filled, STEPS + 1)
            device, feature = np.divmod(rest, v.shape[1])
            out = [devices.dictionary.take(pa.array(device)), feature, bucket_ - 1, m, n - m, np.bincount(where, v.reshape(-1), len(filled))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    rows = feats.select(key, F.coalesce(F.col("phase") == "MOVEMENT", F.lit(False)).alias("_move"), F.array(*names).alias("_v")).join(small, key)
    parts = rows.mapInArrow(count, f"{key} {kind.simpleString()}, feature_idx int, bucket int, m long, b long, s double")
    sums = parts.groupBy(key, "feature_idx", "bucket").agg(*(F.sum(c).alias(c) for c in ("m", "b", "s")))
    at = F.col("feature_idx")
    edged = sums.join(small, key).withColumns({"lo": F.get("_lo", at), "hi": F.get("_hi", at), "feature": F.get(F.array(*(F.lit(n) for n in names)), at)})
    return edged.withColumn("step", (F.col("hi") - F.col("lo")) / STEPS).select(key, "feature_idx", "feature", "lo", "hi", "step", "bucket", "m", "b", "s")


def splits(hist: DataFrame, group: tuple[str, ...] = ("device_id", "feature_idx", "feature")) -> DataFrame:
    """Every distinct split of a group's values by a candidate: its counts below and its spread.

    Candidates between two filled buckets split alike; the first of them, ``i``, stands for all.
    The lowest bucket has no split (null ``i``).
    """
    group = list(group)
    by = Window.partitionBy(*group)
    up = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    c = (
        hist.withColumn("i", (F.lag("bucket").over(by.orderBy("bucket")) + 1).cast("int"))
        .withColumn("b0", F.sum("b").over(up)).withColumn("m0", F.sum("m").over(up))
        .withColumn("s0", F.sum("s").over(up))
        .withColumn("nb", F.sum("b").over(by)).withColumn("nm", F.sum("m").over(by))
        .withColumn("ns", F.sum("s").over(by))
    )
    n, n0 = F.col("nb") + F.col("nm"), F.col("b0") + F.col("m0")
    n1 = n - n0
    gap = F.col("s0") / n0 - (F.col("ns") - F.col("s0")) / n1
    spread = (n0 / n) * (n1 / n) * gap * gap
    return c.withColumn("spread", F.when(F.col("i").isNotNull(), spread))


def otsu(hist: DataFrame, group: tuple[str, ...] = ("device_id", "feature_idx", "feature")) -> DataFrame:
    """Best threshold per group with the confusion counts at it (value >= threshold is positive).

    The first candidate whose spread reaches the maximum up to rounding wins; where all values
    are equal the midpoint is used and everything is positive.
    """
    group = list(group)
    c = splits(hist, tuple(group)).withColumn("_top", F.max("spread").over(Window.partitionBy(*group)))
    wins = (F.col("spread") > 0) & (F.col("spread") >= F.col("_top") * (1 - 1e-9))
    best = c.groupBy(*group).agg(
        F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.min("step").alias("step"),
        F.min("nb").alias("nb"), F.min("nm").alias("nm"),
        F.min(F.when(wins, F.struct("i", "b0", "m0"))).alias("w"))
    got = F.col("w").isNotNull()
    tn = F.when(got, F.col("w.b0")).otherwise(F.lit(0))
    fn = F.when(got, F.col("w.m0")).otherwise(F.lit(0))
    middle = (F.col("lo") + F.col("hi")) / 2
    return best.select(
        *group, F.when(got, F.col("lo") + F.col("w.i") * F.col("step")).otherwise(middle).alias("threshold"),
        (F.col("nm") - fn).alias("tp"), tn.alias("tn"), (F.col("nb") - tn).alias("fp"), fn.alias("fn"))


def metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, specificity, F1 and error balance in percent."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))

    def pct(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b * 100.0).otherwise(0.0)

    df = (
        counts.withColumn("accuracy", pct(tp + tn, tp + tn + fp + fn))
        .withColumn("precision", pct(tp, tp + fp)).withColumn("recall", pct(tp, tp + fn))
        .withColumn("specificity", pct(tn, tn + fp))
    )
    p, r = F.col("precision") / 100.0, F.col("recall") / 100.0
    fpr, fnr = pct(fp, tn + fp), pct(fn, tp + fn)
    return (
        df.withColumn("f1", F.when(p + r > 0, 2.0 * (p * r) / (p + r) * 100.0).otherwise(0.0))
        .withColumn("fp_rate", fpr).withColumn("fn_rate", fnr)
        .withColumn("balance", F.when(fpr > fnr, fpr / (fnr + 0.01)).otherwise(fnr / (fpr + 0.01)))
    )


def ranking(m: DataFrame) -> DataFrame:
    """Ranks by accuracy and F1, first wins on ties."""
    def rank(c: str) -> Column:
        return F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc(c), "feature_idx"))

    return m.withColumn("accuracy_rank", rank("accuracy")).withColumn("f1_rank", rank("f1"))


def best_features(m: DataFrame) -> DataFrame:
    """Best feature by accuracy, F1, specificity, recall and fewest errors; first wins on ties."""
    def top(e: Column) -> Column:
        return F.max_by("feature", F.struct(e, -F.col("feature_idx")))

    return m.groupBy("device_id").agg(
        top(F.col("accuracy")).alias("best_accuracy"), top(F.col("f1")).alias("best_f1"),
        top(F.col("specificity")).alias("best_specificity"), top(F.col("recall")).alias("best_recall"),
        top(-(F.col("fp") + F.col("fn"))).alias("fewest_errors"))
