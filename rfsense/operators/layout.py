"""Per-key row order that survives hot keys.

Every ordered operator needs the rows of a device in order. Where one device holds
more rows than a task should, its time line is cut into pieces of about
``piece_rows`` rows. A piece carries the few rows before it (and at most one after
it) that its operators look back on, marked as not belonging to it, so window
operators run per piece and give the same values as over the whole device.

The cut comes from a histogram of rows per key and time bin, an aggregate over the
key and time columns only. Inputs without a hot key keep the plain per-device
partitioning and pay no extra shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from rfsense.session import materialise

PIECE_ROWS = 1_000_000
BIN_SECONDS = 60.0
BROADCAST_ROWS = 50_000

_HELPERS = ("_piece", "_core", "_base", "_total")


@dataclass
class Layout:
    df: DataFrame
    keys: list[str]
    order: list[str]
    pieces: bool
    part: list[str] = field(default_factory=list)
    n_keys: int = 0

    def with_df(self, df: DataFrame) -> Layout:
        return replace(self, df=df)

    def per_key(self, small: DataFrame) -> DataFrame:
        """A table of fixed width with one row per key (or fewer), broadcast if the key count allows."""
        return F.broadcast(small) if self.n_keys <= BROADCAST_ROWS else small

    def w(self, lo: int | None = None, hi: int | None = 0) -> WindowSpec:
        """Ordered window of a device; ``lo``/``hi`` bound the frame in rows (None = unbounded)."""
        spec = Window.partitionBy(*self.part).orderBy(*self.order)
        if lo is None and hi is None:
            return spec
        return spec.rowsBetween(Window.unboundedPreceding if lo is None else lo,
                                Window.unboundedFollowing if hi is None else hi)

    def last_n(self, n: int) -> WindowSpec:
        return self.w(-(n - 1), 0)

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def pos(self) -> Column:
        """0-based position of the row within its key."""
        rn = F.row_number().over(self.ordered()).cast("long") - 1
        return rn + F.col("_base") if self.pieces else rn

    def total(self) -> Column:
        """Rows of the key."""
        here = F.count(F.lit(1)).over(Window.partitionBy(*self.part))
        return F.coalesce(F.col("_total"), here) if self.pieces else here

    def done(self, df: DataFrame) -> DataFrame:
        """Keep the rows a piece owns and drop the layout columns."""
        if not self.pieces:
            return df
        return df.where("_core").drop(*_HELPERS)

    def first_of(self, df: DataFrame, expr: Column, out: str) -> DataFrame:
        """Value of ``expr`` on the first row of the key."""
        out_df = df.withColumn(out, F.first(expr).over(self.w(None, 0)))
        if not self.pieces:
            return out_df
        firsts = (
            df.where(self.hot() & F.col("_core")).groupBy(*self.keys)
            .agg(F.min_by(expr, F.struct(*self.order)).alias("_first"))
        )
        return (out_df.join(firsts, self.keys, "left")
                .withColumn(out, F.coalesce("_first", out)).drop("_first"))

    def hot(self) -> Column:
        """Rows of keys that were cut; the others are one piece and need nothing from elsewhere."""
        return F.col("_total").isNotNull()

    def carry(self, df: DataFrame, values: dict[str, Column], inclusive: bool = True) -> DataFrame:
        """Last non-null value of each column up to (``inclusive``) or before the current row.

        Unbounded look-back: pieces hand their last values on through one row per piece.
        """
        upto = self.w(None, 0 if inclusive else -1)
        out = df.select("*", *[F.last(v, ignorenulls=True).over(upto).alias(n) for n, v in values.items()])
        if not self.pieces:
            return out
        tails = [F.max(F.when(F.col("_core") & v.isNotNull(), F.struct(*self.order, v.alias("_v")))).alias(f"_t_{n}")
                 for n, v in values.items()]
        earlier = (Window.partitionBy(*self.keys).orderBy("_piece")
                   .rowsBetween(Window.unboundedPreceding, -1))
        handed = df.where(self.hot()).groupBy(*self.part).agg(*tails).select(*self.part, *[
            F.last(F.col(f"_t_{n}._v"), ignorenulls=True).over(earlier).alias(f"_in_{n}") for n in values])
        joined = out.join(handed, self.part, "left")
        return joined.withColumns({n: F.coalesce(F.col(n), F.col(f"_in_{n}")) for n in values}).drop(
            *[f"_in_{n}" for n in values])

    def sum_before(self, df: DataFrame, value: str, out: str) -> DataFrame:
        """Sum of ``value`` over all earlier rows of the key; pieces hand on one sum each."""
        own = F.when(F.col("_core"), F.col(value)).otherwise(0) if self.pieces else F.col(value)
        df = df.withColumn(out, F.coalesce(F.sum(own).over(self.w(None, -1)), F.lit(0)).cast("long"))
        if not self.pieces:
            return df
        earlier = Window.partitionBy(*self.keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        handed = df.where(self.hot() & F.col("_core")).groupBy(*self.part).agg(F.sum(value).alias("_own")).select(
            *self.part, F.coalesce(F.sum("_own").over(earlier), F.lit(0)).alias("_in"))
        return df.join(handed, self.part, "left").withColumn(out, F.col(out) + F.coalesce("_in", F.lit(0))).drop("_in")


def _time_bin(df: DataFrame, col: str, width: float) -> Column:
    if dict(df.dtypes)[col] in ("timestamp", "timestamp_ntz"):
        return F.floor(F.unix_micros(F.col(col).cast("timestamp")) / F.lit(width * 1e6))
    return F.floor(F.col(col) / F.lit(width))


@dataclass
class Profile:
    """How the rows of a frame spread over keys and time; valid for every frame with the same rows."""

    keys: list[str]
    hot: bool
    n_keys: int
    bins: DataFrame
    width: float
    piece_rows: int

    def of_subset(self) -> Profile | None:
        """What it says about some of the rows: without a hot key there is none among fewer rows."""
        return None if self.hot else self


def measure(df: DataFrame, keys: tuple[str, ...] = ("device_id",), order: tuple[str, ...] = ("ts", "seq"),
            piece_rows: int | None = None, bin_width: float | None = None) -> Profile:
    """Find out whether any key is hot: one aggregate job over the key column."""
    piece_rows = max(int(piece_rows or PIECE_ROWS), 1)
    bin_width = bin_width or BIN_SECONDS
    bins = df.select(*keys, _time_bin(df, order[0], bin_width).alias("_bin"))
    biggest, n_keys = bins.groupBy(*keys).count().agg(F.max("count"), F.count(F.lit(1))).first()
    # A bin is not cut: where one holds more rows than a piece should, bins are made narrower. Rows of one and the same time stay together.
    while (biggest or 0) > piece_rows and bin_width > 1e-6 and bins.groupBy(*keys, "_bin").count().agg(F.max("count")).first()[0] > piece_rows:
        bin_width = max(bin_width / 64, 1e-6)
        bins = df.select(*keys, _time_bin(df, order[0], bin_width).alias("_bin"))
    return Profile(list(keys), (biggest or 0) > piece_rows, n_keys, bins, bin_width, piece_rows)


def arrange(
    df: DataFrame,
    before: int = 0,
    after: int = 0,
    keys: tuple[str, ...] = ("device_id",),
    order: tuple[str, ...] = ("ts", "seq"),
    piece_rows: int | None = None,
    bin_width: float | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    profile: Profile | None = None,
) -> Layout:
    """Lay ``df`` out for ordered operators that look ``before`` rows back and ``after`` (0, 1) ahead.

    ``order[0]`` gives the time bins, ``bin_width`` wide (seconds for timestamps). ``profile``
    spares the measuring job where the rows are those of a frame measured before, or split its
    keys further.
    """
    if after not in (0, 1):
        raise ValueError("after must be 0 or 1")
    keys, order = list(keys), list(order)
    if profile is not None and profile.keys != keys:
        finer = not profile.hot and set(profile.keys) <= set(keys)
        profile = replace(profile, keys=keys, n_keys=BROADCAST_ROWS + 1) if finer else None
    if profile is None or (profile.hot and profile.piece_rows < before):
        piece_rows = max(int(piece_rows or PIECE_ROWS), before)
        profile = measure(df, tuple(keys), tuple(order), piece_rows, bin_width)
    if not profile.hot:
        return Layout(df, keys, order, False, keys, profile.n_keys)

    bins, n_keys, piece_rows, bin_width = profile.bins, profile.n_keys, profile.piece_rows, profile.width
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    hist = (
        bins.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_total", F.sum("_n").over(by_key))
        .where(F.col("_total") > piece_rows)
        .withColumn("_from", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        .withColumn("_piece", F.floor(F.col("_from") / piece_rows))
    )
    starts = (
        hist.groupBy(*keys, "_piece").agg(F.min("_from").alias("_start"))
        .withColumn("_next", F.struct(F.lead("_piece", 1).over(by_key.orderBy("_piece")).alias("p"),
                                      F.lead("_start", 1).over(by_key.orderBy("_piece")).alias("s")))
        .withColumn("_next2", F.struct(F.lead("_piece", 2).over(by_key.orderBy("_piece")).alias("p"),
                                       F.lead("_start", 2).over(by_key.orderBy("_piece")).alias("s")))
        .withColumn("_prev", F.lag("_piece", 1).over(by_key.orderBy("_piece")))
    )
    # A bin serves its own piece, and the next pieces whose look-back reaches into it: with
    # before <= piece_rows that can be no more than the next two.
    end = F.col("_from") + F.col("_n")

    def reach(nxt: str) -> Column:
        return F.when((F.col(f"{nxt}.s") < end + before), F.col(f"{nxt}.p"))

    serves = [F.col("_piece")]
    if before:
        serves += [reach("_next"), reach("_next2")]
    if after:
        serves.append(F.when(F.col("_from") == F.col("_start"), F.col("_prev")))
    bin_map = (
        hist.join(starts, [*keys, "_piece"])
        .withColumn("_own", F.col("_piece"))
        .withColumn("_to", F.explode(F.array_compact(F.array(*serves))))
        .withColumn("_base", F.min("_from").over(Window.partitionBy(*keys, "_to")))
        .select(*keys, "_bin", F.col("_to").alias("_piece"),
                (F.col("_to") == F.col("_own")).alias("_core"), "_base", "_total")
    )
    # Written once: every use of the layout would otherwise count the rows again.
    bin_map = materialise(bin_map, "pieces")
    if bin_map.count() <= broadcast_rows:
        bin_map = F.broadcast(bin_map)
    cold = F.col("_piece").isNull()
    laid = (
        df.withColumn("_bin", _time_bin(df, order[0], bin_width))
        .join(bin_map, [*keys, "_bin"], "left").drop("_bin")
        .withColumn("_core", F.when(cold, F.lit(True)).otherwise(F.col("_core")))
        .withColumn("_base", F.when(cold, F.lit(0)).otherwise(F.col("_base")).cast("long"))
        .withColumn("_piece", F.when(cold, F.lit(0)).otherwise(F.col("_piece")).cast("long"))
    )
    return Layout(laid, keys, order, True, [*keys, "_piece"], n_keys)
