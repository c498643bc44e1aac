"""Baselines whose fitted state is a table: seasonal naive and profile mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import period_index, step_micros
from ..operators.blocks import BLOCK_ROWS, POS, with_positions
from ..operators.quantile import BUCKETS, join_facts
from .base import PREDICTION, Fitted, Forecaster, spread_to_folds


class SeasonalNaive(Forecaster):
    """The value at the same place of the last season before the end of training.

    ``align="phase"`` goes back whole seasons in time from each forecast instant to
    the last one at or before the end of training, so a gap does not shift the season.
    ``align="position"`` repeats the last ``season_length`` training rows over the
    test rows by position.  Both work per site.

    With ``fallback="last"`` a place that the last season lacks (only ``phase`` can have
    such) gets the latest known value of that place in the season.
    """

    kind = "seasonal_naive"

    def __init__(
        self,
        season_length: int = 336,
        align: str = "phase",
        freq: str = "30min",
        timestamp_col: str = "timestamp",
        site_col: str = "site_id",
        fallback: str | None = None,
    ):
        if fallback not in (None, "last"):
            raise ValueError(f"fallback must be None or 'last', not {fallback!r}")
        if align not in ("phase", "position"):
            raise ValueError(f"align must be 'phase' or 'position', not {align!r}")
        self.season_length = season_length
        self.align = align
        self.freq = freq
        self.timestamp_col = timestamp_col
        self.site_col = site_col
        self.fallback = fallback

    @property
    def _season(self) -> int:
        return self.season_length * step_micros(self.freq)

    def _source(self, ts: Column, train_end: Column) -> Column:
        """Instant whose value is the forecast for ``ts``."""
        ahead = F.unix_micros(ts) - F.unix_micros(train_end)
        seasons = F.greatest(
            F.call_function("div", ahead + F.lit(self._season - 1), F.lit(self._season)),
            F.lit(1),
        )
        return F.timestamp_micros(F.unix_micros(ts) - seasons * F.lit(self._season))

    def _after(self, ts: str, end: Column) -> Column:
        return F.unix_micros(F.col(ts)) > F.unix_micros(end) - F.lit(self._season)

    def _newest(self, rows: DataFrame, group: Sequence[str]) -> DataFrame:
        """Last season of rows per group with ``__back``, 1 for the newest, and ``__size``.

        Rows are counted per day first.  Only days that can reach into the last season are
        ranked, each by itself, so no task ranks a whole series.
        """
        ts = self.timestamp_col
        day = period_index(ts, step_micros("1D"))
        rows = rows.where(F.col(ts).isNotNull()).withColumn("__day", day)
        counts = rows.groupBy(*group, "__day").agg(F.count(F.lit(1)).alias("__n"))
        later = Window.partitionBy(*group).orderBy(F.col("__day").desc())
        newer = F.coalesce(F.sum("__n").over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        size = F.least(F.sum("__n").over(Window.partitionBy(*group)), F.lit(self.season_length))
        days = (
            counts.withColumns({"__newer": newer, "__size": size})
            .where(F.col("__newer") < self.season_length)
            .drop("__n")
        )
        on = [F.col(f"__d.{c}").eqNullSafe(F.col(f"__r.{c}")) for c in [*group, "__day"]]
        met = rows.alias("__r").join(days.alias("__d"), on).select("__r.*", "__d.__newer", "__d.__size")
        inside = Window.partitionBy(*group, "__day").orderBy(F.col(ts).desc())
        return (
            met.withColumn("__back", F.row_number().over(inside) + F.col("__newer"))
            .where(F.col("__back") <= self.season_length)
            .drop("__day", "__newer")
        )

    def _tail(self, rows: DataFrame, group: Sequence[str], target: str) -> DataFrame:
        """Last season of rows per group, numbered from the oldest, with their count."""
        return self._newest(rows, group).select(
            *group,
            "__size",
            (F.col("__size") - F.col("__back")).alias("__slot"),
            F.col(target).alias(PREDICTION),
        )

    def _phase(self, ts: str | Column) -> Column:
        """Place of an instant in its season."""
        return F.pmod(F.unix_micros(F.col(ts) if isinstance(ts, str) else ts), F.lit(self._season))

    def fit(self, train: DataFrame, features: Sequence[str] = (), target: str = "value") -> Fitted:
        site, ts = self.site_col, self.timestamp_col
        if self.align == "position":
            return Fitted(self, features, target, {"history": self._tail(train, [site], target)})
        ends = train.agg(F.max(ts).alias("train_end"))
        recent = train.withColumn("__end", ends.scalar()).where(self._after(ts, F.col("__end")))
        history = recent.select(
            site, ts, F.col(target).alias(PREDICTION), F.col("__end").alias("train_end")
        )
        tables = {"history": history}
        if self.fallback:
            tables["last"] = self._last(train, [site], target)
        return Fitted(self, features, target, tables)

    def _last(self, train: DataFrame, group: Sequence[str], target: str) -> DataFrame:
        """The latest known value per group and place in the season: one aggregate."""
        known = train.where(F.col(target).isNotNull())
        return known.groupBy(*group, self._phase(self.timestamp_col).alias("__phase")).agg(
            F.max_by(target, self.timestamp_col).alias("__last"), F.max(self.timestamp_col).alias("__last_at")
        )

    def _filled(self, df: DataFrame, last: DataFrame, group: Sequence[str]) -> DataFrame:
        """``df`` with missing predictions from ``last``."""
        named = last.select(*[F.col(c).alias(f"__of_{c}") for c in group], "__phase", "__last")
        same = [F.col(c) == F.col(f"__of_{c}") for c in group]
        joined = df.join(named, [*same, self._phase(self.timestamp_col) == F.col("__phase")], "left")
        return joined.withColumn(PREDICTION, F.coalesce(PREDICTION, "__last")).drop(
            *[f"__of_{c}" for c in group], "__phase", "__last"
        )

    def apply(self, fitted: Fitted, df: DataFrame) -> DataFrame:
        site, ts = self.site_col, self.timestamp_col
        history = fitted.tables["history"]
        df = df.drop(PREDICTION)
        if self.align == "position":
            sizes = history.groupBy(site).agg(F.max("__size").alias("__len"))
            spread = F.call_function("div", F.col(POS), F.lit(BLOCK_ROWS).cast("long"))
            numbered = join_facts(with_positions(df, site, ts), sizes, site, spread)
            placed = numbered.withColumn("__slot", F.pmod(F.col(POS), F.col("__len")))
            lookup = history.select(site, F.col("__slot").cast("long").alias("__slot"), PREDICTION)
            # A slot comes once a season: rows of one slot are spread by their position.
            spread = F.pmod(F.xxhash64(POS), F.lit(BUCKETS))
            return join_facts(placed, lookup, [site, "__slot"], spread).select(*df.columns, PREDICTION)
        end = history.agg(F.max("train_end")).scalar()
        placed = df.withColumn("__end", end).withColumn(
            "__src", self._source(F.col(ts), F.col("__end"))
        )
        lookup = history.select(site, F.col(ts).alias("__src"), PREDICTION)
        out = placed.join(lookup, [site, "__src"], "left").select(*df.columns, PREDICTION)
        return self._filled(out, fitted.tables["last"], [site]) if self.fallback else out

    def predict_folds(self, marked, features, target, timestamp_col):
        site, ts = self.site_col, timestamp_col
        n_splits = sum(1 for f in marked.schema["__bounds"].dataType if f.name.startswith("train_"))
        ends = [F.col(f"__bounds.train_{i}.at") for i in range(n_splits)]
        test = (
            marked.where(F.col("test_fold").isNotNull())
            .withColumn("fold", F.col("test_fold"))
            .drop(PREDICTION)
        )
        train = marked.where(F.col("train_from").isNotNull())
        if self.align == "position":
            # A season from every stretch of new training rows, then the last season of
            # the stretches each fold has seen: nothing is repeated before it is cut.
            tail = self._tail_rows(train, [site, "train_from", "n_folds"], target)
            history = self._tail(spread_to_folds(tail), [site, "fold"], target)
            order = Window.partitionBy(site, "fold").orderBy(ts)
            numbered = test.withColumn("__row", F.row_number().over(order) - 1)
            sizes = history.groupBy(site, "fold").agg(F.max("__size").alias("__len"))
            placed = numbered.join(sizes, [site, "fold"], "left").withColumn(
                "__slot", F.pmod(F.col("__row"), F.col("__len"))
            )
            lookup = history.select(site, "fold", F.col("__slot").cast("long").alias("__slot"), PREDICTION)
            return placed.join(lookup, [site, "fold", "__slot"], "left").drop(
                "__slot", "__row", "__len"
            )
        end = F.element_at(F.array(*ends), F.col("n_folds") - F.col("fold"))
        oldest = F.coalesce(*reversed(ends))
        history = (
            train.where(self._after(ts, oldest))
            .select(
                F.col(site).alias("__site"),
                F.col(ts).alias("__at"),
                F.col("train_from").alias("__seen"),
                F.col(target).alias(PREDICTION),
            )
        )
        placed = test.withColumn("__src", self._source(F.col(ts), end))
        out = placed.join(
            history,
            (F.col(site) == F.col("__site"))
            & (F.col("__src") == F.col("__at"))
            & (F.col("__seen") <= F.col("fold")),
            "left",
        ).drop("__site", "__at", "__src", "__seen")
        if not self.fallback:
            return out
        seen = self._last(train, [site, "train_from", "n_folds"], target)
        last = spread_to_folds(seen).groupBy(site, "fold", "__phase").agg(
            F.max_by("__last", "__last_at").alias("__last")
        )
        return self._filled(out, last, [site, "fold"])

    def _tail_rows(self, rows: DataFrame, group: Sequence[str], target: str) -> DataFrame:
        return self._newest(rows, group).select(*group, self.timestamp_col, target)


# How many values a calendar column can have.
CALENDAR_VALUES = {
    "hour": 24, "minute": 60, "minute_of_day": 1440, "hour_of_day": 1440, "day_of_week": 7, "day_of_month": 31,
    "day_of_year": 366, "week_of_year": 53, "month": 12, "quarter": 4, "season": 4, "is_weekend": 2, "is_holiday": 2,
}
# A table with so many cells at most is sent to every task.
SMALL_CELLS = 200_000


class ProfileMean(Forecaster):
    """Mean of the training rows in the same cell; unseen cells get the overall mean."""

    kind = "profile_mean"

    def __init__(self, group_cols: Sequence[str] = ("day_of_week", "minute_of_day")):
        self.group_cols = tuple(group_cols)

    def _sums(self, rows: DataFrame, group: Sequence[str], target: str) -> DataFrame:
        return rows.groupBy(*group).agg(
            F.sum(target).alias("__sum"), F.count(target).alias("__count")
        )

    def _lookup(self, cells: DataFrame, folds: int = 1) -> DataFrame:
        """``cells``, broadcast if its columns bound its size by their nature."""
        bound = max(1, folds)
        for c in self.group_cols:
            bound *= CALENDAR_VALUES.get(c, SMALL_CELLS) + 1
        return F.broadcast(cells) if bound <= SMALL_CELLS else cells

    @staticmethod
    def _mean() -> Column:
        return F.sum("__sum") / F.nullif(F.sum("__count"), F.lit(0))

    def fit(self, train: DataFrame, features: Sequence[str] = (), target: str = "value") -> Fitted:
        sums = self._sums(train, self.group_cols, target)
        cells = sums.groupBy(*self.group_cols).agg(self._mean().alias("cell_mean"))
        overall = sums.agg(self._mean().alias("overall_mean"))
        return Fitted(self, features, target, {"cells": cells, "overall": overall})

    def apply(self, fitted: Fitted, df: DataFrame) -> DataFrame:
        overall = fitted.tables["overall"].scalar()
        cells = self._lookup(fitted.tables["cells"])
        joined = df.drop(PREDICTION).join(cells, list(self.group_cols), "left")
        return joined.withColumn(PREDICTION, F.coalesce("cell_mean", overall)).select(
            *[c for c in df.columns if c != PREDICTION], PREDICTION
        )

    def predict_folds(self, marked, features, target, timestamp_col):
        cells = list(self.group_cols)
        train = marked.where(F.col("train_from").isNotNull())
        sums = self._sums(train, ["train_from", "n_folds", *cells], target)
        per_fold = spread_to_folds(sums).groupBy("fold", *cells).agg(
            F.sum("__sum").alias("__sum"), F.sum("__count").alias("__count")
        )
        profile = per_fold.withColumn("__cell", F.col("__sum") / F.col("__count")).select(
            "fold", *cells, "__cell"
        )
        overall = per_fold.groupBy("fold").agg(self._mean().alias("__overall"))
        test = marked.where(F.col("test_fold").isNotNull()).withColumn("fold", F.col("test_fold"))
        n_splits = sum(1 for f in marked.schema["__bounds"].dataType if f.name.startswith("train_"))
        return (
            test.join(self._lookup(profile, n_splits), ["fold", *cells], "left")
            .join(F.broadcast(overall), "fold", "left")  # one row per fold
            .withColumn(PREDICTION, F.coalesce("__cell", "__overall"))
            .drop("__cell", "__overall")
        )
