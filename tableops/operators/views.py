"""Aggregates kept up to date from a change feed, without reading the whole base table again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums are decimals, so that what is taken away again leaves no trace; values have at most so many decimal places.
SUM_TYPE = "decimal(38,9)"


@dataclass(frozen=True)
class GroupedView:
    """A view of one row a group: n, sum_ and n_ (non-null values) of `sums`, least_ and greatest_ of `extremes`, distinct_ of `distinct`."""

    keys: Sequence[str]
    sums: Sequence[str] = ()
    extremes: Sequence[str] = ()
    distinct: Sequence[str] = ()

    def compute(self, base: DataFrame) -> DataFrame:
        """The view of a whole table."""
        aggs = [F.count(F.lit(1)).alias("n")]
        for c in self.sums:
            aggs += [F.coalesce(F.sum(F.col(c).cast(SUM_TYPE)), F.lit(0)).cast(SUM_TYPE).alias(f"sum_{c}"), F.count(c).alias(f"n_{c}")]
        for c in self.extremes:
            aggs += [F.min(c).alias(f"least_{c}"), F.max(c).alias(f"greatest_{c}")]
        aggs += [F.countDistinct(c).alias(f"distinct_{c}") for c in self.distinct]
        return base.groupBy(*self.keys).agg(*aggs)

    def averages(self, view: DataFrame) -> DataFrame:
        """view with avg_ of each of `sums`."""
        return view.withColumns({f"avg_{c}": F.col(f"sum_{c}").cast("double") / F.nullif(F.col(f"n_{c}"), F.lit(0)) for c in self.sums})

    def _deltas(self, changes: DataFrame) -> DataFrame:
        """What changes add to and take from each group, which values they take away, and which they bring."""
        gain = F.when(F.col("_change_type").isin("insert", "update_postimage"), 1).otherwise(-1)
        signed = changes.withColumn("__gain", gain)
        come, gone = (lambda c: F.when(F.col("__gain") == 1, F.col(c))), (lambda c: F.when(F.col("__gain") == -1, F.col(c)))
        aggs = [F.sum("__gain").alias("d")]
        for c in self.sums:
            value = F.col(c).cast(SUM_TYPE)
            aggs += [F.coalesce(F.sum(F.when(F.col("__gain") == 1, value).otherwise(-value)), F.lit(0)).cast(SUM_TYPE).alias(f"d_sum_{c}"), F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("__gain"))), F.lit(0)).alias(f"d_n_{c}")]
        for c in self.extremes:
            aggs += [F.min(come(c)).alias(f"in_least_{c}"), F.max(come(c)).alias(f"in_greatest_{c}"), F.min(gone(c)).alias(f"out_least_{c}"), F.max(gone(c)).alias(f"out_greatest_{c}")]
        return signed.groupBy(*self.keys).agg(*aggs)

    def _joined(self, view: DataFrame, changes: DataFrame) -> DataFrame:
        deltas = self._deltas(changes)
        renamed = deltas.select(*(F.col(k).alias(f"__{k}") for k in self.keys), *(c for c in deltas.columns if c not in self.keys))
        return view.join(renamed, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys], "full")

    def _stale(self) -> Column:
        """Groups whose changes can't be told from the view and the deltas alone: an extreme or a value of a distinct count may be gone."""
        out = F.lit(bool(self.distinct))
        for c in self.extremes:
            out = out | (F.col(f"out_least_{c}") <= F.col(f"least_{c}")) | (F.col(f"out_greatest_{c}") >= F.col(f"greatest_{c}"))
        return F.col("d").isNotNull() & F.coalesce(out, F.lit(False))

    def stale_groups(self, view: DataFrame, changes: DataFrame) -> DataFrame:
        """Keys of the groups that refresh reads from the base table."""
        return self._joined(view, changes).where(self._stale()).select(*(F.coalesce(F.col(k), F.col(f"__{k}")).alias(k) for k in self.keys))

    def refresh(self, view: DataFrame, changes: DataFrame, base: DataFrame) -> DataFrame:
        """The view after a change feed (rows with _change_type, preimages among them) has led to base.

        Counts and sums move by signed deltas; groups that lost their least or greatest value, and with `distinct` all that
        changed, are computed from their rows of base. Groups without rows vanish. Null keys are a group.
        """
        joined = self._joined(view, changes)
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        columns = [F.coalesce(F.col(k), F.col(f"__{k}")).alias(k) for k in self.keys] + [(zero("n") + zero("d")).alias("n")]
        for c in self.sums:
            columns += [(zero(f"sum_{c}") + zero(f"d_sum_{c}")).cast(SUM_TYPE).alias(f"sum_{c}"), (zero(f"n_{c}") + zero(f"d_n_{c}")).alias(f"n_{c}")]
        for c in self.extremes:
            columns += [F.least(f"least_{c}", f"in_least_{c}").alias(f"least_{c}"), F.greatest(f"greatest_{c}", f"in_greatest_{c}").alias(f"greatest_{c}")]
        columns += [F.col(f"distinct_{c}") for c in self.distinct]
        moved = joined.where(~self._stale()).select(*columns).where("n > 0")
        if not (self.extremes or self.distinct):
            return moved
        stale = self.stale_groups(view, changes).select(*(F.col(k).alias(f"__{k}") for k in self.keys))
        rows = base.join(stale, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys], "left_semi")
        return moved.unionByName(self.compute(rows))
