"""Positions and pages of long lists, without sorting any list in one task.

The rows are dealt by range over (scope, order): Spark samples the splitters, every task sorts one
slice, and the slices in a row are the sorted whole.  A slice knows how many rows of each scope it
holds; adding these numbers up over the slices gives every slice the place its first row of a scope has.
A position is that offset plus the row's place in its slice, so a scope on a third of all rows costs
as many tasks as it fills slices.  A page is a range of positions: only slices that reach into it are read,
however deep it lies, and a bookmark (the last row seen) leads to the page after it the same way.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskweave.session import stage

SLICE_ROWS = 1_000_000
_PLACE = (1 << 33) - 1             # monotonically_increasing_id: partition above, row of the partition below


@dataclass
class Ordered:
    """Rows in slices (column _at: slice and row) and the offsets of every (slice, scope)."""

    rows: DataFrame
    scope: list[str]

    @cached_property
    def offsets(self) -> DataFrame:
        """_slice, scope, _first (place of the scope's first row in the slice), _n, _before (rows of the scope in earlier slices)."""
        sizes = self.rows.groupBy("_slice", *self.scope).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy(*self.scope).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        return stage(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "offsets")

    def totals(self) -> DataFrame:
        return self.offsets.groupBy(*self.scope).agg(F.sum("_n").alias("total"))

    def positions(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """The rows with their position from 1 in their scope; only those from low to high if given."""
        met = self.offsets
        if low is not None:
            met = met.where((F.col("_before") + F.col("_n") >= low) & (F.col("_before") < high))
        rows = self._meet(met)
        position = F.col("_before") + F.col("_place") - F.col("_first") + 1
        placed = rows.withColumn("position", position.cast("long")).drop("_slice", "_place", "_first", "_n", "_before")
        return placed if low is None else placed.where(F.col("position").between(low, high))

    def page(self, number: int, size: int) -> DataFrame:
        """The page of every scope, with position, page, total and total_pages."""
        number, size = max(1, number), max(1, size)
        rows = self.positions((number - 1) * size + 1, number * size)
        totals = self.totals()
        with_total = rows.join(totals, self.scope) if self.scope else rows.withColumn("total", totals.select("total").scalar())
        return with_total.withColumns({"page": F.lit(number), "total_pages": F.greatest(F.ceil(F.col("total") / size), F.lit(1))})

    def after(self, bookmarks: DataFrame, key: str, size: int) -> DataFrame:
        """The `size` rows behind the row that each bookmark (scope, key) names, with their position; key: a column unique in a scope."""
        seen = self._meet(self.offsets, self.rows.join(bookmarks.select(*self.scope, key), [*self.scope, key], "left_semi"))
        at = seen.select(*self.scope, (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias("_seen"))
        met = self.offsets.join(at, self.scope) if self.scope else self.offsets.withColumn("_seen", at.select("_seen").scalar())
        rows = self._meet(met.where((F.col("_before") + F.col("_n") > F.col("_seen")) & (F.col("_before") < F.col("_seen") + size)))
        placed = rows.withColumn("position", (F.col("_before") + F.col("_place") - F.col("_first") + 1).cast("long"))
        return placed.where((F.col("position") > F.col("_seen")) & (F.col("position") <= F.col("_seen") + size)).drop("_slice", "_place", "_first", "_n", "_before", "_seen")

    def _meet(self, offsets: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        return (self.rows if rows is None else rows).join(offsets, ["_slice", *self.scope])


def ordered(df: DataFrame, scope: list[str], order: list[Column], slice_rows: int = SLICE_ROWS) -> Ordered:
    """Deal df into sorted slices.  order must be total within a scope, and a scope not null; equal rows stay in one slice."""
    slices = max(1, -(-df.count() // slice_rows))
    dealt = df.repartitionByRange(slices, *scope, *order).sortWithinPartitions(*scope, *order)
    at = dealt.withColumn("_at", F.monotonically_increasing_id())
    placed = at.withColumns({"_slice": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit(_PLACE))}).drop("_at")
    return Ordered(stage(placed, "slices"), scope)
