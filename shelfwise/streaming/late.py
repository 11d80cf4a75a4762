"""Running consumption that late rows correct.

``streaming/consumption`` drops what comes after its watermark. Here a stream keeps two tables in
versions (``streaming/versions``), both with a bucket a day:

* ``days``: issues and movements of every pair on a day, as mergeable sums,
* ``windows``: the sliding windows that the watermark has closed, by the day they end on.

A batch adds its sums to the days it has rows of, and then writes the windows that it closes and, for
rows that came too late, the closed windows they belong to. So it reads the days around its own rows
and those of the windows it closes, never the history. Both tables are published as one version, with the
watermark and the number of the batch in it: a batch that is repeated adds nothing, and a reader
never sees a day without its windows. Late rows are also kept as they came, in a side table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfwise.functions.dates import utc_date
from shelfwise.operators.positions import PAIR
from shelfwise.streaming.versions import Version, VersionedTables

DAY = dt.timedelta(days=1)
MICROSECOND = dt.timedelta(microseconds=1)
SUMS = ("issues", "movements")


@dataclass(frozen=True)
class ConsumptionLog:
    """Windows of ``window_days`` days, one ending every day, under one root folder.

    A window is closed once the newest row is ``lateness`` past its end. Movements have ts,
    location_code, item_code and issues; rows without a time belong to no window.
    """

    spark: SparkSession
    root: str
    window_days: int = 7
    lateness: dt.timedelta = DAY

    @property
    def tables(self) -> VersionedTables:
        return VersionedTables(self.spark, f"{self.root.rstrip('/')}/consumption")

    @property
    def _late_path(self) -> str:
        return f"{self.root.rstrip('/')}/late"

    def _closed_to(self, newest: int | None) -> int | None:
        """The last day number on which a closed window can end."""
        return None if newest is None else (newest - self.lateness // MICROSECOND) // (DAY // MICROSECOND)

    def _windows(self, days: DataFrame | None, first: int, last: int) -> DataFrame | None:
        """All windows that end on the day numbers first to last and have a movement."""
        if days is None:
            return None
        ends = F.sequence(
            F.greatest(F.col("day") + 1, F.lit(first)), F.least(F.col("day") + self.window_days, F.lit(last))
        )
        reaches = (F.col("day") < last) & (F.col("day") + self.window_days >= first)
        return (
            days.filter(reaches)
            .withColumn("bucket", F.explode(ends))
            .groupBy("bucket", *PAIR)
            .agg(*[F.sum(name).alias(name) for name in SUMS])
            .select(
                F.date_from_unix_date(F.col("bucket") - self.window_days).alias("window_start"),
                F.date_from_unix_date("bucket").alias("window_end"),
                *PAIR,
                *SUMS,
                "bucket",
            )
        )

    def _write_windows(self, version: Version, ends: Iterable[int]) -> Version:
        """Writes the windows that end on these days from the days a version has."""
        ends = set(ends)
        if not ends:
            return version
        reached = {end - back for end in ends for back in range(1, self.window_days + 1)}
        days = self.tables.read(version, "days", reached)
        windows = self._windows(days, min(ends), max(ends))
        if windows is None:
            return version
        return self.tables.write(version, "windows", windows.filter(F.col("bucket").isin(ends)), ends)

    def update(self, movements: DataFrame, batch_id: int) -> None:
        """Takes in one batch and publishes the windows that it closes or corrects."""
        before = self.tables.version()
        notes = before.notes if before else {"batch": -1, "newest": None}
        if batch_id <= notes["batch"]:
            return
        rows = movements.filter(F.col("ts").isNotNull()).withColumn("day", F.unix_date(utc_date(F.col("ts"))))
        found = rows.groupBy("day").agg(F.max(F.unix_micros("ts")).alias("newest")).collect()
        if not found:
            return
        touched = {row["day"] for row in found}
        newest = max([row["newest"] for row in found] + ([] if notes["newest"] is None else [notes["newest"]]))
        closed_before, closed_now = self._closed_to(notes["newest"]), self._closed_to(newest)

        late_days = {day for day in touched if closed_before is not None and day < closed_before}
        if late_days:
            rows.filter(F.col("day") < closed_before).drop("day").write.mode("overwrite").parquet(
                f"{self._late_path}/batch_id={batch_id}"
            )
        version = self.tables.next_version(batch=batch_id, newest=newest)
        sums = rows.select("day", *PAIR, "issues", F.lit(1).cast("bigint").alias("movements"))
        known = self.tables.read(version, "days", touched)
        if known is not None:
            sums = sums.unionByName(known)
        days = sums.groupBy("day", *PAIR).agg(*[F.sum(name).alias(name) for name in SUMS])
        version = self.tables.write(version, "days", days.withColumn("bucket", F.col("day")), touched)

        corrected = {day + ahead for day in late_days for ahead in range(1, self.window_days + 1)}
        ends = {end for end in corrected if end <= closed_before}
        first = min(version.tables["days"]) + 1 if closed_before is None else closed_before + 1
        ends |= set(range(first, min(closed_now, max(version.tables["days"]) + self.window_days) + 1))
        self.tables.publish(self._write_windows(version, ends))

    def closed(self) -> DataFrame:
        """The windows closed so far, with every late row in them."""
        version = self.tables.version()
        found = self.tables.read(version, "windows")
        if found is None:
            return self.still_open().limit(0)
        return found

    def still_open(self) -> DataFrame:
        """The windows that the watermark has not reached, as they stand."""
        version = self.tables.version()
        if version is None:
            raise LookupError("nothing has been published yet")
        known = version.tables["days"]
        closed_to = self._closed_to(version.notes["newest"])
        last = max(known) + self.window_days
        days = self.tables.read(version, "days", {day for day in known if day + self.window_days > closed_to})
        if days is None:
            days = self.tables.read(version, "days", {max(known)}).limit(0)
        return self._windows(days, closed_to + 1, last).drop("bucket")

    def late(self) -> DataFrame:
        """The rows that came after their first window was closed, with their batch."""
        return self.spark.read.parquet(self._late_path)

    def start(self, movements: DataFrame, every: str | None = None) -> StreamingQuery:
        """Runs ``update`` on a stream of movements; ``every=None`` takes what is there and stops."""
        writer = movements.writeStream.foreachBatch(self.update).option(
            "checkpointLocation", f"{self.root.rstrip('/')}/_checkpoint"
        )
        when = {"availableNow": True} if every is None else {"processingTime": every}
        return writer.trigger(**when).start()
