"""Refreshing the classified stock as daily records arrive.

Pairs are spread over hash buckets, and three tables are stored by bucket:

* ``positions``: the latest record of every pair and description,
* ``partials``: issues per pair and day of the last 90 days, as mergeable sums,
* ``health``: the classified pairs.

A micro-batch is merged into the positions and partials of the buckets its pairs are in, and
these alone give the buckets' classes: neither the history nor the last 90 days of the
fact table are read again, however many records they hold. Days that leave the window leave the partials.

The three tables are published together as one version (``versions``), with the number of the batch
that is in it. Readers see one version whole while the next is written; a batch that is repeated
after a failure finds its number published and adds nothing twice. Roll-ups follow the published versions,
each group at its own lag. Alerts of a batch and the changes of a version go to a
folder named after it, so writing them again gives the same.

Classes also age without new records: the first batch of a new day brings all buckets up to
date, from the positions and partials at hand, with the stream's checkpoint and everything logged left as
they are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfwise.operators import rollups
from shelfwise.operators.alerts import alerts_without_id
from shelfwise.operators.consumption import (
    HISTORY_DAYS,
    day_partials,
    merge_partials,
    metrics_of_partials,
)
from shelfwise.operators.health import classify, join_metrics
from shelfwise.operators.positions import (
    PAIR,
    choose_positions,
    merge_candidates,
    position_candidates,
)
from shelfwise.operators.reorder import reorder_recommendations
from shelfwise.sources.readers import stream_folder
from shelfwise.streaming.changes import change_capture
from shelfwise.streaming.versions import Version, VersionedTables

REFRESH_EVERY = "10 minutes"
BASE_BATCH = -1
#: When the file of a record was written, in microseconds.
ARRIVED = "unix_micros(_metadata.file_modification_time) AS _arrived"
#: How far each roll-up may lag behind the classified table.
ROLLUP_LAGS = {
    "reorder_recommendations": "10 minutes",
    "location_risk_summary": "10 minutes",
    "executive_summary": "15 minutes",
}


@dataclass(frozen=True)
class StockRefresh:
    """Where the fact table lies, where the refreshed tables go, and for which date.

    ``as_of`` is a date, or a function that gives the date of each batch.
    """

    spark: SparkSession
    fact_path: str
    fact_schema: T.StructType
    root: str
    items: DataFrame
    locations: DataFrame
    params: DataFrame
    as_of: dt.date | Callable[[], dt.date]
    buckets: int = 64

    def today(self) -> dt.date:
        """The date that a batch starting now is for."""
        return self.as_of() if callable(self.as_of) else self.as_of

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def tables(self) -> VersionedTables:
        """Positions, partials and health."""
        return VersionedTables(self.spark, self._path("stock"))

    def rollup(self, name: str) -> VersionedTables:
        """The versions of one roll-up, in a single bucket."""
        return VersionedTables(self.spark, self._path(f"rollups/{name}"))

    def _bucket(self) -> Column:
        return F.pmod(F.hash(*PAIR), F.lit(self.buckets)).alias("bucket")

    def _facts(self) -> DataFrame:
        return self.spark.read.schema(self.fact_schema).parquet(self.fact_path)

    def health(self, number: int | None = None) -> DataFrame:
        """The classified table as the newest version, or the one of this number, has it."""
        found = self.tables.read(self.tables.version(number), "health")
        if found is None:
            raise LookupError("nothing has been published yet")
        return found

    def _merged(
        self, version: Version, scope: set[int], rows: DataFrame, since: dt.date
    ) -> tuple[DataFrame, DataFrame]:
        """Positions and partials of the buckets in scope, with the rows taken in."""
        known = [self.tables.read(version, name, scope) for name in ("positions", "partials")]
        new = [position_candidates(rows), day_partials(rows, since)]
        candidates, partials = (
            n if k is None else k.unionByName(n) for k, n in zip(known, new)
        )
        return merge_candidates(candidates), merge_partials(partials, since)

    def _classify(self, version: Version, scope: set[int], day: dt.date) -> DataFrame:
        """The classes of the buckets in scope from a version's positions and partials."""
        known = self.tables.read(version, "positions", scope)
        partials = self.tables.read(version, "partials", scope)
        if partials is None:  # no record of the last 90 days
            partials = day_partials(self.spark.createDataFrame([], self.fact_schema), day)
        return classify(
            join_metrics(
                choose_positions(known),
                metrics_of_partials(partials, day),
                self.items,
                self.locations,
                self.params,
                day,
            )
        )

    def _publish(
        self, start: Version, scope: set[int], rows: DataFrame, day: dt.date, age_all: bool
    ) -> None:
        """Merges rows into the buckets in scope, classifies them (or all) and publishes."""
        since = day - dt.timedelta(days=HISTORY_DAYS)
        positions, partials = self._merged(start, scope, rows, since)
        version = start
        for name, frame in (("positions", positions), ("partials", partials)):
            version = self.tables.write(version, name, frame.select("*", self._bucket()), scope)
        known = version.tables["positions"]
        aged = set(known) if age_all else scope & set(known)
        if aged:
            classes = self._classify(version, aged, day).select("*", self._bucket())
            version = self.tables.write(version, "health", classes, aged)
        self.tables.publish(version)

    def rebuild(self) -> None:
        """Full refresh from the files the fact table has now, published like any version.

        The version notes how far these files go, so a stream that meets them later, or has not
        met some of them yet, does not add their issues a second time.
        """
        before, day = self.tables.version(), self.today()
        facts = self._facts().selectExpr("*", ARRIVED)
        through = facts.agg(F.max("_arrived").alias("through")).first()["through"]
        notes = {
            "batch": before.notes["batch"] if before else BASE_BATCH,
            "day": day.isoformat(),
            "through": through,
        }
        start = Version(self.tables.next_version().number, {}, notes)
        known = facts.filter(F.col("_arrived") <= F.lit(through)).drop("_arrived")
        self._publish(start, set(range(self.buckets)), known, day, True)
        self._log_changes(self.tables.version())

    def refresh(self, batch: DataFrame, batch_id: int) -> None:
        """Brings the buckets of the batch's pairs up to date; logs its alerts and changes."""
        before = self.tables.version()
        done, through = (before.notes["batch"], before.notes["through"]) if before else (BASE_BATCH, None)
        if batch_id < done:
            return
        if "_arrived" in batch.columns:
            if through is not None:
                batch = batch.filter(F.col("_arrived") > F.lit(through))
            batch = batch.drop("_arrived")
        if batch_id > done:
            touched = {r["bucket"] for r in batch.select(self._bucket()).distinct().collect()}
            if not touched:
                return
            day = self.today()
            start = self.tables.next_version(batch=batch_id, day=day.isoformat(), through=through)
            new_day = before is None or before.notes["day"] != day.isoformat()
            self._publish(start, touched, batch, day, new_day)
        now = self.tables.version()
        self._log_alerts(batch, batch_id, dt.date.fromisoformat(now.notes["day"]))
        self._log_changes(now)

    def _log_alerts(self, batch: DataFrame, batch_id: int, day: dt.date) -> None:
        pairs = batch.select(*PAIR).distinct()
        (
            alerts_without_id(self.health().join(pairs, list(PAIR), "left_semi"))
            .withColumn("alert_date", F.lit(day))
            .write.mode("overwrite")
            .parquet(f"{self._path('alerts')}/batch_id={batch_id}")
        )

    def _log_changes(self, now: Version) -> None:
        """What a version changed in the classified table: only its own buckets are compared."""
        mine = {b for b, n in now.tables["health"].items() if n == now.number}
        after = self.tables.read(now, "health", mine).drop("calculated_timestamp")
        earlier = self.tables.version(now.number - 1) if now.number > 1 else None
        before = self.tables.read(earlier, "health", mine)
        before = after.limit(0) if before is None else before.drop("calculated_timestamp")
        changed = change_capture(before, after, PAIR)
        changed.withColumn("batch_id", F.lit(now.notes["batch"])).write.mode("overwrite").parquet(
            f"{self._path('changes')}/version={now.number}"
        )

    def changes(self) -> DataFrame:
        """The change feed of the classified table, with the version and batch of each change.

        A batch changes the rows of its pairs, and of all pairs on a new day; a rebuild has the number
        of the batch before it.
        """
        return self.spark.read.parquet(self._path("changes"))

    def stream_changes(self) -> DataFrame:
        """The change feed as a stream, for consumers with a checkpoint of their own."""
        schema = self.changes().schema
        return self.spark.readStream.schema(schema).parquet(self._path("changes"))

    def alerts(self) -> DataFrame:
        """All alerts logged, with the batch that raised them."""
        return self.spark.read.parquet(self._path("alerts"))

    def _rollups(self, health: DataFrame, day: dt.date) -> dict[str, DataFrame]:
        return {
            "reorder_recommendations": reorder_recommendations(health, self.items, day),
            "location_risk_summary": rollups.location_risk_summary(health),
            "executive_summary": rollups.executive_summary(health),
        }

    def write_rollups(self) -> None:
        """Reorder, location and executive tables as plain folders, replaced in place."""
        for name, frame in self._rollups(self.health(), self.today()).items():
            frame.write.mode("overwrite").parquet(self._path(name))

    def publish_rollups(self, names: Sequence[str] = tuple(ROLLUP_LAGS)) -> None:
        """Roll-ups of the newest version, each published as a version of its own."""
        now = self.tables.version()
        frames = self._rollups(self.health(now.number), dt.date.fromisoformat(now.notes["day"]))
        for name in names:
            table = self.rollup(name)
            version = table.next_version(of=now.number)
            rows = frames[name].select("*", F.lit(0).alias("bucket"))
            table.publish(table.write(version, name, rows, {0}))

    def rollup_table(self, name: str) -> DataFrame:
        """A roll-up as last published."""
        table = self.rollup(name)
        found = table.read(table.version(), name)
        if found is None:
            raise LookupError(f"{name} has not been published yet")
        return found

    def start_rollups(self, lags: Mapping[str, str] | None = None) -> dict[str, StreamingQuery]:
        """Keeps roll-ups up to date, each at its own lag behind the published versions.

        Every lag is one stream over the version files, so a roll-up is written anew only if
        something was published since. ``lags`` gives table -> time; {} or None takes ROLLUP_LAGS, and
        "once" catches up and stops.
        """
        by_lag: dict[str, list[str]] = {}
        for name, lag in (lags or ROLLUP_LAGS).items():
            by_lag.setdefault(lag, []).append(name)

        def follow(lag: str, names: list[str]) -> StreamingQuery:
            versions = self.spark.readStream.schema("value string").text(self.tables.published)
            writer = versions.writeStream.foreachBatch(
                lambda batch, batch_id: self.publish_rollups(names)
            ).option("checkpointLocation", self._path(f"_checkpoint_{'_'.join(sorted(names))}"))
            when = {"availableNow": True} if lag == "once" else {"processingTime": lag}
            return writer.trigger(**when).start()

        return {lag: follow(lag, names) for lag, names in by_lag.items()}

    def start(
        self,
        every: str | None = REFRESH_EVERY,
        files_per_batch: int | None = None,
        with_rollups: bool = False,
    ) -> StreamingQuery:
        """Runs ``refresh`` on new files; ``every=None`` takes what is there and stops."""
        stream = stream_folder(
            self.spark, self.fact_path, self.fact_schema, files_per_batch=files_per_batch
        )

        stream = stream.selectExpr("*", ARRIVED)

        def on_batch(batch: DataFrame, batch_id: int) -> None:
            self.refresh(batch, batch_id)
            if with_rollups:
                self.write_rollups()

        writer = stream.writeStream.foreachBatch(on_batch).option(
            "checkpointLocation", self._path("_checkpoint")
        )
        if every is None:
            return writer.trigger(availableNow=True).start()
        return writer.trigger(processingTime=every).start()
