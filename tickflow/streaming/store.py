"""The event store - acknowledged appends, then dispatch of exactly what was committed.

An append writes its events to a folder of its own and acknowledges them with
a commit record; readers see committed batches only, so a write that failed
half way is invisible and its retry overwrites it.  Handlers run after the
commit, on the committed events of their types; one that fails is logged and
recorded and the others still run.  Outcomes are kept per batch and handler,
so what a lost driver left undelivered can be delivered later.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickflow.operators.messages import JSON_OPTIONS
from tickflow.session import materialize, path_exists

Handler = Callable[[DataFrame, str], None]

COMMITS = "batch string, events bigint, low date, high date, undated bigint"
OUTCOMES = "batch string, handler string, ok boolean, error string"

log = logging.getLogger(__name__)


class EventStore:
    """A log of events under ``path``, one folder per appended batch, partitioned by event date.

    ``schema`` is that of the events (``event_id``, ``event_type`` and ``timestamp`` among them).
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.handlers: dict[str, tuple[set[str], Handler]] = {}

    def register(self, event_type: str, name: str, handler: Handler) -> None:
        """Have ``handler(events, batch)`` called with the events of ``event_type`` (and any other it is registered for)."""
        types, _ = self.handlers.get(name, (set(), handler))
        self.handlers[name] = (types | {event_type}, handler)

    # -- reading ------------------------------------------------------------------

    def _table(self, folder: str, schema: T.StructType | str) -> DataFrame:
        where = f"{self.path}/{folder}"
        if not path_exists(self.spark, where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(where)

    def commits(self) -> DataFrame:
        """One row per acknowledged batch: its number of events, and the dates they have."""
        return self._table("commits", COMMITS)

    def _events(self) -> DataFrame:
        placed = T.StructType([*self.schema.fields, T.StructField("batch", T.StringType()), T.StructField("event_date", T.DateType())])
        return self._table("events", placed)

    def committed(self) -> DataFrame:
        """The acknowledged events, with their batch; folders of failed appends are not read."""
        return self._events().join(self.commits().select("batch"), "batch", "left_semi").select(*self.schema.names, "batch")

    def events_of(self, batch: str) -> DataFrame:
        return self.committed().where(F.col("batch") == batch).drop("batch")

    def outcomes(self) -> DataFrame:
        """What became of each batch at each handler that got it."""
        return self._table("outcomes", OUTCOMES)

    # -- appending ----------------------------------------------------------------

    def append(self, events: DataFrame, batch: str) -> bool:
        """Append what of ``events`` the log has not, then dispatch it; False, and nothing dispatched, if the write fails.

        ``batch`` names the append: a retry under the same name overwrites
        what a failed attempt left, and does not write again what was
        acknowledged.  An event repeated in the batch or known from an earlier
        one is left out, by its id or, without an id, by its whole row.
        """
        try:
            if not self._is_committed(batch):
                self._write(events, batch)
        except Exception:  # noqa: BLE001 - any failure of the write is the answer False
            log.exception("batch %s was not appended", batch)
            return False
        self.dispatch(batch)
        return True

    def _is_committed(self, batch: str) -> bool:
        return path_exists(self.spark, f"{self.path}/commits/batch={batch}/_SUCCESS")

    def _write(self, events: DataFrame, batch: str) -> None:
        names = self.schema.names
        whole = F.to_json(F.struct(*names), JSON_OPTIONS)
        key = F.coalesce(F.concat(F.lit("id "), F.col("event_id").cast("string")), F.concat(F.lit("row "), whole))
        new = (events.select(*names).withColumn("event_date", F.to_date("timestamp"))
               .withColumn("_key", key).dropDuplicates(["_key"]))
        if path_exists(self.spark, f"{self.path}/commits"):
            new = materialize(new)  # read for its dates, and then joined
            span = new.agg(F.min("event_date").alias("low"), F.max("event_date").alias("high")).first()
            # an event keeps its date: other partitions of the log cannot hold it
            days = F.col("event_date").isNull()
            if span["low"] is not None:
                days = days | F.col("event_date").between(F.lit(span["low"]), F.lit(span["high"]))
            known = self._events().where(days).join(self.commits().select("batch"), "batch", "left_semi").select(key.alias("_key"))
            new = new.join(known, "_key", "left_anti")
        folder = f"{self.path}/events/batch={batch}"
        new.drop("_key").write.mode("overwrite").partitionBy("event_date").parquet(folder)
        placed = T.StructType([*self.schema.fields, T.StructField("event_date", T.DateType())])
        record = self.spark.read.schema(placed).parquet(folder).agg(
            F.count("*").alias("events"), F.min("event_date").alias("low"), F.max("event_date").alias("high"),
            F.count(F.when(F.col("event_date").isNull(), 1)).alias("undated"))
        record.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")

    # -- dispatching --------------------------------------------------------------

    def dispatch(self, batch: str) -> dict[str, bool]:
        """Hand the batch's committed events to every handler of their types; whether each did its work."""
        done = {}
        for name, (types, handler) in self.handlers.items():
            error = None
            try:
                handler(self.events_of(batch).where(F.col("event_type").isin(*sorted(types))), batch)
            except Exception as e:  # noqa: BLE001 - a failing handler does not keep the events from the others
                log.exception("handler %s failed on batch %s", name, batch)
                error = str(e)[:500]
            done[name] = error is None
            outcome = self.spark.range(1).select(F.lit(error is None).alias("ok"), F.lit(error).cast("string").alias("error"))
            outcome.write.mode("overwrite").parquet(f"{self.path}/outcomes/batch={batch}/handler={name}")
        return done

    def undelivered(self) -> DataFrame:
        """Batches and registered handlers without a recorded success, oldest batch name first."""
        if not self.handlers:
            return self.spark.createDataFrame([], "batch string, handler string")
        names = F.explode(F.array(*[F.lit(name) for name in self.handlers])).alias("handler")
        due = self.commits().select("batch", names)
        return due.join(self.outcomes().where("ok"), ["batch", "handler"], "left_anti").orderBy("batch", "handler")

    def redeliver(self) -> None:
        """Dispatch what is undelivered once more: at least once for each handler.

        The loop is over the batches that a crash or a failing handler left,
        taken one by one from an iterator.
        """
        for row in self.undelivered().select("batch").distinct().orderBy("batch").toLocalIterator():
            self.dispatch(row["batch"])
