"""Steps as state: a connection is published when the last of its tasks ends, a repeated step is written once, and senders' repeats are dropped
by how far each run has come.

State is kept by RocksDB in the stream's checkpoint, so a restarted stream goes on where it stood, on any executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..registry import query
from ..sources.shared import shared_folder
from .events import event_stream, run_to_end

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; the settings of `spark` stay as they are."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return own


class Publisher(StatefulProcessor):
    """Steps (`task`, `content`, `seq`, `page`, `tasks`) of one connection. The first content of a task counts; the same again changes nothing, and
    other content is a `mismatch`. When as many tasks have ended as the connection has, it is `published` on the page of the last, once."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getListState("done", "task string, content string")
        self.progress = handle.getValueState("progress", "ended long, last long, page long, published boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # every call to the state is a message: four a connection and batch, however many tasks it has
        ended, last, page, published = self.progress.get() or (0, -1, 0, False)
        known = dict(map(tuple, self.done.get())) if ended else {}
        new, out = {}, []
        for r in sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: (r.seq, r.task, r.content)):
            before = known.get(r.task)
            if before is None:
                known[r.task] = r.content
                new[r.task] = r.content
                ended += 1
                last, page = max((last, page), (int(r.seq), int(r.page)))
                if ended == r.tasks and not published:
                    published = True
                    out.append((*key, "published", r.task, page, last, ended))
            elif before != r.content:
                out.append((*key, "mismatch", r.task, int(r.page), int(r.seq), ended))
        if new:
            self.done.appendList(list(new.items()))
            self.progress.update((ended, last, page, published))
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def publications(steps: DataFrame, group: list[str]) -> DataFrame:
    """(group, outcome, task, page, at_, n): what the stream of steps (group, task, content, seq, page, tasks) publishes, and its mismatches. A
    connection's steps are few; the state is one content per task of it."""
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in group), "outcome string, task string, page long, at_ long, n long"])
    names = [*group, "outcome", "task", "page", "at_", "n"]
    return steps.groupBy(*group).transformWithStateInPandas(Publisher(names), outputStructType=schema, outputMode="append", timeMode="None")


class Cursor(StatefulProcessor):
    """Events of one run, each once: what isn't beyond the run's high-water mark was sent before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()[0] if self.mark.exists() else None
        seen: set[int] = set()
        for part in rows:
            part = part[part["seq"] > mark] if mark is not None else part
            part = part[~part["seq"].isin(seen)].drop_duplicates("seq")
            seen.update(part["seq"].tolist())
            if len(part):
                yield part
        if seen:
            self.mark.update((max(seen),))

    def close(self) -> None:
        pass


def once_per_run(events: DataFrame, run: str) -> DataFrame:
    """The stream's events (run, seq, ...) without those sent again. A run's events come in the order of `seq` from batch to batch, in any order inside
    one; the state is one number a run, so nothing is late and nothing expires."""
    return events.groupBy(run).transformWithStateInPandas(Cursor(), outputStructType=events.schema, outputMode="append", timeMode="None")


def steps_of(events: DataFrame, plan: DataFrame) -> DataFrame:
    """Events as the ends of tasks of their user's and type's connection; some are sent again, and some of those with other content."""
    text = F.col("event_id").cast("string")
    ends = events.join(plan, ["user_id", "event_type"]).select(
        "user_id", "event_type", text.alias("task"), F.concat(F.lit("v"), (F.col("event_id") % 7).cast("string")).alias("content"), F.col("event_id").alias("seq"), (F.col("event_id") % 20).alias("page"), "tasks"
    )
    again = ends.where("seq % 3 = 0").withColumn("content", F.when(F.col("seq") % 30 == 0, "x").otherwise(F.col("content"))).withColumn("seq", F.col("seq") + 1_000_000_000)
    return ends.unionByName(again)


def plan_of(events: DataFrame) -> DataFrame:
    """How many tasks each connection has, as its scan said: a row per user and type."""
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("tasks"))


@query(
    "t5_t6_stream_publication",
    """WITH s AS (SELECT user_id, event_type, max(event_id) AS m, count(*) AS n FROM events GROUP BY ALL)
       SELECT user_id, event_type, 'published' AS outcome, m::VARCHAR AS task, m % 20 AS page, m AS at_, n FROM s
       UNION ALL SELECT user_id, event_type, 'mismatch', event_id::VARCHAR, event_id % 20, event_id + 1000000000, n FROM events JOIN s USING (user_id, event_type) WHERE event_id % 30 = 0""",
)
def publication(t):
    """Connections as their last tasks end, and steps sent again with other content."""
    own = stateful_session(t.spark)
    static = own.read.parquet(f"{t.folder}/events.parquet")
    stream = event_stream(own, f"{t.folder}/events.parquet*", static.schema)
    return run_to_end(publications(steps_of(stream, plan_of(static)), ["user_id", "event_type"]), shared_folder(t.spark), reader=t.spark)


@query("s17_t9_stream_once", "SELECT user_id, event_id AS seq, event_type FROM events")
def stream_once(t):
    """Every event of every run once, of a stream whose sender repeats itself."""
    own = stateful_session(t.spark)
    static = own.read.parquet(f"{t.folder}/events.parquet")
    sent = event_stream(own, f"{t.folder}/events.parquet*", static.schema).select("user_id", F.col("event_id").alias("seq"), "event_type")
    return run_to_end(once_per_run(sent.union(sent.where("seq % 3 = 0")), "user_id"), shared_folder(t.spark), reader=t.spark)
