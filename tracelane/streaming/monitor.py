"""Monitoring: each violation is reported once.

`Monitor.check(past, pending)` keeps the keys seen in memory, for one growing trace. `watch` runs a policy over a stream of events: each
micro-batch is appended to a table of events, only the buckets of traces that have new events are read again, violations that bind a new event are
kept, and an anti join with the table of reported keys drops those reported before. Both tables are written by batch number, so a batch
that is run again after a failure replaces what it had written.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


#: Folders of a batch by the hash of the trace: a batch reads those of its traces.
BUCKETS = 64


class Monitor:
    """handlers: what to call with a violation, by error type; see run."""

    def __init__(self, policy, handlers: dict | None = None):
        self.policy, self.seen, self.handlers = policy, set(), handlers or {}

    @classmethod
    def from_string(cls, text: str, handlers: dict | None = None, **more) -> Monitor:
        from ..plans.policy import Policy

        return cls(Policy.from_string(text, **more), handlers)

    def check(self, past: list, pending: list, raise_unhandled: bool = False, **parameters) -> list[dict]:
        from ..plans.policy import UnhandledError

        found = self.policy.analyze_pending(past, pending, **parameters)
        new = [f for f in found if f["key"] not in self.seen]  # duplicates within one call stay
        self.seen |= {f["key"] for f in found}
        if raise_unhandled and new:
            raise UnhandledError(new[0]["error"])
        return new

    def analyze(self, trace: list, **parameters) -> list[dict]:
        found = self.policy.analyze(trace, **parameters)
        new = [f for f in found if f["key"] not in self.seen]
        self.seen |= {f["key"] for f in found}
        return new

    def run(self, trace: list, n_past: int = 0, **parameters) -> list[dict]:
        """The new violations that bind an event at or after n_past (with 0: all new ones). Each goes to the handler of its error type; one without a
        handler raises UnhandledError, after the handlers of the others have run. What was found then counts as not reported: the trace may go on
        with other events at the same places."""
        from ..plans.policy import UnhandledError

        before = set(self.seen)
        new = self.check(trace[:n_past], trace[n_past:], **parameters) if n_past else self.analyze(trace, **parameters)
        left = []
        for violation in new:
            handler = self.handlers.get(violation["error_type"])
            if handler is None:
                left.append(violation)
            else:
                handler(violation)
        if left:
            self.seen = before
            raise UnhandledError(left[0]["error"])
        return new

    def validated(self, function=None, **parameters):
        """A decorator of a function from a trace to the events that it adds: `run` sees the trace before the call and what was added after it, so
        a violation without a handler keeps the function from running, or its events from being returned."""

        def wrap(step):
            @wraps(step)
            def guarded(trace: list, *args, **named) -> list:
                self.run(trace, **parameters)
                added = list(step(trace, *args, **named))
                self.run(trace + added, len(trace), **parameters)
                return added

            return guarded

        return wrap if function is None else wrap(function)

    def reset(self) -> None:
        self.seen = set()


def new_keys(violations: DataFrame, seen: DataFrame) -> DataFrame:
    """Violations whose (trace_id, rule, key) isn't among those seen."""
    return violations.join(seen.select("trace_id", "rule", "key").distinct(), ["trace_id", "rule", "key"], "left_anti")


def watch(policy, stream: DataFrame, folder: str, **parameters):
    """A writer for a stream of events (columns of tracelane.sources.traces.EVENTS): start it with a checkpoint location. New violations are
    in `<folder>/violations`, with the batch that found them."""

    bucket = F.pmod(F.hash("trace_id"), F.lit(BUCKETS)).alias("bucket")

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.select("*", F.lit(number).alias("batch"), bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/events/number={number}")
        touched = df.select("trace_id").distinct()
        buckets = [r["bucket"] for r in df.select(bucket).distinct().collect()]  # BUCKETS at most
        files = spark.read.parquet(f"{folder}/events").where((F.col("number") <= number) & F.col("bucket").isin(buckets)).drop("number", "bucket")
        events = files.join(touched, "trace_id", "left_semi")
        fresh = events.where(F.col("batch") == number).groupBy("trace_id").agg(F.min("trace_idx").alias("first_new"))
        found = policy.check(events.drop("batch"), **parameters).join(fresh, "trace_id").where("max_idx >= first_new").drop("first_new")
        if number > 0:
            kind = StructType([*found.schema.fields, StructField("number", IntegerType()), StructField("bucket", IntegerType())])
            old = spark.read.schema(kind).parquet(f"{folder}/violations").where((F.col("number") < number) & F.col("bucket").isin(buckets))
            found = new_keys(found, old)
        found.select("*", bucket).write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/violations/number={number}")

    return stream.writeStream.foreachBatch(batch)
