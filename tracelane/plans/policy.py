"""Policies: rules loaded from text and applied to any number of traces at once."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import ranges as R
from ..sources import traces as T
from .compiler import EVENT_TYPES, Compiler, Context
from .syntax import Node, PolicyError, parse

VIOLATIONS = "trace_id bigint, rule int, error_type string, error string, args string, kwargs string, key string, max_idx int, bindings map<string,string>, ranges array<" + R.RANGE + ">"


class PolicyLoadingError(PolicyError):
    """A policy whose text can't be read."""


class UnhandledError(RuntimeError):
    """raise_unhandled was asked for and a rule matched."""


@dataclass
class Policy:
    module: object
    functions: dict
    quantifiers: dict
    matchers: dict
    link: object = None

    @classmethod
    def from_string(cls, text: str, functions: dict | None = None, quantifiers: dict | None = None, matchers: dict | None = None, link=None) -> Policy:
        """link: a function from an import path to a function of the rule language or None, asked for names that `functions` lacks; by default only
        the language's own functions are known."""
        try:
            return cls(parse(text), functions or {}, quantifiers or {}, matchers or {}, link)
        except PolicyLoadingError:
            raise
        except PolicyError as e:
            raise PolicyLoadingError(str(e)) from e

    @classmethod
    def from_file(cls, path: str, **more) -> Policy:
        return cls.from_string(Path(path).read_text(), **more)

    def context(self, events: DataFrame, parameters: dict, traces: DataFrame | None = None) -> Context:
        if "data" in parameters:
            raise ValueError("`data` is a reserved parameter")
        return Context(self.module, events, traces if traces is not None else events.select("trace_id").distinct(), parameters, self.functions, self.quantifiers, self.matchers, self.link)

    def models(self, events: DataFrame, rule: int = 0, traces: DataFrame | None = None, **parameters) -> DataFrame:
        """The assignments that satisfy a rule: trace_id and a column `<variable>__<field>` per variable and field."""
        r = self.module.rules[rule]
        return Compiler(self.context(events, parameters, traces), r.body, head=r.head).run_from_traces()[0]

    def check(self, events: DataFrame, traces: DataFrame | None = None, **parameters) -> DataFrame:
        """Violations (VIOLATIONS) of all rules over all traces. `traces` (trace_id) names traces that may have no events."""
        context = self.context(events, parameters, traces)
        parts = [self._rule(context, i, r) for i, r in enumerate(self.module.rules)]
        if not parts:
            return events.sparkSession.createDataFrame([], VIOLATIONS)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _rule(self, context: Context, index: int, rule) -> DataFrame:
        c = Compiler(context, rule.body, head=rule.head)
        df, _ = c.run_from_traces()
        have = set(df.columns)
        live = {n: v for n, v in c.env.items() if n not in c.bound_names and (f"{n}__pos" in have or f"{n}__value" in have or n in c.assigned)}
        message, args, kwargs, own_key = self._head(c, rule.head)
        kind = rule.head.value.value if rule.head.kind == "call" and rule.head.value.kind == "name" else "PolicyViolation"
        events = {n: v for n, v in live.items() if v.kind == "obj" and v.type in EVENT_TYPES}
        idx = {n: F.coalesce(F.col(f"{n}__trace_idx"), F.lit(-1)) if n in events else F.lit(-1) for n in live}
        key = own_key if own_key is not None else F.to_json(F.array(F.lit(index), *[idx[n] for n in sorted(live)]))
        bindings = [x for n in sorted(live) for x in (F.lit(n), F.col(f"{n}__path") if n in events else self._shown(live[n]))]
        spots = F.array_compact(F.array(*[F.when(F.col(f"{n}__path").isNotNull(), R.object_range(F.col(f"{n}__path"))) for n in sorted(events)])) if events else F.array().cast(f"array<{R.RANGE}>")
        most = F.greatest(F.lit(-1), *[idx[n] for n in events]) if events else F.lit(-1)
        return df.select(
            F.col("trace_id").cast("long").alias("trace_id"), F.lit(index).alias("rule"), F.lit(kind).alias("error_type"), message.alias("error"), args.alias("args"), kwargs.alias("kwargs"), key.alias("key"), most.cast("int").alias("max_idx"),
            (F.create_map(*bindings) if bindings else F.create_map().cast("map<string,string>")).alias("bindings"), F.array_distinct(F.concat(spots, *c.marks.values())).cast(f"array<{R.RANGE}>").alias("ranges"),
        )

    @staticmethod
    def _shown(v):
        return V.as_text(v).cast("string") if v.col is not None or v.kind in ("json", "struct") else F.lit(None).cast("string")

    def _head(self, c: Compiler, head: Node):
        """(message, args as JSON, keyword arguments as JSON, the key that the rule names or None)."""
        none = F.lit(None).cast("string")
        if head.kind == "call" and head.value.kind == "name":
            args, named = head.parts
            values = [c.expr(a) for a in args]
            fields = {k: c.expr(v) for k, v in named}
            shown = lambda v: v.path if v.kind == "obj" else V.as_text(v)
            message = shown(values[0]) if values else F.lit(head.value.value)
            key = fields["key"] if "key" in fields else None
            return message.cast("string"), F.to_json(F.array(*[shown(v).cast("string") for v in values])), (F.to_json(F.struct(*[shown(v).cast("string").alias(k) for k, v in fields.items()])) if fields else none), (shown(key).cast("string") if key is not None else None)
        v = c.expr(head)
        text = V.as_text(v).cast("string")
        return text, F.to_json(F.array(text)), none, None

    # -- one or a few traces from Python

    def analyze(self, trace: list, raise_unhandled: bool = False, **parameters) -> list[dict]:
        """The violations of one trace given as a list of events."""
        return self._found(trace, None, raise_unhandled, parameters)

    def analyze_pending(self, past: list, pending: list, raise_unhandled: bool = False, **parameters) -> list[dict]:
        """The violations of past + pending that bind at least one pending event."""
        return self._found(past + pending, len(past), raise_unhandled, parameters)

    def _found(self, trace: list, n_past: int | None, raise_unhandled: bool, parameters: dict) -> list[dict]:
        spark = SparkSession.active()
        events = T.from_python(spark, [trace])
        out = self.check(events, spark.createDataFrame([(0,)], "trace_id long"), **parameters)
        if n_past is not None:
            out = pending_only(out, F.lit(n_past))
        rows = [r.asDict(recursive=True) for r in out.collect()]
        if raise_unhandled and rows:
            raise UnhandledError(rows[0]["error"])
        return rows

    def incremental(self):
        from ..streaming.monitor import Monitor

        return Monitor(self)


def match_counts(violations: DataFrame) -> DataFrame:
    """trace_id, rule, n: how often each rule matched in each trace that it matched in."""
    return violations.groupBy("trace_id", "rule").agg(F.count("*").alias("n"))


def pending_only(violations: DataFrame, n_past) -> DataFrame:
    """Violations that bind an event at or after index n_past; those that bind no event are never reported."""
    return violations.where(F.col("max_idx") >= n_past)


def filter_traces(traces: DataFrame, events: DataFrame, condition: str, max_items: int | None = None, **parameters) -> DataFrame:
    """traces (trace_id, ...) with at least one match of a rule body; the first max_items by trace_id."""
    body = "\n".join("    " + line for line in condition.strip().split("\n"))
    found = Policy.from_string(f'raise "match" if:\n{body}\n').check(events, traces.select("trace_id"), **parameters).select("trace_id")
    out = traces.join(found, "trace_id", "left_semi")
    return out.orderBy("trace_id").limit(max_items) if max_items is not None else out


def to_records(violations: DataFrame) -> DataFrame:
    """One JSON text per violation: key, args, kwargs and addresses of its ranges."""
    return violations.select("trace_id", F.to_json(F.struct("key", "error", "args", "kwargs", F.transform("ranges", R.address).alias("ranges"))).alias("value"))
