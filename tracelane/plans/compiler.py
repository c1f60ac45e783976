"""Rules to DataFrames.

A rule's variables are bound in stages, as the language prescribes: stage 0 binds nothing, stage 1 all open variables `(x: T)`, later stages
the variables drawn from collections that earlier ones made known. At each stage every body line is a three-valued condition: null while it
depends on a variable not bound yet. Rows whose lines are all true (and whose error needs no later variable) are matches, false ones are
dropped (or kept for `forall`), the rest go on. Most rules collapse to one join and one filter.

Variables are flat columns `<name>__<field>`, so Catalyst prunes what a rule doesn't use and pushes conditions into the scans. All joins
are on trace_id; `->` and `~>` add conditions on pos. Quantifiers and predicates with variables of their own become aggregates or distinct
keys joined back to the outer rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detectors as D
from ..functions import values as V
from ..functions.values import Val, lit
from ..operators import ranges as R
from ..sources.traces import PARAMETER
from .syntax import Module, Node, PolicyError

EVENT_TYPES = ("Message", "ToolCall", "ToolOutput", "Tool")
FIELDS = ("pos", "trace_idx", "path", "kind", "role", "content", "json", "chunks", "tool_name", "args", "call_id", "call_type", "link_pos", "link_name", "link_args", "link_id", "server", "metadata", "description", "params")
SCALARS = {"str": "str", "int": "num", "float": "num", "bool": "bool"}
PARTS = {"TextChunk": "text", "Image": "image_url"}
OTHER_TYPES = ("ToolParameter", "list", "dict", "Input", "Function", "LLM", "File")
#: Most characters of a workspace's files that a rule may draw from.
FILES_BYTES = 8 << 20


class MissingPolicyParameter(KeyError):
    """A rule reads `input.<name>` and no such parameter was given."""


class ExcessivePolicyError(PolicyError):
    """A rule reaches for an attribute or a method that isn't allowed."""


@dataclass
class Context:
    module: Module
    events: DataFrame
    traces: DataFrame
    parameters: dict
    functions: dict = field(default_factory=dict)
    quantifiers: dict = field(default_factory=dict)
    matchers: dict = field(default_factory=dict)
    link: object = None  # import path -> a function for it, or None
    counter: list = field(default_factory=lambda: [0])

    def fresh(self, prefix: str) -> str:
        self.counter[0] += 1
        return f"_{prefix}{self.counter[0]}"


@dataclass
class Variable:
    name: str
    type: str
    source: Node | None = None  # None: open


@dataclass
class Tri:
    """A three-valued condition: null where it isn't decided. may_be_true: statically, at this stage."""

    col: Column
    may_be_true: bool
    decided: bool
    always: bool = False  # a declaration: true whatever is bound


def jpath(base: str, key) -> str:
    if isinstance(key, int):
        return f"{base}[{key}]"
    return f"{base}.{key}" if re.fullmatch(r"[A-Za-z_]\w*", key) else f"{base}['" + key.replace("'", "\\'") + "']"


def python_regex(p: str) -> str:
    """Python's dialect to Java's: named groups, end anchors, Unicode classes; `.` and `$` end lines at \\n only."""
    return "(?Ud)" + p.replace("(?P<", "(?<").replace(r"\Z", r"\z")


class Compiler:
    def __init__(self, context: Context, rule_body: tuple, outer: dict[str, Val] | None = None, head: Node | None = None, scope: str = "", deps: dict[str, set] | None = None):
        """scope: prefix of the columns of this body's own variables, so that those of inner bodies never meet outer ones. deps: for each outer
        name, the prefixes of the columns that its value is made of."""
        self.c, self.lines, self.head, self.scope = context, rule_body, head, scope
        self.outer_deps = dict(deps or {})
        self.env: dict[str, Val] = dict(outer or {})
        self.bound_names = set(self.env)
        self.assigned: dict[str, Node] = {}
        self.variables: list[Variable] = []
        self.kinds: dict[str, str] = {}
        self.columns: dict[int, Column] = {}  # of quantifiers and predicates that are materialised
        self.marks: dict[tuple, Column] = {}  # ranges by the node that makes them: a line is compiled again at each stage
        self.quiet = 0  # within a comprehension, whose element is no column of the rows
        for line in rule_body:
            self._declare(line)

    # -- declarations

    def _declare(self, node: Node, nested: bool = False) -> None:
        if node.kind == "typed" or node.kind == "typed_in":
            name, kind = node.value
            kind = kind.split(".")[-1]
            if name in self.env or any(v.name == name for v in self.variables) or name in self.assigned:
                raise PolicyError(f"{name} is declared twice", self.c.module.source, node.at)
            if kind not in EVENT_TYPES and kind not in SCALARS and kind not in PARTS and kind not in OTHER_TYPES:
                raise PolicyError(f"unknown type {kind}", self.c.module.source, node.at)
            self.variables.append(Variable(name, kind, node.parts[0] if node.kind == "typed_in" else None))
        elif node.kind == "assign":
            if node.value in self.assigned or node.value in self.env:
                raise PolicyError(f"{node.value} is declared twice", self.c.module.source, node.at)
            self.assigned[node.value] = node.parts[0]
        elif node.kind in ("wildcard", "ref"):
            raise PolicyError("* and value references stand within tool patterns only", self.c.module.source, node.at)
        if node.kind in ("quantifier", "pattern"):
            return
        for p in self._children(node):
            self._declare(p)

    @staticmethod
    def _children(node: Node) -> list[Node]:
        if node.kind == "call":
            return [node.value, *node.parts[0], *(v for _, v in node.parts[1])] if node.parts else [node.value]
        return [p for p in node.parts if isinstance(p, Node)]

    def free(self, node: Node) -> set[str]:
        """Variables of this body that a node needs, through assignments."""
        own = {v.name for v in self.variables}
        out: set[str] = set()

        def walk(n: Node, hidden: frozenset) -> None:
            if n.kind == "name":
                if n.value in hidden:
                    return
                if n.value in own:
                    out.add(n.value)
                elif n.value in self.assigned:
                    walk(self.assigned[n.value], hidden)
            elif n.kind == "typed":
                out.add(n.value[0])
            elif n.kind == "typed_in":
                out.add(n.value[0])
                walk(n.parts[0], hidden)
            elif n.kind == "comprehension":
                walk(n.parts[1], hidden)
                for p in (n.parts[0], *n.parts[2:]):
                    walk(p, hidden | {n.value})
            elif n.kind == "quantifier":
                inner = frozenset(x.value[0] for line in n.parts for x in line.walk() if x.kind in ("typed", "typed_in"))
                for p in n.parts:
                    walk(p, hidden | inner)
            elif n.kind == "typed_hidden":
                return
            else:
                for p in self._children(n):
                    walk(p, hidden)

        walk(node, frozenset())
        return {n for n in out if n in own}

    def prefix(self, name: str) -> str:
        return f"{self.scope}{name}__"

    def deps(self, node: Node) -> set[str]:
        """Prefixes of the columns that a node's value is made of: those of its variables here and in outer bodies, through names, arguments
        and inner bodies. A name that an inner body declares anew may count too, which does no harm."""
        own, out, seen = {v.name for v in self.variables}, set(), set()

        def walk(n: Node) -> None:
            name = n.value if n.kind == "name" else n.value[0] if n.kind in ("typed", "typed_in") else None
            if name is not None and name not in seen:
                seen.add(name)
                if name in own:
                    out.add(self.prefix(name))
                elif name in self.assigned:
                    walk(self.assigned[name])
                out.update(self.outer_deps.get(name, ()))
            for p in n.parts if n.kind == "quantifier" else self._children(n):
                walk(p)

        walk(node)
        return out

    # -- stages

    def run_from_traces(self, want_false: bool = False) -> tuple[DataFrame | None, DataFrame | None]:
        return self.run(self.c.traces, want_false)

    def run(self, start: DataFrame, want_false: bool = False) -> tuple[DataFrame | None, DataFrame | None]:
        """(rows that match, rows that are definitely false) of a body, from rows that have trace_id and what outer variables need."""
        df, base = start, True
        bound: set[str] = set()
        self.prune = not want_false  # rows that can't match may go before all is bound
        pending = list(self.variables)
        true_parts, false_parts = [], []
        head_needs = self.free(self.head) if self.head is not None else set()
        while True:
            df = self._materialise(df, bound)
            last = not pending
            tris = [self._line(n, bound, top=last and not want_false) for n in self.lines]
            tris = [t for t in tris if t is not None]
            ready = all(t.may_be_true for t in tris) and head_needs <= bound
            if last:
                if not want_false:
                    for t in tris:
                        df = df if t.always else df.filter(t.col)
                    true_parts.append(df)
                else:
                    body = self._all(tris)
                    true_parts.append(df.filter(body))
                    false_parts.append(df.filter(~body))
                break
            interesting = [t for t in tris if t.decided or t.may_be_true]
            real = [t for t in interesting if not t.always]
            if ready:
                body = self._all(tris)
                true_parts.append(df.filter(F.coalesce(body, F.lit(False))))
                if want_false and real:
                    false_parts.append(df.filter(F.coalesce(~body, F.lit(False))))
                if all(t.always for t in tris):
                    break
                df = df.filter(body.isNull())
            elif real:
                body = self._all(real)
                if want_false:
                    false_parts.append(df.filter(F.coalesce(~body, F.lit(False))))
                df = df.filter(F.coalesce(body, F.lit(True)))
            nxt = [v for v in pending if (v.source is None or self.free(v.source) <= bound)]
            if not nxt:
                raise PolicyError(f"{pending[0].name} can't be bound", self.c.module.source)
            for v in nxt:
                df, more = self._bind(df, v, base and not real and not bound and start is self.c.traces, bound)
                base = False
                bound |= {v.name, *more}
            pending = [v for v in pending if v.name not in bound]
        union = lambda parts: None if not parts else parts[0] if len(parts) == 1 else _union(parts)
        return union(true_parts), union(false_parts)

    @staticmethod
    def _all(tris: list[Tri]) -> Column:
        out = F.lit(True)
        for t in tris:
            if not t.always:
                out = out & t.col
        return out

    def _bind(self, df: DataFrame, v: Variable, first: bool, bound: set[str]) -> tuple[DataFrame, tuple[str, ...]]:
        """Rows with a variable bound, and the names of others that were bound with it."""
        p = self.prefix(v.name)
        if v.source is None or v.type in EVENT_TYPES:
            view = self._view(v.type, p)
            extra = None
            if v.source is not None:
                source = self.expr(v.source)
                if source.calls is None:
                    raise PolicyError(f"{v.name}: events can be drawn from a message's tool_calls only", self.c.module.source, v.source.at)
                m = source.calls
                extra = (F.col(f"{p}trace_idx") == F.col(f"{m}trace_idx")) & F.startswith(F.col(f"{p}path"), F.concat(F.col(f"{m}path"), F.lit(".tool_calls.")))
            self.env[v.name] = self._variable(v)
            if first:
                return view, ()
            more, meeting = (), self._meeting(v, bound) if v.source is None else None
            if meeting is not None:
                left, right = self._exploded(df, meeting[0]), self._exploded(view, meeting[1])
                if left is not None and right is not None:
                    df, view, more = left, right, tuple(x.name for x in meeting)
                    extra = self.env[more[0]].col == self.env[more[1]].col
            view = view.withColumnRenamed("trace_id", f"{p}trace_id")
            on = df["trace_id"] == view[f"{p}trace_id"]
            return df.join(view, on if extra is None else on & extra).drop(f"{p}trace_id"), more
        if v.type == "File":
            self.env[v.name] = self._variable(v)
            return df.withColumn(f"{p}value", F.explode(self._files(v.source))), ()
        col, kind = self._collection(self.expr(v.source), v.type)
        self.env[v.name] = self._variable(v)
        if kind == "variant" and v.type in SCALARS:
            name = f"{p}raw"
            df = df.withColumn(name, F.explode(col))
            schema = F.schema_of_variant(F.col(name))
            ok = {"str": schema == "STRING", "bool": schema == "BOOLEAN", "int": schema == "BIGINT", "float": schema.startswith("DECIMAL") | (schema == "DOUBLE")}[v.type]
            value = F.try_variant_get(F.col(name), "$", {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}[v.type])
            return df.filter(ok).withColumn(f"{p}value", value).drop(name), ()
        df = df.withColumn(f"{p}value", F.explode(col))
        return df if kind != "variant" else df.withColumn(f"{p}key", F.to_json(F.col(f"{p}value"))), ()

    def _meeting(self, event: Variable, bound: set[str]) -> tuple[Variable, Variable] | None:
        """(w, v) of a line `w == v` of two text variables, v drawn from `event` alone and w from what is bound: they can be joined by their values, so
        that two long texts make a row for each match, not for each pair of words."""
        texts = {v.name: v for v in self.variables if v.type == "str" and v.source is not None and v.name not in bound}
        for line in self.lines if self.prune else ():
            if line.kind == "binary" and line.value == "==" and all(p.kind == "name" and p.value in texts for p in line.parts):
                for w, v in (line.parts, line.parts[::-1]):
                    near, far = texts[w.value], texts[v.value]
                    if self.free(far.source) == {event.name} and self.free(near.source) and self.free(near.source) <= bound:
                        return near, far
        return None

    def _exploded(self, df: DataFrame, v: Variable) -> DataFrame | None:
        """df with a text variable bound; None if its collection doesn't hold texts."""
        col, kind = self._collection(self.expr(v.source), v.type)
        if kind != "str":
            return None
        self.env[v.name] = self._variable(v)
        return df.withColumn(f"{self.prefix(v.name)}value", F.explode(col))

    def _files(self, source: Node) -> Column:
        """The files of a workspace (at most FILES_BYTES of text, as they become a literal): structs of path and content."""
        from ..sources.traces import file_contents

        value = self.expr(source)
        if value.type != "Files":
            raise PolicyError("files are drawn from get_file_contents(...)", self.c.module.source, source.at)
        spark = self.c.events.sparkSession
        files = file_contents(spark, *value.const)
        if (files.agg(F.sum(F.length("content"))).first()[0] or 0) > FILES_BYTES:
            raise PolicyError("the workspace is too large for a rule; read it with file_contents and join", self.c.module.source, source.at)
        rows = files.orderBy("path").collect()
        return F.array(*[F.struct(F.lit(r["path"]).alias("path"), F.lit(r["content"]).alias("content")) for r in rows]).cast("array<struct<path:string,content:string>>")

    def _collection(self, x: Val, type_name: str) -> tuple[Column, str]:
        """The array a variable ranges over: elements of its type, flattened once."""
        if type_name in PARTS:
            if x.kind == "content":
                f = PARTS[type_name]
                return F.filter(x.fields["chunks"], lambda c: c["type"] == f), "chunk"
            raise PolicyError(f"{type_name} can be drawn from a content only", self.c.module.source)
        if type_name == "ToolParameter":
            return x.col, "param"
        if x.kind in ("str", "content") and type_name == "str":
            return F.array_compact(F.array(V.as_str(x))), "str"
        if x.kind == "num" and type_name in ("int", "float"):
            return F.array_compact(F.array(x.col)), "num"
        col, kind = V.as_list(x)
        if kind == "list":
            col, kind = F.flatten(col), x.elem.elem if isinstance(x.elem, Val) else "str"
        if kind == "variant" or kind == SCALARS.get(type_name):
            return F.filter(col, lambda e: e.isNotNull()), kind
        return F.filter(col, lambda e: F.lit(False)), kind

    def _variable(self, v: Variable) -> Val:
        p = self.prefix(v.name)
        if v.type in EVENT_TYPES:
            return Val("obj", None, type=v.type, at=p, path=F.col(f"{p}path"))
        if v.type == "File":
            return Val("struct", None, type="File", fields={n: Val("str", F.col(f"{p}value")[n]) for n in ("path", "content")})
        if v.type in PARTS or v.type == "ToolParameter":
            return Val("obj", F.col(f"{p}value"), type="Chunk" if v.type in PARTS else "ToolParameter", path=F.lit(None).cast("string"))
        if v.type == "Input":
            return Val("obj", None, type="Input", path=F.lit(""))
        return Val(SCALARS.get(v.type, "variant"), F.col(f"{p}value"))

    def _view(self, kind: str, p: str) -> DataFrame:
        e = self.c.events
        if kind in EVENT_TYPES:
            return e.where(F.col("kind") == kind).select("trace_id", *[F.col(f).alias(p + f) for f in FIELDS])
        if kind == "Input":
            return self.c.traces
        if kind in PARTS:
            f = PARTS[kind]
            return e.select("trace_id", F.explode(F.filter("chunks", lambda c: c["type"] == f)).alias(f"{p}value"))
        if kind == "ToolParameter":
            return e.where("kind = 'Tool'").select("trace_id", F.explode("params").alias(f"{p}value"))
        if kind == "str":  # whatever text selection reaches: roles, contents, ids, types, chunks' texts and URLs
            parts = F.array_compact(F.array("role", F.when(~F.coalesce("json", F.lit(False)), F.col("content")), F.when(F.col("kind").isin("ToolCall", "ToolOutput"), F.col("call_id")), "call_type"))
            chunks = F.coalesce(F.transform("chunks", lambda c: F.coalesce(c["text"], c["url"])), F.array().cast("array<string>"))
            return e.select("trace_id", F.explode(F.array_compact(F.concat(parts, chunks))).alias(f"{p}value"))
        raise PolicyError(f"(x: {kind}) has no values over a whole trace", self.c.module.source)

    # -- quantifiers and predicates

    def _subqueries(self, node: Node):
        if node.kind == "quantifier":
            yield node
        elif node.kind == "call" and node.value.kind == "name" and self._predicate(node.value.value) and self._has_variables(node.value.value):
            yield node
        if node.kind not in ("quantifier", "comprehension"):
            for p in self._children(node):
                yield from self._subqueries(p)

    def _predicate(self, name: str):
        return self.c.module.predicates.get(name)

    def _has_variables(self, name: str, seen: tuple = ()) -> bool:
        if name in seen:
            raise PolicyError(f"{name} calls itself", self.c.module.source)
        for line in self._predicate(name).body:
            for n in line.walk():
                if n.kind in ("typed", "typed_in", "quantifier"):
                    return True
                if n.kind == "call" and n.value.kind == "name" and self._predicate(n.value.value) and self._has_variables(n.value.value, (*seen, name)):
                    return True
        return False

    def _materialise(self, df: DataFrame, bound: set[str]) -> DataFrame:
        for line in self.lines:
            for node in self._subqueries(line):
                if id(node) in self.columns or not self.free(node) <= bound:
                    continue
                df = self._subquery(df, node)
        return df

    def _keys(self, df: DataFrame, prefixes: set[str]) -> list[str]:
        """Columns that tell the values of variables apart: an event's place, a value's text."""
        keys = ["trace_id"]
        for p in sorted(prefixes):
            keys += [k for k in (f"{p}pos", f"{p}key", f"{p}value") if k in df.columns][:1]
        return keys

    def _subquery(self, df: DataFrame, node: Node) -> DataFrame:
        """Adds a boolean column for a quantifier or predicate: its body runs over the distinct outer values that it depends on, its result is
        joined back."""
        name = self.c.fresh("q")
        prefixes = self.deps(node)
        if node.kind == "call":
            predicate = self._predicate(node.value.value)
            if len(node.parts[0]) != len(predicate.parameters) or node.parts[1]:
                raise PolicyError(f"{predicate.name} takes {len(predicate.parameters)} positional arguments", self.c.module.source, node.at)
            pairs = [(p, a) for (p, _), a in zip(predicate.parameters, node.parts[0], strict=True)]
            inner, deps = {p: self.expr(a) for p, a in pairs}, {p: self.deps(a) for p, a in pairs}
            lines, kind, options = predicate.body, "exists", {}
        else:
            (kind, options), lines = node.value, node.parts
            used = {x.value for line in lines for x in self._names(line)}
            inner = self.env | {n: self.expr(self.assigned[n]) for n in used if n in self.assigned and n not in self.env}
            deps = self.outer_deps | {v.name: {self.prefix(v.name)} for v in self.variables} | {n: self.deps(e) for n, e in self.assigned.items()}
        keys = self._keys(df, prefixes)
        needed = [c for c in df.columns if c == "trace_id" or c.startswith("_q") or any(c.startswith(p) for p in prefixes)]
        outer_rows = df.select(*needed).dropDuplicates(keys) if len(keys) > 1 else df.select("trace_id").distinct()
        body = Compiler(self.c, lines, inner, scope=self.c.fresh("s") + "_", deps=deps)
        if kind == "forall":
            _, false = body.run(outer_rows, want_false=True)
            hits = None if false is None else false.select(*keys).distinct().withColumn(name, F.lit(False))
            out = self._join_back(df, hits, keys, name)
            self.columns[id(node)] = F.coalesce(F.col(name), F.lit(True))
            return out
        true, _ = body.run(outer_rows)
        if kind == "exists":
            out = self._join_back(df, true.select(*keys).distinct().withColumn(name, F.lit(True)), keys, name)
            self.columns[id(node)] = F.coalesce(F.col(name), F.lit(False))
            return out
        if kind in self.c.quantifiers:
            counted = self.c.quantifiers[kind](true.groupBy(*keys), name, {k: self._constant(v) for k, v in options.items()})
            out = self._join_back(df, counted, keys, name)
            self.columns[id(node)] = F.coalesce(F.col(name), F.lit(False))
            return out
        if kind != "count":
            raise PolicyError(f"unknown quantifier {kind}", self.c.module.source, node.at)
        spots = body.spots()
        columns = [F.count("*").alias(name), *([F.array_distinct(F.flatten(F.collect_list(spots))).alias(f"{name}r")] if spots is not None else [])]
        out = self._join_back(df, true.groupBy(*keys).agg(*columns), keys, name)
        if spots is not None:  # ranges of what was counted belong to the match
            self.marks[(id(node), 0)] = F.coalesce(F.col(f"{name}r"), F.array().cast(f"array<{R.RANGE}>"))
        n, low, high = F.coalesce(F.col(name), F.lit(0)), options.get("min"), options.get("max")
        ok = F.lit(True)
        if low is not None:
            ok = ok & (n >= self._constant(low))
        if high is not None:
            ok = ok & (n <= self._constant(high))
        self.columns[id(node)] = ok
        return out

    @classmethod
    def _names(cls, node: Node):
        if node.kind == "name":
            yield node
        for p in node.parts if node.kind == "quantifier" else cls._children(node):
            yield from cls._names(p)

    def spots(self) -> Column | None:
        """Ranges of a match: its events, and what its lines marked in texts."""
        events = [self.env[v.name] for v in self.variables if v.name in self.env and self.env[v.name].kind == "obj" and v.type in EVENT_TYPES]
        own = [F.array_compact(F.array(*[F.when(v.path.isNotNull(), R.object_range(v.path)) for v in events]))] if events else []
        return F.concat(*[x.cast(f"array<{R.RANGE}>") for x in (*own, *self.marks.values())]) if own or self.marks else None

    def mark(self, node: Node, ranges: Column, nth: int = 0) -> None:
        if not self.quiet:
            self.marks[(id(node), nth)] = ranges

    @staticmethod
    def _join_back(df: DataFrame, hits: DataFrame | None, keys: list[str], name: str) -> DataFrame:
        if hits is None:
            return df.withColumn(name, F.lit(None).cast("boolean"))
        right = hits.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], *[c for c in hits.columns if c not in keys and c.startswith(name)])
        on = df["trace_id"] == right[f"{name}_trace_id"]
        for k in keys[1:]:
            on = on & df[k].eqNullSafe(right[f"{name}_{k}"])
        return df.join(right, on, "left").drop(*[f"{name}_{k}" for k in keys])

    def _constant(self, node: Node):
        v = self.expr(node)
        if v.const is None:
            raise PolicyError("expected a constant", self.c.module.source, node.at)
        return v.const

    # -- conditions

    def _line(self, node: Node, bound: set[str], top: bool) -> Tri | None:
        if node.kind == "assign":
            if self.free(node.parts[0]) <= bound:
                self.env[node.value] = self.expr(node.parts[0])
            return None
        return self.condition(node, bound, top)

    def condition(self, node: Node, bound: set[str], top: bool = False) -> Tri:
        k = node.kind
        if k in ("typed", "typed_in"):
            return Tri(F.lit(True), True, True, always=True)
        if k == "binary" and node.value in ("and", "or"):
            a, b = (self.condition(p, bound) for p in node.parts)
            if node.value == "and":
                return Tri(a.col & b.col, a.may_be_true and b.may_be_true, a.decided or b.decided)
            return Tri(a.col | b.col, a.may_be_true or b.may_be_true, a.decided and b.decided or a.may_be_true or b.may_be_true)
        if k == "unary" and node.value == "not":
            inner = node.parts[0]
            if not self._is_boolean(inner):
                if not self.free(inner) <= bound:
                    return Tri(F.lit(None).cast("boolean"), False, False)
                return Tri(~V.truthy(self.expr(inner)), True, True)
            a = self.condition(inner, bound)
            return Tri(~a.col, a.may_be_true, a.decided)
        if not self.free(node) <= bound:
            return Tri(F.lit(None).cast("boolean"), False, False)
        if id(node) in self.columns:
            return Tri(self.columns[id(node)], True, True)
        col = V.as_bool(self.expr(node))
        if col is None:
            return Tri(F.lit(False), True, True)
        return Tri(col if top else F.coalesce(col, F.lit(False)), True, True)

    def _is_boolean(self, n: Node) -> bool:
        return n.kind in ("typed", "typed_in", "quantifier", "flow", "pattern") or n.kind == "binary" and n.value not in ("+", "-", "*", "/", "%", "**") or n.kind == "unary" and n.value == "not" or id(n) in self.columns or n.kind == "call" and n.value.kind == "name" and bool(self._predicate(n.value.value))

    # -- expressions

    def expr(self, n: Node) -> Val:
        if id(n) in self.columns:
            return Val("bool", self.columns[id(n)])
        return getattr(self, "_e_" + n.kind)(n)

    def _e_number(self, n):
        return lit(n.value)

    _e_string = _e_const = _e_number

    def _e_typed(self, n):
        return Val("bool", F.lit(True))

    _e_typed_in = _e_typed

    def _e_name(self, n: Node) -> Val:
        name = n.value
        if name in self.env:
            return self.env[name]
        if name in self.assigned:
            return self.expr(self.assigned[name])
        if name in self.c.module.constants:
            return self.expr(self.c.module.constants[name])
        if name == "input":
            return Val("obj", None, type="Input", path=F.lit(""))
        if name in self.c.module.imports or name in FUNCTIONS or name in self.c.functions:
            return Val("module", None, type=self.c.module.imports.get(name, name))
        raise PolicyError(f"unknown name {name}", self.c.module.source, n.at)

    def _e_list(self, n: Node) -> Val:
        items = [self.expr(p) for p in n.parts]
        if not items:
            return lit([])
        if all(i.kind == items[0].kind for i in items) and items[0].kind in ("str", "num", "bool", "list"):
            const = [i.const for i in items] if all(i.const is not None for i in items) else None
            return Val("list", F.array(*[i.col for i in items]), elem=items[0] if items[0].kind == "list" else items[0].kind, const=const)
        return Val("list", F.array(*[V.as_text(i) for i in items]), elem="str")

    def _e_dict(self, n: Node) -> Val:
        fields = {p.value: self.expr(p.parts[0]) for p in n.parts}
        const = {k: v.const for k, v in fields.items()} if all(v.const is not None for v in fields.values()) else None
        return Val("struct", None, fields=fields, const=const)

    def _e_ternary(self, n: Node) -> Val:
        c, a, b = (self.expr(p) for p in n.parts)
        if a.kind == b.kind and a.col is not None:
            return replace(a, col=F.when(V.truthy(c), a.col).otherwise(b.col), const=None)
        return Val("str", F.when(V.truthy(c), V.as_text(a)).otherwise(V.as_text(b)))

    def _e_comprehension(self, n: Node) -> Val:
        source = self.expr(n.parts[1])
        col, kind = V.as_list(source)
        saved = self.env.get(n.value)

        def within(e: Column, node: Node) -> Val:
            self.env[n.value] = V.element(kind, e)
            self.quiet += 1
            try:
                return self.expr(node)
            finally:
                self.quiet -= 1
                if saved is None:
                    self.env.pop(n.value, None)
                else:
                    self.env[n.value] = saved

        if len(n.parts) > 2:
            col = F.filter(col, lambda e: F.coalesce(V.as_bool(within(e, n.parts[2])), F.lit(False)))
        shape = within(F.lit(None), n.parts[0]) if kind != "variant" else within(F.lit(None).cast("variant"), n.parts[0])
        flat = lambda v: v.variant() if v.kind in ("json", "variant") else V.as_str(v) if v.kind == "content" else v.col if v.col is not None else V.as_text(v)
        out = F.transform(col, lambda e: flat(within(e, n.parts[0])))
        elem = "variant" if shape.kind in ("json", "variant") else shape.kind if shape.kind in ("str", "num", "bool") else ("chunk" if shape.type == "Chunk" else "str")
        return Val("list", F.coalesce(out, F.filter(out, lambda _: F.lit(False))) if source.kind != "null" else F.array().cast("array<string>"), elem=elem)

    def _e_quantifier(self, n: Node) -> Val:
        raise PolicyError("a quantifier stands on a line of its own or under `not`", self.c.module.source, n.at)

    def _e_flow(self, n: Node) -> Val:
        names = [p.value if p.kind == "name" else p.value[0] for p in n.parts]
        a, b = (self.env[x] for x in names)
        for x, v in zip(names, (a, b), strict=True):
            if v.kind != "obj" or v.type not in EVENT_TYPES:
                raise PolicyError(f"{x} isn't an event, so it has no place in the flow", self.c.module.source, n.at)
        pa, pb = F.col(a.at + "pos"), F.col(b.at + "pos")
        return Val("bool", pa < pb if n.value == "->" else pb == pa + 1)

    def _e_unary(self, n: Node) -> Val:
        x = self.expr(n.parts[0])
        if n.value == "not":
            return Val("bool", ~V.truthy(x))
        col = V.as_num(x)
        return Val("num", -col if n.value == "-" else col, const=None if x.const is None else -x.const if n.value == "-" else x.const)

    def _e_binary(self, n: Node) -> Val:
        op = n.value
        if op == "is" and n.parts[1].kind in ("pattern", "tool", "ref"):
            return self._is_pattern(n)
        a, b = (self.expr(p) for p in n.parts)
        if op in ("and", "or"):
            x, y = V.truthy(a), V.truthy(b)
            return Val("bool", x & y if op == "and" else x | y)
        if op == "==":
            return Val("bool", V.equal(a, b))
        if op == "!=":
            return Val("bool", ~V.equal(a, b))
        if op == "is":
            if b.kind == "null":
                return Val("bool", V.is_none(a))
            if b.kind == "bool":
                return Val("bool", V.equal(a, b) if a.kind in ("bool", "json", "variant") else F.lit(False))
            raise PolicyError("`is` compares with None, True, False or a pattern", self.c.module.source, n.at)
        if op == "in":
            if a.kind == "str" and b.kind in ("str", "content") and b.path is not None and a.col is not None:
                self.mark(n, R.text_ranges(b.path, b.col, F.regexp_replace(V.as_str(a), r"([\\^$.|?*+()\[\]{}])", r"\\$1")))
            return V.contains(a, b)
        if op == "contains_only":  # a superset test: every element on the right is on the left
            x, y = V.as_list(a)[0], V.as_list(b)[0]
            return Val("bool", F.coalesce(F.size(F.array_except(y.cast("array<string>"), x.cast("array<string>"))) == 0, F.lit(False)))
        if op in ("<", "<=", ">", ">="):
            texts = ("str", "content")
            if a.kind in texts or b.kind in texts:
                x, y = V.as_str(a), V.as_str(b)
            else:
                x, y = V.as_num(a), V.as_num(b)
            return Val("bool", {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op])
        if op == "+" and (a.kind in ("str", "content") or b.kind in ("str", "content")):
            return Val("str", F.concat(V.as_str(a), V.as_str(b)))
        if op == "+" and a.kind == "list" and b.kind == "list":
            return Val("list", F.concat(a.col, b.col), elem=a.elem)
        if op == "*" and a.kind == "str" and b.kind == "num":
            return Val("str", F.repeat(a.col, b.col.cast("int")))
        x, y = V.as_num(a), V.as_num(b)
        if op == "%":  # the divisor's sign, as in Python
            return Val("num", x - y * F.floor(x / F.nullif(y, F.lit(0))))
        return Val("num", {"+": x + y, "-": x - y, "*": x * y, "/": x / F.nullif(y, F.lit(0)), "**": F.pow(x, y)}[op])

    def _e_member(self, n: Node) -> Val:
        x = self.expr(n.parts[0])
        name = n.value
        if x.kind == "obj":
            return self._attribute(x, name, n)
        if x.kind == "module":
            return Val("module", None, type=f"{x.type}.{name}")
        if x.kind == "struct":
            if name in x.fields:
                return x.fields[name]
            raise ExcessivePolicyError(f"no field {name}", self.c.module.source, n.at)
        if x.kind == "json":
            return Val("json", x.col, at=jpath(x.at, name))
        if x.kind == "variant":
            return Val("variant", F.try_variant_get(x.col, jpath("$", name), "variant"))
        if x.kind in ("str", "content"):  # a field of a text that is JSON
            return Val("json", V.as_str(x), at=jpath("$", name))
        raise ExcessivePolicyError(f"no attribute {name}", self.c.module.source, n.at)

    def _attribute(self, x: Val, name: str, n: Node) -> Val:
        if x.type == "Input":
            if name == "data":  # the trace itself
                return x
            if name not in self.c.parameters:
                raise MissingPolicyParameter(name)
            return lit(self.c.parameters[name])
        if x.type == "Chunk":
            key = {"text": "text", "type": "type", "image_url": "url"}.get(name)
            if key:
                return Val("str", x.col[key])
        elif x.type == "ToolParameter":
            if name in ("name", "type", "description"):
                return Val("str", x.col[name])
            if name == "required":
                return Val("bool", x.col[name])
            if name in ("items", "properties", "enum"):
                return Val("json", x.col["raw"], at=f"$.{name}")
        elif x.type == "Link":
            if name in ("name", "function"):
                return Val("str", F.col(x.at + "link_name")) if name == "name" else replace(x, type="LinkFunction")
            if name == "id":
                return Val("str", F.col(x.at + "link_id"))
        elif x.type in ("Function", "LinkFunction"):
            link = "link_" if x.type == "LinkFunction" else ""
            if name == "name":
                return Val("str", F.col(x.at + ("link_name" if link else "tool_name")), path=None if link else F.concat(F.col(x.at + "path"), F.lit(".function.name")))
            if name == "arguments":
                return Val("json", F.col(x.at + link + "args"))
        else:
            c = lambda f: F.col(x.at + f)
            if name == "metadata":
                return Val("json", c("metadata"))
            if name == "server":
                return Val("str", c("server"))
            if x.type in ("Message", "ToolOutput"):
                if name == "role":
                    return Val("str", c("role"), path=F.concat(c("path"), F.lit(".role")))
                if name == "content":
                    return Val("content", c("content"), fields={"chunks": c("chunks")}, path=F.concat(c("path"), F.lit(".content")))
                if name == "tool_calls" and x.type == "Message":
                    return Val("list", F.array().cast("array<string>"), elem="str", calls=x.at)
                if name == "tool_call_id" and x.type == "ToolOutput":
                    return Val("str", c("call_id"))
            elif x.type == "ToolCall":
                if name == "function":
                    return replace(x, type="Function")
                if name in ("id", "type"):
                    return Val("str", c("call_id" if name == "id" else "call_type"))
            elif x.type == "Tool":
                if name in ("name", "description"):
                    return Val("str", c("tool_name" if name == "name" else name))
                if name == "inputSchema":
                    return Val("list", F.coalesce(c("params"), F.array().cast(f"array<{PARAMETER}>")), elem="param")
        raise ExcessivePolicyError(f"{x.type} has no attribute {name}", self.c.module.source, n.at)

    def _e_key(self, n: Node) -> Val:
        x, k = self.expr(n.parts[0]), self.expr(n.parts[1])
        if x.kind == "struct" and k.const in x.fields:
            return x.fields[k.const]
        if x.kind == "list":
            i = k.col.cast("int")
            return V.element(x.elem if isinstance(x.elem, str) else x.elem.kind, F.get(x.col, F.when(i < 0, F.size(x.col) + i).otherwise(i)))
        if x.kind in ("str", "content") and k.kind == "num":  # a character; of a content of chunks, a chunk's text
            i = k.col.cast("int")
            at = F.when(i < 0, F.length(x.col) + i).otherwise(i) + 1
            character = F.when(at > 0, F.nullif(F.substring(x.col, at, F.lit(1)), F.lit("")))
            chunks = x.fields["chunks"] if x.kind == "content" else None
            return Val("str", character if chunks is None else F.coalesce(character, F.get(chunks, F.when(i < 0, F.size(chunks) + i).otherwise(i))["text"]))
        if x.kind in ("json", "variant", "str", "content") and isinstance(k.const, (str, int)):
            if x.kind == "variant" or isinstance(k.const, int) and k.const < 0:
                v = x.variant()
                if isinstance(k.const, int) and k.const < 0:
                    items = F.try_variant_get(v, "$", "array<variant>")
                    return Val("variant", F.get(items, F.size(items) + k.const))
                return Val("variant", F.try_variant_get(v, jpath("$", k.const), "variant"))
            at = x.at if x.kind == "json" else "$"
            return Val("json", V.as_str(x) if x.kind != "json" else x.col, at=jpath(at, k.const))
        if x.kind in ("json", "variant"):
            return Val("variant", F.get(F.map_filter(F.try_variant_get(x.variant(), "$", "map<string,variant>"), lambda a, _: a == V.as_str(k)), V.as_str(k)))
        if x.kind == "struct" and x.fields:
            pairs = [p for name, v in x.fields.items() for p in (F.lit(name), V.as_text(v))]
            return Val("json", F.try_element_at(F.create_map(*pairs), V.as_str(k)))
        raise ExcessivePolicyError("this value has no keys", self.c.module.source, n.at)

    # -- patterns

    def _is_pattern(self, n: Node) -> Val:
        x, p = self.expr(n.parts[0]), n.parts[1]
        if p.kind == "ref":
            return Val("bool", F.coalesce(self._match(x, p), F.lit(False)))
        if x.kind != "obj" or x.type not in ("ToolCall", "ToolOutput"):
            return Val("null", F.lit(None).cast("string"))  # no boolean: never satisfied
        link = "link_" if x.type == "ToolOutput" else ""
        col = F.col(x.at + ("link_name" if link else "tool_name")) == p.value
        if p.kind == "pattern" and p.parts:
            if len(p.parts) != 1:
                return Val("bool", F.lit(False))
            col = col & F.coalesce(self._match(Val("json", F.col(x.at + link + "args")), p.parts[0]), F.lit(False))
        return Val("bool", col)

    def _match(self, x: Val, p: Node) -> Column:
        """Whether a value fits a pattern: dicts may hold more keys, lists have equal lengths, constants are of one type."""
        if p.kind == "wildcard":
            return x.variant().isNotNull() if x.kind in ("json", "variant") else F.lit(True)
        if p.kind == "ref":
            return self._ref(x, p)
        if p.kind == "dict":
            out = F.lit(True)
            for e in p.parts:
                out = out & F.coalesce(self._match(Val("variant", F.try_variant_get(x.variant(), jpath("$", e.value), "variant")), e.parts[0]), F.lit(False))
            return out
        if p.kind == "list":
            items = F.try_variant_get(x.variant(), "$", "array<variant>")
            out = F.size(items) == len(p.parts)
            for i, e in enumerate(p.parts):
                out = out & F.coalesce(self._match(Val("variant", F.get(items, i)), e), F.lit(False))
            return out
        if p.kind in ("string", "number", "const", "name"):
            c = self.expr(p)
            if c.kind == "str":
                text = V.as_str(x)
                return (text == c.const) | text.rlike(f"^(?s:{python_regex(c.const)}$)")
            if c.kind == "num":
                whole = isinstance(c.const, int)
                schema = F.schema_of_variant(x.variant())
                return (schema == "BIGINT" if whole else schema.startswith("DECIMAL") | (schema == "DOUBLE")) & V.equal(c, x)
            return V.equal(c, x)
        raise PolicyError(f"a pattern can't hold this ({p.kind})", self.c.module.source, p.at)

    def _ref(self, x: Val, p: Node) -> Column:
        if p.value in self.c.matchers:
            return self.c.matchers[p.value](V.as_str(x))
        if p.value in ("EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS", "CREDIT_CARD", "LOCATION", "PERSON"):
            return F.size(D.pii(V.as_str(x), [p.value])) > 0
        if p.value == "MODERATED":
            return D.moderated(V.as_str(x))
        if p.value == "DUMMY":
            return V.as_str(x) == "__DUMMY__"
        raise PolicyError(f"unknown value reference <{p.value}>", self.c.module.source, p.at)

    _e_pattern = _e_tool = _e_ref = _e_wildcard = lambda self, n: (_ for _ in ()).throw(PolicyError("a pattern stands on the right of `is`", self.c.module.source, n.at))

    # -- calls

    def _e_call(self, n: Node) -> Val:
        f, (args, named) = n.value, n.parts
        if f.kind == "member":
            receiver = self.expr(f.parts[0])
            if receiver.kind != "module":
                return self._method(receiver, f.value, [self.expr(a) for a in args], n)
            name = f.value
        elif f.kind == "name":
            name = f.value
            if self._predicate(name):
                return self._inline(name, args, n)
            name = self.c.module.imports.get(name, name).split(".")[-1]
        else:
            raise ExcessivePolicyError("this can't be called", self.c.module.source, n.at)
        if name in ("is_sensitive", "is_sensitive_dir") and name not in self.c.functions:
            return self._sensitive(name, list(args), dict(named), n)
        values, options = [self.expr(a) for a in args], {k: self.expr(v) for k, v in named}
        if self.c.link is not None and name not in self.c.functions:
            linked = self.c.link(self.c.module.imports.get(f.value, name) if f.kind == "name" else f"{receiver.type}.{name}")
            if linked is not None:
                return linked(*values, **options)
        if name in self.c.functions:
            return self.c.functions[name](*values, **options)
        if name not in FUNCTIONS:
            raise PolicyError(f"unknown function {name}", self.c.module.source, n.at)
        self.call = n  # functions mark ranges under it
        return FUNCTIONS[name](self, *values, **options)

    def _judge(self, detector: Node, content: Val, n: Node) -> Column:
        """Whether a detector, given by name, finds something in a text."""
        found = self._e_call(Node("call", detector, ((Node("held", content),), ()), n.at))
        return V.truthy(found) if found.kind == "list" else F.coalesce(V.as_bool(found), F.lit(False))

    def _e_held(self, n: Node) -> Val:
        return n.value

    def _sensitive(self, name: str, args: list[Node], named: dict, n: Node) -> Val:
        """is_sensitive(file or text, detector); is_sensitive_dir(workspace, [detectors], path, pattern, tree), which is settled by one job over the files."""
        if name == "is_sensitive":
            x = self.expr(args[0])
            return Val("bool", self._judge(args[1], x.fields["content"] if x.kind == "struct" else Val("str", V.as_str(x)), n))
        from ..sources.traces import file_contents

        rest = [self._constant(a) for a in args[2:]]
        options = {"tree": True} | dict(zip(("path", "pattern", "tree"), rest, strict=False)) | {k: self._constant(v) for k, v in named.items()}
        files = file_contents(self.c.events.sparkSession, self._constant(args[0]), **options)
        hits = F.lit(False)
        for detector in args[1].parts:
            hits = hits | self._judge(detector, Val("str", F.col("content")), n)
        return lit(bool(files.where(hits).limit(1).count()))

    def _inline(self, name: str, args: tuple, n: Node) -> Val:
        p = self._predicate(name)
        if len(args) != len(p.parameters):
            raise PolicyError(f"{name} takes {len(p.parameters)} positional arguments", self.c.module.source, n.at)
        inner = Compiler(self.c, p.body, {k: self.expr(a) for (k, _), a in zip(p.parameters, args, strict=True)})
        inner.quiet = self.quiet
        tris = [t for t in (inner._line(line, set(), False) for line in p.body) if t is not None]
        self.marks |= {(id(n), *k): m for k, m in inner.marks.items()}
        return Val("bool", inner._all(tris))

    def _method(self, x: Val, name: str, args: list[Val], n: Node) -> Val:
        if x.kind in ("json", "variant", "struct") and name in ("keys", "values", "items", "get"):
            if x.kind == "struct":
                if name == "keys":
                    return lit(list(x.fields))
                if name == "values":
                    return Val("list", F.array(*[V.as_text(v) for v in x.fields.values()]), elem="str")
                return x.fields.get(args[0].const, args[1] if len(args) > 1 else lit(None))
            entries = F.try_variant_get(x.variant(), "$", "map<string,variant>")
            if name == "keys":
                return Val("list", F.map_keys(entries), elem="str")
            if name == "values":
                return Val("list", F.map_values(entries), elem="variant")
            if name == "items":
                quoted = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
                pairs = F.transform(F.map_entries(entries), lambda e: F.parse_json(F.concat(F.lit("["), quoted(e["key"]), F.lit(","), F.to_json(e["value"]), F.lit("]"))))
                return Val("list", pairs, elem="variant")
            got = F.try_variant_get(x.variant(), jpath("$", args[0].const), "variant")
            if len(args) > 1 and args[1].kind == "str":
                return Val("str", F.coalesce(V.as_str(Val("variant", got)), args[1].col))
            if len(args) > 1 and args[1].kind == "num":
                return Val("num", F.coalesce(V.as_num(Val("variant", got)), args[1].col.cast("double")))
            return Val("variant", got)
        if x.kind not in ("str", "content", "json", "variant"):
            raise ExcessivePolicyError(f"no method {name}", self.c.module.source, n.at)
        s = V.as_str(x)
        if name in ("lower", "upper"):
            return Val("str", getattr(F, name)(s))
        if name == "strip":
            if args:
                chars = "[" + R.quoted(args[0].const) + "]+"
                return Val("str", F.regexp_replace(s, f"^{chars}|{chars}$", ""))
            return Val("str", F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
        if name == "split":
            if args and args[0].const is not None:
                return Val("list", F.split(s, R.quoted(args[0].const), -1), elem="str")
            return Val("list", F.filter(F.split(s, r"(?U)\s+"), lambda w: w != ""), elem="str")
        if name == "splitlines":
            lines = F.split(s, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]", -1)
            return Val("list", F.when(F.get(lines, F.size(lines) - 1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines), elem="str")
        if name == "join":
            return Val("str", F.call_function("array_join", V.as_list(args[0])[0].cast("array<string>"), s))
        if name == "format":
            if not isinstance(x.const, str):
                raise ExcessivePolicyError("only a constant can be a format", self.c.module.source, n.at)
            return Val("str", F.format_string(re.sub(r"\{\d*\}", "%s", x.const.replace("%", "%%")), *[V.as_str(a) for a in args]))
        raise ExcessivePolicyError(f"no method {name}", self.c.module.source, n.at)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _texts(v: Val) -> Column:
    """All text of a value: of a content its text chunks too."""
    if v.kind == "obj" and v.type in ("Message", "ToolOutput"):
        v = Val("content", F.col(v.at + "content"), fields={"chunks": F.col(v.at + "chunks")})
    if v.kind == "obj" and v.type == "ToolCall":
        return F.col(v.at + "args")
    if v.kind == "obj":
        return v.col["text"]
    if v.kind == "list":
        return F.array_join(v.col.cast("array<string>"), "\n")
    return V.as_text(v) if v.kind in ("json", "variant") else V.as_str(v)


def _chunks_of(v: Val) -> Column:
    if v.kind == "obj" and v.type in ("Message", "ToolOutput"):
        return F.col(v.at + "chunks")
    return v.fields["chunks"] if v.kind == "content" else F.lit(None).cast("array<struct<type:string,text:string,url:string,idx:int>>")


def _f_any(c, x):
    col, kind = V.as_list(x)
    return Val("bool", F.coalesce(F.exists(col, lambda e: V.truthy(V.element(kind, e))), F.lit(False)))


def _f_len(c, x):
    if x.kind in ("str", "content"):
        return Val("num", F.length(V.as_str(x)))
    if x.kind in ("json", "variant"):
        v = x.variant()
        return Val("num", F.coalesce(F.length(V.as_str(x)), F.size(F.try_variant_get(v, "$", "array<variant>")), F.size(F.try_variant_get(v, "$", "map<string,variant>"))))
    return Val("num", F.size(V.as_list(x)[0]) if x.kind != "struct" else F.lit(len(x.fields)))


def _numbers(x):
    col, kind = V.as_list(x)
    return F.transform(col, lambda e: V.as_num(V.element(kind, e)).cast("double")) if kind == "variant" else col


def _f_find(c, p, x):
    text, pattern = _texts(x), python_regex(p.const)
    if x.path is not None:
        c.mark(c.call, R.text_ranges(x.path, text, F.lit(pattern)))
    return Val("list", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), elem="str")


def _f_extreme(pick, fold):
    def f(c, *xs):
        return Val("num", fold(_numbers(xs[0]))) if len(xs) == 1 else Val("num", pick(*[V.as_num(x) for x in xs]))

    return f


def _f_text(c, *xs):
    parts = []
    for x in xs:
        parts.append(F.array_compact(F.array(V.as_str(x) if x.kind == "str" else F.col(x.at + "content") if x.kind == "obj" and x.type in ("Message", "ToolOutput") else x.col if x.kind == "content" else _texts(x))))
        chunks = _chunks_of(x)
        parts.append(F.coalesce(F.transform(F.filter(chunks, lambda k: k["text"].isNotNull()), lambda k: k["text"]), F.array().cast("array<string>")))
    return Val("list", F.concat(*parts), elem="str")


def _f_image(c, *xs):
    parts = [F.coalesce(F.transform(F.filter(_chunks_of(x), lambda k: k["url"].isNotNull()), lambda k: k["url"]), F.array().cast("array<string>")) for x in xs if x.kind != "str"]
    parts += [F.when(x.col.rlike("^data:image/(png|jpe?g);base64,"), F.array(x.col)).otherwise(F.array().cast("array<string>")) for x in xs if x.kind == "str"]
    return Val("list", F.concat(*parts), elem="str")


def _f_tool_call(c, x):
    return Val("obj", None, type="Link", at=x.at, path=F.col(x.at + "path"))


def _f_rbac(c, data, scope, user, roles, grants):
    """Whether a role of the user grants the scope; roles and grants are constants, user and scope may be any text."""
    none = F.array().cast("array<string>")
    table = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]) if v else none)]) if d else F.create_map().cast("map<string,array<string>>")
    granted = table({role: [s for s, yes in (scopes or {}).items() if yes] for role, scopes in grants.const.items()})
    names = F.coalesce(F.try_element_at(table(roles.const), V.as_str(user)), none)
    return Val("bool", F.exists(names, lambda r: F.coalesce(F.array_contains(F.try_element_at(granted, r), V.as_str(scope)), F.lit(False))))


def _strings(col):
    return Val("list", F.coalesce(col, F.array().cast("array<string>")), elem="str")


def _f_python(c, x, ipython_mode=None):
    s = D.python_code(_texts(x))
    return Val("struct", None, fields={k: _strings(s[k]) for k in ("imports", "builtins", "function_calls")} | {"syntax_error": Val("bool", s["syntax_error"]), "syntax_error_exception": Val("str", s["syntax_error_exception"])})


def _f_html(c, x):
    s = D.html_code(_texts(x))
    return Val("struct", None, fields={"alt_texts": _strings(s["alt_texts"]), "links": _strings(s["links"])})


def _f_similarity(c, data, target, mode=None):
    """The best (or, by mode, the worst) similarity of the texts to the target's, by the registered scorer."""
    kind = mode.const if mode is not None else "max"
    if kind not in ("min", "max"):
        raise PolicyError("mode is min or max")
    if "embedding" not in D.SCORERS:
        raise PolicyError("embedding_similarity needs an embedding scorer; see register_scorer")
    targets = target.const if isinstance(target.const, (list, tuple)) else [target.const]
    texts = _f_text(c, data).col

    def against(target):
        return F.transform(texts, lambda t: D.SCORERS["embedding"](t, target))

    scores = [against(x) for x in targets]
    both = F.concat(*scores) if len(scores) > 1 else scores[0]
    return Val("num", (F.array_min if kind == "min" else F.array_max)(both))


def _f_similar(c, data, target, threshold=None):
    t = D.SIMILARITY.get(threshold.const, threshold.const) if threshold is not None else D.SIMILARITY["might_resemble"]
    return Val("bool", F.coalesce(_f_similarity(c, data, target).col > float(t), F.lit(False)))


def _spot(v: Val) -> tuple[Column, Column] | None:
    """(path, text) of a value that is one text of the trace."""
    if v.kind == "obj" and v.type in ("Message", "ToolOutput"):
        return F.concat(F.col(v.at + "path"), F.lit(".content")), F.col(v.at + "content")
    return (v.path, v.col) if v.kind in ("str", "content") and v.path is not None else None


def _finder(find, patterns=None):
    """A detector that returns class names and marks what its patterns match. patterns: (options) -> regular expressions."""

    def f(c, x, *args, **options):
        values = [a.const for a in args], {k: v.const for k, v in options.items()}
        spot = _spot(x)
        if spot is not None and patterns is not None:
            for i, p in enumerate(patterns(*values[0], **values[1])):
                c.mark(c.call, R.text_ranges(*spot, F.lit(p)), i)
        return _strings(find(_texts(x), *values[0], **values[1]))

    return f


def _flagged(c, x, hit: Column) -> Val:
    """A text that a model flags is marked as a whole."""
    spot = _spot(x)
    if spot is not None:
        path, text = spot
        whole = F.struct(path.alias("json_path"), F.lit(0).alias("start"), F.length(text).alias("end"))
        c.mark(c.call, F.when(hit, F.array(whole)).otherwise(F.array().cast(f"array<{R.RANGE}>")))
    return Val("bool", hit)


def _f_moderated(c, x, model=None, default_threshold=None, cat_thresholds=None):
    limits = cat_thresholds.const if cat_thresholds is not None else None
    return _flagged(c, x, D.moderated(_texts(x), default_threshold.const if default_threshold is not None else 0.5, limits))


def _f_injection(c, x, model=None, threshold=None):
    return _flagged(c, x, D.prompt_injection(_texts(x), threshold.const if threshold is not None else 0.9))


def _needs(name: str) -> None:
    if name not in D.SCORERS:
        raise PolicyError(f"{name} needs a registered scorer")


def _f_llm(c, prompt, *rest, **options):
    _needs("llm")
    return Val("str", D.answers(_texts(prompt)))


def _f_confirm(c, question, *rest, **options):
    _needs("llm")
    return Val("bool", D.confirmed(_texts(question)))


def _f_ocr(c, images, **options):
    """The texts of images: of one, given as text, or of a list such as image(m)."""
    _needs("ocr")
    many = images.col if images.kind == "list" else F.array(V.as_str(images))
    read = D.read_images(many)
    return Val("list", read, elem="str") if images.kind == "list" else Val("str", F.get(read, 0))


def _f_semgrep(c, x, lang=None):
    _needs("semgrep")
    return Val("list", D.code_issues(_texts(x), lang.const if lang is not None else "python"), elem="variant")


def _f_fuzzy(c, x, query, query_threshold=None, use_semantic=None, threshold=None):
    near = threshold or query_threshold
    return Val("bool", D.fuzzy_contains(_texts(x), query.const, float(near.const) if near is not None else 0.8, use_semantic is None or bool(use_semantic.const)))


def _f_files(tree):
    def f(c, workspace, path=None, pattern=None):
        from ..sources.traces import list_files

        rows = list_files(c.c.events.sparkSession, workspace.const, pattern.const if pattern is not None else None, tree, path.const if path is not None else ".").select("path").orderBy("path").collect()  # names of a workspace
        return lit([r["path"] for r in rows])

    return f


def _f_file(c, workspace, path):
    from ..sources.traces import file_contents

    row = file_contents(c.c.events.sparkSession, workspace.const, path.const, tree=False).first()
    if row is None:
        raise FileNotFoundError(path.const)
    return Val("struct", None, type="File", fields={"path": lit(row["path"]), "content": lit(row["content"])})


def _f_contents(c, workspace, path=None, pattern=None, tree=None):
    given = lambda x, default: default if x is None else x.const
    return Val("module", None, type="Files", const=(workspace.const, given(path, "."), given(pattern, None), given(tree, True)))


FUNCTIONS = {
    "any": _f_any, "len": _f_len, "find": _f_find, "text": _f_text, "image": _f_image, "tool_call": _f_tool_call, "should_allow_rbac": _f_rbac, "python_code": _f_python, "ipython_code": _f_python, "html_code": _f_html, "is_similar": _f_similar,
    "empty": lambda c, x: Val("bool", F.coalesce(_f_len(c, x).col == 0, F.lit(False))),
    "match": lambda c, p, x: Val("bool", V.as_str(x).rlike("^(?:" + python_regex(p.const) + ")")),
    "sum": lambda c, x: Val("num", F.aggregate(_numbers(x), F.lit(0.0), lambda a, e: a + e.cast("double"))),
    "min": _f_extreme(F.least, F.array_min), "max": _f_extreme(F.greatest, F.array_max),
    "print": lambda c, *x: Val("bool", F.lit(True)), "tuple": lambda c, x: x, "server": lambda c, x: Val("str", F.col(x.at + "server")), "json_loads": lambda c, x: Val("json", V.as_str(x)),
    "pii": _finder(D.pii, lambda entities=None: [p for n, p in D.PII.items() if entities is None or n in entities]),
    "secrets": _finder(D.secrets, lambda: D.SECRETS.values()),
    "unicode": _finder(D.unicode_categories, lambda categories=None: ["[" + "".join(rf"\p{{{k}}}" for k in categories or D.CATEGORIES if k != "Cs") + "]"]),
    "copyright": _finder(D.copyright_kinds, lambda threshold=0.5: [R.quoted(m) for m in D.COPYRIGHT_MARKS]),
    "links": _finder(D.links), "prompt_injection": _f_injection, "moderated": _f_moderated, "embedding_similarity": _f_similarity,
    "fuzzy_contains": _f_fuzzy,
    "get_files": _f_files(False), "get_tree_files": _f_files(True), "get_file_content": _f_file, "get_file_contents": _f_contents,
    "llm": _f_llm, "llm_confirm": _f_confirm, "ocr": _f_ocr, "semgrep": _f_semgrep,
}
