"""Traces as Spark tables.

`events`: one row per object of the flow sequence (messages, each followed by its tool calls; calls; outputs; tool declarations), with
trace_id, pos (place in the sequence), trace_idx (index of the parsed event; calls share their message's) and path (JSON path).
An output is linked to the latest call before it with its id (an as-of join, done with one window).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = "struct<type:string,text:string,url:string,idx:int>"
PARAMETER = "struct<name:string,type:string,description:string,required:boolean,raw:string>"
#: Names of parameter types that have another common spelling.
TYPE_ALIASES = {"integer": "int", "number": "float", "boolean": "bool", "string": "str", "array": "list", "object": "dict"}
EVENTS = (
    "trace_id bigint, pos int, trace_idx int, path string, kind string, role string, content string, json boolean, chunks array<" + CHUNK + ">, tool_name string, args string, call_id string,"
    " call_type string, link_pos int, link_name string, link_args string, link_id string, server string, metadata string, description string, params array<" + PARAMETER + ">"
)


def empty_columns() -> dict[str, Column]:
    import re

    out = {}
    for part in re.split(r",(?![^<]*>)", EVENTS):
        name, kind = part.strip().split(" ", 1)
        out[name] = F.lit(None).cast(kind)
    return out


def shaped(df: DataFrame, **columns: Column) -> DataFrame:
    """df with exactly the columns of `events`; those not given are null."""
    return df.select(*[(columns.get(n, empty)).alias(n) for n, empty in empty_columns().items()])


class InvalidTrace(ValueError):
    """An event that is neither message, call, output nor tool declaration."""


def _chunks(content) -> list[dict] | None:
    if not isinstance(content, list):
        return None
    out = []
    for i, c in enumerate(content):
        c = c if isinstance(c, dict) else {"type": "text", "text": str(c)}
        url = c.get("image_url")
        known = "text" in c or "image_url" in c
        out.append({"type": c.get("type"), "text": c.get("text") if known else json.dumps(c, ensure_ascii=False), "url": url.get("url") if isinstance(url, dict) else url, "idx": i})
    return out


def _content(content) -> dict:
    if content is None or isinstance(content, str):
        return {"content": content, "json": False, "chunks": None}
    if isinstance(content, list):
        return {"content": None, "json": False, "chunks": _chunks(content)}
    return {"content": json.dumps(content), "json": True, "chunks": None}


def _parameters(schema: dict) -> list[dict]:
    required, out = schema.get("required") or [], []

    def walk(properties: dict, prefix: str) -> None:
        for name, p in properties.items():
            kind, needed = p.get("type"), (name if not prefix else f"{prefix}.{name}") in required
            options = p.get("anyOf") or []
            if options or isinstance(kind, list):
                kinds = [o.get("type") for o in options] or kind
                needed = needed and "null" not in kinds
                kind = next((k for k in kinds if k != "null"), None)
            out.append({"name": f"{prefix}.{name}" if prefix else name, "type": TYPE_ALIASES.get(kind, kind), "description": p.get("description"), "required": needed, "raw": json.dumps(p)})
            if isinstance(p.get("properties"), dict):
                walk(p["properties"], f"{prefix}.{name}" if prefix else name)

    walk(schema.get("properties") or {}, "")
    return out


def normalise(trace_id: int, trace: list) -> list[dict]:
    """The rows of one trace. Raises InvalidTrace for an event of no kind; a missing tool_call_id takes the last call's."""
    rows: list[dict] = []
    calls: dict = {}
    state = {"last": None, "idx": 0}

    def add(kind: str, path: str, raw: dict, **more) -> dict:
        meta = raw.get("metadata")
        rows.append({"trace_id": trace_id, "pos": len(rows), "trace_idx": state["idx"], "path": path, "kind": kind, "metadata": json.dumps(meta) if meta is not None else None, "server": (meta or {}).get("server") if isinstance(meta, dict) else None} | more)
        return rows[-1]

    def call(raw: dict, path: str) -> None:
        function = raw.get("function") or {}
        args = function.get("arguments")
        if isinstance(args, str):
            try:
                args = json.loads(args)
            except ValueError:
                pass
        row = add("ToolCall", path, raw, tool_name=function.get("name"), args=json.dumps(args if args is not None else {}), call_id=raw.get("id"), call_type=raw.get("type"))
        calls[raw.get("id")] = row
        state["last"] = raw.get("id")

    for i, event in enumerate(trace):
        if not isinstance(event, dict):
            raise InvalidTrace(f"event {i} of trace {trace_id} is no object")
        if event.get("role") == "tool":
            key = event.get("tool_call_id", state["last"])
            link = calls.get(key)
            linked = {"link_pos": link["pos"], "link_name": link["tool_name"], "link_args": link["args"], "link_id": link["call_id"]} if link else {}
            add("ToolOutput", str(i), event, role="tool", call_id=key, **_content(event.get("content")), **linked)
        elif "role" in event:
            add("Message", str(i), event, role=event["role"], **_content(event.get("content")))
            for j, c in enumerate(event.get("tool_calls") or []):
                call(c, f"{i}.tool_calls.{j}")
        elif "type" in event:
            call(event, str(i))
        elif "tools" in event:
            for j, tool in enumerate(event["tools"]):
                add("Tool", f"{i}.tools.{j}", tool, tool_name=tool.get("name"), description=tool.get("description"), params=_parameters(tool.get("inputSchema") or {}))
                state["idx"] += j + 1 < len(event["tools"])
        else:
            raise InvalidTrace(f"event {i} of trace {trace_id} has no role, type or tools")
        state["idx"] += 1
    return rows


def from_python(spark: SparkSession, traces: list[list]) -> DataFrame:
    """Events of traces given as lists of objects."""
    names = list(empty_columns())
    rows = [tuple(r.get(n) for n in names) for i, t in enumerate(traces) for r in normalise(i, t)]
    return spark.createDataFrame(rows, EVENTS)


def from_json(lines: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """lines: trace_id, value (a JSON array of events). Returns events and (trace_id, error) of traces that can't be read; strict raises."""
    import pandas as pd

    names = list(empty_columns())

    def read(frames):
        for frame in frames:
            out = []
            for trace_id, value in zip(frame["trace_id"], frame["value"], strict=True):
                try:
                    rows = normalise(trace_id, json.loads(value))
                    out += [[r.get(n) for n in names] + [None] for r in rows] or []
                except (ValueError, TypeError, AttributeError) as e:
                    if strict:
                        raise
                    out.append([trace_id, *[None] * (len(names) - 1), str(e)])
            yield pd.DataFrame(out, columns=[*names, "error"]).astype(object).where(lambda x: x.notna(), None)

    both = lines.select(F.col("trace_id").cast("long"), "value").mapInPandas(read, EVENTS + ", error string")
    return both.where("error IS NULL").drop("error"), both.where("error IS NOT NULL").select("trace_id", "error")


def read_jsonl(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """A trace set: one JSON array per line."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("trace_id", F.monotonically_increasing_id())
    return from_json(lines, strict)


def write_jsonl(traces: DataFrame, path: str) -> None:
    """traces: value, a JSON array of events per row."""
    traces.select("value").write.mode("overwrite").text(path)


def messages(conversations: DataFrame) -> DataFrame:
    """conversations: conv_id, turn, role, text."""
    return shaped(conversations, trace_id=F.col("conv_id").cast("long"), pos=F.col("turn").cast("int"), trace_idx=F.col("turn").cast("int"), path=F.col("turn").cast("string"), kind=F.lit("Message"), role=F.col("role"), content=F.col("text"), json=F.lit(False))


def calls(events: DataFrame) -> DataFrame:
    """events: event_id, ts, user_id, event_type, value, props: a call per event, a trace per user, in the order of ts."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    args = F.regexp_replace(F.col("props"), r"\}\s*$", F.concat(F.lit(', "value": '), F.col("value").cast("string"), F.lit("}")))
    return shaped(events, trace_id=F.col("user_id").cast("long"), pos=place.cast("int"), trace_idx=place.cast("int"), path=place.cast("string"), kind=F.lit("ToolCall"), tool_name=F.col("event_type"), args=args, call_id=F.col("event_id").cast("string"), call_type=F.lit("function"))


def outputs(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A trace of one output per row: documents or pages as tool results."""
    return shaped(rows, trace_id=F.col(id_col).cast("long"), pos=F.lit(0), trace_idx=F.lit(0), path=F.lit("0"), kind=F.lit("ToolOutput"), role=F.lit("tool"), content=F.col(text_col), json=F.lit(False))


def latest_call(rows: DataFrame, call: Column, within: Column, order: list, before: bool = True) -> DataFrame:
    """rows with `_call`: the latest call (a struct, null where a row is none) of the trace up to a row, or, with `before`, strictly before it: the as-of
    join that links outputs to calls, done with one window."""
    place = Window.partitionBy(within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return rows.withColumn("_call", F.last(call, ignorenulls=True).over(place))


# -- loaders of recorded trajectories

#: Tags of the recorded agent actions and the tool each stands for.
ACTION_TAGS = {"execute_bash": "bash", "execute_ipython": "ipython", "execute_browse": "browse"}


def from_trajectories(turns: DataFrame) -> DataFrame:
    """turns: trace_id, turn, role, content. Assistant turns with an action tag give a message and a call, user turns that begin with
    `OBSERVATION:` give the output of the latest call."""
    tag = F.coalesce(*[F.when(F.col("content").contains(f"<{t}>"), F.lit(t)) for t in ACTION_TAGS])
    code = F.regexp_extract("content", r"(?s)<(execute_\w+)>(.*?)</\1>", 2)
    base = turns.withColumn("_tag", F.when(F.col("role") == "assistant", tag)).withColumn("_code", code).withColumn("_obs", (F.col("role") == "user") & F.col("content").startswith("OBSERVATION:"))
    tool = F.coalesce(*[F.when(F.col("_tag") == t, F.lit(n)) for t, n in ACTION_TAGS.items()])
    parts = F.when(F.col("_tag").isNotNull(), F.array(F.lit("Message"), F.lit("ToolCall"))).otherwise(F.array(F.when(F.col("_obs"), "ToolOutput").otherwise("Message")))
    rows = base.select("*", tool.alias("_tool"), F.posexplode(parts).alias("_part", "_kind"))
    order = Window.partitionBy("trace_id").orderBy("turn", "_part")
    rows = rows.withColumn("_pos", F.row_number().over(order) - 1)
    call = F.when(F.col("_kind") == "ToolCall", F.struct(F.col("_pos").alias("pos"), F.col("_tool").alias("name"), F.to_json(F.struct(F.col("_code").alias("code"))).alias("args"), F.col("turn").cast("string").alias("id")))
    rows = latest_call(rows, call, F.col("trace_id"), ["turn", "_part"], before=False)
    is_call, is_out = F.col("_kind") == "ToolCall", F.col("_kind") == "ToolOutput"
    link = lambda f, c: F.when(is_out, F.col(f"_call.{f}")).cast(c)
    return shaped(
        rows, trace_id=F.col("trace_id").cast("long"), pos=F.col("_pos").cast("int"), trace_idx=F.col("turn").cast("int"), path=F.concat(F.col("turn").cast("string"), F.when(is_call, ".tool_calls.0").otherwise("")), kind=F.col("_kind"),
        role=F.when(is_out, "tool").when(~is_call, F.col("role")), content=F.when(is_out, F.trim(F.substring("content", 13, 1 << 30))).when(~is_call, F.col("content")), json=F.lit(False), tool_name=F.when(is_call, F.col("_tool")),
        args=F.when(is_call, F.col("_call.args")), call_id=F.when(is_call | is_out, F.col("_call.id")), call_type=F.when(is_call, "function"), link_pos=link("pos", "int"), link_name=link("name", "string"), link_args=link("args", "string"), link_id=link("id", "string"),
    )


def from_react(turns: DataFrame) -> DataFrame:
    """turns: trace_id, turn, role, content. A fenced bash block of an assistant turn is a call of its own after the message."""
    body = F.regexp_extract("content", r"(?s)```(?:bash|sh)\s*\n(.*?)```", 1)
    has = (F.col("role") == "assistant") & F.col("content").rlike(r"(?s)```(?:bash|sh)\s*\n.*?```")
    rows = turns.select("*", body.alias("_body"), F.posexplode(F.when(has, F.array(F.lit("Message"), F.lit("ToolCall"))).otherwise(F.array(F.lit("Message")))).alias("_part", "_kind"))
    place = F.row_number().over(Window.partitionBy("trace_id").orderBy("turn", "_part")) - 1
    is_call = F.col("_kind") == "ToolCall"
    return shaped(
        rows, trace_id=F.col("trace_id").cast("long"), pos=place.cast("int"), trace_idx=place.cast("int"), path=place.cast("string"), kind=F.col("_kind"), role=F.when(~is_call, F.col("role")), content=F.when(~is_call, F.col("content")), json=F.lit(False),
        tool_name=F.when(is_call, "bash"), args=F.when(is_call, F.to_json(F.struct(F.col("_body").alias("command")))), call_id=F.when(is_call, F.col("turn").cast("string")), call_type=F.when(is_call, "function"),
    )


# -- files

def _inside(workspace: str, path: str) -> str:
    if ".." in workspace.split("/") or ".." in path.split("/") or path.startswith("/"):
        raise ValueError("a workspace path can't climb")
    return workspace if path in (".", "") else f"{workspace.rstrip('/')}/{path}"


def list_files(spark: SparkSession, workspace: str, pattern: str | None = None, tree: bool = False, path: str = ".") -> DataFrame:
    """path, name, bytes of a workspace's files; nothing outside it is reached."""
    workspace = _inside(workspace, path)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(tree).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(workspace).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def file_contents(spark: SparkSession, workspace: str, path: str = ".", pattern: str | None = None, tree: bool = False) -> DataFrame:
    """path, content (UTF-8) of a workspace's files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(tree).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(_inside(workspace, path)).select("path", F.decode("content", "UTF-8").alias("content"))
