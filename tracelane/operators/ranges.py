"""Ranges: where in a trace a match lies. A range is (json_path, start, end); an object's range has no offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = "struct<json_path:string,start:int,end:int>"


def quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}-" else c for c in text)


def offsets(text: Column, pattern: Column) -> Column:
    """(start, end) of all matches of a regular expression that matches no empty text: the gaps between matches and the matches themselves
    have known lengths, so their running sum places each."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.transform(hits, lambda h, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(h).alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    run = lambda acc, s: F.struct((acc["at"] + s["gap"] + s["hit"]).alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["hit"]).alias("end"))).alias("out"))
    return F.aggregate(sizes, start, run)["out"]


def text_ranges(path: Column, text: Column, pattern: Column) -> Column:
    return F.coalesce(F.transform(offsets(text, pattern), lambda o: F.struct(path.alias("json_path"), o["start"].alias("start"), o["end"].alias("end"))), F.array().cast(f"array<{RANGE}>"))


def object_range(path: Column) -> Column:
    return F.struct(path.alias("json_path"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))


def address(r: Column) -> Column:
    """`messages.<path>:<start>-<end>`."""
    return F.concat(F.lit("messages."), r["json_path"], F.when(r["start"].isNotNull(), F.concat(F.lit(":"), r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))).otherwise(F.lit("")))


def parse_address(text: Column) -> Column:
    pattern = r"^messages\.(.*?)(?::(\d+)-(\d+))?$"
    number = lambda g: F.nullif(F.regexp_extract(text, pattern, g), F.lit("")).cast("int")
    return F.struct(F.regexp_extract(text, pattern, 1).alias("json_path"), number(2).alias("start"), number(3).alias("end"))


def mask(text: Column, spans: Column, sign: str = "*") -> Column:
    """text with every span (start, end) overlaid by signs, right to left; lengths stay."""
    ordered = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    return F.aggregate(ordered, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.repeat(F.lit(sign), s["end"] - s["start"]), F.substring(t, s["end"] + 1, F.length(t))))


def mask_json_paths(trace, addresses: list[str], sign):
    """A trace (lists, objects, texts) with the spans that addresses name (`<path>:<start>-<end>`, with or without `messages.`) replaced by
    sign(text of the span). Addresses without a span leave their object as it is. Spans of one text are replaced from its end."""
    import re

    spans: dict[str, list] = {}
    for a in addresses:
        m = re.fullmatch(r"(?:messages\.)?(.*):(\d+)-(\d+)", a)
        if m:
            spans.setdefault(m.group(1), []).append((int(m.group(2)), int(m.group(3))))

    def copied(x, path: str):
        if isinstance(x, str):
            for start, end in sorted(set(spans.get(path, ())), reverse=True):
                x = x[:start] + sign(x[start:end]) + x[end:]
            return x
        at = lambda k: f"{path}.{k}" if path else str(k)
        if isinstance(x, dict):
            return {k: copied(v, at(k)) for k, v in x.items()}
        return [copied(v, at(i)) for i, v in enumerate(x)] if isinstance(x, list) else x

    return copied(trace, "")
