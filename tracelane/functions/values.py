"""Typed values of the rule language while it is compiled, and their conversions to columns. Lenient: what can't be converted is null."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Val:
    """kind: str, num, bool, null, list (of `elem`), json (text of a document, at `at`), variant, content (an event's content), obj (an event
    or a part of one), struct (named fields), module."""

    kind: str
    col: Column | None = None
    elem: Val | str | None = None
    const: Any = None
    at: str = "$"
    type: str | None = None
    fields: dict | None = None
    path: Column | None = None  # JSON path of a text in its trace, for ranges
    calls: str | None = None  # prefix of the message whose calls this is

    def variant(self) -> Column:
        if self.kind == "variant":
            return self.col
        whole = F.try_parse_json(self.col)
        return whole if self.at == "$" else F.try_variant_get(whole, self.at, "variant")


def lit(value) -> Val:
    if value is None:
        return Val("null", F.lit(None).cast("string"), const=None)
    if isinstance(value, bool):
        return Val("bool", F.lit(value), const=value)
    if isinstance(value, (int, float)):
        return Val("num", F.lit(value), const=value)
    if isinstance(value, str):
        return Val("str", F.lit(value), const=value)
    if isinstance(value, (list, tuple)):
        items = [lit(v) for v in value]
        kind = items[0].kind if items and all(i.kind == items[0].kind for i in items) else "str"
        return Val("list", F.array(*[i.col.cast("string") if kind == "str" else i.col for i in items]) if items else F.array().cast("array<string>"), elem=kind, const=list(value))
    if isinstance(value, dict):
        return Val("struct", None, fields={k: lit(v) for k, v in value.items()}, const=value)
    raise TypeError(f"no literal for {value!r}")


def schema_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def as_str(x: Val) -> Column:
    if x.kind in ("json", "variant"):
        v = x.variant()
        return F.when(schema_of(v) == "STRING", F.try_variant_get(v, "$", "string"))
    if x.kind == "content":
        return F.coalesce(x.col, F.array_join(F.transform(F.filter(x.fields["chunks"], lambda c: c["text"].isNotNull()), lambda c: c["text"]), " "))
    if x.kind in ("str", "null"):
        return x.col
    if x.kind == "num":
        return x.col.cast("string")
    if x.kind == "bool":
        return F.when(x.col, "True").otherwise("False")
    return as_text(x)


def as_text(x: Val) -> Column:
    """Any value as text: strings as they are, the rest as JSON."""
    if x.kind in ("json", "variant"):
        v = x.variant()
        return F.coalesce(F.when(schema_of(v) == "STRING", F.try_variant_get(v, "$", "string")), F.to_json(v))
    if x.kind == "list":
        return F.to_json(x.col)
    if x.kind == "struct":
        return F.to_json(F.struct(*[as_text(v).alias(k) for k, v in x.fields.items()]))
    if x.kind == "obj":
        return x.path
    return as_str(x)


def as_num(x: Val) -> Column:
    if x.kind in ("json", "variant"):
        v = x.variant()
        return F.when(~schema_of(v).isin("STRING", "BOOLEAN"), F.try_variant_get(v, "$", "double"))
    return x.col if x.kind == "num" else F.lit(None).cast("double")


def as_bool(x: Val) -> Column | None:
    """A condition's column, or None for a value that is no boolean and so never satisfies."""
    if x.kind == "bool":
        return x.col
    if x.kind in ("json", "variant"):
        v = x.variant()
        return F.when(schema_of(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
    return None


def truthy(x: Val) -> Column:
    if x.kind == "null":
        return F.lit(False)
    if x.kind == "bool":
        return F.coalesce(x.col, F.lit(False))
    if x.kind == "num":
        return F.coalesce(x.col != 0, F.lit(False))
    if x.kind == "list":
        return F.coalesce(F.size(x.col) > 0, F.lit(False))
    if x.kind in ("str", "content"):
        return F.coalesce(F.length(as_str(x)) > 0, F.lit(False))
    if x.kind in ("json", "variant"):
        return F.coalesce(~F.to_json(x.variant()).isin("null", "false", "0", '""', "[]", "{}"), F.lit(False))
    return F.lit(True)


def as_list(x: Val) -> tuple[Column, str]:
    """(array, kind of its elements)."""
    if x.kind == "list":
        return x.col, x.elem if isinstance(x.elem, str) else x.elem.kind
    if x.kind in ("json", "variant"):
        return F.try_variant_get(x.variant(), "$", "array<variant>"), "variant"
    if x.kind == "content":
        return x.fields["chunks"], "chunk"
    if x.kind == "null":
        return F.array().cast("array<string>"), "str"
    return F.array(x.col), x.kind


def element(kind: str, col: Column) -> Val:
    """The value of an array's element."""
    if kind == "chunk":
        return Val("obj", col, type="Chunk")
    if kind == "param":
        return Val("obj", col, type="ToolParameter")
    return Val(kind, col)


def equal(a: Val, b: Val) -> Column:
    """Python's ==: values of unlike kinds are unequal; None equals None."""
    if "null" in (a.kind, b.kind):
        other = b if a.kind == "null" else a
        return is_none(other)
    loose = ("json", "variant")
    if a.kind in loose and b.kind in loose:
        return F.to_json(a.variant()).eqNullSafe(F.to_json(b.variant()))
    if a.kind in loose:
        a, b = b, a
    if b.kind in loose:
        if a.kind in ("str", "content"):
            return F.coalesce(as_str(a) == as_str(b), F.lit(False))
        if a.kind == "num":
            return F.coalesce(a.col.cast("double") == as_num(b), F.lit(False))
        if a.kind == "bool":
            return F.coalesce(a.col == as_bool(b), F.lit(False))
        return F.coalesce(as_text(a) == F.to_json(b.variant()), F.lit(False))
    texts = ("str", "content")
    if a.kind in texts and b.kind in texts:
        return as_str(a).eqNullSafe(as_str(b))
    if a.kind != b.kind and not {a.kind, b.kind} <= {"num", "bool"}:
        return F.lit(False)
    if a.kind == "list":
        return a.col.eqNullSafe(b.col)
    if a.kind == "obj":
        return a.path.eqNullSafe(b.path)
    if a.kind == "struct":
        return as_text(a).eqNullSafe(as_text(b))
    x, y = (c.col.cast("int") if c.kind == "bool" and a.kind != b.kind else c.col for c in (a, b))
    return x.eqNullSafe(y)


def is_none(x: Val) -> Column:
    if x.kind == "null":
        return F.lit(True)
    if x.kind in ("json", "variant"):
        v = x.variant()
        return v.isNull() | F.is_variant_null(v)
    if x.kind == "content":
        return x.col.isNull() & x.fields["chunks"].isNull()
    return x.col.isNull() if x.col is not None else F.lit(False)


def contains(needle: Val, hay: Val) -> Val:
    """Python's `in`; a list on the left gives a list of booleans."""
    if needle.kind == "list" and hay.kind in ("list", "json", "variant"):
        kind = as_list(needle)[1]
        return Val("list", F.transform(needle.col, lambda x: contains(element(kind, x), hay).col), elem="bool")
    no = F.lit(False)
    if hay.kind == "null":
        return Val("bool", no)
    if hay.kind == "str":
        return Val("bool", F.coalesce(F.contains(hay.col, as_str(needle)), no))
    if hay.kind == "content":
        n = as_str(needle)
        return Val("bool", F.coalesce(F.contains(hay.col, n), no) | F.coalesce(F.exists(hay.fields["chunks"], lambda c: F.coalesce(F.contains(F.coalesce(c["text"], c["url"]), n), F.lit(False))), no))
    if hay.kind == "struct":
        return Val("bool", F.coalesce(as_str(needle).isin(*hay.fields), no) if hay.fields else no)
    if hay.kind in ("json", "variant"):
        v = hay.variant()
        items = F.try_variant_get(v, "$", "array<variant>")
        keys = F.try_variant_get(v, "$", "map<string,variant>")
        inside = F.exists(items, lambda x: equal(needle, Val("variant", x)))
        return Val("bool", F.coalesce(F.contains(as_str(hay), as_str(needle)), no) | F.coalesce(inside, no) | F.coalesce(F.array_contains(F.map_keys(keys), as_str(needle)), no))
    items, kind = as_list(hay)
    return Val("bool", F.coalesce(F.exists(items, lambda x: equal(needle, element(kind, x))), no))
