"""Functions for rules from Python: out of modules that a policy's owner allows, or out of plain functions of texts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import Val
from .syntax import PolicyError

#: Kinds of results that a plain function may have.
RESULTS = {"boolean": "bool", "string": "str", "double": "num", "array<string>": "list"}


def modules(*allowed: str) -> Callable:
    """A `link` for policies: `from some.module import f` reaches the functions of the modules named here, imported when a rule first calls one of
    them; all others stay unknown. Functions take and return Val; wrap plain ones in python_function."""

    def link(path: str):
        owner, _, name = path.rpartition(".")
        if owner not in allowed:
            return None
        found = getattr(importlib.import_module(owner), name, None)
        if not callable(found):
            raise PolicyError(f"{owner} has no function {name}")
        return found

    return link


def python_function(function: Callable, returns: str = "boolean") -> Callable:
    """A function of texts (str or None) as a function of rules, run on Arrow batches. An error in it ends the query."""
    if returns not in RESULTS:
        raise ValueError(f"returns is one of {', '.join(RESULTS)}")

    def call(*values: Val) -> Val:
        run = F.pandas_udf(lambda *texts: pd.Series([function(*row) for row in zip(*texts, strict=True)], dtype=object), returns)  # needs a session
        out = run(*[V.as_str(v) if v.kind == "content" else V.as_text(v) for v in values])
        return Val(RESULTS[returns], F.coalesce(out, F.array().cast(returns)), elem="str") if returns == "array<string>" else Val(RESULTS[returns], out)

    return call
