"""Detectors and parsers. What built-in functions can express is a column expression; the rest are Arrow-batched UDFs over the standard
library. Detectors that need a model or a service are pluggable: register a scorer, or get the deterministic stand-in named here."""

from __future__ import annotations

import ast
import json
import re
from collections import OrderedDict
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of secrets.
SECRETS = {
    "GITHUB_TOKEN": r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}",
    "AWS_ACCESS_KEY": r"(?:A3T[A-Z0-9]|AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}",
    "AZURE_STORAGE_KEY": r"AccountKey=[A-Za-z0-9+/=]{88}",
    "SLACK_TOKEN": r"xox[abeoprs]-(?:[0-9]+-)*[A-Za-z0-9]+",
}
#: Personal data that patterns can name.
PII = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "IP_ADDRESS": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9.])",
    "PHONE_NUMBER": r"\+[0-9][ ().0-9-]{7,20}[0-9]",
    "CREDIT_CARD": r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])",
}
#: Titles of software licences, in the order they are tried, and marks of copyright.
LICENCES = {
    "GNU_AGPL_V3": "GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007",
    "GNU_GPL_V2": "GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007",
    "GNU_LGPL_V3": "GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007",
    "MOZILLA_PUBLIC_LICENSE_2.0": "Mozilla Public License Version 2.0",
    "APACHE_LICENSE_2.0": "Apache License\n                           Version 2.0, January 2004",
    "MIT_LICENSE": "MIT License",
    "BOOST_SOFTWARE_LICENSE": "Boost Software License - Version 1.0 - August 17th, 2003",
}
COPYRIGHT_MARKS = ("Copyright (C)", "Copyright ©")
#: Unicode general categories.
CATEGORIES = tuple("Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co Cn".split())
URL = r"https?://[^\s<>\"')\]]+"


def once(value: Column, then) -> Column:
    """then(value), with the value computed once for a row however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def found_classes(text: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]))


def secrets(text: Column) -> Column:
    return found_classes(text, SECRETS)


def luhn_valid(digits: Column) -> Column:
    backwards = F.reverse(F.split(digits, ""))
    value = lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int"))
    return F.aggregate(F.transform(backwards, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def pii(text: Column, entities: list[str] | None = None) -> Column:
    """Names of the entities a text holds. PERSON and LOCATION need a model: a scorer registered under that name; without one they are never found."""
    chosen = {n: p for n, p in PII.items() if entities is None or n in entities}
    parts = []
    for n, p in chosen.items():
        hit = text.rlike(p)
        if n == "CREDIT_CARD":
            hit = F.exists(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: luhn_valid(F.regexp_replace(m, "[ -]", "")))
        parts.append(F.when(hit, F.lit(n)))
    parts += [F.when(scored(n, text, ()) > 0.5, F.lit(n)) for n in ("PERSON", "LOCATION") if n in SCORERS and (entities is None or n in entities)]
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def unicode_categories(text: Column, categories: list[str] | None = None) -> Column:
    chosen = [c for c in (categories or CATEGORIES) if c != "Cs"]
    if not chosen:
        return F.array().cast("array<string>")
    characters = F.array_join(F.array_distinct(F.split(text, "")), "")  # one pass over the text, then tests of its few characters
    return once(characters, lambda d: F.array_compact(F.array(*[F.when(d.rlike(rf"\p{{{c}}}"), F.lit(c)) for c in chosen])))


def copyright_kinds(text: Column, threshold: float = 0.5) -> Column:
    """The licence whose title begins the text, or else those of which a share of blank-separated title words are words of the text, and COPYRIGHT
    once for each mark that the text holds."""
    names, known = F.array().cast("array<string>"), {w for t in LICENCES.values() for w in t.split(" ") if w}

    def shared(words: Column) -> Column:
        parts = []
        for name, title in LICENCES.items():
            own = [w for w in title.split(" ") if w]
            share = sum((F.array_contains(words, w).cast("int") for w in own), F.lit(0)) / len(own)
            parts.append(F.when(share >= threshold, F.lit(name)))
        return F.array_compact(F.array(*parts))

    def titled(bare: Column) -> Column:
        first = F.coalesce(*[F.when(F.startswith(bare, F.lit(title)), F.array(F.lit(name))) for name, title in LICENCES.items()])
        return F.coalesce(first, once(F.split(bare, " "), shared))

    licences = once(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), titled)
    if threshold > 0.2:  # a share that dashes alone can't make; most texts hold no other word of any title, so they need one test
        some = "|".join("".join("\\" + c if c in ".-" else c for c in w) for w in sorted(known) if w != "-")
        licences = F.when(text.rlike(some), licences).otherwise(names)
    return F.concat(licences, F.array_compact(F.array(*[F.when(F.contains(text, F.lit(m)), F.lit("COPYRIGHT")) for m in COPYRIGHT_MARKS])))


def links(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(URL), F.lit(0)))


def windows(text: Column, size: int = 2000) -> Column:
    """Lines, cut into windows of `size` characters: what a moderation model is asked about."""
    return F.flatten(F.transform(F.filter(F.split(text, "\n"), lambda s: s != ""), lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / size)), lambda i: F.substring(s, (i * size + 1).cast("int"), F.lit(size)))))


# -- pluggable detectors

SCORERS: dict[str, object] = {}


def register_scorer(name: str, function, categories: tuple[str, ...] | None = None) -> None:
    """function: pandas Series of texts -> Series of scores, for `prompt_injection`, `moderation`, `PERSON` and `LOCATION`; with categories
    (moderation): -> DataFrame of a column of scores for each; -> Series of texts for `llm` (prompts) and `ocr` (images); with the language as
    second argument -> Series of lists of issues (dicts) for `semgrep`; for `embedding`: two columns -> a column of similarities."""
    SCORERS[name] = function
    CATEGORIES_OF.pop(name, None)
    if categories is not None:
        CATEGORIES_OF[name] = tuple(categories)


def cached(function, size: int = 10_000):
    """A scorer that a worker asks once for each text among the last `size` ones; null results are asked for again."""
    held: OrderedDict = OrderedDict()

    def score(texts: pd.Series) -> pd.Series:
        new = [t for t in dict.fromkeys(texts) if t not in held]
        found = dict(zip(new, function(pd.Series(new, dtype=object)), strict=True)) if new else {}
        out = texts.map(lambda t: found[t] if t in found else held[t])
        for t, v in found.items():
            if v is not None and v == v:
                held[t] = v
                if len(held) > size:
                    held.popitem(last=False)
        return out

    return score


CATEGORIES_OF: dict[str, tuple[str, ...]] = {}


#: The stand-ins' phrases.
INJECTION_PHRASES = ("ignore previous instructions", "ignore all previous instructions", "ignore the above", "disregard previous", "you are now", "system prompt", "attention!")
UNSAFE_WORDS = {"violence": ("kill", "murder", "bomb"), "harassment": ("hate you",), "self-harm": ("suicide",)}


def scored(name: str, text: Column, phrases: tuple[str, ...]) -> Column:
    if name in SCORERS:
        function = SCORERS[name]
        return F.pandas_udf(lambda s: function(s).astype(float), "double")(text)
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(F.lower(text), F.lit(p))
    return F.when(hit, 0.99).otherwise(0.01)


def answers(text: Column) -> Column:
    """What the `llm` scorer answers to each prompt."""
    function = SCORERS["llm"]
    return F.pandas_udf(lambda s: pd.Series(function(s)).astype(object), "string")(text)


def confirmed(question: Column) -> Column:
    """Whether the `llm` scorer answers yes and nothing else."""
    return F.coalesce(answers(question).rlike(r"(?iU)^\s*yes\s*$"), F.lit(False))


def read_images(images: Column) -> Column:
    """The texts that the `ocr` scorer reads in each row's images; a batch's images are one call."""
    function = SCORERS["ocr"]

    @F.pandas_udf("array<string>")
    def read(rows: pd.Series) -> pd.Series:
        every = [i for row in rows if row is not None for i in row]
        texts = iter(function(pd.Series(every, dtype=object)) if every else ())
        return rows.map(lambda row: None if row is None else [next(texts) for _ in row])

    return read(images)


def code_issues(text: Column, language: str = "python") -> Column:
    """The issues that the `semgrep` scorer finds in a program, one value each."""
    function = SCORERS["semgrep"]
    found = F.pandas_udf(lambda s: pd.Series(function(s, language)).map(lambda issues: [json.dumps(i) for i in (issues if issues is not None else ())]), "array<string>")(text)
    return F.transform(found, lambda i: F.parse_json(i))


def prompt_injection(text: Column, threshold: float = 0.9) -> Column:
    return F.coalesce(scored("prompt_injection", text, INJECTION_PHRASES) > threshold, F.lit(False))


def moderated(text: Column, threshold: float = 0.5, cat_thresholds: dict | None = None) -> Column:
    """Whether a category's score exceeds its threshold (cat_thresholds, or else `threshold`) in some window of the text."""
    limits = cat_thresholds or {}
    if "moderation" in SCORERS and "moderation" not in CATEGORIES_OF:
        return F.coalesce(scored("moderation", text, ()) > threshold, F.lit(False))
    if "moderation" in SCORERS:
        names, function = CATEGORIES_OF["moderation"], SCORERS["moderation"]
        scores = F.pandas_udf(lambda s: function(s)[list(names)].astype(float), "struct<" + ",".join(f"`{n}`:double" for n in names) + ">")(text)
        over = F.lit(False)
        for n in names:
            over = over | F.coalesce(scores[n] > float(limits.get(n, threshold)), F.lit(False))
        return over

    def unsafe(w: Column) -> Column:
        over = F.lit(False)
        for n, words in UNSAFE_WORDS.items():
            over = over | (scored("", w, words) > float(limits.get(n, threshold)))
        return over

    return F.coalesce(F.exists(windows(text), unsafe), F.lit(False))


# -- UDFs

def distance_within(text: str, query: str, edits: int) -> bool:
    """Whether some substring of text is within `edits` edits of query: one row of the edit table per character of text, cut where it
    exceeds the budget (Sellers with Ukkonen's bound)."""
    m = len(query)
    if m <= edits:
        return True
    row, top = list(range(m + 1)), edits
    for c in text:
        left, diagonal = 0, 0
        new_top = 0
        for i in range(1, min(top + 1, m) + 1):
            above = row[i] if i <= top else edits + 1
            value = diagonal if query[i - 1] == c else 1 + min(diagonal, above, left)
            diagonal, left = above, value
            row[i] = value
            if value <= edits:
                new_top = i
        top = new_top
        if top == m:
            return True
    return False


#: What the `llm` scorer is asked where no substring of a text is near the query.
SAME_MEANING = "Does the text below hold this, in whatever words: %s? Answer YES or NO.\n\n"


def fuzzy_contains(text: Column, query: str, threshold: float = 0.8, semantic: bool = True) -> Column:
    """Edits allowed: min(10, floor(len * (1 - threshold))). Texts that hold the query as it is are settled without Python. With `semantic`, an
    `llm` scorer, where one is registered, is asked about the texts that have no near match."""
    edits = min(10, int(len(query) * (1 - threshold)))

    @F.pandas_udf("boolean")
    def near(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: False if t is None else distance_within(t, query, edits)).astype(bool)

    hit = F.coalesce(F.when(F.contains(text, F.lit(query)), F.lit(True)).otherwise(near(text)), F.lit(False))
    if not semantic or "llm" not in SCORERS:
        return hit
    return F.when(hit, hit).otherwise(confirmed(F.when(~hit, F.concat(F.lit(SAME_MEANING % query), text))))


CODE = "struct<imports:array<string>,builtins:array<string>,function_calls:array<string>,syntax_error:boolean,syntax_error_exception:string>"


def read_python(code: str | None) -> dict:
    import builtins

    out = {"imports": [], "builtins": [], "function_calls": [], "syntax_error": False, "syntax_error_exception": None}
    if code is None:
        return out
    try:
        tree = ast.parse("\n".join(line for line in code.split("\n") if not line.lstrip().startswith(("!", "%"))))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return out | {"syntax_error": True, "syntax_error_exception": str(e)}
    imports, built, called = set(), set(), set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports |= {a.name.split(".")[0] for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            imports.add(node.module.split(".")[0])
        elif isinstance(node, ast.Name) and hasattr(builtins, node.id):
            built.add(node.id)
        elif isinstance(node, ast.Call):
            called.add(ast.unparse(node.func))
    return out | {"imports": sorted(imports), "builtins": sorted(built), "function_calls": sorted(called)}


def python_code(text: Column) -> Column:
    @F.pandas_udf(CODE)
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_python(t) for t in texts], columns=["imports", "builtins", "function_calls", "syntax_error", "syntax_error_exception"])

    return read(text)


class _Html(HTMLParser):
    def __init__(self):
        super().__init__()
        self.alts, self.links = [], []

    def handle_starttag(self, tag, attrs):
        d = dict(attrs)
        if tag == "img" and d.get("alt"):
            self.alts.append(d["alt"])
        if tag == "a" and d.get("href"):
            self.links.append(d["href"])

    handle_startendtag = handle_starttag


def read_html(text: str | None) -> dict:
    p = _Html()
    p.feed(text or "")
    p.close()
    return {"alt_texts": p.alts, "links": list(dict.fromkeys(p.links + re.findall(URL, text or "")))}


def html_code(text: Column) -> Column:
    @F.pandas_udf("struct<alt_texts:array<string>,links:array<string>>")
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_html(t) for t in texts], columns=["alt_texts", "links"])

    return read(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Named thresholds of similarity.
SIMILARITY = {"might_resemble": 0.2, "same_topic": 0.5, "very_similar": 0.8}
