"""Personal data by candidate gradient boosting.

1. Base spans: the four patterns with their checks. They always stay.
2. Generators of high recall propose overlapping spans: digit zones and their parts as card, phone and ip, defanged (`10[.]0[.]0[.]1`)
   and IPv6 addresses as ip, and spelled-out addresses as email. Proposals whose format or surroundings rule them out (`ruled_out`) are never added.
3. Boosted trees judge each other proposal by its format and its surroundings. They learn from all documents, half of them chosen by a
   hash of the text: base spans and spelled-out or reformatted variants of them are positive; proposals that are ruled out, and those that
   cover a variant in part or beyond its ends, are negative. Other proposals are unlabelled and teach nothing: many are
   personal data that no base pattern fits. Examples that fall into the same bins are counted; up to `HELD` kinds of them are kept by the
   driver, more stay in a table that gives the same sums, and so the same trees.
4. Per kind a threshold is calibrated on the half of the documents that the trees didn't see: the least one at which at most `MISS` of
   that half's negatives would be taken, never below `FLOOR`. Proposals that reach it and touch no base span are added; of overlapping
   ones the longer stays, then the likelier.

Null texts are empty. Without a base span in the first half nothing is added. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate, batched, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .boosting import BINS, BoostedTrees, binned
from .common import table, tune, written

KINDS = ("email", "ip", "card", "phone")
MISS, FLOOR = 0.001, 0.9
#: Proposals judged at a time.
CHUNK = 8192
#: Distinct examples that the driver keeps, or that a task counts or judges at a time.
HELD, COUNTED = 1 << 19, 1 << 16
#: The base patterns, written so that none rescans a run of characters.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Generators.
_ZONE = re.compile(r"[+(]?[0-9](?:[0-9 ().\-/]*[0-9])?")
_LABEL = r"[A-Za-z0-9-]{1,63}"
_SPELLED = re.compile(
    rf"[ ]?(?:\(at\)|\[at\])[ ]?({_LABEL}(?:(?:[ ]?(?:\(dot\)|\[dot\])[ ]?| dot |\.){_LABEL})+)"
    rf"| at ({_LABEL}(?:(?:[ ]?(?:\(dot\)|\[dot\])[ ]?| dot ){_LABEL})+)"
)
_DEFANGED = re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot )[0-9]{1,3}){3}")
_SIX = re.compile(r"(?:[0-9A-Fa-f]{1,4}|:):[0-9A-Fa-f:]*[0-9A-Fa-f]")
_TLD = re.compile(r"[A-Za-z]{2,6}\Z")
_PART = re.compile(r"[^ /]+")
_PLAIN = re.compile(r"[0-9]+(?:\.[0-9]+)?|[0-9]{1,3}(?:[ .][0-9]{3})+")  # one number, perhaps grouped by thousands
_DATE = re.compile(r"[0-9]{4}([-./ ])[0-9]{1,2}\1[0-9]{1,2}(?: [0-9]{1,2})?|[0-9]{1,2}([-./ ])[0-9]{1,2}\2[0-9]{4}(?: [0-9]{1,2})?|[12][0-9]{3} ?[-/] ?[12][0-9]{3}")
_ABROAD = re.compile(r"\+[0-9]{1,3}[ .-]*")
_NO_LOCAL = frozenset("a an and are as at be been but by is it look looked looks meet met not of or stay stayed that the them then they this to was we were you".split())
_DOT = re.compile(r"[ ]?(?:\(dot\)|\[dot\]| dot |\.)[ ]?")
_HINTS = tuple(re.compile(p, re.I) for p in (r"mail|contact|write", r"\bip\b|host|server|addr", r"card|visa|pay|credit", r"tel|phone|call|fax|mobil", r"token|password|key|secret"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted by start, then kind."""
    found = []
    if "@" in text:
        end = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                end = m.end()
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := only_digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return sorted(found)


def proposals(text: str):
    """Yields (start, kind number, end) of whatever could be personal data; spans may overlap."""
    if "at)" in text or "at]" in text or " at " in text:
        for m in _SPELLED.finditer(text):
            start = m.start()
            while start > 0 and m.start() - start < 64 and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < m.start() and _TLD.search(m.group(1) or m.group(2)):
                yield start, 0, m.end()
    if "::" in text or text.count(":") >= 3:
        for m in _SIX.finditer(text):
            if m.group().count(":") >= 2:
                yield m.start(), 1, m.end()
    if _DIGIT.search(text):
        for m in _DEFANGED.finditer(text):
            yield m.start(), 1, m.end()
        for m in _ZONE.finditer(text):
            zone = m.group()
            n = len(only_digits(zone)) if len(zone) >= 7 else 0
            if zone.count(".") >= 3 and 4 <= n <= 12 or n >= 4 and zone.count("-") >= 3 and n <= 12:
                yield m.start(), 1, m.end()
            if 12 <= n <= 19:
                yield m.start(), 2, m.end()
            if 7 <= n <= 15:
                yield m.start(), 3, m.end()
            if n > 7 and (" " in zone or "/" in zone):
                yield from parts(zone, m.start())


def parts(zone: str, at: int):
    """Proposals for runs of a zone's parts (between blanks and slashes) other than the whole zone: at most 19 per part, as each has a digit."""
    pieces = [(m.start(), m.end(), only_digits(m.group())) for m in _PART.finditer(zone)]
    pieces = [x for x in pieces if x[2]]
    for i, (start, _, _) in enumerate(pieces):
        while zone[start] not in "+(0123456789":
            start += 1
        digits = ""
        for j in range(i, len(pieces)):
            digits += pieces[j][2]
            n = len(digits)
            if n > 19:
                break
            if n < 4 or i == 0 and j == len(pieces) - 1:
                continue
            end = pieces[j][1]
            while not "0" <= zone[end - 1] <= "9":
                end -= 1
            if i == j and n <= 12 and max(zone.count(".", start, end), zone.count("-", start, end)) >= 3:
                yield at + start, 1, at + end
            if n >= 12 and luhn(digits):
                yield at + start, 2, at + end
            if 7 <= n <= 15:
                yield at + start, 3, at + end


def ruled_out(text: str, span: tuple[int, int, int]) -> bool:
    """Whether a proposal is surely no personal data of its kind, or too likely another number: digits within a word or a quoted secret,
    a card without a valid check digit, an ip with parts beyond 255, a date, half a pair of brackets; without a word such as `call` before it, a phone number
    that is one plain number, or has under 9 digits and neither brackets nor 00."""
    start, kind, end = span
    s = text[start:end]
    if kind == 0:
        return s.partition(" at ")[0].lower() in _NO_LOCAL
    before, after = text[max(0, start - 30) : start], text[end : end + 1]
    if before[-1:].isalnum() or after.isalnum() or before[-1:] == "_" or after == "_" or before[-1:] in ('"', "=", "'") and _HINTS[4].search(before):
        return True
    if kind == 1 and ":" in s:
        groups = s.split(":")
        some = [g for g in groups if g]
        if after == ":" or before[-1:] == ":" or s.count("::") > 1 or ":::" in s or len(groups) > 8 or any(len(g) > 4 for g in groups):
            return True
        return len(some) < 8 if "::" not in s else all(g.isdigit() for g in some) and len(some) < 3  # a time, an address of a device
    if kind == 1:
        groups = [g.lstrip("0") for g in re.split(r"[^0-9]+", s) if g]
        if "[" in s or "(" in s or " dot " in s:
            return any(len(g) > 3 or int(g or 0) > 255 for g in groups)
        return len(groups) != 4 or any(len(g) > 3 or int(g or 0) > 255 for g in groups) or "." not in s and not _HINTS[1].search(before)
    if kind == 2:
        return not luhn(only_digits(s))
    if _DATE.fullmatch(s) or s.count("(") != s.count(")"):
        return True
    return not _HINTS[3].search(before) and bool(_PLAIN.fullmatch(s) or len(only_digits(s)) < 9 and "(" not in s and not s.startswith("00"))


def untouched(candidates, base: list[tuple[int, int, int]]):
    """Yields the candidates that overlap no base span. base: sorted by start."""
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    return (c for c in candidates if not (i := bisect_left(starts, c[2])) or ends[i - 1] <= c[0])


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    start, kind, end = span
    s, before, after = text[start:end], text[max(0, start - 30) : start], text[end : end + 10]
    digits, letters = only_digits(s), sum(c.isalpha() for c in s)
    groups = [g for g in re.split(r"[^0-9]+", s) if g]
    sizes = [len(g) for g in groups] or [0]
    return [
        *(float(kind == k) for k in range(4)), len(s), len(digits), letters, len(s) - len(digits) - letters, len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        s.startswith("+"), "(" in s, s.count("."), s.count("-"), s.count(" "), s.count("/"), len(digits) > 11 and luhn(digits), max((int(g[:6]) for g in groups), default=0) <= 255, "@" in s, s.count(":"), "[" in s, len(_DOT.split(s)[-1]) if kind == 0 else 0,
        before.rstrip(" ()./-")[-1:].isdigit(), after.lstrip(" ()./-")[:1].isdigit(), before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in ('"', "=", "'", "_", "#"), after[:1] in ('"', "=", "'", "_"), *(bool(h.search(before)) for h in _HINTS),
    ]


def variants(text: str, span: tuple[int, int, int]):
    """The text around a base span with the span in other forms: (text, span)."""
    start, kind, end = span
    s, head, tail = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    forms = []
    if kind == 0:
        local, _, host = s.partition("@")
        forms = [f"{local} at {host.replace('.', ' dot ')}", f"{local}(at){host}", f"{local} [at] {host.replace('.', '[dot]')}"]
    elif kind == 1:
        a, b, c, d = (int(x.lstrip("0") or 0) for x in s.split("."))
        forms = [s.replace(".", "[.]"), s.replace(".", "(.)"), s.replace(".", " dot "), f"2001:db8:{a:x}{b:02x}::{c:x}{d:02x}", f"fe80::{a:x}:{b:x}:{c:x}:{d:x}", f"2001:db8:{a:x}:{b:x}:0:{c:x}:{d:x}:1"]
    elif kind == 2:
        d = only_digits(s)
        forms = [".".join(d[i : i + 4] for i in range(0, len(d), 4)), "/".join(d[i : i + 4] for i in range(0, len(d), 4))]
    elif kind == 3:
        home = _ABROAD.sub("", s) if "(" in s or " " in s or "-" in s else ""
        plain = re.findall(r"[0-9]+", home)
        forms = ["00" + s[1:], "(" + s[1:3] + ")" + s[3:]]
        if len("".join(plain)) >= 9 and len(plain) > 1:
            forms += dict.fromkeys([home, "-".join(plain), ".".join(plain), " ".join(plain)])
    for form in forms:
        yield head + form + tail, (len(head), kind, len(head) + len(form))
    if kind >= 2:  # within a zone of other numbers
        d = only_digits(s)
        near = [d[-4:], d[:2], d[-3:], d[1:2]]
        for i, form in enumerate([s, *forms]):
            a, b, c = (near[(i + j + int(d[-1])) % 4] for j in range(3))
            ahead = f"{head}{a} " if form[0] != "+" else head
            yield f"{ahead}{form} {b} {c}{tail}", (len(ahead), kind, len(ahead) + len(form))


def wrong(text: str, c: tuple[int, int, int], known: tuple[int, int, int]) -> bool:
    """Whether a proposal overlaps a known span and is surely not right itself: a number without its prefix may be."""
    if c == known or c[0] >= known[2] or known[0] >= c[2]:
        return False
    return c[1] != known[1] or c[2] != known[2] or c[0] < known[0] or len(only_digits(text[c[0] : c[2]])) < 9


class SpanModel:
    def __init__(self, trees: BoostedTrees | None = None, thresholds: list[float] | None = None):
        self.trees, self.thresholds = trees, thresholds or [2.0] * 4

    def likely(self, texts: list[str], base: list[list]) -> list[list]:
        """Per text: (span, probability) of the proposals that reach their threshold. Proposals are made and judged CHUNK by CHUNK."""
        out: list[list] = [[] for _ in texts]
        each = ((i, c) for i, (t, b) in enumerate(zip(texts, base, strict=True)) for c in untouched(proposals(t), b) if not ruled_out(t, c))
        for part in batched(each, CHUNK):
            p = self.trees.predict(np.array([features(texts[i], c) for i, c in part], dtype=float))
            for (i, c), x in zip(part, p.tolist(), strict=True):
                if x >= self.thresholds[c[1]]:
                    out[i].append((c, x))
        return out

    @staticmethod
    def added(text: str, found: list) -> list[tuple[int, int, int]]:
        """Of overlapping spans the longer, then the likelier, then the first stays."""
        out, taken = [], bytearray(len(text))
        for (start, kind, end), _ in sorted(found, key=lambda x: (x[0][0] - x[0][2], -x[1])):
            if taken.find(1, start, end) < 0:
                out.append((start, kind, end))
                taken[start:end] = b"\1" * (end - start)
        return out

    def find(self, texts: list[str | None]) -> list[tuple[list, list]]:
        """Per text: base spans, added spans."""
        texts = [t or "" for t in texts]
        base = [base_spans(t) for t in texts]
        if self.trees is None:
            return [(b, []) for b in base]
        return [(b, self.added(t, found) if found else []) for t, b, found in zip(texts, base, self.likely(texts, base), strict=True)]


def examples(text: str):
    """(text, span, label) of a text's base spans, variants and known negatives."""
    base = base_spans(text)
    yield from ((text, s, 1) for s in base)
    for t, s in (v for b in base for v in variants(text, b)):
        yield t, s, 1
        yield from ((t, c, 0) for c in proposals(t) if wrong(t, c, s))
    yield from ((text, c, 0) for c in untouched(proposals(text), base) if ruled_out(text, c))


def counted(batches):
    """x (features in bins), label, fold (a hash of the text) and how often the examples of texts have these."""
    held: Counter = Counter()

    def told():
        x, y, fold = zip(*held, strict=True)
        return pa.RecordBatch.from_pydict({"x": pa.array(x, pa.binary()), "y": pa.array(y, pa.int32()), "fold": pa.array(fold, pa.int32()), "n": pa.array(held.values(), pa.int64())})

    for batch in batches:
        texts = (t or "" for t in batch.column("text").to_pylist())
        each = ((*e, fold) for t in texts for fold in [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()[0] % 2] for e in examples(t))
        for part in batched(each, CHUNK):
            rows = binned(np.array([features(t, s) for t, s, _, _ in part], dtype=float))
            held.update((x.tobytes(), y, fold) for x, (_, _, y, fold) in zip(rows, part, strict=True))
            if len(held) >= COUNTED:
                yield told()
                held.clear()
    if held:
        yield told()


def unpacked(batch) -> tuple[np.ndarray, ...]:
    """x, y, fold, n of counted examples."""
    y, fold, n = (batch.column(c).to_numpy() for c in ("y", "fold", "n"))
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(y.size, -1), y, fold, n


def blocks(batches):
    """Batches joined to about COUNTED rows, unpacked."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= COUNTED:
            yield unpacked(pa.Table.from_batches(held))
            held = []
    if any(b.num_rows for b in held):
        yield unpacked(pa.Table.from_batches(held))


def grown(rows: DataFrame) -> BoostedTrees:
    """Trees from a table of counted examples: each task gives the sums of its rows."""
    trees = BoostedTrees()

    def told(tree, waiting):
        def task(batches):
            out = 0
            for x, y, _, n in blocks(batches):
                out = out + trees.sums(tree, waiting, x, y, n, trees.margin(x) if trees.trees else np.zeros(y.size))
            if isinstance(out, np.ndarray):
                yield pa.RecordBatch.from_pydict({"sums": pa.array([out.tobytes()], pa.binary())})

        parts = [np.frombuffer(r.sums).reshape(2, len(waiting), -1, BINS) for r in rows.mapInArrow(task, "sums binary").collect()]
        return sum(parts[1:], parts[0])

    total = rows.agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)), F.sum("n")).first()
    return trees.grow(told, total[0], total[1])


def taken(trees: BoostedTrees, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, probabilities and counts of the rows that reach FLOOR."""
    p = trees.likely(x)
    at = np.flatnonzero(p >= FLOOR)
    return np.argmax(x[at, : len(KINDS)], axis=1), p[at], n[at]


def train(docs: DataFrame) -> SpanModel:
    rows = written(docs.select("text").where(F.col("text").isNotNull()).mapInArrow(counted, "x binary, y int, fold int, n long").groupBy("x", "y", "fold").agg(F.sum("n").alias("n")))
    labels = {(r.fold, r.y): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    if not labels.get((0, 1)) or not any(y == 0 for _, y in labels):
        return SpanModel()
    # the first features of an example are its kind
    kind = sum(F.when(F.substring("x", k + 1, 1) == F.lit(b"\1"), k).otherwise(0) for k in range(len(KINDS)))
    clean = {r.kind: r.n for r in rows.where("fold = 1 and y = 0").groupBy(kind.alias("kind")).agg(F.sum("n").alias("n")).collect()}
    if sum(labels.values()) <= HELD:
        x, y, fold, n = unpacked(rows.toArrow().combine_chunks())
        trees = BoostedTrees().fit(x[fold == 0], y[fold == 0], n[fold == 0])
        high = taken(trees, x[(fold == 1) & (y == 0)], n[(fold == 1) & (y == 0)])
    else:
        trees = grown(rows.where("fold = 0"))

        def task(batches):
            for x, _, _, n in blocks(batches):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in taken(trees, x, n)], names=["kind", "p", "n"])

        found = rows.where("fold = 1 and y = 0").mapInArrow(task, "kind long, p double, n long").groupBy("kind", "p").agg(F.sum("n").alias("n")).toArrow()
        high = tuple(found.column(c).to_numpy() for c in ("kind", "p", "n"))
    return SpanModel(trees, thresholds(clean, *high))


def thresholds(clean: dict[int, int], kind: np.ndarray, p: np.ndarray, n: np.ndarray) -> list[float]:
    """clean: negatives of each kind; the others: those that reach FLOOR."""
    out = []
    for k in range(len(KINDS)):
        order = np.argsort(-p[kind == k])
        over = np.flatnonzero(np.cumsum(n[kind == k][order]) > int(MISS * clean.get(k, 0)))
        out.append(max(FLOOR, float(np.nextafter(p[kind == k][order][over[0]], 2))) if over.size else FLOOR)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """Spans become [KIND]; overlapping spans become one, named after the first."""
    if text is None or not spans:
        return text
    merged: list[list[int]] = []
    for s, k, e in sorted(spans):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    parts = [text[: merged[0][0]]]
    for a, b in pairwise([*merged, [len(text), 0, 0]]):
        parts += [f"[{KINDS[a[1]].upper()}]", text[a[2] : b[0]]]
    return "".join(parts)


def find(docs: DataFrame, model: SpanModel, redacted: bool = False) -> DataFrame:
    """docs: with text. Appends base_spans and spans (`kind:start:end`, comma-joined), in place of columns of these names, or, if `redacted`, replaces text."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def scan(batches):
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            found = shared.value.find(texts)
            columns = list(batch.columns)
            if redacted:
                columns[text_at] = pa.array([redact(t, b + a) for t, (b, a) in zip(texts, found, strict=True)], pa.string())
            else:
                columns = [columns[i] for i in kept] + [pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(b + a) for b, a in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    fields = list(docs.schema.fields)
    kept = [i for i, f in enumerate(fields) if f.name not in ("text", "base_spans", "spans")]
    if not redacted:
        fields = [fields[i] for i in kept] + [StructField("base_spans", StringType()), StructField("spans", StringType())]
    out = StructType(fields)
    return docs.mapInArrow(scan, out)


def query(spark, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs))
    kind = lambda k: F.regexp_count(F.col("base_spans"), F.lit(f"{k}:")).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[kind(k) for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its spans replaced by [EMAIL], [IP], [CARD] or [PHONE]; n_chars follows where there is one."""
    tune(spark)
    out = find(docs, train(docs), redacted=True)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else out
