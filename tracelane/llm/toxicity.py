"""Toxicity by class-conditional Kneser-Ney models over characters.

Two models of order 5 (toxic, ordinary) are learnt from all labelled training rows. Each interpolates its own discounted counts with
one shared lower-order model, which is made of continuation counts (distinct left contexts) pooled over both classes: an expression that
neither class knows gets the same probability from both, and counts for neither. The context of a character is what precedes it in its
word. A text is judged by its length-normalised log-likelihood ratio, as a whole and in its two worst words (each held within +-CLIP); a
logistic fit on a bounded sample of each class's training rows, its intercept corrected by the classes' true counts, turns these into a
score. The fit is cross-fitted: the ratios of a sample row come from
models without the texts of its fold, so that it meets texts as a new text is met; copies share a fold.

Counting runs where the rows lie (one pass per partition, then a sum by n-gram) and keeps every n-gram. Up to `model_grams` distinct ones
the model is made on the driver and broadcast. Beyond, it stays a table (`model_table`): the ratios of distinct words are looked up by
joins, and texts join their words (`looked_up`). Both ways hold the same numbers in double precision and give the same scores but for
the last digits. In these joins, keys with more than 1 / HOT of the rows (so fewer than HOT keys) are looked up in a broadcast table.
Null and empty texts have ratios of 0. Labels that repeat an id count by their maximum; rows without a known class score the base rate.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HashTable, cut, folded, id_hash_mod, packs, table, tune

ORDER, DISCOUNT, CLIP, THRESHOLD, FOLDS = 5, 0.75, 8.0, 0.7, 5
MODEL_GRAMS, FIT_ROWS, FOLD_TASKS, HOT = 1 << 20, 4000, 8, 1024
#: Bits of a gram's last character, and of each before it.
LAST, EACH = 16, 12


def _before() -> np.ndarray:
    """EACH bits for every code: itself below 0x800, which holds blanks and the alphabets of few letters; above, a hash that shares no value with those."""
    codes = np.arange(1 << 16)
    return np.where(codes < 0x800, codes, 0x800 + (codes * 40503 >> 5) % 0x800).astype(np.uint64)


_BEFORE = _before()


def grams(codes: np.ndarray) -> np.ndarray:
    """The ORDER characters that end at each position, the last one exactly, those before its word as blanks."""
    wide = np.concatenate((np.full(ORDER - 1, 32, np.uint16), codes))
    out = codes.astype(np.uint64)
    inside = np.ones(codes.size, dtype=bool)
    for i in range(1, ORDER):
        before = wide[ORDER - 1 - i : wide.size - i]
        inside &= before != 32
        out |= np.where(inside, _BEFORE[before], np.uint64(32)) << np.uint64(LAST + EACH * (i - 1))
    return out


def bits(order: int) -> int:
    """Of a gram's last `order` characters."""
    return LAST + EACH * (order - 1)


def useful(codes: np.ndarray) -> np.ndarray:
    """Letters, and the one space after a letter."""
    letter = codes != 32
    return letter | np.concatenate(([False], letter[:-1]))


def _merge(parts: list) -> tuple:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros((2 * FOLDS, keys.size), np.int64)
    begin = 0
    for k, c in parts:
        counts[:, at[begin : begin + k.size]] += c
        begin += k.size
    return keys, counts


COUNTS = [f"{c}{f}" for c in ("ordinary", "toxic") for f in range(FOLDS)]


def count_grams(batches):
    """Per partition: grams and their counts by class and fold."""
    held, size = [], 0
    for batch in batches:
        texts, cells = batch.column("text").to_pylist(), batch.column("cell").to_pylist()
        for cell in set(cells):
            for _, _, codes, _ in packs([t for t, x in zip(texts, cells, strict=True) if x == cell and t], 1):
                keys, n = np.unique(grams(codes)[useful(codes)], return_counts=True)
                counts = np.zeros((2 * FOLDS, keys.size), np.int64)
                counts[cell] = n
                held.append((keys, counts))
                size += keys.size
        if size > 1 << 19:
            held, size = [_merge(held)], 0
    if held:
        keys, counts = _merge(held)
        for lo in range(0, keys.size, 100_000):
            yield pa.RecordBatch.from_pydict({"gram": keys[lo : lo + 100_000].astype(np.int64)} | {n: c[lo : lo + 100_000] for n, c in zip(COUNTS, counts, strict=True)})


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the sum of counts, and the number of rows with a count, over the rows of equal key."""
    _, at = np.unique(keys, return_inverse=True)
    return np.bincount(at, weights=counts)[at], np.bincount(at, weights=counts > 0)[at]


def shared_model(keys: np.ndarray, order: int) -> np.ndarray:
    """Kneser-Ney probabilities of the last character of each key (distinct grams of `order` + 1 characters) given the ones before it,
    without the first: from the number of distinct characters before the shorter gram, pooled over the classes."""
    short = keys & np.uint64((1 << bits(order)) - 1)
    unique, at, lefts = np.unique(short, return_inverse=True, return_counts=True)
    if order == 1:
        return (lefts / lefts.sum())[at]
    total, kinds = _sums(unique >> np.uint64(LAST), lefts.astype(np.float64))
    lower = shared_model(unique, order - 1)
    return ((np.maximum(lefts - DISCOUNT, 0) + DISCOUNT * kinds * lower) / total)[at]


class ToxicityModel:
    """Log ratios toxic : ordinary of known grams, and of unknown characters after a known context; a logistic fit over them."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        keys = keys.astype(np.uint64)
        some = counts.sum(axis=0) > 0
        keys, counts = keys[some], counts[:, some]
        shared = shared_model(keys, ORDER - 1) if keys.size else np.empty(0)
        context = keys >> np.uint64(LAST)
        ratio, rest = np.zeros(keys.size), np.zeros(keys.size)
        for c, sign in ((1, 1.0), (0, -1.0)):
            total, kinds = _sums(context, counts[c].astype(np.float64)) if keys.size else (ratio, ratio)
            left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            p = np.maximum(counts[c] - DISCOUNT, 0) / np.maximum(total, 1) + left * shared
            ratio += sign * np.log(np.maximum(p, 1e-12))
            rest += sign * np.log(np.maximum(left, 1e-12))
        self.keys, self.ratio = keys, np.clip(ratio, -CLIP, CLIP)
        self.contexts, where = np.unique(context, return_index=True)
        self.rest = np.clip(rest[where], -CLIP, CLIP)
        self.weights = np.zeros(5)
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """(n, 4): mean log ratio of a text's characters, log ratios of its two worst words, and the share of words with a ratio above 2."""
        if self._tables is None:
            self._tables = HashTable(self.keys, self.ratio, 0.0), HashTable(self.contexts, self.rest, 0.0)
        out = np.zeros((len(texts), 4))
        for first, last, codes, starts in packs([t or "" for t in texts], 1):
            at = np.flatnonzero(useful(codes))
            if at.size == 0:
                continue
            keys = grams(codes)[at]
            ratio, known = self._tables[0].get(keys)
            miss = np.flatnonzero(~known)
            ratio[miss] = self._tables[1].get(keys[miss] >> np.uint64(LAST))[0]
            begins = np.flatnonzero(np.concatenate(([True], codes[at[:-1]] == 32)))  # of words, in `at`
            words = np.clip(np.add.reduceat(ratio, begins), -CLIP, CLIP)
            owner = np.searchsorted(starts, at[begins], side="right") - 1
            some = np.unique(owner)  # texts with words
            edges = np.searchsorted(owner, some)
            chars = np.bincount(owner, weights=np.diff(np.append(begins, at.size)), minlength=last - first)  # a word's blank is its text's
            n = np.bincount(owner, minlength=last - first)
            out[first:last, 0] = np.bincount(owner, weights=words, minlength=last - first) / np.maximum(chars, 1)
            top = np.maximum.reduceat(words, edges)
            out[first + some, 1] = top
            order = np.lexsort((-words, owner))
            second = order[np.minimum(edges + 1, words.size - 1)]
            out[first + some, 2] = np.where(n[some] > 1, words[second], 0.0)
            out[first:last, 3] = np.log1p(100 * np.bincount(owner, weights=words > 2, minlength=last - first) / np.maximum(n, 1))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.features(texts) @ self.weights[1:], -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge: the intercept and four weights."""
    if y.size == 0 or y.min() == y.max():
        return np.array([np.log((y.sum() + 0.5) / (y.size - y.sum() + 0.5)), 0.0, 0.0, 0.0, 0.0])
    z, w = np.column_stack((np.ones(y.size), x)), np.zeros(5)
    ridge = np.diag([1e-6, 0.1, 0.1, 0.1, 0.1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def clipped(c: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), c))


def model_table(counted: DataFrame) -> DataFrame:
    """The models as a table, for any number of grams: gram, ratio0.., rest0..; 0 is the model of all texts, f + 1 the one without fold f.
    A ratio is null where the model lacks the gram. Groups are the grams of one context or one suffix, 65,536 at most."""
    models = range(FOLDS + 1)
    of = {(c, m): sum((F.col(f"{c}{f}") for f in range(FOLDS) if f != m - 1), F.lit(0)) for c in ("ordinary", "toxic") for m in models}
    full = counted.select("gram", *[n.alias(f"{c}_{m}") for (c, m), n in of.items()])

    def some(c: Column) -> Column:
        return (c > 0).cast("long")

    def suffix(order: int) -> Column:
        return F.col("gram").bitwiseAND(F.lit((1 << bits(order)) - 1))

    lefts = {ORDER - 1: full.groupBy(suffix(ORDER - 1).alias("gram")).agg(*[F.sum(some(F.col(f"ordinary_{m}") + F.col(f"toxic_{m}"))).alias(f"l{m}") for m in models])}
    for k in range(ORDER - 2, 0, -1):
        lefts[k] = lefts[k + 1].groupBy(suffix(k).alias("gram")).agg(*[F.sum(some(F.col(f"l{m}"))).alias(f"l{m}") for m in models])
    every = Window.partitionBy()  # over single characters: 65,536 rows at most
    lower = lefts[1].select(F.col("gram").alias("_s"), *[(F.col(f"l{m}") / F.greatest(F.lit(1), F.sum(f"l{m}").over(every))).alias(f"p{m}") for m in models])
    same = Window.partitionBy(F.shiftrightunsigned("gram", LAST))
    for k in range(2, ORDER):
        held = lefts[k].join(lower, suffix(k - 1) == F.col("_s")).drop("_s")
        share = lambda m: (F.greatest(F.col(f"l{m}") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.sum(some(F.col(f"l{m}"))).over(same) * F.col(f"p{m}")) / F.greatest(F.lit(1), F.sum(f"l{m}").over(same))
        lower = held.select(F.col("gram").alias("_s"), *[share(m).alias(f"p{m}") for m in models])
    held = full.join(lower, suffix(ORDER - 1) == F.col("_s")).drop("_s")
    out = []
    for m in models:
        ratio, rest = F.lit(0.0), F.lit(0.0)
        for c, sign in (("toxic", 1.0), ("ordinary", -1.0)):
            n = F.col(f"{c}_{m}")
            total = F.sum(n).over(same)
            left = F.when(total > 0, DISCOUNT * F.sum(some(n)).over(same) / F.greatest(total, F.lit(1))).otherwise(1.0)
            ratio += sign * F.log(F.greatest(F.lit(1e-12), F.greatest(n - DISCOUNT, F.lit(0.0)) / F.greatest(total, F.lit(1)) + left * F.col(f"p{m}")))
            rest += sign * F.log(F.greatest(F.lit(1e-12), left))
        out += [F.when(F.col(f"toxic_{m}") + F.col(f"ordinary_{m}") > 0, clipped(ratio, CLIP)).alias(f"ratio{m}"), clipped(rest, CLIP).alias(f"rest{m}")]
    return held.select("gram", *out)


def text_words(batches):
    """The distinct words of each text as their folded codes, with counts."""
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts = Counter(folded(text or "").tobytes().decode("utf-16-le", "surrogatepass").split(" "))
            del counts[""]
            if counts:
                words = [w.encode("utf-16-le", "surrogatepass") for w in counts]
                yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(words), pa.binary()), "word": pa.array(words, pa.binary()), "n": pa.array(counts.values(), pa.int64())})


def word_grams(batches):
    for batch in batches:
        for word in batch.column("word").to_pylist():
            keys, n = np.unique(grams(np.append(np.frombuffer(word, np.uint16), np.uint16(32))), return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": pa.array([word] * keys.size, pa.binary()), "gram": keys.astype(np.int64), "n": n.astype(np.int64)})


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def joined(rows: DataFrame, key: Column, found: DataFrame, key_name: str) -> DataFrame:
    """rows left-joined with found on key == key_name (distinct there, dropped). rows: read more than once. Keys that hold more than 1 / HOT of rows are
    fewer than HOT; their rows meet a broadcast of so many."""
    keyed = rows.withColumn("_key", key)
    least = rows.count() / HOT
    hot = keyed.where(F.col("_key").isNotNull()).groupBy("_key").count().where(F.col("count") > least).select(F.col("_key").alias("_hot"))  # under HOT rows
    near = F.broadcast(found.join(F.broadcast(hot), F.col(key_name) == F.col("_hot"), "left_semi"))
    marked = keyed.join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
    often = marked.where(F.col("_hot").isNotNull()).join(near, F.col("_key") == F.col(key_name), "left")
    rest = marked.where(F.col("_hot").isNull()).join(found.hint("merge"), F.col("_key") == F.col(key_name), "left")
    return often.unionByName(rest).drop("_key", "_hot", key_name)


def looked_up(texts: DataFrame, grams_table: DataFrame, m: int) -> DataFrame:
    """texts: key, text (equal keys: equal texts). Returns key, x0..x3, the features of ToxicityModel, of the distinct texts that have words.
    A text's group holds its distinct words."""
    counted = cut(texts.select("key", "text").mapInArrow(text_words, "key binary, word binary, n long").groupBy("key", "word").agg(F.max("n").alias("n")))
    parts = cut(counted.select("word").distinct().mapInArrow(word_grams, "word binary, gram long, n long"))
    known = grams_table.select(F.col("gram").alias("_g"), F.col(f"ratio{m}").alias("ratio"))
    rests = grams_table.groupBy(F.shiftrightunsigned("gram", LAST).alias("_c")).agg(F.max(f"rest{m}").alias("rest"))
    found = cut(joined(parts, F.col("gram"), known, "_g"))
    found = joined(found, F.shiftrightunsigned("gram", LAST), rests, "_c")
    judged = cut(found.groupBy("word").agg(clipped(F.sum(F.col("n") * F.coalesce("ratio", "rest", F.lit(0.0))), CLIP).alias("r")).withColumnRenamed("word", "_w"))
    words = joined(counted, F.col("word"), judged, "_w")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("r"), "word"))
    sums = words.withColumn("_i", rank).groupBy("key").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("r")).alias("sum"), F.sum(F.col("n") * (F.octet_length("word") / 2 + 1)).alias("chars"), F.sum(F.when(F.col("r") > 2, F.col("n")).otherwise(0)).alias("many"),
        F.max("r").alias("top"), F.max(F.when(F.col("_i") == 1, F.col("n"))).alias("top_n"), F.max(F.when(F.col("_i") == 2, F.col("r"))).alias("next"),
    )
    second = F.when(F.col("top_n") > 1, F.col("top")).otherwise(F.coalesce("next", F.lit(0.0)))
    return sums.select("key", (F.col("sum") / F.col("chars")).alias("x0"), F.col("top").alias("x1"), second.alias("x2"), F.log1p(100 * F.col("many") / F.col("n")).alias("x3"))


class TableModel:
    """The same model where it has more than `model_grams` grams: they stay in a table of the shared folder."""

    def __init__(self, table: DataFrame):
        self.table, self.weights = table, np.zeros(5)

    def score(self, docs: DataFrame, name: str) -> DataFrame:
        texts = docs.select(text_key(F.col("text")).alias("key"), "text")
        z = sum((float(w) * F.col(f"x{i}") for i, w in enumerate(self.weights[1:])), F.lit(float(self.weights[0])))
        scores = looked_up(texts, self.table, 0).select(F.col("key").alias("_k"), (1 / (1 + F.exp(-clipped(z, 30.0)))).alias("_s"))
        none = 1 / (1 + np.exp(-np.clip(self.weights[0], -30, 30)))
        held = docs.select(F.struct(*docs.columns).alias("_d"), text_key(F.col("text")).alias("_key")).join(scores, F.col("_key") == F.col("_k"), "left")
        return held.select("_d.*", F.coalesce("_s", F.lit(float(none))).alias(name))


def sampled(known: DataFrame, fit_rows: int) -> tuple[DataFrame, float]:
    """About fit_rows labels of each class, chosen by a hash of the id: the same in every run; and what to add to an intercept that is fitted on them."""
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    share = {c: min(1.0, fit_rows / counts[c]) if c in counts else 1.0 for c in (0, 1)}
    kept = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1_000_000)) < 1_000_000 * F.when(F.col("toxic") > 0, share[1]).otherwise(share[0])
    return known.where(kept), float(np.log(share[0] / share[1]))


def train(docs: DataFrame, labels: DataFrame, model_grams: int = MODEL_GRAMS, fit_rows: int = FIT_ROWS) -> ToxicityModel | TableModel:
    """docs: doc_id, text; labels: doc_id, toxic. Counts come from all rows that have both; only the logistic fit takes a sample, fit_rows of each class."""
    tune(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    # labels grow with the documents: the join is by key at every size, never one that ships a side whole
    rows = texts.join(known.hint("merge"), F.col("doc_id") == F.col("_id")).select("text", (F.col("toxic") * FOLDS + F.col("fold")).alias("cell"))
    counted = cut(rows.mapInArrow(count_grams, "gram long, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS]))
    chosen, shift = sampled(known, fit_rows)
    # the sample's labels are about 2 * fit_rows, so they go to the texts
    sample = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "fold", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(FOLD_TASKS)).alias("part"))
    if counted.count() > model_grams:
        model = TableModel(cut(model_table(counted)))
        sample = cut(sample.withColumn("key", text_key(F.col("text"))))
        measured = [looked_up(own := sample.where(F.col("fold") == f), model.table, f + 1).join(own.select("key", "toxic"), "key", "right").select(*[F.coalesce(f"x{i}", F.lit(0.0)).alias(f"x{i}") for i in range(4)], "toxic").toArrow() for f in range(FOLDS)]
        points = pa.concat_tables(measured)
    else:
        kept = counted.orderBy("gram").toArrow()  # model_grams rows at most
        keys = kept.column("gram").to_numpy()
        counts = np.stack([kept.column(c).to_numpy() for c in COUNTS]).reshape(2, FOLDS, keys.size)
        model = ToxicityModel(keys, counts.sum(axis=1))
        shared = docs.sparkSession.sparkContext.broadcast((keys, counts))  # model_grams entries

        def measured(batches):
            without, made = None, None
            for batch in batches:
                texts, folds = batch.column("text").to_pylist(), batch.column("fold").to_numpy()
                x = np.zeros((len(texts), 4))
                for f in np.unique(folds).tolist():
                    if f != made:  # one model at a time; a task's rows come fold by fold
                        keys, counts = shared.value
                        without, made = ToxicityModel(keys, counts.sum(axis=1) - counts[:, f]), f
                    own = np.flatnonzero(folds == f)
                    x[own] = without.features([texts[i] for i in own])
                yield pa.RecordBatch.from_pydict({f"x{i}": x[:, i] for i in range(4)} | {"toxic": batch.column("toxic")})

        by_fold = sample.repartition(FOLDS * FOLD_TASKS, "fold", "part").sortWithinPartitions("fold")  # copies share a fold, not a task
        points = by_fold.mapInArrow(measured, "x0 double, x1 double, x2 double, x3 double, toxic int").toArrow()
        shared.destroy()
    x, y = np.column_stack([points.column(f"x{i}").to_numpy() for i in range(4)]), points.column("toxic").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    model.weights = fitted(x[order], y[order])
    model.weights[0] += shift
    return model


def score(docs: DataFrame, model: ToxicityModel | TableModel, name: str = "score") -> DataFrame:
    """docs with a column of scores appended; all columns stay."""
    if isinstance(model, TableModel):
        return model.score(docs, name)
    from pyspark.sql.types import DoubleType, StructField, StructType

    tune(docs.sparkSession)
    text_at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most model_grams entries

    def scored(batches):
        for batch in batches:
            scores = shared.value.score(batch.column(text_at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    tune(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    other = id_hash_mod("doc_id", 3) == 1
    model = train(docs.where(~other), labels)
    rows = score(docs.select("doc_id", "text"), model).drop("text")
    return rows.select("doc_id", F.coalesce(other, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below THRESHOLD; the labels of all documents of `docs` are learnt from."""
    tune(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    name = "_toxicity" + "_" * sum(c.lower().startswith("_toxicity") for c in docs.columns)
    return score(docs, model, name).where(F.col(name) < THRESHOLD).drop(name)
