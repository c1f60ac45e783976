"""Language identification with language-bitmask n-gram filters.

A Bloom filter is bit-sliced: each of its positions holds one bit per language (words of 64), so the AND of a few positions gives at
once all languages that contain an n-gram, however many there are. Per language the hits of a text's n-grams are counted, corrected for the share of false
positives that the filter's fill gives that language, and the largest count decides (ties: the smaller name).

Training: a bounded sample of the labelled rows of each language (`train_rows` of each), so a rare language is learnt too. A language contains an n-gram (4 folded characters, spaces at word ends)
if it occurs at least `least` times there, at a rate of at least `share` of the rate in the language where it is most frequent.
Null or empty texts, and texts without letters, are `und` with score 0. Without any labelled row every text is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_hash_mod, packs, table, tune

N, HASHES, BITS_PER_GRAM, TRAIN_ROWS, LEAST, SHARE = 4, 3, 16, 3000, 3, 0.2
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
SPACES = np.uint64(0x0020002000200020)


def grams(codes: np.ndarray) -> np.ndarray:
    """The n-gram at each position, exactly, in 64 bits; the last N - 1 positions get the gram of spaces."""
    wide = np.concatenate((codes, np.full(N - 1, 32, np.uint16))).astype(np.uint64)
    out = wide[: codes.size] << np.uint64(48)
    for i in range(1, N):
        out |= wide[i : codes.size + i] << np.uint64(16 * (N - 1 - i))
    return out


def useful(keys: np.ndarray) -> np.ndarray:
    """Grams whose second character is a letter: each letter of a text counts once, with a space before the first."""
    return ((keys >> np.uint64(32)) & np.uint64(0xFFFF)) != 32


class LanguageFilter:
    """masks: (n-grams, words of 64 languages), a bit per language."""

    def __init__(self, languages: list[str], keys: np.ndarray, masks: np.ndarray):
        self.languages = languages
        self.bits = max(10, int(np.ceil(np.log2(max(1, keys.size) * BITS_PER_GRAM))))
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        self.slices = np.zeros((1 << self.bits, max(1, -(-len(languages) // 64))), dtype=kind)
        for h in range(HASHES):
            np.bitwise_or.at(self.slices, self._at(keys, h), masks.reshape(-1, self.slices.shape[1]).astype(kind))
        self.false_rate = np.array([self._bit(self.slices, b).mean() for b in range(len(languages))]) ** HASHES

    @staticmethod
    def _bit(words: np.ndarray, b: int) -> np.ndarray:
        """Whether each row of words has language b."""
        return (words[:, b // 64] >> words.dtype.type(b % 64)) & words.dtype.type(1)

    def _at(self, keys: np.ndarray, h: int) -> np.ndarray:
        return ((keys * _MULTIPLIERS[h]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def languages_of(self, keys: np.ndarray) -> np.ndarray:
        """A row of words per key: the languages that contain it, and false positives."""
        found = self.slices[self._at(keys, 0)]
        for h in range(1, HASHES):
            found &= self.slices[self._at(keys, h)]
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        for first, last, codes, starts in packs([t or "" for t in texts], 1):
            keys = grams(codes)
            use = useful(keys)
            found = self.languages_of(keys) * use.astype(self.slices.dtype)[:, None]
            n = np.add.reduceat(use, starts, dtype=np.int64)
            hits = np.stack([np.add.reduceat(self._bit(found, b), starts, dtype=np.int64) for b in range(len(self.languages))])
            fixed = np.maximum(0, hits - n * self.false_rate[:, None]) / (1 - self.false_rate[:, None])
            best = np.argmax(fixed, axis=0)
            for i in np.flatnonzero(n):
                names[first + i] = self.languages[best[i]]
                scores[first + i] = float(min(1.0, fixed[best[i], i] / n[i]))
        return names, scores


def count_grams(batches):
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for lang in set(langs):
            for _, _, codes, _ in packs([t for t, x in zip(texts, langs, strict=True) if x == lang], 1):
                keys = grams(codes)
                keys, n = np.unique(keys[useful(keys)], return_counts=True)
                if lang in totals:
                    keys, at = np.unique(np.concatenate((totals[lang][0], keys)), return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate((totals[lang][1], n))).astype(np.int64)
                totals[lang] = (keys, n)
    for lang, (keys, n) in totals.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * keys.size, pa.string()), "gram": keys.astype(np.int64), "n": n.astype(np.int64)})


def sampled(labelled: DataFrame, train_rows: int) -> DataFrame:
    """About train_rows rows of each language (all, if it has fewer), chosen by a hash of doc_id: the same rows in every run."""
    counts = labelled.groupBy("lang").count().collect()  # a row per language
    share = [x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, train_rows / r["count"])))]
    if not share:
        return labelled
    return labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < 1_000_000 * F.element_at(F.create_map(*share), F.col("lang")))


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> LanguageFilter:
    """labelled: doc_id, text, lang. What reaches the driver are the frequent n-grams of the sample."""
    rows = sampled(labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"), train_rows).select("text", "lang")
    counted = rows.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).toArrow()
    languages = sorted(set(counted.column("lang").to_pylist()))
    if not languages:
        return LanguageFilter([], np.empty(0, np.uint64), np.empty(0, np.uint64))
    which = np.searchsorted(np.array(languages), np.array(counted.column("lang").to_pylist()))
    keys, at = np.unique(counted.column("gram").to_numpy().astype(np.uint64), return_inverse=True)
    n = np.zeros((len(languages), keys.size))
    n[which, at] = counted.column("n").to_numpy()
    rates = n / np.maximum(1, n.sum(axis=1, keepdims=True))
    holds = (rates > 0) & (rates >= SHARE * rates.max(axis=0))
    masks = np.zeros((keys.size, -(-len(languages) // 64)), np.uint64)
    for b, held in enumerate(holds):
        masks[held, b // 64] |= np.uint64(1) << np.uint64(b % 64)
    return LanguageFilter(languages, keys, masks)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, lang_pred, score."""
    tune(docs.sparkSession)

    def predict(batches):
        for batch in batches:
            names, scores = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """Rows without an id are learnt from by nothing and count as not held out."""
    return F.coalesce(id_hash_mod("doc_id", 4) == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(id_hash_mod("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
