"""What the corpus operators share: lineage cuts, packed text arrays, a hash table for numpy."""

from __future__ import annotations

import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bounded_batches
from ..shared import scratch, shared_dir, store

__all__ = ["HashTable", "cut", "scratch", "shared_dir", "store", "table", "tune", "written"]

BATCH_ROWS = 1000
PACK_CHARS = 1 << 20
SHORT = 0xFFFF
#: Bytes of a row group of what `written` writes; its folder in each application.
GROUP_BYTES = 16 << 20
_WRITTEN: dict[str, str] = {}


def tune(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes, and workers that can import the package."""
    bounded_batches(spark, BATCH_ROWS)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there: later jobs survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like `cut`, but the tasks write Parquet from Python. Hadoop's local file system starts a process for each file and folder that it makes, to
    set permissions, and until that process runs its program it seems to hold all memory of the executor's JVM a second time."""
    spark, schema = df.sparkSession, df.schema
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        _WRITTEN[app] = scratch(spark, "written")
    folder = f"{_WRITTEN[app]}/{uuid.uuid4().hex}"
    files, at = store(folder)
    files.create_dir(at)

    def write(batches):
        from pyarrow import parquet

        (files, at), held, writer = store(folder), [], None
        draft = f"{at}/_{uuid.uuid4().hex}"
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if held and (batch is None or sum(b.nbytes for b in held) >= GROUP_BYTES):
                writer = writer or parquet.ParquetWriter(draft, held[0].schema, filesystem=files)
                writer.write_table(pa.Table.from_batches(held))
                held = []
        if writer:
            writer.close()
            files.move(draft, f"{at}/part-{TaskContext.get().partitionId():06}.parquet")  # a task that runs again writes the same
        yield from ()

    df.mapInArrow(write, "none long").collect()
    return spark.read.schema(schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_hash_mod(column: str, n: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def bounded(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows of df, chosen by a hash of `key`: the same rows in every run, read where they lie."""
    total = df.count()
    if total <= rows:
        return df
    share = max(1, round(rows / total * 1_000_000))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(1_000_000)) < share)


def _fold_table() -> np.ndarray:
    fold = np.full(SHORT + 1, 32, dtype=np.uint16)
    for code in range(SHORT + 1):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            fold[code] = ord(low) if len(low) == 1 and ord(low) <= SHORT else code
    return fold


_FOLD: list[np.ndarray] = []


def fold() -> np.ndarray:
    if not _FOLD:
        _FOLD.append(_fold_table())
    return _FOLD[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def folded(text: str) -> np.ndarray:
    """Lower-case letters as 16-bit codes, everything else as a space. Letters beyond the first plane share codes."""
    codes = code_points(text)
    out = fold()[np.minimum(codes, SHORT)]
    far = np.flatnonzero(codes > SHORT)
    if far.size:
        out = out.copy()
        out[far] = [0x8000 | (c & 0x7FFF) if chr(c).isalpha() else 32 for c in codes[far].tolist()]
    return out


def packs(texts: list[str], pad: int, limit: int = PACK_CHARS):
    """Joins neighbouring texts to arrays of about `limit` characters: (first, last + 1, folded codes, starts).
    Each text is preceded by `pad` spaces; text i owns the positions from starts[i] to starts[i + 1]. A longer text is a pack of its own."""
    first = 0
    while first < len(texts):
        size, last = 0, first
        while last < len(texts) and (last == first or size + len(texts[last]) <= limit):
            size += len(texts[last]) + pad
            last += 1
        gap = " " * pad
        joined = gap + gap.join(texts[first:last]) + gap
        lengths = np.fromiter((len(t) + pad for t in texts[first:last]), dtype=np.int64, count=last - first)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        yield first, last, folded(joined), starts
        first = last


class HashTable:
    """64-bit keys to values by open addressing in numpy arrays; missing keys give `default`."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray, default=0, load: float = 0.3):
        bits = max(4, int(np.ceil(np.log2(max(1, keys.size) / load))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, self.EMPTY, dtype=np.uint64)
        self.values = np.full(1 << bits, default, dtype=values.dtype)
        self.default = default
        pending, at = keys.astype(np.uint64), self._home(keys.astype(np.uint64))
        waiting = np.arange(keys.size)
        while waiting.size:
            slots = at[waiting]
            free = self.keys[slots] == self.EMPTY
            chosen, where = np.unique(slots[free], return_index=True)
            winners = waiting[free][where]
            self.keys[chosen], self.values[chosen] = pending[winners], values[winners]
            left = np.ones(waiting.size, dtype=bool)
            left[np.flatnonzero(free)[where]] = False
            waiting = waiting[left]
            at[waiting] = (at[waiting] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and whether each key is there."""
        keys = keys.astype(np.uint64, copy=False)
        at = self._home(keys)
        held = self.keys[at]
        found = held == keys
        out = np.where(found, self.values[at], self.default)
        todo = np.flatnonzero(~found & (held != self.EMPTY))
        while todo.size:
            at[todo] = (at[todo] + 1) & self.mask
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            found[todo[hit]] = True
            todo = todo[~hit & (held != self.EMPTY)]
        return out, found
