"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are compared as sets of shingles of `SHINGLE` blank-separated words in lower case (a text of fewer words is one shingle, a text
without words has none and no links). Two texts link if their sets' Jaccard similarity is at least `THRESHOLD`.

1. Equal texts are one class. Sketches (MinHash values) are taken where the texts lie, and each class keeps one.
2. Bands of MinHash values give candidates: texts that share a band. With 25 bands of 5 values a pair at the threshold is missed with
   probability 5e-5, one at 0.9 with 2e-10.
3. Within a band's bucket, MinHash values are compared chunk by chunk; with a uniform prior, the posterior of similarity given m matches
   of n is Beta(m + 1, n - m + 1), and a pair is dropped once the probability of reaching the threshold is below `TOLERANCE`. Buckets of
   the same members are one. Buckets of more than `BUCKET` texts are not compared here: all their members stay together.
4. What is left makes clusters (connected components), so texts that merely share a band don't meet again. A cluster is dealt out by hash
   into parts of about `PART` texts and `PART_BYTES` bytes of shingles. A part's texts are compared with each other in one task: pruned
   as before, then verified exactly by their shingles.
5. The parts of larger clusters are written to the shared folder, one file each, and each pair of parts is compared in a task that reads
   its two files: no text is shuffled more than once, whatever the size of its cluster.
6. A task returns, per text, its number of links and one edge that spans its links, never all pairs. Components of the edges are groups.

Null texts are empty texts; all of these are one class. A class is named by its smallest doc_id (class_id). If no row of it has one, or if
a class of other text has the same smallest id, its name is a negative number made of its text. Rows that repeat are copies of each other.
"""

from __future__ import annotations

import io
import re
import uuid
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, store, table, tune, written

SHINGLE, THRESHOLD, BANDS, ROWS, CHUNK, TOLERANCE = 5, 0.8, 25, 5, 25, 1e-6
#: Texts of a bucket that is compared whole, texts and bytes of shingles of a part, digests that a task keeps.
BUCKET, PART, PART_BYTES, SEEN = 256, 128, 16 << 20, 200_000
HASHES = BANDS * ROWS
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 31, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 62, HASHES, dtype=np.uint64)
_POWERS = np.cumprod(np.full(1 << 12, np.uint64(0x100000001B3)), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if starts.size == 0:
        return np.empty(0, np.uint64)
    # a word's hash: the sum of its bytes times powers of a base, by place in the word
    place = np.arange(raw.size) - np.repeat(starts, np.diff(np.concatenate((starts, [raw.size])))) if starts[0] == 0 else np.concatenate((np.zeros(starts[0], np.int64), np.arange(starts[0], raw.size) - np.repeat(starts, np.diff(np.concatenate((starts, [raw.size]))))))
    power = _POWERS[place & 4095] + (place >> 12).astype(np.uint64)
    value = np.where(solid, (raw.astype(np.uint64) + np.uint64(1)) * power, np.uint64(0))
    words = mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))
    if words.size < SHINGLE:
        n, out = words.size, np.zeros(1, np.uint64)
        for i in range(n):
            out = mix(out + words[i : i + 1])
    else:
        n = words.size - SHINGLE + 1
        out = np.zeros(n, np.uint64)
        for i in range(SHINGLE):
            out = mix(out + words[i : i + n])
    return np.unique(out)


def minhash(values: np.ndarray) -> np.ndarray:
    """HASHES minima, the upper 32 bits of each."""
    low = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for lo in range(0, values.size, 2048):
        part = values[lo : lo + 2048]
        low = np.minimum(low, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key + rows[:, i])
    return key.astype(np.int64)


def least_matches() -> list[int]:
    """For each number of values compared, CHUNK by CHUNK: the fewest matches whose posterior of reaching the threshold isn't below TOLERANCE.
    P(s >= t | m of n) under Beta(m + 1, n - m + 1) is the probability of at most m successes in n + 1 trials of chance t."""
    out = []
    for n in range(CHUNK, HASHES + 1, CHUNK):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
            if total >= TOLERANCE:
                break
            m += 1
        out.append(m)
    return out


LEAST = least_matches()


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs (left[i], right[i]) of sets reach the threshold, exactly."""
    if left.size <= 64:
        common = np.array([np.intersect1d(sets[a], sets[b], assume_unique=True).size for a, b in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
    else:
        used, back = np.unique(np.concatenate((left, right)), return_inverse=True)
        a, b = back[: left.size], back[left.size :]
        values, column = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
        row = np.repeat(np.arange(used.size), [sets[i].size for i in used])
        often = np.bincount(column, minlength=values.size) > 1
        number = np.cumsum(often) - 1
        keep = often[column]
        row, column = row[keep], number[column[keep]]
        together = np.zeros((used.size, used.size), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for lo in range(0, int(often.sum()), 4096):  # the incidence matrix, some columns at a time
            x, y = np.searchsorted(column, (lo, lo + 4096))
            dense = np.zeros((used.size, 4096), np.float32)
            dense[row[x:y], column[x:y] - lo] = 1
            together += dense @ dense.T
        common = together[a, b].astype(np.int64)
    size = np.array([s.size for s in sets], np.int64)
    return common * 10 >= np.int64(round(THRESHOLD * 10)) * (size[left] + size[right] - common)


def candidates(sketches: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that share a band and that the posterior doesn't rule out; with `side`, only pairs across sides."""
    n = len(sketches)
    keys = np.stack([band_keys(s) for s in sketches])
    left, right = [], []
    for i in range(n - 1):
        share = (keys[i + 1 :] == keys[i]).any(axis=1)
        if side is not None:
            share &= side[i + 1 :] != side[i]
        j = np.flatnonzero(share) + i + 1
        left.append(np.full(j.size, i))
        right.append(j)
    left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    matches = np.zeros(left.size, np.int64)
    for step, least in enumerate(LEAST):
        lo = step * CHUNK
        matches += (sketches[left, lo : lo + CHUNK] == sketches[right, lo : lo + CHUNK]).sum(axis=1)
        stay = matches >= least
        left, right, matches = left[stay], right[stay], matches[stay]
    return left, right


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest place along links, of each place."""
    root = np.arange(n)
    while left.size:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def compare(nodes: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """One part, or two parts (side: which) of which only pairs across count: (node, its links here, the smallest node it is joined to here)."""
    left, right = candidates(sketches, side)
    ok = verified(sets, left, right) if left.size else np.empty(0, bool)
    left, right = left[ok], right[ok]
    links = np.bincount(np.concatenate((left, right)), minlength=nodes.size)
    root = roots(nodes.size, left, right)
    best = np.full(nodes.size, np.iinfo(np.int64).max)
    np.minimum.at(best, root, nodes)
    return [(int(nodes[i]), int(links[i]), int(best[root[i]])) for i in np.flatnonzero(links)]


def followed(parents: DataFrame) -> DataFrame:
    """parents: node, root (smaller). Follows roots that have a parent themselves, by doubling; each round is cut to the shared folder."""
    while True:
        above = parents.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        new = written(parents.join(above, parents["root"] == above["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        parents = new.select("node", "root")
        if not new.where("moved").limit(1).count():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs). Returns node, root (the smallest node of its component) of every node with an edge to another.

    Contraction: each node that has a smaller neighbour takes the smallest as its parent; parents are followed to the local minima, which
    alone stay in the graph, and edges pass to them. So edges vanish within few rounds and none is made that wasn't there."""

    def canon(df, x, y):
        return df.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()

    now, forest = written(canon(edges, "a", "b")), []
    while now.limit(1).count():
        parents = followed(written(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))))
        forest.append(parents)
        moved = now.join(parents, now["u"] == parents["node"]).select("v", F.col("root").alias("x"))
        now = written(canon(moved.join(parents, moved["v"] == parents["node"], "left").select("x", F.coalesce("root", "v").alias("y")), "x", "y"))
    if not forest:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where("a <> b")
    labels = followed(reduce(DataFrame.union, forest)) if len(forest) > 1 else forest[0]  # the roots of one round have no parents
    return labels.union(labels.select(F.col("root").alias("node"), "root").distinct())


def runs(batches, keys: list[str]):
    """Groups of consecutive rows of equal keys over all batches, as lists of dicts; callers group by keys of bounded groups."""
    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            key = tuple(r[k] for k in keys)
            if key != now and rows:
                yield rows
                rows = []
            now = key
            rows.append(r)
    if rows:
        yield rows


def text_key():
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def unnamed(key):
    """A negative number made of a text's digest."""
    return -F.abs(F.xxhash64(key) % F.lit(1 << 62)) - 1


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row, and (key, node, class_id, teller, n_docs) of every distinct text. key: the text's digest; node: a number of the
    class inside a run; class_id: its name; teller: the doc_id of the row that stands for the class, or `unnamed`."""
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.monotonically_increasing_id().alias("row")))
    held = rows.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("row").alias("node"), F.min("doc_id").alias("least"))
    nth = F.row_number().over(Window.partitionBy(F.coalesce("least", "node"), F.col("least").isNull()).orderBy("key"))
    name = F.when(F.col("least").isNotNull() & (nth == 1), F.col("least")).otherwise(unnamed("key"))
    return rows.select("doc_id", "key"), written(held.select("key", "node", "n_docs", name.alias("class_id"), F.coalesce("least", unnamed("key")).alias("teller")))


def sketch(batches):
    """Sketches of the texts of a task; a text that it has met among its last SEEN ones is not sketched again."""
    seen: set[bytes] = set()
    for batch in batches:
        keys, bands, sketches, sizes = [], [], [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if key in seen:
                continue
            seen = {key} if len(seen) >= SEEN else seen
            seen.add(key)
            values = shingles(text or "")
            if values.size:
                signature = minhash(values)
                keys.append(key)
                bands.append(band_keys(signature))
                sketches.append(signature.tobytes())
                sizes.append(values.nbytes)
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.binary()), "bytes": pa.array(sizes, pa.int64())})


def near(sketched: DataFrame) -> DataFrame:
    """sketched: node, bands, sketch. Edges (a, b) that span, within each bucket, the pairs that the sketches don't rule out."""
    banded = sketched.select("node", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = written(banded.join(sizes, "band").select("band", "node", "leader", "n"))
    large = members.where((F.col("n") > BUCKET) & (F.col("node") != F.col("leader"))).select(F.col("node").alias("a"), F.col("leader").alias("b"))
    small = members.where(F.col("n") <= BUCKET).groupBy("band").agg(F.array_sort(F.collect_set("node")).alias("nodes")).select("nodes").distinct()  # BUCKET nodes at most
    asked = small.select(F.xxhash64("nodes").alias("bucket"), F.explode("nodes").alias("node")).join(sketched.select("node", "sketch"), "node")

    def pruned(batches):
        for group in runs(batches, ["bucket"]):
            left, right = candidates(np.stack([np.frombuffer(r["sketch"], np.uint32) for r in group]))
            root = roots(len(group), left, right)
            at = np.flatnonzero(root != np.arange(root.size))
            nodes = np.array([r["node"] for r in group], np.int64)
            yield pa.RecordBatch.from_pydict({"a": nodes[at], "b": nodes[root[at]]})

    return large.union(asked.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(pruned, "a long, b long"))


def links(sets: DataFrame, places: DataFrame, folder: str) -> DataFrame:
    """sets: node, root, part, parts, sketch, shingles. places: root, part, parts of every part. Returns (node, links, root): per text and comparison."""
    schema = "node long, links long, root long"

    def told(found):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], [], []))], names=["node", "links", "root"])

    def within(batches):
        files, at = store(folder)
        for group in runs(batches, ["root", "part"]):
            nodes, sketches = np.array([r["node"] for r in group], np.int64), np.stack([np.frombuffer(r["sketch"], np.uint32) for r in group])
            own = [np.frombuffer(r["shingles"], np.uint64) for r in group]
            if group[0]["parts"] > 1:
                data = io.BytesIO()
                np.savez(data, nodes=nodes, sketches=sketches, sizes=[x.size for x in own], sets=np.concatenate(own))
                draft = f"{at}/_{uuid.uuid4().hex}"
                with files.open_output_stream(draft) as out:
                    out.write(data.getvalue())
                files.move(draft, f"{at}/{group[0]['root']}-{group[0]['part']}")  # a task that runs again writes the same
            yield told(compare(nodes, sketches, own))

    def load(files, path):
        with files.open_input_stream(path) as stream:
            data = np.load(io.BytesIO(stream.read()))
        return data["nodes"], data["sketches"], np.split(data["sets"], np.cumsum(data["sizes"])[:-1])

    def across(batches):
        files, at = store(folder)
        held, part = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if held != (r["root"], r["p"]):
                    held, part = (r["root"], r["p"]), load(files, f"{at}/{r['root']}-{r['p']}")
                other = load(files, f"{at}/{r['root']}-{r['q']}")
                side = np.repeat([0, 1], [part[0].size, other[0].size])
                yield told(compare(np.concatenate((part[0], other[0])), np.concatenate((part[1], other[1])), part[2] + other[2], side))

    first = written(sets.repartition("root", "part").sortWithinPartitions("root", "part", "node").mapInArrow(within, schema))
    # parts are dealt by hash, so one of few texts may be empty and have no file
    pairs = places.where("part + 1 < parts").select("root", F.col("part").alias("p"), F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("q"))
    pairs = pairs.join(places.select("root", F.col("part").alias("q")), ["root", "q"], "left_semi")
    second = pairs.repartition("root", "p", "q").sortWithinPartitions("root", "p").mapInArrow(across, schema)
    return first.union(written(second))


def join(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns per row: doc_id, class_id, n_copies (rows of the class), n_links (other classes within the threshold),
    group_id (the smallest class_id of its connected component), and key, the digest of its text."""
    spark = docs.sparkSession
    tune(spark)
    rows, named = classes(docs)
    # texts are sketched where they lie, once in each task, and their class picked afterwards: no text is shuffled, and few sketches of copies
    found = docs.select(text_key().alias("key"), "text").mapInArrow(sketch, "key binary, bands array<long>, sketch binary, bytes long")
    sketched = written(found.join(named.select("key", "node", "teller"), "key").dropDuplicates(["key"]))
    clusters = components(near(sketched)).join(sketched.select("node", "key", "teller", "sketch", "bytes"), "node")
    sizes = clusters.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / PART), F.ceil(F.sum("bytes") / PART_BYTES)).cast("int").alias("parts"))
    placed = written(clusters.join(sizes, "root").select("node", "key", "teller", "root", "sketch", "parts", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part")))

    def shingled(batches):  # shingles are made again, from the texts of candidates only
        for batch in batches:
            data = [shingles(t).tobytes() for t in batch.column("text").to_pylist()]
            names = ["node", "root", "part", "parts", "sketch"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(data, pa.binary())], names=[*names, "shingles"])

    # copies lie under their own ids, so those of one text go to many tasks, and only the row that stands for the class meets its sketch
    texts = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), unnamed(text_key())).alias("teller"), text_key().alias("key"), "text")
    texts = texts.join(placed, ["teller", "key"]).dropDuplicates(["teller", "key"])
    sets = texts.select("node", "root", "part", "parts", "sketch", "text").mapInArrow(shingled, "node long, root long, part int, parts int, sketch binary, shingles binary")
    folder = scratch(spark, "parts")
    spans = links(sets, placed.select("root", "part", "parts").distinct(), folder)
    counts = spans.groupBy("node").agg(F.sum("links").alias("n_links"))
    joined = components(spans.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", "root")
    told = named.join(counts, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = told.groupBy("root").agg(F.coalesce(F.min(F.when(F.col("class_id") >= 0, F.col("class_id"))), F.min("class_id")).alias("group_id"))
    told = told.join(groups, "root").select("key", "class_id", F.col("n_docs").alias("n_copies"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "group_id")
    return rows.join(told, "key").select("doc_id", "class_id", "n_copies", "n_links", "group_id", "key")


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("key")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of smallest doc_id, one without an id only where the group has no other; ties by the text's digest.
    Groups are transitive: a document may go without a link to the one that stays, through a chain of links. Repeated rows give one row."""
    told = join(docs.select("doc_id", "text"))
    one = told.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")).alias("_o"))

    def row(doc_id, key):
        return F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), F.lit(" "), F.hex(key))

    kept = one.select(row(F.col("_o.doc_id"), F.col("_o.key")).alias("_row"))
    names = list(docs.columns)
    held = docs.select(F.struct(*names).alias("_doc"), row(F.col("doc_id"), text_key()).alias("_row"))
    return held.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select("_doc.*")


#: All pairs of texts that share a shingle, verified; groups by following links from each group's smallest class.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT t, min(doc_id) AS class_id, count(*) AS n_copies FROM d GROUP BY t),
w AS (SELECT class_id, regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+') AS w FROM c),
s AS (SELECT DISTINCT class_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT class_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.class_id < y.class_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.class_id = a JOIN n y ON y.class_id = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT class_id, class_id FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE e.b > r.root),
g AS (SELECT node, min(root) AS group_id FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1)
SELECT doc_id, class_id, n_copies, coalesce(n_links, 0)::BIGINT AS n_links, group_id FROM d JOIN c USING (t) JOIN g ON g.node = class_id LEFT JOIN k ON k.a = class_id
"""
