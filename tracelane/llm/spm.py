"""SentencePiece encoding and decoding by suffix-array matching.

A text becomes words (a run of blanks and what follows it up to the next blank); no piece reaches over the end of such a word, so words are
encoded by themselves. The distinct words of a batch that are not known yet are concatenated; a suffix array over the longest piece's
length indexes them; every piece is looked up by binary search and its range of the array gives its occurrences. These edges, sorted by
where they end, are relaxed in one sweep: an edge is kept if the piece may follow the last piece of the encoding of what is before it.

The model in use is a byte-pair model, whose encoding is not the path of highest score but the result of its merges, so relaxing compares
no scores: by the merge order, a sequence of pieces is the encoding exactly if each two neighbours are (no merge across their border comes
before the merges that made them), and each prefix has exactly one last piece. So the sweep yields what the merges yield. Words that hold
several blanks in a row, whose merges can tie in rank, are merged one by one.

Characters that are no piece become byte pieces. Null texts give null; empty texts give no ids. A text that holds U+2581 decodes with
blanks in its place; all others decode to themselves. The model's path is a parameter.
"""

from __future__ import annotations

import re
from heapq import heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashTable, table, tune

BLANK, SEPARATOR = "▁", 0
INDEX_CHARS, KNOWN_WORDS, KNOWN_CHARS, GROUP_CHARS, MEMO_BITS = 1 << 18, 300_000, 1 << 22, 1 << 19, 20
_WORD = re.compile(r"▁*[^▁]+|▁+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def merge(word: str, ids: dict, rank: np.ndarray) -> list[tuple[str, tuple | None]]:
    """Merges of lowest rank first, the leftmost first among equal ones: (piece, its two parts or None). A heap of neighbours that may merge, a
    list linked by places: n log n."""
    n = len(word)
    parts: list = [(c, None) for c in word]
    before, after, heap = list(range(-1, n - 1)), list(range(1, n + 1)), []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            whole = parts[i][0] + parts[after[i]][0]
            k = ids.get(whole)
            if k is not None:
                heappush(heap, (rank[k], i, after[i], whole))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, whole = heappop(heap)
        if parts[i] is None or parts[j] is None or after[i] != j or parts[i][0] + parts[j][0] != whole:
            continue  # a part has merged with another since
        parts[i], parts[j] = (whole, (parts[i][0], parts[j][0])), None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]


def _words(text: str) -> list[str]:
    """A text's words without the blank that begins each."""
    if not text:
        return []
    if text[0] != " " and "  " not in text and BLANK not in text:
        return text.split(" ")
    return [w[1:] for w in _WORD.findall(BLANK + text.replace(" ", BLANK))]


class PieceModel:
    """Arrays made once from a model file; picklable."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
        n = s.get_piece_size()
        pieces = [s.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (s.is_control(i) or s.is_unknown(i) or s.is_byte(i) or s.is_unused(i))]
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(n) if s.is_byte(i)}
        score = np.array([s.get_score(i) for i in range(n)])
        order = np.lexsort((np.arange(n), -score))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        _, tied = np.unique(-score, return_inverse=True)
        ids = {pieces[i]: i for i in plain}
        if any(BLANK in p.lstrip(BLANK) for p in ids):
            raise ValueError("a piece of this model reaches over a word's end")
        self.ids, self.tied, self.texts = ids, tied, pieces
        # left and right part of each piece by its last merge; pieces that the merges don't make are left out
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        good = []
        for p, i in ids.items():
            made = merge(p, ids, tied)
            if len(made) == 1:
                good.append(i)
                if made[0][1]:
                    self.left[i], self.right[i] = ids[made[0][1][0]], ids[made[0][1][1]]
        self.rank = rank
        self.pieces = sorted((pieces[i], i) for i in good)
        made_of = {p: i for p, i in self.pieces}
        pairs = [(made_of[p[:c]], made_of[p[c:]], i) for p, i in self.pieces for c in range(1, len(p)) if p[:c] in made_of and p[c:] in made_of]
        self.pair_keys = np.array([(a << 32) | b for a, b, _ in pairs], dtype=np.uint64)
        self.pair_rank = rank[np.array([i for *_, i in pairs], dtype=np.int64)] if pairs else np.empty(0, np.int64)
        self.longest = max((len(p) for p, _ in self.pieces), default=1)
        raw = [b""] * n
        for i in plain:
            raw[i] = pieces[i].replace(BLANK, " ").encode()
        for b, i in self.bytes.items():
            raw[i] = bytes([b])
        self.raw, self.raw_at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


class Encoder:
    """Encodes words with a PieceModel; keeps what it has learnt about pairs of pieces, and a bounded number of words and of their characters."""

    def __init__(self, model: PieceModel):
        self.m = model
        self.pairs = HashTable(model.pair_keys, model.pair_rank.astype(np.int64), -1)
        self.memo_keys = np.full(1 << MEMO_BITS, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.memo = np.zeros(1 << MEMO_BITS, bool)
        chars = sorted({c for p, _ in model.pieces for c in p})
        self.alphabet = np.zeros(0x110000, np.uint16)  # 0: no piece has it
        self.alphabet[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = model.longest // 4 + 1  # beyond the longest piece, so that each has a place for what follows it
        self.piece_codes = np.zeros((len(model.pieces), 4 * self.width), np.uint16)
        for row, (p, _) in enumerate(model.pieces):
            self.piece_codes[row, : len(p)] = self.alphabet[[ord(c) for c in p]]
        self.piece_len = np.array([len(p) for p, _ in model.pieces], np.int32)
        after_end = np.arange(4 * self.width) >= self.piece_len[:, None]
        self.piece_keys = self._pack(self.piece_codes)  # what begins with a piece lies from its key up to the key that goes on with the last code
        self.piece_ends = self._pack(np.where(after_end, np.uint16(0xFFFF), self.piece_codes))
        self.piece_id = np.array([i for _, i in model.pieces], np.int32)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.flat, self.filled = np.empty(1 << 18, np.int32), 0
        self.at, self.words = np.zeros(1 << 16, np.int64), 0  # the ids of word i are flat[at[i] : at[i + 1]]

    # -- the suffix array and the pieces' ranges in it

    @staticmethod
    def _pack(windows: np.ndarray) -> np.ndarray:
        w = windows.astype(np.uint64)
        return (w[..., 0::4] << np.uint64(48)) | (w[..., 1::4] << np.uint64(32)) | (w[..., 2::4] << np.uint64(16)) | w[..., 3::4]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and piece rows of all occurrences of all pieces in codes."""
        padded = np.concatenate((codes, np.zeros(4 * self.width, np.uint16)))
        quads = self._pack(np.lib.stride_tricks.sliding_window_view(padded, 4))[:, 0]  # 4 characters from each position
        # doubling: ranks by 4 characters, then by 8, 16, ... until the longest piece is covered
        rank, covered, array = quads, 4, None
        while True:
            array = np.argsort(rank)
            if covered >= self.m.longest:
                break
            line = rank[array]
            dense = np.empty(rank.size, np.uint64)
            dense[array] = np.concatenate(([0], np.cumsum(line[1:] != line[:-1]))).astype(np.uint64)
            rank = dense << np.uint64(32)
            rank[:-covered] |= dense[covered:]
            covered *= 2
        array = array[array < codes.size].astype(np.int32)
        keys = np.stack([quads[np.minimum(array + 4 * j, quads.size - 1)] for j in range(self.width)], axis=1)
        low, high = self._search(keys, self.piece_keys), self._search(keys, self.piece_ends)
        counts = high - low
        rows = np.repeat(np.arange(counts.size, dtype=np.int32), counts)
        return array[np.arange(rows.size, dtype=np.int32) + np.repeat((low - np.cumsum(counts) + counts).astype(np.int32), counts)], rows

    def _search(self, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The number of keys below each wanted one: binary search by the first column, then, where keys share it, by the others."""
        first = np.ascontiguousarray(keys[:, 0])
        low, top = np.searchsorted(first, wanted[:, 0], "left"), np.searchsorted(first, wanted[:, 0], "right")
        live = np.flatnonzero(low < top)
        a, b, sought = low[live], top[live], wanted[live]
        while live.size:
            mid = (a + b) // 2
            here = keys[mid]
            less, same = np.zeros(live.size, bool), np.ones(live.size, bool)
            for j in range(1, self.width):
                less |= same & (here[:, j] < sought[:, j])
                same &= here[:, j] == sought[:, j]
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            low[live] = a
            open_ = a < b
            live, a, b, sought = live[open_], a[open_], b[open_], sought[open_]
        return low

    # -- which piece may follow which

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO_BITS)).astype(np.int64)
        out = self.memo[slot]
        miss = np.flatnonzero(self.memo_keys[slot] != keys)
        if miss.size:
            new, back = np.unique(keys[miss], return_inverse=True)
            answer = self._stable((new >> np.uint64(32)).astype(np.int64), (new & np.uint64(0xFFFFFFFF)).astype(np.int64))
            out[miss] = answer[back]
            self.memo_keys[slot[miss]], self.memo[slot[miss]] = keys[miss], answer[back]
        return out

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging a's and b's characters leaves the border: undo, latest first, the merges that made the pieces at the border;
        a merge across it that would have come before the last one undone decides. At equal ranks the left one comes first."""
        m = self.m
        ok, live = np.ones(a.size, bool), np.arange(a.size)
        a, b = a.copy(), b.copy()
        limit = np.full(a.size, np.iinfo(np.int64).max)  # twice the rank of the last merge undone, plus 1 if it was on the left
        while live.size:
            x, y = a[live], b[live]
            across, there = self.pairs.get((x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64))
            wrong = there & (2 * across < limit[live])
            ok[live[wrong]] = False
            live = live[~wrong]
            x, y = a[live], b[live]
            split_x, split_y = m.left[x] >= 0, m.left[y] >= 0
            rank_x, rank_y = np.where(split_x, m.rank[x], -1), np.where(split_y, m.rank[y], -1)
            on_left = split_x & (rank_x > rank_y)
            on_right = split_y & ~on_left
            limit[live[on_left]] = 2 * rank_x[on_left]
            a[live[on_left]] = m.right[x[on_left]]
            limit[live[on_right]] = 2 * rank_y[on_right] + 1
            b[live[on_right]] = m.left[y[on_right]]
            live = live[on_left | on_right]
        return ok

    # -- words

    def learn(self, words: list[str]) -> None:
        """Encodes words, appends their ids to the flat array and keeps their places, by the word without the blank that begins it."""
        m, simple, slow = self.m, [], []
        for w in words:
            (slow if w.count(BLANK) > 1 else simple).append(w)
        first = 0
        while first < len(simple):
            size, last = 0, first
            while last < len(simple) and (last == first or size < INDEX_CHARS):
                size += len(simple[last]) + 1
                last += 1
            self._learn_simple(simple[first:last])
            first = last
        for w in slow:
            ids = []
            for p, _ in merge(w, m.ids, m.tied):
                ids += [m.ids[p]] if p in m.ids else [m.bytes[b] for b in p.encode("utf-8", "replace")]
            self._store(np.array(ids, np.int32), np.array([len(ids)]))
            self.known[w[1:]] = self.words - 1

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.filled + ids.size > self.flat.size:
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.flat[self.filled : self.filled + ids.size] = ids
        while self.words + lengths.size + 1 > self.at.size:
            self.at = np.concatenate((self.at, np.empty_like(self.at)))
        self.at[self.words + 1 : self.words + 1 + lengths.size] = self.filled + np.cumsum(lengths)
        self.filled += ids.size
        self.words += lengths.size

    def _learn_simple(self, words: list[str]) -> None:
        m = self.m
        joined = "\0".join(words) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.alphabet[points]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(lengths + 1) - lengths - 1
        codes[begins + lengths] = SEPARATOR
        starts, rows = self.edges(codes)
        ends = starts + self.piece_len[rows]
        offset = (np.arange(codes.size) - np.repeat(begins, lengths + 1)).astype(np.int32)
        order = np.argsort(np.minimum(offset[ends - 1], 0xFFFF).astype(np.uint16), kind="stable").astype(np.int32)
        if offset.size and offset.max() >= 0xFFFF:
            order = np.argsort(offset[ends - 1], kind="stable")
        starts, ends, pieces = starts[order], ends[order], self.piece_id[rows[order]]
        steps = offset[ends - 1]
        # last[p]: the last piece of the encoding of its word up to p; -1: none ends there; -2: a word's begin or an unknown character before p
        last = np.full(codes.size + 1, -1, np.int32)
        came = np.full(codes.size + 1, -1, np.int32)
        last[begins] = -2
        unknown = np.flatnonzero((codes == SEPARATOR))
        strange = np.setdiff1d(unknown, begins + lengths, assume_unique=True)
        last[strange + 1] = -2
        last[begins + lengths + 1] = -2
        cuts = np.flatnonzero(np.diff(steps)) + 1
        for lo, hi in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [steps.size])).tolist(), strict=True):
            if lo == hi:
                continue
            before = last[starts[lo:hi]]
            fits = before == -2
            test = np.flatnonzero(before >= 0)
            if test.size:
                fits[test] = self.may_follow(before[test], pieces[lo:hi][test])
            won = np.flatnonzero(fits)
            last[ends[lo:hi][won]] = pieces[lo:hi][won]
            came[ends[lo:hi][won]] = starts[lo:hi][won]
        self._collect(words, points, codes, begins, lengths, last, came)

    def _collect(self, words, points, codes, begins, lengths, last, came) -> None:
        """Walks all words back from their ends at once."""
        m = self.m
        at, word = (begins + lengths).copy(), np.arange(len(words))
        found_word, found_at, found_id = [], [], []
        live = np.flatnonzero(at > begins)
        while live.size:
            p = at[live]
            strange = codes[p - 1] == SEPARATOR
            ids = np.where(strange, -1 - points[p - 1].astype(np.int64), last[p])
            found_word.append(word[live])
            found_at.append(p)
            found_id.append(ids)
            at[live] = np.where(strange, p - 1, came[p])
            live = live[at[live] > begins[live]]
        if not found_word:
            found_word, found_at, found_id = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        w, p, ids = np.concatenate(found_word), np.concatenate(found_at), np.concatenate(found_id)
        order = np.argsort(p, kind="stable")  # words lie one after another, so this is also the order of words
        w, ids = w[order], ids[order]
        odd = np.flatnonzero(ids < 0)
        if odd.size:
            spelled = [[m.bytes[b] for b in chr(-1 - i).encode("utf-8", "replace")] for i in ids[odd].tolist()]
            width = np.ones(ids.size, np.int64)
            width[odd] = [len(s) for s in spelled]
            w, ids = np.repeat(w, width), np.repeat(ids, width)
            ids[ids < 0] = np.concatenate([np.array(s) for s in spelled])
        number = self.words
        self._store(ids.astype(np.int32), np.bincount(w, minlength=len(words)))
        self.known.update(zip((x[1:] for x in words), range(number, number + len(words)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        if len(self.known) > KNOWN_WORDS or self.chars > KNOWN_CHARS:  # a text without blanks is one word
            self.forget()
        split = [_words(t) for t in texts]
        every = list(chain.from_iterable(split))
        numbers = np.fromiter(map(self.known.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(numbers < 0)
        if missing.size:
            new = sorted({every[i] for i in missing.tolist()})
            self.learn([BLANK + w for w in new])
            self.chars += sum(map(len, new)) + len(new)
            numbers[missing] = [self.known[every[i]] for i in missing.tolist()]
        at = self.at
        sizes = at[numbers + 1] - at[numbers]
        total = np.cumsum(sizes)
        ids = self.flat[np.arange(int(total[-1]) if total.size else 0) + np.repeat(at[numbers] - (total - sizes), sizes)]
        ends = np.cumsum([len(ws) for ws in split])
        return ids, np.concatenate(([0], np.where(ends > 0, np.concatenate(([0], total))[ends], 0))).astype(np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        m = self.m
        sizes = m.raw_at[ids + 1] - m.raw_at[ids]
        total = np.cumsum(sizes)
        data = m.raw[np.arange(int(total[-1]) if total.size else 0) + np.repeat(m.raw_at[ids] - (total - sizes), sizes)].tobytes()
        edges = np.concatenate(([0], total))[offsets].tolist()
        return [data[a + (a < b) : b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:], strict=False)]  # without the blank put before


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per Python worker and model: what it has learnt about pairs of pieces serves the worker's later tasks."""
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(shared.value)
    return _ENCODERS[shared.id]


class _Shared:
    def __init__(self, spark, model: PieceModel):
        self.broadcast = spark.sparkContext.broadcast(model)
        self.id = hash((id(model), self.broadcast._jbroadcast.id()))

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def _groups(texts: list[str | None]):
    first = 0
    while first < len(texts):
        size, last = 0, first
        while last < len(texts) and (last == first or size < GROUP_CHARS):
            size += len(texts[last] or "")
            last += 1
        yield first, last
        first = last


def encode(docs: DataFrame, model: PieceModel) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, ids (null for null), and whether decoding the ids gives the text again."""
    tune(docs.sparkSession)
    shared = _Shared(docs.sparkSession, model)

    def scan(batches):
        encoder = _encoder(shared)
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id")
            for first, last in _groups(texts):
                part = [t or "" for t in texts[first:last]]
                ids, offsets = encoder.encode(part)
                back = encoder.decode(ids, offsets)
                same = [b == t or b == t.replace(BLANK, " ") for b, t in zip(back, part, strict=True)]
                null = pa.array([t is None for t in texts[first:last]])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                if null.true_count:
                    import pyarrow.compute as pc

                    lists = pc.if_else(null, pa.scalar(None, lists.type), lists)
                yield pa.RecordBatch.from_arrays([keys.slice(first, last - first), lists, pa.array(same, pa.bool_())], names=["doc_id", "ids", "round_trip"])
        encoder.forget()  # an idle worker keeps no words

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """encoded: doc_id, ids. Returns doc_id, text."""
    tune(encoded.sparkSession)
    shared = _Shared(encoded.sparkSession, model)

    def scan(batches):
        encoder = _encoder(shared)
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                text = None if ids is None else encoder.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "text": pa.array([text], pa.string())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(scan, "doc_id long, text string")


def query(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    tune(spark)
    return encode(table(spark, sf_dir, "documents"), PieceModel(model_path)).select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "round_trip")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: doc_id, ids, n_ids, round_trip of every document."""
    tune(spark)
    return encode(docs, PieceModel()).select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "round_trip")
