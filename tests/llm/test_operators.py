"""Each operator against brute force, an exact round trip or held-out accuracy, and on hard inputs."""

import base64
import hashlib
import math
import random
import re
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelane.llm import ann, common, exact_topk, langid, mixing, ngram_join, pii, sharding, spm, toxicity, warc
from tracelane.llm.common import HashTable

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000


def hard_documents(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n ", "en", "a", 3), (4, LONG, "en", "a", len(LONG)), (5, "same text here", "en", "b", 14), (6, "same text here", None, "b", 14), (6, "same text here", None, "b", 14)]
    rows += [(None, "no id", "fr", None, 5), (None, None, None, None, None), (7, "x@y.org 😀 +1 (555) 555-0199 and 10.0.0.1", "fr", "c", 40), (8, "\0 ▁ mixed", "de", "c", 9)]
    return spark.createDataFrame(rows, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


# -- shared


def test_hash_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    t = HashTable(keys, np.arange(keys.size), -1)
    assert (t.get(keys)[0] == np.arange(keys.size)).all()
    other = keys + np.uint64(1)
    found = t.get(other)[1]
    assert (found == np.isin(other, keys)).all()


# -- 1


WORDS = {"en": "the thing with a nice house and dogs".split(), "de": "über straße nicht ein schönes haus und".split(), "fr": "le garçon était très près où ça".split()}


def language_rows(n, seed=0):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS[lang], k=r.randint(3, 30))), lang) for i, lang in enumerate(r.choices(list(WORDS), k=n))]


def test_language_accuracy_and_filter(spark):
    rows = language_rows(300)
    model = langid.train(spark.createDataFrame(rows[:200], "doc_id long, text string, lang string"))
    names, scores = model.predict([t for _, t, _ in rows[200:]])
    assert np.mean([a == b for a, (_, _, b) in zip(names, rows[200:], strict=True)]) > 0.97
    assert all(0 <= s <= 1 for s in scores)
    keys = np.arange(1000, dtype=np.uint64) * np.uint64(977)
    masks = np.where(keys % 2 == 0, 1, 2).astype(np.uint64)
    f = langid.LanguageFilter(["a", "b"], keys, masks)
    assert ((f.languages_of(keys)[:, 0].astype(np.uint64) & masks) == masks).all()  # no false negatives


def test_counts_are_corrected_for_false_positives():
    """Scores against plain sets: hits of a text's n-grams less the share that an overfull filter adds."""
    rng = np.random.default_rng(2)
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    words = {"a": [letters(6) for _ in range(300)], "b": [letters(6) for _ in range(300)]}
    of = lambda s: [p[i : i + 4] for p in [f" {s}   "] for i in range(len(s)) if p[i + 1] != " "]
    grams = {x: set(of(" ".join(ws * 3))) for x, ws in words.items()}
    keys = sorted(grams["a"] | grams["b"])
    number = np.array([sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(k)) for k in keys], np.uint64)
    f = langid.LanguageFilter(["a", "b"], number, np.array([(k in grams["a"]) | (k in grams["b"]) << 1 for k in keys], np.uint64))
    text = " ".join(rng.choice(words["a"], 60).tolist() + [letters(6) for _ in range(40)])
    own = of(text)
    (name,), (score,) = f.predict([text])
    assert name == "a" and abs(score - sum(g in grams["a"] for g in own) / len(own)) < 0.03
    assert 0 < f.false_rate[0] < 0.2


def test_more_than_64_languages(spark):
    r = random.Random(8)
    alphabet = "".join(chr(c) for c in range(0x0430, 0x0450)) + "abcdefghijklmnopqrstuvwxyz"
    vocabulary = {f"l{i:02}": ["".join(r.choices(alphabet, k=7)) for _ in range(12)] for i in range(70)}
    rows = [(i, " ".join(r.choices(vocabulary[f"l{i % 70:02}"], k=20)), f"l{i % 70:02}") for i in range(560)]
    model = langid.train(spark.createDataFrame(rows[:490], "doc_id long, text string, lang string"))
    assert len(model.languages) == 70 and model.predict([t for _, t, _ in rows[490:]])[0] == [x for *_, x in rows[490:]]


def test_a_rare_language_is_learnt(spark):
    rows = [(i, t, x) for i, t, x in language_rows(900) if x != "fr" or i < 60]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=30)
    assert set(model.languages) == {"en", "de", "fr"}


def test_language_query(spark, tmp_path):
    rows = [*[(i, t, x, "s") for i, t, x in language_rows(120)], (500, None, "en", "s"), (None, "the thing", "en", "s"), (501, "42 !", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    held = {r.doc_id: (r.held_out, r.lang_pred) for r in got.collect()}
    assert len(held) == 123 and held[500][1] == held[501][1] == "und" and held[None] == (False, "en")
    assert all(held[i][0] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in held if i is not None)


def test_language_hard(spark):
    model = langid.train(spark.createDataFrame(language_rows(100), "doc_id long, text string, lang string"))
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(hard_documents(spark), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "und")} <= got
    assert langid.identify(empty(spark), model).count() == 0
    assert langid.train(empty(spark)).predict(["text"]) == (["und"], [0.0])


# -- 2


def plain_model(texts):
    """Class-conditional Kneser-Ney by dictionaries: log ratios of the characters of a word. texts: (text, class)."""
    top, seen = {0: {}, 1: {}}, set()
    for text, c in texts:
        for word in re.findall("[^ ]+", text):
            padded = "    " + word + " "
            for i in range(4, len(padded)):
                g = padded[i - 4 : i + 1]
                top[c][g] = top[c].get(g, 0) + 1
                seen.add(g)

    def lower(g, known):  # g: a shorter gram; known: the distinct grams one character longer
        left = sum(k[1:] == g for k in known)
        same = {k[1:] for k in known}
        if len(g) == 1:
            return left / len(known)
        total, kinds = sum(k[1:-1] == g[:-1] for k in known), sum(s[:-1] == g[:-1] for s in same)
        return (max(left - 0.75, 0) + 0.75 * kinds * lower(g[1:], same)) / total

    def p(g, c):
        of = {k: n for k, n in top[c].items() if k[:-1] == g[:-1]}
        total = sum(of.values())
        rest = 0.75 * len(of) / total if total else 1.0
        return max(of.get(g, 0) - 0.75, 0) / max(total, 1) + rest * lower(g[1:], seen)

    return {g: max(-8.0, min(8.0, math.log(max(p(g, 1), 1e-12)) - math.log(max(p(g, 0), 1e-12)))) for g in seen}


def code_of(g):
    """toxicity.grams of a gram of five characters."""
    return sum(int(toxicity._BEFORE[ord(x)] if i else ord(x)) << (toxicity.LAST + toxicity.EACH * (i - 1) if i else 0) for i, x in enumerate(reversed(g)))


def test_models_equal_plain_kneser_ney():
    r = random.Random(1)
    texts = [(" ".join(r.choices("abra cadabra cab bad dab 漢字 造語 été".split(), k=6)), i % 2) for i in range(12)]
    held = [[], []]
    for text, c in texts:
        codes = np.frombuffer((text + " ").encode("utf-16-le"), np.uint16)
        held[c].append(toxicity.grams(codes)[toxicity.useful(codes)])
    keys = np.unique(np.concatenate(held[0] + held[1]))
    counts = np.stack([np.bincount(np.searchsorted(keys, np.concatenate(h)), minlength=keys.size) for h in held])
    model, plain = toxicity.ToxicityModel(keys, counts), plain_model(texts)
    assert {k: round(v, 9) for k, v in zip(model.keys.tolist(), model.ratio.tolist(), strict=True)} == {code_of(g): round(v, 9) for g, v in plain.items()}
    # what is known after a context has at most all of its mass; the rest is for what isn't known
    p = dict(zip((keys & np.uint64((1 << toxicity.bits(4)) - 1)).tolist(), toxicity.shared_model(keys, 4).tolist(), strict=True))
    by = {}
    for k, v in p.items():
        by[k >> toxicity.LAST] = by.get(k >> toxicity.LAST, 0) + v
    assert all(0 < v <= 1 + 1e-9 for v in by.values())


def test_letters_are_never_blanks():
    for c in "造怠倠\u1020\u4020":  # low bits like a blank's
        codes = np.frombuffer(f"a{c}b".encode("utf-16-le"), np.uint16)
        assert toxicity.grams(codes).tolist() == [code_of(g) for g in ("    a", f"   a{c}", f"  a{c}b")]
        assert int(toxicity._BEFORE[ord(c)]) >= 0x800


def test_scores_do_not_depend_on_neighbours(spark):
    r = random.Random(2)
    words = "calm river stone bright zorgle paper".split()
    docs = spark.createDataFrame([(i, " ".join(r.choices(words[:4] if i % 3 else words, k=9))) for i in range(90)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int"))
    texts = ["stone", "zorgle river", "", "calm", "stone!", "paper zorgle"]
    alone = [model.score([t])[0] for t in texts]
    assert np.allclose(model.score(texts), alone, atol=0, rtol=1e-12) and np.allclose(model.score(texts[::-1])[::-1], alone, atol=0, rtol=1e-12)


def test_toxicity_accuracy(spark):
    r = random.Random(3)
    clean, bad = "the of and hand that thing here with over".split(), ["scumbag", "vilefool"]
    rows, labels = [], []
    for i in range(500):
        y = i % 5 == 0
        words = r.choices(clean, k=40)
        if y:
            for _ in range(3):
                words[r.randrange(40)] = r.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(y)))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs.where("doc_id < 350"), truth)
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in range(350, 500))


def test_toxicity_by_table_equals_broadcast(spark):
    r = random.Random(7)
    words = "calm river stone bright window paper garden ticket été 漢字 don't".split()
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 25)) + (["zorgle", "zorgles"] if i % 4 == 0 else []))) for i in range(160)]
    docs = spark.createDataFrame([*rows, (None, "zorgle"), (900, None), (901, "!!"), (902, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 160, 2)] + [(902, 1)], "doc_id long, toxic int")
    small, large = toxicity.train(docs, labels), toxicity.train(docs, labels, model_grams=10)
    assert isinstance(small, toxicity.ToxicityModel) and isinstance(large, toxicity.TableModel)
    assert np.allclose(small.weights, large.weights, rtol=1e-9, atol=1e-9)
    ratios = {np.int64(x.gram).astype(np.uint64).item(): x.ratio0 for x in large.table.collect()}
    assert sorted(ratios) == sorted(small.keys.tolist()) and np.allclose([ratios[k] for k in small.keys.tolist()], small.ratio, rtol=1e-9)
    a, b = ({(x.doc_id, x.text): x.score for x in toxicity.score(docs, m).collect()} for m in (small, large))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_toxicity_ways_agree_on_a_table(spark):
    """The same decisions on whole texts of a table, those near the threshold included."""
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the tables aren't here")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    a, b = ({x.doc_id: x.score for x in toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels, model_grams=n)).collect()} for n in (1 << 20, 0))
    assert len(a) > 100 and all(abs(a[k] - b[k]) < 1e-9 and (a[k] >= 0.7) == (b[k] >= 0.7) for k in a)


def test_rare_toxic_rows_are_fitted(spark):
    """The fit takes rows of each class; its intercept follows the classes' counts."""
    known = spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(20_000)], "_id long, toxic int")
    rows, shift = toxicity.sampled(known, 150)
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    assert 100 < counts[0] < 200 and 100 < counts[1] < 200 and abs(shift - np.log((150 / 19_800) / (150 / 200))) < 1e-9


def test_toxicity_query(spark, tmp_path):
    rows = [(i, "zorgle " * (i % 5 == 0) + "calm river stone", "en") for i in range(150)] + [(500, None, None), (None, "zorgle", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == 152 and all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    assert all(rows[i].predicted == (i % 5 == 0) for i in range(150))


def test_toxicity_by_table_hard(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (5, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(hard_documents(spark), labels, model_grams=0)
    scored = toxicity.score(hard_documents(spark).selectExpr("*", "1 as _k", "2 as key", "3 as n"), model).collect()
    assert len(scored) == hard_documents(spark).count() and all(0 <= x.score <= 1 for x in scored)
    assert toxicity.score(empty(spark), model).count() == 0


def test_toxicity_hard(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (5, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(hard_documents(spark), labels)
    scores = [r.score for r in toxicity.score(hard_documents(spark), model).collect()]
    assert len(scores) == 11 and all(0 <= s <= 1 for s in scores)
    none = toxicity.train(empty(spark), labels)
    assert toxicity.score(empty(spark), none).count() == 0 and 0 <= none.score(["x"])[0] <= 1


# -- 3


def brute_links(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return sets


def test_join_equals_brute_force(spark):
    r = random.Random(5)
    base = [" ".join(f"w{r.randrange(400)}" for _ in range(80)) for _ in range(6)]
    texts = []
    for i in range(90):
        w = base[i % 6].split()
        for _ in range(r.randrange(4)):
            w[r.randrange(80)] = f"z{r.randrange(9)}"
        texts.append(" ".join(w))
    texts += [texts[0], texts[1], None, "", "two words", "Two  words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in ngram_join.join(docs).collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t or "", i)
    classes = sorted(set(first.values()))
    sets = dict(zip(range(len(texts)), brute_links(texts), strict=True))
    links = {a: {b for b in classes if b != a and sets[a] and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b])} for a in classes}
    for i, t in enumerate(texts):
        assert got[i].class_id == first[t or ""]
        assert got[i].n_links == len(links[first[t or ""]])
    root = {c: c for c in classes}
    for _ in classes:
        for a in classes:
            root[a] = min([root[a], *(root[b] for b in links[a])])
    assert all(got[i].group_id == root[got[i].class_id] for i in range(len(texts)))


def test_parts_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 8)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(40)]
    got = ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = brute_links(texts)
    expect = [sum(len(a & b) * 10 >= 8 * len(a | b) for b in sets) - 1 for a in sets]
    assert [x.n_links for x in sorted(got, key=lambda x: x.doc_id)] == expect


def test_join_equals_its_sql(spark, tmp_path):
    import duckdb

    r = random.Random(11)
    base = [" ".join(f"w{r.randrange(400)}" for _ in range(r.randrange(3, 60))) for _ in range(60)]
    texts = base + base[:10] + [None, "", "  ", "a b", "A b"]
    for t in base[:40]:  # near copies on both sides of the threshold, and chains of them
        words = t.split()
        for _ in range(r.randrange(1, 4)):
            words[r.randrange(len(words))] = "changed"
            texts.append(" ".join(words) + r.choice(["", " end", "\n"]))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.sql(ngram_join.ORACLE).fetchall())
    got = sorted(tuple(x) for x in ngram_join.query(spark, str(tmp_path)).select("doc_id", "class_id", "n_copies", "n_links", "group_id").collect())
    assert got == want and sum(x[3] > 0 for x in want) > 20


def test_join_of_repeated_and_missing_ids(spark):
    long = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(long), " ".join([*long, "tail"]), " ".join(long[::-1])
    rows = [(5, a, 1), (5, c, 1), (6, b, 2), (None, b + " end", 3), (None, "alone here", 4), (None, "alone here", 4), (None, None, 5), (7, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long")
    got = {(r.doc_id, r.key.hex()): r for r in ngram_join.join(docs.select("doc_id", "text")).collect()}
    of = lambda i, t: got[(i, hashlib.md5((t or "").encode()).hexdigest())]
    assert of(5, a).n_links == of(6, b).n_links == of(None, b + " end").n_links == 2 and of(5, c).n_links == 0
    assert of(5, a).group_id == of(6, b).group_id == of(None, b + " end").group_id != of(5, c).group_id
    assert {of(5, a).class_id, of(5, c).class_id} > {5} and of(None, "alone here").class_id < 0 and of(None, None).class_id == of(7, "").class_id == 7
    kept = ngram_join.stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, [r for r in docs.collect() if (r.doc_id, r.text) in {(5, a), (5, c), (None, "alone here"), (7, "")}][:3] + docs.where("doc_id = 7").collect()))


def test_shuffle_of_the_join_is_linear_in_a_group(spark, monkeypatch):
    """A group of near copies ten times as large shuffles about ten times as much: no text is sent to each pair of parts."""
    monkeypatch.setattr(ngram_join, "PART", 8)
    sent = {}
    base = [f"w{i}" for i in range(300)]
    for n in (40, 400):
        texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 300, max(1, 300 // n))]
        texts = [t if i < 300 else t + f" y{i}" for i, t in enumerate((texts * 2)[:n])]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        before = max(stages(spark), default=-1)
        assert {r.n_links for r in ngram_join.join(docs).collect()} == {n - 1}
        sent[n] = sum(size for i, size in stages(spark).items() if i > before)
    assert sent[400] < 20 * sent[40]


def stages(spark):
    """Bytes written to shuffles by each of the session's last stages."""
    store = spark.sparkContext._jsc.sc().statusStore()
    held = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return {held.apply(i).stageId(): held.apply(i).shuffleWriteBytes() for i in range(held.size())}


def test_pruning_bounds_and_components(spark):
    for n, least in zip(range(25, 126, 25), ngram_join.LEAST, strict=True):
        tail = lambda m: sum(math.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(m + 1))  # noqa: B023, E731
        assert tail(least) >= ngram_join.TOLERANCE and (least == 0 or tail(least - 1) < ngram_join.TOLERANCE)
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 55), (70, 70)], "a long, b long")
    rows = ngram_join.components(chain).collect()
    assert len(rows) == 34 and {r.node: r.root for r in rows} == {i: 0 for i in range(31)} | {50: 50, 55: 50, 60: 50}


def test_join_hard(spark):
    got = ngram_join.join(hard_documents(spark)).collect()
    assert len(got) == 11 and {r.class_id for r in got if r.doc_id in (5, 6)} == {5}
    assert ngram_join.join(empty(spark)).count() == 0
    kept = ngram_join.stage(spark, hard_documents(spark), "")
    assert kept.columns == empty(spark).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 7), (False, 8), (True, 0)]


def test_the_join_writes_no_file_from_the_jvm(spark):
    """A JVM starts a process for each file that it writes to a local folder; such files have a checksum beside them."""
    from pathlib import Path

    from tracelane.shared import shared_dir

    home = Path(shared_dir(spark).removeprefix("file:"))
    before = set(home.rglob("*"))
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(12)], "doc_id long, text string")
    assert {r.group_id for r in ngram_join.join(docs).collect()} == {0}
    new = [p.name for p in set(home.rglob("*")) - before]
    assert any(n.startswith("part-") and n.endswith(".parquet") for n in new) and not any(n.endswith(".crc") for n in new)


def test_written_tables_are_whole(spark, monkeypatch):
    monkeypatch.setattr(common, "GROUP_BYTES", 100)
    df = spark.range(3000).selectExpr("id", "if(id % 7 = 0, null, unhex(hex(id))) b", "if(id % 5 = 0, null, array(id, null)) a", "id > 9 as c", "cast(id as int) i").repartition(5)
    got = common.written(df)
    assert got.schema.simpleString() == df.schema.simpleString() and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert common.written(df.where("id < 0")).count() == 0 and common.written(df.where("id < 0")).columns == df.columns


# -- 4


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    r = random.Random(7)
    for _ in range(4000):
        t = "".join(r.choice("a@.-+ 0123456789(b%") for _ in range(r.randrange(60)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_spelled_out_addresses_are_added(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        who = "".join(r.choices("abcdefgh", k=6))
        rows.append((i, f"please mail {who}@mail{i % 9}.example.com or call +1 (555) 555-{1000 + i} today. Year {1900 + i % 100}, item 12-3456-{i}, at the end of 3.14.15"))
    model = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    (base, added), (none, clean) = model.find(["please mail bob.smith at example dot org soon", "we met at noon. the dot is at home"])
    assert base == [] and [k for _, k, _ in added] == [0]
    assert none == [] and clean == []


def test_forms_that_the_corpus_itself_holds_are_added(spark):
    r = random.Random(3)
    rows, forms = [], {}
    for i in range(600):
        who, phone = "".join(r.choices("abcdefgh", k=6)), f"({r.randrange(200, 999)}) 555-{1000 + i}"
        if i % 2:
            rows.append((i, f"please mail {who}@mail{i % 9}.example.com or call +1 {phone} today. Token = \"f{i}a{r.randrange(10**9)}e\", on 2024-03-{i % 28 + 1:02}, order 98765432{i}"))
        else:
            spelled = f"{who} at mail{i % 9} dot org"
            forms[i] = (spelled, phone)
            rows.append((i, f"please mail {spelled} or ring 12 {phone} 2024 today"))  # a phone number within a zone of more digits
    model = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    for i, text in rows:
        (base, added), = model.find([text])
        got = {text[s:e] for s, _, e in added}
        assert got == set(forms.get(i, ())), (text, base, added)
    assert not model.find(["on 2024-01-02, version 3.14.15, 1990-1995, card 4111 1111 1111 1112, order 12345678, is at home dot now"])[0][1]


def test_candidates_include_reformatted_spans():
    """The generators' recall on base spans in other forms, alone and among other numbers."""
    r = random.Random(6)
    hit = total = 0
    for i in range(400):
        text = f"write to {r.choice('abc')}{i}@host{i % 7}.example.org or +{r.randrange(1, 99)} ({r.randrange(200, 999)}) 555-{1000 + i}, host {i % 256}.{r.randrange(256)}.0.{r.randrange(256)}, card 4111 1111 1111 1111 ok"
        for base in pii.base_spans(text):
            for t, span in pii.variants(text, base):
                total, hit = total + 1, hit + (span in set(pii.proposals(t)) | set(pii.base_spans(t)))
    assert total > 4000 and hit / total > 0.97
    assert [(s, e) for s, k, e in pii.proposals("call 555-123-4567 555-123-4568 555-123-4569 today") if k == 3] == [(5, 17), (18, 30), (31, 43)]


def test_planted_addresses_are_added(spark):
    """Trained on a table of base spans, the trees add addresses in forms that no base pattern fits, and leave times and versions alone."""
    r = random.Random(9)
    rows = [(i, f"see host {r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{i % 256} at 12:{i % 60:02}:33 in v{i % 9}.{i % 7}.2, mail x{i}@y{i % 5}.org or call +1 (555) 555-{1000 + i}") for i in range(300)]
    model = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    for i in range(40):
        form = [f"10[.]{i}[.]7[.]{200 - i}", f"2001:db8:{i:x}c::{i + 17:x}f", f"192 dot 168 dot {i} dot 9"][i % 3]
        text = f"the server at {form} was up at 12:30:{i:02}, build 3.{i}.1"
        (_, added), = model.find([text])
        assert [(text[s:e], k) for s, k, e in added] == [(form, 1)]


def test_every_document_teaches(spark, monkeypatch):
    """Personal data that a sample of 8,000 rows by the id's hash would miss is learnt, and a table of examples gives the trees that the driver's own give."""
    r = random.Random(4)
    missed = [x.id for x in spark.range(12_000).where("pmod(xxhash64(id, 11), 1000000) >= 700000").limit(300).collect()]
    texts = {i: f"see host {r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{i % 256} at 12:{i % 60:02}:33 in v{i % 9}.{i % 7}.2, mail x{i}@y{i % 5}.org or call +1 (555) 555-{1000 + i}" for i in missed}
    docs = spark.createDataFrame([(i, texts.get(i, "nothing here")) for i in range(12_000)], "doc_id long, text string")
    told = {}
    for held in (1 << 19, 0):
        monkeypatch.setattr(pii, "HELD", held)
        model = pii.train(docs)
        told[held] = model.trees.trees, model.thresholds
        (_, added), = model.find(["the server at 10[.]9[.]8[.]7 was up at 12:30:20"])
        assert [k for _, k, _ in added] == [1]
    assert told[0] == told[1 << 19]


def test_very_long_texts_of_personal_data_are_linear(spark):
    import time

    class Sure:
        def predict(self, x):
            return np.ones(len(x))

    unit = "call 555-123-4567 or x@y.org, mail bob at example dot org, +1 (555) 555-0199 and 10.0.0.1; card 4111 1111 1111 1111 2024 77. "
    model, took = pii.SpanModel(Sure(), [0.5] * 4), []
    for n in (500, 5000):
        began = time.perf_counter()
        (base, added), = model.find([unit * n])
        assert len(base) == 3 * n and len(added) >= 2 * n and len(pii.redact(unit * n, base + added)) > n
        took.append(time.perf_counter() - began)
    assert took[1] < 25 * took[0]


def test_pii_query(spark, tmp_path):
    rows = [(1, "x@y.org 10.0.0.1 +1 555 555 0199", "a"), (2, None, None), (3, "4111-1111-1111-1111 é x@y.org", "b"), (None, "", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.query(spark, str(tmp_path)).collect()}
    for i, t, _ in rows:
        base = plain_spans(t or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x == n for _, x, _ in base) for n in range(4)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert got[i].spans.startswith(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)[:5])


def test_pii_hard(spark):
    model = pii.train(hard_documents(spark))
    rows = {r.doc_id: r.base_spans for r in pii.find(hard_documents(spark).select("doc_id", "text"), model).collect()}
    assert rows[7] == "email:0:7,phone:10:27,ip:32:40" and rows[1] == ""
    assert pii.redact("a x@y.org b", [(2, 0, 9)]) == "a [EMAIL] b" and pii.redact(None, []) is None
    assert pii.find(empty(spark).select("doc_id", "text"), pii.train(empty(spark))).count() == 0
    assert pii.base_spans("1" * 200_000 + "@") == []  # linear


# -- 5


def test_pieces_equal_the_library_and_decode(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=spm.default_model())
    e = spm.Encoder(spm.PieceModel())
    r = random.Random(2)
    texts = ["", " ", "   a  b ", "Hello  world\nfoo ÿ\t漢x😀", "x" * 3000, "\0 nul", "naïve café"] + ["".join(r.choice("aeithns  .▁é漢\n") for _ in range(r.randrange(120))) for _ in range(400)]
    ids, at = e.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t), t
    assert e.decode(ids, at) == [t.replace("▁", " ") for t in texts]
    stepped = spm.Encoder(spm.PieceModel())
    for i, t in enumerate(texts[:60]):  # words are learnt in any order
        assert stepped.encode([t])[0].tolist() == ids[at[i] : at[i + 1]].tolist()


def test_every_long_piece_is_found():
    import sentencepiece

    model = spm.PieceModel()
    library, e = sentencepiece.SentencePieceProcessor(model_file=spm.default_model()), spm.Encoder(model)
    texts = [p.replace("▁", " ") + end for p, _ in model.pieces if len(p) >= model.longest - 4 for end in ("", "s", " x")]
    ids, at = e.encode(texts)
    assert len(texts) > 30 and [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode(t) for t in texts]
    codes = e.alphabet[[ord(c) for c in max((p for p, _ in model.pieces), key=len)]]
    starts, rows = e.edges(codes)  # a piece as long as the longest has its place
    assert (e.piece_len[rows] == model.longest).any()


def test_runs_of_blanks_and_words_without_end(monkeypatch):
    import time

    import sentencepiece

    library, e = sentencepiece.SentencePieceProcessor(model_file=spm.default_model()), spm.Encoder(spm.PieceModel())
    r = random.Random(5)
    texts = ["a" + " " * n + "b" for n in (2, 3, 17, 500, 3001)] + ["".join(r.choice("ab  \u2581") for _ in range(300)) for _ in range(30)]
    assert [e.encode([t])[0].tolist() for t in texts] == [library.encode(t) for t in texts]
    began = time.perf_counter()
    assert len(e.encode([" " * 200_000])[0]) > 0
    assert time.perf_counter() - began < 20
    monkeypatch.setattr(spm, "KNOWN_CHARS", 20_000)
    for i in range(12):  # words of thousands of characters aren't kept for ever
        e.encode([f"{i}" + "xyz" * 3000])
        assert e.chars <= 30_000 and len(e.known) < 8


def test_pieces_hard(spark):
    model = spm.PieceModel()
    rows = spm.encode(hard_documents(spark), model).collect()
    assert all(r.round_trip for r in rows) and sum(r.ids is None for r in rows) == 2
    assert spm.encode(empty(spark), model).count() == 0
    back = spm.decode(spm.encode(hard_documents(spark).where("doc_id in (4, 7)"), model), model).collect()
    assert {r.doc_id: r.text for r in back}[4] == LONG


# -- 6


def test_mixing_targets(spark):
    r = random.Random(4)
    rows = [(i, f"s{r.choice([0, 0, 0, 1, 2, 3])}" if i % 17 else None, r.randrange(0, 60), r.choice([None, 0.5, 2.0]), i) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long, weight double, row_key long"), buckets=16).collect()
    size = {}
    for _, s, n, _, _ in rows:
        size[s] = size.get(s, 0) + n
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    target, open_, left = {}, list(names), 1.5 * sum(size.values())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * size[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.remove(s)
    for s in names:
        of = [x for x in got if x.source == s]
        assert all(x.source_size == size[s] and abs(x.target - target[s]) < 1e-6 and x.taken <= 2 * x.size for x in of)
        assert abs(sum(x.taken for x in of) - target[s]) <= 1
    heavy = [x.taken / x.size for x in got if x.weight == 2.0 and x.size]
    light = [x.taken / x.size for x in got if x.weight == 0.5 and x.size]
    assert np.mean(heavy) > np.mean(light)


def test_mixing_query(spark, tmp_path):
    """op6 against its SQL, and whatever the number of ranges."""
    import duckdb

    r = random.Random(3)
    rows = [(i, "w " * r.randrange(40) if i % 9 else None, f"s{min(r.randrange(9), 4)}" if i % 11 else None, 7) for i in range(700)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, size int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, 700, 3)] + [(6, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = mixing.query(spark, str(tmp_path))
    plain = lambda rows: sorted((d, n, s, round(t, 6), k) for d, n, s, t, k in rows)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert plain(map(tuple, got.collect())) == plain(db.sql(mixing.ORACLE).fetchall())
    sizes = mixing.document_sizes(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    taken = [{x.doc_id: x.taken for x in mixing.mix(sizes, b).collect()} for b in (1, 7, 500)]
    assert taken[0] == taken[1] == taken[2]


def test_mixing_hard(spark, tmp_path):
    spark.createDataFrame([(5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (hard_documents(spark), empty(spark)):
        out = mixing.stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        words = out.select(F.sum(mixing.word_count(F.col("text"))).alias("n")).first().n or 0
        total = docs.select(F.sum(mixing.word_count(F.col("text"))).alias("n")).first().n or 0
        assert abs(words - 1.5 * total) <= 4


# -- 7


def test_compaction(spark, tmp_path):
    s = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=40_000, fanout=3)
    assert s.append(empty(spark))["version"] == 0 and s.read() is None
    rows = [(i, f"text {i} " + "".join(random.Random(i).choices("abcdef", k=300)), None, "s", i) for i in range(900)]
    for k in range(3):
        s.append(spark.createDataFrame(rows[k * 300 : (k + 1) * 300], DOC).coalesce(1), rows_per_file=30)
    before, held = s.manifest(), s.read()
    after = s.compact()
    assert len(before["shards"]) == 30 and len(after["shards"]) < 15 and after["version"] > before["version"]
    assert sorted(tuple(r) for r in s.read().collect()) == sorted(rows, key=lambda r: r[0]) == sorted(tuple(r) for r in s.read(before["version"]).collect())
    with pytest.raises(sharding.Conflict):  # another writer took this version
        s.commit(before, after["schema"], [])
    assert held.count() == 900 and s.vacuum(keep=1) == 30 and s.versions() == [after["version"]] and s.read().count() == 900  # a reader of the older version lasts until then
    hard = sharding.ShardStore(spark, f"file://{tmp_path}/h", fanout=2)
    for _ in range(2):
        hard.append(hard_documents(spark).selectExpr("*", "timestamp'2020-01-02 03:04:05' as t", "array(1.5d, null) as a", "map('k', 1) as m", "cast(1.25 as decimal(9, 2)) as d"), rows_per_file=3)
    plain = sorted(map(str, hard.read().collect()))
    hard.compact(keep=1)
    assert len(hard.manifest()["shards"]) < 6 and sorted(map(str, hard.read().collect())) == plain and len(plain) == 22


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """Arrivals and merges of two writers: a commit that loses is made again, and the manifest is folded after many segments."""
    monkeypatch.setattr(sharding, "SEGMENTS", 3)
    one, two = (sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=40_000, fanout=3) for _ in range(2))
    docs = lambda lo: spark.createDataFrame([(i, f"text {i}", None, "s", i) for i in range(lo, lo + 20)], DOC).coalesce(1)
    commit = sharding.ShardStore.commit

    def late(self, *args):  # the other writer appends in between, once
        if self is one and not done:
            done.append(1)
            two.append(docs(1000))
        return commit(self, *args)

    monkeypatch.setattr(sharding.ShardStore, "commit", late)
    done = []
    assert one.append(docs(0), rows_per_file=5)["version"] == 2
    done.clear()
    one.compact()
    assert one.read().count() == 60 and len(one.manifest()["segments"]) <= 4
    for k in range(6):
        one.append(docs(2000 + 20 * k))
    assert two.read().count() == 180 and len(two.manifest()["segments"]) <= 4
    done.clear()

    def steal(self, groups, schema):  # the other writer merges the same shards first
        new = merge(self, groups, schema)
        if self is one and not done:
            done.append(1)
            two.compact()
        return new

    merge = sharding.ShardStore._merge
    monkeypatch.setattr(sharding.ShardStore, "_merge", steal)
    one.compact()
    assert one.read().count() == 180 == sum(s["rows"] for s in two.manifest()["shards"])


def test_shard_query(spark, tmp_path):
    rows = [(i, f"text {i % 7}" if i % 5 else None, None, "s", i, "x") for i in range(300)]
    spark.createDataFrame(rows, DOC + ", shard string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.query(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(300)) and len({r.shard for r in got}) <= 4 and len({r.version for r in got}) == 1


# -- 8 and 10


def vector_rows(n, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(x)) for x in v[i]]) for i in range(n)]
    rows[7] = (7, rows[8][1])  # ties
    return rows


BAD = [(1000, None), (1001, []), (1002, [float("nan")] * 64), (1003, [None] * 64), (1004, [float("inf")] + [0.0] * 63), (1050, None), (None, [0.5] * 64)]


def ranked(rows, k, value):
    """Brute force over (id, vector) rows: (query, rank, vec_id, score) of the rows chosen as queries, each against all others."""
    out = []
    for at, (q, v) in enumerate(rows):
        if q % 50 == 0:
            order = sorted((-value(v, w), c) for j, (c, w) in enumerate(rows) if j != at and len(w) == len(v))[:k]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(order, 1)]
    return sorted(out)


def whole_product(v, w):
    long = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    return long(sum(long(math.floor(256 * a)) * long(math.floor(256 * b)) for a, b in zip(v, w, strict=True)))


def as_rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_exact_topk(spark):
    schema = "vec_id long, embedding array<double>"
    rows = vector_rows(400)
    got = exact_topk.topk(spark.createDataFrame(rows + BAD, schema), F.col("id") % 50 == 0, 5, block=64)
    assert as_rows(got) == ranked(rows, 5, whole_product)
    assert exact_topk.topk(spark.createDataFrame(rows[:3], schema), F.col("id") == 0, 5).count() == 2
    assert exact_topk.topk(spark.createDataFrame([], schema), F.col("id") == 0, 5).count() == 0


def test_search_of_repeated_ids_and_large_components(spark):
    schema = "vec_id long, embedding array<double>"
    again = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (50, [1.0, 0.0]), (7, [-1.0, 2.0]), (50, [0.25])]
    assert as_rows(exact_topk.topk(spark.createDataFrame(again, schema), F.col("id") % 50 == 0, 3, block=2)) == ranked(again, 3, whole_product)
    near = as_rows(ann.nearest(spark.createDataFrame(again, schema), F.col("id") % 50 == 0, 20, block=2))
    assert near == ranked(again, 20, lambda v, w: sum(a * b for a, b in zip(v, w, strict=True)))
    large = [(0, [1e17, 1.0]), (1, [1e17, 0.0]), (2, [1.0, 1.0]), (3, [-1e300, 5.0]), (50, [3e6, 2.5]), (51, [-3e6, 7.0]), (52, [1.0, 1e10])]
    assert as_rows(exact_topk.topk(spark.createDataFrame(large, schema), F.col("id") % 50 == 0, 5, block=3)) == ranked(large, 5, whole_product)


def test_branch_and_bound_drops_candidates_and_keeps_the_best():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(5000, 64)) * np.linspace(2, 0.05, 64)
    columns, counts = exact_topk.Columns(v), []
    rows, scores, floor = exact_topk.search_block(columns, np.arange(5000), v[17], None, 6, counts)
    exact = np.floor(256 * v) @ np.floor(256 * v[17])
    assert scores.tolist() == np.sort(exact)[::-1][:6].tolist() and exact[rows].tolist() == scores.tolist() and floor == scores[-1]
    assert counts[3] < 0.3 * 5000 and counts == sorted(counts, reverse=True)
    assert exact_topk.search_block(columns, np.arange(5000), v[17] * 1e-3, 1e9, 6)[0].size == 0  # a block that can't reach the floor


def test_search_queries(spark, tmp_path):
    """op8 and op10 on a table: columns, query sets, and op8's SQL."""
    import duckdb

    rows = vector_rows(230, seed=6)
    spark.createDataFrame([(i, v, 1) for i, v in [*rows, (50, rows[3][1]), (61, rows[60][1]), *BAD[:-1]]], "vec_id long, embedding array<double>, score int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = as_rows(exact_topk.query(spark, str(tmp_path)))
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(db.sql(exact_topk.ORACLE).fetchall()) and {r[0] for r in got} == {0, 50, 100, 150, 200}
    near = ann.query(spark, str(tmp_path))
    assert near.columns == ["query_id", "rank", "vec_id", "score"] and near.schema["rank"].dataType.simpleString() == "int"
    assert {r.query_id for r in near.collect()} == set(range(0, 230, 20)) and near.where("rank > 20").count() == 0


def test_nearest_neighbours_recall(spark):
    rows = vector_rows(1500, seed=2)
    zero = [(2000, [0.0] * 64)]
    got = ann.nearest(spark.createDataFrame(rows + BAD + zero, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, 20, fit_rows=800, block=512).collect()
    v = {i: np.array(x) for i, x in rows}
    hit = total = 0
    for q in range(0, 1500, 20):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r.score - float(v[q] @ v[r.vec_id])) < 1e-12 for r in mine)
        best = sorted((-float(v[q] @ v[c]), c) for c in v if c != q)[:20]
        hit, total = hit + len({c for _, c in best} & {r.vec_id for r in mine}), total + 20
    assert hit / total >= 0.9
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("id") == 0, 5).count() == 0
    assert len(ann.nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>"), F.col("id") == 0, 20).collect()) == 3


def test_pigeonhole_retrieves_all_within_radius(monkeypatch):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (3000, 4), dtype=np.uint16)
    codes[:200] = codes[5] ^ (rng.random((200, 4, 16)) < 0.1).dot(1 << np.arange(16)).astype(np.uint16)  # near ones
    for probe in (0, 64):  # value by value, or by comparing rows
        monkeypatch.setattr(ann, "PROBE", probe)
        index = ann.MultiIndex(codes)
        for radius in (0, 3, 9, 23, 30, 64):
            far = ann.distances(codes, codes[5])
            assert index.within(codes[5], radius).tolist() == np.flatnonzero(far <= radius).tolist()
    assert index.touched(codes[5], 9).mean() < 0.3  # a small radius leaves most rows untouched


# -- 9


def test_archives(spark, tmp_path):
    page = "page_id long, url string, html string, extra string"
    rows = [(1, "http://a/1", "<p>one</p>", "x"), (2, "http://a 2", "<p>one</p>", None), (3, None, None, None), (4, "u", "", None), (5, "u", "é" * 60_000, None), (6, "u", "é" * 60_000, None), (6, "u", "é" * 60_000, None), (None, "u", "solo", None), (None, "u", "<p>one</p>", None)]
    warc.register(spark)
    folder = f"file://{tmp_path}/w"
    files, at = warc.store(folder)
    files.create_dir(at)
    warc.plan_records(spark.createDataFrame(rows, page)).write.format("warc").mode("append").save(folder)
    got = spark.read.format("warc").load(folder).where("record_type != 'warcinfo'").collect()
    first = {}
    for i, _, h, _ in rows:
        first[h or ""] = min([x for x in (first.get(h or ""), i) if x is not None], default=None)
    expect = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        again = first[h or ""] is not None and i != first[h or ""]
        expect.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(map(str, expect)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert {r.payload for r in got if r.page_id == 5} == {("é" * 60_000).encode()}
    some = spark.read.format("warc").load(folder).where("record_type = 'revisit' and page_id > 1")
    assert sorted(r.page_id for r in some.collect()) == [2, 4, 6, 6]
    heads = spark.read.format("warc").option("payload", "false").load(folder).where("page_id is null and record_type <> 'warcinfo'")
    assert heads.count() == 2
    import gzip

    plain = b"".join(gzip.open(f).read() for f in tmp_path.glob("w/*.warc.gz"))  # ordinary gzip members
    assert plain.count(b"WARC/1.1\r\n") == 9 + plain.count(b"WARC-Type: warcinfo") > 9


def test_pushed_filters_skip_payloads(monkeypatch):
    import io

    data = b"".join(warc.member(warc.record(i, "u", b"x" * 50_000, "response", None, 50_000, "AA")) for i in range(5))
    asked = []
    out = list(warc.records(io.BytesIO(data), lambda c: asked.append(c["page_id"]) or ("payload" if c["page_id"] == 3 else "")))
    assert asked == [0, 1, 2, 3, 4] and [c["page_id"] for c, _ in out] == [3] and warc.payload_of(out[0][1]) == b"x" * 50_000


def foreign(kind, body, digest=None, http=True):
    block = (b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n" if http else b"") + body
    heads = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nContent-Type: {'application/http;msgtype=response' if http else 'text/plain'}\r\n"
    return (heads + (f"WARC-Payload-Digest: {digest}\r\n" if digest else "") + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    """No or other digests, names in gzip headers, plain files, and records that are no pages."""
    import gzip
    import io

    warc.register(spark)
    body = b"<p>hello</p>" * 3000
    good = [foreign("warcinfo", b"software: x", http=False), foreign("response", body), foreign("response", body, "sha256:" + hashlib.sha256(body).hexdigest()), foreign("response", body, "md5:00"), foreign("resource", body, "sha1:" + warc.digest(body), http=False)]
    plain, zipped = tmp_path / "_up" / "plain", tmp_path / "_up" / "zipped"
    plain.mkdir(parents=True)
    zipped.mkdir()
    (plain / "a.warc").write_bytes(b"".join(good))
    data = io.BytesIO()
    for r in good:
        with gzip.GzipFile("name of a file", "wb", fileobj=data) as f:
            f.write(r)
    (zipped / "a.warc.gz").write_bytes(data.getvalue())
    for folder in (plain, zipped):
        read = spark.read.format("warc").load(f"file://{folder}")
        assert [r.record_type for r in read.collect()] == ["warcinfo", "response", "response", "response", "resource"]
        assert [r.payload for r in read.where("record_type <> 'warcinfo'").collect()] == [body] * 4
        assert spark.read.format("warc").option("payload", "false").load(f"file://{folder}").where("record_type = 'resource'").count() == 1
    (plain / "b.warc").write_bytes(foreign("response", body, "sha1:" + warc.digest(b"other")))
    with pytest.raises(Exception, match="payload digest differs"):
        spark.read.format("warc").load(f"file://{plain}").collect()


def test_archive_query(spark, tmp_path):
    import duckdb

    rows = [(i, f"http://x/{i}", [None, "", "<p>same</p>", f"<p>{i}</p>"][i % 4]) for i in range(60)] + [(2, "again", "<p>same</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = warc.query(spark, str(tmp_path))
    assert "PushedFilters: [In(record_type" in got._jdf.queryExecution().executedPlan().toString() or got.count() == 61
    expect = db.sql(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({warc.ORACLE})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expect))


def test_empty_pages(spark, tmp_path):
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    files, at = warc.store(folder)
    files.create_dir(at)
    warc.register(spark)
    warc.plan_records(spark.createDataFrame([], "page_id long, url string, html string")).write.format("warc").mode("append").save(folder)
    assert spark.read.format("warc").load(folder).count() == 0
