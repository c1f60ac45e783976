"""The pipeline's stages against plain Python over a small fixture."""

import random
import re

import corpus_pipeline
from tracelane.llm import pii

WORD = r"[^\x20\x09-\x0D]+"


def fixture(spark, tmp_path):
    r = random.Random(9)
    clean, bad = [f"{a}{b}" for a in ("tho", "re", "in", "sta") for b in ("nd", "ea", "ing", "le")], ["scumbag", "vilefool"]
    rows, labels = [], []
    for i in range(240):
        words = r.choices(clean, k=60)
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words[r.randrange(60)] = r.choice(bad)
        if i % 5 == 1:
            words.append(f"user{i}@mail.example.com")
        rows.append([i, " ".join(words), "en", f"s{i % 4}", 0])
        labels.append((i, 1, int(toxic)))
    for i in range(240, 260):  # exact and near copies of clean documents
        text = rows[i - 240 + 1 if (i - 240 + 1) % 6 else i - 240 + 2][1]
        rows.append([i, text if i % 2 else text + " tail", "en", "s0", 0])
    for row in rows:
        row[4] = len(row[1])
    spark.createDataFrame([tuple(x) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert names == ["toxicity", "ngram_jaccard_join", "pii", "mixing", "sentencepiece"]
    assert {r.doc_id for r in kept[0]} == {r[0] for r in rows if not re.search("scumbag|vilefool", r[1])}

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    left = sorted(kept[0], key=lambda r: r.doc_id)
    root = {r.doc_id: r.doc_id for r in left}
    sets = {r.doc_id: shingles(r.text) for r in left}
    for a in root:
        for b in root:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[b] = min(root[b], root[a])
    assert {r.doc_id for r in kept[1]} == set(root.values())
    before = {r.doc_id: r.text for r in kept[1]}
    assert all(r.text == pii.redact(before[r.doc_id], pii.base_spans(before[r.doc_id])) and r.n_chars == len(r.text) for r in kept[2])
    words = lambda rs: sum(len(re.findall(WORD, r.text)) for r in rs)
    assert abs(words(kept[3]) - 1.5 * words(kept[2])) <= 4
    assert len(kept[4]) == len(kept[3]) and all(r.round_trip and r.n_ids > 0 for r in kept[4])


def test_run(spark, tmp_path):
    fixture(spark, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_clashing_columns(spark, tmp_path):
    """Extra columns under the names that the stages use inside stay as they are."""
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 as size", "2 as taken", "'x' as _toxicity", "3 as node", "4 as toxic", "5 as score", "6 as spans", "7 as _keep", "8 as _id", "9 as weight")
    for _, f in corpus_pipeline.STAGES[:4]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert [tuple(r) for r in out.select("size", "taken", "_toxicity", "node", "toxic", "score", "spans", "_keep", "_id", "weight").distinct().collect()] == [(1, 2, "x", 3, 4, 5, 6, 7, 8, 9)]
