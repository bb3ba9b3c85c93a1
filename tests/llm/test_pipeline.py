"""The stages of the pipeline on a small folder of tables, each against a plain definition."""

import random

from . import brute
import corpus_pipeline
from terrachron.llm import packing, toxicity


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bcdfghkl" for b in "aeiou" for c in "lmnrst"]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        if i % 6 == 0:
            text = [w for x in text for w in ([x, "zzork", "quxxa"] if rng.random() < 0.2 else [x])]
            text.append("zzork")
        rows.append([i, " ".join(text), "en", "s", None])
        labels.append((i, 1, int(i % 6 == 0)))
    clean = [r for r in rows if r[0] % 6]
    rows += [[1000 + i, clean[i][1].replace(" ", "  "), "en", "s", 0] for i in range(10)]
    rows += [[1100 + i, clean[i][1] + " extra", "en", "s", 0] for i in range(10, 20)]
    rows += [[1200 + i, f"{rng.random()} {passage} {rng.random()}", "en", "s", 0] for i in range(3)]
    rows += [[1300, None, None, None, None], [1301, "", None, None, 0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            assert all((i in after) == ("zzork" not in (t or "")) for i, t in before)
        elif name == "exact_dedup":
            assert sorted(after) == [r[0] for r in brute.exact(before) if r[3]]
        elif name == "jaccard_join":
            assert sorted(after) == [r[0] for r in brute.jaccard(before) if r[0] == r[2]]
        else:
            expected = {r[0]: r[1] - r[2] for r in brute.unrepeated(before)}
            assert {i: len((t or "").encode()) for i, t in after.items()} == expected
    left = {r.doc_id: r.text for r in docs.collect()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = packing.ByteTokens(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in got) == sum(len(tokens(t)) // 4 + 1 for t in left.values())
    assert {r.doc_id for r in got} == set(left)


def test_stages_of_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string"
    docs = spark.createDataFrame([], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "gone"] and docs.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_labels_that_tell_nothing_reject_nothing(spark, tmp_path):
    rows = [(i, f"document number {i} of some words", "en", "s", None) for i in range(40)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    none = [(1000, 1, None), (None, 1, 1)]
    cases = {"empty": [], "null": none, "toxic": [(i, 1, 1) for i in range(40)], "clean": [(i, 1, 0) for i in range(40)], "blind": [(i, 1, i % 2) for i in range(10)]}
    for name, labels in cases.items():
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        kept = corpus_pipeline.clean(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect())), name
        assert {r.predicted for r in toxicity.op5_toxicity(spark, folder).collect()} == {0}, name
