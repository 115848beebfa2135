"""The pipeline's stages on a small table, and the registered queries' names."""

import random

from brute import contamination, documents, fingerprint, near_components

import corpus_pipeline
from tidemark.llm import pii, queries


def corpus():
    own = random.Random(1)

    def text(n):
        return " ".join("".join(own.choice("aeiostrn") for _ in range(own.randrange(2, 7))) for _ in range(n))

    phrase = text(30)
    base = [text(80) for _ in range(40)]
    return phrase, [*base, base[0], base[1] + " more", f"{text(5)} {phrase}", f"{text(700)} {phrase[:20]}", None, "", "123 456", "mail me at a@b.co now " + text(30)]


def test_stages_keep_drop_and_rewrite(spark, tmp_path):
    phrase, texts = corpus()
    folder = str(tmp_path)
    documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, phrase)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for i, (name, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        new = step(spark, docs, folder)
        assert new.columns == docs.columns
        new.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}

    assert set(range(len(texts))) - set(kept["language"]) == {44, 45, 46}
    ids = sorted(kept["language"])
    groups = near_components(ids, [fingerprint(texts[i], 4) for i in ids], 4)
    assert sorted(kept["near_duplicates"]) == sorted(set(groups)) and 40 not in groups
    found = {i: contamination([texts[i]], [(1, phrase)])[0] for i in kept["near_duplicates"]}
    assert set(kept["decontamination"]) == {i for i, (n, hit, _) in found.items() if not (hit and 20 * hit >= n)}
    assert 42 not in kept["decontamination"] and 43 in kept["decontamination"]
    assert kept["personal_data"] == {i: pii.redacted(texts[i]) for i in kept["decontamination"]} and "<EMAIL>" in kept["personal_data"][47]

    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(kept["personal_data"])


def test_stages_of_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    documents(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, folder).collect() == []
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_stages_take_very_long_texts(spark, tmp_path):
    folder = str(tmp_path)
    phrase, texts = corpus()
    long = " ".join(texts[:40]) * 60
    own = [*texts[:20], long, f"{long[:-9]} end {phrase}", "x" * 300_000 + " " + texts[1]]
    documents(spark, own).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, phrase)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    kept = {r.doc_id for r in rows}
    assert 20 in kept and 21 not in kept  # near copies, the first of which stays
    total = {r.doc_id: r.doc_tokens for r in rows}
    assert all(sum(r.length for r in rows if r.doc_id == i) == n for i, n in total.items()) and total[20] > 100_000


def test_each_operator_has_one_query():
    names = [x.split("_")[0] for x in queries.QUERIES]
    assert names == [f"op{n}" for n in range(1, 14)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
