"""Stages that keep the columns of documents, with columns named like their own helpers."""
import corpus_pipeline
import pytest
from corpusflow.llm import decontaminate, exact_dedup, ngram_join

HELPERS = ["_n", "_id", "_digest", "_stays", "_row_digest", "_drop", "digest", "id", "doc", "maybe", "_place", "_map", "_bits", "d", "i", "stays",
           "statistics", "score", "predicted", "hit_words", "items", "spans", "n_words", "_doc", "wanted", "key", "n"]
ROWS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "One two three four five six seven eight nine ten eleven twelve"),
        (3, "one two three four five six seven eight nine ten eleven twelve"), (4, None), (5, ""), (None, "x"), (6, "other words"), (6, "other words")]


def frame(spark):
    schema = "doc_id long, text string, " + ", ".join(f"`{h}` string" for h in HELPERS)
    return spark.createDataFrame([(i, t, *[f"{h}{i}" for h in HELPERS]) for i, t in ROWS], schema)


@pytest.mark.parametrize("name", ["exact", "near", "clean", "quality"])
def test_helper_names_in_the_input_are_only_columns(spark, name):
    docs = frame(spark)
    bench = spark.createDataFrame([("a", "unrelated words of some benchmark question here")], "item_id string, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 7)], "doc_id long, quality int, toxic int")
    from corpusflow.llm import quality
    out = {"exact": lambda: exact_dedup.drop_duplicates(docs, exact_dedup.fresh_index(spark, docs.schema["doc_id"].dataType)),
           "near": lambda: ngram_join.keep_one(docs), "clean": lambda: decontaminate.clean(docs, bench),
           "quality": lambda: quality.keep_good(docs, labels)}[name]()
    assert out.dtypes == docs.dtypes
    rows = out.collect()
    assert all(r[h] == f"{h}{r.doc_id}" for r in rows for h in HELPERS)
    kept = sorted((r.doc_id or 0, r.text or "") for r in rows)
    if name == "exact":
        assert [k[0] for k in kept] == [0, 3, 5, 6]
    if name == "near":
        assert [k[0] for k in kept] == [0, 1, 4, 5, 6, 6]
    if name == "clean":
        assert len(kept) == len(ROWS)
    assert corpus_pipeline.STAGES
