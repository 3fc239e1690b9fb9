"""Registered queries on the smallest tables: against their SQL, or brute force where SQL cannot state them."""
import hashlib
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="shared tables are not here")
sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
import brute


@pytest.fixture(scope="module")
def sides():
    import check
    import duckdb

    import __spark_entry__ as e
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return check, con, e.queries(), e.oracle_sql()


@pytest.mark.parametrize("name", ["op3_ngram_join", "op5_benchmark_decontamination", "op7_warc", "op10_exact_dedup", "op11_suffix_array",
                                  "op12_conversation_repair", "op13_hard_negatives"])
def test_query_equals_sql(spark, sides, name):
    check, con, queries, sql = sides
    df = queries[name](spark, SF)
    rel = con.sql(sql[name])
    assert check.normal(df.columns, [tuple(r) for r in df.collect()]) == check.normal(rel.columns, rel.fetchall())


def test_one_query_for_each_operator(sides):
    names = [n for n in sides[2] if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in sides[2]


def test_pipeline_equals_brute_force(spark, sides):
    from corpusflow.llm import bpe, quality
    from corpusflow.llm.common import table
    con, queries = sides[1], sides[2]
    docs = dict(con.sql("SELECT doc_id, text FROM documents").fetchall())
    good = {r.doc_id for r in quality.judge(table(spark, SF, "documents"), table(spark, SF, "labels")).collect() if r.predicted}
    last = {}
    for i in sorted(good):
        last[brute.digest(docs[i])] = i
    rows = [(i, docs[i]) for i in sorted(last.values())]
    alone = [i for i, _, c in brute.near(rows, 5, 8, 10) if i == c]
    items = con.sql("SELECT item_id, text FROM benchmark").fetchall()
    clean = [i for i in alone if not brute.hits(docs[i], items, 10)[1]]
    out = {r.doc_id: r for r in queries["pipeline"](spark, SF).collect()}
    assert sorted(out) == clean and 0 < len(clean) < len(docs)
    enc = bpe.encoder(bpe.default_vocabulary())
    for i, (ids, raw) in zip(clean, enc.encode_all([docs[i] for i in clean])):
        assert out[i].ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(docs[i].encode()).hexdigest()


def test_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline as p
    from corpusflow.llm.common import stored, table
    docs = table(spark, SF, "documents").limit(60)
    for name, stage in p.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() <= docs.count()
        docs = out


def test_url_filter_and_text_cover_every_page(spark, sides):
    con, queries = sides[1], sides[2]
    pages = con.sql("SELECT page_id FROM pages").fetchall()
    for name in ("op1_url_filter", "op8_html_text"):
        assert sorted((r.page_id,) for r in queries[name](spark, SF).collect()) == sorted(pages)


def test_quality_of_documents_on_held_out_labels(spark, sides):
    big = "/root/testdata/sf0.01"
    from corpusflow.llm.common import table
    out = {r.doc_id: r for r in sides[2]["op2_quality"](spark, big).collect()}
    known = [(r.doc_id, r.quality) for r in table(spark, big, "labels").collect() if r.quality is not None and out[r.doc_id].held_out]
    assert sum(out[i].predicted == q for i, q in known) / len(known) > 0.93
