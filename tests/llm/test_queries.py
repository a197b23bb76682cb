"""The registered queries and the pipeline on the smallest tables."""

import pytest
import __spark_entry__ as entry
import corpus_pipeline
from parkops.llm import language, minhash, mixing, secrets
from parkops.llm.common import materialize, read
from parkops.llm.queries import ORACLES, QUERIES
from parkops.plans.verify import duck, rows

SF_SMALL = "/root/testdata/sf0.001"


def test_thirteen_operators_and_the_pipeline_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(names) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    assert rows(got) == rows(duck(SF_SMALL).execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    table = {"op1_embedding_dedup": "embeddings", "op6_chat_format": "conversations", "op8_ann_search": "embeddings"}.get(name, "documents")
    n = read(spark, SF_SMALL, table).count()
    # one row a conversation of several turns, one a word, else one a row or more
    assert df.count() >= (n // 10 if "chat" in name else 1 if "spelling" in name else n)


def test_pipeline_stages_take_effect(spark):
    docs = read(spark, SF_SMALL, "documents")
    for (name, stage), check in zip(corpus_pipeline.STAGES, (language_check, dedup_check, secret_check, mixing_check, None)):
        out = materialize(stage(spark, docs, SF_SMALL), "test-stage")
        if check:
            assert out.columns == docs.columns, name
            check(spark, docs, out)
        else:
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        docs = out


def language_check(spark, docs, out):
    found = language.identify(docs, docs)
    assert out.count() == found.where(f"lang_pred != 'und' AND score >= {corpus_pipeline.LEAST_SCORE}").count() >= 0.95 * docs.count()


def dedup_check(spark, docs, out):
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in minhash.classes(docs).where("kept").collect())


def secret_check(spark, docs, out):
    spans = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    before, after = ({r.doc_id: r for r in df.collect()} for df in (docs, out))
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert (r.text == before[i].text) == (not spans[i]) and r.n_chars == len(r.text)


def mixing_check(spark, docs, out):
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).where("size > 0").collect()}
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in taken.items() if n}


def test_run_equals_the_stages(spark):
    assert corpus_pipeline.run(spark, SF_SMALL).count() > 0
