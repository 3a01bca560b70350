import re

import duckdb
import pytest

import corpus_pipeline
from plotmark.llm import pii
from plotmark.llm.line_dedup import line_dedup_sql
from tests.llm.conftest import prose
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check_places

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage reads and returns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_keep_the_columns_of_documents(stages):
    names = list(stages)
    assert [n for n, _ in corpus_pipeline.STAGES] == names[1:]
    assert all(stages[n].dtypes == stages["documents"].dtypes for n in names[1:-1])


def test_documents_with_letters_stay_and_get_their_language(stages):
    before, after = ({r.doc_id: r for r in stages[n].collect()} for n in ("documents", "language_id"))
    assert all(not any(c.isalpha() for c in before[i].text or "") for i in set(before) - set(after))
    assert all(after[i].text == before[i].text for i in after)
    assert sum(after[i].lang == before[i].lang for i in after) >= 0.97 * len(after)


def test_recurring_lines_go(stages):
    c = duckdb.connect()
    c.execute("CREATE TABLE docs (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO docs VALUES (?, ?)", [(r.doc_id, r.text) for r in stages["language_id"].collect()])
    want = {i: t for i, n, t in c.execute(f"SELECT doc_id, n_dropped, text FROM ({line_dedup_sql('docs')})").fetchall() if n == 0 or t.strip(" ")}
    got = stages["line_dedup"].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_one_of_each_group_stays(stages):
    want = brute([(r.doc_id, r.text) for r in stages["line_dedup"].collect()])
    assert {r.doc_id for r in stages["ngram_join"].collect()} == {i for i, (root, _) in want.items() if i == root}


def test_personal_data_are_replaced(stages):
    before = {r.doc_id: r.text for r in stages["ngram_join"].collect()}
    for r in stages["pii"].collect():
        spans = pii.find_spans(before[r.doc_id])
        assert not [s for s in pii.find_spans(r.text) if s["kind"] in pii.BASE]
        assert len(re.findall("<(?:EMAIL|IP|CARD|PHONE|IBAN|SSN)>", r.text)) >= bool(spans)
        assert spans or r.text == before[r.doc_id]


def test_every_document_is_packed(stages):
    rows = stages["packing"].collect()
    check_places(rows, 2048)
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages["pii"].collect()}


def test_run_is_the_stages_in_order(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*key).collect())) == sorted(map(tuple, stages["packing"].select(*key).collect()))


def test_odd_documents_pass_all_stages(spark, odd_docs, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd_docs.select(*columns), no_docs.select(*columns)):
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)


def test_null_and_repeated_ids_keep_whole_rows(spark):
    rows = [(None, prose(60, 1), "en", "a", 1), (None, prose(60, 2), "en", "b", 1), (5, prose(60, 3), "en", "c", 1), (5, prose(60, 4), "fr", "d", 1), (7, prose(60, 3), "en", "e", 1), (5, prose(60, 3), "en", "c", 1), (None, prose(60, 3), "en", "f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    whole = lambda found: sorted(map(str, ((r.doc_id, r.text, r.lang, r.source) for r in found)))
    assert whole(corpus_pipeline.lines(spark, docs, SF).collect()) == sorted(str(r[:4]) for r in rows)
    assert whole(corpus_pipeline.near_copies(spark, docs, SF).collect()) == sorted(str(r[:4]) for r in rows[:4])
