"""The corpus pipeline: every stage against a brute-force version of its decision."""

import os

import numpy as np
import pytest
from test_line_dedup import expected as lines_expected
from test_packing import check as check_packing
from test_simhash import plain_groups, plain_print

import __spark_entry__ as entry_module
import corpus_pipeline
from astrolake.llm import langid, pii

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(name, rows)] of the input and of every stage."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [("documents", docs.collect(), docs.columns)]
    for name, stage in corpus_pipeline.STAGES:
        path = os.path.join(folder, name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs.collect(), docs.columns))
    return out


def test_columns_stay_until_the_last(stages):
    for _, _, columns in stages[1:-1]:
        assert columns == stages[0][2]


def test_language_id_keeps_clean_documents(stages):
    before, after = stages[0][1], stages[1][1]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert len(gone) <= 0.02 * len(before)
    assert all(langid.words_of(r.text) for r in after)
    assert {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()


def test_language_id_keeps_documents_without_labels(spark):
    docs = spark.createDataFrame([(1, "the house is of wood", None), (2, "das haus", None)],
                                 "doc_id long, text string, lang string")
    assert corpus_pipeline.language_id(spark, docs, SF_DIR).collect() == docs.collect()


def test_line_dedup(stages):
    rows = [(r.doc_id, r.text) for r in stages[1][1]]
    assert sorted((r.doc_id, r.text) for r in stages[2][1]) == sorted(lines_expected(rows))
    assert all(r.n_chars == len(r.text) for r in stages[2][1])


def test_near_dedup(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[2][1])
    groups = plain_groups([plain_print(text) for _, text in rows], 2)
    assert sorted(r.doc_id for r in stages[3][1]) == sorted(rows[i][0] for i in set(groups))


def test_pii(stages):
    before = {r.doc_id: r.text for r in stages[3][1]}
    after = {r.doc_id: r.text for r in stages[4][1]}
    assert set(before) == set(after)
    for doc, text in before.items():
        base = pii.base_spans(text)
        assert not pii.base_spans(after[doc])
        if base:
            assert all(f"<{kind.upper()}>" in after[doc] for _, _, kind in base[:1])
    assert np.mean([before[d] == after[d] for d in before]) > 0.5


def test_packing(stages):
    check_packing(stages[5][1], {r.doc_id: r.text for r in stages[4][1]})


def test_run_is_registered(spark, stages):
    result = entry_module.queries()["pipeline"](spark, SF_DIR)
    key = ("doc_id", "start", "length", "sequence_id", "offset")
    assert sorted(tuple(r[k] for k in key) for r in result.collect()) == \
        sorted(tuple(r[k] for k in key) for r in stages[5][1])
