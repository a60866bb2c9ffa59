"""The pipeline stage by stage against plain versions."""

import re

import pytest

import corpus_pipeline
from kinweave.llm import langid, omh, packing

from .test_omh import brute
from .test_packing import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "privacy", "packing"]
    assert corpus_pipeline.oracle_sql() == {} and set(corpus_pipeline.queries()) == {"pipeline"}


def test_language_keeps_clean_documents(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert stages[1].columns == stages[0].columns
    assert set(after) == {i for i, r in before.items() if langid.words_of(r.text)}


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])
    ids = sorted(before)
    expected = {ids[c] for c in brute([before[i].text for i in ids]).values()}
    assert set(after) == expected and all(after[i] == before[i] for i in after)


def test_personal_data_goes(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert set(after) == set(before) and stages[3].columns == stages[0].columns
    for i, r in after.items():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)
        assert r.n_chars == len(r.text)
        if not re.search(r"[@0-9]", before[i].text):
            assert r.text == before[i].text


def test_packed(stages):
    texts = [(r.doc_id, r.text) for r in stages[3].collect()]
    used, tokens = check(None, texts, stages[4], packing.CAPACITY)
    assert used <= 1.05 * -(-tokens // packing.CAPACITY) + 1


def test_run(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, found.select(key).collect())) == sorted(map(tuple, stages[4].select(key).collect()))
    assert omh.THRESHOLD == 0.8
