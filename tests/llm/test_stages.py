"""Every stage of the pipeline over null, empty, short, very long, repeated and clashing input."""

import random

import pytest

import corpus_pipeline
from tests.llm.test_corpus import clashing, documents, rows_by_id

STAGES = dict(corpus_pipeline.STAGES)
R = random.Random(21)


def prose(n):
    words = ["".join(R.choice("abdegilmnorstu") for _ in range(R.randint(3, 9))) for _ in range(n)]
    return ". ".join(" ".join(words[i:i + 12]).capitalize() for i in range(0, n, 12)) + "."


CLEAN = [prose(n) for n in (60, 90, 200, 40_000)]
LEAKED = prose(24)
#: ids: 0-3 clean, 4 null, 5 empty, 6 blank, 7 one long word, 8 and 9 copies of 1, 10 short.
TEXTS = [*CLEAN, None, "", " \n\t", "x" * 200_000, CLEAN[1], CLEAN[1], "a few words."]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stages"))
    items = [(1, LEAKED, 5), (2, None, 6), (3, "", 7), (None, "zzz yyy", 8), (1, LEAKED, 9)]
    spark.createDataFrame(items, "item_id bigint, text string, contaminated int").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", STAGES)
def test_stage_over_odd_documents(spark, folder, name):
    df = documents(spark, TEXTS)
    got = STAGES[name](spark, clashing(df), folder)
    if name == "packing":
        lengths = {r.doc_id: r.n for r in got.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
        assert sorted(lengths) == list(range(len(TEXTS))) and lengths[4] == lengths[5] == 1 and lengths[8] == lengths[9] == lengths[1]
        assert lengths == {r.doc_id: r.doc_tokens for r in got.collect()}
        assert all(r.offset + r.length <= 1024 for r in got.collect())
    else:
        assert tuple(got.columns) == corpus_pipeline.COLUMNS
        rows = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
        want = {"quality": {0, 1, 2, 3, 8, 9}, "near_duplicates": {0, 1, 2, 3, 7, 10}, "decontaminate": set(range(11)), "privacy": set(range(11))}[name]
        odd = {4, 5, 6} if name == "near_duplicates" else set()
        assert set(rows) - odd == want
        assert all(rows[i] == (TEXTS[i], len(TEXTS[i])) for i in want - {4})
    assert STAGES[name](spark, df.limit(0), folder).count() == 0


def test_near_duplicates_of_texts_without_words(spark, folder):
    """Null and empty are equal texts and keep their smallest id; a blank one is another text."""
    assert rows_by_id(STAGES["near_duplicates"](spark, documents(spark, [None, "", None, " "]), folder)) == [(0,), (3,)]


def test_decontamination_over_odd_benchmarks(spark, folder, tmp_path):
    df = documents(spark, [CLEAN[0], CLEAN[0] + " " + LEAKED, "zzz yyy", None, CLEAN[3] + " " + LEAKED])
    assert rows_by_id(STAGES["decontaminate"](spark, df, folder)) == [(0,), (3,)]
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows_by_id(STAGES["decontaminate"](spark, df, str(tmp_path))) == [(i,) for i in range(5)]


def test_privacy_over_very_long_texts(spark, folder):
    text = CLEAN[3] + " Write to ann@example.org or call +44 20 7946 0958."
    got = STAGES["privacy"](spark, documents(spark, [text, CLEAN[0]]), folder).orderBy("doc_id").collect()
    assert got[0].text.startswith(CLEAN[3]) and "ann@example.org" not in got[0].text and "7946" not in got[0].text
    assert got[1].text == CLEAN[0]


def test_run_over_an_empty_table(spark, folder, tmp_path):
    documents(spark, TEXTS).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
