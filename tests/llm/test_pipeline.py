"""Stages of the pipeline, each held against brute force on what it was given."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_classes, check_packing
from tillcast.llm import quality
from tillcast.session import materialize

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def steps(spark):
    """The input and then what each stage returned."""
    found = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        found.append(materialize(stage(spark, found[-1], FOLDER), f"test-{name}"))
    return found


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_all_but_the_last_keep_the_columns(steps):
    assert all(s.dtypes == steps[0].dtypes for s in steps[:-1])


def test_quality_stage_drops_what_a_rule_rejects(steps):
    judged = quality.judge_quality(steps[0]).filter("kept")
    assert by_id(steps[1]).keys() == by_id(judged).keys()
    before = by_id(steps[0])
    assert all(before[d] == r for d, r in by_id(steps[1]).items())


def test_copies_stage_keeps_one_of_each_class(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[1].collect()]
    assert by_id(steps[2]).keys() == {c for _, _, c in brute_classes(rows)}


def test_copies_stage_of_repeated_null_and_reused_ids(spark):
    """One row of each group is kept, whatever the ids; counted by rows, not by ids."""
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [
        (1, text("a")), (1, text("a")), (1, text("a")),  # repeated rows
        (None, text("b")), (None, text("b")), (None, text("b") + " more"),  # no ids at all
        (None, text("c")), (9, text("c")), (8, text("c")),  # no id comes last
        (3, text("d")), (5, text("d")), (5, text("e")),  # 5 is a copy of 3, and a text of its own
        (6, None), (6, None), (None, ""), (None, ""),  # no words: no copies
    ]
    made = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.distinct_documents(spark, made.repartition(3), FOLDER)
    assert found.dtypes == made.dtypes
    kept = sorted(((r["doc_id"], (r["text"] or "").split(" ")[0]) for r in found.collect()), key=str)
    expected = [(1, "a0"), (None, "b0"), (8, "c0"), (3, "d0"), (5, "e0"), (6, ""), (6, ""), (None, ""), (None, "")]
    assert kept == sorted(expected, key=str)


def test_secrets_stage_changes_keys_alone(steps):
    before, after = by_id(steps[2]), by_id(steps[3])
    assert before.keys() == after.keys()
    for d, row in after.items():
        assert row["n_chars"] == len(row["text"])
        assert 'token = "' not in row["text"] or 'token = "[SECRET]"' in row["text"]
        if "[SECRET]" not in row["text"]:
            assert row["text"] == before[d]["text"]


def test_mix_stage_repeats_documents_towards_the_targets(steps):
    before = by_id(steps[3])
    times = steps[4].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert all(r["doc_id"] in before and r["n"] <= 2 for r in times)
    assert all(before[r["doc_id"]] == r for r in steps[4].collect())
    words = lambda s: s.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert abs(words(steps[4]) / words(steps[3]) - 1.5) < 0.1


def test_packing_stage_places_every_token(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[4].collect()]
    check_packing(steps[5].collect(), rows, 4096)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size int, row string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like results."""
    base = " ".join(f"w{i % 97}x{i % 13}" for i in range(300)) + "."
    long = " ".join(f"word{i % 5000}" for i in range(40_000))
    rows = [(1, base, "a"), (1, base, "a"), (2, base + " more", None), (3, None, "b"), (4, "", "b"),
            (5, " \n\t ", None), (None, base, None), (6, long, "a"), (7, "x" * 50_000, "b"),
            (None, None, None), (8, f'{base} token = "{"0123456789abcdef" * 3}" end', "c")]
    made = [(d, t, None, s, None, 1, "r") for d, t, s in rows]
    return spark.createDataFrame(made, COLUMNS).repartition(3)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_each_stage_of_odd_rows_and_of_none(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    given = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = stage(spark, odd, FOLDER).collect()
    assert stage(spark, odd.filter("false"), FOLDER).count() == 0
    if name == "best_fit_packing":
        check_packing(found, given, 4096)
        return
    own = [(r["doc_id"], r["text"]) for r in found]
    count = {x: given.count(x) for x in given}
    if name == "quality_rules":
        assert all(own.count(x) == count[x] for x in own) and None not in [t for _, t in own]
    if name == "ngram_jaccard_join":
        kept = brute_classes([(k, t) for k, (_, t) in enumerate(given)])
        assert len(own) == len({c for _, _, c in kept})
    if name == "secret_scans":
        assert sorted(str(d) for d, _ in own) == sorted(str(d) for d, _ in given)
    if name == "source_mixing":
        assert all(own.count(x) <= 2 * count[x] for x in own)
