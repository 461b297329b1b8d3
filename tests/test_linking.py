"""Names in texts, checked against brute force."""

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tillcast.operators import linking
from tillcast.sources.driver_tables import DriverTables

ITEMS = ["three milk 2.5 lbs", "belgian chocolate 2.5 lbs", "strawberry donut", "red velvet", "pie"]
BRANCHES = ["lake city", "f10 markaz"]
TEXTS = [
    ("1", "what is the price of strawberry donut?"),
    ("2", "how many strawbery donuts were sold at lake city"),
    ("3", "sale of three milk 2.5 lbs at f10 markaz"),
    ("4", "chocolate please"),
    ("5", "good morning"),
    ("6", "magpies"),
    ("7", "belgian milk"),
    ("8", "red"),
]


@pytest.fixture(scope="module")
def names(spark):
    items = spark.createDataFrame([(n,) for n in ITEMS], "name string")
    return linking.catalogue(items, spark.createDataFrame([(n,) for n in BRANCHES], "name string"))


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "text_id string, text string")


def test_containment_equals_brute_force(texts, names, rows):
    expected = sorted(
        (i, any(n in t for n in ITEMS), any(n in t for n in BRANCHES)) for i, t in TEXTS)
    assert rows(linking.text_mentions(texts, names)) == expected
    pairs = sorted((i, n) for i, t in TEXTS for n in ITEMS + BRANCHES if n in t)
    assert rows(linking.mentions(texts, names)) == pairs


def test_links_and_suggestions(texts, names, rows):
    got = {r["text_id"]: r for r in linking.answer_context(
        linking.fuzzy_link(texts, names)).collect()}
    assert got["1"]["found_items"] == "strawberry donut"
    assert got["2"]["found_items"] == "strawberry donut"
    assert got["2"]["found_branches"] == "lake city"
    assert got["2"]["context"] == (
        "Items found in your query: strawberry donut. Branches found in your query: lake city. ")
    # tokens of "three milk 2.5 lbs" are three, milk, 2, 5, lbs; belgian shares 2, 5, lbs of 5
    assert got["3"]["found_items"] == "belgian chocolate 2.5 lbs, three milk 2.5 lbs"
    assert got["5"]["context"] == linking.NOTHING_FOUND
    assert got["7"]["suggested_items"] == "belgian chocolate 2.5 lbs" or (
        got["7"]["suggested_items"] == "")
    assert got["8"]["context"] == "Did you mean these items: red velvet?"


def test_routes(spark, names, rows):
    texts = spark.createDataFrame(
        [("1", "drop the strawberry donut"), ("2", "you strawberry donut"), ("3", "hello"),
         ("4", "strawberry donut")], "text_id string, text string")
    scores = spark.createDataFrame(
        [("2", {"INSULT": 0.9}), ("4", {"INSULT": 0.6})],
        "text_id string, scores map<string, double>")
    got = linking.route(texts, scores, names)
    assert rows(got, "text_id", "route") == [
        ("1", "unsafe"), ("2", "abusive"), ("3", "passed on"), ("4", "linked")]
    answers = {r["text_id"]: r["answer"] for r in got.collect()}
    assert answers["3"] is None and answers["1"] == linking.UNSAFE


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


word = st.text(alphabet="abé1", min_size=1, max_size=6)


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(word, min_size=5, max_size=40), st.sets(word, min_size=5, max_size=40))
def test_similar_tokens_equal_brute_force(spark, left, right):
    def alike(a, b):
        """One edit, which leaves 60 percent of the longer word."""
        longer = max(len(a), len(b))
        return edit_distance(a, b) <= 1 and 100 * (longer - 1) >= 60 * longer

    expected = {(a, b) for a in left for b in right if a == b or alike(a, b)}
    got = linking.similar_tokens(
        spark.createDataFrame([(a,) for a in left], "token string"),
        spark.createDataFrame([(b,) for b in right], "token string"))
    pairs = [tuple(r) for r in got.collect()]
    assert set(pairs) == expected and len(pairs) == len(expected)


def test_index_keeps_every_pair_that_reaches_the_cutoff(spark):
    """All tokens shared by many names: the rare-token index must not lose a match."""
    items = [f"{a} {b} {c}" for a in ("red", "blue") for b in ("ring", "gear") for c in ("x1", "x2")]
    lines = [(str(k), t) for k, t in enumerate(
        ["red ring", "blue gear x2", "x1 red", "ring ring", "gear blue x1 red", "none"])]
    catalogue = linking.catalogue(
        spark.createDataFrame([(n,) for n in items], "name string"),
        spark.createDataFrame([], "name string"))
    got = {r["text_id"]: r["found_items"] for r in linking.fuzzy_link(
        spark.createDataFrame(lines, "text_id string, text string"), catalogue).collect()}
    for text_id, line in lines:
        used = set(line.split())
        found = sorted(n for n in items if 100 * len(used & set(n.split())) / 3 >= 60)
        assert got[text_id] == ", ".join(found)


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.text(alphabet="ab.( é", min_size=1, max_size=7), min_size=1, max_size=25),
       st.lists(st.text(alphabet="ab.( é", max_size=20), min_size=1, max_size=15))
def test_both_ways_to_find_names_equal_brute_force(spark, names, lines):
    texts = spark.createDataFrame([(str(k), t) for k, t in enumerate(lines)], "text_id string, text string")
    table = spark.createDataFrame([(n,) for n in names], "name string")
    expected = {(str(k), n) for k, t in enumerate(lines) for n in names if n in t}
    for found in (linking.mentions(texts, table), linking._mentions_by_grams(texts, table)):
        pairs = [tuple(r) for r in found.collect()]
        assert set(pairs) == expected and len(pairs) == len(expected)


def test_a_text_sends_its_matches_only(spark):
    texts = spark.createDataFrame([("1", "a red ring and a red ringlet")], "text_id string, text string")
    names = spark.createDataFrame([("red",), ("red ring",), ("ring",), ("blue",)], "name string")
    found = linking.mentions(texts, names)
    assert sorted(r["name"] for r in found.collect()) == ["red", "red ring", "ring"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "contains" not in plan.lower()
    assert linking.mentions(texts, names.filter("false")).count() == 0


def test_hits_are_not_broadcast_for_their_small_file(spark):
    """Texts that share their words make a small file of many rows; the few names are broadcast instead."""
    items = [f"{a} {b}" for a in ("red", "blue", "green", "black") for b in ("ring", "bolt", "plate")]
    names = linking.catalogue(
        spark.createDataFrame([(n,) for n in items], "name string"),
        spark.createDataFrame([(n,) for n in BRANCHES], "name string"),
    )
    said = " ".join(sorted({w for n in items for w in n.split()}))
    texts = linking.materialize(
        spark.range(4000).selectExpr("CAST(id AS STRING) AS text_id", f"'{said}' AS text"), "texts")
    linked = linking.fuzzy_link(texts, names)
    assert {r["found_items"] for r in linked.collect()} == {", ".join(sorted(items))}
    plan = linked._jdf.queryExecution().executedPlan().toString()  # as it was run
    joins = [x for x in plan[: plan.index("Initial Plan")].splitlines() if "HashJoin [name_token" in x]
    assert joins and not any("BuildLeft" in x for x in joins)


@pytest.mark.parametrize("pairs", [0, 100_000])
def test_many_names_are_linked_alike(spark, texts, names, rows, monkeypatch, pairs):
    """Without any broadcast, and with that of the similar words alone, the links are the same."""
    few = rows(linking.fuzzy_link(texts, names))
    monkeypatch.setattr(linking, "LOOKUP_LETTERS", 0)
    monkeypatch.setattr(linking, "LOOKUP_PAIRS", pairs)
    linked = linking.fuzzy_link(texts, names)
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin [name_token" not in plan
    assert rows(linked) == few


def test_items_are_looked_up_in_keys(spark):
    """Neither the items of the sales nor those of the questions are broadcast whole."""
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    tables = DriverTables(spark, folder)
    for found in (tables.sold_items(), tables.questions()):
        assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    keys = {r[0] for r in tables.table("lineitem").select("l_partkey").distinct().collect()}
    expected = sorted((r["p_type"], r["p_name"]) for r in tables.table("part").collect() if r["p_partkey"] in keys)
    assert sorted(tuple(r) for r in tables.sold_items().collect()) == expected
