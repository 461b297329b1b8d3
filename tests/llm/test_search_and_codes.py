"""Vector codes, lexical search and removal of repeats against brute force and on odd rows."""

import hashlib
import math
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.llm import codes, lexical, repeats
from tillcast.llm.queries import QUERIES
from tillcast.llm.scratch import CLEANUP, Scratch

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
DOCS = "doc_id long, text string, score string, n long, id int, key string, terms int, print int"


def odd_rows():
    base = " ".join(f"w{i % 97}x{i % 13}" for i in range(300))
    long = " ".join(f"word{i % 5000}" for i in range(120_000))
    rows = [(1, base), (1, base), (2, base + " More"), (3, None), (4, ""), (5, " \n\t "), (6, "one Two"),
            (7, "ONE two é"), (None, base), (8, long), (9, "x" * 100_000), (None, None), (10, "é " * 90)]
    return [(*r, "s", 1, 2, "k", 3, 4) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 11 vector codes


def brute_codes(rows, parts, entries, rounds, scale):
    """rows: (id, vector, label), sorted; every part against every entry."""
    v = np.array([[math.floor(scale * float(x)) for x in r[1]] for r in rows], object)
    step = v.shape[1] // parts
    texts, errors, shown = [""] * len(v), [0] * len(v), []
    for k in range(parts):
        x = v[:, k * step : (k + 1) * step]
        book = [list(y) for y in x[:entries]]

        def nearest(book, x=x):
            return [min((sum((a - b) ** 2 for a, b in zip(row, e, strict=True)), j)
                        for j, e in enumerate(book)) for row in x]

        for _ in range(rounds):
            found = [j for _, j in nearest(book)]
            for j in set(found):
                own = x[[i for i, f in enumerate(found) if f == j]]
                book[j] = [sum(c) // len(own) for c in own.T]
        for i, (d, j) in enumerate(nearest(book)):
            texts[i] += f"{j:02x}"
            errors[i] += d
        shown += [str(c) for e in book for c in e]
    labels = {}
    for r, e in zip(rows, errors, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(shown).encode()).hexdigest()
    return [(r[0], t, e, labels[r[2]], digest) for r, t, e in zip(rows, texts, errors, strict=True)]


VECTORS = "vec_id long, embedding array<double>, label int, code string, trees int"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_codes_equal_brute_force(spark, seed, monkeypatch):
    """With ties, repeated vectors, one of them a third of all, and entries that nothing uses."""
    monkeypatch.setattr(codes, "BLOCK", 64)
    monkeypatch.setattr(codes, "LEAF", 3)
    pick = np.random.default_rng(seed)
    spread = [0.02, 0.004, 0.5][seed - 1]
    made = pick.normal(0, spread, (300, 8))
    made[::3] = made[0]
    rows = [(i, made[i].tolist(), [None, 1, 2][i % 3], "x", 1) for i in range(300)]
    found = codes.compress_vectors(
        spark.createDataFrame(rows, VECTORS).repartition(4), entries=20, rounds=3
    )
    got = sorted(tuple(r) for r in found.collect())
    assert got == brute_codes([r[:3] for r in rows], 4, 20, 3, 1024)


def test_codes_of_odd_vectors(spark):
    good = [(i, [float(i % 3), -0.5, 0.001 * i, 2.0], None if i % 2 else 7, "x", 1) for i in range(9)]
    bad = [(100, None, 1, "x", 1), (101, [1.0, None, 2.0, 3.0], 1, "x", 1), (102, [], 1, "x", 1),
           (103, [1.0, float("nan"), 2.0, 3.0], 1, "x", 1), (104, [1.0, 2.0, float("-inf"), 0.0], 1, "x", 1),
           (105, [1.0] * 8, 1, "x", 1), (106, [1.0] * 5, 1, "x", 1)]
    twice = [(3, good[3][1], 5, "x", 1), (None, [0.1, 0.2, 0.3, 0.4], 5, "x", 1)]
    frame = spark.createDataFrame(good + bad + twice, VECTORS)
    got = codes.compress_vectors(frame, entries=4, rounds=2).collect()
    assert len(got) == 11 and {r["vec_id"] for r in got} == {*range(9), None}
    kept = sorted(good + twice, key=lambda r: (r[0] is None, r[0], r[1]))
    expected = brute_codes([r[:3] for r in kept], 4, 4, 2, 1024)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, expected))
    assert codes.compress_vectors(frame.filter("false")).count() == 0
    assert codes.compress_vectors(frame.filter("vec_id = 102")).count() == 0


def test_balls_hold_their_points_sums_and_counts():
    points = np.random.default_rng(5).integers(-50, 50, (700, 4))
    points[100:400] = points[0]
    tree = codes.build_tree(points)
    assert sorted(tree.order) == list(range(700)) and (tree.points == points[tree.order]).all()
    for (low, high, left, right), total, radius in zip(tree.nodes, tree.sums, tree.radius, strict=True):
        own = tree.points[low:high]
        assert (own.sum(axis=0) == total).all()
        assert np.linalg.norm(own - own.mean(axis=0), axis=1).max() == pytest.approx(radius, abs=1e-9)
        if left >= 0:
            assert tree.nodes[left][0] == low and tree.nodes[right][1] == high
            assert tree.nodes[left][1] == tree.nodes[right][0]


def test_whole_balls_are_owned_by_one_entry():
    pick = np.random.default_rng(6)
    centres = np.array([[0, 0], [1000, 0], [0, 1000]])
    points = np.concatenate([c + pick.integers(-20, 20, (300, 2)) for c in centres])
    tree = codes.build_tree(points)
    balls = list(codes.owners(tree, centres.astype(float)))
    assert sum(high - low for _, low, high, _ in balls) == 900 and len(balls) < 20


# 12 ranked lexical search


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranks(docs, items, k):
    held = [(d, terms_of(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    total, length = len(held), sum(len(t) for _, t in held)
    frequency = {}
    for _, own in held:
        for term in set(own):
            frequency[term] = frequency.get(term, 0) + 1
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    found = []
    for item, own in wanted.items():
        scores = []
        for doc, words in held:
            m = 100 - 90 + (90 * len(words) * total) // length
            score = 0
            for term in own & set(words):
                tf = words.count(term)
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * frequency[term] + 1)))
                score += w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scores)[:k], 1):
            found.append((item, rank, doc, -score))
    return sorted(found, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_equal_brute_force(spark, seed, monkeypatch):
    """Small blocks and leaves, blocks of items, ties between copies, and frequent terms."""
    monkeypatch.setattr(lexical, "BLOCK", 50)
    monkeypatch.setattr(lexical, "LEAF", 4)
    monkeypatch.setattr(lexical, "FAN", 3)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 120)
    pick = random.Random(seed)
    words = ["The", "of", *(f"t{i}" for i in range(60)), "é", "ÉT", "x-y", "a_b", "7"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(pick.choices(words, weights, k=pick.randrange(1, 60)))) for i in range(230)]
    docs += [(500 + i, docs[0][1]) for i in range(20)] + [(None, docs[1][1]), (3, docs[2][1])]
    items = [(i, " ".join(pick.choices(words, k=pick.randrange(1, 12)))) for i in range(30)]
    items += [(2, "t1 t2"), (None, "the of"), (91, None), (92, "zzz"), (93, "")]
    found = lexical.rank_documents(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
        k=7,
    )
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_ranks(docs, items, 7)


def test_ranks_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame(
        [(1, "w3x3 one"), (2, "É é word7"), (3, "x" * 100_000), (4, None)],
        "item_id long, text string")
    found = lexical.rank_documents(odd, items, k=3)
    own = [(r[0], r[1]) for r in odd_rows()]
    expected = brute_ranks(own, [tuple(r) for r in items.collect()], 3)
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected
    assert lexical.rank_documents(empty, items).count() == 0
    assert lexical.rank_documents(odd, items.filter("false")).count() == 0


def test_node_bounds_hold_and_prune():
    pick = np.random.default_rng(3)
    doc = np.repeat(np.arange(600), 12)
    column = (pick.integers(0, 40, 7200) + 40 * (doc % 5))
    pairs = np.unique(np.stack([doc, column], axis=1), axis=0)
    impact = pick.integers(1, 1000, len(pairs))
    weights = pick.integers(0, 3000, 200)
    index = lexical.build_index(np.arange(600), pairs[:, 0], pairs[:, 1], impact, weights)
    dense = np.zeros(200, np.int64)
    dense[40:60] = weights[40:60]
    scores = index.products(dense, np.arange(600), 0)
    for level in range(1, len(index.levels)):
        nodes = np.arange(len(index.levels[level][0]) - 1)
        below = index.products(dense, index.children(nodes, level), level - 1)
        owner = np.repeat(nodes, index.width(level))[: len(below)]
        best = np.zeros(len(nodes), np.int64)
        np.maximum.at(best, owner, below)
        assert (index.products(dense, nodes, level) >= best).all()
    asked = []
    keep = index.products
    index.products = lambda d, n, level: asked.append(len(n) if level == 0 else 0) or keep(d, n, level)
    items = lexical.Items([0], [np.arange(40, 60)], np.arange(200), np.ones(200), weights)
    search = lexical.Search(items, 5, np.ones(1, np.int64))
    search.look(index)
    assert sorted(search.best[0][1].tolist()) == sorted(scores.tolist())[-5:]
    assert sum(asked) < 300


# 13 suffix-array dedup


def brute_repeats(rows, length):
    first = {}
    own = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in own:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, float("inf")), i)
    found = []
    for (doc, _), (i, b) in zip(rows, own, strict=True):
        depth = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                depth[p] += 1
                depth[p + length] -= 1
        gone = np.cumsum(depth)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        found.append((doc, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(found, key=str)


def test_suffix_arrays_equal_sorting():
    pick = np.random.default_rng(1)
    for _ in range(150):
        strings = [np.append(pick.integers(1, pick.integers(2, 6), pick.integers(1, 50)), 0)
                   for _ in range(pick.integers(1, 6))]
        starts = np.concatenate([[0], np.cumsum([len(s) for s in strings])[:-1]])
        found = repeats.suffix_arrays(np.concatenate(strings), starts)
        for s, start in zip(strings, starts, strict=True):
            text = s.tolist()
            own = (found[start : start + len(text)] - start).tolist()
            assert own == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("seed", range(4))
def test_repeats_equal_brute_force(spark, seed, monkeypatch):
    """Passages shared by many, null and repeated ids, periods; small bounds for the ways around."""
    if seed == 1:
        monkeypatch.setattr(repeats, "SURROUNDINGS", 2)
    if seed == 2:
        monkeypatch.setattr(repeats, "USES", 5)
        monkeypatch.setattr(repeats, "STEP_BITS", 7)
    if seed == 3:
        monkeypatch.setattr(repeats, "FILTER_BITS", 64)
        monkeypatch.setattr(repeats, "LOCKSTEP_BYTES", 500)
    pick = random.Random(seed)
    shared = ["".join(pick.choices("abé ", k=pick.randrange(30, 200))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [pick.choice(shared) if pick.random() < 0.5 else "".join(pick.choices("abcdé ", k=40))
                 for _ in range(pick.randrange(5))]
        rows.append((pick.choice([i, i, i // 2, None]), pick.choice(["".join(parts)] * 3 + [None])))
    rows += rows[:5] + [(1000, "ab" * 300), (1001, "ab" * 200), (1002, "a" * 49), (1003, "a" * 50),
                        (1004, "a" * 51)]
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted(((*tuple(r)[:5], bytes(r["kept"])) for r in found.collect()), key=str)
    assert got == brute_repeats(rows, 50)


def test_repeats_of_odd_rows(odd, empty):
    found = repeats.remove_repeats(odd).collect()
    got = sorted(((*tuple(r)[:5], bytes(r["kept"])) for r in found), key=str)
    assert got == brute_repeats([(r[0], r[1]) for r in odd_rows()], 50)
    assert repeats.remove_repeats(empty).count() == 0


def test_filters_beyond_their_share_still_leave_out(spark, monkeypatch):
    """However many numbers there are, the others aren't all let through, and none of them is lost."""
    monkeypatch.setattr(repeats, "FILTER_BITS", 1 << 16)
    monkeypatch.setattr(repeats, "FILTER_STEP", 1000)
    for size in (0, 1, 3000, 20_000, 30_000):  # the last two are more than a quarter of the bits
        found = repeats._filter(spark.range(0, size, 1, 3))
        assert found is not None
        assert repeats._held(found, np.arange(size)).all()
        assert repeats._held(found, np.arange(10**6, 10**6 + 20_000)).mean() < 0.5


def test_bytes_of_many_are_not_all_shuffled(spark, monkeypatch):
    """With more wanted than a quarter of a filter's bits, others are still left out where they are read."""
    monkeypatch.setattr(repeats, "FILTER_BITS", 1 << 10)
    pick = random.Random(5)
    texts = [(i, "".join(pick.choices("abcdefgh", k=3000))) for i in range(20)]
    docs = spark.createDataFrame(texts, "id long, text string").coalesce(1)

    def some(records):
        for record in records:
            for part, texts in repeats.batches(record, "text", False):
                for key, _, start, n, text in repeats.surroundings(texts, 50):
                    own = repeats._prints(texts, start, start + n + 49)
                    low = repeats._numbers(part)[text]
                    yield repeats._batch({"key": key[:300], "print": own[:300], "low": low[:300]})

    wanted = docs.mapInArrow(some, "key long, print long, low long").localCheckpoint()
    assert wanted.count() > (1 << 10) // 4
    fetched = repeats._bytes(docs, 50, wanted, repeats._filter(spark.range(0)))
    assert "Exchange" not in fetched._jdf.queryExecution().executedPlan().toString()
    assert fetched.join(wanted, ["key", "print"], "left_semi").count() >= wanted.count()
    assert fetched.count() < 3000


def test_scratch_leaves_no_shuffle_files(spark):
    """What was shuffled to write a table is gone soon after, and the session's setting is as before."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        names = [files.apply(k).getName() for k in range(files.size())]
        return {x for x in names if x.startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(CLEANUP, None)
    scratch = Scratch(spark, "test")
    kept = scratch.keep(spark.range(1000).repartition("id"), "rows")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert kept.count() == 1000
    assert spark.conf.get(CLEANUP, None) == setting
    scratch.drop("rows")


def test_queries_read_whole_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert QUERIES["op13_suffix_array_dedup"](spark, FOLDER).count() == docs.count()
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    assert QUERIES["op11_vector_codes"](spark, FOLDER).count() == vectors.count()
    ranks = QUERIES["op12_lexical_search"](spark, FOLDER).groupBy("item_id").agg(F.max("rank").alias("n"))
    assert ranks.agg(F.max("n")).first()[0] == 10
