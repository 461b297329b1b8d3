"""Operators against brute force, and on rows that are null, empty, repeated, long or oddly named."""

import collections
import heapq
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillcast.llm import chat, jaccard, mixing, packing, ppm, quality, secrets, sharding, tokens, topk
from tillcast.llm.components import components
from tillcast.llm.queries import QUERIES, vocabulary
from tillcast.session import materialize

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_tokens string, row long, size int, kept int"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like results."""
    base = " ".join(f"w{i % 997}x{i % 13}" for i in range(400))
    long = " ".join(f"word{i % 5000}" for i in range(300_000))
    rows = [
        (1, base, "a"), (1, base, "a"), (2, base + " more", None), (3, None, "b"), (4, "", "b"),
        (5, " \n\t ", None), (6, "one two", "a"), (7, "One TWO", "c"), (None, base, None),
        (8, long, "a"), (9, "x" * 100_000, "b"), (None, None, "a"), (10, "é " * 60, "d"),
    ]
    return spark.createDataFrame([(*r, "n", 0, 1, 2) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 chat formatting


TURNS = "conv_id long, turn long, role string, text string"


def test_control_strings_come_back(spark):
    marks = [*chat.INSTRUCTIONS.marks, "<", "[", "\\", "\\\\", "x", "/s>", "INST]", "\n", "é"]
    pick = random.Random(3)
    texts = ["".join(pick.choices(marks, k=pick.randrange(9))) for _ in range(300)]
    rows = [(c, t, pick.choice(["user", "assistant", "system", "tool", None, "[TEXT]"]), x)
            for c in range(30) for t, x in enumerate(texts[10 * c : 10 * c + 10])]
    made = chat.format_chats(spark.createDataFrame(rows, TURNS)).select(
        "conv_id",
        "formatted",
        "segments",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("segments")).alias("learned"),
    )
    for row in made.collect():
        own = [(r[2] or "", r[3]) for r in rows if r[0] == row["conv_id"]]
        assert [tuple(t) for t in row["turns"]] == own
        assert row["learned"] == "".join(x for r, x in own if r == "assistant")
        assert "".join(s["text"] for s in row["segments"]) == row["formatted"]


def test_machine_flags_turns_out_of_order(spark):
    cases = {"sua": (None, True), "ua": (None, True), "uau": (None, False), "uu": (1, False),
             "a": (0, False), "us": (1, False), "uaa": (2, False), "uax": (2, False)}
    role = {"s": "system", "u": "user", "a": "assistant", "x": None}
    rows = [(i, t, role[c], None) for i, k in enumerate(cases) for t, c in enumerate(k)]
    found = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()}
    for i, (bad, complete) in enumerate(cases.values()):
        assert (found[i]["first_bad_turn"], found[i]["complete"]) == (bad, complete)
        assert found[i]["valid"] == (bad is None)


def test_chats_with_null_ids_ties_and_no_rows(spark):
    rows = [(None, 1, "user", "b"), (None, 1, "user", "a"), (None, None, "system", "c")]
    made = chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()
    assert [r["formatted"] for r in made] == ["[SYS]c[/SYS][INST]a[/INST][INST]b[/INST]"]
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_template_refuses_ambiguous_marks():
    with pytest.raises(ValueError):
        chat.Template({"user": chat.Turn("<<", ">")}, ("[R]", "[T]", "[E]"), {}, ())


# 2 n-gram Jaccard join


def brute_classes(rows, size=5, percent=75):
    sets = []
    for doc, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = WORD.findall(low)
        grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        sets.append(grams if len(words) >= size else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows))]


def test_classes_equal_brute_force(spark, rows):
    """Families with many edits: chains, hubs, sizes at the limit, common passages."""
    pick = random.Random(11)
    texts = []
    passage = [f"p{i}" for i in range(50)]
    for family in range(6):
        words = [f"f{family}w{i}" for i in range(pick.randrange(30, 160))]
        for _ in range(18):
            copy = list(words)
            for _ in range(pick.randrange(7)):
                at = pick.randrange(len(copy))
                copy[at : at + pick.randrange(3)] = [f"e{pick.randrange(500)}"] * pick.randrange(3)
            texts.append(" ".join(copy + (passage if pick.random() < 0.3 else [])))
    texts += ["a b", "A  B", "a b c", None, ""]
    docs = list(enumerate(texts))
    pick.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(jaccard.jaccard_classes(frame)) == sorted(brute_classes(docs), key=str)


def test_classes_of_odd_rows(spark, odd, empty, rows):
    own = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert rows(jaccard.jaccard_classes(odd)) == sorted(brute_classes(own), key=str)
    assert jaccard.jaccard_classes(empty).count() == 0


def test_whole_sets_are_written_of_the_compared_texts_only(spark, monkeypatch):
    """A set that no pair names, or the set of a pair a second time, would grow the disk used."""
    base = [f"w{i}" for i in range(60)]
    # near copies, and texts that share a run of words with them but are similar to nothing
    texts = [" ".join(base[k:] + [f"e{k}"]) for k in range(3)]
    texts += [" ".join(base[:20] + [f"r{k}x{i}" for i in range(60)]) for k in range(12)]
    written = []

    def kept(df, label):
        found = materialize(df, label)
        written.append((label, found))
        return found

    monkeypatch.setattr(jaccard, "materialize", kept)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = jaccard.jaccard_classes(frame).orderBy("doc_id").collect()
    assert [r["component_id"] for r in found] == [0, 0, 0, *range(3, 15)]
    pairs = [df.selectExpr("explode(array(a, b)) key").distinct() for label, df in written if label == "jaccard-pairs"]
    sets = [df.select("key") for _, df in written if "grams" in df.columns]
    assert pairs and len(sets) == len(pairs)
    for used, named in zip(sets, pairs, strict=True):
        assert sorted(used.collect()) == sorted(named.collect())


def test_pairs_of_unequal_size_beside_a_hub(spark, rows):
    """Links just above the limit whose sets differ in size, and a third set that takes the place of
    their hub: the smaller set's prefix holds n-grams that lie beyond the larger one's."""
    pick = random.Random(6)
    late = [f"late{i}" for i in range(400)]
    texts = [[f"f{k}x{i}" for i in range(1700)] + late for k in range(5)]
    sizes = [(100, 80, 78), (100, 78, 77), (400, 312, 306)]
    while len(sizes) < 15:
        x = pick.randrange(60, 400)
        y = pick.randrange(78 * x // 100, 90 * x // 100)
        sizes.append((x, y, -(-75 * (x + y) // 175)))
    for t, (x, y, common) in enumerate(sizes):
        needed = x - -(-75 * x // 100) + 1 - (x - common)
        shared = [f"t{t}c{i}" for i in range(common)]
        texts += [[f"e{t}x{k}x{i}" for i in range(1200)] + shared[needed:] for k in range(2)]
        texts.append(shared + [f"t{t}a{i}" for i in range(x - common)])
        texts.append(shared + [f"t{t}b{i}" for i in range(y - common)])
        texts.append(shared[:needed] + late[: (x + y) // 2 - needed])
    made = [(i, " ".join(words)) for i, words in enumerate(texts)]
    frame = spark.createDataFrame(made, "doc_id long, text string").coalesce(1)
    found = rows(jaccard.jaccard_classes(frame, size=1))
    assert found == sorted(brute_classes(made, size=1), key=str)


def test_components_equal_union_find(spark, rows):
    pick = random.Random(5)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(170)]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    expected = sorted(((i, root(i)) for a, b in links for i in (a, b) if a != b), key=str)
    found = rows(components(spark.createDataFrame(links, "a long, b long")))
    assert found == sorted(set(expected), key=str)


# 3 token counts and 5 packing


def whole_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(whole_ids, "library"):
        whole_ids.library = Tokenizer.from_file(vocabulary())
    return whole_ids.library.encode(text or "", add_special_tokens=False).ids


TRICKY = ["it's <|endoftext|> don't", "á é", "x y z\x1cq\x85r", "ÀÉß ªº ÿŸ İI",
          "<|startoftext|>x<|endoftext|>", "12 3.5e6 ... !!", "日本語 テキスト", "'S 'LL word's", "Σας ΟΔΟΣ"]


def test_counts_equal_the_library(spark, documents, odd, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in documents]
    rows += [(10_000 + i, t) for i, t in enumerate(TRICKY)]
    found = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary(), 2048)
    expected = {d: (len((t or "").encode()), n := len(whole_ids(t)), n > 2048) for d, t in rows}
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == expected
    counted = tokens.count_tokens(odd, vocabulary(), 2048).select("n_bytes", "n_tokens").collect()
    texts = [r["text"] for r in odd.collect()]
    assert sorted(map(tuple, counted)) == sorted((len((t or "").encode()), len(whole_ids(t))) for t in texts)


def test_small_memory_gives_the_same_ids(documents, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 50)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 100)
    library = tokens.WordTexts(open(vocabulary(), "rb").read())
    for text in [*TRICKY, *(r["text"] for r in documents[:20])]:
        assert np.frombuffer(library.ids(text.encode()), "<u4").tolist() == whole_ids(text)


def test_words_of_many_texts_are_learnt_at_once(documents, monkeypatch):
    library = tokens.WordTexts(open(vocabulary(), "rb").read())
    learnt = []
    learn = library._learn
    monkeypatch.setattr(library, "_learn", lambda words: (learnt.append(len(words)), learn(words)))
    texts = [*TRICKY, "", *(r["text"] or "" for r in documents[:50])]
    found = [np.frombuffer(x, "<u4").tolist() for x in library.each_ids(t.encode() for t in texts)]
    assert found == [whole_ids(t) for t in texts] and len(learnt) == 1
    assert list(library.counts(t.encode() for t in texts)) == [len(x) for x in found]
    monkeypatch.setattr(tokens, "SLICE_BYTES", 300)  # some texts are longer, others share a slice
    assert list(library.counts(t.encode() for t in texts)) == [len(x) for x in found]


def test_words_are_remembered_in_little_memory():
    import gc
    import tracemalloc

    library = tokens.WordTexts(open(vocabulary(), "rb").read())
    library.ids(b"any")
    letters = "abcdefghij"
    names = ["".join(letters[int(d)] for d in f"{n:07d}") for n in range(0, 4_000_000, 80)]
    gc.collect()
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    for at in range(0, len(names), 10_000):
        library.ids(" ".join(names[at : at + 10_000]).encode())
    gc.collect()
    used = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert used < 150 * len(names)  # each is kept as a word and as a run of letters


def test_words_with_one_hash_keep_their_ids(documents, monkeypatch):
    monkeypatch.setattr(tokens.Memo, "_hashes", staticmethod(lambda words: np.full(len(words), 7)))
    monkeypatch.setattr(tokens, "LONG_BYTES", 12)
    monkeypatch.setattr(tokens, "LEARN_WORDS", 5)
    library = tokens.WordTexts(open(vocabulary(), "rb").read())
    for text in [*TRICKY, *(r["text"] or "" for r in documents[:5])] * 2:
        assert np.frombuffer(library.ids(text.encode()), "<u4").tolist() == whole_ids(text)


def test_packing_gives_memory_back_after_each_slice(monkeypatch):
    calls = []
    monkeypatch.setattr(packing, "SLICE_BYTES", 4)
    monkeypatch.setattr(packing, "give_back", lambda: calls.append(1))
    library = tokens.WordTexts(open(vocabulary(), "rb").read())
    record = pa.RecordBatch.from_pydict({"id": [1, 2, None], "text": ["a b c", None, "d" * 9]})
    pieces = np.concatenate(list(packing._pieces(library, record, 2, bytes(4))))
    assert len(calls) == 2 and sorted(pieces["named"].tolist()) == [0] * (len(pieces) - 3) + [1] * 3


def test_packing_workers_do_not_load_pandas():
    import subprocess
    import sys

    code = "import sys, tillcast.llm.packing; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0


def test_other_vocabularies(spark):
    import public_tokenizers as P

    rows = [(1, "a  b\nc"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from tokenizers import Tokenizer

    expected = len(Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(rows[0][1]).ids)
    found = tokens.count_tokens(docs, P.path("byte_bpe_50k.json"), 2048).collect()
    assert [r["n_tokens"] for r in sorted(found)] == [expected, 0]
    assert tokens.count_tokens(docs, P.path("piece_bpe_32k.model"), 2048).count() == 2


def check_packing(found, docs, limit):
    expected = collections.Counter()
    for doc, text in docs:
        ids = np.array([*whole_ids(text), 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            expected[doc, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter(tuple(r[:5]) for r in found) == expected
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


@pytest.mark.parametrize("limit", [128, 4096])
def test_packing_places_every_piece(spark, documents, limit):
    docs = [(r["doc_id"], r["text"]) for r in documents]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = packing.pack_documents(frame, vocabulary(), limit).collect()
    least = math.ceil(sum(len(whole_ids(t)) + 1 for _, t in docs) / limit)
    assert check_packing(found, docs, limit) <= 1.03 * least + 1


def test_packing_odd_rows_in_small_rounds(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 4)
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_packing(packing.pack_documents(odd, vocabulary(), 4096).collect(), docs, 4096)
    assert packing.pack_documents(empty, vocabulary(), 4096).count() == 0


def test_first_bins_are_made_in_one_python_function(spark, documents, monkeypatch):
    plans, keep = [], packing.materialize

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(packing, "materialize", noted)
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in documents], "doc_id long, text string")
    packing.pack_documents(docs, vocabulary()).count()
    assert plans[0].count("MapIn") == 1  # two would be two workers of each task


def test_best_fit_takes_the_fullest_bin():
    assert sorted(map(sorted, packing.best_fit(np.array([6, 5, 4, 5, 10]), 10))) == [[0, 2], [1, 3], [4]]


# 4 exact top-k


def brute_top(rows, k):
    sound = {}
    for number, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound[number] = (i, [math.floor(64 * x) for x in v])
    out = set()
    for i in {i for i, _ in sound.values() if i % 20 == 0}:
        own = min(v for j, v in sound.values() if j == i)
        scores = sorted((-sum(map(lambda a, b: a * b, own, v)), j) for j, v in sound.values() if j != i)
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])}
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    for name, size in (("BLOCK_ROWS", 16), ("CELL_BLOCKS", 3), ("CELL_QUERIES", 4)):
        monkeypatch.setattr(topk, name, size)
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r[0], list(r[1])) for r in table.collect()]
    rows += [(600 + i, rows[i % 3][1]) for i in range(60)]  # ties
    rows += [(700, None), (701, [None] * 64), (702, [float("nan")] * 64), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(frame, F.col("vec_id") % 20 == 0, 20).collect()
    assert {tuple(r) for r in found} == brute_top(rows, 20) and len(found) == len(set(found))


def test_top_k_of_large_numbers_short_and_few_vectors(spark):
    rows = [(0, [3e9, -2e9, 1e9]), (1, [3e9, 1e9]), (2, [2e9, 1.0, 1.0]), (20, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [[math.floor(64 * x) for x in v] + [0] * (3 - len(v)) for _, v in rows]
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(frame, F.col("vec_id") % 20 == 0).collect()}
    ids = [i for i, _ in rows]
    assert found == {(q, v): dot(whole[ids.index(q)], whole[ids.index(v)]) for q in (0, 20) for v in ids if v != q}
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# 6 quality rules


def test_order_of_rules_changes_nothing(spark, documents, odd):
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in documents], "doc_id long, text string")
    judged = {r["doc_id"]: r["kept"] for r in quality.judge_quality(docs).collect()}
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {d for d, k in judged.items() if k}
    from tillcast.llm.words import Texts
    import pyarrow as pa

    texts = Texts(pa.array([r["text"] for r in documents]))
    names = list(quality.RULES)
    for order in (names, names[::-1]):
        kept = quality.first_rejection(quality.Counts(texts), quality.RULES, order) < 0
        assert kept.tolist() == [judged[r["doc_id"]] for r in documents]
    assert sorted(quality.rule_order(docs)) == sorted(names)


def test_counts_of_odd_rows(odd, empty):
    texts = collections.Counter((r["text"] or "") for r in odd.collect())
    found = collections.Counter(r["n_words"] for r in quality.judge_quality(odd).collect())
    assert found == collections.Counter(len(WORD.findall(t)) for t in texts.elements())
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.judge_quality(empty).count() == quality.keep_good(empty).count() == 0


def test_counts_equal_brute_force(monkeypatch):
    import pyarrow as pa

    from tillcast.llm import words
    from tillcast.llm.words import Texts

    monkeypatch.setattr(words, "PIECE_BYTES", 64)
    pick = random.Random(2)
    texts = ["".join(pick.choices(["a ", "b ", "a", "\n", "é", "\n\n", "#", "A B C "], k=pick.randrange(60))) for _ in range(200)]
    made = quality.Counts(Texts(pa.array(texts)))
    for i, t in enumerate(texts):
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = {g for g, n in collections.Counter(grams).items() if n > 1}
        covered = {k + j for k, g in enumerate(grams) if g in often for j in range(3)}
        expected = [len(w), sum(map(len, w)), t.count("#"), len(lines) - len(set(lines)), len(covered)]
        assert [int(made(c)[i]) for c in quality.DIGEST] == expected


# 7 language-model scores


def slow_ppm(training, text):
    """Probability by the definition, one byte at a time."""
    followers = collections.defaultdict(collections.Counter)
    for t in training:
        run = b"\n" * ppm.ORDER + t + b"\n"
        for i in range(ppm.ORDER, len(run)):
            for order in range(ppm.ORDER + 1):
                followers[run[i - order : i]][run[i]] += 1
    run, total = b"\n" * ppm.ORDER + text + b"\n", 0.0
    for i in range(ppm.ORDER, len(run)):
        excluded = set()
        for order in range(ppm.ORDER, -1, -1):
            seen = followers.get(run[i - order : i], {})
            open_ = {s: n for s, n in seen.items() if s not in excluded}
            if open_:
                whole = sum(open_.values()) + len(open_)
                if run[i] in open_:
                    total += math.log10(open_[run[i]] / whole)
                    break
                total += math.log10(len(open_) / whole)
                excluded |= set(open_)
        else:
            total -= math.log10(256 - len(excluded))
    return total


@pytest.mark.parametrize("head", [1 << 20, 8])
def test_scores_equal_the_definition(spark, head, monkeypatch):
    monkeypatch.setattr(ppm, "HEAD_WORDS", head)
    pick = random.Random(4)
    rows = [(i, " ".join(pick.choices(["the", "The", "then", "a", "é", "zz", "  "], k=pick.randrange(25)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "the odd"), (101, "")]
    found = ppm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    low = [(d, WORD.findall((t or "").lower())) for d, t in rows]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    train = [w for d, w in low if not held(d)]
    counts = collections.Counter(x for w in train for x in [*w, None])
    n, v = sum(counts.values()), len(counts)
    expected = collections.Counter()
    for d, w in low:
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None])
        score = slow_ppm([" ".join(x).encode() for x in train], " ".join(w).encode())
        known = sum(x in counts for x in [*w, None])
        expected[d, held(d), len(w) + 1, known, n, round(base, 6), round(score, 6)] += 1
    assert collections.Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in found) == expected


def test_probabilities_sum_to_one():
    pick = np.random.default_rng(1)
    grams = np.unique(pick.integers(0, 4, (300, ppm.ORDER + 1)) @ (256 ** np.arange(ppm.ORDER + 1)))
    levels = ppm.trie_levels(grams, pick.integers(1, 9, len(grams)))
    for context in (0, 1, int(grams[5] >> 8), 77 << 16, 3):
        every = (context << 8) + np.arange(256)
        assert abs((10 ** ppm.gram_log10(levels, every)).sum() - 1) < 1e-9


def test_scores_without_training_or_rows(spark, empty):
    frame = spark.createDataFrame([(None, "ab")], "doc_id long, text string")
    (row,) = ppm.score_texts(frame).collect()
    assert (row["train_tokens"], row["n_known"]) == (0, 0) and abs(row["score"] + 3 * math.log10(256)) < 1e-9
    assert ppm.score_texts(empty).count() == 0


@pytest.mark.parametrize("head", [40, 0])
def test_runs_beyond_the_broadcast_are_joined(spark, head, monkeypatch):
    monkeypatch.setattr(ppm, "HEAD_GRAMS", head)
    pick = random.Random(6)
    rows = [(i, " ".join(pick.choices(["the", "then", "a", "é", "zz", "odd"], k=pick.randrange(25)))) for i in range(60)]
    rows += [(None, "the odd zebra QUIZ"), (None, None), (None, "\u4e00 thenthe"), (101, "")]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    low = [(d, " ".join(WORD.findall((t or "").lower())).encode()) for d, t in rows]
    train = [w for d, w in low if not held(d)]
    expected = collections.Counter((d, round(slow_ppm(train, w), 6)) for d, w in low)
    found = ppm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert collections.Counter((r["doc_id"], round(r["score"], 6)) for r in found) == expected


def test_shedding_rare_runs_keeps_a_model(spark, documents, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in documents[:60]]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["doc_id"]: r["score"] for r in ppm.score_texts(frame).collect()}
    monkeypatch.setattr(ppm, "GRAMS", 2000)
    small = {r["doc_id"]: r["score"] for r in ppm.score_texts(frame).collect()}
    assert sum(small.values()) < sum(whole.values()) < 0


# 8 secret scans


def test_forest_tells_keys_from_look_alikes(spark):
    pick = random.Random(8)
    hexes = lambda n: "".join(pick.choices("0123456789abcdef", k=n))
    prose = lambda: " ".join(pick.choices(["alpha", "beta", "gamma", "delta", "the"], k=12))
    rows, keys = [], {}
    for i in range(600):
        key = hexes(40)
        kind = i % 4
        text = [f'token = "{key}"', f"number {pick.randrange(10**16, 10**17)}", "betagammadeltaalphabeta", prose()][kind]
        rows.append((i, f"{prose()} {text} {prose()}", "src"))
        if kind == 0:
            keys[i] = key
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    train, held = frame.filter("doc_id < 400"), frame.filter("doc_id >= 400")
    language = secrets.learn_language(train)
    findings = secrets.labelled_findings(train, language, "text", "source")
    assert {r["label"] for r in findings.select("label").distinct().collect()} == {0.0, 1.0}
    scanned = secrets.scan_secrets(held, findings)
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    found = {r["row"]["doc_id"]: {f["text"] for f in r["findings"] if f["is_secret"]} for r in scanned.collect()}
    wrong = sum(f != ({keys[d]} if d in keys else set()) for d, f in found.items())
    assert wrong <= 0.02 * len(found)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(scanned).collect()}
    before = {r[0]: r[1] for r in rows}
    for d, text in clean.items():
        expected = before[d]
        for key in found[d]:
            expected = expected.replace(key, "[SECRET]")
        assert text == expected


def test_a_secret_within_a_longer_one_leaves_no_rest(spark):
    """Whatever their order in the text; and one that stands in many places goes everywhere."""
    short, long = "A1b2C3d4E5f6G7h8", "A1b2C3d4E5f6G7h8ZZtop99secretTail0"
    texts = [f"{short} and {long}", f"{long} then {short} {long}", f"x{short}y", None]
    found = "array<struct<text string, is_secret boolean>>"
    rows = [((i, t), [(short, True), (long, True), ("harmless", False)]) for i, t in enumerate(texts)]
    scanned = spark.createDataFrame(rows, f"row struct<doc_id long, text string>, findings {found}")
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(scanned).collect()}
    assert clean == {0: "[SECRET] and [SECRET]", 1: "[SECRET] then [SECRET] [SECRET]",
                     2: "x[SECRET]y", 3: None}


def test_transitions_equal_brute_force_and_long_candidates_end(spark):
    signs = "abcdefghijklmnopqrstuvwxyz0123456789"
    pick = random.Random(6)
    language = secrets.Language(tuple(pick.uniform(-6, -1) for _ in range(36**2)), ("word",))
    texts = ["".join(pick.choices("abcxyzABC012_+/", k=n)) for n in (16, 17, 40, 400)] + ["a" * 1_000_000]

    def mean(text):
        rare = min(language.pairs)
        codes = [signs.find(c) for c in text.lower()]
        pairs = [language.pairs[a * 36 + b] if a >= 0 and b >= 0 else rare
                 for a, b in itertools.pairwise(codes)]
        return sum(pairs) / len(pairs)

    frame = spark.createDataFrame([(t, "src") for t in texts], "text string, source string")
    found = secrets.with_candidates(frame, language).select("candidates").collect()
    got = {c["text"]: c["features"]["transitions"] for r in found for c in r["candidates"]}
    assert set(got) == set(texts)
    for text in texts:
        assert got[text] == pytest.approx(mean(text), abs=1e-5)


def test_language_is_counted_on_all_documents(spark, monkeypatch):
    """However small the sample for labelled findings; the dictionary holds rarer words too."""
    names = ["".join(x) for x in itertools.product("bcdfg", "aeiou", "klmnp", "aeiou")]
    rows = [(i, f"{name} {name} {'x' * 100} zq9", "src") for i, name in enumerate(names)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    monkeypatch.setattr(secrets, "SAMPLE_DOCS", 5)
    seen = []
    learn = secrets.learn_language
    monkeypatch.setattr(secrets, "learn_language", lambda *a: seen.append(learn(*a)) or seen[-1])
    secrets.scan_secrets(frame)
    pairs = collections.Counter()
    for _, text, _ in rows:
        for word in re.findall("[a-z0-9]+", text):
            pairs.update(a + b for a, b in itertools.pairwise(word))
    total = sum(pairs.values()) + 36**2
    signs = "abcdefghijklmnopqrstuvwxyz0123456789"
    expected = [math.log10((pairs[a + b] + 1) / total) for a in signs for b in signs]
    assert np.allclose(seen[0].pairs, expected) and set(seen[0].words) == set(names)


def test_dictionary_pattern_finds_the_longest_word():
    pick = random.Random(3)
    words = {"".join(pick.choices("abc", k=pick.randrange(1, 7))) for _ in range(200)}
    slow = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    pattern = secrets._any_word(tuple(words))
    for _ in range(300):
        text = "".join(pick.choices("abcd", k=30))
        assert re.sub(pattern, "-", text) == re.sub(slow, "-", text)
    assert not re.search(secrets._any_word(()), "any")


def test_scans_of_odd_rows(spark, odd, empty):
    scanned = secrets.scan_secrets(odd)
    assert scanned.count() == odd.count()
    assert secrets.redact(scanned).columns == odd.columns
    assert sorted(r["text"] or "" for r in secrets.redact(scanned).collect()) == sorted(r["text"] or "" for r in odd.collect())
    assert secrets.scan_secrets(empty).count() == 0


# 9 mixing


def slow_targets(sizes, weights, share, most):
    """By the words of the rule: share, stop, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, total = dict.fromkeys(names, 0.0), share * sum(sizes.values())
    open_ = set(names)
    while total > 1e-9 and open_:
        each = total / sum(weight[s] for s in open_)
        total = 0.0
        for s in list(open_):
            target[s] += each * weight[s]
            if target[s] >= most * sizes[s]:
                total += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_the_rule(spark, seed):
    pick = random.Random(seed)
    sizes = {s: pick.choice([0, 5, 100, 1000, 10**6]) for s in ["z", "é", "a", "B", "b", "", None]}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(frame, (5.0, 2.0, 1.0), 1.5, 2.0).collect()}
    expected = slow_targets(sizes, (5.0, 2.0, 1.0), 1.5, 2.0)
    assert found.keys() == expected.keys()
    assert all(abs(found[s] - expected[s]) < 1e-6 * (1 + expected[s]) for s in found)


def test_quotas_equal_one_seat_at_a_time(spark):
    pick = random.Random(9)
    rows = [(s, f"c{c}", pick.choice([0.0, 3.0, 50.5, 700.0, 9000.0]) * pick.random()) for s in range(6) for c in range(7)]
    found = mixing.block_quotas(spark.createDataFrame(rows, "shard int, source string, wanted double"), 16)
    quotas = {(r["shard"], r["source"]): r["blocks"] for r in found.collect()}
    for shard in range(6):
        own = {c: w for s, c, w in rows if s == shard}
        heap = [(-w, c, 0) for c, w in own.items() if w > 0]
        heapq.heapify(heap)
        seats = collections.Counter()
        for _ in range(math.floor(sum(own.values()) / 16 + 0.5)):
            _, c, j = heapq.heappop(heap)
            seats[c] += 1
            heapq.heappush(heap, (-own[c] / (2 * j + 3), c, j + 1))
        assert {c: quotas[shard, c] for c in own} == {c: seats[c] for c in own}


@pytest.mark.parametrize("rows_each", [7, 20_000])
def test_mix_comes_near_its_targets(spark, rows_each, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", rows_each)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("taken", F.lit("clash"))
    first = mixing.mix_sources(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    again = mixing.mix_sources(docs, keep=["doc_id", "source"]).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    assert sorted(first) == sorted(again) and len(first) == docs.count()
    taken = collections.Counter()
    for r in first:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for r in first:
        assert abs(taken[r["source"]] - r["target"]) <= 0.02 * r["target"] + 2


def test_mix_of_odd_rows(odd, empty):
    found = mixing.mix_sources(odd).collect()
    assert len(found) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in found)
    assert mixing.mix_sources(empty).count() == 0


# 10 sharding


def test_shards_are_even_and_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 40)
    path = str(tmp_path / "records")
    spark.range(1003).select("id", F.lit(5).alias("shard"), (F.col("id") % 3).alias("slot")).write.parquet(path)
    records = spark.read.parquet(path)
    found = sharding.shard_records(records, 16, bytes_each=1).collect()
    assert sorted(r["row"]["id"] for r in found) == list(range(1003))
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(s) for s in slots.values()} <= {62, 63} and len(slots) == 16
    order = [r["row"]["id"] for r in sorted(found, key=lambda r: (r["slot"], r["shard"]))]
    rising = sum(a < b for a, b in zip(order, order[1:], strict=False))
    assert 420 < rising < 580
    again = sharding.shard_records(records, 16, bytes_each=1).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_buckets_follow_the_measured_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 1 << 20)
    made = spark.range(100).select("id", F.repeat(F.lit("é"), 20_000).alias("text"))
    made.write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    held = []
    keep = sharding.materialize
    monkeypatch.setattr(sharding, "materialize", lambda df, label: held.append(keep(df, label)) or held[-1])
    assert sharding.shard_records(wide, 4).count() == 100
    fullest = held[0].groupBy("bucket").agg(F.sum(F.octet_length("row.text")).alias("n"))
    assert fullest.agg(F.max("n")).first()[0] <= 2 << 20
    assert sharding.buckets_for(64 << 20, 1 << 10) == 64
    assert sharding.buckets_for(64 << 20, 1 << 19) == 256
    assert sharding.buckets_for(64 << 20, 1 << 30) == 512
    assert sharding.buckets_for(0, 0) == 1


def test_sharding_query_moves_whole_documents(spark, monkeypatch):
    given = []
    shard = sharding.shard_records
    monkeypatch.setattr(sharding, "shard_records", lambda r, n: given.append(r) or shard(r, n))
    found = QUERIES["op10_sharding"](spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert given[0].columns == docs.columns
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    expected = sorted((d, len(t) + 1, zlib.crc32(t)) for d, t in texts)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected


def test_written_shards_keep_the_order(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    sharded = sharding.shard_records(docs, 4)
    sharding.write_shards(sharded, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    expected = {(r["row"]["doc_id"], r["shard"], r["slot"]) for r in sharded.collect()}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in back.collect()} == expected


def test_shards_of_odd_rows(odd, empty, spark, tmp_path):
    odd.write.parquet(str(tmp_path / "odd"))
    assert sharding.shard_records(spark.read.parquet(str(tmp_path / "odd")), 16).count() == odd.count()
    assert sharding.shard_records(empty, 16).count() == 0


# the queries


NATIVE = ["op1_chat_formatting", "op8_secret_scans", "op9_source_mixing", "op10_sharding"]


@pytest.mark.parametrize("key", NATIVE)
def test_native_queries_run_no_python(spark, key):
    plan = QUERIES[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_secret_query_finds_the_planted_tokens(spark, documents):
    planted = {(r["doc_id"], m) for r in documents for m in re.findall(r'token = "([0-9a-f]{40})"', r["text"] or "")}
    found = QUERIES["op8_secret_scans"](spark, FOLDER).filter("is_secret").collect()
    import hashlib

    got = {(r["doc_id"], r["finding_sha256"]) for r in found}
    assert {(d, hashlib.sha256(m.encode()).hexdigest()) for d, m in planted} <= got
    assert all(r["length"] == 40 for r in found)
