import re

import numpy as np
import pyarrow as pa
import pytest

from tillcast.llm import words
from tillcast.llm.words import Texts, batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    "a b  a\tB\nb",
    None,
    "",
    "   ",
    "é é é x",
    "last",
    "last next",
    "x" * 300 + " y " * 50,
    "\x1cword\x85",
]


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
@pytest.mark.parametrize("fold", [False, True])
def test_words_equal_the_pattern(monkeypatch, piece, fold):
    monkeypatch.setattr(words, "PIECE_BYTES", piece)
    texts = Texts(pa.array(TEXTS), fold)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    expected = [WORD.findall((t or "").translate(lower) if fold else t or "") for t in TEXTS]
    assert texts.counts.tolist() == [len(w) for w in expected]
    flat = [w for ws in expected for w in ws]
    by_word, by_hash = {}, {}
    for w, h in zip(flat, texts.words.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h and by_hash.setdefault(h, w) == w


def test_windows_stay_within_a_text():
    texts = Texts(pa.array(["a b c", "a b c d", "c"]))
    hashes, whole = texts.windows(3)
    assert whole.tolist() == [True, False, False, True, True, False, False, False]
    assert hashes[0] == hashes[3] != hashes[4]


def test_batches_cut_by_bytes_keep_every_row():
    record = pa.record_batch({"k": pa.array(range(9)), "t": pa.array(TEXTS)})
    parts = list(batches(record, "t", False, most_bytes=10))
    assert [k for p, _ in parts for k in p.column("k").to_pylist()] == list(range(9))
    assert np.concatenate([t.counts for _, t in parts]).tolist() == Texts(pa.array(TEXTS)).counts.tolist()


def test_empty_column():
    assert len(Texts(pa.array([], pa.string()))) == 0
    assert Texts(pa.array([], pa.string())).words.tolist() == []


def test_a_batch_gives_its_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(words, "give_back", lambda: calls.append(1))
    record = pa.RecordBatch.from_pydict({"text": ["a b", None, "c", "d" * 9]})
    assert sum(len(part) for part, _ in words.batches(record, "text", False, 4)) == 4
    assert calls == [1]
    monkeypatch.undo()
    words.give_back()
