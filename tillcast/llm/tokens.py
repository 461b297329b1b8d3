"""Token counts of whole texts by a public tokenizer's vocabulary file.

Texts go through Arrow functions that return lengths only. The tokenizer sees batches of equal
size in bytes, and long texts are cut where no token can cross: at ASCII white space, which the
word tokenizers drop before they encode. Equal words get equal tokens, so a batch holds each
word that the worker hasn't met lately once. A vocabulary that keeps white space is given whole
texts instead.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tillcast.llm.words import Texts, batches, give_back

#: Bytes of texts that are split into words at once, and of words encoded at once.
SLICE_BYTES, BATCH_BYTES = 1 << 21, 1 << 15
#: Words that a worker remembers, and their bytes; it then starts anew. Longer words than LONG_BYTES are
#: learnt each time. This bounds memory, not what is counted.
MEMO_WORDS, MEMO_BYTES, LONG_BYTES = 1_000_000, 1 << 26, 256
#: Words that are Python objects at once while they are looked up or learnt.
LEARN_WORDS = 1 << 15

# How the word tokenizer that drops white space is set up in its file.
_NORMAL_FORM = ["NFC", "Replace", "Lowercase"]
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Letters whose small form is one letter of the same set, then signs that start no contraction
# and no special token.
_PLAIN_LINE = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,;:!?|$%&*#]*)\n|([^\n]*)\n")


class WholeTexts:
    """Token ids of whole texts, for vocabularies in which white space counts."""

    def __init__(self, blob: bytes, kind: str):
        if kind == ".model":
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_proto=blob)
            self._encode = lambda text: library.encode(text, num_threads=1)
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(blob.decode())
            library.no_truncation()
            library.no_padding()
            self._encode = lambda text: library.encode(text, add_special_tokens=False).ids

    def ids(self, text: bytes) -> bytes:
        return np.array(self._encode(text.decode("utf-8", "replace")), "<u4").tobytes()

    def each_ids(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        return map(self.ids, texts)

    def counts(self, texts: Iterable[bytes]) -> Iterator[int]:
        return (len(self.ids(text)) // 4 for text in texts)


def _objects(words: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls; ``to_pylist`` takes some times longer."""
    _, offsets, data = words.buffers()
    limits = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    if not len(words) or limits[0] == limits[-1]:
        return [b""] * len(words)
    first = int(limits[0])
    data = data[first : int(limits[-1])].to_pybytes()
    limits = (limits - first).tolist()
    return [data[low:high] for low, high in zip(limits, limits[1:], strict=False)]


class Memo:
    """Token ids of words in flat arrays: some 40 bytes a word, of which Python objects take 200."""

    def __init__(self):
        self.words = self.ids = pa.array([], pa.binary())
        self._keys = np.zeros(0, np.int64)  # hashes, ascending, and the numbers of their words
        self._numbers = np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.words)

    @staticmethod
    def _hashes(words: pa.Array) -> np.ndarray:
        found = np.empty(len(words), np.int64)
        for at in range(0, len(words), LEARN_WORDS):
            part = _objects(words.slice(at, LEARN_WORDS))
            found[at : at + len(part)] = np.fromiter(map(hash, part), np.int64, len(part))
        return found

    def find(self, words: pa.Array) -> np.ndarray:
        """Number of each word, -1 if it isn't here. Words are compared whole, not by hash alone."""
        found = np.full(len(words), -1, np.int32)
        if len(self) and len(words):
            hashes = self._hashes(words)
            place = np.minimum(np.searchsorted(self._keys, hashes), len(self._keys) - 1)
            like = np.flatnonzero(self._keys[place] == hashes)
            number = self._numbers[place[like]]
            same = pc.equal(self.words.take(pa.array(number)), words.take(pa.array(like)))
            same = same.to_numpy(zero_copy_only=False)
            found[like[same]] = number[same]
        return found

    def add(self, words: pa.Array, ids: pa.Array) -> None:
        """Remember different words that aren't here; not those that are long or share a hash."""
        short = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) <= LONG_BYTES)
        hashes, first = np.unique(self._hashes(words.take(pa.array(short))), return_index=True)
        place = np.searchsorted(self._keys, hashes)
        new = np.ones(len(hashes), bool)
        if len(self):
            new = self._keys[np.minimum(place, len(self._keys) - 1)] != hashes
        chosen = pa.array(short[first[new]])
        numbers = np.arange(len(self), len(self) + len(chosen), dtype=np.int32)
        self._keys = np.insert(self._keys, place[new], hashes[new])
        self._numbers = np.insert(self._numbers, place[new], numbers)
        self.words = pa.concat_arrays([self.words, words.take(chosen)])
        self.ids = pa.concat_arrays([self.ids, ids.take(chosen)])

    def has_room(self, more: int = 0) -> bool:
        return len(self) + more <= MEMO_WORDS and self.words.nbytes + self.ids.nbytes <= MEMO_BYTES


class WordTexts:
    """Token ids of texts from the ids of their words, as little-endian 32-bit numbers."""

    def __init__(self, blob: bytes):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_str(blob.decode())
        self._library.no_truncation()
        self._library.no_padding()
        suffix = json.loads(blob)["model"]["end_of_word_suffix"]
        vocabulary = self._library.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._words, self._parts = Memo(), Memo()

    @staticmethod
    def fits(blob: bytes) -> bool:
        """Whether this file's tokenizer drops white space, in the way this class relies on."""
        setup = json.loads(blob)
        normal, before = setup.get("normalizer") or {}, setup.get("pre_tokenizer") or {}
        steps = [x["type"] for x in normal.get("normalizers", [])]
        split = (before.get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        suffix = setup["model"].get("end_of_word_suffix")
        return steps == _NORMAL_FORM and split == _WORD_PATTERN and bool(suffix)

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Encode runs of letters or of signs, many in one text: each ends with an end token."""
        at, found = 0, []
        while at < len(parts):
            size, stop = 0, at
            while stop < len(parts) and size < BATCH_BYTES:
                size += len(parts[stop]) + 1
                stop += 1
            text = " ".join(parts[at:stop])
            # the same ids as ``encode`` gives, without the offsets that it makes of each token
            ids = self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids
            ids = np.array(ids, "<u4")
            cuts = [0, *(np.flatnonzero(self._ends[ids]) + 1).tolist()]
            if len(cuts) != stop - at + 1 or cuts[-1] != len(ids):
                raise ValueError("a run of letters or signs was not one word to the tokenizer")
            raw = ids.tobytes()
            found += [raw[4 * low : 4 * high] for low, high in zip(cuts, cuts[1:], strict=False)]
            at = stop
        return found

    def _part_ids(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of different runs; those that aren't in memory yet are encoded."""
        words = pa.array(parts, pa.string()).cast(pa.binary())
        at = self._parts.find(words)
        known, missing = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        kept = _objects(self._parts.ids.take(pa.array(at[known])))
        of = dict(zip([parts[i] for i in known.tolist()], kept, strict=True))
        if len(missing):
            new = [parts[i] for i in missing.tolist()]
            ids = self._encode_parts(new)
            of.update(zip(new, ids, strict=True))
            self._parts.add(words.take(pa.array(missing)), pa.array(ids, pa.binary()))
        return of

    def _learn(self, words: pa.Array) -> None:
        """Remember different words, and keep their ids as the ones just learnt."""
        learnt = []
        for at in range(0, len(words), LEARN_WORDS):
            learnt.append(self._ids_of(_objects(words.slice(at, LEARN_WORDS))))
        self._learnt = pa.concat_arrays(learnt)
        self._words.add(words, self._learnt)

    def _ids_of(self, words: list[bytes]) -> pa.Array:
        lines = _PLAIN_LINE.findall((b"\n".join(words) + b"\n").decode("utf-8", "replace"))
        small = [letters.lower() for letters, _, _ in lines]
        wanted = {*small, *(signs for _, signs, _ in lines)} - {""}
        of = self._part_ids(list(wanted))
        of[""] = b""
        ids = [of[letters] + of[signs] for letters, (_, signs, _) in zip(small, lines, strict=True)]
        other = [at for at, letters in enumerate(small) if not letters]
        texts = [lines[at][2] for at in other]
        found = self._library.encode_batch_fast(texts, add_special_tokens=False)
        for at, encoding in zip(other, found, strict=True):
            ids[at] = np.array(encoding.ids, "<u4").tobytes()
        return pa.array(ids, pa.binary())

    @staticmethod
    def _slices(text: bytes) -> Iterator[bytes]:
        low = 0
        while low < len(text):
            high = low + SLICE_BYTES
            gap = re.compile(rb"[ \t-\r]").search(text, high)
            high = gap.start() if gap and high < len(text) else len(text)
            yield text[low:high]
            low = high

    def _known(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of different words and each word's place there; what isn't in memory yet is learnt at once."""
        at = self._words.find(words)
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return self._words.ids.take(pa.array(at)), np.arange(len(words))
        if not (self._words.has_room(len(missing)) and self._parts.has_room()):
            self._words, self._parts = Memo(), Memo()
            at[:] = -1
            missing = np.arange(len(words))
        known = np.flatnonzero(at >= 0)
        kept = self._words.ids.take(pa.array(at[known]))
        self._learn(words.take(pa.array(missing)))
        place = np.empty(len(words), np.int64)
        place[known] = np.arange(len(known))
        place[missing] = np.arange(len(known), len(words))
        return pa.concat_arrays([kept, self._learnt]), place

    def _words_of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Words of each text: where its numbers begin (and the last end), places of words, and
        the ids of the different words. Python meets each different word once."""
        limits = np.concatenate([[0], np.cumsum([len(text) for text in texts])])
        buffers = [None, pa.py_buffer(limits), pa.py_buffer(b"".join(texts))]
        lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), buffers))
        words = lists.flatten().dictionary_encode()
        found, place = self._known(words.dictionary.cast(pa.large_binary()).cast(pa.binary()))
        return lists.offsets.to_numpy(), place[words.indices.to_numpy()], found

    def _each(self, texts: Iterable[bytes], made: Callable) -> Iterator[list]:
        """For each text what ``made`` makes of its slices. Short texts are held until they make a
        slice, as words are learnt faster many at once."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            if held and size + len(text) > SLICE_BYTES:
                yield from ([x] for x in made(held))
                held, size = [], 0
            if len(text) > SLICE_BYTES:
                yield [found for part in self._slices(text) for found in made([part])]
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from ([x] for x in made(held))

    def _slice_ids(self, texts: list[bytes]) -> Iterator[bytes]:
        limits, words, found = self._words_of(texts)
        ids = found.cast(pa.large_binary()).take(pa.array(words))
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[limits] if len(words) else np.zeros(len(limits), np.int64)
        data = memoryview(data or b"")
        cuts = ends.tolist()
        return (bytes(data[low:high]) for low, high in zip(cuts, cuts[1:], strict=False))

    def _slice_counts(self, texts: list[bytes]) -> list[int]:
        limits, words, found = self._words_of(texts)
        sizes = pc.binary_length(found).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        return np.diff(np.concatenate([[0], np.cumsum(sizes[words])])[limits]).tolist()

    def each_ids(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Ids of each text, in order."""
        return map(b"".join, self._each(texts, self._slice_ids))

    def counts(self, texts: Iterable[bytes]) -> Iterator[int]:
        """Number of ids of each text, in order."""
        return map(sum, self._each(texts, self._slice_counts))

    def ids(self, text: bytes) -> bytes:
        return next(self.each_ids([text]))


_ENCODERS: dict[tuple[str, int], WordTexts | WholeTexts] = {}


def encoder(blob: bytes, kind: str) -> WordTexts | WholeTexts:
    """The worker's encoder for a vocabulary file; it stays for later tasks. A task has one core, so
    the library takes no threads, each of which would keep memory of its own."""
    key = (kind, zlib.crc32(blob))
    if key not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        words = kind == ".json" and WordTexts.fits(blob)
        _ENCODERS[key] = WordTexts(blob) if words else WholeTexts(blob, kind)
        give_back()
    return _ENCODERS[key]


def sent_vocabulary(docs: DataFrame, path: str):
    """The vocabulary file (some MB, whatever the number of texts), broadcast, and its kind."""
    blob = Path(path).read_bytes()
    return docs.sparkSession.sparkContext.broadcast(blob), Path(path).suffix


def text_bytes(texts: Texts) -> Iterator[bytes]:
    limits = texts.limits.tolist()
    for low, high in zip(limits, limits[1:], strict=False):
        yield texts.data[low:high].tobytes()


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    No begin, end or other special token is added; strings of special tokens inside a text are
    what the library makes of them by default. A null or empty text has 0 bytes and tokens. Rows
    stay as they are: a null or repeated id gives a row each. Other columns are not read.
    ``vocabulary``: path, on the driver, of a tokenizers .json or a sentencepiece .model file.
    """
    blob, kind = sent_vocabulary(docs, vocabulary)

    def lengths(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(blob.value, kind)
        for record in records:
            for part, texts in batches(record, "text", False, SLICE_BYTES):
                n = np.fromiter(library.counts(text_bytes(texts)), np.int64, len(part))
                size = np.diff(texts.limits)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(size), pa.array(n), pa.array(n > limit)],
                    names=[id, "n_bytes", "n_tokens", "over_limit"],
                )
                give_back()

    kind_of_id = docs.schema[id].dataType.simpleString()
    return docs.select(docs[id].alias("id"), docs[text].alias("text")).mapInArrow(
        lengths, f"`{id}` {kind_of_id}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
