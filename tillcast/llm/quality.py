"""Quality rules as a cascade: the rule that rejects most for its cost is asked first.

Every rule is an exact integer comparison on counts of the whole text, and a document is kept if
no rule rejects it, so the order changes the time only. The order comes from a sample: the
first documents of every partition, on which each rule's time and share of rejections are measured.
Later rules see only the documents that are left.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.words import _WHITE, PIECE_BYTES, Texts, batches, mix, run_hashes

#: Documents of each partition that cost and selectivity are estimated on.
SAMPLE_ROWS = 64
#: The texts are copied for the next rule once it needs less than this share of them.
COPY_BELOW = 0.75

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def n_words(texts: Texts) -> np.ndarray:
    return texts.counts


def word_chars(texts: Texts) -> np.ndarray:
    """Code points in words."""
    return texts.sums(((texts.data & 0xC0) != 0x80) & ~_WHITE[texts.data])


def n_symbols(texts: Texts) -> np.ndarray:
    return texts.sums(_SYMBOL[texts.data])


def n_dup_lines(texts: Texts) -> np.ndarray:
    r"""Lines, split at \n, that hold a word and equal an earlier line of the same text."""
    if not len(texts.data):
        return np.zeros(len(texts), np.int64)
    breaks = np.flatnonzero(texts.data == 10)
    starts = np.union1d(texts.limits[:-1], breaks + 1)
    starts = starts[starts < len(texts.data)]
    ends = np.append(starts[1:], len(texts.data))
    ends = ends - (texts.data[ends - 1] == 10) if len(ends) else ends
    inked = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(~_WHITE[texts.data], out=inked[1:])
    wordy = inked[ends] > inked[starts]
    starts, ends = starts[wordy], ends[wordy]
    hashes = np.zeros(len(starts), np.uint64)
    for low, high in _line_pieces(starts, ends):
        base = starts[low]
        hashes[low:high] = run_hashes(
            texts.data[base : ends[high - 1]], starts[low:high] - base, ends[low:high] - base, False
        )
    owner = np.searchsorted(texts.limits, starts, "right") - 1
    return _repeats_per_text(hashes, owner, len(texts))


def _line_pieces(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of lines of about 1 MB, so that no more bytes are hashed at once."""
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + (1 << 20), "right")))
        yield low, high
        low = high


def _repeats_per_text(hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    keys = mix(hashes ^ mix(owner.astype(np.uint64)))
    order = np.argsort(keys)
    again = keys[order][1:] == keys[order][:-1]
    return np.bincount(owner[order][1:][again], minlength=texts)


def n_repeat_words(texts: Texts) -> np.ndarray:
    """Words in windows of three words that the text holds twice or more."""
    hashes, whole = texts.windows(3)
    owner = np.repeat(np.arange(len(texts)), texts.counts)
    at = np.flatnonzero(whole)
    keys = mix(hashes[at] ^ mix(owner[at].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes) + 2, bool)
    for j in range(3):
        covered[at[twice] + j] = True
    return np.bincount(owner[covered[: len(owner)]], minlength=len(texts))


def n_upper(texts: Texts) -> np.ndarray:
    return texts.sums(_UPPER[texts.data])


def n_letters(texts: Texts) -> np.ndarray:
    return texts.sums(_LETTER[texts.data])


def n_lines(texts: Texts) -> np.ndarray:
    return texts.sums(texts.data == 10) + 1


class Counts:
    """Counts of some texts, each made when first asked for."""

    def __init__(self, texts: Texts):
        self.texts = texts
        self._made: dict[Callable, np.ndarray] = {}

    def __call__(self, count: Callable[[Texts], np.ndarray]) -> np.ndarray:
        if count not in self._made:
            self._made[count] = count(self.texts)
        return self._made[count]

    def take(self, keep: np.ndarray) -> Counts:
        left = Counts(self.texts.take(keep))
        left._made = {k: v[keep] for k, v in self._made.items()}
        return left


Rule = Callable[[Counts], np.ndarray]

#: Rules of which each alone fails a document, whatever the others say.
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda c: c(n_words) < 50,
    "repetition": lambda c: 100 * c(n_repeat_words) > 50 * c(n_words),
}
#: All rules. Symbols, word length and lines: thresholds usual for web text.
RULES: dict[str, Rule] = BASE_RULES | {
    "symbols": lambda c: 10 * c(n_symbols) > c(n_words),
    "short_words": lambda c: c(word_chars) < 2 * c(n_words),
    "long_words": lambda c: c(word_chars) > 15 * c(n_words),
    "repeated_lines": lambda c: 100 * c(n_dup_lines) > 30 * c(n_lines),
    "shouting": lambda c: 2 * c(n_upper) > c(n_letters),
}
DIGEST = (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)


def rule_order(docs: DataFrame, rules: dict[str, Rule] = RULES, text: str = "text") -> list[str]:
    """Rules by rejections per second, most first, as measured on the sample."""

    def measure(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            if not len(record):
                continue
            rows = []
            for _, texts in batches(record.slice(0, SAMPLE_ROWS), "text", False):
                for name, rule in rules.items():
                    start = time.perf_counter()
                    rejected = int(rule(Counts(Texts(texts.column))).sum())
                    rows.append((name, rejected, time.perf_counter() - start))
            name, rejected, seconds = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name), pa.array(rejected), pa.array(seconds)],
                names=["rule", "rejected", "seconds"],
            )
            return

    found = (
        docs.select(docs[text].alias("text"))
        .mapInArrow(measure, "rule string, rejected bigint, seconds double")
        .groupBy("rule")
        .agg((F.sum("rejected") / F.greatest(F.sum("seconds"), F.lit(1e-9))).alias("rate"))
        .collect()
    )
    rate = {r["rule"]: r["rate"] for r in found}
    return sorted(rules, key=lambda name: (-rate.get(name, 0.0), name))


def first_rejection(counts: Counts, rules: dict[str, Rule], order: list[str]) -> np.ndarray:
    """Per text the place in ``order`` of the rule that rejects it first, or -1."""
    verdict = np.full(len(counts.texts), -1)
    left = np.arange(len(verdict))  # the texts that counts has
    open_ = np.ones(len(verdict), bool)  # of those, not rejected yet
    for place, name in enumerate(order):
        if not open_.any():
            break
        if open_.mean() < COPY_BELOW:
            counts, left = counts.take(open_), left[open_]
            open_ = np.ones(len(left), bool)
        hit = rules[name](counts) & open_
        verdict[left[hit]] = place
        open_ &= ~hit
    return verdict


def judge_quality(
    docs: DataFrame, rules: dict[str, Rule] = RULES, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: id, the counts of DIGEST, base_failed, kept, rejected_by (a rule or null).

    A null or empty text has no words and is rejected. Rows stay as they are: a null or repeated id
    gives a row each. Other columns are not read. ``rejected_by`` is the rule that happened to
    be asked first, so it may differ between runs; all else may not.
    """
    order = rule_order(docs, rules, text)
    base = [name for name in BASE_RULES if name in rules]

    def judge(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*order, None], object)
        for record in records:
            for part, texts in batches(record, "text", False, PIECE_BYTES):
                counts = Counts(texts)
                digest = [pa.array(counts(c).astype(np.int64)) for c in DIGEST]
                failed = np.zeros(len(texts), bool)
                for name in base:
                    failed |= rules[name](counts)
                verdict = first_rejection(counts, rules, order)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *digest, pa.array(failed), pa.array(verdict < 0),
                     pa.array(names[verdict], pa.string())],
                    names=columns,
                )

    columns = [id, *(c.__name__ for c in DIGEST), "base_failed", "kept", "rejected_by"]
    counted = ", ".join(f"{c.__name__} bigint" for c in DIGEST)
    return docs.select(docs[id].alias("id"), docs[text].alias("text")).mapInArrow(
        judge,
        f"`{id}` {docs.schema[id].dataType.simpleString()}, {counted}, base_failed boolean,"
        " kept boolean, rejected_by string",
    )


def keep_good(docs: DataFrame, rules: dict[str, Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns; later rules are skipped."""
    order = rule_order(docs, rules, text)

    def keep(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for part, texts in batches(record, text, False, PIECE_BYTES):
                yield part.filter(pa.array(first_rejection(Counts(texts), rules, order) < 0))

    return docs.mapInArrow(keep, docs.schema)
