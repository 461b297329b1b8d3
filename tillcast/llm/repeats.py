"""Exact removal of byte strings that occur in an earlier document, by suffix arrays.

Every string of ``length`` bytes has an anchor: its ``GRAM``-byte piece with the smallest hash, the
first of equals. Equal strings have equal anchors, so all strings meet if texts are dealt by anchor:
an anchor stands for its surroundings, the bytes of the successive strings that share it. Anchors met in
one document only are left out first (but for those a filter takes for others), and fingerprints tell
equal surroundings. Where an anchor has different ones with a like side, the bytes of each are fetched
once and joined to a string of their own, whose suffix array shows the repeats: suffixes that share
``length`` bytes are neighbours. All others are settled where the uses of their anchor meet.

Suffix arrays are made by linear grouping. Suffixes start in groups by their first byte. Groups are
taken in descending order; the previous smaller group's suffix before each member is found by
pointers over members done before, and the suffixes pointed to move to new groups behind their old
one, by how many members pointed at them. Each group then holds the suffixes with one Lyndon prefix.
An ascending pass puts suffixes at the front of their groups, which orders each group; no suffix is
renamed and nothing recurs. Many strings are treated in lockstep, a group of each at a time.

Anchors with more than ``SURROUNDINGS`` different ones (a line that a large part of all documents
holds) would hold up the lockstep, so their strings are told by fingerprints; those with more than
``USES`` uses aren't even gathered in one task, but their strings dealt by their fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.scratch import Scratch
from tillcast.llm.words import U64, Texts, batches, mix, run_hashes

#: Bytes of the piece whose hash makes an anchor.
GRAM = 16
#: Strings whose anchors are found at once; their numbers fill the low bits of a hash.
STEP_BITS = 15
#: Uses of an anchor up to which its surroundings are compared in one task, and different
#: surroundings up to which they get a suffix array; the strings of more are told by fingerprints.
USES, SURROUNDINGS = 4096, 64
#: Bytes of surroundings that a task sorts in lockstep. Anchors with more than ``FEW`` wait for others
#: of that kind, as a lockstep takes as long as its longest string.
LOCKSTEP_BYTES, FEW = 1 << 20, 10
#: Bits of a filter for each of its numbers, and at least and at most in all; fuller ones let more other
#: numbers through, which later steps leave out. Bits that are gathered in one row.
FILTER_SHARE, FEWEST_BITS, FILTER_BITS, BLOCK_BITS = 8, 1 << 22, 1 << 29, 1 << 16
#: Numbers of a task that are put into blocks of a filter at once.
FILTER_STEP = 1 << 20
#: Anchors of a task that are counted at once, and bits of the number of blocks they are sent in.
ANCHOR_STEP, BLOCK_KEYS_BITS = 1 << 21, 12
#: Kinds of rows that ``_compared`` makes.
DONE, OPEN, HOT, PLACE = range(4)
_NO_ID = np.iinfo(np.int64).max  # a null id is later than all others


# --- suffix arrays -----------------------------------------------------------------------


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def suffix_arrays(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Suffix arrays of the strings that begin at ``starts`` and fill ``symbols``, each in its place.

    Every string ends with a symbol smaller than its others.
    """
    n = len(symbols)
    ends = np.append(starts[1:], n)
    string = np.repeat(np.arange(len(starts)), ends - starts)
    array = np.lexsort((symbols, string))
    place = np.empty(n, np.int64)
    place[array] = np.arange(n)
    ordered = symbols[array]
    first = np.ones(n, bool)
    first[1:] = (ordered[1:] != ordered[:-1]) | (string[1:] != string[:-1])
    heads = np.flatnonzero(first)
    sizes = np.diff(np.append(heads, n))
    group = np.empty(n, np.int64)  # of a suffix: where its group starts
    group[array] = np.repeat(heads, sizes)
    end = np.zeros(n, np.int64)  # of a group: where it ends
    end[heads] = heads + sizes
    before = _grouped(array, place, group, end, starts, ends)
    return _emitted(group, before, starts, ends)


def _grouped(array, place, group, end, starts, ends) -> np.ndarray:
    """Groups by Lyndon prefix, in place, and the previous smaller suffix of each."""
    n = len(array)
    before = np.arange(n) - 1
    moved = np.zeros(n, bool)
    top, low = ends.copy(), starts
    while len(top):
        head = group[array[top - 1]]
        size = top - head
        members = array[_ranges(head, size)]
        own, base = np.repeat(head, size), np.repeat(low, size)
        # skip what isn't in a smaller group, by the pointers of those already done
        at, limit, floor = members, own, base
        while len(at):
            target = before[at]
            on = (target >= floor) & (group[target] >= limit)
            at, limit, floor = at[on], limit[on], floor[on]
            before[at] = before[target[on]]
        target = before[members]
        target = np.sort(target[target >= base])
        if len(target):
            new = np.ones(len(target), bool)
            new[1:] = target[1:] != target[:-1]
            cuts = np.flatnonzero(new)
            _move(target[cuts], np.diff(np.append(cuts, len(target))), array, place, group, end, moved)
        going = head > low
        top, low = head[going], low[going]
    return before


def _move(chosen, count, array, place, group, end, moved) -> None:
    """Put suffixes into new groups right behind their old ones, those with smaller counts first."""
    by_group = np.lexsort((count, group[chosen]))
    chosen, count = chosen[by_group], count[by_group]
    old = group[chosen]
    head = np.ones(len(old), bool)
    head[1:] = old[1:] != old[:-1]
    heads = np.flatnonzero(head)
    total = np.diff(np.append(heads, len(old)))
    left = end[old[heads]] - total  # where the old group ends now
    slot = np.repeat(left - heads, total) + np.arange(len(old))
    now = place[chosen]
    moved[chosen] = True
    there = array[slot]
    there = there[~moved[there]]
    free = now[now < np.repeat(left, total)]
    array[free], place[there] = there, free
    array[slot], place[chosen] = chosen, slot
    moved[chosen] = False
    end[old[heads]] = left
    head[1:] |= count[1:] != count[:-1]
    runs = np.flatnonzero(head)
    sizes = np.diff(np.append(runs, len(old)))
    end[slot[runs]] = slot[runs] + sizes
    group[chosen] = np.repeat(slot[runs], sizes)


def _emitted(group, before, starts, ends) -> np.ndarray:
    """Suffixes in order: each that comes up places those that end their Lyndon prefix before it."""
    n = len(group)
    array = np.zeros(n, np.int64)
    fill = np.arange(n)
    placed = np.zeros(n, bool)
    array[starts] = ends - 1
    placed[ends - 1] = True
    by_length = np.argsort(starts - ends, kind="stable")
    starts, lengths = starts[by_length], (ends - starts)[by_length]
    step = 0
    while len(starts):
        low = starts
        at = array[low + step] - 1
        while True:
            on = at >= low
            on &= ~placed[at]
            if not on.all():
                at, low = at[on], low[on]
            if not len(at):
                break
            own = group[at]
            slot = fill[own]
            array[slot] = at
            fill[own] = slot + 1
            placed[at] = True
            at = before[at]
        step += 1
        left = int(np.searchsorted(-lengths, -step))  # strings longer than step
        starts, lengths = starts[:left], lengths[:left]
    return array


# --- anchors -----------------------------------------------------------------------------


_BYTES = mix(np.arange(256, dtype=U64) + U64(0x9E3779B97F4A7C15))


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on (a power of two)."""
    grown = _BYTES[data]
    step = 1
    while step < size:
        factor = U64(pow(0xA0761D6478BD642F, step, 2**64))
        grown = grown[: len(grown) - step] + grown[step:] * factor
        step *= 2
    return mix(grown)


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[: len(values) - step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def surroundings(
    texts: Texts, length: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, its place, first string, number of strings, text) of runs of strings with one anchor."""
    low_bits = U64((2 << STEP_BITS) - 1)  # room for the pieces beyond the last string's start
    data, limits = texts.data, texts.limits
    numbers = np.arange((1 << STEP_BITS) + length, dtype=U64) & low_bits
    for low in range(0, max(len(data) - length + 1, 0), 1 << STEP_BITS):
        count = min(1 << STEP_BITS, len(data) - length + 1 - low)
        part = data[low : low + count + length - 1]
        hashes = _gram_hashes(part, GRAM)
        # the number in the low bits makes the first of equal hashes the smallest
        numbered = hashes & ~low_bits
        numbered |= numbers[: len(hashes)]
        least = _window_minimum(numbered, length - GRAM + 1)
        # strings that run into the next text are none
        depth = np.zeros(count + 1, np.int32)
        ends = limits[np.searchsorted(limits, low, "right") :]
        ends = ends[: np.searchsorted(ends, low + count + length)] - low
        np.add.at(depth, np.clip(ends - length + 1, 0, count), 1)
        np.add.at(depth, np.clip(ends, 0, count), -1)
        inside = np.cumsum(depth[:count]) == 0
        cut = np.ones(count, bool)
        cut[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, count))
        good = inside[first]
        first, size = first[good], size[good]
        at = (least[first] & low_bits).astype(np.int64)
        start = first + low
        yield hashes[at], at + low, start, size, np.searchsorted(limits, start, "right") - 1


def _numbers(part: pa.RecordBatch) -> np.ndarray:
    ids = part.column("id")
    return ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values start in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _summed(key, low, high, uses) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the smallest low, largest high and sum of uses of each."""
    order = np.argsort(key, kind="stable")
    key, low, high, uses = key[order], low[order], high[order], uses[order]
    first = _first_of(key)
    if not len(first):
        return key, low, high, uses
    ufuncs = (np.minimum, low), (np.maximum, high), (np.add, uses)
    return key[first], *(f.reduceat(x, first) for f, x in ufuncs)


def _shared(docs: DataFrame, length: int) -> DataFrame:
    """Anchors met in more than one document, with their number of uses. A task's anchors are sent in
    blocks, by their last bits: one row for many anchors."""
    bits, at_once = BLOCK_KEYS_BITS, ANCHOR_STEP
    kind = "block bigint, key binary, low binary, high binary, uses binary"

    def scan(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for record in records:
            for part, texts in batches(record, "text", False):
                ids = _numbers(part)
                for key, _, _, _, text in surroundings(texts, length):
                    own = ids[text]
                    held.append((key, own, own, np.ones(len(key), np.int64)))
                    count += len(key)
                    if count >= at_once:
                        yield dealt(*_summed(*map(np.concatenate, zip(*held, strict=True))))
                        held, count = [], 0
        if held:
            yield dealt(*_summed(*map(np.concatenate, zip(*held, strict=True))))

    def dealt(key, low, high, uses) -> pa.RecordBatch:
        block = (key & U64((1 << bits) - 1)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        block = block[order]
        first = _first_of(block)
        limits = pa.py_buffer(np.append(first, len(block)).astype(np.int32) * 8)
        made = [
            pa.Array.from_buffers(pa.binary(), len(first), [None, limits, pa.py_buffer(x[order])])
            for x in (key, low, high - low, uses)  # mostly zeros, as most occur once
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(block[first]), *made], names=["block", "key", "low", "high", "uses"]
        )

    def gather(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[], [], [], []]
        last = None
        for record in records:
            columns = [c.to_pylist() for c in record.columns]
            for own, *blobs in zip(*columns, strict=True):
                if own != last and held[0]:
                    yield met(held)
                    held = [[], [], [], []]
                last = own
                for x, blob in zip(held, blobs, strict=True):
                    x.append(blob)
        if held[0]:
            yield met(held)

    def met(held: list[list[bytes]]) -> pa.RecordBatch:
        columns = [
            np.frombuffer(b"".join(x), t) for x, t in zip(held, (U64, *[np.int64] * 3), strict=True)
        ]
        columns[2] = columns[1] + columns[2]
        key, low, high, uses = _summed(*columns)
        some = low < high
        return _batch({"key": key[some], "uses": uses[some]})

    return (
        docs.mapInArrow(scan, kind)
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(gather, "key bigint, uses bigint")
    )


def _filter(tags: DataFrame):
    """A broadcast bit table of numbers, and how many bits each has. It holds every number, and others."""
    count = tags.count()
    size = min(FILTER_BITS, max(FEWEST_BITS, 1 << (FILTER_SHARE * count).bit_length()))
    ways = 2 if size > 2 * count else 1
    block, at_once = min(size, BLOCK_BITS), FILTER_STEP

    def places(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for record in records:
            held.append(record.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= at_once:
                yield dealt(np.concatenate(held))
                held = []
        if held:
            yield dealt(np.concatenate(held))

    def dealt(numbers: np.ndarray) -> pa.RecordBatch:
        at = np.unique(np.concatenate(_bits(numbers, size, ways)))
        own = at // block
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        limits = np.append(cut, len(at)).astype(np.int32) * 2
        inside = (at % block).astype(np.uint16)
        rows = pa.Array.from_buffers(
            pa.binary(), len(cut), [None, pa.py_buffer(limits), pa.py_buffer(inside)]
        )
        return pa.RecordBatch.from_arrays([pa.array(own[cut]), rows], names=["block", "bits"])

    def filled(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for record in records:
            for own, places in zip(record.column(0).to_pylist(), record.column(1).to_pylist(), strict=True):
                held = blocks.setdefault(own, np.zeros(block, np.uint8))
                held[np.frombuffer(places, np.uint16)] = 1
        for own, held in blocks.items():
            bits = np.packbits(held, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([bits])], names=["block", "bits"])

    kind = "block bigint, bits binary"
    found = tags.mapInArrow(places, kind).repartition("block").mapInArrow(filled, kind).toArrow()
    table = np.zeros(size // 8, np.uint8)
    for own, bits in zip(found.column("block").to_pylist(), found.column("bits"), strict=True):
        table[own * block // 8 : (own + 1) * block // 8] = np.frombuffer(bits.as_buffer(), np.uint8)
    return tags.sparkSession.sparkContext.broadcast((table, ways))


def _bits(tags: np.ndarray, size: int, ways: int) -> list[np.ndarray]:
    """The bits of numbers in a table of ``size`` (a power of two, 2**32 at most)."""
    spread = mix(tags.view(U64))
    return [((spread >> U64(32 * k)) & U64(size - 1)).astype(np.int64) for k in range(ways)]


def _held(filter_, tags: np.ndarray) -> np.ndarray:
    table, ways = filter_.value
    hit = np.ones(len(tags), bool)
    for at in _bits(tags, 8 * len(table), ways):
        hit &= (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return hit


def _tag(key: np.ndarray, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(key.view(U64) ^ mix(own.view(U64) + mix(ids.astype(np.int64).view(U64))))


def _prints(texts: Texts, start: np.ndarray, ends: np.ndarray) -> np.ndarray:
    low = int(start.min()) if len(start) else 0
    part = texts.data[low : int(ends.max()) if len(ends) else 0]
    return run_hashes(part, start - low, ends - low, False)


def _batch(columns: dict[str, np.ndarray], **arrays: pa.Array) -> pa.RecordBatch:
    made = {
        name: pa.array(c.view(np.int64) if c.dtype == U64 else c.astype(np.int64))
        for name, c in columns.items()
    }
    return pa.RecordBatch.from_pydict(made | arrays)


def _prints_and_sides(texts: Texts, at: np.ndarray, start: np.ndarray, ends: np.ndarray, length: int):
    """Prints of surroundings, and two of 16 bits: of the bytes up to the anchor's end and of those from its
    start on, as many as one of both sides of any string holds; 0 where the surroundings are shorter."""
    reach = GRAM + (length - GRAM) // 2
    lows = at + GRAM - reach, at
    good = [np.flatnonzero((low >= start) & (low + reach <= ends)) for low in lows]
    sides = [low[some] for low, some in zip(lows, good, strict=True)]
    prints = _prints(
        texts, np.concatenate([start, *sides]), np.concatenate([ends, *(x + reach for x in sides)])
    )
    found = np.zeros(len(at), np.int64)
    cuts = np.cumsum([len(start), len(good[0])])
    own, *of_sides = np.split(prints, cuts)
    for shift, some, x in zip((0, 16), good, of_sides, strict=True):
        found[some] |= ((x >> U64(48)) | U64(1)).astype(np.int64) << shift
    return own, found


def _places(docs: DataFrame, length: int, shared, hot) -> DataFrame:
    """(key, print, id, text_print, at, sides) of the surroundings of shared anchors, and maybe of others;
    at is their first string above 32 bits with their number, sides has bit 32 set for all anchors in the
    filter ``hot``, and maybe for others."""

    def scan(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for part, texts in batches(record, "text", False):
                ids = _numbers(part)
                of_text = part.column("print").to_numpy(zero_copy_only=False)
                for found in surroundings(texts, length):
                    hit = _held(shared, found[0])
                    key, at, start, n, text = (x[hit] for x in found)
                    own, sides = _prints_and_sides(texts, at, start, start + n + length - 1, length)
                    yield _batch(
                        {"key": key, "print": own, "id": ids[text], "text_print": of_text[text],
                         "at": start - texts.limits[text] << 32 | n,
                         "sides": sides | _held(hot, key).astype(np.int64) << 32}
                    )

    names = ["key", "print", "id", "text_print", "at", "sides"]
    return docs.mapInArrow(scan, ", ".join(f"{c} bigint" for c in names))


def _compared(places: DataFrame) -> DataFrame:
    """Rows (kind, key, print, low, high, id, text_print, start, n) from the uses of each anchor:

    DONE (id, text_print, start, n): strings that occur in an earlier document; of surroundings like no other
    of the anchor's on either side, so that they share no string with these.
    OPEN (key, print, low, high): the other surroundings, with their first and last document.
    HOT (the same): of surroundings of hot anchors, by parts.
    PLACE (key, print, id, text_print, start): where those of the last two kinds are that may have to go.
    """
    names = ["kind", "key", "print", "low", "high", "id", "text_print", "start", "n"]

    def compare(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 6
        for record in records:
            new = [record.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield from whole(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield from whole(*held)

    def whole(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((columns[2], columns[1], columns[0]))
        key, own, ids, of_text, at, sides = (x[order] for x in columns)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        uses = np.diff(np.append(first, len(key)))
        last = first + uses - 1
        heads = np.flatnonzero(np.diff(np.searchsorted(key[first], key[first]), prepend=-1))
        different = np.diff(np.append(heads, len(first)))  # surroundings of each anchor
        least = np.repeat(np.minimum.reduceat(ids[first], heads), different)
        most = np.repeat(np.maximum.reduceat(ids[last], heads), different)
        hot = (sides[first] >> 32 & 1).astype(bool)
        alone = np.ones(len(first), bool)
        for side in (sides[first] & 0xFFFF, sides[first] >> 16 & 0xFFFF):
            order = np.lexsort((side, key[first]))
            by, of = side[order], key[first][order]
            same = (of[1:] == of[:-1]) & (by[1:] == by[:-1]) & (by[1:] != 0)
            alone[order[1:][same]] = alone[order[:-1][same]] = False
        alone &= ~hot
        start, n = at >> 32, at & 0xFFFFFFFF
        go = np.repeat(alone, uses) & (ids > np.repeat(ids[first], uses))
        yield rows(DONE, id=ids[go], text_print=of_text[go], start=start[go], n=n[go])
        for kind, which in ((OPEN, ~alone & ~hot & (least < most)), (HOT, hot)):
            some = first[which]
            yield rows(kind, key=key[some], print=own[some], low=ids[some], high=ids[last[which]])
            go = np.repeat(which, uses)
            if kind == OPEN:
                go &= ids > np.repeat(least, uses)
            yield rows(PLACE, key=key[go], print=own[go], id=ids[go], text_print=of_text[go], start=start[go])

    def rows(kind: int, **columns: np.ndarray) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        columns["kind"] = np.full(size, kind)
        none = pa.nulls(size, pa.int64())
        made = [pa.array(columns[c]) if c in columns else none for c in names]
        return pa.RecordBatch.from_arrays(made, names=names)

    # the uses of a hot anchor are dealt singly, those of any other meet
    one_by_one = F.xxhash64("id", "text_print", "at")
    return (
        places.repartition(F.when(F.col("sides") >= 1 << 32, one_by_one).otherwise(F.col("key")))
        .sortWithinPartitions("key")
        .mapInArrow(compare, ", ".join(f"{c} bigint" for c in names))
    )


def _bytes(docs: DataFrame, length: int, wanted: DataFrame, hot) -> DataFrame:
    """(key, print, hot, bytes) of all of ``wanted`` (key, print, low), taken from document ``low``, and maybe of
    others; hot as in ``_places``."""

    def tags(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            columns = [record.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            yield _batch({"tag": _tag(*columns)})

    table = _filter(wanted.select("key", "print", "low").mapInArrow(tags, "tag bigint"))

    def scan(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for part, texts in batches(record, "text", False):
                ids = _numbers(part)
                for key, _, start, n, text in surroundings(texts, length):
                    ends = start + n + length - 1
                    own = _prints(texts, start, ends)
                    hit = _held(table, _tag(key, own, ids[text]))
                    key, own, start, ends = key[hit], own[hit], start[hit], ends[hit]
                    limits = np.concatenate([[0], np.cumsum(ends - start)]).astype(np.int32)
                    held = texts.data[_ranges(start, ends - start)]
                    bytes_ = pa.Array.from_buffers(
                        pa.binary(), len(key), [None, pa.py_buffer(limits), pa.py_buffer(held)]
                    )
                    yield _batch({"key": key, "print": own, "hot": _held(hot, key)}, bytes=bytes_)

    return docs.mapInArrow(scan, "key bigint, print bigint, hot bigint, bytes binary")


# --- repeats -----------------------------------------------------------------------------


def first_ids(
    bytes_: np.ndarray, limits: np.ndarray, key: np.ndarray, ids: np.ndarray, length: int
) -> np.ndarray:
    """For each string of ``length`` bytes of each text, the smallest id of a text of its key that
    holds it, one text after the other. Texts are sorted by key."""
    sizes = np.diff(limits)
    starts = limits[:-1] + np.arange(len(sizes))  # each text is followed by one more symbol
    symbols = np.ones(len(bytes_) + len(sizes), np.int16)
    inked = np.ones(len(symbols), bool)
    inked[starts + sizes] = False
    symbols[inked] = bytes_.astype(np.int16) + 2
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(key)) - 1
    symbols[starts[last] + sizes[last]] = 0
    array = suffix_arrays(symbols, starts[heads])

    strings = np.maximum(sizes - length + 1, 0)
    begins = _ranges(starts, strings)
    of_text = np.repeat(np.arange(len(sizes)), strings)
    number = np.full(len(symbols), -1)
    number[begins] = np.arange(len(begins))
    order = number[array]
    order = order[order >= 0]  # strings in order; equal ones are neighbours
    same = np.zeros(len(order), bool)
    if len(order):
        at, of = begins[order], key[of_text[order]]
        same[1:] = of[1:] == of[:-1]
        for low in range(0, length, 8):
            wide = np.arange(low, min(low + 8, length))
            rows = np.flatnonzero(same)
            differ = symbols[at[rows][:, None] + wide] != symbols[at[rows - 1][:, None] + wide]
            same[rows[differ.any(axis=1)]] = False
    group = np.cumsum(~same) - 1
    heads = np.flatnonzero(~same)
    found = np.empty(len(order), np.int64)
    if len(order):
        found[order] = np.minimum.reduceat(ids[of_text[order]], heads)[group]
    return found


def _first_by_print(
    bytes_: np.ndarray, limits: np.ndarray, key: np.ndarray, ids: np.ndarray, length: int
) -> np.ndarray:
    """The same as ``first_ids`` by 64-bit fingerprints of the strings."""
    strings = np.diff(limits) - length + 1
    starts = _ranges(limits[:-1], strings)
    of = np.repeat(np.arange(len(key)), strings)
    prints = run_hashes(bytes_, starts, starts + length, False)
    order = np.lexsort((ids[of], prints, key[of]))
    new = np.ones(len(order), bool)
    same = (prints[order][1:] == prints[order][:-1]) & (key[of[order]][1:] == key[of[order]][:-1])
    new[1:] = ~same
    found = np.empty(len(order), np.int64)
    found[order] = ids[of[order[np.flatnonzero(new)]]][np.cumsum(new) - 1]
    return found


def _repeats(wanted: DataFrame, known: DataFrame, length: int) -> DataFrame:
    """Rows (key, print, at, n, first): from string ``at`` on, n strings of these surroundings
    occur first in the document ``first``, and the surroundings in a later one. ``wanted``: different
    surroundings (key, print, low, high), ``known``: their bytes, see ``_bytes``."""
    names = ["key", "print", "at", "n", "first"]
    most, few_of, at_once = SURROUNDINGS, FEW, LOCKSTEP_BYTES

    def sort(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        many: list[pa.Table] = []
        count = waiting = 0
        for record in records:
            if not len(record):
                continue
            held.append(record)
            count += record.nbytes
            if count >= at_once:
                rows = pa.Table.from_batches(held).combine_chunks()
                keys = rows.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if cut:
                    few, more = parted(paired(rows.slice(0, cut)))
                    yield from found(few)
                    many.append(more)
                    waiting += more.nbytes
                    rows = rows.slice(cut)
                held, count = rows.combine_chunks().to_batches(), rows.nbytes
                if waiting >= 4 * at_once:
                    yield from found(pa.concat_tables(many).combine_chunks())
                    many, waiting = [], 0
        if count:
            few, more = parted(paired(pa.Table.from_batches(held).combine_chunks()))
            yield from found(few)
            many.append(more)
        if many:
            yield from found(pa.concat_tables(many).combine_chunks())

    def paired(rows: pa.Table) -> pa.Table:
        """Each of the wanted with its bytes, which follow it."""
        told = rows.column("low").is_valid().to_numpy()
        key, own = rows.column("key").to_numpy(), rows.column("print").to_numpy()
        one = np.flatnonzero(told[:-1] & ~told[1:] & (key[1:] == key[:-1]) & (own[1:] == own[:-1]))
        bytes_ = rows.column("bytes").take(pa.array(one + 1))
        return rows.take(pa.array(one)).drop_columns("bytes").append_column("bytes", bytes_)

    def parted(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
        keys = rows.column("key").to_numpy()
        sizes = np.searchsorted(keys, keys, "right") - np.searchsorted(keys, keys)
        return tuple(rows.filter(pa.array(x)).combine_chunks() for x in (sizes <= few_of, sizes > few_of))

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        low = 0
        sizes = np.cumsum([len(x) for x in rows.column("bytes").to_pylist()])
        keys = rows.column("key").to_numpy()
        while low < len(rows):
            start = int(sizes[low - 1]) if low else 0
            high = int(np.searchsorted(sizes, start + 2 * at_once)) + 1
            high = int(np.searchsorted(keys, keys[min(high, len(rows)) - 1], "right"))
            yield part(rows.slice(low, high - low))
            low = high

    def part(rows: pa.Table) -> pa.RecordBatch:
        key, own, ids, latest = (rows.column(c).to_numpy() for c in ("key", "print", "low", "high"))
        texts = rows.column("bytes").to_pylist()
        sizes = np.array([len(t) for t in texts])
        bytes_ = np.frombuffer(b"".join(texts), np.uint8)
        limits = np.concatenate([[0], np.cumsum(sizes)])
        strings = sizes - length + 1
        different = np.searchsorted(key, key, "right") - np.searchsorted(key, key)
        first = np.repeat(ids, strings)  # right for a lone one, which has no other to share with
        many = different > most
        for rows_, way in ((~many & (different > 1), first_ids), (many, _first_by_print)):
            some = np.flatnonzero(rows_)
            if len(some):
                chosen = bytes_[_ranges(limits[some], sizes[some])]
                inner = np.concatenate([[0], np.cumsum(sizes[some])])
                first[np.repeat(rows_, strings)] = way(chosen, inner, key[some], ids[some], length)
        of = np.repeat(np.arange(len(key)), strings)
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (first[1:] != first[:-1])
        heads = np.flatnonzero(new)
        n = np.diff(np.append(heads, len(of)))
        row = of[heads]
        before = np.cumsum(strings) - strings
        keep = first[heads] < latest[row]
        columns = [key[row], own[row], heads - before[row], n, first[heads]]
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=names)

    told = wanted.select("key", "print", "low", "high", F.lit(None).cast("binary").alias("bytes"))
    none = F.lit(None).cast("bigint")
    return (
        told.unionByName(known.select("key", "print", none.alias("low"), none.alias("high"), "bytes"))
        .repartition("key")
        .sortWithinPartitions("key", "print", F.col("low").asc_nulls_last())
        .mapInArrow(sort, ", ".join(f"{c} bigint" for c in names))
    )


def _dealt_singly(contexts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """The same for surroundings of very frequent anchors, by fingerprints of their strings."""
    names = ["key", "print", "at", "string", "low", "high"]

    def cut(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for low in range(0, len(record), 4096):
                yield part(record.slice(low, 4096))

    def part(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column("bytes").to_pylist()
        sizes = np.array([len(t) for t in texts])
        limits = np.cumsum(sizes) - sizes
        strings = sizes - length + 1
        starts = _ranges(limits, strings)
        data = np.frombuffer(b"".join(texts), np.uint8)
        prints = run_hashes(data, starts, starts + length, False).view(np.int64)
        of = np.repeat(np.arange(len(sizes)), strings)
        own = [rows.column(c).to_numpy(zero_copy_only=False)[of] for c in ("key", "print", "low", "high")]
        columns = [own[0], own[1], starts - limits[of], prints, own[2], own[3]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    strings = scratch.keep(
        contexts.mapInArrow(cut, ", ".join(f"{c} bigint" for c in names)), "strings"
    )
    first = scratch.keep(
        strings.groupBy("key", "string")
        .agg(F.min("low").alias("first"), F.max("high").alias("last"))
        .filter("first < last")
        .drop("last"),
        "firsts",
    )
    return (
        strings.join(first, ["key", "string"])
        .filter("first < high")
        .select("key", "print", "at", F.lit(1).cast("bigint").alias("n"), "first")
    )


def remove_repeats(
    docs: DataFrame, length: int = 50, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, kept (its remaining bytes).

    Texts are UTF-8 bytes. Every byte is removed that lies in a string of ``length`` bytes which also
    starts in a row with a smaller id, as the texts were given; n_spans counts the maximal runs
    removed. Nothing crosses texts, and rows with equal ids don't count against each other. A null or
    empty text has no bytes. A null id is larger than any other and equal to itself. Ids are
    integers; repeated rows are rows of their own with equal results. An empty table gives no rows.
    Other columns are not read. Anchors, surroundings and, for very frequent anchors, strings are told
    apart by 64-bit hashes within an anchor's 64 bits.
    """
    number = docs[id].cast("bigint")
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    chosen = docs.select(number.alias("id"), F.xxhash64(body).alias("print"), body.alias("text"))
    scratch = Scratch(docs.sparkSession, "repeats")
    shared = scratch.keep(_shared(chosen, length), "anchors")
    table = _filter(shared.select("key"))
    hot = shared.filter(F.col("uses") > USES).select("key")
    any_hot = not hot.isEmpty()
    hot = _filter(hot)
    met = scratch.keep(_compared(_places(chosen, length, table, hot)), "met")
    scratch.drop("anchors")
    wanted = met.filter(F.col("kind") == OPEN).select("key", "print", "low", "high")
    if any_hot:
        different = met.filter(F.col("kind") == HOT).groupBy("key", "print").agg(
            F.min("low").alias("low"), F.max("high").alias("high")
        )
        different = scratch.keep(different, "hot-surroundings")
        known = scratch.keep(
            _bytes(chosen, length, wanted.unionByName(different), hot), "bytes"
        )
        found = scratch.keep(_repeats(wanted, known.filter("hot = 0"), length), "found")
        held = known.filter("hot = 1").groupBy("key", "print").agg(F.first("bytes").alias("bytes"))
        singly = _dealt_singly(different.join(held, ["key", "print"]), length, scratch)
        found = found.unionByName(scratch.keep(singly, "found-singly"))
        scratch.drop("hot-surroundings", "bytes", "strings", "firsts")
    else:
        found = scratch.keep(_repeats(wanted, _bytes(chosen, length, wanted, hot), length), "found")
    start = F.col("start") + F.col("at")
    strings = (
        met.filter(F.col("kind") == PLACE)
        .select("key", "print", "id", "text_print", "start")
        .join(found, ["key", "print"])
        .filter("first < id")
        .select("id", "text_print", start.alias("low"), (start + F.col("n")).alias("high"))
    ).unionByName(
        met.filter(F.col("kind") == DONE).select(
            "id", "text_print", F.col("start").alias("low"), (F.col("start") + F.col("n")).alias("high")
        )
    )
    spans = _merged(strings, length)
    spans = scratch.keep(spans, "spans")
    scratch.drop("met", "found", *["found-singly"] * any_hot)
    rows = chosen.withColumn("number", F.coalesce("id", F.lit(int(_NO_ID)))).join(
        spans.select(F.col("id").alias("number"), F.col("text_print").alias("print"), "spans"),
        ["number", "print"],
        "left",
    )
    return _cleaned(rows.select("id", "text", "spans"), id)


def _merged(strings: DataFrame, length: int) -> DataFrame:
    """(id, text_print, spans): the runs of bytes of each text that lie in strings which start from low on
    and before high."""

    def merge(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        for record in records:
            new = [record.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            new[3] = new[3] + (length - 1)
            held = runs(*(np.concatenate(x) for x in zip(held, new, strict=True)))
            # the last text may go on
            cut = int(np.flatnonzero(changes(*held[:2]))[-1]) if len(held[0]) else 0
            if cut:
                yield listed(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield listed(*held)

    def changes(ids: np.ndarray, of_text: np.ndarray) -> np.ndarray:
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (of_text[1:] != of_text[:-1])
        return new

    def runs(ids, of_text, low, end) -> list[np.ndarray]:
        apart = np.cumsum(changes(ids, of_text)) << 40  # more than any text is long
        reach = np.maximum.accumulate(end + apart)
        new = np.ones(len(ids), bool)
        new[1:] = (low + apart)[1:] > reach[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(ids)) - 1 if len(first) else first
        return [ids[first], of_text[first], low[first], (reach - apart)[last]]

    def listed(ids, of_text, low, end) -> pa.RecordBatch:
        first = np.flatnonzero(changes(ids, of_text))
        limits = pa.array(np.append(first, len(ids)).astype(np.int32))
        spans = pa.StructArray.from_arrays([pa.array(low), pa.array(end)], names=["low", "high"])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[first]), pa.array(of_text[first]), pa.ListArray.from_arrays(limits, spans)],
            names=["id", "text_print", "spans"],
        )

    return (
        strings.repartition("id", "text_print")
        .sortWithinPartitions("id", "text_print", "low")
        .mapInArrow(merge, "id bigint, text_print bigint, spans array<struct<low bigint, high bigint>>")
    )


def _cleaned(rows: DataFrame, id: str) -> DataFrame:
    """The results, from texts and the spans removed from them."""

    def clean(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for part, texts in batches(record, "text", False):
                yield cleaned(part, texts)

    def cleaned(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        limits = texts.limits.tolist()
        lists = part.column("spans")
        offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
        inner = lists.flatten()
        lows, highs = (
            (inner.field(k).to_numpy(zero_copy_only=False)) for k in range(2)
        )
        removed, spans, digests, kept = [], [], [], []
        for k, (low, high) in enumerate(zip(limits, limits[1:], strict=False)):
            data = texts.data[low:high]
            a, b = int(offsets[k]), int(offsets[k + 1])
            n = 0
            if a < b:
                depth = np.zeros(len(data) + 1, np.int32)
                np.add.at(depth, lows[a:b], 1)
                np.add.at(depth, highs[a:b], -1)
                gone = np.cumsum(depth)[:-1] > 0
                n = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                data = data[~gone]
            removed.append(high - low - len(data))
            spans.append(n)
            kept.append(data.tobytes())
            digests.append(hashlib.sha256(kept[-1]).hexdigest())
        return pa.RecordBatch.from_arrays(
            [
                part.column("id"),
                pa.array(np.diff(texts.limits)),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
                pa.array(digests),
                pa.array(kept, pa.binary()),
            ],
            names=[id, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )

    return rows.mapInArrow(
        clean,
        f"`{id}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string,"
        " kept binary",
    )
