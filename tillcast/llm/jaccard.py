"""Near copies by the Jaccard similarity of word n-grams: a grouped prefix join.

A document's set holds the hashes of its distinct n-grams. All sets are ordered alike, n-grams met
often last, and two similar sets share an n-gram of their prefixes, the first quarter or so.
Documents with the same prefix and size form a group. Groups that meet under an n-gram and
pass the size and position filters are candidates; their members are verified on whole sets.

Links are wanted as classes, so pairs inside a class needn't all be made. First each group is
verified against one hub of the groups it meets, and the links found give classes. Then all
candidate pairs across classes are made and verified. A group of thousands of copies thus costs as
many pairs as it has members, and no link between two classes is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm.components import components
from tillcast.llm.words import U64, Texts, batches, mix
from tillcast.session import materialize

#: Bytes of texts whose n-grams are made at once.
SLICE_BYTES = 1 << 20
#: n-grams that a task counts at once, and the most frequent of them that it reports.
CHUNK_GRAMS, CHUNK_REPORTS = 1 << 20, 1 << 14
#: n-grams put last in the order, by estimated frequency. The estimate and this bound decide
#: how long the lists of a prefix join are, not its result: any order is right.
FREQUENT_GRAMS = 1 << 18
#: Lists of an n-gram up to this length are paired row by row at once, longer ones class by class.
PAIRED_ROWS = 64
_LOW = 0xFFFFFFFF
_HIT = ["key", "owner", "more"]
#: Bits of a filter that drops most texts no one needs before they are shuffled; with more texts
#: needed than half of it, the join alone does that.
FILTER_BITS = 1 << 23
#: Prefixes that a task remembers, to send each but once.
SENT_PREFIXES = 1 << 18


def text_sets(texts: Texts, size: int) -> Iterator[np.ndarray]:
    """Per text, its distinct n-grams as sorted hashes; a shorter text is one n-gram."""
    grams, _ = texts.windows(size)
    words = texts.words
    first = texts.first.tolist()
    for low, high in zip(first, first[1:], strict=False):
        n = high - low
        if n >= size:
            yield np.unique(grams[low : high - size + 1])
        elif n:
            whole = words[low:high] * np.array([3 ** (2 * j + 1) for j in range(n)], U64)
            yield mix(np.array([int(whole.sum(dtype=U64)) ^ (n << 56)], U64))
        else:
            yield np.zeros(0, U64)


def set_key(grams: np.ndarray) -> int:
    """64-bit fingerprint of a set, as a signed number."""
    return _key(grams, len(grams))


def _key(grams: np.ndarray, size: int) -> int:
    total = mix(grams ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
    twice = mix(grams + U64(0x14057B7EF767814F)).sum(dtype=U64)
    key = mix(np.array([total], U64) ^ mix(np.array([twice], U64) + U64(size)))
    return int(key.view(np.int64)[0])


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """Rows (kind 0, id, n, set key, row) per document, and (kind 1, n-gram, count) for n-grams
    that a task saw in several different sets."""

    def scan(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count, seen = 0, set()
        for record in records:
            for part, texts in batches(record, "text", True, SLICE_BYTES):
                n, keys = [], []
                for grams in text_sets(texts, size):
                    key = set_key(grams)
                    n.append(len(grams))
                    keys.append(key)
                    if key not in seen:
                        seen.add(key)
                        held.append(grams)
                        count += len(grams)
                kinds = np.zeros(len(part), np.int32)
                yield rows(kinds, part.column("id"), n, keys, part.column("row"))
                if count >= CHUNK_GRAMS:
                    yield frequent(held)
                    held, count, seen = [], 0, set()
        if count:
            yield frequent(held)

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate(held), return_counts=True)
        grams, counts = grams[counts > 1], counts[counts > 1]
        top = np.lexsort((grams, -counts))[:CHUNK_REPORTS]
        kinds = np.ones(len(top), np.int32)
        none = pa.nulls(len(top), pa.int64())
        return rows(kinds, pa.array(grams[top].view(np.int64)), counts[top], kinds, none)

    def rows(kind, a, b, c, d) -> pa.RecordBatch:
        b, c = (pa.array(x, pa.int64()) for x in (b, c))
        names = ["kind", "a", "b", "c", "d"]
        return pa.RecordBatch.from_arrays([pa.array(kind), a, b, c, d], names=names)

    return docs.mapInArrow(scan, "kind int, a bigint, b bigint, c bigint, d bigint")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, sorted, and their places in the order (rarest first)."""
    found = (
        sets.filter("kind = 1")
        .groupBy("a")
        .agg(F.sum("b").alias("n"))
        .orderBy(F.desc("n"), "a")
        .limit(FREQUENT_GRAMS)
        .toArrow()
    )
    grams = found.column("a").to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return grams[order], (len(grams) - 1 - np.arange(len(grams)))[order]


def _in_order(grams: np.ndarray, frequent: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A sorted set in the common order: by hash, and then the frequent n-grams."""
    if not len(frequent):
        return grams
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    often = frequent[at] == grams
    if not often.any():
        return grams
    late = np.argsort(places[at[often]])
    return np.concatenate([grams[~often], grams[often][late]])


def _prefixes(docs: DataFrame, size: int, percent: int, order) -> DataFrame:
    """Rows (n-gram, group, set size << 32 | position) of each group's prefix, and (group, set
    key, -1) of each set. Each task sends a group or set once."""

    def scan(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, places = order.value
        sets, groups = set(), set()
        for record in records:
            for _, texts in batches(record, "text", True, SLICE_BYTES):
                keys, owners, more = [], [], []
                for grams in text_sets(texts, size):
                    n = len(grams)
                    key = set_key(grams)
                    if not n or key in sets:
                        continue
                    sets.add(key)
                    prefix = _in_order(grams, frequent, places)
                    prefix = prefix[: n - -(-percent * n // 100) + 1]
                    group = _key(prefix, n)
                    keys.append(np.array([group]))
                    owners.append(np.array([key]))
                    more.append(np.array([-1]))
                    if group in groups:
                        continue
                    groups.add(group)
                    keys.append(prefix.view(np.int64))
                    owners.append(np.full(len(prefix), group))
                    more.append((n << 32) + np.arange(len(prefix)))
                if keys:
                    columns = [pa.array(np.concatenate(x)) for x in (keys, owners, more)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "owner", "more"])
                if len(sets) > SENT_PREFIXES:
                    sets, groups = set(), set()

    return docs.mapInArrow(scan, "key bigint, owner bigint, more bigint")


def _runs(records: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of a stream sorted by its first column, in parts that split no run of it."""
    held = [np.zeros(0, np.int64) for _ in names]
    for record in records:
        new = [record.column(n).to_numpy(zero_copy_only=False) for n in names]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if cut:
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield held


def _limits(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    return zip(cuts, cuts[1:], strict=False) if len(key) else iter(())


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names)


def _possible(percent: int, x, i, m, y, j, n) -> np.ndarray:
    """Whether sets of x and y n-grams with a common one at places i and j can be similar, if m
    and n of the n-grams before it were met in other sets at all.

    With overlap o that is 100 o >= percent (x + y - o); o is at most the lesser of m and n, and
    the lesser of what the sets hold from that place on.
    """
    most = np.minimum(m, n) + np.minimum(x - i, y - j)
    return (100 + percent) * most >= percent * (x + y)


def _first_possible(percent: int, x, i, a, m, y, j, b, n) -> np.ndarray:
    """Whether sets of x and y n-grams can be similar if the first one they share is at places i
    and j: a and b of the n-grams of their prefixes were met, m and n of these come before it.

    What both prefixes hold was met in both. A prefix n-gram that was met nowhere may still lie
    beyond the other set's prefix, so as in ``_least_meetings`` the larger rest is added.
    """
    most = np.minimum(a - m, b - n) + _larger_rest(percent, x, y)
    most = np.minimum(most, np.minimum(x - i, y - j))
    return (100 + percent) * most >= percent * (x + y)


def _larger_rest(percent: int, x, y) -> np.ndarray:
    """The larger number of n-grams that sets of x and y have beyond their prefixes."""
    return np.maximum(-(-percent * x // 100), -(-percent * y // 100)) - 1


def _least_meetings(percent: int, x, y) -> np.ndarray:
    """In how many lists similar sets of x and y n-grams meet at least.

    Of two prefixes, that which ends earlier in the order holds nothing of the other set's
    rest, so what the sets share beyond their prefixes lies in its own rest.
    """
    needed = -(-percent * (x + y) // (100 + percent))
    return np.maximum(needed - _larger_rest(percent, x, y), 1)


def _near_pairs(
    key: np.ndarray, sets: tuple[np.ndarray, ...], percent: int, passes=_possible
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of the same run of ``key`` that pass the filter, i < j, by distance.
    ``sets``: what the filter takes of either set."""
    first = np.arange(len(key))
    step = 0
    while len(first):
        step += 1
        first = first[first + step < len(key)]
        first = first[key[first] == key[first + step]]
        second = first + step
        good = passes(percent, *(c[first] for c in sets), *(c[second] for c in sets))
        yield first[good], second[good]


def _meeting(key: np.ndarray, sets: tuple[np.ndarray, ...], percent: int) -> np.ndarray:
    """Whether each row is in a long list or passes the filters with another row of its list."""
    met = _long_runs(key)
    short = np.flatnonzero(~met)
    for i, j in _near_pairs(key[short], tuple(c[short] for c in sets), percent):
        met[short[i]] = met[short[j]] = True
    return met


def _long_runs(key: np.ndarray) -> np.ndarray:
    """Whether each row is in a run of more than PAIRED_ROWS equal keys."""
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    lengths = np.diff(cuts) if len(key) else np.zeros(0, np.int64)
    return np.repeat(lengths > PAIRED_ROWS, lengths)


def _meetings(prefixes: DataFrame, percent: int) -> DataFrame:
    """From the prefixes of all: (kind 0, n-gram, group, size and place) where groups meet, and
    (1, group, set, -1) for all sets. Rows that pass the filters with no other row of their
    list, if that is short, are left out: no similar set has that n-gram."""
    names = ["kind", "a", "b", "c"]

    def meet(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, owner, more in _runs(records, ["key", "owner", "more"]):
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]) | (more[1:] != more[:-1])
            key, owner, more = key[new], owner[new], more[new]
            member = more < 0
            yield _batch([member[member], key[member], owner[member], more[member]], names)
            key, owner, more = key[~member], owner[~member], more[~member]
            met = _meeting(key, (more >> 32, more & _LOW, more & _LOW), percent)
            yield _batch([np.zeros(int(met.sum())), key[met], owner[met], more[met]], names)

    return (
        prefixes.repartition("key")
        .sortWithinPartitions("key", "owner", "more")
        .mapInArrow(meet, ", ".join(f"{name} bigint" for name in names))
    )


def _ranked(hits: DataFrame) -> DataFrame:
    """Rows (key, owner, more) with ``met``: how many n-grams of the owner's prefix were met, and
    ``before``: how many of these come before this one. The others are in no similar set's prefix,
    which the filters then know."""
    own = Window.partitionBy("owner")
    return hits.select(
        *_HIT,
        (F.row_number().over(own.orderBy("more", "key")) - 1).cast("bigint").alias("before"),
        F.count(F.lit(1)).over(own).alias("met"),
    )


def _hubs(hits: DataFrame, percent: int) -> DataFrame:
    """The ranked rows that still pass the filters (kind 0, n-gram, group, size and place, number
    before), and (2, group, hub, least number of meetings, 0) for each group and its hub there."""
    names = ["kind", "a", "b", "c", "d"]

    def star(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, owner, more, before in _runs(records, [*_HIT, "before"]):
            met = _meeting(key, (more >> 32, more & _LOW, before), percent)
            key, owner, more, before = key[met], owner[met], more[met], before[met]
            yield _batch([np.zeros(len(key)), key, owner, more, before], names)
            yield _batch(hubs(key, owner, more >> 32, more & _LOW, before), names)

    def hubs(key, owner, size, place, before) -> list[np.ndarray]:
        """Each row's hub: of the sets of its n-gram that it may be similar to in size, the one
        with the fewest rarer n-grams, which is nearest to what they have in common."""
        order = np.lexsort((owner, size, place, key))
        key, owner, size, place, before = (x[order] for x in (key, owner, size, place, before))
        found = [np.zeros(0, np.int64)] * 3
        while len(key):
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            hub = np.repeat(starts, np.diff(np.append(starts, len(key))))
            small, large = np.minimum(size, size[hub]), np.maximum(size, size[hub])
            fits = percent * large <= 100 * small
            own, other = (size, place, before), (size[hub], place[hub], before[hub])
            near = fits & (hub != np.arange(len(key))) & _possible(percent, *own, *other)
            least = _least_meetings(percent, size[near], size[hub[near]])
            new = owner[near], owner[hub[near]], least
            found = [np.append(x, y) for x, y in zip(found, new, strict=True)]
            key, owner, size, place, before = (x[~fits] for x in (key, owner, size, place, before))
        n = len(found[0])
        return [np.full(n, 2), *found, np.zeros(n)]

    return (
        hits.repartition("key")
        .sortWithinPartitions("key", "owner")
        .mapInArrow(star, ", ".join(f"{name} bigint" for name in names))
    )


def _across(met: DataFrame, percent: int) -> DataFrame:
    """Pairs of (group, class) of different classes, of which some row may be the first n-gram
    that two similar sets share. ``met``: ranked rows with the class of their group.

    Only the first common n-gram need give a pair, so rows too far behind give none.
    """
    names = ["key", "class", "owner", "size", "place", "met", "before"]
    made = ["group1", "class1", "group2", "class2"]

    def pair(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, class_, owner, *sets in _runs(records, names):
            long = _long_runs(key)
            short = np.flatnonzero(~long)
            found = []
            own = tuple(c[short] for c in sets)
            for i, j in _near_pairs(key[short], own, percent, _first_possible):
                apart = class_[short[i]] != class_[short[j]]
                found.append((short[i][apart], short[j][apart]))
            if found:
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                yield distinct([owner[i], class_[i], owner[j], class_[j]])
            rows = np.flatnonzero(long)
            for low, high in _limits(key[rows]):
                run = rows[low:high]
                yield from across_run(class_[run], owner[run], tuple(c[run] for c in sets))

    def across_run(class_, owner, sets) -> Iterator[pa.RecordBatch]:
        """Of one long list, by class: each class against all after it."""
        for low, high in _limits(class_):
            rest = tuple(c[high:] for c in sets)
            for i in range(low, high if len(rest[0]) else low):
                near = np.flatnonzero(_first_possible(percent, *(c[i] for c in sets), *rest)) + high
                if len(near):
                    ones = np.ones(len(near), np.int64)
                    yield distinct([ones * owner[i], ones * class_[i], owner[near], class_[near]])

    def distinct(columns: list[np.ndarray]) -> pa.RecordBatch:
        swap = columns[0] > columns[2]
        columns = [np.where(swap, columns[(k + 2) % 4], columns[k]) for k in range(4)]
        key = np.zeros(len(swap), U64)
        for column in columns:
            key = mix(key + column.view(U64))
        once = np.unique(key, return_index=True)[1]
        return _batch([c[once] for c in columns], made)

    return (
        met.withColumn("size", F.expr("shiftright(more, 32)"))
        .withColumn("place", F.col("more").bitwiseAND(F.lit(_LOW)))
        .select(*names)
        .repartition("key")
        .sortWithinPartitions("key", "class", "owner")
        .mapInArrow(pair, ", ".join(f"{name} bigint" for name in made))
        .distinct()
    )


def _meet_enough(pairs: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose groups share as many n-grams of their prefixes as they must, and
    parts of one group. A prefix bounds what is gathered for a group."""
    lists = materialize(
        ranked.groupBy("owner").agg(
            F.collect_list("key").alias("keys"),
            F.max(F.expr("shiftright(more, 32)")).alias("size"),
        ),
        "jaccard-lists",
    )
    parts = pairs.filter("group1 = group2")
    joined = pairs.filter("group1 <> group2").join(lists.toDF("group1", "keys1", "size1"), "group1").join(
        lists.toDF("group2", "keys2", "size2"), "group2"
    )
    needed = F.ceil((F.col("size1") + F.col("size2")) * percent / (100 + percent))
    rest = F.ceil(F.greatest("size1", "size2") * percent / 100) - 1
    met = F.size(F.array_intersect("keys1", "keys2"))
    enough = joined.filter(met >= F.greatest(needed - rest, F.lit(1)))
    return enough.select(pairs.columns).unionByName(parts)


def _verified(
    pairs: DataFrame, docs: DataFrame, first: DataFrame, size: int, percent: int
) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar. The whole sets of the pairs, and of nothing
    else, are made once more from the texts; ``first`` (key, row): the row that a set is read from."""
    pairs = materialize(pairs, "jaccard-pairs")
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    wanted = materialize(first.join(keys.distinct(), "key"), "jaccard-wanted")
    texts = _likely(docs, wanted).join(wanted, "row").select("key", "text")
    used = materialize(_grams(texts, size), "jaccard-used")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return (
        pairs.join(used.toDF("a", "x"), "a")
        .join(used.toDF("b", "y"), "b")
        .filter(100 * common >= percent * union)
        .select("a", "b")
    )


def jaccard_classes(
    docs: DataFrame,
    size: int = 5,
    percent: int = 75,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: id, n_shingles (size of its set), component_id (smallest id reachable by links).

    A-Z are lower-cased, words are runs without ASCII white space, a set holds the distinct runs of
    ``size`` words. Two rows link when 100 * intersection >= ``percent`` * union. Texts with
    fewer words are one n-gram; null or wordless ones have none and link with nothing. Equal sets
    are one node, however many rows have it. Rows with equal ids are rows of their own; a null id
    names no component unless all ids of the component are null. Ids are integers. An empty table
    gives no rows. Other columns are not read. Sets are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    own_id = docs[id].cast("bigint")
    chosen = docs.select(
        own_id.alias("id"),
        F.coalesce(own_id, F.xxhash64(docs[text])).alias("row"),
        docs[text].alias("text"),
    )
    scanned = materialize(_sets(chosen, size), "jaccard-sets")
    rows = scanned.filter("kind = 0").select(
        F.col("a").alias("id"),
        F.col("b").alias("n"),
        F.col("c").alias("key"),
        F.col("d").alias("row"),
    )
    order = spark.sparkContext.broadcast(_frequent(scanned))
    met = materialize(_meetings(_prefixes(chosen, size, percent, order), percent), "jaccard-met")
    members = met.filter("kind = 1").select(F.col("a").alias("owner"), F.col("b").alias("key"))
    once = _ranked(met.filter("kind = 0").toDF("kind", *_HIT))
    stars = materialize(_hubs(once, percent), "jaccard-stars")
    left = stars.filter("kind = 0").toDF("kind", *_HIT, "before")
    hits = materialize(_ranked(left), "jaccard-ranked")
    leads = materialize(
        members.groupBy("owner").agg(F.min("key").alias("lead"), F.count(F.lit(1)).alias("n")),
        "jaccard-groups",
    )
    best = (
        stars.filter("kind = 2")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("least"))
        .filter("2 * n >= least")  # a group may meet its hub elsewhere under another hub
        .groupBy("a")
        .agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    )
    lead = leads.select("owner", "lead")
    hub_pairs = (
        best.join(lead.toDF("a", "x"), "a").join(lead.toDF("b", "y"), "b").select(
            F.col("x").alias("a"), F.col("y").alias("b")
        )
    )
    inner = (
        members.join(leads.filter("n > 1"), "owner")
        .filter("key <> lead")
        .select(F.col("key").alias("a"), F.col("lead").alias("b"))
    )
    # everything that may be similar to anything
    met_owners = hits.select("owner").distinct().unionByName(leads.filter("n > 1").select("owner"))
    needed = materialize(
        members.join(met_owners.distinct(), "owner").select("key").distinct(), "jaccard-needed"
    )
    first = rows.filter("n > 0").groupBy("key").agg(F.min("row").alias("row"))
    hub_links = _verified(hub_pairs.unionByName(inner), chosen, first, size, percent)
    star = materialize(hub_links, "jaccard-links")
    classes = materialize(components(star), "jaccard-classes")

    own = F.coalesce("component", "key").alias("class")
    in_class = materialize(
        members.join(needed, "key")
        .join(classes.withColumnRenamed("node", "key"), "key", "left")
        .select("owner", "key", own),
        "jaccard-members",
    )
    parts = in_class.select("owner", "class").distinct()
    apart = parts.join(parts.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "owner")
    alone = apart.select(
        F.col("owner").alias("key"),
        "owner",
        F.lit(1 << 32).cast("bigint").alias("more"),
        F.lit(0).cast("bigint").alias("before"),
        F.lit(1).cast("bigint").alias("met"),
        "class",
    )
    crossing = hits.join(parts, "owner").select(*_HIT, "before", "met", "class")
    near = materialize(_across(crossing.unionByName(alone), percent), "jaccard-across")
    pairs = _meet_enough(near, hits, percent)
    side = in_class.select("owner", "key", "class")
    rest = (
        pairs.join(side.toDF("group1", "a", "class1"), ["group1", "class1"])
        .join(side.toDF("group2", "b", "class2"), ["group2", "class2"])
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    more = materialize(_verified(rest, chosen, first, size, percent), "jaccard-more")
    final = materialize(components(star.unionByName(more)), "jaccard-final")

    found = first_ids(rows, final)
    return (
        rows.alias("r")
        .join(found.alias("f"), F.col("r.key") == F.col("f.key"), "left")
        .select(
            F.col("r.id").alias(id),
            F.col("r.n").alias("n_shingles"),
            F.when(F.col("r.n") == 0, F.col("r.id")).otherwise(F.col("f.id")).alias("component_id"),
        )
    )


def first_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, id): for each set the smallest id of its component."""
    keys = rows.filter("n > 0").groupBy("key").agg(F.min("id").alias("id"))
    named = materialize(
        keys.join(classes.withColumnRenamed("node", "key"), "key", "left").select(
            "key", "id", F.coalesce("component", "key").alias("component")
        ),
        "jaccard-keys",
    )
    least = materialize(
        named.groupBy("component").agg(F.min("id").alias("id")), "jaccard-components"
    )
    return materialize(
        named.select("key", "component").join(least, "component").select("key", "id"),
        "jaccard-ids",
    )


def _likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` (row, text) without most rows that ``wanted`` (row) lacks; none of it is lost."""
    if wanted.count() > FILTER_BITS // 2:
        return docs.select("row", "text")
    spark = docs.sparkSession.sparkContext

    def bit(rows: pa.Array) -> np.ndarray:
        return (mix(rows.to_numpy(zero_copy_only=False).view(U64)) % U64(FILTER_BITS)).astype(np.int64)

    def bits(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            yield _batch([np.unique(bit(record.column("row")))], ["bit"])

    table = np.zeros(FILTER_BITS, bool)
    found = wanted.select("row").mapInArrow(bits, "bit bigint").distinct().toArrow()
    table[found.column("bit").to_numpy()] = True
    packed = spark.broadcast(np.packbits(table))

    def keep(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            at = bit(record.column("row"))
            hit = packed.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            yield record.filter(pa.array(hit.astype(bool)))

    return docs.select("row", "text").mapInArrow(keep, "row bigint, text string")


def _grams(docs: DataFrame, size: int) -> DataFrame:
    """(key, grams) of the rows whose set has the fingerprint that they are wanted for."""

    def scan(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for part, texts in batches(record, "text", True, SLICE_BYTES):
                keys = part.column("key").to_pylist()
                found = {}
                for key, grams in zip(keys, text_sets(texts, size), strict=True):
                    if key == set_key(grams):
                        found[key] = grams.view(np.int64)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(list(found), pa.int64()),
                            pa.array(list(found.values()), pa.list_(pa.int64())),
                        ],
                        names=["key", "grams"],
                    )

    return docs.mapInArrow(scan, "key bigint, grams array<bigint>")
