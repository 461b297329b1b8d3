"""The best documents for each of many items by a lexical score, with a dual-tree search.

A document is a vector of the impacts of its terms, an item one of the weights of its terms; the score
is their product. Documents form hierarchies, a block of them each, whose nodes hold for every term
the largest impact below them; items form a hierarchy whose nodes hold for every term the largest
weight. The product of two nodes bounds the scores of all their pairs. A pair of nodes is left
alone when its bound is below the weakest k-th score of the node's items, and children look only
at what their parent kept. At single items leaves are scored by falling bound until the next
one can't reach the k-th score. All numbers are integers, so bounds and results are exact.

Texts are read once; the terms that items may have are written per document. Items come in blocks of a
bounded number of terms, which are broadcast; for each block an index of all documents is written and
searched twice: first the best leaf of each index block gives k-th scores over all documents, and then
the search starts with these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm.words import U64, Texts, batches, mix, run_hashes
from tillcast.session import materialize

#: Documents of an index block and of a leaf, and children of a node of either hierarchy.
BLOCK, LEAF, FAN, ITEM_FAN = 4096, 16, 8, 4
#: Terms of the items that are broadcast together, repeats between items counted.
BLOCK_TERMS = 1 << 18
#: Bits of the filter of items' terms; terms that pass it and are in no item only cost space.
FILTER_BITS = 1 << 24
#: Leaves scored before the k-th score is looked at again.
LEAVES = 8
# The score's constants.
SLOPE, FLOOR, SCALE, MOST = 90, 10, 8, 1_000_000_000

_SEPARATES = np.ones(256, bool)
_SEPARATES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


# --- terms -------------------------------------------------------------------------------


def text_terms(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term of the texts, A-Z lower-cased, and the number of its text."""
    hashes, places = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for low, high in texts.pieces():
        inked = ~_SEPARATES[texts.data[low:high]]
        edge = np.zeros(high - low + 1, bool)
        edge[texts.limits[(texts.limits >= low) & (texts.limits <= high)] - low] = True
        edge[[0, -1]] = True
        first, last = inked.copy(), inked.copy()
        first[1:] &= ~inked[:-1] | edge[1:-1]
        last[:-1] &= ~inked[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes.append(run_hashes(texts.data[low:high], starts, ends, True))
        places.append(starts + low)
    place = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(texts.limits, place, "right") - 1


def _counted(texts: Texts, passes=None) -> Iterator:
    """Terms of each text: n per text, and (text, term, count) of the different ones that pass."""
    terms, text = text_terms(texts)
    n = np.bincount(text, minlength=len(texts))
    if passes is not None:
        good = passes(terms)
        terms, text = terms[good], text[good]
    order = np.lexsort((terms, text))
    terms, text = terms[order], text[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return n, text[first], terms[first], np.diff(np.append(first, len(terms)))


def _lists(size: int, text: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    limits = pa.array(np.searchsorted(text, np.arange(size + 1)), pa.int32())
    return [pa.ListArray.from_arrays(limits, pa.array(c)) for c in columns]


def _item_terms(items: DataFrame) -> DataFrame:
    """(id, term): the different terms of each item."""

    def scan(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for part, texts in batches(record, "text", True):
                _, text, terms, _ = _counted(texts)
                ids = part.column("id").take(pa.array(text))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(terms.view(np.int64))], names=["id", "term"]
                )

    return items.mapInArrow(scan, "id bigint, term bigint").distinct()


def _bit(terms: np.ndarray) -> np.ndarray:
    return (mix(terms ^ U64(0x2545F4914F6CDD1D)) % U64(FILTER_BITS)).astype(np.int64)


def _filter(terms: DataFrame):
    """A broadcast bit table of all items' terms, of one size whatever their number."""

    def bits(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            found = record.column("term").to_numpy(zero_copy_only=False).view(U64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bit(found)))], names=["bit"])

    table = np.zeros(FILTER_BITS, bool)
    found = terms.select("term").mapInArrow(bits, "bit bigint").distinct().toArrow()
    table[found.column("bit").to_numpy()] = True
    return terms.sparkSession.sparkContext.broadcast(np.packbits(table))


def _postings(docs: DataFrame, packed) -> DataFrame:
    """(id, n, terms, counts) of each document with a term; lists of those that items may have."""

    def passes(terms: np.ndarray) -> np.ndarray:
        at = _bit(terms)
        return (packed.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    def scan(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for part, texts in batches(record, "text", True):
                n, text, terms, counts = _counted(texts, passes)
                lists = _lists(len(part), text, terms.view(np.int64), counts.astype(np.int32))
                made = pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n), *lists], names=["id", "n", "terms", "counts"]
                )
                yield made.filter(pa.array(n > 0))

    return docs.mapInArrow(scan, "id bigint, n bigint, terms array<bigint>, counts array<int>")


# --- items -------------------------------------------------------------------------------


@dataclass
class Items:
    """A block of items: their ids, and columns of ``terms`` (sorted), each with a weight."""

    ids: list
    columns: list[np.ndarray]
    terms: np.ndarray
    frequency: np.ndarray
    weights: np.ndarray

    def hierarchy(self) -> list:
        """Nested lists down to item numbers; those with the same frequent terms are near."""

        def signature(number: int) -> tuple:
            own = self.columns[number]
            return tuple(own[np.lexsort((own, -self.frequency[own]))][:FAN].tolist())

        nodes: list = sorted(range(len(self.ids)), key=signature)
        while len(nodes) > 1:
            nodes = [nodes[k : k + ITEM_FAN] for k in range(0, len(nodes), ITEM_FAN)]
            nodes = [x[0] if len(x) == 1 else x for x in nodes]
        return nodes

    def members(self, node) -> list[int]:
        return [node] if isinstance(node, int) else [m for x in node for m in self.members(x)]


def weight(total: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * frequency + 1)))


def _frequencies(postings: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents each of the sorted terms is."""
    sent = postings.sparkSession.sparkContext.broadcast(terms)

    def count(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(sent.value), np.int64)
        for record in records:
            _, columns, _ = _known(record, sent.value)
            found += np.bincount(columns, minlength=len(found))
        column = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(column), pa.array(found[column])], names=["column", "n"]
        )

    found = (
        postings.select("terms", "counts")
        .mapInArrow(count, "column bigint, n bigint")
        .groupBy("column")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    sent.unpersist()
    made = np.zeros(len(terms), np.int64)
    made[found.column("column").to_numpy()] = found.column("n").to_numpy()
    return made


def _known(record: pa.RecordBatch, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, column, count) of the postings whose term is one of ``terms``."""
    lists, counts = record.column("terms"), record.column("counts").flatten()
    doc = np.repeat(np.arange(len(record)), lists.value_lengths().to_numpy())
    own = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
    at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
    good = np.flatnonzero(terms[at] == own)
    return doc[good], at[good], counts.to_numpy(zero_copy_only=False)[good]


# --- documents ---------------------------------------------------------------------------


@dataclass
class Index:
    """A hierarchy of documents. ``levels``: (limits, columns, largest impacts) of the nodes, first
    those of single documents, then leaves of LEAF documents, then nodes of FAN nodes each."""

    ids: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def width(self, level: int) -> int:
        return LEAF if level == 1 else FAN

    def children(self, nodes: np.ndarray, level: int) -> np.ndarray:
        width, most = self.width(level), len(self.levels[level - 1][0]) - 1
        below = (nodes[:, None] * width + np.arange(width)).reshape(-1)
        return below[below < most]

    def products(self, dense: np.ndarray, nodes: np.ndarray, level: int) -> np.ndarray:
        """Product of an item's weights with these nodes' impacts: scores, or bounds of them."""
        limits, columns, impacts = self.levels[level]
        sizes = limits[nodes + 1] - limits[nodes]
        at = _ranges(limits[nodes], sizes)
        sums = np.zeros(len(at) + 1, np.int64)
        np.cumsum(dense[columns[at]] * impacts[at], out=sums[1:])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def build_index(ids: np.ndarray, doc, column, impact, weights: np.ndarray) -> Index:
    """``doc``, ``column`` and ``impact`` of each posting, by document."""
    # near each other: documents with the same strongest term, and of these with the same best one
    keys = np.zeros((2, len(ids)), np.int64)
    for k, strength in enumerate((impact, impact * weights[column])):
        order = np.lexsort((column, -strength, doc))
        first = np.unique(doc[order], return_index=True)
        keys[k, first[0]] = column[order][first[1]] + 1
    order = np.lexsort((keys[1], keys[0]))
    place = np.argsort(order)
    node, levels = place[doc], []
    count, width = len(ids), 1
    while True:
        node = node // width
        count = -(-count // width)
        sorted_ = np.lexsort((-impact, column, node))
        node, column, impact = node[sorted_], column[sorted_], impact[sorted_]
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (column[1:] != column[:-1])
        node, column, impact = node[new], column[new], impact[new]  # the largest impact comes first
        levels.append((np.searchsorted(node, np.arange(count + 1)), column, impact))
        if count == 1 and len(levels) > 1:
            return Index(ids[order], levels)
        width = LEAF if len(levels) == 1 else FAN


_LEVELS = pa.list_(pa.struct([(c, pa.binary()) for c in ("limits", "columns", "impacts")]))


def _indexed(postings: DataFrame, sent, total: int, length: int) -> DataFrame:
    """Rows (ids, levels): an index block each."""
    names, block = ["ids", "levels"], BLOCK

    def build(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for record in records:
            for low in range(0, len(record), block):
                held.append(record.slice(low, block))
                count += len(held[-1])
                if count >= block:
                    yield made(pa.Table.from_batches(held))
                    held, count = [], 0
        if count:
            yield made(pa.Table.from_batches(held))

    def made(rows: pa.Table) -> pa.RecordBatch:
        record = rows.combine_chunks().to_batches()[0]
        doc, column, count = _known(record, sent.value.terms)
        n = record.column("n").to_numpy(zero_copy_only=False)
        size = FLOOR + SLOPE * n * total // length
        count = count.astype(np.int64)
        impact = MOST * count // (1000 * count + SCALE * size[doc])
        ids = record.column("id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        index = build_index(ids, doc, column, impact, sent.value.weights)
        levels = [
            dict(zip(("limits", "columns", "impacts"), (x.astype("<i4").tobytes() for x in l), strict=True))
            for l in index.levels
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array([index.ids]), pa.array([levels], _LEVELS)], names=names
        )

    return postings.mapInArrow(
        build, "ids array<bigint>, levels array<struct<limits:binary,columns:binary,impacts:binary>>"
    )


_NO_ID = np.iinfo(np.int64).max  # a null id comes last among equal scores


def _indexes(records: Iterator[pa.RecordBatch]) -> Iterator[Index]:
    for record in records:
        for k in range(len(record)):
            ids = record.column("ids")[k].values.to_numpy(zero_copy_only=False)
            levels = [
                tuple(np.frombuffer(held[c], "<i4") for c in ("limits", "columns", "impacts"))
                for held in record.column("levels")[k].as_py()
            ]
            yield Index(ids, [(a, b, c.astype(np.int64)) for a, b, c in levels])


# --- search ------------------------------------------------------------------------------


class Search:
    """The best ``k`` documents so far of each item of a block."""

    def __init__(self, items: Items, k: int, least: np.ndarray):
        self.items, self.k, self.root = items, k, items.hierarchy()
        self.least = least.copy()  # of each item: scores below it are of no use
        none = np.zeros(0, np.int64)
        self.best = [(none, none)] * len(items.ids)
        self._dense = np.zeros(len(items.terms), np.int64)

    def _with(self, members: list[int]) -> np.ndarray:
        own = np.unique(np.concatenate([self.items.columns[m] for m in members]))
        self._dense[own] = self.items.weights[own]
        return own

    def _keep(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least[item]
        ids = np.concatenate([self.best[item][0], ids[good]])
        scores = np.concatenate([self.best[item][1], scores[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[item] = ids[order], scores[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], scores[order[-1]])

    def look(self, index: Index, one_leaf: bool = False) -> None:
        """Search a hierarchy; ``one_leaf``: only the leaf with the best bound of each item."""
        top = len(index.levels) - 1
        stack = [(self.root, np.arange(1), top)] if self.items.ids else []
        while stack:
            node, nodes, level = stack.pop()
            members = self.items.members(node)
            own = self._with(members)
            bounds = index.products(self._dense, nodes, level)
            if isinstance(node, int):
                self._single(node, index, nodes, bounds, level, one_leaf)
            else:
                kept = nodes[bounds >= self.least[members].min()]
                if level > 1:
                    kept, level = index.children(kept, level), level - 1
                if len(kept):
                    stack += [(child, kept, level) for child in node]
            self._dense[own] = 0

    def _single(self, item, index, nodes, bounds, level, one_leaf) -> None:
        while level > 1:
            nodes = nodes[bounds >= self.least[item]]
            nodes, level = index.children(nodes, level), level - 1
            bounds = index.products(self._dense, nodes, level)
        order = np.argsort(-bounds, kind="stable")
        nodes, bounds = nodes[order], bounds[order]
        width = 1 if one_leaf else LEAVES
        for low in range(0, 1 if one_leaf else len(nodes), width):
            good = bounds[low : low + width] >= self.least[item]
            if not good.any():
                return
            docs = index.children(nodes[low : low + width][good], 1)
            self._keep(item, index.ids[docs], index.products(self._dense, docs, 0))


def _searched(indexes: DataFrame, sent, k: int, least, one_leaf: bool) -> DataFrame:
    """(item, id, score): for each task the best of its documents, score above 0."""

    def find(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(sent.value, k, np.maximum(least.value, 1))
        for index in _indexes(records):
            search.look(index, one_leaf)
        found = [np.full(len(b[0]), item) for item, b in enumerate(search.best)]
        columns = [found, [b[0] for b in search.best], [b[1] for b in search.best]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in columns],
            names=["item", "id", "score"],
        )

    return indexes.mapInArrow(find, "item bigint, id bigint, score bigint")


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order))


def _block_results(postings, rows, total: int, length: int, k: int) -> DataFrame:
    """(item_id, rank, id, score) for a block of items, given as (id, terms)."""
    context = postings.sparkSession.sparkContext
    lists = [np.array(r["terms"], np.int64).view(U64) for r in rows]
    terms = np.unique(np.concatenate(lists))
    frequency = _frequencies(postings, terms)
    weights = np.array([weight(total, int(f)) for f in frequency], np.int64)
    columns = [np.sort(np.searchsorted(terms, x)) for x in lists]
    sent = context.broadcast(Items([r["id"] for r in rows], columns, terms, frequency, weights))
    indexes = materialize(_indexed(postings, sent, total, length), "lexical-index")
    least = np.zeros(len(rows), np.int64)
    seeds = _ranked(_searched(indexes, sent, k, context.broadcast(least), True))
    for seed in seeds.filter(F.col("rank") == k).select("item", "score").collect():
        least[seed["item"]] = seed["score"]
    found = _searched(indexes, sent, k, context.broadcast(least), False)
    best = materialize(_ranked(found).filter(F.col("rank") <= k), "lexical-best")
    names = postings.sparkSession.createDataFrame(
        [(number, r["id"]) for number, r in enumerate(rows)], "item bigint, item_id bigint"
    )
    return best.join(names, "item").select("item_id", "rank", "id", "score")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """For each item its ``k`` documents with the highest scores above 0: item_id, rank (from 1), id,
    score. Equal scores go by ascending id, a null one last.

    Terms are maximal runs of ASCII letters and digits and of all other characters, A-Z lower-cased.
    N documents have a term, L are all their terms, n a document's, df documents hold a term, tf
    times each. w = floor(1000 ln((2N+2) / (2df+1))), m = 10 + (90 n N) div L, and the score sums
    w * ((10^9 tf) div (1000 tf + 8 m)) over the item's different terms.

    Null and empty texts have no terms; such documents count nowhere, such items give no rows. Rows of
    documents are documents of their own, whatever their ids; rows of items with one id (null being
    one) are one item with the terms of all. Empty tables give no rows. Other columns are not read.
    Ids are integers. Terms are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    asked = items.select(items[item_id].cast("bigint").alias("id"), items[item_text].alias("text"))
    terms = materialize(_item_terms(asked), "lexical-terms")
    own = docs.select(docs[id].cast("bigint").alias("id"), docs[text].alias("text"))
    postings = materialize(_postings(own, _filter(terms)), "lexical-postings")
    sums = postings.agg(F.count(F.lit(1)).alias("total"), F.sum("n").alias("length")).collect()[0]
    result = spark.createDataFrame([], "item_id bigint, rank int, id bigint, score bigint")
    blocks = math.ceil(terms.count() / BLOCK_TERMS) if sums["total"] else 0
    for block in range(blocks):
        part = terms.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        rows = part.groupBy("id").agg(F.collect_list("term").alias("terms")).collect()
        if rows:
            found = _block_results(postings, rows, sums["total"], sums["length"], k)
            result = result.unionByName(found)
    return result.select(
        F.col("item_id").alias(item_id),
        "rank",
        F.nullif("id", F.lit(int(_NO_ID))).alias(id),
        "score",
    )
