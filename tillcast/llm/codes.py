"""Vector codes: each part of a vector becomes the number of its codebook's nearest entry.

Codebooks are learned in rounds: every part goes to its nearest entry, then every entry becomes the
mean of its parts. Parts are kept in metric trees by the anchors hierarchy. Of a set of points some
sqrt(n) anchors are chosen, each the point farthest from its own anchor so far, and take the points
nearer to them, most of which the triangle inequality leaves untouched. Anchors are merged upwards
into balls from the middle, and each anchor's points are split downwards in the same way. A ball
caches the sum and the count of its points. A round walks down a tree with a list of entries that may
be the nearest one for some point of the ball; children inherit the list and shorten it, and once one
entry is left it owns the whole ball, whose sum and count are added without touching a point.

Trees are made once, for blocks of vectors, and written; each round reads them and sends its sums by
part and entry. All arithmetic that decides is on integers, so results don't depend on the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.session import materialize

#: Vectors whose trees are made together, and points below which a ball isn't split.
BLOCK, LEAF = 2048, 24
_FIELDS = {"order": "<i4", "points": "<i4", "nodes": "<i4", "sums": "<i8", "radius": "<f8"}
_TREE = f"struct<{','.join(f'{name}:binary' for name in _FIELDS)}>"
_ARROW_TREE = pa.struct([(name, pa.binary()) for name in _FIELDS])


# --- metric trees ------------------------------------------------------------------------


@dataclass
class Tree:
    """A hierarchy of balls over points. ``points`` lie in the order of the leaves; ``order`` holds
    their numbers. ``nodes``: first and last point, left and right child (-1: a leaf); parents
    come before children. ``sums`` and ``radius`` are those of each ball, whose centre is the mean."""

    order: np.ndarray
    points: np.ndarray
    nodes: np.ndarray
    sums: np.ndarray
    radius: np.ndarray

    def packed(self) -> dict[str, bytes]:
        return {name: getattr(self, name).astype(kind).tobytes() for name, kind in _FIELDS.items()}

    @staticmethod
    def unpacked(held: dict[str, bytes], width: int) -> Tree:
        return Tree(
            np.frombuffer(held["order"], "<i4"),
            np.frombuffer(held["points"], "<i4").reshape(-1, width).astype(np.float64),
            np.frombuffer(held["nodes"], "<i4").reshape(-1, 4),
            np.frombuffer(held["sums"], "<i8").reshape(-1, width),
            np.frombuffer(held["radius"], "<f8"),
        )


def _distance(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = points - centre
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


def _anchors(points: np.ndarray) -> np.ndarray:
    """For each point the number of its anchor, of about sqrt(n)."""
    n = len(points)
    owner = np.zeros(n, np.int64)
    centres = points[:1]
    reach = _distance(points, points[0])
    for new in range(1, int(np.ceil(np.sqrt(n)))):
        far = int(reach.argmax())
        if reach[far] == 0:
            break
        # a point nearer to its anchor than half the way to the new one stays
        near = np.flatnonzero(2 * reach >= _distance(centres, points[far])[owner])
        length = _distance(points[near], points[far])
        taken = length < reach[near]
        owner[near[taken]], reach[near[taken]] = new, length[taken]
        centres = np.concatenate([centres, points[far : far + 1]])
    return owner


def _merged(groups: list[np.ndarray], points: np.ndarray, made: list) -> list:
    """The hierarchy over groups of points: always the two that fit into the smallest ball."""
    n = len(groups)
    if n == 1:
        return made[0]
    count = np.array([len(g) for g in groups], float)
    centre = np.array([points[g].mean(axis=0) for g in groups])
    radius = np.array([_distance(points[g], c).max() for g, c in zip(groups, centre, strict=True)])
    apart = np.sqrt(np.maximum(((centre[:, None] - centre[None]) ** 2).sum(axis=2), 0))
    cost = (apart + radius[:, None] + radius[None]) / 2
    np.fill_diagonal(cost, np.inf)
    held = list(made)
    for _ in range(n - 1):
        a, b = divmod(int(cost.argmin()), n)
        held[a] = (held[a], held[b])
        both = count[a] + count[b]
        middle = (centre[a] * count[a] + centre[b] * count[b]) / both
        radius[a] = max(
            np.linalg.norm(middle - centre[a]) + radius[a],
            np.linalg.norm(middle - centre[b]) + radius[b],
        )
        centre[a], count[a] = middle, both
        cost[b], cost[:, b] = np.inf, np.inf
        alive = np.isfinite(cost[a])
        alive[a] = False
        line = np.where(alive, (_distance(centre, middle) + radius + radius[a]) / 2, np.inf)
        cost[a], cost[:, a] = line, line
        if not alive.any():
            return held[a]
    return held[a]


def _hierarchy(points: np.ndarray, numbers: np.ndarray):
    """Pairs of pairs down to arrays of point numbers. Equal points are one leaf."""
    if len(numbers) <= LEAF:
        return numbers
    owner = _anchors(points[numbers])
    if not owner.any():
        return numbers
    by_owner = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[by_owner])) + 1
    groups = [numbers[g] for g in np.split(by_owner, cuts)]
    return _merged(groups, points, [_hierarchy(points, g) for g in groups])


def build_tree(points: np.ndarray) -> Tree:
    """The tree of integer points, one a row."""
    points = points.astype(np.float64)
    nodes: list[list[int]] = []
    leaves: list[np.ndarray] = []
    at = 0
    stack = [(_hierarchy(points, np.arange(len(points))), -1, 0)]
    while stack:
        part, parent, side = stack.pop()
        if parent >= 0:
            nodes[parent][side] = len(nodes)
        nodes.append([at, -1, -1, -1])
        if isinstance(part, tuple):
            stack += [(part[1], len(nodes) - 1, 3), (part[0], len(nodes) - 1, 2)]
        else:
            leaves.append(part)
            at += len(part)
            nodes[-1][1] = at
    for node in reversed(nodes):
        if node[1] < 0:
            node[1] = nodes[node[3]][1]
    order = np.concatenate(leaves)
    points = points[order]
    limits = np.array(nodes)
    before = np.zeros((len(points) + 1, points.shape[1]), np.int64)
    np.cumsum(points.astype(np.int64), axis=0, out=before[1:])
    sums = before[limits[:, 1]] - before[limits[:, 0]]
    radius = [
        _distance(points[low:high], total / (high - low)).max()
        for (low, high), total in zip(limits[:, :2].tolist(), sums, strict=True)
    ]
    return Tree(order, points, limits, sums, np.array(radius))


def owners(tree: Tree, book: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | int]]:
    """(node, first, end, entries): balls owned by one entry, or with an entry for each point.

    ``book`` holds the entries, as doubles of integers. An entry equal to an earlier one can own
    nothing. In a ball of radius r around c, entry e is nearer than f to every point if
    |c-f|^2 - |c-e|^2 > 2 r |e-f|; only differences beyond rounding count.
    """
    norms = np.einsum("ij,ij->i", book, book)
    gaps = np.sqrt(np.maximum(norms[:, None] + norms[None] - 2 * (book @ book.T), 0))
    first = np.sort(np.unique(book, axis=0, return_index=True)[1])
    nodes, radius = tree.nodes.tolist(), tree.radius.tolist()
    centres = tree.sums / (tree.nodes[:, 1] - tree.nodes[:, 0])[:, None]
    stack = [(0, first)]
    while stack:
        node, maybe = stack.pop()
        low, high, left, right = nodes[node]
        if radius[node] > 0 and len(maybe) > 1:
            apart = book[maybe] - centres[node]
            far = np.einsum("ij,ij->i", apart, apart)
            best = int(far.argmin())
            room = 2 * radius[node] * gaps[maybe[best], maybe] + 1e-7 * (1 + far.max())
            maybe = maybe[far - far[best] <= room]
        if len(maybe) == 1:
            yield node, low, high, int(maybe[0])
        elif radius[node] == 0 or left < 0:
            end = low + 1 if radius[node] == 0 else high
            costs = norms[maybe] - 2 * (tree.points[low:end] @ book[maybe].T)
            nearest = maybe[costs.argmin(axis=1)]  # the first of equals: the lowest number
            yield node, low, high, int(nearest[0]) if radius[node] == 0 else nearest
        else:
            stack += [(left, maybe), (right, maybe)]


def totals(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the points nearest to each entry."""
    counts = np.zeros(len(book), np.int64)
    sums = np.zeros(book.shape, np.int64)
    for node, low, high, entry in owners(tree, book):
        if isinstance(entry, int):
            counts[entry] += high - low
            sums[entry] += tree.sums[node]
        else:
            np.add.at(counts, entry, 1)
            np.add.at(sums, entry, tree.points[low:high].astype(np.int64))
    return counts, sums


def nearest(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each point and its squared distance, by point number."""
    entries = np.zeros(len(tree.points), np.int64)
    for _, low, high, entry in owners(tree, book):
        entries[low:high] = entry
    apart = (tree.points - book[entries]).astype(np.int64)
    back = np.argsort(tree.order)
    return entries[back], (apart * apart).sum(axis=1)[back]


# --- the job -----------------------------------------------------------------------------


def _sound(vector: Column) -> Column:
    """Whether a vector can take part: neither null nor with null or non-finite components."""
    endless = float("inf")
    return vector.isNotNull() & F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(endless)),
    )


def _width(vectors: DataFrame, parts: int) -> int:
    """The most frequent length of a vector that can be cut into equal parts, 0 without any."""
    found = (
        vectors.groupBy(F.size("vector").alias("width"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("width") > 0) & (F.col("width") % parts == 0))
        .orderBy(F.desc("n"), F.desc("width"))
        .limit(1)
        .collect()
    )
    return found[0]["width"] if found else 0


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, width)


def _blocks(vectors: DataFrame, width: int, parts: int) -> DataFrame:
    """Rows (ids, labels, trees): blocks of vectors with a tree for each part."""
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}
    step, block = width // parts, BLOCK
    # so that four times a squared distance is a whole number in a double
    most = int(np.sqrt(2.0**51 / step)) // 2

    def build(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for record in records:
            for low in range(0, len(record), block):
                held.append(record.slice(low, block))
                count += len(held[-1])
                while count >= block:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    yield made(whole.slice(0, block))
                    held = whole.slice(block).to_batches()
                    count -= block
        if count:
            yield made(pa.Table.from_batches(held).combine_chunks())

    def made(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        vectors = _rows_of(rows.column("vector").chunk(0), width)
        if np.abs(vectors).max() > most:
            raise ValueError(f"a component is beyond {most} after scaling")
        trees = [
            build_tree(vectors[:, k * step : (k + 1) * step]).packed() for k in range(parts)
        ]
        limits = pa.array([0, len(rows)], pa.int32())
        columns = [
            pa.ListArray.from_arrays(limits, rows.column(c).chunk(0)) for c in ("id", "label")
        ]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([trees], pa.list_(_ARROW_TREE))], names=["ids", "labels", "trees"]
        )

    return vectors.mapInArrow(
        build, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, trees array<{_TREE}>"
    )


def _first_books(vectors: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """Per part the parts of the rows with the smallest ids; an entry per row, at most ``entries``."""
    rows = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector")
    found = np.array([r[0] for r in rows.collect()], np.float64).reshape(-1, parts, width // parts)
    return found.transpose(1, 0, 2)


def _trees(records: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each block, alone, with its trees."""
    for record in records:
        for k in range(len(record)):
            block = record.slice(k, 1)
            yield block, [Tree.unpacked(t, step) for t in block.column("trees")[0].as_py()]


def _next_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry replaced by the mean, rounded down, of the parts nearest to it, if any."""
    parts, entries, step = books.shape
    sent = blocks.sparkSession.sparkContext.broadcast(books)
    names = [f"s{k}" for k in range(step)]

    def add(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros(books.shape, np.int64)
        for _, trees in _trees(records, step):
            for k, tree in enumerate(trees):
                n, total = totals(tree, sent.value[k])
                counts[k] += n
                sums[k] += total
        part, entry = np.nonzero(counts)
        columns = [part, entry, counts[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(c)) for c in columns], names=["part", "entry", "n", *names]
        )

    held = blocks.select("trees").mapInArrow(
        add, ", ".join(f"{c} bigint" for c in ["part", "entry", "n", *names])
    )
    found = held.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).toArrow()
    part, entry, n = (found.column(c).to_numpy() for c in ("part", "entry", "n"))
    made = books.copy()
    for k, name in enumerate(names):
        made[part, entry, k] = found.column(name).to_numpy() // n
    sent.unpersist()
    return made


def _coded(blocks: DataFrame, books: np.ndarray, kinds: dict[str, str]) -> DataFrame:
    """Rows (id, label, code, error) of every vector."""
    step = books.shape[2]
    sent = blocks.sparkSession.sparkContext.broadcast(books)
    digits = np.array([f"{k:02x}" for k in range(books.shape[1])], object)

    def code(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, trees in _trees(records, step):
            text, error = "", 0
            for k, tree in enumerate(trees):
                entries, apart = nearest(tree, sent.value[k])
                text, error = text + digits[entries], error + apart
            columns = [block.column(c)[0].values for c in ("ids", "labels")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(text, pa.string()), pa.array(error)],
                names=["id", "label", "code", "error"],
            )

    return blocks.mapInArrow(
        code, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"
    )


def compress_vectors(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Per vector: id, code, error, label_error, codebooks_sha256.

    A component x becomes the integer floor(``scale`` * x). Each of ``parts`` equal parts has a
    codebook, at first the parts of the rows with the ``entries`` smallest ids; ``rounds`` times all
    parts go to their nearest entry (squared distance, ties to the lower number) and entries become
    the means of their parts, rounded down; unused ones stay. code: two hexadecimal digits per part;
    error: sum of the final squared distances; label_error: sum of errors over the rows with this
    label, null being one label; codebooks_sha256: of all entries' components, joined by commas.

    Rows whose vector is null or holds null or non-finite components take no part, nor do vectors of
    another length than the most frequent one that ``parts`` divides. Repeated rows and ids are rows
    of their own; among equal ids those with smaller vectors come first, null ids last. With fewer
    rows than ``entries`` codebooks are shorter. An empty table gives no rows. A component beyond
    some ten million after scaling is an error. Other columns are not read.
    """
    floor = F.transform(
        vectors[vector], lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")
    )
    chosen = vectors.select(
        vectors[id].alias("id"), vectors[label].alias("label"), floor.alias("vector")
    ).filter(_sound(vectors[vector]))
    kinds = {c: chosen.schema[c].dataType.simpleString() for c in ("id", "label")}
    width = _width(chosen, parts)
    names = f"`{id}` {kinds['id']}, code string, error bigint, label_error bigint"
    if not width:
        return vectors.sparkSession.createDataFrame([], f"{names}, codebooks_sha256 string")
    chosen = chosen.filter(F.size("vector") == width)
    blocks = materialize(_blocks(chosen, width, parts), "codes-trees")
    books = _first_books(chosen, width, parts, entries)
    for _ in range(rounds):
        books = _next_books(blocks, books)
    shown = ",".join(str(int(x)) for x in books.reshape(-1))
    digest = hashlib.sha256(shown.encode()).hexdigest()
    coded = materialize(_coded(blocks, books, kinds), "codes-rows")
    by_label = materialize(
        coded.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels"
    )
    named = by_label.withColumnRenamed("label", "own_label")
    return coded.join(named, F.col("label").eqNullSafe(F.col("own_label"))).select(
        F.col("id").alias(id), "code", "error", "label_error",
        F.lit(digest).alias("codebooks_sha256"),
    )
