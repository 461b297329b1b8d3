"""Best-fit packing of token sequences, by partitions first and then up a tree.

Each task packs the pieces it has by best fit, the longest first. Nearly full bins are done.
The others are items of the next round, in fewer tasks, until one task holds the rest or a
round no longer helps. A task holds a bounded number of items at a time, whatever its input.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.tokens import SLICE_BYTES, encoder, sent_vocabulary, text_bytes
from tillcast.llm.words import batches, give_back
from tillcast.session import materialize

#: Items that a task packs at once.
ITEMS = 50_000
#: A bin is done when no more than this share of it is empty.
SLACK = 1 / 128
#: Another round is made if the last one saved more than this share of its bins.
GAIN = 0.005

_PIECE = np.dtype(
    [("id", "<i8"), ("named", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"),
     ("crc", "<u4")]
)


def best_fit(sizes: np.ndarray, limit: int) -> list[list[int]]:
    """Numbers of the items in each bin: longest first, each into the fullest bin it fits."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0  # bit r is set if a bin has exactly r left
    for item in np.lexsort((np.arange(len(sizes)), -sizes)).tolist():
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
            bins[chosen].append(item)
        else:
            room, chosen = limit, len(bins)
            bins.append([item])
        room -= size
        if room:
            with_room[room].append(chosen)
            rooms |= 1 << room
    return bins


def _pieces(library, record: pa.RecordBatch, limit: int, last: bytes) -> Iterator[np.ndarray]:
    """The pieces of each document of a record batch, some MB of text at a time."""
    for part, texts in batches(record, "text", False, SLICE_BYTES):
        found = []
        each = library.each_ids(text_bytes(texts))
        for doc, ids in zip(part.column("id").to_pylist(), each, strict=True):
            ids += last
            for number, at in enumerate(range(0, len(ids), 4 * limit)):
                own = ids[at : at + 4 * limit]
                row = (doc or 0, doc is not None, number, at // 4, len(own) // 4)
                found.append((*row, zlib.crc32(own)))
        yield np.array(found, _PIECE)
        give_back()


def _bins(sizes: np.ndarray, pieces: pa.Array, limit: int) -> pa.RecordBatch:
    """Bins of items: how full each is, and the pieces of its items one after the other."""
    bins = best_fit(sizes, limit)
    order = np.concatenate([np.array(b) for b in bins])
    ends = np.cumsum([len(b) for b in bins])
    fill = np.add.reduceat(sizes[order], np.append(0, ends[:-1]))
    _, offsets, data = (taken := pieces.take(pa.array(order))).buffers()
    limits = np.frombuffer(offsets, np.int32)[: len(taken) + 1][np.append(0, ends)]
    packed = pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(limits), data])
    return pa.RecordBatch.from_arrays([pa.array(fill.astype(np.int32)), packed], ["fill", "pieces"])


def _first_bins(docs: DataFrame, vocabulary: str, limit: int, end_id: int) -> DataFrame:
    """Bins of the pieces that each task has, at most about ITEMS at a time. A task cuts and packs in
    one function, so an executor holds one Python worker for each and no piece goes back and forth."""
    blob, kind = sent_vocabulary(docs, vocabulary)
    last = np.array([end_id], "<u4").tobytes()
    most = ITEMS

    def pack(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(blob.value, kind)
        held: list[np.ndarray] = []
        count = 0
        for record in records:
            for pieces in _pieces(library, record, limit, last):
                held.append(pieces)
                count += len(pieces)
                if count >= most:
                    yield bins_of(np.concatenate(held))
                    held, count = [], 0
        if count:
            yield bins_of(np.concatenate(held))

    def bins_of(pieces: np.ndarray) -> pa.RecordBatch:
        limits = np.arange(len(pieces) + 1, dtype=np.int32) * _PIECE.itemsize
        buffers = [None, pa.py_buffer(limits), pa.py_buffer(pieces.tobytes())]
        held = pa.Array.from_buffers(pa.binary(), len(pieces), buffers)
        return _bins(pieces["length"].astype(np.int64), held, limit)

    return docs.mapInArrow(pack, "fill int, pieces binary")


def _packed(items: DataFrame, limit: int) -> DataFrame:
    """Items of each task packed into bins, at most ITEMS at a time."""
    most = ITEMS

    def pack(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for record in records:
            held.append(record)
            count += len(record)
            if count >= most:
                yield bins_of(held)
                held, count = [], 0
        if count:
            yield bins_of(held)

    def bins_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sizes = np.concatenate([record.column("fill").to_numpy() for record in held]).astype(np.int64)
        pieces = pa.concat_arrays([record.column("pieces").cast(pa.binary()) for record in held])
        return _bins(sizes, pieces, limit)

    return items.mapInArrow(pack, "fill int, pieces binary")


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    limit: int = 4096,
    end_id: int = 1,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Place all documents in as few sequences of at most ``limit`` tokens as best fit finds.

    A document is its token ids and then ``end_id``; a null or empty text is ``end_id`` alone.
    Documents longer than ``limit`` are cut into pieces of ``limit``, the last one maybe shorter.
    Returns a row per piece: id, piece (from 0), start (ids of the document before it), length,
    ids_crc32 (of the ids as little-endian 32-bit numbers), sequence_id, offset (its place
    there, without gaps from 0). Ids are integers; rows with a null or repeated id are documents of
    their own. An empty table gives no rows. Other columns are not read.
    """
    full = limit - int(limit * SLACK)
    chosen = docs.select(docs[id].cast("bigint").alias("id"), docs[text].alias("text"))
    bins = materialize(_first_bins(chosen, vocabulary, limit, end_id), "packed")
    done = bins.filter(F.col("fill") >= full)
    rest = bins.filter(F.col("fill") < full)
    count = rest.count()
    while count > 1:
        tasks = math.ceil(count / ITEMS)
        bins = materialize(_packed(rest.repartition(tasks), limit), "packed")
        left = bins.count()
        if tasks == 1 or left > (1 - GAIN) * count:
            rest = bins
            break
        done = done.unionByName(bins.filter(F.col("fill") >= full))
        rest = bins.filter(F.col("fill") < full)
        count = rest.count()
    numbered = done.unionByName(rest).select(
        F.monotonically_increasing_id().alias("sequence_id"), "pieces"
    )

    def places(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            if not len(record):
                continue
            held = record.column("pieces").to_pylist()
            counts = np.array([len(x) // _PIECE.itemsize for x in held])
            rows = np.frombuffer(b"".join(held), _PIECE)
            length = rows["length"].astype(np.int64)
            before = np.cumsum(length) - length
            first = np.cumsum(counts) - counts
            sequences = record.column("sequence_id").to_numpy(zero_copy_only=False)
            columns = [
                pa.array(rows["id"], mask=rows["named"] == 0),
                pa.array(rows["piece"]),
                pa.array(rows["start"]),
                pa.array(length),
                pa.array(rows["crc"].astype(np.int64)),
                pa.array(np.repeat(sequences, counts)),
                pa.array(before - np.repeat(before[first], counts)),
            ]
            names = [id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return numbered.mapInArrow(
        places,
        f"`{id}` bigint, piece int, start bigint, length bigint, ids_crc32 bigint,"
        " sequence_id bigint, offset bigint",
    )
