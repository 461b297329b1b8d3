"""Language-model scores by prediction by partial matching over bytes.

All training texts together give a trie of byte contexts up to ORDER bytes long. A byte is coded in
its longest known context; if it never followed there, an escape is coded (method C: as likely
as the context has different followers) and the next shorter context is asked, from whose
followers those of the longer one are excluded. In the end all bytes not yet excluded are equally
likely. As the followers of a context are among those of any shorter one, what is excluded
depends on the next longer context alone, so sums over it are made once per context.

The counts come from all training texts, by Spark, and none is shed. What a task holds of them is
bounded: up to HEAD_GRAMS longest byte runs the whole trie. Of more, the most frequent HEAD_GRAMS
with their logarithms; all others, and runs that no training text has, meet theirs in a join. So do
words beyond the most frequent HEAD_WORDS.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.llm.words import _WHITE, U64, Texts, batches
from tillcast.session import materialize

#: Length of the longest context in bytes.
ORDER = 5
#: Bounds of what is broadcast: byte runs and words that each task has; the others are joined.
HEAD_GRAMS, HEAD_WORDS = 1 << 21, 1 << 20
#: Byte runs of a smaller model on purpose, that sheds the rarest; None, as always here, keeps all.
GRAMS: int | None = None
#: Entries that a task counts before it hands them on.
CHUNK = 1 << 20
#: Ends a text and pads the context before its start; no word holds this byte.
END = 0x0A
#: Stands for the end among the words.
END_WORD = np.int64(0)


def stream(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one run of bytes, where their bytes to score stand in it, and whose they are.

    Each text is its words, lower-cased and parted by one space, and END. ORDER ENDs go before it.
    """
    starts, ends = texts.spans
    data = texts.data
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    kept = ~_WHITE[data]
    last = np.zeros(len(starts), bool)
    last[texts.first[1:][texts.counts > 0] - 1] = True
    gaps = ends[~last]
    kept[gaps] = True
    lower[gaps] = 0x20
    at = np.flatnonzero(kept)
    owner = np.searchsorted(texts.limits, at, "right") - 1
    sizes = np.bincount(owner, minlength=len(texts))
    n = len(texts)
    out = np.full(len(at) + n * (ORDER + 1), END, np.uint8)
    places = np.arange(len(at)) + owner * (ORDER + 1) + ORDER
    out[places] = lower[at]
    closing = np.cumsum(sizes + ORDER + 1) - 1
    return out, np.concatenate([places, closing]), np.concatenate([owner, np.arange(n)])


def grams_at(run: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The ORDER bytes before each place and the byte there, as one number."""
    codes = np.zeros(len(run), np.int64)
    for back in range(ORDER + 1):
        codes[back:] |= run[: len(run) - back].astype(np.int64) << (8 * back)
    return codes[places]


def _narrow(whole: np.ndarray, most: int | None = None) -> np.ndarray:
    """Numbers from 0 on in the smallest type that holds them all, and any up to ``most``."""
    return whole.astype(np.min_scalar_type(int(whole.max()) if most is None else most))


def trie_levels(grams: np.ndarray, counts: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Per length of context: grams (context and follower, sorted) and their counts; contexts,
    their totals, kinds (number of followers) and shadows (counts of their followers in the next
    shorter context). Each task holds them all, so they are kept in narrow types."""
    levels: list[dict[str, np.ndarray]] = []
    for order in range(ORDER + 1):
        known, at = np.unique(grams & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        if not len(known):
            return []
        count = np.bincount(at, counts)
        context = known >> 8
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        shadows = np.zeros(len(first))
        if order:
            below = levels[-1]
            shorter = (known & ((1 << 8 * order) - 1)).astype(below["grams"].dtype)
            same = np.searchsorted(below["grams"], shorter)
            shadows = np.add.reduceat(below["counts"][same].astype(float), first)
        levels.append(
            {
                "grams": _narrow(known, (1 << 8 * (order + 1)) - 1),
                "counts": _narrow(count),
                "contexts": _narrow(context[first], (1 << 8 * order) - 1),
                "totals": _narrow(np.add.reduceat(count, first)),
                "kinds": _narrow(np.diff(np.append(first, len(known)))),
                "shadows": _narrow(shadows),
            }
        )
    return levels


def gram_log10(levels: list[dict[str, np.ndarray]], grams: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's last byte after the bytes before it."""
    found = np.zeros(len(grams))
    left = np.arange(len(grams))
    shadow, hidden = np.zeros(len(grams)), np.zeros(len(grams))  # of the longer context
    for order in reversed(range(len(levels))):
        level = levels[order]
        if not len(left):
            break
        gram = grams[left] & ((1 << 8 * (order + 1)) - 1)
        contexts, known_grams = level["contexts"], level["grams"]
        context, gram = (gram >> 8).astype(contexts.dtype), gram.astype(known_grams.dtype)
        at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        known = contexts[at] == context
        total = np.where(known, level["totals"][at] - shadow[left], 0.0)
        kinds = np.where(known, level["kinds"][at] - hidden[left], 0.0)
        entry = np.minimum(np.searchsorted(known_grams, gram), len(known_grams) - 1)
        hit = known_grams[entry] == gram
        with np.errstate(divide="ignore", invalid="ignore"):
            coded = np.log10(level["counts"][entry] / (total + kinds))
            escape = np.where(kinds > 0, np.log10(kinds / (total + kinds)), 0.0)
        found[left] += np.where(hit, coded, escape)
        shadow[left] = np.where(known, level["shadows"][at], shadow[left])
        hidden[left] = np.where(known, level["kinds"][at], hidden[left])
        left = left[~hit]
    found[left] -= np.log10(256 - hidden[left])
    return found


def held_out(ids: list) -> np.ndarray:
    """Whether crc32 of the id as text is a multiple of 10; a null id counts as no text."""
    crc = (zlib.crc32(b"" if i is None else str(i).encode()) for i in ids)
    return np.fromiter((c % 10 == 0 for c in crc), bool, len(ids))


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else order
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over the training documents: byte runs (kind 0) and words (kind 1)."""

    def count(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        sizes = [0, 0]
        for record in records:
            for part, texts in batches(record, "text", True, 1 << 20):
                trains = ~held_out(part.column("id").to_pylist())
                if not trains.all():
                    texts = texts.take(trains)
                if not len(texts):
                    continue
                run, places, _ = stream(texts)
                ends = np.full(len(texts), END_WORD)
                words = np.concatenate([texts.words.view(np.int64), ends])
                for kind, keys in enumerate((grams_at(run, places), words)):
                    held[kind].append(_summed(keys))
                    sizes[kind] += len(held[kind][-1][0])
                    if sizes[kind] > CHUNK:
                        yield made(kind, held[kind])
                        held[kind], sizes[kind] = [], 0
        for kind in (0, 1):
            if sizes[kind]:
                yield made(kind, held[kind])

    def made(kind: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        columns = [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(counts)]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "n"])

    found = docs.mapInArrow(count, "kind int, key bigint, n bigint")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _step() -> Column:
    """Place of a count among steps of a sixteenth of a power of two."""
    return F.floor(F.log2("n") * 16).cast("int")


def _least_step(counts: DataFrame, most: int) -> int:
    """The first step from which on at most ``most`` entries lie; 0 if all do."""
    sizes = counts.groupBy(_step().alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()
    total = 0
    for row in sorted(sizes, key=lambda r: -r["step"]):
        total += row["rows"]
        if total > most:
            return row["step"] + 1
    return 0


def _collected(entries: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and a value of each."""
    kept = entries.select("key", value).toArrow()
    keys, values = kept.column("key").to_numpy(), kept.column(value).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def _most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and counts of all entries met so often that at most ``most`` are, sorted by key, and
    the least step of their counts."""
    least = _least_step(counts, most)
    return *_collected(counts.filter(_step() >= least), "n"), least


def run_logs(runs: DataFrame) -> DataFrame:
    """(key, n, log) of runs (key, n): log10 of the probability of each run's last byte, which is
    always coded in the longest context. A context has at most 256 runs."""
    context = Window.partitionBy(F.shiftright("key", 8))
    whole = F.sum("n").over(context) + F.count(F.lit(1)).over(context)
    return runs.select("key", "n", F.log10(F.col("n") / whole).alias("log"))


def escaped_logs(unseen: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, log) of distinct runs (key) that are not among ``runs`` (key, n): as ``gram_log10``,
    with the levels of the trie as a table that is joined by context and by run.

    Shorter contexts of a known one are known, so the next longer level tells what is excluded."""

    def low_bytes(count: str) -> Column:
        return F.col("key").bitwiseAND(F.expr(f"shiftleft(1L, 8 * ({count})) - 1"))

    shorter = runs.select("n", "key", F.explode(F.sequence(F.lit(0), F.lit(ORDER - 1))).alias("level"))
    levels = materialize(
        shorter.groupBy("level", low_bytes("level + 1").alias("key"))
        .agg(F.sum("n").alias("n"))
        .unionByName(runs.select(F.lit(ORDER).alias("level"), "key", "n")),
        "ppm-levels",
    )
    below = Window.partitionBy("level", low_bytes("level"))  # one run of the next shorter level
    contexts = (
        levels.withColumn("below", F.sum("n").over(below))
        .groupBy("level", F.shiftright("key", 8).alias("context"))
        .agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("below").alias("shadow")
        )
    )
    places = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("level")
    asked = unseen.select(F.col("key").alias("run"), "key", places).withColumn(
        "key", low_bytes("level + 1")
    )
    numbers = ("n", "total", "kinds", "shadow")
    met = (
        asked.withColumn("context", F.shiftright("key", 8))
        .join(levels, ["level", "key"], "left")
        .join(contexts, ["level", "context"], "left")
        .groupBy("run")
        .agg(
            *(
                F.max(F.when(F.col("level") == o, F.col(c))).alias(f"{c}{o}")
                for o in range(ORDER + 1)
                for c in numbers
            )
        )
    )
    kinds0 = F.coalesce("kinds0", F.lit(0))
    log = F.when(F.col("n0").isNull(), -F.log10(256 - kinds0)).otherwise(0.0)
    for o in range(ORDER + 1):
        shadow = hidden = F.lit(0)
        left = F.lit(True)
        if o < ORDER:
            shadow, hidden = (F.coalesce(f"{c}{o + 1}", F.lit(0)) for c in ("shadow", "kinds"))
            left = F.col(f"n{o + 1}").isNull()
        kinds = F.col(f"kinds{o}") - hidden
        whole = F.col(f"total{o}") - shadow + kinds
        coded = F.when(F.col(f"n{o}").isNotNull(), F.log10(F.col(f"n{o}") / whole))
        log += F.when(left, coded.when(kinds > 0, F.log10(kinds / whole)).otherwise(0.0)).otherwise(0.0)
    return met.select(F.col("run").alias("key"), log.alias("log"))


def score_texts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes (scored).

    Documents with crc32(id as text) mod 10 other than 0 train; all are scored. Tokens are the words
    of the text, A-Z lower-cased, and one end. base_score is log10 of the text's probability by
    add-0.1 counts of words, score by the byte trie (of the words parted by one space, and the
    end). A null or empty text is the end alone. A row with a null id is held out; repeated rows
    train and are scored as often as they come. If nothing trains, all bytes are equally likely. An
    empty table gives no rows. Other columns are not read. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession.sparkContext
    chosen = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    counts = materialize(corpus_counts(chosen), "ppm-counts")
    words = counts.filter("kind = 1")
    trained = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = int(trained[0]), int(trained[1])
    runs = counts.filter("kind = 0").select("key", "n")
    if GRAMS is not None:
        runs = runs.filter(_step() >= _least_step(runs, GRAMS))
    rarest = _least_step(runs, HEAD_GRAMS)
    if rarest:
        runs = materialize(run_logs(runs), "ppm-runs")
        model = spark.broadcast(_collected(runs.filter(_step() >= rarest), "log"))
    else:
        model = spark.broadcast(trie_levels(*_collected(runs, "n")))
    head, head_n, least = _most_frequent(words, HEAD_WORDS)
    common = spark.broadcast((head, np.log10(head_n + 0.1)))

    def score(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = common.value
        row = TaskContext.get().partitionId() << 40
        for record in records:
            for part, texts in batches(record, "text", True, 1 << 20):
                size = len(part)
                ids = part.column("id")
                run, places, owner = stream(texts)
                distinct, at = np.unique(grams_at(run, places), return_inverse=True)
                if rarest:
                    frequent, run_log = model.value
                    coded, logs_of = np.zeros(len(distinct), bool), np.zeros(len(distinct))
                    if len(frequent):
                        place = np.minimum(np.searchsorted(frequent, distinct), len(frequent) - 1)
                        coded = frequent[place] == distinct
                        logs_of[coded] = run_log[place[coded]]
                else:
                    coded, logs_of = np.ones(len(distinct), bool), gram_log10(model.value, distinct)
                total = np.bincount(owner, logs_of[at], size)
                own = np.concatenate([texts.words.view(np.int64), np.full(size, END_WORD)])
                whose = np.concatenate([np.repeat(np.arange(size), texts.counts), np.arange(size)])
                known = np.zeros(len(own), bool)
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    known = keys[place] == own
                    base = np.bincount(whose[known], logs[place[known]], size)
                else:
                    base = np.zeros(size)
                rows = row + np.arange(size)
                row += size
                columns = [
                    pa.array(np.zeros(size, np.int32)),
                    pa.array(rows),
                    ids,
                    pa.array(held_out(ids.to_pylist())),
                    pa.array(texts.counts + 1),
                    pa.array(np.bincount(whose[known], minlength=size)),
                    pa.array(base),
                    pa.array(total),
                    pa.array(np.bincount(owner, minlength=size)),
                    pa.nulls(size, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                yield tail(1, rows[whose[~known]], own[~known], ids.type)
                if not coded.all():
                    rare = ~coded[at]
                    yield tail(2, rows[owner[rare]], distinct[at[rare]], ids.type)

    def tail(
        kind: int, rows: np.ndarray, keys: np.ndarray, kind_of_id: pa.DataType
    ) -> pa.RecordBatch:
        order = np.lexsort((keys, rows))
        rows, keys = rows[order], keys[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
        first = np.flatnonzero(new)
        uses = np.diff(np.append(first, len(rows)))
        size = len(first)
        columns = {
            "kind": pa.array(np.full(size, kind, np.int32)),
            "row": pa.array(rows[first]),
            "n_tokens": pa.array(uses),
            "key": pa.array(keys[first]),
        }
        types = dict(zip(names, kinds_of(kind_of_id), strict=True))
        return pa.RecordBatch.from_arrays(
            [columns.get(c, pa.nulls(size, types[c])) for c in names], names=names
        )

    def kinds_of(kind_of_id: pa.DataType) -> list[pa.DataType]:
        whole, real = pa.int64(), pa.float64()
        return [pa.int32(), whole, kind_of_id, pa.bool_(), whole, whole, real, real, whole, whole]

    names = [
        "kind", "row", "id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "key",
    ]
    kind_of_id = docs.schema[id].dataType.simpleString()
    scored = materialize(
        chosen.mapInArrow(
            score,
            f"kind int, row bigint, id {kind_of_id}, held_out boolean, n_tokens bigint,"
            " n_known bigint, base double, score double, n_bytes bigint, key bigint",
        ),
        "ppm-scores",
    )
    logs = words.filter(_step() < least).select(
        F.lit(1).alias("kind"), "key", F.log10(F.col("n") + 0.1).alias("log")
    )
    uses = scored.filter("kind > 0").select("kind", "row", "key", F.col("n_tokens").alias("uses"))
    if rarest:
        others = runs.filter(_step() < rarest).select("key", "log")
        asked = uses.filter("kind = 2").select("key").distinct()
        unseen = materialize(asked.join(others, "key", "left_anti"), "ppm-unseen")
        others = others.unionByName(escaped_logs(unseen, runs.select("key", "n")))
        logs = logs.unionByName(others.select(F.lit(2).alias("kind"), "key", "log"))
    word, used = F.col("kind") == 1, F.col("uses") * F.col("log")
    added = (
        uses.join(logs, ["kind", "key"], "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(word & F.col("log").isNotNull(), F.col("uses"))).alias("more_known"),
            F.sum(F.when(word, F.coalesce(used, F.col("uses") * F.log10(F.lit(0.1))))).alias("more"),
            F.sum(F.when(~word, used)).alias("more_score"),
        )
    )
    below = F.log10(F.lit(n + 0.1 * (v + 1)))
    return (
        scored.filter("kind = 0")
        .join(added, "row", "left")
        .select(
            F.col("id").alias(id),
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(n).cast("bigint").alias("train_tokens"),
            (
                F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * below
            ).alias("base_score"),
            (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
            "n_bytes",
        )
    )
