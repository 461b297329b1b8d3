"""Secret scans: candidate strings, judged by a random forest on what and where they are.

Candidates are long runs of the characters that keys are made of. Each gets numbers for its
length, its character transitions, its coverage by dictionary words, its path and its
neighbouring words. A forest trained on labelled findings then tells secrets from look-alikes.
What a text looks like (pairs of characters, words) is counted on all documents first, summed by
task before it is shuffled. The trained trees become one SQL expression, so the scan itself is a
projection of the table: nothing is shuffled, no Python runs, and hot sources don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.session import materialize

#: Bounds of the labelled findings: documents sampled for them, and findings.
SAMPLE_DOCS, LABELLED_FINDINGS = 30_000, 20_000
#: Bounds of the dictionary, which is counted on all documents: words, and letters of a word.
DICTIONARY_WORDS, WORD_LETTERS = 8192, 32
TREES, DEPTH = 15, 6

_RUN = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
_WHITE = r"[\x20\x09-\x0D]+"
_KEYWORD = r"(?i)(token|secret|passw|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
_HARMLESS = r"(?i)(commit|sha\d*|md5|hash|digest|checksum|uuid|isbn|serial|order|invoice|card|account)"
_TRIAL_PATH = r"(?i)(test|example|sample|fixture|mock|docs?/)"
_ASSIGNED = r"[=:]>?[\"'`]?$"
#: Characters that transitions are counted between; 0 stands for all others.
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"

FEATURES = [
    "length", "digits", "uppers", "lowers", "runs", "mixed", "transitions", "covered", "slashes",
    "trial_path", "keyword", "harmless", "assigned", "quoted", "whole_word",
]
#: Features of the place, which labelled findings also come without: see ``train_forest``.
CONTEXT = ["trial_path", "keyword", "harmless", "assigned", "quoted", "whole_word"]


@dataclass(frozen=True)
class Language:
    """What texts look like: logarithms of pair frequencies and frequent words."""

    pairs: tuple[float, ...]
    words: tuple[str, ...]


def learn_language(docs: DataFrame, text: str = "text") -> Language:
    """From all texts given: log10 frequency of each pair of characters within words, and the
    DICTIONARY_WORDS most frequent words of 4 to WORD_LETTERS letters. Both are bounded in size."""
    words = docs.select(F.explode(F.split(F.lower(docs[text]), r"[^a-z0-9]+")).alias("word"))
    counts = materialize(
        words.filter(F.length("word") > 1).groupBy("word").agg(F.count(F.lit(1)).alias("n")),
        "secret-words",
    )
    letters = F.split("word", "")  # once, as counting to a place would start at the first each time
    pairs = (
        counts.select("n", F.explode(_neighbours(letters, lambda a, b: F.concat(a, b))).alias("pair"))
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    found = {r["pair"]: r["n"] for r in pairs}
    total = sum(found.values()) + len(_ALPHABET) ** 2
    logs = [math.log10((found.get(a + b, 0) + 1) / total) for a in _ALPHABET for b in _ALPHABET]
    frequent = (
        counts.filter(F.col("word").rlike(f"^[a-z]{{4,{WORD_LETTERS}}}$"))
        .orderBy(F.desc("n"), "word")
        .limit(DICTIONARY_WORDS)
        .collect()
    )
    longest_first = sorted((r["word"] for r in frequent), key=lambda w: (-len(w), w))
    return Language(tuple(logs), tuple(longest_first))


def _neighbours(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of each value of an array and the next one."""
    rest = F.size(values) - 1
    return F.zip_with(F.slice(values, F.lit(1), rest), F.slice(values, F.lit(2), rest), join)


def _any_word(words: tuple[str, ...]) -> str:
    """Pattern of the longest of the words that stands at a place, as a tree of their letters, so
    that a match takes a step per letter however many words there are."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        tails = [letter + pattern(node[letter]) for letter in sorted(node) if letter]
        if not tails:
            return ""
        if len(tails) == 1 and "" not in node:
            return tails[0]
        return f"(?:{'|'.join(tails)})" + ("?" if "" in node else "")

    return pattern(tree) or "(?!)"


def _share(found: Column, pattern: str) -> Column:
    kept = F.length(F.regexp_replace(found, pattern, ""))
    return (F.length(found) - kept) / F.length(found)


def _transition_score(found: Column, language: Language) -> Column:
    """Mean logarithm of the frequencies of the pairs of characters in the string."""
    width = len(_ALPHABET)
    table = F.array(*(F.lit(round(x, 6)) for x in language.pairs))
    rare = min(language.pairs)

    codes = F.transform(F.split(F.lower(found), ""), lambda c: F.instr(F.lit(_ALPHABET), c))

    def pair(a: Column, b: Column) -> Column:
        seen = F.element_at(table, F.greatest((a - 1) * width + b, F.lit(1)))
        return F.when((a > 0) & (b > 0), seen).otherwise(rare)

    pairs = _neighbours(codes, pair)
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x) / (F.length(found) - 1)


def _features(found: Column, words: Column, path: Column, language: Language) -> Column:
    """Numbers of one candidate: struct with the fields of FEATURES."""
    text, place = found["text"], found["place"]

    def word(step: int) -> Column:
        return F.coalesce(F.get(words, place + step), F.lit(""))

    before = F.left(word(0), F.instr(word(0), text) - 1)
    near = F.concat_ws(" ", word(-3), word(-2), word(-1), before)
    shape = F.translate(text, "bcdefghijklmnopqrstuvwxyz", "a" * 25)
    shape = F.translate(shape, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 26)
    shape = F.translate(shape, "123456789", "0" * 9)
    known = _any_word(language.words)
    made = {
        "length": F.length(text),
        "digits": _share(text, "[0-9]"),
        "uppers": _share(text, "[A-Z]"),
        "lowers": _share(text, "[a-z]"),
        "runs": F.length(F.regexp_replace(shape, r"(.)\1+", "$1")) / F.length(text),
        "mixed": (text.rlike("[0-9]") & text.rlike("[A-Za-z]")).cast("int"),
        "transitions": _transition_score(text, language),
        "covered": _share(F.lower(text), known),
        "slashes": _share(text, "/"),
        "trial_path": F.coalesce(path.rlike(_TRIAL_PATH), F.lit(False)).cast("int"),
        "keyword": near.rlike(_KEYWORD).cast("int"),
        "harmless": near.rlike(_HARMLESS).cast("int"),
        "assigned": F.concat(word(-1), before).rlike(_ASSIGNED).cast("int"),
        "quoted": before.rlike("[\"'`]$").cast("int"),
        "whole_word": (word(0) == text).cast("int"),
    }
    return F.struct(*(made[name].cast("double").alias(name) for name in FEATURES))


def with_candidates(
    docs: DataFrame, language: Language, text: str = "text", path: str = "source"
) -> DataFrame:
    """All rows in a column ``row``, and ``candidates``: array of struct(text, place, features).

    place: number of the white-space separated word, from 0, in which the candidate stands.
    A null or empty text has none. Texts without any long run are not split into words.
    """
    words = F.when(docs[text].rlike(_RUN), F.split(docs[text], _WHITE))
    split = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"),
        docs[path].cast("string").alias("path"),
        F.coalesce(words, F.array().cast("array<string>")).alias("words"),
    )

    def long_runs(word: Column, place: Column) -> Column:
        runs = F.regexp_extract_all(word, F.lit(_RUN), F.lit(0))
        return F.transform(runs, lambda run: F.struct(run.alias("text"), place.alias("place")))

    long_words = F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("place"))),
        lambda w: (F.length(w["word"]) >= 16) & w["word"].rlike(_RUN),
    )
    runs = F.flatten(F.transform(long_words, lambda w: long_runs(w["word"], w["place"])))
    found = split.select("row", "path", "words", runs.alias("found"))
    features = F.transform(
        "found",
        lambda c: F.struct(
            c["text"].alias("text"),
            c["place"].alias("place"),
            _features(c, F.col("words"), F.col("path"), language).alias("features"),
        ),
    )
    return found.select("row", features.alias("candidates"))


def label_by_context(features: Column) -> Column:
    """Findings in texts labelled by rule: 1 if the string mixes letters and digits and is
    assigned to a name that says secret, 0 otherwise."""
    told = (features["keyword"] == 1) & (features["assigned"] == 1) & (features["harmless"] == 0)
    return (told & (features["mixed"] == 1)).cast("double")


def labelled_findings(docs: DataFrame, language: Language, text: str, path: str) -> DataFrame:
    """Labelled findings (features, label) of a sample of documents."""
    # explode_outer: for explode, Spark would make the candidates once more to test for any
    found = with_candidates(docs, language, text, path)
    found = found.select(F.explode_outer("candidates").alias("c")).filter("c IS NOT NULL")
    return found.select(
        F.col("c.features").alias("features"), label_by_context(F.col("c.features")).alias("label")
    )


def train_forest(findings: DataFrame, seed: int = 5) -> str | None:
    """The trees of a forest trained on ``findings`` (features: struct of FEATURES, label 0/1), as
    Spark prints them for ``forest_share``; None without findings.

    Every finding is learned twice, with and without the features of its place, so that
    a key is also known where no word gives it away.
    """
    findings = materialize(findings, "secret-labelled")
    told = findings.select("label", *(F.col("features")[n].alias(n) for n in FEATURES))
    blind = told.select(
        "label", *(F.lit(0.0).alias(n) if n in CONTEXT else F.col(n) for n in FEATURES)
    )
    rows = materialize(told.unionByName(blind), "secret-findings")
    if rows.isEmpty():
        return None
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows)
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed
    ).fit(assembled)
    return forest.toDebugString


_STEP = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)|^( *)Predict: (\S+)")


def forest_share(trees: str, features: Column) -> Column:
    """The forest, given as Spark prints it, as an expression: share of trees that vote 1."""
    lines = [m for line in trees.splitlines() if (m := _STEP.match(line))]
    at = 0

    def tree() -> Column:
        nonlocal at
        line = lines[at]
        at += 1
        if line[7] is not None:
            return F.lit(float(line[7]))
        test = features[FEATURES[int(line[3])]] <= float(line[5])
        low = tree()
        at += 1  # its Else
        return F.when(test, low).otherwise(tree())

    votes = []
    while at < len(lines):
        votes.append(tree())
    total = votes[0]
    for vote in votes[1:]:
        total = total + vote
    return total / len(votes)


def scan_secrets(
    docs: DataFrame,
    findings: DataFrame | None = None,
    text: str = "text",
    path: str = "source",
    threshold: float = 0.5,
    seed: int = 5,
) -> DataFrame:
    """All rows in a column ``row`` (a struct), and ``findings``: array of struct(text, place,
    features, probability, is_secret), empty where a text holds no candidate.

    Pairs of characters and words are counted on all rows. ``findings``: labelled findings
    (features, label) to train on; without them they are labelled by rule in a sample of at most
    about SAMPLE_DOCS documents and LABELLED_FINDINGS findings, both chosen by seeded hashes and so
    the same in every run. Only training uses the sample: every row is scanned, whole. A null text has no
    findings, a null path is not a trial path. Repeated rows stay. Without any labelled
    finding nothing is called a secret. Other columns are kept in ``row``, whatever their names.
    """
    language = learn_language(docs, text)
    if findings is None:
        share = int(2**30 * min(1.0, SAMPLE_DOCS / max(docs.count(), 1)))
        chosen = F.pmod(F.xxhash64(docs[text], F.lit(seed)), F.lit(2**30)) < share
        sample = docs.filter(chosen)
        findings = labelled_findings(sample, language, text, path)
        by_print = F.xxhash64("features", F.lit(seed))
        findings = findings.orderBy(by_print, "label").limit(LABELLED_FINDINGS)
    trees = train_forest(findings, seed)

    def judged(c: Column) -> Column:
        share = F.lit(0.0) if trees is None else forest_share(trees, c["features"])
        return F.struct(
            c["text"].alias("text"),
            c["place"].alias("place"),
            c["features"].alias("features"),
            share.alias("probability"),
            (share >= threshold).alias("is_secret"),
        )

    found = with_candidates(docs, language, text, path)
    return found.select("row", F.transform("candidates", judged).alias("findings"))


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows that were scanned, with ``mark`` in place of every secret found in the text.

    Longer secrets go first, so that one that holds another leaves no rest in the text."""
    secrets = F.transform(
        F.filter("findings", lambda f: f["is_secret"]),
        lambda f: F.struct((-F.length(f["text"])).alias("size"), f["text"].alias("text")),
    )
    ordered = F.array_sort(F.array_distinct(secrets))
    clean = F.aggregate(
        ordered, F.col("row")[text], lambda t, s: F.replace(t, s["text"], F.lit(mark))
    )
    names = scanned.schema["row"].dataType.names
    return scanned.select(
        *((clean if name == text else F.col("row")[name]).alias(name) for name in names)
    )
