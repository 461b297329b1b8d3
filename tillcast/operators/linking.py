"""Item and branch names in question texts: containment, fuzzy linking, screens, answers.

Texts have columns text_id and text (normalised); names have the column name (normalised), with
their kind where both kinds are handled together. No step compares every text with every name:
both sides meet in equi-joins on short keys, and the exact test runs on what those joins leave.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions import text as tx
from tillcast.session import materialize

ITEM, BRANCH = "item", "branch"
GRAM = 5
#: Letters of all names up to which they become one pattern, which every task holds.
PATTERN_LETTERS = 20_000
#: Words are alike if equal, or one edit apart and no less similar than this percentage: 100 less
#: the share that the edit has of the longer word. It holds for letters and digits alike.
SIMILAR_WORDS = 60
#: Files of words that recur are a small part of their rows, so their size doesn't tell what the driver can
#: hold. What is made of names alone is broadcast if the squares of their lengths, which bound it, add
#: up to no more than this; pairs of similar words are if there are no more of them.
LOOKUP_LETTERS, LOOKUP_PAIRS = 1 << 21, 100_000

# Scores (0 to 100) from which a name counts as found or as a suggestion.
FOUND_ITEM = 60
FOUND_BRANCH = 40
SUGGESTED = 40

# Wording of the answers.
ITEMS_FOUND = "Items found in your query: %s. "
BRANCHES_FOUND = "Branches found in your query: %s. "
ITEMS_MEANT = "Did you mean these items: %s?"
NOTHING_FOUND = "No matching items or branches found. Please check your query."
UNSAFE = "Your query contains potentially unsafe SQL keywords."
ABUSIVE = "Your query contains inappropriate language. Please modify your query and try again."


# --- containment -------------------------------------------------------------------------


def _grams(text: Column, size: int) -> Column:
    """All distinct character runs of one length, in a single pass over the text."""
    return F.array_distinct(
        F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    )


def _rarest_gram(names: DataFrame) -> DataFrame:
    """Rows (name, _key): of each name's runs of characters the one fewest names share."""
    grams = names.select("name", F.explode(_grams(F.col("name"), GRAM)).alias("_key"))
    counts = grams.groupBy("_key").agg(F.count(F.lit(1)).alias("_names"))
    return (
        grams.join(counts, "_key")
        .groupBy("name")
        .agg(F.min_by("_key", F.struct("_names", "_key")).alias("_key"))
    )


def any_of(names: Sequence[str]) -> str:
    """Pattern of the longest of the names that starts at a place.

    The names share their beginnings as in a tree, so a place costs a step per letter, however many
    names there are."""
    tree: dict = {}
    for name in names:
        node = tree
        for letter in name:
            node = node.setdefault(letter, {})
        node[""] = {}

    def literal(letter: str) -> str:
        return f"\\{letter}" if letter.isascii() and not letter.isalnum() else letter

    def pattern(node: dict) -> str:
        tails = [literal(c) + pattern(node[c]) for c in sorted(node) if c]
        if not tails:
            return ""
        if len(tails) == 1 and "" not in node:
            return tails[0]
        return f"(?:{'|'.join(tails)})" + ("?" if "" in node else "")

    return pattern(tree)


def _mentions_in_one_pass(texts: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same for few names: one scan of each text for all of them.

    At each place the longest name is found, and the others that stand there are its beginnings, so
    a text sends its matches only."""
    known = set(names)
    starts = [
        (longest, longest[:k]) for longest in names for k in range(1, len(longest) + 1)
        if longest[:k] in known
    ]
    starting = texts.sparkSession.createDataFrame(starts, "_longest string, name string")
    found = F.regexp_extract_all(F.col("text"), F.lit(f"(?s)(?=({any_of(names)}))"), F.lit(1))
    return (
        texts.select("text_id", F.explode(F.array_distinct(found)).alias("_longest"))
        .join(starting, "_longest")
        .select("text_id", "name")
        .distinct()
    )


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (text_id, name) where the text holds the name as a substring.

    Up to PATTERN_LETTERS letters of names are looked for in one pass over each text. For a larger
    catalogue, texts and names meet in joins: a text can only hold a name if it holds each run of
    five characters of it. Of these the one that fewest names share becomes the name's key; both sides are joined on it and the
    remaining pairs are tested. Shorter names are their own key and need no test; the texts
    are cut into shorter runs only if the catalogue has such names.
    """
    filled = names.select("name").filter(F.length("name") > 0).distinct()
    letters = filled.agg(F.sum(F.length("name"))).first()[0] or 0
    if letters <= PATTERN_LETTERS:
        some = [r["name"] for r in filled.collect()]
        if not some:
            return texts.select("text_id", F.lit("").alias("name")).limit(0)
        return _mentions_in_one_pass(texts, some)
    return _mentions_by_grams(texts, filled)


def _mentions_by_grams(texts: DataFrame, filled: DataFrame) -> DataFrame:
    long_names = _rarest_gram(filled.filter(F.length("name") >= GRAM))
    keys = texts.select("text_id", F.explode(_grams(F.col("text"), GRAM)).alias("_key"))
    candidates = keys.join(long_names, "_key").select("text_id", "name")
    tested = (
        candidates.join(texts.select("text_id", "text"), "text_id")
        .filter(F.contains("text", "name"))
        .select("text_id", "name")
    )
    short_names = filled.filter(F.length("name") < GRAM)
    if short_names.isEmpty():
        return tested
    short_grams = F.concat(*[_grams(F.col("text"), k) for k in range(1, GRAM)])
    short_keys = texts.select("text_id", F.explode(short_grams).alias("name"))
    return tested.unionByName(short_keys.join(short_names, "name").select("text_id", "name"))


def catalogue(items: DataFrame, branches: DataFrame) -> DataFrame:
    """Both kinds of names as rows (kind, name), written once as every step reads them."""
    both = items.select(F.lit(ITEM).alias("kind"), "name").unionByName(
        branches.select(F.lit(BRANCH).alias("kind"), "name")
    )
    return materialize(both.distinct(), "names")


def text_mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Per text: does it hold any item name, any branch name; ``names`` from ``catalogue``."""
    per_text = (
        mentions(texts, names)
        .join(names, "name")
        .groupBy("text_id")
        .agg(
            F.max(F.col("kind") == ITEM).alias("has_item"),
            F.max(F.col("kind") == BRANCH).alias("has_branch"),
        )
    )
    return texts.select("text_id").join(per_text, "text_id", "left").select(
        "text_id",
        F.coalesce("has_item", F.lit(False)).alias("has_item"),
        F.coalesce("has_branch", F.lit(False)).alias("has_branch"),
    )


# --- fuzzy linking -----------------------------------------------------------------------


def _with_deletions(token: Column) -> Column:
    """The token and every form of it that lacks one character."""
    lacking = F.transform(
        F.sequence(F.lit(1), F.length(token)),
        lambda i: F.concat(
            F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))
        ),
    )
    return F.array_distinct(F.concat(F.array(token), lacking))


def _hinted(small: bool) -> str:
    """The join hint for a table whose rows are few or not; without it Spark goes by the files below."""
    return "broadcast" if small else "merge"


def _few(names: DataFrame) -> bool:
    squares = F.sum(F.length("name").cast("bigint") * F.length("name"))
    return (names.agg(squares).first()[0] or 0) <= LOOKUP_LETTERS


def similar_tokens(left: DataFrame, right: DataFrame, few: bool = False) -> DataFrame:
    """Pairs (token, name_token) that are equal, or one edit apart and similar enough.

    Two words one edit apart share a form with one character deleted, so the join on those
    forms finds every pair; only distinct words are joined, not their uses. If there are few words on the
    right, those are broadcast.
    """
    words = left.select(F.col("token")).distinct()
    others = right.select(F.col("token").alias("name_token")).distinct()
    equal = words.join(others.hint(_hinted(few)), words["token"] == others["name_token"])
    left_forms = words.select("token", F.explode(_with_deletions(F.col("token"))).alias("_form"))
    right_forms = others.select(
        "name_token", F.explode(_with_deletions(F.col("name_token"))).alias("_form")
    )
    longer = F.greatest(F.length("token"), F.length("name_token"))
    near = (
        left_forms.join(right_forms.hint(_hinted(few)), "_form")
        .filter(F.col("token") != F.col("name_token"))
        .filter(100 * (longer - 1) >= SIMILAR_WORDS * longer)
        .filter(F.levenshtein("token", "name_token", 1) >= 0)
        .select("token", "name_token")
        .distinct()
    )
    return equal.unionByName(near)


def _tokenized_names(names: DataFrame) -> DataFrame:
    distinct = F.array_distinct(tx.tokens(F.col("name")))
    return names.select("kind", "name", distinct.alias("tokens")).filter(F.size("tokens") > 0)


def _index(tokenized: DataFrame, few: bool) -> DataFrame:
    """Rows (name_token, name, ...) for as few, and as rare, tokens as the cutoff allows.

    A name of n tokens needs m = ceil(cutoff * n / 100) matches to reach its cutoff, so at
    least one of any n - m + 1 of its tokens must match. The rarest ones are taken, which
    keeps a word shared by many names from pairing every text with all of them.
    """
    uses = tokenized.withColumn("name_token", F.explode("tokens"))
    counts = uses.groupBy("kind", "name_token").agg(F.count(F.lit(1)).alias("_uses"))
    rarest = (
        uses.join(counts.hint(_hinted(few)), ["kind", "name_token"])
        .groupBy("kind", "name")
        .agg(F.array_sort(F.collect_list(F.struct("_uses", "name_token"))).alias("_rarest"))
    )
    n = F.size("tokens")
    keep = n - F.ceil(n * F.col("cutoff") / 100).cast("int") + 1
    return (
        tokenized.join(rarest.hint(_hinted(few)), ["kind", "name"])
        .withColumn("_rare", F.explode(F.slice("_rarest", F.lit(1), keep)))
        .select(F.col("_rare.name_token").alias("name_token"), "kind", "name", "tokens", "cutoff")
    )


def _linked(hits: DataFrame, tokenized: DataFrame, few: bool) -> DataFrame:
    """Pairs (text_id, kind, name) where the name reaches its cutoff; a pair may repeat."""
    score = 100 * F.size(F.array_intersect("tokens", "hits")) / F.size("tokens")
    return (
        hits.select("text_id", "hits", F.explode("hits").alias("name_token"))
        .join(_index(tokenized, few).hint(_hinted(few)), "name_token")
        .filter(score >= F.col("cutoff"))
        .select("text_id", "kind", "name")
    )


def _listed(kind: str) -> Column:
    """The names of one kind, sorted and separated by commas."""
    names = F.collect_set(F.when(F.col("kind") == kind, F.col("name")))
    return F.concat_ws(", ", F.array_sort(names))


def _hits(texts: DataFrame, tokenized: DataFrame, few: bool) -> DataFrame:
    """Per text the name tokens it matches; bounded by the words of the text."""
    used = texts.select(
        "text_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token")
    )
    spelt = tokenized.select(F.explode("tokens").alias("token"))
    similar = materialize(similar_tokens(used, spelt, few), "similar-words")
    return (
        used.join(similar.hint(_hinted(similar.count() <= LOOKUP_PAIRS)), "token")
        .groupBy("text_id")
        .agg(F.collect_set("name_token").alias("hits"))
    )


def fuzzy_link(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Found items and branches of each text, and suggested items where nothing was found.

    The score of a name is the percentage of its tokens that match a token of the text. As
    branches are found at the suggestion threshold already, there are no suggested branches.
    ``names`` comes from ``catalogue``.
    """
    tokenized, few = _tokenized_names(names), _few(names)
    hits = materialize(_hits(texts, tokenized, few), "hits")
    cutoff = F.when(F.col("kind") == ITEM, FOUND_ITEM).otherwise(FOUND_BRANCH)
    found = (
        _linked(hits, tokenized.withColumn("cutoff", cutoff), few)
        .groupBy("text_id")
        .agg(_listed(ITEM).alias("found_items"), _listed(BRANCH).alias("found_branches"))
    )
    items = tokenized.filter(F.col("kind") == ITEM).withColumn("cutoff", F.lit(SUGGESTED))
    open_hits = hits.join(found.select("text_id"), "text_id", "left_anti")
    suggested = (
        _linked(open_hits, items, few).groupBy("text_id").agg(_listed(ITEM).alias("suggested_items"))
    )
    return (
        texts.select("text_id")
        .join(found, "text_id", "left")
        .join(suggested, "text_id", "left")
        .na.fill("", ["found_items", "found_branches", "suggested_items"])
    )


def answer_context(linked: DataFrame) -> DataFrame:
    """The sentence that goes with a linked question."""
    items, branches = F.col("found_items"), F.col("found_branches")
    found = F.concat(
        F.when(items != "", F.format_string(ITEMS_FOUND, items)).otherwise(""),
        F.when(branches != "", F.format_string(BRANCHES_FOUND, branches)).otherwise(""),
    )
    meant = F.format_string(ITEMS_MEANT, F.col("suggested_items"))
    return linked.withColumn(
        "context",
        F.when(found != "", found)
        .when(F.col("suggested_items") != "", meant)
        .otherwise(NOTHING_FOUND),
    )


# --- screens -----------------------------------------------------------------------------


def keyword_screen(texts: DataFrame) -> DataFrame:
    return texts.select(
        "text_id", (~tx.has_restricted_keyword(F.col("text"))).alias("is_valid")
    )


def score_screen(scores: DataFrame, limit: float = 0.6) -> DataFrame:
    return scores.select(
        "text_id", tx.has_high_score(F.col("scores"), limit).alias("is_abusive")
    )


def route(texts: DataFrame, scores: DataFrame, names: DataFrame) -> DataFrame:
    """What happens to each question: refused, passed on as it is, or linked to names.

    A text without scores counts as harmless. ``answer`` is the refusal or the context; it
    is null for a question that names nothing and is passed on unchanged. ``names`` comes
    from ``catalogue``.
    """
    screened = materialize(
        texts.withColumn("is_valid", ~tx.has_restricted_keyword(F.col("text")))
        .join(score_screen(scores), "text_id", "left")
        .withColumn("is_abusive", F.coalesce("is_abusive", F.lit(False))),
        "questions",
    )
    kept = screened.filter(F.col("is_valid") & ~F.col("is_abusive")).select("text_id", "text")
    named = mentions(kept, names).select("text_id").distinct()
    to_link = materialize(kept.join(named, "text_id", "left_semi"), "named-questions")
    contexts = answer_context(fuzzy_link(to_link, names)).select("text_id", "context")
    return screened.join(contexts, "text_id", "left").select(
        "text_id",
        F.when(~F.col("is_valid"), "unsafe")
        .when(F.col("is_abusive"), "abusive")
        .when(F.col("context").isNotNull(), "linked")
        .otherwise("passed on")
        .alias("route"),
        F.when(~F.col("is_valid"), UNSAFE)
        .when(F.col("is_abusive"), ABUSIVE)
        .otherwise(F.col("context"))
        .alias("answer"),
    )
