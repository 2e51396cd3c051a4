"""Operator 13: groups of spelling variants, by asymmetric q-chunks.

Method. Words are counted over all texts. Two words s and t, s the shorter or (at equal length) the first in
code-point order, differ by one edit. s contributes two disjoint chunks, its first and its last half
(``q = length / 2`` code points, rounded down), t all its positional grams of that size. One edit leaves one of the chunks whole and
moves it by one place at most, so s and t share a chunk and a gram whose places differ by no more than one. They are joined by
(length of s, chunk, which of the two) on grams within that shift; only grams that some chunk place can reach are
sent. Candidates are then verified by their edit distance.

A key with many words (a common beginning, or ending) is split: where chunk and gram are the same and one stands
at the same end of both words, what is left of s and t also differs by one edit, and is cut into chunks and grams in turn. This is
repeated while a key would give more than ``CROWDED`` candidates, or until no more than one code point of s is left. Keys then hold
words that agree in all but one or two places, so candidates stay in proportion to pairs that are near.

From near words follow a word's form (the most frequent one that is ``FACTOR`` times as frequent), and its root by
doubling: each step replaces a form by the form's form.

Defined cases: null texts have no words; empty and wordless texts neither; a null ``doc_id`` counts as an empty
text in the crc32; documents that repeat an id, and repeated rows, count each; equal counts are settled by
code-point order; an empty table gives no rows; other columns are ignored. A text is split by Spark's own expressions as one value; words of any length are compared whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmkiln.llm.common import saved

RUN = r"[A-Za-z\\u00C0-\\u00FF]+"
#: A run loses a code point where this divides its crc32.
LOSING = 199
MIN_LENGTH, MIN_COUNT = 6, 5
#: A form is so many times as frequent as its word.
FACTOR = 5
#: Candidates of a key above which it is split by what else its words agree in.
CROWDED = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word`` and ``n``, its occurrences in all texts."""
    lowered = f"translate(text, '{_UPPER}', '{_LOWER}')"
    runs = docs.selectExpr("coalesce(CAST(CAST(doc_id AS LONG) AS STRING), '') AS doc",
                           f"explode(regexp_extract_all({lowered}, '{RUN}', 0)) AS run")
    # A run of one code point more may become a word.
    hashed = runs.where(f"length(run) >= {MIN_LENGTH}").selectExpr(
        "run", "crc32(CAST(concat(doc, ':', run) AS BINARY)) AS h", "length(run) AS size")
    place = "CAST(h % size AS INT)"
    words = hashed.selectExpr(
        f"CASE WHEN h % {LOSING} = 0 THEN concat(left(run, {place}), substr(run, {place} + 2)) ELSE run END AS word")
    return words.groupBy("word").agg(F.count("*").alias("n")).where(
        f"length(word) >= {MIN_LENGTH} AND n >= {MIN_COUNT}")


def _sides(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two roles of every word before any split: ``key`` is what the roles have agreed in so far."""
    chunked = words.selectExpr("word AS s", "n AS s_n", "word AS s_rest", "xxhash64(length(word)) AS key")
    # As the longer word, or the later one, it meets words of its length and of one less.
    grammed = words.selectExpr(
        "word AS t", "n AS t_n", "word AS t_rest",
        "explode(array(length(word), length(word) - 1)) AS size").selectExpr(
        "t", "t_n", "t_rest", "size AS s_size", "xxhash64(size) AS key")
    return chunked, grammed


def _chunks(side: DataFrame) -> DataFrame:
    """Two rows per row: chunk 0, the beginning, and chunk 1, the end, with what the chunk leaves."""
    halves = side.withColumn("size", F.expr("length(s_rest)")).withColumn("q", F.expr("size div 2"))
    return halves.selectExpr("s", "s_n", "key", "size", "q", "explode(array(0, 1)) AS slot", "s_rest").selectExpr(
        "s", "s_n",
        "xxhash64(key, slot, if(slot = 0, left(s_rest, q), right(s_rest, q))) AS key",
        "if(slot = 0, 0, size - q) AS s_place",
        "if(slot = 0, substr(s_rest, q + 1), left(s_rest, size - q)) AS s_rest")


def _grams(side: DataFrame) -> DataFrame:
    """All positional grams of the chunks' size that lie within one place of a chunk's.

    ``aligned``: the gram stands at the end of the word that its chunk stands at, so that what is left
    of the two words can be compared further.
    """
    sized = side.withColumn("size", F.expr("length(t_rest)")).withColumn("q", F.expr("s_size div 2"))
    places = sized.selectExpr(
        "t", "t_n", "t_rest", "key", "s_size", "size", "q", "explode(array(0, 1)) AS slot").selectExpr(
        "*", "if(slot = 0, 0, s_size - q) AS chunk_place").selectExpr(
        "*", "explode(filter(sequence(greatest(chunk_place - 1, 0), chunk_place + 1), p -> p <= size - q)) AS t_place")
    return places.selectExpr(
        "t", "t_n", "xxhash64(key, slot, substr(t_rest, t_place + 1, q)) AS key", "t_place",
        "if(slot = 0, t_place = 0, t_place = size - q) AS aligned",
        "if(slot = 0, substr(t_rest, q + 1), left(t_rest, size - q)) AS t_rest", "s_size - q AS s_size")


def _verified(chunks: DataFrame, grams: DataFrame) -> DataFrame:
    """Pairs at one edit among the rows that share a key."""
    pairs = chunks.join(grams, "key").where("abs(s_place - t_place) <= 1")
    earlier = "length(s) < length(t) OR s < t"
    return pairs.where(f"({earlier}) AND s <> t AND levenshtein(s, t, 1) = 1").select("s", "s_n", "t", "t_n")


def near_pairs(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``s``, ``s_n``, ``t``, ``t_n``: all pairs of ``word`` (with its ``n``) at one edit, each once, in one direction."""
    found = []
    chunked, grammed = _sides(words)
    while True:
        chunks, grams = saved(_chunks(chunked), "chunks"), saved(_grams(grammed), "grams")
        sizes = chunks.groupBy("key").agg(F.count("*").alias("c")).join(
            grams.groupBy("key").agg(F.count("*").alias("g")), "key")
        # Nothing is left to split where a single code point of s remains.
        open_keys = chunks.where("length(s_rest) > 1").select("key").distinct()
        full = saved(sizes.where(F.expr(f"c * g > {crowded}")).join(open_keys, "key", "left_semi").select("key"),
                     "crowded")
        if full.isEmpty():
            found.append(_verified(chunks, grams))
            break
        found.append(_verified(chunks.join(full, "key", "left_anti"), grams.join(full, "key", "left_anti")))
        # Of a full key go on those rows whose chunk or gram stands at its end of the word, which one edit leaves so.
        chunked = chunks.join(full, "key", "left_semi").select("s", "s_n", "s_rest", "key")
        grammed = grams.join(full, "key", "left_semi").where("aligned").select(
            "t", "t_n", "t_rest", "s_size", "key")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``word``, ``n_near``, ``form`` (null where no near word is frequent enough), ``form_n`` of words with near words."""
    both = pairs.select(F.col("s").alias("word"), F.col("s_n").alias("n"), F.col("t").alias("near"), F.col("t_n").alias("near_n"))
    both = both.unionAll(pairs.select("t", "t_n", "s", "s_n"))
    # The smallest of (-n, word) is the most frequent, and of these the first in code-point order.
    best = both.groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    frequent = f"-best.col1 >= {FACTOR} * n"
    return best.selectExpr("word", "n_near", f"if({frequent}, best.near, NULL) AS form",
                           f"if({frequent}, -best.col1, NULL) AS form_n")


def roots(links: DataFrame) -> DataFrame:
    """``word`` and ``root``, where its chain of forms ends, of every row (``word``, ``form``).

    A form is FACTOR times as frequent as its word, so chains have no circles and few links.
    """
    reached = saved(links.selectExpr("word", "form AS root"), "roots")
    while True:
        ahead = reached.selectExpr("word AS root", "root AS further")
        moved = saved(reached.join(ahead, "root", "left").selectExpr(
            "word", "coalesce(further, root) AS root", "further IS NOT NULL AS moved"), "roots")
        reached = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return reached


def variants(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word."""
    words = saved(vocabulary(docs), "words")
    near = saved(forms(words, near_pairs(words, crowded)), "forms")
    ends = roots(near.where("form IS NOT NULL").select("word", "form"))
    return words.join(near, "word", "left").join(ends, "word", "left").selectExpr(
        "word", "form", "coalesce(root, word) AS root", "n", "coalesce(n_near, 0L) AS n_near", "form_n")
