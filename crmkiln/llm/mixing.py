"""Operator 6: a mix of sources at target weights, out of fixed-length blocks of words.

Method. The words of each source, documents in a fixed pseudorandom order, are one stream cut into blocks of
``block_words``. Targets are the water level at which sources share ``rate`` times all words by their
weights, none above ``cap`` times its own size. A source's target is a whole number of slots; each slot draws
its output shard (so a source's counts per shard are multinomial, given its total) and takes a block by
a pseudorandom permutation of the source's block numbers, one permutation for each time round. Blocks
and the pieces of documents inside them meet in a join on (source, block).

Outputs. ``packed`` has the slots of every shard with their block's pieces of text; ``taken`` the words that the
mix takes of each row; ``mixed_documents`` rows of documents, where neighbouring blocks that the mix takes
equally often are one piece again, so that a document taken as a whole is whole.

The permutation is a swap-or-not network: each round pairs x with (key - x) mod n and a hash bit of the
pair decides which of the two goes on. It permutes any range. Everything is DataFrame expressions. A hot source has
as many keys as blocks, so no key is hot. The place of a row in its source's stream is summed in three steps:
inside runs of about ``RUN_ROWS`` rows that a hash of the row deals out (whatever the ids are: dense, sparse or
random), over the runs of a group of ``RUN_GROUP``, and over the groups of a source.

Defined cases: null text has size 0 and nothing is taken of it; null source is a source of its own, the
last one; rows that repeat a ``doc_id`` are documents of their own; where all sizes are 0, so are the
targets; an empty table gives no rows; other columns are ignored. Rows alike in id and text share a run, whose
sort can spill. A source's taken words differ from its target by less than a block and its short last block,
each time round, however long its documents are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crmkiln.llm import common

WEIGHTS = (3, 1, 2)
RATE = 1.5
CAP = 2
BLOCK_WORDS = 64
#: Longer in documents than in packed slots: fewer documents are cut.
STAGE_BLOCK_WORDS = 128
SHARD_SLOTS = 4096
ROUNDS = 10
RUN_ROWS = 32
RUN_GROUP = 64
CHUNK = 1 << 12

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"^[\x20\x09-\x0D]+"
_SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, keep=()) -> DataFrame:
    """``doc_id``, ``source``, the number of words and a hash of the text of each row."""
    return docs.select(
        *keep,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("mark"),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, rate=RATE, cap=CAP) -> DataFrame:
    """One row per source: rank, number of rows, size, target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("full_at", "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = F.array(*[F.lit(float(weight)) for weight in weights])
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
        .withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(shares, (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * float(cap))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * float(rate))
        .withColumn("spent", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("spent")) / F.sum("weight").over(onward))
        # The level of the first source that does not fill up is the largest one not above its own mark.
        .withColumn("level", F.max(F.expr("CASE WHEN level <= full_at THEN level END")).over(everything))
        .select(
            "source", "rank", "n_rows", "source_size",
            F.expr("CASE WHEN level IS NULL THEN most ELSE least(most, level * weight) END").alias("target"),
        )
    )


def permuted(place: str, domain: str, key: str, seed: int) -> str:
    """Image of ``place`` (0 to ``domain`` - 1) under a permutation chosen by ``key``."""
    keys = f"{seed}, turn, {key}"
    other = f"pmod(pmod(xxhash64({keys}), {domain}) - x, {domain})"
    chosen = f"if(xxhash64('swap', {keys}, greatest(x, other)) & 1 = 1, other, x)"
    one_round = f"element_at(transform(array({other}), other -> {chosen}), 1)"
    return f"aggregate(sequence(1, {ROUNDS}), {place}, (x, turn) -> {one_round})"


def slots(sources: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """Every slot of the mix: its number in its source, output ``shard``, source ``rank``, ``block``, and the time
    ``round``."""
    counted = sources.where("source_size > 0").select(
        "rank",
        F.expr(f"CAST(ceil(source_size / {block_words}) AS BIGINT)").alias("blocks"),
        F.expr(
            f"CAST(round(target / source_size * ceil(source_size / {block_words})) AS BIGINT)"
        ).alias("wanted"),
    ).withColumn("shards", F.expr(f"1 + sum(wanted) OVER () DIV {SHARD_SLOTS}"))
    chunks = counted.where("wanted > 0").withColumn(
        "chunk", F.explode(F.expr(f"sequence(0L, (wanted - 1) DIV {CHUNK})")))
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = chunks.repartition(tasks, "rank", "chunk").withColumn(
        "slot", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(wanted, (chunk + 1) * {CHUNK}) - 1)")))
    drawn = places.select(
        "rank", "blocks", "slot",
        F.pmod(F.xxhash64(F.lit("shard"), F.lit(seed), "rank", "slot"), F.col("shards")).alias("shard"),
        F.expr("slot DIV blocks").alias("round"),
        F.expr("slot % blocks").alias("block"),
    )
    return drawn.select(
        "shard", "rank", "slot", F.expr(permuted("block", "blocks", "rank, round", seed)).alias("block"), "round")


def placed(sizes: DataFrame, sources: DataFrame, keep=()) -> DataFrame:
    """Rows with their source's figures and the place of their first word in the source's stream."""
    rows = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn(
        "run", F.pmod(F.xxhash64("doc_id", "mark"), F.expr(f"1 + n_rows DIV {RUN_ROWS}")))
    runs = rows.groupBy("rank", "run").agg(F.sum("size").alias("words")).withColumn(
        "group", F.expr(f"run DIV {RUN_GROUP}"))
    groups = runs.groupBy("rank", "group").agg(F.sum("words").alias("words"))
    by_group = Window.partitionBy("rank").orderBy("group")
    by_run = Window.partitionBy("rank", "group").orderBy("run")
    starts = runs.withColumn("inner", F.sum("words").over(by_run) - F.col("words")).join(
        groups.select("rank", "group", (F.sum("words").over(by_group) - F.col("words")).alias("outer")),
        ["rank", "group"]).select("rank", "run", F.expr("inner + outer").alias("run_start"))
    inside = Window.partitionBy("rank", "run").orderBy("doc_id", "mark", "size", *keep).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return rows.join(starts, ["rank", "run"]).withColumn(
        "start", F.col("run_start") + F.sum("size").over(inside) - F.col("size")).drop(
        "run", "run_start", "mark", "n_rows")


def blocks_of(rows: DataFrame, block_words: int) -> DataFrame:
    """Placed rows once for each block they have words in: ``first`` (their first block) and ``block``."""
    return rows.where("size > 0").withColumn("first", F.expr(f"start DIV {block_words}")).withColumn(
        "block", F.explode(F.expr(f"sequence(first, (start + size - 1) DIV {block_words})")))


def used(rows: DataFrame, sources: DataFrame, block_words: int, seed: int) -> DataFrame:
    """``blocks_of`` the rows, and how often the mix takes each block."""
    uses = slots(sources, block_words, seed).groupBy("rank", "block").agg(F.count("*").alias("uses"))
    # Spark's estimate does not see that slots multiply; a broadcast of them would have no bound.
    return blocks_of(rows, block_words).join(uses.hint("merge"), ["rank", "block"], "left").withColumn(
        "uses", F.coalesce("uses", F.lit(0)))


def stream(docs: DataFrame, keep=(), **shares) -> tuple[DataFrame, DataFrame]:
    """The placed rows and the targets of their sources."""
    sizes = common.saved(sized(docs, keep), "sizes")
    sources = common.saved(targets(sizes, **shares), "targets")
    return placed(sizes, sources, keep), sources


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0, **shares) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``; ``taken``: words of the row in the mix."""
    rows, sources = stream(docs, **shares)
    keys = ["rank", "start", "doc_id", "source", "size", "source_size", "target"]
    overlap = f"least(start + size, (block + 1) * {block_words}) - greatest(start, block * {block_words})"
    words = used(rows, sources, block_words, seed).groupBy(*keys).agg(
        F.sum(F.expr(f"uses * ({overlap})")).alias("taken"))
    empty = rows.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return words.unionByName(empty).drop("rank", "start")


def _cut(pieces: str) -> str:
    """The pieces (``begin`` and ``n`` in words) of the column ``text``, white space between words kept. The words of
    a text are found once for all of its pieces."""
    words = f"regexp_extract_all(text, r'{_SPACED_WORD}', 0)"
    joined = "array_join(slice(words, CAST(piece.begin + 1 AS INT), CAST(piece.n AS INT)), '')"
    return (f"flatten(transform(array({words}), words -> transform({pieces}, piece -> "
            f"regexp_replace({joined}, r'{_SPACE}', ''))))")


def packed(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0, **shares) -> DataFrame:
    """The mix itself, one row for each slot: output ``shard``, ``source``, ``slot``, ``block``, ``n_words``, and
    ``pieces``, the (``doc_id``, ``text``) that the block holds, in order."""
    keyed = common.keyed(docs, ("source",))
    rows, sources = stream(keyed, (common.ROW,), **shares)
    begin = f"greatest(start, block * {block_words})"
    spans = blocks_of(rows, block_words).select(
        common.ROW, "rank", "source", F.struct(
            "block", F.expr(f"{begin} AS place"), F.expr(f"{begin} - start AS begin"),
            F.expr(f"least(start + size, (block + 1) * {block_words}) - {begin} AS n")).alias("span"))
    spans = spans.groupBy(common.ROW, "rank", "source").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    pieces = keyed.select(common.ROW, "doc_id", "text").join(spans, common.ROW).select(
        "rank", "source", "doc_id", F.expr(
            f"explode(zip_with(spans, {_cut('spans')}, (span, cut) -> struct(span, cut AS text)))").alias("piece"))
    piece = F.struct("piece.span.place", "doc_id", "piece.text")
    blocks = pieces.groupBy("rank", "source", F.col("piece.span.block").alias("block")).agg(
        F.sum("piece.span.n").alias("n_words"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    return slots(sources, block_words, seed).hint("merge").join(blocks, ["rank", "block"]).select(
        "shard", "source", "slot", "block", "n_words",
        F.expr("transform(pieces, x -> struct(x.doc_id, x.text))").alias("pieces"))


def mixed_documents(docs: DataFrame, columns, block_words: int = STAGE_BLOCK_WORDS, seed: int = 0, **shares) -> DataFrame:
    """Rows of documents in the mix's proportions. A row comes as often as the mix takes it: whole where all of its
    blocks are taken, else the pieces whose blocks are; ``n_chars`` is then that of the piece."""
    rows = common.keyed(docs, columns)
    where, sources = stream(rows, (common.ROW,), **shares)
    # Every block of a row is among its uses, in order, also those that are not taken.
    uses = used(where, sources, block_words, seed).groupBy(common.ROW, "start", "size", "first").agg(
        F.expr("transform(sort_array(collect_list(struct(block, uses))), x -> x.uses)").alias("uses"))
    turn = "filter(sequence(0, size(uses) - 1), i -> uses[i] >= level AND coalesce(get(uses, i {}) < level, true))"
    span = (f"zip_with({turn.format('- 1')}, {turn.format('+ 1')}, (head, last) -> struct("
            f"greatest(0L, (first + head) * {block_words} - start) AS begin, "
            f"least(size, (first + last + 1) * {block_words} - start) AS until))")
    levels = "sequence(1, CAST(array_max(uses) AS INT))"
    pieces = uses.where("array_max(uses) > 0").select(common.ROW, "size", F.expr(
        f"transform(flatten(transform({levels}, level -> {span})), x -> "
        "struct(x.begin AS begin, x.until - x.begin AS n))").alias("pieces"))
    whole = F.expr("n_whole > 0")
    found = rows.join(pieces, common.ROW).withColumn(
        "n_whole", F.expr("size(filter(pieces, x -> x.n = size))")).withColumn(
        "parts", F.expr("filter(pieces, x -> x.n < size)"))
    wholes = found.where(whole).withColumn("__copy", F.explode(F.expr("sequence(1, n_whole)"))).select(*columns)
    cut = found.where("size(parts) > 0").withColumn("__piece", F.explode(F.expr(_cut("parts"))))
    changed = {"text": F.col("__piece"), "n_chars": F.length("__piece").cast(
        rows.schema["n_chars"].dataType) if "n_chars" in rows.columns else None}
    return wholes.unionByName(cut.select(*[
        changed[name].alias(name) if name in changed else F.col(name) for name in columns]))
