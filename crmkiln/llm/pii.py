"""Operator 4: personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Method. Fixed expressions find the seed entities of four base kinds and of one more, ``secret``: a run of 32 or more
letters and digits that looks drawn at random (both present, many different characters), as keys and access tokens
do. Seeds, and all other tokens with a digit or ``@`` (candidates), are instances; the one and the two words before
them are lexical patterns. Spark counts the pattern-instance graph and scores it by turns: a pattern's confidence in
a kind is the smoothed share of its occurrences whose instances are believed to be of the kind; a candidate's belief
is the noisy-or of its patterns' confidences. Patterns with at least ``MIN_SEEDS`` different seeds and a confidence of
``CONFIDENT`` or more are promoted, and their candidates become spans of the pattern's kind where their value has a
shape that the kind allows (``_SHAPES``): a year after "tel" is no telephone number.

Words before an instance are those of the whole text, however long and whatever they are: another instance is a word
like any other. In the token of the seed itself, what stands before it is a word too, back to the seed of its kind
before, if it has a letter or a digit (a quotation mark is none).

The text is read once: spans and contexts are saved per row, and all that follows works on them. Counts cover all
rows and combine per task. The promoted patterns are a written table, as many as there are, which the candidates
are joined with; nothing passes the driver.

Start and end are code points. Expressions that scan long runs begin only where a run does, places are running sums
over chunks, and overlaps are found by binary search, so that no text takes quadratic time.

Defined cases: null text is empty; spans may touch but seeds of one kind never overlap; a candidate that overlaps a
seed is no instance of its own; a pattern promoted for several kinds is of the one it has the most confidence in, then
of the first; where patterns of one and of two words are promoted, the longer decides; repeated rows are judged each and
count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crmkiln.llm.common import ROW, saved

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
ROUNDS = 3
MIN_SEEDS = 5
CONFIDENT = 0.6
#: Matches whose places are summed up at a time.
CHUNK = 128

_LOCAL = r"[A-Za-z0-9._%+-]"
#: (gate, expression, condition on the match ``y.m``) per kind. A local part and a run of digits match from
#: their first character or not at all, so only the first, or the end of the last match, is tried. Repeated
#: groups are possessive: other ones of unfixed width recurse, and long runs would overflow the stack.
_SEEDS = {
    "email": ("contains({t}, '@')",
              rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "true"),
    "ip": ("digits AND {t} RLIKE r'[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]'",
           r"(?:(?<![0-9])|\G)[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
           "forall(split(y.m, r'\\.'), part -> length(ltrim('0', part)) <= 3 AND "
           "(length(ltrim('0', part)) = 0 OR CAST(ltrim('0', part) AS int) <= 255))"),
    "card": ("digits AND {t} RLIKE r'[0-9](?:[\\x20-]?[0-9]){{13}}'", r"[0-9](?:[\x20-]?[0-9])++", "{luhn}"),
    "phone": ("digits AND contains({t}, '+')", r"\+[0-9][\x20().0-9-]+[0-9]",
              "length(regexp_replace(y.m, '[^0-9]', '')) BETWEEN 10 AND 15"),
    "secret": ("digits AND {t} RLIKE r'[A-Za-z0-9]{{32}}'", r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,}+",
               "length(y.m) <= 512 AND length(regexp_replace(y.m, '[^0-9]', '')) >= 4 "
               "AND length(regexp_replace(y.m, '[0-9]', '')) >= 4 AND size(array_distinct(split(y.m, ''))) >= 12"),
}
_DIGITS = "regexp_replace(y.m, '[^0-9]', '')"
_LUHN = f"""length({_DIGITS}) BETWEEN 14 AND 19 AND aggregate(
    sequence(1, length({_DIGITS})), 0L, (sum, k) -> sum + transform(
        array(CAST(substr(reverse({_DIGITS}), k, 1) AS int) * (2 - k % 2)), d -> d DIV 10 + d % 10)[0]) % 10 = 0"""
#: What a discovered value of each kind looks like.
_SHAPES = {
    "email": "value RLIKE '[A-Za-z0-9][^@]*@[^@]*[A-Za-z0-9]'",
    "ip": "value RLIKE '^[^A-Za-z0-9]*[0-9]{1,3}([^A-Za-z0-9]+[0-9]{1,3}){3}[^A-Za-z0-9]*$'",
    "card": "NOT value RLIKE '[A-Za-z@]' AND length(regexp_replace(value, '[^0-9]', '')) BETWEEN 12 AND 19",
    "phone": "NOT value RLIKE '[A-Za-z@]' AND length(regexp_replace(value, '[^0-9]', '')) BETWEEN 6 AND 15",
    "secret": "value RLIKE '[A-Za-z]' AND value RLIKE '[0-9].*[0-9]' AND length(value) >= 8 AND NOT contains(value, '@')",
}
_SPACE = r"\x20\x09-\x0D"
_SPANS = "array<struct<start:int,rank:int,stop:int>>"
_MATCHES = "array<struct<m:string,gap:string,p:int>>"
_SEEN = "array<struct<start:int,rank:int,stop:int,value:string,words:array<string>>>"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for the value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running_sums(lengths: str) -> str:
    """Sum of the elements before each element. An array that grows element by element is copied each time, so it
    grows within chunks, and the chunks then are put together."""
    inner = """aggregate(part, named_struct('at', s.at, 'found', CAST(array() AS array<int>)),
        (u, x) -> named_struct('at', u.at + x, 'found', concat(u.found, array(u.at))))"""
    return f"""flatten(aggregate(
        transform(sequence(0, CAST(greatest(size({lengths}) - 1, 0) div {CHUNK} AS int)),
                  k -> slice({lengths}, k * {CHUNK} + 1, {CHUNK})),
        named_struct('at', 0, 'parts', CAST(array() AS array<array<int>>)),
        (s, part) -> transform(array({inner}), r -> named_struct('at', r.at, 'parts', concat(s.parts, array(r.found))))[0],
        s -> s.parts))"""


def _matches(text: str, regex: str, condition: str) -> str:
    """The matches that meet the condition: ``m``, the text ``gap`` since the match before, and the place ``p``."""
    placed = _let("transform(z, x -> length(x.`0`) + coalesce(length(x.`1`), 0))", "n", _let(
        _running_sums("n"), "sums",
        "transform(z, (x, i) -> named_struct('m', x.`1`, 'gap', x.`0`, 'p', sums[i] + length(x.`0`)))"))
    pairs = f"arrays_zip(split({text}, r'{regex}', -1), regexp_extract_all({text}, r'{regex}', 0))"
    return f"filter({_let(pairs, 'z', placed)}, y -> y.m IS NOT NULL AND ({condition}))"


def _last(array: str, bound: str) -> str:
    """Place of the last element whose ``p`` is at most the bound, from 0; -1 where there is none."""
    middle = "CAST((b.lo + b.hi) div 2 AS int)"
    return f"""aggregate(sequence(0, CAST(ceil(log2(size({array}) + 1)) AS int)),
        named_struct('lo', 0, 'hi', size({array})),
        (b, k) -> CASE WHEN b.lo >= b.hi THEN b
            WHEN {array}[{middle}].p <= {bound} THEN named_struct('lo', {middle} + 1, 'hi', b.hi)
            ELSE named_struct('lo', b.lo, 'hi', {middle}) END,
        b -> b.lo - 1)"""


def _two(first: str, second: str) -> str:
    """The last two words before an instance, fewer where there are fewer, as patterns have them."""
    return f"""transform(filter(array({first}, {second}), w -> w IS NOT NULL),
        w -> regexp_replace(lower(w), '[0-9]', '0'))"""


def _seen(kind: str) -> str:
    """The matches of a kind as instances with the words before them."""
    own = rf"element_at(split(y.gap, r'[{_SPACE}]', -1), -1)"
    words = _let(_last("tokens", "y.p"), "at", _let(own, "own", rf"""CASE WHEN own RLIKE r'[\p{{L}}\p{{N}}]'
        THEN {_two('get(tokens, at - 1).m', 'own')}
        ELSE {_two('get(tokens, at - 2).m', 'get(tokens, at - 1).m')} END"""))
    return f"""transform(__{kind}, y -> named_struct('start', y.p, 'rank', {KINDS.index(kind)},
        'stop', y.p + length(y.m), 'value', y.m, 'words', {words}))"""


def _free(kind: str) -> str:
    """Whether no match of the kind overlaps candidate ``c``: the last one that starts before its end ends
    before its start. Matches of a kind are in order and do not overlap."""
    last = _last(f"__{kind}", "c.stop - 1")
    return _let(f"get(__{kind}, {last})", "o", "coalesce(o.p + length(o.m) <= c.start, true)")


def analysed(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """Per row: ``seeds`` in order, ``seen``: the same with values and words before, and ``candidates``."""
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text")).withColumn(
        "digits", F.col("__text").rlike("[0-9]"))
    for kind in KINDS:
        gate, regex, condition = _SEEDS[kind]
        found = _matches("__text", regex, condition.format(luhn=_LUHN) if kind == "card" else condition)
        rows = rows.withColumn(f"__{kind}", F.expr(
            f"CASE WHEN {gate.format(t='__text')} THEN {found} ELSE CAST(array() AS {_MATCHES}) END"))
    rows = rows.withColumn("tokens", F.expr(
        f"CASE WHEN digits OR contains(__text, '@') THEN {_matches('__text', rf'[^{_SPACE}]++', 'true')} "
        f"ELSE CAST(array() AS {_MATCHES}) END"))
    candidates = f"""filter(transform(tokens, (t, i) -> CASE WHEN t.m RLIKE '[0-9@]' THEN named_struct(
        'start', t.p, 'stop', t.p + length(t.m), 'value', t.m,
        'words', {_two('get(tokens, i - 2).m', 'get(tokens, i - 1).m')}) END),
        c -> c IS NOT NULL AND {' AND '.join(_free(kind) for kind in KINDS)})"""
    seen = ", ".join(f"CASE WHEN size(__{kind}) > 0 THEN {_seen(kind)} ELSE CAST(array() AS {_SEEN}) END"
                     for kind in KINDS)
    return rows.select(
        *keep, F.expr(f"array_sort(concat({seen}))").alias("seen"), F.expr(candidates).alias("candidates"),
    ).withColumn("seeds", F.expr(
        f"CAST(transform(seen, s -> named_struct('start', s.start, 'rank', s.rank, 'stop', s.stop)) AS {_SPANS})"))


def _patterns(words: str) -> str:
    """The one word and the two words before; none where nothing precedes."""
    return f"filter(array(try_element_at({words}, -1), IF(size({words}) > 1, array_join({words}, ' '), NULL)), x -> x IS NOT NULL)"


def graph(rows: DataFrame) -> DataFrame:
    """``pattern``, ``instance``, ``rank`` of its seed kind (null for candidates), and occurrences."""
    seeds = rows.select(F.explode(F.expr(
        "transform(seen, x -> named_struct('rank', x.rank, 'value', x.value, 'words', x.words))")).alias("x"))
    candidates = rows.select(F.explode(F.expr(
        "transform(candidates, x -> named_struct('rank', CAST(NULL AS int), 'value', x.value, 'words', x.words))"
    )).alias("x"))
    return seeds.unionAll(candidates).select(
        F.col("x.rank").alias("rank"), F.xxhash64(F.lower("x.value")).alias("instance"),
        F.explode(F.expr(_patterns("x.words"))).alias("pattern"),
    ).groupBy("pattern", "instance", "rank").agg(F.count("*").alias("n"))


def promoted(edges: DataFrame) -> DataFrame:
    """``pattern`` and the rank of its kind, of each promoted pattern."""
    edges = saved(edges, "graph")
    sizes = saved(edges.groupBy("pattern").agg(
        F.sum("n").alias("total"), F.countDistinct(F.expr("CASE WHEN rank IS NOT NULL THEN instance END")).alias("seeds")
    ).where(f"seeds >= {MIN_SEEDS}"), "patterns")
    usable = saved(edges.join(sizes.select("pattern"), "pattern", "left_semi"), "usable")
    seeds = usable.where("rank IS NOT NULL").select("pattern", "instance", "rank", "n", F.lit(1.0).alias("belief"))
    others = usable.where("rank IS NULL").select("pattern", "instance", "n")
    believed, scores = seeds, None
    for turn in range(ROUNDS):
        mass = believed.groupBy("pattern", "rank").agg(F.sum(F.col("n") * F.col("belief")).alias("mass"))
        scores = saved(mass.join(sizes, "pattern").withColumn(
            "confidence", F.col("mass") / (F.col("total") + 1)), "confidence")
        if turn + 1 < ROUNDS:
            own = others.join(scores.select("pattern", "rank", "confidence"), "pattern")
            beliefs = own.groupBy("instance", "rank").agg(
                (1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("belief"))
            believed = seeds.unionByName(others.join(beliefs, "instance").select(
                "pattern", "instance", "rank", "n", "belief"))
    best = F.max(F.struct(F.col("confidence") * F.log1p("seeds"), -F.col("rank"))).alias("best")
    return saved(scores.where(f"confidence >= {CONFIDENT}").groupBy("pattern").agg(best).select(
        "pattern", (-F.col("best.col2")).alias("rank")), "promoted")


def discovered(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Row key and ``new``: the candidates of promoted patterns as spans, of every row that has some."""
    mentions = rows.select(ROW, F.explode("candidates").alias("c"))
    named = mentions.select(
        ROW, "c.start", "c.stop", "c.value", F.posexplode(F.expr(_patterns("c.words"))).alias("at", "pattern"))
    shaped = "CASE rank " + " ".join(f"WHEN {k} THEN {_SHAPES[kind]}" for k, kind in enumerate(KINDS)) + " END"
    # The longer pattern decides where both are promoted: it comes first of those with equal starts.
    spans = F.array_sort(F.collect_list(F.struct("start", (-F.col("at")).alias("at"), "rank", "stop"))).alias("spans")
    return named.join(patterns, "pattern").where(shaped).groupBy(ROW).agg(spans).select(ROW, F.expr(
        """transform(array(spans), s -> transform(
            filter(s, (x, k) -> k = 0 OR s[k - 1].start <> x.start),
            x -> named_struct('start', x.start, 'rank', x.rank, 'stop', x.stop)))[0]""").alias("new"))


def found_spans(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """The columns to keep, ``seeds``, and ``all_spans`` with what the promoted patterns discover."""
    # Written, so that row numbers stay as they are.
    rows = saved(analysed(docs, keep).withColumn(ROW, F.monotonically_increasing_id()), "analysed")
    new = discovered(rows, promoted(graph(rows)))
    return rows.select(*keep, "seeds", ROW).join(new, ROW, "left").select(
        *keep, "seeds", F.expr("CASE WHEN new IS NULL THEN seeds ELSE array_sort(concat(seeds, new)) END").alias("all_spans"))


def _text(spans: str) -> str:
    names = ", ".join(f"'{kind}'" for kind in KINDS)
    return (f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.rank + 1), ':', s.start, ':', "
            "s.stop)), ',')")


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base seeds, and all spans, of every row."""
    base = f"filter(seeds, s -> s.rank < {len(BASE_KINDS)})"
    return found_spans(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.expr(f"CAST(size(filter(seeds, s -> s.rank = {k})) AS BIGINT)").alias(f"n_{kind}")
          for k, kind in enumerate(BASE_KINDS)],
        F.expr(f"sha2({_text(base)}, 256)").alias("base_sha256"),
        F.expr(_text("all_spans")).alias("spans"),
        F.expr("CAST(size(all_spans) AS BIGINT)").alias("n_spans"))
