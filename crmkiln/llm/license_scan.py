"""Operator 2: licence scan by ordered signature rules, in DataFrame expressions only.

Method. A text is normalised to its lower-cased words. One regular expression gates texts without any
licence vocabulary; in the others, the key words present pick the rules to run. Rules are the forms below
for every licence of the table, a few hundred regular expressions over words. A form has a priority:
identifiers before grants before names before mentions. A detection inside the interval of one with the
same or a better priority is suppressed; detections in order of (start, longest, priority) need one sweep that
keeps the furthest end per priority. Everything happens within the row: no shuffle, no join.

Base phrases are counted at every place where their words stand consecutively, whatever the rules say.

Defined cases: null, empty or wordless text has no words, no labels and score 0; equal detections of one
interval go to the better priority, then to the earlier licence of the table; repeated rows are judged each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases, as words, and their labels. Fixed values.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: label: key words, of which one must occur (``rules`` adds some for spellings without); identifier as words;
#: names as an expression over words.
LICENSES = {
    "mit": ("mit expat", "mit", "(?:mit|expat)"),
    "x11": ("x11", "x11", "x11"),
    "apache-1.1": ("apache", "apache 1 1", "apache(?: software)?(?: license)? (?:version )?1 1"),
    "apache-2": ("apache", "apache 2 0", "apache(?: software)?(?: license)? (?:version )?2(?: 0)?"),
    "agpl-3": ("agpl affero", "agpl 3 0(?: only| or later)?", "(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?v?3(?: 0)?"),
    "lgpl-2.1": ("lgpl lesser library", "lgpl 2 1(?: only| or later)?", "(?:gnu )?(?:(?:lesser|library) general public license|lgpl)(?: version| v)? ?v?2(?: [01])?"),
    "lgpl-3": ("lgpl lesser", "lgpl 3 0(?: only| or later)?", "(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?v?3(?: 0)?"),
    "gpl-1": ("gpl general gplv1", "gpl 1 0(?: only| or later)?", "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?v?1(?: 0)?"),
    "gpl-2": ("gpl general gplv2", "gpl 2 0(?: only| or later)?", "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?v?2(?: 0)?"),
    "gpl-3": ("gpl general gplv3", "gpl 3 0(?: only| or later)?", "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?v?3(?: 0)?"),
    "gfdl-1": ("gfdl documentation", "gfdl 1 [123]", "(?:gnu )?(?:free documentation license|gfdl)(?: version)?(?: 1 [123])?"),
    "mpl-1.1": ("mpl mozilla", "mpl 1 [01]", "(?:mozilla public license|mpl)(?: version| v)? ?1 [01]"),
    "mpl-2": ("mpl mozilla", "mpl 2 0", "(?:mozilla public license|mpl)(?: version| v)? ?2(?: 0)?"),
    "bsd-0": ("0bsd bsd", "0bsd", "(?:0bsd|bsd zero clause|zero clause bsd)"),
    "bsd-2": ("bsd freebsd", "bsd 2 clause", "(?:(?:simplified|2 clause|two clause|freebsd) bsd|bsd 2 clause|bsd two clause)"),
    "bsd-3": ("bsd", "bsd 3 clause", "(?:(?:new|revised|modified|3 clause|three clause) bsd|bsd 3 clause|bsd three clause)"),
    "bsd-4": ("bsd", "bsd 4 clause", "(?:(?:original|4 clause|four clause) bsd|bsd 4 clause)"),
    "isc": ("isc", "isc", "isc"),
    "zlib": ("zlib", "zlib", "zlib(?: libpng)?"),
    "libpng": ("libpng png", "libpng(?: 2 0)?", "(?:libpng|png reference library)(?: version 2)?"),
    "unlicense": ("unlicense", "unlicense", "(?:the )?unlicense"),
    "wtfpl": ("wtfpl", "wtfpl", "wtfpl"),
    "beerware": ("beerware beer", "beerware", "beer ?ware"),
    "artistic-1": ("artistic", "artistic 1 0(?: perl)?", "artistic(?: license)? (?:version )?1(?: 0)?"),
    "artistic-2": ("artistic", "artistic 2 0", "artistic(?: license)? (?:version )?2(?: 0)?"),
    "epl-1": ("epl eclipse", "epl 1 0", "(?:eclipse public license|epl)(?: version| v)? ?1(?: 0)?"),
    "epl-2": ("epl eclipse", "epl 2 0", "(?:eclipse public license|epl)(?: version| v)? ?2(?: 0)?"),
    "cpl-1": ("cpl common", "cpl 1 0", "(?:common public license|cpl)(?: version| v)? ?1(?: 0)?"),
    "ipl-1": ("ibm", "ipl 1 0", "ibm public license(?: version)?(?: 1 0)?"),
    "cddl-1": ("cddl distribution", "cddl 1 [01]", "(?:common development and distribution license|cddl)(?: version)?(?: 1 [01])?"),
    "eupl-1": ("eupl union", "eupl 1 [012]", "(?:european union public licen[cs]e|eupl)(?: version| v)?(?: 1 [012])?"),
    "cecill-2": ("cecill", "cecill 2 [01]", "cecill(?: [bc])?(?: version 2 [01])?"),
    "ms-pl": ("microsoft ms", "ms pl", "(?:microsoft public license|ms pl)"),
    "ms-rl": ("microsoft ms", "ms rl", "(?:microsoft reciprocal license|ms rl)"),
    "osl-3": ("osl open", "osl 3 0", "(?:open software license|osl)(?: version| v)? ?3(?: 0)?"),
    "afl-3": ("afl academic", "afl 3 0", "(?:academic free license|afl)(?: version| v)?(?: 3 0)?"),
    "ecl-2": ("ecl educational", "ecl 2 0", "(?:educational community license|ecl)(?: version)?(?: 2 0)?"),
    "boost-1": ("boost bsl", "bsl 1 0", "boost software license(?: version)?(?: 1 0)?"),
    "busl-1.1": ("business busl", "busl 1 1", "business source license(?: version)?(?: 1 1)?"),
    "sspl-1": ("sspl server", "sspl 1 0", "(?:server side public license|sspl)(?: version| v)?(?: 1)?"),
    "elastic-2": ("elastic", "elastic 2 0", "elastic license(?: version)? ?2(?: 0)?"),
    "cc0": ("cc0 cc creative", "cc0 1 0", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?"),
    "cc-by-nc-nd": ("cc creative noderivatives nd", "cc by nc nd(?: [1234] [05])?", "(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)(?: [1234] [05])?(?: international)?"),
    "cc-by-nc-sa": ("cc creative sharealike sa", "cc by nc sa(?: [1234] [05])?", "(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)(?: [1234] [05])?(?: international)?"),
    "cc-by-nc": ("cc creative noncommercial nc", "cc by nc(?: [1234] [05])?", "(?:cc|creative commons) (?:by nc|attribution non ?commercial)(?: [1234] [05])?(?: international)?"),
    "cc-by-nd": ("cc creative noderivatives nd", "cc by nd(?: [1234] [05])?", "(?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative)?s)(?: [1234] [05])?(?: international)?"),
    "cc-by-sa": ("cc creative sharealike sa", "cc by sa(?: [1234] [05])?", "(?:cc|creative commons) (?:by sa|attribution share ?alike)(?: [1234] [05])?(?: international)?"),
    "cc-by": ("cc creative", "cc by(?: [1234] [05])?", "(?:cc by|creative commons attribution)(?: [1234] [05])?(?: international)?"),
    "odbl": ("odbl database", "odbl 1 0", "(?:open database license|odbl)"),
    "odc-by": ("odc data", "odc by 1 0", "open data commons attribution"),
    "pddl": ("pddl dedication", "pddl 1 0", "(?:public domain dedication and license|pddl)"),
    "ofl-1.1": ("ofl font", "ofl 1 1", "(?:sil )?(?:open font license|ofl)(?: version)?(?: 1 1)?"),
    "psf-2": ("python psf", "(?:psf|python) 2 0", "python(?: software foundation)? license(?: version 2)?"),
    "php-3": ("php", "php 3 0[1]?", "php license(?: version)?(?: 3 0[1]?)?"),
    "ruby": ("ruby", "ruby", "ruby(?: s)? license"),
    "openssl": ("openssl ssleay", "openssl", "(?:openssl|ssleay)"),
    "ncsa": ("ncsa illinois", "ncsa", "(?:university of illinois ncsa|ncsa)(?: open source)?"),
    "postgresql": ("postgresql", "postgresql", "postgresql"),
    "vim": ("vim", "vim", "vim license"),
    "w3c": ("w3c", "w3c", "w3c(?: software)?(?: notice and)?"),
    "zpl-2": ("zope zpl", "zpl 2 [01]", "(?:zope public license|zpl)(?: version)?(?: 2 [01])?"),
    "qpl-1": ("qpl", "qpl 1 0", "(?:q public license|qpl)"),
    "sleepycat": ("sleepycat", "sleepycat", "sleepycat"),
    "upl-1": ("upl permissive", "upl 1 0", "(?:universal permissive license|upl)(?: version| v)?(?: 1 0)?"),
    "json": ("json", "json", "json license"),
    "curl": ("curl", "curl", "curl license"),
    "unicode": ("unicode", "unicode dfs 20[0-9]+", "unicode license(?: agreement)?"),
    "icu": ("icu", "icu", "icu license"),
    "ijg": ("ijg jpeg", "ijg", "independent jpeg group(?: s)? license"),
    "tcl": ("tcl", "tcl", "tcl tk license"),
    "hpnd": ("hpnd historical", "hpnd", "historical permission notice and disclaimer"),
    "blueoak-1": ("blue blueoak", "blueoak 1 0 0", "blue oak model license(?: 1 0 0)?"),
    "mulan-2": ("mulan mulanpsl", "mulanpsl 2 0", "mulan permissive software license(?: v2)?"),
    "ogl-3": ("ogl open", "ogl uk 3 0", "open government licen[cs]e(?: version| v)?(?: ?v?3 0)?"),
    "llama": ("llama", "llama", "llama(?: [234])? community license"),
    "openrail": ("openrail rail", "openrail", "(?:open ?rail|responsible ai license)(?: m)?"),
}

_GRANTED = "(?:licen[cs]ed|released|distributed|available|provided|published|shared|used)(?: to you)? under"
_GRANT = f"{_GRANTED}(?: the)?(?: terms of)?(?: the)?"
#: (priority, expression) of each form; 0 is best.
FORMS = (
    (0, " (?:spdx )?licen[cs]e identifier {identifier}(?= )"),
    (1, f" {_GRANT} {{name}}(?: (?:public )?licen[cs]e)?(?= )"),
    (2, " (?:the )?{name}(?: public)? licen[cs]e(?:s|d)?(?= )"),
    (3, " licen[cs]e {name}(?= )"),
)
#: Confidence of the best detection, by priority.
SCORES = (0.95, 0.9, 0.7, 0.5)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words before A-Z are lower-cased, which is cheaper to do in the few gated texts.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Every base phrase and every form needs one of these.
_GATE = "(?i)" + "|".join([
    "licen[cs]e", *[x.replace(" ", _GAP) for x in BASE if "license" not in x], _GRANTED.replace(" ", _GAP)])
#: Words that say little of a licence.
_COMMON = {"license", "licence", "public", "software", "version", "general", "open", "the", "and"}


def spellings(expression: str) -> set[str]:
    """All texts of an expression of letters, ``[...]``, ``(?:...|...)``, ``?`` and ``+``. A range has
    its first character and ``+`` is once."""

    def branches(at):
        found, texts = set(), {""}
        while at < len(expression) and expression[at] != ")":
            if expression[at] == "|":
                found, texts, at = found | texts, {""}, at + 1
                continue
            if expression.startswith("(?:", at):
                part, at = branches(at + 3)
            elif expression[at] == "[":
                end = expression.index("]", at)
                part, at = set(re.sub("(.)-.", r"\1", expression[at + 1:end])), end
            else:
                part = {expression[at]}
            at += 1
            if expression[at:at + 1] == "?":
                part, at = part | {""}, at + 1
            elif expression[at:at + 1] == "+":
                at += 1
            texts = {x + y for x in texts for y in part}
        return found | texts, at

    return branches(0)[0]


def keys(label: str) -> list[str]:
    """The licence's key words, and of each spelling that has none of them its longest word."""
    key_words, identifier, name = LICENSES[label]
    found = key_words.split()
    for text in sorted(spellings(identifier) | spellings(name)):
        words = text.split()
        if not set(words) & set(found):
            found.append(max(words, key=lambda x: (x not in _COMMON and not x.isdigit(), len(x))))
    return found


def rules() -> list[tuple[str, str, int, str]]:
    """(key word, label, priority, expression) in the order that breaks ties."""
    return [
        (key, label, priority, form.format(identifier=identifier, name=name))
        for label, (_, identifier, name) in LICENSES.items()
        for priority, form in FORMS
        for key in keys(label)
    ]


def _sql(text: str) -> str:
    return "r'" + text + "'"


def _rule_map() -> str:
    by_key: dict[str, list[str]] = {}
    for number, (key, label, priority, expression) in enumerate(rules()):
        by_key.setdefault(key, []).append(
            f"named_struct('label', '{label}', 'priority', {priority}, 'number', {number}, 'regex', {_sql(expression)})")
    entries = ", ".join(f"'{key}', array({', '.join(own)})" for key, own in by_key.items())
    return f"map({entries})"


_SPANS = "array<struct<start:int,tail:int,priority:int,number:int,label:string>>"


def _detections() -> str:
    """All detections in ``norm``: of each rule picked by a key word, the places where it matches."""
    places = f"""aggregate(
        arrays_zip(split(norm, rule.regex, -1), regexp_extract_all(norm, rule.regex, 0)),
        named_struct('at', 0, 'found', CAST(array() AS {_SPANS})),
        (state, x) -> named_struct(
            'at', state.at + length(x.`0`) + coalesce(length(x.`1`), 0),
            'found', CASE WHEN x.`1` IS NULL THEN state.found ELSE concat(state.found, array(named_struct(
                'start', state.at + length(x.`0`), 'tail', -(state.at + length(x.`0`) + length(x.`1`)),
                'priority', rule.priority, 'number', rule.number, 'label', rule.label))) END),
        state -> state.found)"""
    words = "|".join(sorted({key for key, *_ in rules()}))
    picked = f"array_distinct(regexp_extract_all(norm, {_sql(f' ({words})(?= )')}, 1))"
    chosen = f"flatten(transform({picked}, key -> element_at(rule_map, key)))"
    return f"array_sort(flatten(transform({chosen}, rule -> {places})))"


def _unsuppressed() -> str:
    """Detections that lie in no other of the same or a better priority. ``tail`` is minus the end, so
    that the order of (start, tail, priority, number) has every interval before those it contains."""
    best = ", ".join(f"CASE WHEN x.priority >= {k} THEN state.end{k} ELSE 0 END" for k in range(len(FORMS)))
    ends = ", ".join(f"'end{k}', CASE WHEN x.priority = {k} THEN greatest(state.end{k}, -x.tail) ELSE state.end{k} END"
                     for k in range(len(FORMS)))
    start = ", ".join(f"'end{k}', 0" for k in range(len(FORMS)))
    return f"""aggregate(found,
        named_struct({start}, 'kept', CAST(array() AS {_SPANS})),
        (state, x) -> named_struct({ends},
            'kept', CASE WHEN greatest({best}) >= -x.tail THEN state.kept ELSE concat(state.kept, array(x)) END),
        state -> state.kept)"""


def _spaces(text: str) -> str:
    return f"(length({text}) - length(replace({text}, ' ', '')))"


def scanned(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """The columns to keep with words, base places, labels and score of every row."""
    rows = docs.select(
        *keep, F.coalesce("text", F.lit("")).alias("__text"),
    ).withColumn("n_words", F.regexp_count("__text", F.lit(_WORD)).cast("long")).withColumn(
        "norm", F.when(F.col("__text").rlike(_GATE), F.concat(
            F.lit(" "),
            F.array_join(F.expr(
                f"filter(split(translate(__text, '{_UPPER}', '{_LOWER}'), {_sql(_GAP)}), x -> x <> '')"), " "),
            F.lit(" "))))
    for number, phrase in enumerate(BASE):
        rows = rows.withColumn(f"p{number}", F.expr(f"split(norm, {_sql(f' {phrase}(?= )')}, -1)"))
    counts = [f"coalesce(size(p{k}) - 1, 0)" for k in range(len(BASE))]
    firsts = [f"CASE WHEN size(p{k}) > 1 THEN {_spaces(f'element_at(p{k}, 1)')} END" for k in range(len(BASE))]
    lasts = [
        f"CASE WHEN size(p{k}) > 1 THEN n_words - {len(phrase.split())} - {_spaces(f'element_at(p{k}, -1)')} + 1 END"
        for k, phrase in enumerate(BASE)]
    base = ", ".join(f"CASE WHEN size(p{k}) > 1 THEN '{label}' END" for k, label in enumerate(BASE.values()))
    # A row without the gate's vocabulary has no ``norm`` and skips all that follows.
    rows = rows.select(
        *keep, "n_words", "norm",
        F.expr(f"CAST({' + '.join(counts)} AS BIGINT)").alias("n_base"),
        F.expr(f"CAST(least({', '.join(firsts)}) AS BIGINT)").alias("first_word"),
        F.expr(f"CAST(greatest({', '.join(lasts)}) AS BIGINT)").alias("last_word"),
        F.expr(f"array_sort(array_distinct(array_compact(array({base}))))").alias("__base"),
    ).withColumn("rule_map", F.expr(_rule_map())).withColumn(
        "found", F.expr(f"CASE WHEN norm IS NOT NULL THEN {_detections()} ELSE CAST(array() AS {_SPANS}) END")
    ).withColumn(
        "spans", F.expr(f"CASE WHEN size(found) > 1 THEN {_unsuppressed()} ELSE found END"))
    scores = " ".join(f"WHEN {k} THEN {score}D" for k, score in enumerate(SCORES))
    return rows.select(
        *keep, "n_words", "n_base", "first_word", "last_word",
        F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.expr("array_sort(array_union(__base, transform(spans, x -> x.label)))"), ",").alias("labels"),
        F.expr(f"CASE WHEN n_base > 0 THEN 1D WHEN size(spans) = 0 THEN 0D "
               f"ELSE CASE array_min(transform(spans, x -> x.priority)) {scores} END END").alias("score"),
    )
