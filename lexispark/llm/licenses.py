"""License scan by ordered signature rules, with DataFrame functions only.

Texts are lower-cased and cut into words (ASCII letters and digits, and any other character beyond ASCII). A
keyword prefilter, derived from the rules, lets only texts through that hold all the words which some rule needs;
for the others nothing but words is counted. Each rule is a regular expression over the space-joined words, it
begins at an anchor word, and it is tried only where that anchor stands and where the words that follow hold the
rule's keyword, the longest word that it needs behind its anchor. The rules are the hand-written signatures of license_rules, by
priority, and behind them, for names in other phrasings, the license families below in the phrasings below.

Detections of a text are intervals of words. One that lies within another of the same or a higher priority
(a lower number) is suppressed; of equal intervals the higher priority stays, then the rule that comes first. What
is left gives the labels, beside those of the base phrases, which always stay; the score is the largest
confidence of what is left.

No row meets another, so there is no shuffle and no skew; work on a text grows with its length, as a
detection is held against those only that begin within SPAN words before it.

Defined cases: null and empty texts have no words and score 0; an empty table gives no rows; repeated rows are
scanned alike; texts of any length are scanned whole; null ids stay; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm import license_rules

#: Base phrases and their labels, as the contract fixes them.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: What separates words in a lower-cased text.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word in a text of any case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Longest signature in words.
SPAN = 24

#: Families: label, anchor (the first word of the name), keyword, the name as a regular expression over words.
FAMILIES = (
    ("mit", "mit", "mit", r"mit(?: expat| x11)?"),
    ("mit-0", "mit", "mit", r"mit (?:no attribution|0)"),
    ("apache-1", "apache", "apache", r"apache(?: software)?(?: license)?(?: version)? 1(?: [01])?"),
    ("apache-2", "apache", "apache", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("gpl-2", "gpl", "gpl", r"gpl ?(?:version |v)?2(?: 0)?(?: only)?"),
    ("gpl-3", "gpl", "gpl", r"gpl ?(?:version |v)?3(?: 0)?(?: only)?"),
    ("gpl-2", "gnu", "gnu", r"gnu (?:general public|gpl)(?: license)? ?(?:version |v)?2(?: 0)?"),
    ("gpl-3", "gnu", "gnu", r"gnu (?:general public|gpl)(?: license)? ?(?:version |v)?3(?: 0)?"),
    ("gpl", "gnu", "gnu", r"gnu (?:general public|gpl)"),
    ("lgpl-2-1", "gnu", "gnu", r"gnu (?:lesser|library) general public(?: license)? ?(?:version |v)?2(?: [01])?"),
    ("lgpl-3", "gnu", "gnu", r"gnu lesser general public(?: license)? ?(?:version |v)?3(?: 0)?"),
    ("lgpl", "lgpl", "lgpl", r"lgpl(?: ?(?:version |v)?(?:2 1|2|3)(?: 0)?)?"),
    ("agpl-3", "gnu", "affero", r"gnu affero general public(?: license)?(?: ?(?:version |v)?3(?: 0)?)?"),
    ("agpl-3", "agpl", "agpl", r"agpl(?: ?(?:version |v)?3(?: 0)?)?"),
    ("bsd-2", "bsd", "bsd", r"bsd 2 clause|bsd two clause"),
    ("bsd-2", "simplified", "bsd", r"simplified bsd"),
    ("bsd-3", "bsd", "bsd", r"bsd 3 clause|bsd three clause"),
    ("bsd-3", "modified", "bsd", r"modified bsd"),
    ("bsd-3", "new", "bsd", r"new bsd"),
    ("bsd", "bsd", "bsd", r"bsd"),
    ("0bsd", "0bsd", "0bsd", r"0bsd"),
    ("mpl-1-1", "mozilla", "mozilla", r"mozilla public(?: license)?(?: version)? 1(?: 1)?"),
    ("mpl-2", "mozilla", "mozilla", r"mozilla public(?: license)?(?: version)? 2(?: 0)?"),
    ("mpl-2", "mpl", "mpl", r"mpl(?: v)? ?2(?: 0)?"),
    ("epl-1", "eclipse", "eclipse", r"eclipse public(?: license)?(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "eclipse", "eclipse", r"eclipse public(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("cddl-1", "common", "distribution", r"common development and distribution(?: license)?(?: version)?(?: 1 [01])?"),
    ("isc", "isc", "isc", r"isc"),
    ("zlib", "zlib", "zlib", r"zlib(?: libpng)?"),
    ("boost-1", "boost", "boost", r"boost software(?: license)?(?: version)?(?: 1 0)?"),
    ("artistic-2", "artistic", "artistic", r"artistic(?: license)? 2(?: 0)?"),
    ("wtfpl", "wtfpl", "wtfpl", r"wtfpl"),
    ("unlicense", "unlicense", "unlicense", r"unlicense"),
    ("cc0", "cc0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by", "cc", "by", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", "sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", "nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", "nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", "nc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", "nc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative", "attribution", r"creative commons attribution(?: [1-4] [05])?"),
    ("cc-by-sa", "creative", "share", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative", "non", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("odbl", "open", "database", r"open (?:data commons open )?database"),
    ("ofl", "sil", "sil", r"sil open font"),
    ("proprietary", "proprietary", "proprietary", r"proprietary"),
)
#: Phrasings behind the signatures: priority, confidence, anchor (none: the family's), what comes before and after the name.
_UNDER = r" under (?:the )?(?:terms of the |conditions of the )?"
PHRASINGS = (
    (5, 0.75, "licensed", "licensed" + _UNDER, r"(?: licen[cs]e)?"),
    (5, 0.75, "released", "released" + _UNDER, r"(?: licen[cs]e)?"),
    (5, 0.75, "distributed", "distributed" + _UNDER, r"(?: licen[cs]e)?"),
    (5, 0.75, "available", "available" + _UNDER, r"(?: licen[cs]e)?"),
    (5, 0.7, "under", r"under (?:the )?(?:terms of the )?", r" licen[cs]e"),
    (5, 0.7, "spdx", r"spdx licen[cs]e identifier ", r""),
    (6, 0.65, None, "", r" licen[cs]e"),
    (6, 0.6, "license", r"license (?:is )?(?:the )?", r""),
)
#: Names that mean a license by themselves, without the word.
ALONE = ("cc0", "wtfpl", "unlicense", "0bsd", "cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd", "agpl-3", "lgpl", "gpl-2", "gpl-3")


def rules() -> list[tuple[str, str, str, str, int, float]]:
    """(anchor, label, keyword, expression, priority, confidence), in order of priority."""
    out = []
    for label, rx, priority, sure in license_rules.signatures():
        anchor, words = re.match("[a-z0-9]+", rx)[0], needed(rx)
        out.append((anchor, label, max([w for w in words if w not in (anchor, "under")] or words, key=len), rx, priority, sure))
    for priority, sure, anchor, before, after in PHRASINGS:
        out += [(anchor or a, label, k, f"{before}(?:{name}){after}", priority, sure) for label, a, k, name in FAMILIES]
    out += [(a, label, k, f"(?:{name})", 7, 0.5) for label, a, k, name in FAMILIES if label in ALONE]
    return sorted(out, key=lambda r: r[4])


def needed(rx: str) -> list[str]:
    """Words, or beginnings of words, that each match of a rule's expression holds."""
    rx = rx.replace("licen[cs]e", "licen").replace(" ?", " ")
    before = None
    while rx != before:
        before = rx
        rx = re.sub(r"\(\?:[^()]*\)\?", " ", rx)  # optional
        rx = re.sub(r"\(\?:([^()|]*)\)(?!\?)", r"\1", rx)  # always there
    rx = re.sub(r"\(\?:[^()]*\)", " ", rx)  # alternatives
    return re.findall(r"[a-z0-9]{2,}", re.sub(r"\[[^]]*\](?:\{[0-9]\})?", " ", rx))


def gates() -> dict[tuple[str, ...], set[str]]:
    """Words that must all be in a text, and, if there are any, keywords of which one must be; no rule or base phrase matches without one of these."""
    out: dict[tuple[str, ...], set[str]] = {}
    for rx, anchor, keyword in [(p, None, None) for p, _ in BASE] + [(rx, a, k) for a, _, k, rx, _, _ in rules()]:
        words = sorted(needed(rx), key=len, reverse=True)
        if any("licen" in w for w in words):
            out["licen",] = set()
        elif "under" in words and anchor in words and anchor != "under":
            out.setdefault((anchor, "under"), set()).add(keyword)
        else:
            out[tuple(dict.fromkeys([*words, *([keyword] if keyword else [])]))] = set()
    return {g: k for g, k in out.items() if not any(not k2 and set(g2) < set(g) for g2, k2 in out.items())}


def covered() -> dict[str, list[tuple[tuple[str, ...], set[str]]]]:
    """The gates by few words, one of which each gate needs: the most shared first, short ones only where there is no other. A text without these words is through with as many looks."""
    left, out = list(gates().items()), {}
    while left:
        shared = Counter(w for group, _ in left for w in {w for w in group if len(w) > 4} or set(group))
        stem = max(shared, key=lambda w: (sum(shared[x] for x in shared if w in x), len(w), w))
        out[stem] = [(tuple(w for w in group if w != stem), keys) for group, keys in left if any(stem in w for w in group)]
        left = [(group, keys) for group, keys in left if not any(stem in w for w in group)]
    return out


def _quoted(x: str) -> str:
    return "r'" + x + "'"


def rule_map() -> tuple[str, list[str]]:
    """SQL for a constant map from anchor to its rules, and the anchors."""
    by: dict[str, list[str]] = {}
    for n, (anchor, label, keyword, rx, priority, sure) in enumerate(rules()):
        by.setdefault(anchor, []).append(f"named_struct('label', '{label}', 'keyword', '{keyword}', 'rx', {_quoted('^(?:' + rx + ')(?= |$)')}, 'priority', {priority}, 'sure', {sure}D, 'n', {n})")
    return "map(" + ", ".join(f"'{a}', array({', '.join(r)})" for a, r in by.items()) + ")", list(by)


def detections(words: str) -> tuple[Column, int]:
    """Array of (first, short, priority, n, label, sure) of an array of words, sorted so that what contains comes first; how many rows back that can be.

    short is minus the number of words, so that of those with one start the longest comes first. Of one start only
    those stay that no longer one of the same or a higher priority contains: one for each priority at most.
    """
    table, anchors = rule_map()
    here = ", ".join(f"'{a}'" for a in anchors)
    found = f"""
      filter(
        transform(
          transform(
            filter({table}[{words}[i - 1]], r -> contains(array_join(slice({words}, i, {SPAN}), ' '), r.keyword)),
            r -> named_struct('r', r, 'hit', regexp_extract(array_join(slice({words}, i, {SPAN}), ' '), r.rx, 0))),
          x -> named_struct('first', i - 1, 'short', if(x.hit = '', 0, length(replace(x.hit, ' ', '')) - length(x.hit) - 1), 'priority', x.r.priority, 'n', x.r.n, 'label', x.r.label, 'sure', x.r.sure)),
        x -> x.short < 0)"""
    every = f"""
      flatten(transform(
        filter(sequence(1, size({words})), i -> array_contains(array({here}), {words}[i - 1])),
        i -> element_at(transform(array(array_sort({found})), own ->
          filter(own, (d, k) -> not exists(slice(own, 1, k), e -> e.priority <= d.priority))), 1)))"""
    return F.expr(every), len({r[4] for r in rules()}) * (SPAN + 1)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base counts and places, and detections: label, priority, first word, number of words, confidence of those that stay."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long"), text.alias("_text"))
    low = F.lower("_text")
    passes = F.lit(False)
    for stem, groups in covered().items():
        some = F.lit(False)
        for group, words in groups:
            every = low.rlike("|".join(sorted(words))) if words else F.lit(True)
            for k in reversed(group):
                every = low.contains(k) & every
            some = every | some
        passes = passes | low.contains(stem) & some
    own = own.withColumn("_words", F.regexp_count("_text", F.lit(WORD)).cast("long")).withColumn("_gated", F.when(passes, low).otherwise(""))
    own = own.withColumn("_norm", F.trim(F.regexp_replace("_gated", GAPS, " "))).drop("_text", "_gated")
    own = own.withColumn("_padded", F.concat(F.lit(" "), "_norm", F.lit(" ")))
    own = own.withColumn("_twice", F.concat(F.lit(" "), F.replace("_norm", F.lit(" "), F.lit("  ")), F.lit(" ")))
    own = own.withColumn("_split", F.when(F.col("_norm") == "", F.array().cast("array<string>")).otherwise(F.split("_norm", " ")))
    found, window = detections("_split")
    own = own.withColumn("_all", F.when(F.size("_split") > 0, found))
    stays = f"""
      filter(_all, (d, i) -> not exists(slice(_all, greatest(1, i + 1 - {window}), least(i, {window})),
        e -> e.first <= d.first and e.first - e.short >= d.first - d.short and e.priority <= d.priority))"""
    return own.withColumn("detections", F.expr(stays))


def places(phrase: str) -> tuple[Column, Column, Column]:
    """Count, first and last start (in words) of a phrase."""
    doubled, one = phrase.replace(" ", "  "), f" {phrase} "
    gone = F.length("_twice") - F.length(F.replace("_twice", F.lit(f" {doubled} "), F.lit("")))
    n = (gone / (len(doubled) + 2)).cast("long")
    spaces = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")
    first = F.when(n > 0, spaces(F.substring_index("_padded", one, 1)))
    last = F.when(n > 0, F.col("_words") - spaces(F.substring_index("_padded", one, -1)) - len(phrase.split(" ")))
    return n, first, last


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    own = scan(docs)
    for i, (phrase, _) in enumerate(BASE):
        n, first, last = places(phrase)
        own = own.withColumn(f"_n{i}", n).withColumn(f"_f{i}", first).withColumn(f"_l{i}", last)
    every = range(len(BASE))
    base = F.array_compact(F.array(*(F.when(F.col(f"_n{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE))))
    more = F.coalesce(F.transform("detections", lambda d: d["label"]), F.array().cast("array<string>"))
    sure = F.coalesce(F.array_max(F.transform("detections", lambda d: d["sure"])), F.lit(0.0))
    return own.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        sum((F.col(f"_n{i}") for i in every), F.lit(0).cast("long")).alias("n_base"),
        F.least(*(f"_f{i}" for i in every)).alias("first_word"),
        F.greatest(*(f"_l{i}" for i in every)).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.when(F.size(base) > 0, F.greatest(sure, F.lit(0.9))).otherwise(sure).alias("score"),
    )
