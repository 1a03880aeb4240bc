"""License detection by ordered signature rules, in DataFrame functions only.

Rules are regular expressions in three ranks: 1 declares a license (an SPDX tag, "licensed under"), 2
names it in full, 3 mentions it.  They are written as a few forms over a list of license families, so
there are some hundreds of them.  A text first shows which keywords it contains, whatever white space, punctuation
or comment marks stand between their words; only the rules of those keywords run on it.  Every match is an interval.  Detections are put in order of start, longer
first, then rank and rule; one is suppressed if an earlier one of the same or a better rank contains
it, so of equal intervals the better rank and the earlier rule stays.

Beside the rules, four base phrases are counted over the words of the text.

Defined cases: null counts as empty; a text without words has 0 words, no places, empty labels and score
0; all rows come back, repeated ones too.  Columns of the input with the name of a result column are
replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import free_name, lower_ascii, text_of

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Fixed value: what separates words, after lower-casing A-Z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: family: (keyword, name as a pattern, SPDX stem, versions)
FAMILIES: dict[str, tuple[str, str, str, tuple[str, ...]]] = {
    "gpl": ("general public", r"gnu general public licen[cs]e", "gpl", ("1.0", "2.0", "3.0")),
    "gpl-short": ("gpl", r"gnu gpl|gpl", "gpl", ("2.0", "3.0")),
    "lgpl": ("lesser general", r"gnu lesser general public licen[cs]e", "lgpl", ("2.0", "2.1", "3.0")),
    "lgpl-short": ("lgpl", r"gnu lgpl|lgpl", "lgpl", ("2.1", "3.0")),
    "agpl": ("affero", r"(?:gnu )?affero general public licen[cs]e", "agpl", ("1.0", "3.0")),
    "agpl-short": ("agpl", r"agpl", "agpl", ("3.0",)),
    "gfdl": ("free documentation", r"gnu free documentation licen[cs]e", "gfdl", ("1.1", "1.2", "1.3")),
    "apache": ("apache", r"apache(?: software)? licen[cs]e", "apache", ("1.0", "1.1", "2.0")),
    "mit": ("mit", r"mit licen[cs]e", "mit", ()),
    "mit-expat": ("expat", r"expat licen[cs]e", "mit", ()),
    "bsd": ("bsd", r"(?:modified |simplified |new |revised )?bsd licen[cs]e", "bsd", ()),
    "bsd-2": ("bsd", r"(?:two|2)[ -]clause bsd(?: licen[cs]e)?|bsd[ -]2[ -]clause", "bsd-2-clause", ()),
    "bsd-3": ("bsd", r"(?:three|3)[ -]clause bsd(?: licen[cs]e)?|bsd[ -]3[ -]clause", "bsd-3-clause", ()),
    "isc": ("isc", r"isc licen[cs]e", "isc", ()),
    "mpl": ("mozilla", r"mozilla public licen[cs]e", "mpl", ("1.0", "1.1", "2.0")),
    "epl": ("eclipse", r"eclipse public licen[cs]e", "epl", ("1.0", "2.0")),
    "edl": ("eclipse", r"eclipse distribution licen[cs]e", "edl", ("1.0",)),
    "cddl": ("common development", r"common development and distribution licen[cs]e", "cddl", ("1.0", "1.1")),
    "cpl": ("common public", r"common public licen[cs]e", "cpl", ("1.0",)),
    "eupl": ("european union public", r"european union public licen[cs]e", "eupl", ("1.0", "1.1", "1.2")),
    "artistic": ("artistic", r"artistic licen[cs]e", "artistic", ("1.0", "2.0")),
    "bsl": ("boost", r"boost software licen[cs]e", "bsl", ("1.0",)),
    "zlib": ("zlib", r"zlib(?:/libpng)? licen[cs]e", "zlib", ()),
    "unlicense": ("unlicense", r"the unlicense|unlicense", "unlicense", ()),
    "wtfpl": ("wtfpl", r"wtfpl", "wtfpl", ("1.0", "2.0")),
    "psf": ("python software", r"python software foundation licen[cs]e", "psf", ("2.0",)),
    "php": ("php", r"php licen[cs]e", "php", ("3.0", "3.01")),
    "ruby": ("ruby", r"ruby licen[cs]e", "ruby", ()),
    "openssl": ("openssl", r"openssl licen[cs]e", "openssl", ()),
    "ofl": ("open font", r"(?:sil )?open font licen[cs]e", "ofl", ("1.0", "1.1")),
    "osl": ("open software", r"open software licen[cs]e", "osl", ("1.0", "2.0", "2.1", "3.0")),
    "afl": ("academic free", r"academic free licen[cs]e", "afl", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    "ms-pl": ("microsoft", r"microsoft public licen[cs]e", "ms-pl", ()),
    "ms-rl": ("microsoft", r"microsoft reciprocal licen[cs]e", "ms-rl", ()),
    "upl": ("universal permissive", r"universal permissive licen[cs]e", "upl", ("1.0",)),
    "odbl": ("open database", r"open database licen[cs]e", "odbl", ("1.0",)),
    "cecill": ("cecill", r"cecill(?:-[bc])?(?: licen[cs]e)?", "cecill", ("1.0", "2.0", "2.1")),
    "qpl": ("q public", r"q public licen[cs]e", "qpl", ("1.0",)),
    "ncsa": ("ncsa", r"(?:university of illinois/)?ncsa(?: open source)? licen[cs]e", "ncsa", ()),
    "apsl": ("apple public", r"apple public source licen[cs]e", "apsl", ("1.0", "1.1", "1.2", "2.0")),
    "busl": ("business source", r"business source licen[cs]e", "busl", ("1.1",)),
    "sspl": ("server side public", r"server side public licen[cs]e", "sspl", ("1.0",)),
    "elastic": ("elastic", r"elastic licen[cs]e", "elastic", ("1.0", "2.0")),
    "mulan": ("mulan", r"mulan permissive software licen[cs]e", "mulanpsl", ("1.0", "2.0")),
    "vim": ("vim", r"vim licen[cs]e", "vim", ()),
    "x11": ("x11", r"x11 licen[cs]e", "x11", ()),
    "ecl": ("educational community", r"educational community licen[cs]e", "ecl", ("1.0", "2.0")),
    "lppl": ("latex project", r"latex project public licen[cs]e", "lppl", ("1.0", "1.2", "1.3")),
    "cc0": ("cc0", r"cc0", "cc0", ("1.0",)),
    "cc0-long": ("creative commons", r"creative commons zero", "cc0", ("1.0",)),
}
#: Creative Commons kinds: each as a short form and as a long name
COMMONS = {
    "by": "attribution", "by-sa": "attribution[ -]sharealike", "by-nd": "attribution[ -]noderiv(?:ative|ativ)e?s",
    "by-nc": "attribution[ -]noncommercial", "by-nc-sa": "attribution[ -]noncommercial[ -]sharealike",
    "by-nc-nd": "attribution[ -]noncommercial[ -]noderiv(?:ative|ativ)e?s",
}
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
RANK_SCORE = {1: 0.95, 2: 0.85, 3: 0.6}
BASE_SCORE = 0.5
#: A text without any of these holds no match of any rule
GATE = ("licen", "spdx", "gpl", "bsd", "cc by", "cc-by", "cc0", "creative", "unlicense", "wtfpl", "cecill",
        "public domain", "all rights reserved")
_GAP = r"[\s,;:()*#/]+"
_DECLARES = (r"(?:licensed|released|distributed|available|published|provided)" + _GAP + r"(?:under|on)" + _GAP
             + r"(?:the" + _GAP + r")?(?:terms" + _GAP + r"of" + _GAP + r")?(?:the" + _GAP + r")?(?:conditions" + _GAP + r"of" + _GAP + r")?")
_WRAP = r"(?:[\r\n][\s*#/]*)?"       # a line break and the comment mark of the next line
_VERSION = r"[\s,;:()-]*" + _WRAP + r"(?:version|ver\.?|v)?[\s.]*" + _WRAP


@dataclass(frozen=True)
class Rule:
    keyword: str
    rank: int
    label: str
    pattern: str


def _spaced(name: str) -> str:
    """Lets any run of white space or punctuation stand where the name has a blank."""
    return rf"\b(?:{name.replace('[ -]', _GAP.replace('[', '[-')).replace(' ', _GAP)})\b"


def rules() -> list[Rule]:
    """All rules, in order."""
    out: list[Rule] = []
    for keyword, name, stem, versions in FAMILIES.values():
        full = _spaced(name)
        number = lambda v: _VERSION + v.removesuffix(".0").replace(".", r"\.") + (r"(?:\.0)?" if v.endswith(".0") else "") + r"(?![\d.]*\d)"
        for v in versions:
            out.append(Rule("spdx", 1, f"{stem}-{v}", rf"spdx-license-identifier:\s*{stem}-{v}".replace(".", r"\.") + r"(?:-only|-or-later|\+)?"))
            out.append(Rule(keyword, 1, f"{stem}-{v}", _DECLARES + full + number(v)))
            out.append(Rule(keyword, 2, f"{stem}-{v}", full + number(v)))
        if not versions:
            out.append(Rule("spdx", 1, stem, rf"spdx-license-identifier:\s*{stem}\b(?!-)"))
        out.append(Rule(keyword, 1, stem, _DECLARES + full))
        out.append(Rule(keyword, 3, stem, full))
    for kind, name in COMMONS.items():
        short = r"\bcc(?:-|\s[\s*#/]*)" + kind.replace("-", r"[\s-]") + r"\b(?![\s-](?:sa|nc|nd)\b)"
        long = _spaced("creative commons " + name)
        for v in COMMONS_VERSIONS:
            digits = v.replace(".", r"\.")
            out.append(Rule("cc", 2, f"cc-{kind}-{v}", short + r"[\s-]*" + _WRAP + r"(?:v\s?)?" + digits))
            out.append(Rule("creative commons", 2, f"cc-{kind}-{v}", long + r"[\s,-]*" + _WRAP + r"(?:v\s?|version\s*)?" + _WRAP + digits))
            out.append(Rule("creativecommons.org", 1, f"cc-{kind}-{v}", rf"creativecommons\.org/licenses/{kind}/{digits}"))
        out.append(Rule("cc", 3, f"cc-{kind}", short))
        out.append(Rule("creative commons", 3, f"cc-{kind}", long))
    out.append(Rule("public domain", 3, "public-domain", _spaced("(?:dedicated to|released into|in) the public domain")))
    out.append(Rule("all rights reserved", 3, "proprietary", _spaced("all rights reserved")))
    return out


def _holds(low: Column, phrase: str) -> Column:
    """Whether the words of the phrase stand in a row, with anything between them that a pattern lets be there."""
    words = phrase.split(" ")
    each = reduce(and_, [F.contains(low, F.lit(w)) for w in words])
    return each & F.rlike(low, F.lit(_GAP.replace("[", "[-").join(map(re.escape, words)))) if len(words) > 1 else each


def _matches(low: Column, rule: Column) -> Column:
    """Intervals of a rule's matches.  The pieces between matches give their places."""
    found = F.regexp_extract_all(low, rule["pattern"], F.lit(0))
    between = F.transform(F.split(low, rule["pattern"], -1), F.length)
    lengths = F.transform(found, F.length)
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    walked = F.aggregate(
        F.arrays_zip(between.alias("gap"), lengths.alias("len")), first,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["len"], F.lit(0))).alias("at"),
            F.when(x["len"].isNull(), acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["at"] + x["gap"]))).alias("starts")))
    return F.transform(
        F.arrays_zip(walked["starts"].alias("start"), lengths.alias("len")),
        lambda m: F.struct(m["start"].alias("start"), (-m["start"] - m["len"]).alias("minus_end"),
                           rule["rank"].alias("rank"), rule["number"].alias("number"), rule["label"].alias("label")))


def detections(low: Column, hits: Column) -> Column:
    """Detections that stay, of the rules of the keywords ``hits``: (start, minus_end, rank, number, label)."""
    every = rules()
    of_keyword: dict[str, list[Column]] = {}
    for n, r in enumerate(every):
        of_keyword.setdefault(r.keyword, []).append(F.struct(
            F.lit(n).alias("number"), F.lit(r.rank).alias("rank"), F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern")))
    book = F.create_map(*[c for k, rs in of_keyword.items() for c in (F.lit(k), F.array(*rs))])
    run = F.flatten(F.transform(hits, lambda k: book[k]))
    found = F.array_sort(F.flatten(F.transform(run, lambda r: _matches(low, r))))
    none = F.lit(-1)
    # furthest end so far among detections of each rank or a better one
    start = F.struct(none.alias("e1"), none.alias("e2"), none.alias("e3"), F.filter(found, lambda d: F.lit(False)).alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        end = -d["minus_end"]
        covered = F.when(d["rank"] == 1, acc["e1"]).when(d["rank"] == 2, acc["e2"]).otherwise(acc["e3"]) >= end
        upto = lambda r: F.greatest(acc[f"e{r}"], F.when(d["rank"] <= r, end).otherwise(-1))
        return F.struct(upto(1).alias("e1"), upto(2).alias("e2"), upto(3).alias("e3"),
                        F.when(covered, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"))

    return F.aggregate(found, start, step, lambda acc: acc["kept"])


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels``, ``score`` and ``detections``."""
    low, words, hits, det = (free_name(df, n) for n in ("_low", "_words", "_hits", "_found"))
    keywords = sorted({r.keyword for r in rules()})
    contains = lambda k: F.contains(F.col(low), F.lit(k))
    gate = reduce(or_, [_holds(F.col(low), g) for g in GATE])
    # the rarest word of each phrase; "cc by" may have anything between its words
    base_gate = contains("license") | (contains("cc") & contains("by") & F.rlike(F.col(low), F.lit("cc[^a-z0-9]+by")))
    out = df.withColumn(low, lower_ascii(text_of(text)))
    held = F.array_compact(F.array(*[F.when(_holds(F.col(low), k), F.lit(k)) for k in keywords]))
    out = out.withColumn(hits, F.when(gate, held).otherwise(F.array().cast("array<string>")))
    out = out.withColumn(det, F.when(F.size(hits) > 0, detections(F.col(low), F.col(hits))))
    # words between single blanks, with one at either end; only for texts that may hold a phrase
    out = out.withColumn(words, F.when(base_gate, F.concat(F.lit(" "), F.trim(F.regexp_replace(low, GAP, " ")), F.lit(" "))))
    # the blank after a phrase may be the one before the next
    places = {p: F.regexp_count(F.col(words), F.lit(f" {p}(?= )")) for p in BASE}
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    first = lambda p: F.when(F.locate(f" {p} ", F.col(words)) > 0, blanks(F.left(words, F.locate(f" {p} ", F.col(words)))) - 1)
    back = lambda p: F.locate(f" {p[::-1]} ", F.reverse(words))
    after = lambda p: blanks(F.left(F.reverse(words), back(p))) - 1  # noqa: E731  words behind the last place
    last = lambda p: F.when(back(p) > 0, blanks(F.col(words)) - 1 - after(p) - len(p.split()))
    base_found = F.array_compact(F.array(*[F.when(places[p] > 0, F.lit(label)) for p, label in BASE.items()]))
    n_base = F.coalesce(sum((places[p] for p in BASE), F.lit(0)), F.lit(0)).cast("long")
    own = F.coalesce(F.transform(det, lambda d: d["label"]), F.array().cast("array<string>"))
    ranks = F.coalesce(F.array_min(F.transform(det, lambda d: d["rank"])), F.lit(9))
    weight = F.when(ranks == 1, RANK_SCORE[1]).when(ranks == 2, RANK_SCORE[2]).when(ranks == 3, RANK_SCORE[3]).otherwise(0.0)
    result = {
        "n_words": F.regexp_count(F.col(low), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long"),
        "n_base": n_base,
        "first_word": F.least(*[first(p) for p in BASE]).cast("long"),
        "last_word": F.greatest(*[last(p) for p in BASE]).cast("long"),
        "base_labels": F.coalesce(F.array_join(F.array_sort(base_found), ","), F.lit("")),
        "labels": F.array_join(F.array_sort(F.array_union(F.coalesce(base_found, F.array().cast("array<string>")), own)), ","),
        "score": F.greatest(weight, F.when(n_base > 0, BASE_SCORE).otherwise(0.0)),
        "detections": F.coalesce(F.transform(det, lambda d: F.struct(
            d["start"].alias("start"), (-d["minus_end"]).alias("end"), d["label"].alias("label"))),
            F.array().cast("array<struct<start:int,end:int,label:string>>")),
    }
    keep = [F.col(c) for c in df.columns if c.lower() not in result]
    return out.select(*keep, *[c.alias(n) for n, c in result.items()])
