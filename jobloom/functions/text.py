"""Text, number and date expressions.  All of them are plain Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom import rules as R

# A word character is a letter, a digit or "_" in any script.  Spelled out because the
# shorthand \w and \b are ASCII-only in Java regular expressions.
WORD = r"\p{L}\p{N}_"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(""))


def first_nonempty(*cs: str | Column) -> Column:
    """First argument that is neither null nor empty, else null."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def display_default(c: str | Column, label: str) -> Column:
    return F.coalesce(blank_to_null(F.trim(col(c))), F.lit(label))


#: All characters that count as white space at the ends of a text
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: str | Column) -> Column:
    """Without white space of any kind at the ends; ``trim`` removes blanks only."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def collapse_blanks(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(c), r"[\s\x{A0}]+", " "))


def normalize_text(c: str | Column, terms: Sequence[str] = R.COMPANY_TERMS) -> Column:
    """Lower case, drop generic company terms, punctuation to blanks; null becomes ''."""
    lowered = F.trim(F.lower(F.coalesce(col(c), F.lit(""))))
    # most places of a long text are passed over by their letter alone
    begins = {t[0] for t in terms} if all(t and t[0].isalpha() and "|" not in t and t[1:2] not in ("?", "*", "{") for t in terms) else set()
    gate = f"(?=[{''.join(sorted(begins))}])" if begins else ""
    term = rf"{gate}(?<![{WORD}])(?:{'|'.join(terms)})(?![{WORD}])"
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, term, " "), rf"[^{WORD}]+", " "))


def block_key(normalized: str | Column) -> Column:
    return F.substring(col(normalized), 1, 3)


# Vowels whose tone mark moves between the old and the new spelling ("thoả" / "thỏa").
TONE_PAIRS = {"oà": "òa", "oá": "óa", "oả": "ỏa", "oã": "õa", "oạ": "ọa",
              "oè": "òe", "oé": "óe", "oẻ": "ỏe", "oẽ": "õe", "oẹ": "ọe",
              "uỳ": "ùy", "uý": "úy", "uỷ": "ủy", "uỹ": "ũy", "uỵ": "ụy"}


def fold_tone_marks(c: str | Column) -> Column:
    out = col(c)
    for new, old in TONE_PAIRS.items():
        out = F.replace(out, F.lit(new), F.lit(old))
    return out


def is_unstated(c: str | Column, words: Sequence[str] = R.UNSTATED, fold: bool = False) -> Column:
    v = strip(F.lower(col(c)))
    if fold:
        v = fold_tone_marks(v)
    return col(c).isNull() | v.isin(list(words))


def sanitize_name(c: str | Column) -> Column:
    cleaned = F.regexp_replace(F.lower(strip(c)), "[^a-zA-Z0-9_]", "_")
    return F.coalesce(blank_to_null(cleaned), F.lit("unknown"))


def contains_any(c: str | Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(col(c), F.lit(n))
    return out


def first_rule(c: Column, rule_list: Sequence[tuple[Sequence[str], str]]) -> Column:
    """Value of the first rule one of whose needles occurs in ``c``; null without a hit."""
    out = None
    for needles, value in rule_list:
        hit = contains_any(c, needles)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out if out is not None else F.lit(None).cast("string")


def normalize_province(c: str | Column, rule_list=R.PROVINCE_RULES, default: str = R.UNKNOWN_LOCATION) -> Column:
    return F.coalesce(first_rule(F.trim(F.lower(col(c))), rule_list), F.lit(default))


def infer_sector(company, titles, requirements, rule_list=R.SECTOR_RULES) -> Column:
    text = F.lower(F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in (company, titles, requirements)]))
    return first_rule(text, rule_list)


_PLAIN = re.compile(r"^[^\\.^$*+?()\[\]{}|]+$")


def matches_ignoring_case(lowered: Column, pattern: str) -> Column:
    """Whether a pattern occurs in a text that is lower case already.

    Alternatives without special characters become plain substring tests, which are much
    cheaper than the regular expression.
    """
    if re.search(r"\\[A-Z]", pattern):  # \S, \W, \D, \P must keep their case
        return lowered.rlike(f"(?iu){pattern}")
    parts = pattern.lower().split("|") if not re.search(r"[()\[\]\\]", pattern) else [pattern.lower()]
    plain = [p for p in parts if _PLAIN.match(p)]
    other = [p for p in parts if not _PLAIN.match(p)]
    out = contains_any(lowered, plain)
    return out | lowered.rlike("|".join(other)) if other else out


# ---- salary and dates -------------------------------------------------------------------

def _thousands(c: Column) -> Column:
    return F.format_string("%,d", c.cast("bigint"))


def _stated(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


def salary_text(pretty, low, high, currency) -> Column:
    """Bounds with thousands separators, used when the board's own text says nothing."""
    low, high = col(low), col(high)
    cur = F.coalesce(col(currency), F.lit("VND"))
    built = (
        F.when(_stated(low) & _stated(high), F.concat(_thousands(low), F.lit(" - "), _thousands(high), F.lit(" "), cur))
        .when(_stated(low), F.concat(F.lit("Từ "), _thousands(low), F.lit(" "), cur))
        .otherwise(R.SALARY_AGREED)
    )
    text = F.coalesce(col(pretty), F.lit(""))
    return F.when(F.trim(text).isin(R.SALARY_PLACEHOLDERS), built).otherwise(text)


_SPLIT = 134217729.0  # 2**27 + 1 cuts a double into two halves of 26 bits


def _halves(x: float) -> tuple[float, float]:
    high = _SPLIT * x - (_SPLIT * x - x)
    return high, x - high


def _pick(values: Sequence[float], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


_SCALES = [float(10 ** d) for d in range(10)]


def _fixed(v: Column) -> Column:
    """``v.x`` with ``v.digits`` decimals, trailing zeros cut.

    Rounds the exact binary value, as C does: where the scaled value seems to lie half-way,
    the product's rounding error tells on which side it really is.
    """
    def whole_number(w: Column) -> Column:
        x, high, low = w["x"], w["high"], w["low"]
        product = x * w["scale"]
        xh = x * _SPLIT - (x * _SPLIT - x)
        xl = x - xh
        error = (xh * high - product) + xh * low + xl * high + xl * low
        whole = F.floor(product)
        part = product - whole
        up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
        return F.struct((whole + F.when(up, 1).otherwise(0)).cast("bigint").alias("n"),
                        w["scale"].cast("bigint").alias("base"), w["digits"].alias("digits"))

    def text(t: Column) -> Column:
        decimals = F.lpad((t["n"] % t["base"]).cast("string"), t["digits"], F.lit("0"))
        joined = F.concat(F.floor(t["n"] / t["base"]).cast("string"), F.lit("."), decimals)
        return F.when(t["digits"] == 0, t["n"].cast("string")).otherwise(F.regexp_replace(joined, r"\.?0+$", ""))

    halves = [_halves(x) for x in _SCALES]
    parts = F.struct(
        v["x"].alias("x"), v["digits"].alias("digits"), _pick(_SCALES, v["digits"]).alias("scale"),
        _pick([h for h, _ in halves], v["digits"]).alias("high"), _pick([lo for _, lo in halves], v["digits"]).alias("low"))
    return bind(parts, lambda w: bind(whole_number(w), text))


def six_digits(c: Column) -> Column:
    """A non-negative number with at most six significant digits, as C's ``%g`` writes it."""
    def notation(v: Column) -> Column:
        plain = F.when(v["digits"].between(0, 9), _fixed(v))
        return F.when(v["x"] == 0, "0").otherwise(F.coalesce(plain, F.regexp_replace(v["sci"], r"\.?0*e", "e")))

    def with_digits(v: Column) -> Column:
        exponent = F.regexp_extract(v["sci"], r"e([+-]\d+)$", 1).try_cast("int")
        # six significant digits need 5 - exponent decimals
        return bind(F.struct(v["x"].alias("x"), v["sci"].alias("sci"), (5 - exponent).alias("digits")), notation)

    return bind(F.struct(c.alias("x"), F.format_string("%.5e", c).alias("sci")), with_digits)


def salary_text_millions(low, high) -> Column:
    low, high = col(low), col(high)
    lo, hi = six_digits(low / 1e6), six_digits(high / 1e6)
    return (
        F.when(~_stated(low) & ~_stated(high), R.SALARY_AGREED_MILLIONS)
        .when(_stated(low) & _stated(high), F.concat(lo, F.lit(" - "), hi, F.lit(" triệu VND")))
        .when(_stated(low), F.concat(F.lit("Từ "), lo, F.lit(" triệu VND")))
        .otherwise(F.concat(F.lit("Tới "), hi, F.lit(" triệu VND")))
    )


# Currency words and units understood when a salary text is read back.
MILLION_WORDS = r"triệu|tr\b|million"
CURRENCY_WORDS = [("USD", r"usd|\$"), ("VND", r"vnd|vnđ|đồng|triệu|tr\b")]
PERIOD_WORDS = [("year", r"năm|year"), ("hour", r"giờ|hour"), ("day", r"ngày|day")]
FROM_WORDS = r"^\s*(từ|trên|from)"
UPTO_WORDS = r"^\s*(tới|đến|dưới|up to)"


def parse_salary(c: str | Column) -> Column:
    """Salary text as struct(min, max, currency, period); null bounds when not stated.

    Commas are thousands separators, a dot followed by exactly three digits too.
    """
    raw = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    plain = F.regexp_replace(F.regexp_replace(raw, r"(\d),(\d{3})", "$1$2"), r"(\d),(\d{3})", "$1$2")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\d)\.(\d{3})(?!\d)", "$1$2"), r"(\d)\.(\d{3})(?!\d)", "$1$2")
    numbers = F.transform(
        F.regexp_extract_all(plain, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.try_cast("double"))
    unit = F.when(plain.rlike(MILLION_WORDS), 1e6).otherwise(1.0)
    first, second = F.get(numbers, F.lit(0)) * unit, F.get(numbers, F.lit(1)) * unit
    unstated = is_unstated(c, fold=True) | (F.size(numbers) == 0)
    low = F.when(unstated | plain.rlike(UPTO_WORDS), None).otherwise(first)
    high = F.when(unstated, None).when(plain.rlike(UPTO_WORDS), first).when(plain.rlike(FROM_WORDS), None)
    high = high.otherwise(F.coalesce(second, first))
    currency = F.when(unstated, None)
    for name, pattern in CURRENCY_WORDS:
        currency = currency.when(plain.rlike(pattern), name)
    period = F.when(unstated, None)
    for name, pattern in PERIOD_WORDS:
        period = period.when(plain.rlike(pattern), name)
    return F.struct(low.alias("min"), high.alias("max"), currency.otherwise("VND").alias("currency"),
                    period.otherwise("month").alias("period"))


def epoch_to_date(c: str | Column) -> Column:
    """Seconds since 1970 as dd/MM/yyyy in the session zone; '' when missing."""
    seconds = col(c).try_cast("bigint")
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "dd/MM/yyyy"), F.lit(""))


DATE_FORMATS = ["dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd"]


def parse_date(c: str | Column) -> Column:
    """A date in any of the boards' formats; ISO timestamps too; null when unreadable."""
    v = F.trim(col(c))
    head = F.substring(v, 1, 10)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(head, F.lit(f))) for f in DATE_FORMATS])


def space_units(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"(?iu)(\d+)\s*(năm|tháng)", "$1 $2")


def work_type_code(c: str | Column, full_time="1") -> Column:
    return F.when(col(c) == F.lit(full_time), R.WORK_FULL_TIME).otherwise(R.WORK_PART_TIME)


def text_after_label(c: str | Column, label: str = R.WORKING_TIME_LABEL, limit: int = R.MAX_WORKING_TIME) -> Column:
    """Text between the first and the second occurrence of ``label:``, if short enough.

    The second occurrence ends the value because the text is split at every label.
    """
    parts = F.split(col(c), rf"(?iu){label}\s*:\s*")
    value = F.get(parts, F.lit(1))
    return F.when(F.length(value) < limit, F.regexp_replace(value, r"^[- ]+|[- ]+$", ""))


# ---- lists ------------------------------------------------------------------------------

def join_nonempty(c: str | Column, sep: str) -> Column:
    trimmed = F.transform(col(c), strip)
    return F.coalesce(F.array_join(F.filter(trimmed, lambda x: x != ""), sep), F.lit(""))


def encode_tags(c: str | Column) -> Column:
    """Ordered distinct tags as ``{a} {b}``; commas are dropped, blanks skipped."""
    cleaned = F.transform(col(c), lambda x: strip(F.replace(x, F.lit(","), F.lit(""))))
    kept = F.array_distinct(F.filter(cleaned, lambda x: x != ""))
    return F.coalesce(F.array_join(F.transform(kept, lambda x: F.concat(F.lit("{"), x, F.lit("}"))), " "), F.lit(""))


def decode_tags(c: str | Column) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"\{([^}]*)\}"), F.lit(1))


def pick_location(locations: str | Column, address: str | Column) -> Column:
    first = F.get(col(locations), F.lit(0))
    return F.coalesce(first_nonempty(first["cityName"], first["address"], address), F.lit(""))


def join_locations(places: str | Column) -> tuple[Column, Column]:
    """(distinct provinces in order, all addresses) of an array of places."""
    provinces = F.transform(col(places), lambda p: p["province_name"])
    provinces = F.array_sort(F.array_distinct(F.filter(provinces, lambda x: x != "")))
    addresses = F.filter(F.transform(col(places), lambda p: p["address"]), lambda x: x != "")
    short = F.coalesce(blank_to_null(F.array_join(provinces, ", ")), F.lit(R.NATIONWIDE))
    return short, F.coalesce(F.array_join(addresses, "\n"), F.lit(""))


# ---- stored pages -----------------------------------------------------------------------

ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def html_to_text(c: str | Column, sep: str = "\n") -> Column:
    """Text of an HTML fragment: every run between tags on its own line; null becomes ''."""
    t = F.coalesce(col(c), F.lit(""))
    t = F.regexp_replace(t, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "\n")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t\r\f\x{A0}]+", " ")
    t = F.regexp_replace(t, r" ?\n[ \n]*", "\n")
    t = F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")
    return t if sep == "\n" else F.replace(t, F.lit("\n"), F.lit(sep))


def canonical_url(url: str | Column, base: str | Column | None = None) -> Column:
    """Absolute URL without query and fragment.

    Relative paths are resolved against the scheme and host of ``base``.
    """
    u = F.regexp_replace(F.trim(col(url)), r"[?#].*$", "")
    if base is None:
        return u
    base = F.lit(base) if isinstance(base, str) and "://" in base else col(base)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://.*/)", 1)
    folder = F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), u)
        .when(F.startswith(u, F.lit("//")), F.concat(scheme, u))
        .when(F.startswith(u, F.lit("/")), F.concat(root, u))
        .when(u == "", F.regexp_replace(base, r"[?#].*$", ""))
        .otherwise(F.concat(folder, u))
    )


def unwrap_image_url(url: str | Column) -> Column:
    """Keep the URL from an address nested inside it; https is looked for before http."""
    u = col(url)
    https, http = F.locate("https://", u, 9), F.locate("http://", u, 8)
    return (
        F.when(https > 0, F.substr(u, https))
        .when(http > 0, F.substr(u, http))
        .otherwise(F.coalesce(u, F.lit("")))
    )
