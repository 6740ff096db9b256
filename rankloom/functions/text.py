"""Text functions: Column to Column. Those that look values up take tables as parameters, with the domain's as defaults.

Costly ones are meant for distinct values: ``operators.joins.over_dictionary`` applies a function to the distinct
values of a column and joins the results back."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables as t


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def safe_int(c: Column) -> Column:
    """An integer without thousands separators, or NULL."""
    return F.try_to_number(F.regexp_extract(F.replace(F.trim(c), F.lit(","), F.lit("")), r"^([+-]?\d{1,9})$", 1), F.lit("S999999999")).cast("int")


def clean_cell(c: Column) -> Column:
    """Trimmed, white space collapsed, empty to NULL."""
    return blank_to_null(collapsed(c))


def is_dash(c: Column) -> Column:
    """Empty or a placeholder."""
    return F.coalesce(F.trim(c).isin(t.DASHES), F.lit(True))


def lookup_map(table: dict[str, list[str]], key=lambda x: x) -> Column:
    pairs = {key(alias): code for code, aliases in table.items() for alias in aliases}
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def squashed(s: str) -> str:
    return s.replace("-", "").replace(".", "").replace(" ", "")


def norm_quota(c: Column, table: dict[str, list[str]] = t.QUOTA) -> Column:
    """The code of a quota, by alias, then by alias without dots, hyphens and spaces; else UNKNOWN."""
    key = F.upper(collapsed(c))
    plain = F.regexp_replace(key, "[-. ]", "")
    return F.coalesce(F.try_element_at(lookup_map(table), key), F.try_element_at(lookup_map(table, squashed), plain), F.lit("UNKNOWN"))


def norm_category(c: Column, table: dict[str, list[str]] = t.CATEGORY) -> Column:
    """The code of a category by alias in any case; else UNKNOWN."""
    return F.coalesce(F.try_element_at(lookup_map(table), F.upper(collapsed(c))), F.lit("UNKNOWN"))


def pincode_of(c: Column) -> Column:
    """The first six digits that stand alone."""
    return blank_to_null(F.regexp_extract(c, r"\b(\d{6})\b", 1))


def state_of(c: Column, states: list[str] = t.STATES) -> Column:
    """The longest state name in the text, as it is called now; else by the first postal code with a known prefix."""
    text = F.upper(c)
    named = [F.when(text.contains(s.upper()), F.lit(t.STATE_NOW.get(s, s))) for s in sorted(states, key=len, reverse=True)]
    by_pin = F.create_map(*[F.lit(x) for pair in t.PIN_PREFIX.items() for x in pair])
    pins = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\b(\d{6})\b"), 1), lambda p: F.coalesce(F.try_element_at(by_pin, F.substring(p, 1, 3)), F.try_element_at(by_pin, F.substring(p, 1, 2)))), lambda s: s.isNotNull())
    return F.coalesce(*named, F.get(pins, F.lit(0)))


def _state_names() -> list[str]:
    return sorted({s.upper() for s in t.STATES} | {s.upper() for s in t.STATE_NOW.values()})


def area_of(c: Column, name_words: Column) -> Column:
    """The first word of the first run of capitalised words of more than three letters, none generic, a state or in
    ``name_words`` (array, upper case), alone or with a plural S; runs that are a state's name don't count."""
    fixed = set(t.GENERIC) | set(_state_names())
    skip = F.array(*[F.lit(w) for w in sorted(fixed | {w + "S" for w in fixed if not w.endswith("S")})])
    plural = F.transform(F.filter(name_words, lambda w: ~w.endswith("S")), lambda w: F.concat(w, F.lit("S")))
    def mark(w):
        up = F.upper(w)
        good = w.rlike("^[A-Z]") & (F.length(w) > 3) & ~F.array_contains(skip, up) & ~F.array_contains(name_words, up) & ~F.array_contains(plural, up)
        return F.when(good, w).otherwise(F.lit("|"))
    marked = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(t.WORD), 1), mark), " ")
    runs = F.filter(F.transform(F.split(marked, r"\|"), lambda r: F.trim(r)), lambda r: (r != "") & ~F.upper(r).isin(_state_names()))
    return F.get(F.split(F.get(runs, F.lit(0)), " "), F.lit(0))


def city_of(c: Column) -> Column:
    """A short city or area label of a raw institute text; its postal code if nothing else is found."""
    def of(text):
        parts = F.transform(F.split(F.regexp_replace(text, r"\b\d{6}\b", ""), ","), lambda p: F.trim(p))
        def from_parts(parts):
            tidy = F.transform(F.slice(parts, 2, 6), lambda p: F.regexp_replace(p, "[.,;:]+$", ""))
            short = F.filter(tidy, lambda p: F.length(p).between(3, 35) & p.rlike(r"^\p{L}") & ~p.rlike(t.ADDRESS_START) & ~F.upper(p).isin(_state_names()))
            words = F.transform(F.filter(F.regexp_extract_all(F.get(parts, F.lit(0)), F.lit(t.WORD), 1), lambda w: F.length(w) > 3), lambda w: F.upper(w))
            areas = F.filter(F.transform(F.filter(F.slice(parts, 2, 8), lambda p: F.length(p) > 20), lambda p: area_of(p, words)), lambda a: a.isNotNull() & ~F.upper(a).isin(_state_names()))
            return F.coalesce(F.get(short, F.lit(0)), F.get(areas, F.lit(0)), pincode_of(text))
        return let(parts, from_parts)
    return let(F.regexp_replace(F.trim(c), t.MAIL, ""), of)


def clean_institute(c: Column) -> Column:
    """The name before the first comma, without mail, telephone and postal code; the whole if that is too short."""
    text = F.regexp_replace(F.trim(c), t.MAIL, "")
    text = F.regexp_replace(text, t.TELEPHONE, "")
    text = collapsed(F.regexp_replace(text, t.PIN, ""))
    def of(whole):
        first = F.get(F.filter(F.transform(F.split(whole, ","), lambda p: F.trim(p)), lambda p: p != ""), F.lit(0))
        name = F.regexp_replace(first, "[.,;:]+$", "")
        return F.when(first.isNull() | (F.length(name) <= 3), whole).otherwise(name)
    return F.when(blank_to_null(c).isNotNull(), let(text, of))


@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Compatibility-decomposed and without what isn't ASCII. Spark has no function for it; meant for distinct values."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def norm_course(c: Column, fold=ascii_fold) -> Column:
    """A course name in one form; '' if absent."""
    text = F.regexp_replace(F.upper(fold(c) if fold else c), t.BRACKETS, " ")
    for pattern, code in t.DEGREE_PATTERNS:
        text = F.regexp_replace(text, rf"\b{pattern}\b", code)
    text = F.regexp_replace(F.regexp_replace(text, t.SEPARATORS, " "), t.SIGNS, " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    for parts, whole in t.SPLIT_WORDS:
        text = F.regexp_replace(text, rf"\b{parts}\b", whole)
    return F.coalesce(text, F.lit(""))


def split_course(c: Column) -> Column:
    """struct(degree, specialty) of a normalised course."""
    pattern = rf"^({'|'.join(t.DEGREES)})(?: (.*))?$"
    degree = blank_to_null(F.regexp_extract(c, pattern, 1))
    rest = F.when(degree.isNull(), blank_to_null(c)).otherwise(blank_to_null(F.trim(F.regexp_extract(c, pattern, 2))))
    return F.struct(degree.alias("degree"), rest.alias("specialty"))


def course_type(c: Column, rules=t.COURSE_TYPES) -> Column:
    """The type of the first keyword rule that a course contains; Clinical if none does. A keyword of a later type may
    be part of a longer name whose earlier keyword wins, so order is kept."""
    text = F.upper(c)
    return F.coalesce(*[F.when(text.contains(k), F.lit(kind)) for kind, keys in rules for k in keys], F.lit("Clinical"))


def fingerprint(*cols: Column) -> Column:
    """40 hexadecimal digits of SHA-256 of the values joined by |; null and 0 count as empty."""
    parts = [F.coalesce(F.nullif(c.cast("string"), F.lit("0")) if c is not None else F.lit(""), F.lit("")) for c in cols]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 40)


def fold_norm(c: Column, fold=ascii_fold) -> Column:
    """Lower case, words only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold(c) if fold else c), r"[^\w\s]", " "), r"\s+", " "))


def strip_generic(c: Column, stop: list[str] = t.STOP_WORDS) -> Column:
    """Without stop words and one-letter tokens; if none is left, all."""
    kept = F.filter(F.split(c, " "), lambda w: ~w.isin(stop) & (F.length(w) > 1))
    return F.when(F.size(kept) == 0, c).otherwise(F.array_join(kept, " "))


def to_pin(c: Column) -> Column:
    """A number-like value as integer text; '' if it isn't one."""
    return F.coalesce(F.regexp_extract(F.trim(c.cast("string")), r"^(\d+)(?:\.0*)?$", 1), F.lit(""))


def display_name(name: Column, city: Column) -> Column:
    """Name, city; the name alone if it has the city already or there is none."""
    has = F.coalesce(F.lower(name).contains(F.lower(city)), F.lit(True)) | (F.coalesce(city, F.lit("")) == "")
    return F.when(has, name).otherwise(F.concat(name, F.lit(", "), city))


def dedup_segments(parts: Column) -> Column:
    """If an array begins with a block (of two or more) that is repeated at once, the smallest such block."""
    plain = F.transform(parts, lambda p: F.regexp_replace(F.lower(p), "[ -]", ""))
    def of(own):
        sizes = F.when(F.size(own) >= 4, F.sequence(F.lit(2), (F.size(own) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.get(F.filter(sizes, lambda k: F.slice(own, F.lit(1), k) == F.slice(own, k + 1, k)), F.lit(0))
    size = let(plain, of)
    return F.when(size.isNotNull(), F.slice(parts, F.lit(1), size)).otherwise(parts)


def clean_num(c: Column) -> Column:
    """A number without separators, currency sign and spaces; NULL for placeholders and what isn't one."""
    text = F.regexp_replace(c, "[,₹ ]", "")
    return F.when(~F.upper(F.trim(c)).isin("NA", "N/A", "-", "NIL", ""), text.try_cast("double"))


def is_numeric_text(c: Column) -> Column:
    """Digits, with separators and at most one point."""
    return F.coalesce(F.replace(c, F.lit(","), F.lit("")).rlike(r"^(\d+\.?\d*|\.\d+)$"), F.lit(False))


def fields_of(text: Column, patterns: dict[str, str]) -> Column:
    """Struct of the first group of each pattern, NULL where it has no match."""
    return F.struct(*[blank_to_null(F.trim(F.regexp_extract(text, p, 1))).alias(name) for name, p in patterns.items()])


#: Labelled fields of a profile page.
PROFILE = {
    "code": r"(?i)code\s*[:\-]\s*(\d+)",
    "college": r"(?i)(?:college|institute)\s*name\s*[:\-]\s*([^\n]+)",
    "university": r"(?i)university\s*[:\-]\s*([^\n]+)",
    "annual_fee": r"(?i)annual\s*fee\s*[:\-]\s*([^\n]+)",
    "stipend_yr1": r"(?is)stipend.*?1st\s*year\s*[:\-]\s*([\d,]+)",
    "bond_forfeit": r"(?is)bond.*?(?:penalty|forfeit)[^\n:]*[:\-]\s*([^\n]+)",
    "bond_years": r"(?is)bond.*?years?\s*[:\-]\s*([\d.]+)",
    "website": r"(?i)website\s*[:\-]\s*(\S+)",
}


def sqlite_real(c: Column) -> Column:
    """The number that a text begins with, 0.0 if it begins with none; NULL stays."""
    head = F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(c.isNotNull(), F.coalesce(head.try_cast("double"), F.lit(0.0)))


def state_by_patterns(name: Column, address: Column, patterns: dict[str, list[str]] = t.STATE_PATTERNS) -> Column:
    """The first state, in order, one of whose patterns occurs, in any case, in name and address."""
    text = F.concat_ws(" ", name, address)
    return F.coalesce(*[F.when(text.rlike("(?i)" + "|".join(p)), F.lit(state)) for state, p in patterns.items()])


def safe_str(c: Column) -> Column:
    """NULL for missing text, which '' and 'nan' are too; 0 stays."""
    return F.nullif(blank_to_null(F.trim(c.cast("string"))), F.lit("nan"))


def is_missing(c: Column) -> Column:
    """NULL, '' or 'nan'."""
    return F.nullif(blank_to_null(c), F.lit("nan")).isNull()


def city_from_address(name: Column, address: Column) -> Column:
    """From the right, the first comma part that isn't a postal code, a state or too long; of a road, its last word."""
    def of(whole):
        parts = F.reverse(F.transform(F.split(whole, ","), lambda p: F.trim(F.regexp_replace(p, r"\b\d{6}\b", ""))))
        good = F.filter(parts, lambda p: F.length(p).between(1, 40) & ~F.upper(p).isin(_state_names()) & p.rlike(r"\p{L}"))
        def tidy(p):
            return F.when(p.rlike(r"(?i)\b(road|street|marg|lane|nagar)\b"), F.element_at(F.split(p, r"\s+"), -1)).otherwise(p)
        return F.get(F.transform(good, tidy), F.lit(0))
    stripped = F.when(F.lower(address).startswith(F.lower(name)), F.substring(address, F.length(name) + 1, F.length(address))).otherwise(address)
    return F.coalesce(let(stripped, of), let(address, of))


def clean_address(name: Column, raw: Column) -> Column:
    """Without the name in front, states, postal codes, short codes, dots and repeated blocks."""
    stripped = F.when(F.lower(raw).startswith(F.lower(name)), F.substring(raw, F.length(name) + 1, F.length(raw))).otherwise(raw)
    parts = F.transform(F.split(stripped, ","), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"\b\d{6}\b", ""), r"[.\s-]+$", "")))
    good = F.filter(parts, lambda p: (p != "") & ~F.upper(p).isin(_state_names()) & ~p.rlike("^[A-Z]{1,3}$"))
    return blank_to_null(F.array_join(dedup_segments(good), ", "))
