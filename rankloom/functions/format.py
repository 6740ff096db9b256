"""Keys and labels: group ids, row keys, money, ranks and places as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, sqlite_real

#: Fields of a group id in the order of their JSON keys, and the fields of a row key.
GROUP_FIELDS = {
    "a": "allotted_category_norm", "c": "course_norm", "cs": "counselling_state", "ct": "counselling_type", "i": "institute_name",
    "ip": "institute_pincode", "q": "quota_norm", "r": "round", "y": "year",
}
ROW_FIELDS = ["year", "counselling_type", "counselling_state", "institute_name", "institute_pincode", "course_norm", "quota_norm", "allotted_category_norm"]


def encode_group_id(cols: dict[str, Column], round_no: int, count: Column) -> Column:
    """URL-safe base64 of the group's key as compact JSON; NULL where the round has no rows."""
    text = lambda f: F.lit(str(round_no)) if f == "round" else F.coalesce(cols[f].cast("string"), F.lit(""))
    raw = F.to_json(F.struct(*[text(f).alias(k) for k, f in GROUP_FIELDS.items()]))
    return F.when(count > 0, F.translate(F.regexp_replace(F.base64(F.encode(raw, "UTF-8")), r"[\r\n=]", ""), "+/", "-_"))


def decode_group_id(c: Column) -> Column:
    """The key of a group id as a struct of strings; NULL if it is malformed."""
    plain = F.translate(c, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    valid = plain.rlike("^[A-Za-z0-9+/]+$") & (F.length(plain) % 4 != 1)
    raw = F.when(valid, F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))
    key = F.from_json(raw, ", ".join(f"`{k}` string" for k in GROUP_FIELDS))
    return F.when(key["i"].isNotNull(), key)


def row_key(*cols: Column) -> Column:
    """The fields of a row joined by |, null as empty."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (cols or [F.col(f) for f in ROW_FIELDS])])


def shown_name(*cols: Column) -> Column:
    """P5: the first name that isn't missing, or a dash."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit("—"))


def format_inr(c: Column) -> Column:
    """Rupees with groups of two digits before the last three; a dash for what isn't a number."""
    digits = F.round(F.when(c.rlike(r"^\s*[+-]?[\d.]"), sqlite_real(c))).cast("long").cast("string")
    return F.coalesce(F.concat(F.lit("₹"), F.regexp_replace(digits, r"(?<=\d)(?=(\d{2})*\d{3}$)", ",")), F.lit("—"))


def format_lakh(c: Column) -> Column:
    """In units of 100,000, with one decimal; halves round up."""
    return F.format_string("₹%.1fL", c.cast("double") / 100000)


def rank_label(rank: Column, count: Column) -> Column:
    """Rank (count), or a dash."""
    return F.when(count > 0, F.concat(rank.cast("string"), F.lit("("), count.cast("string"), F.lit(")"))).otherwise(F.lit("—"))


def dataset_key(year: Column, kind: Column, state: Column, round_no: Column) -> Column:
    """P10."""
    return F.concat_ws("|", year.cast("string"), kind, F.coalesce(blank_to_null(state), F.lit("AIQ")), round_no.cast("string"))


def invalid_dims(year: Column, kind: Column, state: Column, round_no: Column) -> Column:
    """Why a row's dataset fields are invalid, or NULL."""
    return (
        F.when(~F.coalesce(year > 2000, F.lit(False)), F.lit("year"))
        .when(~F.coalesce(kind.isin("AIQ", "STATE"), F.lit(False)), F.lit("type"))
        .when(~F.coalesce(round_no >= 1, F.lit(False)), F.lit("round"))
        .when((kind == "STATE") & blank_to_null(state).isNull(), F.lit("state"))
    )


def location_label(city: Column, pincode: Column) -> Column:
    """City and postal code, what there is of them."""
    return F.concat_ws(" ", blank_to_null(city), blank_to_null(pincode))
