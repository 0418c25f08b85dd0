"""Text, identifier, code and weekday functions as Column expressions; none is a UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sidetrace import vocab

# Texts that stand for no identifier.
_NOTHING = ("", "0", "0.0", "NONE", "NULL", "NAN", "<NA>")


def clean_text(v: Column) -> Column:
    """Null to empty, runs of any Unicode white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(v.cast("string"), F.lit("")), r"(?U)\s+", " "))


def source_code(v: Column) -> Column:
    """Upper-cased clean text; a whole number that came as a double loses its fraction."""
    return F.upper(F.regexp_replace(clean_text(v), r"^(-?[0-9]+)\.0$", "$1"))


def clean_identifier(v: Column) -> Column:
    """Trimmed, case kept; a whole number that came as a double loses its fraction; null to empty."""
    return F.regexp_replace(F.trim(F.coalesce(v.cast("string"), F.lit(""))), r"^(-?[0-9]+)\.0$", "$1")


def optional_text(v: Column) -> Column:
    return F.nullif(F.trim(v), F.lit(""))


def first_present(*vs: Column) -> Column:
    """The first value that is neither null nor blank, as it came."""
    return F.coalesce(*(F.when(F.trim(v.cast("string")) != "", v) for v in vs))


def is_non_addressable(v: Column) -> Column:
    """Missing, one of the texts for nothing, or any number that equals 0."""
    t = F.upper(F.trim(v.cast("string")))
    return v.isNull() | t.isin(*_NOTHING) | F.coalesce(t.try_cast("double") == 0, F.lit(False))


def usable_address(v: Column) -> Column:
    """Whether the digits of v are there and not all zero."""
    return F.coalesce(F.regexp_replace(v.cast("string"), r"\D", "").rlike("[1-9]"), F.lit(False))


def usable_range(*vs: Column) -> Column:
    return reduce(lambda a, b: a | b, (usable_address(v) for v in vs))


def borough_name(v: Column) -> Column:
    """Name of a borough code given as text or number, truncated; null if it is none."""
    text = F.trim(v.cast("string"))
    code = F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), text.try_cast("double")).try_cast("int")
    return F.create_map(*(F.lit(x) for kv in vocab.BOROUGHS.items() for x in kv))[code]


def day_tokens(v: Column) -> Column:
    return F.transform(F.split(v, "[,/;]"), lambda t: F.upper(F.trim(t)))


def days(v: Column) -> Column:
    """Weekdays of a schedule text in calendar order; null if it is null, blank or holds an empty or unknown token."""
    names = F.create_map(*(F.lit(x) for kv in vocab.DAY_NAMES.items() for x in kv))
    found = F.transform(day_tokens(v), lambda t: F.try_element_at(names, t))
    order = F.array(*(F.lit(d) for d in vocab.DAYS))
    kept = F.filter(order, lambda d: F.array_contains(found, d))
    return F.when((F.trim(v) != "") & ~F.exists(found, lambda d: d.isNull()), kept)


def day_error(v: Column) -> Column:
    """Why a schedule text is no schedule, or null."""
    tokens = day_tokens(v)
    known = F.array(*(F.lit(d) for d in vocab.DAY_NAMES))
    unknown = F.array_sort(F.array_distinct(F.filter(tokens, lambda t: ~F.array_contains(known, t))))
    return (
        F.when(v.isNull() | (F.trim(v) == ""), "missing explicit schedule")
        .when(F.array_contains(tokens, ""), "invalid empty weekday token")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown weekday token(s) "), F.array_join(unknown, ", ")))
    )


def schedule_state(kind: str, raw: Column, recycling: Column | None = None) -> Column:
    """STRUCT(days, state, rule_id, source_policy_conflict, error) of a type's schedule text.

    Blank organics beside explicit recycling take its days by policy; both explicit and different are flagged.
    """
    blank = raw.isNull() | (F.trim(raw) == "")
    own = days(raw)
    none = F.array().cast("array<string>")
    state = F.when(own.isNotNull(), F.lit(vocab.EXPLICIT)).otherwise(F.lit(vocab.BLANK))
    error = F.when(~blank | F.lit(kind == "REFUSE"), day_error(raw))
    if kind != "ORGANICS" or recycling is None:
        return F.struct(F.coalesce(own, none).alias("days"), state.alias("state"), F.lit(None).cast("string").alias("rule_id"), F.lit(False).alias("source_policy_conflict"), error.alias("error"))
    other = days(recycling)
    derived = own.isNull() & other.isNotNull()
    return F.struct(
        F.coalesce(own, other, none).alias("days"), F.when(derived, F.lit(vocab.DERIVED)).otherwise(state).alias("state"),
        F.when(derived, F.lit(vocab.ORGANICS_RULE)).alias("rule_id"), F.coalesce((own.isNotNull() & other.isNotNull() & (own != other)), F.lit(False)).alias("source_policy_conflict"), error.alias("error"),
    )


def signature(states: dict[str, Column]) -> Column:
    """Canonical text of all types' days, states, rules and flags: equal schedules of equal evidence are equal texts."""
    parts = [F.concat_ws("|", F.lit(t), F.array_join(s["days"], ","), s["state"], F.coalesce(s["rule_id"], F.lit("")), s["source_policy_conflict"].cast("string")) for t, s in states.items()]
    return F.concat_ws(";", *parts)


def split_key(origin: Column, borough: Column, sign: Column) -> Column:
    """Key of one part of a split feature: its origin and 16 hex digits over borough and signature."""
    return F.concat(origin, F.lit("~"), F.substring(F.sha2(F.concat_ws("\n", F.coalesce(borough, F.lit("")), sign), 256), 1, 16))


def is_version(v: Column) -> Column:
    return v.rlike(vocab.VERSION_PATTERN)


def unique_match(v: Column, pattern: str) -> Column:
    """The one distinct match of a pattern in a text, or null if there are none or several."""
    found = F.array_distinct(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)))
    return F.when(F.size(found) == 1, found[0])


def parse_wkt(v: Column) -> Column:
    """ARRAY of lines, each an array of (x, y), from LINESTRING or MULTILINESTRING text; lines that are broken are left out, null if none is left."""
    number = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
    texts = F.regexp_extract_all(F.when(v.rlike(r"^\s*(MULTI)?LINESTRING\s*\("), v), F.lit(r"\(([^()]*)\)"), F.lit(1))
    pairs = F.transform(texts, lambda t: F.transform(F.split(F.trim(t), r"\s*,\s*"), lambda p: F.when(p.rlike(f"^{number}\\s+{number}$"), F.struct(F.split(p, r"\s+")[0].try_cast("double").alias("x"), F.split(p, r"\s+")[1].try_cast("double").alias("y")))))
    good = F.filter(pairs, lambda line: (F.size(line) >= 2) & ~F.exists(line, lambda p: p.isNull()))
    return F.when(F.size(good) > 0, good)


def to_wkt(lines: Column) -> Column:
    """WKT of an array of lines; one line is a LINESTRING."""
    body = F.transform(lines, lambda line: F.concat(F.lit("("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ","), F.lit(")")))
    return F.when(F.size(lines) == 1, F.concat(F.lit("LINESTRING "), body[0])).when(F.size(lines) > 1, F.concat(F.lit("MULTILINESTRING ("), F.array_join(body, ","), F.lit(")")))


def json_whole(v: Column, name: str) -> Column:
    """A property of a JSON object if it is a whole number, else null."""
    found = F.get_json_object(v, f"$.{name}")
    return F.when(found.rlike("^-?[0-9]+$"), found.try_cast("long"))


def json_has(v: Column, name: str) -> Column:
    """Whether a JSON object has a property that isn't null."""
    return F.get_json_object(v, f"$.{name}").isNotNull()


def format_bytes(v: Column) -> Column:
    """A size for people: whole bytes, else one decimal of KB, MB, GB or TB of 1024."""
    out = F.concat(v.cast("long").cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(v >= float(1024**power), F.format_string(f"%.1f {unit}", v / float(1024**power))).otherwise(out)
    return out


def html_escape(v: Column) -> Column:
    return reduce(lambda t, ab: F.replace(t, F.lit(ab[0]), F.lit(ab[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")), v)
