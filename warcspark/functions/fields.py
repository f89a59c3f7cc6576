"""Header fields as an ordered multimap: ARRAY<STRUCT<name, value>>, all inside Catalyst.

Names are matched without case; a missing field is null, an empty one is ''.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FIELD_RULES, FIELDS, RECORD_TYPES
from . import let, lookup

_KNOWN = {k.lower(): k for k in FIELD_RULES}
#: Names that HTTP allows; only these are respelled.
_TOKEN = r"[A-Za-z0-9!#$%&'*+.^_`|~-]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def canonical_key(name: Column | str) -> Column:
    """HTTP spelling: each part between hyphens capitalised. Names with blanks or other odd characters stay."""
    n = _c(name)
    parts = F.transform(F.split(n, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30))))
    return F.when(n.rlike(rf"\A{_TOKEN}\z"), F.array_join(parts, "-")).otherwise(n)


def normalize_name(name: Column | str) -> Column:
    """The standard's spelling of known fields, HTTP spelling of all others."""
    n = _c(name)
    return F.coalesce(lookup(_KNOWN, F.lower(n)), canonical_key(n))


def normalize_constant(name: str) -> str:
    """The same for a name that is known now."""
    if known := _KNOWN.get(name.lower()):
        return known
    return "-".join(p[:1].upper() + p[1:].lower() for p in name.split("-")) if re.fullmatch(_TOKEN, name) else name


def field(name: str | Column, value: Column | str) -> Column:
    return F.struct(_lit(normalize_constant(name) if isinstance(name, str) else normalize_name(name)).alias("name"), _lit(value).cast("string").alias("value"))


def fields(pairs: list[tuple[str, Column | str]]) -> Column:
    """Headers of the given fields in order; fields with a null value are left out."""
    return F.filter(F.array(*[field(n, v) for n, v in pairs]), lambda h: h["value"].isNotNull()) if pairs else F.array().cast(FIELDS)


def _is(name: str) -> callable:
    low = normalize_constant(name).lower()
    return lambda h: F.lower(h["name"]) == low


def get(headers: Column | str, name: str) -> Column:
    """The first value, null if missing."""
    return F.get(F.filter(_c(headers), _is(name)), F.lit(0))["value"]


def get_all(headers: Column | str, name: str) -> Column:
    return F.transform(F.filter(_c(headers), _is(name)), lambda h: h["value"])


def has(headers: Column | str, name: str) -> Column:
    return F.exists(_c(headers), _is(name))


def as_int(value: Column | str, kind: str = "int") -> Column:
    """Base-10 number without blanks; null if it is none or doesn't fit."""
    v = _c(value)
    return F.when(v.rlike(r"^[+-]?[0-9]+$"), v.try_cast(kind))


def get_int(headers: Column | str, name: str) -> Column:
    return as_int(get(headers, name), "int")


def get_int64(headers: Column | str, name: str) -> Column:
    return as_int(get(headers, name), "long")


RFC3339 = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.,][0-9]+)?(Z|[+-]([01][0-9]|2[0-4]):[0-5][0-9])$"


def as_time(value: Column | str) -> Column:
    """RFC 3339 time; null otherwise. Spark keeps microseconds: finer digits stay in the text only."""
    v = _c(value)
    return F.when(v.rlike(RFC3339), F.try_to_timestamp(F.regexp_replace(F.translate(v, ",", "."), r"(\.[0-9]{6})[0-9]+", "$1")))


def get_time(headers: Column | str, name: str) -> Column:
    return as_time(get(headers, name))


def bare_id(value: Column | str) -> Column:
    """Without the angle brackets at either end."""
    return F.regexp_replace(_c(value), "^[<>]++|(?<![<>])[<>]++$", "")


def get_id(headers: Column | str, name: str) -> Column:
    return bare_id(get(headers, name))


def bracketed(value: Column | str) -> Column:
    """In angle brackets, unless a bracket stands at either end."""
    v = _lit(value)
    return F.when(v.startswith("<") | v.endswith(">"), v).otherwise(F.concat(F.lit("<"), v, F.lit(">")))


def rfc3339(time: Column | str) -> Column:
    """UTC to the second."""
    return F.date_format(F.to_utc_timestamp(_c(time), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rfc3339_fraction(time: Column | str) -> Column:
    """UTC with the fraction's significant digits."""
    text = F.date_format(F.to_utc_timestamp(_c(time), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), F.lit("Z"))


def rfc3339_nano(nanos: Column | str) -> Column:
    """UTC with up to nine significant digits of the fraction, from nanoseconds since 1970, which timestamps don't keep."""
    second = F.lit(1_000_000_000).cast("long")

    def text(n: Column) -> Column:
        rest = F.pmod(n, second)
        whole = F.timestamp_seconds(F.call_function("div", n - rest, second))
        digits = F.regexp_replace(F.lpad(rest.cast("string"), 9, "0"), "0+$", "")
        return F.concat(F.regexp_replace(rfc3339(whole), "Z$", ""), F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(""), F.lit("Z"))

    return let(_c(nanos).cast("long"), text)


def nanos_of(value: Column | str) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 time, digits beyond the ninth left out; null where it is none."""
    v = F.translate(_c(value), ",", ".")
    digits = F.rpad(F.substring(F.regexp_extract(v, r"\.([0-9]+)", 1), 1, 9), 9, "0")
    return F.when(as_time(v).isNotNull(), F.unix_seconds(F.date_trunc("second", as_time(v))) * F.lit(1_000_000_000).cast("long") + digits.cast("long"))


def add(headers: Column | str, name: str, value: Column | str) -> Column:
    return F.array_append(_c(headers), field(name, value))


def add_int(headers: Column | str, name: str, value: Column) -> Column:
    return add(headers, name, value.cast("string"))


def add_time(headers: Column | str, name: str, time: Column, *, fraction: bool = False) -> Column:
    return add(headers, name, rfc3339_fraction(time) if fraction else rfc3339(time))


def add_time_nano(headers: Column | str, name: str, nanos: Column | str) -> Column:
    return add(headers, name, rfc3339_nano(nanos))


def add_id(headers: Column | str, name: str, value: Column | str) -> Column:
    """Appends the bracketed id; an empty id changes nothing."""
    v = _lit(value)
    return F.when(F.coalesce(v, F.lit("")) == "", _c(headers)).otherwise(add(headers, name, bracketed(v)))


def set_(headers: Column | str, name: str, value: Column | str) -> Column:
    """Puts the value into the first such field and drops later ones; appends where there is none."""
    new, same = field(name, value), _is(name)

    def put(p: Column) -> Column:
        kept = F.filter(F.transform(p["h"], lambda x, i: F.when(i + 1 == p["at"], new).when(~same(x), x)), lambda x: x.isNotNull())
        return F.when(p["at"] > 0, kept).otherwise(F.array_append(p["h"], new))

    def find(h: Column) -> Column:
        return F.struct(h.alias("h"), F.array_position(F.transform(h, same), F.lit(True)).alias("at"))

    return let(let(_c(headers), find), put)


def set_many(headers: Column | str, changes: list[tuple[str, Column]], *, keep_missing: bool = True) -> Column:
    """set_ for several fields at once, in one pass: what is there gets its value, the others follow in order.
    A null value leaves its field alone, or removes it unless keep_missing."""
    low = [normalize_constant(n).lower() for n, _ in changes]
    table = F.struct(_c(headers).alias("h"), *[v.cast("string").alias(f"v{i}") for i, (_, v) in enumerate(changes)])

    def put(t: Column) -> Column:
        h = t["h"]
        names = F.transform(h, lambda x: F.lower(x["name"]))

        def each(x: Column, i: Column) -> Column:
            name = F.lower(x["name"])
            out = F.when(~name.isin(low), x)
            for k, n in enumerate(low):
                first = F.when(F.array_position(names, n) == i + 1, field(changes[k][0], t[f"v{k}"]))
                out = out.when(name == n, F.when(t[f"v{k}"].isNotNull(), first).otherwise(x if keep_missing else F.lit(None)))
            return out

        more = [F.when(t[f"v{k}"].isNotNull() & ~F.array_contains(names, n), field(changes[k][0], t[f"v{k}"])) for k, n in enumerate(low)]
        return F.filter(F.concat(F.transform(h, each), F.array(*more)), lambda x: x.isNotNull())

    return let(table, put)


def set_int(headers: Column | str, name: str, value: Column) -> Column:
    return set_(headers, name, value.cast("string"))


def set_time(headers: Column | str, name: str, time: Column) -> Column:
    return set_(headers, name, rfc3339(time))


def set_id(headers: Column | str, name: str, value: Column | str) -> Column:
    v = _lit(value)
    return F.when(F.coalesce(v, F.lit("")) == "", _c(headers)).otherwise(set_(headers, name, bracketed(v)))


def delete(headers: Column | str, *names: str) -> Column:
    low = [normalize_constant(n).lower() for n in names]
    return F.filter(_c(headers), lambda h: ~F.lower(h["name"]).isin(low))


def sort(headers: Column | str) -> Column:
    """By name; fields of a name stay in order."""
    numbered = F.transform(_c(headers), lambda h, i: F.struct(h["name"].alias("name"), i.alias("i"), h["value"].alias("value")))
    return F.transform(F.array_sort(numbered), lambda h: F.struct(h["name"].alias("name"), h["value"].alias("value")))


def serialize(headers: Column | str) -> Column:
    """`Name: value` lines with CRLF, as text."""
    return F.array_join(F.transform(_c(headers), lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n"))), "")


def to_json(headers: Column | str) -> Column:
    """A JSON object of the fields: each name with the array of its values, names in order of first appearance."""

    def entry(h: Column) -> Column:
        names = F.array_distinct(F.transform(h, lambda x: x["name"]))
        return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("name"), F.transform(F.filter(h, lambda x: x["name"] == n), lambda x: x["value"]).alias("values"))))

    return F.to_json(let(_c(headers), entry))


def from_json(text: Column | str) -> Column:
    """Headers of such an object."""
    pairs = F.map_entries(F.from_json(_c(text), "map<string,array<string>>"))
    return F.flatten(F.transform(pairs, lambda e: F.transform(e["value"], lambda v: F.struct(normalize_name(e["key"]).alias("name"), v.alias("value")))))


def type_code(name: Column | str) -> Column:
    """Bit code of a record type's name; 0 if unknown or missing."""
    return F.coalesce(lookup(RECORD_TYPES, F.lower(_c(name))), F.lit(0))


def type_name(code: Column | str) -> Column:
    return lookup({v: k for k, v in RECORD_TYPES.items()}, _c(code).cast("int"))


#: Charsets of encoded words, by their names in the engine; words in others stay as they are.
_CHARSETS = {"utf-8": "UTF-8", "iso-8859-1": "ISO-8859-1", "us-ascii": "US-ASCII"}
_WORD = r"=\?(?i:utf-8|iso-8859-1|us-ascii)\?(?:[bB]\?[A-Za-z0-9+/]*={0,2}|[qQ]\?[^?\s]*)\?="


def decode_words(text: Column | str) -> Column:
    """The text with RFC 2047 encoded words decoded; white space between two of them goes."""
    t = _c(text)

    def bytes_of(q: Column) -> Column:
        each = F.transform(F.regexp_extract_all(q, F.lit(r"(?s)=[0-9A-Fa-f]{2}|."), F.lit(0)), lambda x: F.when(x.rlike("^=..$"), F.substring(x, 2, 2)).when(x == "_", "20").otherwise(F.hex(F.encode(x, "UTF-8"))))
        return F.unhex(F.array_join(each, ""))

    def decoded(part: Column) -> Column:
        p = F.split(part, r"\?")
        data = F.when(F.lower(p[2]) == "b", F.try_to_binary(p[3], F.lit("base64"))).otherwise(bytes_of(p[3]))
        as_text = None
        for name, engine in _CHARSETS.items():
            is_it = F.lower(p[1]) == name
            value = F.decode(data, engine) if engine != "UTF-8" else F.try_validate_utf8(data.cast("string"))
            as_text = F.when(is_it, value) if as_text is None else as_text.when(is_it, value)
        return F.coalesce(as_text, part)

    parts = F.regexp_extract_all(F.regexp_replace(t, rf"({_WORD})\s+(?={_WORD})", "$1"), F.lit(rf"(?s){_WORD}|(?:(?!{_WORD}).)++"), F.lit(0))
    return F.when(t.rlike(_WORD), F.array_join(F.transform(parts, lambda x: F.when(x.rlike(rf"\A{_WORD}\z"), decoded(x)).otherwise(x)), "")).otherwise(t)


def parse_lenient(text: Column | str, *, words: bool = False) -> Column:
    """Header fields of a text of lines, without findings: folded lines joined by a blank, names normalised,
    lines without a colon left out, up to the first empty line; with `words`, encoded words are decoded."""
    head = F.regexp_extract(F.concat(_c(text), F.lit("\n")), r"^((?:[^\n]*[^\s][^\n]*\n)*+)", 1)
    folded = F.regexp_replace(head, r"(?<![ \t\r])[ \t\r]*+\n[ \t]+", " ")
    lines = F.split(folded, "\n")
    lines = F.filter(F.transform(lines, decode_words) if words else lines, lambda x: F.instr(x, ":") > 0)
    return F.transform(lines, lambda x: F.struct(normalize_name(F.trim(F.regexp_extract(x, r"^[ \t\r]*+((?:[^:]*[^: \t\r])?)[ \t\r]*+:", 1))).alias("name"), F.regexp_extract(x, r"(?s)^[^:]*+:[ \t\r]*+((?:.*[^ \t\r])?)[ \t\r]*+$", 1).alias("value")))
