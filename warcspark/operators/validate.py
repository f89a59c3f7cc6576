"""Header, length and digest findings of a record, and what repairs do about them; all in Catalyst.

Everything here is a projection: no shuffle, and hashes only where a digest is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digest as D
from ..functions import fields as H
from ..functions import let, lookup
from ..options import FAIL, IGNORE, WARN, WarcOptions
from ..schema import FIELD_RULES, FINDING, FINDINGS, REPEATABLE, REQUIRED, WHOLE


def finding(category: str, msg: Column | str, *, kind: str | None = None, field: Column | str | None = None, expected: Column | None = None, actual: Column | None = None) -> Column:
    def text(x: Column | str | None) -> Column:
        return (x if isinstance(x, Column) else F.lit(x)).cast("string")

    return F.struct(F.lit(category).alias("category"), F.lit(kind or category).alias("kind"), text(field).alias("field"), F.lit(None).cast("int").alias("line"), text(msg).alias("msg"), text(expected).alias("expected"), text(actual).alias("actual"))


def _some(*items: Column) -> Column:
    """The non-null ones of findings."""
    return F.filter(F.array(*[i.cast(FINDING) for i in items]), lambda x: x.isNotNull())


#: Decimal, 0x, 0o, 0b and old-style octal, underscores between digits. Here as below, groups repeat possessively: the
#: engine goes through other ones by calling itself, and values of some thousand letters end its stack.
LONG = r"^[+-]?(?:0[xX](?:_?[0-9A-Fa-f])++|0[bB](?:_?[01])++|0[oO]?(?:_?[0-7])*+|[1-9](?:_?[0-9])*+)$"
IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


#: Groups of hex digits with at most one gap, and an IPv4 address in place of the last two.
_H16 = "[0-9A-Fa-f]{1,4}"
_V4 = IPV4[1:-1]
IPV6 = "^(?:" + "|".join(
    [f"(?:{_H16}:){{7}}{_H16}", f"(?:{_H16}:){{6}}{_V4}"]
    + [f"(?:{_H16}(?::{_H16}){{0,{n - 1}}})?::(?:{_H16}(?::{_H16}){{0,{6 - n}}})?" if n else f"::(?:{_H16}(?::{_H16}){{0,6}})?" for n in range(0, 7)]
    + [f"(?:{_H16}:){{1,7}}:"]
    + [f"(?:{_H16}(?::{_H16}){{0,{n - 1}}})?::(?:{_H16}:){{0,{5 - n}}}{_V4}" if n else f"::(?:{_H16}:){{0,5}}{_V4}" for n in range(0, 6)]
) + ")$"


def _at_most(most: int) -> str:
    """Pattern of the decimal numbers up to `most`, without leading zeros."""
    digits, out = str(most), ["0"]
    if len(digits) > 1:
        out.append(f"[1-9][0-9]{{0,{len(digits) - 2}}}")
    for k, d in enumerate(digits):
        low = "1" if k == 0 else "0"
        if d > low:
            out.append(f"{digits[:k]}[{low}-{int(d) - 1}][0-9]{{{len(digits) - 1 - k}}}")
    return f"(?:{'|'.join([*out, digits])})"


def _v4_part(octal: str, size: int) -> str:
    """A part of an IPv4 address that has `size` bytes: hexadecimal, octal after 0, or decimal."""
    return f"(?:0[xX]0*[0-9A-Fa-f]{{0,{2 * size}}}|0+{octal}|{_at_most(256**size - 1)})"


def _url() -> str:
    """What the URL Standard's parser takes, without blanks at the ends, tabs and line ends."""
    byte, two, three, four = (_v4_part(o, k) for k, o in enumerate(("(?:[0-3]?[0-7]{1,2})?", "(?:1?[0-7]{1,5})?", "(?:[0-7]{1,8})?", "(?:[0-3]?[0-7]{1,10})?"), 1))
    v4 = rf"(?:{byte}\.{byte}\.{byte}\.{byte}|{byte}\.{byte}\.{two}|{byte}\.{three}|{four})\.?"
    v6 = rf"\[{IPV6[1:-1]}\]"
    # no control character, blank or delimiter, as it stands or after a percent sign
    letter = r"(?:[^\x00-\x20\x22#%/:<>?@\[\\\]^`{|}\x7F]|%(?!(?i:[01][0-9A-F]|20|22|23|25|2F|3A|3C|3E|3F|40|5B|5C|5D|5E|60|7B|7C|7D|7F))[0-9A-Fa-f]{2})"
    numeric = r"(?:[^/\\?#:@]*\.)?(?:[0-9]+|0[xX][0-9A-Fa-f]*)\.?(?:[:/\\?#]|\z)"
    domain = rf"(?:{v6}|(?!{numeric}){letter}++|{v4})"
    opaque = rf"(?:{v6}|[^\x00\t\n\r #/:<>?@\[\\\]^|]+)"
    port = f"(?::(?:0*{_at_most(65535)})?)?"
    special, scheme = "(?i:https?|wss?|ftp)", r"[A-Za-z][A-Za-z0-9+.\-]*"
    hosted = rf"{special}:[/\\]*+(?:[^/\\?#]*@)?{domain}{port}(?:[/\\?#].*)?"
    file = rf"(?i:file):(?:[/\\]{{2}}(?:[A-Za-z][:|]|{domain})?(?:[/\\?#].*)?|(?![/\\]{{2}}).*)"
    other = rf"(?!(?:{special}|(?i:file)):){scheme}:(?://(?:(?:[^/?#]*@)?{opaque}{port})?(?:[/?#].*)?|(?!//).*)"
    return rf"(?s)\A(?:{hosted}|{file}|{other})\z"


URL = _url()


def is_ip(value: Column) -> Column:
    return value.rlike(IPV4) | value.rlike(IPV6)


def is_uri(value: Column) -> Column:
    """Whether the URL Standard's parser accepts the value as an absolute URL. Blanks at either end, tabs and line
    ends are dropped, other odd characters in paths are allowed; of a domain's letters only the ASCII ones are looked at."""
    return F.regexp_replace(value, r"\A[\x00-\x20]++|(?<![\x00-\x20])[\x00-\x20]++\z|[\t\n\r]", "").rlike(URL)


def is_bracketed(value: Column) -> Column:
    """One angle bracket at either end, as WARC ids have."""
    return F.length(value) == F.length(H.bare_id(value)) + 2


def is_id(value: Column) -> Column:
    return is_bracketed(value) & is_uri(H.bare_id(value))


def is_int(value: Column) -> Column:
    return value.rlike(r"^[+-]?[0-9]+$") & value.try_cast("long").isNotNull()


#: Numbers of 64 bits without underscores, in bases 16, 8 and 2: those below 2**63, and -2**63.
_FITS = r"^[+-]?0(?:[xX]0*(?:[0-9A-Fa-f]{0,15}|[0-7][0-9A-Fa-f]{15})|[oO]?0*[0-7]{0,21}|[bB]0*[01]{0,63})$|^-0(?:[xX]0*80{15}|[oO]?0*10{21}|[bB]0*10{63})$"


def is_long(value: Column) -> Column:
    """A whole number of 64 bits in any of the notations of LONG."""
    bare = F.translate(value, "_", "")
    return value.rlike(LONG) & (bare.rlike(_FITS) | (bare.rlike("^[+-]?[1-9]") & bare.try_cast("long").isNotNull()))


def is_time(value: Column) -> Column:
    return H.as_time(value).isNotNull()


def resolve_type(headers: Column | str, options: WarcOptions) -> tuple[Column, Column]:
    """Bit code of the record's type, and its findings."""
    value = F.coalesce(H.get(headers, "WARC-Type"), F.lit(""))

    def found(v: Column) -> Column:
        missing = F.when(v == "", finding("spec", "no record type is given", kind="missing", field="WARC-Type"))
        unknown = F.when(H.type_code(v) == 0, finding("type", F.concat(F.lit("no record type is called '"), v, F.lit("'")), kind="unknown_type", field="WARC-Type"))
        return _some(missing, unknown)

    return H.type_code(value), let(value, found)


def field_problem(name: Column, value: Column, code: Column, version_bit: Column) -> Column:
    """What is wrong with one field's legality or value, as a message; null if nothing."""
    low = F.lower(name)
    masks, specs, checks = ({k.lower(): v[i] for k, v in FIELD_RULES.items()} for i in (1, 2, 0))
    active = (code != 0) & (F.coalesce(lookup(specs, low), F.lit(0)).bitwiseAND(version_bit) != 0)
    illegal = lookup(masks, low).bitwiseAND(code) == 0

    def bad(kind: Column) -> Column:
        return _bad_value(kind, value)

    return F.when(active, F.when(illegal, F.concat(F.lit("records of type "), H.type_name(code), F.lit(" don't have a field "), name)).otherwise(let(lookup(checks, low), bad)))


def _bad_value(kind: Column, value: Column) -> Column:
    return (
        F.when((kind == "uri") & ~is_uri(value), F.lit("the value is no URL"))
        .when((kind == "ip") & ~is_ip(value), F.concat(F.lit("the value is no IP address: "), value))
        .when((kind == "time") & ~is_time(value), F.lit("the value is no RFC 3339 time"))
        .when((kind == "id") & ~is_bracketed(value), F.lit("the id doesn't stand in angle brackets"))
        .when((kind == "id") & ~is_id(value), F.lit("the id is no URL"))
        .when((kind == "int") & ~is_int(value), F.lit("the value is no whole number"))
        .when((kind == "long") & ~is_long(value), F.lit("the value is no whole number of 64 bits"))
    )


def header_findings(headers: Column | str, code: Column, version_minor: Column, version_major: Column) -> Column:
    """Findings of the fields: illegal, of bad value, repeated; and of those that are missing or don't go together."""
    bit = F.when(version_major != 1, 0).when(version_minor == 0, 1).otherwise(2)
    return let(F.struct(H._c(headers).alias("h"), code.alias("code"), bit.alias("bit")), lambda s: _header_findings(s["h"], s["code"], s["bit"]))


def _header_findings(h: Column, code: Column, bit: Column) -> Column:
    once = [k.lower() for k in FIELD_RULES if k not in REPEATABLE]
    names = F.transform(h, lambda x: F.lower(x["name"]))

    def of(x: Column) -> Column:
        again = F.lower(x["name"]).isin(once) & (F.size(F.filter(names, lambda n: n == F.lower(x["name"]))) > 1)
        problem = let(field_problem(x["name"], x["value"], code, bit), lambda p: F.when(p.isNotNull(), finding("spec", p, kind="field", field=x["name"])))
        return F.array(problem.cast(FINDING), F.when(again, finding("spec", "the field may stand only once", kind="repeated", field=x["name"])).cast(FINDING))

    each = F.filter(F.flatten(F.transform(h, of)), lambda x: x.isNotNull())
    required = [F.when(~H.has(h, n), finding("spec", f"every record needs a field {n}", kind="missing", field=n)) for n in REQUIRED]
    length = F.coalesce(H.get_int64(h, "Content-Length"), F.lit(0))
    untyped = F.when((code != 128) & (length > 0) & ~H.has(h, "Content-Type"), finding("spec", "a block that isn't empty needs a Content-Type", kind="missing", field="Content-Type"))
    concurrent = F.when((code.bitwiseAND(1 | 64 | 128) != 0) & H.has(h, "WARC-Concurrent-To"), finding("spec", "records of this type have no concurrent ones", kind="field", field="WARC-Concurrent-To"))
    return F.concat(each, _some(*required, untyped, concurrent))


def blanked(headers: Column | str, code: Column, version_minor: Column, version_major: Column) -> Column:
    """Headers with illegal and invalid values emptied."""
    bit = F.when(version_major != 1, 0).when(version_minor == 0, 1).otherwise(2)
    return F.transform(H._c(headers), lambda x: F.struct(x["name"].alias("name"), F.when(field_problem(x["name"], x["value"], code, bit).isNotNull(), F.lit("")).otherwise(x["value"]).alias("value")))


def line_findings(text: Column) -> Column:
    """What is wrong with the lines of a warc-fields block, each with its number, up to the empty line that ends it."""

    def of(lines: Column) -> Column:
        # worked out once: inside of a lambda it would be for each line
        ends = F.coalesce(F.nullif(F.array_position(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", "")) == ""), F.lit(True)), F.lit(0)), F.size(lines) + 1)
        return let(F.struct(ends.alias("ends"), F.size(lines).alias("last")), lambda s: judged(lines, s["ends"], s["last"]))

    def judged(lines: Column, ends: Column, last: Column) -> Column:

        def say(i: Column, msg: str) -> Column:
            f = finding("block", msg, kind="warc_fields")
            return f.withField("line", (i + 1).cast("int"))

        def each(x: Column, i: Column) -> Column:
            cr = F.when((i + 1 < last) & ~x.endswith("\r"), say(i, "the line doesn't end in a carriage return"))
            feed = F.when((i + 1 == last) & (x != ""), say(i, "the last line doesn't end"))
            colon = F.when(~x.rlike(r"^[ \t]") & ~x.contains(":"), say(i, "the line has no colon"))
            return F.when(i + 1 < ends, F.filter(F.array(cr.cast(FINDING), feed.cast(FINDING), colon.cast(FINDING)), lambda f: f.isNotNull())).otherwise(F.array().cast(FINDINGS))

        return F.flatten(F.transform(lines, each))

    return let(F.split(text, "\n"), of)


def _digest_step(headers: Column, field: str, what: str, data: Column, ready: Column, where: Column, options: WarcOptions) -> Column:
    """STRUCT<headers, finding, unsupported> after looking at one digest field; headers is used once only, so
    that steps in a row stay small however the optimizer puts them together. ready has digests that are known already."""

    def said(h: Column) -> Column:
        given = F.coalesce(H.get(h, field), F.lit(""))
        default = F.struct(F.lit(options.default_algorithm).alias("algorithm"), F.lit(options.default_encoding).alias("encoding"), F.lit("").alias("value"))
        return F.struct(h.alias("h"), let(given, lambda g: F.when(g != "", D.parse_field(g, options.default_encoding)).otherwise(default)).alias("p"))

    def done(s: Column) -> Column:
        # nothing is hashed where the header says nothing and nothing is added
        asked = F.lit(True) if options.add_missing_digest else s["p"]["value"] != ""
        return F.struct(s["h"].alias("h"), s["p"].alias("p"), F.when(asked, F.when(ready.isNotNull(), D.encoded(F.try_element_at(ready, s["p"]["algorithm"]), s["p"]["encoding"])).otherwise(D.compute(data, s["p"]["algorithm"], s["p"]["encoding"]))).alias("right"))

    def judged(s: Column) -> Column:
        p, right = s["p"], s["right"]
        bad = where & p["algorithm"].isNotNull() & (p["value"] != "") & ~D.same_value(right, p["value"])
        full, was = D.format_field(p["algorithm"], right), D.format_field(p["algorithm"], p["value"])
        msg = F.concat(F.lit(f"the digest of the {what} is "), full, F.lit(", the header says "), was)
        change = F.lit(False)
        if options.spec == WARN and options.fix_digest:
            change = change | bad
        if options.add_missing_digest:
            change = change | (where & (p["value"] == "") & data.isNotNull())
        found = F.when(bad, finding("spec", msg, kind="digest", field=field, expected=was, actual=full)) if options.spec != IGNORE else F.lit(None)
        return F.struct(F.when(F.coalesce(change, F.lit(False)), H.set_(s["h"], field, full)).otherwise(s["h"]).alias("headers"), found.cast(FINDING).alias("finding"), p["algorithm"].isNull().alias("unsupported"))

    return let(let(let(headers, said), done), judged)


def validate_digests(df: DataFrame, options: WarcOptions, *, findings: str = "validation") -> DataFrame:
    """Checks and repairs length and digests of records with headers, block, payload, block_kind, record_type_code.

    Appends to the array column `findings`. Unsupported algorithms leave an error under any policy. Of blocks that a
    row holds the beginning of, framing has taken size and digests of the whole; where there are none, nothing is done.
    """
    with_error = "error" in df.columns
    whole = ~F.coalesce(F.col("block_truncated"), F.lit(False)) if "block_truncated" in df.columns else F.lit(True)
    known = F.col("whole") if "whole" in df.columns else F.lit(None).cast(WHOLE)
    whole = whole | known.isNotNull()
    df = df.withColumn("_sound", F.when(whole, F.col("block")))
    size = F.coalesce(known["size"], F.octet_length("_sound").cast("long"))
    if options.spec != IGNORE:
        said = H.get("headers", "Content-Length")
        found = let(said, lambda v: F.when(v.isNotNull() & F.col("_sound").isNotNull() & (v != size.cast("string")), finding("spec", F.concat(F.lit("the block has "), size.cast("string"), F.lit(" bytes, the header says "), v), kind="content_length", field="Content-Length", expected=v, actual=size)))
        df = df.withColumn(findings, F.concat(findings, _some(found)))
        if options.spec == WARN and options.fix_content_length:
            df = df.withColumn("headers", let(F.col("headers"), lambda h: F.when(F.col("_sound").isNotNull() & (H.get(h, "Content-Length") != size.cast("string")), H.set_(h, "Content-Length", size.cast("string"))).otherwise(h)))
    about = F.struct(F.col("record_type_code").alias("code"), F.col("block_kind").alias("kind"), H.has("headers", "WARC-Segment-Number").alias("part"))
    has_payload = let(about, lambda a: F.coalesce((a["code"] != 32) & ~a["part"] & (a["kind"].isin("http_request", "http_response") | ((a["code"] == 4) & (a["kind"] == "generic"))), F.lit(False)))
    headless = known.isNotNull() & (F.size(known["payload"]) == 0)  # an HTTP header that goes on beyond what the row holds
    for what, field, data, ready, where in (("block", "WARC-Block-Digest", F.col("_sound"), known["block"], whole), ("payload", "WARC-Payload-Digest", F.when(whole, F.col("payload")), known["payload"], has_payload & whole & ~F.coalesce(headless, F.lit(False)))):
        df = df.withColumn("_step", _digest_step(F.col("headers"), field, what, data, ready, where, options))
        more = {"headers": F.col("_step.headers"), findings: F.concat(findings, _some(F.col("_step.finding")))}
        if with_error:
            wrong = F.struct(F.lit("digest").alias("kind"), F.concat(F.lit("no digest can be computed by "), F.split_part(H.get("headers", field), F.lit(":"), F.lit(1))).alias("msg"))
            more["error"] = F.coalesce("error", F.when(F.col("_step.unsupported"), wrong))
        df = df.withColumns(more)
    return df.drop("_step", "_sound")


def apply_policies(df: DataFrame, options: WarcOptions, *, findings: str = "validation") -> DataFrame:
    """Drops findings of ignored categories; the first one of a failing category becomes the record's error."""
    keep = [c for c in ("syntax", "spec", "type", "block") if options.policy(c) != IGNORE]
    fatal = [c for c in keep if options.policy(c) == FAIL]
    df = df.withColumn(findings, F.filter(findings, lambda x: x["category"].isin(keep) if keep else F.lit(False)))
    if fatal:
        first = F.get(F.filter(findings, lambda x: x["category"].isin(fatal)), F.lit(0))
        df = df.withColumn("error", F.coalesce(F.col("error"), F.when(first.isNotNull(), F.struct(first["category"].alias("kind"), first["msg"].alias("msg")))))
    return df


def no_findings() -> Column:
    return F.array().cast(FINDINGS)
