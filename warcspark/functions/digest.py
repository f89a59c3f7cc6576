"""Digest columns: md5, sha1, sha256 and sha512 in base16, base32 and base64.

Everything here stays inside Catalyst. A digest field reads `algorithm:value`; the encoding of
a value is known from its length, and a field without a value names an algorithm only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let

#: Bytes of a digest for each algorithm.
SIZES = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
#: The digits of conv() to base 32, and those of the base32 encoding.
_CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hex_digest(data: Column | str, algorithm: str) -> Column:
    """Lower-case base16 digest of a binary column."""
    data = _c(data).cast("binary")
    if algorithm == "md5":
        return F.md5(data)
    if algorithm == "sha1":
        return F.sha1(data)
    if algorithm in ("sha256", "sha512"):
        return F.sha2(data, int(algorithm[3:]))
    raise ValueError(f"unsupported digest algorithm '{algorithm}'")


def base32_of_hex(hexed: Column, size: int) -> Column:
    """Padded base32 of `size` bytes given in base16: ten hex digits are eight of base32."""
    groups = -(-size // 5)
    filled = F.rpad(hexed, 10 * groups, "0")
    parts = [F.lpad(F.conv(F.substring(filled, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(groups)]
    digits = -(-8 * size // 5)
    text = F.translate(F.concat(*parts), _CONV32, _BASE32)
    return F.rpad(F.substring(text, 1, digits), 8 * groups, "=") if digits < 8 * groups else text


def base64_of_hex(hexed: Column) -> Column:
    """Padded base64 without the line breaks that base64() puts after 76 characters."""
    return F.translate(F.base64(F.unhex(hexed)), "\r\n", "")


def digest(data: Column | str, algorithm: str = "sha256", encoding: str = "base16") -> Column:
    """The bare digest value of a binary column."""
    hexed = hex_digest(data, algorithm)
    if encoding == "base16":
        return hexed
    if encoding == "base32":
        return base32_of_hex(hexed, SIZES[algorithm])
    if encoding == "base64":
        return base64_of_hex(hexed)
    raise ValueError(f"unknown digest encoding '{encoding}'")


def normalize_algorithm(name: Column | str) -> Column:
    """sha-1 and SHA1 are sha1; the empty name is sha256; unknown names stay, in lower case."""
    low = F.lower(_c(name))
    return F.when(low == "", "sha256").otherwise(F.regexp_replace(low, r"^sha-(1|256|512)$", "sha$1"))


def recommended_encoding(algorithm: Column | str) -> Column:
    return F.when(_c(algorithm) == "sha1", "base32").otherwise("base16")


def detect_encoding(algorithm: Column | str, value: Column | str, default: str | Column = "base16") -> Column:
    """The encoding that a value of this length must have; the default where none fits."""
    a, v = _c(algorithm), _c(value)
    n = F.length(v)
    out = F.when((a == "md5") & (n == 32), F.when(F.endswith(v, F.lit("=")), "base32").otherwise("base16"))
    for name, size in SIZES.items():
        b32, b64 = 8 * -(-size // 5), 4 * -(-size // 3)
        u32, u64 = -(-8 * size // 5), -(-4 * size // 3)
        out = out.when((a == name) & (n == 2 * size), "base16").when((a == name) & n.isin(b32, u32), "base32").when((a == name) & n.isin(b64, u64), "base64")
    return out.otherwise(_c(default) if isinstance(default, Column) else F.lit(default))


def parse_field(field: Column | str, default_encoding: str | Column = "base16") -> Column:
    """STRUCT<algorithm, encoding, value> of a digest field; null algorithm where it is unsupported.

    Base16 values come out in lower case and base32 values in upper case.
    """
    default = default_encoding if isinstance(default_encoding, Column) else F.lit(default_encoding)

    def cut(f: Column) -> Column:
        at = F.instr(f, ":")
        name = normalize_algorithm(F.when(at > 0, F.substring(f, F.lit(1), at - 1)).otherwise(f))
        return F.struct(name.alias("a"), F.when(at > 0, F.substring(f, at + 1, F.length(f))).otherwise(F.lit("")).alias("v"))

    def coded(p: Column) -> Column:
        encoding = F.when(p["v"] == "", default).otherwise(detect_encoding(p["a"], p["v"], default))
        return F.struct(p["a"].alias("a"), p["v"].alias("v"), encoding.alias("e"))

    def shaped(p: Column) -> Column:
        cased = F.when(p["e"] == "base16", F.lower(p["v"])).when(p["e"] == "base32", F.upper(p["v"])).otherwise(p["v"])
        return F.struct(F.when(p["a"].isin(*SIZES), p["a"]).alias("algorithm"), p["e"].alias("encoding"), cased.alias("value"))

    f = _c(field)
    return F.when(f.isNotNull(), let(let(let(f, cut), coded), shaped))


def base32_any(hexed: Column) -> Column:
    """Padded base32 of bytes given in base16, whatever their number."""
    groups = F.ceil(F.length(hexed) / 10).cast("int")
    filled = F.rpad(hexed, groups * 10, F.lit("0"))
    part = F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.lpad(F.conv(F.substring(filled, i * 10 + 1, F.lit(10)), 16, 32), 8, "0"))
    text = F.translate(F.array_join(part, ""), _CONV32, _BASE32)
    return F.rpad(F.substring(text, F.lit(1), F.ceil(F.length(hexed) * 4 / 5).cast("int")), groups * 8, F.lit("="))


def compute(data: Column | str, algorithm: Column, encoding: Column) -> Column:
    """The digest value of data where algorithm and encoding vary by row; null for unsupported ones."""
    hexed = None
    for a in SIZES:
        h = hex_digest(data, a)
        hexed = F.when(algorithm == a, h) if hexed is None else hexed.when(algorithm == a, h)
    return _coded(hexed, encoding)


def _coded(hexed: Column, encoding: Column) -> Column:
    return let(hexed, lambda h: F.when(encoding == "base16", h).when(encoding == "base32", base32_any(h)).when(encoding == "base64", base64_of_hex(h)))


def encoded(raw: Column, encoding: Column) -> Column:
    """A digest value from the digest's bytes."""
    return _coded(F.lower(F.hex(raw)), encoding)


def format_field(algorithm: Column | str, value: Column | str) -> Column:
    return F.concat(_c(algorithm), F.lit(":"), _c(value))


def digest_field(data: Column | str, algorithm: str = "sha256", encoding: str | None = None) -> Column:
    """`algorithm:value` of a binary column; sha1 defaults to base32, the rest to base16."""
    return F.concat(F.lit(f"{algorithm}:"), digest(data, algorithm, encoding or ("base32" if algorithm == "sha1" else "base16")))


def same_value(a: Column, b: Column) -> Column:
    """Equal but for padding."""
    return F.regexp_replace(a, "(?<!=)=++$", "") == F.regexp_replace(b, "(?<!=)=++$", "")


def matches(field: Column | str, data: Column | str, default_encoding: str = "base16") -> Column:
    """Whether the digest field is that of data: padding doesn't matter, nor does case but in base64.

    Null where the field is null, has no value, or names an unsupported algorithm.
    """
    return let(parse_field(field, default_encoding), lambda p: F.when(p["algorithm"].isNotNull() & (p["value"] != ""), same_value(compute(data, p["algorithm"], p["encoding"]), p["value"])))
