"""Text, path, size and bit functions, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_size(n: Column) -> Column:
    """Whole bytes, else one decimal (ties to even) of KB, MB or GB, by 1024; GB is the largest unit."""
    k = n.cast("double")
    return (
        F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.format_string("%.1f KB", F.bround(k / 1024, 1)))
        .when(n < 1024**3, F.format_string("%.1f MB", F.bround(k / 1024**2, 1)))
        .otherwise(F.format_string("%.1f GB", F.bround(k / 1024**3, 1)))
    )


def short_path(path: Column) -> Column:
    return F.substring_index(path, "/", -2)


def md5_tag(data: Column) -> Column:
    """Upper-case hexadecimal MD5 and a line end."""
    return F.concat(F.upper(F.md5(data.cast("binary"))), F.lit("\r\n"))


def blank_as_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def parse_bool(text: Column) -> Column:
    return F.trim(text).isin("true", "1")


def parse_int(text: Column, zero_as_null: bool = False) -> Column:
    value = blank_as_null(text).try_cast("long")
    return F.nullif(value, F.lit(0)) if zero_as_null else value


def parse_choice(text: Column, options: list[str]) -> Column:
    """The trimmed text if it is an option; anything else fails."""
    value = blank_as_null(text)
    return F.when(value.isNull() | value.isin(options), value).otherwise(F.raise_error(F.concat(F.lit("no such choice: "), value)))


def sibling_path(path: Column, tag: str, extension: str) -> Column:
    """{folder}/{stem}_{tag}.{extension}"""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.concat(folder, stem, F.lit(f"_{tag}.{extension}"))


def path_problem(path: Column) -> Column:
    """Why a path must not be extracted, null if it may: empty, nul, absolute, drive letter or a step up."""
    unified = F.replace(path, F.lit("\\"), F.lit("/"))
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(F.contains(path, F.lit("\x00")), "nul")
        .when(unified.startswith("/"), "absolute")
        .when(unified.rlike(r"^[A-Za-z]:"), "drive")
        .when(F.array_contains(F.split(unified, "/"), ".."), "parent")
    )


def normalised_path(path: Column) -> Column:
    """Without empty, ``.`` and ``..`` components."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.concat_ws("/", F.filter(parts, lambda p: ~p.isin("", ".", "..")))


def matches_query(query: str, id_: Column, *others: Column) -> Column:
    """A command's id in lower case, or any other field as it is, contains the query, trimmed and in lower case; an empty query finds all."""
    q = F.lit(query.strip().lower())
    found = F.lower(id_).contains(q)
    for o in others:
        found = found | o.contains(q)
    return found


def suffix_is(path: Column, suffix: str) -> Column:
    return F.lower(path).endswith(suffix.lower())


def bit_field(raw: Column, offset: int, width: int) -> Column:
    """An unsigned field of a packed number."""
    return F.shiftrightunsigned(raw.cast("long"), offset).bitwiseAND((1 << width) - 1)


def with_bit_field(raw: Column, offset: int, width: int, value: Column) -> Column:
    mask = ((1 << width) - 1) << offset
    low = value.cast("long").bitwiseAND((1 << width) - 1)
    return raw.cast("long").bitwiseAND(~mask).bitwiseOR(F.shiftleft(low, offset))


def is_zlib(data: Column) -> Column:
    """Whether the first two bytes are a zlib header: method 8 and a multiple of 31."""
    head = F.conv(F.hex(F.substring(data, 1, 2)), 16, 10).cast("long")
    return (F.length(data) >= 2) & (head.bitwiseAND(0x0F00) == 0x0800) & (head % 31 == 0)


def zigzag(n: Column) -> Column:
    n = n.cast("long")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column) -> Column:
    n = n.cast("long")
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(1))


def varint_length(n: Column) -> Column:
    """Bytes of an unsigned number in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n.cast("long"))) / 7)).cast("int")


def fixed_point(n: Column, scale: float) -> Column:
    return n.cast("double") / F.lit(scale)


def affine(kx: Column, ky: Column, sx: Column, sy: Column) -> dict[str, Column]:
    """A matrix from skews in degrees and scales."""
    return {"a": F.cos(F.radians(kx)) * sx, "b": F.sin(F.radians(kx)) * sx, "c": -F.sin(F.radians(ky)) * sy, "d": F.cos(F.radians(ky)) * sy}
