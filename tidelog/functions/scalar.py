"""Scalar functions over paths, numbers, dates, sizes and hashes, all as column expressions."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_dir(path: Column) -> Column:
    """Up to the last slash, with it; empty if there is none."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def join_path(a: Column, b: Column) -> Column:
    """Exactly one slash between the two."""
    return F.concat(F.regexp_replace(a, "/$", ""), F.lit("/"), F.regexp_replace(b, "^/", ""))


def normal_path(path: Column) -> Column:
    """Back slashes become slashes and a drive letter loses its colon."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^([A-Za-z]):", "$1")


def thousands(n: Column) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit("."))


def padded(n: Column, digits: int) -> Column:
    """Decimal with at least that many digits; 0 with no digits asked for is empty."""
    text = n.cast("string")
    out = F.lpad(text, F.greatest(F.lit(digits), F.length(text)), F.lit("0"))
    return F.when(n == 0, F.lit("0" * digits)).otherwise(out)


def replace_first(text: Column, find: str, put: str) -> Column:
    at = F.locate(find, text)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit(put), F.substr(text, at + len(find)))).otherwise(text)


def split_list(text: Column, delimiter: str) -> Column:
    """Tokens between delimiters: repeated ones give empty tokens, one at the end gives none."""
    parts = F.split(text, re.escape(delimiter))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def little_endian(hex_text: Column) -> Column:
    """The number that bytes in hex, smallest first, stand for."""
    pairs = F.regexp_extract_all(hex_text, F.lit("(..)"), F.lit(1))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("decimal(20,0)")


def to_little_endian(n: Column, width: int) -> Column:
    pairs = F.regexp_extract_all(F.lpad(F.hex(n), 2 * width, "0"), F.lit("(..)"), F.lit(1))
    return F.lower(F.array_join(F.reverse(pairs), ""))


def bit_length(x: Column) -> Column:
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def squash(x: Column) -> Column:
    return F.floor(32768 / (1 + F.exp(-x / 64)))


def stretch(x: Column) -> Column:
    return F.round(64 * F.log((x + 0.5) / (32767.5 - x))).cast("long")


def date_int(ts: Column) -> Column:
    """YYYYMMDDHHMMSS as a number."""
    return F.date_format(ts, "yyyyMMddHHmmss").cast("long")


def date_fields(n: Column) -> Column:
    part = lambda unit, size: ((n / unit).cast("long") % size)
    whole = lambda unit: F.floor(n / unit)
    return F.struct(whole(10**10).alias("year"), (whole(10**8) % 100).alias("month"), (whole(10**6) % 100).alias("day"), (whole(10**4) % 100).alias("hour"), (whole(100) % 100).alias("minute"), (n % 100).alias("second"))


def fill_date(template: Column, ts: Column) -> Column:
    """%year %month %day %hour %min %sec %week %date %time %datetime %timestamp, longest names first."""
    values = (
        ("%timestamp", F.unix_seconds(ts.cast("timestamp")).cast("string")),
        ("%datetime", F.date_format(ts, "yyyyMMddHHmmss")),
        ("%weekday", F.date_format(ts, "EEEE")),
        ("%month", F.date_format(ts, "MM")),
        ("%year", F.date_format(ts, "yyyy")),
        ("%hour", F.date_format(ts, "HH")),
        ("%week", F.lpad(F.weekofyear(ts).cast("string"), 2, "0")),
        ("%date", F.date_format(ts, "yyyyMMdd")),
        ("%time", F.date_format(ts, "HHmmss")),
        ("%day", F.date_format(ts, "dd")),
        ("%min", F.date_format(ts, "mm")),
        ("%sec", F.date_format(ts, "ss")),
    )
    for name, value in values:
        template = F.replace(template, F.lit(name), value)
    return template


def elapsed(seconds: Column) -> Column:
    """hh:mm:ss."""
    two = lambda c: F.lpad(c.cast("string"), F.greatest(F.lit(2), F.length(c.cast("string"))), F.lit("0"))
    return F.concat(two(F.floor(seconds / 3600)), F.lit(":"), two(F.floor(seconds / 60) % 60), F.lit(":"), two(seconds % 60))


def size_bytes(text: Column) -> Column:
    """A number with K, M, G, T (B may follow), in powers of 1024."""
    unit = F.upper(F.regexp_extract(text, r"(?i)([KMGT]?)B?\s*$", 1))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return (F.regexp_extract(text, r"^\s*(\d+)", 1).cast("long") * F.pow(F.lit(1024.0), power)).cast("long")


def parse_size(text: str) -> int:
    found = re.fullmatch(r"\s*(\d+)\s*([KMGT]?)B?\s*", text, re.I)
    if not found:
        raise ValueError(f"not a size: {text}")
    return int(found[1]) * 1024 ** " KMGT".index(found[2].upper() or " ")


def hex_only(text: Column, length: int | None = None) -> Column:
    out = F.upper(F.regexp_replace(text, "[^0-9A-Fa-f]", ""))
    return out if length is None else F.substring(out, 1, length)


def all_zero(hex_text: Column) -> Column:
    """Whether bytes in hex are zeros only; no bytes are not."""
    return hex_text.rlike("^(00)+$")


def safe_name(path: Column, most: int = 255) -> Column:
    """Characters that file systems refuse become underscores; each name is cut to `most` characters."""
    cut = F.transform(F.split(F.regexp_replace(path, r'[<>:"|?*\x00-\x1F]', "_"), "/"), lambda x: F.substring(x, 1, most))
    return F.array_join(cut, "/")


def quick_hash(content: Column, piece: int = 4096) -> Column:
    """Our own definition: SHA-1 of the first, middle and last characters and the length."""
    n = F.length(content)
    middle = F.substr(content, F.greatest(F.lit(1), F.floor(n / 2).cast("int")), F.lit(piece))
    return F.sha1(F.concat_ws("|", F.substring(content, 1, piece), middle, F.right(content, F.lit(piece)), n.cast("string")).cast("binary"))


def no_attributes(df, column: str = "attr"):
    """Listing without attributes: they count as 0."""
    return df.withColumn(column, F.lit(0).cast("long"))


def touched(df, when: str, column: str = "mtime"):
    """All files get one date."""
    return df.withColumn(column, F.lit(when).cast("timestamp_ntz"))


#: Names that an operating system keeps for devices.
RESERVED = ("con", "prn", "aux", "nul", *(f"{n}{i}" for n in ("com", "lpt") for i in range(1, 10)))


def unreserved(path: Column) -> Column:
    """A part of a path whose stem is a device's name gets an underscore in front."""
    parts = F.transform(F.split(path, "/"), lambda x: F.when(F.lower(F.substring_index(x, ".", 1)).isin(*RESERVED), F.concat(F.lit("_"), x)).otherwise(x))
    return F.array_join(parts, "/")


def flat(path: Column, by: str = "_") -> Column:
    """All files in one folder: slashes become part of the name."""
    return F.translate(path, "/", by)


def case_collisions(df, path: str = "path"):
    """Paths that differ in case only, by their lower-case form: folded, paths, first."""
    own = df.select(path).distinct().groupBy(F.lower(path).alias("folded")).agg(F.count(F.lit(1)).alias("paths"), F.min(path).alias("first"))
    return own.filter("paths > 1")


def utf16(text: Column) -> Column:
    return F.encode(text, "UTF-16LE")


def from_utf16(data: Column) -> Column:
    return F.decode(data, "UTF-16LE")


def elias_gamma(n: Column) -> Column:
    """The Elias-gamma code of a positive number as a string of bits: as many zeros as bits follow the first one, then all."""
    bits = F.bin(n)
    return F.when(n > 0, F.concat(F.repeat(F.lit("0"), F.length(bits) - 1), bits))


def from_elias_gamma(code: Column) -> Column:
    return F.conv(F.regexp_extract(code, "^0*(1[01]*)$", 1), 2, 10).cast("long")


def stretched_key(password: Column, salt: Column, n: int = 16384, r: int = 8, p: int = 1, length: int = 32) -> Column:
    """scrypt of a password, in hex. Meant for keys, not for tables: it is slow by design."""
    @F.udf("string")
    def one(word, grain):
        if word is None or grain is None:
            return None
        return hashlib.scrypt(bytes(word), salt=bytes(grain), n=n, r=r, p=p, maxmem=1 << 28, dklen=length).hex()

    return one(password.cast("binary"), salt.cast("binary"))


def digests(content: Column, names=("sha3_256", "blake2b", "sha512")) -> Column:
    """Hashes that the engine itself hasn't, as a struct of hex strings."""
    @F.pandas_udf(", ".join(f"{n} string" for n in names))
    def each(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({n: [None if x is None else hashlib.new(n, x).hexdigest() for x in data] for n in names})

    return each(content.cast("binary"))
