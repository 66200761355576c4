"""Which paths are meant: globs, file, only and not lists, sizes, versions, and renaming."""

from __future__ import annotations

import re
from calendar import monthrange
from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """* is any run and ? any one character, slashes too; letters match in either case (ASCII); descendants match as well."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
    return f"(?is)^{body}" + (r".*\z" if glob.endswith("/") else r"(/.*)?\z")


def matches(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def any_of(path: Column, globs: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [matches(path, g) for g in globs], F.lit(False))


def selected(path: Column, files: Sequence[str] = (), only: Sequence[str] = (), not_: Sequence[str] = ()) -> Column:
    """In files (if given) and in only (if given), and not in not_."""
    out = ~any_of(path, not_)
    for globs in (files, only):
        if globs:
            out = out & any_of(path, globs)
    return out


def literal_prefix(globs: Sequence[str]) -> str:
    """What every match must start with if case matters not: the globs' common text before any wildcard or letter."""
    heads = [re.match(r"[^*?A-Za-z]*", g)[0] for g in globs] or [""]
    return reduce(lambda a, b: a[: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))], heads)  # noqa: B905


def select_paths(df: DataFrame, files: Sequence[str] = (), only: Sequence[str] = (), not_: Sequence[str] = (), path: str = "path") -> DataFrame:
    """The filter by selected(); a literal prefix of the globs is pushed to the scan as well."""
    prefix = literal_prefix(list(files))
    return (df.filter(F.col(path).startswith(prefix)) if prefix else df).filter(selected(F.col(path), files, only, not_))


#: What operating systems and sync tools leave behind; plain globs, so they can be extended.
HOUSEKEEPING = (
    "*/.DS_Store", "*/._*", "*/.Spotlight-V100", "*/.Trashes", "*/@eaDir", "*/#recycle", "*/Thumbs.db", "*/desktop.ini",
    "*/.dropbox.cache", "*/System Volume Information", "*/$RECYCLE.BIN",
)


def without_housekeeping(df: DataFrame, extra: Sequence[str] = (), path: str = "path") -> DataFrame:
    return df.filter(~any_of(F.col(path), [*HOUSEKEEPING, *extra]))


def sized(df: DataFrame, least: int | None = None, most: int | None = None, size: str = "size") -> DataFrame:
    if least is not None:
        df = df.filter(F.col(size) >= least)
    return df if most is None else df.filter(F.col(size) <= most)


def containing(df: DataFrame, text: str, path: str = "path") -> DataFrame:
    return df.filter(F.col(path).contains(text))


def depth(df: DataFrame, most: int, path: str = "path") -> DataFrame:
    """At most that many slashes: 0 is no recursion."""
    return df.filter(F.size(F.split(F.regexp_replace(path, "/$", ""), "/")) <= most + 1)


def without_dirs(df: DataFrame, path: str = "path") -> DataFrame:
    return df.filter(~F.col(path).endswith("/"))


def renamed(path: Column, files: Sequence[str] = (), to: Sequence[str] = ()) -> Column:
    """Without files, to[0] goes before the path; else the first literal prefix in files becomes its counterpart in to."""
    if not to:
        return path
    if not files:
        return F.concat(F.regexp_replace(F.lit(to[0]), "/$", ""), F.lit("/"), F.regexp_replace(path, "^/", ""))
    out = None
    for a, b in zip(files, to):  # noqa: B905 - files beyond `to` keep their names
        case, name = path.startswith(a), F.concat(F.lit(b), F.substring(path, len(a) + 1, 1 << 30))
        out = F.when(case, name) if out is None else out.when(case, name)
    return out.otherwise(path)


def replaced(path: Column, find: str, put: str) -> Column:
    return F.replace(path, F.lit(find), F.lit(put))


def parse_range(text: str) -> tuple[int | None, int | None, int | None]:
    """X:Y, X:, :Y, X and ::K as (first, last, how many of the last)."""
    if found := re.fullmatch(r"::(\d+)", text):
        return None, None, int(found[1])
    found = re.fullmatch(r"(\d*)(:?)(\d*)", text)
    if not found or not (found[1] or found[3]):
        raise ValueError(f"not a range: {text}")
    first = int(found[1]) if found[1] else None
    return first, (int(found[3]) if found[3] else None) if found[2] else first, None


def selected_renamed(path: Column, to: Sequence[str], files: Sequence[str] = (), only: Sequence[str] = (), not_: Sequence[str] = ()) -> Column:
    """selected() with renaming on: a file argument is matched against the path by the new name that it has, if it has one."""
    return selected(path, [to[i] if i < len(to) else f for i, f in enumerate(files)], only, not_)


def _last_valid(digits: int) -> datetime:
    """The last point in time whose decimal YYYYMMDDHHMMSS isn't above the given one, which may be no date."""
    year, rest = divmod(digits, 10**10)
    month, day, hour, minute, second = (rest // 100**k % 100 for k in (4, 3, 2, 1, 0))
    if month < 1:
        return datetime(year - 1, 12, 31, 23, 59, 59)
    if month > 12:
        return datetime(year, 12, 31, 23, 59, 59)
    if day < 1:
        return datetime(year, month, 1) - timedelta(seconds=1)
    if day > (days := monthrange(year, month)[1]):
        return datetime(year, month, days, 23, 59, 59)
    if hour > 23:
        return datetime(year, month, day, 23, 59, 59)
    return datetime(year, month, day, hour, 59, 59) if minute > 59 else datetime(year, month, day, hour, minute, min(second, 59))


def parse_until(*words: str) -> int | datetime:
    """A version number (negative counts from the end) or a date.

    All digits of the words make one number, lone digits with a zero before them. Up to seven digits are a version; a date
    without hour, minute or second has the latest one. A negative version is one word.
    """
    if words and words[0].startswith("-"):
        if len(words) > 1 or not re.fullmatch(r"-\d+", words[0]) or int(words[0]) == 0:
            raise ValueError(f"not a version: {' '.join(words)}")
        return int(words[0])
    runs = re.findall(r"[0-9]+", " ".join(words))
    if not runs:
        raise ValueError(f"neither a version nor a date: {' '.join(words)}")
    number = int("".join(r.zfill(2) for r in runs))
    for low, high, default in ((19000000, 29991231, 23), (1900000000, 2999123123, 59), (190000000000, 299912312359, 59)):
        if low <= number <= high:
            number = number * 100 + default
    if number <= 9_999_999:
        return number
    if not 19000101000000 <= number <= 29991231235959:
        raise ValueError(f"dates run from 19000101000000 to 29991231235959: {number}")
    return _last_valid(number)
