"""Column functions on texts, urls and uids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: texts shown in place of content
SHORTENED = "[... CONTENT SHORTENED ...]\n"
BINARY = "task {stream} is binary -- use file staging"
TAIL_LENGTH = 1024

#: separators of a directive in order of precedence; True: target comes first
ARROWS = [(">>", False), (">", False), ("<<", True), ("<", True)]


def tail(text: Column, n: int = TAIL_LENGTH) -> Column:
    """The last n characters, marked when something was cut; null gives ''."""
    cut = F.concat(F.lit(SHORTENED), F.substring(text, -n, n))
    return F.when(F.length(text) > n, cut).otherwise(F.coalesce(text, F.lit("")))


def url_path(url: Column) -> Column:
    """Path of a url without query and fragment; a plain path is its own path."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    return F.regexp_replace(rest, r"[?#].*$", "")


def url_schema(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parse_directive(text: Column) -> Column:
    """Struct(source, target) of a directive such as `a.dat > b.dat`.

    Without an arrow the target is the base name of the source.  More than one
    arrow of the kind that counts gives nulls.
    """
    found = None
    for arrow, reverse in ARROWS:
        parts = F.split(text, arrow)
        one = F.size(parts) == 2
        first = F.when(one, F.trim(F.get(parts, F.lit(0))))
        second = F.when(one, F.trim(F.get(parts, F.lit(1))))
        pair = (F.struct(second.alias("source"), first.alias("target")) if reverse
                else F.struct(first.alias("source"), second.alias("target")))
        has = text.contains(arrow)
        found = F.when(has, pair) if found is None else found.when(has, pair)
    return found.otherwise(F.struct(
        F.trim(text).alias("source"), F.trim(basename(url_path(text))).alias("target")))


def default_target(source: Column, target: Column) -> Column:
    """An empty target is the source's base name in the task sandbox."""
    empty = F.trim(F.coalesce(target, F.lit(""))) == ""
    return F.when(empty, F.concat(F.lit("task:///"), basename(url_path(source)))).otherwise(target)


def complete_url(url: Column, context: Column) -> Column:
    """Struct(url, error): place the path below the base its schema stands for.

    `context` maps schemas to base urls.  No schema means `file` for absolute
    and `pwd` for relative paths.  `file` and unknown schemas stay as they are.
    Known schemas are namespaces, so a host in them is an error.
    """
    named = url_schema(url)
    absolute = url.startswith("/")
    kind = F.when(named != "", named).when(absolute, F.lit("file")).otherwise(F.lit("pwd"))
    full = F.when(named != "", url).otherwise(F.concat(kind, F.lit("://"), F.when(
        absolute, F.lit("")).otherwise(F.lit("/")), url))
    known = F.coalesce(F.map_contains_key(context, kind), F.lit(False))
    bad = known & (url_host(url) != "")
    path = F.regexp_replace(url_path(url), "^/+", "")
    base = F.regexp_replace(F.element_at(context, kind), "/+$", "")
    placed = F.when(known & (kind != "file"), F.concat(base, F.lit("/"), path)).otherwise(full)
    return F.struct(
        F.when(~bad, placed).alias("url"),
        F.when(bad, F.lit("urls cannot specify a host for expanded schemas")).alias("error"))


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit).cast("long")) != 0


def uid_type(uid: Column) -> Column:
    """Entity type: what stands before the first dot."""
    return F.substring_index(uid, ".", 1)


def uid_code(uid: Column, pattern: str) -> Column:
    """Group code from a uid chosen by the user; null without a match."""
    code = F.regexp_extract(uid, pattern, 1)
    return F.when(code != "", code)


def ts_text(epoch: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch seconds as text, in UTC when the session is."""
    return F.date_format(F.timestamp_micros((epoch * 1e6).cast("long")), fmt)


def extract_info(line: Column, pattern: str) -> Column:
    """Last group of the first match of the pattern in a line; null without one."""
    wrapped = f"^.*({pattern}).*$"
    groups = _groups(wrapped)
    return F.when(line.rlike(wrapped), F.regexp_extract(line, wrapped, groups))


def _groups(pattern: str) -> int:
    import re
    return re.compile(pattern).groups


def tool_name(text: Column) -> Column:
    """Event name from a tool's text: lower case, `_` for spaces, no `state_`."""
    return F.regexp_replace(F.lower(F.replace(text, F.lit(" "), F.lit("_"))), "state_", "")
