"""Scalar text functions as Column expressions: everything stays in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of headings, section references and properties.
HEADING_NUMBERED = r"^[#]{0,3}\s*(?:Chapter\s+)?(\d+(?:\.\d+)*)\s+[A-Z].+$"
HEADING_CAPITALS = r"^([A-Z][A-Z\s\-]{10,})$"
HEADING_ROMAN = r"^(?=[MDCLXVI]+\.\s)[MDCLXVI]+\.\s+[A-Z].+$"
SECTION_REF = r"\b(?:GEN|ENR|AD)\s*\d+(?:[\.\-\u2013\u2014]+\d+)*(?:\s*-\s*[A-Z0-9]+)*"
LINK = r"\[\[(.*?)\]\]"


def tokens(text: Column) -> Column:
    """Lower-cased whitespace tokens; punctuation stays; no empty tokens."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def words(text: Column) -> Column:
    """Whitespace tokens as they are."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def slug(title: Column) -> Column:
    """Lower case; all but letters, digits, ``_`` and ``-`` become ``-``; outer dashes go."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\-]", "-"), "^-+|-+$", "")


def section_id(title: Column, ordinal: Column) -> Column:
    """The slug's first 40 characters, or ``section-<n>`` where nothing is left."""
    cut = F.substring(slug(title), 1, 40)
    return F.when(cut == "", F.concat(F.lit("section-"), ordinal.cast("string"))).otherwise(cut)


def collapsed(text: Column) -> Column:
    """White space runs become one space, outer ones go, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def toc_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]", "")


def clean_link(link: Column) -> Column:
    """A link target without brackets, label (after a pipe) and true ``.md`` suffix."""
    bare = F.regexp_replace(F.trim(link), r"^\[+|\]+$", "")
    return F.regexp_replace(F.trim(F.split_part(bare, F.lit("|"), F.lit(1))), r"\.md$", "")


def raw_name(name: Column) -> Column:
    """A raw file's name without brackets and white space around it, its first folder prefix, and leading slashes."""
    bare = F.regexp_replace(name, r"\A[\s\[]+|[\s\]]+\z", "")
    return F.regexp_replace(F.regexp_replace(bare, "^(?i)(raw/sources/|raw/|sources/)", ""), "^/+", "")


def day(stamp: Column) -> Column:
    """The ISO date of a time."""
    return F.date_format(stamp, "yyyy-MM-dd")


def moment(stamp: Column) -> Column:
    """A time to the second, as progress and catalogs note it."""
    return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


OMITTED = "\n\n[... middle of document omitted ...]\n\n"


def sample(text: Column, limit: int = 60_000, head: int = 15_000, tail: int = 10_000) -> Column:
    """Head, a mark and tail of a text that is longer than ``limit`` characters."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, head), F.lit(OMITTED), F.right(text, F.lit(tail)))).otherwise(text)


def links(text: Column) -> Column:
    """Distinct ``[[targets]]`` in alphabetical order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(LINK), F.lit(1))))


def section_refs(text: Column, most: int = 5) -> Column:
    """The first distinct section references, white space collapsed."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SECTION_REF), F.lit(0)), lambda r: F.regexp_replace(r, r"\s+", " "))
    return F.slice(F.array_distinct(found), 1, most)


def is_heading(line: Column) -> Column:
    s = F.trim(line)
    return (F.length(s) >= 4) & (s.rlike(HEADING_NUMBERED) | s.rlike(HEADING_CAPITALS) | s.rlike(HEADING_ROMAN))


PROPERTIES = r"(?s)###\s+Properties\s*\n(.*?)(?=\n##|\z)"
FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n(.*)\z"


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def has_properties(content: Column) -> Column:
    return content.rlike(PROPERTIES)


def properties_block(content: Column) -> Column:
    """The ``### Properties`` block, or front matter between dashes."""
    return F.when(has_properties(content), F.regexp_extract(content, PROPERTIES, 1)).otherwise(F.regexp_extract(content, FRONT_MATTER, 1))


def note_body(content: Column) -> Column:
    """What follows the properties or the front matter; the whole text where there are none."""
    behind = F.regexp_extract(content, r"(?s)###\s+Properties\s*\n.*?(?=\n##|\z)(.*)\z", 1)
    return F.when(has_properties(content), stripped(behind)).when(content.rlike(FRONT_MATTER), F.regexp_extract(content, FRONT_MATTER, 2)).otherwise(stripped(content))


def unquoted(value: Column) -> Column:
    return F.regexp_replace(value, "^([\"'])(.*)\\1$", "$2")


def quoted(value: Column) -> Column:
    """A string as YAML and JSON write it: in double quotes, with escapes."""
    return F.regexp_replace(F.to_json(F.array(value)), r"(?s)\A\[(.*)\]\z", "$1")


def without_comment(value: Column) -> Column:
    """A value without a trailing comment; quoted strings and lists keep what is in them."""
    closed = F.regexp_extract(value, r"""^("(?:[^"\\]++|\\.)*+"|'[^']*'|\[.*\])\s+#.*$""", 1)
    return F.when(closed != "", closed).when(value.rlike("^[\"'\\[]"), value).otherwise(F.trim(F.regexp_replace(value, r"\s#.*$", "")))


ITEM = "\u001f"


def property_map(block: Column) -> Column:
    """Top-level ``key: value`` pairs of a YAML mapping as a map of strings; the last of equal keys counts.

    Lists in lines of their own (``- item``) become flow lists, indented lines continue
    the value before them, comment and blank lines are left out. Values stay as they are
    written: ``property_text`` and ``property_list`` read them.
    """
    rows = F.regexp_replace(block, r"(?m)^[ \t]*#.*$", "")
    rows = F.regexp_replace(rows, r"\n[ \t]*-[ \t]+", ITEM)
    rows = F.regexp_replace(rows, r"\n[ \t]+(?=\S)", " ")
    lines = F.filter(F.split(rows, "\n"), lambda x: F.trim(x).rlike("^[^#:]+:"))

    def entry(line: Column) -> Column:
        key = F.trim(F.regexp_extract(line, "^([^:]+):", 1))
        value = F.trim(F.regexp_extract(line, "(?s)^[^:]+:(.*)$", 1))
        items = F.transform(F.slice(F.split(value, ITEM), 2, 1 << 20), lambda x: property_text(without_comment(F.trim(x))))
        return F.struct(key.alias("key"), F.when(F.contains(value, F.lit(ITEM)), F.to_json(items)).otherwise(without_comment(value)).alias("value"))

    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(F.transform(lines, entry), empty, lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))


def property_text(value: Column) -> Column:
    """A scalar value: a quoted string without its quotes and escapes, or the text as it is."""
    return F.when(F.startswith(value, F.lit('"')), F.coalesce(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0], unquoted(value))).otherwise(unquoted(value))


def property_list(value: Column) -> Column:
    """``["a", "b"]`` or ``[a, b]`` or ``a, b`` as an array."""
    loose = F.filter(F.transform(F.split(F.regexp_replace(value, r"^\[|\]$", ""), ","), lambda x: unquoted(F.trim(x))), lambda x: x != "")
    return F.when(F.startswith(value, F.lit("[")), F.coalesce(F.from_json(value, "array<string>"), loose)).otherwise(loose)


def property_source(value: Column) -> Column:
    """A list, or a scalar as the only item of one."""
    return F.when(F.startswith(value, F.lit("[")), property_list(value)).when(value.isNotNull(), F.array(property_text(value)))


def locate_marker(text: Column, marker: Column, start: Column | int = 0) -> Column:
    """Place (from 0, in the collapsed text) of a section marker at or after ``start``, or -1."""
    return locate_in(collapsed(text), collapsed(marker), start)


def locate_in(norm: Column, mark: Column, start: Column | int = 0) -> Column:
    """``locate_marker`` of a marker in a text that are collapsed already.

    The whole marker, else its first 20, 12, 8, 5 or 3 longer words, else the last such
    word that is found, less 50 characters.
    """
    long = F.filter(F.split(mark, " "), lambda w: F.length(w) > 2)
    origin = (F.lit(start) if isinstance(start, int) else start) + 1

    def place(needle: Column) -> Column:
        return F.call_function("locate", needle, norm, origin.cast("int"))

    def found(needle: Column) -> Column:
        return F.when(needle != "", F.nullif(place(needle), F.lit(0)) - 1)

    tries = [found(mark)] + [F.when(F.size(long) >= n, found(F.array_join(F.slice(long, 1, n), " "))) for n in (20, 12, 8, 5, 3)]
    last = F.try_element_at(F.filter(F.transform(F.reverse(long), place), lambda p: p > 0), F.lit(1)) - 1
    return F.coalesce(*tries, F.when(last.isNotNull(), F.greatest(last - 50, F.lit(0))), F.lit(-1))


def section_title(title: Column, marker: Column, ordinal: Column) -> Column:
    """A section's title: its own, else the second line of its start marker that is not blank, else the first, else ``Section <n>``."""
    lines = F.filter(F.split(F.coalesce(marker, F.lit("")), "\n"), lambda x: stripped(x) != "")
    derived = F.when(F.size(lines) > 1, stripped(F.get(lines, F.lit(1)))).when(F.size(lines) == 1, stripped(F.get(lines, F.lit(0)))).otherwise(F.concat(F.lit("Section "), ordinal.cast("string")))
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(derived)
