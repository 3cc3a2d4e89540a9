"""Properties that lines alone cannot tell: block scalars, nested mappings and lists of mappings.

``text.property_map`` reads flat properties as expressions of Spark's own. Blocks that ``is_nested``
finds are read here, in Arrow batches: a line belongs to the last key or list mark that is less indented than it.
Values come out as they would be written on one line, strings and structures as JSON, so that ``property_text`` and ``property_list`` read
them alike.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

BLOCK = re.compile(r"([|>])(?:([1-9])?([+-])?|([+-])([1-9]))[ \t]*(?:#.*)?$")
KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#:'"\[{-][^:]*|-[^\s:][^:]*?)[ \t]*:(?:[ \t]+|$)""")
NESTED = r"(?m)^[^\s:#][^:\n]*:[ \t]*(?:[|>][+-]?[1-9]?[+-]?[ \t]*(?:#.*)?$|(?:#[^\n]*)?\n(?:[ \t]*\n)*[ \t]+(?!-[ \t])[^\s:#][^:\n]*:(?:[ \t]|$)|(?:\n[ \t]*)+-[ \t]+(?:-[ \t]|[^\s:#\"'\[][^:\n]*:(?:[ \t]|$)))"


class NotAMapping(ValueError):
    pass


def scalar(text: str):
    """A value on one line: a string without its quotes and escapes, a flow list, or the text without a comment."""
    if text[:1] == '"':
        m = re.match(r'"(?:[^"\\]|\\.)*"', text)
        if not m:
            raise NotAMapping("a string has no end")
        try:
            return json.loads(m.group())
        except ValueError:
            return m.group()[1:-1]
    if text[:1] == "'":
        m = re.match(r"'(?:[^']|'')*'", text)
        if not m:
            raise NotAMapping("a string has no end")
        return m.group()[1:-1].replace("''", "'")
    if text[:1] == "[":
        m = re.match(r"""\[((?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\]"'])*)\]""", text)
        if m:
            return [scalar(x.strip()) for x in re.findall(r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,"'])+""", m.group(1)) if x.strip()]
    text = re.sub(r"(?:^|\s)#.*$", "", text).strip()
    return None if text in ("", "~", "null") else text


class Lines:
    def __init__(self, block: str):
        self.rows = block.expandtabs(1).split("\n")
        self.at = 0

    def next(self) -> tuple[int, str] | None:
        """Indent and text of the next line that is neither blank nor a comment."""
        while self.at < len(self.rows):
            text = self.rows[self.at].strip()
            if text and not text.startswith("#") and text not in ("---", "..."):
                return len(self.rows[self.at]) - len(self.rows[self.at].lstrip()), text
            self.at += 1
        return None

    def node(self, least: int):
        """The mapping, list or scalar that starts at the next line, if that is indented by ``least``."""
        found = self.next()
        if found is None or found[0] < least:
            return None
        indent, text = found
        if text == "-" or text.startswith("- "):
            return self.list(indent)
        return self.mapping(indent) if KEY.match(text) else self.continued("", least)

    def mapping(self, indent: int) -> dict:
        out = {}
        while (found := self.next()) is not None and found[0] == indent and (m := KEY.match(found[1])):
            self.at += 1
            key = scalar(m.group(1))
            out[key if isinstance(key, str) else str(key)] = self.value(found[1][m.end() :], indent, True)
        if found is not None and found[0] > indent:
            raise NotAMapping("a line is indented without reason")
        return out

    def list(self, indent: int) -> list:
        out = []
        while (found := self.next()) is not None and found[0] == indent and (found[1] == "-" or found[1].startswith("- ")):
            inside = found[1][1:].lstrip()
            step = len(found[1]) - len(inside)
            if inside.startswith("- ") or KEY.match(inside):  # the item's own first line, as if it stood alone
                self.rows[self.at] = " " * (indent + step) + inside
                out.append(self.node(indent + step))
            else:
                self.at += 1
                out.append(self.value(inside, indent, False))
        return out

    def value(self, text: str, indent: int, of_key: bool):
        """What follows a key or list mark: a block scalar, a value with its lines, or a node of its own. A key's list may stand at its own indent."""
        header = BLOCK.match(text)
        if header:
            return self.block(header, indent)
        if text and not text.startswith("#"):
            return self.continued(text, indent + 1)
        found = self.next()
        if of_key and found is not None and found[0] == indent and (found[1] == "-" or found[1].startswith("- ")):
            return self.list(indent)
        return self.node(indent + 1)

    def continued(self, text: str, least: int):
        parts = [text] if text else []
        while (found := self.next()) is not None and found[0] >= least:
            parts.append(found[1])
            self.at += 1
        whole = " ".join(parts)
        if whole[:1] not in ('"', "'", "[") and re.search(r":(?:\s|$)", re.sub(r"(?:^|\s)#.*$", "", whole)):
            raise NotAMapping("a key stands inside a value")
        return scalar(whole)

    def block(self, header: re.Match, indent: int) -> str:
        folded, keep = header.group(1) == ">", header.group(3) or header.group(4) or ""
        given = header.group(2) or header.group(5)
        rows = []
        while self.at < len(self.rows):
            row = self.rows[self.at]
            if row.strip() and len(row) - len(row.lstrip()) <= indent:
                break
            rows.append(row)
            self.at += 1
        width = indent + int(given) if given else next((len(r) - len(r.lstrip()) for r in rows if r.strip()), 0)
        rows = [r[width:] if r.strip() else r[width:].strip(" ") for r in rows]
        end = len(rows)
        while end and not rows[end - 1]:
            end -= 1
        tail, rows = len(rows) - end, rows[:end]
        if not folded:
            text = "\n".join(rows)
        else:
            text, gap = "", 0
            for k, row in enumerate(rows):
                if not row:
                    gap += 1
                    continue
                spaced = row[0] == " " or (k and next((r for r in rows[k - 1 :: -1] if r), " ")[0] == " ")
                text += ("" if not text and not gap else "\n" * (gap + bool(spaced and text)) if gap or spaced else " ") + row
                gap = 0
        last = self.at == len(self.rows)  # the file's last line has no line end of its own
        return text + {"-": "", "+": "\n" * (tail + bool(rows) - last)}.get(keep, "\n" if rows and (tail or not last) else "")


def mapping(block: str) -> dict[str, str | None] | None:
    """Top-level keys with their values as they would be written on one line; none where the block is no mapping."""
    lines = Lines(block)
    try:
        found = lines.node(0)
        if not isinstance(found, dict) or lines.next() is not None:
            return None
    except (NotAMapping, RecursionError):
        return None
    return {k: None if v is None else json.dumps(v, ensure_ascii=False) for k, v in found.items()}


def is_nested(block: Column) -> Column:
    return F.coalesce(block.rlike(NESTED), F.lit(False))


def nested_map(block: Column) -> Column:
    """``text.property_map`` of the blocks that ``is_nested`` finds, null for others."""

    @pandas_udf("map<string,string>")
    def mappings(blocks: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else {k: v for k, v in (mapping(b) or {}).items() if v is not None} for b in blocks], dtype=object)

    return mappings(F.when(is_nested(block), block))
