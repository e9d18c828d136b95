"""The structured query language: parser, and compiler to a plan.

A query is a clause, a pattern (`~ ...`) or a text (the rest of the line). A clause is a list of items, each behind a
junction, `/\\`, `\\/` or `--` (less), all in one column; an item is again a query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lodestack.operators.index import KEYS, Index
from lodestack.operators.search import all_terms, any_match, with_metadata

# The junctions.
JUNCTIONS = {"\\/": "or", "/\\": "and", "--": "less"}


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Pattern:
    pattern: str


@dataclass(frozen=True)
class Clause:
    op: str
    items: tuple


class _Reader:
    def __init__(self, text: str):
        self.text = text

    def past_space(self, at: int) -> int:
        while at < len(self.text) and self.text[at].isspace():
            at += 1
        return at

    def column(self, at: int) -> int:
        """Bytes since the begin of the line."""
        return len(self.text[self.text.rfind("\n", 0, at) + 1 : at].encode())

    def line(self, at: int) -> tuple[str, int]:
        end = self.text.find("\n", at)
        end = len(self.text) if end < 0 else end
        return self.text[at:end].strip(), end

    def junction(self, at: int) -> tuple[str, int, int] | None:
        at = self.past_space(at)
        op = JUNCTIONS.get(self.text[at : at + 2])
        return (op, self.column(at), at + 2) if op else None

    def query(self, at: int):
        first = self.junction(at)
        if first:
            return self.clause(first)
        at = self.past_space(at)
        if self.text[at : at + 1] == "~":
            pattern, end = self.line(self.past_space(at + 1))
            return Pattern(pattern), end
        text, end = self.line(at)
        return Text(text), end

    def clause(self, first: tuple[str, int, int]):
        op, column, at = first
        item, at = self.query(at)
        items = [item]
        while (following := self.junction(at)) and following[1] == column:
            if following[0] != op:
                raise QueryError("mismatch")
            item, at = self.query(following[2])
            items.append(item)
        return (items[0] if len(items) == 1 else Clause(op, tuple(items))), at


def parse(text: str):
    """The tree of a query; QueryError if junctions of one column differ or something is left over."""
    reader = _Reader(text)
    tree, at = reader.query(0)
    if reader.past_space(at) < len(text):
        raise QueryError("leftover")
    return tree


def compile_query(tree, index: Index, tombstones: DataFrame | None = None) -> DataFrame:
    """(keys, doc_id, url) of a tree: leaves are searches, junctions set operations from the left."""
    if isinstance(tree, Text):
        return all_terms(index, tree.text, tombstones)
    if isinstance(tree, Pattern):
        return any_match(index, tree.pattern, tombstones)
    parts = [compile_query(x, index, tombstones).select(*KEYS, "doc_id", "url") for x in tree.items]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p).distinct() if tree.op == "or" else out.intersect(p) if tree.op == "and" else out.subtract(p)
    return out


def structured(text: str, index: Index, tombstones: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """The records of a query; metadata (keys, url, meta) is joined to the result only."""
    found = compile_query(parse(text), index, tombstones)
    return found if metadata is None else with_metadata(found, metadata)
