"""Boolean queries as one column: AND, OR, NOT, parentheses, quotes and ``field:value``."""

from __future__ import annotations

import re

from pyspark.sql import Column

from ..operators.search import contains_term

_FIELDS = {"name": ("name",), "type": ("entity_type",), "entitytype": ("entity_type",), "observation": ("observations",), "observations": ("observations",), "tag": ("tags",), "tags": ("tags",)}
_ALL = ("name", "entity_type", "observations", "tags")
#: Limits of a query (fixed values).
MAX_LENGTH, MAX_TERMS, MAX_DEPTH = 5000, 50, 10


class QueryError(ValueError):
    """The query is malformed or too large."""


def compile_query(query: str) -> Column:
    """A predicate over (name, entity_type, observations, tags).

    OR binds least, then AND (also between neighbours), then NOT.  An unknown field
    searches all fields.  Matching is by substring, without case.
    """
    if len(query) > MAX_LENGTH:
        raise QueryError(f"a query has {MAX_LENGTH} characters at most")
    tokens = re.findall(r'[()]|(?:[A-Za-z]+:)?"[^"]*"|[^\s()"]+', query)
    if sum(t not in ("(", ")") and t.upper() not in ("AND", "OR", "NOT") for t in tokens) > MAX_TERMS:
        raise QueryError(f"a query has {MAX_TERMS} terms at most")
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def either(depth: int) -> Column:
        out = both(depth)
        while (peek() or "").upper() == "OR":
            take()
            out = out | both(depth)
        return out

    def both(depth: int) -> Column:
        out = single(depth)
        while peek() is not None and peek() != ")" and peek().upper() != "OR":
            if peek().upper() == "AND":
                take()
            out = out & single(depth)
        return out

    def single(depth: int) -> Column:
        token = peek()
        if token is None or token == ")" or token.upper() in ("AND", "OR"):
            raise QueryError("a term is missing")
        take()
        if token.upper() == "NOT":
            return ~single(depth)
        if token == "(":
            if depth >= MAX_DEPTH:
                raise QueryError(f"parentheses are nested {MAX_DEPTH} deep at most")
            out = either(depth + 1)
            if peek() != ")":
                raise QueryError("a parenthesis is not closed")
            take()
            return out
        field, _, value = token.partition(":")
        if value and re.fullmatch("[A-Za-z]+", field):
            return contains_term(value.strip('"'), _FIELDS.get(field.lower(), _ALL))
        return contains_term(token.strip('"'), _ALL)

    if not tokens:
        raise QueryError("the query is empty")
    out = either(0)
    if peek() is not None:
        raise QueryError("a parenthesis was not opened")
    return out
