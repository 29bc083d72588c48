"""Search query trees and the warnings a search may give."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Query:
    pass


@dataclass(frozen=True)
class Field:
    """kind: all (title or text), title, text, notes or metadata (then with a name)."""

    kind: str = "all"
    name: str = ""


ALL_FIELD = Field()


@dataclass(frozen=True)
class Everything(Query):
    pass


@dataclass(frozen=True)
class And(Query):
    nodes: tuple[Query, ...]


@dataclass(frozen=True)
class Or(Query):
    nodes: tuple[Query, ...]


@dataclass(frozen=True)
class Not(Query):
    node: Query


@dataclass(frozen=True)
class Leaf(Query):
    field: Field
    text: str


@dataclass(frozen=True)
class Phrase(Leaf):
    pass


@dataclass(frozen=True)
class Prefix(Leaf):
    pass


@dataclass(frozen=True)
class Fuzzy(Leaf):
    distance: int | None = None


@dataclass(frozen=True)
class Proximity(Leaf):
    slop: int = 0


@dataclass(frozen=True)
class Regex(Leaf):
    pass


@dataclass(frozen=True)
class Warn:
    """kind: TooManyExpansions, TooMuchFuzz, IndexDoesNotExist, RegexSyntaxError, NestedRegexIgnored, RegexLimited, MissingField, ViewFilterError."""

    kind: str
    about: str = ""
    detail: str = ""


def flat(query: Query) -> Query:
    """Ands within ands, and ors within ors, become one."""
    if isinstance(query, Not):
        return Not(flat(query.node))
    if isinstance(query, (And, Or)):
        kind, nodes = type(query), []
        for node in map(flat, query.nodes):
            nodes.extend(node.nodes if isinstance(node, kind) else [node])
        return kind(tuple(nodes))
    return query


def leaves(query: Query):
    if isinstance(query, Leaf):
        yield query
    elif isinstance(query, Not):
        yield from leaves(query.node)
    elif isinstance(query, (And, Or)):
        for node in query.nodes:
            yield from leaves(node)


def missing_fields(query: Query, known: list[str]) -> list[Warn]:
    names = dict.fromkeys(x.field.name for x in leaves(query) if x.field.kind == "metadata")
    return [Warn("MissingField", n, ", ".join(known)) for n in names if n not in known]
