"""Statements and expressions as the parser makes them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: int | float | str | None


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Unary:
    op: str  # "-" or "NOT"
    of: object


@dataclass(frozen=True)
class Binary:
    op: str  # + - * / = != < <= > >= AND OR
    left: object
    right: object


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None
    text: str


@dataclass(frozen=True)
class Select:
    items: list[Item]
    table: str
    where: object | None = None
    limit: object | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    values: list[Literal]


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type_name: str
    constraints: tuple[str, ...] = ()


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: list[ColumnDef]
    query: str = ""


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: list[str] = field(default_factory=list)
    unique: bool = False
    if_not_exists: bool = False
