"""What an extractor gives for one text. Lines are from 1, columns from 0."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Symbol:
    name: str
    kind: str
    start_line: int
    end_line: int
    start_col: int = 0
    end_col: int = 0
    signature: str | None = None
    docstring: str | None = None
    parent: str | None = None


@dataclass
class Reference:
    callee: str
    kind: str
    line: int
    caller: str | None = None


@dataclass
class Import:
    module: str
    name: str | None
    kind: str


@dataclass
class Literal:
    value: str
    line: int
    col: int
    context: str
    parent_fn: str | None = None


@dataclass
class Result:
    symbols: list[Symbol] = field(default_factory=list)
    references: list[Reference] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    literals: list[Literal] = field(default_factory=list)
    error: str | None = None
