"""Operator registry: user code hooks its own operators in beside the built-in ones and can list or search them."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Operator:
    """One registered operator: its ids, the function and the first line of its docstring."""

    name: str
    ids: tuple[str, ...]
    group: str
    function: Callable
    summary: str


_OPERATORS: dict[str, Operator] = {}


def operator(*ids: str, group: str = "general") -> Callable:
    """Register the decorated function under its own name and the given operator ids."""

    def register(function: Callable) -> Callable:
        summary = (function.__doc__ or "").strip().split("\n")[0]
        _OPERATORS[function.__name__] = Operator(function.__name__, ids, group, function, summary)
        return function

    return register


def operators(group: str | None = None) -> list[Operator]:
    """All registered operators, by name; of one group if that is given."""
    return sorted((o for o in _OPERATORS.values() if group in (None, o.group)), key=lambda o: o.name)


def apropos(keyword: str) -> list[Operator]:
    """Operators whose name, id or summary holds the keyword, whatever its case."""
    wanted = keyword.lower()
    return [o for o in operators() if wanted in " ".join((o.name, *o.ids, o.summary)).lower()]


def load_operators(folder: str) -> list[Operator]:
    """Import every Python file of a user's folder, in order of name; the operators that they register are given back."""
    before = set(_OPERATORS)
    for path in sorted(Path(folder).expanduser().glob("*.py")):
        spec = importlib.util.spec_from_file_location(f"locusframe_user_{path.stem}", path)
        spec.loader.exec_module(importlib.util.module_from_spec(spec))
    return [o for o in operators() if o.name not in before]


def listing() -> list[tuple[str, str, str]]:
    """(group, name, summary) of all operators, by group."""
    return sorted((o.group, o.name, o.summary) for o in operators())
