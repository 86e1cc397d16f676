"""Boolean conditions written as text, turned into column expressions; nothing is ever evaluated as code."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<op>==|!=|>=|<=|>|<)|(?P<par>[()])|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_][\w.]*))")
_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of every token; anything else in the text raises ValueError."""
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read the condition at: {text[at:]!r}")
        kind = m.lastgroup
        word = m.group(kind)
        out.append(("logic", word) if kind == "word" and word in ("and", "or") else (kind, word))
        at = m.end()
    return out


def condition(text: str, operand: Callable[[str], Column]) -> tuple[Column, list[str]]:
    """The condition as a boolean column, and the keys in it. `and` binds closer than `or`; parentheses group.

    A comparison has a key on one side and a number on the other; operand(key) gives the key's numeric column.
    """
    todo, keys = tokens(text), []

    def take(*kinds: str) -> str:
        if not todo or todo[0][0] not in kinds:
            raise ValueError(f"expected {' or '.join(kinds)} at: {' '.join(t for _, t in todo) or 'the end'}")
        return todo.pop(0)[1]

    def side() -> tuple[Column, bool]:
        if todo and todo[0][0] == "number":
            return F.lit(float(take("number"))), False
        key = take("word", "number")
        keys.append(key)
        return operand(key), True

    def comparison() -> Column:
        if todo and todo[0] == ("par", "("):
            take("par")
            inner = alternatives()
            if take("par") != ")":
                raise ValueError("a closing parenthesis is missing")
            return inner
        left, left_key = side()
        op = take("op")
        right, right_key = side()
        if left_key == right_key:
            raise ValueError("a comparison needs one key and one number")
        return _OPS[op](left, right)

    def conjunction() -> Column:
        out = comparison()
        while todo and todo[0] == ("logic", "and"):
            take("logic")
            out = out & comparison()
        return out

    def alternatives() -> Column:
        out = conjunction()
        while todo and todo[0] == ("logic", "or"):
            take("logic")
            out = out | conjunction()
        return out

    result = alternatives()
    if todo:
        raise ValueError(f"left over: {' '.join(t for _, t in todo)}")
    return result, keys
