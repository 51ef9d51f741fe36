"""Boolean expressions over names: ``a & (b | ~c)`` as Spark conditions.

Names may hold any characters but the operators and parentheses; blanks around them are
ignored.  Precedence: ``~`` before ``&`` before ``|``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = "&|~()"


def tokens(text: str) -> list[str]:
    out, name = [], ""
    for ch in text + "\0":
        if ch in OPERATORS or ch == "\0":
            if name.strip():
                out.append(name.strip())
            name = ""
            if ch != "\0":
                out.append(ch)
        else:
            name += ch
    return out


def parse(text: str):
    """A tree of ("name", x), ("not", t), ("and", a, b) and ("or", a, b)."""
    rest = tokens(text)

    def any_of():
        left = all_of()
        while rest and rest[0] == "|":
            rest.pop(0)
            left = ("or", left, all_of())
        return left

    def all_of():
        left = one()
        while rest and rest[0] == "&":
            rest.pop(0)
            left = ("and", left, one())
        return left

    def one():
        if not rest:
            raise ValueError(f"an operand is missing in {text!r}")
        head = rest.pop(0)
        if head == "~":
            return ("not", one())
        if head == "(":
            inner = any_of()
            if not rest or rest.pop(0) != ")":
                raise ValueError(f"a parenthesis is open in {text!r}")
            return inner
        if head in OPERATORS:
            raise ValueError(f"{head!r} is out of place in {text!r}")
        return ("name", head)

    tree = any_of()
    if rest:
        raise ValueError(f"{rest[0]!r} is out of place in {text!r}")
    return tree


def names(tree) -> list[str]:
    """The distinct names of a tree, in order."""
    if tree[0] == "name":
        return [tree[1]]
    return list(dict.fromkeys(n for t in tree[1:] for n in names(t)))


def column(tree, has) -> Column:
    """The condition of a tree; ``has(name)`` is the condition that a name is there."""
    kind = tree[0]
    if kind == "name":
        return has(tree[1])
    if kind == "not":
        return ~column(tree[1], has)
    a, b = (column(t, has) for t in tree[1:])
    return a & b if kind == "and" else a | b


def over_set(text: str, names_col: str) -> Column:
    """The condition over an array column of names."""
    return column(parse(text), lambda n: F.array_contains(names_col, n))
