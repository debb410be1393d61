"""Three sizes of a function: distinct operands, occurrences of operations, independent paths.

Each is a number, or Unsupported where the function holds syntax that the measure does not define. Functions and classes
inside a function count nothing; its docstring counts nothing.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

INNER = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
MARKS = (ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.expr_context)

#: What one node of each kind weighs as an operation; kinds that are not listed are not defined.
WEIGHTS: dict[type, Callable[[ast.AST], int]] = dict.fromkeys(
    (ast.Assign, ast.NamedExpr, ast.BinOp, ast.UnaryOp, ast.Call, ast.Attribute, ast.Subscript, ast.Set, ast.Dict, *COMPREHENSIONS), lambda n: 1
) | dict.fromkeys(
    (ast.Expr, ast.Return, ast.Raise, ast.If, ast.IfExp, ast.For, ast.Try, ast.ExceptHandler, ast.Pass, ast.Name, ast.Constant, ast.keyword, ast.Slice), lambda n: 0
) | {
    ast.AnnAssign: lambda n: int(n.value is not None), ast.AugAssign: lambda n: 2, ast.BoolOp: lambda n: len(n.values) - 1,
    ast.Compare: lambda n: len(n.ops), ast.Tuple: lambda n: int(isinstance(n.ctx, ast.Load)), ast.List: lambda n: int(isinstance(n.ctx, ast.Load)),
}


class Unsupported(ValueError):
    """The function holds syntax that a measure does not define."""


def body_of(function: ast.AST) -> list[ast.stmt]:
    return function.body[ast.get_docstring(function, clean=False) is not None :]


def refuse(n: ast.AST, measure: str) -> Unsupported:
    return Unsupported(f"{type(n).__name__} is not defined for {measure}.")


def chain(n: ast.expr) -> str | None:
    """a.b.c of attributes on a plain name."""
    parts = []
    while isinstance(n, ast.Attribute):
        parts.append(n.attr)
        n = n.value
    return ".".join([n.id, *parts[::-1]]) if isinstance(n, ast.Name) else None


def bound_names(n: ast.AST) -> Iterator[str]:
    """Names that a node binds without a Name of its own."""
    if isinstance(n, ast.Import):
        yield from (a.asname or a.name.partition(".")[0] for a in n.names)
    elif isinstance(n, ast.ImportFrom):
        yield from (a.asname or a.name for a in n.names if a.name != "*")
    elif isinstance(n, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and n.name:
        yield n.name
    elif isinstance(n, ast.MatchMapping) and n.rest:
        yield n.rest


def operands(function: ast.AST) -> int:
    """Distinct parameters, names, whole attribute chains, and constants told apart by type."""
    a = function.args
    names = {p.arg for p in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if p}
    constants = set()
    todo: list[ast.AST] = list(body_of(function))
    while todo:
        n = todo.pop()
        if isinstance(n, INNER):
            continue
        if isinstance(n, ast.Lambda):
            raise refuse(n, "operands")
        names.update(bound_names(n))
        if isinstance(n, ast.Attribute):
            names.add(chain(n) or ast.unparse(n))
            while isinstance(n, ast.Attribute):
                n = n.value
            todo += [] if isinstance(n, ast.Name) else [n]
            continue
        if isinstance(n, ast.Name):
            names.add(n.id)
        elif isinstance(n, ast.Constant):
            constants.add((type(n.value), n.value))
        todo += ast.iter_child_nodes(n)
    return len(names) + len(constants)


def operations(function: ast.AST) -> int:
    """Weighted operations. What lies inside a comprehension is not looked at, nor are annotations."""
    total, todo = 0, list(body_of(function))
    while todo:
        n = todo.pop()
        if isinstance(n, (*INNER, *MARKS)):
            continue
        if type(n) not in WEIGHTS:
            raise refuse(n, "operations")
        total += WEIGHTS[type(n)](n)
        if isinstance(n, ast.AnnAssign):
            todo += [x for x in (n.target, n.value) if x is not None]
        elif not isinstance(n, COMPREHENSIONS):
            todo += ast.iter_child_nodes(n)
    return total


def choices(*parts: ast.AST | None) -> int:
    """Paths through expressions one after the other."""
    return 1 + sum(expression_paths(p) - 1 for p in parts if p is not None)


def expression_paths(n: ast.AST) -> int:
    if isinstance(n, (ast.Await, ast.Yield, ast.YieldFrom, ast.Lambda)):
        raise refuse(n, "paths")
    if isinstance(n, COMPREHENSIONS):
        return 1
    if isinstance(n, ast.IfExp):
        return expression_paths(n.test) + expression_paths(n.body) + expression_paths(n.orelse) - 1
    return choices(*ast.iter_child_nodes(n))


def target_is_plain(n: ast.expr) -> bool:
    return isinstance(n, ast.Name) or (isinstance(n, (ast.Tuple, ast.List)) and all(map(target_is_plain, n.elts)))


def block_paths(statements: list[ast.stmt]) -> tuple[int, bool]:
    """Paths through statements, and whether none of them goes on behind; what cannot be reached does not count."""
    total = 1
    for s in statements:
        n, ends = statement_paths(s)
        total += n - 1
        if ends:
            return total, True
    return total, False


def statement_paths(s: ast.stmt) -> tuple[int, bool]:
    if isinstance(s, INNER):
        return 1, False
    if isinstance(s, (ast.Return, ast.Raise)):
        return choices(*ast.iter_child_nodes(s)), True
    if isinstance(s, ast.If):
        (then, a), (other, b) = block_paths(s.body), block_paths(s.orelse)
        return choices(s.test) + then + other - 1, a and b
    if isinstance(s, (ast.For, ast.While)) and not s.orelse:
        if isinstance(s, ast.For) and not target_is_plain(s.target):
            raise Unsupported("A loop's target other than names is not defined for paths.")
        head = choices(s.iter if isinstance(s, ast.For) else s.test)
        return head + 2 * block_paths(s.body)[0] - 1, False
    if isinstance(s, ast.Try) and s.handlers and not s.orelse and not s.finalbody:
        clauses = [block_paths(s.body), *((n + choices(h.type) - 1, ends) for h in s.handlers for n, ends in [block_paths(h.body)])]
        return sum(n for n, _ in clauses), all(ends for _, ends in clauses)
    if isinstance(s, (ast.Expr, ast.Assign, ast.AnnAssign, ast.AugAssign, ast.Pass, ast.Import, ast.ImportFrom, ast.Global, ast.Nonlocal)):
        return choices(*ast.iter_child_nodes(s)), False
    raise refuse(s, "paths")


def paths(function: ast.AST) -> int:
    return block_paths(body_of(function))[0]


MEASURES: dict[str, Callable[[ast.AST], int]] = {"operands": operands, "operations": operations, "paths": paths}


def measured(function: ast.AST, measure: str) -> dict:
    """count, or why there is none."""
    try:
        return {"count": MEASURES[measure](function), "diagnostic": None}
    except Unsupported as e:
        return {"count": None, "diagnostic": str(e)}
