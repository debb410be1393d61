"""Programs of our own, counted by hand after the rules: what makes a way, an operand, an operation, and what has no count."""

import ast

import pytest

from strataquery.sources.structure import measured


def counted(text, measure):
    return measured(ast.parse(text).body[0], measure)


def guarded(n):
    """A function that leaves early n times: each guard adds one way."""
    return "def f(box):\n" + "".join(f"    if box == {i}:\n        return {i}\n" for i in range(n)) + "    return None\n"


def stacked(n):
    """A function with n decisions, one behind the other, each with two ways on."""
    return "def f(box):\n" + "".join(f"    if box.f{i}:\n        use(box)\n    else:\n        drop(box)\n" for i in range(n))


@pytest.mark.parametrize("n", [1, 2, 5])
def test_ways_add_up(n):
    assert counted(guarded(n), "paths")["count"] == n + 1
    assert counted(stacked(n), "paths")["count"] == n + 1


def test_ways_of_loops_handlers_and_expressions():
    nested = "def f(rows):\n" + "    for row in rows:\n        for cell in row:\n            keep(cell)\n"
    assert counted(nested, "paths")["count"] == 4  # a loop's body is passed or not, and so is the loop in it
    handled = "def f(door):\n    try:\n        door.open()\n    except Jammed:\n        kick(door)\n    except Locked:\n        unlock(door)\n"
    assert counted(handled, "paths")["count"] == 3
    chosen = "def f(door):\n    return (1 if door.left else 2) if door else 3\n"
    assert counted(chosen, "paths")["count"] == 3
    gathered = "def f(rows):\n    return {row: [cell for cell in row if cell] for row in rows}\n"
    assert counted(gathered, "paths")["count"] == 1
    assert counted("def f(x):\n    return x\n    if x:\n        use(x)\n", "paths")["count"] == 1


@pytest.mark.parametrize("statement", [
    "while x:\n        continue", "for x.y in z:\n        pass", "for y in z:\n        pass\n    else:\n        use(z)", "del x", "with x as y:\n        pass",
    "try:\n        use(x)\n    except* E:\n        pass", "try:\n        use(x)\n    except E:\n        pass\n    else:\n        use(x)", "use(lambda: x)", "assert x", "y = yield x",
])
def test_ways_that_are_not_defined(statement):
    found = counted(f"def f(x, z):\n    {statement}\n", "paths")
    assert found["count"] is None and found["diagnostic"]


def test_operands():
    assert counted("def f(first, *, second=1, **more):\n    'says what'\n    return first\n", "operands")["count"] == 3
    chains = "def f(car):\n    car.engine.start(car.key, 'now', 3, 3, 3.0)\n"
    assert counted(chains, "operands")["count"] == 6  # car; car.engine.start, car.key; a text, a whole number, a float
    assert counted("def f(x):\n    def inner(y):\n        return y + z\n", "operands")["count"] == 1
    assert counted("def f(x):\n    return lambda: x\n", "operands")["count"] is None


def test_operations():
    assert counted("def f(car):\n    car.speed += 2 * car.gear[1]\n", "operations")["count"] == 6  # two for +=, a product, two attributes, a subscript
    assert counted("def f(a, b):\n    c: int = a\n    d: int\n    return a < b <= c and not b\n", "operations")["count"] == 5  # one assignment, two comparisons, and, not
    assert counted("def f(a):\n    return (a, [a], {a}, {a: a}, [b for b in a])\n", "operations")["count"] == 5
    for odd in ("while a:\n        pass", "import b", "assert a", "use(*a)", "b = f'{a}'"):
        assert counted(f"def f(a):\n    {odd}\n", "operations")["count"] is None
