import ast
import time

import pytest

from strataquery.operators import code, hunks
from strataquery.sources import python_code


def extraction(spark, *sources, relations=tuple(python_code.RELATIONS)):
    rows = [(path, bytearray(text if isinstance(text, bytes) else text.encode()), None) for path, text in sources]
    return python_code.extract(spark.createDataFrame(rows, "path string, content binary, error string"), relations)


def rows(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.collect()]


def test_inventory_tells_what_cannot_be_read(spark):
    x = extraction(spark, ("pkg/__init__.py", ""), ("tests/a.py", "x = 1\ny = 2"), ("bad.py", "def nope(:\n"), ("raw.py", b"\xff"), ("nul.py", "a\0b"), relations=())
    assert rows(code.inventory(x), "path", "module", "kind", "lines", "parse_status") == [
        ("bad.py", "bad", "module", 1, "syntax_error"), ("nul.py", "nul", "module", 1, "syntax_error"), ("pkg/__init__.py", "pkg", "package", 0, "parsed"),
        ("raw.py", "raw", "module", None, "unreadable"), ("tests/a.py", "tests.a", "test", 2, "parsed"),
    ]
    assert rows(code.warnings(x), "path", "code") == [("bad.py", "invalid_python"), ("nul.py", "invalid_python"), ("raw.py", "unreadable_file")]


def test_empty_repository(spark):
    x = python_code.extract(spark.createDataFrame([], "path string, content binary, error string"))
    for report in (code.inventory(x), code.literals(x), code.structural(x, "a"), code.guard_groups(x, "a")):
        assert report.collect() == []


def test_names(spark):
    x = extraction(spark, ("a.py", "class PaymentProcessor: pass\npayment_processor = PaymentProcessor()\ndef pay(payment): return payment\n"))
    assert rows(code.names(x, "processor payment"), "line", "name", "kind") == [(1, "PaymentProcessor", "class"), (2, "payment_processor", "assignment"), (2, "PaymentProcessor", "reference")]
    assert rows(code.neighborhood(x, "payment"), "name", "pass", "occurrences") == [("payment", "exact", 2), ("PaymentProcessor", "lexical", 2), ("payment_processor", "lexical", 1)]
    assert code.names(x, "").collect() == []


@pytest.mark.parametrize(("body", "found"), [
    ("if a:\n        return 1", (1, 2, 1)), ("for i in a:\n        if i and a or i:\n            pass", (2, 5, 2)), ("return [x for x in a if x]", (1, 2, 0)),
    ("def g():\n        if a: pass", (0, 1, 0)), ("while a:\n        break\n    else:\n        return 1 if a else 2", (2, 3, 2)),
])
def test_complexity(spark, body, found):
    x = extraction(spark, ("a.py", f"class C:\n  def f(a):\n    {body}\n"), relations=("functions",))
    first = code.complexity(x).where("qualified_name = 'C.f'").first()
    assert (first.kind, (first.branch_count, first.cyclomatic_count, first.max_nesting_depth)) == ("method", found)


def test_literals_and_groups(spark):
    x = extraction(spark, ("a.py", 'a = ["retry", "retry", 42, 42.0, 1, 1, None, None, b"z", b"z", "\\ud800"]\n'), ("b.py", "def f(a, b): return 42\ndef g(self, a, b): pass\nclass P:\n  x: int\n  y: str\n"))
    assert rows(code.literals(x), "kind", "value", "occurrence_count") == [("bytes", "7a", 2), ("integer", "42", 2), ("string", "retry", 2)]
    assert rows(code.groups(x), "kind", "members", "occurrence_count") == [("parameters", ["a", "b"], 2)]


def test_density(spark):
    x = extraction(spark, ("a.py", "def f(a: int, b: list[str], c: Order, d: Any, e: 'int', *f: Money): pass\n"), ("b.py", ""))
    assert rows(code.density(x), "path", "primitive_count", "specialized_count", "primitive_ratio") == [("a.py", 2, 2, 0.5), ("b.py", 0, 0, None)]


def test_duplicates_do_not_see_local_names(spark):
    text = "def f(a):\n    'doc'\n    b = a + 1\n    return b\ndef g(x):\n    y = x + 1\n    return y\nclass C:\n    def h(self, q):\n        r = q + 1\n        return r\ndef k(a):\n    b = a + 2\n    return b\n"
    x = extraction(spark, ("a.py", text))
    assert [[o.qualified_name for o in r.occurrences] for r in code.duplicates(x).collect()] == [["f", "g", "C.h"]]
    assert rows(code.duplicate_pairs(x), "left_qualified_name", "right_qualified_name") == [("f", "g"), ("f", "C.h"), ("g", "C.h")]
    assert len(code.duplicates_compact(x).first().digest) == 16


def test_import_graph(spark):
    x = extraction(spark, ("src/pkg/__init__.py", "from . import a\n"), ("src/pkg/a.py", "import os.path, pkg\nfrom ...far import x\n"))
    assert rows(code.imports(x), "target_module", "relative_level", "unresolved") == [("src.pkg", 1, False), ("os.path", 0, False), ("pkg", 0, False), ("far", 3, True)]
    nodes, edges = code.import_graph(x)
    assert sorted(rows(edges, "source", "target")) == [("src.pkg", "src.pkg"), ("src.pkg.a", "module:far"), ("src.pkg.a", "module:os.path"), ("src.pkg.a", "src.pkg")]
    assert sorted(r.node for r in nodes.collect()) == ["src.pkg", "src.pkg.a"]


def test_lifecycle(spark):
    text = "def f():\n    order = Order()\n    order.total = 1\n    print(order.total)\n    del order.total\n    order.items.append(3)\n    other = order\n    return order\n"
    x = extraction(spark, ("a.py", text))
    assert rows(code.operations(x, "order"), "line", "field", "kind") == [(3, "total", "field_write"), (4, "total", "field_read"), (5, "total", "field_delete"), (6, "items", "mutative_call")]
    assert rows(code.operation_transitions(x, "order"), "from_kind", "to_kind") == [("field_write", "field_read"), ("field_read", "field_delete")]
    assert rows(code.bindings(x, "order", "construction"), "line", "other") == [(2, "Order()")]
    assert rows(code.bindings(x, "order", "alias"), "other", "kind") == [("other", "source")]
    assert rows(code.bindings(x, "order", "boundary"), "kind") == [("return",)]


def test_guards_tell_what_holds_at_their_effects(spark):
    text = "def f(order):\n    if order.status == 'open':\n        order.n = 1\ndef g(order):\n    if order.status != 'open':\n        return\n    go(order)\n    go(order.n)\ndef h(order):\n    if not isinstance(order, T):\n        raise E\n    order.pop(order.n)\ndef i(order):\n    if order.x is None:\n        return\n"
    x = extraction(spark, ("a.py", text))
    assert rows(code.guards(x, "order"), "line", "control_shape", "effect_when") == [(2, "enclosed_branch", "=="), (5, "early_exit", "=="), (10, "early_exit", "isinstance")]
    assert rows(code.guard_groups(x, "order"), "field", "effect_when", "occurrence_count", "modifications", "accesses") == [("", "isinstance", 1, 1, 0), ("status", "==", 2, 1, 1)]


def test_discriminations_and_encounters(spark):
    text = "class Kind(Enum):\n    A = 1\n    B = 2\ndef f(k):\n    if k == Kind.A or Kind.B is k or k != Kind.B: pass\n    return {Kind.A: 1}[Kind.B], k.run(k), g(k, z=k), k < Kind.A\n"
    x = extraction(spark, ("a.py", text))
    assert rows(code.declarations(x, "Kind"), "kind", "members") == [("enum", ["A", "B"])]
    assert rows(code.discriminations(x, "Kind"), "kind", "operator", "member") == [("comparison", "==", "A"), ("comparison", "is", "B"), ("subscript", None, "B"), ("dict_key", None, "A")]
    met = {(r.neighbor, r.relationship): r["count"] for r in code.behavioral(x, "k").collect()}
    assert met == {("Kind", "type/enum comparison"): 3, ("run", "method call"): 1, ("run", "field access"): 1, ("g", "passed as argument"): 2}


def test_structural_and_scopes(spark):
    x = extraction(spark, ("a.py", "def f(seed, b):\n    return seed + b\ndef g(c): return c\n"), ("b.py", "from m import seed\n"))
    got = {(r.name, r.reason): r.weight for r in code.structural(x, "seed").collect()}
    assert got == {
        ("b", "shared file"): 1, ("c", "shared file"): 1, ("f", "shared file"): 1, ("g", "shared file"): 1, ("b", "repeated co-occurrence"): 2,
        ("c", "repeated co-occurrence"): 2,
        ("b", "AST adjacency"): 2, ("b", "shared scope"): 1, ("m", "import target"): 1,
    }
    assert rows(code.shared_scopes(x, ["seed", "b"]), "path", "scope", "occurrences") == [("a.py", "f", 4)]


def test_cluster(spark):
    text = "def f(a, b):\n    if a and b:\n        while b:\n            a = c = b\n            self.a = 1\n        else:\n            del a\n    elif b:\n        return a\n    x = a\n    if (a := b): pass\na = b = 0\ndef g(b): return a\n"
    x = extraction(spark, ("a.py", text), ("bad.py", "def nope(:\n"))
    seen = {(r.line, r.column, r.role): [(g.kind, g.branch, g.expression, g.depth) for g in r.guards] for r in code.cluster(x, ["a", "b"]).collect() if r.name == "a" and r.line < 10}
    both = ("if", "body", "a and b", 1)
    assert seen == {
        (1, 6, "parameter"): [], (2, 7, "read"): [], (4, 12, "write"): [both, ("while", "body", "b", 2)], (7, 16, "delete"): [both],
        (9, 15, "read"): [("if", "else", "a and b", 1), ("if", "body", "b", 2)],
    }
    assert rows(code.shared_scopes(x, ["a", "b"]), "scope", "occurrences") == [("", 2), ("f", 13), ("g", 2)]
    assert rows(code.shared_guards(x, ["a", "b"]), "line", "kind", "expression", "depth") == [(2, "if", "a and b", 1), (3, "while", "b", 2)]
    assert rows(code.cluster_constructions(x, ["a"]), "line", "target", "kind", "value") == [
        (4, "a", "assignment", "b"), (5, "self.a", "attribute_assignment", "1"), (11, "a", "named_assignment", "b"), (12, "a", "assignment", "0"),
    ]
    assert rows(code.cluster_aliases(x, ["a"]), "line", "name", "source", "target") == [(10, "a", "a", "x")]
    assert rows(code.cluster_boundaries(x, ["a"]), "line", "kind", "scope") == [(1, "parameter", "f"), (9, "return", "f"), (13, "return", "g")]
    assert code.shared_guards(x, ["a", "none"]).collect() == [] and code.cluster(x, ["none"]).collect() == []


def test_affinities(spark):
    text = "def a(o: Order):\n    return o.x + o.y\ndef b(p: Order):\n    p.x = p.y\nclass Order:\n    def c(self, o: Order): return o.x + o.z\n"
    assert rows(code.field_affinities(extraction(spark, ("a.py", text)), "Order"), "left_field", "right_field", "functions", "reads", "writes") == [("x", "y", 2, 3, 1)]


def test_rules(spark):
    text = "def a(o: Order):\n    return o.x == 1, o.n * 2, o.s.strip(), f'{o.x}!'\ndef b(p: Order, q: Order):\n    return 1 == p.x, 2 * q.n, p.s.strip(), f'{p.x}{q.x}', p.x == q.n\nclass Order:\n    def c(self, o: Order): return o.x == 1\ndef test_b():\n    b(1, 2)\n"
    x = extraction(spark, ("a.py", text))
    assert rows(code.repeated_rules(x, "Order"), "kind", "field", "operator", "value", "occurrence_count") == [("calculation", "n", "*", "2", 2), ("call", "s", "strip", "", 2), ("comparison", "x", "==", "1", 2)]
    assert rows(code.rule_tests(x, "Order"), "test", "symbol") == [("test_b", "b")]


def test_comprehension_sites(spark):
    x = extraction(spark, ("a.py", "def f(a):\n    return {k: (v if v else [w for w in v]) for k, v in a if k if v}, [x for y in a for x in y]\n"), relations=("sites",))
    found = python_code.relation(x, "sites").where("kind = 'comprehension'").orderBy("column")
    assert rows(found, "column", "end_column", "generator_count", "filter_count", "conditional_result", "nested_comprehension") == [(11, 68, 1, 2, True, True), (28, 42, 1, 0, False, False), (70, 95, 2, 0, False, False)]


def test_tests(spark):
    text = "from m import pay as p, charge\nimport m\ndef test_a():\n    p()\n    m.pay()\ndef test_b():\n    charge = 1\n    charge\ndef other(): p()\n"
    x = extraction(spark, ("test_a.py", text))
    told = lambda symbol: [(r.qualified_name, r.kind, r.line, [(e.kind, e.name, e.expression) for e in r.evidence]) for r in code.tests(x, [symbol]).collect()]
    assert told("pay") == [("test_a", "function", 3, [("imported_alias", "p", "p()"), ("imported_module_attribute", "pay", "m.pay")])]
    assert told("charge") == [("test_b", "function", 6, [("shadowed_name", "charge", "charge")])]
    assert rows(code.matching_imports(x, "pay"), "line", "module", "local_name") == [(1, "m", "p"), (2, "m", "m")]
    assert told("none") == [] and code.matching_imports(x, "none").collect() == []


def test_tests_see_what_functions_bind(spark):
    text = "import a.b as c, d.e\nclass T:\n    def test_m(self):\n        from z import pay\n        [pay for pay in d.e.charge]\n        with pay() as charge: charge\n        def inner(): refund()\n        c.refund\ndef test_n(refund):\n    refund\ndef outer():\n    def test_o(): pay()\n"
    x = extraction(spark, ("test_b.py", text))
    told = lambda symbol: [(r.qualified_name, r.kind, [(e.kind, e.line) for e in r.evidence]) for r in code.tests(x, [symbol]).collect()]
    assert told("pay") == [("T.test_m", "method", [("imported_name", 5), ("imported_name", 6)])]
    assert told("charge") == [("T.test_m", "method", [("imported_module_attribute", 5), ("exact_name", 6)])]
    assert told("refund") == [("T.test_m", "method", [("imported_module_attribute", 8)]), ("test_n", "function", [("exact_name", 10)])]


def patch(path, *parts):
    return (f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n" + "\n".join(parts) + "\n").encode()


def matched(spark, a, b):
    frame = hunks.hunks(spark.createDataFrame([("t", "x", bytearray(a)), ("p", "x", bytearray(b)), ("merge", None, None)], "commit string, parent string, patch binary"))
    topic = frame.where("commit = 't'")
    found = hunks.match(topic, frame.where("commit = 'p'"))
    return rows(found, "method", "overlap", "shared_context"), hunks.unmatched(topic, found).count()


def test_hunk_matches(spark):
    assert matched(spark, patch("a", "@@ -1 +4 @@", "-x", "+y  "), patch("b", "@@ -20 +40 @@", "-x", "+y")) == ([("exact_normalized_body", 0, [])], 0)
    assert matched(spark, patch("a", "@@ -1,3 +10,3 @@", "+a"), patch("a", "@@ -1,3 +11,3 @@", "+b")) == ([("range_overlap", 2, [])], 0)
    assert matched(spark, patch("a", "@@ -1,4 +1,4 @@", " context", "+a"), patch("a", "@@ -20,4 +20,4 @@", " context", "+b")) == ([("context_overlap", 1, ["context"])], 0)
    assert matched(spark, patch("a", "@@ -1 +1 @@", "+a"), b"") == ([], 1)


def test_added_branches_have_new_line_numbers(spark):
    raw = patch("a.py", "@@ -1,2 +10,4 @@", " x", "-if gone:", "+    if new:", "+elif no:", "+formal = 1", "+for i in x:")
    frame = hunks.hunks(spark.createDataFrame([("t", bytearray(raw))], "commit string, patch binary"))
    assert rows(hunks.added_branches(frame, ("if", "for")), "line", "keyword") == [(11, "if"), (14, "for")]


def test_segments_are_those_of_ast():
    text = "def f(\x0c a='é\x0c',\r\n b=1):\r    x = (a,\n 'ü', b)\n    return x\x0c\nclass C:\n    y = '''1\r\n2\x0b3'''"
    m = python_code.Module("a.py", text, ast.parse(text))
    placed = [n for n in m.nodes if hasattr(n, "end_lineno")]
    assert len(placed) > 12 and [m.segment(n) for n in placed] == [ast.get_source_segment(text, n) for n in placed]


def test_scopes_and_kinds_are_in_the_order_of_the_walk():
    text = "class A:\n    def f(self, a):\n        def g(): return a\n        return g\nasync def h(): pass\n"
    m = python_code.Module("a.py", text, ast.parse(text))
    assert [m.qualified(n) for n in m.all(ast.AsyncFunctionDef, ast.FunctionDef, ast.ClassDef)] == ["A", "h", "A.f", "A.f.g"]
    assert m.scope(m.all(ast.Return)[-1]) == "A.f.g"


def test_time_of_an_extraction_grows_with_the_file():
    def seconds(n):
        text = "".join(f"def f{i}(a):\n    if a.x:\n        a.y = b = {i}\n    return a\n\n\n" for i in range(n))
        m = python_code.Module("a.py", text, ast.parse(text))
        began = time.process_time()
        assert sum(len(list(read(m))) for read in (python_code.variables, python_code.constructions, python_code.bindings)) > 5 * n
        return time.process_time() - began

    assert seconds(1600) < 30 * min(seconds(100) for _ in range(3)) + 0.5
