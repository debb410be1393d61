"""Queries by name on small repositories."""

import json
import pytest
from test_git import commit, repository, run  # noqa: F401

from strataquery.plans.session import OPERATIONS, Session, check_examples, plain, to_json
from strataquery.plans.topic_cache import TopicCache

BOUNDS = {"since_unix_time": 1, "limit": 10}


@pytest.fixture
def session(spark, repository):  # noqa: F811
    s = Session(spark, str(repository))
    yield s
    s.close()


def data(session, name, **given):
    out = session.run(name, **given)
    assert out["status"] == "ok", out
    return plain(out["data"])


def test_rejections(session, tmp_path_factory):
    code = lambda name, **given: session.run(name, **given)["error"]["code"]
    assert code("git.nothing") == "not_implemented"
    for wrong in ({}, {"since_unix_time": 0, "limit": 1}, {"since_unix_time": 1, "limit": 5001}, {"since_unix_time": 1, "limit": True}, BOUNDS | {"odd": 1}):
        assert code("git.history", **wrong) == "invalid_query"
    assert code("git.cochange.file", path="../x", **BOUNDS) == "invalid_query"
    assert code("git.cochange.pair", left_path="a", right_path="./a", **BOUNDS) == "invalid_query"
    assert code("git.review_packet.files", paths=[], **BOUNDS) == "invalid_query"
    assert code("git.topic", commit="abcdef0123") == "repository_access_failed"
    assert code("python.variable_cluster") == "not_implemented"
    for wrong in ({"term": "a", "terms": ["a", "b"]}, {"terms": ["a"]}, {"terms": ["a", "a"]}, {"terms": ["a", "b c"]}, {"terms": list("abcdefghi")}):
        assert code("python.variable_cluster", **wrong) == "invalid_query"
    for wrong in ({"carrier": "a b"}, {"carrier": "a", "limit": 3}, {"term": "a", "since_unix_time": 3}, {}):
        assert code("python.object_lifecycle", **wrong) == "invalid_query"
    outside = Session(session.spark, str(tmp_path_factory.mktemp("plain")))
    assert outside.run("python.inventory")["error"]["code"] == "not_a_repository"


def test_history_of_a_renamed_file(session, repository):  # noqa: F811
    first = commit(repository, {"old.py": "a = 1\n" * 5, "other.py": "b = 1\n"}, "feat: start")
    run(repository, "mv", "old.py", "new.py")
    second = commit(repository, {"other.py": "b = 2\n"}, "odd")
    out = data(session, "git.cochange", **BOUNDS)
    assert out["pairs"] == [{"left_path": "new.py", "right_path": "other.py", "score": 2.0, "commit_count": 2, "contributing_commits": [second, first]}]
    assert {f["path"]: f["commits"] for f in data(session, "git.hotspots", **BOUNDS)["files"]} == {"new.py": [second, first], "other.py": [second, first]}
    cut = data(session, "git.snapshot", since_unix_time=1, limit=1)
    assert cut["provenance"]["truncated"] and [f["recent_commits"] for f in cut["files"]] == [[second], [second]]
    assert data(session, "git.cochange.pair", left_path="other.py", right_path="new.py", **BOUNDS)["pair"][0]["commit_count"] == 2
    assert data(session, "git.cochange.pair", left_path="other.py", right_path="x.py", **BOUNDS)["pair"] == []
    spread = data(session, "git.distributions", **BOUNDS)
    assert spread["summary"] == [{"minimum": 2, "maximum": 2, "average": 2.0, "unknown": 1}]
    topic = data(session, "git.topic", commit=second)
    assert [(c["path"], c["hunk_status"]) for c in topic["changes"]] == [("new.py", "rename_only"), ("other.py", "available")]
    assert data(session, "git.topic_hunks", commit=first)["status"] == "initial"
    walk = data(session, "git.topic_walk", commit=second, **BOUNDS)
    assert ([c["sha"] for c in walk["commits"]], walk["termination"]) == ([second, first], "root")


def test_family_follows_matching_hunks(session, repository):  # noqa: F811
    body = [f"line {i}\n" for i in range(30)]
    commit(repository, {"a.py": "".join(body), "z.py": "1\n"})
    shas = []
    for i, text in enumerate(["x = 1\n", "x = 2\n", "x = 3\n"]):
        body[4] = text
        shas.append(commit(repository, {"a.py": "".join(body), "z.py": f"{i}\n"} if i < 2 else {"a.py": "".join(body)}))
    out = data(session, "git.topic_family", commit=shas[2], **BOUNDS)
    assert [(m["depth"], m["commit"], m["path"]) for m in sorted(out["members"], key=lambda m: m["depth"])] == [(1, shas[1], "a.py"), (2, shas[0], "a.py")]
    assert out["termination"] == "exhausted" and out["unmatched_hunks"] == []
    assert [(e["parent_commit"], e["commit"], e["depth"], e["method"]) for e in out["ancestry_edges"]] == [(shas[2], shas[1], 1, "range_overlap"), (shas[1], shas[0], 2, "range_overlap")]
    assert [(t["commit"], t["depth"], t["status"], t["path"]) for t in out["path_transitions"]] == [(sha, d, "modified", p) for d, sha in ((1, shas[1]), (2, shas[0])) for p in ("a.py", "z.py")]
    assert out["counts"] == {"members": 2, "matches": 2, "ancestry_edges": 2, "unmatched_hunks": 0, "skipped_commits": 0, "path_transitions": 4}
    assert [(m["method"], m["depth"]) for m in out["matches"]] == [("range_overlap", 1), ("range_overlap", 2)]
    assert data(session, "git.topic_family", commit=shas[2], since_unix_time=1, limit=1)["counts"]["members"] == 0


def test_branches_and_merges(session, repository):  # noqa: F811
    first = commit(repository, {"a.py": "x = 1\n"})
    commit(repository, {"a.py": "x = 1\nif x:\n    pass\n", "b.py": "if 1: pass\n"})
    out = data(session, "git.branch_additions", path="a.py", **BOUNDS)
    assert [(e["line"], e["keyword"]) for e in out["events"]] == [(2, "if")]
    assert out["skipped"] == [{"commit": first, "reason": "root"}]


def test_all_operations_answer(session, repository):  # noqa: F811
    commit(repository, {"pkg/__init__.py": "", "pkg/order.py": "class Order:\n    x: int\n    y: int\n", "bad.py": "def nope(:\n"})
    last = commit(repository, {"pkg/use.py": "from .order import Order\n\ndef use(order: Order):\n    if order.x == 1:\n        order.y = 2\n    return order\n", "tests/test_use.py": "from pkg.use import use\n\ndef test_use():\n    use(1)\n"})
    given = {"term": "order", "seed": "order", "carrier": "order", "path": "pkg/use.py", "left_path": "pkg/use.py", "right_path": "tests/test_use.py", "paths": ["pkg/use.py"], "terms": ["order", "Order"], "commit": last, "revision": "HEAD", "lines": [1], "measure": "paths", "qualified_name": "use", "targets": [("pkg/use.py", "use")]} | BOUNDS
    for name, (_, parameters) in OPERATIONS.items():
        names = {p.rstrip("?") for p in parameters} - ({"terms"} if "term?" in parameters else set())
        out = session.run(name.replace(".", "_"), **{p: given[p] for p in names if p in given})
        assert json.loads(to_json(out))["status"] == "ok", (name, out)
    assert data(session, "python.tests", term="use")["mapping_status"] == "matched"
    assert data(session, "python.tests", term="none")["mapping_status"] == "no_mapping_found"
    topology = data(session, "python.graph_topology")["topology"]
    assert [c["size"] for c in topology["component_sizes"]] == [1, 1, 3] and topology["formulas"]["average_degree"] == "sum(degrees) / node_count"
    assert {c["node"]: c["community"] for c in topology["community_ids"]} == {"bad": 0, "pkg": 1, "pkg.order": 2, "pkg.use": 2, "tests.test_use": 2}
    assert session.run("git.review_packet.revision", term=last, **BOUNDS)["status"] == session.run("git_review_packet_revision", revision=last, **BOUNDS)["status"] == "ok"
    assert data(session, "python.term_change_evidence", term="order", **BOUNDS)["dimensions"]["ownership"]["occurrence_count"] == 1


def test_profiles(session, repository):  # noqa: F811
    text = "class C:\n    x: int\n    def f(self, a):\n        if a.x < 1:\n            self.x += 1\n        return [i for i in a]\n    def f2(self): return lambda: 1\ndef two(): pass\ndef two(): pass\n"
    commit(repository, {"a.py": text, "bad.py": "def nope(:\n"})
    out = data(session, "python.function_profiles", targets=[("a.py", "two"), ("a.py", "C.f"), ("bad.py", "nope"), ("a.py", "none"), ("a.py", "C.f2")])["profiles"]
    assert [p["match_status"] for p in out] == ["ambiguous", "found", "unavailable", "not_found", "found"]
    assert [(k["kind"], k["site_count"], k["truncated"], [x["text"] for x in k["sites"]]) for k in out[1]["sites"]] == [
        ("attribute_read", 2, False, ["a.x", "self.x"]), ("attribute_write", 1, False, ["self.x"]), ("comparison", 1, False, ["lt"]),
        ("comprehension", 1, False, ["[i for i in a]"]), ("guard", 1, False, ["a.x < 1"]),
    ]
    assert (out[1]["primitive_count"], out[1]["specialized_count"], out[1]["total_count"], out[1]["primitive_ratio"]) == (0, 0, 0, None)
    assert {m["measure"]: (m["count"], m["diagnostic"]) for m in out[4]["measures"]}["operands"] == (None, "Lambda is not defined for operands.")
    found = data(session, "python.class_profile", path="a.py", qualified_name="C", limit=1)
    assert [m["qualified_name"] for m in found["methods"]] == ["C.f"] and found["methods"][0]["method_count"] == 2
    assert (found["class"][0]["primitive_count"], found["class"][0]["primitive_ratio"]) == (1, 1.0)
    assert [(a["site_count"], a["truncated"], a["sites"]) for a in found["receiver_accesses"]] == [(1, False, [{"line": 5, "column": 12, "field": "x", "operations": ["read", "write"]}])]
    status = lambda path, name: data(session, "python.class_profile", path=path, qualified_name=name)["match_status"]
    assert (status("a.py", "D"), status("bad.py", "C"), status("none.py", "C")) == ("not_found", "unavailable", "not_found")
    assert session.run("python.structural_complexity", measure="odd")["error"]["code"] == "unsupported_measure"


def test_receivers_of_any_name(session, repository):  # noqa: F811
    text = "class C:\n    x: int\n    y: str = ''\n    def f(me, self):\n        me.x, self.y = me.z, lambda: me.y\n        del me.x\n    @staticmethod\n    def s(me): return me.x\n    def g(): pass\n" + "    def h(s):\n" + "        s.x\n" * 20
    commit(repository, {"a.py": text + "def f():\n    class C: pass\nclass D: pass\nclass D: pass\n"})
    found = data(session, "python.class_profile", path="a.py", qualified_name="C")
    assert [(a["qualified_name"], a["site_count"], a["truncated"], len(a["sites"])) for a in found["receiver_accesses"]] == [("C.f", 1, False, 1), ("C.s", 0, False, 0), ("C.g", 0, False, 0), ("C.h", 20, True, 16)]
    assert data(session, "python.class_profile", path="a.py", qualified_name="f.C")["class"][0]["total_count"] == 0
    assert data(session, "python.class_profile", path="a.py", qualified_name="D") == {"match_status": "ambiguous", "match_count": 2, "warnings": []}


def test_cluster_with_history_and_guards_of_one_file(session, repository):  # noqa: F811
    commit(repository, {"a.py": "def f(o, p):\n    if o.x == p:\n        o.x = 1\n", "b.py": "def g(o):\n    if o.x == 1:\n        o.x = 2\n"})
    out = data(session, "python.variable_cluster", terms=["o", "p"], **BOUNDS)
    assert [s["scope"] for s in out["shared_scopes"]] == ["f"] and [f["path"] for f in out["history_evidence"]["files"]] == ["a.py", "b.py"]
    assert data(session, "python.variable_cluster", term="p")["history_evidence"] is None
    assert [o["path"] for o in data(session, "python.carrier_guards", term="o")["occurrences"]] == ["a.py", "b.py"]
    assert [o["path"] for o in data(session, "python.carrier_guards", term="o", path="b.py")["occurrences"]] == ["b.py"]
    assert session.run("python.variable_cluster", terms=["o", "p q"])["status"] == "rejected"
    assert data(session, "python.neighborhood", term="o")["edges"] == [{"seed": "o", "neighbor": "o", "weight": 6, "discovery_pass": "exact", "reason": "exact identifier match"}]
    change = data(session, "python.term_change_evidence", term="o", **BOUNDS)["dimensions"]
    assert change["coupling"]["edge_count"] == 1 and [f["path"] for f in change["history"]["paths"]] == ["a.py", "b.py"]


def test_examples(spark):
    fine = [{"tool": "git_history", "arguments": {"repository_root": "."} | BOUNDS}, {"tool": "python.inventory", "arguments": {"repository_root": "."}}]
    assert check_examples(spark, fine).collect() == []
    found = check_examples(spark, [*fine, {"tool": "no"}, {}, {"tool": "git.history", "arguments": {"limit": 1, "odd": 2, "b": 1}}]).collect()
    assert [tuple(r) for r in found] == [
        (3, "unknown_tool", ["no"]), (4, "unknown_tool", ["None"]), (5, "unknown_arguments", ["b", "odd"]), (5, "missing_arguments", ["repository_root", "since_unix_time"]),
    ]


def test_topic_cache(spark, tmp_path):
    cache, key = TopicCache(spark, str(tmp_path / "topics")), {"repository_revision": "r1", "topic_sha": "abc", "matching_policy": "exact", "since_unix_time": 1, "limit": 10}
    first = cache.lookup(key).first()
    assert (first.cache_status, first.report, first.differences) == ("miss", None, [])
    cache.store(key, '{"member_count": 3}')
    cache.store(key | {"limit": 12}, "[]")
    hit = cache.lookup(key).first()
    assert (hit.cache_status, json.loads(hit.report), hit.digest) == ("hit", {"member_count": 3}, first.digest)
    later = cache.lookup(key | {"repository_revision": "r2"}).first()
    assert (later.cache_status, later.report, [tuple(d) for d in later.differences]) == ("invalidated", None, [("repository_revision", "r1", "r2")])
    assert later.digest != first.digest
    cache.store(key | {"repository_revision": "r2"}, "{}")
    assert [cache.lookup(k).first().cache_status for k in (key, key | {"limit": 11}, key | {"limit": 12})] == ["invalidated", "miss", "hit"]
    with pytest.raises(ValueError):
        cache.lookup({"topic_sha": "abc"})


def test_empty_repository_answers(session):
    assert data(session, "git.history", **BOUNDS)["commits"] == []
    assert data(session, "git.distributions", **BOUNDS)["weeks"] == []
    assert data(session, "python.graph_topology")["topology"]["node_count"] == 0
