"""Queries on one repository by name: Session(spark, path).run("git.hotspots", since_unix_time=1, limit=50).

run returns an envelope: schema_version, status, operation, query, and data (ok) or error (rejected). data holds lazy
DataFrames and plain values; to_json reads them. One extraction of the Python source, and one read of each window of the
history, serve all queries of a session; close frees them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from ..operators import code, graph, history, hunks
from ..sources import git, python_code
from ..sources.structure import MEASURES

#: The most commits of a window, paths of a packet, terms of a cluster, places in an index, targets, sites.
MOST = {"commits": 5000, "paths": 8, "terms": 8, "places": 32, "targets": 16, "sites": 16}
SHA = re.compile(r"[0-9a-fA-F]{7,40}")
REVISION = re.compile(r"[A-Za-z0-9_./-]+([~^][0-9]*)?")

OPERATIONS: dict[str, tuple[Callable[..., dict[str, Any]], tuple[str, ...]]] = {}
#: What a parameter's values are; text, if it is not named here.
TYPES = {"since_unix_time": "integer", "limit": "integer", "lines": "array of integers", "paths": "array of strings", "terms": "array of strings", "targets": "array of (path, qualified_name)"}
#: Names that callers may give to an operation's seed besides its own.
OTHER_NAMES = {"commit": ("revision", "term"), "path": ("term",), "revision": ("term",), "carrier": ("term",), "seed": ("term",)}


class Rejected(Exception):
    def __init__(self, code_: str, message: str, **more):
        super().__init__(message)
        self.error = {"code": code_, "message": message} | more


def operation(name: str, *parameters: str):
    """Register a query with its parameters; one that ends in ? may be left out."""

    def add(f):
        OPERATIONS[name] = f, parameters
        return f

    return add


def check(name: str, value: Any) -> Any:
    """A parameter's value as it is used, or Rejected."""
    bad = lambda why: Rejected("invalid_query", f"{name} {why}")
    if name in ("since_unix_time", "limit"):
        if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
            raise bad("must be a positive integer")
        if name == "limit" and value > MOST["commits"]:
            raise bad(f"must be at most {MOST['commits']}")
    elif name in ("path", "left_path", "right_path"):
        try:
            return git.safe_path(value)
        except (TypeError, ValueError) as e:
            raise bad(f"is {e}") from None
    elif name == "paths":
        if not 1 <= len(value) <= MOST["paths"]:
            raise bad(f"must be 1 to {MOST['paths']}")
        return [check("path", p) for p in value]
    elif name == "terms":
        sound = isinstance(value, (list, tuple)) and 2 <= len(value) <= MOST["terms"] and all(isinstance(t, str) and t.isidentifier() for t in value)
        if not sound or len(set(value)) < len(value):
            raise bad(f"must be 2 to {MOST['terms']} different identifiers")
    elif name == "commit" and not SHA.fullmatch(str(value)):
        raise bad("must be 7 to 40 hexadecimal digits")
    elif name == "revision" and not REVISION.fullmatch(str(value)):
        raise bad("is not a revision")
    elif name == "lines" and not (value and all(isinstance(x, int) and x > 0 for x in value)):
        raise bad("must be positive integers")
    elif name == "detail" and value != "compact":
        raise bad("must be compact")
    elif name in ("term", "seed", "carrier") and not (isinstance(value, str) and value.strip()):
        raise bad("must not be empty")
    return value


class Session:
    def __init__(self, spark: SparkSession, repository: str):
        self.spark, self.repository = spark, repository
        self.held: dict[Any, DataFrame] = {}

    def hold(self, key: Any, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in self.held:
            self.held[key] = make().persist()
        return self.held[key]

    def close(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()

    def read(self, relation: str, **options) -> DataFrame:
        return git.read(self.spark, self.repository, relation, **options)

    def source(self, paths: list[str] | None = None) -> DataFrame:
        x = self.hold("source", lambda: python_code.extract(self.read("files")))
        return x if paths is None else x.where(F.col("path").isin(paths))

    def commits(self, since_unix_time: int, limit: int, paths: str | None = "*.py", tip: str | None = None) -> DataFrame:
        """The window's commits and one more, if there is one."""
        key = ("commits", since_unix_time, limit, paths, tip)
        return self.hold(key, lambda: self.read("commits", since=since_unix_time, limit=limit, paths=paths, tip=tip).withColumn("ts", F.timestamp_seconds("committed")))

    def changes(self, since_unix_time: int, limit: int, tip: str | None = None) -> DataFrame:
        key = ("changes", since_unix_time, limit, tip)
        every = self.hold(key, lambda: self.read("changes", since=since_unix_time, limit=limit, paths="*.py", tip=tip).withColumn("ts", F.timestamp_seconds("committed")))
        return every.where(F.col("commit_seq") < limit)

    def scope(self, since_unix_time: int, limit: int, tip: str | None = None) -> dict[str, Any]:
        """Where the history was cut. The window is read with one commit too many, which tells whether there are more."""
        found = self.commits(since_unix_time, limit, tip=tip).count()
        return {
            "report_version": "1", "repository_root": self.repository, "tip_revision": tip or "HEAD", "since_unix_time": since_unix_time, "limit": limit,
            "commit_count": min(found, limit), "truncated": found > limit, "source_file_filter": {"pathspec": "*.py"},
        }

    def run(self, name: str, **given) -> dict[str, Any]:
        """The envelope of one query; what cannot be answered is rejected, with a code, not raised."""
        name = next((n for n in OPERATIONS if name == tool_name(n)), name)
        query = {"repository_root": self.repository} | {k: v for k, v in given.items() if v is not None}
        head = {"schema_version": "1", "status": "ok", "operation": name, "query": query}
        try:
            if name not in OPERATIONS:
                raise Rejected("not_implemented", "The operation is not known.", correction={"valid_operations": sorted(OPERATIONS)})
            f, parameters = OPERATIONS[name]
            known = {p.rstrip("?") for p in parameters}
            for own in (p for p in parameters if p in OTHER_NAMES):
                for other in OTHER_NAMES[own]:
                    if other in given and other not in known and own not in given:
                        given[own] = given.pop(other)
            if wrong := sorted(k for k in given if k not in known):
                raise Rejected("invalid_query", f"no such parameter: {', '.join(wrong)}")
            if missing := [p for p in parameters if not p.endswith("?") and given.get(p) is None]:
                raise Rejected("invalid_query", f"missing: {', '.join(missing)}")
            values = {k: check(k, v) for k, v in given.items() if v is not None}
            try:
                git.root_of(self.repository)
            except git.GitError as e:
                raise Rejected("not_a_repository", str(e)) from None
            if "commit" in values:
                git.git(self.repository, "rev-parse", "--verify", f"{values['commit']}^{{commit}}")
            return head | {"data": f(self, **values)}
        except Rejected as e:
            return head | {"status": "rejected", "error": e.error}
        except git.GitError as e:
            return head | {"status": "rejected", "error": {"code": "repository_access_failed", "message": str(e), "command": list(e.command), "returncode": e.returncode, "stderr": e.stderr}}


def tool_name(operation_name: str) -> str:
    return operation_name.replace(".", "_")


def contract() -> list[dict[str, Any]]:
    """Every operation with its tool's name, its parameters and their types, sorted by name. All of them only read, give the
    same answer to the same call, and look at nothing but the repository."""
    marks = {"read_only": True, "idempotent": True, "open_world": False}
    told = lambda p: {"name": p.rstrip("?"), "type": TYPES.get(p.rstrip("?"), "string"), "required": not p.endswith("?")}
    return [{"name": n, "tool": tool_name(n), "parameters": [told("repository_root"), *map(told, OPERATIONS[n][1])]} | marks for n in sorted(OPERATIONS)]


def check_examples(spark: SparkSession, examples: list[dict[str, Any]]) -> DataFrame:
    """example, problem, names: what examples {tool, arguments} get wrong against the contract, by anti-joins of the two.

    problem is unknown_tool, unknown_arguments or missing_arguments; names are sorted. Examples are numbered from 1.
    """
    declared = spark.createDataFrame([(o["tool"], p["name"], p["required"]) for o in contract() for p in o["parameters"]], "tool string, argument string, required boolean")
    called = spark.createDataFrame([(i, str(x.get("tool"))) for i, x in enumerate(examples, 1)], "example int, tool string")
    called = called.withColumn("tool", F.replace("tool", F.lit("."), F.lit("_")))
    given = spark.createDataFrame([(i, a) for i, x in enumerate(examples, 1) for a in x.get("arguments", {})], "example int, argument string").join(called, "example")
    strange = called.join(declared, "tool", "left_anti").select("example", F.lit("unknown_tool").alias("problem"), F.col("tool").alias("name"))
    known = called.join(strange, "example", "left_anti")
    odd = given.join(known.select("example"), "example", "left_semi").join(declared, ["tool", "argument"], "left_anti").select("example", F.lit("unknown_arguments").alias("problem"), F.col("argument").alias("name"))
    lacking = known.join(declared.where("required"), "tool").join(given, ["example", "tool", "argument"], "left_anti").select("example", F.lit("missing_arguments").alias("problem"), F.col("argument").alias("name"))
    return strange.unionByName(odd).unionByName(lacking).groupBy("example", "problem").agg(F.sort_array(F.collect_list("name")).alias("names")).orderBy("example", F.desc("problem"))


def plain(value: Any) -> Any:
    if isinstance(value, DataFrame):
        return [plain(r) for r in value.collect()]
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    return value


def to_json(envelope: dict[str, Any]) -> str:
    """The envelope as JSON, keys sorted. All rows of its DataFrames are read to the driver: a report, not a way to move data."""
    return json.dumps(plain(envelope), sort_keys=True, default=str)


BOUNDS = ("since_unix_time", "limit")


@operation("git.history", *BOUNDS)
def _history(s: Session, since_unix_time: int, limit: int) -> dict:
    kept = s.commits(since_unix_time, limit).where(F.col("seq") < limit).orderBy("seq")
    return {"provenance": s.scope(since_unix_time, limit), "commits": kept.select(F.col("commit").alias("sha"), "parents", "committed", "author_name", "author_email", "subject")}


@operation("git.snapshot", *BOUNDS)
def _snapshot(s: Session, since_unix_time: int, limit: int, tip: str | None = None) -> dict:
    files = history.commit_lists(s.changes(since_unix_time, limit, tip)).select("path", F.size("commits").alias("commit_count"), F.col("commits").alias("recent_commits"))
    return {"provenance": s.scope(since_unix_time, limit, tip), "files": files.orderBy("path")}


@operation("git.hotspots", *BOUNDS)
def _hotspots(s: Session, since_unix_time: int, limit: int) -> dict:
    changes = s.changes(since_unix_time, limit)
    files = history.hotspots(changes).join(history.commit_lists(changes), "path")
    return {"provenance": s.scope(since_unix_time, limit), "files": files.orderBy(F.desc("commit_count"), F.desc("changed_lines"), "path")}


@operation("git.distributions", *BOUNDS)
def _distributions(s: Session, since_unix_time: int, limit: int) -> dict:
    kept = s.commits(since_unix_time, limit).where(F.col("seq") < limit)
    weeks, kinds = history.weekly(kept), history.categories(kept)
    numbers = weeks.agg(F.min("commit_count").alias("minimum"), F.max("commit_count").alias("maximum"), F.round(F.avg("commit_count"), 2).alias("average"))
    unknown = kinds.agg(F.coalesce(F.sum(F.when(F.col("category") == "unknown", F.col("commit_count"))), F.lit(0)).alias("unknown"))
    return {"provenance": s.scope(since_unix_time, limit), "weeks": weeks.orderBy("week_start"), "categories": kinds.orderBy("category", "raw"), "summary": numbers.crossJoin(unknown)}


def _sorted_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("score"), "left_path", "right_path")


@operation("git.cochange", *BOUNDS)
def _cochange(s: Session, since_unix_time: int, limit: int) -> dict:
    changes = s.changes(since_unix_time, limit)
    return {"provenance": s.scope(since_unix_time, limit), "weighting": history.EVEN.told(), "pairs": _sorted_pairs(history.cochange(changes)), "eligibility": history.eligibility(changes)}


@operation("git.cochange.file", "path", *BOUNDS)
def _cochange_file(s: Session, path: str, since_unix_time: int, limit: int) -> dict:
    return {"provenance": s.scope(since_unix_time, limit), "pairs": _sorted_pairs(history.scoped_cochange(s.changes(since_unix_time, limit), path))}


@operation("git.cochange.pair", "left_path", "right_path", *BOUNDS)
def _cochange_pair(s: Session, left_path: str, right_path: str, since_unix_time: int, limit: int) -> dict:
    if left_path == right_path:
        raise Rejected("invalid_query", "left_path and right_path must differ")
    return {"provenance": s.scope(since_unix_time, limit), "pair": history.pair_cochange(s.changes(since_unix_time, limit), left_path, right_path).where("commit_count > 0")}


def added_branches(s: Session, since_unix_time: int, limit: int, paths: str) -> dict:
    kept = s.commits(since_unix_time, limit, paths).where(F.col("seq") < limit)
    single = [r.commit for r in kept.where("size(parents) = 1").select("commit").collect()]
    found = hunks.added_branches(hunks.hunks(s.read("patches", commits=single)), code.BRANCHES)
    skipped = kept.where("size(parents) <> 1").select("commit", F.when(F.size("parents") > 1, "merge").otherwise("root").alias("reason"))
    order = kept.select("commit", "seq")
    return {"events": found.join(order, "commit"), "skipped": skipped.orderBy("commit")}


@operation("git.branch_additions", "path", *BOUNDS)
def _branch_additions(s: Session, path: str, since_unix_time: int, limit: int) -> dict:
    out = added_branches(s, since_unix_time, limit, path)
    return out | {"events": out["events"].where(F.col("path") == path).orderBy("seq", "line").drop("seq")}


def one_commit(s: Session, sha: str) -> Row | None:
    return s.read("commits", tip=sha, limit=1).orderBy("seq").first()


def status_of(row: Row) -> str:
    return "merge" if len(row.parents) > 1 else "normal" if row.parents else "initial"


def binary_patch(patch: bytes | None) -> bool:
    return any(x == b"GIT binary patch" or x.startswith(b"Binary files ") for x in (patch or b"").splitlines())


@operation("git.topic", "commit")
def _topic(s: Session, commit: str) -> dict:
    row = one_commit(s, commit)
    patches = s.read("patches", commits=[row.commit])
    found = hunks.hunks(patches)
    changes = hunks.change_status(s.read("name_status", commits=[row.commit]), found, status_of(row), binary_patch(patches.first().patch))
    told = {"sha": row.commit, "parents": row.parents, "committed": row.committed, "subject": row.subject, "status": status_of(row)}
    return told | {"changes": changes.orderBy("path"), "hunks": found.orderBy("seq")}


@operation("git.topic_hunks", "commit")
def _topic_hunks(s: Session, commit: str) -> dict:
    row = one_commit(s, commit)
    none = {"commit": row.commit, "hunks": []}
    if len(row.parents) != 1:
        return none | ({"status": "merge", "uncertainties": ["multiple_parents"]} if row.parents else {"status": "initial", "uncertainties": ["no_parent"]})
    patches = s.read("patches", commits=[row.commit])
    patch = bytes(patches.first().patch)
    found = hunks.hunks(patches)
    odd = [] if patch.decode("utf-8", "replace").encode() == patch else ["non_utf8_patch"]
    n = found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fingerprint").alias("k")).first()
    if binary_patch(patch):
        status, odd = "binary", ["binary_patch"]
    elif not n.n:
        status, odd = ("encoding", odd) if odd else ("no_hunks", ["no_unified_hunks"])
    else:
        status, odd = ("ambiguous", [*odd, "duplicate_fingerprints"]) if n.n > n.k else ("available", odd)
    return {"commit": row.commit, "hunks": found.orderBy("seq"), "status": status, "uncertainties": odd}


def first_parents(s: Session, commit: str, since_unix_time: int, limit: int) -> tuple[list[dict], str]:
    """The chain of first parents from a commit on, and why it ends. The window is bounded by limit, so it is walked here."""
    known = {r.commit: r for r in s.commits(since_unix_time, limit + 1, None, commit).collect()}
    row = next((r for sha, r in known.items() if sha.startswith(commit.lower())), None)
    chain: list[dict] = []
    end = "missing_topic"
    while row is not None and len(chain) < limit:
        merge = len(row.parents) > 1
        chain.append({"depth": len(chain), "sha": row.commit, "parents": row.parents, "skipped": "merge" if merge else None})
        end = "merge_encountered" if merge else "parent_unavailable" if row.parents else "root"
        row = None if merge or not row.parents else known.get(row.parents[0])
    return chain, "limit" if len(chain) >= limit and end == "parent_unavailable" else end


@operation("git.topic_walk", "commit", *BOUNDS)
def _topic_walk(s: Session, commit: str, since_unix_time: int, limit: int) -> dict:
    chain, end = first_parents(s, commit, since_unix_time, limit)
    shas = [c["sha"] for c in chain]
    return {"commits": chain, "termination": end, "changes": s.read("name_status", commits=shas), "hunks": hunks.hunks(s.read("patches", commits=shas))}


@operation("git.topic_family", "commit", *BOUNDS)
def _topic_family(s: Session, commit: str, since_unix_time: int, limit: int) -> dict:
    """Backward from a commit's hunks: the hunks of each parent in turn that match the hunks matched last.

    A commit that shares no body, path or context line with the hunks matched last is passed over without a comparison, so
    there is a round for each commit that may have kin, not for each commit.
    """
    chain, _ = first_parents(s, commit, since_unix_time, limit)
    shas = [c["sha"] for c in chain]
    every = s.hold(("hunks", tuple(shas)), lambda: hunks.hunks(s.read("patches", commits=shas)))
    topic = every.where(F.col("commit") == shas[0]) if shas else every.limit(0)
    active, steps, members, end = topic, [], 0, "exhausted"
    single = [c for c in chain[1:] if len(c["parents"]) == 1]
    places = s.spark.createDataFrame([(c["sha"], i) for i, c in enumerate(single, 1)], "commit string, depth int")
    known = s.hold(("hunk keys", tuple(shas)), lambda: hunks.keys(every).join(places, "commit").select("key", "depth").distinct())
    depth = 0
    while depth < len(single):
        if members >= limit:
            end = "limit"
            break
        depth = known.where(F.col("depth") > depth).join(hunks.keys(active), "key", "left_semi").agg(F.min("depth").alias("depth")).first().depth
        if depth is None:
            break
        prior = every.where(F.col("commit") == single[depth - 1]["sha"])
        found = checkpointed(hunks.match(active, prior).withColumn("depth", F.lit(depth)))
        reached = prior.join(found.select(F.col("prior_seq").alias("seq")).distinct(), "seq", "left_semi").dropDuplicates(["hunk_id"])
        number = reached.count()
        if number:
            members += number
            active = checkpointed(reached)
            steps.append((found, active.select("commit", "hunk_id", "fingerprint", "path").withColumn("depth", F.lit(depth))))
    empty = every.limit(0)
    matches = hunks.match(empty, empty).withColumn("depth", F.lit(0))
    reached = empty.select("commit", "hunk_id", "fingerprint", "path").withColumn("depth", F.lit(0))
    for found, then in steps:
        matches, reached = matches.unionByName(found), reached.unionByName(then)
    named = lambda side: every.select(F.col("commit").alias(f"{side}_commit"), F.col("seq").alias(f"{side}_seq"), F.col("hunk_id").alias(f"{side}_hunk_id"))
    edges = matches.join(named("topic"), ["topic_commit", "topic_seq"]).join(named("prior"), ["prior_commit", "prior_seq"])
    edges = edges.select(F.col("topic_commit").alias("parent_commit"), F.col("prior_commit").alias("commit"), F.col("topic_hunk_id").alias("parent_hunk_id"), F.col("prior_hunk_id").alias("hunk_id"), "depth", "method")
    depths = s.spark.createDataFrame([(c["sha"], c["depth"]) for c in chain[1:]], "commit string, depth int")
    moves = hunks.path_status(s.read("name_status", commits=shas[1:])) if shas[1:] else hunks.path_status(s.read("name_status"))
    moves = moves.join(reached.select("commit").distinct(), "commit", "left_semi").join(depths, "commit").select("commit", "depth", "status", "path", "previous_path")
    mine = matches.select(F.col("topic_commit").alias("commit"), F.col("topic_seq").alias("seq"))
    unmatched = topic.join(mine, ["commit", "seq"], "left_anti").select("hunk_id", "path", "fingerprint")
    skipped = [c for c in chain if c["skipped"]]
    meta = {k: v for k, v in one_commit(s, shas[0]).asDict().items() if k != "seq"} if shas else None
    return {
        "report_version": "1", "topic_sha": shas[0] if shas else commit, "topic_metadata": meta, "topic_hunks": topic.orderBy("seq"), "termination": end, "budget_limit": limit,
        "history_commits": chain, "skipped_commits": skipped, "members": reached.orderBy("depth", "hunk_id"), "matches": matches.orderBy("depth", "topic_seq", "prior_seq"),
        "ancestry_edges": edges.orderBy("depth", "parent_hunk_id", "hunk_id"), "unmatched_hunks": unmatched, "path_transitions": moves.orderBy("depth", "path"),
        "counts": {
            "members": members, "matches": matches.count(), "ancestry_edges": matches.count(), "unmatched_hunks": unmatched.count(), "skipped_commits": len(skipped), "path_transitions": moves.count(),
        },
    }


@operation("git.line_origins", "revision", "path", "lines")
def _line_origins(s: Session, revision: str, path: str, lines: list[int]) -> dict:
    return {"revision": revision, "path": path, "lines": s.read("blame", tip=revision, path=path, lines=lines)}


@operation("git.ownership", *BOUNDS)
def _ownership(s: Session, since_unix_time: int, limit: int) -> dict:
    kept = s.commits(since_unix_time, limit).where(F.col("seq") < limit)
    return {"authors": history.ownership(kept).orderBy("author_name", "author_email")}


def holds_path(paths: list[str]):
    return F.exists("occurrences", lambda o: o["path"].isin(paths))


@operation("python.representation_inventory", "paths?", *BOUNDS)
def _representations(s: Session, since_unix_time: int, limit: int, paths: list[str] | None = None) -> dict:
    x = s.source()
    files = _hotspots(s, since_unix_time, limit)["files"]
    same, lists = code.duplicates(x), code.groups(x)
    tracked = s.source(paths).select("path")
    branches = added_branches(s, since_unix_time, limit, "*.py")["events"].join(tracked, "path", "left_semi")
    if paths is not None:
        files, same, lists = files.where(F.col("path").isin(paths)), same.where(holds_path(paths)), lists.where(holds_path(paths))
    return {
        "hotspots": files, "duplicates": same, "groups": lists, "distributions": _distributions(s, since_unix_time, limit),
        "branch_growth": branches.groupBy("path").agg(F.count(F.lit(1)).alias("branch_additions")).orderBy("path"), "ownership": _ownership(s, since_unix_time, limit)["authors"],
    }


def review_context(s: Session, limit: int, paths: list[str] | None) -> dict:
    """The first classes and functions, what tests them, and the first imports with the number of all."""
    x = s.source()
    chosen = s.source(paths)
    first = python_code.relation(chosen, "names").where("kind in ('class', 'function')").select(*code.PLACE, "name", "kind").orderBy(*code.PLACE).limit(limit)
    symbols = sorted({r.name for r in first.select("name").collect()})
    return {"names": first, "tests": code.tests(x, symbols), "dependencies": code.capped(code.imports(chosen), ["path", "line", "target_module", "imported_names", "relative_level"], limit)}


def packet(s: Session, since_unix_time: int, limit: int, paths: list[str] | None = None) -> dict:
    files = _snapshot(s, since_unix_time, limit)
    if paths is not None:
        files["files"] = files["files"].where(F.col("path").isin(paths))
    scope = {"repository_root": s.repository, "since_unix_time": since_unix_time, "limit": limit} | ({"paths": paths} if paths else {})
    return {"scope": scope, "history": files, "inventory": _representations(s, since_unix_time, limit, paths), "python": review_context(s, limit, paths)}


@operation("git.review_packet", *BOUNDS)
def _packet(s: Session, since_unix_time: int, limit: int) -> dict:
    return packet(s, since_unix_time, limit)


@operation("git.review_packet.file", "path", *BOUNDS)
def _packet_file(s: Session, path: str, since_unix_time: int, limit: int) -> dict:
    return packet(s, since_unix_time, limit, [path])


@operation("git.review_packet.files", "paths", *BOUNDS)
def _packet_files(s: Session, paths: list[str], since_unix_time: int, limit: int) -> dict:
    return packet(s, since_unix_time, limit, paths)


@operation("git.review_packet.revision", "commit", *BOUNDS)
def _packet_revision(s: Session, commit: str, since_unix_time: int, limit: int) -> dict:
    gone = {"status": "unavailable_at_revision", "tip_sha": commit, "message": "The working tree's Python source does not belong to an explicit revision."}
    scope = {"repository_root": s.repository, "since_unix_time": since_unix_time, "limit": limit, "tip_sha": commit, "source_evidence": "unavailable_at_revision"}
    return {"scope": scope, "history": _snapshot(s, since_unix_time, limit, commit), "inventory": gone, "python": gone}


def on_source(name: str, report: Callable[[DataFrame], DataFrame], key: str) -> None:
    operation(name)(lambda s: {key: report(s.source()), "warnings": code.warnings(s.source())})


def on_term(name: str, parameter: str, **reports: Callable[[DataFrame, str], DataFrame]) -> None:
    operation(name, parameter)(lambda s, **given: {key: f(s.source(), given[parameter]) for key, f in reports.items()} | {"warnings": code.warnings(s.source())})


@operation("python.structural_complexity", "measure")
def _structural(s: Session, measure: str) -> dict:
    if measure not in MEASURES:
        raise Rejected("unsupported_measure", f"measure must be one of {', '.join(MEASURES)}")
    return {"measure": measure, "functions": code.structural_complexity(s.source(), measure), "warnings": code.warnings(s.source())}


def target(path: str, qualified_name: str) -> tuple[str, str]:
    if not path.endswith(".py") or not all(p.isidentifier() for p in str(qualified_name).split(".")):
        raise Rejected("invalid_query", "a target is a .py path and a dotted name")
    return check("path", path), qualified_name


@operation("python.function_profiles", "targets")
def _profiles(s: Session, targets: list) -> dict:
    if not 1 <= len(targets) <= MOST["targets"]:
        raise Rejected("invalid_query", f"targets must be 1 to {MOST['targets']}")
    rows = [(i, *target(*t)) for i, t in enumerate(targets)]
    return {"profiles": code.profiles(s.source(), s.spark.createDataFrame(rows, "at int, path string, qualified_name string"), MOST["sites"])}


@operation("python.function_profile", "path", "qualified_name")
def _profile(s: Session, path: str, qualified_name: str) -> dict:
    return _profiles(s, [(path, qualified_name)])


@operation("python.class_profile", "path", "qualified_name", "limit?")
def _class_profile(s: Session, path: str, qualified_name: str, limit: int = 16) -> dict:
    """A class, its fields' annotations, its first methods with their profiles and what they do to their receiver's fields."""
    path, qualified_name = target(path, qualified_name)
    if limit > MOST["targets"]:
        raise Rejected("invalid_query", f"limit must be at most {MOST['targets']}")
    x = s.source([path])
    found = code.classes(x, path, qualified_name)
    number = found.count()
    if number != 1:
        unread = not x.where("parse_status <> 'parsed'").isEmpty()
        return {"match_status": "ambiguous" if number else "unavailable" if unread else "not_found", "match_count": number, "warnings": code.warnings(x)}
    methods = code.class_methods(x, path, qualified_name, limit)
    targets = methods.selectExpr("cast(row_number() over (order by line, column) as int) as at", "path", "qualified_name")
    return {"match_status": "found", "class": found, "methods": methods, "profiles": code.profiles(x, targets, MOST["sites"]), "receiver_accesses": code.receiver_accesses(x, methods, MOST["sites"]), "warnings": code.warnings(x)}


on_source("python.inventory", code.inventory, "files")
on_source("python.imports", code.imports, "edges")
on_source("python.complexity", code.complexity, "functions")
on_source("python.literals", code.literals, "literals")
on_source("python.groups", code.groups, "groups")
on_source("python.primitive_density", code.density, "files")
on_term("python.names", "term", occurrences=code.names)
on_term("python.discriminations", "term", declarations=code.declarations, discriminations=code.discriminations)
on_term("python.neighborhood", "seed", nodes=code.neighborhood, edges=code.neighborhood_edges)
on_term("python.neighborhood.structural", "seed", edges=code.structural)
on_term("python.neighborhood.behavioral", "seed", edges=code.behavioral)


def identifier(carrier: str) -> str:
    if not carrier.isidentifier():
        raise Rejected("invalid_query", "carrier must be an identifier")
    return carrier


@operation("python.carrier_guards", "carrier", "path?")
def _carrier_guards(s: Session, carrier: str, path: str | None = None) -> dict:
    x = s.source([path] if path else None)
    return {"occurrences": code.guards(x, identifier(carrier)), "groups": code.guard_groups(x, carrier), "warnings": code.warnings(x)}


@operation("python.graph_topology")
def _topology(s: Session) -> dict:
    nodes, edges = code.import_graph(s.source())
    return {"parameters": {"tracked_by": "git", "language": "python", "pathspec": "*.py"}, "topology": graph.summary(nodes, edges), "nodes": graph.node_scores(nodes, edges).orderBy("node"), "edges": edges.orderBy("source", "target", "provenance")}


@operation("python.duplicates")
def _duplicates(s: Session) -> dict:
    return {"groups": code.duplicates(s.source()), "pairs": code.duplicate_pairs(s.source()), "warnings": code.warnings(s.source())}


@operation("python.duplicates.compact", "detail?")
def _duplicates_compact(s: Session, detail: str | None = None) -> dict:
    return {"groups": code.duplicates_compact(s.source()), "warnings": code.warnings(s.source())}


@operation("python.tests", "term")
def _tests(s: Session, term: str) -> dict:
    found = code.tests(s.source(), [term])
    status = "no_mapping_found" if found.isEmpty() else "matched"
    return {"language": "python", "symbol": term, "mapping_status": status, "candidates": found.drop("symbol"), "matching_imports": code.matching_imports(s.source(), term), "warnings": code.warnings(s.source())}


@operation("python.neighborhood.historical", "seed", *BOUNDS)
def _historical(s: Session, seed: str, since_unix_time: int, limit: int) -> dict:
    """What changes together with each file that holds a name of the seed; the pairs are made once for all files."""
    seeds = code.names(s.source(), seed).select(F.col("path").alias("seed_path")).distinct()
    pairs = history.cochange(s.changes(since_unix_time, limit))
    ways = pairs.selectExpr("left_path as seed_path", "right_path as neighbor", "score", "commit_count").unionByName(pairs.selectExpr("right_path as seed_path", "left_path as neighbor", "score", "commit_count"))
    return {"provenance": s.scope(since_unix_time, limit), "edges": ways.join(seeds, "seed_path", "left_semi").orderBy("seed_path", "neighbor")}


@operation("python.variable_cluster", "term?", "terms?", "since_unix_time?", "limit?")
def _cluster(s: Session, term: str | None = None, terms: list[str] | None = None, since_unix_time: int | None = None, limit: int | None = None) -> dict:
    """Where names occur and under which guards, how they are made, renamed and handed over, and what tests use them; of two
    names or more also the scopes and guards that all share."""
    if term and terms:
        raise Rejected("invalid_query", "term and terms exclude each other")
    if not term and not terms:
        raise Rejected("not_implemented", "The operation needs a term or terms.")
    wanted = list(terms or [term])
    x = s.source()
    out = {
        "names": wanted, "occurrences": code.cluster(x, wanted), "shared_scopes": code.shared_scopes(x, wanted) if terms else [],
        "shared_guards": code.shared_guards(x, wanted) if terms else [], "construction_sites": code.cluster_constructions(x, wanted),
        "aliases": code.cluster_aliases(x, wanted), "boundaries": code.cluster_boundaries(x, wanted),
        "test_evidence": [{"name": t, "report": _tests(s, t)} for t in wanted], "history_evidence": None, "warnings": code.warnings(x),
    }
    if since_unix_time and limit:
        past = _snapshot(s, since_unix_time, limit)
        out["history_evidence"] = past | {"files": past["files"].join(code.variables(x, wanted).select("path").distinct(), "path", "left_semi").orderBy("path")}
    return out


@operation("python.object_lifecycle", "carrier", "since_unix_time?", "limit?")
def _lifecycle(s: Session, carrier: str, since_unix_time: int | None = None, limit: int | None = None) -> dict:
    if (since_unix_time is None) != (limit is None):
        raise Rejected("invalid_query", "since_unix_time and limit go together")
    x = s.source()
    parts = {of: code.bindings(x, identifier(carrier), of) for of in ("construction", "alias", "boundary")}
    seen = {"operations": code.operations(x, carrier), "operation_groups": code.operation_groups(x, carrier), "transitions": code.operation_transitions(x, carrier)}
    past = {"history": _snapshot(s, since_unix_time, limit)} if since_unix_time and limit else {}
    return {"constructions": parts["construction"], "aliases": parts["alias"], "boundaries": parts["boundary"]} | seen | past


@operation("python.external_field_rules", "carrier")
def _rules(s: Session, carrier: str) -> dict:
    return {"declarations": code.declarations(s.source(), carrier), "affinities": code.field_affinities(s.source(), carrier), "rules": code.repeated_rules(s.source(), carrier), "tests": code.rule_tests(s.source(), carrier)}


@operation("python.external_field_rules.history", "carrier", *BOUNDS)
def _rules_history(s: Session, carrier: str, since_unix_time: int, limit: int) -> dict:
    seen = code.external(s.source(), "accesses", carrier).select("path").unionAll(code.external(s.source(), "rules", carrier).select("path")).unionAll(code.declarations(s.source(), carrier).select("path")).distinct()
    files = _snapshot(s, since_unix_time, limit)
    return _rules(s, carrier) | {"history": files | {"files": files["files"].join(seen, "path", "left_semi").orderBy("path")}}


@operation("python.seed_evidence", "seed")
def _seed(s: Session, seed: str) -> dict:
    nodes = code.neighborhood(s.source(), seed)
    places = nodes.select("name", "pass", F.explode("locations").alias("at")).select("name", "pass", "at.*")
    more = {"carrier_guards": code.guards(s.source(), seed), "object_lifecycle": _lifecycle(s, seed)} if seed.isidentifier() else {"carrier_guards": None, "object_lifecycle": None}
    edges = code.neighborhood_edges(s.source(), seed)
    return {"nodes": nodes, "edges": edges, "locations": places, "warnings": code.warnings(s.source())} | more


@operation("python.term_change_evidence", "term", *BOUNDS)
def _term_change(s: Session, term: str, since_unix_time: int, limit: int) -> dict:
    seed, files = _seed(s, term), _snapshot(s, since_unix_time, limit)
    places = seed["locations"].orderBy(F.col("pass"), "name", *code.PLACE)
    total, known = places.count(), term.isidentifier()
    index = {
        "ownership": {"source": "carrier_guards", "available": known, "occurrence_count": seed["carrier_guards"].count() if known else 0, "group_count": code.guard_groups(s.source(), term).count() if known else 0},
        "multiplicity": {"source": "nodes", "node_count": seed["nodes"].count(), "location_count": total, "locations": places.limit(MOST["places"]), "locations_truncated": total > MOST["places"]},
        "coupling": {"source": "edges", "edge_count": seed["edges"].count()},
        "history": {"source": "history.files", "file_count": files["files"].count(), "paths": files["files"].select("path").orderBy("path")},
        "representations": {
            "source": "object_lifecycle", "available": known, "construction_count": seed["object_lifecycle"]["constructions"].count() if known else 0,
            "operation_count": seed["object_lifecycle"]["operations"].count() if known else 0,
        },
    }
    return {"current": seed, "history": files, "dimensions": index}
