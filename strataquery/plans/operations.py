"""Every operation of a Session on the repository that sample.build makes of the driver's tables, with SQL that computes the
same answers from the tables alone: no row of the SQL comes from a parse or from git.

Hashes of commits and of bodies are told as the nation whose commit it is, or not at all; whole numbers are told as bigint.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from . import sample
from .session import Session, check_examples, contract
from .topic_cache import TopicCache

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SINCE, LIMIT = 1, 5000
BOUNDS = {"since_unix_time": SINCE, "limit": LIMIT}
_sessions: dict[tuple[str, str], Session] = {}


def session(spark: SparkSession, sf_dir: str) -> Session:
    """One repository and one session for each application and folder of tables."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _sessions:
        _sessions[key] = Session(spark, sample.build(spark, sf_dir))
    return _sessions[key]


class Asked:
    """A session that answers or raises, with what the queries below need to tell its answers."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.session = spark, session(spark, sf_dir)

    def __call__(self, name: str, **given) -> dict[str, Any]:
        out = self.session.run(name, **given)
        if out["status"] != "ok":
            raise ValueError(out["error"]["message"])
        return out["data"]

    def shas(self) -> list[str]:
        """Hashes of the commits, oldest first."""
        return [r.sha for r in self("git.history", **BOUNDS)["commits"].collect()][::-1]

    def nations(self) -> DataFrame:
        """commit, nation: commits are by ascending key, and their times tell the key."""
        return self("git.history", **BOUNDS)["commits"].select(F.col("sha").alias("commit"), F.expr(f"cast((committed - {sample.BEGIN}) div {sample.STEP} as bigint)").alias("nation"))

    def told(self, rows: DataFrame, *columns: str, commit: str = "commit") -> DataFrame:
        """columns of rows, with nation for the commit."""
        return rows.join(self.nations().withColumnRenamed("commit", commit), commit, "left").select(*columns)

    def one(self, row: dict[str, Any]) -> DataFrame:
        return self.spark.createDataFrame([Row(**row)])


def plain(frame: DataFrame) -> DataFrame:
    return frame.select(*(F.col(f"`{f.name}`").cast("bigint").alias(f.name) if f.dataType.simpleString() in ("int", "smallint") else F.col(f"`{f.name}`") for f in frame.schema.fields))


#: The tables as the repository's parts. n: nations with their paths, f: functions with their lines in module and test file,
#: ch: changes by commit, words: every name of a module, test file or list.
TABLES = f"""with n as (select n_nationkey::bigint as k, n_name, n_regionkey::bigint as r, r_name, row_number() over (partition by n_regionkey order by n_nationkey) as m,
 'pkg/n' || lpad(n_nationkey::varchar, 2, '0') || '.py' as path, 'tests/test_n' || lpad(n_nationkey::varchar, 2, '0') || '.py' as tpath, 'pkg/r' || n_regionkey || '.py' as rpath,
 {sample.BEGIN} + {sample.STEP} * n_nationkey::bigint as committed, (select count(*) from supplier where s_nationkey = n_nationkey) as own,
 case n_regionkey % 5 when 0 then 'feat(api): add ' || n_name when 1 then 'fix: ' || n_name when 2 then 'docs!: ' || n_name when 3 then 'chorus: ' || n_name else n_name end as subject
 from nation join region on n_regionkey = r_regionkey),
 f as (select s_suppkey as s, n.*, s_suppkey % 2 = 0 as even, 16 + 7 * (row_number() over w - 1) as l, 5 + 5 * (row_number() over w - 1) as t, 100 + s_suppkey % 7 as number, s_suppkey % 3 as kind
 from supplier join n on s_nationkey = k window w as (partition by s_nationkey order by s_suppkey)),
 ch as (select k, path, 15 + 7 * own as added from n union all select k, tpath, 4 + 5 * own from n union all select k, rpath, 1 from n union all select min(k), 'pkg/__init__.py', 0 from n),
 words as (select path, l as line, 0 as col, 'take_' || s as name, 'function' as kind from f
 union all select path, l, 10 + length(s::varchar), 'order', 'parameter' from f union all select path, l, 17 + length(s::varchar), 'amount', 'parameter' from f
 union all select path, l, 25 + length(s::varchar), case when even then 'int' else 'Money' end, 'reference' from f
 union all select path, l + 1, 7, 'order', 'reference' from f union all select path, l + 1, 23, 'Kind', 'reference' from f where even
 union all select path, case when even then l + 2 else l + 3 end, case when even then 8 else 4 end, 'order', 'reference' from f
 union all select path, case when even then l + 2 else l + 3 end, case when even then 22 else 18 end, 'amount', 'reference' from f
 union all select path, case when even then l + 3 else l + 4 end, 11, 'order', 'reference' from f
 union all select path, 6, 0, 'Kind', 'class' from n union all select path, 6, 11, 'Enum', 'reference' from n union all select path, 7, 4, 'OPEN', 'assignment' from n union all select path, 8, 4, 'SHUT', 'assignment' from n
 union all select path, 11, 0, 'Order', 'class' from n union all select path, 12, 4, 'total', 'assignment' from n union all select path, 12, 11, 'int', 'reference' from n
 union all select path, 13, 4, 'status', 'assignment' from n union all select path, 13, 12, 'Kind', 'reference' from n
 union all select tpath, t, 0, 'test_take_' || s, 'function' from f union all select tpath, t + 1, 4, 'order', 'assignment' from f union all select tpath, t + 1, 12, 'Order', 'reference' from f
 union all select tpath, t + 2, 11, 'pkg', 'reference' from f union all select tpath, t + 2, 25 + length(s::varchar), 'order', 'reference' from f union all select tpath, t + 2, 38 + length(s::varchar), 'order', 'reference' from f)"""


def query(name: str, sql: str):
    def add(f: Callable[[Asked], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(f(Asked(spark, sf_dir)))
        SQL[name] = f"{TABLES} {sql}"
        return f

    return add


# --- history ---


@query("git_history", "select (select max(k) from n) - k as seq, n_name is not null as known, subject, r_name as author_name, 'r' || r || '@x.org' as author_email, committed, case when k = (select min(k) from n) then 0 else 1 end as parents from n")
def _(q: Asked) -> DataFrame:
    found = q("git.history", **BOUNDS)["commits"]
    shas = {sha: i for i, sha in enumerate(reversed(q.shas()))}
    order = q.spark.createDataFrame(list(shas.items()), "sha string, seq long")
    return found.join(order, "sha").select("seq", F.lit(True).alias("known"), "subject", "author_name", "author_email", "committed", F.size("parents").alias("parents"))


@query("git_history_scope", "select count(*) > 7 as truncated, least(count(*), 7) as commit_count from n")
def _(q: Asked) -> DataFrame:
    told = q("git.history", since_unix_time=1, limit=7)["provenance"]
    return q.one({"truncated": told["truncated"], "commit_count": told["commit_count"]})


@query("git_snapshot", "select path, count(*) over (partition by path) as commit_count, row_number() over (partition by path order by k desc) - 1 as place, k as nation from ch")
def _(q: Asked) -> DataFrame:
    files = q("git.snapshot", **BOUNDS)["files"]
    return q.told(files.select("path", "commit_count", F.posexplode("recent_commits").alias("place", "commit")), "path", "commit_count", "place", "nation")


@query("git_hotspots", """select path, count(*) as commit_count, sum(added)::bigint as additions, 0::bigint as deletions, sum(added)::bigint as changed_lines, sum(added)::double / count(*) as average_churn,
 string_agg(k::varchar, ',' order by k desc) as nations from ch group by path""")
def _(q: Asked) -> DataFrame:
    files = q("git.hotspots", **BOUNDS)["files"]
    each = q.told(files.select("path", F.posexplode("commits").alias("at", "commit")), "path", "at", "nation")
    listed = each.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "nation"))), lambda x: x["nation"].cast("string")), ",").alias("nations"))
    return files.drop("commits").join(listed, "path")


_WEEKS = """w as (select date_trunc('week', to_timestamp(committed) at time zone 'UTC')::date as week_start, count(*) as commit_count from n group by 1),
 weeks as (select d::date as week_start, coalesce(commit_count, 0) as commit_count from (select unnest(generate_series((select min(week_start) from w)::timestamp, (select max(week_start) from w)::timestamp, interval 7 days)) as d) left join w on w.week_start = d::date)"""


@query("git_distributions", f", {_WEEKS} select week_start, commit_count from weeks")
def _(q: Asked) -> DataFrame:
    return q("git.distributions", **BOUNDS)["weeks"]


@query("git_distributions_categories", "select case r % 5 when 0 then 'feat' when 1 then 'fix' when 2 then 'docs' when 3 then 'chorus' else '' end as raw, case r % 5 when 0 then 'feature' when 1 then 'fix' when 2 then 'docs' else 'unknown' end as category, count(*) as commit_count from n group by 1, 2")
def _(q: Asked) -> DataFrame:
    return q("git.distributions", **BOUNDS)["categories"]


@query("git_distributions_summary", f", {_WEEKS} select min(commit_count) as minimum, max(commit_count) as maximum, round(avg(commit_count), 2) as average, (select count(*) from n where r % 5 >= 3) as unknown from weeks")
def _(q: Asked) -> DataFrame:
    return q("git.distributions", **BOUNDS)["summary"]


_PAIRS = """, size as (select k, count(*) as files from ch group by k),
 pairs as (select a.path as left_path, b.path as right_path, round(sum(2.0::double / (files * (files - 1))), 9) as score, count(*) as commit_count, string_agg(a.k::varchar, ',' order by a.k desc) as nations
 from ch a join ch b on a.k = b.k and a.path < b.path join size on size.k = a.k group by all)"""


def told_pairs(q: Asked, pairs: DataFrame) -> DataFrame:
    each = q.told(pairs.select("left_path", "right_path", F.posexplode("contributing_commits").alias("at", "commit")), "left_path", "right_path", "at", "nation")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "nation"))), lambda x: x["nation"].cast("string")), ",").alias("nations")
    return pairs.join(each.groupBy("left_path", "right_path").agg(listed), ["left_path", "right_path"]).select("left_path", "right_path", F.round("score", 9).alias("score"), "commit_count", "nations")


@query("git_cochange", f"{_PAIRS} select * from pairs")
def _(q: Asked) -> DataFrame:
    return told_pairs(q, q("git.cochange", **BOUNDS)["pairs"])


@query("git_cochange_file", f"{_PAIRS} select * from pairs where 'pkg/r3.py' in (left_path, right_path)")
def _(q: Asked) -> DataFrame:
    return told_pairs(q, q("git.cochange.file", path="pkg/r3.py", **BOUNDS)["pairs"])


@query("git_cochange_pair", f"{_PAIRS} select * from pairs where left_path = 'pkg/n07.py' and right_path = 'pkg/r2.py'")
def _(q: Asked) -> DataFrame:
    return told_pairs(q, q("git.cochange.pair", left_path="pkg/r2.py", right_path="pkg/n07.py", **BOUNDS)["pair"])


_ADDED = "select path, l + 1 as line, 'if' as keyword, case when even then 'if order.status == Kind.OPEN:' else 'if order.status != ''open' || kind || ''':' end as text from f where k > (select min(k) from n)"


@query("git_branch_additions", f"select * from ({_ADDED}) where path = 'pkg/n15.py'")
def _(q: Asked) -> DataFrame:
    return q("git.branch_additions", path="pkg/n15.py", **BOUNDS)["events"].select("path", "line", "keyword", "text")


@query("git_branch_additions_skipped", "select k as nation, 'root' as reason from n where path = 'pkg/n00.py' and k = (select min(k) from n)")
def _(q: Asked) -> DataFrame:
    return q.told(q("git.branch_additions", path="pkg/n00.py", **BOUNDS)["skipped"], "nation", "reason")


#: The newest commit's hunks, and those of any: new files are one hunk of their own, a list gets a line behind at most three.
_HUNKS = """, h as (select k, path, 0 as old_start, 0 as old_count, 1 as new_start, 15 + 7 * own as new_count from n union all select k, tpath, 0, 0, 1, 4 + 5 * own from n
 union all select k, rpath, case when m = 1 then 0 else greatest(1, m - 3) end, least(m - 1, 3), greatest(1, m - 3), least(m, 4) from n), last as (select max(k) as k from n)"""


@query("git_topic", f"{_HUNKS} select path, case when path like 'pkg/r%' and (select m from n where n.k = last.k) > 1 then 'M' else 'A' end as status, 1 as hunk_count, 'available' as hunk_status from h join last using (k)")
def _(q: Asked) -> DataFrame:
    return q("git.topic", commit=q.shas()[-1])["changes"].select("path", "status", "hunk_count", "hunk_status")


@query("git_topic_commit", "select subject, 'normal' as status, committed, 1 as parents from n where k = (select max(k) from n)")
def _(q: Asked) -> DataFrame:
    out = q("git.topic", commit=q.shas()[-1])
    return q.one({"subject": out["subject"], "status": out["status"], "committed": out["committed"], "parents": len(out["parents"])})


@query("git_topic_hunks", f"{_HUNKS} select path, old_start, old_count, new_start, new_count, 'available' as status from h join last using (k)")
def _(q: Asked) -> DataFrame:
    out = q("git.topic_hunks", commit=q.shas()[-1])
    return out["hunks"].select("path", "old_start", "old_count", "new_start", "new_count", F.lit(out["status"]).alias("status"))


@query("git_topic_walk", "select (select max(k) from n) - k as depth, k as nation, 'root' as termination, (select count(*) from ch where ch.k = n.k) as changes from n")
def _(q: Asked) -> DataFrame:
    out = q("git.topic_walk", commit=q.shas()[-1], **BOUNDS)
    chain = q.spark.createDataFrame([(c["depth"], c["sha"]) for c in out["commits"]], "depth long, commit string")
    number = out["changes"].groupBy("commit").agg(F.count(F.lit(1)).alias("changes"))
    return q.told(chain.join(number, "commit"), "depth", "nation", F.lit(out["termination"]).alias("termination"), "changes")


@query("git_topic_walk_limit", "select count(*) as commits, 'limit' as termination from (select k from n order by k desc limit 4)")
def _(q: Asked) -> DataFrame:
    out = q("git.topic_walk", commit=q.shas()[-1], since_unix_time=1, limit=4)
    return q.one({"commits": len(out["commits"]), "termination": out["termination"]})


#: Of the newest commit's hunks only the list's has kin: the lines added to the same list before, one a commit.
_FAMILY = """, own as (select r, m, k from n where k = (select max(k) from n)), kin as (select n.k, n.m, own.k as top, n.rpath from n join own using (r) where n.k < own.k and n.k > (select min(k) from n))"""


@query("git_topic_family", f"""{_FAMILY} select 'member' as part, k as nation, top - k as depth, rpath as path, '' as told from kin
 union all select 'edge', k, top - k, rpath, 'range_overlap' from kin
 union all select 'transition', kin.k, top - kin.k, ch.path, case when ch.path = rpath and kin.m > 1 then 'modified' else 'added' end from kin join ch on ch.k = kin.k
 union all select 'unmatched', null, 0, path, '' from n join own using (k) union all select 'unmatched', null, 0, tpath, '' from n join own using (k)""")
def _(q: Asked) -> DataFrame:
    out = q("git.topic_family", commit=q.shas()[-1], **BOUNDS)
    part = lambda name, rows, path, told: rows.select(F.lit(name).alias("part"), "commit", "depth", path.alias("path"), told.alias("told"))
    path_of = F.regexp_extract("hunk_id", r"^(.*):\d+:[0-9a-f]+$", 1)
    rows = part("member", out["members"], F.col("path"), F.lit("")).unionByName(part("edge", out["ancestry_edges"], path_of, F.col("method")))
    rows = rows.unionByName(part("transition", out["path_transitions"], F.col("path"), F.col("status")))
    rows = rows.unionByName(part("unmatched", out["unmatched_hunks"].select("*", F.lit(None).cast("string").alias("commit"), F.lit(0).alias("depth")), F.col("path"), F.lit("")))
    return q.told(rows, "part", "nation", "depth", "path", "told")


@query("git_topic_family_counts", f"""{_FAMILY} select (select count(*) from kin) as members, (select count(*) from kin) as matches, (select count(*) from kin) as ancestry_edges, 2 as unmatched_hunks, 0 as skipped_commits,
 (select count(*) from kin join ch on ch.k = kin.k) as path_transitions, 'exhausted' as termination""")
def _(q: Asked) -> DataFrame:
    out = q("git.topic_family", commit=q.shas()[-1], **BOUNDS)
    return q.one(out["counts"] | {"termination": out["termination"]})


@query("git_line_origins", "select m as line, k as nation, rpath as source_path, m as source_line, 'from .n' || lpad(k::varchar, 2, '0') || ' import Order as Order' || k as text, 'available' as status from n where r = 1 union all select 99, null, null, null, null, 'unavailable'")
def _(q: Asked) -> DataFrame:
    number = q.nations().count() // 5
    return q.told(q("git.line_origins", revision="HEAD", path="pkg/r1.py", lines=[*range(1, number + 1), 99])["lines"], "line", "nation", "source_path", "source_line", "text", "status")


@query("git_ownership", "select r_name as author_name, 'r' || r || '@x.org' as author_email, count(*) as commit_count, string_agg(k::varchar, ',' order by k desc) as nations from n group by r_name, r")
def _(q: Asked) -> DataFrame:
    authors = q("git.ownership", **BOUNDS)["authors"]
    each = q.told(authors.select("author_email", F.posexplode("commits").alias("at", "commit")), "author_email", "at", "nation")
    listed = each.groupBy("author_email").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "nation"))), lambda x: x["nation"].cast("string")), ",").alias("nations"))
    return authors.drop("commits").join(listed, "author_email")


# --- packets ---


def packet_rows(q: Asked, out: dict[str, Any]) -> DataFrame:
    """Parts of a packet as rows part, path, name, number."""
    kind = lambda part, rows, path, name, number: rows.select(F.lit(part).alias("part"), path.alias("path"), name.alias("name"), number.cast("bigint").alias("number"))
    rows = kind("history", out["history"]["files"], F.col("path"), F.lit(""), F.col("commit_count"))
    if "names" not in out["python"]:
        return rows
    rows = rows.unionByName(kind("hotspot", out["inventory"]["hotspots"], F.col("path"), F.lit(""), F.col("changed_lines")))
    rows = rows.unionByName(kind("growth", out["inventory"]["branch_growth"], F.col("path"), F.lit(""), F.col("branch_additions")))
    rows = rows.unionByName(kind("owner", out["inventory"]["ownership"], F.lit(""), F.col("author_name"), F.col("commit_count")))
    rows = rows.unionByName(kind("name", out["python"]["names"], F.col("path"), F.col("name"), F.col("line")))
    return rows.unionByName(kind("import", out["python"]["dependencies"], F.col("path"), F.col("target_module"), F.col("edge_count")))


def packet_sql(where: str, limit: int, whole: bool = True) -> str:
    """limit bounds commits, names and imports alike."""
    edges = """imp as (select path, 1 as line, 'enum' as target from n union all select path, 2, 'os.path' from n union all select path, 3, 'pkg.r' || r from n
 union all select rpath, m, 'pkg.n' || lpad(k::varchar, 2, '0') from n union all select tpath, 1, 'pkg.n' || lpad(k::varchar, 2, '0') from n union all select tpath, 2, 'pkg.n' || lpad(k::varchar, 2, '0') from n)"""
    rows = f"""select 'history' as part, path, '' as name, count(*) as number from win where {where} group by path
 union all select 'hotspot', path, '', sum(added)::bigint from win where {where} group by path
 union all select 'growth', path, '', count(*) from f where k > (select min(k) from n) and k in (select k from win) and {where} group by path
 union all select 'owner', '', r_name, count(*) from n where k in (select k from win) group by r_name
 union all select * from (select 'name', path, name, line from words where kind in ('class', 'function') and {where} order by path, line, col limit {limit})
 union all select * from (select 'import', path, target, (select count(*) from imp where {where}) from imp where {where} order by path, line, target limit {limit})"""
    return f", {edges}, win as (select * from ch where k in (select k from n order by k desc limit {limit})) select * from ({rows})"


@query("git_review_packet", packet_sql("true", 9))
def _(q: Asked) -> DataFrame:
    return packet_rows(q, q("git.review_packet", since_unix_time=1, limit=9))


@query("git_review_packet_file", packet_sql("path = 'pkg/n15.py'", 20))
def _(q: Asked) -> DataFrame:
    return packet_rows(q, q("git.review_packet.file", path="pkg/n15.py", since_unix_time=1, limit=20))


@query("git_review_packet_files", packet_sql("path in ('pkg/n15.py', 'tests/test_n15.py', 'pkg/r0.py')", 20))
def _(q: Asked) -> DataFrame:
    return packet_rows(q, q("git.review_packet.files", paths=["pkg/n15.py", "tests/test_n15.py", "pkg/r0.py"], since_unix_time=1, limit=20))


@query("git_review_packet_revision", "select 'history' as part, path, '' as name, count(*) as number from ch where k in (select k from n where k <= 12 order by k desc limit 6) group by path union all select 'inventory', '', 'unavailable_at_revision', 0")
def _(q: Asked) -> DataFrame:
    out = q("git.review_packet.revision", revision=q.shas()[12], since_unix_time=1, limit=6)
    return packet_rows(q, out).unionByName(q.one({"part": "inventory", "path": "", "name": out["inventory"]["status"], "number": 0}))


@query("python_review_context", "select tpath as path, t as line, 'test_take_' || s as qualified_name, 'Order' as symbol, 'imported_name' as kind, 'Order()' as expression from f")
def _(q: Asked) -> DataFrame:
    found = q("git.review_packet.file", path="pkg/n00.py", since_unix_time=1, limit=2)["python"]["tests"]
    return found.select("symbol", "path", "line", "qualified_name", F.explode("evidence").alias("e")).select("path", "line", "qualified_name", "symbol", "e.kind", "e.expression")


@query("python_representation_inventory", """select 'hotspot' as part, path, sum(added)::bigint as number from ch group by path union all select 'growth', path, count(*) from f where k > (select min(k) from n) group by path
 union all select 'group', kind, count(*) from (select 'fields' as kind from n union all select 'parameters' from f) group by kind having count(*) > 1 union all select 'owner', r_name, count(*) from n group by r_name""")
def _(q: Asked) -> DataFrame:
    out = q("python.representation_inventory", **BOUNDS)
    rows = out["hotspots"].select(F.lit("hotspot").alias("part"), "path", F.col("changed_lines").alias("number"))
    rows = rows.unionAll(out["branch_growth"].select(F.lit("growth"), "path", "branch_additions")).unionAll(out["groups"].select(F.lit("group"), "kind", "occurrence_count"))
    return rows.unionAll(out["ownership"].select(F.lit("owner"), "author_name", "commit_count"))


# --- source ---


@query("python_inventory", """, src as (select path, 15 + 7 * own as lines, 'module' as kind from n union all select tpath, 4 + 5 * own, 'test' from n union all select rpath, count(*), 'module' from n group by rpath union all select 'pkg/__init__.py', 0, 'package')
 select path, case kind when 'package' then 'pkg' else replace(left(path, -3), '/', '.') end as module, kind, lines, 'parsed' as parse_status from src""")
def _(q: Asked) -> DataFrame:
    return q("python.inventory")["files"].select("path", "module", "kind", "lines", "parse_status")


@query("python_names", "select path, line, col as \"column\", name, kind from words where name like 'take\\_%' escape '\\' or name like 'test\\_take\\_%' escape '\\'")
def _(q: Asked) -> DataFrame:
    return q("python.names", term="take")["occurrences"]


_IMPORTS = """, imp as (select path, 1 as line, 'enum' as target_module, 'Enum' as names, 0 as relative_level from n union all select path, 2, 'os.path', '', 0 from n union all select path, 3, 'pkg.r' || r, 'names', 1 from n
 union all select rpath, m, 'pkg.n' || lpad(k::varchar, 2, '0'), 'Order', 1 from n union all select tpath, 1, 'pkg.n' || lpad(k::varchar, 2, '0'), 'Order', 0 from n union all select tpath, 2, 'pkg.n' || lpad(k::varchar, 2, '0'), '', 0 from n)"""


@query("python_imports", f"{_IMPORTS} select path, line, target_module, names, relative_level, false as unresolved, replace(left(path, -3), '/', '.') as source_module from imp")
def _(q: Asked) -> DataFrame:
    return q("python.imports")["edges"].select("path", "line", "target_module", F.array_join("imported_names", ",").alias("names"), "relative_level", "unresolved", "source_module")


_EDGES = f"""{_IMPORTS}, known as (select replace(left(path, -3), '/', '.') as module from (select path from n union select tpath from n union select rpath from n) union all select 'pkg'),
 e as (select replace(left(path, -3), '/', '.') as source, case when target_module in (select module from known) then target_module else 'module:' || target_module end as target from imp),
 nodes as (select module as node from known union select target from e), simple as (select least(source, target) as a, greatest(source, target) as b, count(*)::double as weight from e group by 1, 2),
 ends as (select a as node from simple union all select b from simple)"""


@query("python_graph_topology_edges", f"{_EDGES} select source, target, 1.0::double as weight, 'python.import' as provenance from e")
def _(q: Asked) -> DataFrame:
    return q("python.graph_topology")["edges"].select("source", "target", "weight", "provenance")


@query("python_graph_topology_degrees", f"{_EDGES} select node, (select count(*) from ends where ends.node = nodes.node) as degree from nodes")
def _(q: Asked) -> DataFrame:
    return q("python.graph_topology")["nodes"].select("node", "degree")


@query("python_graph_topology", f"""{_EDGES} select count(*) as node_count, (select count(*) from simple) as edge_count, (select sum(weight) from simple) as total_edge_weight, round(2 * (select count(*) from simple) / count(*), 2) as average_degree,
 round((select avg(weight) from simple), 2) as average_edge_weight, 'connected_components' as community_method, 2 as component_count, 0 as cross_community_edge_count, 0.0::double as cross_community_edge_ratio,
 (select count(*) from n) as bridge_edge_count, round((select count(*) from n) / (select count(*) from simple), 2) as bridge_edge_ratio, 'bridge_edge_count / edge_count' as formula from nodes""")
def _(q: Asked) -> DataFrame:
    told = q("python.graph_topology")["topology"]
    return q.one({k: v for k, v in told.items() if isinstance(v, (int, float, str))} | {"formula": told["formulas"]["bridge_edge_ratio"]})


@query("python_graph_topology_communities", f"{_EDGES} select node, case when node = 'pkg' then 1 else 0 end as community from nodes")
def _(q: Asked) -> DataFrame:
    return q("python.graph_topology")["topology"]["community_ids"]


@query("python_complexity", """select path, l as line, 0 as \"column\", 'take_' || s as qualified_name, 'function' as kind, case when even then l + 3 else l + 4 end as end_line, case when even then 4 else 5 end as line_count, 1 as branch_count, 2 as cyclomatic_count, 1 as max_nesting_depth from f
 union all select tpath, t, 0, 'test_take_' || s, 'function', t + 2, 3, 0, 1, 0 from f""")
def _(q: Asked) -> DataFrame:
    return q("python.complexity")["functions"]


#: An if makes two ways of one. Operations: a comparison, three attributes or two, an assignment, a computation.
@query("python_structural_complexity", "select path, 'take_' || s as qualified_name, 2 as count, null::varchar as diagnostic from f union all select tpath, 'test_take_' || s, null, 'Assert is not defined for paths.' from f")
def _(q: Asked) -> DataFrame:
    return q("python.structural_complexity", measure="paths")["functions"].select("path", "qualified_name", "count", "diagnostic")


@query("python_structural_operands", "select path, 'take_' || s as qualified_name, case when even then 6 else 7 end as count from f")
def _(q: Asked) -> DataFrame:
    return q("python.structural_complexity", measure="operands")["functions"].where("path like 'pkg/%'").select("path", "qualified_name", "count")


@query("python_structural_operations", "select path, 'take_' || s as qualified_name, case when even then 6 else 5 end as count from f")
def _(q: Asked) -> DataFrame:
    return q("python.structural_complexity", measure="operations")["functions"].where("path like 'pkg/%'").select("path", "qualified_name", "count")


@query("python_literals", """, lit as (select 'integer' as kind, number::varchar as value, path, case when even then l + 2 else l + 3 end as line, case when even then 31 else 27 end as col from f
 union all select 'string', 'open' || kind, path, l + 1, 23 from f where not even union all select 'integer', '2', path, 8, 11 from n)
 select kind, value, count(*) as occurrence_count, min(path || ':' || lpad(line::varchar, 6, '0')) as first_place, min(col) as least_column from lit group by 1, 2 having count(*) > 1""")
def _(q: Asked) -> DataFrame:
    places = F.transform("occurrences", lambda o: F.concat(o["path"], F.lit(":"), F.lpad(o["line"].cast("string"), 6, "0")))
    return q("python.literals")["literals"].select("kind", "value", "occurrence_count", F.array_min(places).alias("first_place"), F.array_min(F.transform("occurrences", lambda o: o["column"])).alias("least_column"))


@query("python_groups", "select kind, members, owner, path, line, count(*) over (partition by kind, members) as occurrence_count from (select 'parameters' as kind, 'order,amount' as members, 'take_' || s as owner, path, l as line from f union all select 'fields', 'total,status', 'Order', path, 11 from n) qualify occurrence_count > 1")
def _(q: Asked) -> DataFrame:
    groups = q("python.groups")["groups"]
    return groups.select("kind", F.array_join("members", ",").alias("members"), "occurrence_count", F.explode("occurrences").alias("o")).select("kind", "members", "o.owner", "o.path", "o.line", "occurrence_count")


@query("python_primitive_density", """select path, 1 + count(*) filter (even) as primitive_count, 1 + count(*) filter (not even) as specialized_count, (1 + count(*) filter (even))::double / (2 + count(even)) as primitive_ratio from n left join (select k, even from f) using (k) group by path
 union all select tpath, 0, 0, null from n union all select distinct rpath, 0, 0, null from n union all select 'pkg/__init__.py', 0, 0, null""")
def _(q: Asked) -> DataFrame:
    return q("python.primitive_density")["files"]


#: Functions are alike when they differ in their name alone; tests never are, since they name what they test.
_ALIKE = ", alike as (select *, case when even then 'even' else 'odd' || kind end || number as body from f)"


@query("python_duplicates", f"{_ALIKE} select path, l as line, case when even then l + 3 else l + 4 end as end_line, 'take_' || s as qualified_name, count(*) over (partition by body) as occurrence_count, min(s) over (partition by body) as least, case when even then 2 else 3 end as statement_count, 2 as parameter_count, 0 as call_count, 1 as branch_count from alike qualify occurrence_count > 1")
def _(q: Asked) -> DataFrame:
    groups = q("python.duplicates")["groups"].select("fingerprint", "occurrence_count", F.explode("occurrences").alias("o")).select("fingerprint", "occurrence_count", "o.*")
    least = groups.groupBy("fingerprint").agg(F.min(F.substring("qualified_name", 6, 20).cast("long")).alias("least"))
    return groups.join(least, "fingerprint").select("path", "line", "end_line", "qualified_name", "occurrence_count", "least", "statement_count", "parameter_count", "call_count", "branch_count")


@query("python_duplicate_pairs", f"{_ALIKE} select case when x then a.s else b.s end as left_key, case when x then b.s else a.s end as right_key from (select a, b, (a.path, a.l) < (b.path, b.l) as x from alike a join alike b on a.body = b.body and a.s < b.s)")
def _(q: Asked) -> DataFrame:
    key = lambda side: F.substring(f"{side}_qualified_name", 6, 20).cast("long").alias(f"{side}_key")
    return q("python.duplicates")["pairs"].select(key("left"), key("right"))


@query("python_duplicates_compact", f"{_ALIKE} select count(*) as occurrence_count, min(s) as least, 16 as digits from alike group by body having count(*) > 1")
def _(q: Asked) -> DataFrame:
    least = F.array_min(F.transform("occurrences", lambda o: F.substring(o["qualified_name"], 6, 20).cast("long")))
    return q("python.duplicates.compact", detail="compact")["groups"].select("occurrence_count", least.alias("least"), F.length("digest").alias("digits"))


@query("python_discriminations", """select 'comparison' as kind, path, l + 1 as line, 7 as \"column\", '==' as operator, 'OPEN' as member, 'order.status == Kind.OPEN' as expression from f where even
 union all select 'enum', path, 6, 0, null, 'OPEN,SHUT', 'Kind' from n""")
def _(q: Asked) -> DataFrame:
    out = q("python.discriminations", term="Kind")
    declared = out["declarations"].select("kind", *("path", "line", "column"), F.lit(None).cast("string").alias("operator"), F.array_join("members", ",").alias("member"), F.col("name").alias("expression"))
    return out["discriminations"].select("kind", "path", "line", "column", "operator", "member", "expression").unionAll(declared)


@query("python_tests", "select tpath as path, t as line, 0 as \"column\", 'test_take_' || s as qualified_name, 'function' as kind, 'imported_name' as evidence, t + 1 as evidence_line, 12 as evidence_column, 'Order()' as expression, 'matched' as mapping_status from f")
def _(q: Asked) -> DataFrame:
    out = q("python.tests", term="Order")
    return out["candidates"].select("path", "line", "column", "qualified_name", "kind", F.explode("evidence").alias("e"), F.lit(out["mapping_status"]).alias("mapping_status")).select(
        "path", "line", "column", "qualified_name", "kind", F.col("e.kind").alias("evidence"), F.col("e.line").alias("evidence_line"), F.col("e.column").alias("evidence_column"), "e.expression", "mapping_status"
    )


@query("python_tests_of_attributes", "select tpath as path, t as line, 'imported_module_attribute' as evidence, 'pkg.n' || lpad(k::varchar, 2, '0') || '.take_7' as expression, 'pkg.n' || lpad(k::varchar, 2, '0') as module, 'pkg' as local_name, 2 as import_line from f where s = 7")
def _(q: Asked) -> DataFrame:
    out = q("python.tests", term="take_7")
    found = out["candidates"].select("path", "line", F.explode("evidence").alias("e")).select("path", "line", F.col("e.kind").alias("evidence"), "e.expression")
    return found.join(out["matching_imports"].select("path", "module", "local_name", F.col("line").alias("import_line")), "path")


@query("python_tests_matching_imports", """select tpath as path, 1 as line, 20 + 0 * k as \"column\", 'pkg.n' || lpad(k::varchar, 2, '0') as module, 0 as relative_level, 'Order' as imported_name, 'Order' as local_name from n
 union all select rpath, m, 17, 'n' || lpad(k::varchar, 2, '0'), 1, 'Order', 'Order' || k from n""")
def _(q: Asked) -> DataFrame:
    return q("python.tests", term="Order")["matching_imports"].select("path", "line", "column", "module", "relative_level", "imported_name", "local_name")


_NEAR = "near as (select name, case when name = 'order' then 'exact' else 'lexical' end as pass, count(*) as occurrences, min(path) as first_path from words where lower(name) = 'order' group by name)"


@query("python_neighborhood", f", {_NEAR} select name, pass, occurrences, first_path from near")
def _(q: Asked) -> DataFrame:
    return q("python.neighborhood", seed="order")["nodes"].select("name", "pass", "occurrences", F.array_min(F.transform("locations", lambda p: p["path"])).alias("first_path"))


@query("python_neighborhood_edges", f", {_NEAR} select 'order' as seed, name as neighbor, occurrences as weight, pass as discovery_pass, case pass when 'exact' then 'exact identifier match' else 'shared identifier word' end as reason from near")
def _(q: Asked) -> DataFrame:
    return q("python.neighborhood", seed="order")["edges"]


#: Money stands once in the head of each odd function: beside its parameter in the tree, in no function's scope but its own.
_MONEY = """, per as (select path, name, count(*) as c from words group by 1, 2), seeds as (select path, c from per where name = 'Money')"""


@query("python_neighborhood_structural", f"""{_MONEY} select per.name, 'shared file' as reason, count(*) as weight from per join seeds using (path) where per.name <> 'Money' group by 1
 union all select per.name, 'repeated co-occurrence', sum(least(per.c, seeds.c))::bigint from per join seeds using (path) where per.name <> 'Money' and per.c > 1 and seeds.c > 1 group by 1
 union all select name, 'shared scope', count(*) from (select 'order' as name from f where not even union all select 'amount' from f where not even) group by 1""")
def _(q: Asked) -> DataFrame:
    return q("python.neighborhood.structural", seed="Money")["edges"].where("reason <> 'AST adjacency'")


@query("python_neighborhood_adjacent", "select 'order' as name, count(*) as weight from f having count(*) > 0")
def _(q: Asked) -> DataFrame:
    return q("python.neighborhood.structural", seed="amount")["edges"].where("reason = 'AST adjacency'").select("name", "weight")


@query("python_neighborhood_import_target", f"{_IMPORTS} select target_module as name, count(*) as weight from imp where names = 'Order' group by 1")
def _(q: Asked) -> DataFrame:
    return q("python.neighborhood.structural", seed="Order")["edges"].where("reason = 'import target'").select("name", "weight")


@query("python_neighborhood_historical", f"{_PAIRS} select seed.path as seed_path, case when left_path = seed.path then right_path else left_path end as neighbor, score, commit_count from pairs join (select distinct path from words where name = 'Money') seed on seed.path in (left_path, right_path)")
def _(q: Asked) -> DataFrame:
    return q("python.neighborhood.historical", seed="Money", **BOUNDS)["edges"].withColumn("score", F.round("score", 9))


_BEHAVIOR = """, met as (select 'order' as owner, 'status' as neighbor, 'read' as detail, path, l + 1 as line from f union all select 'order', 'total', 'write', path, case when even then l + 2 else l + 3 end from f
 union all select 'Kind', 'OPEN', 'read', path, l + 1 from f where even)"""


@query("python_neighborhood_behavioral", f"{_BEHAVIOR} select neighbor, 'field access' as relationship, count(*) as \"count\" from met where owner = 'order' group by neighbor")
def _(q: Asked) -> DataFrame:
    return q("python.neighborhood.behavioral", seed="order")["edges"].select("neighbor", "relationship", "count")


@query("python_behavioral_sites", f"{_BEHAVIOR} select owner, neighbor, path, line, detail from met")
def _(q: Asked) -> DataFrame:
    rows = [q("python.neighborhood.behavioral", seed=s)["edges"].select(F.lit(s).alias("owner"), "neighbor", F.explode("sites").alias("x")).select("owner", "neighbor", "x.path", "x.line", "x.detail") for s in ("order", "Kind")]
    return rows[0].unionAll(rows[1])


#: Guards: the status compared in every function. In even ones it stands around two uses, in odd ones it leaves.
_CLUSTER = """, occ as (select path, line, col, name, case kind when 'parameter' then 'parameter' when 'assignment' then 'write' else 'read' end as role from words where name in ('order', 'amount') and kind <> 'class'),
 spot as (select path, l as first_line, l + 6 as last_line, 'take_' || s as scope, even, l from f union all select tpath, t, t + 4, 'test_take_' || s, false, t from f)"""


@query("python_variable_cluster", f"""{_CLUSTER} select occ.path, line, col as \"column\", name, role, case when role = 'parameter' then '' else scope end as own_scope, case when even and line = l + 2 then 'order.status == Kind.OPEN' else '' end as guard from occ join spot on occ.path = spot.path and line between first_line and last_line""")
def _(q: Asked) -> DataFrame:
    found = q("python.variable_cluster", terms=["order", "amount"])["occurrences"]
    return found.select("path", "line", "column", "name", "role", F.when(F.col("role") == "parameter", "").otherwise(F.col("scope")).alias("own_scope"), F.array_join(F.transform("guards", lambda g: g["expression"]), " ").alias("guard"))


@query("python_variable_cluster_shared", """select 'scope' as part, path, 'take_' || s as told, 6 as number from f union all select 'guard', path, 'order.status == Kind.OPEN', l + 1 from f where even
 union all select 'boundary', path, 'parameter order', l from f union all select 'boundary', path, 'parameter amount', l from f union all select 'boundary', path, 'return order', case when even then l + 3 else l + 4 end from f
 union all select 'construction', tpath, 'Order()', t + 1 from f""")
def _(q: Asked) -> DataFrame:
    out = q("python.variable_cluster", terms=["order", "amount"])
    rows = out["shared_scopes"].select(F.lit("scope").alias("part"), "path", F.col("scope").alias("told"), F.col("occurrences").cast("bigint").alias("number"))
    rows = rows.unionAll(out["shared_guards"].select(F.lit("guard"), "path", "expression", "line")).unionAll(out["construction_sites"].select(F.lit("construction"), "path", "value", "line"))
    return rows.unionAll(out["boundaries"].select(F.lit("boundary"), "path", F.concat("kind", F.lit(" "), "name"), "line"))


_OPERATIONS = """, ops as (select path, l + 1 as line, 7 as col, 'status' as field, 'field_read' as kind, 'take_' || s as scope from f union all select path, case when even then l + 2 else l + 3 end, case when even then 8 else 4 end, 'total', 'field_write', 'take_' || s from f)"""


@query("python_object_lifecycle", f"{_OPERATIONS} select path, line, col as \"column\", field, kind, scope from ops")
def _(q: Asked) -> DataFrame:
    return q("python.object_lifecycle", carrier="order")["operations"].select("path", "line", "column", "field", "kind", "scope")


@query("python_lifecycle_groups", f"{_OPERATIONS} select field, kind, count(*) as \"count\" from ops group by 1, 2")
def _(q: Asked) -> DataFrame:
    return q("python.object_lifecycle", carrier="order")["operation_groups"]


@query("python_lifecycle_transitions", f"{_OPERATIONS}, b as (select *, lag(scope) over w as s0, lag(field) over w as f0, lag(kind) over w as from_kind, lag(line) over w as from_line from ops window w as (partition by path order by line, col, kind, field)) select path, from_kind, kind as to_kind, from_line, line as to_line from b where s0 = scope and f0 = field")
def _(q: Asked) -> DataFrame:
    return q("python.object_lifecycle", carrier="order")["transitions"].select("path", "from_kind", "to_kind", "from_line", "to_line")


@query("python_lifecycle_bindings", """select 'construction' as part, tpath as path, t + 1 as line, 'assignment' as kind from f union all select 'boundary', path, l, 'parameter' from f
 union all select 'boundary', path, case when even then l + 3 else l + 4 end, 'return' from f union all select 'boundary', tpath, t + 2, 'argument' from f union all select 'history', path, count(*), '' from ch group by path""")
def _(q: Asked) -> DataFrame:
    out = q("python.object_lifecycle", carrier="order", **BOUNDS)
    rows = [out[f"{part}{end}"].select(F.lit(part).alias("part"), "path", F.col("line").cast("bigint").alias("line"), "kind") for part, end in (("construction", "s"), ("alias", "es"))]
    rows.append(out["boundaries"].select(F.lit("boundary").alias("part"), "path", F.col("line").cast("bigint").alias("line"), "kind"))
    rows.append(out["history"]["files"].select(F.lit("history").alias("part"), "path", F.col("commit_count").cast("bigint").alias("line"), F.lit("").alias("kind")))
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])


_GUARDS = """, g as (select path, l + 1 as line, case when even then 'enclosed_branch' else 'early_exit' end as control_shape, case when even then '==' else '!=' end as operator, case when even then 'Kind.OPEN' else '''open' || kind || '''' end as value,
 '==' as effect_when, case when even then null else 'return' end as exit_kind from f)"""


@query("python_carrier_guards", f"{_GUARDS} select path, line, control_shape, operator, value, effect_when, exit_kind, 1 as modifications from g")
def _(q: Asked) -> DataFrame:
    changed = F.size(F.filter("effects", lambda e: e["role"] == "modification"))
    return q("python.carrier_guards", carrier="order")["occurrences"].select("path", "line", "control_shape", "operator", "value", "effect_when", "exit_kind", changed.alias("modifications"))


@query("python_carrier_guard_groups", f"{_GUARDS} select 'order' as carrier, 'status' as field, value, effect_when, count(*) as occurrence_count, count(distinct path) as path_count, count(*) as modifications, 0 as accesses from g group by value, effect_when")
def _(q: Asked) -> DataFrame:
    return q("python.carrier_guards", carrier="order")["groups"].drop("occurrences")


_RULES = """, rule as (select 'comparison' as kind, 'status' as field, case when even then '==' else '!=' end as operator, case when even then 'Kind.OPEN' else '''open' || kind || '''' end as value, path, l + 1 as line from f)"""


@query("python_external_field_rules", f"{_RULES} select kind, field, operator, value, count(*) as occurrence_count, min(path) as first_path from rule group by 1, 2, 3, 4 having count(*) > 1")
def _(q: Asked) -> DataFrame:
    return q("python.external_field_rules", carrier="order")["rules"].select("kind", "field", "operator", "value", "occurrence_count", F.array_min(F.transform("occurrences", lambda o: o["path"])).alias("first_path"))


@query("python_external_field_affinities", "select 'status' as left_field, 'total' as right_field, count(*) as functions, 2 * count(*) as occurrences, count(*) as reads, count(*) as writes, 0 as deletes from f having count(*) > 1")
def _(q: Asked) -> DataFrame:
    return q("python.external_field_rules", carrier="order")["affinities"]


@query("python_external_field_rules_tests", "select 'take_' || s as symbol, tpath as path, t + 2 as line, 'test_take_' || s as test from f")
def _(q: Asked) -> DataFrame:
    return q("python.external_field_rules", carrier="order")["tests"].select("symbol", "path", "line", "test")


@query("python_external_field_rules_history", "select path, count(*) as commit_count from ch where path in (select path from f) group by path")
def _(q: Asked) -> DataFrame:
    return q("python.external_field_rules.history", carrier="order", **BOUNDS)["history"]["files"].select("path", "commit_count")


@query("python_seed_evidence", f", {_NEAR} select pass, name, path, line, col as \"column\" from words join near using (name)")
def _(q: Asked) -> DataFrame:
    return q("python.seed_evidence", seed="order")["locations"].select("pass", "name", "path", "line", "column")


@query("python_term_change_evidence", f"""{_GUARDS}, {_NEAR} select (select count(*) from g) as occurrences, (select count(*) from (select distinct value, effect_when from g)) as groups, (select count(*) from near) as nodes, (select sum(occurrences)::bigint from near) as locations,
 (select sum(occurrences) > 32 from near) as locations_truncated, (select count(*) from near) as edges, (select count(distinct path) from ch) as files, (select count(*) from f) as constructions, (select 2 * count(*) from f) as operations""")
def _(q: Asked) -> DataFrame:
    d = q("python.term_change_evidence", term="order", **BOUNDS)["dimensions"]
    return q.one({
        "occurrences": d["ownership"]["occurrence_count"], "groups": d["ownership"]["group_count"], "nodes": d["multiplicity"]["node_count"], "locations": d["multiplicity"]["location_count"],
        "locations_truncated": d["multiplicity"]["locations_truncated"], "edges": d["coupling"]["edge_count"], "files": d["history"]["file_count"],
        "constructions": d["representations"]["construction_count"], "operations": d["representations"]["operation_count"],
    })


# --- profiles ---

_PROFILED = "(select * from f where s in (select min(s) from f union all select max(s) from f) order by s)"


def targets(q: Asked) -> list[tuple[str, str]]:
    """The functions of the least and the greatest supplier key, and one that is not there."""
    found = q("python.complexity")["functions"].where("path like 'pkg/%'").select("path", "qualified_name").collect()
    found.sort(key=lambda r: int(re.sub(r"\D", "", r.qualified_name)))
    return [tuple(found[0]), tuple(found[-1]), ("pkg/n00.py", "none")]


@query("python_function_profiles", f"""select row_number() over (order by s) - 1 as at, path, 'take_' || s as qualified_name, 'found' as match_status, 1 as branch_count, 2 as cyclomatic_count, case when even then 4 else 5 end as line_count, case when even then 1 else 0 end as primitive_count, case when even then 0 else 1 end as specialized_count,
 case when even then 1.0::double else 0.0::double end as primitive_ratio from {_PROFILED} union all select 2, 'pkg/n00.py', 'none', 'not_found', null, null, null, null, null, null""")
def _(q: Asked) -> DataFrame:
    return q("python.function_profiles", targets=targets(q))["profiles"].select("at", "path", "qualified_name", "match_status", "branch_count", "cyclomatic_count", "line_count", "primitive_count", "specialized_count", "primitive_ratio")


@query("python_function_profile", """, one as (select * from f where s = (select max(s) from f)) select 'guard' as kind, l + 1 as line, 1 as site_count, case when even then 'order.status == Kind.OPEN' else 'order.status != ''open' || kind || '''' end as text from one
 union all select 'comparison', l + 1, 1, case when even then 'eq' else 'not_eq' end from one union all select 'attribute_write', case when even then l + 2 else l + 3 end, 1, 'order.total' from one
 union all select 'attribute_read', l + 1, case when even then 2 else 1 end, 'order.status' from one union all select 'attribute_read', l + 1, 2, 'Kind.OPEN' from one where even""")
def _(q: Asked) -> DataFrame:
    path, name = targets(q)[1]
    sites = q("python.function_profile", path=path, qualified_name=name)["profiles"].select(F.explode("sites").alias("k")).select("k.kind", "k.site_count", F.explode("k.sites").alias("x"))
    return sites.select("kind", "x.line", "site_count", "x.text")


@query("python_class_profile", "select 'found' as match_status, 11 as line, 13 as end_line, 1 as primitive_count, 1 as specialized_count, 0.5::double as primitive_ratio, 0 as methods from n where k = 3")
def _(q: Asked) -> DataFrame:
    out = q("python.class_profile", path="pkg/n03.py", qualified_name="Order")
    return out["class"].select(F.lit(out["match_status"]).alias("match_status"), "line", "end_line", "primitive_count", "specialized_count", "primitive_ratio", F.lit(out["methods"].count()).alias("methods"))


# --- access ---


@query("topic_cache", "select * from (values ('first', 'miss', ''), ('same', 'hit', ''), ('later', 'invalidated', 'repository_revision'), ('other', 'miss', '')) as v(asked, cache_status, differences)")
def _(q: Asked) -> DataFrame:
    key = {"repository_revision": "r1", "topic_sha": q.shas()[-1], "matching_policy": "hunks", "since_unix_time": SINCE, "limit": LIMIT}
    cache = TopicCache(q.spark, f"{shared_folder(q.spark)}/topics-{uuid.uuid4().hex}")
    told = lambda asked, k: cache.lookup(k).select(F.lit(asked).alias("asked"), "cache_status", F.array_join(F.transform("differences", lambda d: d["name"]), ",").alias("differences")).collect()
    rows = told("first", key | {"limit": 1})
    cache.store(key, "{}")
    rows += told("same", key) + told("later", key | {"repository_revision": "r2"}) + told("other", key | {"limit": 2})
    return q.spark.createDataFrame(rows)


@query("contract_examples", "select * from (values (2, 'unknown_tool', 'no_such'), (3, 'unknown_arguments', 'odd'), (3, 'missing_arguments', 'limit,repository_root,since_unix_time'), (4, 'missing_arguments', 'carrier')) as v(example, problem, names)")
def _(q: Asked) -> DataFrame:
    examples = [{"tool": "git_history", "arguments": {"repository_root": "."} | BOUNDS}, {"tool": "no.such"}, {"tool": "git.hotspots", "arguments": {"odd": 1}}, {"tool": "python_carrier_guards", "arguments": {"repository_root": "."}}]
    return check_examples(q.spark, examples).select("example", "problem", F.array_join("names", ",").alias("names"))


@query("contract_tools", "select * from (values ('git_history', 'limit', 'integer', true), ('git_line_origins', 'lines', 'array of integers', true), ('python_neighborhood', 'seed', 'string', true), ('python_object_lifecycle', 'carrier', 'string', true), ('python_object_lifecycle', 'limit', 'integer', false)) as v(tool, parameter, type, required)")
def _(q: Asked) -> DataFrame:
    rows = [(o["tool"], p["name"], p["type"], p["required"]) for o in contract() for p in o["parameters"]]
    wanted = [("git_history", "limit"), ("git_line_origins", "lines"), ("python_neighborhood", "seed"), ("python_object_lifecycle", "carrier"), ("python_object_lifecycle", "limit")]
    every = q.spark.createDataFrame(rows, "tool string, parameter string, type string, required boolean")
    return every.join(q.spark.createDataFrame(wanted, "tool string, parameter string"), ["tool", "parameter"], "left_semi").select("tool", "parameter", "type", "required")


@query("rejections", """select * from (values ('bounds', 'invalid_query'), ('both', 'invalid_query'), ('carrier', 'invalid_query'), ('half', 'invalid_query'), ('measure', 'unsupported_measure'), ('neither', 'not_implemented'), ('pair', 'invalid_query'), ('path', 'invalid_query'),
 ('tool', 'not_implemented'), ('topic', 'repository_access_failed')) as v(asked, code)""")
def _(q: Asked) -> DataFrame:
    asked = {
        "bounds": ("git.history", {"since_unix_time": 0, "limit": 1}), "both": ("python.variable_cluster", {"term": "a", "terms": ["a", "b"]}), "neither": ("python.variable_cluster", {}),
        "carrier": ("python_object_lifecycle", {"carrier": "a b"}), "half": ("python.object_lifecycle", {"term": "a", "limit": 3}), "measure": ("python_structural_complexity", {"measure": "odd"}),
        "pair": ("git.cochange.pair", {"left_path": "a", "right_path": "./a"} | BOUNDS), "path": ("git_cochange_file", {"term": "../x"} | BOUNDS), "tool": ("git_nothing", {}), "topic": ("git_topic", {"term": "abcdef0123"}),
    }
    return q.spark.createDataFrame([(k, q.session.run(name, **given)["error"]["code"]) for k, (name, given) in asked.items()], "asked string, code string")
