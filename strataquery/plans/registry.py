"""The operators of history, graph and code over the driver's tables, with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code
from ..operators import graph as gr
from ..operators import history as hi

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


class Tables:
    """The driver's tables as the relations that operators take."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.at = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}.parquet")

    def changes(self) -> DataFrame:
        orders = self.orders.select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"))
        lines = self.lineitem.select(
            F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("path"), F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions")
        )
        return lines.join(orders, "commit")

    def order_commits(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"))

    def event_commits(self) -> DataFrame:
        subject = F.concat(F.when(F.col("event_type") == "error", "fix").when(F.col("event_type") == "signup", "feat").otherwise(F.col("event_type")), F.lit("(k): "), F.col("props"))
        return self.events.select(F.col("event_id").alias("commit"), "ts", subject.alias("subject"))


_CHANGES = "changes as (select l_orderkey as commit, o_orderdate as ts, l_suppkey as path, cast(l_quantity as bigint) as additions, cast(l_linenumber as bigint) as deletions from lineitem join orders on l_orderkey = o_orderkey)"
_PAIRS = f"""with {_CHANGES}, p as (select distinct commit, path from changes), n as (select commit, count(*) as n from p group by commit having count(*) > 1),
 pairs as (select a.path as left_path, b.path as right_path, n.n from p a join p b on a.commit = b.commit and a.path < b.path join n on n.commit = a.commit)"""
_SCORES = "select left_path, right_path, round(sum(2.0::double / (n::double * (n::double - 1))), 6) as score, count(*) as commit_count from pairs"
_FOCUS = 7
_PAIR = (3, 11)


def rounded(pairs: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order, so that they are compared to six places."""
    return pairs.select("left_path", "right_path", F.round("score", 6).alias("score"), "commit_count")


@query("cochange_global", f"{_PAIRS} {_SCORES} group by all")
def cochange_global(spark, sf_dir):
    return rounded(hi.cochange(Tables(spark, sf_dir).changes()))


@query("cochange_file", f"{_PAIRS} {_SCORES} where left_path = {_FOCUS} or right_path = {_FOCUS} group by all")
def cochange_file(spark, sf_dir):
    return rounded(hi.scoped_cochange(Tables(spark, sf_dir).changes(), _FOCUS))


@query("cochange_pair", f"""{_PAIRS} select {_PAIR[0]}::bigint as left_path, {_PAIR[1]}::bigint as right_path,
 coalesce(round(sum(2.0::double / (n::double * (n::double - 1))), 6), 0.0::double) as score, count(*) as commit_count from pairs where left_path = {_PAIR[0]} and right_path = {_PAIR[1]}""")
def cochange_pair(spark, sf_dir):
    return rounded(hi.pair_cochange(Tables(spark, sf_dir).changes(), *_PAIR))


@query("cochange_eligibility", f"with {_CHANGES}, n as (select commit, count(distinct path) as n from changes group by commit) select count(*) filter (n > 1) as eligible, count(*) filter (n <= 1) as excluded from n")
def cochange_eligibility(spark, sf_dir):
    return hi.eligibility(Tables(spark, sf_dir).changes())


@query("hotspots", f"""with {_CHANGES} select path, count(distinct commit) as commit_count, cast(sum(additions) as bigint) as additions, cast(sum(deletions) as bigint) as deletions,
 cast(sum(additions) + sum(deletions) as bigint) as changed_lines, cast(sum(additions) + sum(deletions) as double) / count(distinct commit) as average_churn from changes group by path""")
def hotspots(spark, sf_dir):
    return hi.hotspots(Tables(spark, sf_dir).changes())


@query("weekly_distribution", """with w as (select cast(date_trunc('week', o_orderdate) as date) as week_start, count(*) as commit_count from orders group by 1),
 s as (select cast(unnest(generate_series((select min(week_start) from w)::timestamp, (select max(week_start) from w)::timestamp, interval 7 days)) as date) as week_start)
 select s.week_start, coalesce(commit_count, 0) as commit_count from s left join w on s.week_start = w.week_start""")
def weekly_distribution(spark, sf_dir):
    return hi.weekly(Tables(spark, sf_dir).order_commits())


@query("message_categories", r"""with s as (select concat(case event_type when 'error' then 'fix' when 'signup' then 'feat' else event_type end, '(k): ', props) as subject from events),
 r as (select lower(regexp_extract(subject, '^([A-Za-z]+)(\([^)]*\))?!?:\s', 1)) as raw from s)
 select raw, case raw when 'fix' then 'fix' when 'feat' then 'feature' else 'unknown' end as category, count(*) as commit_count from r group by 1, 2""")
def message_categories(spark, sf_dir):
    return hi.categories(Tables(spark, sf_dir).event_commits())


def places(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Suppliers below nations below regions, as nodes and edges; r:, n: and s: keep their names apart."""
    region, nation, supplier = (F.concat(F.lit(f"{k}:"), F.col(c)) for k, c in (("r", "n_regionkey"), ("n", "n_nationkey"), ("s", "s_suppkey")))
    up = t.nation.select(nation.alias("source"), region.alias("target"), F.lit(1.0).alias("weight"))
    below = t.supplier.select(supplier.alias("source"), F.concat(F.lit("n:"), F.col("s_nationkey")).alias("target"), F.lit(1.0).alias("weight"))
    nodes = t.region.select(F.concat(F.lit("r:"), F.col("r_regionkey")).alias("node"))
    return nodes, up.unionAll(below)


_TREE = """p as (select 'n:' || n_nationkey as child, 'r:' || n_regionkey as parent, 'r:' || n_regionkey as top, 1 + (select count(*) from supplier where s_nationkey = n_nationkey) as below from nation
 union all select 's:' || s_suppkey, 'n:' || s_nationkey, 'r:' || n_regionkey, 1 from supplier join nation on s_nationkey = n_nationkey),
 m as (select node, top from (select child as node, top from p union all select 'r:' || r_regionkey, 'r:' || r_regionkey from region) group by all)"""


@query("graph_components", f"with {_TREE} select node, min(node) over (partition by top) as label, count(*) over (partition by top) as size from m")
def graph_components(spark, sf_dir):
    labels = gr.components(*places(Tables(spark, sf_dir)))
    return labels.join(labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "label").select("node", "label", "size")


@query("graph_edge_betweenness", f"""with {_TREE}, c as (select top, count(*) as size from m group by 1), n as (select count(*) as n from m)
 select least(child, parent) as a, greatest(child, parent) as b, round(2.0::double * below * (size - below) / (n * (n - 1)), 6) as betweenness from p join c on c.top = p.top cross join n""")
def graph_edge_betweenness(spark, sf_dir):
    return gr.edge_betweenness(*places(Tables(spark, sf_dir))).withColumn("betweenness", F.round("betweenness", 6))


@query("graph_bridge_scores", f"""with {_TREE}, c as (select top, count(*) as size from m group by 1), n as (select count(*) as n from m),
 b as (select child, parent, 2.0::double * below * (size - below) / (n * (n - 1)) as betweenness from p join c on c.top = p.top cross join n), ends as (select child as node, betweenness from b union all select parent, betweenness from b)
 select m.node, count(betweenness) as degree, coalesce(round(sum(betweenness) / count(betweenness), 2), 0.0) as bridge_score from m left join ends on ends.node = m.node group by m.node""")
def graph_bridge_scores(spark, sf_dir):
    return gr.node_scores(*places(Tables(spark, sf_dir)))


@query("repeated_lines", """with l as (select doc_id, unnest(string_split(lower(text), chr(10))) as value from documents where text is not null)
 select value, count(*) as occurrence_count, min(doc_id) as first_id from l where value <> '' group by value having count(*) > 1""")
def repeated_lines(spark, sf_dir):
    pieces = Tables(spark, sf_dir).documents.select("doc_id", F.explode(F.split(F.lower("text"), "\n")).alias("value")).where("value <> ''")
    return code.occurrences(pieces, ["value"], ["doc_id"]).select("value", "occurrence_count", F.col("occurrences")[0]["doc_id"].alias("first_id"))


@query("event_transitions", """with o as (select cast(cast(ts as date) as varchar) as path, event_id as line, event_type as field, case when value > 10 then 'field_write' else 'field_read' end as kind, cast(user_id % 7 as varchar) as scope from events),
 l as (select *, lag(scope) over w as s0, lag(field) over w as f0, lag(kind) over w as from_kind, lag(line) over w as from_line from o window w as (partition by path order by line))
 select path, scope, field, from_kind, kind as to_kind, from_line, line as to_line from l where s0 = scope and f0 = field""")
def event_transitions(spark, sf_dir):
    kind = F.when(F.col("value") > 10, "field_write").otherwise("field_read")
    operation = F.struct(F.col("event_id").alias("line"), F.lit(0).alias("column"), F.lit("it").alias("carrier"), F.col("event_type").alias("field"), kind.alias("kind"), (F.col("user_id") % 7).cast("string").alias("scope"))
    events = Tables(spark, sf_dir).events.select(F.to_date("ts").cast("string").alias("path"), operation.alias("operation"))
    return code.operation_transitions(events.groupBy("path").agg(F.collect_list("operation").alias("operations")), "it")


@query("review_edges", "select s_name as source, s_nationkey as target, (select count(*) from supplier) as edge_count, (select count(*) > 16 from supplier) as edges_truncated from supplier order by s_name, s_nationkey limit 16")
def review_edges(spark, sf_dir):
    return code.capped(Tables(spark, sf_dir).supplier.select(F.col("s_name").alias("source"), F.col("s_nationkey").alias("target")), ["source", "target"], 16)
