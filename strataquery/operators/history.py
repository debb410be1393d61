"""History operators: DataFrames of commits and file changes in, reports out.

commits: seq, commit, ts, author_name, author_email, subject. changes: commit, ts, path, additions, deletions, and where
an order is asked for commit_seq.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Conventional-commit prefixes and the categories they stand for.
CATEGORIES = {
    "build": "build", "chore": "chore", "ci": "ci", "docs": "docs", "feat": "feature", "fix": "fix",
    "perf": "performance", "refactor": "refactor", "revert": "revert", "style": "style", "test": "test",
}
CONVENTIONAL = r"^([A-Za-z]+)(\([^)]*\))?!?:\s"


def hotspots(changes: DataFrame) -> DataFrame:
    """Per path: different commits, additions, deletions, churn, churn per commit."""
    per_path = changes.groupBy("path").agg(
        F.countDistinct("commit").alias("commit_count"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")
    )
    churn = F.col("additions") + F.col("deletions")
    return per_path.withColumn("changed_lines", churn).withColumn("average_churn", churn / F.col("commit_count"))


def weekly(commits: DataFrame) -> DataFrame:
    """Commits of each week from Monday on, weeks without any included."""
    weeks = commits.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week_start")).agg(F.count(F.lit(1)).alias("commit_count"))
    ends = weeks.agg(F.min("week_start").alias("lo"), F.max("week_start").alias("hi"))
    spine = ends.select(F.explode(F.expr("sequence(lo, hi, interval 7 days)")).alias("week_start"))
    return spine.join(weeks, "week_start", "left").withColumn("commit_count", F.coalesce("commit_count", F.lit(0)))


def categories(commits: DataFrame, known: dict[str, str] = CATEGORIES) -> DataFrame:
    """Commits by raw prefix of the subject and the category it stands for; unknown where there is none."""
    raw = F.nullif(F.lower(F.regexp_extract("subject", CONVENTIONAL, 1)), F.lit(""))
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    counted = commits.groupBy(raw.alias("raw")).agg(F.count(F.lit(1)).alias("commit_count"))
    return counted.select(F.coalesce("raw", F.lit("")).alias("raw"), F.coalesce(F.try_element_at(names, F.col("raw")), F.lit("unknown")).alias("category"), "commit_count")


def ownership(commits: DataFrame) -> DataFrame:
    """Commits of each author, newest first: commits(seq, commit, author_name, author_email)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "commit"))), lambda x: x["commit"]).alias("commits")
    return commits.groupBy("author_name", "author_email").agg(F.count(F.lit(1)).alias("commit_count"), listed)


def commit_lists(changes: DataFrame) -> DataFrame:
    """Each path's different commits, newest first: changes(commit_seq, commit, path)."""
    listed = F.transform(F.array_sort(F.collect_set(F.struct("commit_seq", "commit"))), lambda x: x["commit"])
    return changes.groupBy("path").agg(listed.alias("commits"))


def inverse_pairs(n: Column) -> Column:
    """The weight of one of the n(n-1)/2 pairs of a commit, so that every commit weighs 1."""
    return F.lit(2.0) / (n * (n - 1))


@dataclass(frozen=True)
class Weighting:
    """What a pair of an N-file commit weighs, as a Column of N, with its description. A weight that is not positive and
    finite ends the query with an error."""

    weight: Callable[[Column], Column]
    formula: str
    pair_count_formula: str
    per_pair_formula: str
    invariant: str

    def of(self, n: Column) -> Column:
        w = self.weight(n)
        sound = w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf"))
        return F.when(sound, w).otherwise(F.raise_error(F.concat(F.lit("weight must be positive and finite: "), F.coalesce(w.cast("string"), F.lit("null")))))

    def told(self) -> dict[str, str]:
        return {k: v for k, v in vars(self).items() if k != "weight"}


#: The description of the default.
EVEN = Weighting(inverse_pairs, "1/C(N,2)", "N*(N-1)/2", "2/(N*(N-1))", "each_eligible_commit_contributes_one_total_pair_affinity_mass")


def cochange(changes: DataFrame, weighting: Weighting = EVEN, focus: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Affinity of path pairs: the sum of the weights of the commits that change both, with these commits, newest first
    where changes has commit_seq.

    focus keeps the pairs for which it holds of the left and the right path. Commits of one path have no pair. A commit's
    paths are gathered once, by one shuffle, and its pairs are made where they are; a commit of N paths makes N(N-1)/2
    rows, which is the report's own size, but never more than N of them at a time.
    """
    seq = F.col("commit_seq") if "commit_seq" in changes.columns else F.lit(0)
    commits = changes.groupBy("commit").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.min(seq).alias("seq")).withColumn("n", F.size("paths")).where("n > 1")
    lefts = commits.select("commit", "seq", "n", "paths", F.posexplode("paths").alias("at", "left_path"))
    pairs = lefts.select("commit", "seq", "n", "left_path", F.explode(F.slice("paths", F.col("at") + 2, F.col("n"))).alias("right_path"))
    if focus is not None:
        pairs = pairs.where(focus(F.col("left_path"), F.col("right_path")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "commit"))), lambda x: x["commit"])
    scored = pairs.withColumn("weight", weighting.of(F.col("n").cast("double")))
    return scored.groupBy("left_path", "right_path").agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("commit_count"), listed.alias("contributing_commits"))


def scoped_cochange(changes: DataFrame, path) -> DataFrame:
    """cochange of the pairs that hold path; only commits that change it are looked at."""
    own = changes.where(F.col("path") == path).select("commit").distinct()
    return cochange(changes.join(own, "commit", "left_semi"), focus=lambda left, right: (left == path) | (right == path))


def pair_cochange(changes: DataFrame, a, b) -> DataFrame:
    """cochange of one pair: always one row, with score 0 where no commit changes both."""
    lo, hi = min(a, b), max(a, b)
    found = scoped_cochange(changes, a).where((F.col("left_path") == lo) & (F.col("right_path") == hi))
    kind = changes.schema["path"].dataType
    one = changes.sparkSession.range(1).select(F.lit(lo).cast(kind).alias("left_path"), F.lit(hi).cast(kind).alias("right_path"))
    return one.join(found, ["left_path", "right_path"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("commit_count", F.coalesce("commit_count", F.lit(0)))


def eligibility(changes: DataFrame) -> DataFrame:
    """How many commits can and can't have pairs."""
    n = changes.groupBy("commit").agg(F.countDistinct("path").alias("n"))
    return n.agg(F.count_if(F.col("n") > 1).alias("eligible"), F.count_if(F.col("n") <= 1).alias("excluded"))
