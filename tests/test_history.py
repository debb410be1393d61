import pytest
from pyspark.sql import functions as F

from strataquery.operators import history

CHANGES = "commit long, ts timestamp, path string, additions long, deletions long"


def changes(spark, rows):
    return spark.createDataFrame([(c, None, p, 1, 0) for c, p in rows], CHANGES)


def test_cochange_weighs_each_commit_one(spark):
    frame = changes(spark, [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "b"), (3, "a")])
    got = {(r.left_path, r.right_path): (pytest.approx(r.score, abs=1e-15), r.commit_count) for r in history.cochange(frame).collect()}
    assert got == {("a", "b"): (1 / 3 + 1, 2), ("a", "c"): (1 / 3, 1), ("b", "c"): (1 / 3, 1)}
    assert {(r.left_path, r.right_path): (r.score, r.commit_count) for r in history.scoped_cochange(frame, "c").collect()} == {k: v for k, v in got.items() if "c" in k}
    assert [r.contributing_commits for r in history.cochange(frame).where("left_path = 'a' and right_path = 'b'").collect()] == [[1, 2]]
    newest = frame.withColumn("commit_seq", 3 - F.col("commit"))
    assert history.cochange(newest).where("left_path = 'a' and right_path = 'b'").first().contributing_commits == [2, 1]
    e = history.eligibility(frame).first()
    assert (e.eligible, e.excluded) == (2, 1)


def test_empty_history(spark):
    frame = changes(spark, [])
    assert history.cochange(frame).collect() == []
    assert history.hotspots(frame).collect() == []


def test_categories(spark):
    frame = spark.createDataFrame([(1, "feat(x)!: a"), (2, "Fix: b"), (3, "odd: c"), (4, "none"), (5, None)], "commit long, subject string")
    got = {(r.raw, r.category): r.commit_count for r in history.categories(frame).collect()}
    assert got == {("feat", "feature"): 1, ("fix", "fix"): 1, ("odd", "unknown"): 1, ("", "unknown"): 2}


def test_weights_are_checked(spark):
    frame = changes(spark, [(1, "a"), (1, "b"), (1, "c")])
    quarter = history.Weighting(lambda n: n * 0.25, "N/4", "", "N/4", "")
    assert {r.score for r in history.cochange(frame, quarter).collect()} == {0.75}
    assert history.EVEN.told()["per_pair_formula"] == "2/(N*(N-1))"
    for wrong in (lambda n: n * 0, lambda n: -n, lambda n: n / F.lit(0.0), lambda n: F.lit(None).cast("double")):
        with pytest.raises(Exception, match="weight must be positive and finite|DIVIDE_BY_ZERO"):
            history.cochange(frame, history.Weighting(wrong, "", "", "", "")).collect()


@pytest.mark.parametrize(("name", "words"), [("HTTPServer-error", ["http", "server", "error"]), ("payment_processor", ["payment", "processor"]), ("", [])])
def test_identifier_words(spark, name, words):
    from strataquery.functions.words import identifier_words

    assert spark.createDataFrame([(name,)], "name string").select(identifier_words(F.col("name")).alias("w")).first().w == words
