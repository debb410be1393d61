"""Hunks of patches and how they match: patches(commit, parent, patch) in, one row per hunk out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

HEADER = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
SCHEMA = (
    "commit string, seq long, path string, old_start long, old_count long, new_start long, new_count long, lines array<string>,"
    " normalized_body string, fingerprint string, hunk_id string"
)
#: The words for git's letters.
MOVES = {"A": "added", "D": "deleted", "M": "modified", "R": "rename", "C": "copy"}
#: Kept lines of a patch's body besides + - and context.
NO_NEWLINE = "\\ No newline at end of file"


def parse_patch(patch: bytes) -> list[dict]:
    """Hunks in the patch's order. Trailing blanks do not count for the normalised body; a deleted file's path is empty."""
    path, found, lines = "", [], None
    for line in patch.decode("utf-8", "replace").splitlines():
        head = HEADER.match(line)
        if line.startswith("diff --git "):
            path, lines = "", None
        elif head:
            old, old_n, new, new_n = (int(x) if x else 1 for x in head.groups())
            lines = []
            found.append({"path": path, "old_start": old, "old_count": old_n, "new_start": new, "new_count": new_n, "lines": lines})
        elif lines is None:
            path = line[6:] if line.startswith("+++ b/") else path
        elif line[:1] in ("+", "-", " ") or line == NO_NEWLINE:
            lines.append(line)
    for seq, hunk in enumerate(found):
        body = "\n".join(x[0] + x[1:].rstrip() if x else x for x in hunk["lines"])
        digest = hashlib.sha256(body.encode()).hexdigest()
        hunk |= {"seq": seq, "normalized_body": body, "fingerprint": digest, "hunk_id": f"{hunk['path']}:{hunk['new_start']}:{digest[:12]}"}
    return found


def hunks(patches: DataFrame) -> DataFrame:
    """All hunks of all patches; a commit without a patch has none."""
    schema = _parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [h | {"commit": row["commit"]} for h in parse_patch(row["patch"] or b"")]
                yield pa.RecordBatch.from_pylist(found, arrow)

    return patches.select("commit", "patch").mapInArrow(run, schema)


def context(side: DataFrame) -> DataFrame:
    lines = F.transform(F.filter("lines", lambda x: x.startswith(" ")), lambda x: F.trim(F.substring(x, 2, 1 << 30)))
    return side.select("commit", "seq", F.explode(F.array_distinct(lines)).alias("line"))


def keys(side: DataFrame) -> DataFrame:
    """commit, key: everything that two hunks must have in common, one of it at least, to match."""
    body = side.select("commit", F.concat(F.lit("body "), "fingerprint").alias("key"))
    path = side.select("commit", F.concat(F.lit("path "), "path").alias("key"))
    return body.unionAll(path).unionAll(context(side).select("commit", F.concat(F.lit("line "), "line")))


def match(topic: DataFrame, prior: DataFrame) -> DataFrame:
    """Pairs of hunks by the first method that fits: equal bodies, overlapping new lines of one path, shared context lines.
    Each method is a join on a key of its own, so no pair is tried that shares neither body, path nor line."""
    ids = ["topic_commit", "topic_seq", "prior_commit", "prior_seq"]

    def pairs(on: str) -> DataFrame:
        t = topic.select(F.col("commit").alias("topic_commit"), F.col("seq").alias("topic_seq"), F.col("new_start").alias("ts"), F.col("new_count").alias("tn"), on)
        p = prior.select(F.col("commit").alias("prior_commit"), F.col("seq").alias("prior_seq"), F.col("new_start").alias("ps"), F.col("new_count").alias("pn"), on)
        return t.join(p, on)

    none = F.array().cast("array<string>")
    exact = pairs("fingerprint").select(*ids, F.lit(1).alias("rank"), F.lit("exact_normalized_body").alias("method"), F.lit(0).cast("long").alias("overlap"), none.alias("shared_context"))
    end = F.least(F.col("ts") + F.greatest("tn", F.lit(1)), F.col("ps") + F.greatest("pn", F.lit(1)))
    ranges = pairs("path").withColumn("overlap", end - F.greatest("ts", "ps")).where("overlap > 0")
    ranges = ranges.select(*ids, F.lit(2).alias("rank"), F.lit("range_overlap").alias("method"), "overlap", none.alias("shared_context"))
    t, p = (context(side).select(F.col("commit").alias(f"{name}_commit"), F.col("seq").alias(f"{name}_seq"), "line") for side, name in ((topic, "topic"), (prior, "prior")))
    best = Window.partitionBy(*ids).orderBy("rank")
    nearer = exact.unionByName(ranges).withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "rank")
    # a line that stands in many hunks is one row a side until the hunks meet; what nearer methods matched is left out before
    # lines are gathered
    t, p = (side.groupBy("line").agg(F.collect_list(F.struct(f"{name}_commit", f"{name}_seq")).alias(name)) for side, name in ((t, "topic"), (p, "prior")))
    met = t.join(p, "line").select("line", F.explode("topic").alias("topic"), "prior").select("line", "topic.*", F.explode("prior").alias("prior")).select("line", "topic_commit", "topic_seq", "prior.*")
    shared = met.join(nearer.select(*ids), ids, "left_anti").groupBy(*ids).agg(F.sort_array(F.collect_list("line")).alias("shared_context"))
    shared = shared.select(*ids, F.lit("context_overlap").alias("method"), F.size("shared_context").cast("long").alias("overlap"), "shared_context")
    return nearer.select(*ids, "method", "overlap", "shared_context").unionByName(shared)


def unmatched(topic: DataFrame, matches: DataFrame) -> DataFrame:
    """Topic hunks that no prior hunk matches, as rows of no method."""
    ids = topic.select(F.col("commit").alias("topic_commit"), F.col("seq").alias("topic_seq"))
    return ids.join(matches, ["topic_commit", "topic_seq"], "left_anti").select("*", F.lit("no_match").alias("method"), F.lit("unmatched").alias("status"))


def path_status(changes: DataFrame) -> DataFrame:
    """name_status rows with the word for what became of the path."""
    words = F.create_map(*(F.lit(v) for pair in MOVES.items() for v in pair))
    moved = F.coalesce(F.try_element_at(words, F.col("status")), F.lit("path_transition"))
    stayed = F.coalesce(F.try_element_at(words, F.col("status")), F.lit("discontinuity"))
    return changes.withColumn("status", F.when(F.col("previous_path").isNotNull(), moved).otherwise(stayed))


def added_branches(found: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """Added lines that open a branch, with their number in the new file: commit, path, line, keyword, text."""
    new = F.filter("lines", lambda x: x.startswith("+") | x.startswith(" "))
    each = found.select("commit", "path", "seq", "new_start", F.posexplode(new).alias("at", "raw")).where(F.col("raw").startswith("+"))
    text = F.ltrim(F.substring("raw", 2, 1 << 30))
    keyword = F.regexp_extract(text, r"^(" + "|".join(keywords) + r")\b", 1)
    return each.select("commit", "path", (F.col("new_start") + F.col("at")).alias("line"), keyword.alias("keyword"), text.alias("text")).where("keyword <> ''")


def change_status(changes: DataFrame, found: DataFrame, commit_status: str, binary: bool) -> DataFrame:
    """A commit's changed paths with hunk_status and number of hunks: changes(path, previous_path, status)."""
    at = found.groupBy("path").agg(F.count(F.lit(1)).alias("hunks"))
    joined = changes.join(at, "path", "left").join(at.select(F.col("path").alias("previous_path"), F.col("hunks").alias("before")), "previous_path", "left")
    number = F.coalesce("hunks", F.lit(0)) + F.coalesce("before", F.lit(0))
    status = F.when(number > 0, "available").when(F.col("status") == "R", "rename_only").otherwise("no_hunks")
    if commit_status in ("initial", "merge") or binary:
        status = F.lit(commit_status if commit_status in ("initial", "merge") else "binary")
    return joined.select("path", "previous_path", "status", number.alias("hunk_count"), status.alias("hunk_status"))
