"""Reports on Python source: an extraction of sources.python_code in, sorted DataFrames out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import holds_all, identifier_words, shares_any
from ..sources.python_code import relation

#: Relations that hold where a predicate is false.
FLIPPED = {"==": "!=", "!=": "==", "is": "is not", "is not": "is", "isinstance": "not_isinstance", "not_isinstance": "isinstance"}
PLACE = ["path", "line", "column"]
#: Statements that open a branch.
BRANCHES = ("if", "for", "while", "try", "except", "match", "case")


def capped(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first limit rows with the count of all and whether any were left out."""
    total = rows.agg(F.count(F.lit(1)).alias("edge_count"))
    return rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(total)).withColumn("edges_truncated", F.col("edge_count") > limit)


def words_of(term: str) -> list[str]:
    humps = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", re.sub(r"([A-Z])([A-Z][a-z])", r"\1_\2", term))
    return [w for w in re.split(r"[^a-z0-9]+", humps.lower()) if w]


def inventory(x: DataFrame) -> DataFrame:
    return x.select("path", "module", F.col("module_kind").alias("kind"), "bytes", "lines", "parse_status", "syntax_error").orderBy("path")


def warnings(x: DataFrame) -> DataFrame:
    return x.where("warning is not null").select("path", "warning.code", "warning.message").orderBy("path", "code", "message")


def names(x: DataFrame, term: str) -> DataFrame:
    """Occurrences whose words hold all words of the term."""
    found = relation(x, "names").where(holds_all(identifier_words(F.col("name")), words_of(term)))
    return found.select(*PLACE, "name", "kind").orderBy(*PLACE, "kind")


def imports(x: DataFrame) -> DataFrame:
    return relation(x, "imports").select("path", "source_module", "target_module", "imported_names", "relative_level", "line", "unresolved").orderBy("path", "line", "target_module", "imported_names", "relative_level")


def import_graph(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the import graph: a tracked module (also when it lies below src), else the name marked as foreign."""
    tracked = x.select("module").distinct()
    alias = tracked.select(F.col("module").alias("target_module"), F.col("module").alias("known"))
    plain = tracked.where("module like 'src.%'").select(F.substring("module", 5, 1 << 20).alias("target_module"), F.col("module").alias("known"))
    # a module of its own name wins over one below src
    lookup = alias.unionByName(plain.join(alias.select("target_module"), "target_module", "left_anti"))
    found = relation(x, "imports").join(lookup, "target_module", "left")
    target = F.coalesce("known", F.concat(F.lit("module:"), F.col("target_module")))
    edges = found.select(F.col("source_module").alias("source"), target.alias("target"), F.lit(1.0).alias("weight"), F.lit("python.import").alias("provenance"))
    return tracked.select(F.col("module").alias("node")), edges


def complexity(x: DataFrame) -> DataFrame:
    return relation(x, "functions").orderBy(*PLACE, "qualified_name")


def occurrences(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Groups of equal keys with two rows or more, and the sorted places of each."""
    listed = F.sort_array(F.collect_list(F.struct(*fields)))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrence_count"), listed.alias("occurrences")).where("occurrence_count > 1").orderBy(*keys)


def literals(x: DataFrame) -> DataFrame:
    return occurrences(relation(x, "literals"), ["kind", "value"], PLACE)


def groups(x: DataFrame) -> DataFrame:
    return occurrences(relation(x, "groups"), ["kind", "members"], [*PLACE, "owner"])


def density(x: DataFrame) -> DataFrame:
    """Every parsed file with its sums; the ratio is null where nothing was counted."""
    sums = relation(x, "density").groupBy("path").agg(F.sum("primitive_count").alias("primitive_count"), F.sum("specialized_count").alias("specialized_count"))
    filled = x.where("parse_status = 'parsed'").select("path").join(sums, "path", "left").na.fill(0)
    return filled.withColumn("primitive_ratio", F.try_divide("primitive_count", F.col("primitive_count") + F.col("specialized_count"))).orderBy("path")


def duplicates(x: DataFrame) -> DataFrame:
    """Functions of equal shape. occurrences lists them; their pairs are duplicate_pairs'."""
    return occurrences(relation(x, "helpers"), ["fingerprint"], [*PLACE, "qualified_name", "kind", "end_line", "statement_count", "parameter_count", "call_count", "branch_count"])


def duplicate_pairs(x: DataFrame) -> DataFrame:
    order = Window.partitionBy("fingerprint").orderBy(*PLACE, "qualified_name")
    ranked = relation(x, "helpers").select("fingerprint", *PLACE, "qualified_name").withColumn("rn", F.row_number().over(order))
    left, right = (ranked.select("fingerprint", *(F.col(c).alias(f"{side}_{c}") for c in [*PLACE, "qualified_name", "rn"])) for side in ("left", "right"))
    return left.join(right, "fingerprint").where("left_rn < right_rn").drop("left_rn", "right_rn").orderBy("fingerprint", "left_path", "left_line", "right_path", "right_line")


def duplicates_compact(x: DataFrame) -> DataFrame:
    return duplicates(x).select(F.substring(F.sha2("fingerprint", 256), 1, 16).alias("digest"), "occurrence_count", "occurrences").orderBy("digest")


def declarations(x: DataFrame, term: str) -> DataFrame:
    return relation(x, "types").where(F.col("name") == term).drop("full_name").orderBy(*PLACE)


def discriminations(x: DataFrame, term: str) -> DataFrame:
    """Comparisons with and lookups by members of a type; of two members in one comparison the left one is told."""
    first = Window.partitionBy(*PLACE, "kind", "pair", "expression").orderBy("side")
    found = relation(x, "discriminations").where(F.col("owner") == term).withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return found.select(*PLACE, "kind", "operator", "member", "expression").orderBy(*PLACE, "kind")


def tests(x: DataFrame, symbols: list[str]) -> DataFrame:
    """Test functions that use a symbol, where they stand, and each use with how the symbol is bound there."""
    used = F.sort_array(F.collect_list(F.struct("line", "column", F.col("evidence").alias("kind"), "name", "expression"))).alias("evidence")
    found = relation(x, "tests").where(F.col("symbol").isin(symbols)).groupBy("symbol", "path", "test", "test_line", "test_column", "test_kind").agg(used)
    return found.select("symbol", "path", F.col("test_line").alias("line"), F.col("test_column").alias("column"), F.col("test").alias("qualified_name"), F.col("test_kind").alias("kind"), "evidence").orderBy("symbol", *PLACE, "kind")


def matching_imports(x: DataFrame, symbol: str) -> DataFrame:
    return relation(x, "symbol_imports").where(F.col("symbol") == symbol).withColumnRenamed("symbol", "imported_name").orderBy(*PLACE, "module", "relative_level", "local_name")


def neighborhood(x: DataFrame, term: str) -> DataFrame:
    """The seed and the names that share a word with it, exact first."""
    near = relation(x, "names").where(shares_any(identifier_words(F.col("name")), words_of(term)))
    kind = F.when(F.col("name") == term, "exact").otherwise("lexical").alias("pass")
    return near.groupBy("name").agg(F.count(F.lit(1)).alias("occurrences"), F.sort_array(F.collect_list(F.struct(*PLACE))).alias("locations")).select("name", kind, "occurrences", "locations").orderBy("pass", "name")


def neighborhood_edges(x: DataFrame, term: str) -> DataFrame:
    """From the seed to each of its neighborhood's names, weighed by how often the name occurs."""
    reason = F.when(F.col("pass") == "exact", "exact identifier match").otherwise("shared identifier word")
    return neighborhood(x, term).select(F.lit(term).alias("seed"), F.col("name").alias("neighbor"), F.col("occurrences").alias("weight"), F.col("pass").alias("discovery_pass"), reason.alias("reason")).orderBy("discovery_pass", "neighbor")


def structural(x: DataFrame, term: str) -> DataFrame:
    """name, reason, weight: shared file, repeated co-occurrence, siblings in the tree, shared scope, import target."""
    every = relation(x, "names")
    seed, others = every.where(F.col("name") == term), every.where(F.col("name") != term)
    per_file = others.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"))
    seeds = seed.groupBy("path").agg(F.count(F.lit(1)).alias("seeds"))
    beside = per_file.join(seeds, "path")
    shared = beside.groupBy("name").agg(F.count(F.lit(1)).alias("weight")).withColumn("reason", F.lit("shared file"))
    repeated = beside.where("n > 1 and seeds > 1").groupBy("name").agg(F.sum(F.least("n", "seeds")).alias("weight")).withColumn("reason", F.lit("repeated co-occurrence"))
    parents = seed.select("path", "parent_seq").distinct()
    adjacent = others.join(parents, ["path", "parent_seq"], "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("weight")).withColumn("reason", F.lit("AST adjacency"))
    inside = lambda side: side.select("path", "name", F.explode("scope_seqs").alias("scope")).distinct()
    scoped = inside(others).join(inside(seed).select("path", "scope"), ["path", "scope"], "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("weight")).withColumn("reason", F.lit("shared scope"))
    named = F.array_contains("imported_names", term) | F.array_contains("aliases", term)
    targets = relation(x, "imports").where(named).groupBy(F.col("target_module").alias("name")).agg(F.count(F.lit(1)).alias("weight")).withColumn("reason", F.lit("import target"))
    out = shared
    for more in (repeated, adjacent, scoped, targets):
        out = out.unionByName(more)
    return out.select("name", "reason", "weight").orderBy("name", "reason")


def behavioral(x: DataFrame, term: str) -> DataFrame:
    met = relation(x, "encounters").where((F.col("owner") == term) & (F.col("neighbor") != term))
    return met.groupBy("neighbor", "relationship").agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list(F.struct(*PLACE, "detail"))).alias("sites")).orderBy("neighbor", "relationship")


def operations(x: DataFrame, carrier: str) -> DataFrame:
    return relation(x, "operations").where(F.col("carrier") == carrier).orderBy(*PLACE, "kind", "field")


def operation_groups(x: DataFrame, carrier: str) -> DataFrame:
    return operations(x, carrier).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("count")).orderBy("field", "kind")


def operation_transitions(x: DataFrame, carrier: str) -> DataFrame:
    """Neighbours in a file's order of operations that are of one scope and field."""
    order = Window.partitionBy("path").orderBy("line", "column", "kind", "field")
    before = operations(x, carrier).select("*", *(F.lag(c).over(order).alias(f"from_{c}") for c in ("scope", "field", "kind", "line")))
    kept = before.where("scope = from_scope and field = from_field")
    return kept.select("path", "scope", "field", "from_kind", F.col("kind").alias("to_kind"), "from_line", F.col("line").alias("to_line")).orderBy("path", "to_line", "from_line")


def bindings(x: DataFrame, carrier: str, of: str) -> DataFrame:
    """Constructions, aliases or boundaries of a carrier."""
    return relation(x, "bindings").where((F.col("carrier") == carrier) & (F.col("relation") == of)).drop("relation").orderBy(*PLACE, "kind")


def guards(x: DataFrame, carrier: str) -> DataFrame:
    """If-guards with the relation that holds where their effects run: not and an early exit each turn it around."""
    turn = F.create_map(*(F.lit(v) for pair in FLIPPED.items() for v in pair))
    once = F.when(F.col("unary_not"), F.try_element_at(turn, F.col("operator"))).otherwise(F.col("operator"))
    found = relation(x, "guards").where(F.col("carrier") == carrier).withColumn("__once", once)
    twice = F.when(F.col("control_shape") == "early_exit", F.try_element_at(turn, F.col("__once"))).otherwise(F.col("__once"))
    return found.withColumn("effect_when", twice).drop("__once").orderBy(*PLACE, "control_shape", "expression")


def guard_groups(x: DataFrame, carrier: str) -> DataFrame:
    keys = ["carrier", "field", "value", "effect_when"]
    places = F.sort_array(F.collect_list(F.struct(*PLACE))).alias("occurrences")
    of = lambda role: F.sum(F.size(F.filter("effects", lambda e: e["role"] == role)))
    return guards(x, carrier).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.countDistinct("path").alias("path_count"), of("modification").alias("modifications"), of("access").alias("accesses"), places
    ).orderBy(*keys)


def external(x: DataFrame, name: str, carrier: str) -> DataFrame:
    """Rows of accesses or rules outside the carrier's class, on parameters of its name or type."""
    return relation(x, name).where(((F.col("carrier") == carrier) | (F.col("carrier_type") == carrier)) & ~F.array_contains("classes", carrier))


def field_affinities(x: DataFrame, carrier: str) -> DataFrame:
    """Field pairs that two functions or more outside the carrier's class use together, with reads, writes and deletions."""
    used = external(x, "accesses", carrier).select("function", "field", "role", *PLACE)
    fields = used.select("function", "field").distinct()
    pairs = fields.withColumnRenamed("field", "left_field").join(fields.withColumnRenamed("field", "right_field"), "function").where("left_field < right_field")
    both = pairs.join(used, "function").where("field = left_field or field = right_field")
    roles = [F.count_if(F.col("role") == role).alias(f"{role}s") for role in ("read", "write", "delete")]
    return both.groupBy("left_field", "right_field").agg(F.countDistinct("function").alias("functions"), F.count(F.lit(1)).alias("occurrences"), *roles).where("functions > 1").orderBy("left_field", "right_field")


def repeated_rules(x: DataFrame, carrier: str) -> DataFrame:
    """Equal rules on a carrier's field that occur twice or more."""
    return occurrences(external(x, "rules", carrier), ["kind", "field", "operator", "value"], [*PLACE, "function", "expression"])


def rule_tests(x: DataFrame, carrier: str) -> DataFrame:
    """What tests the functions that use the carrier's fields."""
    users = external(x, "accesses", carrier).select("function").unionAll(external(x, "rules", carrier).select("function"))
    last = users.select(F.substring_index("function", ".", -1).alias("symbol")).distinct()
    return relation(x, "tests").join(last, "symbol", "left_semi").orderBy("symbol", *PLACE)


def variables(x: DataFrame, terms: list[str]) -> DataFrame:
    return relation(x, "variables").where(F.col("name").isin(sorted(set(terms))))


def cluster(x: DataFrame, terms: list[str]) -> DataFrame:
    """Plain names and parameters of the terms, each with the guards it stands under."""
    return variables(x, terms).drop("returned").orderBy(*PLACE, "name", "role")


def held_by_all(rows: DataFrame, terms: list[str], keys: list[str]) -> DataFrame:
    """Keys under which every one of the names occurs."""
    return rows.groupBy(*keys).agg(F.countDistinct("name").alias("__k"), F.count(F.lit(1)).alias("occurrences")).where(F.col("__k") == len(set(terms))).drop("__k")


def shared_scopes(x: DataFrame, terms: list[str]) -> DataFrame:
    """Scopes in which every one of the names occurs; a module's own has the empty name."""
    return held_by_all(variables(x, terms), terms, ["path", "scope"]).orderBy("path", "scope")


def shared_guards(x: DataFrame, terms: list[str]) -> DataFrame:
    """Guards of the stacks under which every one of the names occurs in one scope."""
    stacks = held_by_all(variables(x, terms).where("size(guards) > 0"), terms, ["path", "scope", "guards"])
    return stacks.select("path", F.explode("guards").alias("g")).select("path", "g.*").distinct().orderBy(*PLACE, "kind", "expression", "branch")


def cluster_constructions(x: DataFrame, terms: list[str]) -> DataFrame:
    return relation(x, "constructions").where(F.col("name").isin(sorted(set(terms)))).orderBy(*PLACE, "name", "kind")


def cluster_aliases(x: DataFrame, terms: list[str]) -> DataFrame:
    """Single assignments of a plain name to another, once for each of the names in it."""
    found = relation(x, "bindings").where(F.col("carrier").isin(sorted(set(terms))) & (F.col("relation") == "alias"))
    ways = [F.when((F.col("kind") == "source") == here, F.col("carrier")).otherwise(F.col("other")).alias(name) for here, name in ((True, "source"), (False, "target"))]
    return found.select(F.col("carrier").alias("name"), *PLACE, "scope", *ways, F.lit("assignment").alias("kind")).orderBy(*PLACE, "source", "target", "name")


def cluster_boundaries(x: DataFrame, terms: list[str]) -> DataFrame:
    """Parameters, and names that are returned as they are."""
    kind = F.when(F.col("returned"), "return").otherwise("parameter")
    return variables(x, terms).where("returned or role = 'parameter'").select("name", *PLACE, "scope", kind.alias("kind"), F.col("name").alias("detail")).orderBy(*PLACE, "kind")


def structural_complexity(x: DataFrame, measure: str) -> DataFrame:
    """One measure of every function: its count, or why there is none."""
    return relation(x, "measures").where(F.col("measure") == measure).drop("measure").orderBy(*PLACE, "qualified_name")


def profiles(x: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """targets(at, path, qualified_name) in their order: metrics and the first sites of each kind of the one function that
    a target names; match_status tells when there is none, more than one, or when its file cannot be parsed."""
    key = ["path", "qualified_name"]
    rank = Window.partitionBy("at", "kind").orderBy("line", "column", "text")
    near = relation(x, "sites").join(F.broadcast(targets.select("at", *key)), key).withColumn("__n", F.row_number().over(rank))
    fields = ("line", "column", "text", "end_line", "end_column", "generator_count", "filter_count", "conditional_result", "nested_comprehension")
    listed = F.sort_array(F.collect_list(F.when(F.col("__n") <= most, F.struct(*fields)))).alias("sites")
    of_kind = near.groupBy("at", "kind").agg(F.count(F.lit(1)).alias("site_count"), listed).withColumn("truncated", F.col("site_count") > most)
    sites = of_kind.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("kind", "site_count", "truncated", "sites"))).alias("sites"))
    counts = relation(x, "measures").groupBy(*key, "line", "column").agg(F.sort_array(F.collect_list(F.struct("measure", "count", "diagnostic"))).alias("measures"))
    typed = relation(x, "density").select("path", F.col("name").alias("qualified_name"), "line", "column", "primitive_count", "specialized_count")
    own = relation(x, "functions").join(counts, [*key, "line", "column"], "left").join(typed, [*key, "line", "column"], "left").na.fill(0, ["primitive_count", "specialized_count"])
    total = F.col("primitive_count") + F.col("specialized_count")
    own = own.withColumn("total_count", total).withColumn("primitive_ratio", F.try_divide("primitive_count", total))
    wanted = targets.join(own, key, "left")
    wanted = wanted.withColumn("matches", F.count("line").over(Window.partitionBy("at"))).dropDuplicates(["at"])
    wanted = wanted.join(x.select("path", F.col("parse_status").alias("file_status")), "path", "left").join(sites, "at", "left")
    status = F.when(F.col("file_status").isin("syntax_error", "unreadable"), "unavailable").when(F.col("matches") == 0, "not_found").when(F.col("matches") > 1, "ambiguous").otherwise("found")
    kept = [c for c in wanted.columns if c not in ("at", "matches", "file_status", *key)]
    told = wanted.withColumn("match_status", status)
    return told.select("at", *key, "match_status", *(F.when(F.col("match_status") == "found", F.col(c)).alias(c) for c in kept)).orderBy("at")


def class_methods(x: DataFrame, path: str, qualified_name: str, limit: int) -> DataFrame:
    """The first methods that stand directly in a class, with the number of all."""
    own = relation(x, "functions").where((F.col("path") == path) & (F.col("kind") == "method"))
    direct = own.where(F.regexp_replace("qualified_name", r"\.[^.]*$", "") == qualified_name)
    return direct.withColumn("method_count", F.count(F.lit(1)).over(Window.partitionBy("path"))).orderBy(*PLACE).limit(limit)


def classes(x: DataFrame, path: str, qualified_name: str) -> DataFrame:
    """A file's classes of a dotted name, with the annotations of their fields."""
    counts = relation(x, "density").select("path", "line", "column", "primitive_count", "specialized_count")
    named = relation(x, "types").where((F.col("path") == path) & (F.col("full_name") == qualified_name)).select(*PLACE, F.col("full_name").alias("qualified_name"), "end_line")
    told = named.join(counts, PLACE, "left").na.fill(0, ["primitive_count", "specialized_count"])
    total = F.col("primitive_count") + F.col("specialized_count")
    return told.withColumn("total_count", total).withColumn("primitive_ratio", F.try_divide("primitive_count", total)).orderBy(*PLACE)


def receiver_accesses(x: DataFrame, methods: DataFrame, most: int) -> DataFrame:
    """The first sites at which each method uses its class's fields through its receiver, with the number of all."""
    key = ["path", "qualified_name", "method_line"]
    rank = Window.partitionBy(*key).orderBy("line", "column", "field", "operations")
    found = relation(x, "receiver_fields").withColumn("__n", F.row_number().over(rank))
    sites = F.sort_array(F.collect_list(F.when(F.col("__n") <= most, F.struct("line", "column", "field", "operations"))))
    told = found.groupBy(*key).agg(F.count(F.lit(1)).alias("site_count"), sites.alias("sites"))
    own = methods.select("path", "qualified_name", F.col("line").alias("method_line")).join(told, key, "left").na.fill(0, ["site_count"])
    filled = F.coalesce("sites", F.array().cast(told.schema["sites"].dataType))
    return own.withColumn("sites", filled).withColumn("truncated", F.col("site_count") > most).orderBy("method_line")
