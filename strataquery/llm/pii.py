"""Personal data in texts, in DataFrame functions only.

Method: bootstrapped contextual extraction. Spans that the base patterns find are seeds; the words around them are
lexical patterns; a graph of patterns and instances is scored in rounds (a pattern by the share of its instances that
are trusted, an instance by its best pattern), and patterns of high confidence find identifiers that the base misses.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that no part is tried twice: a run is entered at its begin or right after a match only,
#: and what can't be given back is possessive. They match what the plain forms match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CARD_DIGITS, PHONE_DIGITS = (16, 19), (8, 15)
#: Candidates: runs without blanks that hold a digit, @ or an at in brackets. Blanks are space and \t-\r.
CANDIDATE = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*(?:[0-9@]|[(\[](?:at|AT)[)\]]))[^\x20\x09-\x0D]++"
#: The last two words of what stands before a span.
TWO_WORDS = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$"
EDGES = r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$"
#: What an instance of each kind must look like where only its context speaks for it.
SHAPES = {"email": r"^[^@]+(?:@|[(\[](?:at|AT)[)\]])[^@]+$", "ip": r"^[0-9]{1,3}([.,:][0-9]{1,3}){3}$", "card": r"^[0-9][0-9-]{12,22}$", "phone": r"^[+(]?[0-9][0-9().-]{6,18}$"}
#: A pattern needs so many different seeds in as many texts, and this share of trusted instances; rounds of scoring.
SUPPORT, CONFIDENCE, ROUNDS = 10, 0.9, 3
_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"
_CHUNK = 512


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What join makes of 0 and all entries before each, of an array that is not empty; join is a sum or the like. In two
    levels, so that very long arrays stay cheap."""
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<long>")
    folded = lambda part: F.aggregate(part, F.struct(zero.alias("at"), none.alias("all")), lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")), lambda c: folded(F.slice(values, c * _CHUNK + 1, _CHUNK)))
    empty = F.array().cast("array<array<long>>")
    whole = F.aggregate(
        parts, F.struct(zero.alias("at"), empty.alias("all")),
        lambda s, p: F.struct(join(s["at"], p["at"]).alias("at"), F.concat(s["all"], F.array(F.transform(p["all"], lambda x: join(s["at"], x)))).alias("all")),
    )
    return F.flatten(whole["all"])


def _clear(candidates: str, spans: list[str]) -> Column:
    """The candidates that no span overlaps. Candidates lie apart, ascending; both are sorted together once and each looks
    at the farthest end before it and at its next neighbour."""
    ends = [F.transform(F.col(c), lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s["end"].alias("end"))) for c in spans]
    mine = F.transform(F.col(candidates), lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("own"), c["end"].alias("end")))
    every = F.array_sort(F.concat(*ends, mine))
    reach = _before(F.transform(every, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(F.lit(0).cast("long"))), F.greatest)
    after = F.slice(F.concat(every, F.slice(every, 1, 1)), F.lit(2), F.size(every))  # the last one's is not looked at: it begins before
    near = F.zip_with(F.zip_with(every, reach, lambda x, r: F.struct(x.alias("x"), r.alias("reach"))), after, lambda x, a: F.struct(x["x"]["own"].alias("own"), ((x["reach"] > x["x"]["start"]) | ((a["own"] == 0) & (a["start"] >= x["x"]["start"]) & (a["start"] < x["x"]["end"]))).alias("met")))
    met = F.filter(near, lambda x: x["own"] == 1)
    kept = F.filter(F.zip_with(F.col(candidates), met, lambda c, m: F.struct(c.alias("c"), m["met"].alias("met"))), lambda x: ~x["met"])
    return F.when(F.size(candidates) == 0, F.col(candidates)).otherwise(F.transform(kept, lambda x: x["c"]))


def _marked(text: Column, pattern: str, needs: str = "") -> Column:
    """The text cut before each match; each later piece is a match, a mark and what follows."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN, -1)
    return F.when(F.instr(text, needs) > 0, pieces).otherwise(F.array(text)) if needs else pieces


def _spans(pieces: Column, starts: Column) -> Column:
    """Structs of start, end, match, and the text on either side up to the next match."""

    def one(i: Column) -> Column:
        piece, before = F.get(pieces, i), F.get(pieces, i - 1)
        size = F.instr(piece, _CLOSE) - 1
        start = F.get(starts, i)
        return F.struct(
            start.alias("start"), (start + size).alias("end"), F.substring(piece, F.lit(1), size).alias("match"),
            F.substring_index(before, _CLOSE, -1).alias("left"), F.substring_index(piece, _CLOSE, -1).alias("right"),
        )

    return F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), one)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,match:string,left:string,right:string>>"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    """What a match must satisfy besides its pattern."""
    if kind == "ip":
        return match.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(match) < CARD_DIGITS[0], False).when(F.length(digits).between(*CARD_DIGITS), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(*PHONE_DIGITS)
    return F.lit(True)


def _sound(kind: str, span: Column) -> Column:
    return _holds(kind, span["match"])


def _place(kind: str | None, span: Column) -> Column:
    """A seed, or with kind None a candidate, with its value and the lexical patterns it is in."""
    return F.struct(
        F.lit(kind).cast("string").alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.lower(span["match"]).alias("value"),
        _contexts(span["left"], span["right"]).alias("patterns"),
    )


def _contexts(left: Column, right: Column) -> Column:
    """The lexical patterns of a place: the two words before it, and the words on both sides."""
    before = F.lower(F.regexp_extract(left, TWO_WORDS, 0))
    words = F.split(F.trim(F.regexp_replace(before, r"[\x20\x09-\x0D]+", " ")), " ")
    after = F.lower(F.regexp_extract(right, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1))
    two = F.when(F.size(words) == 2, F.concat(F.lit("< "), F.array_join(words, " ")))
    around = F.when((F.size(words) == 2) & (after != ""), F.concat(F.lit("<> "), F.get(words, F.lit(1)), F.lit(" "), after))
    return F.filter(F.array(two, around), lambda x: x.isNotNull() & ~x.rlike("[0-9@]"))


def base_spans(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with __text (no null, its own marks replaced by a character no pattern knows) and, for each kind,
    __email and so on: the spans of the base patterns, leftmost and not overlapping, with what is around them."""
    out = documents.withColumn("__text", F.translate(F.coalesce(F.col(text_col), F.lit("")), _OPEN + _CLOSE, _OTHER + _OTHER))
    sources = dict(PATTERNS) | {"candidate": CANDIDATE}
    out = out.withColumns({f"__{k}_pieces": _marked(F.col("__text"), p, NEEDS.get(k, "")) for k, p in sources.items()})
    starts = {}
    for k in sources:
        sizes = F.transform(F.col(f"__{k}_pieces"), lambda piece, i: (F.length(piece) - F.when(i > 0, 1).otherwise(0)).cast("long"))
        starts[f"__{k}_starts"] = _before(sizes, lambda a, b: a + b)
    out = out.withColumns(starts)
    out = out.withColumns({f"__{k}": _spans(F.col(f"__{k}_pieces"), F.col(f"__{k}_starts")) for k in sources})
    # Entry i of the running sums is the size of all pieces before piece i, which is where its match begins.
    kept = {f"__{k}": F.filter(F.col(f"__{k}"), partial(_sound, k)) for k in KINDS}
    out = out.withColumns(kept).drop(*(f"__{k}_{x}" for k in sources for x in ("pieces", "starts")))
    return out.withColumn("__candidate", _clear("__candidate", [f"__{k}" for k in KINDS]))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _kind_struct(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("place"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _score(instances: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that may find new instances.

    instances: (pattern, value, kind, text_key), kind null where the base knows nothing of the value.
    """
    edges = instances.groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    known = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    texts = instances.where("kind is not null").select("pattern", "kind", "text_key").distinct().groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("texts"))
    live = known.where(F.col("seeds") >= SUPPORT).join(texts.where(F.col("texts") >= SUPPORT), ["pattern", "kind"])
    live = materialize(live.select("pattern", F.col("kind").alias("of"), "seeds"), "patterns")
    graph = materialize(edges.join(live, "pattern").withColumn("trust", F.when(F.col("kind") == F.col("of"), 1.0).otherwise(0.0)), "graph")
    for turn in range(ROUNDS):
        patterns = graph.groupBy("pattern", "of").agg((F.sum("trust") / F.count(F.lit(1))).alias("confidence"))
        if turn + 1 == ROUNDS:
            break
        best = graph.where("kind is null").join(patterns, ["pattern", "of"]).groupBy("value", "of").agg(F.max("confidence").alias("best"))
        best = best.withColumn("best", F.when(F.col("best") >= CONFIDENCE, F.col("best")).otherwise(0.0))
        graph = materialize(
            graph.join(best, ["value", "of"], "left").withColumn("trust", F.when(F.col("kind").isNull(), F.coalesce("best", F.lit(0.0))).otherwise(F.col("trust"))).drop("best"), "graph"
        )
    return patterns.where(F.col("confidence") >= CONFIDENCE).select("pattern", F.col("of").alias("kind"), "confidence")


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, base, added, spans) of every row: arrays of (place, start, end, kind), in code points, end exclusive.

    base holds the base patterns' spans by kind and start, added those the contexts find, spans both in that order. A null
    text is empty and has no spans. Repeated rows stay and have equal spans; a null id has its row; an empty table gives
    an empty result. Texts are searched whole.
    """
    found = base_spans(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    own = F.concat(*(_kind_struct(k, F.col(f"__{k}")) for k in KINDS))
    seeds = F.concat(*(F.transform(f"__{k}", partial(_place, k)) for k in KINDS))
    others = F.transform("__candidate", partial(_place, None))
    table_ = materialize(found.select("id", F.xxhash64("text").alias("text_key"), own.alias("base"), F.concat(seeds, others).alias("places")), "places")
    flat = table_.select("id", "text_key", F.explode("places").alias("p")).select("id", "text_key", "p.*")
    flat = flat.withColumn("pattern", F.explode("patterns")).drop("patterns")
    patterns = _score(flat.select("pattern", "value", "kind", "text_key"))
    fits = reduce(lambda a, k: a | ((F.col("of") == k) & F.col("bare").rlike(SHAPES[k])), KINDS, F.lit(False))
    hits = flat.where("kind is null").join(patterns.withColumnRenamed("kind", "of"), "pattern").withColumn("bare", F.regexp_replace("value", EDGES, "")).where(fits)
    hits = hits.groupBy("id", "text_key", "start", "end", "value", "bare").agg(F.max(F.struct("confidence", "of")).alias("best"))
    start = F.col("start") + F.instr("value", F.col("bare")) - 1
    kind = F.col("best.of")
    place = reduce(lambda a, k: F.when(kind == k, KINDS.index(k)).otherwise(a), KINDS, F.lit(0))
    added = hits.select("id", "text_key", F.struct(place.alias("place"), start.alias("start"), (start + F.length("bare")).alias("end"), kind.alias("kind")).alias("span"))
    added = materialize(added, "added")
    none = F.array().cast("array<struct<place:int,start:bigint,end:bigint,kind:string>>")
    if added.isEmpty():
        return table_.select("id", "text_key", "base", none.alias("added"), F.col("base").alias("spans"))
    lists = added.groupBy(F.coalesce("id", F.lit(0)).alias("__id"), F.col("id").isNull().alias("__null"), F.col("text_key").alias("__key")).agg(F.array_sort(F.collect_set("span")).alias("added"))
    same = (F.coalesce("id", F.lit(0)) == F.col("__id")) & (F.col("id").isNull() == F.col("__null")) & (F.col("text_key") == F.col("__key"))
    joined = table_.join(lists, same, "left").withColumn("added", F.coalesce("added", none))
    return joined.select("id", "text_key", "base", "added", F.array_sort(F.concat("base", "added")).alias("spans"))


def mask_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with every span of its texts replaced by its kind in brackets, such as [EMAIL]; a null text stays null.

    Where spans overlap, the one that begins first names the whole.
    """
    spans = find_pii(documents, id_col, text_col).where(F.size("spans") > 0)
    spans = spans.groupBy(F.coalesce("id", F.lit(0)).alias("__id"), F.col("text_key").alias("__key")).agg(F.first("spans").alias("__spans"))
    keyed = documents.withColumn("__row_id", F.coalesce(F.col(id_col).cast("long"), F.lit(0))).withColumn("__row_key", F.xxhash64(F.col(text_col)))
    joined = keyed.join(spans, (F.col("__row_id") == F.col("__id")) & (F.col("__row_key") == F.col("__key")), "left")
    text, found = F.col(text_col), F.col("__spans").isNotNull()
    ordered = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # A span that begins before the farthest end so far lies in a place that is masked already.
    joined = joined.withColumn("__ordered", F.when(found, ordered)).withColumn("__points", F.when(found, F.encode(text, "UTF-32")))
    reach = _before(F.transform("__ordered", lambda s: s["end"]), F.greatest)
    heads = F.filter(F.zip_with("__ordered", reach, lambda s, r: F.struct(s.alias("s"), r.alias("reach"))), lambda x: x["s"]["start"] >= x["reach"])

    def piece(begin: Column, end: Column) -> Column:
        """The characters from begin to before end, at fixed width, so that no piece is looked for from the text's begin. The
        mark before them is what a decoder takes away."""
        raw = F.substring(F.col("__points"), (begin * 4 + 1).cast("int"), ((end - begin) * 4).cast("int"))
        return F.decode(F.concat(F.unhex(F.lit("0000FEFF")), raw), "UTF-32")

    parts = F.transform(heads, lambda x: F.concat(piece(x["reach"], x["s"]["start"]), F.lit("["), F.upper(x["s"]["kind"]), F.lit("]")))
    rest = piece(F.array_max(F.transform("__ordered", lambda s: s["end"])), F.octet_length("__points") / 4)
    masked = F.when(found, F.concat(F.array_join(parts, ""), rest)).otherwise(text)
    return joined.withColumn(text_col, masked).select(*documents.columns)


def _is_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", partial(_is_kind, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
