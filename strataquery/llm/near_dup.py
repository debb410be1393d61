"""Near-duplicate detection by Order MinHash.

Method: a text's k-mers are its runs of five words, each labelled with how often it came before. Each of several sketches
takes the few k-mers with the smallest hashes and keeps their order in the text, so that texts share a sketch when they
are alike as sequences, not as sets. Short texts, whose sketches hold most of what they have, are also found by single
k-mers: of two alike texts, the rarest k-mers of each always have one in common. Texts that share a sketch or such a k-mer
are candidates; an alignment within the band that the threshold allows decides. Linked texts form classes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import drop_folder, materialize, table, tidy
from .textvec import byte_view, chunks, find, finish, words_of

#: Words of a k-mer, and the least similarity: shingles aligned in order, over all shingles of either text.
SHINGLE, SIMILARITY = 5, 0.8
#: Sketches, and k-mers of each. Texts that share I of U k-mers, in one order, share no sketch with probability
#: (1 - C(I, 5) / C(U, 5))**24.
SKETCHES, PER_SKETCH = 24, 5
#: No pair is lost in which a text has at most SHORT shingles; texts of REACH shingles can be alike to such a one.
SHORT = 30
REACH = int(SHORT / SIMILARITY + 1e-9)
#: Most common k-mers of short texts that are put last among a text's k-mers, so that few texts meet in one of them. Which
#: they are changes no result.
COMMON = 1 << 16
#: Rounds in which each bucket compares its members with one of them; texts of a side of a tile, and shingles of one, when
#: that doesn't settle it.
ROUNDS, TILE, TILE_SHINGLES = 3, 256, 1 << 20
#: Places from which on a shingle's places are kept as the bits of one integer.
MANY = 64
_SEEDS = np.random.default_rng(9).integers(1, 2**63, SKETCHES).astype(np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of SHINGLE words of all texts in order, and where each text's begin (one more: the end).

    A-Z count as a-z. A text of fewer words has one shingle of all its words; one without words has none.
    """
    raw, offsets = byte_view(texts)
    words = words_of(raw, offsets)
    n, sizes = len(offsets) - 1, np.diff(words.edges)
    h = words.hashes
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, (sizes > 0).astype(np.int64))
    starts = np.repeat(words.edges[:-1], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    take = np.repeat(np.minimum(sizes, SHINGLE), counts)
    out = np.zeros(len(starts), np.uint64)
    for j in range(SHINGLE):
        here = j < take
        out[here] = out[here] * _STEP + h[starts[here] + j]
    return finish(out, take), np.concatenate([[0], np.cumsum(counts)])


def labelled(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each k-mer's hash with how many equal ones stand before it in its text."""
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    nth = np.empty(len(h), np.int64)
    nth[order] = np.arange(len(h)) - np.repeat(first, np.diff(first, append=len(h)))
    return finish(hashes + nth.astype(np.uint64) * _STEP, nth)


def sketches(kmers: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of one text, each of the PER_SKETCH k-mers with the smallest hashes in the order of the text."""
    n = len(kmers)
    out = np.zeros(SKETCHES, np.uint64)
    step = max(1, min(SKETCHES, 2_000_000 // max(n, 1)))
    for at in range(0, SKETCHES, step):
        rows = kmers[None, :] ^ _SEEDS[at : at + step, None]
        rows = (rows ^ (rows >> np.uint64(31))) * _STEP
        rows ^= rows >> np.uint64(29)
        if n > PER_SKETCH:
            places = np.sort(np.argpartition(rows, PER_SKETCH - 1, axis=1)[:, :PER_SKETCH], axis=1)
        else:
            places = np.broadcast_to(np.arange(n), rows.shape)
        total = np.zeros(len(rows), np.uint64)
        for j in range(places.shape[1]):
            total = (total + kmers[places[:, j]]) * _STEP
            total ^= total >> np.uint64(32)
        out[at : at + step] = total
    return out


def rarest(kmers: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The k-mers that come first by (count, hash), so many that two texts of SIMILARITY or more have one in common.

    Such a text shares at least SIMILARITY of its own k-mers, which are all different; all but these, and one more, come
    first. common is sorted; k-mers it lacks count as 0.
    """
    at = find(common, kmers)
    often = np.where(at >= 0, counts[at], 0) if len(common) else np.zeros(len(kmers), np.int64)
    n = len(kmers)
    return kmers[np.lexsort((kmers, often))[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1]] if n else kmers


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether an alignment of the two shingle sequences matches at least similarity of all their shingles.

    The share is matches / (len(a) + len(b) - matches). Only places within the band that the share allows are compared;
    the band's row is one integer whose bits are the steps of the longest common subsequence.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < similarity * max(n, m):
        return False
    need = int(np.ceil((n + m) * similarity / (1 + similarity) - 1e-9))
    width = n + m - 2 * need
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    a, b, done = a[head:], b[head:], head
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:k] != b[::-1][:k])
    tail = int(differ[0]) if len(differ) else k
    a, b, done = a[: len(a) - tail], b[: len(b) - tail], done + tail
    if done >= need:
        return True
    if not len(a) or not len(b):
        return False
    common, x, y = np.intersect1d(a, b, return_indices=False), a, b
    if len(common) < len(np.unique(a)) or len(common) < len(np.unique(b)):
        x, y = a[np.isin(a, common)], b[np.isin(b, common)]
        if done + min(len(x), len(y)) < need:
            return False
    places: dict[int, list[int]] = defaultdict(list)
    for i, h in enumerate(a.tolist()):
        places[h].append(i)
    # Where a shingle stands often, its places are one integer too, so that repeated text costs no more than other text.
    masks = {h: sum_of_bits(at, len(a)) for h, at in places.items() if len(at) > MANY}
    size, low, steps, lost = 2 * width + 1, -width, (1 << (2 * width + 1)) - 1, 0
    full, n = steps, len(a)
    for j, h in enumerate(b.tolist()):
        low = j - width
        if h in masks:
            hits = (masks[h] >> low if low >= 0 else masks[h] << -low) & full
        else:
            hits = 0
            for i in places.get(h, ()):
                if low <= i < low + size:
                    hits |= 1 << (i - low)
        if hits:
            u = steps & hits
            steps = ((steps + u) | (steps - u)) & full
        if not steps & 1:
            lost += 1
        steps = (steps >> 1) | (1 << (size - 1))
    return done + lost + (size - steps.bit_count()) >= need


def sum_of_bits(places: list[int], n: int) -> int:
    """The integer whose bits at places are set, of n bits."""
    flags = np.zeros(n, np.uint8)
    flags[places] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def sketch_table(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tid, n, bands, kmers) of every row: tid stands for the whole text, n counts its shingles, bands are its
    sketches, kmers all k-mers of a text of at most REACH shingles (else none)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ready = documents.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("tid"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2):
                h, edges = shingles(part.column(2))
                kmers = labelled(h, edges)
                spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                bands = _lists([sketches(kmers[x:y]) if y > x else kmers[:0] for x, y in spans])
                short = _lists([kmers[x:y] if y - x <= REACH else kmers[:0] for x, y in spans])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(edges)), bands, short], names=["id", "tid", "n", "bands", "kmers"])

    return ready.mapInArrow(tidy(run), "id long, tid binary, n long, bands array<long>, kmers array<long>")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def with_rarest(texts: DataFrame) -> DataFrame:
    """texts (tid, rep, n, bands) with the rarest k-mers of short texts behind the sketches in bands."""
    often = texts.select(F.explode("kmers").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    most = often.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    common, counts = most["h"].to_numpy().view(np.uint64), most["n"].to_numpy()
    order = np.argsort(common)
    common, counts = common[order], counts[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, kmers = (_parts(batch.column(k)) for k in ("bands", "kmers"))
            both = _lists([np.concatenate([x, rarest(y, common, counts)]) if len(y) else x for x, y in zip(bands, kmers, strict=True)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("tid", "rep", "n")), both], names=["tid", "rep", "n", "bands"])

    return texts.select("tid", "rep", "n", "bands", "kmers").mapInArrow(tidy(run), "tid binary, rep long, n long, bands array<long>")


def _parts(lists: pa.ListArray) -> list[np.ndarray]:
    values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return np.split(values, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(lists) else []


def _compatible(n: str, m: str):
    return F.least(n, m) >= F.greatest(n, m) * F.lit(SIMILARITY)


def _verify(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are aligned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2):
                x, x_edges = shingles(part.column(2))
                y, y_edges = shingles(part.column(3))
                good = [aligned(x[x_edges[i] : x_edges[i + 1]], y[y_edges[i] : y_edges[i + 1]]) for i in range(part.num_rows)]
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = bodies.select(F.col("tid").alias("a"), F.col("text").alias("text_a"))
    second = bodies.select(F.col("tid").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a binary, b binary")


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between texts of one tile of a bucket that no link connects yet: shared shingles bound what is aligned.

    A pair is looked at in the first sketch or k-mer its texts share only.
    """
    band, own_hash, left, right = (k.as_py() for k in key)
    rows = rows.sort_by("tid")
    tids, label = rows["tid"].to_pylist(), rows["label"].to_pylist()
    block = rows["block"].to_numpy()
    bands = [{(min(k, SKETCHES), h) for k, h in enumerate(b)} for b in rows["bands"].to_pylist()]
    h, edges = shingles(rows["text"].combine_chunks())
    kmers, sizes, n = labelled(h, edges), np.diff(edges), len(tids)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(kmers, kind="stable")
    values, owners = kmers[order], owner[order]
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    links = []
    for i in range(n):
        own = kmers[edges[i] : edges[i + 1]]
        lo, hi = np.searchsorted(values, own), np.searchsorted(values, own, side="right")
        spans = hi - lo
        at = np.repeat(lo - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))
        shared = np.bincount(owners[at], minlength=n)
        share = shared / (sizes + sizes[i] - shared)
        ok = (share >= SIMILARITY) & (np.arange(n) > i)
        if left != right:
            ok &= block != block[i]
        for j in sorted(np.flatnonzero(ok).tolist(), key=lambda j: -share[j]):
            p, q = root(label[i]), root(label[j])
            if p != q and min(bands[i] & bands[j]) == (band, own_hash) and aligned(h[edges[i] : edges[i + 1]], h[edges[j] : edges[j + 1]]):
                parent[p] = q
                links.append((tids[i], tids[j]))
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tid, class_id, label) of every row: tid stands for its text, class_id is the smallest id of its class.

    label, the smallest tid of the class, tells classes apart: unrelated classes can have one class_id where ids repeat or
    are null.

    Equal texts are one class member each (a null text counts as empty, all empty texts are equal), and texts linked by an
    alignment of SIMILARITY or more are in one class, directly or over others. Texts under SHINGLE words are alike only if
    they hold the same words. Repeated rows stay; null ids get a class but never name one unless all its ids are null.
    An empty table gives an empty result.

    A bucket, the texts that share a sketch or a rare k-mer, never meets in one task: in ROUNDS rounds its members are compared with one
    of them, the one whose sketches are the most common; members that still are in different classes are then compared
    tile by tile. Pairs that a class connects already need no comparison.
    """
    rows = materialize(sketch_table(documents, id_col, text_col), "sketches")
    texts = rows.groupBy("tid").agg(F.min("id").alias("rep"), *(F.first(k).alias(k) for k in ("n", "bands", "kmers")))
    plain = materialize(texts, "texts")
    texts = materialize(with_rarest(plain), "texts")
    drop_folder(plain)
    entries = texts.select("tid", "n", F.posexplode("bands").alias("band", "h")).withColumn("band", F.least("band", F.lit(SKETCHES)))
    sizes = entries.groupBy("band", "h").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = entries.join(sizes, ["band", "h"])
    shared = materialize(shared, "shared")
    central = shared.groupBy("tid").agg(F.sum("size").alias("central"))
    members = materialize(shared.join(central, "tid"), "members")
    done = [shared, members]
    wanted = members.select("tid").distinct().join(texts.select("tid", "rep"), "tid").withColumn("rep", F.coalesce("rep", F.lit(0)))
    whole = documents.select(F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("rep"))
    whole = whole.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tid", F.unhex(F.md5(F.col("text").cast("binary"))))
    bodies = materialize(whole.join(wanted, ["tid", "rep"], "left_semi").select("tid", "text"), "bodies")
    done.append(bodies)
    if bodies.count() != wanted.count():  # rows that repeat id and text
        bodies = materialize(bodies.groupBy("tid").agg(F.first("text").alias("text")), "bodies")
        done.append(bodies)

    labels = links = tested = used = None
    for turn in range(ROUNDS + 1):
        now = members if labels is None else members.join(labels.withColumnRenamed("node", "tid"), "tid", "left")
        now = now.withColumn("label", F.col("tid") if labels is None else F.coalesce("label", "tid"))
        if used is not None:
            now = now.join(used.withColumnRenamed("hub", "tid"), ["band", "h", "tid"], "left_anti")
        hub = F.max(F.struct("central", "tid", "label", "n")).alias("hub")
        still = now.groupBy("band", "h").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("left"), F.sum("n").alias("shingles"), hub).where("low <> high")
        still = materialize(still, "still")
        done.append(still)
        if still.isEmpty():
            break
        if turn == ROUNDS:
            found = _settle(now, still, texts, bodies)
        else:
            against = now.select("band", "h", "tid", "label", "n").join(still.select("band", "h", "hub"), ["band", "h"])
            against = against.where((F.col("label") != F.col("hub.label")) & _compatible("n", "hub.n"))
            pairs = against.select(F.least("tid", "hub.tid").alias("a"), F.greatest("tid", "hub.tid").alias("b")).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = materialize(pairs, "pairs")
            done.append(pairs)
            tested = pairs if tested is None else tested.unionByName(pairs)
            found = _verify(pairs, bodies)
            hubs = still.select("band", "h", F.col("hub.tid").alias("hub"))
            used = hubs if used is None else used.unionByName(hubs)
        found = materialize(found, "links")
        done.append(found)
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            labels = materialize(components(links), "labels")
    for table_ in done:  # what follows reads rows, texts and labels alone
        drop_folder(table_)
    if labels is None:
        classes = texts.select("tid", F.col("rep").alias("class_id"), F.col("tid").alias("label"))
    else:
        named = texts.select("tid", "rep").join(labels.withColumnRenamed("node", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
        least = named.groupBy("label").agg(F.min("rep").alias("class_id"))
        classes = named.join(least, "label").select("tid", "class_id", "label")
    return rows.select(F.col("id").alias(id_col), "tid").join(classes, "tid").select(id_col, "tid", "class_id", "label")


def _settle(now: DataFrame, still: DataFrame, texts: DataFrame, bodies: DataFrame) -> DataFrame:
    """Compare all members of different classes of the buckets that are left, in tiles of about TILE texts a side, or of
    fewer where these hold more than TILE_SHINGLES shingles.

    The class that most of a bucket's members are in meets only the members that are not in it, so a bucket of one large
    class and few others costs its size, not the square of it.
    """
    rows = now.select("band", "h", "tid", "label").join(still.select("band", "h", "left", "shingles"), ["band", "h"])
    top = rows.groupBy("band", "h", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("band", "h").agg(F.max(F.struct("size", "label")).alias("top"))
    rows = rows.join(top, ["band", "h"]).withColumn("rest", F.col("left") - F.col("top.size"))
    of = lambda number: F.greatest(F.ceil(number / TILE), F.least(F.ceil(number * F.col("shingles") / F.col("left") / TILE_SHINGLES), number))
    rows = rows.withColumn("rests", of(F.col("rest"))).withColumn("tops", of(F.col("top.size")))
    hashed, in_top = F.xxhash64("tid"), F.col("label") == F.col("top.label")
    rows = rows.withColumn("block", F.when(in_top, F.col("rests") + F.pmod(hashed, "tops")).otherwise(F.pmod(hashed, "rests")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(in_top, F.col("rests")).otherwise(F.col("rests") + F.col("tops")) - 1)))
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    rows = rows.join(texts.select("tid", "bands"), "tid").join(bodies, "tid").select("band", "h", "lo", "hi", "tid", "label", "block", "bands", "text")
    return rows.groupBy("band", "h", "lo", "hi").applyInArrow(_tile, "a binary, b binary").distinct()


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class with all its columns: that of the class's smallest id (null last), of equal ids that of the
    smallest tid, of equal ids and texts any one."""
    classes = near_duplicates(documents, id_col, text_col)
    member = F.struct(F.col(id_col).isNull().alias("__null"), F.coalesce(id_col, F.lit(0)).alias("__id"), F.col("tid").alias("__tid"))
    rows = classes.select("label", member.alias("member")).groupBy("label", "member").agg(F.count(F.lit(1)).alias("rows"))
    stay = rows.groupBy("label").agg(F.min(F.struct("member", "rows")).alias("first"))
    stay = materialize(stay.select("first.member.*", (F.col("first.rows") > 1).alias("__repeats")), "stay")
    key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    own = documents.withColumn("__tid", key).withColumn("__null", F.col(id_col).cast("long").isNull()).withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    kept = own.join(stay, ["__null", "__id", "__tid"])
    columns = documents.columns
    once = kept.where("not __repeats").select(*columns)
    if stay.where("__repeats").isEmpty():
        return once
    return once.unionByName(kept.where("__repeats").dropDuplicates(["__null", "__id", "__tid"]).select(*columns))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.lower(F.hex("label")).alias("class_key"))
