"""Quality classifier by positive-unlabelled learning.

Method: the non-negative unbiased risk prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]) is minimised over
trusted positives and unlabelled text. With squared loss it is a function of the two first moments of either, so all
unlabelled text counts: one pass sums the moments, and the minimum is computed from these exactly. The class prior is
estimated from how the scores of both are spread, without any negative. Features are how often pairs and triples of
character shapes occur in the whole text, and how often words repeat; no feature knows a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import id_crc, table, tidy
from .textvec import byte_view, chunks, words_of

#: The fit takes at most so many trusted positives, the first by a hash of their ids; of unlabelled text it takes all.
POSITIVES = 20_000
FOLDS, HELD_FOLD, THRESHOLD = 5, 0, 0.3
PAIRS, TRIPLES, REPEATS = 256, 512, 3
WIDTH = PAIRS + TRIPLES + REPEATS
#: Ridge on standardised features, over the number of positives; rows summed at one node of the tree; bins of the prior's
#: histograms; its confidence, and the least share of positives that may speak for it.
RIDGE, FAN_IN, BINS, DELTA, LEAST_SHARE = 30.0, 8, 1000, 0.05, 0.05
_SHAPES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "|", "!?", "$%&", "#*@", "()[]{}<>", "=:;/\\_", "'\"`-+~^"]


def _shape_table() -> np.ndarray:
    shape = np.full(256, len(_SHAPES), np.uint8)  # control characters
    for i, chars in enumerate(_SHAPES):
        shape[[ord(c) for c in chars]] = i
    shape[0x80:] = len(_SHAPES) + 1  # bytes of other letters
    return shape


_SHAPE = _shape_table()
_TRIPLE = np.random.default_rng(7).integers(0, TRIPLES, 4096)


def features(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of pairs and triples of shapes in each whole text, and of words that repeat the last
    one, the last but one or any before; zeros for an empty text."""
    raw, offsets = byte_view(texts)
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)
    shape = _SHAPE[raw].astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    for width, at, size in ((2, 0, PAIRS), (3, PAIRS, TRIPLES)):
        if len(raw) < width:
            continue
        codes = shape[: len(raw) - width + 1].copy()
        for i in range(1, width):
            codes = codes * 16 + shape[i : len(raw) - width + 1 + i]
        same = owner[: len(codes)] == owner[width - 1 :]
        codes = codes if width == 2 else _TRIPLE[codes]
        counts = np.bincount(owner[: len(codes)][same] * size + codes[same], minlength=n * size).reshape(n, size)
        out[:, at : at + size] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    words = words_of(raw, offsets)
    total = np.maximum(np.diff(words.edges), 1)
    at = PAIRS + TRIPLES
    for back in (1, 2):
        again = (words.hashes[back:] == words.hashes[:-back]) & (words.owner[back:] == words.owner[:-back])
        out[:, at + back - 1] = np.sqrt(np.bincount(words.owner[back:][again], minlength=n) / total)
    order = np.lexsort((words.hashes, words.owner))
    again = (words.hashes[order][1:] == words.hashes[order][:-1]) & (words.owner[order][1:] == words.owner[order][:-1])
    out[:, at + 2] = np.sqrt(np.bincount(words.owner[order][1:][again], minlength=n) / total) / 4
    return out


@dataclass
class Moments:
    """Number, sums and sums of products of rows of features with a 1 behind each."""

    n: float
    products: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        y = np.append(x, np.ones((len(x), 1), np.float32), axis=1)
        return Moments(len(x), (y.T @ y).astype(np.float64))

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.products + other.products)


NOTHING = Moments(0, np.zeros((WIDTH + 1, WIDTH + 1)))
_UPPER = np.triu_indices(WIDTH + 1)


def packed(m: Moments) -> bytes:
    return m.products[_UPPER].astype(np.float32).tobytes()


def unpacked(n: float, raw: bytes) -> Moments:
    out = np.zeros((WIDTH + 1, WIDTH + 1))
    out[_UPPER] = np.frombuffer(raw, np.float32)
    return Moments(n, out + np.triu(out, 1).T)


@dataclass
class QualityModel:
    weights: np.ndarray  # the bias behind the features' weights
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        """(1 + margin) / 2 estimates the probability; a curve that meets it at THRESHOLD and at 1/2 keeps the order beyond
        0 and 1. Rounded, so that equal texts score alike in whatever batch they are."""
        steep = np.log(THRESHOLD / (1 - THRESHOLD)) / (2 * THRESHOLD - 1)
        return np.round(1 / (1 + np.exp(-np.clip(steep * self.margin(x), -60, 60))), 9)


def fit_nnpu(positive: Moments, unlabelled: Moments, prior: float) -> QualityModel:
    """The minimum of the non-negative risk with squared loss (1 - z)**2 / 4 and a ridge.

    Where the negative part of the unbiased risk is not below 0 at its minimum, that is the answer; else the part weighs
    less, as little less as makes it 0, which are the conditions of the constrained minimum.
    """
    if not positive.n or not unlabelled.n:
        return QualityModel(np.zeros(WIDTH + 1), prior)
    sp, su = positive.products / positive.n, unlabelled.products / unlabelled.n
    scale = 1 / np.sqrt(np.maximum(np.diag(su) - su[-1] ** 2, 1e-6))
    center = np.eye(WIDTH + 1) * scale  # standardised features as a linear map of the plain ones
    center[:-1, -1] = -su[-1, :-1] * scale[:-1]
    center[-1, -1] = 1
    sp, su = center @ sp @ center.T, center @ su @ center.T
    mp, mu = sp[-1], su[-1]
    ridge = RIDGE / positive.n * np.eye(WIDTH + 1)
    ridge[-1, -1] = 0

    def minimum(part: float) -> tuple[np.ndarray, float]:
        w = np.linalg.solve(prior * sp + part * (su - prior * sp) + ridge, prior * mp - part * (mu - prior * mp))
        return w, 1 - prior + 2 * w @ (mu - prior * mp) + w @ (su - prior * sp) @ w

    w, negative = minimum(1.0)
    if negative < 0:
        low, high = 0.0, 1.0
        for _ in range(30):
            middle = (low + high) / 2
            low, high = (middle, high) if minimum(middle)[1] >= 0 else (low, middle)
        w, _ = minimum(low)
    return QualityModel(center.T @ w, prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from counts of margins in ascending bins, of positives and of unlabelled rows.

    The unlabelled share above a threshold is at least prior times the positives' share above it, and close to that where
    hardly a negative is. The threshold is the one whose upper bound, by both samples' spread, is least.
    """
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    over_p, over_u = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (positive, unlabelled))
    spread = sum(np.sqrt(np.log(4 / DELTA) / (2 * n)) for n in (n_p, n_u))
    ok = over_p >= LEAST_SHARE
    bound = np.where(ok, (over_u + spread) / np.maximum(over_p, 1e-9), np.inf)
    at = int(np.argmin(bound))
    return float(np.clip(over_u[at] / over_p[at], 0.05, 0.95))


def trusted_positives(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """At most POSITIVES ids of label 1. Ids with a null or two different labels are not trusted."""
    learns = F.col("id").isNotNull() & (F.pmod(id_crc("id"), F.lit(FOLDS)) != HELD_FOLD)
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where(learns)
    marks = marks.groupBy("id").agg(F.min("y").alias("least"), F.max("y").alias("most"), F.count("y").alias("n"), F.count(F.lit(1)).alias("all"))
    good = marks.where("least = 1 and most = 1 and n = all").select("id", F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1 << 32)).alias("h"))
    total = good.count()
    if total > 2 * POSITIVES:  # few more than are wanted are ever sorted
        good = good.where(F.col("h") < int((1 << 32) * 1.2 * POSITIVES / total))
    return good.orderBy("h", "id").limit(POSITIVES).select("id", F.lit(True).alias("positive"))


def fit_quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on documents whose crc32(id) mod FOLDS is not HELD_FOLD: all of them are the unlabelled text.

    Negative labels are never looked at. Without positives or texts every score is 1/2. Rows of one id count each. The
    driver gets the sums of moments and two histograms, whatever the number of rows.
    """
    learns = F.col("id").isNotNull() & (F.pmod(id_crc("id"), F.lit(FOLDS)) != HELD_FOLD)
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tasks = texts.rdd.getNumPartitions()
    chosen = trusted_positives(labels, id_col, label_col)
    rows = texts.where(learns).join(F.broadcast(chosen), "id", "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive"))
    sums = {kind: unpacked(n, raw) for kind, n, raw in _sum_tree(rows, tasks)}
    positive, unlabelled = sums.get(1, NOTHING), sums.get(0, NOTHING)
    if not positive.n:
        return fit_nnpu(positive, unlabelled, 0.5)
    first = fit_nnpu(positive, unlabelled, 0.5)
    return fit_nnpu(positive, unlabelled, estimated_prior(*_histograms(rows, first)))


def _sum_tree(rows: DataFrame, tasks: int) -> list[tuple[int, float, bytes]]:
    """(kind, n, packed moments) of all unlabelled rows (0: every row) and of the positives (1), added up FAN_IN at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [NOTHING, NOTHING]
        for batch in batches:
            for part in chunks(batch, 0):
                x, good = features(part.column(0)), part.column(1).to_numpy(zero_copy_only=False)
                total[0] += Moments.of(x)
                if good.any():
                    total[1] += Moments.of(x[good])
        for kind, m in enumerate(total):
            if m.n:
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([m.n], pa.float64()), pa.array([packed(m)])], names=["kind", "node", "n", "sums"])

    def add(key: tuple, some: pa.Table) -> pa.Table:
        total = NOTHING
        for n, raw in zip(some["n"].to_pylist(), some["sums"], strict=True):
            total += unpacked(n, raw.as_buffer())
        return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([total.n], pa.float64()), "sums": pa.array([packed(total)])})

    schema = "kind int, node long, n double, sums binary"
    nodes = rows.mapInArrow(tidy(run), schema)
    while tasks > 1:
        nodes = nodes.withColumn("node", F.expr(f"node div {FAN_IN}")).groupBy("kind", "node").applyInArrow(add, schema)
        tasks = -(-tasks // FAN_IN)
    return [(r.kind, r.n, r.sums) for r in nodes.collect()]


def _histograms(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the scores in BINS bins, of positives and of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for part in chunks(batch, 0):
                at = np.minimum((model.score(features(part.column(0)).astype(np.float64)) * BINS).astype(np.int64), BINS - 1)
                good = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                counts += np.stack([np.bincount(at[good], minlength=BINS), np.bincount(at, minlength=BINS)])
        kind, place = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(counts[kind, place])], names=["kind", "bin", "n"])

    out = np.zeros((2, BINS))
    for r in rows.mapInArrow(tidy(run), "kind int, bin int, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect():
        out[r.kind, r.bin] = r.n
    return out[0], out[1]


def score_quality(documents: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """The columns of keep (by default the id) and, under the given names, held_out, score and predicted of each row, from
    its whole text alone.

    Columns of keep that bear one of these names give way. A null text counts as empty; all empty texts score alike. Rows
    that repeat stay; a null id is not held out. An empty table gives an empty result.
    """
    keep = [c for c in ([id_col] if keep is None else keep) if c not in names]
    held = (F.pmod(id_crc(id_col), F.lit(FOLDS)) == HELD_FOLD) & F.col(id_col).isNotNull()
    inner = [f"c{i}" for i in range(len(keep))]
    ready = documents.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner, strict=True)), held.alias("held"), F.col(text_col).alias("text"))
    last = len(inner) + 1
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in ready.schema.fields[:last]), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, last):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(model.score(features(part.column(last)).astype(np.float64)), pa.float64())], names=[*inner, "held", "score"])

    scored = ready.mapInArrow(tidy(run), schema)
    columns = [F.col(n).alias(c) for c, n in zip(keep, inner, strict=True)]
    return scored.select(*columns, F.col("held").alias(names[0]), F.col("score").alias(names[1]), (F.col("score") >= THRESHOLD).cast("int").alias(names[2]))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_quality(documents, fit_quality(documents, table(spark, sf_dir, "labels")))
