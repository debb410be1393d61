"""Document fingerprints by I-Match.

Method: the lexicon is the terms within a band of document frequency (so of inverse document frequency); a text's
distinct terms of the lexicon are sorted and hashed once for each of several randomised lexicon subsets. Subsets come in
families, each thinner by half than the one before, so that short and long texts have subsets that meet few of their terms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWEST, ranges, table, tidy
from .textvec import CHUNK_BYTES, Counter, byte_view, chunks, find, finish, words_of

#: Terms count that are in at least this share of the documents (and in two) and at most this share.
LEAST_SHARE, MOST_SHARE, LEAST_DOCUMENTS = 2e-4, 0.05, 2
#: Terms that a lexicon may have: every task holds it, at 8 bytes a term.
MOST_TERMS = 1 << 23
#: Families of subsets; subset l of a family keeps each term with probability 2**-l.
FAMILIES, LEVELS = 8, 10
_DIGITS, _NONE = 5, "-"
_SEEDS = np.random.default_rng(6).integers(1, 2**63, (FAMILIES, 2)).astype(np.uint64)
#: Bytes of packed text meant for one task.
TASK_BYTES = 64 << 20


def distinct_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(owner, hash) of the distinct terms of each text, sorted; A-Z count as a-z."""
    raw, offsets = byte_view(texts)
    words = words_of(raw, offsets)
    order = np.lexsort((words.hashes, words.owner))
    owner, h = words.owner[order], words.hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new], len(offsets) - 1


def document_frequencies(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, n): in how many documents each term is, over all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        give = lambda keys, counts: pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "n"])
        for batch in batches:
            for part in chunks(batch, 0):
                _, h, _ = distinct_terms(part.column(0))
                if (full := counter.add(*np.unique(h, return_counts=True))) is not None:
                    yield give(*full)
        yield give(*(x.astype(t) for x, t in zip(counter.take(), (np.uint64, np.int64), strict=True)))

    return documents.select(F.col(text_col).alias("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def lexicon(documents: DataFrame, text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> np.ndarray:
    """Sorted hashes of the terms in the band.

    Bounded whatever the corpus: each of N documents adds its distinct terms once, so at most (mean distinct terms of a
    document) / least terms can be in least * N documents or more. More than MOST_TERMS are refused with ValueError.
    """
    n = documents.count()
    floor, ceiling = max(LEAST_DOCUMENTS, int(np.ceil(least * n))), most * n
    band = document_frequencies(documents, text_col).where((F.col("n") >= floor) & (F.col("n") <= F.lit(float(max(ceiling, floor)))))
    rows = band.select("h").toArrow()
    if rows.num_rows > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms in the band: raise the least share")
    return np.sort(rows["h"].to_numpy().view(np.uint64))


def fingerprints(texts: pa.Array, terms: np.ndarray) -> np.ndarray:
    """A row of FAMILIES * LEVELS hashes of _DIGITS hexadecimal digits for each text, plus 1; 0 where a subset has none of
    its terms.

    A text without any term of the lexicon is hashed by all its distinct terms; a text without terms has zeros.
    """
    owner, h, n = distinct_terms(texts)
    inside = find(terms, h) >= 0
    bare = np.bincount(owner[inside], minlength=n) == 0
    keep = inside | bare[owner]
    owner, h = owner[keep], h[keep]
    out = np.zeros((n, FAMILIES, LEVELS), np.uint64)
    for f in range(FAMILIES):
        place, value, who = finish(h ^ _SEEDS[f, 0], 1), finish(h ^ _SEEDS[f, 1], 2), owner
        for level in range(LEVELS):
            if level:
                stay = (place >> np.uint64(64 - level)) == 0
                place, value, who = place[stay], value[stay], who[stay]
            edges = np.searchsorted(who, np.arange(n + 1))
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
            sums = (finish(upto[edges[1:]] - upto[edges[:-1]], np.diff(edges)) >> np.uint64(64 - 4 * _DIGITS)) + np.uint64(1)
            out[:, f, level] = np.where(np.diff(edges) > 0, sums, 0)
    return out.reshape(n, -1)


def as_text(rows: np.ndarray) -> list[str]:
    """Hash by hash in _DIGITS hexadecimal digits, `-` for an empty subset."""
    return [".".join([f"{x - 1:0{_DIGITS}x}" if x else _NONE for x in row]) for row in rows.tolist()]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes, as the fingerprints show them, among the subsets that meet either text; 1 for two texts
    without terms."""
    some = (a != 0) | (b != 0)
    n = some.sum(axis=1)
    return np.where(n > 0, ((a == b) & some).sum(axis=1) / np.maximum(n, 1), 1.0)


def edited_text(text: str, following: str) -> str:
    """text with its last half replaced by the first as many characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next row is that of the next id, after the last the first; null ids come first, rows of one id follow one another
    by the xxhash64 of their texts. A null text is empty; empty texts share one fingerprint. A table of one row is its own next; an empty
    table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ready = documents.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    terms = lexicon(ready)
    key = F.struct(F.coalesce("id", F.lit(int(LOWEST))).alias("id"), "tie")
    size, least = ready.agg(F.sum(F.octet_length("text")), F.min(key)).first()
    cut = ranges(ready.select("id", "tie"), size or 0, TASK_BYTES)
    last = len(cut) - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to its range; the first of each range, and of all, also as what follows the range before."""
        for batch in batches:
            for part in chunks(batch, 1):
                keys, ties = part.column(0).fill_null(LOWEST).to_numpy(zero_copy_only=False), part.column(2).to_numpy()
                texts = [t.encode() for t in part.column(1).to_pylist()]
                packed = [pa.compress(t, "zstd", asbytes=True) for t in texts]
                range_of, begins = cut.of(keys, ties)
                rows = [(int(p), False, i) for i, p in enumerate(range_of)]
                rows += [(int(range_of[i]) - 1, True, i) for i in np.flatnonzero(begins)]
                rows += [(last, True, i) for i in np.flatnonzero((keys == least.id) & (ties == least.tie))]
                p, ahead, at = zip(*rows, strict=True)
                where = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p, pa.int32()), pa.array(ahead), part.column(0).take(where), part.column(2).take(where), pa.array([len(texts[i]) for i in at], pa.int64()), pa.array([packed[i] for i in at], pa.binary())],
                    names=["part", "ahead", "id", "tie", "n", "packed"],
                )

    def marked(rows: list[tuple[int | None, str]], following: str | None) -> pa.RecordBatch:
        texts = [t for _, t in rows] + ([following] if following is not None else [])
        nexts = texts[1:] if following is not None else [*texts[1:], texts[0]]
        changed = [edited_text(t, n) for (_, t), n in zip(rows, nexts, strict=True)]
        own = fingerprints(pa.array(texts, pa.string()), terms)
        edited = fingerprints(pa.array(changed, pa.string()), terms)
        n = len(rows)
        after = own[1 : n + 1] if following is not None else np.roll(own, -1, axis=0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in rows], pa.int64()), pa.array([len(t) for _, t in rows], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(as_text(own[:n])), pa.array(as_text(edited)),
                pa.array(likeness(own[:n], edited)), pa.array(likeness(own[:n], after)),
            ],
            names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, done = 0, False
        for batch in batches:
            for ahead, key, n, packed in zip(*(batch.column(i) for i in range(4)), strict=True):
                if done:
                    continue
                text = pa.decompress(packed.as_buffer(), n.as_py(), "zstd", asbytes=True).decode() if n.as_py() else ""
                if held and (ahead.as_py() or size > CHUNK_BYTES):
                    yield marked(held, text)
                    held, size = [], 0
                if ahead.as_py():
                    done = True
                else:
                    held.append((key.as_py(), text))
                    size += n.as_py()
        if held:
            yield marked(held, None)

    dealt = ready.mapInArrow(tidy(deal), "part int, ahead boolean, id long, tie long, n long, packed binary")
    rows = dealt.repartitionById(len(cut), "part").sortWithinPartitions("ahead", F.col("id").asc_nulls_first(), "tie", "packed").select("ahead", "id", "n", "packed")
    return rows.mapInArrow(tidy(run), f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
