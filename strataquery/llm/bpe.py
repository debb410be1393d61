"""BPE encoding and decoding that equals the tokenizers library, over whole batches of texts at once.

Method: forced-boundary splitting. Where two neighbouring bytes never stand side by side inside any vocabulary token,
no merge can cross, so the text is cut there for certain; fragments are encoded independently and concatenated.
Borders of pre-tokens are such cuts too. Equal pre-tokens are encoded once while a bounded table remembers them; a hash
finds the entry, and the characters themselves decide whether it is the same pre-token.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, tidy

#: Characters segmented at once; slots of the table of known pre-tokens; ids it holds before it starts anew.
CHUNK_CHARS, SLOT_BITS, STORE_IDS = 1_000_000, 20, 6_000_000
#: Fragments remembered, and the length from which merges use a heap.
FRAGMENTS, HEAP_FROM = 200_000, 40
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: White space as the library's patterns have it, and the endings that stay with an apostrophe.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS_1, ENDINGS_2 = "stmd", ("re", "ve", "ll")
#: Beyond these characters the library itself normalizes; within, lower case is all there is to do.
_EXOTIC = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            out[i] = LETTER
        elif c == "N":
            out[i] = NUMBER
    out[WHITE] = SPACE
    return out


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def segments(points: np.ndarray, begins: np.ndarray, attach_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens of texts that begin at begins, and each one's class.

    attach_space: the splitting of byte-level vocabularies, where one space stays before a word and runs of numbers hold
    together; else every number character is alone.
    """
    n = len(points)
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    run = np.empty(n + 1, bool)
    run[0] = run[n] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:n])
    run |= first
    bound = run.copy()
    if attach_space:
        ends = np.flatnonzero(run[1:] & ~first[1:] & (kind == SPACE)) + 1  # of white space before something else
        bound[ends - 1] = True
        bound[ends[points[ends - 1] == 0x20]] = False
    else:
        bound[:n] |= kind == NUMBER
    marks = np.flatnonzero((points == 0x27) & run[:n] & bound[:n] & run[1:])
    marks = marks[~first[marks + 1]]
    if len(marks):
        marks = marks[kind[marks + 1] == LETTER]
        one = points[marks + 1]
        inside = (marks + 2 < n) & ~first[np.minimum(marks + 2, n)]
        two = np.where(inside, points[np.minimum(marks + 2, n - 1)], 0)
        takes = np.where(np.isin(one, [ord(c) for c in ENDINGS_1]), 1, 0)
        for a, b in ENDINGS_2:
            takes[(one == ord(a)) & (two == ord(b))] = 2
        marks, takes = marks[takes > 0], takes[takes > 0]
        bound[marks + 1] = False
        after = marks + 1 + takes
        bound[after] |= ~first[after] & (kind[np.minimum(after, n - 1)] == LETTER) & (after < n)
    starts = np.flatnonzero(bound[:n])
    return starts, kind[starts]


class _Powers:
    def __init__(self):
        self.values = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            self.values = np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _ODD[0], np.uint64)]).cumprod(dtype=np.uint64)
        return self.values


_POWERS = _Powers()


def run_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of values; runs begin at starts, the first at 0, and fill the array."""
    sizes = np.diff(starts, append=len(values))
    place = np.arange(len(values)) - np.repeat(starts, sizes)
    mixed = (values.astype(np.uint64) + np.uint64(0x51)) * _ODD[1]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _POWERS.upto(int(sizes.max(initial=0)) + 1)[place]
    h = np.add.reduceat(mixed, starts) if len(starts) else np.zeros(0, np.uint64)
    h = (h ^ (h >> np.uint64(29))) * _ODD[2] + sizes.astype(np.uint64) * _ODD[1]
    return h ^ (h >> np.uint64(32))


class ForcedBoundaryBPE:
    """Merges of one vocabulary file, applied between the cuts that are certain."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.end = end
        symbol = byte_symbols()
        back = {c: b for b, c in symbol.items()}
        self.plain = [vocab.get(symbol[b], -1) for b in range(256)]
        self.last = [vocab.get(symbol[b] + end, -1) for b in range(256)] if end else self.plain
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for i, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), (i, vocab[a + b]))
        inner, final = bytearray(65536), bytearray(65536)
        for token in vocab:
            closes = bool(end) and token.endswith(end) and len(token) > len(end)
            raw = [back[c] for c in (token[: -len(end)] if closes else token) if c in back]
            for i in range(len(raw) - 1):
                (final if closes and i == len(raw) - 2 else inner)[raw[i] << 8 | raw[i + 1]] = 1
        self.inner, self.final = bytes(inner), bytes(final if end else inner)
        self.fragments: dict[tuple[bytes, bool], list[int]] = {}

    def cuts(self, word: bytes) -> list[int]:
        """Where no token can cross, for certain."""
        n = len(word)
        inner = self.inner
        out = [i + 1 for i in range(n - 2) if not inner[word[i] << 8 | word[i + 1]]]
        if n > 1 and not self.final[word[n - 2] << 8 | word[n - 1]]:
            out.append(n - 1)
        return out

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token: its fragments' ids, one after another."""
        cuts = self.cuts(word)
        if not cuts:
            return self._fragment(word, True)
        out: list[int] = []
        at = 0
        for cut in [*cuts, len(word)]:
            out += self._fragment(word[at:cut], cut == len(word))
            at = cut
        return out

    def _fragment(self, raw: bytes, last: bool) -> list[int]:
        if (ids := self.fragments.get((raw, last))) is None:
            ids = [self.plain[b] for b in raw]
            if last and raw:
                ids[-1] = self.last[raw[-1]]
            ids = self._merge(ids) if len(ids) < HEAP_FROM else self._merge_long(ids)
            if len(raw) < 64:
                if len(self.fragments) >= FRAGMENTS:
                    self.fragments.clear()
                self.fragments[raw, last] = ids
        return ids

    def _merge(self, ids: list[int]) -> list[int]:
        rank = self.rank.get
        while len(ids) > 1:
            best, pair = None, None
            for p in zip(ids, ids[1:], strict=False):
                r = rank(p)
                if r is not None and (best is None or r < best):
                    best, pair = r, p
            if best is None:
                break
            out, i, n = [], 0, len(ids)
            while i < n:
                if i + 1 < n and ids[i] == pair[0] and ids[i + 1] == pair[1]:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs by (rank, place), in n log n."""
        n = len(ids)
        ids = list(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.rank.get
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x in (left[i], i):
                if x >= 0 and (y := right[x]) >= 0 and (r := rank((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y], r[1]))
        return [x for x in ids if x >= 0]


class Codec:
    """Encodes and decodes as tokenizers does with one of the public files and add_special_tokens=False.

    word_encoder(tokenizer, description) gives the function from a pre-token to its ids; by default forced-boundary BPE.
    """

    def __init__(self, path: str, word_encoder: Callable | None = None):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        assert model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
        self.library = Tokenizer.from_file(path)
        self.end = model.get("end_of_word_suffix") or ""
        self.attach_space = not self.end
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lowers = spec["normalizer"] is not None
        self.size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.byte_level = (spec["decoder"] or {}).get("type") == "ByteLevel"
        back = {c: b for b, c in byte_symbols().items()}
        self.token_bytes: list[bytes | None] = [None] * self.size
        for token, i in (model["vocab"] | self.special).items():
            self.token_bytes[i] = bytes(back[c] for c in token) if self.byte_level and all(c in back for c in token) else token.encode()
        self.encode_word = word_encoder(self.library) if word_encoder else ForcedBoundaryBPE(model["vocab"], model["merges"], self.end).encode
        self._forget()

    @staticmethod
    def size_of(path: str) -> int:
        """Ids of a vocabulary file: one more than the largest."""
        spec = json.loads(open(path, encoding="utf-8").read())
        return max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])]) + 1

    def _forget(self) -> None:
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.where = np.zeros(1 << SLOT_BITS, np.int64)
        self.flat = np.zeros(1 << 16, np.int32)
        self.bounds, self.count = np.zeros(1 << 12, np.int64), 0  # where each known pre-token's ids begin in flat
        self.chars, self.spans = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)  # its characters, and where they begin

    def _normal(self, text: str) -> str:
        if not self.lowers:
            return text
        if text.isascii() or not _EXOTIC.search(text):
            return text.lower()
        return self.library.normalizer.normalize_str(text)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Ids of new pre-tokens into the store; their numbers."""
        new = [self.encode_word(w.encode()) for w in words]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        ids = np.fromiter((i for x in new for i in x), np.int32, int(sizes.sum()))
        number, used = self.count, int(self.bounds[self.count])
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
        self.flat[used : used + len(ids)] = ids
        if number + len(new) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros(max(len(self.bounds), len(new)), np.int64)])
        self.bounds[number + 1 : number + 1 + len(new)] = used + np.cumsum(sizes)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        used = int(self.spans[number])
        if used + len(points) > len(self.chars):
            self.chars = np.concatenate([self.chars, np.zeros(max(len(self.chars), len(points)), np.uint32)])
        self.chars[used : used + len(points)] = points
        if number + len(new) >= len(self.spans):
            self.spans = np.concatenate([self.spans, np.zeros(max(len(self.spans), len(new)), np.int64)])
        self.spans[number + 1 : number + 1 + len(new)] = used + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        self.count += len(new)
        return number + np.arange(len(new))

    def _encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has."""
        texts = [self._normal(t) for t in texts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begins = np.cumsum(sizes) - sizes
        starts, kind = segments(points, begins[sizes > 0], self.attach_space)
        hashes = run_hashes(points, starts)
        lengths = np.diff(starts, append=len(points))
        if not self.attach_space:
            keep = kind != SPACE
            starts, hashes, lengths = starts[keep], hashes[keep], lengths[keep]
        if self.bounds[self.count] > STORE_IDS:
            self._forget()
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        number = self.where[slot]
        missed = np.flatnonzero(self.keys[slot] != hashes)
        if len(missed):
            new, at, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            at = missed[at]
            numbers = self._learn([joined[s : s + z] for s, z in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)])
            number[missed] = numbers[back]
            self.keys[slot[at]], self.where[slot[at]] = new, numbers
        if len(wrong := self._unlike(points, starts, lengths, number)):
            number[wrong] = self._learn([joined[s : s + z] for s, z in zip(starts[wrong].tolist(), lengths[wrong].tolist(), strict=True)])
        bounds = self.bounds
        first, count = bounds[number], bounds[number + 1] - bounds[number]
        total = int(count.sum())
        run = np.cumsum(count) - count
        ids = self.flat[np.arange(total) + np.repeat(first - run, count)]
        upto = np.concatenate([[0], np.cumsum(count)])
        edge = np.searchsorted(starts, np.append(begins, len(points)))
        return ids, upto[edge[1:]] - upto[edge[:-1]]

    def _unlike(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Pre-tokens that are not the known ones they were taken for, character by character: a hash decides nothing."""
        known = self.spans[number]
        odd = lengths != self.spans[number + 1] - known
        sizes = np.where(odd, 0, lengths)
        total = int(sizes.sum())
        run = np.cumsum(sizes) - sizes
        step = np.arange(total)
        differ = points[step + np.repeat(starts - run, sizes)] != self.chars[step + np.repeat(known - run, sizes)]
        if differ.any():
            odd[np.repeat(np.arange(len(sizes)), sizes)[differ]] = True
        return np.flatnonzero(odd)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null counts as empty."""
        at = 0
        while at < len(texts):
            chars, upto = 0, at
            while upto < len(texts) and (upto == at or chars + len(texts[upto] or "") <= CHUNK_CHARS):
                chars += len(texts[upto] or "")
                upto += 1
            chunk = [t or "" for t in texts[at:upto]]
            at = upto
            if self.split_special and any(s in t for s in self.special for t in chunk):
                pieces = [self.split_special.split(t) for t in chunk]
                ids, counts = self._encode_pieces([p for x in pieces for p in x[::2]])
                parts = iter(np.split(ids, np.cumsum(counts)[:-1]))
                for x in pieces:
                    yield np.concatenate([np.array([self.special[p]], np.int32) if i % 2 else next(parts) for i, p in enumerate(x)])
            else:
                ids, counts = self._encode_pieces(chunk)
                yield from np.split(ids, np.cumsum(counts)[:-1])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the library's decode(ids, skip_special_tokens=False); ids outside the vocabulary are left out."""
        tokens = [t for i in ids.tolist() if 0 <= i < self.size and (t := self.token_bytes[i]) is not None]
        return b"".join(tokens).decode("utf-8", "replace").encode() if self.byte_level else b" ".join(tokens)


def library_words(tokenizer) -> Callable[[bytes], list[int]]:
    """The library's own merges, pre-token by pre-token."""
    symbol = byte_symbols()
    tables = {b: symbol[b] for b in range(256)}
    model = tokenizer.model
    return lambda word: [t.id for t in model.tokenize(word.decode("latin-1").translate(tables))]


def encode_documents(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (by default the id) with token_ids, n_tokens, ids_sha256 and decoded_sha256 of each row.

    A null text counts as empty and has no ids; a repeated row has its row in the result each time. Columns are taken by
    name, others are ignored; an empty table gives an empty result. Texts of any length are encoded whole.
    """
    keep = [id_col] if keep is None else keep
    ready = documents.select(*(F.col(c) for c in keep), F.col(text_col).alias("__text"))
    kept = [f for f in ready.schema.fields if f.name != "__text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "token_ids array<int>", "n_tokens long", "ids_sha256 string", "decoded_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            for part, texts in text_parts(batch, batch.num_columns - 1):
                ids = list(codec.encode(texts))
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1], lists, pa.array(sizes),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(codec.decode_bytes(x)).hexdigest() for x in ids]),
                    ],
                    names=[*(f.name for f in kept), "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return ready.mapInArrow(tidy(run), schema)


def text_parts(batch: pa.RecordBatch, column: int, most: int = 4 * CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with about most bytes of text each, a longer text alone."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        part = batch.slice(at, end - at)
        yield part, part.column(column).to_pylist()
        at = end


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json")).drop("token_ids")
