"""Token ids in Arrow stream files of equal-length sequences.

Method: each shard is an Arrow file whose record batches hold fixed-size lists, `ids` and `mask`, so any sequence is a
zero-copy slice of a memory map; a second file beside it holds where each document lies. Shards follow one another in
ascending id order.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Codec, library_words, text_parts, vocabulary_path
from .shared import LOWEST, new_folder, ranges, table, tidy

END_ID, SEQUENCE, BATCH_SEQUENCES = 2, 2048, 128
#: Bytes of text meant for one shard, and ids from which on a shard takes no more documents.
SHARD_BYTES, SHARD_IDS = 256 << 20, 1 << 28


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class TokenWriter:
    """Writes one shard: documents' ids one after another, cut into sequences; the last is padded and masked."""

    def __init__(self, path: str, width: np.dtype, sequence: int = SEQUENCE, batch: int = BATCH_SEQUENCES):
        self.uri = path
        self.store, self.path = _store(path)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.sequence, self.room, self.width = sequence, sequence * batch, np.dtype(width)
        value = pa.from_numpy_dtype(self.width)
        self.schema = pa.schema([("ids", pa.list_(value, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.index_schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
        self.sinks = [self.store.open_output_stream(self.temporary + end) for end in ("", ".index")]
        self.file, self.index = (pa.ipc.new_file(s, x) for s, x in zip(self.sinks, (self.schema, self.index_schema), strict=True))
        self.buffer, self.filled, self.total, self.documents = np.zeros(self.room, self.width), 0, 0, 0
        self.rows: list[tuple[int | None, int, int]] = []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.rows.append((key, self.total, len(ids)))
        self.total += len(ids)
        self.documents += 1
        while len(ids):
            part = ids[: self.room - self.filled]
            self.buffer[self.filled : self.filled + len(part)] = part
            self.filled += len(part)
            ids = ids[len(part) :]
            if self.filled == self.room:
                self._batch()
        if len(self.rows) >= 8192:
            self._rows()

    def _batch(self) -> None:
        n = -(-self.filled // self.sequence) * self.sequence
        self.buffer[self.filled : n] = 0
        flat, mask = pa.array(self.buffer[:n]), pa.array(np.arange(n) < self.filled)
        self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x, self.sequence) for x in (flat, mask)], schema=self.schema))
        self.filled = 0

    def _rows(self) -> None:
        columns = [pa.array(x, pa.int64()) for x in zip(*self.rows, strict=True)]
        self.index.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.index_schema))
        self.rows = []

    def close(self) -> None:
        """Only whole files get their name, so that a task that is run again replaces them."""
        if self.filled:
            self._batch()
        if self.rows:
            self._rows()
        self.file.close()
        self.index.close()
        for sink, end in zip(self.sinks, ("", ".index"), strict=True):
            sink.close()
            self.store.move(self.temporary + end, self.path + end)


class TokenFile:
    """Random access to one shard."""

    def __init__(self, path: str):
        store, place = _store(path)
        opened = (lambda p: pa.memory_map(p)) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file
        self.reader, self.index = pa.ipc.open_file(opened(place)), pa.ipc.open_file(opened(place + ".index"))
        self.sequence_length = self.reader.schema.field("ids").type.list_size
        sizes = [self.reader.get_batch(i).num_rows for i in range(min(1, self.reader.num_record_batches))]
        self.per_batch = sizes[0] if sizes else 1
        self.open: tuple[int, np.ndarray | None] = (-1, None)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of the i-th sequence, as views of the file."""
        batch = self.reader.get_batch(i // self.per_batch)
        at = i % self.per_batch
        return batch.column("ids").slice(at, 1).flatten().to_numpy(), batch.column("mask").slice(at, 1).flatten()

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from start on; a view where one batch holds them."""
        room, parts = self.per_batch * self.sequence_length, []
        while n > 0:
            i = start // room
            if self.open[0] != i:
                self.open = (i, self.reader.get_batch(i).column("ids").flatten().to_numpy())
            part = self.open[1][start - i * room :][:n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def documents(self) -> Iterator[pa.RecordBatch]:
        for i in range(self.index.num_record_batches):
            yield self.index.get_batch(i)


def write_tokens(
    documents: DataFrame, folder: str, vocabulary: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, shard_ids: int = SHARD_IDS
) -> list[dict]:
    """Encode every whole text, append end_id, write shards to folder in ascending id order; the manifest, a row a shard.

    A null text is empty and has the end id alone. Null ids come first, rows of one id lie side by side in the order of
    the xxhash64 of their texts. A shard that grows beyond SHARD_IDS ids is followed by another of the same task. An empty
    table writes nothing. The driver holds one small row a shard and nothing of the documents.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ready = documents.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    cut = ranges(ready.select("id", "tie"), ready.agg(F.sum(F.octet_length("text"))).first()[0] or 0, SHARD_BYTES)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary, library_words)
        width, tail = _width(codec.size, end_id), [] if end_id is None else [end_id]
        for batch in batches:
            for part, texts in text_parts(batch, 1):
                ids = [np.concatenate([x, tail]).astype(width) for x in codec.encode(texts)]
                range_of, _ = cut.of(part.column(0).fill_null(LOWEST).to_numpy(zero_copy_only=False), part.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range_of, pa.int32()), part.column(0), part.column(2),
                        pa.array([len(x) for x in ids], pa.int64()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in ids]),
                    ],
                    names=["part", "id", "tie", "n", "packed"],
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, piece, writer = TaskContext.get().partitionId(), 0, None
        width = _width(Codec.size_of(vocabulary), end_id)

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "piece": pa.array([piece], pa.int32()), "path": [writer.uri], "n_ids": [writer.total], "n_documents": [writer.documents]})

        for batch in batches:
            for key, n, packed in zip(*(batch.column(i) for i in range(3)), strict=True):
                if writer is not None and writer.total >= shard_ids:
                    yield closed()
                    writer, piece = None, piece + 1
                if writer is None:
                    writer = TokenWriter(f"{folder}/shard-{task:08d}-{piece:06d}.arrow", width, sequence)
                writer.add(key.as_py(), np.frombuffer(pa.decompress(packed.as_buffer(), n.as_py() * width.itemsize, "zstd"), width))
        if writer is not None:
            yield closed()

    store, place = _store(folder)
    store.create_dir(place, recursive=True)
    encoded = ready.mapInArrow(tidy(encode), "part int, id long, tie long, n long, packed binary")
    dealt = encoded.repartitionById(len(cut), "part").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie", "packed").select("id", "n", "packed")
    shards = dealt.mapInArrow(tidy(write), "task int, piece int, path string, n_ids long, n_documents long").collect()
    return [r.asDict() for r in sorted(shards, key=lambda r: (r.task, r.piece))]


def _width(size: int, end_id: int | None) -> np.dtype:
    return np.dtype("<u2" if max(size - 1, end_id or 0) < 1 << 16 else "<u4")


def read_tokens(spark: SparkSession, manifest: list[dict], id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    rows, base = [], 0
    for x in manifest:
        rows.append((x["path"], base))
        base += x["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = TokenFile(path)
                for own in shard.documents():
                    starts, sizes = own.column("start").to_numpy(), own.column("n").to_numpy()
                    sums = [zlib.crc32(shard.span(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([own.column("id"), pa.array(starts + before), own.column("n"), pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(rows, "path string, before long").repartition(len(rows)).mapInArrow(read, schema)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), vocabulary_path("byte_bpe_50k.json"))
    return read_tokens(spark, manifest)
