"""Token-id files: fixed-size blocks of ids as bit or byte planes, each plane compressed.

A shard file is

    magic "LOOMBP01" | planes of all blocks | index (zstd) | index length (u64) | magic

The index is a little-endian record: plane kind, ids in a block, counts, by block its place,
ids and the compressed length of each plane, and by document its id and number of ids.  A
reader needs the last 16 bytes, the index, and only the blocks it wants.

All-zero planes, as the high bytes of a small vocabulary, take no room at all.  Ids are
unsigned 32-bit.  A null text is an empty one and has the end id alone; an empty table gives
no shard; repeated rows and repeated doc_ids are kept as they are; a null doc_id sorts first.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, parallelism, shared_path, sliced
from .tokens import encoder

MAGIC = b"LOOMBP01"
BLOCK_IDS = 1 << 16
NULL_ID = np.iinfo(np.int64).min


def _planes(ids: np.ndarray, bits: bool) -> np.ndarray:
    """Planes by rows: 4 of bytes, or 32 of bits (eight ids in a byte)."""
    by_byte = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if not bits:
        return by_byte
    pad = np.zeros((4, -len(ids) % 8), np.uint8)
    spread = np.unpackbits(np.hstack([by_byte, pad])[:, :, None], axis=2, bitorder="little")
    return np.packbits(spread.transpose(0, 2, 1).reshape(32, -1), axis=1, bitorder="little")


def _ids(planes: np.ndarray, n: int, bits: bool) -> np.ndarray:
    if bits:
        spread = np.unpackbits(planes, axis=1, bitorder="little").reshape(4, 8, -1)
        planes = np.packbits(spread.transpose(0, 2, 1), axis=2, bitorder="little")[:, :, 0]
    return np.ascontiguousarray(planes[:, :n].T).view("<u4").ravel()


class ShardWriter:
    """Writes one shard to a binary file object; holds one block and the index."""

    def __init__(self, out, bits: bool = False, block_ids: int = BLOCK_IDS, level: int = 3) -> None:
        import zstandard

        self._zstd = zstandard.ZstdCompressor(level=level)
        self._out, self._bits, self._size = out, bits, block_ids
        self._at = out.write(MAGIC)
        self._part, self._n = [], 0
        self._blocks: list[tuple[int, int, list[int]]] = []
        self._docs: list[tuple[int, int]] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self._docs.append((doc_id, len(ids)))
        while len(ids):
            take = ids[: self._size - self._n]
            self._part.append(take)
            self._n += len(take)
            ids = ids[len(take) :]
            if self._n == self._size:
                self._flush()

    def _flush(self) -> None:
        if not self._n:
            return
        lengths, start = [], self._at
        for plane in _planes(np.concatenate(self._part), self._bits):
            packed = self._zstd.compress(plane.tobytes()) if plane.any() else b""
            self._at += self._out.write(packed)
            lengths.append(len(packed))
        self._blocks.append((start, self._n, lengths))
        self._part, self._n = [], 0

    def close(self) -> int:
        """Writes the index; gives the number of ids."""
        self._flush()
        index = io.BytesIO()
        index.write(np.array([int(self._bits), self._size, len(self._blocks), len(self._docs)], "<i8").tobytes())
        for start, n, lengths in self._blocks:
            index.write(np.array([start, n, *lengths], "<i8").tobytes())
        index.write(np.array(self._docs, "<i8").reshape(-1, 2).tobytes())
        packed = self._zstd.compress(index.getvalue())
        self._out.write(packed + len(packed).to_bytes(8, "little") + MAGIC)
        return sum(n for _, n in self._docs)


class ShardReader:
    """Reads a shard from a seekable file object, any range of ids or document by document."""

    def __init__(self, source) -> None:
        import zstandard

        self._zstd = zstandard.ZstdDecompressor()
        self._in = source
        size = source.seek(0, io.SEEK_END)
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token-id shard")
        n = int.from_bytes(tail[:8], "little")
        source.seek(size - 16 - n)
        index = np.frombuffer(self._zstd.decompress(source.read(n)), "<i8")
        self._bits, self.block_ids, blocks, docs = bool(index[0]), int(index[1]), int(index[2]), int(index[3])
        wide = 2 + (32 if self._bits else 4)
        self._blocks = index[4 : 4 + blocks * wide].reshape(blocks, wide)
        self.doc_ids, self.doc_tokens = index[4 + blocks * wide :].reshape(docs, 2).T

    def block(self, k: int) -> np.ndarray:
        at, n, *lengths = self._blocks[k].tolist()
        wide = -(-n // 8) if self._bits else n
        planes = np.zeros((len(lengths), wide), np.uint8)
        self._in.seek(at)
        for row, length in enumerate(lengths):
            if length:
                planes[row] = np.frombuffer(self._zstd.decompress(self._in.read(length), max_output_size=wide), np.uint8)
        return _ids(planes, n, self._bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """A range of the shard's ids, by the blocks it lies in."""
        parts = [self.block(k)[max(0, start - k * self.block_ids) : stop - k * self.block_ids] for k in range(start // self.block_ids, -(-stop // self.block_ids))]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, ids before it in the shard, ids) in order, holding a block and a document."""
        at, k, rest = 0, 0, np.zeros(0, "<u4")
        for doc_id, n in zip(self.doc_ids.tolist(), self.doc_tokens.tolist(), strict=True):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            joined = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc_id, at, joined[:n]
            rest = joined[n:]
            at += n


@dataclass(frozen=True)
class Shards:
    """Written shards: `manifest` has by shard its path, documents, ids, and ids before it."""

    folder: str
    manifest: DataFrame


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return system, path


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = 2, bits: bool = False, folder: str | None = None, shards: int | None = None) -> Shards:
    """Tokenises whole texts and writes shards in ascending doc_id order.

    A range shuffle deals documents; each task writes its shard under a name of its own and
    renames it when whole, so a repeated task replaces it by the same bytes.  The driver gets
    one row for each shard.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-shards")
    if "://" not in folder:
        folder = f"file://{folder}"
    shards = shards or parallelism(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        enc = encoder(vocabulary)
        name = f"{folder}/shard-{context.partitionId():06d}.bp"
        system, path = _open(name)
        out = writer = None
        for batch in sliced(batches, "text", 2 << 20):
            if writer is None:
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(f"{path}.{context.taskAttemptId()}")
                writer = ShardWriter(out, bits)
            ids, first = enc.encode_ended(column(batch, "text"), end_id)
            for doc_id, a, b in zip(column(batch, "doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                writer.add(NULL_ID if doc_id is None else doc_id, ids[a:b])
        if writer is not None:
            n = writer.close()
            out.close()
            system.move(f"{path}.{context.taskAttemptId()}", path)
            yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "path": [name], "n_ids": [n]})

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    done = sorted(ordered.mapInArrow(write, "shard long, path string, n_ids long").collect())
    before, rows = 0, []
    for shard, path, n in done:
        rows.append((shard, path, n, before))
        before += n
    return Shards(folder, spark.createDataFrame(rows, "shard long, path string, n_ids long, ids_before long"))


def read_shards(shards: Shards) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document, read
    back from the files; a task holds a block, a document and a small batch."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, before in zip(batch.path, batch.ids_before, strict=True):
                system, inner = _open(path)
                with system.open_input_file(inner) as source:
                    rows, held = [], 0
                    for doc_id, at, ids in ShardReader(source).documents():
                        rows.append((None if doc_id == NULL_ID else doc_id, before + at, len(ids), ids.tobytes()))
                        held += len(ids)
                        if held > 1 << 20:
                            yield _frame(rows)
                            rows, held = [], 0
                    if rows:
                        yield _frame(rows)

    spread = shards.manifest.repartition(parallelism(shards.manifest.sparkSession), "shard")
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])
    return out.astype({"doc_id": "Int64"})

