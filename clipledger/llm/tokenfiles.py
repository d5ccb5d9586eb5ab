"""Token-id files: ids of many documents in a row, with Elias-Fano coded boundaries.

A shard file, all numbers little-endian:

    ids      n_ids ids of ``width`` bytes each (2 if the vocabulary allows, else 4)
    bounds   Elias-Fano of the n_docs + 1 offsets 0 = b[0] <= ... <= b[n_docs] = n_ids
    doc ids  Elias-Fano of the ids that are not null, less the first of them; documents with a null id come first
    footer   9 numbers of 8 bytes: magic, width, n_docs, n_ids, first id, where bounds begin, where doc ids begin, their
             end, documents with a null id

An Elias-Fano part: count, upper bound, low bits l (3 numbers of 8 bytes); the count's low bits of l bits each, packed;
the high parts in unary (bit (value >> l) + i is set for value i); for select, the 4-byte position of every 512th set bit.
That is about 2 + log2(n_ids / n_docs) bits a document, and a sixteenth of a bit for select; no table of 8-byte offsets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.common import dealt_in_order, pick
from clipledger.llm.tokens import encoder
from clipledger.session import checkpoint_folder, settle

MAGIC, SAMPLE = 0x325344494B4F54, 512
SHARD = "shard int, file string, n_docs long, n_ids long"
#: Ids that a reader holds at once, about; a longer document is held whole.
CHUNK = 1 << 21


def elias_fano(values: np.ndarray, top: int) -> bytes:
    """Code ascending numbers in 0..top."""
    v, n = values.astype(np.uint64), len(values)
    low = max(0, int(top // max(n, 1)).bit_length() - 1)
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    high = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    size = -(-((int(top) >> low) + n + 1) // 64) * 64
    if size >= 1 << 32:
        raise ValueError("too many documents for one shard file")
    unary = np.zeros(size, dtype=np.uint8)
    unary[high] = 1
    head = np.array([n, top, low], dtype="<u8").tobytes()
    return head + np.packbits(bits.reshape(-1), bitorder="little").tobytes() + np.packbits(unary, bitorder="little").tobytes() + high[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    """Reads a coded part in place: ``select(i)`` touches one sample, a few 8-byte blocks and one low part."""

    def __init__(self, data: bytes):
        self.n, self.top, self.low = (int(x) for x in np.frombuffer(data, "<u8", 3))
        at, size = 24, (self.n * self.low + 7) // 8
        self.lows = np.frombuffer(data, np.uint8, size, at)
        blocks = -(-((self.top >> self.low) + self.n + 1) // 64)
        self.unary = np.frombuffer(data, "<u8", blocks, at + size)
        self.samples = np.frombuffer(data, "<u4", -(-self.n // SAMPLE), at + size + 8 * blocks)

    def _low(self, i: np.ndarray) -> np.ndarray:
        out, bit = np.zeros(len(i), dtype=np.int64), i * self.low
        for k in range(self.low):
            at = bit + k
            out |= ((self.lows[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << k
        return out

    def position(self, i: int) -> int:
        """Where the i-th set bit of the unary part stands."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, rest = int(self.samples[i // SAMPLE]), i % SAMPLE
        block, word = at >> 6, int(self.unary[at >> 6]) >> (at & 63) << (at & 63)
        while word.bit_count() <= rest:
            rest -= word.bit_count()
            block += 1
            word = int(self.unary[block])
        for _ in range(rest):
            word &= word - 1
        return block * 64 + (word & -word).bit_length() - 1

    def select(self, i: int) -> int:
        """The i-th value."""
        return (self.position(i) - i << self.low) | int(self._low(np.array([i], dtype=np.int64))[0])

    def values(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1."""
        if a >= b:
            return np.zeros(0, dtype=np.int64)
        first, last = self.position(a), self.position(b - 1)
        bits = np.unpackbits(self.unary[first >> 6 : (last >> 6) + 1].view(np.uint8), bitorder="little")
        set_ = np.flatnonzero(bits[first & 63 :])[: b - a] + first
        i = np.arange(a, b)
        return (set_ - i << self.low) | self._low(i)


def _open(folder: str):
    from pyarrow import fs

    folder = "file:///" + folder.removeprefix("file:").lstrip("/") if folder.startswith(("file:", "/")) else folder
    return fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, null_ids: bool = False) -> DataFrame:
    """Encode whole texts and write their ids, each document followed by ``end_id``, in ascending id order, as shard
    files in ``folder``, which driver and executors share (any store that pyarrow reaches). Returns the manifest, also
    kept as Parquet in ``folder``: ``shard`` (ascending in id), ``file``, ``n_docs``, ``n_ids``.

    Texts are range-partitioned by id in one shuffle; each task streams one shard to a file named anew in each attempt,
    and only files that the manifest names count, so retries and lost executors leave no wrong rows.

    Null and empty texts: the end id alone. Equal ids stand in the order of their texts. Null ids come first
    with ``null_ids``, and are refused without. Empty table: a manifest without rows. Other columns of ``docs`` play no part.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        width = 2 if max(enc.whole.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        names, sizes, nulls, sink = [], [], 0, None
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"

        for b in batches:
            if not b.num_rows:
                continue
            if sink is None:
                store, path = _open(folder)
                store.create_dir(path, recursive=True)
                sink = store.open_output_stream(f"{path}/{name}")
            names.append(b.column(0).drop_null().to_numpy())
            nulls += b.column(0).null_count
            for _, ids, cuts in enc.encode(b.column(1), end_id):
                sink.write(ids.astype(f"<u{width}").tobytes())
                sizes.append(np.diff(cuts))
        if sink is None:
            return
        keys, bounds = np.concatenate(names), np.append(0, np.cumsum(np.concatenate(sizes)))
        n = int(bounds[-1])
        coded = elias_fano(bounds, n)
        base, last = (int(keys[0]), int(keys[-1])) if len(keys) else (0, 0)
        named = elias_fano((keys.astype(np.uint64) - np.uint64(base % (1 << 64))), last - base)
        at = n * width
        sink.write(coded + named + np.array([MAGIC, width, len(bounds) - 1, n, base % (1 << 64), at, at + len(coded), at + len(coded) + len(named), nulls], dtype="<u8").tobytes())
        sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([len(bounds) - 1], pa.int64()), pa.array([n], pa.int64())], names=["shard", "file", "n_docs", "n_ids"])

    rows = pick(docs, id=id_col, text=text_col)
    own = F.col("id").cast("long")
    rows = rows.select((own if null_ids else F.coalesce(own, F.raise_error(F.lit("a null id is refused")))).alias("id"), "text")
    dealt_in_order(rows, "id", "text").mapInArrow(write, SHARD).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(SHARD).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of token files: ``id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids``
    (little-endian unsigned 32-bit). One task reads one shard, a stretch of it at a time; offsets come from select."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            store, path = _open(folder)
            with store.open_input_file(f"{path}/{row['file']}") as f:
                foot = np.frombuffer(f.read_at(72, f.size() - 72), "<u8")
                magic, width, n_docs, _, base, at, named, end, nulls = (int(x) for x in foot)
                if magic != MAGIC:
                    raise ValueError(f"{row['file']} is no token file")
                bounds, keys = EliasFano(f.read_at(named - at, at)), EliasFano(f.read_at(end - named, named))
                i = 0
                while i < n_docs:
                    lo, j = bounds.select(i), i + 1
                    step = max(1, min(4096, n_docs - i))
                    offsets = bounds.values(i, i + step + 1)
                    j = i + max(1, int(np.searchsorted(offsets - lo, CHUNK, side="right")) - 1)
                    j = min(j, i + step)
                    offsets = offsets[: j - i + 1]
                    raw = np.frombuffer(f.read_at(int(offsets[-1] - lo) * width, lo * width), f"<u{width}").astype("<u4").tobytes()
                    cuts = ((offsets - lo) * 4).tolist()
                    ids = (keys.values(max(i - nulls, 0), max(j - nulls, 0)).astype(np.uint64) + np.uint64(base)).view(np.int64)
                    ids = pa.concat_arrays([pa.nulls(j - i - len(ids), pa.int64()), pa.array(ids, pa.int64())])
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(offsets[:-1] + row["base"]), pa.array(np.diff(offsets)), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())],
                        names=["id", "start", "n_tokens", "ids"],
                    )
                    i = j

    # a row for each shard: few, and the only thing that is ordered as a whole
    placed = settle(manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")))
    shards = placed.agg(F.max("shard")).first()[0]
    return placed.repartitionById((0 if shards is None else shards) + 1, "shard").mapInArrow(read, "id long, start long, n_tokens long, ids binary")


def token_folder(spark, name: str = "tokens") -> str:
    """A new folder for token files in the application's shared folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
