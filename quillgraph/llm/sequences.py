"""Training sequences as Arrow files: token ids in fixed-size lists of equal length, with masks, for random access.

Documents are sorted in ranges of their ids. Each task encodes its range and writes one shard of two files in Arrow's
file format (a stream with a footer): the sequences, as batches of fixed-size lists of ids and of a mask that is false on
the padding at the shard's end, uncompressed, so that a reader maps a file into memory and takes any sequence as a view;
and the index, a row for each document with its place in the shard. A document may go over from one sequence to the next.

Files are named for the attempt that wrote them, and the manifest, a Parquet table written when all tasks are done,
names those that count: what a lost executor left behind is not read. Ids take two bytes where the vocabulary allows it.

Cost: one shuffle of the texts; a task holds one batch of sequences and one chunk of texts.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import text as T
from quillgraph.llm.tokens import PRETOKEN, PRINTED

# Letters, digits and white space below U+0250, for the same pre-tokens as PRETOKEN gives.
_LETTERS, _DIGITS, _WHITE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_LATIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_WHITE}{_LETTERS}{_DIGITS}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_BEYOND = re.compile("[^\0-ɏ]")
_KEEP_LENGTH, _KEEP_MANY = 64, 400_000
_INDEX_ROWS = 10_000


class _Known(dict):
    """Ids (as bytes) of pre-tokens: the library's model is asked for those not met before. Up to a bound they are kept."""

    def __init__(self, model, kind: str):
        super().__init__()
        self.model, self.kind = model, kind
        printed, rest = set(PRINTED), iter(range(256, 512))
        self.letters = {b: b if b in printed else next(rest) for b in range(256)}

    def __missing__(self, part: str) -> bytes:
        found = self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
        ids = array(self.kind, [t.id for t in found]).tobytes()
        if len(self) < _KEEP_MANY and len(part) <= _KEEP_LENGTH:
            self[part] = ids
        return ids


class Encoder:
    """Ids of a text, as the tokenizers library gives them for a vocabulary file, with nothing added. Byte-level BPE is cut
    into pre-tokens here, each of which the library encodes once; texts with special strings, and all texts where a file
    asks for anything else, go to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.known = _Known(self.library.model, self.kind) if self._plain() else None
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.other = regex.compile(PRETOKEN)

    def _plain(self) -> bool:
        """Whether the file is a byte-level BPE and no more than that."""
        pre, model = self.library.pre_tokenizer, self.library.model
        return (
            type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and self.library.normalizer is None and type(model).__name__ == "BPE"
            and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix or model.byte_fallback)
        )

    def __call__(self, text: str) -> bytes:
        if self.known is None or self.added is not None and self.added.search(text):
            return array(self.kind, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        cut = _LATIN if text.isascii() or not _BEYOND.search(text) else self.other
        return b"".join(map(self.known.__getitem__, cut.findall(text)))


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if re.match(r"\w[\w+.-]+:", folder):
        return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
    return pyarrow.fs.LocalFileSystem(), folder


class _Shard:
    """Writes one shard."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, id_type: pa.DataType, length: int, rows: int):
        fs, root = _place(folder)
        fs.create_dir(root, recursive=True)
        ids = pa.from_numpy_dtype(dtype)
        self.dtype, self.length, self.rows = dtype, length, rows
        self.schema = pa.schema([("ids", pa.list_(pa.field("item", ids, nullable=False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length))])
        self.index_schema = pa.schema([("id", id_type), ("start", pa.int64()), ("n", pa.int64())])
        self.streams = [fs.open_output_stream(f"{root}/{name}.{what}.arrow") for what in ("sequences", "index")]
        self.sequences, self.index = (pa.ipc.new_file(s, k) for s, k in zip(self.streams, (self.schema, self.index_schema), strict=True))
        self.waiting = bytearray()
        self.entries: list[tuple] = []
        self.documents = self.ids = self.made = 0

    def add(self, key: pa.Scalar, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.entries.append((key, self.ids, n))
        self.documents += 1
        self.ids += n
        self.waiting += ids
        if len(self.entries) == _INDEX_ROWS:
            self._index()
        size = self.length * self.rows * self.dtype.itemsize
        while len(self.waiting) >= size:
            self._batch(np.frombuffer(bytes(self.waiting[:size]), self.dtype), self.length * self.rows)
            del self.waiting[:size]

    def _index(self) -> None:
        keys, starts, lengths = zip(*self.entries, strict=True)
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(list(keys), self.index_schema[0].type), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], schema=self.index_schema))
        self.entries = []

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), self.schema, strict=True)]
        self.sequences.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.made += len(ids) // self.length

    def close(self) -> tuple[int, int, int]:
        if self.entries:
            self._index()
        if self.waiting:
            rest = np.frombuffer(bytes(self.waiting), self.dtype)
            ids = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            ids[: len(rest)] = rest
            self._batch(ids, len(rest))
        for x in (self.sequences, self.index, *self.streams):
            x.close()
        return self.documents, self.ids, self.made


class ShardReader:
    """Random access to one shard. Where its files are local they are mapped, and what is returned are views of them."""

    def __init__(self, folder: str, name: str):
        fs, root = _place(folder)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        files = [f"{root}/{name}.{what}.arrow" for what in ("sequences", "index")]
        self.sequences, self.index = (pa.ipc.open_file(pa.memory_map(f) if local else fs.open_input_file(f)) for f in files)
        self.length = self.sequences.schema.field("ids").type.list_size
        self.batches = self.sequences.num_record_batches
        self.rows = self.sequences.get_batch(0).num_rows if self.batches else 1
        self.last: tuple[int, pa.RecordBatch] | None = None

    def __len__(self) -> int:
        return (self.batches - 1) * self.rows + self._get(self.batches - 1).num_rows if self.batches else 0

    def _get(self, k: int) -> pa.RecordBatch:
        if self.last is None or self.last[0] != k:
            self.last = (k, self.sequences.get_batch(k))
        return self.last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence i."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch = self._get(i // self.rows)
        ids, mask = (batch.column(c)[i % self.rows].values for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def tokens(self, start: int, n: int) -> np.ndarray:
        """The ids from `start` on, over as many sequences as they take."""
        each, parts = self.rows * self.length, []
        while n:
            k, at = divmod(start, each)
            flat = self._get(k).column(0).values.to_numpy(zero_copy_only=True)
            parts.append(flat[at : at + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def documents(self) -> Iterator[pa.RecordBatch]:
        """Batches of the index: id, start, n."""
        return map(self.index.get_batch, range(self.index.num_record_batches))


_MANIFEST = "shard int, name string, n_docs long, n_ids long, n_sequences long"


def write_sequences(docs: DataFrame, folder: str, vocabulary: str, end: int | None = 2, length: int = 1024, rows: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs to a new `folder` that all executors reach, in ascending order of id (nulls first; rows of one id by a
    hash of their text), each followed by the id `end` if given. Returns the manifest: a row for each shard, with `before`,
    the ids in all shards before it. `vocabulary`: path, on every executor, of a file of the tokenizers library; `length`:
    ids of a sequence; `rows`: sequences of a batch.

    Null texts are empty (and have the end id alone), repeated rows are written each, other columns are ignored; no
    documents give a manifest without rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    keys = ["_id", "_hash", "_row"]
    dealt = source.select("*", F.xxhash64("_text").alias("_hash"), F.monotonically_increasing_id().alias("_row")).repartitionByRange(*keys).sortWithinPartitions(*keys).select("_id", "_text")

    def write(batches):
        encode = _encoder(vocabulary)
        tail = array(encode.kind, [] if end is None else [end]).tobytes()
        shard, name, out = TaskContext.get().partitionId(), "", None
        for batch in batches:
            for c in T.chunks(batch.column(1)):
                if out is None:
                    name = f"{shard:06d}-{uuid.uuid4().hex[:12]}"
                    out = _Shard(folder, name, encode.dtype, batch.schema.field(0).type, length, rows)
                for i in range(c.rows):
                    out.add(batch.column(0)[c.first + i], encode(c.text(i)) + tail)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((shard, name, *out.close()), (pa.int32(), pa.string(), *[pa.int64()] * 3), strict=True)], names=["shard", "name", "n_docs", "n_ids", "n_sequences"])

    dealt.mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards in order, a row each; `before` sums over these few rows."""
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").withColumn("before", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))


def read_documents(spark: SparkSession, folder: str, id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """One row for each document of the files in `folder`: id, start (ids of all documents before it), n_tokens, and
    ids_crc32 (the CRC-32 of its ids, as little-endian unsigned 32-bit integers). A task reads one shard at a time."""
    shards = manifest(spark, folder)
    spread = shards.select("name", "before").repartition(max(1, min(shards.count(), 10_000)))

    def read(batches):
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = ShardReader(folder, name)
                for docs in shard.documents():
                    start, n = (docs.column(c).to_numpy() for c in (1, 2))
                    crc = [zlib.crc32(shard.tokens(s, k).astype("<u4")) for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(start + before), docs.column(2), pa.array(crc, pa.int64())], names=["_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(read, f"_id {id_type}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("_id", id_col)
