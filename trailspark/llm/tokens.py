"""Token-id output: Arrow stream files of fixed-size-list batches.

Documents are tokenized where they are read; only their ids are dealt, by ranges
of ``doc_id`` (then a hash, then a row number, so that equal ids, null among them,
can be split), and written in ascending order. Each range is a sequence of shard
files in the shared folder, begun anew after ``shard_bytes`` of ids at a
document's end. A shard is an Arrow stream whose batches hold ``ids`` (fixed-size
list of 16- or 32-bit unsigned integers, by the vocabulary's size), ``mask`` and
``ends`` (fixed-size lists of bits: false on padding; true on a document's last
id) and ``docs`` (ids of the documents that end in the sequence). Sequences have
equal length, so sequence n of a memory mapped shard is a slice of one buffer: no
parsing, no copy. Shards are written under a name of their own and renamed, so a
lost or repeated task leaves one complete file.

A file tells all of its documents: ``read_back`` reads nothing else but the list
of shards, and finds global starts from the files' own totals, by sums within and
over the ranges.

The default tokenizer drops white space and lower-cases before it splits, so no
token spans a white space and equal pieces have equal ids; each worker encodes a
piece once and gathers the ids of known pieces with array operations. Tokenizers
that normalise or split otherwise encode whole texts.

Defined results: a null or empty text is the end id alone; null ids come first;
rows of equal id are ordered by a hash of their ids; an empty table gives no
shard; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch, new_path
from ._text import _LOWER, chunks, column_bytes, word_hashes

VOCABULARY = "word_bpe_49k.json"
END = 2
LENGTH = 2048
BATCH = 64
#: Known pieces a worker keeps.
PIECES = 1_500_000
#: Bytes of ids after which a shard ends with its document.
SHARD_BYTES = 16 << 20
#: Ranges of documents, each written by one task.
RANGES = 8192
#: Ids are dealt in so many rounds of ascending documents, which bounds what lies in shuffle files at a time.
ROUNDS = 2
#: How the default vocabulary normalises and splits (fixed values); only such texts may be cut into pieces.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Classes of bytes: 0 white space, 1 ASCII letter, 2 digit, 3 other ASCII, 4 apostrophe and non-ASCII.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x80:] = _CLASS[0x27] = 4


def pieces(data: np.ndarray, off: np.ndarray, fine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first piece of each row): runs without white space; fine: also cut where ASCII letters, digits and signs meet.

    The vocabulary's splitter always cuts there: no token of its pattern holds a
    letter, digit or sign beside another kind, but contractions, which begin
    with an apostrophe.
    """
    kind = _CLASS[data]
    n = len(data)
    inside = kind > 0
    begin, end = inside.copy(), inside.copy()
    if n:
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        if fine:
            cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] < 4) & (kind[:-1] < 4) & inside[1:] & inside[:-1]) + 1
            begin[cut] = True
            end[cut - 1] = True
        edge = off[(off > 0) & (off < n)]
        begin[edge] = inside[edge]
        end[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


class Encoder:
    """Ids of a column of texts; a piece is encoded once and remembered by its 64-bit hash (at PIECES pieces, two share one with a chance below 10^-7)."""

    def __init__(self, path: str, end: int = END):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.end = end
        told = json.loads(self.tokenizer.to_str())
        self.cuts = (told["normalizer"], told["pre_tokenizer"]) == (NORMALIZER, SPLITTER)
        self._forget()

    def _forget(self) -> None:
        # entry 0 is the end id
        self.keys, self.entries = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.size, self.ids = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.end], self.kind)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        got = [e.ids for e in batch(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for g in got for i in g), self.kind, int(size.sum()))
        first = len(self.at)
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, flat])
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.entries = np.insert(self.entries, place, np.arange(first, first + len(keys)))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows with the end id after each, counts)."""
        if not self.cuts:
            batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
            got = [[*e.ids, self.end] for e in batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.fromiter((i for g in got for i in g), self.kind, sum(map(len, got))), np.fromiter(map(len, got), np.int64, len(got))
        data, off = column_bytes(column)
        # special strings are found in the text as it stands, so such chunks are neither lower-cased nor cut
        fine = not ((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any()
        if fine:
            data = _LOWER[data]
        starts, ends, rows = pieces(data, off, fine)
        keys, first, of = np.unique(word_hashes(data, starts, ends) ^ np.uint64(0 if fine else 0x5BD1E995), return_index=True, return_inverse=True)
        if len(self.keys) > PIECES:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        low = place < len(self.keys)
        known[low] = self.keys[place[low]] == keys[low]
        if (new := np.flatnonzero(~known)).size:
            raw = data.tobytes()
            self._learn(keys[new], [raw[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            place = np.searchsorted(self.keys, keys)
        entry = np.insert(self.entries[place][of] if len(keys) else np.zeros(0, np.int64), rows[1:], 0)
        size = self.size[entry]
        stop = np.cumsum(size)
        where = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.at[entry] - stop + size, size)
        counts = np.diff(np.append(0, stop[rows[1:] + np.arange(len(rows) - 1)]))
        return self.ids[where], counts


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder_for(path: str, end: int = END) -> Encoder:
    """A worker's encoder, which lasts for its tasks."""
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


def schema(kind: np.dtype, length: int) -> pa.Schema:
    bits = pa.list_(pa.bool_(), length)
    return pa.schema([("ids", pa.list_(pa.uint16() if kind.itemsize == 2 else pa.uint32(), length)), ("mask", bits), ("ends", bits), ("docs", pa.list_(pa.int64()))])


def _bits(x: np.ndarray, length: int) -> pa.FixedSizeListArray:
    return pa.FixedSizeListArray.from_arrays(pa.Array.from_buffers(pa.bool_(), len(x), [None, pa.py_buffer(np.packbits(x, bitorder="little").tobytes())]), length)


class ShardWriter:
    """Packs documents into sequences; the last one is padded."""

    def __init__(self, sink, kind: np.dtype, length: int = LENGTH, batch: int = BATCH):
        self.kind, self.length, self.size = kind, length, batch * length
        self.schema = schema(kind, length)
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.held = bytearray()
        #: Ends (exclusive) and ids of the documents held, counted from the first id held.
        self.ends: list[int] = []
        self.docs: list[int | None] = []
        self.count = self.documents = 0

    def add(self, ids: bytes, doc: int | None) -> None:
        """One whole document."""
        self.held += ids
        self.ends.append(len(self.held) // self.kind.itemsize)
        self.docs.append(doc)
        self.count += len(ids) // self.kind.itemsize
        self.documents += 1
        if len(self.held) >= self.size * self.kind.itemsize:
            whole = len(self.held) // self.kind.itemsize // self.size * self.size
            data = np.frombuffer(bytes(self.held[: whole * self.kind.itemsize]), self.kind)
            del self.held[: whole * self.kind.itemsize]
            self._write(data, whole)

    def _write(self, ids: np.ndarray, real: int) -> None:
        done = sum(1 for e in self.ends if e <= len(ids))
        ends = np.array(self.ends[:done], dtype=np.int64) - 1
        for s in range(0, len(ids), self.size):
            part = ids[s : s + self.size]
            own = (ends >= s) & (ends < s + len(part))
            flags = np.zeros(len(part), bool)
            flags[ends[own] - s] = True
            lists = np.searchsorted(ends[own] - s, np.arange(0, len(part) + 1, self.length))
            docs = pa.array([d for d, o in zip(self.docs[:done], own.tolist(), strict=True) if o], pa.int64())
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(part.astype(self.kind.newbyteorder("="))), self.length), _bits(np.arange(s, s + len(part)) < real, self.length), _bits(flags, self.length), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), docs)], schema=self.schema))
        self.ends, self.docs = [e - len(ids) for e in self.ends[done:]], self.docs[done:]

    def close(self) -> None:
        rest = np.frombuffer(bytes(self.held), self.kind)
        if len(rest):
            whole = -(-len(rest) // self.length) * self.length
            self._write(np.concatenate([rest, np.zeros(whole - len(rest), self.kind)]), len(rest))
        self.out.close()


class Shard:
    """Zero-copy random access to a shard."""

    def __init__(self, source):
        self.batches = list(pa.ipc.open_stream(source))
        self.flat = [b.column(0).values.to_numpy(zero_copy_only=True) if b.num_rows else np.zeros(0) for b in self.batches]
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in self.flat])]).astype(np.int64)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the shard; a view where they lie in one batch."""
        first = int(np.searchsorted(self.starts, start, "right")) - 1
        parts = []
        while n > 0:
            at = start - int(self.starts[first])
            part = self.flat[first][at : at + n]
            parts.append(part)
            start, n, first = start + len(part), n - len(part), first + 1
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def sequence(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence n."""
        for b in self.batches:
            if n < b.num_rows:
                length = b.schema.field(0).type.list_size
                mask = b.column(1).slice(n, 1).flatten().to_numpy(zero_copy_only=False)
                return b.column(0).values.to_numpy(zero_copy_only=True)[(b.column(0).offset + n) * length :][:length], mask
            n -= b.num_rows
        raise IndexError(n)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def open_shard(path: str) -> Shard:
    fs, local = _open(path)
    return Shard(pa.memory_map(local) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(local))


def write(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, length: int = LENGTH, end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all documents; returns the shards: part (range), shard, path, n_docs, n_tokens."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    folder = folder or new_path(spark, "tokens")
    fs, local = _open(folder)
    fs.create_dir(local, recursive=True)
    vocabulary = vocabulary or vocabulary_path()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = scratch.table(d.mapInArrow(_encoded(vocabulary, end), "doc_id long, ids binary").select("*", F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("row")), "encoded")
    total = int(encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0)
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc(), F.col("row").asc()]
    edges = sorted(set(encoded.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / ROUNDS for i in range(1, ROUNDS)], 1000).alias("q")).first()["q"] or []))
    id_, shards = F.col("doc_id"), None
    for i, (low, high) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        below = F.lit(True) if high is None else id_ <= high
        part = encoded.where(below | id_.isNull() if low is None else below & (id_ > low))
        dealt = part.repartitionByRange(min(RANGES, max(1, -(-total // shard_bytes // ROUNDS))), *order).sortWithinPartitions(*order)
        made = scratch.table(dealt.select("doc_id", "ids").mapInArrow(_writer(folder, vocabulary, end, length, shard_bytes, i * RANGES), _SHARDS), f"shards{i}")
        shards = made if shards is None else shards.unionByName(made)
    scratch.drop("encoded")
    return shards


_SHARDS = "part int, shard int, path string, n_docs long, n_tokens long"


def _encoded(vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]):
        encoder = encoder_for(vocabulary, end)
        for b in chunks(batches, "text"):
            ids, n = encoder.encode(b.column("text"))
            at = np.append(0, np.cumsum(n)) * encoder.kind.itemsize
            data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), data], names=["doc_id", "ids"])

    return run


def _writer(folder: str, vocabulary: str, end: int, length: int, shard_bytes: int, first: int):
    def run(batches: Iterator[pa.RecordBatch]):
        part = first + TaskContext.get().partitionId()
        fs, local = _open(folder)
        kind = encoder_for(vocabulary, end).kind
        shard, writer, sink, own = 0, None, None, ""

        def finish():
            writer.close()
            sink.close()
            name = f"part-{part:05d}-{shard:05d}.arrows"
            fs.move(own, f"{local}/{name}")
            cols = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([writer.documents], pa.int64()), pa.array([writer.count], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "shard", "path", "n_docs", "n_tokens"])

        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                if writer is None:
                    own = f"{local}/_{uuid.uuid4().hex}"
                    sink = fs.open_output_stream(own)
                    writer = ShardWriter(sink, kind, length)
                writer.add(ids.as_py(), doc)
                if writer.count * kind.itemsize >= shard_bytes:
                    yield finish()
                    shard, writer = shard + 1, None
        if writer is not None:
            yield finish()

    return run


def documents(path: str) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, place, n_tokens, crc32) of a shard's documents, read batch by batch."""
    fs, local = _open(path)
    place = n = crc = 0
    with fs.open_input_stream(local) as f:
        for b in pa.ipc.open_stream(f):
            real = int(b.column("mask").values.true_count)
            ids = b.column("ids").values.to_numpy(zero_copy_only=True)[:real].astype("<u4")
            stops = np.flatnonzero(b.column("ends").values.to_numpy(zero_copy_only=False)[:real]) + 1
            at = 0
            for stop, doc in zip(stops.tolist(), b.column("docs").values.to_pylist(), strict=True):
                crc, n, at = zlib.crc32(ids[at:stop], crc), n + stop - at, stop
                yield doc, place, n, crc
                place, n, crc = place + n, 0, 0
            if at < real:
                crc, n = zlib.crc32(ids[at:], crc), n + real - at


def read_back(shards: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""
    scratch = Scratch(shards.sparkSession, "read")

    def run(batches):
        names = ["part", "shard", "doc_id", "place", "n_tokens", "ids_crc32"]
        for b in batches:
            for part, shard, path in zip(*(b.column(c).to_pylist() for c in ("part", "shard", "path")), strict=True):
                doc, place, n, crc = (list(x) for x in zip(*documents(path), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(doc), pa.int32()), pa.array([shard] * len(doc), pa.int32()), *[pa.array(x, pa.int64()) for x in (doc, place, n, crc)]], names=names)

    files = max(1, min(RANGES, shards.count()))
    found = scratch.table(shards.repartition(files, "part", "shard").select("part", "shard", "path").mapInArrow(run, "part int, shard int, doc_id long, place long, n_tokens long, ids_crc32 long"), "documents")
    totals = scratch.table(found.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n")), "totals")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # one row a range, ROUNDS * RANGES at most
    ranges = totals.groupBy("part").agg(F.sum("n").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("base"))
    own = totals.select(F.col("part").alias("q"), F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy("shard")), F.lit(0)).alias("within"))
    offsets = own.join(ranges, F.col("q") == F.col("p")).select("q", "s", (F.col("base") + F.col("within")).alias("offset"))
    return found.join(offsets, (F.col("part") == F.col("q")) & (F.col("shard") == F.col("s"))).select("doc_id", (F.col("offset") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
