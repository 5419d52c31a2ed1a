"""Raw records of input files: (record_no, raw) or an error.

NDJSON is split by Spark; record numbers come from counts of each split. JSON
arrays, CSV and event logs need their file's start, so one task reads one file;
many files are read by many tasks, and once more before that to count their records.
Arrays and CSV are decoded as they stream in, so a task holds a few records of its file.
"""

from __future__ import annotations

import codecs
import csv
import gzip
import io
import itertools
import json
import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import jsontext

MAX_INPUT = 2 << 30
MAX_EVENT = 4 << 20
FORMATS = ("auto", "json", "csv", "evtx")
#: Records, and characters of them, from which a batch is full.
_BATCH, _BATCH_TEXT = 512, 4 << 20
#: Bytes that are decoded at a time.
_BLOCK = 1 << 20
#: A file is read in pieces that end with this letter: every record has one, so a piece is no longer than a record.
_ENDS = {"json": "}", "csv": "\n"}
#: What an Arrow batch of long records may hold.
_SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
#: One file a task, whatever its size.
_UNSPLIT = _SMALL | {"spark.sql.files.maxPartitionBytes": 1 << 60, "spark.sql.files.openCostInBytes": 1 << 60, "spark.sql.files.minPartitionNum": 1}
#: What may be the rest of a number that goes on in the next text.
_OPEN = re.compile(r"[-+.\deE]*\Z", re.A)
SCHEMA = "record_no long, raw string, error string"


class InputError(ValueError):
    pass


def detect(path: str, format_: str = "auto") -> str:
    """The format by name or, for auto, by extension."""
    f = (format_ or "auto").strip().lower()
    if f not in FORMATS:
        raise InputError(f"unsupported format {format_!r}")
    if f != "auto":
        return f
    name = path.lower().removesuffix(".gz")
    return "csv" if name.endswith(".csv") else "evtx" if name.endswith(".evtx") else "json"


def first_byte(spark: SparkSession, path: str) -> str:
    """The first character that is not white space."""
    blank = F.trim(F.translate("value", "\t\r\n﻿", "    "))
    row = spark.read.text(path, lineSep=_ENDS["json"]).where(blank != "").select(F.substring(blank, 1, 1)).first()
    return row[0] if row else ""


def expanded_size(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file, packed files expanded; pieces are streamed, so a bomb costs time and no memory."""
    sizes = spark.read.text(path, lineSep=_ENDS["json"]).groupBy("_metadata.file_path").agg(F.sum(F.octet_length("value") + 1).alias("n"))
    return int(sizes.agg(F.max("n")).first()[0] or 0)


def records(spark: SparkSession, path: str, format_: str, limit: int = MAX_INPUT) -> DataFrame:
    if format_ == "json" and first_byte(spark, path) != "[":
        return ndjson(spark, path)
    return _whole_files(spark, path, format_, limit)


def ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order; blank ones do not count."""
    lines = _session(spark, _SMALL).read.text(path).select(F.trim(F.translate("value", "\r\t", "  ")).alias("t"), F.trim(F.rtrim(F.col("value"), F.lit("\r"))).alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # a task reads each of its splits in order, so a line's number in its split is its distance from the split's first line
    lines = lines.where("t <> ''").withColumn("id", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = splits.select(F.col("file").alias("f"), F.col("block").alias("b"), "first", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # one row a split is sent, so at most the input limit over the split size; no line is shuffled
    placed = lines.join(F.broadcast(before), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    return placed.select((F.col("before") + F.col("id") - F.col("first") + 1).cast("long").alias("record_no"), "raw", F.lit(None).cast("string").alias("error"))


def _session(spark: SparkSession, settings: dict[str, int]) -> SparkSession:
    """A copy of the session with settings of its own; the caller's stay as they are."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in settings.items():
        own.conf.set(k, str(v))
    return own


def _whole_files(spark: SparkSession, path: str, format_: str, limit: int) -> DataFrame:
    own = _session(spark, _UNSPLIT)
    named = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")]
    packed = F.lower("_metadata.file_path").endswith(".gz")
    contents = own.read.format("binaryFile")
    if format_ in _ENDS:
        pieces = own.read.text(path, lineSep=_ENDS[format_]).where(~packed).select(*named, F.col("value").cast("binary").alias("piece"))
        frames = [(pieces, _ENDS[format_].encode())]
        if own.read.format("binaryFile").load(path).where(packed).select("path").limit(1).count():
            frames.append((contents.load(path).where(packed).select(*named, F.col("content").alias("piece")), None))
    else:
        frames = [(contents.load(path).select(*named, F.col("content").alias("piece")), None)]

    def counter(end: bytes | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name, blocks in _files(batches, end, limit):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sum(1 for _ in _guarded(blocks, format_))], pa.int64())], names=["file", "n"])

        return count

    # records are numbered over the dataset, files in the order of their paths; one row a file reaches the driver
    before: dict[str, int] = {}
    if own.read.format("binaryFile").load(path).select("path").limit(2).count() > 1:
        total = 0
        counts = [tuple(r) for df, end in frames for r in df.mapInArrow(counter(end), "file string, n long").collect()]
        for name, n in sorted(counts, key=lambda x: unquote(x[0])):
            before[name] = total
            total += n

    def runner(end: bytes | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name, blocks in _files(batches, end, limit):
                held: list[tuple[int, str | None, str | None]] = []
                letters = 0
                for n, raw, error in _guarded(blocks, format_):
                    held.append((before.get(name, 0) + n, raw, error))
                    letters += len(raw or "")
                    if len(held) >= _BATCH or letters >= _BATCH_TEXT:
                        yield _batch(held)
                        held, letters = [], 0
                if held:
                    yield _batch(held)

        return run

    made = [df.mapInArrow(runner(end), SCHEMA) for df, end in frames]
    return made[0] if len(made) == 1 else made[0].union(made[1])


def _files(batches: Iterator[pa.RecordBatch], end: bytes | None, limit: int) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(name, blocks of bytes) of each file, from pieces that lost their end or, without an end, from whole contents."""

    def rows():
        for b in batches:
            if not b.num_rows:
                continue
            names, sizes = b.column("file"), b.column("size")
            first = names[0].as_py()
            # files follow each other, so equal names at both ends are one file
            at = zip(names.to_pylist(), sizes.to_pylist(), strict=True) if names[b.num_rows - 1].as_py() != first else itertools.repeat((first, sizes[0].as_py()), b.num_rows)
            yield from zip(at, b.column("piece").to_pylist(), strict=True)

    for (name, size), own in itertools.groupby(rows(), key=lambda r: r[0]):
        parts = (piece for _, piece in own)
        if end is not None:
            parts = _joined(parts, end, size)
        elif name.lower().endswith(".gz"):
            parts = _expanded(parts)
        yield name, _bounded(parts, limit)


def _joined(pieces: Iterable[bytes], end: bytes, size: int) -> Iterator[bytes]:
    """A file's blocks; whether its last piece had an end is told from the file's size (a byte order mark is 3 bytes)."""
    held: list[bytes] = []
    length = seen = 0
    for piece in pieces:
        if length >= _BLOCK:
            yield end.join(held) + end
            held, length = [], 0
        held.append(piece)
        length += len(piece) + 1
        seen += len(piece) + 1
    if size - seen in (0, 3):
        yield end.join(held) + end
    elif size - seen in (-1, 2):
        yield end.join(held)
    else:
        raise InputError(f"{seen} bytes were read of {size}")


def _expanded(contents: Iterable[bytes]) -> Iterator[bytes]:
    for content in contents:
        with gzip.open(io.BytesIO(content)) as f:
            while block := f.read(_BLOCK):
                yield block


def _bounded(blocks: Iterable[bytes], limit: int) -> Iterator[bytes]:
    total = 0
    for block in blocks:
        total += len(block)
        if total > limit:
            raise InputError(f"expanded input exceeds the {limit} byte limit")
        yield block


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    n, raw, error = map(list, zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(raw, pa.string()), pa.array(error, pa.string())], names=["record_no", "raw", "error"])


def _guarded(blocks: Iterator[bytes], format_: str) -> Iterator[tuple[int, str | None, str | None]]:
    """Records, then one row with the error if there is one."""
    n = 0
    try:
        for raw in DECODERS[format_](blocks):
            n += 1
            yield n, raw, None
    except Exception as e:  # noqa: BLE001  any decoding failure is a record's error
        yield n + 1, None, f"decode {format_} input: {e}"


def _texts(blocks: Iterable[bytes]) -> Iterator[str]:
    """The blocks as text; a letter may lie across two of them."""
    decoder = codecs.getincrementaldecoder("utf-8-sig")()
    for block in blocks:
        if text := decoder.decode(block):
            yield text
    if text := decoder.decode(b"", True):
        yield text


def _lines(texts: Iterable[str], split) -> Iterator[str]:
    """Lines with their ends; split cuts a text into such lines."""
    tail = ""
    for text in texts:
        lines = split(tail + text)
        # a return may be followed by a line feed in the next text
        tail = "" if lines[-1].endswith("\n") else lines.pop()
        yield from lines
        if len(tail) > MAX_EVENT:
            raise InputError(f"event exceeds {MAX_EVENT} bytes")
    if tail:
        yield tail


def decode_array(blocks: Iterable[bytes]) -> Iterator[str]:
    """Elements of a JSON array, each as it is written."""
    texts = _texts(blocks)
    text, at = "", 0

    def more() -> bool:
        """Lets go of what lies behind and takes the next text."""
        nonlocal text, at
        got = next(texts, None)
        text, at = text[at:] + (got or ""), 0
        return got is not None

    def token() -> str:
        """The next letter that is not white space; none at the end."""
        nonlocal at
        while True:
            at = jsontext._LEADING.match(text, at).end()
            if at < len(text) or not more():
                return text[at : at + 1]

    def element() -> str:
        nonlocal at
        while True:
            try:
                _, end = jsontext._decoder.raw_decode(text, at)
            except ValueError:
                # it is cut off or wrong; the text held doubles until that is known
                held = len(text) - at
                if held > MAX_EVENT or not more():
                    raise
                while len(text) < 2 * held and more():
                    pass
                continue
            if _OPEN.match(text, end):
                end -= at
                if more():
                    continue
            out, at = text[at:end], end
            return out

    if token() != "[":
        # a single file may hold lines although another began with an array
        for line in _lines(itertools.chain([text[at:]] if at < len(text) else [], texts), lambda x: x.splitlines(keepends=True)):
            if line.strip():
                yield line.strip()
        return
    at += 1
    while (letter := token()) != "]":
        if not letter:
            raise InputError("the array has no end")
        yield element()
        if (letter := token()) == ",":
            at += 1
            if token() == "]":
                raise InputError("trailing comma in the array")
        elif letter != "]":
            raise InputError("expected , or ] in the array")
    at += 1
    if token():
        raise InputError("content after the array")


def decode_csv(blocks: Iterable[bytes]) -> Iterator[str]:
    """Rows as objects in header order; every cell is a string."""
    csv.field_size_limit(MAX_EVENT)
    reader = csv.reader(_lines(_texts(blocks), lambda x: list(io.StringIO(x, newline=""))), strict=True)
    header = next(reader, None)
    if header is None:
        raise InputError("a header row is required")
    if any(not h.strip() for h in header):
        raise InputError("empty header")
    if len(set(header)) < len(header):
        raise InputError("duplicate header")
    keys = [jsontext.quote(h) for h in header]
    for row in reader:
        if not row:
            continue
        if len(row) != len(header):
            raise InputError(f"row has {len(row)} cells, the header {len(header)}")
        yield "{" + ",".join(f"{k}:{jsontext.quote(v.replace(chr(13) + chr(10), chr(10)))}" for k, v in zip(keys, row, strict=True)) + "}"


def decode_evtx(blocks: Iterable[bytes]) -> Iterator[str]:
    from .evtx import events

    for e in events(b"".join(blocks)):
        yield json.dumps(e, ensure_ascii=False, separators=(",", ":"))


DECODERS = {"json": decode_array, "csv": decode_csv, "evtx": decode_evtx}
