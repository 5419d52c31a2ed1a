"""Substring dedup with a log-structured fingerprint index.

Every window of ``k`` words has a 128-bit fingerprint: a 64-bit key and, from
other word hashes, a 64-bit check. The index is a log of immutable sorted runs.
A run lies in the shared folder as one file a shelf, in which each bucket is a
batch of ascending keys with their checks; buckets are ranges of keys, so a
shelf is sorted as a whole. A batch of documents is ingested in one pass: its
windows are sent to their shelves as packed arrays, each task opens its shelf's
files and merge-joins bucket by bucket (the history is never shuffled), verifies
each match by the check, answers every window that an earlier document owns, and
writes the shelf's file of the new run. When more than ``fan_in`` runs stand, they
are compacted shelf by shelf into one and the old files are deleted. Runs that
stand are listed in versioned manifests, by which an index is opened again.

Earlier documents are those of earlier batches, and in a batch those of smaller
ids; so batches of ascending ids equal one batch of all rows. ``dedup`` ingests a
table in such batches.

Neither a very common passage nor a large group of copies gathers in one task: of
equal windows of a chunk of text, only those of the smallest document are sent,
and a document sends each window once, however often it repeats there. Where it
repeats is found again when words are removed: a place is cut if its window is
equal to an answered one.

Defined results: null and empty texts have no words and lose none; rows with a
null id are kept whole and own nothing; rows of equal id do not remove each
other's words if they lie in one batch; texts below ``k`` words have no window;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch, delete, new_path
from ._text import SPACED, chunks, column_bytes, groups, mix, pack, scan, slices, spread, squeeze, unpack, unsqueeze, windows

WINDOW = 13
BUCKET_BYTES = 14 << 20
#: A batch of the query holds about so much text, and there are BATCHES at least.
BATCH_BYTES = 1 << 40
BATCHES = 6
FAN_IN = 3
CHUNK = 4 << 20
#: Tasks, and files of a run.
SHELVES = 4096

_SENT = "shelf int, bucket long, kind int, docs binary, keys binary, counts binary, fingerprints binary, gaps binary"
_HITS = "to long, docs binary, keys binary, counts binary, places binary"


def fingerprints(w, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, check, row, first word in the row) of each window."""
    key, row, at = windows(w, k)
    plain = w.hashes
    w.hashes = mix(plain * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x2545))
    check, _, _ = windows(w, k)
    w.hashes = plain
    return key, check, row, at - w.rows[row]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets as equal ranges of keys."""
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def shelf_of(bucket: int, buckets: int, shelves: int) -> int:
    return bucket * shelves // buckets


def _gaps(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ascending places as 16-bit steps; 65535 says: so far, and more follows. first: where a document begins."""
    step = np.diff(at, prepend=0)
    step[first] = at[first]
    long = step // 65535
    if not long.any():
        return step.astype(np.uint16)
    out = np.full(len(step) + int(long.sum()), 65535, dtype=np.uint16)
    out[np.cumsum(long + 1) - 1] = step % 65535
    return out


def _places(gaps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Inverse of _gaps, for documents of so many places each."""
    last = gaps != 65535
    total = np.cumsum(gaps.astype(np.int64))[last]
    first = np.cumsum(counts) - counts
    base = np.where(first > 0, total[np.maximum(first - 1, 0)], 0)
    return total - np.repeat(base, counts)


def _by_document(to: np.ndarray, entry: np.ndarray, place: np.ndarray, docs: np.ndarray, keys: np.ndarray) -> Iterator[tuple]:
    """Places as rows of (bucket, documents, text keys, counts, places); entry: index into docs and keys."""
    order = np.lexsort((entry, to))
    to, entry, place = to[order], entry[order], place[order]
    for s, e in groups(to):
        first = np.flatnonzero(np.diff(entry[s:e], prepend=-1))
        of = entry[s:e][first]
        yield int(to[s]), pack(docs[of], "<i8"), pack(keys[of], "<i8"), pack(np.diff(np.append(first, e - s)), "<u4"), pack(place[s:e], "<u4")


def _both(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Key and check as one number that sorts by both."""
    out = np.empty(len(key), dtype=[("key", "<u8"), ("check", "<u8")])
    out["key"], out["check"] = key, check
    return out


def _starts(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Where sorted fingerprints change."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    return np.flatnonzero(new)


_SENT_TYPES = {"shelf": pa.int32(), "bucket": pa.int64(), "kind": pa.int32(), **{c: pa.binary() for c in ("docs", "keys", "counts", "fingerprints", "gaps")}}
_HIT_TYPES = {"to": pa.int64(), **{c: pa.binary() for c in ("docs", "keys", "counts", "places")}}


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(map(list, zip(*rows, strict=True))) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values(), strict=True)], names=list(types))


def _sent(buckets: int, shelves: int, k: int):
    """Windows by bucket (kind 0); kind 2: places that a smaller document of the chunk owns, which need no search, by document bucket."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in chunks(batches, "text", CHUNK):
            w = scan(b.column("text"), SPACED)
            key, check, row, at = fingerprints(w, k)
            doc = b.column("doc_id").to_numpy(zero_copy_only=False)
            text = b.column("text_key").to_numpy(zero_copy_only=False)
            # each window once a row, at its first place
            order = np.lexsort((at, row, check, key))
            key, check, row, at = key[order], check[order], row[order], at[order]
            new = np.zeros(len(key), bool)
            new[_starts(key, check)] = True
            once = new.copy()
            once[1:] |= row[1:] != row[:-1]
            key, check, row, at, new = key[once], check[once], row[once], at[once], new[once]
            first = np.flatnonzero(new)
            least = np.repeat(np.minimum.reduceat(doc[row], first), np.diff(np.append(first, len(key)))) if len(key) else np.zeros(0, np.int64)
            known = doc[row] > least
            rows = [(shelf_of(to, buckets, shelves), to, 2, *x[:3], None, x[3]) for to, *x in _by_document(spread(doc[row[known]], buckets), row[known], at[known], doc, text)]
            key, check, row, at = key[~known], check[~known], row[~known], at[~known]
            to = bucket_of(key, buckets)
            order = np.lexsort((at, row, to))
            key, check, row, at, to = key[order], check[order], row[order], at[order], to[order]
            for s, e in groups(to):
                first = np.flatnonzero(np.diff(row[s:e], prepend=-1))
                of = row[s:e][first]
                rows.append((shelf_of(int(to[s]), buckets, shelves), int(to[s]), 0, pack(doc[of], "<i8"), pack(text[of], "<i8"), pack(np.diff(np.append(first, e - s)), "<u4"), pack(_both(key[s:e], check[s:e]).view("<u8"), "<u8"), pack(_gaps(at[s:e], first), "<u2")))
            if rows:
                yield _batch(rows, _SENT_TYPES)

    return run


# -- runs
_RUN = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary())])


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class ShelfReader:
    """A run's file of one shelf, read bucket by bucket in ascending order."""

    def __init__(self, path: str):
        fs, at = _open(path)
        self.file = fs.open_input_stream(at)
        self.reader = pa.ipc.open_stream(self.file)
        self.next = self._read()

    def _read(self) -> dict | None:
        try:
            return self.reader.read_next_batch().to_pylist()[0]
        except StopIteration:
            self.file.close()
            return None

    def take(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and checks of a bucket; those before it are passed over."""
        while self.next is not None and self.next["bucket"] < bucket:
            self.next = self._read()
        if self.next is None or self.next["bucket"] > bucket:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        out = unsqueeze(self.next["keys"]), np.frombuffer(self.next["checks"], "<u8")
        self.next = self._read()
        return out


class ShelfWriter:
    """Writes a run's file of one shelf beside its place and renames it, so that a lost or repeated task leaves one whole file."""

    def __init__(self, path: str):
        self.path = path
        self.fs, self.at = _open(path)
        self.own = f"{self.at}.{uuid.uuid4().hex}"
        self.sink = self.fs.open_output_stream(self.own)
        self.out = pa.ipc.new_stream(self.sink, _RUN)

    def add(self, bucket: int, key: np.ndarray, check: np.ndarray) -> None:
        if len(key):
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([squeeze(key)], pa.binary()), pa.array([pack(check, "<u8")], pa.binary())], schema=_RUN))

    def close(self) -> None:
        self.out.close()
        self.sink.close()
        self.fs.move(self.own, self.at)


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs as one, each fingerprint once."""
    if len(runs) == 1:
        return runs[0]
    key, check = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    order = np.lexsort((check, key))
    key, check = key[order], check[order]
    first = _starts(key, check)
    return key[first], check[first]


def owned(run: tuple[np.ndarray, np.ndarray], key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Merge-join: whether each fingerprint stands in a run; keys are looked for, and checks verify them."""
    keys, checks = run
    out = np.zeros(len(key), bool)
    if not len(keys):
        return out
    at = np.searchsorted(keys, key)
    todo = np.flatnonzero(at < len(keys))
    while todo.size:  # once more only where different windows have one key
        todo = todo[keys[at[todo]] == key[todo]]
        out[todo] = checks[at[todo]] == check[todo]
        todo = todo[~out[todo]]
        at[todo] += 1
        todo = todo[at[todo] < len(keys)]
    return out


def _ingest(runs: list[dict], new_run: str, buckets: int, hit_buckets: int):
    """Rows of shelves, by bucket: answers the batch's windows and writes the shelves' files of the new run."""

    def bucket_rows(batches):
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["bucket"] != r["bucket"]:
                    yield held
                    held = []
                held.append(r)
        if held:
            yield held

    def run(batches):
        shelf, readers, writer = None, [], None
        for rows in bucket_rows(batches):
            if rows[0]["shelf"] != shelf:
                if writer:
                    writer.close()
                shelf = rows[0]["shelf"]
                readers = [ShelfReader(f"{r['path']}/{shelf:06d}") for r in runs if shelf in r["shelves"]]
                writer = ShelfWriter(f"{new_run}/{shelf:06d}")
            passed = [r for r in rows if r["kind"] == 2]
            if passed:
                yield _batch([(r["bucket"], r["docs"], r["keys"], r["counts"], r["gaps"]) for r in passed], _HIT_TYPES)
            rows = [r for r in rows if r["kind"] == 0]
            if not rows:
                continue
            bucket = rows[0]["bucket"]
            both = unpack([r["fingerprints"] for r in rows], "<u8").reshape(-1, 2)
            key, check = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
            del both
            counts = unpack([r["counts"] for r in rows], "<u4").astype(np.int64)
            docs, texts = unpack([r["docs"] for r in rows], "<i8"), unpack([r["keys"] for r in rows], "<i8")
            entry = np.repeat(np.arange(len(docs)), counts)
            order = np.lexsort((docs[entry], check, key))
            first = _starts(key[order], check[order])
            # the batch's own run, and each window's smallest document in it
            own = key[order][first], check[order][first]
            least = np.empty(len(key), np.int64)
            least[order] = np.repeat(docs[entry][order][first], np.diff(np.append(first, len(key))))
            hit = docs[entry] > least
            for r in readers:
                hit |= owned(r.take(bucket), key, check)
            writer.add(bucket, *own)
            if hit.any():
                # places count from each document's start, so gaps of all rows in a line can be undone together
                place = _places(unpack([r["gaps"] for r in rows], "<u2"), counts)[hit]
                yield _batch(list(_by_document(spread(docs[entry[hit]], hit_buckets), entry[hit], place, docs, texts)), _HIT_TYPES)
        if writer:
            writer.close()

    return run


def _spans(key, table):
    """One document bucket: first places of all answered windows of its documents."""
    col = {n: table.column(n).to_pylist() for n in ("docs", "keys", "counts", "places")}
    counts = unpack(col["counts"], "<u4").astype(np.int64)
    doc, text = np.repeat(unpack(col["docs"], "<i8"), counts), np.repeat(unpack(col["keys"], "<i8"), counts)
    place = unpack(col["places"], "<u4").astype(np.int64)
    order = np.lexsort((place, text, doc))
    doc, text, place = doc[order], text[order], place[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]))
    of = np.flatnonzero(new)
    places = [squeeze(np.unique(p)) for p in np.split(place, of[1:])]
    return pa.table([pa.array(doc[of]), pa.array(text[of]), pa.array(places, pa.binary())], names=["doc_id", "text_key", "places"])


_SPANS = "doc_id long, text_key long, places binary"


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))


def cut(d: DataFrame, spans: DataFrame, k: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the kept words joined by one space."""

    def run(batches):
        for b in slices(batches, "text"):
            raw, off = column_bytes(b.column("text"))
            body, places = raw.tobytes(), b.column("places").to_pylist()
            some = [i for i, p in enumerate(places) if p]
            hits: dict[int, np.ndarray] = {}
            if some:
                # every place whose window equals an answered one
                w = scan(b.column("text").take(pa.array(some)), SPACED)
                key, check, row, at = fingerprints(w, k)
                cuts = np.searchsorted(row, np.arange(len(some) + 1))
                for n, i in enumerate(some):
                    both = _both(key[cuts[n] : cuts[n + 1]], check[cuts[n] : cuts[n + 1]])
                    hits[i] = np.flatnonzero(np.isin(both.view("V16").ravel(), both[unsqueeze(places[i]).astype(np.int64)].view("V16").ravel())) if len(both) > 1 else np.arange(len(both))
            kept, n, gone = [], [], []
            for i in range(b.num_rows):
                words = body[off[i] : off[i + 1]].split()
                n.append(len(words))
                if i in hits:
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, hits[i], 1)
                    np.add.at(step, hits[i] + k, -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    both = d.join(spans.withColumnsRenamed({"doc_id": "d", "text_key": "t"}), (F.col("doc_id") == F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    return both.select("doc_id", "text", "places").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


class FingerprintIndex:
    """Log-structured index for incremental dedup.

    The number of buckets is fixed when the index is made. ``runs`` lists what
    stands, oldest first: path and shelves of each run. ``path`` opens an index
    that is there, or makes one.
    """

    def __init__(self, spark: SparkSession, buckets: int = 1, k: int = WINDOW, fan_in: int = FAN_IN, path: str | None = None):
        self.spark, self.buckets, self.k, self.fan_in = spark, buckets, k, fan_in
        self.path = path or new_path(spark, "index")
        self.runs: list[dict] = []
        self.version = 0
        self.fs, self.at = _open(self.path)
        self.fs.create_dir(self.at, recursive=True)
        versions = sorted(f.path for f in self.fs.get_file_info(pafs.FileSelector(self.at)) if f.path.endswith(".json"))
        if versions:
            with self.fs.open_input_stream(versions[-1]) as f:
                state = json.loads(f.read())
            self.buckets, self.k, self.runs, self.version = state["buckets"], state["k"], state["runs"], state["version"]

    @property
    def shelves(self) -> int:
        return min(self.buckets, SHELVES)

    def _commit(self, runs: list[dict]) -> None:
        """A new manifest, written whole and renamed, lists the runs that stand; then what no longer stands is deleted."""
        old, self.runs, self.version = self.runs, runs, self.version + 1
        body = json.dumps({"buckets": self.buckets, "k": self.k, "runs": runs, "version": self.version})
        own = f"{self.at}/{uuid.uuid4().hex}.new"
        with self.fs.open_output_stream(own) as f:
            f.write(body.encode())
        self.fs.move(own, f"{self.at}/manifest-{self.version:09d}.json")
        for r in old:
            for shelf in set(r["shelves"]) - {s for x in runs if x["path"] == r["path"] for s in x["shelves"]}:
                _, at = _open(f"{r['path']}/{shelf:06d}")
                self.fs.delete_file(at)

    def _new(self) -> str:
        path = f"{self.path}/run-{uuid.uuid4().hex}"
        self.fs.create_dir(_open(path)[1], recursive=True)
        return path

    def _listed(self, path: str) -> dict:
        names = [f.base_name for f in self.fs.get_file_info(pafs.FileSelector(_open(path)[1]))]
        return {"path": path, "shelves": sorted(int(n) for n in names if n.isdigit())}

    def places(self, batch: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """Ingest a batch (doc_id, text, text_key): the places of windows that earlier documents own."""
        new, buckets, shelves = self._new(), self.buckets, self.shelves
        sent = batch.where("doc_id is not null and text is not null").mapInArrow(_sent(buckets, shelves, self.k), _SENT)
        # shelves are tasks, in which buckets come in order
        hits = sent.repartition(shelves, "shelf").sortWithinPartitions("shelf", "bucket").mapInArrow(_ingest(self.runs, new, buckets, buckets), _HITS)
        spans = scratch.table(hits.repartition(shelves, "to").groupBy("to").applyInArrow(_spans, _SPANS), name)
        self._commit([*self.runs, self._listed(new)])
        if len(self.runs) > self.fan_in:
            self.compact()
        return spans

    def dedup(self, batch: DataFrame) -> DataFrame:
        """Per document of a batch: doc_id, n_words, n_removed, kept."""
        d = _with_key(batch)
        return cut(d, self.places(d, Scratch(self.spark, "batch"), "spans"), self.k)

    def compact(self, parts: int = 4) -> None:
        """Merge all runs into one, a part of the shelves at a time, so that old and new files lie side by side for that part alone."""
        runs, new = self.runs, self._new()
        for part in range(parts):
            todo = sorted({s for r in runs for s in r["shelves"] if s % parts == part})
            if not todo:
                continue

            def merge(batches, runs=runs):
                for b in batches:
                    for shelf in b.column("shelf").to_pylist():
                        readers = [ShelfReader(f"{r['path']}/{shelf:06d}") for r in runs if shelf in r["shelves"]]
                        writer = ShelfWriter(f"{new}/{shelf:06d}")
                        while left := [r.next["bucket"] for r in readers if r.next is not None]:
                            writer.add(min(left), *merged([r.take(min(left)) for r in readers]))
                        writer.close()
                        yield pa.RecordBatch.from_arrays([pa.array([shelf], pa.int32())], names=["shelf"])

            shelves = self.spark.createDataFrame([(s,) for s in todo], "shelf int").repartition(len(todo), "shelf")
            shelves.mapInArrow(merge, "shelf int").count()
            runs = [{"path": r["path"], "shelves": [s for s in r["shelves"] if s % parts != part]} for r in runs]
            # the merged shelves stand in the new run; they hold what the log held, so it is the oldest
            self._commit([self._listed(new), *[r for r in runs if r["shelves"]]])
        for r in {r["path"] for r in runs}:
            delete(self.spark, r)


def buckets_for(size: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(1, -(-size // bucket_bytes))


def dedup(docs: DataFrame, k: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """A table, ingested in batches of ascending ids into an index that is deleted afterwards: doc_id, n_words, n_removed, kept."""
    spark = docs.sparkSession
    d = _with_key(docs)
    size = int(d.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = max(BATCHES, -(-size // batch_bytes))
    edges = sorted(set(d.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"] or []))
    index, scratch = FingerprintIndex(spark, buckets_for(size, bucket_bytes), k), Scratch(spark, "substring")
    id_ = F.col("doc_id")
    parts = []
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        batch = d.where((F.lit(True) if low is None else id_ > low) & (F.lit(True) if high is None else id_ <= high))
        parts.append(index.places(batch, scratch, f"spans{len(parts)}"))
    delete(spark, index.path)
    return cut(d, reduce(DataFrame.unionByName, parts), k)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
