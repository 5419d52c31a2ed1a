"""Benchmark decontamination as a prefix-filtered set join.

Each item window (``k`` consecutive item words) is a set of word shingles that a
document must contain whole, so under a global order of shingles by rarity one
token is a necessary prefix: the window's rarest shingle, by document frequency
over the corpus. Windows with a shingle that no document holds are dropped.

Two scans of the corpus, whatever the benchmark's size: the first counts in how
many documents the benchmark's shingles stand, the second gathers the places of
necessary tokens, each with the words around it. What is sent to executors is a
bit filter of fixed size; the benchmark itself is never gathered. Places are then
joined with windows by token, and a candidate must pass the positional bound (the
window's words before the token lie in the document), the length bound (those
after it too) and a comparison of all words of the item-sized window.

Defined results: null or empty texts have no words and are never contaminated;
items without words are ignored; repeated item ids count once; items with a
null id mark words but are not listed; repeated documents each give a row;
other columns are ignored; with an empty benchmark nothing is hit; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, lookup
from ._text import ALNUM, Words, scan, slices, windows

#: Item texts are cut into windows in batches of so many bytes.
SLICE_BYTES = 1 << 20
#: Words of a shingle; shorter windows are one shingle.
SHINGLE = 5
#: Bits of the filters that are sent to executors (8 MB).
FILTER_BITS = 1 << 26


# -- the benchmark
def _windows(k: int, slice_bytes: int):
    """Each window of each item: its words, their number, its item and the hashes of its shingles in order."""

    def run(batches):
        for b in slices(batches, "text", slice_bytes):
            w = scan(b.column("text"), ALNUM, lower=True)
            raw = w.data.tobytes()
            words = [raw[s:e].decode() for s, e in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
            hashes = {}
            for s in range(1, min(SHINGLE, k) + 1):
                h, _, first = windows(w, s)
                hashes[s] = dict(zip(first.tolist(), h.view(np.int64).tolist(), strict=True))
            rows = []
            for i, item in enumerate(b.column("item_id").to_pylist()):
                a, z = int(w.rows[i]), int(w.rows[i + 1])
                n = min(k, z - a)
                s = min(SHINGLE, n)
                for at in range(a, z - n + 1) if n else ():
                    rows.append((" ".join(words[at : at + n]), n, item, [hashes[s][j] for j in range(at, at + n - s + 1)]))
            cols = list(map(list, zip(*rows, strict=True))) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64())), strict=True)], names=["window", "n", "item", "tokens"])

    return run


class Filter:
    """A bit filter of fixed size over 64-bit hashes, two bits each: no hash of the set is missed."""

    def __init__(self, hashes: DataFrame, bits: int = FILTER_BITS):
        h = F.col(hashes.columns[0])
        bit = F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))))
        # at most bits / 64 rows
        got = hashes.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("word")).toArrow()
        words = np.zeros(bits // 64, np.int64)
        words[got.column("slot").to_numpy()] = got.column("word").to_numpy()
        self.words, self.mask = words.view(np.uint64), np.uint64(bits - 1)

    def test(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be in the set."""
        at = np.arange(len(h))
        for shift in (np.uint64(0), np.uint64(32)):
            bit = (h[at] >> shift) & self.mask
            at = at[(self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
        return at


# -- the corpus
def _counted(filter_, sizes: list[int]):
    """In how many documents each shingle of the filter stands."""

    def run(batches):
        own = filter_.value
        for b in slices(batches, "text"):
            w = scan(b.column("text"), ALNUM, lower=True)
            for s in sizes:
                h, row, _ = windows(w, s)
                at = own.test(h)
                pairs = np.unique(np.stack([h[at], row[at].astype(np.uint64)]), axis=1)
                found, n = np.unique(pairs[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["token", "n"])

    return run


_FOUND = pa.struct([("token", pa.int64()), ("at", pa.int64()), ("lead", pa.int32()), ("words", pa.list_(pa.string()))])
_SCANNED = "doc_id long, text_key long, n_words long, found array<struct<token:long,at:long,lead:int,words:array<string>>>"


def _placed(filter_, sizes: list[int], k: int):
    """Each document with the places of necessary tokens and the words around them."""

    def around(w: Words, raw: bytes, row: int, at: int) -> dict:
        a, z = max(int(w.rows[row]), at - k + 1), min(int(w.rows[row + 1]), at + k)
        return {"lead": at - a, "words": [raw[s:e].decode() for s, e in zip(w.starts[a:z].tolist(), w.ends[a:z].tolist(), strict=True)]}

    def run(batches):
        own = filter_.value
        for b in slices(batches, "text"):
            w = scan(b.column("text"), ALNUM, lower=True)
            raw = w.data.tobytes()
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for s in sizes:
                h, row, first = windows(w, s)
                for i in own.test(h).tolist():
                    r, at = int(row[i]), int(first[i])
                    found[r].append({"token": int(h[i].view(np.int64)), "at": at - int(w.rows[r]), **around(w, raw, r, at)})
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(w.per_row()), pa.array(found, pa.list_(_FOUND))], names=["doc_id", "text_key", "n_words", "found"])

    return run


def _joined(rows: DataFrame, table: DataFrame, left: str, right: str) -> DataFrame:
    """Rows joined to windows of one key, hot keys apart; a key of very many windows is left to the shuffle."""
    held = rows.groupBy(F.col(left).alias("__key")).agg(F.count("*").alias("__held"))
    counted = table.join(held, F.col(right) == F.col("__key")).drop("__key")
    few = counted.groupBy(right).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    if few > 64:
        return rows.join(counted, F.col(left) == F.col(right)).drop("__held")
    return lookup(rows, counted, {left: right}, "__held", rows.count(), "inner").drop("__held")


def _hits(docs: DataFrame, benchmark: DataFrame, k: int, slice_bytes: int, doc_id: str, text: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned documents, verified places of windows, items of windows)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    cut = scratch.table(items.mapInArrow(_windows(k, slice_bytes), "window string, n int, item string, tokens array<long>"), "cut")
    tokens = scratch.table(cut.dropDuplicates(["window"]).select("window", "n", F.posexplode("tokens").alias("place", "token")), "tokens")
    sizes = sorted(r[0] for r in cut.select(F.least("n", F.lit(SHINGLE))).distinct().collect())
    send = spark.sparkContext.broadcast
    counted = d.select("text").mapInArrow(_counted(send(Filter(tokens.select("token"))), sizes), "token long, n long")
    frequency = scratch.table(counted.groupBy(F.col("token").alias("t")).agg(F.sum("n").alias("df")), "frequency")
    ranked = tokens.join(frequency, F.col("token") == F.col("t"), "left").select("window", "n", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "place", "token").alias("rank"))
    rarest = ranked.groupBy("window").agg(F.first("n").alias("n"), F.min("rank").alias("rank")).where("rank.df > 0")
    necessary = scratch.table(rarest.select("window", "n", "rank.place", F.col("rank.token").alias("need")), "necessary")
    scanned = scratch.table(d.mapInArrow(_placed(send(Filter(necessary.select("need"))), sizes, k), _SCANNED), "scanned")
    places = scanned.where(F.size("found") > 0).select("doc_id", "text_key", "n_words", F.inline("found"))
    start, within = F.col("at") - F.col("place"), F.col("lead") - F.col("place")
    candidates = _joined(places, necessary, "token", "need").where((start >= 0) & (within >= 0) & (start + F.col("n") <= F.col("n_words")))
    verified = candidates.where(F.array_join(F.slice("words", within + 1, F.col("n")), " ") == F.col("window"))
    hits = scratch.table(verified.select("doc_id", "text_key", F.struct(start.alias("start"), (start + F.col("n")).alias("stop")).alias("span"), "window").distinct(), "hits")
    return scanned, hits, cut.where("item is not null").select(F.col("window").alias("w"), "item").distinct()


_HIT = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def _merged(batches):
    """Spans that touch or overlap as one."""
    for b in batches:
        joined = []
        for spans in b.column("hits").to_pylist():
            own: list[dict] = []
            for x in sorted(spans or [], key=lambda x: x["start"]):
                if own and own[-1]["stop"] >= x["start"]:
                    own[-1]["stop"] = max(own[-1]["stop"], x["stop"])
                else:
                    own.append(dict(x))
            joined.append(own)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(joined, pa.list_(_HIT)), b.column("item_ids")], names=["doc_id", "n_words", "hits", "item_ids"])


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 10, slice_bytes: int = SLICE_BYTES, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, hits (merged word spans that item windows cover) and item_ids (sorted)."""
    scanned, hits, items = _hits(docs, benchmark, k, slice_bytes, doc_id, text, item_id, item_text)
    key = [F.col("doc_id").eqNullSafe(F.col("d")), F.col("text_key") == F.col("t")]
    spans = hits.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(F.collect_set("span").alias("hits"))
    listed = _joined(hits.select("doc_id", "text_key", "window").distinct(), items, "window", "w").select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "item").groupBy("d", "t").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    rows = scanned.select("doc_id", "text_key", "n_words").join(spans, key, "left").drop("d", "t").join(listed, key, "left")
    return rows.select("doc_id", "n_words", "hits", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")).mapInArrow(_merged, "doc_id long, n_words long, hits array<struct<start:long,stop:long>>, item_ids array<string>")


def clean(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...], k: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The documents without a hit."""
    _, hits, _ = _hits(docs, benchmark, k, slice_bytes, "doc_id", "text", "item_id", "text")
    gone = hits.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).distinct()
    return docs.select(*columns).join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("d")) & (F.xxhash64(F.col("text").cast("string")) == F.col("t")), "left_anti")


def digest(found: DataFrame) -> DataFrame:
    """The flat form: counts and a digest of the item ids."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
