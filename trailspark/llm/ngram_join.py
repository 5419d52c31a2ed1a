"""N-gram Jaccard join: exact links between documents' shingle sets, and their components.

1. Each text becomes a set of 64-bit shingle hashes, and chunks of texts become
   rows of packed arrays. Equal sets are one class, kept by its smallest id.
2. Shingles are counted over the corpus: each chunk sends each of its shingles
   once to a hash bucket, which answers with a rank for each, by the number of
   sets that hold it. So a shingle costs its bucket one entry a chunk, however
   many documents hold it. A shingle of one set can be in no intersection.
3. Prefix: under the global order (rank, hash), two sets that link share one of
   the first ``n - ceil(threshold * n) + 1`` shingles of each. Unshared shingles
   come first in that order, so most documents have no candidate at all.
4. Prefix shingles, split by size band (links join equal or adjacent bands), tie
   candidates into blocks: connected components of the prefix graph.
5. Blocks are cut into size-banded tiles of bounded documents and shingles. A
   block whose prefix shingles are held by few documents each, such as a chain of
   weak candidates, is cut by prefix shingle instead: whichever compares less.
   In a pair of tiles, hashed bitmaps bound each overlap from above by bit counts:
   |A and B| <= (|A| + |B| - |bits(A) xor bits(B)|) / 2. Survivors are decided by
   exact intersection of sorted arrays. Pairs of sets already connected in the
   tile need no decision.
6. Links give the components of the classes, and classes those of the documents.

Classes, prefix shingles and components of any size are found by aggregation and
by ``lookup``, which keeps hot keys out of the shuffle, and a block of any size is
dealt as tile pairs; none of them is gathered in one task. Partitions are bounded
by PARTITIONS; a task works bucket by bucket.

Defined results: null, empty and blank texts have the empty set and link with
nothing; a null id takes no part (its component is null); rows of equal id are
one node with several sets; equal sets link; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, lookup, settle
from ._text import SPACED, chunks, deflate, groups, inflate, mix, pack, release, scan, squeeze, unsqueeze, windows
from .components import components

K = 5
#: Jaccard similarity as a fraction of integers, so that the test is exact.
NUM, DEN = 75, 100
BUCKET = 3_000_000
TILE_DOCS = 1024
TILE_SHINGLES = 1_000_000
BITS = 512
CHUNK = 3 << 20
PARTITIONS = 16_384
#: So many entries of a bucket are sorted at a time.
SORTED = 1 << 18
#: Shingles are counted in so many rounds, which bounds what lies in shuffle files at a time.
ROUNDS = 2


def shingle_sets(column: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the sorted distinct shingles of each row, in row order."""
    w = scan(column, SPACED, lower=True)
    h, row, _ = windows(w, k, short=True)
    # windows come by row but for the short rows, which have one each and stand last
    n = w.per_row()
    per_row = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    if len(h):
        order = np.argsort(row, kind="stable")
        h = h[order]
    at = np.append(0, np.cumsum(per_row))
    parts = [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array([len(p) for p in parts], dtype=np.int64)


def _sums(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64))
    at = np.append(0, np.cumsum(counts))
    return total[at[1:]] - total[at[:-1]]


def set_keys(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, from sums of mixed members."""
    return mix(_sums(mix(h + np.uint64(1)), counts)), mix(_sums(mix(h * np.uint64(3) + np.uint64(7)), counts))


def _batch(rows: list[tuple], names: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(map(list, zip(*rows, strict=True))) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, names.values(), strict=True)], names=list(names))


_PACKED = "chunk long, docs binary, known binary, counts binary, k1 binary, k2 binary, own binary, shingles long, hashes binary, begins binary, holders binary"
_DESCRIBED = "chunk long, doc_id long, n long, k1 long, k2 long, own boolean"


def _packed(k: int):
    """Chunks of text as one row each: ids, set sizes and digests of all rows, and the sets of those that are the first of their class in the chunk."""
    names = {x.split()[0]: pa.int64() if x.endswith("long") else pa.binary() for x in _PACKED.split(", ")}

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for i, b in enumerate(chunks(batches, "text", CHUNK)):
            h, counts = shingle_sets(b.column("text"), k)
            k1, k2 = set_keys(h, counts)
            ids = b.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
            live = np.flatnonzero(known & (counts > 0))
            order = live[np.lexsort((doc[live], k2[live], k1[live], counts[live]))]
            new = np.ones(len(order), bool)
            new[1:] = (counts[order][1:] != counts[order][:-1]) | (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
            own = np.zeros(len(doc), bool)
            own[order[new]] = True
            # the kept sets as (shingle, holder) by shingle
            h, holder = h[np.repeat(own, counts)], np.repeat(np.arange(int(own.sum())), counts[own])
            order = np.argsort(h, kind="stable")
            h = h[order]
            begins = np.append(True, h[1:] != h[:-1])[: len(h)]
            yield _batch([(first + i, pack(doc, "<i8"), pack(known, "u1"), pack(counts, "<u4"), pack(k1, "<u8"), pack(k2, "<u8"), pack(own, "u1"), len(h), squeeze(h), pack(np.packbits(begins), "u1"), squeeze(holder[order], step=False))], names)
            del b, h, holder, order, begins
        release()

    return run


def _describe(batches):
    """One row a document of packed chunks."""
    for b in batches:
        for r in b.to_pylist():
            doc, known = np.frombuffer(r["docs"], "<i8"), np.frombuffer(r["known"], "u1").astype(bool)
            cols = [pa.array(np.full(len(doc), r["chunk"])), pa.array(doc, mask=~known), pa.array(np.frombuffer(r["counts"], "<u4").astype(np.int64)), pa.array(np.frombuffer(r["k1"], "<i8")), pa.array(np.frombuffer(r["k2"], "<i8")), pa.array(np.frombuffer(r["own"], "u1").astype(bool))]
            yield pa.RecordBatch.from_arrays(cols, names=["chunk", "doc_id", "n", "k1", "k2", "own"])


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets as equal ranges of hashes, so that sorted hashes lie bucket by bucket."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _asked(buckets: int, part: int, rounds: int):
    """Each shingle of a chunk once, to its bucket, with the number of the chunk's sets that hold it; of one part of the buckets."""
    names = {"bucket": pa.int64(), "chunk": pa.int64(), "hashes": pa.binary(), "times": pa.binary()}

    def run(batches):
        for b in batches:
            for chunk, hashes in zip(b.column("chunk").to_pylist(), b.column("hashes"), strict=True):
                h, times = np.unique(unsqueeze(hashes.as_py()), return_counts=True)
                to = bucket_of(h, buckets)
                yield _batch([(int(to[s]), chunk, squeeze(h[s:e]), deflate(np.minimum(times[s:e], 255))) for s, e in groups(to) if to[s] % rounds == part], names)
        release()

    return run


_ROW = "chunk long, kind int, bucket long, docs binary, counts binary, k1 binary, own binary, begins binary, holders binary, ranks binary, tokens binary"


def _held(h: np.ndarray, times: np.ndarray, low: int, high: int) -> np.ndarray:
    """The rank of each of a bucket's entries; a range of hashes at a time, so that sorting needs little beside the entries."""
    rank = np.empty(len(h), np.uint8)
    parts = max(1, -(-len(h) // SORTED))
    edges = [low + (high - low) * i // parts for i in range(parts)]
    for i, edge in enumerate(edges):
        inside = h >= np.uint64(edge) if i else np.ones(len(h), bool)
        if i + 1 < parts:
            inside &= h < np.uint64(edges[i + 1])
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        x = h[at]
        order = np.argsort(x, kind="stable")
        x, at = x[order], at[order]
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        held = np.add.reduceat(times[at], first, dtype=np.int64)
        rank[at] = np.repeat(np.minimum(255, np.floor(8 * np.log2(held))).astype(np.uint8), np.diff(np.append(first, len(x))))
    return rank


def _ranked(key, table):
    """One bucket: the rank of each shingle asked for, 0 for those that one set holds, and those of several sets."""
    times = [inflate(x.as_py()) for x in table.column("times")]
    at = np.append(0, np.cumsum([len(x) for x in times]))
    times = np.concatenate(times)
    h = np.empty(len(times), np.uint64)
    for s, e, x in zip(at[:-1].tolist(), at[1:].tolist(), table.column("hashes"), strict=True):
        h[s:e] = unsqueeze(x.as_py())
    rank = _held(h, times, int(h.min()), int(h.max()) + 1) if len(h) else np.zeros(0, np.uint8)
    spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    ranks = [deflate(rank[s:e]) for s, e in spans]
    tokens = [squeeze(h[s:e][rank[s:e] > 0]) for s, e in spans]
    del h, rank, times
    release()
    return pa.table([table.column("chunk").combine_chunks(), pa.array([key[0].as_py()] * len(spans), pa.int64()), pa.array(ranks, pa.binary()), pa.array(tokens, pa.binary())], names=["chunk", "bucket", "ranks", "tokens"])


def _dead(batches):
    """Sets that a smaller id of another chunk holds as well, packed by chunk."""
    names = {"chunk": pa.int64(), "docs": pa.binary(), "k1": pa.binary()}
    for b in batches:
        chunk, doc, key = (b.column(x).to_numpy(zero_copy_only=False) for x in ("chunk", "doc_id", "k1"))
        order = np.argsort(chunk, kind="stable")
        yield _batch([(int(chunk[order[s]]), pack(doc[order[s:e]], "<i8"), pack(key[order[s:e]], "<i8")) for s, e in groups(chunk[order])], names)


def _sets(key, table):
    """One chunk: documents whose prefix holds shared shingles, with those and all their shared shingles."""
    rows = table.to_pylist()
    whole = next(r for r in rows if r["kind"] == 0)
    own = np.frombuffer(whole["own"], "u1").astype(bool)
    doc, n, k1 = (np.frombuffer(whole[c], t)[own] for c, t in (("docs", "<i8"), ("counts", "<u4"), ("k1", "<i8")))
    n = n.astype(np.int64)
    answers = sorted((r for r in rows if r["kind"] == 1), key=lambda r: r["bucket"])
    ranks = np.concatenate([np.zeros(0, np.uint8), *[inflate(r["ranks"]) for r in answers]])
    tokens = np.zeros(len(ranks), np.uint64)
    tokens[ranks > 0] = np.concatenate([unsqueeze(r["tokens"]) for r in answers]) if answers else tokens
    row = unsqueeze(whole["holders"], step=False).astype(np.int64)
    at = np.cumsum(np.unpackbits(np.frombuffer(whole["begins"], "u1"), count=len(row)).astype(np.int64)) - 1
    rank, token = ranks[at], tokens[at]
    gone = {p for r in rows if r["kind"] == 2 for p in zip(np.frombuffer(r["docs"], "<i8").tolist(), np.frombuffer(r["k1"], "<i8").tolist(), strict=True)}
    dropped = np.array([p in gone for p in zip(doc.tolist(), k1.tolist(), strict=True)], dtype=bool)
    held = np.bincount(row[rank > 0], minlength=len(doc))
    wanted = n - (NUM * n + DEN - 1) // DEN + 1 - (n - held)
    ok = (wanted > 0) & ~dropped
    sel = (rank > 0) & ok[row]
    row, token, rank = row[sel], token[sel], rank[sel]
    order = np.lexsort((token, row))
    row, token, rank = row[order], token[order], rank[order]
    order = np.lexsort((token, rank, row))
    out = []
    for s, e in groups(row):
        i = row[s]
        out.append((int(doc[i]), int(n[i]), pack(token[s:e], "<u8"), token[order[s : s + wanted[i]]].view(np.int64).tolist()))
    return pa.Table.from_batches([_batch(out, {"doc_id": pa.int64(), "n": pa.int64(), "members": pa.binary(), "prefix": pa.list_(pa.int64())})])


def bitmaps(members: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Hashed bitmap of each set: bit h mod bits is flipped by each member."""
    out = np.zeros((len(members), bits // 64), np.uint64)
    for i, m in enumerate(members):
        odd = np.bincount((mix(m) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Exact size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    i = np.searchsorted(b, a)
    i[i == len(b)] = 0
    return int((b[i] == a).sum()) if len(b) else 0


def links(n: np.ndarray, members: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """Links that connect the sets of two tiles (left and right: positions; equal for one tile), none between sets already connected.

    n: whole sizes; members: the shared shingles, to which every intersection belongs.
    """
    parent = list(range(len(n)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held = np.array([len(m) for m in members])
    bits = bitmaps(members)
    same = left is right
    out = []
    for place, i in enumerate(left.tolist()):
        others = right[place + 1 :] if same else right
        if not len(others):
            continue
        small, large = np.minimum(n[i], n[others]), np.maximum(n[i], n[others])
        others = others[den * small >= num * large]
        # bit counts bound the overlap from above
        most = (held[i] + held[others] - np.bitwise_count(bits[i] ^ bits[others]).sum(axis=1, dtype=np.int64)) // 2
        union = n[i] + n[others]
        ok = den * most >= num * (union - most)
        others, most = others[ok], most[ok]
        for j in others[np.argsort(-most, kind="stable")].tolist():
            a, b = root(i), root(j)
            if a == b:
                continue
            x = overlap(members[i], members[j])
            if den * x >= num * (int(n[i]) + int(n[j]) - x):
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _verify(key, table):
    """One pair of tiles."""
    doc, n, side = table.column("doc_id").to_numpy(), table.column("n").to_numpy(), table.column("side").to_numpy()
    members = [np.frombuffer(m, "<u8") for m in table.column("members").to_pylist()]
    if (side == 0).all():
        left = right = np.arange(len(doc))
    else:
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    found = links(n, members, left, right)
    return pa.table([pa.array([int(doc[i]) for i, _ in found], pa.int64()), pa.array([int(doc[j]) for _, j in found], pa.int64())], names=["a", "b"])


_RATIO = math.log(DEN / NUM)


def _band(n):
    """Sets that link lie in one band or in neighbours: a band's largest size is DEN/NUM times its smallest."""
    return F.floor(F.log(n.cast("double")) / F.lit(_RATIO) + F.lit(1e-9)).cast("int")


def _keyed(sets: DataFrame) -> DataFrame:
    """(key, doc_id): prefix shingles of a band; a document is keyed to its own band and, as the smaller one, to the next."""
    prefix = sets.select("doc_id", _band(F.col("n")).alias("band"), F.explode("prefix").alias("token"))
    return prefix.select("doc_id", F.explode(F.array(F.xxhash64("token", "band"), F.xxhash64("token", F.col("band") + 1))).alias("key"))


def _blocks(scratch: Scratch, keyed: DataFrame) -> DataFrame:
    """(node, block) of the documents with a candidate."""
    hubs = scratch.table(keyed.groupBy(F.col("key").alias("hub_key")).agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"), F.count("*").alias("held")).where("hub <> last").drop("last"), "hubs")
    edges = lookup(keyed, hubs, {"key": "hub_key"}, "held", keyed.count(), "inner").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    stars = components(edges)
    return scratch.table(stars.select("node", F.col("root").alias("block")).union(stars.select(F.col("root").alias("node"), F.col("root").alias("block")).distinct()), "blocks")


def _placed(scratch: Scratch, sets: DataFrame, keyed: DataFrame, blocks: DataFrame, tile_docs: int) -> DataFrame:
    """(mode, block, band, doc_id, n, held, members): documents to be compared within a block's neighbouring bands or (mode 1) within a prefix shingle's."""
    shown = sets.select("doc_id", "n", _band(F.col("n")).alias("band"), (F.length("members") / 8).cast("long").alias("held"), "members")
    sizes = blocks.groupBy("block").agg(F.count("*").alias("docs")).where(F.col("docs") > tile_docs)
    if sizes.isEmpty():
        return scratch.table(shown.join(blocks, F.col("doc_id") == F.col("node")).select(F.lit(0).alias("mode"), "block", "band", "doc_id", "n", "held", "members"), "placed")
    large = scratch.table(lookup(blocks, sizes.withColumnRenamed("block", "z"), {"block": "z"}, "docs", blocks.count(), "inner").select("node", "block", "docs"), "large")
    # documents of large blocks by prefix shingle, and what comparing these would cost
    by_key = scratch.table(keyed.join(large, F.col("doc_id") == F.col("node")).select("key", "block", "docs", "doc_id"), "by_key")
    held = scratch.table(by_key.groupBy("key", "block").agg(F.count("*").alias("g"), F.first("docs").alias("docs")).where("g > 1"), "held")
    chains = held.groupBy("block").agg(F.sum(F.col("g").cast("double") * F.col("g")).alias("cost"), F.first("docs").alias("docs")).where(F.col("cost") * 4 < F.col("docs").cast("double") * F.col("docs")).select(F.col("block").alias("c"), "docs")
    chained = scratch.table(chains, "chains")
    rest = blocks.join(chained.select("c"), F.col("block") == F.col("c"), "left_anti")
    whole = shown.join(rest, F.col("doc_id") == F.col("node")).select(F.lit(0).alias("mode"), "block", "band", "doc_id", "n", "held", "members")
    keys = held.join(chained.select("c"), F.col("block") == F.col("c"), "left_semi").select(F.col("key").alias("kk"), "g")
    some = lookup(by_key.select("key", "doc_id"), keys, {"key": "kk"}, "g", by_key.count(), "inner").select("key", F.col("doc_id").alias("node"))
    cut = shown.join(some, F.col("doc_id") == F.col("node")).select(F.lit(1).alias("mode"), F.col("key").alias("block"), F.lit(0).alias("band"), "doc_id", "n", "held", "members")
    return scratch.table(whole.unionByName(cut), "placed")


def _tiles(scratch: Scratch, placed: DataFrame, tile_docs: int, tile_shingles: int) -> DataFrame:
    """Rows of tile pairs: (pair, side, doc_id, n, members); side 0: a tile with itself, 1 and 2: two tiles."""
    at = ["mode", "block"]
    bands = scratch.table(placed.groupBy(*at, "band").agg(F.count("*").alias("docs"), F.sum("held").alias("shingles")), "bands")
    tiles = bands.select(*at, "band", "docs", F.greatest(F.ceil(F.col("docs") / tile_docs), F.ceil(F.col("shingles") / tile_shingles), F.lit(1)).cast("int").alias("tiles"))
    whole = bands.groupBy(*at).agg((F.ceil(F.sum("docs") / tile_docs) <= 1).alias("few"), (F.ceil(F.sum("shingles") / tile_shingles) <= 1).alias("light")).select(*at, (F.col("few") & F.col("light")).alias("one"))
    b = F.col("band")
    near = tiles.join(tiles.select(F.col("mode").alias("x_mode"), F.col("block").alias("x_block"), (F.col("band") - 1).alias("x_band"), F.col("tiles").alias("above")), (F.col("mode") == F.col("x_mode")) & (F.col("block") == F.col("x_block")) & (b == F.col("x_band")), "left").select(*at, "band", "docs", "tiles", F.coalesce("above", F.lit(0)).alias("above"))
    near = near.join(tiles.select(F.col("mode").alias("y_mode"), F.col("block").alias("y_block"), (F.col("band") + 1).alias("y_band"), F.col("tiles").alias("below")), (F.col("mode") == F.col("y_mode")) & (F.col("block") == F.col("y_block")) & (b == F.col("y_band")), "left").select(*at, "band", "docs", "tiles", "above", F.coalesce("below", F.lit(0)).alias("below"))
    # a table, as the lookup reads it three times: its joins would stand in the plan as often
    plan = scratch.table(near.join(whole, at).withColumnsRenamed({"mode": "p_mode", "block": "p_block", "band": "p_band"}), "plan")
    dealt = lookup(placed, plan, {"mode": "p_mode", "block": "p_block", "band": "p_band"}, "docs", placed.count(), "inner")
    t = F.pmod(F.xxhash64("doc_id", "n"), F.col("tiles")).cast("int")
    pair = lambda low, high, i, j, side: F.struct(low.alias("low"), high.alias("high"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    zero = F.lit(0)
    own = F.transform(F.sequence(zero, F.col("tiles") - 1), lambda j: pair(b, b, F.least(F.col("t"), j), F.greatest(F.col("t"), j), F.when(F.col("t") == j, 0).when(F.col("t") < j, 1).otherwise(2)))
    up = F.when(F.col("above") > 0, F.transform(F.sequence(zero, F.col("above") - 1), lambda j: pair(b, b + 1, F.col("t"), j, F.lit(1))))
    down = F.when(F.col("below") > 0, F.transform(F.sequence(zero, F.col("below") - 1), lambda j: pair(b - 1, b, j, F.col("t"), F.lit(2))))
    none = F.filter(own, lambda x: F.lit(False))
    pairs = F.when(F.col("one"), F.array(pair(zero, zero, zero, zero, F.lit(0)))).otherwise(F.concat(own, F.coalesce(up, none), F.coalesce(down, none)))
    return dealt.withColumn("t", t).select(*at, "doc_id", "n", "members", F.explode(pairs).alias("p")).select(*at, "p.low", "p.high", "p.i", "p.j", "p.side", "doc_id", "n", "members")


def jaccard_components(docs: DataFrame, k: int = K, bucket: int = BUCKET, tile_docs: int = TILE_DOCS, tile_shingles: int = TILE_SHINGLES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles and component_id."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    packed = scratch.table(d.mapInArrow(_packed(k), _PACKED), "packed")
    described = scratch.table(packed.select("chunk", "docs", "known", "counts", "k1", "k2", "own").mapInArrow(_describe, _DESCRIBED), "described")
    total = int(packed.agg(F.sum("shingles")).first()[0] or 0)
    rows = described.count()
    known = described.where("doc_id is not null")
    key = {"n": "rn", "k1": "r1", "k2": "r2"}
    classes = scratch.table(known.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").withColumnsRenamed(key), "classes")
    # what is answered to each chunk: ranks of its shingles, and which of its sets are kept elsewhere
    buckets = max(1, -(-total // bucket))
    ranks = None
    for part in range(ROUNDS):
        asked = packed.select("chunk", "hashes").mapInArrow(_asked(buckets, part, ROUNDS), "bucket long, chunk long, hashes binary, times binary")
        told = scratch.table(asked.repartition(min(buckets, PARTITIONS), "bucket").groupBy("bucket").applyInArrow(_ranked, "chunk long, bucket long, ranks binary, tokens binary"), f"ranks{part}", rows=1, batch=1 << 20)
        ranks = told if ranks is None else ranks.unionByName(told)
    gone = lookup(known.where("own"), classes, key, "copies", rows, "inner").where("doc_id <> rep").select("chunk", "doc_id", "k1").mapInArrow(_dead, "chunk long, docs binary, k1 binary")
    columns = _ROW.split(", ")
    row = lambda df, kind, **given: df.select(*[(F.lit(kind) if c.split()[0] == "kind" else given.get(c.split()[0], F.lit(None))).cast(c.split()[1]).alias(c.split()[0]) for c in columns])
    c = F.col
    sent = row(packed, 0, **{x: c(x) for x in ("chunk", "docs", "counts", "k1", "own", "begins", "holders")}).unionByName(row(ranks, 1, **{x: c(x) for x in ("chunk", "bucket", "ranks", "tokens")})).unionByName(row(gone, 2, chunk=c("chunk"), docs=c("docs"), k1=c("k1")))
    sets = scratch.table(sent.repartition(min(buckets, PARTITIONS), "chunk").groupBy("chunk").applyInArrow(_sets, "doc_id long, n long, members binary, prefix array<long>"), "sets", rows=2, batch=1 << 20)
    scratch.drop("packed", *[f"ranks{part}" for part in range(ROUNDS)])
    settle(docs.sparkSession)
    keyed = scratch.table(_keyed(sets), "keyed")
    placed = _placed(scratch, sets, keyed, _blocks(scratch, keyed), tile_docs)
    linked = _tiles(scratch, placed, tile_docs, tile_shingles).groupBy("mode", "block", "low", "high", "i", "j").applyInArrow(_verify, "a long, b long")
    # rows of one id tie the classes of their sets
    several = known.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("s"))
    if not several.isEmpty():
        tied = lookup(known, classes, key, "copies", rows, "inner").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct().join(several, F.col("a") == F.col("s"), "left_semi")
        linked = linked.unionByName(tied)
    roots = components(scratch.table(linked, "links"))
    scratch.drop("sets", "placed", "keyed", "bands", "plan")
    settle(docs.sparkSession)
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select("rn", "r1", "r2", "copies", F.coalesce("root", "rep").alias("class_root"))
    found = lookup(known, scratch.table(named, "named"), key, "copies", rows, "left").select("doc_id", "n", "class_root")
    whole = found.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_root", "root", "doc_id").alias("component_id"))
    return whole.unionByName(described.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
