"""Mix sources to target weights with hash-threshold histograms.

Sizes (words) are summed by source and hash bucket. A source whose target is t
takes every document ``floor(t / source size)`` times and, for the rest of its
budget, once more each document whose hash is below a threshold. The threshold
is found by nested histograms: the first buckets whose running sum stays within
the budget are taken whole; only the bucket at the boundary is split again by
the next hash digits, until one document is left in it. Nothing is sorted and no
group is collected: a histogram has ``16 ** digits`` rows a source at most.

A hash is twelve hexadecimal digits each of the id, of the text and of the row's
number in the table of sizes. Equal ids are thus told apart by their texts, and
rows equal in both by number: as many of them are taken as fit the budget, and
as they are equal, reruns agree. Source names are ranked, weighed and capped in
the cluster; the driver holds three sums.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; null ids are equal ids; repeated rows are separate documents;
sources of size 0 have target 0; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch, lookup

WEIGHTS = (1, 2, 3)
CEILING = 3
DIGITS = 3
#: Hexadecimal digits of each part of a hash.
PART = 12


def n_words(text: Column) -> Column:
    """How many runs of non-space a text has: places where one begins."""
    squeezed = F.regexp_replace(F.translate(text, "\t\n\x0b\x0c\r", "     "), "[^ ]+", "x")
    return F.when(text.isNull(), 0).otherwise(F.length(F.translate(squeezed, " ", ""))).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, ceiling: float = CEILING) -> dict[str | None, float]:
    """Each source's share of all words: by weight, at most ``ceiling`` times its size, the excess shared again by weight; the plain form, for few sources."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size = dict(order)
    total = float(sum(size.values()))
    target: dict[str | None, float] = {}
    open_ = [s for s, _ in order]
    while open_:
        rest = total - sum(target.values())
        all_weight = sum(weight[s] for s in open_)
        above = [s for s in open_ if rest * weight[s] / all_weight > ceiling * size[s]]
        if not above:
            return target | {s: rest * weight[s] / all_weight for s in open_}
        for s in above:
            target[s] = float(ceiling * size[s])
        open_ = [s for s in open_ if s not in above]
    return target


def _ranked(scratch: Scratch, sources: DataFrame) -> DataFrame:
    """Sources with their place in order of code points, null last, without gathering them: places within ranges, and the ranges' sums."""
    order = F.col("source").asc_nulls_last()
    dealt = scratch.table(sources.repartitionByRange(order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")), "ranges")
    # one row a range
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return dealt.join(F.broadcast(before), F.col("part") == F.col("p")).withColumn("rank", F.col("before") + F.col("place")).drop("part", "p", "place", "before")


def _leveled(ranked: DataFrame, weights: tuple[float, ...], ceiling: float) -> DataFrame:
    """Sources with their target: round by round, those above ``ceiling`` times their size are fixed there and the rest is shared again."""
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    cap = F.lit(float(ceiling)) * F.col("source_size")
    total = int(weighed.agg(F.sum("source_size")).first()[0] or 0)
    fixed, share, before = F.lit(False), None, -1
    while True:
        r = weighed.agg(F.sum(F.when(fixed, cap)).alias("fixed"), F.sum(F.when(~fixed, F.col("weight"))).alias("open"), F.count_if(fixed).alias("n")).first()
        if int(r["n"]) == before or not r["open"]:
            return weighed.withColumn("target", F.when(fixed, cap).otherwise(share) if share is not None else cap)
        before = int(r["n"])
        share = F.lit(float(total) - float(r["fixed"] or 0.0)) * F.col("weight") / F.lit(float(r["open"]))
        fixed = share > cap


def _boundaries(histogram: DataFrame, state: DataFrame) -> DataFrame:
    """Of each source, the first bucket that does not fit whole: key, prefix, what is left for it, its rows."""
    run = histogram.join(state.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).withColumn("upto", F.sum("words").over(Window.partitionBy("key").orderBy("bucket")))
    first = run.where(F.col("upto") > F.col("left")).groupBy("key").agg(F.min_by(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("words")).alias("left"), "rows", "held"), "bucket").alias("b"))
    return first.select("key", F.col("b.bucket").alias("prefix"), "b.left", "b.rows", "b.held")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, ceiling: float = CEILING, digits: int = DIGITS, carry: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, times (how often the mix takes it) and the carried columns."""
    scratch = Scratch(docs.sparkSession, "mix")
    part = lambda x: F.substring(F.md5(x.cast("binary")), 1, PART)
    hash_ = F.concat(part(F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), part(F.hex(F.xxhash64(text))), part(F.monotonically_increasing_id().cast("string")))
    name = F.col(source).cast("string")
    sized = scratch.table(docs.select(F.col(doc_id).alias("doc_id"), name.alias("source"), n_words(F.col(text)).alias("size"), F.when(name.isNull(), "n").otherwise(F.concat(F.lit("s"), name)).alias("key"), hash_.alias("hash"), *carry), "sizes")
    narrow = sized.select("key", "size", "hash")
    bucket = lambda n: F.substring("hash", 1, n).alias("bucket")
    sums = (F.sum("size").alias("words"), F.count("*").alias("rows"))
    histogram = scratch.table(sized.groupBy("key", "source", bucket(digits)).agg(*sums), "histogram")
    sources = histogram.groupBy("key", "source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("held"))
    wanted = _leveled(_ranked(scratch, sources), weights, ceiling)
    full = F.when(F.col("source_size") > 0, F.least(F.lit(int(ceiling)), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    # left: the budget after whole repeats
    plan = scratch.table(wanted.withColumn("full", full).select("key", "source_size", "target", "full", "held", (F.col("target") - F.col("full") * F.col("source_size")).alias("left")), "plan")
    total = int(plan.agg(F.sum("held")).first()[0] or 0)
    histogram, state, edge, found = histogram.select("key", "bucket", "words", "rows"), plan.select("key", "left", "held"), narrow, []
    for level in range(1, 3 * PART // digits + 1):
        at = scratch.table(_boundaries(histogram, state), f"boundary{level}")
        found.append(at.where("rows = 1").select("key", "prefix"))
        several = at.where("rows > 1")
        if level == 3 * PART // digits or several.isEmpty():
            found.append(several.select("key", "prefix"))
            break
        # held: how many rows of the frame have the key, of which the boundary's are kept
        inside = lookup(edge, several.select(F.col("key").alias("k"), "prefix", "left", "held", "rows"), {"key": "k"}, "held", total, "inner").where(F.col("hash").startswith(F.col("prefix")))
        edge = scratch.table(inside.select("key", "size", "hash"), f"edge{level}")
        histogram = edge.groupBy("key", bucket(digits * (level + 1))).agg(*sums)
        state = several.select("key", "left", F.col("rows").alias("held"))
    edges = found[0]
    for x in found[1:]:
        edges = edges.unionByName(x)
    # below the last boundary: taken once more; a source without one takes all
    told = plan.join(edges.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left").select(F.col("key").alias("s"), "source_size", "target", "full", "held", F.col("prefix").alias("threshold"))
    out = lookup(sized, told, {"key": "s"}, "held", total, "inner")
    once_more = F.col("threshold").isNull() & (F.col("full") < F.lit(int(ceiling))) & (F.col("target") > F.col("full") * F.col("source_size")) | (F.col("hash") < F.col("threshold"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("full") + F.when(once_more, 1).otherwise(0)).alias("times"), *carry)
