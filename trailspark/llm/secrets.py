"""Secrets: base patterns, and a battery of randomness tests over the other long tokens.

The battery infers a token's encoding (hex, base32, base64 with its URL form)
and asks whether the token looks like uniform random letters of that alphabet:
a chi-squared test of uniformity, a runs test (letters above and below the
alphabet's middle) and a lag-1 serial correlation test. A token that passes all
three at ``ALPHA`` is a candidate. Its p-value is the chance that prose of that
length would look as random, from the log-likelihood ratio of uniform letters
against letter frequencies of prose: P(ratio >= r) <= exp(-r) under prose
(Markov's bound on a likelihood ratio), so longer tokens earn smaller values.
Candidates are accepted by the Benjamini-Hochberg step-up rule at ``FDR`` over all
tokens that the corpus holds: p-values are counted in ``BINS`` bins a unit of their
logarithm, a bin counts by its largest value, and the number of tests is the
number of tokens of ``LEAST`` letters or more.

Defined results: null and empty texts have no spans; repeated rows count as often
as they stand; ties, null ids and other columns need nothing; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import slices

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
ALPHA = 0.001
FDR = 0.01
LEAST = 12
BINS = 8

_ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
_LONG = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST}}}")

#: Encodings from the narrowest alphabet to the widest.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Letter frequencies of prose in per mille (fixed values): a to z.
PROSE = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)


def _prose(alphabet: str) -> np.ndarray:
    p = np.array([PROSE[ord(c.lower()) - 97] * (1.0 if c.islower() else 0.1) if c.isalpha() else 4.0 for c in alphabet])
    return p / p.sum()


_TABLE = {name: ({c: i for i, c in enumerate(a)}, _prose(a)) for name, a in ALPHABETS}
_RATIO = {name: {c: math.log(1 / len(a)) - math.log(p) for c, p in zip(a, _prose(a), strict=True)} for name, a in ALPHABETS}


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(token: str) -> str | None:
    have = set(token)
    return next((name for name, a in _RATIO.items() if have <= a.keys()), None)


def chance(token: str) -> tuple[str | None, float]:
    """(encoding, p-value under prose)."""
    name = encoding(token)
    if name is None:
        return None, 1.0
    return name, math.exp(-max(0.0, min(sum(map(_RATIO[name].__getitem__, token)), 700.0)))


def battery(token: str) -> tuple[str | None, dict[str, float], float]:
    """(encoding, p-value of each test under uniform letters, p-value under prose)."""
    name, p = chance(token)
    if name is None:
        return None, {}, 1.0
    index, _ = _TABLE[name]
    x = np.array([index[c] for c in token])
    n, k = len(x), len(index)
    seen = np.bincount(x, minlength=k)
    chi = float(((seen - n / k) ** 2).sum() * k / n)
    # Wilson-Hilferty: the cube root of chi-squared over its freedom is near normal
    f = k - 1
    tests = {"uniform": _upper(((chi / f) ** (1 / 3) - (1 - 2 / (9 * f))) / math.sqrt(2 / (9 * f)))}
    high = x >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b and n > 2:
        mean, var = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        tests["runs"] = 2 * _upper(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        tests["runs"] = 2.0 ** (1 - n)
    d = x - x.mean()
    if (s := float((d * d).sum())) > 0:
        r = float((d[1:] * d[:-1]).sum()) / s
        tests["serial"] = 2 * _upper(abs(r + 1 / n) * math.sqrt(n))
    else:
        tests["serial"] = 0.0
    return name, tests, p


def accepted(p: list[float], rate: float = FDR) -> list[bool]:
    """Benjamini-Hochberg step-up over all values."""
    order = sorted(range(len(p)), key=p.__getitem__)
    last = max((i for i, j in enumerate(order, 1) if p[j] <= rate * i / len(p)), default=0)
    keep = set(order[:last])
    return [i in keep for i in range(len(p))]


def proposed(text: str) -> tuple[list[tuple[str, int, int, float]], list[tuple[int, int, float]], int]:
    """(base spans with a score, candidates with their p-value, number of tokens tested)."""
    out: list[tuple[str, int, int, float]] = []
    for m in _ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 6:
            out.append(("assign", m.start(), m.end(), 0.9))
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), 0.95) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    candidates, tested = [], 0
    if _LONG.search(text):
        out += [("hex", m.start(), m.end(), 0.8) for m in _HEX.finditer(text)]
        for m in _TOKEN.finditer(text):
            token = m[0].rstrip("=")
            tested += 1
            # a value above the rate is accepted in no corpus, so its tests are not needed
            if chance(token)[1] <= FDR and min(battery(token)[1].values()) >= ALPHA:
                candidates.append((m.start(), m.end(), chance(token)[1]))
    return out, candidates, tested


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans of a corpus of this text alone, by start, then kind as listed, with a score."""
    out, candidates, tested = proposed(text)
    take = accepted([p for *_, p in candidates] + [1.0] * (tested - len(candidates)))
    out += [("random", s, e, round(1 - p, 6)) for (s, e, p), t in zip(candidates, take, strict=False) if t]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def threshold(bins: dict[int, int], tested: int, rate: float = FDR) -> int:
    """The least bin that the step-up rule accepts over a corpus' bins (floor of -ln p times BINS): its largest value is at most the rate times the share of tokens at or beyond it."""
    total, least = 0, 1 << 30
    for b in sorted(bins, reverse=True):
        total += bins[b]
        if math.exp(-b / BINS) <= rate * total / tested:
            least = b
    return least


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,stop:long,score:double>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("bin", pa.int32())])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its spans by start, then kind."""

    def run(batches):
        for b in slices(batches, "text"):
            found, tests = [], []
            for t in b.column("text"):
                out, candidates, tested = proposed(t.as_py() or "")
                rows = [(k, s, e, p, None) for k, s, e, p in out] + [("random", s, e, round(1 - p, 6), int(-math.log(p) * BINS)) for s, e, p in candidates]
                found.append([dict(zip(("kind", "start", "stop", "score", "bin"), r, strict=True)) for r in sorted(rows, key=lambda x: (x[1], KINDS.index(x[0])))])
                tests.append(tested)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(_SPAN)), pa.array(tests, pa.int64())], names=["doc_id", "spans", "tested"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = Scratch(docs.sparkSession, "secrets").table(d.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,stop:long,score:double,bin:int>>, tested long"), "found")
    tested = int(found.agg(F.sum("tested")).first()[0] or 0)
    # at most 700 * BINS bins
    bins = {r["bin"]: r["n"] for r in found.select(F.explode("spans.bin").alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n")).collect()}
    least = threshold(bins, tested)
    kept = F.filter("spans", lambda x: x["bin"].isNull() | (x["bin"] >= least))
    return found.select("doc_id", F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["score"].alias("score"))).alias("spans"))


def _written(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
