"""Toxicity with a weighted finite-state pattern grammar.

Words are mapped to terminal classes (insult, threat, target, negation, report).
A clause ends at punctuation or a line break. Five small transducers read a
clause's classes: insult, threat, target, negation (it opens a scope that ends
where no class follows for ``SCOPE`` words) and reported speech. ``compose`` makes
one machine of them, whose final state emits the clause's category: an insult
aimed at a target, a bare insult, a threat with or without a target, and each of
these negated or in reported speech. A document is scored from its matched
clauses: a logistic model over clause counts.

A clause of any length is read in a logarithmic number of steps: each class is a
map from states to states, and neighbouring maps are composed pairwise.

The insult lexicon is the seed list plus what labelled rows teach: words, and word
beginnings of ``STEMS`` bytes, that stand in far more toxic than clean rows. Both
the lexicon and the clause weights are fitted on at most ``SAMPLE`` labelled rows
(those of smallest hash, one text an id), never on held-out rows; the sample is
written once. Scoring covers every row whole. Labels, language, source and id are
never inputs of a score.

Defined results: a null or empty text scores like a text without a matched
clause; a null id is held out of nothing and scored; repeated rows score alike;
without usable labels the seed weights hold; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import ALNUM, Words, mix, scan, slices, word_hashes

#: At most so many labelled rows are fitted on.
SAMPLE = 24_000
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.7
#: A negation reaches over at most so many words to the next grammar word.
SCOPE = 6

#: Terminal classes; GAP stands between two of them that are more than SCOPE words apart.
NONE, INSULT, THREAT, TARGET, NEGATION, REPORT, GAP = range(7)
#: Seed terminals (fixed values).
SEEDS = {
    INSULT: "idiot moron loser scum trash stupid pathetic worthless disgusting clown",
    THREAT: "kill hurt destroy beat burn attack shoot töten umbringen matar tuer frapper",
    TARGET: "you your yourself they them he she him her these those people du dich ihr euch sie tú usted ustedes ellos tu vous ils elles",
    NEGATION: "not no never isn aren nicht kein keine nie nunca ni pas jamais aucun",
    REPORT: "said says wrote quoted claimed called reported sagte schrieb dijo dice dit écrit",
}

#: Categories a clause can have; each is insult or threat, with or without a target, plain, negated or reported.
CATEGORIES = tuple(f"{what}{aim}{how}" for what in ("insult", "threat") for aim in ("", "+target") for how in ("", "+negated", "+reported"))


@dataclass(frozen=True)
class Machine:
    """A transducer of a clause: where a symbol leads from a state (it stays where nothing is said), and what the last state says."""

    start: str
    steps: dict[tuple[str, int], str]
    says: Callable[[str], bool]

    def step(self, state: str, symbol: int) -> str:
        return self.steps.get((state, symbol), state)


def _seen(symbol: int) -> Machine:
    return Machine("no", {("no", symbol): "yes"}, lambda s: s == "yes")


#: The grammar's transducers.
MACHINES = {
    "insult": _seen(INSULT),
    "threat": _seen(THREAT),
    "target": _seen(TARGET),
    "report": _seen(REPORT),
    # an insult or threat in an open scope is negated for good
    "negation": Machine(
        "closed",
        {("closed", NEGATION): "open", ("open", GAP): "closed", ("open", INSULT): "open, hit", ("open", THREAT): "open, hit", ("open, hit", GAP): "hit", ("hit", NEGATION): "open, hit"},
        lambda s: s.endswith("hit"),
    ),
}


def category(said: dict[str, bool]) -> int:
    """Place in CATEGORIES of what the transducers say, -1 for none."""
    if not (said["insult"] or said["threat"]):
        return -1
    what, how = 0 if said["insult"] else 1, 2 if said["report"] else 1 if said["negation"] else 0
    return what * 6 + said["target"] * 3 + how


def compose(machines: dict[str, Machine]) -> tuple[np.ndarray, np.ndarray]:
    """All machines at once: (state, symbol) -> state over their reachable joint states, the first being the start, and each state's category."""
    states = {tuple(m.start for m in machines.values()): 0}
    todo, table = list(states), []
    while todo:
        now = todo.pop(0)
        row = []
        for symbol in range(GAP + 1):
            after = tuple(m.step(s, symbol) for m, s in zip(machines.values(), now, strict=True))
            if after not in states:
                states[after] = len(states)
                todo.append(after)
            row.append(states[after])
        table.append(row)
    said = [category({n: m.says(s) for (n, m), s in zip(machines.items(), joint, strict=True)}) for joint in states]
    return np.array(table, dtype=np.uint8), np.array(said, dtype=np.int64)


TABLE, OUTPUT = compose(MACHINES)


def final_states(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state in which each run of symbols ends; first: where the runs begin."""
    maps = TABLE.T[symbols]
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(symbols))))
    while len(run) > len(first):
        place = np.arange(len(run)) - np.searchsorted(run, run)
        left = np.flatnonzero(place % 2 == 0)
        paired = (left + 1 < len(run)) & (run[np.minimum(left + 1, len(run) - 1)] == run[left])
        kept = maps[left]
        kept[paired] = np.take_along_axis(maps[left[paired] + 1], kept[paired].astype(np.int64), axis=1)
        maps, run = kept, run[left]
    return maps[:, 0]


@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    stems: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.array([2.5, 1.0, 1.5] * 4))
    slope: np.ndarray = field(default_factory=lambda: np.full(12, 0.5))
    bias: float = -1.2

    def score(self, counts: np.ndarray) -> np.ndarray:
        z = self.bias + features(counts) @ np.concatenate([self.weights, self.slope])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(counts: np.ndarray) -> np.ndarray:
    """Whether a category occurs, and the logarithm of how often beyond once."""
    return np.concatenate([(counts > 0).astype(float), np.log1p(np.maximum(counts - 1, 0))], axis=1)


def seeds() -> Model:
    pairs = [(w, c) for c, text in SEEDS.items() for w in text.split()]
    w = scan(pa.array([x for x, _ in pairs], pa.string()), ALNUM, lower=True)
    order = np.argsort(w.hashes)
    return Model(w.hashes[order], np.array([c for _, c in pairs])[order])


def stem_hashes(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, hash) of each word's beginning, for each length in STEMS, of longer words only."""
    out = []
    for k in STEMS:
        at = np.flatnonzero(w.ends - w.starts > k)
        out.append((at, mix(word_hashes(w.data, w.starts[at], w.starts[at] + k) ^ np.uint64(k * 0x9E37))))
    return out


def _member(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h), dtype=bool)
    return keys[np.searchsorted(keys, h).clip(max=len(keys) - 1)] == h


def classify(w: Words, model: Model) -> np.ndarray:
    """Terminal class of each word."""
    out = np.zeros(len(w.hashes), dtype=np.int64)
    if len(model.stems):
        for at, h in stem_hashes(w):
            out[at[_member(model.stems, h)]] = INSULT
    if len(model.words):
        i = np.searchsorted(model.words, w.hashes).clip(max=len(model.words) - 1)
        same = model.words[i] == w.hashes
        out[same] = model.classes[i[same]]
    return out


_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?;:\n"]] = True


def clause_counts(w: Words, model: Model) -> np.ndarray:
    """Rows x categories: matched clauses."""
    n = len(w.rows) - 1
    counts = np.zeros((n, len(CATEGORIES)), dtype=np.int64)
    classes = classify(w, model)
    some = np.flatnonzero(classes)
    if not some.size:
        return counts
    stops = np.cumsum(_STOP[w.data])
    clause = stops[w.starts[some]]
    row = np.searchsorted(w.rows, some, "right") - 1
    new = np.append(True, (clause[1:] != clause[:-1]) | (row[1:] != row[:-1]))
    far = ~new & (np.diff(some, prepend=0) > SCOPE)
    symbols = np.insert(classes[some], np.flatnonzero(far), GAP)
    first = np.flatnonzero(new)
    said = OUTPUT[final_states(symbols, first + np.cumsum(far)[first])]
    ok = said >= 0
    np.add.at(counts, (row[first[ok]], said[ok]), 1)
    return counts


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most SAMPLE labelled texts that may be learned from, those of smallest hash, one of each id."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    # SAMPLE rows of two numbers: a fixed bound for what is sent
    joined = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    one = joined.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("row"))
    return Scratch(docs.sparkSession, "sample").table(one.select("row.text", "row.toxic"), "sample")


def _counted(sample: DataFrame) -> DataFrame:
    """Document frequencies of words and stems: (kind, hash, rows, toxic rows)."""

    def run(batches):
        for b in slices(batches, "text"):
            w = scan(b.column("text"), ALNUM, lower=True)
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)
            row = w.row_of()
            for kind, (at, h) in enumerate([(np.arange(len(w.hashes)), w.hashes), *stem_hashes(w)]):
                pairs = np.unique(np.stack([row[at].astype(np.uint64), h]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
                keys, inverse = np.unique(pairs[1], return_inverse=True)
                df = np.bincount(inverse, minlength=len(keys))
                tox = np.bincount(inverse, weights=toxic[pairs[0].astype(np.int64)], minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int64)), pa.array(keys.view(np.int64)), pa.array(df), pa.array(tox)], names=["kind", "hash", "rows", "toxic"])

    return sample.mapInArrow(run, "kind long, hash long, rows long, toxic long").groupBy("kind", "hash").agg(F.sum("rows").alias("rows"), F.sum("toxic").alias("toxic"))


def _fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method; the bias is not shrunk."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    beta = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def fit(docs: DataFrame, labels: DataFrame, least: int = 3) -> Model:
    """Learn the insult lexicon and the clause weights."""
    spark = docs.sparkSession
    sample = _sample(docs, labels)
    model = seeds()
    totals = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, toxic = int(totals["n"] or 0), int(totals["toxic"] or 0)
    if not toxic or toxic == n:
        return model
    rate = toxic / n
    ratio = (F.col("toxic") + 0.1 * rate) / (F.col("rows") + 0.1)
    # far more often toxic than by chance: precision, support and a likelihood ratio
    strong = _counted(sample).where((F.col("toxic") >= least) & (ratio >= 0.85) & (F.col("toxic") * F.log(ratio / rate) >= 6.0))
    # words of several toxic rows of the sample: as bounded as the sample is
    learned = strong.select("kind", "hash").collect()
    words = np.unique(np.array([r["hash"] for r in learned if r["kind"] == 0], dtype=np.int64).view(np.uint64))
    fresh = words[~_member(model.words, words)]
    order = np.argsort(np.concatenate([model.words, fresh]))
    model.words, model.classes = np.concatenate([model.words, fresh])[order], np.concatenate([model.classes, np.full(len(fresh), INSULT)])[order]
    model.stems = np.unique(np.array([r["hash"] for r in learned if r["kind"]], dtype=np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast(pickle.dumps(model))

    def count(batches):
        own = pickle.loads(sent.value)
        for b in slices(batches, "text"):
            c = clause_counts(scan(b.column("text"), ALNUM, lower=True), own)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(c.tolist(), pa.list_(pa.int64()))], names=["toxic", "counts"])

    rows = sample.select("text", "toxic").mapInArrow(count, "toxic int, counts array<long>").collect()
    x, y = features(np.array([r["counts"] for r in rows], dtype=np.int64)), np.array([r["toxic"] for r in rows], dtype=float)
    beta, model.bias = _fit_weights(x, y)
    # a category never seen in the sample keeps its seed weight
    seen = (x > 0).any(axis=0)
    k = len(CATEGORIES)
    model.weights = np.where(seen[:k], beta[:k], model.weights)
    model.slope = np.where(seen[k:], beta[k:], 0.0)
    return model


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, score, the number of matched clauses and the carried columns."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(pickle.dumps(model))
    d = docs.select("doc_id", *(["text"] if "text" not in carry else []), *[c for c in carry if c != "doc_id"])
    keep = [f for f in d.schema.fields if f.name in ("doc_id", *carry)]

    def run(batches):
        own = pickle.loads(sent.value)
        for b in slices(batches, "text"):
            c = clause_counts(scan(b.column("text"), ALNUM, lower=True), own)
            yield pa.RecordBatch.from_arrays([*[b.column(f) for f in names], pa.array(own.score(c)), pa.array(c.sum(axis=1))], names=[*names, "score", "n_clauses"])

    names = [f.name for f in keep]
    schema = d.select(*names).schema.add("score", "double").add("n_clauses", "long")
    return d.mapInArrow(run, schema)


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_clauses")


def remainder(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3
