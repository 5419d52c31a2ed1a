"""Datasets to Parquet: normalise, discover fields, extract time and source, shred root fields.

Each dataset is written whole or not at all: it goes to a staging folder, the
lowest failing record is looked for, and only then the folder and the catalogue
take the place of the old ones.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions import values
from trailspark.functions.values import BOOL, DATETIME, DYNAMIC, LONG, REAL, STRING, Value
from trailspark.operators.relation import ColumnInfo, Relation

from . import discover, jsontext, times
from .catalog import Catalog
from .formats import MAX_EVENT, MAX_INPUT, InputError, expanded_size, records
from .manifest import DatasetConfig, Manifest
from .store import Store

#: Records whose fields are discovered in full.
SAMPLE = 5000
#: Root fields beyond this many are read from the record's text.
MAX_SHREDDED = 400
#: Records that a task holds as objects at a time.
_ROWS = 1024
_KINDS = {"bool": BOOL, "long": LONG, "real": REAL, "string": STRING, "dynamic": DYNAMIC, "mixed": DYNAMIC, "null": STRING}
_ARROW = {BOOL: pa.bool_(), LONG: pa.int64(), REAL: pa.float64(), STRING: pa.string(), DYNAMIC: pa.string()}


@dataclass
class Dataset:
    id: int
    config: DatasetConfig
    signature: str
    path: str
    count: int
    #: Catalogue: path as keys joined by NUL -> type.
    fields: dict[str, str]
    #: Physical column of each shredded root field and indexed path.
    columns: dict[str, str]

    def types(self) -> dict[tuple[str, ...], str]:
        return {tuple(k.split("\0")): v for k, v in self.fields.items()}


def signature(config: DatasetConfig, size: int, changed: str) -> str:
    return hashlib.sha256(json.dumps([asdict(config), size, changed], sort_keys=True).encode()).hexdigest()


def _sample(raw: DataFrame) -> list[tuple[int, str]]:
    """The first SAMPLE records and, after them, the first record of each new set of root keys."""
    head = raw.where(F.col("record_no") <= SAMPLE)
    keys = F.array_sort(F.json_object_keys(F.when(F.try_parse_json("raw").isNotNull(), F.col("raw"))))
    late = raw.where(F.col("record_no") > SAMPLE).select("record_no", "raw", keys.alias("k")).where("k is not null")
    firsts = late.groupBy("k").agg(F.min_by("raw", "record_no").alias("raw"), F.min("record_no").alias("record_no"))
    known = head.select(keys.alias("k")).where("k is not null").distinct()
    new = firsts.join(known, "k", "left_anti").select("record_no", "raw")
    return sorted((r["record_no"], r["raw"]) for r in head.where("raw is not null").select("record_no", "raw").union(new).collect())


def _discover(sample: list[tuple[int, str]]) -> tuple[dict[tuple[str, ...], str], list[tuple[int, tuple[str, ...]]], set[int]]:
    """(fields, embedded paths with the record that showed each first, record numbers of the sample)."""
    fields: dict[tuple[str, ...], str] = {}
    paths: dict[tuple[str, ...], int] = {}
    for n, text in sample:
        try:
            value = jsontext.loads(text)
        except (ValueError, RecursionError):
            continue
        if not isinstance(value, dict):
            continue
        found: set[tuple[str, ...]] = set()
        value, _ = jsontext.normalize(value, None, found)
        for p in found:
            paths.setdefault(p, n)
        discover.walk(value, fields)
    return fields, sorted((n, p) for p, n in paths.items()), {n for n, _ in sample}


def _cell(text: str | None, kind: str):
    """A shredded value from its JSON text."""
    if text is None or text == "null":
        return None
    if kind == DYNAMIC:
        return text
    value = jsontext.loads(text)
    if kind == BOOL:
        return value if isinstance(value, bool) else None
    if kind == LONG:
        if not isinstance(value, jsontext.Number):
            return None
        try:
            n = int(value)
        except ValueError:
            return None
        return n if -(2**63) <= n < 2**63 else None
    if kind == REAL:
        return float(value) if isinstance(value, jsontext.Number) else None
    return jsontext.plain(value)


def _prepare(config: DatasetConfig, roots: dict[str, str], names: dict[str, str], paths: list[tuple[int, tuple[str, ...]]], sampled: set[int]):
    time_keys = jsontext.split_path(config.timestamp_path)
    source_keys = jsontext.split_path(config.source_path) if config.source_path else None
    columns = [(root, _KINDS[kind]) for root, kind in roots.items()]
    indexed = [(p, p.split(".")) for p in config.indexed_paths if "." in p]

    def one(n: int, text: str):
        if len(text.encode()) > MAX_EVENT:
            raise InputError(f"event exceeds {MAX_EVENT} bytes")
        value = jsontext.loads(text)
        if not isinstance(value, dict):
            raise InputError("record is not an object")
        known = None if n in sampled else {p for first, p in paths if n >= first}
        value, changed = jsontext.normalize(value, known) if known is None or known else (value, False)
        raw = jsontext.dumps(value) if changed else jsontext.minify(text)
        ok, at = jsontext.at_path(value, time_keys)
        if not ok or at is None:
            raise InputError(f"no timestamp at {config.timestamp_path}")
        nanos = times.parse(jsontext.plain(at), isinstance(at, jsontext.Number), config.timestamp_format)
        source = config.source
        if source_keys is not None:
            ok, found = jsontext.at_path(value, source_keys)
            source = jsontext.plain(found) if ok else ""
            if not source.strip():
                raise InputError(f"no source at {config.source_path}")
        parts = jsontext.members(raw)
        cells = [_cell(parts.get(root), kind) for root, kind in columns]
        for _, keys in indexed:
            ok, found = jsontext.at_path(value, keys)
            cells.append(jsontext.plain(found) if ok and found is not None else None)
        return nanos // 1000, times.text_of(nanos), source, raw, cells

    def run(batches):
        kinds = [_ARROW[k] for _, k in columns] + [pa.string() for _ in indexed]
        labels = [names[r] for r, _ in columns] + [names[p] for p, _ in indexed]
        for b in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            out = []
            for n, text, error in zip(b.column("record_no").to_pylist(), b.column("raw").to_pylist(), b.column("error").to_pylist(), strict=True):
                row = (None, None, None, None, [None] * len(kinds))
                if error is None:
                    try:
                        row = one(n, text)
                    except (ValueError, RecursionError, OverflowError) as e:
                        error = str(e)
                out.append((n, *row[:4], error, *row[4]))
            types = [pa.int64(), pa.timestamp("us"), pa.string(), pa.string(), pa.string(), pa.string(), *kinds]
            cols = list(map(list, zip(*out, strict=True))) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(t) if pa.types.is_timestamp(t) else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["record_no", "TimeGenerated", "time_ns", "Source", "RawData", "error", *labels])

    spark_kinds = [values.SPARK[k] for _, k in columns] + ["string" for _ in indexed]
    fields = [f"`{names[r]}` {t}" for r, t in zip([r for r, _ in columns] + [p for p, _ in indexed], spark_kinds, strict=True)]
    return run, ", ".join(["record_no long, TimeGenerated timestamp_ntz, time_ns string, Source string, RawData string, error string", *fields])


class Workspace:
    """Imported datasets under one folder, and the tables they make."""

    def __init__(self, spark: SparkSession, root: str, max_input: int = MAX_INPUT):
        self.spark, self.store, self.max_input = spark, Store(spark, root), max_input
        self.datasets: list[Dataset] = []
        text = self.store.read_text(self._catalog_path)
        if text:
            for d in json.loads(text):
                config = DatasetConfig(**{**d.pop("config")})
                self.datasets.append(Dataset(config=DatasetConfig(**{**asdict(config), "indexed_paths": tuple(config.indexed_paths)}), **d))

    @property
    def _catalog_path(self) -> str:
        return self.store.join("catalog.json")

    def _save(self) -> None:
        self.store.write_text(self._catalog_path, json.dumps([asdict(d) for d in self.datasets]))

    def load(self, manifest: Manifest) -> list[str]:
        """Import what changed, drop what is gone; returns the names that were imported."""
        todo = []
        current = {d.config.name: d for d in self.datasets}
        for c in manifest.datasets:
            size, changed = self.store.stat(c.path)
            sig = signature(c, size, changed)
            old = current.get(c.name)
            if old is None or old.signature != sig:
                todo.append((c, sig))
        for c, sig in todo:
            self.import_(c, sig)
        wanted = {c.name for c in manifest.datasets}
        for d in [d for d in self.datasets if d.config.name not in wanted]:
            self.datasets.remove(d)
            self._save()
            self.store.delete(d.path)
        return [c.name for c, _ in todo]

    def import_(self, config: DatasetConfig, sig: str = "") -> Dataset:
        """One dataset, whole or not at all."""
        if config.table.lower() == "events":
            raise InputError("table Events is reserved")
        spark = self.spark
        # names below the path; those that Spark's readers pass over do not count
        files = [(name, size) for name, size, _ in self.store.files(config.path) if not any(part.startswith(("_", ".")) for part in name.split("/"))]
        packed = any(name.lower().endswith(".gz") for name, _ in files) or config.path.lower().endswith(".gz")
        # the limit is a file's: a folder may hold any number of them
        if not packed and max((size for _, size in files), default=0) > self.max_input or packed and config.format == "json" and expanded_size(spark, config.path) > self.max_input:
            raise InputError(f"expanded input exceeds the {self.max_input} byte limit")
        if config.format != "json" and min((size for _, size in files), default=0) == 0:
            raise InputError(f"decode {config.format} input: the file is empty")
        raw = records(spark, config.path, config.format, self.max_input)
        fields, paths, sampled = _discover(_sample(raw))
        roots = dict(list(discover.root_columns(fields).items())[:MAX_SHREDDED])
        names = {r: f"f{i}_{r}" for i, r in enumerate(roots)} | {p: f"x{i}_{p}" for i, p in enumerate(config.indexed_paths) if "." in p}
        run, schema = _prepare(config, roots, names, paths, sampled)
        staging = self.store.join("staging", uuid.uuid4().hex)
        try:
            prepared = raw.mapInArrow(run, schema).sortWithinPartitions("TimeGenerated")
            writer = prepared.write
            for p in config.indexed_paths:
                if p in names:
                    # equality on an indexed field skips row groups
                    writer = writer.option(f"parquet.bloom.filter.enabled#{names[p]}", "true")
            writer.parquet(staging)
            written = spark.read.parquet(staging)
            totals = written.agg(F.count("*").alias("n"), F.min_by(F.struct("record_no", "error"), F.when(F.col("error").isNotNull(), F.col("record_no"))).alias("bad")).first()
            if totals["bad"] is not None and totals["bad"]["error"] is not None:
                raise InputError(f"record {totals['bad']['record_no']}: {totals['bad']['error']}")
            number = max((d.id for d in self.datasets), default=0) + 1
            final = self.store.join("datasets", f"{number:06d}-{uuid.uuid4().hex[:8]}")
            self.store.rename(staging, final)
        except BaseException:
            self.store.delete(staging)
            raise
        made = Dataset(number, config, sig, final, int(totals["n"]), {"\0".join(k): v for k, v in fields.items()}, names)
        old = [d for d in self.datasets if d.config.name == config.name]
        self.datasets = [d for d in self.datasets if d.config.name != config.name] + [made]
        self._save()
        for d in old:
            self.store.delete(d.path)
        return made

    # -- tables
    def _columns(self, datasets: list[Dataset]) -> dict[str, str]:
        """Root fields of a table with their types; a type that differs between datasets is dynamic."""
        seen: dict[str, set[str]] = {}
        for d in datasets:
            for p, t in d.types().items():
                if len(p) == 1:
                    seen.setdefault(p[0], set()).add(t)
        merged = {(k,): next(iter(t)) if len(t) == 1 else "mixed" for k, t in seen.items()}
        return discover.root_columns(merged)

    def _frame(self, d: Dataset, columns: dict[str, str]) -> DataFrame:
        """A dataset with a table's columns, each in the table's type."""
        own = {p[0]: t for p, t in d.types().items() if len(p) == 1}
        df = self.spark.read.parquet(d.path)
        out = [F.col("TimeGenerated"), F.col("time_ns"), F.col("Source"), F.col("RawData")]
        for name, kind in columns.items():
            want = _KINDS[kind]
            if name not in own:
                c = F.lit(None).cast(values.SPARK[want])
            else:
                have = _KINDS[own[name]]
                v = Value(F.col(f"`{d.columns[name]}`"), have) if name in d.columns else values.convert(values.member(Value(F.col("RawData"), DYNAMIC), name), have)
                c = v.column if have == want else values.convert(v, want).column
            out.append(c.alias(name))
        for p in sorted({p for x in self.datasets for p in x.config.indexed_paths if "." in p}):
            out.append((F.col(f"`{d.columns[p]}`") if p in d.columns else F.get_json_object("RawData", "$" + "".join(f"['{k}']" for k in p.split(".")))).alias(f"__ix_{p}"))
        return df.select(*out)

    def _relation(self, datasets: list[Dataset], columns: dict[str, str]) -> Relation:
        frames = [self._frame(d, columns) for d in datasets]
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f)
        infos = [ColumnInfo("TimeGenerated", DATETIME), ColumnInfo("Source", STRING), ColumnInfo("RawData", DYNAMIC), *[ColumnInfo(n, _KINDS[t]) for n, t in columns.items()]]
        indexes = {p: f"__ix_{p}" for d in self.datasets for p in d.config.indexed_paths if "." in p}
        return Relation(df, tuple(infos), "RawData", indexes)

    def catalog(self) -> Catalog:
        """All tables and Events, their union."""
        out = Catalog()
        tables: dict[str, list[Dataset]] = {}
        for d in self.datasets:
            tables.setdefault(d.config.table, []).append(d)
        union: dict[str, set[str]] = {}
        for name, datasets in sorted(tables.items()):
            columns = self._columns(datasets)
            out.add(name, self._relation(datasets, columns))
            for c, t in columns.items():
                union.setdefault(c, set()).add(_KINDS[t])
        if self.datasets:
            folded: dict[str, int] = {}
            for c in union:
                folded[c.lower()] = folded.get(c.lower(), 0) + 1
            back = {v: k for k, v in reversed(_KINDS.items())}
            shared = {c: back[next(iter(t))] if len(t) == 1 else "mixed" for c, t in union.items() if folded[c.lower()] == 1}
            out.add("Events", self._relation(self.datasets, dict(sorted(shared.items(), key=lambda x: x[0].lower()))))
        return out

    def fields(self) -> dict:
        """The field catalogue: common paths and paths by table, as queries write them."""
        by_table: dict[str, dict[str, set[str]]] = {}
        for d in self.datasets:
            columns = self._columns([x for x in self.datasets if x.config.table == d.config.table])
            into = by_table.setdefault(d.config.table, {})
            for p, t in d.types().items():
                into.setdefault(discover.catalogue_path(p, columns), set()).add(t)
        tables = {t: [{"path": p, "type": next(iter(k)) if len(k) == 1 else "mixed"} for p, k in sorted(f.items())] for t, f in sorted(by_table.items())}
        common = [{"path": "TimeGenerated", "type": "datetime"}, {"path": "Source", "type": "string"}, {"path": "RawData", "type": "dynamic"}]
        return {"common": common, "tables": tables}
