"""Manifests: which files make which tables, and the questions of a challenge."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from .discover import is_identifier
from .formats import detect


class ManifestError(ValueError):
    pass


@dataclass(frozen=True)
class Question:
    id: str
    revision: int
    title: str
    prompt: str
    accepted: tuple[str, ...]
    case_sensitive: bool = False


@dataclass(frozen=True)
class DatasetConfig:
    name: str
    table: str
    path: str
    format: str
    source: str = ""
    source_path: str = ""
    timestamp_path: str = ""
    timestamp_format: str = ""
    indexed_paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class Manifest:
    challenge: str = ""
    flag: str = ""
    cooldown_s: float = 3.0
    full_text_index: bool = False
    questions: tuple[Question, ...] = ()
    datasets: tuple[DatasetConfig, ...] = field(default=())


_TOP = {"challengeName", "flag", "submissionCooldown", "fullTextIndex", "questions", "datasets"}
_QUESTION = {"id", "revision", "title", "prompt", "acceptedAnswers", "caseSensitive"}
_DATASET = {"name", "table", "path", "format", "source", "sourcePath", "timestampPath", "timestampFormat", "indexedPaths"}
MAX_NAME, MAX_QUESTIONS, MAX_FLAG, MAX_COOLDOWN_S = 120, 100, 512, 60


def _known(value: object, keys: set[str], what: str) -> dict:
    if not isinstance(value, dict):
        raise ManifestError(f"{what} must be a mapping")
    if extra := set(value) - keys:
        raise ManifestError(f"unknown key {sorted(map(str, extra))[0]} in {what}")
    return value


def _seconds(text: object) -> float:
    if text in (None, ""):
        return 3.0
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h)", str(text))
    if not parts or "".join(a + b for a, b in parts) != str(text):
        raise ManifestError(f"invalid submissionCooldown {text!r}")
    return sum(float(n) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600}[u] for n, u in parts)


def indexed_path(path: str) -> str:
    """A dotted path of identifiers."""
    if not path or not all(s.isascii() and is_identifier(s) for s in path.split(".")):
        raise ManifestError(f"invalid indexed path {path!r}")
    return path


def parse(text: str, folder: str = ".") -> Manifest:
    """A checked manifest from YAML or JSON; paths are taken from ``folder`` and stay below it."""
    try:
        raw = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ManifestError("YAML manifests need a YAML library; JSON needs none") from e
        try:
            raw = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ManifestError(f"invalid manifest: {e}") from e
    top = _known(raw or {}, _TOP, "the manifest")
    challenge = str(top.get("challengeName") or "").strip()
    if len(challenge) > MAX_NAME:
        raise ManifestError(f"challengeName exceeds {MAX_NAME} characters")
    questions = tuple(_question(q) for q in top.get("questions") or ())
    flag = str(top.get("flag") or "")
    if len(questions) > MAX_QUESTIONS:
        raise ManifestError(f"more than {MAX_QUESTIONS} questions")
    if len({q.id for q in questions}) < len(questions):
        raise ManifestError("question ids must be unique")
    if bool(questions) != bool(flag):
        raise ManifestError("questions and flag come together")
    if len(flag) > MAX_FLAG:
        raise ManifestError(f"flag exceeds {MAX_FLAG} characters")
    cooldown = _seconds(top.get("submissionCooldown"))
    if not 0 <= cooldown <= MAX_COOLDOWN_S:
        raise ManifestError(f"submissionCooldown must be at most {MAX_COOLDOWN_S} s")
    datasets = tuple(_dataset(d, folder) for d in top.get("datasets") or ())
    names = [d.name for d in datasets]
    if len(set(names)) < len(names):
        raise ManifestError("dataset names must be unique")
    casing: dict[str, str] = {}
    for d in datasets:
        if casing.setdefault(d.table.lower(), d.table) != d.table:
            raise ManifestError(f"table {d.table} is also written {casing[d.table.lower()]}")
    return Manifest(challenge, flag, cooldown, bool(top.get("fullTextIndex")), questions, datasets)


def _question(raw: object) -> Question:
    q = _known(raw, _QUESTION, "a question")
    id_ = str(q.get("id") or "")
    if not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", id_):
        raise ManifestError(f"invalid question id {id_!r}")
    answers = tuple(str(a).strip() for a in q.get("acceptedAnswers") or ())
    revision = int(q.get("revision") or 0)
    if not answers or not all(answers):
        raise ManifestError(f"question {id_} needs accepted answers")
    if revision < 1 or not q.get("title") or not q.get("prompt"):
        raise ManifestError(f"question {id_} needs a revision, a title and a prompt")
    return Question(id_, revision, str(q["title"]), str(q["prompt"]), answers, bool(q.get("caseSensitive")))


def _dataset(raw: object, folder: str) -> DatasetConfig:
    d = _known(raw, _DATASET, "a dataset")
    name, table, path = (str(d.get(k) or "").strip() for k in ("name", "table", "path"))
    if not name or not path:
        raise ManifestError("a dataset needs a name and a path")
    if not is_identifier(table):
        raise ManifestError(f"table {table!r} is not an identifier")
    if table.lower() == "events":
        raise ManifestError("table Events is reserved")
    if os.path.isabs(path) or os.path.normpath(path).startswith(".."):
        raise ManifestError(f"path {path} leaves the manifest's folder")
    source, source_path = str(d.get("source") or ""), str(d.get("sourcePath") or "")
    if bool(source) == bool(source_path):
        raise ManifestError(f"dataset {name} needs either source or sourcePath")
    if not d.get("timestampPath"):
        raise ManifestError(f"dataset {name} needs a timestampPath")
    try:
        format_ = detect(path, str(d.get("format") or "auto"))
    except ValueError as e:
        raise ManifestError(str(e)) from e
    indexed = tuple(sorted({indexed_path(str(p)) for p in d.get("indexedPaths") or ()}))
    return DatasetConfig(name, table, f"{folder.rstrip('/')}/{os.path.normpath(path)}", format_, source, source_path, str(d["timestampPath"]), str(d.get("timestampFormat") or ""), indexed)
