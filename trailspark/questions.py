"""Questions of a challenge: attempts, cooldown, progress, and the flag at the end."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
from dataclasses import dataclass

from trailspark.sources.manifest import Manifest, Question


@dataclass
class Progress:
    revision: int
    attempts: int = 0
    last: dt.datetime | None = None
    solved: dt.datetime | None = None
    answer: str | None = None


class Challenge:
    """Shared progress; ``progress`` may be kept and given back, and a new revision starts a question again."""

    def __init__(self, manifest: Manifest, progress: dict[str, Progress] | None = None):
        self.manifest = manifest
        kept = progress or {}
        self.progress = {q.id: kept[q.id] if q.id in kept and kept[q.id].revision == q.revision else Progress(q.revision) for q in manifest.questions}

    def state(self) -> dict:
        solved = sum(p.solved is not None for p in self.progress.values())
        done = bool(self.progress) and solved == len(self.progress)
        return {
            "challengeName": self.manifest.challenge,
            "questions": [{"id": q.id, "title": q.title, "prompt": q.prompt, "attempts": self.progress[q.id].attempts, "solved": self.progress[q.id].solved is not None, "answer": self.progress[q.id].answer} for q in self.manifest.questions],
            "solved": solved,
            "total": len(self.progress),
            "flag": self.manifest.flag if done else None,
        }

    @staticmethod
    def _digest(q: Question, text: str) -> bytes:
        trimmed = text.strip()
        return hashlib.sha256((trimmed if q.case_sensitive else trimmed.casefold()).encode()).digest()

    def submit(self, id_: str, answer: str, now: dt.datetime) -> dict:
        q = next((q for q in self.manifest.questions if q.id == id_), None)
        if q is None:
            raise KeyError(id_)
        p = self.progress[id_]
        if p.solved is not None:
            return {"correct": False, "alreadySolved": True, "retryAfter": 0.0, "state": self.state()}
        if p.last is not None and (wait := self.manifest.cooldown_s - (now - p.last).total_seconds()) > 0:
            return {"correct": False, "alreadySolved": False, "retryAfter": wait, "state": self.state()}
        given = self._digest(q, answer)
        # every accepted answer is compared, in constant time
        correct = any([hmac.compare_digest(self._digest(q, a), given) for a in q.accepted])
        p.attempts += 1
        p.last = now
        if correct:
            p.solved, p.answer = now, answer.strip()
        return {"correct": correct, "alreadySolved": False, "retryAfter": 0.0, "state": self.state()}
