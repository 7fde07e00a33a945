"""Small keyed stores on the driver: debounced JSON, a summary log, work memory."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import time
from pathlib import Path
from typing import Any


class KeyValueStore:
    """Set, get, delete, all, replace; written at most every ``pause`` seconds and at exit, atomically.

    A missing or broken file is an empty store.
    """

    def __init__(self, path: str, pause: float = 0.5, clock=time.monotonic):
        self.path, self.pause, self.clock = Path(path), pause, clock
        self.last, self.dirty = float("-inf"), False
        try:
            data = json.loads(self.path.read_text("utf-8"))
            self.data: dict[str, Any] = data if isinstance(data, dict) else {}
        except (OSError, ValueError):
            self.data = {}
        atexit.register(self.flush)

    def _changed(self) -> None:
        self.dirty = True
        if self.clock() - self.last >= self.pause:
            self.flush()

    def set(self, key: str, value: Any) -> None:
        self.data[key] = value
        self._changed()

    def all(self) -> dict[str, Any]:
        return dict(self.data)

    def get(self, key: str, default: Any = None) -> Any:
        return self.data[key] if key in self.data else default

    def delete(self, key: str) -> bool:
        there = self.data.pop(key, None) is not None
        if there:
            self._changed()
        return there

    def replace(self, data: dict[str, Any]) -> None:
        self.data = dict(data)
        self._changed()

    def flush(self) -> None:
        if not self.dirty:
            return
        self.path.parent.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(dir=self.path.parent)
        os.close(handle)
        Path(name).write_bytes(json.dumps(self.data, ensure_ascii=False).encode())
        os.replace(name, self.path)
        self.dirty, self.last = False, self.clock()


class FactStore:
    """A flat façade: add, add_many, all, search, clear; facts are distinct and keep their order."""

    def __init__(self, store: KeyValueStore, key: str = "__facts__"):
        self.store, self.key = store, key

    def all(self) -> list[str]:
        return list(self.store.get(self.key, []))

    def add_many(self, facts: list[str]) -> int:
        known = dict.fromkeys(self.all())
        before = len(known)
        known.update(dict.fromkeys(f.strip() for f in facts if f and f.strip()))
        self.store.set(self.key, list(known))
        return len(known) - before

    def add(self, fact: str) -> bool:
        return self.add_many([fact]) > 0

    def search(self, query: str) -> list[str]:
        return [f for f in self.all() if query.lower() in f.lower()]

    def clear(self) -> None:
        self.store.set(self.key, [])


class DailyFacts:
    """H08 for one user: the bucket is emptied when the day changes; ``today`` is passed in."""

    def __init__(self, store: KeyValueStore, key: str = "__daily__"):
        self.store, self.key = store, key

    def facts(self, today: str) -> list[str]:
        bucket = self.store.get(self.key)
        return list(bucket["facts"]) if isinstance(bucket, dict) and bucket.get("date") == today else []

    def append(self, facts: list[str], today: str) -> list[str]:
        merged = list(dict.fromkeys([*self.facts(today), *facts]))
        self.store.set(self.key, {"date": today, "facts": merged})
        return merged


def append_summary(path: str, text: str, now: str) -> None:
    """P10: a dated section at the end of a log."""
    section = f"\n## {now}\n\n{text.strip()}\n"
    with Path(path).open("ab") as log:
        log.write(section.encode())


def prompt(facts: list[str], values: dict[str, Any], skill: str | None, sources: list[str], value_chars: int = 200, names: int = 8) -> str:
    """What a system prompt says about memory, the matching skill and the knowledge base."""
    parts = []
    if facts:
        parts.append("\n- ".join(["Known facts:", *facts]))
    if values:
        parts.append("Notes:\n" + "\n".join(f"- {k}: {str(v)[:value_chars]}" for k, v in values.items() if not k.startswith("__")))
    if skill:
        parts.append(f"Skill: {skill}")
    if sources:
        more = len(sources) - names
        parts.append("Knowledge base: " + ", ".join(sources[:names]) + (f" and {more} more" if more > 0 else ""))
    return "\n\n".join(parts)
