"""A small store of settings on the driver: nested values by dotted path, kept versions, atomic writes."""

from __future__ import annotations

import json
import os
from datetime import datetime
from pathlib import Path
from typing import Any


class Settings:
    """Settings in a JSON file; every change keeps the version before it, at most ``keep``."""

    def __init__(self, path: str, keep: int = 20):
        self.path, self.keep = Path(path), keep

    def load(self) -> dict[str, Any]:
        return json.loads(self.path.read_text("utf-8")) if self.path.exists() else {}

    def get(self, dotted: str, default: Any = None) -> Any:
        node: Any = self.load()
        for part in dotted.split("."):
            if not isinstance(node, dict) or part not in node:
                return default
            node = node[part]
        return node

    def set(self, dotted: str, value: Any) -> None:
        data = self.load()
        *above, last = dotted.split(".")
        node = data
        for part in above:
            node = node.setdefault(part, {})
        node[last] = value
        self.save(data)

    def delete(self, dotted: str) -> bool:
        data = self.load()
        *above, last = dotted.split(".")
        node: Any = data
        for part in above:
            node = node.get(part) if isinstance(node, dict) else None
        if not isinstance(node, dict) or last not in node:
            return False
        del node[last]
        self.save(data)
        return True

    def versions(self) -> list[Path]:
        return sorted(self.path.parent.glob(self.path.name + ".v*"), key=lambda p: int(p.suffix[2:]))

    def save(self, data: dict[str, Any]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        old = self.versions()
        if self.path.exists():
            number = int(old[-1].suffix[2:]) + 1 if old else 1
            self.path.with_name(f"{self.path.name}.v{number}").write_text(self.path.read_text("utf-8"), "utf-8")
        fresh = self.path.with_name(self.path.name + ".new")
        fresh.write_text(json.dumps(data, ensure_ascii=False, indent=2), "utf-8")
        os.replace(fresh, self.path)
        for stale in self.versions()[: -self.keep]:
            stale.unlink()

    def backup(self, keep: int = 10) -> Path | None:
        """A copy of the settings named by the time, at most ``keep`` of them; none where there are no settings yet."""
        if not self.path.exists():
            return None
        copy = self.path.with_name(f"{self.path.name}.{datetime.now():%Y%m%dT%H%M%S%f}.bak")
        copy.write_text(self.path.read_text("utf-8"), "utf-8")
        for stale in sorted(self.path.parent.glob(self.path.name + ".*.bak"))[:-keep]:
            stale.unlink()
        return copy

    def rollback(self) -> bool:
        """Puts the last kept version back."""
        old = self.versions()
        if not old:
            return False
        os.replace(old[-1], self.path)
        return True


def clean_key(key: str) -> str:
    """An API key without quotes and scheme."""
    out = key.strip().strip("\"'").strip()
    return out[7:].strip() if out.lower().startswith("bearer ") else out


def endpoint(url: str, suffix: str) -> str:
    """``url`` ending in ``suffix``."""
    base = url.strip().rstrip("/")
    return base if base.endswith(suffix) else base + suffix
