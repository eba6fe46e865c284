"""Where rule documents come from. Loading happens on the driver only."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

from ..plans.syntax import RuleError


class RuleSource(Protocol):
    def load(self, key: str) -> dict: ...


def read_document(text: str | bytes | dict) -> dict:
    """A rule document; cells are trimmed, unknown keys ignored."""
    doc = text if isinstance(text, dict) else json.loads(text)
    if not isinstance(doc, dict):
        raise RuleError("a rule document is an object")
    if "blocks" not in doc and "nodes" not in doc:
        raise RuleError("a rule document has nodes or blocks")
    return doc


def is_policy(doc: dict) -> bool:
    return "blocks" in doc


class NoSource:
    """The default: it has no documents."""

    def load(self, key: str) -> dict:
        raise RuleError(f"no source of rule documents, asked for {key!r}")


class MemorySource:
    def __init__(self, documents: dict[str, dict | str] | None = None):
        self.documents = dict(documents or {})

    def add(self, key: str, document: dict | str) -> None:
        self.documents[key] = document

    def get(self, key: str) -> dict | str | None:
        return self.documents.get(key)

    def remove(self, key: str) -> bool:
        return self.documents.pop(key, None) is not None

    def keys(self) -> list[str]:
        return sorted(self.documents)

    def load(self, key: str) -> dict:
        if key not in self.documents:
            raise RuleError(f"no rule document {key!r}")
        return read_document(self.documents[key])


class DirectorySource:
    """JSON files under a folder, by their path in it."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    def keys(self) -> list[str]:
        return sorted(p.relative_to(self.root).as_posix() for p in self.root.rglob("*.json"))

    def load(self, key: str) -> dict:
        path = (self.root / key).resolve()
        if not path.is_relative_to(self.root.resolve()) or not path.is_file():
            raise RuleError(f"no rule document {key!r}")
        return read_document(path.read_text())


class StoreSource:
    """JSON files in any store that Spark reads."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def load(self, key: str) -> dict:
        row = self.spark.read.text(f"{self.root}/{key}", wholetext=True).first()
        if row is None:
            raise RuleError(f"no rule document {key!r}")
        return read_document(row[0])


class ZipSource:
    """JSON files of a zip archive, given as a path or as bytes."""

    def __init__(self, archive: str | Path | bytes):
        import io

        with zipfile.ZipFile(io.BytesIO(archive) if isinstance(archive, bytes) else archive) as z:
            self.texts = {n: z.read(n) for n in z.namelist() if n.endswith(".json")}

    def keys(self) -> list[str]:
        return sorted(self.texts)

    def load(self, key: str) -> dict:
        if key not in self.texts:
            raise RuleError(f"no rule document {key!r}")
        return read_document(self.texts[key])


class CallableSource:
    def __init__(self, f: Callable[[str], dict | str]):
        self.f = f

    def load(self, key: str) -> dict:
        return read_document(self.f(key))


class CachedSource:
    """Keeps what another source loaded."""

    def __init__(self, source: RuleSource):
        self.source = source
        self.kept: dict[str, dict] = {}

    def load(self, key: str) -> dict:
        if key not in self.kept:
            self.kept[key] = self.source.load(key)
        return self.kept[key]

    def clear(self) -> None:
        self.kept.clear()


def source_from(config: dict) -> RuleSource:
    """{"type": "static", "content": {...}}, {"type": "fs", "path": ...} or {"type": "zip", "path": ...}."""
    kind = config.get("type")
    if kind == "static":
        return MemorySource(config.get("content"))
    if kind == "fs":
        return DirectorySource(config["path"])
    if kind == "zip":
        return ZipSource(config.get("content") or config["path"])
    raise RuleError(f"no source of type {kind!r}")
