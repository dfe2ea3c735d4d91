"""Run governance on the driver: hashes, the experiment registry, freezes, address checks, phase order.

Nothing here touches data; all of it is small files and dictionaries.
"""

from __future__ import annotations

import csv
import fcntl
import hashlib
import io
import json
import os
import re
from collections.abc import Callable, Collection, Mapping
from datetime import datetime
from pathlib import Path
from urllib.parse import urlsplit

from asofgraph.sources.tables import write_json

# The registry's columns in order, and the exit codes of a run.
REGISTRY_FIELDS = (
    "experiment_id", "timestamp", "phase", "sample_period", "signal_name", "direction", "horizon",
    "edge_weighting", "residual_model", "controls", "purpose", "pre_specified", "result_artifact",
)
EXIT_CODES = {"COMPLETE": 0, "FAILED": 1, "BLOCKED": 2, "INFEASIBLE_DATA": 3, "INVALID": 4}
_SHA256 = re.compile(r"[0-9a-f]{64}")


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, NaN refused: equal values, equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def config_hash(config: Mapping) -> str:
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()


def file_hash(path: str | Path) -> str:
    with open(path, "rb") as source:
        return hashlib.file_digest(source, "sha256").hexdigest()


def tree_manifest(root: str | Path, skip: Collection[str] = (".git", "__pycache__")) -> dict[str, str]:
    """Digest by relative path of every file below ``root``; links are refused."""
    found = {}
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n not in skip)
        for name in sorted(files):
            path = Path(folder, name)
            if path.is_symlink():
                raise ValueError(f"link in source tree: {path}")
            found[path.relative_to(root).as_posix()] = file_hash(path)
    return found


def require_digest(value: str, label: str) -> str:
    if not isinstance(value, str) or not _SHA256.fullmatch(value):
        raise ValueError(f"{label} must be 64 lower-case hexadecimal digits")
    return value


def require_official_url(value: str, hosts: Collection[str], path: str | None = None) -> str:
    """The address itself if it is https on exactly an approved host, without user, port or fragment."""
    parts = urlsplit(value if isinstance(value, str) and value == value.strip() else "")
    official = parts.scheme == "https" and (parts.hostname or "") in {h.lower() for h in hosts} and parts.netloc.lower() == parts.hostname and not parts.fragment
    if not official or path is not None and (parts.path != path or parts.query):
        raise ValueError(f"not an approved address: {value!r}")
    return value


class Registry:
    """Append-only CSV of experiments with a companion digest; a changed or incomplete file is refused."""

    def __init__(self, path: str | Path):
        self.path, self.seal = Path(path), Path(f"{path}.integrity.json")

    @staticmethod
    def _text(rows: list[dict[str, str]]) -> str:
        out = io.StringIO()
        writer = csv.DictWriter(out, REGISTRY_FIELDS, lineterminator="\n")
        writer.writeheader()
        writer.writerows(rows)
        return out.getvalue()

    def verify(self) -> list[dict[str, str]]:
        if not self.path.exists() and not self.seal.exists():
            return []
        text, seal = self.path.read_text(encoding="utf-8"), json.loads(self.seal.read_text(encoding="utf-8"))
        rows = list(csv.DictReader(io.StringIO(text)))
        ids = [r["experiment_id"] for r in rows]
        if hashlib.sha256(text.encode()).hexdigest() != seal["registry_sha256"] or len(rows) != seal["row_count"] or self._text(rows) != text or len(set(ids)) < len(ids):
            raise ValueError("the registry isn't what was sealed")
        return rows

    def append(self, entry: Mapping[str, object]) -> None:
        if set(entry) != set(REGISTRY_FIELDS) or any(str(v).strip() == "" for v in entry.values()):
            raise ValueError("an entry has exactly the registry's fields, none blank")
        with open(f"{self.path}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
            rows = self.verify()
            if any(r["experiment_id"] == str(entry["experiment_id"]) for r in rows):
                raise ValueError(f"experiment {entry['experiment_id']} is there already")
            text = self._text([*rows, {k: str(entry[k]) for k in REGISTRY_FIELDS}])
            part = Path(f"{self.path}.part")
            part.write_text(text, encoding="utf-8")
            os.replace(part, self.path)
            write_json({"format_version": 1, "registry_sha256": hashlib.sha256(text.encode()).hexdigest(), "row_count": len(rows) + 1}, str(self.seal))


def freeze(path: str | Path, frozen_at: str, source: str, config: str, registry: str, candidate: bool) -> dict:
    """Writes the fingerprint that holdout data may be opened against."""
    at = datetime.fromisoformat(frozen_at.replace("Z", "+00:00"))
    if at.tzinfo is None or not isinstance(candidate, bool):
        raise ValueError("a freeze needs an aware time and a boolean candidate flag")
    value = {"frozen_at": at.isoformat(), "source_tree_sha256": require_digest(source, "source"), "config_sha256": require_digest(config, "config"),
             "experiment_registry_sha256": require_digest(registry, "registry"), "portfolio_candidate": candidate}
    write_json(value, str(path))
    return value


def authorize_holdout(path: str | Path, source: str, config: str, registry: str) -> dict:
    """The freeze, if it still fits source, configuration and registry; else an error."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if (value["source_tree_sha256"], value["config_sha256"], value["experiment_registry_sha256"]) != (source, config, registry):
        raise PermissionError("the freeze doesn't fit this state")
    return value


def run_phases(phases: Mapping[int, Callable[[], str]], done: Mapping[int, Mapping], key: str, through: int) -> tuple[dict[int, str], int]:
    """Runs phases in order; one recorded complete under the same key is reused, the first other state ends the run."""
    states: dict[int, str] = {}
    for number in sorted(p for p in phases if p <= through):
        known = done.get(number, {})
        states[number] = known["state"] if known.get("key") == key and known["state"] in ("COMPLETE", "INFEASIBLE_DATA") else phases[number]()
        if states[number] != "COMPLETE":
            return states, EXIT_CODES[states[number]]
    return states, 0
