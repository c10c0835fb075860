"""Report sinks: small results as one JSON document, and the run log as JSON lines."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path


def write_report(path: str | os.PathLike, report: dict | list) -> None:
    """Written beside the target and swapped in one step."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, suffix=".tmp")
    with os.fdopen(handle, "w") as f:
        json.dump(report, f, indent=1, default=str)
    os.replace(name, target)


def append_run(path: str | os.PathLike, run: dict) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("a") as f:
        f.write(json.dumps(run, default=str) + "\n")
