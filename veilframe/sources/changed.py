"""Files that changed in a working tree, and options from a file: both read on the driver, once."""

from __future__ import annotations

import json
import os
import subprocess
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame


def changed_files(folder: str, staged: bool = False, seconds: int = 10) -> list[str]:
    """Absolute paths that git reports as changed (or staged); none where git fails."""
    try:
        done = subprocess.run(["git", "-C", folder, "diff", "--name-only", "--relative", *(["--staged"] if staged else [])], capture_output=True, text=True, timeout=seconds, check=True)
    except (OSError, subprocess.SubprocessError):
        return []
    return [os.path.join(os.path.abspath(folder), x) for x in done.stdout.splitlines() if x]


def changed_or_staged(folder: str) -> list[str]:
    return sorted({*changed_files(folder), *changed_files(folder, True)})


def newly_changed(changed: DataFrame, staged: DataFrame, before: DataFrame) -> DataFrame:
    """path of the files that are changed or staged now and were neither before (columns path), each once."""
    return changed.select("path").union(staged.select("path")).distinct().join(before.select("path").distinct(), "path", "left_anti")


@dataclass(frozen=True)
class Options:
    """What a run is asked for. engine: see detect(); safe: unite overlaps; strict_names: ask more of names."""

    engine: str = "hybrid"
    safe: bool = False
    strict_names: bool = True
    project: str = ""
    vault: str = ""


OPTION_FILES = (".veilframe.json", "veilframe.json", ".veilframe.yaml", "veilframe.yaml")


def find_options(folder: str) -> str | None:
    """The nearest option file in a folder or one above it."""
    at = os.path.abspath(folder)
    while True:
        for name in OPTION_FILES:
            if os.path.isfile(os.path.join(at, name)):
                return os.path.join(at, name)
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def load_options(folder: str) -> Options:
    """Options of the nearest file, defaults for what it doesn't name; unknown names raise an error."""
    path = find_options(folder)
    if path is None:
        return Options()
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            given = json.load(f)
        else:
            import yaml

            given = yaml.safe_load(f) or {}
    unknown = set(given) - {f.name for f in fields(Options)}
    if unknown:
        raise ValueError(f"{path}: unknown options {', '.join(sorted(unknown))}")
    return Options(**given)


def save_options(options: Options, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({x.name: getattr(options, x.name) for x in fields(Options)}, f, indent=2, ensure_ascii=False)


def create_options(folder: str) -> str:
    """Writes an option file with the defaults, where none is, and returns its path."""
    path = os.path.join(folder, OPTION_FILES[1])
    if not os.path.exists(path):
        save_options(Options(), path)
    return path
