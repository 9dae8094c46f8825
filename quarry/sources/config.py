"""The registry of projects and other small JSON files on the driver's side."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Sequence
from typing import NamedTuple


class Project(NamedTuple):
    name: str
    path: str
    added_at: str = ""


def default_name(path: str) -> str:
    """The last part of a path, whichever way its slashes lean."""
    return path.replace("\\", "/").rstrip("/").rpartition("/")[2] or "project"


def write_json(path: str, value: object) -> None:
    """Replaces a file as a whole: readers see the old one or the new one."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, draft = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2)
            f.write("\n")
        os.replace(draft, path)
    except BaseException:
        os.unlink(draft)
        raise


def read_json(path: str) -> dict:
    """An object from a file; empty if there is none, an error if it is no JSON object."""
    try:
        with open(path, encoding="utf-8") as f:
            value = json.load(f)
    except FileNotFoundError:
        return {}
    except ValueError as error:
        raise ValueError(f"{path} is not JSON: {error}") from None
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no JSON object")
    return value


def merge_entry(path: str, section: str, name: str, entry: object) -> dict:
    """Sets one entry of a section of somebody else's file and keeps all the rest; broken files are left alone."""
    whole = read_json(path)
    part = whole.get(section)
    whole[section] = (part if isinstance(part, dict) else {}) | {name: entry}
    write_json(path, whole)
    return whole


def load_registry(path: str) -> list[Project]:
    """Projects of a registry file; none if it is missing. A blank name is taken from the path."""
    entries = read_json(path).get("projects") or []
    return [Project(e.get("name") or default_name(e.get("path", "")), e.get("path", ""), e.get("added_at", "")) for e in entries]


def save_registry(path: str, projects: Sequence[Project], default: str = "") -> None:
    write_json(path, {"default": default, "projects": [p._asdict() for p in projects]})


def find_project(projects: Sequence[Project], asked: str, default: str = "") -> Project | None:
    """By name, by name in any case, by absolute path, by path as written; blank means the default if it is known, else the first."""
    wanted = asked.strip()
    if not wanted:
        known = find_project(projects, default) if default.strip() else None
        return known or (projects[0] if projects else None)
    tests = (
        lambda p: p.name == wanted,
        lambda p: p.name.casefold() == wanted.casefold(),
        lambda p: os.path.abspath(p.path) == os.path.abspath(wanted),
        lambda p: p.path == wanted,
    )
    return next((p for test in tests for p in projects if test(p)), None)
