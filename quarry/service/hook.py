"""A hook that brings an index up to date after each commit, and never stops one."""

from __future__ import annotations

import os
import shlex
import sys

NAME = "post-commit"


def script(store: str, python: str = sys.executable) -> str:
    return f"""#!/bin/sh
root=$(git rev-parse --show-toplevel) || exit 0
{shlex.quote(python)} -m quarry index "$root" --store {shlex.quote(store)} >/dev/null 2>&1 || true
exit 0
"""


def install(repository: str, store: str) -> str:
    """Writes the hook into a repository; one that is there already, and isn't this, is an error."""
    path = os.path.join(repository, ".git", "hooks", NAME)
    wanted = script(store)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if f.read() != wanted:
                raise FileExistsError(f"{path} is another hook")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(wanted)
    os.chmod(path, 0o755)
    return path
