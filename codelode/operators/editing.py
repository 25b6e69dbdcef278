"""Edits of single files: syntax check, backup, unified diff. Many files at once: scalars.replace_lines and find_replace."""

from __future__ import annotations

import difflib
import re
import shutil
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from codelode import schemas as S
from codelode.operators.parse import PARSERS


@dataclass
class Edit:
    """result: success, failure or syntax_error."""

    result: str
    message: str
    diff: str | None = None


def syntax_error(path: str, content: str) -> str | None:
    """What is wrong with a file's syntax, as far as its language's parser can tell."""
    parser = PARSERS.get(S.LANGUAGES.get(Path(path).suffix, ""))
    try:
        if parser:
            parser(content)
    except (SyntaxError, ValueError) as e:
        return str(e)
    return None


def unified_diff(old: str, new: str, name: str) -> str:
    return "".join(difflib.unified_diff(old.splitlines(keepends=True), new.splitlines(keepends=True), f"a/{name}", f"b/{name}"))


def _write(path: Path, old: str, new: str, backups: Path | None) -> Edit:
    if wrong := syntax_error(path.name, new):
        return Edit("syntax_error", f"the new text has an error: {wrong}", unified_diff(old, new, path.name))
    if backups and path.exists():
        backups.mkdir(parents=True, exist_ok=True)
        shutil.copy2(path, backups / f"{path.name}.{datetime.now(UTC):%Y%m%d%H%M%S%f}.bak")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(new, encoding="utf-8")
    return Edit("success", f"wrote {path}", unified_diff(old, new, path.name))


def replace_lines(path: str, first: int, last: int, new: str, backups: str | None = None) -> Edit:
    """Replaces lines first to last (from 1)."""
    p = Path(path)
    if not p.is_file():
        return Edit("failure", f"no such file: {path}")
    old = p.read_text(encoding="utf-8")
    lines = old.splitlines(keepends=True)
    if not 1 <= first <= last <= len(lines):
        return Edit("failure", f"lines {first} to {last} are not in a file of {len(lines)}")
    text = new if not new or new.endswith("\n") else new + "\n"
    return _write(p, old, "".join([*lines[: first - 1], text, *lines[last:]]), Path(backups) if backups else None)


def find_and_replace(path: str, pattern: str, replacement: str, backups: str | None = None) -> Edit:
    p = Path(path)
    if not p.is_file():
        return Edit("failure", f"no such file: {path}")
    old = p.read_text(encoding="utf-8")
    try:
        new, n = re.subn(pattern, replacement, old)
    except re.error as e:
        return Edit("failure", f"not a pattern: {e}")
    return _write(p, old, new, Path(backups) if backups else None) if n else Edit("failure", "the pattern is not in the file")


def create_file(path: str, content: str) -> Edit:
    p = Path(path)
    return Edit("failure", f"the file exists: {path}") if p.exists() else _write(p, "", content, None)
