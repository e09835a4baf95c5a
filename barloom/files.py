"""Durable small files."""

from __future__ import annotations

import json
import os
from pathlib import Path


def sync_path(path: Path) -> None:
    """Force a file's data, or a folder's entries, to the disk."""
    handle = os.open(path, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


def write_text(path: Path, text: str) -> None:
    """Replace the file as a whole; if anything fails the old one stays and no draft is left."""
    draft = path.with_name(path.name + ".tmp")
    try:
        with draft.open("w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.replace(draft, path)
    except OSError:
        draft.unlink(missing_ok=True)
        raise
    sync_path(path.parent)


def write_json(path: Path, value) -> None:
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False))
