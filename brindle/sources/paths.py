"""Path helpers for the driver."""

from __future__ import annotations

import os


def join(directory: str, name: str) -> str:
    return os.path.join(directory, name)


def directory_name(path: str) -> str:
    return os.path.dirname(path)


def file_name(path: str) -> str:
    return os.path.basename(path)
