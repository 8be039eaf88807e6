"""Values of configuration files in one form: a blank or missing one is None, a single one is a list of one."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path


def text_of(value: object) -> str | None:
    return str(value).strip() or None if value is not None else None


def texts_of(value: object) -> list[str] | None:
    """Texts without blank ones; None where none is left."""
    several = value if isinstance(value, Iterable) and not isinstance(value, (str, bytes)) else [value]
    return [t for t in map(text_of, several) if t] or None


def int_of(value: object) -> int | None:
    return None if text_of(value) is None else int(str(value).strip())


def ints_of(value: object) -> list[int] | None:
    """Of a list, or of a text with commas."""
    parts = texts_of(value.split(",") if isinstance(value, str) else value)
    return parts and [int(p) for p in parts]


def flag_of(value: object) -> bool | None:
    """The words for yes and no."""
    if isinstance(value, bool) or value is None:
        return value
    word = str(value).strip().casefold()
    if word in ("1", "true", "yes", "on"):
        return True
    if word in ("0", "false", "no", "off"):
        return False
    if word:
        raise ValueError(f"neither yes nor no: {value!r}")
    return None


def path_of(value: object) -> str | None:
    text = text_of(value)
    return text and str(Path(text).expanduser())
