"""Keeps evaluation data out of what corpora are built from."""

from __future__ import annotations

import posixpath
from urllib.parse import urlsplit


class ExternalDataError(ValueError):
    pass


def assert_not_external(path: str, external_roots: list[str], allow: bool = False) -> str:
    """The path, unless it lies under one of the roots; dot segments do not help."""
    clean = lambda p: posixpath.normpath(urlsplit(p).path or p)
    here = clean(path)
    if not allow and any(here == r or here.startswith(r.rstrip("/") + "/") for r in map(clean, external_roots)):
        raise ExternalDataError(f"{path} holds evaluation data")
    return path
