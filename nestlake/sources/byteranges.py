"""Ranges of bytes of a file, wherever it lies: local disk, an HTTP server that serves ranges, or a scheme that a user adds."""

from __future__ import annotations

import os
import re
import urllib.request
from collections.abc import Callable
from pathlib import Path


class LocalFile:
    """A file of this machine or of a mounted store."""

    def __init__(self, path: str):
        self.file = open(path.removeprefix("file://").removeprefix("file:"), "rb")  # noqa: SIM115 - close() ends it
        self.size = os.fstat(self.file.fileno()).st_size

    def read(self, seek: int, n: int) -> bytes:
        self.file.seek(seek)
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()


def bearer_token() -> str | None:
    """A token for HTTP servers: $BEARER_TOKEN, else the file that $BEARER_TOKEN_FILE names, else bt_u<uid> in $XDG_RUNTIME_DIR or /tmp."""
    if found := os.environ.get("BEARER_TOKEN", "").strip():
        return found
    named = os.environ.get("BEARER_TOKEN_FILE")
    places = [named] if named else [f"{d}/bt_u{os.getuid()}" for d in (os.environ.get("XDG_RUNTIME_DIR"), "/tmp") if d]
    for p in places:
        if Path(p).is_file():
            return Path(p).read_text().strip() or None
    return None


class HttpFile:
    """A file on an HTTP(S) server, read by Range requests."""

    def __init__(self, url: str, timeout: float = 60):
        self.url, self.timeout = url, timeout
        token = bearer_token()
        self.headers = {"Authorization": f"Bearer {token}"} if token else {}
        with self._get(0, 1) as r:
            total = r.headers.get("Content-Range", "").rpartition("/")[2]
            if r.status != 206 or not total.isdigit():
                raise OSError(f"no byte ranges from {url}")
            self.size = int(total)

    def _get(self, seek: int, n: int):
        ask = urllib.request.Request(self.url, headers={**self.headers, "Range": f"bytes={seek}-{seek + n - 1}"})
        return urllib.request.urlopen(ask, timeout=self.timeout)  # noqa: S310 - the scheme has been looked at

    def read(self, seek: int, n: int) -> bytes:
        n = min(n, self.size - seek)
        if n <= 0:
            return b""
        with self._get(seek, n) as r:
            return r.read()

    def close(self) -> None:
        pass


def _no_client(url: str):
    raise NotImplementedError(f"no client for {url}; add one with register_scheme")


#: Schemes and what opens them: called with the whole path, it gives an object with size, read(seek, n) and close().
_schemes: dict[str, Callable] = {"file": LocalFile, "http": HttpFile, "https": HttpFile, "root": _no_client}


def register_scheme(scheme: str, opener: Callable) -> None:
    """Open paths of `scheme` by opener(path). It must be importable on executors, as each task opens the file anew."""
    _schemes[scheme] = opener


def open_bytes(path: str):
    """What reads ranges of the file at `path`; a path without a scheme is local."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if m is None:
        return LocalFile(path)
    if m[1].lower() not in _schemes:
        raise ValueError(f"unknown scheme {m[1]}")
    return _schemes[m[1].lower()](path)
