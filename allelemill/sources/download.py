"""Fetching of public reference files: in pieces, resumed where the server allows it, tried again, checked by digest."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from pathlib import Path

from .reference import md5_matches


def fetch(url: str, target: str, digest_url: str | None = None, attempts: int = 3, timeout: float = 3600.0, wait: float = 2.0) -> str:
    """The file of a URL under the name target, which appears only when it is whole; OSError after the last attempt.

    digest_url names a file that starts with the MD5 digest. A file that is there already and agrees with it is kept."""
    out, part = Path(target), Path(f"{target}.part")
    out.parent.mkdir(parents=True, exist_ok=True)
    error: Exception | None = None
    for attempt in range(attempts):
        if attempt:
            time.sleep(wait)
        try:
            digest = urllib.request.urlopen(digest_url, timeout=timeout).read().decode() if digest_url else None
            if out.exists() and (digest is None or md5_matches(str(out), digest)):
                return target
            have = part.stat().st_size if part.exists() else 0
            ask = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
            with urllib.request.urlopen(ask, timeout=timeout) as src, open(part, "ab" if have and getattr(src, "status", None) == 206 else "wb") as f:
                while piece := src.read(1 << 20):
                    f.write(piece)
            if digest and not md5_matches(str(part), digest):
                part.unlink()
                raise OSError(f"{url} does not agree with its digest")
            part.replace(out)
            return target
        except (OSError, urllib.error.URLError) as e:
            error = e
    raise OSError(f"{url} could not be fetched in {attempts} attempts: {error}")
