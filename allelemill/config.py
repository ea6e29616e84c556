"""Settings that persist: where reference entries and chain tables lie. Kept in a JSON file."""

from __future__ import annotations

import json
import os
import warnings
from pathlib import Path

KEYS = ("reference_path", "chain_path")


def config_file() -> Path:
    """The settings file: in the folder that ALLELEMILL_CONFIG_DIR names, else in the user's configuration folder."""
    return Path(os.environ.get("ALLELEMILL_CONFIG_DIR") or Path.home() / ".config" / "allelemill") / "config.json"


def load() -> dict[str, str]:
    """All settings; unreadable or missing ones are empty."""
    try:
        got = json.loads(config_file().read_text())
        return got if isinstance(got, dict) else {}
    except (OSError, ValueError):
        return {}


def _set(key: str, path: str | os.PathLike) -> str:
    path = str(Path(path).expanduser().absolute())
    if not Path(path).exists():
        raise FileNotFoundError(path)
    now = load() | {key: path}
    config_file().parent.mkdir(parents=True, exist_ok=True)
    config_file().write_text(json.dumps(now, indent=1))
    return path


def _get(key: str, warn: bool) -> str | None:
    path = load().get(key)
    if path is None and warn:
        warnings.warn(f"{key} is not set", stacklevel=3)
    return path


def set_reference_path(path: str | os.PathLike) -> str:
    return _set("reference_path", path)


def reference_path(warn: bool = True) -> str | None:
    return _get("reference_path", warn)


def set_chain_path(path: str | os.PathLike) -> str:
    return _set("chain_path", path)


def chain_path(warn: bool = True) -> str | None:
    return _get("chain_path", warn)


def reset() -> None:
    config_file().unlink(missing_ok=True)
