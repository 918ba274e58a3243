"""Settings of the frame pipeline, from the environment or a file of `KEY=value` lines; the environment wins."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

IDENTIFIERS = ("embedding", "classical", "ensemble")
PREFIX = "GLEANER_"


@dataclass(frozen=True)
class Settings:
    frames_dir: str = "frames"
    confidence_threshold: float = 0.5
    identifier: str = "embedding"


def load(env_file: str | None = None, environ: Mapping[str, str] | None = None, prefix: str = PREFIX) -> Settings:
    """Keys start with `prefix`. Unknown keys are ignored; a value that does not fit is an error."""
    found: dict[str, str] = {}
    if env_file and Path(env_file).exists():
        for line in Path(env_file).read_text().splitlines():
            key, sep, value = line.partition("=")
            if sep and not key.lstrip().startswith("#"):
                found[key.strip().upper()] = value.strip().strip("\"'")
    found |= {k.upper(): v for k, v in (os.environ if environ is None else environ).items()}
    own = {k.removeprefix(prefix).lower(): v for k, v in found.items() if k.startswith(prefix)}
    settings = Settings(own.get("frames_dir", Settings.frames_dir), float(own.get("confidence_threshold", Settings.confidence_threshold)), own.get("identifier", Settings.identifier).lower())
    if settings.identifier not in IDENTIFIERS:
        raise ValueError(f"identifier is one of {', '.join(IDENTIFIERS)}, not {settings.identifier}")
    if not 0 <= settings.confidence_threshold <= 1:
        raise ValueError("confidence_threshold is between 0 and 1")
    return settings
