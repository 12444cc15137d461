"""Typed settings with defaults; read from TOML files merged in order."""

from __future__ import annotations

import dataclasses
import tomllib
from dataclasses import dataclass
from pathlib import Path

from chronofind.errors import EngineError


@dataclass(frozen=True)
class EngineConfig:
    """Settings of ingest, query and roll-up. Durations are seconds."""

    namespace: str = "default"
    shards: int = 10
    batch_seconds: int = 7200
    segment_full_duration: int = 86400
    start_epoch: int = 0
    polling_interval: int = 60
    rollup_size: int = 7
    rollup_start_epoch: int = 1
    response_size: int = 100_000
    input_path: str = ""
    store_path: str = ""
    rollup_path: str = ""
    max_files_per_trigger: int = 500

    def __post_init__(self) -> None:
        for name in ("shards", "batch_seconds", "segment_full_duration", "rollup_size", "response_size"):
            if getattr(self, name) <= 0:
                raise EngineError(f"{name} must be positive")

    @classmethod
    def load(cls, *paths: str) -> EngineConfig:
        """Later files win; missing files and unknown keys raise EngineError."""
        merged: dict[str, object] = {}
        for path in paths:
            try:
                merged |= tomllib.loads(Path(path).read_text())
            except (OSError, tomllib.TOMLDecodeError) as e:
                raise EngineError(f"cannot read settings from {path}: {e}") from e
        known = {f.name: type(f.default) for f in dataclasses.fields(cls)}
        if unknown := set(merged) - set(known):
            raise EngineError(f"unknown settings: {', '.join(sorted(unknown))}")
        for name, value in merged.items():
            if not isinstance(value, known[name]):
                raise EngineError(f"{name} must be of type {known[name].__name__}")
        return cls(**merged)
