"""Stages in sequence: a failure skips what follows but for stages that always run; every stage is reported."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame


@dataclass
class Stage:
    name: str
    run: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
    always: bool = False
    #: What the stage says of its input before it runs.
    describe: Callable[[dict[str, DataFrame]], dict] | None = None


@dataclass
class Report:
    name: str
    status: str
    ms: int
    message: str = ""
    outputs: tuple[str, ...] = field(default=())
    input: dict = field(default_factory=dict)
    started_at: str = ""


def run_stages(stages: list[Stage], frames: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], list[Report]]:
    """The frames after all stages, and the reports. Stages declare plans; what fails here is planning or an action of their own."""
    reports, failed = [], False
    for s in stages:
        if failed and not s.always:
            reports.append(Report(s.name, "skipped", 0))
            continue
        began, stamp = time.perf_counter(), datetime.now(UTC).isoformat()
        said: dict = {}
        try:
            said = s.describe(frames) if s.describe else {}
            made = s.run(frames)
            frames = frames | made
            reports.append(Report(s.name, "done", round((time.perf_counter() - began) * 1000), outputs=tuple(made), input=said, started_at=stamp))
        except Exception as e:  # noqa: BLE001  reported, and what depends on it is skipped
            failed = True
            reports.append(Report(s.name, "failed", round((time.perf_counter() - began) * 1000), str(e)[:500], input=said, started_at=stamp))
    return frames, reports


def merged(base: dict, override: dict) -> dict:
    """A configuration with another one's values over it, level by level."""
    return {**base, **{k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in override.items()}}


class Registry:
    """Named query builders: the requested one, else the default, else `mock`."""

    def __init__(self, default: str):
        self.default, self.known = default, {}

    def add(self, name: str, build: Callable) -> None:
        self.known[name] = build

    def get(self, name: str | None) -> Callable:
        for n in (name, self.default, "mock"):
            if n in self.known:
                return self.known[n]
        raise KeyError(name)


def coerced(value, kind: str, default, name: str, warnings: list[str]):
    """A setting as bool, positive int, positive float or ratio (0 to 1); a value that is none gives the default and a warning."""
    try:
        if kind == "bool":
            if isinstance(value, bool):
                return value
            text = str(value).strip().lower()
            if text in ("1", "true", "yes", "on"):
                return True
            if text in ("0", "false", "no", "off"):
                return False
            raise ValueError(text)
        if isinstance(value, bool):
            raise ValueError(value)
        number = int(value) if kind == "int" else float(value)
        if (kind == "ratio" and not 0 <= number <= 1) or (kind != "ratio" and not number > 0):
            raise ValueError(value)
        return number
    except (TypeError, ValueError):
        if value is not None:
            warnings.append(f"{name}: {value!r} is no {kind}, {default!r} is used")
        return default
