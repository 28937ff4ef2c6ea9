"""Runs converters by name, each on its own, so that one that fails doesn't stop
the others."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from ..functions.rand import seeded
from .records import CONVERTERS

#: Sources of raw text and generation tasks by name, as converters are in CONVERTERS.
SOURCES: dict[str, Callable[..., DataFrame]] = {}
TASKS: dict[str, Callable[..., DataFrame]] = {}


def source(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        SOURCES[name] = f
        return f

    return add


def task(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        TASKS[name] = f
        return f

    return add


def convert_all(inputs: dict[str, tuple], only: Iterable[str] | None = None, sink: Callable[[str, DataFrame], None] | None = None, seed: int | str | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Records by converter and, for those that failed, why. inputs: what each
    converter takes; only: names to run (all, if none); sink: writes a
    converter's records, so that failures of its jobs are caught too; seed: of
    all draws, so that each converter draws anew with another one."""
    done: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for name in only or list(inputs):
        try:
            with seeded("" if seed is None else f"{seed}-{name}-"):
                got = CONVERTERS[name](*inputs[name])
            if sink is not None:
                sink(name, got)
            done[name] = got
        except Exception as e:  # whatever a source does, the others go on
            failed[name] = type(e).__name__
    return done, failed
