"""Runs named modules in order of what they need, passing over finished ones."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import complete, manifest_row, write_table


@dataclass(frozen=True)
class Module:
    """A table made by build(spark, inputs); inputs are the tables that it needs, by name."""

    name: str
    build: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()


@dataclass
class Runner:
    spark: SparkSession
    folder: str
    modules: dict[str, Module] = field(default_factory=dict)

    def add(self, name: str, build, needs: Iterable[str] = (), partition_by: Iterable[str] = ()) -> None:
        self.modules[name] = Module(name, build, tuple(needs), tuple(partition_by))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def levels(self, only: Iterable[str] | None = None) -> list[list[str]]:
        """Modules in waves: each needs only modules of waves before it."""
        wanted: set[str] = set()

        def visit(name: str, trail: tuple[str, ...] = ()) -> None:
            if name in trail:
                raise ValueError(f"modules need each other: {' -> '.join((*trail, name))}")
            if name in self.modules and name not in wanted:
                for n in self.modules[name].needs:
                    visit(n, (*trail, name))
                wanted.add(name)

        for name in only or list(self.modules):
            if name not in self.modules:
                raise KeyError(name)
            visit(name)
        out: list[list[str]] = []
        done: set[str] = set()
        while done < wanted:
            ready = [n for n in self.modules if n in wanted and n not in done and all(x in done or x not in self.modules for x in self.modules[n].needs)]
            out.append(ready)
            done |= set(ready)
        return out

    def run(self, only: Iterable[str] | None = None, *, force: bool = False, parallel: int = 4) -> DataFrame:
        """Run; a module that fails does not stop those that do without it. Returns the manifest."""
        status: dict[str, tuple[str, float, str]] = {}

        def one(name: str) -> None:
            module, began = self.modules[name], time.perf_counter()
            if not force and complete(self.spark, self.path(name)):
                status[name] = ("skip", 0.0, "")
                return
            broken = [n for n in module.needs if status.get(n, ("ok",))[0] in ("fail", "blocked")]
            if broken:
                status[name] = ("blocked", 0.0, f"needs {', '.join(broken)}")
                return
            try:
                inputs = {n: self.spark.read.parquet(self.path(n)) for n in module.needs}
                write_table(module.build(self.spark, inputs), self.path(name), module.partition_by)
                status[name] = ("ok", time.perf_counter() - began, "")
            except Exception as e:  # any failure is one of the module
                status[name] = ("fail", time.perf_counter() - began, str(e).splitlines()[0][:300])

        for wave in self.levels(only):
            with ThreadPoolExecutor(max(1, min(parallel, len(wave)))) as pool:
                list(pool.map(one, wave))
        out = None
        for name, (state, seconds, message) in status.items():
            row = manifest_row(self.spark, name, state, seconds, message)
            out = row if out is None else out.unionByName(row)
        write_table(out, self.path("_manifest"), mode="append")
        return out
