"""Tables by name: the first source that has a name serves it, in any case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Loader = Callable[[], DataFrame]


class Router:
    def __init__(self):
        self.sources: list[tuple[str, dict[str, Loader]]] = [("tables", {})]

    def add(self, name: str, loader: Loader, source: str = "tables") -> None:
        for s, tables in self.sources:
            if s == source:
                tables[name.lower()] = loader
                return
        self.sources.append((source, {name.lower(): loader}))

    def find(self, name: str) -> Loader | None:
        return next((tables[name.lower()] for _, tables in self.sources if name.lower() in tables), None)

    def source_of(self, name: str) -> str | None:
        return next((s for s, tables in self.sources if name.lower() in tables), None)

    def names(self) -> list[str]:
        return list(dict.fromkeys(n for _, tables in self.sources for n in tables))


class Chain:
    """Executors in order; the first that can handle a request does."""

    def __init__(self, *executors: tuple[Callable[[str], bool], Callable[[str], DataFrame]]):
        self.executors = executors

    def run(self, request: str) -> DataFrame:
        for can, execute in self.executors:
            if can(request):
                return execute(request)
        raise ValueError("No executor can handle this request")
