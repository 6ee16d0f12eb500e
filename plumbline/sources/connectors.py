"""Sources of datasets by name: a connector is added by registering it, without touching the library.

A connector describes the objects that can be assessed and gives each as a
DataFrame with ``__row__``; it is told once when no more will be asked for, so that
it can give back what it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from .. import config
from .rowcsv import EXTENSIONS, files_of, read_csv, read_parquet


class SourceError(Exception):
    """A failure to show as it is: a code to branch on, and a message that says what to do next."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message = code, message


@dataclass(frozen=True)
class SourceObject:
    name: str
    label: str


class Connector(Protocol):
    def objects(self) -> list[SourceObject]: ...

    def read(self, name: str) -> DataFrame: ...

    def close(self, reason: str) -> None: ...


CONNECTORS: dict[str, Callable[..., Connector]] = {}


def connector(name: str):
    """Registers what makes a connector from (spark, **settings); a name may be taken once."""

    def keep(make):
        if name in CONNECTORS:
            raise ValueError(f"source {name} exists")
        CONNECTORS[name] = make
        return make

    return keep


def connect(spark: SparkSession, name: str, **settings) -> Connector:
    if name not in CONNECTORS:
        raise SourceError("unknown_source", f"no source is called {name}; there are {', '.join(sorted(CONNECTORS))}")
    return CONNECTORS[name](spark, **settings)


def datasets(source: Connector, names: Iterable[str], progress: Callable[[float, str], None] = lambda share, what: None, cancelled: Callable[[], bool] = lambda: False) -> Iterator[tuple[str, DataFrame | SourceError]]:
    """Each named object with its rows, or with the error that reading it gave; the others go on.

    Closes the source once, whatever happens, also where the caller stops early.
    """
    wanted, reason = list(dict.fromkeys(names)), "failed"
    try:
        if len(wanted) > config.ASSESSMENT_MAX_OBJECTS:
            raise SourceError("too_many_objects", f"choose at most {config.ASSESSMENT_MAX_OBJECTS} objects")
        known = {o.name: o.label for o in source.objects()}
        for k, name in enumerate(wanted):
            if cancelled():
                reason = "cancelled"
                return
            progress(k / len(wanted), known.get(name, name))
            if name not in known:
                yield name, SourceError("unknown_object", f"{name} is not among the objects of this source")
                continue
            try:
                got = source.read(name)
            except SourceError as e:
                got = e
            yield name, got
        progress(1.0, "")
        reason = "finished"
    except GeneratorExit:
        reason = "cancelled"
        raise
    finally:
        source.close(reason)


@connector("files")
class Files:
    """The delimited and Parquet files of a folder, each an object called by its name without the extension."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.paths = {Path(f).stem: f for f in files_of(path) if f.lower().endswith((*EXTENSIONS, ".parquet"))}

    def objects(self) -> list[SourceObject]:
        return [SourceObject(name, Path(path).name) for name, path in self.paths.items()]

    def read(self, name: str) -> DataFrame:
        path = self.paths[name]
        try:
            return read_parquet(self.spark, path) if path.lower().endswith(".parquet") else read_csv(self.spark, path).df
        except ValueError as e:
            raise SourceError("unreadable", str(e)) from e

    def close(self, reason: str) -> None:
        pass
