"""Registered queries: every operator run over the given star-schema tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(sql: str | None = None):
    """Registers a function of the driver tables under its own name."""

    def add(run: Callable):
        from estatelake.registry.tables import Tables

        REGISTRY[run.__name__] = Entry(lambda spark, path: run(Tables(spark, path)), sql)
        return run

    return add


def load() -> dict[str, Entry]:
    from estatelake.registry import entities, ingest, pages, reads, streams, texts  # noqa: F401

    return REGISTRY
