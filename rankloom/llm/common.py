"""Helpers that the operators share: input tables, the shared folder, staged tables."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rankloom.sources.workspace import fresh_dir, shared_root, staged  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def task_memory(*caches):
    """A task's word caches: cleared at its end, and what was freed given back to the system. A worker process serves the
    tasks of many operators, and would hold it for all of them."""
    try:
        yield
    finally:
        for cache in caches:
            cache.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not this C library: its own way of giving back must do
            pass


def local_path(uri: str) -> str | None:
    """The plain path of a folder on a mounted file system, or None for a store that needs a client."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def open_store(uri: str):
    """``(filesystem, path)`` of pyarrow for any other kind of store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def filtered(docs: DataFrame, load, keep) -> DataFrame:
    """The rows of ``docs``, all columns as they are, for which ``keep(model, text)`` says True; ``load()`` is the model, which
    has a cache of ``words``."""
    at = docs.columns.index("text")

    def run(batches):
        model = load()
        with task_memory(model.words):
            for b in batches:
                yield b.filter(pa.array([keep(model, t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
