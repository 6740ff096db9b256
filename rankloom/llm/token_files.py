"""Token-ID output: flat unsigned integer files, 64-bit document offsets, prefix-summed bases, memory-mapped reading.

Format, for each part: ``<part>.bin`` holds the ids of its documents back to back (unsigned 16-bit little-endian if the
vocabulary allows, else 32-bit), ``<part>.idx`` holds n+1 64-bit offsets into it, ``<part>.doc`` the n document ids (the
least 64-bit integer stands for null). A manifest table has one row a part: its file, counts, first key and base, which
is the number of ids in all parts before it. A part that a lost executor left half-written is in no manifest.

Cases: null text counts as empty and yields the end id alone; null doc_id sorts first; rows that share a doc_id are
ordered by a hash of their text and keep one entry each; an empty table gives an empty manifest; other columns are
ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import byte_bpe, common

NULL_ID = -(2**63)
MANIFEST = "file string, first_id long, first_hash long, n_docs long, n_tokens long, width int"


def _put(uri: str, pieces) -> None:
    path = common.local_path(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            for p in pieces:
                out.write(p)
        return
    fs, path = common.open_store(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        for p in pieces:
            out.write(p)


def _get(uri: str, dtype) -> np.ndarray:
    """The file as an array: mapped into memory on a mounted file system, else fetched."""
    path = common.local_path(uri)
    if path:
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    fs, path = common.open_store(uri)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Writes all documents in ascending doc_id order; returns the manifest with ``base``."""

    def write(batches):
        bpe = byte_bpe.loaded(tokenizer_path)
        name = f"{out_dir}/part-{uuid.uuid4().hex}"
        first, ids, lengths = None, [], []

        def tokens():
            nonlocal first
            for b in batches:
                keys = b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                if first is None and len(keys):
                    first = (int(keys[0]), b.column(1)[0].as_py())
                ids.append(keys)
                texts = b.column(2)
                for low, high in byte_bpe.slices(texts):
                    flat, at = bpe.encode(texts.slice(low, high - low))
                    lengths.append(np.diff(at) + 1)
                    yield np.insert(flat, at[1:], end_id).tobytes()

        with common.task_memory(bpe):
            _put(name + ".bin", tokens())
        if first is None:
            return
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        _put(name + ".idx", [offsets.tobytes()])
        _put(name + ".doc", [np.concatenate(ids).astype("<i8").tobytes()])
        row = [[name], [first[0]], [first[1]], [len(offsets) - 1], [int(offsets[-1])], [bpe.dtype.itemsize]]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["file", "first_id", "first_hash", "n_docs", "n_tokens", "width"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    manifest = common.staged(ordered.mapInArrow(write, MANIFEST), "manifest")
    # one row a file: the window over all of them is small at any size of the corpus
    before = Window.orderBy("first_id", "first_hash").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row a document, read from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = _get(r["file"] + ".bin", f"<u{r['width']}")
                offsets, docs = _get(r["file"] + ".idx", "<i8"), _get(r["file"] + ".doc", "<i8")
                for low in range(0, len(docs), 20_000):
                    high = min(low + 20_000, len(docs))
                    at = offsets[low : high + 1].tolist()
                    crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(at, at[1:])]
                    own = np.array(docs[low:high])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(np.array(at[:-1]) + r["base"], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return read_token_files(write_token_files(docs, common.fresh_dir(spark, "tokens"), byte_bpe.default_path()))
