"""Cross-tokenizer alignment: how the tokens of two vocabularies overlap in the bytes of each text.

A batch's tokens of either side are rows with their document and the byte where they start. ``merge_asof`` by document finds, for
each token's start, the other side's token that covers it; the union of both directions is all pairs that overlap. Where
both sides start a token (and so both have ended one) a new group begins.

How often a pair of ids is linked in the whole corpus needs a second step. The first writes, for slices of documents of bounded
size, the links of each document as numbers in a dictionary of pairs that some slices share, and these dictionaries. They are summed by
pair, each pair's count goes back to the dictionaries that have it, and slices meet their dictionary: neither text nor
single links are shuffled, and a frequent pair is one row for each dictionary.

Cases: null and empty text, and text whose bytes a vocabulary doesn't give back, has no tokens (numbers 0, groups '');
strings of special tokens are plain text; null and repeated doc_ids get a row each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_bpe, common

#: Bytes of text of a slice, and of the slices that share a dictionary.
SLICE_BYTES, DICTIONARY_BYTES = 3_000_000, 18_000_000

SLICED = "batch long, docs binary, links binary, at int, pair long, n long"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


class Vocabularies:
    """Both encoders of a worker process, with the bytes of each token and the decimal strings of ids."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_bpe.loaded(a_path, plain=True), byte_bpe.loaded(b_path, byte_bpe.PieceBpe)
        byte = {c: i for i, c in enumerate(byte_bpe.byte_symbols())}
        n = self.a.tokenizer.get_vocab_size()
        own = [self.a.tokenizer.id_to_token(i) or "" for i in range(n)]
        self.a_bytes = pa.array([bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in own], pa.binary())
        model = self.b.model
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.pieces)], pa.binary())
        self.lengths = [pc.binary_length(x).to_numpy().astype(np.int64) for x in (self.a_bytes, self.b_bytes)]
        self.decimal = pa.array([f"{i}{s}" for i in range(max(n, len(self.b.pieces))) for s in ",|;"])


_VOCABULARIES: dict[tuple, Vocabularies] = {}


def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    if (a_path, b_path) not in _VOCABULARIES:
        _VOCABULARIES[a_path, b_path] = Vocabularies(a_path, b_path)
    return _VOCABULARIES[a_path, b_path]


def _data(strings: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of an array that begins at its buffers' beginning."""
    _, offsets, data = strings.buffers()
    return np.frombuffer(offsets, np.int32, len(strings) + 1), memoryview(data if data is not None else b"")


class Side:
    """Tokens of a slice: ids, documents and starts."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, lengths: np.ndarray, keep: np.ndarray):
        n = np.diff(at)
        doc, size = np.repeat(np.arange(len(n)), n), lengths[ids]
        if not keep.all():
            kept = keep[doc]
            ids, doc, size = ids[kept], doc[kept], size[kept]
        self.ids, self.doc, self.n = ids.astype(np.int64), doc, np.where(keep, n, 0)
        self.start = np.cumsum(size) - size

    def covering(self, other: Side) -> np.ndarray:
        """For each token's start, the number of the other side's token that covers it."""
        own = pd.DataFrame({"start": self.start, "doc": self.doc}, copy=False)
        theirs = pd.DataFrame({"start": other.start, "doc": other.doc, "token": np.arange(len(other.ids))}, copy=False)
        return pd.merge_asof(own, theirs, on="start", by="doc")["token"].to_numpy(np.int64)


def _gives_back(table: pa.Array, ids: np.ndarray, at: np.ndarray, offsets: np.ndarray, data: memoryview) -> np.ndarray:
    """For each text, whether the tokens' bytes joined are its bytes."""
    own_at, own = _data(table.take(pa.array(ids)))
    begin, end = own_at[at[:-1]], own_at[at[1:]]
    if len(own) and own[: own_at[-1]] == data[: offsets[-1]] and (begin == offsets[:-1]).all():
        return np.ones(len(begin), bool)
    return np.array([own[x:y] == data[p:q] for x, y, p, q in zip(begin.tolist(), end.tolist(), offsets[:-1].tolist(), offsets[1:].tolist())], bool)


def align(v: Vocabularies, texts: pa.Array):
    """Of a slice of texts: numbers by name, SHA-256 of the groups, and (document, A id, B id) of each link as arrays."""
    empty = pc.equal(pc.fill_null(pc.binary_length(texts), 0), 0)
    spaced = pc.if_else(empty, "", pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), ""))
    chunks = byte_bpe.chunked(spaced)
    offsets, data = _data(pa.concat_arrays([spaced]) if spaced.offset else spaced)
    (a_ids, a_at), (b_ids, b_at) = v.a.encode_chunks(*chunks), v.b.encode_chunks(*chunks)
    keep = _gives_back(v.a_bytes, a_ids, a_at, offsets, data) & _gives_back(v.b_bytes, b_ids, b_at, offsets, data)
    a, b = Side(a_ids, a_at, v.lengths[0], keep), Side(b_ids, b_at, v.lengths[1], keep)
    b_of, a_of = a.covering(b), b.covering(a)
    a_opens, b_opens = b.start[b_of] == a.start, a.start[a_of] == b.start  # starts of groups
    inside = np.flatnonzero(~b_opens)
    # a pair that starts together was found from both sides
    links = np.concatenate([a.doc, b.doc[inside]]), np.concatenate([a.ids, a.ids[a_of[inside]]]), np.concatenate([b.ids[b_of], b.ids[inside]])
    n_docs = len(texts)
    numbers = {"n_a": a.n, "n_b": b.n, "n_groups": np.bincount(a.doc[a_opens], minlength=n_docs), "n_links": np.bincount(links[0], minlength=n_docs)}
    return numbers, _groups(v, a, b, a_opens, b_opens, n_docs), links


def _groups(v: Vocabularies, a: Side, b: Side, a_opens: np.ndarray, b_opens: np.ndarray, n_docs: int) -> list[str]:
    """The SHA-256 of each document's groups as text."""
    n_a, n_b = len(a.ids), len(b.ids)
    first_a, first_b = np.flatnonzero(a_opens), np.flatnonzero(b_opens)
    of_a, of_b = np.cumsum(a_opens) - 1, np.cumsum(b_opens) - 1
    # a group's A tokens come after all tokens of the groups before it, its B tokens after its A tokens
    codes = np.empty(n_a + n_b, np.int64)
    codes[np.arange(n_a) + first_b[of_a]] = a.ids * 3 + np.append(a_opens[1:], True)[:n_a]
    codes[np.arange(n_b) + np.append(first_a[1:], n_a)[of_b]] = b.ids * 3 + 2 * np.append(b_opens[1:], True)[:n_b]
    offsets, data = _data(v.decimal.take(pa.array(codes)))
    ends = np.cumsum(a.n + b.n)
    cut = zip(offsets[ends - a.n - b.n].tolist(), offsets[ends].tolist())
    return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in cut]


def _planes(x: np.ndarray) -> bytes:
    """32-bit integers by their bytes' places, as small ones compress better so."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _packed(per_doc: np.ndarray, numbers: np.ndarray, times: np.ndarray) -> bytes:
    """Links of a slice: how many different ones each document has, their numbers (as steps up within the document) and how often."""
    steps = numbers.copy()
    steps[1:] -= numbers[:-1]
    first = (np.cumsum(per_doc) - per_doc)[per_doc > 0]
    steps[first] = numbers[first]
    sizes = np.array([len(per_doc), len(numbers)], "<i8").tobytes()
    raw = _planes(per_doc) + _planes(steps) + _planes(times)
    return sizes + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n_docs, n = np.frombuffer(packed[:16], "<i8").tolist()
    raw = pa.decompress(packed[16:], decompressed_size=4 * (n_docs + 2 * n), codec="zstd", asbytes=True)
    per_doc, steps, times = (_unplaned(raw[low:high], size) for low, high, size in ((0, 4 * n_docs, n_docs), (4 * n_docs, 4 * (n_docs + n), n), (4 * (n_docs + n), len(raw), n)))
    total, end = np.cumsum(steps), np.cumsum(per_doc)
    first = (end - per_doc)[per_doc > 0]
    return per_doc, total - np.repeat(total[first] - steps[first], per_doc[per_doc > 0]), times


class Dictionary:
    """Pairs that some slices share, by number in order of first occurrence, with the links of each."""

    def __init__(self):
        self.pairs, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.sorted, self.number, self.held = self.pairs, self.n, 0

    def add(self, docs: np.ndarray, pairs: np.ndarray, n_docs: int) -> bytes:
        """The links of a slice, packed."""
        codes, own = pd.factorize(pairs)
        at = np.searchsorted(self.sorted, own)
        known = np.zeros(len(own), bool)
        known[at < len(self.sorted)] = self.sorted[at[at < len(self.sorted)]] == own[at < len(self.sorted)]
        number = np.empty(len(own), np.int64)
        number[known] = self.number[at[known]]
        number[~known] = len(self.pairs) + np.arange((~known).sum())
        self.pairs = np.concatenate([self.pairs, own[~known]])
        self.n = np.concatenate([self.n, np.zeros((~known).sum(), np.int64)])
        self.n[number] += np.bincount(codes, minlength=len(own))
        self.number = np.argsort(self.pairs, kind="stable")
        self.sorted = self.pairs[self.number]
        keyed = np.sort(docs * len(self.pairs) + number[codes])
        begin = np.flatnonzero(np.diff(keyed, prepend=-1))
        distinct, times = keyed[begin], np.diff(np.append(begin, len(keyed)))
        doc, numbers = np.divmod(distinct, max(len(self.pairs), 1))
        return _packed(np.bincount(doc, minlength=n_docs), numbers, times)


def _rows(**columns) -> pa.RecordBatch:
    types = {"batch": pa.int64(), "docs": pa.binary(), "links": pa.binary(), "at": pa.int32(), "pair": pa.int64(), "n": pa.int64()}
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in types.items()], names=list(types))


def sliced(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int, dictionary_bytes: int) -> DataFrame:
    """Slices of documents, as rows with ``docs`` and ``links``, and dictionaries of pairs, as rows with ``at``, ``pair`` and ``n``."""

    def run(batches):
        v = vocabularies(a_path, b_path)
        first, made = TaskContext.get().partitionId() << 32, 0
        words, width = Dictionary(), len(v.b.pieces)

        def closed():
            nonlocal made, words
            for low in range(0, len(words.pairs), 50_000):
                part = slice(low, low + 50_000)
                yield _rows(batch=np.full(len(words.pairs[part]), first + made), at=np.arange(len(words.pairs))[part].astype(np.int32), pair=words.pairs[part], n=words.n[part])
            made, words = made + 1, Dictionary()

        with common.task_memory(v.a, v.b):
            for b in batches:
                for low, high in byte_bpe.slices(b.column(1), slice_bytes):
                    texts = b.column(1).slice(low, high - low)
                    numbers, sha, (doc, a_ids, b_ids) = align(v, texts)
                    links = words.add(doc, a_ids * width + b_ids, len(texts))
                    columns = [b.column(0).slice(low, high - low), *[pa.array(numbers[c], pa.int64()) for c in NUMBERS], pa.array(sha, pa.string())]
                    sink = pa.BufferOutputStream()
                    own = pa.RecordBatch.from_arrays(columns, names=["doc_id", *NUMBERS, "groups_sha256"])
                    with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(own)
                    yield _rows(batch=[first + made], docs=[sink.getvalue().to_pybytes()], links=[links])
                    words.held += pc.sum(pc.binary_length(texts)).as_py() or 0
                    if words.held >= dictionary_bytes:
                        yield from closed()
            yield from closed()

    return docs.select("doc_id", "text").mapInArrow(run, SLICED)


def _counted(slices: pa.Table, pairs: pa.Table) -> pa.Table:
    """The rows of a dictionary's documents, with the corpus' counts of their links."""
    at = pairs.column("at").to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at], best[at] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
    tables = []
    for docs, links in zip(slices.column("docs"), slices.column("links")):
        with pa.ipc.open_stream(docs.as_py()) as stream:
            own = stream.read_all()
        per_doc, numbers, times = _unpacked(links.as_py())
        end = np.cumsum(per_doc)
        sums = [np.concatenate([[0], np.cumsum(x[numbers] * times)]) for x in (best, count)]
        n_best, count_sum = (pa.array(s[end] - s[end - per_doc], pa.int64()) for s in sums)
        tables.append(pa.table([own.column("doc_id"), *[own.column(c) for c in NUMBERS], n_best, count_sum, own.column("groups_sha256")], names=["doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"]))
    none = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in (*NUMBERS, "n_best", "count_sum")], ("groups_sha256", pa.string())])
    return pa.concat_tables(tables) if tables else none.empty_table()


def aligned(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = SLICE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """One row a document: numbers of tokens, groups and links, and of the counts of its links in the corpus."""
    rows = common.staged(sliced(docs, a_path, b_path, slice_bytes, dictionary_bytes), "aligned")
    pairs = rows.where("pair is not null").select("batch", "at", "pair", "n")
    width = F.lit(len(vocabularies(a_path, b_path).b.pieces)).cast("long")
    total = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    highest = F.max("count").over(Window.partitionBy(F.pmod("pair", width)))  # of a B id: one row for each A id at most
    counts = total.select("pair", "count", (F.col("count") == highest).cast("int").alias("best"))
    known = pairs.select("batch", "at", "pair").join(counts, "pair").select("batch", "at", "count", "best")
    slices = rows.where("docs is not null").select(F.col("batch").alias("own"), "docs", "links")
    return slices.groupBy("own").cogroup(known.groupBy("batch")).applyInArrow(lambda s, p: _counted(s, p), ALIGNED)


def op13_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(common.documents(spark, sf_dir), byte_bpe.default_path(), public_tokenizers.path("piece_bpe_32k.model"))
