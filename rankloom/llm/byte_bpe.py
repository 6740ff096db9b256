"""Token ids of the byte-level vocabulary, through the tokenizers library, with a cache of chunks.

The splitting pattern of this vocabulary attaches one leading space to a word and never lets a piece cross from a
non-space into the space after it. A text may so be cut before each space that follows a non-space, and the chunks be
encoded one by one: their ids concatenate to the ids of the whole text. Chunks repeat, whole texts don't. Arrow cuts the
texts of a slice and numbers their distinct chunks, the library encodes those that aren't known, and NumPy gathers ids.
"""

from __future__ import annotations

import json
import os
import re
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of chunks and ids after which a worker starts its cache anew; bounds its memory, not the work.
CACHE_BYTES = 96 << 20
#: Bytes that an entry takes beside its string and ids.
ENTRY_BYTES = 110
#: Longer chunks are encoded each time they occur.
LONGEST = 200
#: Chunks that go to the library in one string, and strings in one call.
JOINED, STRINGS = 64, 128

#: White space as Python has it, spelled out for Arrow.
_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A text that can't be cut at each space; a chunk that can't be told from its neighbours by its tokens.
_SPACE_AFTER_SPACE, _ALONE = f"{_SPACE} ", f"^{_SPACE}|{_SPACE}$| |^$"
_CUT = re.compile(r"(?<!\s) ")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return [chr(b) if b in set(keep) else chr(256 + rest.index(b)) for b in range(256)]


def _cut(texts: pa.Array) -> pa.ListArray:
    """Chunks of each text; all but a text's first lack the one space that they begin with."""
    odd = pc.match_substring_regex(texts, _SPACE_AFTER_SPACE)
    if not pc.any(odd).as_py():
        return pc.split_pattern(texts, " ")
    odd = odd.to_numpy(zero_copy_only=False)
    parts = [pc.split_pattern(texts.filter(pa.array(~odd)), " "), pa.array([_CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(texts.type))]
    order = np.empty(len(odd), np.int64)
    order[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(odd))
    return pa.concat_arrays(parts).take(pa.array(order))


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one range after the other."""
    before = np.cumsum(size) - size
    at = np.repeat(begin - before, size)
    at += np.arange(len(at))
    return at


def chunked(texts: pa.Array):
    """Of the texts' chunks: offsets of each text's, their number, and the distinct ones by what comes before them (nothing or a space)."""
    lists = _cut(pc.fill_null(texts, ""))
    offsets, chunks = np.asarray(lists.offsets), lists.flatten()
    offsets = offsets - offsets[0]
    first = np.zeros(len(chunks), bool)
    first[offsets[:-1]] = True
    return offsets, len(chunks), [(before, some, chunks.filter(pa.array(some)).dictionary_encode()) for before, some in (("", first), (" ", ~first))]


class ByteBpe:
    """``plain``: strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError(f"{path} splits texts by another pattern")
        n = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        space = byte_symbols()[ord(" ")]
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(space) for i in range(n)])
        self.clear()

    def clear(self) -> None:
        """Chunks by what comes before them (nothing or a space), to their number; by number, where ids begin in ``flat``, how
        many they are, and whether a later slice had the chunk again."""
        self.known: dict[str, dict[str, int]] = {"": {}, " ": {}}
        self.flat, self.begin, self.size = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again, self.held, self.long = np.zeros(0, bool), 0, []

    def _forget(self) -> None:
        """Drops the chunks that no later slice had again, or all if that isn't half of them."""
        stay = np.flatnonzero(self.again)
        kept = [(before, c, i) for before, known in self.known.items() for c, i in known.items() if self.again[i]]
        flat, begin, size = self.flat, self.begin, self.size
        self.clear()
        if 2 * len(stay) > len(size):
            return
        for before in self.known:
            own = [(c, i) for b, c, i in kept if b == before]
            if own:
                at = np.array([i for _, i in own])
                self._keep([c for c, _ in own], before, flat[ranges(begin[at], size[at])], size[at])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, without special tokens added, and where each text's begin, then their
        end. Null and empty text: no ids."""
        return self.encode_chunks(*chunked(texts))

    def encode_chunks(self, offsets: np.ndarray, n: int, parts: list) -> tuple[np.ndarray, np.ndarray]:
        for before, chunk in self.long:
            self.known[before].pop(chunk, None)
        self.long = []
        if self.held > CACHE_BYTES:
            self._forget()
        number = np.empty(n, np.int64)
        for before, some, coded in parts:
            number[some] = self._numbers(coded, before)
        size = self.size[number]
        return self.flat[ranges(self.begin[number], size)], np.concatenate([[0], np.cumsum(size)])[offsets]

    def _numbers(self, coded: pa.DictionaryArray, before: str) -> np.ndarray:
        known = self.known[before]
        distinct = _strings(coded.dictionary)
        number = np.array([known.get(c, -1) for c in distinct], np.int64)
        new = np.flatnonzero(number < 0)
        self.again[number[number >= 0]] = True
        if len(new):
            missing = coded.dictionary.take(pa.array(new))
            self._learn(missing, before)
            number[new] = [known[c] for c in _strings(missing)]
        return number[coded.indices.to_numpy()]

    def _learn(self, missing: pa.Array, before: str) -> None:
        """Chunks without white space at their ends or a space inside go to the library joined: there, a token that begins
        with a space begins a chunk."""
        alone = pc.match_substring_regex(missing, _ALONE) if before else pa.array(np.ones(len(missing), bool))
        joined, single = _strings(missing.filter(pc.invert(alone))), _strings(missing.filter(alone))
        for low in range(0, len(joined), JOINED * STRINGS):
            part = joined[low : low + JOINED * STRINGS]
            flat = np.concatenate(self._library([before + before.join(part[k : k + JOINED]) for k in range(0, len(part), JOINED)]))
            begin = np.flatnonzero(self.opens[flat])
            if len(begin) == len(part):
                self._keep(part, before, flat, np.diff(begin, append=len(flat)))
            else:
                single.extend(part)
        for low in range(0, len(single), 4096):
            part = single[low : low + 4096]
            ids = self._library([before + c for c in part])
            self._keep(part, before, np.concatenate(ids), np.array([len(x) for x in ids], np.int64))

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, chunks: list[str], before: str, flat: np.ndarray, size: np.ndarray) -> None:
        self.known[before].update(zip(chunks, range(len(self.size), len(self.size) + len(chunks))))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        self.again = np.concatenate([self.again, np.zeros(len(chunks), bool)])
        self.long.extend((before, c) for c in chunks if len(c) > LONGEST)
        self.held += sum(map(sys.getsizeof, chunks)) + flat.nbytes + ENTRY_BYTES * len(chunks)


class PieceBpe(ByteBpe):
    """Ids of a sentencepiece model, by the same chunks, for texts that begin with the space that the model adds. No piece of
    such a model crosses from a non-space into the space after it, which is checked."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\u2581" in p.lstrip("\u2581") for p in self.pieces):
            raise ValueError(f"{path} has pieces that cross from one word into the next")
        self.dtype = np.dtype("<u2" if len(self.pieces) <= 1 << 16 else "<u4")
        self.space = [self.model.piece_to_id("\u2581")]
        self.clear()

    def _learn(self, missing: pa.Array, before: str) -> None:
        chunks = _strings(missing)
        if not before:
            if any(chunks):
                raise ValueError("a text that doesn't begin with a space")
            self._keep(chunks, before, np.zeros(0, self.dtype), np.zeros(len(chunks), np.int64))
            return
        for low in range(0, len(chunks), 4096):
            part = chunks[low : low + 4096]
            ids = [own or self.space for own in self.model.encode(part, num_threads=1)]  # to an empty string, the model adds no space
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self._keep(part, before, np.fromiter(chain.from_iterable(ids), self.dtype, int(size.sum())), size)


_LOADED: dict[tuple, ByteBpe] = {}


def loaded(path: str, kind=ByteBpe, **settings) -> ByteBpe:
    """One encoder for a worker process, vocabulary file and settings."""
    key = (path, kind, *settings.items())
    if key not in _LOADED:
        _LOADED[key] = kind(path, **settings)
    return _LOADED[key]


def slices(texts: pa.Array, most_bytes: int = 4_000_000, most_rows: int = 2_000):
    """Consecutive (start, end) runs of bounded text, so that a batch of long texts doesn't fill a worker."""
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and (held + n > most_bytes or i - start >= most_rows):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)
