"""BPE encoding and decoding with a tokenization automaton.

The automaton is built by successive merge gadgets. It starts as one state with a loop for each base symbol. The gadget
for merge (u, v) -> uv takes the state t that all u-arcs enter, makes a copy of t without its v-arc, lets the u-arcs
enter the copy, and gives every state with a u-arc a uv-arc to where v-arcs enter. All arcs of a label enter one state,
so a state is kept as the pair (label, time): the state that the label's arcs entered after the merges up to that time.
A path spells a word and is accepted exactly if it is the word's encoding, of which there is one. States share the arcs that
no gadget changed: each keeps those that a gadget took from it, and when, and the state that it is a copy of.

That automaton reads labels. Compiled with it is one that reads symbols: its states are the beginnings of labels, with an arc
for each symbol that leads to a longer one, a failure arc to the longest that remains, and the labels that end there. A word
is encoded by one walk through it: after each symbol, of the labels that end there, the longest that the label automaton
takes after the path before it is the last arc of the prefix's own path. What a walk found for a beginning holds for all words
that begin so; sorted words are encoded one after the other, each from where it parts from the one before. Decoding emits arc labels.

Cases: null text counts as empty (no ids, empty decoded text); rows are independent, so null or repeated doc_ids, empty
tables and other columns need no rule.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, common

#: Answers of the label automaton after which a worker starts their record anew; bounds its memory, not the work.
PAIRS = 1_000_000
#: The splitting pattern of the vocabulary file, with its white space spelled out.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"
#: Before a special string among chunks: lower-cased text has no such letter.
SPECIAL = "A"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Automaton:
    """States and arcs for a list of merges; labels are token strings, numbered by the vocabulary."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int]):
        self.vocab = vocab
        made: dict[str, int] = {}
        for k, (u, v) in enumerate(merges, 1):
            if made.setdefault(u + v, k) != k:
                raise ValueError(f"two merges make {u + v!r}")
        self.time = {x: made.get(x, 0) for x in vocab}
        self.left = {u + v: u for u, v in merges}
        self.base = {x for x in vocab if x not in made}
        self.removed: dict[str, dict[str, int]] = {}  # of a label's state: the arcs that gadgets took, and when
        self.origin: dict[str, tuple[str, int]] = {}  # the state that the arcs of a new label entered at first
        self.alive = set(self.base)
        for k, (u, v) in enumerate(merges, 1):
            if self.time.get(u, k) >= k or self.time.get(v, k) >= k:
                raise ValueError(f"merge {k} uses a symbol that is made later")
            self.origin[u + v] = (v, k if u != v else k - 1)
            if self.arc(u, k - 1, v):
                self.alive.add(u + v)
                self.removed.setdefault(u, {})[v] = k
        self.last = len(merges)
        self.table: dict[tuple[str, str], bool] = {}
        self._compile(merges)

    def _compile(self, merges: list[tuple[str, str]]) -> None:
        """The automaton that reads symbols: arcs, failure arcs, and labels that end at a state with their length, longest first."""
        spelled = {x: (x,) for x in self.base}
        for u, v in merges:
            spelled[u + v] = spelled[u] + spelled[v]
        self.arcs: list[dict[str, int]] = [{}]
        self.fails, self.ends, own = [0], [()], {}
        for x in self.alive:
            state = 0
            for symbol in spelled[x]:
                state = self.arcs[state].setdefault(symbol, len(self.arcs))
                if state == len(self.arcs):
                    self.arcs.append({})
            own[state] = ((x, len(spelled[x])),)
        self.fails, self.ends = [0] * len(self.arcs), [()] * len(self.arcs)
        level = [0]
        while level:  # by length: the state that a failure arc enters is shorter
            for state in level:
                for symbol, to in self.arcs[state].items():
                    self.fails[to] = self._step(self.fails[state], symbol) if state else 0
                    self.ends[to] = own.get(to, ()) + self.ends[self.fails[to]]
            level = [to for state in level for to in self.arcs[state].values()]

    def _step(self, state: int, symbol: str) -> int:
        while symbol not in self.arcs[state] and state:
            state = self.fails[state]
        return self.arcs[state].get(symbol, 0)

    def arc(self, label: str, at: int, x: str) -> bool:
        """Whether the state that ``label`` entered at time ``at`` has an arc ``x``."""
        time, removed = self.time, self.removed
        while True:
            gone = removed.get(label)
            if gone is not None and gone.get(x, at + 1) <= at:
                return False
            if time[x] < time[label]:  # x is older than the label: look at the state that its arcs entered first
                label, at = self.origin[label]
            elif x in self.base:
                return True
            elif x not in self.alive:
                return False
            else:  # x was added wherever its left part was
                at, x = min(at, time[x]), self.left[x]

    def takes(self, last: str, x: str) -> bool:
        """Transition table: whether arc ``x`` leaves the state that ``last`` enters in the finished automaton."""
        key = (last, x)
        found = self.table.get(key)
        if found is None:
            if len(self.table) > PAIRS:
                self.table.clear()
            found = self.table[key] = self.arc(last, self.last, x)
        return found

    def encode(self, symbols: list[str]) -> list[str]:
        """The labels of the one accepted path that spells the symbols."""
        return next(self.encode_all([symbols]))

    def encode_all(self, words: Iterable[list[str]]) -> Iterator[list[str]]:
        """``encode`` of each word. A walk begins where the word parts from the one before it, which sorted words do late."""
        arcs, fails, ends, table, takes = self.arcs, self.fails, self.ends, self.table, self.takes
        begins, labels, states, before = [0], [""], [0], []
        for symbols in words:
            i = 0
            for a, b in zip(before, symbols):
                if a != b:
                    break
                i += 1
            before = symbols
            del begins[i + 1 :], labels[i + 1 :], states[i + 1 :]
            state = states[i]
            for symbol in symbols[i:]:
                i += 1
                to = arcs[state].get(symbol)
                while to is None:
                    if not state:
                        raise KeyError(symbol)
                    state = fails[state]
                    to = arcs[state].get(symbol)
                state = to
                for x, n in ends[state]:
                    if i > n:
                        found = table.get((labels[i - n], x))
                        if found is None:
                            found = takes(labels[i - n], x)
                        if not found:
                            continue
                    begins.append(i - n)
                    labels.append(x)
                    break
                states.append(state)
            out = []
            while i:
                out.append(labels[i])
                i = begins[i]
            yield out[::-1]


class WordBpe(byte_bpe.ByteBpe):
    """Normalises, splits and encodes as the vocabulary file states; special strings are taken as they stand. No word crosses
    a space, so texts are cut into chunks there; ids are kept of chunks (known after a space) and of their words (known after nothing)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = dict(model["vocab"])
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.automaton = Automaton(merges, self.vocab)
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: x for x, i in [*self.vocab.items(), *self.special.items()]}  # arc labels, by id
        n = max(self.labels) + 1
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.written = [pa.array(x, pa.large_string()) for x in ([str(i) for i in range(n)], [self.labels.get(i) for i in range(n)])]
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.plain = regex.compile("[\\x00-\u052f\u2010-\u2027]*")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.split = regex.compile(SPLIT + "| ")
        self.symbols = dict(enumerate(byte_bpe.byte_symbols()))
        self.clear()

    def clear(self) -> None:
        super().clear()
        self._keep([" "], "", np.zeros(0, self.dtype), np.zeros(1, np.int64))
        self._keep([SPECIAL + x for x in self.special], " ", np.array([*self.special.values()], self.dtype), np.ones(len(self.special), np.int64))

    def normal(self, text: str) -> str:
        """The text as the library normalises it, but for white space, whose kind doesn't matter. Special strings are taken out
        before, and stand marked between spaces. Scripts whose letters depend on the version of Unicode are left to the library itself."""
        parts = self.cut.split(text)
        for k in range(0, len(parts), 2):
            if self.plain.fullmatch(parts[k]):
                parts[k] = unicodedata.normalize("NFC", parts[k]).replace("Σ", "σ").replace("\n", " ").lower()
            else:
                parts[k] = self.library.normalizer.normalize_str(parts[k])
        parts[1::2] = [SPECIAL + x for x in parts[1::2]]
        return " ".join(parts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pa.array([self.normal(t or "") for t in texts.to_pylist()], pa.large_string()), " ")
        chunks = lists.flatten()
        return self.encode_chunks(np.asarray(lists.offsets), len(chunks), [(" ", slice(None), chunks.dictionary_encode())])

    def _learn(self, missing: pa.Array, before: str) -> None:
        strings = missing.to_pylist()
        if before:
            self._learn_chunks(strings)
            return
        strings.sort()
        ids = [[self.vocab[x] for x in labels] for labels in self.automaton.encode_all(map(self._spelled, strings))]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self._keep(strings, "", np.fromiter(chain.from_iterable(ids), self.dtype, int(size.sum())), size)

    def _learn_chunks(self, chunks: list[str]) -> None:
        """Words of normalised chunks, each chunk's followed by a space, which has no ids; split by the same rule as ``normal``."""
        other = [c for c in chunks if not c.isascii() and not self.plain.fullmatch(c)]
        if other:
            apart = set(other)
            chunks = [c for c in chunks if c not in apart]
        words = self.split.findall(" ".join([*chunks, ""]))
        for c in other:
            words += [c[low:high] for _, (low, high) in self.library.pre_tokenizer.pre_tokenize_str(c)]
            words.append(" ")
        words = pa.array(words, pa.large_string())
        number = self._numbers(words.dictionary_encode(), "")
        size, ends = self.size[number], np.flatnonzero(pc.equal(words, " ").to_numpy(zero_copy_only=False))
        self._keep(chunks + other, " ", self.flat[byte_bpe.ranges(self.begin[number], size)], np.diff(np.cumsum(size)[ends], prepend=0))

    def _spelled(self, word: str) -> list[str]:
        symbols = [*word.encode().decode("latin-1").translate(self.symbols)]
        symbols[-1] += self.suffix
        return symbols

    def ids(self, text: str) -> list[int]:
        return self.encode(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.labels[i] for i in ids])

    def digests(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Of each text: number of ids, their decimals, the decoded text."""
        ids, at = self.encode(texts)
        ids, offsets, space = pa.array(ids), pa.array(at, pa.int32()), pa.scalar(" ", pa.large_string())
        return np.diff(at), *[pc.binary_join(pa.ListArray.from_arrays(offsets, x.take(ids)), space) for x in self.written]


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (the token ids of the whole text)."""

    def run(batches):
        bpe = loaded(path)
        with common.task_memory(bpe, bpe.automaton.table):
            for b in batches:
                for low, high in byte_bpe.slices(b.column(1)):
                    ids, at = bpe.encode(b.column(1).slice(low, high - low))
                    ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the labels of the ids."""

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        bpe, sha = loaded(path), hashlib.sha256
        with common.task_memory(bpe, bpe.automaton.table):
            for b in batches:
                for low, high in byte_bpe.slices(b.column(1)):
                    n, *joined = bpe.digests(b.column(1).slice(low, high - low))
                    arrays = [b.column(0).slice(low, high - low), pa.array(n)]
                    arrays += [pa.array([sha(x.as_buffer()).hexdigest() for x in column], pa.string()) for column in joined]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(common.documents(spark, sf_dir), default_path())
