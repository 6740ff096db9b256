"""Token ids: the automaton, the cached encoder, files and packing, against the tokenizers library and by round trip."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankloom.llm import bpe_automaton, byte_bpe, common, packing, token_files


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(bpe_automaton.default_path())


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(byte_bpe.default_path())


TEXTS = ["", "  a  b\n\tc　d", "Hello WORLD's don't  they'll 12345 ½ Ⅷ ²", "naïve café ΣΑΣ İstanbul ß", "<|endoftext|>x<|startoftext|> <|EndOfText|> a<|endoftext|>b", "a" * 300, "hahaha !!!! ---==="]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoders_equal_the_library(text):
    for encoder, path in ((bpe_automaton.loaded(bpe_automaton.default_path()).ids, bpe_automaton.default_path()), (lambda t: byte_bpe.loaded(byte_bpe.default_path()).encode(pa.array([t], pa.string()))[0].tolist(), byte_bpe.default_path())):
        library = Tokenizer.from_file(path) if path not in _LIB else _LIB[path]
        _LIB[path] = library
        if any(0xD800 <= ord(c) < 0xE000 for c in text):
            return
        assert list(encoder(text)) == library.encode(text, add_special_tokens=False).ids


_LIB: dict = {}


@pytest.mark.parametrize("text", TEXTS)
def test_encoders_on_hard_texts(text, word_library, byte_library):
    word = bpe_automaton.loaded(bpe_automaton.default_path())
    ids = word_library.encode(text, add_special_tokens=False).ids
    assert word.ids(text) == ids
    assert word.decode(ids) == word_library.decode(ids, skip_special_tokens=False)
    assert byte_bpe.loaded(byte_bpe.default_path()).encode(pa.array([text], pa.string()))[0].tolist() == byte_library.encode(text, add_special_tokens=False).ids


def test_automaton_against_merging_by_hand():
    merges = [("a", "b"), ("a", "a"), ("ab", "c"), ("b", "c"), ("aa", "aa")]
    vocab = {x: i for i, x in enumerate(["a", "b", "c", *(u + v for u, v in merges)])}
    auto = bpe_automaton.Automaton(merges, vocab)

    def by_hand(word):
        parts = list(word)
        for u, v in merges:
            i, out = 0, []
            while i < len(parts):
                if parts[i : i + 2] == [u, v]:
                    out.append(u + v)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    for n in range(1, 8):
        for k in range(3**n):
            word = "".join("abc"[k // 3**i % 3] for i in range(n))
            assert auto.encode(list(word)) == by_hand(word), word


def test_word_digests(docs, odd, word_library):
    rows = bpe_automaton.encode_digests(docs(odd, clash=True), bpe_automaton.default_path()).collect()
    assert len(rows) == len(odd)
    want = sorted((str(k), len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(word_library.decode(i, skip_special_tokens=False).encode()).hexdigest()) for k, i in ((k, word_library.encode(t or "", add_special_tokens=False).ids) for k, t in odd))
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in rows) == want


def test_encode_then_decode(docs, word_library):
    path = bpe_automaton.default_path()
    out = bpe_automaton.decode(bpe_automaton.encode(docs([(1, "Two words"), (2, None)]), path), path).collect()
    assert {r.doc_id: r.text for r in out} == {1: "two</w> words</w>", 2: ""}


def test_token_files_round_trip(spark, docs, odd, byte_library):
    manifest = token_files.write_token_files(docs(odd, clash=True), common.fresh_dir(spark, "t"), byte_bpe.default_path())
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id is None for r in got] == [True] + [False] * (len(odd) - 1)
    assert [r.doc_id for r in got[1:]] == sorted(k for k, _ in odd if k is not None)
    at, by_id = 0, {k: t for k, t in odd}
    for r in got:
        ids = byte_library.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_of_no_documents(spark, docs):
    manifest = token_files.write_token_files(docs([]), common.fresh_dir(spark, "t"), byte_bpe.default_path())
    assert token_files.read_token_files(manifest).count() == 0


def check_pieces(rows, ids_of, window):
    left, sequences = {k: 0 for k in ids_of}, {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.start)):
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == left[r.doc_id] and r.length == len(ids) and r.doc_tokens == len(ids_of[r.doc_id])
        assert ids == ids_of[r.doc_id][r.start : r.start + r.length]
        left[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert left == {k: len(v) for k, v in ids_of.items()}
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_places_each_id_once(docs, odd, byte_library):
    rows = [r for r in odd if r[0] != 9] + [(100 + i, "some more words " * i) for i in range(40)]
    ids = {k: byte_library.encode(t or "", add_special_tokens=False).ids + [0] for k, t in rows}
    got = packing.pack(docs(rows, clash=True).coalesce(1), byte_bpe.default_path(), 64).collect()
    assert check_pieces(got, ids, 64) == 0
    assert packing.pack(docs([]), byte_bpe.default_path()).count() == 0


def test_sum_of_squares_rule():
    """Each placement is the one that a search over all levels finds."""
    rng = np.random.default_rng(5)
    packer = packing.SumOfSquares(50)
    for size in rng.integers(1, 50, 400):
        counts = packer.counts.copy()
        options = {}
        for level in range(0, 50 - size + 1):
            if level and not counts[level]:
                continue
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + size < 50:
                after[level + size] += 1
            options[level] = int((after[1:50].astype(np.int64) ** 2).sum())
        packer.place((0, 0, np.zeros(size, np.uint16), size))
        assert (packer.counts[1:50].astype(np.int64) ** 2).sum() == min(options.values())


def test_packing_keeps_any_number_of_windows_open():
    packer = packing.SumOfSquares(100)
    for i in range(5000):
        packer.add(i, np.full(60, i, np.uint16))
    assert packer.counts[60] == 5000 and not packer.done
    packer.close()
    assert sum(len(p[2]) for p in packer.done) == 5000 * 60
    assert sum(len(p[2]) == 60 for p in packer.done) >= 5000 // 2


def test_byte_encoder_forgets_and_learns_anew(byte_library, monkeypatch):
    """Slices of words, some of which return, under a bound that makes the cache start anew again and again."""
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 20_000)
    bpe, rng = byte_bpe.ByteBpe(byte_bpe.default_path()), np.random.default_rng(3)
    for turn in range(12):
        texts = [None, "", *(" ".join(f"w{rng.integers(0, 400 * (1 + turn % 3))}{'.' * (k % 3)}" for k in range(n)) for n in rng.integers(1, 300, 8)), "long" * 100, " a  b \n c\u00a0 d ", "x" * 5000 + " y"]
        ids, at = bpe.encode(pa.array(texts, pa.string()))
        assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == [byte_library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert bpe.held < 400_000


def test_symbol_automaton_is_deterministic_and_complete():
    """Each state of the compiled automaton spells one beginning of a label, and lists exactly the labels that end there."""
    auto = bpe_automaton.loaded(bpe_automaton.default_path()).automaton
    spelled, todo = {0: ()}, [0]
    while todo:
        state = todo.pop()
        for symbol, to in auto.arcs[state].items():
            assert to not in spelled
            spelled[to] = (*spelled[state], symbol)
            todo.append(to)
    assert len(spelled) == len(auto.arcs)
    for state in np.random.default_rng(1).integers(1, len(auto.arcs), 3000).tolist():
        text = spelled[state]
        assert [x for x, _ in auto.ends[state]] == [x for k in range(len(text)) if (x := "".join(text[k:])) in auto.alive]


def test_words_of_a_slice_share_the_walk_of_their_beginnings(word_library):
    """Words that begin alike, in any order: the automaton reads a common beginning once, not once for each word."""
    word = bpe_automaton.WordBpe(bpe_automaton.default_path())
    words = ["unforeseeable" * 6 + a + b for a in "abcdefghij" for b in "klmnopqrst"]
    text = " ".join(words[k] for k in np.random.default_rng(2).permutation(len(words)))

    class Counted(list):
        read = 0

        def __getitem__(self, at):
            Counted.read += 1
            return list.__getitem__(self, at)

    word.automaton.arcs = Counted(word.automaton.arcs)
    assert word.ids(text) == word_library.encode(text, add_special_tokens=False).ids
    assert Counted.read < len(text) / 5


def test_word_encoder_forgets_and_learns_anew(word_library, monkeypatch):
    """Slices of texts whose words return, with special strings, other scripts and long words, under a small bound of the cache."""
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 20_000)
    word, rng = bpe_automaton.WordBpe(bpe_automaton.default_path()), np.random.default_rng(4)
    hard = [None, *TEXTS, "A<|endoftext|>A <|startoftext|>\n", "<|ENDOFTEXT|> 日本語 Ⱥb 漢字's J̌", "z" * 900 + "é", "\x1c\x85  x"]
    for turn in range(8):
        texts = [*hard, *(" ".join(f"w{rng.integers(0, 300 * (1 + turn % 3))}{'!' * (k % 3)}" for k in range(n)) for n in rng.integers(1, 300, 6))]
        texts = [texts[k] for k in rng.permutation(len(texts))]
        n, ids, decoded = word.digests(pa.array(["before", *texts], pa.string()).slice(1))
        want = [word_library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(x) for x in want]
        assert ids.to_pylist() == [" ".join(map(str, x)) for x in want]
        assert decoded.to_pylist() == [word_library.decode(x, skip_special_tokens=False) for x in want]
        assert word.held < 400_000
