"""Alignment against whole-text encodings by the libraries and a comparison of all pairs of tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from rankloom.llm import alignment, byte_bpe

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """(id, begin, end) of both sides; none if their bytes aren't the text's."""
    a, b = libraries
    if not text:
        return [], []
    byte = {c: i for i, c in enumerate(byte_bpe.byte_symbols())}
    ids = a.encode(" " + text, add_special_tokens=False).ids
    one = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in ids]
    two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    out = []
    for side in (one, two):
        if b"".join(x for _, x in side) != (" " + text).encode():
            return [], []
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def brute(libraries, pairs):
    linked = []
    for doc, text in pairs:
        one, two = tokens(libraries, text)
        links = [(i, j) for i, s, e in one for j, t, f in two if s < f and t < e]
        groups, k, m = [], 0, 0
        for end in sorted({e for *_, e in one} & {e for *_, e in two}):
            x, y = [i for i, s, e in one[k:] if e <= end], [i for i, s, e in two[m:] if e <= end]
            k, m = k + len(x), m + len(y)
            groups.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if one else ""
        linked.append((doc, len(one), len(two), len(groups), links, sha))
    count = Counter(x for row in linked for x in row[4])
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(((d, x, y, g, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), sha) for d, x, y, g, links, sha in linked), key=str)


def check(libraries, docs, pairs, **sizes):
    got = alignment.aligned(docs(pairs, True), A, B, **sizes).collect()
    want = brute(libraries, pairs)
    assert sorted((tuple(r) for r in got), key=str) == want
    return want


HARD = [
    "<|endoftext|> and <s> </s> <unk> <0x41>", "  two  spaces \n and\tmore   ", "▁ lower block", "é é ﬁ Ⅷ 日本語 😀👩‍👩‍👧 　 x", "\x00\x01 control", "a" * 300, "x y  z", "don't we'll I'VE 12345 67",
    "one▁two words", " ", "\n", "\n \n  x", "tabs\t\tand\r\nlines \r\n",
]


def test_texts_equal_brute_force(libraries, docs):
    rng = random.Random(2)
    parts = ["the", "Straße", "onten", "ция", "λόγος", "x=1;", "日本", "😀", "   ", "\n", "'s", "<s>", "é", "1999", "\t", "foo_bar", "…"]
    texts = HARD + ["".join(rng.choice(parts) + rng.choice([" ", "", " ", "  "]) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    want = check(libraries, docs, list(enumerate(texts)), slice_bytes=300, dictionary_bytes=900)
    assert sum(r[1] == 0 for r in want) == 2 and any(r[1] > r[3] > 1 for r in want)


def test_odd_rows(libraries, docs, odd):
    want = check(libraries, docs, [(d, t if t is None or len(t) < 1000 else t[:2000]) for d, t in odd])
    assert sum(r[7] == "" for r in want) == 2
    assert alignment.aligned(docs([]), A, B).count() == 0


def test_chunks_equal_whole_texts(libraries, spark):
    """Both sides' ids of whole documents of the given table equal the libraries'."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].combine_chunks()
    chunks = byte_bpe.chunked(pc.binary_join_element_wise(" ", texts, ""))
    v = alignment.vocabularies(A, B)
    for own, library in ((v.a, lambda t: libraries[0].encode(" " + t, add_special_tokens=False).ids), (v.b, libraries[1].encode)):
        ids, at = own.encode_chunks(*chunks)
        for i, t in enumerate(texts.to_pylist()):
            assert ids[at[i] : at[i + 1]].tolist() == library(t)
    assert isinstance(texts, pa.Array)


def test_links_are_packed_without_loss():
    rng = np.random.default_rng(4)
    per_doc = rng.integers(0, 4, 30)
    numbers = np.concatenate([np.sort(rng.choice(10**6, n, replace=False)) for n in per_doc])
    times = rng.integers(1, 2**31, len(numbers))
    for got, was in zip(alignment._unpacked(alignment._packed(per_doc, numbers, times)), (per_doc, numbers, times)):
        assert (got == was).all()
    assert all(len(x) == 0 for x in alignment._unpacked(alignment._packed(per_doc[:0], numbers[:0], times[:0])))
