"""Spelling variants against a brute-force comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from rankloom.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(u, v):
    """Whether one inserted, deleted or replaced code point turns u into v."""
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(pairs):
    count = Counter()
    for doc, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= 2}
    form, n_near = {}, {}
    for w, n in words.items():
        others = [v for v in words if v != w and near(w, v)]
        n_near[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, n_near[w], words[form[w]] if form[w] else -1) for w, n in words.items())


def found(df, most=spelling.MOST_WORDS):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.variants(df, most).collect())


@pytest.mark.parametrize("most", [20_000, 3])
def test_words_equal_brute_force(docs, most):
    """Words over few letters, so that letters repeat and edits have several places; partitions cut down to single places."""
    rng = random.Random(most)
    words = list({"".join(rng.choice("abÿ") for _ in range(rng.choice([7, 7, 8, 9, 12]))) for _ in range(220)})
    counts = [2 * 11 ** rng.randint(0, 2) for _ in words]
    bag = [w for w, n in zip(words, counts) for _ in range(n)] + [w[1:] + w[0].upper() for w in words]
    bag += ["kkkkkkk"] * 600 + ["kkkkkkm"] * 40 + ["kkkkkmm"] * 3
    rng.shuffle(bag)
    pairs = [(i, "; ".join(bag[k : k + 40])) for i, k in enumerate(range(0, len(bag), 40))]
    want = brute(pairs)
    assert found(docs(pairs, True), most) == want
    assert sum(r[4] > 0 for r in want) > 100 and any(r[0] == "kkkkkmm" and r[1:3] == ("kkkkkkm", "kkkkkkk") for r in want) and len(want) > 200


def test_altered_runs_and_letters(docs):
    text = " ".join(f"{w}{'x' * (i % 3)}" for i, w in enumerate(["Straßen", "GRÖSSEN", "größen", "Éclairs", "éclairs", "naïveté×÷", "шесть", "abcdefg"] * 60))
    pairs = [(i, text) for i in range(40)] + [(None, text), (7, text)]
    want = brute(pairs)
    assert found(docs(pairs)) == want and any("É" in r[0] for r in want)


def test_odd_rows(docs, odd):
    long = "ab" * 20_000
    pairs = [*odd, (50, long + " " + long), (51, long[:-1] + " " + long[1:] + " " + long[:-1]), (52, "word1word2word3 sevenxx sevenxx_sevenxy sevenxy")]
    assert found(docs(pairs, True)) == brute(pairs)
    assert found(docs([])) == []


def test_machine_accepts_its_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(5)) for _ in range(90)})
    machine = spelling.Acceptor()
    start = machine.add(words)
    assert sorted(machine.common(start, start)) == words and machine.add(words) == start
    assert len(machine.arcs) < len({w[:k] for w in words for k in range(6)})  # fewer states than a tree
