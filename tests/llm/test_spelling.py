"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyscope.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n int, form string"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def documents(seed, count, letters="abé", longest=9):
    pick = random.Random(seed)
    words = ["".join(pick.choice(letters) for _ in range(pick.randint(4, longest))) for _ in range(60)]
    words += [w.upper() for w in words[:5]] + ["ÀÉàé×÷ßÿ", "Àéàé×÷ßÿ"]
    weights = [1 / (k + 1) for k in range(len(words))]
    words += [w[:k] + w[k + 1 :] for w in words[:30] for k in (1, len(w) - 1)]
    weights += [0.05] * (len(words) - len(weights))
    for k in range(count):
        yield k, pick.choice((" ", ", ", "1", "_")).join(pick.choices(words, weights, k=pick.randint(0, 80)))


@pytest.mark.parametrize("sizes", [(256, 8192), (4, 8192), (3, 5), (2, 3)])
def test_variants_by_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(spelling, "BLOCK", sizes[0])
    monkeypatch.setattr(spelling, "TILE", sizes[1])
    docs = [*documents(sum(sizes), 120)]
    out = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id bigint, text string"))
    got = [tuple(r) for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute(docs)
    assert len(got) == len(want) and set(got) == want
    assert sum(1 for r in want if r[4]) > 40 and any(r[1] for r in want)


def test_roots_of_chains(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "c"), ("y", "z")]
    got = spelling._roots(spark.createDataFrame(pairs, "word string, form string"))
    assert {tuple(r) for r in got.collect()} == {(w, "e") for w in "abcdx"} | {("y", "z")}


def test_letters_in_bounded_tiles(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE_LETTERS", 40)
    docs = [*documents(9, 100)]
    out = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {tuple(r) for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute(docs)


def test_pairs_are_found_once():
    pick = random.Random(2)
    words = sorted({"".join(pick.choice("ab") for _ in range(pick.randint(5, 8))) for _ in range(300)})
    found = Counter()
    for level in range(5, 10):
        rows = [w for w in words if len(w) in (level, level - 1)]
        for tail in (False, True):
            part = lambda w: w[-(level // 2) :] if tail else w[: level // 2]  # noqa: B023, E731
            rows.sort(key=part)
            keys = [part(w) for w in rows]
            groups = np.cumsum([0] + [a != b for a, b in zip(keys, keys[1:], strict=False)])
            if rows:
                x, y = spelling.pairs_within(rows, groups, level, tail)
                found.update(frozenset((rows[a], rows[b])) for a, b in zip(x.tolist(), y.tolist(), strict=True))
    assert set(found.values()) == {1}
    assert set(found) == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_odd_rows(spark):
    long = "a" * 70_000
    rows = [(1, "Hello hello HELLO hallo", "x", 1, "y"), (1, "Hello hello HELLO hallo", "x", 1, "y"), (None, "hello hallo", None, None, None), (2, None, "x", 1, "y"), (3, "", "x", 1, "y"), (4, " ".join([long, long, long, long + "b"] * 3), "x", 1, "y"), (5, "hallo " * 5_000, "x", 1, "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = spelling.spelling_variants(docs)
    assert {tuple(r) for r in out.collect()} == brute([r[:2] for r in rows])
    assert spelling.spelling_variants(docs.where("false")).count() == 0
    plain = spelling.spelling_variants(docs, damage=False)
    assert plain.where("word = 'hello'").first().n == 7
