"""Personal data: patterns against plain regular expressions, the field against enumeration, odd rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.llm import private_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    """The contract word by word."""
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1]))
            fine = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and total % 10 == 0,
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]  # noqa: B023
            if fine():
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def texts(count, seed):
    pick, make = random.Random(seed), private_data.Composer(seed)
    pieces = ["@", ".", "+", "-", " ", "1", "23", "456", "a.b", "x@y.z", "@@", "é", "%", "(", ")", "..", "\n", "1.2.3.4", "300.1.1.1", "+1 (234) 555-7890", "漢"]
    for k in range(count):
        if k % 2:
            yield "".join(pick.choice(pieces) for _ in range(pick.randint(0, 25)))
        else:
            yield make.text()[0]


def test_base_spans_equal_plain_patterns():
    for text in texts(4_000, 1):
        got = [f"{private_data.KINDS[k]}:{a}:{b}" for a, b, k in private_data.base_spans(text)]
        assert got == plain_spans(text), repr(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+" * 300_000, "(at)" * 60_000, "a.b-" * 60_000, "@" * 200_000, "+1 " * 90_000])
def test_long_runs_take_linear_time(text):
    field = private_data.Field({}, np.zeros((0, 5)), np.zeros((2, 5, 5)))
    [(base, spans)] = private_data.find_spans(field, [text])
    assert base == spans


def test_messages_are_exact_without_loops():
    pick = np.random.default_rng(3)
    scores, pair = pick.normal(size=(6, 3)), pick.normal(size=(5, 3, 3))
    ends = np.array([[0, 1], [1, 2], [1, 3], [3, 4], [5, 4]])
    nodes, joint = private_data.messages(scores, ends, pair, rounds=60)
    want, both = np.zeros((6, 3)), np.zeros((5, 3, 3))
    for y in itertools.product(range(3), repeat=6):
        weight = np.exp(sum(scores[k, v] for k, v in enumerate(y)) + sum(pair[e, y[a], y[b]] for e, (a, b) in enumerate(ends)))
        for k, v in enumerate(y):
            want[k, v] += weight
        for e, (a, b) in enumerate(ends):
            both[e, y[a], y[b]] += weight
    assert np.allclose(nodes, want / want.sum(axis=1, keepdims=True)) and np.allclose(joint, both / both.sum(axis=(1, 2), keepdims=True))


def test_messages_are_close_with_a_loop():
    pick = np.random.default_rng(4)
    for _ in range(20):
        scores, pair = pick.normal(size=(4, 2)), 0.4 * pick.normal(size=(4, 2, 2))
        ends = np.array([[0, 1], [1, 2], [2, 3], [3, 0]])
        nodes, _ = private_data.messages(scores, ends, pair, rounds=40)
        want = np.zeros((4, 2))
        for y in itertools.product(range(2), repeat=4):
            want[np.arange(4), y] += np.exp(sum(scores[k, v] for k, v in enumerate(y)) + sum(pair[e, y[a], y[b]] for e, (a, b) in enumerate(ends)))
        assert np.abs(nodes - want / want.sum(axis=1, keepdims=True)).max() < 0.02


@pytest.fixture(scope="module")
def field():
    return private_data.train(private_data.examples([], 600))


def test_held_out_accuracy(field):
    make, right, missed, extra = private_data.Composer(77), 0, 0, 0
    for _ in range(300):
        text, want = make.text()
        [(_, got)] = private_data.find_spans(field, [text])
        right, missed, extra = right + len({*want} & {*got}), missed + len({*want} - {*got}), extra + len({*got} - {*want})
    assert right / (right + missed) > 0.95 and right / (right + extra) > 0.93


def test_similar_tokens_share_their_label(field):
    """A bare number is found if the text has it elsewhere in a form that the patterns know."""
    bare, known = "word 4875557209 and more", "call +1 (487) 555-7209 now"
    filler = " plain words without any number" * 50
    probabilities = []
    for text in (bare, f"{known}{filler} {bare}"):
        spans = private_data.tokens(text)
        base = private_data.labels_of(spans, private_data.base_spans(text), -1)
        [p] = field.probabilities([private_data.graph(text, spans)], [base])
        probabilities.append(p[-1, 3])
    assert probabilities[1] > probabilities[0] + 0.02


def test_clean_texts_stay_clean(field):
    clean = ["Licensed under the Apache License, Version 2.0.", "In 1999, 25 of 300 people (8.3%) met on 2024-01-31 at 12:30:45.", "token = \"908038b7daaf91e4c565a0eb63815530a948bdde\"", "CC BY-NC 4.0. GNU version 3.", "ISBN 978-3-16-148410-0"]
    assert [s for _, s in private_data.find_spans(field, clean)] == [[]] * len(clean)


def test_repeated_numbers_make_few_edges():
    text = "5557209 x " * 2_000
    g = private_data.graph(text, private_data.tokens(text))
    assert len(g.edges) <= 2 * len(g.spans)


def test_rows_and_digests(spark, field):
    rows = [(1, "mail a.b@c.de or a.b [at] c [dot] de", 1), (1, "mail a.b@c.de or a.b [at] c [dot] de", 1), (2, None, 1), (3, "", 1), (None, "ä 1.2.3.4", None), (5, "word " * 20_000 + "x@y.org", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, private int")
    out = private_data.find_private_data(docs, field)
    assert out.columns == docs.columns
    got = out.select("doc_id", private_data.joined_spans(F.col("private.base")).alias("b"), private_data.joined_spans(F.col("private.spans")).alias("s")).collect()
    assert {(r.doc_id, r.b) for r in got} == {(1, "email:5:13"), (2, ""), (3, ""), (None, "ip:2:9"), (5, "email:100000:100007")}
    assert [r.s for r in got if r.doc_id == 1] == ["email:5:13,email:17:36"] * 2
    assert private_data.find_private_data(docs.where("false"), field).count() == 0
    masked = {r.doc_id: r.text for r in private_data.mask_private_data(docs.where("doc_id < 4"), field).collect()}
    assert masked == {1: "mail <email> or <email>", 2: None, 3: ""}


def test_training_without_rows(spark):
    none = spark.createDataFrame([], "text string")
    assert len(private_data.learn_private_data(none, composed=20).names) > 10
    assert private_data.learn_private_data(none, composed=0).names == {}
    nulls = spark.createDataFrame([(None,), ("",), ("call 1",)], "text string")
    assert private_data.learn_private_data(nulls, composed=0).weights.shape[1] == 5


def test_query_against_plain_patterns(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in private_data.op12(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        base, r = plain_spans(doc.text or ""), rows[doc.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(f"{k}:") for s in base) for k in PLAIN]
        assert {*base} <= {s for s in r.spans.split(",") if s}
