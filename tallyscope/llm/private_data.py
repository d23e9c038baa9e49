"""Operator 12: personal data by a skip-chain conditional random field.

Base spans are what four patterns find. The field adds what they miss: tokens with
digits or an at sign are its nodes, neighbours share a chain potential, and equal or
similar tokens of a document, however far apart, share a skip potential. Base spans
are evidence, so a telephone number that comes once with its plus sign and once
without is found both times. Sum-product messages run around the loops of this graph
until every token has a probability of each label. All other words are no personal
data by definition, which cuts the chain exactly into short stretches.

The weights are learnt from a bounded sample: base spans label the texts, and more
examples are composed from written forms that the patterns don't cover and from
numbers that are no personal data.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import lean, query, ready, sample_rows, table

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
#: Sampled texts for training, and texts composed beside them.
SAMPLE, COMPOSED = 400, 600
#: A label counts from this probability on.
SURE = 0.8
ROUNDS = 12
STEPS = 120
#: Characters between neighbours at most.
GAP = 2

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can't begin inside a run of digits, so looking back loses none and keeps this linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of what the patterns find, by start and kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end, 0))
        else:
            # No later match begins before this sign, so no run is walked twice.
            end = at + 1
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# ------------------------------------------------------------- tokens

_MARK = re.compile(r"[0-9@]++|[(\[{][aA][tT][)\]}]")
_INNER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+@()[]{}._%/:-")
_FORWARD = re.compile(r"[A-Za-z0-9+@()\[\]{}._%/:-]*+")
_WRITTEN = re.compile(r" ?[(\[{][aA][tT][)\]}] ?[A-Za-z0-9-]++(?:(?:\.| ?[(\[{][dD][oO][tT][)\]}] ?)[A-Za-z0-9-]++)++")
_OUTER = re.compile(r"[A-Za-z0-9+(\[](?:.*[A-Za-z0-9)\]])?", re.DOTALL)
_RUNS = re.compile(r"[0-9]++|[A-Za-z]++")


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens that can be personal data, without marks around them."""
    out: list[tuple[int, int]] = []
    done = 0
    for m in _MARK.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        if m.group()[0] in "([{":
            # An address with its signs written out is one token.
            if start > done and text[start - 1] == " ":
                start -= 1
            # A name with digits has just become a token of its own.
            last = out.pop() if out and out[-1][1] == start else None
            written, local = _WRITTEN.match(text, start), start
            while local > (last[0] if last else done) and text[local - 1] in _LOCAL:
                local -= 1
            if last and not (written and local < start):
                out.append(last)
            if written and local < start:
                out.append((local, written.end()))
                done = written.end()
            continue
        while start > done and text[start - 1] in _INNER:
            start -= 1
        done = _FORWARD.match(text, m.end()).end()
        core = _OUTER.search(text, start, done)
        if core:
            first, last = core.span()
            if text[first] in "([" and not any(c in ")]" for c in text[first:last]):
                first += 1
            if text[last - 1] in ")]" and not any(c in "([" for c in text[first:last]):
                last -= 1
            if first < last:
                out.append((first, last))
    return out


def _shape(token: str) -> str:
    return _RUNS.sub(lambda m: f"#{len(m.group())}" if m.group()[0].isdigit() else "a", token[:80])


def _similar(token: str) -> str:
    return "".join(c for c in token.lower() if c.isalnum())


@dataclass
class Graph:
    """Tokens of some texts with their features and the edges between them."""

    spans: list[tuple[int, int]]
    names: list[list[str]]
    edges: list[tuple[int, int, int]]  # two nodes; 0 for a neighbour, 1 for a similar token


def graph(text: str, spans: list[tuple[int, int]]) -> Graph:
    words = [text[a:b] for a, b in spans]
    joined = [k > 0 and a - spans[k - 1][1] <= GAP and not text[spans[k - 1][1] : a].strip() for k, (a, _) in enumerate(spans)]
    shapes = [_shape(w) for w in words]
    first, runs = [], []
    for k in range(len(spans)):
        if joined[k]:
            runs[-1].append(k)
        else:
            runs.append([k])
        first.append(len(runs) - 1)
    digits = [_digits(w) for w in words]
    # A stretch of more than a few tokens is no number: only those around count.
    names = []
    for k, w in enumerate(words):
        run = runs[first[k]]
        at = k - run[0]
        near = run[max(0, at - 3) : at + 4]
        n = len(digits[k])
        parts = w.replace("[.]", ".").split(".")
        four = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
        whole = sum(len(digits[j]) for j in near)
        names.append(
            [
                "bias",
                f"shape {shapes[k]}",
                f"run {' '.join(shapes[j] for j in near)}",
                f"before {shapes[k - 1] if joined[k] else ''}",
                f"after {shapes[k + 1] if k + 1 < len(spans) and joined[k + 1] else ''}",
                f"digits {min(n, 20)}",
                f"run digits {min(whole, 20)}, {len(near)}",
                f"letters {any(c.isalpha() for c in w[:200])}",
                f"plus {w[0] == '+'}, {words[near[0]][0] == '+'}",
                f"luhn {14 <= n <= 19 and luhn(digits[k])}, {14 <= n <= 19}",
                f"four parts {four}",
                f"at {'@' in w}, {bool(_WRITTEN.search(w[:200]))}",
            ]
        )
    edges = [(k - 1, k, 0) for k in range(1, len(spans)) if joined[k]]
    seen: dict[str, int] = {}
    # Each token is linked to the one before it that is like it, so edges grow with the text.
    for k, w in enumerate(words):
        run = runs[first[k]]
        keys = {f"t{_similar(w)}"} if len(w) >= 4 else set()
        if len(run) <= 7 and len(number := "".join(digits[j] for j in run)) >= 7:
            keys.add(f"n{number[-7:]}")
        for key in sorted(keys):
            other = seen.get(key)
            if other is not None and first[other] != first[k]:
                edges.append((other, k, 1))
            if key[0] == "t" or k == run[-1]:
                seen[key] = k if key[0] == "t" else run[0]
    return Graph(spans, names, edges)


# -------------------------------------------------------------- field


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(x - most).sum(axis=axis))


def messages(scores: np.ndarray, ends: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of labels per node, and of label pairs per edge, by loopy sum-product.

    ``scores`` (nodes, labels), ``ends`` (edges, 2) and ``pair`` (edges, labels, labels) are logarithms.
    Exact for graphs without loops once ``rounds`` reaches their diameter.
    """
    n, m = len(scores), len(ends)
    source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    both = np.concatenate([pair, pair.transpose(0, 2, 1)])
    sent = np.zeros((2 * m, scores.shape[1]))
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])

    def belief() -> np.ndarray:
        out = scores.copy()
        np.add.at(out, target, sent)
        return out

    for step in range(rounds if m else 0):
        cavity = belief()[source] - sent[back]
        new = _log_sum(cavity[:, :, None] + both, 1)
        new -= _log_sum(new, 1)[:, None]
        sent = new if step < 2 else (sent + new) / 2
    total = belief()
    nodes = np.exp(total - _log_sum(total, 1)[:, None])
    cavity = total[source] - sent[back]
    joint = cavity[:m, :, None] + pair + cavity[m:, None, :]
    joint -= _log_sum(joint.reshape(m, -1), 1)[:, None, None] if m else 0
    return nodes.reshape(n, -1), np.exp(joint)


@dataclass
class Field:
    names: dict[str, int]
    weights: np.ndarray  # (features, labels)
    pair: np.ndarray  # chain and skip potentials, (2, labels, labels)

    def scores(self, names: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(names), NONE + 1))
        for k, row in enumerate(names):
            known = [i for name in row if (i := self.names.get(name)) is not None]
            out[k] = self.weights[known].sum(axis=0)
        return out

    def probabilities(self, graphs: list[Graph], evidence: list[list[int]]) -> list[np.ndarray]:
        """Probabilities of the labels of every token; ``evidence`` has its known label or -1."""
        names = [row for g in graphs for row in g.names]
        if not names:
            return [np.zeros((0, NONE + 1)) for _ in graphs]
        scores = self.scores(names) + clamp([e for known in evidence for e in known])
        ends, kinds, cuts = joined_edges(graphs)
        nodes, _ = messages(scores, ends, self.pair[kinds])
        return np.split(nodes, cuts[1:-1])


def clamp(evidence: list[int]) -> np.ndarray:
    known = np.array(evidence, dtype=np.int64)
    out = np.zeros((len(known), NONE + 1))
    rows = np.flatnonzero(known >= 0)
    out[rows] = -60.0
    out[rows, known[rows]] = 0.0
    return out


def joined_edges(graphs: list[Graph]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cuts = np.cumsum([0, *[len(g.spans) for g in graphs]])
    rows = [(a + c, b + c, kind) for g, c in zip(graphs, cuts.tolist(), strict=False) for a, b, kind in g.edges]
    edges = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return edges[:, :2], edges[:, 2], cuts


def train(examples: list[tuple[Graph, list[int], list[int]]], *, steps: int = STEPS) -> Field:
    """Weights from (graph, label of each token, evidence) by gradient ascent on the field's likelihood.

    The model's expectations are those of the messages, so training fits what is used later.
    """
    counts: dict[str, int] = {}
    for g, _, _ in examples:
        for row in g.names:
            for name in row:
                counts[name] = counts.get(name, 0) + 1
    names = {name: k for k, name in enumerate(sorted(n for n, c in counts.items() if c >= 2))}
    field = Field(names, np.zeros((len(names), NONE + 1)), np.zeros((2, NONE + 1, NONE + 1)))
    labels = np.array([y for _, ys, _ in examples for y in ys], dtype=np.int64)
    if not len(labels):
        field.weights = np.zeros((len(names), NONE + 1))
        return field
    ends, kinds, _ = joined_edges([g for g, _, _ in examples])
    fixed = clamp([e for _, _, known in examples for e in known])
    at, which = [], []
    for k, row in enumerate(row for g, _, _ in examples for row in g.names):
        for name in row:
            if name in names:
                at.append(k)
                which.append(names[name])
    at, which = np.array(at, dtype=np.int64), np.array(which, dtype=np.int64)
    wanted = np.eye(NONE + 1)[labels]
    seen = np.zeros_like(field.pair)
    np.add.at(seen, (kinds, labels[ends[:, 0]], labels[ends[:, 1]]), 1.0)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (field.weights, field.pair)]
    for step in range(1, steps + 1):
        scores = fixed.copy()
        np.add.at(scores, at, field.weights[which])
        nodes, joint = messages(scores, ends, field.pair[kinds], rounds=6)
        by_name = np.zeros_like(field.weights)
        np.add.at(by_name, which, (wanted - nodes)[at])
        by_pair = seen.copy()
        np.add.at(by_pair, kinds, -joint)
        # What is similar has no direction.
        by_pair[1] = (by_pair[1] + by_pair[1].T) / 2
        for x, slope, (mean, square) in zip((field.weights, field.pair), (by_name, by_pair), moments, strict=True):
            slope = slope - 0.3 * x
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope**2 - square)
            x += 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return field


# ----------------------------------------------------------- examples


class Composer:
    """Personal data in written forms that the patterns miss, and numbers that are none."""

    def __init__(self, seed: int):
        self.pick = random.Random(seed)

    def number(self, n: int) -> str:
        return "".join(self.pick.choice("0123456789") for _ in range(n))

    def word(self) -> str:
        return "".join(self.pick.choice("abcdefghijklmnoprstuvwz") for _ in range(self.pick.randint(2, 9)))

    def card(self) -> str:
        body = str(self.pick.randint(2, 9)) + self.number(self.pick.choice((14, 14, 14, 13)))
        return next(body + d for d in "0123456789" if luhn(body + d))

    def entity(self) -> tuple[int, str]:
        """Kind and usual form."""
        p = self.pick
        kind = p.randrange(NONE)
        if kind == 0:
            local = p.choice((self.word(), f"{self.word()}.{self.word()}", f"{self.word()}.{self.number(2)}", f"{self.word()}{self.number(2)}"))
            return 0, f"{local}@{self.word()}{p.choice(('', self.number(1)))}.{p.choice(('', self.word() + '.'))}{p.choice(('com', 'org', 'net', 'de', 'fr'))}"
        if kind == 1:
            return 1, ".".join(str(p.randint(1, 255)) for _ in range(4))
        if kind == 2:
            d = self.card()
            return 2, p.choice((d, " ".join(d[k : k + 4] for k in range(0, len(d), 4)), "-".join(d[k : k + 4] for k in range(0, len(d), 4))))
        a, b, c = self.number(3), self.number(3), self.number(4)
        return 3, f"+{p.choice((1, 33, 44, 49))} {p.choice((f'({a}) {b}-{c}', f'{a} {b} {c}', f'{a}-{b}-{c}'))}"

    def other_form(self, kind: int, text: str) -> str:
        """The same thing as the patterns don't know it."""
        p = self.pick
        if kind == 0:
            at, dot = p.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "."), (" {at} ", " {dot} ")))
            local, _, domain = text.partition("@")
            return f"{local}{at}{domain.replace('.', dot)}"
        if kind == 1:
            return text.replace(".", "[.]")
        if kind == 2:
            d = _digits(text)
            sign = p.choice((".", "/", ":"))
            return sign.join(d[k : k + 4] for k in range(0, len(d), 4))
        d = _digits(text)[-10:]
        a, b, c = d[:3], d[3:6], d[6:]
        return p.choice((f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", f"00{p.choice((1, 33, 44))} {a} {b} {c}"))

    def distractor(self) -> str:
        p, n = self.pick, self.number
        return p.choice(
            (
                lambda: f"{p.randint(1900, 2100)}", lambda: f"{p.randint(1, 12)}.{p.randint(0, 20)}", lambda: f"{p.randint(1, 9)}.{p.randint(0, 9)}.{p.randint(0, 30)}",
                lambda: f"{p.randint(1900, 2100)}-{p.randint(1, 12):02}-{p.randint(1, 28):02}", lambda: f"{p.randint(0, 23)}:{n(2)}:{n(2)}",
                lambda: f"{p.randint(1, 31)}.{p.randint(1, 12)}.{p.randint(1900, 2100)}", lambda: f"{p.randint(1, 99)},{n(3)}.{n(2)}", lambda: f"{n(p.randint(1, 9))}",
                lambda: n(p.randint(10, 24)), lambda: f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", lambda: f"{p.randint(1900, 2000)}-{p.randint(2000, 2100)}",
                lambda: "".join(p.choice("0123456789abcdef") for _ in range(p.choice((8, 32, 40)))), lambda: f"(c) {p.randint(1990, 2030)}",
                lambda: f"@{self.word()}", lambda: f"{n(3)} {n(3)}", lambda: f"({p.randint(1, 99)})", lambda: f"{n(2)}%", lambda: f"{n(3)}-{n(4)}",
                lambda: f"{n(2)}.{n(4)}/{n(5)}", lambda: f"{p.randint(256, 999)}.{n(3)}.{n(3)}.{n(3)}", lambda: f"http://{self.word()}.com/{n(4)}",
                lambda: f"{self.word()}{n(2)}", lambda: f"{n(1)}/{n(1)}", lambda: f"{n(4)}/{n(2)}/{n(2)} {n(2)}:{n(2)}",
            )
        )()

    def text(self) -> tuple[str, list[Span]]:
        """A text with such things in it, and (start, end, kind) of what is personal data."""
        p, parts, spans, known = self.pick, [], [], []
        size = 0

        def add(part: str, kind: int | None = None) -> None:
            nonlocal size
            if kind is not None:
                spans.append((size, size + len(part), kind))
            parts.append(part)
            size += len(part)

        for _ in range(p.randint(2, 9)):
            add(" ".join(self.word() for _ in range(p.randint(1, 6))) + p.choice((" ", " ", ": ", ", ")))
            what = p.random()
            if what < 0.3:
                kind, usual = self.entity()
                known.append((kind, usual))
                add(usual, kind)
            elif what < 0.6:
                kind, usual = p.choice(known) if known and p.random() < 0.6 else self.entity()
                add(self.other_form(kind, usual), kind)
            else:
                add(self.distractor())
            add(p.choice((" ", ". ", ", ", "\n", "### ")))
        return "".join(parts), spans


def labels_of(spans: Iterable[tuple[int, int]], marked: list[Span], nothing: int) -> list[int]:
    """The kind of the first marked span that a token overlaps, else ``nothing``."""
    marked = sorted(marked)
    out, k = [], 0
    for a, b in spans:
        while k < len(marked) and marked[k][1] <= a and (k + 1 == len(marked) or marked[k + 1][0] <= a):
            k += 1
        here = [s for s in marked[max(0, k - 2) : k + 3] if s[0] < b and a < s[1]]
        out.append(here[0][2] if here else nothing)
    return out


def examples(texts: list[str], composed: int = COMPOSED, seed: int = 5) -> list[tuple[Graph, list[int], list[int]]]:
    """Training graphs of texts, labelled by their base spans, and of composed ones."""
    make, out = Composer(seed), []
    labelled = [(t, base_spans(t)) for t in texts] + [make.text() for _ in range(composed)]
    for k, (text, marked) in enumerate(labelled):
        spans = tokens(text)
        if spans:
            base = labels_of(spans, base_spans(text), -1)
            # As evidence in every other text, as something to be learnt in the rest.
            out.append((graph(text, spans), labels_of(spans, marked, NONE), base if k % 2 else [-1] * len(spans)))
    return out


def learn_private_data(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE, composed: int = COMPOSED) -> Field:
    """Train on up to ``sample`` texts that hold a digit or an at sign, by a hash of the text, and ``composed`` made ones.

    NULL texts and an empty table leave the composed ones.
    """
    rows = docs.where(F.col(f"`{text}`").rlike("[0-9@]")).select(F.col(f"`{text}`").alias("text"))
    return train(examples([r.text for r in sample_rows(rows, ["text"], sample)], composed))


# ------------------------------------------------------------- search


def added_spans(text: str, spans: list[tuple[int, int]], known: list[int], probabilities: np.ndarray) -> list[Span]:
    """What the field finds beside the evidence; neighbours of a kind that are no whole by themselves are one span."""
    out: list[Span] = []
    open_end = False
    for (a, b), fixed, p in zip(spans, known, probabilities, strict=True):
        label = int(p.argmax())
        if fixed >= 0 or label == NONE or p[label] < SURE:
            open_end = False
            continue
        alone = len(_digits(text[a:b])) >= 10 or label < 2
        if open_end and not alone and out[-1][2] == label and a - out[-1][1] <= GAP:
            out[-1] = (out[-1][0], b, label)
        else:
            out.append((a, b, label))
        open_end = not alone
    # A telephone or card number has more digits than a part of one.
    least = {2: 14, 3: 10}
    return [s for s in out if len(_digits(text[s[0] : s[1]])) >= least.get(s[2], 0)]


def find_spans(field: Field, texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    spans = [tokens(t) for t in texts]
    known = [labels_of(s, b, -1) for s, b in zip(spans, base, strict=True)]
    graphs = [graph(t, s) for t, s in zip(texts, spans, strict=True)]
    for t, s, k, b, p in zip(texts, spans, known, base, field.probabilities(graphs, known), strict=True):
        yield b, sorted([*b, *added_spans(t, s, k, p)], key=lambda x: (x[0], x[2], x[1]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = pa.struct([("base", pa.list_(_SPAN)), ("spans", pa.list_(_SPAN))])
_CANDIDATE = re.compile(r"[0-9@]|[(\[{][aA][tT][)\]}]")


def find_private_data(docs: DataFrame, field: Field, *, text: str = "text", name: str = "private") -> DataFrame:
    """Add ``name`` (base, spans): arrays of (kind, start, end) in code points, the end exclusive.

    ``base`` is what the patterns find, ``spans`` that and what the field adds, by start
    and by kind as in ``KINDS``. Whole texts are searched; NULL and empty ones have none.
    Each row is searched for itself, so rows that repeat have equal results. Other
    columns stay; one called ``name`` is replaced.
    """
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(field)

    @F.arrow_udf("struct<base:array<struct<kind:string,start:bigint,end:bigint>>,spans:array<struct<kind:string,start:bigint,end:bigint>>>")
    @lean
    def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            texts = column.fill_null("").to_pylist()
            out: list[dict] = [{"base": [], "spans": []} for _ in texts]
            held = [k for k, t in enumerate(texts) if _CANDIDATE.search(t)]
            for k, (base, spans) in zip(held, find_spans(shared.value, [texts[k] for k in held]), strict=True):
                out[k] = {n: [{"kind": KINDS[c], "start": a, "end": b} for a, b, c in s] for n, s in (("base", base), ("spans", spans))}
            yield pa.array(out, _FOUND)

    return docs.withColumn(name, find(F.col(f"`{text}`")))


def mask_private_data(docs: DataFrame, field: Field, *, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans are one, of the first's kind.

    NULL texts stay NULL; all columns stay.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("string")
    @lean
    def mask(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            texts = column.to_pylist()
            out = []
            for t, (_, spans) in zip(texts, find_spans(shared.value, [t or "" for t in texts]), strict=True):
                pieces, at = [], 0
                for a, b, kind in spans:
                    if a >= at:
                        pieces += [t[at:a], f"<{KINDS[kind]}>"]
                    at = max(at, b)
                out.append(None if t is None else "".join([*pieces, t[at:]]))
            yield pa.array(out, pa.string())

    return docs.withColumn(text, mask(F.col(f"`{text}`")))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


@query("op12_personal_data")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document: counts and a digest of the base spans, and all spans."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_private_data(docs, learn_private_data(docs)).select("doc_id", "private.*")
    counts = [F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
