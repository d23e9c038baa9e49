"""The training-data operators on small frames: brute force, round trips and odd rows."""

import gzip
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.llm import (
    decontaminate,
    embedding_dedup,
    extraction,
    jaccard_join,
    language,
    mixing,
    sharding,
    tokens,
    warc,
)
from tallyscope.llm.components import connected_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, found string, shard string, copy string, language string, _x int"
LONG = "Eine sehr lange Zeile mit vielen Wörtern, und noch mehr. " * 4_000


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [
        (1, "the same words here and there", "en", "a"),
        (1, "the same words here and there", "en", "a"),
        (2, "The same  words\nhere and there", None, None),
        (3, None, "en", "b"),
        (4, "", None, "a"),
        (5, " \n\t ", "de", None),
        (6, "123 !!", "de", "b"),
        (7, LONG, "de", "b"),
        (8, "mot", "fr", "a"),
        (None, "no id at all", "en", "a"),
        (None, None, None, None),
    ]
    return spark.createDataFrame([(*r, None, "f", "s", "c", "l", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------ 1


def windows(text, n=13):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " " for c in words).split(" ")
    words = [w for w in words if w]
    n = min(n, len(words))
    return words, {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def test_contamination_by_brute_force(spark):
    pick = random.Random(3)
    word = lambda: pick.choice("ab cd ef ghé 12 Ij".split())
    items = [(k, " ".join(word() for _ in range(pick.choice((0, 1, 4, 12, 13, 14, 20))))) for k in range(12)] + [(1, "second text"), (None, "no id"), (20, None)]
    docs = []
    for k in range(80):
        parts = [" ".join(word() for _ in range(pick.randint(0, 30)))]
        for _ in range(pick.randint(0, 2)):
            parts.insert(pick.randint(0, len(parts)), pick.choice(items)[1] or "")
        docs.append((k, ", ".join(parts)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    for k, text in docs:
        words, _ = windows(text)
        hit, found = set(), set()
        for item, body in items:
            for w in windows(body)[1]:
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i : i + len(w)]) == w:
                        hit |= set(range(i, i + len(w)))
                        if item is not None:
                            found.add(str(item))
        want[k] = (len(words), len(hit), sorted(found))
    for block in (8 << 20, 200):  # in one block and in several
        out = decontaminate.find_benchmark_text(frame, bench, block_bytes=block)
        rows = out.select("doc_id", "found.n_words", decontaminate.hit_words().alias("h"), "found.items").collect()
        assert {r[0]: (r[1], r[2], r[3]) for r in rows} == want


def test_benchmark_text_is_cut_or_dropped(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "Start: One, two THREE! end"), (2, "clean"), (3, None), (4, "")], "doc_id bigint, text string")
    cut = {r.doc_id: r.text for r in decontaminate.cut_benchmark_text(docs, bench).collect()}
    assert cut == {1: "Start: ! end", 2: "clean", 3: None, 4: ""}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 3, 4]


def test_contamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "same words here")], "item_id bigint, text string")
    out = decontaminate.find_benchmark_text(odd, bench)
    assert out.columns == odd.columns
    rows = out.select("doc_id", "found.n_words", "found.items").collect()
    assert len(rows) == 11 and [r.n_words for r in rows if r.doc_id in (3, 4, 5)] == [0, 0, 0]
    assert [r["items"] for r in rows if r.doc_id in (1, 2)] == [["1"]] * 3
    assert decontaminate.drop_contaminated(odd, bench).columns == odd.columns
    assert decontaminate.find_benchmark_text(empty, bench).count() == 0
    assert decontaminate.find_benchmark_text(odd, bench.where("false")).where(F.size("found.items") > 0).count() == 0


# ------------------------------------------------------------------ 2


def test_shards_are_contiguous_and_even(spark):
    pick = random.Random(1)
    rows = [(k, pick.choice((1, 5, 90, 1000))) for k in range(700)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id bigint, size bigint").repartition(7), 8, ["doc_id"], F.col("size"))
    found = sorted(out.collect())
    total, start, slots = sum(s for _, s in rows), 0, {}
    for r in found:
        assert r.shard == min(7, start * 8 // total)
        assert r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1
        start += r.size
    assert len(found) == 700


def test_shards_of_odd_rows(odd, empty):
    out = sharding.shard_by_bytes(odd, 3, ["doc_id"], sharding.text_size())
    assert out.count() == 11 and dict(out.dtypes)["shard"] == "int" and out.columns[-1] == "slot"
    assert sharding.shard_by_bytes(empty, 3, ["doc_id"], sharding.text_size()).count() == 0


# ------------------------------------------------------------------ 3


def test_copies_follow_the_poisson_distribution(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    out = mixing.mix_sources(docs, weights)
    n = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["a"] - 20_000) < 600 and abs(n["b"] - 20_000) < 600
    times = out.where("source = 'a'").groupBy("doc_id").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    share = {r["count"]: r.n / 10_000 for r in times}
    for k, p in ((1, 0.2707), (2, 0.2707), (3, 0.1804), (4, 0.0902)):  # Poisson with mean 2
        assert abs(share[k] - p) < 0.02
    again = mixing.mix_sources(docs.repartition(5), weights)
    assert out.exceptAll(again).count() == 0 and again.exceptAll(out).count() == 0


def test_large_and_zero_rates(spark):
    docs = spark.range(1_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") == 0, "tiny").otherwise("rest").alias("source"))
    out = mixing.mix_sources(docs, spark.createDataFrame([("tiny", 2.0), ("none", 5.0)], "source string, weight double"))
    assert {r.source for r in out.select("source").distinct().collect()} == {"tiny"} and 800 < out.count() < 1200


def test_mixing_odd_rows(odd, empty):
    out = mixing.mix_sources(odd, budget=5.0)
    assert out.columns == [c for c in odd.columns if c != "copy"] + ["copy"]
    assert out.where("source IS NULL").count() > 0
    assert mixing.mix_sources(empty).count() == 0


# ------------------------------------------------------------------ 4


def test_article_text():
    field = extraction.train(extraction.labelled_layouts([], 200, seed=1), steps=80)
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class=cookie-notice>We use cookies</div><article><h1>A &amp; B</h1><p><b>First\n  line<br>goes&nbsp;on<p>Second &#8364; line.</p>"
        "<!-- no --></article><section class=comments><p>I agree with this</p></section><footer>&copy; x</footer></body></html>"
    )
    assert extraction.main_text(field, page) == "A & B\nFirst line goes on\nSecond € line."
    assert extraction.main_text(field, "") == "" and extraction.main_text(field, "<p></p>") == ""


@pytest.mark.parametrize(
    "head",
    [
        "<html><head><title>T</title>",
        "<head><meta charset=utf-8><title>T</title><noscript><div>no</div><img src=x></noscript><template><p>no</p></template>\n",
        "<head><head><style>p{}</style><title>T</title><img src=x><script>'<p>no'</script></head><body>",
        "<head><title>T</title><body>",
    ],
)
@pytest.mark.parametrize("first", ["<article><p>", "<p>", "<a href=/>", "<b>", "<x-part>", "", "&nbsp;"])
def test_head_ends_without_its_end_tag(head, first):
    texts = [b.text for b in extraction.leaf_blocks(f"{head}{first}Words of an article.<p>And its end.")]
    assert texts == ["Words of an article.", "And its end."]


def test_article_of_page_without_optional_tags():
    field = extraction.train(extraction.labelled_layouts([], 200, seed=1), steps=80)
    page = "<!doctype html><title>T</title><nav><a href=/>Home</a></nav><article><h1>A</h1><p>First line of it.<p>Second line.</article><footer>&copy; x</footer>"
    assert extraction.main_text(field, page.replace("<title>", "<html><head><title>")) == extraction.main_text(field, page) == "A\nFirst line of it.\nSecond line."


def test_formulas_stay_in_their_block():
    page = "<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.<p>End."
    assert [b.text for b in extraction.leaf_blocks(page)] == ["So x=1 holds.", "End."]


def test_training_reads_whole_pages(spark):
    end = "<p>Words here.</p></article>" + "<div class=qqq>Words here.</div>" * 20
    for page in ("<article>" + "<p>Words here.</p>" * 150 + end, f"<article><p>{'word ' * 50_000}</p>{end}"):
        pages = spark.createDataFrame([(1, page)], "page_id bigint, html string")
        field = extraction.learn_from_pages(pages, layouts=0)
        blocks = extraction.leaf_blocks(page)
        assert field.decode(field.scores(*extraction.features(blocks))) == [True] * (len(blocks) - 20) + [False] * 20


def test_field_decodes_unseen_layouts():
    texts = ["Some words of a text, and more of them. Then another sentence follows here."] * 3
    field = extraction.train(extraction.labelled_layouts(texts, 400, seed=2), steps=120)
    right = total = 0
    for blocks, labels in extraction.labelled_layouts(texts, 100, seed=3):
        if blocks:
            got = field.decode(field.scores(*extraction.features(blocks)))
            right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_path():
    pick = np.random.default_rng(4)
    for _ in range(30):
        field = extraction.Field(np.zeros((1, 2)), pick.normal(size=(2, 2)))
        scores = pick.normal(size=(6, 2))
        value = lambda y: sum(scores[t, v] for t, v in enumerate(y)) + sum(field.steps[a, b] for a, b in zip(y, y[1:], strict=False))
        best = max(((k >> np.arange(6)) & 1 for k in range(64)), key=lambda y: value(y.tolist()))
        assert field.decode(scores) == [bool(v) for v in best]
        single, _ = extraction._marginals(scores[None], np.ones((1, 6), dtype=bool), field.steps)
        every = [((k >> np.arange(6)) & 1).tolist() for k in range(64)]
        weight = np.exp([value(y) for y in every])
        assert np.allclose(single[0, :, 1], np.array(every).T @ weight / weight.sum())


def test_extraction_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 2), (None, "u", "<article><p>x y</p></article>", 3)], "page_id bigint, url string, html string, text int")
    out = extraction.extract_main_text(pages, extraction.learn_from_pages(pages, layouts=100))
    assert {(r.page_id, r.text) for r in out.collect()} == {(1, ""), (2, ""), (None, "x y")}
    assert extraction.extract_main_text(pages.where("false"), extraction.learn_from_pages(pages.where("false"), layouts=5)).count() == 0


# ------------------------------------------------------------------ 5


def test_pruned_comparison_loses_nothing():
    pick = np.random.default_rng(0)
    raw = pick.normal(size=(12, 40))[pick.integers(0, 12, 300)] + 0.25 * pick.normal(size=(300, 40))
    unit = raw / np.linalg.norm(raw, axis=1)[:, None]
    i, j, cosine = embedding_dedup.compare(unit, unit, 0.93)
    want = np.argwhere(unit @ unit.T >= 0.93)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist())) and len(want) > 400
    assert np.allclose(cosine, (unit @ unit.T)[i, j], atol=1e-12)


@pytest.mark.parametrize("same", [True, False])
def test_tiles_lose_no_pair_and_pass_over_most_of_uneven_vectors(monkeypatch, same):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    pick = np.random.default_rng(3)
    # Three axes hold nearly all of the length.
    raw = pick.normal(size=(900, 24)) * np.array([1.0] * 3 + [0.02] * 21)
    unit = raw / np.linalg.norm(raw, axis=1)[:, None]
    a, b = (unit, unit) if same else (unit[:400], unit[400:])
    met, found = 0, set()
    for x, y in embedding_dedup.close_tiles(a, b, 0.99, same):
        assert max(len(x), len(y)) <= 16
        met += 1
        i, j, _ = embedding_dedup.compare(a[x], b[y], 0.99)
        found |= set(zip(x[i].tolist(), y[j].tolist(), strict=True))
    want = {(i, j) for i, j in np.argwhere(a @ b.T >= 0.99).tolist()}
    assert (found | {(j, i) for i, j in found} if same else found) == want and sum(i != j for i, j in want) > 400
    tiles_a, tiles_b = (len(embedding_dedup.cut(t, 16)) for t in (a, b))
    every = tiles_a * (tiles_a + 1) // 2 if same else tiles_a * tiles_b
    assert met < 0.2 * every


def test_pairs_on_the_threshold_and_huge_components(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 2)
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 48)
    rows = [(0, [1.0, 0.0, 0.0]), (1, [3.0, 4.0, 0.0]), (2, [0.6, 0.8 + 1e-7, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 0.0, 1e200]), (5, [0.0, 1e190, 1e200])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int")
    out = embedding_dedup.embedding_classes(table, threshold=0.6)
    # 0 and 1 have a cosine of exactly 3 / 5, 2 lies a hair below it; 0 and 3 are equal.
    assert {(r.vec_id, r.n_links, r.component_id) for r in out.collect()} == {(0, 2, 0), (1, 3, 0), (2, 1, 0), (3, 2, 0), (4, 1, 4), (5, 1, 4)}


def test_embedding_classes(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 24 * 8 * 40)
    pick = np.random.default_rng(5)
    base = pick.normal(size=(9, 24))
    rows = [(k, (base[k % 9] + 0.2 * pick.normal(size=24)).tolist(), int(k % 3 == 0), 1) for k in range(150)]
    rows += [(200, rows[3][1], rows[3][2], 1), (201, rows[3][1], None, 1), (202, None, 1, 1), (203, [0.0] * 24, 1, 1), (204, [float("nan")] * 24, 1, 1), (205, [1.0], 1, 1), (206, [2.0], 1, 1), (207, [], 1, 1), (208, [None, 1.0], 1, 1)]
    out = {r.vec_id: r for r in embedding_dedup.embedding_classes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, kept int")).collect()}
    fine = [(k, np.array(v), y) for k, v, y, _ in rows if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = {k: set() for k, *_ in rows}
    for a, u, y in fine:
        for b, v, z in fine:
            if a != b and y == z and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93:
                links[a].add(b)
    assert {k: out[k].n_links for k in links} == {k: len(v) for k, v in links.items()}
    for k in links:
        reach, todo = {k}, [k]
        while todo:
            todo += [x for x in links[todo.pop()] if x not in reach and not reach.add(x)]
        assert out[k].component_id == min(reach) and out[k].kept == (k == min(reach))
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_dedup.embedding_classes(none).count() == 0


@pytest.mark.parametrize("copies", [1, 4])
def test_embeddings_of_one_class(spark, copies):
    rows = [(k, [1.0, 2.0, 0.5], 1) for k in range(copies)] + [(9, None, 1)]
    out = embedding_dedup.embedding_classes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert {tuple(r) for r in out.collect()} == {(k, copies - 1, 0, k == 0) for k in range(copies)} | {(9, 0, 9, True)}


# ------------------------------------------------------------------ 6


def test_damaged_archives(spark, tmp_path):
    def record(name, block, length=None, kind="application/http; msgtype=response"):
        size = len(block) if length is None else length
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {name}\r\nContent-Type: {kind}\r\nContent-Length: {size}\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(
        record("whole", http + b"one") + record("bare", b"not a message\r\n\r\nWARC/1.1") + record("nolength", http + b"two", "x")
        + b"rubbish\n" * 3 + record("later", http + b"three") + record("cut", http + b"four")[:-6]
    )
    (tmp_path / "b.warc").write_bytes(record("short", http + b"five", 21) + record("next", http + b"six") + record("endless", http[:-2]))
    packed = gzip.compress(record("packed", http + b"seven")) + gzip.compress(record("lost", http + np.random.default_rng(1).bytes(5_000)))
    (tmp_path / "c.warc.gz").write_bytes(packed[:-2_000])
    (tmp_path / "d.warc").write_bytes(b"")
    (tmp_path / "e.warc").write_bytes(b"\x00" * 100)
    (tmp_path / "f.warc").write_bytes(record("last", b"plain", kind="text/plain"))
    back = warc.read_warc(spark, str(tmp_path), partitionBytes="1000000")
    got = Counter((r.record_id, bytes(r.payload) if r.payload is not None else None, r.damage) for r in back.collect())
    assert got == Counter([
        ("whole", b"one", None),
        ("bare", b"not a message\r\n\r\nWARC/1.1", "no HTTP message"),
        ("nolength", None, "no length"),
        ("later", b"three", None),
        ("cut", b"fo", "cut off"),
        ("short", b"fi", None),
        (None, None, "no record starts here"),
        ("next", b"six", None),
        ("endless", b"", None),
        ("packed", b"seven", None),
        (None, None, "broken compression"),
        (None, None, "no record starts here"),
        ("last", b"plain", None),
    ])
    lengths = {(r.record_id, r.damage) for r in warc.read_warc(spark, str(tmp_path), payload="false").where("record_type = 'response'").collect()}
    assert ("cut", "cut off") in lengths and ("later", None) in lengths and not any(name is None for name, _ in lengths)


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "u1", "same é"), (2, "u2", "same é"), (3, None, None), (4, "a\r\nb", ""), (5, "u5", "x\r\n\r\nWARC/1.1\r\n" * 3), (2, "u2", "same é"), (None, "n", "other")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, payload int")
    warc.write_warc(warc.to_records(pages), str(tmp_path / "w"), fileBytes="300")
    back = warc.read_warc(spark, str(tmp_path / "w"), partitionBytes="500")
    got = {(r.record_id, r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload) if r.payload is not None else None) for r in back.collect()}
    urn = "<urn:page:{}>".format
    assert got == {
        (urn(1), "revisit", urn(2), 7, None),
        (urn(2), "response", None, 7, "same é".encode()),
        (urn(3), "revisit", urn(4), 0, None),
        (urn(4), "response", None, 0, b""),
        (urn(5), "response", None, len(rows[4][2]), rows[4][2].encode()),
        (urn(""), "response", None, 5, b"other"),
    }
    assert back.count() == 7
    revisits = back.where("record_type = 'revisit' AND target_uri LIKE 'u%'")
    assert [r.target_uri for r in revisits.collect()] == ["u1"]
    headers = warc.read_warc(spark, str(tmp_path / "w"), payload="false")
    assert headers.where("payload IS NOT NULL").count() == 0


def test_only_committed_files_count(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id bigint, url string, html string")
    warc.write_warc(warc.to_records(pages), str(tmp_path / "w"))
    (tmp_path / "w" / "left-by-a-lost-task.warc").write_bytes(b"WARC/1.1\r\nbroken")
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 1
    warc.write_warc(warc.to_records(pages.where("false")), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_filters_are_decided_by_headers():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = warc.WarcReader({"path": "/x"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and len(reader.filters) == 1


# ------------------------------------------------------------------ 7


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs, language.learn_from_documents(docs)).withColumn("h", language.held_out())
    r = out.where("h").agg(F.avg((F.col("lang") == F.col("language.lang")).cast("double")), F.min("language.score"), F.max("language.score")).first()
    assert r[0] > 0.98 and r[1] >= 0 and r[2] <= 1


def test_language_of_odd_rows(odd, empty):
    model = language.learn_from_documents(odd)
    assert model.languages == ["de", "en", "fr"]
    rows = language.identify(odd, model).select("doc_id", "language.lang", "language.score").collect()
    assert all(r.lang == "und" and r.score == 0 for r in rows if r.doc_id in (3, 4, 5, 6))
    assert len(rows) == 11 and all(r.lang in model.languages for r in rows if r.doc_id in (1, 2, 7, 8))
    assert language.keep_known_language(odd, model).columns == odd.columns
    nothing = language.learn_from_documents(empty)
    assert {r.language.lang for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0


# ------------------------------------------------------- 8 and 10


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary())


def test_pieces_encode_like_whole_texts(library):
    pick, own = random.Random(5), tokens.Encoder(tokens.vocabulary())
    alphabet = [*"abXY01 \n\t.,;'_-!?é漢½🙂 \u0085", "'s", "'re", " the", "\n\n", "  ", "<|endoftext|>", "%%%"]
    for _ in range(3_000):
        text = "".join(pick.choice(alphabet) for _ in range(pick.randint(0, 14)))
        want = library.encode(text, add_special_tokens=False)
        assert np.frombuffer(own.ids([text])[0], dtype=own.kind).tolist() == want.ids, repr(text)
        assert [tuple(x) for x in own.spans([text])[0].tolist()] == want.offsets, repr(text)


@pytest.mark.parametrize("remembered", [1_000_000, 40])
def test_pieces_of_many_texts(library, monkeypatch, remembered):
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    pick, own = random.Random(6), tokens.Encoder(tokens.vocabulary())
    words = ["the", "and", "naïve", "Straße", "漢字", "x1", "don't", "end.", "a,b", "!!", "tab\there", "new\nline", "", "<|endoftext|>", "nul\0"]
    for _ in range(60):
        texts = [" ".join(pick.choice(words) for _ in range(pick.randint(0, 30))) for _ in range(20)]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(raw, dtype=own.kind).tolist() for raw in own.ids(texts)] == want


def test_equal_hashes_of_different_pieces_change_nothing(library, monkeypatch):
    weak = lambda data, starts, ends: (ends - starts).astype(np.uint64)
    for hashes in (weak, lambda data, starts, ends: data[ends - 1].astype(np.uint64)):
        monkeypatch.setattr(tokens, "piece_hashes", hashes)
        own = tokens.Encoder(tokens.vocabulary())
        for texts in (["one two", "six ten, as"], ["abc!! def??", "abc"], ["one"], ["won two"], ["ab", "cd"]):
            want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
            assert [np.frombuffer(raw, dtype=own.kind).tolist() for raw in own.ids(texts)] == want


def test_tokens_by_section(odd, empty, library):
    rows = tokens.section_token_counts(odd, tokens.vocabulary()).collect()
    sums = {}
    for r in rows:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.n_tokens
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    want = {}
    for k, t in texts:
        want[k] = want.get(k, 0) + len(library.encode(t, add_special_tokens=False).ids)
    assert sums == want and tokens.section_token_counts(empty, tokens.vocabulary()).count() == 0
    spans = np.array([[0, 3], [3, 7], [7, 8], [8, 12]])
    assert tokens.attribute(spans, np.array([0, 5, 10, 12])).tolist() == [2, 2, 0]


def test_packed_numbers_round_trip():
    pick = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (pick.integers(0, 1 << 32, n, dtype=np.uint64) >> pick.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        controls, data = tokens.pack(x)
        assert (tokens.unpack(np.frombuffer(controls, np.uint8), np.frombuffer(data, np.uint8), n) == x).all()
        assert len(controls) == -(-n // 4)


def test_token_files(spark, odd, empty, library, tmp_path):
    folder = f"file://{tmp_path}/t"
    manifest = tokens.write_token_files(odd, folder, tokens.vocabulary(), file_tokens=20)
    assert manifest.count() > 2
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read_token_files(manifest, folder).collect())
    at, want = 0, []
    for r in sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str(x[1:]) for x in got) and [x[1] for x in got] == [x[0] for x in want]
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert tokens.read_token_files(tokens.write_token_files(empty, folder, tokens.vocabulary()), folder).count() == 0


# ------------------------------------------------------------------ 9


def classes_by_brute_force(docs, words=3, percent=90):
    sets = {}
    for k, text in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
        w = [x for x in w if x]
        n = min(words, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    label = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared) and label[a] != label[b]:
                    low, high = sorted((label[a], label[b]))
                    label = {k: low if v == high else v for k, v in label.items()}
    return {k: (len(sets[k]), label[k]) for k in sets}


@pytest.mark.parametrize("tile", [400, 5])
def test_jaccard_classes_by_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE_SETS", tile)
    pick = random.Random(8)
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE\ttwo"), (5, "one")]
    for k in range(6, 150):
        if k < 20 or pick.random() < 0.3:
            text = " ".join(pick.choice("a b c d e f g h é ſ".split()) for _ in range(pick.choice((3, 12, 40, 200))))
        else:
            words = pick.choice(docs[6:])[1].split(" ")
            for _ in range(pick.choice((0, 1, 1, 2, 5))):
                words[pick.randrange(len(words))] = pick.choice("xyz")
            text = " ".join(words)
        docs.append((k, text))
    out = jaccard_join.jaccard_classes(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5))
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == classes_by_brute_force(docs)


def test_jaccard_of_ids_with_several_texts(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "a b c d e"), (5, "a b c d e"), (5, "q r s t u v w"), (5, "q r s t u v w"), (9, "q  r s t u v W"), (7, long), (7, "x y z"), (3, f"{long} thirteen"), (8, None), (8, "x y z"), (2, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in jaccard_join.jaccard_classes(docs).collect())
    assert got == sorted([(1, 3, 1), (5, 3, 1), (5, 5, 5), (5, 5, 5), (9, 5, 5), (7, 10, 3), (7, 1, 2), (3, 11, 3), (8, 0, 8), (8, 1, 2), (2, 1, 2)])
    heads = sorted((r.doc_id, r.text or "") for r in jaccard_join.class_heads(docs).collect())
    assert heads == sorted([(1, "a b c d e"), (5, "q r s t u v w"), (5, "q r s t u v w"), (3, f"{long} thirteen"), (8, ""), (2, "x y z")])


def test_jaccard_of_odd_rows(odd, empty):
    out = jaccard_join.jaccard_classes(odd)
    rows = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_shingles))
    assert [(r.doc_id, r.component_id) for r in rows] == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (None, None), (None, None)]
    assert [r.n_shingles for r in rows][:7] == [4, 4, 4, 0, 0, 0, 1] and rows[-1].n_shingles == 2
    assert jaccard_join.jaccard_classes(empty).count() == 0
    heads = jaccard_join.class_heads(odd)
    assert heads.columns == odd.columns and heads.where("doc_id = 2").count() == 0 and heads.count() == 10


def test_signatures_meet_for_every_linked_pair():
    pick = np.random.default_rng(1)
    for _ in range(150):
        base = pick.integers(0, 1 << 63, int(pick.integers(1, 300)), dtype=np.uint64)
        other = np.concatenate([base[pick.random(len(base)) > 0.05], pick.integers(0, 1 << 63, int(pick.integers(0, 8)), dtype=np.uint64)])
        sets = [np.unique(base), np.unique(other)]
        if not len(sets[1]):
            continue
        shared = len(np.intersect1d(*sets))
        if 100 * shared >= 90 * (len(sets[0]) + len(sets[1]) - shared) and not np.array_equal(*sets):
            value, owner = jaccard_join.signatures(sets)
            assert set(value[owner == 0].tolist()) & set(value[owner == 1].tolist())
            labels = jaccard_join.join_sets(sets)
            assert labels[0] == labels[1]


def test_components(spark):
    pick = random.Random(4)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)] + [(7, 7), (None, 3)]
    label = list(range(500))
    for a, b in edges:
        if a is not None and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    frame = spark.createDataFrame(edges, "a bigint, b bigint").repartition(6)
    got = {r.node: r.component for r in connected_components(frame).collect()}
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {k: label[k] for k in nodes}
    assert connected_components(frame.where("false")).count() == 0


# ------------------------------------------------------------- pipeline


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, now = docs.columns, docs
    for k, (name, stage) in enumerate(p.STAGES):
        before = [tuple(r) for r in now.collect()]
        now = stage(spark, now, folder)
        now = spark.createDataFrame(now.collect(), now.schema)
        rows = [tuple(r) for r in now.collect()]
        assert now.columns == columns + (["shard", "slot"] if k == len(p.STAGES) - 1 else [])
        if name in ("language", "near copies", "benchmark"):
            assert set(rows) <= set(before)
        if name == "near copies":
            classes = classes_by_brute_force([(r[0], r[1]) for r in before])
            assert {r[0] for r in rows} == {c for _, c in classes.values()}
        if name == "shards":
            assert sorted(map(json.dumps, (r[:5] for r in rows))) == sorted(map(json.dumps, before))
    run = p.run(spark, folder)
    assert sorted(map(str, run.collect())) == sorted(map(str, now.collect()))


def test_pipeline_on_odd_rows(spark, odd, empty):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), empty.select("doc_id", "text", "lang", "source", "n_chars")):
        now = docs
        for _, stage in p.STAGES:
            now = stage(spark, now, folder)
            now = spark.createDataFrame(now.collect(), now.schema)
        assert now.columns[:5] == docs.columns
