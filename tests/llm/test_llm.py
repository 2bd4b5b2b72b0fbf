"""Each operator against a brute-force version or an exact round trip, and on its edge cases."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polis.llm import common, decontamination, language_id, language_model, mixing, near_dedup, pivot_search, queries, recurrent, suffix_dedup, token_counts, toxicity, warc
from polis.llm.components import components
from polis.llm.recurrent import backward, forward
from tests_llm_brute import brute_components, brute_removed, brute_targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))


def docs(spark, texts, start=1):
    return spark.createDataFrame([(start + k, t, ("en", "fr")[k % 2], f"s{k % 3}", None) for k, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, "some words that stand here for a test of nulls", "en", "a", 3), (3, LONG, "fr", "b", 1), (4, "one two three four five six", "en", "a", 1), (4, "one two three four five six", "en", "a", 1), (5, "ONE two three four five six", "fr", "b", 2), (6, "…", "fr", None, 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "doc_id AS block", "text AS key", "1 AS row", "lang AS label", "0.5 AS score", "'x' AS kept", "'y' AS component", "2 AS n", "'z' AS word")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 7)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


# --- 1 Token counts ---------------------------------------------------------------------------------------------------------


def test_token_counts_are_the_library_s(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.op1_token_counts(spark, sf_dir).collect()}
    for r in table.collect():
        assert own[r.doc_id] == (len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids))
    hard = ["<|endoftext|> a", "don't  stop here now", "a\x85b\x1cc", "ﬁ ﬀ ß İ ǅ", "中文 日本語 a1b2", "é ́x", "x" * 5000, "​ ﻿", "<|startoftext|>x<|endoftext|>"]
    assert token_counts.count_tokens(hard, "word_bpe_49k.json") == [len(library.encode(t, add_special_tokens=False).ids) for t in hard]


def test_token_counts_edges(odd, empty):
    out = token_counts.token_counts(odd).collect()
    assert len(out) == odd.count() and {r.n_tokens for r in out if r.doc_id in (1, 2)} == {0}
    assert [r.over_limit for r in out if r.doc_id == 3] == [True]
    assert token_counts.token_counts(empty).count() == 0


# --- 2 Language -------------------------------------------------------------------------------------------------------------


def test_language_of_held_out_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out AND lang_pred <> 'und'")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0] > 0.97
    held = {r.doc_id: r.held_out for r in out.collect()}
    assert all(zlib.crc32(str(k).encode()) % 4 == 2 for k, v in held.items() if v)


def brute_languages(rows):
    """Plain word-first backoff: (language, posterior) by doc_id of (doc_id, text, lang)."""
    words = {k: re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (t or "").lower())) for k, t, _ in rows}
    learned = [(k, x) for k, _, x in rows if x is not None and zlib.crc32(str(k).encode()) % 4 != 2]
    names = sorted({x for k, x in learned if words[k]})
    count = {n: {} for n in range(6)}  # 0: words
    for k, x in learned:
        for w in words[k]:
            for n, e in [(0, w), *((n, g) for n in range(1, 6) for g in language_id.grams(w, n))]:
                count[n].setdefault(e, dict.fromkeys(names, 0))[x] += 1
    total = {n: {x: sum(c[x] for c in count[n].values()) for x in names} for n in count}
    log = lambda n, e, x: math.log((count[n][e][x] + 0.1) / (total[n][x] + 0.1 * len(count[n])))
    out = {}
    for k, own in words.items():
        score = {x: math.log((total[0][x] + 1) / sum(v + 1 for v in total[0].values())) for x in names}
        for w in own:
            level, entries = (0, [w]) if w in count[0] else next((n, e) for n in (5, 4, 3, 2, 1) if (e := [g for g in language_id.grams(w, n) if g in count[n]]))
            for x in names:
                score[x] += sum(log(level, e, x) for e in entries) / len(entries)
        best = max(names, key=lambda x: (score[x], [-ord(c) for c in x]))
        out[k] = (best, 1 / sum(math.exp(score[x] - score[best]) for x in names)) if own else ("und", 0.0)
    return out


@pytest.mark.parametrize("held", [language_id.HELD_NUMBERS, 80])
def test_every_language_is_the_brute_one(spark, sf_dir, monkeypatch, held):
    monkeypatch.setattr(language_id, "HELD_NUMBERS", held)
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(9001, "½ ² 12 Ⅷ ①", "en"), (9002, "zzqx ñandú ½x 3ème", None), (9003, "日本語 ไทย e\u0301", "fr")]
    want = brute_languages(rows)
    for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        assert (r.lang_pred, r.score) == (want[r.doc_id][0], pytest.approx(want[r.doc_id][1], rel=1e-6))
    assert want[9001] == ("und", 0.0)


def test_language_edges(odd, empty):
    out = language_id.identify(odd).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 6)} == {"und"} and [r.held_out for r in out if r.doc_id is None] == [False]
    assert language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- 3 Near duplicates ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("numerator", [80, 85])
def test_near_duplicates_match_brute_force(spark, sf_dir, numerator):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_components({r.doc_id: r.text for r in table.collect()}, numerator, 100)
    out = near_dedup.near_duplicates(table, numerator=numerator).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_large_classes_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(40)] + [" ".join(f"z{k}{j}" for j in range(30)) for k in range(20)]
    want = brute_components({k + 1: t for k, t in enumerate(texts)}, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, texts)).collect()} == want


@pytest.mark.parametrize("settled", [0.0, 0.25, 0.99])
def test_balls_of_large_classes_lose_no_link(spark, monkeypatch, settled):
    for name, value in (("NODE", 8), ("BLOCK", 4), ("REPRESENTATIVES", 3), ("SETTLED", settled)):
        monkeypatch.setattr(near_dedup, name, value)
    r = np.random.default_rng(5)
    base, texts = [f"w{k}" for k in range(80)], []
    for family in range(3):  # chains of texts that drift away from one another
        own = [f"f{family}" if k % 27 == 0 else w for k, w in enumerate(base)]
        for _ in range(25):
            own = own.copy()
            own[int(r.integers(80))] = f"x{int(r.integers(10**6))}"
            texts.append(" ".join(own))
            if r.random() < 0.4:
                own = texts[-int(r.integers(1, 5))].split() if len(texts) > 5 else own
    want = brute_components({k + 1: t for k, t in enumerate(texts)}, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, texts)).collect()} == want


def test_pairs_at_the_threshold_in_large_nodes_are_found(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE", 300)
    r, n = np.random.default_rng(1), 4000
    one = r.integers(0, 256, (n, near_dedup.TOKENS)).astype(np.uint8)
    one[:, :59] = 7  # what all share; two sketches of a pair agree in 82 of 96 places
    two = one.copy()
    two[:, 82:] += np.uint8(1)
    both = np.stack([one, two], 1).reshape(2 * n, -1)
    reps = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(both)], "doc_id long, sketch binary")
    found = {r.id: r.component for r in components(near_dedup._candidates(reps, 0.85)).collect()}
    assert [p for p in range(n) if found.get(2 * p, -1) != found.get(2 * p + 1, -2)] == []


@pytest.mark.parametrize("depth", near_dedup.DEPTHS)
def test_trees_give_the_recall(depth):
    r = np.random.default_rng(depth)
    agree, trees = r.random((1000, near_dedup.TOKENS)) < 0.8, near_dedup.trees_for(0.8, depth, 0.02)
    a = r.integers(0, 128, agree.shape).astype(np.uint8)
    met = (near_dedup.paths(a, trees, depth, 5) == near_dedup.paths(a + np.uint8(128) * ~agree, trees, depth, 5)).any(1)
    assert met.mean() >= 0.965


def test_near_duplicates_edges(odd, empty):
    out = near_dedup.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    assert {r.doc_id: r.component_id for r in out} == {1: 1, 2: 2, None: None, 3: 3, 4: 4, 5: 4, 6: 6}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (20, 20), (21, 20)]
    assert {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()} == {**{k: 1 for k in (1, 2, 3, 7, 8, 9)}, 20: 20, 21: 20}


# --- 4 Toxicity -------------------------------------------------------------------------------------------------------------


def test_gradients_are_those_of_differences():
    r = np.random.default_rng(1)
    x, u, h = r.normal(size=(4, 3, 9)).astype(np.float32), r.normal(size=(3, 9)).astype(np.float32), r.normal(size=(3, 3)).astype(np.float32)
    mask, d = (r.random((4, 3)) > 0.2).astype(np.float32), r.normal(size=(4, 3, 3)).astype(np.float32)
    value = lambda x, u: float((forward(x, u, h, mask)[0] * d).sum())
    states, saved = forward(x, u, h, mask, True)
    dx, du = backward(d, states, saved, u, h, mask)
    for a, g, f in ((x, dx, lambda z: value(z, u)), (u, du, lambda z: value(x, z))):
        for at in list(np.ndindex(a.shape))[::5]:
            z = a.copy()
            z[at] += 1e-2
            up = f(z)
            z[at] -= 2e-2
            assert (up - f(z)) / 2e-2 == pytest.approx(float(g[at]), abs=2e-2)


def test_toxicity_of_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    table, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = table.join(marks.select("doc_id", "toxic"), "doc_id")
    out = toxicity.score_toxicity(known.drop("toxic"), marks).filter("held_out").join(marks.select("doc_id", "toxic"), "doc_id")
    rate = {r.toxic: r.p for r in out.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert rate[1] > 0.85 and rate[0] < 0.04


def test_toxicity_scores_every_window(spark):
    words = ["calm"] * 1000
    net = toxicity.fit([(k % 2, "bad " * (k % 2) + "calm day " * 10) for k in range(60)])
    for at in (0, 500, 999):
        own = words.copy()
        own[at] = "bad"
        assert net.score_texts([" ".join(own)])[0] > 0.5 > net.score_texts([" ".join(words)])[0]
    assert [toxicity.starts(n)[-1] + min(n, toxicity.WINDOW) for n in (1, 64, 65, 500)] == [1, 64, 65, 500]


def test_toxicity_edges(odd, empty, labels):
    out = toxicity.score_toxicity(odd, labels, carry=True).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.score_toxicity(odd, labels.filter("false")).collect()} == {0}


# --- 5 Repeated strings -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("large", [2000, 3])
@pytest.mark.parametrize("block", [12_000_000, 20_000])
def test_removed_bytes_match_brute_force(spark, sf_dir, monkeypatch, large, block):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    monkeypatch.setattr(common, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 10 * block)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_removed({r.doc_id: r.text for r in table.collect()}, 100)
    got = {r.doc_id: (bytes(r.kept), len(r.spans)) for r in suffix_dedup.dedup_substrings(table).collect()}
    assert got == want


def test_one_gram_in_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGE", 5)
    r = np.random.default_rng(3)
    letters = lambda n: r.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    middle, sides = letters(40), [letters(70) for _ in range(6)]
    texts = {k + 1: letters(9) + sides[r.integers(6)][-int(r.integers(5, 70)) :] + middle + sides[r.integers(6)][: int(r.integers(5, 70))] + letters(9) for k in range(150)}
    got = {r.doc_id: (bytes(r.kept), len(r.spans)) for r in suffix_dedup.dedup_substrings(docs(spark, [texts[k] for k in sorted(texts)])).collect()}
    assert got == brute_removed(texts, 100) and sum(n for _, n in got.values()) > 50


def test_removed_bytes_of_periodic_texts(spark):
    texts = {1: "ab" * 300, 2: "x" + "ab" * 60, 3: "é" * 130, 4: "q" * 99, 5: "q" * 99, 6: "q" * 100, 7: "q" * 101}
    got = {r.doc_id: (bytes(r.kept), len(r.spans)) for r in suffix_dedup.dedup_substrings(docs(spark, [texts[k] for k in sorted(texts)])).collect()}
    assert got == brute_removed(texts, 100)


@pytest.mark.parametrize("size", [700, 50_000])
def test_long_texts_in_parts_match_brute_force(spark, sf_dir, monkeypatch, size):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", size)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_removed({r.doc_id: r.text for r in table.collect()}, 100)
    got = {r.doc_id: (bytes(r.kept), len(r.spans)) for r in suffix_dedup.dedup_substrings(table).collect()}
    assert got == want


def test_clean_text_over_the_part_s_size_stays_whole(spark):
    text = np.random.default_rng(7).integers(97, 123, (1 << 23) + 5000).astype(np.uint8).tobytes().decode()
    (row,) = suffix_dedup.dedup_substrings(docs(spark, [text])).collect()
    assert row.spans == [] and bytes(row.kept) == text.encode()


def test_deep_shallow_orders_like_sorted():
    r = np.random.default_rng(5)
    strings = [bytes(r.integers(97, 99, r.integers(0, 60)).astype(np.uint8)) + b"tail" * 5 for _ in range(400)]
    strings += strings[:50]
    group = r.integers(0, 4, len(strings))
    order, lcp = suffix_dedup.deep_shallow(group, strings, 80, 16)
    padded = [s.ljust(80, b"\0") for s in strings]
    got = [(group[i], padded[i]) for i in order]
    assert got == sorted(got)
    for k in range(1, len(order)):
        a, b = got[k - 1], got[k]
        want = -1 if a[0] != b[0] else next((i for i in range(80) if a[1][i] != b[1][i]), 80)
        assert lcp[k] == want


def test_repeats_edges(odd, empty):
    out = suffix_dedup.dedup_substrings(odd, carry=True).collect()
    assert len(out) == odd.count() and {r.n_bytes for r in out if r.doc_id in (1, 2)} == {0}
    assert suffix_dedup.dedup_substrings(empty).count() == 0


# --- 6 Mixing ---------------------------------------------------------------------------------------------------------------


def test_mix_meets_targets(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in table.collect()}
    source = {r.doc_id: r.source for r in table.collect()}
    sizes = {}
    for k, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[k]
    want = brute_targets(sizes)
    out = mixing.mix(table).collect()
    taken = {}
    for r in out:
        assert r["size"] == size[r.doc_id] and r.target == pytest.approx(want[source[r.doc_id]]) and 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(table).collect()))


def test_mix_clamps_and_edges(spark, odd, empty):
    rows = spark.createDataFrame([(1, "a " * 10, None, "s1", None), (2, "a " * 1000, None, "s2", None), (3, "b", None, None, None)], DOCS)
    out = {r.doc_id: (r.target, r.taken) for r in mixing.mix(rows).collect()}
    want = brute_targets({"s1": 10, "s2": 1000, None: 1})
    assert out[1] == (pytest.approx(want["s1"]), 30) and out[3] == (pytest.approx(want[None]), 3) and abs(out[2][1] - want["s2"]) <= 1
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0


# --- 7 Decontamination ------------------------------------------------------------------------------------------------------


def brute_tiles(item, doc, shortest):
    a, b, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = []
        for i, j in itertools.product(range(len(item)), range(len(doc))):
            n = 0
            while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                n += 1
            if n >= shortest:
                best.append((-n, i, j))
        if not best:
            return covered
        n, i, j = min(best)
        a[i : i - n] = b[j : j - n] = [True] * -n
        covered -= n


def test_tiles_match_brute_force():
    r = np.random.default_rng(7)
    for _ in range(40):
        item, doc = r.integers(1, 4, 25).tolist(), r.integers(1, 4, 60).tolist()
        at = int(r.integers(0, 40))
        doc[at : at + 12] = item[8:20]
        tiles = decontamination.tile(item, doc, 4)
        assert all(item[i : i + n] == doc[j : j + n] for i, j, n in tiles)
        for side in (0, 1):
            places = [t[side] + k for t in tiles for k in range(t[2])]
            assert len(places) == len(set(places))
        assert sum(t[2] for t in tiles) >= 0.8 * brute_tiles(item, doc, 4)


def test_matches_that_a_tile_cuts_short_are_tiled():
    item = list(range(1, 21))
    tiles = decontamination.tile(item, [*item[:7], -1, *item[5:13], -1, *item[13:]], 5)
    assert sorted(n for _, _, n in tiles) == [5, 7, 8]


def test_reordered_passages_are_found(spark, odd, empty):
    words = [f"k{k}" for k in range(60)]
    item = spark.createDataFrame([(7, " ".join(words)), (8, None), (9, ""), (7, " ".join(words))], "item_id long, text string")
    texts = ["clean text " * 30, "before " + " ".join(words[30:]) + " between " + " ".join(words[:30]).upper() + " after", " ".join(words[:40]), None]
    out = {r.doc_id: (r.contaminated, r.item_id) for r in decontamination.decontaminate(docs(spark, texts), item, carry=True).collect()}
    assert out == {1: (False, None), 2: (True, 7), 3: (False, None), 4: (False, None)}
    assert decontamination.decontaminate(odd, item).count() == odd.count() and decontamination.decontaminate(empty, item).count() == 0
    assert not decontamination.decontaminate(odd, item.filter("false")).filter("contaminated").head(1)


def test_benchmark_in_blocks(spark, sf_dir, monkeypatch):
    table, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = sorted(map(tuple, decontamination.decontaminate(table, items).collect()), key=str)
    monkeypatch.setattr(decontamination, "BENCHMARK_BYTES", 3000)
    assert sorted(map(tuple, decontamination.decontaminate(table, items).collect()), key=str) == want


# --- 8 Language model -------------------------------------------------------------------------------------------------------


def brute_base(texts):
    counts = {}
    split = {k: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"] for k, t in texts.items()}
    for k, w in split.items():
        if zlib.crc32(str(k).encode()) % 5 != 1:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return {k: (len(w), sum(x in counts for x in w), n, sum(math.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for k, w in split.items()}


@pytest.mark.parametrize("held", [language_model.HELD, 300])
def test_language_model_scores(spark, sf_dir, monkeypatch, held):
    monkeypatch.setattr(language_model, "HELD", held)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_base({r.doc_id: r.text for r in table.collect()})
    out = language_model.score_documents(table).collect()
    for r in out:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base) and r.score < 0
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_holds_the_end(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HELD", 3)
    table = docs(spark, [" ".join(f"w{(k * j) % 97}" for j in range(400)) for k in range(12)])
    want = brute_base({r.doc_id: r.text for r in table.collect()})
    for r in language_model.score_documents(table).collect():
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base)


def test_language_model_learns_from_every_training_document(spark, sf_dir, monkeypatch):
    models, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df, name="table": models.append(cut(df, name)) or models[-1] if name == "models" else cut(df, name))
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total = language_model.score_documents(table).head().train_tokens
    assert sum(r["weight"] for df in models for r in df.select("weight").collect()) > 0.99 * total
    copies = docs(spark, ["the same words again and again"] * 200).select("doc_id", "text")
    models.clear()
    monkeypatch.setattr(common, "blocks", lambda df, block_bytes=0: 4)
    language_model.train(copies, {"\n": 1, "the": 2}, np.ones(3))
    learned = [df.select("block", "weight").collect() for df in models]
    assert [len(x) for x in learned] == [4, 1] * language_model.ROUNDS and max(r["weight"] for r in learned[0]) < 0.5 * sum(r["weight"] for r in learned[0])


def test_language_model_is_a_distribution_and_carries_state():
    model = language_model.Model.fresh(np.arange(1, 4000, dtype=float)[::-1].copy())
    h = np.random.default_rng(1).normal(size=(1, language_model.HIDDEN)).astype(np.float32)
    every = np.arange(language_model.CLASSES * language_model.CLASS)
    assert np.exp(model.log_probabilities(np.repeat(h, len(every), 0), every)).sum() == pytest.approx(1, abs=1e-3)
    r = np.random.default_rng(2)
    texts = [r.integers(2, 3000, n) for n in (1, 5, 200, 1000, 64)]
    together = language_model.log_likelihoods(model, texts)
    assert together == pytest.approx([language_model.log_likelihoods(model, [t])[0] for t in texts], rel=1e-4)
    step, state = 0.0, np.zeros((1, language_model.HIDDEN), np.float32)
    for token in texts[2]:
        step += float(model.log_probabilities(state, np.array([token]))[0])
        state = model.run(np.array([[token]]), np.ones((1, 1), np.float32), state)[1]
    assert together[2] == pytest.approx(step, rel=1e-4)


def test_language_model_learns_side_by_side_as_alone():
    start = language_model.Model.fresh(np.arange(1, 4000, dtype=float)[::-1].copy()).p
    r = np.random.default_rng(3)
    texts = [[r.integers(0, 3000, n) % r.integers(1, 3000) for n in sizes] for sizes in ([700, *[60] * 90], [5, 1], [], [40] * 70)]
    stack = {k: np.repeat(v[None], len(texts), 0) for k, v in start.items()}
    language_model.learn_texts(stack, texts, 0.1)
    for i, own in enumerate(texts):
        alone = {k: v[None].copy() for k, v in start.items()}
        language_model.learn_texts(alone, [own], 0.1)
        for k, v in stack.items():
            assert np.allclose(v[i], alone[k][0], atol=2e-2) and np.abs(v[i] - alone[k][0]).mean() < 1e-4 and np.array_equal(v[i], start[k]) == (not own)


def test_recurrent_gates_side_by_side_as_one_by_one():
    r, size, many, steps, lanes = np.random.default_rng(4), 8, 3, 6, 5
    rows, u, h, d = (r.normal(0, 1, s).astype(np.float32) for s in ((40, 3 * size), (many, size, 3 * size), (many, lanes, size), (steps, many, lanes, size)))
    ids, mask = r.integers(0, 40, (steps, many, lanes)), (r.random((steps, many, lanes)) > 0.3).astype(np.float32)
    ends = [np.nonzero(m == 0) for m in mask]
    gates = np.ascontiguousarray(u.reshape(many, size, 3, size).transpose(2, 0, 1, 3))
    states, saved = recurrent.gates_forward(rows.reshape(-1, size), ids[:, None] * 3 + np.arange(3)[:, None, None], gates, h, ends, True)
    x, du = recurrent.gates_backward(d, states, saved, gates, ends)
    for k in range(many):
        want, kept = recurrent.forward(rows[ids[:, k]], u[k], h[k], mask[:, k], True)
        dx, own = recurrent.backward(d[:, k], want, kept, u[k], h[k], mask[:, k])
        assert np.allclose(states[1:, k], want, atol=1e-5)
        assert np.allclose(x[:, :, k].transpose(0, 2, 1, 3).reshape(dx.shape), dx, atol=1e-4) and np.allclose(du[:, k].transpose(1, 0, 2).reshape(own.shape), own, atol=1e-3)


def test_language_model_joins_batches_up_to_a_size(monkeypatch):
    monkeypatch.setattr(language_model, "SCORE_BYTES", 10)
    batches = [pa.RecordBatch.from_pydict({"text": t}) for t in (["a" * 4, "b" * 3], ["c" * 2, "d" * 30, "e"], [""] * 3)]
    out = [b.column("text").to_pylist() for b in language_model._joined(iter(batches))]
    assert sum(out, []) == sum((b.column("text").to_pylist() for b in batches), []) and [len(x) for x in out] == [3, 1, 4]
    assert list(language_model._joined(iter([]))) == []


def test_language_model_edges(odd, empty):
    out = language_model.score_documents(odd).collect()
    assert len(out) == odd.count() and {r.n_tokens for r in out if r.doc_id in (1, 2)} == {1} and all(math.isfinite(r.score) for r in out)
    assert language_model.score_documents(empty).count() == 0


# --- 9 Top-k ----------------------------------------------------------------------------------------------------------------


def brute_top(vectors, k, every):
    ints = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in vectors.items() if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q in sorted(ints):
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)
            out[q] = [(c, -s) for s, c in found[:k]]
    return out


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "CANDIDATES", 64)
    monkeypatch.setattr(pivot_search, "QUERIES", 16)
    r = np.random.default_rng(9)
    vectors = {k: r.normal(size=8).astype(np.float32).tolist() for k in range(300)}
    vectors |= {300: None, 301: [None] + [1.0] * 7, 302: [float("nan")] * 8, 303: [float("inf")] * 8, 304: vectors[0], 305: vectors[0]}
    table = spark.createDataFrame(list(vectors.items()), T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    got = {}
    for row in pivot_search.top_k(table.withColumn("score", F.lit(1)), k=7).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    assert got == brute_top(vectors, 7, 20)
    assert pivot_search.top_k(table.filter("false")).count() == 0


# --- 10 WARC ----------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 30_000
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, "small"), (4, "http://a/4", "small"), (5, "http://a/\r\n5", None), (None, "u", big), (6, "u", "x\r\n\r\nWARC/1.1\r\n" * 100)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = f"file://{tmp_path}/warc"
    warc.write_warc(table, path, segment_bytes=1000, chunk_bytes=77)
    out = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert all(r.verified for r in out.values()) and len(out) == len(pages)
    for page, _, html in pages:
        r, raw = out[None if page is None else str(page)], (html or "").encode()
        assert r.payload_digest == hashlib.sha1(raw).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw
    assert {k: (r.record_type, r.refers_to) for k, r in out.items() if r.refers_to} == {"1": ("revisit", "2"), None: ("revisit", "2")}
    warc.write_warc(table.filter("false"), path + "0")
    assert warc.read_warc(spark, path + "0").count() == 0


def test_warc_tells_missing_segments(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "a" * 5000)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    warc.write_warc(table, path, segment_bytes=1000)
    records = warc.read_records(spark, path)
    assert warc.reassemble(records).head().complete
    assert not warc.reassemble(records.filter("NOT (segment <=> 3)")).head().complete
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
