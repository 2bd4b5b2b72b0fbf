"""Alignment, SimHash and vector codes against brute-force versions, and on their edge cases."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from polis.llm import alignment, queries, simhash, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, "some words that stand here for a test of nulls", "en", "a", 3), (3, LONG, "fr", "b", 1), (4, "one two three four five six", "en", "a", 1), (4, "one two three four five six", "en", "a", 1), (5, "ONE two three four five six", "fr", "b", 2), (6, "…", "fr", None, 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "doc_id AS row", "text AS pair", "1 AS print", "lang AS component", "0.5 AS n_a", "'x' AS links", "'y' AS cell")


# --- 11 Alignment -----------------------------------------------------------------------------------------------------------


def brute_alignment(rows):
    """Whole texts through both libraries, groups from running byte offsets."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = alignment.byte_level_names()
    encoded = []
    for k, t in rows:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        xb = [bytes(names[c] for c in a.id_to_token(i)) for i in x]
        yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        whole = (" " + t).encode() if t else b""
        if not t or b"".join(xb) != whole or b"".join(yb) != whole:
            encoded.append((k, [], [], [], []))
            continue
        xe, ye = list(itertools.accumulate(map(len, xb))), list(itertools.accumulate(map(len, yb)))
        shared = sorted(set(xe) & set(ye))
        links = [(x[xe.index(e)], y[ye.index(e)]) for e in shared]
        groups = [([i for i, end in zip(x, xe) if lo < end <= hi], [i for i, end in zip(y, ye) if lo < end <= hi]) for lo, hi in zip([0, *shared], shared)]
        encoded.append((k, x, y, groups, links))
    counts = Counter(p for e in encoded for p in e[4])
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    for k, x, y, groups, links in encoded:
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield k, len(x), len(y), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if x else ""


HARD = ["<|endoftext|> a", "<s> x </s> <unk> <0x41>", "don't  stop here now ", " leading", "\n\tlines\r\nof \n text", "a\x85b\x1cc d", "ﬁ ﬀ ß İ ǅ", "中文 日本語 a1b2 12345", "é ́x e ́", "x" * 3000, "a b   c", "▁ x", "a ▁b", "🙂🙃 \U0001f9d1‍\U0001f680", " ", "   ", "a ́b", "\x00 b", "x\x1c y", "{}[]();:=+ --- ==", "I'll we're I'm ' s 's", "\nabc\ndef", "x\nabc", "a\n\nb", "a\n b", "a \nb", "\n", "a\n", "\n\na", "a\r\nb", "a\n\u00a0b", "\nabc", "end. Of, it.", "a.  b", "x.\ny,", ".a ., , .", "a.b c,d", "².  ².", "é. ñ, ß.", "a. \ue000b \ue000", "\ue000", "it's. don't,", "a,\n\nb. ", "x.\ttab"]


def test_alignment_matches_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows = [(r.doc_id, r.text) for r in table] + [(10_000 + k, t) for k, t in enumerate([*HARD, None, "", *HARD[:3]])]
    own = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(brute_alignment(rows))
    assert sorted(map(tuple, alignment.align(own).collect())) == want
    assert sorted(map(tuple, alignment.align(own, held=50).collect())) == want  # most pairs joined


def test_transducer_closes_groups_and_refuses_other_bytes():
    t = alignment.Transducer([b"ab", b"c", b"abc", b"x"], [b"a", b"bc", b"abc", b"b"])
    shown = list("0123"), list("0123")
    run = lambda a, b: t.align(a, b, shown, 10)
    assert run([0, 1], [0, 1]) == (b"0,1|0,1", [11]) and run([2, 2], [2, 0, 1]) == (b"2|2;2|0,1", [22, 21])
    assert run([0], [0, 3]) == (b"0|0,3", [3]) and run([3], [0]) is None and run([0], [0]) is None and run([0], [0, 3, 0]) is None
    assert run([], []) == (b"", [])


def test_alignment_edges(spark, odd):
    out = {r.doc_id: r for r in alignment.align(odd).collect()}
    assert alignment.align(odd).count() == odd.count()
    assert out[1].n_a == out[2].n_a == 0 and out[1].groups_sha256 == out[2].groups_sha256 == ""
    assert out[3].n_a > 30_000 and out[None].n_links > 0
    assert alignment.align(spark.createDataFrame([], DOCS)).count() == 0


# --- 12 SimHash -------------------------------------------------------------------------------------------------------------


def brute_print(text, words=4):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))] if own else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits):
    group = {k: k for k in prints}
    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            low, high = sorted((group[a], group[b]))
            group = {k: low if g == high else g for k, g in group.items()}
    return group


def test_simhash_matches_brute_force(spark, sf_dir):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    base = LONG.split()[:400]
    for k in range(60):  # near copies, each a word away from another
        base[6 * k] = f"n{k}"
        table.append((5000 + k, " ".join(base)))
    table += [(6000, None), (6001, ""), (6002, " \n"), (6003, "a"), (6004, "one two"), (6005, "A B c D e"), (6006, "É éa b c d")]
    prints = {k: brute_print(t) for k, t in table}
    group = brute_components(prints, 4)
    out = simhash.simhash_duplicates(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.fingerprint for r in out} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {r.doc_id: r.component_id for r in out} == group


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4, 5, 7])
def test_linked_prints_share_a_cell(bits):
    rng = np.random.default_rng(bits)
    a = rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 200, dtype=np.uint64)
    flips = [sum(1 << int(k) for k in rng.choice(64, bits, replace=False)) for _ in a]
    b = a ^ np.array(flips, np.uint64)
    own = [defaultdict(set), defaultdict(set)]
    for side, prints in zip(own, (a, b)):
        for k, c in zip(*simhash.cells(prints, bits)):
            side[int(k)].add(int(c))
    assert all(own[0][k] & own[1][k] for k in range(len(a)))


def cell_links(rows, bits, size):
    """All edges of compare_cells over rows of (cell, print) that come in batches of `size`."""
    rows = sorted(rows)
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + size]], pa.int64()) for k in (0, 1)], names=["cell", "print"]) for i in range(0, len(rows), size)]
    out = pa.Table.from_batches(list(simhash.compare_cells(iter(batches), bits)) or [pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["a", "b", "cell"])])
    return out.filter(pa.compute.is_null(out["cell"])).to_pylist(), out.filter(pa.compute.is_valid(out["cell"])).to_pylist()


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_cells_span_their_links_and_large_ones_pass_through(monkeypatch, size):
    monkeypatch.setattr(simhash, "CELL", 40)
    rng = np.random.default_rng(size)
    sizes = [1, 2, 3, 8, 9, 40, 41, 100, 5]
    rows = [(c, int(p)) for c, n in enumerate(sizes) for p in rng.choice(1 << 9, n, replace=False)]
    edges, large = cell_links(rows, 1, size)
    assert Counter(r["cell"] for r in large) == {6: 41, 7: 100}
    got, want = {}, {}
    kept = [(c, p) for c, p in rows if sizes[c] <= 40]
    ids = sorted({p for _, p in kept})
    got = want = {p: p for p in ids}

    def union(group, a, b):
        low, high = sorted((group[a], group[b]))
        return {k: low if g == high else g for k, g in group.items()}

    for e in edges:
        assert (e["a"] ^ e["b"]).bit_count() <= 1
        got = union(got, e["a"], e["b"])
    for (c, p), (d, q) in itertools.combinations(kept, 2):
        if c == d and (p ^ q).bit_count() <= 1:
            want = union(want, p, q)
    assert got == want


def test_large_cells_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(12)
    middle = int(rng.integers(0, 1 << 62))
    prints = sorted({middle ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(0, 9)), replace=False)) for _ in range(220)})
    large = spark.createDataFrame([(1, p) for p in prints], "cell long, print long")
    edges = [(r.a, r.b) for r in simhash._split_cells(large, 4).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    group = {p: p for p in prints}
    for a, b in edges:
        low, high = sorted((group[a], group[b]))
        group = {k: low if g == high else g for k, g in group.items()}
    want = brute_components(dict(zip(prints, prints)), 4)
    assert group == want


def test_simhash_edges(spark, odd):
    out = simhash.simhash_duplicates(odd).collect()
    assert len(out) == odd.count()
    by = {r.doc_id: r for r in out}
    assert by[1].fingerprint == by[2].fingerprint == "0" * 16 and by[1].component_id == by[2].component_id == 1
    assert by[4].component_id == by[5].component_id == 4 and by[None].component_id is None
    assert simhash.simhash_duplicates(spark.createDataFrame([], DOCS)).count() == 0


# --- 13 Vector codes --------------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(k, [math.floor(scale * x) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = max((len(v) for _, v, _ in kept), default=1)
    size = -(-w // parts)
    kept = [(k, v + [0] * (parts * size - len(v)), label) for k, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        codes = [[min(range(len(b)), key=lambda j: (far(cut(v, p), b[j]), j)) for p, b in enumerate(books)] for _, v, _ in kept]
        if r < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    own = [cut(v, p) for (_, v, _), c in zip(kept, codes) if c[p] == j]
                    if own:
                        books[p][j] = [sum(x) // len(own) for x in zip(*own)]
    errors = [sum(far(cut(v, p), books[p][c[p]]) for p in range(parts)) for (_, v, _), c in zip(kept, codes)]
    total = Counter()
    for (_, _, label), e in zip(kept, errors):
        total[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((k, "".join(f"{c:02x}" for c in code), e, total[label], digest) for (k, _, label), code, e in zip(kept, codes, errors)), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, code string, v string, row int, total int"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, label, "x", "y", 1, 2) for k, v, label in rows], VECTORS)


def test_vector_codes_match_brute_force(spark):
    rng = np.random.default_rng(13)
    data = [(k, [float(np.float32(x)) for x in rng.normal(0, 0.3, 16)], (None, 1, 2)[k % 3]) for k in range(150)]
    data += [(200 + k, list(data[3][1]), 5) for k in range(40)]  # ties
    data += [(300 + k, [float(x) for x in rng.integers(-1, 2, 16)], 1) for k in range(40)]  # equal distances
    data += [(400, None, 1), (401, [1.0] * 15 + [None], 1), (402, [float("nan")] + [0.0] * 15, 2), (403, [float("inf")] + [0.0] * 15, 2), (5, data[5][1], 1), (None, data[0][1], None)]
    out = sorted(map(tuple, vector_codes.compress(vectors(spark, data).repartition(5)).collect()), key=repr)
    assert out == brute_codes(data)


def test_vector_codes_edges(spark):
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).count() == 0
    few = [(1, [0.5, 0.25], 1), (2, [0.1], None), (2, [0.1], None), (3, [], 2)]  # short, ragged, fewer than entries
    assert sorted(map(tuple, vector_codes.compress(vectors(spark, few)).collect()), key=repr) == brute_codes(few)
    huge = vector_codes.compress(vectors(spark, [(1, [3e38, -3e38] * 4, 1), (2, [1.0] * 8, 1), (3, [-3e38] * 8, 1)]), entries=2).collect()
    assert len(huge) == 3 and all(r.error >= 0 for r in huge)


@pytest.mark.parametrize("spread", [3, 4096, 1 << 24])
def test_nearest_is_exact_where_float32_is_not(spread):
    rng = np.random.default_rng(spread)
    book = rng.integers(-spread, spread + 1, (16, 8))
    x = np.r_[rng.integers(-spread, spread + 1, (500, 8)), (book[rng.integers(0, 16, 500)] + book[rng.integers(0, 16, 500)]) // 2, book]
    far = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert (vector_codes.nearest(x, book) == far.argmin(1)).all()


def test_vector_codes_query_matches_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    sql = con.execute(queries.SQL["op13_vector_codes"])
    names = [d[0] for d in sql.description]
    want = sorted(dict(zip(names, r)).items() for r in sql.fetchall())
    own = queries.op13_vector_codes(spark, sf_dir).collect()
    assert sorted(sorted(r.asDict().items()) for r in own) == sorted(sorted(w) for w in want)
