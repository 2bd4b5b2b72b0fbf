"""The stages of the pipeline against brute-force versions, each on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from polis.llm import common, toxicity
from tests_llm_brute import brute_components, brute_removed, brute_targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in P.STAGES:
        before, docs = docs, common.cut(stage(spark, docs, SF), name)
        out[name] = (before, docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(steps, spark):
    assert list(steps) == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "mixing"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == columns for name, (_, after) in steps.items() if name != "mixing")


def test_toxicity(steps, spark):
    before, after = steps["toxicity"]
    scored = toxicity.score_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(rows(after)) == {r.doc_id for r in scored.filter("predicted = 0").collect()}


def test_near_dedup(steps):
    before, after = steps["near_dedup"]
    want = brute_components({k: r.text for k, r in rows(before).items()}, 80, 100)
    assert set(rows(after)) == {k for k, (_, c) in want.items() if c == k}


def test_suffix_dedup(steps):
    before, after = steps["suffix_dedup"]
    want = brute_removed({k: r.text for k, r in rows(before).items()}, 100)
    got = rows(after)
    assert {k: r.text for k, r in got.items()} == {k: w[0].decode(errors="ignore") for k, w in want.items()}


def test_decontamination_keeps_clean_documents(steps, spark):
    before, after = steps["decontamination"]
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {k for k, r in rows(before).items() if any(" ".join(i) in " ".join(r.text.lower().split()) for i in items)}
    gone = set(rows(before)) - set(rows(after))
    assert whole <= gone
    seeds = {tuple(i[k : k + 5]) for i in items for k in range(len(i) - 4)}
    for k in gone:
        w = rows(before)[k].text.lower().split()
        assert any(tuple(w[j : j + 5]) in seeds for j in range(len(w)))


def test_mixing(steps):
    before, after = steps["mixing"]
    sizes = {}
    for r in before.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    want, source, taken = brute_targets(sizes), {k: r.source for k, r in rows(before).items()}, {}
    for r in after.collect():
        assert r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{k * k % 9973}" for k in range(20_000))
    odd = spark.createDataFrame([(9, long, "en", "s", 1), (1, None, None, None, None), (None, "a b c", "en", "s", 1), (2, "", "en", "s", 0), (3, "x y z " * 60, "en", "s", 1), (3, "x y z " * 60, "en", "s", 1), (4, "X y z " * 60, "fr", None, 1)], schema)
    for docs in (odd, odd.filter("false"), odd.withColumn("row", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("block", F.lit(2)).withColumn("my col-x", F.lit(1)).withColumn("a.b", F.lit("y")).withColumn("size", F.lit(3))):
        columns = docs.columns
        for name, stage in P.STAGES:
            docs = common.cut(stage(spark, docs, SF), name)
            assert name == "mixing" or docs.columns == columns


def test_suffix_dedup_keeps_replacement_characters_of_the_input(spark):
    shared = "some passage that two texts have in common, of more than one hundred bytes so that it goes from the later one"
    texts = [f"x\ufffdy {shared} end", f"x\ufffdy \u00e9{shared}\u00e9 \ufffd\ufffd", f"\ufffd{shared}\ufffd"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_removed(dict(enumerate(texts)), 100)
    assert {r.doc_id: (r.text, r.n_chars) for r in P.suffix_dedup(spark, docs, SF).collect()} == {k: (t := "".join(w[0].decode(errors="ignore")), len(t)) for k, w in want.items()}
