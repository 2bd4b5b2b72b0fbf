"""The toxicity network against plain loops, and operators' queries on odd tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polis.llm import queries, toxicity


def plain_logit(p, inputs):
    """The logit of one window from its words' inputs to the gates, one step and one unit at a time."""
    h, n = toxicity.HIDDEN, len(inputs)
    sig = lambda v: 1 / (1 + math.exp(-v))

    def walk(xs, u):
        state, out = [0.0] * h, []
        for x in xs:
            g = [sum(state[i] * float(u[i][k]) for i in range(h)) for k in range(3 * h)]
            r = [sig(x[k] + g[k]) for k in range(h)]
            z = [sig(x[h + k] + g[h + k]) for k in range(h)]
            new = [math.tanh(x[2 * h + k] + r[k] * g[2 * h + k]) for k in range(h)]
            state = [new[k] + z[k] * (state[k] - new[k]) for k in range(h)]
            out.append(state)
        return out

    right = walk([x[: 3 * h] for x in inputs], p["u0"])
    left = walk([x[3 * h :] for x in inputs][::-1], p["u1"])[::-1]
    both = [a + b for a, b in zip(right, left)]
    energy = [sum(math.tanh(sum(s[i] * float(p["attend"][i][k]) for i in range(2 * h))) * float(p["query"][k]) for k in range(toxicity.ATTENTION)) for s in both]
    top = max(energy)
    weight = [math.exp(e - top) for e in energy]
    pool = [sum(w * s[i] for w, s in zip(weight, both)) / sum(weight) for i in range(2 * h)]
    return sum(a * float(b) for a, b in zip(pool, p["out"])) + float(p["shift"][0])


def plain_inputs(net, words):
    out = []
    for w in words:
        grams, _ = toxicity.pieces([w])
        character = sum(net.p["character"][g].astype(float) for g in grams) / math.sqrt(len(grams))
        v = np.r_[net.p["word"][net.vocabulary.get(w, 0)].astype(float), character]
        out.append((v @ net.p["input"].astype(float) + net.p["bias"]).tolist())
    return out


def plain_score(net, text):
    words = toxicity.letter_words(text or "")
    at = toxicity.starts(len(words))
    return max((1 / (1 + math.exp(-plain_logit(net.p, plain_inputs(net, words[s : s + toxicity.WINDOW])))) for s in at), default=net.prior)


def test_scores_are_those_of_plain_loops():
    r = np.random.default_rng(4)
    net = toxicity.fit([(k % 2, " ".join(r.choice(["calm", "day", "walk", "tree"] + ["nasty", "awful"] * (k % 2), 12))) for k in range(80)])
    texts = ["calm day", "", None, "42 !", "awful", " ".join(r.choice(["calm", "tree", "unseen", "nasty"], 150)), "Calm DAY nasty été " * 20]
    assert net.score_texts(texts) == pytest.approx([plain_score(net, t) for t in texts], abs=1e-4)


def test_toxicity_query_scores_every_document_so(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.Network(*toxicity._unpacked(toxicity.train(docs, labels, 4, 2)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in queries.op4_toxicity(spark, sf_dir).collect()}
    assert set(out) == set(texts)
    short = sorted(texts, key=lambda k: (len(texts[k] or ""), k))
    for k in [*short[:25], *short[len(short) // 2 : len(short) // 2 + 5]]:
        assert out[k].score == pytest.approx(plain_score(net, texts[k]), abs=1e-4)
        assert out[k].predicted == int(out[k].score >= 0.3)


def test_long_labelled_texts_alone_are_learned_from():
    r = np.random.default_rng(6)

    def text(bad):
        words = r.choice(["calm", "day", "walk", "tree", "river"], 700)
        if bad:
            words[r.integers(0, 700, 12)] = "vile"
        return " ".join(words)

    net = toxicity.fit([(k % 2, text(k % 2)) for k in range(60)])
    scores = net.score_texts([text(k % 2) for k in range(20)])
    assert min(scores[1::2]) > max(scores[::2])


def test_warc_query_on_odd_pages(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "http://a", big, 1), (2, None, big, 2), (2, None, big, 3), (None, "http://n", big, 4), (4, "u", None, None), (5, "u", "", 1), (6, "u", "small", 1), (7, "u", "small", 1), (8, "u", "é" * 400_000, 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, payload long").withColumn("record_type", F.lit("?")).withColumn("refers_to", F.lit(0))
    table.write.parquet(f"file://{tmp_path}/pages.parquet")
    out = queries.op10_warc(spark, f"file://{tmp_path}").collect()
    assert len(out) == len(rows)
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        assert any((r.page_id, r.payload_bytes, r.payload_digest) == (page, len(raw), hashlib.sha1(raw).hexdigest()) for r in out)
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in out if r.payload_bytes == 1500), key=repr) == sorted([(1, "revisit", 2), (2, "response", None), (2, "response", None), (None, "revisit", 2)], key=repr)
    assert all(r.record_type == "response" for r in out if r.payload_bytes != 1500) and all(r.verified for r in out)
    spark.createDataFrame([], table.schema).write.parquet(f"file://{tmp_path}/none/pages.parquet")
    assert queries.op10_warc(spark, f"file://{tmp_path}/none").count() == 0
