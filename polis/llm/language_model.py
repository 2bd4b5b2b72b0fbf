"""Operator 8: document log-likelihood by a gated recurrent language model with a class-factored softmax."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .recurrent import Adagrad, gates_backward, gates_forward, sums_by_row
from .word_counts import word_counts

#: Words of the softmax, in classes of this many; hidden units.
CLASSES, CLASS, HIDDEN = 64, 64, 32
#: Words whose counts every task holds; the counts of the others are joined.
HELD = 150_000
#: Steps of a window, in training and in scoring; lanes in training, and at most in scoring.
TRAIN_STEPS, SCORE_STEPS, TRAIN_LANES, SCORE_LANES = 32, 64, 64, 384
#: Rounds of training; each learns from other training documents, all rounds together from every one.
ROUNDS = 3
#: Tokens whose softmax is computed at once, so that it stays in cache.
CHUNK = 2048
#: Bytes of text in a run of training; scored at once, so many that one long text leaves many lanes; models averaged at once.
RUN_BYTES, SCORE_BYTES, FAN_IN = 3 << 20, 24 << 20, 64
#: Blocks of texts whose models learn side by side in a task.
SIDE = 4
#: Classes of a training window are computed together up to these numbers of tokens, larger ones alone.
TOGETHER = (4, 8, 16, 32, 64)
#: Stands for the end of a text; no word holds white space.
END = "\n"

_LN10 = math.log(10)


def tokens(text: str) -> list[bytes]:
    """Words, A-Z in lower case, without the end."""
    return text.encode().lower().split()


def with_end(text: str) -> list[bytes]:
    return [*tokens(text), END.encode()]


def numbers(of: dict[bytes, int], words: list[bytes], other: int, end: int) -> np.ndarray:
    """The number of each word, `other` for those without one, and then the end's."""
    out = np.fromiter(map(of.get, words, repeat(other)), np.int64, len(words))
    return np.append(out, end)


def _exponentials(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """(exp of e less a shift of each row, its row sums, the shifts); e is spent. Rows are shifted only where they need it."""
    shift = 0.0
    if e.size and (e.max() > 60 or e[:, 0].min() < -60):
        shift = e.max(1, keepdims=True)
        e -= shift
        shift = shift[:, 0]
    np.exp(e, out=e)
    return e, e @ np.ones(e.shape[1], np.float32), shift


def _log_share(logit: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the softmax of logit + bias at the target of each row; logit is spent."""
    logit += bias
    own = logit.take(np.arange(len(target)) * logit.shape[1] + target)
    _, total, shift = _exponentials(logit)
    return own - shift - np.log(total)


def _errors(logit: np.ndarray, bias: np.ndarray, target: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """(softmax of logit + bias, less 1 at the target of each row) * scale; logit is spent."""
    logit += bias
    e, total, _ = _exponentials(logit)
    e *= (scale / total)[:, None]
    e.reshape(-1)[np.arange(len(target)) * e.shape[1] + target] -= scale
    return e


def _column_sums(e: np.ndarray) -> np.ndarray:
    return np.ones(e.shape[-2], np.float32) @ e


def _inputs(ids: np.ndarray) -> np.ndarray:
    """Rows (T, 3, K, B), for gates_forward, of the tokens' shares, each of three rows."""
    return ids[:, None].astype(np.int64) * 3 + np.arange(3)[:, None, None]


def _by_gate(u: np.ndarray) -> np.ndarray:
    """(3, K, H, H) of (K, H, 3H)."""
    return np.ascontiguousarray(u.reshape(-1, HIDDEN, 3, HIDDEN).transpose(2, 0, 1, 3))


def _ends(mask: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each step of mask (T, K, B), the models and lanes where a text ends."""
    t, k, b = np.nonzero(mask == 0)
    edges = np.searchsorted(t, np.arange(len(mask) + 1))
    return [(k[i:j], b[i:j]) for i, j in zip(edges[:-1], edges[1:])]


class Model:
    """State h predicts a token's class, then the token within its class; then the token changes the state. Symbol 0 is any
    word outside the softmax."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.zero = np.zeros(HIDDEN, np.float32)

    @classmethod
    def fresh(cls, frequency: np.ndarray, seed: int = 8) -> Model:
        """A model whose biases are the symbols' frequencies and whose other outputs start near nothing."""
        r, n = np.random.default_rng(seed), CLASSES * CLASS
        f = np.full(n, 1e-30)
        f[: len(frequency)] = frequency
        f = (f / f.sum()).reshape(CLASSES, CLASS)
        share = f.sum(1)
        p = {
            "token": r.normal(0, 0.3, (n, 3 * HIDDEN)), "u": r.normal(0, 0.8 / HIDDEN**0.5, (HIDDEN, 3 * HIDDEN)), "class": r.normal(0, 0.01, (HIDDEN, CLASSES)), "class_bias": np.log(share),
            "word": r.normal(0, 0.01, (CLASSES, HIDDEN, CLASS)), "word_bias": np.log(f) - np.log(share)[:, None],
        }
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def run(self, ids: np.ndarray, mask: np.ndarray, h: np.ndarray):
        """(states before each token, state after the last)."""
        rows, u = self.p["token"].reshape(-1, HIDDEN), _by_gate(self.p["u"][None])
        states = gates_forward(rows, _inputs(ids[:, None]), u, h[None], _ends(mask[:, None]))[0][:, 0]
        return states[:-1], states[-1]

    def log_probabilities(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log probability of each token (n,) from the state before it (n, H)."""
        p, which = self.p, ids // CLASS
        order = np.argsort(which.astype(np.uint8), kind="stable")
        which, ids, h = which[order], ids[order], h.take(order, 0)
        got = np.empty(len(ids), np.float32)
        for at in range(0, len(ids), CHUNK):
            part = slice(at, at + CHUNK)
            got[part] = _log_share(h[part] @ p["class"], p["class_bias"], which[part])
        edges = np.searchsorted(which, np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(edges)):
            for at in range(edges[c], edges[c + 1], CHUNK):
                part = slice(at, min(at + CHUNK, edges[c + 1]))
                got[part] += _log_share(h[part] @ p["word"][c], p["word_bias"][c], ids[part] % CLASS)
        out = np.empty(len(ids))
        out[order] = got
        return out


class Learners:
    """Models that learn side by side, each from its own texts: numpy is given the arrays of all at once, none sees another's."""

    def __init__(self, p: dict[str, np.ndarray]):
        """p: the arrays of a model, each with the models in front; learning changes them in place."""
        self.p = p
        # Tokens and classes of the second model are numbered on from the first's.
        self.rows = {k: p[k].reshape(-1, *p[k].shape[2:]) for k in ("token", "word", "word_bias")}

    def learn(self, optimizer: Adagrad, ids: np.ndarray, mask: np.ndarray, real: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One window (T, K, B) of truncated backpropagation of the first K models from the states h (K, B, H); the states after it."""
        many, ends = ids.shape[1], _ends(mask)
        p, models = {k: v[:many] for k, v in self.p.items()}, np.arange(many)
        u, numbered = _by_gate(p["u"]), ids + models[:, None] * (CLASSES * CLASS)
        inputs = _inputs(numbered)
        states, saved = gates_forward(self.rows["token"].reshape(-1, HIDDEN), inputs, u, h, ends, True)
        # Tokens in the order of their models and classes.
        use = np.flatnonzero(real)
        own = numbered.ravel()[use]
        order = np.argsort((own // CLASS).astype(np.uint16), kind="stable")
        use, own = use[order], own[order]
        which, own = own // CLASS, own % CLASS
        edges = np.searchsorted(which, np.arange(many * CLASSES + 1))
        sizes = np.diff(edges[::CLASSES])
        scale = np.repeat((1 / np.maximum(1, sizes)).astype(np.float32), sizes)
        before = states.reshape(-1, HIDDEN).take(use, 0)
        # The last row of the states' gradients is that of a state that predicts nothing.
        dx = np.zeros((len(use) + 1, HIDDEN), np.float32)
        dclass, dbias = np.zeros_like(p["class"]), np.zeros_like(p["class_bias"])
        for k in np.flatnonzero(sizes):
            at = slice(edges[k * CLASSES], edges[(k + 1) * CLASSES])
            e = _errors(before[at] @ p["class"][k], p["class_bias"][k], which[at] - k * CLASSES, scale[at])
            np.matmul(e, p["class"][k].T, out=dx[at])
            dclass[k], dbias[k] = before[at].T @ e, _column_sums(e)
        self._learn_words(optimizer, before, own, scale, dx, edges)
        place = np.full(ids.shape, len(use))
        place.ravel()[use] = np.arange(len(use))
        place[:-1], place[-1] = place[1:].copy(), len(use)
        d, du = gates_backward(dx.take(place, 0), states, saved, u, ends)
        for name, g in (("class", dclass), ("class_bias", dbias), ("u", du.transpose(1, 2, 0, 3).reshape(p["u"].shape))):
            optimizer.step(name, self.p[name], g, models)
        parts = np.arange(inputs.size).reshape(inputs.shape).swapaxes(0, 1).reshape(3, -1).T
        rows, g = sums_by_row(numbered.ravel(), d.reshape(-1, HIDDEN), np.ascontiguousarray(parts))
        optimizer.step("token", self.rows["token"], g, rows)
        return states[-1]

    def _learn_words(self, optimizer: Adagrad, x: np.ndarray, own: np.ndarray, scale: np.ndarray, dx: np.ndarray, edges: np.ndarray) -> None:
        """A step of the softmaxes within classes; the states' gradients are added to dx."""
        word, bias = self.rows["word"], self.rows["word_bias"]
        count = np.diff(edges)
        for c in np.flatnonzero(count > TOGETHER[-1]):
            at = slice(edges[c], edges[c + 1])
            e = _errors(x[at] @ word[c], bias[c], own[at], scale[at])
            dx[at] += e @ word[c].T
            optimizer.step("word", word, (x[at].T @ e)[None], np.array([c]))
            optimizer.step("word_bias", bias, _column_sums(e)[None], np.array([c]))
        # Classes of few tokens at once, each filled up to the same number of rows.
        for low, high in zip((0, *TOGETHER), TOGETHER):
            c = np.flatnonzero((count > low) & (count <= high))
            if not len(c):
                continue
            place = np.arange(count[c].max())
            there = place < count[c][:, None]
            at = np.where(there, edges[c][:, None] + place, edges[c][:, None]).ravel()
            full, there = (len(c), len(place), -1), there.ravel()
            z, w = x.take(at, 0).reshape(full), word.take(c, 0)
            logit = z @ w
            logit += bias.take(c, 0)[:, None]
            e = _errors(logit.reshape(-1, CLASS), np.float32(0), own[at], scale[at] * there).reshape(full)
            rows = np.flatnonzero(there)
            dx[at[rows]] += (e @ w.swapaxes(1, 2)).reshape(-1, HIDDEN).take(rows, 0)
            optimizer.step("word", word, z.swapaxes(1, 2) @ e, c)
            optimizer.step("word_bias", bias, _column_sums(e), c)


def lanes(sizes: list[int], most: int) -> list[list[int]]:
    """Texts laid end to end in lanes of about equal length, the longest first."""
    n = max(1, min(most, len(sizes), sum(sizes) // max(1, max(sizes, default=1))))
    out, heap = [[] for _ in range(n)], [(0, k) for k in range(n)]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (size + sizes[i], k))
    return out


def laid_out(texts: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids (T, B), 0 where a text ends (T, B), text of each place or -1 (T, B))."""
    plan = lanes([len(x) for x in texts], most)
    steps = max(sum(len(texts[i]) for i in lane) for lane in plan)
    ids, owner, mask = (np.full((steps, len(plan)), v, kind) for v, kind in ((0, np.int16), (-1, np.int32), (1, np.float32)))
    for k, lane in enumerate(plan):
        at = 0
        for i in lane:
            ids[at : at + len(texts[i]), k], owner[at : at + len(texts[i]), k] = texts[i], i
            at += len(texts[i])
            mask[at - 1, k] = 0
    return ids, mask, owner


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of whole texts (each ends with the end's symbol); the state is carried across windows."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    ids, mask, owner = laid_out(texts, SCORE_LANES)
    h = np.zeros((ids.shape[1], HIDDEN), np.float32)
    for at in range(0, len(ids), SCORE_STEPS):
        part = slice(at, at + SCORE_STEPS)
        before, h = model.run(ids[part], mask[part], h)
        own = owner[part].ravel()
        use = np.flatnonzero(own >= 0)
        got = model.log_probabilities(before.reshape(-1, HIDDEN).take(use, 0), ids[part].ravel()[use])
        out += np.bincount(own[use], got.astype(np.float64), len(texts))
    return out


def learn_texts(p: dict[str, np.ndarray], texts: list[list[np.ndarray]], rate: float) -> None:
    """The models whose arrays stand side by side in p learn, each from its own texts; those with fewer steps are through sooner."""
    plans = [laid_out(t, TRAIN_LANES) if t else (np.empty((0, 0), int),) * 3 for t in texts]
    order = sorted(range(len(plans)), key=lambda k: -len(plans[k][0]))
    plans = [plans[k] for k in order]
    steps, wide = (max(x[0].shape[i] for x in plans) for i in (0, 1))
    ids, mask, real = (np.full((steps, len(plans), wide), v, kind) for v, kind in ((0, np.int64), (1, np.float32), (False, bool)))
    for k, x in enumerate(plans):
        part = (slice(x[0].shape[0]), k, slice(x[0].shape[1]))
        ids[part], mask[part], real[part] = x[0], x[1], x[2] >= 0
    own = Learners({k: v[order] for k, v in p.items()})
    h, optimizer = np.zeros((len(plans), wide, HIDDEN), np.float32), Adagrad(rate)
    for at in range(0, steps, TRAIN_STEPS):
        many = sum(len(x[0]) > at for x in plans)
        wide = max(x[0].shape[1] for x in plans[:many])
        part = (slice(at, at + TRAIN_STEPS), slice(many), slice(wide))
        h = own.learn(optimizer, ids[part], mask[part], real[part], h[:many, :wide])
    for k, v in own.p.items():
        p[k][order] = v


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, anew in batches of about SCORE_BYTES of text."""
    held, size = [], 0
    for batch in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)), 0
        while at < len(batch):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SCORE_BYTES - size, side="right")))
            held.append(batch.slice(at, to - at))
            size, at = size + int(ends[to - 1]) - before, to
            if at < len(batch) or size >= SCORE_BYTES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _pack(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].astype(np.float32).tobytes() for k in sorted(p))


def _unpack(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, at, out = np.frombuffer(data, np.float32), 0, {}
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _learner(words, start, rate: float):
    """Learning from up to SIDE blocks of texts, a model for each; the states start anew with each run of texts."""

    def learn(table: pa.Table) -> pa.Table:
        of, end = words.value, words.value[END.encode()]
        blocks = sorted(pc.unique(table.column("block")).to_pylist())
        own = {k: np.repeat(v[None], len(blocks), 0) for k, v in start.value.items()}
        texts = [sorted(table.filter(pc.equal(table.column("block"), b)).column("text").to_pylist()) for b in blocks]
        order, at = [np.random.default_rng(8).permutation(len(t)) for t in texts], [0] * len(blocks)
        while any(i < len(t) for i, t in zip(at, texts)):
            runs = []
            for k, t in enumerate(texts):
                run, size = [], 0
                while at[k] < len(t) and (not run or size <= RUN_BYTES):
                    run.append(numbers(of, tokens(t[order[k][at[k]]]), 0, end))
                    size += len(t[order[k][at[k]]])
                    at[k] += 1
                runs.append(run)
            learn_texts(own, runs, rate)
        weights = [float(sum(map(len, t)) + len(t)) for t in texts]
        return pa.table([pa.array(blocks, pa.int32()), pa.array(weights), pa.array([_pack({k: v[i] for k, v in own.items()}) for i in range(len(blocks))], pa.binary())], names=["block", "weight", "model"])

    return learn


def _average(frame: pd.DataFrame) -> pd.DataFrame:
    """One model for up to FAN_IN blocks, each weighing as the text it has learned from."""
    frame = frame.sort_values("block")
    total = sum(w * np.frombuffer(m, np.float32).astype(np.float64) for w, m in zip(frame["weight"], frame["model"]))
    return pd.DataFrame({"block": [int(frame["block"].iloc[0]) // FAN_IN], "weight": [frame["weight"].sum()], "model": [(total / frame["weight"].sum()).astype(np.float32).tobytes()]})


def train(rows: DataFrame, symbols: dict[str, int], frequency: np.ndarray) -> Model:
    """Rounds of training: blocks of documents learn side by side from one model, whose copies are then averaged by tokens.

    The rounds part the training documents among them, so each is learned from once. Round and block go by the hashes of id and
    text, so neither copies of a text nor rows of one id come together.
    """
    model = Model.fresh(frequency)
    session = rows.sparkSession
    words = session.sparkContext.broadcast({w.encode(): i for w, i in symbols.items()})
    for turn in range(ROUNDS):
        part = rows.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(8)), F.lit(ROUNDS)) == turn)
        n = common.blocks(part)
        learn = _learner(words, session.sparkContext.broadcast(model.p), 0.1 / (turn + 1) ** 0.5)
        shape = "block int, weight double, model binary"
        models = common.cut(common.by_block(part.withColumn("doc_id", F.xxhash64("doc_id", "text", F.lit(9))), n).select("block", "text").groupBy(F.floor(F.col("block") / SIDE)).applyInArrow(learn, shape), "models")
        while n > 1:
            models = common.cut(models.groupBy(F.floor(F.col("block") / FAN_IN)).applyInPandas(_average, shape), "models")
            n = -(-n // FAN_IN)
        last = models.head(1)
        if last:
            model = Model(_unpack(last[0]["model"], model.p))
    return model


def score_documents(docs: DataFrame, folds: int = 5, held_out: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs; scores are log10.

    A word outside the softmax has the probability of symbol 0 times its share (c + 0.5) / (N' + 0.5 (V' + 1)) among the words
    outside, so that counts of all training documents take part. Every text ends with an end token, null and empty ones too.
    A null doc_id is in no fold: neither learned from nor held out. Without training documents both scores are those of the
    base formula with N = V = 0. Very long texts are scored whole, the state carried from window to window. Repeated rows give
    repeated rows; an empty table gives no rows; other columns are left out.
    """
    session = docs.sparkSession
    rows = common.texts(docs, key, text).withColumn("learns", common.learns("doc_id", folds, held_out))
    learned = rows.filter(F.coalesce("learns", F.lit(False))).select("doc_id", "text")
    counts = common.cut(word_counts(learned, with_end).select("word", "n"), "words")
    n_all, v_all = counts.agg(F.sum("n"), F.count("*")).head()
    n_all = n_all or 0
    top = sorted(common.most_frequent(counts, "n", HELD).collect(), key=lambda r: (-r["n"], r["word"]))
    # Symbol 0 is for the words outside; the end always has a symbol.
    ranked = [END, *(r["word"] for r in top if r["word"] != END)][: CLASSES * CLASS - 1]
    symbols = {w: i + 1 for i, w in enumerate(ranked)}
    ends = counts.filter(F.col("word") == END).head(1)
    # The end is held too, however seldom it is.
    held = {r["word"]: r["n"] for r in top} | {END: ends[0]["n"] if ends else 0}
    inside = sum(held[w] for w in ranked)
    n_out, v_out = n_all - inside, v_all - sum(held[w] > 0 for w in ranked)
    frequency = np.array([n_out + 0.5, *(held[w] + 0.5 for w in ranked)], float)
    model = train(learned, symbols, frequency) if n_all else None
    base_log, out_log = math.log10(n_all + 0.5 * (v_all + 1)), math.log10(n_out + 0.5 * (v_out + 1))
    sent = session.sparkContext.broadcast(({w.encode(): (symbols.get(w, 0), n) for w, n in held.items()}, model and model.p))
    shape = common.shape(rows, "held_out boolean, number long, n_tokens long, n_known long, base double, score double, rare array<string>")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, p = sent.value
        own = Model(p) if p is not None else None
        names = list(known)
        place = {w: i for i, w in enumerate(names)}
        symbol, count = (np.array([known[w][k] for w in names], np.int64) for k in (0, 1))
        weight = np.log10(count + 0.5)
        end = place[END.encode()]
        for batch in _joined(batches):
            out, ids = [], []
            for t in batch.column("text"):
                words = tokens(t.as_py())
                x = numbers(place, words, -1, end)
                rare = [words[i].decode() for i in np.flatnonzero(x < 0)]
                have = x[x >= 0]
                s = np.where(x >= 0, symbol[x], 0).astype(np.int16)
                outside = int((s == 0).sum())
                base = float(weight[have].sum())
                inner = float(weight[have[symbol[have] == 0]].sum())
                out.append((len(x), int((count[have] > 0).sum()), base - len(x) * base_log, inner - outside * out_log, rare))
                ids.append(s)
            like = log_likelihoods(own, ids) / _LN10 if own else np.array([v[2] - v[3] for v in out])
            out = [(*v[:3], v[3] + x, v[4]) for v, x in zip(out, like.tolist())]
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("number"), *(pa.array(c, t) for c, t in zip(columns, types))], names=shape.names)

    numbered = rows.select(F.monotonically_increasing_id().alias("number"), "doc_id", F.coalesce(~F.col("learns"), F.lit(False)).alias("held_out"), "text")
    scored = common.cut(numbered.mapInArrow(score, shape), "scored")
    # Words that no task holds: their counts are joined, word by word, and summed for each text.
    rare = scored.select("number", F.explode("rare").alias("word")).groupBy("number", "word").agg(F.count("*").alias("times"))
    found = rare.join(counts, "word", "left").groupBy("number").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("weight"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known")
    )
    whole = scored.drop("rare").join(found, "number", "left")
    more = F.coalesce("weight", F.lit(0.0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
