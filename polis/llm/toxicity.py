"""Operator 4: toxicity by a bidirectional gated recurrent network with attention pooling over characters and words."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .language_id import letter_words
from .recurrent import Adagrad, backward, by_row, forward, sigmoid

#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 48
#: Labelled documents to learn from, of label 1 and of label 0; each with all its windows.
POSITIVE, NEGATIVE = 1000, 2000
#: Sizes: hidden units of a direction, word and character vectors, attention, hashed byte n-grams, known words.
HIDDEN, WORD, CHARACTER, ATTENTION, PIECES, VOCABULARY = 12, 16, 12, 8, 1 << 16, 20_000
#: Lengths of byte n-grams; training documents that a known word stands in; share of words that training hides.
LENGTHS, KNOWN_FROM, HIDDEN_WORDS = (3, 7), 4, 0.3
#: Windows scored at once; words whose inputs a worker remembers; bytes of text taken at once.
BATCH, REMEMBERED, RUN_BYTES = 512, 150_000, 2 << 20


def starts(n: int) -> list[int]:
    """Where the overlapping windows of n words start: the last one ends with the text; none without words."""
    last = max(0, n - WINDOW)
    return [*range(0, last, STRIDE), last] if n else []


def pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed byte n-grams of the words with marked edges, word by word, how many each word has)."""
    marked = [b"<%b>" % w.encode() for w in words]
    size = np.array([len(m) for m in marked], np.int64)
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32) + np.uint32(1)
    owner = np.repeat(np.arange(len(words)), size)
    left = (np.cumsum(size))[owner] - np.arange(len(data))  # bytes from here to the end of the word
    grams, owners = [], []
    for n in LENGTHS:
        h = np.full(max(0, len(data) - n + 1), np.uint32(n))
        for k in range(n):
            h = (h ^ data[k : k + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        inside = left[: len(h)] >= n
        grams.append((h % np.uint32(PIECES)).astype(np.int64)[inside])
        owners.append(owner[: len(h)][inside])
    owners = np.concatenate(owners)
    return np.concatenate(grams)[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))


class Network:
    """The network; parameters are arrays by name."""

    def __init__(self, vocabulary: list[str], prior: float, p: dict[str, np.ndarray] | None = None, seed: int = 4):
        self.vocabulary, self.prior = {w: i + 1 for i, w in enumerate(vocabulary)}, prior
        r = np.random.default_rng(seed)
        shape = {
            "word": (len(vocabulary) + 1, WORD), "character": (PIECES, CHARACTER), "input": (WORD + CHARACTER, 6 * HIDDEN), "bias": (6 * HIDDEN,), "u0": (HIDDEN, 3 * HIDDEN), "u1": (HIDDEN, 3 * HIDDEN),
            "attend": (2 * HIDDEN, ATTENTION), "query": (ATTENTION,), "out": (2 * HIDDEN,), "shift": (1,),
        }
        self.p = p or {k: (r.normal(0, 0.1 if k in ("word", "character") else 0.3, s) * (k not in ("bias", "shift"))).astype(np.float32) for k, s in shape.items()}
        self.seen: dict[str, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), np.float32)

    def vectors(self, ids: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A word's own vector beside the sum of its n-grams', which is scaled by the root of their number."""
        character = np.add.reduceat(self.p["character"][grams], np.cumsum(n) - n, axis=0) / np.sqrt(n, dtype=np.float32)[:, None]
        return np.concatenate([self.p["word"][ids], character], 1)

    def index(self, words: list[str]) -> np.ndarray:
        """Rows of table for words; the table remembers their inputs to the gates."""
        fresh = list(set(words).difference(self.seen))
        for k in range(0, len(fresh), 20_000):
            new = fresh[k : k + 20_000]
            ids = np.array([self.vocabulary.get(w, 0) for w in new], np.int64)
            x = self.vectors(ids, *pieces(new)) @ self.p["input"] + self.p["bias"]
            at = len(self.seen)
            while len(self.table) < at + len(new):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(new)] = x
            self.seen.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))

    def pooled(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """(logits, what gradient needs) of windows x (T, B, 6H)."""
        p, zero = self.p, np.zeros((x.shape[1], HIDDEN), np.float32)
        right, saved0 = forward(x[..., : 3 * HIDDEN], p["u0"], zero, mask, keep)
        left, saved1 = forward(x[::-1, :, 3 * HIDDEN :], p["u1"], zero, mask[::-1], keep)
        h = np.concatenate([right, left[::-1]], 2)
        a = np.tanh(h @ p["attend"])
        e = a @ p["query"]
        e = np.where(mask > 0, e, -1e9)
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        pool = np.einsum("tb,tbh->bh", e, h)
        return pool @ p["out"] + p["shift"][0], (h, a, e, pool, right, saved0, left, saved1, zero)

    def gradient(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray):
        """(loss, gradient of x, gradients of what stands above it)."""
        p = self.p
        logit, (h, a, e, pool, right, saved0, left, saved1, zero) = self.pooled(x, mask, True)
        y = sigmoid(logit)
        d = (weight * (y - label)).astype(np.float32)
        g = {"out": pool.T @ d, "shift": d.sum(keepdims=True)}
        dpool = d[:, None] * p["out"]
        de = np.einsum("bh,tbh->tb", dpool, h)
        de = e * (de - (e * de).sum(0))
        da = de[..., None] * p["query"] * (1 - a * a)
        g["query"] = np.einsum("tba,tb->a", a, de)
        g["attend"] = h.reshape(-1, 2 * HIDDEN).T @ da.reshape(-1, ATTENTION)
        dh = (e[..., None] * dpool + da @ p["attend"].T).astype(np.float32)
        dx0, g["u0"] = backward(dh[..., :HIDDEN], right, saved0, p["u0"], zero, mask)
        dx1, g["u1"] = backward(dh[::-1, :, HIDDEN:], left, saved1, p["u1"], zero, mask[::-1])
        loss = -(weight * np.where(label > 0, np.log(y + 1e-9), np.log(1 - y + 1e-9))).sum()
        return loss, np.concatenate([dx0, dx1[::-1]], 2), g

    def step(self, optimizer: Adagrad, corpus: Corpus, first: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray, hide: np.random.Generator) -> float:
        """Learn from one batch of windows of a corpus."""
        p, many = self.p, len(first)
        at, mask = cut(first, size)
        words, inverse = np.unique(corpus.words[at], return_inverse=True)
        ids = np.where(hide.random(len(words)) < HIDDEN_WORDS, 0, corpus.known[words])
        grams, n = corpus.pieces(words)
        vectors = self.vectors(ids, grams, n)
        loss, dx, g = self.gradient((vectors @ p["input"] + p["bias"])[inverse.reshape(at.shape)], mask, label, weight)
        full = by_row(inverse.ravel(), dx.reshape(-1, 6 * HIDDEN))[1]
        g |= {"input": vectors.T @ full, "bias": full.sum(0)}
        dv = full @ p["input"].T / many
        for k, v in g.items():
            optimizer.step(k, p[k], np.clip(v / many, -1, 1))
        rows, d = by_row(ids, dv[:, :WORD])
        optimizer.step("word", p["word"], d, rows)
        rows, d = by_row(grams, np.repeat(dv[:, WORD:] / np.sqrt(n, dtype=np.float32)[:, None], n, axis=0))
        optimizer.step("character", p["character"], d, rows)
        return float(loss) / many

    def scores(self, words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The score of each window of words, given as rows of table."""
        out, order = np.empty(len(first)), np.argsort(size, kind="stable")
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            place, mask = cut(first[own], size[own])
            out[own] = sigmoid(self.pooled(self.table[words[place]], mask)[0].astype(np.float64))
        return out

    def score_texts(self, texts: list[str | None]) -> list[float]:
        """The highest score of a text's windows; the share of label 1 among what was learned from, for a text without words."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        words, first, size, owner = [], [], [], []
        for i, t in enumerate(texts):
            own = letter_words(t or "")
            at = starts(len(own))
            first += [len(words) + s for s in at]
            size += [min(WINDOW, len(own))] * len(at)
            owner += [i] * len(at)
            words += own
        out = np.full(len(texts), -1.0)
        if words:
            np.maximum.at(out, owner, self.scores(self.index(words), np.array(first), np.array(size)))
        return np.where(out < 0, self.prior, out).tolist()


def cut(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places (T, B), mask (T, B)) of windows."""
    step = np.arange(size.max())[:, None]
    return first + np.minimum(step, size - 1), (step < size).astype(np.float32)


class Corpus:
    """Labelled texts to learn from: their words numbered in one array, their windows as places in it."""

    def __init__(self, examples: list[tuple[int, str]]):
        place: dict[str, int] = {}
        flat, first, size, owner, self.label, total = [], [], [], [], [], 0
        for label, text in examples:
            own = letter_words(text)
            if own:
                at = starts(len(own))
                first.append(np.array(at, np.int64) + total)
                total += len(own)
                size.append(np.full(len(at), min(WINDOW, len(own))))
                owner.append(np.full(len(at), len(self.label)))
                flat.append(np.fromiter((place.setdefault(w, len(place)) for w in own), np.int32, len(own)))
                self.label.append(label)
        self.label = np.array(self.label, np.int64)
        self.names = list(place)
        self.words, self.first, self.size, self.doc = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (flat, first, size, owner))
        documents = np.bincount(np.concatenate([np.unique(x) for x in flat]), minlength=len(place)) if flat else np.empty(0, np.int64)
        known = sorted(np.flatnonzero(documents >= KNOWN_FROM).tolist(), key=lambda i: (-documents[i], self.names[i]))[:VOCABULARY]
        self.vocabulary = [self.names[i] for i in known]
        self.known = np.zeros(len(place), np.int64)
        self.known[known] = np.arange(1, len(known) + 1)
        self.grams, self.n = pieces(self.names) if place else (np.empty(0, np.int64),) * 2
        self.at = np.cumsum(self.n) - self.n

    def pieces(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[words]
        return self.grams[np.repeat(self.at[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def fit(examples: list[tuple[int, str]], seed: int = 4, first: int = 2, later: int = 3, size: int = 256, least: int = 90) -> Network:
    """Learn from (label, text) of documents: first from all windows of short documents (of all, where the short ones don't have
    both labels), then from the window of each document that scores highest, and one other window of documents of label 0 beside. Small samples are learned from in
    smaller batches and more often, in at least `least` steps of the first kind and of the second. Texts without words are
    left out."""
    corpus = Corpus(examples)
    labels = corpus.label
    if not 0 < labels.sum() < len(labels):
        net = Network([], float(labels.mean()) if len(labels) else 0.0, seed=seed)
        net.p["out"][:], net.p["shift"][0] = 0, 9.0 if labels.sum() else -9.0
        return net
    net = Network(corpus.vocabulary, float(labels.mean()), seed=seed)
    share = (len(labels) / 2 / np.bincount(labels, minlength=2)).clip(0.5, 3)
    r, optimizer = np.random.default_rng(seed), Adagrad(0.08)
    many = np.bincount(corpus.doc)

    def learn(windows: np.ndarray, weight: np.ndarray, times: int, steps: int) -> None:
        batch = int(np.clip(len(windows) // 20, 32, size))
        for _ in range(max(times, -(-steps * batch // max(1, len(windows))))):
            order = r.permutation(len(windows))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                own, label = windows[part], labels[corpus.doc[windows[part]]]
                net.step(optimizer, corpus, corpus.first[own], corpus.size[own], label.astype(np.float32), (share[label] * weight[part]).astype(np.float32), r)

    short = np.flatnonzero(many[corpus.doc] <= 8)
    if len(set(labels[corpus.doc[short]].tolist())) < 2:
        short = np.arange(len(corpus.doc))
    learn(short, many[corpus.doc[short]] ** -0.5, first, least)
    for _ in range(later):
        net.seen.clear()
        score = net.scores(net.index(corpus.names)[corpus.words], corpus.first, corpus.size)
        order = np.lexsort((-score, corpus.doc))
        head = np.cumsum(many) - many
        best = order[head]
        other = order[head + (r.random(len(many)) * many).astype(np.int64)][labels == 0]
        learn(np.r_[best, other], np.r_[np.ones(len(best)), np.full(len(other), 0.5)], 1, least // later)
    net.seen.clear()
    return net


def _packed(net: Network) -> bytes:
    out = io.BytesIO()
    np.savez(out, vocabulary="\n".join(net.vocabulary), prior=net.prior, **{f"p_{k}": v for k, v in net.p.items()})
    return out.getvalue()


def _unpacked(data: bytes) -> tuple[list[str], float, dict[str, np.ndarray]]:
    held = np.load(io.BytesIO(data))
    return [w for w in str(held["vocabulary"]).split("\n") if w], float(held["prior"]), {k[2:]: held[k] for k in held.files if k.startswith("p_")}


def train(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, key: str = "doc_id", text: str = "text", label: str = "toxic") -> bytes:
    """The packed network, learned from a bounded sample of labelled rows: POSITIVE and NEGATIVE documents, the first by the
    hash of their id, with their whole texts. A document labelled twice has its larger label.

    The sample goes to one task, which learns; only the network comes to the driver.
    """
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1)").filter(common.learns("doc_id", folds, held_out))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, POSITIVE), (0, NEGATIVE))]
    sample = common.texts(docs, key, text).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((str(d), t, k) for batch in batches for d, t, k in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label"))))
        yield pa.RecordBatch.from_arrays([pa.array([_packed(fit([(k, t) for _, t, k in rows]))], pa.binary())], names=["network"])

    found = sample.select("doc_id", "text", "label").repartition(1).mapInArrow(learn, "network binary").head(1)
    return bytes(found[0]["network"]) if found else _packed(fit([]))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held_out: int = 2, key: str = "doc_id", text: str = "text", label: str = "toxic", carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, without a shuffle of texts; with carry also row, a struct of all
    columns of docs.

    Words are runs of letters in lower case. A text's score is the highest of its overlapping windows', 0 to 1, however long
    the text; predicted is 1 from threshold on. Only the text is an input. Texts that are null, empty or without letters score
    the share of label 1 among what was learned from; without labels of both kinds the score is near 0 or 1, as they say, and
    near 0 without any. A null doc_id is in no fold. Repeated rows give repeated rows, an empty table no rows; other columns,
    whatever their names, are left out or carried.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held_out, key, text, label))
    extra = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(~common.learns(key, folds, held_out), F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"), *extra)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(*_unpacked(sent.value))
        for batch in batches:
            texts, at, out = batch.column("text").to_pylist(), 0, []
            while at < len(texts):  # runs of bounded size
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= RUN_BYTES):
                    size += len(texts[end])
                    end += 1
                out += own.score_texts(texts[at:end])
                at = end
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(out, pa.float64()), pa.array([int(s >= threshold) for s in out], pa.int32())]
            names = ["doc_id", "held_out", "score", "predicted"]
            if carry:
                columns, names = [*columns, batch.column("row")], [*names, "row"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(score, common.shape(rows, "held_out boolean, score double, predicted int"))
