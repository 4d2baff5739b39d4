"""Toxicity of documents by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a learned vector of its hash, its document log-odds among the training rows, and the sum of learned vectors
of its character trigrams. Windows of `WINDOW` words that overlap by half run through the network in both
directions; attention weights pool the states. A document's score is that of its highest window, calibrated
by a logistic fit on the training documents. All windows of the whole text are scored.

Null and empty texts, and texts without a word: the score of an empty window. Repeated rows and ties get equal scores; an id whose
labels disagree counts as toxic. Texts of more than LONG bytes are read in pieces that begin at a window's first word. An empty table
gives an empty result, and labels of one kind alone a constant score. Other columns are never read (training reads labels.toxic).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import RollingHash, WordBatch, fold, hashed, least_hashes, materialize, mix, row_chunks, text_chunks

TRAIN_DOCS = 1500  # labelled documents of either class that the model is fitted on, at most; those with the least hashes of doc_id
WINDOW, STRIDE = 32, 16
WORD_SLOTS, TRI_SLOTS, ODDS_SLOTS = 1 << 14, 1 << 12, 1 << 18
DW, DC, H = 8, 4, 8
STEPS, LOT = 400, 192
LONG = 4 << 20  # bytes, beyond which a text is read in pieces
_NO_LETTER = re.compile(rb"[^A-Za-z\x80-\xff]")


def inputs(raw: list[bytes]) -> tuple[WordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """(words, hash of each word, trigram slots, first trigram of each word)."""
    w = WordBatch(raw, "letter")
    h = w.hashes(RollingHash(47))
    length = w.end - w.start
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum())) + np.repeat(w.start - first, length)
    left = np.where(at == np.repeat(w.start, length), 0, w.buf[np.maximum(at - 1, 0)]).astype(np.uint64)
    right = np.where(at + 1 == np.repeat(w.end, length), 0, w.buf[np.minimum(at + 1, len(w.buf) - 1)]).astype(np.uint64)
    tri = (mix((left << np.uint64(16)) | (w.buf[at].astype(np.uint64) << np.uint64(8)) | right) % np.uint64(TRI_SLOTS)).astype(np.int64)
    return w, h, tri, first


def windows(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of each window; a document without words has none."""
    n = np.where(count > 0, np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1), 0)
    doc = np.repeat(np.arange(len(count)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = first[doc] + k * STRIDE
    return doc, start, np.minimum(WINDOW, first[doc] + count[doc] - start)


def long_windows(text: bytes, size: int | None = None) -> Iterator[tuple]:
    """(words, start, length) of the windows of a long text, from pieces of about `size` bytes that begin at a window's first word: the same windows as of the whole text."""
    size = size or LONG
    pos = 0
    while pos < len(text):
        end = _NO_LETTER.search(text, pos + size)
        hi = end.start() if end else len(text)
        words = inputs([text[pos:hi]])
        w, n = words[0], len(words[1])
        _, start, length = windows(np.array([0]), np.array([n]))
        if hi < len(text):  # a window that ends with the piece may go on in the next one
            keep = start + WINDOW <= n
            if not keep.any():
                size *= 2
                continue
            start, length = start[keep], length[keep]
        if len(start):
            yield words, start, length
        if hi == len(text):
            return
        following = int(start[-1]) + STRIDE
        pos = pos + int(w.start[following]) if following < n else hi


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Net:
    def __init__(self, seed: int = 3):
        g = np.random.default_rng(seed)
        r = lambda *s: (g.standard_normal(s) * 0.3).astype(np.float32)
        d = DW + DC + 1
        self.p = {"word": r(WORD_SLOTS, DW) * 0.1, "tri": r(TRI_SLOTS, DC) * 0.1, "wx": r(d, 6 * H), "bx": np.zeros(6 * H, np.float32), "uf": r(H, 3 * H), "ub": r(H, 3 * H), "att": r(2 * H), "out": r(2 * H), "bias": np.zeros(1, np.float32)}
        self.odds = np.zeros(ODDS_SLOTS, np.float32)
        self.scale = np.array([1.0, 0.0])

    def embed(self, h, tri, first) -> np.ndarray:
        c = np.add.reduceat(self.p["tri"][tri], first, axis=0) if len(tri) else np.zeros((0, DC), np.float32)
        return np.concatenate([self.p["word"][(h % np.uint64(WORD_SLOTS)).astype(np.int64)], c, self.odds[(h >> np.uint64(46)).astype(np.int64)][:, None]], 1)

    def run(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows. x: steps x windows x 6H inputs of both directions; mask: steps x windows."""
        t_, n = mask.shape
        states = np.empty((t_, n, 2 * H), np.float32)
        for d, u in ((0, self.p["uf"]), (1, self.p["ub"])):
            h = np.zeros((n, H), np.float32)
            for t in range(t_) if d == 0 else range(t_ - 1, -1, -1):
                hu = h @ u
                xt = x[t, :, 3 * H * d : 3 * H * (d + 1)]
                zr = _sigmoid(xt[:, : 2 * H] + hu[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                new = np.tanh(xt[:, 2 * H :] + r * hu[:, 2 * H :])
                nxt = new + z * (h - new)
                if not mask[t].all():
                    nxt = np.where(mask[t][:, None], nxt, h)
                if keep is not None:
                    keep.append((d, t, h, hu, z, r, new))
                h = nxt
                states[t, :, H * d : H * (d + 1)] = h
        a = states @ self.p["att"]
        a = np.where(mask, a, -1e9)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnk->nk", a, states)
        if keep is not None:
            keep.extend([states, a, pooled])
        return pooled @ self.p["out"] + self.p["bias"]

    def logits(self, words: tuple, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of windows in the order of their first words; only the inputs of a few thousand windows exist at a time."""
        _, h, tri, first = words
        bound = np.append(first, len(tri))
        out = np.empty(len(start), np.float32)
        for b in range(0, len(start), 4096):
            s, n = start[b : b + 4096], length[b : b + 4096]
            lo, hi = int(s.min()), int((s + n).max())
            x = self.embed(h[lo:hi], tri[bound[lo] : bound[hi]], first[lo:hi] - bound[lo]) @ self.p["wx"] + self.p["bx"]
            order = np.argsort(-n, kind="stable")  # whole windows need no mask
            whole = int((n == WINDOW).sum())
            cuts = [c for c in (0, whole, *range(whole + 512, len(n), 512), len(n))]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j > i:
                    pick = order[i:j]
                    t = np.arange(n[pick].max())[:, None]
                    at = np.minimum(s[pick] - lo + t, hi - lo - 1)
                    out[b + pick] = self.run(x[at], t < n[pick])
        return out

    def documents(self, raw: list[bytes]) -> np.ndarray:
        """The highest logit of each document's windows."""
        words = inputs([x if len(x) <= LONG else b"" for x in raw])
        doc, start, length = windows(words[0].first[:-1], words[0].count)
        out = np.full(len(raw), float(self.p["bias"][0]))
        top = np.full(len(raw), -np.inf)
        if len(doc):
            np.maximum.at(top, doc, self.logits(words, start, length))
        for i, x in enumerate(raw):
            if len(x) > LONG:
                top[i] = max((float(self.logits(*part).max()) for part in long_windows(x)), default=-np.inf)
        return np.where(np.isfinite(top), top, out)

    def probability(self, raw: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * np.clip(self.documents(raw), -20, 20) + self.scale[1], -30, 30)))

    def gradients(self, words, start, length, y) -> tuple[dict, np.ndarray]:
        _, h, tri, first = words
        e = self.embed(h, tri, first)
        t = np.arange(length.max())[:, None]
        mask, at = t < length, np.minimum(start + t, len(e) - 1)
        x = e[at] @ self.p["wx"] + self.p["bx"]
        keep: list = []
        logit = self.run(x, mask, keep)
        pooled, a, states = keep.pop(), keep.pop(), keep.pop()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dl = ((1 / (1 + np.exp(-logit))) - y) / len(y)
        g["bias"][0] = dl.sum()
        g["out"] = pooled.T @ dl
        dp = dl[:, None] * self.p["out"]
        da = np.einsum("nk,tnk->tn", dp, states)
        ds = a[:, :, None] * dp
        dscore = a * (da - (a * da).sum(0))
        g["att"] = np.einsum("tn,tnk->k", dscore, states)
        ds += dscore[:, :, None] * self.p["att"]
        dx = np.zeros_like(x)
        dh = {0: np.zeros((len(y), H), np.float32), 1: np.zeros((len(y), H), np.float32)}
        for d, t0, hp, hu, z, r, new in reversed(keep):
            u, gu = (self.p["uf"], g["uf"]) if d == 0 else (self.p["ub"], g["ub"])
            m = mask[t0][:, None]
            total = dh[d] + ds[t0, :, H * d : H * (d + 1)]
            live = np.where(m, total, 0)
            dnew = live * (1 - z) * (1 - new * new)
            dz = live * (hp - new) * z * (1 - z)
            dr = dnew * hu[:, 2 * H :] * r * (1 - r)
            dhu = np.concatenate([dz, dr, dnew * r], 1)
            dx[t0, :, 3 * H * d : 3 * H * (d + 1)] = np.concatenate([dz, dr, dnew], 1)
            gu += hp.T @ dhu
            dh[d] = np.where(m, live * z + dhu @ u.T, total)
        flat, used = dx.reshape(-1, 6 * H), at.ravel()
        g["wx"], g["bx"] = e[used].T @ flat, flat.sum(0)
        de = np.zeros_like(e)
        np.add.at(de, used, flat @ self.p["wx"].T)
        np.add.at(g["word"], (h % np.uint64(WORD_SLOTS)).astype(np.int64), de[:, :DW])
        length_of = np.diff(np.append(first, len(tri)))
        np.add.at(g["tri"], tri, np.repeat(de[:, DW : DW + DC], length_of, axis=0))
        return g, logit


def fit(texts: list[str], toxic: list[int], seed: int = 5) -> Net:
    """Adam over windows. Of a toxic document the window with the highest log-odds counts as toxic; of others, that window and random ones count as clean."""
    net, rng = Net(), np.random.default_rng(seed)
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        net.p["bias"][0] = -4.0 if not len(y) or y.max() == 0 else 4.0
        net.p["out"][:] = 0
        return net
    raw = [t.encode() for t in texts]
    pieces = [inputs(raw[lo:hi]) for lo, hi in row_chunks(np.fromiter(map(len, raw), np.int64, len(raw)), 1 << 18)]
    # what training needs of all words, without the bytes
    h = np.concatenate([p[1] for p in pieces])
    tris = np.concatenate([p[2].astype(np.int16) for p in pieces])
    sizes = np.concatenate([(p[0].end - p[0].start).astype(np.int32) for p in pieces])
    count = np.concatenate([p[0].count for p in pieces])
    del pieces
    tri_first, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(raw)), count)
    slot = (h >> np.uint64(46)).astype(np.int64)
    pairs = np.unique(np.stack([of, slot], 1), axis=0)
    pos = np.bincount(pairs[y[pairs[:, 0]] == 1, 1], minlength=ODDS_SLOTS)
    neg = np.bincount(pairs[y[pairs[:, 0]] == 0, 1], minlength=ODDS_SLOTS)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
    df = pos + neg
    net.odds = np.where(df >= 4, np.clip(odds, -4, 4) * df / (df + 10), 0).astype(np.float32)
    doc, start, length = windows(np.cumsum(count) - count, count)
    peak = np.array([net.odds[slot[s : s + n]].max() for s, n in zip(start, length, strict=True)])
    order = np.lexsort((-peak, doc))
    top = order[np.append(True, doc[order][1:] != doc[order][:-1])]
    good, bad = top[y[doc[top]] == 1], np.concatenate([top[y[doc[top]] == 0], rng.choice(np.flatnonzero(y[doc] == 0), min(4000, int((y[doc] == 0).sum())), replace=False)])
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(good, LOT // 3), rng.choice(bad, LOT - LOT // 3)])
        # the lot's own words only, laid end to end
        parts = [np.arange(s, s + n) for s, n in zip(start[pick], length[pick], strict=True)]
        take = np.concatenate(parts)
        n, tl = length[pick], sizes[take].astype(np.int64)
        tri = tris[np.arange(int(tl.sum())) + np.repeat(tri_first[take] - (np.cumsum(tl) - tl), tl)].astype(np.int64)
        sub = (None, h[take], tri, np.cumsum(tl) - tl)
        g, _ = net.gradients(sub, np.cumsum(n) - n, n, y[doc[pick]].astype(np.float32))
        rate = 0.02 * min(1, 2 * (1 - step / (STEPS + 1)))
        for k, v in net.p.items():
            a, b = m[k]
            a += 0.1 * (g[k] - a)
            b += 0.01 * (g[k] * g[k] - b)
            v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    logit = np.clip(np.concatenate([net.documents(raw[lo:hi]) for lo, hi in row_chunks(np.fromiter(map(len, raw), np.int64, len(raw)), 1 << 18)]), -20, 20)
    s = np.array([1.0, 0.0])
    x = np.stack([logit, np.ones_like(logit)], 1)
    for _ in range(50):  # Newton steps of the logistic fit, classes weighted alike
        q = 1 / (1 + np.exp(-np.clip(x @ s, -30, 30)))
        weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (weight * (q - y)) + 1e-4 * (s - [1, 0]))
        s = s - step * min(1, 0.3 / max(1e-9, np.abs(step).max()))
    net.scale = np.maximum(s, [0.05, -np.inf])
    return net


def training_rows(docs: DataFrame, labels: DataFrame) -> list:
    """At most TRAIN_DOCS labelled documents of either class outside the held-out fold."""
    marked = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # toxic, if labels of one id disagree
    known = hashed(docs.where((fold() != 0) & F.col("text").isNotNull())).select("doc_id", "_u", "_v").join(marked, "doc_id")
    return least_hashes(docs, known, TRAIN_DOCS, "toxic")


def score_batches(net_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = net_of()
        for rows, raw in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(net.probability(raw).astype(np.float64))], names=["doc_id", "score"])

    return run


def toxicity_of_documents(docs: DataFrame, labels: DataFrame, net: Net | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    if net is None:
        rows = training_rows(docs, labels)
        net = fit([r[0] for r in rows], [r[1] for r in rows])
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = materialize(texts.mapInArrow(score_batches(lambda: shared.value), f"doc_id {kind}, score double"))
    shared.destroy()
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
