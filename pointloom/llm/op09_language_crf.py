"""Language of documents by a linear-chain conditional random field over words.

Each word (letters in lower case) gets emission scores from hashed features: the word itself (lexicon), its first two and
three bytes and last two, three and four bytes (affixes), and its byte trigrams. Learned transitions join the
words of a sentence, however long; forward-backward gives the marginal probability of each language for each
word. A document's language has the largest sum of marginals, each weighted by the word's bytes; the score is its
share. Training sentences are partly spliced from two languages, so that transitions see switches.

Long sentences are cut into parts whose transfer matrices are combined first, so that all parts then run side by side with
the messages that reach them: the marginals are those of the whole chain.

Null and empty texts, and texts without a letter: `und`, score 0. Ties: the first language by name. Repeated rows get
equal results, and equal texts count once in training. A very long text is held by one task, about 60 bytes for each of its bytes. An empty
table gives an empty result, and without labels all texts are `und`. Other columns are never read (training reads lang) and carried by
identify() as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import RollingHash, WordBatch, fold, hashed, least_hashes, materialize, mix, text_chunks

TRAIN_DOCS = 500  # labelled texts of each language that the model is fitted on, at most; those with the least hashes
PART = 128  # words of a long sentence that advance together with its other parts
SLOTS = 1 << 17
EPOCHS = 4


def features(w: WordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fixed slots of each word, trigram slots, the trigrams' first place for each word)."""
    r = RollingHash(31)
    p = r.prefix(w.buf)
    s, e = w.start, w.end
    ranges = [(s, e), *((s, np.minimum(s + k, e)) for k in (2, 3)), *((np.maximum(e - k, s), e) for k in (2, 3, 4))]
    fixed = np.stack([mix(r.ranges(p, a, b) + np.uint64(i)) % np.uint64(SLOTS) for i, (a, b) in enumerate(ranges)], 1).astype(np.int32)
    # trigrams of the word with a mark at each side: as many as it has bytes
    length = e - s
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum())) + np.repeat(s - first, length)
    left = np.where(at == np.repeat(s, length), 0, w.buf[np.maximum(at - 1, 0)]).astype(np.uint64)
    right = np.where(at + 1 == np.repeat(e, length), 0, w.buf[np.minimum(at + 1, len(w.buf) - 1)]).astype(np.uint64)
    tri = (mix((left << np.uint64(16)) | (w.buf[at].astype(np.uint64) << np.uint64(8)) | right) % np.uint64(SLOTS)).astype(np.int32)
    return fixed, tri, first


def sentences(w: WordBatch) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each sentence."""
    n = len(w.start)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    marks = np.concatenate([[0], np.cumsum(np.isin(w.buf, np.frombuffer(b".!?\n", np.uint8)))])
    new = np.ones(n, bool)
    new[1:] = (marks[w.start[1:]] > marks[w.end[:-1]]) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # slots x languages
    start: np.ndarray
    trans: np.ndarray

    def emissions(self, fixed, tri, first) -> np.ndarray:
        out = np.zeros((len(fixed), len(self.langs)), np.float32)
        for k in range(fixed.shape[1]):
            out += self.weights[fixed[:, k]]
        if len(tri):
            out += np.add.reduceat(self.weights[tri], first, axis=0)
        return out

    def marginals(self, emit: np.ndarray, first: np.ndarray, length: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """Marginals of each word by forward-backward, all sentences side by side. counts: gets the expected transitions added."""
        e = np.exp(emit - emit.max(1, keepdims=True))
        step = np.exp(self.trans).astype(np.float32)
        begin, end = np.tile(np.exp(self.start), (len(first), 1)), np.ones((len(first), len(self.langs)), np.float32)
        if counts is None and len(length) and length.max() > PART:
            first, length, begin, end = self._parts(e, step, first, length)
        order = np.argsort(-length, kind="stable")
        first, length, begin, end = first[order], length[order], begin[order], end[order]
        live = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")  # sentences longer than t
        alpha, beta = np.empty_like(e), np.empty_like(e)
        a = None
        for t, m in enumerate(live):
            at = first[:m] + t
            a = (begin if t == 0 else a[:m] @ step) * e[at]
            a /= a.sum(1, keepdims=True)
            alpha[at] = a
        for t in range(len(live) - 1, -1, -1):
            m, longer = live[t], live[t + 1] if t + 1 < len(live) else 0
            b = end[:m].copy()
            if longer:
                after = first[:longer] + t + 1
                ahead = beta[after] * e[after]
                b[:longer] = ahead @ step.T
                b[:longer] /= b[:longer].sum(1, keepdims=True)
                if counts is not None:
                    pair = alpha[first[:longer] + t][:, :, None] * step * ahead[:, None, :]
                    counts += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            beta[first[:m] + t] = b
        out = alpha * beta
        return out / out.sum(1, keepdims=True)

    def _parts(self, e: np.ndarray, step: np.ndarray, first: np.ndarray, length: np.ndarray):
        """(first, length, message from before, message from behind) of the parts of all sentences."""
        k = len(self.langs)
        many = -(-length // PART)
        whose = np.repeat(np.arange(len(first)), many)
        nth = np.arange(len(whose)) - np.repeat(np.cumsum(many) - many, many)
        at, size = first[whose] + PART * nth, np.minimum(PART, length[whose] - PART * nth)
        begin, end = np.tile(np.exp(self.start), (len(at), 1)), np.ones((len(at), k), np.float32)
        cut = np.flatnonzero(many[whose] > 1)
        n = np.zeros((len(at), k, k), np.float32)  # of each part: emissions and transitions from its first word to its last
        n[cut] = np.eye(k, dtype=np.float32) * e[at[cut]][:, None, :]
        for t in range(1, PART):
            on = cut[size[cut] > t]
            m = (n[on] @ step) * e[at[on] + t][:, None, :]
            n[on] = m / m.sum((1, 2), keepdims=True)
        head = np.cumsum(many) - many
        for j in range(1, int(many.max())):
            on = head[many > j] + j
            v = (begin[on - 1][:, None, :] @ n[on - 1])[:, 0] @ step
            begin[on] = v / v.sum(1, keepdims=True)
        last = np.cumsum(many) - 1
        for j in range(1, int(many.max())):
            on = last[many > j] - j
            w = ((n[on + 1] @ end[on + 1][:, :, None])[:, :, 0]) @ step.T
            end[on] = w / w.sum(1, keepdims=True)
        return at, size, begin.astype(np.float32), end


def fit(texts: list[str], langs: list[str], seed: int = 1) -> Crf:
    """Gradient ascent on the likelihood, with adaptive steps."""
    names = sorted(set(langs))
    k, rng = len(names), np.random.default_rng(seed)
    model = Crf(names, np.zeros((SLOTS, k), np.float32), np.zeros(k, np.float32), np.zeros((k, k), np.float32))
    if k < 2 or not texts:
        return model
    gw, gt = np.full((SLOTS, k), 1e-2, np.float32), np.full((k, k), 1.0, np.float32)
    label = np.array([names.index(x) for x in langs])
    for _ in range(EPOCHS):
        deal = rng.permutation(len(texts))
        for lot in np.array_split(deal, max(1, len(deal) // 100)):
            w = WordBatch([texts[i].lower().encode() for i in lot], "letter")
            first, length = sentences(w)
            if not len(first):
                continue
            fixed, tri, tri_first = features(w)
            emit = model.emissions(fixed, tri, tri_first)
            y = label[lot][w.doc]
            # a third of the sentences are spliced to another one
            shuffled = rng.permutation(len(first))
            places, lengths = [], []
            j = 0
            while j < len(shuffled):
                n = 2 if rng.random() < 0.33 and j + 1 < len(shuffled) else 1
                got = [np.arange(first[s], first[s] + length[s]) for s in shuffled[j : j + n]]
                places.extend(got)
                lengths.append(sum(map(len, got)))
                j += n
            place = np.concatenate(places)
            lengths = np.array(lengths)
            expected = np.zeros((k, k))
            p = model.marginals(emit[place], np.cumsum(lengths) - lengths, lengths, expected)
            y = y[place]
            diff = -p
            diff[np.arange(len(y)), y] += 1
            back = np.empty_like(diff)
            back[place] = diff
            grad = np.zeros((SLOTS, k), np.float32)
            tri_word = np.repeat(np.arange(len(fixed)), w.end - w.start)
            for c in range(k):
                g = sum(np.bincount(fixed[:, f], back[:, c], SLOTS) for f in range(fixed.shape[1]))
                grad[:, c] = g + np.bincount(tri, back[tri_word, c], SLOTS)
            grad = grad / max(1.0, len(y) ** 0.5) - 1e-4 * model.weights
            gw += grad * grad
            model.weights += 0.2 * grad / np.sqrt(gw)
            inner = np.ones(len(y), bool)
            inner[np.cumsum(lengths) - lengths] = False
            at = np.flatnonzero(inner)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[at - 1], y[at]), 1)
            g = (seen - expected) / max(1, len(at)) ** 0.5
            gt += g * g
            model.trans += 0.2 * g / np.sqrt(gt)
    return model


def predict(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for rows, raw in text_chunks(batches):
            text = [x.decode().lower() for x in raw]
            w = WordBatch([x.encode() for x in text], "letter")
            share = np.zeros((len(raw), max(1, len(model.langs))))
            if len(w.start) and model.langs:
                first, length = sentences(w)
                p = model.marginals(model.emissions(*features(w)), first, length)
                size = (w.end - w.start).astype(np.float64)
                for c in range(p.shape[1]):
                    share[:, c] = np.bincount(w.doc, p[:, c] * size, len(raw))
            total = share.sum(1)
            ok = np.fromiter((any(map(str.isalpha, x)) for x in text), bool, len(text)) & (total > 0)
            best = share.argmax(1)
            score = np.where(ok, share.max(1) / np.where(total > 0, total, 1), 0.0)
            lang = [model.langs[b] if good else "und" for b, good in zip(best, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(lang, pa.string()), pa.array(np.minimum(score, 1.0))], names=["row", "lang_pred", "score"])

    return run


def training_rows(docs: DataFrame) -> list:
    """At most TRAIN_DOCS labelled texts of each language outside the held-out fold."""
    known = docs.where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return least_hashes(docs, hashed(known), TRAIN_DOCS, "lang")


def identify(docs: DataFrame, columns: list[str], model: Crf | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The named columns of docs, with the language and its score under the given names. The model is fitted on docs where none is given."""
    if model is None:
        rows = training_rows(docs)
        model = fit([r[0] for r in rows], [r[1] for r in rows])
        RollingHash.cache_clear()  # the driver needs its tables for the fit alone
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.struct(*columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.select(F.struct(*columns).alias("row")).schema["row"].dataType.simpleString()
    found = materialize(kept.mapInArrow(predict(lambda: shared.value), f"row {kind}, lang_pred string, score double"))
    shared.destroy()
    return found.select("row.*", F.col("lang_pred").alias(names[0]), F.col("score").alias(names[1]))


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return identify(docs, ["doc_id"]).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
