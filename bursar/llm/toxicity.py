"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bursar.llm.common import built, id_remainder, small_batches, steps

#: Bounds of the labelled sample: documents per class, characters of a document that may be drawn.
SAMPLE_DOCS = 3000
SAMPLE_DOC_CHARS = 20_000
#: Tokens of a training segment, and segments at most.
SEGMENT = 32
SEGMENTS = 8000
#: Features kept, by strength of association with the label.
FEATURES = 4000
EPOCHS = 60
#: A feature marks a token of a toxic document as toxic if so many toxic documents have it ...
MIN_DOCS = 3
#: ... and they are this share of its documents, the classes weighted to their true sizes.
MIN_SHARE = 0.7
#: Tokens of a block of the forward-backward recursion; blocks of a step run side by side.
BLOCK = 64
MAX_WORDS = 200_000
THRESHOLD = 0.3
#: Characters tagged side by side.
STEP_CHARS = 1_500_000
SPAN_MARGINAL = 0.5
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(word: str) -> list[str]:
    """Of one token: its letters in lower case, and their beginnings."""
    letters = "".join(filter(str.isalpha, word)).lower()
    if not letters:
        return []
    return [f"w:{letters}"] + [f"p:{letters[:k]}" for k in (4, 5, 6, 7) if len(letters) > k]


@dataclass
class Model:
    """Feature weights and bias for the toxic state, transition potentials, and document calibration."""

    weights: dict[str, float]
    bias: float
    potentials: np.ndarray  # [from, to], state 1 is toxic; a text starts as if after a token in state 0
    calibration: np.ndarray  # of 1, log(1 + expected toxic tokens), largest marginal, their share

    def score(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


def marginals(scores: np.ndarray, lengths: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """P(toxic) of each token, by forward-backward over each whole text.

    ``scores`` are the toxic state's log potentials of all texts in a row. Texts are laid out in blocks;
    each block's product of transfer matrices is built token by token for all blocks at once, products
    carry the messages from block to block, and inside a block they are spread again.
    """
    if not len(scores):
        return np.zeros(0)
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    starts = np.cumsum(lengths) - lengths
    total = int(blocks.sum())
    place = np.arange(len(scores)) + np.repeat(first * BLOCK - starts, lengths)
    grid = np.full(total * BLOCK, np.nan)
    grid[place] = np.exp(np.clip(scores, -30, 30))
    emit = np.ascontiguousarray(grid.reshape(total, BLOCK).T)
    real = ~np.isnan(emit)
    emit = np.where(real, emit, 1.0)
    (a, b), (c, d) = potentials.tolist()

    def forward(x0, x1, t):
        y0, y1 = x0 * a + x1 * c, (x0 * b + x1 * d) * emit[t]
        norm = 1 / (y0 + y1)
        return np.where(real[t], y0 * norm, x0), np.where(real[t], y1 * norm, x1)

    # Rows of each block's product, each with its own scale kept as a logarithm.
    rows = []
    for x0, x1 in ((np.ones(total), np.zeros(total)), (np.zeros(total), np.ones(total))):
        scale = np.zeros(total)
        for t in range(BLOCK):
            y0, y1 = x0 * a + x1 * c, (x0 * b + x1 * d) * emit[t]
            norm = y0 + y1
            scale += np.where(real[t], np.log(norm), 0)
            x0, x1 = np.where(real[t], y0 / norm, x0), np.where(real[t], y1 / norm, x1)
        rows.append((x0, x1, scale))
    top = np.maximum(rows[0][2], rows[1][2])
    k0, k1 = np.exp(rows[0][2] - top), np.exp(rows[1][2] - top)
    m00, m01, m10, m11 = rows[0][0] * k0, rows[0][1] * k0, rows[1][0] * k1, rows[1][1] * k1

    before, after = np.empty((total, 2)), np.empty((total, 2))
    order = np.argsort(-blocks, kind="stable")
    most = int(blocks.max())
    alive = np.searchsorted(-blocks[order], -np.arange(most), side="left")
    v = np.tile([1.0, 0.0], (len(lengths), 1))
    u = np.ones((len(lengths), 2))
    for k in range(most):
        on = order[:alive[k]]
        at = first[on] + k
        before[at] = v[on]
        x0, x1 = v[on, 0], v[on, 1]
        y0, y1 = x0 * m00[at] + x1 * m10[at], x0 * m01[at] + x1 * m11[at]
        v[on, 0], v[on, 1] = y0 / (y0 + y1), y1 / (y0 + y1)
        at = first[on] + blocks[on] - 1 - k  # the same number of steps backwards
        after[at] = u[on]
        x0, x1 = u[on, 0], u[on, 1]
        y0, y1 = m00[at] * x0 + m01[at] * x1, m10[at] * x0 + m11[at] * x1
        u[on, 0], u[on, 1] = y0 / (y0 + y1), y1 / (y0 + y1)

    f0, f1 = before[:, 0], before[:, 1]
    odds = np.empty((BLOCK, total))
    for t in range(BLOCK):
        f0, f1 = forward(f0, f1, t)
        odds[t] = f1
    b0, b1 = after[:, 0], after[:, 1]
    for t in range(BLOCK - 1, -1, -1):
        f1 = odds[t]
        p1 = f1 * b1
        odds[t] = p1 / np.maximum((1 - f1) * b0 + p1, 1e-300)
        e1 = emit[t] * b1
        y0, y1 = a * b0 + b * e1, c * b0 + d * e1
        norm = y0 + y1
        b0, b1 = np.where(real[t], y0 / norm, b0), np.where(real[t], y1 / norm, b1)
    return odds.T.reshape(-1)[place]


def labelled_sample(documents: DataFrame, labels: DataFrame, modulus: int | None = 4, held_out: int = 2,
                    docs: int = SAMPLE_DOCS, chars: int = SAMPLE_DOC_CHARS) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most ``docs`` (text, toxic) per class, the first in the order of a hash of id; labelled rows per class.

    A document with several labels is toxic if one of them says so. Ranks are bounded before the shuffle,
    on ids alone; only the chosen rows' texts are fetched.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null")
    if modulus:
        known = known.filter(id_remainder("doc_id", modulus) != held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = documents.filter((F.length("text") <= chars) & (F.length("text") > 0)).select("doc_id", "text")
    ids = known.join(rows.select("doc_id").distinct(), "doc_id")
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id"))
    chosen = {r.doc_id: r.toxic for r in ids.withColumn("rank", rank).filter(F.col("rank") <= docs).collect()}
    totals = {r.toxic: r["count"] for r in ids.groupBy("toxic").count().collect()}
    if not chosen:
        return [], totals
    wanted = documents.sparkSession.createDataFrame(  # bounded by docs and two classes
        [(i,) for i in chosen], f"doc_id {documents.schema['doc_id'].dataType.simpleString()}")
    texts = rows.join(F.broadcast(wanted), "doc_id").collect()
    return sorted((r.text, chosen[r.doc_id]) for r in texts), totals


def fit(sample: list[tuple[str, int]], totals: dict[int, int], seed: int = 5) -> Model | None:
    """The field and its calibration from labelled documents; None without documents of both classes.

    Tokens are labelled first: in a toxic document, those with a feature that nearly only toxic documents
    have. The field is then trained on segments of labelled tokens by gradient ascent on the conditional
    likelihood (expected minus observed counts by forward-backward), and documents are calibrated by
    logistic regression on their marginals, weighted to the classes' true sizes.
    """
    if len({y for _, y in sample}) < 2:
        return None
    docs = {c: [text for text, y in sample if y == c] for c in (0, 1)}
    of_text = lambda text: {f for w in set(WORD.findall(text)) for f in features(w)}
    toxic: Counter = Counter()
    for text in docs[1]:
        toxic.update(of_text(text))
    toxic = Counter({f: n for f, n in toxic.items() if n >= MIN_DOCS})
    clean: Counter = Counter()
    for text in docs[0]:
        clean.update(of_text(text) & toxic.keys())
    true = {c: totals.get(c, 1) / len(docs[c]) for c in (0, 1)}  # rows of the class that a sampled one stands for
    share = {f: n * true[1] / (n * true[1] + (clean[f] + 0.25) * true[0]) for f, n in toxic.items()}
    marks = {f for f, s in share.items() if s >= MIN_SHARE}
    strength = sorted(share, key=lambda f: (f not in marks, -abs(share[f] - 0.5) * np.log1p(toxic[f] + clean[f]), f))
    index = {f: k for k, f in enumerate(strength[:FEATURES])}

    rng = np.random.default_rng(seed)
    marked, plain, seen = [], [], 0  # of the plain segments a uniform sample
    for text, y in sample:
        words = WORD.findall(text)
        for k in range(0, len(words), SEGMENT):
            part = words[k:k + SEGMENT]
            tags = [int(y == 1 and not marks.isdisjoint(features(w))) for w in part]
            if any(tags):
                marked.append((part, tags))
            elif y == 0 or rng.random() < 0.3:
                seen += 1
                at = len(plain) if len(plain) < SEGMENTS // 2 else int(rng.integers(seen))
                if at < SEGMENTS // 2:
                    plain[at:at + 1] = [(part, tags)]
    if not marked:
        weights, bias, potentials = {}, -6.0, np.ones((2, 2))
    else:
        pick = lambda x: [x[k] for k in sorted(rng.permutation(len(x))[:SEGMENTS // 2])]
        chosen = [([features(w) for w in part], tags) for part, tags in pick(marked) + plain]
        weights, bias, potentials = _train(chosen, index)
    model = Model(weights, bias, potentials, np.zeros(4))

    facts = document_facts(model, [t for t, _ in sample])
    y = np.array([t for _, t in sample], float)
    w = np.where(y == 1, true[1], true[0])
    w = w / w.mean()
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-facts @ beta))
        hess = (facts * (w * p * (1 - p))[:, None]).T @ facts + 0.5 * np.eye(4)
        beta += np.linalg.solve(hess, facts.T @ (w * (y - p)) - 0.5 * beta)
    model.calibration = beta
    return model


def _train(segments: list, index: dict[str, int]) -> tuple[dict[str, float], float, np.ndarray]:
    lengths = np.array([len(p) for p, _ in segments])
    tags = np.concatenate([t for _, t in segments])
    token_of, feature_of = [], []
    at = 0
    for part, _ in segments:
        for w in part:
            for f in w:
                if f in index:
                    token_of.append(at)
                    feature_of.append(index[f])
            at += 1
    token_of, feature_of = np.array(token_of, np.int64), np.array(feature_of, np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    previous = np.concatenate([[0], tags[:-1]])
    previous[starts] = 0
    observed = np.array([[((previous == i) & (tags == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    theta = np.zeros(len(index) + 5)  # features, bias, transitions
    theta[len(index)] = -3
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    # Segments are padded to one length to run side by side.
    grid = np.full((len(lengths), SEGMENT), -1, np.int64)
    for k, (s, n) in enumerate(zip(starts, lengths)):
        grid[k, :n] = np.arange(s, s + n)
    for step in range(1, EPOCHS + 1):
        scores = np.bincount(token_of, weights=theta[feature_of], minlength=len(tags)) + theta[len(index)]
        trans = np.exp(theta[len(index) + 1:].reshape(2, 2))
        alpha = np.zeros((SEGMENT, len(lengths), 2))
        prior = np.tile([1.0, 0.0], (len(lengths), 1))
        emit = np.where(grid >= 0, np.exp(np.clip(scores[grid], -30, 30)), 1.0)
        for t in range(SEGMENT):
            x = prior @ trans
            x[:, 1] *= emit[:, t]
            x /= x.sum(1, keepdims=True)
            prior = np.where((grid[:, t] >= 0)[:, None], x, prior)
            alpha[t] = prior
        beta = np.ones((len(lengths), 2))
        expected, p_toxic = np.zeros((2, 2)), np.zeros(len(tags))
        for t in range(SEGMENT - 1, -1, -1):
            on = grid[:, t] >= 0
            come = alpha[t - 1] if t else np.tile([1.0, 0.0], (len(lengths), 1))
            out = beta.copy()
            out[:, 1] *= emit[:, t]
            joint = come[:, :, None] * trans[None] * out[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            expected += joint[on].sum(0)
            p_toxic[grid[on, t]] = joint[on][:, :, 1].sum(1)
            back = out @ trans.T
            beta = np.where(on[:, None], back / back.sum(1, keepdims=True), beta)
        error = tags - p_toxic
        grad = np.concatenate([np.bincount(feature_of, weights=error[token_of], minlength=len(index)),
                               [error.sum()], (observed - expected).reshape(-1)])
        grad = grad / len(lengths) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return ({f: float(theta[k]) for f, k in index.items()}, float(theta[len(index)]),
            np.exp(theta[len(index) + 1:].reshape(2, 2)))


class _Words(dict):
    """Scores of recent words."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= MAX_WORDS:
            self.clear()
        score = self[word] = self.model.score(word)
        return score


def token_marginals(model: Model, words: _Words, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    split_texts = [WORD.findall(t) for t in texts]
    lengths = np.array([len(x) for x in split_texts], np.int64)
    look = words.__getitem__
    scores = np.fromiter((s for x in split_texts for s in map(look, x)), float, int(lengths.sum()))
    return marginals(scores, lengths, model.potentials), lengths


def _facts(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(lengths)), lengths)
    expected = np.bincount(owner, weights=p, minlength=len(lengths))
    largest = np.zeros(len(lengths))
    if len(p):
        has = lengths > 0
        largest[has] = np.maximum.reduceat(p, (np.cumsum(lengths) - lengths)[has])
    return np.stack([np.ones(len(lengths)), np.log1p(expected), largest,
                     expected / np.maximum(lengths, 1)], axis=1)


def document_facts(model: Model, texts: list[str]) -> np.ndarray:
    words = _Words(model)
    return np.concatenate([_facts(*token_marginals(model, words, texts[k:k + 200])) for k in range(0, len(texts), 200)])


def tag(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``documents`` with tox_score (0 to 1) and tox_spans: start and end (characters) and marginal.

    Every token of the whole text gets the marginal of the toxic state; runs above one half are spans. The
    score is the calibrated probability that the document is labelled toxic. Null and empty texts have no
    spans and the score of a text without toxic tokens; without a model all scores are 0. Input columns
    named tox_... are replaced; repeated rows stay. The broadcast model has at most ``FEATURES`` weights.
    """
    small_batches(documents)
    base = documents.drop("tox_score", "tox_spans")
    sent = documents.sparkSession.sparkContext.broadcast(model)
    key = "toxicity", uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        words = built(key, lambda: _Words(model)) if model else None
        for pdf in steps(batches, text, STEP_CHARS):
            texts = [t if isinstance(t, str) else "" for t in pdf[text]]
            spans: list[list[dict]] = [[] for _ in texts]
            score = np.zeros(len(texts))
            if model:
                p, lengths = token_marginals(model, words, texts)
                score = 1 / (1 + np.exp(-_facts(p, lengths) @ model.calibration))
                starts = np.cumsum(lengths) - lengths
                hot = p >= SPAN_MARGINAL
                for k in np.unique(np.searchsorted(starts, np.flatnonzero(hot), side="right") - 1):
                    spans[k] = _spans(texts[k], p[starts[k]:starts[k] + lengths[k]])
            yield pdf.assign(tox_score=score, tox_spans=spans)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInPandas(run, f"{fields}, tox_score double, "
                                 "tox_spans array<struct<start:int,end:int,marginal:double>>")


def _spans(text: str, p: np.ndarray) -> list[dict]:
    out: list[dict] = []
    last = -2
    for k, (word, q) in enumerate(zip(WORD.finditer(text), p.tolist())):
        if q >= SPAN_MARGINAL:
            if last == k - 1:
                out[-1] |= {"end": word.end(), "marginal": max(out[-1]["marginal"], q)}
            else:
                out.append({"start": word.start(), "end": word.end(), "marginal": q})
            last = k
    return out
