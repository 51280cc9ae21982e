"""A gated recurrent language model over words: numpy inside tasks, corpus statistics and rounds by Spark."""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bursar.llm.common import built, cut, id_remainder, small_batches, steps
from bursar.llm.quality import cell

#: Words with an output of their own, in classes of equal size; the last of them all is the end.
CLASSES = 32
CLASS_WORDS = 32
VOCABULARY = CLASSES * CLASS_WORDS - 1
#: Classes of all other words, by their last two characters.
RARE_CLASSES = 32
HIDDEN = 16
#: Words whose corpus counts every task holds; the counts of the others are joined.
HEAD_WORDS = 100_000
#: Backpropagation is truncated to windows of WINDOW tokens of LANES texts side by side.
WINDOW = 16
LANES = 512
#: The warm start has fewer lanes, so that its few texts make more steps.
WARM_LANES = 64
#: The state is carried across windows up to this length in training (and without limit in scoring).
SEGMENT = 1024
#: Before the round over all documents, weights start from a pass over so many documents at most.
WARM_DOCS = 400
WARM_PASSES = 3
RATE = 0.006
#: Distinct words a task counts before it hands them on.
PARTIAL_WORDS = 300_000
#: Characters of texts that are scored side by side.
SCORE_CHARS = 8_000_000
#: Characters that a text counts for beside its own, so that short and null texts are bounded in number.
TEXT_CHARS = 500
OUTPUT_ROWS = 16_384
#: Rows of class probabilities that are made at a time.
OUTPUT_BLOCK = 1024
MAX_CODES = 200_000
WORDS = CLASSES * CLASS_WORDS
END = WORDS - 1


def words_of(text: str) -> list[bytes]:
    """Words parted by ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def rare_class(word: bytes) -> int:
    last = word[-2:]
    if last.isascii():  # then these two bytes are the last two characters
        return zlib.crc32(last) % RARE_CLASSES
    return zlib.crc32(word.decode("utf-8", "surrogatepass")[-2:].encode("utf-8", "surrogatepass")) % RARE_CLASSES


class Codes(dict):
    """Word to number: of one of ``words`` its place, of any other -1 minus its rare class."""

    def __init__(self, words: list[str]):
        super().__init__()
        self.own = {w.encode("utf-8", "surrogatepass"): k for k, w in enumerate(words)}
        self.update(self.own)
        self.most = len(self.own) + MAX_CODES
        codes = [k if k < VOCABULARY else WORDS + rare_class(w) for w, k in self.own.items()]
        # Indexed by the number: codes of the words, then, from the end, those of the rare classes.
        self.codes = np.array(codes + list(range(WORDS + RARE_CLASSES - 1, WORDS - 1, -1)), np.int32)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.own)
        number = self[word] = -1 - rare_class(word)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def of(self, words: list[bytes]) -> np.ndarray:
        """Codes: below VOCABULARY a word's own, from WORDS on its rare class; the end comes last."""
        return np.append(self.codes[self.numbers(words)], np.int32(END))


Weights = dict[str, np.ndarray]


def initial(word_counts: np.ndarray, rare_counts: np.ndarray, seed: int = 3) -> Weights:
    """Small random weights; output biases are the corpus statistics, so training starts at unigrams."""
    rng = np.random.default_rng(seed)
    own = np.log(word_counts.reshape(CLASSES, CLASS_WORDS) + 1e-3)
    mass = np.concatenate([word_counts.reshape(CLASSES, CLASS_WORDS).sum(1), rare_counts]) + 1e-3
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {"inputs": small(WORDS + RARE_CLASSES, 3 * HIDDEN), "state": small(HIDDEN, 3 * HIDDEN),
            "classes": small(HIDDEN, CLASSES + RARE_CLASSES), "class_bias": np.log(mass / mass.sum()).astype(np.float32),
            "words": small(CLASSES, HIDDEN, CLASS_WORDS), "word_bias": own.astype(np.float32)}


def by_gate(x: np.ndarray) -> np.ndarray:
    """Rows of three gates side by side as [gate, row, HIDDEN]: the rows of a gate lie together."""
    return np.ascontiguousarray(x.reshape(len(x), 3, HIDDEN).swapaxes(0, 1))


def gates(x: np.ndarray, state: np.ndarray, h: np.ndarray):
    """The next state from the input's contribution ``x`` and the last state."""
    return gate_step(by_gate(x), by_gate(state), h)


def gate_step(x: np.ndarray, state: np.ndarray, h: np.ndarray):
    """As ``gates``, of arrays by gate."""
    u = h @ state
    zr, un = u[:2], u[2]
    zr += x[:2]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r = zr
    n = r * un
    n += x[2]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, (z, r, n, un)


def _exponentials(logits: np.ndarray, every: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logits at ``at``; exp of all takes their place. They stay far below the bound in a trained net."""
    if logits.max() > 60:
        np.minimum(logits, np.float32(60), out=logits)
    picked = logits[every, at]
    np.exp(logits, out=logits)
    return picked


def output(w: Weights, h: np.ndarray, code: np.ndarray, learn: bool):
    """Natural log probability of each code after state ``h``: its class, then the word in the class.

    For a code of a rare class it is the class's alone. With ``learn`` also the gradients.
    """
    cls = np.where(code < WORDS, code // CLASS_WORDS, code - WORDS + CLASSES)
    every = np.arange(len(code))
    logp, dh, grads = np.empty(len(code), h.dtype), np.empty_like(h) if learn else None, {}
    # Few rows at a time, so that they stay in the processor's cache; only gradients need them all.
    p = np.empty((len(code) if learn else min(len(code), OUTPUT_BLOCK), CLASSES + RARE_CLASSES), h.dtype)
    for a in range(0, len(code), OUTPUT_BLOCK):
        b = min(a + OUTPUT_BLOCK, len(code))
        part, these, at = p[a:b] if learn else p[:b - a], every[:b - a], cls[a:b]
        np.matmul(h[a:b], w["classes"], out=part)
        part += w["class_bias"]
        gained = _exponentials(part, these, at)
        total = part.sum(axis=1)
        logp[a:b] = gained - np.log(total)
        if learn:
            part /= total[:, None]
            part[these, at] -= 1
            np.matmul(part, w["classes"].T, out=dh[a:b])
    if learn:
        grads = {"classes": h.T @ p, "class_bias": p.sum(0), "words": np.zeros_like(w["words"]),
                 "word_bias": np.zeros_like(w["word_bias"])}
    # In the order of classes (sorted as 16-bit numbers, by radix), so that a class's rows lie together.
    order = np.argsort(cls.astype(np.int16), kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
    order = order[:bounds[-1]]
    states, places, gained = h[order], code[order] % CLASS_WORDS, np.empty(len(order), logp.dtype)
    back = np.empty_like(states) if learn else None
    for c in range(CLASSES):
        a, b = bounds[c], bounds[c + 1]
        if a == b:
            continue
        at, state, these = places[a:b], states[a:b], every[:b - a]
        q = state @ w["words"][c]
        q += w["word_bias"][c]
        picked = _exponentials(q, these, at)
        total = q.sum(axis=1)
        gained[a:b] = picked - np.log(total)
        if learn:
            q /= total[:, None]
            q[these, at] -= 1
            grads["words"][c] = state.T @ q
            grads["word_bias"][c] = q.sum(0)
            np.matmul(q, w["words"][c].T, out=back[a:b])
    logp[order] += gained
    if learn:
        dh[order] += back
    return logp, grads, dh


def window_gradients(w: Weights, codes: np.ndarray, real: np.ndarray, fresh: np.ndarray, h: np.ndarray):
    """Loss gradients over one window [time, lane], truncated at its start; also the state after it.

    ``fresh`` marks the first token of a text, before which the state is zero; rows with ``real`` false
    are padding. Returns (sum of log probabilities, gradients, state).
    """
    span, lanes = codes.shape
    x, state = np.take(by_gate(w["inputs"]), codes, axis=1), by_gate(w["state"])
    before, saved = np.empty((span, lanes, HIDDEN), x.dtype), []
    whole, starts = real.all(axis=1), fresh.any(axis=1)
    for t in range(span):
        if starts[t]:
            h = np.where(fresh[t][:, None], np.float32(0), h)
        before[t] = h
        new, parts = gate_step(x[:, t], state, h)
        saved.append(parts)
        h = new if whole[t] else np.where(real[t][:, None], new, h)
    flat = real.reshape(-1)
    every = bool(whole.all())
    only = (lambda rows: rows) if every else (lambda rows: rows[flat])
    logp, grads, out = output(w, only(before.reshape(-1, HIDDEN)), only(codes.reshape(-1)), True)
    if every:
        from_output = out
    else:
        from_output = np.zeros((span * lanes, HIDDEN), x.dtype)
        from_output[flat] = out
    from_output = from_output.reshape(span, lanes, HIDDEN)
    dx, du = np.empty((span, lanes, 3 * HIDDEN), x.dtype), np.empty((span, lanes, 3 * HIDDEN), x.dtype)
    gate = np.empty((3, lanes, HIDDEN), x.dtype)
    dh = np.zeros((lanes, HIDDEN), x.dtype)
    back = np.ascontiguousarray(w["state"].T)
    for t in range(span - 1, -1, -1):
        z, r, n, un = saved[t]
        d = dh if whole[t] else dh * real[t][:, None]
        dz = d * z
        dn = (d - dz) * (1 - n * n)
        np.multiply(dz * (1 - z), before[t] - n, out=gate[0])
        np.multiply(dn, r, out=gate[2])
        np.multiply(gate[2] * un, 1 - r, out=gate[1])
        to = du[t]
        to.reshape(lanes, 3, HIDDEN)[:] = gate.swapaxes(0, 1)
        dx[t, :, 2 * HIDDEN:] = dn
        past = to @ back
        past += dz
        dh = (past if whole[t] else np.where(real[t][:, None], past, dh)) + from_output[t]
        if starts[t]:
            dh = np.where(fresh[t][:, None], np.float32(0), dh)
    dx[:, :, :2 * HIDDEN] = du[:, :, :2 * HIDDEN]
    d_state = before.reshape(-1, HIDDEN).T @ du.reshape(-1, 3 * HIDDEN)
    codes_flat, dx = only(codes.reshape(-1)), only(dx.reshape(-1, 3 * HIDDEN))
    order = np.argsort(codes_flat.astype(np.int16), kind="stable")
    in_order = codes_flat[order]
    starts = np.flatnonzero(np.diff(in_order, prepend=-1))
    grads["inputs"] = np.zeros_like(w["inputs"])
    if len(starts):
        pairs = dx[order].view(np.result_type(dx, 1j))  # two numbers are added at once
        grads["inputs"][in_order[starts]] = np.add.reduceat(pairs, starts).view(dx.dtype)
    grads["state"] = d_state
    return float(logp.sum()), grads, h


class Trainer:
    """Adam over windows of lanes."""

    def __init__(self, weights: Weights, rate: float = RATE, lanes: int = LANES):
        self.lanes = lanes
        self.w = {k: v.copy() for k, v in weights.items()}
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}
        self.rate, self.steps, self.tokens, self.logp = rate, 0, 0, 0.0

    def learn(self, texts: list[np.ndarray]) -> None:
        """One pass over coded texts: segments are dealt to lanes, and lanes advance window by window."""
        parts = [x[k:k + SEGMENT] for x in texts for k in range(0, len(x), SEGMENT)]
        lanes: list[list[np.ndarray]] = [[] for _ in range(min(self.lanes, max(1, len(parts))))]
        size = np.zeros(len(lanes), np.int64)
        for k in np.argsort([-len(p) for p in parts], kind="stable"):
            lane = int(size.argmin())
            lanes[lane].append(parts[k])
            size[lane] += len(parts[k])
        if not size.sum():
            return
        codes = np.zeros((int(size.max()), len(lanes)), np.int32)
        real, fresh = np.zeros(codes.shape, bool), np.zeros(codes.shape, bool)
        for lane, held in enumerate(lanes):
            at = 0
            for p in held:
                codes[at:at + len(p), lane] = p
                fresh[at, lane] = True
                at += len(p)
            real[:at, lane] = True
        h = np.zeros((len(lanes), HIDDEN), np.float32)
        for t in range(0, len(codes), WINDOW):
            logp, grads, h = window_gradients(self.w, codes[t:t + WINDOW], real[t:t + WINDOW], fresh[t:t + WINDOW], h)
            n = int(real[t:t + WINDOW].sum())
            self.tokens, self.logp = self.tokens + n, self.logp + logp
            self._update(grads, n)

    def _update(self, grads: Weights, n: int) -> None:
        self.steps += 1
        rate = self.rate * min(1.0, self.steps / 20) * (0.3 + 0.7 / (1 + self.steps / 1500))
        fix = np.sqrt(1 - 0.99 ** self.steps) / (1 - 0.9 ** self.steps)
        for k, g in grads.items():
            g *= np.float32(1 / max(n, 1))
            m, v = self.m[k], self.v[k]
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            self.w[k] -= np.float32(rate * fix) * m / (np.sqrt(v) + np.float32(1e-7))


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over whole texts: counted inside tasks, then summed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode("utf-8", "surrogatepass") for w in seen], "n": list(seen.values())})

        for pdf in batches:
            for t in pdf[text]:
                if t:
                    seen.update(words_of(t))
                if len(seen) >= PARTIAL_WORDS:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    return documents.select(text).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Statistics:
    """What the corpus counts say: bounded by VOCABULARY, HEAD_WORDS and RARE_CLASSES."""

    vocabulary: list[str]
    head: dict[str, int]
    rare_mass: np.ndarray  # tokens per rare class
    rare_types: np.ndarray  # distinct words per rare class
    tokens: int  # with one end per text
    distinct: int  # with the end
    ends: int


def statistics(counts: DataFrame, texts: int) -> Statistics:
    # The head is all words from a count on: the least of a bounded list of counts at which they are few enough.
    fewest, above = None, 0
    for r in sorted(counts.groupBy(cell("n").alias("cell")).agg(F.count("*").alias("words")).collect(), reverse=True):
        above += r.words
        if above > HEAD_WORDS:
            break
        fewest = r.cell
    found = counts.filter(F.col("n") >= fewest).collect() if fewest is not None else []
    head = sorted(((r.word, r.n) for r in found), key=lambda x: (-x[1], x[0].encode("utf-8", "surrogatepass")))
    vocabulary = [w for w, _ in head[:VOCABULARY]]
    mass, types = np.zeros(RARE_CLASSES), np.zeros(RARE_CLASSES)
    total = distinct = 0
    last = head[len(vocabulary) - 1] if head else ("", 1 << 62)
    if texts:
        rare = (F.col("n") < last[1]) | ((F.col("n") == last[1]) & (F.col("word") > last[0]))
        of = F.when(rare, F.crc32(F.right("word", F.lit(2)).cast("binary")) % RARE_CLASSES).otherwise(-1)
        for r in counts.groupBy(of.alias("class")).agg(F.sum("n").alias("mass"), F.count("*").alias("types")).collect():
            total, distinct = total + r.mass, distinct + r.types
            if r["class"] >= 0:
                mass[r["class"]], types[r["class"]] = r.mass, r.types
    return Statistics(vocabulary, dict(head), mass, types, total + texts, distinct + (texts > 0), texts)


def _flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in sorted(w)])


def _shaped(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def train(training: DataFrame, stats: Statistics, text: str = "text") -> Weights:
    """Weights after a warm start on few documents and one round over all of them.

    In the round every partition goes on from the same weights over all its documents; the results are
    averaged, weighted by tokens. Sums are formed in two steps of groups of bounded size, and the driver
    gets one set of weights.
    """
    spark = training.sparkSession
    counts = np.zeros(WORDS)
    for k, w in enumerate(stats.vocabulary):
        counts[k] = stats.head[w]
    counts[END] = stats.ends
    weights = initial(counts, stats.rare_mass)
    # Ids first: a sorted limit sends its rows from every task.
    short = training.filter((F.length(text) <= 20_000) & F.col("doc_id").isNotNull())
    ids = [r.doc_id for r in short.select("doc_id").orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(WARM_DOCS).collect()]
    few = short.filter(F.col("doc_id").isin(ids)).dropDuplicates(["doc_id"]).select("doc_id", text).collect() if ids else []
    codes, warm = Codes(stats.vocabulary), Trainer(weights, lanes=WARM_LANES)
    texts = [codes.of(words_of(r[text])) for r in sorted(few, key=lambda r: ids.index(r.doc_id))]
    for _ in range(WARM_PASSES):
        warm.learn(texts)
    # Frequent words beyond the vocabulary, whose codes are those of their rare classes, are looked up too.
    sent = spark.sparkContext.broadcast((warm.w, list(stats.head)))
    chunk, key = 4096, ("language_model training", uuid.uuid4().hex)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, codes = built(key, lambda: (sent.value[0], Codes(sent.value[1])))
        trainer = Trainer(start, RATE / 2)
        for pdf in steps(batches, text):
            trainer.learn([codes.of(words_of(t) if isinstance(t, str) else []) for t in pdf[text]])
        if trainer.tokens:
            flat = _flat(trainer.w).astype(np.float64) * trainer.tokens
            part = TaskContext.get().partitionId() % 64
            yield pd.DataFrame({"part": part, "chunk": np.arange(0, len(flat), chunk) // chunk, "tokens": trainer.tokens,
                                "total": [flat[k:k + chunk].astype(np.float32).tobytes()
                                          for k in range(0, len(flat), chunk)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["total"].iloc[0]) // 4)
        for b in pdf["total"]:
            total += np.frombuffer(b, np.float32)
        return pd.DataFrame({"part": [0], "chunk": [pdf["chunk"].iloc[0]], "tokens": [pdf["tokens"].sum()],
                             "total": [total.astype(np.float32).tobytes()]})

    schema = "part int, chunk int, tokens long, total binary"
    sums = (training.select(text).mapInPandas(learn, schema)
            .groupBy("part", "chunk").applyInPandas(add, schema).groupBy("chunk").applyInPandas(add, schema)
            .orderBy("chunk").collect())
    if not sums:
        return warm.w
    return _shaped(np.concatenate([np.frombuffer(r.total, np.float32) / r.tokens for r in sums]), weights)


def gathered(parts: Iterator[pd.DataFrame], column: str, chars: int) -> Iterator[list[pd.DataFrame]]:
    """Lists of parts one after another, as long as these count for ``chars`` characters at most."""
    held, size = [], 0
    for pdf in parts:
        more = int(pdf[column].str.len().sum()) + TEXT_CHARS * len(pdf)
        if held and size + more > chars:
            yield held
            held, size = [], 0
        held.append(pdf)
        size += more
    if held:
        yield held


def text_log_probabilities(w: Weights, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log of each coded text's probability (rare words: of their classes).

    All texts advance together, longest first, so that those still running are always the first rows; the
    state is carried from window to window over the whole text.
    """
    out = np.zeros(len(texts))
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    flat = np.concatenate([texts[k] for k in order]) if len(texts) else np.zeros(0, np.int32)
    starts = np.cumsum(lengths) - lengths
    inputs, state = by_gate(w["inputs"]), by_gate(w["state"])
    h = np.zeros((len(texts), HIDDEN), np.float32)
    states, targets, owners, held = [], [], [], 0
    ends = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left").tolist()

    def settle() -> None:
        logp, _, _ = output(w, np.concatenate(states), np.concatenate(targets), False)
        out[:] += np.bincount(np.concatenate(owners), logp.astype(float), len(out))
        states.clear(), targets.clear(), owners.clear()

    for t, n in enumerate(ends):
        code = flat[starts[:n] + t]
        states.append(h[:n])
        targets.append(code)
        owners.append(order[:n])
        held += n
        h, _ = gate_step(np.take(inputs, code, axis=1), state, h[:n])
        if held >= OUTPUT_ROWS:
            settle()
            held = 0
    if held:
        settle()
    return out


def score(documents: DataFrame, counts: DataFrame, stats: Statistics, weights: Weights,
          text: str = "text") -> DataFrame:
    """doc_id, lm_tokens, lm_known, lm_base and lm_score: one row per row of ``documents``.

    lm_score is the model's log10 probability of the whole text and its end: the recurrent net gives the
    probability of each word or, for a word without an output of its own, of its rare class, within which
    the word has (c + 1) / (class tokens + class words + 1). lm_base is the sum of log10((c + 1) / (N + V + 1)).
    Counts of the most frequent words, ``HEAD_WORDS`` at most, are held by every task; a text's other words are
    joined to the counts (their counts are small, so no key is hot) and summed per text. Null and empty
    texts consist of the end alone. Repeated rows are scored one by one.
    """
    spark = documents.sparkSession
    if not stats.tokens:
        stats = Statistics([], {}, stats.rare_mass, stats.rare_types, 0, 0, 0)
    sent = spark.sparkContext.broadcast((weights, stats))
    key = "language_model", uuid.uuid4().hex

    def load() -> tuple:
        w, s = sent.value
        return w, s, Codes(list(s.head)), np.log10(np.array([*s.head.values(), *[0] * RARE_CLASSES]) + 1)

    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, s, codes, log_count = built(key, load)
        within = np.log10(s.rare_mass + s.rare_types + 1)
        end = float(np.log10(s.ends + 1))
        row = TaskContext.get().partitionId() << 40
        for parts in gathered(steps(batches, text, SCORE_CHARS), text, SCORE_CHARS):
            coded, known, base, extra, tails, sizes = [], [], [], [], [], []
            for t in chain.from_iterable(pdf[text] for pdf in parts):
                words = words_of(t) if isinstance(t, str) else []
                number = codes.numbers(words)
                code, logs = np.append(codes.codes[number], np.int32(END)), log_count[number]
                tail = [words[k].decode("utf-8", "surrogatepass") for k in np.flatnonzero(number < 0)]
                rare = code[:-1] >= WORDS
                coded.append(code)
                sizes.append(len(code))
                known.append(len(words) - len(tail) + (s.ends > 0))
                base.append(float(logs.sum()) + end)
                extra.append(float(logs[rare].sum() - within[code[:-1][rare] - WORDS].sum()))
                tails.append(tail)
            net = text_log_probabilities(w, coded) / np.log(10) + np.array(extra)
            at = 0
            for pdf in parts:  # by itself, as ids have another type in a part with nulls
                of = slice(at, at + len(pdf))
                yield pd.DataFrame({"row": np.arange(row + of.start, row + of.stop), "doc_id": pdf["doc_id"].to_numpy(),
                                    "lm_tokens": sizes[of], "known": known[of], "base": base[of], "net": net[of],
                                    "tail": tails[of]})
                at = of.stop
            row += at

    rows = cut(documents.select("doc_id", text).mapInPandas(
        run, f"row long, doc_id {id_type}, lm_tokens long, known long, base double, net double, tail array<string>"))
    tail = (rows.select("row", F.explode("tail").alias("word")).join(counts, "word")
            .groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("tail_log"), F.count("*").alias("tail_known")))
    every = float(np.log10(stats.tokens + stats.distinct + 1))
    return (rows.drop("tail").join(tail, "row", "left").select(
        "doc_id", "lm_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("lm_known"),
        (F.col("base") + F.coalesce("tail_log", F.lit(0.0)) - F.col("lm_tokens") * F.lit(every)).alias("lm_base"),
        (F.col("net") + F.coalesce("tail_log", F.lit(0.0))).alias("lm_score")))


def learn_and_score(documents: DataFrame, modulus: int = 7, held_out: int = 2) -> tuple[DataFrame, Statistics]:
    """The scores of all rows by a model learnt from those whose id is not held out, and its statistics."""
    small_batches(documents)
    training = documents.select("doc_id", "text").filter(id_remainder("doc_id", modulus) != held_out)
    counts = cut(word_counts(training))
    stats = statistics(counts, training.count())
    return score(documents, counts, stats, train(training, stats)), stats
