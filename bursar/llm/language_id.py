"""Language identification by cross-parsing: the language needing fewest phrases per letter wins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bursar.llm.common import built, id_remainder, small_batches, steps

#: Bounds of the labelled sample: documents per language, characters of a document that may be drawn,
#: and characters of a language's learning text.
SAMPLE_DOCS = 48
SAMPLE_DOC_CHARS = 20_000
SAMPLE_CHARS = 60_000
#: Distinct characters that automata tell apart; rarer ones are foreign to every language.
ALPHABET = 256
#: Texts are parsed in blocks of so many normalised characters, side by side.
BLOCK = 256
#: A text with over this many phrases per character in every language is in none of them.
MAX_PHRASE_RATE = 0.75
UNKNOWN = "und"
#: Characters parsed side by side.
STEP_CHARS = 1_000_000


def normalised(text: str) -> np.ndarray:
    """Code points of the lower-cased text: letters as they are, each other run as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return points
    distinct, inverse = np.unique(points, return_inverse=True) if points.max() >= LATIN else (None, None)
    if distinct is None:
        out = _LATIN_LETTERS[points]
    else:
        out = np.array([p if chr(p).isalpha() else 32 for p in distinct.tolist()], np.uint32)[inverse]
    blank = out == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    return out[keep]


LATIN = 0x3000
_LATIN_LETTERS = np.array([p if chr(p).isalpha() else 32 for p in range(LATIN)], np.uint32)


def suffix_automaton(codes: list[int], letters: int) -> np.ndarray:
    """The suffix automaton of ``codes``, completed for cross-parsing.

    Entry [state * letters + code] is 2 * next + cut: along an edge of the automaton the running phrase
    grows; without one the phrase ends (cut 1) and the code starts the next from the root. A code that the
    learning text lacks is a phrase of its own: it leads to one more state, after which all start anew.
    """
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    table = np.empty((len(edges) + 1, letters), np.int32)
    table[:] = 2 * len(edges) + 1
    for c, to in edges[0].items():
        table[:, c] = 2 * to + 1
    for state, out in enumerate(edges):
        for c, to in out.items():
            table[state, c] = 2 * to
    return table.reshape(-1)


class Parser:
    """Automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, list[str]]):
        texts = {k: np.concatenate([np.append(normalised(t), np.uint32(32)) for t in v])[:SAMPLE_CHARS]
                 for k, v in sorted(samples.items())}
        points, counts = np.unique(np.concatenate([*texts.values(), np.array([32], np.uint32)]), return_counts=True)
        self.points = np.sort(points[np.argsort(-counts, kind="stable")[:ALPHABET - 1]])
        self.languages = list(texts)
        self.letters = len(self.points) + 1
        self.tables = [suffix_automaton(self.codes(t).tolist(), self.letters) for t in texts.values()]

    def codes(self, points: np.ndarray) -> np.ndarray:
        """1.. for the alphabet, 0 for all other characters."""
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at + 1, 0).astype(np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language; texts are parsed whole, block by block."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.tables)), np.int64)
        if not sizes.sum():
            return out
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        first = np.cumsum(blocks) - blocks
        grid = np.zeros(int(blocks.sum()) * BLOCK, np.int32)
        codes = self.codes(np.concatenate(texts))
        starts = np.cumsum(sizes) - sizes
        grid[np.arange(len(codes)) + np.repeat(first * BLOCK - starts, sizes)] = codes
        length = np.full(len(owner), BLOCK, np.int64)
        has = sizes > 0
        length[(first + blocks - 1)[has]] = (sizes - (blocks - 1) * BLOCK)[has]
        order = np.argsort(-length, kind="stable")
        columns = np.ascontiguousarray(grid.reshape(-1, BLOCK)[order].T)
        alive = np.searchsorted(-length[order], -np.arange(BLOCK), side="left")
        for k, table in enumerate(self.tables):
            state = np.zeros(len(owner), np.int32)
            count = np.ones(len(owner), np.int64)  # the last phrase of a block has no cut after it
            for t in range(BLOCK):
                n = int(alive[t])
                if not n:
                    break
                step = table[state[:n] * self.letters + columns[t, :n]]
                if t:
                    count[:n] += step & 1
                state[:n] = step >> 1
            out[:, k] = np.bincount(owner[order], weights=count, minlength=len(texts)).astype(np.int64)
        return out


def _predict(model, batches: Iterator[pd.DataFrame], text: str) -> Iterator[pd.DataFrame]:
    """Adds lid_lang, lid_score and lid_rate."""
    parser = built(model.id, lambda: Parser(model.value) if model.value else None)
    for pdf in steps(batches, text, STEP_CHARS):
        texts = [normalised(t) if isinstance(t, str) else np.zeros(0, np.uint32) for t in pdf[text]]
        has_letter = np.array([bool((t != 32).any()) for t in texts])
        lang = np.full(len(pdf), UNKNOWN, object)
        score, rate = np.zeros(len(pdf)), np.full(len(pdf), np.nan)
        if parser and has_letter.any():
            phrases = parser.phrases(texts) / np.maximum([len(t) for t in texts], 1)[:, None]
            best = phrases.argmin(axis=1)
            least = phrases[np.arange(len(pdf)), best]
            others = phrases.copy()
            others[np.arange(len(pdf)), best] = np.inf
            second = others.min(axis=1)
            sure = np.where(np.isinf(second), 1.0, np.clip(1 - least / np.maximum(second, 1e-12), 0, 1) * 0.5 + 0.5)
            lang = np.where(has_letter, np.array(parser.languages, object)[best], UNKNOWN)
            score, rate = np.where(has_letter, sure, 0.0), np.where(has_letter, least, np.nan)
        yield pdf.assign(lid_lang=lang, lid_score=score, lid_rate=rate)


def labelled_sample(documents: DataFrame, modulus: int | None = 3, held_out: int = 1,
                    docs: int = SAMPLE_DOCS, chars: int = SAMPLE_DOC_CHARS) -> dict[str, list[str]]:
    """At most ``docs`` texts per language, the first in the order of a hash of id, up to ``chars`` long each.

    The ranks are bounded before the shuffle, on ids alone; only the chosen rows' texts are fetched.
    """
    rows = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                            & (F.length("text") <= chars) & (F.length("text") > 0))
    if modulus:
        rows = rows.filter(id_remainder("doc_id", modulus) != held_out)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id"))
    chosen = rows.select("lang", "doc_id").withColumn("rank", rank).filter(F.col("rank") <= docs).collect()
    ids = sorted({r.doc_id for r in chosen})
    texts = rows.filter(F.col("doc_id").isin(ids)).select("lang", "doc_id", "text").distinct().collect() if ids else []
    wanted = {(r.lang, r.doc_id) for r in chosen}
    out: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r.lang, str(r.doc_id), r.text)):
        if (r.lang, r.doc_id) in wanted:
            out.setdefault(r.lang, []).append(r.text)
    return out


def identify(documents: DataFrame, samples: dict[str, list[str]], text: str = "text") -> DataFrame:
    """``documents`` with lid_lang, lid_score (0 to 1) and lid_rate (phrases per character).

    Each language's learning text becomes a suffix automaton, along which a text is parsed greedily into
    longest matches: a Ziv-Merhav cross-parsing, whose phrase count per character estimates the cross
    entropy. Texts are parsed whole, in blocks of ``BLOCK`` characters that each start a phrase, all
    blocks of a step side by side. The language with the fewest phrases wins (ties: the first name). The
    score compares it with the runner-up: 0.5 for a tie, towards 1 the clearer it is; 1 with one
    language only. ``und``, score 0 and a null rate for a text that is null or has no letter, or if there is nothing
    to learn from. The broadcast holds at most ``SAMPLE_DOCS`` bounded texts a language. Input columns
    named lid_... are replaced; rows are neither dropped nor joined, so repeated rows stay.
    """
    small_batches(documents)
    base = documents.drop("lid_lang", "lid_score", "lid_rate")
    model = documents.sparkSession.sparkContext.broadcast(samples)
    model_ref = _Model(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInPandas(lambda batches: _predict(model_ref, batches, text),
                            f"{fields}, lid_lang string, lid_score double, lid_rate double")


class _Model:
    """A broadcast with an id to cache what workers build from it."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, ("language_id", uuid.uuid4().hex)

    @property
    def value(self):
        return self.broadcast.value
