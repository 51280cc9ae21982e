"""Packing of token sequences by vector bin packing: the dot-product heuristic under several limits at once."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from bursar.llm.common import aside, built, small_batches, steps

#: Limits of a sequence: tokens, segments (pieces of examples), tokens that bear a loss.
TOKENS, SEGMENTS, LOSS = 2048, 128, 2048
#: Tokens of a lot, the examples that are packed together: bounds the memory of a task, which packs lot by lot.
LOT_TOKENS = 1_000_000
#: Parts of words whose ids a task remembers.
CACHED_PARTS = 400_000


#: Texts of these characters alone fall into parts that are tokenized one by one (fixed values: the vocabulary's own
#: pattern, for letters that lower-casing and the normal form treat one by one). In other texts this holds word by word.
_PLAIN = re.compile("[\x09-\x0d\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff\x09-\x0d\x20]+")
_SPACE = re.compile("[\x09-\x0d\x20]+")
#: The vocabulary writes printable bytes as the characters of these codes, the others as those from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
#: Characters of a text that are parted at once; a longer text is cut at white space.
SLICE = 1_000_000


class Words:
    """Ids of texts as little-endian unsigned 32-bit integers, by way of a memory of the parts of their words.

    The tokenizer's pattern never crosses white space, and neither do its normal form and lower-casing, so a
    text's ids are those of its words in a row; a plain word's are those of its letters, digits and signs in a row.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings are ordinary text
        self.model = self.library.model
        self.known: dict[str, bytes] = {}

    def _parts(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _PARTS.findall(text.lower())
        out: list[str] = []
        for word in _SPACE.split(text):
            out += _PARTS.findall(word.lower()) if _PLAIN.fullmatch(word) else [word]
        return out

    def _encoded(self, part: str) -> bytes:
        if _PLAIN.fullmatch(part):  # in lower case and in one part already, so the merges alone remain
            ids = [t.id for t in self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_WRITTEN))]
        else:
            ids = self.library.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids_of(self, texts: list[str]) -> list[bytes]:
        split = [self._parts(t) for t in texts]
        new = list(set().union(*split).difference(self.known))
        if len(self.known) + len(new) > CACHED_PARTS:
            self.known.clear()
            new = list(set().union(*split))
        for part in new:
            self.known[part] = self._encoded(part)
        get = self.known.__getitem__
        return [b"".join(map(get, parts)) for parts in split]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out = self._ids_of([t if t and len(t) <= SLICE else "" for t in texts])
        for k, text in enumerate(texts):
            if text and len(text) > SLICE:
                cuts = [0]
                while len(text) - cuts[-1] > SLICE:
                    space = _SPACE.search(text, cuts[-1] + SLICE)
                    cuts.append(space.end() if space else len(text))
                out[k] = b"".join(self._ids_of([text[a:b]])[0] for a, b in zip(cuts, [*cuts[1:], len(text)]))
        return out


def _tokenized(batches: Iterator[pd.DataFrame], path: str, end: int, text: str) -> Iterator[pd.DataFrame]:
    words = built(("packing", path), lambda: Words(path))
    tail = struct.pack("<I", end)
    for pdf in steps(batches, text, 1_000_000):
        ids = [i + tail for i in words.ids(pdf[text].tolist())]
        yield pdf.drop(columns=text).assign(pack_ids=ids, pack_size=[len(i) // 4 for i in ids])


class Packer:
    """Fills sequences one after another from the examples it holds; what is left of each is known by its start."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = limits
        self.left, self.loss, self.start = (np.zeros(0, np.int64) for _ in range(3))
        self.pieces: list[list[tuple]] = []
        self.sequences = 0

    def add(self, sizes: np.ndarray, losses: np.ndarray) -> None:
        self.left, self.loss = np.concatenate([self.left, sizes]), np.concatenate([self.loss, losses])
        self.start = np.concatenate([self.start, np.zeros(len(sizes), np.int64)])
        self.pieces += [[] for _ in range(len(sizes))]

    def _choose(self, alive: np.ndarray, weights: np.ndarray, room: int, loss_room: int, fresh: bool) -> tuple[int, int]:
        """The example that goes in next, by its place in ``alive``, and how many of its tokens."""
        left, loss = self.left[alive], self.loss[alive]
        tokens, _, losses = self.limits
        # Demands and what is left as shares of the limits; the segment share is the same for all examples.
        value = weights[0] * (room / tokens) * (left / tokens) + weights[2] * (loss_room / losses) * (loss / losses)
        # The first tokens of an example bear no loss, so a cut takes these and as many more as the limits allow.
        most = np.minimum(np.minimum(left, room), np.where(loss > loss_room, left - loss + loss_room, left))
        whole = most == left
        if fresh and (left > room).any():
            able = (left > room) & (most > 0)  # an example longer than a sequence begins one
            able = able if able.any() else most > 0
        else:
            able = whole if whole.any() else most > 0
        if not able.any():
            return -1, 0
        at = int(np.where(able, value, -1.0).argmax())
        return at, int(most[at])

    def _next(self, alive: np.ndarray, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, bool]:
        """(example, tokens, loss-bearing tokens) of one sequence, what is left of ``alive``, whether a limit was met."""
        room, segments, loss_room = self.limits
        here = []
        while room > 0 and segments > 0 and len(alive):
            at, take = self._choose(alive, weights, room, loss_room, not here)
            if at < 0:
                return here, alive, True
            k = int(alive[at])
            bears = max(0, take - int(self.left[k] - self.loss[k]))
            here.append((k, take, bears))
            self.left[k] -= take
            self.loss[k] -= bears
            room, segments, loss_room = room - take, segments - 1, loss_room - bears
            if self.left[k] == 0:
                alive = np.delete(alive, at)
        return here, alive, room == 0 or segments == 0

    def _give_back(self, here: list[tuple[int, int, int]], keep: int) -> list[tuple[int, int, int]]:
        """The first ``keep`` tokens of a sequence; the rest is left of its examples again."""
        kept = []
        for k, take, bears in here:
            use = min(take, keep)
            bears_use = max(0, use - (take - bears))
            if use:
                kept.append((k, use, bears_use))
            self.left[k] += take - use
            self.loss[k] += bears - bears_use
            keep -= use
        return kept

    def _close(self, here: list[tuple[int, int, int]]) -> None:
        total = sum(take for _, take, _ in here)
        padded, offset = (total if total & (total - 1) == 0 else self.limits[0]), 0
        for k, take, bears in here:
            self.pieces[k].append((int(self.start[k]), take, bears, self.sequences, offset, padded))
            self.start[k] += take
            offset += take
        self.sequences += 1

    def fill(self, last: bool) -> None:
        """Packs what is held. A sequence that the examples do not fill is given back for more to come, or, of the
        ``last``, cut to the largest power of two, as is one that meets another limit first."""
        while True:
            alive = np.flatnonzero(self.left > 0)
            if not len(alive):
                return
            asked = np.array([self.left.sum(), len(alive), self.loss.sum()]) / np.array(self.limits, np.float64)
            weights = asked / asked.sum()
            while len(alive):
                here, alive, met = self._next(alive, weights)
                total = sum(take for _, take, _ in here)
                if not here:
                    raise ValueError("an example can take no place in an empty sequence: a limit is 0")
                if not met and not last:
                    self._give_back(here, 0)
                    return
                if total < self.limits[0] and total & (total - 1):
                    here = self._give_back(here, 1 << (total.bit_length() - 1))
                    self._close(here)
                    break  # what was given back is alive again
                self._close(here)

    def take_done(self) -> tuple[np.ndarray, list[list[tuple]]]:
        """Which examples are placed whole, and their pieces; the others stay."""
        done = self.left == 0
        pieces = [p for p, d in zip(self.pieces, done) if d]
        self.pieces = [p for p, d in zip(self.pieces, done) if not d]
        self.left, self.loss, self.start = self.left[~done], self.loss[~done], self.start[~done]
        return done, pieces


def _packed(batches: Iterator[pd.DataFrame], limits: tuple[int, int, int], size: str, loss: str,
            lot_tokens: int) -> Iterator[tuple[pd.DataFrame, list[list[tuple]]]]:
    """Rows and their pieces, a lot at a time; rows that a lot leaves unfinished come with a later one."""
    first = TaskContext.get().partitionId() << 40
    packer, held, new = Packer(limits), [], 0

    def placed(last: bool) -> Iterator[tuple[pd.DataFrame, list[list[tuple]]]]:
        nonlocal held
        packer.fill(last)
        done, pieces = packer.take_done()
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        held = [rows[~done]]
        rows = rows[done]
        for a in range(0, len(pieces), 500):
            yield rows.iloc[a:a + 500], [[(*p[:3], first + p[3], *p[4:]) for p in found] for found in pieces[a:a + 500]]

    for pdf in batches:
        for a in range(0, len(pdf), 250):
            part = pdf.iloc[a:a + 250]
            sizes = np.maximum(part[size].fillna(0).to_numpy(np.int64), 0)
            packer.add(sizes, np.clip(part[loss].fillna(0).to_numpy(np.int64), 0, sizes))
            held.append(part)
            new += int(sizes.sum())
            if new >= lot_tokens:
                yield from placed(False)
                new = 0
    yield from placed(True)


_PIECE = ("start", "length", "loss", "sequence", "offset", "padded")


def pack(examples: DataFrame, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), size: str = "pack_size",
         loss: str = "pack_loss", lot_tokens: int = LOT_TOKENS) -> DataFrame:
    """Columns of ``examples`` with packed_pieces: structs of start, length, loss, sequence, offset and padded.

    ``size`` has the tokens of an example and ``loss`` how many of them, at its end, bear a loss (the answer to an
    instruction). One sequence after another is filled within ``limits`` of tokens, segments and loss-bearing tokens: of the
    examples that fit whole, the one goes in whose demands have the largest weighted dot product with what is left of the
    sequence (all as shares of the limits, weights: the demands of all examples at hand); where none fits, the one with
    the largest product is cut to what is left. Examples longer than a sequence begin one. So sequences are
    full, or meet another limit; these and the last ones of a task are cut to a power of two, and need no padding.

    Rows are packed where they lie, without a shuffle: each task takes about ``lot_tokens`` tokens at a time and carries
    over what does not fill a sequence, so hot sources and repeated rows change nothing. Sequence numbers are unique over all
    tasks (partition in the upper bits), not dense. A null or negative size is 0: no pieces; a null loss is 0 and a loss is the
    size at most; an empty table has no sequences. Other columns stay as they are.
    """
    base, back = aside(examples, lambda c: c == "packed_pieces")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, pieces in _packed(batches, limits, size, loss, lot_tokens):
            yield pdf.assign(packed_pieces=[[dict(zip(_PIECE, p)) for p in found] for found in pieces])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    piece = ", ".join(f"{c}: long" for c in _PIECE)
    packed = base.mapInPandas(run, f"{fields}, packed_pieces array<struct<{piece}>>")
    return packed.toDF(*back(packed.drop("packed_pieces")).columns, "packed_pieces")


def packed_documents(documents: DataFrame, path: str, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), end: int = 1,
                     lot_tokens: int = LOT_TOKENS) -> DataFrame:
    """Pieces of tokenized documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset, padded.

    A document's ids are those of its text by the tokenizer at ``path``, without special tokens, and then ``end``; a null or empty
    text has only that. All ids but a document's first bear a loss, as there is nothing that the first could be
    predicted from. Tokenized and packed in one pass over the rows where they lie (see ``pack``).
    """
    small_batches(documents)
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def with_loss(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _tokenized(batches, path, end, "text"):
            yield pdf.assign(pack_loss=pdf["pack_size"] - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, pieces in _packed(with_loss(batches), limits, "pack_size", "pack_loss", lot_tokens):
            rows = [(doc_id, p[0], p[1], ids[4 * p[0]:4 * (p[0] + p[1])], len(ids) // 4, p[3], p[4], p[5])
                    for doc_id, ids, found in zip(pdf["doc_id"], pdf["pack_ids"], pieces) for p in found]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded"])
            yield out.astype({"doc_id": pdf["doc_id"].dtype})

    return documents.select("doc_id", "text").mapInPandas(
        run, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded long")
