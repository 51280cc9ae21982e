"""Byte-level BPE: encoding through a lazily determinised transducer, streaming decoding."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from bursar.llm.common import built, small_batches, steps

#: Bounds of a worker's memory: a full cache is emptied and filled again.
MAX_STATES = 200_000
MAX_PIECES = 200_000
MAX_PAIRS = 300_000
_BYTES = [bytes([b]) for b in range(256)]
#: Later than any rank.
NEVER = 1 << 62
#: Pieces longer than this are not kept in the cache.
MAX_PIECE_CHARS = 64
#: Ids that the decoder takes at a time.
DECODE_IDS = 65_536


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Reads a piece byte by byte and writes tokens as soon as no further byte can change them.

    A state is what is still open: the last token written and the pending bytes after it. For each pending
    position it knows where the last token of the prefix up to there starts; by the structure of ranked
    merges this is the one token whose pair with the last token before it stands up to merging. The next
    token can only begin where the bytes since then begin some token; what all those positions agree on
    is written out. So the lookahead is at most the longest token. States and their edges are built when
    first met.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.begins = {token[:k] for token in ranks for k in range(1, len(token))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        # By token, bounded by the vocabulary: its last merge, and its left (0) and right (1) edge.
        self.split: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.spines: tuple[dict, dict] = {}, {}
        self._reset()

    def _reset(self) -> None:
        # Of each state: last token and pending bytes, starts, the tokens if the piece ends here; edges by
        # state << 8 | byte.
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.content: list[tuple[bytes, bytes]] = []
        self.starts: list[tuple[int, ...]] = []
        self.final: list[tuple[int, ...] | None] = []
        self.edges: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._state(b"", b"", (0,))

    def _state(self, last: bytes, pending: bytes, starts: tuple[int, ...]) -> int:
        key = last, pending
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.content)
            self.content.append(key)
            self.starts.append(starts)
            self.final.append(None)
        return at

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens of the last merge that makes ``token``; None if merging does not make it."""
        if token not in self.split:
            parts, own = [token[k:k + 1] for k in range(len(token))], self.ranks[token]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[k] + parts[k + 1], own), k) for k in range(len(parts) - 1))
                if rank >= own:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.split[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.split[token]

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]] | None:
        """The tokens that stand in turn at one edge of ``token``, with the rank of the merge that ends each."""
        spine = self.spines[side].get(token, 0)
        if spine == 0:
            spine, part = [(token, NEVER)], token
            while len(part) > 1 and spine is not None:
                halves = self._halves(part)
                if halves is None or (side and self._spine(halves[0], 1) is None):
                    spine = None
                    break
                end, part = self.ranks[part], halves[side]
                spine.append((part, end))
            if spine is not None:
                spine.reverse()
            self.spines[side][token] = spine
        return spine

    def _stands(self, left: bytes, right: bytes) -> bool:
        """Whether merging the bytes of both gives just these two tokens.

        Both grow by their own merges; the pair falls if, at some time, the tokens at the border are a
        token together whose rank is due before the merges that end them (the leftmost first).
        """
        rights = self._spine(right, 0)
        if rights is None:
            return False
        if not left:
            return True
        ok = self.pairs.get((left, right))
        if ok is not None:
            return ok
        lefts, i, j, ok = self._spine(left, 1), 0, 0, True
        ranks = self.ranks
        while ok:
            (a, a_end), (b, b_end) = lefts[i], rights[j]
            rank = ranks.get(a + b, NEVER)
            if rank < a_end and rank <= b_end and rank != NEVER:
                ok = False
            elif a_end == b_end == NEVER:
                break
            elif a_end <= b_end:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = ok
        return ok

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        (last, pending), starts = self.content[state], self.starts[state]
        pending += _BYTES[byte]
        n = len(pending)
        for s in range(max(0, n - self.longest), n):
            token = pending[s:]
            if token in self.ranks and self._stands(pending[starts[s]:s] if s else last, token):
                starts += (s,)
                break
        else:
            raise ValueError(f"the ranks lack the byte {byte}")
        if pending in self.begins:
            return self._state(last, pending, starts), ()
        # Where the next token may begin; what these prefixes share, going back along starts, is settled.
        live = {j for j in range(max(1, n - self.longest + 1), n) if pending[j:] in self.begins}
        live.add(n)
        while len(live) > 1:
            back = max(live)
            live.remove(back)
            live.add(starts[back])
        settled = live.pop()
        cuts, j = [], settled
        while j > 0:
            cuts.append(j)
            j = starts[j]
        written = []
        for end in reversed(cuts):
            last = pending[j:end]
            written.append(self.ranks[last])
            j = end
        pending = pending[settled:]
        if pending and pending not in self.begins:
            last = b""  # no further token can begin right after it, so it does not matter any more
        # Starts before the cut belong to positions that cannot be reached any more.
        return self._state(last, pending, tuple(max(s - settled, 0) for s in starts[settled:])), tuple(written)

    def _finish(self, state: int) -> tuple[int, ...]:
        pending, starts = self.content[state][1], self.starts[state]
        out, j = [], len(pending)
        while j > 0:
            out.append(self.ranks[pending[starts[j]:j]])
            j = starts[j]
        return tuple(reversed(out))

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token is that token, even if merging cannot make it."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self.content) > MAX_STATES:
            self._reset()
        out: list[int] = []
        state = 0
        edges = self.edges
        for byte in piece:
            edge = edges.get(state << 8 | byte)
            if edge is None:
                edge = edges[state << 8 | byte] = self._step(state, byte)
                if len(self.content) > 2 * MAX_STATES:  # one very long piece: go on from a fresh copy of the state
                    content, starts = self.content[edge[0]], self.starts[edge[0]]
                    self._reset()
                    edges = self.edges
                    edge = self._state(*content, starts), edge[1]
            state, written = edge
            if written:
                out += written
        rest = self.final[state]
        if rest is None:
            rest = self.final[state] = self._finish(state)
        out += rest
        return out


#: The pattern of the public byte-level tokenizers (fixed by them), and its meaning within FAST: letters,
#: digits and white space of Latin text written out, for the standard library's quicker matcher.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FAST = "\t-\r -\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_SPACE = "\t-\r \xa0"
FAST_PATTERN = (f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+"
                f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Encoder(dict):
    """Text to packed little-endian 32-bit ids; as a dict it holds the ids of recent short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.transducer = Transducer(ranks)
        self.any_pieces = regex.compile(pattern).findall
        self.fast_pieces = re.compile(FAST_PATTERN).findall if pattern == PATTERN else self.any_pieces
        self.beyond_fast = re.compile(f"[^{FAST}]").search

    def pieces(self, text: str) -> list[str]:
        return (self.any_pieces if self.beyond_fast(text) else self.fast_pieces)(text)

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.transducer.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= MAX_PIECE_CHARS:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))


class Utf8Stream:
    """An incremental UTF-8 state machine: bytes go in, whole characters come out.

    Between calls the state is an unfinished character's bytes and how many are still to come. Bytes that
    can be no character become U+FFFD.
    """

    def __init__(self):
        self.open = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that begin a character but do not complete it."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:  # no continuation byte: it starts the last character
                need = 2 if 0xC2 <= lead <= 0xDF else 3 if lead & 0xF0 == 0xE0 else 4 if 0xF0 <= lead <= 0xF4 else 1
                return back if need > back else 0
        return 0

    def feed(self, data: bytes, end: bool = False) -> str:
        data = self.open + data
        keep = 0 if end else self._unfinished(data)
        self.open = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")


def decode_stream(packed: bytes, tokens: dict[int, bytes]) -> Iterable[str]:
    """The text of packed ids, chunk by chunk."""
    stream = Utf8Stream()
    ids = np.frombuffer(packed, "<u4")
    for k in range(0, len(ids), DECODE_IDS):
        yield stream.feed(b"".join(map(tokens.__getitem__, ids[k:k + DECODE_IDS].tolist())))
    yield stream.feed(b"", end=True)


def _coder(model) -> tuple[Encoder, dict[int, bytes]]:
    ranks, pattern = model.value
    return Encoder(ranks, pattern), {rank: token for token, rank in ranks.items()}


def encode_decode(documents: DataFrame, ranks_path: str, pattern: str, text: str = "text",
                  as_array: bool = False) -> DataFrame:
    """``documents`` with bpe_count, bpe_ids and bpe_text: the whole text encoded, and the ids decoded again.

    Each match of ``pattern`` is encoded on its own; bpe_ids holds little-endian unsigned 32-bit ids, or
    with ``as_array`` an array of ints. Null and empty texts have no ids and decode to the empty text.
    Input columns of these names are replaced; other columns, repeated rows and the order stay. The
    driver reads the ranks file and broadcasts it (its size is the vocabulary's); a worker's caches are
    bounded. Rows stream through without a shuffle.
    """
    small_batches(documents)
    base = documents.drop("bpe_count", "bpe_ids", "bpe_text")
    model = documents.sparkSession.sparkContext.broadcast((load_ranks(ranks_path), pattern))
    key = "byte_bpe", uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, tokens = built(key, lambda: _coder(model))
        for pdf in steps(batches, text):
            packed = [encoder.encode(t) if isinstance(t, str) else b"" for t in pdf[text]]
            ids = [np.frombuffer(p, "<u4").astype(np.int32) for p in packed] if as_array else packed
            yield pdf.assign(bpe_count=[len(p) // 4 for p in packed], bpe_ids=ids,
                             bpe_text=["".join(decode_stream(p, tokens)) for p in packed])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInPandas(run, f"{fields}, bpe_count long, "
                                 f"bpe_ids {'array<int>' if as_array else 'binary'}, bpe_text string")
