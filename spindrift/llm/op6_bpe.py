"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries are found without a regular expression. Each code point has a class from one array; with a look-ahead of up
to two code points it becomes a symbol, and a symbol is a transition function over the states of a small automaton.
Composition of functions is associative, so the states at all positions come from a blocked scan: compose within
blocks, scan over blocks, then run each block from its true start. A token starts where (symbol, state) says so.

The slices feed a pair merger with a cache by slice. Offsets of tokens, in bytes, are kept for decoding into spans.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import cells, pieces, table, texts

# Classes of code points
LETTER, NUMBER, SPACE, BLANK, APOSTROPHE, OTHER = range(6)
# States: what the token so far is
NONE, LETTERS, NUMBERS, OTHERS, BLANKS, PREFIX, LAST_ONE, LAST_TWO, CLOSED = range(9)
STATES = 9
# Symbols
S_LETTER, S_NUMBER, S_OTHER, S_APOSTROPHE, S_SHORT, S_LONG, S_SPACE_BEFORE, S_BLANK_BEFORE, S_BLANK, S_RESET = range(10)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and starts[symbol, state] of the pattern's automaton.

    Alternatives in order: contractions; an optional space with a run of letters, numbers or others; white space up to
    the last before a non-blank; white space.
    """
    follow = np.zeros((10, 16), np.uint8)
    starts = np.ones((10, 16), bool)
    for state in range(STATES):
        joins = state == PREFIX
        follow[S_LETTER, state], starts[S_LETTER, state] = {LAST_TWO: (LAST_ONE, False), LAST_ONE: (CLOSED, False)}.get(state, (LETTERS, not (joins or state == LETTERS)))
        follow[S_NUMBER, state], starts[S_NUMBER, state] = NUMBERS, not (joins or state == NUMBERS)
        follow[S_OTHER, state], starts[S_OTHER, state] = OTHERS, not (joins or state == OTHERS)
        for symbol, to in ((S_APOSTROPHE, OTHERS), (S_SHORT, LAST_ONE), (S_LONG, LAST_TWO)):
            inside = joins or state == OTHERS
            follow[symbol, state], starts[symbol, state] = OTHERS if inside else to, not inside
        follow[S_SPACE_BEFORE, state] = PREFIX
        follow[S_BLANK_BEFORE, state] = BLANKS
        follow[S_BLANK, state], starts[S_BLANK, state] = BLANKS, state != BLANKS
        follow[S_RESET, state] = NONE
    return follow, starts


FOLLOW, STARTS = _automaton()
#: As two arrays over symbol * 16 + state.
_FLAT, _START = FOLLOW.ravel(), STARTS.ravel()


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point, as the tokenizer's own engine has it; surrogates, which no text holds, are OTHER.

    An encoding whose tokens are single bytes and whose pattern is one class returns the members of the class.
    """
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        one = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(one.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    out[0x20], out[0x27] = SPACE, APOSTROPHE
    return out


def symbols(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Symbols of code points; resets are positions of separators between texts."""
    kind = classes()[points]
    kind[resets] = BLANK
    n = len(points)
    solid = np.zeros(n, bool)  # the next position is in the same text and not white space
    solid[:-1] = (kind[1:] != BLANK) & (kind[1:] != SPACE)
    out = np.array([S_LETTER, S_NUMBER, S_BLANK, S_BLANK, S_APOSTROPHE, S_OTHER], np.uint8)[kind]
    out[(kind == SPACE) & solid] = S_SPACE_BEFORE
    out[(kind == BLANK) & solid] = S_BLANK_BEFORE
    at = np.flatnonzero(kind == APOSTROPHE)
    if len(at):
        one = points[np.minimum(at + 1, n - 1)]
        two = points[np.minimum(at + 2, n - 1)]
        inside = at + 1 < n
        out[at[inside & np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
        pair = one.astype(np.int64) * 0x110000 + two
        out[at[(at + 2 < n) & np.isin(pair, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")])]] = S_LONG
    out[resets] = S_RESET
    return out


def token_starts(symbol: np.ndarray, block: int = 256) -> np.ndarray:
    """Whether a token starts at each position, by a blocked scan over composed transition functions."""
    n = len(symbol)
    if n == 0:
        return np.zeros(0, bool)
    rows = -(-n // block)
    padded = np.full(rows * block, S_RESET, np.uint8)
    padded[:n] = symbol
    by_step = np.ascontiguousarray(padded.reshape(rows, block).T).astype(np.uint16) << 4
    function = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES)).copy()
    for step in by_step:  # the function of each whole block
        function = _FLAT[step[:, None] | function]
    shift = 1
    while shift < rows:  # prefix composition over blocks, doubling the reach each time
        function[shift:] = np.take_along_axis(function[shift:], function[:-shift].astype(np.int64), axis=1)
        shift *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = function[:-1, NONE]
    out = np.empty((block, rows), bool)
    for k, step in enumerate(by_step):
        at = step | state
        out[k] = _START[at]
        state = _FLAT[at]
    return np.ascontiguousarray(out.T).ravel()[:n]


def slices(texts_: list[bytes]) -> list[list[bytes]]:
    """The pre-tokens of each UTF-8 text."""
    joined = "\n".join([*(t.decode("utf-8", "replace") for t in texts_), ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    data = joined.encode()
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    place = np.concatenate([[0], np.cumsum(width)])
    lengths = np.array([len(t.decode("utf-8", "replace")) for t in texts_], np.int64)
    resets = np.cumsum(lengths + 1) - 1
    starts = token_starts(symbols(points, resets))
    starts[resets] = True
    at = np.flatnonzero(starts)
    edges = place[at].tolist()
    edges.append(len(data))
    cutting = np.searchsorted(at, resets).tolist()
    every = [data[a:z] for a, z in zip(edges, edges[1:], strict=False)]
    out, begin = [], 0
    for end in cutting:
        out.append(every[begin:end])
        begin = end + 1
    return out


class Encoder:
    """Pair merging by ranks, cached by slice."""

    def __init__(self, path: str, cache_size: int = 300_000) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.cache: dict[bytes, bytes] = {}
        self.cache_size = cache_size

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        return self._merge_short(piece) if len(piece) <= 96 else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        get, no = self.ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pair = [get(a + b, no) for a, b in zip(parts, parts[1:], strict=False)]
        while pair:
            low = min(pair)
            if low == no:
                break
            i = pair.index(low)
            parts[i] += parts.pop(i + 1)
            del pair[i]
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], no)
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], no)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges from a heap over a linked list: n log n for slices of any length."""
        get = self.ranks.get
        n = len(piece)
        end = list(range(1, n + 1))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        stamp = [0] * n

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, stamp[i], stamp[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, si, sj = heapq.heappop(heap)
            j = after[i] if stamp[i] >= 0 else n
            if stamp[i] != si or j >= n or stamp[j] != sj:
                continue
            end[i] = end[j]
            stamp[i] += 1
            stamp[j] = -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def encode(self, parts: list[bytes]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        cache = self.cache
        if len(cache) > self.cache_size:
            cache.clear()
        for p in set(parts).difference(cache):
            cache[p] = np.array(self.merge(p), "<u4").tobytes()
        return b"".join(map(cache.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> list[int]:
        """Byte offset of each token's start in the decoded text, and the end."""
        return np.concatenate([[0], np.cumsum([len(self.tokens[i]) for i in np.frombuffer(ids, "<u4").tolist()])]).astype(int).tolist()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoded(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], Encoder]]:
        own = encoder(path or ranks_path())
        for b in pieces(batches, 2 << 20):
            yield b, [own.encode(p) for p in slices([t or b"" for t in cells(b.column(1))])], own

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and offsets (bytes) for each row of docs (doc_id, text); null is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b, ids, own in _encoded(path)(batches):
            lists = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32())), pa.array([own.offsets(x) for x in ids], pa.list_(pa.int64()))], names=["doc_id", "ids", "offsets"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of each row of (doc_id, ids)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = encoder(path or ranks_path())
        for b in batches:
            out = [own.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def encoded_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256: the token ids beside the digests that prove the round trip."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b, ids, own in _encoded(path)(batches):
            sha = lambda x: hashlib.sha256(x).hexdigest()
            lists = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), lists, pa.array([sha(x) for x in ids], pa.string()), pa.array([sha(own.decode(x)) for x in ids], pa.string())],
                names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (doc_id, text).

    Null and empty texts have no tokens. Repeated rows give repeated rows, null ids stay null, other columns are not read.
    """
    return encoded_digests(docs, path).drop("ids")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(texts(table(spark, sf_dir, "documents"), "doc_id", "text"))
