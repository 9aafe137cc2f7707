"""A hashed maximum-entropy language model with a class-factored softmax.

Classes form a tree of 16 branches and one to four levels, more for a larger vocabulary. P(word | history) is the
product of P(branch | node, history) over the word's path and of P(word | leaf). Each branch is a softmax on hashed
features of the node with: the last word, the last two, two skips (the word before the last, and the one before that),
and the class of the last word. The most frequent words are leaves of their own at the first level; others go by their
last two bytes, last three, and the whole word. P(word | leaf) is add-one smoothed counts within the leaf.

Training is synchronous: in each round all tasks sum the gradient of their texts at the shared weights, the sums meet,
and every weight moves once, by the gradient over the greater of what was seen and what was expected. So weights and
scores do not hang on how texts are dealt to tasks, but for rounding. Biases start at the counts of the branches.

Texts are split twice, to count words and to lay out each token's hash and leaf; rounds and scores read only the latter,
6 bytes a token. What was seen is the same in every round and is summed in the first alone. There all weights but the
biases are zero, so the chances hang on the node alone: counts of (row, node) give what was expected.

Word counts cover all training texts and stay a distributed table. Only words at or above a count that leaves at most
``FREQUENT`` of them, 64 bytes long at most, are broadcast; the other words of each text meet their counts in a join,
one row for each distinct word of a text. Weight rows grow with the training tokens up to ``2 ** MOST_BITS`` (4 MB),
leaves with the vocabulary up to 65,536. So nothing on the driver or in a worker grows with the corpus beyond that.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cells, pieces, shared_dir, stored, table, texts

CLASSES, OWN = 16, 8  # branches of a node, and words that are leaves of their own
MOST_LEVELS = 4
LEAST_BITS, MOST_BITS = 12, 16
FREQUENT, LONGEST = 300_000, 64
ROUNDS = 2
RATE, DAMP = 1.0, 16.0
STEP = 16384  # tokens of one softmax
BLOCK = 1 << 16  # tokens whose rows are found, and whose chances are summed in single precision, at once
JOINT = 1 << 23  # most pairs of a row and a node that are counted at a level
TASK_TOKENS = 2_000_000  # least tokens of a training task, whose sums are as large as the weights
ROOM = 200_000  # words beside the frequent ones that a worker remembers
END = b""
CHUNK = 512
_FAN = 64


def tokens_of(text: bytes) -> list[bytes]:
    """Words, A-Z lowered, and one end, the empty token."""
    words = text.lower().split()
    words.append(END)
    return words


def held_out(doc_id):
    """crc32 of the id as text, modulo 7, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


# --- vocabulary ------------------------------------------------------------------------------------------------------


def word_counts(train: DataFrame) -> DataFrame:
    """(word: binary, c) over all training texts; counted within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for b in pieces(batches):
            for t in cells(b.column(0)):
                counts.update(tokens_of(t or b""))
                if len(counts) > 300_000:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass(frozen=True)
class Shape:
    """Levels of the class tree and bits of the hashed rows. Rows of the nodes' biases follow the hashed ones."""

    levels: int
    bits: int

    @property
    def rows(self) -> int:
        return 1 << self.bits

    @property
    def leaves(self) -> int:
        return CLASSES**self.levels

    def first(self, level: int) -> int:
        """Number of the first node of a level, counted from the root."""
        return (CLASSES**level - 1) // (CLASSES - 1)

    @property
    def size(self) -> int:
        return self.rows + self.first(self.levels)


def shape_of(n: int, v: int) -> Shape:
    """At most some 256 words a leaf and 8 tokens a row, within the bounds."""
    levels = next((k for k in range(1, MOST_LEVELS) if 256 * CLASSES**k >= v), MOST_LEVELS)
    return Shape(levels, min(MOST_BITS, max(LEAST_BITS, (n // 8).bit_length())))


def word_leaves(words: list[bytes], hashes: np.ndarray, own: dict[bytes, int], levels: int) -> np.ndarray:
    """Leaves of words, whose crc32 hashes are."""
    crc = lambda parts: np.fromiter(map(zlib.crc32, parts), np.int64, len(words))
    leaves = OWN + crc([w[-2:] for w in words]) % (CLASSES - OWN)
    if levels > 1:
        leaves = leaves * CLASSES + (crc([w[-3:] for w in words]) >> 9) % CLASSES
    for k in range(2, levels):
        leaves = leaves * CLASSES + (hashes.astype(np.int64) >> (4 * k + 8)) % CLASSES
    for k, w in enumerate(words):
        if w in own:
            leaves[k] = own[w] * CLASSES ** (levels - 1)
    return leaves


def word_leaf(word: bytes, own: dict[bytes, int], levels: int) -> int:
    return int(word_leaves([word], np.array([zlib.crc32(word)]), own, levels)[0])


def leaf_column(own: dict[bytes, int], levels: int):
    """word_leaf as a Column over the column word."""
    last = lambda k: F.crc32(F.expr(f"substring(word, greatest(length(word) - {k - 1}, 1), {k})"))
    leaf = F.lit(OWN) + last(2) % (CLASSES - OWN)
    if levels > 1:
        leaf = leaf * CLASSES + F.shiftright(last(3), 9) % CLASSES
    for k in range(2, levels):
        leaf = leaf * CLASSES + F.shiftright(F.crc32("word"), 4 * k + 8) % CLASSES
    for word, k in own.items():
        leaf = F.when(F.col("word") == F.lit(bytearray(word)), F.lit(k * CLASSES ** (levels - 1)).cast("long")).otherwise(leaf)
    return leaf


@dataclass(frozen=True)
class Vocabulary:
    """What training and scoring need beside the table of counts; bounded in size."""

    words: bytes  # the frequent words, parted by blanks; the end token is apart
    counts: np.ndarray
    end_count: int
    least: int
    own: dict[bytes, int]
    shape: Shape
    leaf_tokens: np.ndarray
    leaf_words: np.ndarray

    @property
    def n(self) -> int:
        return int(self.leaf_tokens.sum())

    @property
    def v(self) -> int:
        return int(self.leaf_words.sum())


def vocabulary(counts: DataFrame) -> Vocabulary:
    short = counts.filter(F.length("word") <= LONGEST)
    # Counts by eighths of an octave: a few hundred bins whatever the input.
    bins = short.groupBy(F.floor(F.log2("c") * 8).alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.min("c").alias("least")).orderBy(F.desc("bin")).collect()
    least, taken = 1 << 62, 0
    for b in bins:
        if taken + b["words"] > FREQUENT:
            break
        least, taken = b["least"], taken + b["words"]
    found = short.filter(F.col("c") >= least).toArrow()
    top = sorted(zip(cells(found.column("word")), found.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    end_count = next((c for w, c in top if w == END), 0)
    if not end_count:
        end_count = next((r["c"] for r in counts.filter(F.length("word") == 0).collect()), 0)
    top = [x for x in top if x[0] != END]
    own = {w: k for k, w in enumerate([END, *[w for w, _ in top[: OWN - 1]]])}
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).collect()[0]
    shape = shape_of(whole["n"], whole["v"])
    by = counts.groupBy(leaf_column(own, shape.levels).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    tokens, words = np.zeros(shape.leaves, np.int64), np.zeros(shape.leaves, np.int64)
    for r in by:
        tokens[r["k"]], words[r["k"]] = r["c"], r["v"]
    return Vocabulary(b" ".join(w for w, _ in top), np.array([c for _, c in top], np.int64), end_count, int(least), own, shape, tokens, words)


class _Numbers(dict):
    """Numbers words as they come and lists the new ones."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Lexicon:
    """Numbers of words within a Python worker: frequent ones first, others as they come, forgotten when there are many."""

    def __init__(self, vocabulary: Vocabulary | None, own: dict[bytes, int], levels: int) -> None:
        self.own, self.levels = own, levels
        self.base = [END] + (vocabulary.words.split() if vocabulary else [])
        room = len(self.base) + 2 * ROOM
        self.hash_array, self.leaf_array = np.zeros(room, np.uint32), np.zeros(room, np.int64)
        self._fill(0, self.base)
        self.reset()

    def reset(self) -> None:
        self.numbers = _Numbers(zip(self.base, range(len(self.base)), strict=True))
        self.numbers.fresh = []

    def _fill(self, at: int, words: list[bytes]) -> None:
        end = at + len(words)
        if end > len(self.hash_array):
            self.hash_array, self.leaf_array = np.resize(self.hash_array, 2 * end), np.resize(self.leaf_array, 2 * end)
        self.hash_array[at:end] = hashes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        self.leaf_array[at:end] = word_leaves(words, hashes, self.own, self.levels)

    def number(self, words: list[bytes]) -> np.ndarray:
        numbers = self.numbers
        if len(numbers) > len(self.base) + ROOM:
            self.reset()
            numbers = self.numbers
        out = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        if numbers.fresh:
            self._fill(len(numbers) - len(numbers.fresh), numbers.fresh)
            numbers.fresh.clear()
        return out


# --- model -----------------------------------------------------------------------------------------------------------


def features(hashes: np.ndarray, leaves: np.ndarray, position: np.ndarray, shape: Shape) -> np.ndarray:
    """Hashes of each token's history, one row a feature; position: the token's place in its text."""
    n = len(hashes)

    def back(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        out[by:] = x[: max(0, n - by)]
        out[position < by] = 0x1234567
        return out

    h = hashes.astype(np.uint64)
    one, two, three = back(h, 1), back(h, 2), back(h, 3)
    kind = back((leaves >> 4 * max(0, shape.levels - 2)).astype(np.uint64), 1)
    return np.stack([
        one * np.uint64(0x9E3779B97F4A7C15),
        (one * np.uint64(31) + two + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F),
        two * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1 << 50),
        three * np.uint64(0xA0761D6478BD642F) + np.uint64(3 << 50),
        (kind + np.uint64(5)) * np.uint64(0xE7037ED1A0B428DB),
    ])


def branches(history: np.ndarray, leaves: np.ndarray, level: int, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At a level: the tokens whose path goes through it, their weight rows (one row a feature), the branch taken."""
    below = 4 * (shape.levels - level)
    at = np.flatnonzero(leaves >> 4 * (shape.levels - 1) >= OWN) if level else np.arange(len(leaves))
    leaves = leaves[at]
    node = (leaves >> below) + shape.first(level)
    salt = (node + 1).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)
    rows = np.empty((len(history) + 1, len(at)), np.int64)
    for k, h in enumerate(history):
        rows[k] = ((h[at] ^ salt) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - shape.bits)
    rows[-1] = shape.rows + node
    return at, rows, (leaves >> below - 4) & CLASSES - 1


def logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sparse rows of the weights summed. Weights move by at most RATE a round, so exponentials need no shift."""
    z = np.take(weights, rows[0], axis=0)
    row = np.empty_like(z)
    for k in range(1, len(rows)):
        z += np.take(weights, rows[k], axis=0, out=row, mode="clip")
    return z


def log_chances(weights: np.ndarray, rows: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probabilities of the branches taken."""
    z = logits(weights, rows)
    return z[np.arange(len(z)), taken] - np.log(np.exp(z) @ np.ones(CLASSES, np.float32))


def _histories(hashes: np.ndarray, leaves: np.ndarray, position: np.ndarray, shape: Shape) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Start, history and leaves of each block of tokens."""
    for i in range(0, len(hashes), BLOCK):
        cut = slice(max(0, i - 3), i + BLOCK)  # three words of history
        here = leaves[cut].astype(np.int64)
        past = i - cut.start
        yield i, features(hashes[cut], here, position[cut], shape)[:, past:], here[past:]


def _blocks(numbers: np.ndarray, position: np.ndarray, lexicon: Lexicon, shape: Shape) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    return _histories(lexicon.hash_array[numbers], lexicon.leaf_array[numbers], position, shape)


def chances(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities of all branches."""
    z = logits(weights, rows)
    np.exp(z, out=z)
    z /= (z @ np.ones(CLASSES, np.float32))[:, None]
    return z


class Sums:
    """Expected counts of each weight row with each branch; in the first round the seen ones too.

    Two neighbouring branches are added at a time, as the parts of a complex number: numpy has no other compiled
    addition by index of more than one float.
    """

    def __init__(self, weights: np.ndarray, shape: Shape, first: bool) -> None:
        self.weights, self.shape, self.first = weights, shape, first
        self.singles = np.zeros((CLASSES // 2, shape.size), np.complex64)
        self.doubles = np.zeros((CLASSES // 2, 2 * shape.size))
        if first:
            self.seen = np.zeros(shape.size * CLASSES, np.int64)
            self.by_node = chances(weights, np.arange(shape.rows, shape.size)[None])
            self.joint = [np.zeros(shape.rows * self.nodes(k), np.int64) if shape.rows * self.nodes(k) <= JOINT else None for k in range(shape.levels)]

    def past(self, level: int) -> int:
        """Nodes of a level that no path goes through, as the first branches of the root are leaves."""
        return OWN * CLASSES ** (level - 1) if level else 0

    def nodes(self, level: int) -> int:
        return CLASSES**level - self.past(level)

    def add(self, history: np.ndarray, leaves: np.ndarray) -> None:
        for level in range(self.shape.levels):
            at, rows, taken = branches(history, leaves, level, self.shape)
            if not len(at):
                continue
            if self.first:
                np.add.at(self.seen, (rows * CLASSES + taken).ravel(), 1)
                node = rows[-1] - self.shape.rows
                if self.joint[level] is not None:
                    node -= self.shape.first(level) + self.past(level)
                    np.add.at(self.joint[level], (rows[:-1] * self.nodes(level) + node).ravel(), 1)
                else:
                    self._scatter(rows[:-1], np.take(self.by_node, node, axis=0))
            else:
                for i in range(0, len(at), STEP):
                    part = rows[:, i : i + STEP]
                    p = chances(self.weights, part)
                    if level:
                        self._scatter(part, p)
                    else:  # all tokens meet in the root's bias
                        self._scatter(part[:-1], p)
                        self.doubles[:, 2 * self.shape.rows : 2 * self.shape.rows + 2] += (np.ones(len(p), np.float32) @ p).reshape(-1, 2)
        if not self.first or any(x is None for x in self.joint):
            self.doubles += self.singles.view(np.float32)
            self.singles[:] = 0

    def _scatter(self, rows: np.ndarray, p: np.ndarray) -> None:
        pairs = np.ascontiguousarray(p.view(np.complex64).T)
        for row in rows:
            for to, x in zip(self.singles, pairs, strict=True):
                np.add.at(to, row, x)

    def expected(self) -> np.ndarray:
        out = np.ascontiguousarray(self.doubles.reshape(CLASSES // 2, -1, 2).transpose(1, 0, 2)).reshape(-1, CLASSES)
        if self.first:
            rows = self.shape.rows
            out[rows:] = self.seen.reshape(-1, CLASSES)[rows:].sum(axis=1, keepdims=True) * self.by_node.astype(np.float64)
            for level, joint in enumerate(self.joint):
                if joint is not None:
                    at = self.shape.first(level) + self.past(level)
                    p = self.by_node[at : at + self.nodes(level)].astype(np.float64)
                    for i in range(0, rows, 4096):
                        out[i : min(i + 4096, rows)] += joint.reshape(rows, -1)[i : i + 4096] @ p
        return out


def _words(column: pa.Array) -> list[bytes]:
    """Bytes of a column of words, none of which has a blank: quicker than cell by cell."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(column)], column.cast(pa.string())), " ")[0].as_buffer().to_pybytes().split(b" ") if len(column) else []


def _laid_out(texts_, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[pa.Array, np.ndarray]]:
    """Word numbers of all texts in a row, each token's place in its text, texts' lengths, and the distinct words with
    each token's place among them. texts_: strings or their bytes; words are those of tokens_of."""
    column = texts_ if isinstance(texts_, pa.Array) else pa.array(texts_, pa.binary())
    kind = {pa.binary(): pa.string(), pa.large_binary(): pa.large_string()}.get(column.type)
    split = pc.ascii_split_whitespace(pc.ascii_lower((column.view(kind) if kind else column).fill_null("")))
    found = split.flatten().dictionary_encode()
    words = _words(found.dictionary)
    places = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    if END in words:  # blanks at either end of a text leave an empty word there
        full = places != words.index(END)
        places, text = places[full], text[full]
    sizes = np.bincount(text, minlength=len(split)) + 1
    among = np.full(int(sizes.sum()), len(words))
    among[np.arange(len(places)) + text] = places
    position = np.arange(len(among)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return lexicon.number([*words, END])[among], position, sizes, (found.dictionary, among)


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers held in the cells of a binary column, in a row, and how many each cell has."""
    wide = pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends) // np.dtype(kind).itemsize


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, leaves, places in their texts of all tokens, and texts' lengths."""
    hashes, sizes = _flat(b.column("hashes"), np.uint32)
    return hashes, _flat(b.column("leaves"), np.uint16)[0], np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def _gradients(weights, shape: Shape, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _KEPT.clear()  # words are laid out by now
        sums = Sums(weights.value, shape, first)
        for b in pieces(batches):
            hashes, leaves, position, _ = _read(b)
            for _, history, here in _histories(hashes, leaves, position, shape):
                sums.add(history, here)
        part, expected = TaskContext.get().partitionId(), sums.expected()
        seen = sums.seen.reshape(-1, CLASSES) if first else None
        for c in range(0, shape.size, CHUNK):
            e = expected[c : c + CHUNK]
            if e.any():
                both = np.stack([seen[c : c + CHUNK], e]) if first else e
                yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK], pa.int64()), pa.array([part], pa.int64()), pa.array([both.astype(np.float32).tobytes()], pa.binary())], names=["chunk", "part", "sums"])

    return run


def _sum(parts) -> np.ndarray:
    return np.sum([np.frombuffer(x, np.float32) for x in parts], axis=0, dtype=np.float64)


def _added(key, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"chunk": [key[0]], "part": [key[1]], "sums": [_sum(rows["sums"]).astype(np.float32).tobytes()]})


_PARTS = "chunk long, part long, sums binary"


def biases(words: Vocabulary) -> np.ndarray:
    """Weights before training: biases at the frequencies of the nodes' branches, the rest zero."""
    shape = words.shape
    weights = np.zeros((shape.size, CLASSES), np.float32)
    for level in range(shape.levels):
        tokens = words.leaf_tokens.reshape(CLASSES**level, CLASSES, -1).sum(axis=2) + 0.5
        first = shape.rows + shape.first(level)
        weights[first : first + len(tokens)] = np.log(tokens / tokens.sum(axis=1, keepdims=True))
    return weights


def train(laid: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights from all of laid (hashes, leaves): each round sums the gradient over all texts and moves every weight once."""
    sc, shape = laid.sparkSession.sparkContext, words.shape
    weights, seen = biases(words), np.zeros((shape.size, CLASSES))
    for k in range(rounds):
        shared = sc.broadcast(weights)
        rows = laid.select("hashes", "leaves").coalesce(1 + words.n // TASK_TOKENS).mapInArrow(_gradients(shared, shape, k == 0), _PARTS)
        for _ in range(3):  # sums of at most _FAN tasks meet at a time
            rows = rows.withColumn("part", F.expr(f"part div {_FAN}")).groupBy("chunk", "part").applyInPandas(_added, _PARTS)
        expected = np.zeros((shape.size, CLASSES))
        for x in rows.groupBy("chunk").agg(F.collect_list("sums").alias("all")).collect():  # as large as the weights
            at, found = x["chunk"] * CHUNK, _sum(x["all"]).reshape(2 if k == 0 else 1, -1, CLASSES)
            expected[at : at + found.shape[1]] = found[-1]
            if k == 0:
                seen[at : at + found.shape[1]] = found[0]
        weights = weights + (RATE * (seen - expected) / (np.maximum(seen, expected) + DAMP)).astype(np.float32)
    return weights


# --- scores ----------------------------------------------------------------------------------------------------------


_KEPT: dict[str, Lexicon] = {}


def _lexicon(name: str, words: Vocabulary) -> Lexicon:
    """The frequent words' numbers, built once in each Python worker."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Lexicon(words, words.own, words.shape.levels)
    return _KEPT[name]


_LAID = "held_out boolean, n_tokens long, known long, logs double, rare array<struct<word:binary,n:long>>, hashes binary, leaves binary"


def _laying(shared, name: str):
    """What needs the words: the frequent ones' counts, the others by text, and each token's hash and leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        lexicon = _lexicon(name, words)
        known = len(lexicon.base)
        counts = np.concatenate([[words.end_count], words.counts, [0]])  # the last: any other word's
        has, log = (counts > 0).astype(np.int64), np.log10(counts + 1.0)
        for b in pieces(batches):
            if not b.num_rows:
                continue
            numbers, _, sizes, (distinct, among) = _laid_out(b.column(2), lexicon)
            ends = np.cumsum(sizes)
            add = lambda x: np.add.reduceat(x, ends - sizes)
            common = np.minimum(numbers, known)
            rare_at = np.flatnonzero(numbers >= known)
            pairs, n = np.unique(np.searchsorted(ends, rare_at, side="right") * (len(distinct) + 1) + among[rare_at], return_counts=True)
            text, place = np.divmod(pairs, len(distinct) + 1)
            rare_words = distinct.take(pa.array(place, pa.int64())).cast(pa.binary())
            offsets = np.searchsorted(text, np.arange(len(sizes) + 1)).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([rare_words, pa.array(n, pa.int64())], names=["word", "n"]))
            parts = np.r_[0, ends]
            binary = lambda x: pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.array(parts * x.itemsize, pa.int32()).buffers()[1], pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array(sizes), pa.array(add(has[common])), pa.array(add(log[common])), rare,
                    binary(lexicon.hash_array[numbers]), binary(lexicon.leaf_array[numbers].astype(np.uint16)),
                ],
                names=["doc_id", "held_out", "n_tokens", "known", "logs", "rare", "hashes", "leaves"],
            )

    return run


def _scored(trained):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, shape, floor = trained.value
        for b in pieces(batches):
            if not b.num_rows:
                continue
            hashes, leaves, position, sizes = _read(b)
            model = np.empty(len(hashes))
            for i, history, here in _histories(hashes, leaves, position, shape):
                model[i : i + len(here)] = -floor[here]
                for level in range(shape.levels):
                    at, rows, taken = branches(history, here, level, shape)
                    for j in range(0, len(at), STEP):
                        model[i + at[j : j + STEP]] += log_chances(weights, rows[:, j : j + STEP], taken[j : j + STEP]) / np.log(10)
            sums = pa.array(np.add.reduceat(model, np.cumsum(sizes) - sizes))
            names = [x for x in b.schema.names if x not in ("hashes", "leaves")]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), sums], names=[*names, "model"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    Null and empty texts have the end token alone. A null id counts as the empty text when folds are dealt. Repeated
    rows are learned from and scored each. Without training texts N and V are 0 and all words unknown. Other columns
    are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    training = rows.filter(~F.col("held_out"))
    counts = stored(word_counts(training), folder, "words")
    words = vocabulary(counts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    laid = rows.mapInArrow(_laying(spark.sparkContext.broadcast(words), uuid.uuid4().hex), f"doc_id {kind}, {_LAID}")
    laid = stored(laid.withColumn("row", F.monotonically_increasing_id()), folder, "tokens")
    floor = np.log10(words.leaf_tokens + words.leaf_words + 1)
    model = spark.sparkContext.broadcast((train(laid.filter(~F.col("held_out")), words), words.shape, floor))
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, model double"
    scored = laid.select("row", "doc_id", "held_out", "n_tokens", "known", "logs", "hashes", "leaves").mapInArrow(_scored(model), schema)
    unusual = counts.filter((F.col("c") < words.least) | (F.length("word") > LONGEST))
    rare = laid.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n").join(unusual, "word")
    sums = rare.groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_logs"))
    more = F.coalesce("rare_logs", F.lit(0.0))
    n, v = words.n, words.v
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), (F.col("model") + F.col("logs") + more).alias("score"),
    )


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(texts(table(spark, sf_dir, "documents"), "doc_id", "text"))
