"""Exact substring dedup: every byte of a 100-byte string that also starts earlier is removed.

The suffix array is built blockwise over a difference cover, and the cover is defined by content: sample points are
the minimisers of the hashed 32-byte strings within each 100-byte window. Two equal windows have their sample point at
the same offset d, which is what a difference cover is for; comparing them takes d bytes and the rank of the sample.

1. Sample points of all texts meet by the hash of their 32 bytes, their suffix bucket. Buckets seen in one text only
   drop out, and so do all but the first of exact copies.
2. For each bucket left, the bytes around its sample points (all windows that share the point, 168 bytes at most) are
   gathered. A task sorts one block of whole buckets at a time: the suffixes that start at the sample points, and the
   reversed prefixes that end there. Neighbours' common lengths turn both orders into ranks for every length. A window
   is its pair of ranks; of equal pairs all but the first in (document, start) are marked.
3. A bucket beyond ``MAX_BUCKET`` is split by content: windows that reach far to the right by more bytes on the right,
   the others by more bytes on the left, until a bucket is small or a row is one window.

Repeats within one text are found on the text itself, so periodic text does not fill a bucket. A text is handled in
segments of about a MB. Memory depends on blocks, never on the corpus.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cells, pieces, shared_dir, stored, table, texts

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # a sample point lies 0 to REACH bytes behind its window's start
SEGMENT = (1 << 20) - 256  # windows of a segment; positions fit 20 bits
MAX_BUCKET, BLOCK = 100_000, 20_000
_BATCH = 2 << 20  # bytes of text handled at a time in a worker
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_WIDTH = REACH + LENGTH  # bytes around a sample point that any of its windows has


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit value for each byte, and powers of an odd base and of its inverse modulo 2**64."""

    def powers(base: int) -> np.ndarray:
        out, n = np.ones(SEGMENT + 2 * LENGTH, np.uint64), 1
        while n < len(out):
            m = min(n, len(out) - n)
            out[n : n + m] = out[:m] * np.uint64(pow(base, n, 1 << 64))
            n += m
        return out

    return np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def rolling(data: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """A 64-bit hash of the bytes at every place, for each length."""
    value, up, down = _tables()
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value[data] * down[:n], out=sums[1:])
    out = []
    for k in lengths:
        h = (sums[k:] - sums[:-k]) * up[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(32)))
    return out


def sample_points(data: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the windows' minimisers, and for each the first and past-the-last window start."""
    coded = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    least, reach, width = coded, 1, REACH + 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    at = (least & _LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], len(at)]


def repeats_within(data: np.ndarray, raw: bytes) -> np.ndarray | None:
    """Whether each window equals an earlier one of the same segment; None if none does. Runs are compared byte by byte."""
    (h,) = rolling(data, LENGTH)
    _, index, inverse = np.unique(h, return_index=True, return_inverse=True)
    first = index[inverse]
    start = np.arange(len(h))
    back = start - first
    if not back.any():
        return None
    edge = np.flatnonzero(np.r_[True, back[1:] != back[:-1], True])
    out = np.zeros(len(h), bool)
    for a, z in zip(edge.tolist(), edge[1:].tolist(), strict=False):
        if (d := int(back[a])) and raw[a : z - 1 + LENGTH] == raw[a - d : z - 1 + LENGTH - d]:
            out[a:z] = True
    return out


def points_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Hash, place, first and past-the-last window of a segment's sample points, without windows that repeat an earlier one."""
    none = np.empty(0, np.int64)
    if len(raw) < LENGTH:
        return none.view(np.uint64), none, none, none, None
    data = np.frombuffer(raw, np.uint8)
    (h,) = rolling(data, GRAM)
    at, first, last = sample_points(data, h)
    keys = h[at]
    repeated = repeats_within(data, raw) if len(np.unique(keys)) < len(keys) else None
    if repeated is not None:
        fresh = np.r_[False, ~repeated, False]
        owner = np.repeat(np.arange(len(at)), last - first)
        begin = fresh[1:-1] & (~fresh[:-2] | np.r_[True, owner[1:] != owner[:-1]])
        end = fresh[1:-1] & (~fresh[2:] | np.r_[owner[1:] != owner[:-1], True])
        first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
        own = owner[first]
        at, keys = at[own], keys[own]
    return keys, at, first, last, repeated


# --- first pass: buckets of more than one text -----------------------------------------------------------------------


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, unit, ord) for the sample points of segments; a task leaves out a copy of what it has seen from no later row."""
    seen: dict[int, int] = {}
    for b in pieces(batches, _BATCH):
        keys, units, ords = [], [], []
        for unit, order, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), cells(b.column(2)), strict=True):
            if len(raw) < LENGTH or seen.get(unit, 1 << 63) <= order:
                continue
            seen[unit] = order
            k = np.unique(points_of(raw)[0])
            keys.append(k)
            units.append(np.full(len(k), unit, np.int64))
            ords.append(np.full(len(k), order, np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(units)), pa.array(np.concatenate(ords))], names=["key", "unit", "ord"])


def _shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, unit, ord): the first of each (key, unit) whose key has more units. One row is carried over."""
    held: list[np.ndarray] = [np.empty(0, np.int64)] * 3
    out_already = False
    for b in batches:
        rows = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, b.columns, strict=True)]
        if not len(rows[0]):
            continue
        fresh = np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]
        carried = len(held[0]) > 0
        key, unit, order = (r[fresh] for r in rows)
        same = key[1:] == key[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        last_out = bool(keep[-1]) or (carried and len(key) == 1 and out_already)
        if carried and out_already:
            keep[0] = False
        held, out_already = [key[-1:], unit[-1:], order[-1:]], last_out
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, unit, order)], names=["key", "unit", "ord"])


# --- second pass: windows of shared buckets --------------------------------------------------------------------------

_PIECES = "key long, ord long, unit long, at long, low int, high int, piece binary, begin int, done int"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each sample point of a shared bucket.

    at: place of the sample point in the text. low, high: least and most distance of a window's start before it.
    begin: the piece's first byte, as the column of a row of _WIDTH bytes in which the sample point is column REACH.
    done: how many bytes beyond the gram the key covers.
    """
    for b in pieces(batches, _BATCH):
        out: list[tuple] = []
        for unit, order, offset, raw, wanted in zip(*(b.column(k).to_pylist() for k in range(3)), cells(b.column(3)), b.column(4).to_pylist(), strict=True):
            keys, at, first, last, _ = points_of(raw)
            take = np.isin(keys.view(np.int64), np.array(wanted, np.int64))
            for k, p, a, z in zip(*(x[take].tolist() for x in (keys.view(np.int64), at, first, last)), strict=True):
                out.append((k, order, unit, offset + p, p - z + 1, p - a, raw[a : z - 1 + LENGTH], REACH - (p - a), 0))
        yield _frame(out)


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=["key", "ord", "unit", "at", "low", "high", "piece", "begin", "done"])


def _ranks(keys: np.ndarray, rows: np.ndarray, lengths: range) -> Iterator[np.ndarray]:
    """For each length, numbers of the classes of rows that agree in key and in so many first bytes, by one sort."""
    n, width = rows.shape
    order = np.argsort(np.concatenate([keys.astype(">u8").view(np.uint8).reshape(n, 8), rows], axis=1).view(f"S{8 + width}").ravel(), kind="stable")
    sorted_rows, sorted_keys = rows[order], keys[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[sorted_keys[1:] != sorted_keys[:-1]] = -1
    for length in lengths:
        out = np.zeros(n, np.int64)
        out[order[1:]] = np.cumsum(common < length)
        yield out


def marked(keys: np.ndarray, low: np.ndarray, high: np.ndarray, begin: np.ndarray, pieces_: list[bytes]) -> np.ndarray:
    """[row, d]: whether the window that starts d bytes before the row's sample point equals one of an earlier row.

    Rows must come in the order of (document, start); equal keys are one bucket.
    """
    n = len(keys)
    lengths = np.fromiter(map(len, pieces_), np.int64, n)
    grid = np.zeros(n * _WIDTH, np.uint8)
    ends = np.cumsum(lengths)
    grid[np.arange(int(ends[-1])) + np.repeat(np.arange(n) * _WIDTH + begin - (ends - lengths), lengths)] = np.frombuffer(b"".join(pieces_), np.uint8)
    grid = grid.reshape(n, _WIDTH)
    unsigned = keys.view(np.uint64)
    suffixes = list(_ranks(unsigned, np.ascontiguousarray(grid[:, REACH:]), range(GRAM, LENGTH + 1)))  # [k]: GRAM + k bytes
    out = np.zeros((n, REACH + 1), bool)
    for d, prefix in enumerate(_ranks(unsigned, np.ascontiguousarray(grid[:, REACH - 1 :: -1]), range(REACH + 1))):
        rows = np.flatnonzero((low <= d) & (d <= high))
        if len(rows) < 2:
            continue
        code = np.sort((prefix[rows] * n + suffixes[REACH - d][rows]) * n + rows)
        later = code[1:] // n == code[:-1] // n
        out[code[1:][later] % n, d] = True
    return out


def _spans(order: np.ndarray, unit: np.ndarray, at: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
    """(ord, unit, start, end) of the runs of marked windows."""
    padded = np.zeros((len(marks), marks.shape[1] + 2), bool)
    padded[:, 1:-1] = marks
    row, far = np.nonzero(padded[:, 1:-1] & ~padded[:, 2:])  # the greatest distance: the first start
    row2, near = np.nonzero(padded[:, 1:-1] & ~padded[:, :-2])
    assert (row == row2).all()
    return pa.RecordBatch.from_arrays([pa.array(order[row]), pa.array(unit[row]), pa.array(at[row] - far), pa.array(at[row] - near + LENGTH)], names=["ord", "unit", "start", "end"])


def split(row: tuple) -> list[tuple]:
    """A row of a large bucket as rows of finer ones: by more bytes on the right for windows that have them, else on the left.

    A window d before its point has d bytes on the left and REACH - d behind the gram. The key covers `left` and `right`
    of these, packed in done as left + 128 * right; half of what is open is added on one side.
    """
    key, order, unit, at, low, high, piece, begin, done = row
    left, right = done % 128, done // 128
    step = (REACH - left - right + 1) // 2
    out = []
    for side, a, z in (("r", low, min(high, REACH - right - step)), ("l", max(low, REACH - right - step + 1), high)):
        if a > z:
            continue
        c = REACH + GRAM + right if side == "r" else REACH - left - step
        text = piece[c - begin : c - begin + step]
        new = left + 128 * (right + step) if side == "r" else left + step + 128 * right
        digest = hashlib.blake2b(b"%d %s %d " % (key, side.encode(), done) + text, digest_size=8).digest()
        out.append((int.from_bytes(digest, "little", signed=True), order, unit, at, a, z, piece, begin, new))
    return out


_OUT = "ord long, unit long, start long, end long"


def _sorted_buckets(max_bucket: int, block: int):
    """From rows sorted by key: spans (piece null), and the split rows of buckets beyond max_bucket (start null)."""

    def joined(spans: pa.RecordBatch | None, rest: list[tuple]) -> pa.RecordBatch:
        more = _frame(rest)
        n, m = (spans.num_rows if spans else 0), more.num_rows
        columns = []
        for name in ("ord", "unit"):
            columns.append(pa.concat_arrays([*([spans.column(name)] if spans else []), more.column(name)]))
        for name in ("start", "end"):
            columns.append(pa.concat_arrays([*([spans.column(name)] if spans else []), pa.nulls(m, pa.int64())]))
        for name in ("key", "at", "low", "high", "piece", "begin", "done"):
            columns.append(pa.concat_arrays([pa.nulls(n, more.column(name).type), more.column(name)]))
        return pa.RecordBatch.from_arrays(columns, names=["ord", "unit", "start", "end", "key", "at", "low", "high", "piece", "begin", "done"])

    def solve(rows: pa.Table) -> pa.RecordBatch:
        key, order, unit, at = (rows.column(k).to_numpy() for k in range(4))
        place = np.lexsort((at, unit, order))
        place = place[np.r_[True, (order[place][1:] != order[place][:-1]) | (unit[place][1:] != unit[place][:-1]) | (at[place][1:] != at[place][:-1]) | (key[place][1:] != key[place][:-1]) | (rows.column(4).to_numpy()[place][1:] != rows.column(4).to_numpy()[place][:-1])]]
        held = cells(rows.column(6))
        marks = marked(key[place], rows.column(4).to_numpy()[place], rows.column(5).to_numpy()[place], rows.column(7).to_numpy()[place].astype(np.int64), [held[i] for i in place.tolist()])
        return _spans(order[place], unit[place], at[place], marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, open_key = 0, None

        def rows_of(t: pa.Table) -> list[tuple]:
            return [x for row in zip(*(c.to_pylist() for c in t.columns), strict=True) for x in split(row)]

        for b in batches:
            for part in (b.slice(i, block) for i in range(0, b.num_rows, block)):
                held.append(part)
                count += part.num_rows
                if count < block:
                    continue
                t = pa.Table.from_batches(held)
                keys = t.column(0).to_numpy()
                begin = 0
                if open_key is not None:
                    begin = len(keys) if keys[-1] == open_key else int(np.argmax(keys != open_key))
                    if begin:
                        yield joined(None, rows_of(t.slice(0, begin)))
                    open_key = open_key if begin == len(keys) else None
                if begin < len(keys):
                    tail = begin + int(np.flatnonzero(np.r_[True, keys[begin + 1 :] != keys[begin:-1]])[-1])
                    if tail > begin:
                        yield joined(solve(t.slice(begin, tail - begin)), [])
                    rest = t.slice(tail)
                    if rest.num_rows > max_bucket:
                        open_key = int(keys[-1])
                        yield joined(None, rows_of(rest))
                        rest = rest.slice(rest.num_rows)
                else:
                    rest = t.slice(len(keys))
                held, count = rest.to_batches(), rest.num_rows
        if count:
            t = pa.Table.from_batches(held)
            keys = t.column(0).to_numpy()
            begin = 0
            if open_key is not None:
                begin = len(keys) if keys[-1] == open_key else int(np.argmax(keys != open_key))
            if begin:
                yield joined(None, rows_of(t.slice(0, begin)))
            if begin < len(keys):
                yield joined(solve(t.slice(begin)), [])

    return run


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that cover whole windows, sorted by (key, ord, unit, at): all rows but the first of each key are marked."""
    before: int | None = None
    first: tuple | None = None
    for b in batches:
        key, order, unit, at, low = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        fresh = np.r_[before is None or key[0] != before, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
        heads = [(int(order[i]), int(unit[i]), int(at[i] - low[i])) if i >= 0 else first for i in lead.tolist()]
        own = list(zip(order.tolist(), unit.tolist(), (at - low).tolist(), strict=True))
        take = np.array([h != o for h, o in zip(heads, own, strict=True)], bool)
        if len(key):
            before, first = int(key[-1]), heads[-1]
        start = (at - low)[take]
        yield pa.RecordBatch.from_arrays([pa.array(order[take]), pa.array(unit[take]), pa.array(start), pa.array(start + LENGTH)], names=["ord", "unit", "start", "end"])


# --- tables ----------------------------------------------------------------------------------------------------------


def _release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files whose frames are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _segments(docs: DataFrame) -> DataFrame:
    """(unit, ord, base, raw): a row for each segment of each text of 100 bytes or more. ord: doc_id, null as the last."""
    body = F.encode("text", "UTF-8")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("ord"), F.xxhash64("text").alias("same"), body.alias("body"), F.octet_length("text").alias("n")).filter(F.col("n") >= LENGTH)
    cut = rows.select("ord", "same", "body", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - LENGTH) / F.lit(SEGMENT)).cast("int"))).alias("segment"))
    raw = F.expr(f"CASE WHEN segment = 0 AND length(body) <= {SEGMENT + LENGTH - 1} THEN body ELSE substring(body, segment * {SEGMENT} + 1, {SEGMENT + LENGTH - 1}) END")
    unit = F.when(F.col("segment") == 0, F.col("same")).otherwise(F.xxhash64("same", "segment"))
    return cut.select(unit.alias("unit"), "ord", (F.col("segment").cast("long") * SEGMENT).alias("base"), raw.alias("raw"), "same")


def repeated_spans(docs: DataFrame, max_bucket: int = MAX_BUCKET, block: int = BLOCK) -> DataFrame:
    """(same, ord, start, end): byte spans of windows that start earlier in another segment, of the first of exact copies."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    parts = _segments(docs)
    wanted = parts.select("unit", "ord", "raw").mapInArrow(_bucket_rows, "key long, unit long, ord long").repartition("key").sortWithinPartitions("key", "unit", "ord").mapInArrow(_shared_buckets, "key long, unit long, ord long")
    lists = stored(wanted.groupBy("unit", "ord").agg(F.collect_list("key").alias("keys")), folder, "buckets")
    del wanted
    _release(spark)
    rows = parts.join(lists, ["unit", "ord"]).select("unit", "ord", "base", "raw", "keys").mapInArrow(_pieces, _PIECES)
    found = None
    for level in range(9):
        sorted_ = rows.repartition("key").sortWithinPartitions("key", "ord", "unit", "at")
        if level == 8:
            spans = stored(sorted_.mapInArrow(_first_of_each, _OUT), folder, f"spans{level}")
            found = found.unionByName(spans)
            break
        names = "ord long, unit long, start long, end long, key long, at long, low int, high int, piece binary, begin int, done int"
        both = stored(sorted_.mapInArrow(_sorted_buckets(max_bucket, block), names), folder, f"spans{level}")
        spans = both.filter("start IS NOT NULL").select("ord", "unit", "start", "end")
        found = spans if found is None else found.unionByName(spans)
        large = both.filter("start IS NULL")
        del rows, sorted_
        _release(spark)
        if large.isEmpty():
            break
        rows = large.select("key", "ord", "unit", "at", "low", "high", "piece", "begin", "done")
    return found


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, copy, starts, ends: the text without the spans, its own repeats included."""
    for b in pieces(batches, _BATCH):
        out = []
        for t, copy, starts, ends in zip(cells(b.column(1)), *(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            raw = t or b""
            n = len(raw)
            if n < LENGTH:
                out.append((n, 0, 0, raw))
                continue
            if copy:
                out.append((n, n, 1, b""))
                continue
            spans = list(zip(starts or [], ends or [], strict=True))
            for base in range(0, n - LENGTH + 1, SEGMENT):
                repeated = points_of(raw[base : base + SEGMENT + LENGTH - 1])[4]
                if repeated is not None:
                    edge = np.flatnonzero(np.diff(np.r_[0, repeated.view(np.int8), 0]))
                    spans += [(base + a, base + z - 1 + LENGTH) for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            runs: list[list[int]] = []
            for a, z in sorted(spans):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(z, runs[-1][1])
                else:
                    runs.append([a, z])
            kept, at = [], 0
            for a, z in runs:
                kept.append(raw[at:a])
                at = z
            kept.append(raw[at:])
            out.append((n, sum(z - a for a, z in runs), len(runs), b"".join(kept)))
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame, max_bucket: int = MAX_BUCKET, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for each row of docs (doc_id, text).

    Null and empty texts, and those under 100 bytes, keep all they have. Documents are ordered by doc_id, a null id
    behind all others; where rows share an id, by a hash of the text. Rows that repeat id and text are one document and
    get the same result. Other columns are not read; an empty table gives no rows.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = repeated_spans(docs, max_bucket, block)
    spans = found.groupBy("unit", "ord").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    whole = docs.select(order.alias("ord"), F.xxhash64("text").alias("same"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), F.octet_length("text").alias("n")).filter(F.col("n") >= LENGTH)
    firsts = whole.groupBy("sha").agg(F.min("ord").alias("first"))
    copies = whole.join(firsts, "sha").filter(F.col("ord") > F.col("first")).select("same", "ord").distinct()
    # Spans of later segments go under a hash of text and segment: bring them back to the text.
    segments = whole.filter(F.col("n") >= LENGTH + SEGMENT).select("same", "ord", F.explode(F.sequence(F.lit(1), F.floor((F.col("n") - LENGTH) / F.lit(SEGMENT)).cast("int"))).alias("segment")).distinct()
    later = segments.select(F.xxhash64("same", "segment").alias("unit"), "ord", "same")
    by_text = spans.join(later, ["unit", "ord"], "left").select(F.coalesce("same", "unit").alias("same"), "ord", "spans")
    facts = by_text.select("same", "ord", "spans", F.lit(False).alias("copy")).unionByName(copies.select("same", "ord", F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(True).alias("copy")))
    facts = facts.groupBy("same", "ord").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.max("copy").alias("copy"))
    facts = stored(facts, shared_dir(docs.sparkSession), "facts")
    _release(docs.sparkSession)
    rows = docs.select("doc_id", "text", order.alias("ord"), F.xxhash64("text").alias("same")).join(facts, ["same", "ord"], "left")
    return rows.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends")).mapInArrow(_result, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(texts(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
