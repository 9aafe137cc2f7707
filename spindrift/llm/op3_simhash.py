"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint is 64 bits from the XXH64 hashes of its word shingles. Fingerprints link at ``bits`` or fewer
differing bits. They are cut into bits // 2 + 1 segments, so few that one segment of a linked pair differs by at most
one bit. For each segment a fingerprint is indexed under the segment itself and under each variant with one bit as a
wildcard; equal keys meet and the pair is verified on all 64 bits.

Only distinct fingerprints are indexed, so copies cost nothing here. Of each key's links, a spanning forest is kept:
what is connected stays connected, and a large group of near copies gives as many links as it has fingerprints, not
their square. A key with more than ``max_group`` fingerprints is indexed again, under the key and deletion variants of
the shorter segments of the bits that the key leaves open, until each group is small or no bits are left to cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cells, checkpointed, pieces, table, texts
from .components import connected_components, joined_by_hub

SHINGLE = 3
BITS = 3
MAX_GROUP = 4096
SMALL = 64


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words than a shingle: one hash of them all; none: no hash."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    one = xxhash.xxh64_intdigest
    if n <= size:
        return np.array([one(joined, seed)], np.uint64)
    at = list(accumulate(map(len, words), lambda a, b: a + b + 1, initial=0))
    return np.array([one(joined[a : z - 1], seed) for a, z in zip(at, at[size:], strict=False)], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit k is 1 if more than half of the hashes have it."""
    n = len(hashes)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)]
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * total > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a long, a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            prints = np.array([fingerprint_of(shingle_hashes(t or b"", size)) for t in cells(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, print long")


# --- index -----------------------------------------------------------------------------------------------------------


def cut(free: int, parts: int) -> list[list[int]]:
    """The set bits of free, in order, in segments of nearly equal length."""
    at = [k for k in range(64) if free >> k & 1]
    return [at[len(at) * k // parts : len(at) * (k + 1) // parts] for k in range(parts)]


def _mask(at: list[int]) -> int:
    return sum(1 << k for k in at)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _keys(prints: np.ndarray, fixed: np.ndarray, segments: list[list[int]]) -> Iterator[tuple[np.ndarray, int]]:
    """Index keys (64-bit, from what is fixed so far, segment, wildcard and value), each with the bits that it covers.

    A collision of two keys only adds pairs, which the check on all bits drops.
    """
    for s, at in enumerate(segments):
        own = _mask(at)
        value = prints & np.uint64(own)
        for wild in (-1, *at):
            masked = value if wild < 0 else value & ~np.uint64(1 << wild)
            key = fixed ^ (masked + np.uint64((1 + 131 * s + wild) * 0xD6E8FEB86659FD93 % (1 << 64)))
            key = (key ^ (key >> np.uint64(29))) * _MIX
            yield key ^ (key >> np.uint64(32)), own


def _forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a group's distinct prints, compared block by block."""
    n = len(prints)
    root = np.arange(n)
    edges: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(0, n, 512):
        rows = prints[i : i + 512]
        near = np.bitwise_count(rows[:, None] ^ prints[None, i:]) <= bits
        for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            x, y = find(i + a), find(i + b)
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((int(prints[i + a]), int(prints[i + b])))
    return edges


def _thinned(edges: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of edges, so that near copies that meet under many keys leave few links."""
    root: dict[int, int] = {}
    out = []
    for a, b in edges.tolist():
        x, y = a, b
        while (r := root.get(x, x)) != x:
            root[x] = root.get(r, r)
            x = r
        while (r := root.get(y, y)) != y:
            root[y] = root.get(r, r)
            y = r
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _variants(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns]
            for free in np.unique(columns[2]).tolist():
                prints, fixed, _ = (c[columns[2] == np.uint64(free)] for c in columns)
                segments = cut(free, parts)
                for i in range(0, len(prints), 4096):
                    for key, own in _keys(prints[i : i + 4096], fixed[i : i + 4096], segments):
                        left = np.full(len(key), free & ~own, np.uint64)
                        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, prints[i : i + 4096], left)], names=["key", "print", "free"])

    return run


def _grouped(bits: int, max_group: int):
    """Rows sorted by key: links (a, b) within each key, thinned to a forest. The prints of keys beyond max_group come back as (a, key, free)."""

    def frame(a, b, key, free) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(np.asarray(b, np.uint64).view(np.int64)), pa.array(key, pa.int64()), pa.array(free, pa.int64())], names=["a", "b", "big", "free"])

    def solve(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        pairs = [np.empty((0, 2), np.uint64)]
        few = np.repeat(sizes <= SMALL, sizes)
        small_keys, small = keys[few], prints[few]
        for d in range(1, int(sizes[sizes <= SMALL].max(initial=1))):  # all groups at once, by distance within the group
            x, y = small[:-d], small[d:]
            near = (small_keys[:-d] == small_keys[d:]) & (np.bitwise_count(x ^ y) <= bits) & (x != y)
            pairs.append(np.stack([np.minimum(x[near], y[near]), np.maximum(x[near], y[near])], axis=1))
        edges = np.unique(np.concatenate(pairs), axis=0)
        edges = _thinned(edges) if len(edges) > 1 else edges.tolist()
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            edges += _forest(np.unique(prints[s : s + n]), bits)
        if edges:
            yield frame([x for x, _ in edges], [y for _, y in edges], [None] * len(edges), [None] * len(edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, free = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        open_key: int | None = None  # a large group whose first rows are out already

        def large(n: int) -> pa.RecordBatch:
            return frame(prints[:n], np.zeros(n, np.uint64), keys[:n], free[:n])

        for b in batches:
            keys, prints, free = (np.concatenate([x, c.to_numpy(zero_copy_only=False).view(x.dtype)]) for x, c in zip((keys, prints, free), b.columns, strict=True))
            while len(keys):
                same = len(keys) if keys[-1] == keys[0] else int(np.argmax(keys != keys[0]))
                if keys[0] == open_key or same > max_group:
                    open_key = int(keys[0])
                    yield large(same)
                    keys, prints, free = keys[same:], prints[same:], free[same:]
                    continue
                if same == len(keys):
                    break
                starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                sizes = np.diff(np.r_[starts, len(keys)])
                over = np.flatnonzero(sizes > max_group)
                ready = int(starts[over[0]]) if len(over) else int(starts[-1])
                yield from solve(keys[:ready], prints[:ready])
                keys, prints, free = keys[ready:], prints[ready:], free[ready:]
        if len(keys):
            yield from solve(keys, prints)

    return run


def links(prints: DataFrame, bits: int = BITS, max_group: int = MAX_GROUP) -> DataFrame:
    """(a, b): links between distinct fingerprints (column print) that connect all that are within ``bits``."""
    parts, width = bits // 2 + 1, 64
    level = prints.select("print", F.lit(0).cast("long").alias("fixed"), F.lit(-1).cast("long").alias("free"))
    found = None
    while True:
        last = width <= 16  # so few bits are left open that a group is bounded by their number
        keys = level.mapInArrow(_variants(parts), "key long, print long, free long")
        rows = checkpointed(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_grouped(bits, 1 << 62 if last else max_group), "a long, b long, big long, free long"))
        part = rows.filter(F.col("big").isNull()).select("a", "b")
        found = part if found is None else found.unionByName(part)
        large = rows.filter(F.col("big").isNotNull())
        if last or large.isEmpty():
            return found.distinct()
        level = large.select(F.col("a").alias("print"), F.col("big").alias("fixed"), "free").distinct()
        width -= 64 // parts if parts > 2 else width // 2


def components(docs: DataFrame, size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, print, component_id for each row of docs (doc_id, text); component_id is the smallest id reachable.

    Null, empty and blank texts have fingerprint zero and link like any other. Rows with a null doc_id get the smallest
    id that is not null in their component, or null. Repeated rows give repeated rows. Other columns are not read.
    """
    rows = checkpointed(fingerprints(docs, size))
    prints = rows.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    edges = links(prints, bits)
    roots = connected_components(edges)
    named = prints.join(roots, prints["print"] == roots["node"], "left").select("print", "first_id", F.coalesce("root", "print").alias("root"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = joined_by_hub(named, ids, "root").select("print", "component_id")
    return joined_by_hub(rows, labels, "print").select("doc_id", "print", "component_id")


def hexadecimal(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(texts(table(spark, sf_dir, "documents"), "doc_id", "text")).select("doc_id", hexadecimal("print").alias("fingerprint"), "component_id")
