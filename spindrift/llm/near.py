"""Near-duplicate removal for a pipeline: texts whose five-word shingles have Jaccard similarity 0.8 or more.

At that similarity two plain 64-bit fingerprints differ by some ten bits, beyond an index whose cost stays in proportion
to the input. So candidates come from two indexes of deletion variants:

* the operator's own, links of fingerprints of all shingles within three bits (op3_simhash.links);
* one of letters. A letter is the fingerprint of a sample of one shingle, that with the least hash under a mixing of its
  own; two texts share a letter with a chance equal to their similarity. A segment of ``LETTERS`` letters is indexed
  with each letter as a wildcard in turn, so texts meet that differ by one letter of one of ``SEGMENTS`` segments at most:
  0.99 of the pairs at similarity 0.8. Unrelated texts share no three letters, so the pairs grow with the input alone.

Texts that meet compare ``SKETCH`` letters, a byte each. Of a small group all likely pairs are proposed, of a larger one
a spanning forest of the likeliest. A pair links if the similarity of the shingle sets, computed on the texts, is 0.8 or
more. If links that failed leave a group in parts, all its texts that have a likely pair with another part are compared
with each other, in blocks, by lists of the shingles: no pair is written but those that link, and none is left out.

A key held by over ``MAX_GROUP`` texts is indexed again together with the variants of SEGMENTS further segments, and a
third time if need be; each time 0.99 of the pairs at similarity 0.8 stay together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cells, checkpointed, dropped, pieces, shared_dir, stored, texts
from .components import connected_components, joined_by_hub
from .op3_simhash import BITS, fingerprint_of, links, shingle_hashes

SHINGLE, LEAST = 5, 0.8
SEGMENTS, LETTERS, LEVELS, SKETCH = 3, 4, 3, 240
#: Pairs with so many equal bytes of the sketch are tested: 3.5 standard deviations below what similarity 0.8 gives.
LIKELY = 170
SMALL, MAX_GROUP = 8, 8192
#: Bytes of text in a block of a group whose links have left it in parts.
BLOCK = 8 << 20
_MIXERS = np.random.default_rng(7).integers(1, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """SKETCH letters of a set of shingle hashes: the least under each mixing; all zero for no shingle."""
    out = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        x = hashes[i : i + 1024, None] * _MIXERS[None, :]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        out = np.minimum(out, x.min(axis=0))
    return out if len(hashes) else np.zeros(SKETCH, np.uint64)


def variant_keys(letters: np.ndarray) -> np.ndarray:
    """For each row of SEGMENTS * LETTERS letters, its deletion variants: each segment with each of its letters left out."""
    out = np.empty((len(letters), SEGMENTS * LETTERS), np.uint64)
    for s in range(SEGMENTS):
        for wild in range(LETTERS):
            key = np.full(len(letters), s * LETTERS + wild + 1, np.uint64)
            for k in range(LETTERS):
                if k != wild:
                    key = (key ^ letters[:, s * LETTERS + k]) * np.uint64(0xC2B2AE3D27D4EB4F)
                    key ^= key >> np.uint64(29)
            out[:, s * LETTERS + wild] = key
    return out


def _signed(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = SEGMENTS * LETTERS
        for b in pieces(batches):
            raw = [shingle_hashes(t or b"", SHINGLE) for t in cells(b.column(1))]
            letters = np.array([minima(np.unique(h)) for h in raw], np.uint64).reshape(-1, SKETCH)
            prints = np.array([fingerprint_of(h) for h in raw], np.uint64).view(np.int64)
            keys = variant_keys(letters[:, level * width : (level + 1) * width])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * width, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            sketch = [x.tobytes() for x in (letters >> np.uint64(40)).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(prints), keys, pa.array(sketch, pa.binary())], names=["doc_id", "t", "print", "keys", "sketch"])

    return run


def signatures(docs: DataFrame, level: int = 0) -> DataFrame:
    """doc_id, t (a 64-bit hash of the text), print, keys (of the level's segments) and sketch for each row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(_signed(level), f"doc_id {kind}, t long, print long, keys array<long>, sketch binary")


def bodies(docs: DataFrame, base: DataFrame, wanted: DataFrame, folder: str, name: str) -> DataFrame:
    """(t, text, doc_id) of one row of docs for each wanted t, as a table of its own, so that docs are read once for it.

    The wanted are stored first: their size is known then, and documents are not shuffled where it is small.
    """
    first = stored(base.join(wanted, "t", "left_semi").select(F.col("first_id").alias("i"), F.col("t").alias("h")), folder, f"{name}_wanted")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    return stored(rows.join(first, rows["doc_id"].eqNullSafe(first["i"]) & (rows["t"] == first["h"]), "left_semi").dropDuplicates(["t"]), folder, name)


# --- candidates ------------------------------------------------------------------------------------------------------


def _forest(sketches: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the likeliest pairs, grown from row to row; sketches: SKETCH by n."""
    n = sketches.shape[1]
    best, parent, done = np.zeros(n, np.uint8), np.zeros(n, np.int64), np.zeros(n, bool)
    out, at = [], 0
    for _ in range(n - 1):
        done[at] = True
        equal = np.add.reduce(sketches == sketches[:, at, None], axis=0, dtype=np.uint8)
        closer = (equal > best) & ~done
        best[closer], parent[closer] = equal[closer], at
        best[at] = 0
        at = int(best.argmax())
        if best[at] >= LIKELY:
            out.append((int(parent[at]), at))
        elif best[at] == 0:
            left = np.flatnonzero(~done)
            at = int(left[0])
    return out


def _across(sketches: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Whether each row has a likely pair with a row of another root."""
    found = np.zeros(len(roots), bool)
    for i in range(len(roots)):
        if not found[i]:  # any other row still looks at all rows itself
            equal = np.add.reduce(sketches == sketches[:, i, None], axis=0, dtype=np.uint8)
            likely = (equal >= LIKELY) & (roots != roots[i])
            found |= likely
            found[i] = likely.any()
    return found


_PAIRS = "a long, b long, key long"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Whole groups of rows sorted by key, a batch's worth at a time: keys, further columns of longs, sketches."""
    held: pa.Table | None = None
    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        keys = held.column("key").to_numpy()
        ready = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if ready:
            yield _columns(held.slice(0, ready))
            held = held.slice(ready)
    if held is not None and held.num_rows:
        yield _columns(held)


def _columns(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    return rows.column("key").to_numpy(), [rows.column(c).to_numpy() for c in rows.column_names if c not in ("key", "sketch")], sketches


def _frame(a, b, key) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (a, b)] + [pa.array(key, pa.int64())], names=["a", "b", "key"])


def _proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, key): likely pairs of rows (key, t, sketch) sorted by key; key is null where they are all of the group's."""
    for keys, (t,), sketches in _groups(batches):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        k, x, s = keys[few], t[few], sketches[few]
        for d in range(1, min(SMALL, len(k))):  # all small groups at once, by distance within the group
            at = np.flatnonzero(k[:-d] == k[d:])
            at = at[(s[at] == s[at + d]).sum(axis=1) >= LIKELY]
            if len(at):
                yield _frame(x[at], x[at + d], [None] * len(at))
        for i, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            own = t[i : i + n]
            edges = np.array(_forest(np.ascontiguousarray(sketches[i : i + n].T)), np.int64).reshape(-1, 2)
            if len(edges):
                yield _frame(own[edges[:, 0]], own[edges[:, 1]], [int(keys[i])] * len(edges))


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, t, root): the rows (key, t, root, sketch), sorted by key, that have a likely pair across roots of their group."""
    for keys, (t, root), sketches in _groups(batches):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for i, z in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            if z - i > 1 and (root[i:z] != root[i]).any():
                at = i + np.flatnonzero(_across(np.ascontiguousarray(sketches[i:z].T), root[i:z]))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (keys, t, root)], names=["key", "t", "root"])


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "t")


def keyed(docs: DataFrame, base: DataFrame, folder: str, max_group: int = MAX_GROUP) -> DataFrame:
    """(key, t, sketch): rows of base by deletion variant, but for keys of one text; keys with too many are indexed again."""
    level, done = base.select(F.explode("keys").alias("key"), "t"), None
    for step in range(1, LEVELS + 1):
        counts = checkpointed(level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        big = counts.filter(F.col("n") > max_group).select("key")
        last = step == LEVELS or big.isEmpty()
        part = level.join((counts if last else counts.filter(F.col("n") <= max_group)).select("key"), "key", "left_semi")
        done = part if done is None else done.unionByName(part)
        if last:
            return checkpointed(done.join(base.select("t", "sketch"), "t").select("key", "t", "sketch"))
        again = checkpointed(level.join(big, "key", "left_semi"))
        more = signatures(bodies(docs, base, again.select("t").distinct(), folder, f"level{step}"), step).select("t", F.explode("keys").alias("other"))
        level = checkpointed(again.join(more, "t").select(F.xxhash64("key", "other").alias("key"), "t"))


# --- links -----------------------------------------------------------------------------------------------------------


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct hashes; two empty ones are the same."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        known: dict[int, np.ndarray] = {}
        a, b, ok = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for row in zip(a, b, cells(batch.column(2)), cells(batch.column(3)), strict=True):
            for key, t in (row[::2], row[1::2]):
                if key not in known:
                    known[key] = np.unique(shingle_hashes(t or b"", SHINGLE))
            ok.append(jaccard(known[row[0]], known[row[1]]) >= LEAST)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])


def tested(pairs: DataFrame, company: DataFrame) -> DataFrame:
    """(a, b, ok) for pairs of texts (a, b) of company (t, text): whether the shingle sets of the texts are similar enough."""
    own = lambda key, text: company.select(F.col("t").alias(key), F.col("text").alias(text))
    return pairs.join(own("a", "ta"), "a").join(own("b", "tb"), "b").select("a", "b", "ta", "tb").mapInArrow(_tested, "a long, b long, ok boolean")


def _joined(sets: list[np.ndarray], roots: list[int], sides: np.ndarray) -> list[tuple[int, int]]:
    """Links between rows of different roots, by the similarity of all pairs; one for each two parts that they join.

    With two sides, only pairs of rows of both are looked at. A row meets the rows that share a shingle with it by the
    shingles' lists, which give the size of each intersection.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets])
    above: dict[int, int] = {r: r for r in roots}

    def top(r: int) -> int:
        while above[r] != r:
            above[r] = r = above[above[r]]
        return r

    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    by_code = np.argsort(code, kind="stable")
    holder = np.repeat(np.arange(n), sizes)[by_code]
    lengths = np.bincount(code)
    ends, at = np.cumsum(lengths), np.r_[0, np.cumsum(sizes)]
    number = {r: k for k, r in enumerate(above)}
    part = np.array([number[r] for r in roots])
    split, parts, out = bool((sides != sides[0]).any()), len(above), []
    for i in range(n):
        if parts == 1:
            break
        if split and sides[i]:
            continue
        own = code[at[i] : at[i + 1]]
        each = lengths[own]
        spots = np.repeat(ends[own] - np.cumsum(each), each) + np.arange(each.sum())
        both = np.bincount(holder[spots], minlength=n)
        either = sizes + sizes[i] - both
        near = np.where(either > 0, both / np.maximum(either, 1), 1.0) >= LEAST
        near &= (sides == 1) if split else (np.arange(n) > i)
        for j in np.flatnonzero(near & (part != part[i])).tolist():
            a, b = top(roots[i]), top(roots[j])
            if a != b:
                above[b] = a
                parts -= 1
                out.append((i, j))
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, ok): links across roots of rows (key, side, t, root, text) sorted by key; the text is kept as its shingles only."""
    now, held = None, []

    def links_of() -> Iterator[pa.RecordBatch]:
        found = _joined([x[3] for x in held], [x[2] for x in held], np.array([x[0] for x in held])) if len(held) > 1 else []
        if found:
            a, b = ([held[pair[k]][1] for pair in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([True] * len(a))], names=["a", "b", "ok"])

    for batch in pieces(batches):
        for key, side, t, root, text in zip(*[batch.column(k).to_pylist() for k in range(4)], cells(batch.column(4)), strict=True):
            if key != now:
                yield from links_of()
                now, held = key, []
            held.append((side, t, root, np.unique(shingle_hashes(text or b"", SHINGLE))))
    yield from links_of()


def linked_across(parted: DataFrame, company: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, ok): links that join different roots within the groups of parted (key, t, root), by all pairs of texts.

    A group is cut in blocks of so many bytes of text, and each two blocks of it (and each block by itself) are a task's
    work, so a large group is neither held nor looked through by one task.
    """
    sized = parted.join(company.select("t", (F.coalesce(F.octet_length("text"), F.lit(0)) + SKETCH).alias("bytes")), "t")
    blocks = checkpointed(sized.select("key", "t", "root", F.floor(F.sum("bytes").over(Window.partitionBy("key").orderBy("t")) / block).alias("block")))
    most = blocks.groupBy("key").agg(F.max("block").alias("last"))
    met = blocks.join(most, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    rows = met.select(F.xxhash64("key", low, high).alias("key"), (F.col("block") > F.col("other")).cast("int").alias("side"), "t", "root")
    return rows.join(company.select("t", "text"), "t").select("key", "side", "t", "root", "text").repartition("key").sortWithinPartitions("key").mapInArrow(_linked, "a long, b long, ok boolean")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def print_pairs(base: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): texts whose fingerprints are linked within ``bits``, each fingerprint by its first text; texts of one fingerprint by its first."""
    prints = base.groupBy("print").agg(F.min("t").alias("first"))
    found = links(prints.select("print"), bits)
    side = lambda key: prints.select(F.col("print").alias(key), F.col("first").alias(f"t{key}"))
    across = found.join(side("a"), "a").join(side("b"), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
    return across.unionByName(joined_by_hub(base.select("t", "print"), prints, "print").select(F.col("first").alias("a"), F.col("t").alias("b")))


def rooted(docs: DataFrame, folder: str, max_group: int = MAX_GROUP) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id and t of each row of docs, texts: t, first_id and root of each distinct text)."""
    base = stored(signatures(docs).groupBy("t").agg(F.min("doc_id").alias("first_id"), F.first("print").alias("print"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), folder, "base")
    rows = keyed(docs, base, folder, max_group)
    proposed = checkpointed(_sorted(rows).mapInArrow(_proposed, _PAIRS))
    pairs = checkpointed(_ordered(proposed.select("a", "b").unionByName(print_pairs(base))))
    thinned = checkpointed(rows.join(proposed.filter("key IS NOT NULL").select("key").distinct(), "key", "left_semi"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("t")).unionByName(thinned.select("t")).distinct()
    company = bodies(docs, base, wanted, folder, "company")
    links_ = checkpointed(tested(pairs, company))
    roots = connected_components(links_.filter("ok").select("a", "b"))
    label = roots.select(F.col("node").alias("t"), "root")
    live = thinned.join(label, "t", "left").select("key", "t", F.coalesce("root", "t").alias("root"), "sketch")
    parted = checkpointed(_sorted(live).mapInArrow(_parted, "key long, t long, root long"))
    if not parted.isEmpty():
        found = checkpointed(linked_across(parted, company))
        if not found.isEmpty():
            roots = connected_components(links_.filter("ok").unionByName(found).select("a", "b"))
    return docs.select("doc_id", F.xxhash64("text").alias("t")), base.select("t", "first_id").join(roots, F.col("t") == F.col("node"), "left").select("t", "first_id", F.coalesce("root", "t").alias("root"))


def near_components(docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """doc_id, root and component_id (the smallest id of the component) for each row of docs (doc_id, text).

    Null, empty and blank texts have no shingle and are one component. Exact copies are always in one. A component whose
    ids are all null has a null id. Repeated rows give repeated rows; other columns are not read.
    """
    rows, labelled = rooted(texts(docs, "doc_id", "text"), shared_dir(docs.sparkSession), max_group)
    ids = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = joined_by_hub(labelled.select("t", "root"), ids, "root")
    return joined_by_hub(rows, named, "t").select("doc_id", "root", "component_id")


def representatives(docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """docs (doc_id, text and any other columns) with one row of each component, that with the smallest doc_id.

    A component whose ids are all null keeps one row, and so do rows that repeat an id and a text; which of these is not
    defined. Null, empty and blank texts are one component. Columns of any name are passed on untouched. An empty table
    stays empty.
    """
    own = [f"c{k}" for k in range(len(docs.columns))]
    named = docs.toDF(*own)
    key, text = own[docs.columns.index("doc_id")], own[docs.columns.index("text")]
    folder = shared_dir(docs.sparkSession)
    ids, labelled = rooted(named.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), folder, max_group)
    best = labelled.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("i"), F.col("t").alias("h"))).alias("s")).select("s.i", "s.h")
    best = stored(best, shared_dir(docs.sparkSession), "best")
    twice = checkpointed(ids.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("i2"), F.col("t").alias("h2")))
    dropped(docs.sparkSession, folder)
    rows = named.withColumn("t", F.xxhash64(text))
    match = lambda right: rows[key].eqNullSafe(right["i"]) & (rows["t"] == right["h"])
    if twice.isEmpty():
        return rows.join(best, match(best), "left_semi").select(*own).toDF(*docs.columns)
    same = best["i"].eqNullSafe(twice["i2"]) & (best["h"] == twice["h2"])
    once, again = best.join(twice, same, "left_anti"), best.join(twice, same, "left_semi")
    kept = rows.join(once, match(once), "left_semi").unionByName(rows.join(again, match(again), "left_semi").dropDuplicates([key, "t"]))
    return kept.select(*own).toDF(*docs.columns)
