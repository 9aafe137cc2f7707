"""Quality rules: per-document rules and cross-document line frequency.

Lines are normalised (A-Z lowered, white space collapsed, ASCII digits as 0) and hashed. For every host and line the
distinct documents are counted. A line above the limit is removed, and a document that loses more than its share of
words is rejected as depleted.

What counts as one document: exact copies are one text. A line in more than ``max_docs_per_host`` distinct texts is
frequent. Of a text that holds frequent lines, the rest is its own, but for lines that are near a frequent one (edited
copies of it). A text whose own words are more than ``own_share`` of it is a document told apart by its own lines,
however much of it is shared. Any other differs from the frequent lines in a few words only, and is told apart by one of
its frequent lines: many edited copies of a clean document are one document or a few, and do not make the document's own
lines boilerplate before near-duplicate removal can keep one of them. A line goes if more than the limit of such
documents hold it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cells, dropped, pieces, shared_dir, signed, stored, table, texts

SYMBOLS = b"#*$%&|<>"
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_CONTINUATION = bytes(range(0x80, 0xC0))
#: Samples of a line by which near lines are known.
MINIMA = 6
#: Texts that a worker remembers, so that exact copies give their lines once a task.
REMEMBERED = 200_000
#: Rows of two or three numbers that are broadcast whatever the session's threshold.
FEW = 100_000
#: Longs of the bitmap that tells the lines of wanted texts from most others before they are shuffled.
SLOTS = 1 << 18


@dataclass(frozen=True)
class QualityPolicy:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_docs_per_host: int = 30
    max_removed_share: float = 0.7
    own_share: float = 0.05


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.lower().translate(_DIGITS).split())


def text_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def line_minima(lines: list[bytes]) -> np.ndarray:
    """For each line (one word at least), the least hash of its three-word shingles under each of MINIMA mixings.

    Lines that differ in a few words mostly share one. A line of fewer words is a shingle of its own.
    """
    sizes = np.array([x.count(b" ") + 1 for x in lines])
    crc = np.array([zlib.crc32(w) for x in lines for w in x.split(b" ")], np.uint64) + np.uint64(1)
    ends = np.cumsum(sizes)
    line_of = np.repeat(np.arange(len(lines)), sizes)
    at = np.arange(len(crc))
    shingle = crc.copy()
    for k in (1, 2):
        inside = np.minimum(at + k, len(crc) - 1)
        ok = (at + k < len(crc)) & (line_of[inside] == line_of)
        shingle = shingle * np.uint64(0x9E3779B97F4A7C15) + np.where(ok, crc[inside], np.uint64(0))
    last = ends[line_of] - at < 3  # shingles cut by the line's end count only where they are its first
    starts = ends - sizes
    last[starts] = False
    out = np.empty((MINIMA, len(lines)), np.uint64)
    for k in range(MINIMA):
        x = (shingle ^ np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(29)
        x[last] = np.uint64((1 << 64) - 1)
        out[k] = np.minimum.reduceat(x, starts)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def base_figures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.translate(None, _CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            at = np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=n - 2)
            hit = np.zeros(n, dtype=bool)
            for k in range(3):
                hit[k : n - 2 + k] |= at
            repeat = int(hit.sum())
    return n, chars, symbols, dup, repeat


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        rows = [(*base_figures(t or b""), text_key(t or b"")) for t in cells(b.column(2))]
        out = np.array(rows, dtype=np.uint64).reshape(-1, 6).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(out[:, k]) for k in range(6)]], names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_key"])


NEAR = [f"near{k}" for k in range(MINIMA)]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct line with a word of each text, with the words that all its occurrences hold."""
    seen: set[tuple[str, int]] = set()
    for b in pieces(batches):
        at: list[int] = []
        line: list[int] = []
        words: list[int] = []
        keys: list[int] = []
        near: list[np.ndarray] = [np.empty((MINIMA, 0), np.int32)]
        for i, (host, t) in enumerate(zip(b.column(0).to_pylist(), cells(b.column(1)), strict=True)):
            key = text_key(t or b"")
            if not t or (host, key) in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add((host, key))
            found: dict[bytes, int] = {}
            for x in t.split(b"\n"):
                if y := normal_line(x):
                    found[y] = found.get(y, 0) + y.count(b" ") + 1
            if not found:
                continue
            n = len(found)
            at += [i] * n
            line += [xxhash.xxh3_64_intdigest(x) for x in found]
            words += found.values()
            keys += [key] * n
            near.append(line_minima(list(found)))
        columns = [b.column(0).take(pa.array(at, pa.int64())), *[pa.array(signed(x)) for x in (line, words, keys)], *map(pa.array, np.concatenate(near, axis=1))]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "line", "words", "text_key", *NEAR])


def _host(docs: DataFrame):
    return F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host")


def document_lines(docs: DataFrame) -> DataFrame:
    return docs.select(_host(docs), F.col("text")).mapInArrow(_lines, "host string, line long, words long, text_key long, " + ", ".join(f"{c} int" for c in NEAR))


def _above(rows: DataFrame, member: str, policy: QualityPolicy) -> DataFrame:
    """(host, line) with more than so many distinct members. Both steps combine on the map side, so no host or line fills a task."""
    return rows.select("host", "line", member).distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > policy.max_docs_per_host).select("host", "line")


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """rows for the smaller side of a join: n of them at most, broadcast where these are few."""
    return F.broadcast(rows) if n <= FEW else rows


def possible(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows but most of those whose text_key is not in keys (text_key); none whose is. For the exact join behind it, which then shuffles less.

    The bitmap has a bit for some 16 million values of text_key, whatever the number of keys: at most SLOTS rows are broadcast.
    """
    slot = (F.shiftright("text_key", 6).bitwiseAND(F.lit(SLOTS - 1))).alias("slot")
    bit = F.expr("shiftleft(1L, cast(text_key & 63 as int))")
    bits = keys.groupBy(slot).agg(F.bit_or(bit).alias("bits"))
    found = rows.withColumn("slot", slot).join(F.broadcast(bits), "slot").filter(F.col("bits").bitwiseAND(bit) != 0)
    return found.select(*rows.columns)


def near_frequent(rest: DataFrame, many: DataFrame, n_many: int) -> DataFrame:
    """(host, line, label) of the lines of rest that share a sample with a line of many, and the least of these.

    One side of the join has a row for each host and sample, so no two lists meet in full.
    """
    spread = lambda rows: rows.groupBy("host", "line").agg(F.array(*[F.first(c) for c in NEAR]).alias("near")).select("host", "line", F.posexplode("near").alias("k", "value"))
    least = spread(many).groupBy("host", "k", "value").agg(F.min("line").alias("label"))
    return spread(rest).join(_sent(least, MINIMA * n_many), ["host", "k", "value"]).groupBy("host", "line").agg(F.min("label").alias("label"))


def documents_of(held: DataFrame, many: DataFrame, n_many: int, policy: QualityPolicy) -> DataFrame:
    """(host, text_key, document) of the texts of held (all lines of texts that hold a line of many): what tells documents apart."""
    flagged = held.join(_sent(many.withColumn("many", F.lit(True)), n_many), ["host", "line"], "left")
    rest = flagged.filter("many IS NULL")
    labels = near_frequent(rest, flagged.filter("many"), n_many)
    frequent = flagged.filter("many").select("host", "text_key", "words", F.col("line").alias("label"), F.lit(None).cast("long").alias("own"))
    others = rest.select("host", "text_key", "line", "words").join(labels, ["host", "line"], "left").select("host", "text_key", "words", "label", F.when(F.col("label").isNull(), F.col("line")).alias("own"))
    sums = frequent.unionByName(others).groupBy("host", "text_key").agg(
        F.sum("words").alias("words"), F.sum(F.when(F.col("own").isNotNull(), F.col("words"))).alias("own_words"), F.min(F.xxhash64("label")).alias("shared"), F.expr("bit_xor(xxhash64(own)) FILTER (WHERE own IS NOT NULL)").alias("own")
    )
    return sums.select("host", "text_key", F.when(F.coalesce("own_words", F.lit(0)) > policy.own_share * F.col("words"), F.col("own")).otherwise(F.col("shared")).alias("document"))


def frequent_lines(lines: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """(host, line) of the lines above the limit. Only lines in so many distinct texts, and the texts that hold them, are looked at closer."""
    folder = shared_dir(lines.sparkSession)
    many = stored(_above(lines, "text_key", policy), folder, "many")
    n_many = many.count()
    # wanted is distinct: an inner join, as a semi join would be pushed below that with the bitmap
    wanted = lines.join(_sent(many, n_many), ["host", "line"], "left_semi").select("host", "text_key").distinct()
    held = stored(possible(lines, wanted).join(wanted, ["host", "text_key"]).select(*lines.columns).dropDuplicates(["host", "text_key", "line"]), folder, "held")
    documents = documents_of(held, many, n_many, policy)
    counted = _above(held.select("host", "text_key", "line").join(_sent(many, n_many), ["host", "line"], "left_semi").join(documents, ["host", "text_key"]), "document", policy)
    found = stored(counted, shared_dir(lines.sparkSession), "frequent")
    dropped(lines.sparkSession, folder)
    return found


def _removed(docs: DataFrame, policy: QualityPolicy) -> tuple[DataFrame, DataFrame]:
    """Lines of each (host, text) that go, and the sums of their words."""
    folder = shared_dir(docs.sparkSession)
    lines = stored(document_lines(docs), folder, "lines")
    frequent = frequent_lines(lines, policy)
    hits = lines.join(_sent(frequent, frequent.count()), ["host", "line"], "left_semi").groupBy("host", "text_key", "line").agg(F.max("words").alias("words"))
    return hits, hits.groupBy("host", "text_key").agg(F.sum("words").alias("removed_words"))


def quality(docs: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """A row for each row of docs (doc_id, source, text): the figures, base_failed, removed_words and kept.

    A null text is empty (no words, so base_failed); a null source is a host of its own, the same as ''. Repeated rows
    are judged alike, each with its own row. Further columns of docs are not read. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    figures = docs.select("doc_id", _host(docs), "text").mapInArrow(_figures, f"doc_id {kind}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_key long")
    _, sums = _removed(docs, policy)
    failed = (F.col("n_words") < policy.min_words) | (100 * F.col("n_repeat_words") > policy.max_repeat_percent * F.col("n_words"))
    removed = F.coalesce(F.col("removed_words"), F.lit(0))
    return figures.join(sums, ["host", "text_key"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (removed <= policy.max_removed_share * F.col("n_words"))).alias("kept"), removed.alias("removed_words")
    )


def _clean(policy: QualityPolicy, text_at: int, n_at: int | None, kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            keep: list[int] = []
            out: list[str | None] = []
            for i, (t, gone) in enumerate(zip(cells(b.column(text_at)), b.column(b.num_columns - 1).to_pylist(), strict=True)):
                n, _, _, _, repeat = base_figures(t or b"")
                if n < policy.min_words or 100 * repeat > policy.max_repeat_percent * n:
                    continue
                if gone:
                    drop, removed, rest = set(gone), 0, []
                    for x in t.split(b"\n"):
                        y = normal_line(x)
                        if y and int(signed([xxhash.xxh3_64_intdigest(y)])[0]) in drop:
                            removed += y.count(b" ") + 1
                        else:
                            rest.append(x)
                    if removed > policy.max_removed_share * n:
                        continue
                    t = b"\n".join(rest)
                keep.append(i)
                out.append(None if t is None else t.decode("utf-8", "replace"))
            kept = b.take(pa.array(keep, pa.int64()))
            arrays = list(kept.columns[:-1])
            arrays[text_at] = pa.array(out, kinds[text_at])
            if n_at is not None:
                arrays[n_at] = pa.array([None if x is None else len(x) for x in out], kinds[n_at])
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names[:-1])

    return run


def clean(docs: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """docs (source, text and any other columns) without the rejected documents, and the rest without lines above the limit; n_chars renewed.

    A null text has no words, so it goes unless min_words is 0; then it stays null. A null source is a host like ''.
    Repeated rows are judged alike and stay repeated. Columns of any name are passed on untouched. An empty table stays
    empty.
    """
    own = [f"c{k}" for k in range(len(docs.columns))]
    named = docs.toDF(*own)
    text_at, n_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    hits, _ = _removed(texts(docs, "source", "text"), policy)
    lists = hits.groupBy("host", "text_key").agg(F.collect_list("line").alias("removed_lines"))
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(own, docs.schema, strict=True))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            keys = pa.array(signed([text_key(t or b"") for t in cells(b.column(text_at))]))
            yield pa.RecordBatch.from_arrays([*b.columns, keys], names=[*own, "text_key"])

    rows = named.mapInArrow(keyed, f"{schema}, text_key long").withColumn("host", F.coalesce(F.col(own[docs.columns.index("source")]).cast("string"), F.lit("")))
    joined = rows.join(lists, ["host", "text_key"], "left").select(*own, "removed_lines")
    kinds = [pa.int64() if k == n_at and f.dataType.simpleString() == "bigint" else pa.int32() if k == n_at else pa.string() for k, f in enumerate(docs.schema)]
    return joined.mapInArrow(_clean(policy, text_at, n_at, kinds), schema).toDF(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(texts(table(spark, sf_dir, "documents"), "doc_id", "source", "text"))
