"""Benchmark decontamination by one Aho-Corasick automaton.

Texts are normalised to words (A-Z lowered; every other ASCII character than a letter or digit parts words). The
automaton runs over sequences of words: its keys are the windows of the benchmark's items, as numbers of words, and a
text is scanned once as the numbers of its words. A match therefore ends at a word, and word numbers map back to code
points of the original text.

Windows are held in blocks of at most ``block_windows``; a benchmark beyond one block is scanned block by block and
the hits are united by text. So what is broadcast has a fixed bound whatever the benchmark's size.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cells, checkpointed, pieces, shared_dir, stored, table, texts

WINDOW = 10
BLOCK_WINDOWS = 200_000
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Code points of each word in the original text."""
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    return [m.span() for m in WORD.finditer(lower)]


def windows_of(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(win, item) for each distinct window of each item; item is the id as text, '' for a null id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item: list[str] = []
            win: list[bytes] = []
            for i, t in zip(b.column(0).to_pylist(), cells(b.column(1)), strict=True):
                found = windows_of(words_of(t or b""), size)
                win += found
                item += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(win, pa.binary()), pa.array(item, pa.string())], names=["win", "item"])

    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").mapInArrow(run, "win binary, item string").distinct()


class Automaton:
    """Windows with their items; built once in each Python worker."""

    def __init__(self, rows: list[tuple[bytes, str]]) -> None:
        items: dict[bytes, list[str]] = {}
        for win, item in rows:
            items.setdefault(bytes(win), []).append(item)
        self.numbers: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for win, own in items.items():
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in win.split(b" "))
            self.machine.add_word(key, (len(key), own))
        if items:
            self.machine.make_automaton()
        self.empty = not items

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs of hit words as (first, past the last), and the items."""
        if self.empty or not words:
            return [], set()
        numbers = tuple(map(self.numbers.get, words, repeat(0)))
        if not any(numbers):
            return [], set()
        found: set[str] = set()
        runs: list[tuple[int, int]] = []
        spans = []
        for end, (n, own) in self.machine.iter(numbers):
            spans.append((end - n + 1, end + 1))
            found.update(own)
        for a, z in sorted(spans):
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(z, runs[-1][1]))
            else:
                runs.append((a, z))
        return runs, found


_BUILT: dict[str, Automaton] = {}


class _Shared:
    """Broadcast windows under a name, by which a Python worker knows the automaton that it has built already."""

    def __init__(self, sc, windows: DataFrame) -> None:
        self.name = uuid.uuid4().hex
        self.rows = sc.broadcast([(bytes(w), i) for w, i in windows.select("win", "item").collect()])

    def automaton(self) -> Automaton:
        if self.name not in _BUILT:
            _BUILT.clear()
            _BUILT[self.name] = Automaton(self.rows.value)
        return _BUILT[self.name]

    def __getstate__(self):
        return self.name, self.rows

    def __setstate__(self, state) -> None:
        self.name, self.rows = state


_SCAN = "n_words long, text_key string, runs array<int>, items array<string>"


def _scan(shared, with_id: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.automaton()
        for b in pieces(batches):
            n, keys, runs, items = [], [], [], []
            for t in cells(b.column(b.num_columns - 1)):
                words = words_of(t or b"")
                hit, found = machine.scan(words)
                n.append(len(words))
                keys.append(xxhash.xxh3_128_hexdigest(t or b""))
                runs.append([x for r in hit for x in r])
                items.append(sorted(found))
            own = [pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*([b.column(0)] if with_id else []), *own], names=[*(["doc_id"] if with_id else []), "n_words", "text_key", "runs", "items"])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """runs: flat list of lists from several blocks, as one list of maximal runs."""
    for b in batches:
        out = []
        for flat in b.column(1).to_pylist():
            merged: list[list[int]] = []
            for a, z in sorted(zip(flat[::2], flat[1::2], strict=True)):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(z, merged[-1][1])
                else:
                    merged.append([a, z])
            out.append([x for r in merged for x in r])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32())), b.column(2)], names=["text_key", "runs", "items"])


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, text_key, runs (flat list of first and past-the-last word numbers), items: a row for each row of docs."""
    sc = docs.sparkSession.sparkContext
    windows = checkpointed(benchmark_windows(benchmark, size))
    blocks = max(1, -(-windows.count() // block_windows))
    rows = docs.select("doc_id", "text")
    if blocks == 1:
        return rows.mapInArrow(_scan(_Shared(sc, windows), True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCAN}")
    found = None
    for k in range(blocks):  # (win, item) pairs are dealt evenly by hash, so a block keeps to the bound
        part = windows.filter(F.pmod(F.xxhash64("win", "item"), F.lit(blocks)) == k)
        hits = rows.select("text").mapInArrow(_scan(_Shared(sc, part), False), _SCAN).filter(F.size("runs") > 0).dropDuplicates(["text_key"])
        found = hits if found is None else found.unionByName(hits)
    merged = (
        found.groupBy("text_key")
        .agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        .mapInArrow(_united, "text_key string, runs array<int>, items array<string>")
    )
    plain = rows.mapInArrow(_scan(_Shared(sc, windows.limit(0)), True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCAN}").select("doc_id", "n_words", "text_key")
    return plain.join(merged, "text_key", "left").select("doc_id", "n_words", "text_key", F.coalesce("runs", F.array().cast("array<int>")).alias("runs"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """A row for each row of docs (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; an empty benchmark hits nothing. Items with a null id hit words but
    are not listed. Repeated item ids are one item. Repeated rows of docs give repeated rows. Other columns are not read.
    """
    found = scan(docs, benchmark, size, block_windows)
    hit = F.expr("aggregate(sequence(0, size(runs) div 2), 0L, (s, i) -> s + coalesce(get(runs, 2 * i + 1) - get(runs, 2 * i), 0))")
    named = F.array_sort(F.filter("items", lambda x: x != ""))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size(named).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", named), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


def hit_spans(text: str, runs: list[int]) -> list[tuple[int, int]]:
    """Code points in the original text of each run of hit words."""
    at = word_spans(text)
    return [(at[a][0], at[z - 1][1]) for a, z in zip(runs[::2], runs[1::2], strict=True)]


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs without the contaminated documents; same columns."""
    windows = checkpointed(benchmark_windows(benchmark, size))
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    for k in range(blocks):
        docs = _without(docs, _Shared(docs.sparkSession.sparkContext, windows.filter(F.pmod(F.xxhash64("win", "item"), F.lit(blocks)) == k)))
        docs = stored(docs, shared_dir(docs.sparkSession), f"block{k}") if k + 1 < blocks else docs
    return docs


def _without(docs: DataFrame, shared: _Shared) -> DataFrame:
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.automaton()
        for b in pieces(batches):
            yield b.take(pa.array([i for i, t in enumerate(cells(b.column(at))) if not machine.scan(words_of(t or b""))[0]], pa.int64()))

    return docs.mapInArrow(run, docs.schema)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(texts(table(spark, sf_dir, "documents"), "doc_id", "text"), texts(table(spark, sf_dir, "benchmark"), "item_id", "text"))
