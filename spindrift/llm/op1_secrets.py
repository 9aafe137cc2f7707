"""Secret scans in DataFrame functions only.

Three patterns give the base spans. Beside them, candidate strings (runs of token characters) are scanned by a sliding
window. Its state holds the count of each symbol; the character that enters adds one, the character that leaves takes
one off, and the window's Shannon entropy follows from these two changes, as do the numbers of digits, lower-case and
upper-case letters, by which the window belongs to a character class. Windows at or above their class's threshold are
merged to spans. Spans that fit the allow-list (placeholders, sequences) and spans within a base span are suppressed.

Offsets are code points. A pattern's pieces and matches, cut by one expression each, give offsets by running sums;
the sums run over blocks of matches, and a candidate is scanned in blocks of characters, so a text with very many
matches or a very long candidate costs in proportion to its length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "entropy_base64", "entropy_hex", "entropy_lower", "entropy_upper", "entropy_letters")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[a-z+/_-]*[A-Z0-9])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Symbols of candidates: 10 digits, 26 lower-case and 26 upper-case letters, others.
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-="
_BLOCK, _CHARACTERS = 256, 512
_PACKED = 12  # counts in a long, five bits each


@dataclass(frozen=True)
class SecretPolicy:
    min_assigned: int = 8
    window: int = 20
    #: Bits of a window that holds upper and lower case and a digit.
    base64_bits: float = 3.9
    #: Of digits and letters a to f in one case.
    hex_bits: float = 3.0
    #: Of digits (4 at least, so that words with a number are none) and letters of one case.
    one_case_bits: float = 3.5
    #: Of letters alone, 6 at least of either case.
    letters_bits: float = 3.9
    #: Spans that these fit are no secrets.
    allow: tuple[str, ...] = (r"(?i)example|sample|dummy|placeholder|changeme|x{6,}|0{8,}|0123456789|1234567890|abcdefghij",)

    def __post_init__(self) -> None:
        if not 1 < self.window <= 31:
            raise ValueError("a window's counts are kept in five bits")


_SPAN = "array<struct<start:int,end:int,ok:boolean,found:string>>"


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end, ok, found>> of the leftmost non-overlapping matches; ok: group has least characters."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.zip_with(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda a, b: F.struct(a.alias("found"), (F.length(b) >= least).alias("ok")))
    items = F.zip_with(F.slice(gaps, 1, F.size(parts)), parts, lambda g, p: F.struct(F.length(g).alias("gap"), F.length(p["found"]).alias("size"), p["ok"].alias("ok"), p["found"].alias("found")))

    def block(chunk: Column) -> Column:
        """Spans within a block of matches, from 0, and the block's length."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

        def step(s: Column, x: Column) -> Column:
            a = s["at"] + x["gap"]
            z = a + x["size"]
            return F.struct(z.alias("at"), F.concat(s["out"], F.array(F.struct(a.alias("start"), z.alias("end"), x["ok"].alias("ok"), x["found"].alias("found")))).alias("out"))

        return F.aggregate(chunk, start, step)

    def whole(all_items: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / F.lit(_BLOCK)).cast("int")), lambda c: block(F.slice(all_items, c * _BLOCK + 1, _BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

        def step(s: Column, c: Column) -> Column:
            moved = F.transform(c["out"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), (x["end"] + s["at"]).alias("end"), x["ok"].alias("ok"), x["found"].alias("found")))
            return F.struct((s["at"] + c["at"]).alias("at"), F.concat(s["out"], F.array(moved)).alias("out"))

        return F.flatten(F.aggregate(chunks, start, step)["out"])

    return F.when(text.rlike(pattern), bound(items, whole)).otherwise(F.array().cast(_SPAN))


def bound(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


_RUNS = "array<struct<a:int,z:int,kind:int>>"


def _class_of(digits: Column, lower: Column, upper: Column, low_hex: Column, up_hex: Column, bits: Column, policy: SecretPolicy) -> Column:
    """A window's kind, as its place in KINDS, if its bits reach the class's threshold; else -1."""
    w, letters = policy.window, lower + upper
    hexadecimal = (digits > 1) & (letters > 1) & ((digits + low_hex == w) | (digits + up_hex == w))
    return (
        F.when(hexadecimal, F.when(bits >= policy.hex_bits, 4).otherwise(-1))
        .when((upper > 1) & (lower > 1) & (digits > 0), F.when(bits >= policy.base64_bits, 3).otherwise(-1))
        .when((digits > 3) & (lower > 3) & (digits + lower == w), F.when(bits >= policy.one_case_bits, 5).otherwise(-1))
        .when((digits > 3) & (upper > 3) & (digits + upper == w), F.when(bits >= policy.one_case_bits, 6).otherwise(-1))
        .when((upper > 5) & (lower > 5) & (letters == w), F.when(bits >= policy.letters_bits, 7).otherwise(-1))
        .otherwise(-1)
    )


def _hot_runs(candidate: Column, policy: SecretPolicy) -> Column:
    """array<struct<a, z, kind>> of the merged hot windows of a candidate; a run has its first window's kind.

    Windows that overlap or touch are merged. The fold's state is the counts, the sum of k * log2(k) over them, and the
    open run; blocks come with the last window's characters of the block before, so what leaves is at hand.
    """
    w = policy.window
    weight = F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(w + 2)])
    number = F.array(*[F.lit(SYMBOLS.find(chr(k)) if chr(k) in SYMBOLS else len(SYMBOLS) - 1) for k in range(128)])
    f = lambda k: F.element_at(weight, k + 1)
    slot, unit, offset = (F.array(*[F.lit(x) for x in made]) for made in ([k // _PACKED for k in range(len(SYMBOLS))], [1 << 5 * (k % _PACKED) for k in range(len(SYMBOLS))], [5 * (k % _PACKED) for k in range(len(SYMBOLS))]))
    of = lambda table_, code: F.element_at(table_, code + 1)
    ends = lambda s: F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["z"].alias("z"), s["kind"].alias("kind"))).cast(_RUNS))

    def step(codes: Column, s: Column, i: Column) -> Column:
        new, full = F.element_at(codes, i), s["at"] >= w
        old = F.when(full, F.element_at(codes, F.when(full, i - w).otherwise(1)))

        def moved(x: Column) -> Column:
            """x: what enters, what leaves, and their counts before."""
            enters, leaves = x["new"], x["old"]
            kept = F.coalesce(x["n_old"], F.lit(0))
            same = F.coalesce(enters == leaves, F.lit(False))
            after = F.when(same, s["total"]).otherwise(s["total"] + f(x["n_new"] + 1) - f(x["n_new"]) + f(F.greatest(kept - 1, F.lit(0))) - f(kept))
            counts = F.when(same, s["counts"]).otherwise(F.transform(s["counts"], lambda c, k: c + F.when(k == x["slot_new"], x["unit_new"]).otherwise(0) - F.when(k == x["slot_old"], x["unit_old"]).otherwise(0)))

            def tally(name: str, low: int, high: int) -> Column:
                return (s[name] + enters.between(low, high).cast("int") - F.coalesce(leaves.between(low, high).cast("int"), F.lit(0))).alias(name)

            return F.struct((s["at"] + 1).alias("at"), counts.alias("counts"), after.alias("total"), tally("digits", 0, 9), tally("lower", 10, 35), tally("upper", 36, 61), tally("low_hex", 10, 15), tally("up_hex", 36, 41))

        count = lambda code: F.call_function("shiftright", of(s["counts"], of(slot, code)), of(offset, code)).bitwiseAND(31).cast("int")
        seen = bound(F.struct(new.alias("new"), old.alias("old")), lambda x: F.struct(x["new"], x["old"], count(x["new"]).alias("n_new"), count(x["old"]).alias("n_old"), of(slot, x["new"]).alias("slot_new"), of(unit, x["new"]).alias("unit_new"), of(slot, x["old"]).alias("slot_old"), of(unit, x["old"]).alias("unit_old")))

        def judged(m: Column) -> Column:
            bits = F.lit(math.log2(w) + 1e-9) - m["total"] / w
            kind = F.when(m["at"] >= w, _class_of(m["digits"], m["lower"], m["upper"], m["low_hex"], m["up_hex"], bits, policy)).otherwise(-1)

            def put(k: Column) -> Column:
                hot = k >= 0
                fresh = hot & ~(s["z"] >= m["at"] - w)
                out = F.when(fresh & (s["z"] >= 0), ends(s)).otherwise(s["out"])
                return F.struct(*[m[x].alias(x) for x in ("at", "counts", "total", "digits", "lower", "upper", "low_hex", "up_hex")], F.when(fresh, m["at"] - w).otherwise(s["a"]).alias("a"), F.when(hot, m["at"]).otherwise(s["z"]).alias("z"), F.when(fresh, k).otherwise(s["kind"]).alias("kind"), out.alias("out"))

            return bound(kind, put)

        return bound(bound(seen, moved), judged)

    def block(s: Column, b: Column) -> Column:
        """The state after a block (text: the block behind the characters before it, ahead: how many these are)."""
        codes = F.transform(F.split(b["text"], ""), lambda c: F.element_at(number, F.ascii(c) + 1))
        return bound(codes, lambda n: F.aggregate(F.sequence(b["ahead"] + 1, F.size(n)), s, lambda t, i: step(n, t, i)))

    zero = F.lit(0)
    start = F.struct(zero.alias("at"), F.array_repeat(F.lit(0).cast("long"), -(-len(SYMBOLS) // _PACKED)).alias("counts"), F.lit(0.0).alias("total"), *[zero.alias(x) for x in ("digits", "lower", "upper", "low_hex", "up_hex")], F.lit(-1).alias("a"), F.lit(-1).alias("z"), F.lit(-1).alias("kind"), F.array().cast(_RUNS).alias("out"))
    pieces = F.regexp_extract_all(candidate, F.lit(f"(?s).{{1,{_CHARACTERS}}}"), F.lit(0))
    tailed = lambda p: F.transform(p, lambda x, k: F.struct(F.when(k > 0, F.concat(F.substring(F.element_at(p, F.greatest(k, F.lit(1))), -w, w), x)).otherwise(x).alias("text"), F.when(k > 0, w).otherwise(0).alias("ahead")))
    return bound(pieces, lambda p: F.aggregate(tailed(p), start, block, lambda s: F.when(s["z"] >= 0, ends(s)).otherwise(s["out"])))


def _entropy(candidates: Column, policy: SecretPolicy) -> Column:
    """array<struct<start, end, rank>> of the candidates' hot runs that no allow-list entry fits."""

    def one(c: Column) -> Column:
        def allowed(r: Column) -> Column:
            own = F.substring(c["found"], r["a"] + 1, r["z"] - r["a"])
            return ~F.greatest(*[own.rlike(a).cast("int") for a in policy.allow], F.lit(0), F.lit(0)).cast("boolean")

        return F.transform(F.filter(_hot_runs(c["found"], policy), allowed), lambda r: F.struct((c["start"] + r["a"]).alias("start"), (c["start"] + r["z"]).alias("end"), r["kind"].alias("rank")))

    return F.flatten(F.transform(candidates, one))


def spans(docs: DataFrame, policy: SecretPolicy = SecretPolicy()) -> DataFrame:
    """docs (text and any other columns) with base_spans and all_spans: array<struct<start, rank, end>> in order.

    rank is the kind's place in KINDS. A null text counts as empty. The row's other columns are passed on untouched.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = docs.withColumns({
        "_assign": _matches(text, ASSIGN, 2, policy.min_assigned),
        "_access": _matches(text, ACCESS, 0, 16),
        "_hex": _matches(text, HEX, 0, 32),
        "_candidates": _matches(text, CANDIDATE, 0, 20),
    })
    ranked = lambda r: lambda x: F.struct(x["start"].alias("start"), F.lit(r).alias("rank"), x["end"].alias("end"))
    base = F.concat(*[F.transform(F.filter(F.col(f"_{k}"), lambda x: x["ok"]), ranked(r)) for r, k in enumerate(KINDS[:3])])
    raw = raw.withColumn("base_spans", F.array_sort(base)).withColumn("_more", F.when(F.size("_candidates") > 0, _entropy(F.col("_candidates"), policy)).otherwise(F.array().cast("array<struct<start:int,end:int,rank:int>>")))
    outside = F.filter(F.col("_more"), lambda m: ~F.exists("base_spans", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))
    more = F.transform(outside, lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["end"].alias("end")))
    return raw.withColumn("all_spans", F.array_sort(F.concat("base_spans", more))).drop("_assign", "_access", "_hex", "_candidates", "_more")


def joined(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(column), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(docs: DataFrame, policy: SecretPolicy = SecretPolicy()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs (doc_id, text).

    Null and empty texts have no spans. Repeated rows and null ids give a row each; an empty table gives none.
    """
    found = spans(docs.select("doc_id", "text"), policy)
    count = lambda r: F.size(F.filter("base_spans", lambda s: s["rank"] == r)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans"))


def redact(docs: DataFrame, policy: SecretPolicy = SecretPolicy(), mark: str = "[secret]") -> DataFrame:
    """docs with each span, overlapping ones as one, replaced by mark; same columns, n_chars renewed where text changes.

    A null text stays null, an empty one empty. Repeated rows are handled alike; columns of any name are passed on
    untouched. An empty table stays empty.
    """
    names = docs.columns
    found = spans(docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"_c{k}") for k, c in enumerate(names)]), policy)
    blocks = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{8 * _CHARACTERS}}}"), F.lit(0))

    def cut(parts: Column, a: Column, z: Column) -> Column:
        """Characters a to z of the text, from the blocks that hold them."""
        size = 8 * _CHARACTERS
        first, last = F.floor(a / size).cast("int"), F.floor((z - 1) / size).cast("int")
        piece = lambda k: F.substring(F.element_at(parts, k + 1), F.greatest(a - k * size, F.lit(0)) + 1, F.least(z - k * size, F.lit(size)) - F.greatest(a - k * size, F.lit(0)))
        return F.when(a >= z, "").otherwise(F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), piece), ""))

    def replaced(parts: Column) -> Column:
        """The text before the last span's end, a string for each block of spans, and the rest."""
        state = lambda at, kind: F.struct(at.alias("at"), F.array().cast("array<string>").alias(kind))

        def step(s: Column, x: Column) -> Column:
            fresh = x["start"] >= s["at"]
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, F.concat(s["out"], F.array(cut(parts, s["at"], x["start"]), F.lit(mark)))).otherwise(s["out"]).alias("out"))

        def block(s: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice("all_spans", k * _BLOCK + 1, _BLOCK), state(s["at"], "out"), step)
            return bound(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(s["done"], F.array(F.array_join(x["out"], ""))).alias("done")))

        blocks_ = F.sequence(F.lit(0), F.floor((F.size("all_spans") - 1) / F.lit(_BLOCK)).cast("int"))
        return F.aggregate(blocks_, state(F.lit(0), "done"), block, lambda s: F.concat(F.array_join(s["done"], ""), cut(parts, s["at"], F.length("text"))))

    hit = F.size("all_spans") > 0
    clean = found.withColumn("_text", F.when(hit, bound(blocks, replaced)).otherwise(F.col("text")))
    columns = [F.col("_text").alias(c) if c == "text" else F.when(hit, F.length("_text").cast(docs.schema[c].dataType)).otherwise(F.col(f"_c{k}")).alias(c) if c == "n_chars" else F.col(f"_c{k}").alias(c) for k, c in enumerate(names)]
    return clean.select(*columns)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(texts(table(spark, sf_dir, "documents"), "doc_id", "text"))
