"""Operators against plain re-implementations on small and on the given tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from spindrift.llm import near, op1_secrets, op2_decontamination, op3_simhash, op4_warc, op5_quality, op6_bpe, op7_urls, op8_substrings, op9_maxent, op10_sharding

from .helpers import prose

FOLDER = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")


def sha(b) -> str:
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


# --- op1


def letters(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join([*map(letters, ("password", "passwd", "secret", "token")), letters("api") + "_?" + letters("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t: str):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def window_kind(x: str, policy) -> int:
    """A window's kind by counting afresh."""
    w = len(x)
    bits = -sum(n / w * math.log2(n / w) for n in Counter(x).values()) + 1e-9
    d, l, u = (len(re.findall(c, x)) for c in ("[0-9]", "[a-z]", "[A-Z]"))  # noqa: E741
    if d > 1 and l + u > 1 and re.fullmatch("[0-9a-f]+|[0-9A-F]+", x):
        return 4 if bits >= policy.hex_bits else -1
    if u > 1 and l > 1 and d > 0:
        return 3 if bits >= policy.base64_bits else -1
    if d > 3 and (l > 3 and d + l == w or u > 3 and d + u == w):
        return (5 if l else 6) if bits >= policy.one_case_bits else -1
    return 7 if u > 5 and l > 5 and u + l == w and bits >= policy.letters_bits else -1


def entropy_spans(t: str, policy=op1_secrets.SecretPolicy()):
    out, base, w = [], base_spans(t), policy.window
    for m in re.finditer(op1_secrets.CANDIDATE, t):
        c, runs = m[0], []
        for i in range(w, len(c) + 1):
            kind = window_kind(c[i - w : i], policy)
            if kind >= 0:
                if runs and runs[-1][2] >= i - w:
                    runs[-1][2] = i
                else:
                    runs.append([i - w, kind, i])
        out += [(a + m.start(), k, z + m.start()) for a, k, z in runs if not any(re.search(x, c[a:z]) for x in policy.allow) and not any(x <= a + m.start() and z + m.start() <= y for x, _, y in base)]
    return out


def test_secrets_of_each_class(spark):
    rows = ["key-3ax6xnjp29jd6fds4gc373sgvjxteol0", "JBSWY3DPEHPK3PXPGE2DG4BVGY3TQOJQ", "go wJalrXUtnFEMIKMDENGbPxRfiCYzqkLm", "com/acme/sample-app/raw/wJalrXUtnFEMIK7MDENGbPxRfiCYzq9kLm", "A1b2c3d4e5f60718293a4b5c6d7e8f90", "de305d54-75b4-431b-adb2-eb6b9e546014", "my-long-blog-post-title-of-2020-and-more", "getElementsByClassNameAndTagName", "thequickbrownfoxjumpsoverthelazydog"]
    got = [r.spans.split(":")[0] for r in op1_secrets.findings(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["entropy_lower", "entropy_upper", "entropy_letters", "entropy_base64", "entropy_hex", "", "", "", ""]


def test_secrets_in_a_very_long_candidate(spark):
    """A candidate of 200,000 characters takes seconds (a scan that recounts its windows takes an hour), and its offsets are right."""
    rnd = random.Random(8)
    long = "".join(rnd.choices(op1_secrets.SYMBOLS[:64], k=200_000))
    text = "data:" + long + " end"
    docs = spark.createDataFrame([(1, text), (2, "password=abcdefgh12 " * 20_000)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in op1_secrets.findings(docs).collect()}
    clean = {r.doc_id: r.text for r in op1_secrets.redact(docs).collect()}
    assert time.perf_counter() - began < 90
    assert got[1].spans.split(",") == [f"{op1_secrets.KINDS[k]}:{a}:{z}" for a, k, z in sorted(base_spans(text) + entropy_spans(text))]
    assert got[2].n_assign == 20_000 and len(clean[1]) < 20_000 and clean[2] == "[secret] " * 20_000


def test_secrets(spark):
    rnd = random.Random(3)
    parts = ["token", "=", ":", " ", "'", '"', "abcdefgh", "AKIA", "ABCD1234", "0f9e8d7c", "\n", "é", "😀", "Zk9", "qW3rT7", "-", "/", "PassWD", "api_KEY", "ſecret", "aB3xY9kLmN0pQrStUvW2", "example"]
    rows = ["token=token:abcdefgh", "0123456789abcdef" * 4, "token=abcdefgh " * 900] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 50))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    join = lambda s: ",".join(f"{op1_secrets.KINDS[k]}:{a}:{z}" for a, k, z in s)
    for r in op1_secrets.findings(docs).collect():
        t = rows[r.doc_id]
        base = base_spans(t)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert r.base_sha256 == sha(join(base)) and r.spans == join(sorted(base + entropy_spans(t)))
    clean = op1_secrets.redact(docs).collect()
    assert not any("aB3xY9kLmN0pQrStUvW2" in r.text for r in clean if not base_spans(r.text) and "example" not in r.text and re.search(r"(?<![\w+/-])aB3xY9kLmN0pQrStUvW2(?![\w+/=-])", rows[r.doc_id]))


# --- op2


def test_decontamination(spark):
    rnd = random.Random(5)
    items = [(i, prose(rnd, rnd.choice((3, 9, 10, 14, 30)))) for i in range(25)] + [(25, "..."), (26, None), (7, "another text of item seven is here")]
    rows = []
    for i in range(150):
        t = prose(rnd, rnd.randint(0, 60))
        if i % 3 == 0:
            item = rnd.choice(items)[1] or ""
            t += "! " + item.upper().replace(" ", ",  ") + " " + prose(rnd, 5)
        rows.append((i, t))
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = [(i, w[k : k + 10]) for i, t in items if (w := word(t)) for k in range(max(1, len(w) - 9))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (200_000, 40):
        got = {r.doc_id: r for r in op2_decontamination.contamination(docs, bench, block_windows=block).collect()}
        for i, t in rows:
            w, hit, found = word(t), set(), set()
            for item, x in windows:
                for k in range(len(w) - len(x) + 1):
                    if w[k : k + len(x)] == x:
                        hit |= set(range(k, k + len(x)))
                        found.add(str(item))
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    runs = {r.doc_id: r.runs for r in op2_decontamination.scan(docs, bench).collect()}
    assert all(op2_decontamination.words_of(rows[i][1][a:z].encode()) for i, r in runs.items() for a, z in op2_decontamination.hit_spans(rows[i][1], r))
    kept = {r.doc_id for r in op2_decontamination.clean(docs, bench).collect()}
    assert kept == {i for i, r in got.items() if not r.contaminated}


# --- op3


def components_of(prints: np.ndarray, bits: int) -> list[int]:
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]) <= bits), strict=True):
        root[find(a)] = find(b)
    return [find(i) for i in range(len(prints))]


def test_simhash_contract(spark):
    docs = documents(spark)
    got = op3_simhash.op3_simhash(spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}

    def fingerprint(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(texts[r.doc_id]) for r in got]
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    roots = components_of(np.array(prints, np.uint64), 3)
    least = {}
    for r, c in zip(got, roots, strict=True):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert [r.component_id for r in got] == [least[c] for c in roots]


@pytest.mark.parametrize(("bits", "group"), [(3, 4096), (3, 8), (1, 4), (5, 4096), (7, 4096)])
def test_links_connect_all(spark, bits, group):
    rnd, prints = random.Random(bits), set()
    for _ in range(8):
        base = rnd.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    p = np.array(sorted(prints), np.uint64)
    edges = op3_simhash.links(spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "print long"), bits, group).collect()
    number = {int(x): i for i, x in enumerate(p.view(np.int64))}
    root = list(range(len(p)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        assert ((e.a ^ e.b) & (2**64 - 1)).bit_count() <= bits
        root[find(number[e.a])] = find(number[e.b])
    assert len({find(i) for i in range(len(p))}) == len(set(components_of(p, bits)))


def test_near_copies_go(spark):
    rnd = random.Random(9)
    rows = []
    for g in range(12):
        words = [f"{rnd.choice(('ka', 'lo', 'mi', 'tu'))}{rnd.randrange(4000)}" for _ in range(300)]
        rows.append((100 * g, " ".join(words)))
        for k in range(4):
            other = list(words)
            for _ in range(k):
                other[rnd.randrange(300)] = "changed"
            rows.append((100 * g + k + 1, " ".join(other)))
    kept = {r.doc_id for r in near.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {100 * g for g in range(12)} <= kept and len(kept) <= 16


def test_near_components_against_all_pairs(spark):
    """Links are the pairs with Jaccard similarity 0.8 or more, and nearly all of them: none is false."""
    rnd, rows = random.Random(31), []
    for g in range(150):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        other = list(words)
        for k in rnd.sample(range(40), rnd.randint(1, 20)):
            other[5 * k] = f"e{rnd.randrange(10**6)}"  # each breaks five shingles
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    true = {a for a in range(0, 300, 2) if len(sets[a] & sets[a + 1]) >= 0.8 * len(sets[a] | sets[a + 1])}
    groups = {}
    for r in near.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    found = {a for a in groups if len(groups[a]) > 1}
    assert 20 < len(true) < 120 and found <= true and len(found) >= 0.9 * len(true)
    assert all(groups[a] == {a, a + 1} for a in found)


def star_shaped(rnd: random.Random, copies: int) -> list[tuple[int, str]]:
    """Copies that are each near one text and mostly not near each other."""
    words = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    rows = [(copies // 2, " ".join(words))]
    for i in range(copies):
        own = list(words)
        for k in rnd.sample(range(40), 4):
            own[5 * k] = f"e{rnd.randrange(10**6)}"
        rows.append((i if i < copies // 2 else i + 1, " ".join(own)))
    return rows


def pairs_of(rows, least=0.8):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for _, t in rows for w in [t.split()]]
    return {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


@pytest.mark.parametrize("group", [16_384, 6])
def test_near_components_of_a_star(spark, group):
    """No link is lost where a forest's likeliest pairs fail; keys of many texts are split."""
    rows = star_shaped(random.Random(41), 60)
    true = pairs_of(rows)
    assert sum(a == 0 for a, _ in true) > 50 > len(true) - sum(a == 0 for a, _ in true)
    got = near.near_components(spark.createDataFrame(rows, "doc_id long, text string"), group).collect()
    assert sum(r.component_id == 0 for r in got) >= 0.95 * (1 + sum(a == 0 for a, _ in true))


def crowded(rnd: random.Random, families: int, size: int, twins: int) -> list[tuple[int, str]]:
    """Families of texts just below the limit of similarity to each other, among them twins just above it."""
    rows = []
    for _ in range(families):
        core = [f"w{rnd.randrange(10**9)}" for _ in range(176)]
        tails = [[f"e{rnd.randrange(10**9)}" for _ in range(23)] for _ in range(size)]
        for k in range(twins):
            tails[2 * k + 1][:3] = tails[2 * k][:3]
        rows += [" ".join(core + t) for t in tails]
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [near.BLOCK, 10_000])
def test_near_links_among_many_that_fail(spark, block, monkeypatch):
    """A text has far more likely pairs that fail than one that links; the one is found all the same, in blocks or not."""
    monkeypatch.setattr(near.linked_across, "__defaults__", (block,))
    rows = crowded(random.Random(43), 4, 60, 10)
    true = pairs_of(rows)
    assert true == {(60 * f + 2 * k, 60 * f + 2 * k + 1) for f in range(4) for k in range(10)}
    got = {r.doc_id: r.component_id for r in near.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [a for a, b in true if got[a] != got[b]]
    assert not lost and len(set(got.values())) == len(rows) - len(true)


def test_near_candidates_stay_in_proportion(spark):
    """Ten times the texts give about ten times the pairs, near copies and texts that share a passage among them."""
    rnd, passage = random.Random(42), " ".join(f"p{k}" for k in range(60))
    rows = []
    for g in range(1000):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(100)]
        rows.append((2 * g, " ".join(words + [passage] * (g % 4 == 0))))
        words[rnd.randrange(100)] = "edited"
        rows.append((2 * g + 1, " ".join(words)))
    counts = []
    for n in (200, 2000):
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string")
        found = near._ordered(near._sorted(near.keyed(docs, near.signatures(docs), near.shared_dir(spark))).mapInArrow(near._proposed, near._PAIRS).select("a", "b")).count()
        counts.append(found)
    assert counts[0] >= 60 and counts[1] <= 14 * counts[0]


# --- op4


def test_warc(spark, tmp_path):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html")
    pages = pages.unionByName(pages.filter("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1000))
    folder = f"file://{tmp_path}/warc"
    manifest = op4_warc.write(pages, folder, frame_bytes=8_000, bundle_bytes=16_000)
    got = {r.page_id: r for r in op4_warc.read(spark, folder, manifest).collect()}
    rows = pages.collect()
    last = {}
    for r in rows:
        last[r.html] = max(last.get(r.html, -1), r.page_id)
    for r in rows:
        b, x = r.html.encode(), got[r.page_id]
        first = last[r.html] == r.page_id
        assert (x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else last[r.html])
    import zstandard

    names = [r.bundle for r in manifest.collect()]
    assert len(names) > 2 and sum(r.n_records for r in manifest.collect()) == len(rows)
    for n in names:  # plain zstd readers can read a bundle from the start, and any record alone
        data = (tmp_path / "warc/bundles" / n).read_bytes()
        reader = op4_warc.BundleReader(data)
        records = list(reader.records())
        assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(records)
        assert [reader.record(x[0]) for x in reader.index] == records
    small = op4_warc.round_trip(pages, min_revisit=10**9).collect()
    assert {r.record_type for r in small} == {"response"}


# --- op5


def test_quality_base(spark):
    rnd = random.Random(2)
    rows = [(i, "s", "\n".join(prose(rnd, rnd.randint(0, 12)) + rnd.choice(("", " #a|b", "\r", "é<>")) for _ in range(rnd.randint(1, 30)))) for i in range(80)]
    rows += [(100, "s", "a b c " * 30), (101, "s", "a b"), (102, "s", "x\n" * 60)]
    got = {r.doc_id: r for r in op5_quality.quality(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    for i, _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit), failed)
        assert not (failed and r.kept)


def test_quality_lines(spark):
    rnd = random.Random(4)
    notice = "All  Rights reserved " + prose(rnd, 57)
    fresh = lambda n: " ".join(f"{rnd.choice('bcdfg')}{rnd.randrange(10**8)}long" for _ in range(n))
    body = {i: "\n".join(fresh(20) for _ in range(4)) for i in range(200)}
    rows = [(i, "h", f"{notice.upper() if i % 2 else notice}\n{body[i]}") for i in range(80)]  # boilerplate in many texts of one host
    rows += [(100 + i, "other", f"{notice}\n{body[100 + i]}") for i in range(5)]  # in few of another
    rows += [(200 + i, "h", f"{notice}\n{fresh(20)}") for i in range(10)]  # little else
    rows += [(300 + i, "copies", body[150]) for i in range(60)]  # exact copies
    near = body[151].split()
    for i in range(60):  # near copies
        w = list(near)
        w[rnd.randrange(80)] = "x"
        rows.append((400 + i, "copies", "\n".join(" ".join(w[k : k + 20]) for k in range(0, 80, 20))))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in op5_quality.quality(docs).collect()}
    assert all(got[i].kept and got[i].removed_words == 60 for i in range(80))
    assert all(got[i].kept and got[i].removed_words == 0 for i in (*range(100, 105), *range(300, 360), *range(400, 460)))
    assert not any(got[i].kept for i in range(200, 210))
    clean = {r.doc_id: r.text for r in op5_quality.clean(docs).collect()}
    assert clean.keys() == {i for i, r in got.items() if r.kept}
    assert clean[3] == body[3] and clean[100] == rows[80][2]


def test_quality_depleted_and_copies(spark):
    """Depleted documents cannot veto the lines that they share, nor can a group of copies larger than the rest."""
    rnd = random.Random(21)
    lines = lambda n, size=10: "\n".join(prose(rnd, size) for _ in range(n // size))
    footers = {own: lines(150) for own in (10, 40, 60)}
    rows = [(1000 * own + i, f"h{own}", f"{lines(own)}\n{footers[own]}") for own in footers for i in range(100)]
    mixed, shared = lines(300, 30), prose(rnd, 20)
    rows += [(i, "mixed", f"{lines(100)}\n{shared}") for i in range(40)]  # 40 documents share a line with 400 near copies of one
    for i in range(400):
        w = [x.split() for x in mixed.split("\n")]
        for _ in range(6):
            x = rnd.choice(w)
            x[rnd.randrange(30)] = f"edit{rnd.randrange(10**6)}long"
        rows.append((100 + i, "mixed", "\n".join(map(" ".join, w)) + f"\n{shared}"))
    got = {r.doc_id: r for r in op5_quality.quality(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    for own in footers:
        assert all(not got[1000 * own + i].kept and got[1000 * own + i].removed_words == 150 for i in range(100))
    assert all(got[i].kept and got[i].removed_words == 20 for i in range(500) if i in got)


def test_quality_shuffles_lines_of_wanted_texts(spark, monkeypatch):
    """All lines of wanted texts pass the bitmap and hardly any other, with keys of either sign and with joins that do not broadcast."""
    rnd = np.random.default_rng(5)
    keys = rnd.integers(-(1 << 63), 1 << 63, 20_000).tolist()
    rows = spark.createDataFrame([(k, j) for k in keys for j in range(2)], "text_key long, line long")
    wanted = spark.createDataFrame([(k,) for k in keys[:1000]], "text_key long")
    got = [tuple(r) for r in op5_quality.possible(rows, wanted).collect()]
    assert len(got) == len(set(got)) <= 2100 and set(got) >= {(k, j) for k in keys[:1000] for j in range(2)}
    assert op5_quality.possible(rows, wanted.limit(0)).isEmpty()
    line, texts = prose(random.Random(23), 20), [prose(random.Random(k), 90) for k in range(90)]
    docs = spark.createDataFrame([(i, "h", f"{t}\n{line}" if i < 40 else t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    want = sorted(map(tuple, op5_quality.quality(docs).collect()))
    assert [r[-1] for r in want] == [20] * 40 + [0] * 50
    monkeypatch.setattr(op5_quality, "FEW", -1)
    assert sorted(map(tuple, op5_quality.quality(docs).collect())) == want


def test_quality_counts_documents_whatever_their_words(spark):
    """200 documents of one host share a line: all lose it, with short or long own words, a long or a short line."""
    rnd = random.Random(22)
    cases = {"a": (" ".join(f"navigation{k}entry" for k in range(60)), 5, 70), "b": (" ".join(f"newsletter{k}" for k in range(12)), 5, 60), "c": (" ".join(f"newsletter{k}" for k in range(12)), 10, 60)}
    rows = []
    for host, (shared, size, own) in cases.items():
        for i in range(200):
            body = "\n".join(" ".join("".join(rnd.choices("bcdfglmnprst", k=size)) for _ in range(10)) for _ in range(own // 10))
            rows.append((f"{host}{i}", host, f"{shared}\n{body}"))
    got = op5_quality.quality(spark.createDataFrame(rows, "doc_id string, source string, text string")).collect()
    assert len(got) == 600 and all(r.kept and r.removed_words == len(cases[r.doc_id[0]][0].split()) for r in got)


def test_quality_short_lines_and_dropped_lines(spark):
    """Copies that lack a line, or have one edited beyond recognition, are still few documents."""
    rnd = random.Random(23)
    lines = [prose(rnd, 25) for _ in range(8)] + ["two words"]
    rows = []
    for i in range(300):
        own = list(lines)
        if i % 2:
            own[8] = f"edit{i} words"
        else:
            del own[rnd.randrange(8)]
        rows.append((i, "h", "\n".join(own)))
    got = op5_quality.quality(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert all(r.kept and r.removed_words == 0 for r in got)


def test_quality_clean_passes_columns_on(spark):
    """Columns named like the operator's own keep their values; a null text may stay."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([("a", text, "src", "MYHOST", "key", "gone"), ("b", None, None, "MYHOST", None, None)], "doc_id string, text string, source string, host string, text_key string, removed_lines string")
    assert op5_quality.clean(docs).collect() == docs.collect()[:1]
    assert op5_quality.clean(docs, op5_quality.QualityPolicy(min_words=0)).orderBy("doc_id").collect() == docs.collect()


# --- op6


def test_bpe(spark):
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", "a", "b", "é", "1", "²", "'", "'s", "'re", "'ll", "'v", "!", "\u00a0", "\u3000", "日本", "😀", "\t", "don't", "<|endoftext|>", "x" * 150, "\x00"]
    rows = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(500)] + ["ab" * 4000, "'", " ", "\n\n "] + [r.text for r in documents(spark).collect()]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in op6_bpe.encoded_digests(docs).collect():
        ids = own.encode_ordinary(rows[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert (r.ids_sha256, r.decoded_sha256) == (sha(np.array(ids, "<u4").tobytes()), sha(rows[r.doc_id]))
    encoded = op6_bpe.encode(docs)
    back = {r.doc_id: r.text for r in op6_bpe.decode(encoded).collect()}
    assert all(back[i] == t for i, t in enumerate(rows))
    row = encoded.filter("doc_id = 500").first()
    assert row.offsets[0] == 0 and row.offsets[-1] == 8000 and len(row.offsets) == len(row.ids) + 1


# --- op7


def test_urls(spark):
    def expected(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fit = [(len(t), t, k) for k, t in op7_urls.RULES for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return host, path, *(max(fit)[1:] if fit else (None, None))

    rnd = random.Random(8)
    hosts = ["com", "a.com", "xcom", "Example.COM", "www.example.com", "a.www.example.com", "net", "b.net", "org", "c.org:80"]
    urls = [rnd.choice(("http://", "https://", "", "x://y://")) + rnd.choice(hosts) + rnd.choice(("", "/", "/en/", "/en", "/es/1", "/fr/q", "?/en/", "#/es/", "/EN/")) for _ in range(400)]
    rows = op7_urls.verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert len(rows) == 400
    for r in rows:
        host, path, rule, verdict = expected(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_url_models(spark):
    """The ratio tells held-out URLs of two kinds apart, and is what Witten-Bell smoothing gives by hand."""
    rnd = random.Random(6)
    make = lambda good: f"http://h{rnd.randrange(9)}.{'com' if good else 'net'}/{'en/article-' if good else 'fr/casino.win/'}{''.join(rnd.choice('aeiou' if good else 'qxzjk') for _ in range(12))}"
    rules = (("allow", "com/"), ("block", "net/fr/"))
    train = [make(k % 2) for k in range(400)]
    model = op7_urls.fit(spark.createDataFrame([(u,) for u in train], "url string"), rules)
    test = [(k, make(k % 2).replace(".com", ".org").replace(".net", ".org")) for k in range(200)]
    got = {r.page_id: r.verdict for r in op7_urls.verdicts(spark.createDataFrame(test, "page_id long, url string"), rules, model).collect()}
    assert sum(got[k] == ("allow" if k % 2 else "block") for k, _ in test) >= 195

    def codes(u):
        s = "^^" + re.sub("[^a-z0./-]", "~", re.sub("[1-9]", "0", u.partition("://")[2].lower()).replace("_", "-")) + "^"
        n = [op7_urls.SYMBOLS.index(c) for c in s]
        return list(zip(n, n[1:], n[2:], strict=False))

    def table(kind):
        c = [x for u in train if (".com" in u) == kind for x in codes(u)]
        tri, bi, uni = Counter(c), Counter(x[1:] for x in c), Counter(x[2] for x in c)
        p0 = lambda z: (uni[z] + len(uni) / 32) / (len(c) + len(uni))

        def p1(y, z):
            own = {k: v for k, v in bi.items() if k[0] == y}
            return (bi[y, z] + len(own) * p0(z)) / (sum(own.values()) + len(own)) if own else p0(z)

        def p2(x, y, z):
            own = {k: v for k, v in tri.items() if k[:2] == (x, y)}
            return (tri[x, y, z] + len(own) * p1(y, z)) / (sum(own.values()) + len(own)) if own else p1(y, z)

        return p2

    good, bad = table(True), table(False)
    for x in codes(test[0][1]) + codes(test[1][1]):
        assert model.ratios[(x[0] * 32 + x[1]) * 32 + x[2]] == pytest.approx(math.log(good(*x)) - math.log(bad(*x)), abs=1e-9)


# --- op8


def removed(rows, length=100):
    first, out = {}, {}
    for i, t in sorted(rows):
        b = t.encode()
        for a in range(len(b) - length + 1):
            first.setdefault(b[a : a + length], (i, a))
    for i, t in rows:
        b = t.encode()
        m = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if first[b[a : a + length]] != (i, a):
                m[a : a + length] = b"\1" * length
        out[i] = (len(b), sum(m), len(re.findall(b"\1+", bytes(m))), bytes(c for c, x in zip(b, m, strict=True) if not x))
    return out


@pytest.mark.parametrize(("bucket", "block"), [(100_000, 20_000), (3, 8)])
def test_substrings(spark, bucket, block):
    rnd = random.Random(5)
    shared = [prose(rnd, 30) + "é" for _ in range(6)]
    rows = [(900, "x" * 350), (901, "ab" * 300), (902, "x" * 99), (903, "y" * 700 + prose(rnd, 20) + "y" * 300)]
    for i in range(90):
        t = prose(rnd, rnd.randint(3, 40))
        if i % 2:
            t += " " + rnd.choice(shared) + prose(rnd, rnd.randint(0, 20)) + rnd.choice(shared)[: rnd.randint(20, 140)]
        if i % 11 == 0:
            t = rnd.choice(rows)[1]
        rows.append((rnd.randrange(10**6) * 100 + i, t))
    want = removed(rows)
    for r in op8_substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"), bucket, block).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_substrings_across_segments(spark, monkeypatch):
    rnd = random.Random(7)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(150))
    noise = lambda n: "".join(rnd.choice("ijklmnopqrstuvwxyz") for _ in range(n))
    long = noise(op8_substrings.SEGMENT - 60) + passage + noise(5000) + passage
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in op8_substrings.dedup(spark.createDataFrame([(2, long), (1, passage), (3, passage)], "doc_id long, text string")).collect()}
    assert got[1] == (0, 0, passage.encode()) and got[3] == (150, 1, b"")
    assert got[2] == (300, 2, long.replace(passage, "").encode())


# --- op9


def test_maxent(spark):
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in op9_maxent.tokens_of(t.encode()))
    n, v = sum(counts.values()), len(counts)
    rows = op9_maxent.score(docs).collect()
    for r in rows:
        w = op9_maxent.tokens_of(texts[r.doc_id].encode())
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_maxent_rare_words_by_join(spark, monkeypatch):
    """With a small table of frequent words, the rest meets its counts in the join, and nothing changes."""
    docs = documents(spark)
    monkeypatch.setattr(op9_maxent, "FREQUENT", 10**9)
    every = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in op9_maxent.score(docs).collect()}
    monkeypatch.setattr(op9_maxent, "FREQUENT", 50)
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in op9_maxent.score(docs).collect()} == every


def test_maxent_leaves(spark):
    """Leaves in SQL and in workers agree, and each word of the vocabulary is in one."""
    words = [b"", b"a", b"of", b"the", "süß".encode(), "日本語".encode(), b"x" * 99]
    for levels in range(1, op9_maxent.MOST_LEVELS + 1):
        own = {b"": 0, b"of": 1}
        got = spark.createDataFrame([(bytearray(w),) for w in words], "word binary").select("word", op9_maxent.leaf_column(own, levels).alias("k")).collect()
        assert {bytes(r.word): r.k for r in got} == {w: op9_maxent.word_leaf(w, own, levels) for w in words}


def test_maxent_sums_to_one():
    """Over all leaves, probabilities sum to one after any history."""
    rng = np.random.default_rng(1)
    for levels in (1, 2, 3):
        shape = op9_maxent.Shape(levels, 12)
        weights = rng.standard_normal((shape.size, op9_maxent.CLASSES)).astype(np.float32)
        leaves = np.array([k for k in range(shape.leaves) if k // 16 ** (levels - 1) >= op9_maxent.OWN or k % 16 ** (levels - 1) == 0])
        history = np.repeat(rng.integers(0, 2**63, (5, 1)).astype(np.uint64), len(leaves), axis=1)
        logs = np.zeros(len(leaves))
        for level in range(levels):
            at, rows, taken = op9_maxent.branches(history, leaves, level, shape)
            logs[at] += op9_maxent.log_chances(weights, rows, taken)
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def plain_maxent(texts: dict[int, str]) -> dict[int, float]:
    """Training and scores a token at a time, sums in dictionaries."""
    m = op9_maxent
    texts = {i: m.tokens_of(t.encode()) for i, t in texts.items()}
    learn = [w for i, w in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in learn for w in t)
    n, v = sum(counts.values()), len(counts)
    levels = next((k for k in (1, 2, 3) if 256 * 16**k >= v), 4)
    bits = min(m.MOST_BITS, max(m.LEAST_BITS, (n // 8).bit_length()))
    own = {w: k for k, w in enumerate([b"", *sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[:7]])}
    path = {w: m.word_leaf(w, own, levels) for t in texts.values() for w in t}
    leaf_tokens, leaf_words = Counter(), Counter()
    for w, c in counts.items():
        leaf_tokens[path[w]] += c
        leaf_words[path[w]] += 1
    mask = 2**64 - 1
    crc = zlib.crc32

    def steps(t, j):
        """(weight rows, branch) of each level on a token's path."""
        one, two, three = (crc(t[j - k]) if j >= k else 0x1234567 for k in (1, 2, 3))
        kind = path[t[j - 1]] >> 4 * max(0, levels - 2) if j else 0x1234567
        history = [one * 0x9E3779B97F4A7C15, (one * 31 + two + 7) * 0xC2B2AE3D27D4EB4F, two * 0xD6E8FEB86659FD93 + (1 << 50), three * 0xA0761D6478BD642F + (3 << 50), (kind + 5) * 0xE7037ED1A0B428DB]
        leaf = path[t[j]]
        for level in range(levels if leaf >> 4 * (levels - 1) >= 8 else 1):
            node = (leaf >> 4 * (levels - level)) + sum(16**k for k in range(level))
            salt = (node + 1) * 0x8EBC6AF09C88C6E3 & mask
            rows = [((((h & mask) ^ salt) * 0x9E3779B97F4A7C15) & mask) >> (64 - bits) for h in history]
            yield [*rows, ("bias", node)], (leaf >> 4 * (levels - level - 1)) & 15

    weights: dict = {}
    for level in range(levels):
        for k in range(16**level):
            mass = np.array([0.5 + sum(c for x, c in leaf_tokens.items() if x >> 4 * (levels - level - 1) == 16 * k + b) for b in range(16)])
            weights["bias", sum(16**j for j in range(level)) + k] = np.log(mass / mass.sum())

    def chances(rows):
        z = sum(weights.get(r, 0.0) for r in rows)
        p = np.exp(z - z.max())
        return p / p.sum()

    for _ in range(m.ROUNDS):
        seen, expected = {}, {}
        for t in learn:
            for j in range(len(t)):
                for rows, branch in steps(t, j):
                    p = chances(rows)
                    for r in rows:
                        expected[r] = expected.get(r, 0.0) + p
                        seen.setdefault(r, np.zeros(16))[branch] += 1
        for r in seen:
            weights[r] = weights.get(r, 0.0) + m.RATE * (seen[r] - expected[r]) / (np.maximum(seen[r], expected[r]) + m.DAMP)
    out = {}
    for i, t in texts.items():
        out[i] = sum(math.log10((counts[w] + 1) / (leaf_tokens[path[w]] + leaf_words[path[w]] + 1)) for w in t)
        out[i] += sum(math.log10(chances(rows)[branch]) for j in range(len(t)) for rows, branch in steps(t, j))
    return out


def test_maxent_score(spark, monkeypatch):
    """Scores are those of plain training, in any number of tasks, blocks and sums."""
    rng = np.random.default_rng(5)
    words = [f"w{k}x{k * k % 97}" for k in range(400)]
    texts = {i: " ".join(words[k] for k in (rng.integers(0, 20, 60).cumsum() % 400 if i % 2 else rng.integers(0, 400, int(rng.integers(0, 40))))) for i in range(60)}
    want = plain_maxent(texts)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(op9_maxent, "TASK_TOKENS", 200)
    for parts in (1, 7, 32):
        got = {r.doc_id: r.score for r in op9_maxent.score(rows.repartition(parts)).collect()}
        assert got == {i: pytest.approx(x, abs=2e-3) for i, x in want.items()}
    # Blocks are cut within texts, history and all.
    lexicon, shape = op9_maxent.Lexicon(None, {}, 2), op9_maxent.Shape(2, 12)
    numbers, position, _, _ = op9_maxent._laid_out([t.encode() for t in texts.values()], lexicon)
    whole = [np.concatenate(x, axis=-1) for x in zip(*[(h, k) for _, h, k in op9_maxent._blocks(numbers, position, lexicon, shape)], strict=True)]
    monkeypatch.setattr(op9_maxent, "BLOCK", 17)
    cut = [np.concatenate(x, axis=-1) for x in zip(*[(h, k) for _, h, k in op9_maxent._blocks(numbers, position, lexicon, shape)], strict=True)]
    assert all((x == y).all() for x, y in zip(whole, cut, strict=True))


def test_maxent_laid_out():
    """Words are those of tokens_of, whatever the blanks, at either end too, and whatever lies before a slice."""
    texts = ["", None, " a  B\x0b\x0cc\r\n", "\x1cÄ\x85\u3000x\xa0Y \t", " ", *(f"x{chr(k)}Y{chr(k)}" for k in range(128)), "Ça É"]
    column = pa.array(["before", *texts], pa.string())[1:]
    for given in ([t and t.encode() for t in texts], column, column.cast(pa.large_string())):
        lexicon = op9_maxent.Lexicon(None, {}, 2)
        numbers, position, sizes, (distinct, among) = op9_maxent._laid_out(given, lexicon)
        assert [lexicon.leaf_array[k] for k in lexicon.numbers.values()] == [op9_maxent.word_leaf(w, {}, 2) for w in lexicon.numbers]
        names = list(lexicon.numbers)
        want = [op9_maxent.tokens_of((t or "").encode()) for t in texts]
        assert [names[k] for k in numbers] == [w for t in want for w in t]
        assert [(distinct.to_pylist() + [""])[k].encode() for k in among] == [w for t in want for w in t]
        assert sizes.tolist() == [len(t) for t in want] and position.tolist() == [k for t in want for k in range(len(t))]


@pytest.mark.parametrize("joint", [0, 1 << 23])
def test_maxent_sums(monkeypatch, joint):
    """Sums of both rounds are those of each token's own softmax; one history met 300,000 times does no harm."""
    m, rng, shape = op9_maxent, np.random.default_rng(3), op9_maxent.Shape(3, 12)
    monkeypatch.setattr(m, "JOINT", joint)
    history = np.repeat(rng.integers(0, 2**63, (5, 40)).astype(np.uint64), 100, axis=1)
    history = np.concatenate([history, np.repeat(history[:, :1], 300_000, axis=1)], axis=1)
    leaves = rng.choice([k for k in range(shape.leaves) if k >> 8 >= m.OWN or k % 256 == 0], history.shape[1])
    for first in (True, False):
        weights = np.zeros((shape.size, m.CLASSES), np.float32)
        weights[0 if not first else shape.rows :] = rng.standard_normal(weights[0 if not first else shape.rows :].shape)
        sums, seen, expected = m.Sums(weights, shape, first), np.zeros((shape.size, m.CLASSES)), np.zeros((shape.size, m.CLASSES))
        for i in range(0, len(leaves), 1 << 16):
            sums.add(history[:, i : i + (1 << 16)], leaves[i : i + (1 << 16)])
        for level in range(3):
            _, rows, taken = m.branches(history, leaves, level, shape)
            p = np.exp(sum(weights[r].astype(float) for r in rows))
            p /= p.sum(axis=1, keepdims=True)
            for r in rows:
                for k in range(m.CLASSES):
                    expected[:, k] += np.bincount(r, p[:, k], shape.size)
                    seen[:, k] += np.bincount(r, taken == k, shape.size)
        np.testing.assert_allclose(sums.expected(), expected, rtol=1e-3, atol=1e-3)
        assert not first or (sums.seen.reshape(-1, m.CLASSES) == seen).all()


def test_maxent_rounds_read_no_texts(spark):
    """Each round reads hashes and leaves of the tokens alone, and a text is split once for all rounds and scores."""
    rows = spark.createDataFrame([(k, f"a{k % 7} b{k % 3} c") for k in range(50)], "doc_id long, text string")
    words = op9_maxent.vocabulary(op9_maxent.word_counts(rows).cache())
    laid = rows.select("doc_id", F.lit(False), "text").mapInArrow(op9_maxent._laying(spark.sparkContext.broadcast(words), "x"), "doc_id long, " + op9_maxent._LAID)
    assert [len(r.hashes) == 4 * r.n_tokens == 2 * len(r.leaves) for r in laid.collect()] == [True] * 50
    weights = op9_maxent.train(laid.select("hashes", "leaves"), words)
    assert weights.shape == (words.shape.size, op9_maxent.CLASSES) and np.abs(weights[: words.shape.rows]).max() > 0.5


# --- op10


@pytest.mark.parametrize("limit", [3_000, 20_000, 10**9])
def test_sharding(spark, tmp_path, limit):
    docs = documents(spark).unionByName(documents(spark).filter("doc_id = 3")).unionByName(documents(spark).filter("doc_id = 3"))
    rows = docs.collect()
    size, total = Counter(), Counter()
    bits = {r.doc_id: f"{int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16):060b}" for r in rows}
    for r in rows:
        for d in range(61):
            size[bits[r.doc_id][:d]] += len(r.text.encode())
            total[bits[r.doc_id][:d]] += 1
    got = op10_sharding.assign(docs, limit).collect()
    assert len(got) == len(rows)
    for r in got:
        b, d = bits[r.doc_id], r.depth
        assert r.shard == "s" + b[:d] and (r.shard_bytes, r.shard_docs) == (size[b[:d]], total[b[:d]])
        assert all(size[b[:k]] > limit for k in range(d))
        assert r.fits == (r.shard_bytes <= limit) and (r.fits or len({x for x in bits if bits[x].startswith(b[:d])}) == 1)
    back = op10_sharding.write(docs, f"file://{tmp_path}/s", limit).collect()
    assert sorted((r.doc_id, r.text, r.shard) for r in back) == sorted((r.doc_id, r.text, g.shard) for r, g in zip(sorted(rows), sorted(got), strict=True))
