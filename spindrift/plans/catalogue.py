"""All queries of the library by name, each over whole tables. Oracle SQL stands in oracles.py under the same names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates, clusters, coverage, digests, dml, feedback, fusion, link, quality, records
from ..sources import exports
from ..sources.tables import load
from . import check
from .oracles import ORACLES

#: Searches ask for every vector whose id is divisible by this, against all vectors.
QUERY_STEP = 20


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", "text")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("vec_id") % QUERY_STEP == 0)


def dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.canonical(_documents(spark, sf_dir), "doc_id", "text")


def digest_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return digests.digest_any(docs.withColumnRenamed("doc_id", "query_id"), docs, "doc_id", "text", "query_id")


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are the store; of the others the first of each unseen text is inserted."""
    docs, known = _documents(spark, sf_dir), load(spark, sf_dir, "labels").select("doc_id").distinct()
    return digests.insert_if_absent(docs.join(known, "doc_id", "left_semi"), docs.join(known, "doc_id", "left_anti"), "doc_id", "text").select("doc_id", F.length("text").cast("long").alias("n"))


def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.stats(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "doc_id")


def label_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.backlog(load(spark, sf_dir, "documents").select("doc_id", "source"), load(spark, sf_dir, "labels"), "doc_id")


def orphan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that no line item names. Events have no order keys; the second reference, negative user ids, is as in the SQL and has no rows in these tables."""
    events = load(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    return coverage.orphans(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", (load(spark, sf_dir, "lineitem"), "l_orderkey"), (events.filter("k < 0"), "k"))


def sig_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.views(_vectors(spark, sf_dir), "vec_id", "embedding")


def band_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.band_index(sig_views(spark, sf_dir), "vec_id")


def _full_views(spark: SparkSession, sf: str) -> DataFrame:
    return sig_views(spark, sf).filter("kind = 'full'")


def band_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The light candidates of each query: vectors any of whose views shares a band with any of its views, the 120 with the most."""
    return candidates.band_candidates(band_index(spark, sf_dir), _asked(_vectors(spark, sf_dir)), "vec_id")


def hamming_best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidates.best_pairs(band_candidates(spark, sf_dir), sig_views(spark, sf_dir), "vec_id")
    return found.withColumn("light", F.round("light", 6))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return candidates.cosine_topk(v, _asked(v), "vec_id", "embedding")


def simhash_lsh_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return candidates.lsh_votes(v, _asked(v), "vec_id", "embedding")


def exact_or_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return candidates.exact_or_lsh(v, _asked(v), "vec_id", "embedding")


def lsh_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sign-hash candidates, scored exactly; exact_or_lsh does not use them."""
    v = _vectors(spark, sf_dir)
    return candidates.rescored(candidates.lsh_votes(v, _asked(v), "vec_id", "embedding"), v, "vec_id", "embedding")


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    light = hamming_best_pair(spark, sf_dir).select("query_id", "cand_id", (F.col("light") / 100).alias("score"))
    return candidates.union_max(light, cosine_topk(spark, sf_dir))


def knn_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.mutual_matches(_vectors(spark, sf_dir), "vec_id", "embedding", "label", 0.99)


#: Ids of altered copies start here.
COPIES = 1_000_000


def _altered(vectors: DataFrame) -> DataFrame:
    """Copies of the asked vectors: every eighth element 0, but unchanged where the id is divisible by 100."""
    gone = F.transform("embedding", lambda x, i: F.when((i % 8 == 0) & (F.col("vec_id") % 100 != 0), F.lit(0.0).cast("float")).otherwise(x))
    return _asked(vectors).select((F.col("vec_id") + COPIES).alias("vec_id"), gone.alias("embedding"))


def check_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Altered copies checked against the whole library."""
    v = _vectors(spark, sf_dir)
    return check.check(_altered(v), v.select("vec_id", "embedding"), "vec_id", "embedding")


def import_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as records in order; a turn matches the turn before it unless a system turn parts them."""
    rows = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "turn")
    matches = rows.filter("turn > 0 AND role <> 'system'").select(F.col("id").alias("new_id"), (F.col("id") - 1).alias("old_id"), F.lit(95.0).alias("score"), F.lit(True).alias("strong"), F.lit(True).alias("learn_safe"))
    return clusters.imported(rows, matches.join(rows.select(F.col("id").alias("old_id")), "old_id", "left_semi"), "id")


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signal rows made from all events: each signal is a residue of the id, so that every rule has rows on both sides."""
    percent = lambda a, b, low: low + (F.col("event_id") * a + b) % 1000 * ((100 - low) / 1000.0)
    e = load(spark, sf, "events").select("event_id", (F.col("event_id") % 97).alias("query_id"))
    return e.select(
        "query_id", F.col("event_id").alias("cand_id"), percent(7, 3, 70).alias("p"), percent(11, 5, 70).alias("d"), percent(13, 1, 70).alias("roi"), percent(17, 2, 60).alias("hist"), percent(19, 4, 40).alias("orb"), percent(23, 6, 0).alias("ai"), percent(29, 8, 55).alias("copy"), percent(31, 9, 50).alias("geometry"),
        (F.col("event_id") * 3 % 40).alias("inliers"), (F.col("event_id") * 37 % 100 / 100.0).alias("ratio"), (F.col("event_id") * 41 % 100 / 400.0).alias("coverage_q"), (F.col("event_id") * 43 % 100 / 250.0).alias("coverage_c"), percent(47, 10, 0).alias("ssim"), (F.col("event_id") * 53 % 100 / 200.0).alias("overlap"),
        (F.col("event_id") % 5 != 0).alias("sane"), (F.col("event_id") % 7 == 0).alias("low_info"),
    )


def fusion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.fuse(_signals(spark, sf_dir))
    return found.select("query_id", "cand_id", F.round("base", 6).alias("base"), F.round("score", 6).alias("score"), "strong", "suspect", "learn_safe", "independent")


def fusion_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = fusion.verdict(fusion.best(fusion.fuse(_signals(spark, sf_dir)).withColumn("score", F.round("score", 6)), "query_id", "cand_id"))
    return best.select("query_id", "cand_id", "score", "verdict", "match_type", "action", "strong", "learn_safe")


def veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative evidence: structural similarity below 56 makes a candidate new."""
    found = fusion.vetoed(fusion.fuse(_signals(spark, sf_dir)), "ssim")
    return found.select("query_id", "cand_id", F.round("score", 6).alias("score"), "strong")


def exclusion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light candidates without those that an exclusion covers; every tenth query has been rejected with its neighbour id."""
    views = _full_views(spark, sf_dir).select("vec_id", "phash")
    found = band_candidates(spark, sf_dir).select("query_id", "cand_id")
    label = _vectors(spark, sf_dir).select(F.col("vec_id").alias("cand_id"), F.col("label").alias("cluster_id"))
    rows = found.join(views.select(F.col("vec_id").alias("query_id"), F.md5(F.col("phash").cast("binary")).alias("query_digest"), F.col("phash").alias("query_hash")), "query_id").join(label, "cand_id")
    rules = views.join(_vectors(spark, sf_dir).select("vec_id", "label"), "vec_id").filter(F.col("vec_id") % (10 * QUERY_STEP) == 0)
    rules = rules.select(F.md5(F.col("phash").cast("binary")).alias("digest"), F.col("phash").alias("hash"), (F.col("vec_id") + 1).alias("matched_id"), F.when(F.col("vec_id") % (20 * QUERY_STEP) == 0, F.col("label")).alias("cluster_id"))
    return feedback.excluded(rows.select("query_id", "query_digest", "query_hash", "cand_id", "cluster_id"), rules).select("query_id", "cand_id", "cluster_id")


def exclusion_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine candidates without those that an exclusion covers by vector; every fifth query, each 16th element halved, has been rejected with its best."""
    v = _vectors(spark, sf_dir)
    found = cosine_topk(spark, sf_dir)
    best = found.filter("rank = 1").select(F.col("query_id").alias("vec_id"), F.col("cand_id").alias("matched_id"))
    none = F.lit(None).cast("string")
    damped = F.transform("embedding", lambda x, i: F.when(i % 16 == 0, x / 2).otherwise(x.cast("double")))
    rules = v.filter(F.col("vec_id") % (5 * QUERY_STEP) == 0).join(best, "vec_id").select(none.alias("digest"), none.alias("hash"), "matched_id", F.col("label").alias("cluster_id"), damped.alias("vector"))
    own = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    label = v.select(F.col("vec_id").alias("cand_id"), F.col("label").alias("cluster_id"))
    rows = found.join(own, "query_id").join(label, "cand_id").select("query_id", none.alias("query_digest"), none.alias("query_hash"), "cand_id", "cluster_id", "query_vector")
    return feedback.excluded(rows, rules).select("query_id", "cand_id", "cluster_id")


def review_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "error"))
    rows = events.select(F.col("user_id").alias("review_id"), "event_id", "ts", F.when(F.col("event_type") == "click", "confirm").otherwise("reject").alias("decision"))
    return feedback.transitions(rows, "review_id", "ts", "event_id", "decision")


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = load(spark, sf, "customer")
    old = c.filter("c_custkey % 3 <> 0").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    new = c.filter("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("name"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.lower("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_acctbal") + 1).alias("balance"))
    return old, new


def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dml.merge(*_halves(spark, sf_dir), "c_custkey", {"name": dml.OVERWRITE, "segment": dml.KEEP_IF_EMPTY, "balance": dml.COALESCE})
    return found.withColumn("balance", F.round("balance", 2))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _halves(spark, sf_dir)
    return dml.audited(old, new, "c_custkey", "name", "segment")


def field_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _halves(spark, sf_dir)
    both = old.join(new.select("c_custkey", F.col("name").alias("name2"), F.col("segment").alias("segment2")), "c_custkey")
    found = T.conflicts({"name": F.col("name"), "segment": F.col("segment")}, {"name": F.col("name2"), "segment": F.col("segment2")})
    return both.select("c_custkey", F.explode(found).alias("x")).select("c_custkey", "x.*")


def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read back from one-line texts that are put together from suppliers."""
    line = F.concat(F.lit("note Vendor: "), F.col("s_name"), F.lit(" ; Nation code = "), F.col("s_nationkey"), F.lit(", NATION ："), F.lit("old / nation: n"), F.col("s_nationkey"), F.lit(" |"))
    fields = T.labelled_fields(line, {"vendor": ["vendor", "seller"], "code": ["nation code"], "nation": ["nation"]})
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", fields.alias("f"))
    return rows.select("s_suppkey", *[F.element_at("f", k).alias(k) for k in ("vendor", "code", "nation")], T.is_record(F.col("f"), "vendor").alias("valid"))


def short_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    return c.filter(T.short_query(F.col("text"), r"(?i)the|que|der|\.\s*$")).select("conv_id", "turn", F.length("text").cast("long").alias("n"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations")
    n = F.length(F.coalesce("text", F.lit("")))
    return c.select("conv_id", "turn", "role", n.alias("n"), (F.col("role") == "system").alias("service"), (n % 3 == 0).alias("joined"), F.when(n % 4 == 0, n).alias("media"), (n % 5 == 0).alias("record"))


def sender_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).withColumn("named", F.when(~F.col("joined"), F.col("role")))
    return link.carry_forward(rows, "conv_id", "turn", "named", "service", "history").select("conv_id", "turn", "carried")


def reply_chain4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).select("conv_id", "turn", (F.col("turn") - 1).alias("parent"), "media")
    return link.reply_chain(rows, "conv_id", "turn", "parent", "media").select("conv_id", "turn", "found_key", F.col("found").cast("long").alias("found"), "hops")


def lookback7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).withColumn("at", F.col("turn") * 100)
    return link.look_back(rows, "conv_id", "turn", "role", "joined", "service", "record", "media", "at").select("conv_id", "turn", "linked")


def latest_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    asks = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("ask_id"), "ts")
    facts = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("fact_id"), "ts")
    return link.latest_as_of(asks, facts, "user_id", "ask_id", "ts", "fact_id", "ts", 3 * 3600)


def interval_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    views = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("open_id"), "ts")
    buys = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("close_id"), "ts")
    return link.interval_pairs(views, buys, "user_id", "open_id", "close_id", "ts")


def consume_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.consume_once(load(spark, sf_dir, "events"), "user_id", "event_id", "ts", "event_type", "view", "purchase")


def ttl_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views by age at the time of the newest event."""
    e = load(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now")).withColumn("_", F.lit(1))
    rows = e.filter("event_type = 'view'").withColumn("_", F.lit(1)).join(now, "_")
    return link.expired(rows, "event_id", "ts", F.col("now"), 86_400)


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, as escaping wrote it, and number of links of each page, and whether it has visible text."""
    found = exports.page_fields(load(spark, sf_dir, "pages"), "page_id", "html")
    return found.select("page_id", F.col("plain_title").alias("title"), "n_links", (F.length("text") > 0).alias("has_text"))


def entropy_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.entropy(_documents(spark, sf_dir), "doc_id", "text")


def record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions on suppliers: identifier, object key, clipped and escaped text, and the parsed date of an order."""
    o = load(spark, sf_dir, "orders")
    stamp = F.date_format("o_orderdate", "dd.MM.yyyy HH:mm:ss")
    return o.select("o_orderkey", T.identifier(F.col("o_orderpriority")).alias("ident"), T.object_key(F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))).alias("object"), T.clipped(F.col("o_orderpriority"), 6).alias("clip"), T.escaped(F.concat(F.lit("_"), "o_orderstatus", F.lit("*"))).alias("escaped"), T.parsed_date(F.concat(stamp, F.lit(" UTC+08:00"))).alias("parsed"))


def cascade12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.cascade(_signals(spark, sf_dir), "query_id", "cand_id").select("query_id", "cand_id", "light", "base", "place")


def review_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending reviews of the queries whose best candidate asks for one; each three events are a query's candidates."""
    fused = fusion.fuse(_signals(spark, sf_dir).withColumn("query_id", F.expr("cand_id div 3"))).withColumn("score", F.round("score", 6))
    return records.review_records(fusion.verdict(fusion.best(fused, "query_id", "cand_id")))


def buffer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are kept one a user, views one an event."""
    e = load(spark, sf_dir, "events").filter("event_type IN ('click', 'view')")
    return records.buffered(e, "user_id", "event_id", "ts", "event_type", ["click"])


def buffer_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All buffered rows at a restart half an hour after the newest event."""
    e = load(spark, sf_dir, "events")
    rows = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    age = (link.micros("now") - link.micros("ts")) / 1e6 + 1800
    return records.restored(rows, "event_id", age)


def last_wins_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    users = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return records.last_wins(users, e, "user_id", ["ts", "event_id"], "event_type")


def most_frequent_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.most_frequent(load(spark, sf_dir, "events"), "user_id", "event_type")


def import_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return records.run_counters(t, {"scanned": F.lit(True), "services": F.col("service"), "with_media": F.col("media").isNotNull(), "records": F.col("record"), "media_without_record": F.col("media").isNotNull() & ~F.col("record")})


def stale_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.stale(load(spark, sf_dir, "pages"), "url", "https://").select("page_id", "url")


def supplier_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of suppliers; a nation key below 5 stands for the supplier itself, one of 10 to 14 is empty."""
    nation = F.when(F.col("s_nationkey").between(10, 14), "").otherwise(F.col("s_nationkey").cast("string"))
    shown = records.alias_of(nation, ["0", "1", "2", "3", "4"], F.col("s_name"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", records.summary({"name": F.col("s_name"), "nation": shown}).alias("card"))


def backlog_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest 20 documents without a label."""
    return coverage.backlog(load(spark, sf_dir, "documents").select("doc_id", "source"), load(spark, sf_dir, "labels"), "doc_id", 20)


QUERIES = (
    cascade12, review_records, buffer_state, buffer_restore, last_wins_lookup, most_frequent_type, import_counters, stale_paths, supplier_cards, backlog_batch,
    dup_documents, digest_any, insert_if_absent, coverage_stats, label_backlog, orphan_keys, sig_views, band_index, band_candidates, hamming_best_pair, cosine_topk, simhash_lsh_vote, exact_or_lsh, lsh_rescored, candidate_union, knn_mutual, check_library, import_clusters,
    fusion_scores, fusion_verdict, veto, exclusion_filter, exclusion_vectors, review_transition, merge_upsert, audit_log, field_conflicts, label_parse, short_text_filter, sender_carry_forward, reply_chain4, lookback7, latest_asof, interval_pair, consume_once, ttl_expiry, html_extract, entropy_quality, record_text,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
