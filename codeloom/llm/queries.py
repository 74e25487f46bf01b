"""The queries of this subpackage: pN_... over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.labels import dimension_of, framework_rows, polarity_of
from codeloom.llm import abuse, baskets, consensus, mixing, packing, pairs, pii, sentences, tokens
from codeloom.plans.oracles import spelling
from codeloom.session import materialise, small

#: Thresholds that the problem states.
MIN_TOGETHER, MIN_RATIO = 5, 2.75


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of items with counts and ratio."""
    b = baskets.dimension_baskets(_t(spark, d, "records"), _t(spark, d, "frameworks"))
    b = b.unionByName(baskets.label_baskets(_t(spark, d, "open_records"), _t(spark, d, "codebooks")))
    # Rows that arrived within a day first, then the late ones as a second batch of changes.
    in_time = F.col("received_at") <= F.col("saved_at") + F.expr("interval 1 day")
    return pairs.count_pairs(b, [in_time])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    s = p1_scores(spark, d).filter((F.col("n_ab") >= MIN_TOGETHER) & (F.col("n_ab") * F.col("n_all").cast("decimal(38,0)") > F.lit(MIN_RATIO).cast("decimal(4,2)") * F.col("n_a").cast("decimal(38,0)") * F.col("n_b")))
    return s.select(F.col("scope").alias("scope_id"), "item_a", "item_b")


def _segments(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    """Entries of ``segments`` with the given fields; null entries are left out."""
    seg = _t(spark, d, "records").select("record_id", F.explode("segments").alias("s")).filter("s is not null")
    return seg.select("record_id", "s.segment_id", *[f"s.{f}" for f in fields])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Splitting repeated rows again costs less than shuffling texts to drop them first: only spans are shuffled."""
    return sentences.split_sentences(_segments(spark, d, "full_text"), ["record_id", "segment_id"], "full_text").distinct()


def _judgements(spark: SparkSession, d: str) -> DataFrame:
    rows = framework_rows(_t(spark, d, "frameworks"))
    units = small(_t(spark, d, "units").filter("unit_id is not null").select("unit_id", "framework_id").dropDuplicates(["unit_id"]))
    code = lambda c: F.concat(dimension_of(rows, F.col("framework_id"), c["dimension"]), F.lit(consensus.SEP), polarity_of(rows, F.col("framework_id"), c["polarity"]))
    return _t(spark, d, "codings").join(units, "unit_id").select("unit_id", "coder", "coded_at", "received_at", F.transform("codes", code).alias("labels"))


def p4_consensus(spark: SparkSession, d: str) -> consensus.Consensus:
    return consensus.reach_consensus(_judgements(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split(F.col("label"), consensus.SEP)
    return p4_consensus(spark, d).labels.select("unit_id", parts[0].alias("dimension"), parts[1].alias("polarity"))


def p4_coders(spark: SparkSession, d: str) -> DataFrame:
    """Reliability of every coder."""
    return p4_consensus(spark, d).annotators


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Chance-corrected agreement of all judgements."""
    return consensus.alpha_of_sets(consensus.latest_judgements(_judgements(spark, d)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    spans = pii.pii_spans(_segments(spark, d, "full_text", "quote"), ["record_id", "segment_id"], ["full_text", "quote"])
    return spans.drop("score").distinct()


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    """Texts and quotes with placeholders; repeated rows of a record count once."""
    seg = _segments(spark, d, "full_text", "quote")
    return seg.select("record_id", "segment_id", pii.mask(F.col("full_text")).alias("full_text"), pii.mask(F.col("quote")).alias("quote")).distinct()


def _sizes(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return tokens.count_tokens(_t(spark, d, "documents"), list(keys))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = materialise(_sizes(spark, d, "doc_id"), "tokens")
    return packing.pack(sizes, _t(spark, d, "pack_limits"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill_report(p6_pack(spark, d), _t(spark, d, "pack_limits"))


def p7_draw(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw(_sizes(spark, d, "doc_id", "source"), _t(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares."""
    return mixing.shares(p7_draw(spark, d), _t(spark, d, "mix_targets"))


def _scored(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return abuse.score_documents(_t(spark, d, "documents").select("doc_id", "text", *columns), _t(spark, d, "abuse_reviews"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter(F.col("abuse_score") >= abuse.ABUSIVE).select("doc_id").distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents and rate of abusive ones per source; null where the reviews make up no model."""
    bad = (F.col("abuse_score") >= abuse.ABUSIVE).cast("int")
    return _scored(spark, d, "source").groupBy(mixing.source_key(F.col("source")).alias("source")).agg(F.count("*").alias("docs"), F.sum(bad).alias("abusive"), F.avg(bad.cast("double")).alias("rate"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_found, p1_scores, p3_found, p4_found, p4_coders, p4_agreement, p5_found, p5_masked, p6_pack, p6_fill, p7_draw, p7_shares, p8_found, p8_rates)
    return {f.__name__: f for f in named}


_CLEAN = (
    "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[\\s\\x{{3000}}\\x{{a0}}]+', ' ', 'g'), "
    "'(?i)^(\\s*(\\[\\s*\\d+\\s*[x×]\\s*\\]|\\[\\s*new( code)?\\s*\\]|【[^】]*】|new( code)?\\s*[:：]|[-*•#>]+ ))+', ''), '\\s[—–-]+\\s.*$', ''), '——.*$', ''), "
    "'^[\\s\"''“”‘’«»「『*_`]+|[\\s\"''“”‘’«»」』*_`.。．!！?？;；:：,，、…]+$', '', 'g'))"
)

_P1 = f"""WITH rec AS (SELECT * FROM records QUALIFY record_id IS NULL OR row_number() OVER (PARTITION BY record_id ORDER BY saved_at DESC) = 1),
 orec AS (SELECT * FROM open_records QUALIFY record_id IS NULL OR row_number() OVER (PARTITION BY record_id ORDER BY saved_at DESC) = 1),
 seg AS (SELECT record_id, _meta.framework_id AS framework_id, i AS pos, segments[i].codes AS codes FROM rec, unnest(range(1, coalesce(len(segments), 0) + 1)) t(i)),
 entry AS (SELECT record_id, framework_id, pos, c.dimension AS raw FROM (SELECT record_id, framework_id, pos, unnest(codes) AS c FROM seg)),
 {spelling("entry")},
 oseg AS (SELECT record_id, _meta.codebook_id AS scope, i AS pos, open_segments[i].open_codes AS codes FROM orec, unnest(range(1, coalesce(len(open_segments), 0) + 1)) t(i)),
 oentry AS (SELECT record_id, scope, pos, {_CLEAN.format("c.label")} AS k FROM (SELECT record_id, scope, pos, unnest(codes) AS c FROM oseg)),
 book AS (SELECT codebook_id AS scope, {_CLEAN.format("c.label")} AS k, min(c.label) AS item FROM (SELECT codebook_id, unnest(codes) AS c FROM codebooks) WHERE c.label IS NOT NULL GROUP BY 1, 2),
 x AS (SELECT DISTINCT 'r' || e.record_id || '#' || e.pos AS basket, e.framework_id AS scope, s.dimension AS item FROM entry e JOIN spell s ON s.framework_id = e.framework_id AND s.raw = e.raw
  UNION SELECT DISTINCT 'o' || e.record_id || '#' || e.pos, e.scope, b.item FROM oentry e JOIN book b ON b.scope = e.scope AND b.k = e.k),
 n AS (SELECT scope, count(DISTINCT basket) AS n_all FROM x GROUP BY 1), m AS (SELECT scope, item, count(*) AS k FROM x GROUP BY 1, 2),
 p AS (SELECT a.scope, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM x a JOIN x b ON a.basket = b.basket AND a.item < b.item GROUP BY 1, 2, 3),
 r AS (SELECT p.scope, p.item_a, p.item_b, n_ab, a.k AS n_a, b.k AS n_b, n_all FROM p JOIN n ON n.scope = p.scope JOIN m a ON a.scope = p.scope AND a.item = p.item_a JOIN m b ON b.scope = p.scope AND b.item = p.item_b)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_scores": f"{_P1} SELECT scope, item_a, item_b, n_ab, n_a, n_b, n_all, n_ab * n_all::DOUBLE / (n_a::DOUBLE * n_b) AS ratio FROM r",
        "p1_found": f"{_P1} SELECT scope AS scope_id, item_a, item_b FROM r WHERE n_ab >= 5 AND n_ab * n_all > 2.75 * n_a * n_b",
    }
