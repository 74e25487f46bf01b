"""Queries over the core operators, and their SQL (see plans/oracles.py)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.framework import Framework
from codeloom.functions import segmenting, text as tx
from codeloom.functions.arrays import sorted_set
from codeloom.functions.labels import framework_rows
from codeloom.operators import agreement, coding, cooccur, corpus, crosstab as ct, frame, lexicon, longtable, marks, migrate, openbook, review, themes
from codeloom.plans import oracles
from codeloom.session import materialise
from codeloom.sources import export, files, hearing, nested
from codeloom.streaming.review import action_counts

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Framework of the agreement queries and its codes.
FRAMEWORK = "ri_core"
CODES = [f"{s}-{p}" for s in ("ANT", "ENG", "REF", "RES") for p in ("P", "N")]


def query(f: Callable) -> Callable:
    _Q[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r9(c: str) -> F.Column:
    """Nine decimals: what two engines' floating point agrees on."""
    return F.round(F.col(c), 9).alias(c)


# --- nested payloads ---------------------------------------------------------------------


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every code entry of every readable payload with its place, linked by interval containment."""
    linked = nested.link_nodes(nested.node_table(_t(spark, d, "raw_records")).drop("attrs"))
    codes = linked.filter("kind = 'code'").select(
        "raw_id", F.col("record.pos").alias("rec_pos"), F.coalesce("window.pos", F.lit(-1)).alias("window_pos"), "list_name",
        F.col("segment.pos").alias("seg_pos"), F.col("segment.ident").alias("segment_id"), F.col("pos").alias("code_pos"), F.col("ident").alias("item"))
    return codes.distinct()


@query
def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of records with the number of their segments and codes, 0 where there are none."""
    linked = nested.link_nodes(nested.node_table(_t(spark, d, "raw_records")).drop("attrs")).withColumn("pos", F.coalesce("record.pos", "pos")).withColumn("pre", F.coalesce("record.pre", "pre"))
    # A record's own node carries its row; records at one position of different envelopes are told apart by their label.
    rows = linked.filter("kind in ('record', 'segment', 'code')").groupBy("raw_id", "payload_hash", "pre", F.col("pos").alias("rec_pos"))
    n = lambda kind: F.sum((F.col("kind") == kind).cast("int")).alias(f"{kind}s")
    return rows.agg(n("segment"), n("code")).select("raw_id", "rec_pos", "segments", "codes")


@query
def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of segments with title and quote."""
    s = nested.segment_table(nested.link_nodes(nested.node_table(_t(spark, d, "raw_records"), attributes=True)))
    return s.select("raw_id", "rec_pos", "window_pos", "list_name", "seg_pos", "segment_id", F.try_element_at("attrs", F.lit("title")).alias("title"), F.try_element_at("attrs", F.lit("quote")).alias("quote"))


@query
def payload_states(spark: SparkSession, d: str) -> DataFrame:
    """How many payloads can be read."""
    return nested.payload_status(_t(spark, d, "raw_records").select("raw_id", "payload")).groupBy("status").agg(F.count("*").alias("n"))


# --- the star schema as a long table: record = customer, segment = order, code = flag-status ----


def star_long(spark: SparkSession, d: str) -> DataFrame:
    line = _t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").distinct()
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("record_id"), F.col("o_custkey").cast("string").alias("respondent"), F.col("l_orderkey").alias("segment"), F.col("l_returnflag").alias("dimension"), F.col("l_linestatus").alias("polarity"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("code"), F.col("c_mktsegment").alias("institution_type"), F.col("o_orderpriority").alias("priority"))


@query
def long_star(spark: SparkSession, d: str) -> DataFrame:
    return star_long(spark, d).select("respondent", "segment", "dimension", "polarity", "code", "institution_type")


@query
def crosstab_code(spark: SparkSession, d: str) -> DataFrame:
    return ct.crosstab(star_long(spark, d), "institution_type", "code")


@query
def crosstab_dimension(spark: SparkSession, d: str) -> DataFrame:
    return ct.crosstab(star_long(spark, d), "institution_type", "dimension")


@query
def crosstab_polarity(spark: SparkSession, d: str) -> DataFrame:
    return ct.crosstab(star_long(spark, d), "institution_type", "polarity")


@query
def crosstab_pct(spark: SparkSession, d: str) -> DataFrame:
    return ct.percent(ct.crosstab(star_long(spark, d), "institution_type", "code")).select("by", "unit", "n", r9("pct"))


@query
def crosstab_wide(spark: SparkSession, d: str) -> DataFrame:
    return ct.pivoted(ct.crosstab(star_long(spark, d), "institution_type", "dimension"), ["A", "N", "R"])


@query
def crosstab_case_level(spark: SparkSession, d: str) -> DataFrame:
    return ct.case_level(star_long(spark, d), "institution_type", "code")


_CHI = ("chi2", "min_expected", "cramers_v")


@query
def chi2_components(spark: SparkSession, d: str) -> DataFrame:
    t = ct.chi_square(ct.crosstab(star_long(spark, d), "institution_type", "dimension"))
    return t.select(*[F.round(c, 6).alias(c) for c in _CHI], "dof", "n", "small_cells", "verdict")


@query
def chi2_p(spark: SparkSession, d: str) -> DataFrame:
    return ct.with_p(ct.chi_square(ct.crosstab(star_long(spark, d), "institution_type", "dimension")))


@query
def test_sweep(spark: SparkSession, d: str) -> DataFrame:
    return ct.with_p(ct.test_sweep(star_long(spark, d), ["institution_type", "priority"], ["code", "dimension", "polarity"]))


@query
def cooccurrence_segment(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.cooccurrence(star_long(spark, d), ["segment"]).select("code_a", "code_b", "n", r9("jaccard"))


@query
def cooccurrence_case(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.cooccurrence(star_long(spark, d), ["respondent"]).select("code_a", "code_b", "n", r9("jaccard"))


@query
def cooccurrence_totals(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.totals(star_long(spark, d), ["segment"])


@query
def cooccurrence_dense(spark: SparkSession, d: str) -> DataFrame:
    long = star_long(spark, d)
    codes = long.select("code").distinct()
    return cooccur.dense(cooccur.cooccurrence(long, ["segment"]), cooccur.totals(long, ["segment"]), codes)


@query
def top_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.top_pairs(cooccur.cooccurrence(star_long(spark, d), ["segment"]), 5).select("code_a", "code_b", "n", r9("jaccard"), "cross_dimension")


@query
def case_matrix(spark: SparkSession, d: str) -> DataFrame:
    long = star_long(spark, d)
    return ct.case_matrix(long, long.select("code").distinct())


@query
def case_matrix_pct(spark: SparkSession, d: str) -> DataFrame:
    long = star_long(spark, d)
    return ct.case_matrix(long, long.select("code").distinct(), by_percent=True).select("respondent", "code", r9("pct"))


@query
def polarity_balance(spark: SparkSession, d: str) -> DataFrame:
    b = ct.polarity_balance(star_long(spark, d), "O", "F")
    return b.select("respondent", "dimension", "high", "low", "total", r9("ratio"), r9("index"))


# --- nested records ------------------------------------------------------------------------


def _records(spark: SparkSession, d: str) -> DataFrame:
    return longtable.first_rows(_t(spark, d, "records"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    return longtable.build_long(_records(spark, d), _t(spark, d, "frameworks"))


@query
def long_records(spark: SparkSession, d: str) -> DataFrame:
    """Long table of the nested records."""
    return _long(spark, d).select("record_id", "seg_pos", "segment_id", "framework_id", "dimension", "polarity", "code", "multi_coded", "codes_in_segment", "status", "source", "endpoint")


@query
def crosstab_records(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d).withColumn("institution_type", F.try_element_at("descriptors", F.lit("institution_type")))
    return ct.crosstab(long.filter("institution_type <> 'unspecified'"), "institution_type", "dimension")


@query
def coverage(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return longtable.coverage(r, longtable.build_long(r, _t(spark, d, "frameworks"))).select("record_id", "segments", "codes", "coded", "dimensions", "multi", r9("multi_rate"))


@query
def code_audit(spark: SparkSession, d: str) -> DataFrame:
    """Dropped code entries by reason."""
    return migrate.drop_summary(migrate.code_audit(_records(spark, d), _t(spark, d, "frameworks")))


@query
def framework_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return migrate.framework_mismatch(_records(spark, d), FRAMEWORK).select("record_id", F.col("_meta.framework_id").alias("framework_id"))


@query
def descriptor_values(spark: SparkSession, d: str) -> DataFrame:
    v = _records(spark, d).select(F.explode("descriptors").alias("descriptor", "value")).filter("descriptor = 'sector'")
    clean = migrate.descriptor_value(F.col("value"), ["finance", "agritech", "biomedical", "ict_ai", "manufacturing", "energy_sustainability"])
    return v.groupBy(clean.alias("value")).agg(F.count("*").alias("n"))


@query
def saved_index(spark: SparkSession, d: str) -> DataFrame:
    return files.saved_index(_records(spark, d))


@query
def provenance(spark: SparkSession, d: str) -> DataFrame:
    return export.provenance(_records(spark, d))


@query
def endpoints(spark: SparkSession, d: str) -> DataFrame:
    return export.endpoint_rows(_records(spark, d))


@query
def quote_verify(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of every segment against their record's transcript."""
    r = _records(spark, d)
    q = longtable.segments_of(r).select("record_id", F.concat_ws("#", "record_id", "seg_pos").alias("quote_id"), F.col("segment.quote").alias("quote"))
    return coding.verify_quotes(q, r.select("record_id", F.col("transcript").alias("text")), "record_id")


@query
def quote_units(spark: SparkSession, d: str) -> DataFrame:
    """Quotes located in units of the same record (units: full texts)."""
    # Only the two texts of a segment are read; one table serves as quotes and as units.
    texts = F.arrays_zip(F.col("segments.quote").alias("quote"), F.col("segments.full_text").alias("text")).alias("texts")
    r = longtable.first_rows(_t(spark, d, "records").select("record_id", "saved_at", "received_at", texts)).filter("record_id is not null")
    seg = r.select("record_id", F.posexplode("texts").alias("seg_pos", "s")).select("record_id", F.concat_ws("#", "record_id", "seg_pos").alias("id"), "s.*")
    seg = materialise(seg, "segment_texts")
    return frame.located(seg.select("record_id", F.col("id").alias("quote_id"), "quote"), seg.select("record_id", F.col("id").alias("unit_id"), "text"), "record_id")


def _segment_codes(spark: SparkSession, d: str) -> DataFrame:
    """Segments and deleted segments with status, snapshot and current codes as written."""
    seg = longtable.segments_of(_records(spark, d), ("segments", "deleted_segments"))
    return seg.select("record_id", "list_name", "seg_pos", F.col("segment.review.status").alias("status"), F.col("segment.review.source").alias("source"), F.col("segment.review.original_codes").alias("original_codes"),
                      sorted_set(F.transform("segment.codes", lambda c: F.trim(c["dimension"]))).alias("code_list"))


@query
def review_stats(spark: SparkSession, d: str) -> DataFrame:
    s = review.stats(_segment_codes(spark, d))
    return s.select("ai", "reviewed", "confirmed", "modified", "deleted", "human_added", "human_deleted", "active", "pending", r9("confirmed_rate"))


@query
def code_changes(spark: SparkSession, d: str) -> DataFrame:
    s = _segment_codes(spark, d).filter("list_name = 'segments' and original_codes is not null")
    return review.code_changes(s).select("code", "original", "kept", "removed", "added", r9("removal_rate"), "net")


@query
def changed_segments(spark: SparkSession, d: str) -> DataFrame:
    return review.changed_segments(_segment_codes(spark, d).filter("list_name = 'segments'"))


@query
def review_events(spark: SparkSession, d: str) -> DataFrame:
    """Review events per action and day."""
    e = review.history_rows(_records(spark, d))
    return e.groupBy("action", F.to_date("time").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query
def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    return review.audit_trail(review.history_rows(_records(spark, d)), 50).select("record_id", "list_name", "seg_pos", "event_pos", "time", "action")


@query
def action_windows(spark: SparkSession, d: str) -> DataFrame:
    """Event types per hour (the batch form of the streaming count)."""
    e = _t(spark, d, "events").select(F.col("ts").alias("time"), F.col("event_type").alias("action"))
    return action_counts(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "action", "n")


@query
def respondent_names(spark: SparkSession, d: str) -> DataFrame:
    """Plurality name per transcript file."""
    n = _t(spark, d, "documents").filter("transcript_file is not null").select("transcript_file", F.col("respondent").alias("name"), F.col("doc_id").alias("ord"))
    return coding.merge_respondent(n, ["transcript_file"])


@query
def merged_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """First specified value per respondent and descriptor."""
    p = _records(spark, d).filter("respondent is not null").select("respondent", F.col("record_id").alias("ord"), F.explode("descriptors").alias("descriptor", "value"))
    return coding.merge_descriptors(p, ["respondent"])


@query
def yield_report(spark: SparkSession, d: str) -> DataFrame:
    """Codes per 10,000 characters of transcript, with flags, by the dimensions of each record's framework."""
    r = _records(spark, d).withColumn("framework_id", F.col("_meta.framework_id"))
    wanted = longtable.dimensions_of(framework_rows(_t(spark, d, "frameworks")), F.col("framework_id"), "dimension")
    seg = longtable.build_long(r, _t(spark, d, "frameworks")).groupBy("record_id", "seg_pos").agg(F.collect_set("dimension").alias("dimensions")).select("record_id", "dimensions")
    out = coding.yield_report(r.select("record_id", "framework_id", F.col("transcript").alias("text")), seg, "record_id", wanted, ("framework_id",))
    return out.select("framework_id", "record_id", "chars", "segments", r9("per_10k"), "flags")


@query
def resume(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose transcript file no record was made from."""
    docs = _t(spark, d, "documents").filter("transcript_file is not null").select("doc_id", "transcript_file")
    return coding.already_done(docs, _t(spark, d, "records").filter("transcript_file is not null"), ["transcript_file"])


# --- agreement: the coder with most judgements against the model's codes (its SQL reads this part only; the _all queries read all) ---


def _hub(spark: SparkSession, d: str) -> DataFrame:
    """(unit_id, codes_a of the busiest coder, codes_b of the model) for the units of one framework."""
    rows = framework_rows(_t(spark, d, "frameworks"))
    u = _t(spark, d, "units").filter(F.col("framework_id") == FRAMEWORK).select("unit_id", "framework_id", F.col("ai_codes").alias("codes_b"))
    c = _t(spark, d, "codings").filter(F.lower(F.trim("coder")) == "coder_hub").join(u.select("unit_id", "framework_id"), "unit_id")
    fw = F.col("framework_id")
    one = lambda x: longtable.code_string(rows, fw, longtable.dimension_of(rows, fw, x["dimension"]), longtable.polarity_of(rows, fw, x["polarity"]))
    codes = sorted_set(F.transform("codes", one))
    a = c.select("unit_id", F.struct("coded_at", "received_at", codes.alias("codes")).alias("j")).groupBy("unit_id").agg(F.max("j").alias("j")).select("unit_id", F.col("j.codes").alias("codes_a"))
    return a.join(u.select("unit_id", sorted_set(F.col("codes_b")).alias("codes_b")), "unit_id")


_KAPPA = ("po", "kappa", "pabak", "ac1", "prevalence", "bias")


@query
def kappa_per_code(spark: SparkSession, d: str) -> DataFrame:
    k = agreement.with_bands(agreement.per_code(_hub(spark, d), CODES))
    return k.select("code", "n", "both_yes", "neither", "only_a", "only_b", *[r9(c) for c in _KAPPA], "band", "paradox")


@query
def kappa_pooled(spark: SparkSession, d: str) -> DataFrame:
    return agreement.pooled(_hub(spark, d), CODES).select("n", "both_yes", "neither", "only_a", "only_b", *[r9(c) for c in _KAPPA])


@query
def exact_set(spark: SparkSession, d: str) -> DataFrame:
    return agreement.exact_set(_hub(spark, d)).select("n", r9("exact"))


@query
def alpha_nominal(spark: SparkSession, d: str) -> DataFrame:
    """Alpha over the verdicts on documents."""
    v = _t(spark, d, "abuse_reviews").select(F.col("doc_id").alias("unit_id"), F.col("verdict").alias("value"))
    return agreement.alpha_nominal(v).select("pairable", r9("alpha"))


@query
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return agreement.precision_recall(_hub(spark, d), CODES).select("code", "tp", "fp", "fn", r9("precision"), r9("recall"), r9("f1"))


@query
def dimension_confusion(spark: SparkSession, d: str) -> DataFrame:
    return agreement.dimension_confusion(_hub(spark, d))


@query
def polarity_confusion(spark: SparkSession, d: str) -> DataFrame:
    return agreement.polarity_confusion(_hub(spark, d))


@query
def dimension_agreement(spark: SparkSession, d: str) -> DataFrame:
    return agreement.dimension_agreement(_hub(spark, d), ["ANT", "ENG", "REF", "RES"]).select("code", "n", "both_yes", "neither", "only_a", "only_b", r9("kappa"))


@query
def disagreements(spark: SparkSession, d: str) -> DataFrame:
    return agreement.disagreements(_hub(spark, d)).select("unit_id", "kind", "only_a", "only_b")


# --- the same for every coder and every framework -----------------------------------------------

_PAIR = ["framework_id", "coder"]


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """(framework_id, coder, unit_id, codes_a of the coder, codes_b of the model, wanted, dims) for every judged unit.

    Coders are the same if their names differ only in case or outer blanks; of several
    judgements the latest holds. wanted and dims are the framework's codes and dimensions.
    """
    rows = framework_rows(_t(spark, d, "frameworks"))
    fw = F.col("framework_id")
    u = _t(spark, d, "units").select("unit_id", "framework_id", sorted_set(F.col("ai_codes")).alias("codes_b"))
    c = _t(spark, d, "codings").select("unit_id", F.lower(F.trim("coder")).alias("coder"), "codes", "coded_at", "received_at").join(u.select("unit_id", "framework_id"), "unit_id")
    one = lambda x: longtable.code_string(rows, fw, longtable.dimension_of(rows, fw, x["dimension"]), longtable.polarity_of(rows, fw, x["polarity"]))
    j = F.struct("coded_at", "received_at", sorted_set(F.transform("codes", one)).alias("codes"))
    a = c.groupBy("unit_id", "coder").agg(F.max(j).alias("j")).select("unit_id", "coder", F.col("j.codes").alias("codes_a"))
    return a.join(u, "unit_id").select(*_PAIR, "unit_id", "codes_a", "codes_b", longtable.codes_of(rows, fw).alias("wanted"), longtable.dimensions_of(rows, fw).alias("dims"))


@query
def kappa_per_code_all(spark: SparkSession, d: str) -> DataFrame:
    k = agreement.with_bands(agreement.per_code(_pairs(spark, d), F.col("wanted"), _PAIR))
    return k.select(*_PAIR, "code", "n", "both_yes", "neither", "only_a", "only_b", *[r9(c) for c in _KAPPA], "band", "paradox")


@query
def kappa_pooled_all(spark: SparkSession, d: str) -> DataFrame:
    return agreement.pooled(_pairs(spark, d), F.col("wanted"), _PAIR).select(*_PAIR, "n", "both_yes", "neither", "only_a", "only_b", *[r9(c) for c in _KAPPA])


@query
def pooled_alpha_all(spark: SparkSession, d: str) -> DataFrame:
    return agreement.pooled_alpha(_pairs(spark, d), F.col("wanted"), _PAIR).select(*_PAIR, "pairable", r9("alpha"))


@query
def menu_labels(spark: SparkSession, d: str) -> DataFrame:
    """Names of records in a menu, told apart by their file."""
    return longtable.menu_labels(_records(spark, d))


@query
def segment_texts(spark: SparkSession, d: str) -> DataFrame:
    """Segments by whether their text is the full one, the quote or missing, with the characters."""
    s = longtable.segments_of(_records(spark, d)).select(longtable.segment_text(F.col("segment")).alias("t"), F.col("segment.full_text").alias("f"))
    kind = F.when(F.col("t").isNull(), "none").when(F.trim("f") != "", "full").otherwise("quote")
    return s.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars"))


@query
def exact_set_all(spark: SparkSession, d: str) -> DataFrame:
    return agreement.exact_set(_pairs(spark, d), _PAIR).select(*_PAIR, "n", r9("exact"))


@query
def precision_recall_all(spark: SparkSession, d: str) -> DataFrame:
    return agreement.precision_recall(_pairs(spark, d), F.col("wanted"), _PAIR).select(*_PAIR, "code", "tp", "fp", "fn", r9("precision"), r9("recall"), r9("f1"))


@query
def dimension_confusion_all(spark: SparkSession, d: str) -> DataFrame:
    return agreement.dimension_confusion(_pairs(spark, d), keys=_PAIR)


@query
def polarity_confusion_all(spark: SparkSession, d: str) -> DataFrame:
    return agreement.polarity_confusion(_pairs(spark, d), _PAIR)


@query
def dimension_agreement_all(spark: SparkSession, d: str) -> DataFrame:
    return agreement.dimension_agreement(_pairs(spark, d), F.col("dims"), _PAIR).select(*_PAIR, "code", "n", "both_yes", "neither", "only_a", "only_b", r9("kappa"))


@query
def disagreements_all(spark: SparkSession, d: str) -> DataFrame:
    return agreement.disagreements(_pairs(spark, d), _PAIR).select(*_PAIR, "unit_id", "kind", "only_a", "only_b")


@query
def adjudicated(spark: SparkSession, d: str) -> DataFrame:
    """Every third disagreement of every coder with the model left open, the others decided as both."""
    rows = _pairs(spark, d).withColumn("decision", F.when(F.crc32(F.col("unit_id")) % 3 > 0, "both_yes")).withColumn("custom_codes", F.array().cast("array<string>"))
    return marks.adjudicate(rows).select(*_PAIR, "unit_id", F.array_join("codes", "/").alias("codes"), "undecided")


@query
def frame_roles(spark: SparkSession, d: str) -> DataFrame:
    return frame.frame_counts(_t(spark, d, "units").select(F.col("speaker_role").alias("role")))


@query
def strata(spark: SparkSession, d: str) -> DataFrame:
    """Units per stratum as the frame would set it."""
    u = _t(spark, d, "units").withColumn("codes", sorted_set(F.col("ai_codes")))
    return u.groupBy(F.when(F.size("codes") > 0, F.array_join("codes", "+")).otherwise(frame.UNMARKED).alias("stratum")).agg(F.count("*").alias("n"))


@query
def sample_units(spark: SparkSession, d: str) -> DataFrame:
    """Stratified sample of every framework's units (a sampling operator)."""
    return frame.stratified_samples(_t(spark, d, "units"), longtable.codes_of(framework_rows(_t(spark, d, "frameworks")), F.col("framework_id")))


@query
def session_ids(spark: SparkSession, d: str) -> DataFrame:
    u = _t(spark, d, "units").groupBy("session_id").agg(F.array_sort(F.collect_list("unit_id")).alias("ids"))
    return u.select("session_id", export.session_id(F.col("ids"), F.lit(42)).alias("digest"))


# --- texts --------------------------------------------------------------------------------------


@query
def scripts(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "documents").filter("text is not null")
    return x.groupBy(tx.script(F.col("text")).alias("script")).agg(F.count("*").alias("docs"), F.sum(tx.estimate_tokens(F.col("text"))).alias("tokens"))


@query
def normalised_text(spark: SparkSession, d: str) -> DataFrame:
    """Length of every document under the normalisers."""
    return _t(spark, d, "documents").filter("text is not null").select("doc_id", F.length(tx.alnum_lower(F.col("text"))).alias("alnum"), F.length(tx.drop_punctuation(F.col("text"))).alias("unpunctuated"))


@query
def placeholder_names(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "records").groupBy(tx.is_placeholder(F.col("respondent")).alias("placeholder")).agg(F.count("*").alias("n"))


@query
def text_windows(spark: SparkSession, d: str) -> DataFrame:
    w = segmenting.windows(_t(spark, d, "documents"), ["doc_id"])
    return w.select("doc_id", "chunk", "char_start", "char_end", F.length("overlap_text").alias("shared"))


@query
def speaker_turns(spark: SparkSession, d: str) -> DataFrame:
    return segmenting.speakers(segmenting.turns(_t(spark, d, "documents"), ["doc_id"]), ["doc_id"])


@query
def suggested_interviewers(spark: SparkSession, d: str) -> DataFrame:
    return segmenting.suggest_interviewers(speaker_turns(spark, d), ["doc_id"])


@query
def hearing_answers(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").filter("lower(trim(source)) = 'hearing'")
    return hearing.question_answers(hearing.turns(docs)).select("doc_id", "position", "speaker", F.length("question").alias("question_chars"), F.length("answer").alias("answer_chars"))


@query
def discover_terms(spark: SparkSession, d: str) -> DataFrame:
    t = lexicon.discover_terms_en(_t(spark, d, "documents").filter("lang = 'en'"), top=None)
    return t.select("term", "freq", F.round("cohesion", 6).alias("cohesion"), F.round("score", 6).alias("score"))


@query
def discover_terms_cjk(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.discover_terms_cjk(_t(spark, d, "documents").filter("lang = 'zh'"), top=None)


@query
def log_odds(spark: SparkSession, d: str) -> DataFrame:
    t = lexicon.code_tokens(_t(spark, d, "documents").filter("lang = 'en'").withColumn("source", F.regexp_replace(F.lower("source"), "-", "_")), "source", "text")
    return lexicon.log_odds(t, top=None).select("code", "term", F.round("z", 6).alias("z"), F.round("log_odds", 6).alias("log_odds"), "count_in", "count_out")


def _small_lexicons(rows: list) -> dict[str, lexicon.DictionaryCoder]:
    """A coder per framework: the small lexicon of ``FRAMEWORK``; of the others their labels, at the first pole where they have polarity."""
    out = {}
    for i in sorted({r.framework_id for r in rows}):
        fw = Framework.from_rows(rows, i)
        first = fw.polarities[0] if fw.polarities else ""
        labels = tuple(dict.fromkeys((m.id, first, t) for m in fw.dimensions for _, x in m.labels if x for t in (x, x.lower())))
        out[i] = _small_lexicon(fw) if i == FRAMEWORK else lexicon.DictionaryCoder(lexicon.Lexicon(terms=labels, negators=("not ", "never "), reported=("said", "told")), fw)
    return out


def _small_lexicon(fw: Framework) -> lexicon.DictionaryCoder:
    lex = lexicon.Lexicon(
        terms=(("responsiveness", "P", "changed course"), ("responsiveness", "N", "never replied"), ("engagement", "P", "kept asking"), ("engagement", "N", "Nobody asked"), ("reflexivity", "P", "I think"), ("anticipation", "N", "no plan"), ("anticipation", "P", "planned")),
        patterns=(("p1", "engagement", "N", r"without telling anyone"),), negators=("not ", "never "), intensifiers=("very ", "really "), pivots=("but ", "even though"), reported=("said", "told"))
    return lexicon.DictionaryCoder(lex, fw)


@query
def dictionary_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of every unit by its framework's lexicon."""
    u = _t(spark, d, "units").select("framework_id", "unit_id", "text")
    return lexicon.dictionary_codes(u, _small_lexicons(framework_rows(_t(spark, d, "frameworks")))).select("framework_id", "unit_id", F.array_join("dictionary_codes", "/").alias("codes"))


@query
def compare_coders(spark: SparkSession, d: str) -> DataFrame:
    rows = framework_rows(_t(spark, d, "frameworks"))
    u = _t(spark, d, "units").select("framework_id", "unit_id", "text", F.col("ai_codes").alias("codes"))
    coded = lexicon.dictionary_codes(u, _small_lexicons(rows))
    return lexicon.compare_coders(coded, longtable.codes_of(rows, F.col("framework_id")), keys=["framework_id"])


@query
def audit_llm(spark: SparkSession, d: str) -> DataFrame:
    u = _t(spark, d, "units").select("framework_id", "unit_id", "text", sorted_set(F.col("ai_codes")).alias("codes"))
    return lexicon.audit_llm(u, _small_lexicons(framework_rows(_t(spark, d, "frameworks"))))


# --- open coding ------------------------------------------------------------------------------------


def _open(spark: SparkSession, d: str) -> DataFrame:
    return longtable.first_rows(_t(spark, d, "open_records"))


@query
def codebook_stats(spark: SparkSession, d: str) -> DataFrame:
    return openbook.codebook_stats(_t(spark, d, "codebooks"))


@query
def concentration(spark: SparkSession, d: str) -> DataFrame:
    return openbook.concentration(_t(spark, d, "codebooks")).select("codebook_id", r9("top2"), r9("singleton_share"))


@query
def saturation(spark: SparkSession, d: str) -> DataFrame:
    """Running number of new codes per codebook over windows in order of saving."""
    s = _open(spark, d).select("record_id", "saved_at", F.col("_meta.codebook_id").alias("codebook_id"), F.explode("_meta.codes_per_chunk").alias("c")).filter("codebook_id is not null and c is not null")
    steps = s.select("codebook_id", "saved_at", "record_id", "c.chunk", F.coalesce("c.reused", F.lit(0)).alias("reused"), F.coalesce("c.created", F.lit(0)).alias("created"))
    return review.saturation(steps, ["saved_at", "record_id", "chunk"], ["codebook_id"]).select("codebook_id", "record_id", "chunk", "n", "created", "cumulative")


@query
def absorbed_codes(spark: SparkSession, d: str) -> DataFrame:
    return openbook.absorb(openbook.open_code_rows(_open(spark, d)))


@query
def prompt_codes(spark: SparkSession, d: str) -> DataFrame:
    return openbook.prompt_codes(absorbed_codes(spark, d))


@query
def frequent_codes(spark: SparkSession, d: str) -> DataFrame:
    return openbook.drop_rare(absorbed_codes(spark, d)).select("codebook_id", "code_id", "label", "count")


@query
def codebook_framework(spark: SparkSession, d: str) -> DataFrame:
    return openbook.to_framework(absorbed_codes(spark, d))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "codebooks").select("codebook_id", F.explode("codes.label").alias("label")).filter("label is not null")


@query
def dice_pairs(spark: SparkSession, d: str) -> DataFrame:
    return openbook.dice_pairs(_labels(spark, d), ["codebook_id"]).select("codebook_id", "label_a", "label_b", r9("dice"))


@query
def dice_parts(spark: SparkSession, d: str) -> DataFrame:
    """Similar part types, over all of them."""
    return openbook.dice_pairs(_t(spark, d, "part").select("p_type").distinct(), [], "p_type").select("label_a", "label_b", r9("dice"))


@query
def accepted_merges(spark: SparkSession, d: str) -> DataFrame:
    codes = _t(spark, d, "codebooks").select("codebook_id", F.explode("codes").alias("c")).select("codebook_id", "c.label", F.coalesce("c.count", F.lit(0)).alias("count"))
    return openbook.accept_all(codes, openbook.dice_pairs(_labels(spark, d), ["codebook_id"]))


@query
def merged_codebook(spark: SparkSession, d: str) -> DataFrame:
    codes = _t(spark, d, "codebooks").select("codebook_id", F.explode("codes").alias("c")).select("codebook_id", "c.label", F.coalesce("c.count", F.lit(0)).alias("count"))
    return openbook.merge_codes(codes, accepted_merges(spark, d))


@query
def code_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Average-linkage clusters of every codebook's labels by bigram distance; pairs without a common bigram are at distance 1."""
    codes = _t(spark, d, "codebooks").select("codebook_id", F.explode("codes").alias("c")).select("codebook_id", F.col("c.label").alias("code"), F.coalesce("c.count", F.lit(0)).alias("weight")).filter("code is not null")
    dist = openbook.dice_pairs(codes.select("codebook_id", F.col("code").alias("label")), ["codebook_id"], least=1e-9).select("codebook_id", F.col("label_a").alias("code_a"), F.col("label_b").alias("code_b"), (1 - F.col("dice")).alias("distance"))
    return themes.cluster_codes(codes, dist, "codebook_id")


# --- themes over the star schema: item = order, theme = return flag ---------------------------------


def _themes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = _t(spark, d, "orders").select(F.col("o_orderkey").alias("global_id"), F.col("o_custkey").alias("respondent"), F.col("o_orderpriority").alias("quote"), F.array("o_orderstatus").alias("existing_codes"))
    members = _t(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_returnflag").alias("theme_id"), F.col("l_orderkey").alias("global_id"))
    return members, items


@query
def theme_table(spark: SparkSession, d: str) -> DataFrame:
    return themes.theme_table(*_themes(spark, d))


@query
def theme_cases(spark: SparkSession, d: str) -> DataFrame:
    return themes.theme_case_matrix(*_themes(spark, d))


@query
def theme_support(spark: SparkSession, d: str) -> DataFrame:
    m, i = _themes(spark, d)
    return themes.support(themes.theme_case_matrix(m, i), i).select("theme_id", "respondents", r9("support_rate"))


@query
def theme_codes(spark: SparkSession, d: str) -> DataFrame:
    return themes.theme_by_code(*_themes(spark, d))


@query
def unassigned_items(spark: SparkSession, d: str) -> DataFrame:
    return themes.unassigned(*_themes(spark, d)).select("global_id", "respondent")


@query
def first_order_items(spark: SparkSession, d: str) -> DataFrame:
    return themes.first_order_items(_long(spark, d))


# --- corpora ---------------------------------------------------------------------------------------


@query
def coded_records(spark: SparkSession, d: str) -> DataFrame:
    """Segments per session, coder and respondent, built from the model's codes of every unit."""
    u = _t(spark, d, "units")
    r = corpus.records_from_codings(u.select("session_id", F.lit("model").alias("coder"), "unit_id", F.col("ai_codes").alias("codes")), u)
    return r.select("session_id", "respondent", F.size("segments").alias("segments"))


@query
def methods_facts(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return corpus.methods_facts(r, review.history_rows(r))


@query
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Lexicon terms (clean code labels) and discovered terms."""
    terms = _labels(spark, d).select(F.lower("label").alias("term"))
    return lexicon.vocabulary(terms, lexicon.discover_terms_en(_t(spark, d, "documents").filter("lang = 'en'"), top=None))


@query
def segmented_words(spark: SparkSession, d: str) -> DataFrame:
    """Word counts of Chinese documents, dimension labels kept whole."""
    s = lexicon.Segmenter([r.label_zh for r in framework_rows(_t(spark, d, "frameworks"))])
    docs = _t(spark, d, "documents").filter("lang = 'zh' and text is not null").select("text")
    return lexicon.segment(docs, s).select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query
def dimension_labels(spark: SparkSession, d: str) -> DataFrame:
    """Chinese label of every dimension, else the English one."""
    f = _t(spark, d, "frameworks")
    pair = lambda lang: F.struct(F.lit(lang).alias("lang"), F.col(f"label_{lang}").alias("label"))
    key = F.concat_ws(".", "framework_id", "dimension").alias("key")
    labels = f.select(key, F.explode(F.array(pair("en"), pair("zh"))).alias("l")).select("key", "l.*")
    return corpus.label_lookup(f.select(key), labels, "zh")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in _Q}
