"""The same queries as DuckDB SQL over the same tables."""

from __future__ import annotations

_STAR = """WITH long AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS respondent, l_orderkey AS segment, l_returnflag AS dimension, l_linestatus AS polarity,
 l_returnflag || '-' || l_linestatus AS code, c_mktsegment AS institution_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

_STANDS_IN = """(respondent IS NULL OR trim(lower(trim(respondent)), '「」"''') IN ('', 'unknown', 'unspecified', 'unnamed', 'none', 'n/a', 'na', 'null', 'respondent', 'the respondent', 'interviewee', 'the interviewee', 'speaker', 'the speaker', 'participant', 'the participant', '未指定', '不明', '未知', '受訪者', '受訪人', '無')
 OR contains(lower(respondent), 'as named in') OR regexp_matches(trim(lower(trim(respondent)), '「」"'''), '^(the respondent|the person speaking)'))"""

_KEY = "trim(regexp_replace(lower({}), '[\\s_]+', ' ', 'g'))"
#: Latest row per record, and spellings mapped to dimensions.
RECORDS = "rec AS (SELECT * FROM records QUALIFY record_id IS NULL OR row_number() OVER (PARTITION BY record_id ORDER BY saved_at DESC NULLS LAST, received_at DESC NULLS LAST) = 1)"
OPEN = "orec AS (SELECT * FROM open_records QUALIFY record_id IS NULL OR row_number() OVER (PARTITION BY record_id ORDER BY saved_at DESC NULLS LAST, received_at DESC NULLS LAST) = 1)"
SEGMENTS = """seg AS (SELECT record_id, respondent, _meta.framework_id AS framework_id, coalesce(_meta.endpoint.endpoint, _meta.source, '') AS endpoint, i - 1 AS seg_pos, segments[i] AS s
 FROM rec, unnest(range(1, coalesce(len(segments), 0) + 1)) t(i) WHERE segments[i] IS NOT NULL)"""


def spelling(source: str) -> str:
    """CTEs alias and spell(framework_id, raw, dimension) for the spellings in ``source`` (framework_id, raw)."""
    return f"""alias AS (SELECT framework_id, {_KEY.format("x")} AS k, min(dimension) AS dimension FROM frameworks, unnest([dimension, short_code, label_en, label_zh]) t(x) GROUP BY 1, 2),
 raws AS (SELECT DISTINCT framework_id, raw FROM {source} WHERE raw IS NOT NULL AND framework_id IS NOT NULL),
 exact AS (SELECT r.framework_id, r.raw, a.dimension FROM raws r JOIN alias a ON a.framework_id = r.framework_id AND a.k = {_KEY.format("r.raw")}),
 pieces AS (SELECT framework_id, raw, unnest(regexp_split_to_array(raw, '[(（)）\\-—/|:：,，、]')) AS p FROM raws),
 parts AS (SELECT q.framework_id, q.raw, min(a.dimension) AS dimension FROM pieces q JOIN alias a ON a.framework_id = q.framework_id AND a.k = {_KEY.format("q.p")} GROUP BY 1, 2 HAVING count(DISTINCT a.dimension) = 1),
 spell AS (SELECT * FROM exact UNION ALL SELECT * FROM parts p WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.framework_id = p.framework_id AND e.raw = p.raw)),
 poles AS (SELECT framework_id, any_value(polarity_values) AS pv FROM frameworks GROUP BY 1),
 shorts AS (SELECT framework_id, dimension, short_code FROM frameworks)"""


_POLARITY = "CASE WHEN len(pv) = 0 THEN '' WHEN list_contains(pv, upper(trim(rawp))) THEN upper(trim(rawp)) END"

CODES = f"""{RECORDS}, {SEGMENTS},
 entry AS (SELECT seg.* EXCLUDE (s), s, j - 1 AS code_pos, s.codes[j].dimension AS raw, s.codes[j].polarity AS rawp, s.codes[j] AS c FROM seg, unnest(range(1, coalesce(len(s.codes), 0) + 1)) t(j)),
 {spelling("entry")},
 clean AS (SELECT e.*, sp.dimension, {_POLARITY} AS polarity FROM entry e LEFT JOIN spell sp ON sp.framework_id = e.framework_id AND sp.raw = e.raw LEFT JOIN poles po ON po.framework_id = e.framework_id)"""

LONG = f"""WITH {CODES},
 valid AS (SELECT record_id, seg_pos, respondent, framework_id, dimension, polarity, any_value(s) AS s, any_value(endpoint) AS endpoint FROM clean WHERE dimension IS NOT NULL AND polarity IS NOT NULL GROUP BY ALL),
 long AS (SELECT v.record_id, v.seg_pos, v.s.segment_id AS segment_id, v.framework_id, v.dimension, v.polarity, CASE WHEN v.polarity = '' THEN h.short_code ELSE h.short_code || '-' || v.polarity END AS code,
  count(*) OVER (PARTITION BY v.record_id, v.seg_pos) AS codes_in_segment, coalesce(v.s.review.status, 'pending') AS status, coalesce(v.s.review.source, 'ai') AS source, v.endpoint
  FROM valid v JOIN shorts h ON h.framework_id = v.framework_id AND h.dimension = v.dimension)"""

_CLEAN = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[\\s\\x{{3000}}\\x{{a0}}]+', ' ', 'g'), "
    "'(?i)^(\\s*(\\[\\s*\\d+\\s*[x×]\\s*\\]|\\[\\s*new( code)?\\s*\\]|【[^】]*】|new( code)?\\s*[:：]|[-*•#>]+ ))+', ''), '\\s[—–-]+\\s.*$', ''), '——.*$', ''), "
    "'^[\\s\"''“”‘’«»「『*_`]+|[\\s\"''“”‘’«»」』*_`.。．!！?？;；:：,，、…]+$', '', 'g')"
)
#: Codebooks replayed from the labels of the records: book(codebook_id, code_no, code_id, label, count, first_record).
_BOOK = f"""WITH {OPEN}, s AS (SELECT record_id, _meta.codebook_id AS codebook_id, saved_at, i - 1 AS seg_pos, open_segments[i] AS s FROM orec, unnest(range(1, coalesce(len(open_segments), 0) + 1)) t(i) WHERE open_segments[i] IS NOT NULL),
 c AS (SELECT record_id, codebook_id, saved_at, seg_pos, j - 1 AS code_pos, s.open_codes[j] AS c FROM s, unnest(range(1, coalesce(len(s.open_codes), 0) + 1)) t(j) WHERE s.open_codes[j] IS NOT NULL),
 k AS (SELECT record_id, codebook_id, saved_at, seg_pos, code_pos, {_CLEAN.format("c.label")} AS clean FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY codebook_id, lower(clean) ORDER BY saved_at NULLS FIRST, record_id NULLS FIRST, seg_pos, code_pos) AS rn, count(*) OVER (PARTITION BY codebook_id, lower(clean)) AS n FROM k WHERE clean <> ''),
 o AS (SELECT codebook_id, clean AS label, n AS "count", record_id AS first_record, CAST(row_number() OVER (PARTITION BY codebook_id ORDER BY saved_at NULLS FIRST, record_id NULLS FIRST, seg_pos, code_pos) AS INTEGER) AS code_no FROM r WHERE rn = 1),
 book AS (SELECT codebook_id, code_no, printf('c%03d', code_no) AS code_id, label, "count", first_record FROM o)"""

#: Written out apart from functions/text.py, for comparison.
_ABSENT = (
    "(?i)\\b(does|did|do)\\s*n[o'']t\\s+(show|demonstrate|exhibit|display|reflect|indicate|reveal|evidence|mention|articulate)\\b|"
    "\\bfail(s|ed|ing)?\\s+to\\s+(show|demonstrate|exhibit|display|reflect|indicate|reveal|evidence|mention|acknowledge|articulate)\\b|"
    "\\bno\\s+(evidence|indication|sign|mention|trace)\\s+of\\b|\\bnot\\s+(shown|demonstrated|evidenced|evident|articulated)\\b|"
    "\\bnothing\\s+(here|in\\s+this\\s+(passage|excerpt|segment|quote))\\b|\\bthe\\s+(passage|excerpt|segment|quote|speaker)\\s+never\\s+(show|demonstrate|exhibit|reflect|indicate)\\b|"
    "未(表現出|表现出|展現|展现|顯示|显示|呈現|呈现|體現|体现)|沒有(表現|展現|顯示|呈現|體現)|没有(表现|展现|显示|呈现|体现)|看不出|無法看出|无法看出|不足以顯示|不足以显示|未見(任何)?(證據|跡象)|"
    "(本段|這段|该段|此段)[^，。；]{0,12}(沒有|没有|未)"
)

_HUB = f"""WITH u AS (SELECT unit_id, framework_id, ai_codes FROM units WHERE framework_id = 'ri_core'),
 j AS (SELECT c.*, u.framework_id FROM codings c JOIN u USING (unit_id) WHERE lower(trim(coder)) = 'coder_hub'),
 entry AS (SELECT unit_id, coder, coded_at, received_at, framework_id, x.dimension AS raw, x.polarity AS rawp FROM (SELECT unit_id, coder, coded_at, received_at, framework_id, unnest(codes) AS x FROM j)),
 {spelling("entry")},
 clean AS (SELECT e.unit_id, e.coder, e.coded_at, e.received_at, h.short_code || '-' || ({_POLARITY}) AS code FROM entry e JOIN spell sp ON sp.framework_id = e.framework_id AND sp.raw = e.raw JOIN poles po ON po.framework_id = e.framework_id JOIN shorts h ON h.framework_id = e.framework_id AND h.dimension = sp.dimension),
 sets AS (SELECT unit_id, coder, coded_at, received_at, list_sort(list_distinct(list(code) FILTER (code IS NOT NULL))) AS codes FROM clean GROUP BY ALL),
 rows AS (SELECT j.unit_id, j.coded_at, j.received_at, coalesce(s.codes, []) AS codes FROM j LEFT JOIN sets s ON s.unit_id = j.unit_id AND s.coder = j.coder AND s.coded_at = j.coded_at AND s.received_at = j.received_at),
 latest AS (SELECT DISTINCT unit_id, codes FROM rows QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY coded_at DESC, received_at DESC, codes DESC) = 1),
 hub AS (SELECT l.unit_id, coalesce(l.codes, []) AS codes_a, coalesce(list_sort(list_distinct(u.ai_codes)), []) AS codes_b FROM latest l JOIN u USING (unit_id)),
 codelist AS (SELECT unnest(['ANT-P','ANT-N','ENG-P','ENG-N','REF-P','REF-N','RES-P','RES-N']) AS code),
 cells AS (SELECT unit_id, code, list_contains(codes_a, code) AS a, list_contains(codes_b, code) AS b FROM hub CROSS JOIN codelist)"""

_ALL = f"""WITH u AS (SELECT unit_id, framework_id, ai_codes FROM units),
 j AS MATERIALIZED (SELECT row_number() OVER () AS rid, c.unit_id, lower(trim(c.coder)) AS coder, c.codes, c.coded_at, c.received_at, u.framework_id FROM codings c JOIN u USING (unit_id)),
 entry AS (SELECT rid, framework_id, x.dimension AS raw, x.polarity AS rawp FROM (SELECT rid, framework_id, unnest(codes) AS x FROM j)),
 {spelling("entry")},
 clean AS (SELECT e.rid, h.short_code, ({_POLARITY}) AS p FROM entry e JOIN spell sp ON sp.framework_id = e.framework_id AND sp.raw = e.raw JOIN poles po ON po.framework_id = e.framework_id JOIN shorts h ON h.framework_id = e.framework_id AND h.dimension = sp.dimension),
 sets AS (SELECT rid, list_sort(list_distinct(list(CASE WHEN p = '' THEN short_code ELSE short_code || '-' || p END) FILTER (p IS NOT NULL))) AS codes FROM clean GROUP BY 1),
 judged AS (SELECT j.unit_id, j.coder, j.framework_id, coalesce(s.codes, []) AS codes FROM j LEFT JOIN sets s USING (rid) QUALIFY row_number() OVER (PARTITION BY j.unit_id, j.coder ORDER BY coded_at DESC, received_at DESC, coalesce(s.codes, []) DESC) = 1),
 hub AS (SELECT l.framework_id, l.coder, l.unit_id, l.codes AS codes_a, coalesce(list_sort(list_distinct(u.ai_codes)), []) AS codes_b FROM judged l JOIN u USING (unit_id)),
 codelist AS (SELECT framework_id, short_code AS code FROM frameworks WHERE len(polarity_values) = 0 UNION ALL SELECT framework_id, short_code || '-' || unnest(polarity_values) FROM frameworks),
 cells AS (SELECT framework_id, coder, unit_id, code, list_contains(codes_a, code) AS a, list_contains(codes_b, code) AS b FROM hub JOIN codelist USING (framework_id))"""

_COUNTS = "count(*) AS n, count(*) FILTER (a AND b) AS both_yes, count(*) FILTER (NOT a AND NOT b) AS neither, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b"


def _kappa(source: str, key: str = "") -> str:
    k = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f""", t AS (SELECT {k}{_COUNTS} FROM {source} {group}),
 p AS (SELECT *, (both_yes + neither) / n::DOUBLE AS po, (both_yes + only_a) / n::DOUBLE AS pa, (both_yes + only_b) / n::DOUBLE AS pb FROM t),
 q AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe, 2 * ((pa + pb) / 2) * (1 - (pa + pb) / 2) AS pg FROM p),
 r AS (SELECT *, CASE WHEN abs(1 - pe) > 1e-12 THEN (po - pe) / (1 - pe) END AS kappa, 2 * po - 1 AS pabak, CASE WHEN abs(1 - pg) > 1e-12 THEN (po - pg) / (1 - pg) END AS ac1, abs(both_yes - neither) / n::DOUBLE AS prevalence, abs(only_a - only_b) / n::DOUBLE AS bias FROM q)"""


_K6 = "round(po, 9) AS po, round(kappa, 9) AS kappa, round(pabak, 9) AS pabak, round(ac1, 9) AS ac1, round(prevalence, 9) AS prevalence, round(bias, 9) AS bias"
_BAND = "CASE WHEN kappa IS NULL THEN NULL WHEN kappa < 0 THEN 'poor' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' ELSE 'almost_perfect' END AS band, coalesce(prevalence > 0.6 AND pabak - kappa > 0.2, false) AS paradox"


def _pairs(unit: str) -> str:
    return f"""{_STAR}, s AS (SELECT DISTINCT {unit} AS u, code FROM long), t AS (SELECT code, count(*) AS k FROM s GROUP BY 1),
 p AS (SELECT a.code AS code_a, b.code AS code_b, count(*) AS n FROM s a JOIN s b ON a.u = b.u AND a.code < b.code GROUP BY 1, 2)"""


_PAIR_OUT = "SELECT code_a, code_b, n, round(n / (ta.k + tb.k - n)::DOUBLE, 9) AS jaccard FROM p JOIN t ta ON ta.code = code_a JOIN t tb ON tb.code = code_b"
_EVENTS = f"""WITH {RECORDS}, seg AS (
 SELECT record_id, 'segments' AS list_name, i - 1 AS seg_pos, segments[i] AS s FROM rec, unnest(range(1, coalesce(len(segments), 0) + 1)) t(i) WHERE segments[i] IS NOT NULL
 UNION ALL SELECT record_id, 'deleted_segments', i - 1, deleted_segments[i] FROM rec, unnest(range(1, coalesce(len(deleted_segments), 0) + 1)) t(i) WHERE deleted_segments[i] IS NOT NULL)"""
_CHANGES = _EVENTS + """, c AS (SELECT record_id, list_name, seg_pos, s.review.original_codes AS oc, list_sort(list_distinct(list_filter(list_transform(coalesce(s.codes, []), lambda x: trim(x.dimension)), lambda y: y IS NOT NULL))) AS cur FROM seg),
 o AS (SELECT record_id, seg_pos, list_sort(list_distinct(list_filter(oc, lambda y: y IS NOT NULL))) AS old, cur FROM c WHERE list_name = 'segments' AND oc IS NOT NULL)"""


def _stops() -> str:
    from codeloom.operators.lexicon import STOP_EN

    return "[" + ", ".join(f"'{w}'" for w in STOP_EN) + "]"


def _inside() -> str:
    from codeloom.operators.lexicon import INSIDE_EN

    return "[" + ", ".join(f"'{w}'" for w in INSIDE_EN) + "]"


_WORDS = r"""sents AS (SELECT {extra} unnest(regexp_split_to_array(lower(text), '[.!?;:\n]+')) AS s FROM documents WHERE lang = 'en' AND text IS NOT NULL),
 toks AS (SELECT {keys} regexp_extract_all(s, '[a-z][a-z''-]*') AS w FROM sents)"""


def _dice(labels: str, key: str) -> str:
    k = f"{key}, " if key else ""
    on = f"a.{key} = b.{key} AND " if key else ""
    return f"""WITH l AS ({labels}), n AS (SELECT {k}label, regexp_replace(lower(label), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS c FROM l),
 g AS (SELECT {k}label, CASE WHEN length(c) = 1 THEN [c] ELSE list_distinct(list_transform(range(1, length(c)), lambda i: substr(c, i, 2))) END AS grams FROM n WHERE length(c) > 0),
 x AS (SELECT a.label AS label_a, b.label AS label_b, {f"a.{key}," if key else ""} 2.0 * len(list_intersect(a.grams, b.grams)) / (len(a.grams) + len(b.grams))::DOUBLE AS dice FROM g a JOIN g b ON {on}a.label < b.label)
 SELECT {k}label_a, label_b, round(dice, 9) AS dice FROM x WHERE dice >= 0.5"""


SQL: dict[str, str] = {
    "long_star": f"{_STAR} SELECT respondent, segment, dimension, polarity, code, institution_type FROM long",
    "crosstab_code": f'{_STAR} SELECT institution_type AS "by", code AS unit, count(*) AS n FROM long GROUP BY 1, 2',
    "crosstab_dimension": f'{_STAR} SELECT institution_type AS "by", dimension AS unit, count(*) AS n FROM long GROUP BY 1, 2',
    "crosstab_polarity": f'{_STAR} SELECT institution_type AS "by", polarity AS unit, count(*) AS n FROM long GROUP BY 1, 2',
    "crosstab_pct": f'{_STAR} SELECT institution_type AS "by", code AS unit, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY institution_type), 9) AS pct FROM long GROUP BY 1, 2',
    "crosstab_wide": f"""{_STAR} SELECT institution_type AS "by", count(*) FILTER (dimension = 'A') AS "A", count(*) FILTER (dimension = 'N') AS "N", count(*) FILTER (dimension = 'R') AS "R" FROM long GROUP BY 1""",
    "crosstab_case_level": f"""{_STAR}, c AS (SELECT respondent, code, count(*) AS k, min(institution_type) AS b FROM long GROUP BY 1, 2), t AS (SELECT *, min(b) OVER (PARTITION BY respondent) AS d FROM c QUALIFY k = max(k) OVER (PARTITION BY respondent)),
 m AS (SELECT respondent, CASE WHEN count(*) = 1 THEN min(code) ELSE 'mixed' END AS unit, min(d) AS "by" FROM t GROUP BY 1) SELECT "by", unit, count(*) AS n FROM m GROUP BY 1, 2""",
    "chi2_components": f"""{_STAR}, c AS (SELECT institution_type AS b, dimension AS u, count(*) AS n FROM long GROUP BY 1, 2), r AS (SELECT b, sum(n)::DOUBLE AS r FROM c GROUP BY 1), k AS (SELECT u, sum(n)::DOUBLE AS k FROM c GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS t FROM c),
 g AS (SELECT coalesce(c.n, 0) AS n, r.r * k.k / t.t AS e FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.b = r.b AND c.u = k.u),
 s AS (SELECT sum((n - e) * (n - e) / e) AS chi2, min(e) AS min_expected, count(*) FILTER (e < 5) AS small_cells, count(*) AS cells, sum(n) AS n FROM g), d AS (SELECT count(*) AS rr FROM r), f AS (SELECT count(*) AS kk FROM k)
 SELECT round(chi2, 6) AS chi2, round(min_expected, 6) AS min_expected, round(sqrt(chi2 / (n * (least(rr, kk) - 1))), 6) AS cramers_v, CAST((rr - 1) * (kk - 1) AS INTEGER) AS dof, CAST(n AS BIGINT) AS n, small_cells,
 CASE WHEN small_cells / cells::DOUBLE <= 0.2 AND min_expected >= 1 THEN 'ok' ELSE 'sparse' END AS verdict FROM s, d, f""",
    "cooccurrence_segment": f"{_pairs('segment')} {_PAIR_OUT}",
    "cooccurrence_case": f"{_pairs('respondent')} {_PAIR_OUT}",
    "cooccurrence_totals": f"{_pairs('segment')} SELECT code, k AS n FROM t",
    "cooccurrence_dense": f"{_pairs('segment')}, f AS (SELECT code_a, code_b, n FROM p UNION ALL SELECT code_b, code_a, n FROM p UNION ALL SELECT code, code, k FROM t) SELECT a.code AS code_a, b.code AS code_b, coalesce(f.n, 0) AS n FROM t a CROSS JOIN t b LEFT JOIN f ON f.code_a = a.code AND f.code_b = b.code",
    "top_pairs": f"{_pairs('segment')}, o AS ({_PAIR_OUT}) SELECT *, split_part(code_a, '-', 1) <> split_part(code_b, '-', 1) AS cross_dimension FROM o ORDER BY n DESC, jaccard DESC, code_a, code_b LIMIT 5",
    "case_matrix": f"{_STAR}, r AS (SELECT DISTINCT respondent FROM long), c AS (SELECT DISTINCT code FROM long), n AS (SELECT respondent, code, count(*) AS n FROM long GROUP BY 1, 2) SELECT respondent, code, coalesce(n, 0) AS n FROM r CROSS JOIN c LEFT JOIN n USING (respondent, code)",
    "case_matrix_pct": f"{_STAR}, r AS (SELECT DISTINCT respondent FROM long), c AS (SELECT DISTINCT code FROM long), n AS (SELECT respondent, code, count(*) AS n FROM long GROUP BY 1, 2), m AS (SELECT respondent, code, coalesce(n, 0) AS n FROM r CROSS JOIN c LEFT JOIN n USING (respondent, code)) SELECT respondent, code, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY respondent), 9) AS pct FROM m",
    "polarity_balance": f"""{_STAR}, b AS (SELECT respondent, dimension, count(*) FILTER (polarity = 'O') AS high, count(*) FILTER (polarity = 'F') AS low FROM long GROUP BY GROUPING SETS ((respondent, dimension), (respondent)))
 SELECT respondent, dimension, high, low, high + low AS total, round(CASE WHEN low > 0 THEN high / low::DOUBLE END, 9) AS ratio, round((high - low) / (high + low)::DOUBLE, 9) AS "index" FROM b""",
    "long_records": f"{LONG} SELECT record_id, CAST(seg_pos AS INTEGER) AS seg_pos, segment_id, framework_id, dimension, polarity, code, codes_in_segment > 1 AS multi_coded, codes_in_segment, status, source, endpoint FROM long",
    "crosstab_records": f"""{LONG}, d AS (SELECT record_id, CASE WHEN len(map_extract(descriptors, 'institution_type')) > 0 THEN map_extract(descriptors, 'institution_type')[1] END AS v FROM rec) SELECT d.v AS "by", l.dimension AS unit, count(*) AS n FROM long l JOIN d USING (record_id) WHERE d.v <> 'unspecified' GROUP BY 1, 2""",
    "coverage": f"""{LONG}, c AS (SELECT record_id, count(*) AS codes, count(DISTINCT seg_pos) AS coded, count(DISTINCT dimension) AS dimensions, count(DISTINCT CASE WHEN codes_in_segment > 1 THEN seg_pos END) AS multi FROM long GROUP BY 1)
 SELECT r.record_id, CAST(len(list_filter(coalesce(r.segments, []), lambda x: x IS NOT NULL)) AS INTEGER) AS segments, coalesce(codes, 0) AS codes, coalesce(coded, 0) AS coded, coalesce(dimensions, 0) AS dimensions, coalesce(multi, 0) AS multi, round(CASE WHEN coded > 0 THEN multi / coded::DOUBLE END, 9) AS multi_rate FROM rec r LEFT JOIN c USING (record_id)""",
    "framework_mismatch": f"WITH {RECORDS} SELECT record_id, _meta.framework_id AS framework_id FROM rec WHERE _meta.framework_id <> 'ri_core'",
    "descriptor_values": f"""WITH {RECORDS}, v AS (SELECT lower(trim(map_extract(descriptors, 'sector')[1])) AS v FROM rec WHERE descriptors IS NOT NULL AND list_contains(map_keys(descriptors), 'sector'))
 SELECT CASE WHEN v IS NULL OR v = '' THEN 'unspecified' WHEN v IN ('finance', 'agritech', 'biomedical', 'ict_ai', 'manufacturing', 'energy_sustainability', 'unspecified') THEN v ELSE 'other' END AS value, count(*) AS n FROM v GROUP BY 1""",
    "saved_index": f"WITH {RECORDS} SELECT record_id, respondent, _meta.framework_id AS framework_id, _meta.coded_at AS coded_at, CAST(coalesce(len(segments), 0) AS INTEGER) AS segments, CAST(coalesce(len(deleted_segments), 0) AS INTEGER) AS deleted FROM rec",
    "provenance": f"""WITH {RECORDS}, k AS (SELECT record_id, unnest([{{'key': 'framework', 'value': _meta.framework_id}}, {{'key': 'source', 'value': _meta.source}}, {{'key': 'coded_at', 'value': _meta.coded_at}}, {{'key': 'endpoint', 'value': _meta.endpoint.endpoint}}, {{'key': 'model', 'value': _meta.endpoint.model}}, {{'key': 'locality', 'value': _meta.endpoint.data_locality}}, {{'key': 'windows', 'value': CAST(_meta.chunking.n_chunks AS VARCHAR)}}]) AS p FROM rec)
 SELECT record_id, p.key AS key, coalesce(p.value, 'not recorded') AS value FROM k""",
    "endpoints": f"WITH {RECORDS} SELECT coalesce(_meta.endpoint.endpoint, 'not recorded') AS endpoint, coalesce(_meta.endpoint.provider, 'not recorded') AS provider, coalesce(_meta.endpoint.model, 'not recorded') AS model, coalesce(_meta.endpoint.data_locality, 'not recorded') AS data_locality, count(*) AS records FROM rec GROUP BY 1, 2, 3, 4",
    "quote_verify": f"""WITH {RECORDS}, {SEGMENTS}, n AS (SELECT seg.record_id, seg.record_id || '#' || seg.seg_pos AS quote_id, regexp_replace(lower(s.quote), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS q, regexp_replace(lower(rec.transcript), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS t FROM seg JOIN rec USING (record_id))
 SELECT record_id, quote_id, CASE WHEN q <> '' THEN contains(t, q) END AS verbatim FROM n""",
    "quote_units": rf"""WITH {RECORDS}, {SEGMENTS}, n AS (SELECT record_id, record_id || '#' || seg_pos AS id, regexp_replace(s.quote, '[\s\x{{3000}}，。！？；：、,.!?;:「」『』（）()〈〉《》【】\-—…·"'']+', '', 'g') AS q, regexp_replace(s.full_text, '[\s\x{{3000}}，。！？；：、,.!?;:「」『』（）()〈〉《》【】\-—…·"'']+', '', 'g') AS u FROM seg)
 SELECT a.id AS unit_id, b.id AS quote_id FROM n a JOIN n b ON a.record_id = b.record_id WHERE (length(b.q) >= 10 AND contains(a.u, b.q)) OR (length(a.u) >= 10 AND contains(b.q, a.u))""",
    "review_stats": _EVENTS + """, x AS (SELECT list_name = 'deleted_segments' AS del, CASE WHEN list_name = 'deleted_segments' THEN 'deleted' ELSE coalesce(s.review.status, 'pending') END AS st, coalesce(s.review.source, 'ai') = 'ai' AS ai FROM seg)
 SELECT count(*) FILTER (ai) AS ai, count(*) FILTER (ai AND st IN ('confirmed', 'modified', 'deleted')) AS reviewed, count(*) FILTER (ai AND st = 'confirmed') AS confirmed, count(*) FILTER (ai AND st = 'modified') AS modified, count(*) FILTER (ai AND del) AS deleted, count(*) FILTER (NOT ai AND NOT del) AS human_added, count(*) FILTER (NOT ai AND del) AS human_deleted,
 count(*) FILTER (NOT del) AS active, count(*) FILTER (NOT del AND st = 'pending') AS pending, round(count(*) FILTER (ai AND st = 'confirmed') / nullif(count(*) FILTER (ai AND st IN ('confirmed', 'modified', 'deleted')), 0)::DOUBLE, 9) AS confirmed_rate FROM x""",
    "code_changes": _CHANGES + """, k AS (SELECT unnest(list_intersect(old, cur)) AS code, 'kept' AS kind FROM o UNION ALL SELECT unnest(list_filter(old, lambda x: NOT list_contains(cur, x))), 'removed' FROM o UNION ALL SELECT unnest(list_filter(cur, lambda x: NOT list_contains(old, x))), 'added' FROM o)
 SELECT code, count(*) FILTER (kind <> 'added') AS original, count(*) FILTER (kind = 'kept') AS kept, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'added') AS added, round(count(*) FILTER (kind = 'removed') / nullif(count(*) FILTER (kind <> 'added'), 0)::DOUBLE, 9) AS removal_rate, count(*) FILTER (kind = 'added') - count(*) FILTER (kind = 'removed') AS net FROM k GROUP BY 1""",
    "changed_segments": _CHANGES + " SELECT record_id, CAST(seg_pos AS INTEGER) AS seg_pos, array_to_string(old, '/') AS before, array_to_string(cur, '/') AS after FROM o WHERE old <> cur",
    "review_events": _EVENTS + ", e AS (SELECT unnest(s.review.history) AS e FROM seg) SELECT e.action AS action, CAST(CAST(try_cast(e.time AS TIMESTAMP) AS DATE) AS VARCHAR) AS day, count(*) AS n FROM e WHERE e IS NOT NULL GROUP BY 1, 2",
    "action_windows": "SELECT date_trunc('hour', ts) AS start, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2",
    "merged_descriptors": f"""WITH {RECORDS}, p AS (SELECT respondent, record_id, unnest(map_entries(descriptors)) AS e FROM rec WHERE respondent IS NOT NULL)
 SELECT respondent, e.key AS descriptor, coalesce(arg_min(CASE WHEN e.value <> 'unspecified' THEN e.value END, CASE WHEN e.value <> 'unspecified' THEN record_id END), 'unspecified') AS value FROM p GROUP BY 1, 2""",
    "resume": "SELECT doc_id, transcript_file FROM documents d WHERE transcript_file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM records r WHERE r.transcript_file = d.transcript_file)",
    "kappa_per_code": f"{_HUB}{_kappa('cells', 'code')} SELECT code, n, both_yes, neither, only_a, only_b, {_K6}, {_BAND} FROM r",
    "kappa_pooled": f"{_HUB}{_kappa('cells')} SELECT n, both_yes, neither, only_a, only_b, {_K6} FROM r",
    "exact_set": f"{_HUB} SELECT count(*) AS n, round(avg(CASE WHEN codes_a = codes_b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS exact FROM hub",
    "alpha_nominal": """WITH k AS (SELECT doc_id, verdict, count(*) AS k FROM abuse_reviews WHERE verdict IS NOT NULL GROUP BY 1, 2), u AS (SELECT doc_id, sum(k) AS m, sum(k * k) AS kk FROM k GROUP BY 1 HAVING sum(k) > 1),
 o AS (SELECT sum((m * m - kk)::DOUBLE / (m - 1)) AS d, sum(m)::DOUBLE AS n FROM u), v AS (SELECT sum(c * c) AS cc FROM (SELECT verdict, sum(k) AS c FROM k WHERE doc_id IN (SELECT doc_id FROM u) GROUP BY 1))
 SELECT CAST(n AS BIGINT) AS pairable, round(1 - d / nullif((n * n - cc) / (n - 1), 0), 9) AS alpha FROM o, v""",
    "precision_recall": f"""{_HUB}, t AS (SELECT code, count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a AND b) AS fp, count(*) FILTER (a AND NOT b) AS fn FROM cells GROUP BY 1), q AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS p, tp / nullif(tp + fn, 0)::DOUBLE AS r FROM t)
 SELECT code, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) END, 9) AS f1 FROM q""",
    "dimension_confusion": f"""{_HUB}, d AS (SELECT CASE WHEN len(codes_a) = 0 THEN ['__none__'] ELSE list_distinct(list_transform(codes_a, lambda x: split_part(x, '-', 1))) END AS a, CASE WHEN len(codes_b) = 0 THEN ['__none__'] ELSE list_distinct(list_transform(codes_b, lambda x: split_part(x, '-', 1))) END AS b FROM hub),
 e AS (SELECT unnest(a) AS dim_a, b FROM d), f AS (SELECT dim_a, unnest(b) AS dim_b FROM e) SELECT dim_a, dim_b, count(*) AS n FROM f GROUP BY 1, 2""",
    "polarity_confusion": f"""{_HUB}, d AS (SELECT unit_id, codes_a, codes_b, unnest(list_distinct(list_intersect(list_transform(codes_a, lambda x: split_part(x, '-', 1)), list_transform(codes_b, lambda x: split_part(x, '-', 1))))) AS dimension FROM hub),
 e AS (SELECT dimension, list_filter(codes_a, lambda x: split_part(x, '-', 1) = dimension) = list_filter(codes_b, lambda x: split_part(x, '-', 1) = dimension) AS same FROM d) SELECT dimension, count(*) FILTER (same) AS agree, count(*) FILTER (NOT same) AS conflict FROM e GROUP BY 1""",
    "dimension_agreement": f"""{_HUB}, dims AS (SELECT unnest(['ANT','ENG','REF','RES']) AS code), dcells AS (SELECT unit_id, code, len(list_filter(codes_a, lambda x: split_part(x, '-', 1) = code)) > 0 AS a, len(list_filter(codes_b, lambda x: split_part(x, '-', 1) = code)) > 0 AS b FROM hub CROSS JOIN dims){_kappa('dcells', 'code')} SELECT code, n, both_yes, neither, only_a, only_b, round(kappa, 9) AS kappa FROM r""",
    "disagreements": f"""{_HUB}, x AS (SELECT unit_id, codes_a, codes_b, list_sort(list_distinct(list_transform(codes_a, lambda x: split_part(x, '-', 1)))) AS da, list_sort(list_distinct(list_transform(codes_b, lambda x: split_part(x, '-', 1)))) AS db FROM hub WHERE codes_a <> codes_b)
 SELECT unit_id, CASE WHEN len(codes_a) = 0 OR len(codes_b) = 0 THEN 'presence' WHEN da = db THEN 'polarity' ELSE 'dimension' END AS kind, array_to_string(list_filter(codes_a, lambda x: NOT list_contains(codes_b, x)), '/') AS only_a, array_to_string(list_filter(codes_b, lambda x: NOT list_contains(codes_a, x)), '/') AS only_b FROM x""",
    "frame_roles": "SELECT speaker_role AS role, count(*) AS n, speaker_role = 'respondent' AS in_frame FROM units GROUP BY 1",
    "strata": "WITH u AS (SELECT list_sort(list_distinct(coalesce(ai_codes, []))) AS c FROM units) SELECT CASE WHEN len(c) > 0 THEN array_to_string(c, '+') ELSE '__unmarked__' END AS stratum, count(*) AS n FROM u GROUP BY 1",
    "session_ids": """WITH u AS (SELECT session_id, list_sort(list(unit_id)) AS ids FROM units GROUP BY 1) SELECT session_id, substr(md5('[' || array_to_string(list_transform(ids, lambda x: '"' || x || '"'), ', ') || ']' || '42'), 1, 8) AS digest FROM u""",
    "scripts": """WITH t AS (SELECT text, len(regexp_extract_all(text, '[一-鿿]')) AS cjk, len(regexp_extract_all(text, '[A-Za-z]')) AS lat FROM documents WHERE text IS NOT NULL)
 SELECT CASE WHEN cjk + lat = 0 THEN 'unknown' WHEN cjk / (cjk + lat)::DOUBLE >= 0.15 THEN 'zh' ELSE 'en' END AS script, count(*) AS docs, CAST(sum(cjk + CAST(trunc((length(text) - cjk) / 3.5::DOUBLE) AS BIGINT) + 16) AS BIGINT) AS tokens FROM t GROUP BY 1""",
    "placeholder_names": f"SELECT {_STANDS_IN} AS placeholder, count(*) AS n FROM records GROUP BY 1",
    "respondent_names": f"""WITH n AS (SELECT transcript_file, CASE WHEN NOT {_STANDS_IN} THEN trim(respondent) END AS name, count(*) AS n, min(doc_id) AS first FROM documents WHERE transcript_file IS NOT NULL GROUP BY 1, 2)
 SELECT transcript_file, coalesce(name, 'unknown') AS name FROM n QUALIFY row_number() OVER (PARTITION BY transcript_file ORDER BY name IS NULL, n DESC, first) = 1""",
    "code_audit": f"""WITH {CODES},
 r AS (SELECT record_id, seg_pos, code_pos, dimension, polarity, coalesce(trim(c.rationale), '') AS rationale, CASE WHEN coalesce(trim(raw), '') = '' THEN 'malformed' WHEN dimension IS NULL THEN 'unknown_dimension'
  WHEN polarity IS NULL THEN 'no_polarity' WHEN regexp_matches(coalesce(trim(c.rationale), ''), '{_ABSENT}') THEN 'absence_as_evidence' END AS reason FROM clean),
 k AS (SELECT coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY record_id, seg_pos, dimension, polarity, rationale, reason IS NULL ORDER BY code_pos) > 1 THEN 'duplicate' END) AS reason FROM r)
 SELECT reason, count(*) AS n FROM k WHERE reason IS NOT NULL GROUP BY 1""",
    "discover_terms": f"""WITH {_WORDS.format(extra="", keys="")},
 ng AS (SELECT n, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS term FROM toks CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n)),
 c AS (SELECT n, term, count(*) AS freq FROM ng GROUP BY 1, 2), uni AS (SELECT term AS word, freq AS f FROM c WHERE n = 1), tot AS (SELECT sum(f)::DOUBLE AS t FROM uni),
 one AS (SELECT term, freq, 0.0::DOUBLE AS cohesion, ln(freq + 1.0) AS score FROM c WHERE n = 1 AND freq >= 3 AND length(term) >= 2 AND NOT list_contains({_stops()}, term)),
 more AS (SELECT n, term, freq, string_split(term, ' ') AS parts FROM c WHERE n > 1 AND freq >= 3),
 kept AS (SELECT * FROM more WHERE NOT list_contains({_stops()}, parts[1]) AND NOT list_contains({_stops()}, parts[-1]) AND NOT list_has_any(parts, {_inside()})),
 lg AS (SELECT n, term, freq, sum(log2(f)) AS lw FROM (SELECT n, term, freq, unnest(parts) AS word FROM kept) JOIN uni USING (word) GROUP BY 1, 2, 3),
 many AS (SELECT term, freq, (log2(freq) - log2(t) - (lw - n * log2(t))) / (n - 1) AS cohesion FROM lg, tot)
 SELECT term, freq, round(cohesion, 6) AS cohesion, round(score, 6) AS score FROM one UNION ALL SELECT term, freq, round(cohesion, 6), round(cohesion * ln(freq + 1.0), 6) FROM many WHERE cohesion >= 1.5""",
    "log_odds": f"""WITH {_WORDS.format(extra="replace(lower(source), '-', '_') AS code,", keys="code,")}, tk AS (SELECT code, unnest(w) AS term FROM toks), ct AS (SELECT code, term, count(*) AS k FROM tk WHERE code IS NOT NULL GROUP BY 1, 2),
 bg AS (SELECT term, sum(k) AS total FROM ct GROUP BY 1 HAVING sum(k) >= 3), ni AS (SELECT code, sum(k)::DOUBLE AS ni FROM ct WHERE term IN (SELECT term FROM bg) GROUP BY 1), big AS (SELECT sum(total)::DOUBLE AS big FROM bg),
 g AS (SELECT ni.code, bg.term, coalesce(ct.k, 0)::DOUBLE AS yi, (bg.total - coalesce(ct.k, 0))::DOUBLE AS yj, ni, big, big * (total / big) AS al FROM bg CROSS JOIN ni CROSS JOIN big LEFT JOIN ct ON ct.code = ni.code AND ct.term = bg.term),
 h AS (SELECT *, yi + al AS xi, ni + big - yi - al AS ui, yj + al AS xj, (big - ni) + big - yj - al AS uj FROM g), z AS (SELECT *, ln(xi / ui) - ln(xj / uj) AS delta FROM h WHERE least(xi, ui, xj, uj) > 0)
 SELECT code, term, round(delta / sqrt(1 / xi + 1 / xj), 6) AS z, round(delta, 6) AS log_odds, CAST(yi AS BIGINT) AS count_in, CAST(yj AS BIGINT) AS count_out FROM z WHERE NOT list_contains({_stops()}, term)""",
    "absorbed_codes": f"{_BOOK} SELECT * FROM book",
    "frequent_codes": f'{_BOOK} SELECT codebook_id, code_id, label, "count" FROM book WHERE "count" >= 2',
    "prompt_codes": f"""{_BOOK}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY codebook_id ORDER BY "count" DESC, code_no) AS INTEGER) AS rank FROM book) SELECT * FROM ranked WHERE rank <= 60""",
    "codebook_framework": f"""{_BOOK} SELECT codebook_id AS framework_id, code_no - 1 AS dim_ord, regexp_replace(lower(label), '[^\\p{{L}}\\p{{N}}]+', '_', 'g') AS dimension, upper(code_id) AS short_code, label AS label_en FROM book""",
    "pooled_alpha_all": f"""{_ALL}, t AS (SELECT framework_id, coder, {_COUNTS} FROM cells GROUP BY 1, 2), y AS (SELECT *, 2 * both_yes + only_a + only_b AS yes FROM t)
 SELECT framework_id, coder, 2 * n AS pairable, round(1 - (2 * n - 1)::DOUBLE * (only_a + only_b) / nullif(yes::DOUBLE * (2 * n - yes), 0), 9) AS alpha FROM y""",
    "menu_labels": f"""WITH {RECORDS} SELECT record_id, CASE WHEN count(*) OVER (PARTITION BY respondent) > 1 THEN coalesce(respondent, 'unknown') || ' (' || coalesce(transcript_file, record_id::VARCHAR) || ')' ELSE coalesce(respondent, 'unknown') END AS label FROM rec""",
    "segment_texts": f"""WITH {RECORDS}, {SEGMENTS}, t AS (SELECT CASE WHEN trim(s.full_text) <> '' THEN s.full_text ELSE s.quote END AS t, s.full_text AS f FROM seg)
 SELECT CASE WHEN t IS NULL THEN 'none' WHEN trim(f) <> '' THEN 'full' ELSE 'quote' END AS kind, count(*) AS n, CAST(coalesce(sum(length(t)), 0) AS BIGINT) AS chars FROM t GROUP BY 1""",
    "codebook_stats": """WITH c AS (SELECT codebook_id, unnest(codes) AS c FROM codebooks) SELECT codebook_id, count(c.label) AS codes, CAST(coalesce(sum(c.count), 0) AS BIGINT) AS applications, count(*) FILTER (c.count = 1) AS singletons, max(c.count) AS most, count(*) FILTER (c.label IS NOT NULL AND trim(coalesce(c.definition, '')) = '') AS undefined FROM c GROUP BY 1""",
    "concentration": """WITH c AS (SELECT codebook_id, unnest(codes) AS c FROM codebooks), r AS (SELECT codebook_id, coalesce(c.count, 0) AS n, row_number() OVER (PARTITION BY codebook_id ORDER BY coalesce(c.count, 0) DESC, c.label) AS r FROM c)
 SELECT codebook_id, round(sum(n) FILTER (r <= 2) / nullif(sum(n), 0)::DOUBLE, 9) AS top2, round(avg(CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS singleton_share FROM r GROUP BY 1""",
    "saturation": f"""WITH {OPEN}, s AS (SELECT record_id, saved_at, _meta.codebook_id AS codebook_id, unnest(_meta.codes_per_chunk) AS c FROM orec), t AS (SELECT codebook_id, record_id, saved_at, c.chunk AS chunk, coalesce(c.created, 0) AS created FROM s WHERE codebook_id IS NOT NULL AND c IS NOT NULL)
 SELECT codebook_id, record_id, chunk, CAST(row_number() OVER w AS INTEGER) AS n, created, CAST(sum(created) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM t WINDOW w AS (PARTITION BY codebook_id ORDER BY saved_at, record_id, chunk)""",
    "dice_pairs": _dice("SELECT DISTINCT codebook_id, c.label AS label FROM (SELECT codebook_id, unnest(codes) AS c FROM codebooks) WHERE c.label IS NOT NULL", "codebook_id"),
    "dice_parts": _dice("SELECT DISTINCT p_type AS label FROM part WHERE p_type IS NOT NULL", ""),
    "theme_table": """WITH m AS (SELECT DISTINCT l_returnflag AS theme_id, l_orderkey AS g FROM lineitem WHERE l_quantity > 40) SELECT theme_id, count(*) AS items, count(DISTINCT o_custkey) AS respondents, arg_min(o_orderpriority, g) AS exemplar, count(DISTINCT o_custkey) < 2 AS thin FROM m JOIN orders ON o_orderkey = g GROUP BY 1""",
    "theme_cases": """WITH m AS (SELECT DISTINCT l_returnflag AS theme_id, l_orderkey AS g FROM lineitem WHERE l_quantity > 40) SELECT theme_id, o_custkey AS respondent, count(*) AS n FROM m JOIN orders ON o_orderkey = g GROUP BY 1, 2""",
    "theme_support": """WITH m AS (SELECT DISTINCT l_returnflag AS theme_id, o_custkey AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 40), a AS (SELECT count(DISTINCT o_custkey) AS k FROM orders) SELECT theme_id, count(*) AS respondents, round(count(*) / any_value(a.k)::DOUBLE, 9) AS support_rate FROM m, a GROUP BY 1""",
    "theme_codes": """WITH m AS (SELECT DISTINCT l_returnflag AS theme_id, l_orderkey AS g FROM lineitem WHERE l_quantity > 40) SELECT theme_id, o_orderstatus AS code, count(*) AS n FROM m JOIN orders ON o_orderkey = g GROUP BY 1, 2""",
    "unassigned_items": "SELECT o_orderkey AS global_id, o_custkey AS respondent FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
    "coded_records": """SELECT session_id, coalesce(respondent, 'unspecified') AS respondent, CAST(count(*) AS INTEGER) AS segments FROM units WHERE len(ai_codes) > 0 GROUP BY 1, 2""",
    "dimension_labels": "SELECT framework_id || '.' || dimension AS key, coalesce(label_zh, label_en, framework_id || '.' || dimension) AS label FROM frameworks",
    "methods_facts": _EVENTS + """, e AS (SELECT unnest(s.review.history) AS e FROM seg), a AS (SELECT count(*) AS records, count(DISTINCT respondent) AS respondents, array_to_string(list_sort(list(DISTINCT _meta.framework_id)), ', ') AS frameworks, array_to_string(list_sort(list(DISTINCT _meta.endpoint.model) FILTER (_meta.endpoint.model IS NOT NULL)), ', ') AS models FROM rec),
 b AS (SELECT count(*) AS events, count(DISTINCT e.reviewer) AS reviewers FROM e WHERE e IS NOT NULL) SELECT * FROM a, b""",
    "kappa_per_code_all": f"{_ALL}{_kappa('cells', 'framework_id, coder, code')} SELECT framework_id, coder, code, n, both_yes, neither, only_a, only_b, {_K6}, {_BAND} FROM r",
    "kappa_pooled_all": f"{_ALL}{_kappa('cells', 'framework_id, coder')} SELECT framework_id, coder, n, both_yes, neither, only_a, only_b, {_K6} FROM r",
    "exact_set_all": f"{_ALL} SELECT framework_id, coder, count(*) AS n, round(avg(CASE WHEN codes_a = codes_b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS exact FROM hub GROUP BY 1, 2",
    "precision_recall_all": f"""{_ALL}, t AS (SELECT framework_id, coder, code, count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a AND b) AS fp, count(*) FILTER (a AND NOT b) AS fn FROM cells GROUP BY 1, 2, 3), q AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS p, tp / nullif(tp + fn, 0)::DOUBLE AS r FROM t)
 SELECT framework_id, coder, code, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) END, 9) AS f1 FROM q""",
    "dimension_confusion_all": f"""{_ALL}, d AS (SELECT framework_id, coder, CASE WHEN len(codes_a) = 0 THEN ['__none__'] ELSE list_distinct(list_transform(codes_a, lambda x: split_part(x, '-', 1))) END AS a, CASE WHEN len(codes_b) = 0 THEN ['__none__'] ELSE list_distinct(list_transform(codes_b, lambda x: split_part(x, '-', 1))) END AS b FROM hub),
 e AS (SELECT framework_id, coder, unnest(a) AS dim_a, b FROM d), f AS (SELECT framework_id, coder, dim_a, unnest(b) AS dim_b FROM e) SELECT framework_id, coder, dim_a, dim_b, count(*) AS n FROM f GROUP BY 1, 2, 3, 4""",
    "polarity_confusion_all": f"""{_ALL}, d AS (SELECT framework_id, coder, codes_a, codes_b, unnest(list_distinct(list_intersect(list_transform(codes_a, lambda x: split_part(x, '-', 1)), list_transform(codes_b, lambda x: split_part(x, '-', 1))))) AS dimension FROM hub),
 e AS (SELECT framework_id, coder, dimension, list_filter(codes_a, lambda x: split_part(x, '-', 1) = dimension) = list_filter(codes_b, lambda x: split_part(x, '-', 1) = dimension) AS same FROM d) SELECT framework_id, coder, dimension, count(*) FILTER (same) AS agree, count(*) FILTER (NOT same) AS conflict FROM e GROUP BY 1, 2, 3""",
    "dimension_agreement_all": f"""{_ALL}, dcells AS (SELECT h.framework_id, coder, unit_id, short_code AS code, len(list_filter(codes_a, lambda x: split_part(x, '-', 1) = short_code)) > 0 AS a, len(list_filter(codes_b, lambda x: split_part(x, '-', 1) = short_code)) > 0 AS b FROM hub h JOIN shorts USING (framework_id)){_kappa('dcells', 'framework_id, coder, code')} SELECT framework_id, coder, code, n, both_yes, neither, only_a, only_b, round(kappa, 9) AS kappa FROM r""",
    "disagreements_all": f"""{_ALL}, x AS (SELECT framework_id, coder, unit_id, codes_a, codes_b, list_sort(list_distinct(list_transform(codes_a, lambda x: split_part(x, '-', 1)))) AS da, list_sort(list_distinct(list_transform(codes_b, lambda x: split_part(x, '-', 1)))) AS db FROM hub WHERE codes_a <> codes_b)
 SELECT framework_id, coder, unit_id, CASE WHEN len(codes_a) = 0 OR len(codes_b) = 0 THEN 'presence' WHEN da = db THEN 'polarity' ELSE 'dimension' END AS kind, array_to_string(list_filter(codes_a, lambda x: NOT list_contains(codes_b, x)), '/') AS only_a, array_to_string(list_filter(codes_b, lambda x: NOT list_contains(codes_a, x)), '/') AS only_b FROM x""",
}
