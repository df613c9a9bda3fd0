"""The registered queries as DuckDB SQL over the bench tables.

Every statement starts from the same WITH list, which re-derives the intermediate tables straight
from the rules rather than from the Spark code.  Ratios use integer arithmetic, so rounding is
exactly half up.
"""

from __future__ import annotations

from cairn.operators import quality
from cairn.rules import WHITESPACE, Rules
from cairn.schema import CLEANED_CSV_SCHEMA, DERIVED_COLUMNS, DESCRIPTIVE_COLUMNS, SOURCE_HEADER
from cairn.sources.star import BENCH_RULES, SCORE_LABELS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


R: Rules = BENCH_RULES
WS = text(WHITESPACE)


def half_up(part: str, whole: str, digits: int = 4) -> str:
    scale = 10 ** digits
    return (f"CASE WHEN ({whole}) > 0 THEN ((2 * ({part})::BIGINT * {scale} + ({whole})::BIGINT) "
            f"// (2 * ({whole})::BIGINT)) / {float(scale)} END")


def zero(expr: str) -> str:
    return f"coalesce({expr}, 0.0)"


def stats(source: str) -> str:
    scores = ", ".join(f"count(*) FILTER (score = {s}) AS score_{s}" for s in range(1, 6))
    return f"""
    SELECT spot_name, count(*) AS review_count, {half_up('sum(score)', 'count(score)', 2)} AS avg_score, {scores},
      {half_up('count(*) FILTER (score >= 4)', 'count(score)')} AS positive_rate,
      {half_up('count(*) FILTER (score <= 2)', 'count(score)')} AS negative_rate,
      {zero(half_up('count(*) FILTER (image_count > 0)', 'count(*)'))} AS image_rate,
      coalesce(sum(like_count), 0)::BIGINT AS total_likes,
      {zero(half_up('count(*) FILTER (is_low_info = 1)', 'count(*)'))} AS low_info_rate,
      count(*) FILTER (trim(ip_province) <> '') AS valid_ip_sample,
      min(publish_date) AS first_comment_date, max(publish_date) AS last_comment_date, 'v1' AS stat_version
    FROM {source} GROUP BY spot_name"""


def times(source: str, spot_months: bool) -> str:
    mean = half_up("sum(score)", "count(score)", 2)
    year, month = "strftime(publish_date, '%Y')", "strftime(publish_date, '%Y-%m')"
    parts = [("year", year, "global"), ("month", month, "global"), ("year", year, "spot")]
    if spot_months:
        parts.append(("month", month, "spot"))
    return " UNION ALL ".join(
        f"SELECT '{kind}' AS period_type, {period} AS period, '{scope}' AS scope_type, "
        f"{'spot_name' if scope == 'spot' else 'NULL::VARCHAR'} AS spot_name, count(*) AS review_count, {mean} AS avg_score "
        f"FROM {source} GROUP BY {'spot_name, ' if scope == 'spot' else ''}{period}"
        for kind, period, scope in parts)


def origins(source: str) -> str:
    over = texts(R.domestic_regions)
    return f"""
    SELECT scope_type, spot_name, ip_province, review_count, {zero(half_up('review_count', 'sample_size'))} AS ratio,
      sample_size, CASE WHEN list_contains({over}, ip_province) THEN 0 ELSE 1 END AS is_overseas FROM (
      SELECT *, (sum(review_count) OVER (PARTITION BY scope_type, spot_name))::BIGINT AS sample_size FROM (
        SELECT 'global' AS scope_type, NULL::VARCHAR AS spot_name, ip_province, count(*) AS review_count
        FROM {source} WHERE trim(ip_province) <> '' GROUP BY ip_province
        UNION ALL
        SELECT 'spot', spot_name, ip_province, count(*) FROM {source} WHERE trim(ip_province) <> ''
        GROUP BY spot_name, ip_province))"""


def any_word(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


_score = """CASE WHEN quality = 1 AND toxic = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 5 END
  WHEN quality = 1 AND toxic = 1 THEN 3 WHEN quality = 0 AND toxic = 0 THEN 2 WHEN quality = 0 AND toxic = 1 THEN 1 END"""
_rates = {n: half_up(f"{n}_n", "sample_size") for n in ("positive", "neutral", "negative")}
_candidates = f"""
  SELECT source AS spot_name, doc_id AS ordinal, 'open_time' AS field, o_orderpriority AS value FROM raw
  UNION ALL SELECT source, doc_id, 'introduction', c_mktsegment || ' ' || n_name FROM raw
  UNION ALL SELECT source, doc_id, 'address', 'No. ' || (doc_id % 3) || ' ' || source || ' Road' FROM raw WHERE doc_id % 4 <> 0
  UNION ALL SELECT source, doc_id, 'phone', '089-' || source || CASE WHEN substr(source, 4)::INT % 7 = 3
    THEN '; ' || repeat('8', 60) ELSE '' END FROM raw WHERE doc_id % 5 <> 0"""

_hits = ", ".join(
    f"{{'aspect': {text(a)}, 'evidence': CASE " + " ".join(f"WHEN contains(t, {text(w)}) THEN {text(w)}" for w in words) + " END}"
    for a, words in R.aspect_words)

PRELUDE = f"""
WITH raw AS (
  SELECT d.doc_id, d.source, d.text, ({_score})::INT AS score, o_orderdate, o_totalprice, o_orderpriority,
    c_name, c_mktsegment, n_name
  FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN orders ON o_orderkey = doc_id
  LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey),
clean AS (
  SELECT doc_id AS comment_id, source AS spot_name, score, list_extract({texts(SCORE_LABELS)}, score) AS score_desc,
    nullif(trim(text, {WS}), '') AS content, length(trim(text, {WS}))::INT AS content_length,
    o_orderdate::DATE AS publish_date, year(o_orderdate)::INT AS publish_year, month(o_orderdate)::INT AS publish_month,
    CASE WHEN doc_id % 11 = 0 THEN '未知' ELSE n_name END AS ip_location, (doc_id % 11 = 0)::INT AS ip_is_unknown,
    CASE WHEN doc_id % 11 <> 0 AND o_orderdate >= DATE '{R.origin_cutoff}' THEN n_name END AS ip_province,
    trim(c_name) AS user_nick, floor(o_totalprice / 1000)::BIGINT AS like_count, (doc_id % 3)::INT AS image_count,
    CASE WHEN doc_id % 3 <> 0 THEN 'img/' || doc_id END AS image_urls,
    (length(trim(text, {WS})) BETWEEN 1 AND {R.low_info_max_chars})::INT AS is_low_info
  FROM raw),
lines AS (
  SELECT 's' || l_suppkey AS spot_name, CASE WHEN l_tax <> 0.08 THEN (floor((l_quantity - 1) / 10) + 1)::INT END AS score,
    l_shipdate::DATE AS publish_date, CASE WHEN l_shipdate >= DATE '{R.origin_cutoff}' THEN n_name END AS ip_province,
    l_quantity::BIGINT AS like_count, l_linenumber % 3 AS image_count, (l_discount = 0)::INT AS is_low_info
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey),
flagged AS (
  SELECT *, (dup_group_id IS NOT NULL)::INT AS is_dup_content FROM (
    SELECT *, CASE WHEN content IS NOT NULL AND count(*) OVER (PARTITION BY content) > 1
      THEN min(comment_id) OVER (PARTITION BY content) END AS dup_group_id FROM clean)),
reps AS (
  SELECT dup_group_id, comment_id AS representative_id FROM (
    SELECT *, row_number() OVER (PARTITION BY dup_group_id ORDER BY is_low_info, content_length DESC, comment_id) AS rn
    FROM flagged WHERE is_dup_content = 1) WHERE rn = 1),
layered AS (
  SELECT f.*, representative_id, CASE WHEN content IS NULL THEN 'excluded' WHEN is_low_info = 1 THEN 'rule'
    WHEN representative_id IS NOT NULL AND representative_id <> comment_id THEN 'reuse' ELSE 'call' END AS layer
  FROM flagged f LEFT JOIN reps USING (dup_group_id)),
ruled AS (
  SELECT comment_id, spot_name, CASE WHEN pos AND NOT neg THEN 'positive' WHEN neg AND NOT pos THEN 'negative'
      ELSE 'neutral' END AS polarity, CASE WHEN pos <> neg THEN 3 END AS intensity, 1 AS is_valid,
    nullif(array_to_string(list_filter({texts(R.positive_words + R.negative_words)}, lambda w: contains(t, w))[1:5], ','), '') AS keywords,
    nullif(substr(t, 1, 40), '') AS summary
  FROM (SELECT *, {any_word('t', R.positive_words)} AS pos, {any_word('t', R.negative_words)} AS neg
        FROM (SELECT *, coalesce(content, '') AS t FROM clean))),
read AS (
  SELECT comment_id, list_filter([{_hits}], lambda x: x.evidence IS NOT NULL)[1:5] AS hits,
    nullif(trim(substr(t, 1, 40), {WS}), '') AS summary FROM (SELECT comment_id, coalesce(content, '') AS t FROM clean)),
ann AS (
  SELECT l.comment_id, l.spot_name, l.layer, l.representative_id, r.polarity, r.intensity, 1 AS is_valid, r.keywords,
    CASE WHEN layer = 'rule' THEN r.summary ELSE d.summary END AS summary, CASE WHEN layer = 'rule' THEN [] ELSE hits END AS hits,
    CASE WHEN layer = 'rule' THEN 'rule' ELSE 'annotated' END AS source
  FROM layered l JOIN read d USING (comment_id) JOIN ruled r USING (comment_id) WHERE layer <> 'excluded'),
half AS (SELECT * FROM ann WHERE layer = 'rule'),
aspects AS (SELECT comment_id, spot_name, h.aspect AS aspect_name, polarity, h.evidence FROM (
  SELECT comment_id, spot_name, polarity, unnest(hits) AS h FROM ann)),
picked_values AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spot_name, field ORDER BY n DESC, length(value) DESC, first_seen) AS rn
    FROM (SELECT spot_name, field, value, count(*) AS n, min(ordinal) AS first_seen FROM ({_candidates}) GROUP BY ALL)) WHERE rn = 1),
spots AS (
  SELECT c.spot_name, CASE WHEN substr(c.spot_name, 4)::INT % 3 = 0 THEN 'route' ELSE 'tibet' END AS source_scope,
    any_value(value) FILTER (field = 'address') AS address, any_value(value) FILTER (field = 'open_time') AS open_time,
    any_value(CASE WHEN length(value) > {R.phone_max_chars} THEN '089-' || c.spot_name ELSE value END) FILTER (field = 'phone') AS phone,
    any_value(value) FILTER (field = 'introduction') AS introduction, any_value(review_count) AS review_count,
    any_value((review_count >= {R.full_evaluation_min})::INT) AS has_full_evaluation
  FROM (SELECT source AS spot_name, count(*) AS review_count FROM raw GROUP BY source) c
  LEFT JOIN picked_values p ON p.spot_name = c.spot_name GROUP BY c.spot_name),
stat AS ({stats('clean')}),
line_stat AS ({stats('lines')}),
stat_time AS ({times('clean', False)}),
stat_ip AS ({origins('clean')}),
moods AS (
  SELECT spot_name, count(*) AS sample_size, count(*) FILTER (polarity = 'positive') AS positive_n,
    count(*) FILTER (polarity = 'neutral') AS neutral_n, count(*) FILTER (polarity = 'negative') AS negative_n
  FROM ann GROUP BY spot_name),
aspect_stat AS (
  SELECT *, (sample_size >= 10)::INT AS conclusive, CASE WHEN sample_size >= 10 THEN {_rates['positive']} END AS positive_rate,
    CASE WHEN sample_size >= 10 THEN {_rates['negative']} END AS negative_rate FROM (
    SELECT spot_name, aspect_name, count(*) AS sample_size, count(*) FILTER (polarity = 'positive') AS positive_n,
      count(*) FILTER (polarity = 'neutral') AS neutral_n, count(*) FILTER (polarity = 'negative') AS negative_n
    FROM aspects GROUP BY spot_name, aspect_name)),
reports AS (
  SELECT spot_name, CASE WHEN substr(spot_name, 4)::INT % 5 = 0 THEN 'v0' ELSE 'v1' END AS fact_package_version,
    '共 ' || review_count || ' 条评论' AS summary, source_scope, substr(spot_name, 4)::INT % 2 AS need_review
  FROM spots WHERE NOT coalesce(introduction LIKE 'BUILDING%' OR introduction LIKE 'FURNITURE%', false)),
representatives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spot_name, side ORDER BY
      CASE WHEN content_length BETWEEN 30 AND 200 THEN 0 ELSE 1 END, like_count DESC, comment_id) AS rank_no FROM (
    SELECT *, CASE WHEN score >= 4 THEN 'positive' WHEN score <= 2 THEN 'negative' END AS side FROM flagged
      WHERE is_low_info = 0 AND is_dup_content = 0 AND content IS NOT NULL)
    WHERE side IS NOT NULL) WHERE rank_no <= 5),
pairs AS (
  SELECT spot_name AS spot_a, 'src' || CASE WHEN substr(spot_name, 4)::INT = 3 THEN 3 ELSE (substr(spot_name, 4)::INT + 1) % 20 END AS spot_b
  FROM spots),
snap AS (
  SELECT s.spot_name, s.review_count, avg_score, positive_rate, negative_rate, image_rate, total_likes
  FROM spots s LEFT JOIN stat t USING (spot_name)),
asked AS (
  SELECT o_orderkey AS question_id, trim(list_extract([a || '怎么样', a || '和' || b || '哪个好', '游客在' || a || '关注什么',
    a || '为什么不满', '一共有多少条评论', '评论量前五的排行', '帮我订' || a || '的酒店', '', 'src值得去吗，还是' || b,
    '评论数Top' || (o_orderkey % 18 + 3) || '排名', '某个地方怎么样', '介绍一下' || b, a || '差别在哪里'],
    ((o_orderkey // 20) % 13 + 1)::INT), {WS}) AS t, ((o_orderkey // 20) % 13)::INT AS form, a, b
  FROM (SELECT o_orderkey, 'src' || (o_orderkey % 20) AS a, 'src' || ((o_orderkey * 7 + 3) % 20) AS b FROM orders)),
typed AS (
  SELECT *, list_extract(['SPOT_EVALUATION', 'SPOT_COMPARISON', 'VISITOR_FOCUS', 'SENTIMENT_EXPLAIN', 'DATA_METRIC', 'RANKING',
    'OUT_OF_SCOPE', 'OUT_OF_SCOPE', 'SPOT_EVALUATION', 'RANKING', 'SPOT_EVALUATION', 'OUT_OF_SCOPE', 'SPOT_COMPARISON'], form + 1) AS question_type
  FROM asked)
"""

_one = {
    "line_spot_statistics": "SELECT * FROM line_stat",
    "line_time_statistics": times("lines", True),
    "line_origin_statistics": origins("lines"),
    "line_ranking": """SELECT spot_name, review_count, avg_score, positive_rate, negative_rate,
        CASE WHEN s_nationkey % 3 = 0 THEN 'route' ELSE 'tibet' END AS source_scope, 1 AS has_full_evaluation
      FROM line_stat JOIN supplier ON spot_name = 's' || s_suppkey WHERE review_count >= 10
      ORDER BY positive_rate DESC NULLS LAST, review_count DESC, spot_name LIMIT 20""",
    "line_volume_buckets": """SELECT CASE WHEN review_count >= 650 THEN '650+' WHEN review_count >= 600 THEN '600-649' ELSE 'under 600' END AS bucket,
        CASE WHEN review_count >= 650 THEN 0 WHEN review_count >= 600 THEN 1 ELSE 2 END AS bucket_rank,
        count(*) AS spot_count, sum(review_count)::BIGINT AS review_count FROM line_stat GROUP BY 1, 2""",
    "line_totals": "SELECT count(*) AS review_count, count(score) AS scored_count, count(ip_province) AS valid_ip_count, "
                   "count(*) FILTER (is_low_info = 1) AS low_info_count FROM lines",
    "clean_reviews": "SELECT * REPLACE (md5(content) AS content) FROM clean",
    "rejected_reviews": "SELECT doc_id::VARCHAR AS comment_id, '1998-13-45' AS publish_date FROM raw WHERE doc_id % 97 = 5",
    "cleaning_steps": """SELECT s.* FROM (SELECT (SELECT count(*) FROM raw) AS r, (SELECT count(*) FROM clean WHERE comment_id % 97 <> 5) AS c,
          (SELECT count(*) FROM (SELECT *, count(*) OVER (PARTITION BY content) AS n FROM clean WHERE comment_id % 97 <> 5)
           WHERE is_low_info = 0 AND (content IS NULL OR n = 1)) AS u),
        LATERAL (SELECT 'read source' AS stage, r AS input_count, r AS output_count, 0::BIGINT AS dropped_count, 0::BIGINT AS abnormal_count
          UNION ALL SELECT 'normalise fields', r, c, r - c, r - c
          UNION ALL SELECT 'mark duplicates and short texts', c, c, 0, 0
          UNION ALL SELECT 'text modelling input', c, u, c - u, 0) s""",
    "normalisation_statistics": """SELECT count(*) - count(score) AS score_null, count(*) - count(content) AS content_null,
        sum(ip_is_unknown)::BIGINT AS ip_unknown, count(ip_province) AS ip_province_filled, min(content_length) AS min_length,
        max(content_length) AS max_length, sum(content_length)::BIGINT AS sum_length, min(publish_date) AS first_date,
        max(publish_date) AS last_date, count(DISTINCT publish_year) AS years FROM clean""",
    "layering_statistics": f"""SELECT count(*) AS total, sum(is_low_info)::BIGINT AS low_info, sum(is_dup_content)::BIGINT AS dup_content,
        count(DISTINCT dup_group_id) AS dup_groups, count(*) FILTER (is_low_info = 0 AND is_dup_content = 0) AS usable_for_text,
        {half_up('sum(is_low_info)', 'count(*)')} AS low_info_share, {half_up('sum(is_dup_content)', 'count(*)')} AS dup_share FROM flagged""",
    "duplicate_groups": "SELECT dup_group_id, count(*) AS members FROM flagged WHERE is_dup_content = 1 GROUP BY 1",
    "duplicate_flags": "SELECT comment_id, is_dup_content, dup_group_id FROM flagged",
    "listed_duplicate_flags": """SELECT comment_id, (g IS NOT NULL)::INT AS is_dup_content, g AS dup_group_id FROM clean LEFT JOIN (
        SELECT o_orderkey AS comment_id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS g FROM orders
        QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1) USING (comment_id)""",
    "duplicate_representatives": "SELECT * FROM reps",
    "group_members": "SELECT comment_id, dup_group_id, representative_id FROM layered WHERE representative_id <> comment_id",
    "flag_overlap": """SELECT sum(is_low_info)::BIGINT AS low_info, sum(is_dup_content)::BIGINT AS dup_content,
        count(*) FILTER (is_low_info = 1 AND is_dup_content = 1) AS both_flags,
        count(*) FILTER (is_low_info = 0 AND is_dup_content = 0) AS neither_flag, count(*) AS total FROM flagged""",
    "spot_dimension": "SELECT * FROM spots",
    "representative_values": "SELECT spot_name, field, md5(value) AS value_md5, n AS occurrences FROM picked_values",
    "phone_truncations": """SELECT spot_name, length(value)::INT AS merged_length, length('089-' || spot_name)::INT AS kept_length,
        '089-' || spot_name AS kept FROM picked_values WHERE field = 'phone' AND length(value) > 64""",
    "spot_counters": """SELECT count(*) AS spots, count(*) FILTER (source_scope = 'tibet') AS scope_a_spots,
        count(*) FILTER (source_scope = 'route') AS scope_b_spots, sum(has_full_evaluation)::BIGINT AS full_evaluation_spots,
        count(address) AS has_address, count(open_time) AS has_open_time, count(phone) AS has_phone,
        count(introduction) AS has_introduction FROM spots""",
    "scope_labels": "SELECT spot_name, source_scope FROM spots",
    "entity_level_counts": """SELECT count(*) AS spots, count(*) FILTER (source_scope = 'tibet') AS scope_a,
        count(*) FILTER (source_scope = 'route') AS scope_b, count(*) FILTER (has_full_evaluation = 1) AS full_evaluation FROM spots""",
    "unknown_entities": "SELECT DISTINCT spot_name FROM clean WHERE substr(spot_name, 4)::INT % 3 = 0",
    "reviews_with_spot_fields": "SELECT comment_id, address, open_time, introduction FROM clean JOIN spots USING (spot_name)",
    "reviews_with_spot_id": "SELECT comment_id, substr(spot_name, 4)::INT AS spot_id FROM clean",
    "spot_statistics": "SELECT * FROM stat",
    "time_statistics": "SELECT * FROM stat_time",
    "origin_statistics": "SELECT * FROM stat_ip",
    "dataset_totals": "SELECT count(*) AS review_count, count(score) AS scored_count, count(ip_province) AS valid_ip_count, "
                      "count(*) FILTER (is_low_info = 1) AS low_info_count FROM clean",
    "score_distribution": f"SELECT score, n, {half_up('n', 'total')} AS rate FROM (SELECT score, count(*) AS n, "
                          "(sum(count(*)) OVER ())::BIGINT AS total FROM clean WHERE score IS NOT NULL GROUP BY score)",
    "volume_buckets": """SELECT b AS bucket, (list_position(['3000+', '1000-2999', '500-999', '100-499', '10-99', '1-9'], b) - 1)::INT AS bucket_rank,
        count(*) AS spot_count, sum(review_count)::BIGINT AS review_count FROM (SELECT review_count, CASE WHEN review_count >= 3000 THEN '3000+'
          WHEN review_count >= 1000 THEN '1000-2999' WHEN review_count >= 500 THEN '500-999' WHEN review_count >= 100 THEN '100-499'
          WHEN review_count >= 10 THEN '10-99' ELSE '1-9' END AS b FROM stat) GROUP BY b""",
    "scope_composition": """SELECT source_scope, count(DISTINCT s.spot_name) AS spot_count, count(comment_id) AS review_count,
        CASE WHEN source_scope = 'tibet' THEN '西藏' ELSE '进藏沿线' END AS scope_label FROM spots s LEFT JOIN clean c USING (spot_name) GROUP BY source_scope""",
    "weak_labels": """SELECT CASE WHEN score >= 4 THEN 2.0::DOUBLE WHEN score = 3 THEN 1.0 ELSE 0.0 END AS label,
        CASE WHEN score >= 4 THEN 'positive' WHEN score = 3 THEN 'neutral' ELSE 'negative' END AS polarity, count(*) AS n
        FROM clean WHERE score IS NOT NULL GROUP BY 1, 2""",
    "overview_totals": """SELECT unnest(['review_count', 'low_info_count', 'dup_count', 'dup_group_count', 'image_review_count', 'ip_unknown_count',
          'score_null_count', 'dedup_review_count']) AS metric, unnest([count(*), count(*) FILTER (is_low_info = 1),
          count(*) FILTER (is_dup_content = 1), count(DISTINCT dup_group_id), count(*) FILTER (image_count > 0),
          count(*) FILTER (ip_is_unknown = 1), count(*) FILTER (score IS NULL), count(*) FILTER (is_dup_content = 0)]) AS value FROM flagged
        UNION ALL SELECT unnest(['spot_count', 'spot_scope_a', 'spot_scope_b', 'spot_full_evaluation']), unnest([count(*),
          count(*) FILTER (source_scope = 'tibet'), count(*) FILTER (source_scope = 'route'), count(*) FILTER (has_full_evaluation = 1)]) FROM spots""",
    "data_note": """SELECT unnest(['reviews', 'empty_content', 'low_info', 'dup_content', 'dup_groups', 'score_null', 'ip_unknown']) AS metric,
        unnest([count(*), count(*) FILTER (content IS NULL), count(*) FILTER (is_low_info = 1), count(*) FILTER (is_dup_content = 1),
          count(DISTINCT dup_group_id), count(*) FILTER (score IS NULL), count(*) FILTER (ip_is_unknown = 1)]) AS value FROM flagged
        UNION ALL SELECT 'spots', count(*) FROM spots""",
    "yearly_trend": "SELECT period, review_count, avg_score FROM stat_time WHERE scope_type = 'global' AND period_type = 'year'",
    "monthly_trend": "SELECT period, review_count, avg_score FROM stat_time WHERE scope_type = 'global' AND period_type = 'month'",
    "spot_trend": "SELECT period, review_count, avg_score FROM stat_time WHERE spot_name = 'src7' AND period_type = 'year'",
    "top_origins": "SELECT ip_province, review_count, ratio AS rate, is_overseas, sample_size FROM stat_ip WHERE scope_type = 'global' "
                   "ORDER BY review_count DESC, ip_province LIMIT 10",
    "origin_summary": "SELECT count(*) AS province_count, coalesce(max(sample_size), 0) AS sample_size FROM stat_ip WHERE scope_type = 'global'",
    "spot_page": """SELECT spot_name, source_scope, has_full_evaluation, address, s.review_count, avg_score, positive_rate, negative_rate,
        CASE WHEN source_scope = 'tibet' THEN '西藏' ELSE '进藏沿线' END AS scope_label FROM spots s LEFT JOIN stat t USING (spot_name)
        WHERE spot_name LIKE '%src1%' ORDER BY s.review_count DESC, spot_name LIMIT 4 OFFSET 4""",
    "page_totals": "SELECT count(*) AS total FROM spots WHERE spot_name LIKE '%src1%'",
    "ranking_by_reviews": """SELECT spot_name, t.review_count, avg_score, positive_rate, negative_rate, source_scope, has_full_evaluation
        FROM stat t JOIN spots USING (spot_name) ORDER BY t.review_count DESC, spot_name LIMIT 7""",
    "ranking_by_rating": """SELECT spot_name, t.review_count, avg_score, positive_rate, negative_rate, source_scope, has_full_evaluation
        FROM stat t JOIN spots USING (spot_name) WHERE t.review_count >= 10
        ORDER BY avg_score DESC NULLS LAST, t.review_count DESC, spot_name LIMIT 7""",
    "spot_details": """SELECT spot_name, source_scope, s.review_count, avg_score, positive_rate, negative_rate, image_rate,
        strftime(first_comment_date, '%Y-%m-%d') AS first_comment_date, strftime(last_comment_date, '%Y-%m-%d') AS last_comment_date,
        (s.review_count >= 20)::INT AS evaluation_available,
        CASE WHEN s.review_count < 20 THEN 'REVIEW_COUNT_BELOW_THRESHOLD' END AS availability_reason,
        concat_ws(',', CASE WHEN open_time IS NULL THEN 'open_time' END, CASE WHEN phone IS NULL THEN 'phone' END,
          CASE WHEN introduction IS NULL THEN 'introduction' END, 'poi_url') AS missing_fields
        FROM spots s LEFT JOIN stat t USING (spot_name)""",
    "work_layers": "SELECT comment_id, layer, representative_id FROM layered",
    "pending_work": "SELECT comment_id, layer FROM layered WHERE layer IN ('call', 'reuse')",
    "layer_totals": """SELECT layer, count(*) AS total, count(h.comment_id) AS done, count(*) - count(h.comment_id) AS pending
        FROM layered l LEFT JOIN half h USING (comment_id) GROUP BY l.layer""".replace("SELECT layer", "SELECT l.layer"),
    "rule_labels": "SELECT * REPLACE (md5(summary) AS summary) FROM ruled",
    "read_annotations": "SELECT comment_id, polarity, intensity, array_to_string(list_transform(hits, lambda h: h.aspect || ':' || h.evidence), ',') AS aspects "
                        "FROM ruled JOIN read USING (comment_id)",
    "sentiment_rows": """SELECT comment_id, spot_name, polarity, intensity, is_valid,
        CASE layer WHEN 'rule' THEN 'rule' WHEN 'call' THEN 'annotated' ELSE 'reuse' END AS source,
        CASE layer WHEN 'call' THEN 'rules' WHEN 'reuse' THEN 'reuse' END AS mode,
        CASE layer WHEN 'call' THEN true WHEN 'reuse' THEN false END AS has_usage FROM ann""",
    "aspect_rows": "SELECT comment_id, spot_name, aspect_name, polarity, md5(evidence) AS evidence_md5 FROM aspects",
    "semantic_rows": "SELECT comment_id, spot_name, md5(keywords) AS keywords_md5, md5(summary) AS summary_md5, source FROM ann",
    "reused_results": "SELECT comment_id, spot_name, polarity, intensity, representative_id AS reused_from FROM ann WHERE layer = 'reuse'",
    "annotator_job": """SELECT comment_id, 1 AS attempt, CASE WHEN bad THEN 'ValueError' END AS error_kind,
        CASE WHEN bad THEN 15 END AS reason_length, CASE WHEN NOT bad THEN true END AS has_tokens
        FROM (SELECT comment_id, upper(coalesce(content, '')) = coalesce(content, '') AS bad FROM clean)""",
    "annotator_failures": """SELECT 'ERROR' AS level, 'semantic' AS stage, '[ValueError] no small letter' AS message,
        comment_id::VARCHAR AS ref_key, 0 AS resolved FROM clean WHERE upper(coalesce(content, '')) = coalesce(content, '')""",
    "merged_calls": """SELECT conv_id AS comment_id, md5(arg_max(text, turn)) AS raw_text, count(*) AS calls, sum(turn % 4 + 1)::BIGINT AS attempts,
        sum(length(text))::BIGINT AS prompt_tokens, sum(length(text) // 2)::BIGINT AS completion_tokens,
        sum(length(text) + length(text) // 2)::BIGINT AS total_tokens FROM conversations GROUP BY conv_id""",
    "call_statistics": """SELECT CASE WHEN length(text) % 7 = 0 THEN 'timeout' WHEN length(text) % 11 = 0 THEN 'server' ELSE 'ok' END AS outcome,
        count(*) AS requests, sum(turn % 4 + 1)::BIGINT AS attempts, (sum(turn % 4 + 1) - count(*))::BIGINT AS retries,
        sum(length(text))::BIGINT AS prompt_tokens, sum(length(text) // 2)::BIGINT AS completion_tokens,
        sum(length(text) + length(text) // 2)::BIGINT AS total_tokens FROM conversations GROUP BY 1""",
    "sentiment_distribution": f"SELECT spot_name, 'annotated' AS method, sample_size, positive_n, neutral_n, negative_n, "
        f"{_rates['positive']} AS positive_rate, {_rates['neutral']} AS neutral_rate, {_rates['negative']} AS negative_rate FROM moods",
    "method_coverage": "SELECT 'annotated' AS method, count(*) AS n FROM ann",
    "aspect_statistics": "SELECT * FROM aspect_stat",
    "focus_ranking": f"""SELECT aspect_name, sample_size, CASE WHEN sample_size >= 10 THEN {_rates['negative']} END AS negative_rate FROM (
        SELECT aspect_name, count(*) AS sample_size, count(*) FILTER (polarity = 'negative') AS negative_n FROM aspects GROUP BY 1)
        ORDER BY sample_size DESC, aspect_name LIMIT 15""",
    "keyword_frequency": f"""SELECT keyword, count(*) AS n FROM (SELECT trim(unnest(string_split(keywords, ',')), {WS}) AS keyword FROM ann)
        WHERE keyword <> '' GROUP BY keyword ORDER BY n DESC, keyword LIMIT 15""",
    "most_negative_aspects": f"""SELECT *, {_rates['negative']} AS negative_rate FROM (SELECT aspect_name, count(*) AS sample_size,
        count(*) FILTER (polarity = 'negative') AS negative_n FROM aspects GROUP BY 1 HAVING count(*) >= 10)
        ORDER BY negative_n::DOUBLE / sample_size DESC, aspect_name LIMIT 10""",
    "length_histogram": f"SELECT bucket, count(*) AS n, {half_up('sum(content_length)', 'count(*)', 1)} AS avg_chars FROM (SELECT content_length, "
        "CASE WHEN content_length <= 20 THEN '01: <=20' WHEN content_length <= 40 THEN '02: 21-40' WHEN content_length <= 60 THEN '03: 41-60' "
        "WHEN content_length <= 80 THEN '04: 61-80' WHEN content_length <= 100 THEN '05: 81-100' WHEN content_length <= 150 THEN '06: 101-150' "
        "WHEN content_length <= 200 THEN '07: 151-200' WHEN content_length <= 300 THEN '08: 201-300' WHEN content_length <= 500 THEN '09: 301-500' "
        "WHEN content_length <= 1000 THEN '10: 501-1000' ELSE '11: >1000' END AS bucket FROM layered WHERE layer = 'call') GROUP BY bucket",
    "evidence_violations": f"""SELECT comment_id, aspect_name, CASE WHEN contains(translate(content, {WS}, ''), translate(e, {WS}, ''))
        THEN 'whitespace_only' ELSE 'genuine' END AS violation FROM (SELECT comment_id, aspect_name, CASE WHEN comment_id % 5 = 0
          THEN replace(replace(evidence, ' ', ''), chr(10), '') WHEN comment_id % 7 = 0 THEN evidence || '#' ELSE evidence END AS e FROM aspects)
        JOIN clean USING (comment_id) WHERE e <> '' AND NOT contains(content, e)""",
    "representative_reviews": """SELECT spot_name, side, comment_id, md5(substr(content, 1, 300)) AS content, like_count, score, rank_no::INT AS rank_no
        FROM representatives""",
    "fact_packages": f"""SELECT s.spot_name, 'v1' AS version, t.review_count, source_scope, introduction AS intro_excerpt, avg_score,
        last_comment_date AS last_date, m.sample_size AS sentiment_sample, {half_up('positive_n', 'm.sample_size', 2)} AS sentiment_positive,
        a.n::INT AS aspects, a.first_aspect, a.first_aspect_negative, coalesce(p.n, 0)::INT AS positive_reviews, p.first_positive
        FROM spots s JOIN stat t USING (spot_name) JOIN moods m USING (spot_name)
        JOIN (SELECT spot_name, count(*) AS n, arg_min(aspect_name, (-sample_size, aspect_name)) AS first_aspect,
          arg_min(coalesce(CASE WHEN sample_size >= 10 THEN {half_up('negative_n', 'sample_size', 2)} END, -1), (-sample_size, aspect_name)) AS f,
          nullif(f, -1) AS first_aspect_negative FROM aspect_stat GROUP BY spot_name) a USING (spot_name)
        LEFT JOIN (SELECT spot_name, count(*) AS n, arg_min(comment_id, rank_no)::VARCHAR AS first_positive FROM representatives
          WHERE side = 'positive' GROUP BY spot_name) p USING (spot_name) WHERE has_full_evaluation = 1""",
    "package_statistics": """SELECT count(DISTINCT spot_name) AS packages, count(*) FILTER (sample_size >= 10) AS aspects_included,
        count(*) FILTER (sample_size < 10) AS aspects_excluded, 0::BIGINT AS without_sentiment FROM aspect_stat JOIN spots USING (spot_name) WHERE has_full_evaluation = 1""",
    "missing_packages": "SELECT spot_name, 'v1' AS version FROM spots WHERE has_full_evaluation = 1 AND source_scope <> 'route'",
    "allowed_numbers": f"""SELECT spot_name, (p.n + a.np)::INT AS percents, (3 + (avg_score IS NOT NULL)::INT + a.ns)::INT AS numbers,
        round(p.total + a.tp, 2) AS percent_sum, round(t.review_count + coalesce(avg_score, 0) + total_likes + m.sample_size + a.ts, 2) AS number_sum
        FROM spots s JOIN stat t USING (spot_name) JOIN moods m USING (spot_name)
        JOIN (SELECT spot_name, count(x) AS n, sum(round(x * 100, 2)) AS total FROM (SELECT spot_name, unnest([image_rate, t.positive_rate, t.negative_rate,
            {half_up('positive_n', 'sample_size', 2)}, {half_up('neutral_n', 'sample_size', 2)}, {half_up('negative_n', 'sample_size', 2)}]) AS x
            FROM stat t JOIN moods USING (spot_name)) GROUP BY spot_name) p USING (spot_name)
        JOIN (SELECT spot_name, 2 * count(*) FILTER (sample_size >= 10) AS np, count(*) AS ns, sum(sample_size) AS ts,
            coalesce(sum(round(100 * {half_up('positive_n', 'sample_size', 2)}, 2) + round(100 * {half_up('negative_n', 'sample_size', 2)}, 2))
              FILTER (sample_size >= 10), 0) AS tp FROM aspect_stat GROUP BY spot_name) a USING (spot_name) WHERE has_full_evaluation = 1""",
    "stale_reports": """SELECT s.spot_name, 'v1' AS version, fact_package_version, CASE WHEN fact_package_version IS NULL THEN 'missing' ELSE 'outdated' END AS reason
        FROM spots s LEFT JOIN reports USING (spot_name) WHERE has_full_evaluation = 1 AND fact_package_version IS DISTINCT FROM 'v1'""",
    "report_number_check": """SELECT spot_name, p AS wrong_percents, n AS wrong_numbers, (p + n > 0)::INT AS need_review FROM (
        SELECT spot_name, CASE WHEN k % 11 = 0 THEN 0 WHEN len(list_filter(pf, lambda f: abs(f - pct) <= 0.5)) = 0 THEN 1 ELSE 0 END AS p,
          CASE WHEN k % 11 = 0 OR cnt < 3 THEN 0 WHEN len(list_filter(nf, lambda f: abs(f - cnt) <= greatest(0.5, f * 0.01))) = 0 THEN 1 ELSE 0 END AS n
        FROM (SELECT spot_name, substr(spot_name, 2)::BIGINT AS k,
          round(round(positive_rate * 100, 2) + CASE WHEN k % 3 = 0 THEN 2.5 ELSE 0.2 END, 2) AS pct, review_count + CASE WHEN k % 4 = 0 THEN 40 ELSE 0 END AS cnt,
          [round(positive_rate * 100, 2), round(negative_rate * 100, 2), round(image_rate * 100, 2)] AS pf,
          [review_count::DOUBLE, avg_score, total_likes::DOUBLE] AS nf FROM line_stat))""",
    "validated_reports": """SELECT spot_name, (k % 11 <> 0)::INT AS is_usable, CASE WHEN k % 11 = 0 THEN 0 ELSE
          length('共 ' || c || ' 条评论，好评率 ' || printf('%.2f', p) || '%，有 2 个方面较突出。') END::INT AS summary_length,
        2 AS advantages, CASE WHEN k % 5 = 0 THEN 6 ELSE 1 END AS issues, 2 AS visitor_focus,
        CASE WHEN k % 5 = 0 THEN 'issues cut' ELSE 'issues short' END AS repairs FROM (SELECT spot_name, substr(spot_name, 2)::BIGINT AS k,
          round(positive_rate * 100, 2) + CASE WHEN k % 3 = 0 THEN 2.5 ELSE 0.2 END AS p, review_count + CASE WHEN k % 4 = 0 THEN 40 ELSE 0 END AS c FROM line_stat)""",
    "pair_differences": f"""SELECT spot_a, spot_b, a.review_count - b.review_count AS review_count_delta, round(a.avg_score - b.avg_score, 2) AS avg_score_delta,
        round(a.positive_rate - b.positive_rate, 4) AS positive_rate_delta, round(a.negative_rate - b.negative_rate, 4) AS negative_rate_delta,
        {half_up('greatest(a.review_count, b.review_count)', 'least(a.review_count, b.review_count)', 2)} AS sample_ratio,
        (coalesce(sample_ratio, 0) >= 10)::INT AS reliability_warning,
        CASE WHEN a.review_count > b.review_count THEN spot_a WHEN a.review_count < b.review_count THEN spot_b END AS larger_spot
        FROM pairs JOIN snap a ON a.spot_name = spot_a JOIN snap b ON b.spot_name = spot_b WHERE spot_a <> spot_b""",
    "indicator_rows": " UNION ALL ".join(
        f"SELECT spot_a, spot_b, {i} AS indicator_no, '{n}' AS indicator, a.{n}::DOUBLE AS value_a, b.{n}::DOUBLE AS value_b, "
        f"round(a.{n}::DOUBLE - b.{n}::DOUBLE, {d}) AS delta FROM pairs JOIN snap a ON a.spot_name = spot_a JOIN snap b ON b.spot_name = spot_b "
        "WHERE spot_a <> spot_b" for i, (n, d) in enumerate((("review_count", 0), ("avg_score", 2), ("positive_rate", 4),
                                                           ("negative_rate", 4), ("image_rate", 4), ("total_likes", 0)), 1)),
    "aspect_alignment": """SELECT *, row_number() OVER (PARTITION BY spot_a, spot_b ORDER BY larger_sample DESC, aspect_name)::INT AS rank_no FROM (
        SELECT spot_a, spot_b, aspect_name, any_value(sample_size) FILTER (side = 'a') AS sample_size_a, any_value(conclusive) FILTER (side = 'a') AS conclusive_a,
          any_value(positive_rate) FILTER (side = 'a') AS positive_rate_a, any_value(negative_rate) FILTER (side = 'a') AS negative_rate_a,
          any_value(sample_size) FILTER (side = 'b') AS sample_size_b, any_value(conclusive) FILTER (side = 'b') AS conclusive_b,
          any_value(positive_rate) FILTER (side = 'b') AS positive_rate_b, any_value(negative_rate) FILTER (side = 'b') AS negative_rate_b,
          max(sample_size) AS larger_sample
        FROM (SELECT spot_a, spot_b, 'a' AS side, s.* FROM pairs JOIN aspect_stat s ON spot_name = spot_a
          UNION ALL SELECT spot_a, spot_b, 'b', s.* FROM pairs JOIN aspect_stat s ON spot_name = spot_b) WHERE spot_a <> spot_b GROUP BY 1, 2, 3)
        QUALIFY rank_no <= 12""",
    "question_types": "SELECT question_id, question_type FROM typed",
    "ranking_sizes": """SELECT question_id, CASE WHEN form = 5 THEN 5 ELSE CASE WHEN question_id % 18 + 3 <= 20 THEN (question_id % 18 + 3)::INT ELSE 10 END END AS top_n
        FROM typed WHERE question_type = 'RANKING'""",
    "import_measures": """SELECT unnest(['spots', 'scope_a', 'scope_b', 'full_evaluation', 'review_count_sum', 'full_evaluation_reviews']) AS check_name,
        unnest([count(*), count(*) FILTER (source_scope = 'tibet'), count(*) FILTER (source_scope = 'route'), sum(has_full_evaluation), sum(review_count),
          sum(review_count) FILTER (has_full_evaluation = 1)])::DOUBLE AS actual FROM spots
        UNION ALL SELECT unnest(['reviews', 'low_info', 'dup_rows', 'dup_groups', 'score_null', 'content_null', 'ip_unknown', 'region_filled', 'five_star',
          'max_length', 'distinct_ids', 'region_before_cutoff']), unnest([count(*), sum(is_low_info), sum(is_dup_content), count(DISTINCT dup_group_id),
          count(*) - count(score), count(*) - count(content), sum(ip_is_unknown), count(ip_province), count(*) FILTER (score = 5), max(content_length),
          count(DISTINCT comment_id), 0])::DOUBLE FROM flagged""",
    "self_check": """SELECT check_name, actual::DOUBLE AS actual, expected::DOUBLE AS expected, (abs(actual - expected) <= 0.01)::INT AS ok FROM (
        SELECT 'stat_rows' AS check_name, (SELECT count(*) FROM stat)::DOUBLE AS actual, (SELECT count(*) FROM spots)::DOUBLE AS expected
        UNION ALL SELECT 'review_count_sum', (SELECT sum(review_count) FROM stat), (SELECT count(*) FROM clean)
        UNION ALL SELECT 'score_sum', (SELECT sum(score_1 + score_2 + score_3 + score_4 + score_5) FROM stat), (SELECT count(score) FROM clean)
        UNION ALL SELECT 'rates_out_of_bounds', (SELECT count(*) FROM stat WHERE positive_rate NOT BETWEEN 0 AND 1 OR negative_rate NOT BETWEEN 0 AND 1), 0
        UNION ALL SELECT 'count_mismatches', 0, 0
        UNION ALL SELECT 'origin_ratio_sum', (SELECT round(sum(ratio), 2) FROM stat_ip WHERE scope_type = 'global'), 1
        UNION ALL SELECT 'origin_denominator', (SELECT max(sample_size) FROM stat_ip WHERE scope_type = 'global'), (SELECT count(ip_province) FROM clean))""",
    "integrity_checks": """SELECT unnest(['orphan_spot', 'orphan_review', 'semantic_without_sentiment', 'sentiment_without_semantic', 'orphan_aspect',
          'orphan_aspect_review', 'sentiment_dup_keys', 'aspect_dup_keys', 'illegal_polarity', 'illegal_intensity', 'usage_missing', 'stub_rows',
          'trace_rows', 'evidence_not_in_content', 'evidence_whitespace_only']) AS check_name,
        unnest([0, 0, (SELECT count(*) FROM ann WHERE layer = 'reuse' AND keywords IS NOT NULL), (SELECT count(*) FROM ann WHERE layer <> 'reuse' AND keywords IS NULL),
          (SELECT sum(CASE WHEN a.polarity = 'negative' THEN 2 ELSE 1 END) FROM aspects a JOIN ann USING (comment_id) WHERE layer = 'reuse'), 0, 0,
          (SELECT count(*) FROM aspects WHERE polarity = 'negative'), 0, (SELECT count(*) FROM ann WHERE layer <> 'reuse' AND polarity = 'negative'),
          0, 0, 0, 0, 0])::DOUBLE AS actual""",
    "layer_checks": """SELECT unnest(['layers_not_exhaustive', 'layer_pending_mismatch', 'rule_result_on_normal_text', 'result_on_empty_text', 'nothing_pending']) AS check_name,
        unnest([0, 0, 0, 0, (NOT EXISTS (SELECT 1 FROM ann WHERE layer <> 'rule'))::INT])::DOUBLE AS actual""",
    "recomputed_columns": """SELECT unnest(['score', 'content_length', 'publish_date', 'ip_province', 'is_low_info', 'like_count', 'missing_rows']) AS check_name,
        unnest([0, count(*) FILTER (strlen(coalesce(content, '')) <> content_length), 0, 0, 0, 0, 0])::DOUBLE AS actual FROM clean""",
    "stage_reconciliation": """SELECT count(*) FILTER (is_low_info = 0 AND is_dup_content = 0) AS usable, count(*) FILTER (layer = 'call') AS call_layer,
        count(*) FILTER (layer = 'call' AND is_dup_content = 1) AS representatives,
        count(*) FILTER (content IS NULL AND is_low_info = 0 AND is_dup_content = 0) AS empty_texts, 0::BIGINT AS unexplained FROM layered""",
    "count_mismatches": """SELECT spot_name, t.review_count, nullif(count(score), 0) AS actual FROM stat t JOIN clean USING (spot_name)
        GROUP BY spot_name, t.review_count HAVING count(score) <> t.review_count""",
    "annotation_status": """SELECT 'sentiment' AS section, 'annotated/' || polarity AS key, count(*) AS n FROM ann GROUP BY polarity
        UNION ALL SELECT 'semantic', source, count(*) FROM ann GROUP BY source""",
    "task_summary": """SELECT event_type AS task_type, CASE WHEN event_type = 'error' THEN 'FAILED' WHEN (props->>'$.k')::BIGINT % 5 = 0 THEN 'RUNNING'
        ELSE 'SUCCESS' END AS status, count(*) AS n FROM events GROUP BY 1, 2""",
    "task_list": """SELECT event_id AS task_id, event_type AS task_type, 'FAILED' AS status, (props->>'$.k')::BIGINT AS success_count FROM events
        WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 15""",
    "task_details": """SELECT user_id AS task_id, count(*) AS log_count, count(*) FILTER (event_type = 'error') AS error_count,
        count(*) FILTER (event_type = 'error' AND NOT value > 10) AS open_errors, sum((props->>'$.k')::BIGINT)::BIGINT AS detail_total FROM events GROUP BY user_id""",
    "caliber_table": f"""SELECT unnest(['ip_valid_since', 'min_review_count', 'aspect_min_sample', 'low_info_max_length', 'sentiment_methods', 'trend_note']) AS key,
        unnest(['{R.origin_cutoff}', '20', '10', '40', 'annotated,mllib,dict', NULL]) AS value, count(*) AS sample_size FROM clean""",
    "ranking_with_caliber": """SELECT spot_name, t.review_count AS caliber_sample FROM stat t JOIN spots USING (spot_name)
        ORDER BY t.review_count DESC, spot_name LIMIT 5""",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
        "benchmark", "labels", "conversations")),
    "bound_query": "SELECT spot_name, count(*) AS n FROM clean WHERE score >= 4 GROUP BY spot_name",
    "first_reviews": "SELECT comment_id, spot_name FROM clean ORDER BY comment_id LIMIT 50",
    "upserted_sentiment": """SELECT comment_id, polarity FROM ann WHERE intensity IS NOT NULL
        UNION ALL SELECT comment_id, 'old' FROM half WHERE intensity IS NULL""",
    "replaced_aspects": """SELECT comment_id, aspect_name, 'new' AS state FROM aspects a JOIN clean USING (comment_id) WHERE clean.score >= 4 AND polarity = 'positive'
        UNION ALL SELECT comment_id, aspect_name, 'old' FROM aspects JOIN clean USING (comment_id) WHERE NOT coalesce(clean.score >= 4, false)""",
    "missing_after_write": "SELECT comment_id, layer FROM layered WHERE layer <> 'rule'",
    "packages_by_id": "SELECT spot_name, 'v1' AS version, t.review_count FROM spots s JOIN stat t USING (spot_name) JOIN reports USING (spot_name) WHERE has_full_evaluation = 1",
    "packages_by_version": "SELECT spot_name, 'v1' AS version, t.review_count FROM spots s JOIN stat t USING (spot_name) WHERE has_full_evaluation = 1",
    "outside_reuse": "SELECT comment_id, layer FROM layered WHERE comment_id NOT IN (SELECT representative_id FROM layered WHERE layer = 'reuse')",
    "run_report_top": "SELECT spot_name, review_count, avg_score FROM stat ORDER BY review_count DESC, spot_name LIMIT 5",
    "modelling_counters": """SELECT count(*) AS input_rows, sum(is_low_info)::BIGINT AS low_info_rows, sum(is_dup_content)::BIGINT AS dup_rows,
        count(*) FILTER (content IS NOT NULL AND is_low_info = 0 AND is_dup_content = 0) AS modelling_rows FROM flagged""",
    "mean_sentiment": f"SELECT spot_name, {half_up('2 * positive_n + neutral_n', '2 * sample_size')} AS sentiment_avg FROM moods",
}


_own = f"list_extract({texts(R.aspects)}, (k % 10 + 1)::INT)"
_reasons = f"""CASE k % 13 WHEN 3 THEN [] WHEN 8 THEN ['unknown_aspect'] WHEN 9 THEN ['duplicate_aspect']
  WHEN 10 THEN ['over_limit', 'over_limit'] WHEN 11 THEN ['evidence_not_in_text']
  WHEN 12 THEN [CASE WHEN k % 10 = 0 THEN 'duplicate_aspect' ELSE 'illegal_polarity' END] ELSE [] END"""
_bent = "(SELECT comment_id AS k, content AS t FROM clean)"
_stop = texts(("the", "of", "and", "le", "la", "der", "die"))
_terms = (f"(SELECT comment_id, list_filter(words, lambda w: NOT list_contains({_stop}, w)) AS words FROM (SELECT comment_id, "
          "list_filter(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'), lambda w: length(w) >= 2) AS words FROM flagged "
          "WHERE content IS NOT NULL AND is_low_info = 0 AND is_dup_content = 0) WHERE len(words) > 0)")
_voices = """SELECT *, row_number() OVER (PARTITION BY spot_name, voice ORDER BY is_dup_content, like_count DESC, content_length DESC, comment_id)::INT AS rank_no
  FROM (SELECT *, CASE WHEN score >= 4 THEN 'positive' WHEN score = 3 THEN 'neutral' WHEN score <= 2 THEN 'negative' END AS voice
    FROM flagged WHERE content IS NOT NULL) WHERE voice IS NOT NULL"""

_one.update({
    "validated_annotations": f"""SELECT k AS comment_id, (k % 13 <> 3)::INT AS is_usable,
        CASE WHEN k % 13 IN (3, 5) THEN 'neutral' ELSE list_extract(['positive', 'neutral', 'negative'], (k % 3 + 1)::INT) END AS polarity,
        CASE k % 13 WHEN 3 THEN NULL WHEN 6 THEN 5 WHEN 7 THEN 4 ELSE (k % 5 + 1)::INT END AS intensity, (k % 13 NOT IN (3, 5))::INT AS is_valid,
        CASE k % 13 WHEN 3 THEN '' WHEN 10 THEN {text(','.join(R.aspects[:5]))} WHEN 11 THEN '' ELSE {_own} END AS accepted,
        coalesce(array_to_string({_reasons}, ','), '') AS reasons,
        CASE WHEN k % 13 <> 3 THEN md5('风景,' || trim(substr(t, 1, 4), {WS}) || ',很长的关键词超过十个') END AS keywords_md5,
        CASE WHEN k % 13 <> 3 THEN md5(substr(trim(substr(t, 1, 50), {WS}), 1, 40)) END AS summary_md5 FROM {_bent}""",
    "dropped_aspects": f"SELECT reason, count(*) AS n FROM (SELECT unnest({_reasons}) AS reason FROM {_bent}) GROUP BY reason",
    "review_voices": f"""SELECT v.spot_name, voice, rank_no, comment_id, coalesce(topics, '') AS topics
        FROM ({_voices}) v LEFT JOIN (SELECT comment_id, array_to_string(list_sort(list(DISTINCT aspect_name))[1:3], ',') AS topics
          FROM aspects GROUP BY comment_id) a USING (comment_id) WHERE rank_no <= 5""",
    "usable_voices": f"SELECT spot_name, voice, rank_no, comment_id FROM ("
        + _voices.replace("content IS NOT NULL", "content IS NOT NULL AND is_low_info = 0 AND is_dup_content = 0") + ") WHERE rank_no <= 3",
    "validated_comparisons": """SELECT o_orderkey AS pair_id, (o_orderkey % 5 <> 0)::INT AS is_usable, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END AS differences,
        2 AS reasons, CASE o_orderkey % 4 WHEN 1 THEN '更值得' WHEN 2 THEN '不如,首选' ELSE '' END AS verdict_words FROM orders""",
    "comparison_numbers": """SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0
        THEN format('{:,}', floor(o_totalprice)::BIGINT) ELSE '' END AS unmatched FROM orders""",
    "validated_answers": """SELECT k AS question_id, length(CASE k % 7 WHEN 0 THEN '共有 ' || n || ' 条评论' WHEN 1 THEN '共有 ' || (n * 3 + 11) || ' 条评论'
          WHEN 2 THEN '好评率为 56.5%，以 4-5 星为主' WHEN 3 THEN '评论量 ' || format('{:,}', n) || ' ，另有 2 处说明'
          WHEN 4 THEN '可以考虑订票与酒店 （本系统只基于评论数据的分析结果作答，不提供路线规划、票务预订、天气等实时信息。）'
          WHEN 5 THEN '多为 3~4 星，没有其他数字' ELSE repeat('很', 600) END)::INT AS answer_length,
        CASE WHEN k % 7 = 4 THEN '订票,酒店' ELSE '' END AS boundary_words, (k % 7 = 1)::INT AS need_review
        FROM (SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS n FROM orders)""",
    "mention_candidates": """SELECT question_id, token, max((token = spot_name)::INT) AS is_whole FROM (
        SELECT question_id, spot_name, CASE WHEN contains(t, spot_name) THEN spot_name WHEN length(spot_name) = 5 AND contains(t, substr(spot_name, 1, 4))
          THEN substr(spot_name, 1, 4) WHEN contains(t, substr(spot_name, 1, 3)) THEN substr(spot_name, 1, 3) END AS token
        FROM asked CROSS JOIN (SELECT spot_name FROM spots)) WHERE token IS NOT NULL GROUP BY question_id, token""",
    "ranking_items": """SELECT (rn - 1)::INT AS item_no, '{"排名": ' || rn || ', "景点": "' || spot_name || '", "评论量": ' || review_count || ', "平均评分": '
        || avg_score || '}' AS item FROM (SELECT *, row_number() OVER (ORDER BY review_count DESC, spot_name) AS rn FROM stat WHERE review_count >= 10) WHERE rn <= 20""",
    "token_report": f"""SELECT count(*) AS rows, sum(len(words))::BIGINT AS token_count, {half_up('sum(len(words))', 'count(*)', 1)} AS mean_tokens,
        0::BIGINT AS leaked_stop_words FROM {_terms}""",
    "top_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest(words) AS term FROM {_terms}) GROUP BY term ORDER BY n DESC, term LIMIT 20",
    "report_view": """SELECT s.spot_name, s.review_count, (r.spot_name IS NOT NULL AND s.review_count >= 20)::INT AS available,
        CASE WHEN s.review_count < 20 THEN 'REVIEW_COUNT_BELOW_THRESHOLD' WHEN r.spot_name IS NULL THEN 'REPORT_NOT_GENERATED' END AS reason,
        CASE WHEN available = 1 THEN r.summary END AS summary, CASE WHEN available = 1 THEN s.source_scope || ',advantages' END AS advantages,
        CASE WHEN available = 1 THEN s.source_scope || ',issues' END AS issues, CASE WHEN available = 1 THEN s.source_scope || ',visitor_focus' END AS visitor_focus,
        CASE WHEN available = 1 THEN need_review END AS need_review, CASE WHEN available = 1 THEN 'fact_package' END AS basis_source,
        CASE WHEN available = 1 THEN 'v1' END AS basis_version, CASE WHEN available = 1 THEN t.review_count END AS basis_review_count,
        CASE WHEN available = 1 THEN avg_score END AS basis_avg_score, CASE WHEN available = 1 THEN positive_rate END AS basis_positive_rate,
        CASE WHEN available = 1 THEN negative_rate END AS basis_negative_rate, CASE WHEN available = 1 THEN top END AS top_aspects
        FROM spots s JOIN stat t USING (spot_name) LEFT JOIN reports r USING (spot_name)
        JOIN (SELECT spot_name, array_to_string(list(aspect_name ORDER BY sample_size DESC, aspect_name)[1:5], ',') AS top FROM aspect_stat GROUP BY spot_name) a USING (spot_name)""",
})

_blocking = texts(quality.BLOCKING)
_one.update({
    "hash_sample": f"SELECT comment_id FROM clean WHERE ('0x' || substr(md5('{R.seed}:' || comment_id), 1, 8))::BIGINT % 1000000 < 200000",
    "table_fingerprint": """SELECT count(*) AS row_count, sum(('0x' || substr(md5(concat_ws('|', comment_id, spot_name, score, score_desc, content, content_length,
        publish_date, publish_year, publish_month, ip_location, ip_is_unknown, ip_province, user_nick, like_count, image_count, image_urls, is_low_info)), 1, 8))::BIGINT)
        ::DECIMAL(38, 0) AS checksum FROM clean""",
    "readiness": f"""SELECT CASE WHEN issues = '' THEN 'READY' ELSE 'BLOCKED' END AS status, issues, warnings FROM (
        SELECT coalesce(string_agg(check_name, ',' ORDER BY check_name) FILTER (list_contains({_blocking}, check_name)), '') AS issues,
          coalesce(string_agg(check_name, ',' ORDER BY check_name) FILTER (list_contains({texts(quality.WARNING)}, check_name)), '') AS warnings
        FROM ({_one['integrity_checks']} UNION ALL SELECT 'open_failures', count(*) FROM events WHERE event_type = 'error' AND NOT value > 10) WHERE actual > 0)""",
})

_bayes = f"""
, feat AS (SELECT comment_id, words FROM {_terms}),
tf AS (SELECT comment_id, term, count(*) AS n FROM (SELECT comment_id, unnest(words) AS term FROM feat) GROUP BY 1, 2),
vocab AS (SELECT term, ln(((SELECT count(*) FROM feat) + 1) / (count(*) + 1)) AS idf FROM tf GROUP BY term HAVING count(*) >= 2),
lab AS (SELECT comment_id, CASE WHEN score >= 4 THEN 2 WHEN score = 3 THEN 1 ELSE 0 END AS c,
  ('0x' || substr(md5('{R.seed}:' || comment_id), 1, 8))::BIGINT % 100 < 80 AS training FROM feat JOIN clean USING (comment_id) WHERE score IS NOT NULL),
cls AS (SELECT c, count(*) AS docs FROM lab WHERE training GROUP BY c),
sums AS (SELECT c, term, sum(n * idf) AS s FROM tf JOIN vocab USING (term) JOIN lab USING (comment_id) WHERE training GROUP BY 1, 2),
theta AS (
  SELECT cls.c, vocab.term, idf, ln(coalesce(s, 0) + 1) - ln((SELECT coalesce(sum(s), 0) FROM sums x WHERE x.c = cls.c) + (SELECT count(*) FROM vocab)) AS w
  FROM cls CROSS JOIN vocab LEFT JOIN sums ON sums.c = cls.c AND sums.term = vocab.term),
pred AS (
  SELECT comment_id, arg_max(c, (p, -c))::DOUBLE AS prediction FROM (
    SELECT feat.comment_id, cls.c, coalesce(sum(n * idf * w), 0) + ln(any_value(docs) + 1)
      - ln((SELECT sum(docs) FROM cls) + (SELECT count(*) FROM cls)) AS p
    FROM feat CROSS JOIN cls LEFT JOIN (SELECT comment_id, c, n, idf, w FROM tf JOIN theta USING (term)) x
      ON x.comment_id = feat.comment_id AND x.c = cls.c GROUP BY feat.comment_id, cls.c) GROUP BY comment_id),
conf AS (SELECT c::DOUBLE AS label, prediction, count(*) AS n FROM lab JOIN pred USING (comment_id) WHERE NOT training GROUP BY 1, 2)
"""
_one.update({
    "tfidf_rows": _bayes + "SELECT comment_id, count(*) AS terms, round(sum(n * idf), 3) AS weight FROM tf JOIN vocab USING (term) WHERE idf > 0 GROUP BY comment_id",
    "baseline_confusion": _bayes + "SELECT label, prediction, n FROM conf",
    "baseline_predictions": _bayes + """SELECT comment_id, spot_name, 'mllib' AS method,
      CASE prediction WHEN 2 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS polarity FROM pred JOIN clean USING (comment_id)""",
    "baseline_metrics": _bayes + f"""SELECT round(sum(tp) / sum(t), 6) AS accuracy, round(sum(t * f) / sum(t), 6) AS f1,
      round(sum(t * p) / sum(t), 6) AS "weightedPrecision", round(sum(t * r) / sum(t), 6) AS "weightedRecall",
      (SELECT count(*) FROM lab WHERE training) AS train_rows, {R.seed} AS seed, 'score>=4 positive, 3 neutral, else negative' AS label_rule
      FROM (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM (
        SELECT l, tp, t, CASE WHEN pn > 0 THEN tp / pn ELSE 0 END AS p, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS r FROM (
          SELECT l, (SELECT coalesce(sum(n), 0) FROM conf WHERE label = l AND prediction = l) AS tp,
            (SELECT coalesce(sum(n), 0) FROM conf WHERE label = l) AS t, (SELECT coalesce(sum(n), 0) FROM conf WHERE prediction = l) AS pn
          FROM (SELECT unnest([0.0, 1.0, 2.0]) AS l))))""",
})


def _segmented(source: str, key: str, column: str) -> str:
    """WITH items for the words, the segmented runs and the tokens of a table's texts."""
    low = f"lower(coalesce({column}, ''))"
    entropy = "ln(sum(n)) - sum(n * ln(n)) / sum(n)"
    return f""", seg_runs AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all({low}, '\\p{{L}}+')) AS run FROM {source}) GROUP BY run),
place AS (SELECT run, n, p, l, substr(run, p, l) AS gram, CASE WHEN p > 1 THEN substr(run, p - 1, 1) ELSE '' END AS pre,
    substr(run, p + l, 1) AS post FROM seg_runs, unnest(range(1, 5)) a(l), unnest(range(1, length(run) - l + 2)) b(p)),
gram AS (SELECT gram, sum(n)::BIGINT AS n FROM place GROUP BY gram),
chars AS (SELECT sum(n)::BIGINT AS chars FROM gram WHERE length(gram) = 1),
held AS (
  SELECT g.gram, min(ln(g.n * chars / (h.n * t.n))) AS cohesion FROM gram g, unnest(range(1, length(g.gram))) c(k), chars, gram h, gram t
  WHERE g.n >= 5 AND h.gram = substr(g.gram, 1, k) AND t.gram = substr(g.gram, k + 1) GROUP BY g.gram),
pre AS (SELECT gram, {entropy} AS e FROM (SELECT gram, pre, sum(n) AS n FROM place GROUP BY ALL) GROUP BY gram),
post AS (SELECT gram, {entropy} AS e FROM (SELECT gram, post, sum(n) AS n FROM place GROUP BY ALL) GROUP BY gram),
chosen AS (
  SELECT gram, n FROM gram WHERE length(gram) = 1 UNION ALL
  SELECT gram, n FROM gram JOIN held USING (gram) JOIN pre USING (gram) JOIN post USING (gram)
  WHERE cohesion >= 1.0 AND pre.e >= 0.8 AND post.e >= 0.8),
seg_words AS (SELECT gram AS word, n, round(ln((SELECT sum(n) FROM chosen) / n) * 1000000)::BIGINT AS cost FROM chosen),
ends AS (
  SELECT run, p + l - 1 AS e, list(struct_pack(l := l, cost := cost) ORDER BY l) AS ways
  FROM place JOIN seg_words ON word = gram GROUP BY run, e),
lattice AS (SELECT run, list(ways ORDER BY e) AS ends FROM ends GROUP BY run),
best AS (
  SELECT run, list_reduce(range(1, length(run) + 1), lambda path, i: list_append(path, list_min(list_transform(ends[i],
      lambda w: struct_pack(cost := path[i - w.l + 1].cost + w.cost, back := -w.l)))),
    [struct_pack(cost := 0::BIGINT, back := 0::BIGINT)]) AS path FROM lattice),
seg AS (
  SELECT run, list_reduce(range(length(run), 0, -1), lambda s, k: CASE WHEN k = s.at THEN
      struct_pack(at := k + path[k + 1].back, words := list_concat([substr(run, k + path[k + 1].back + 1, -path[k + 1].back)], s.words))
      ELSE s END, struct_pack(at := length(run), words := []::VARCHAR[])).words AS words FROM best),
item AS (
  SELECT {key}, i, m[i] AS run FROM (SELECT {key}, regexp_extract_all({low}, '\\p{{L}}+|\\p{{N}}+') AS m FROM {source}), unnest(range(1, len(m) + 1)) t(i)),
seg_tokens AS (
  SELECT s.{key}, coalesce(flatten(list(coalesce(words, [item.run]) ORDER BY i) FILTER (i IS NOT NULL)), []) AS tokens
  FROM {source} s LEFT JOIN item USING ({key}) LEFT JOIN seg ON seg.run = item.run GROUP BY s.{key})
"""


_seg_features = _segmented("flagged", "comment_id", "content") + """, seg_features AS (
  SELECT comment_id, list_filter(tokens, lambda w: w NOT IN ('la', 'le')) AS words FROM (
    SELECT comment_id, list_filter(tokens, lambda w: length(w) >= 2) AS tokens FROM seg_tokens JOIN flagged USING (comment_id)
    WHERE coalesce(content, '') <> '' AND is_low_info = 0 AND is_dup_content = 0) WHERE len(tokens) > 0)"""

def _csv(column: str) -> str:
    """A field as CSV writes it: quoted if it holds a comma, a quote or a line break."""
    return (f"CASE WHEN regexp_matches({column}, '[,\"\\r\\n]') THEN '\"' || replace({column}, '\"', '\"\"') || '\"' "
            f"ELSE coalesce({column}, '') END")


_csv_line = " || ',' || ".join(_csv(f"f.{c}::VARCHAR" if c not in DESCRIPTIVE_COLUMNS else f"s.{c}::VARCHAR") for c in (
    *[n for _, n in SOURCE_HEADER], *[n for n, _ in DERIVED_COLUMNS]))
_csv_header = ",".join(CLEANED_CSV_SCHEMA.fieldNames())

_one |= {
    "isolated_annotator_failures": """SELECT comment_id, CASE WHEN bad THEN 'ValueError' END AS error_kind,
      CASE WHEN NOT bad THEN length(coalesce(content, '')) END AS prompt_tokens
      FROM (SELECT *, upper(coalesce(content, '')) = coalesce(content, '') AS bad FROM clean)""",
    "exact_csv_lines": f"""SELECT false AS is_header, sha256({_csv_line}) AS line_sha256 FROM flagged f JOIN spots s USING (spot_name)
      UNION ALL SELECT true, sha256('{_csv_header}')""",
    "csv_round_trip": """SELECT comment_id, spot_name, score, md5(content) AS content_md5, publish_date, like_count, address, phone,
      content_length, ip_province, is_low_info, is_dup_content, dup_group_id FROM flagged JOIN spots USING (spot_name)""",
    "header_contract": f"""SELECT 3 AS columns, 0 AS position, {text(CLEANED_CSV_SCHEMA.fieldNames()[2])} AS found,
      {text(CLEANED_CSV_SCHEMA.fieldNames()[0])} AS wanted, 1::BIGINT AS files FROM (SELECT count(*) FROM clean)""",
    "precedence_union": """SELECT comment_id, spot_name, CASE WHEN is_dup_content = 1 THEN 'duplicate' WHEN is_low_info = 1 THEN 'short'
      ELSE 'rated' END AS pool FROM flagged WHERE is_dup_content = 1 OR is_low_info = 1 OR score IS NOT NULL""",
    "incremental_spot_statistics": "SELECT * FROM stat",
    "incremental_time_statistics": _one["time_statistics"],
    "incremental_origin_statistics": "SELECT * FROM stat_ip",
    "stored_model_predictions": _one["baseline_predictions"],
    "observed_cleaning_steps": _one["cleaning_steps"],
    "exact_sample": f"SELECT comment_id, spot_name FROM clean ORDER BY md5('{R.seed}:' || comment_id), comment_id LIMIT 137",
    "exact_line_sample": f"""SELECT l_orderkey, l_linenumber, l_orderkey || '-' || l_linenumber AS line FROM lineitem
      ORDER BY md5('{R.seed}:' || l_orderkey || '-' || l_linenumber), line LIMIT 20000""",
    "numbered_terms": f"""SELECT *, row_number() OVER (ORDER BY n DESC, term) - 1 AS term_id FROM (
      SELECT term, count(*) AS df, sum(n)::BIGINT AS n FROM (SELECT comment_id, term, count(*) AS n FROM (
        SELECT comment_id, unnest(words) AS term FROM {_terms}) GROUP BY ALL) GROUP BY term HAVING count(*) >= {R.min_df})""",
    "numbered_reviews": """SELECT comment_id, spot_no, row_number() OVER (ORDER BY spot_no, publish_date NULLS FIRST, comment_id) AS review_no
      FROM clean JOIN (SELECT spot_name, row_number() OVER (ORDER BY count(*) DESC, spot_name) AS spot_no FROM clean GROUP BY spot_name)
      USING (spot_name)""",
    "segment_words": _segmented("documents", "doc_id", "text") + "SELECT word, n, cost FROM seg_words",
    "segmented_tokens": _segmented("documents", "doc_id", "text")
                        + "SELECT doc_id, len(tokens)::BIGINT AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM seg_tokens",
    "segmented_token_report": _seg_features + "SELECT count(*) AS rows, sum(len(words))::BIGINT AS token_count, "
                              "round(sum(len(words)) / count(*), 1) AS mean_tokens, 0::BIGINT AS leaked_stop_words FROM seg_features",
    "segmented_top_terms": _seg_features + "SELECT term, count(*) AS n FROM (SELECT unnest(words) AS term FROM seg_features) "
                                           "GROUP BY term ORDER BY n DESC, term LIMIT 20",
}


_C = R.cost
_share = _C.input_share * _C.price_input + _C.output_share * _C.price_output
_report_price = (_C.report_input_tokens * _C.price_input + _C.report_output_tokens * _C.price_output) / 1_000_000
_edges = (20, 40, 60, 80, 100, 150, 200, 300, 500, 1000)
_class = "CASE " + " ".join(f"WHEN content_length <= {e} THEN {i}" for i, e in enumerate(_edges)) + f" ELSE {len(_edges)} END"


def _measured(no: int, label: str, value: str) -> str:
    return f"""SELECT 0 AS block_no, {no} AS item_no, '{{"指标": "{label}", "值": ' || {value} || '}}' AS item"""


_one |= {
    "metric_items": f"""
      {_measured(0, "评论总数", "count(*)")} FROM flagged
      UNION ALL {_measured(1, "景点总数", "count(*)")} FROM spots
      UNION ALL {_measured(2, "有评分评论数", "count(score)")} FROM flagged
      UNION ALL {_measured(3, "低信息量评论数", "count(*) FILTER (is_low_info = 1)")} FROM flagged
      UNION ALL {_measured(4, "重复正文评论数", "count(*) FILTER (is_dup_content = 1)")} FROM flagged
      UNION ALL SELECT 1, 5 - score, '{{"星级": "' || score || ' 星", "条数": ' || n || ', "占比": ' || {half_up('n', 'total')} || '}}' FROM (
        SELECT score, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM clean WHERE score IS NOT NULL GROUP BY score)
      UNION ALL SELECT 2, 0, '{{"指标": "有效 IP 样本量", "值": ' || coalesce(max(sample_size), 0) || '}}' FROM stat_ip WHERE scope_type = 'global'""",
    "cost_projection": f"""
      SELECT comment_calls, round(w, 1) AS weighted_tokens, max_body_chars, longer_than_sample, report_calls, low AS comment_cost_min,
        high AS comment_cost_max, usual AS comment_cost_conservative, report_cost, comment_calls + report_calls AS total_calls,
        round(low + report_cost, 2) AS total_cost_min, round(high + report_cost, 2) AS total_cost_max, round(usual + report_cost, 2) AS total_cost_conservative
      FROM (SELECT *, round(comment_calls * {_C.measured_min} * {_share / 1e6!r}, 2) AS low, round(comment_calls * {_C.observed_max} * {_share / 1e6!r}, 2) AS high,
          round(comment_calls * w * {_share / 1e6!r}, 2) AS usual, round(report_calls * {_report_price!r}, 2) AS report_cost
        FROM (SELECT sum(n)::BIGINT AS comment_calls, sum(n * tokens) / sum(n) AS w, max(longest) AS max_body_chars, sum(longer)::BIGINT AS longer_than_sample
          FROM (SELECT count(*) AS n, max(content_length) AS longest, count(*) FILTER (content_length > {_C.sample_max_chars}) AS longer,
              {_C.fixed_prompt_tokens} + round_even(floor({half_up('sum(content_length)', 'count(*)', 1)}) * {_C.tokens_per_char!r}::DOUBLE, 0) + {_C.output_tokens} AS tokens
            FROM layered WHERE layer = 'call' GROUP BY {_class})),
          (SELECT count(*) AS report_calls FROM spots ANTI JOIN reports USING (spot_name) WHERE has_full_evaluation = 1))""",
    "linked_entities": """
      SELECT question_id, spot_name, row_number() OVER (PARTITION BY question_id ORDER BY p, i)::INT AS mention_no FROM (
        SELECT question_id, spot_name, min(i) AS i, CASE WHEN contains(any_value(t), spot_name) THEN instr(any_value(t), spot_name)
            WHEN contains(any_value(t), substr(spot_name, 1, 3)) THEN instr(any_value(t), substr(spot_name, 1, 3)) ELSE 1000000 END AS p
        FROM (SELECT question_id, t, i, kept[i].spot_name AS spot_name FROM (
          SELECT question_id, t, list_reduce(c, lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: x.s < k.e AND k.s < x.e)) > 0
              OR len(list_distinct(list_transform(kept, lambda k: k.spot_name))) >= 5 THEN kept ELSE list_append(kept, x) END,
            list_filter(c, lambda x: false)) AS kept
          FROM (SELECT question_id, t, list_sort(list(struct_pack(o1 := part, o2 := -length(token), o3 := -n, s := instr(t, token),
                e := instr(t, token) + length(token), token := token, spot_name := name))) AS c
            FROM (SELECT question_id, t, token, (arg_min(spot_name, (token <> spot_name, -review_count, spot_name))) AS name,
                (min(token <> spot_name))::INT AS part, arg_min(review_count, (token <> spot_name, -review_count, spot_name)) AS n
              FROM (SELECT question_id, t, spot_name, review_count, CASE WHEN contains(t, spot_name) THEN spot_name
                    WHEN length(spot_name) = 5 AND contains(t, substr(spot_name, 1, 4)) THEN substr(spot_name, 1, 4)
                    WHEN contains(t, substr(spot_name, 1, 3)) THEN substr(spot_name, 1, 3) END AS token FROM asked CROSS JOIN spots)
              WHERE token IS NOT NULL GROUP BY question_id, t, token)
            GROUP BY question_id, t)), unnest(range(1, len(kept) + 1)) u(i))
        GROUP BY question_id, spot_name)""",
}


def all_oracles() -> dict[str, str]:
    return {name: f"{PRELUDE}\n{body}" for name, body in _one.items()}
