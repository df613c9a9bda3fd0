"""Declared schemas of sources and result tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DateType()

# Header of the source CSV -> column name used by the operators (fixed contract, S4).
SOURCE_HEADER = (
    ("景点名称", "spot_name"), ("评论编号", "comment_id"), ("评分", "score"),
    ("评分描述", "score_desc"), ("评论内容", "content"), ("发布时间", "publish_date"),
    ("IP归属地", "ip_location"), ("用户昵称", "user_nick"), ("点赞数", "like_count"),
    ("图片数", "image_count"), ("图片URL", "image_urls"), ("地址", "address"),
    ("开放时间", "open_time"), ("官方电话", "phone"), ("景点介绍", "introduction"),
)
DERIVED_COLUMNS = (
    ("content_length", _I), ("publish_year", _I), ("publish_month", _I), ("ip_province", _S),
    ("ip_is_unknown", _I), ("is_low_info", _I), ("is_dup_content", _I), ("dup_group_id", _L),
)
DESCRIPTIVE_COLUMNS = ("address", "open_time", "phone", "introduction")

RAW_SCHEMA = _struct(*[(header, _S) for header, _ in SOURCE_HEADER])

_CLEAN_TYPES = {"comment_id": _L, "score": _I, "publish_date": _D, "like_count": _L, "image_count": _I}
CLEANED_CSV_SCHEMA = _struct(
    *[(header, _CLEAN_TYPES.get(name, _S)) for header, name in SOURCE_HEADER], *DERIVED_COLUMNS
)

REVIEW_SCHEMA = _struct(
    ("comment_id", _L), ("spot_name", _S), ("score", _I), ("score_desc", _S), ("content", _S),
    ("content_length", _I), ("publish_date", _D), ("publish_year", _I), ("publish_month", _I),
    ("ip_location", _S), ("ip_is_unknown", _I), ("ip_province", _S), ("user_nick", _S),
    ("like_count", _L), ("image_count", _I), ("image_urls", _S),
    ("is_low_info", _I), ("is_dup_content", _I), ("dup_group_id", _L),
)

SENTIMENT_SCHEMA = _struct(
    ("comment_id", _L), ("spot_name", _S), ("method", _S), ("polarity", _S), ("intensity", _I),
    ("is_valid", _I), ("raw_json", _S),
)
ASPECT_SCHEMA = _struct(
    ("comment_id", _L), ("spot_name", _S), ("aspect_name", _S), ("polarity", _S), ("evidence", _S),
    ("method", _S),
)
SEMANTIC_SCHEMA = _struct(
    ("comment_id", _L), ("spot_name", _S), ("keywords", _S), ("summary", _S), ("source", _S),
)
REPORT_SCHEMA = _struct(
    ("spot_name", _S), ("fact_package_version", _S), ("summary", _S), ("advantages_json", _S),
    ("issues_json", _S), ("visitor_focus_json", _S), ("model", _S), ("prompt_version", _S),
    ("need_review", _I), ("token_usage", _L),
)
RESPONSE_SCHEMA = _struct(
    ("comment_id", _L), ("spot_name", _S), ("content", _S), ("raw_text", _S), ("attempt", _I),
    ("prompt_tokens", _L), ("completion_tokens", _L), ("total_tokens", _L),
    ("error_kind", _S), ("error_reason", _S),
)
