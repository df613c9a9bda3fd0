"""Business rules and fixed word lists, all of them parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

POLARITIES = ("positive", "neutral", "negative")

# --- fixed values: the lists and numbers below are part of the result definitions ---------------------

DOMESTIC_REGIONS = (
    "北京", "天津", "河北", "山西", "内蒙古", "辽宁", "吉林", "黑龙江", "上海", "江苏",
    "浙江", "安徽", "福建", "江西", "山东", "河南", "湖北", "湖南", "广东", "广西",
    "海南", "重庆", "四川", "贵州", "云南", "西藏", "陕西", "甘肃", "青海", "宁夏", "新疆",
)

PHONE_RESIDUE = ("全部", "收起", "展开", "查看更多", "更多")

SCOPE_LABELS = {"西藏": "tibet", "进藏沿线": "route"}

ASPECTS = (
    "风景", "交通", "门票", "服务", "设施", "住宿餐饮", "高原反应", "人流拥挤", "性价比", "其他",
)

POSITIVE_WORDS = (
    "值得", "推荐", "很美", "漂亮", "震撼", "壮观", "满意", "喜欢", "不错", "好玩", "舒服", "惊艳", "出片",
)
NEGATIVE_WORDS = (
    "失望", "坑", "贵", "差", "脏", "乱", "挤", "难受", "后悔", "不值", "骗", "垃圾", "高反", "缺氧", "排队",
)

VERDICT_WORDS = (
    "更好", "更值得", "更胜一筹", "优于", "强于", "不如", "推荐去", "首选", "建议选择",
    "哪个好", "胜过", "碾压",
)

BOUNDARY_WORDS = ("路线", "行程", "门票预订", "订票", "天气", "酒店", "机票", "包车", "自驾")

OUT_OF_SCOPE_WORDS = (
    "路线", "行程", "攻略", "几天", "日游", "自驾", "包车", "租车",
    "天气", "气温", "下雨", "下雪",
    "门票预订", "订票", "买票", "预订", "订酒店", "酒店", "住宿推荐", "民宿",
    "机票", "火车票", "航班", "签证", "护照",
    "多少钱一晚", "预算", "推荐去", "帮我规划", "带我去",
)

# Checked in this order: the first list with a hit decides.
QUESTION_KEYWORDS = (
    ("SPOT_COMPARISON", ("对比", "比较", "哪个好", "哪个更", "和", "与", "差别", "差异", "比起来")),
    ("RANKING", ("排行", "排名", "前十", "top", "TOP", "最多", "最高", "最火", "榜")),
    ("VISITOR_FOCUS", ("关注", "在意", "关心", "看重", "最常提", "提到最多", "吐槽", "喜欢什么")),
    ("SENTIMENT_EXPLAIN", ("为什么", "差评", "好评", "负面", "不满", "情感", "情绪", "口碑")),
    ("DATA_METRIC", ("多少", "几条", "条评论", "占比", "比例", "统计", "样本", "分布", "五星", "三星")),
    ("SPOT_EVALUATION", ("怎么样", "值得", "好不好", "如何", "评价", "体验", "推荐吗")),
)

# Python's str.isspace() characters; used by strip / whitespace removal.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


@dataclass(frozen=True)
class CostModel:
    """Token and price assumptions of the cost projection."""

    fixed_prompt_tokens: int = 300
    tokens_per_char: float = 0.7
    output_tokens: int = 300
    measured_tokens: int = 484
    measured_min: int = 335
    observed_max: int = 2695
    input_share: float = 0.6955
    output_share: float = 0.3045
    price_input: float = 2.0
    price_output: float = 8.0
    report_input_tokens: int = 3600
    report_output_tokens: int = 700
    sample_max_chars: int = 126

# --- end of fixed values ------------------------------------------------------------------


@dataclass(frozen=True)
class Rules:
    """Thresholds (BR-01 … BR-06), lists and tuning values shared by the operators."""

    origin_cutoff: str = "2022-08-01"          # BR-01
    full_evaluation_min: int = 100             # BR-02 / BR-03
    aspect_min_sample: int = 10                # BR-04
    low_info_max_chars: int = 10               # BR-05
    unknown_region: str = "未知"
    phone_max_chars: int = 64
    domestic_regions: tuple[str, ...] = DOMESTIC_REGIONS
    aspects: tuple[str, ...] = ASPECTS
    positive_words: tuple[str, ...] = POSITIVE_WORDS
    negative_words: tuple[str, ...] = NEGATIVE_WORDS
    aspect_words: tuple[tuple[str, tuple[str, ...]], ...] = tuple((a, (a,)) for a in ASPECTS)
    ranking_min_reviews: int = 10

    annotated_method: str = "annotated"        # label of the text-reading method
    baseline_method: str = "mllib"             # label of the star-trained baseline
    stat_version: str = "v1"
    package_version: str = "v1"

    max_aspects: int = 5
    evidence_chars: int = 30
    keyword_chars: int = 10
    max_keywords: int = 5
    summary_chars: int = 40

    representative_max: int = 5
    representative_chars: tuple[int, int] = (30, 200)
    excerpt_chars: int = 300
    intro_chars: int = 200

    seed: int = 42
    topics: int = 5
    topic_iterations: int = 20
    topic_words: int = 10
    min_df: float = 2.0

    hot_key_rows: int = 1_000_000              # a key with more fact rows is split over tasks
    cost: CostModel = field(default_factory=CostModel)


DEFAULT_RULES = Rules()


def caliber_notes(rules: Rules = DEFAULT_RULES) -> dict[str, str]:
    """Scope notes that travel with affected answers (BR-10, Q12)."""
    return {
        "origin": f"Origin regions count only reviews published on or after {rules.origin_cutoff}; "
                  "unknown regions are left out.",
        "trend": "Trends follow the publish date of reviews; they are not visitor counts.",
        "threshold": f"A full evaluation needs at least {rules.full_evaluation_min} reviews; "
                     "below that only basic statistics are given.",
        "aspect": f"An aspect needs at least {rules.aspect_min_sample} samples before any share is given.",
        "sentiment": "Star-based rates and text-based polarity are two separate results and must not be mixed.",
        "low_info": f"Texts of up to {rules.low_info_max_chars} characters count in statistics "
                    "but are labelled by rule, not by the annotator.",
    }
