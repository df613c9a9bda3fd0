"""Reviews, entities, questions and logs derived from the bench tables.

The derived rows deliberately carry what the cleaning rules have to deal with: padded names,
missing scores, unknown and foreign origins, phone fields with page residue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.rules import ASPECTS, Rules

# Thresholds that split the bench tables (see SURVEY 7.2); everything else stays at its default.
BENCH_RULES = Rules(
    origin_cutoff="1998-06-01",
    full_evaluation_min=20,
    low_info_max_chars=40,
    domestic_regions=tuple(f"NATION_{i}" for i in range(15)),
    positive_words=("with", "tion", "eau", "heit", "ción"),
    negative_words=("whst", "oth", "oui", "ung", "rra"),
    aspect_words=tuple(zip(ASPECTS, (
        ("eron", "eaux"), ("whin",), ("stea", "lich"), ("orha", "iere"), ("ndth",), ("ciado", "edwh"), ("nntt",), ("thles",),
        ("eueo", "heon"), ("inge",)))),
)

SCORE_LABELS = ("不佳", "一般", "不错", "满意", "超棒")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _score() -> Column:
    q, t, d = F.col("quality"), F.col("toxic"), F.col("doc_id")
    return (
        F.when((q == 1) & (t == 0), F.when(d % 3 == 0, 4).otherwise(5))
        .when((q == 1) & (t == 1), 3)
        .when((q == 0) & (t == 0), 2)
        .when((q == 0) & (t == 1), 1)
    )


def raw_reviews(spark: SparkSession, sf_dir: str, bad_dates: bool = False) -> DataFrame:
    """The 15 source columns, all text, one row per document; with ``bad_dates`` some dates do not exist."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    labels = table(spark, sf_dir, "labels")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"
    )
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey", "c_mktsegment"
    )
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    # Orders meet their customers before the texts: a document without an order has no customer key, and all
    # of these would meet in one task.
    buyers = orders.join(customer, "o_custkey", "left").join(nation, "c_nationkey", "left")
    rows = documents.join(labels, "doc_id", "left").join(buyers, "doc_id", "left")
    d = F.col("doc_id")
    score = _score()
    desc = F.get(F.array(*[F.lit(x) for x in SCORE_LABELS]), score - 1)
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    if bad_dates:
        date = F.when(d % 97 == 5, F.lit("1998-13-45")).otherwise(date)
    origin = F.when(d % 11 == 0, F.lit("未知")).otherwise(F.concat(F.col("n_name"), F.lit("\u3000")))
    address = F.when(d % 4 == 0, F.lit("")).otherwise(
        F.concat(F.lit("No. "), (d % 3).cast("string"), F.lit(" \n"), "source", F.lit("\u3000Road "))
    )
    number = F.substring("source", 4, 10).cast("int")
    long_tail = F.when(number % 7 == 3, F.lit("\r\n" + "8" * 60)).otherwise(F.lit(""))
    phone = F.when(d % 5 == 0, F.lit("全部\n")).otherwise(
        F.concat(F.lit("089-"), F.col("source"), F.lit("\n全部\t收起\n"), long_tail)
    )
    return rows.select(
        F.concat(F.lit("\u3000"), "source", F.lit(" ")).alias("spot_name"),
        d.cast("string").alias("comment_id"),
        F.coalesce(score.cast("string"), F.lit("")).alias("score"),
        F.coalesce(desc, F.lit("")).alias("score_desc"),
        F.col("text").alias("content"),
        date.alias("publish_date"),
        origin.alias("ip_location"),
        F.concat(F.lit(" "), "c_name").alias("user_nick"),
        F.floor(F.col("o_totalprice") / 1000).cast("string").alias("like_count"),
        F.when(d % 3 == 0, F.lit("")).otherwise((d % 3).cast("string")).alias("image_count"),
        F.when(d % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("img/"), d.cast("string"))).alias("image_urls"),
        address.alias("address"),
        F.col("o_orderpriority").alias("open_time"),
        phone.alias("phone"),
        F.concat_ws(" ", "c_mktsegment", "n_name").alias("introduction"),
    )


def spot_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label file stand-in: one (name, label) row per document source."""
    number = F.substring("source", 4, 10).cast("int")
    return (
        table(spark, sf_dir, "documents").select("source").distinct()
        .select(F.col("source").alias("name"),
                F.when(number % 3 == 0, "进藏沿线").otherwise("西藏").alias("label"))
    )


def line_reviews(spark: SparkSession, sf_dir: str, rules: Rules = BENCH_RULES) -> DataFrame:
    """One review per line item: volume for the aggregates.  It has no unique key."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_tax", "l_discount", "l_shipdate", "l_linenumber"
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    date = F.col("l_shipdate").cast("date")
    return (
        items.join(orders, "l_orderkey", "left").join(customer, "o_custkey", "left").join(nation, "c_nationkey", "left")
        .select(
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("spot_name"),
            F.when(F.col("l_tax") != 0.08, (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("int")).alias("score"),
            date.alias("publish_date"),
            F.when(date >= F.lit(rules.origin_cutoff), F.col("n_name")).alias("ip_province"),
            F.col("l_quantity").cast("bigint").alias("like_count"),
            (F.col("l_linenumber") % 3).cast("int").alias("image_count"),
            (F.col("l_discount") == 0.0).cast("int").alias("is_low_info"),
        )
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per order, naming document sources."""
    key = F.col("o_orderkey")
    a = F.concat(F.lit("src"), (key % 20).cast("string"))
    b = F.concat(F.lit("src"), ((key * 7 + 3) % 20).cast("string"))
    texts = (
        F.concat(a, F.lit("怎么样")),
        F.concat(a, F.lit("和"), b, F.lit("哪个好")),
        F.concat(F.lit("游客在"), a, F.lit("关注什么")),
        F.concat(a, F.lit("为什么不满")),
        F.lit("一共有多少条评论"),
        F.lit("评论量前五的排行"),
        F.concat(F.lit("帮我订"), a, F.lit("的酒店")),
        F.lit(" \u3000"),
        F.concat(F.lit("src值得去吗，还是"), b),
        F.concat(F.lit("评论数Top"), (key % 18 + 3).cast("string"), F.lit("排名")),
        F.lit("某个地方怎么样"),
        F.concat(F.lit("介绍一下"), b),
        F.concat(a, F.lit("差别在哪里")),
    )
    text = F.element_at(F.array(*texts), (F.floor(key / 20) % len(texts) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(key.alias("question_id"), text.alias("question"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations table stand-in: one task per event."""
    e = table(spark, sf_dir, "events")
    n = F.get_json_object("props", "$.k").cast("bigint")
    status = F.when(F.col("event_type") == "error", "FAILED").when(n % 5 == 0, "RUNNING").otherwise("SUCCESS")
    return e.select(
        F.col("event_id").alias("task_id"), F.col("event_type").alias("task_type"), status.alias("status"),
        F.col("ts").alias("started_at"), F.col("value").alias("cost_seconds"), n.alias("success_count"),
        F.col("user_id").alias("owner_id"),
    )


def task_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log stand-in: one line per event, belonging to its user's task."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("log_id"), F.col("user_id").alias("task_id"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.col("event_type").alias("stage"), F.col("event_id").cast("string").alias("ref_key"),
        (F.col("value") > 10).cast("int").alias("resolved"), F.col("props").alias("detail_json"),
    )


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotator call stand-in: one call per conversation turn."""
    c = table(spark, sf_dir, "conversations")
    size = F.length("text").cast("bigint")
    return c.select(
        F.col("conv_id").alias("comment_id"), F.col("turn").alias("attempt"),
        F.col("text").alias("raw_text"),
        size.alias("prompt_tokens"), F.floor(size / 2).alias("completion_tokens"),
        (size + F.floor(size / 2)).alias("total_tokens"),
        (F.col("turn") % 4 + 1).cast("int").alias("attempts"),
        F.when(size % 7 == 0, "timeout").when(size % 11 == 0, "server").alias("error_kind"),
    )


def listed_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate-list stand-in: the orders of every customer with several are a group, named by the smallest."""
    groups = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_orderkey").alias("first"), F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    ids = F.concat(F.array_join(F.transform("keys", lambda k: k.cast("string")), "、 "), F.lit("、"))
    return groups.filter(F.size("keys") > 1).select(F.col("first").cast("string").alias("group_id"), ids.alias("ids"))


def annotator_responses(reviews: DataFrame, rules: Rules = BENCH_RULES) -> DataFrame:
    """Stub answers bent in twelve ways, chosen by review id: (comment_id, content, raw_text)."""
    case = F.col("comment_id") % 13
    text = F.coalesce("content", F.lit(""))
    head = F.substring(text, 1, 12)
    polarity = F.element_at(F.array(F.lit("positive"), F.lit("Neutral"), F.lit(" negative ")),
                            (F.col("comment_id") % 3 + 1).cast("int"))
    aspects = [F.lit(a) for a in rules.aspects]
    own = F.element_at(F.array(*aspects), (F.col("comment_id") % 10 + 1).cast("int"))

    def item(name: Column, mood: Column, evidence: Column) -> Column:
        return F.struct(name.alias("aspect"), mood.alias("polarity"), evidence.alias("evidence"))

    mood = F.lit("positive")
    listed = (
        F.when(case == 8, F.array(item(F.lit("位置"), mood, head), item(own, mood, head)))
        .when(case == 9, F.array(item(own, mood, head), item(own, F.lit("negative"), head)))
        .when(case == 10, F.array(*[item(a, mood, head) for a in aspects[:7]]))
        .when(case == 11, F.array(item(own, mood, F.lit("编造的内容"))))
        .when(case == 12, F.array(item(own, mood, F.translate(head, " \n\t", "")), item(aspects[0], F.lit("odd"), head)))
        .otherwise(F.array(item(own, mood, head)))
    )
    fields = F.struct(
        F.when(case == 5, "great").otherwise(polarity).alias("polarity"),
        F.when(case == 6, "9").when(case == 7, "4分").otherwise((F.col("comment_id") % 5 + 1).cast("string")).alias("intensity"),
        listed.alias("aspects"),
        F.array(F.lit("风景"), F.substring(text, 1, 4), F.lit("风景"), F.lit("  "), F.lit("很长的关键词超过十个字的")).alias("keywords"),
        F.concat(F.lit(" "), F.substring(text, 1, 50)).alias("summary"),
    )
    body = F.to_json(fields)
    raw = (
        F.when(case == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(case == 2, F.concat(F.lit("好的，结果如下： "), body, F.lit(" 以上。")))
        .when(case == 3, F.lit("抱歉，无法处理"))
        .when(case == 4, F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(body)
    )
    return reviews.select("comment_id", "content", raw.alias("raw_text"))


def comparison_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison texts, one per order: (pair_id, raw_text, facts)."""
    k, price = F.col("o_orderkey"), F.floor("o_totalprice")
    amount = F.format_number(price, 0)
    note = F.when(k % 4 == 1, "甲更值得去").when(k % 4 == 2, "两者首选甲，乙不如甲").otherwise("样本量不同")
    differences = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("评论量相差 "), amount, F.lit(" 条")),
                F.concat(F.lit("好评率 "), F.format_string("%.2f", F.lit(87.82)), F.lit("%"))))
    body = F.to_json(F.struct(differences.alias("differences"),
                              F.array(F.lit("客群不同"), F.concat(F.lit("约 "), (k % 9).cast("string"), F.lit(" 处差异")))
                              .alias("possible_reasons"), note.alias("reliability_note")))
    facts = F.array(F.when(k % 3 == 0, price * 2).otherwise(price).cast("double"), F.lit(0.8782))
    return table(spark, sf_dir, "orders").select(
        k.alias("pair_id"), body.alias("raw_text"), F.concat(*_joined(differences)).alias("text"), facts.alias("facts"))


def _joined(items: Column) -> list[Column]:
    return [F.array_join(items, " ")]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated answers, one per order, with the numbers they may quote."""
    k, n = F.col("o_orderkey"), F.floor("o_totalprice")
    plain, grouped = n.cast("string"), F.format_number(n, 0)
    case = k % 7
    text = (
        F.when(case == 0, F.concat(F.lit("共有 "), plain, F.lit(" 条评论")))
        .when(case == 1, F.concat(F.lit("共有 "), (n * 3 + 11).cast("string"), F.lit(" 条评论")))
        .when(case == 2, F.lit("好评率为 56.5%，以 4-5 星为主"))
        .when(case == 3, F.concat(F.lit("评论量 "), grouped, F.lit(" ，另有 2 处说明")))
        .when(case == 4, F.lit("可以考虑订票与酒店"))
        .when(case == 5, F.lit("多为 3~4 星，没有其他数字"))
        .otherwise(F.concat(F.lit("评论"), F.repeat(F.lit("很多"), 320)))
    )
    return table(spark, sf_dir, "orders").select(
        k.alias("question_id"), F.concat(F.lit(" "), text).alias("answer"),
        F.array(n.cast("double"), F.lit(0.565)).alias("facts"))


def report_responses(stats: DataFrame) -> DataFrame:
    """Report texts per entity; every third one misquotes its rate, every fourth its count."""
    number = F.substring("spot_name", 2, 12).cast("bigint")
    percent = F.round(F.col("positive_rate") * 100, 2) + F.when(number % 3 == 0, 2.5).otherwise(0.2)
    count = F.col("review_count") + F.when(number % 4 == 0, 40).otherwise(0)
    summary = F.concat(F.lit("共 "), count.cast("string"), F.lit(" 条评论，好评率 "),
                       F.format_string("%.2f", percent), F.lit("%，有 2 个方面较突出。"))
    items = F.array(F.lit("景观体验"), F.lit(" "), F.concat(F.lit("提及"), F.repeat(F.lit("很多"), 30)))
    body = F.to_json(F.struct(
        F.when(number % 11 == 0, F.lit(" ")).otherwise(summary).alias("summary"),
        items.alias("advantages"),
        F.when(number % 5 == 0, F.array(*[F.lit(f"条目{c}") for c in "甲乙丙丁戊己庚"])).otherwise(F.array(F.lit("排队"))).alias("issues"),
        F.array(F.lit("门票"), F.lit("交通")).alias("visitor_focus")))
    return stats.select("spot_name", body.alias("raw_text"))
