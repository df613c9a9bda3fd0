import re

from pyspark.sql import functions as F

from cairn.functions.skew import key_sizes, salted_lookup_join
from cairn.operators.annotation import work_layers
from cairn.sources.star import raw_reviews


def test_facts_are_never_dealt_by_the_bare_key(spark):
    """Rows without a key, and those of a hot one, would all meet in one task."""
    facts = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, F.col("id") % 8).alias("k"))
    lookup = spark.createDataFrame([(0, "a"), (4, "b"), (5, "c")], "k long, name string")
    sizes = key_sizes(facts.filter("k IS NOT NULL"), ["k"])
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {c: spark.conf.get(c) for c in settings}
    for c, v in settings.items():
        spark.conf.set(c, v)
    try:
        joined = salted_lookup_join(facts, lookup, sizes, ["k"], "id", 100)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        by_key = re.findall(r"hashpartitioning\(k#\d+L, \d+\), (\w+)", plan)
        assert len(by_key) <= 2  # the sums of ``sizes``, on either side
        spread = joined.filter("k IS NULL").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in spread) == 3000 and max(r["count"] for r in spread) < 1500
        got = {(r.k, r.name, r["count"]) for r in joined.groupBy("k", "name").count().collect()}
        assert got == {(None, None, 3000), (0, "a", 500), (4, "b", 500)}
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_documents_without_an_order_are_not_dealt_by_their_missing_customer(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = raw_reviews(spark, "/root/testdata/sf0.001")
        lines = rows._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    depth = [len(re.match(r"[ :|+-]*", line)[0]) for line in lines]
    below = []
    for i, line in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\((o_custkey|c_nationkey)#", line):
            end = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
            below.append("\n".join(lines[i:end]))
    assert below and not any("text#" in plan for plan in below)
    got = {r.comment_id: r.user_nick for r in rows.select("comment_id", "user_nick").collect()}
    orders, customer = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("orders", "customer"))
    names = {str(r.o_orderkey): f" {r.c_name}" for r in orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
             .select("o_orderkey", "c_name").collect() if r.c_name is not None}
    assert len(got) == 200 and all(nick == names.get(key) for key, nick in got.items()) and any(got.values())


def _left_sides_of_salted_joins(node):
    children = [node.children().apply(i) for i in range(node.children().size())]
    found = [side for child in children for side in _left_sides_of_salted_joins(child)]
    names = [[a.output().apply(i).name() for i in range(a.output().size())] for a in children]
    if node.nodeName() == "Join" and "__salt" in names[0] and "__salt" in names[1]:
        found.append(names[0])
    return found


def test_layers_alone_move_no_text_through_the_join(spark):
    """Whether a text is empty is told before the representatives are looked up."""
    i = F.col("id")
    reviews = spark.range(8).select(
        i.alias("comment_id"), F.when(i == 7, F.lit(" \n")).when(i != 6, F.concat(F.lit("text "), (i % 3).cast("string"))).alias("content"),
        F.lit(6).alias("content_length"), (i == 5).cast("int").alias("is_low_info"), (i < 4).cast("int").alias("is_dup_content"),
        F.when(i < 4, 0).cast("long").alias("dup_group_id"))
    layered = work_layers(reviews)
    plan = layered.select("comment_id", "layer")._jdf.queryExecution().optimizedPlan()
    sides = _left_sides_of_salted_joins(plan)
    assert sides and all("content" not in side for side in sides)
    assert set(layered.columns) == {*reviews.columns, "representative_id", "layer"}
    got = {r.comment_id: r.layer for r in layered.collect()}
    assert got == {0: "call", 1: "reuse", 2: "reuse", 3: "reuse", 4: "call", 5: "rule", 6: "excluded", 7: "excluded"}
