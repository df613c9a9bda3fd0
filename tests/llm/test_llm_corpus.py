"""Decontamination, sharding, mixing and near-duplicates against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import decontamination, mixing, near_dedup, sharding

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


# --- decontamination ----------------------------------------------------------------------------------

def benchmark(spark, data):
    long = data[86 + 3][1] if data[86 + 3][1] else data[0][1]
    items = [(1, " ".join(data[0][1].split()[-30:])), (2, "some Text, without!"), (2, "née"), (None, "x1 x2 x3"), (3, None), (4, "..."),
             (5, " ".join(long.split()[100:125])), (6, " ".join(long.split()[100:125]))]
    return items, spark.createDataFrame(items, "item_id bigint, text string")


def decontaminated(items, data):
    windows = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k:k + 10])].add("" if item is None else str(item))
    out = Counter()
    for key, text, *_ in data:
        w, hit, found = alnum_words(text), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k:k + size])]
        out[key, len(w), len(hit), tuple(sorted(found))] += 1
    return out


def test_matches_equal_brute_force_for_one_block_and_many(spark, stored, data):
    items, bench = benchmark(spark, data)
    want = decontaminated(items, data)
    for block_bytes in (1 << 20, 60):
        found = decontamination.contamination(stored, bench, keep=["doc_id"], block_bytes=block_bytes).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found) == want
        assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in found)
        assert any(r.longest >= 20 for r in found)


def test_decontamination_keeps_columns_and_takes_empty_tables(spark, stored, empty, data):
    items, bench = benchmark(spark, data)
    clean = sum(n for (_, _, hit, _), n in decontaminated(items, data).items() if hit == 0)
    clashing = stored.withColumn("n_hit", F.lit("mine")).withColumn("row", F.lit(1))
    left = decontamination.remove_contaminated(clashing, bench)
    assert left.columns == clashing.columns and left.filter("n_hit = 'mine'").count() == clean
    assert decontamination.find_matches(empty, bench).count() == 0
    assert decontamination.find_matches(stored, bench.limit(0)).filter("n_hit > 0 OR size(matches) > 0").count() == 0


# --- sharding -----------------------------------------------------------------------------------------

def test_sizes_checksums_and_gapless_places(stored, data):
    rows = sharding.placed_rows(stored, 4).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (k, size(t), zlib.crc32((t or "").encode())) for k, t, *_ in data)
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())


def test_hot_slot_is_split_and_shards_are_even(spark, tmp_path):
    spark.createDataFrame([(1, "same text of a hot key")] * 3000 + [(i, "t" * 20) for i in range(5000)], "doc_id bigint, text string") \
        .write.parquet(str(tmp_path / "hot"))
    rows = sharding.placed_rows(spark.read.parquet(str(tmp_path / "hot")), 8).groupBy("shard").agg(
        F.sum("size").alias("b"), F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    total = sum(r.b for r in rows)
    assert len(rows) == 8 and all(abs(r.b - total / 8) < 0.01 * total / 8 and r.n == r.d == r.m + 1 for r in rows)


def test_map_versions_move_few_slots(spark, tmp_path):
    sizes = {(s, 0): (1000 + s % 7, 1) for s in range(512)}
    second = sharding.rebalance(sharding.first_map(4, 512), sizes)
    third = sharding.rebalance(second, sizes, shards=5)
    loads = third.loads()
    assert third.version == 3 and max(loads) - min(loads) < 1100
    moved = sum(a.shard != b.shard for a, b in zip(second.entries, third.entries))
    assert moved <= 512 // 5 + 5 and sum(b.shard not in (a.shard, 4) for a, b in zip(second.entries, third.entries)) <= 5
    sharding.save_map(spark, second, str(tmp_path))
    sharding.save_map(spark, third, str(tmp_path))
    assert sharding.load_map(spark, str(tmp_path), 2).entries == second.entries
    assert sharding.load_map(spark, str(tmp_path), 3).entries == third.entries


def test_sharding_edge_tables(stored, empty):
    assert sharding.placed_rows(empty, 8).count() == 0
    out = sharding.assign_shards(stored.withColumn("shard", F.lit("x")), sharding.balanced_map(sharding.with_slots(stored), 3))
    assert out.count() == stored.count() and {r.shard for r in out.select("shard").distinct().collect()} <= {0, 1, 2}


# --- mixing -------------------------------------------------------------------------------------------

def targets_of(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, capped, total = {s: weights[i % 3] for i, s in enumerate(order)}, set(), sum(sizes.values())
    while True:
        rate = (total - sum(3 * sizes[s] for s in capped)) / max(1e-9, sum(weight[s] for s in order if s not in capped))
        more = {s for s in order if s not in capped and rate * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in capped else rate * weight[s] for s in order}
        capped |= more


def test_targets_and_takes(stored, data):
    rows = mixing.document_takes(stored).collect()
    sizes = Counter()
    for _, text, _, source, _ in data:
        sizes[source] += len(blank_words(text))
    want, taken = targets_of(sizes), Counter()
    assert Counter((r.key, r.size) for r in rows) == Counter((k, len(blank_words(t))) for k, t, *_ in data)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.document_takes(stored.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_schedule_prefixes_follow_the_weights(spark):
    targets = spark.createDataFrame([("a", 5000, 5.0, 5000.0), ("b", 5000, 2.0, 2000.0), ("c", 5000, 1.0, 1000.0)],
                                    "source string, source_size bigint, weight double, target double")
    slots = mixing.schedule(targets, bits=9).orderBy("time").collect()
    for prefix in (len(slots) // 4, len(slots) // 2, len(slots)):
        share = Counter(r.source for r in slots[:prefix])
        assert abs(share["a"] / prefix - 5 / 8) < 0.05 and abs(share["b"] / prefix - 2 / 8) < 0.05
    assert sum(r.end - r.begin for r in slots) == 8000
    for s in "abc":
        assert [r["rank"] for r in slots if r.source == s] == list(range(sum(r.source == s for r in slots)))


def test_mixing_edge_tables(spark, stored, empty):
    assert mixing.document_takes(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    no_words = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert {(r.key, r.target, r.taken) for r in mixing.document_takes(no_words).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
    mixed = mixing.mix_documents(stored.withColumn("taken", F.lit(1)).withColumn("rank", F.lit(2)))
    assert mixed.columns == [*stored.columns, "taken", "rank"] and mixed.groupBy("doc_id", "text").count().filter("count > 9").isEmpty()


# --- near-duplicates ----------------------------------------------------------------------------------

def shingles(text):
    w = blank_words((text or "").translate(LOW))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(data, percent=85):
    sets = [shingles(t) for _, t, *_ in data]
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    keys = defaultdict(list)
    for i, row in enumerate(data):
        if row[0] is not None:
            keys[root(i)].append(row[0])
    out = []
    for i, row in enumerate(data):
        smallest = min(keys[root(i)], default=None)
        out.append((row[0], len(sets[i]), smallest, row[0] == smallest))
    return Counter(out), len({root(i) for i in range(len(data))})


def test_components_equal_brute_force(stored, data):
    want, groups = classes(data)
    assert Counter(map(tuple, near_dedup.near_duplicates(stored).collect())) == want
    clashing = stored.withColumn("label", F.lit("l")).withColumn("print", F.lit("p"))
    kept = near_dedup.keep_one_of_each(clashing)
    assert kept.columns == clashing.columns and kept.count() == groups


def test_chain_is_one_component_and_far_texts_are_not(spark, tmp_path):
    base, rows = [f"v{k}" for k in range(400)], []
    for i in range(40):  # each differs a little from the one before, the ends have nothing in common
        words = base[:]
        words[:10 * i] = [f"c{k}" for k in range(10 * i)]
        rows.append((100 - i, " ".join(words)))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "chain"))
    found = near_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "chain")), percent=85).collect()
    want, _ = classes(rows)
    assert Counter(map(tuple, found)) == want and {r.component_id for r in found} == {61}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (102, 101)], "a bigint, b bigint")
    labels = {r.node: r.label for r in near_dedup.components(edges).collect()}
    assert labels == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_no_link_of_a_large_bucket_is_lost_to_its_centres(spark):
    """Forty pairs in one bucket, each near its partner and far from all other members."""
    rng, sets = np.random.default_rng(4), []
    common = rng.integers(1, 2 ** 63, 60, dtype=np.uint64)
    for _ in range(40):
        own = rng.integers(1, 2 ** 63, 40, dtype=np.uint64)
        sets += [np.unique(np.concatenate([common, own])), np.unique(np.concatenate([common, own[:37]]))]
    buckets = spark.createDataFrame([(7, k, len(s)) for k, s in enumerate(sets)], "bucket bigint, node bigint, n bigint")
    sketches = spark.createDataFrame([(k, bytearray(near_dedup.signature(s, 240).astype(np.uint8).tobytes()))
                                      for k, s in enumerate(sets)], "node bigint, sketch binary")
    stored = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "node bigint, set binary")
    found = near_dedup._linked(buckets, sketches, stored, 85).collect()
    assert {r.node: r.label for r in found} == {k: k - k % 2 for k in range(80)}


def test_near_duplicates_of_empty_tables(empty):
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.keep_one_of_each(empty).count() == 0


# --- clashing names -----------------------------------------------------------------------------------

def test_stage_operators_keep_columns_of_their_own_names(spark, data, tmp_path):
    """Columns named like those that the operators add on their way pass through untouched."""
    names = ["__row", "__maybe", "__slot", "__lane", "__size", "__crc", "__hash", "__copy", "__times", "__word", "size", "first", "key"]
    folder = str(tmp_path / "documents")
    rows = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names}).write.parquet(folder)
    docs = spark.read.parquet(folder)
    slotted = sharding.with_slots(docs)
    for out in (near_dedup.keep_one_of_each(docs), mixing.mix_documents(docs),
                sharding.assign_shards(docs, sharding.balanced_map(slotted, 3)).drop("shard", "virtual_slot")):
        assert out.columns == docs.columns and out.count() > 0
        wrong = [~F.col(n).eqNullSafe(F.concat(F.lit(n), F.col("doc_id").cast("string"))) for n in names]
        assert out.filter(F.array_contains(F.array(*wrong), True)).isEmpty()
