"""The pipeline, stage by stage, against plain Python on what each stage was given."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
from llm_rows import rows
from test_llm_corpus import blank_words, classes, decontaminated, targets_of


def copies(data):
    """Copies of each document: its source's stream in digest order, repeated up to the rounded target."""
    sizes, streams = Counter(), defaultdict(list)
    for row in data:
        sizes[row[3]] += len(blank_words(row[1]))
        streams[row[3]].append(row)
    targets, out = targets_of(sizes), Counter()
    for source, docs in streams.items():
        def order(row):
            parts = ["5", *([source] if source is not None else []), *([str(row[0])] if row[0] is not None else []), str(len(blank_words(row[1])))]
            return hashlib.md5(":".join(parts).encode()).hexdigest()

        first, limit = 0, int(targets[source] + 0.5)
        for row in sorted(docs, key=order):
            n = len(blank_words(row[1]))
            taken = sum(max(0, min(n, limit - e * sizes[source] - first)) for e in range(3))
            if n:
                out[row[0]] += int(taken / n + 0.5)
            first += n
    return +out


def test_stages(spark, tmp_path):
    data = [r for r in rows(seed=3)]
    folder = str(tmp_path)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(1, " ".join(data[64][1].split()[20:40])), (2, " ".join(data[86 + 3][1].split()[:15]) if data[89][1] else "x")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, before = spark.read.parquet(f"{folder}/documents.parquet"), data
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        after = [tuple(r) for r in docs.collect()]
        if name == "quality rules":
            assert after and all(len(blank_words(r[1])) >= 50 for r in after)
        elif name == "near-dedup":
            assert len(after) == classes(before)[1] and Counter(after) <= Counter(before)
        elif name == "decontaminate":
            clean = Counter({key: n for (key, _, hit, _), n in decontaminated(items, before).items() if hit == 0})
            assert Counter(r[0] for r in after) == clean and len(after) < len(before)
        elif name == "mix":
            assert Counter(r[0] for r in after) == copies(before)
        else:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "virtual_slot"]
            assert Counter(r[:5] for r in after) == Counter(before) and all(0 <= r[5] < 8 for r in after)
        if name != "shard":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            before = after


def test_run_of_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
