"""The n-gram Jaccard join against plain Python: groups of near copies, chunks of lists, blocks, odd texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_rows import SCHEMA, prose
from pyspark.sql import functions as F

from cairn.llm import jaccard_join, similar_lists

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset([tuple(w)] if 0 < len(w) < n else (tuple(w[k:k + n]) for k in range(len(w) - n + 1)))


def joined(data, percent=90, n=3):
    """Counter of (key, n_shingles, component) by comparing all pairs of different sets."""
    keys = {}
    for key, text, *_ in data:
        keys.setdefault(grams(text, n), []).append(key)
    sets = sorted((s for s in keys if s), key=len)
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if 100 * len(a) < percent * len(b):
                break
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                links += 1
                top[find(i)] = find(j)
    least = {}
    for i, s in enumerate(sets):
        known = [k for k in keys[s] if k is not None]
        least[find(i)] = min([*known, *([least[find(i)]] if least.get(find(i)) is not None else [])], default=None)
    of = {s: least[find(i)] for i, s in enumerate(sets)}
    return Counter((key, len(s), of[s] if s else key) for s, own in keys.items() for key in own), links


def copies(rng, base, changes, first, count):
    out = []
    for i in range(count):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append((first + i, " ".join(words), "en", "b", 0))
    return out


@pytest.fixture(scope="module")
def rows(data):
    """The common rows, groups of near copies around the threshold, and short and equal texts."""
    rng = random.Random(8)
    out = list(data)
    out += copies(rng, prose(rng, 150), 5, 1000, 150) + copies(rng, prose(rng, 60), 3, 2000, 60) + copies(rng, prose(rng, 400), 30, 3000, 40)
    template = prose(rng, 120)
    out += [(4000 + i, " ".join(template + prose(rng, 8)), "en", "a", 0) for i in range(60)]
    out += [(5000, "one", "en", "a", 0), (5001, "One", "en", "a", 0), (5002, "one two", "en", "a", 0), (5003, "two one", "en", "a", 0),
            (4999, out[-1][1], "en", "a", 0), (None, out[-2][1], "en", "a", 0)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("join") / "documents")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(folder)
    return spark.read.parquet(folder)


def found(df):
    return Counter(tuple(r) for r in df.collect())


def test_components_equal_all_pairs(table, rows):
    want, links = joined(rows)
    got = found(jaccard_join.linked_documents(table.withColumn("print", F.lit("mine")).withColumn("block", F.lit(1))))
    assert got == want and links > 300 and len({c for _, _, c in want}) > 100


@pytest.mark.parametrize("percent,n", [(80, 5), (90, 3)])
def test_small_chunks_blocks_and_parts_lose_no_link(monkeypatch, table, rows, percent, n):
    monkeypatch.setattr(similar_lists, "CHUNK", 7)
    for name, value in (("BLOCK_ROWS_LOG2", 3), ("LONG_TEXT", 700), ("ROWS_PER_PART", 20), ("COPIES_PER_TASK", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    assert found(jaccard_join.linked_documents(table, percent=percent, n=n)) == joined(rows, percent, n)[0]


def test_empty_and_unlinked_tables(spark, empty, tmp_path):
    assert jaccard_join.linked_documents(empty).count() == 0
    odd = [(1, None), (2, ""), (3, " \n"), (None, None), (4, "a b c d")]
    spark.createDataFrame(odd, "doc_id bigint, text string").write.parquet(f"{tmp_path}/odd")
    assert found(jaccard_join.linked_documents(spark.read.parquet(f"{tmp_path}/odd"))) == joined(odd)[0]


def test_parity_bits_bound_the_difference_from_below():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b, c = (rng.integers(0, 2**63, rng.integers(1, 200), dtype=np.uint64) for _ in range(3))
        x, y = np.unique(np.concatenate([a, c])), np.unique(np.concatenate([b, c]))
        p, q = (np.frombuffer(similar_lists.parity_bits(s), np.uint64).reshape(1, -1) for s in (x, y))
        while p.shape[1] != q.shape[1]:
            p, q = (similar_lists.folded(p), q) if p.shape[1] > q.shape[1] else (p, similar_lists.folded(q))
        assert int(np.bitwise_count(p ^ q).sum()) <= len(np.setxor1d(x, y))


def test_prefixes_of_linked_sets_meet():
    for percent in (80, 85, 90):
        for n in range(1, 80):
            for m in range(n, 100):
                least = similar_lists.least_overlap(n + m, percent)
                if least <= n:  # more elements in common than a set has after its prefix
                    assert least > n - jaccard_join.prefix_length(n, percent) and least > m - jaccard_join.prefix_length(m, percent)
