"""Prefix trie and periodic runs against plain Python, on nulls, ties, repeats and very long input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import periodic_runs, prefix_trie, queries

# --- conversation prefix trie ---------------------------------------------------------------------------

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def conversations(seed=2):
    rng, out = random.Random(seed), []
    for c in [*range(-4, 60), 1000, 1003, 1004, 10**12]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 14])):
            text = rng.choice(["hi", "hi", "é ß", "", None, f"t{rng.randrange(3)}"])
            out.append((c, rng.choice([t, t, t // 2, None]), rng.choice(["user", "bot", None, ""]), text))
    out += [(7, 3, "user", "same")] * 3 + [(None, 1, "user", "nobody's"), (2000, None, None, None)]
    out += [(c, t, "user", f"shared {t}") for c in range(3000, 3040) for t in range(1, 9 + c % 3)]
    return out + [(5000, t, "bot", f"long {t % 7}") for t in range(300)]


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        base, h = int(c - (abs(c) % 5) * (1 if c > 0 else -1)), zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key, m in members.items():
        cost = (len(m) - 1) * len(key[-1][1].encode()) if key else 0
        for d in range(len(key) + 1):
            saved[key[:d]] += cost
            leaves[key[:d]] += not children[key]
    return Counter((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items())


def test_trie_equals_brute_force_for_one_tree_and_many(spark):
    rows = conversations()
    random.Random(1).shuffle(rows)
    want = brute_trie(rows)
    assert max(n for n in Counter(k[3] for k in want)) > 5
    table = spark.createDataFrame(rows, CONVERSATIONS).repartition(3).withColumn("place", F.lit("mine")).withColumn("pid", F.lit(1))
    for tree_bytes in (1 << 20, 300):
        got = prefix_trie.prefix_trie(*prefix_trie.rebuilt_turns(table), tree_bytes=tree_bytes).collect()
        assert Counter(tuple(r) for r in got) == want


def test_trie_query_and_empty_tables(spark, tmp_path):
    for name, rows in (("some", conversations(5)), ("none", [])):
        spark.createDataFrame(rows, CONVERSATIONS).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        got = queries.op11_conversation_prefix_trie(spark, f"{tmp_path}/{name}")
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert Counter(tuple(r) for r in got.collect()) == brute_trie(rows)


@pytest.mark.parametrize("alphabet", [2, 5, 17, 60, 256])
def test_radix_tree_holds_every_key_in_every_layout(alphabet):
    rng = random.Random(alphabet)
    tree, want = prefix_trie.RadixTree(), defaultdict(list)
    for i in range(2000):
        key = bytes(rng.randrange(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 8])))
        tree.insert(key, i)
        want[key].append(i)
    got, keys, layouts = {}, [], set()
    for node, depth, up in tree.nodes():
        keys.append((keys[up] if up >= 0 else b"") + node.path)
        assert len(keys[-1]) == depth and (up < 0 or node.path)
        layouts.add((type(node.children).__name__, getattr(node.children, "room", None)))
        # A step without an end has to branch: bytes without a branch are compressed.
        assert node.ends or up < 0 or len(list(node.children.items())) > 1
        if node.ends:
            got[keys[-1]] = node.ends
    assert got == want
    assert {2: ("_Sorted", 4), 5: ("_Sorted", 16), 17: ("_Indexed", None), 60: ("_Full", None), 256: ("_Full", None)}[alphabet] in layouts


# --- periodic runs --------------------------------------------------------------------------------------

def brute_runs(w):
    """All stretches of all lags, each compared from end to end."""
    _, w = np.unique(np.array(w, dtype=object if w and isinstance(w[0], str) else None), return_inverse=True)
    out = {}
    for q in range(1, len(w) // 4 + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], w[q:] == w[:-q], [0]])))
        for first, end in zip(same[::2].tolist(), same[1::2].tolist()):
            if end - first + q >= max(6, 4 * q):
                out.setdefault((first, end - first + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def repeating(rng, words):
    out = []
    while len(out) < words:
        if rng.random() < 0.4:
            out += [rng.choice("abcd") for _ in range(rng.randint(1, 9))] * rng.randint(2, 7)
        else:
            out.append(rng.choice(["a", "b", "A", "é"]))
    return out[:words]


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        docs = [[ord(c) for c in repeating(rng, rng.choice([0, 1, 5, 6, 7, 30, 90]))] for _ in range(rng.randint(1, 4))]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        got = periodic_runs.find_runs(np.array([x for d in docs for x in d], np.uint64), offsets)
        assert [tuple(r) for r in got.tolist()] == [(i, *r) for i, d in enumerate(docs) for r in brute_runs(d)]


def test_a_word_repeated_a_hundred_thousand_times_is_one_run():
    assert periodic_runs.find_runs(np.ones(100_000, np.uint64), np.array([0, 0, 100_000, 100_000])).tolist() == [[1, 0, 100_000, 1]]


def told(key, text):
    """The contract's columns of one document."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (key, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_documents(spark, data, tmp_path):
    rng = random.Random(4)
    rows = [r[:2] for r in data] + [(i, rng.choice([" ", "\n", " \t"]).join(repeating(rng, rng.choice([5, 40, 300])))) for i in range(100, 180)]
    rows += [(200, " ".join(["no"] * 5)), (201, " ".join(["yes"] * 6)), (202, "yes " * 6), (202, "yes " * 6)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = Counter(tuple(r) for r in got.collect())
    assert got == Counter(told(*r) for r in rows) and sum(r[1] > 1 for r in got) > 10
    assert sum(r[3] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in got) >= 5


def test_runs_keep_columns_and_take_empty_tables(spark, empty, stored):
    clashing = stored.withColumn("runs", F.lit("mine")).withColumn("start", F.lit(1))
    got = periodic_runs.collapse_runs(clashing, limit=50)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "start", "runs", "longest", "runs_sha256", "collapsed", "n_words"]
    assert got.count() == stored.count() and got.filter("text IS NULL AND (size(runs) > 0 OR collapsed <> '' OR longest IS NOT NULL)").isEmpty()
    assert periodic_runs.collapse_runs(empty).count() == 0
