"""Language model, classifier, perplexity rules, license scan, repeats and personal data against plain Python."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import bloom_lm, licenses, perplexity, pii, rule_ensemble, suffix_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- language model -----------------------------------------------------------------------------------

def test_scores_equal_the_formulas(stored, data):
    rows = bloom_lm.score_documents(stored).collect()
    tokens = [[*blank_words((t or "").translate(LOW)), "\n"] for _, t, *_ in data]
    out = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, *_ in data]
    one = Counter(w for ws, o in zip(tokens, out) if not o for w in ws)
    two = Counter(p for ws, o in zip(tokens, out) if not o for p in zip(["\r", *ws], ws))
    n, v = sum(one.values()), len(one)
    want, models = Counter(), {}
    for (key, *_), ws, o in zip(data, tokens, out):
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws)
        want[key, o, len(ws), sum(one[w] > 0 for w in ws), n, round(base, 6)] += 1
        models[key, len(ws), round(base, 6)] = sum(
            math.log10((two[a, b] + 20 * (one[b] + 1) / (n + v + 1)) / (one["\n" if a == "\r" else a] + 20)) for a, b in zip(["\r", *ws], ws))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    off = [abs(r.score - models[r.doc_id, r.n_tokens, round(r.base_score, 6)]) / r.n_tokens for r in rows]
    assert np.median(off) < 0.1 and max(off) < 0.5  # counts are quantised


def test_filter_holds_every_level_and_drops_low_counts_only_beyond_its_bound():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    counts = rng.zipf(1.6, len(keys)).clip(1, 10 ** 6)
    part = bloom_lm.part_of(keys, 1)
    bits, entries, least = bloom_lm.build_segment(keys & np.uint64(0xFFFFFFFF), counts, 1 << 20)
    read = bloom_lm.LogFilter.of({0: bits}, 1).counts(keys)
    assert part.max() == 0 and least == 1 and entries == bloom_lm.levels(counts).sum()
    assert (read >= bloom_lm.decoded(bloom_lm.levels(counts)) - 1e-9).all()
    assert np.mean(read == bloom_lm.decoded(bloom_lm.levels(counts))) > 0.9
    unseen = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    assert np.mean(bloom_lm.LogFilter.of({0: bits}, 1).counts(unseen) > 0) < 0.06
    small, _, least = bloom_lm.build_segment(keys & np.uint64(0xFFFFFFFF), counts, 800)
    assert len(small) <= 800 and least > 1
    assert (bloom_lm.LogFilter.of({0: small}, 1).counts(keys[counts >= 2 * least]) > 0).all()


def test_parts_hold_and_answer_every_pair_seen_once():
    """Whatever the size of the corpus, a part holds all its pairs, and answers learned and held-out ones."""
    rng = np.random.default_rng(2)
    low = np.unique(rng.integers(0, 1 << 32, 400_000, dtype=np.uint64)).astype(np.uint32)
    learned, held = low[::2], low[1::2]
    asked = bloom_lm.table_of([(bloom_lm.PAIRS, 5, 9, learned.tobytes(), None, b"", b"", held.tobytes())], bloom_lm._KEYS)
    total, answer = bloom_lm._answer(asked).to_pylist()
    level = np.frombuffer(answer["levels"], np.uint8)
    assert total["total_n"] == total["distinct_n"] == len(learned) and answer["block"] == 9
    assert (level[:len(learned)] >= 1).all() and np.mean(level[len(learned):] > 0) < 0.06


def test_scores_of_edge_tables(spark, stored, empty):
    assert bloom_lm.score_documents(empty).count() == 0
    none = bloom_lm.score_documents(spark.createDataFrame([(None, None), (1, "")], "doc_id bigint, text string")).collect()
    assert all(r.n_tokens == 1 and math.isfinite(r.score) for r in none)


# --- classifier ---------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    rng, rows, labels = random.Random(5), [], []
    for i in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(30, 120))]
        bad = i % 4 == 0
        text = " ".join(w + rng.choice(["###", "%%%"]) if bad else w for w in words)
        rows.append((i, text))
        labels += [(i, 0 if bad else 1)]
    rows += [(None, None), (1000, ""), (1001, " \n "), (1001, " \n ")]
    labels += [(None, 1), (7, None), (8, 5), (12, 0), (12, 0)]
    folder = str(tmp_path_factory.mktemp("labelled"))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(folder + "/d")
    return spark.read.parquet(folder + "/d"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_rules_tell_held_out_junk_from_prose(labelled):
    docs, labels = labelled
    rows = rule_ensemble.score_quality(docs, labels, trees=6, depth=3).collect()
    assert len(rows) == 604 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    unseen = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(unseen) > 80 and np.mean([r.predicted == (r.doc_id % 4 != 0) for r in unseen]) > 0.97
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in rows)


def test_compiled_expression_equals_the_rules(labelled):
    docs, labels = labelled
    table = rule_ensemble.with_statistics(docs.filter("doc_id < 300"), keep=["doc_id"]).join(labels.filter("quality IN (0, 1)"), "doc_id")
    model = rule_ensemble.fit(table, "quality", "doc_id", trees=4, depth=3)
    assert 0 < len(model.weights) < 120 and any(len(r.parts) > 1 for r, _ in model.weights)
    for r in table.withColumn("score", model.score()).limit(40).collect():
        total = model.intercept + sum(w for rule, w in model.weights if all((r[s] > t) == above for s, above, t in rule.parts))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_classifier_without_labels_or_rows(spark, stored, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert rule_ensemble.score_quality(empty, none).count() == 0
    assert {r.score for r in rule_ensemble.score_quality(stored, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, quality int")
    assert {r.predicted for r in rule_ensemble.score_quality(stored, one).collect()} == {1}


# --- perplexity rules ---------------------------------------------------------------------------------

def test_base_counts_and_verdict(stored, data):
    judged = perplexity.judge(stored.withColumn("kept", F.lit("x")), keep=["doc_id"])
    assert judged.columns[0] == "doc_id" and judged.columns[-2:] == ["base_failed", "kept"]
    want = Counter()
    for key, text, *_ in data:
        w = blank_words(text)
        lines = [x for x in (text or "").split("\n") if blank_words(x)]
        three, again = Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if three[tuple(w[k:k + 3])] > 1:
                again |= {k, k + 1, k + 2}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want[key, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), failed] += 1
    rows = judged.collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)


def brute_kneser_ney(texts):
    """Interpolated modified Kneser-Ney over class strings, by definition."""
    strings = [tuple(perplexity.CLASSES[np.frombuffer(t.encode(), np.uint8)].tolist()) for t in texts]
    tables = [Counter(), Counter(), Counter(), Counter(s[i:i + 4] for s in strings for i in range(len(s) - 3))]
    for order in (2, 1, 0):
        tables[order] = Counter(g[1:] for g in tables[order + 1])

    def discount(c):
        n = Counter(c.values())
        if not all(n[k] for k in (1, 2, 3, 4)):
            return [0, 0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3)]

    discounts = [discount(c) for c in tables]

    def p(gram):
        if not gram:
            return 1 / 32
        c, d = tables[len(gram) - 1], discounts[len(gram) - 1]
        after = [n for g, n in c.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        n, total = c[gram], sum(after)
        return (n - d[min(n, 3)]) / total + sum(d[min(a, 3)] for a in after) / total * p(gram[1:])

    return p


def test_kneser_ney_equals_its_definition():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aab cd. E1#é") for _ in range(300)) for _ in range(4)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    ids, _ = perplexity.gram_ids(data, offsets)
    unique, counts = np.unique(ids, return_counts=True)
    model, p = perplexity.KneserNey.fit({3: (unique, counts)}), brute_kneser_ney(texts)
    probe = np.array([int(x) for x in unique[:60]] + [rng.randrange(1 << 20) for _ in range(200)])
    want = [math.log10(p(tuple((g >> s) & 31 for s in (15, 10, 5, 0)))) for g in probe.tolist()]
    assert np.allclose(model.log_prob(3, probe), want, atol=1e-4)
    every = 10 ** model.log_prob(3, (int(unique[5]) >> 5 << 5) + np.arange(32))
    assert every.sum() == pytest.approx(1, abs=1e-4)


def test_perplexity_band_rejects_strange_texts_and_keeps_the_rest(spark, tmp_path):
    rng = random.Random(9)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    rows = [(i, " ".join(word("etaoinshr") for _ in range(150)), "en") for i in range(300)]
    rows += [(1000 + i, " ".join(word("etaoinshr") for _ in range(20)) + " " + " ".join(word("0QZ{}~#") for _ in range(130)), "en") for i in range(3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "d"))
    kept = {r.doc_id: r.kept for r in perplexity.judge(spark.read.parquet(str(tmp_path / "d")), keep=["doc_id"]).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(3))


def test_every_language_has_its_own_model_and_band(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(perplexity, "LANGUAGES_AT_ONCE", 3)
    rng = random.Random(11)
    scripts = {"ru": "оеаинтсрвл", "el": "αοιετσνηυρ", "zh": "的一是不了人我在有他"}
    letters = {**{f"l{k:02d}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 8)) for k in range(17)}, **scripts, None: "etaoin"}
    junk = {"ru": "щъэюфцхчшж", "el": "ξψζφχβδθωγ", "zh": "鑫龘靐齉爨麤灪籱癵驫"}
    def text(chars):
        return " ".join("".join(rng.choice(chars) for _ in range(rng.randint(3, 8))) for _ in range(80))
    rows = [(1000 * k + i, text(chars), name) for k, (name, chars) in enumerate(letters.items()) for i in range(40)]
    rows += [(100000 + k, text(junk.get(name, "0QZ{}~#")), name) for k, name in enumerate(letters)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = {r.doc_id: r.kept for r in perplexity.judge(docs, keep=["doc_id"]).collect()}
    assert len(kept) == len(rows) and not any(k for i, k in kept.items() if i >= 100000)
    assert np.mean([k for i, k in kept.items() if i < 100000]) > 0.99
    # Another language's rows change nothing for this one.
    alone = perplexity.judge(docs.filter("lang = 'l03'"), keep=["doc_id"]).collect()
    assert {r.doc_id: r.kept for r in alone} == {i: kept[i] for i in (r.doc_id for r in alone)}


def test_perplexity_equals_its_definition_over_characters(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("aab cD. E17é的一是😀") for _ in range(60 + 40 * i)), "xy"[i % 2]) for i in range(6)] + [(9, "的一是", "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r.log_perplexity for r in perplexity.judge(spark.read.parquet(str(tmp_path / "d")), keep=["doc_id"]).collect()}
    assert got.pop(9) is None
    for lang in "xy":
        mine = {i: t for i, t, name in rows if name == lang and i < 9}
        tables = [Counter(), Counter(), Counter(), Counter(t[i:i + 4] for t in mine.values() for i in range(len(t) - 3))]
        for order in (2, 1, 0):
            tables[order] = Counter(g[1:] for g in tables[order + 1])

        def p(gram):
            if not gram:
                return 1 / len(tables[0])
            c = tables[len(gram) - 1]
            numbers = Counter(c.values())
            d = [0, *perplexity.KneserNey.discounts_of(*(numbers[k] for k in (1, 2, 3, 4)))[1:]]
            after = [n for g, n in c.items() if g[:-1] == gram[:-1]]
            return (c[gram] - d[min(c[gram], 3)] + sum(d[min(a, 3)] for a in after) * p(gram[1:])) / sum(after)

        for i, t in mine.items():
            grams = [t[k:k + 4] for k in range(len(t) - 3)]
            assert got[i] == pytest.approx(-sum(math.log10(p(g)) for g in grams) / len(grams), abs=1e-9)


def test_characters_of_one_byte_class_are_told_apart(spark, tmp_path):
    """Capitals, digits, and characters beyond ASCII with the same first byte, in sound and in odd mixtures."""
    rng = random.Random(13)
    usual = {"a": "ETAOIN", "b": "123", "c": "的一是不了人"}
    odd = {"a": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "b": "0123456789", "c": "皂皃皆皇皈皊皋皌皍皎皏皐皑皒皓皔皕皖皗皘皙皚"}
    def text(chars):
        return " ".join("".join(rng.choice(chars) for _ in range(rng.randint(3, 8))) for _ in range(150))
    rows = [(1000 * k + i, text(usual[name]), name) for k, name in enumerate(usual) for i in range(100)]
    rows += [(100000 + k, text(odd[name]), name) for k, name in enumerate(usual)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "d"))
    kept = {r.doc_id: r.kept for r in perplexity.judge(spark.read.parquet(str(tmp_path / "d")), keep=["doc_id"]).collect()}
    assert not any(k for i, k in kept.items() if i >= 100000)
    assert np.mean([k for i, k in kept.items() if i < 100000]) > 0.98


def test_blocks_share_one_model_and_keep_all_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(perplexity, "BLOCK_ROWS_LOG2", 3)
    rng = random.Random(17)
    rows = [(i, None if i % 9 == 8 else "".join(rng.choice("etaoin shrdlu") for _ in range(400)), "en" if i % 3 else None, [i, None]) for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, other array<int>").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    small = {r.doc_id: r for r in perplexity.judge(docs).collect()}
    monkeypatch.undo()
    large = {r.doc_id: r for r in perplexity.judge(docs).collect()}
    assert small.keys() == large.keys() == {r[0] for r in rows}
    for r in rows:
        assert (small[r[0]].text, small[r[0]].lang, small[r[0]].other) == r[1:]
        assert small[r[0]].kept == large[r[0]].kept and (small[r[0]].log_perplexity is None) == (r[1] is None)
        assert r[1] is None or small[r[0]].log_perplexity == pytest.approx(large[r[0]].log_perplexity, abs=1e-9)


def test_perplexity_of_an_empty_table(empty):
    assert perplexity.judge(empty).count() == 0


# --- license scan -------------------------------------------------------------------------------------

def test_licenses_and_inheritance(spark, tmp_path):
    prose = "\n".join(f"line {k} of some code and the rest" for k in range(20))
    rows = [("a/LICENSE", "Released under the MIT License.\n"), ("a/b/x.py", prose), ("a/b/c/y.py", "# licensed under CC BY-NC 4.0.\n" + prose),
            ("a/b/c/z.py", prose), ("d/e/f.py", prose), ("d/COPYING", "All rights reserved."), ("d/e/COPYING", "All rights reserved."),
            ("top.txt", None), (None, ""), ("a/b/x.py", prose), ("/d//e/g.py", prose)]
    files = spark.createDataFrame(rows, "path string, text string")
    found = licenses.with_licenses(files, "path", [])
    got = Counter((r.path, r.own_license, r.license, r.license_from) for r in found.collect())
    assert got == Counter([("a/LICENSE", "MIT", "MIT", None), *[("a/b/x.py", None, "MIT", "a")] * 2, ("a/b/c/y.py", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
                           ("a/b/c/z.py", None, "MIT", "a"), ("d/e/f.py", None, "proprietary", "d/e"), ("d/COPYING", "proprietary", "proprietary", None),
                           ("d/e/COPYING", "proprietary", "proprietary", None), ("top.txt", None, None, None), (None, None, None, None),
                           ("/d//e/g.py", None, "proprietary", "d/e")])
    assert licenses.with_licenses(files.limit(0), "path", []).count() == 0


def test_line_cosines_equal_plain_tf_idf(stored, data):
    texts = [t or "" for _, t, *_ in data]
    model = licenses.Templates(licenses.TEMPLATES)
    model.weigh(*licenses.document_frequencies(stored, "text", model))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    vocabulary = {w for t in licenses.TEMPLATES.values() for w in words(t)}
    df = Counter(w for t in texts for w in set(words(t)) & vocabulary)
    weight = lambda w: math.log((1 + len(texts)) / (1 + (df[w] if w in vocabulary else 0))) + 1
    probe = ["licensed under the mit license", "the the license w1 w2", "all rights reserved"]
    import pyarrow as pa
    hashes, found = licenses._hashed(pa.array(probe))
    got = model.cosines(found.documents(), hashes, len(probe))
    for i, line in enumerate(probe):
        a = {w: n * weight(w) for w, n in Counter(words(line)).items()}
        for j, name in enumerate(model.names):
            b = {w: n * weight(w) for w, n in Counter(words(licenses.TEMPLATES[name])).items()}
            norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
            assert got[i, j] == pytest.approx(sum(a.get(w, 0) * x for w, x in b.items()) / norm)

def commented(text, prefix, width):
    return "\n".join(prefix + line for line in textwrap.wrap(text, width)) + "\n"


def test_license_files_and_wrapped_headers(spark):
    texts, headers, openings = dict(licenses.LICENSE_TEXTS), dict(licenses.HEADERS), dict(licenses.OPENINGS)
    code = "\n".join(f"def part_{k}(x, y):\n    return x + {k} * y" for k in range(60))
    long = "\n".join(f"{k}. clause of the terms about copying part {k} and the obligations that follow from it" for k in range(400))
    rows = [("MIT", "MIT", "MIT License\n\nCopyright (c) 2021 Jane Doe\n\n" + commented(texts["MIT"], "", 78)),
            ("ISC", "ISC", "Copyright (c) 2019, J. Doe\n\n" + commented(texts["ISC"], "", 70)),
            ("BSD-2-Clause", "BSD-2-Clause", "Copyright 2018 A. Person. All rights reserved.\n\n" + commented(texts["BSD-2-Clause"], "", 60)),
            ("BSD-3-Clause", "BSD-3-Clause", "Copyright 2018 A. Person\n\n" + commented(texts["BSD-3-Clause"], " ", 72)),
            ("Unlicense", "Unlicense", commented(texts["Unlicense"], "", 64)),
            *[(name, name, "\n" + commented(text.upper(), " " * 10, 60) + "\n" + long) for name, text in openings.items()
              if name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1")],
            *[(name, None, "#!/usr/bin/env python\n" + commented(text, prefix, width) + code)
              for (name, text), prefix, width in zip(headers.items(), ["# ", " * ", "// ", "-- ", "# ", "; ", "# "] * 2, [50, 60, 70, 44, 78, 66, 58] * 2)],
            (None, None, code), (None, None, long), (None, None, "the permission of the author and the conditions of use"),
            ("MIT", None, code + "\n# Released under\n# the MIT License.\n" + code)]
    files = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, own string, file string, text string")
    for r in licenses.scan_texts(files).collect():
        assert (r.id, r.own_license, r.file_license) == (r.id, r.own, r.file)


def slow_scan(texts):
    import pyarrow as pa
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    pairs = sorted([*licenses.TEMPLATES.items(), *licenses.HEADERS, *licenses.LICENSE_TEXTS])
    openings, found = sorted(licenses.OPENINGS), []
    vocabulary = {w for _, t in [*pairs, *openings] for w in words(t)}
    known = sorted({w for t in texts for w in words(t)} | vocabulary)
    key = dict(zip(known, (w if w in vocabulary else int(licenses._slot(licenses._hashed(pa.array([w]))[0])[0]) for w in known)))
    df = Counter(k for t in texts for k in {key[w] for w in words(t)})

    def vector(t):
        v = {w: n * (math.log((1 + len(texts)) / (1 + df[key[w]])) + 1) for w, n in Counter(words(t)).items()}
        return v, math.sqrt(sum(x * x for x in v.values()))

    rows = [(name, *vector(t)) for name, t in pairs], [(name, *vector(t)) for name, t in openings]

    def best(t, among):
        v, norm = vector(t)
        return max([(round(sum(x * u.get(w, 0) for w, x in v.items()) / (norm * size), 9), -i, name)
                    for i, (name, u, size) in enumerate(among)]) if norm else (0, 0, None)

    for t in texts:
        lines = [x for x in t.split("\n") if words(x)]
        own, begun, single = (0, None), (0, None), 0
        for length in licenses.RUN_LINES:
            for at in range(0, len(lines), max(1, length // 4)):
                size = min(length, len(lines) - at)
                if size < length and (at or length >= 2 * size):
                    continue
                run = "\n".join(lines[at:at + size])
                score, _, name = best(run, rows[0])
                single += length == 1 and score >= licenses.LINE_COSINE
                own = (score, name) if score >= licenses.LINE_COSINE and score > own[0] else own
                score, _, name = best(run, rows[1]) if at == 0 else (0, 0, None)
                begun = (score, name) if score >= licenses.LINE_COSINE and score > begun[0] else begun
        score, _, name = best(t, rows[0])
        file = (score, name) if score >= licenses.FILE_COSINE else (0, None)
        own, file = max(own, begun, key=lambda x: x[0]), max(file, begun, key=lambda x: x[0])
        found.append((own[1], own[0], single, file[1], file[0]))
    return found


def test_scan_equals_brute_force(spark):
    rng = random.Random(12)
    pool = [x for _, t in [*licenses.HEADERS, *licenses.LICENSE_TEXTS, *licenses.OPENINGS] for x in t.split("\n")] + list(licenses.TEMPLATES.values())
    prose = ["a line of code and the rest", "ünd nöch eine", "x = 1", "", "  * ", "the software of the author", "public domain"]
    whole = [t for _, t in [*licenses.HEADERS, *licenses.LICENSE_TEXTS, *licenses.OPENINGS]]
    texts = ["", " \n\n", "license", *["\n".join([*rng.choices(prose, k=rng.randrange(4)), rng.choice(whole), *rng.choices(prose, k=rng.randrange(9))]) for _ in range(30)]]
    texts += ["\n".join(rng.choice(pool if rng.random() < 0.4 else prose) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts += [texts[5]] * 3
    files = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    got = {r.id: (r.own_license, r.own_score or 0, r.n_license_lines, r.file_license, r.file_score or 0) for r in licenses.scan_texts(files).collect()}
    for i, want in enumerate(slow_scan(texts)):
        assert got[i][0::2] == want[0::2][:3] and got[i][3] == want[3], (i, got[i], want)
        assert got[i][1] == pytest.approx(want[1]) and got[i][4] == pytest.approx(want[4])


def test_inheritance_equals_brute_force_with_hot_directories(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        directory = "hot/a" if i % 3 == 0 else "/".join(rng.choice("abc") for _ in range(rng.randrange(5)))
        text = rng.choice(list(licenses.TEMPLATES.values())) if rng.random() < 0.03 else "x = 1\n"
        rows.append((i, f"{directory}/f{i:03d}" if directory else f"f{i:03d}", text))
    files = spark.createDataFrame(rows, "id int, path string, text string").repartition(3)
    names = {t: n for n, t in licenses.TEMPLATES.items()}
    given = {}
    for _, path, text in sorted(rows, key=lambda r: r[1]):
        if text in names:
            given.setdefault(path.rpartition("/")[0], names[text])
    for r in licenses.with_licenses(files, "path", ["id"], hot_files=7).collect():
        text, directory = rows[r.id][2], rows[r.id][1].rpartition("/")[0]
        want = (names[text], None) if text in names else (None, None)
        while text not in names:
            if directory in given:
                want = given[directory], directory
                break
            if not directory:
                break
            directory = directory.rpartition("/")[0]
        assert (r.license, r.license_from) == want


# --- repeats ------------------------------------------------------------------------------------------

def without_repeats(data, length=50):
    texts = [(k, (t or "").encode()) for k, t, *_ in data]
    first, out = {}, Counter()
    for key, text in texts:
        key = math.inf if key is None else key
        for p in range(len(text) - length + 1):
            s = text[p:p + length]
            first[s] = min(first.get(s, math.inf), key)
    for key, text in texts:
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if first[text[p:p + length]] < (math.inf if key is None else key):
                gone[p:p + length] = b"\1" * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[math.inf if key is None else key, len(text), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(text, gone) if not g)).hexdigest()] += 1
    return out


def repeat_rows():
    rng = random.Random(4)
    shared = ["".join(rng.choice("ab c") for _ in range(n)) for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(120):
        text = "".join(rng.choice("abcde fgh") for _ in range(rng.choice([0, 10, 60, 300])))
        for s in rng.sample(shared, rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text = text[:at] + s + text[at:]
        rows.append((rng.randrange(100), text))
    return rows + [(None, rows[3][1]), (None, None), (5, "ab" * 300), (4, "ba" * 200), (7, "é" * 100), (6, "é" * 90), (200, rows[0][1]), (200, rows[0][1])]


@pytest.mark.parametrize("options", [{}, {"many": 1, "block_rows_log2": 2}, {"gram": 24, "block_rows_log2": 3}])
def test_repeats_equal_brute_force(spark, tmp_path, options):
    data = repeat_rows()
    spark.createDataFrame(data, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    rows = suffix_dedup.remove_repeats(spark.read.parquet(str(tmp_path / "d")), **options).collect()
    got = Counter((math.inf if r.doc_id is None else r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed),
                   hashlib.sha256(r.kept).hexdigest()) for r in rows)
    assert got == without_repeats(data)


def test_repeats_of_an_empty_table(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_earlier_matches_by_definition():
    rng = random.Random(8)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    keys = np.array([rng.randrange(12) for _ in strings])
    hit = suffix_dedup.earlier_matches(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), keys, 9)
    at = 0
    for s, k in zip(strings, keys):
        for p in range(len(s)):
            want = p + 9 <= len(s) and any(s[p:p + 9] in t for t, j in zip(strings, keys) if j < k)
            assert hit[at + p] == want
        at += len(s)


# --- personal data ------------------------------------------------------------------------------------

def slow_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "B", "1", "2", "0", "255", ".", "@", "+", "-", " ", "(", ")", "%", "é", "4111111111111111"])
                       for _ in range(rng.randint(0, 40)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == slow_spans(text)


def test_patterns_are_linear_on_long_runs():
    for run in ("1" * 200_000, "a" * 200_000, "a@" * 50_000, "1." * 50_000, "+1 " * 50_000, "- " * 100_000):
        pii.base_spans(run)
        pii.find_units([(0, run, pii.base_spans(run))])


def test_field_labels_repeated_numbers_alike(spark, tmp_path):
    rng, rows = random.Random(6), []
    for i in range(150):
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        rows.append((i, f"call {phone} now, again {phone}. version 2.{i % 9} of {rng.randrange(9999)} items"))
    rows += [(1000, "é call +1 (176) 555-0570 or 176 555 0570 again"), (1001, "only 176 555 0570 here 4.0"), (None, None), (1002, ""), (1002, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d")).withColumn("base", F.lit("mine"))
    found = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    spans = lambda r: [(s.kind, s.start, s.end) for s in r.spans]
    texts = dict(rows)
    assert all([(s.kind, s.start, s.end) for s in r.base] == slow_spans(texts[k] or "") for k, r in found.items())
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in found.values())
    assert spans(found[1000]) == [("phone", 7, 24), ("phone", 28, 40)] and spans(found[1001]) == [] and spans(found[None]) == []
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_field_adds_repeats_and_numbers_of_the_same_form(spark, tmp_path):
    rng, rows, wanted, others = random.Random(8), [], set(), set()

    def card(good):
        while True:
            digits = "".join(rng.choice("0123456789") for _ in range(16))
            if pii.luhn(digits) == good:
                return digits

    def add(text, start, end, group):
        group.add((len(rows), start, end))
        return text

    for i in range(600):
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        if i % 3 == 0:
            # Ties are learned from numbers that the patterns find twice.
            rows.append((i, f"please call {phone} today or dial {phone} tonight about item {rng.randrange(9999)} of page {i % 40}"))
        elif i % 3 == 1:
            again = phone[4:7] + " " + phone[9:12] + " " + phone[13:]
            text = f"please call {phone} today or dial "
            rows.append((i, add(text + again + " tonight", len(text), len(text) + len(again), wanted)))
        else:
            number, text = card(i % 2 == 0), "paid with card "
            if i % 2:
                add("", len(text), len(text) + 16, wanted)
            build = f"{text}{number} in 20{i % 30:02d}, order 1{rng.randrange(10 ** 6):06d} shipped"
            at = build.index("order ") + 6
            rows.append((i, add(build, at, at + 7, others)))
    # A third of all rows is one text, which counts once.
    rows += [(k, "plain 12 of 34") for k in range(1000, 1300)] + [(None, None), (2000, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    found = pii.find_personal_data(spark.read.parquet(str(tmp_path / "d")), fit_documents=5000).collect()
    added = {(r.doc_id, s.start, s.end) for r in found for s in set(r.spans) - set(r.base)}
    assert len(added & wanted) >= 0.95 * len(wanted) and not added & others
    assert len(added - wanted) <= 0.02 * len(added)


def test_fitting_sample_is_bounded_in_units(spark, tmp_path):
    rows = [(k, f"call +1 (203) 555-{k:04d} or page {k}") for k in range(300)] + [(999, "12, " * 5000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    docs, seen = spark.read.parquet(str(tmp_path / "d")), []
    fit = pii.SkipChainField.fit
    try:
        pii.SkipChainField.fit = classmethod(lambda cls, units, *a: seen.append(units) or fit.__func__(cls, units, 1))
        pii.fit_field(docs, "text", 1000, 100)
        pii.fit_field(docs, "text", 1000, 1)
    finally:
        pii.SkipChainField.fit = fit
    assert len(seen[0].label) == 100 and len(seen[0].chain) == 50 and not len(seen[1].label)
    assert (seen[0].chain == np.arange(100).reshape(-1, 2)).all() and set(seen[0].label) == {0, 4}

def test_messages_equal_exact_marginals_on_a_tree():
    rng = np.random.default_rng(0)
    k = len(pii.KINDS) + 1
    field = pii.SkipChainField(rng.normal(size=(pii.N_FEATURES, k)), *(lambda a, b: (a + a.T, b + b.T))(rng.normal(size=(k, k)), rng.normal(size=(k, k))))
    none = np.zeros(4, np.int64)
    units = pii.Units(none, none, none, np.array([0, 2, 0, 0]), rng.normal(size=(4, pii.N_FEATURES)), np.array([[0, 1], [1, 2]]), np.array([[1, 3]]))
    joint = np.zeros((k,) * 4)
    local = units.features @ field.unary
    for index in np.ndindex(*joint.shape):
        joint[index] = np.exp(sum(local[i, y] for i, y in enumerate(index)) + field.chain[index[0], index[1]]
                              + field.chain[index[1], index[2]] + field.skip[index[1], index[3]]) if index[1] == 2 else 0
    for i in range(4):
        exact = joint.sum(axis=tuple(j for j in range(4) if j != i))
        assert np.allclose(field.marginals(units, rounds=60)[i], exact / exact.sum(), atol=1e-6)
