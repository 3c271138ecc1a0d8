"""Phrase collocations, word runs and near-duplicate vectors against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from brute import SPACE_RUN, roots
from llm_rows import words

from chronofold.llm import collocations, embedding_dedup, word_runs
from chronofold.llm.scratch import Scratch

# Phrases


def brute_phrases(rows, longest, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in some.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held[p[i : i + m]], a)
        scored = []
        for p, a in some.items():
            if held[p] * share[1] >= a * share[0] and held[p]:
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows():
    rnd = random.Random(11)
    vocabulary = ["The", "the", "cat", "sat", "on", "New", "york", "city", "é x", "a-b", "日本"]
    rows = [
        (rnd.choice(["en", "de", None, "und"]), "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " \x0b"]) for _ in range(rnd.randrange(60))))
        for _ in range(120)
    ]
    return [*rows, ("en", None), (None, ""), ("fr", " . , ; "), ("en", "one"), ("en", "x " * 3000), ("en", "x " * 3000)]


@pytest.mark.parametrize(("longest", "budget"), [(3, 1 << 18), (3, 30), (4, 60)])
def test_phrases(spark, monkeypatch, longest, budget):
    monkeypatch.setattr(collocations, "PACKED", min(budget, 1 << 10))
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 1, "f", 2) for r in rows], "lang string, text string, n bigint, phrase string, size int").repartition(3)
    got = collocations.phrase_collocations(docs, longest=longest, least=3, top=25, budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, longest, 3, (50, 100), 25)


def test_phrases_of_parts_of_a_long_text(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 64)
    text = "ab cd. ef, gh ij kl mn op qr st uv wx yz ab cd ef gh ij kl mn op qr st uv wx yz. " * 40
    buf = np.frombuffer(text.encode(), np.uint8)
    parts = list(collocations._parts(buf))
    assert parts[0][0] == 0 and parts[-1][1] == len(buf) and all(b == c for (_, b), (c, _) in zip(parts, parts[1:]))
    found = Counter()
    for a, b in parts:
        assert b == len(buf) or chr(buf[b - 1]) in ".,"
        batch = collocations._suffixes(buf[a:b], np.array([0, b - a]), np.zeros(1, np.int64), pa.array(["en"]), 3)
        for r in batch.to_pylist() if batch else []:
            lines = r["rest"].split("\n")
            assert len(lines) == len(r["n"]) <= collocations.PACKED
            for line, n in zip(lines, r["n"]):
                found[f"{r['prefix']} {line}".strip()] += n
    want = Counter()
    for piece in re.split("[.,]", text):
        w = piece.split()
        want.update(" ".join(w[i : i + 3]) for i in range(len(w)))
    assert found == want


def test_counts_do_not_depend_on_the_budget(spark, edge_docs):
    def counts(budget):
        found, total = collocations.count_phrases(edge_docs, longest=3, least=1, scratch=Scratch(spark), budget=budget)
        return sorted(map(tuple, found.collect())), sorted(map(tuple, total.collect()))

    assert counts(2000) == counts(1 << 18)


def test_phrases_of_nothing(no_docs, edge_docs):
    assert collocations.phrase_collocations(no_docs).count() == 0
    got = [tuple(r) for r in collocations.phrase_collocations(edge_docs, least=10).collect()]
    rows = [(r["lang"], r["text"]) for r in edge_docs.select("lang", "text").collect()]
    assert sorted(got) == brute_phrases(rows, 3, 10, (50, 100), 2000)


def test_scores_beyond_64_bits(spark):
    """A phrase of 3 * 10**9 occurrences: numerator and product of counts pass 64 bits."""
    a, left, right = 3 * 10**9, 4 * 10**9 + 1, 7 * 10**9 + 3
    row = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    got = row.selectExpr(
        "(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as s"
    ).first()["s"]
    assert got == 1000000 * a * a // (left * right)


# Runs


def brute_runs(w, shortest=24, periods=3):
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            x = w[i : i + size]
            if j > i and size >= max(shortest, periods * q) and not any(x[p:] == x[:-p] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_document(doc_id, text, fold):
    w = SPACE_RUN.findall(text or "")
    n = len(w)
    if fold and doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    power = None if best[0] is None else 1000 * best[1] // best[2]
    return doc_id, len(runs), *best, power, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def run_texts():
    rnd = random.Random(12)
    rows = []
    for i in range(150):
        w = [rnd.choice("abcé") for _ in range(rnd.randrange(80))]
        for _ in range(rnd.randrange(4)):
            p, a = rnd.randrange(1, 15), rnd.randrange(len(w) + 1)
            for _ in range(rnd.randrange(70)):
                w.insert(a + p, w[a]) if a + p <= len(w) and a < len(w) else None
                a += 1
        rows.append((i, rnd.choice([" ", "\t", " \n"]).join(w)))
    odd = [(None, "x " * 40), (None, None), (5, None), (5, ""), (5, " \t\n"), (7, "ab " * 24), (7, "ab " * 23), (7, "ab " * 24)]
    return rows + odd + [(10**12, words(0, 500)), (8, ("p q r " * 9).strip() + " tail"), (9, ("u v w x y z " * 700) + words(0, 300) + " k" * 2000)]


@pytest.mark.parametrize("fold", [False, True])
def test_runs(spark, fold):
    rows = run_texts()
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, n_runs int, start int, runs int").repartition(3)
    got = word_runs.find_runs(docs, fold=fold)
    assert got.columns == word_runs.NAMES
    want = sorted((brute_document(*r, fold) for r in rows), key=repr)
    assert sorted((tuple(r)[:-1] for r in got.collect()), key=repr) == want
    for r in got.collect():
        listed = "".join(f"{x['start']},{x['length']},{x['period']}\n" for x in r["runs"])
        assert hashlib.sha256(listed.encode()).hexdigest() == r["runs_sha256"]


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_appended_in_parts(letters):
    rnd = random.Random(letters)
    for _ in range(200):
        w = [rnd.randrange(letters) for _ in range(rnd.randrange(120))]
        for _ in range(rnd.randrange(3)):
            a, p = rnd.randrange(len(w) + 1), rnd.randrange(1, 12)
            for i in range(a + p, min(len(w), a + rnd.randrange(70))):
                w[i] = w[i - p]
        names = np.array(w, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(5)
        for step in (1, 3, 17, 1000):
            row = word_runs.Catchers()
            for at in range(0, len(w), step):
                row.append(names[at : at + step])
            for shortest in (3, 24):
                assert sorted(row.runs(shortest, 3)) == sorted(brute_runs(w, shortest))


def test_catchers_forget_what_no_later_word_needs():
    row = word_runs.Catchers()
    names = np.random.default_rng(1).integers(0, 1 << 62, 1 << 15).astype(np.uint64)
    for at in range(0, len(names), 256):
        row.append(names[at : at + 256])
    assert sum(len(x.suffixes) for x in row.levels) < 6 * len(names)
    assert not row.runs(3, 3)


def test_runs_of_nothing(no_docs):
    assert word_runs.find_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        word_runs.find_runs(no_docs, periods=2)


# Vectors


def brute_vectors(rows, threshold):
    def sound(i, x):
        return i is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)

    def cosine(a, b):
        a, b = np.array(a, float), np.array(b, float)
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))

    good = [k for k, r in enumerate(rows) if sound(*r)]
    counts, links = Counter(), []
    for at, a in enumerate(good):
        for b in good[:at]:
            if len(rows[a][1]) == len(rows[b][1]) and cosine(rows[a][1], rows[b][1]) >= threshold:
                counts[a] += 1
                counts[b] += 1
                links.append((rows[a][0], rows[b][0]))
    group = roots(links, {rows[k][0] for k in good})
    out = []
    for k, (i, _) in enumerate(rows):
        own = group[i] if k in set(good) else i
        out.append((i, counts[k], own, own == i))
    return sorted(out, key=repr)


def vector_rows():
    rnd = np.random.default_rng(13)
    centres = rnd.normal(size=(12, 24))
    rows = [(int(i), (centres[i % 12] + rnd.normal(size=24) * rnd.choice([0.05, 0.2, 0.35])).tolist()) for i in rnd.permutation(160)]
    one = rows[0][1]
    nan, inf = float("nan"), float("inf")
    return rows + [
        (200, one), (201, one), (201, one), (3, rows[5][1]), (3, [-v for v in one]), (202, [2.0**60 * v for v in one]),
        (203, None), (204, []), (205, [0.0] * 24), (206, [nan] + one[1:]), (207, [inf] + one[1:]), (208, [None] + one[1:]),
        (None, one), (None, None), (209, one[:5]), (210, one[:5]), (211, [1.0]), (212, [5.0]), (213, [-1.0]),
        (214, [1e-300] * 24), (215, [1e300] * 24), (216, [-0.0, 1.0]), (217, [0.0, 1.0]),
    ]


@pytest.mark.parametrize(("size", "tile"), [(8192, (512, 8192)), (16, (3, 5))])
def test_vectors(spark, monkeypatch, size, tile):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", (size, size))
    rows = vector_rows()
    schema = "vec_id bigint, embedding array<double>, label int, h1 int, rep string, n int"
    table = spark.createDataFrame([(*r, 1, 2, "r", 3) for r in rows], schema).repartition(3)
    got = embedding_dedup.near_duplicate_vectors(table)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = [(i, n, c, bool(k)) for i, n, c, k in brute_vectors(rows, 0.9)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, n, c, True if i is None else k) for i, n, c, k in want), key=repr)


def test_vectors_of_nothing(spark):
    table = spark.createDataFrame([], "vec_id int, embedding array<float>")
    assert embedding_dedup.near_duplicate_vectors(table).count() == 0
    only_bad = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id int, embedding array<float>")
    got = sorted(map(tuple, embedding_dedup.near_duplicate_vectors(only_bad).collect()))
    assert got == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("dims", [1, 3, 64, 2500])
def test_bounds_hold_and_few_pairs_are_computed_again(dims):
    rnd = np.random.default_rng(dims)
    base = rnd.normal(size=(300, dims))
    x = np.concatenate([base, base + rnd.normal(size=base.shape) * 0.45, rnd.standard_cauchy(size=(200, dims))])
    codes, scale, error = embedding_dedup.quantise(x)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    exact = unit @ unit.T
    product = codes.astype(np.int64) @ codes.astype(np.int64).T
    assert (embedding_dedup.tile_product(codes, codes) == product).all()
    estimate = product * np.outer(scale, scale)
    assert (np.abs(exact - estimate) <= error[:, None] + error + np.outer(error, error) + 1e-9).all()
    side = codes, scale, error
    i, j = embedding_dedup.possible(side, side, 0.9)
    asked = np.zeros(exact.shape, bool)
    asked[i, j] = True
    assert not ((exact >= 0.9) & ~asked).any()
    if dims == 64:
        assert asked.sum() < 1.3 * (exact >= 0.88).sum() and not asked[exact < 0.85].any()


def test_full_precision_decides_and_counts():
    rnd = np.random.default_rng(2)
    x = np.repeat(rnd.normal(size=(40, 64)), 5, axis=0) + rnd.normal(size=(200, 64)) * 0.28
    weight = np.arange(1, 201)
    every = np.arange(200)
    found, root, computed = embedding_dedup.cell_links(x, weight, every, every, 0.9)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    assert (found == linked @ weight).all()
    assert linked.sum() // 2 <= computed < 200 * 199 // 2 // 4
    group = roots(list(zip(*np.nonzero(linked))), range(200))
    assert [int(r) for r in root] == [group[i] for i in range(200)]
    left, right = np.arange(0, 90), np.arange(90, 200)
    split, _, _ = embedding_dedup.cell_links(x, weight, left, right, 0.9)
    assert (split[:90] == linked[:90, 90:] @ weight[90:]).all()
