"""Whitening against eigenvectors, and the audit of sources against brute force and SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import divergence, whitening
from ferrule.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, same

VECTORS = "vec_id long, embedding array<double>, component string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(k, v, "clash") for k, v in rows], VECTORS)


def quantized(v, scale=256):
    if v is None or any(c is None or not math.isfinite(c) for c in v):
        return None
    return [math.floor(scale * c) for c in v]


def check_against_eigenvectors(rows, found, scale=256, loose=1e-7):
    """``found`` rows against the eigenvectors of the exact covariance of the distinct vectors."""
    width = max((len(q) for _, v in rows if (q := quantized(v, scale)) is not None), default=0)
    kept = [(k, [*q, *[0] * (width - len(q))]) for k, v in rows if (q := quantized(v, scale)) is not None]
    fit = sorted({tuple(q) for _, q in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    apart = np.array([[n * c - s for c, s in zip(q, sums, strict=True)] for q in fit], np.float64) / n
    values, parts = np.linalg.eigh(apart.T @ apart / n)
    values, parts = values[::-1], parts[:, ::-1]
    k = min(4, int((values > 1e-13 * values[0]).sum()))
    assert {r.component for r in found} == set(range(1, k + 1))
    got = defaultdict(list)
    for r in found:
        got[r.vec_id, r.component].append(r)
        assert r.n == n and r.identity_error <= 1e-4
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-6)
    assert len(found) == k * len(kept)
    signs = {}
    for vec_id, q in kept:
        exact = [n * c - s for c, s in zip(q, sums, strict=True)]
        for c in range(1, k + 1):
            r = got[vec_id, c][0]
            assert r.deviation == (d if (d := sum(e * e for e in exact)) < 1 << 63 else None)
            whitened = float(np.array(exact, np.float64) / n @ parts[:, c - 1] / math.sqrt(values[c - 1]))
            if abs(whitened) > 1e-3:
                sign = signs.setdefault(c, math.copysign(1, whitened * r.whitened))
                assert sign * r.whitened == pytest.approx(whitened, rel=loose, abs=loose)


def test_whitened_coordinates_are_those_of_the_eigenvectors(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 8)) * [9, 1, 5, 1, 3, 2, 1, 1] + rng.normal(size=(300, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(mixed)]
    rows += [(k, rows[0][1]) for k in range(300, 500)]  # a hot vector counts once
    rows += [(500, None), (501, [1.0, None, 0.0]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (None, rows[4][1]), (4, rows[4][1]), (504, [-0.0] * 8), (505, [0.5, -0.25])]
    found = whitening.whiten(vectors_of(spark, rows).repartition(5)).collect()
    check_against_eigenvectors(rows, found)
    assert found[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}


def test_columns_far_apart_in_size_and_columns_that_depend_on_others(spark):
    rng = np.random.default_rng(5)
    sizes = rng.normal(size=(200, 5)) * [1e5, 1e3, 10, 0.1, 0.02] + [1e6, 0, 0, 0, 0]
    rows = [(k, v.tolist()) for k, v in enumerate(sizes)]
    check_against_eigenvectors(rows, whitening.whiten(vectors_of(spark, rows)).collect(), loose=1e-5)
    flat = rng.integers(-9, 9, (100, 2)) @ [[1.0, 2.0, 0.0, 3.0], [0.0, 1.0, 0.0, -1.0]]
    rows = [(k, (v / 256 + 1e-9).tolist()) for k, v in enumerate(flat)]
    check_against_eigenvectors(rows, whitening.whiten(vectors_of(spark, rows)).collect())
    rows = [(k, [float(k == 1), 0.0, float(k)]) for k in range(3)]  # fewer vectors than dimensions
    check_against_eigenvectors(rows, whitening.whiten(vectors_of(spark, rows)).collect())


def test_vectors_without_spread_and_numbers_beyond_64_bits(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])], [(1, None)]):
        assert whitening.whiten(vectors_of(spark, rows)).collect() == []
    found = whitening.whiten(vectors_of(spark, [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 3.0])])).collect()
    assert {r.vec_id for r in found} == {1, 2, 3} and {r.deviation for r in found if r.vec_id != 2} == {None} and found[0].identity_error < 1e-4


def test_passes_end_with_factors_that_give_the_covariance(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-500, 500, (400, 7))
    x[:, 6] = x[:, 0] * 1000 + x[:, 6] % 3
    rows = spark.createDataFrame([(v.tolist(),) for v in np.unique(x, axis=0)], "x array<long>")
    fitted = whitening.components(rows, 7, most=7)
    apart = np.unique(x, axis=0) - np.unique(x, axis=0).mean(axis=0)
    values = np.linalg.svd(apart, compute_uv=False) ** 2 / len(apart)
    assert np.allclose(fitted.values, values, rtol=1e-9) and np.allclose(fitted.components.T @ fitted.components, np.eye(7), atol=1e-12)
    factor = whitening._factor(np.diag([4.0, 1.0]))
    assert np.allclose(whitening._solved(np.array([[2.0, 3.0]]), factor) @ factor, [[2.0, 3.0]])


# --- divergence ----------------------------------------------------------------


def brute_audit(rows):
    """(lang, source, part, item, value, rank) by loops; rows are (text, lang, source)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))
        held[lang].update(set(found))
        counts[lang, source].update(found)
        groups.add((lang, source))
    out = []
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= 30]
        others = [s for g, s in groups if g == lang]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in others}

        def frequency(n, whole, v=len(kept)):
            return 1 + 10**9 * (n + 5) // (whole + 5 * v)

        p = {s: {t: frequency(counts[lang, s][t], total[s]) for t in kept} for s in others}
        q = {t: frequency(sum(counts[lang, s][t] for s in others), sum(total.values())) for t in kept}
        pairs = [(s, sum(abs(p[source][t] - p[s][t]) for t in kept)) for s in others if s != source]
        terms = [(t, p[source][t] - q[t]) for t in kept if counts[lang, source][t] and p[source][t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, 50)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)] + ["Écoute", "éCOUTE", "漢字", "𝒳y", "naïve", "ZED"]
    rows = []
    for _ in range(n):
        source = rng.choice(["hot"] * 4 + ["a", "b", "É", "z", "", None])
        text = rng.choice([" ", "-", "\n", "1", "\x00", "_"]).join(rng.choice(words[: rng.choice([20, 80, 200])]) for _ in range(rng.choice([0, 3, 40, 200])))
        rows.append((text, rng.choice(["en", "en", "de", None, ""]), source))
    return [*rows, (None, "en", "only null"), ("", "xx", "s"), ("rare", "xx", "t"), ("123 !", "yy", "alone"), *[("w", "en", "hot")] * 3, ("long " * 50_000, "en", "a")]


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"TERMS": 16, "GROUPS": 3, "SLICE": 5, "TILE": 2, "HELD": 50, "STRETCH": 10})])
def test_the_audit_is_that_of_brute_force(spark, monkeypatch, seed, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(seed)
    docs = spark.createDataFrame([(7, t, g, s, "clash", 1, 2) for t, g, s in rows], "doc_id long, text string, lang string, source string, term string, n int, group int").repartition(7)
    found = sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.audit(docs).collect())
    assert found == brute_audit(rows)


def test_distances_come_from_joint_tables():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 4, (300, 21))
    prices = 10**9 // (counts + np.arange(1, 22))
    expected = np.abs(prices[:, :, None] - prices[:, None, :]).sum(axis=0)
    assert (divergence._distances((counts, counts[:, :7]), (prices, prices[:, :7])) == expected[:, :7]).all()
    matrix, price, first = divergence._levels(counts[:10], prices[:10])
    assert (matrix.sum(axis=1) == 21).all() and len(price) == matrix.shape[1] and first[0] == 0
    joint = matrix.T @ matrix
    assert joint.sum() == 10 * 21 * 21


def test_an_audit_of_nothing(spark):
    docs = spark.createDataFrame([(None, None, None)], "text string, lang string, source string")
    assert divergence.audit(docs).count() == 0 and divergence.audit(docs.where("false")).count() == 0
    two = docs.unionByName(docs.withColumn("source", F.lit("s")))
    assert [tuple(r) for r in divergence.audit(two).orderBy("source").collect()] == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def test_the_audit_gives_the_rows_of_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    same(QUERIES["op13_divergence"](spark, folder), connect(folder), ORACLE_SQL["op13_divergence"])


def test_whitening_of_the_whole_table(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    check_against_eigenvectors(rows, QUERIES["op11_whitening"](spark, data).collect())
