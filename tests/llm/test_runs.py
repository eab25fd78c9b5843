"""Operator 12 against brute force: runs, their periods, collapsed texts, and the registered query's damage and digests."""

import hashlib
import random
import re
import zlib

import numpy as np

from tickflow.llm import queries, runs
from tickflow.llm.frames import prepare

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(x):
    """All runs by comparing every word with the one a period later."""
    out = set()
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            b = i + q
            if b - a >= max(6, 4 * q) and not any(x[a:b - r] == x[a + r:b] for r in range(1, q)):
                out.add((a, b - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(x):
    gone = set()
    for start, length, period in brute(x):
        gone |= set(range(start + period, start + length))
    return " ".join(w for i, w in enumerate(x) if i not in gone)


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    for size in (2, 4, 32):
        a = rng.integers(0, runs.PRIME, (3, 2 * size)).astype(np.uint64)
        powers, inverse = runs.roots(2 * size), runs.roots(2 * size, inverse=True)
        assert (runs.backward(runs.forward(a, powers), inverse) == a).all()
        window = rng.integers(0, 50, (4, 2 * size))
        block = window[:, 1:size + 1]
        sums = runs.mismatches(block.astype(np.uint64), window.astype(np.uint64), powers, inverse)
        own = [[int(((b - w[d:d + size]) ** 2).sum()) for d in range(size + 1)] for b, w in zip(block, window)]
        assert sums.tolist() == own


def test_find_runs_equals_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(0, 150)
        x = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(n)]
        if n > 20 and rng.random() < 0.7:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 4))
            x = x[:a] + [x[a + (i - a) % p] for i in range(a, n)]
        got = runs.find_runs(np.array([*x, 99]), n)
        assert sorted((a, b - a, q) for a, b, q in got.tolist()) == sorted(brute(x))


def fixture(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "é", "word", "W"])
    prose = lambda n: [rng.choice(["x", "y"]) + str(rng.randrange(300)) for _ in range(n)]
    texts = [None, "", " \n\t ", "one", "a a a a a", "a a a a a a", " a\tb a\nb  a b a b a"]
    texts += [" ".join(prose(k) + [word() for _ in range(p)] * t + prose(k)) for k, p, t in
              [(10, 3, 4), (0, 7, 5), (50, 40, 4), (3, 40, 3), (100, 1, 2000), (7, 300, 5)]]
    texts += [" ".join(word() for _ in range(rng.randint(1, 200))) for _ in range(30)]
    texts += [texts[7]] * 3
    rows = [(i, t, "mine", 1.5) for i, t in enumerate(texts)] + [(None, "a a a a a a a", None, None), (3, texts[3], "mine", 1.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words double")


def test_periodic_runs(spark):
    prepare(spark)
    docs = fixture(spark)
    out = runs.periodic_runs(docs.repartition(3)).collect()
    assert len(out) == docs.count()
    assert list(out[0].asDict()) == ["doc_id", "text", "n_words", "runs", "collapsed"]
    for r in out:
        words = WORD.findall(r["text"] or "")
        assert r["n_words"] == len(words)
        assert [tuple(x) for x in r["runs"]] == brute(words)
        assert r["collapsed"] == collapsed(words)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(rng.randint(0, 300)))) for i in range(150)]
    rows += [(-5, None), (-7, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    damaged = 0
    for doc_id, text in rows:
        x = WORD.findall(text or "")
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and x:
            g = h // 10
            a = g % len(x)
            p = 1 + (len(x) - a) // (3 + g % 8)
            x = x[:a] + [x[a + (i - a) % p] for i in range(a, len(x))]
            damaged += 1
        found = brute(x)
        r = out[doc_id]
        best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % f for f in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(x).encode()).hexdigest()
    assert damaged > 5
