"""Periodic runs against a comparison of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.helpers import EDGE, LONG, edge, empty
from trackloom.llm import periodic

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    """All runs, by walking along every period; of one stretch the smallest period counts."""
    best = {}
    for p in range(1, len(words) // 2 + 1):
        a = 0
        while a + p < len(words):
            b = a
            while b + p < len(words) and words[b] == words[b + p]:
                b += 1
            if b + p - a >= max(least, 2 * p):
                best.setdefault((a, b + p), p)
            a = b + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def lyndon_brute(s):
    return [max(k - i for k in range(i + 1, len(s) + 1) if all(s[i:k] < s[j:k] for j in range(i + 1, k))) for i in range(len(s))]


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_lyndon_arrays_equal_their_definition():
    r = random.Random(1)
    for _ in range(600):
        letters = r.choice([1, 2, 3, 5])
        s = [r.randrange(letters) for _ in range(r.randint(1, 30))]
        if r.random() < 0.4:
            s = (s * r.randint(1, 4))[: r.randint(1, 60)]
        assert periodic.lyndon_array(s, letters) == lyndon_brute(s), s
    for s in (thue_morse(64), fibonacci(89)):
        assert periodic.lyndon_array(s, 2) == lyndon_brute(s)


@pytest.mark.parametrize("least", [2, 3, 7, 12])
def test_runs_equal_brute_force(least):
    r = random.Random(least)
    for case in range(300):
        letters = r.choice([1, 2, 3, 8, 100])
        s = [r.randrange(letters) for _ in range(r.randint(0, 60))]
        while r.random() < 0.6:
            a = r.randrange(len(s) + 1)
            s = s[:a] + s[a : a + r.randint(0, 30)] * r.randint(1, 5) + s[a:]
        texts = [" ".join(map(str, s)), "", " ".join(map(str, s[::-1]))]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        words, found = periodic.chunk_runs(data, np.cumsum([0, *map(len, texts)]), least)
        want = [[(a, b, q) for a, b, q in brute(split(t), least)] for t in texts]
        got = [[(int(a - words.first[d]), int(b - a), int(p)) for a, b, p in found if words.doc[a] == d] for d in range(3)]
        assert got == want, (case, s)


def test_runs_of_words_that_hashes_confuse():
    """Sums of powers of an odd base agree on the halves of such words; the stretches are checked word by word."""
    s = thue_morse(1 << 13)
    for w in (s, fibonacci(6000)):
        words = [str(x) for x in w]
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        _, found = periodic.chunk_runs(data, np.array([0, len(data)]), 12)
        want = [(a, a + n, p) for a, n, p in brute(w[:6000])]
        assert [tuple(x) for x in found.tolist() if x[1] < 5500 and x[0] + 2 * x[2] < 5500] == [x for x in want if x[1] < 5500 and x[0] + 2 * x[2] < 5500]


def test_runs_of_a_long_text_take_linear_time():
    import time

    text = " ".join([f"w{i}" for i in range(50_000)] + ["a b c d e"] * 40_000)
    data = np.frombuffer(text.encode(), np.uint8)
    began = time.time()
    _, found = periodic.chunk_runs(data, np.array([0, len(data)]), 12)
    assert found.tolist() == [[50_000, 250_000, 5]] and time.time() - began < 30


def test_runs_on_edge_cases(spark):
    rows = {}
    for r in periodic.runs(edge(spark)).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) == len(EDGE)
    for key, text, *_ in EDGE:
        want = brute(split(text)[:2000]) if text and len(text) > 50_000 else brute(split(text))
        for r in rows[key]:
            if text and len(text) > 50_000:
                (run,) = r.runs
                assert (run.start, run.period) == want[0][::2] and run.length == len(split(text)) and r.collapsed == LONG
            elif key is not None:
                assert [(x.start, x.length, x.period) for x in r.runs] == want and r.collapsed == collapsed(split(text), want) and r.n_words == len(split(text))
    assert periodic.runs(empty(spark)).collect() == []
    named = spark.createDataFrame([("x", "a b " * 9, 1)], "name string, body string, k int")
    (row,) = periodic.runs(named, "name", "body").collect()
    assert row.name == "x" and [tuple(x) for x in row.runs] == [(0, 18, 2)] and row.collapsed == "a b"


def cycled(key, words):
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = periodic.op13_runs(spark, SF).collect()
    assert len(out) == len(texts)
    some = 0
    for r in out:
        words = cycled(r.doc_id, split(texts[r.doc_id]))
        want = brute(words)
        some += len(want)
        top = max(want, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, want).encode()).hexdigest()
    assert some > 10
