"""Collocations against a count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import EDGE, LOWER, edge, empty
from trackloom.llm import phrases


def brute(rows, least, longest=5):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    often = {key: c for key, c in f.items() if c >= least}
    inside = set()
    for (lang, ws), c in often.items():
        for i in range(len(ws)):
            for j in range(i + 2, len(ws) + 1):
                part = ws[i:j]
                if len(part) < len(ws) and 100 * c >= 100 * often[lang, part]:
                    inside.add((lang, part))
    out = {}
    for (lang, ws), a in often.items():
        if len(ws) > 1 and (lang, ws) not in inside:
            score, k = min((1000 * a * n[lang] // (often[lang, ws[:k]] * often[lang, ws[k:]]), k) for k in range(1, len(ws)))
            out[lang, " ".join(ws)] = (len(ws), a, often[lang, ws[:k]], often[lang, ws[k:]], n[lang], score)
    return out


def found(df, **options):
    return {(r.lang, r.phrase): (r.words, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, **options).collect()}


@pytest.mark.parametrize("block_bytes", [1, 3000, 1 << 25])
def test_collocations_equal_brute_force(spark, block_bytes):
    r = random.Random(5)
    vocabulary = ["the", "of", "and", "New", "york", "city", "é", "日本", "a\x01", "a", "x\x00y", "aa"]
    fixed = ["the New york city of", "é日本 é日本", "a a a a a a", "new york"]
    rows = []
    for i in range(300):
        words = [r.choice(fixed) if r.random() < 0.3 else r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        rows.append((i, "".join(w + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " \x0b"]) for w in words), r.choice(["en", "de", None, "und"])))
    rows += [(400, None, "en"), (401, "", None), (402, "  .. ,", "de"), (403, "new york " * 3000, "en"), (404, "new york", "only")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = brute([(t, x) for _, t, x in rows], 5)
    assert found(df, least=5, block_bytes=block_bytes) == want and len({k[0] for k in want}) == 3 and max(v[0] for v in want.values()) == 5


def test_collocations_of_other_lengths(spark):
    rows = [(1, "a b c d e f g. a b c d e f g, b c", "en")] * 7
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for longest in (2, 3, 7):
        assert found(df, least=3, longest=longest) == brute([r[1:] for r in rows], 3, longest)


def test_collocations_on_edge_cases(spark):
    want = brute([(r[1], r[2]) for r in EDGE], 3)
    assert found(edge(spark), least=3) == want and want
    assert found(empty(spark)) == {}


def test_score_expression_is_exact(spark):
    a, n, l, r = 3 * 10**9, 10**15, 4 * 10**9, 5 * 10**9 + 7
    df = spark.createDataFrame([(a, n, [l, a], [r, 100])], "a long, n long, ls array<long>, rs array<long>")
    assert df.select(phrases.scores("a", "n", "ls", "rs").alias("s")).first().s == [1000 * a * n // (l * r), 10 * n]


def test_query_ranks_ties_by_bytes(spark, tmp_path):
    rows = [(i, "b a. é a. a b. z z", "en") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = [(r["rank"], r.phrase) for r in phrases.op11_phrases(spark, str(tmp_path)).orderBy("rank").collect()]
    want = sorted(((-v[5], -v[1], k[1].encode()) for k, v in brute([r[1:] for r in rows], 100).items()))
    assert out == [(i + 1, p.decode()) for i, (_, _, p) in enumerate(want)]


def test_blocks_exchange_pairs_in_a_few_bytes(spark):
    r = random.Random(8)
    vocabulary = [f"{i:x}{chr(97 + i % 26)}" for i in range(700)]
    rows = [(" ".join(r.choices(vocabulary, k=1000)), "en") for _ in range(480)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "text string, lang string").localCheckpoint()
    sent = lambda: spark._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = sent()
    assert found(df, least=8, longest=2) == brute(rows, 8, 2)
    pairs = sum(len({p for t, _ in rows[i : i + 120] for w in [t.split()] for p in zip(w, w[1:])}) for i in range(0, 480, 120))
    assert pairs > 400_000 and sent() - before < 8 * pairs


@pytest.mark.parametrize("width", [1, 9, 32])
def test_keys_of_pairs_can_be_undone_and_are_dealt_evenly(width):
    keys, top = phrases.Keys(width, 8), min(1 << width, 300)
    p, s = (x.ravel() for x in np.meshgrid(np.arange(top), (1 << width) - 1 - np.arange(top)))
    key = np.sort(keys.of(p, s))
    assert len(np.unique(key)) == len(p) and set(zip(*keys.pairs(key))) == set(zip(p, s))
    cuts = keys.cuts(key)
    assert cuts[0] == 0 and cuts[-1] == len(key) and (np.diff(cuts) >= 0).all()
    if width > 1:
        assert np.abs(np.diff(cuts) / (len(key) / 8) - 1).max() < 0.1
