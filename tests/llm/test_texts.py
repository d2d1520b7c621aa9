"""BPE, decontamination, line dedup, n-gram join and repeats against the library and brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import EDGE, LONG, edge, empty, words
from trackloom.llm import bpe, decontaminate, graph, linededup, ngramjoin, repeats
from trackloom.llm.bytesops import Words, shingles

SF = "/root/testdata/sf0.001"
VOCAB = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def texts_of(n, seed, alphabet="abcdefghijklmnopqrstuvwxyzABCéèßñ'’!.,-_<>|0123 \n\t\x85Σσςİ日本👍"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(str(VOCAB)), bpe.BPE(str(VOCAB))
    texts = [*texts_of(1500, 1), *texts_of(500, 2, "aehilnorst"), "", "<|endoftext|>hi<|startoftext|> x", "a\x1cb \x1f c", "don't I'LL we've '", "Σας ΣΑΣ", "_a__b", "ﬁ ŉ ǅ", LONG * 50]
    ids, decoded = own.encode_batch(texts)
    for text, i, d in zip(texts, ids, decoded):
        want = lib.encode(text, add_special_tokens=False).ids
        assert i.tolist() == want, text
        assert d == lib.decode(want, skip_special_tokens=False) == own.decode(i), text
    assert 0 < own.merged_exactly < own.proposed


def test_bpe_speculation_needs_verification():
    own = bpe.BPE(str(VOCAB))
    for word in ("hello", "antidisestablishmentarianism", "aaaaaaa", "thth", "zq"):
        exact = own.merge(own.symbols(word))
        assert own.encode_words([word])[0] == exact


def test_bpe_merges_long_words_in_time():
    import time

    from tokenizers import Tokenizer

    lib, own, r = Tokenizer.from_file(str(VOCAB)), bpe.BPE(str(VOCAB)), random.Random(3)
    words_ = ["".join(r.choice(a) for _ in range(n)) for a in ("ab", "aehilnorst", "abcdefghijklmnopqrstuvwxyz", "éèü日") for n in (65, 66, 200, 3000)] + ["a" * 5000, "ab" * 2000]
    for w in words_:
        assert own.encode_batch([w])[0][0].tolist() == lib.encode(w, add_special_tokens=False).ids
        assert own._merge_long(own.symbols(own._bytes(w[:150]))) == own.merge(own.symbols(own._bytes(w[:150])))
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    began = time.time()
    ids, decoded = own.encode_batch([long])
    assert time.time() - began < 60 and "".join(decoded[0].replace("</w>", "").split()) == long


def test_bpe_equals_the_library_on_every_code_point():
    import sys
    import unicodedata

    import regex
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(str(VOCAB)), bpe.BPE(str(VOCAB))
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and c < 0x20000]
    odd = [c for c in points if unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{N}]", c)]  # of which the tables' versions disagree
    every = [f"x{c}!" for c in points] + [f"{form[0]}{c}{form[1]}" for form in ("  ", " 1", "! ") for c in odd]
    differ = []
    for a in range(0, len(every), 20_000):
        texts = every[a : a + 20_000]
        want = lib.encode_batch_fast(texts, add_special_tokens=False)
        got = own.encode_batch(texts)[0]
        differ += [texts[k] for k, (w, g) in enumerate(zip(want, got)) if w.ids != g.tolist()]
    assert differ == []


def test_bpe_edges(spark):
    out = bpe.encode(edge(spark), str(VOCAB)).collect()
    assert len(out) == len(EDGE)
    assert all((len(r["ids"]) == 0) == (not r["decoded"]) for r in out)
    assert bpe.encode(empty(spark), str(VOCAB)).count() == 0
    again = bpe.decode(bpe.encode(edge(spark), str(VOCAB)).withColumnRenamed("decoded", "want"), str(VOCAB)).collect()
    assert all(r["want"] == r["decoded"] for r in again)


def contaminated(docs, items, window=13):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else []:
            wins[tuple(w[k : k + window])].add(i)
    sizes, out = {len(x) for x in wins}, []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        out.append((d, len(w), len(hit), sorted(i for i in found if i is not None)))
    return out


def test_decontamination_equals_brute_force(spark):
    r = random.Random(5)
    vocab = ["aa", "b", "C", "dé", "e1"]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.randint(0, 20)))) for k in range(12)] + [(None, "b b b"), (3, "only one")]
    docs = [(k, " ".join(r.choice([*vocab, "zz"]) for _ in range(r.randint(0, 80))) + r.choice(["", " " + r.choice(items)[1], "!"])) for k in range(60)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most, pass_bytes in ((decontaminate.AUTOMATON_WORDS, decontaminate.PASS_BYTES), (30, decontaminate.PASS_BYTES), (30, 4000)):  # one automaton, several, and several passes
        got = decontaminate.find(d, i, most=most, pass_bytes=pass_bytes).collect()
        assert sorted((x["doc_id"], x["n_words"], x["n_hit"], x["item_ids"]) for x in got) == sorted(contaminated(docs, items))


def test_automata_are_bounded_by_words(spark):
    """Items without spaces between words and items longer than a share come in shares of bounded words and bytes, no window lost."""
    items = [(1, ",".join(f"w{k}" for k in range(1000))), (2, "a" * 50), (3, None)] + [(10 + k, " ".join(f"x{k} y{k} {j}" for j in range(20))) for k in range(100)]
    i = spark.createDataFrame(items, "item_id long, text string")
    blobs = [bytes(r[0]) for r in decontaminate.automata(i, "item_id", "text", 13, 200).collect()]
    assert len(blobs) > 10 and max(map(len, blobs)) < 200_000
    docs = [(1, " ".join(f"w{k}" for k in range(1000))), (2, "x7 y7 3 x7 y7 4 x7 y7 5 x7 y7 6 x7 stop"), (3, "a" * 50)]
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), i, most=200, pass_bytes=300_000).collect()
    assert sorted((x["doc_id"], x["n_words"], x["n_hit"], x["item_ids"]) for x in got) == sorted(contaminated(docs, items))


def test_decontamination_removes(spark):
    item = " ".join(f"w{k}" for k in range(13))
    docs = [(1, item), (2, "clean " * 40), (3, "x " * 300 + item + " y" * 300), (4, None)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.remove(d, i).collect()} == {2, 3, 4}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove(d, i, coverage=None, longest=12).collect()}
    assert cut[1] == "" and cut[3] == "x " * 300 + " y" * 300 and cut[2] == "clean " * 40 and cut[4] is None


def test_decontamination_edges(spark):
    i = spark.createDataFrame([(1, None), (None, "one two"), (2, "")], "item_id long, text string")
    got = decontaminate.find(edge(spark), i).collect()
    assert len(got) == len(EDGE) and sum(r["n_hit"] for r in got) == 2
    assert decontaminate.find(empty(spark), i).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.find(edge(spark), i.limit(0)).collect())


def deduped(docs, least=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    where = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                where[key(x)].add(-1 if d is None else d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(where[key(x)]) >= min_docs and max(where[key(x)]) != (-1 if d is None else d))]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_docs():
    r = random.Random(4)
    pool = [f"line {k} " + "x" * 40 for k in range(6)] + ["É" * 40, "É" * 39, "short"]
    return [(k % 37, "\n".join(r.choice([p, p.upper(), f" \t{p}\r"]) for p in r.choices(pool, k=r.randint(0, 6)))) for k in range(60)] + [(None, pool[0]), (50, None)]


def test_line_dedup_equals_brute_force(spark):
    docs = line_docs()
    got = linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), shards=3).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got))) == sorted(map(str, deduped(docs)))


def test_line_dedup_edges(spark):
    got = linededup.dedup(edge(spark)).collect()
    assert len(got) == len(EDGE) and got[0]["block"] in {e[4] for e in EDGE}
    assert linededup.dedup(empty(spark)).count() == 0


def test_cuckoo_filter_inserts_and_deletes():
    r = np.random.default_rng(1)
    keys = np.zeros(5000, linededup.KEY)
    keys["hi"], keys["lo"] = r.integers(0, 2**63, 5000), r.integers(0, 2**63, 5000)
    f = linededup.CuckooFilter(4000)
    f.insert(keys[:4000])
    assert f.contains(keys[:4000]).all() and f.contains(keys[4000:]).mean() < 0.01
    f.delete(keys[:2000])
    assert f.contains(keys[2000:4000]).all() and f.contains(keys[:2000]).mean() < 0.01
    small = linededup.CuckooFilter(1)
    small.insert(keys[:50])  # more than fit: the overflow keeps them
    assert small.contains(keys[:50]).all()
    small.delete(keys[:50])
    assert not small.overflow and not small.slots.any()


def test_filter_survives_being_written():
    keys = np.zeros(300, linededup.KEY)
    keys["lo"] = np.arange(300)
    for capacity in (400, 1):
        f = linededup.CuckooFilter(capacity)
        f.insert(keys[:200])
        again = linededup.CuckooFilter.loads(f.dumps())
        assert (again.contains(keys) == f.contains(keys)).all() and again.overflow == f.overflow
        again.delete(keys[:100])
        assert again.contains(keys[100:200]).all()


def kept(df):
    return sorted(map(str, ((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect())))


@pytest.mark.parametrize("shard_keys", [200_000, 2])
def test_line_store_is_reversible(spark, tmp_path, shard_keys):
    """Insertions and deletions, each against brute force over the documents held, by the query's own path."""
    def frame(rows):
        return spark.createDataFrame(rows, "doc_id long, text string")

    docs = line_docs()
    store = linededup.LineStore(spark, f"file://{tmp_path}/lines", shard_keys=shard_keys)
    store.delete(frame(docs))  # an empty store holds nothing to delete
    store.insert(frame(docs))
    first = kept(store.dedup(frame(docs)))
    assert first == sorted(map(str, deduped(docs)))
    line = "line 0 " + "x" * 40
    extra = [(100 + k, f"{line}\nnew line {k // 6} " + "y" * 40) for k in range(12)] + [(None, "null " + "z" * 40), (36, line)]
    store.insert(frame(extra))
    assert kept(store.dedup(frame(docs + extra))) == sorted(map(str, deduped(docs + extra)))
    store.insert(frame(extra[:3]))  # once more changes nothing
    assert kept(store.dedup(frame(docs + extra))) == sorted(map(str, deduped(docs + extra)))
    part = [x for x in extra if x[0] in (111, 110, 106)]
    store.delete(frame(part))
    left = docs + [x for x in extra if x not in part]
    assert kept(store.dedup(frame(left))) == sorted(map(str, deduped(left)))
    store.delete(frame([x for x in extra if x[0] is not None and x[0] >= 100] + [(999, None)]))
    store.insert(frame([]))
    ids = {None, 36}
    again = docs + [x for x in extra if x[0] in ids]
    assert kept(store.dedup(frame(again))) == sorted(map(str, deduped(again)))
    reopened = linededup.LineStore(spark, store.path, shards=store.shards, version=store.version)
    assert kept(reopened.dedup(frame(again))) == sorted(map(str, deduped(again)))


def test_line_lookups_are_screened_by_filters(spark, tmp_path):
    """The filters settle all but the frequent keys and some false alarms before the counts are read, sent to the tasks or not."""
    docs = [(k, "\n".join([f"rare line number {k} {j} " + "x" * 30 for j in range(30)] + ["a frequent line, found in every document"])) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    store = linededup.LineStore(spark, f"file://{tmp_path}/lines")
    store.insert(df)
    passed = store.screened(df).count()
    assert 40 <= passed < 60 and store.counts().count() == 1201 and store.frequent().count() == 1
    want = kept(store.dedup(df))
    assert want == sorted(map(str, deduped(docs)))
    old, linededup.FILTER_BYTES = linededup.FILTER_BYTES, 0
    try:
        assert 40 <= store.screened(df).count() < 60 and kept(store.dedup(df)) == want  # keys and filters meet by shard
    finally:
        linededup.FILTER_BYTES = old


def near(docs, least=0.8, n=5):
    sets = [frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if (w := words(t)) else frozenset() for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (docs[find(k)][0], links[k]) for k, (d, _) in enumerate(docs)}


@pytest.mark.parametrize("n", [2, 3, 5])
def test_ngram_join_counts_once_where_blocks_are_empty(spark, n):
    """A cluster that its shingles cut into more blocks than it has classes."""
    r = random.Random(n)
    body = " ".join(str(r.randrange(10**6)) for _ in range(1500))
    rows = [(k, f"{body} {k} {k + 1}") for k in range(1, 4 * n, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for sizes in ({"block_shingles": 400}, {"block_shingles": 400, "block": 2}, {}):
        assert {tuple(x) for x in ngramjoin.join(df, **sizes).select("doc_id", "class_id", "n_links").collect()} == {(k, 1, n - 1) for k, _ in rows}


def test_ngram_join_equals_brute_force(spark):
    r = random.Random(6)
    base = [[f"w{r.randint(0, 500)}" for _ in range(80)] for _ in range(8)]
    docs = []
    for k in range(120):
        w = list(base[k % 8])
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w[r.randrange(len(w))] = f"e{r.randint(0, 99)}"
        docs.append((k, " ".join(w)))
    docs += [(200, "one two"), (201, "One, two!"), (202, "one"), (203, "..."), (204, "...")]
    want = near(docs)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for sizes in ({}, {"block": 4}, {"block_shingles": 500}):  # whole clusters, and clusters cut into blocks by members or shingles
        got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in ngramjoin.join(d, **sizes).collect()}
        assert got == want


def test_ngram_join_of_hot_classes_bands_and_hubs(spark):
    """A third of the rows equal, a third near copies: with small partitions, which adaptive execution splits, the result is the same."""
    r = random.Random(7)
    base = [f"w{r.randint(0, 500)}" for _ in range(80)]
    docs = [(k, " ".join(base)) for k in range(40)] + [(k, " ".join([*base[:79], f"e{k}"])) for k in range(40, 90)] + [(k, f"other text {k}") for k in range(90, 120)]
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in ngramjoin.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    finally:
        for k in small:
            spark.conf.unset(k)
    assert got == near(docs)


def test_ngram_join_recall_by_similarity(spark):
    """Pairs that no third document joins, from 0.80 to 0.90, with the shipped settings: all of 400 at each are found."""
    r, docs = random.Random(9), []
    for k in range(2000):
        words_ = 100
        w = [f"w{r.randrange(10**9)}" for _ in range(words_)]
        cut = (10, 9, 8, 6, 5)[k % 5]  # of 96 shingles, 96 - cut are common: similarities 0.81, 0.83, 0.85, 0.88, 0.90
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[: words_ - cut], *(f"x{r.randrange(10**9)}" for _ in range(cut))]))]
    rows = ngramjoin.join(spark.createDataFrame(docs, "doc_id long, text string")).where("n_links <> 1").collect()
    assert rows == []


def test_ngram_join_keeps_links_at_the_threshold(spark):
    r = random.Random(8)
    docs = []
    for k in range(8000):  # pairs of similarity 0.8 that no third document joins
        w = [f"w{r.randrange(10**9)}" for _ in range(40)]
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:36], *(f"x{r.randrange(10**9)}" for _ in range(4))]))]
    got = ngramjoin.join(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect()
    assert [x["doc_id"] for x in got if x["n_links"] != 1 or x["class_id"] != x["doc_id"] // 2 * 2] == []


def test_ngram_join_edges(spark):
    got = ngramjoin.join(edge(spark)).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["class_id"] == by[2]["class_id"] == 1 and by[1]["n_links"] == by[2]["n_links"] == 2 and by[4]["n_links"] == 0
    assert ngramjoin.join(empty(spark)).count() == 0


def test_bands_reach_the_recall():
    for s, recall in ((0.8, 0.999), (0.5, 0.95)):
        b = ngramjoin.bands_for(s, recall)
        assert 1 - (1 - s**4) ** b >= recall > 1 - (1 - s**4) ** (b - 1)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (7, 7), (None, 3), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, **{k: 20 for k in range(20, 26)}}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(50)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["node"]: x["root"] for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_shingles():
    text = pa.array(["a b c d e f", "one two", ""])
    data = np.frombuffer("".join(text.to_pylist()).encode(), np.uint8)
    value, row = shingles(Words(data, np.array([0, 11, 18, 18])))
    assert row.tolist() == [0, 0, 1]


def uncovered(docs, size=50):
    first = {}
    docs = [(-1 if d is None else d, (t or "").encode(), d) for d, t in docs]
    for d, b, _ in sorted(docs, key=lambda x: x[0]):
        for p in range(len(b) - size + 1):
            first.setdefault(b[p : p + size], d)
    out = []
    for d, b, own in docs:
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < d:
                cover[p : p + size] = True
        spans = int((cover & ~np.concatenate([[False], cover[:-1]])).sum()) if len(b) else 0
        out.append((own, len(b), int(cover.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 12, 1])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é"])
def test_repeats_equal_brute_force(spark, alphabet, hot):
    r = random.Random(3)
    base = ["".join(r.choice(alphabet) for _ in range(r.randint(30, 200))) for _ in range(6)]
    docs = [(k % 50, "".join(r.choice(base)[r.randint(0, 40) : r.randint(60, 200)] + r.choice(["", "x", "yz", " " * 60, "ab" * 40]) for _ in range(r.randint(0, 5)))) for k in range(60)]
    docs += [(None, base[0]), (70, None)]
    got = repeats.dedup(spark.createDataFrame(docs, "doc_id long, text string"), blocks=3, hot=hot).collect()
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in got]
    assert sorted(map(str, got)) == sorted(map(str, uncovered(docs)))


def test_repeats_edges(spark):
    got = repeats.dedup(edge(spark)).collect()
    assert len(got) == len(EDGE)
    assert repeats.dedup(empty(spark)).count() == 0


def test_a_passage_of_all_documents_is_no_shards_alone():
    """The suffixes at the edges of a hot passage aren't sent; its runs are, a key each, and inner ones once a block."""
    r = random.Random(1)
    passage = "".join(r.choice("abcdefghij") for _ in range(300))
    texts = ["".join(r.choice("klmnopqrst") for _ in range(80)) + passage + "".join(r.choice("klmnopqrst") for _ in range(80)) for _ in range(200)]
    t = pa.table({"k": pa.array(range(200), pa.int64()), "t": pa.array(texts), "block": pa.array([0] * 200, pa.int32())})
    offered = repeats.offer(t, 7)
    sizes = {}
    for hot in (None, 100):
        known = pa.concat_tables([repeats.repeated(offered.filter(pa.array([s == k for s in offered["shard"].to_pylist()])), hot) for k in sorted(set(offered["shard"].to_pylist()))])
        own = repeats.Suffixes(t, known, 7)
        sizes[hot] = len(own.rows), len(own.run_keys), np.bincount(own.run_shard, minlength=7).max(initial=0)
    assert sizes[None][0] > 400 and sizes[None][1] == 0  # hundreds of ends
    assert sizes[100][0] < 0.5 * sizes[None][0]  # anchors that lie in the edge itself, each in few documents
    assert sizes[100][2] < 0.25 * sizes[100][1]


def test_long_texts_come_in_pieces(monkeypatch):
    text = "".join(random.Random(2).choice("abcd") for _ in range(5000))
    whole = repeats.Block([1], pa.array([text]))
    monkeypatch.setattr(repeats, "PIECE", 700)
    pieces = repeats.Block([1], pa.array([text]))
    assert whole.at.tolist() == pieces.at.tolist()


def maximal(docs, least=50):
    """{content: occurrences} of the maximal repeats, by extending every pair of equal runs."""
    raw = {d: t.encode() for d, t in docs}
    starts = defaultdict(list)
    for d, b in raw.items():
        for p in range(len(b) - least + 1):
            starts[b[p : p + least]].append((d, p))
    out = set()
    for places in starts.values():
        for i, (d, p) in enumerate(places):
            for e, q in places[:i]:
                a, b, n, m = raw[d], raw[e], 0, least
                while p - n - 1 >= 0 and q - n - 1 >= 0 and a[p - n - 1] == b[q - n - 1]:
                    n += 1
                while p + m < len(a) and q + m < len(b) and a[p + m] == b[q + m]:
                    m += 1
                out.add(a[p - n : p + m])
    return {c: {(d, p) for d, b in raw.items() for p in range(len(b) - len(c) + 1) if b[p : p + len(c)] == c} for c in out}


@pytest.mark.parametrize("blocks", [1, 3])
def test_repeat_groups_are_the_maximal_repeats(spark, blocks):
    """Repeats of 60 to 700 bytes, between documents and within one, with all occurrences, against brute force."""
    r = random.Random(9)

    def some(n):
        return "".join(r.choice("abcdefghij") for _ in range(n))

    a, b, c, d = some(60), some(700), some(84), some(51)
    docs = [(1, "A" + a + "B" + b), (2, "C" + a + "D"), (3, "E" + a + "F" + a + "G"), (4, some(300)), (6, "H" + c + "I" + c), (7, some(70) + d), (8, d + "Y" + b + "Z"), (9, some(49))]
    rows = repeats.repeat_groups(spark.createDataFrame([*docs, (10, None), (11, "")], "doc_id long, text string"), blocks=blocks).collect()
    by = defaultdict(set)
    for x in rows:
        by[x["repeat"], x["length"]].add((x["doc_id"], x["start"]))
    got = {}
    for (_, n), places in by.items():
        content = {dict(docs)[d].encode()[s : s + n] for d, s in places}
        assert len(content) == 1
        got[content.pop()] = places
    want = maximal(docs)
    assert max(map(len, want)) == 700 and got == want


def test_repeat_with_a_part_that_occurs_elsewhere(spark):
    """As documented: the part comes with all its places, the rest up to its end without what only the part's context sees."""
    r = random.Random(4)
    b = "".join(r.choice("abcdefghij") for _ in range(700))
    docs = [(1, "A" + b), (2, "B" + b + "C"), (3, b[:400] + "X")]
    rows = repeats.repeat_groups(spark.createDataFrame(docs, "doc_id long, text string"), blocks=2).collect()
    by = defaultdict(set)
    for x in rows:
        by[x["repeat"], x["length"]].add((x["doc_id"], x["start"]))
    part = [p for (_, n), p in by.items() if n == 400]
    assert part == [{(1, 1), (2, 1), (3, 0)}]
    rest = [(n, p) for (_, n), p in by.items() if n != 400]
    assert [p for n, p in rest] == [{(1, 701 - rest[0][0]), (2, 701 - rest[0][0])}] and 300 < rest[0][0] < 400


def test_repeat_groups_edges(spark):
    got = repeats.repeat_groups(edge(spark)).collect()
    whole = {(r["doc_id"], r["start"]) for r in got if r["length"] == len(LONG)}
    assert {(1, 0), (2, 0), (None, 0)} <= whole
    assert repeats.repeat_groups(empty(spark)).count() == 0


def test_the_cover_comes_from_the_groups():
    """For each suffix of a shard, the reach that covers bytes is that of the maximal repeats of which a smaller document has a part."""
    r = random.Random(5)
    base = "".join(r.choice("ab") for _ in range(400))
    texts = ["".join(base[x : x + r.randint(40, 160)] for x in (r.randint(0, 300), r.randint(0, 300))) for _ in range(12)]
    shards = 1
    t = pa.table({"k": pa.array(range(12), pa.int64()), "t": pa.array(texts), "block": pa.array([0] * 12, pa.int32())})
    known = repeats.repeated(repeats.offer(t, shards))
    sent = repeats.Suffixes(t, known, shards).send(0)
    shard = repeats.Shard(sent)
    left, right = shard.reach()
    want = np.zeros((2, len(shard.rows)), int)
    for a, b, own in shard.groups():
        if a + b >= repeats.LENGTH:
            for k in own:
                if shard.least[k] > shard.least[own].min():
                    want[:, k] = np.maximum(want[:, k], (a, b))
    assert (left == want[0]).all() and (right == want[1]).all() and left.any()


def test_intervals_of_a_suffix_array():
    text = "banana$"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = []
    for a, b in zip(order, order[1:]):
        n = 0
        while text[a + n : a + n + 1] == text[b + n : b + n + 1] != "":
            n += 1
        lcp.append(n)
    assert {(d, sorted(order[a : b + 1])[0], b - a + 1) for d, a, b in repeats.intervals(lcp, 1)} == {(1, 1, 3), (3, 1, 2), (2, 2, 2)}
