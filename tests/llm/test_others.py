"""Toxicity, quality, chat, media, WARC and the pipeline."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import EDGE, LONG, edge, empty
from trackloom.llm import bpe, chat, chroma, quality, toxicity, warc
from trackloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_toxicity_is_ordered_and_right():
    r = np.random.default_rng(1)
    plain = [f"word{k}" for k in range(200)]
    texts, toxic = [], []
    for k in range(300):
        bad = k % 4 == 0
        w = list(r.choice(plain, 40))
        if bad:
            w += list(r.choice(["vile", "foul", "nasty"], 1 + k % 9))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    m = toxicity.fit([toxicity.bag(t) for t in texts], np.array(toxic))
    assert (np.diff(m.thresholds) > 0).all()
    p = m.grades(np.array([m.logit(t) for t in texts]))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert ((1 - p[:, 0] >= 0.5) == np.array(toxic)).mean() > 0.98
    mild, harsh = m.logit(" ".join([*plain[:40], "vile"])), m.logit(" ".join([*plain[:40], *["vile", "foul", "nasty"] * 4]))
    severity = m.grades(np.array([mild, harsh])) @ np.arange(4)
    assert severity[1] > severity[0]


def test_toxicity_edges(spark):
    m = toxicity.fit([], np.zeros(0, int))
    got = toxicity.score(edge(spark), m).collect()
    assert len(got) == len(EDGE) and not any(r["p_toxic"] >= 0.5 for r in got)
    assert toxicity.score(empty(spark), m).count() == 0
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    toxicity.train(edge(spark), labels)
    toxicity.train(empty(spark), labels.limit(0))


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n1 = label.sum()
    return (rank[label > 0].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_toxicity_held_out(spark):
    """On rows that training didn't see: found, right, calibrated at every threshold, severity in order, better than the rate of marker words alone."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = toxicity.train(docs, labels.where("doc_id % 4 <> 0"))
    rows = toxicity.score(docs, m).join(labels.where("doc_id % 4 = 0"), "doc_id").select("p_toxic", "severity", "grade", "toxic", "text").collect()
    p, severity, grade, toxic = (np.array([r[k] for r in rows], float) for k in range(4))
    hit = p >= 0.5
    assert hit[toxic > 0].mean() > 0.85 and toxic[hit].mean() > 0.85 and (hit == toxic).mean() > 0.95
    assert auc(severity, toxic) > 0.97 and abs(p.mean() - toxic.mean()) < 0.05
    share = [toxic[(severity >= a) & (severity < b)].mean() for a, b in ((0, 0.5), (0.5, 1.5), (1.5, 3.1)) if ((severity >= a) & (severity < b)).any()]
    assert share == sorted(share)  # toxic rows are more frequent where severity is higher
    chances = m.grades(np.array([m.logit(r["text"]) for r in rows]))
    for k in (1, 2):  # among all rows the predicted chance of a higher grade is near its frequency
        assert abs(chances[:, k + 1 :].sum(axis=1).mean() - (grade > k).mean()) < 0.05


def test_quality_gradient():
    net = quality.ByteNet(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    texts, y, w = [b"abc###de" * 50, b"plain text here", b""], np.array([0.0, 1.0, 1.0]), np.ones(3)

    def loss():
        z = []
        for t in texts:
            data, offsets = np.frombuffer(t, np.uint8), np.array([0, len(t)])
            doc, inside, first = net.layout(offsets)
            parts = list(net.slices(data, offsets, doc, inside))
            raw, valid = (np.concatenate([x[k] for x in parts]) for k in (1, 2))
            tables = np.einsum("be,wef->wbf", net.p["embed"], net.p["filter"])
            out = sum(tables[j][raw[:, j : j + net.CHUNK]] for j in range(net.WIDTH))
            out[~valid] = -1e9
            z.append((net._features(np.maximum(out.max(axis=1) + net.p["bias"], 0), first) @ net.p["out"] + net.p["base"])[0])
        z = np.array(z)
        return float(np.sum(w * (np.log1p(np.exp(z)) - y * z)))

    got = net._gradient(texts, y, w)
    for name, at in (("out", (2,)), ("filter", (1, 2, 3)), ("embed", (97, 1)), ("base", (0,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert got[name][at] == pytest.approx((up - down) / 2e-5, rel=2e-2, abs=2e-4)


def test_quality_edges_and_fold(spark):
    net = quality.ByteNet()
    got = quality.score(edge(spark), net).collect()
    assert len(got) == len(EDGE) and all(0 < r["score"] < 1 for r in got)
    assert quality.score(empty(spark), net).count() == 0
    folds = spark.range(50).select("id", quality.fold(quality.F.col("id")).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in folds)
    quality.train(empty(spark), spark.createDataFrame([], "doc_id long, quality int"))
    one = quality.ByteNet().score(pa.array([LONG * 30]))
    assert quality.ByteNet().score(pa.array(["x", LONG * 30, None]))[1] == pytest.approx(one[0], abs=1e-6)


def test_quality_held_out(spark):
    rows = QUERIES["op8_quality"](spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    score, quality_ = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    predicted = np.array([r["predicted"] for r in rows])
    assert (predicted == quality_).mean() > 0.9 and auc(score, quality_) > 0.95
    assert all((predicted == quality_)[quality_ == k].mean() > 0.75 for k in (0, 1))


def test_quality_equals_a_slow_convolution():
    net, r = quality.ByteNet(4), np.random.default_rng(1)
    texts = ["", "a", "abcdefg", "".join(map(chr, r.integers(32, 127, 255))), "".join(map(chr, r.integers(32, 127, 257))), "".join(map(chr, r.integers(32, 400, 40_000)))]
    tables, want = net.tables(), []
    for t in texts:
        raw = t.encode()
        padded, best = raw + bytes(net.WIDTH), {}
        for at in range(max(len(raw), 1)):  # every window that begins in the text, padded with zeros
            out = sum(tables[j][padded[at + j]] for j in range(net.WIDTH))
            best[at // net.CHUNK] = np.maximum(best.get(at // net.CHUNK, -np.inf), out)
        pooled = np.maximum(np.array(list(best.values())) + net.p["bias"], 0)
        z = np.concatenate([pooled.max(axis=0), pooled.mean(axis=0)]) @ net.p["out"] + net.p["base"][0]
        want.append(1 / (1 + np.exp(-float(z))))
    assert np.allclose(net.score(pa.array(texts)), want, atol=1e-5)


def test_quality_scores_long_texts_in_bounded_memory():
    import tracemalloc

    text = pa.array([(LONG + "\n") * (64_000_000 // len(LONG))])
    net = quality.ByteNet(4)
    tracemalloc.start()
    net.score(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000


@pytest.mark.parametrize("text", ["", "\\", "[INST]", "\\[INST]", "a</s>b<s>\\\\", "<|end|>" * 3, "[\\INST]", "<<SYS>>é\n", "<|im_start|>system"])
def test_chat_escapes_reversibly(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROL)


def test_chat_masks():
    mask = chat.masks(np.array([5, 3, 6]), np.array([0, 0, 2]), np.array([0, 0, 5]))
    assert mask.tolist() == [0] * 10 + [1, 1, 1, 0]


def turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST]\\ yes"), (1, 2, "tool", None), (2, 0, None, ""), (2, None, "assistant", "é" * 500), (None, 0, "assistant", "lost"), (3, 0, "user", "<|end|>"), (3, 0, "user", "<|end|>"), (3, 0, "assistant", "tie")]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")


@pytest.mark.parametrize(("part", "block"), [(8192, 256), (4, 256), (8192, 1), (50, 7)])
def test_chat_reads_back(spark, part, block):
    rows, df = turns(spark)
    long = [(8, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(-5, 60)]  # in blocks of turns
    rows, df = rows + long, df.unionByName(spark.createDataFrame([(*r, "x") for r in long], df.schema))
    path = chat.vocabulary_path()
    got = {r["conv_id"]: r for r in chat.read_back(chat.assemble(chat.encode_turns(df, path), part, block), path).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-99 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for _, r, x in own if r == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert tuple(got[conv])[1:5] == want
    assert chat.read_back(chat.format_chats(df.limit(0), path), path).count() == 0


def test_chat_text_holds_no_foreign_control(spark):
    _, df = turns(spark)
    path = chat.vocabulary_path()
    for r in chat.format_chats(df, path).collect():
        text = chat.text_of(np.frombuffer(r["ids"], "<u4"), path)
        assert len(text) == r["chars"] and "[INST]" not in text and text.count("<|turn|>") == text.count("<|end|>")


def test_quality_learns_from_all_parts_of_long_texts(spark):
    most = quality.STRETCHES * quality.STRETCH_BYTES
    texts = [None, "", "é" * 10, "x" * most, "".join(chr(97 + k % 26) for k in range(most + 1)), "a" * (5 * most) + "z"]
    got = [bytes(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(quality.stretches(F.col("t"))).collect()]
    assert got[:4] == [(t or "").encode() for t in texts[:4]] and [len(g) for g in got[4:]] == [most, most]
    assert got[4][: quality.STRETCH_BYTES] == texts[4].encode()[: quality.STRETCH_BYTES] and got[5].endswith(b"az") and got[4][-9:] == texts[4].encode()[-9:]


def test_chroma_aligns_a_cut_and_noisy_copy():
    r = np.random.default_rng(4)
    songs = [r.normal(0, 0.125, 64) for _ in range(12)]
    prints = [chroma.fingerprint(chroma.chroma(chroma.render(s))) for s in songs]
    index = chroma.Index(prints)
    cut = chroma.render(songs[5])[3 * chroma.HOP :]
    found = list(index.matches(chroma.fingerprint(chroma.chroma(cut + r.normal(0, 0.2, len(cut)).astype(np.float32)))))
    assert [x[0] for x in found] == [5] and found[0][1] == -3 and found[0][3] < 0.15


def test_chroma_of_odd_and_long_pcm(spark, monkeypatch):
    song = (chroma.render(np.random.default_rng(3).normal(0, 0.125, 64)) * 20000).astype("<i2").tobytes()
    rows = [(1, song), (2, song + b"x"), (3, b"x"), (4, None), (None, song[:3])]
    got = {r["k"]: r["prints"] for r in chroma.fingerprints(spark.createDataFrame(rows, "id long, pcm binary"), "id", "pcm").collect()}
    assert got[1] == got[2] and len(got[1]) > 50 and got[3] == got[4] == [] and len(got[None]) == 1
    pcm = chroma.render(np.random.default_rng(3).normal(0, 0.125, 64))
    whole = chroma.chroma(pcm)
    monkeypatch.setattr(chroma, "SPECTRA", 7)
    assert np.allclose(chroma.chroma(pcm), whole)


def test_chroma_octaves_share_a_class():
    t = np.arange(8000) / chroma.RATE
    low, high = (chroma.chroma(np.sin(2 * np.pi * f * t)).mean(axis=0).argmax() for f in (220.0, 440.0))
    assert low == high == 0


def test_chroma_search_equals_brute_force(spark):
    r = np.random.default_rng(2)
    songs = [r.normal(0, 0.125, 64) for _ in range(10)]
    rows = [(k, [float(x) for x in songs[k % 10] + (0.002 * r.normal(0, 1, 64) if k >= 10 else 0)]) for k in range(25)] + [(30, None), (None, [0.1] * 64), (31, [float(x) for x in songs[0]])]
    prints = chroma.fingerprints(chroma.recordings(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), "vec_id", "pcm")
    got = {x["k"]: (x["query"], x["offset"]) for x in chroma.search(prints, every=5).collect()}
    held = {x["k"]: np.array(x["prints"], np.int64) for x in prints.collect()}
    for k, own in held.items():
        best = None
        for q in (x for x in held if x is not None and x % 5 == 0 and len(held[x])):
            if len(own):
                for _, d, _, e in chroma.Index([own]).matches(held[q]):
                    best = min(best or (9, 0, 0), (e, q, d))
        assert got[k] == ((best[1], best[2]) if best else (None, None))
    assert len(got) == 28 and got[0] == (0, 0) and got[31][0] == 0
    assert chroma.search(prints.limit(0)).count() == 0


def test_chroma_align_finds_all_that_brute_force_finds():
    r = np.random.default_rng(6)
    base = r.integers(0, 2**24, 62)

    def noisy(own, share):
        flips = (r.random((len(own), 24)) < share) @ (1 << np.arange(24))
        return own ^ flips

    prints = [noisy(base, x) for x in (0.05, 0.12, 0.15, 0.17, 0.19, 0.25)] + [noisy(base[20:50], 0.15), np.tile(base[:9], 6), base[:5], r.integers(0, 2**24, 40), np.zeros(0, np.int64)]
    queries = [base, np.concatenate([r.integers(0, 2**24, 7), base]), np.tile(base[:9], 3), base[2:4], np.zeros(0, np.int64)]
    want = []
    for q, a in enumerate(queries):
        for t, b in enumerate(prints):
            least, tries = min(chroma.MIN_OVERLAP, len(a), len(b)), []
            for d in range(least - len(b), len(a) - least + 1) if least else ():
                start, stop = max(d, 0), min(len(a), len(b) + d)
                tries.append((chroma.bit_errors(a[start:stop], b[start - d : stop - d]), start - stop, d))
            if tries and min(tries)[0] <= chroma.MAX_BIT_ERRORS:
                e, n, d = min(tries)
                want.append((q, t, d, -n, e))
    got = sorted(zip(*(x.tolist() for x in chroma.align(queries, prints))))
    assert got == want and {(0, k) for k in range(5)} <= {x[:2] for x in want}


def test_chroma_aligns_long_recordings():
    """Unequal bits of thousands of frames; unrelated ones don't match, a noisy part of a long one does, at its place."""
    r = np.random.default_rng(9)
    a, b = r.integers(0, 2**24, (2, 6000))
    flips = (r.random((5600, 24)) < 0.15) @ (1 << np.arange(24))
    part = a[300:5900] ^ flips
    queries, targets, offset, overlap, errors = chroma.align([a, b], [part, r.integers(0, 2**24, 5600)])
    assert (queries.tolist(), targets.tolist(), offset.tolist(), overlap.tolist()) == ([0], [0], [300], [5600])
    assert errors[0] == chroma.bit_errors(a[300:5900], part) and 0.14 < errors[0] < 0.16


def test_chroma_correlation_equals_the_histogram_in_less_time(monkeypatch):
    """Fingerprints of all lengths, constant and random bits, noisy pieces with errors about the limit, queries and targets in several blocks."""
    import time

    r = np.random.default_rng(21)
    songs = [r.integers(0, 2**24, int(n)) for n in (1, 2, 9, 15, 16, 17, 40, 62, 62, 100, 255, 256)]

    def noisy(x, share):
        return x ^ ((r.random((len(x), 24)) < share) << np.arange(24)).sum(axis=1)

    targets = [noisy(x[a:b], share) for x in songs for a, b in ((0, None), (3, -2), (None, 20)) for share in (0.0, 0.15, 0.19, 0.21)]
    targets += [np.zeros(n, np.int64) for n in (5, 30, 200)] + [np.full(70, 2**24 - 1), np.zeros(0, np.int64)] + [r.integers(0, 2**24, 300)]
    queries = [*songs, *(noisy(x, 0.1) for x in songs), np.zeros(40, np.int64), np.zeros(0, np.int64), targets[-1]]

    def rows():
        return sorted(zip(*(x.tolist() for x in chroma.align(queries, targets))))

    got = rows()
    monkeypatch.setattr(chroma, "ASKED", 3)
    monkeypatch.setattr(chroma, "TARGETS", 7)
    blocks = rows()
    monkeypatch.setattr(chroma, "LONG", 0)
    monkeypatch.setattr(chroma, "BINS", 500)
    assert got == blocks == rows() and len(got) > 100
    monkeypatch.undo()
    many, asked, took = [r.integers(0, 2**24, 62) for _ in range(2000)], [r.integers(0, 2**24, 62) for _ in range(200)], []
    for long in (chroma.LONG, 0):
        monkeypatch.setattr(chroma, "LONG", long)
        tries = []
        for _ in range(3):
            began = time.perf_counter()
            chroma.align(asked, many)
            tries.append(time.perf_counter() - began)
        took.append(min(tries))
    assert took[0] < took[1] / 1.5


def test_chroma_aligns_within_bounds_of_bins_and_frames(monkeypatch):
    r = np.random.default_rng(10)
    prints = [r.integers(0, 4, n) for n in (30, 40, 1, 16, 17, 90)]
    whole = [x.tolist() for x in chroma.align(prints, prints)]
    monkeypatch.setattr(chroma, "BINS", 50)
    monkeypatch.setattr(chroma, "FRAMES", 70)
    assert sorted(zip(*(x.tolist() for x in chroma.align(prints, prints)))) == sorted(zip(*whole))


def test_chroma_query_aligns_late_noisy_and_cut_copies(spark):
    """The query's recordings hold copies of each tenth one; all that are copies of a query are found, at the place of the copy."""
    out = {r.vec_id: r for r in chroma.op9_chroma(spark, SF).collect() if r.query is not None}
    ids = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    for q in (k for k in ids if k % 100 == 0):
        late, noisy, cut = (out[q + kind] for kind in (1, 2, 3))
        assert {late.query, noisy.query, cut.query} == {q} and late.offset < 0 and noisy.offset == 0 and cut.offset > 0
        assert max(r.bit_errors for r in (late, noisy, cut)) <= chroma.MAX_BIT_ERRORS


def test_chroma_search_all_has_every_pair_of_queries(spark):
    r = np.random.default_rng(5)
    song = r.normal(0, 0.125, 64)
    rows = [(k, [float(x) for x in song + 0.002 * r.normal(0, 1, 64)]) for k in range(12)] + [(13, [float(x) for x in r.normal(0, 0.125, 64)]), (14, None)]
    rows += [(16, rows[1][1]), (17, rows[5][1])]
    prints = chroma.fingerprints(chroma.recordings(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), "vec_id", "pcm")
    held = {x["k"]: np.array(x["prints"], np.int64) for x in prints.collect()}
    first = {k: min(j for j in held if np.array_equal(held[j], own)) for k, own in held.items()}
    want = sorted((k, q, *m) for q in (0, 5, 10) if q == min(x for x in (0, 5, 10) if first[x] == first[q]) for k in set(first.values()) for _, *m in chroma.Index([held[k]]).matches(held[q]))
    got = chroma.search_all(prints, every=5).collect()
    assert sorted((x["k"], x["query"], x["offset"], x["overlap"], x["bit_errors"]) for x in got if x["query"] is not None) == want
    assert {(x["k"], x["class_id"]) for x in got} == set(first.items())
    assert {(0, 0), (0, 5), (10, 0)} <= {(x[0], x[1]) for x in want}
    assert chroma.search_all(prints.limit(0)).count() == 0
    clash = prints
    for name in ("code", "class_id", "query", "bucket", "part", "rep", "own"):
        clash = clash.withColumn(name, F.lit("x"))
    assert sorted(map(str, chroma.search_all(clash, every=5).collect())) == sorted(map(str, got))


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_ranges(zip64):
    import io
    import zipfile

    w = warc.ZipWriter(zip64)
    w.add("a.txt", b"hello")
    w.add("dir/é.bin", bytes(range(256)) * 10)
    parts, at, members = list(w.parts), w.at, list(w.members)
    with zipfile.ZipFile(io.BytesIO(w.close(b"plain"))) as z:  # another reader agrees
        assert z.testzip() is None and z.read("dir/é.bin") == bytes(range(256)) * 10
    w.parts, w.at, w.members = parts, at, members
    data = w.close(b"a comment with PK\5\6 inside")
    reads = []

    def read(at, n):
        reads.append(n)
        return data[at : at + n]

    z = warc.ZipReader(read, len(data))
    at, n = z.locate("dir/é.bin")
    assert data[at : at + n] == bytes(range(256)) * 10 and list(z.members) == ["a.txt", "dir/é.bin"]
    with pytest.raises(ValueError, match="end of central directory"):
        warc.ZipReader(lambda a, n: b"x" * n, 100)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("packed", b"a" * 1000)
    with pytest.raises(ValueError, match="compressed"):
        warc.ZipReader(lambda a, n: buffer.getvalue()[a : a + n], len(buffer.getvalue())).locate("packed")


def test_warc_files_are_read_by_ranges(spark, tmp_path):
    """One record of a package takes its directory, its index and the record's own range; other bytes aren't read."""
    noise = np.random.default_rng(1)
    rows = [(k, f"http://p/{k}", "".join(map(chr, noise.integers(33, 126, 5000)))) for k in range(400)] + [(900, "u", "tiny"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/packages"
    files = warc.write_files(warc.decide(pages).coalesce(1), folder, package_bytes=300_000).cache()
    listed = [tuple(r) for r in files.collect()]
    assert len(listed) > 3 and all((tmp_path / "packages" / p.rsplit("/", 1)[1]).stat().st_size == n for p, n in listed)
    every = warc.read_files(files).collect()
    assert sorted(str((r["page_id"], bytes(r["payload"]).decode())) for r in every) == sorted(str((k, t or "")) for k, _, t in rows)
    some = warc.read_files(files, [7, 900]).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in some} == {7: rows[7][2], 900: "tiny"}
    for path, size in listed:
        reads = []
        with open(path.removeprefix("file://"), "rb") as f:

            def read(at, n, f=f, reads=reads):
                f.seek(at)
                reads.append(n)
                return f.read(n)

            found = list(warc.records(read, size, lambda page: page in (7, 900)))
        assert sum(reads) < 66_000 + 20_000 + 6_000 * len(found) < size
    assert warc.read_files(warc.write_files(warc.decide(pages.limit(0)), folder)).count() == 0
    with pytest.raises((ValueError, OSError, NotImplementedError)):
        warc.filesystem("unknown://host/folder")


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a", big, 0), (5, None, big, 0), (5, "http://a\r\nX: y", big, 0), (2, "u", "short", 0), (3, "u", "short", 0), (4, None, None, 0), (None, "n", big, 0), (None, "n", "alone" * 300, 0), (6, "u", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    for zip64 in (False, True):
        got = warc.read(warc.write(warc.decide(pages), package_bytes=500, zip64=zip64)).collect()
        assert len(got) == len(rows)
        by = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got]
        n = len(big.encode())
        assert sorted(map(str, by)) == sorted(map(str, [(1, "revisit", 5, n), (5, "response", None, n), (5, "response", None, n), (2, "response", None, 5), (3, "response", None, 5), (4, "response", None, 0), (None, "revisit", 5, n), (None, "response", None, 1500), (6, "response", None, 0)]))
        for r in got:
            if r["record_type"] == "response":
                assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
    assert warc.read(warc.write(warc.decide(pages.limit(0)))).count() == 0


def test_pipeline_stages(spark):
    """Each stage against what it should do to its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF).cache()
        assert out.columns == corpus_pipeline.COLUMNS
        seen.append(out)
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in seen]
    assert ids[0] > ids[1] == ids[2] >= ids[3] >= ids[4] and len(ids[4]) > 0.7 * len(ids[0])
    toxic = {r[0] for r in QUERIES["op1_toxicity"](spark, SF).where("toxic").select("doc_id").collect()}
    assert ids[0] - ids[1] == toxic
    from tests.llm.test_texts import contaminated, deduped, near

    before = [(r["doc_id"], r["text"]) for r in seen[1].collect()]
    assert sorted((d, t) for d, t, _, _ in deduped(before)) == sorted((r["doc_id"], r["text"]) for r in seen[2].collect())
    lines = sorted((r["doc_id"], r["text"]) for r in seen[2].collect())
    assert ids[3] == {d for d, (root, _) in near(lines).items() if d == root}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [(r["doc_id"], r["text"]) for r in seen[3].collect()]
    assert ids[4] == {d for d, n, hit, _ in contaminated(left, items) if not (hit and 20 * hit >= n)}
    final = corpus_pipeline.STAGES[-1][1](spark, seen[4], SF).collect()
    texts = dict((r["doc_id"], r["text"]) for r in seen[4].collect())
    import public_tokenizers

    own = bpe.load(str(public_tokenizers.path("word_bpe_49k.json")))
    for r in final:
        want, decoded = own.encode_batch([texts[r["doc_id"]]])
        assert r["ids"] == want[0].astype("<u4").tobytes() and r["n_tokens"] == len(want[0]) and r["decoded_sha256"] == hashlib.sha256(decoded[0].encode()).hexdigest()


def test_pipeline_keeps_one_row_of_a_group(spark):
    """Of near copies one row stays, though rows share the smallest id; rows without links stay, whatever their ids."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(3, LONG, "a", "s", 1), (3, LONG, "b", "s", 1), (3, LONG + " more", "c", "s", 1), (5, LONG, "d", "s", 1), (6, "alone", "e", "s", 1), (6, "apart", "f", "s", 1), (None, LONG, "g", "s", 1)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted((str(r["doc_id"]), r["lang"]) for r in got if r["doc_id"] != 3) == [("6", "e"), ("6", "f"), ("None", "g")] and len([r for r in got if r["doc_id"] == 3]) == 1


def test_pipeline_runs_and_removes_its_folders(spark):
    from pathlib import Path

    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100
    last = Path(out.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent
    assert last.exists() and last.name.endswith("-bpe")


def test_pipeline_handles_edges(spark):
    docs = edge(spark).withColumn("source", quality.F.lit(None).cast("string"))
    for _, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.limit(0)):
            stage(spark, d, SF).collect()
        docs = stage(spark, docs, SF)
