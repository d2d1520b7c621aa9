"""BPE encoding and decoding by speculation and verification.

A word's greedy longest-match split is proposed first. A split is the result of exact merging when
every adjacent pair of its tokens merges back to that same pair, so all pairs of a batch are looked up
at once in a table of pairs judged so far; only words with a failing pair are merged exactly.

The vocabulary file is the ``tokenizers`` JSON of a BPE model with byte-level symbols and an end-of-word
suffix, whose normaliser is NFC, white space to a space, lower case. Its path is a parameter.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import arrow_batches, docs_table, give_back

#: Fixed values of the public vocabulary file: its pre-tokeniser pattern.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Fixed values of Unicode 16: letters and numbers that it added, as ranges.
UNICODE_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA)]
#: Fixed values of Unicode 16 and 17: (first, last, lower case of the first) of capitals that they added.
CAPITALS = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
NEW_LOWER = {a + k: low + k for a, b, low in CAPITALS for k in range(b - a + 1)}
NEW_CAPITAL = re.compile("[\u1c89\ua7cb-\ua7dc\U00010d50-\U00010d65\U00016ea0-\U00016eb8]")
#: Python counts these as white space, the vocabulary's pattern doesn't.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
CACHE_ENTRIES = 400_000
NO_RANK = 1 << 30
#: Symbols up to which a list is searched for the best pair; beyond, a heap is kept.
SHORT = 64
SLICE_BYTES = 2 << 20


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


@functools.lru_cache(maxsize=1)
def newer_letters() -> frozenset[str]:
    """Code points that the regular expressions here take for letters or numbers, though the vocabulary library's older Unicode tables have them
    unassigned: those that Python's tables, older still, don't know, but for what Unicode 16 added."""
    known, out = {c for a, b in UNICODE_16 for c in range(a, b + 1)}, []
    for start in range(0, sys.maxunicode + 1, 1 << 12):
        unassigned = [chr(c) for c in range(start, start + (1 << 12)) if unicodedata.category(chr(c)) == "Cn" and c not in known]
        out += regex.findall(r"[\p{L}\p{N}]", "".join(unassigned))
    return frozenset(out)


def ranges(points: Iterable[str]) -> str:
    """The inside of a character class of these code points."""
    out: list[list[int]] = []
    for c in sorted(map(ord, points)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in out)


class BPE:
    """Encoder and decoder of one vocabulary file; caches are cleared when they reach CACHE_ENTRIES."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: rank by pair of ids, and the id that the merge of each rank makes
        self.rank = {self.vocab[x] << 16 | self.vocab[y]: k for k, (x, y) in enumerate(merges)}
        self.result = [self.vocab[x + y] for x, y in merges]
        if max(self.vocab.values()) >> 16:
            raise ValueError("a vocabulary of more than 65,536 tokens")
        self.table = dict(enumerate(byte_symbols()))
        self.word = regex.compile(WORD_PATTERN.replace(r"\s", SPACES.pattern[1:-2]))
        self.newer = newer_letters()
        new = f"[{ranges(self.newer)}]" if self.newer else "(?!)"
        pattern = self.word.pattern.replace(r"[\p{L}]+", rf"(?:(?!{new})\p{{L}})+").replace(r"[\p{N}]|", rf"(?!{new})\p{{N}}|")
        others = pattern[pattern.rindex("[^") :]
        #: the same pattern where newer letters are none
        self.old_word = regex.compile(pattern[: -len(others)] + f"(?:{new}|{others[:-1]})+")
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        inner = {t: i for t, i in self.vocab.items() if not t.endswith(self.suffix)} if self.suffix else dict(self.vocab)
        final = {t[: -len(self.suffix)]: i for t, i in self.vocab.items() if t.endswith(self.suffix)} if self.suffix else inner
        self.inner, self.final = inner, final
        #: beginnings of tokens, at which longest match goes on
        self.prefixes = {t[:k] for t in [*inner, *final] for k in range(1, len(t) + 1)}
        self.pairs: dict[int, bool] = {}
        self._known = np.zeros(0, np.int64), np.zeros(0, bool)
        self.stable: dict[int, bool] = {}
        self.merged_exactly = self.proposed = 0
        self._clear()

    def _clear(self) -> None:
        self.chunk: dict[str, int] = {}
        self.decoded: list[str] = []
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(4096, np.uint32), 0
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}

    # exact merging

    def merge(self, ids: list[int]) -> tuple[int, ...]:
        """Exact merging of symbol ids: always the pair of lowest rank, from the left."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        rank, result = self.rank.get, self.result
        ranks = [rank(x << 16 | y, NO_RANK) for x, y in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            k = ranks.index(best)
            ids[k : k + 2] = (new := result[best],)
            del ranks[k]
            if k:
                ranks[k - 1] = rank(ids[k - 1] << 16 | new, NO_RANK)
            if k < len(ranks):
                ranks[k] = rank(new << 16 | ids[k + 1], NO_RANK)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same for long words: a heap of pairs by rank and place, over symbols linked to their neighbours.

        A pair in the heap may have been overtaken by a merge beside it; it counts only if its left symbol still has that rank.
        """
        rank, result, n = self.rank.get, self.result, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [rank(x << 16 | y, NO_RANK) for x, y in zip(ids, ids[1:])] + [NO_RANK]
        heap = [(r, k) for k, r in enumerate(now) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if now[k] != r:
                continue
            gone = after[k]
            ids[k], now[gone], ids[gone] = result[r], NO_RANK, -1
            after[k] = end = after[gone]
            if end < n:
                before[end] = k
            for left, right in ((before[k], k), (k, end)):
                if left >= 0:
                    now[left] = own = rank(ids[left] << 16 | ids[right], NO_RANK) if right < n else NO_RANK
                    if own != NO_RANK:
                        heapq.heappush(heap, (own, left))
        return tuple(i for i in ids if i >= 0)

    def symbols(self, word: str, closed: bool = True) -> list[int]:
        """Ids of the byte symbols of a word given as byte-level characters."""
        out = [self.inner[c] for c in word]
        if closed and word:
            out[-1] = self.final[word[-1]]
        return out

    # speculation

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match; None where no token fits."""
        out, p, n = [], 0, len(word)
        inner, final, prefixes = self.inner.get, self.final.get, self.prefixes
        while p < n:
            got, reach, e = None, p, p + 1
            while e < n and (part := word[p:e]) in prefixes:
                if (t := inner(part)) is not None:
                    got, reach = t, e
                e += 1
            if e == n and (t := final(word[p:])) is not None:
                out.append(t)
                return out
            if got is None:
                return None
            out.append(got)
            p = reach
        return out

    def _symbols_of(self, token: int) -> list[int]:
        name = self.names[token]
        closed = bool(self.suffix) and name.endswith(self.suffix)
        return self.symbols(name[: -len(self.suffix)] if closed else name, closed)

    def compatible(self, a: int, b: int) -> bool:
        """Whether exact merging of the two tokens' text gives back the two tokens."""
        return self.merge(self._symbols_of(a) + self._symbols_of(b)) == (a, b)

    def whole(self, a: int) -> bool:
        """Whether exact merging of the token's text gives the token."""
        got = self.stable.get(a)
        if got is None:
            got = self.stable[a] = self.merge(self._symbols_of(a)) == (a,)
        return got

    def verify(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (a << 32 | b) is compatible; pairs not seen before are judged and remembered."""
        known, good = self._known
        at = np.searchsorted(known, keys)
        found = np.zeros(len(keys), bool)
        inside = at < len(known)
        found[inside] = known[at[inside]] == keys[inside]
        if not found.all():
            fresh = np.unique(keys[~found])
            judged = np.fromiter((self.compatible(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in fresh), bool, len(fresh))
            if len(known) > 4 * CACHE_ENTRIES:
                known, good = known[:0], good[:0]
                fresh = np.unique(keys)
                judged = np.fromiter((self.compatible(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in fresh), bool, len(fresh))
            every = np.concatenate([known, fresh])
            order = np.argsort(every, kind="stable")
            self._known = known, good = every[order], np.concatenate([good, judged])[order]
            at = np.searchsorted(known, keys)
        return good[at]

    def encode_words(self, words: Sequence[str]) -> list[tuple[int, ...]]:
        """Token ids of distinct words (byte-level characters)."""
        proposals = [self.propose(w) for w in words]
        self.proposed += len(words)
        sizes = np.fromiter((len(p) if p else 0 for p in proposals), np.int64, len(proposals))
        tokens = np.fromiter((t for p in proposals if p for t in p), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = sizes == 0
        if len(tokens):
            single = np.unique(tokens)
            broken = single[np.fromiter((not self.whole(int(t)) for t in single), bool, len(single))]
            bad[owner[np.isin(tokens, broken)]] = True
            inner = owner[:-1] == owner[1:]
            keys = (tokens[:-1] << 32 | tokens[1:])[inner]
            if len(keys):
                bad[owner[:-1][inner][~self.verify(keys)]] = True
        out = []
        for k, w in enumerate(words):
            if bad[k]:
                self.merged_exactly += 1
                out.append(self.merge(self.symbols(w)))
            else:
                out.append(tuple(tokens[ends[k] - sizes[k] : ends[k]].tolist()))
        return out

    # texts

    def normal(self, text: str) -> str:
        """NFC, then lower case code point by code point (so no final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
            if NEW_CAPITAL.search(text):
                text = text.translate(NEW_LOWER)
        return text.lower()

    def _pieces(self, text: str) -> list[str]:
        """White-space separated pieces of a text in order; special tokens stand for themselves behind a NUL-free marker."""
        if self.split_special and "<|" in text:
            out = []
            for k, part in enumerate(self.split_special.split(text)):
                out += [("\udfff" + part)] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        text = self.normal(text)
        if NOT_SPACE.search(text):
            return [x for x in SPACES.split(text) if x]
        return text.split()

    def _words(self, piece: str) -> list[str]:
        """A piece's words by the pattern."""
        old = not piece.isascii() and not self.newer.isdisjoint(piece)
        return (self.old_word if old else self.word).findall(piece)

    def _bytes(self, word: str) -> str:
        """A word's bytes as byte-level characters; printable ASCII stands for itself."""
        if word.isascii() and word.isprintable():
            return word
        return word.encode().decode("latin-1").translate(self.table)

    def _learn(self, pieces: Sequence[str]) -> None:
        """Enters pieces that aren't in the cache."""
        find, spell, words, names, special = self._words, self._bytes, self.words, self.names.__getitem__, self.special
        cut = [[p] if p.isascii() and p.isalpha() else [] if p[0] == "\udfff" else list(map(spell, find(p))) for p in pieces]
        fresh = list({w for ws in cut for w in ws if w not in words})
        words.update((w, (ids, " ".join(map(names, ids)))) for w, ids in zip(fresh, self.encode_words(fresh)))
        flat, counts = [], []
        for p, ws in zip(pieces, cut):
            if len(ws) == 1:
                ids, text = words[ws[0]]
            elif p[0] == "\udfff":
                ids, text = (special[p[1:]],), p[1:]
            else:
                ids, text = [t for w in ws for t in words[w][0]], " ".join([words[w][1] for w in ws])
            flat += ids
            counts.append(len(ids))
            self.chunk[p] = len(self.decoded)
            self.decoded.append(text)
        ends = np.cumsum(np.array(counts, np.int64)) + self.used
        self.counts = np.concatenate([self.counts, np.array(counts, np.int64)])
        self.starts = np.concatenate([self.starts, ends - counts])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode_batch(self, texts: Sequence[str | None]) -> tuple[list[np.ndarray], list[str]]:
        """For each text its ids (uint32) and their decoding."""
        pieces = [self._pieces(t) if t else [] for t in texts]
        if len(self.chunk) > CACHE_ENTRIES:
            self._clear()
        fresh = {p for ps in pieces for p in ps if p not in self.chunk}
        if fresh:
            self._learn(list(fresh))
        ids, decoded, at, names = [], [], self.chunk.__getitem__, self.decoded.__getitem__
        for ps in pieces:
            rows = list(map(at, ps))
            index = np.array(rows, dtype=np.int64)
            n = self.counts[index]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            ids.append(self.ids[np.repeat(self.starts[index] - ends + n, n) + np.arange(total)])
            decoded.append(" ".join(filter(None, map(names, rows))))
        return ids, decoded

    def decode(self, ids: Sequence[int]) -> str:
        """Token strings joined by spaces, as for a vocabulary without a decoder; unknown ids are left out."""
        return " ".join(self.names[int(i)] for i in ids if int(i) in self.names)


@functools.lru_cache(maxsize=2)
def load(path: str) -> BPE:
    return BPE(path)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    first, total = 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > SLICE_BYTES:
            yield first, k
            first, total = k, 0
        total += int(n)
    if first < len(sizes):
        yield first, len(sizes)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, ids, decoded): ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` their decoding.

    One row per input row, in any order; no shuffle. Null or empty text: no ids, empty decoding. Other
    columns, whatever their names, are not read. A null id stays null; repeated rows stay repeated.
    """
    src = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = src.schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        bpe = load(path)
        for batch in batches:
            texts = batch.column(1)
            for a, b in _slices(texts):
                ids, decoded = bpe.encode_batch(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(decoded, pa.string())],
                    names=[id_col, "ids", "decoded"],
                )

    return src.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, ids binary, decoded string")


def decode(df: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the decoding of a column of little-endian unsigned 32-bit ids; a null is decoded as an empty text."""

    @F.pandas_udf("string")
    def text(column):  # noqa: ANN001, ANN202
        bpe = load(path)
        return column.map(lambda b: bpe.decode(np.frombuffer(b or b"", "<u4")))

    return df.withColumn(to, text(F.col(ids_col)))


def op7_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Per document: n_tokens and the digests of its ids and of their decoding."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("word_bpe_49k.json"))
    arrow_batches(spark)
    out = encode(docs_table(spark, sf_dir), path)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
