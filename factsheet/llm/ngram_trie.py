"""Language-model scoring with n-gram tries in Elias-Fano code."""

from __future__ import annotations

import mmap
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from factsheet.llm.common import checkpointed, words

#: The token after a text's last word; no word is empty.
END = b""
#: Id of the context before a text's first token; ids of words begin at 1.
START = 0


def pack(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, as many as the largest needs (all eight where one is negative), compressed."""
    top = int(values.max(initial=0))
    planes = 8 if values.min(initial=0) < 0 else max(1, -(-top.bit_length() // 8))
    kind = np.dtype("<i8" if planes > 4 else "<u4" if planes > 2 else "<u2" if planes > 1 else "u1")
    data = np.ascontiguousarray(values, dtype=kind).view(np.uint8).reshape(-1, kind.itemsize)[:, :planes].T.tobytes()
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    out = np.zeros(planes.shape[1], "<i8")
    cells = out.view(np.uint8).reshape(-1, 8)
    for i, plane in enumerate(planes):
        cells[:, i] = plane
    return out


def pack_words(tokens: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(tokens))


def unpack_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


@dataclass
class EliasFano:
    """A sequence that never falls: low bits side by side, high parts as gaps in unary. Searched as it is, without decoding."""

    n: int
    low_bits: int
    bits: int  # of the unary part
    low: np.ndarray  # bytes, with eight more so that any value can be read as part of eight bytes
    gaps: np.ndarray  # the unary part in words of 64 bits
    ones: np.ndarray  # set bits before each of these words

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        n = len(values)
        last = int(values[-1]) if n else 0
        width = max(0, (last // max(n, 1)).bit_length() - 1)
        low = np.empty((n, width), np.uint8)
        for b in range(width):
            low[:, b] = (values >> b) & 1
        bits = (last >> width) + n + 1
        unary = np.zeros(-(-bits // 64) * 64, np.uint8)
        unary[(values >> width) + np.arange(n)] = 1
        gaps = np.packbits(unary, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(gaps), dtype=np.int64)[:-1]])
        return EliasFano(n, width, bits, np.concatenate([np.packbits(low.ravel(), bitorder="little"), np.zeros(8, np.uint8)]), gaps, ones.astype("<u4"))

    @property
    def high(self) -> np.ndarray:
        return self.gaps.view(np.uint8)[: -(-self.bits // 8)]

    def decode(self) -> np.ndarray:
        return self.get(np.arange(self.n))

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at these places."""
        return ((_select(self.gaps, self.ones, i) - i) << self.low_bits) | self._low(i)

    def seek(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each ``x`` its place from ``begin`` to before ``end``, and whether it is there.

        The unary part gives the places of the values with the high part of ``x``; of those the low bits are halved.
        """
        high = x >> self.low_bits
        inside = (high >= 0) & (high < self.bits - self.n)
        h = np.where(inside, high, 0)
        zeros = 64 * np.arange(len(self.gaps)) - self.ones
        stop = _select(~self.gaps, zeros, h) - h
        start = np.where(h > 0, _select(~self.gaps, zeros, np.maximum(h - 1, 0)) - h + 1, 0)
        at, stop = np.maximum(start, begin), np.where(inside, np.minimum(stop, end), 0)
        above, sought = stop, x & ((1 << self.low_bits) - 1)
        while len(live := np.flatnonzero(at < above)):
            middle = (at[live] + above[live]) >> 1
            less = self._low(middle) < sought[live]
            if len(live) == len(at):
                at, above = np.where(less, middle + 1, at), np.where(less, above, middle)
            else:
                above = above.copy()
                at[live], above[live] = np.where(less, middle + 1, at[live]), np.where(less, above[live], middle)
        there = np.flatnonzero(at < stop)
        found = np.zeros(len(x), bool)
        found[there] = self._low(at[there]) == sought[there]
        return at, found

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        eight = np.ndarray(len(self.low) - 7, "<u8", self.low, strides=(1,))  # eight bytes from each byte on
        return ((eight[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where the set bits numbered ``k`` from 0 are, given how many lie before each word."""
    at = np.searchsorted(before, k, side="right") - 1
    left, word, place = (k - before[at]).astype(np.int64), words[at], at * 64
    for step in (32, 16, 8, 4, 2, 1):
        here = np.bitwise_count(word & np.uint64((1 << step) - 1)).astype(np.int64)
        on = left >= here
        left -= here * on
        place += step * on
        word = word >> (on * step).astype(np.uint64)
    return place


#: Steps of the codes of log10 probabilities: 1 is 10 to the power -FLOOR, 65535 is 1; 0 is no entry.
FLOOR, STEPS = 12.0, 65534


def quantize(p: np.ndarray) -> np.ndarray:
    return (1 + np.rint(np.clip(1 + np.log10(np.maximum(p, 1e-300)) / FLOOR, 0, 1) * STEPS)).astype(np.uint16)


def dequantize(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (((code.astype(np.float64) - 1) / STEPS - 1) * FLOOR), 0.0)


class Trie:
    """N-grams of one shard in memory-mapped levels: the words of each depth, pointers to their successors, quantised probabilities.

    A node's successors are kept relative to it: each is written as its id plus the last written value of the
    node before, so a level never falls and is one Elias-Fano sequence, as are the pointers and what was added.
    """

    def __init__(self, *levels: np.ndarray) -> None:
        """The words of distinct n-grams by depth, in order, and then their probabilities."""
        *keys, p = levels
        n = len(p)
        coded: list[EliasFano] = []
        above, new = np.zeros(min(n, 1), np.int64), np.zeros(n, bool)  # first n-gram of each node above, and which n-grams begin a node
        new[:1] = True
        for k in keys:
            new = new | np.concatenate([new[:1], k[1:] != k[:-1]])
            nodes = np.flatnonzero(new)
            first = np.searchsorted(nodes, above)
            ends = np.concatenate([first[1:], [len(nodes)]])[: len(first)]
            base = np.concatenate([[0], np.cumsum(k[nodes][ends - 1])[:-1]])[: len(first)]
            coded += [EliasFano.encode(x) for x in (np.concatenate([first, ends[-1:]]), base, k[nodes] + np.repeat(base, ends - first))]
            above = nodes
        parts = [quantize(p).astype("<u2").tobytes(), *(x.tobytes() for e in coded for x in (e.low, e.gaps, e.ones))]
        starts = np.cumsum([0, *(-(-len(x) // 8) * 8 for x in parts)])
        with tempfile.TemporaryFile() as f:  # has no name, so it goes with its last mapping
            f.write(b"".join(x.ljust(-(-len(x) // 8) * 8, b"\0") for x in parts) + b"\0")
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = lambda i, kind: np.frombuffer(self._map, kind, len(parts[i]) // np.dtype(kind).itemsize, int(starts[i]))
        self.codes = view(0, "<u2")
        self.levels = [EliasFano(e.n, e.low_bits, e.bits, view(3 * i + 1, "u1"), view(3 * i + 2, "<u8"), view(3 * i + 3, "<u4")) for i, e in enumerate(coded)]

    def places(self, *keys: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams, -1 for those that are not there: word after word, among its context's successors alone."""
        n = len(keys[0])
        if not n or not len(self.codes):
            return np.full(n, -1)
        new = np.zeros(n, bool)  # n-grams that begin alike and stand side by side are sought as one
        new[0] = True
        run, above = np.zeros(n, np.int64), np.zeros(1, np.int64)
        for i, k in enumerate(keys):
            pointers, base, words = self.levels[3 * i : 3 * i + 3]
            there = np.maximum(above, 0)
            added, begin, end = base.get(there), pointers.get(there), np.where(above < 0, 0, pointers.get(there + 1))
            new[1:] |= k[1:] != k[:-1]
            heads = np.flatnonzero(new)
            up = run[heads]
            at, found = words.seek(k[heads] + added[up], begin[up], end[up])
            run, above = np.cumsum(new) - 1, np.where(found, at, -1)
        return above[run]

    def find(self, *keys: np.ndarray) -> np.ndarray:
        """Codes of the n-grams, 0 for those that are not there."""
        return np.append(self.codes, np.uint16(0))[self.places(*keys)]


def folded(keys: list[np.ndarray]) -> np.ndarray:
    """One number for each row of keys, in the order of the rows."""
    out = keys[0].astype(np.int64)
    for k in keys[1:]:
        size = int(k.max(initial=0)) + 1
        if (int(out.max(initial=0)) + 1) * size >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
        out = out * size + k
    return out


#: A context with more than this part of a shard's even share of the tokens is spread over further shards.
PIECE = 64


def shard_of(keys: list[np.ndarray], seen: np.ndarray, learnt: int, shards: int) -> np.ndarray:
    """By the context, and by the last word too as far as the context is frequent: one with a third of all tokens goes over all shards.

    How often learning texts have a context is everywhere the same, and so is the shard.
    """
    mixed = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        context = mixed
        mixed = (mixed ^ k.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    over = np.minimum(1 + PIECE * shards * seen // max(learnt, 1), shards).astype(np.uint64)
    return ((context % np.uint64(shards) + mixed % over) % np.uint64(shards)).astype(np.int64)


def begins_run(keys: list[np.ndarray]) -> np.ndarray:
    """Which rows differ from the one before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def pack_keys(keys: list[np.ndarray]) -> list[bytes]:
    """Keys in order, each as steps among those that begin alike."""
    out, new = [], begins_run([np.zeros(len(keys[0]))])
    for k in keys:
        steps = np.diff(k, prepend=0)
        out.append(pack(np.where(new, k, steps)))
        new = new | (steps != 0)
    return out


def unpack_keys(data: Iterable[bytes]) -> list[np.ndarray]:
    out, new = [], None
    for steps in map(unpack, data):
        new = begins_run([np.zeros(len(steps))]) if new is None else new
        sums = np.cumsum(steps)
        out.append(sums - (sums - steps)[new][np.cumsum(new) - 1])
        new = new | (steps != 0)
    return out


BIN = "bin string, doc_ids array<long>, held binary, texts long, lengths binary, tokens binary, vocabulary binary, counts binary, n long"


def binned(documents: DataFrame, most: int) -> DataFrame:
    """Documents in bins of about ``most`` tokens: word numbers of their texts, and how often learning texts have each word."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs: list = []
        vocabulary: dict[bytes, int] = {}
        number = vocabulary.setdefault
        parts: list[np.ndarray] = []
        n = 0

        def flush() -> pd.DataFrame:
            tokens, lengths = np.concatenate(parts), np.array([len(x) for x in parts])
            taught = np.repeat([not d[1] for d in docs], lengths)
            every, learnt = np.bincount(tokens, minlength=len(vocabulary)), np.bincount(tokens[taught], minlength=len(vocabulary))
            order = np.argsort(-every, kind="stable")  # frequent words get small numbers
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            names = list(vocabulary)
            return pd.DataFrame(
                {
                    "bin": [uuid.uuid4().hex],
                    "doc_ids": [[d[0] for d in docs]],
                    "held": [pack(np.array([d[1] for d in docs], np.int64))],
                    "texts": [sum(not d[1] for d in docs)],
                    "lengths": [pack(lengths)],
                    "tokens": [pack(place[tokens])],
                    "vocabulary": [pack_words([names[i] for i in order])],
                    "counts": [pack(learnt[order])],
                    "n": [int(taught.sum())],
                }
            )

        for pdf in batches:
            for doc_id, held, text in zip(pdf["doc_id"], pdf["held"], pdf["text"]):
                tokens = [w.lower() for w in words(text)] + [END]
                parts.append(np.fromiter((number(w, len(vocabulary)) for w in tokens), np.int64, len(tokens)))
                docs.append((None if pd.isna(doc_id) else int(doc_id), bool(held)))
                n += len(tokens)
                if n >= most:
                    yield flush()
                    docs, parts, n = [], [], 0
                    vocabulary.clear()
        if docs:
            yield flush()

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return documents.select("doc_id", held.alias("held"), "text").mapInPandas(rows, BIN)


def word_counts(bins: DataFrame, shards: int) -> DataFrame:
    """For each bin and shard of words, ids and counts of the bin's words there; a word's id and count are everywhere the same.

    A count is written twice over, and one more where no other bin has the word.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                names, counts = unpack_words(row.vocabulary), unpack(row.counts)
                of = np.fromiter((zlib.crc32(w) % shards for w in names), np.int64, len(names))
                for s in np.unique(of):
                    here = np.flatnonzero(of == s)
                    yield pd.DataFrame({"shard": [s], "bin": [row.bin], "places": [pack(np.diff(here, prepend=0))], "names": [pack_words([names[i] for i in here])], "counts": [pack(counts[here])]})

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        number: dict[bytes, int] = {}
        local = [np.fromiter((number.setdefault(w, len(number)) for w in unpack_words(x)), np.int64) for x in pdf["names"]]
        total = np.zeros(len(number), np.int64)
        bins_with = np.zeros(len(number), np.int64)
        for at, x in zip(local, pdf["counts"]):
            total[at] += unpack(x)
            bins_with[at] += 1
        told = total * 2 + (bins_with == 1)
        rank = np.empty(len(number), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(number))  # frequent words get small ids
        out = pd.DataFrame({"bin": pdf["bin"], "kind": 0, "shard": shard, "places": pdf["places"], "a": [pack(rank[at] * shards + shard + 1) for at in local], "b": [pack(told[at]) for at in local], "known": 0, "learnt": 0})
        out.loc[out.index[0], ["known", "learnt"]] = [int((total > 0).sum()), int(total.sum())]
        return out

    packets = bins.select("bin", "vocabulary", "counts").mapInPandas(split, "shard int, bin string, places binary, names binary, counts binary")
    return packets.groupBy("shard").applyInPandas(count, "bin string, kind int, shard int, places binary, a binary, b binary, known long, learnt long")


@dataclass
class Grams:
    """The distinct n-grams of a bin in order: their words, how often learning texts have them here, and how often everywhere."""

    keys: list[np.ndarray]
    own: np.ndarray
    seen: np.ndarray  # how often learning texts have the context
    of: np.ndarray  # of each token, its place among the n-grams
    order: np.ndarray  # those to be asked about, by shard and words
    cuts: np.ndarray

    @staticmethod
    def of_bin(keys: list[np.ndarray], own: np.ndarray, seen: np.ndarray, of: np.ndarray, alone: np.ndarray, learnt: int, shards: int) -> Grams:
        """``alone``: n-grams whose context or end occurs in no other bin, so that their count here is their count everywhere.

        Nothing is asked about them, nor about n-grams whose context no learning text has.
        """
        asked = np.flatnonzero(~alone & (seen > 0))
        shard = shard_of([k[asked] for k in keys], seen[asked], learnt, shards)
        order = np.argsort(shard.astype(np.min_scalar_type(shards)), kind="stable")
        return Grams(keys, own, seen, of, asked[order], np.searchsorted(shard[order], np.arange(shards + 1)))

    def questions(self, bin_: str) -> Iterator[tuple]:
        for s in np.flatnonzero(np.diff(self.cuts)):
            o = self.order[self.cuts[s] : self.cuts[s + 1]]
            keys = [k[o] for k in self.keys]
            yield int(s), bin_, pack_keys(keys), pack(self.own[o]), pack(self.seen[o[begins_run(keys[:-1])]])

    def answered(self, answers: Iterable[tuple], prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities as the trie has them, counts everywhere, and whether no other bin has the n-gram.

        Codes come as steps above that of an n-gram seen once in its context, from 1; 0 is no entry.
        """
        codes, told = np.where(self.own > 0, quantize(self.own / (self.seen + prior)), 0).astype(np.int64), self.own * 2 + 1
        for shard, steps, counts in answers:
            at = self.order[self.cuts[shard] : self.cuts[shard + 1]]
            above = unpack(steps)
            codes[at] = np.where(above > 0, above - 1 + quantize(1 / (self.seen[at] + prior)), 0)
            if counts is not None:
                told[at] = unpack(counts)
        return dequantize(codes), told >> 1, (told & 1) == 1


@dataclass
class Coded:
    """A bin with what the words' shards say: words numbered anew by their ids, from the start of texts as 0, their counts, and the distinct pairs."""

    lengths: np.ndarray
    begins: np.ndarray
    taught: np.ndarray  # whether the token is in a learning text
    tokens: np.ndarray
    counts: np.ndarray
    word: np.ndarray  # number of each pair's second word
    pairs: Grams

    @staticmethod
    def read(row, texts: int, learnt: int, shards: int) -> Coded:
        lengths, tokens, held = unpack(row.lengths), unpack(row.tokens), unpack(row.held)
        size = int(tokens.max()) + 2
        ids, told = np.full(size, START, np.int64), np.full(size, texts * 2 + (shards == 1), np.int64)
        for places, a, b in zip(row.word_places, row.word_ids, row.word_told):
            at = np.cumsum(unpack(places))
            ids[at], told[at] = unpack(a), unpack(b)
        by_id = np.argsort(ids)  # the start of texts first
        number = np.empty_like(by_id)
        number[by_id] = np.arange(size)
        ids, told, tokens = ids[by_id], told[by_id], number[tokens]
        counts, here = told >> 1, (told & 1) == 1
        begins = np.cumsum(lengths) - lengths
        before = np.concatenate([[0], tokens[:-1]])
        before[begins] = 0
        key, pair = np.unique(before * size + tokens, return_inverse=True)
        taught = np.repeat(held == 0, lengths)
        c, w = key // size, key % size
        pairs = Grams.of_bin([ids[c], ids[w]], np.bincount(pair[taught], minlength=len(key)), counts[c], pair, here[c] | here[w], learnt, shards)
        return Coded(lengths, begins, taught, tokens, counts, w, pairs)

    def triples(self, everywhere: np.ndarray, here: np.ndarray, learnt: int, shards: int) -> tuple[Grams, np.ndarray, np.ndarray]:
        """The distinct triples of tokens, whose contexts are pairs; the tokens that end one; and each triple's pair at its end."""
        inner = np.ones(len(self.tokens), bool)
        inner[self.begins] = False
        ends = np.flatnonzero(inner)
        of, size = self.pairs.of, len(everywhere)
        key, triple = np.unique(of[ends - 1] * size + of[ends], return_inverse=True)
        a, b = key // size, key % size
        (u, v), (_, w) = ([k[x] for k in self.pairs.keys] for x in (a, b))
        own = np.bincount(triple[self.taught[ends]], minlength=len(key))
        return Grams.of_bin([u, v, w], own, everywhere[a], triple, here[a] | here[b], learnt, shards), ends, b


def scored(documents: DataFrame, *, prior: float = 8.0, tokens_a_bin: int = 2_000_000) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every document.

    The model has three levels, learnt from every text that is not held out. With c counts in those texts, V distinct
    and N all tokens, p(w) = (c(w) + 1) / (N + V + 1), p(w | v) = (c(v w) + prior p(w)) / (c(v) + prior), and
    p(w | u v) = (c(u v w) + prior p(w | v)) / (c(u v) + prior); a text's first token has p(w | start) alone. The
    part of a pair or triple that was seen is quantised in a trie; the rest comes from the shorter context.

    Texts are read once and kept as bins of word numbers. A bin asks the shards of words for its distinct words,
    those of pairs for its distinct pairs and those of triples for its distinct triples, so a frequent one is one
    entry a bin wherever it goes, and a shard holds about as much as a bin: there are as many as bins. N-grams go
    to shards by their context, a frequent one's by their last word too. One whose context or end is in no other bin,
    held-out texts included, is counted in its bin; one whose context no learning text has is not counted.

    A null or empty text is its end alone; repeated rows are texts of their own; a row without ``doc_id`` is not
    held out. Without texts there are no rows.
    """
    bins = checkpointed(binned(documents, tokens_a_bin))
    shards = max(1, bins.count())
    counted = checkpointed(word_counts(bins, shards))
    known, learnt = (x or 0 for x in counted.agg(F.sum("known"), F.sum("learnt")).first())
    texts = bins.agg(F.sum("texts")).first()[0] or 0
    whole = learnt + known + 1
    ASKED = "shard int, bin string, keys array<binary>, learnt binary, seen binary"

    def posted(answers: DataFrame, **columns: str) -> DataFrame:
        """What came to each bin as one row, so that bins, and all that is answered them, are shuffled once and joined."""
        mail = answers.groupBy("bin").agg(F.collect_list(F.struct(*columns.values())).alias("mail"))
        return mail.select("bin", *[F.col(f"mail.{c}").alias(name) for name, c in columns.items()])

    def by_bin(one: Callable[..., pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    yield one(row, Coded.read(row, texts, learnt, shards))  # a call, so that one bin's arrays go before the next one's come

        return run

    def mail_of(row, kind: str) -> Iterable[tuple]:
        parts_ = [getattr(row, f"{kind}_{x}") for x in ("shard", "codes", "told")]
        return () if parts_[0] is None else zip(*parts_)  # nothing was asked

    def ask_pairs(row, x: Coded) -> pd.DataFrame:
        return pd.DataFrame(x.pairs.questions(row.bin), columns=["shard", "bin", "keys", "learnt", "seen"])

    def ask_triples(row, x: Coded) -> pd.DataFrame:
        _, everywhere, here = x.pairs.answered(mail_of(row, "pair"), prior)
        return pd.DataFrame(x.triples(everywhere, here, learnt, shards)[0].questions(row.bin), columns=["shard", "bin", "keys", "learnt", "seen"])

    def answer(pdf: pd.DataFrame, tells: bool) -> pd.DataFrame:
        asked = [unpack_keys(k) for k in pdf["keys"]]
        runs = [np.cumsum(begins_run(k[:-1])) - 1 for k in asked]
        sizes = [len(x) for x in runs]
        contexts = [unpack(x) for x in pdf["seen"]]
        seen, once = (np.concatenate([x[run] for x, run in zip(y, runs)]) for y in (contexts, [quantize(1 / (x + prior)) for x in contexts]))
        keys = [np.concatenate(x) for x in zip(*asked)]
        learnt = np.concatenate([unpack(x) for x in pdf["learnt"]])
        del asked, runs, contexts
        one = folded(keys)
        order = np.argsort(one, kind="stable")  # what a bin asks is in order already
        new = np.diff(one[order], prepend=-1) != 0
        first = np.flatnonzero(new)  # a bin asks once about an n-gram
        count, askers = np.add.reduceat(learnt[order], first), np.diff(first, append=len(order))
        sole = np.zeros(len(order), np.int64)
        sole[order[first[askers == 1]]] = 1
        taught = order[first[count > 0]]
        count = count[count > 0]
        trie = Trie(*(k[taught] for k in keys), count / (seen[taught] + prior))
        at = np.empty(len(order), np.int64)
        at[order] = trie.places(*(k[order[first]] for k in keys))[np.cumsum(new) - 1]
        steps = np.where(at >= 0, np.append(trie.codes, np.uint16(0))[at].astype(np.int64) - once + 1, 0)
        cuts = np.cumsum(sizes)[:-1]
        told = [pack(x) for x in np.split(np.append(count, 0)[at] * 2 + sole, cuts)] if tells else None  # nothing is asked after the last level
        return pd.DataFrame({"bin": pdf["bin"], "shard": pdf["shard"], "codes": [pack(x) for x in np.split(steps, cuts)], "told": told})

    def score(row, x: Coded) -> pd.DataFrame:
        alone = (x.counts + 1) / whole
        found, everywhere, here = x.pairs.answered(mail_of(row, "pair"), prior)
        two = found + prior / (x.pairs.seen + prior) * alone[x.word]
        triples, ends, pair = x.triples(everywhere, here, learnt, shards)
        found, *_ = triples.answered(mail_of(row, "triple"), prior)
        three = found + prior / (triples.seen + prior) * two[pair]
        p = two[x.pairs.of]
        p[ends] = three[triples.of]
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if pd.isna(i) else int(i) for i in row.doc_ids], dtype="Int64"),
                "held_out": unpack(row.held) == 1,
                "n_tokens": x.lengths,
                "n_known": np.add.reduceat((x.counts[x.tokens] > 0).astype(np.int64), x.begins),
                "train_tokens": learnt,
                "base_score": np.add.reduceat(np.log10(alone)[x.tokens], x.begins),
                "score": np.add.reduceat(np.log10(np.minimum(p, 1.0)), x.begins),
            }
        )

    def answers(asked: DataFrame, kind: str) -> DataFrame:
        found = asked.groupBy("shard").applyInPandas(lambda pdf: answer(pdf, kind == "pair"), "bin string, shard int, codes binary, told binary")
        return posted(found, **{f"{kind}_{c}": c for c in ("shard", "codes", "told")})

    base = bins.select("bin", "doc_ids", "held", "lengths", "tokens").join(posted(counted, word_places="places", word_ids="a", word_told="b"), "bin")
    with_pairs = base.join(answers(base.mapInPandas(by_bin(ask_pairs), ASKED), "pair"), "bin", "left")
    with_triples = with_pairs.join(answers(with_pairs.mapInPandas(by_bin(ask_triples), ASKED), "triple"), "bin", "left")
    return with_triples.mapInPandas(by_bin(score), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
