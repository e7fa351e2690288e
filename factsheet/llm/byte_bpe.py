"""Byte-level BPE: pre-tokens by scans of transition functions, pairs merged with a cache, offsets kept to decode."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from factsheet.llm.common import map_text

RANKS = "byte_bpe_50k.tiktoken"
#: Symbols, and the states of the same number after them. Two further symbols are an apostrophe that may begin
#: a contraction of two or three characters; two further states have that many of its characters to come.
EDGE, LETTER, NUMBER, OTHER, SPACE, BLANK, SHORT, LONG = range(8)
ONE_LEFT, TWO_LEFT = 6, 7
#: Code points with the property White_Space: fixed values.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings of contractions: fixed values.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """The symbol of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], dtype=np.uint8)
    table[WHITE_SPACE] = BLANK
    table[0x20] = SPACE
    return table


@lru_cache(maxsize=1)
def transitions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions on states that words of symbols make: that of each symbol, all products, and the value of constant ones.

    A contraction begins where a token does: not after a space, which the apostrophe joins, nor inside a run of
    other signs.
    """

    def after(state: int, symbol: int) -> int:
        if state in (ONE_LEFT, TWO_LEFT) and symbol != EDGE:
            return EDGE if state == ONE_LEFT else ONE_LEFT
        if symbol in (SHORT, LONG):
            return OTHER if state in (OTHER, SPACE) else (ONE_LEFT if symbol == SHORT else TWO_LEFT)
        return symbol

    single = [tuple(after(s, x) for s in range(8)) for x in range(8)]
    known = list(dict.fromkeys(single))
    at = {f: i for i, f in enumerate(known)}
    for f in known:  # grows while it runs, until closed under composition
        for g in single:
            made = tuple(g[s] for s in f)
            if made not in at:
                at[made] = len(known)
                known.append(made)
    product = np.array([[at[tuple(g[s] for s in f)] for g in known] for f in known], dtype=np.uint16)
    constant = np.array([f[0] if len(set(f)) == 1 else 255 for f in known], dtype=np.uint16)
    return np.array([at[f] for f in single], dtype=np.uint16), product, constant


def states(symbols: np.ndarray) -> np.ndarray:
    """The state after each symbol: products of the functions up to it, over twice as many each round.

    A product that is constant no longer depends on what came before, so the scan ends when all are.
    """
    function, product, constant = transitions()
    scan, width = function[symbols], 1
    scan[:1] = function[EDGE] if len(scan) else scan[:1]
    while (constant[scan] == 255).any():
        scan[width:] = product[scan[:-width], scan[width:]]
        width *= 2
    return constant[scan]


def starts(code_points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point; ``edges`` are places between texts, each a token of its own.

    The first code point must be an edge.
    """
    symbols = symbol_table()[code_points]
    symbols[edges] = EDGE
    for quote in np.flatnonzero(code_points == 39):
        ending = "".join(map(chr, code_points[quote + 1 : quote + 3]))
        if ending.startswith(ENDINGS[:4]):
            symbols[quote] = SHORT
        elif ending in ENDINGS[4:]:
            symbols[quote] = LONG
    now = states(symbols)
    before, after = np.concatenate([[EDGE], now[:-1]]), np.concatenate([symbols[1:], [EDGE]])
    run = (now == LETTER) | (now == NUMBER) | (now == OTHER)
    white, was_white = (now == SPACE) | (now == BLANK), (before == SPACE) | (before == BLANK)
    follows = (after != SPACE) & (after != BLANK) & (after != EDGE)
    begun = (now >= ONE_LEFT) & (before < ONE_LEFT)
    return (run & (now != before) & (before != SPACE)) | (white & (~was_white | follows)) | begun | (symbols == EDGE)


#: Above any rank.
NO_RANK = 1 << 30


class Codec:
    """Ranks of a tiktoken file, by which text is encoded and ids are decoded."""

    def __init__(self, path: str, cache: int = 1 << 17) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.single = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        self.pairs = {
            (self.ranks[t[:i]] << 20) | self.ranks[t[i:]]: rank
            for t, rank in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        }
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.length = np.array([len(t) for t in self.bytes], dtype=np.int64)
        self.first = np.cumsum(self.length) - self.length
        keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.pair_keys, self.pair_ranks = keys, np.array([self.pairs[k] for k in keys.tolist()], dtype=np.int64)
        self.most, self.known = cache, {}

    def ids_of(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each pre-token; those not in the cache are merged together, and the cache begins anew when it is full."""
        new = [p for p in set(pieces) if p not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(set(pieces))
        self.known.update(zip(new, self.merged(new)))
        return list(map(self.known.__getitem__, pieces))

    def merged(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of distinct pre-tokens: in each the pair of the lowest rank is merged, the leftmost first, while any can be."""
        out: list[tuple[int, ...] | None] = [None] * len(pieces)
        short = []
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = (whole,)
            elif len(piece) > 64:
                out[i] = self._merged_long(piece)
            else:
                short.append(i)
        for i, ids in zip(short, self._merged_together([pieces[i] for i in short])):
            out[i] = ids
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)

    def _merged_together(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """One merge a round in every piece that has one; pieces without leave."""
        if not pieces:
            return []
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.array(self.single, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        last = np.zeros(len(ids), bool)
        last[np.cumsum(sizes) - 1] = True
        rank = np.append(self._rank(ids[:-1], ids[1:]), NO_RANK)
        rank[last] = NO_RANK
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(ids)), first)
            ended = (best >> 32) == NO_RANK
            if ended.any():
                gone = np.repeat(ended, np.diff(np.append(first, len(ids))))
                done.append((owner[gone], ids[gone]))
                shift = np.cumsum(gone)
                ids, owner, last, rank = ids[~gone], owner[~gone], last[~gone], rank[~gone]
                best = best[~ended]
            at = best & 0xFFFFFFFF
            if ended.any():
                at = at - shift[at]
            if not len(at):
                break
            ids[at] = rank[at]
            last[at] = last[at + 1]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, owner, last, rank = ids[stay], owner[stay], last[stay], rank[stay]
            at = at - np.arange(len(at))
            after = at[~last[at]]
            rank[at] = NO_RANK
            rank[after] = self._rank(ids[after], ids[after + 1])
            before = at[at > 0] - 1
            before = before[~last[before]]
            rank[before] = self._rank(ids[before], ids[before + 1])
        owner, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        flat, ends = ids[order].tolist(), np.cumsum(np.bincount(owner, minlength=len(pieces))).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def _merged_long(self, piece: bytes) -> tuple[int, ...]:
        """The same for a long one, with a heap over a linked list, in n log n steps."""
        ids: list[int] = [self.single[b] for b in piece]
        left, right = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (rank := self.pairs.get((ids[i] << 20) | ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = rank, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return tuple(x for x in ids if x >= 0)

    def encode(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and the byte at which each token begins."""
        joined = "\n" + "\n".join(texts) + "\n"
        data = joined.encode("utf-8", "replace")
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4")
        edges = np.cumsum([0, *[len(t) + 1 for t in texts]])
        begin = starts(points, edges)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        chars = np.flatnonzero(begin)
        cuts = at[chars].tolist()
        of_edge = np.searchsorted(chars, edges).tolist()
        coded = self.ids_of([data[i:j] for i, j in zip(cuts, cuts[1:])])  # edges too, which nobody reads
        for a, b in zip(of_edge, of_edge[1:]):
            ids = np.array(array("I", chain.from_iterable(coded[a + 1 : b])), dtype=np.uint32)
            yield ids, np.cumsum(self.length[ids]) - self.length[ids]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of the ids; each token's own are copied to its offset."""
        if not len(ids):
            return b""
        length = self.length[ids]
        source = np.repeat(self.first[ids] - offsets, length)
        return self.flat[np.arange(int(offsets[-1] + length[-1])) + source].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def chunks(texts: Sequence[str | None], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in order, as many at a time as have about ``chars`` characters; null as empty."""
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def encoded(documents: DataFrame, *, path: str | None = None, keep: Sequence[str] | None = None, offsets: bool = True) -> DataFrame:
    """``keep`` (all columns but ``text`` by default) with ``n_tokens``, ``ids`` and ``offsets`` (bytes, if asked for) of each whole text.

    Null and empty texts have no tokens; rows are encoded each, also repeated ones; ``ids`` is by the rank file
    at ``path``, which every machine must have. No special tokens: their strings are ordinary text.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(texts):
        made = [x for part in chunks(texts) for x in codec(path).encode(part)]
        return [[len(ids) for ids, _ in made], [ids for ids, _ in made], *([[at for _, at in made]] if offsets else [])]

    keep = [c for c in documents.columns if c != "text"] if keep is None else keep
    return map_text(documents, "n_tokens long, ids array<int>" + ", offsets array<long>" * offsets, run, keep)


def digests(documents: DataFrame, *, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, and SHA-256 of the ids (little-endian, 32 bits each) and of the bytes decoded from them."""
    path = path or public_tokenizers.path(RANKS)

    def run(texts):
        n, coded, back = [], [], []
        for part in chunks(texts):
            for ids, offsets in codec(path).encode(part):
                n.append(len(ids))
                coded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(codec(path).decode(ids, offsets)).hexdigest())
        return [n, coded, back]

    return map_text(documents, "n_tokens long, ids_sha256 string, decoded_sha256 string", run, ["doc_id"])
