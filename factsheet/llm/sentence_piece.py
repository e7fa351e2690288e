"""SentencePiece encoding for merge-type vocabularies: an agenda of adjacent symbol pairs in the order of their scores."""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from factsheet.llm.common import map_text

MODEL = "piece_bpe_32k.model"
#: A pair of symbols is one number: the left one above these bits, the right one in them.
_BITS = 22
#: Places of the table that says whether two characters may be joined; a place shared by chance only spares a cut.
_PLACES = 22
#: Slices of more characters have an agenda of their own.
_SHORT = 48
#: Above the value of any pair.
_NONE = 1 << 50
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _place(pair: np.ndarray) -> np.ndarray:
    return (pair.astype(np.uint64) * _SPREAD) >> np.uint64(64 - _PLACES)


class Pieces:
    """A vocabulary of normal, control, unknown and byte pieces, as the sentencepiece library reads it.

    A symbol is the id of a piece, or, for a character that is no piece, its code point above all ids. Two
    neighbours whose characters never stand side by side in any piece are never merged, nor is anything across
    them. So a text is cut there, and a slice's ids depend on the slice alone: they are kept in a cache.
    """

    def __init__(self, path: str, cache: int = 1 << 17) -> None:
        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        if any(library.is_unused(i) for i in range(n)):
            raise ValueError("pieces marked as unused would have to be split again")
        special = {i for i in range(n) if library.is_control(i) or library.is_unknown(i) or library.is_byte(i)}
        self.ids = {library.id_to_piece(i): i for i in range(n) if i not in special}
        self.first_character = n
        scores = sorted({library.get_score(i) for i in self.ids.values()}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        #: Place of a piece's score among all, the highest first; equal scores share it.
        self.order = {i: order[library.get_score(i)] for i in self.ids.values()}
        self.pairs: dict[int, int] = {}
        joined = np.zeros(1 << _PLACES, bool)
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = self.symbol(piece[:k]), self.symbol(piece[k:])
                if left >= 0 and right >= 0:
                    self.pairs[left << _BITS | right] = i
            points = np.array([ord(c) for c in piece], np.int64)
            joined[_place(points[:-1] << _BITS | points[1:])] = True
        self.joined = joined
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        made = [self.pairs[k] for k in self.pair_keys.tolist()]
        self.pair_values = np.array([self.order[i] << _BITS | i for i in made], np.int64)
        points = np.arange(0x110000)
        self.of_character = points + n
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_character[ord(piece)] = i
        in_bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.in_bytes = in_bytes if all(library.is_byte(i) for i in in_bytes) else None
        self.unknown = library.unk_id()
        self.begin = [i for i in [library.bos_id()] if i >= 0]
        self.end = [i for i in [library.eos_id()] if i >= 0]
        self.most, self.known = cache, {}

    def symbol(self, piece: str) -> int:
        """The symbol of a piece or of a single character, else -1."""
        found = self.ids.get(piece)
        if found is not None:
            return found
        return self.first_character + ord(piece) if len(piece) == 1 else -1

    def _ids(self, symbols: list[int]) -> tuple[int, ...]:
        """The ids of symbols: those of its bytes for a character that is no piece, where the vocabulary has them."""
        if max(symbols) < self.first_character:
            return tuple(symbols)
        out: list[int] = []
        for s in symbols:
            if s < self.first_character:
                out.append(s)
            else:
                out.extend([self.unknown] if self.in_bytes is None else [self.in_bytes[b] for b in chr(s - self.first_character).encode()])
        return tuple(out)

    def merged(self, piece: str) -> tuple[int, ...]:
        """Ids of a slice: of all pairs that make a piece the one of the highest score is merged, the leftmost first, while there is one.

        The agenda holds every such pair of neighbours there has been. One that has changed since is passed over.
        """
        symbols: list[int] = [self.symbol(c) for c in piece]
        pairs, order, last = self.pairs, self.order, len(symbols) - 1
        agenda = []
        for i in range(last):
            made = pairs.get(symbols[i] << _BITS | symbols[i + 1])
            if made is not None:
                agenda.append((order[made], i, symbols[i], symbols[i + 1], made))
        heapq.heapify(agenda)
        after, before = list(range(1, last + 2)), list(range(-1, last))
        while agenda:
            _, i, left, right, made = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != left or j > last or symbols[j] != right:
                continue
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k <= last:
                before[k] = i
                new = pairs.get(made << _BITS | symbols[k])
                if new is not None:
                    heapq.heappush(agenda, (order[new], i, made, symbols[k], new))
            h = before[i]
            if h >= 0:
                new = pairs.get(symbols[h] << _BITS | made)
                if new is not None:
                    heapq.heappush(agenda, (order[new], h, symbols[h], made, new))
        return self._ids([s for s in symbols if s >= 0])

    def _values(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair the place of its score and, in the low bits, what it makes; ``_NONE`` if nothing."""
        key = left << _BITS | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_values[at], _NONE)

    def merged_together(self, slices: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """The same for many short slices: the heads of all their agendas at once.

        Slices of as many symbols are the rows of a matrix, and so are the values of their pairs. Each round takes
        every row's best pair and leaves it one symbol shorter; so it joins the rows that are that short.
        """
        by_width: dict[int, list[str]] = {}
        for s in slices:
            by_width.setdefault(len(s), []).append(s)
        names: list[str] = []
        width = max(by_width, default=0)
        symbols, values = np.zeros((0, width), np.int64), np.zeros((0, max(width - 1, 0)), np.int64)
        for width in range(width, 0, -1):
            if fresh := by_width.get(width):
                points = np.frombuffer("".join(fresh).encode("utf-32-le", "replace"), "<u4").reshape(-1, width)
                added = self.of_character[points]
                names += fresh
                symbols = np.concatenate([symbols, added])
                values = np.concatenate([values, self._values(added[:, :-1], added[:, 1:])])
            if width == 1:
                yield from zip(names, map(self._ids, symbols.tolist()))
                return
            rows = np.arange(len(names))
            at = (values >> _BITS).argmin(axis=1) if len(names) else rows
            best = values[rows, at]
            done = best == _NONE
            yield from zip([names[i] for i in np.flatnonzero(done)], map(self._ids, symbols[done].tolist()))
            names = [names[i] for i in np.flatnonzero(~done)]
            symbols, values, at, best = symbols[~done], values[~done], at[~done], best[~done]
            rows, column = np.arange(len(names)), np.arange(width)
            symbols[rows, at] = best & ((1 << _BITS) - 1)
            symbols = symbols[column != at[:, None] + 1].reshape(len(names), width - 1)
            # the value at ``at`` goes; those of the pairs before and after it are new
            values = values[column[:-1] != at[:, None]].reshape(len(names), width - 2)
            for shift in (-1, 0):
                there = (at + shift >= 0) & (at + shift < width - 2)
                row, place = rows[there], (at + shift)[there]
                values[row, place] = self._values(symbols[row, place], symbols[row, place + 1])

    def ids_of(self, slices: list[str]) -> list[tuple[int, ...]]:
        """Ids of each slice; the cache begins anew when it is full."""
        found = list(map(self.known.get, slices))
        new = {s for s, ids in zip(slices, found) if ids is None}
        if not new:
            return found
        if len(self.known) + len(new) > self.most:
            self.known.clear()
        made = {s: self.merged(s) for s in new if len(s) > _SHORT}
        made.update(self.merged_together([s for s in new if len(s) <= _SHORT]))
        self.known.update(made)
        return [made[s] if ids is None else ids for s, ids in zip(slices, found)]

    def encode(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """For each text its ids, with those of begin and end where the vocabulary has them.

        The library brings a text to the vocabulary's normal form; all else is done here.
        """
        normal = [self.library.normalize(t) for t in texts]
        whole = "".join(normal)
        points = np.frombuffer(whole.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.joined[_place(points[:-1] << _BITS | points[1:])]
        edges = np.cumsum([0, *map(len, normal)])
        cut[edges] = True
        places = np.flatnonzero(cut)
        cuts, of_edge = places.tolist(), np.searchsorted(places, edges).tolist()
        coded = self.ids_of([whole[i:j] for i, j in zip(cuts, cuts[1:])])
        for a, b in zip(of_edge, of_edge[1:]):
            ids = np.array(array("I", chain(self.begin, chain.from_iterable(coded[a:b]), self.end)), np.uint32)
            if self.in_bytes is None:  # the library takes neighbours that it does not know as one
                unknown = ids == self.unknown
                ids = ids[~(unknown & np.concatenate([[False], unknown[:-1]]))]
            yield ids

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each, by the library."""
        return self.library.decode([x.tolist() for x in ids])


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def parts(texts: Sequence[str | None], characters: int = 1 << 19) -> Iterator[list[str]]:
    """Texts in order, as many at a time as have about ``characters``; null as empty. A longer text is a part of its own."""
    held: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > characters:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encoded(documents: DataFrame, *, path: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` (all columns but ``text`` by default) with ``n_tokens`` and ``ids`` of each whole text.

    ``path`` is a model file that every machine must have. Ids of begin and end are put around every text, also
    around a null or empty one, which has no other. Rows are encoded each, repeated ones too; an empty table
    gives an empty table; columns called ``n_tokens`` or ``ids`` are replaced. Special pieces written in a text
    are ordinary text. Vocabularies with unused pieces are refused.
    """
    path = path or public_tokenizers.path(MODEL)

    def run(texts):
        ids = [x for part in parts(texts) for x in pieces(path).encode(part)]
        return [list(map(len, ids)), ids]

    keep = [c for c in documents.columns if c != "text"] if keep is None else keep
    return map_text(documents, "n_tokens long, ids array<int>", run, keep)


def decoded(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """All columns, with ``decoded``: the text of ``ids``, which are a vocabulary's; null ids give an empty text."""
    path = path or public_tokenizers.path(MODEL)
    kept = [c for c in encoded.columns if c.lower() != "decoded"]
    source = encoded.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pieces(path).library.decode([x or [] for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, "decoded"])

    return source.mapInArrow(run, StructType([*source.schema, StructField("decoded", StringType())]))


def digests(documents: DataFrame, *, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, and SHA-256 of the ids (little-endian, 32 bits each) and of the text decoded from them, in UTF-8.

    One row per row, as in ``encoded``: a null or empty text has the ids of begin and end and decodes to nothing.
    """
    path = path or public_tokenizers.path(MODEL)

    def run(texts):
        n, coded, back = [], [], []
        for part in parts(texts):
            ids = list(pieces(path).encode(part))
            n += map(len, ids)
            coded += [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            back += [hashlib.sha256(t.encode()).hexdigest() for t in pieces(path).decode(ids)]
        return [n, coded, back]

    return map_text(documents, "n_tokens long, ids_sha256 string, decoded_sha256 string", run, ["doc_id"])


def differences(documents: DataFrame, *, path: str | None = None) -> DataFrame:
    """The rows (``doc_id``, ``ids``, ``expected``) whose ids are not the library's: a check in the batches that Arrow brings.

    No rows, if all agree; nulls as in ``encoded``.
    """
    path = path or public_tokenizers.path(MODEL)

    def run(texts):
        own = [x for part in parts(texts) for x in pieces(path).encode(part)]
        theirs = pieces(path).library.encode([t or "" for t in texts], add_bos=True, add_eos=True, num_threads=1)
        return [own, theirs]

    return map_text(documents, "ids array<int>, expected array<int>", run, ["doc_id"]).filter("ids <> expected")
