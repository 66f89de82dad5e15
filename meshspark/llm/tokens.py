"""Whole texts to ids with public tokenizers, on executors.

A batch of texts is cut where the tokenizer's own pre-tokenizer is certain to cut, its distinct pieces are found by one
Arrow hash table, and the tokenizer encodes those that the worker's store does not hold. The store is a few flat arrays
of bounded bytes. Texts whose cuts are not certain are given whole to the tokenizer. Either way the ids are those of
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, slices

#: Bytes a worker's store may take; the pieces met longest ago go first.
STORE_BYTES = 24 << 20
#: Bytes of text worked on at a time.
SLICE_BYTES = 3 << 20
#: Pieces longer than this are not kept.
LONGEST_PIECE = 64

#: Kinds of bytes: white space that cuts, letters, digits, signs, and all that is left to the tokenizer.
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)


def _kinds(spaces: bytes) -> np.ndarray:
    """The kind of each ASCII byte; apostrophes begin contractions and are left to the tokenizer."""
    table = np.full(256, _OTHER, dtype=np.uint8)
    for k in range(33, 127):
        table[k] = _LETTER if chr(k).isalpha() else _DIGIT if chr(k).isdigit() else _SIGN
    table[ord("'")] = _OTHER
    table[list(spaces)] = _SPACE
    return table


_BYTE_KINDS, _WORD_KINDS = _kinds(b" \n"), _kinds(b" \t\n\x0b\x0c\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _kinds_of(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The kind of every byte; the two bytes of U+00C0 to U+00FF, but for U+00D7 and U+00F7, are letters."""
    kinds = table[data]
    first = np.flatnonzero(data[:-1] == 0xC3)
    if len(first):
        second = data[first + 1]
        first = first[(second != 0x97) & (second != 0xB7)]
        kinds[first] = _LETTER
        kinds[first + 1] = _LETTER
    return kinds


def _has_foreign_space(data: np.ndarray) -> np.ndarray:
    """Places of white space other than the space and \\n, and of control characters."""
    found = [np.flatnonzero((data < 32) & (data != 10))]
    at = lambda k: data[np.minimum(lead + k, len(data) - 1)]
    for byte, test in (
        (0xC2, lambda: (at(1) == 0x85) | (at(1) == 0xA0)),
        (0xE1, lambda: (at(1) == 0x9A) & (at(2) == 0x80)),
        (0xE2, lambda: ((at(1) == 0x80) & ((at(2) <= 0x8A) | (at(2) == 0xA8) | (at(2) == 0xA9) | (at(2) == 0xAF))) | ((at(1) == 0x81) & (at(2) == 0x9F))),
        (0xE3, lambda: (at(1) == 0x80) & (at(2) == 0x80)),
    ):
        lead = np.flatnonzero(data == byte)
        if len(lead):
            found.append(lead[test()])
    return np.concatenate(found)


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """Byte -> the letter that byte-level vocabularies write for it: itself if it prints, else the next from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


class Store:
    """Pieces and their ids in flat arrays. Place 0 is the end of a text."""

    def __init__(self, end: np.ndarray):
        self.pieces = pa.array([b"\0end"], pa.binary())
        self.ids, self.starts, self.sizes = end, np.zeros(1, dtype=np.int64), np.array([len(end)], dtype=np.int64)
        self.met = np.zeros(1, dtype=np.int32)
        self.turn = 0

    def add(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.met = np.concatenate([self.met, np.full(len(sizes), self.turn, dtype=np.int32)])

    def nbytes(self) -> int:
        return self.pieces.nbytes + self.ids.nbytes + self.starts.nbytes + self.sizes.nbytes + self.met.nbytes

    def shrink(self, most: int) -> None:
        """Forget long pieces, and if need be the half met longest ago."""
        size = self.nbytes()
        keep = pc.binary_length(self.pieces).to_numpy(zero_copy_only=False) <= LONGEST_PIECE
        if size > most:
            order = np.argsort(self.met, kind="stable")
            keep[order[: len(order) // 2]] = False
        elif keep.all():
            return
        keep[0] = True
        at = np.flatnonzero(keep)
        self.ids, self.sizes = self.gather(at), self.sizes[at]
        self.starts, self.met = np.cumsum(self.sizes) - self.sizes, self.met[at]
        self.pieces = self.pieces.take(pa.array(at))

    def gather(self, places: np.ndarray) -> np.ndarray:
        """The ids of the pieces at ``places``, one after the other."""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.starts[places] - (ends - sizes), sizes)
        return self.ids[at]


class Encoder:
    """Ids of texts (null: empty), with the end id appended if given."""

    def __init__(self, path: str, end_id: int | None = 1):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = {"byte_bpe_50k.json": "byte", "word_bpe_49k.json": "word"}.get(os.path.basename(path))
        self.end = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        self.store = Store(self.end)
        # the vocabulary's own merges without its normalizer and pre-tokenizer, for pieces put one to a line
        self.letters = str.maketrans(byte_letters())
        if self.kind:
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = CharDelimiterSplit("\n")
        self.line = self.ends = None
        if self.kind == "byte":
            self.line = self.tokenizer.token_to_id(byte_letters()[10])
        elif self.kind == "word":
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(array("I", e.ids), dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each) of pieces that are one pre-token each, all in one call."""
        # no merge joins a piece and the line break's own letter after it, so its id ends a piece where no suffix does
        mark = byte_letters()[10]
        lines = b"\n".join(runs).decode("latin-1").translate(self.letters).replace(mark, mark + "\n" if self.kind == "byte" else "\n")
        lines += mark if self.kind == "byte" else ""
        ids = np.array(array("I", self.bare.encode_batch_fast([lines], add_special_tokens=False)[0].ids), dtype=np.uint32)
        if self.kind == "byte":
            stops = np.flatnonzero(ids == self.line)
            sizes = np.diff(stops, prepend=-1) - 1
            return ids[ids != self.line], sizes
        stops = np.flatnonzero(self.ends[ids])
        return ids, np.diff(stops, prepend=-1)

    def _learn(self, pieces: pa.Array) -> None:
        """Put pieces into the store: pre-tokens by the bare merges, all others through the whole tokenizer."""
        table = _BYTE_KINDS if self.kind == "byte" else _WORD_KINDS
        data, bounds = buffer_of(pieces)
        starts = bounds[:-1]
        plain = np.maximum.reduceat(_kinds_of(data, table), starts) < _OTHER
        plain &= data[starts] != 10
        runs, others = pieces.filter(pa.array(plain)), pieces.filter(pa.array(~plain))
        if len(runs):
            self.store.add(runs, *self._runs(runs.to_pylist()))
        if len(others):
            ids = self._encode([p.decode() for p in others.to_pylist()])
            self.store.add(others, np.concatenate(ids), np.array([len(x) for x in ids], dtype=np.int64))

    def _uncertain(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The texts, at ``bounds`` in ``data``, whose cuts are not certain."""
        hits = [np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))]  # special tokens
        if self.kind == "byte":
            hits.append(_has_foreign_space(data))
            # runs of two spaces or line breaks are cut singly unless they end the text
            space = (data == 32) | (data == 10)
            two = np.flatnonzero(space[:-1] & space[1:])
            ends = np.zeros(len(data) + 1, dtype=bool)
            ends[bounds[1:]] = True
            inside = two[~ends[two + 1]]
            third = np.minimum(inside + 2, len(data) - 1)
            hits.append(inside[ends[inside + 2] | space[third]])
        return np.unique(np.searchsorted(bounds, np.concatenate(hits), side="right") - 1)

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(pieces of texts that are certain, number of pieces of each text)."""
        n = len(data)
        kinds = _kinds_of(data, _BYTE_KINDS if self.kind == "byte" else _WORD_KINDS)
        space = kinds == _SPACE
        first = np.zeros(n + 1, dtype=bool)  # beginnings of parts
        first[bounds] = True
        if self.kind == "byte":  # a line break, or a word and the space before it
            first[:n] |= space
            first[1:] |= data == 10
        else:
            first[1:] |= space
            kept = ~space
            # white space goes; what follows it begins a part, and texts begin at the count of bytes kept before
            place = np.concatenate([[0], np.cumsum(kept)])
            bounds = place[bounds]
            firsts = np.flatnonzero(first[:n] & kept)
            data, kinds = data[kept], kinds[kept]
            n = len(data)
            first = np.zeros(n + 1, dtype=bool)
            first[place[firsts]] = True
            first[n] = True
        if not n:
            return pa.array([], pa.binary()), np.zeros(len(bounds) - 1, dtype=np.int64)
        starts = np.flatnonzero(first[:n])
        other = np.maximum.reduceat(kinds, starts) == _OTHER
        inner = np.zeros(n, dtype=bool)  # where the kind changes within a part
        inner[1:] = (kinds[1:] != kinds[:-1]) & (kinds[1:] != _SPACE) & (kinds[:-1] != _SPACE)
        if self.kind == "word":
            inner[1:] |= (kinds[1:] == _DIGIT) & (kinds[:-1] == _DIGIT)
        if other.any():
            left = np.repeat(other, np.diff(np.append(starts, n)))
            inner &= ~left
        if self.kind == "word":
            data = _LOWER[data]
            high = np.flatnonzero(data[:-1] == 0xC3) + 1
            high = high[(data[high] >= 0x80) & (data[high] <= 0x9E) & (data[high] != 0x97)]
            if other.any():
                high = high[~left[high]]
            data[high] += 32
        cuts = np.append(np.flatnonzero(first[:n] | inner), n).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
        return pieces, np.diff(np.searchsorted(cuts[:-1], bounds, side="left"))

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their bounds); ``texts`` are binary without nulls."""
        data, bounds = buffer_of(texts)
        odd = np.arange(len(texts)) if self.kind is None else self._uncertain(data, bounds) if len(data) else np.zeros(0, dtype=np.int64)
        if len(odd):
            keep = np.ones(len(texts), dtype=bool)
            keep[odd] = False
            parts = {int(k): np.concatenate([ids, self.end]) for k, ids in zip(odd, self._encode([texts[int(k)].as_py().decode() for k in odd]), strict=True)}
            if keep.any():
                ids, at = self._encode_slice(texts.filter(pa.array(keep)))
                parts |= {int(k): ids[at[j] : at[j + 1]] for j, k in enumerate(np.flatnonzero(keep))}
            ordered = [parts[k] for k in range(len(texts))]
            return np.concatenate(ordered), np.cumsum([0, *map(len, ordered)])
        store = self.store
        store.turn += 1
        pieces, per_text = self._pieces(data, bounds)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        place = pc.index_in(distinct, value_set=store.pieces)
        if place.null_count:
            self._learn(distinct.filter(pc.is_null(place)))
            place = pc.index_in(distinct, value_set=store.pieces)
        place = place.to_numpy(zero_copy_only=False).astype(np.int64)
        store.met[place] = store.turn
        ends = np.cumsum(per_text)
        where = np.insert(place[coded.indices.to_numpy(zero_copy_only=False)], ends, 0) if len(distinct) else np.zeros(len(texts), dtype=np.int64)
        ids = store.gather(where)
        bounds = np.concatenate([[0], np.cumsum(store.sizes[where])[ends + np.arange(len(ends))]])
        store.shrink(STORE_BYTES)
        return ids, bounds

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(texts before, ids, bounds) for stretches of ``texts``, a string array."""
        for low, part in slices(texts, SLICE_BYTES):
            yield low, *self._encode_slice(part)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """One uint32 array per text."""
        return [ids[a:b] for _, ids, at in self.slices(pa.array(texts, pa.string())) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int | None = 1) -> Encoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    return Encoder(path, end_id)


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids as bytes, two each where all are below 65536, else four; the first byte says which."""
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if data[0] == 2 else "<u4", offset=1)


def encode_documents(rows: DataFrame, path: str, end_id: int | None = 1, text_col: str = "text") -> DataFrame:
    """``rows`` without its text, plus n_tokens long, ids binary (see ``pack_ids``) and at long, the row's place in its task."""
    others = [c for c in rows.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            for low, ids, bounds in encoder(path, end_id).slices(batch.column(len(others))):
                n = len(bounds) - 1
                cuts = zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
                packed = pa.array([pack_ids(ids[a:b]) for a, b in cuts], pa.binary())
                kept = batch.slice(low, n).columns[: len(others)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(bounds), pa.int64()), packed, pa.array(np.arange(at, at + n), pa.int64())], names=[*others, "n_tokens", "ids", "at"])
                at += n

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*others).dtypes)
    return rows.select(*others, F.col(text_col).cast("string")).mapInArrow(run, f"{schema}, n_tokens long, ids binary, at long")
