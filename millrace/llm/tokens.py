"""Token ids of whole Arrow text columns by a public tokenizer.

A text is cut where no token of the vocabulary's pattern can reach across: in
front of ASCII white space that follows something else. Equal pieces then have
equal ids, and the ids of a text are the concatenation of its pieces' ids,
exactly those of the library. Pieces are cut and numbered in the Arrow buffer;
only distinct ones become Python strings, and are encoded once.

Texts are worked off in blocks of bounded bytes, cut between pieces, so a very
long text costs no more at a time than many short ones; a text without white
space is one piece. What is remembered of pieces is bounded in bytes.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from millrace.llm.words import text_buffers

BLOCK_BYTES = 8 << 20  # of pieces at a time
LONGEST_REMEMBERED = 64  # characters
REMEMBERED_BYTES = 96 << 20  # of a worker's memory, about
ENTRY_BYTES = 160  # that a remembered piece takes besides its ids
#: Letters beyond ASCII that stay one composed letter under every normal form used here (fixed values).
LATIN = "\xc0-\xd6\xd8-\xf6\xf8-\xff"
PLAIN = re.compile(f"[A-Za-z{LATIN}]+")


def flags(values: list[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[values] = True
    return table


WHITE = flags([0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20])
BLANK = flags([0x20])
LETTERS = flags([*range(0x41, 0x5B), *range(0x61, 0x7B)])
MARKS = flags([*b".,;:!?"])
#: Last byte and last but one of white space beyond ASCII (fixed values): NEL, NBSP, U+1680, U+2000 and on, U+3000.
WIDE_LAST = flags([0x85, 0xA0, 0x9F, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)])
WIDE_BEFORE = flags([0xC2, 0x9A, 0x80, 0x81])


def piece_starts(data: np.ndarray, bounds: np.ndarray, cut_at: np.ndarray = WHITE, marks: bool = False) -> np.ndarray:
    """Where pieces begin: each text that is not empty, and each byte of ``cut_at`` that follows no white space.

    ``marks``: a punctuation mark that follows an ASCII letter begins one too.
    """
    start = cut_at[data]
    start[1:] &= ~WHITE[data[:-1]]
    at = np.flatnonzero(start[2:]) + 2
    start[at[WIDE_LAST[data[at - 1]] & WIDE_BEFORE[data[at - 2]]]] = False
    if marks:
        start[1:] |= MARKS[data[1:]] & LETTERS[data[:-1]]
    first = bounds[:-1][bounds[1:] > bounds[:-1]]
    start[first] = True
    return np.flatnonzero(start)


@dataclass
class Pieces:
    """A block of pieces: the distinct ones and, in order, which one stands at each place."""

    distinct: list[str]
    which: pa.Array


def pieces_of(data: np.ndarray, starts: np.ndarray, block_bytes: int = BLOCK_BYTES) -> Iterator[Pieces]:
    """The pieces of a buffer, by blocks of bounded bytes (a longer piece is a block)."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    at, n = 0, len(starts)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + block_bytes, "right")) - 1
        end = min(max(end, at + 1), n)
        cut = offsets[at : end + 1]
        column = pa.Array.from_buffers(
            pa.large_string(), end - at, [None, pa.py_buffer(cut - cut[0]), pa.py_buffer(data[cut[0] : cut[-1]])]
        )
        coded = column.dictionary_encode()
        yield Pieces(coded.dictionary.to_pylist(), coded.indices)
        at = end


def numbers_of(values: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Packed numbers end to end, and how many each value has."""
    lengths = np.fromiter(map(len, values), np.int64, len(values)) // kind.itemsize
    return np.frombuffer(b"".join(values), kind), lengths


def take_lists(flat: np.ndarray, lengths: np.ndarray, which: pa.Array) -> np.ndarray:
    """The numbers of the chosen lists end to end."""
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)).take(which).flatten().to_numpy()


class Memory:
    """What has been worked out for pieces, the less lately used half given up when it is full. Long pieces are never kept."""

    def __init__(self, work_out, limit: int = REMEMBERED_BYTES) -> None:
        self.work_out, self.limit, self.size = work_out, limit, 0
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def get(self, pieces: list[str]) -> list[bytes]:
        out = list(map(self.recent.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        if not missing:
            return out
        if 2 * self.size > self.limit:
            self.recent, self.older, self.size = {}, self.recent, 0
        older, recent, new = self.older, self.recent, []
        for i in missing:
            made = older.get(pieces[i])
            if made is None:
                new.append(i)
            else:
                out[i] = recent[pieces[i]] = made
        self.size += ENTRY_BYTES * (len(missing) - len(new))
        for i, made in zip(new, self.work_out([pieces[i] for i in new])):
            out[i] = made
            if len(pieces[i]) <= LONGEST_REMEMBERED:
                recent[pieces[i]] = made
                self.size += ENTRY_BYTES + len(made)
        return out


class Encoder:
    """Ids of a vocabulary of the tokenizers library, in two bytes each where it allows, else four.

    A piece of letters is given to the library's model as the library's own
    normaliser and pattern would give it, which spares most of the work; how
    they would is asked of them once, and where they do something else with
    such pieces, all pieces take the library's whole way.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.type = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.letters, self.blank, self.fold = self._plain_form()
        self.memory = Memory(self._work_out)

    def _seen(self, text: str) -> list[str]:
        normal = self.tokenizer.normalizer
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal.normalize_str(text) if normal else text)]

    def _plain_form(self) -> tuple[dict[int, str], str, bool]:
        """How letters and a blank in front of them reach the model; no letters if not in the expected way."""
        if self.tokenizer.pre_tokenizer is None:
            return {}, "", False
        letters = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
        fold = self._seen("A") == ["a"]
        seen = {ord(c): self._seen(c) for c in letters}
        blank = {("ab", "..", "ab"): "", ("Ġab", "..", "ab"): "Ġ"}.get(tuple(self._seen(" ab..ab")))
        expected = blank is not None and self._seen("AB") == ["ab" if fold else "AB"] and all(len(x) == 1 for x in seen.values())
        if not expected or self._seen("ab\xe9\xc9") != ["ab" + seen[0xE9][0] + seen[0xC9][0]]:
            return {}, "", False
        return {c: x[0] for c, x in seen.items()}, blank, fold

    def _work_out(self, pieces: list[str]) -> list[bytes]:
        tokenize, code, blank, letters = self.model.tokenize, self.code, self.blank, self.letters
        out, whole = [b""] * len(pieces), []
        for i, piece in enumerate(pieces):
            word = piece[1:] if piece[0] == " " else piece
            if not letters or not word.isalpha() or not (word.isascii() or PLAIN.fullmatch(word)):
                whole.append(i)
                continue
            word = word.lower() if self.fold else word
            word = word if word.isascii() else word.translate(letters)
            out[i] = array(code, [t.id for t in tokenize(blank + word if piece[0] == " " else word)]).tobytes()
        for at in range(0, len(whole), 20_000):
            part = whole[at : at + 20_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False)):
                out[i] = array(code, e.ids).tobytes()
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids before each text and in all. Null is as empty."""
        data, bounds = text_buffers(column)
        if not len(data):
            return np.zeros(0, self.type), np.zeros(len(bounds), np.int64)
        starts = piece_starts(data, bounds, marks=bool(self.letters))
        ids, lengths = [], []
        for block in pieces_of(data, starts):
            flat, n = numbers_of(self.memory.get(block.distinct), self.type)
            ids.append(take_lists(flat, n, block.which))
            lengths.append(n[block.which.to_numpy()])
        before = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        return np.concatenate(ids), before[np.searchsorted(starts, bounds)]


def packed_lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Lists of numbers as bytes in the machine's order, without a copy."""
    offsets = (bounds * flat.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with one more after each text."""
    n = len(bounds) - 1
    out = np.insert(ids, bounds[1:], np.full(n, end_id, ids.dtype)) if n else ids
    return out, bounds + np.arange(n + 1)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for a worker process."""
    return Encoder(path)


def decimal_table(n: int, marks: str) -> pa.Array:
    """``0`` to ``n - 1`` in decimal, each followed by each of the marks in turn."""
    return pa.array(list(chain.from_iterable((f"{i}{m}" for m in marks) for i in range(n))), pa.large_string())


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
