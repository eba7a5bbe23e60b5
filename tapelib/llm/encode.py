"""Token ids of whole texts by a public tokenizer, with a cache of pieces that the tokenizer treats alone."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

from tapelib.llm.text import text_buffers
from tapelib.llm.worker import kept

#: A word with the space before it, of letters that every definition counts as letters and that no normalisation changes but
#: for case: A-Z, a-z and, of Latin-1, À-Ö, Ø-ö, ø-ÿ.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Pieces kept; of twice as many, those used least are dropped.  Only speed depends on it.
CACHE_PIECES = 400_000
#: Longer pieces (bytes) are encoded anew each time.
LONGEST = 48
#: Bytes of text encoded at once; a longer single text is encoded alone.
CHUNK_BYTES = 4 << 20
#: Bytes of new pieces that the tokenizer gets at once.
GROUP_BYTES = 200_000


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks the bytes before which both tokenizers cut, whatever stands around, in texts one after the other that end at
    ``ends``: a space before what no definition counts as white space (a byte-level tokenizer gives it to the word), an ASCII
    mark but the apostrophe after a letter, a line break after an ASCII mark, letter or digit, and a letter after that."""
    letter, visible = (data | 32) - 97 < 26, data - 33 < 94
    mark = visible & ~letter & (data - 48 >= 10) & (data != 39)
    # first bytes of characters: ASCII, and all others but of the blocks that hold white space
    sure = visible | (data - 0xC3 < 0x1E) | (data - 0xE4 < 0x11)
    space, line = data == 32, visible[:-1] & (data[1:] == 10)
    space[ends - 1] = False  # what follows is another text
    out = np.zeros(len(data) + 1, dtype=bool)
    out[:-2] = space[:-1] & sure[1:]
    out[1:-1] |= letter[:-1] & mark[1:] | line
    out[2:-1] |= line[:-1] & letter[2:]
    return out


def _groups(pieces: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for p in pieces:
        group.append(p)
        size += len(p) + 1
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


class Encoder:
    """``spaced``: byte-level tokenizer in which a word carries the space before it; otherwise white space and case are dropped."""

    def __init__(self, path: str, spaced: bool, pieces: int = CACHE_PIECES):
        self.pieces, self.spaced = pieces, spaced
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = Tokenizer(self.tokenizer.model)  # the same model without normaliser and splitter, for single words
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level alphabets: these stand for themselves
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        # words are given to the model in one text, kept apart by the line break, which no word holds
        gap = self.letters[0x0A]
        self.merges.pre_tokenizer = Split(gap, "isolated")
        self.gap_id, = self.merges.encode(gap, add_special_tokens=False).ids
        # known pieces by number; the ids of piece k are ids[starts[k]:starts[k] + counts[k]]
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.counts, self.uses = np.empty(0, self.kind), *(np.empty(0, np.int64) for _ in range(3))

    def _word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"\n".join(words) + b"\n"
        if not self.spaced:
            joined = joined.decode().replace(" ", "").lower().encode()
        one, = self.merges.encode_batch_fast([joined.decode("latin-1").translate(self.letters)], add_special_tokens=False)
        ids = np.array(one.ids, dtype=self.kind)
        gaps = ids == self.gap_id
        return ids[~gaps], np.diff(np.flatnonzero(gaps), prepend=-1) - 1

    def _piece_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), self.kind), np.fromiter(map(len, found), np.int64, len(found))

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of the pieces, which are all different.  New ones are encoded; too long ones get the last numbers."""
        known = self.known
        new = [p for p in pieces if p not in known]
        words, rest, long = [], [], []
        for p in new:
            (long if len(p) > LONGEST else words if _WORD.fullmatch(p) else rest).append(p)
        found = [self._word_ids(g) for g in _groups(words)] + [self._piece_ids(g) for g in _groups(rest + long)]
        if found:
            counts = np.concatenate([c for _, c in found])
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, *(i for i, _ in found)])
            self.uses = np.concatenate([self.uses, np.zeros(len(counts), np.int64)])
        for p in chain(words, rest):
            known[p] = len(known)
        once = {p: len(known) + k for k, p in enumerate(long)}
        return np.fromiter((known[p] if p in known else once[p] for p in pieces), np.int64, len(pieces))

    def _join(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these pieces one after the other, and where each begins and the last ends."""
        counts = self.counts[numbers]
        at = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat(self.starts[numbers] - at[:-1], counts)
        places += np.arange(at[-1])
        return self.ids[places], at

    def _forget(self) -> None:
        """Drop the pieces that are too long and, of too many, those used least; older uses count half each time."""
        if len(self.known) > 2 * self.pieces:
            keep = np.sort(np.argpartition(-self.uses[:len(self.known)], self.pieces)[:self.pieces])
            pieces = list(self.known)
            self.known = {pieces[k]: n for n, k in enumerate(keep.tolist())}
            self.ids, at = self._join(keep)
            self.starts, self.counts, self.uses = at[:-1], self.counts[keep], self.uses[keep] // 2
        elif len(self.counts) > len(self.known):
            n = len(self.known)
            self.ids = self.ids[:self.starts[n]]
            self.starts, self.counts, self.uses = self.starts[:n], self.counts[:n], self.uses[:n]

    def encode(self, texts: pa.Array | Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text (null: none), as the tokenizer gives them for the whole text without special tokens."""
        offsets, data = text_buffers(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        lo, rows = 0, len(offsets) - 1
        while lo < rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, side="right")) - 1)
            yield from self._chunk(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            lo = hi

    def _chunk(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        if not len(data):
            yield from (np.empty(0, self.kind) for _ in bounds[1:])
            return
        cut = cuts(data, bounds[1:])
        cut[bounds] = True
        raw = data.tobytes()
        for token in self.added:  # a text that holds one is not cut
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(bounds, at, side="right")) - 1
                cut[bounds[row] + 1:bounds[row + 1]] = False
                at = raw.find(token, int(bounds[row + 1]))
        at = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
        each = pieces.indices.to_numpy()
        numbers = self._learn(pieces.dictionary.to_pylist())
        self.uses[numbers] += np.bincount(each, minlength=len(numbers))
        ids, begins = self._join(numbers[each])
        self._forget()
        ends = begins[np.searchsorted(at, bounds)].tolist()
        yield from (ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


def encoder(path: str, spaced: bool, pieces: int = CACHE_PIECES) -> Encoder:
    """The worker's encoder of a vocabulary file; it lives until the Python worker gets other work.  ``pieces``: see
    ``CACHE_PIECES``."""
    encoders, key = kept("encode"), (path, spaced, pieces)
    if key not in encoders:
        encoders[key] = Encoder(path, spaced, pieces)
    return encoders[key]
