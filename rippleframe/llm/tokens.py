"""Token ids of whole texts with the tokenizers library, encoded once per distinct piece of text.

A byte-level BPE never merges across a single ASCII space that stands between two characters which are not white
space, so a text is cut there and each distinct piece is encoded once and remembered. Pieces of letters with
punctuation behind them are cut once more, where the pre-tokenizer's pattern cuts as well. Texts that hold the content
of an added token are encoded whole. The ids equal those of encoding the whole text; the tests compare both.
"""

from __future__ import annotations

import os
import re
from array import array
from string import punctuation

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in same}, 256
    for b in range(256):
        if b not in out:
            out[b], n = chr(n), n + 1
    return out


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids; remembers about limit pieces and drops all when full."""

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters, self.limit = self.tokenizer.model, _byte_letters(), limit
        #: ids of pieces that have a space before them (keys without it), and of others.
        self.after: dict[str, bytes | None] = {}
        self.start: dict[str, bytes] = {}

    def _whole(self, s: str) -> bytes:
        return array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes()

    def _has_added(self, text: str) -> bool:
        return any(a in text for a in self.added)

    def _room(self, limit: int) -> None:
        if len(self.after) + len(self.start) > limit:
            self.after.clear()
            self.start.clear()

    def _learn(self, pieces: set[str], known: dict[str, bytes | None], space: str) -> None:
        """Fill known for pieces (without their space)."""
        tokenize, byte_space = self.model.tokenize, "\u0120" if space else ""

        def letters(s: str) -> bytes:
            mapped = s if s.isascii() else s.encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in tokenize(byte_space + mapped)]).tobytes()

        for p in pieces:
            if p.isalpha():
                known[p] = letters(p)
                continue
            stem = p.rstrip(punctuation)
            if stem.isalpha():
                if stem not in known:
                    known[stem] = letters(stem)
                known[p] = known[stem] + self._start(p[len(stem) :])
                continue
            if not p or p[0].isspace() or p[-1].isspace():
                known[p] = None if space else self._whole(p)
                continue
            head, line, rest = p.partition("\n")
            if line and not head[-1].isspace() and not rest[0].isspace():
                if head not in known:
                    self._learn({head}, known, space)
                known[p] = known[head] + self._start("\n") + self._start(rest)
            else:
                known[p] = self._whole(space + p)

    def _start(self, s: str) -> bytes:
        if s not in self.start:
            self._learn({s}, self.start, "")
        return self.start[s]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        self._room(self.limit)
        after, out = self.after, []
        get = after.get
        for text in texts:
            parts = text.split(" ")
            head = parts.pop(0)
            if not head or head[-1].isspace() or self._has_added(text):
                out.append(self._pieces(text))
                continue
            held = list(map(get, parts))
            new = [i for i, ids in enumerate(held) if ids is None]
            if new:
                self._learn({parts[i] for i in new}.difference(after), after, " ")
                for i in new:
                    held[i] = after[parts[i]]
            try:
                out.append(self._start(head) + b"".join(held))
            except TypeError:  # a space beside other white space
                out.append(self._pieces(text))
        return out

    def _pieces(self, text: str) -> bytes:
        """For texts with runs of white space: cut only where no white space is beside the space."""
        if not text:
            return b""
        if self._has_added(text):
            return self._whole(text)
        first, *rest = _CUT.split(text)
        self._learn(set(rest).difference(self.after), self.after, " ")
        return (self._whole(first) if first[0].isspace() or first[-1].isspace() else self._start(first)) + b"".join([self.after[p] or self._whole(" " + p) for p in rest])

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def forget() -> None:
    """Free this process's memory of pieces, for work that encodes no more."""
    for e in (*_ENCODERS.values(), *_OFFSETS.values()):
        e._room(0)


def encoder(path: str) -> Encoder:
    """One per process and vocabulary, so that its memory lasts over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class OffsetEncoder(Encoder):
    """Character spans of tokens; a remembered piece is its tokens' (begin, end) pairs in characters."""

    def __init__(self, path: str, limit: int = 600_000):
        super().__init__(path, limit)
        self.stems: dict[str, bytes] = {}

    def _span_bytes(self, s: str, encoding) -> bytes:
        return array("I", [x for pair in encoding.offsets for x in pair]).tobytes()

    def _whole(self, s: str) -> bytes:
        return self._span_bytes(s, self.tokenizer.encode(s, add_special_tokens=False))

    def _letters(self, stems: list[str], space: str) -> None:
        for s in stems:
            plain = (" " if space else "") + s
            if plain.isascii():  # bytes are characters
                wide = len(space)  # the byte letter of a space takes two bytes, so later offsets are one too high
                self.stems[space + s] = array("I", [max(x - wide, 0) for t in self.model.tokenize(space + s) for x in t.offsets]).tobytes()
            else:
                self.stems[space + s] = self._whole(plain)

    def _learn(self, pieces: set[str], known: dict[str, bytes | None], space: str) -> None:
        letters = {p for p in pieces if p.isalpha()}
        byte_space = "Ġ" if space else ""
        self._letters([p for p in letters if byte_space + p not in self.stems], byte_space)
        for p in letters:
            known[p] = self.stems[byte_space + p]
        for p in pieces - letters:
            bare = not p or p[0].isspace() or p[-1].isspace()
            known[p] = (None if space else self._whole(p)) if bare else self._whole(space + p)

    def spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Begin and end of every token of each text."""
        out = []
        after = self.after
        if len(after) + len(self.start) + len(self.stems) > self.limit:
            self.stems.clear()
            self._room(0)
        cut = [([t] if self._has_added(t) else _CUT.split(t)) if t else [] for t in texts]
        self._learn(set().union(*(p[1:] for p in cut)).difference(after), after, " ")
        for pieces in cut:
            if not pieces:
                out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            first = pieces[0]
            held = [self._whole(first) if first[0].isspace() or first[-1].isspace() or self._has_added(first) else self._start(first)]
            held += [after[p] or self._whole(" " + p) for p in pieces[1:]]
            pairs = np.frombuffer(b"".join(held), "<u4").astype(np.int64).reshape(-1, 2)
            counts = np.fromiter((len(h) >> 3 for h in held), np.int64, len(held))
            sizes = np.fromiter((len(p) + 1 for p in pieces), np.int64, len(pieces))
            sizes[0] -= 1
            base = np.repeat(np.cumsum(sizes) - sizes, counts)
            out.append((pairs[:, 0] + base, pairs[:, 1] + base))
        return out


_OFFSETS: dict[str, OffsetEncoder] = {}


def offset_encoder(path: str) -> OffsetEncoder:
    if path not in _OFFSETS:
        _OFFSETS[path] = OffsetEncoder(path)
    return _OFFSETS[path]
