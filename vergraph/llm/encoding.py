"""Token ids of many texts from a public tokenizer file, by word.

The tokenizer drops white space and never joins across it, nor across the
border of a letter and most punctuation, so a text's ids are the ids of its
words and punctuation runs, one after another.  A task encodes each different
piece of its texts once, told apart by its bytes as they are, and lays the ids
out with array operations.  Pieces of Latin letters only, which are nearly all
of them, need no further splitting and go straight to the tokenizer's merge
model; all others take its full path.

Whether a tokenizer file allows this is tried on probes when it is loaded: if
letters do not come out the same both ways, all pieces take the full path; if a
text is not the sum of its pieces, or a cut would fall inside an added token,
whole texts do.
"""

from __future__ import annotations

import os

import numpy as np

from .kernels import NOT_SPACE, U64, Words, byte_class, ragged

VOCABULARY = "word_bpe_49k.json"
#: Pieces remembered by a task before it starts to remember anew.
REMEMBER = 1_500_000
_ASCII_LETTER = byte_class(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
#: Second bytes, after 0xC3, of the letters U+00C0 to U+00FF (not of the two signs there).
_LATIN_TAIL = byte_class(lambda b: 0x80 <= b <= 0xBF and b not in (0x97, 0xB7))
#: Punctuation that may be cut from letters: not the apostrophe, which starts
#: contractions, nor the characters of special tokens.
_PUNCTUATION = byte_class(lambda b: chr(b) in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~")


def _byte_symbols() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 as itself and the other
    bytes, in order, as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SYMBOLS = _byte_symbols()


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of the two-byte letters of Latin-1."""
    out = _ASCII_LETTER[data]
    if len(data) > 1:
        lead = np.flatnonzero((data[:-1] == 0xC3) & _LATIN_TAIL[data[1:]])
        out[lead] = True
        out[lead + 1] = True
    return out


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        #: Ids are below this.
        self.size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.letters_alone = self.pieces = True
        self._forget()
        self._probe()

    def _forget(self):
        self.keys = np.zeros(0, U64)
        self.slot = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.off = np.zeros(1 << 14, np.int64)
        self.known = 0

    def _full(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _probe(self) -> None:
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        for text in added:
            data = np.frombuffer(text.encode(), np.uint8)
            if len(data) and (len(Words(data, np.array([0, len(data)]), NOT_SPACE, self._cuts(data), fold=False).hash) != 1 or not NOT_SPACE[data].all() or letters(data).all()):
                self.pieces = False
        rng = np.random.default_rng(5)
        alphabet = [*map(chr, range(65, 91)), *map(chr, range(97, 123)), *(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]
        words = ["".join(alphabet[i] for i in rng.integers(0, len(alphabet), n)) for n in rng.integers(1, 14, 200)] + ["The", "walking", "WORLD", "Straße", "été", "Ñandú", "ÀÿÞ"]
        try:
            self.letters_alone = [self._alone(w.encode()) for w in words] == self._full(words)
        except (KeyError, ValueError, TypeError):
            self.letters_alone = False
        marks = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~'<>|0123456789\n\t  中文°"
        texts = ["".join(words[rng.integers(len(words))] if rng.random() < 0.5 else marks[rng.integers(len(marks))] for _ in range(30)) for _ in range(40)]
        raw = [t.encode() for t in texts]
        ids, counts = self.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
        parts = [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
        self.pieces = self.pieces and parts == self._full(texts)
        self._forget()

    def _alone(self, piece: bytes) -> list[int]:
        """Ids of a piece of letters, straight from the merge model."""
        if piece.isascii():
            text = piece.decode("ascii").lower()
        else:
            text = piece.decode().lower().encode().decode("latin-1").translate(_SYMBOLS)
        return [t.id for t in self.merge(text)]

    @staticmethod
    def _cuts(data: np.ndarray) -> np.ndarray:
        """Borders of letters and punctuation."""
        letter, mark = letters(data), _PUNCTUATION[data]
        split = np.zeros(len(data), bool)
        split[1:] = letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
        return split

    def _learn(self, raw: bytes, hashes: np.ndarray, start: list[int], end: list[int], plain: list[bool]) -> None:
        ids: list[list[int]] = []
        whole: list[str] = []
        place: list[int] = []
        for i, (a, b, simple) in enumerate(zip(start, end, plain, strict=True)):
            piece = raw[a:b]
            if simple and self.letters_alone:
                ids.append(self._alone(piece))
            else:
                whole.append(piece.decode("utf-8", "replace"))
                place.append(i)
                ids.append([])
        if whole:
            for i, own in zip(place, self._full(whole), strict=True):
                ids[i] = own
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.array([x for i in ids for x in i], np.uint32)
        used, n = int(self.off[self.known]), len(ids)
        if used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(flat)), np.uint32)])
        if self.known + n + 1 > len(self.off):
            self.off = np.concatenate([self.off, np.zeros(max(len(self.off), n + 1), np.int64)])
        self.flat[used : used + len(flat)] = flat
        self.off[self.known + 1 : self.known + n + 1] = used + np.cumsum(counts)
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.slot = np.insert(self.slot, at, self.known + np.arange(n))
        self.known += n

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows of a slice, and how many each row has."""
        n_rows = len(off) - 1
        if not self.pieces:
            own = self._full([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            return np.array([x for i in own for x in i], np.uint32), np.fromiter(map(len, own), np.int64, n_rows)
        letter = letters(data)
        words = Words(data, off, NOT_SPACE, self._cuts(data), fold=False)
        if len(words.hash) == 0:
            return np.zeros(0, np.uint32), np.zeros(n_rows, np.int64)
        unique, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if self.known + len(unique) > REMEMBER and self.known:
            self._forget()
        place = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != unique[inside]
        if new.any():
            at = at[new]
            start, end = words.start[at], words.end[at]
            sums = np.zeros(len(data) + 1, np.int32)
            np.cumsum(letter, out=sums[1:])
            plain = sums[end] - sums[start] == end - start
            self._learn(data.tobytes(), unique[new], start.tolist(), end.tolist(), plain.tolist())
            place = np.searchsorted(self.keys, unique)
        slot = self.slot[place]
        first, many = self.off[slot], self.off[slot + 1] - self.off[slot]
        counts = many[back]
        ids = self.flat[ragged(first[back], counts)]
        sums = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=sums[1:])
        return ids, sums[words.first[1:]] - sums[words.first[:-1]]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def id_width(path: str, width: int | None = None) -> int:
    """Bytes that an id of this tokenizer takes, 2 or 4; raises if ``width`` is too small."""
    least = 2 if encoder(path).size <= 1 << 16 else 4
    if width is not None and width < least:
        raise ValueError(f"ids of {path} need {least} bytes")
    return width or least


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after each row."""
    total = counts + 1
    ends = np.cumsum(total) - 1
    out = np.empty(int(total.sum()), np.uint32)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[ends] = end_id
    out[mask] = ids
    return out, total
