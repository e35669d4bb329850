"""Subword ids of whole texts by a public tokenizer, with a bounded memory of what it has spelled.

The tokenizer drops white space, and no token of it crosses white space, so the ids of a text are
those of its words in turn.  A word of Latin letters and marks after them is spelled in two parts.  Parts are told apart by their bytes
within a block of texts, and each process remembers the ids of at least the last ``MEMORY`` different ones.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from .textbuf import LOWER, blocks, distinct, ragged, words

MEMORY = 250_000
BLOCK_BYTES = 1 << 22
#: Fixed value: the pattern by which the vocabulary file splits words.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: What may stand after a word of letters without changing how the word is split.
MARKS, MOST_MARKS = b".,;:!?%#*&$|", 8
_MARK = np.isin(np.arange(256), list(MARKS))
#: Bytes of letters A-Z, a-z and U+00C0 to U+023F; of these, multiplication and division signs are no letters, and a dotted I ends with a mark.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = True
_NOT_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def shared_encoder(path: str | None = None) -> Encoder:
    """The encoder of this worker process: what it knows outlasts a task."""
    return Encoder(path)


def _parts(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with plain words in lower case; where each word's marks begin (its end, if it isn't plain); which words are plain."""
    cut, left = end.copy(), np.arange(len(end))
    for _ in range(MOST_MARKS + 1):  # a word with more marks isn't plain: one is left that is no letter
        left = left[(cut[left] > start[left]) & _MARK[raw[cut[left] - 1]]]
        cut[left] -= 1
    wrong = ~_LETTER[raw]
    at = np.flatnonzero((raw[:-1] == 0xC3) | (raw[:-1] == 0xC4))
    for a, b in _NOT_LETTERS:
        wrong[at[(raw[at] == a) & (raw[at + 1] == b)]] = True
    total = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(wrong, out=total[1:])
    plain = total[cut] == total[start]
    cut = np.where(plain, cut, end)
    low = LOWER[raw]
    odd = np.flatnonzero(~plain)
    at = ragged(start[odd], (end - start)[odd])
    low[at] = raw[at]
    return low, cut, plain


class Encoder:
    """Ids of words and texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str | None = None, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        self.memory = memory
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        return [ids[a:b].tobytes() for _, ids, off in self.column(pa.array(texts, pa.binary())) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]

    def column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each block of a binary column: its first row, the ids of its texts in a row, where each text's begin (and the end)."""
        for at, raw, off in blocks(texts, BLOCK_BYTES):
            start, end, first = words(raw, off)
            low, cut, plain = _parts(raw, start, end)
            # one or two parts for each word; what is told apart is the part and whether it is plain
            parts = np.stack([start, cut, cut, end], axis=1).reshape(-1, 2)
            real = parts[:, 0] < parts[:, 1]
            parts, kind = parts[real], np.repeat(plain, 2)[real]
            one, number, _ = distinct(low, parts[:, 0].copy(), parts[:, 1].copy(), kind)
            data = low.tobytes()
            spelled = self._spell([data[a:b] for a, b in parts[one].tolist()], kind[one].tolist())
            many = np.fromiter(map(len, spelled), np.int64, len(spelled)) // 4
            times = many[number]
            ids = np.frombuffer(b"".join(spelled), "<u4")[ragged((np.cumsum(many) - many)[number], times)]
            before = np.concatenate([[0], np.cumsum(real)])[2 * first]  # parts before each text
            yield at, ids, np.concatenate([[0], np.cumsum(times)])[before]

    def _spell(self, parts: list[bytes], plain: list[bool]) -> list[bytes]:
        """The ids of each part; plain ones are one run of letters or marks."""
        if len(self.known) > self.memory:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new: list[bytes] = []
        many: list[int] = []
        for w, one in zip(parts, plain, strict=True):
            if w not in known:
                if (ids := older.get(w)) is not None:
                    known[w] = ids
                else:
                    new.append(w)
                    many.append(1 if one else -1)
        texts = [w.decode("utf-8", "replace") for w in new]
        runs = [n if n > 0 else len(PIECES.findall(unicodedata.normalize("NFC", t).lower())) for n, t in zip(many, texts, strict=True)]
        known.update(zip(new, self._encode(texts, runs), strict=True))
        return [known[w] for w in parts]

    def _encode(self, texts: list[str], pieces: list[int], at_once: int = 256) -> list[bytes]:
        """Ids of texts without spaces, many to a call; ``pieces``: how many runs the tokenizer splits each into."""
        out: list[bytes] = []
        for at in range(0, len(texts), at_once):
            part, many = texts[at : at + at_once], np.array(pieces[at : at + at_once])
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids])  # every run ends with a token of its own kind
            if len(ends) == many.sum() and many.all() and len(ids) == ends[-1] + 1:
                cuts = [0, *(4 * (ends[np.cumsum(many) - 1] + 1)).tolist()]
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            else:  # special tokens or odd characters: one by one
                out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out
