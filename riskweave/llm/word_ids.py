"""Ids of whole texts by a tokenizers vocabulary file, each distinct word encoded once a worker.

The vocabulary's pipeline drops white space, and none of its steps looks across it, so the
ids of a text are those of its words in a row.  Words of plain letters go straight to the
merge model; everything else goes through the library's whole pipeline.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from riskweave.llm.common import Memo

# ASCII and the composed letters of Latin-1: nothing to compose, and lower case letter by letter
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# the vocabulary's split over that alphabet
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
# byte-level alphabet: printable bytes stand for themselves, the others for 256 and above
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER = dict(zip(_SELF, map(chr, _SELF))) | dict(zip((b for b in range(256) if b not in set(_SELF)), map(chr, range(256, 512))))
LETTERS = [_LETTER[b] for b in range(256)]


class WordIds:
    """Encodes texts; ids are kept as little-endian unsigned integers of `width` bytes."""

    def __init__(self, path: str, memo: int = 600_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.code = np.dtype(f"<u{self.width}"), "H" if self.width == 2 else "I"
        self.tokenize = self.tokenizer.model.tokenize
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        parts = json.dumps([steps["normalizer"], steps["pre_tokenizer"]])
        # the shortcut stands on these steps; another vocabulary goes the whole way
        self.short = all(s in parts for s in ("NFC", "Lowercase", "[\\\\p{L}]+", '"ByteLevel"', '"add_prefix_space": false'))
        self.words: dict[str, bytes] = {}
        self.memo = Memo(self._chunks, memo)

    def _model(self, piece: str) -> bytes:
        found = self.words.get(piece)
        if found is None:
            if len(self.words) >= 300_000:
                self.words.clear()
            letters = "".join(map(LETTERS.__getitem__, piece.encode()))
            found = self.words[piece] = array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()
        return found

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        out, rest = [], []
        for i, chunk in enumerate(chunks):
            word = chunk.decode("utf-8", "replace")
            if self.short and PLAIN.fullmatch(word):
                out.append(b"".join(map(self._model, SPLIT.findall(word.lower()))))
            else:
                out.append(b"")
                rest.append((i, word))
        whole = self.tokenizer.encode_batch([w for _, w in rest], add_special_tokens=False)
        for (i, _), e in zip(rest, whole):
            out[i] = np.array(e.ids, self.kind).tobytes()
        return out

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, cut at the six white-space characters of ASCII."""
        return [np.frombuffer(b, self.kind) for b in self.memo.join([t.encode("utf-8", "replace").split() for t in texts])]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
