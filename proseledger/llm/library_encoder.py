"""The tokenizers library behind a table of pieces, one for each tokenizer file and worker process."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .bpe import byte_letters, check_byte_level
from .pieces import PieceTable
from .shared import held

#: A space or none and letters (Latin ones, which every version of Unicode has as such): a pre-token as it stands, whatever white space or mark follows.
_LETTERS = r"^ ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+$"
#: One white-space character and a word, without any other white space or separator.
_WORD = r"^[ \n][^\s\pZ\x{0B}\x{1C}-\x{1F}\x{85}]+$"


class LibraryEncoder:
    """Ids as the library gives them for the whole text, and the number of bytes that each id stands for.

    Texts are cut where pre-tokenization starts anew whatever stands before, and the library encodes each distinct piece
    once: pieces of letters by its model alone, since they are pre-tokens already (its pre-tokenizer takes half of the time),
    others with its pre-tokenizer. Texts for which that rule doesn't hold go to it whole. Encoding all
    texts whole takes the library two to three times as long, since it cuts and looks up each word anew. With
    ``plain_specials`` the strings of special tokens are text like any other.
    """

    def __init__(self, path: str, plain_specials: bool = False, limit_bytes: int = 96 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each worker has one core; the library's threads would only wait on each other
        with open(path, encoding="utf-8") as f:
            check_byte_level(json.load(f), path)
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._tokenizer.encode_special_tokens = plain_specials
        added = {i: t.content for i, t in self._tokenizer.get_added_tokens_decoder().items()}
        self._model = self._tokenizer.model
        # an added token that may stand inside a word is found by the tokenizer, not by its model
        self._by_model = not any(re.fullmatch(r"[\w\s]*", t) for t in added.values())
        self.table = PieceTable(self._batch, () if plain_specials else tuple(added.values()), limit_bytes, marks=True, arrow=True)
        letters = byte_letters()
        self._letter_of = np.zeros(256, "<u4")
        self._letter_of[[*letters.values()]] = [ord(c) for c in letters]
        self.n_bytes = np.zeros(1 + max([*self._tokenizer.get_vocab().values()]), np.int64)
        for token, i in self._tokenizer.get_vocab().items():
            self.n_bytes[i] = len(token) if i not in added and all(c in letters for c in token) else len(token.encode())

    def _batch(self, given: pa.Array) -> list[bytes]:
        """The ids of each of texts. Other pieces than letters, if of one white-space character and a word, are encoded as one text, which is cut by its ids' bytes."""
        is_word = pc.match_substring_regex(given, _WORD).to_numpy(zero_copy_only=False)
        out = [b""] * len(given)
        if self._by_model:
            letters = pc.match_substring_regex(given, _LETTERS)
            is_letters = letters.to_numpy(zero_copy_only=False)
            # bytes as the model's letters; a line feed, which no piece of letters has, parts them
            joined = self._letter_of[np.frombuffer("\n".join(given.filter(letters).to_numpy(zero_copy_only=False)).encode(), np.uint8)].tobytes().decode("utf-32-le")
            for k, piece in zip(np.flatnonzero(is_letters).tolist(), joined.split(chr(self._letter_of[10])), strict=False):
                out[k] = array("I", [token.id for token in self._model.tokenize(piece)]).tobytes()
        else:
            is_letters = np.zeros(len(given), bool)
        n_bytes = pc.binary_length(given).to_numpy()
        words, rest = np.flatnonzero(is_word & ~is_letters), np.flatnonzero(~is_word & ~is_letters)
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids = np.array(self._tokenizer.encode_batch_fast(["".join(given.take(pa.array(part)).to_pylist())], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(n_bytes[part]), "right") * 4
            blob, start = ids.tobytes(), 0
            for k, cut in zip(part.tolist(), cuts.tolist(), strict=True):
                out[k] = blob[start:cut]
                start = cut
        for k, found in zip(rest.tolist(), self._tokenizer.encode_batch_fast(given.take(pa.array(rest)).to_pylist(), add_special_tokens=False), strict=True):
            out[k] = array("I", found.ids).tobytes()
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.table.encode(text), "<u4")

    def encode_many(self, texts: list[str], at_once: int = 4 << 20) -> list[np.ndarray]:
        """The ids of each of the texts, of about ``at_once`` characters at a time."""
        out: list[np.ndarray] = []
        first = size = 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= at_once or k == len(texts) - 1:
                out.extend(np.frombuffer(ids, "<u4") for ids in self.table.encode_many(texts[first : k + 1]))
                first, size = k + 1, 0
        return out


def library_encoder(path: str) -> LibraryEncoder:
    """The encoder of a file; it outlives a task in its worker process."""
    return held(("library", path), lambda: LibraryEncoder(path))
