"""Cutting a text at places where byte-level pre-tokenization always starts anew, so that pieces can be encoded apart.

A white-space character after a non-white one always starts a new pre-token, whatever follows. Texts cut there give
pieces that repeat a great deal; each is encoded once per worker process and looked up afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Where one piece can depend on the next: three white-space characters in a row, or two at the end of a text.
_TANGLED = re.compile(r"\s\s\s|\s\s\Z")
#: What the usual text has not: two white-space characters in a row, and characters that may be more of them.
_UNUSUAL = r"[ \n][ \n]|[^ \n!-~\x{A1}-\x{AC}\x{AE}-\x{24F}]"
#: What a kept piece takes besides its own characters and ids: two objects and a place in the table.
_OVERHEAD = 180
#: Marks a piece that has no white space before it: a text's first one, and those of cut-off marks. No other piece has more than one line feed.
_FIRST = "\n\n"
#: A letter or digit and a mark (but for the apostrophe, which contractions start with): the two are always of different pre-tokens.
_MARK = r"([A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([!-&(-/:-@\[-`{-~])"


def _tangled(text: str) -> bool:
    return bool(_TANGLED.search(text))


def _as_in_text(pieces: pa.Array) -> pa.Array:
    none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    spaced = pc.if_else(pc.starts_with(pieces, "\n"), pieces, pc.binary_join_element_wise(none, pieces, space))
    return pc.if_else(pc.starts_with(pieces, _FIRST), pc.utf8_slice_codeunits(pieces, len(_FIRST)), spaced)


class PieceTable(dict):
    """Maps a piece to the bytes of its ids (little-endian unsigned 32-bit).

    ``encode_batch`` gives the ids of many texts, whole or pieces; ``tangled`` tells the texts that can't be cut. The table keeps pieces of at most 64 characters while they
    take ``limit_bytes`` or less in all; whatever is over that is encoded each time, so memory is bounded (for each
    worker process, outside the JVM's heap) and results never depend on what is kept. With ``marks`` words and the marks after them
    are pieces of their own, which holds where pre-tokens never mix letters or digits with marks, and leaves fewer distinct pieces.
    With ``arrow`` the encoder is given an Arrow array instead of a list.
    """

    def __init__(self, encode_batch: Callable[[Any], list[bytes]], special: tuple[str, ...] = (), limit_bytes: int = 96 << 20, tangled: Callable[[str], bool] | None = None, marks: bool = False, arrow: bool = False) -> None:
        super().__init__()
        self._encode_batch, self._special, self._room, self._tangled, self._marks, self._arrow = encode_batch, special, limit_bytes, tangled, marks, arrow

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each of the whole texts. Arrow cuts them and numbers their distinct pieces, so only those are looked up."""
        out = [b""] * len(texts)
        whole: list[int] = []
        cut: list[int] = []
        given_texts = pa.array(texts, pa.large_string())
        unusual = pc.match_substring_regex(given_texts, _UNUSUAL).to_numpy(zero_copy_only=False).tolist()
        for k, text in enumerate(texts):
            if (self._tangled(text) if self._tangled else unusual[k] and _tangled(text)) or (self._special and any(s in text for s in self._special)):
                whole.append(k)
            elif text:
                cut.append(k)
        none, first = pa.scalar("", pa.large_string()), pa.scalar(_FIRST, pa.large_string())
        parted = pc.binary_join_element_wise(first, pc.replace_substring(given_texts.take(pa.array(cut, pa.int64())), "\n", " \n"), none)
        if self._marks:
            parted = pc.replace_substring_regex(parted, _MARK, rf"\1 {_FIRST}\2")
        pieces = pc.split_pattern(parted, " ")
        numbered = pieces.values.dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = [*map(self.get, distinct)]
        fresh = [k for k, ids in enumerate(own) if ids is None]
        new = pa.concat_arrays([_as_in_text(numbered.dictionary.take(pa.array(fresh, pa.int64()))), pa.array([texts[k] for k in whole], pa.large_string())])
        given = self._encode_batch(new if self._arrow else new.to_numpy(zero_copy_only=False).tolist()) if len(new) else []
        for k, ids in zip(fresh, given, strict=False):
            own[k], piece = ids, distinct[k]
            size = _OVERHEAD + len(piece) + len(ids)
            if len(piece) <= 64 and size <= self._room:
                self[piece] = ids
                self._room -= size
        for k, ids in zip(whole, given[len(fresh) :], strict=True):
            out[k] = ids
        if cut:
            sizes = np.fromiter(map(len, own), np.int64, len(own)) >> 2
            starts = np.cumsum(sizes) - sizes
            which = numbered.indices.to_numpy()
            sizes = sizes[which]
            ends = np.cumsum(sizes)
            places = np.repeat(starts[which] - ends + sizes, sizes)
            places += np.arange(len(places))
            ids = np.frombuffer(b"".join(own), "<u4")[places]
            stops = ends[pieces.offsets.to_numpy()[1:] - 1].tolist()
            for k, start, stop in zip(cut, [0, *stops], stops, strict=False):
                out[k] = ids[start:stop].tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """The ids of one whole text."""
        return self.encode_many([text])[0]
