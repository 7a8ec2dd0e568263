"""Ids of whole texts by a tokenizer of the tokenizers library that drops white space, through a dictionary of parts.

Texts of plain characters are cut into the pre-tokenizer's parts by the classes of their bytes; the library's model
encodes each distinct part once. A text's ids are those of its parts, one after the other. The library encodes any
other text as a whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Known, bytes_of, changes, ragged, runs_of

#: Distinct parts that a worker keeps between batches: some 200 bytes each.
KEPT_PARTS = 400_000
#: White space, printable ASCII and Latin-1 letters: one code point is one letter, NFC and lower-casing act on each alone.
PLAIN = r"^[\t\n\v\f\r -~À-ÖØ-öø-ÿ]*$"
#: Fixed value: the pre-tokenizer that _cut restates.
PRE_TOKENIZER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Fixed value: the normalizer that plain characters need no more of than lower case.
NORMALIZER = ["NFC", "Replace", "Lowercase"]

#: Classes of bytes in lower-cased plain text: 0 white space, 1 letters (all of two bytes are), 2 digits, 3 others.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]], KIND[97:123], KIND[128:], KIND[48:58] = 0, 1, 1, 2


#: The byte-level alphabet's spelling of Latin-1 letters: each byte of their UTF-8 as a character, 0x80-0xA0 and 0xAD
#: moved up to 0x100 + k in the order of bytes without a spelling of their own (after 33 below 0x21 and at 0x7F).
_MOVED = [*range(0x21), 0x7F, *range(0x80, 0xA1), 0xAD]
ALPHABET = {c: "".join(chr(0x100 + _MOVED.index(b)) if b in _MOVED else chr(b) for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def _cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The pre-tokenizer's parts of lower-cased plain texts."""
    data, offsets = bytes_of(texts)
    kind = KIND[data]
    start = changes(kind, offsets)
    start |= kind == 2
    # an apostrophe alone, then letters: 's 't 'm 'd 're 've 'll are parts, and what follows is the next one
    at = np.flatnonzero(data == ord("'"))
    at = at[at + 1 < len(data)]
    at = at[start[at] & start[at + 1] & (kind[at + 1] == 1)]
    at = at[~np.isin(at + 1, offsets)]
    if len(at):
        one = data[at + 1]
        goes_on = (at + 2 < len(data)) & ~start[np.minimum(at + 2, len(data) - 1)]
        two = np.where(goes_on, data[np.minimum(at + 2, len(data) - 1)], 0)
        single = np.isin(one, list(b"stmd"))
        double = (np.isin(one, list(b"rv")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for size, some in ((1, at[single]), (2, at[double])):
            start[some + 1] = False
            start[(some + 1 + size)[some + 1 + size < len(data)]] = True
    return runs_of(data, offsets, kind, start)


class WordEncoder:
    """Encodes batches of texts; keeps parts between batches."""

    _loaded: dict[str, "WordEncoder"] = {}

    @classmethod
    def load(cls, path: str) -> "WordEncoder":
        """One for each process and file."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        patterns = [x["pattern"].get("Regex") for x in spec["pre_tokenizer"].get("pretokenizers", []) if x["type"] == "Split"]
        byte_level = any(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in spec["pre_tokenizer"].get("pretokenizers", []))
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.by_parts = bool(suffix) and patterns == [PRE_TOKENIZER] and byte_level and normal == NORMALIZER
        self.tokenizer = Tokenizer.from_file(path)
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.model, self.known = self.tokenizer.model.tokenize, Known(KEPT_PARTS)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _part(self, part: str) -> list[int]:
        """A part that the pre-tokenizer leaves whole, spelt as the byte-level alphabet has it."""
        return [t.id for t in self.model(part if part.isascii() else part.translate(ALPHABET))]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the number of each text."""
        index, forms, offsets = _cut(pc.utf8_lower(texts))
        ids, lengths = self.known.ids(index, forms.to_pylist(), self._part)
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return ids, np.diff(ends[offsets])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the n + 1 offsets of the texts in them."""
        plain = pc.match_substring_regex(texts, PLAIN) if self.by_parts else pa.array([False] * len(texts))
        for t in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, t)))
        is_plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        if is_plain.all():
            ids, n = self._plain(texts)
            return ids, np.concatenate(([0], np.cumsum(n)))
        ids, n = self._plain(texts.filter(plain)) if is_plain.any() else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        other = self._library(texts.filter(pc.invert(plain)).to_pylist())
        lengths = np.zeros(len(texts), np.int64)
        lengths[is_plain], lengths[~is_plain] = n, list(map(len, other))
        ends = np.concatenate(([0], np.cumsum(lengths)))
        out = np.zeros(int(ends[-1]), np.int32)
        out[ragged(ends[:-1][is_plain], n)] = ids
        out[ragged(ends[:-1][~is_plain], lengths[~is_plain])] = np.array([i for x in other for i in x], np.int32)
        return out, ends
