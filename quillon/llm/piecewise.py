"""SentencePiece encoding by best scores of pieces, and decoding.

An Aho-Corasick automaton over the pieces goes through a text once; at each character its output links name all pieces
that end there, which relax the best score up to it. The model's normalizer must be the identity that adds a space in
front and writes spaces as U+2581; characters that are no piece become their bytes' pieces.
"""

from __future__ import annotations

import hashlib
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Known, arrow_map, bytes_of, ragged, runs_of, texts_of

SPACE = "▁"
#: Segments that a worker keeps between batches.
KEPT_SEGMENTS = 700_000
#: What a character that is no piece scores below the lowest piece.
UNKNOWN = 10.0


class PieceCodec:
    """A model's pieces as an automaton."""

    _loaded: dict[str, "PieceCodec"] = {}

    @classmethod
    def load(cls, path: str) -> "PieceCodec":
        """One for each process and file."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize("  a ﬁ\n") != f"{SPACE * 3}a{SPACE}ﬁ\n":
            raise ValueError(f"{path}: its normalizer is not the identity with a space in front")
        n = model.vocab_size()
        self.automaton, self.pieces, self.bytes, chars = ahocorasick.Automaton(), [b""] * n, [0] * 256, set()
        scores = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.pieces[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.pieces[i] = piece.replace(SPACE, " ").encode()
                self.automaton.add_word(piece, (len(piece), model.get_score(i), i))
                scores.append(model.get_score(i))
                chars.update(piece)
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"{path}: a piece goes on after a space")
        self.automaton.make_automaton()
        self.singles = {c for c in chars if c in self.automaton}
        self.unknown = min(scores) - UNKNOWN
        #: No path crosses a newline if no piece has one.
        self.kind = np.ones(256, np.uint8)
        self.kind[ord(" ")] = 2
        if "\n" not in chars:
            self.kind[ord("\n")] = 3
        self.lengths = np.fromiter(map(len, self.pieces), np.int64, n)
        self.starts, self.flat = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(self.pieces), np.uint8)
        self.known = Known(KEPT_SEGMENTS)

    def best(self, text: str) -> list[int]:
        """Ids of the best path through text (spaces as U+2581); of equal paths the one with the longer last piece."""
        n, singles, unknown, lowest = len(text), self.singles, self.unknown, float("-inf")
        score, back, piece = [lowest] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0], done = 0.0, 0
        for end, (size, value, i) in self.automaton.iter(text):
            at = end + 1
            while done < at:  # characters up to here that are no piece go alone, unless a longer piece is better
                if text[done] not in singles:
                    score[done + 1], back[done + 1] = score[done] + unknown, done
                done += 1
            if (s := score[at - size] + value) > score[at]:  # the longest piece comes first
                score[at], back[at], piece[at] = s, at - size, i
        while done < n:
            if text[done] not in singles:
                score[done + 1], back[done + 1] = score[done] + unknown, done
            done += 1
        out, at = [], n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out.extend(self.bytes[b] for b in reversed(text[at - 1].encode()))
            at = back[at]
        out.reverse()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the n + 1 offsets of the texts in them.

        Segments begin at a space after another character and around newlines; no piece goes on there, so the best
        path of a text is that of its segments. Segments are kept between batches.
        """
        texts = pc.replace_substring(texts, SPACE, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        data, offsets = bytes_of(texts)
        kind = self.kind[data]
        start = np.zeros(len(data), bool)
        start[1:] = ((kind[1:] != kind[:-1]) & (kind[1:] != 1)) | (kind[:-1] == 3) | (kind[1:] == 3)
        start[offsets[:-1][offsets[:-1] < len(data)]] = True
        index, forms, first = runs_of(data, offsets, kind, start)
        ids, lengths = self.known.ids(index, forms.to_pylist(), lambda w: self.best(w.replace(" ", SPACE)))
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return ids, ends[first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 of each text."""
        size = self.lengths[ids]
        data = self.flat[ragged(self.starts[ids], size)].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[offsets].tolist()
        return [data[a + 1 : b] if data[a : a + 1] == b" " else data[a:b] for a, b in zip(ends, ends[1:])]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>) for each row of docs(doc_id, text); null and empty texts have no ids."""

    def each(batch):
        ids, offsets = PieceCodec.load(model).encode(texts_of(batch, "text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); bytes that are no UTF-8 become U+FFFD, control pieces are left out."""

    def run(batches):
        codec = PieceCodec.load(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                some = batch.slice(k, 1000)
                ids = pc.fill_null(some.column("ids"), [])
                n = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
                texts = codec.decode(ids.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(n))))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([t.decode(errors="replace") for t in texts], pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text_sha256, same) of docs(doc_id, text), each text encoded and decoded again.

    ids_crc32 is that of the ids as little-endian unsigned 32-bit numbers, text_sha256 that of the decoded text, same
    whether it is the text (U+2581 and a space count as one, since the model writes one as the other). Null texts are
    empty: no ids. Repeated rows and rows without a doc_id stay; further columns are left out.
    """

    def each(batch):
        codec, texts = PieceCodec.load(model), texts_of(batch, "text")
        ids, offsets = codec.encode(texts)
        decoded = codec.decode(ids, offsets)
        raw, ends = memoryview(ids.astype("<u4").tobytes()), offsets.tolist()
        plain = pc.replace_substring(texts, SPACE, " ").cast(pa.large_binary())
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").cast(pa.int64()), "n_ids": np.diff(offsets), "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])], pa.int64()),
            "text_sha256": [hashlib.sha256(t).hexdigest() for t in decoded], "same": pc.equal(plain, pa.array(decoded, pa.large_binary())),
        })

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, n_ids long, ids_crc32 long, text_sha256 string, same boolean")
