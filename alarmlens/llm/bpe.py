"""Byte-level BPE encoding and decoding with forced-boundary splitting.

Two adjacent bytes that stand side by side in no token of the vocabulary can never end up in one
token, so the text is certainly cut between them. Fragments between such cuts are encoded on their
own, by merging the pair of lowest rank until none is left, and the ids are put together in order.
Pieces of the vocabulary's own splitting pattern bound the fragments first, because the pattern looks
at neighbouring characters and so has to see the whole text.

Words repeat, so each Python worker keeps the ids of pieces it has met lately, up to a fixed number.
"""
from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from alarmlens.llm.tables import id_and_text, in_slices

# The splitting pattern that belongs to the byte-level vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

REMEMBERED = 200_000  # pieces of one generation; a worker keeps two
LONG_PIECE = 64
_ID_BITS = 20
_ID_MASK = (1 << _ID_BITS) - 1
_NEVER = 1 << 62


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in the vocabulary file: Latin-1's visible characters stand
    for themselves, the others follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        symbols = byte_symbols()
        vocab = data["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(symbols[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.decimal_of = {i: str(i).encode() for i in self.bytes_of}
        self.byte_id = [0] * 256
        for i, raw in self.bytes_of.items():
            if len(raw) == 1:
                self.byte_id[raw[0]] = i
        self.merges: dict[int, int] = {}  # pair of ids -> rank and id of what they become, in one number
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left] << _ID_BITS | vocab[right]] = rank << _ID_BITS | vocab[left + right]
        self.joined = bytearray(1 << 16)  # 1 for byte pairs that some token holds
        for token in vocab:
            raw = bytes(symbols[c] for c in token)
            for a, b in zip(raw, raw[1:]):
                self.joined[a << 8 | b] = 1
        # Rank and result of two bytes side by side; -1 where a cut is certain.
        self.byte_pairs = [
            self.merges.get(self.byte_id[at >> 8] << _ID_BITS | self.byte_id[at & 255], _NEVER) if self.joined[at] else -1
            for at in range(1 << 16)
        ]
        self.pattern = regex.compile(PIECES)
        ordered = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("|".join(map(regex.escape, ordered))) if ordered else None
        self.pieces: dict[str, tuple[int, bytes, bytes]] = {}
        self.older: dict[str, tuple[int, bytes, bytes]] = {}

    def fragments(self, raw: bytes) -> list[bytes]:
        """``raw`` cut at every byte pair that no token holds."""
        if len(raw) > LONG_PIECE:
            codes = np.frombuffer(raw, np.uint8).astype(np.uint16)
            joined = np.frombuffer(self.joined, np.uint8)
            cuts = (np.flatnonzero(joined[codes[:-1] << 8 | codes[1:]] == 0) + 1).tolist()
        else:
            joined = self.joined
            cuts = [i for i, (a, b) in enumerate(zip(raw, raw[1:]), 1) if not joined[a << 8 | b]]
        if not cuts:
            return [raw] if raw else []
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one fragment: the leftmost pair of lowest rank is merged until no pair has a rank."""
        byte_id = self.byte_id
        ids = [byte_id[b] for b in raw]
        if len(ids) > LONG_PIECE:
            return self._merge_long(ids)
        pairs = self.byte_pairs
        return self._merge_short(ids, [pairs[a << 8 | b] for a, b in zip(raw, raw[1:])])

    def _merge_short(self, ids: list[int], ranks: list[int]) -> list[int]:
        get = self.merges.get
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            new = best & _ID_MASK
            ids[i] = new
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << _ID_BITS | new, _NEVER)
            if i < len(ranks):
                ranks[i] = get(new << _ID_BITS | ids[i + 1], _NEVER)
        return ids

    def piece_ids(self, raw: bytes) -> list[int]:
        """Ids of one piece: its fragments are merged one by one. A short piece is read once for cuts and ranks."""
        if len(raw) > LONG_PIECE:
            return [i for fragment in self.fragments(raw) for i in self.merge(fragment)]
        byte_id, pairs = self.byte_id, self.byte_pairs
        ids = [byte_id[b] for b in raw]
        ranks = [pairs[a << 8 | b] for a, b in zip(raw, raw[1:])]
        if -1 not in ranks:
            return self._merge_short(ids, ranks)
        out, start = [], 0
        while -1 in ranks[start:]:
            cut = ranks.index(-1, start)
            out += self._merge_short(ids[start : cut + 1], ranks[start:cut])
            start = cut + 1
        return out + self._merge_short(ids[start:], ranks[start:])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, so that a fragment of any length takes n log n steps."""
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (m := self.merges.get(ids[i] << _ID_BITS | ids[after[i]])) is not None:
                heapq.heappush(heap, (m, i, ids[i], ids[after[i]]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            merged, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i] = merged & _ID_MASK
            ids[j] = -1
            after[i] = after[j]
            after[j] = -1
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [i for i in ids if i >= 0]

    def _learn(self, piece: str) -> tuple[int, bytes, bytes]:
        known = self.pieces.get(piece) or self.older.get(piece)
        if not known:
            ids = self.piece_ids(piece.encode("utf-8"))
            bytes_of, decimal = self.bytes_of, self.decimal_of
            known = (len(ids), b",".join([decimal[i] for i in ids]), b"".join([bytes_of[i] for i in ids]))
        if len(piece) <= LONG_PIECE:
            if len(self.pieces) >= REMEMBERED:  # pieces in use move on to the new generation
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = known
        return known

    def _spans(self, text: str) -> Iterator[tuple[bool, str]]:
        """Special tokens written out in the text, and what lies between them."""
        at = 0
        if self.special_pattern:
            for found in self.special_pattern.finditer(text):
                if found.start() > at:
                    yield False, text[at : found.start()]
                yield True, found.group()
                at = found.end()
        if at < len(text):
            yield False, text[at:]

    def known_pieces(self, text: str) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, ids as decimal text, their bytes) of each piece of the text, in order."""
        get, learn = self.pieces.get, self._learn
        for special, span in self._spans(text):
            if special:
                token = self.special[span]
                yield 1, str(token).encode(), self.bytes_of[token]
            else:
                for piece in self.pattern.findall(span):
                    yield get(piece) or learn(piece)

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.known_pieces(text) for i in ids.split(b",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of.get(i, b"") for i in ids).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and vocabulary file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and the decoded text.

    ``vocabulary`` is a file every executor has. Null texts count as empty: no tokens, digests of
    the empty string. Rows are independent; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for batch in in_slices(batches):
            counts, id_digests, text_digests, all_ids, decoded = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                parts = list(coder.known_pieces(text))
                ids = b",".join([p[1] for p in parts])
                raw = b"".join([p[2] for p in parts])
                counts.append(sum([p[0] for p in parts]))
                id_digests.append(hashlib.sha256(ids).hexdigest())
                back = raw.decode("utf-8", "replace")
                text_digests.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                if with_ids:
                    all_ids.append([int(i) for i in ids.split(b",")] if ids else [])
                    decoded.append(back)
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([a.cast(pa.string()) if a.type == pa.null() else a for a in arrays], names=names)

    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
