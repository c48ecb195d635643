"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The model file gives pieces and scores; a text is its characters behind one leading space, spaces written as U+2581. The agenda holds every pair of
neighbours whose concatenation is a piece; the best score, leftmost first, is merged until the agenda is empty. With dropout each candidate is
skipped if a keyed hash of (seed, id of the text, span) falls below the rate, so every text, and every place in it, has its own
segmentation, the same on each run. Characters without a piece become byte pieces, as do literal U+2581, so that decoding gives back every text.

No piece has U+2581 behind another character, so words are independent: a batch's words advance together in numpy, one merge a word and round. Words of more
than LONG_WORD characters run through the same agenda as a heap.

Nulls: a null text has null ids and decodes to null; an empty one has none. Rows that repeat have equal results. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import mixed

SPACE = "▁"
BLOCK = 1 << 17
LONG_WORD = 256
SLOT_BITS = 20
NONE = np.int32(2**31 - 1)
_U = np.uint64
_models: dict = {}


class Model:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.bytes = [p.replace(SPACE, " ").encode() if ok else b"" for p, ok in zip(pieces, plain)]
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        keys, merged = [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    merged.append(i)
        keys, merged = np.array(keys, np.int64), np.array(merged, np.int32)
        # a table with one entry a slot, and the entries that found theirs taken
        self.slot_key, self.slot_piece = np.full(1 << SLOT_BITS, -1, np.int64), np.full(1 << SLOT_BITS, -1, np.int32)
        slot = _slot(keys)
        _, first = np.unique(slot, return_index=True)
        self.slot_key[slot[first]], self.slot_piece[slot[first]] = keys[first], merged[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.rest_key, self.rest_piece = np.append(keys[rest], 1 << 62), np.append(merged[rest], np.int32(-1))
        self.full = np.zeros(1 << SLOT_BITS, bool)
        self.full[slot[rest]] = True

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece made of two neighbours, or -1."""
        key = left.astype(np.int64) << 20 | right
        slot = _slot(key)
        out = np.where(self.slot_key[slot] == key, self.slot_piece[slot], np.int32(-1))
        rest = np.flatnonzero(self.full[slot] & (out < 0))
        if len(rest):
            at = np.searchsorted(self.rest_key, key[rest])
            at = np.minimum(at, len(self.rest_key) - 1)
            out[rest] = np.where(self.rest_key[at] == key[rest], self.rest_piece[at], -1)
        return np.where((left >= 0) & (right >= 0), out, np.int32(-1))


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.astype(_U) * _U(0x9E3779B97F4A7C15) >> _U(64 - SLOT_BITS)).astype(np.int64)


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def text_key(doc_id, seed: int) -> int:
    """What a text's dropout hangs on besides places."""
    return zlib.crc32(f"{seed}:{doc_id}".encode()) | seed << 32 & (1 << 64) - 1


def _dropped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    """Whether the candidate (start, middle, end) of a text is skipped."""
    place = (start.astype(_U) << _U(24)) + ((middle - start).astype(_U) << _U(12)) + (end - start).astype(_U)
    return mixed(mixed(key) ^ place) < _U(limit)


_M64 = (1 << 64) - 1


def _mixed_one(x: int) -> int:
    """mixed() of one number."""
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & _M64
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & _M64
    return x ^ x >> 33


def _joined_one(m: Model, left: int, right: int) -> int:
    """Model.joined() of one pair."""
    key = left << 20 | right
    slot = (key * 0x9E3779B97F4A7C15 & _M64) >> 64 - SLOT_BITS
    if m.slot_key[slot] == key:
        return int(m.slot_piece[slot])
    if m.full[slot]:
        at = int(np.searchsorted(m.rest_key, key))
        if m.rest_key[at] == key:
            return int(m.rest_piece[at])
    return -1


def heap_merge(m: Model, symbols: list[int], key: int, start: int, limit: int) -> list[int]:
    """The agenda of one word as a heap: ids of `symbols` (-1: no piece) after merging."""
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    ends = list(range(1, n + 1))
    agenda: list = []
    spread = _mixed_one(key)

    def push(i):
        j = after[i]
        if j < n and symbols[i] >= 0 and symbols[j] >= 0:
            piece = _joined_one(m, symbols[i], symbols[j])
            # _dropped() of one candidate
            place = ((start + i) << 24) + ((j - i) << 12) + ends[j] - i & _M64
            if piece >= 0 and not (limit and _mixed_one(spread ^ place) < limit):
                heapq.heappush(agenda, (int(m.rank[piece]), i, piece, symbols[i], symbols[j], j))

    for i in range(n):
        push(i)
    while agenda:
        _, i, piece, a, b, j = heapq.heappop(agenda)
        if symbols[i] != a or after[i] != j or symbols[j] != b:
            continue
        symbols[i], symbols[j], after[i], ends[i] = piece, None, after[j], ends[j]
        if after[j] < n:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


def _merged(m: Model, points: np.ndarray, key: np.ndarray, offset: np.ndarray, limit: int) -> np.ndarray:
    """Per character the id of the piece that begins there, -1 where its bytes stand for it, -2 within a piece.

    key: the text's key per character; offset: the character's place in its text.
    """
    out = np.full(len(points), -2, np.int32)
    symbol = m.char[points]
    is_space = points == ord(SPACE)
    first = np.ones(len(points), bool)
    first[1:] = is_space[1:] & ~is_space[:-1] | (offset[1:] == 0)
    bounds = np.append(np.flatnonzero(first), len(points))
    length = np.diff(bounds)
    for w in np.flatnonzero(length > LONG_WORD):
        lo, hi = bounds[w], bounds[w + 1]
        at = lo
        for piece in heap_merge(m, symbol[lo:hi].tolist(), int(key[lo]), int(offset[lo]), limit):
            out[at] = piece
            at += 1 if piece < 0 else m_length(m, piece)
    word = np.repeat(np.arange(len(length)), length)
    place = np.flatnonzero((length <= LONG_WORD)[word])
    symbol, word = symbol[place], word[place]
    end = place + 1  # one past the symbol's last character, in the block

    def candidates(i):
        """Rank and piece of the pairs that begin at the symbols i (indices with a successor in the same word)."""
        piece = m.joined(symbol[i], symbol[i + 1])
        rank = np.where(piece >= 0, m.rank[piece], NONE)
        if limit:
            shift = offset[place[i]] - place[i]
            skip = _dropped(key[place[i]], place[i] + shift, place[i + 1] + shift, end[i + 1] + shift, limit)
            rank = np.where(skip, NONE, rank)
        return rank.astype(np.int32), piece

    rank, piece = np.full(len(symbol), NONE, np.int32), np.full(len(symbol), -1, np.int32)
    pairs = np.flatnonzero(word[1:] == word[:-1])
    rank[pairs], piece[pairs] = candidates(pairs)
    while len(symbol):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes = np.diff(np.append(starts, len(word)))
        best = np.minimum.reduceat(rank, starts)
        open_ = np.repeat(best < NONE, sizes)
        out[place[~open_]] = symbol[~open_]
        if not open_.any():
            break
        symbol, word, place, end, rank, piece = symbol[open_], word[open_], place[open_], end[open_], rank[open_], piece[open_]
        best = np.repeat(best[best < NONE], sizes[best < NONE])
        at = np.flatnonzero(rank == best)
        at = at[np.append(True, word[at[1:]] != word[at[:-1]])]
        symbol[at], end[at] = piece[at], end[at + 1]
        stay = np.ones(len(symbol), bool)
        stay[at + 1] = False
        at = at - np.arange(len(at))  # one symbol has gone for each merge to the left
        symbol, word, place, end, rank, piece = symbol[stay], word[stay], place[stay], end[stay], rank[stay], piece[stay]
        rank[at], piece[at] = NONE, -1
        for side in (at[(at + 1 < len(word))], at[at > 0] - 1):
            side = side[word[side] == word[side + 1]]
            if len(side):
                rank[side], piece[side] = candidates(side)
    return out


def m_length(m: Model, piece: int) -> int:
    return len(m.bytes[piece].decode("utf-8", "replace"))


def encode_texts(m: Model, texts: list, keys: list[int], rate: float) -> list:
    """Ids (int32 arrays) of whole texts; None for None."""
    limit = int(rate * (1 << 64)) if rate < 1 else (1 << 64) - 1
    out: list = [None] * len(texts)
    group, held = [], 0

    def flush():
        points = [np.frombuffer((SPACE + texts[i]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) for i in group]
        sizes = np.array([len(p) for p in points])
        all_points = np.concatenate(points)
        offset = np.arange(len(all_points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        masked = np.where((all_points == ord(SPACE)) & (offset > 0), 0x10FFFF, all_points)  # a literal mark has no piece
        masked[masked == 32] = ord(SPACE)
        ids = _merged(m, masked, np.repeat(np.array([keys[i] for i in group], _U), sizes), offset, limit)
        for i, lo, n in zip(group, np.cumsum(sizes) - sizes, sizes):
            own = ids[lo : lo + n]
            bare = np.flatnonzero(own == -1)
            if not len(bare):
                out[i] = own[own >= 0]
                continue
            spelled = [m.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in all_points[lo + bare]]
            counts = np.where(own == -1, 0, own >= 0).astype(np.int64)
            counts[bare] = [len(s) for s in spelled]
            full = np.empty(counts.sum(), np.int32)
            ends = np.cumsum(counts)
            single = own >= 0
            full[ends[single] - 1] = own[single]
            full[np.concatenate([np.arange(ends[b] - counts[b], ends[b]) for b in bare])] = np.concatenate(spelled)
            out[i] = full

    for i, text in enumerate(texts):
        if text is None:
            continue
        if not text:
            out[i] = np.zeros(0, np.int32)
            continue
        if group and held + len(text) > BLOCK:
            flush()
            group, held = [], 0
        group.append(i)
        held += len(text) + 1
    if group:
        flush()
    return out


def decode_ids(m: Model, ids) -> str | None:
    if ids is None:
        return None
    return b"".join([m.bytes[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


def encode(docs: DataFrame, path: str, rate: float = 0.1, seed: int = 1) -> DataFrame:
    """(doc_id, ids) of every whole text."""

    def run(batches):
        m = model(path)
        for pdf in batches:
            own = encode_texts(m, [t if isinstance(t, str) else None for t in pdf["text"]], [text_key(d, seed) for d in pdf["doc_id"].astype("Int64")], rate)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": pd.Series(own, index=pdf.index, dtype=object)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches):
        m = model(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": pd.Series([decode_ids(m, x) for x in pdf["ids"]], index=pdf.index, dtype=object)})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def op4_merge_dropout(docs: DataFrame, path: str, rate: float = 0.1, seed: int = 1) -> DataFrame:
    """Per document the number of pieces, the crc32 of its little-endian 32-bit ids, and whether they decode to the text."""

    def run(batches):
        m = model(path)
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            for lo in range(0, len(texts), 500):
                part = texts[lo : lo + 500]
                ids = encode_texts(m, part, [text_key(d, seed) for d in pdf["doc_id"].iloc[lo : lo + 500].astype("Int64")], rate)
                rows = [(0, 0, True) if x is None else (len(x), zlib.crc32(x.astype("<i4").tobytes()), decode_ids(m, x.tolist()) == t) for x, t in zip(ids, part)]
                out = pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "round_trip"])
                out.insert(0, "doc_id", pdf["doc_id"].iloc[lo : lo + 500].astype("Int64").to_numpy())
                yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
