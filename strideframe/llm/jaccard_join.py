"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

A document is the set of its distinct 5-word shingles. Sets with a Jaccard similarity of at least 3/4 differ in at most H = (|r| + |s|) div 7 shingles.
Sizes fall into bands whose largest is at most 4/3 of the smallest, so a set finds its smaller partners in its own band and the one below.
Each band hashes the shingle universe into segments. Give segment i the allowance d_i: -1 (skipped), 0 (equal subsets) or 1 (subsets that differ in one
shingle); if the d_i + 1 add up to H + 1, two sets within distance H must agree on some segment within its allowance. Every set is indexed in
its own band by the subset of each segment, and in a few segments (all of them in the bands of small sets) by its one-deletion neighbourhood;
it probes with the cheapest allowances, counted in shingles that are not frequent: subsets of frequent shingles alone and empty subsets are
the last resort.

Signatures go to buckets as packed blocks. In a bucket, few sets with one signature give all their pairs (SMALL_GROUP at most); more give links to their
first set and are remembered as a group. Candidates pass a parity sketch, whose distance never exceeds the true one, and are verified on the two
texts. Groups that the verified links leave in more than one component give a pair for each component; what is still apart is compared whole in
tiles, on sets of 32-bit hashes, and gives a spanning forest of the links there. Should verification reject a pair of a forest (two shingles with one hash), the
tiles are compared once more with other hashes. So no link between components is missed, and a group gives fewer pairs than it has members.

Equal sets are one class from the start, known by 128 bits. Frequent shingles are a cost estimate only (HOT_MOST entries); results do not depend on them.
Texts are read whole, however long; a component's name is its smallest id, so ties decide nothing.

Nulls, empty texts and texts without words have an empty set and link with nothing. Rows that repeat link like any copies. A null id is never a
component's name unless all ids there are null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, byte_blocks, mixed, row_id, saved, span_hashes, with_group, word_spans
from .components import components

SHINGLE = 5
SMALL_BAND = 64
SMALL_GROUP = 8
HOT_MOST = 200_000
HOT_LOCAL = 4
HOT_FLUSH = 4_000_000
ENTRIES_PER_BUCKET = 1_500_000
FLUSH = 2_000_000
MEMBERS = 50_000
TILE = 2_048
TILE_SHINGLES = 1 << 20
WIDE = 8
_U = np.uint64
_STEPS = np.array([1, 0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _bands() -> tuple[np.ndarray, np.ndarray]:
    lows = [1]
    while lows[-1] < 1 << 33:
        lows.append(4 * lows[-1] // 3 + 1)
    lows = np.array(lows)
    return lows[:-1], lows[1:] - 1


LOW, HIGH = _bands()
SEGMENTS = np.maximum(1, -(-2 * HIGH // 5))


def shingle_sets(texts, seed: int = 0):
    """Blocks (row numbers, set sizes, the sets' 64-bit shingle hashes one after another, ascending in each set) of whole texts."""
    for rows, group in byte_blocks(texts):
        buf = LOWER[np.frombuffer(b" ".join(group) + b" ", np.uint8)]
        starts, ends = word_spans(buf, SPACE)
        (words,) = span_hashes(buf, (starts, ends), seed=seed)
        counts = np.diff(np.searchsorted(starts, np.cumsum([len(x) + 1 for x in group])), prepend=0)
        first = np.concatenate([[0], np.cumsum(counts)])
        doc = np.repeat(np.arange(len(rows)), counts)
        if len(words) >= SHINGLE:
            n = len(words) - SHINGLE + 1
            full = sum(words[k : k + n] * _STEPS[k] for k in range(SHINGLE))
            inside = doc[:n] == doc[SHINGLE - 1 :]
            hashes, owner = mixed(full[inside]), doc[:n][inside]
        else:
            hashes, owner = np.zeros(0, _U), np.zeros(0, int)
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        if len(short):
            alone = [mixed(np.sum(words[first[i] : first[i + 1]] * _STEPS[: counts[i]], dtype=_U, keepdims=True) + _U(counts[i])) for i in short]
            hashes, owner = np.concatenate([hashes, *alone]), np.concatenate([owner, short])
        order = np.argsort(hashes)
        order = order[np.argsort(owner[order].astype(np.uint16 if len(rows) < 65_536 else np.int64), kind="stable")]
        hashes, owner = hashes[order], owner[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[fresh], owner[fresh]
        yield np.array(rows), np.bincount(owner, minlength=len(rows)), hashes


def class_keys(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    ends = np.cumsum(sizes)
    out = []
    for salt in (0x51ED270B7A3C9F11, 0x2127599BF4325C37):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(mixed(hashes ^ _U(salt)))])
        out.append(mixed(total[ends] - total[ends - sizes] + sizes.astype(_U) * _U(salt)))
    return out[0], out[1]


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the set's shingles over a power of two of bits, at least twice as many as shingles and 64."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes % _U(bits)).astype(np.int64), minlength=bits) & 1, bitorder="little").astype(np.uint8).tobytes()


def _folded(held: bytes, width: int) -> np.ndarray:
    """The sketch of the same set over `width` bytes."""
    out = np.frombuffer(held, np.uint64)
    while 8 * len(out) > width:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the distance of two sets."""
    width = min(len(a), len(b))
    return int(np.bitwise_count(_folded(a, width) ^ _folded(b, width)).sum())


def _probe_levels(k: np.ndarray, rare: np.ndarray, deletable: np.ndarray, doc: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Allowance of each segment: the cheapest units, need[doc] of each document."""
    first = np.where(k == 0, 1000, np.where(rare == 0, 500, 16 - np.minimum(rare, 15)))
    second = np.where(k == 0, 1100, np.where(rare < 2, 600, 100 + np.minimum(k, 300)))
    one, two = np.flatnonzero((k > 0) | deletable), np.flatnonzero(deletable)
    segment = np.concatenate([one, two])
    order = np.argsort(doc[segment] * 2048 + np.concatenate([first[one], second[two]]), kind="stable")
    owner = doc[segment[order]]
    units = np.bincount(owner, minlength=len(need))
    if np.any(units < need):
        raise ArithmeticError("a set fills too few segments for its allowance")  # needs a set that defeats the 64-bit hash
    rank = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(units)[:-1]]), units)
    chosen = segment[order][rank < need[owner]]
    return np.bincount(chosen, minlength=len(k)) - 1


def signatures(hashes: np.ndarray, sizes: np.ndarray, hot: np.ndarray):
    """Arrays (document number, signature, flags). Flags: 1 full subset indexed, 2 deletion indexed, 4 looks for 1, 8 looks for 2."""
    band = np.searchsorted(HIGH, sizes)
    token_doc = np.repeat(np.arange(len(sizes)), sizes)
    cold = np.ones(len(hashes), bool)
    if len(hot):
        cold = hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] != hashes
    value, place = mixed(hashes ^ _U(0x3C79AC492BA7B653)), mixed(hashes ^ _U(0x1C69B3F74AC4AE35))
    out = []
    for own in (True, False):
        target = band if own else band - 1
        there = sizes > 0
        if not own:
            there &= (target >= 0) & (4 * HIGH[np.maximum(target, 0)] >= 3 * sizes)
        target = np.maximum(target, 0)
        m = np.where(there, SEGMENTS[target], 0)
        if not m.any():
            continue
        at = np.concatenate([[0], np.cumsum(m)])
        mine = there[token_doc]
        tokens, owner = np.flatnonzero(mine), token_doc[mine]
        slot = at[owner] + (place[mine] % m[owner].astype(_U)).astype(np.int64)
        total = np.zeros(at[-1], _U)
        np.add.at(total, slot, value[mine])
        k = np.bincount(slot, minlength=at[-1])
        rare = np.bincount(slot[cold[mine]], minlength=at[-1])
        doc = np.repeat(np.arange(len(sizes)), m)
        segment = np.arange(at[-1]) - at[doc]
        deletable = (HIGH[target] < SMALL_BAND)[doc] | (segment < 8 + m[doc] // 64)
        need = np.where(there, (sizes + np.minimum(sizes, HIGH[target])) // 7 + 1, 0)
        level = _probe_levels(k, rare, deletable, doc, need)
        salt = mixed((target[doc].astype(_U) << _U(40)) + segment.astype(_U) + _U(0x5851F42D4C957F2D))
        looks = (4 * (level >= 0) + 8 * (level >= 1)).astype(np.uint64)
        full = (k > 0) | deletable if own else level >= 0
        out.append((doc[full], mixed(total[full] ^ salt[full]), looks[full] + _U(own)))
        near = deletable[slot] if own else level[slot] >= 1
        flags = 4 * (level[slot[near]] >= 1).astype(np.uint64) + _U(2 * own)
        out.append((owner[near], mixed((total[slot[near]] - value[tokens[near]]) ^ salt[slot[near]]), flags))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*out))


def packed_blocks(keys: np.ndarray, doc: np.ndarray, sig: np.ndarray, flags: np.ndarray, buckets: int):
    """Per bucket a block: set keys with their numbers of entries, and entries of 52 hash bits and 4 flags in 7 bytes."""
    bucket = (sig % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket * len(keys) + doc, kind="stable")
    bucket, doc = bucket[order], doc[order]
    entry = ((sig[order] >> _U(12)) << _U(4)) | flags[order]
    entry = np.ascontiguousarray(entry.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :7]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    rows = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        starts = np.concatenate([[lo], np.flatnonzero(np.diff(doc[lo:hi])) + lo + 1])
        rows.append((int(bucket[lo]), keys[doc[starts]].tobytes(), np.diff(np.append(starts, hi)).astype("<u4").tobytes(), entry[lo:hi].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "keys", "counts", "entries"])


def bucket_candidates(keys, counts, entries):
    """From a bucket's blocks: pairs (a < b) of set keys, and the different groups above SMALL_GROUP as their ascending members."""
    raw = np.concatenate([np.frombuffer(x, np.uint8) for x in entries]).reshape(-1, 7)
    entry = np.zeros((len(raw), 8), np.uint8)
    entry[:, :7] = raw
    entry = entry.view("<u8").ravel()
    key = np.repeat(np.concatenate([np.frombuffer(x, "<u8") for x in keys]), np.concatenate([np.frombuffer(x, "<u4") for x in counts]))
    sig = entry >> _U(4)
    order = np.argsort(sig)
    sig = sig[order]
    again = np.zeros(len(sig), bool)
    again[1:] = sig[1:] == sig[:-1]
    again[:-1] |= again[1:]
    order = order[again]
    order = order[np.lexsort((key[order], entry[order] >> _U(4)))]
    sig, key, flags = entry[order] >> _U(4), key[order], (entry[order] & _U(15)).astype(np.uint8)
    if not len(sig):
        return np.zeros((0, 2), _U), []
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(fresh)
    sig, key, flags = sig[at], key[at], np.bitwise_or.reduceat(flags, at)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(sig)) + 1])
    length = np.diff(np.append(starts, len(sig)))
    found, groups = [np.zeros((0, 2), _U)], {}

    def matching(a, b):
        return ((flags[a] & 4 > 0) & (flags[b] & 1 > 0)) | ((flags[b] & 4 > 0) & (flags[a] & 1 > 0)) | ((flags[a] & 8 > 0) & (flags[b] & 2 > 0)) | ((flags[b] & 8 > 0) & (flags[a] & 2 > 0))

    for size in range(2, SMALL_GROUP + 1):
        own = starts[length == size]
        for i in range(size):
            for j in range(i + 1, size):
                ok = matching(own + i, own + j)
                found.append(np.stack([key[own[ok] + i], key[own[ok] + j]], axis=1))
    for lo, n in zip(starts[length > SMALL_GROUP], length[length > SMALL_GROUP]):
        looks, holds = flags[lo : lo + n] & 12, flags[lo : lo + n] & 3
        if not (looks.any() and holds.any()):
            continue
        members = key[lo : lo + n]
        found.append(np.stack([np.full(n - 1, members[0]), members[1:]], axis=1))
        groups[members.tobytes()] = members
    pairs = np.concatenate(found)
    return np.unique(pairs, axis=0) if len(pairs) else pairs, list(groups.values())


DESCRIBED = "doc_id long, n_shingles long, key long, set_id binary, row_id binary, sketch binary, hot long, hot_n long"


def described(docs: DataFrame) -> DataFrame:
    """One row per document with its set's size, identity and sketch; and rows (hot, hot_n) of shingles frequent among a task's different sets.

    `set_id` has 128 bits, the first 64 of which are `key`.
    """

    def frequent(parts):
        shingles, n = np.unique(np.concatenate(parts), return_counts=True)
        keep = np.flatnonzero(n >= HOT_LOCAL)
        out = pd.DataFrame({"hot": shingles[keep].view(np.int64), "hot_n": n[keep]})
        return out.reindex(columns=["doc_id", "n_shingles", "key", "set_id", "row_id", "sketch", "hot", "hot_n"]).astype(dict.fromkeys(("doc_id", "n_shingles", "key"), "Int64"))

    def run(batches):
        parts, held, seen = [], 0, set()
        for pdf in batches:
            for rows, sizes, hashes in shingle_sets(pdf["text"].tolist()):
                key, key2 = class_keys(hashes, sizes)
                ends = np.cumsum(sizes)
                out = pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[rows], "n_shingles": sizes, "key": key.view(np.int64)})
                out["doc_id"] = out["doc_id"].astype("Int64")
                out["set_id"] = [x.tobytes() for x in np.stack([key, key2], axis=1).astype(">u8")]
                out["row_id"] = pdf["row_id"].to_numpy()[rows]
                out["sketch"] = [sketch(hashes[e - n : e]) if n else None for n, e in zip(sizes, ends)]
                yield out.assign(hot=pd.NA, hot_n=pd.NA)
                new = np.array([not (k in seen or seen.add(k)) for k in key.tolist()], bool)
                parts.append(hashes[np.repeat(new, sizes)])
                held += len(parts[-1])
                if held >= HOT_FLUSH:
                    yield frequent(parts)
                    parts, held, seen = [], 0, set()
        if held:
            yield frequent(parts)

    return docs.select("doc_id", row_id().alias("row_id"), "text").mapInPandas(run, DESCRIBED)


def blocks(docs: DataFrame, held_hot, buckets: int) -> DataFrame:
    """Packed signature blocks of all documents; equal sets that follow each other in a task go in once."""

    def run(batches):
        seen, parts, held, at = set(), [], 0, 0

        def flush():
            keys, doc, sig, flags = (np.concatenate(x) for x in zip(*parts))
            return packed_blocks(keys, doc, sig, flags, buckets)

        for pdf in batches:
            for _, sizes, hashes in shingle_sets(pdf["text"].tolist()):
                keys, more = class_keys(hashes, sizes)
                new = np.zeros(len(keys), bool)
                for i, key in enumerate(zip(keys.tolist(), more.tolist())):
                    if sizes[i] and key not in seen:
                        seen.add(key)
                        new[i] = True
                if len(seen) > 200_000:
                    seen.clear()
                hashes = hashes[np.repeat(new, sizes)]
                keys, sizes = keys[new], sizes[new]
                if not len(keys):
                    continue
                doc, sig, flags = signatures(hashes, sizes, held_hot.value)
                parts.append((keys, doc + at, sig, flags))
                at += len(keys)
                held += len(sig)
                if held >= FLUSH:
                    yield flush()
                    parts, held, at = [], 0, 0
        if parts:
            yield flush()

    return docs.select("text").mapInPandas(run, "bucket long, keys binary, counts binary, entries binary")


def candidates(packed: DataFrame) -> DataFrame:
    """Rows (a, b) of candidate pairs and rows (group, part, members) of larger groups."""

    def run(pdf):
        pairs, groups = bucket_candidates(pdf["keys"], pdf["counts"], pdf["entries"])
        # a group goes by its members, so that the same group of another signature has the same name
        cut = [(hashlib.sha256(members.tobytes()).hexdigest()[:32], i, members[i : i + MEMBERS].tobytes()) for members in groups for i in range(0, len(members), MEMBERS)]
        out = pd.DataFrame({"a": pairs[:, 0].view(np.int64), "b": pairs[:, 1].view(np.int64)}).astype("Int64")
        out = pd.concat([out, pd.DataFrame(cut, columns=["group", "part", "members"])], ignore_index=True)
        return out.astype({"part": "Int64"})[["a", "b", "group", "part", "members"]]

    return packed.groupBy("bucket").applyInPandas(run, "a long, b long, group string, part long, members binary")


def verified(pairs: DataFrame, facts: DataFrame, docs: DataFrame, by: str = "node") -> DataFrame:
    """Those of the pairs (a, b), named by the column `by` of `facts`, whose texts have a similarity of 3/4 or more, as nodes a < b."""
    side = lambda s: facts.select(F.col(by).alias(s), F.col("node").alias(f"node_{s}"), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where("node_a <> node_b AND 4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    near = near.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), "n_a", "n_b", "sketch_a", "sketch_b")

    def pruned(batches):
        for pdf in batches:
            ok = [sketch_distance(x, y) <= (m + n) // 7 for x, y, m, n in zip(pdf["sketch_a"], pdf["sketch_b"], pdf["n_a"], pdf["n_b"])]
            yield pdf.loc[np.array(ok, bool), ["a", "b"]]

    near = saved(near.mapInPandas(pruned, "a long, b long").distinct(), "near-pairs")
    wanted = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    texts = saved(_with_texts(wanted, facts, docs), "near-texts")
    both = near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def alike(batches):
        for pdf in batches:
            keep, last, held = [], None, None
            for x, y in zip(pdf["text_a"], pdf["text_b"]):
                if last is None or y != last:  # neighbours often share their second text
                    last, held = y, word_shingles(y)
                own = word_shingles(x)
                keep.append(100 * len(own & held) >= 75 * len(own | held))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return both.mapInPandas(alike, "a long, b long")


def _with_texts(wanted: DataFrame, facts: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the sets `wanted`: the text of each set's representative row."""
    rows = facts.join(wanted, "node", "left_semi").select("node", F.col("row_id").alias("wanted_row"), "again")
    texts = docs.select(row_id().alias("row_id"), "text").join(rows.hint("shuffle_hash"), F.col("row_id") == F.col("wanted_row"))
    # rows that repeat have one text
    again = texts.where("again").groupBy("node").agg(F.first("text").alias("text"))
    return texts.where("NOT again").select("node", "text").unionByName(again)


_LOWERED = bytes(LOWER.tolist())


def word_shingles(text: str) -> set:
    """The shingles themselves, for verification."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWERED).split()
    if len(words) < SHINGLE:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def _open_members(groups: DataFrame, labels: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows (group, node, component) of the groups whose members have more than one component.

    With the group's members and their shingles in all.
    """

    def frame(part):
        return pd.DataFrame({"group": np.repeat([g for g, _ in part], [len(k) for _, k in part]), "key": np.concatenate([k for _, k in part])})

    def unpacked(batches):
        for pdf in batches:
            part, held = [], 0
            for group, packed in zip(pdf["group"], pdf["members"]):
                part.append((group, np.frombuffer(packed, "<i8")))
                held += len(part[-1][1])
                if held >= MEMBERS:  # a frame holds less than twice as many keys, however large the groups are
                    yield frame(part)
                    part, held = [], 0
            if part:
                yield frame(part)

    rows = groups.mapInPandas(unpacked, "group string, key long").join(facts.select("key", "node", "n_shingles"), "key").drop("key")
    rows = rows.join(labels, "node", "left")
    rows = saved(rows.select("group", "node", "n_shingles", F.coalesce("component", "node").alias("component")), "group-members")
    about = rows.groupBy("group").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles"),
    )
    return with_group(rows, about, ["group"], "members", rows.count()).where("low <> high")


def spanning_links(component: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between members of different components, a spanning forest: fewer than there are components.

    sets: ascending hashes. Two members link when their hashes agree to a similarity of 3/4. side: only members of different sides are compared.
    """
    root = list(range(int(component.max()) + 1))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    n = np.array([len(x) for x in sets])
    bits = max(64, 1 << int(WIDE * n.mean() - 1).bit_length())
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
    place = (mixed(flat.astype(_U)) % _U(bits)).astype(np.int64)
    parity = np.zeros((len(n), bits // 64), _U)
    np.bitwise_xor.at(parity, (owner, place // 64), _U(1) << (place % 64).astype(_U))
    start, out = np.cumsum(n) - n, []
    now = component.copy()  # the components as links join them
    for i in range(len(n) - 1):
        rest = slice(i + 1, None)
        ok = (now[rest] != now[i]) & (4 * np.minimum(n[rest], n[i]) >= 3 * np.maximum(n[rest], n[i]))
        if side is not None:
            ok &= side[rest] != side[i]
        at = np.flatnonzero(ok) + i + 1
        if len(at):
            at = at[np.bitwise_count(parity[at] ^ parity[i]).sum(axis=1) <= (n[at] + n[i]) // 7]
        if not len(at):
            continue
        own = sets[i]
        other = np.concatenate([sets[j] for j in at])
        met = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
        common = np.add.reduceat(met, np.cumsum(n[at]) - n[at], dtype=np.int64)
        for j in at[100 * common >= 75 * (n[at] + n[i] - common)]:
            a, b = find(int(component[i])), find(int(component[j]))
            if a != b:
                root[b] = a
                now[now == now[j]] = now[i]
                out.append((i, int(j)))
    return out


def _across(rows: DataFrame, facts: DataFrame, docs: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b) that join the components of a group, as far as its members' hashed sets say that they are linked.

    A group is dealt in tiles of two parts each, of TILE members and TILE_SHINGLES shingles at most (or one member), so that no task holds one
    whole. A tile gives a spanning forest, so there are fewer pairs than members.
    """

    def hashed(batches):
        for pdf in batches:
            for at, sizes, hashes in shingle_sets(pdf["text"].tolist(), seed):
                short = (hashes >> _U(32)).astype(np.uint32)  # still ascending
                ends = np.cumsum(sizes)
                yield pd.DataFrame({"node": pdf["node"].to_numpy()[at], "hashes": [short[e - k : e].tobytes() for k, e in zip(sizes, ends)]})

    own = saved(_with_texts(rows.select("node").distinct(), facts, docs).mapInPandas(hashed, "node long, hashes binary"), "group-sets")
    parts = F.greatest(F.ceil(F.col("members") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.select("group", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "component", "node").join(own, "node")

    def compared(key, pdf):
        names = pdf["node"].tolist()
        side = pdf["part"].to_numpy() if key[1] != key[2] else None
        found = spanning_links(pd.factorize(pdf["component"])[0], [np.frombuffer(x, np.uint32) for x in pdf["hashes"]], side)
        return pd.DataFrame([(min(names[i], names[j]), max(names[i], names[j])) for i, j in found], columns=["a", "b"])

    return rows.groupBy("group", "low", "high").applyInPandas(compared, "a long, b long").distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Every row of `docs` as (doc_id, row_id, n_shingles, component, component_id); component is null for empty sets."""
    docs = docs.select("doc_id", "text")
    rows = saved(described(docs), "sets")
    sets = rows.where("hot IS NULL")
    entries = (sets.agg(F.sum("n_shingles")).first()[0] or 0) * 0.7
    buckets = max(64, int(entries / ENTRIES_PER_BUCKET) + 1)
    top = rows.where("hot IS NOT NULL").groupBy("hot").agg(F.sum("hot_n").alias("n")).orderBy(F.desc("n"), "hot").limit(HOT_MOST)
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(top.select("hot").toPandas()["hot"].to_numpy(np.int64).view(np.uint64)))
    found = saved(candidates(blocks(docs, hot, buckets)), "candidates")
    hot.destroy()
    # one representative row per set, which gets a number, the set's node
    facts = sets.where("n_shingles > 0").groupBy("set_id", "key", "n_shingles").agg(F.min(F.struct("doc_id", "row_id", "sketch")).alias("own"), F.count(F.lit(1)).alias("rows"))
    repeated = sets.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_id", F.lit(True).alias("again"))
    facts = facts.select("set_id", "key", "n_shingles", "rows", "own.row_id", "own.sketch").join(repeated, "row_id", "left")
    facts = saved(facts.withColumns({"again": F.coalesce("again", F.lit(False)), "node": F.monotonically_increasing_id()}), "facts")
    pairs = found.where("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # sets that share a key stand for each other in candidates; all of them are tried, with each other too
    same = facts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    links = saved(verified(pairs.union(same.select("key", "key")), facts, docs, by="key"), "verified").select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = saved(components(links), "labels")
    groups = saved(found.where("group IS NOT NULL").groupBy("group", "part").agg(F.first("members").alias("members")), "groups")
    # groups in more than one component: spanning forests of their links, with new hashes until every link given is true
    seed, rejected = 1, 1
    while rejected:
        members = saved(_open_members(groups, labels, facts), "open-groups")
        if members.isEmpty():
            break
        more = saved(_across(members, facts, docs, seed), "more-pairs")
        extra = saved(verified(more, facts, docs).distinct(), "verified")
        n_extra = extra.count()
        if n_extra:
            stars = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
            labels = saved(components(stars.union(extra.select(F.col("a").alias("u"), F.col("b").alias("v")))), "labels")
        seed, rejected = seed + 1, more.count() - n_extra
    columns = ["doc_id", "row_id", "n_shingles", "component", "component_id"]
    named = facts.select("set_id", "node", "rows").join(labels, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"), "rows")
    full = sets.where("n_shingles > 0").select("doc_id", "row_id", "n_shingles", "set_id")
    classes = saved(with_group(full, named, ["set_id"], "rows", sets.count()).select(*columns[:-1]), "classes")
    names = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    alone = sets.where("n_shingles = 0").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return with_group(classes, names, ["component"], "rows", classes.count()).select(*columns).unionByName(alone.select(*columns))


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component: the smallest doc_id, then the smallest text hash. Rows with an empty set all stay."""
    rows = saved(jaccard_components(docs), "components")
    leads = rows.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "row_id")).alias("lead"))
    lead = leads.select(F.col("lead.row_id").alias("__key"))
    # of rows that repeat id and text one stays: with the least text of its other columns
    times = rows.join(lead, F.col("row_id") == F.col("__key"), "left_semi").groupBy(F.col("row_id").alias("__key")).agg((F.count(F.lit(1)) > 1).alias("__again"))
    stay = times.unionByName(rows.where("component IS NULL").select(F.col("row_id").alias("__key"), F.lit(False).alias("__again")).distinct())
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")  # any type has an order as text
    out = docs.select(kept, order.alias("order"), row_id().alias("__own")).join(stay.hint("shuffle_hash"), F.col("__own") == F.col("__key"))
    again = out.where("__again").groupBy("__own").agg(F.min_by("kept", "order").alias("kept"))
    return out.where("NOT __again").select("kept").unionByName(again.select("kept")).select("kept.*")


def op10_universe_partition(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
