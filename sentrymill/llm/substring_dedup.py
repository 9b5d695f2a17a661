"""Removal of repeated word passages by difference-cover anchors.

Positions whose place modulo a period lies in a difference cover are anchors: for any two
positions some shift below the period takes both to anchors. So two equal windows share an
aligned anchor whose shorter stretch lies inside both, and only windows around a repeated
anchor can repeat. Those are extended to the whole window and compared.

Documents are read in blocks. A block sends its distinct anchor hashes to shards by hash, and
each shard answers with a bit per hash: met elsewhere or not. The block then extends its
repeated anchors, sends the distinct hashes of those windows, and is answered again. However
often a passage occurs, a block sends it once, so no shard or task holds its occurrences.
Blocks are written once, and the number of shards follows the bytes of text.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, rows_of, rows_one_by_one, text_bytes
from .packing import pack, steps, unpack, unsteps

#: A perfect difference set; every residue modulo 21 is a difference of two of them.
PERIOD, COVER = 21, (0, 1, 6, 8, 18)
#: Multipliers of the two rolling hashes, odd.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of text in a block; documents are never cut.
BLOCK = 6_000_000
#: Bytes of text for each shard.
SHARD_BYTES, LEAST_SHARDS = 16 << 20, 8
ROUTE = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("data", pa.binary())])
ROUTE_SQL = "block bigint, shard int, data binary"


@functools.lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))


def powers(which: int, n: int, inverse: bool) -> np.ndarray:
    base = pow(BASES[which], -1, 1 << 64) if inverse else BASES[which]
    return _powers(base, 1 << max(16, n.bit_length()))


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Passages:
    """A block's texts as one stream of word hashes, with where each document starts and ends."""

    def __init__(self, texts: list[bytes], window: int):
        self.words = [t.split() for t in texts]
        self.window, self.short = window, window - PERIOD + 1
        numbers, n = Numbers(), np.array([len(w) for w in self.words], np.int64)
        ids = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(self.words)), np.int64, int(n.sum()))
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))[ids]
        self.ends = np.cumsum(n)
        self.begins = self.ends - n
        self.prefix: dict[int, np.ndarray] = {}

    def hash_at(self, at: np.ndarray, length: int, which: int) -> np.ndarray:
        if which not in self.prefix:
            rising = np.cumsum(self.hashes * powers(which, len(self.hashes), False)[: len(self.hashes)])
            self.prefix[which] = np.concatenate([[np.uint64(0)], rising])
        prefix = self.prefix[which]
        mixed = (prefix[at + length] - prefix[at]) * powers(which, len(self.hashes), True)[at]
        return mixed ^ (mixed >> np.uint64(31))

    def anchors(self) -> np.ndarray:
        """Places of anchors in documents of a window or more, whose stretch ends within the document."""
        place = np.arange(len(self.hashes)) - np.repeat(self.begins, self.ends - self.begins)
        last = np.repeat(self.ends, self.ends - self.begins)
        long = np.repeat(self.ends - self.begins >= self.window, self.ends - self.begins)
        return np.flatnonzero(np.isin(place % PERIOD, COVER) & long & (np.arange(len(self.hashes)) + self.short <= last))

    def around(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of windows that hold the stretch of one of the anchors."""
        doc = np.searchsorted(self.ends, anchors, "right")
        first = np.maximum(anchors - (PERIOD - 1), self.begins[doc])
        last = np.minimum(anchors, self.ends[doc] - self.window)
        change = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(change, first[first <= last], 1)
        np.add.at(change, last[first <= last] + 1, -1)
        return np.flatnonzero(np.cumsum(change[:-1]) > 0)

    def kept(self, starts: np.ndarray) -> np.ndarray:
        """For each word, whether no window that begins at starts covers it."""
        change = np.zeros(len(self.hashes) + 1, np.int64)
        change[starts] += 1
        np.add.at(change, starts + self.window, -1)
        return np.cumsum(change[:-1]) == 0


class Asked:
    """Distinct keys (64 and 32 bits) of places, in order, cut into shards by their top bits."""

    def __init__(self, h: np.ndarray, g: np.ndarray, shards: int):
        order = np.lexsort((g, h)) if len(g) else np.argsort(h)
        h, g = h[order], g[order] if len(g) else g
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | ((g[1:] != g[:-1]) if len(g) else False)
        self.key = np.empty(len(h), np.int64)
        self.key[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.h, self.g = h[first], g[first] if len(g) else g
        self.more = np.diff(first, append=len(h)) > 1
        shard = ((self.h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        self.cuts = np.searchsorted(shard, np.arange(shards + 1))

    def requests(self):
        for k in range(len(self.cuts) - 1):
            s, e = self.cuts[k], self.cuts[k + 1]
            if e > s:
                yield k, pack(steps(self.h[s:e]), self.g[s:e], np.packbits(self.more[s:e]))

    def met(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each place, whether its key occurs twice or more anywhere."""
        found = np.zeros(len(self.h), bool)
        if sorted(answers) != np.flatnonzero(np.diff(self.cuts)).tolist():
            raise RuntimeError("a block has not heard from every shard that it asked")
        for k, data in answers.items():
            s, e = self.cuts[k], self.cuts[k + 1]
            found[s:e] = np.unpackbits(unpack(data)[0], count=e - s)
        return found[self.key]


def _out(block: int, shard: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([data], pa.binary())], schema=ROUTE)


def _blocks(batches):
    """Packed ids and texts of documents in batches with columns id, t."""
    ids, texts, held = [], [], 0

    def done():
        numbers, null = np.array([x if x is not None else 0 for x in ids], np.int64), np.array([x is None for x in ids], bool)
        packed = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        data = pack(numbers, null, np.array([len(t) for t in texts], np.int64), np.frombuffer(packed, np.uint8))
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["texts"])

    for batch in batches:
        for row, text in zip(rows_of(batch, "id"), rows_of(batch, "t")):
            ids.append(row)
            texts.append(text)
            held += len(text)
            if held >= BLOCK:
                yield done()
                ids, texts, held = [], [], 0
    if ids:
        yield done()


def _texts(data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ids, null, lengths, packed = unpack(data)
    joined, ends = zstandard.ZstdDecompressor().decompress(packed.tobytes()), np.cumsum(lengths).tolist()
    return ids, null, [joined[s:e] for s, e in zip([0, *ends[:-1]], ends)]


def _ask_anchors(passages: Passages, shards: int) -> tuple[np.ndarray, Asked]:
    at = passages.anchors()
    return at, Asked(passages.hash_at(at, passages.short, 0), np.empty(0, np.uint32), shards)


def _ask_windows(passages: Passages, answers: dict, shards: int) -> tuple[np.ndarray, Asked]:
    at, asked = _ask_anchors(passages, shards)
    starts = passages.around(at[asked.met(answers)])
    g = (passages.hash_at(starts, passages.window, 1) >> np.uint64(32)).astype(np.uint32)
    return starts, Asked(passages.hash_at(starts, passages.window, 0), g, shards)


def _answer(batches):
    """Rows of one shard after another: which keys several blocks sent, or one block met twice."""
    name, held = None, []

    def close():
        if not held:
            return
        parts = [(b, *unpack(d)) for b, d in held]
        hs = [unsteps(p[1]) for p in parts]
        h, g = np.concatenate(hs), np.concatenate([p[2] for p in parts])
        more = np.concatenate([np.unpackbits(p[3], count=len(x)) for p, x in zip(parts, hs)]).astype(bool)
        order = np.lexsort((g, h)) if len(g) else np.argsort(h)
        h, g = h[order], g[order] if len(g) else g
        same = (h[1:] == h[:-1]) & ((g[1:] == g[:-1]) if len(g) else True)
        twice = more[order]
        twice[1:] |= same
        twice[:-1] |= same
        # a key flagged by one block alone may be sent by no other, so flags need not spread
        found = np.empty(len(h), bool)
        found[order] = twice
        for (b, *_), bits in zip(parts, np.split(found, np.cumsum([len(x) for x in hs])[:-1])):
            yield _out(b, name, pack(np.packbits(bits)))

    for batch in batches:
        for b, k, data in rows_one_by_one(batch):
            if k != name:
                yield from close()
                name, held = k, []
            held.append((b, data))
    yield from close()


def _answered(requests: DataFrame, shards: int, name: str) -> DataFrame:
    """(block, name): each block's answers, one for each of the shards it asked."""
    answers = requests.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_answer, ROUTE_SQL)
    return answers.groupBy("block").agg(F.collect_list(F.struct("shard", "data")).alias(name))


def _as_dict(answers) -> dict[int, bytes]:
    return {a["shard"]: a["data"] for a in answers or ()}


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, shards: int | None = None) -> DataFrame:
    """id, n_words, n_removed, kept_text: each text's words outside repeated windows, joined by one blank.

    A window repeats if its words also start anywhere else, in the same document or another;
    windows are judged on the input. Null text is empty; texts shorter than a window keep all.
    Equal rows repeat one another. Texts are read whole; extra columns are ignored; an empty
    table gives no rows. Windows are told apart by 96 bits of hash. shards: how many parts hashes
    are dealt to; by default one for each SHARD_BYTES of text.
    """
    if window < PERIOD:
        raise ValueError(f"windows of {PERIOD} words at least")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    shards = shards or max(LEAST_SHARDS, -(-text_bytes(rows, "t") // SHARD_BYTES))

    def anchor_requests(batches):
        for batch in batches:
            for block, data in rows_one_by_one(batch):
                for k, asked in _ask_anchors(Passages(_texts(data)[2], window), shards)[1].requests():
                    yield _out(block, k, asked)

    def window_requests(batches):
        for batch in batches:
            for block, data, first in rows_one_by_one(batch):
                for k, asked in _ask_windows(Passages(_texts(data)[2], window), _as_dict(first), shards)[1].requests():
                    yield _out(block, k, asked)

    def removed(batches):
        for batch in batches:
            for data, first, second in rows_one_by_one(batch):
                ids, null, texts = _texts(data)
                passages = Passages(texts, window)
                starts, asked = _ask_windows(passages, _as_dict(first), shards)
                keep = passages.kept(starts[asked.met(_as_dict(second))])
                left = np.concatenate([[0], np.cumsum(keep)])
                n, kept = passages.ends - passages.begins, left[passages.ends] - left[passages.begins]
                out = []
                for words, s, e, k in zip(passages.words, passages.begins.tolist(), passages.ends.tolist(), kept.tolist()):
                    out.append(b" ".join(words if k == e - s else [w for w, x in zip(words, keep[s:e].tolist()) if x]))
                columns = [pa.array(ids, mask=null), pa.array(n), pa.array(n - kept), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept_text"])

    texts = checkpointed(rows.mapInArrow(_blocks, "texts binary").select(F.monotonically_increasing_id().alias("block"), "texts"))
    first = _answered(texts.mapInArrow(anchor_requests, ROUTE_SQL), shards, "first")
    both = texts.hint("merge").join(first, "block", "left").select("block", "texts", "first")
    second = _answered(both.mapInArrow(window_requests, ROUTE_SQL), shards, "second")
    every = texts.hint("merge").join(first, "block", "left").join(second, "block", "left").select("texts", "first", "second")
    out = every.mapInArrow(removed, "id bigint, n_words bigint, n_removed bigint, kept_text string")
    return out.withColumnRenamed("id", id_col)


def kept_digest(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(id_col, "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
