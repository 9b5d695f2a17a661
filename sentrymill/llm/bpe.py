"""BPE encoding and decoding with a contiguous rank array per word.

A word's parts are held as boundaries in one array beside the rank of each adjacent pair. The
smallest rank is found by a scan, its right boundary deleted and the two neighbouring ranks
refreshed, until no pair has a rank. Words are short, so the scan beats a heap; the arrays of
many distinct words are scanned at once. Pieces longer than LONG, such as text without blanks,
take a heap over linked parts, with the same result. Documents are taken in groups of some
megabytes, whose distinct words alone are encoded and held.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import per_row

#: The split pattern of the vocabulary file's pre-tokenizer, and what Unicode's white space is there.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACES = regex.compile(r"\s+")
NONE = 1 << 60
#: A merge is its rank above so many bits of the merged part's id.
ID_BITS = 24
#: Lengths up to which words share arrays; longer ones are merged by a heap.
CLASSES = (8, 12, 16, 24, 32, 64, 128, 256)
#: Characters of the documents whose distinct words are encoded together.
GROUP = 8_000_000


#: Code point ranges that the regex library counts as letters or numbers and the
#: vocabulary's own library (Unicode 16) doesn't, and newer capitals with their small letters.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


#: Where the rules of LATER and SMALL may hold, and what str.split takes for blanks besides them.
LATE = regex.compile("[\u0558-\U0010ffff]")
CONTROLS = frozenset("\x1c\x1d\x1e\x1f")


@functools.cache
def newer() -> tuple:
    """A pattern for LATER, and PIECES with LATER as neither letters nor numbers."""
    left = "[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in LATER) + "]"
    return regex.compile(left), regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|(?:(?!{left})\\p{{L}})+|(?:(?!{left})\\p{{N}})|(?:[^\\s\\p{{L}}\\p{{N}}]|{left})+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible Latin-1, else the next one from 256."""
    out, after = [], 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(after))
            after += 1
    return out


class Numbers(dict):
    """Numbers keys as they come, from 0."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


class Lists:
    """Lists of numbers, end to end: list k is flat[offsets[k]:offsets[k + 1]]."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.offsets = flat, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        self.lengths = np.diff(self.offsets)

    def joined(self, picks: np.ndarray) -> np.ndarray:
        """The lists picked, end to end."""
        n = self.lengths[picks]
        return self.flat[np.repeat(self.offsets[picks] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]

    def split(self) -> list[np.ndarray]:
        return [self.flat[s:e] for s, e in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist())]


class RankArrayBPE:
    """A vocabulary file of the word-end kind: NFC, white space to one blank, lower case."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.end: str = spec["model"]["end_of_word_suffix"] or ""
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        keys = np.array([self.ids[a] << ID_BITS | self.ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        # each pair's key, and its rank above the merged part's id
        self.keys, self.merges = keys[order], np.array([r << ID_BITS | self.ids[a + b] for r, (a, b) in enumerate(pairs)], np.int64)[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.symbols = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        byte = byte_symbols()
        # ids of bytes inside a word and at its end; -1 for those that the vocabulary lacks
        self.inner, self.final = (np.array([self.ids.get(c + end, -1) for c in byte], np.int64) for end in ("", self.end))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each adjacent pair its rank above the merged part's id, or NONE."""
        key = left << ID_BITS | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0) & (left >= 0), self.merges[at], NONE)

    def merged(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of as many rows, parts from the left and -1 beyond: (parts after all merges, their number)."""
        out, rows = parts.copy(), np.arange(len(parts))
        ranks = np.full(parts.shape, NONE)
        ranks[:, :-1] = self.ranks(parts[:, :-1], parts[:, 1:])
        columns = np.arange(parts.shape[1])
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            go = best != NONE
            if not go.all():
                out[rows[~go]] = parts[~go]
                rows, parts, ranks, at, best = rows[go], parts[go], ranks[go], at[go], best[go]
                if not len(rows):
                    break
            # delete the boundary right of the best pair: what lies beyond moves one place to the left
            w, beyond = np.arange(len(rows)), columns > at[:, None]
            moved = np.minimum(columns + beyond, len(columns) - 1)
            last = len(columns) - 1
            parts = np.take_along_axis(parts, moved, 1)
            ranks = np.take_along_axis(ranks, np.minimum(columns + (columns >= at[:, None]), last), 1)
            parts[:, last], ranks[:, last] = -1, NONE
            parts[w, at] = best & (1 << ID_BITS) - 1
            ranks[w, at] = self.ranks(parts[w, at], parts[w, np.minimum(at + 1, last)])
            inner = w[at > 0]
            k = at[inner]
            ranks[inner, k - 1] = self.ranks(parts[inner, k - 1], parts[inner, k])
        return out, (out >= 0).sum(axis=1)

    @functools.cached_property
    def known(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.merges.tolist()))

    def long_word(self, parts: list[int]) -> list[int]:
        """The same merges, the least rank and then the leftmost first, in time n log n."""
        n, known = len(parts), self.known.get
        pair = lambda a, b: known(a << ID_BITS | b, NONE)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        first = self.ranks(np.array(parts[:-1], np.int64), np.array(parts[1:], np.int64))
        heap = [(int(first[k]), k) for k in np.flatnonzero(first != NONE).tolist()]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            right = after[k]
            # stale where a part has gone or another pair stands there now
            if right < 0 or parts[k] < 0 or pair(parts[k], parts[right]) != rank:
                continue
            parts[k], parts[right] = rank & (1 << ID_BITS) - 1, -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
                if (r := pair(parts[k], parts[after[k]])) != NONE:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0 and (r := pair(parts[before[k]], parts[k])) != NONE:
                heapq.heappush(heap, (r, before[k]))
        return [p for p in parts if p >= 0]

    def words(self, pieces: list) -> Lists:
        """ids of distinct pieces; a special token is its id."""
        raw = [p.encode() if isinstance(p, str) else b"" for p in pieces]
        size = np.array([len(x) for x in raw], np.int64)
        ends = np.cumsum(size)
        bytes_at = np.frombuffer(b"".join(raw), np.uint8)
        flat = self.inner[bytes_at]
        flat[ends[size > 0] - 1] = self.final[bytes_at[ends[size > 0] - 1]]
        if (flat < 0).any():  # bytes that the vocabulary lacks are passed over
            size = np.diff(np.concatenate([[0], np.cumsum(flat >= 0)])[np.concatenate([[0], ends])])
            flat = flat[flat >= 0]
            ends = np.cumsum(size)
        starts, lengths, found = ends - size, np.zeros(len(pieces), np.int64), []
        for low, high in zip((0, *CLASSES), CLASSES):
            which = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(which), 50_000):
                some = which[at : at + 50_000]
                place = np.arange(high)
                inside = place < size[some, None]
                parts = np.where(inside, flat[np.minimum(starts[some, None] + place, max(0, len(flat) - 1))], -1)
                done, lengths[some] = self.merged(parts)
                found.append((some, done[done >= 0]))
        for k in np.flatnonzero(size > CLASSES[-1]).tolist():
            ids = self.long_word(flat[starts[k] : ends[k]].tolist())
            lengths[k] = len(ids)
            found.append((np.array([k]), np.array(ids, np.int64)))
        for k, p in enumerate(pieces):
            if not isinstance(p, str):
                lengths[k] = 1
                found.append((np.array([k]), np.array([p], np.int64)))
        order = np.concatenate([np.zeros(0, np.int64), *(some for some, _ in found)])
        by_class = Lists(np.concatenate([np.zeros(0, np.int64), *(ids for _, ids in found)]).astype(np.int32), lengths[order])
        kept = np.flatnonzero(lengths)
        place = np.zeros(len(pieces), np.int64)
        place[order] = np.arange(len(order))
        return Lists(by_class.joined(place[kept]), lengths)

    def chunks(self, text: str):
        """What lies between blanks in text after normalisation; special tokens as their ids."""
        for part in self.split.split(text) if self.split and "<|" in text else (text,):
            if part in self.special:
                yield self.special[part]
            elif part.isascii():
                # str.split takes four control characters for blanks, which the pre-tokenizer doesn't
                yield from part.lower().split() if CONTROLS.isdisjoint(part) else SPACES.split(part.lower())
            else:
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                if LATE.search(plain):
                    plain = plain.translate(SMALL)
                plain = plain.lower()
                yield from plain.split() if CONTROLS.isdisjoint(plain) else SPACES.split(plain)

    def pieces(self, chunk) -> list:
        """Words of a chunk, by the pre-tokenizer's pattern."""
        if isinstance(chunk, int):
            return [chunk]
        if chunk.isascii():
            return [chunk] if chunk.isalpha() else PIECES.findall(chunk)
        if LATE.search(chunk):
            late, exact = newer()
            if late.search(chunk):
                return exact.findall(chunk)
        return PIECES.findall(chunk)

    def group(self, texts: list[str]) -> tuple[list[np.ndarray], Lists]:
        """For each text the numbers of its chunks, and the ids of each distinct chunk."""
        chunks, pieces = Numbers(), Numbers()
        numbers = [np.fromiter(map(chunks.__getitem__, self.chunks(t)), np.int64) for t in texts]
        of = [list(map(pieces.__getitem__, self.pieces(c))) for c in chunks]
        ids = self.words(list(pieces))
        picks = np.fromiter(itertools.chain.from_iterable(of), np.int64)
        per_chunk = np.add.reduceat(np.append(ids.lengths[picks], 0), np.minimum(np.cumsum([0, *map(len, of)])[:-1], len(picks))) if of else np.zeros(0, np.int64)
        per_chunk[np.array([not x for x in of], bool)] = 0
        return numbers, Lists(ids.joined(picks), per_chunk)

    def groups(self, texts: list[str]):
        """group() of texts in groups of some GROUP characters."""
        some, held = [], 0
        for t in texts:
            some.append(t)
            held += len(t)
            if held >= GROUP:
                yield self.group(some)
                some, held = [], 0
        if some:
            yield self.group(some)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [ids.joined(n) for numbers, ids in self.groups(texts) for n in numbers]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        """Symbols joined by blanks: the file names no decoder. Unknown ids are passed over."""
        return " ".join([self.symbols[i] for i in ids if i in self.symbols])

    def digests(self, texts: list[str]):
        """For each text: number of tokens, their ids as decimals, and the decoded text."""
        for numbers, ids in self.groups(texts):
            each = [x.tolist() for x in ids.split()]
            decimal, symbols = [" ".join(map(str, x)) for x in each], [self.decode(x) for x in each]
            for n in numbers:
                n = n[ids.lengths[n] > 0]
                at = n.tolist()
                yield int(ids.lengths[n].sum()), " ".join([decimal[k] for k in at]), " ".join([symbols[k] for k in at])


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> RankArrayBPE:
    return RankArrayBPE(path)


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids (array of int). Null text is empty and has no tokens.

    vocabulary: the file's path, the same on every executor. Each text is read whole; rows map
    one to one, so repeated rows and ids need no rule, and an empty table gives no rows.
    """

    def rows(x):
        bpe = loaded(vocabulary)
        found = bpe.encode_all([t.decode() for t in x[text_col]])
        ends = np.cumsum([0, *map(len, found)])
        flat = np.concatenate([*found, np.zeros(0, np.int32)])
        return {"id": x[id_col], "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))}

    return per_row(docs.select(id_col, text_col), rows, "id bigint, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id, text. Null ids decode to the empty text."""

    def rows(x):
        bpe = loaded(vocabulary)
        return {"id": x[id_col], "text": [bpe.decode(i or ()) for i in x[ids_col]]}

    return per_row(encoded.select(id_col, ids_col), rows, "id bigint, text string").withColumnRenamed("id", id_col)


def bpe_digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens and SHA-256 of its ids and of the decoded text.

    The same words pass through the same encoder and decoder as in bpe_encode and bpe_decode.
    """

    def rows(x):
        bpe = loaded(vocabulary)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        found = [(n, sha(i), sha(d)) for n, i, d in bpe.digests([t.decode() for t in x[text_col]])]
        return {"id": x[id_col], "n_tokens": [n for n, _, _ in found], "ids_sha256": [i for _, i, _ in found], "decoded_sha256": [d for _, _, d in found]}

    return per_row(docs.select(id_col, text_col), rows, "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
