"""Language-model scores from an Elias-Fano bigram trie, built and asked in shards.

Documents are read once, in blocks of some million tokens, and written as numbers over each
block's own vocabulary. First each block sends its distinct words with their counts in training
documents to shards, and hears the counts of all. Then it sends its distinct word pairs, dealt
by their context, with the counts of both words. A shard sums the pairs, builds its part of the
trie of smoothed probabilities in memory-mapped files and answers by context-relative search.
A context with more than a shard's share of the tokens is split by its successors, into parts
that follow from its count alone. The number of shards follows the bytes of text, so that what
one task holds doesn't grow with the input.

The model: p(w|v) = (c(v w) + MU p1(w)) / (c(v) + MU), with p1(w) = (c(w)+1) / (N + V + 1), a
Dirichlet prior at the unigrams; a text starts after a start mark and ends with an end token.
"""

from __future__ import annotations

import shutil
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, rows_of, rows_one_by_one, text_bytes
from .elias_fano import STEP, Trie
from .langid import fold
from .packing import pack, planes, small, steps, unpack, unplanes, unsteps

MU = 8.0
#: Tokens in a block; documents are never cut.
BLOCK = 1_500_000
#: Bytes of text for each shard of pairs; shards of words are an eighth as many.
SHARD_BYTES, LEAST_SHARDS = 24 << 20, 8
#: A successor is known within its context by so many bits less than 64.
DROPPED = np.uint64(16)
#: Hashes of the start mark and the end token; no word's UTF-8 holds the byte 0xFF.
START, END = xxhash.xxh64_intdigest(b"\xffstart"), xxhash.xxh64_intdigest(b"\xffend")
SCHEMA = "block bigint, shard int, data binary"
ARROW = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("data", pa.binary())])


class Vocabulary(dict):
    """Numbers words as they come; 0 and 1 are the start mark and the end token."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 2
        return number


def _blocks(batches):
    """Packed blocks of documents in batches with columns id, t, train: ids, null flags, lengths, train flags, hashes, tokens."""
    vocabulary, ids, rows, train, held = Vocabulary(), [], [], [], 0

    def done():
        hashes = np.array([START, END, *map(xxhash.xxh64_intdigest, vocabulary)], np.uint64)
        numbers, null = np.array([x if x is not None else 0 for x in rows], np.int64), np.array([x is None for x in rows], bool)
        data = pack(numbers, null, np.array([len(x) for x in ids], np.int64), np.array(train, bool), hashes, planes(np.concatenate(ids)))
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

    for batch in batches:
        for row, text, learn in zip(rows_of(batch, "id"), rows_of(batch, "t"), rows_of(batch, "train")):
            words = text.lower().split()
            tokens = np.ones(len(words) + 1, np.int32)
            tokens[:-1] = list(map(vocabulary.__getitem__, words))
            ids.append(tokens)
            rows.append(row)
            train.append(learn)
            held += len(tokens)
            if held >= BLOCK:
                yield done()
                vocabulary, ids, rows, train, held = Vocabulary(), [], [], [], 0
    if rows:
        yield done()


class Block:
    """Documents as tokens over their vocabulary in order of its hashes, and what they ask of shards."""

    def __init__(self, data: bytes):
        self.rows, self.null, self.lengths, self.train, hashes, tokens = unpack(data)
        order = np.argsort(hashes)
        rank = np.empty(len(hashes), np.int64)
        rank[order] = np.arange(len(hashes))
        self.hashes, self.start, self.ids = hashes[order], int(rank[0]), rank[unplanes(tokens)]
        self.learned = np.repeat(self.train, self.lengths)

    def word_cuts(self, shards: int) -> np.ndarray:
        return np.searchsorted((self.hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))

    def word_requests(self, shards: int):
        """(shard, words and their counts in training documents); the start mark counts once for each document."""
        counts = np.bincount(self.ids[self.learned], minlength=len(self.hashes))
        counts[self.start] = int(self.train.sum())
        cuts = self.word_cuts(shards)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[k], cuts[k + 1])
            yield k, pack(steps(self.hashes[part]), small(counts[part]))

    def hear_words(self, answers: dict[int, bytes], shards: int) -> None:
        """Counts of all training documents for the block's words."""
        cuts, self.counts = self.word_cuts(shards), np.zeros(len(self.hashes), np.int64)
        _complete(answers, np.flatnonzero(np.diff(cuts)))
        for k, data in answers.items():
            self.counts[cuts[k] : cuts[k + 1]] = unpack(data)[0]

    def deal_pairs(self, total: int, shards: int) -> None:
        """Distinct pairs that training documents may hold, in order of shards."""
        n = len(self.hashes)
        before = np.empty(len(self.ids), np.int64)
        before[1:] = self.ids[:-1]
        before[np.concatenate([[0], np.cumsum(self.lengths)[:-1]])] = self.start
        pairs, self.pair_of = np.unique(before * n + self.ids, return_inverse=True)
        self.first, self.second = pairs // n, pairs % n
        asked = np.flatnonzero((self.counts[self.first] > 0) & (self.counts[self.second] > 0))
        # a context is split where it has over half a shard's share of the tokens
        parts = np.clip(-(-2 * shards * self.counts // max(total, 1)), 1, shards).astype(np.uint64)
        home = (self.hashes >> np.uint64(17)) % np.uint64(shards)
        f, s = self.first[asked], self.second[asked]
        shard = (home[f] + (self.hashes[s] >> np.uint64(13)) % parts[f]) % np.uint64(shards)
        shard = shard.astype(np.uint16 if shards < 1 << 16 else np.uint32)  # small integers sort by radix
        self.order = asked[np.argsort(shard, kind="stable")]
        self.cuts = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])

    def pair_requests(self):
        """(shard, contexts with counts, successors with counts, pairs by both's places with counts in training documents)."""
        times, place = np.bincount(self.pair_of[self.learned], minlength=len(self.first)), np.zeros(len(self.hashes), np.int64)
        for k in np.flatnonzero(np.diff(self.cuts)).tolist():
            p = self.order[self.cuts[k] : self.cuts[k + 1]]
            first, second = self.first[p], self.second[p]
            new = np.concatenate([[True], first[1:] != first[:-1]])
            contexts, words = first[new], np.flatnonzero(np.bincount(second, minlength=len(self.hashes)))
            place[words] = np.arange(len(words))
            yield k, pack(steps(self.hashes[contexts]), small(self.counts[contexts]), np.packbits(new), steps(self.hashes[words] >> DROPPED), small(self.counts[words]), small(place[second]), small(times[p]))

    def scores(self, answers: dict[int, bytes], total: int, distinct: int):
        """For each document: known tokens, base score and the model's score."""
        codes = np.zeros(len(self.first), np.uint16)
        _complete(answers, np.flatnonzero(np.diff(self.cuts)))
        for k, data in answers.items():
            codes[self.order[self.cuts[k] : self.cuts[k + 1]]] = unpack(data)[0]
        alone = (self.counts + 1) / (total + distinct + 1)
        unseen = np.log10(MU * alone[self.second] / (self.counts[self.first] + MU))
        follows = np.where(codes > 0, codes * STEP - 16, unseen)
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        per = lambda x: np.bincount(doc, x, len(self.lengths))
        return per(self.counts[self.ids] > 0).astype(np.int64), per(np.log10(alone)[self.ids]), per(follows[self.pair_of])


def _complete(answers: dict[int, bytes], asked: np.ndarray) -> None:
    if sorted(answers) != asked.tolist():
        raise RuntimeError("a block has not heard from every shard that it asked")


def _out(block: int, shard: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([data], pa.binary())], schema=ARROW)


def _by_shard(batches, answer):
    """answer(shard, [(block, arrays)]) for each run of rows of one shard."""
    name, held = None, []
    for batch in batches:
        for b, k, data in rows_one_by_one(batch):
            if k != name and held:
                yield from answer(name, [(b2, unpack(d)) for b2, d in held])
                held = []
            name = k
            held.append((b, data))
    if held:
        yield from answer(name, [(b, unpack(d)) for b, d in held])


def _count_words(name, parts):
    """Each block's words with the counts of all; tokens and distinct words of the shard go out as shards -2 and -3."""
    hashes = [unsteps(p[0]) for _, p in parts]
    words, at = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.bincount(at, np.concatenate([p[1] for _, p in parts]).astype(np.float64), len(words)).astype(np.int64)
    tokens = counts[words != np.uint64(START)]
    yield _out(int(tokens.sum()), -2, b"")
    yield _out(int((tokens > 0).sum()), -3, b"")
    for (b, _), cut in zip(parts, np.split(at, np.cumsum([len(h) for h in hashes])[:-1])):
        yield _out(b, name, pack(small(counts[cut])))


def _probabilities(name, parts, total: int, distinct: int):
    """Codes of each block's pairs, from a trie of those that training documents hold."""
    contexts_of, words_of = [unsteps(p[0]) for _, p in parts], [unsteps(p[3]) for _, p in parts]
    contexts, words = np.unique(np.concatenate(contexts_of)), np.unique(np.concatenate(words_of))
    context_counts, word_counts, keys = np.zeros(len(contexts)), np.zeros(len(words)), []
    places = [np.cumsum(np.unpackbits(p[2], count=len(p[5])), dtype=np.int32) - 1 for _, p in parts]
    for (_, p), c, w, i in zip(parts, contexts_of, words_of, places):
        c, w = np.searchsorted(contexts, c), np.searchsorted(words, w)
        context_counts[c], word_counts[w] = p[1], p[4]
        learned = p[6] > 0
        keys.append(c[i[learned]] * len(words) + w[p[5][learned]])
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    times = np.bincount(at, np.concatenate([p[6][p[6] > 0] for _, p in parts]).astype(np.float64), len(key))
    first, second = key // max(len(words), 1), key % max(len(words), 1)
    probability = (times + MU * (word_counts[second] + 1) / (total + distinct + 1)) / (context_counts[first] + MU)
    folder = tempfile.mkdtemp(prefix="trie-")
    try:
        trie = Trie(folder, contexts[first], words[second], probability)
    finally:
        shutil.rmtree(folder, ignore_errors=True)  # the maps stay; nothing is left if the worker dies
    del key, at, times, first, second, probability
    for (b, p), c, w, i in zip(parts, contexts_of, words_of, places):
        yield _out(b, name, pack(trie.look_up(c, i, w, p[5])))


def _answered(requests: DataFrame, shards: int, answer) -> DataFrame:
    return requests.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(lambda batches: _by_shard(batches, answer), SCHEMA)


def _per_block(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("block").agg(F.collect_list(F.struct("shard", "data")).alias(name))


def _as_dict(answers) -> dict[int, bytes]:
    return {a["shard"]: a["data"] for a in answers or ()}


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held: int = 2, shards: int | None = None) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row, by its whole text.

    The model learns from rows whose crc32 of the id as text, modulo parts, isn't held; a null
    id is held out. Null text is empty: it has the end token alone. Repeated rows count each
    time and get equal scores. Extra columns are ignored; an empty table gives no rows. shards:
    how many parts the pairs and the trie are dealt to; by default one for each SHARD_BYTES of text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.coalesce(fold(id_col, parts) != held, F.lit(False)).alias("train"))
    shards = shards or max(LEAST_SHARDS, -(-text_bytes(rows, "t") // SHARD_BYTES))
    word_shards = max(2, shards // 8)
    blocks = checkpointed(rows.mapInArrow(_blocks, "data binary").select(F.monotonically_increasing_id().alias("block"), "data"))

    def ask_words(batches):
        for batch in batches:
            for b, data in rows_one_by_one(batch):
                for k, request in Block(data).word_requests(word_shards):
                    yield _out(b, k, request)

    counted = checkpointed(_answered(blocks.mapInArrow(ask_words, SCHEMA), word_shards, _count_words))
    sums = counted.filter("shard < 0").groupBy("shard").agg(F.sum("block").alias("n")).collect()
    total, distinct = (next((int(r["n"]) for r in sums if r["shard"] == k), 0) for k in (-2, -3))

    def with_pairs(data, words) -> Block:
        block = Block(data)
        block.hear_words(_as_dict(words), word_shards)
        block.deal_pairs(total, shards)
        return block

    def ask_pairs(batches):
        for batch in batches:
            for b, data, words in rows_one_by_one(batch):
                for k, request in with_pairs(data, words).pair_requests():
                    yield _out(b, k, request)

    def score(batches):
        for batch in batches:
            for data, words, pairs in rows_one_by_one(batch):
                block = with_pairs(data, words)
                known, base, found = block.scores(_as_dict(pairs), total, distinct)
                columns = [pa.array(block.rows, mask=block.null), pa.array(~block.train), pa.array(block.lengths), pa.array(known), pa.array(np.full(len(known), total, np.int64)), pa.array(base), pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    heard = blocks.hint("merge").join(_per_block(counted.filter("shard >= 0"), "words"), "block", "left").select("block", "data", "words")
    coded = _answered(heard.mapInArrow(ask_pairs, SCHEMA), shards, lambda name, parts: _probabilities(name, parts, total, distinct))
    every = heard.join(_per_block(coded, "pairs"), "block", "left").select("data", "words", "pairs")
    out = every.mapInArrow(score, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
