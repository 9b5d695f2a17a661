"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints within two bits (or three) of one another differ by one bit at most in one of their two
halves. Each distinct fingerprint is indexed under both halves with one bit masked, 64 keys
in all; those that share a key are verified by their whole distance. A crowded key is cut
again: of its free half's two quarters, one again differs by one bit at most, and what then
shares a key has 18 free bits, so that all its neighbours can be looked up in a table. Within
a key only links that join its parts are kept, so links stay linear in fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, per_row

#: Keys with more fingerprints than this are cut again; all are still compared.
CROWD = 1024
#: Min-hash bands and minima in each; multipliers are odd.
BANDS, BAND_ROWS = 24, 5
#: Texts and shingles in a block; groups of more are compared block against block, all pairs still.
PAIRED, HELD = 2048, 1 << 20
MULTIPLIERS = np.random.default_rng(42).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed_again(h: np.ndarray, table: int) -> np.ndarray:
    """Another hash of what h hashes, for tables after the first."""
    if not table:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * table & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42, tables: int = 1) -> list[int]:
    """Majority bits of hashes of word shingles, A-Z lower-cased, repeats included; 0 without words.

    The first table's hash is XXH64 itself.
    """
    words = text.lower().split()
    if not words:
        return [0] * tables
    if len(words) < shingle:
        joined, starts, stops = b" ".join(words), [0], [sum(map(len, words)) + len(words) - 1]
    else:
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        starts, stops = np.concatenate([[0], ends[:-shingle]]).tolist(), (ends[shingle - 1 :] - 1).tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros((tables, 64), np.int64)
    for at in range(0, n, 65_536):
        h = np.fromiter((digest(joined[a:z], seed) for a, z in zip(starts[at : at + 65_536], stops[at : at + 65_536])), np.uint64)
        for t in range(tables):
            counts[t] += np.unpackbits(mixed_again(h, t).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits((2 * counts > n).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel().tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, tables: int = 1) -> DataFrame:
    """id, fp and fps: the first table's fingerprint and those of all, as signed longs, of each row's whole text."""

    def rows(x):
        found = np.array([fingerprint(t, shingle, seed, tables) for t in x[text_col]], np.uint64).view(np.int64).reshape(-1, tables)
        return {"id": x[id_col], "fp": found[:, 0], "fps": found.tolist()}

    return per_row(docs.select(id_col, text_col), rows, "id bigint, fp bigint, fps array<bigint>")


def linked(fps: np.ndarray, bits: int = 2) -> list[tuple[int, int]]:
    """Pairs within so many bits that join what is joined at all; fps distinct."""
    n = len(fps)
    if n < 2:
        return []
    if n <= CROWD:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
        if n < 4:
            return [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(near, 1)))]
        look = [lambda labels, near=near: np.where(near, labels[None, :], n).min(axis=1)]
    else:
        varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
        free = [b for b in range(64) if varying >> b & 1]
        code = np.zeros(n, np.int64)
        for k, b in enumerate(free):
            code |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
        table = np.full(1 << len(free), -1, np.int64)
        table[code] = np.arange(n)

        def probe(labels, flip):
            found = table[code ^ flip]
            return np.where(found >= 0, labels[found], n)

        flips = [sum(1 << k for k in some) for n_flipped in range(1, bits + 1) for some in combinations(range(len(free)), n_flipped)]
        look = [lambda labels, flip=flip: probe(labels, flip) for flip in flips]
    labels = np.arange(n)
    while True:
        before = labels
        for of in look:
            labels = np.minimum(labels, of(labels))
        labels = np.minimum(labels, labels[labels])
        if (labels == before).all():
            return [(int(labels[i]), i) for i in range(n) if labels[i] != i]


def _runs(batches, crowd, bits):
    """Links of runs of equal keys in sorted batches; rows of runs over crowd go on with their key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])
    key_at, open_key, held, full = 0, None, [], False

    def out(links, over):
        if links or over:
            a, b, k = [x for x, _ in links] + over, [y for _, y in links] + [0] * len(over), [None] * len(links) + [open_key] * len(over)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.int64())], schema=schema)

    def close():
        if not full and len(held) > 1:
            fps = np.unique(np.array(held, np.int64))
            yield from out([(int(fps[i]), int(fps[j])) for i, j in linked(fps.view(np.uint64), bits)], [])

    for batch in batches:
        keys, fps = batch.column(key_at).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        # runs of one row inside a batch need no look; only those of two or more and the batch's edges do
        busy = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys)))
        for r in busy.tolist():
            s, e = int(starts[r]), int(ends[r])
            if open_key is None or keys[s] != open_key:
                yield from close()
                open_key, held, full = int(keys[s]), [], False
            part = fps[s:e].tolist()
            if full:
                yield from out([], part)
            else:
                held += part
                if crowd and len(held) > crowd:
                    yield from out([], held)
                    held, full = [], True
    yield from close()


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): each half of fp with one of its bits masked."""
    v = fps.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(63))))
    half = F.when(F.col("v") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    bit = F.expr("shiftleft(1L, v % 32)")
    return v.select((F.expr("shiftleft(cast(v as bigint), 32)").bitwiseOR(half.bitwiseAND(F.bitwise_not(bit)))).alias("key"), "fp")


def _quarters(crowded: DataFrame) -> DataFrame:
    """(key, fp) of rows that share a key: the free half's quarters with one bit masked.

    The new key hashes the old one with the variant; a clash only brings together what is then
    verified apart.
    """
    v = crowded.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(31))))
    free = F.when(F.shiftright("key", 32) < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    quarter = F.when(F.col("v") < 16, F.shiftright(free, 16)).otherwise(free.bitwiseAND(F.lit(0xFFFF)))
    masked = quarter.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, v % 16)")))
    return v.select("key", "v", masked.alias("m"), "fp")


def _links_by_key(rows: DataFrame, crowd: int, bits: int) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _runs(batches, crowd, bits), "a bigint, b bigint, key bigint")


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join all within two bits, or three."""
    if bits not in (2, 3):
        raise ValueError("one of two halves differs by one bit at most only up to three bits")
    found = checkpointed(_links_by_key(_variants(fps), CROWD, bits))
    first = found.filter("key is null").select("a", "b")
    crowded = found.filter("key is not null").select("key", F.col("a").alias("fp"))
    if not crowded.isEmpty():
        cut = _quarters(crowded).select(F.xxhash64("key", "v", "m").alias("key"), "fp")
        first = first.unionByName(checkpointed(_links_by_key(cut, 0, bits)).select("a", "b"))
    return first.distinct()


#: Edges (16 bytes each) up to this many are joined up in one task; more take rounds over all executors.
ONE_TASK = 200_000


def _joined(batches):
    """(node, root) of edges (u, v), by union and find."""
    root: dict[int, int] = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): nodes of edges (a, b) with the least node they reach, by alternating stars.

    Where there are no more than ONE_TASK edges, one task joins them, as each round costs
    several shuffles however few rows there are. Otherwise each round ships minima and edges, never a node's list of neighbours, and is written to the
    checkpoint folder; it ends when no edge changes.
    """
    edges = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(_joined, "node bigint, root bigint")
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = checkpointed(small.select(F.col("u"), F.col("m").alias("v")).union(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(now)
    raise RuntimeError(f"components need over {rounds} rounds")


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """Distinct XXH64 of a text's word shingles, sorted; A-Z lower-cased, no words give none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[k : k + shingle]), seed) for k in range(max(1, len(words) - shingle + 1))), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS hashes of BAND_ROWS minima each over the shingles: texts of Jaccard J share a band with probability J ** BAND_ROWS."""
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024, None] * MULTIPLIERS
        low = np.minimum(low, (part ^ (part >> np.uint64(32))).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, BAND_ROWS).T:
        out = mixed_again(out ^ column, 1)
    return out


def shingled(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int, tables: int) -> DataFrame:
    """id, fp, fps, node (a hash of the text's set of shingles), n (their count), bands and h (XXH64 of the text)."""

    def rows(x):
        found = np.array([fingerprint(t, shingle, seed, tables) for t in x["t"]], np.uint64).view(np.int64).reshape(-1, tables)
        sets = [shingle_hashes(t, shingle, seed) for t in x["t"]]
        nodes = [np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64) for s in sets]
        bands = [band_keys(s).view(np.int64).tolist() for s in sets]
        return {"id": x["id"], "h": x["h"], "fp": found[:, 0], "fps": found.tolist(), "node": nodes, "n": [len(s) for s in sets], "bands": bands}

    text = F.coalesce(F.col(text_col), F.lit(""))
    return per_row(docs.select(F.col(id_col).alias("id"), text.alias("t"), F.xxhash64(text).alias("h")), rows, "id bigint, h bigint, fp bigint, fps array<bigint>, node bigint, n bigint, bands array<bigint>")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _merged(of: DataFrame, edges: DataFrame) -> DataFrame:
    """of (node, n, root) with the roots joined that edges (a, b) link."""
    edges = checkpointed(edges.distinct())
    if edges.isEmpty():
        return of
    joined = components(edges).toDF("root", "least")
    return checkpointed(of.join(joined, "root", "left").select("node", "n", F.coalesce("least", "root").alias("root")))


def _similar(of: DataFrame, pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """(a, b): roots of those pairs of nodes whose sets have at least that similarity; pairs of one root need no look."""
    side = lambda x: of.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("root").alias(f"r{x}"))
    open_pairs = _ordered(pairs).join(side("a"), "a").join(side("b"), "b").filter("ra <> rb").filter(F.least("na", "nb") >= jaccard * F.greatest("na", "nb") - 1e-9)
    both = open_pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(shared >= jaccard * (F.col("na") + F.col("nb") - shared) - 1e-9).select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def _links_of(roots: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], jaccard: float) -> list[tuple[int, int]]:
    """Pairs of roots that join what links of at least that similarity join; side 0 is compared with itself, -1 with 1."""
    out, sizes, label = [], np.array([len(s) for s in sets]), np.unique(roots, return_inverse=True)[1]
    for asks, holds in ((0, 0), (-1, 1)):
        asked, held = np.flatnonzero(sides == asks), np.flatnonzero(sides == holds)
        if not len(asked) or not len(held):
            continue
        index, owner = np.concatenate([sets[j] for j in held]), np.repeat(np.arange(len(held)), sizes[held])
        order = np.argsort(index, kind="stable")
        index, owner = index[order], owner[order]
        for i in asked.tolist():
            if (label[held] == label[i]).all():
                continue
            first = np.searchsorted(index, sets[i], "left")
            n = np.searchsorted(index, sets[i], "right") - first
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(held))
            for j in held[(shared >= jaccard * (sizes[i] + sizes[held] - shared) - 1e-9) & (label[held] != label[i])].tolist():
                if label[j] != label[i]:
                    out.append((int(roots[i]), int(roots[j])))
                    label[label == label[j]] = label[i]
    return out


def _compared(batches, jaccard):
    """Links (a, b) of roots in runs of equal parts of sorted batches (part, side, root, s)."""
    open_part, held = None, []

    def close():
        if len(held) > 1:
            roots, sides, sets = zip(*held)
            if links := _links_of(np.array(roots), np.array(sides), list(sets), jaccard):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

    for batch in batches:
        parts, sides, roots = (batch.column(k).to_numpy() for k in range(3))
        values, offsets = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_numpy()
        for r in range(len(parts)):
            if open_part is None or parts[r] != open_part:
                yield from close()
                open_part, held = parts[r], []
            held.append((roots[r], sides[r], values[offsets[r] : offsets[r + 1]]))
    yield from close()


def _within(rows: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """(a, b): links of at least that similarity between the roots of rows (key, node, n, root) of each key, all pairs compared.

    Pairs are made in the tasks and not as rows. A key of more than PAIRED nodes or HELD shingles
    is dealt to blocks; each two of them meet in a part, as does each with itself. Parts are named by
    a hash; a clash only adds comparisons.
    """
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(PAIRED), F.sum("n") / F.lit(HELD))).cast("int")
    split = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), blocks.alias("blocks")).filter("low <> high").select("key", "blocks")
    dealt = rows.join(split, "key").withColumn("at", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.xxhash64("key", F.least("at", "other"), F.greatest("at", "other"))
    parts = dealt.select("node", part.alias("part"), F.signum(F.col("at") - F.col("other")).cast("int").alias("side"), "root")
    shipped = parts.join(sets, "node").select("part", "side", "root", "s").repartition("part").sortWithinPartitions("part")
    return shipped.mapInArrow(lambda batches: _compared(batches, jaccard), "a bigint, b bigint")


def _grouped(rows: DataFrame) -> DataFrame:
    """rows (key, node, ...) of keys with two nodes or more, with their number m and the least of them."""
    return rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("rep")).filter("m > 1"), "key")


def _roots(nodes: DataFrame, near: DataFrame, docs: DataFrame, text_col: str, shingle: int, seed: int, jaccard: float) -> DataFrame:
    """(node, root): components of links of at least that Jaccard similarity; candidates share a band or a component of near, the links by fingerprint.

    Each node is first compared with those it is near and the least one of its fullest group, then
    with that of each group. Of groups, however large, that these have not joined into one
    component, all pairs are compared that are still apart.
    """
    near = checkpointed(near.select("a", "b"))
    bands = nodes.select("node", F.posexplode("bands").alias("k", "band")).select(F.xxhash64("k", "band").alias("key"), "node")
    # links by fingerprint only join what is near; two that are near may not be linked themselves
    keys = bands.unionByName(components(near).select(F.xxhash64(F.lit(-1), "root").alias("key"), "node"))
    shared = checkpointed(_grouped(keys))
    wanted = checkpointed(shared.select("node").distinct().join(nodes.select("node", "n", "h"), "node"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("h"), text.alias("t")).join(wanted.select("h"), "h", "left_semi")
    found = per_row(texts, lambda x: {"h": x["h"], "s": [shingle_hashes(t, shingle, seed).view(np.int64) for t in x["t"]]}, "h bigint, s array<bigint>").dropDuplicates(["h"])
    sets = checkpointed(wanted.select("node", "h").join(found, "h").select("node", "s"))
    of = wanted.select("node", "n", F.col("node").alias("root"))
    star = lambda rows: rows.select(F.col("node").alias("a"), F.col("rep").alias("b"))
    fullest = shared.groupBy("node").agg(F.max_by("rep", F.struct("m", "rep")).alias("rep"))
    of = _merged(of, _similar(of, near.union(star(fullest)), sets, jaccard))
    of = _merged(of, _similar(of, star(shared), sets, jaccard))
    rows = checkpointed(shared.select("key", "node").join(of, "node"))
    return _merged(of, _within(rows, sets, jaccard)).select("node", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, bits: int = 2, tables: int = 1, jaccard: float | None = None) -> DataFrame:
    """id, fp, component_id for each row: the smallest id linked to it through fingerprints at so many bits or fewer.

    With several tables a text has a fingerprint in each, and a link in any table counts: pairs
    that one fingerprint just misses are found by another. Null and blank texts have fingerprint
    zero and link like any other; texts of fewer words than a shingle hash the words they have.
    Repeated rows and ids share a fingerprint and so a component. A null id takes its component's
    id, null only if all there are null. Texts are read whole; extra columns are ignored; an
    empty table gives no rows.

    With jaccard, links are those whose sets of distinct shingles are at least so similar: pairs
    near by fingerprint or equal in one of BANDS min-hash bands are compared exactly (shingles
    by XXH64). A pair at 0.8 shares no band with probability 0.00007.
    """
    if jaccard is None:
        rows = checkpointed(fingerprints(docs, id_col, text_col, shingle, seed, tables))
        # a node for each combination of fingerprints, named by the first table's and a hash of the rest
        rows = rows.withColumn("node", F.col("fp") if tables == 1 else F.xxhash64("fps"))
        nodes = checkpointed(rows.groupBy("node").agg(F.min("id").alias("first"), F.first("fps").alias("fps")))
    else:
        rows = checkpointed(shingled(docs, id_col, text_col, shingle, seed, tables))
        one = F.first(F.struct("fps", "bands", "n", "h")).alias("x")
        nodes = checkpointed(rows.groupBy("node").agg(F.min("id").alias("first"), one).select("node", "first", "x.*"))
        rows = rows.select("id", "fp", "node")
    edges = None
    for t in range(tables):
        of = nodes.select("node", F.get("fps", F.lit(t)).alias("fp"))
        if tables == 1 and jaccard is None:
            edges = links(of.select("fp"), bits)
            break
        least = checkpointed(of.groupBy("fp").agg(F.min("node").alias("rep")))
        same = of.join(least, "fp").filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
        near = links(least.select("fp"), bits)
        near = near.join(least.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(least.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
        found = checkpointed(same.unionByName(near.select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
        edges = found if edges is None else edges.unionByName(found)
    found = components(edges) if jaccard is None else _roots(nodes, edges, docs, text_col, shingle, seed, jaccard)
    rooted = nodes.select("node", "first").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.select("node", "root").join(least, "root").select("node", "component_id")
    return rows.join(of, "node").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component left, that of the smallest id; all columns as they were.

    Rows that repeat that id within its component all stay: they are the caller's exact copies.
    Null and empty texts are near one another. A null id stays only where all its component's
    are null. Extra columns may have any names; an empty table gives no rows.
    """
    kept_id, least = fresh(docs, "kept_id", "least_id")
    found = near_duplicates(docs, id_col, text_col, **options).select(F.col(id_col).alias(kept_id), F.col("component_id").alias(least))
    kept = found.filter(F.col(kept_id).eqNullSafe(F.col(least))).select(kept_id).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
