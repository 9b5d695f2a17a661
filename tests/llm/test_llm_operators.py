"""The training-data operators against brute force, and on the cases their docstrings define."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sentrymill.llm import bpe, elias_fano, exact_dedup, langid, licences, lm_score, mixing, pii, quality, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = "the of and to in is that for with on as by this are".split()


def prose(r, n):
    return " ".join(r.choice(COMMON) if r.random() < 0.4 else "".join(r.choice("aeinorst") for _ in range(r.randrange(3, 9))) for _ in range(n))


def corpus(seed=3, n=60):
    r = random.Random(seed)
    texts = [prose(r, r.randrange(5, 160)) for _ in range(n)]
    shared = prose(r, 60)
    texts += [texts[0], texts[0].upper(), texts[1] + " x", shared + " " + prose(r, 20), prose(r, 30) + "\n" + shared, None, "", "  \t\n", "a", "a b", "Ünïcödé ΣΑΣ naïve", "one two three four five " * 40]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["s1", "s2", "s2", "s2", None]), 0) for i, t in enumerate(texts)]
    rows += [rows[2], (None, "no id here at all", "en", "s1", 0)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(docs, rows, keep):
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").translate(LOW)].append(d)
    best = lambda ids: (max if keep == "max" else min)([i for i in ids if i is not None], default=None)
    got = exact_dedup.exact_dedup(docs, keep=keep).collect()
    assert len(got) == len(rows)
    text = {d: (t or "").translate(LOW) for d, t, *_ in rows}
    for r in got:
        t = text[r["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (best(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest())
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    left = exact_dedup.drop_copies(docs, keep=keep)
    assert left.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in left.collect()))) == sorted(map(str, (best(ids) for ids in groups.values())))


def brute_quality(t):
    w, lines = words(t), [x for x in (t or "").split("\n") if WORD.search(x)]
    c = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, rows):
    text = {d: t for d, t, *_ in rows}
    for r in quality.quality_rules(docs).collect():
        n, chars, symbols, dup, rep = brute_quality(text[r["doc_id"]])
        assert tuple(r[1:6]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_quality_divergence(spark):
    r = random.Random(1)
    clean = [(i, ". ".join(prose(r, 12).capitalize() for _ in range(10)) + ".", "en", "s", 0) for i in range(40)]
    junk = [(100 + i, " ".join("$$$ %%% &&& ***".split()[k % 4] + w for k, w in enumerate(prose(r, 100).split())), "en", "s", 0) for i in range(3)]
    got = {x["doc_id"]: x["kept"] for x in quality.quality_rules(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert all(got[i] for i in range(40)) and not any(got[100 + i] for i in range(3))


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights, goal = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values())
    target = {s: 0.0 for s in names}
    for _ in range(50):  # share by weight, cap, share the excess again
        left, free = goal - sum(target.values()), [s for s in names if target[s] < 2 * sizes[s] - 1e-9]
        if left < 1e-9 or not free:
            break
        for s in free:
            target[s] = min(2 * sizes[s], target[s] + left * weights[s] / sum(weights[x] for x in free))
    taken = collections.defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] <= 2 * r["size"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(len(words(t)) for _, t, _, x, _ in rows if x == s)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_tree_levels(docs):
    """Small buckets and fan-in force several levels; totals hold all the same."""
    got = mixing.mix(docs, bucket_rows=3, fan_in=2).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("size").alias("m")).collect()
    assert all(abs(r["t"] - r["g"]) <= r["m"] for r in got)


def test_rounding_keeps_expectations():
    size, share = np.array([5.0, 9.0, 3.0, 7.0, 1.0]), np.array([0.3, 0.6, 0.5, 0.2, 0.9])
    mean = np.mean([mixing.round_group(0, size, share, np.random.default_rng(k), True) for k in range(4000)], axis=0)
    assert np.abs(mean - share).max() < 0.04


def brute_fp(t):
    w = words((t or "").translate(LOW))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[i : i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else [w])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, rows):
    fps = {d: brute_fp(t) for d, t, *_ in rows}
    ids = sorted(i for i in fps if i is not None)
    comp = dict(zip(ids, (ids[k] for k in brute_components([fps[i] for i in ids], 2))))
    for r in simhash.near_duplicates(docs).collect():
        assert r["fp"] & (2**64 - 1) == fps[r["doc_id"]]
        if r["doc_id"] is not None:
            assert r["component_id"] == comp[r["doc_id"]]


def test_several_tables(docs, rows):
    """Components of links in any table, by brute force."""
    ids = sorted(d for d, *_ in rows if d is not None)
    text = {d: t for d, t, *_ in rows}
    fps = {d: simhash.fingerprint((text[d] or "").encode(), 5, 42, 3) for d in ids}
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any((x ^ y).bit_count() <= 3 for x, y in zip(fps[a], fps[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for r in simhash.near_duplicates(docs, shingle=5, bits=3, tables=3).collect():
        if r["doc_id"] is not None:
            assert r["component_id"] == find(r["doc_id"])


@pytest.mark.parametrize("bits, one_task", [(2, 200_000), (3, 0)])
def test_links_of_chains_and_crowds(spark, monkeypatch, bits, one_task):
    monkeypatch.setattr(simhash, "CROWD", 8)
    monkeypatch.setattr(simhash, "ONE_TASK", one_task)
    r, fps = random.Random(bits), set()
    base = r.getrandbits(64)
    for _ in range(40):  # a crowd that shares a half, chains that drift, strangers
        fps.add(base ^ sum(1 << b for b in r.sample(range(32), 3)))
    x = r.getrandbits(64)
    for _ in range(30):
        x ^= 1 << r.randrange(64) | 1 << r.randrange(64)
        fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(30)}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, bits)).collect()}
    got = [found.get(int(np.uint64(f).view(np.int64)), int(np.uint64(f).view(np.int64))) for f in fps]
    want = brute_components(fps, bits)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_simhash_finds_all_at_jaccard(spark, monkeypatch):
    r, texts = random.Random(11), []
    for i in range(60):
        w = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(60, 300))]
        texts.append(" ".join(w))
        for k in r.sample(range(1, 9), 3):
            v = list(w)
            for at in r.sample(range(len(v)), k):
                v[at] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(v))
    texts += [" ".join(f"c{k}" if k % 50 != i % 50 else f"y{i}" for k in range(200)) for i in range(50)] + ["a b", "a b", None, ""]
    sets = [{tuple((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} if t else set() for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for paired in (32, 3):
        monkeypatch.setattr(simhash, "PAIRED", paired)
        got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(df, shingle=5, bits=3, tables=4, jaccard=0.8).collect()}
        assert [got[i] for i in range(len(texts))] == root


def brute_pii(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]


def test_pii_base():
    r = random.Random(5)
    for _ in range(3000):
        x = "".join(r.choice(["a", "@", ".", "1", "2", "255", "256", " ", "-", "+", "(", ")", "%", "b.c", "é", "4111111111111111"]) for _ in range(r.randrange(1, 40)))
        assert sorted(pii.identifiers(x)) == sorted(brute_pii(x))
        base, spans = pii.find(x)
        assert set(base) <= set(spans)


@pytest.mark.parametrize(
    "text, span",
    [
        ("ask bob.7 [at] mail9 [dot] example [dot] com today", ("email", "bob.7 [at] mail9 [dot] example [dot] com")),
        ("write to bob at example dot com please", ("email", "bob at example dot com")),
        ("jоhn@exаmple.com", ("email", "jоhn@exаmple.com")),
        ("call plus one five zero nine five five five six nine seven three", ("phone", "plus one five zero nine five five five six nine seven three")),
        ("１９２.１６８.１.２ up", ("ip", "１９２.１６８.１.２")),
        ("4​111 1111 1111 1111", ("card", "4​111 1111 1111 1111")),
    ],
)
def test_pii_disguises(text, span):
    base, spans = pii.find(text)
    assert base == [] and [(k, text[s:e]) for k, s, e in spans] == [span]


@pytest.mark.parametrize(
    "text, span",
    [
        ("host one nine two point one six eight point one point one up", ("ip", "one nine two point one six eight point one point one")),
        ("host one zero point zero point zero point one up", ("ip", "one zero point zero point zero point one")),
    ],
)
def test_pii_spelled_points(text, span):
    assert [(k, text[s:e]) for k, s, e in pii.find(text)[1]] == [span]


def test_pii_hints_cover_transducers():
    r, parts = random.Random(8), ["one", "zero", "dot", "point", "plus", "at", "_at_", "-at-", "@", ".", "[", "]", "(at)", "a1", "x.y", "example", "com", "192", "10", "O", "l", "-", ",", "_"]
    hit = 0
    for _ in range(60_000):
        x = "".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randrange(3, 12)))
        tape = pii.Tape(x)
        pii.fold_digits(tape)
        pii.fold_addresses(tape)
        if tape.text != x:
            hit += 1
            assert pii.HINTS.search(x), x
    assert hit > 1000


@pytest.mark.parametrize(
    "text, span",
    [
        ("see 192 dot 168 dot 1 dot 10 now", ("ip", "192 dot 168 dot 1 dot 10")),
        ("to john.smith_at_example.com now", ("email", "john.smith_at_example.com")),
        ("to john.smith-at-example.com now", ("email", "john.smith-at-example.com")),
        ("to bob@a dot b dot c dot d dot e dot f dot com, now", ("email", "bob@a dot b dot c dot d dot e dot f dot com")),
    ],
)
def test_pii_written_dots_and_joined_at(text, span):
    assert [(k, text[s:e]) for k, s, e in pii.find(text)[1]] == [span]


def test_pii_leaves_prose(rows):
    for t in ["look at example.com and at the dot", "one of the two or three at on", *(t for _, t, *_ in rows if t)]:
        assert pii.find(t)[1] == brute_pii(t)


def test_pii_rows(docs, rows):
    got = pii.pii_spans(docs).collect()
    assert len(got) == len(rows) and all(r["base"] == r["spans"] == [] for r in got)


def test_lm_score(docs, rows):
    toks = [(d, words((t or "").translate(LOW)) + [None]) for d, t, *_ in rows]
    train = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 != 2
    c, p, starts = collections.Counter(), collections.Counter(), 0
    for d, w in toks:
        if train(d):
            c.update(w)
            p.update(zip([0, *w], w))
            starts += 1
    n, v = sum(c.values()), len(c)
    c1 = lambda w: starts if w == 0 else c[w]
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    want = {(d, len(w)): (sum(map(math.log10, map(p1, w))), sum(math.log10((p[a, b] + lm_score.MU * p1(b)) / (c1(a) + lm_score.MU)) for a, b in zip([0, *w], w)), sum(c[x] > 0 for x in w)) for d, w in toks}
    got = lm_score.lm_score(docs, shards=5).collect()
    assert len(got) == len(rows)
    for r in got:
        base, score, known = want[r["doc_id"], r["n_tokens"]]
        assert r["held_out"] == (not train(r["doc_id"])) and r["train_tokens"] == n and r["n_known"] == known
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["score"] == pytest.approx(score, abs=3e-4 * r["n_tokens"])


def test_equal_blocks(spark):
    """Partitions of equal rows make blocks that share an id; none is lost."""
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text)] * 3, "doc_id long, text string").repartition(3)
    assert lm_score.lm_score(docs, shards=2).count() == 3
    assert [(r["n_words"], r["n_removed"]) for r in substring_dedup.remove_passages(docs, shards=2).collect()] == [(50, 50)] * 3


@pytest.mark.parametrize("values", [[0], [5], [0, 0, 0, 7, 7, 900], list(range(300)), sorted(random.Random(2).choices(range(1 << 60), k=700)), [(1 << 64) - 1]])
def test_elias_fano(tmp_path, values):
    a = np.array(values, np.uint64)
    ef = elias_fano.EliasFano(str(tmp_path), "x", a)
    assert (ef.get(np.arange(len(a))) == a).all()
    ask = np.array(sorted({*values, *(max(0, v - 1) for v in values), *(min((1 << 64) - 1, v + 1) for v in values)}), np.uint64)
    at, same = ef.successor(ask)
    assert (at == np.searchsorted(a, ask)).all() and (same == np.isin(ask, a)).all()


def test_difference_cover():
    d = substring_dedup.COVER
    assert {(a - b) % substring_dedup.PERIOD for a in d for b in d} == set(range(substring_dedup.PERIOD))


@pytest.mark.parametrize("window", [21, 35])
def test_substring_dedup(docs, rows, window):
    all_words = [words(t) for _, t, *_ in rows]
    c = collections.Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    want = collections.Counter()
    for (d, *_), w in zip(rows, all_words):
        gone = {i + k for i in range(len(w) - window + 1) if c[tuple(w[i : i + window])] > 1 for k in range(window)}
        want[d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    got = collections.Counter(tuple(r) for r in substring_dedup.remove_passages(docs, window=window).collect())
    assert got == want and sum(n[2] for n in got) > 0


def test_bpe_matches_library(spark, docs, rows):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    library, own = tokenizers.Tokenizer.from_file(path), bpe.loaded(path)
    r = random.Random(4)
    odd = ["Hello   wORLD's <|endoftext|>x Σας İ ﬁ 12345 ... é́ 😀 \x00 a<|STARTOFTEXT|>", "I'LL 'S 'Re ²½ Ⅷ ٣ ＡＢＣ", "x" * 500]
    odd += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x500), r.randrange(0x3040, 0x9FFF)])) for _ in range(50)) for _ in range(300)]
    for t in odd + [t or "" for _, t, *_ in rows]:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)
    encoded = bpe.bpe_encode(docs, path)
    digest = {(r["doc_id"], r["ids_sha256"]): r["n_tokens"] for r in bpe.bpe_digest(docs, path).collect()}
    for r in encoded.collect():
        assert digest[r["doc_id"], hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()] == len(r["ids"])
    assert bpe.bpe_decode(encoded, path).count() == len(rows)


LETTERS = {"en": "the of and to in is that thing with", "fr": "le la les des une qui pour dans eau que", "de": "der die und das mit ein ich nicht sch ung"}


def test_language_id_held_out(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(LETTERS[k].split()) + r.choice(["", "", r.choice(LETTERS[k].split())]) for _ in range(30)), k, "s", 0) for i in range(150) for k in [list(LETTERS)[i % 3]]]
    rows += [(1000, None, "en", "s", 0), (1001, "12 34 !!", None, "s", 0), (1002, "", "fr", "s", 0)]
    got = {x["doc_id"]: x for x in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = [i for i in range(150) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i]["held_out"] for i in held)
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.95 * len(held)
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert all(0 <= x["score"] <= 1 for x in got.values())


def test_licences_inherit(spark):
    mit = licences.TEMPLATES["MIT"][3]
    files = [
        (1, mit, "repo/LICENSE"), (2, "plain words only", "repo/src/a.py"), (3, "Licensed under the Apache License, Version 2.0.\n" + "code line\n" * 40, "repo/src/b.py"),
        (4, licences.TEMPLATES["GPL-3.0"][0], "repo/src/deep/COPYING"), (5, None, "repo/src/deep/x/y.c"), (6, "nothing", "other/z.c"), (7, "Licensed under CC BY-NC 4.0.", "other/sub/n.txt"),
    ]
    df = spark.createDataFrame(files, "doc_id int, text string, path string")
    got = {r["doc_id"]: (r["own"], r["licence"], r["licence_from"]) for r in licences.inherited(licences.scan(df)).collect()}
    assert got[1][0] == "MIT" and got[2] == (None, "MIT", "repo") and got[3][:2] == ("Apache-2.0", "Apache-2.0")
    assert got[5] == (None, "GPL-3.0", "repo/src/deep") and got[6] == (None, None, None) and got[7][0] == "CC-BY-NC-4.0"


def test_licences_in_running_text(spark):
    r, notices = random.Random(4), [(n, t) for n, texts in licences.TEMPLATES.items() for t in texts]
    files = [(i, f"{prose(r, 100)} {t} {prose(r, 100)}", "x/y.txt") for i, (_, t) in enumerate(notices)] + [(i + 500, f"{prose(r, 100)} {t}", "x/z.txt") for i, (_, t) in enumerate(notices)]
    files += [(900, prose(r, 100) + " the licence fee under the old law " + prose(r, 100), "x/n.txt"), (901, prose(r, 60) + " Copyright 2024 Foo. All rights reserved. Released under the ISC License. " + prose(r, 60), "x/m.txt")]
    got = {x["doc_id"]: x["own"] for x in licences.scan(spark.createDataFrame(files, "doc_id int, text string, path string")).collect()}
    assert [(n, got[i], got[i + 500]) for i, (n, _) in enumerate(notices)] == [(n, n, n) for n, _ in notices]
    assert got[900] is None and got[901] == "ISC"


def test_licence_scores_hold_when_the_corpus_is_repeated():
    line = b"Copyright (c) 2024 Foo Bar Inc. Released, as ever, under the MIT licence and the License terms."
    df = {"the": 900, "under": 300, "license": 40, "released": 30, "mit": 2}
    once, again = (licences.Matcher(1000 * k, {t: c * k for t, c in df.items()}).scan(line) for k in (1, 3000))
    assert once == again and once[1] > 0


def test_empty_tables(spark, empty, tmp_path):
    frames = [
        exact_dedup.exact_dedup(empty), exact_dedup.drop_copies(empty), quality.quality_rules(empty), mixing.mix(empty), mixing.mixed(empty), simhash.near_duplicates(empty),
        simhash.drop_near_duplicates(empty), pii.pii_spans(empty), lm_score.lm_score(empty), substring_dedup.remove_passages(empty), langid.identify(empty), langid.keep_identified(empty),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_extra_columns_with_clashing_names(spark, docs, rows):
    odd = docs.withColumns({c: F.lit("x") for c in ("id", "t", "h", "s", "n", "rk", "fp", "block", "key", "bucket", "size", "target", "w", "lines", "p")})
    assert exact_dedup.exact_dedup(odd).count() == len(rows)
    assert mixing.mix(odd).count() == len(rows) and simhash.near_duplicates(odd).count() == len(rows)
    assert lm_score.lm_score(odd).count() == len(rows) and substring_dedup.remove_passages(odd).count() == len(rows)
    assert quality.quality_rules(odd).count() == len(rows) and langid.identify(odd).count() == len(rows)
    assert set(exact_dedup.drop_copies(odd).columns) == set(odd.columns) == set(mixing.mixed(odd).columns)


def test_no_pair_of_a_crowd_is_skipped(spark):
    """Of 99 texts in one band and one in none, those linked are joined: two far from the band's least, two that are near by fingerprint through a third that is not like them."""
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(100)]
    texts[70], texts[97] = texts[40] + " more", texts[95] + " more"
    nodes = [(i, 56 + (i in (70, 97)), [0 if i < 95 else i], list(range(8 * i, 8 * i + 8))) for i in range(100)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    frame = spark.createDataFrame([(*x, t) for x, t in zip(nodes, texts)], "node long, n long, bands array<long>, deep array<long>, text string").withColumn("h", F.xxhash64("text")).drop("text")
    near = spark.createDataFrame([(95, 96), (96, 97)], "a long, b long")
    got = {x["node"]: x["root"] for x in simhash._roots(frame, near, docs, "text", 5, 42, 0.8).collect()}
    assert {n: k for n, k in got.items() if n != k} == {70: 40, 97: 95}


def test_blocks_compare_all_pairs(spark, monkeypatch):
    """Links between the roots of one key by brute force, whatever the blocks."""
    r, sets, root = random.Random(6), [], list(range(90))
    for i in range(90):
        sets.append(sorted(r.sample(range(100), 80)) if i % 3 else sorted({*r.sample(range(100), 50), *range(200, 210 + i)}))
    for i in range(90):
        for j in range(i):
            if len(set(sets[i]) & set(sets[j])) >= 0.72 * len(set(sets[i]) | set(sets[j])):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    rows = spark.createDataFrame([(7, i, len(s), i) for i, s in enumerate(sets)], "key long, node long, n long, root long")
    held = spark.createDataFrame(list(enumerate(sets)), "node long, s array<long>")
    assert 1 < len(set(root)) < 80
    for paired, most in ((2048, 1 << 20), (7, 1 << 20), (2048, 500)):
        monkeypatch.setattr(simhash, "PAIRED", paired)
        monkeypatch.setattr(simhash, "HELD", most)
        edges = simhash._within(rows, held, 0.72)
        got = {x["node"]: x["root"] for x in simhash.components(edges).collect()}
        assert [got.get(i, i) for i in range(90)] == root
