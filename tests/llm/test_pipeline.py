"""The pipeline's stages against what each must keep, and the oracles of the folder's queries."""

import collections
import random
import re

import duckdb
import pytest

import corpus_pipeline
from sentrymill.llm import queries

SF = "/root/testdata/sf0.001"


def test_op1_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        got = con.execute(sql)
        order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
        theirs = [c[0] for c in got.description]
        assert sorted(theirs) == sorted(df.columns)
        pick = sorted(range(len(theirs)), key=lambda i: theirs[i])
        assert sorted(tuple(r[i] for i in order) for r in df.collect()) == sorted(tuple(r[i] for i in pick) for r in got.fetchall())


def test_stages(spark, tmp_path):
    r = random.Random(2)
    text = lambda n: " ".join("".join(r.choice("aeinorst") for _ in range(6)) for _ in range(n))
    rows = [(i, text(200), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[0][1].upper(), "en", "s0", 0), (101, "12 !! 34", "en", "s0", 0), (102, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs, before = spark.read.parquet(path), docs
        seen[name] = [x["doc_id"] for x in docs.select("doc_id").collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    assert sorted(seen["language_id"]) == [*range(60), 100]
    assert sorted(seen["exact_dedup"]) == list(range(60))
    assert sorted(seen["simhash_dedup"]) == list(range(60))
    assert 60 <= len(seen["mix_sources"]) <= 120 and set(seen["mix_sources"]) <= set(range(60))
    assert sorted(seen["bpe_encode"]) == sorted(seen["mix_sources"])


def test_run_by_brute_force(spark):
    """run() over a whole small table against plain Python: who stays at each stage, the mix's totals, the library's ids."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    table = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    scores = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op10_language_id(spark, SF).collect()}
    docs = [(d, t, s) for d, t, s in table if scores[d][0] != "und" and (scores[d][1] >= 0.45 or sum(map(str.isalpha, t)) < 200)]
    first = {}
    for d, t, s in sorted(docs):
        first.setdefault(t.translate(low), (d, t, s))
    docs = list(first.values())
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t, _ in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    docs = [docs[min((docs[k][0], k) for k in range(len(docs)) if root[k] == x)[1]] for x in sorted(set(root))]
    by, sizes, names = {d: (t, s) for d, t, s in docs}, collections.Counter(), sorted({s for *_, s in docs})
    for _, t, s in docs:
        sizes[s] += len(words(t))
    target, goal = collections.Counter(), 1.5 * sum(sizes.values())
    for _ in range(60):
        free, left = [k for k, s in enumerate(names) if target[s] < 2 * sizes[s] - 1e-9], goal - sum(target.values())
        for k in free:
            target[names[k]] = min(2 * sizes[names[k]], target[names[k]] + left * (3, 1, 2)[k % 3] / sum((3, 1, 2)[x % 3] for x in free))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} <= set(by) and max(collections.Counter(r["doc_id"] for r in got).values()) <= 2
    taken = collections.Counter()
    for r in got:
        taken[by[r["doc_id"]][1]] += len(words(by[r["doc_id"]][0]))
    for s in names:
        assert abs(taken[s] - target[s]) <= max(len(words(t)) for _, t, x in docs if x == s)
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    library.no_truncation()
    for r in got:
        assert r["ids"] == library.encode(by[r["doc_id"]][0], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_queries_give_a_row_per_document(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
