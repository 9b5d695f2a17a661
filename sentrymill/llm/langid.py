"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds its letters' vectors,
permuted by place; a text's vector bundles (adds) those of its trigrams; a language's
prototype bundles the vectors of its texts. A text's language is that of the prototype with
the largest cosine.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row

#: Trigram vectors kept in a worker's memory (a byte for each dimension).
KEPT = 20_000
BLOCK = 64
UNKNOWN = "und"


@functools.lru_cache(maxsize=4096)
def letter_vector(code: int, dims: int, seed: int) -> np.ndarray:
    return (np.random.default_rng([seed, code]).integers(0, 2, dims, dtype=np.int8) * 2 - 1).astype(np.int8)


@functools.cache
def _space() -> np.ndarray:
    """For each code point: 1 if it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Trigrams:
    """Vectors of trigrams met, up to KEPT of them; others are made anew each time."""

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed = dims, seed
        self.row: dict[int, int] = {}
        self.kept = np.empty((0, dims), np.int8)

    def vector(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        of = lambda x: letter_vector(x, self.dims, self.seed)
        return np.roll(of(a), 2) * np.roll(of(b), 1) * of(c)

    def matrix(self, keys: np.ndarray) -> np.ndarray:
        wanted = keys.tolist()
        new = [k for k in wanted if k not in self.row][: KEPT - len(self.row)]
        if new:
            start = len(self.row)
            if start + len(new) > len(self.kept):
                grown = np.empty((min(KEPT, max(1024, 2 * len(self.kept), start + len(new))), self.dims), np.int8)
                grown[:start] = self.kept[:start]
                self.kept = grown
            for i, k in enumerate(new):
                self.kept[start + i] = self.vector(k)
                self.row[k] = start + i
        at = np.array([self.row.get(k, -1) for k in wanted], np.int64)
        out = self.kept[np.maximum(at, 0)].astype(np.float32) if len(self.kept) else np.zeros((len(at), self.dims), np.float32)
        for i in np.flatnonzero(at < 0):
            out[i] = self.vector(wanted[i])
        return out


@functools.lru_cache(maxsize=2)
def trigrams(dims: int, seed: int) -> Trigrams:
    return Trigrams(dims, seed)


def trigram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the lower-cased letters, other runs as one blank, and their counts."""
    codes = np.frombuffer(text.decode().lower().encode("utf-32-le"), np.uint32)
    letter = _space()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.where(letter, codes, 0).astype(np.int64)
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    keys = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    return np.unique(keys, return_counts=True)


def bundles(texts: list[bytes], dims: int, seed: int) -> np.ndarray:
    """One vector a text, in blocks that share a matrix of trigram vectors."""
    out, vectors = np.zeros((len(texts), dims), np.float32), trigrams(dims, seed)
    for start in range(0, len(texts), BLOCK):
        counted = [trigram_counts(t) for t in texts[start : start + BLOCK]]
        keys = np.unique(np.concatenate([k for k, _ in counted]))
        if len(keys):
            table = np.zeros((len(counted), len(keys)), np.float32)
            for i, (k, n) in enumerate(counted):
                table[i, np.searchsorted(keys, k)] = n
            for at in range(0, len(keys), 8192):
                out[start : start + len(counted)] += table[:, at : at + 8192] @ vectors.matrix(keys[at : at + 8192])
    return out


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = 1024, seed: int = 11, max_languages: int = 1000) -> dict[str, np.ndarray]:
    """A vector for each language of docs, from all its texts; null text or language is passed over.

    Each Arrow batch gives one partial vector a language, summed by Spark; the driver gets
    dims numbers for each language, and refuses more than max_languages of them.
    """
    import pyarrow as pa

    def partial(batches):
        from .common import rows_of

        for batch in batches:
            by: dict[str, dict[int, int]] = {}
            for lang, text in zip(rows_of(batch, "lang"), rows_of(batch, "text")):
                own = by.setdefault(lang.decode(), {})
                for k, n in zip(*(x.tolist() for x in trigram_counts(text))):
                    own[k] = own.get(k, 0) + n
            for lang, own in by.items():
                total, keys, n = np.zeros(dims), np.fromiter(own, np.int64, len(own)), np.fromiter(own.values(), np.float32, len(own))
                for at in range(0, len(keys), 8192):
                    total += n[at : at + 8192] @ trigrams(dims, seed).matrix(keys[at : at + 8192])
                yield pa.RecordBatch.from_pydict({"lang": [lang], "v": [total.tolist()]}, schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    summed = rows.mapInArrow(partial, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    per = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).limit(max_languages + 1).collect()
    if len(per) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    out = {r["lang"]: np.array([x["x"] for x in r["v"]], np.float32) for r in per}
    return {k: v / n for k, v in sorted(out.items()) if (n := float(np.linalg.norm(v)))}


def predict(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """id, lang_pred and score (cosine, 0 to 1) for each row, by its whole text alone.

    Null text and text without a letter are UNKNOWN with score 0, as is all text where no
    language is known. Ties go to the first language by name.
    """
    names = list(known)
    table = np.stack([known[n] for n in names]) if names else np.zeros((0, 1), np.float32)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def rows(x):
        protos = sent.value
        if not len(protos):
            return {"id": x[id_col], "lang_pred": [UNKNOWN] * len(x[id_col]), "score": [0.0] * len(x[id_col])}
        found = bundles(x[text_col], protos.shape[1], seed)
        norms = np.linalg.norm(found, axis=1)
        cosines = (found @ protos.T) / np.maximum(norms, 1e-9)[:, None]
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(best)), best], 0.0, 1.0)
        return {"id": x[id_col], "lang_pred": [names[b] if n > 0 else UNKNOWN for b, n in zip(best, norms)], "score": [round(float(s), 6) if n > 0 else 0.0 for s, n in zip(score, norms)]}

    return per_row(docs.select(id_col, text_col), rows, "id bigint, lang_pred string, score double").withColumnRenamed("id", id_col)


def fold(id_col: str, parts: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 3, held: int = 1, dims: int = 1024, seed: int = 11) -> DataFrame:
    """id, held_out, lang_pred, score for each row; prototypes from labelled rows that aren't held out.

    Rows are held out by crc32 of the id as text, modulo parts. A null id is held out. Repeated
    rows get equal results; extra columns are ignored; an empty table gives no rows.
    """
    out = F.coalesce(fold(id_col, parts) == held, F.lit(True))
    known = prototypes(docs.filter(~out), text_col, lang_col, dims, seed)
    return predict(docs, known, id_col, text_col, seed).select(id_col, F.coalesce(fold(id_col, parts) == held, F.lit(True)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.45, min_letters: int = 200, dims: int = 1024, seed: int = 11) -> DataFrame:
    """docs without those of no language; all columns as they were.

    Texts that are null or have no letter go, and those of min_letters letters or more whose
    cosine to every language's prototype is under min_score: one phrase over and over, or a
    language that no label names. A shorter text's profile is too noisy to reject it by. One
    pass over rows, no join. If no language is known, as without labelled rows, all rows stay.
    Repeated rows stay or go together; extra columns may have any names; an empty table gives
    no rows.
    """
    known = prototypes(docs.filter(F.coalesce(fold(id_col, 3) != 1, F.lit(False))), text_col, lang_col, dims, seed)
    if not known:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(np.stack(list(known.values())))

    @F.pandas_udf("boolean")
    def identified(texts: pd.Series) -> pd.Series:
        raw = [(t or "").encode() for t in texts]
        found = bundles(raw, dims, seed)
        norms = np.linalg.norm(found, axis=1)
        best = ((found @ sent.value.T) / np.maximum(norms, 1e-9)[:, None]).max(axis=1)
        kept = (norms > 0) & (best >= min_score)
        for k in np.flatnonzero((norms > 0) & ~kept):
            kept[k] = sum(map(str.isalpha, raw[k].decode())) < min_letters
        return pd.Series(kept)

    return docs.filter(identified(F.col(text_col)))
