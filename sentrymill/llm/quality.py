"""Quality rules by divergence from language references, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, words

#: Frequent function words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "que"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ein"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "las", "un"],
}
#: Character classes besides blanks and the rest (mostly lower-case letters), as what to remove.
CLASSES = {"upper": r"\P{Lu}++", "digit": r"\P{Nd}++", "symbol": r"[^#*$%&|<>]++", "punct": r"(?:\P{P}|[#*%&])++"}
SYMBOLS = CLASSES["symbol"]


def _left(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _folded(word: Column) -> Column:
    return F.lower(F.rtrim(word, F.lit(".,;:!?")))


def with_learned(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common_words: dict = COMMON_WORDS, min_documents: int = 20, most: int = 10) -> dict:
    """common_words, and the most frequent words of each other language that min_documents documents or more are labelled with.

    Words are counted over all documents of those languages; ties go to the first by code point.
    The driver gets a row for each language, and most rows for each language learned.
    """
    known = [r["lang"] for r in docs.select(F.col(lang_col).alias("lang")).dropna().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_documents).collect()]
    new = sorted(set(known) - set(common_words))
    if not new:
        return common_words
    each = docs.filter(F.col(lang_col).isin(new)).select(F.col(lang_col).alias("lang"), F.explode(words(F.col(text_col))).alias("w")).select("lang", _folded(F.col("w")).alias("w"))
    counted = each.filter("w <> ''").groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    best = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).filter(F.col("k") <= most)
    out = dict(common_words) | {lang: [] for lang in new}
    for r in best.orderBy("lang", "k").collect():
        out[r["lang"]].append(r["w"])
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common_words: dict = COMMON_WORDS) -> DataFrame:
    """One narrow row per document: base counts, character-class counts and common-word counts.

    Windows of three words are compared by XXH64 of the three words, within one text only.
    Common words become one character each, so that all are counted in one short string.
    """
    vocabulary = sorted({w for ws in common_words.values() for w in ws})
    marks = [chr(0x100 + k if k < 0xD700 else 0x900 + k) for k in range(len(vocabulary))]  # none is a surrogate
    at = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    at = at.withColumn("w", words(F.col("t")))
    three = F.when(
        F.size("w") >= 3,
        F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.struct(F.xxhash64(F.get(F.col("w"), i - 1), F.get(F.col("w"), i), F.get(F.col("w"), i + 1)).alias("h"), i.alias("i"))),
    )
    at = at.withColumn("g", F.sort_array(three))
    same = lambda a, b: F.get(F.col("g"), a).getField("h") == F.get(F.col("g"), b).getField("h")
    last = F.size("g") - 1
    repeated = F.filter(F.col("g"), lambda x, k: ((k > 0) & F.coalesce(same(k, F.greatest(k - 1, F.lit(0))), F.lit(False))) | ((k < last) & F.coalesce(same(k, F.least(k + 1, last)), F.lit(False))))
    at = at.withColumn("r", F.sort_array(F.transform(repeated, lambda x: x.getField("i"))))
    covered = F.aggregate(
        F.transform(F.col("r"), lambda i, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), i - F.get(F.col("r"), F.greatest(k - 1, F.lit(0)))))),
        F.lit(0),
        lambda a, x: a + x,
    )
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    at = at.withColumn("lines", lines)
    met = F.filter(F.transform("w", _folded), lambda x: x.isin(vocabulary))
    mark = F.create_map(*[F.lit(x) for pair in zip(vocabulary, marks) for x in pair])
    at = at.withColumn("c", F.array_join(F.transform(met, lambda x: mark[x]), ""))
    return at.select(
        "id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _left(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.size("w") >= 3, covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length("t").cast("long").alias("n_chars"),
        F.array(*[_left(F.col("t"), p).cast("long") for p in CLASSES.values()]).alias("classes"),
        F.array(*[(F.length("c") - F.length(F.replace(F.col("c"), F.lit(m), F.lit("")))).cast("long") for m in marks]).alias("common"),
    )


def _shares(counts: Column, total: Column) -> Column:
    """Counts and the rest of the total, as shares of it."""
    sure = F.greatest(total, F.lit(1)).cast("double")
    rest = F.greatest(F.lit(0.0), 1 - F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) / sure)
    return F.concat(F.transform(counts, lambda x: x / sure), F.array(rest))


def jensen_shannon(p: Column, q: list[float]) -> Column:
    """Square root of the Jensen-Shannon divergence in bits; 0 to 1."""
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, F.array(*map(F.lit, q)), lambda a, b: term(a, b) + term(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2)


def references(found: DataFrame, common_words: dict = COMMON_WORDS) -> dict:
    """Class and common-word shares of each language of common_words, over all its documents in found.

    At most one row for each of these languages comes to the driver.
    """
    vocabulary = sorted({w for ws in common_words.values() for w in ws})
    total = lambda name, k: F.sum(F.get(F.col(name), F.lit(k)).cast("double")).alias(f"{name}{k}")
    rows = (
        found.filter(F.col("lang").isin(sorted(common_words)))
        .groupBy("lang")
        .agg(F.sum("n_chars").alias("n_chars"), F.sum("n_words").alias("n_words"), F.sum("word_chars").alias("word_chars"), *[total("classes", k) for k in range(len(CLASSES))], *[total("common", k) for k in range(len(vocabulary))])
        .collect()
    )

    def shares(values, whole):
        parts = [v / max(whole, 1) for v in values]
        return [*parts, max(0.0, 1 - math.fsum(parts))]

    return {
        r["lang"]: (
            shares([*(r[f"classes{k}"] for k in range(len(CLASSES))), r["n_chars"] - r["word_chars"]], r["n_chars"]),
            shares([r[f"common{k}"] for k in range(len(vocabulary))], r["n_words"]),
        )
        for r in sorted(rows, key=lambda r: r["lang"])
        if r["n_words"]
    }


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    common_words: dict = COMMON_WORDS,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_chars: int = 200,
    max_class_distance: float = 0.28,
    max_word_distance: float = 0.40,
    min_documents: int = 20,
) -> DataFrame:
    """Base counts, the verdict of two fixed rules, and that of the divergence from references.

    References are learned from all documents that pass the base rules, for each language of
    common_words and each other language that min_documents documents or more are labelled
    with. A document is compared with every reference and judged by the nearest; it is dropped
    if its character classes lie over max_class_distance away, or its common words over
    max_word_distance. Documents labelled with no language, or one without a reference, are
    judged by their character classes alone. Texts under min_words words or min_chars characters are not judged by
    divergence (min_words fails the base rule already). Without references, as for an empty table
    or one without the languages named, the base rules alone decide. Null text is empty: it has
    no words and fails the base rule. Repeated rows get equal results; extra columns are ignored.
    """
    common_words = with_learned(docs, text_col, lang_col, common_words, min_documents)
    found = checkpointed(features(docs, id_col, text_col, lang_col, common_words))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    refs = references(found.filter(~failed), common_words)
    out = found.withColumn("p", _shares(F.concat("classes", F.array(F.col("n_chars") - F.col("word_chars"))), F.col("n_chars")))
    out = out.withColumn("q", _shares(F.col("common"), F.col("n_words")))
    pairs = [F.struct((jensen_shannon(F.col("q"), q) + jensen_shannon(F.col("p"), p)).alias("d"), jensen_shannon(F.col("p"), p).alias("c"), jensen_shannon(F.col("q"), q).alias("w")) for p, q in refs.values()]
    nearest = F.array_min(F.array(*pairs)) if pairs else F.lit(None).cast("struct<d:double,c:double,w:double>")
    out = out.withColumn("near", nearest).withColumn("base_failed", failed)
    judged = (F.col("n_words") >= min_words) & (F.col("n_chars") >= min_chars)
    odd = judged & F.coalesce((F.col("near.c") > max_class_distance) | ((F.col("near.w") > max_word_distance) & F.col("lang").isin(sorted(refs))), F.lit(False))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~odd).alias("kept"), F.col("near.c").alias("class_distance"), F.col("near.w").alias("word_distance"),
    )
