"""Quality rules: word and repetition counts, and divergence from a language's usual text.

For every language the whole corpus gives two reference histograms: of character
classes, and of its most common words with all other words as one more class. A
document is compared with the references of its language by Jensen-Shannon
distance (base 2, so from 0 to 1). Short documents have noisy histograms, so below
a minimum length they are not judged by them, and neither is a language with too
little reference text.

DataFrame functions only. Documents are never exploded on the judging path: each
row is judged by itself, beside one small reference row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.common import WORD_SPLIT, stored

SYMBOLS = "#*$%&|<>"
# One letter for each common word in a document's code string; "0" stands for words as short that are
# none, and BARE for those of them without a letter.
BARE = "!"
CODES = "0ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# One reference row for each language is broadcast up to this many; beyond, they are joined by shuffle.
BROADCAST_LANGUAGES = 10_000

LETTER = r"\p{L}"

# Characters by class: the counts of a document, and of all documents of a language.
# Each class but the last takes what the classes before it in this order leave.
CLASSES = (
    "_lower",
    "_white",
    "n_symbols",
    "_upper",
    "_digit",
    "_point",
    "_latin",
    "_letter",
    "_mark",
    "_other",
)
# The classes that are counted by pattern in what is left of a text without lower-case letters and white
# space, and those of characters beyond ASCII.
ASCII_PATTERNS = {
    "_upper": "[A-Z]+",
    "_digit": "[0-9]+",
    "_point": r"[.,;:!?'\"()\[\]{}-]+",
}
WIDE_PATTERNS = {
    "_latin": r"[\p{L}&&[\p{IsLatin}]]+",
    "_letter": r"[\p{L}&&[^\p{IsLatin}]]+",
    "_mark": r"\p{M}+",
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count(text: Column, characters: str) -> Column:
    left = text
    for c in characters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(left)).cast("long")


def _matched(text: Column, pattern: str) -> Column:
    """How many characters of ``text`` lie in matches of a pattern."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _shares(counts: list[Column]) -> Column:
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return F.array(*[c / total for c in counts])


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares; null if either is."""

    def part(x, y):
        m = (x + y) / 2
        one = lambda v: F.when(v > 0, v * F.log2(v / m)).otherwise(F.lit(0.0))
        return one(x) + one(y)

    total = F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def common_words(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", n_common: int = 20, min_words: int = 1000
) -> DataFrame:
    """(lang, ref_words, _longest, ref_shares) of each language with ``min_words`` words or more.

    All documents of a language count. ``ref_words`` are its ``n_common`` most
    frequent words with a letter, lower-cased, ties in the order of the words; ``_longest``
    is the length of the longest; ``ref_shares`` has the share of all other words first,
    then that of words without a letter that are no longer than the longest.
    Documents without a language count nowhere.
    """
    if n_common >= len(CODES):
        raise ValueError(f"n_common must be under {len(CODES)}")
    known = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    words = stored(
        known.filter("lang is not null")
        .select("lang", F.explode(F.split(F.lower("text"), WORD_SPLIT)).alias("word"))
        .filter("word <> ''")
        .groupBy("lang", "word")
        .count(),
        "words",
    )
    totals = words.groupBy("lang").agg(F.sum("count").alias("total")).filter(F.col("total") >= min_words)
    order = W.partitionBy("lang").orderBy(F.desc("count"), F.asc("word"))
    common = (
        words.filter(F.col("word").rlike(LETTER))
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= n_common)
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("n", "word", "count"))).alias("top"))
        .withColumn("_longest", F.array_max(F.transform("top.word", F.length)))
    )
    bare = (
        words.filter(~F.col("word").rlike(LETTER))
        .join(common.select("lang", "_longest"), "lang")
        .filter(F.length("word") <= F.col("_longest"))
        .groupBy("lang")
        .agg(F.sum("count").alias("bare"))
    )
    share = F.transform(
        F.concat(F.array(F.coalesce("bare", F.lit(0))), "top.count"), lambda x: x / F.col("total")
    )
    rest = F.lit(1.0) - F.aggregate(share, F.lit(0.0), lambda a, x: a + x)
    return totals.join(common, "lang").join(bare, "lang", "left").select(
        "lang",
        F.col("top.word").alias("ref_words"),
        "_longest",
        F.concat(F.array(F.greatest(rest, F.lit(0.0))), share).alias("ref_shares"),
    )


def quality_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of :data:`COUNTS`, and columns that later steps use.

    A null text has no words.

    ``n_repeat_words`` is the number of words that lie in a window of three words
    found twice or more in the text, each word once.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in COUNTS]
    names = [c for c in docs.columns if c not in COUNTS]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Most of a text is lower-case Latin letters and white space: what else it has is looked at without them.
    rows = docs.select(
        *kept,
        F.array_remove(F.split(body, WORD_SPLIT), "").alias("_words"),
        lines.alias("_lines"),
        F.length(body).cast("long").alias("_chars"),
        F.regexp_replace(body, "[a-z]+", "").alias("_no_lower"),
    ).withColumn("_rest", F.regexp_replace("_no_lower", r"[\x20\x09-\x0D]+", ""))
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    window = lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2))
    rows = rows.select(
        *kept,
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        "_chars",
        "_rest",
        (F.col("_chars") - F.length("_no_lower")).alias("_lower"),
        (F.length("_no_lower") - F.length("_rest")).cast("long").alias("_white"),
        _count(F.col("_rest"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_words") >= 3,
            F.slice(F.transform("_hashes", window), F.lit(1), F.size("_words") - 2),
        ).alias("_windows"),
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn(
        "_sorted",
        F.when(
            repeats,
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("_windows")
    again = F.filter(
        F.transform(
            "_sorted",
            lambda x, j: F.when(
                (F.get("_sorted", j - 1)["h"] == x["h"]) | (F.get("_sorted", j + 1)["h"] == x["h"]),
                x["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    rows = rows.withColumn("_starts", F.sort_array(again)).drop("_sorted")
    covered = F.aggregate(
        F.transform(
            "_starts", lambda s, j: F.least(F.lit(3), F.coalesce(F.get("_starts", j + 1) - s, F.lit(3)))
        ),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return rows.select(
        *[F.col(f"`{c}`") for c in names],
        "_words",
        "_chars",
        "_rest",
        "_lower",
        "_white",
        "n_words",
        (F.col("_chars") - F.col("_white")).alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def judge_quality(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    n_common: int = 20,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    judged_words: int = 50,
    judged_chars: int = 200,
    reference_words: int = 1000,
    max_class_distance: float = 0.27,
    max_word_distance: float = 0.42,
) -> DataFrame:
    """``docs`` without its text, with the counts, base_failed, both distances and kept.

    ``base_failed``: fewer than ``min_words`` words, or over ``max_repeat_percent``
    of them in repeated windows. Otherwise a document is kept unless a distance
    exceeds its bound. Distances are null, and pass, where the document has fewer
    than ``judged_words`` words or ``judged_chars`` characters, has no language, or
    its language has fewer than ``reference_words`` words in all. A null text counts
    as an empty one. Rows are kept one for one, repeated ones too; input columns
    called like a result are replaced.

    The texts are read twice, for the words of the languages and for the documents'
    own counts, which are written; all else works on those counts.
    """
    results = (*COUNTS, "base_failed", "class_distance", "word_distance", "kept")
    words = _small(
        common_words(docs, text=text, lang=lang, n_common=n_common, min_words=reference_words)
    )
    carried = [c for c in docs.columns if c not in results and c != text]
    rows = quality_counts(docs.drop(*[c for c in results if c != text]), text)
    rows = rows.join(words.withColumnRenamed("lang", "_lang"), F.col(f"`{lang}`") == F.col("_lang"), "left")
    # Common words are short, so most others need no look at the list.
    place = lambda w: F.array_position("ref_words", F.lower(w))
    code = F.transform(
        F.filter("_words", lambda w: F.length(w) <= F.col("_longest")),
        lambda w: F.when(w.rlike(LETTER), F.substring(F.lit(CODES), (place(w) + 1).cast("int"), F.lit(1))).otherwise(
            F.lit(BARE)
        ),
    )
    keep = [F.col(f"`{c}`") for c in carried]
    # Few texts have much beyond ASCII, and many nothing.
    wide = F.when(F.octet_length("_rest") == F.length("_rest"), F.lit("")).otherwise(
        F.regexp_replace("_rest", r"[\x00-\x7F]+", "")
    )
    rows = rows.withColumn("_wide", wide).select(
        *keep,
        *COUNTS,
        "_lang",
        "_chars",
        "_white",
        "_lower",
        *[_matched(F.col("_rest"), pattern).alias(name) for name, pattern in ASCII_PATTERNS.items()],
        *[_matched(F.col("_wide"), pattern).alias(name) for name, pattern in WIDE_PATTERNS.items()],
        F.array_join(code, "").alias("_code"),
        "ref_shares",
    )
    uses = [_count(F.col("_code"), c) for c in BARE + CODES[1 : n_common + 1]]
    other = F.col("n_words") - F.length(F.translate("_code", "0", ""))
    rows = rows.withColumn("_uses", F.array(other.cast("long"), *uses)).drop("_code")
    shares = F.transform("_uses", lambda x: x / F.col("n_words"))
    # a language may have fewer words than n_common
    word_distance = js_distance(F.slice(shares, F.lit(1), F.size("ref_shares")), F.col("ref_shares"))
    judged = (
        F.col("_lang").isNotNull()
        & (F.col("n_words") >= judged_words)
        & (F.col("_chars") >= judged_chars)
    )
    rows = stored(
        rows.select(
            *keep,
            *COUNTS,
            "_lang",
            *[c for c in CLASSES[:-1] if c not in COUNTS],
            (F.col("_chars") - sum((F.col(c) for c in CLASSES[1:-1]), F.col(CLASSES[0]))).alias("_other"),
            judged.alias("_judged"),
            F.when(judged, word_distance).alias("word_distance"),
        ),
        "counts",
    )
    classes = _small(
        rows.filter("_lang IS NOT NULL")
        .groupBy("_lang")
        .agg(*[F.sum(c).alias(c) for c in CLASSES])
        .select(F.col("_lang").alias("_of"), _shares([F.col(c) for c in CLASSES]).alias("ref_classes"))
    )
    failed = (F.col("n_words") < min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * F.col("n_words")
    )
    class_distance = js_distance(_shares([F.col(c) for c in CLASSES]), F.col("ref_classes"))
    rows = rows.join(classes, F.col("_lang") == F.col("_of"), "left").select(
        *keep,
        *COUNTS,
        failed.alias("base_failed"),
        F.when(F.col("_judged"), class_distance).alias("class_distance"),
        "word_distance",
    )
    diverges = (F.col("class_distance") > max_class_distance) | (
        F.col("word_distance") > max_word_distance
    )
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(diverges, F.lit(False)))


def _small(references: DataFrame) -> DataFrame:
    """One row for each language, broadcast if there are few enough."""
    references = stored(references, "references")
    return F.broadcast(references) if references.count() <= BROADCAST_LANGUAGES else references
