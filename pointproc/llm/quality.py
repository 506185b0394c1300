"""Quality rules: counts, and divergence of a text's histograms from those of languages.

Everything is DataFrame expressions. A text's characters are counted by class and its
words by a list of common words (the rest as one more class). Summed over all
documents of a language these make the language's reference. A document is compared
with every reference by Jensen-Shannon distance (base 2, so 0 to 1) and fails if it
is too far from all of them: by its characters beyond a fixed distance, by its words
if it is nearly as far as a text without any common word. Words are looked up in lower
case without their punctuation. Texts shorter than a guard are not judged by that
histogram, nor texts of a language by words of which the list has too few. A language is a reference for all documents if it has a hundredth of those that name
one, so there are at most a hundred; documents of rarer languages are compared with
their own language's characters as well. Without any, the base rules alone decide.

Missing text counts as empty. Rows are judged one by one, repeated or not.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointproc.llm.common import WORD
from pointproc.session import discard, store

#: Common words of the languages expected, in the order of their frequency.
COMMON = {
    "en": "the of and to in is that it was for on are with as be at this from by an or not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine".split(),
    "fr": "de la le et les des en un une du que dans pour est au sur pas par avec".split(),
    "es": "de la que el en y los se del las un por con una para su es al lo".split(),
}
WORDS = list(dict.fromkeys(w for words in COMMON.values() for w in words))
#: Characters by class; blanks are what words leave, and what no class matches is a letter in lower case.
CLASSES = {"upper": r"\p{Lu}", "digit": r"[0-9]", "stop": r"[.,;:!?]",
           "sign": r"[^\p{L}\p{M}0-9.,;:!?\x20\x09-\x0D]"}
SYMBOLS = r"[#*$%&|<>]"
#: Guards and greatest distances.
LEAST_CHARS, LEAST_WORDS = 200, 40
FAR_CHARS = 0.28
#: Share of the distance that a text without any common word has from a reference; the least share of common words
#: in a reference that tells by them.
FAR_WORDS, TELLING = 0.95, 0.05
#: Taken from words before they are looked up, after folding their case.
MARKS = ".,;:!?\"'()[]{}«»“”‘’„¿¡…*_"
WINDOW = 5


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with the array `words`: words in windows of five that occur twice or more."""
    windows = F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))
    g = docs.withColumn("_g", F.transform(F.slice("words", F.lit(1), windows), lambda w, i: F.xxhash64(
        w, *[F.get("words", i + k) for k in range(1, WINDOW)])))
    some = F.size(F.array_distinct("_g")) < F.size("_g")
    s = g.withColumn("_s", F.when(some, F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_g")

    def again(x: Column, k: Column) -> Column:
        return F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False))

    at = s.withColumn("_at", F.sort_array(F.transform(F.filter("_s", again), lambda x: x["i"]))).drop("_s")
    steps = F.transform("_at", lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - v, F.lit(WINDOW))).cast("long"))
    return at.withColumn("n_repeat_words", F.coalesce(_sum(steps), F.lit(0).cast("long"))).drop("_at")


def measures(docs: DataFrame) -> DataFrame:
    """Counts and histograms of every row: doc_id, lang, n_chars, the base counts, chars and common (arrays of long)."""
    text = F.coalesce("text", F.lit(""))
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("long")
    d = docs.select("doc_id", "lang", text.alias("_t")).withColumn("words", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD))
    d = d.select("*", F.length("_t").cast("long").alias("all_chars"), count(SYMBOLS).alias("n_symbols"), lines.alias("_lines"),
                 *[count(p).alias(f"_{c}") for c, p in CLASSES.items()])
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines", "_t")
    d = d.withColumn("_joined", F.array_join("words", " "))
    d = d.withColumn("word_chars", (F.length("_joined") - F.greatest(F.size("words") - 1, F.lit(0))).cast("long"))
    d = d.withColumn("_folded", F.split(F.translate(F.lower("_joined"), MARKS, ""), " ")).drop("_joined")
    rest = reduce(lambda a, c: a - F.col(f"_{c}"), CLASSES, F.col("word_chars"))
    known = F.array(*[F.lit(w) for w in WORDS])
    codes = F.transform(F.filter("_folded", lambda w: w.isin(WORDS)), lambda w: F.chr(F.array_position(known, w) + 47))
    d = d.withColumn("_codes", F.array_join(codes, ""))
    each = [(F.length("_codes") - F.length(F.replace("_codes", F.lit(chr(48 + k)), F.lit("")))).cast("long") for k in range(len(WORDS))]
    d = repeated_words(d)
    return d.select(
        "doc_id", "lang", "all_chars", F.size("words").cast("long").alias("n_words"),
        "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(F.col("all_chars") - F.col("word_chars"), *[F.col(f"_{c}") for c in CLASSES], rest).alias("chars"),
        F.array(*each, (F.size("words") - F.length("_codes")).cast("long")).alias("common"))


def references(rows: DataFrame) -> tuple[list[dict], DataFrame]:
    """Histograms of each language that has a hundredth of the rows naming one: at most a hundred; lang and own_chars of the rest."""
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 2)]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    per = store(rows.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"), *sums))
    total = per.agg(F.sum("n")).first()[0] or 0
    found = per.where(F.col("n") * 100 >= total).orderBy("lang").collect()
    rest = store(per.where(F.col("n") * 100 < total).select("lang", F.array(*[f"c{i}" for i in range(len(CLASSES) + 2)]).alias("own_chars")))
    discard(per)
    return [{"lang": r["lang"], "chars": [r[f"c{i}"] for i in range(len(CLASSES) + 2)],
             "common": [r[f"w{i}"] for i in range(len(WORDS) + 1)]} for r in found], rest


def _entropy(values: Column) -> Column:
    """Bits of an array of shares."""
    bits = F.transform(values, lambda x: F.when(x > 0, -x * F.log2(F.greatest(x, F.lit(1e-300)))).otherwise(0.0))
    return F.aggregate(bits, F.lit(0.0), lambda s, x: s + x)


def with_shares(df: DataFrame, histogram: str) -> DataFrame:
    """Adds a histogram's shares and their entropy, which all its distances use; missing for an empty one."""
    total = _sum(F.col(histogram))
    shares = F.when(total > 0, F.transform(histogram, lambda x: x / F.greatest(total, F.lit(1))))
    # a generator of one row keeps the costly column from being copied into each distance
    df = df.select("*", F.explode(F.array(shares)).alias(f"{histogram}_p"))
    return df.select("*", F.explode(F.array(_entropy(F.col(f"{histogram}_p")))).alias(f"{histogram}_h"))


def distance(histogram: str, reference: list[int]) -> Column:
    """Jensen-Shannon distance of shares to a reference: entropy of the mean less mean entropy; missing if either is empty."""
    whole = float(sum(reference))
    if not whole:
        return F.lit(None).cast("double")
    q = [x / whole for x in reference]
    own = -sum(x * math.log2(x) for x in q if x)
    mean = F.zip_with(f"{histogram}_p", F.array(*[F.lit(x) for x in q]), lambda a, b: (a + b) / 2)
    return F.when(F.col(f"{histogram}_h").isNotNull(), F.sqrt(F.greatest(_entropy(mean) - (F.col(f"{histogram}_h") + own) / 2, F.lit(0.0))))


def own_distance() -> Column:
    """Jensen-Shannon distance of the shares chars_p to the histogram own_chars; missing without one."""
    total = _sum(F.col("own_chars"))
    q = F.transform("own_chars", lambda x: x / F.greatest(total, F.lit(1)))
    mean = F.zip_with("chars_p", q, lambda a, b: (a + b) / 2)
    return F.when(F.col("own_chars").isNotNull() & (total > 0) & F.col("chars_h").isNotNull(),
                  F.sqrt(F.greatest(_entropy(mean) - (F.col("chars_h") + _entropy(q)) / 2, F.lit(0.0))))


def without_common(reference: list[int]) -> float:
    """Distance of a text without any common word to a reference."""
    q = [x / sum(reference) for x in reference]
    p = [0.0] * (len(q) - 1) + [1.0]
    bits = lambda v: -sum(x * math.log2(x) for x in v if x)
    return math.sqrt(max(0.0, bits([(x + y) / 2 for x, y in zip(p, q)]) - (bits(p) + bits(q)) / 2))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, chars_distance, words_distance."""
    rows = store(measures(docs))
    known, rest = references(rows)
    names = [r["lang"] for r in known]
    rare = F.col("lang").isNotNull() & ~F.col("lang").isin(names)
    # only rows of rare languages are joined, none of which has more than a hundredth of the table
    common = rows.where(~F.coalesce(rare, F.lit(False))).withColumn("own_chars", F.lit(None).cast("array<long>"))
    rows = common.unionByName(rows.where(rare).join(rest, "lang", "left"))

    # a generator of one row keeps the distances from being computed for each use
    each = F.array(*[distance("common", r["common"]) for r in known]).cast("array<double>")
    out = with_shares(with_shares(rows, "chars"), "common").select("*", F.explode(F.array(each)).alias("_each"))
    found = [distance("chars", r["chars"]) for r in known]
    out = out.withColumn("chars_distance", F.least(own_distance(), F.lit(None).cast("double"), *found))
    out = out.withColumn("words_distance", F.array_min("_each"))
    telling = [(k, r) for k, r in enumerate(known) if sum(r["common"]) - r["common"][-1] >= TELLING * sum(r["common"]) > 0]
    near = reduce(lambda x, y: x | y, [F.get("_each", F.lit(k)) < FAR_WORDS * without_common(r["common"]) for k, r in telling], F.lit(False))
    # a language without common words of its own in the list is not judged by them
    judged = F.col("lang").isNull() | F.col("lang").isin([r["lang"] for _, r in telling]) if telling else F.lit(False)
    far = ((F.col("all_chars") >= LEAST_CHARS) & (F.coalesce("chars_distance", F.lit(0.0)) > FAR_CHARS)) | (
        judged & (F.col("n_words") >= LEAST_WORDS) & ~F.coalesce(near, F.lit(True)))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base.alias("base_failed"), (~base & ~far).alias("kept"), "chars_distance", "words_distance")
