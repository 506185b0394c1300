"""Audit of how the sources of a language differ in their terms, by count-level bitmaps.

A group is a language and source; each language keeps the terms that at least
`LEAST` of its documents hold. A group's count of a term gives a smoothed share p in
billionths, and two shares p, q differ by f = floor((p - q)^2 / (p + q)).

Kept terms are numbered so that terms of like frequency are neighbours, 64 to a
machine word. For each word a group stores one bitset per count: the terms that it
holds so often. The bitsets of two groups are intersected and their bits counted,
which gives the joint cells (count here, count there); each cell is worth its number
of terms times f of its two counts. Terms that one or both lack need no bitset: a
level less its cells is what the other group lacks, and the vocabulary less all
levels is what both lack, so f at count 0 enters by complement, with level sizes
only. The language as a whole is one more group; its cells with a source, read bit by
bit, give the source's telling terms. Rare terms, nearly the whole vocabulary, lie in
words with two or three levels a group.

Counts are added up inside the scanning tasks first. Cells are worked out in one task
per language and 1,024 terms, so neither a large language nor a large source meets one
task; memory there grows with the number of sources of a language, whose square the
report lists anyway. Arithmetic is in whole numbers throughout.

Missing texts, languages and sources read as empty. Repeated rows count each. Groups
without a term take part; where a language keeps no term all values are 0. An empty
table gives no rows. Columns other than text, lang and source are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointproc.llm.common import heads
from pointproc.llm.sentencepieces import ragged
from pointproc.session import discard, store

TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that must hold a term.
LEAST = 10
#: Telling terms listed for a group.
TOP = 10
SCALE = 1_000_000_000
#: Distinct (group, term) that a task gathers before it hands them on.
GATHER = 400_000
#: Words of 64 terms that a task compares together.
BLOCK = 16
#: Bitsets of sources intersected at once.
TILE = 1 << 21


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it): sums of parts of the table, to be added up."""

    def run(batches):
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def parts():
            for (lang, source), (n, docs) in seen.items():
                terms = list(n)
                yield pa.record_batch([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                                       pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                                      names=["lang", "source", "term", "n", "docs"])
            seen.clear()

        size = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
                terms = re.findall(TERM, text.as_py().lower())  # bytes fold A-Z only
                size -= len(n)
                n.update(terms)
                docs.update(set(terms))
                size += len(n)
                if size > GATHER:
                    yield from parts()
                    size = 0
        yield from parts()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def numbered(terms: DataFrame) -> DataFrame:
    """Adds word and bit: terms of a language in the order of their count, 64 to a word; a word may hold fewer."""
    rows = terms.repartitionByRange("lang", F.col("total").desc(), "term").sortWithinPartitions("lang", F.col("total").desc(), "term")
    place = F.monotonically_increasing_id()
    return rows.withColumn("word", F.shiftright(place, 6)).withColumn("bit", place.bitwiseAND(F.lit(63)).cast("int"))


def bitsets(rows: DataFrame, *level: str) -> DataFrame:
    """One bitset per word and level."""
    return rows.groupBy(*level).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def share(n: Column, size: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (size + 2 v)), whole-number arithmetic in decimals."""
    top = (n + F.lit(2)).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = size.cast("decimal(19,0)") + F.lit(2) * v
    return F.lit(1).cast("long") + F.call_function("div", top, below.cast("decimal(20,0)"))


def difference(p, q):
    """floor((p - q)^2 / (p + q)), for columns and for whole numbers in numpy."""
    if isinstance(p, Column):
        return F.call_function("div", (p - q) * (p - q), p + q)
    return (p - q) ** 2 // (p + q)


def bits_of(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bit set: the row of its bitset and its place."""
    return np.nonzero(np.unpackbits(sets.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def cells(top: int):
    """A task's function: bitsets of all groups of a language in some words, to sums of cells and telling terms."""

    def run(key, rows):
        lang = key[0].as_py()
        source = rows.column("source").combine_chunks().dictionary_encode()
        names, code = source.dictionary, source.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        word, p, p0 = (rows.column(c).to_numpy() for c in ("word", "p", "p0"))
        bits = rows.column("bits").to_numpy().view(np.uint64)
        order = np.lexsort((code, word))
        code, word, p, p0, bits = code[order], word[order], p[order], p0[order], bits[order]
        n = len(names)
        total = np.zeros((n, n), np.int64)
        telling = []
        begin = np.flatnonzero(heads(word))
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(word)]):
            first = lo + int(np.searchsorted(code[lo:hi], 0))  # the language's own bitsets come first
            step = max(1, TILE // max(hi - first, 1))
            for k in range(first, hi, step):
                end = min(k + step, hi)
                joint = bits[k:end, None] & bits[None, k:hi]
                a, b = np.nonzero(joint)
                count = np.bitwise_count(joint[a, b]).astype(np.int64)
                a, b = a + k, b + k
                use = code[a] < code[b]
                a, b, count = a[use], b[use], count[use]
                worth = difference(p[a], p[b]) - difference(p[a], p0[b]) - difference(p0[a], p[b]) + difference(p0[a], p0[b])
                np.add.at(total, (code[a], code[b]), count * worth)
                joint = bits[k:end, None] & bits[None, lo:first]
                a, b = np.nonzero(joint)
                found = joint[a, b]
                a, b = a + k, b + lo
                more = p[a] > p[b]
                a, b, found = a[more], b[more], found[more]
                telling.append((code[a], difference(p[a], p[b]), np.full(len(a), word[lo]), found))
        i, j = np.nonzero(total)
        out = [(i, j, np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), total[i, j])]
        if telling:  # what may be among the first of its group here; equal values stay together
            owner, value, at, found = (np.concatenate(x) for x in zip(*telling))
            order = np.lexsort((-value, owner))
            owner, value, at, found = owner[order], value[order], at[order], found[order]
            before = np.cumsum(np.bitwise_count(found)) - np.bitwise_count(found)
            head = heads(owner)
            before -= before[np.flatnonzero(head)][np.cumsum(head) - 1] if len(head) else 0
            new = head | heads(value)
            keep = before[np.flatnonzero(new)][np.cumsum(new) - 1] < top if len(new) else np.zeros(0, bool)
            owner, value, at, found = owner[keep], value[keep], at[keep], found[keep]
            row, bit = bits_of(found)
            out.append((owner[row], np.full(len(row), -1), at[row], bit, value[row]))
        a, b, at, bit, value = (np.concatenate(x) for x in zip(*out))
        other = pa.array(np.maximum(b, 0), mask=b < 0)
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": names.take(pa.array(a)), "other": names.take(other),
                         "word": pa.array(at, pa.int64()), "bit": pa.array(bit, pa.int32()), "value": pa.array(value, pa.int64())})

    return run


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each other source is (part `pair`, all of them) and what the source
    has more of than its language (part `term`, the first `top`)."""
    counts = store(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    terms = store(numbered(terms.drop("docs")))
    here = counts.join(terms, ["lang", "term"])
    sets = store(bitsets(here, "lang", "word", "source", "n").unionByName(
        bitsets(terms.withColumn("source", F.lit(None).cast("string")).withColumnRenamed("total", "n"), "lang", "word", "source", "n")))
    discard(counts)

    kept = terms.groupBy("lang").agg(F.count("*").alias("v"))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = named.unionByName(named.select("lang", F.lit(None).cast("string").alias("source")).distinct())
    sizes = sets.groupBy("lang", "source").agg(F.sum(F.col("n") * F.bit_count("bits")).alias("size"))
    g, s = groups.alias("g"), sizes.alias("s")
    groups = g.join(s, (F.col("g.lang") == F.col("s.lang")) & F.col("g.source").eqNullSafe(F.col("s.source")), "left") \
        .join(kept.alias("k"), F.col("g.lang") == F.col("k.lang"), "left") \
        .select("g.lang", "g.source", F.coalesce("s.size", F.lit(0)).alias("size"), F.coalesce("k.v", F.lit(0)).alias("v"))
    groups = store(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("size"), F.col("v")))))

    b, g = sets.alias("b"), groups.alias("g")
    rows = b.join(g, (F.col("b.lang") == F.col("g.lang")) & F.col("b.source").eqNullSafe(F.col("g.source"))).select(
        "b.lang", "b.source", "b.word", "b.bits", share(F.col("b.n"), F.col("g.size"), F.col("g.v")).alias("p"), "g.p0",
        F.floor(F.col("b.word") / BLOCK).alias("block"))
    found = store(rows.groupBy("lang", "block").applyInArrow(
        cells(top), "lang string, source string, other string, word long, bit int, value long"))

    named = groups.where(F.col("source").isNotNull())
    a, o = named.alias("a"), named.alias("o")
    others = a.join(o, (F.col("a.lang") == F.col("o.lang")) & (F.col("a.source") != F.col("o.source")))
    neither = others.select("a.lang", "a.source", F.col("o.source").alias("item"),
                            F.when(F.col("a.v") > 0, F.col("a.v") * difference(F.col("a.p0"), F.col("o.p0"))).otherwise(0).alias("value"))
    # levels of a group against what the other lacks; a level's number spreads the levels of a language
    levels = sets.where(F.col("source").isNotNull()).groupBy("lang", "source", "n").agg(F.sum(F.bit_count("bits").cast("long")).alias("m"))
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lv = levels.withColumn("salt", F.pmod(F.xxhash64("source", "n"), F.lit(salts)).cast("int")).alias("l")
    pairs = others.select("a.lang", "a.source", F.col("o.source").alias("item"), "a.size", "a.v", "a.p0", F.col("o.p0").alias("q0")) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("x")
    p = share(F.col("l.n"), F.col("x.size"), F.col("x.v"))
    lacking = lv.join(pairs, ["lang", "source", "salt"]).select(
        "lang", "source", "x.item",
        (F.col("l.m") * (difference(p, F.col("x.q0")) - difference(F.col("x.p0"), F.col("x.q0")))).alias("value")) \
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    joint = found.where(F.col("other").isNotNull()).select("lang", "source", F.col("other").alias("item"), "value")
    both = joint.unionByName(lacking)
    far = neither.unionByName(both).unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    far = far.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    telling = found.where(F.col("other").isNull()).join(terms, ["lang", "word", "bit"]).select(
        "lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    first = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return far.withColumn("rank", F.row_number().over(order)).select(columns).unionByName(first.select(columns))


#: DuckDB text for `audit` over documents: every group gets every kept term.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(
        translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grps AS (SELECT DISTINCT lang, source FROM d),
counted AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
every AS (SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n
          FROM grps g JOIN kept k ON g.lang = k.lang
          LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n,
             1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (CAST(sum(n) OVER (PARTITION BY lang, source) AS HUGEINT) + 2 * v) AS p
           FROM every JOIN vocabulary USING (lang)),
whole AS (SELECT lang, term, sum(n) AS n FROM every GROUP BY lang, term),
whole_shares AS (SELECT lang, term,
             1 + (CAST(1000000000 AS HUGEINT) * (CAST(n AS HUGEINT) + 2)) // (CAST(sum(n) OVER (PARTITION BY lang) AS HUGEINT) + 2 * v) AS q
           FROM whole JOIN vocabulary USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
         FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
         FROM shares s JOIN whole_shares USING (lang, term) WHERE s.n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
           FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
