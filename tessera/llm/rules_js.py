"""Quality rules in DataFrame functions: base counts, and distribution divergence from language references.

References are counted from the corpus itself, over all documents with a language: for each language the
WORDS most frequent words with their shares, from documents of MIN_CHARS characters or more, and the shares
of the character classes, from documents that the base rules don't fail.

A document's character-class shares and its shares of each language's common words are compared
with that language's reference by Jensen-Shannon distance (base 2, 0 to 1). The nearest language
counts, for each histogram by itself. A document is kept if the base rules don't fail it and
neither distance is over its limit: FENCE times the middle half's width above the upper quartile of the
distances of the reference documents that are long enough for the test, all to three places. Short texts
give noisy shares, so the class test needs MIN_CHARS characters and the word test MIN_WORDS words; a test
that isn't made passes.

Three-word windows that occur twice are found by 64-bit hashes of their words. The words of references
are counted by partial sums in each task; all else of a document is computed inside its row
from arrays, over the whole text, and written once without the text. What the driver sees are the
references, WORDS words and seven numbers a language, and the histograms of distances.

Defined cases: null and empty texts have no words, all counts 0, and fail the base rules; documents of null
language are judged but teach nothing; without any reference both tests pass. Rows with repeated ids are
judged one by one; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD_SPACE, materialise, table, words

PUNCTUATION = ".,;:!?'\"()-"
MIN_CHARS, MIN_WORDS = 300, 100
#: Words of a language's reference, the most languages, and the fence above the upper quartile.
WORDS, MOST_LANGUAGES, FENCE = 20, 100, 3.0
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_OTHER = "".join(chr(c) for c in range(33, 127) if chr(c) not in _LOWER + _UPPER + _DIGITS + PUNCTUATION)


@dataclass
class References:
    """words: for each language its common words with their shares; classes: for each language the shares of lower case a-z, upper case A-Z, digits, white space, punctuation, other ASCII and the rest."""

    words: dict
    classes: dict


def divergence(reference: list, share: Column) -> Column:
    """Jensen-Shannon distance of an array of shares from a fixed one."""
    term = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    halves = F.zip_with(F.array(*map(F.lit, reference)), share, lambda p, q: 0.5 * (term(p, q) + term(q, p)))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(halves, F.lit(0.0), lambda s, x: s + x)))


def without(text: str, characters: str) -> Column:
    """Length of the text less that without these characters (runs are cut out at once)."""
    kind = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in characters) + "]+"
    return F.length(text) - F.length(F.regexp_replace(text, kind, ""))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, w (the words) and the base columns."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    df = df.withColumn("w", words(F.col("text"))).withColumn("n_words", F.size("w").cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{WORD_SPACE}]"))
    at = lambda name, i: F.get(F.col(name), i)
    windows = F.transform(F.slice("w", 3, F.greatest(F.size("w") - 2, F.lit(0))), lambda last, i: F.struct(F.xxhash64(at("w", i), at("w", i + 1), last).alias("k"), i.alias("i")))
    df = df.withColumn("lines", lines).withColumn("sorted", F.sort_array(windows))
    twice = lambda x, i: F.when((x["k"] == at("sorted", i - 1)["k"]) | (x["k"] == at("sorted", i + 1)["k"]), x["i"])
    df = df.withColumn("found", F.sort_array(F.array_compact(F.transform("sorted", twice))))
    covered = F.transform("found", lambda x, i: F.least(F.coalesce(at("found", i + 1) - x, F.lit(3)), F.lit(3)))
    return df.select(
        "doc_id", "text", "lang", "w", "n_words",
        without("text", " \t\n\x0b\f\r").alias("n_space"),
        without("text", "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda s, x: s + x).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def bare_words(text: Column) -> Column:
    """The words in lower case without punctuation at their ends; words of punctuation alone are empty."""
    ends = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in PUNCTUATION) + "]*"
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(PUNCTUATION)), f"{ends}[{WORD_SPACE}]+{ends}")


def common_words(docs: DataFrame, first: int = WORDS) -> dict:
    """For each language its most frequent words with their shares of all words, ties by word."""
    long = docs.where("lang is not null").where(F.length("text") >= MIN_CHARS)
    each = long.select(F.col("lang").cast("string").alias("lang"), F.explode(bare_words(F.col("text"))).alias("x")).where("x <> ''")
    counts = each.groupBy("lang", "x").agg(F.count("*").alias("n"))
    counts = materialise(counts, "rules-words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "x"))  # Spark keeps each task's first ones only
    best = counts.withColumn("k", place).where(F.col("k") <= first)
    found: dict = {}
    for r in best.orderBy("lang", "k").collect():  # WORDS rows a language
        found.setdefault(r["lang"], {})[r["x"]] = r["n"] / totals[r["lang"]]
    return found


def counted(docs: DataFrame, common: dict) -> DataFrame:
    """The base columns, lang, n_chars, n_space, classes (counts) and own (for each language counts of its common words): no texts."""
    df = base_counts(docs).withColumns({"n_chars": F.length("text"), "n_lower": without("text", _LOWER), "n_upper": without("text", _UPPER), "n_digits": without("text", _DIGITS), "n_punct": without("text", PUNCTUATION), "n_ascii": without("text", _OTHER)})
    kinds = ["n_lower", "n_upper", "n_digits", "n_space", "n_punct", "n_ascii"]
    rest = F.greatest(F.lit(0), F.col("n_chars") - sum(F.col(k) for k in kinds))
    df = df.withColumn("classes", F.array(*[F.col(k).cast("int") for k in kinds], rest.cast("int")))
    listed = sorted({x for v in common.values() for x in v})
    df = df.withColumn("common", F.filter(bare_words(F.col("text")), lambda x: x.isin(*listed)) if listed else F.slice("w", 1, 0))
    names = []
    for i, (lang, shares) in enumerate(common.items()):
        df = df.withColumn("mine", F.filter("common", lambda x: x.isin(*common[lang])))  # noqa: B023 - used at once
        df = df.withColumn(f"own{i}", F.transform(F.array(*map(F.lit, shares)), lambda k: F.size("mine") - F.size(F.array_remove("mine", k))))
        names.append(f"own{i}")
    return df.drop("text", "w", "common", "mine", *[k for k in kinds if k != "n_space"])


def class_shares(rows: DataFrame) -> dict:
    """For each language the shares of the seven classes, over documents that the base rules don't fail."""
    sums = rows.where("lang is not null and not base_failed").groupBy("lang").agg(*[F.sum(F.get("classes", F.lit(i)).cast("long")).alias(f"c{i}") for i in range(7)])
    found = {r["lang"]: [r[f"c{i}"] for i in range(7)] for r in sums.orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {lang: [x / sum(n) for x in n] for lang, n in found.items() if sum(n)}


def distances(rows: DataFrame, references: References) -> DataFrame:
    """rows with class_distance and word_distance, each from the nearest language's reference, in whole thousandths."""
    share = F.transform("classes", lambda n: n / F.greatest("n_chars", F.lit(1)))
    near = lambda found: F.floor(1000 * (F.least(*found) if len(found) > 1 else found[0])).cast("int") if found else F.lit(0)
    by_class = [divergence(v, F.col("_classes")) for v in references.classes.values()]
    by_word = []
    for i, shares in enumerate(references.words.values()):
        own = F.transform(f"own{i}", lambda n: n / F.greatest("n_words", F.lit(1)))
        rest = F.greatest(F.lit(0.0), 1 - F.aggregate(own, F.lit(0.0), lambda s, x: s + x))
        by_word.append(divergence([*shares.values(), max(0.0, 1 - sum(shares.values()))], F.concat(own, F.array(rest))))
    return rows.withColumn("_classes", share).withColumns({"class_distance": near(by_class), "word_distance": near(by_word)}).drop("_classes")


def limit(rows: DataFrame, distance: str) -> int:
    """FENCE times the middle half's width above the upper quartile of a distance, by its histogram of at most 1,001 values; 1000 without rows."""
    n = sorted((r[distance], r["count"]) for r in rows.groupBy(distance).count().collect())
    total, seen, quartiles = sum(c for _, c in n), 0, []
    for value, c in n:
        seen += c
        while len(quartiles) < 2 and 4 * seen >= (1, 3)[len(quartiles)] * total:
            quartiles.append(value)
    return int(quartiles[1] + FENCE * (quartiles[1] - quartiles[0])) if total else 1000


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, both distances (in thousandths), their limits and the verdict for each document."""
    common = common_words(docs)
    rows = materialise(counted(docs, common), "rules-counts")
    found = materialise(distances(rows, References(common, class_shares(rows))), "rules-distances")
    teaches = found.where("lang is not null and not base_failed")
    by_class, by_word = limit(teaches.where(F.col("n_chars") >= MIN_CHARS), "class_distance"), limit(teaches.where(F.col("n_words") >= MIN_WORDS), "word_distance")
    far = ((F.col("n_chars") >= MIN_CHARS) & (F.col("class_distance") > by_class)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > by_word))
    return found.select("doc_id", "n_words", (F.col("n_chars") - F.col("n_space")).cast("long").alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance", F.lit(by_class).alias("class_limit"), F.lit(by_word).alias("word_limit"))


def op7_rules_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over every document."""
    return judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance", "class_limit", "word_limit")


def _sql() -> str:
    """The query in DuckDB's SQL: it counts the same references and histograms from the table."""
    term = lambda a, b: f"case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0 end"
    half = f"0.5 * ({term('p', 'q')} + {term('q', 'p')})"
    punctuation = PUNCTUATION.replace("'", "''")
    kinds = ["[^a-z]", "[^A-Z]", "[^0-9]", rf"[^{WORD_SPACE}]", "[^" + re.escape(PUNCTUATION).replace("'", "''") + "]", "[^!-~]"]
    lengths = ", ".join(f"length(regexp_replace(t, '{k}', '', 'g')) k{i}" for i, k in enumerate(kinds))
    fence = lambda name, test: f"""
{name}_h as (select {name} v, count(*) c from dist where lang is not null and not failed and {test} group by 1),
{name}_s as (select v, sum(c) over (order by v) seen, sum(c) over () total from {name}_h),
{name}_l as (select coalesce(cast(floor(u + {FENCE} * (u - l)) as bigint), 1000) top from (select min(v) filter (where 4 * seen >= total) l, min(v) filter (where 4 * seen >= 3 * total) u from {name}_s))"""  # noqa: E731
    return rf"""
with d as (select row_number() over () rid, doc_id, lang, coalesce(text, '') t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[{WORD_SPACE}]+'), lambda x: x <> '') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{WORD_SPACE}]')) l from d),
g as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] k from (select rid, w, unnest(range(1, len(w) - 1)) i from w)),
r as (select rid, i from g qualify count(*) over (partition by rid, k) > 1),
v as (select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from r) group by 1),
c as (select w.rid, doc_id, lang, length(t) n_chars, len(w) n_words, {lengths}, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines, coalesce(v.n, 0) n_repeat_words from w left join v on v.rid = w.rid),
s as (select *, list_transform([k0, k1, k2, k3, k4, k5 - k0 - k1 - k2 - k4, greatest(0, n_chars - k3 - k5)], lambda k: cast(k as double)) classes, n_words < 50 or 100 * n_repeat_words > 50 * n_words failed from c),
x as (select rid, lang, n_chars, lower(trim(word, '{punctuation}')) x from (select w.rid, w.lang, n_chars, unnest(w.w) word from w join s using (rid))),
n as (select lang, x, count(*) n from x where lang is not null and n_chars >= {MIN_CHARS} and x <> '' group by 1, 2),
top as (select lang, x, n / total share from (select *, sum(n) over (partition by lang) total from n) qualify row_number() over (partition by lang order by n desc, x) <= {WORDS}),
own as (select rid, top.lang, top.x, count(*) n from x join top on top.x = x.x group by 1, 2, 3),
pairs as (select s.rid, top.lang, top.share p, coalesce(own.n, 0) / greatest(s.n_words, 1) q from s cross join top left join own on own.rid = s.rid and own.lang = top.lang and own.x = top.x),
whole as (select rid, lang, p, q from pairs union all select rid, lang, greatest(0, 1 - sum(p)), greatest(0, 1 - sum(q)) from pairs group by 1, 2),
word as (select rid, cast(floor(1000 * min(m)) as bigint) word_distance from (select rid, lang, sqrt(greatest(0, sum({half}))) m from whole group by 1, 2) group by 1),
ref as (select lang, i, sum(classes[i]) n from s, range(1, 8) t(i) where lang is not null and not failed group by 1, 2),
refs as (select lang, i, n / sum(n) over (partition by lang) p from ref),
cls as (select rid, cast(floor(1000 * min(m)) as bigint) class_distance from (select rid, lang, sqrt(greatest(0, sum({half}))) m from (select s.rid, refs.lang, p, classes[i] / greatest(n_chars, 1) q from s cross join refs) group by 1, 2) group by 1),
dist as (select s.*, coalesce(class_distance, 0) class_distance, coalesce(word_distance, 0) word_distance from s left join cls using (rid) left join word using (rid)),
{fence("class_distance", f"n_chars >= {MIN_CHARS}")}, {fence("word_distance", f"n_words >= {MIN_WORDS}")}
select doc_id, cast(n_words as bigint) as n_words, cast(n_chars - k3 as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, failed as base_failed,
       not failed and not (n_chars >= {MIN_CHARS} and class_distance > class_distance_l.top or n_words >= {MIN_WORDS} and word_distance > word_distance_l.top) as kept from dist, class_distance_l, word_distance_l"""


QUERIES = {"op7_rules_divergence": op7_rules_divergence}
ORACLES = {"op7_rules_divergence": _sql()}
