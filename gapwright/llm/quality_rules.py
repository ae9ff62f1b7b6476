"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Base counts of a text are columns; a rule is a condition that rejects. ``estimate`` times every rule on a bounded
sample and counts what it rejects there; ``cascade`` orders rules by rejections per cost and builds one CASE WHEN, of
which Spark evaluates no branch behind the first that holds. The order changes what is evaluated, never the verdict.

Defined results: a null or empty text has no words, so every count is 0, ``base_failed`` holds and it isn't kept; rows
are judged alone, so repeated rows and ties get equal verdicts; an empty table gives no rows, and its cascade keeps
the order in which rules were given; other columns are kept, those with an added column's name are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words, symbol characters, the base's limits, the rules' limits.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT = 20, 8, 30
#: The sample's rows and the bytes of a text in it (32 MB at most); evaluations of a row in a run; runs that count.
SAMPLE, SAMPLE_BYTES, REPEATS, RUNS = 1000, 1 << 15, 4, 3


@dataclass(frozen=True)
class Rule:
    """``rejects`` is over the base counts and the columns ``__text`` and ``__words``."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: int


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value worked out once: a lambda's variable is never inlined into the lambdas in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{BLANK_CLASS}+"), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that are found twice or more, the first included. Windows are compared by 64-bit hashes."""

    def covered(windows: Column) -> Column:
        def marked(ranked: Column) -> Column:
            def twice(x, k):
                beside = [F.get(ranked, k + d)["h"] == x["h"] for d in (-1, 1)]
                return F.coalesce(beside[0], F.lit(False)) | F.coalesce(beside[1], F.lit(False))

            spots = F.array_sort(F.transform(F.filter(ranked, twice), lambda x: x["i"]))
            start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
            step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"))
            return F.aggregate(spots, start, step, lambda acc: acc["n"])

        ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ranked, marked))

    def hashed(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (window - 1))
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, window))), covered)

    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), hashed))


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``__text``, ``__words``, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and
    base_failed."""
    text, words = F.col("__text"), F.col("__words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = df.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumns({"__words": words_of(text), "__lines": lines})
    counted = counted.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeated_words(words).cast("long"),
    }).drop("__lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def matches(text: Column, pattern: str) -> Column:
    """Characters that a pattern of single characters matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def default_rules() -> list[Rule]:
    text, words, n = F.col("__text"), F.col("__words"), F.col("n_words")
    same = let(words, lambda w: F.size(F.filter(F.transform(w, lambda x, k: F.when(k > 0, F.get(w, k - 1) == x)), lambda x: x)))
    return [
        Rule("stutter", 100 * same > 20 * n),
        Rule("upper_case", 100 * matches(text, "\\p{Lu}") > 40 * matches(text, "\\p{L}")),
        Rule("exclamations", 100 * matches(text, "[!?]") > 50 * n),
        Rule("mean_word_length", (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n)),
        Rule("symbols", 100 * F.col("n_symbols") > 10 * n),
        Rule("duplicate_lines", 100 * F.col("n_dup_lines") > 40 * F.col("n_lines")),
    ]


def estimate(df: DataFrame, rules: list[Rule], text_col: str = "text", sample: int = SAMPLE) -> list[Estimate]:
    """Seconds and rejections of every rule over ``sample`` rows at most (it orders rules, and decides nothing).

    The sample is taken from the first partitions that have as many texts of at most SAMPLE_BYTES: no other is read, no
    exchange brings rows of every partition together, and its size is bounded by the two numbers. In a run a rule is
    evaluated REPEATS times on each row. Runs of the rules and of an empty condition over the same columns take turns,
    after one that warms up, so the machine's drift falls on all of them; a rule's cost is the median of its runs
    less that of the empty ones, and at least the spread of these, below which costs can't be told apart."""
    spark = df.sparkSession
    short = df.where(F.octet_length(F.col(text_col).cast("string")) <= SAMPLE_BYTES).select(F.col(text_col).cast("string").alias(text_col))
    taken = spark.createDataFrame(short.take(sample), f"`{text_col}` string")
    held = base_counts(taken, text_col).where(~F.col("base_failed")).persist()
    columns = [c for c in held.columns if c not in (text_col, "base_failed")]
    empty = F.lit(False)
    for c in columns:
        empty = empty | F.col(c).isNull()
    try:
        held.count()
        many = held.select(*columns, F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("__again")).drop("__again")
        runs: list[list[float]] = [[] for _ in range(len(rules) + 1)]
        rejected = [0] * len(rules)
        for run in range(RUNS + 1):
            for k, condition in enumerate([empty, *[r.rejects for r in rules]]):
                asked = many.agg(F.count_if(condition).alias("n"), F.count_if(empty).alias("read"))
                began = time.perf_counter()
                n = asked.collect()[0].n
                if run:
                    runs[k].append(time.perf_counter() - began)
                if k:
                    rejected[k - 1] = n // REPEATS
        idle = runs[0]
        least = max(max(idle) - min(idle), 1e-4)
        return [Estimate(r.name, max(median(runs[k + 1]) - median(idle), least), rejected[k]) for k, r in enumerate(rules)]
    finally:
        held.unpersist()


def ordered(rules: list[Rule], estimates: list[Estimate]) -> list[Rule]:
    """By rejections per second, the most first; of rules that reject nothing there the cheapest first."""
    worth = {e.name: (-e.rejected / e.seconds, e.seconds) for e in estimates}
    return sorted(rules, key=lambda r: worth[r.name])


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null; ``base`` stands before all."""
    chain = F.when(F.col("base_failed"), F.lit("base"))
    for r in rules:
        chain = chain.when(r.rejects, F.lit(r.name))
    return chain


def apply_rules(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample: int = SAMPLE) -> DataFrame:
    """``df`` with the base counts, ``rejected_by`` (depends on the order) and ``kept`` (does not)."""
    rules = default_rules() if rules is None else rules
    chain = cascade(ordered(rules, estimate(df, rules, text_col, sample)))
    judged = base_counts(df, text_col).withColumn("rejected_by", chain)
    return judged.withColumn("kept", F.col("rejected_by").isNull()).drop("__text", "__words")


def rules_query(docs: DataFrame) -> DataFrame:
    judged = apply_rules(docs.select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


RULES_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS win FROM w, unnest(range(1, greatest(len(ws) - 6, 1))) AS u(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 8) AS v(k) GROUP BY doc_id),
b AS (SELECT w.doc_id, x, ws, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  len(list_filter(range(2, n_words + 1), lambda i: ws[i] = ws[i - 1])) AS same,
  length(regexp_replace(x, '\P{Lu}', '', 'g')) AS upper_n, length(regexp_replace(x, '\P{L}', '', 'g')) AS letter_n,
  length(regexp_replace(x, '[^!?]', '', 'g')) AS bang_n FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * same > 20 * n_words OR 100 * upper_n > 40 * letter_n OR 100 * bang_n > 50 * n_words
    OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 100 * n_symbols > 10 * n_words
    OR 100 * n_dup_lines > 40 * n_lines) AS kept
FROM f
"""
