"""Secret scans: three fixed patterns, and runs of characters that a Markov model of random strings explains better.

Two character Markov models of order one are trained from labelled samples. Random strings are the values that the first
pattern finds (each once) and, for every document, digests of its id in base 64 and base 16, which are random by
construction. Ordinary identifiers are all runs of four characters or more of all texts that no pattern covers, each as
often as it occurs. Counts are smoothed by one. A run of RUN characters or more is a secret if its log-likelihood ratio
is at least that of a random string among a million ordinary ones (PRIOR); ratios are added in thousandths of a nat, as
integers, so the sum doesn't hang on its order.

All of it is Spark's own functions: a text is cut into pieces that each end with a match, so that running lengths of the
pieces give the places; the two models are counts of pairs of 67 characters and come to the driver as 9,112 at most.

Defined results: a null or empty text has no spans, and its digest is that of an empty string; rows are judged alone, so
repeated rows get equal results; a null id counts as the text ``null`` in the digests; places are code points; a span of
the models is added whether or not a pattern covers it too; an empty table gives no rows. Other columns are kept, those
with an added column's name are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let

#: The patterns of the base and the least lengths of what they find.
KEY = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
LEAST_VALUE = 8
KINDS = ("assign", "access", "hex", "random")
#: Characters of the models; the least run that is scored, and that is learnt from; random strings of a document; the
#: share of secrets among runs, which sets the threshold, in thousandths of a nat.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN, LEARNT, DIGESTS, PRIOR = 16, 4, 4, 1e-6
THRESHOLD = round(-1000 * math.log(PRIOR))
CLASS = "[A-Za-z0-9+/_=-]"
SIZE = len(ALPHABET) + 1
#: Pieces whose running lengths are added in one go.
CHUNK = 1024


def running(lengths: Column) -> Column:
    """Running sums of an array, in chunks, so that a long array isn't copied once for each of its elements."""
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<long>").alias("ends"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + n)).alias("ends"))
    sums = lambda part, at: F.aggregate(part, start(at), step, lambda acc: acc["ends"])
    zero = F.lit(0).cast("long")

    def over(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, n: a + n))
        return let(sums(totals, zero), lambda ends: F.flatten(F.transform(chunks, lambda c, k: sums(c, F.when(k > 0, F.get(ends, k - 1)).otherwise(zero)))))

    count = F.floor((F.size(lengths) + (CHUNK - 1)) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(1), count), lambda k: F.slice(lengths, (k - 1) * CHUNK + 1, F.lit(CHUNK)))
    return F.when(F.size(lengths) == 0, F.array().cast("array<long>")).otherwise(let(chunks, over))


def spans(text: Column, kind: int, pattern: str, holds: Callable[[Column], Column], first: str) -> Column:
    """Array of (start, kind, end) of the leftmost non-overlapping matches of ``pattern`` that hold. ``first``: a pattern
    that every text with a match contains. A match is the end of its piece."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def of(pieces: Column) -> Column:
        ends = running(F.transform(pieces, lambda p: F.length(p).cast("long")))
        found = F.transform(F.arrays_zip(pieces.alias("p"), ends.alias("e")), lambda z: F.struct(F.regexp_extract(z["p"], pattern, 0).alias("m"), z["e"].alias("e")))
        kept = F.filter(found, lambda z: (F.length(z["m"]) > 0) & holds(z["m"]))
        return F.transform(kept, lambda z: F.struct((z["e"] - F.length(z["m"])).alias("start"), F.lit(kind).alias("kind"), z["e"].alias("end")))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).*?(?:{pattern}|\\z)"), F.lit(0))
    return F.when(text.rlike(first), let(pieces, of)).otherwise(none)


def characters(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, i, 1))


def labelled_samples(texts: DataFrame) -> DataFrame:
    """run, label (1 random, 0 ordinary), n. ``texts``: id and text."""
    text = F.col("text")
    value = F.explode(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).alias("run")
    values = texts.where(text.rlike(KEY)).select(value).where((F.length("run") >= LEAST_VALUE) & ~F.col("run").rlike(f"[^{ALPHABET[:-1]}-]")).distinct()
    digest = lambda k: F.sha2(F.concat(F.coalesce("id", F.lit("null")), F.lit(f":{k}")), 256)
    strings = F.array(*[F.base64(F.unhex(digest(k))) for k in range(DIGESTS)], digest(DIGESTS))
    random = values.unionByName(texts.select(F.explode(strings).alias("run"))).select("run", F.lit(1).alias("label"), F.lit(1).cast("long").alias("n"))
    uncovered = F.when(text.rlike(KEY), F.regexp_replace(text, ASSIGN, " ")).otherwise(text)
    runs = texts.select(F.explode(F.regexp_extract_all(uncovered, F.lit(f"{CLASS}{{{LEARNT},}}"), F.lit(0))).alias("run"))
    ordinary = runs.where(~F.col("run").rlike(f"{ACCESS}|{HEX}")).groupBy("run").agg(F.count("*").alias("n"))
    return random.unionByName(ordinary.select("run", F.lit(0).alias("label"), "n"))


def pair_counts(samples: DataFrame) -> DataFrame:
    """label, pair, n: a character and the one before it; the first of a run stands alone."""
    held = samples.withColumn("c", characters(F.col("run")))
    pairs = F.transform("c", lambda c, i: F.concat(F.when(i > 0, F.get("c", i - 1)).otherwise(F.lit("")), c))
    return held.select("label", "n", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.sum("n").alias("n"))


def log_ratios(counts: DataFrame) -> list[int]:
    """Thousandths of a nat by which the random model likes a character better, at [place before * SIZE + place]."""
    n = [[0] * (SIZE * SIZE) for _ in range(2)]
    for r in counts.collect():  # two models of at most 67 * 68 pairs
        before = ALPHABET.index(r.pair[0]) + 1 if len(r.pair) == 2 else 0
        n[r.label][before * SIZE + ALPHABET.index(r.pair[-1]) + 1] = r.n
    sums = [[sum(model[k * SIZE : (k + 1) * SIZE]) for k in range(SIZE)] for model in n]

    def log(label, k):
        return math.log((n[label][k] + 1) / (sums[label][k // SIZE] + len(ALPHABET)))

    return [round(1000 * (log(1, k) - log(0, k))) for k in range(SIZE * SIZE)]


def log_ratio(run: Column, ratios: Column) -> Column:
    """The log-likelihood ratio of a run of ALPHABET, in thousandths of a nat."""
    places = F.transform(characters(run), lambda c: F.position(c, F.lit(ALPHABET)))

    def total(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.get(ratios, F.when(i > 0, F.get(at, i - 1)).otherwise(F.lit(0)) * SIZE + x))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return let(places, total)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Log ratios of the two models over all of ``docs``."""
    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return log_ratios(pair_counts(labelled_samples(texts)))


def find(docs: DataFrame, ratios: list[int], text_col: str = "text", threshold: int = THRESHOLD, out: str = "secrets") -> DataFrame:
    """``docs`` with ``out``: array of (start, kind, end), in order; kind is a place in KINDS."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    always = lambda m: F.lit(True)
    found = F.concat(
        spans(text, 0, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE, KEY),
        spans(text, 1, ACCESS, always, ACCESS),
        spans(text, 2, HEX, always, HEX),
        spans(text, 3, f"{CLASS}{{{RUN},}}", lambda m: log_ratio(m, table) >= threshold, f"{CLASS}{{{RUN}}}"),
    )
    return docs.withColumn(out, F.array_sort(found))


def written_out(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_query(docs: DataFrame) -> DataFrame:
    asked = docs.select("doc_id", "text")
    held = find(asked, train(asked)).drop("text")
    many = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = written_out(F.filter("secrets", lambda s: s["kind"] < 3))
    return held.select("doc_id", many(0).alias("n_assign"), many(1).alias("n_access"), many(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), written_out(F.col("secrets")).alias("spans"))


_ASSIGN = ASSIGN.replace("'", "''")
SECRETS_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS x FROM documents),
v AS (SELECT DISTINCT run FROM (SELECT unnest(regexp_extract_all(x, '{_ASSIGN}', 2)) AS run FROM t)
  WHERE length(run) >= {LEAST_VALUE} AND NOT contains(run, '.')),
dg AS (SELECT sha256(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || k) AS h, k FROM t, range(0, {DIGESTS + 1}) AS u(k)),
m AS (SELECT run, 1 AS label, 1 AS n FROM v UNION ALL SELECT CASE WHEN k < {DIGESTS} THEN to_base64(unhex(h)) ELSE h END, 1, 1 FROM dg
  UNION ALL SELECT run, 0, count(*) FROM (SELECT unnest(regexp_extract_all(regexp_replace(x, '{_ASSIGN}', ' ', 'g'), '{CLASS}{{{LEARNT},}}')) AS run FROM t)
    WHERE NOT regexp_matches(run, '{ACCESS}|{HEX}') GROUP BY run),
p AS (SELECT label, CASE WHEN i > 1 THEN run[i - 1] ELSE '' END AS a, run[i] AS b, sum(n) AS n FROM m, unnest(range(1, length(run) + 1)) AS u(i) GROUP BY ALL),
ab AS (SELECT unnest(string_split('{ALPHABET}', '')) AS c),
w AS (SELECT ca.c AS a, cb.c AS b, CAST(round(1000 * (ln((coalesce(r.n, 0) + 1) / (coalesce(rs.n, 0) + {len(ALPHABET)})) - ln((coalesce(o.n, 0) + 1) / (coalesce(os.n, 0) + {len(ALPHABET)})))) AS BIGINT) AS w
  FROM (SELECT c FROM ab UNION ALL SELECT '') ca CROSS JOIN ab cb LEFT JOIN (SELECT * FROM p WHERE label = 1) r ON r.a = ca.c AND r.b = cb.c
  LEFT JOIN (SELECT * FROM p WHERE label = 0) o ON o.a = ca.c AND o.b = cb.c
  LEFT JOIN (SELECT a, sum(n) AS n FROM p WHERE label = 1 GROUP BY a) rs ON rs.a = ca.c
  LEFT JOIN (SELECT a, sum(n) AS n FROM p WHERE label = 0 GROUP BY a) os ON os.a = ca.c),
c AS (SELECT row_id, kind, name, pat, unnest(g) AS piece, unnest(range(1, len(g) + 1)) AS i FROM (
    SELECT row_id, 0 AS kind, 'assign' AS name, '{_ASSIGN}' AS pat, regexp_extract_all(x, '(?s).*?(?:{_ASSIGN}|\z)') AS g FROM t UNION ALL
    SELECT row_id, 1, 'access', '{ACCESS}', regexp_extract_all(x, '(?s).*?(?:{ACCESS}|\z)') FROM t UNION ALL
    SELECT row_id, 2, 'hex', '{HEX}', regexp_extract_all(x, '(?s).*?(?:{HEX}|\z)') FROM t UNION ALL
    SELECT row_id, 3, 'random', '{CLASS}{{{RUN},}}', regexp_extract_all(x, '(?s).*?(?:{CLASS}{{{RUN},}}|\z)') FROM t)),
e AS (SELECT row_id, kind, name, CAST(sum(length(piece)) OVER (PARTITION BY row_id, kind ORDER BY i) AS BIGINT) AS stop,
  CASE kind WHEN 0 THEN regexp_extract(piece, '{_ASSIGN}') WHEN 1 THEN regexp_extract(piece, '{ACCESS}') WHEN 2 THEN regexp_extract(piece, '{HEX}')
    ELSE regexp_extract(piece, '{CLASS}{{{RUN},}}') END AS m, i FROM c),
f AS (SELECT *, stop - length(m) AS start FROM e WHERE m <> '' AND (kind <> 0 OR length(regexp_extract(m, '{_ASSIGN}', 2)) >= {LEAST_VALUE})),
s AS (SELECT row_id, i, sum(w.w) AS ratio FROM (SELECT row_id, i, m, unnest(range(1, length(m) + 1)) AS j FROM f WHERE kind = 3) q
  JOIN w ON w.a = CASE WHEN j > 1 THEN m[j - 1] ELSE '' END AND w.b = m[j] GROUP BY row_id, i),
h AS (SELECT f.* FROM f LEFT JOIN s ON f.kind = 3 AND s.row_id = f.row_id AND s.i = f.i WHERE f.kind < 3 OR s.ratio >= {THRESHOLD}),
o AS (SELECT row_id, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex,
  string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base,
  string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM h GROUP BY row_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN o USING (row_id)
"""
