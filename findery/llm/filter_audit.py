"""Interaction of document filters (operator 13): what each order of the filters removes, and each filter's Shapley value.

A filter fails a document or not, so a document is a mask of the filters that fail it, and a part of the corpus is
told by its counts of masks. For a part with n(m) documents of mask m, the number removed by a set of filters is the
corner of the multilinear polynomial

    R(x) = sum over m of n(m) (1 - product over i in m of (1 - x_i)) = sum over T of c(T) product over i in T of x_i,
    c(T) = (-1)^(|T|+1) sum over m >= T of n(m)   for T not empty, c({}) = 0.

Corners give the survivors of every prefix of every order. A filter's share over all orders is the integral of dR/dx_i
along the diagonal, sum over T with i of c(T) / |T| as exact rationals; times 120 it is a whole number for five filters.

Texts are read once; what is kept of a document is its id, part, mask and a digest of its text. Equal texts are found
by the digest's smallest id, and whether a document is that first one is an equi-join on digest and id together, so
that a group of copies of any size is spread. Parts have at most 2^5 masks, whatever their documents.

Defined results: a null text is empty (and equal to other empty ones); a null part is the empty string; a row without
an id is never equal to a smaller one's text, and none is equal to its; repeated rows count as documents each, and
rows of the smallest id with a text are first, all of them; a document with several labels has a label if one of its
rows does; null labels are none; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UPPER, releasing, small_batches, stored, table

#: The filters in the order of their bits; E needs the whole corpus, the others the text alone.
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT, MAX_UPPER = 50, 2  # percent of words, of code points
SYMBOLS = b"#$%&*|"
CONTINUATION = bytes(range(0x80, 0xC0))


def text_mask(body: bytes) -> int:
    """Bits of the filters A to D that fail a text in UTF-8."""
    words = body.split()  # splits at the six ASCII blanks and at nothing else
    upper = len(body) - len(body.translate(None, UPPER.encode()))
    points = len(body.translate(None, CONTINUATION))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT * len(words),
        100 * upper > MAX_UPPER * points,
        len(body.translate(None, SYMBOLS)) < len(body),
    )
    return sum(f << i for i, f in enumerate(fails))


def measured(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc, part, digest, mask, n): one row for each different document, n for repeated rows."""
    small_batches(docs.sparkSession)
    body = F.col(text_col).cast("string").cast("binary")
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), body.alias("body"))

    def run(batches):
        for batch in batches:
            masks, digests = [], []
            for body in batch.column(2):
                body = body.as_py() or b""
                masks.append(text_mask(body))
                digests.append(hashlib.blake2b(body, digest_size=16).digest())
            columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "part", "digest", "mask"])

    kind = T.StructType([*rows.schema.fields[:2], T.StructField("digest", T.BinaryType()), T.StructField("mask", T.IntegerType())])
    return rows.mapInArrow(releasing(run), kind).groupBy("doc", "part", "digest", "mask").agg(F.count("*").alias("n"))


def mask_counts(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
    good_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """(part, mask, docs, good, toxic): documents of each part and mask of failed filters, and those with a label."""
    rows = stored(measured(docs, id_col, text_col, part_col))
    first = rows.where("doc IS NOT NULL").groupBy("digest").agg(F.min("doc").alias("doc"))
    has = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.groupBy(F.col(id_col).alias("doc")).agg(has(good_col).alias("good"), has(toxic_col).alias("toxic"))
    found = rows.join(known, "doc", "left").join(first.withColumn("first", F.lit(True)), ["doc", "digest"], "left")
    copy = F.col("doc").isNotNull() & F.col("first").isNull()
    mask = F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    count = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return found.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("docs"), count("good"), count("toxic"))


def polynomial(counts: dict[int, int], k: int) -> list[int]:
    """Coefficients c(T) of the removal polynomial, by the bits of T, from the counts of masks."""
    above = [counts.get(m, 0) for m in range(1 << k)]
    for i in range(k):  # sums over all masks that hold T
        for m in range(1 << k):
            if not m >> i & 1:
                above[m] += above[m | 1 << i]
    return [0] + [above[t] * (1 if t.bit_count() % 2 else -1) for t in range(1, 1 << k)]


def corner(poly: list[int], chosen: int) -> int:
    """The polynomial where the chosen variables are 1 and the others 0: what those filters remove."""
    total, t = 0, chosen
    while t:
        total += poly[t]
        t = (t - 1) & chosen
    return total


def shapley(poly: list[int], i: int) -> Fraction:
    """The integral of the partial derivative by x_i along the diagonal from 0 to 1."""
    return sum((Fraction(c, t.bit_count()) for t, c in enumerate(poly) if t >> i & 1), Fraction(0))


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_part(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """(order, step, COLUMNS...) of every order of the filters, from (documents, good, toxic) of each mask."""
    k = len(filters)
    docs, good, toxic = (polynomial({m: c[j] for m, c in counts.items()}, k) for j in range(3))
    total, whole = sum(c[0] for c in counts.values()), (1 << k) - 1
    removed = [[corner(p, s) for s in range(1 << k)] for p in (docs, good, toxic)]
    orders = list(permutations(range(k)))
    shares = [len(orders) * shapley(docs, i) for i in range(k)]
    assert all(s.denominator == 1 for s in shares)
    rows = []
    for order in orders:
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here = [r[after] - r[before] for r in removed]
            # the partial derivative at the corner of all other filters is what fails this one alone
            alone = removed[0][whole] - removed[0][whole ^ 1 << i]
            rows.append((name, step, total - removed[0][after], here[0], removed[0][1 << i] - here[0], alone, here[1], here[2], int(shares[i])))
            before = after
    return rows


def audit(docs: DataFrame, labels: DataFrame, filters: str = FILTERS, **columns) -> DataFrame:
    """(part, filter_order, step, COLUMNS...): 120 orders of five steps for every part."""
    counts = mask_counts(docs, labels, **columns)
    each = F.struct("mask", "docs", "good", "toxic")
    parts = counts.groupBy("part").agg(F.collect_list(each).alias("masks"))  # at most 2^5 of a part

    def run(frames):
        for frame in frames:
            for part, masks in zip(frame["part"], frame["masks"]):
                rows = audit_part({m["mask"]: (m["docs"], m["good"], m["toxic"]) for m in masks}, filters)
                out = pd.DataFrame(rows, columns=["filter_order", "step", *COLUMNS])
                out.insert(0, "part", part)
                yield out

    return parts.mapInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every order walked step by step over the counts of masks; shares are sums over the 120 orders.
ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
worded AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM docs),
known AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM worded LEFT JOIN known USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f) JOIN letters d ON d.f NOT IN (a.f, b.f, c.f)
  JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
walked AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN docs ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN docs ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN docs ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN docs ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit, before)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM walked
"""
