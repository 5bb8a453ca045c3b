"""Personal data and information-theoretic sanitisation (operator 5). DataFrame functions only.

Patterns find the protected entities (e-mail, IP, card, phone). Which words give an entity away is estimated
from the whole corpus: for a term t in the documents of entity e, with document counts n(t), n(e), n(t, e) among
N documents, the pointwise mutual information is set against the entity's information content,

    disclosure(t, e) = log(n(t, e) N / (n(t) n(e))) / log(N / n(e)),

1 if the term stands with the entity alone. A term whose disclosure exceeds a threshold, whose company with the
entity is not chance, and from which the entity follows with even odds at least, is sanitised wherever it stands:
removed if it discloses all, else generalised to a class of words. The odds come from the posterior n(t, e) / (n(t) + 1),
with one document more that holds the term alone: a rare word that an entity's only document shares with another
document by accident tells nothing and stays. Chance is the bound exp(-n(e) KL(n(t, e) / n(e) || n(t) / N)) of as much
company among independent documents, times the terms that were tried with the entity. So one document is enough in a
large corpus and none is in a small one, and a neighbourhood repeated word for word counts in each document.

Texts are read three times and never stored or shuffled. The first reading finds the entities and keeps the words of
documents that hold one. All bounds fall as n(t) grows, so the documents with entities alone tell which terms can still
pass; the second reading counts those among all documents, the third places those that passed. Words on their way meet a
table of bits first, whose size is bounded and follows the number of terms, and of the few that pass it the terms are
told by a join.

Defined results: a null or empty text has no spans; repeated rows count as a document each and give one result
each; an entity that all documents hold has no information to disclose; terms that overlap an entity's span
are not reported; an empty table gives an empty result; other columns are kept or ignored whatever their
names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPAN, among, bits_of, count_kind, kept_spans, let, running, span_list, stored, table, wrapped

#: The patterns start where a longer match of the same run could not have started, and never back up.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ["email", "ip", "card", "phone"]
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Probability below which the company of a term and an entity is not chance.
CHANCE = 0.01
#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.85, 0.999
#: Posterior of the entity, given the term, from which the term is sanitised.
POSTERIOR = 0.5

SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_CHAR = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    value = lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    total = F.aggregate(F.transform(F.split(F.reverse(number), ""), value), F.lit(0), lambda a, v: a + v)
    return total % 10 == 0


def card(hit: Column) -> Column:
    # a match of fewer characters cannot hold enough digits, and the longest has one separator a digit
    fits = let(digits(hit), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    return F.when(F.length(hit).between(12, 37), fits).otherwise(False)


def base_spans(text: Column) -> Column:
    return F.concat(
        kept_spans(text, "email", 0, EMAIL),
        kept_spans(text, "ip", 1, IP, lambda h: h.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z")),
        kept_spans(text, "card", 2, CARD, card),
        kept_spans(text, "phone", 3, PHONE, lambda h: F.length(digits(h)).between(9, 15)),
    )


def all_terms(text: Column) -> Column:
    """The different words of a text that are not numbers, lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SPLIT), lambda w: (w != "") & ~w.rlike("^[0-9]")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def counted(found: DataFrame) -> DataFrame:
    """(doc, text_hash, base, entities, tried, within, apart): the entities of each document, and of those that hold one the
    words, the words of the text that stand in an entity alone, and the words that are one only without the entity they touch."""
    text = replaced(F.col("text"), F.col("base"), dict.fromkeys(BASE, " "))
    value = lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    entity = lambda s: F.xxhash64(s["kind"], F.when(s["kind"] == "email", F.lower(value(s))).otherwise(digits(value(s))))
    some, none = F.size("base") > 0, F.array().cast("array<string>")
    rows = found.withColumn("tried", F.when(some, all_terms(text)).otherwise(none))
    split = let(all_terms(F.col("text")), lambda own: F.struct(F.array_except(own, F.col("tried")).alias("within"), F.array_except(F.col("tried"), own).alias("apart")))
    rows = rows.withColumn("_split", F.when(some, split).otherwise(F.struct(none.alias("within"), none.alias("apart"))))
    return rows.select("doc", "text_hash", "base", F.array_distinct(F.transform("base", entity)).alias("entities"), "tried", "_split.within", "_split.apart")


def _disclosing(pairs: DataFrame, n: float, chance: float, generalise: float, posterior: float) -> DataFrame:
    """The pairs of a term and an entity that pass all bounds with their n_t, and their disclosure. None passes with a larger n_t that
    does not with a smaller one."""
    ratio = F.col("n_te") * n / (F.col("n_t") * F.col("n_e"))
    without = F.col("n_e") - F.col("n_te")
    away = F.when(without > 0, without * F.log((without / F.col("n_e")) / (1 - F.col("n_t") / n))).otherwise(0.0)
    surprise = F.col("n_te") * F.log(ratio) + away - F.log("tests")
    likely = F.col("n_te") >= posterior * (F.col("n_t") + 1)
    sure = pairs.where((ratio > 1) & (F.col("n_t") < n) & (F.col("n_e") < n) & likely).where(surprise >= -math.log(chance))
    return sure.withColumn("disclosure", F.log(ratio) / F.log(n / F.col("n_e"))).where(F.col("disclosure") >= generalise)


def revealing(
    held: DataFrame, texts: DataFrame, chance: float = CHANCE, generalise: float = GENERALISE, posterior: float = POSTERIOR
) -> DataFrame:
    """(word, disclosure): the terms to sanitise."""
    n = float(held.count())
    of_doc = held.where(F.size("entities") > 0)
    holders = of_doc.select(F.explode("entities").alias("entity"), "tried")
    of_entity = holders.groupBy("entity").agg(F.count("*").alias("n_e"))
    with_entity = stored(holders.select("entity", F.explode("tried").alias("word")).groupBy("entity", "word").agg(F.count("*").alias("n_te")))
    tests = with_entity.groupBy("entity").agg(F.count("*").alias("tests"))
    inside = of_doc.select(F.explode("tried").alias("word")).groupBy("word").agg(F.count("*").alias("n_t"))
    pairs = with_entity.join(of_entity.join(tests, "entity"), "entity").join(inside, "word")
    # the documents with entities alone rule most pairs out
    possible = stored(_disclosing(pairs, n, chance, generalise, posterior).drop("n_t", "disclosure"))
    bits = bits_of(stored(possible.select(F.xxhash64("word").alias("h")).distinct()))
    seen = texts.select(F.explode(all_terms(F.col("text"))).alias("word")).withColumn("h", F.xxhash64("word"))
    everywhere = among(seen, bits).groupBy("word").agg(F.count("*").alias("n_all"))
    # the texts count words in entities too, and not those that an entity touches: n_t is exact, so never below n_te
    by = lambda c, n: of_doc.select(F.explode(c).alias("word"), F.lit(n).alias("n"))
    beside = by("within", -1).union(by("apart", 1)).groupBy("word").agg(F.sum("n").alias("n_beside"))
    n_t = F.coalesce("n_all", F.lit(0)) + F.coalesce("n_beside", F.lit(0))
    told = possible.join(everywhere, "word", "left").join(beside, "word", "left").withColumn("n_t", n_t)
    return _disclosing(told, n, chance, generalise, posterior).groupBy("word").agg(F.max("disclosure").alias("disclosure"))


def placed_words(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep..., start, end, word): every word of a text in lower case with its place."""
    # a word and what follows it up to the next one
    steps = F.transform(F.regexp_extract_all(text, F.lit(rf"{WORD_CHAR}++(?:(?!{WORD_CHAR})(?s:.))*+"), F.lit(0)), lambda t: F.length(t))
    words = F.filter(F.split(text, SPLIT), lambda w: w != "")
    cut = rows.select(*keep, words.alias("_words"), steps.alias("_steps"), F.length(text).alias("_length"))
    left = let(F.col("_steps"), lambda s: let(running(s), lambda ends: F.zip_with(s, ends, lambda n, e: e - n - F.coalesce(F.element_at(ends, -1), F.lit(0)))))
    # places from the end of the text, as every step but the last ends where a word begins
    span = lambda w, a: F.struct((F.col("_length") + a).alias("start"), (F.col("_length") + a + F.length(w)).alias("end"), F.lower(w).alias("word"))
    return cut.select(*keep, F.inline(F.zip_with("_words", left, span)))


def find_pii(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chance: float = CHANCE,
    generalise: float = GENERALISE, remove: float = REMOVE,
) -> DataFrame:
    """(doc, text_hash, base, more): the entities of each document, and the spans of terms that reveal one:
    kind term to generalise and kind reveal to remove."""
    rows = _keyed(docs, id_col, text_col)
    held = stored(counted(rows.withColumn("base", base_spans(F.col("text")))))
    removed = F.col("disclosure") >= remove
    flagged = stored(revealing(held, rows, chance, generalise).select("word", removed.alias("removed")))
    base = held.select("doc", "text_hash", "base")
    if flagged.isEmpty():
        return base.withColumn("more", F.array().cast(SPAN))
    bits = bits_of(flagged.select(F.xxhash64("word").alias("h")))
    near = among(placed_words(rows, F.col("text"), "doc", "text_hash").withColumn("h", F.xxhash64("word")), bits).drop("h")
    span = F.struct(
        "start", F.when(F.col("removed"), 5).otherwise(4).alias("rank"), "end", F.when(F.col("removed"), "reveal").otherwise("term").alias("kind")
    )
    spans = near.join(flagged, "word").groupBy(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_set(span).alias("more"))
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    out = base.join(stored(spans), same, "left").withColumn("more", F.coalesce("more", F.array().cast(SPAN)))
    clear = lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    return out.select("doc", "text_hash", "base", F.filter("more", clear).alias("more"))


#: What stands for a span in a sanitised text; what reveals all is removed.
STANDS_FOR = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "reveal": ""}


def replaced(text: Column, spans: Column, stands_for: dict[str, str] = STANDS_FOR) -> Column:
    """The text with every span replaced; of spans that overlap, the first in order counts."""
    names = F.create_map(*[F.lit(x) for pair in stands_for.items() for x in pair])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
        F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), names[s["kind"]])).alias("out"),
        )
    )
    return F.aggregate(
        F.array_sort(spans), start, step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The documents with entities replaced by their class and revealing terms generalised or removed; all columns stay."""
    spans = find_pii(docs, id_col=id_col, text_col=text_col, **limits)
    marked = spans.where(F.size(F.concat("base", "more")) > 0).select(
        F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"), F.concat("base", "more").alias("_spans")
    )
    marked = stored(marked.dropDuplicates(["_doc", "_hash"]))
    # rows that hold nothing pass by the join
    bits = bits_of(marked.select(F.xxhash64("_doc", "_hash").alias("h")))
    rows = wrapped(docs, id_col, text_col).withColumn("h", F.xxhash64("doc", "text_hash"))
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    text = F.col("row")[text_col].cast("string")
    new = F.when(F.col("_spans").isNull(), text).otherwise(replaced(text, F.col("_spans")))
    changed = among(rows, bits).join(marked, same, "left").select(F.col("row").withField(text_col, new).alias("row"))
    return among(rows, bits, inside=False).select(F.col("row").withField(text_col, text).alias("row")).union(changed).select("row.*")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"), *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.concat("base", "more")).alias("spans"),
    )
