"""LM scoring with a gated recurrent model (operator 2).

Steps, all over whole texts: (1) tokens of the training documents are counted, in Arrow batches and then by a
shuffle; (2) the most frequent words, a bounded head, get a learned softmax, the others share classes by their
shape, with the share of unseen words in each class by Good-Turing; (3) the model is trained over all training
documents in rounds: each task trains a copy on its documents, and a round ends with the average of the copies,
weighted by tokens and computed by Spark; (4) every document is scored in one pass, its state carried from its
first token to its end; (5) the counts of words outside a bounded dictionary come from a join
by 64-bit hashes; words that share one count as one.

As in the base, all words unseen in training are one symbol in each class. Reaches the driver: the dictionary,
the statistics of the classes and the parameters, all of fixed size. Copies are trained on what Spark puts in a task, so
scores depend, a little, on how the input is partitioned; the counts and the base do not.

Defined results: a null or empty text is its end token alone; without training documents counts are zero and the
model is its start; repeated rows give one result each (as training documents each counts); null ids are held
out, as no crc32 gives them a remainder; an empty table gives an empty result; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gru
from .common import LOWER_BYTES, releasing, small_batches, stored, table

END = b""
#: Words with their own softmax output, and words whose counts are broadcast.
HEAD, DICTIONARY = 1024, 65_536
#: Count ranges for each factor of e, to cut the dictionary at.
RANGES = 50
#: Classes of the other words: a bucket of the first letter beyond ASCII, the last character's kind, the length.
BUCKETS, KINDS, LENGTHS = 4, 4, 2
TAILS = BUCKETS * KINDS * LENGTHS
#: Rounds of training, each over its share of the training documents.
ROUNDS = 3
HELD_OUT, FOLDS = 0, 10
#: Words remembered in a task, and words counted before a task hands its counts on.
REMEMBERED, COUNTED = 400_000, 400_000
#: Means of the tasks' parameters that are taken apart into rows.
MERGED = 16
#: Tokens trained or scored together.
TOGETHER = 4_000_000
SMOOTH = 0.1


def tokens(body: bytes | None) -> list[bytes]:
    """The words of a text; the end token is not among them."""
    return (body or b"").translate(LOWER_BYTES).split()


def kind(last: str) -> int:
    return 0 if last.isalpha() else 1 if last in ".,;:!?" else 3 if last.isdigit() else 2


ASCII_KINDS = [kind(chr(b)) for b in range(128)]


def shape(word: bytes) -> int:
    """The class of a word outside the head."""
    if word.isascii():
        return ASCII_KINDS[word[-1]] * LENGTHS + (len(word) > 7)
    text = word.decode(errors="replace")
    bucket = next((1 + ord(c) % (BUCKETS - 1) for c in text if ord(c) > 127), 0)
    return (bucket * KINDS + kind(text[-1])) * LENGTHS + (len(text) > 7)


class WordIds(dict):
    """Word to id: its place among the given words, or len(given) + class; the memory of the others is bounded."""

    def __init__(self, given: list[bytes]) -> None:
        super().__init__((w, i) for i, w in enumerate(given))
        self.given = given

    def __missing__(self, word: bytes) -> int:
        if len(self) >= len(self.given) + REMEMBERED:
            self.clear()
            self.update((w, i) for i, w in enumerate(self.given))
        self[word] = i = len(self.given) + shape(word)
        return i


class RareIds(dict):
    """Word to id: its place among the given words, or len(given) + its place in a memory of other words."""

    def __init__(self, given: list[bytes]) -> None:
        self.given = given
        self.clear_memory()

    def clear_memory(self) -> None:
        self.clear()
        self.update((w, i) for i, w in enumerate(self.given))
        self.hashes: list[int] = []
        self.classes: list[int] = []

    def trim(self) -> None:
        """Forget the other words if they are many; ids given before are void then."""
        if len(self.hashes) > REMEMBERED:
            self.clear_memory()

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.given) + len(self.hashes)
        self.hashes.append(signed_hash(word))
        self.classes.append(shape(word))
        return i

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.hashes, dtype=np.int64), np.array(self.classes, dtype=np.int32)


def encode(ids: dict, words: list[bytes]) -> np.ndarray:
    return np.array([*map(ids.__getitem__, words), 0], dtype=np.int32)  # the end is the first of the given words


def gathered(batches: Iterator[tuple[object, list[np.ndarray]]]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """What comes with some batches, and their documents, TOGETHER tokens or more at a time."""
    held, docs = [], []
    for what, more in batches:
        held.append(what)
        docs += more
        if sum(map(len, docs)) >= TOGETHER:
            yield held, docs
            held, docs = [], []
    if held:
        yield held, docs


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text_hash, held, body): held is whether the document is held out."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    held = F.coalesce(fold == HELD_OUT, F.lit(True))
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), held.alias("held"), text.cast("binary").alias("body"))


def word_counts(training: DataFrame) -> DataFrame:
    """(word, shape, n) over (body) rows; the word is bytes, the end is empty and has shape -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            kinds = [shape(w) if w else -1 for w in counts]
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(kinds, pa.int32()), pa.array(list(counts.values()), pa.int64())],
                names=["word", "shape", "n"],
            )
            counts.clear()
            return out

        for batch in batches:
            for body in batch.column(0):
                counts.update(tokens(body.as_py()))
                counts[END] += 1
                if len(counts) > COUNTED:
                    yield handed()
        if counts:
            yield handed()

    found = training.select("body").mapInArrow(releasing(run), "word binary, shape int, n long")
    return found.groupBy("word", "shape").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What the driver knows of the counts; all of it of bounded size."""

    def __init__(self, counts: DataFrame) -> None:
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.n, self.v = int(total[0]), int(total[1])
        # the dictionary: words from a count on, found from a table of count ranges (at most some thousand rows)
        ranged = counts.where("shape >= 0").withColumn("range", F.floor(F.log(F.col("n")) * RANGES))
        sizes = sorted(((int(r[0]), int(r[1])) for r in ranged.groupBy("range").count().collect()), reverse=True)
        least, size = math.inf, 0
        for at, words in sizes:
            if size + words > DICTIONARY:
                break
            least, size = at, size + words
        top = ranged.where(F.col("range") >= least).select("word", "n").collect() if size else []
        top.sort(key=lambda r: (-r["n"], bytes(r["word"])))
        ends = counts.where("shape < 0").first()
        self.counts = {END: int(ends["n"]) if ends else 0} | {bytes(r["word"]): int(r["n"]) for r in top}
        filler = [f" {i}".encode() for i in range(HEAD)]  # no word holds a space
        self.head = ([END] + [bytes(r["word"]) for r in top[: HEAD - 1]] + filler)[:HEAD]
        self.head_counts = np.array([self.counts.get(w, 0) for w in self.head], dtype=float)
        by_shape = counts.where("shape >= 0").groupBy("shape").agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect()
        in_head = np.zeros((2, TAILS))
        for w in self.head:
            if w and not w.startswith(b" "):
                in_head[:, shape(w)] += [self.counts[w], self.counts[w] == 1]
        sums, once = np.zeros(TAILS), np.zeros(TAILS)
        for r in by_shape:
            sums[r["shape"]], once[r["shape"]] = int(r["n"]), int(r["once"])
        self.tail_counts = sums - in_head[0]
        unseen = (once - in_head[1] + 0.5) / (self.tail_counts + 1)
        #: log10 P(unseen | class), and what a seen word's log10 count is added to.
        self.log_unseen = np.log10(unseen)
        self.log_seen = np.log10(1 - unseen) - np.log10(np.maximum(self.tail_counts, 1))
        self.log_total = math.log10(self.n + SMOOTH * (self.v + 1))


def averaged(copies: DataFrame) -> DataFrame:
    """(seen, p): the copies of the parameters in at most MERGED means, weighted by tokens; a copy is added as it comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = 0, None
        for batch in batches:
            for n, p in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = n * p.values.to_numpy()
                seen, total = seen + n, part if total is None else total + part
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([total / seen], pa.list_(pa.float64()))], names=["seen", "p"])

    return copies.repartition(MERGED).mapInArrow(releasing(run), copies.schema)


def train(training: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters after `rounds` averages; every training document is seen once."""
    start = gru.init(HEAD, TAILS, vocab.head_counts, vocab.tail_counts)
    params, head = start, vocab.head
    for r in range(rounds):
        now = gru.flat(params)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            model, ids, seen = gru.Model(gru.shaped(now.copy(), start), 0), WordIds(head), 0
            for _, docs in gathered((None, [encode(ids, tokens(x.as_py())) for x in batch.column(0)]) for batch in batches):
                model.train(docs)
                seen += sum(map(len, docs))
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seen], pa.int64()), pa.array([gru.flat(model.p).astype(float)], pa.list_(pa.float64()))], names=["seen", "p"]
                )

        share = training.where(F.pmod(F.xxhash64("doc", "text_hash"), F.lit(rounds)) == r).select("body")
        copies = averaged(share.mapInArrow(releasing(run), "seen long, p array<double>")).select("seen", F.posexplode("p").alias("i", "x"))
        mean = copies.groupBy("i").agg((F.sum(F.col("x").cast("double") * F.col("seen")) / F.sum("seen")).alias("x"))
        found = mean.toArrow()  # as many rows as the model has parameters
        if found.num_rows:
            vector = np.empty(len(now))
            vector[found.column("i").to_numpy()] = found.column("x").to_numpy()
            params = gru.shaped(vector, start)
    return params


def score_rows(rows: DataFrame, params: dict[str, np.ndarray], vocab: Vocabulary) -> DataFrame:
    """(doc, text_hash, held, n_tokens, known, base, lm, words, shapes, ns): log10 sums over the dictionary's words,
    for lm with the class of every word, and the different words outside the dictionary as hash, class and count."""
    start = gru.init(HEAD, TAILS, vocab.head_counts, vocab.tail_counts)
    vector, head = gru.flat(params), vocab.head
    in_head = set(head)
    given = head + [w for w in vocab.counts if w not in in_head]
    n = np.array([vocab.counts.get(w, 0) for w in given], dtype=float)
    shapes = np.array([-1 if i < HEAD else shape(w) for i, w in enumerate(given)])
    # by id: the model's id, and for words that were seen: one, the base's share, the share of the word in its class
    model_id = np.concatenate([np.where(shapes < 0, np.arange(len(given)), HEAD + shapes), HEAD + np.arange(TAILS)]).astype(np.int32)
    outside = np.zeros(TAILS)
    known = np.concatenate([n > 0, outside])
    base = np.concatenate([np.where(n > 0, np.log10(n + SMOOTH) - vocab.log_total, 0), outside])
    share = np.concatenate([np.where(shapes < 0, 0, np.log10(np.maximum(n, 1)) + vocab.log_seen[shapes]), outside])
    tables = np.stack([known, base, share])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids = gru.Model(gru.shaped(vector, start), 0), RareIds(given)

        def read(batch: pa.RecordBatch) -> tuple[list[pa.Array], list[np.ndarray]]:
            """The columns but the score, and the model's ids. All tokens of a batch are looked up at once."""
            ids.trim()
            found = [encode(ids, tokens(x.as_py())) for x in batch.column(3)]
            hashes, classes = ids.arrays()
            sizes, at = np.array([len(d) for d in found], dtype=np.int64), np.concatenate([*found, np.zeros(0, np.int32)])
            ends = np.cumsum(sizes)
            outside = np.flatnonzero(at >= len(given))
            other = at[outside] - len(given)
            at[outside] = len(given) + classes[other]
            docs = np.split(model_id[at], ends[:-1])
            sums = np.add.reduceat(tables[:, at], ends - sizes, axis=1).T if len(at) else np.zeros((0, 3))
            # the different words outside the dictionary, by document
            spread = max(1, len(hashes))
            pairs, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[outside] * spread + other, return_counts=True)
            row, which = pairs // spread, pairs % spread
            keys, kinds = hashes[which], classes[which]
            if not n[0]:  # no document was learned from, and the end is a word that is not known
                row = np.append(row, np.arange(len(sizes)))
                keys, kinds = np.append(keys, np.full(len(sizes), signed_hash(END))), np.append(kinds, np.full(len(sizes), TAILS))
                order = np.argsort(row, kind="stable")
                keys, kinds, times = keys[order], kinds[order], np.append(times, np.ones(len(sizes), np.int64))[order]
            edges = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(sizes)))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (keys.astype(np.int64), kinds.astype(np.int32), times.astype(np.int32))]
            cols = [*batch.columns[:3], pa.array(sizes), pa.array(np.rint(sums[:, 0]).astype(np.int64)), pa.array(sums[:, 1].copy()), sums[:, 2], *lists]
            return cols, docs

        for held, docs in gathered(map(read, batches)):
            scores, at = model.score(docs) / math.log(10), 0
            for cols in held:
                cols[6] = pa.array(cols[6] + scores[at : at + len(cols[6])])
                at += len(cols[6])
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "text_hash", "held", "n_tokens", "known", "base", "lm", "words", "shapes", "ns"])

    kinds = T._parse_datatype_string("n_tokens bigint, known bigint, base double, lm double, words array<bigint>, shapes array<int>, ns array<int>")
    return rows.mapInArrow(releasing(run), T.StructType([*rows.schema.fields[:3], *kinds.fields]))


def signed_hash(word: bytes) -> int:
    """Spark's xxhash64 of the same bytes."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row a document: held_out, n_tokens, n_known, train_tokens, base_score and score, both log10."""
    rows = _rows(docs, id_col, text_col)
    training = rows.where(~F.col("held"))
    counts = stored(word_counts(training))
    vocab = Vocabulary(counts)
    params = train(training, vocab, rounds)
    scored = stored(score_rows(rows, params, vocab))
    # one row a hash, so that words that share one cannot multiply rows
    seen = counts.where("shape >= 0").groupBy(F.xxhash64("word").alias("word")).agg(F.sum("n").alias("c"))
    rare = scored.select("doc", "text_hash", F.inline(F.arrays_zip("words", "shapes", "ns"))).withColumnsRenamed({"words": "word", "shapes": "shape", "ns": "n"})
    joined = rare.join(seen, "word", "left")
    by_shape = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in [*xs, 0.0]]), F.col("shape") + 1)
    c = F.coalesce("c", F.lit(0))
    base = F.log10(c + SMOOTH) - vocab.log_total
    lm = F.when(F.col("shape") == TAILS, 0.0).when(c > 0, F.log10(c.cast("double")) + by_shape(vocab.log_seen)).otherwise(by_shape(vocab.log_unseen))
    n = F.col("n")
    sums = joined.groupBy(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")).agg(
        F.sum(F.when(c > 0, n).otherwise(0)).alias("known2"), F.sum(n * base).alias("base2"), F.sum(n * lm).alias("lm2")
    )
    # rows that repeat a document have its sums together: each takes its share
    copies = scored.groupBy(F.col("doc").alias("d"), F.col("text_hash").alias("h")).agg(F.count("*").alias("copies"))
    sums = sums.join(copies, F.col("_doc").eqNullSafe(F.col("d")) & (F.col("_hash") == F.col("h")))
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    more = lambda name: F.coalesce(F.col(name) / F.col("copies"), F.lit(0.0))
    return scored.drop("words", "shapes", "ns").join(sums, same, "left").select(
        F.col("doc").alias(id_col), F.col("held").alias("held_out"), "n_tokens",
        (F.col("known") + more("known2").cast("long")).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") + more("base2")).alias("base_score"), (F.col("lm") + more("lm2")).alias("score"),
    )


def op2_lm(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
