"""Best-fit packing by exact complements (operator 8).

Texts are tokenised in Arrow batches and cut into pieces of at most `capacity` tokens. Only the histogram of
piece lengths, at most `capacity` rows however large the corpus, reaches the driver, where sequences are
planned as patterns with counts: a length's gap is filled exactly from an index of single, pair and triple
sums under availability counts, and what is left is packed best-fit decreasing. Pieces are then ranked
within their length over salted windows and each rank is looked up in the plan, so that no task or driver
ever holds all the pieces.

Tokenising works word by word with a bounded memory: the tokenizer never joins text across white space, so a
text's ids are those of its white-space-separated parts.

Defined results: a null or empty text is one piece holding the end id alone; repeated rows are packed one by
one; an empty table gives no pieces; other columns are ignored whatever their names.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_BYTES, releasing, stored, table, text_bytes

CAPACITY = 2048
END = 0
#: Parts of texts remembered in each Python worker: two generations of so many.
REMEMBERED = 300_000
#: ASCII punctuation that may follow a word; an apostrophe may belong to it.
BEHIND = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The end of the Latin letters, and how many words go to the model as one text.
LATIN_END, TOGETHER = "\u0250", 64
#: Rows of one length that one window may rank, and the least number of salts.
RANKED, SALTS = 20_000, 128


class PartTokenizer:
    """Ids of white-space-separated parts, as little-endian unsigned 32-bit bytes, with a bounded memory.

    Most new parts are one lower-case Latin word, perhaps with punctuation behind it. The tokenizer's
    normaliser leaves such a word alone and its pre-tokenizer keeps it whole and apart from the punctuation,
    so these words go to the model many at a time, and are told apart by the tokens that end a word.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        spec["normalizer"], spec["added_tokens"] = None, []
        whole = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, whole]}
        self.words = Tokenizer.from_str(json.dumps(spec))
        vocab = self.words.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that neither the normaliser nor the pre-tokenizer would change."""
        joined = [" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        found = self.words.encode_batch_fast(joined, add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(x.ids for x in found), dtype="<u4")
        cuts = (4 * (np.flatnonzero(self.ends[flat]) + 1)).tolist()
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def known(self, lists: list[list[bytes]]) -> dict[bytes, bytes]:
        """A memory that holds every part of the lists."""
        missing = set(chain.from_iterable(lists)).difference(self.new)
        for part in missing & self.old.keys():
            self.new[part] = self.old[part]
        plain, other, words = [], [], {}
        for part in missing.difference(self.new):
            text = part.decode()
            word = text.rstrip(BEHIND)
            if word.isalpha() and word.islower() and max(word) < LATIN_END and unicodedata.is_normalized("NFC", word):
                tail = text[len(word) :]
                bare = part[: len(part) - len(tail)]  # what follows the word is ASCII
                plain.append((part, bare, tail))
                ids = self.new.get(bare) or self.old.get(bare)
                if ids:
                    self.new[bare] = ids
                else:
                    words[bare] = word
            else:
                other.append((part, text))
        tails = sorted({tail for _, _, tail in plain if tail})
        tail_ids = {"": b"", **dict(zip(tails, self._whole(tails)))}
        self.new.update(zip(words, self._words(list(words.values())), strict=True))
        for part, bare, tail in plain:
            self.new[part] = self.new[bare] + tail_ids[tail]
        for (part, _), ids in zip(other, self._whole([text for _, text in other])):
            self.new[part] = ids
        held = self.new
        if len(held) > REMEMBERED:
            self.old, self.new = held, {}
        return held

    def encode(self, bodies: list[bytes | None]) -> list[bytes]:
        # special tokens are matched in their own case only, so such a text keeps its letters
        lists = [(b.translate(LOWER_BYTES) if b"<|" not in b else b).split() if b else [] for b in bodies]
        get = self.known(lists).__getitem__
        return [b"".join(map(get, x)) for x in lists]


_TOKENIZERS: dict[str, PartTokenizer] = {}


def part_tokenizer(path: str) -> PartTokenizer:
    """One tokenizer a worker, kept over tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PartTokenizer(path)
    return _TOKENIZERS[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    capacity: int = CAPACITY, with_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) for every piece."""
    path = tokenizer or tokenizer_path()
    rows = text_bytes(docs, id_col, text_col)
    end = np.array([END], dtype="<u4").tobytes()
    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = part_tokenizer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = []
                for i, ids in enumerate(known.encode(batch.column(1).to_pylist())):
                    ids += end
                    for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        out.append((i, k, start, len(part) // 4, zlib.crc32(part), part))
                cols = list(zip(*out)) or [()] * 6
                made = [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                if with_ids:
                    flat = np.frombuffer(b"".join(cols[5]), dtype="<i4")
                    made.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cols[3])]).astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(made, names=names)
        known.old = {}  # between tasks one generation is enough

    kinds = T._parse_datatype_string("piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
    return rows.mapInArrow(releasing(run), T.StructType([rows.schema[0], *kinds.fields]))


class _Sums:
    """Pairs of available lengths by sum. Counts only fall, so each pointer only moves on."""

    def __init__(self, count: list[int]) -> None:
        self.count, self.pair_at, self.triple_at = count, {}, {}

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.count[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        count, a = self.count, self.pair_at.get(gap, gap - 1)
        while 2 * a >= gap and a > 0:
            b = gap - a
            if b and count[a] and count[b] and (a != b or count[a] > 1):
                self.pair_at[gap] = a
                return a, b
            a -= 1
        self.pair_at[gap] = 0
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        count, c = self.count, self.triple_at.get(gap, gap - 2)
        while c > 0:
            if count[c] and (two := self.pair(gap - c)):
                if count[c] >= 1 + two.count(c):
                    self.triple_at[gap] = c
                    return c, *two
            c -= 1
        self.triple_at[gap] = 0
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of piece lengths and how many sequences each fills. Its size follows the capacity, not the data."""
    count = [0] * (capacity + 1)
    for length, n in histogram.items():
        count[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if count[capacity]:
        out.append(((capacity,), count[capacity]))
    sums, left = _Sums(count), {}
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        for find in (sums.single, sums.pair, sums.triple):
            while count[length]:
                count[length] -= 1  # the piece whose gap is to be filled is not available itself
                found = find(gap)
                count[length] += 1
                if not found:
                    break
                whole = (length, *found)
                n = min(count[x] // whole.count(x) for x in set(whole))
                for x in whole:
                    count[x] -= n
                out.append((whole, n))
        if count[length]:
            left[length], count[length] = count[length], 0
    return out + best_fit(left, capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: each length goes to the fullest open sequences that can take it."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by gap
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            gap = next((g for g in range(length, capacity) if bins.get(g)), None)
            if gap is None:
                each = min(capacity // length, n)
                fit = n // each
                bins[capacity - each * length].append(((length,) * each, fit))
                n -= fit * each
                continue
            pattern, m = bins[gap].pop()
            each = min(gap // length, n)
            used = min(m, n // each)
            bins[gap - each * length].append((pattern + (length,) * each, used))
            if m > used:
                bins[gap].append((pattern, m - used))
            n -= used * each
    return [x for group in bins.values() for x in group]


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    capacity: int = CAPACITY, with_ids: bool = False,
) -> DataFrame:
    """Every piece with the sequence it goes to and its offset there."""
    found = pieces(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, capacity=capacity, with_ids=with_ids)
    # numbered once and stored: rows that share an id, or have none, are spread and ranked like others
    cut = stored(found.withColumn("_piece", F.monotonically_increasing_id()))
    histogram = {int(r[0]): r[1] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length: (first rank, first sequence, offset)
    filled: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in plan(histogram, capacity):
        at = 0
        for length in pattern:
            slots[length].append((filled[length], sequence, at))
            filled[length] += n
            at += length
        sequence += n
    lookup = {k: np.array(v, dtype=np.int64) for k, v in slots.items()}
    salts = max(SALTS, -(-max(histogram.values(), default=0) // RANKED))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("_piece"), F.lit(salts)))
    ranks = Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "_piece")
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    sofar = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "_salt", F.coalesce(F.sum("_n").over(sofar), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_row", F.row_number().over(ranks)).join(before, ["length", "_salt"])
    ranked = ranked.select(*found.columns, (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    names = [*found.columns, "sequence_id", "offset"]
    place = found.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(place).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for length in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == length)
                slot = lookup[length]
                k = np.searchsorted(slot[:, 0], rank[mine], "right") - 1
                seq[mine] = slot[k, 1] + rank[mine] - slot[k, 0]
                off[mine] = slot[k, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(off)], names=names)

    more = T._parse_datatype_string("sequence_id bigint, offset bigint")
    return ranked.mapInArrow(run, T.StructType([*found.schema.fields, *more.fields]))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
