"""English lexemes: words, stop words and the Porter2 stemmer, as an Arrow UDF.

Text is cut into tokens of overlapping classes, each with a place of its own: an e-mail address is one; a URL is itself,
then its host, then its path; a host is one; a hyphenated compound is itself, then its parts; a word is one. Only words
and parts are stemmed or stopped. A compound as a whole is kept as it is written, and numbers with points are cut at them,
which are known differences from a database's parser.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W_]+")

#: The classes of tokens, the first that fits counts. W stands for a letter or digit, L for a letter, X and Y for what hosts and names in
#: addresses have beside W; Spark's and SQL's regular expressions name these in one way and Python's in another.
_HOST = r"WX*(?:\.WX*)*\.LL+"
_CLASSES = rf"WY*@WX*(?:\.WX*)+|(?:[a-z]+://)?{_HOST}/[^ \t\r\n<>\"']*|(?:[a-z]+://)?{_HOST}|LW*(?:-W+)+|W+"
_NAMED = {"W": r"[\p{L}\p{N}]", "L": r"\p{L}", "X": r"[\p{L}\p{N}-]", "Y": r"[\p{L}\p{N}._%+-]"}
_IN_PYTHON = {"W": r"[^\W_]", "L": r"[^\W\d_]", "X": r"(?:[^\W_]|-)", "Y": r"(?:[^\W_]|[._%+-])"}
TOKEN = re.sub("[WLXY]", lambda m: _NAMED[m[0]], _CLASSES)
#: The same for Spark, quicker: a word that nothing follows which another class could go on with is tried before these.
_SPARK_TOKEN = rf"{_NAMED['W']}++(?![%+@:/_-]|\.[\p{{L}}\p{{N}}.%+@_-])|{TOKEN}"
_PYTHON_TOKEN = re.compile(re.sub("[WLXY]", lambda m: _IN_PYTHON[m[0]], _CLASSES))

#: The stop words of English.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a "
    "an the and but if or because as until while of at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor "
    "not only own same so than too very s t can will just don should now".split()
)
#: Words that Porter2 stems by table, and words it leaves alone.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl",
} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""

    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in VOWELS and word[i - 1] in VOWELS:
                return i + 1
        return len(word)

    head = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = head if head is not None else after(0)
    return r1, after(r1) if r1 < len(word) else len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Porter2 (English) stem of a lower-case word."""
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.lstrip("'")
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    # plural and third person
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w
    # past and participle
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not w.endswith(end):
            continue
        base = w[: -len(end)]
        if end in ("eed", "eedly"):
            w = base + "ee" if len(base) >= r1 else w
        elif any(c in VOWELS for c in base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"
        break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for end, new in STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + new
            break
    for end, new in STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= (r2 if end == "ative" else r1):
                w = w[:at] + new
            break
    for end in STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def lexemes(text: str | None, stemmed: bool = True) -> list[tuple[str, int]] | None:
    """(lexeme, position from 1); stop words take a position and are left out. Without stemming all words stay."""
    if text is None:
        return None
    if not stemmed:
        return [(w, i) for i, w in enumerate(WORD.findall(text.lower()), 1)]
    words = enumerate((t for m in _PYTHON_TOKEN.finditer(text.lower()) for t in parts_of(m[0])), 1)
    return [(stem(w), i) for i, w in words if w not in STOP_WORDS]


def parts_of(token: str) -> list[str]:
    """A token and what it is made of."""
    bare = re.sub("^[a-z]+://", "", token)
    if "@" in token and "/" not in token:
        return [token]
    if "/" in bare:
        host, _, path = bare.partition("/")
        return [bare, host, f"/{path}"]
    return [bare] if "." in bare or "-" not in bare else [bare, *bare.split("-")]


@F.arrow_udf(T.ArrayType(T.StringType()))  # built without a session
def _stems(words: pa.Array) -> pa.Array:
    """Only the words of a row that are no stop words come here, and only their stems go back; a word is stemmed once a batch."""
    coded = words.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], coded.dictionary.type)
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(words), 0).cast(pa.int32()))
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), stems.take(coded.indices), mask=words.is_null())


#: Kept apart from what is made of it: merged into a later expression it would run once for each use.
_stems_once = _stems.asNondeterministic()


def tokens(text):
    """array<string>: the tokens of a text in lower case and what they are made of, in order."""

    def parts(t):
        bare = F.regexp_replace(t, "^[a-z]+://", "")
        path = F.regexp_replace(bare, "^[^/]*", "")
        return (
            F.when(~(t.contains("-") | t.contains(".") | t.contains("/") | t.contains("@")), F.array(t))  # most are words
            .when(t.contains("@") & ~t.contains("/"), F.array(t))
            .when(bare.contains("/"), F.array(bare, F.substring_index(bare, "/", 1), path))
            .when(bare.contains(".") | ~bare.contains("-"), F.array(bare))
            .otherwise(F.concat(F.array(bare), F.split(bare, "-")))
        )

    return F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit(_SPARK_TOKEN), F.lit(0)), parts))


def placed_words(text):
    """array<struct<word,pos>>: the tokens that are no stop words, with their places."""
    placed = F.transform(tokens(text), lambda w, i: F.struct(w.alias("word"), (i + 1).alias("pos")))
    return F.filter(placed, lambda x: ~x["word"].isin(sorted(STOP_WORDS)))


def english_lexemes(text):
    """array<struct<lexeme,pos>>: splitting, stop words and positions are expressions, stemming alone is Python."""
    return stemmed(placed_words(text))


def stemmed(kept):
    """Lexemes of placed words. A column that holds these is worked out once, an expression once more for their places."""
    return F.zip_with(kept, _stems_once(F.transform(kept, lambda x: x["word"])), lambda k, s: F.struct(s.alias("lexeme"), k["pos"].alias("pos")))


def plain_lexemes(text):
    """Lexemes without stop words or stemming, as an expression."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w, i: F.struct(w.alias("lexeme"), (i + 1).alias("pos")))
