"""Full-text queries: web-style parsing, matching of stored lexemes as columns, and cover-density rank of what matches."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .english import lexemes

WEIGHT = 0.1  # of every lexeme: none is set apart


@dataclass(frozen=True)
class Node:
    """kind: word (value), phrase (words with gaps), not, and, or."""

    kind: str
    parts: tuple = ()
    value: str = ""
    gaps: tuple[int, ...] = ()


def parse(query: str, stemmed: bool = True) -> Node | None:
    """Words are joined by and, quotes make phrases, or separates, a leading minus negates; None if nothing is left."""
    groups: list[list[Node]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"?|(\S+)', query):
        if m[3] is None:
            negated, text, quoted = bool(m[1]), m[2], True
        else:
            word = m[3]
            if word.lower() == "or":
                groups.append([])
                continue
            negated, text, quoted = word.startswith("-"), word.lstrip("-"), False
        found = lexemes(text, stemmed) or []
        if not found:
            continue
        # the parts of one word stand side by side like those of a phrase
        node = Node("word", value=found[0][0]) if len(found) == 1 else Node(
            "phrase", tuple(x for x, _ in found), gaps=tuple(b - a for (_, a), (_, b) in zip(found, found[1:]))
        )
        groups[-1].append(Node("not", (node,)) if negated else node)
    whole = [g[0] if len(g) == 1 else Node("and", tuple(g)) for g in groups if g]
    if not whole:
        return None
    return whole[0] if len(whole) == 1 else Node("or", tuple(whole))


def words_of(node: Node, negated: bool = False) -> set[str]:
    """Words that can count for the query."""
    if node.kind == "word":
        return set() if negated else {node.value}
    if node.kind == "phrase":
        return set() if negated else set(node.parts)
    return set().union(*[words_of(p, negated != (node.kind == "not")) for p in node.parts])


def matches(tsv: Column, node: Node) -> Column:
    """Whether a column of lexemes matches."""
    names = F.transform(tsv, lambda x: x["lexeme"])
    if node.kind == "word":
        return F.array_contains(names, node.value)
    if node.kind == "phrase":
        offsets = [sum(node.gaps[:i]) for i in range(len(node.parts))]
        at = lambda word, pos: F.exists(tsv, lambda y: (y["lexeme"] == word) & (y["pos"] == pos))
        together = lambda x: reduce(and_, [at(w, x["pos"] + o) for w, o in zip(node.parts[1:], offsets[1:])])
        all_there = reduce(and_, [F.array_contains(names, w) for w in node.parts])
        return all_there & F.exists(tsv, lambda x: (x["lexeme"] == node.parts[0]) & together(x))
    if node.kind == "not":
        return ~matches(tsv, node.parts[0])
    return reduce(and_ if node.kind == "and" else or_, [matches(tsv, p) for p in node.parts])


def all_words(node: Node) -> set[str]:
    """Every word of a query, negated ones too."""
    if node.kind == "word":
        return {node.value}
    return set(node.parts) if node.kind == "phrase" else set().union(*map(all_words, node.parts))


def matches_nothing(node: Node) -> bool:
    """Whether a text with none of the query's words matches."""
    if node.kind in ("word", "phrase"):
        return False
    found = [matches_nothing(p) for p in node.parts]
    return not found[0] if node.kind == "not" else all(found) if node.kind == "and" else any(found)


def _leaves(node: Node) -> list[Node]:
    """Words and phrases that count for an extent; a negation does not restrict one."""
    if node.kind in ("word", "phrase"):
        return [node]
    return [] if node.kind == "not" else [leaf for p in node.parts for leaf in _leaves(p)]


def _begin(node: Node, last: dict[Node, Column], here: Column) -> Column:
    """The latest place from which what was read up to here satisfies the query; negative where none does."""
    if node.kind in ("word", "phrase"):
        return last[node]
    if node.kind == "not":
        return here
    parts = [_begin(p, last, here) for p in node.parts]
    return parts[0] if len(parts) == 1 else (F.least if node.kind == "and" else F.greatest)(*parts)


def cover_density(tsv: Column, node: Node) -> Column:
    """Sum over the shortest extents that satisfy the query: weight over one and the foreign words inside.

    One pass over the query's entries by position. For each entry the latest beginning of an extent that ends there
    follows from the places where the words and phrases were met last; the extent is a shortest one if it begins
    later than the one before.
    """
    wanted, leaves = sorted(words_of(node)), list(dict.fromkeys(_leaves(node)))
    if not wanted:
        return F.lit(0.0)
    entries = F.array_sort(F.transform(F.filter(tsv, lambda x: x["lexeme"].isin(wanted)), lambda x: F.struct(x["pos"].alias("pos"), x["lexeme"].alias("lexeme"))))
    name = {leaf: f"l{i}" for i, leaf in enumerate(leaves)}

    def met(es: Column, leaf: Node, x: Column) -> Column:
        """The place of a phrase's first word, if its last one is the entry and the others are where they should be."""
        offsets = [sum(leaf.gaps[:i]) for i in range(len(leaf.parts))]
        first = x["pos"] - offsets[-1]
        place = lambda w, o: F.array_position(F.transform(es, lambda e: F.struct(e["pos"], e["lexeme"])), F.struct((first + o).alias("pos"), F.lit(w).alias("lexeme")))
        there = reduce(and_, [place(w, o) > 0 for w, o in zip(leaf.parts, offsets)])
        return F.when((x["lexeme"] == leaf.parts[-1]) & there, place(leaf.parts[0], 0).cast("int") - 1)

    def step(es: Column):
        def run(acc: Column, x: Column) -> Column:
            here = acc["at"]
            seen = {
                leaf: F.when(x["lexeme"] == leaf.value, here).otherwise(acc[n]) if leaf.kind == "word" else F.coalesce(met(es, leaf, x), acc[n])
                for leaf, n in name.items()
            }

            def grown(begin: Column) -> Column:
                extra = here - begin
                noise = x["pos"] - F.get(es, begin)["pos"] - extra
                rank = F.lit(WEIGHT) / (1 + F.when(noise >= 0, noise).otherwise(extra / 2))
                new = (begin >= 0) & (begin > acc["best"])
                total = acc["total"] + F.when(new, rank).otherwise(0.0)
                return F.struct(
                    (here + 1).alias("at"), F.when(new, begin).otherwise(acc["best"]).alias("best"), total.alias("total"), *[seen[leaf].alias(n) for leaf, n in name.items()]
                )

            return F.transform(F.array(F.least(_begin(node, seen, here), here)), grown)[0]

        return run

    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("best"), F.lit(0.0).alias("total"), *[F.lit(-1).alias(n) for n in name.values()])
    fold = lambda es: F.aggregate(es, start, step(es), lambda acc: acc["total"])
    return F.when(tsv.isNotNull(), F.transform(F.array(entries), fold)[0]).otherwise(0.0)


def rank(node: Node) -> Callable[[Column], Column]:
    """Cover density of a lexeme column as an expression."""
    return lambda tsv: cover_density(tsv, node)
