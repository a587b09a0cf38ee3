"""Valence of one lexicon word from the three words before and the two after it.

Plain SQL expressions over the columns ``w1..w3`` (words before, nearest first), ``p1..p3`` (the same
in lower case), ``l0`` (the word in lower case) and ``n1``, ``n2`` (words after, in lower case).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.wordlists import (
    BOOST,
    CAPS,
    DAMPENERS,
    DISTANCE_WEIGHTS,
    IDIOMS,
    INTENSIFIERS,
    NEGATION,
    NEGATIONS,
)
from .lexicon import Lexicon


def _in(column: str, words: list[str]) -> str:
    return f"{column} IN (" + ", ".join(f"'{w}'" for w in words) + ")"


def _upper(column: str) -> str:
    return f"(upper({column}) = {column} AND lower({column}) <> {column})"


# +1 above zero, else -1: the direction in which capitals push
_SIDE = "IF({0} > 0, 1D, -1D)"


def _degree(k: int) -> str:
    return f"CASE WHEN {_in(f'p{k}', INTENSIFIERS)} THEN {BOOST}D WHEN {_in(f'p{k}', DAMPENERS)} THEN -{BOOST}D ELSE 0D END"


def _factor(k: int) -> str:
    """What the negation rules multiply by for the word at distance ``k``."""
    near = _in("p1", ["so", "this"])
    stronger, untouched = {
        1: ("false", "false"),
        2: (f"p2 = 'never' AND {near}", "p2 = 'without' AND p1 = 'doubt'"),
        # fixed behaviour: the word right before counts even without "never"
        3: (
            f"(p3 = 'never' AND {_in('p2', ['so', 'this'])}) OR {near}",
            "p3 = 'without' AND (p2 = 'doubt' OR p1 = 'doubt')",
        ),
    }[k]
    negated = f"{_in(f'p{k}', NEGATIONS)} OR contains(p{k}, \"n't\")"
    return f"CASE WHEN {stronger} THEN 1.25D WHEN {untouched} THEN 1D WHEN {negated} THEN {NEGATION}D ELSE 1D END"


def _idiom() -> str:
    """Valence of an idiom around the word, else null.

    Phrases that go on to the right win over those to the left; among the latter the first one counts.
    """
    # first place in the six words and length of each phrase, the winning ones first
    spans = [(4, 3), (4, 2), (3, 2), (2, 3), (2, 2), (1, 3), (1, 2)]
    places = ", ".join(f"struct({at} AS at, {n} AS n)" for at, n in spans)
    phrases = f"transform(array({places}), s -> array_join(slice(array(p3, p2, p1, l0, n1, n2), s.at, s.n), ' '))"
    known = f"get(filter({phrases}, phrase -> {_in('phrase', list(IDIOMS))}), 0)"
    idioms = "map(" + ", ".join(f"'{text}', {value}D" for text, value in IDIOMS.items()) + ")"
    # every phrase holds the word itself or the one two before it
    parts = sorted({part for idiom in IDIOMS for part in idiom.split()})
    return f"CASE WHEN {_in('l0', parts)} OR {_in('p2', parts)} THEN try_element_at({idioms}, {known}) END"


def with_neighbours(words: DataFrame) -> DataFrame:
    """Add the three words before (w1 to w3) and the two after (n1, n2) to rows ``(tokens, pos)``; null past the ends."""
    before = {f"w{k}": F.expr(f"get(tokens, pos - {k})") for k in (1, 2, 3)}
    return words.withColumns(before | {f"n{k}": F.expr(f"get(tokens, pos + {k})") for k in (1, 2)})


def add_word_valence(hits: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Fill ``value`` for rows ``(w1, w2, w3, n1, n2, pos, token, valence, caps)``; rows without a valence get null.

    What each neighbour does is read off first. The value then goes through the three distances in
    turn, as each depends on the sign the one before it left.
    """

    def add(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
        return df.withColumns({name: F.expr(formula) for name, formula in formulas.items()})

    distances = (1, 2, 3)
    out = add(hits, {"l0": "lower(token)", "n1": "lower(n1)", "n2": "lower(n2)"} | {f"p{k}": f"lower(w{k})" for k in distances})
    for k in distances:
        out = lexicon.add_known(out, f"p{k}", f"known{k}")

    # a neighbour that is a lexicon word itself changes nothing
    applies = {k: f"pos >= {k} AND NOT known{k}" for k in distances}
    least = "pos >= 1 AND NOT known1 AND p1 = 'least' AND (pos = 1 OR p2 NOT IN ('at', 'very'))"
    effects = {
        "loud": f"IF(caps AND {_upper('token')}, {CAPS}D, 0D)",
        "idiom": f"IF({applies[3]}, {_idiom()}, NULL)",
        "least": f"IF({least}, {NEGATION}D, 1D)",
        "neutral": f"{_in('l0', [*INTENSIFIERS, *DAMPENERS])} OR (l0 = 'kind' AND coalesce(n1 = 'of', false))",
    }
    for k in distances:
        effects[f"degree{k}"] = f"IF({applies[k]}, {_degree(k)}, 0D)"
        effects[f"factor{k}"] = f"IF({applies[k]}, {_factor(k)}, 1D)"
    out = add(out, effects)
    out = add(
        out,
        {f"shout{k}": f"IF(degree{k} <> 0 AND caps AND {_upper(f'w{k}')}, {CAPS}D, 0D)" for k in distances}
        | {"value": f"valence + loud * {_SIDE.format('valence')}"},
    )
    for k, weight in zip(distances, DISTANCE_WEIGHTS):
        change = f"(degree{k} * IF(value < 0, -1D, 1D) + shout{k} * {_SIDE.format('value')}) * {weight}D"
        out = add(out, {"value": f"(value + {change}) * factor{k}"})
    return add(out, {"value": "IF(neutral, 0D, coalesce(idiom, value) * least)"})
