"""Literals that a pattern can't match without: a cheap first look before many regular expressions."""

from __future__ import annotations

from re import IGNORECASE, _constants, _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literals shorter than this are too common to keep a text away from a pattern.
LEAST = 2


def _of(parts, fold: bool) -> list[frozenset[str]]:
    """Sets of literals; any match of the sequence holds one of each set."""
    out, run = [], ""

    def end() -> None:
        nonlocal run
        if run:
            out.append(frozenset([run]))
        run = ""

    for op, arg in parts:
        if op is _constants.LITERAL:
            run += chr(arg).lower() if fold else chr(arg)
            continue
        end()
        if op is _constants.SUBPATTERN:
            out += _of(arg[3], fold or bool(arg[1] & IGNORECASE))
        elif op is _constants.BRANCH:
            each = [_best(_of(branch, fold)) for branch in arg[1]]
            if all(each):
                out.append(frozenset().union(*each))
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT) and arg[0] > 0:
            out += _of(arg[2], fold)
        elif op is _constants.ATOMIC_GROUP:
            out += _of(arg, fold)
    end()
    return out


def _best(sets: list[frozenset[str]]) -> frozenset[str]:
    """The set whose shortest literal is longest."""
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=frozenset())


def required(pattern: str) -> tuple[frozenset[str], bool]:
    """(literals of which every match holds one, whether case is ignored); no literals where the pattern needs none that is
    LEAST characters long."""
    tree = _parser.parse(pattern)
    fold = bool(tree.state.flags & IGNORECASE)
    best = _best(_of(tree, fold))
    # a literal that ignores case is looked for in the folded text; letters that fold to others than ASCII are left to the pattern
    if best and min(map(len, best)) >= LEAST and (not fold or all(x.isascii() and not set(x) & set("iks") for x in best)):
        return best, fold
    return frozenset(), fold


def may_match(text: str, need: tuple[frozenset[str], bool]) -> bool:
    literals, fold = need
    return not literals or any(x in (text.lower() if fold else text) for x in literals)


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Whether the text matches one of the patterns; texts without any pattern's literals aren't matched."""
    needs = [required(p) for p in patterns]
    found = text.rlike("|".join(f"({p})" for p in patterns))
    if not all(literals and not fold for literals, fold in needs):
        return found
    some = sorted({x for literals, _ in needs for x in literals})
    sieve = F.contains(text, F.lit(some[0]))
    for x in some[1:]:
        sieve = sieve | F.contains(text, F.lit(x))
    return sieve & found
