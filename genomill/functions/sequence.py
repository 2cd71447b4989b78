"""Expressions over nucleotide strings; all run inside the JVM."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = string.ascii_lowercase + string.ascii_uppercase
CYCLE = ("ACGT" * 13)[: len(LETTERS)]

# Symbols of the input alphabet.
AMBIGUOUS = "XYSWKHRMVDBN-"
VALID = "GATCRYWSMKHBVDN"


def folded(text: Column) -> Column:
    """Any text as a sequence over A, C, G, T, N: letters in turn, everything else N."""
    return F.regexp_replace(F.translate(text, LETTERS, CYCLE), "[^ACGT]", "N")


def clean(text: Column) -> Column:
    """Input symbols as the aligner stores them: U is T, ambiguity codes are N, all else is skipped."""
    return F.translate(F.regexp_replace(text, "[^ACGTUXYSWKHRMVDBN\\-]", ""), "U" + AMBIGUOUS, "T" + "N" * len(AMBIGUOUS))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTU", "TGCAA"))


def count_of(seq: Column, symbol: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(symbol), F.lit("")))


def kmers(seq: Column, k: int) -> Column:
    """All windows of k symbols, first to last; none if the sequence is shorter.

    One pass of a look-ahead: substr by position would count characters from the start for every window.
    """
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), 1)


def gapless(seq: Column) -> Column:
    return F.regexp_replace(seq, "[-.]", "")


def padded(seq: Column, width: Column, gap: str = "-") -> Column:
    return F.rpad(seq, width, gap)


def wrapped(seq: Column, width: int = 80) -> Column:
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


_FORMULA = re.compile(r"\s*(\d+\.?\d*|\.\d+|[-+*/^()]|log|[ls])", re.I)


def formula(text: str, size: Column) -> Column:
    """A user's formula in S (a length) with + - * / ^ and L (logarithm to base 2), rounded up: `1.1*(Log(S))`.

    Built as an expression by precedence climbing; anything that isn't a number, S, Log or an operator is refused.
    """
    tokens, at = [], 0
    while text[at:].strip():
        found = _FORMULA.match(text, at)
        if not found:
            raise ValueError(f"not a formula: {text!r}")
        tokens.append(found[1].lower())
        at = found.end()
    power = {"+": 1, "-": 1, "*": 2, "/": 2, "^": 3}

    def atom() -> Column:
        t = tokens.pop(0)
        if t in ("l", "log"):
            return F.log2(atom())
        if t == "(":
            inner = climb(1)
            if not tokens or tokens.pop(0) != ")":
                raise ValueError("unbalanced parentheses")
            return inner
        if t == "s":
            return size.cast("double")
        return F.lit(float(t))

    def climb(least: int) -> Column:
        left = atom()
        while tokens and power.get(tokens[0], 0) >= least:
            op = tokens.pop(0)
            right = climb(power[op] + (op != "^"))
            left = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "^": F.pow}[op](left, right)
        return left

    whole = climb(1)
    if tokens:
        raise ValueError(f"not a formula: {text!r}")
    return F.ceil(whole)


# Percent accepted mutations at 75.0 %, 75.1 %, ... 93.0 % observed difference.
PAMS = [
    195, 196, 197, 198, 199, 200, 200, 201, 202, 203, 204, 205, 206, 207, 208, 209, 209, 210, 211, 212, 213, 214, 215, 216, 217, 218, 219, 220, 221, 222,
    223, 224, 226, 227, 228, 229, 230, 231, 232, 233, 234, 236, 237, 238, 239, 240, 241, 243, 244, 245, 246, 248, 249, 250, 252, 253, 254, 255, 257, 258,
    260, 261, 262, 264, 265, 267, 268, 270, 271, 273, 274, 276, 277, 279, 281, 282, 284, 285, 287, 289, 291, 292, 294, 296, 298, 299, 301, 303, 305, 307,
    309, 311, 313, 315, 317, 319, 321, 323, 325, 328, 330, 332, 335, 337, 339, 342, 344, 347, 349, 352, 354, 357, 360, 362, 365, 368, 371, 374, 377, 380,
    383, 386, 389, 393, 396, 399, 403, 407, 410, 414, 418, 422, 426, 430, 434, 438, 442, 447, 451, 456, 461, 466, 471, 476, 482, 487, 493, 498, 504, 511,
    517, 524, 531, 538, 545, 553, 560, 569, 577, 586, 595, 605, 615, 626, 637, 649, 661, 675, 688, 703, 719, 736, 754, 775, 796, 819, 845, 874, 907, 945, 988,
]


def kimura(identity: Column) -> Column:
    """Distance from a fraction of identical places: a formula below 75 % difference, a table to 93 %, 10 beyond."""
    p = 1 - identity
    at = F.floor((p - 0.75) * 1000 + 0.5).cast("int")
    table = F.element_at(F.array(*map(F.lit, PAMS)), F.least(F.greatest(at, F.lit(0)), F.lit(len(PAMS) - 1)) + 1) / 100.0
    return F.when(p < 0.75, -F.log(1 - p - p * p / 5)).when(p > 0.93, 10.0).otherwise(table)
