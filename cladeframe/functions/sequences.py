"""Column expressions over sequence text, bases and draws."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted characters, characters that mean "missing", and the
# nucleotide set of every encodable character (A=1, C=2, G=4, T=8).
ACCEPTED = "ACGTUYRWSKMBDHVNX?O-"
MISSING = "-?NX"
STATE_OF = {
    "A": 1, "C": 2, "G": 4, "T": 8, "U": 8,
    "Y": 10, "R": 5, "W": 9, "S": 6, "K": 12, "M": 3,
    "B": 14, "D": 13, "H": 11, "V": 7,
    "N": 15, "X": 15, "?": 15, "-": 15,
}
MAX_STATES = 5

_HEX = "0123456789ABCDEF"
_LETTERS = "".join(STATE_OF)
_DIGITS = "".join(_HEX[s] for s in STATE_OF.values())
_OTHERS = "".join(c for c in ascii_uppercase + "0123456789" if c not in STATE_OF)
MISSING_MASK = sum(1 << ACCEPTED.index(c) for c in MISSING)
INFORMATIVE_MASK = ((1 << len(ACCEPTED)) - 1) & ~MISSING_MASK


def normalise(seq: Column) -> Column:
    """Upper-case the letters a to z; other characters stay as they are."""
    return F.translate(seq, ascii_lowercase, ascii_uppercase)


def trim_chars(text: Column, chars: str = "\n\r ") -> Column:
    """Remove any of ``chars`` from both ends."""
    return F.btrim(text, F.lit(chars))


def skip_leading_space(text: Column) -> Column:
    """Text from its first character that is not white space."""
    return F.regexp_replace(text, r"^\s+", "")


def strip_digits_blanks(text: Column) -> Column:
    """Delete digits and blanks, as in numbered sequence blocks."""
    return F.translate(text, "0123456789 ", "")


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def tokens(text: Column, delimiter: str = " ") -> Column:
    """Non-empty pieces between delimiters."""
    return F.filter(F.split(text, f"\\Q{delimiter}\\E"), lambda t: t != "")


def last_token(text: Column) -> Column:
    return F.coalesce(F.get(F.reverse(tokens(text)), F.lit(0)), F.lit(""))


def leading_tokens(text: Column) -> Column:
    """All tokens but the last, joined by one blank."""
    parts = tokens(text)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")


def is_single_token(text: Column) -> Column:
    return F.size(tokens(text)) == 1


def hex_states(seq: Column) -> Column:
    """Whole sequence to one hex digit per base, ``!`` for letters and digits without a set."""
    return F.translate(seq, _LETTERS + _OTHERS, _DIGITS + "!" * len(_OTHERS))


def digit_state(digit: Column) -> Column:
    """Hex digit to nucleotide set 1..15, NULL for anything else."""
    return F.nullif(F.instr(F.lit("123456789ABCDEF"), digit), F.lit(0))


def mask_letters(mask: Column) -> Column:
    """Characters of a letter mask, in alphabetical order, as one string."""
    return F.concat(
        *[
            F.when(mask.bitwiseAND(F.lit(1 << ACCEPTED.index(c))) != 0, F.lit(c)).otherwise(F.lit(""))
            for c in sorted(ACCEPTED)
        ]
    )


def site_block(site: Column, width: int) -> Column:
    """Block number of a site; the partition key for long alignments."""
    return F.floor(site / F.lit(width))


def uniform_draw(seed: int | Column, *keys: Column) -> Column:
    """Draw in [0, 1) that depends on the keys only, not on row order.

    52 bits of the MD5 of seed and keys, written as numbers with colons between: the same in every engine that knows MD5. NULL keys count as nothing.
    """
    seed_col = seed if isinstance(seed, Column) else F.lit(seed)
    text = F.concat_ws(":", *[c.cast("string") for c in (seed_col, *keys)])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def congruential_draw(seed: int | Column, key: Column) -> Column:
    """Draw in [0, 1) by integer arithmetic, the same in every engine."""
    seed_col = seed if isinstance(seed, Column) else F.lit(seed)
    # the key is cut first, so that no product leaves 64 bits
    key = F.pmod(key.cast("bigint"), F.lit(2**31))
    scrambled = F.pmod(key * F.lit(1103515245) + seed_col * F.lit(12345) + F.lit(12345), F.lit(2**31))
    mixed = F.pmod(scrambled * F.lit(48271), F.lit(2**31 - 1))
    return mixed / F.lit(float(2**31 - 1))


def integer_draw(u: Column, upper: Column | int) -> Column:
    """Integer 0..upper, all equally likely."""
    up = upper if isinstance(upper, Column) else F.lit(upper)
    return F.floor(u * (up + 1)).cast("bigint")
