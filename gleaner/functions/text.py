"""Text columns: whitespace strip, accent folding, stable ids, tokens, all in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of anything but these (the same set for every engine).
SEPARATORS = r"[ \t\r\n.,;:!?]+"
TOKEN_PATTERN = SEPARATORS.replace("[", "[^")


@cache
def whitespace() -> str:
    """Every code point that outer-whitespace stripping removes."""
    return "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())


def strip(col: Column | str) -> Column:
    return F.trim(_col(col), F.lit(whitespace()))


def is_blank(col: Column | str) -> Column:
    return F.coalesce(strip(col), F.lit("")) == ""


def stable_id(url: Column | str) -> Column:
    """60-bit id: the first 15 hex digits of SHA-256 over the stripped URL."""
    digest = F.sha2(F.encode(strip(url), "UTF-8"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


# Fixed values of the Hangul block: syllables, and how many vowels and finals there are.
HANGUL = ("\uac00", "\ud7a3")
LEADS, VOWELS, FINALS = 0x1100, 0x1161, 0x11A7
N_VOWELS, N_FINALS = 21, 28

# What str_to_map parts pairs and their halves by; no letter decomposes into these.
PAIR, HALF = "\x01", "\x02"


@cache
def _fold_tables() -> tuple[str, str, str, str]:
    """Arguments of ``translate``: accented letter to base letter, then marks to nothing.
    Letters of several bases, other than Hangul syllables, come as a class and as pairs."""
    letters, bases, marks, several = [], [], [], {}
    # The planes of letters, and the marks that select variants.
    for char in map(chr, chain(range(0x80, 0x30000), range(0xE0000, 0xE0200))):
        if HANGUL[0] <= char <= HANGUL[1]:
            continue
        if unicodedata.category(char) == "Mn":
            marks.append(char)
        elif unicodedata.decomposition(char)[:1] not in ("", "<"):
            decomposed = unicodedata.normalize("NFD", char)
            base = [c for c in decomposed if unicodedata.category(c) != "Mn"]
            if len(base) == 1:
                letters.append(char)
                bases.append(base[0])
            else:
                several[char] = "".join(base)
    pairs = PAIR.join(f"{char}{HALF}{base}" for char, base in several.items())
    return "".join(letters + marks), "".join(bases), "".join(several), pairs


def _jamo(char: Column) -> Column:
    """A Hangul syllable as its two or three letters, anything else as it is."""
    nth = F.ascii(char) - ord(HANGUL[0])
    final = F.pmod(nth, F.lit(N_FINALS))
    vowel = F.pmod(F.floor(nth / N_FINALS), F.lit(N_VOWELS))
    lead = F.floor(nth / (N_FINALS * N_VOWELS))

    def letter(first: int, count: int, at: Column) -> Column:
        return F.substring(F.lit("".join(map(chr, range(first, first + count)))), at + 1, 1)

    parts = F.concat(
        letter(LEADS, 19, lead.cast("int")),
        letter(VOWELS, N_VOWELS, vowel.cast("int")),
        F.when(final > 0, letter(FINALS, N_FINALS, final)).otherwise(""),
    )
    return F.when(char.between(*map(F.lit, HANGUL)), parts).otherwise(char)


def fold(col: Column | str) -> Column:
    """Accent and case folding: canonical decomposition without non-spacing marks, in
    lower case (đ stays đ). Texts and queries are folded by this alone.

    Pure ASCII rows (byte length = character length, both cheap) skip the tables. Rows
    with a letter of several base letters (Hangul syllables and a few dozen others) are
    taken apart character by character.
    """
    c = _col(col)
    matching, replace, several, pairs = _fold_tables()
    plain = F.octet_length(c) == F.char_length(c)
    one_base = F.translate(c, matching, replace)
    known = F.str_to_map(F.lit(pairs), F.lit(PAIR), F.lit(HALF))
    taken_apart = F.array_join(
        F.transform(F.split(one_base, ""), lambda x: F.coalesce(F.try_element_at(known, x), _jamo(x))), ""
    )
    composed = c.rlike(f"[{HANGUL[0]}-{HANGUL[1]}{several}]")
    folded = F.when(composed, taken_apart).otherwise(one_base)
    return F.when(plain, F.lower(c)).otherwise(F.lower(folded))


def tokens(col: Column | str) -> Column:
    """Distinct lower-case words. ``split`` is linear in the text; extracting all
    matches copies the text once per match."""
    words = F.split(F.lower(_col(col)), SEPARATORS)
    return F.array_remove(F.array_distinct(words), "")


def empty_to_null(col: Column | str) -> Column:
    return F.nullif(_col(col), F.lit(""))


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
