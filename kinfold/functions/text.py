"""Title cleaning and tokenising as column expressions (no UDFs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points a title loses as emoji, first and last of each range.
EMOJI_RANGES = (
    (0x1F300, 0x1F9FF),
    (0x1FA00, 0x1FA6F),
    (0x1FA70, 0x1FAFF),
    (0x2600, 0x27BF),
    (0xFE00, 0xFE0F),
    (0x200D, 0x200D),
    (0x231A, 0x23FF),
    (0x25AA, 0x25FF),
    (0x2934, 0x2935),
    (0x2B05, 0x2B55),
    (0x3030, 0x3030),
    (0x303D, 0x303D),
    (0x3297, 0x3297),
    (0x3299, 0x3299),
    (0x1F600, 0x1F64F),
    (0x1F680, 0x1F6FF),
    (0x1F1E0, 0x1F1FF),
    (0x260E, 0x260F),
    (0x20E3, 0x20E3),
    (0x2B50, 0x2B50),
    (0x2764, 0x2764),
)

# The retail phrases a title loses.
SLANG_PHRASES = (
    "readystock",
    "ready stock",
    "ready",
    "original",
    "best seller",
    "promo",
    "promotion",
    "grosir",
    "murah meriah",
    "murah",
    "termurah",
    "diskon",
    "gratis ongkir",
    "cod",
    "limited",
    "brand",
    "import",
    "viral",
    "obral",
)

# Literal byte escapes and brackets a title loses.
NOISE = r"\\x[0-9a-fA-F]{2}|[()\[\]!]"

# Unicode white space and word characters, spelt out because regex engines
# disagree on what \s and \w mean outside ASCII.
SPACE = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WORD = r"[\p{L}\p{N}_]"


def emoji_class(ranges: Sequence[tuple[int, int]] = EMOJI_RANGES) -> str:
    """The regex character class covering ``ranges``."""
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges) + "]"


def _merged(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same code points in as few ranges as possible."""
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if merged and lo <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def longest_first(phrases: Sequence[str]) -> list[str]:
    """Longer phrases must win over their own prefixes in an alternation."""
    return sorted(phrases, key=lambda phrase: (-len(phrase), phrase))


def as_text(column: Column, null_text: str = "nan") -> Column:
    """Text of a column; a missing value reads ``nan``."""
    return F.coalesce(column.cast("string"), F.lit(null_text))


def remove_emoji(text: Column) -> Column:
    ranges = _merged(EMOJI_RANGES)
    # Testing the outer bounds first settles most characters with one comparison.
    bounds = f"\\x{{{ranges[0][0]:X}}}-\\x{{{ranges[-1][1]:X}}}"
    return F.regexp_replace(text, f"[{bounds}&&{emoji_class(ranges)}]+", "")


def remove_noise(text: Column) -> Column:
    return F.regexp_replace(text, NOISE, "")


def remove_slang(text: Column, phrases: Sequence[str] = SLANG_PHRASES) -> Column:
    """Drop whole-word phrases in any case, with the white space after them."""
    if not phrases:
        return text
    # Looking at the first character settles most words before any phrase is tried.
    first = "".join(sorted({f"\\x{{{ord(p[0]):X}}}" for p in phrases}))
    quoted = (r"\Q" + p.replace(r"\E", r"\E\\E\Q") + r"\E" for p in longest_first(phrases))
    pattern = f"(?iu)(?<!{WORD})(?=[{first}])(?:{'|'.join(quoted)})(?!{WORD}){SPACE}*"
    return F.regexp_replace(text, pattern, "")


def collapse_whitespace(text: Column) -> Column:
    # A lone blank already is what its run becomes, and needs no replacing.
    runs = f" {SPACE}+|[{SPACE}&&[^ ]]{SPACE}*"
    return F.trim(F.regexp_replace(text, runs, " "))


def clean_text(text: Column, phrases: Sequence[str] = SLANG_PHRASES) -> Column:
    """Emoji, noise and slang removed, white space collapsed, ends trimmed."""
    return collapse_whitespace(remove_slang(remove_noise(remove_emoji(text)), phrases))


def word_tokens(text: Column) -> Column:
    """Lower-case word tokens, single characters included."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + "+"), F.lit(0))


def without_stop_words(tokens: Column, stop_words: Sequence[str]) -> Column:
    """Drop stop words; a long list becomes a hash-set test, not a scan."""
    words = sorted(set(stop_words))
    return F.filter(tokens, lambda token: ~token.isin(words)) if words else tokens


def word_ngrams(tokens: Column, min_n: int, max_n: int) -> Column:
    """All word n-grams of the lengths given, repeats kept.

    ``tokens`` should name a column: the expression uses it once per length.
    Elements are read by position, because slicing copies the whole array each time.
    """
    size = F.size(tokens)

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(0), size - n)
        gram = F.transform(
            starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(n)])
        )
        return F.when(size >= n, gram).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of_length(n) for n in range(min_n, max_n + 1)])
