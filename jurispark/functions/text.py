"""Column expressions over text.  Everything here stays on the JVM side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that separates tokens, including the Unicode
# separators and the ASCII control separators.
WHITESPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x85]+"
ALPHABETIC = r"^\p{L}+$"
# Tokens of two letters or more, found in the text as it stands.  The plain letters and blanks are
# named as well because the regex engine tests them faster.
_NO_SPACE = r"[^ \n" + WHITESPACE[1:-1]
LETTER_WORDS = rf"(?<!{_NO_SPACE})[a-zA-Z\p{{L}}]{{2,}}+(?!{_NO_SPACE})"
# Entity names whose markers are removed from annotated decisions.
MARKER_NAMES = ("argent", "norme")
# Marks that get a space on both sides in the class-file form.
SPACED_MARKS = ('.', '"', ',', '(', ')', '!', '?', ';', ':')
# Latin letters with a diacritic and their plain form.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
# Ligatures and the sharp s, which have a two-letter plain form.
LIGATURES = {"Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae", "ß": "ss"}


def collapse_whitespace(text: Column) -> Column:
    """Trim, and replace every run of white space with one space."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def tokens(text: Column) -> Column:
    """White-space tokens of ``text``; an empty array for NULL or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITESPACE), lambda t: t != "")


def clean_tokens(
    words: Column, remove_punctuation: bool = True, remove_single: bool = True
) -> Column:
    """Drop tokens that hold anything but letters, and one-letter tokens."""
    def keep(token: Column) -> Column:
        tests = []
        if remove_punctuation:
            tests.append(token.rlike(ALPHABETIC))
        if remove_single:
            tests.append(F.length(token) > 1)
        return reduce(lambda a, b: a & b, tests)

    return F.filter(words, keep) if remove_punctuation or remove_single else words


def clean_words(
    text: Column,
    lower: bool = True,
    remove_punctuation: bool = True,
    remove_single: bool = True,
) -> Column:
    """The preprocessing chain without lemmas, as tokens (``operators.lemmas`` adds those).

    With both filters on, the words are matched in one pass over the text.
    """
    if remove_punctuation and remove_single:
        words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LETTER_WORDS), F.lit(0))
    else:
        words = clean_tokens(tokens(text), remove_punctuation, remove_single)
    return F.transform(words, F.lower) if lower else words


def clean_text(
    text: Column,
    lower: bool = True,
    remove_punctuation: bool = True,
    remove_single: bool = True,
) -> Column:
    """``clean_words`` as one string."""
    return F.array_join(clean_words(text, lower, remove_punctuation, remove_single), " ")


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring tokens, joined by a space; empty if too short."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if n == 1:
        return words
    runs = F.transform(
        F.sequence(F.lit(1), F.size(words) - (n - 1)),
        lambda i: F.array_join(F.slice(words, i, n), " "),
    )
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def ngram_range(words: Column, nmin: int, nmax: int) -> Column:
    """n-grams of every length from ``nmin`` to ``nmax``, one after the other."""
    if not 0 < nmin <= nmax:
        raise ValueError("need 0 < nmin <= nmax")
    parts = [ngrams(words, n) for n in range(nmin, nmax + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def strip_markers(text: Column, names: tuple[str, ...] = MARKER_NAMES) -> Column:
    """Remove ``<...>`` markers whose content holds one of ``names``."""
    return F.regexp_replace(text, "<[^>]*(" + "|".join(names) + ")[^>]*>", "")


def strip_accents(text: Column) -> Column:
    """Plain-letter form of accented Latin letters."""
    plain = F.translate(text, ACCENTED, UNACCENTED)
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), plain)


def decision_key(court: Column, city: Column, number: Column, suffix: str = ".txt") -> Column:
    """File name of a decision: court, first three letters of the city, docket number."""
    return F.concat(
        F.upper(court),
        F.upper(strip_accents(F.substring(city, 1, 3))),
        F.upper(F.translate(number, "/", "")),
        F.lit(suffix),
    )


def class_file_line(text: Column) -> Column:
    """One normalised line: lower case, no line breaks, spaces around marks."""
    out = F.translate(F.lower(text), "\n", " ")
    out = F.replace(out, F.lit("<br />"), F.lit(" "))
    spaced = "([" + "".join("\\" + m for m in SPACED_MARKS) + "])"
    return F.trim(F.regexp_replace(F.regexp_replace(out, spaced, " $1 "), r"[ \t]+", " "))


def supervised_line(label: Column, text: Column) -> Column:
    """``__label__<label> <text>.`` with the text on one line."""
    return F.concat(
        F.lit("__label__"), label.cast("string"), F.lit(" "), collapse_whitespace(text), F.lit(".")
    )


def split_config(config: Column) -> Column:
    """Columns of a packed ``category_vectorization_transformation_classifier`` name."""
    parts = F.split(config, "_")
    names = ("category", "vectorization", "transformation", "classifier")
    return F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
