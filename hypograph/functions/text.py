"""Text expressions: cleaning, sentence boundaries, tokens and token offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_ASCII = r"[^\x00-\x7F]"
# A sentence ends after a run of terminators followed by white space; "0.05" stays whole.
SENTENCE_END = r"([.!?]+\s+)"
# U+2029 cannot occur in the text once it is ASCII only, so it marks boundaries safely.
BREAK_MARK = "\u2029"
BLANKS = " \t\n\x0b\f\r"
WHITE_SPACE = "[ \t\n\x0b\f\r]"
#: White space that is no blank.
OTHER_BLANKS = "[\t\n\x0b\f\r]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Fixed value: mentions that are numbering, statistics or reference residue rather than names.
NOISE = r"^\(\d+\)( \w+)?$|^\d+\.\d|^= .*$|^\w+ = \d$|^.*doi:.*$"


def clean_ascii(text: Column) -> Column:
    return F.regexp_replace(text, NON_ASCII, "")


def split_sentences(paragraph: Column) -> Column:
    """Sentences with their separators, so that they concatenate back to the paragraph."""
    marked = F.regexp_replace(paragraph, SENTENCE_END, "$1" + BREAK_MARK)
    return F.filter(F.split(marked, BREAK_MARK), lambda s: s != "")


def word_split(sentence: Column) -> Column:
    """Words between single white-space characters; neighbouring ones give empty words.

    Every separator is one character, so word ``i`` begins where the lengths before it, plus ``i``, say.
    """
    return F.split(sentence, WHITE_SPACE)


def token_split(sentence: Column) -> Column:
    """Words without dots and slashes, as many as ``word_split`` gives.

    Both are deleted from the whole sentence first, which is far cheaper than from every word and leaves the
    word numbers as they are.
    """
    return word_split(without_marks(sentence))


def without_marks(sentence: Column) -> Column:
    """A sentence without dots and slashes."""
    return F.replace(F.replace(sentence, F.lit("."), F.lit("")), F.lit("/"), F.lit(""))


def blanks_only(text: Column) -> Column:
    """Every white-space character as a blank; offsets stay."""
    return F.translate(text, BLANKS, " " * len(BLANKS))


def dots_to_blanks(sentence: Column) -> Column:
    return F.replace(sentence, F.lit("."), F.lit(" "))


def strip_punctuation(token: Column) -> Column:
    """Drop punctuation around a token, so that ``kcnq1,`` reads ``kcnq1``."""
    return F.regexp_replace(token, r"^[^a-z0-9]+|[^a-z0-9]+$", "")


def without_lead(text: Column) -> Column:
    """A text without its leading punctuation and white space."""
    return F.ltrim(text, F.lit(PUNCTUATION + BLANKS))


def lead_key(text: Column) -> Column:
    """First word of a text without leading punctuation: the candidate key of a several-word term."""
    return F.substring_index(blanks_only(without_lead(text)), " ", 1)


def lead_width(text: Column) -> Column:
    """Number of characters in front of the first word."""
    return F.length(text) - F.length(without_lead(text))


def is_noise(word: Column) -> Column:
    return word.rlike(NOISE)


def name_key(word: Column) -> Column:
    """Lookup key of a name: letters and digits only."""
    return F.regexp_replace(word, "[^A-Za-z0-9]", "")


def corpus_tokens(sentence: Column) -> Column:
    """Tokens for embedding training: dots become blanks, blanks separate."""
    return F.split(dots_to_blanks(sentence), " ")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)
