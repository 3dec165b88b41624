"""Text primitives as column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# The same as four ranges of ASCII.
PUNCTUATION_PATTERN = r"[!-/:-@\[-`{-~]+"
# White space as a general-purpose string split sees it.
WHITE = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
# The same as single characters.
WHITE_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SENTENCE_MARK = "\u0001"
WORD_PATTERN = r"[\p{L}\p{N}]+|[^\s\x0B\x1c-\x1f\x85\p{Z}\p{L}\p{N}]"
WORD_START, WORD_END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
# Words that treebanks cut in two.
TWO_IN_ONE = (("can", "not"), ("gon", "na"), ("got", "ta"), ("wan", "na"), ("gim", "me"), ("lem", "me"))
PIECE_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]"


def strip(text: Column) -> Column:
    """A pattern would look for its end at each white space of the text."""
    return F.btrim(text, F.lit(WHITE_CHARACTERS))


def clean_text(text: Column) -> Column:
    """Lower case, no ASCII punctuation, single spaces.

    One look-up per character replaces two patterns: a pattern of this many ranges is slow where many others are in use.
    """
    bare = F.translate(F.lower(text), WHITE_CHARACTERS + PUNCTUATION, " " * len(WHITE_CHARACTERS))
    return F.trim(F.regexp_replace(bare, "  +", " "))


def string_to_float(text: Column) -> Column:
    """The first run of digits with an optional point and more digits; null when there is none."""
    found = F.regexp_extract(text, r"([0-9]+\.?[0-9]*)", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def both_numeric(left: Column, right: Column) -> Column:
    return string_to_float(left).isNotNull() & string_to_float(right).isNotNull()


def is_subset(left: Column, right: Column) -> Column:
    """One cleaned text lies inside the other; an empty text lies inside everything."""
    a, b = clean_text(left), clean_text(right)
    return F.contains(a, b) | F.contains(b, a)


def sentences(text: Column) -> Column:
    """Sentences end at . ! or ? followed by white space."""
    marked = F.regexp_replace(strip(text), rf"([.!?]){WHITE}+", f"$1{SENTENCE_MARK}")
    return F.filter(F.split(marked, SENTENCE_MARK), lambda s: s != "")


def words(text: Column) -> Column:
    """Runs of letters and digits, and every other visible character by itself."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def pieces(text: Column) -> Column:
    """As ``words`` but white space is kept, so joining the pieces gives the text back."""
    return F.regexp_extract_all(text, F.lit(PIECE_PATTERN), F.lit(0))


def _contractions(text: Column, other: str) -> Column:
    """The rules in their order: the part of a word before its ending, the ending, words of two, other words, ``other``."""
    before = rf"[\p{{L}}\p{{N}}]+?(?=n['’]t{WORD_END})"
    endings = rf"(?<=\p{{L}})n['’]t{WORD_END}|(?<=[\p{{L}}\p{{N}}])['’](?:s|m|d|re|ve|ll){WORD_END}"
    firsts = "|".join(rf"{WORD_START}{a}(?={b}{WORD_END})" for a, b in TWO_IN_ONE)
    return F.regexp_extract_all(text, F.lit(rf"(?i)(?:{before}|{endings}|{firsts}|[\p{{L}}\p{{N}}]+|{other})"), F.lit(0))


def contraction_words(text: Column) -> Column:
    """As ``words``, with contractions cut as treebanks do: ``do n't``, ``it 's``, ``can not``, ``gon na``."""
    return _contractions(text, WORD_PATTERN.split("|")[1])


def contraction_pieces(text: Column) -> Column:
    """As ``contraction_words`` but white space is kept, so joining the pieces gives the text back."""
    return _contractions(text, PIECE_PATTERN.split("|")[1])


def rows_of(array: Column) -> Column:
    """A generator (pos, item) for an array column; use it with ``where("pos IS NOT NULL")``.

    For the inner form Catalyst infers a filter on the array's size and pushes it to the scan, with all that the array
    is computed from; the outer form followed by a filter on the position computes the array once.
    """
    return F.posexplode_outer(array)


def is_word(token: Column) -> Column:
    return token.rlike(r"\A[\p{L}\p{N}]")


def is_punctuation(token: Column) -> Column:
    return F.contains(F.lit(PUNCTUATION), token)


def join_words(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def parse_keywords(answer: Column) -> Column:
    """A comma or line separated answer as cleaned keywords; empty ones are dropped."""
    parts = F.split(answer, r"[,\n]+\s*")
    return F.filter(F.transform(parts, clean_text), lambda k: k != "")


def bind_context(context: Column, keyword: Column) -> Column:
    """A prompt row for one keyword: the context (several inputs joined by line breaks) and the keyword."""
    return F.array(context, keyword)


def join_inputs(inputs: Column, separator: str = "\n") -> Column:
    return F.array_join(inputs, separator)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors in double precision; null when either is all zero."""

    def total(vector: Column) -> Column:
        return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)

    def product(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))

    # Bound once: the vectors may be long expressions.
    both = F.array(F.struct(left.alias("l"), right.alias("r")))

    def one(v: Column) -> Column:
        norm = F.sqrt(total(product(v["l"], v["l"]))) * F.sqrt(total(product(v["r"], v["r"])))
        return total(product(v["l"], v["r"])) / F.nullif(norm, F.lit(0.0))

    return F.get(F.transform(both, one), F.lit(0))
