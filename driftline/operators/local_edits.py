"""Input transformations that need no model: one text column in, one text column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import MODULUS, draw, edit_chosen, let, shuffle
from ..functions.text import (
    is_punctuation,
    is_word,
    join_words,
    pieces,
    rows_of,
    sentences,
    words,
)
from .pools import Pool
from .portions import join_in_portions

#: Text -> its sentences; the rule or a trained model.
Splitter = Callable[[Column], Column]

MUTATED_SHARE = 0.1
SHUFFLE_TRIES = 10

# Neighbours on a QWERTY keyboard.
KEYBOARD = {
    "a": "qwsz", "b": "vghn", "c": "xdfv", "d": "serfcx", "e": "wsdr", "f": "drtgvc", "g": "ftyhbv",
    "h": "gyujnb", "i": "ujko", "j": "huikmn", "k": "jiolm", "l": "kop", "m": "njk", "n": "bhjm",
    "o": "iklp", "p": "ol", "q": "wa", "r": "edft", "s": "awedxz", "t": "rfgy", "u": "yhji",
    "v": "cfgb", "w": "qase", "x": "zsdc", "y": "tghu", "z": "asx",
}
# Characters an optical reader mixes up.
OCR = {
    "0": "8oO", "1": "l4I", "2": "z", "3": "8", "5": "8s", "6": "b", "8": "s30", "9": "g", "b": "6",
    "c": "e", "g": "9q", "i": "l1", "l": "1i", "o": "0", "q": "g9", "s": "58", "u": "v", "z": "2",
    "B": "8", "D": "O0", "G": "C6", "I": "1l", "O": "0D", "S": "58", "Z": "2",
}


# Whole-text edits


def upper(text: Column) -> Column:
    return F.upper(text)


def exclaim(text: Column) -> Column:
    """Full stops become exclamation marks, and the text ends with one."""
    marked = F.replace(text, F.lit("."), F.lit("!"))
    return F.when(F.endswith(marked, F.lit("!")), marked).otherwise(F.concat(marked, F.lit("!")))


def append_constant(text: Column, addition: str) -> Column:
    return F.concat(text, F.lit(" " + addition))


def append_random_sentence(df: DataFrame, text: Column, row: Column, seed: int, pool: Pool, out: str) -> DataFrame:
    df = pool.pick(df, draw(row, F.lit(1), seed) % pool.size, out)
    return df.withColumn(out, F.concat(text, F.lit(" "), F.col(out)))


def permute(inputs: Column, permute_to: list[int]) -> Column:
    """Input i moves to place ``permute_to[i]``."""
    return F.array(*[F.get(inputs, F.lit(permute_to.index(place))) for place in range(len(permute_to))])


# Order of sentences and words


def shuffle_sentences(text: Column, row: Column, seed: int, split: Splitter = sentences) -> Column:
    return F.array_join(shuffle(split(text), row, seed), " ")


def _shuffle_words_only(tokens: Column, row: Column, seed: int) -> Column:
    """Words change places, punctuation keeps its own.

    The words take the places of words in their new order; sorting (place, text) pairs puts both
    kinds together without a search per token.
    """

    def parts(bound: Column) -> Column:
        places = F.filter(F.transform(bound, lambda t, i: F.when(~is_punctuation(t), i)), lambda i: i.isNotNull())
        only_words = F.filter(bound, lambda t: ~is_punctuation(t))
        return F.struct(bound.alias("tokens"), places.alias("places"), shuffle(only_words, row, seed).alias("shuffled"))

    def assign(bound: Column) -> Column:
        moved = F.zip_with(bound["places"], bound["shuffled"], lambda p, w: F.struct(p.alias("p"), w.alias("w")))
        kept = F.filter(
            F.transform(bound["tokens"], lambda t, i: F.struct(F.when(is_punctuation(t), i).alias("p"), t.alias("w"))),
            lambda s: s["p"].isNotNull(),
        )
        return F.transform(F.sort_array(F.concat(moved, kept)), lambda s: s["w"])

    return let(let(tokens, parts), assign)


def shuffle_words(text: Column, row: Column, seed: int) -> Column:
    return join_words(_shuffle_words_only(words(text), row, seed))


def shuffle_words_in_sentences(text: Column, row: Column, seed: int, split: Splitter = sentences) -> Column:
    """As ``shuffle_words`` but a word stays in its sentence: words are ordered by (sentence, draw)."""

    def one(sentence: Column, i: Column) -> Column:
        # The sentence number takes the place of a second seed.
        return join_words(_shuffle_words_only(words(sentence), F.pmod(row.cast("bigint"), F.lit(MODULUS).cast("bigint")) * F.lit(1009) + i, seed))

    return F.array_join(F.transform(split(text), one), " ")


# Chosen words and sentences


def one_less_share(share: float):
    """ceil((n - 1) * share): never all of the items."""
    return lambda n: F.ceil((n - 1) * F.lit(share))


def full_share(share: float):
    return lambda n: F.ceil(n * F.lit(share))


def _shuffled_letters(word: Column, key: Column, seed: int) -> Column:
    # The word's own key, reduced by the draw function, stands for the row.
    return F.array_join(shuffle(F.split(word, ""), key, seed), "")


def scramble_words(text: Column, row: Column, seed: int, draw_seed: int, share: float = MUTATED_SHARE) -> Column:
    """Chosen words with all their characters in random order."""
    return join_words(
        edit_chosen(words(text), row, seed, one_less_share(share), lambda w, k: _shuffled_letters(w, k, draw_seed))
    )


def scramble_inside_words(text: Column, row: Column, seed: int, draw_seed: int, share: float = MUTATED_SHARE) -> Column:
    """Chosen words of four or more characters; first and last stay. Up to ten tries to get another word."""

    def edit(word: Column, key: Column) -> Column:
        inside = F.substring(word, F.lit(2), F.length(word) - 2)

        def one_try(n: Column) -> Column:
            return F.array_join(shuffle(F.split(inside, ""), key + n, draw_seed), "")

        # A word such as "book" has few other forms and "beer" style pairs may repeat, so most words
        # stop at the first try; only unchanged ones look further.
        first = let(one_try(F.lit(0)), lambda t: F.when(t != inside, t))
        others = F.get(
            F.filter(F.transform(F.sequence(F.lit(1), F.lit(SHUFFLE_TRIES - 1)), one_try), lambda t: t != inside), F.lit(0)
        )
        return F.concat(F.substring(word, 1, 1), F.coalesce(first, others, inside), F.right(word, F.lit(1)))

    return join_words(
        edit_chosen(words(text), row, seed, full_share(share), edit, eligible=lambda w: F.length(w) >= 4)
    )


def insert_random_words(
    df: DataFrame, text: Column, row: Column, seed: int, draw_seed: int, pool: Pool, out: str, key: str,
    share: float = MUTATED_SHARE,
) -> DataFrame:
    """A random word after each chosen word."""
    marked = edit_chosen(
        F.transform(words(text), lambda w, i: F.struct(w.alias("w"), F.lit(None).cast("bigint").alias("pick"))),
        row,
        seed,
        one_less_share(share),
        lambda s, k: F.struct(s["w"].alias("w"), (draw(row, k % F.lit(2147483648) + 1, draw_seed) % pool.size).alias("pick")),
    )
    df = df.withColumn("_marked", marked)
    df = pool.pick_many(df, F.filter(F.transform("_marked", lambda s: s["pick"]), lambda i: i.isNotNull()), "_new", key)

    # Sort tokens and new words together: the n-th chosen token is followed by the n-th new word.
    tokens = F.transform("_marked", lambda s, i: F.struct((i * 2).alias("p"), s["w"].alias("w")))
    places = F.filter(F.transform("_marked", lambda s, i: F.when(s["pick"].isNotNull(), i * 2 + 1)), lambda p: p.isNotNull())
    added = F.zip_with(places, F.col("_new"), lambda p, w: F.struct(p.alias("p"), w.alias("w")))
    joined = F.array_join(F.transform(F.sort_array(F.concat(tokens, added)), lambda s: s["w"]), " ")
    return df.withColumn(out, joined).drop("_marked", "_new")


def delete_sentences(text: Column, row: Column, seed: int, share: float = MUTATED_SHARE, split: Splitter = sentences) -> Column:
    left = edit_chosen(split(text), row, seed, one_less_share(share), lambda s, k: F.lit(None).cast("string"))
    return F.array_join(F.filter(left, lambda s: s.isNotNull()), " ")


def replace_sentences(
    df: DataFrame, text: Column, row: Column, seed: int, draw_seed: int, pool: Pool, out: str, share: float = MUTATED_SHARE,
    split: Splitter = sentences,
) -> DataFrame:
    """Chosen sentences all become the same random sentence."""
    df = pool.pick(df, draw(row, F.lit(1), draw_seed) % pool.size, "_sentence")
    changed = edit_chosen(split(text), row, seed, one_less_share(share), lambda s, k: F.col("_sentence"))
    return df.withColumn(out, F.array_join(changed, " ")).drop("_sentence")


# Typing errors


def _confusions(kind: str) -> dict[str, str]:
    return {"keyboard": KEYBOARD, "ocr": OCR}[kind]


def typos(text: Column, row: Column, kind: str, seed: int, draw_seed: int, share: float = MUTATED_SHARE) -> Column:
    """A share of the words, in each a share of the characters that the table of confusions knows."""
    table = _confusions(kind)
    known = "[" + "".join(table) + "]"
    plain, options = "".join(table), list(table.values())

    def confuse(char: Column, key: Column) -> Column:
        choices = F.get(F.lit(options), F.instr(F.lit(plain), char) - 1)
        number = draw(key, F.lit(1), draw_seed) % F.length(choices)
        return F.substring(choices, number.cast("int") + 1, F.lit(1))

    def edit(word: Column, key: Column) -> Column:
        chars = edit_chosen(F.split(word, ""), key, draw_seed, full_share(share), confuse, lambda c: c.rlike(known))
        return F.array_join(chars, "")

    return F.array_join(
        edit_chosen(pieces(text), row, seed, full_share(share), edit, eligible=lambda w: w.rlike(known)), ""
    )


def misspell(
    df: DataFrame, text: Column, row: Column, seed: int, dictionary: DataFrame, out: str, key: str, share: float = MUTATED_SHARE
) -> DataFrame:
    """A share of the words, each looked up in a table (word, misspelling) with one entry per word.

    Only chosen words leave their row. A word that a third of them are is asked for in SPLITS portions, each of which asks
    the table once, so neither the table nor the rows of one word come to one task. The pieces are cut once more where the
    words come back: of a row only its own columns are moved.
    """

    def marked() -> Column:
        """The pieces, the chosen ones behind a space: no other piece of two or more characters begins with one."""
        return edit_chosen(pieces(text), row, seed, full_share(share), lambda p, k: F.concat(F.lit(" "), p), eligible=is_word)

    is_chosen = lambda p: (F.length(p) > 1) & F.startswith(p, F.lit(" "))

    def entries(take: Callable[[Column], Column], piece: Callable[[Column], Column]) -> Column:
        placed = F.transform(marked(), lambda p, i: F.when(take(p), F.struct(i.alias("pos"), piece(p).alias("piece"))))
        return F.filter(placed, lambda s: s.isNotNull())

    spots = entries(is_chosen, lambda p: F.substring(p, F.lit(2), F.length(p)))
    listed = df.select(key, F.explode_outer(spots).alias("s")).where("s IS NOT NULL")
    chosen = listed.select(key, "s.*", F.lower("s.piece").alias("word"))
    changed = (
        join_in_portions(chosen, dictionary, "word", key, "pos")
        .groupBy(key)
        .agg(F.collect_list(F.struct("pos", F.coalesce("misspelling", "piece").alias("piece"))).alias("_changed"))
    )
    joined = df.join(changed, key, "left")
    others = entries(lambda p: ~is_chosen(p), lambda p: p)
    rebuilt = F.array_join(F.transform(F.sort_array(F.concat(others, "_changed")), lambda s: s["piece"]), "")
    return joined.withColumn(out, F.when(F.col("_changed").isNull(), text).otherwise(rebuilt)).drop("_changed")


# Whole-word replacement and removal by rule


def replace_words(text: Column, words_from: Column, words_to: Column) -> Column:
    """Every word found in ``words_from`` (cleaned, lower case) becomes its partner; spacing stays."""

    def apply(rule: Column) -> Column:
        def one(token: Column) -> Column:
            place = F.array_position(rule["words_from"], F.lower(token)).cast("int")
            return F.coalesce(F.get(rule["words_to"], place - 1), token)

        return F.array_join(F.transform(rule["pieces"], one), "")

    rule = F.struct(pieces(text).alias("pieces"), words_from.alias("words_from"), words_to.alias("words_to"))
    return let(rule, apply)


def remove_words(text: Column, removed: Column) -> Column:
    def apply(rule: Column) -> Column:
        return F.array_join(F.filter(rule["pieces"], lambda p: ~F.array_contains(rule["removed"], F.lower(p))), "")

    return let(F.struct(pieces(text).alias("pieces"), removed.alias("removed")), apply)
