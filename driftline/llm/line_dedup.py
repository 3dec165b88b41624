"""Line dedup by an exact set-similarity join, in DataFrame operations only.

Lines are sets of tokens, in the order of the tokens' rarity. Two sets whose Jaccard similarity reaches the threshold
share a token among the first few of both (prefix filter), have similar sizes (length filter), and still have enough tokens
left behind the shared one (positional filter). Their symmetric difference is small, so few bits differ between the
parities of their tokens' hashes. What passes all four is verified on the sets.

Rarity comes from a table of 65,536 token counters, filled by all lines: whatever the corpus, it fits in a constant of the
plan. Counters only decide the order, which is total and the same everywhere, so shared counters cost time, not pairs.

A line goes if it is like any line before it. So one earlier line is enough, and lines that have one need no other
partner: sets are first compared with the earliest of those that share a min-hash (one comparison each), and only pairs
whose later set is still open come out of the join. Groups of near copies thus never show all their pairs: lines are
numbered in their order and sets by their first lines, so the join knows which of two sets is the later one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from driftline.functions.draws import let

from .common import StageTable, whole
from .components import look_up

COUNTERS = 1 << 16
LOW = (1 << 56) - 1
SET = ("sid", "check")
#: Portions that equal rows of one document are dealt to.
PORTIONS = 64
#: More lines than a text can have.
LINES = 1 << 31
#: The parities of sets of that many tokens fill two and four words: in one word all long sets look alike.
TWO_WORDS, FOUR_WORDS = 64, 128
BITS = ("bits", "half", "third", "fourth")


def _odd(text: Column) -> Column:
    return F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r"))


def token_hashes(line: Column) -> Column:
    """The hashes of a line's distinct tokens, in order of appearance."""
    plain = F.when(_odd(line), F.translate(line, "\t\r", "  ")).otherwise(line)
    return F.array_remove(F.array_distinct(F.transform(F.split(plain, " "), lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))


def rarity_table(texts: DataFrame, text_col: str) -> Column:
    """For each counter the logarithm of how many tokens it has counted, in half powers of two.

    The array is told as one text, which the optimizer turns into a constant: a literal for each counter takes seconds.
    """
    text, odd = F.col(text_col), _odd(F.col(text_col))
    # Split at one character, as a pattern takes more time.
    plain = F.when(odd, F.translate(text, "\n\t\r", "   ")).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))
    tokens = texts.select(F.explode_outer(F.split(plain, " ")).alias("t")).filter("t <> ''")
    counted = tokens.groupBy(F.xxhash64("t").bitwiseAND(F.lit(COUNTERS - 1)).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    table = [0] * COUNTERS
    for row in counted.collect():  # COUNTERS rows at most
        table[row["c"]] = min(127, int(2 * math.log2(1 + row["n"])))
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def token_keys(hashes: Column, table: Column) -> Column:
    """The tokens of a line as numbers, rarest first: rarity in the high byte, the token's hash below it."""
    none = F.lit(0).cast("long")
    # Without nulls the numbers are sorted as they are, which takes a fraction of the time.
    rarity = lambda h: F.coalesce(F.get(table, h.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")), none)
    return F.sort_array(F.transform(hashes, lambda h: F.call_function("shiftleft", rarity(h), F.lit(56)).bitwiseOR(h.bitwiseAND(F.lit(LOW)))))


def _bits(keys: Column, counts: Callable[[Column], Column] | None = None) -> Column:
    """Bit i tells whether an odd number of tokens has hash i; with ``counts``, which is 1 or 0, only of those where it is 1."""
    one = F.lit(1).cast("long")
    place = lambda k: k.bitwiseAND(F.lit(63)).cast("int")
    mark = lambda k: F.call_function("shiftleft", counts(k).bitwiseAND(one) if counts else one, place(k))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda so_far, k: so_far.bitwiseXOR(mark(k)))


def _all_bits(keys: Column, n: Column) -> list[Column]:
    """BITS of a set: the parities of all tokens, and of long sets those of a half and of two quarters of them (else 0)."""
    a, b = (lambda k: F.shiftright(k, 6)), (lambda k: F.shiftright(k, 7))
    none = F.lit(0).cast("long")
    more = [(TWO_WORDS, a), (FOUR_WORDS, lambda k: F.bitwise_not(a(k)).bitwiseAND(b(k))), (FOUR_WORDS, lambda k: a(k).bitwiseAND(b(k)))]
    return [_bits(keys).alias(BITS[0]), *(F.when(n >= least, _bits(keys, of)).otherwise(none).alias(c) for c, (least, of) in zip(BITS[1:], more))]


def _common_needed(a: Column, b: Column, threshold: float) -> Column:
    """Tokens that sets of these sizes must share, not rounded: numbers of tokens are compared with it."""
    return (a + b) * (threshold / (1 + threshold)) - 1e-9


def _most(n: Column, m: Column, threshold: float) -> Column:
    """Tokens that sets of these sizes may differ in."""
    return n + m - 2 * _common_needed(n, m, threshold)


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits")))


def _close(a: str, b: str, n: Column, m: Column, threshold: float) -> Column:
    """Parity filter: sets of sizes n and m that are alike differ in few tokens, so few of their bits differ.

    The bits are compared in as many words as the smaller set has.
    """
    differ = {c: F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in BITS}
    kept = lambda c, least: F.when((n >= least) & (m >= least), differ[c]).otherwise(F.lit(0).cast("long"))
    half, third, fourth = kept("half", TWO_WORDS), kept("third", FOUR_WORDS), kept("fourth", FOUR_WORDS)
    words = differ["bits"].bitwiseXOR(half).bitwiseXOR(third), half.bitwiseXOR(fourth), third, fourth
    return F.bit_count(words[0]) + F.bit_count(words[1]) + F.bit_count(words[2]) + F.bit_count(words[3]) <= _most(n, m, threshold)


def _places(own: DataFrame) -> tuple[StageTable, Column]:
    """A table (__doc, id, k, r) of all documents, and the place in the order of identifier and text's hash, from its ``r``.

    Sorted runs are numbered by themselves; what comes to the driver is the size of each run.
    """
    named = own.groupBy(F.col("__id").alias("id"), F.col("__k").alias("k")).agg(F.collect_set("__doc").alias("docs")).orderBy("id", "k")
    runs = StageTable(named.withColumn("r", F.monotonically_increasing_id()).select("id", "k", "r", F.explode("docs").alias("__doc")), "places")
    sizes = {row["run"]: row["n"] for row in runs.df.groupBy(F.shiftright("r", 33).alias("run")).agg(F.count_distinct("r").alias("n")).collect()}
    starts, at = [], 0
    for run in range(max(sizes, default=-1) + 1):
        starts.append(at)
        at += sizes.get(run, 0)
    known = F.split(F.lit(",".join(map(str, starts or [0]))), ",").cast("array<bigint>")
    return runs, F.get(known, F.shiftright("r", 33).cast("int")) + F.col("r").bitwiseAND(F.lit((1 << 33) - 1))


def _number(o: str) -> Column:
    """The place of a line in its document."""
    return F.col(o).bitwiseAND(F.lit(LINES - 1)).cast("int")


def _may_match(a: str, b: str, threshold: float) -> Column:
    """Length filter and parity filter."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (n >= threshold * m - 1e-9) & (m >= threshold * n - 1e-9) & _close(a, b, n, m, threshold)


def line_dedup(
    docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", into: str = "text", removed: str = "removed_lines"
) -> DataFrame:
    """The input's rows and columns, with the text left of each document in `into` and the number of lines that went.

    Lines end at line feeds; tokens are what blanks, tabs and carriage returns separate. Lines are ordered by identifier,
    then by their place in the document. A line is removed if a line before it has a token set with a Jaccard similarity
    of `threshold` or more, whether or not that one was removed too; only lines without a token always stay. A null text
    stays null, and an empty one empty. Null identifiers come first in order; rows with the same identifier and the same text
    are one document, treated alike. Columns of the input that have the names of new ones are replaced. An empty table gives
    an empty result.
    """
    keyed = docs.withColumns({"__id": F.col(id_col), "__k": F.xxhash64(whole(text_col)), "__portion": F.pmod(F.spark_partition_id(), F.lit(PORTIONS))})
    keyed = keyed.withColumn("__copy", F.monotonically_increasing_id())  # tells equal rows apart
    # All that follows meets the texts by document: dealt once, they are never moved again.
    own = StageTable(keyed.withColumn("__doc", F.xxhash64("__id", "__k", "__portion")), "documents", "__doc").df
    table = rarity_table(own, text_col)
    places, place = _places(own)
    numbers = places.df.groupBy("__doc").agg(F.collect_list(F.struct("id", "k", place.alias("place"))).alias("__places"))
    # The key is the only condition of the join, so the texts stay where they are; the array leaves out other rows with the key.
    mine = F.filter("__places", lambda p: p["id"].eqNullSafe(F.col("__id")) & (p["k"] == F.col("__k")))
    placed = own.join(numbers.hint("shuffle_hash"), "__doc").withColumn("__place", F.get(mine, F.lit(0))["place"])
    least = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1  # tokens of the prefix
    lines = placed.select(
        "__place", F.struct(F.col("__doc").alias("doc"), F.col("__copy").alias("copy")).alias("row"), F.spark_partition_id().alias("run"),
        F.posexplode_outer(F.split(whole(text_col), "\n", -1)).alias("no", "line"),
    ).withColumn("hashes", token_hashes(F.col("line")))
    lines = lines.withColumn("keys", token_keys(F.col("hashes"), table)).withColumn("n", F.size("keys"))
    held = StageTable(
        lines.select(
            # The number of a line (`o`) is in the order of lines; a set goes by that of its first line.
            (F.col("__place") * LINES + F.coalesce("no", F.lit(0))).alias("o"), "row", "run", "n", F.xxhash64("keys").alias("sid"), F.hash("keys").alias("check"),
            *_all_bits(F.col("keys"), F.col("n")),
            # The least and the greatest hash are two min-hashes of the set.
            F.array(F.array_min("hashes"), F.array_max("hashes")).alias("lows"), F.transform(F.slice("keys", F.lit(1), F.greatest(least, F.lit(0))), lambda k: F.hash(k)).alias("prefix"),
        ),
        "lines",
    )
    # Filtered only now: a condition on their number would have all tokens worked out once more.
    full = held.df.filter("n > 0")
    sets = StageTable(
        full.groupBy(*SET).agg(
            F.min(F.struct("o", "row")).alias("first"), F.count(F.lit(1)).alias("lines"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in BITS),
            F.first("lows").alias("lows"), F.first("prefix").alias("prefix"),
        ).select(*SET, "first.*", "lines", "n", *BITS, "lows", "prefix"),
        "sets",
    )
    # What follows asks lines only for their sets and places.
    slim = StageTable(full.select("o", "row", "run", *SET), "lines")
    for done in (held, places):
        done.drop()

    def verified(pairs: DataFrame) -> StageTable:
        """The late sets of the pairs (late, early) whose similarity, worked out from their lines, reaches the threshold."""
        asked = pairs.select(F.explode(F.array("late", "early")).alias("o")).distinct()
        wanted = sets.df.select("o", _number("o").alias("no"), "row").join(asked, "o").groupBy(F.col("row.doc").alias("__doc")).agg(
            F.collect_list(F.struct("row.copy", "no", "o")).alias("wants")
        )
        # The key is the only condition of the join, so the texts stay where they are; other rows with the key are left out.
        mine = F.filter("wants", lambda w: w["copy"] == F.col("__copy"))
        texts = own.select("__doc", "__copy", whole(text_col).alias("text")).join(wanted.hint("shuffle_hash"), "__doc")
        read = texts.select(
            F.explode_outer(let(F.split("text", "\n", -1), lambda ls: F.transform(mine, lambda w: F.struct(w["o"].alias("o"), F.get(ls, w["no"]).alias("line"))))).alias("s")
        ).select("s.o", token_keys(token_hashes(F.col("s.line")), table).alias("keys")).filter("o IS NOT NULL")
        both = pairs.join(read.alias("x"), F.col("late") == F.col("x.o")).join(read.alias("y"), F.col("early") == F.col("y.o"))
        common = F.size(F.array_intersect("x.keys", "y.keys"))
        alike = both.select("late", common.alias("common"), (F.size("x.keys") + F.size("y.keys") - common).alias("joined"))
        return StageTable(alike.filter(F.col("common") >= F.col("joined") * threshold - 1e-9).select("late").distinct(), "verified")

    def later(pairs: StageTable) -> DataFrame:
        """The later set of each pair (late, early) whose similarity reaches the threshold.

        One earlier match is enough, so each set is first compared with the earliest of its partners; only sets that are
        not like that one are compared with the others.
        """
        tried = StageTable(pairs.df.groupBy("late").agg(F.min("early").alias("early")), "tried")
        done = verified(tried.df)
        others = pairs.df.join(done.df, "late", "left_anti")
        others = StageTable(others.join(tried.df, ["late", "early"], "left_anti"), "others")
        more = verified(others.df)
        for table_ in (pairs, tried, others):
            table_.drop()
        return done.df.union(more.df)

    # Sets that are so small that one more token makes another set are only like equal ones.
    wide = F.col("n") >= (F.col("n") + 1) * threshold - 1e-9

    # Every set against the earliest one with the same min-hash.
    lows = sets.df.filter(wide).select("o", "n", *BITS, F.posexplode("lows").alias("j", "low"))
    earliest = lows.groupBy("j", "low").agg(F.min(F.struct("o", "n", *BITS)).alias("e"), F.count(F.lit(1)).alias("met")).filter("met > 1")
    near = lows.alias("s").join(earliest.select("j", "low", "e.*").alias("e").hint("merge"), ["j", "low"])
    near = near.filter((F.col("s.o") > F.col("e.o")) & _may_match("s", "e", threshold))
    near = StageTable(near.select(F.col("s.o").alias("late"), F.col("e.o").alias("early")).distinct(), "pairs")
    closed = verified(near.df).df  # two pairs of a set at most
    near.drop()

    # The prefix join, for pairs whose later set is still open. A token of very many prefixes is a skewed key: its rows are
    # split by the adaptive join, each part of one side with all of the other.
    marked = sets.df.filter(wide).join(closed.select(F.col("late").alias("o"), F.lit(True).alias("closed")), "o", "left").withColumn("open", F.col("closed").isNull())
    # A row has few and small fields, as these rows are most of what is shuffled: size, place and mark are one number.
    packed = F.col("n").cast("long") * (1 << 25) + F.col("place") * 2 + F.col("open").cast("int")
    rows = marked.select("o", "n", *BITS, "open", F.posexplode("prefix").alias("place", "token")).withColumn("packed", packed)
    # None is null; where Spark knows it, it filters neither side (for the other would be shuffled again) and tests no pair for it.
    rows = rows.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("token", "o", *BITS, "packed")))

    # Unpacked in the condition only: both sides are the same rows, shuffled once. So the mark is compared with the other
    # side's number too: a condition on one side alone would be pushed below the shuffle, which then is another one.
    open_number = F.when(F.col("q.packed").bitwiseAND(F.lit(1)) == 1, F.col("q.o")).otherwise(F.lit(-1))
    size = lambda c: F.shiftright(F.col(f"{c}.packed"), 25)
    behind = lambda c: size(c) - F.shiftright(F.col(f"{c}.packed").bitwiseAND(F.lit((1 << 25) - 1)), 1)
    n, m = size("p"), size("q")
    # Sets whose sizes differ too much fall to the positional filter.
    met = rows.alias("p").join(
        rows.alias("q").hint("merge"),
        (F.col("p.token") == F.col("q.token")) & (F.col("p.o") < open_number)
        & (_differ("p", "q") <= _most(n, m, threshold)) & (F.least(behind("p"), behind("q")) >= _common_needed(n, m, threshold)) & _close("p", "q", n, m, threshold),
    )
    more = later(StageTable(met.select(F.col("q.o").alias("late"), F.col("p.o").alias("early")).distinct(), "pairs"))
    gone = closed.union(more).distinct().select(F.col("late").alias("o"), F.lit(True).alias("gone"))

    # Lines that go: all but the first of a set, and the first too where the set has an earlier match.
    fate = sets.df.join(gone, "o", "left").filter("lines > 1 OR gone").select(*SET, F.col("o").alias("first"), "gone")
    leaving = look_up(slim.df, fate, *SET).filter("first IS NOT NULL AND (gone OR o > first)")
    by_doc = StageTable(leaving.groupBy("row").agg(F.collect_set(_number("o")).alias("nos")).groupBy(F.col("row.doc").alias("__doc")).agg(
        F.collect_list(F.struct("row.copy", "nos")).alias("__leaving")), "leaving").df
    for done in (slim, sets):
        done.drop()
    mine = F.get(F.filter("__leaving", lambda r: r["copy"] == F.col("__copy")), F.lit(0))["nos"]
    joined = own.join(by_doc.hint("shuffle_hash"), "__doc", "left").withColumn("__nos", F.coalesce(mine, F.array().cast("array<int>")))
    text = F.when(F.size("__nos") == 0, F.col(text_col)).otherwise(_without(F.col(text_col), F.col("__nos")))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (into, removed)]
    return joined.select(*kept, text.alias(into), F.size("__nos").cast("long").alias(removed))


def _without(text: Column, places: Column) -> Column:
    """The lines of a text but those at the given places: what is left of all places, and then the lines there."""

    def cut(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return let(F.split(text, "\n", -1), cut)
