import random
from collections import Counter

import pytest

from driftline.llm import line_dedup as line_dedup_module
from driftline.llm.line_dedup import line_dedup

from .cases import documents, edited, prose, rows


def brute(given, threshold=0.8, least=1):
    """Every line against every earlier one."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    docs = sorted(set(given), key=lambda r: (*key(r), r[1] or ""))
    seen, out = [], {}
    for i, text in docs:
        kept, mine, gone = [], [], 0
        for line in (text or "").split("\n"):
            tokens = frozenset(t for t in line.replace("\t", " ").replace("\r", " ").split(" ") if t)
            like = len(tokens) >= least and any(len(tokens & s) >= threshold * len(tokens | s) - 1e-9 for s in seen + mine)
            gone += like
            kept += [] if like else [line]
            mine.append(tokens)
        seen += mine
        out[i, text] = ("\n".join(kept) if text is not None else None, gone)
    return Counter((i, *out[i, t]) for i, t in given)


def found(spark, given, **more):
    return Counter((r["doc_id"], r["text"], r["removed_lines"]) for r in line_dedup(documents(spark, given), **more).collect())


def test_like_brute_force(spark):
    given = [r for r in rows() if r[0] is not None]  # rows without identifier are ordered by a hash of their text
    assert found(spark, given) == brute(given)


def test_random_lines(spark):
    rng = random.Random(8)
    lines = [prose(i, rng.randint(1, 14)) for i in range(25)]
    given = []
    for i in range(60):
        some = [rng.choice(lines) for _ in range(rng.randint(0, 5))]
        some = [edited(x, rng.randrange(len(x.split(" ")))) if rng.random() < 0.5 else x for x in some]
        given.append((i, "\n".join(some)))
    assert found(spark, given) == brute(given)


@pytest.mark.parametrize("threshold", [0.6, 1.0])
def test_other_thresholds(spark, threshold):
    given = [(i, edited(prose(1, 12), i % 12) + "\n" + prose(i, 3)) for i in range(30)]
    assert found(spark, given, threshold=threshold) == brute(given, threshold)


def test_short_lines_before_longer_ones(spark):
    """A line of five tokens is like an earlier one of four of them, which itself stays."""
    given = [(1, "a b c d\na b c"), (2, "a b c d e\na b c d\na b c"), (3, "a b c d f\n \nx"), (4, "v w x y z"), (5, "v w x y\nx\n ")]
    got = found(spark, given)
    assert got == brute(given) and got[2, "", 3] == 1 and got[3, " \nx", 1] == 1


def test_lines_of_few_tokens_go_too(spark):
    given = [(1, "Les.\nLes.\n" + "x" * 300), (2, "x" * 300 + "\n\t Les.\r"), (3, "a a b\nb a"), (4, "b\na b c")]
    got = found(spark, given)
    assert got == brute(given) and got[1, "Les.\n" + "x" * 300, 1] == 1 and got[2, "", 2] == 1 and got[3, "a a b", 1] == 1


def test_one_line_that_all_documents_share(spark):
    given = [(i, prose(77, 9) + "\n" + prose(1000 + i, 9)) for i in range(80)]
    got = found(spark, given)
    assert got == brute(given) and sum(n for (_, _, gone), n in got.items() if gone == 1) == 79


def test_other_columns_stay_and_empty_tables_work(spark):
    out = line_dedup(documents(spark, []))
    assert out.count() == 0 and {"doc_id", "keys", "n", "run", "text", "removed_lines"} <= set(out.columns)
    missing = found(spark, [(None, prose(1, 9)), (None, prose(1, 9)), (3, prose(1, 9))])
    assert missing == Counter({(None, prose(1, 9), 0): 2, (3, "", 1): 1})


def test_closed_lines_ask_for_no_more_partners(spark, monkeypatch):
    """Lines that are like the first of their group are settled after one comparison, though the first itself stays open."""
    sizes = []

    class Counted(line_dedup_module.StageTable):
        def __init__(self, df, name, key=None):
            super().__init__(df, name, key)
            if name == "pairs":
                sizes.append(self.df.count())

    monkeypatch.setattr(line_dedup_module, "StageTable", Counted)
    # One token more takes the place of the least or of the greatest hash, never of both.
    given = [(i, prose(5, 20) + (f" more{i}" if i else "")) for i in range(40)]
    got = found(spark, given)
    assert got == brute(given) and sum(gone for _, _, gone in got) == 39
    assert sizes[0] <= 80 and sizes[1] == 0


def counted(monkeypatch):
    """The numbers of rows of the tables of pairs that are to be verified, as they are written."""
    sizes = []

    class Counted(line_dedup_module.StageTable):
        def __init__(self, df, name, key=None):
            super().__init__(df, name, key)
            if name == "pairs":
                sizes.append(self.df.count())

    monkeypatch.setattr(line_dedup_module, "StageTable", Counted)
    return sizes


def test_long_lines_of_one_vocabulary_make_no_pairs(spark, monkeypatch):
    """Lines of 200 of 500 words share words of their prefixes, but differ in far more words than lines that are alike may."""
    sizes, rng, words = counted(monkeypatch), random.Random(3), [f"w{i}" for i in range(500)]
    given = [(i, " ".join(rng.sample(words, 200))) for i in range(50)]
    given.append((50, given[0][1] + " more"))
    got = found(spark, given)
    assert got == brute(given) and sum(gone for _, _, gone in got) == 1
    assert sum(sizes) <= 2


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_lines_on_both_sides_of_the_sizes_of_more_words(spark, threshold):
    rng, words = random.Random(4), [f"w{i}" for i in range(900)]
    given = []
    for size in (64, 128):
        base = rng.sample(words[:450], size + 12)
        for i in range(24):
            some = base[: size - 12 + i]
            some = rng.sample(some, len(some) - i % 5) + rng.sample(words[450:], i % 7)
            given.append((len(given), " ".join(some)))
    given.append((len(given), " ".join(words[::3])))
    given.append((len(given), " ".join(words[:870:3])))
    got = found(spark, given, threshold=threshold)
    assert got == brute(given, threshold) and 0 < sum(gone for _, _, gone in got) < len(given)
