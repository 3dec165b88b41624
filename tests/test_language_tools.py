"""Trained sentences, phrases, spelling: laws and brute force."""

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from driftline.functions.text import sentences
from driftline.operators.local_edits import misspell, shuffle_sentences
from driftline.operators.phrases import PhraseAutomaton, remove_phrases, replace_phrases
from driftline.operators.registry import TRANSFORMS
from driftline.operators.rewrites import Edit
from driftline.operators.sentence_model import SentenceModel, sentence_statistics, train_sentences
from driftline.operators.spelling import deletions, spelling_index


def corpus():
    """Prose with two titles, which always have a stop behind them, and a name that is seen elsewhere too."""
    rng = random.Random(4)
    nouns = "house river stone garden window letter market bridge valley forest".split()
    out = []
    for i in range(400):
        a, b, c = (rng.choice(nouns) for _ in range(3))
        out.append(f"Yesterday the {a} was near the {b}. He saw Dr. Miller by the {c}. The {b} stood there! Mr. Brown and Miller left, e.g. by the {a}.")
        out.append(f"A {a} fell as a {c} closed. The old {b} fell. He met Brown near the {a}. They went to the {a}, as the {b} was yesterday closed.")
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def model(spark):
    return train_sentences(spark.createDataFrame(corpus(), "id int, text string").repartition(3))


def test_what_is_learnt(model):
    assert {"dr", "mr", "e.g"} <= model.abbreviations and not {"river", "house", "fell"} & model.abbreviations
    assert {"he", "the"} & model.starters and "miller" not in model.openers and "yesterday" not in model.abbreviations


def test_splits(model):
    said = "He saw Dr. Miller (on the 3. floor). Then, e.g. by the river, Mr. Brown left!  Why?\n\"The house fell.\" J. Miller met Dr. The river…  end"
    assert model.split(said) == [
        "He saw Dr. Miller (on the 3. floor).", "Then, e.g. by the river, Mr. Brown left!", "Why?", "\"The house fell.\"", "J. Miller met Dr.", "The river…  end"
    ]
    for text, want in (("", []), (" \n ", []), ("one", ["one"]), (" . ", ["."]), ("...", ["..."]), ("a.b c", ["a.b c"]), ("x" * 10**6, ["x" * 10**6])):
        assert model.split(text) == want


def test_without_words_only_stops_count():
    plain = SentenceModel(frozenset(), frozenset(), frozenset(), frozenset())
    for text in (t for _, t in corpus()[:40]):
        assert plain.split(text.replace("e.g.", "eg")) == regex.split(r"(?<=[.!?])\s+", text.replace("e.g.", "eg"))


def test_splitter_takes_the_place_of_the_rule(spark, model):
    rows = [(1, ["He saw Dr. Miller. The river rose."]), (2, [None]), (3, [""])]
    df = spark.createDataFrame(rows, "row_id bigint, inputs array<string>")
    got = df.select(model.sentences(F.col("inputs")[0]).alias("s")).collect()
    assert [r["s"] for r in got] == [["He saw Dr. Miller.", "The river rose."], None, []]
    cut = {s: TRANSFORMS["delete_sentences"](df, Edit(split=s), {}).where("row_id = 1").first()["variants"][0][0] for s in (sentences, model.sentences)}
    assert cut[model.sentences] in ("He saw Dr. Miller.", "The river rose.") and len(cut[sentences].split(" ")) > 3
    both = df.select(*[shuffle_sentences(F.col("inputs")[0], F.col("row_id"), 5, s).alias(n) for n, s in (("rule", sentences), ("model", model.sentences))]).first()
    assert "Dr. Miller." in both["model"]


def test_statistics_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, "")], [(1, "word")]):
        assert sentence_statistics(spark.createDataFrame(rows, "id int, text string")).count() == 0


# Phrases


def brute_edit(text, rules):
    """From left to right: the longest phrase that begins at a token, or the token as it is."""
    token = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
    spans = [(m.group().lower(), *m.span()) for m in regex.finditer(token, text)]
    lists = [regex.findall(token, p.lower()) for p, _ in rules]
    out, at, i = [], 0, 0
    while i < len(spans):
        fits = [(len(p), -n) for n, p in enumerate(lists) if p and [s[0] for s in spans[i : i + len(p)]] == p]
        if not fits:
            i += 1
            continue
        size, n = max(fits)
        out += [text[at : spans[i][1]], rules[-n][1]]
        at, i = spans[i + size - 1][2], i + size
    return "".join([*out, text[at:]])


def test_phrases_like_brute_force():
    rng = random.Random(7)
    for _ in range(400):
        rules = [(" ".join(rng.choice("abc'") for _ in range(rng.randint(0, 4))), str(n)) for n in range(rng.randint(0, 7))]
        text = "".join(rng.choice(["a", "B", "c", "'", " ", "  ", "\n", "x"]) + rng.choice(["", " "]) for _ in range(30))
        assert PhraseAutomaton([p for p, _ in rules]).edit(text, [r for _, r in rules]) == brute_edit(text, rules), (text, rules)


def test_phrase_columns(spark):
    rows = [(1, "The Software  Engineer and the engineer.", ["engineer", "software engineer", "the"], ["farmer", "cook"]), (2, None, ["a"], ["b"]), (3, "a b", None, None),
            (4, "a b", ["a", None, ""], [None, "x", "y"]), (5, "", ["a"], ["b"])]
    df = spark.createDataFrame(rows, "id int, t string, f array<string>, r array<string>").coalesce(1)
    got = df.orderBy("id").select(replace_phrases(F.col("t"), F.col("f"), F.col("r")).alias("x"), remove_phrases(F.col("t"), F.col("f")).alias("y")).collect()
    assert [r["x"] for r in got] == ["The cook and the farmer.", None, "a b", "a b", ""]
    assert [r["y"] for r in got] == ["  and  .", None, "a b", " b", ""]


def test_a_thousand_rules_cost_about_as_much_as_one():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(60_000))
    took = []
    for n in (1, 1000):
        rules = PhraseAutomaton([f"{rng.choice(words)} {rng.choice(words)}" for _ in range(n)])
        took.append(min(_timed(lambda: rules.edit(text, ["x"] * n)) for _ in range(3)))
    assert took[1] < 2.5 * took[0]


def _timed(fn):
    start = time.perf_counter()
    fn()
    return time.perf_counter() - start


# Spelling


def test_spelling_index_like_brute_force(spark):
    rng = random.Random(3)
    common = ["river", "stone", "gärten", "bridge", "rivers"]
    texts = [" ".join(rng.choice(common) for _ in range(100)) for _ in range(5)] + ["rivr stome gartén Stne brigde bridgee xriver riverss stöne gärte rivr far"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    counts = {}
    for w in " ".join(texts).lower().split():
        counts[w] = counts.get(w, 0) + 1

    def apart(a, b):
        cuts = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
        return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or b in cuts(a) or a in cuts(b)

    want = {}
    for w, n in counts.items():
        near = sorted((-m, x) for x, m in counts.items() if n >= 20 and m <= 2 and len(x) >= 4 and apart(w, x))
        if near:
            want[w] = (near[0][1], n, -near[0][0])
    got = {r["word"]: (r["misspelling"], r["n_word"], r["n_misspelling"]) for r in spelling_index(df, least_frequent=20).collect()}
    assert got == want and len(got) >= 4
    assert set(spark.range(1).select(deletions(F.lit("aab")).alias("d")).first()["d"]) == {"aab", "ab", "aa"}


def test_a_frequent_word_is_asked_for_in_portions(spark):
    rows = [(i, "river " * 20 + "!") for i in range(200)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "row_id bigint, text string").repartition(4)
    table = spark.createDataFrame([("river", "rivr")], "word string, misspelling string")
    got = {r["row_id"]: r["out"] for r in misspell(df, F.col("text"), F.col("row_id"), 3, table, "out", "row_id", share=0.5).collect()}
    assert got[500] is None and got[501] == "" and all(got[i].split().count("rivr") == 10 and got[i].split().count("river") == 10 for i in range(200))


# Random words


def test_more_keywords_than_words_get_a_word_each(spark):
    from driftline.operators.pools import Pool
    from driftline.operators.rewrites import _random_partners

    pool = Pool.of(spark.createDataFrame([(w,) for w in "xyz"], "w string"), "w")
    rows = [(i, [f"k{j}" for j in range(i)]) for i in range(12)] + [(50, None)]
    df = spark.createDataFrame(rows, "row_id bigint, kw array<string>")
    got = {r["row_id"]: r["to"] for r in _random_partners(df, Edit(words=pool), "kw", 0, 1, "to").collect()}
    assert got[50] in (None, []) and all(len(got[i]) == i for i in range(12))
    for i in range(12):
        assert all(sorted(got[i][at : at + 3]) == ["x", "y", "z"] for at in range(0, i - 2, 3)) and len(set(got[i][i // 3 * 3 :])) == i % 3
    assert len({tuple(got[i][at : at + 3]) for i in range(12) for at in range(0, i - 2, 3)}) > 2
