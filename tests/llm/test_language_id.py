import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import language_id as L

from .cases import documents, rows

TESTDATA = "/root/testdata/sf0.01"


def brute_grams(text):
    """The n-grams of the words of a text, each word with a blank on both sides; runs of blanks only are none."""
    words = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text).split()
    found = Counter()
    for w in words:
        w = f" {w} "
        found.update(g for n in range(1, L.LONGEST + 1) for i in range(len(w) - n + 1) if (g := w[i : i + n]).strip())
    # The blank between two words belongs to the word before it and to the one behind it.
    return found


def bucket_of(gram):
    one = pa.array([gram.strip()])
    code, mask = 0, (1 << 64) - 1
    for size, c in enumerate(gram, 1):
        code = (code + ord(c) + size) * int(L._STEP) & mask
        code ^= code >> 31
    return (code * int(L._MIX) & mask) >> (64 - L.BITS), one


def counts_of(text):
    found = Counter()
    for place, bucket in L.grams(pa.array([text])):
        found.update(bucket.tolist())
    return found


@pytest.mark.parametrize("window", [1 << 20, 7])
def test_grams_like_brute_force(monkeypatch, window):
    monkeypatch.setattr(L, "WINDOW", window)
    texts = [t or "" for _, t in rows() if t is None or len(t) < 5000] + ["a", " a", "a b", "ab  cd!", "", "..", "İstanbul ẞ", "1a2"]
    want = []
    for t in texts:
        of = Counter()
        for g, n in brute_grams(t).items():
            of[bucket_of(g)[0]] += n
        want.append(of)
    got = [Counter() for _ in texts]
    for place, bucket in L.grams(pa.array(texts)):
        for p, b in zip(place.tolist(), bucket.tolist()):
            got[p][b] += 1
    assert got == want


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    return docs, L.train_languages(docs.filter(~L.held_out()))


def test_scores_like_brute_force(spark):
    given = [("en", "the cat sat"), ("en", "the dog"), ("de", "der hund und"), (None, "le chat"), ("fr", None), ("de", "...")]
    docs = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "doc_id long, lang string, text string").repartition(3)
    model = L.train_languages(docs)
    assert model.languages == ("de", "en")
    counts = {l: sum((counts_of(t) for k, t in given if k == l and t), Counter()) for l in ("de", "en")}
    prior = {"de": math.log(3 / 6), "en": math.log(3 / 6)}
    for text in ("the hund", "katze", "Der Dog!", "x"):
        score = {l: prior[l] + sum(n * math.log((c[b] + 0.1) / (sum(c.values()) + 0.1 * L.BUCKETS)) for b, n in counts_of(text).items()) for l, c in counts.items()}
        chances, seen = model.posteriors(pa.array([text]))
        assert seen[0] and chances[0, 0] == pytest.approx(1 / (1 + math.exp(score["en"] - score["de"])), rel=1e-3, abs=1e-9)


def test_held_out_accuracy(spark, trained):
    docs, model = trained
    found = docs.filter(L.held_out()).filter("lang IS NOT NULL AND text rlike '[a-zA-Z]'").select("lang", L.language(spark, model).alias("p")).collect()
    assert len(found) > 150 and np.mean([r["lang"] == r["p"]["lang"] for r in found]) > 0.97


def test_any_row_gets_a_language(spark, trained):
    found = {r["doc_id"]: r["p"] for r in documents(spark).select("doc_id", L.language(spark, trained[1]).alias("p")).collect()}
    assert all(p["lang"] in (*trained[1].languages, "und") and 0 <= p["score"] <= 1 for p in found.values())
    assert [found[i]["lang"] for i in (7, 8, 9)] == ["und"] * 3 and found[7]["score"] == 0 and found[10]["lang"] != "und"
    assert documents(spark, []).select(L.language(spark, trained[1])).count() == 0


def test_without_training_rows_nothing_is_known(spark):
    model = L.train_languages(documents(spark).selectExpr("text", "CAST(NULL AS STRING) AS lang"))
    assert {tuple(r["p"]) for r in documents(spark).select(L.language(spark, model).alias("p")).collect()} == {("und", 0.0)}
    with pytest.raises(Exception, match="over 3 languages"):
        L.train_languages(documents(spark).selectExpr("text", "text AS lang"), most_languages=3)


def test_texts_are_the_only_input(spark, trained):
    df = spark.createDataFrame([(1, "en", "der Hund und die Katze"), (2, None, "der Hund und die Katze")], "doc_id long, lang string, text string")
    a, b = df.select(L.language(spark, trained[1]).alias("p")).collect()
    assert a == b
