import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import quality as Q

from .cases import documents, prose, rows

TESTDATA = "/root/testdata/sf0.01"


def brute_marginals(crf, x):
    """Chances of the good label by summing over all labellings."""
    n, total, good = len(x), 0.0, np.zeros(len(x))
    own = x @ crf.weights
    for code in range(1 << n):
        y = [code >> i & 1 for i in range(n)]
        weight = np.exp(sum(own[i, y[i]] for i in range(n)) + sum(crf.moves[a, b] for a, b in zip(y, y[1:])))
        total += weight
        good += weight * np.array(y)
    return good / total


def test_marginals_like_brute_force():
    rng = np.random.default_rng(3)
    lengths = [1, 4, 7, 2, 7, 3]
    x = rng.standard_normal((sum(lengths), 5))
    crf = Q.LineCrf(rng.standard_normal((5, 2)), rng.standard_normal((2, 2)))
    at = np.concatenate([[0], np.cumsum(lengths)])
    got = crf.marginals(x, at)[:, 1]
    for a, b in zip(at[:-1], at[1:]):
        assert np.allclose(got[a:b], brute_marginals(crf, x[a:b]))


def test_features_in_batches_are_those_of_single_texts():
    texts = [t or "" for _, t in rows() if t is None or len(t) < 20_000]
    x, at, size = Q.line_features(pa.array(texts))
    assert at[-1] == sum(t.count("\n") + 1 for t in texts)
    for i, t in enumerate(texts):
        one, _, one_size = Q.line_features(pa.array([t]))
        assert np.array_equal(one, x[at[i] : at[i + 1]]) and np.array_equal(one_size, size[at[i] : at[i + 1]])


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = (spark.read.parquet(f"{TESTDATA}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, Q.train_quality(docs, labels.filter(~Q.held_out()))


def test_held_out_accuracy(spark, trained):
    docs, labels, model = trained
    rows_ = docs.join(labels, "doc_id").filter(Q.held_out()).select("quality", Q.quality_score(model).alias("s")).collect()
    good, bad = [r["s"] for r in rows_ if r["quality"]], [r["s"] for r in rows_ if not r["quality"]]
    assert len(good) > 40 and len(bad) > 3
    assert np.mean([s >= 0.3 for s in good]) >= 0.98 and np.mean([s < 0.3 for s in bad]) >= 0.8
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.98


def test_any_row_gets_a_score(spark, trained):
    scores = [r["s"] for r in documents(spark).select(Q.quality_score(trained[2]).alias("s")).collect()]
    assert len(scores) == len(rows()) and all(0 <= s <= 1 for s in scores)
    assert documents(spark, []).select(Q.quality_score(trained[2])).count() == 0


def test_without_labels_nothing_is_known(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.train_quality(documents(spark), none)
    assert {r["s"] for r in documents(spark).select(Q.quality_score(model).alias("s")).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (4, 1), (None, 0), (5, None)], "doc_id long, quality int")
    assert not Q.train_quality(documents(spark), one).weights.any()


def test_labels_and_identifiers_are_no_inputs(spark, trained):
    a = documents(spark, [(1, prose(1, 40))]).select(Q.quality_score(trained[2]).alias("s")).first()["s"]
    b = documents(spark, [(99, prose(1, 40))]).select(Q.quality_score(trained[2]).alias("s")).first()["s"]
    assert a == b
