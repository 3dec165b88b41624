import hashlib
import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from driftline.llm import secret_scan as S

from .cases import documents, prose, rows

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(spans)


def noise(rng, n, alphabet=string.ascii_letters + string.digits):
    return "".join(rng.choice(alphabet) for _ in range(n))


RNG = random.Random(4)
ODD = [
    "token=abc token: abcdefgh", "token=token: abcdefgh", "PassWord = 'hunter22' 🙂 api_key:\"x\" apikey:\"0123456789abcdef0123456789\"",
    "AKIA" + "A" * 15, "AKIA" + "B" * 16, "AKIAAKIA" + "C" * 13, "xAKIA" + "D" * 40, "f" * 23, "0" * 24, "secret:" * 50, "é" * 30 + " token=éabcdef",
    "deadbeefdeadbeefdeadbeef token = deadbeefdeadbeefdeadbeef", "tokenſ=abcdefg", "toKen=abcdefgh", "password==ab password===abcdef",
] + [f"{prose(i, 5)} {noise(RNG, 12, 'AKI0af= :')} token{noise(RNG, 3, '=: ')}{noise(RNG, 8)}" for i in range(60)]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(9)
    known = [(noise(rng, 32), True) for _ in range(300)] + [(noise(rng, 40, "0123456789abcdef"), True) for _ in range(100)]
    known += [(w, False) for i in range(40) for w in prose(i, 50).split(" ")] + [("snake_case_name", False), (None, True), ("x", None), ("", True)]
    return S.train_markov(spark.createDataFrame(known, "value string, is_random boolean"))


def test_base_spans_like_brute_force(spark, model):
    texts = ODD + [t for _, t in rows()]
    scanned = S.scan_secrets(documents(spark, list(enumerate(texts))), model)
    for r in scanned.select("text", "base", "spans", S.listed(F.col("base")).alias("told")).collect():
        assert [tuple(s) for s in r["base"]] == brute(r["text"] or "")
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}
        assert r["told"] == ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in brute(r["text"] or ""))


def test_models_tell_random_strings_from_identifiers(spark, model):
    rng = random.Random(11)
    secrets = [noise(rng, 28) for _ in range(200)]
    names = ["_".join(prose(i, 4).split(" ")) for i in range(200)]
    found = {r["doc_id"]: r["spans"] for r in S.scan_secrets(documents(spark, list(enumerate(f"so {t} on" for t in secrets + names))), model).collect()}
    hits = [len(found[i]) == 1 and tuple(found[i][0]) == (3, 3, 31) for i in range(200)]
    assert sum(hits) >= 160  # the rest stays below the odds of ten thousand to one that a finding takes
    assert sum(bool(found[200 + i]) for i in range(200)) <= 4


def test_a_model_without_samples_finds_nothing(spark):
    empty = S.train_markov(spark.createDataFrame([], "value string, is_random boolean"))
    assert set(empty.ratios) == {0}
    assert [len(r["spans"]) for r in S.scan_secrets(documents(spark, [(1, noise(RNG, 60))]), empty).collect()] == [0]


def test_labels_come_from_the_patterns(spark):
    docs = documents(spark, [(i, f"{prose(i, 30)} token={noise(random.Random(i), 20)}") for i in range(50)])
    found = S.labelled_by_patterns(docs).groupBy("is_random").count().collect()
    assert {r["is_random"]: r["count"] for r in found}[True] == 50
    assert S.labelled_by_patterns(documents(spark, [])).count() == 0


def test_redaction_leaves_the_rest(spark, model):
    texts = [t for t in ODD if t]
    scanned = S.scan_secrets(documents(spark, list(enumerate(texts))), model)
    for r in scanned.select("text", "spans", S.redact(F.col("text"), F.col("spans"), "#").alias("out")).collect():
        out, at = "", 0
        for a, _, b in sorted(tuple(s) for s in r["spans"]):
            if a >= at:
                out += r["text"][at:a] + "#"
            at = max(at, b)
        assert r["out"] == out + r["text"][at:]
        assert hashlib.sha256(r["text"].encode()).digest() == hashlib.sha256(r["out"].encode()).digest() or r["spans"]


def brute_random(text, model):
    """Candidates that touch no base span and whose ratio says random, in plain Python."""
    taken, n = brute(text), len(S.ALPHABET)
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
        at = [S.ALPHABET.index(c) for c in m.group()]
        if sum(model.ratios[a * n + b] for a, b in zip(at, at[1:])) > model.threshold and not any(a < m.end() and b > m.start() for a, _, b in taken):
            out.append((m.start(), 3, m.end()))
    return out


def test_random_spans_like_brute_force(spark, model):
    rng = random.Random(21)
    texts = ODD + [t for _, t in rows() if t] + [" ".join(noise(rng, rng.randint(10, 60), "abcdefgh+/_=-0123XYZ") for _ in range(30)) for _ in range(20)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in S.scan_secrets(documents(spark, list(enumerate(texts))), model).collect()}
    assert all(got[i] == sorted(brute(t) + brute_random(t, model)) for i, t in enumerate(texts)) and sum(map(len, got.values())) > 100


def test_sums(spark):
    given = [[], [5], [1, 2], [0, 0, 3], [*range(10)], [1] * 101]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x array<int>")
    got = [r["s"] for r in df.orderBy("i").select(S.running_sums(F.col("x")).alias("s")).collect()]
    assert got == [[sum(x[: k + 1]) for k in range(len(x))] for x in given]


def test_very_long_candidates_and_very_many_matches(spark, model):
    """Both take time in proportion, or nearly: the first version took 80 s for 80,000 letters."""
    rng = random.Random(5)
    long, many = noise(rng, 2_000_000), " token=abcdef1" * 50_000
    start = time.time()
    got = {r["doc_id"]: r for r in S.scan_secrets(documents(spark, [(1, long), (2, many)]), model).select("doc_id", F.size("spans").alias("n"), F.get("spans", F.lit(0)).alias("s")).collect()}
    assert time.time() - start < 120
    assert tuple(got[1]["s"]) == (0, 3, 2_000_000) and got[2]["n"] == 50_000
