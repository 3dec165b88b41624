import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from driftline.llm.exact_dedup import exact_dedup

from .cases import collected, documents, rows

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(given, largest):
    groups = defaultdict(list)
    for i, t in given:
        groups[t or ""].append(i)
    out = []
    for i, t in given:
        known = [x for x in groups[t or ""] if x is not None]
        best = (max(known) if largest else min(known)) if known else None
        out.append((i, best, len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("fan_in", [2, 16])
def test_like_brute_force(spark, keep, fan_in):
    assert collected(exact_dedup(documents(spark), keep=keep, fan_in=fan_in), *COLUMNS) == brute(rows(), keep == "largest")


def test_a_text_that_all_rows_share(spark):
    given = [(i, "same") for i in range(500)]
    assert collected(exact_dedup(documents(spark, given).repartition(17)), *COLUMNS) == brute(given, False)


def test_normalised_texts(spark):
    out = exact_dedup(documents(spark, [(1, "A b"), (2, "a B")]), normalise=F.lower("text"))
    assert [tuple(r)[1:3] for r in out.collect()] == [(1, 2), (1, 2)]


def test_empty_table(spark):
    assert exact_dedup(documents(spark, [])).count() == 0
