from collections import Counter, defaultdict

import numpy as np
import pytest

from driftline.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, node string, unit string, cells int"


def table(spark, given):
    return spark.createDataFrame([(i, v, lab, "x", "y", 3) for i, v, lab in given], SCHEMA).repartition(3)


def brute(given, threshold=0.98):
    def usable(v, label):
        return v is not None and label is not None and len(v) and all(x is not None for x in v) and np.isfinite(np.array(v, np.float32)).all() and np.any(v)

    good = [i for i, (_, v, label) in enumerate(given) if usable(v, label)]
    unit = {i: np.float32(given[i][1]).astype(float) for i in good}
    unit = {i: u / np.linalg.norm(u / np.abs(u).max()) / np.abs(u).max() for i, u in unit.items()}
    links = defaultdict(set)
    for i in good:
        for j in good:
            if i != j and given[i][2] == given[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i].add(j)
    out = []
    for i, (name, _, _) in enumerate(given):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        smallest = min(given[k][0] for k in seen)
        out.append((name, len(links[i]), smallest, name == smallest))
    return Counter(out)


def vectors(n, seed, groups=8, spread=0.08, dims=32):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    return [(i, (centres[i % groups] + spread * rng.standard_normal(dims)).tolist(), i % 3) for i in range(n)]


ODD = [
    (1000, None, 1), (1001, [], 1), (1002, [0.0] * 32, 1), (1003, [None] + [1.0] * 31, 1), (1004, [float("nan")] + [1.0] * 31, 1),
    (1005, [float("inf")] + [1.0] * 31, 1), (1006, [1.0] * 32, None), (1007, [1.0] * 32, 1), (1008, [1.0] * 16, 1), (1009, [1.0] * 16, 1),
    (1010, [1e-38] * 32, 1), (1011, [3e38] * 32, 1), (1012, [2.0] * 32, 2),
]


def found(df, **more):
    return Counter(tuple(r) for r in E.embedding_dedup(df, **more).select("vec_id", "n_links", "component_id", "kept").collect())


def test_like_brute_force(spark):
    given = vectors(150, 1) + ODD + vectors(150, 1)[:5]
    given += [(2000 + i, *given[0][1:]) for i in range(20)]
    assert found(table(spark, given)) == brute(given)


@pytest.mark.parametrize("cell", [16, 64])
def test_cells_and_chunks(spark, monkeypatch, cell):
    """Several tables, lines and chunks find the links that one cell finds, up to the recall."""
    monkeypatch.setattr(E, "CELL", cell)
    monkeypatch.setattr(E, "CHUNK", 8)
    given = vectors(240, 2, groups=20, spread=0.05)
    wanted, got = brute(given), found(table(spark, given))
    links = {k[0]: k[1] for k in wanted}
    mine = {k[0]: k[1] for k in got}
    assert all(mine[i] <= links[i] for i in links)
    assert sum(mine.values()) >= 0.99 * sum(links.values()) > 0


def test_recall_at_the_threshold():
    """Pairs exactly at a cosine of 0.98 pass the count as often as was asked for."""
    rng = np.random.default_rng(5)
    how, hits, n = E.Calibration.of(0.98, 0.999, 1000), 0, 1500
    for _ in range(n):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b)
        hits += any(len(i) for i, _ in E.collisions(np.stack([a, b]), how))
    assert hits >= 0.99 * n


def test_empty_table(spark):
    assert E.embedding_dedup(table(spark, [])).count() == 0
