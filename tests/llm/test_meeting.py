"""Rows that have keys in common, against plain Python."""

import numpy as np
import pytest

meeting = pytest.importorskip("sheetframe.llm.meeting")
components = pytest.importorskip("sheetframe.llm.components")


@pytest.mark.parametrize("run,spread", [(3_000_000, 2_000_000), (5, 7)])
def test_meeting(spark, monkeypatch, run, spread):
    """With one run for a task and with many, one key held by a third of the rows."""
    monkeypatch.setattr(meeting, "RUN", run)
    monkeypatch.setattr(meeting, "RANGE", spread)
    rng = np.random.default_rng(3)
    rows = [(i, sorted({int(x) * 0x1E3779B97F4A7C for x in rng.integers(1, 150, rng.integers(0, 7))} | ({-5} if i % 3 == 0 else set()))) for i in range(90)]
    df = spark.createDataFrame(rows, "row long, keys array<long>").repartitionByRange(5, "row").sortWithinPartitions("row")
    size = sum(len(k) for _, k in rows)
    holders = {}
    for i, keys in rows:
        for k in keys:
            holders.setdefault(k, []).append(i)
    want = {i: n for i, keys in rows if (n := sum(len(holders[k]) > 1 for k in keys))}
    assert {r.row: r.shared for r in meeting.shared_counts(df, meeting.listed, size).collect()} == want
    edges = meeting.stars(df, meeting.listed, size).collect()
    assert len(set(edges)) == len(edges) and all(e.a < e.b for e in edges)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for own in holders.values():
        for i in own:
            root[max(find(i), find(own[0]))] = min(find(i), find(own[0]))
    found = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: find(i) for i, _ in rows if sum(find(j) == find(i) for j, _ in rows) > 1}
    assert meeting.shared_counts(df.limit(0), meeting.listed, 0).count() == 0


@pytest.mark.parametrize("contract", [1_000_000, 7])
def test_components_in_parts(spark, monkeypatch, contract):
    """A long path, a hub and separate pairs, contracted in one task and in many."""
    monkeypatch.setattr(components, "CONTRACT", contract)
    monkeypatch.setattr(components, "HUB", 10)
    edges = [(1, 2), (2, 3), (5, 5), (None, 1), *((i, i + 1) for i in range(100, 160)), *((500, 501 + i) for i in range(50)), (530, 700), (160, 900)]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 700: 500, 900: 100, **{i: 100 for i in range(100, 161)}, **{500 + i: 500 for i in range(51)}}
