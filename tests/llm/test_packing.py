from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sql import compare
from strandline.llm import queries
from strandline.llm.packing import lookup, pack, plan


def check(rows, sizes, capacity):
    """Whole items, none split needlessly, no container overfull or overlapping; gives the number of containers."""
    boxes, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
        if r.container_id is not None:
            boxes.setdefault(r.container_id, []).append((r.container_offset, r.n_tokens))
    assert set(pieces) == set(sizes)
    for k, n in sizes.items():
        got = sorted(pieces[k])
        assert sum(x[1] for x in got) == (n or 0)
        assert len(got) == max(1, -(-(n or 0) // capacity))
        at = 0
        for start, size in got:
            assert start == at
            at += size
    for content in boxes.values():
        at = 0
        for offset, size in sorted(content):
            assert offset >= at
            at = offset + size
        assert at <= capacity
    assert sorted(boxes) == list(range(len(boxes)))
    return len(boxes)


def test_documents(spark, sf01):
    sizes = {r.doc_id: len(r.ids) for r in queries.p7_ids(spark, sf01).collect()}
    rows = queries.p8_containers(spark, sf01).collect()
    n = check(rows, sizes, 2048)
    assert n <= 1.01 * -(-sum(sizes.values()) // 2048) + 1
    assert {r.context for r in rows} >= {512, 1024, 2048}
    fill = Counter()
    for r in rows:
        fill[r.step_group] += r.n_tokens
    groups = [v for k, v in fill.items() if k is not None]
    assert max(groups) - min(groups) <= 2 * 2048


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=25))
def test_plan_holds_everything(hist):
    groups = plan(hist, 40, (10, 20))
    held = Counter()
    for g in groups:
        used = sum(length * k for _, length, k in g.content)
        assert g.count > 0 and used + g.free == 40 and g.free >= 0
        for context, length, k in g.content:
            assert length <= context
            held[length] += g.count * k
    assert held == Counter(hist)
    total = sum(n * c for n, c in hist.items())
    assert sum(g.count for g in groups) <= max(1, 2 * total // 40 + 1) if hist else not groups
    assert len(groups) <= 6 * 40 + 3
    assert lookup(groups)["containers"][0] == sum(g.count for g in groups)


def test_cases(spark):
    rows = [(i, n, "x") for i, n in enumerate([0, None, 1, 7, 7, 7, 10, 11, 35, 3, 3, 3] + [4] * 300)]
    df = spark.createDataFrame(rows + [(None, 5, "x")], "doc_id long, n_tokens long, piece_no string")
    n = check(pack(df, capacity=10, tiers=(5,)).collect(), {r[0]: r[1] for r in rows}, 10)
    assert n <= 156 + 8
    assert pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        plan({11: 1}, 10)


def test_tiers_make_the_plan():
    """Windows of each context hold what they can, tiers change the plan, and no tiers are one best-fit packing."""
    rng = np.random.default_rng(3)
    hist = Counter(np.clip(rng.lognormal(5.6, 0.9, 30_000).astype(int), 1, 2048).tolist())
    need = -(-sum(n * c for n, c in hist.items()) // 2048)
    plans = [plan(hist, 2048, t) for t in ((256, 512, 1024), (512,), ())]
    assert all(sum(g.count for g in p) <= 1.005 * need + 1 for p in plans)
    assert plans[0] != plans[1] != plans[2] and {c for g in plans[0] for c, _, _ in g.content} == {256, 512, 1024, 2048}
    for g in plans[0]:  # contexts are whole windows: no item lies over the end of one
        taken = Counter()
        for context, length, k in g.content:
            taken[context] += length * k
        assert sum(taken.values()) <= 2048


def test_nothing_lost_and_well_filled(spark, sf, sf01):
    compare(queries.p8_check(spark, sf), queries.ORACLES["p8_check"], sf)
    row = queries.p8_fill(spark, sf01).first()
    print(row)
    assert row.broken == row.overlaps == row.overfull == 0 and 0.99 < row.fill <= 1
