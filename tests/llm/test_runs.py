import json
from functools import reduce

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from strandline.llm import queries
from strandline.llm.runs import FIRST, INNER, ONLY, alike, collapse_runs, encode_chunk, merge, shape_of

SCHEMA = "tag_key long, ts_ns long, val string, entry_id long, k string"


def plain(rows, gap=600 * 10**9):
    """Runs by going through all entries in order."""
    out, seen, last = [], set(), None
    for k, t, e, v in sorted((r[0], r[1], r[3], r[2]) for r in rows if r[0] and r[1] is not None and r[2] is not None):
        if (k, t) in seen:
            continue
        seen.add((k, t))
        if last and last[0] == k and t - last[1] <= gap and alike(last[2], v):
            out[-1][2], out[-1][3] = t, out[-1][3] + 1
        else:
            out.append([k, t, t, 1])
        last = (k, t, v)
    return {tuple(x) for x in out}


def test_whole_table_against_plain_order(spark, sf01):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf01}/wal_entries.parquet").select("tag_key", "ts_ns", "val", "entry_id").collect()]
    got = queries.p4_runs(spark, sf01).select("tag_key", "start_ns", "end_ns", "n").collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plain(rows)
    found = {tuple(r) for r in queries.p4_found(spark, sf01).collect()}
    assert found == {x[:3] for x in plain(rows) if x[3] >= 2}


def test_a_run_over_many_chunks_and_edge_cases(spark):
    s = 10**9
    rows = [(7, i * s, "1.0" if i % 2 else " 1.0005 ", i) for i in range(400)]
    rows += [(7, i * s, "1.0", 1000 + i) for i in range(50)]  # written again
    rows += [(None, 1, "1", 1), (0, 1, "1", 2), (8, 1, None, 3), (9, None, "1", 4), (8, 2, "", 5), (8, 3, "{cut", 6), (8, 4, "{cut", 7)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    for chunks in (1, 3, 16):
        got = {tuple(r) for r in collapse_runs(df, "tag_key", "ts_ns", "val", "entry_id", chunks=chunks).select("tag_key", "start_ns", "end_ns", "n").collect()}
        assert got == {(7, 0, 399 * s, 400), (8, 2, 2, 1), (8, 3, 4, 2)}
    assert collapse_runs(df.limit(0), "tag_key", "ts_ns", "val", "entry_id").count() == 0


def test_alternating_values_stay_apart(spark):
    rows = [(7, i * 10**9, str(5 + i % 2), i) for i in range(401)] + [(8, i * 10**9, "57"[i % 3 == 1], i) for i in range(99)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    want = plain(rows)
    for chunks, fan in ((1, 2), (4, 2), (40, 3)):
        got = [tuple(r) for r in collapse_runs(df, "tag_key", "ts_ns", "val", "entry_id", chunks=chunks, fan=fan).select("tag_key", "start_ns", "end_ns", "n").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def summaries(rows, cuts, batch, least):
    """Summaries of the chunks that the rows are cut into, and the runs final within them."""
    out, final = [], []
    for part, (a, z) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        cols = list(zip(*rows[a:z])) or [(), (), ()]
        table = pa.Table.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["k", "t", "v"])
        got = [tuple(r.values())[1:] for b in encode_chunk(table.to_batches(batch), part, 600 * 10**9, 0.001, least) for r in b.to_pylist()]
        final += [r[1:] for r in got if r[0] == INNER]
        edges = tuple(r[1:] for r in sorted(got) if r[0] != INNER)
        assert [r[0] for r in sorted(got) if r[0] != INNER] in ([], [ONLY], [FIRST, FIRST + 1])
        if edges:
            out.append(edges)
    return out, final


ENTRIES = st.lists(st.tuples(st.integers(1, 2), st.integers(0, 60), st.sampled_from(["1", "1.0004", "2", '"a"', str(list(range(40))), str([*range(39), 38])])), min_size=1, max_size=60)


@settings(max_examples=200, deadline=None)
@given(ENTRIES, st.lists(st.integers(0, 60), max_size=8), st.integers(1, 7), st.integers(1, 2), st.randoms())
def test_merging_is_associative_and_exact(entries, cuts, batch, least, random):
    entries = sorted({(k, t * 100 * 10**9): (k, t * 100 * 10**9, v) for k, t, v in entries}.values())
    parts, final = summaries(entries, sorted({c for c in cuts if c < len(entries)}), batch, least)
    order = list(parts)
    while len(order) > 1:  # any two neighbours first
        i = random.randrange(len(order) - 1)
        whole, inside = merge(order[i], order[i + 1])
        order[i : i + 2] = [whole]
        final += inside
    got = sorted(r[:4] for r in [*final, *order[0]] if r[3] >= least)
    assert got == sorted(r for r in plain([(k, t, v, i) for i, (k, t, v) in enumerate(entries)]) if r[3] >= least)
    assert reduce(lambda a, b: merge(a, b)[0], parts) == order[0]


def test_alike():
    assert alike("20.4003", "2.04e1") and not alike("1", "1.002") and alike("1.001", "1")
    assert alike('" Open"', '"open "') and not alike('"1"', "1") and not alike("true", "1")
    assert alike('{"a": 1, "b": "X"}', '{"b":"x","a":1.0005}') and not alike('{"a":1}', '{"a":1,"b":2}')
    assert not alike("null", "false") and alike("[1, 2]", "[1,2.0]")


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3)))
def test_shape_ignores_writing(v):
    assert shape_of(json.dumps(v)) == shape_of(json.dumps(v, indent=2, sort_keys=True))
