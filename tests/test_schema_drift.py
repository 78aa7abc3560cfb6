import itertools
import json

from hypothesis import given, settings, strategies as st

from strandline.operators import schema_drift as sd
from strandline.plans import problems

FILES = "file_id long, tbl_name string, written_ns long, col_type int, structure string, column_order array<string>, column_types array<string>, path string"
RECORDS = "record_id long, file_id long, payload string, field string"


def declared(*fields):
    def one(f):
        name, kind, *rest = f
        if isinstance(kind, list):
            return {"name": name, "desc": "", "type": 6, "float_precision": 0, "structure": [one(x) for x in kind]}
        return {"name": name, "desc": rest[0] if rest else "", "type": {v: k for k, v in sd.TYPE_CODES.items()}[kind], "float_precision": 0, "structure": []}

    return json.dumps([one(f) for f in fields])


def run(spark, files, records):
    f = spark.createDataFrame([(*x, "p") for x in files], FILES)
    r = spark.createDataFrame([(i, *x, "f") for i, x in enumerate(records)], RECORDS)
    return f, r, sorted((x.file_id, x.change_kind, x.old_path, x.new_path) for x in sd.changes(f, r).collect())


def test_each_kind_of_change(spark):
    temp, press, mode = [21.5, 20, 22.25], [9000.5, 8800, 9100.25], ["idle", "run", "idle"]
    rec = lambda **k: [json.dumps({a: v[i] for a, v in k.items()}) for i in range(3)]
    files = [
        (1, "t", 10, 6, declared(("t_in", "float", "Inlet temperature."), ("p", "float"), ("mode", "string")), None, None),
        (2, "t", 20, 0, None, ["mode", "p", "env"], ["string", "float64", "map"]),  # t_in moved to env.temp
        (4, "t", 40, 6, declared(("p", "int"), ("env", [("temp", "float", "inlet temperature")]), ("mode", "string"), ("on", "bool")), None, None),
        (3, "t", 30, 0, None, ["p", "mode", "env"], ["float64", "string", "map"]),  # only another order
        (5, "t", 50, 6, declared(("mode", "string"), ("on", "bool"), ("rate", "float")), None, None),  # another quantity comes as two go
        (6, None, 1, 6, declared(("x", "int")), None, None),
        (7, "u", 1, 0, None, None, None),
        (8, "u", 2, 6, "{cut", None, None),
        (9, "u", 3, 0, None, ["a"], ["int64"]),
    ]
    nested = [json.dumps({"mode": m, "p": p, "env": {"temp": t}}) for m, p, t in zip(mode, press, temp)]
    records = [(1, x) for x in rec(t_in=temp, p=press, mode=mode)] + [(2, x) for x in nested] + [(3, x) for x in nested]
    records += [(4, json.dumps({"p": 9000, "env": {"temp": 21.5}, "mode": "run", "on": True, "undeclared": 1}))]
    records += [(5, json.dumps({"mode": "run", "rate": 0.5})), (5, '{"mode": "ru'), (5, None), (5, "[1]"), (None, "{}"), (77, "{}")]
    f, r, got = run(spark, files, records)
    assert got == [
        (2, "renamed", "t_in", "env.temp"),
        (4, "added", "", "on"), (4, "retyped", "p", "p"),
        (5, "added", "", "rate"), (5, "removed", "env.temp", ""), (5, "removed", "p", ""),
        (9, "added", "", "a"),
    ]
    table = {(x.record_id): x for x in sd.consistent_table(f, r).collect()}
    assert table[0].fields == {"env.temp": "21.5", "p": "9000.5", "mode": "idle"}  # under the last name
    assert table[9].fields == {"p": "9000", "env.temp": "21.5", "mode": "run", "on": "true"}
    assert [table[i].readable for i in (10, 11, 12, 13)] == [True, False, False, False] and 14 not in table
    assert sd.changes(f.limit(0), r.limit(0)).count() == 0 and sd.consistent_table(f, r.limit(0)).count() == 0


def test_many_distinct_texts_and_long_ones(spark):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    files = [(i, "t", i, 0, None, [p], ["string"]) for i, p in ((1, "from_whom"), (2, "sender_q"))] + [(i, "u", i, 0, None, [p], ["string"]) for i, p in ((3, "aa"), (4, "zz"))]
    records = [(1, json.dumps({"from_whom": name(i)})) for i in range(3000)] + [(2, json.dumps({"sender_q": name(i)})) for i in range(1500, 1505)]
    records += [(f, json.dumps({p: "x" * 40 + c * 3})) for f, p, c in ((3, "aa", "k"), (4, "zz", "w"))]
    _, _, got = run(spark, files, records)
    assert got == [(2, "renamed", "from_whom", "sender_q"), (4, "added", "", "zz"), (4, "removed", "aa", "")]


def test_table_keeps_records_of_files_without_fields(spark):
    files = [(1, "t", 1, 6, "{cut", None, None), (2, None, 2, 0, None, ["a"], ["int64"]), (3, "t", 3, 0, None, ["a"], ["int64"])]
    f, r, _ = run(spark, files, [(1, '{"a": 1}'), (2, '{"a": 2}'), (77, '{"a": 3}'), (3, '{"a": 4}'), (1, "{cut"), (None, "{}")])
    got = {x.record_id: (x.tbl_name, x.readable, x.fields) for x in sd.consistent_table(f, r).collect()}
    assert got == {0: ("t", True, {}), 1: (None, True, {}), 2: (None, True, {}), 3: ("t", True, {"a": "4"}), 4: ("t", False, {})}


def leaf(path, kind="float", quantity=None, values=(), shapes=()):
    n = len(values)
    return {"path": path, "type": kind, "quantity": quantity, "n_null": 0, "n_bool": 0, "n_true": 0, "n_int": 0, "n_frac": n, "n_str": 0, "s1": sum(values), "s2": sum(v * v for v in values), "shapes": list(shapes)}


def test_renames_need_type_and_quantity():
    a = leaf("a", values=[20, 21, 22])
    assert sd.edit_script([a], [leaf("b.a2", values=[21, 20.5, 22])]) == [("renamed", "a", "b.a2")]
    assert sorted(sd.edit_script([a], [leaf("b", values=[900, 910])])) == [("added", "", "b"), ("removed", "a", "")]
    assert sorted(sd.edit_script([a], [leaf("b", "int", values=[21, 22])])) == [("added", "", "b"), ("removed", "a", "")]
    assert sd.edit_script([leaf("x", "bool", "alarm")], [leaf("y", "bool", "alarm")]) == [("renamed", "x", "y")]
    assert len(sd.edit_script([leaf("x", "bool", "alarm")], [leaf("x2", "bool", "valve")])) == 2
    two = [leaf("a", values=[20, 21]), leaf("b", values=[400, 410])]
    assert sorted(sd.edit_script(two, [leaf("d", values=[405, 399]), leaf("c", values=[20.4, 20.1])])) == [("renamed", "a", "c"), ("renamed", "b", "d")]
    assert sd.edit_script([], []) == [] and sd.edit_script([a], [a]) == []


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 4).flatmap(lambda n: st.lists(st.lists(st.integers(0, 20), min_size=5, max_size=5), min_size=n, max_size=n)))
def test_assignment_is_of_least_cost(cost):
    got = sd.assign([[float(x) for x in row] for row in cost])
    assert len(set(got)) == len(cost)
    best = min(sum(cost[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(5), len(cost)))
    assert sum(cost[i][j] for i, j in enumerate(got)) == best


def tree(*leaves):
    return {x["path"]: x for x in leaves}


def test_subtrees_are_moved_as_such():
    parts = [("temp", [20, 21]), ("rate", [400, 410]), ("load", [0.1, 0.2])]
    old = tree(*[leaf(f"drive.{n}", values=v) for n, v in parts], leaf("mode", "string", "mode of operation"))
    for root in ("unit.drive", "motor", "unit.motor"):
        t = sd.TreeEdit(old, tree(*[leaf(f"{root}.{n}", values=v) for n, v in parts], leaf("mode", "string", "mode of operation")))
        assert sorted(t.script()) == sorted(("renamed", f"drive.{n}", f"{root}.{n}") for n, _ in parts)
        assert ("renamed", "drive", root) in t.structure_script()
        assert t.distance("", "") >= 0 and all(k != "removed" for k, _, _ in t.structure_script())
    # of two leaves that cost the same the one in the same structure is it
    t = sd.TreeEdit(tree(leaf("a.x", values=[5, 6]), leaf("a.k", "bool")), tree(leaf("b.x", values=[5, 6]), leaf("c.x", values=[5, 6]), leaf("b.k", "bool")))
    assert ("renamed", "a.x", "b.x") in t.script() and t.structure_script() == [("renamed", "a", "b"), ("added", "", "c")]
    assert sd.TreeEdit({}, {}).script() == [] == sd.TreeEdit(old, old).structure_script()
    deep = sd.TreeEdit(tree(leaf("a.b.c.d", values=[1, 2])), tree(leaf("a.d", values=[1, 2])))
    assert deep.script() == [("renamed", "a.b.c.d", "a.d")] and deep.structure_script() == [("removed", "a.b", ""), ("removed", "a.b.c", "")]


NAMES = st.sampled_from(["a", "b", "s.a", "s.b", "t.a", "t.u.a", "t.u.b", "c"])
LEAVES = st.dictionaries(NAMES, st.tuples(st.sampled_from(["float", "int"]), st.sampled_from([1, 2, 50, 900])), max_size=5)


@settings(max_examples=150, deadline=None)
@given(LEAVES, LEAVES)
def test_scripts_are_of_least_cost(before, after):
    old, new = ({p: leaf(p, k, values=[v, v + 1]) for p, (k, v) in x.items()} for x in (before, after))
    t = sd.TreeEdit(old, new)
    gone, came = [p for p in sorted(old) if p not in new], [p for p in sorted(new) if p not in old]
    price = lambda pairs: 2 * (sum(t.leaf(p, q) for p, q in pairs)) + 2 * (len(gone) + len(came) - 2 * len(pairs))
    best = min(
        price(list(zip(some, others)))
        for k in range(min(len(gone), len(came)) + 1) for some in itertools.combinations(gone, k) for others in itertools.permutations(came, k)
    )
    assert price(list(t.renamed.items())) <= best + 2 * 5 * sd.MOVE + 1e-9
    script = t.script()
    assert sorted(x[1] for x in script if x[0] in ("renamed", "removed")) == gone and sorted(x[2] for x in script if x[0] in ("renamed", "added")) == came


def test_projections_do_not_depend_on_ranges(spark):
    temp = [20.5, 21.5]
    names = ["a", "a", "b", "x.b", "x.b", "a", "c"]
    files = [(i, "t", i, 0, None, ["k", p.split(".")[0]], ["int64", "map" if "." in p else "float64"]) for i, p in enumerate(names, 1)]
    files += [(8, "t", 8, 0, None, ["k"], ["int64"]), (9, "t", 9, 0, None, ["k", "c"], ["int64", "float64"])]  # gone, and another one comes
    nest = lambda p, v: {p: v} if "." not in p else {p.split(".")[0]: nest(p.split(".", 1)[1], v)}
    records = [(i, json.dumps({"k": 1, **nest(p, t)})) for i, p in enumerate(names, 1) for t in temp] + [(8, '{"k": 1}'), (9, '{"k": 1, "c": 7000.5}')]
    f, r, _ = run(spark, files, records)
    got = [{(x.file_id, x.path): x.field for x in sd.projections(f, r, size).collect()} for size in (1, 2, 4, 500)]
    assert got[0] == got[1] == got[2] == got[3]
    assert {got[0][i, p] for i, p in enumerate(names, 1)} == {"c"} and got[0][9, "c"] == "c#2" and all(got[0][i, "k"] == "k" for i in range(1, 10))


def test_very_large_numbers_count(spark):
    f, r, _ = run(spark, [(1, "t", 1, 0, None, ["a"], ["float64"])], [(1, '{"a": 1e300}'), (1, '{"a": -1e999}'), (1, '{"a": NaN}'), (1, '{"a": 1%s}' % ("0" * 400))])
    row = sd.members(r).first()
    assert (row.n_null, row.n_int, row.n_frac) == (1, 1, 2) and row.s1 == 1e140 and row.s2 == 3e280


def test_whole_tables(spark, sf01):
    got = [tuple(r) for r in problems.p6_found(spark, sf01).select("file_id", "change_kind", "old_path", "new_path").collect()]
    assert len(got) == len(set(got)) > 100
    assert {x[1] for x in got} == {"added", "removed", "renamed", "retyped"}
    files = spark.read.parquet(f"{sf01}/schema_files.parquet")
    records = spark.read.parquet(f"{sf01}/raw_records.parquet")
    shuffled = sorted(tuple(r) for r in problems.p6_found(spark, sf01).collect())
    again = sd.changes(files.repartition(7), records.repartition(13)).drop("tbl_name", "written_ns")
    assert sorted(tuple(r) for r in again.collect()) == shuffled
    table = problems.p6_table(spark, sf01)
    assert table.count() == records.join(files, "file_id").count()
