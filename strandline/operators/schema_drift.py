"""Schemas that drift between files: tree edit scripts of least cost, and projections compiled from them.

The schema of a file is a tree: structures (and maps) are inner nodes, typed fields are leaves. Between a file and the one before it in its table the
edit script of least cost is found, of additions, deletions, renamings and moves of nodes, whole subtrees included, and changes of a leaf's type. The order of
siblings means nothing, so the distance is that of unordered trees: children are matched by an assignment of least cost, from the leaves up; what is
left over on both sides is matched once more over all levels, as moves. Turning one leaf into another costs less than deleting and adding only where it has
the same type and carries on the same quantity, judged by what describes it (its description, or what its name is described as anywhere in the
corpus) and by the values in the files' records. A leaf whose path stays is the same leaf. Edits of leaves weigh more than those of inner nodes, which
decide between scripts that cost the same at the leaves. The scripts of a table are compiled into one projection per
file, which maps each of its paths to the field of the consistent table: per range of files into a mapping from the paths before to those after, and the
mappings, which compose associatively, from range to range.
"""

from __future__ import annotations

import difflib
import json
import math
import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strandline.session import materialize, spread

DECLARED, STRUCTURE = 6, 6
#: The type codes of declared fields and the names of adaptive column types.
TYPE_CODES = {1: "int", 2: "float", 3: "string", 4: "bool"}
ADAPTIVE_TYPES = {"int64": "int", "uint64": "int", "float64": "float", "string": "string", "bool": "bool"}
#: Cost of adding or deleting a leaf. A rename must cost less than one of each.
EDIT = 1.0
_UNLIKE = 9.0
#: Cost of a move to a parent that isn't its own any more, and of adding, deleting or renaming an inner node.
MOVE, INNER = 0.001, 0.01
#: Files of a table whose scripts are composed in one task; magnitudes beyond LARGEST count as that, so that sums of squares stay finite.
RANGE, LARGEST = 500, 1e140


def declared_leaves(structure: str | None) -> list[tuple[str, str | None, str | None]]:
    """(path, type, description) of the leaves of a declared structure; a text that isn't such JSON has none."""
    out: list[tuple[str, str | None, str | None]] = []

    def walk(fields, prefix: str) -> None:
        for f in fields if isinstance(fields, list) else []:
            if not isinstance(f, dict) or not isinstance(f.get("name"), str):
                continue
            if f.get("type") == STRUCTURE:
                walk(f.get("structure"), f"{prefix}{f['name']}.")
            else:
                desc = re.sub(r"\s+", " ", str(f.get("desc") or "")).strip().rstrip(".").lower()
                out.append((prefix + f["name"], TYPE_CODES.get(f.get("type")), desc or None))

    try:
        walk(json.loads(structure), "")
    except (TypeError, ValueError, RecursionError):
        pass
    return out


def _file_leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for file_id, kind, structure, order, types in pdf.itertuples(index=False):
            if kind == DECLARED:
                out += [(file_id, p, t, d, False) for p, t, d in dict((x[0], x) for x in declared_leaves(structure)).values()]
            elif order is not None and types is not None:
                for name, t in dict(zip(order, types)).items():
                    if name is not None:
                        out.append((file_id, name, ADAPTIVE_TYPES.get(t), None, t == "map"))
        yield pd.DataFrame(out, columns=["file_id", "path", "type", "desc", "is_map"])


def flatten(record: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    for k, v in record.items():
        if isinstance(v, dict):
            yield from flatten(v, f"{prefix}{k}.")
        else:
            yield prefix + k, v


def shape_of(text: str) -> str:
    """A string with digits as 9; with capitals as A too if it has digits."""
    out = re.sub(r"\d", "9", text.strip())
    return re.sub(r"[A-Z]", "A", out) if out != text.strip() else out.lower()


def shape_code(shape: str) -> int:
    """64-bit hash of a whole shape; a field's set of shapes is kept whole, as such codes."""
    return int.from_bytes(blake2b(shape.encode(errors="surrogatepass"), digest_size=8).digest(), "big", signed=True)


_STATS = ["n_null", "n_bool", "n_true", "n_int", "n_frac", "n_str", "s1", "s2"]


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per (file, path) what the values are like; partial sums of a batch."""
    for pdf in frames:
        acc: dict[tuple[int, str], list] = {}
        for file_id, payload in pdf.itertuples(index=False):
            try:
                record = json.loads(payload)
            except (TypeError, ValueError, RecursionError):
                continue
            if not isinstance(record, dict):
                continue
            for path, v in flatten(record):
                a = acc.setdefault((file_id, path), [0, 0, 0, 0, 0, 0, 0.0, 0.0, set()])
                if v is None:
                    a[0] += 1
                elif isinstance(v, bool):
                    a[1] += 1
                    a[2] += v
                elif v != v:  # NaN, which is no number
                    a[0] += 1
                elif isinstance(v, (int, float)):
                    a[3 if isinstance(v, int) else 4] += 1
                    x = float(max(-LARGEST, min(LARGEST, v)))
                    a[6] += x
                    a[7] += x * x
                elif isinstance(v, str):
                    a[5] += 1
                    a[8].add(shape_code(shape_of(v)))
        yield pd.DataFrame([(f, p, *a[:8], sorted(a[8])) for (f, p), a in acc.items()], columns=["file_id", "path", *_STATS, "shapes"])


def members(records: DataFrame) -> DataFrame:
    """(file_id, path, counts by kind, sums, shapes) of the values in the records; payloads that can't be parsed give none."""
    part = spread(records.where("file_id is not null and payload is not null").select("file_id", "payload")).mapInPandas(
        _members,
        "file_id long, path string, n_null long, n_bool long, n_true long, n_int long, n_frac long, n_str long, s1 double, s2 double, shapes array<bigint>",
    )
    each = [F.sum(c).alias(c) for c in _STATS]
    return part.groupBy("file_id", "path").agg(*each, F.array_sort(F.array_distinct(F.flatten(F.collect_set("shapes")))).alias("shapes"))


def _kind() -> F.Column:
    numbers = F.col("n_int") + F.col("n_frac")
    return (
        F.when((F.col("n_str") > F.greatest(numbers, "n_bool")), "string")
        .when((F.col("n_bool") > numbers), "bool")
        .when(F.col("n_frac") > 0, "float")
        .when(F.col("n_int") > 0, "int")
    )


def leaves(files: DataFrame, records: DataFrame) -> DataFrame:
    """(file_id, path, type, desc, quantity, statistics) of every field of every file.

    A declared file has the fields of its structure; an adaptive one its columns, where a map is opened by the members found in its
    records (their type by the values; null if all are null). ``quantity`` is the field's description, else the one its
    name has most often in the corpus.
    """
    flat = files.where("file_id is not null").select("file_id", "col_type", "structure", "column_order", "column_types").mapInPandas(
        _file_leaves, "file_id long, path string, type string, desc string, is_map boolean"
    )
    flat = materialize(flat, "leaves")
    seen = materialize(members(records), "members")
    stats = [*_STATS, "shapes"]
    plain = flat.where("not is_map").select("file_id", "path", "type", "desc").join(seen, ["file_id", "path"], "left")
    maps = flat.where("is_map").select("file_id", F.col("path").alias("root"))
    inside = (
        seen.withColumn("root", F.substring_index("path", ".", 1))
        .where("path != root")
        .join(maps, ["file_id", "root"])
        .select("file_id", "path", _kind().alias("type"), F.lit(None).cast("string").alias("desc"), *stats)
    )
    every = plain.unionByName(inside).withColumn("name", F.substring_index("path", ".", -1))
    described = flat.where("desc is not null").select(F.substring_index("path", ".", -1).alias("name"), "desc")
    usual = (
        described.groupBy("name", "desc")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("name")
        .agg(F.max(F.struct("c", "desc")).alias("top"))
        .select("name", F.col("top.desc").alias("usual"))
    )
    return every.join(usual, "name", "left").select("file_id", "path", "type", F.coalesce("desc", "usual").alias("quantity"), *stats)


def rename_cost(a: dict, b: dict) -> float:
    """Cost of turning leaf ``a`` into ``b``: below two edits only for the same type and the same quantity."""
    if a["type"] != b["type"] and a["type"] and b["type"]:
        return _UNLIKE
    name_a, name_b = (x["path"].rpartition(".")[2] for x in (a, b))
    named = 0.0 if name_a == name_b else 1 - difflib.SequenceMatcher(None, name_a.lower().replace("_", ""), name_b.lower().replace("_", "")).ratio()
    values = _value_distance(a, b)
    if a["quantity"] and b["quantity"]:
        if a["quantity"] != b["quantity"]:
            return _UNLIKE
        return 0.1 + 0.3 * named + (0.3 * values if values is not None else 0.1) if (values or 0) <= 2 else _UNLIKE
    if name_a == name_b:
        return 0.2 + 0.3 * (values or 0) if (values or 0) <= 2 else _UNLIKE
    if values is None:  # nothing but the names to go by
        return 0.5 + named if named <= 0.5 else _UNLIKE
    return 0.5 + 0.5 * named + values if values <= 0.8 else _UNLIKE


def _value_distance(a: dict, b: dict) -> float | None:
    """0 for values alike, 1 for a factor of e between the means or no shape in common; None if the values don't tell."""
    na, nb = (x["n_int"] + x["n_frac"] for x in (a, b))
    if na and nb:
        ma, mb = a["s1"] / na, b["s1"] / nb
        spread = math.sqrt(max(0.0, a["s2"] / na - ma * ma) + max(0.0, b["s2"] / nb - mb * mb))
        if abs(ma - mb) <= spread:
            return 0.0
        if ma * mb <= 0:
            return 3.0
        return abs(math.log(ma / mb))
    sa, sb = (set(x["shapes"]) for x in (a, b))
    if sa and sb:
        return 1 - len(sa & sb) / min(len(sa), len(sb))
    return None


def assign(cost: list[list[float]]) -> list[int]:
    """Column of each row in the assignment of least total cost (shortest augmenting paths); rows <= columns."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used, way = [math.inf] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while match[j0]:
            used[j0] = True
            i0, delta, j1 = match[j0], math.inf, 0
            for j in range(1, m + 1):
                if used[j]:
                    continue
                cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                if cur < low[j]:
                    low[j], way[j] = cur, j0
                if low[j] < delta:
                    delta, j1 = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def _parents(path: str) -> list[str]:
    """The inner nodes that a path goes through, the root ('') first."""
    parts = path.split(".")[:-1]
    return ["", *(".".join(parts[: i + 1]) for i in range(len(parts)))]


class _Tree:
    """Leaves by path, and per inner node its leaves and inner children."""

    def __init__(self, leaves: dict[str, dict]):
        self.leaves: dict[str, list[str]] = {"": []}
        self.inner: dict[str, list[str]] = {"": []}
        for path in leaves:
            up = _parents(path)
            for parent, node in zip(up, up[1:]):
                if node not in self.inner:
                    self.inner[parent].append(node)
                    self.inner[node], self.leaves[node] = [], []
            self.leaves[up[-1]].append(path)

    def size(self, node: str) -> int:
        return len(self.leaves[node]) + sum(map(self.size, self.inner[node]))


def _cheapest(rows: list, cols: list, cost, drop, add) -> tuple[float, list[tuple]]:
    """(cost, matched pairs) of the cheapest way to match some of ``rows`` to ``cols``, to drop the other rows and add the other columns."""
    if not rows or not cols:
        return sum(map(drop, rows)) + sum(map(add, cols)), []
    # matching a pair saves its deletion and addition; a column per row stands for leaving the row alone
    table = [[cost(r, c) - drop(r) - add(c) for c in cols] + [0.0 if i == j else _UNLIKE for j in range(len(rows))] for i, r in enumerate(rows)]
    pairs = [(rows[i], cols[j]) for i, j in enumerate(assign(table)) if j < len(cols) and table[i][j] < 0]
    return sum(map(drop, rows)) + sum(map(add, cols)) + sum(cost(r, c) - drop(r) - add(c) for r, c in pairs), pairs


class TreeEdit:
    """The edit script of least cost between two schemas, given as leaves by path."""

    def __init__(self, old: dict[str, dict], new: dict[str, dict]):
        self.old, self.new = old, new
        self.a, self.b = _Tree(old), _Tree(new)
        self.known: dict[tuple[str, str], float] = {}
        self.leaf_cost: dict[tuple[str, str], float] = {}
        self.structures: dict[str, str] = {"": ""}
        self.renamed: dict[str, str] = {}
        gone, came = [p for p in sorted(old) if p not in new], [p for p in sorted(new) if p not in old]
        if gone and came:
            self._match_structures()
            _, pairs = _cheapest(gone, came, self._moved, lambda _: EDIT, lambda _: EDIT)
            self.renamed = dict(pairs)

    def leaf(self, p: str, q: str) -> float:
        """A leaf turned into another; one that stays at its path is itself and nothing else."""
        if p == q:
            return 0.0 if self.old[p]["type"] == self.new[q]["type"] else EDIT / 2
        if p in self.new or q in self.old:
            return _UNLIKE
        if (p, q) not in self.leaf_cost:
            self.leaf_cost[p, q] = min(rename_cost(self.old[p], self.new[q]), _UNLIKE)
        return self.leaf_cost[p, q]

    def distance(self, p: str, q: str) -> float:
        """Tree edit distance between the subtrees at two inner nodes, their own names aside."""
        if (p, q) not in self.known:
            leaves, _ = _cheapest(self.a.leaves[p], self.b.leaves[q], self.leaf, lambda _: EDIT, lambda _: EDIT)
            inner, _ = _cheapest(self.a.inner[p], self.b.inner[q], self._inner, self._whole(self.a), self._whole(self.b))
            self.known[p, q] = leaves + inner
        return self.known[p, q]

    def _inner(self, p: str, q: str) -> float:
        return self.distance(p, q) + (INNER if p.rpartition(".")[2] != q.rpartition(".")[2] else 0.0)

    @staticmethod
    def _whole(tree: _Tree):
        return lambda node: INNER + EDIT * tree.size(node)

    def _match_structures(self) -> None:
        """Inner nodes that are each other: at every level first, then what is left over at any level, as moves of subtrees."""

        def down(p: str, q: str) -> None:
            _, pairs = _cheapest(self.a.inner[p], self.b.inner[q], self._inner, self._whole(self.a), self._whole(self.b))
            for x, y in pairs:
                self.structures[x] = y
                down(x, y)

        down("", "")
        rest = [p for p in self.a.inner if p not in self.structures]
        taken = set(self.structures.values())
        free = [q for q in self.b.inner if q not in taken]
        _, moved = _cheapest(rest, free, lambda p, q: self._inner(p, q) + MOVE, self._whole(self.a), self._whole(self.b))
        self.structures.update(moved)

    def _moved(self, p: str, q: str) -> float:
        stays = self.structures.get(_parents(p)[-1]) == _parents(q)[-1]
        return self.leaf(p, q) + (0.0 if stays else MOVE)

    def script(self) -> list[tuple[str, str, str]]:
        """(change_kind, old_path, new_path) at the leaves."""
        old, new = self.old, self.new
        out = [("retyped", p, p) for p in old if p in new and old[p]["type"] and new[p]["type"] and old[p]["type"] != new[p]["type"]]
        came = set(self.renamed.values())
        out += [("renamed", p, q) for p, q in self.renamed.items()]
        out += [("removed", p, "") for p in sorted(old) if p not in new and p not in self.renamed]
        return out + [("added", "", q) for q in sorted(new) if q not in old and q not in came]

    def structure_script(self) -> list[tuple[str, str, str]]:
        """(change_kind, old_path, new_path) at the inner nodes: what was added, removed, or renamed or moved with what is in it."""
        a, b = set(self.a.inner), set(self.b.inner)
        moved = {p: q for p, q in self.structures.items() if p != q and p not in b and q not in a}
        out = [("renamed", p, q) for p, q in sorted(moved.items())]
        out += [("removed", p, "") for p in sorted(a - b) if p not in moved]
        return out + [("added", "", q) for q in sorted(b - a) if q not in moved.values()]


def edit_script(before: list[dict], after: list[dict]) -> list[tuple[str, str, str]]:
    """(change_kind, old_path, new_path) of the least-cost script that turns one schema into the other, at the leaves."""
    return TreeEdit({x["path"]: x for x in before}, {x["path"]: x for x in after}).script()


def _scripts(structures: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for tbl, file_id, written, before, after in pdf.itertuples(index=False):
                sides = [{x["path"]: {**x, "shapes": list(x["shapes"]) if x["shapes"] is not None else []} for x in (side if side is not None else [])} for side in (before, after)]
                tree = TreeEdit(*sides)
                out += [(tbl, written, file_id, *c, "leaf") for c in tree.script()]
                if structures:
                    out += [(tbl, written, file_id, *c, "structure") for c in tree.structure_script()]
            yield pd.DataFrame(out, columns=["tbl_name", "written_ns", "file_id", "change_kind", "old_path", "new_path", "node"])

    return run


def _by_file(files: DataFrame, every: DataFrame) -> DataFrame:
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in _STATS]
    fields = F.struct("path", "type", "quantity", *zero, "shapes")
    return every.groupBy("file_id").agg(F.collect_list(fields).alias("fields"))


def scripts(files: DataFrame, records: DataFrame, every: DataFrame | None = None, structures: bool = True) -> DataFrame:
    """(tbl_name, written_ns, file_id, change_kind, old_path, new_path, node) of each file against the one before it; ``node`` is ``leaf`` or,
    with ``structures``, ``structure`` for an inner node that was added, removed, or renamed or moved as a whole.

    Files of a table are ordered by ``written_ns``, then ``file_id``; those without table name or id are left out, and the
    first file of a table has no changes. Only a file's id and time take part in the ordering; schemas are joined to it by
    file, so a table with most of the files is spread.
    A field whose values are all null has no type and is never retyped.
    """
    every = leaves(files, records) if every is None else every
    order = Window.partitionBy("tbl_name").orderBy("written_ns", "file_id")
    listed = files.where("tbl_name is not null and file_id is not null").select("tbl_name", "file_id", "written_ns")
    steps = listed.withColumn("prev", F.lag("file_id").over(order)).where("prev is not null")
    # read twice below: as the schema before and the one after
    schemas = materialize(_by_file(files, every), "schemas")
    pairs = (
        steps.join(schemas.withColumnRenamed("fields", "after"), "file_id", "left")
        .join(schemas.select(F.col("file_id").alias("prev"), F.col("fields").alias("before")), "prev", "left")
        .select("tbl_name", "file_id", "written_ns", "before", "after")
    )
    # most files have the fields of the one before, whatever their order
    fields = lambda side: F.array_sort(F.transform(F.coalesce(side, F.array().cast(schemas.schema["fields"].dataType)), lambda x: F.struct(x["path"], F.coalesce(x["type"], F.lit("")))))
    pairs = pairs.where(fields(F.col("before")) != fields(F.col("after")))
    return pairs.mapInPandas(
        _scripts(structures), "tbl_name string, written_ns long, file_id long, change_kind string, old_path string, new_path string, node string"
    )


def changes(files: DataFrame, records: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(tbl_name, written_ns, file_id, change_kind, old_path, new_path): the scripts at the leaves."""
    return scripts(files, records, every, False).drop("node")


def _groups(frames: Iterator[pd.DataFrame], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of rows with the same first ``keys`` columns, over all frames."""
    rows = (r for pdf in frames for r in zip(*(pdf[c].tolist() for c in pdf.columns)))
    for key, group in groupby(rows, key=lambda r: r[:keys]):
        yield key, [r[keys:] for r in group]


class _Range:
    """The scripts of a range of files, applied to paths that stand for whatever they are before the range.

    A path stands for ``s:path``, what that path was before the range, or ``b:n``, the n-th field that began in it.
    """

    def __init__(self):
        self.now: dict[str, str] = {}
        self.last: dict[str, str] = {}  # the last path of each
        self.touched: set[str] = set()
        self.born = 0

    def _put(self, path: str, ref: str) -> str:
        self.now[path], self.last[ref] = ref, path
        self.touched.add(path)
        return ref

    def birth(self, path: str) -> str:
        self.born += 1
        return self._put(path, f"b:{self.born - 1:09d}")

    def at(self, path: str) -> str:
        if path in self.now:
            return self.now[path]
        # what isn't there any more, and isn't said to come back, is new
        return self.birth(path) if path in self.touched else self._put(path, f"s:{path}")

    def apply(self, edits: list[tuple[str, str, str]]) -> None:
        moved = []
        for kind, old, new in edits:
            if kind in ("renamed", "removed"):
                ref = self.at(old)
                del self.now[old]
                if kind == "renamed":
                    moved.append((new, ref))
        for path, ref in moved:
            self._put(path, ref)
        for kind, _, new in edits:
            if kind == "added":
                self.birth(new)


def _apply_ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per range of a table what each path of each file stands for (kind ``use``), and of all of these the path at the end (null if it is
    gone) and the last path that they had (kind ``end``)."""
    columns = ["tbl_name", "part", "kind", "file_id", "path", "type", "ref", "ends", "last"]
    out: list[tuple] = []
    for (tbl, part), rows in _groups(frames, 2):
        state = _Range()
        for (_, file_id), own in groupby(rows, key=lambda r: r[:2]):
            own = list(own)
            state.apply([r[3:6] for r in own if r[2] == 0])
            out += [(tbl, part, "use", file_id, r[5], r[6], state.at(r[5]), None, None) for r in own if r[2] == 1]
        ends = {ref: path for path, ref in state.now.items()}
        out += [(tbl, part, "end", None, None, None, ref, ends.get(ref), path) for ref, path in state.last.items()]
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    yield pd.DataFrame(out, columns=columns)


def _compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The mappings of a table's ranges, one after the other: which field each ``ref`` is, by the last path that the field had."""
    columns = ["tbl_name", "part", "ref", "field"]
    out: list[tuple] = []
    for (tbl,), rows in _groups(frames, 1):
        now: dict[str, int] = {}
        fields: list[str] = []
        refs = []
        for part, own in groupby(rows, key=lambda r: r[0]):
            ends = []
            for _, ref, end, path in own:
                field = now.pop(ref[2:], None) if ref.startswith("s:") else None
                if field is None:
                    field = len(fields)
                    fields.append(path)
                fields[field] = path
                refs.append((part, ref, field))
                if end is not None:
                    ends.append((end, field))
            now.update(ends)
        names, used = [], set()
        for path in fields:  # two fields may have ended under one path, one after the other
            name, k = path, 2
            while name in used:
                name, k = f"{path}#{k}", k + 1
            used.add(name)
            names.append(name)
        out += [(tbl, p, r, names[f]) for p, r, f in refs]
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    yield pd.DataFrame(out, columns=columns)


def projections(files: DataFrame, records: DataFrame, size: int = RANGE) -> DataFrame:
    """(tbl_name, file_id, path, field, type): for each path of each file the field that it is in the consistent table.

    A field is called by its last path. The scripts of ``size`` consecutive files are composed in one task, so a table with most of the files is
    spread; what is gone through per table are the paths known at the end of each range.
    """
    every = materialize(leaves(files, records), "every")
    found = changes(files, records, every).where("change_kind != 'retyped'")
    order = Window.partitionBy("tbl_name").orderBy("written_ns", "file_id")
    listed = files.where("tbl_name is not null and file_id is not null").select("tbl_name", "file_id", "written_ns").withColumn("idx", F.row_number().over(order) - 1)
    listed = materialize(listed.select("tbl_name", "file_id", "idx", F.floor(F.col("idx") / F.lit(size)).cast("int").alias("part")), "listed")
    uses = every.select("file_id", "path", "type").join(listed, "file_id")
    none = F.lit(None).cast("string")
    row = lambda df, turn, kind, old, new, type: df.select("tbl_name", "part", "idx", "file_id", F.lit(turn).alias("turn"), kind.alias("change_kind"), old.alias("old_path"), new.alias("new_path"), type.alias("type"))
    edits = row(found.drop("tbl_name").join(listed, "file_id"), 0, F.col("change_kind"), F.col("old_path"), F.col("new_path"), none)
    first = row(uses.where("idx = 0"), 0, F.lit("added"), F.lit(""), F.col("path"), none)
    used = row(uses, 1, none, F.lit(""), F.col("path"), F.col("type"))
    laid = edits.unionByName(first).unionByName(used).repartition("tbl_name", "part").sortWithinPartitions("tbl_name", "part", "idx", "file_id", "turn", "old_path", "new_path")
    ranged = materialize(
        laid.mapInPandas(_apply_ranges, "tbl_name string, part int, kind string, file_id long, path string, type string, ref string, ends string, last string"), "ranges"
    )
    ends = ranged.where("kind = 'end'").select("tbl_name", "part", "ref", "ends", "last").repartition("tbl_name").sortWithinPartitions("tbl_name", "part", "ref")
    names = ends.mapInPandas(_compose, "tbl_name string, part int, ref string, field string")
    return ranged.where("kind = 'use'").join(names, ["tbl_name", "part", "ref"]).select("tbl_name", "file_id", "path", "field", "type")


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for record_id, file_id, tbl, payload, mapping in pdf.itertuples(index=False):
            names = {x["path"]: x["field"] for x in mapping} if mapping is not None else {}
            try:
                record = json.loads(payload)
            except (TypeError, ValueError, RecursionError):
                record = None
            got = None
            if isinstance(record, dict):
                got = {names[p]: v if isinstance(v, str) else json.dumps(v) for p, v in flatten(record) if p in names and v is not None}
            out.append((record_id, file_id, tbl, got is not None, dict(sorted((got or {}).items()))))
        yield pd.DataFrame(out, columns=["record_id", "file_id", "tbl_name", "readable", "fields"])


def consistent_table(files: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, file_id, tbl_name, readable, fields): every record under the field names of its table's consistent schema.

    ``fields`` maps a field to its value as text; null and absent fields, and keys that the file's schema doesn't have, are
    left out. A payload that can't be parsed stays as a row with ``readable`` false. Repeated records stay. Records of a file without
    fields, without table name or not in ``files`` have no ``fields``; only those without a file id are left out.
    """
    mapping = projections(files, records).groupBy("file_id").agg(F.collect_list(F.struct("path", "field")).alias("mapping"))
    names = files.where("file_id is not null").select("file_id", "tbl_name")
    rows = records.where("file_id is not null").select("record_id", "file_id", "payload").join(names, "file_id", "left").join(mapping, "file_id", "left")
    return rows.select("record_id", "file_id", "tbl_name", "payload", "mapping").mapInPandas(
        _texts, "record_id long, file_id long, tbl_name string, readable boolean, fields map<string,string>"
    )
