"""A Merkle manifest of a dataset: digests of rows folded into one root a group and one root of all, with a proof for
every row.

A row's digest is the hash of its fields, each with its length in front. In a group (a language) digests ascend by id; runs
of eight become the hash of their concatenation, level by level, until one is left. The groups' roots are folded likewise.

The tree is built by combining, as ``combineByKey`` does, but driven by the arrival of children: a task holds *partial
parents*, each a set of digests by position. A parent's arity follows from the size of its group, so the task knows when
the last child has come; it then hashes them and the new node arrives at its own parent in the same task. What is left at
the end, the task's *frontier*, are children of parents that other tasks hold parts of: a few for each level. Only they
are shuffled, to the task of their ancestor three levels up, where they are combined by the same code, until only roots
remain. Each round keeps reverse links from a node to its parent's children; read backwards they give each frontier node's
path to the root, and inside a task each row's path to its frontier node. Rows, kept narrow, are range-partitioned by
group and id, so a group with most of the rows is spread over tasks, as is a row that is repeated often.

Defined edge results: null fields are ``-``; null languages are a group of their own, which comes first; null ids come
first in their group; rows of one id follow each other by digest, equal rows are leaves of their own; a null id counts as
the empty string where ids are hashed (and so is tampered with in the query); a text without capital letters verifies even
if it is tampered with, as it stays the same; texts of any length are hashed whole; extra columns are not read, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_code
from .common import crc_bucket, if_small, materialize, read_table

ARITY = 8
#: Rows of a task, which holds them while it writes their proofs.
ROWS_PER_TASK = 1 << 17
#: Levels that one round over the frontier climbs: at most 8^3 nodes meet for an ancestor.
CLIMB = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def width(size: int, level: int) -> int:
    """Nodes at a level of a tree over ``size`` leaves."""
    return -(-size // ARITY**level)


class Tree:
    """Partial parents of one task; nodes may arrive in any order."""

    def __init__(self, keep_links: bool = False):
        self.open: dict[tuple, dict[int, str]] = {}
        self.sizes: dict = {}
        self.roots: list[tuple] = []
        self.links: dict[tuple, dict[int, str]] | None = {} if keep_links else None

    def arrive(self, group, size: int, level: int, index: int, digest: str) -> None:
        while True:
            nodes = width(size, level)
            if nodes == 1:
                self.roots.append((group, size, level, index, digest))
                return
            level, slot, index = level + 1, index % ARITY, index // ARITY
            parent = self.open.setdefault((group, level, index), {})
            parent[slot] = digest
            if len(parent) < min(ARITY, nodes - index * ARITY):
                self.sizes[group] = size
                return
            del self.open[group, level, index]
            if self.links is not None:
                self.links[group, level, index] = parent
            digest = sha("".join(parent[k] for k in range(len(parent))))

    def frontier(self) -> Iterator[tuple]:
        """Nodes whose parents aren't complete here, and roots."""
        yield from self.roots
        for (group, level, index), children in self.open.items():
            for slot, digest in children.items():
                yield group, self.sizes[group], level - 1, index * ARITY + slot, digest

    def path(self, group, level: int, index: int) -> tuple[list[int], list[str], int, int]:
        """(position among the siblings, the siblings' digests as one string) for each level up to the highest node that is
        complete here, and that node's level and index."""
        slots, siblings = [], []
        while (children := self.links.get((group, level + 1, index // ARITY))) is not None:
            slot = index % ARITY
            slots.append(slot)
            siblings.append("".join(children[k] for k in range(len(children)) if k != slot))
            level, index = level + 1, index // ARITY
        return slots, siblings, level, index


def climb(digest: str, slots: list[int], siblings: list[str]) -> str:
    """The root that a digest and its path give."""
    for slot, others in zip(slots, siblings, strict=True):
        cut = slot * len(digest)
        digest = sha(others[:cut] + digest + others[cut:])
    return digest


NODE = "g string, size long, level int, idx long, digest string"
NODE_ARROW = pa.schema([("g", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string())])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves in range partitions by group and order, with their ``task``, position ``idx`` and the group's ``size``.

    Equal rows are told apart by where they stood, so however many there are, they are spread.
    """
    spark = leaves.sparkSession
    tasks = max(-(-leaves.count() // ROWS_PER_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["g", *order, "at"]
    ranges = leaves.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).drop("at")
    rows = materialize(ranges.withColumn("task", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    runs = rows.groupBy("g", "task").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(group.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("g", "task", (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("size"))
    return rows.join(if_small(materialize(runs)), ["g", "task"]).withColumn("idx", F.col("row") + F.col("shift")).drop("row", "shift")


def local_frontiers(rows: DataFrame) -> DataFrame:
    """What each task's leaves leave open, with the task: one pass, a few partial parents for each level in memory."""
    schema = pa.schema([*NODE_ARROW, ("task", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, Tree] = {}
        for batch in batches:
            for group, size, index, digest, task in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if task not in trees:
                    trees[task] = Tree()
                trees[task].arrive(group, size, 0, index, digest)
        yield batch_of([(*node, task) for task, tree in trees.items() for node in tree.frontier()], schema)

    return rows.select("g", "size", "idx", "digest", "task").mapInArrow(run, f"{NODE}, task int")


LINKED = "g string, size long, level int, idx long, slots array<int>, siblings array<string>, top_level int, top_idx long, top string"
LINKED_ARROW = pa.schema(
    [("g", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("slots", pa.list_(pa.int32())), ("siblings", pa.list_(pa.string())), ("top_level", pa.int32()), ("top_idx", pa.int64()), ("top", pa.string())]
)


def combined(nodes: DataFrame, height: int) -> DataFrame:
    """Nodes meet at their ancestor of ``height`` levels above the leaves; each with its path to the highest node that is
    complete then."""
    ancestor = F.expr(f"case when level < {height} then shiftright(idx, 3 * ({height} - level)) else idx end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, came = Tree(keep_links=True), []
        for batch in batches:
            for node in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                came.append(node)
                tree.arrive(*node)
        tops = {(g, level, index): digest for g, _, level, index, digest in tree.frontier()}
        out = []
        for g, size, level, index, _ in came:
            slots, siblings, top_level, top = tree.path(g, level, index)
            out.append((g, size, level, index, slots, siblings, top_level, top, tops[g, top_level, top]))
        yield batch_of(out, LINKED_ARROW)

    rows = nodes.select("g", "size", "level", "idx", "digest")
    return rows.repartition(F.col("g"), F.greatest(F.col("level"), F.lit(height)), ancestor).mapInArrow(run, LINKED)


def frontier_paths(frontier: DataFrame) -> DataFrame:
    """The path of every frontier node to its group's root: (g, level, idx, slots, siblings, root)."""
    most = frontier.agg(F.max("size")).first()[0] or 0
    levels = 0
    while width(most, levels) > 1:
        levels += 1
    nodes, rounds = frontier.select("g", "size", "level", "idx", "digest"), []
    for height in range(CLIMB, levels + CLIMB, CLIMB):
        rounds.append(materialize(combined(nodes, height)))
        nodes = rounds[-1].groupBy("g", "size", F.col("top_level").alias("level"), F.col("top_idx").alias("idx")).agg(F.any_value("top").alias("digest"))
    none = F.array().cast("array<int>"), F.array().cast("array<string>")
    paths = nodes.select("g", "level", "idx", none[0].alias("slots"), none[1].alias("siblings"), F.col("digest").alias("root"))
    for linked in reversed(rounds):
        above = paths.select("g", F.col("level").alias("top_level"), F.col("idx").alias("top_idx"), F.col("slots").alias("up_slots"), F.col("siblings").alias("up_siblings"), "root")
        paths = linked.join(above, ["g", "top_level", "top_idx"]).select("g", "level", "idx", F.concat("slots", "up_slots").alias("slots"), F.concat("siblings", "up_siblings").alias("siblings"), "root")
    return paths


def proved(rows: DataFrame, paths: DataFrame, carry: list[str], out: str, finish: Callable[[tuple, str, list, list, dict], tuple]) -> DataFrame:
    """``finish(carried values, digest, slots, siblings, path row)`` of every leaf, whose path goes through the task's own
    tree and on from its frontier node. A task's rows and its frontier's paths meet by the task's number."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tree = Tree(keep_links=True)
        leaves = list(zip(*[left[c].to_pylist() for c in ("g", "size", "idx", "digest", *carry)], strict=True))
        for group, size, index, digest, *_ in leaves:
            tree.arrive(group, size, 0, index, digest)
        above = {(r["g"], r["level"], r["idx"]): r for r in right.to_pylist()}
        got = []
        for group, _, index, digest, *carried in leaves:
            slots, siblings, level, top = tree.path(group, 0, index)
            end = above[group, level, top]
            got.append(finish(tuple(carried), digest, slots + end["slots"], siblings + end["siblings"], end))
        return pa.Table.from_batches([batch_of(got, fields)])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(out))
    leaves = rows.select("task", "g", "size", "idx", "digest", *carry)
    return leaves.groupBy("task").cogroup(paths.groupBy("task")).applyInArrow(run, out)


def rooted(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(leaves with their places, paths of the tasks' frontier nodes with ``task`` and ``root``) of all groups ``g``."""
    ship_code(leaves.sparkSession)
    rows = placed(leaves, order)
    frontier = materialize(local_frontiers(rows))
    paths = frontier_paths(frontier)
    return rows, materialize(frontier.select("g", "level", "idx", "task").join(paths, ["g", "level", "idx"]))


def field(column: F.Column) -> F.Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(columns: list[F.Column]) -> F.Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", changed: F.Column | None = None, proofs: bool = True) -> DataFrame:
    """(id, group, leaf, subroot, root, proof_sha256, folded_root) of every row, and ``slots`` and ``siblings`` if
    ``proofs`` are to be written out.

    ``changed`` is the digest of the row as it is found now, null if it is the leaf: ``folded_root`` is what it and the
    stored siblings give, so a row is as the manifest says if that is the root. ``slots`` and ``siblings`` are the proof, to
    be checked with ``climb``.
    """
    c = {n: F.col(f"`{n}`") for n in fields}
    leaves = docs.select(
        c[id_col].alias("id"),
        F.coalesce(F.concat(F.lit("="), c[group_col].cast("string")), F.lit("")).alias("g"),
        row_digest(list(c.values())).alias("digest"),
        (F.lit(None).cast("string") if changed is None else changed).alias("changed"),
    )
    rows, paths = rooted(materialize(leaves), ["id", "digest"])
    subroots = materialize(paths.groupBy("g").agg(F.any_value("root").alias("digest")))
    # The groups' roots are the leaves of one more tree; its groups are one.
    top_rows, top_paths = rooted(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"])
    ends = proved(top_rows, top_paths, ["name"], "g string, up_slots array<int>, up_siblings array<string>, top string", lambda own, _, slots, siblings, end: (own[0], slots, siblings, end["root"]))
    whole = paths.join(ends, "g").select(
        "g", "level", "idx", "task", F.concat("slots", "up_slots").alias("slots"), F.concat("siblings", "up_siblings").alias("siblings"), F.col("root").alias("subroot"), F.col("top").alias("root")
    )

    def finish(own: tuple, digest: str, slots: list, siblings: list, end: dict) -> tuple:
        key, now = own
        found = key, end["g"][1:] if end["g"] else None, digest, end["subroot"], end["root"], sha("".join(siblings)), climb(now or digest, slots, siblings)
        return (*found, slots, siblings) if proofs else found

    id_type = leaves.schema["id"].dataType.simpleString()
    out = f"id {id_type}, group string, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + ", slots array<int>, siblings array<string>" * proofs
    return proved(rows, whole, ["id", "changed"], out, finish)


def verify(found: DataFrame) -> DataFrame:
    """``verified``: the recomputed root is the root."""
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    lower = F.translate(F.col("text"), CAPITALS, CAPITALS.lower())
    tampered = F.when(crc_bucket(F.col("doc_id"), 3) == 0, row_digest([F.col(c) if c != "text" else lower for c in FIELDS]))
    found = verify(manifest(docs, changed=tampered, proofs=False))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql(levels: int = 7) -> str:
    """The same in SQL, level by level, for groups of up to 8^levels rows and as many groups."""
    texts = ["cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)"]
    one = lambda x: f"coalesce(cast(octet_length(encode({x})) as varchar) || ':' || {x}, '-')"
    hashed = lambda text: f"sha256({' || '.join(one(x) for x in [*texts, text])})"
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(cast(doc_id as varchar), '.'), lambda x: ascii(x)::bigint)), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))))"
    )
    out = [
        f"d as materialized (select doc_id, lang, {hashed('text')} as leaf, {crc} % 3 = 0 as tampered, {hashed(f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')")} as changed from documents)",
        "l0 as materialized (select coalesce('=' || lang, '') as g, doc_id, leaf, case when tampered then changed else leaf end as now, row_number() over (partition by lang order by doc_id, leaf) - 1 as i from d)",
        "a0 as materialized (select g, i, leaf as digest from l0)",
    ]

    def fold(name: str, place: str) -> None:
        for k in range(levels):
            last = f"{name}{k}"
            out.append(f"{name}{k + 1} as materialized (select g, i // {ARITY} as i, case when any_value(n) > 1 then sha256(string_agg(digest, '' order by i)) else any_value(digest) end as digest from (select *, count(*) over (partition by g) as n from {last}) group by g, i // {ARITY})")
            out.append(
                f"{name}s{k} as materialized (select x.g, x.i, any_value(n) > 1 as deep, coalesce(string_agg(y.digest, '' order by y.i) filter (y.i < x.i), '') as before, coalesce(string_agg(y.digest, '' order by y.i) filter (y.i > x.i), '') as behind "
                f"from (select *, count(*) over (partition by g) as n from {last}) x join {last} y on y.g = x.g and y.i // {ARITY} = x.i // {ARITY} group by x.g, x.i)"
            )
        out.append(f"{place} as materialized (select g, digest from {name}{levels})")

    fold("a", "subroots")
    out.append("b0 as materialized (select '' as g, row_number() over (order by g) - 1 as i, digest, g as own from subroots)")
    fold("b", "top")
    last = "(select l0.*, '' as proof, b0.i as j from l0 join b0 on b0.own = l0.g)"
    for name, group, at in (("a", "f.g", "i"), ("b", "''", "j")):
        for k in range(levels):
            out.append(
                f"f{name}{k} as materialized (select f.g, f.doc_id, f.leaf, f.i, f.j, f.proof || s.before || s.behind as proof, case when s.deep then sha256(s.before || f.now || s.behind) else f.now end as now "
                f"from {last} f join {name}s{k} s on s.g = {group} and s.i = f.{at} // {ARITY**k})"
            )
            last = f"f{name}{k}"
    return (
        f"with {', '.join(out)} select f.doc_id, f.leaf, s.digest as subroot, t.digest as root, sha256(f.proof) as proof_sha256, f.now as folded_root, f.now = t.digest as verified "
        f"from {last} f join subroots s on s.g = f.g cross join top t"
    )


OP13_SQL = _sql()
