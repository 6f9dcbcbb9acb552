"""Merkle manifest of a table: one tree per group, one over the groups' roots, in a postorder append log.

The leaves of a tree are dealt to aligned builders of FANOUT ** LEVELS leaves each. A builder appends every node in the
moment it is complete, so its part of the log is the postorder of its subtree, and where a node stands follows from sizes
alone: after m leaves the log holds (3 m - s(m)) / 2 complete nodes, s being the sum of the base-3 digits. A proof
reads its siblings at such positions; nothing is searched and no pointer is stored. The builders' roots are the leaves
of the next layer, and so on until a tree is one node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convoy.llm.common import fold_of, scratch

FANOUT = 3
#: Levels of one builder: 3 ** 7 leaves, a log of about 100 KB.
LEVELS = 7
SPAN = FANOUT**LEVELS
#: Bytes of a digest.
WIDTH = 32
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

BLOCK = "tree long, block long, size long, n int, log binary, ids array<long>, folded binary"
PATH = "tree long, block long, path string, subroot string, root string"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


# positions ---------------------------------------------------------------------------------------------------------

def completed(leaves: int) -> int:
    """Complete nodes of all levels after so many leaves."""
    digits, m = 0, leaves
    while m:
        digits, m = digits + m % FANOUT, m // FANOUT
    return (FANOUT * leaves - digits) // (FANOUT - 1)


def height_of(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    height = 0
    while FANOUT**height < leaves:
        height += 1
    return height


def position(level: int, index: int, leaves: int) -> int:
    """Place in the log of the node ``index`` of a level, in a tree of so many leaves.

    A node whose run is full is appended together with its last leaf, after the lower ones that end there. What is
    left when the leaves end, one node a level, follows in ascending order of levels.
    """
    end = (index + 1) * FANOUT**level
    if end <= leaves:
        return completed(end - 1) + level
    first = 1
    while leaves % FANOUT**first == 0:
        first += 1
    return completed(leaves) + level - first


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def append_log(leaves: list[str], height: int) -> list[str]:
    """All nodes in the order in which they are complete, up to ``height`` levels above the leaves."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(height + 1)]

    def done(level: int, digest: str) -> None:
        log.append(digest)
        run = open_[level]
        run.append(digest)
        if len(run) == FANOUT and level < height:
            open_[level] = []
            done(level + 1, h("".join(run)))

    for leaf in leaves:
        done(0, leaf)
    for level in range(height):  # runs that stayed short
        if open_[level]:
            log.append(h("".join(open_[level])))
            open_[level + 1].append(log[-1])
    return log


def steps(index: int, leaves: int, height: int):
    """Per level the own place in the run and the log positions of the siblings before and after."""
    for level in range(height):
        nodes = -(-leaves // FANOUT**level)
        start = index - index % FANOUT
        yield ([position(level, i, leaves) for i in range(start, index)],
               [position(level, i, leaves) for i in range(index + 1, min(start + FANOUT, nodes))])
        index //= FANOUT


# digests and ranks -------------------------------------------------------------------------------------------------

def leaf_digest(*values: Column) -> Column:
    """sha256 of the values, each ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _ranked(rows: DataFrame, group: str, order: list[Column], folder: str) -> DataFrame:
    """``rows`` with their ``rank`` in the group, the group's ``size`` and its number ``tree`` in ascending order of groups.

    Rows are dealt in ranges of (group, order), so a large group is many tasks; ranks are places in the task plus a
    prefix sum over one row per task and group.
    """
    key = F.col(group).asc_nulls_first()
    placed = _kept(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("at", F.monotonically_increasing_id()), f"{folder}/placed")
    part = F.shiftright("at", 33)
    runs = placed.groupBy(part.alias("part"), F.col(group)).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", group, "first", before.alias("before"), F.sum("n").over(whole).alias("size"), F.min("first").over(whole).alias("start"))
    if rows.schema[group].dataType.typeName() == "integer":  # one group only
        runs = runs.withColumn("tree", F.lit(0).cast("long"))
    else:
        groups = runs.select("start").distinct().withColumn("one", F.lit(0))
        numbers = _ranked(groups, "one", [F.col("start").asc()], f"{folder}/groups").select("start", F.col("rank").alias("tree"))
        runs = runs.join(numbers, "start")
    runs = runs.select("part", F.col(group).alias("_group"), "first", "before", "size", "tree")
    same = F.col(group).eqNullSafe(F.col("_group")) & (part == F.col("part"))
    return placed.join(runs, same).withColumn("rank", F.col("at") - F.col("first") + F.col("before")).drop("part", "_group", "first", "before", "at")


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# building ----------------------------------------------------------------------------------------------------------

def _height(size: int) -> int:
    """Levels of a builder: a tree of one builder ends at one node, others go on to full height."""
    return height_of(size) if size <= SPAN else LEVELS


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("rank")
    size, n = table["size"][0].as_py(), table.num_rows
    log = append_log([d.hex() for d in table["digest"].to_pylist()], _height(size))
    ids = table["doc_id"].to_pylist() if "doc_id" in table.column_names else []
    folded = b"".join(table["folded"].to_pylist()) if "folded" in table.column_names else b""
    return pa.table({
        "tree": table["tree"][:1], "block": table["block"][:1], "size": [size], "n": pa.array([n], pa.int32()),
        "log": pa.array([bytes.fromhex("".join(log))], pa.binary()), "ids": pa.array([ids], pa.list_(pa.int64())), "folded": pa.array([folded], pa.binary())})


def _layers(nodes: DataFrame, folder: str) -> list[DataFrame]:
    """(tree, rank, size, digest, ...) -> the log, one table per layer, one row per builder."""
    out: list[DataFrame] = []
    while True:
        dealt = nodes.withColumn("block", F.expr(f"rank div {SPAN}"))
        out.append(_kept(dealt.groupBy("tree", "block").applyInArrow(_build, BLOCK), f"{folder}/layer={len(out)}"))
        larger = out[-1].where(F.col("size") > SPAN)
        if larger.isEmpty():
            return out
        nodes = larger.select("tree", F.col("block").alias("rank"), F.expr(f"(size + {SPAN - 1}) div {SPAN}").alias("size"), _top().alias("digest"))


def _top() -> Column:
    """The last node a builder wrote: its root."""
    return F.substring("log", -WIDTH, WIDTH)


def build(docs: DataFrame, folder: str, columns: tuple[str, ...] = COLUMNS, group: str = "source", order: str = "doc_id", changed: str | None = "text") -> None:
    """Writes the log of all groups and of the tree over their roots under ``folder``.

    Groups are in UTF-8 byte order with null first; rows of a group ascend by ``order`` with null first, ties by digest,
    so the log does not depend on how the input is split. Repeated rows are leaves of their own. Columns not named take
    no part, whatever their names. Beside each leaf the digest of the row to be checked is kept: with its line
    breaks in ``changed`` deleted where 2 divides the crc32 of the id, else the leaf itself. Texts are hashed whole
    in the JVM; only digests are shuffled. An empty table gives empty logs.
    """
    named = [F.col(c) for c in columns]
    edited = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == changed else F.col(c) for c in columns]
    tampered = F.col(order).isNotNull() & (fold_of(F.col(order), 2) == 0) if changed else F.lit(False)
    leaf = leaf_digest(*named)
    rows = docs.select(F.col(group).alias("group"), F.col(order).cast("long").alias("doc_id"), F.unhex(leaf).alias("digest"),
                       F.unhex(F.when(tampered & F.contains(F.col(changed or order).cast("string"), F.lit("\n")), leaf_digest(*edited)).otherwise(leaf)).alias("folded"))
    ranked = _ranked(rows, "group", [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()], f"{folder}/leaves")
    layers = _layers(ranked, f"{folder}/groups")
    roots = None
    for layer in layers:
        tops = layer.where(F.col("size") <= SPAN).select("tree", _top().alias("digest"))
        roots = tops if roots is None else roots.union(tops)
    counted = _kept(roots, f"{folder}/roots")
    top = counted.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.lit(counted.count()).cast("long").alias("size"), "digest")
    _layers(top, f"{folder}/top")


# proofs ------------------------------------------------------------------------------------------------------------

def _runs(path: str) -> list[tuple[str, str]]:
    """A path is the siblings of each level, ``before.after`` in hex, upwards, each level closed by a comma."""
    return [tuple(level.split(".")) for level in path.split(",")[:-1]]


def _paths_of(log: str, n: int, size: int):
    """Per leaf of a builder the path to its root."""
    digest = [log[k : k + 2 * WIDTH] for k in range(0, len(log), 2 * WIDTH)]
    height = _height(size)
    upper: dict[int, str] = {}  # leaves of one run share all but the first level
    for index in range(n):
        levels = steps(index, n, height)
        if height:
            before, after = next(levels)
            first = "".join([digest[p] for p in before]) + "." + "".join([digest[p] for p in after]) + ","
            run = index // FANOUT
            if run not in upper:
                upper = {run: "".join(["".join([digest[p] for p in b]) + "." + "".join([digest[p] for p in a]) + "," for b, a in levels])}
            yield first + upper[run]
        else:
            yield ""


def _down(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Builders with the paths of their roots -> paths of their leaves, which are builders of the layer below."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                start = r["block"] * SPAN
                found = [p + r["path"] for p in _paths_of(r["log"].hex(), r["n"], r["size"])]
                yield pa.RecordBatch.from_pydict({
                    "tree": [r["tree"]] * r["n"], "block": list(range(start, start + r["n"])), "path": found,
                    "subroot": [r["subroot"]] * r["n"], "root": [r["root"]] * r["n"]}, schema=_PATHS)

    return blocks.join(paths, ["tree", "block"]).select("tree", "block", "size", "n", "log", "path", "subroot", "root").mapInArrow(run, PATH)


_PATHS = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("path", pa.string()), ("subroot", pa.string()), ("root", pa.string())])


def _opened(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The layers of a log: those with a row; a log without rows has none."""
    log = spark.read.schema(f"{BLOCK}, layer int").parquet(folder)
    last = log.agg(F.max("layer")).first()[0]
    return [] if last is None else [log.where(F.col("layer") == k).drop("layer") for k in range(last + 1)]


def proofs(spark: SparkSession, folder: str) -> DataFrame:
    """From the log alone, per leaf: doc_id, leaf, subroot, root, proof_sha256 (of all siblings upwards, left to right) and
    folded_root, the root that follows from the digest of the row to be checked and the siblings. Rows without siblings
    have the digest of nothing as proof."""
    top, layers = _opened(spark, f"{folder}/top"), _opened(spark, f"{folder}/groups")
    paths = None
    for layer in reversed(top):
        root = layer.where(F.col("size") <= SPAN).select("tree", "block", F.lit("").alias("path"), F.lit("").alias("subroot"), F.lower(F.hex(_top())).alias("root"))
        paths = _down(layer, root if paths is None else paths.union(root))
    if paths is None:
        return spark.createDataFrame([], PROOF)
    starts = paths.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), "path", "root")
    below = None
    for k, layer in reversed(list(enumerate(layers))):
        tops = layer.where(F.col("size") <= SPAN).select("tree", "block", F.lower(F.hex(_top())).alias("subroot"))
        tops = tops.join(starts, ["tree", "block"]).select("tree", "block", "path", "subroot", "root")
        below = tops if below is None else below.union(tops)
        if k:
            below = _down(layer, below)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                log, folded = r["log"].hex(), r["folded"].hex()
                upper = _runs(r["path"])
                rest = "".join([b + a for b, a in upper])
                out = {"leaf": [], "proof_sha256": [], "folded_root": []}
                for index, path in enumerate(_paths_of(log, r["n"], r["size"])):
                    own = _runs(path)
                    at = position(0, index, r["n"]) * 2 * WIDTH
                    digest = folded[index * 2 * WIDTH : (index + 1) * 2 * WIDTH]
                    for before, after in own + upper:
                        digest = h(before + digest + after)
                    out["leaf"].append(log[at : at + 2 * WIDTH])
                    out["proof_sha256"].append(h("".join([b + a for b, a in own]) + rest))
                    out["folded_root"].append(digest)
                yield pa.RecordBatch.from_pydict({"doc_id": r["ids"], "leaf": out["leaf"], "subroot": [r["subroot"]] * r["n"], "root": [r["root"]] * r["n"],
                                                  "proof_sha256": out["proof_sha256"], "folded_root": out["folded_root"]}, schema=_PROOFS)

    named = layers[0].join(below, ["tree", "block"])
    return named.select("size", "n", "log", "ids", "folded", "path", "subroot", "root").mapInArrow(run, PROOF)


_PROOFS = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]])


def manifest(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Builds the log of ``docs`` and checks every row against it: the columns of ``proofs`` and ``verified``."""
    folder = folder or scratch(docs.sparkSession, "merkle")
    build(docs, folder)
    return proofs(docs.sparkSession, folder).withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc32_is_even(text: str) -> str:
    """DuckDB expression: 2 divides the unsigned crc32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k) & 1)))"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, {bits}::BIGINT[]), lambda acc, b: xor(acc >> 1, 3988292384 * xor(acc & 1, b)))"
    return f"(xor({crc}, 4294967295) % 2 = 0)"


def _sql_leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


SQL = f"""WITH RECURSIVE base AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM (
    SELECT doc_id, source, {_sql_leaf('text')} AS leaf,
      CASE WHEN {_crc32_is_even('doc_id::VARCHAR')} THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf('text')} END AS folded FROM documents)),
nodes AS (
  SELECT source, 0 AS lvl, i, n, leaf AS digest FROM base
  UNION ALL
  SELECT source, lvl + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY source, lvl, i // 3),
runs AS (SELECT source, lvl, i // 3 AS run, list(digest ORDER BY i) AS ds FROM nodes WHERE n > 1 GROUP BY source, lvl, i // 3),
subroots AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, i, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, i // 3),
top_runs AS (SELECT lvl, i // 3 AS run, list(digest ORDER BY i) AS ds FROM tops WHERE n > 1 GROUP BY lvl, i // 3),
walk AS (
  SELECT doc_id, source, leaf, 0 AS lvl, i, n, folded, '' AS proof FROM base
  UNION ALL
  SELECT w.doc_id, w.source, w.leaf, w.lvl + 1, w.i // 3, (w.n + 2) // 3,
    sha256(array_to_string(r.ds[1:w.i % 3], '') || w.folded || array_to_string(r.ds[w.i % 3 + 2:], '')),
    w.proof || array_to_string(r.ds[1:w.i % 3], '') || array_to_string(r.ds[w.i % 3 + 2:], '')
  FROM walk w JOIN runs r ON w.source IS NOT DISTINCT FROM r.source AND w.lvl = r.lvl AND w.i // 3 = r.run WHERE w.n > 1),
climb AS (
  SELECT w.doc_id, w.leaf, s.subroot, 0 AS lvl, s.i, s.n, w.folded, w.proof FROM walk w JOIN subroots s ON w.source IS NOT DISTINCT FROM s.source WHERE w.n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.lvl + 1, c.i // 3, (c.n + 2) // 3,
    sha256(array_to_string(r.ds[1:c.i % 3], '') || c.folded || array_to_string(r.ds[c.i % 3 + 2:], '')),
    c.proof || array_to_string(r.ds[1:c.i % 3], '') || array_to_string(r.ds[c.i % 3 + 2:], '')
  FROM climb c JOIN top_runs r ON c.lvl = r.lvl AND c.i // 3 = r.run WHERE c.n > 1)
SELECT c.doc_id, c.leaf, c.subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = t.digest AS verified
FROM climb c, tops t WHERE c.n = 1 AND t.n = 1"""
