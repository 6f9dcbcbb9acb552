"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``distance`` bits differ, outside the third of their bits that differs most, by at most two thirds of
the distance: with 4 bits, by 2 in the other two thirds. Each emits the ball of half that radius around its three pairs
of thirds (131 variants with 4 bits); two that share a variant are a candidate, their full distance decides. A pair of
thirds has 42 or 43 bits, so hardly any meet by chance and the work grows with the rows. A variant that very many
fingerprints share is not compared pair by pair: its fingerprints emit all variants of their 64 bits within half the
distance, and a variant that both emit proves the link (half + half bits), so all hang on the smallest of them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.llm.common import documents, stored
from convoy.llm.components import components

SEED = 42
BITS = 64
#: Rows that 8-bit counters can add up.
COUNTED = 255
_SPREAD = np.uint64(0x0101010101010101)
#: Tasks over which the rows of one component are spread.
SALTS = 32
FINGERPRINTS = "doc_id long, fp long"


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of each run of ``width`` words, joined by spaces; of all words when there are fewer; none without words."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z change, and only 0x20 and 0x09-0x0D separate
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(itertools.accumulate(map((1).__add__, map(len, found))))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip(itertools.chain((0,), ends), ends[width - 1 :])]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per group of ``sizes`` hashes the bits that more than half of them have; 0 for an empty group.

    Eight 8-bit counters share a word, so a run of up to 255 hashes is added as plain integers.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    runs = -(-n // COUNTED)
    first = np.cumsum(runs) - runs
    inner = np.arange(runs.sum()) - np.repeat(first, runs)
    starts = np.repeat(np.cumsum(n) - n, runs) + inner * COUNTED
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & _SPREAD, starts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        set_ = (2 * counts > n[:, None]).astype(np.uint8)  # byte k holds bit 8 k + bit
        out[full] |= np.ascontiguousarray(set_).view("<u8").ravel() << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; null and wordless texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            step = 256
            for k in range(0, batch.num_rows, step):
                each = [shingle_hashes(t, width) for t in texts.slice(k, step).to_pylist()]
                sizes = np.fromiter(map(len, each), np.int64, len(each))
                hashes = np.fromiter(itertools.chain.from_iterable(each), np.uint64, int(sizes.sum()))
                yield pa.RecordBatch.from_arrays([ids.slice(k, step), pa.array(majority(hashes, sizes).view(np.int64))], names=["doc_id", "fp"])

    rows = documents(docs, doc_id, text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, FINGERPRINTS)


def flips(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``radius`` set, as signed 64-bit integers."""
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in itertools.combinations(range(bits), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _masks(bits: int, radius: int) -> Column:
    return F.expr(f"array({','.join(f'{m}L' if m >= 0 else f'({m + 1}L - 1L)' for m in flips(bits, radius))})")


def _stars(members: DataFrame, key: str) -> DataFrame:
    """(key, fp) -> (a, b): every member of a key with the smallest member; the key's rows are never gathered."""
    least = members.groupBy(key).agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most").select(key, "least")
    return members.join(stored(least, "least"), key).where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def _thirds() -> list[tuple[Column, int]]:
    """The three pairs of thirds of a fingerprint, and their bits: the low 42, the high 43, and both ends."""
    fp = F.col("fp")
    low, high = fp.bitwiseAND(F.lit((1 << 21) - 1)), F.shiftrightunsigned(fp, 42)
    return [(fp.bitwiseAND(F.lit((1 << 42) - 1)), 42), (F.shiftrightunsigned(fp, 21), 43), (low.bitwiseOR(F.shiftleft(high, 21)), 43)]


def _parts(fp: np.ndarray) -> list[np.ndarray]:
    """The same of unsigned fingerprints."""
    one = np.uint64
    return [fp & one((1 << 42) - 1), fp >> one(21), (fp & one((1 << 21) - 1)) | ((fp >> one(42)) << one(21))]


def _variants(radius: int) -> Column:
    """All keys of a fingerprint: variants of each pair of thirds, with the number of the pair above its bits."""
    def ball(part: Column, bits: int, number: int) -> Column:
        return F.transform(_masks(bits, radius), lambda m: part.bitwiseXOR(m) + F.lit(number << 44))

    return F.concat(*[ball(part, bits, number) for number, (part, bits) in enumerate(_thirds())])


def _settled(keys: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int, radius: int) -> np.ndarray:
    """Which candidates are links that this key reports: within the distance, in the first pair of thirds where the two can
    meet. They may meet at several keys of it; what is reported twice falls together later."""
    differ = [np.bitwise_count(x ^ y) for x, y in zip(_parts(a), _parts(b))]
    side = (keys >> np.uint64(44)).astype(np.int64)
    can = [d <= 2 * radius for d in differ]
    first = np.where(can[0], 0, np.where(can[1], 1, 2))
    near = (np.bitwise_count(a ^ b) <= distance) & (first == side)
    same = np.choose(side, differ) == 0  # equal there: all keys of the ball are common, only its centre reports
    return near & (~same | (np.choose(side, _parts(a)) == keys & np.uint64((1 << 44) - 1)))


def _meetings(distance: int, radius: int, crowd: int):
    """(key, fp) sorted by key -> links (a, b), and (a, null) for each fingerprint of a crowded key."""

    def links_of(keys, fps):
        change = np.append(True, keys[1:] != keys[:-1])
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, len(keys)))
        at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= crowd), sizes))
        end = np.repeat(starts + sizes, sizes)
        out_a, out_b = [fps[:0]], [fps[:0]]
        step = 1
        while len(at := at[at + step < end[at]]):
            a, b = fps[at], fps[at + step]
            good = _settled(keys[at], a, b, distance, radius)
            out_a.append(np.maximum(a[good], b[good]))
            out_b.append(np.minimum(a[good], b[good]))
            step += 1
        return np.concatenate(out_a), np.concatenate(out_b), fps[np.repeat(sizes > crowd, sizes)]

    def batch_of(a, b=None):
        none = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), none], names=["a", "b"])

    def run(batches):
        keys = fps = np.zeros(0, np.uint64)
        crowded = None  # a key that is known to be crowded: its further rows need not be kept
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                more = [batch.column(k).to_numpy().view(np.uint64) for k in (0, 1)]
                if crowded is not None:
                    same = more[0] == crowded
                    if same.any():
                        yield batch_of(more[1][same])
                        more = [x[~same] for x in more]
                if not len(more[0]):
                    continue
                keys, fps = np.concatenate([keys, more[0]]), np.concatenate([fps, more[1]])
                cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            else:
                cut = len(keys)
            if cut:
                a, b, many = links_of(keys[:cut], fps[:cut])
                yield batch_of(a, b)
                yield batch_of(many)
                keys, fps = keys[cut:], fps[cut:]
            if len(keys) > crowd:
                crowded = keys[0]
                yield batch_of(fps)
                keys, fps = keys[:0], fps[:0]

    return run


def links(nodes: DataFrame, distance: int = 4, crowd: int = 1024) -> DataFrame:
    """Different fingerprints (column fp) -> (a, b) edges whose components are those of all pairs within ``distance`` bits.

    The fingerprints of a key are compared if they are up to ``crowd``, so a row has at most that many comparisons; those
    of more crowded keys emit the full ball. Both are exact.
    """
    radius = -(-(distance - -(-distance // 3)) // 2)
    keys = nodes.select(F.explode(_variants(radius)).alias("key"), "fp")
    met = stored(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_meetings(distance, radius, crowd), "a long, b long"), "met")
    crowded = stored(met.where("b IS NULL").select(F.col("a").alias("fp")).distinct(), "crowded")
    ball = _masks(BITS, distance // 2)
    variants = crowded.select("fp", F.explode(F.transform(ball, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    return met.where("b IS NOT NULL").distinct().union(_stars(variants, "variant"))


def groups(prints: DataFrame, distance: int = 4, crowd: int = 1024) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, root, component_id): the smallest id reachable over links of at most ``distance`` bits.

    ``root`` names the component itself, as rows of different components may share an id. ``distance`` must be even. Null
    ids get a component like any row, but are not the smallest id; a component of null ids only has component null.
    Repeated rows stay repeated; an empty table gives an empty table.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    prints = stored(prints, "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    placed = stored(components_of(nodes, distance, crowd), "placed")
    joined = placed.where("linked")  # only these need to hear of others; a large component is spread over SALTS tasks
    smallest = joined.groupBy("root").agg(F.min("first").alias("least"))
    spread = smallest.select("root", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    heard = joined.withColumn("salt", F.pmod(F.hash("fp"), F.lit(SALTS))).join(spread, ["root", "salt"]).select("fp", "root", F.col("least").alias("component_id"))
    classes = stored(heard.union(placed.where("NOT linked").select("fp", "root", "first")), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, crowd: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row. Null texts and texts without words have
    fingerprint 0; very long texts are taken whole; other columns take no part."""
    found = groups(fingerprints(docs, width, doc_id, text), distance, crowd)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, width: int = 4, distance: int = 4, crowd: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per component, all its columns: that with the smallest id, rows without id only where no id is.

    Rows that share an id may be in different components, each of which keeps one. Of rows of one component that share the
    smallest id the one with the smallest fingerprint, text and content stays. Null and wordless texts are one component;
    very long texts are taken whole.
    """
    found = stored(groups(fingerprints(docs, width, doc_id, text), distance, crowd), "found")
    keep = stored(found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp")).alias("k")).select("k.doc_id", "k.fp"), "keep")
    several = stored(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "several")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(doc_id).cast("long").alias("keep_id"), F.col(text).alias("keep_text"))
    single = keep.join(several, keep["doc_id"].eqNullSafe(several["doc_id"]), "left_anti").select(F.col("doc_id").alias("keep_id"))
    kept = rows.join(single, "keep_id", "left_semi").select("row.*")
    repeated = rows.join(several, rows["keep_id"].eqNullSafe(several["doc_id"]), "left_semi")
    repeated = stored(repeated.withColumn("n", F.monotonically_increasing_id()), "repeated")
    marked = repeated.join(fingerprints(repeated.select("n", "keep_text"), width, "n", "keep_text").withColumnRenamed("doc_id", "n"), "n")
    wanted = keep.select(F.col("doc_id").alias("wanted_id"), F.col("fp").alias("wanted_fp"))
    chosen = marked.join(wanted, marked["keep_id"].eqNullSafe(wanted["wanted_id"]) & (F.col("fp") == F.col("wanted_fp")))
    one = chosen.groupBy("keep_id", "fp").agg(F.min_by("row", F.struct("keep_text", F.to_json("row"))).alias("row"))
    return kept.union(one.select("row.*"))


def components_of(nodes: DataFrame, distance: int, crowd: int) -> DataFrame:
    """Different fingerprints (column fp and others) -> these columns, root, and whether it is linked to another one."""
    roots = stored(components(links(nodes, distance, crowd)).select(F.col("node").alias("fp"), "root"), "roots")
    return nodes.join(roots, "fp", "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
