"""Near-dedup by HyperMinHash: each register keeps the count of leading zeros and a few mantissa bits of a minimum, bands
of compressed registers propose pairs, a collision-corrected Jaccard estimate thins them, and full shingle sets confirm.

Documents with equal shingle sets are one node.  Nodes of a band are first tied to one of them, not to each other; after
that only nodes of a band that are still in different components are compared, block by block, so that no link is lost
and no group is expanded into all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelib.llm.components import components
from tapelib.llm.store import stored
from tapelib.llm.text import SPACED, Chunk, chunks, gram_hashes, mix
from tapelib.llm.worker import kept

#: Two texts of similarity 0.8 share none of 32 bands of 5 registers with a probability of 3 in a million.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Bits of the minimum kept after its leading one.
MANTISSA = 10
#: Standard deviations of the estimate below the threshold at which a pair is dropped unconfirmed.
SLACK = 5.0
#: Nodes of a band compared at once in the second round: those outside its largest component with all.
STRAYS, OTHERS = 128, 512
_A = np.random.default_rng(11).integers(1, 2**62, size=REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(13).integers(0, 2**63, size=REGISTERS, dtype=np.uint64)
_SETS = (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))
#: Share of equal registers among unequal minima, from the paper on HyperMinHash, for sets of equal size.
COLLISIONS = 0.1699


def _shingles(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a chunk and ``rows + 1`` bounds; a text of fewer than ``k`` words is one shingle."""
    words, bounds = c.hashes(), c.bounds()
    n = np.diff(bounds)
    grams = gram_hashes(words, k)
    inside = np.flatnonzero(c.row[k - 1:] == c.row[:len(c.row) - k + 1]) if len(words) >= k else np.empty(0, dtype=np.int64)
    row, out = c.row[inside], grams[inside]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        one = np.array([gram_hashes(words[bounds[r]:bounds[r + 1]], int(n[r]))[0] for r in short], dtype=np.uint64)
        row, out = np.concatenate((row, short)), np.concatenate((out, mix(one + n[short].astype(np.uint64))))
        order = np.argsort(row, kind="stable")
        row, out = row[order], out[order]
    return out, np.searchsorted(row, np.arange(c.rows + 1))


def compress(minima: np.ndarray) -> np.ndarray:
    """16-bit registers: leading zeros (6 bits), then the mantissa bits."""
    v = minima | np.uint64(1)
    exponent = np.frexp((v >> np.uint64(11)).astype(np.float64) + 0.5)[1] + 10
    zeros = np.clip(63 - exponent, 0, 63).astype(np.uint64)
    mantissa = ((v << zeros) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype("<u2")


def sketches(df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n_shingles, node`` (128-bit digest of the set, null if empty) and ``registers`` of each row."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        kept("near dedup")
        for batch in batches:
            for c in chunks(batch.column("text"), SPACED, lower=True):
                shingles, bounds = _shingles(c, k)
                some = np.flatnonzero(np.diff(bounds))
                minima, work = np.zeros((c.rows, REGISTERS), dtype=np.uint64), np.empty_like(shingles)
                for j in range(REGISTERS if len(some) else 0):
                    np.bitwise_xor(shingles, _B[j], out=work)
                    np.multiply(work, _A[j], out=work)
                    minima[some, j] = np.minimum.reduceat(work, bounds[some])
                registers, size, nodes, raw = compress(minima), [], [], []
                marks = [mix(shingles ^ s) for s in _SETS]
                for r in range(c.rows):
                    lo, hi = bounds[r], bounds[r + 1]
                    found, first = np.unique(shingles[lo:hi], return_index=True)
                    size.append(len(found))
                    nodes.append(b"".join(int(m[lo:hi][first].sum()).to_bytes(8, "little") for m in marks) if len(found) else None)
                    raw.append(registers[r].tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(c.first, c.rows), pa.array(size, pa.int64()), pa.array(nodes, pa.binary()), pa.array(raw, pa.binary())], ["id", "n_shingles", "node", "registers"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_shingles long, node binary, registers binary")


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, less the expected chance collisions."""
    ratio = n / m
    chance = COLLISIONS * 2.0 ** -MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (equal / REGISTERS - chance) / (1 - chance)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, REGISTERS)


class _Threshold:
    def __init__(self, percent: int):
        self.percent = percent
        p = percent / 100
        self.least = p - SLACK * np.sqrt(p * (1 - p) / REGISTERS)

    def likely(self, equal, n, m):
        return (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)) & (estimate(equal, n, m) >= self.least)


def _band_keys(nodes: DataFrame) -> DataFrame:
    """``band`` (64-bit key of band number and its registers), ``number``, ``node``."""
    def run(batches):
        for batch in batches:
            registers = _matrix(batch.column("registers")).astype(np.uint64) if batch.num_rows else np.zeros((0, REGISTERS), dtype=np.uint64)
            for b in range(BANDS):
                key = np.full(len(registers), b + 1, dtype=np.uint64)
                for j in range(b * ROWS, (b + 1) * ROWS):
                    key = mix(key + registers[:, j])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array([b] * len(key), pa.int32()), batch.column("node")], ["band", "number", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "band long, number int, node binary")


def _star_pairs(members: DataFrame, centres: DataFrame, nodes: DataFrame, limit: _Threshold) -> DataFrame:
    """Each node with the centre that it shares most bands with, if they are likely to be similar."""
    pairs = members.join(centres, "band").filter("node != centre").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("shared"))
    pairs = pairs.groupBy("node").agg(F.max(F.struct("shared", "centre")).alias("best")).select("node", "best.centre")
    at = nodes.select(F.col("node").alias("centre"), F.col("registers").alias("c_registers"), F.col("n_shingles").alias("c_n"))
    joined = pairs.join(nodes.select("node", "registers", "n_shingles"), "node").join(at, "centre")

    def compare(batches):
        for batch in batches:
            equal = (_matrix(batch.column("registers")) == _matrix(batch.column("c_registers"))).sum(axis=1) if batch.num_rows else np.zeros(0)
            n, m = batch.column("n_shingles").to_numpy(), batch.column("c_n").to_numpy()
            keep = limit.likely(equal, n, m)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("centre")], ["node", "centre"]).filter(pa.array(keep))

    return joined.mapInArrow(compare, "node binary, centre binary")


def _pairs_in_band(table: pa.Table, limit: _Threshold) -> list[tuple[float, int, int]]:
    """Likely pairs (estimate, stray, other) of rows in different components, each in the first band that the two share."""
    stray = np.flatnonzero(table.column("stray").to_numpy(zero_copy_only=False))
    other = np.flatnonzero(~table.column("stray").to_numpy(zero_copy_only=False))
    comp = np.unique(np.array(table.column("comp").to_pylist(), dtype=object), return_inverse=True)[1]
    registers, n = _matrix(table.column("registers").combine_chunks()), table.column("n_shingles").to_numpy()
    number, out = table.column("number")[0].as_py(), []
    for s in stray:
        apart = other[comp[other] != comp[s]]
        same = registers[apart] == registers[s]
        equal = same.sum(axis=1)
        keep = limit.likely(equal, n[apart], np.full(len(apart), n[s]))
        keep &= same.reshape(len(apart), BANDS, ROWS).all(axis=2).argmax(axis=1) == number
        out += zip(estimate(equal[keep], n[apart[keep]], n[s]).tolist(), [int(s)] * int(keep.sum()), apart[keep].tolist(), strict=True)
    return out


def _stray_edges(members: DataFrame, comps: DataFrame, nodes: DataFrame, sets: DataFrame, limit: _Threshold) -> DataFrame:
    """Edges that join components: in each band, nodes outside its largest component are compared with all, in blocks.

    A first pass over registers keeps the nodes with a likely partner; a second one, with full sets, confirms pairs, most
    similar first, and leaves out those that are connected by then.  Neither puts out more rows than it gets."""
    placed = stored(members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "near-placed")
    each = placed.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    bands = each.groupBy("band").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    bands = stored(bands.select("band", F.col("top.comp").alias("main"), F.ceil((F.col("size") - F.col("top.n")) / STRAYS).cast("int").alias("blocks"), F.ceil(F.col("size") / OTHERS).cast("int").alias("parts")), "near-bands")
    rows = placed.join(bands, "band").join(nodes.select("node", "registers", "n_shingles"), "node")
    stray = rows.filter("comp != main").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    other = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["band", "number", "block", "part", "node", "comp", "registers", "n_shingles"]
    both = stray.select(*columns, F.lit(True).alias("stray")).unionByName(other.select(*columns, F.lit(False).alias("stray")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema)

    def with_partner(key, table):
        pairs = _pairs_in_band(table, limit)
        return table.take(pa.array(sorted({x for _, s, o in pairs for x in (s, o)}), pa.int64()))

    def confirm(key, table):
        parent, a, b = {}, [], []
        node, comp = table.column("node").to_pylist(), table.column("comp").to_pylist()

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        shingles = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
        for _, s, o in sorted(_pairs_in_band(table, limit), reverse=True):
            if root(comp[s]) != root(comp[o]) and _similar(shingles[s], shingles[o], limit.percent):
                parent[root(comp[s])] = root(comp[o])
                a.append(node[s])
                b.append(node[o])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    likely = both.groupBy("band", "block", "part").applyInArrow(with_partner, schema)
    return likely.join(sets, "node").groupBy("band", "block", "part").applyInArrow(confirm, "a binary, b binary")


def _sets(df: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``node`` and the sorted hashes of its full shingle set, from the whole text of one of its documents."""
    reps = nodes.join(wanted, "node", "left_semi").select(F.col("rep").alias("r_id"), "node").hint("shuffle_hash")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(reps, F.col("id").eqNullSafe(F.col("r_id"))).select("node", "text")

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column("text"), SPACED, lower=True):
                shingles, bounds = _shingles(c, k)
                marks = [mix(shingles ^ s) for s in _SETS]
                node, out, asked = [], [], batch.column("node").slice(c.first, c.rows).to_pylist()
                for r in range(c.rows):
                    found, first = np.unique(shingles[bounds[r]:bounds[r + 1]], return_index=True)
                    own = b"".join(int(m[bounds[r]:bounds[r + 1]][first].sum()).to_bytes(8, "little") for m in marks)
                    if own == asked[r]:  # an id may stand for several texts
                        node.append(own)
                        out.append(found.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(out, pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(run, "node binary, shingles binary").dropDuplicates(["node"])


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, centre) whose full sets are similar enough, as edges."""
    joined = pairs.select("node", "centre").join(sets, "node").join(sets.select(F.col("node").alias("centre"), F.col("shingles").alias("c_shingles")), "centre")

    def compare(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("shingles"), batch.column("c_shingles"), strict=True):
                keep.append(_similar(np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64), percent))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("centre")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(compare, "a binary, b binary")


def near_groups(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id, n_shingles`` (size of its set of ``k``-word shingles), ``component_id`` (smallest
    id reachable over links of ``percent`` / 100 or more), ``kept`` (the id is the component's).

    A-Z count as lower case.  A text of fewer than ``k`` words is one shingle; null and empty texts have no shingles, are
    linked with nothing and stay.  Repeated rows are linked and keep their common id; null ids stand for a component only
    if it has no others.  An empty table gives an empty result.
    """
    limit = _Threshold(percent)
    rows = stored(sketches(df, k, id_col, text_col), "sketches")
    nodes = stored(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")), "near-nodes")
    bands = _band_keys(nodes)
    sizes = stored(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-sizes")
    members = stored(bands.join(sizes, "band"), "near-members")
    # the centre of a band: the node with most company over all its bands, such as the text that the others were copied from
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    centres = stored(members.join(company, "node").groupBy("band").agg(F.max(F.struct("company", "node")).alias("c")).select("band", "c.node"), "near-centres").withColumnRenamed("node", "centre")
    members = members.select("band", "number", "node")
    sets = stored(_sets(df, nodes, members.select("node").distinct(), k, id_col, text_col), "near-sets")
    edges = stored(_confirmed(_star_pairs(members, centres, nodes, limit), sets, percent), "near-edges")
    comps = components(edges, "near-components")
    more = stored(_stray_edges(members, comps, nodes, sets, limit), "near-edges")
    if not more.isEmpty():
        comps = components(edges.unionByName(more), "near-components")
    # every node of an edge and the smallest id of its component
    least = comps.join(nodes.select("node", "rep"), "node").groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_node = nodes.join(comps, "node", "left").join(least, "comp", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    found = rows.select("id", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select("id", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def near_dedup(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that stay: one id of each group (see :func:`near_groups`).  Rows that share an id
    stay or go together."""
    stay = near_groups(df, k, percent, id_col, text_col).filter("kept").select(F.col("id").alias("__id")).distinct().hint("shuffle_hash")
    return df.join(stay, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
