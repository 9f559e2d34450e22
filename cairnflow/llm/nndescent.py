"""Near-duplicate vectors by NN-descent on a neighbour graph, with lists that grow and a recall audit.

Vectors are compared within a label (and number of dimensions) by cosine; those at or above a threshold are linked.

1. Vectors with equal components form a class, a node of the graph; copies add to its weight and make no pairs.  Nodes get a short form, 16 bits a
   component, whose products are whole numbers and so alike wherever they are computed.
2. Each node's first list: nodes are sorted by the sides of random hyperplanes on which they lie, several times, and in each stretch of
   ``LEAF`` nodes every one takes its ``K`` nearest.
3. Descent: a node's neighbours, and those whose neighbour it is, meet at it; two that meet, one of them newly listed, are
   compared, and each enters the other's list if it is nearer than the last there.  The neighbours of hubs meet in
   chunks of about ``CHUNK``.  Rounds end when hardly any list changes.
4. A list that holds nothing but links is saturated: it may cut links off.  It doubles, and its entries count as new, up to ``MOST``.
   What longer lists would hold is settled by step 6.
5. The entries at the threshold or above, confirmed in double precision, are edges; their components follow.
6. Within a component links are counted exactly: its members are dealt to blocks, and of two blocks it is known from their centres and
   radii that all of their pairs link or none, or else they are compared.  So dense groups of any size lose no link and list no pair.
7. Audit: a bounded sample of nodes is compared with all others.  If less than ``RECALL`` of their links (a mean of the sample's nodes that have any) lie in components, there
   are more hyperplanes and another descent.  The links that the audit finds count as edges.

Scale: lists are of bounded length, groups that meet are of bounded size, and each round shuffles short forms once; nothing is
proportional to the square of a label or of a group of copies.  Only the audit's sample is on the driver, ``SAMPLE_BYTES`` at most.

Defined results: a vector that is null, empty or zero, or has a null or non-finite component, or whose label is null, links with nothing.
A null vec_id links with nothing, and its component_id is null.  Rows of one vec_id are vectors of their own.  Vectors of different
lengths don't link.  An empty table gives an empty result.  Other columns are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, claim, column, materialise
from .components import components

THRESHOLD = 0.93
K, MOST = 10, 40
TREES, LEAF = 6, 128
CHUNK = 64
BLOCK = 1024
ROUNDS = 8
#: Rounds end when fewer than this part of the list entries are new.
SETTLED = 0.01
RECALL, AUDITS, SAMPLE, SAMPLE_BYTES = 0.99, 3, 256, 1 << 18
#: Short forms: components times SCALE, rounded.  A product of two is off by sqrt(dimensions) / SCALE at most, under SLACK to 10,000 dimensions.
SCALE = 1 << 14
SLACK = 0.01
_BITS = 62


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    raw, width = np.ascontiguousarray(rows), rows.shape[1] * rows.itemsize
    at = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])


def _matrix(values: pa.Array, kind: type) -> np.ndarray:
    """Binary values of one length as rows."""
    at = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].view(kind).reshape(len(values), -1)


def _groups(parts: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """The rows of each key, which lie side by side."""
    held: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, k: int) -> tuple:
        return tuple(column(b, c)[k].as_py() for c in keys)

    for b in parts:
        if not len(b):
            continue
        differ = np.zeros(len(b), dtype=bool)
        for c in keys:
            v = column(b, c)
            v = v.dictionary_encode().indices if pa.types.is_string(v.type) else v
            v = v.to_numpy(zero_copy_only=False)
            differ[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(differ).tolist(), len(b)]
        if held and key(held[0], 0) != key(b, 0):
            yield _one(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            held.append(b.slice(lo, hi - lo))
            if hi < len(b):
                yield _one(held)
                held = []
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _prepared(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """id and grp (label and length; null for what links with nothing), the 128-bit hash of the components, and the unit vector in double precision."""
    schema = pa.schema([("id", pa.int64()), ("grp", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("unit", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("nndescent")
        for b in parts:
            out = []
            for i, name, v in zip(*(column(b, c).to_pylist() for c in ("id", "label", "v"))):
                grp = unit = None
                h = (None, None)
                if i is not None and name is not None and v and None not in v:
                    x = np.array(v, dtype=np.float64) + 0.0  # no negative zeros
                    most = np.abs(x).max()
                    if np.isfinite(most) and most > 0:
                        grp = f"{len(x)} {name}"
                        h = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), dtype="<i8").tolist()
                        x = x / most
                        unit = (x / np.sqrt((x * x).sum())).tobytes()
                out.append((i, grp, *h, unit))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)

    d = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    return d.mapInArrow(run, "id long, grp string, h1 long, h2 long, unit binary")


def nodes_of(prepared: DataFrame) -> DataFrame:
    """node, grp, h1, h2, rep (the smallest id), n (rows), unit and q (short form) of each class of equal vectors."""
    classes = prepared.where("grp is not null").groupBy("grp", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.max("unit").alias("unit"))
    numbered = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            q = pa.array([np.rint(np.frombuffer(u, dtype=np.float64) * SCALE).astype(np.int16).tobytes() for u in column(b, "unit").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, q], names=[*b.schema.names, "q"])

    names = ["node", "grp", "h1", "h2", "rep", "n", "unit"]
    return materialise(numbered.select(*names).mapInArrow(run, "node long, grp string, h1 long, h2 long, rep long, n long, unit binary, q binary"), "nodes")


def _planes(dim: int, tree: int) -> np.ndarray:
    return np.random.default_rng([tree, dim]).standard_normal((dim, _BITS))


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of short forms, the k others of the largest products, and those."""
    f = x.astype(np.float64)
    s = f @ f.T
    np.fill_diagonal(s, -np.inf)
    k = min(k, len(s) - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(s) - 1 else np.argsort(-s, axis=1)[:, :k]
    return top, np.take_along_axis(s, top, 1)


_LISTED = pa.list_(pa.struct([("sim", pa.int32()), ("id", pa.int64())]))
_LISTS = "array<struct<sim:int,id:long>>"


def _entries(counts: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Lists of entries, given end to end; products become cosines times SCALE."""
    at = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array((sims / SCALE).astype(np.int32)), pa.array(ids.astype(np.int64))], fields=list(_LISTED.value_type)))


def seeds(nodes: DataFrame, trees: range, k: int) -> DataFrame:
    """node and the nearest that it meets in a stretch of LEAF nodes, for each of trees."""

    def sides(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("nndescent")
        made: dict[tuple, np.ndarray] = {}
        weights = 1 << np.arange(_BITS - 1, -1, -1, dtype=np.int64)
        for b in parts:
            codes = []
            for raw in column(b, "q").to_pylist():
                x = np.frombuffer(raw, dtype=np.int16).astype(np.float64)
                if (len(x),) not in made:
                    made.clear()
                    made[len(x),] = np.concatenate([_planes(len(x), t) for t in trees], axis=1)
                codes.append(((x @ made[len(x),] > 0).reshape(len(trees), _BITS) * weights).sum(1).tolist())
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("node", "grp", "q")), pa.array(codes, pa.list_(pa.int64()))], names=["node", "grp", "q", "codes"])

    def stretches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("nndescent")
        for g in _groups(parts, "grp", "tree"):
            cuts = list(range(0, len(g), LEAF)) + [len(g)]
            if len(cuts) > 2 and cuts[-1] - cuts[-2] < LEAF // 2:
                del cuts[-2]  # a short end goes with the stretch before
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo > 1:
                    part = g.slice(lo, hi - lo)
                    ids = column(part, "node").to_numpy()
                    top, sims = _nearest(_matrix(column(part, "q"), np.int16), k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), _entries(np.full(len(ids), top.shape[1]), sims.ravel(), ids[top].ravel())], names=["node", "found"])

    d = nodes.select("node", "grp", "q").mapInArrow(sides, "node long, grp string, q binary, codes array<long>")
    d = d.select("node", "grp", "q", F.posexplode("codes").alias("tree", "code"))
    order = ["grp", "tree", "code", "node"]
    return d.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(stretches, f"node long, found {_LISTS}")


def _merged(lists: DataFrame | None, found: DataFrame, nodes: DataFrame, threshold: float, k: int, most: int) -> DataFrame:
    """node, k, nbrs (nearest first) and fresh (those of nbrs that are newly listed); k doubles where all k are links."""
    rows = found.select("node", "found", F.lit(None).cast("int").alias("k"), F.lit(None).cast(_LISTS).alias("old"))
    if lists is not None:
        rows = rows.unionByName(lists.select("node", F.lit(None).cast(_LISTS).alias("found"), "k", F.col("nbrs").alias("old")))
    d = rows.groupBy("node").agg(F.collect_list("found").alias("found"), F.coalesce(F.max("k"), F.lit(k)).alias("k"), F.flatten(F.collect_list("old")).alias("old"))
    d = d.withColumn("all", F.sort_array(F.array_distinct(F.concat("old", F.flatten("found"))), asc=False)).withColumn("nbrs", F.slice("all", F.lit(1), F.col("k")))
    full = (F.size("nbrs") >= F.col("k")) & (F.element_at("nbrs", -1)["sim"] >= int((threshold - SLACK) * SCALE)) & (F.col("k") < most)
    # a list that grows takes what was left out of it just now, and all of it counts as new
    grown = F.least(2 * F.col("k"), F.lit(most))
    return d.select("node", F.when(full, grown).otherwise(F.col("k")).alias("k"), F.when(full, F.slice("all", F.lit(1), grown)).otherwise(F.col("nbrs")).alias("nbrs"), F.when(full, F.slice("all", F.lit(1), grown)).otherwise(F.array_except("nbrs", "old")).alias("fresh"))


def _meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the nodes that meet at another: each with those that are nearer to it than the last of its list, where one of the two is new there."""
    claim("nndescent")
    held: list[tuple] = []
    size = 0

    def give() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[0] for h in held])), _entries(np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))], names=["node", "found"])

    for g in _groups(parts, "at", "chunk"):
        ids, first = np.unique(column(g, "id").to_numpy(), return_index=True)
        if len(ids) < 2:
            continue
        fresh = np.zeros(len(ids), dtype=bool)
        np.logical_or.at(fresh, np.searchsorted(ids, column(g, "id").to_numpy()), column(g, "fresh").to_numpy(zero_copy_only=False))
        if not fresh.any():
            continue
        x = _matrix(column(g, "q"), np.int16)[first].astype(np.float64)
        least, most = column(g, "worst").to_numpy()[first], column(g, "k").to_numpy()[first]
        s = x @ x.T
        s[~(fresh[:, None] | fresh)] = -np.inf
        np.fill_diagonal(s, -np.inf)
        s[s < ((least.astype(np.float64) + 1) * SCALE)[:, None]] = -np.inf
        some = np.flatnonzero((s > -np.inf).any(1))
        counts, sims, others = [], [], []
        for r in some.tolist():
            y = np.flatnonzero(s[r] > -np.inf)
            if len(y) > most[r]:
                y = y[np.argpartition(-s[r, y], most[r] - 1)[: most[r]]]
            counts.append(len(y))
            sims.append(s[r, y])
            others.append(ids[y])
        if len(some):
            held.append((ids[some], np.array(counts), np.concatenate(sims), np.concatenate(others)))
            size += sum(counts)
            if size > 20_000:
                yield give()
                held, size = [], 0
    if held:
        yield give()


def descend(lists: DataFrame, nodes: DataFrame, threshold: float, k: int, most: int) -> DataFrame:
    """One round: neighbours of neighbours join."""
    worst = F.when(F.size("nbrs") < F.col("k"), F.lit(-2 * SCALE)).otherwise(F.element_at("nbrs", -1)["sim"])
    known = lists.select("node", "k", worst.alias("worst")).join(nodes.select("node", "q"), "node")
    ahead = lists.select("node", F.explode("nbrs").alias("e"), "fresh").select("node", F.col("e.id").alias("nbr"), F.array_contains("fresh", F.col("e")).alias("fresh"))
    back = ahead.select(F.col("nbr").alias("at"), F.col("node").alias("id"), "fresh")
    crowds = back.groupBy("at").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    # a hub's neighbours meet in chunks, each with the hub's own list
    hubs = materialise(crowds, "hubs")
    spread = lambda d: d.join(hubs, "at", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    back = spread(back).select("at", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "id", "fresh")
    own = spread(ahead.select(F.col("node").alias("at"), F.col("nbr").alias("id"), "fresh")).select("at", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), "id", "fresh")
    met = own.unionByName(back).join(known.withColumnRenamed("node", "id"), "id")
    met = met.repartition("at", "chunk").sortWithinPartitions("at", "chunk")
    return met.select("at", "chunk", "id", "fresh", "k", "worst", "q").mapInArrow(_meet, f"node long, found {_LISTS}")


def graph(nodes: DataFrame, threshold: float, trees: range, lists: DataFrame | None = None, k: int = K, most: int = MOST, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour lists that descent ends with."""
    lists = materialise(_merged(lists, seeds(nodes, trees, k), nodes, threshold, k, most), "lists")
    for _ in range(rounds):
        n, new = lists.agg(F.sum(F.size("nbrs")), F.sum(F.size("fresh"))).first()
        if not n or new <= SETTLED * n:
            break
        lists = materialise(_merged(lists, descend(lists, nodes, threshold, k, most), nodes, threshold, k, most), "lists")
    return lists


def _confirmed(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose cosine in double precision is at the threshold or above."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            x = zip(column(b, "ua").to_pylist(), column(b, "ub").to_pylist())
            ok = pa.array([len(u) == len(v) and float(np.frombuffer(u) @ np.frombuffer(v)) >= threshold for u, v in x], pa.bool_())
            yield b.select(["a", "b"]).filter(ok)

    ends = [nodes.select(F.col("node").alias(c), F.col("unit").alias(f"u{c}")) for c in "ab"]
    return pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "ua", "ub").mapInArrow(run, "a long, b long")


def _audit(nodes: DataFrame, threshold: float, seed: int) -> DataFrame:
    """a, b: the links of a bounded sample of nodes (a) with all nodes."""
    width = nodes.agg(F.max(F.length("unit"))).first()[0] or 8
    got = nodes.select("node", "grp", "unit").orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(max(1, min(SAMPLE, SAMPLE_BYTES // width))).collect()
    asked: dict[str, tuple] = {}
    for grp in {r.grp for r in got}:
        mine = [r for r in got if r.grp == grp]
        asked[grp] = (np.array([r.node for r in mine]), np.stack([np.frombuffer(r.unit) for r in mine]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            grp, ids = np.array(column(b, "grp").to_pylist(), dtype=object), column(b, "node").to_numpy()
            units = np.array(column(b, "unit").to_pylist(), dtype=object)
            for name in dict.fromkeys(grp.tolist()):
                if name in asked:
                    rows = np.flatnonzero(grp == name)
                    q, u = asked[name]
                    x, y = np.nonzero(u @ np.stack([np.frombuffer(units[r]) for r in rows]).T >= threshold)
                    keep = q[x] != ids[rows[y]]
                    yield pa.RecordBatch.from_arrays([pa.array(q[x][keep]), pa.array(ids[rows[y]][keep])], names=["a", "b"])

    return materialise(nodes.select("node", "grp", "unit").mapInArrow(run, "a long, b long"), "audited")


def _recall(links: DataFrame, comp: DataFrame) -> float:
    """How much of the sampled nodes' links lies in components, a mean of nodes."""
    ends = [comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
    found = links.join(ends[0], "a", "left").join(ends[1], "b", "left").groupBy("a").agg(F.avg(F.coalesce((F.col("ca") == F.col("cb")).cast("double"), F.lit(0.0))).alias("r"))
    got = found.agg(F.avg("r")).first()[0]
    return 1.0 if got is None else got


_FACTS = pa.schema([("component", pa.int64()), ("block", pa.int32()), ("weight", pa.int64()), ("centre", pa.binary()), ("radius", pa.float64())])


def _block_facts(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Weight, centre and radius (an angle) of each block."""
    for g in _groups(parts, "component", "block"):
        u = _matrix(column(g, "unit"), np.float64)
        c = u.mean(0)
        c = c / max(np.linalg.norm(c), 1e-300)
        yield column(g, "component")[0].as_py(), column(g, "block")[0].as_py(), int(column(g, "n").to_numpy().sum()), c.tobytes(), float(np.arccos(np.clip((u @ c).min(), -1, 1)))


def _compared(threshold: float) -> Callable:
    """The links that each member of a block has in another block, or in its own."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("nndescent")
        for g in _groups(parts, "component", "i", "j"):
            i, j = column(g, "i")[0].as_py(), column(g, "j")[0].as_py()
            block, ids, n, u = column(g, "block").to_numpy(), column(g, "node").to_numpy(), column(g, "n").to_numpy(), _matrix(column(g, "unit"), np.float64)
            x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
            there = np.zeros(len(y), dtype=np.int64)
            for k in range(0, len(x), BLOCK):
                r = x[k : k + BLOCK]
                hit = u[r] @ u[y].T >= threshold
                hit &= ids[r][:, None] != ids[y]
                here = hit @ n[y]
                there += n[r] @ hit
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(here.astype(np.int64))], names=["node", "links"])
            if i != j:
                yield pa.RecordBatch.from_arrays([pa.array(ids[y]), pa.array(there)], names=["node", "links"])

    return run


def link_counts(members: DataFrame, threshold: float, size: int = BLOCK) -> DataFrame:
    """node and links (other rows linked with one of its rows, but for its own copies) of members (node, component, n, unit)."""
    # written, so that a small table is known to be one and large components aren't dealt by their number
    blocks = materialise(members.groupBy("component").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks")), "sizes")
    m = materialise(members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "members")
    facts = m.select("component", "block", "n", "unit").repartition("component", "block").sortWithinPartitions("component", "block")
    facts = materialise(facts.mapInArrow(lambda it: batches(_block_facts(it), _FACTS), "component long, block int, weight long, centre binary, radius double"), "blocks")
    # of n blocks in order, pair every one with itself and those behind it
    pairs = blocks.select("component", "blocks", F.explode(F.expr("sequence(0, blocks - 1)")).alias("i")).select("component", "i", F.explode(F.expr("sequence(i, blocks - 1)")).alias("j"))
    ends = [facts.select("component", F.col("block").alias(k), F.col("weight").alias(f"w{k}"), F.col("centre").alias(f"c{k}"), F.col("radius").alias(f"r{k}")) for k in "ij"]
    at = pairs.join(ends[0], ["component", "i"]).join(ends[1], ["component", "j"])

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = float(np.arccos(threshold))
        for b in parts:
            apart = np.array([np.arccos(np.clip(float(np.frombuffer(x) @ np.frombuffer(y)), -1, 1)) for x, y in zip(column(b, "ci").to_pylist(), column(b, "cj").to_pylist())])
            reach = column(b, "ri").to_numpy() + column(b, "rj").to_numpy()
            verdict = np.where(apart + reach < wide - 1e-6, 1, np.where(apart - reach > wide + 1e-6, -1, 0))
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("component", "i", "j", "wi", "wj")), pa.array(verdict.astype(np.int32))], names=["component", "i", "j", "wi", "wj", "verdict"])

    judged = at.select("component", "i", "j", "wi", "wj", "ci", "cj", "ri", "rj").mapInArrow(judge, "component long, i int, j int, wi long, wj long, verdict int")
    judged = materialise(judged, "judged")
    sure = judged.where("verdict = 1")
    sure = sure.select("component", F.col("i").alias("block"), F.col("wj").alias("w")).unionByName(sure.where("i < j").select("component", F.col("j").alias("block"), F.col("wi").alias("w")))
    # in a block whose pairs all link a node has all rows but its own
    whole = judged.where("verdict = 1 and i = j").select("component", F.col("i").alias("block"), F.lit(1).alias("own"))
    by_block = sure.groupBy("component", "block").agg(F.sum("w").alias("w")).join(whole, ["component", "block"], "left")
    known = m.join(by_block, ["component", "block"]).select("node", (F.col("w") - F.when(F.col("own") == 1, F.col("n")).otherwise(0)).alias("links"))
    open_ = judged.where("verdict = 0").select("component", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    some = open_.join(m, ["component", "block"]).select("component", "i", "j", "block", "node", "n", "unit")
    some = some.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return known.unionByName(some.mapInArrow(_compared(threshold), "node long, links long")).groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", k: int = K, most: int = MOST, trees: int = TREES) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    prepared = materialise(_prepared(rows, vec_id, embedding, label), "vectors")
    nodes = nodes_of(prepared)
    comp = lists = audited = None
    for turn in range(AUDITS):
        lists = graph(nodes, threshold, range(turn * trees, (turn + 1) * trees), lists, k, most)
        near = lists.select(F.col("node").alias("x"), F.explode("nbrs").alias("e")).where(F.col("e.sim") >= int((threshold - SLACK) * SCALE))
        edges = _confirmed(near.select(F.least("x", "e.id").alias("a"), F.greatest("x", "e.id").alias("b")).distinct(), nodes, threshold)
        edges = edges if audited is None else edges.unionByName(audited)
        comp = materialise(components(edges), "components")
        links = _audit(nodes, threshold, turn)
        recall = _recall(links, comp)
        audited = links if audited is None else audited.unionByName(links)
        if recall >= RECALL:
            break
    members = comp.join(nodes.select("node", "n", "rep", "unit"), "node")
    counts = link_counts(members.select("node", "component", "n", "unit"), threshold)
    least = materialise(members.groupBy("component").agg(F.min("rep").alias("least")), "least")
    of_node = nodes.select("node", "grp", "h1", "h2", "n", "rep").join(comp, "node", "left").join(least, "component", "left").join(counts, "node", "left")
    of_node = of_node.select("grp", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    valid = prepared.where("grp is not null").select("id", "grp", "h1", "h2").join(of_node, ["grp", "h1", "h2"]).select("id", "n_links", "component_id")
    none = prepared.where("grp is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = valid.unionByName(none).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
