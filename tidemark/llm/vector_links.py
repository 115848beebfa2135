"""Near-duplicate embeddings found on a robust-pruned flat graph.

Vectors of one label are dealt to their nearest centroids, each to several, so the clusters
overlap. Every cluster shard builds a flat graph: each vector's nearest neighbours, pruned so that
no neighbour is nearer to a kept one than, by a margin, to the vector itself. The adjacency lists
that a vector got in its shards are united. Then each shard searches the united graph: greedy
search from the shard's medoid finds a vector's surroundings, and as long as vectors within the
range turn up, the search goes on through their neighbours. Every link is verified in double
precision. An audit compares a bounded sample of vectors with all others by brute force; if too
few links were found, everything is done again with wider overlap and search, and labels that
still miss some are compared pair by pair.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import components, pick, stage


@dataclass(frozen=True)
class Settings:
    similarity: float = 0.98
    sample_rows: int = 20_000
    """Vectors that the centroids are fitted on."""
    shard_rows: int = 400
    """Vectors per centroid; a shard that grows beyond twice that is cut into blocks."""
    most_centroids: int = 2_048
    overlap: int = 3
    """Centroids that a vector may go to: the nearest, and those not much farther."""
    degree: int = 16
    candidates: int = 48
    alpha: float = 1.2
    far: int = 4
    """Random neighbours besides, so that groups larger than ``candidates`` stay within reach."""
    width: int = 32
    audited: int = 200
    """Vectors that the audit compares with all others at first; more until ``linked`` have links."""
    linked: int = 50
    most_audited: int = 3_200
    recall: float = 0.95
    tries: int = 3


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


# Centroids and shards.


def centroids(vectors: DataFrame, settings: Settings) -> dict[tuple[int, int], np.ndarray]:
    """Centroids by label and length of the vectors, by k-means on the rows with the lowest hash.

    The driver holds at most ``sample_rows`` vectors and ``most_centroids`` centroids.
    """
    counts = {(r.label, r.dim): r.n for r in vectors.groupBy("label", "dim").agg(F.count("*").alias("n")).collect()}
    rows = vectors.orderBy(F.xxhash64("group"), "group").limit(settings.sample_rows).select("label", "dim", "v").collect()
    total, out = sum(counts.values()), {}
    for (label, dim), n in counts.items():
        own = np.array([r.v for r in rows if (r.label, r.dim) == (label, dim)], float).reshape(-1, dim)
        k = min(-(-n // settings.shard_rows), max(1, settings.most_centroids * n // total), len(own))
        random = np.random.default_rng(0)
        if k <= 1:
            out[label, dim] = np.zeros((1, dim))
            continue
        at = own[random.choice(len(own), k, replace=False)]
        for _ in range(8):
            near = (own @ at.T).argmax(axis=1)
            sums = np.zeros_like(at)
            np.add.at(sums, near, own)
            full = np.sqrt((sums * sums).sum(axis=1)) > 1e-9
            at[full] = _unit(sums[full])
        out[label, dim] = at
    return out


def _dealt(vectors: DataFrame, at: dict[tuple[int, int], np.ndarray], settings: Settings) -> DataFrame:
    """``label, dim, group, v, shard`` per vector and centroid it goes to; the first is its own.

    A link of ``similarity`` spans an angle; a vector goes to the centroids whose angle exceeds the
    nearest one's by at most twice that, nearest first, up to ``overlap``.
    """
    slack = 2 * np.arccos(settings.similarity)
    shared = vectors.sparkSession.sparkContext.broadcast(at)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            shards: list = [None] * batch.num_rows
            label, dim = (batch.column(x).to_numpy() for x in ("label", "dim"))
            for key in set(zip(label.tolist(), dim.tolist(), strict=True)):
                rows = np.flatnonzero((label == key[0]) & (dim == key[1]))
                own = shared.value[key]
                angle = np.arccos(np.clip(_matrix(batch.column("v").take(pa.array(rows))) @ own.T, -1, 1))
                order = np.argsort(angle, axis=1)[:, : settings.overlap]
                sorted_ = np.take_along_axis(angle, order, axis=1)
                for row, places, near in zip(rows, order, sorted_, strict=True):
                    shards[row] = places[near <= near[0] + slack].tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("label", "dim", "group", "v")), pa.array(shards, pa.list_(pa.int32()))], ["label", "dim", "group", "v", "shards"])

    dealt = vectors.select("label", "dim", "group", "v").mapInArrow(run, "label long, dim int, group long, v array<double>, shards array<int>")
    return dealt.select("label", "dim", "group", "v", F.explode("shards").alias("shard"))


def _in_blocks(dealt: DataFrame, settings: Settings) -> DataFrame:
    """``part`` names the shard's block that a vector is in; blocks keep a shard's graph in memory."""
    sizes = dealt.groupBy("label", "dim", "shard").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / (2 * settings.shard_rows)).cast("int")
    block = F.pmod(F.xxhash64("group"), "blocks").cast("int")
    return dealt.join(F.broadcast(sizes.withColumn("blocks", blocks).drop("n")), ["label", "dim", "shard"]).withColumn("block", block)


# The graph.


def pruned_graph(rows: np.ndarray, settings: Settings) -> np.ndarray:
    """Neighbours of each row, -1 where there are fewer than ``degree``.

    Candidates are the nearest rows. The nearest is kept; candidates that are nearer to it, by the
    factor ``alpha``, than to the row go; and so on. Some random rows come on top.
    """
    n, wide = len(rows), min(settings.candidates, len(rows) - 1)
    near_most = settings.degree - settings.far
    out = np.full((n, settings.degree), -1)
    if n > settings.degree:
        out[:, near_most:] = np.random.default_rng(n).integers(0, n, (n, settings.far))
    for at in range(0, n, 256):
        own = np.arange(at, min(at + 256, n))
        dots = rows[own] @ rows.T
        dots[np.arange(len(own)), own] = -2
        near = np.argpartition(-dots, wide - 1, axis=1)[:, :wide] if wide else np.zeros((len(own), 0), int)
        order = np.argsort(-np.take_along_axis(dots, near, axis=1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        far = 1 - np.take_along_axis(dots, near, axis=1)
        between = 1 - np.einsum("qcd,qed->qce", rows[near], rows[near])
        open_ = np.ones(near.shape, bool)
        lines = np.arange(len(own))
        for k in range(min(near_most if n > settings.degree else settings.degree, wide)):
            some = open_.any(axis=1)
            pick_ = open_.argmax(axis=1)
            out[own[some], k] = near[some, pick_[some]]
            open_ &= settings.alpha * between[lines, pick_] > far
            open_[lines, pick_] = False
    return out


def _edges(dealt: DataFrame, settings: Settings) -> DataFrame:
    """Adjacency of each vector, united over its shards: ``group, neighbours``."""

    def build(part: pa.Table) -> pa.Table:
        group, rows = part.column("group").to_numpy(), _matrix(part.column("v").combine_chunks())
        graph = pruned_graph(rows, settings)
        a, k = np.nonzero(graph >= 0)
        b = graph[a, k]
        both = np.concatenate((a, b)), np.concatenate((b, a))  # links lead either way
        return pa.table({"group": group[both[0]], "neighbour": group[both[1]]})

    built = dealt.groupBy("label", "dim", "shard", "block").applyInArrow(build, "group long, neighbour long")
    return built.groupBy("group").agg(F.collect_set("neighbour").alias("neighbours"))


# Search.


def range_search(rows: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of query and row within the range: greedy search from the medoid, then expansion.

    All queries step together. Each keeps the ``width`` nearest rows it has seen and looks at the
    neighbours of the nearest one not yet looked at; rows within the range are looked at too.
    """
    n, q = len(rows), len(queries)
    most = min(2 * settings.degree, max((len(x) for x in graph), default=0))
    table = np.full((n, most), -1)
    for i, x in enumerate(graph):
        if len(x) > most:  # united lists are cut again: the nearest, and some far ones
            order = np.argsort(-(rows[x] @ rows[i]), kind="stable")
            x = x[np.concatenate((order[: most - settings.far], order[-settings.far :]))]
        table[i, : len(x)] = x
    medoid = int((rows @ rows.mean(axis=0)).argmax())
    seen = np.zeros((q, n), bool)
    done = np.zeros((q, n), bool)
    near = np.full((q, n), -2.0)  # of rows seen
    seen[:, medoid] = True
    near[:, medoid] = queries @ rows[medoid]
    beam = np.full((q, settings.width), -1)
    beam[:, 0] = medoid
    active = np.arange(q)
    while len(active):
        own = beam[active]
        value = np.where(own >= 0, near[active[:, None], own], -3.0)
        value[done[active[:, None], own] & (own >= 0)] = -3.0
        best = value.argmax(axis=1)
        go = value[np.arange(len(active)), best] > -3.0
        active, node = active[go], own[go, best[go]]
        if not len(active):
            break
        done[active, node] = True
        next_ = table[node]
        line, k = np.nonzero((next_ >= 0) & ~seen[active[:, None], next_])
        who, new = active[line], next_[line, k]
        seen[who, new] = True
        near[who, new] = np.einsum("ij,ij->i", queries[who], rows[new])
        # The beam holds the nearest seen rows.
        merged = np.concatenate((beam[active], np.where(next_ >= 0, next_, -1)), axis=1)
        score = np.where(merged >= 0, near[active[:, None], merged], -3.0)
        order = np.argsort(-score, axis=1, kind="stable")
        merged, score = np.take_along_axis(merged, order, axis=1), np.take_along_axis(score, order, axis=1)
        twice = np.zeros(merged.shape, bool)
        for back in range(1, 4):  # a row that came in again stands beside itself
            twice[:, back:] |= (merged[:, back:] == merged[:, :-back]) & (merged[:, back:] >= 0)
        order = np.argsort(twice, axis=1, kind="stable")[:, : settings.width]
        beam[active] = np.take_along_axis(np.where(twice, -1, merged), order, axis=1)
    # Range expansion: what is within the range leads to its neighbours, until nothing new is.
    front = (near >= settings.similarity - 0.01) & ~done
    while front.any():
        who, node = np.nonzero(front)
        done[who, node] = True
        next_ = table[node]
        line, k = np.nonzero(next_ >= 0)
        who, new = who[line], next_[line, k]
        fresh = ~seen[who, new]
        who, new = who[fresh], new[fresh]
        seen[who, new] = True
        near[who, new] = np.einsum("ij,ij->i", queries[who], rows[new])
        front = (near >= settings.similarity - 0.01) & ~done
    return np.nonzero(near >= settings.similarity - 1e-6)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of paired rows, in double precision."""
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _searched(dealt: DataFrame, edges: DataFrame, settings: Settings) -> DataFrame:
    """Verified links ``a, b`` (each once, a above b) between groups of equal vectors."""
    # Every block of a shard's graph meets every block of the shard's vectors as queries.
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    holds = dealt.join(edges, "group", "left").withColumn("asking", every).withColumn("query", F.lit(False))
    asks = dealt.withColumnRenamed("block", "asking").withColumn("block", every).withColumn("query", F.lit(True))
    both = holds.unionByName(asks, allowMissingColumns=True)

    def search(part: pa.Table) -> pa.Table:
        asks = part.column("query").to_numpy()
        group, rows = part.column("group").to_numpy(), _matrix(part.column("v").combine_chunks())
        held, asked = np.flatnonzero(~asks), np.flatnonzero(asks)
        place = {g: i for i, g in enumerate(group[held].tolist())}
        lists = part.column("neighbours").take(pa.array(held)).to_pylist()
        graph = [np.array([place[x] for x in own or () if x in place], int) for own in lists]
        left, right = [], []
        for at in range(0, len(asked) if len(held) else 0, 512):
            own = asked[at : at + 512]
            q, r = range_search(_unit(rows[held]), graph, _unit(rows[own]), settings)
            a, b = own[q], held[r]
            hit = (group[a] != group[b]) & (cosine(rows[a], rows[b]) >= settings.similarity)
            left.append(np.maximum(group[a[hit]], group[b[hit]]))
            right.append(np.minimum(group[a[hit]], group[b[hit]]))
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *left]), "b": np.concatenate([none, *right])})

    return both.groupBy("label", "dim", "shard", "block", "asking").applyInArrow(search, "a long, b long").distinct()


def _compared(vectors: DataFrame, settings: Settings) -> DataFrame:
    """Links ``a, b`` as of ``_searched``, by comparing every block of a label with every other."""
    sizes = vectors.groupBy("label", "dim").agg(F.ceil(F.count("*") / (4 * settings.shard_rows)).cast("int").alias("blocks"))
    dealt = vectors.join(F.broadcast(sizes), ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("group"), "blocks").cast("int"))
    dealt = stage(dealt.select("label", "dim", "group", "v", "block", "blocks"))
    holds = dealt.withColumn("asking", F.explode(F.sequence("block", F.col("blocks") - 1))).withColumn("query", F.lit(False))
    asks = dealt.withColumn("asking", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), "asking"))).withColumn("query", F.lit(True))

    def compare(part: pa.Table) -> pa.Table:
        asks = part.column("query").to_numpy()
        group, rows = part.column("group").to_numpy(), _matrix(part.column("v").combine_chunks())
        held, asked = np.flatnonzero(~asks), np.flatnonzero(asks)
        unit, left, right = _unit(rows), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(asked), 512):
            q, r = np.nonzero(unit[asked[at : at + 512]] @ unit[held].T >= settings.similarity - 1e-6)
            a, b = asked[at + q], held[r]
            hit = (group[a] != group[b]) & (cosine(rows[a], rows[b]) >= settings.similarity)
            left.append(np.maximum(group[a[hit]], group[b[hit]]))
            right.append(np.minimum(group[a[hit]], group[b[hit]]))
        return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})

    return holds.unionByName(asks).groupBy("label", "dim", "block", "asking").applyInArrow(compare, "a long, b long").distinct()


def audit(vectors: DataFrame, links: DataFrame, settings: Settings) -> dict[tuple[int, int], list[float]]:
    """Of audited vectors that have links by brute force, the share of each one's in ``links``.

    By label and length. The vectors with the lowest hash are compared with all others, in blocks;
    four times as many each time, until ``linked`` have links or ``most_audited`` were compared.
    """
    size = settings.audited
    while True:
        shares = _shares(vectors, links, size, settings)
        if sum(map(len, shares.values())) >= settings.linked or size >= settings.most_audited:
            return shares
        size = min(4 * size, settings.most_audited)


def _shares(vectors: DataFrame, links: DataFrame, size: int, settings: Settings) -> dict[tuple[int, int], list[float]]:
    probes: dict[tuple[int, int], tuple[list[int], list[np.ndarray]]] = {}
    for r in vectors.orderBy(F.xxhash64("group", F.lit(1)), "group").limit(size).select("label", "dim", "group", "v").collect():
        groups, rows = probes.setdefault((r.label, r.dim), ([], []))
        groups.append(r.group)
        rows.append(np.array(r.v))
    shared = vectors.sparkSession.sparkContext.broadcast({k: (np.array(g), np.array(v)) for k, (g, v) in probes.items()})

    def compare(batches):
        for batch in batches:
            label, dim, group = (batch.column(x).to_numpy() for x in ("label", "dim", "group"))
            out: list[list] = [[], [], [], []]
            for (l, d), (probe, v) in shared.value.items():
                own = np.flatnonzero((label == l) & (dim == d))
                if len(own):
                    rows = _matrix(batch.column("v").take(pa.array(own)))
                    p, q = np.nonzero(_unit(v) @ _unit(rows).T >= settings.similarity - 1e-6)
                    hit = (probe[p] != group[own[q]]) & (cosine(v[p], rows[q]) >= settings.similarity)
                    p, other = probe[p[hit]], group[own[q[hit]]]
                    for column, values in zip(out, (np.full(len(p), l), np.full(len(p), d), p, other), strict=True):
                        column += values.tolist()
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["label", "dim", "probe", "other"])

    true = vectors.select("label", "dim", "group", "v").mapInArrow(compare, "label long, dim int, probe long, other long")
    true = true.withColumn("a", F.greatest("probe", "other")).withColumn("b", F.least("probe", "other"))
    seen = true.join(links.select("a", "b", F.lit(1).alias("found")), ["a", "b"], "left").groupBy("label", "dim", "probe")
    shares: dict[tuple[int, int], list[float]] = {}
    for r in seen.agg((F.count("found") / F.count("*")).alias("share")).collect():
        shares.setdefault((r.label, r.dim), []).append(r.share)
    return shares


def _mean(shares: dict[tuple[int, int], list[float]]) -> float | None:
    every = [x for own in shares.values() for x in own]
    return float(np.mean(every)) if every else None


def near_links(vectors: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, float | None]:
    """Links between different vectors, and the mean share found of an audited vector's links.

    None where no audited vector has a link, so that nothing is known.
    """
    for more in range(settings.tries):
        wider = replace(settings, overlap=settings.overlap * 2**more, width=settings.width * 2**more)
        dealt = stage(_in_blocks(stage(_dealt(vectors, centroids(vectors, wider), wider)), wider))
        links = stage(_searched(dealt, stage(_edges(dealt, wider)), wider))
        shares = audit(vectors, links, wider)
        recall = _mean(shares)
        if recall is None or recall >= settings.recall:
            break
    weak = [key for key, own in shares.items() if np.mean(own) < settings.recall]
    if weak:
        these = F.broadcast(vectors.sparkSession.createDataFrame(weak, "label long, dim int"))
        links = stage(links.union(_compared(vectors.join(these, ["label", "dim"]), settings)).distinct())
        recall = _mean(audit(vectors, links, settings))
    return links, recall


def near_duplicates(table: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``vec_id, n_links, component_id, kept, audited_recall`` per row of ``table(vec_id, embedding, label)``.

    Vectors link when their labels, of any type, are equal and not null, their lengths are equal,
    and their cosine is at least ``similarity``. Null and zero vectors and those with null or
    non-finite components, or without a label, link with nothing. Equal vectors of a label are one group:
    it counts all its rows as linked, without a list of pairs. ``audited_recall`` is null where no
    audited vector links with a different one. ``component_id`` is the smallest id
    that links reach; repeated ids are rows of their own that share a component only by links.
    An empty table gives no rows.
    """
    rows = pick(table, "vec_id", "embedding", "label").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    largest = F.array_max(F.transform("v", F.abs))
    fits = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (largest > 0)
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("row", F.monotonically_increasing_id())
    # A power of two changes no digit, and no square over- or underflows; zeros lose their sign.
    scale = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2("largest")), F.lit(-1022)).cast("double"))
    rows = rows.withColumn("largest", F.when(F.col("fits"), largest)).withColumn("scale", F.coalesce(scale, F.lit(1.0)))
    rows = rows.withColumn("v", F.transform("v", lambda x: x / F.col("scale") + 0.0)).drop("largest", "scale")
    rows = stage(rows.withColumn("size", F.size("v")).withColumn("same", F.sha2(F.array_join("v", ","), 256)))
    unlinked = rows.filter("not fits").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    member = rows.filter("fits")
    # Whole-number labels stand for themselves; others by a 64-bit hash in the search for links.
    whole = rows.schema["label"].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.col("label").cast("long") if whole else F.xxhash64("label")
    groups = member.groupBy("label", "same").agg(F.min("row").alias("group"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    groups = stage(groups)
    firsts = member.join(groups.select("group"), F.col("row") == F.col("group")).select(number.alias("label"), F.col("size").alias("dim"), "group", "v")
    links, recall = near_links(stage(firsts), settings)

    sizes = groups.select(F.col("group").alias("b"), "n")
    either = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = either.join(sizes, "b").groupBy("a").agg(F.sum("n").alias("beyond")).withColumnRenamed("a", "group")
    placed = groups.join(components(links), F.col("group") == F.col("v"), "left").withColumn("root", F.coalesce("root", "group"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(lowest, "root").join(linked, "group", "left")
    own = placed.select("label", "same", (F.col("n") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), "component_id")
    done = member.join(own, ["label", "same"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return done.union(unlinked).withColumn("audited_recall", F.lit(recall).cast("double"))
