"""Near-duplicate embeddings by NN-descent.

1. Equal vectors of a label form one node. Random hyperplanes put the nodes of a label into small leaves, a few
   trees over; each leaf compares its nodes, and every node starts with a list of its nearest ones.
2. Descent: the members of a node's neighbourhood (its list, a sample of the nodes that list it, and itself) are
   compared with each other where that neighbourhood meets, and pairs better than the end of a list enter it.
   Rounds go on until few lists change.
3. Pairs at or above the threshold are edges. A list that is full of edges is saturated: it may have cut some off,
   inside its component and outside. All members of a component with a saturated list are therefore compared with
   every other node of the label that the triangle inequality cannot rule out, and components that meet are one.
4. Inside a component members are compared block by block with matrix products, which yields each node's number of
   links without a row per pair.
5. Audit: nodes drawn from each label are compared with all nodes of the label, in blocks. Recall is a mean over
   sampled nodes that link with another node, each counting once; nodes of saturated components and others are
   judged apart, and the lower mean counts. Labels short of the wanted recall, and labels whose sample, if not the
   whole label, holds no such node, are open: descent goes on with longer lists and a larger sample. Labels still
   open after the last try are compared as a whole, block by block.

All similarities are cosines in double precision. Vectors of different length are never compared.

Defined results: rows without label, or whose vector is null, empty, zero or holds null or non-finite components,
have no link, are their own component and are kept; a row without id has a null component and is kept; equal
rows link with each other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.columns import columns_of
from scoreloom.llm.graph import components
from scoreloom.sources.scratch import settle

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Descent:
    """``leaf``: nodes a leaf holds at most. ``rounds``: rounds run at least; more follow while the lists change by
    ``still`` or more. ``audit``: nodes of a label expected in the first sample, four times as many in each later try.
    ``block``: nodes of a component compared at once."""

    threshold: float = 0.93
    neighbours: int = 10
    trees: int = 5
    leaf: int = 256
    rounds: int = 2
    still: float = 0.02
    audit: int = 512
    recall: float = 0.98
    tries: int = 4
    block: int = 1024


def usable(v: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(ok & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes_of(rows: DataFrame) -> DataFrame:
    """(key, label, dim, vec, rep, copies): one row per label and vector."""
    return rows.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).select(
        F.xxhash64("label", "vec").alias("key"), "label", F.size("vec").alias("dim"), "vec", "rep", "copies")


def leaves(nodes: DataFrame, how: Descent, seed: int) -> DataFrame:
    """(tree, label, dim, leaf, part, key, vec): every node once per tree."""
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("n") / (how.leaf / 2))), F.lit(0)), F.lit(60)).cast("int")
    known = nodes.join(sizes.select("label", "dim", bits.alias("bits")), ["label", "dim"]).select("label", "dim", "key", "vec", "bits")
    trees = how.trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x, b = matrix(part.column(3)), part.column(4).to_numpy()
                for t in range(trees):
                    plane = np.random.default_rng([seed, t, int(d)]).standard_normal((int(d), 60))
                    side = (x @ plane[:, : max(1, int(b.max()))]) > 0
                    side &= np.arange(side.shape[1])[None, :] < b[:, None]
                    code = (side.astype(np.int64) << np.arange(side.shape[1])[None, :]).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), t, np.int32)), part.column(0), part.column(1), pa.array(code), part.column(2), part.column(3)],
                                                     names=["tree", "label", "dim", "leaf", "key", "vec"])

    label_type = dict(nodes.dtypes)["label"]
    vec_type = dict(nodes.dtypes)["vec"]
    coded = known.mapInArrow(run, f"tree int, label {label_type}, dim int, leaf long, key long, vec {vec_type}")
    parts = coded.groupBy("tree", "label", "dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / how.leaf).alias("parts"))
    return coded.join(parts, ["tree", "label", "dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64("key", "tree"), F.col("parts"))).drop("parts")


LISTS = "u long, l array<struct<s:double,v:long>>"


def _lists(keys: np.ndarray, s: np.ndarray, k: int) -> pa.Array:
    """The ``k`` best columns of each row of a similarity matrix, as arrays of (s, v); -inf is no pair."""
    k = min(k, s.shape[1])
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    val = np.take_along_axis(s, top, axis=1)
    ok = np.isfinite(val)
    flat = pa.StructArray.from_arrays([pa.array(np.round(val[ok], 9)), pa.array(keys[top[ok]])], names=["s", "v"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ok.sum(axis=1))]).astype(np.int32)), flat)


def merged(lists: DataFrame, how_many: int) -> DataFrame:
    best = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("l"))), asc=False), 1, how_many)
    return lists.groupBy("u").agg(best.alias("l"))


def start(nodes: DataFrame, how: Descent, k: int, seed: int) -> DataFrame:
    def compare(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        x = matrix(table.column("vec"))
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        return pa.table({"u": pa.array(keys), "l": _lists(keys, s, k) if len(keys) > 1 else pa.array([[]], pa.list_(pa.struct([("s", pa.float64()), ("v", pa.int64())])))})

    got = leaves(nodes, how, seed).groupBy("tree", "label", "dim", "leaf", "part").applyInArrow(compare, LISTS)
    return merged(got, k)


def descend(lists: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One round. Returns the new lists with ``changed``."""
    fwd = lists.select(F.col("u").alias("w"), F.explode("l.v").alias("m"))
    indegree = fwd.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    back = fwd.join(indegree, "m").filter(F.pmod(F.xxhash64("w", "m"), F.lit(1_000_003)) * F.col("n") < 1_000_003 * k).select(F.col("m").alias("w"), F.col("w").alias("m"))
    own = lists.select(F.col("u").alias("w"), F.col("u").alias("m"))
    worst = lists.select(F.col("u").alias("m"), F.when(F.size("l") >= k, F.get("l", F.size("l") - 1)["s"]).otherwise(-2.0).alias("worst"))
    near = fwd.union(back).union(own).distinct().join(worst, "m").join(nodes.select(F.col("key").alias("m"), "vec"), "m")
    near = near.select("w", "m", "worst", "vec").repartition("w").sortWithinPartitions("w")

    def meet(m: np.ndarray, worst: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        s[s <= worst[:, None]] = -np.inf
        return m, _lists(m, s, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(t: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            w = t.column("w").to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(w)) + 1, [len(w)]]) if len(w) else np.zeros(1, np.int64)
            end = len(cut) - 1 if last else len(cut) - 2
            u, ls = [], []
            if end > 0:
                m, worst = t.column("m").to_numpy(), t.column("worst").to_numpy()
                vec = t.column("vec").combine_chunks().slice(0, int(cut[end]))
                x = matrix(vec) if len(pc.unique(pc.list_value_length(vec))) == 1 else None  # lengths differ between neighbourhoods only
                for a, b in zip(cut[:end].tolist(), cut[1 : end + 1].tolist(), strict=True):
                    if b - a > 1:
                        i, o = meet(m[a:b], worst[a:b], x[a:b] if x is not None else matrix(vec.slice(a, b - a)))
                        u.append(i)
                        ls.append(o)
            out = [pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.concat_arrays(ls)], names=["u", "l"])] if u else []
            return out, t.slice(int(cut[max(end, 0)]))

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None and len(rest) else t
            out, rest = groups(t, False)
            yield from (b.filter(pc.greater(pc.list_value_length(b.column(1)), 0)) for b in out)
        if rest is not None and len(rest):
            out, _ = groups(rest, True)
            yield from (b.filter(pc.greater(pc.list_value_length(b.column(1)), 0)) for b in out)

    found = near.mapInArrow(run, LISTS)
    both = lists.select("u", "l", F.lit(True).alias("old")).union(found.select("u", "l", F.lit(False)))
    best = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("l"))), asc=False), 1, k)
    return both.groupBy("u").agg(best.alias("l"), F.max(F.when(F.col("old"), F.col("l"))).alias("was")).select("u", "l", F.size(F.array_except("l", "was")).alias("changed"))


def edges_of(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of the lists at or above the threshold. List values are rounded, so pairs next to the threshold
    are computed again from their vectors."""
    near = lists.select(F.col("u").alias("a"), F.explode("l").alias("e")).select("a", F.col("e.v").alias("b"), F.col("e.s").alias("s"))
    close = near.filter(F.abs(F.col("s") - threshold) <= 1e-8).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = close.join(nodes.select(F.col("key").alias("a"), F.col("vec").alias("x")), "a").join(nodes.select(F.col("key").alias("b"), F.col("vec").alias("y")), "b").select("a", "b", "x", "y", F.size("x").alias("d"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(4).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                s = (matrix(part.column(2)) * matrix(part.column(3))).sum(axis=1)
                yield pa.RecordBatch.from_arrays(list(part.filter(pa.array(s >= threshold)).columns[:2]), names=["a", "b"])

    return near.filter(F.col("s") > threshold + 1e-8).select("a", "b").union(met.mapInArrow(judge, "a long, b long"))


def paired(members: DataFrame, how: Descent, *carried: str) -> DataFrame:
    """Members dealt into pairs of blocks (of, i, j) of their component; small components share a bin."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / how.block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    bins = max(1, math.ceil((sizes.filter("blocks = 1").agg(F.sum("n")).first()[0] or 0) / how.block))
    part = F.pmod(F.xxhash64("key", F.lit(5)), F.col("blocks")).cast("int")
    small = F.array(F.struct(F.lit(None).cast("long").alias("of"), F.pmod(F.xxhash64("component"), F.lit(bins)).cast("int").alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")))
    large = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.col("component").alias("of"), F.least(F.col("part"), o).alias("i"), F.greatest(F.col("part"), o).alias("j"),
        F.when(F.col("part") < o, 0).when(F.col("part") > o, 1).otherwise(2).alias("side")))
    placed = members.join(sizes, "component").withColumn("part", part)
    names = ["key", "component", *carried, "vec"]
    return placed.select(*names, F.explode(F.when(F.col("blocks") == 1, small).otherwise(large)).alias("t")).select(*names, "t.*")


def links(members: DataFrame, how: Descent) -> DataFrame:
    """(key, links): exact links of each node within its component. ``members``: key, component, copies, vec."""
    rows = paired(members, how, "copies")
    limit = how.threshold

    def compare(table: pa.Table) -> pa.Table:
        key, comp, copies, side = (table.column(c).to_numpy() for c in ("key", "component", "copies", "side"))
        got, links = [], []
        for c in np.unique(comp):
            at = np.flatnonzero(comp == c)
            x = matrix(table.column("vec").take(pa.array(at)))
            one, two = np.flatnonzero(side[at] != 1), np.flatnonzero(side[at] != 0)
            s = (x[one] @ x[two].T) >= limit
            within = bool((side[at] == 2).all())
            if within:
                np.fill_diagonal(s, True)
                got.append(key[at])
                links.append(s @ copies[at] - 1)
            else:
                got += [key[at][one], key[at][two]]
                links += [s @ copies[at][two], copies[at][one] @ s]
        got, links = np.concatenate(got), np.concatenate(links)
        return pa.table({"key": pa.array(got), "links": pa.array(links.astype(np.int64))})

    return rows.groupBy("of", "i", "j").applyInArrow(compare, "key long, links long").groupBy("key").agg(F.sum("links").alias("links"))


def whole_edges(members: DataFrame, how: Descent) -> DataFrame:
    """(a, b): edges that join just the nodes that all edges between members of one ``component`` join."""
    limit = how.threshold

    def compare(table: pa.Table) -> pa.Table:
        key, comp, side = (table.column(c).to_numpy() for c in ("key", "component", "side"))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for c in np.unique(comp):
            at = np.flatnonzero(comp == c)
            x = matrix(table.column("vec").take(pa.array(at)))
            one, two = np.flatnonzero(side[at] != 1), np.flatnonzero(side[at] != 0)
            s = (x[one] @ x[two].T) >= limit
            root = np.arange(len(at))
            while True:  # the least node that edges of this pair of blocks lead to
                was = root.copy()
                np.minimum.at(root, one, np.where(s, root[two][None, :], len(at)).min(axis=1, initial=len(at)))
                np.minimum.at(root, two, np.where(s, root[one][:, None], len(at)).min(axis=0, initial=len(at)))
                if (root == was).all():
                    break
            tied = np.flatnonzero(root != np.arange(len(at)))
            a.append(key[at][tied])
            b.append(key[at][root[tied]])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return paired(members, how).groupBy("of", "i", "j").applyInArrow(compare, "a long, b long")


def outside(crowd: DataFrame, nodes: DataFrame, how: Descent) -> DataFrame:
    """(a, b): an edge for each node that lies within the threshold of a part of another component of ``crowd``.

    ``crowd``: key, component, label, dim, vec; ``nodes``: the same of every node. Members of a component are dealt
    into balls of at most ``block`` nodes. A node whose angle to a ball's centre exceeds the radius and the
    threshold's angle together has no edge into the ball; every other node is compared with the ball's members.
    """
    label_type, vec_type = dict(nodes.dtypes)["label"], dict(nodes.dtypes)["vec"]
    reach = math.acos(how.threshold) + 1e-6
    sizes = crowd.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / how.block).alias("balls"))
    hosts = settle(crowd.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("key", F.lit(7)), F.col("balls")).cast("int")).drop("balls"))

    def ball(table: pa.Table) -> pa.Table:
        x = matrix(table.column("vec"))
        c = x.mean(axis=0)
        c = c / np.linalg.norm(c) if c.any() else x[0]
        return table.slice(0, 1).select(["component", "part", "label", "dim"]).append_column("centre", pa.array([c.tolist()], pa.list_(pa.float64()))).append_column(
            "radius", pa.array([float(np.arccos(np.clip((x @ c).min(), -1, 1)))]))

    balls = settle(hosts.groupBy("component", "part").applyInArrow(ball, f"component long, part int, label {label_type}, dim int, centre array<double>, radius double"))
    pages = balls.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / how.block).cast("int").alias("pages"))
    dealt = nodes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / (4 * how.block)).cast("int").alias("chunks")).join(pages, ["label", "dim"])
    met = nodes.join(dealt, ["label", "dim"]).select(
        "label", "dim", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"), F.pmod(F.xxhash64("key", F.lit(8)), F.col("chunks")).cast("int").alias("chunk"),
        "key", "component", F.lit(None).cast("int").alias("part"), F.lit(None).cast("double").alias("radius"), F.col("vec").cast("array<double>").alias("vec"))
    met = met.union(balls.join(dealt, ["label", "dim"]).select(
        "label", "dim", F.pmod(F.xxhash64("component", "part"), F.col("pages")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)),
        F.lit(None).cast("long"), "component", "part", "radius", "centre"))

    def reached(table: pa.Table) -> pa.Table:
        host = table.column("part").is_valid()
        n, b = table.filter(pc.invert(host)), table.filter(host)
        if not len(n) or not len(b):
            return pa.table({"key": pa.array([], pa.int64()), "component": pa.array([], pa.int64()), "part": pa.array([], pa.int32())})
        far = np.arccos(np.clip(matrix(n.column("vec")) @ matrix(b.column("vec")).T, -1, 1)) > b.column("radius").to_numpy()[None, :] + reach
        i, j = np.nonzero(~far & (n.column("component").to_numpy()[:, None] != b.column("component").to_numpy()[None, :]))
        return pa.table({"key": n.column("key").take(pa.array(i)), "component": b.column("component").take(pa.array(j)), "part": b.column("part").take(pa.array(j))})

    near = settle(met.groupBy("label", "dim", "page", "chunk").applyInArrow(reached, "key long, component long, part int"))
    slices = near.groupBy("component", "part").agg(F.ceil(F.count(F.lit(1)) / how.block).cast("int").alias("slices"))
    guests = near.join(slices, ["component", "part"]).join(nodes.select("key", "vec"), "key").select(
        "component", "part", F.pmod(F.xxhash64("key", F.lit(9)), F.col("slices")).cast("int").alias("slice"), F.lit(True).alias("guest"), "key", "vec")
    home = hosts.join(slices, ["component", "part"]).select("component", "part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(False).alias("guest"), "key", "vec")
    limit = how.threshold

    def joined(table: pa.Table) -> pa.Table:
        guest = table.column("guest")
        g, h = table.filter(guest), table.filter(pc.invert(guest))
        if not len(g) or not len(h):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        s = matrix(g.column("vec")) @ matrix(h.column("vec")).T
        best = s.argmax(axis=1)
        ok = np.flatnonzero(s[np.arange(len(s)), best] >= limit)
        return pa.table({"a": g.column("key").take(pa.array(ok)), "b": h.column("key").take(pa.array(best[ok]))})

    return guests.union(home).groupBy("component", "part", "slice").applyInArrow(joined, "a long, b long")


def crowds(lists: DataFrame, tied: DataFrame, threshold: float, k: int) -> DataFrame:
    """(component): those with a saturated list, that is one of ``k`` edges."""
    full = lists.filter((F.size("l") >= k) & (F.get("l", F.size("l") - 1)["s"] >= threshold - 1e-8)).select("u")
    return full.join(tied, F.col("u") == F.col("v")).select(F.col("c").alias("component")).distinct()


def true_links(nodes: DataFrame, sizes: DataFrame, how: Descent, wanted: int) -> DataFrame:
    """(key, label, dim, true, linked): links of some ``wanted`` nodes of each label of ``sizes`` (label, dim, n), all
    nodes of smaller labels, by comparison with all nodes of the label; whether another node is among them."""
    chunk = F.pmod(F.xxhash64("key", F.lit(8)), F.col("chunks")).cast("int")
    dealt = nodes.join(sizes.withColumn("chunks", F.ceil(F.col("n") / (4 * how.block)).cast("int")), ["label", "dim"])
    asked = dealt.filter(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1_000_003)) * F.col("n") < 1_000_003 * wanted)
    names = ["label", "dim", "chunk", "asked", "key", "copies", "vec"]
    rows = dealt.withColumn("chunk", chunk).withColumn("asked", F.lit(False)).select(*names).union(
        asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("asked", F.lit(True)).select(*names))
    limit, block = how.threshold, how.block

    def compare(table: pa.Table) -> pa.Table:
        q, t = table.filter(table.column("asked")), table.filter(pc.invert(table.column("asked")))
        key, copies = t.column("key").to_numpy(), t.column("copies").to_numpy()
        true, linked = np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        if len(q) and len(t):
            x = matrix(t.column("vec"))
            for a in range(0, len(q), block):
                some = q.slice(a, block)
                own = some.column("key").to_numpy()[:, None] == key[None, :]
                s = (matrix(some.column("vec")) @ x.T) >= limit
                true[a : a + block], linked[a : a + block] = (s | own) @ copies, (s & ~own).any(axis=1)
        return q.select(["key", "label", "dim"]).append_column("n", pa.array(true)).append_column("linked", pa.array(linked))

    label_type = dict(nodes.dtypes)["label"]
    found = rows.groupBy("label", "dim", "chunk").applyInArrow(compare, f"key long, label {label_type}, dim int, n long, linked boolean")
    return found.groupBy("key", "label", "dim").agg((F.sum("n") - 1).alias("true"), F.max("linked").alias("linked"))


def verdicts(truth: DataFrame, sizes: DataFrame, per: DataFrame, wanted: int) -> DataFrame:
    """(label, dim, n, recall) of ``sizes``. ``per``: key, links, crowded. Recall is null where no sampled node links
    with another one, and 1 if the sample was the whole label."""
    part = F.least("true", "links") / F.col("true")
    kinds = truth.filter("linked").join(per, "key").groupBy("label", "dim", "crowded").agg(F.avg(part).alias("recall"))
    known = kinds.groupBy("label", "dim").agg(F.min("recall").alias("recall"))
    return sizes.join(known, ["label", "dim"], "left").select("label", "dim", "n", F.coalesce("recall", F.when(F.col("n") <= wanted, 1.0)).alias("recall"))


def settled(lists: DataFrame, nodes: DataFrame, k: int, total: int, how: Descent) -> DataFrame:
    """Rounds of descent until few lists change."""
    done = 0
    while True:
        new = settle(descend(lists, nodes, k))
        lists, done = new.select("u", "l"), done + 1
        if done >= how.rounds and (new.agg(F.sum("changed")).first()[0] or 0) <= how.still * k * total:
            return lists


def near_vectors(table: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", how: Descent = Descent()) -> DataFrame:
    """id, n_links, component_id, kept of every row."""
    rows = columns_of(table, id_col, vec, label).select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("vec"), F.col(label).alias("label"))
    rows = rows.withColumn("ok", usable(F.col("vec")) & F.col("label").isNotNull())
    nodes = settle(nodes_of(rows.filter("ok")))
    k, total = how.neighbours, nodes.count()
    open_ = settle(nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")))
    lists = settle(start(nodes, how, k, seed=1))

    def counts(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        tied = settle(components(edges))
        members = tied.select(F.col("v").alias("key"), F.col("c").alias("component")).join(nodes, "key")
        return tied, members, settle(links(members.select("key", "component", "copies", "vec"), how))

    for attempt in range(how.tries):
        lists = settled(lists, nodes, k, total, how)
        edges = settle(edges_of(lists, nodes, how.threshold))
        near = settle(components(edges))
        crowded = settle(crowds(lists, near, how.threshold, k))
        placed = settle(nodes.join(near, F.col("key") == F.col("v"), "left").select("key", F.coalesce("c", "key").alias("component"), "label", "dim", "vec"))
        if crowded.head(1):
            edges = settle(edges.union(outside(placed.join(crowded, "component"), placed, how)))
        tied, members, counted = counts(edges)
        wanted = how.audit * 4**attempt
        crowd = placed.join(crowded.withColumn("crowded", F.lit(True)), "component", "left").select("key", F.coalesce("crowded", F.lit(False)).alias("crowded"))
        per = nodes.select("key", "copies").join(crowd, "key").join(counted, "key", "left").select("key", "crowded", F.coalesce("links", F.col("copies") - 1).alias("links"))
        judged = settle(verdicts(true_links(nodes, open_, how, wanted), open_, per, wanted))
        open_ = judged.filter(F.coalesce(F.col("recall") < how.recall, F.lit(True))).select("label", "dim", "n")
        left, least_recall = judged.agg(F.count_if(F.coalesce(F.col("recall") < how.recall, F.lit(True))), F.min("recall")).first()
        log.info("after try %d, %d labels open, least recall %s", attempt + 1, left, least_recall)
        if not left:
            break
        if attempt + 1 < how.tries:
            k *= 2
            lists = settle(merged(lists.union(start(nodes, how, k, seed=attempt + 2)), k))
    else:
        ids = nodes.join(open_, ["label", "dim"]).groupBy("label", "dim").agg(F.min("key").alias("component"))
        tied, members, counted = counts(settle(edges.union(whole_edges(nodes.join(ids, ["label", "dim"]).select("key", "component", "vec"), how))))
    least = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    per = nodes.select("key", "rep", "copies").join(tied.select(F.col("v").alias("key"), F.col("c").alias("component")), "key", "left").join(least, "component", "left").join(counted, "key", "left").select(
        "key", F.coalesce("links", F.col("copies") - 1).alias("links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.withColumn("key", F.when(F.col("ok"), F.xxhash64("label", "vec"))).join(per, "key", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
