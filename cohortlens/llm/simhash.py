"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at ``max_distance`` differing bits or fewer. The bits
are grouped into partitions, correlated ones together, so that some partitions
tell documents apart better than others. If partition i may differ in t_i bits
(-1: it is not used) and the (t_i + 1) add up to ``max_distance`` + 1, then two
linked fingerprints differ in at most t_i bits in some partition. Each
fingerprint picks its own thresholds: dynamic programming over the partitions
finds those with the fewest estimated candidates, from counts of the partitions'
values. It probes all values within its thresholds, and every candidate is
verified on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import drop_stored, longs_again, longs_as_text, stored
from cohortlens.llm.components import connected_components

BITS = 64
SEED = 42
# Counts are kept of this many bits of a partition at most, so their tables are bounded.
COUNTED_BITS = 16
# How far apart in their order fingerprints are linked before any is probed; all others are found by the probes.
NEIGHBOURS = 8


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text's word shingles, repeats included; zero without a word."""
    import xxhash

    # Bytes split and fold exactly at ASCII white space and A-Z, as the contract has it.
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        some = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64)
            yield batch.drop(columns="text").assign(fp=found.view(np.int64))

    return run


def _pair_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each pair of bits is set together, for a task's fingerprints."""
    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        fps = batch["fp"].to_numpy().view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(fps, axis=1, bitorder="little").astype(np.float64)
        total += (bits.T @ bits).astype(np.int64)
    yield pd.DataFrame({"cell": np.arange(BITS * BITS), "n": total.ravel()})


def group_bits(together: np.ndarray, n: int, partitions: int) -> list[list[int]]:
    """Bits in groups of nearly equal size; each group takes the bits most correlated with it."""
    p = together / max(n, 1)
    mean = np.diag(p)
    spread = np.sqrt(np.clip(mean * (1 - mean), 1e-12, None))
    tied = np.abs((p - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    left, groups = set(range(BITS)), []
    for g in range(partitions):
        size = BITS // partitions + (g < BITS % partitions)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (tied[b, rest].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: tied[b, group].sum())
            group.append(best)
            left.discard(best)
        groups.append(group)
    return groups


def gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint as one number, the first bit lowest."""
    fps = fps.view(np.uint64)
    out = np.zeros(len(fps), np.int64)
    for to, bit in enumerate(bits):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << to
    return out


def _masks(width: int, most: int) -> np.ndarray:
    """All masks of ``width`` bits with ``most`` bits set or fewer."""
    return np.array(
        [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(width), k)], np.int64
    )


def candidate_costs(counts: np.ndarray, width: int, most: int) -> np.ndarray:
    """costs[u, v]: probes and estimated candidates of value v when u - 1 bits may differ; none for u = 0.

    ``counts`` are of the lowest bits; where the partition is wider, its values are
    taken to be spread evenly over the others.
    """
    counted = min(width, COUNTED_BITS)
    costs = np.zeros((most + 2, 1 << counted))
    values = np.arange(1 << counted)
    # by_bits[k]: how many fingerprints differ in k of the counted bits
    by_bits = np.zeros((most + 1, 1 << counted))
    for mask in _masks(counted, most):
        by_bits[int(mask).bit_count()] += counts[values ^ mask]
    from math import comb

    uncounted = width - counted
    for u in range(1, most + 2):
        for k in range(u):
            within = sum(comb(uncounted, j) for j in range(min(u - 1 - k, uncounted) + 1))
            costs[u] += by_bits[k] * within / 2**uncounted
        costs[u] += len(_masks(width, u - 1))
    return costs


def allocate(costs: list[np.ndarray], values: list[np.ndarray], most: int) -> np.ndarray:
    """u[i, row]: bits + 1 that partition i may differ in; they add up to ``most`` + 1 at least cost."""
    rows, need = len(values[0]), most + 1
    best = np.full((need + 1, rows), np.inf)
    best[0] = 0
    picks = []
    for cost, value in zip(costs, values):
        each = cost[:, value & (cost.shape[1] - 1)]
        options = np.full((need + 1, need + 1, rows), np.inf)
        for total in range(need + 1):
            for u in range(total + 1):
                options[total, u] = best[total - u] + each[u]
        pick = options.argmin(axis=1)
        best = np.take_along_axis(options, pick[:, None], axis=1)[:, 0]
        picks.append(pick)
    left = np.full(rows, need)
    out = np.zeros((len(costs), rows), np.int64)
    for i in range(len(costs) - 1, -1, -1):
        out[i] = picks[i][left, np.arange(rows)]
        left = left - out[i]
    return out


def _partitions_for(n: int, most: int) -> int:
    """The number of partitions with the least work for ``n`` evenly spread fingerprints.

    All numbers give the same links.
    """

    def work(m: int) -> float:
        width, u = BITS // m, divmod(most + 1, m)
        probes = [len(_masks(width, u[0] + (i < u[1]) - 1)) for i in range(m) if u[0] + (i < u[1])]
        return sum(p * (1 + n / 2**width) for p in probes)

    return min(range(2, most + 2), key=work) if most else 1


def _plan(fps: DataFrame, max_distance: int, partitions: int | None) -> tuple[list[list[int]], list[np.ndarray]]:
    """The groups of bits, and what each value of a group costs to probe.

    Nothing that grows with the input reaches the driver: 64 x 64 counts of bit
    pairs, and counts of at most 2**16 values of each partition.
    """
    n = fps.count()
    m = partitions or _partitions_for(n, max_distance)
    cells = fps.mapInPandas(_pair_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    together = np.zeros(BITS * BITS)
    for r in cells.collect():
        together[r["cell"]] = r["n"]
    groups = group_bits(together.reshape(BITS, BITS), n, m)
    low = (1 << COUNTED_BITS) - 1
    seen = _index(fps, groups).groupBy("part", F.col("value").bitwiseAND(F.lit(low)).alias("v")).count()
    counts = [np.zeros(1 << min(len(g), COUNTED_BITS)) for g in groups]
    for r in seen.collect():
        counts[r["part"]][r["v"]] = r["count"]
    return groups, [candidate_costs(c, len(g), max_distance) for c, g in zip(counts, groups)]


def _index(fps: DataFrame, groups: list[list[int]]) -> DataFrame:
    """``fps`` once for each group of bits: part and value."""

    def value(bits: list[int]):
        shifted = [F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1)), to) for to, b in enumerate(bits)]
        out = shifted[0]
        for s in shifted[1:]:
            out = out.bitwiseOR(s)
        return out.cast("long")

    return fps.select("*", F.posexplode(F.array(*[value(g) for g in groups])).alias("part", "value"))


def _probes(fps: DataFrame, groups: list[list[int]], costs: list[np.ndarray], max_distance: int) -> DataFrame:
    """(part, value, probe, ...): the values that each fingerprint probes, with the other longs of ``fps``."""
    shared = fps.sparkSession.sparkContext.broadcast((groups, costs))
    others = [c for c in fps.columns if c != "fp"]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups, costs = shared.value
        masks = [[_masks(len(g), u - 1) if u else None for u in range(max_distance + 2)] for g in groups]
        for batch in batches:
            for at in range(0, len(batch), 4096):
                some = {c: batch[c].to_numpy()[at : at + 4096] for c in ["fp", *others]}
                values = [gather(some["fp"], g) for g in groups]
                for part, us in enumerate(allocate(costs, values, max_distance)):
                    for u in range(1, max_distance + 2):
                        rows = us == u
                        if rows.any():
                            around = masks[part][u]
                            yield pd.DataFrame(
                                {
                                    "part": np.int32(part),
                                    "value": (values[part][rows][:, None] ^ around).ravel(),
                                    "probe": np.repeat(some["fp"][rows], len(around)),
                                    **{c: np.repeat(some[c][rows], len(around)) for c in others},
                                }
                            )

    more = "".join(f", {c} long" for c in others)
    return fps.mapInPandas(probe, f"part int, value long, probe long{more}")


def link_fingerprints(
    fingerprints: DataFrame, *, max_distance: int = 3, partitions: int | None = None
) -> DataFrame:
    """(a, b): all pairs a > b of the distinct longs in ``fp`` that differ in ``max_distance`` bits or fewer.

    Their number grows with the square of a dense group; :func:`spanning_links` does not.
    """
    fps = fingerprints.select("fp")
    groups, costs = _plan(fps, max_distance, partitions)
    near = F.expr(f"probe > fp AND bit_count(probe ^ fp) <= {int(max_distance)}")
    return (
        _probes(fps, groups, costs, max_distance)
        .join(_index(fps, groups).hint("merge"), ["part", "value"])
        .filter(near)
        .select(F.col("probe").alias("a"), F.col("fp").alias("b"))
    )


def _neighbour_links(index: DataFrame, max_distance: int) -> DataFrame:
    """(a, b): near pairs at most ``NEIGHBOURS`` apart in the order of part, value and fingerprint.

    A range of that order is a task's, so a value that very many share is spread. Pairs
    across two ranges are left to the probes.
    """

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = np.zeros(0, np.int64)
        for batch in batches:
            fps = np.concatenate([tail, batch["fp"].to_numpy()])
            for lag in range(1, min(NEIGHBOURS, len(fps) - 1) + 1):
                a, b = fps[lag:], fps[:-lag]
                near = (np.bitwise_count((a ^ b).view(np.uint64)) <= max_distance) & (a != b)
                near[: max(len(tail) - lag, 0)] = False  # the batch before had these
                yield pd.DataFrame({"a": a[near], "b": b[near]})
            tail = fps[-NEIGHBOURS:]

    order = ["part", "value", "fp"]
    return index.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(link, "a long, b long")


def spanning_links(
    fingerprints: DataFrame, *, max_distance: int = 3, partitions: int | None = None
) -> DataFrame:
    """(a, b): pairs of :func:`link_fingerprints`, in either order, that join the same groups as all of them.

    First, neighbours in the order of each partition's values are linked and grouped: in
    a dense group these few links join nearly all of it. Then the probes are made. A
    value's main group is the one most of its fingerprints are in. Members of it meet
    only the others there, so the pairs inside it, whose number grows with its square,
    are neither made nor compared. Of the pairs that meet, those of two groups are
    verified on all bits.
    """
    spark = fingerprints.sparkSession
    fps = fingerprints.select("fp")
    groups, costs = _plan(fps, max_distance, partitions)
    first = stored(_neighbour_links(_index(fps, groups), max_distance), "neighbours")
    labels = connected_components(first).withColumnRenamed("node", "fp")
    labelled = stored(
        fps.join(labels, "fp", "left").select("fp", F.coalesce("component", "fp").alias("c")), "labelled"
    )
    index = _index(labelled, groups)
    sizes = index.groupBy("part", "value", "c").count()
    main = stored(sizes.groupBy("part", "value").agg(F.max_by("c", F.struct("count", "c")).alias("main")), "main")
    met = _probes(labelled, groups, costs, max_distance).join(main, ["part", "value"])
    met = stored(met.withColumnRenamed("c", "d"), "probes")
    others = index.join(main, ["part", "value"]).filter("c <> main").drop("main")
    pairs = [
        met.filter("d <> main").join(index.hint("merge"), ["part", "value"]),
        met.filter("d = main").join(others.hint("merge"), ["part", "value"]),
    ]
    near = F.expr(f"probe > fp AND c <> d AND bit_count(probe ^ fp) <= {int(max_distance)}")
    apart = [p.filter(near).select(F.col("probe").alias("a"), F.col("fp").alias("b")) for p in pairs]
    links = stored(first.unionByName(apart[0]).unionByName(apart[1]), "links")
    for table in (first, labelled, main, met):
        drop_stored(spark, table)
    return links


def simhash_components(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = 3,
    max_distance: int = 3,
    partitions: int | None = None,
) -> DataFrame:
    """(doc_id, fp, class_size, component_id) of every row of ``docs``.

    ``fp`` is the fingerprint as a signed long, and ``class_size`` the number of rows
    that have it. ``component_id`` is the smallest doc_id that links reach, the
    document itself included; null ids count only where a component has no other.
    A null text, or one without a word, has fingerprint zero, which links like any
    other. Equal fingerprints are one node, so copies are never expanded into pairs, and
    of a dense group's near pairs only some that span it are made.
    Rows are kept one for one, and an empty table gives an empty one.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    carried = longs_as_text(rows, ["doc_id"])
    kind = carried.schema["doc_id"].dataType.simpleString()
    found = carried.mapInPandas(_fingerprints(shingle), f"doc_id {kind}, fp long")
    prints = stored(longs_again(found, rows), "prints")
    classes = stored(
        prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("class_size")), "classes"
    )
    labels = connected_components(
        spanning_links(classes, max_distance=max_distance, partitions=partitions)
    ).withColumnRenamed("node", "fp")
    classes = classes.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    # One row for each fingerprint, written, so that the join can split a hot one.
    known = stored(classes.join(smallest, "component").select("fp", "class_size", "component_id"), "known")
    return prints.join(known, "fp").select("doc_id", "fp", "class_size", "component_id")
