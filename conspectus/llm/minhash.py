"""Near-duplicate classes by DartMinHash, banded joining and exact checks.

Each text is the weighted set of its five-word shingles, weight = number of occurrences. Darts are thrown into the
weighted regions: each unit of weight of a shingle receives, in order of rank, a Poisson stream of darts made from
its hash, each with a coordinate; a fractional last unit keeps the darts that fall under its height. About
``k ln k + 2k`` darts of least rank reach a text, whatever its size, and each coordinate keeps its earliest. Two
texts agree in a coordinate with the probability of their weighted Jaccard similarity.

Bands of ``rows`` coordinates are keys; the texts with an equal key are a run. Every member of a run is paired with
the run's centre, its member with most companions, and each distinct pair is checked exactly on shingle multisets:
this joins most of a group at a cost in proportion to its size. What a run still holds apart is then compared
exactly with all its members of other classes, so no two texts that share a key are left unchecked unless their
classes are joined already; this costs the members outside a run's largest class times the run, in blocks. Classes
are the connected components of the links of at least ``threshold``; they do not depend on the number of partitions.
Exact copies are one node from the start. Two texts of similarity 0.8 share none of the 20 keys with a chance of 3e-5.

Defined results: null and empty texts are one class; a text under five words is one shingle of all its words;
equal texts always share a class; rows with equal ids are told apart by their text; the class id is the least id
of the class (null only if all are null); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, free_names, small_batches, written
from .tokens import WORDS, mix, occurrence, per_text, slices, string_bytes, text_shingles, tokenise

K = 80
ROWS = 4
SHINGLE = 5
THRESHOLD = 0.8

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_minhash(values: np.ndarray, weights: np.ndarray, k: int = K) -> np.ndarray:
    """Signature (k uint64) of the weighted set of distinct 64-bit ``values``; zeros if it has no weight."""
    units = np.ceil(weights).astype(np.int64)
    layer = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    seed = mix(np.repeat(values, units) + layer.astype(np.uint64) * _GOLD)
    height = np.minimum(1.0, np.repeat(weights, units) - layer)
    mass = float(weights.sum())
    if mass <= 0:
        return np.zeros(k, np.uint64)
    least = np.full(k, np.inf)
    winner = np.zeros(k, np.uint64)
    limit = (k * np.log(k) + 2 * k) / mass
    while True:
        live, rank, n = np.arange(len(seed)), np.zeros(len(seed)), 0
        ranks, marks = [], []
        while len(live):  # the n-th dart of each unit's stream, as long as its rank is under the limit
            n += 1
            h = mix(seed[live] ^ np.uint64(n * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(_uniform(h))
            under = rank <= limit
            live, rank, h = live[under], rank[under], h[under]
            falls = _uniform(mix(h + np.uint64(1))) <= height[live]
            ranks.append(rank[falls])
            marks.append(h[falls])
        r, m = np.concatenate(ranks), np.concatenate(marks)
        coordinate = (mix(m + np.uint64(2)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((m, r))[::-1]  # the earliest is written last
        least[coordinate[order]] = r[order]
        winner[coordinate[order]] = mix(m[order] + np.uint64(3))
        if np.isfinite(least).all():
            return winner
        limit *= 2


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = len(signature) // rows
    parts = signature[: bands * rows].reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + parts[:, j])
    return out


def numbered(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of occurrence-numbered shingles: weighted Jaccard of texts is plain Jaccard of these."""
    raw = np.frombuffer(data, np.uint8)
    sh = text_shingles(tokenise(raw, np.array([0, len(raw)]), WORDS)[2], size)
    return np.sort(mix(sh + occurrence(sh).astype(np.uint64) * _GOLD)) if len(sh) else sh


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(a) + len(b) - shared)


def signatures(df: DataFrame, text_col: str, keep: tuple[str, ...], k: int = K, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """``keep`` and bands (array of 64-bit keys, null without words); no shuffle."""
    small_batches(df.sparkSession)
    picked = df.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def made(batches):
        for batch in batches:
            raw, bounds = string_bytes(batch.column(len(keep)))
            bands = []
            for x, y in slices(bounds):
                own = bounds[x : y + 1] - bounds[x]
                starts, _, hashes = tokenise(raw[bounds[x] : bounds[y]], own, WORDS)
                at = per_text(starts, own)
                for i in range(y - x):
                    values, counts = np.unique(text_shingles(hashes[at[i] : at[i + 1]], size), return_counts=True)
                    signature = dart_minhash(values, counts.astype(np.float64), k) if len(values) else None
                    bands.append(None if signature is None else band_keys(signature, rows).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(bands, pa.list_(pa.int64()))], names=[*keep, "bands"])

    return picked.mapInArrow(made, f"{schema}, bands array<long>")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """Rows (node, pos, key, n) of the band keys that ``n`` > 1 nodes of (node, bands) have, written to the shared folder."""
    rows = nodes.where("bands is not null").select("node", F.posexplode("bands").alias("pos", "key"))
    # written, so that the join reads two plain exchanges and its hot keys can be split
    sizes = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    return written(rows.join(sizes, "key").select("node", "pos", "key", "n"), "shared")


def star_pairs(shared: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, n): each node b with the centre a of each of its runs, the run's size at most n.

    A run's centre is its member with most companions in all its runs, of equals the greatest number. Neighbours
    choose the same centres, so a group's members have few distinct partners whatever its size.
    """
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    centre = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("best"))
    centre = written(centre.select("key", F.col("best.node").alias("a")), "centres")
    return shared.join(centre, "key").where("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.max("n").alias("n"))


def shingle_sets(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(node, bands, set) of (node, bands, text): the sorted hashes of its numbered shingles."""

    def made(batches):
        for batch in batches:
            raw, bounds = string_bytes(batch.column(2))
            out = [numbered(raw[bounds[i] : bounds[i + 1]].tobytes(), size).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["node", "bands", "set"])

    return texts.select("node", "bands", "text").mapInArrow(made, "node long, bands array<long>, set binary")


def checked_links(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, each: int = 256) -> DataFrame:
    """Pairs (a, b, similarity) of at least ``threshold``, from pairs (a, b, n) and sets (node, set).

    A task streams runs of one left side: its shingles, then each partner's; it holds one left side at a time. The
    partners of a left side with many are dealt out, about ``each`` to a task.
    """
    sets = sets.select("node", "set")
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / each).cast("long")).cast("int").alias("slot"))
    left = dealt.select("a", "slot").distinct().join(sets, F.col("a") == F.col("node")).select("a", "slot", F.lit(None).cast("long").alias("b"), "set")
    right = dealt.join(sets, F.col("b") == F.col("node")).select("a", "slot", "b", "set")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = left.unionByName(right).repartition(parts, "a", "slot").sortWithinPartitions("a", "slot", F.col("b").asc_nulls_first())

    def check(batches):
        own = None
        for batch in batches:
            out = []
            data = batch.column(3)
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                found = np.frombuffer(data[i].as_buffer(), np.uint64)
                if b is None:
                    own = found.copy()
                elif min(len(own), len(found)) >= threshold * max(len(own), len(found)) - 1e-9:
                    s = jaccard(own, found)
                    if s >= threshold:
                        out.append((a, b, s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out]), pa.array([x[2] for x in out])], names=["a", "b", "similarity"])

    return runs.mapInArrow(check, "a long, b long, similarity double")


class _Held:
    """Members of a run, outside its most frequent class, that others are compared with."""

    def __init__(self):
        self.parts: list = []
        self.ready = None

    def add(self, node, root, bands, sets):
        self.parts.append((node, root, bands, sets))

    def arrays(self):
        if self.ready is None:
            sets = [x for p in self.parts for x in p[3]]
            lengths = np.array([len(x) for x in sets])
            self.ready = [np.concatenate([p[i] for p in self.parts]) for i in range(3)] + [np.concatenate(sets), lengths, np.cumsum(lengths) - lengths]
        return self.ready


def _shared(own: np.ndarray, values: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many entries of ``own`` each of the sorted sets values[first : first + length] has."""
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first, length)
    v = values[at]
    spot = np.searchsorted(own, v)
    spot[spot == len(own)] = 0
    return np.add.reduceat((own[spot] == v).astype(np.int64), np.cumsum(length) - length)


def run_links(shared: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, block: int = 1024, slot_rows: int = 1024) -> DataFrame:
    """Links (a, b) that join what runs still hold apart: every pair of a run's members with unlike roots is compared.

    shared: (node, pos, key, n); roots: (node, root) of linked nodes; sets: (node, bands, set). Members outside a run's
    most frequent root are held in blocks and meet every member, dealt out in slots. A pair is compared only in the
    first run that its ends share, exactly, and not at all once links of the same task have joined its classes.
    """
    placed = shared.join(roots, "node", "left").select("node", "pos", "key", "n", F.coalesce("root", "node").alias("root"))
    placed = written(placed, "placed")
    counted = placed.groupBy("key", "root").agg(F.count("*").alias("m"))
    mixed = counted.groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    blocks, slots = F.ceil((F.col("n") - F.col("top.m")) / block), F.ceil(F.col("n") / slot_rows)
    mixed = written(mixed.select("key", F.col("top.root").alias("top"), blocks.cast("int").alias("blocks"), slots.cast("int").alias("slots")), "mixed")
    member = placed.select("node", "pos", "key", "root").join(mixed, "key").join(sets, "node")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("node")), F.col(n)).cast("int")
    common = ("node", "root", "pos", "bands", "set")
    held = member.where("root <> top").select("key", part(1, "blocks").alias("block"), F.explode(every("slots")).alias("slot"), F.lit(0).alias("side"), *common)
    met = member.select("key", F.explode(every("blocks")).alias("block"), part(2, "slots").alias("slot"), F.lit(1).alias("side"), *common)
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = held.unionByName(met).repartition(parts, "key", "block", "slot").sortWithinPartitions("key", "block", "slot", "side", "node")

    def pairs(batches):
        now, own, joined = None, None, {}

        def top(r):
            while joined.get(r, r) != r:
                r = joined[r]
            return r

        for batch in batches:
            out = []
            key, block_, slot, side, node, root, pos = (batch.column(i).to_numpy() for i in range(7))
            bands = np.asarray(batch.column(7).flatten()).reshape(batch.num_rows, -1)
            sets_ = batch.column(8)
            for i in range(batch.num_rows):
                if now != (key[i], block_[i], slot[i]):
                    now, own, joined = (key[i], block_[i], slot[i]), _Held(), {}
                mine = np.frombuffer(sets_[i].as_buffer(), np.uint64)
                if side[i] == 0:
                    own.add(node[i : i + 1].copy(), root[i : i + 1].copy(), bands[i : i + 1].copy(), [mine.copy()])
                    continue
                if not own.parts:
                    continue
                n0, r0, b0, values, length, first = own.arrays()
                r = top(root[i])
                may = np.flatnonzero((r0 != r) & (np.minimum(length, len(mine)) >= threshold * np.maximum(length, len(mine)) - 1e-9))
                may = may[(b0[may] == bands[i]).argmax(1) == pos[i]]
                if not len(may):
                    continue
                both = _shared(mine, values, first[may], length[may])
                for j in may[both >= threshold * (length[may] + len(mine) - both)]:
                    if r0[j] != r:  # the two classes are one from now on
                        out.append((int(n0[j]), int(node[i])))
                        joined[int(r0[j])] = int(r)
                        r0[r0 == r0[j]] = r
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], names=["a", "b"])

    return runs.mapInArrow(pairs, "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node in links (a, b): root is the least node of its connected component.

    Alternates linking of larger and of smaller neighbours to the least one until nothing changes; each round is
    written to the shared folder. Groups are reduced to their least member, none is gathered.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        # written, so that joins read two plain exchanges and the hub of a large group can be split
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, edges = edges, written(small, "edges")
        forget(old, least, large, low)
        n, total = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (n, total) == before:
            break
        before = (n, total)
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, rows: int = ROWS, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, node and twin (two 64-bit numbers of its text), class_id (least id of the class) and kept.

    kept marks the class's representative: of the texts with the least id, the one of least number. Of unlike texts
    with one ``node`` (3e10 texts hold some 24 such pairs) only those with the least ``twin`` are looked for copies;
    the others are classes of equal texts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = df.select(F.col(id_col).alias("__id"), *numbers(text, "node", "twin"), text.alias("__text"))
    made = written(signatures(base, "__text", ("__id", "node", "twin"), k, rows, size), "signatures")
    nodes = made.groupBy("node").agg(F.min("twin").alias("twin"), F.min_by("bands", "twin").alias("bands"), F.min_by("__id", F.struct("twin", "__id")).alias("owner"))
    nodes = written(nodes, "nodes")
    shared = shared_keys(nodes)
    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("n"), F.col("twin").alias("t"), "owner", "bands")
    same = (base["node"] == F.col("n")) & (base["twin"] == F.col("t")) & base["__id"].eqNullSafe(F.col("owner"))
    texts = base.join(wanted, same).select("node", "bands", F.col("__text").alias("text"))
    sets = written(shingle_sets(texts, size).dropDuplicates(["node"]), "shingles")
    links = written(checked_links(star_pairs(shared), sets, threshold), "links").select("a", "b")
    roots = components(links)
    rest = written(run_links(shared, roots, sets, threshold), "rest")
    if not rest.isEmpty():
        roots = components(rest.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    # a text that is not its node's stands for itself, with its equals
    main = made.join(nodes.select("node", F.col("twin").alias("first")), "node").join(roots, "node", "left")
    own = F.col("twin") == F.col("first")
    placed = main.select("__id", "node", "twin", F.when(own, F.coalesce("root", "node")).otherwise(F.col("node")).alias("root"), F.when(~own, F.col("twin")).alias("apart"))
    placed = written(placed, "placed")
    # nulls rank last: a class has a null id only if all its ids are null
    named = placed.groupBy("root", "apart").agg(F.min(F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"), F.col("node").alias("node"), F.col("twin").alias("twin"))).alias("first"))
    named = written(named.select(F.col("root").alias("of"), F.col("apart").alias("of_apart"), "first"), "classes")
    forget(made, nodes, shared, sets, rest)
    met = placed.join(named, (F.col("root") == F.col("of")) & F.col("apart").eqNullSafe(F.col("of_apart")))
    kept = F.col("__id").eqNullSafe(F.col("first.id")) & (F.col("node") == F.col("first.node")) & (F.col("twin") == F.col("first.twin"))
    return met.select(F.col("__id").alias(id_col), "node", "twin", F.col("first.id").alias("class_id"), kept.alias("kept"))


def numbers(text: Column, node: str, twin: str) -> tuple[Column, Column]:
    """Two independent 64-bit numbers of a text."""
    return F.xxhash64(text).alias(node), F.xxhash64(F.lit("twin"), text).alias(twin)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that represent their class, whole; a row repeated with id and text stays once."""
    node, twin, own, own_node, own_twin = free_names(df, "__node", "__twin", "__own", "__own_node", "__own_twin")
    found = near_duplicates(df.select(id_col, text_col), id_col, text_col).where("kept")
    found = found.select(F.col(id_col).alias(own), F.col("node").alias(own_node), F.col("twin").alias(own_twin)).distinct()
    rows = df.select("*", *numbers(F.coalesce(F.col(text_col).cast("string"), F.lit("")), node, twin))
    same = (F.col(node) == F.col(own_node)) & (F.col(twin) == F.col(own_twin)) & F.col(id_col).eqNullSafe(F.col(own))
    return rows.join(found, same, "left_semi").dropDuplicates([id_col, node, twin]).drop(node, twin)


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "kept")
