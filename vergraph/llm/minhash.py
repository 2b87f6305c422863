"""Operator 4: near-duplicates by b-bit MinHash, confirmed on full sets.

A document's set holds the hashes of its distinct five-word shingles.  Equal
sets form one class, represented by its smallest doc_id; only classes go on.
128 minima per class give bands (candidates: classes that share one; at 85 % 25
bands of five, at 80 % 28 of four), and the two low bits of every minimum, packed into four longs (the
collision-corrected estimate of the similarity by bit counts).  A pair above
the threshold misses all bands with probability below 5e-7.

Candidates are confirmed in two rounds, so that large groups never need all
pairs:

1. every class against the smallest id of each of its bands;
2. where a band still holds several components, the members outside its largest
   one meet each other and those inside it, in pairs of chunks: first their
   signatures only, which leave the members that some estimate does not put five
   standard errors under the threshold; then their texts, whose full sets are
   compared across components.  Only links that join two components are sent on.

A pair is compared in the first band that it shares.  Every candidate pair
ends in one component, was compared on full sets, or was estimated far below.

Rows are told apart by an internal number, never by doc_id: a component is
named by its smallest doc_id, and exactly one of its rows, the first with that
id, is kept.  Repeated rows are one component; rows of one doc_id whose texts
differ are linked only if they are similar enough.

Nulls and empties: a null text, or one without words, has an empty set and is
its own component; so is a row with a null doc_id, and it is kept.  With fewer
than five words the whole sequence is the only shingle.
An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .kernels import NOT_SPACE, U64, Words, mix, ragged, slices
from .workspace import ship, stage, with_row_ids

SHINGLE, HASHES, MISS = 5, 128, 5e-7
#: Links need 100 * intersection >= 85 * union.
PERCENT = 85
_seeds = mix(np.arange(1, HASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_multiply, _add = _seeds | U64(1), mix(_seeds)
#: Standard error of the corrected estimate near the threshold, from 128 minima.
SIGMA = 0.038


def layout(percent: int) -> tuple[int, int]:
    """Bands, and rows of a band: the longest rows with which a pair at the
    threshold misses all bands with a probability below MISS."""
    s = percent / 100
    for rows in range(HASHES if s < 1 else 1, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-(s**rows))) if s < 1 else 1
        if bands * rows <= HASHES:
            return bands, rows
    raise ValueError(f"{HASHES} minima are too few to find pairs of similarity {s}")


def least_estimate(percent: int) -> float:
    """Five standard errors under the threshold."""
    equal = 0.25 + 0.75 * percent / 100
    return percent / 100 - 5 * max(SIGMA, math.sqrt(equal * (1 - equal) / HASHES) / 0.75)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row of a slice."""
    words = Words(data, off, NOT_SPACE)
    at, h = words.windows(k)
    bounds = np.searchsorted(words.row[at], np.arange(len(off)))
    out = []
    few = (words.count > 0) & (words.count < k)
    for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if few[row]:
            first = words.first[row : row + 2]
            out.append(words.prefix.ranges(first[:1], first[1:]))
        else:
            out.append(np.unique(h[a:b]))
    return out


def minima(s: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over a set."""
    low = np.full(HASHES, ~U64(0))
    for i in range(0, len(s), 2048):
        x = s[i : i + 2048]
        np.minimum(low, (_multiply[:, None] * x[None, :] + _add[:, None]).min(axis=1), out=low)
    return low


def low_bits(m: np.ndarray) -> np.ndarray:
    """Two low bits (of the mixed minimum) for each of 128 minima: four 64-bit words."""
    two = mix(m) & U64(3)
    shift = np.arange(0, 64, 2, dtype=U64)
    return np.bitwise_or.reduce(two.reshape(4, 32) << shift[None, :], axis=1)


def band_keys(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros(bands, U64)
    for i in range(rows):
        h = mix(h ^ m[: bands * rows].reshape(bands, rows)[:, i]) + U64(i + 1)
    return mix(h ^ (np.arange(bands, dtype=U64) << U64(32)))


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures (last axis: four words): equal
    lanes counted, one in four of the others being equal by chance."""
    x = a ^ b
    unequal = np.bitwise_count((x | (x >> U64(1))) & U64(0x5555555555555555)).sum(axis=-1)
    return (1 - unequal / HASHES - 0.25) / 0.75


def _signatures(shape: tuple[int, int]):
    def run(batches):
        for batch, data, off in slices(batches, "text"):
            n, d1, d2, bits, bands = [], [], [], [], []
            for s in shingle_sets(data, off):
                n.append(len(s))
                d1.append(int(s.sum(dtype=U64).view(np.int64)) if len(s) else 0)
                d2.append(int(mix(s ^ U64(0x5DEECE66D)).sum(dtype=U64).view(np.int64)) if len(s) else 0)
                if len(s):
                    m = minima(s)
                    bits.append(low_bits(m).view(np.int64).tolist())
                    bands.append(band_keys(m, *shape).view(np.int64).tolist())
                else:
                    bits.append([])
                    bands.append([])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("name"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bits, longs), pa.array(bands, longs)], ["doc_id", "name", "n_shingles", "d1", "d2", "bits", "bands"])

    return run


def _confirm(percent: int):
    """Rows (hub, member, text), hub's own row first in its group: the members
    whose full sets are similar enough to the hub's."""

    def run(batches):
        hub, own = None, None
        for batch, data, off in slices(batches, "text"):
            a, b = batch.column("hub").to_pylist(), batch.column("member").to_pylist()
            kept_a, kept_b = [], []
            for x, y, s in zip(a, b, shingle_sets(data, off), strict=True):
                if x == y:
                    hub, own = x, s
                    continue
                if hub != x:
                    continue  # the hub's text is gone
                if len(own) * 100 < percent * len(s) or len(s) * 100 < percent * len(own):
                    continue
                small, large = (own, s) if len(own) < len(s) else (s, own)
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[place] == small).sum())
                if 100 * both >= percent * (len(own) + len(s) - both):
                    kept_a.append(x)
                    kept_b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(kept_a, pa.int64()), pa.array(kept_b, pa.int64())], ["a", "b"])

    return run


#: Members that are compared with one copy of a hub's text.
FAN = 256


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of the pairs (hub, member), those whose full sets are similar enough: a, b."""
    fans = pairs.groupBy("hub").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fans"))
    members = pairs.join(fans, "hub").select("hub", F.pmod(F.xxhash64("member"), F.col("fans")).cast("int").alias("fan"), "member")
    hubs = fans.select("hub", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), F.col("hub").alias("member"))
    rows = members.union(hubs).join(texts.hint("merge"), F.col("member") == F.col("doc_id")).select("hub", "fan", "member", "text")
    rows = rows.repartition("hub", "fan").sortWithinPartitions("hub", "fan", F.col("hub") != F.col("member"))
    return rows.mapInArrow(_confirm(percent), "a long, b long")


#: Members of a band that one task compares with each other, or with as many others.
CHUNK = 1024


def candidates(i: int, other: np.ndarray, bits: np.ndarray, bands: np.ndarray, at: int, least: float) -> np.ndarray:
    """Of the members after ``i`` marked in ``other``, those that it may be similar
    to, and did not meet in a band before number ``at``."""
    near = i + 1 + np.flatnonzero(other)
    if len(near):
        near = near[similarity(bits[i], bits[near]) >= least]
    return near[(bands[near, :at] != bands[i, :at]).all(axis=1)] if len(near) else near


def likely_members(ids: np.ndarray, comps: np.ndarray, sides: np.ndarray, bits: np.ndarray, bands: np.ndarray, at: int, cross: bool, percent: int) -> np.ndarray:
    """The members that have a candidate in another component."""
    hit, least = np.zeros(len(ids), bool), least_estimate(percent)
    for i in range(len(ids) - 1):
        other = comps[i + 1 :] != comps[i]
        if cross:
            other &= sides[i + 1 :] != sides[i]
        near = candidates(i, other, bits, bands, at, least)
        hit[near] = True
        hit[i] |= len(near) > 0
    return ids[hit]


def joining_links(ids: list[int], comps: list[int], sides: list[int], bits: np.ndarray, bands: np.ndarray, at: int, cross: bool, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of band number ``at`` that join two components.
    With ``cross`` only pairs of different sides are compared."""
    n = len(ids)
    root = {c: c for c in comps}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    size = np.array([len(x) for x in sets])
    shingles, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    side, least = np.array(sides), least_estimate(percent)
    out = []
    for i in range(n - 1):
        mine = find(comps[i])
        other = np.array([find(c) != mine for c in comps[i + 1 :]])
        if cross:
            other &= side[i + 1 :] != side[i]
        near = candidates(i, other, bits, bands, at, least)
        if not len(near):
            continue
        if len(near) > 32:
            first, last = np.searchsorted(shingles, sets[i], "left"), np.searchsorted(shingles, sets[i], "right")
            both = np.bincount(owner[ragged(first, last - first)], minlength=n)[near]
        else:
            both = np.array([np.intersect1d(sets[i], sets[j], assume_unique=True).size for j in near])
        for j in near[100 * both >= percent * (size[i] + size[near] - both)].tolist():
            x, y = find(comps[i]), find(comps[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((ids[i], ids[j]))
    return out


GROUP = ("band", "lo", "hi")


def _meet(percent: int, texts: bool):
    """Rows sorted by (band, lo, hi).  With ``texts`` the joining links of each
    group (a, b), else the members with candidates (band, id)."""
    names = ["a", "b"] if texts else ["band", "id"]

    def pairs(found):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names)

    def run(batches):
        key, rows = None, []

        def found():
            if len(rows) < 2:
                return []
            ids, comps, sides, bits, bands, sets = zip(*rows, strict=True)
            bits, bands, cross = np.array(bits, np.int64).view(U64), np.array(bands, np.int64), key[1] != key[2]
            at = int(np.flatnonzero(bands[0] == key[0])[0])
            if texts:
                return joining_links(list(ids), list(comps), list(sides), bits, bands, at, cross, list(sets), percent)
            return [(key[0], int(x)) for x in likely_members(np.array(ids), np.array(comps), np.array(sides), bits, bands, at, cross, percent)]

        for batch, data, off in slices(batches, "text") if texts else ((b, None, None) for b in batches):
            out = []
            columns = [batch.column(c).to_pylist() for c in (*GROUP, "id", "comp", "side", "bits", "bands")]
            sets = shingle_sets(data, off) if texts else [None] * batch.num_rows
            for band, lo, hi, *row, s in zip(*columns, sets, strict=True):
                if (band, lo, hi) != key:
                    out += found()
                    key, rows = (band, lo, hi), []
                rows.append((*row, s))
            yield pairs(out)
        yield pairs(found())

    return run


def meetings(members: DataFrame) -> DataFrame:
    """band, lo, hi, side and the columns of ``members`` (band, id, comp), once for
    each group that a member of a band with several components meets in: members
    outside the band's largest component in pairs (lo, hi) of their chunks, and
    each of those chunks with each chunk of the largest one (hi < 0)."""
    sizes = members.groupBy("band", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("n", F.col("comp").alias("main"))).alias("top"), F.sum("n").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    chunks = [F.greatest(F.ceil(x / CHUNK), F.lit(1)).cast("int") for x in (F.col("all") - F.col("top.n"), F.col("top.n"))]
    rows = members.join(mixed.select("band", "top.main", chunks[0].alias("few"), chunks[1].alias("many")), "band").withColumn("inside", F.col("comp") == F.col("main"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("inside"), F.col("many")).otherwise(F.col("few"))).cast("int")
    rows = rows.withColumn("own", own)
    few, many = F.sequence(F.lit(0), F.col("few") - 1), F.sequence(F.lit(0), F.col("many") - 1)
    meet = F.when(F.col("inside"), F.transform(few, lambda i: F.struct(i.alias("lo"), (-1 - F.col("own")).alias("hi"), F.lit(-1).alias("side"))))
    outside = F.concat(
        F.transform(few, lambda i: F.struct(F.least(i, "own").alias("lo"), F.greatest(i, "own").alias("hi"), F.col("own").alias("side"))),
        F.transform(many, lambda j: F.struct(F.col("own").alias("lo"), (-1 - j).alias("hi"), F.col("own").alias("side"))),
    )
    return rows.withColumn("m", F.explode(meet.otherwise(outside))).select("band", "id", "comp", "m.lo", "m.hi", "m.side")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.  With
    ``row_col``, a column of different longs, that column comes first."""
    ship(docs.sparkSession)
    name, text = F.col(id_col).cast("long").alias("name"), F.col(text_col).alias("text")
    # ``doc_id`` is the row's number from here to the end
    rows = docs.select(F.col(row_col).alias("doc_id"), name, text) if row_col else with_row_ids(docs.select(name, text), "doc_id", "minhash-rows")
    signed = stage(rows.mapInArrow(_signatures(layout(percent)), "doc_id long, name long, n_shingles long, d1 long, d2 long, bits array<bigint>, bands array<bigint>"), "minhash-signed")
    full = signed.where("n_shingles > 0 and name is not null")
    first = F.min(F.struct("name", F.col("doc_id").alias("row"))).alias("first")
    classes = stage(full.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), first), "minhash-classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "n_shingles", "d1", "d2"), ["doc_id", "n_shingles", "d1", "d2"])
    bands = stage(reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band")), "minhash-bands")
    shared = bands.groupBy("band").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("band", "pivot")
    bands = stage(bands.join(shared, "band"), "minhash-shared")  # only bands of at least two classes
    near = stage(reps.select(F.col("doc_id").alias("id"), "bits", "bands").join(bands.select("id").distinct(), "id"), "minhash-near")
    # what is joined here grows with the corpus: always by shuffle, never by broadcast
    texts = stage(rows.select("doc_id", "text").join(near.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi"), "minhash-texts")
    least = least_estimate(percent)

    def estimate(pairs):
        """Pairs that the packed signatures don't rule out."""
        x, y = near.select(F.col("id").alias("hub"), F.col("bits").alias("x")), near.select(F.col("id").alias("member"), F.col("bits").alias("y"))
        unequal = F.lit(0)
        for i in range(4):
            d = F.col("x")[i].bitwiseXOR(F.col("y")[i])
            unequal = unequal + F.bit_count((d.bitwiseOR(F.shiftrightunsigned(d, 1))).bitwiseAND(F.lit(0x5555555555555555)))
        close = (1 - unequal / HASHES - 0.25) / 0.75 >= least
        return pairs.join(x, "hub").join(y, "member").where(close).select("hub", "member")

    tested = bands.where("id <> pivot").select(F.col("pivot").alias("hub"), F.col("id").alias("member")).distinct()
    links = stage(confirm(estimate(tested), texts, percent), "minhash-links")
    stars = stage(components(links), "minhash-stars")
    placed = bands.select("band", "id").join(stars, "id", "left").select("band", "id", F.coalesce("component", "id").alias("comp"))
    placed = stage(placed, "minhash-placed")
    likely = meetings(placed).join(near, "id").repartition(*GROUP).sortWithinPartitions(*GROUP, "id").mapInArrow(_meet(percent, False), "band long, id long").distinct()
    likely = stage(likely, "minhash-likely")
    met = meetings(placed.join(likely, ["band", "id"], "left_semi")).join(near, "id").join(texts.hint("merge"), F.col("id") == F.col("doc_id")).select(*GROUP, "id", "comp", "side", "bits", "bands", "text")
    met = stage(met.repartition(*GROUP).sortWithinPartitions(*GROUP, "id").mapInArrow(_meet(percent, True), "a long, b long"), "minhash-met")
    # the new links lie between components: only those, not their members, are joined
    for end in ("a", "b"):
        met = met.join(stars.select(F.col("id").alias(end), "component"), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    joined = components(met).select(F.col("id").alias("star"), F.col("component").alias("whole"))
    named = classes.join(stars, F.col("rep") == F.col("id"), "left").withColumn("star", F.coalesce("component", "rep")).join(joined, "star", "left")
    named = named.select("n_shingles", "d1", "d2", "first", F.coalesce("whole", "star").alias("component"))
    named = named.drop("first").join(named.groupBy("component").agg(F.min("first").alias("first")), "component")
    # members of a class, however many, are joined once, with their class
    out = full.join(named, ["n_shingles", "d1", "d2"]).select(F.col("doc_id").alias("row"), "name", "n_shingles", "first")
    alone = signed.where("n_shingles = 0 or name is null").select(F.col("doc_id").alias("row"), "name", "n_shingles", F.struct("name", F.col("doc_id").alias("row")).alias("first"))
    number = [F.col("row").alias(row_col)] if row_col else []
    return out.union(alone).select(*number, F.col("name").alias("doc_id"), "n_shingles", F.col("first.name").alias("component_id"), (F.col("first.row") == F.col("row")).alias("kept"))
