"""Near-duplicate texts with small edits.

Method: deletion-variant signatures. A text's set of five-word shingles gets
a signature of SEGMENTS * WIDTH symbols (one minimum hash each). Signatures
are cut into so few segments that one of them differs in at most one symbol
for similar texts; each segment is indexed once per symbol with that symbol
replaced by a wildcard, and equal variants of different texts are candidates,
verified exactly on the shingle sets.

Symbols are 32-bit minima rather than single bits: at a Jaccard similarity of
0.5 a quarter of all bits differ, so that no segment of bits is both selective
and almost equal. With 12 segments of 3 symbols a pair of similarity J has an
equal variant with probability 1 - (1 - J^3 - 3 J^2 (1-J))^12: 0.9998 at 0.5,
over 0.99999 from 0.6.

Scale: texts with equal shingle sets are one class before anything is paired.
A variant of at most BUCKET classes yields its pairs directly. Classes with a
variant of more, which comes of boilerplate or of a large family, are indexed
again with all but one symbol a wildcard, and a symbol of at most BUCKET of
them yields its pairs. Two of them that agree in no such symbol agree only in
crowded ones: classes with as many crowded symbols as any similar pair must
agree in go through an exact prefix filter (rarest shingles first). So no
bucket is truncated, and a pair is lost only by its signature: without an
equal variant at all (above), or agreeing in fewer symbols than 3.8 standard
deviations below the threshold's mean (probability 0.00004 at the threshold).
A part of the classes sends at most BUCKET + 1 rows of a key to the shuffle,
so that a variant of a tenth of all texts is no hot key; crowded keys come
back as one row each.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..session import arrow_map, discard, materialize, sweep
from .words import hashed_batch, mix, slices, window_hashes

SHINGLE, SEGMENTS, WIDTH, BUCKET, DOUBT = 5, 12, 3, 16, 0.02
ROWS_AT_ONCE, BROADCAST_KEYS, PLACES, SIEVE_BITS = 1 << 16, 2_000_000, 1 << 16, 1 << 28
_rng = np.random.default_rng(20240607)
XORS = _rng.integers(0, 2**64, SEGMENTS * WIDTH, dtype=np.uint64)
BASE_XOR, RADIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
ODDS = _rng.integers(0, 2**63, SEGMENTS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return window_hashes(*hashed_batch(batch.column(1).to_pylist()), SHINGLE)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        shingles, offsets = _shingles(batch)
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            continue
        starts = offsets[:-1][full]
        symbols = np.empty((len(full), len(ODDS)), dtype=np.int32)
        for k, (x, a) in enumerate(zip(XORS, ODDS)):
            symbols[:, k] = (np.minimum.reduceat((shingles ^ x) * a, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        c1, c2 = np.empty(len(full), dtype=np.int64), np.empty(len(full), dtype=np.int64)
        for i, d in enumerate(full):
            own = np.unique(shingles[offsets[d] : offsets[d + 1]])
            c1[i], c2[i] = int(own.sum(dtype=np.uint64).view(np.int64)), int(mix(own ^ BASE_XOR).sum(dtype=np.uint64).view(np.int64))
        flat = pa.array(symbols.ravel(), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * len(ODDS)), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), pa.array(c1), pa.array(c2), lists], ["id", "c1", "c2", "symbols"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, s): the shingle set."""
    for batch in slices(batches, 1):
        shingles, offsets = _shingles(batch)
        own = [np.unique(shingles[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        ends = np.zeros(len(own) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in own], out=ends[1:])
        flat = np.concatenate(own).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "s"])


def signatures(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, c1, c2, symbols) per text with words; c1, c2 identify its shingle set."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("text is not null and id is not null")
    return arrow_map(rows, _signed, "id bigint, c1 bigint, c2 bigint, symbols array<int>")


def _places(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place(batch.column(0), size))], ["place"])

    return run


def _place(ids: pa.Array, size: int) -> np.ndarray:
    return (mix(ids.to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(size - 1)).astype(np.int32)


def sieve(ids: DataFrame) -> Broadcast:
    """A table of bits, 16 or more for each of ids(id) and SIEVE_BITS at most: what it lets through are those ids and few others."""
    size = min(SIEVE_BITS, 1 << max(6, (16 * ids.count()).bit_length()))
    bits = np.zeros(size // 8, dtype=np.uint8)
    at = arrow_map(ids.select("id"), _places(size), "place int").toArrow()["place"].to_numpy()
    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return ids.sparkSession.sparkContext.broadcast(bits)


def _sifted(bits: Broadcast):
    """Rows whose id, the first column, the sieve lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            at = _place(batch.column(0), 8 * len(table))
            yield batch.filter(pa.array((table[at >> 3] >> (at & 7) & 1).astype(bool)))

    return run


def shingle_sets(df: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    """(id, s) for the texts whose id is in ids(id), and few others; no text is shuffled, however many the ids."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("text is not null and id is not null")
    chosen = _sifted(sieve(ids))
    return arrow_map(rows, lambda batches: _sets(chosen(batches)), "id bigint, s array<bigint>")


def _keys(symbols: np.ndarray, single: bool) -> np.ndarray:
    """One key for each symbol and row: that symbol alone, or its segment without it."""
    out, s = np.empty(symbols.shape, dtype=np.uint64), symbols.view(np.uint32).astype(np.uint64)
    for k in range(symbols.shape[1]):
        first = k - k % WIDTH
        h = np.full(len(s), k + 1, dtype=np.uint64) * RADIX
        for j in (k,) if single else (j for j in range(first, first + WIDTH) if j != k):
            h = mix(h ^ s[:, j]) * RADIX
        out[:, k] = mix(h)
    return out.view(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(ids, symbols, the rows) of many rows at once."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        held += [batch] if batch is not None and batch.num_rows else []
        if held and (batch is None or sum(b.num_rows for b in held) >= ROWS_AT_ONCE):
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield rows.column(0).to_numpy(), rows.column(1).flatten().to_numpy().reshape(rows.num_rows, -1), rows
            held = []


def _posts(single: bool, cap: int):
    """(id, symbols) -> (v, id): the keys of each row; of a key no more than cap + 1 rows of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, symbols, _ in _rows(batches):
            v, owner = _keys(symbols, single).ravel(), np.repeat(ids, symbols.shape[1])
            order = np.argsort(v, kind="stable")
            v, owner = v[order], owner[order]
            starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            place = np.arange(len(v)) - np.repeat(starts, np.diff(np.append(starts, len(v))))
            yield pa.RecordBatch.from_arrays([pa.array(v[place <= cap]), pa.array(owner[place <= cap])], ["v", "id"])

    return run


def _crowded(single: bool, keys: Broadcast, least: int):
    """Rows (id, symbols) of which at least ``least`` keys are among the given ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = keys.value
        for _, symbols, rows in _rows(batches):
            v = _keys(symbols, single)
            at = np.minimum(np.searchsorted(large, v), max(len(large) - 1, 0))
            yield rows.filter(pa.array((large[at] == v).sum(1) >= least))

    return run


def _halves(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The 32 upper bits of the set elements of all rows end to end, and where each row begins."""
    lists = batch.column(1)
    return (lists.flatten().to_numpy() >> 32).astype(np.int32), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def _loads(size: int):
    """(id, s) -> (place, n): elements of the part by their place in a table of ``size`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = np.zeros(size, dtype=np.int64)
        for batch in batches:
            loads += np.bincount(_halves(batch)[0].view(np.uint32) & np.uint32(size - 1), minlength=size)
        at = np.flatnonzero(loads)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(loads[at], pa.int64())], ["place", "n"])

    return run


def _prefixes(loads: Broadcast, share: float):
    """(id, s) -> (id, n, p, h): the elements that come first, those of the least loaded places before others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loads.value
        for batch in batches:
            h, offsets = _halves(batch)
            n = np.diff(offsets)
            owner = np.repeat(np.arange(len(n)), n)
            load = table[h.view(np.uint32) & np.uint32(len(table) - 1)]
            by = np.lexsort((h, load, owner))
            p = np.arange(len(h)) - offsets[:-1][owner]
            # an element that is alone in its place has no partner
            keep = (p < (n - np.ceil(n * share - 1e-9) + 1)[owner]) & (load[by] > 1)
            ids = batch.column(0).take(pa.array(owner[keep]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n[owner[keep]], pa.int32()), pa.array(p[keep], pa.int32()), pa.array(h[by][keep])], ["id", "n", "p", "h"])

    return run


def _prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Candidates (a, b) among sets(id, s): all pairs of the threshold, and others.

    Elements are ordered by how often they occur, rare ones first: any total
    order is right, and occurrences are counted in a table of PLACES hashed
    places, so that nothing is shuffled for it but the tables. Of two similar
    sets the shorter one's first n - ceil(2t/(1+t) n) + 1 and the longer one's
    first n - ceil(t n) + 1 share an element, at places that leave room for the
    overlap that t asks for. A set that is half boilerplate shows none of it in
    the short prefix, so a line that many texts share brings no pairs of its
    own. Elements are 32 bits here, and t is less by DOUBT for their sake.
    """
    t = threshold - DOUBT
    counted = arrow_map(sets, _loads(PLACES), "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    loads = np.zeros(PLACES, dtype=np.int64)
    for r in counted:  # PLACES rows at most
        loads[r["place"]] = r["n"]
    x = arrow_map(sets, _prefixes(sets.sparkSession.sparkContext.broadcast(loads), t), "id bigint, n int, p int, h int").alias("x")
    y = x.where(F.col("p") < F.col("n") - F.ceil(F.col("n") * F.lit(2 * t / (1 + t)) - 1e-9) + 1).alias("y")
    longer = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    near = F.col("x.n") * t <= F.col("y.n")
    room = F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p")) >= t / (1 + t) * (F.col("x.n") + F.col("y.n")) - 1e-9
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & longer & near & room)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _bucket_pairs(cap: int):
    """Rows (v, id) sorted by v -> (a, b): pairs of a bucket of at most cap rows; of a larger one (v, null) once."""

    def table(a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, dtype=np.int64)] * 2  # rows of a bucket that may go on; of one known to be too large the first cap + 1
        for batch in itertools.chain(batches, [None]):
            v, ids = held if batch is None else (np.concatenate(x) for x in zip(held, (batch.column(i).to_numpy() for i in range(2))))
            held = [v[:0], ids[:0]]
            if not len(v):
                continue
            starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            sizes = np.diff(np.append(starts, len(v)))
            if batch is not None:
                last = starts[-1]
                held = [v[last : last + cap + 1], ids[last : last + cap + 1]]
                starts, sizes = starts[:-1], sizes[:-1]
            a, b = [], []
            for n in np.unique(sizes[(sizes > 1) & (sizes <= cap)]).tolist():
                first = starts[sizes == n]
                for i in range(n):
                    for j in range(i + 1, n):
                        x, y = ids[first + i], ids[first + j]
                        a.append(np.minimum(x, y))
                        b.append(np.maximum(x, y))
            if a:
                a, b = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
                yield table(a[a < b], b[a < b])
            large = v[starts[sizes > cap]]
            if len(large):
                yield table(large, [None] * len(large))

    return run


def _met(rows: DataFrame, single: bool, cap: int) -> DataFrame:
    """(a, b) of the pairs of rows(id, symbols) in small buckets, and (key, null) of the crowded ones."""
    posts = arrow_map(rows.select("id", "symbols"), _posts(single, cap), "v bigint, id bigint")
    return materialize(arrow_map(posts.repartition("v").sortWithinPartitions("v"), _bucket_pairs(cap), "a bigint, b bigint"), "met")


def _with_crowded(rows: DataFrame, met: DataFrame, single: bool, least: int) -> DataFrame:
    """Rows (id, symbols) with at least ``least`` crowded keys. The keys are counted; few enough go to the workers, more are joined."""
    keys = met.where("b is null").select(F.col("a").alias("v"))
    if keys.count() <= BROADCAST_KEYS:
        large = np.array(sorted(r["v"] for r in keys.collect()), dtype=np.int64)
        if not len(large):
            return rows.select("id", "symbols").limit(0)
        return arrow_map(rows.select("id", "symbols"), _crowded(single, rows.sparkSession.sparkContext.broadcast(large), least), "id bigint, symbols array<int>")
    posts = arrow_map(rows.select("id", "symbols"), _posts(single, 1 << 40), "v bigint, id bigint")
    ids = posts.join(keys, "v", "left_semi").groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("id")
    return rows.select("id", "symbols").join(ids, "id", "left_semi")


def _compared(sets: DataFrame, pairs: DataFrame, short: bool) -> DataFrame:
    """(a, b, jaccard) of pairs(a, b); by halves of the hashes when short. Of texts given twice under an id the best."""
    s = F.transform("s", lambda x: F.shiftright(x, 32).cast("int")) if short else F.col("s")
    both = pairs.join(sets.select(F.col("id").alias("a"), s.alias("sa")), "a").join(sets.select(F.col("id").alias("b"), s.alias("sb")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("n"), (F.size("sa") + F.size("sb")).alias("m"))
    return counted.groupBy("a", "b").agg(F.max(F.col("n") / (F.col("m") - F.col("n"))).alias("jaccard"))


def class_links(df: DataFrame, key: str, text: str, threshold: float, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(members, links): members(id, rep) of every text with words; links(a, b, jaccard), a < b, between representatives.

    Links join different shingle sets of Jaccard similarity >= threshold.
    Null and wordless texts have no row; rows repeated under one id count once.
    Texts are read twice: for the signatures, and for the shingle sets of the
    classes that any candidate pair or the prefix filter needs.
    """
    signed = materialize(signatures(df, key, text), "signatures")
    heads = signed.groupBy("c1", "c2").agg(F.min(F.struct("id", "symbols")).alias("m"))
    heads = materialize(heads.select("c1", "c2", F.col("m.id").alias("id"), F.col("m.symbols").alias("symbols")), "heads")
    members = signed.select("id", "c1", "c2").join(heads.select("c1", "c2", F.col("id").alias("rep")), ["c1", "c2"]).select("id", "rep").distinct()
    members = materialize(members, "members")
    discard(signed)
    sweep(df.sparkSession)
    symbols = SEGMENTS * WIDTH
    least = max(1, math.ceil(symbols * threshold - 3.8 * math.sqrt(symbols * threshold * (1 - threshold))))
    first = _met(heads, False, bucket)
    sweep(df.sparkSession)
    crowded = materialize(_with_crowded(heads, first, False, 1), "crowded")
    second = _met(crowded, True, bucket)
    over = _with_crowded(crowded, second, True, least).select("id")
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    short = F.transform("symbols", lambda x: (F.pmod(x, F.lit(251)) - 125).cast("tinyint"))

    def plausible(some: DataFrame, rows: DataFrame) -> DataFrame:
        sides = [rows.select(F.col("id").alias(i), short.alias(f"s{i}")) for i in "ab"]
        return some.join(sides[0], "a").join(sides[1], "b").where(agree >= least).select("a", "b")

    met = first.where("b is not null").unionByName(second.where("b is not null")).distinct()
    pairs = materialize(plausible(met, heads), "pairs")
    over = materialize(over, "over")
    discard(heads, first, second)
    sweep(df.sparkSession)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(over).distinct()
    sets = materialize(shingle_sets(df, key, text, wanted), "sets")
    if not over.isEmpty():
        exact = _prefix_pairs(arrow_map(sets, _sifted(sieve(over)), "id bigint, s array<bigint>"), threshold)
        pairs = materialize(pairs.unionByName(plausible(exact, crowded)).distinct(), "pairs")
    discard(crowded)
    sweep(df.sparkSession)
    # half a hash tells nearly every pair; what it leaves within DOUBT of the threshold is decided by whole ones
    half = materialize(_compared(sets, pairs, True).where(F.col("jaccard") >= threshold - DOUBT), "links")
    sweep(df.sparkSession)
    doubt = half.where(F.abs(F.col("jaccard") - threshold) <= DOUBT)
    whole = _compared(sets, doubt.select("a", "b"), False).where(F.col("jaccard") >= threshold)
    return members, half.where(F.col("jaccard") > threshold + DOUBT).unionByName(whole)


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.8, bucket: int = BUCKET) -> DataFrame:
    """Every pair (doc_id_a, doc_id_b), smaller id first, of similarity >= threshold, copies included."""
    members, links = class_links(df, key, text, threshold, bucket)
    crowded = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    copies = members.join(crowded, "rep")
    within = copies.alias("x").join(copies.alias("y"), "rep").where("x.id < y.id").select(F.col("x.id").alias("doc_id_a"), F.col("y.id").alias("doc_id_b"))
    links = links.select("a", "b")
    across = links.join(members.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a").join(members.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b")
    across = across.select(F.least("ia", "ib").alias("doc_id_a"), F.greatest("ia", "ib").alias("doc_id_b"))
    return within.unionByName(across)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of each node of edges(a, b): root is the least id of its connected component.

    Alternating large-star and small-star steps; each is a combinable minimum
    and a join, and the edge list is written to the shared folder in between.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before, old = None, []
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialize(small.where("u <> v").distinct(), "star")
        discard(*old)
        old = [e]
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if before == tuple(now):
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = tuple(now)


def version_groups(df: DataFrame, key: str, text: str, threshold: float = 0.8, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, class_id, group_id, n_links): group_id is the least id of the chained versions, n_links counts links of the class."""
    members, links = class_links(df, key, text, threshold, bucket)
    links = materialize(links.select("a", "b"), "links")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    roots = components(links).select(F.col("id").alias("rep"), "root")
    out = members.join(degree, "rep", "left").join(roots, "rep", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
