"""Exact Jaccard self-join of word-shingle sets by partitions of the universe.

For sets r, s of Jaccard t = num/den or more, |r ^ s| (the elements in just
one of them) is at most (den - num) / (den + num) * (|r| + |s|). Sizes fall into bands;
the scheme of a band hashes the universe into m segments. Equal segments
cover one difference, segments equal up to one deletion cover two: with
segments for more than H differences, H the most that a pair of the band can
have, some segment of a similar pair must match. Each band's split into
segments of either kind is the one of least estimated cost. A set is indexed
in its own band's scheme and in those of lower bands that hold a possible
partner.

Empty segments and crowded index entries find too much. A similar pair
shares more than `slack` units of cover, so a set may leave out entries of up
to `slack` units in all, and the pair still meets elsewhere. Sets with more
empty segments than that are indexed in a coarser scheme besides; sets with
more crowded entries stay in them. Sets that crowded entries hold together
are compared with one leader; links between two of them are found by a join
of their rarest differences from it. Every link is verified on the sets.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.llm.components import components
from tidemark.session import settle, settle_table

U = np.uint64
#: Sets in an index entry that are all compared at once; more make it crowded.
CROWD = 8
#: Digests that a task remembers to send the entries of equal sets once.
KEPT = 400_000
#: Clusters with a member far from its leader that are broadcast (12 bytes each); more are joined by a shuffle.
MOST_OPEN = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9FB21C651E98DF25)
    x = (x ^ (x >> U(29))) * U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U(32))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct 64-bit hashes of its word shingles; one for the whole sequence if it is shorter.

    Words are runs of bytes other than ASCII space and controls 9-13; A-Z are
    lower-cased, no other letter. Each distinct word of the batch is hashed once.
    """
    import xxhash

    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = pc.ascii_split_whitespace(texts)
    at = np.asarray(words.offsets).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), U, len(coded.dictionary))
    w = known[np.asarray(coded.indices)]
    at, full, out = at - at[0], np.asarray(pc.not_equal(texts, "")), []
    runs = np.full(max(0, len(w) - width + 1), width, U)
    for i in range(width):
        runs = mix(runs + w[i : len(w) - width + 1 + i])
    for k in range(len(full)):
        a, n = at[k], at[k + 1] - at[k]
        if not full[k]:
            out.append(np.empty(0, U))
        elif n >= width:
            out.append(np.unique(runs[a : a + n - width + 1]))
        else:
            h = np.full(1, n, U)
            for i in range(n):
                h = mix(h + w[a + i : a + i + 1])
            out.append(h)
    return out


class Scheme:
    """Segments of one band of sizes low..high: x of them matched exactly, the other y up to one deletion."""

    def __init__(self, band: int, low: int, high: int, num: int, den: int):
        self.band, self.low, self.high = band, low, high
        self.most = high * (den - num) // num
        need, choices = self.most + 1, []
        for y in range(min(need, 16) + 1):  # more of them never pay: a deletion segment costs an entry per element
            spare = 1
            for _ in range(8):
                x = max(0, need + spare - 2 * y)
                m = max(1, x + y)
                empty = m * math.exp(-high / m) * ((x + 2 * y * (1 + high / m)) / m)
                spare = math.ceil(empty + 2 * math.sqrt(empty)) + 1 if y < need else 0
            if x + y >= 1 and x + 2 * y >= need:
                choices.append((x + y * (1 + (low + high) / 2 / m) + 3 * m * math.exp(-low / m), x, y))
        _, self.x, self.y = min(choices)
        self.m = self.x + self.y
        self.coarse = -(-need // 2)


@lru_cache
def schemes(num: int, den: int, largest: int = 1 << 31) -> tuple[Scheme, ...]:
    """Bands up to more shingles than a string can hold: under 64 of them, as `tag` needs."""
    out, low = [], 1
    while low <= largest:
        high = max(low, low * 3 // 2 - 1)
        out.append(Scheme(len(out), low, high, num, den))
        low = high + 1
    return tuple(out)


def of_size(n: int, num: int, den: int) -> list[Scheme]:
    """The schemes that a set of n elements is indexed in."""
    return [s for s in schemes(num, den) if s.low <= n and s.high * den >= num * n and s.most]


def tag(h: np.ndarray, scheme: Scheme, double: bool, coarse: bool) -> np.ndarray:
    """The entry's key: its low byte tells the band, whether it covers two differences, and the coarse scheme."""
    return (h & ~U(255)) | U(scheme.band | double << 6 | coarse << 7)


def parts(elements: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the segments that have any of the sorted elements: number, first position, size. A segment is a range of hashes."""
    seg = ((elements >> U(32)) * U(m)) >> U(32)
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    return seg[first], first, np.diff(np.r_[first, len(seg)])


def entries(elements: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index entries of a set, over all its schemes."""
    n, out = len(elements), []
    found = of_size(n, num, den)
    marks = mix(elements) if found else elements
    for s in found:
        seg, first, size = parts(elements, s.m)
        total, name = np.add.reduceat(marks, first), mix(seg + U(s.band << 32))
        exact = seg < s.x
        keys = [tag(mix(total + name)[exact], s, False, False)]
        empty = s.x - int(exact.sum())
        if s.y:
            keys += deletions(marks, total, name, size, ~exact, s, False)
            empty += 2 * (s.y - int((~exact & (size > 1)).sum()))
        if empty > slack(n, s, num, den):
            seg, first, size = parts(elements, s.coarse)
            total, name = np.add.reduceat(marks, first), mix(seg + U(s.band << 32 | 1 << 40))
            keys += deletions(marks, total, name, size, np.ones(len(seg), bool), s, True)
            missing = np.setdiff1d(np.arange(s.coarse, dtype=U), seg)
            keys.append(tag(mix(mix(missing + U(s.band << 32 | 1 << 40))), s, True, True))
        out += keys
    return np.unique(np.concatenate(out)) if out else np.empty(0, U)


def deletions(marks, total, name, size, use, s, coarse) -> list[np.ndarray]:
    """Keys of the segments in use, whole and with each element left out; a segment that is left empty only in the coarse scheme."""
    whole = tag(mix(total + name)[use], s, True, coarse)
    each = np.repeat(use & ((size > 1) | coarse), size)
    one = np.repeat(total, size)[each] - marks[each]
    return [whole, tag(mix(one + np.repeat(name, size)[each]), s, True, coarse)]


def slack(n: int, s: Scheme, num: int, den: int) -> int:
    """Units of cover that a set of n elements may leave out of scheme s."""
    most = min(s.most, (den - num) * (n + min(n, s.high)) // (den + num) if n > s.high else n * (den - num) // num)
    return s.x + 2 * s.y - most - 1


def empty_cover(elements: np.ndarray, s: Scheme) -> int:
    """Units of cover in empty segments, and in segments that a deletion may empty."""
    seg, _, size = parts(elements, s.m)
    return s.x - int((seg < s.x).sum()) + 2 * (s.y - int(((seg >= s.x) & (size > 1)).sum()))


def sketch(elements: np.ndarray) -> bytes:
    """Parities of the elements' counts by hash slot: two sets differ in at least as many elements as their sketches in bits."""
    bits = 1 << min(14, max(6, (2 * len(elements) - 1).bit_length()))
    odd = np.bincount((elements & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def spare_cover(elements: np.ndarray, num: int, den: int) -> dict[int, int]:
    """For each scheme of a set, its band and the cover that it may still leave out, empty segments taken off; band | 128 is the coarse scheme."""
    out = {}
    for s in of_size(len(elements), num, den):
        spare = slack(len(elements), s, num, den)
        out[s.band] = spare - empty_cover(elements, s)
        out[s.band | 128] = 2 * s.coarse - (s.x + 2 * s.y - spare)
    return out


def document_sets(docs: DataFrame, width: int, num: int, den: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, spare, sketch): size, 128-bit digest, spare cover and sketch of every document's set."""

    def work(batches):
        for piece in slices(batches):
            rows = []
            for e in shingle_sets(piece.column(1), width):
                d = hashlib.blake2b(e.tobytes(), digest_size=16).digest()
                rows.append((len(e), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), list(spare_cover(e, num, den).items()), sketch(e)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.int32(), pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_shingles", "hi", "lo", "spare", "sketch"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(work, "doc_id long, n_shingles long, hi long, lo long, spare map<int,int>, sketch binary")


def index(docs: DataFrame, width: int, num: int, den: int, text: str) -> DataFrame:
    """(entry, node): a task sends the entries of equal sets once, so copies don't crowd an entry."""

    def work(batches):
        sent: set[int] = set()
        for piece in slices(batches, 256):
            keys, nodes = [np.empty(0, U)], [np.empty(0, np.int64)]
            for e in shingle_sets(piece.column(0), width):
                node = int.from_bytes(hashlib.blake2b(e.tobytes(), digest_size=16).digest()[8:], "little", signed=True)
                if not len(e) or node in sent:
                    continue
                if len(sent) < KEPT:
                    sent.add(node)
                keys.append(entries(e, num, den))
                nodes.append(np.full(len(keys[-1]), node, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], ["entry", "node"])

    return docs.select(text).mapInArrow(work, "entry long, node long")


def meetings(batches):
    """From rows sorted by (entry, node): pairs of sets that share a small entry (entry is null), and the rows of crowded ones (b is null)."""
    key, node, crowded = np.empty(0, np.int64), np.empty(0, np.int64), None

    def result(a, b, e, no_b, no_e):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=no_b), pa.array(e, mask=no_e)], ["a", "b", "entry"])

    def settled(key, node):
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.r_[first, len(key)])
        a, b, e = [], [], []
        for g in range(2, CROWD + 1):
            at = first[size == g]
            if len(at):
                i, j = np.triu_indices(g, 1)
                a.append(node[at[:, None] + i].ravel())
                b.append(node[at[:, None] + j].ravel())
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.empty((0, 2), np.int64)
        big = np.repeat(size > CROWD, size)
        none = np.zeros(int(big.sum()), np.int64)
        e = np.r_[np.zeros(len(pairs), np.int64), key[big]]
        is_pair = np.r_[np.ones(len(pairs), bool), np.zeros(len(none), bool)]
        return result(np.r_[pairs[:, 0], node[big]], np.r_[pairs[:, 1], none], e, ~is_pair, is_pair)

    for batch in batches:
        key = np.r_[key, np.asarray(batch.column(0))]
        node = np.r_[node, np.asarray(batch.column(1))]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[new], node[new]
        if crowded is not None and len(key):  # rows that go on a crowded entry; the first stood in the batch before
            n = int(np.searchsorted(key, crowded, "right"))
            if n > 1:
                yield result(node[1:n], node[1:n], key[1:n], np.ones(n - 1, bool), np.zeros(n - 1, bool))
            if n < len(key):
                key, node, crowded = key[n:], node[n:], None
            else:
                key, node = key[-1:], node[-1:]
                continue
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1], "left"))
        if len(key) - last > CROWD:
            yield settled(key, node)
            crowded = key[-1]
            key, node = key[-1:], node[-1:]
        elif last:
            yield settled(key[:last], node[:last])
            key, node = key[last:], node[last:]
    if crowded is None and len(key):
        yield settled(key, node)


def bitmap(ids: DataFrame, bits: int, tasks: int = 8) -> np.ndarray:
    """A bit per hash of an id: `bits` in all, whatever the number of ids."""

    def work(batches):
        out = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = mix(np.asarray(b.column(0)).view(U)) % U(bits)
            np.bitwise_or.at(out, (at >> U(3)).astype(np.int64), np.left_shift(1, (at & U(7)).astype(np.uint8)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["bits"])

    total = np.zeros(bits // 8, np.uint8)
    for r in ids.coalesce(tasks).mapInArrow(work, "bits binary").collect():
        total |= np.frombuffer(r["bits"], np.uint8)
    return total


def needed_sets(docs: DataFrame, ids: DataFrame, count: int, width: int, doc_id: str, text: str) -> DataFrame:
    """(rep, n, elements): the sets of the documents in ids, and of a few more: a bitmap of bounded size chooses them."""
    bits = 1 << min(30, max(16, (count * 16).bit_length()))
    chosen = docs.sparkSession.sparkContext.broadcast(bitmap(ids, bits))

    def work(batches):
        have = chosen.value
        for piece in slices(batches):
            piece = piece.filter(pc.is_valid(piece.column(0)))
            ids = np.asarray(piece.column(0)).astype(np.int64)
            at = mix(ids.view(U)) % U(bits)
            want = np.flatnonzero(have[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8) & 1)
            sets = shingle_sets(piece.column(1).take(pa.array(want)), width)
            yield pa.RecordBatch.from_arrays([pa.array(ids[want]), pa.array([len(e) for e in sets], pa.int64()), pa.array([e.tobytes() for e in sets], pa.binary())], ["rep", "n", "elements"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(work, "rep long, n long, elements binary")


def plausible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) by rep from pairs (a, b) by node: those whose sizes and sketches allow a link."""

    def work(batches):
        for piece in slices(batches):
            n_a, n_b = (np.asarray(piece.column(i)) for i in (2, 3))
            most = (den - num) * (n_a + n_b) // (den + num)
            ok = [sketch_distance(x, y) <= m for x, y, m in zip(piece.column(4).to_pylist(), piece.column(5).to_pylist(), most, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in piece.columns[:2]], ["a", "b"])

    def side(c: str) -> DataFrame:
        return classes.select(F.col("lo").alias(c), F.col("rep").alias(f"rep_{c}"), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    return both.select("rep_a", "rep_b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(work, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets have den * intersection >= num * union."""

    def work(batches):
        for piece in slices(batches):
            a, b = ([np.frombuffer(x, U) for x in piece.column(i).to_pylist()] for i in (2, 3))
            ok = []
            for x, y in zip(a, b, strict=True):
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in piece.columns[:2]], ["a", "b"])

    right = sets.select(F.col("rep").alias("b"), F.col("elements").alias("set_b"))
    left = sets.select(F.col("rep").alias("a"), F.col("elements").alias("set_a"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b").mapInArrow(work, "a long, b long")


def differences(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(band, leader, rep, element, size, most, near): the elements in which a member differs from its cluster's leader.

    near: the two link. most: differences that a link of the member allows.
    A member equal to its leader gives no row.
    """
    own = sets.select("rep", F.col("elements").alias("mine"))
    led = sets.select(F.col("rep").alias("leader"), F.col("elements").alias("led"))
    rows = members.join(own, "rep").join(led, "leader").select("band", "leader", "rep", "mine", "led")

    def work(batches):
        for piece in slices(batches, 64):
            out: list[list] = [[], [], [], [], [], [], []]
            for band, leader, rep, mine, led in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                x, y = np.frombuffer(mine, U), np.frombuffer(led, U)
                d = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(d)) // 2
                near = den * both >= num * (len(x) + len(y) - both)
                most = len(x) * (den - num) // num
                n = len(d)
                for column, value in zip(out, (np.full(n, band), np.full(n, leader), np.full(n, rep), d.view(np.int64), np.full(n, n), np.full(n, most), np.full(n, near)), strict=True):
                    column.append(value)
            types = (np.int32, np.int64, np.int64, np.int64, np.int64, np.int64, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, t), *c]).astype(t)) for c, t in zip(out, types, strict=True)], ["band", "leader", "rep", "element", "size", "most", "near"])

    return rows.mapInArrow(work, "band int, leader long, rep long, element long, size long, most long, near boolean")


def crowded_members(crowded: DataFrame, classes: DataFrame) -> DataFrame:
    """(band, leader, rep) of the sets that crowded entries (entry, node) hold together: leaders included, entries within a set's slack left out.

    The leader is the set with the most crowded entries, of equal ones that of
    the smallest id: what copies were made from shares all that they share, so
    few of them differ from it in the same way.
    """
    names = classes.select(F.col("lo").alias("node"), "rep", "spare")
    low, weight = F.col("entry").bitwiseAND(63 | 128).cast("int"), F.when(F.col("entry").bitwiseAND(64) == 64, 2).otherwise(1)
    rows = crowded.join(names, "node").select("entry", "rep", low.alias("scheme"), weight.alias("weight"), "spare")
    load = rows.groupBy("rep", "scheme").agg(F.sum("weight").alias("load"), F.first("spare").alias("spare"))
    band = F.col("scheme").bitwiseAND(63)
    load = load.withColumn("apart", -F.sum("load").over(Window.partitionBy("rep", band)))
    kept = load.filter(F.col("load") > F.coalesce(F.element_at("spare", F.col("scheme")), F.lit(-1))).select("rep", "scheme", "apart")
    rows = rows.select("entry", "rep", "scheme").join(kept, ["rep", "scheme"])
    member = F.struct(band.alias("band"), "apart", "rep")
    meet = rows.groupBy("entry").agg(F.min(member).alias("b")).join(rows.select("entry", member.alias("a")), "entry").select("a", "b").distinct()
    return components(meet).select("component.band", F.col("component.rep").alias("leader"), "node.rep")


def crowded_pairs(members: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links of leaders, and pairs of other members that may link.

    The sets of a band that crowded entries hold together are a cluster with
    one leader. Each member is compared with the leader. Two
    members differ in just the elements in which one of them differs from the
    leader and the other doesn't, so a link between two that aren't both the
    leader's needs many differences in common. In one order for all, rarest
    first, the first common one stands early for both: only such places are
    joined, not all pairs.
    """
    cluster = ["band", "leader"]
    away = settle_table(differences(members.filter("rep <> leader"), sets, num, den), "lz4")
    led = away.filter("near").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    open_ = settle(away.filter("NOT near").select(*cluster).distinct())
    if open_.count() <= MOST_OPEN:
        open_ = F.broadcast(open_)
    away = away.join(open_, cluster, "left_semi")
    counted = away.join(away.groupBy(*cluster, "element").agg(F.count("*").alias("n")).filter("n > 1"), [*cluster, "element"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*cluster, "rep").orderBy("n", "element"))
    ranked = counted.withColumn("rank", rank).filter("n > 1")
    other = ranked.filter("2 * (rank - 1) <= most").select(*cluster, "element", *[F.col(c).alias(f"{c}_b") for c in ("rep", "size", "most", "near", "rank")])
    most = F.least("most", "most_b")
    early = (2 * (F.col("rank") - 1) <= F.col("size") - F.col("size_b") + most) & (2 * (F.col("rank_b") - 1) <= F.col("size_b") - F.col("size") + most)
    ahead = (F.col("size") > F.col("size_b")) | ((F.col("size") == F.col("size_b")) & (F.col("rep") > F.col("rep_b")))
    pairs = other.join(ranked, [*cluster, "element"]).filter(early & ahead & ~(F.col("near") & F.col("near_b"))).select(F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b")).distinct()
    return led, pairs


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when den * |intersection| >= num * |union| of their
    sets of `width`-word shingles (the whole sequence, if shorter). Null,
    empty and blank texts have no shingles and link with nothing, so each is
    its own component. Equal sets are one node of the join, however many
    copies there are. Rows with a null id keep a row: it has the component of
    equal sets with an id, else null. Other columns are not read; an empty
    table gives an empty table.
    """
    if docs.schema[text].dataType.simpleString() != "string":
        docs = docs.withColumn(text, F.col(text).cast("string"))
    rows = settle_table(document_sets(docs, width, num, den, doc_id, text))
    classes = rows.filter("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("spare").alias("spare"), F.first("sketch").alias("sketch"))

    met = index(docs, width, num, den, text).repartition("entry").sortWithinPartitions("entry", "node").mapInArrow(meetings, "a long, b long, entry long")
    met = settle_table(met)
    known = classes.filter("rep IS NOT NULL")
    pairs = settle(plausible(met.filter("entry IS NULL").select("a", "b").distinct(), known, num, den).distinct())
    members = settle(crowded_members(met.filter("b IS NULL").select("entry", F.col("a").alias("node")), known))
    wanted = settle(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(members.select("rep")).distinct())
    count = wanted.count()
    named = classes.select("hi", "lo", F.col("rep").alias("class_id"))
    if count:
        sets = settle_table(needed_sets(docs, wanted, count, width, doc_id, text).join(wanted, "rep", "left_semi"), "lz4")
        led, more = crowded_pairs(members, sets, num, den)
        member = components(verified(pairs.unionByName(more).distinct(), sets, num, den).unionByName(led))
        named = classes.join(member.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("class_id"))
    found = rows.join(named, ["hi", "lo"], "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("component_id"))
