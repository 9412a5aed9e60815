"""N-gram Jaccard self-join: shingle groups, a count-vector R-tree and exact verification.

A set's point holds the counts of its shingles in groups, about one group for every eight to sixteen shingles, so the sum of
the coordinate-wise minima of two points bounds their overlap closely at every length: unrelated sets fall far below what a
link needs. Points are packed into R-trees, whose inner nodes carry upper corners and so the same bound. Leaves hold a second,
finer vector, the parities of the counts in one to two groups a shingle: no more of them can differ than shingles do. What
survives is verified on the sets themselves.

No tree over a whole corpus can prune by counts alone (unrelated texts of one length have like counts in few groups, and in
many groups an upper corner covers everything), so the top level of the index splits by equality. Two sets of similarity t
differ in at most (1 - t) / (1 + t) * (|x| + |y|) shingles. If shingles are hashed into more groups than that, some group that
isn't empty holds the same shingles in both. Such a group is a page of the index, named by its shingles, and linked sets
always share one: no pair is lost. Size classes fix the number of groups.

Each step finds connected parts, not all pairs. Pages are joined under the bounds, which gives candidate components, and each
of these is verified with every set sent once. Members beyond BLOCK are dealt into parts that each also hold the group's first
member; only members that are not connected to it after that meet the other parts. So a group of copies costs a comparison
for each member, however large, and nothing is capped.

Equal sets are one point, whatever the number of documents.

Cases: a null, empty or blank text has an empty set (0 shingles), is linked with nothing and is its own component; fewer
words than a shingle make one shingle of all of them; repeated rows and ids are kept, each row by its own text; a component
whose ids are all null has a null id; an empty table gives an empty result; other columns are ignored or, in
`without_near_copies`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrid.llm.common import saved, shielded, small, table, utf8

#: Points in a leaf of the R-tree, and children of an inner node.
LEAF = 32
#: Members of a group that are joined in one task; larger groups are dealt over several.
BLOCK = 400
#: The same for members that are not connected to their group's first member, and the parts that they meet.
REST = 4096
#: Bytes of sets of such a part, on average.
PART_BYTES = 24_000_000
#: Entries (page name and set) that one bucket of the index holds on average.
BUCKET_ENTRIES = 250_000
#: Entries that a task sends at once.
EMIT_ENTRIES = 500_000
#: Entries that a bucket holds before they are matched.
CHUNK_ENTRIES = 1_000_000
#: Bytes of text that a task hashes at once.
SLICE_BYTES = 1_000_000
#: Bits of the filter that tells which documents' sets are needed: a bound on what is broadcast, whatever the input.
FILTER_BITS = 1 << 25
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Odd base of the words' polynomial hashes, and its inverse modulo 2^64.
BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: A number for each byte, the same for A-Z as for a-z, and which bytes separate words.
BYTES = np.random.default_rng(17).integers(0, 1 << 64, 256, dtype=np.uint64)
BYTES[65:91] = BYTES[97:123]
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of BASE and INVERSE, as many as a task has needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES)
            self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, x, np.uint64)))) for x in (BASE, INVERSE))


def word_hashes(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of texts that lie one after another in data, and the number of each text's first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~BLANK[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge], ends[edge - 1] = word[edge], word[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    powers.reach(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[data] * powers.up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * powers.down[start]), np.searchsorted(start, offsets)


def sets_of(texts: pa.Array, k: int, powers: Powers) -> Iterator[np.ndarray]:
    """The set of each text's hashed k-word shingles, sorted."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = min(len(texts), max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES))))
        h, first = word_hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], powers)
        words = np.diff(first)
        size = np.minimum(words, k)
        many = np.where(words > 0, words - size + 1, 0)
        begin = np.concatenate(([0], np.cumsum(many)))
        place = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], many)
        left = np.repeat(size, many)
        got = left.astype(np.uint64)
        for i in range(k):
            here = slice(None) if i == 0 else np.flatnonzero(left > i)
            got[here] = got[here] * ODD + h[place[here] + i]
        got = mix(got)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            own = got[a:b]
            own.sort()
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own
        at = to


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """The set of one text's hashed k-word shingles, sorted."""
    return next(sets_of(pa.array([text or b""], pa.binary()), k, Powers()))


def signature(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) if len(own) else 0


def page_names(own: np.ndarray, t: float) -> np.ndarray:
    """Names of the pages in which a set (sorted hashes) meets every set of at least similarity t that isn't equal to it."""
    n, out = len(own), []
    most = int((1 - t) / t * n + 1e-9)  # shingles in which a similar set can differ
    if most < 1:
        return np.empty(0, np.uint64)
    for level in range(n.bit_length(), int(n / t + 1e-9).bit_length() + 1):
        top = (1 << level) - 1  # sizes up to this one
        differ = int(2 * (1 - t) / (1 + t) * top + 1e-9)
        groups, seed = int(1.05 * differ) + 2, 0
        while True:
            h = own if not seed else np.sort(mix(own * ODD + np.uint64(seed)))
            group = ((h >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            out.append(mix(np.add.reduceat(mix(h + np.uint64(1)), first) + mix(group[first] * ODD + np.uint64(level * 1000 + seed))))
            if len(first) > min(most, differ):  # else a similar set may agree on empty groups only: deal the groups anew
                break
            seed += 1
    return np.concatenate(out)


def level_of(n: int) -> int:
    return int(n).bit_length()


def counts(own: np.ndarray) -> np.ndarray:
    """The set's point: how many of its shingles are in each group; 2^(level - 4) groups, 32 at least."""
    dims = max(32, 1 << max(0, level_of(len(own)) - 4))
    return np.bincount((mix(own + ODD) >> np.uint64(33)).astype(np.int64) % dims, minlength=dims).astype(np.uint16)


def parities(own: np.ndarray) -> np.ndarray:
    """Whether each of 2^level groups (64 at least) holds an odd number of the set's shingles, as packed bits."""
    groups = max(64, 1 << level_of(len(own)))
    return np.packbits((np.bincount((mix(own ^ ODD) >> np.uint64(33)).astype(np.int64) % groups, minlength=groups) & 1).astype(np.uint8))


def overlap_needed(na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t / (1 + t) * (na + nb) - 1e-6)


def may_link(na: np.ndarray, nb: np.ndarray, pa_: np.ndarray, pb: np.ndarray, t: float) -> np.ndarray:
    """Whether the parities (rows of 64-bit words) leave it possible that two sets are of similarity t."""
    return np.bitwise_count(pa_ ^ pb).sum(axis=1) <= (1 - t) / (1 + t) * (na + nb) + 1e-6


class RTree:
    """Points packed by size and leading coordinates: levels of nodes with their upper corners and least sizes."""

    def __init__(self, points: np.ndarray, n: np.ndarray):
        self.order = np.lexsort((points[:, 2], points[:, 1], points[:, 0], n))
        self.levels = [(points[self.order], n[self.order])]
        while len(self.levels[-1][1]) > 1:
            upper, least = self.levels[-1]
            first = np.arange(0, len(least), LEAF)
            self.levels.append((np.maximum.reduceat(upper, first), np.minimum.reduceat(least, first)))


def tree_join(a: RTree, b: RTree, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose overlap by coordinate minima can reach similarity t."""
    depth = max(len(a.levels), len(b.levels))
    i = j = np.zeros(1, np.int64)
    for level in range(depth - 1, -1, -1):
        (ua, na), (ub, nb) = (x.levels[min(level, len(x.levels) - 1)] for x in (a, b))
        if a is b:  # each pair once
            i, j = i[i <= j], j[i <= j]
        keep_i, keep_j, step = [i[:0]], [j[:0]], max(256, 4_000_000 // ua.shape[1])
        for at in range(0, len(i), step):
            p, q = i[at : at + step], j[at : at + step]
            good = np.minimum(ua[p], ub[q]).sum(axis=1) >= overlap_needed(na[p], nb[q], t)
            keep_i.append(p[good])
            keep_j.append(q[good])
        i, j = np.concatenate(keep_i), np.concatenate(keep_j)
        if level:
            i, j = expand(i, j, len(a.levels[min(level - 1, len(a.levels) - 1)][1]), len(b.levels[min(level - 1, len(b.levels) - 1)][1]), level < len(a.levels), level < len(b.levels))
    if a is b:
        i, j = i[i < j], j[i < j]
    return a.order[i], b.order[j]


def expand(i: np.ndarray, j: np.ndarray, na: int, nb: int, down_a: bool, down_b: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children of each pair of nodes; a tree that is less deep stays at its root until its level is reached."""
    step = np.arange(LEAF)
    ci = (i[:, None] * LEAF + step) if down_a else np.broadcast_to(i[:, None], (len(i), 1))
    cj = (j[:, None] * LEAF + step) if down_b else np.broadcast_to(j[:, None], (len(j), 1))
    x = np.broadcast_to(ci[:, :, None], (len(i), ci.shape[1], cj.shape[1])).ravel()
    y = np.broadcast_to(cj[:, None, :], (len(i), ci.shape[1], cj.shape[1])).ravel()
    good = (x < na) & (y < nb)
    return x[good], y[good]


class Members:
    """The members of one group: sizes, and points and parities as a matrix for each level."""

    def __init__(self, n: np.ndarray, point: list[bytes], parity: list[bytes]):
        self.n, self.levels = n, {}
        level = np.array([level_of(x) for x in n.tolist()], np.int64)
        for x in np.unique(level).tolist():
            at = np.flatnonzero(level == x)
            points = np.frombuffer(b"".join(point[i] for i in at), np.uint16).reshape(len(at), -1).astype(np.int32)
            self.levels[x] = at, points, np.frombuffer(b"".join(parity[i] for i in at), np.uint64).reshape(len(at), -1)

    def possible(self, t: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that sizes, count vectors and parities leave possible, each once."""
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for level, (at, points, parity) in self.levels.items():
            tree = RTree(points, self.n[at])
            for other in (level, level + 1):  # similar sets' sizes differ by less than a factor of two
                if other not in self.levels:
                    continue
                to, far, bits = self.levels[other]
                if other > level:  # groups of the finer vectors fold into those of the coarser
                    far, bits = (x if x.shape[1] == y.shape[1] else f(x.reshape(len(x), 2, -1)) for x, y, f in ((far, points, lambda x: x.sum(axis=1)), (bits, parity, lambda x: x[:, 0] ^ x[:, 1])))
                i, j = tree_join(tree, tree if other == level else RTree(far, self.n[to]), t)
                for k in range(0, len(i), 65536):
                    p, q = i[k : k + 65536], j[k : k + 65536]
                    good = may_link(self.n[at[p]], self.n[to[q]], parity[p], bits[q], t)
                    left.append(at[p[good]])
                    right.append(to[q[good]])
        return np.concatenate(left), np.concatenate(right)


def joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (the least member of each connected part) after the pairs x, y are connected too."""
    while len(x):
        a, b = label[x], label[y]
        np.minimum.at(label, a, b)
        np.minimum.at(label, b, a)
        while not np.array_equal(label, again := label[label]):
            label = again
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    return label


def verified(x: np.ndarray, y: np.ndarray, own: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, for each pair."""
    good = np.zeros(len(x), bool)
    for k, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = own[p], own[q]
        both = np.sort(np.concatenate((a, b)), kind="stable")
        both = int((both[1:] == both[:-1]).sum())
        good[k] = 100 * both >= percent * (len(a) + len(b) - both)
    return good


def spanned(x: np.ndarray, y: np.ndarray, label: np.ndarray, own: list[np.ndarray], percent: int) -> np.ndarray:
    """Labels after verifying, of the pairs x < y, as many as tell what is connected."""
    while len(x):
        pick = np.unique(y, return_index=True)[1]
        good = verified(x[pick], y[pick], own, percent)
        label = joined(label, x[pick[good]], y[pick[good]])
        left = np.ones(len(x), bool)
        left[pick] = False
        left &= label[x] != label[y]
        x, y = x[left], y[left]
    return label


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys (numbers), from rows sorted by them."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        if not len(held):
            continue
        new = np.zeros(len(held), bool)
        for key in keys:
            column = held.column(key).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield held.slice(a, b - a)
        held = held.slice(cuts[-1])
    if held is not None and len(held):
        yield held


def indexed(docs: DataFrame, k: int, t: float) -> tuple[DataFrame, DataFrame]:
    """(rows, pages) from one pass over the texts.

    rows (doc_id, h, n, sig) for every row: the text's hash, its number of shingles and its set's signature. pages (centre,
    sig): the members of every page of at least two, under one of them.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, int(0.055 * size / BUCKET_ENTRIES))  # about a word for every six bytes, and a name for every three shingles

    def emit(names, sigs, kind):
        names, sigs = np.concatenate(names), np.concatenate(sigs)
        bucket = (names >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        which, first = np.unique(bucket[order], return_index=True)
        split = lambda x: [y.tobytes() for y in np.split(x[order], first[1:])]
        none = pa.nulls(len(which), kind)
        return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(split(names), pa.binary()), pa.array(split(sigs), pa.binary()), none, *(pa.nulls(len(which), pa.int64()) for _ in range(3))], columns)

    columns = ["bucket", "names", "sigs", "doc_id", "h", "n", "sig"]

    def index(batches):
        powers, seen, names, sigs, held, at = Powers(), set(), [], [], 0, 0
        for batch in batches:
            kind, sig, n = batch.schema.field(0).type, [], []
            for own in sets_of(whole(batch.column(2)), k, powers):
                sig.append(signature(own))
                n.append(len(own))
                if sig[-1] in seen:
                    continue
                seen.add(sig[-1])
                got = page_names(own, t)
                names.append(got)
                sigs.append(np.full(len(got), sig[-1], np.int64))
                held += len(got)
                if held > EMIT_ENTRIES:
                    yield emit(names, sigs, kind)
                    names, sigs, held = [], [], 0
            bucket = (np.arange(at, at + len(n)) % buckets).astype(np.int32)
            at += len(n)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *(pa.nulls(len(n), pa.binary()) for _ in range(2)), batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.int64())], columns)
        if held:
            yield emit(names, sigs, kind)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, centres = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted names and the member that stands for each
        names, sigs, held, kind = [], [], 0, None

        def matched():
            nonlocal known, centres
            name, sig = np.frombuffer(b"".join(names), np.uint64), np.frombuffer(b"".join(sigs), np.int64)
            order = np.lexsort((sig, name))
            name, sig = name[order], sig[order]
            first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
            many = np.diff(np.append(first, len(name)))
            place = np.minimum(np.searchsorted(known, name[first]), max(0, len(known) - 1))
            met = known[place] == name[first] if len(known) else np.zeros(len(first), bool)
            centre = np.where(met, centres[place] if len(known) else 0, sig[first])
            keep = np.repeat(met | (many > 1), many)
            pairs = np.stack([np.repeat(centre, many)[keep], sig[keep]], axis=1)
            pairs = np.unique(np.concatenate([pairs, np.repeat(pairs[:, :1], 2, axis=1)]), axis=0)  # the centre is a member
            fresh = first[~met]
            known, centres = np.concatenate([known, name[fresh]]), np.concatenate([centres, sig[fresh]])
            order = np.argsort(known)
            known, centres = known[order], centres[order]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), kind), *(pa.nulls(len(pairs), pa.int64()) for _ in range(2))], out)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            is_row = batch.column("names").is_null()
            rows = batch.filter(is_row)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), rows.column("sig"), rows.column("doc_id"), rows.column("h"), rows.column("n")], out)
            blobs = batch.filter(pc.invert(is_row))
            names += blobs.column("names").to_pylist()
            sigs += blobs.column("sigs").to_pylist()
            held += sum(map(len, names[len(names) - len(blobs) :])) // 8
            if held > CHUNK_ENTRIES:
                yield matched()
                names, sigs, held = [], [], 0
        if held:
            yield matched()

    out = ["centre", "sig", "doc_id", "h", "n"]
    entries = docs.select("doc_id", F.xxhash64("text").alias("h"), utf8().alias("text")).mapInArrow(index, f"bucket int, names binary, sigs binary, doc_id {id_type}, h long, n long, sig long")
    both = saved(entries.groupBy("bucket").applyInArrow(gather, f"centre long, sig long, doc_id {id_type}, h long, n long"))
    return both.where("centre is null").select("doc_id", "h", "n", "sig"), saved(both.where("centre is not null").select("centre", "sig").distinct())


def whole(texts: pa.Array) -> pa.Array:
    """Texts without nulls, which count as empty."""
    return texts.fill_null(b"") if texts.null_count else texts


POINTS = {"point": counts, "parity": parities}
SETS = {**POINTS, "own": lambda own: own}


def made_again(docs: DataFrame, rows: DataFrame, to: DataFrame, k: int, columns: dict) -> DataFrame:
    """The rows of `to` (sig and others) with n and one binary column for each entry of columns, a function of the set, made again from the texts.

    Which documents are needed is told by a filter of FILTER_BITS bits over hashed ids, built in Spark: its false positives
    cost time only, as the sets are joined to the signatures afterwards, before anything is sent.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    # copies of a set, and groups that share one, are combined before they meet
    wanted = rows.groupBy("sig").agg(F.min("doc_id").alias("doc_id")).join(to.select("sig").distinct(), "sig", "left_semi").select(spot.alias("spot")).distinct()
    parts = wanted.groupBy(F.bitmap_bucket_number("spot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).collect()
    held = docs.sparkSession.sparkContext.broadcast({r["k"]: bytes(r["bits"]) for r in parts})

    def make(batches):
        powers, seen, bits = Powers(), set(), held.value
        for batch in batches:
            spots = batch.column(0).to_pylist()
            need = pa.array([i for i, s in enumerate(spots) if in_bits(bits, s)], pa.int64())
            sig, n, out = [], [], [[] for _ in columns]
            for own in sets_of(whole(batch.column(1).take(need)), k, powers):
                name = signature(own)
                if len(own) and name not in seen:
                    seen.add(name)
                    sig.append(name)
                    n.append(len(own))
                    for x, f in zip(out, columns.values(), strict=True):
                        x.append(f(own).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in out)], ["sig", "n", *columns])

    made = docs.select(spot.alias("spot"), utf8().alias("text")).mapInArrow(make, "sig long, n long, " + ", ".join(f"{c} binary" for c in columns))
    return made.join(small(to), "sig")


def in_bits(bits: dict[int, bytes], spot: int) -> bool:
    """Whether Spark's bitmap functions have set this position (bucket and bit as bitmap_bucket_number and bitmap_bit_position say)."""
    bucket, bit = (1 + (spot - 1) // 32768, (spot - 1) % 32768) if spot > 0 else (-spot // 32768, -spot % 32768)
    got = bits.get(bucket)
    return got is not None and bool(got[bit >> 3] >> (bit & 7) & 1)


def labels(edges: DataFrame) -> DataFrame:
    """(sig, label): the least signature of each node's component, by alternating large and small stars until nothing changes."""
    edges, before = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # in `large` every row points down, u > v: the small star links u and its lower neighbours to the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v")))
        edges = saved(small_.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("sig"), F.col("v").alias("label"))
        before = now


KEYS = ["centre", "part", "block"]


def parts_of(count: F.Column, n: F.Column, most: int) -> F.Column:
    """Parts into which rows are dealt: at most so many rows, and PART_BYTES of sets, on average."""
    return F.greatest(F.ceil(count / most), F.ceil(n * 8 / PART_BYTES), F.lit(1)).cast("int")


def dealt(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups (centre, sig, n) dealt into parts that each hold the centre too, and the groups of several parts."""
    size = groups.groupBy("centre").agg(parts_of(F.count("*"), F.sum("n"), BLOCK).alias("parts"))
    large = saved(size.where("parts > 1"))
    got = groups.join(small(large), "centre", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")
    part = F.explode(F.when(F.col("sig") == F.col("centre"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own)))
    return got.select("centre", part.alias("part"), F.lit(0).alias("block"), "sig", F.col("sig").alias("label"), F.lit(True).alias("rest")), groups.join(small(large.select("centre")), "centre")


def crossed(groups: DataFrame) -> DataFrame:
    """groups (centre, sig, n, label, rest) dealt so that all marked as rest meet all of their group: parts of the group by blocks of the rest."""
    size = groups.groupBy("centre").agg(parts_of(F.count("*"), F.sum("n"), REST).alias("parts"), parts_of(F.count_if("rest"), F.sum(F.when(F.col("rest"), F.col("n"))), REST).alias("blocks"), F.max("rest").alias("any"))
    got = groups.join(size.where("any").drop("any"), "centre")
    spot = F.xxhash64("sig")
    one, each = (lambda c: F.array(F.pmod(spot, F.col(c)).cast("int"))), (lambda c: F.sequence(F.lit(0), F.col(c) - 1))
    met = got.withColumn("rest", F.lit(False)).withColumn("part", F.explode(one("parts"))).withColumn("block", F.explode(each("blocks")))
    rest = got.where("rest").withColumn("part", F.explode(each("parts"))).withColumn("block", F.explode(one("blocks")))
    return met.unionByName(rest).groupBy(*KEYS, "sig").agg(F.first("label").alias("label"), F.max("rest").alias("rest"))


def edges_in(docs: DataFrame, rows: DataFrame, to: DataFrame, k: int, t: float, percent: int | None, every: bool = False) -> DataFrame:
    """(a, b) from groups (centre, part, block, sig, label, rest): edges that connect what is linked, or every link.

    percent None: pairs that the bounds leave possible count as linked; else sets are verified. Pairs of one label are known to
    be connected, and of each pair one must be marked as rest.
    """

    def join(batches):
        for group in runs(batches, KEYS):
            sig = group.column("sig").to_numpy()
            if len(sig) < 2:
                continue
            centre = group.column("centre")[0].as_py()
            first = np.unique(sig, return_index=True)[1]  # a set may have been made from two documents
            first = np.concatenate([first[sig[first] == centre], first[sig[first] != centre]])
            sig, name, rest = sig[first], group.column("label").to_numpy()[first], group.column("rest").to_numpy(zero_copy_only=False)[first]
            blobs = lambda c: [x for x in group.column(c).take(pa.array(first)).to_pylist()]  # noqa: B023, E731
            x, y = Members(group.column("n").to_numpy()[first], blobs("point"), blobs("parity")).possible(t)
            x, y = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            one = np.unique(name, return_index=True, return_inverse=True)
            start = one[1][one[2]]
            open_ = (rest[x] | rest[y]) & (start[x] != start[y])
            x, y = x[open_], y[open_]
            own = [np.frombuffer(b, np.uint64) for b in blobs("own")] if percent else []
            if every:
                good = verified(x, y, own, percent)
                a, b = sig[x[good]], sig[y[good]]
            else:
                label = spanned(x, y, start.copy(), own, percent) if percent else joined(start.copy(), x, y)
                moved = np.flatnonzero((start == np.arange(len(start))) & (label != start))
                a, b = sig[label[moved]], sig[moved]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    made = made_again(docs, rows, to, k, SETS if percent else POINTS)
    return saved(made.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(join, "a long, b long").distinct())


def connected(docs: DataFrame, rows: DataFrame, groups: DataFrame, k: int, t: float, percent: int | None) -> DataFrame:
    """(sig, label) of what is linked inside groups (centre, sig, n), directly or through others; a set that is alone has no row."""
    to, large = dealt(groups)
    edges = edges_in(docs, rows, saved(to), k, t, percent)
    found = labels(edges)
    if not large.isEmpty():
        label = F.coalesce("label", "sig")
        large = large.join(found, "sig", "left").withColumn("label", label)
        first = found.select(F.col("sig").alias("centre"), F.col("label").alias("__first"))
        large = saved(large.join(first, "centre", "left").withColumn("rest", F.col("label") != F.coalesce("__first", "centre")).drop("__first"))
        if not large.where("rest").isEmpty():
            more = edges_in(docs, rows, saved(crossed(large)), k, t, percent)
            found = labels(found.select(F.col("label").alias("a"), F.col("sig").alias("b")).unionByName(more))
    return found


def candidates(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): groups (centre, sig, n) of at least two sets, which hold every link inside one group each."""
    rows, pages = indexed(docs, k, percent / 100)
    # points are small, so pages are dealt by their members' number alone
    found = connected(docs, rows, pages.withColumn("n", F.lit(0)), k, percent / 100, None)
    groups = found.select(F.col("label").alias("centre"), "sig").unionByName(found.select(F.col("label").alias("centre"), F.col("label").alias("sig")).distinct())
    return rows, saved(groups.join(rows.groupBy("sig").agg(F.first("n").alias("n")), "sig"))


def links(docs: DataFrame, k: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(all links between different sets as pairs of signatures, membership (doc_id, h, n, sig)): the full join, for uses that need every pair."""
    rows, groups = candidates(docs, k, percent)
    groups = groups.withColumn("label", F.col("sig")).withColumn("rest", F.lit(True))
    return edges_in(docs, rows, saved(crossed(groups)), k, percent / 100, percent, every=True), rows


def components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, h, n, sig, component, component_id) for every row: component names it by a signature (null for an empty set)."""
    rows, groups = candidates(docs, k, percent)
    found = connected(docs, rows, groups, k, percent / 100, percent)
    classes = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least")).join(found, "sig", "left").withColumn("component", F.coalesce("label", "sig"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = saved(classes.select("sig", "component").join(least, "component"))
    full = rows.join(classes, "sig", "left")
    empty = F.col("n") == 0
    return full.select("doc_id", "h", "n", "sig", F.when(~empty, F.col("component")).alias("component"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


@shielded
def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component (the least id; null ids last) and all rows of empty sets, with docs's columns."""
    rows = saved(components(docs, k, percent).where(F.col("component").isNotNull()))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    best = rows.groupBy(F.col("component").alias("c")).agg(F.min(rank).alias("best"))
    gone = rows.join(best, F.col("component") == F.col("c")).where(rank != F.col("best")).select("doc_id", "h").distinct()
    gone = small(saved(gone.select(F.col("doc_id").alias("__gone"), F.col("h").alias("__gone_h"))))
    kept = docs.withColumn("__h", F.xxhash64("text"))
    kept = kept.join(gone, (F.col("__h") == F.col("__gone_h")) & F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")
    # equal ids with equal texts: rare, so a shuffle of whole rows is only paid for when there are any
    if rows.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        return kept.drop("__h")
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return kept.where(~blank).dropDuplicates(["doc_id", "__h"]).unionByName(kept.where(blank)).drop("__h")


def op5_count_vector_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of 4-word shingles and its component at a Jaccard similarity of 0.85."""
    got = components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
