"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least t percent.

Sets of sizes a and b are similar only if they differ in at most (a + b)(100 - t)/(100 + t) shingles. Sizes are cut
into bands; a tile takes a band and the smaller sets that can reach into it, so any similar pair shares a tile, which
has one greatest difference D. Each set deals its shingles by hash into P > D parts, and a part's sum of hashes is a
key: a similar pair differs in at most D parts, so it shares the key of some part that is not empty (sets with at
most D parts in use also give the keys of their empty parts). Shingles that a bounded sample shows to be very common
are left out of the keys; leaving the same shingles out of both sets never adds differences, so this loses no pair.

Sets with equal fingerprints are one class, found by a partial aggregate, and only one class of a task gives keys.
Each set has a hashed bitmap signature, whose bit counts bound an overlap from above. Classes that share a key and whose
bitmaps leave room for the similarity are joined in candidate groups: through the least class of each key first,
then, in keys that still hold several groups, by comparing all bitmaps of different groups. A group's sorted hash
arrays meet in one task, or, beyond ``tile_sets`` sets or ``tile_shingles`` shingles, in the tasks of all pairs of its blocks;
pairs that the bit counts do not rule out, and that are not joined yet, get the exact intersection of the sorted
arrays. The links found make the components.

Defined results: null and empty texts have an empty set and link with nothing; texts with fewer words than a shingle
have one shingle, of all words; a component is named by its smallest id, nulls aside; repeated rows are copies; an
empty table gives an empty result; other columns are not read. A set is known by 128 bits: 64 name it, and names that
stand for more than one set, by the other 64, get these mixed in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Folders, Words, grouped_map, ids_and_text, mapped, mix, stored, string_hashes

SETS = "doc_id long, tie long, n_shingles long, sig long, check long, keys array<long>, bits binary"
#: Rows up to which a list of ids is broadcast.
BROADCAST_ROWS = 300_000


@dataclass(frozen=True)
class Join:
    """words: of a shingle. percent: least similarity. sample_docs, common_percent: a shingle in so many percent of about
    so many documents is very common. tile_sets, tile_shingles: most of a tile. sig_bits: of a fingerprint.
    """

    words: int = 5
    percent: int = 80
    sample_docs: int = 4000
    common_percent: float = 1.0
    tile_sets: int = 3000
    tile_shingles: int = 3_000_000
    sig_bits: int = 64

    def edges(self) -> np.ndarray:
        """First sizes of the bands, so far apart that similar sets lie in one band or in neighbouring ones."""
        out = [1]
        while out[-1] < 1 << 34:
            out.append(max(out[-1] * 3 // 2, -(-100 * out[-1] // self.percent), out[-1] + 1))
        return np.array(out)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, joined, and where each text's begin (with the end)."""
    words = Words(texts)
    if not len(words.values):
        return np.empty(0, np.uint64), np.zeros(words.n + 1, np.int64)
    coded = words.values.dictionary_encode()
    hashed = string_hashes(pc.ascii_lower(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
    total = np.zeros(len(hashed), np.uint64)
    for j in range(k):
        m = max(0, len(hashed) - j)  # a batch may hold fewer words than a shingle
        total[:m] = total[:m] * np.uint64(0x9E3779B97F4A7C15) + hashed[j:]
    total = mix(total)
    parts, size = [], np.zeros(words.n, np.int64)
    first = words.first.tolist()
    for i in range(words.n):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            own = np.sort(total[a : b - k + 1])
            if len(own) > 1:
                new = np.empty(len(own), bool)
                new[0] = True
                np.not_equal(own[1:], own[:-1], out=new[1:])
                own = own[new]
        elif b > a:
            short = np.uint64(0)
            for x in hashed[a:b]:
                short = np.uint64((int(short) * 0x9E3779B97F4A7C15 + int(x) + 1) & 0xFFFFFFFFFFFFFFFF)
            own = mix(np.array([short]))
        else:
            continue
        parts.append(own)
        size[i] = len(own)
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(size)])


def fingerprints(hashes: np.ndarray, bounds: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Two signed 64-bit numbers for each set: its name, and a check of it."""
    out = []
    for shift in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(shift)), dtype=np.uint64)])
        out.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
    return (out[0] >> np.uint64(64 - join.sig_bits)).astype(np.int64), out[1].astype(np.int64)


def told_apart(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """rows with names (sig) that stand for one set each: those that several checks share get the check mixed in."""
    if clashes is None:
        return rows
    named = rows.join(clashes.select(F.col("sig").alias("clash")), F.col("sig") == F.col("clash"), "left")
    return named.withColumn("sig", F.when(F.col("clash").isNull(), F.col("sig")).otherwise(F.xxhash64("sig", "check"))).drop("clash")


def part_keys(hashes: np.ndarray, bounds: np.ndarray, join: Join, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all sets, joined, and each key's set."""
    edges, n = join.edges(), np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] != hashes
        hashes, owner = hashes[rare], owner[rare]
    mixed = mix(hashes + np.uint64(0x2545F4914F6CDD1D))
    band = np.searchsorted(edges, n, "right") - 1
    keys, sets = [], []
    for up in (0, 1):
        tile = band + up
        inside = (n > 0) & ((up == 0) | (100 * n >= join.percent * edges[tile]))
        most = 2 * (edges[tile + 1] - 1) * (100 - join.percent) // (100 + join.percent)
        inside &= most > 0  # else only equal sets are similar
        parts = np.where(inside, most + 3 + most // 20, 0)
        start = np.cumsum(parts) - parts
        mine = inside[owner]
        at = start[owner[mine]] + ((hashes[mine] >> np.uint64(32)) * parts[owner[mine]].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        sums, used = np.zeros(int(parts.sum()), np.uint64), np.zeros(int(parts.sum()), bool)
        np.add.at(sums, at, mixed[mine])
        used[at] = True
        who = np.repeat(np.arange(len(n)), parts)
        # A set's own size bounds its differences too; only with so few parts in use may all of those differ.
        few = np.bincount(who[used], minlength=len(n)) <= np.minimum(most, n * (100 - join.percent) // join.percent)
        place = np.arange(len(who)) - start[who]
        give = used | few[who]
        key = mix(sums[give] + mix((tile[who[give]].astype(np.uint64) << np.uint64(40)) + place[give].astype(np.uint64)))
        keys.append(key)
        sets.append(who[give])
    return np.concatenate(keys).astype(np.int64), np.concatenate(sets)


def bitmaps(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set a bitmap of two to four bits for each shingle; halves of a bitmap ORed are the bitmap of half as many bits."""
    mixed = mix(hashes)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        bits = max(64, 1 << (2 * (b - a) - 1).bit_length())
        own = np.zeros(bits, np.uint8)
        own[(mixed[a:b] & np.uint64(bits - 1)).astype(np.int64)] = 1
        out.append(np.packbits(own, bitorder="little").tobytes())
    return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap in words of 64 bits, as one of so many words."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def may_be_similar(a: np.ndarray, n: int, maps: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether bit counts leave room for the similarity: shingles of a set whose bit the other lacks are not shared."""
    lost = np.bitwise_count(a & ~maps).sum(axis=1, dtype=np.int64)
    gained = np.bitwise_count(maps & ~a).sum(axis=1, dtype=np.int64)
    bound = np.minimum(n - lost, sizes - gained)
    return 100 * bound >= percent * (n + sizes - bound)


def text_tie(text: Column) -> Column:
    """Tells apart the texts of one id."""
    return F.xxhash64(text)


def common_shingles(rows: DataFrame, join: Join) -> np.ndarray:
    """Hashes of very common shingles, by a sample of about sample_docs documents; only the speed depends on them."""
    n = rows.count()
    share = F.pmod(F.xxhash64(F.lit(41), "doc_id"), F.lit(1_000_003)) / 1_000_003
    sample = rows.where((share < min(1.0, join.sample_docs / max(n, 1))) & (F.octet_length("text") < 50_000))

    def make():
        return lambda batch: pa.RecordBatch.from_pydict({"h": pa.array(shingles(batch.column("text"), join.words)[0].astype(np.int64))})

    least = max(20, int(min(n, join.sample_docs) * join.common_percent / 100))
    counted = mapped(sample.select("text"), make, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return np.sort(counted.select("h").toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64))


def keyed_sets(rows: DataFrame, join: Join, own: Folders) -> DataFrame:
    """SETS: for the first set with its fingerprint in a task its keys, for the others none."""
    common = common_shingles(rows, join)

    def make():
        seen: set[tuple[int, int]] = set()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, bounds = shingles(batch.column("text"), join.words)
            (sig, check), n = fingerprints(hashes, bounds, join), np.diff(bounds)
            if len(seen) > 1_000_000:
                seen.clear()
            fresh = np.zeros(len(n), bool)
            for i, x in enumerate(zip(sig.tolist(), check.tolist(), strict=True)):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            own = np.repeat(fresh, n)
            keys, sets = part_keys(hashes[own], np.concatenate([[0], np.cumsum(np.where(fresh, n, 0))]), join, common)
            order = np.argsort(sets, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(sets, minlength=len(n)))])
            kept = iter(bitmaps(hashes[own], np.concatenate([[0], np.cumsum(n[fresh])])))
            bits = pa.array([next(kept) if f else None for f in fresh.tolist()], pa.binary())
            return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "tie": batch.column("tie"), "n_shingles": pa.array(n), "sig": pa.array(sig), "check": pa.array(check), "keys": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[order])), "bits": bits})

        return work

    return own.stored(mapped(rows, make, SETS), "keyed-sets")


def components(edges: DataFrame, own: Folders) -> DataFrame:
    """node, root: the smallest node of its component, for all nodes of edges (a, b), by labels that run along edges and jump."""
    # One reading of edges gives both directions: a second one of the comparisons could choose other links.
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = own.stored(edges.select(F.inline(ways)).distinct(), "edges")
    labels = own.stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        mine = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("root", F.coalesce("near", "root")).alias("now"), F.col("root").alias("was"))
        up = labels.select(F.col("node").alias("at"), F.col("root").alias("far"))
        new = own.stored(mine.join(up, mine["now"] == up["at"], "left").select("node", F.least("now", F.coalesce("far", "now")).alias("root"), "was"), "labels")
        labels = new.select("node", "root")
        if not new.where("root <> was").limit(1).count():
            return labels


def joined_groups(stars: DataFrame, own: Folders) -> DataFrame:
    """node, root as components() gives them. First each node goes to the least centre that it has, which leaves few edges."""
    stars = own.stored(stars, "stars")
    near = stars.groupBy("b").agg(F.min("a").alias("near"))
    nodes = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    parent = own.stored(nodes.join(near, nodes["node"] == near["b"], "left").select("node", F.coalesce("near", "node").alias("parent")), "parents")
    a, b = parent.alias("pa"), parent.alias("pb")
    left = stars.join(a, stars["a"] == F.col("pa.node")).join(b, stars["b"] == F.col("pb.node"))
    short = left.select(F.col("pa.parent").alias("a"), F.col("pb.parent").alias("b")).where("a <> b").distinct()
    up = components(short, own)
    return parent.join(up.withColumnRenamed("node", "top"), F.col("parent") == F.col("top"), "left").select("node", F.coalesce("root", "parent").alias("root"))


def similar(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that join all similar sets: a pair is compared unless its sets are joined already. left: compare only across."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    side = None if left is None else left[order]
    n = np.array([len(s) for s in sets])
    bits = 1 << max(6, min(16, int(4 * n.max() - 1).bit_length()))
    maps = np.zeros((len(sets), bits // 64), np.uint64)
    row = np.repeat(np.arange(len(sets)), n)
    joined = np.concatenate(sets)
    bit = (joined * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int64) & (bits - 1)
    np.bitwise_or.at(maps, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    start = np.concatenate([[0], np.cumsum(n)])
    root, links = np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        to = np.searchsorted(n, n[i] * 100 // percent, "right")
        js = np.arange(i + 1, to)
        js = js[root[js] != root[i]]
        if side is not None:
            js = js[side[js] != side[i]]
        if not len(js):
            continue
        js = js[may_be_similar(maps[i], n[i], maps[js], n[js], percent)]
        for part in np.array_split(js, len(js) // 256 + 1):
            part = part[root[part] != root[i]]
            if not len(part):
                continue
            own = np.concatenate([joined[start[j] : start[j + 1]] for j in part])
            at = np.minimum(np.searchsorted(sets[i], own), n[i] - 1)
            both = np.add.reduceat((sets[i][at] == own).astype(np.int64), np.concatenate([[0], np.cumsum(n[part])[:-1]]))
            for j in part[100 * both >= percent * (n[i] + n[part] - both)]:
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    links.append((order[i], order[j]))
    return links


def tiled(members: DataFrame, join: Join) -> DataFrame:
    """members (sig, root, volume, ...) with block, x, y, bin: the cell (root, x, y) holds the blocks x and y of a group, and a bin
    many small groups or one cell of a large one.
    """
    blocks = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / join.tile_sets, F.sum("volume") / join.tile_shingles)).cast("int").alias("blocks"))
    total = members.agg(F.sum("volume")).first()[0] or 0
    bins = int(total // join.tile_shingles) * 2 + int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = placed.withColumn("other", other).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    return spread.withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.xxhash64("root", "x", "y"))).drop("blocks", "other", "volume")


def cells_of(tile: pa.Table):
    """The tile's rows in order, and each cell's bounds and whether only pairs across its two blocks count."""
    tile = tile.sort_by([(c, "ascending") for c in ("root", "x", "y", "sig")])
    cell = np.stack([tile[c].to_numpy() for c in ("root", "x", "y")])
    cuts = np.concatenate([[0], np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1, [tile.num_rows]]).tolist()
    return tile, [(a, b, cell[1, a] != cell[2, a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def bounded(sizes: np.ndarray, maps: list[np.ndarray], label: np.ndarray, percent: int, side: np.ndarray | None) -> list[tuple[int, int]]:
    """Pairs of different labels that their bitmaps do not rule out, enough to join all such."""
    order = np.argsort(sizes, kind="stable")
    n, words = sizes[order], min(map(len, maps))
    own, links = np.stack([folded(maps[i], words) for i in order]), []
    _, root = np.unique(label[order], return_inverse=True)
    for i in range(len(n) - 1):
        js = np.arange(i + 1, np.searchsorted(n, n[i] * 100 // percent, "right"))
        js = js[root[js] != root[i]]
        if side is not None:
            js = js[side[order[js]] != side[order[i]]]
        if len(js):
            for j in js[may_be_similar(own[i], n[i], own[js], n[js], percent)]:
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    links.append((order[i], order[j]))
    return links


def with_ends(rows: DataFrame, value: str) -> DataFrame:
    """rows (key, ...) with the least and the greatest value of their key as low and high."""
    meet = Window.partitionBy("key")
    return rows.withColumn("low", F.min(value).over(meet)).withColumn("high", F.max(value).over(meet))


def candidate_groups(keyed: DataFrame, join: Join, own: Folders) -> DataFrame:
    """node, root: sets that share a key and that their bitmaps do not rule out, directly or through others, have one root.

    Most such sets are joined through the least set of a key; keys that then still hold sets of several groups are
    compared in full, bitmap by bitmap, in tiles.
    """
    some = keyed.where(F.size("keys") > 0)
    each = some.select(F.explode("keys").alias("key"), "sig")
    members = own.stored(with_ends(each, "sig").where("low <> high").select("key", "sig", F.col("low").alias("centre")), "members")
    signs = own.stored(some.join(members.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(F.first("n_shingles").alias("n"), F.first("bits").alias("bits")), "signatures")
    one, two = signs.toDF("a", "n", "bits"), signs.toDF("b", "m", "more")
    stars = members.where("sig <> centre").select(F.col("centre").alias("a"), F.col("sig").alias("b")).distinct().join(one, "a").join(two, "b")

    def pass_bound(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "bits", "more")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(x), len(y))
                keep.append(bool(may_be_similar(folded(x, words), n, folded(y, words)[None], np.array([m]), join.percent)[0]))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    near = own.stored(stars.mapInArrow(pass_bound, "a long, b long"), "bounded-stars")
    first = joined_groups(near, own)
    label = F.coalesce("root", "sig")
    labelled = members.select("key", "sig").join(first, members["sig"] == first["node"], "left").select("key", "sig", label.alias("label"))
    mixed = with_ends(labelled, "label").where("low <> high").select(F.col("key").alias("root"), "sig", "label").distinct()
    open_ = own.stored(mixed.join(signs, "sig").select("sig", "root", "label", "n", "bits", (F.octet_length("bits") / 8).cast("long").alias("volume")), "open-keys")

    def compare(tile: pa.Table) -> pa.Table:
        tile, cells = cells_of(tile)
        sig, n, label, block, bits = (tile[c].to_numpy() for c in ("sig", "n", "label", "block", "bits"))
        a, b = [], []
        for low, high, across in cells:
            maps = [np.frombuffer(x, np.uint64) for x in bits[low:high]]
            for i, j in bounded(n[low:high], maps, label[low:high], join.percent, block[low:high] if across else None):
                a.append(sig[low + i])
                b.append(sig[low + j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    more = own.stored(grouped_map(tiled(open_, join), "bin", compare, "a long, b long").distinct(), "bounded-pairs")
    if not more.limit(1).count():
        return first
    return components(first.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).union(more), own)


def links(rows: DataFrame, keyed: DataFrame, classes: DataFrame, clashes: DataFrame | None, join: Join, own: Folders) -> DataFrame:
    """a, b: names of similar sets, enough to join every component."""
    part = own.part()
    groups = candidate_groups(keyed, join, part)
    members = own.stored(groups.join(classes, groups["node"] == classes["sig"]).select("sig", "root", F.col("n_shingles").alias("volume"), "class_id"), "candidates")
    part.forget(keep=0)
    tiles = tiled(members.drop("class_id"), join)

    wanted = _short(members.select(F.col("class_id").alias("wanted")).distinct())
    chosen = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["wanted"]), "left_semi")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, bounds = shingles(batch.column("text"), join.words)
            data = hashes.tobytes()
            sig, check = fingerprints(hashes, bounds, join)
            return pa.RecordBatch.from_pydict({"sig": pa.array(sig), "check": pa.array(check), "hashes": pa.array([data[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())})

        return work

    arrays = told_apart(mapped(chosen, make, "sig long, check long, hashes binary"), clashes).drop("check")

    def compare(tile: pa.Table) -> pa.Table:
        tile, cells = cells_of(tile)
        sig, block, hashes = tile["sig"].to_numpy(), tile["block"].to_numpy(), tile["hashes"]
        a, b = [], []
        for low, high, across in cells:
            sets = [np.frombuffer(hashes[i].as_py(), np.uint64) for i in range(low, high)]
            for i, j in similar(sets, join.percent, block[low:high] if across else None):
                a.append(sig[low + i])
                b.append(sig[low + j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return grouped_map(tiles.join(arrays, "sig"), "bin", compare, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id, sig, tie per row of docs."""
    rows = ids_and_text(docs, id_col, text_col).withColumn("tie", text_tie(F.col("text")))
    own = Folders(rows.sparkSession)
    keyed = keyed_sets(rows, join, own)
    facts, clashes = [F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies"), F.min("check").alias("least"), F.max("check").alias("most")], None
    classes = own.stored(keyed.where("n_shingles > 0").groupBy("sig").agg(*facts), "classes")
    if classes.where("least <> most").limit(1).count():
        clashes = _short(own.stored(classes.where("least <> most").select("sig"), "name-clashes"))
        keyed = own.stored(told_apart(keyed, clashes), "keyed-sets")
        classes = own.stored(keyed.where("n_shingles > 0").groupBy("sig").agg(*facts), "classes")
    roots = components(links(rows, keyed, classes, clashes, join, own), own)
    rooted = classes.join(roots, classes["sig"] == roots["node"], "left").select("sig", F.coalesce("root", "sig").alias("root"), "class_id", "copies", F.col("root").isNotNull().alias("linked"))
    smallest = rooted.groupBy("root").agg(F.min("class_id").alias("component"))
    # Sets without a copy or link, and empty ones, need no name.
    named = own.stored(rooted.where("linked or copies > 1").join(smallest, "root").select(F.col("sig").alias("named"), "component"), "components")
    keyed = own.stored(keyed.drop("keys", "bits"), "named-sets")
    own.forget(keep=2)
    some, none = keyed.where("n_shingles > 0"), keyed.where("n_shingles = 0")
    told = some.join(_short(named), some["sig"] == F.col("named"), "left")
    columns = ["doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "sig", "tie"]
    return told.select(columns).unionByName(none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "sig", "tie"))


def _short(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to be short."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """The rows of docs that stand for their component: the smallest id; all rows without a component's name (null ids) or a word stay.

    Repeated rows of one id and text stay together, as they are one document; of an id's other texts each is judged alone.
    """
    found = jaccard_components(docs, id_col, text_col, join)
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("other"), F.col("tie").alias("other_tie")).distinct(), "near-copies")
    gone = _short(gone)
    # The row is one column here, so that its columns' names do not meet those used below.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("own"), text_tie(docs[text_col]).alias("own_tie"))
    return rows.join(gone, (F.col("own") == F.col("other")) & (F.col("own_tie") == F.col("other_tie")), "left_anti").select("row.*")
