"""N-gram Jaccard join by signature trees.

A text's set are its distinct word n-grams.  Two texts are linked when the
Jaccard similarity of their sets reaches ``num / den``, tested in integers.

1. Equal sets are one entry, found by a digest of the set.
2. A text stands alone if it has more grams that no other text holds than a link
   leaves over.  To find that, the grams of a zone, a fixed part of all hashes,
   meet as packed numbers; most texts of most corpora go no further.
3. Grams are put in one order for the texts left: those of a wider zone first, rare
   ones first by exact counts, then the others by a counting sketch of fixed size
   (any fixed order is exact; a good one keeps frequent passages out of the way,
   however large the corpus).  An entry's prefix in that order is long enough that
   linked entries share a prefix gram.  Entries that share one are tied to the least
   of them, and these stars joined into candidate components, so each entry comes
   into play once however many grams it shares.
4. A candidate component becomes a signature tree: entries are leaves, each node
   has the OR of its entries' token bitmaps and their size range.  A dual
   traversal, deepest first, drops node pairs whose largest possible overlap is
   too small or whose entries are all connected already.  The pairs left
   connect entries into narrow families; no linked pair falls between two.
5. Only the texts of families travel.  The same traversal over a family's sets
   compares the pairs left exactly, and the links found (a spanning forest) are
   joined into components.

Components and families too large for one task are cut by size range and hash
into parts, and every two parts that may hold linked sets meet in one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import common
from spendlens.llm.components import connected_components

#: Set members a block of texts may hold, and how many times as many a block of bitmaps.
BLOCK_GRAMS = 2_000_000
BITMAP_BLOCK = 8
FAN = 64
#: Most bits of a stored bitmap.
WIDEST = 1 << 17

#: Parts of the zone, zone grams that a task packs and a group of parts meets at once, and most texts of a pack.
ZONE_PARTS, ZONE_GRAMS, PACK_TEXTS = 1 << 10, 1 << 20, 1 << 16
#: Times the grams of a prefix in the zone of the texts left.
WIDE = 4

#: Cells of the gram counts (a byte each, broadcast) and the parts they are added up in.
CELLS, CELL_PARTS = 1 << 24, 64

TEXTS = "entry long, doc_id long, fp1 long, fp2 long, n long, alone long, part int, size long, keys binary, owners binary, twice binary"
SETS = "entry long, doc_id long, fp1 long, fp2 long, n long, prefix array<long>, bits binary"


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def zone_top(num: int, den: int, times: int = 2) -> int:
    """The last hash of the zone: it holds about ``times`` the grams of a prefix."""
    return min(times * (den - num) * (1 << 64) // den, (1 << 64) - 1)


def zone_of(grams: np.ndarray, num: int, den: int, times: int = 2) -> np.ndarray:
    return grams[:np.searchsorted(grams, np.uint64(zone_top(num, den, times)), "right")]


def set_digest(grams: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(grams.tobytes())
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


def bitmap_width(size: int) -> int:
    """Power of two from 4 bits a member up."""
    width = 64
    while width < 4 * size and width < WIDEST:
        width *= 2
    return width


def bitmap(grams: np.ndarray, width: int) -> np.ndarray:
    row = np.zeros(width, bool)
    row[(grams % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(row, bitorder="little").view(np.uint64)


def _pack(first: int, zones: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, pa.RecordBatch]:
    """For texts ``first``, ``first`` + 1 ...: how many grams of its zone each has alone here, and all of these grams.

    A part of the zone is a row: 32 bits of each gram that one text has here with
    the text's number, and of each gram that several have, once.
    """
    size = [len(z) for z in zones]
    grams, owner = np.concatenate(zones), np.repeat(np.arange(len(zones), dtype=np.uint32), size)
    order = np.argsort(grams)
    grams, owner = grams[order], owner[order]
    begins = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, bool)
    single = begins & np.append(begins[1:], True)[:len(grams)]
    alone = np.bincount(owner[single], minlength=len(zones))
    twice, grams, owner = grams[begins & ~single], grams[single], owner[single]
    step = zone_top(num, den) // ZONE_PARTS + 1
    bounds = np.array([k * step for k in range(ZONE_PARTS)], np.uint64)
    shift = np.uint64(max(step.bit_length() - 32, 0))
    at, at2 = (np.append(np.searchsorted(g, bounds), len(g)) for g in (grams, twice))

    def keys(g: np.ndarray, part: int) -> bytes:
        return ((g - bounds[part]) >> shift).astype(np.uint32).tobytes()

    rows = [(first, k, b - a + d - c, keys(grams[a:b], k), pa.compress(owner[a:b].tobytes(), codec="zstd", asbytes=True), keys(twice[c:d], k))
            for k, (a, b, c, d) in enumerate(zip(at, at[1:], at2, at2[1:])) if b - a + d - c]
    columns = zip(("entry", "part", "size", "keys", "owners", "twice"), zip(*rows) if rows else [()] * 6)
    return alone, _texts_batch(dict(columns), len(rows))


def _texts_batch(columns: dict, rows: int) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in TEXTS.split(", ")]
    return pa.RecordBatch.from_pydict({name: pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(rows, kinds[kind])
                                       for name, kind in fields})


def _texts(n: int, num: int, den: int):
    """A row for each text (``part`` is null), and rows with the packed zones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = TaskContext.get().partitionId() << 36
        rows, zones, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            alone, packed = _pack(rows[0][0], zones, num, den)
            columns = dict(zip(("entry", "doc_id", "fp1", "fp2", "n"), zip(*rows)))
            yield _texts_batch(columns | {"alone": alone}, len(rows))
            if packed.num_rows:
                yield packed
            rows.clear()
            zones.clear()

        for batch in common.slices(batches, share=common.WORDS_SHARE):
            words, at = common.word_hashes(batch.column("text"))
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                grams = common.shingle_set(words[at[i]:at[i + 1]], n)
                rows.append((entry, doc_id, *set_digest(grams), len(grams)))
                zones.append(zone_of(grams, num, den).copy() if doc_id is not None else grams[:0])  # such a row links nothing
                held += len(zones[-1])
                entry += 1
            if held >= ZONE_GRAMS or len(rows) >= PACK_TEXTS:
                yield from out()
                held = 0
        if rows:
            yield from out()
    return run


def _met(parts: pa.Table) -> pa.Table:
    """For each pack, how many grams of those that it has alone there a text shares with texts of other packs."""
    common.handled(parts.nbytes)
    keys, owners = [], []
    for first, part, own, owner, twice in zip(*(parts[c].to_pylist() for c in ("entry", "part", "keys", "owners", "twice")), strict=True):
        own, twice = np.frombuffer(own, np.uint32), np.frombuffer(twice, np.uint32)
        owner = np.frombuffer(pa.decompress(owner, decompressed_size=own.nbytes, codec="zstd", asbytes=True), np.uint32)
        keys += [own.astype(np.uint64) | np.uint64(part << 32), twice.astype(np.uint64) | np.uint64(part << 32)]
        owners += [owner.astype(np.int64) + first, np.full(len(twice), -1)]
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(keys)
    same = np.diff(keys[order]) == 0
    shared = np.append(same, False) | np.concatenate([[False], same])
    entry, times = np.unique(owners[order[shared]], return_counts=True)
    first = np.unique(parts["entry"].to_numpy())
    at = np.append(np.searchsorted(entry, first), len(entry))  # one row a pack, not a text
    return pa.table({"entry": pa.array(first, pa.int64()), "texts": pa.array([entry[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()),
                     "times": pa.array([times[a:b].astype(np.uint32).tobytes() for a, b in zip(at, at[1:])], pa.binary())})


def _add_met(pack: pa.Table) -> pa.Table:
    common.handled(pack.nbytes)
    texts, times = (np.frombuffer(b"".join(pack[c].to_pylist()), kind) for c, kind in (("texts", np.int64), ("times", np.uint32)))
    entry, at = np.unique(texts, return_inverse=True)
    return pa.table({"entry": pa.array(entry, pa.int64()), "times": pa.array(np.bincount(at, times, len(entry)).astype(np.int64))})


def _prefix_length(num: int, den: int) -> Column:
    return F.expr(f"n - ({num} * n + {den - 1}) div {den} + 1")


def not_alone(texts: DataFrame, num: int, den: int) -> DataFrame:
    """Texts that may be linked: fewer grams of theirs are held by no other text than a link leaves over."""
    packed = texts.where("part is not null")
    total = packed.agg(F.sum("size")).first()[0] or 0
    groups = min(1 << (total // ZONE_GRAMS).bit_length(), ZONE_PARTS)
    met = (packed.withColumn("group", F.floor(F.col("part") * groups / ZONE_PARTS).cast("int")).groupBy("group")
           .applyInArrow(_met, "entry long, texts binary, times binary").groupBy("entry").applyInArrow(_add_met, "entry long, times long"))
    known = texts.where("part is null and n > 0 and doc_id is not null").select("entry", "doc_id", "fp1", "fp2", "n", "alone")
    return (known.join(met, "entry", "left").where(F.col("alone") - F.coalesce("times", F.lit(0)) < _prefix_length(num, den))
            .drop("alone", "times"))


def _count_cells(n: int):
    """A task's gram counts, one row for each part of the cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint8)
        for batch in common.slices(batches, share=common.WORDS_SHARE):
            words, at = common.word_hashes(batch.column("text"))
            cells = [common.shingle_set(words[a:b], n) % np.uint64(CELLS) for a, b in zip(at, at[1:])]
            cell, count = np.unique(np.concatenate(cells), return_counts=True)
            cell = cell.astype(np.int64)
            counts[cell] = np.minimum(counts[cell] + count, 255)  # added as 64-bit numbers
        parts = counts.reshape(CELL_PARTS, -1)
        blobs = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in parts]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(CELL_PARTS), pa.int64()), "counts": pa.array(blobs, pa.binary())})
    return run


def _add_cells(part: pa.Table) -> pa.Table:
    total = np.zeros(CELLS // CELL_PARTS, np.int64)
    for blob in part["counts"].to_pylist():
        total += np.frombuffer(pa.decompress(blob, decompressed_size=len(total), codec="zstd", asbytes=True), np.uint8)
    return pa.table({"part": part["part"][:1], "counts": pa.array([np.minimum(total, 255).astype(np.uint8).tobytes()])})


def gram_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many texts hold a gram of each cell, up to 255; ``CELLS`` bytes whatever the input."""
    schema = "part long, counts binary"
    rows = docs.mapInArrow(_count_cells(n), schema).groupBy("part").applyInArrow(_add_cells, schema).collect()
    if not rows:
        return np.zeros(CELLS, np.uint8)
    counts, size = np.empty(CELLS, np.uint8), CELLS // CELL_PARTS
    for row in rows:  # a row for each part
        counts[row["part"] * size:(row["part"] + 1) * size] = np.frombuffer(row["counts"], np.uint8)
    del rows, row
    common.release()
    return counts


def prefix_of(grams: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The grams of a set that its prefix is taken from: a zone twice as wide, and what that lacks by the count of the cell, then by hash."""
    if not len(grams):
        return grams
    zone = zone_of(grams, num, den, WIDE)
    lacks = prefix_length(len(grams), num, den) - len(zone)
    if lacks <= 0:
        return zone
    rest = grams[len(zone):]
    rank = (counts[(rest % np.uint64(CELLS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (rest >> np.uint64(8))
    return np.concatenate([zone, rest[np.lexsort((rest, rank))[:lacks]]])


def prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """entry, gram: of the prefix of each of ``sets`` (entry, n, prefix), the grams that others have there too.

    ``prefix`` has the whole zone, so counts over it are the same for all that
    hold a gram; where it has more, it is the prefix.  Grams that one entry has
    alone come first and are left out.
    """
    grams = sets.select("entry", F.explode("prefix").alias("gram"))
    shared = common.cut(grams.groupBy("gram").agg(F.min("entry").alias("least"), F.max("entry").alias("most"), F.count("*").alias("times"))
                        .where("least != most").select("gram", "times"))
    found = grams.join(shared, "gram").groupBy("entry").agg(F.sort_array(F.collect_set(F.struct("times", "gram"))).alias("found"))
    sizes = sets.select("entry", (F.size("prefix") - _prefix_length(num, den)).cast("int").alias("over")).distinct()
    # Of a list that is ``over`` longer than the prefix, the last ``over`` are none of the prefix.
    taken = F.slice("found", 1, F.greatest(F.size("found") - F.col("over"), F.lit(0)))
    return found.join(sizes, "entry").select("entry", F.explode(taken).alias("taken")).select("entry", "taken.gram")


def _sets(n: int, num: int, den: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = TaskContext.get().partitionId() << 36
        for batch in common.slices(batches, share=common.WORDS_SHARE):
            words, at = common.word_hashes(batch.column("text"))
            rows = []
            for i in range(batch.num_rows):
                grams = common.shingle_set(words[at[i]:at[i + 1]], n)
                prefix = common.as_signed(prefix_of(grams, counts.value, num, den))
                bits = bitmap(grams, bitmap_width(len(grams))).tobytes()
                rows.append((entry, *set_digest(grams), len(grams), prefix, bits))
                entry += 1
            sizes = np.cumsum([0, *(len(r[4]) for r in rows)])
            flat = np.concatenate([r[4] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), batch.column("doc_id"),
                 *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)),
                 pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int64())),
                 pa.array([r[5] for r in rows], pa.binary())],
                names=["entry", "doc_id", "fp1", "fp2", "n", "prefix", "bits"])
    return run


class SignatureTree:
    """Levels of nodes over sets: OR of the token bitmaps, sizes from and to, and the slack.

    The slack of a set is its size less its bits, so no more than slack plus
    common bits of its members can be in another set.
    """

    def __init__(self, bits: np.ndarray, size: np.ndarray):
        slack = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, size, size, slack)]
        while len(self.levels[-1][0]) > 1:
            bits, least, most, slack = self.levels[-1]
            first = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, first), np.minimum.reduceat(least, first),
                                np.maximum.reduceat(most, first), np.maximum.reduceat(slack, first)))

    def possible(self, level: int, a: slice, b: slice, num: int, den: int) -> np.ndarray:
        """Whether sets below each node pair can reach the similarity."""
        bits, least, most, slack = self.levels[level]
        common_bits = np.bitwise_count(bits[a][:, None, :] & bits[b][None, :, :]).sum(2).astype(np.int64)
        overlap = np.minimum(slack[a][:, None], slack[b][None, :]) + common_bits
        overlap = np.minimum(overlap, np.minimum(most[a][:, None], most[b][None, :]))
        enough = (num + den) * overlap >= num * (least[a][:, None] + least[b][None, :])
        return (enough & (den * most[a][:, None] >= num * least[b][None, :])
                & (den * most[b][None, :] >= num * least[a][:, None]))


def spanning_links(bits: np.ndarray, size: np.ndarray, num: int, den: int, side: np.ndarray | None = None,
                   linked: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Pairs of row numbers that connect all linked sets, in order of size.

    Without ``linked``, an exact test, a pair counts as linked if its bitmaps
    allow it.  With ``side``, only rows of different sides are paired.
    """
    if len(size) < 2:
        return []
    order = np.argsort(size, kind="stable")
    tree = SignatureTree(bits[order], size[order])
    side = None if side is None else side[order]
    label = np.arange(len(size))
    members = {i: [i] for i in range(len(size))}
    links = []

    def join(i: int, j: int) -> None:
        links.append((int(order[i]), int(order[j])))
        a, b = int(label[i]), int(label[j])
        if len(members[a]) < len(members[b]):
            a, b = b, a
        moved = members.pop(b)
        label[moved] = a
        members[a] += moved

    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        span = FAN ** level
        mine, theirs = label[i * span:(i + 1) * span], label[j * span:(j + 1) * span]
        if mine[0] == theirs[0] and (mine == mine[0]).all() and (theirs == theirs[0]).all():
            continue
        a, b = slice(i * FAN, (i + 1) * FAN), slice(j * FAN, (j + 1) * FAN)
        pairs = tree.possible(level - 1, a, b, num, den)
        if i == j:
            pairs = np.triu(pairs, 1 if level == 1 else 0)
        if level == 1:
            pairs &= mine[:, None] != theirs[None, :]
            if side is not None:
                pairs &= side[a][:, None] != side[b][None, :]
        found = np.argwhere(pairs) + [a.start, b.start]
        if level > 1:
            found = found[np.argsort(found[:, 0] == found[:, 1], kind="stable")]  # a node with itself comes first
            stack += [(level - 1, x, y) for x, y in found.tolist()]
        else:
            for x, y in found.tolist():
                if label[x] != label[y] and (linked is None or linked(int(order[x]), int(order[y]))):
                    join(x, y)
    return links


def _sides(column: pa.ChunkedArray) -> np.ndarray | None:
    side = column.to_numpy()
    return side if len(np.unique(side)) > 1 else None


def _families(num: int, den: int):
    """Pairs of entries whose bitmaps allow a link, as many as connect them."""
    def run(block: pa.Table) -> pa.Table:
        common.handled(block.nbytes)
        block = block.sort_by("entry")
        entry, size, side = block["entry"].to_numpy(), block["n"].to_numpy(), block["side"].to_numpy()
        bits = [np.frombuffer(b, np.uint64) for b in block["bits"].to_pylist()]
        width = np.array([len(b) for b in bits])
        links = []
        for w in np.unique(width).tolist():
            # Sets of the next width that are small enough for a link with this one are folded to it.
            near = (width == w) | ((width == 2 * w) & (num * size <= den * size[width == w].max()))
            rows = np.flatnonzero(near)
            folded = np.stack([bits[r] if width[r] == w else bits[r][:w] | bits[r][w:] for r in rows])
            mine = side[rows] if len(np.unique(side)) > 1 else None
            links += [(rows[x], rows[y]) for x, y in spanning_links(folded, size[rows], num, den, mine)]
        return pa.table({"a": pa.array([entry[x] for x, _ in links], pa.int64()),
                         "b": pa.array([entry[y] for _, y in links], pa.int64())})
    return run


def exact_links(ids: list[int], sets: list[np.ndarray], num: int, den: int,
                side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links by exact comparison that connect all linked sets."""
    if not sets:
        return []

    def linked(i: int, j: int) -> bool:
        inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return den * inter >= num * (len(sets[i]) + len(sets[j]) - inter)

    size = np.array([len(s) for s in sets], np.int64)
    width = bitmap_width(int(size.mean()))
    bits = np.stack([bitmap(s, width) for s in sets])
    return [(ids[i], ids[j]) for i, j in spanning_links(bits, size, num, den, side, linked)]


def _linker(n: int, num: int, den: int):
    def run(block: pa.Table) -> pa.Table:
        common.handled(block.nbytes)
        table = block.sort_by([("doc_id", "ascending"), ("fp1", "ascending")])
        wanted = table["fp2"].to_pylist()
        sets, keep = [], []
        for batch in common.slices(table.select(["text"]).to_batches(), share=common.WORDS_SHARE):
            words, at = common.word_hashes(batch.column("text"))
            for i in range(batch.num_rows):
                grams = common.shingle_set(words[at[i]:at[i + 1]], n)
                keep.append(set_digest(grams)[1] == wanted[len(keep)])  # else another text of a repeated doc_id
                if keep[-1]:
                    sets.append(grams)
        table = table.filter(pa.array(keep, pa.bool_()))
        links = exact_links(table["doc_id"].to_pylist(), sets, num, den, _sides(table["side"]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})
    return run


def _blocks(members: DataFrame, num: int, den: int, block_grams: int) -> DataFrame:
    """``members`` (entry, n, component and more) once for each block they go to, with their side there.

    A component within ``block_grams`` is one block.  A larger one is cut by
    size range (linked sets are in the same or in neighbouring ranges), each
    range by hash into parts of half a block, and every two parts that may hold
    linked sets meet in a block of their own.
    """
    columns = members.columns
    members = members.withColumn("range", F.floor(F.log(F.col("n")) / float(np.log(den / num))).cast("int"))
    ranges = members.groupBy("component", "range").agg(F.sum("n").alias("grams"))
    parts = (ranges.groupBy("component").agg(
        F.sum("grams").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("range", F.ceil(F.col("grams") / (block_grams / 2)).cast("int"))))
        .alias("parts")))  # as many entries as there are size ranges: the logarithm of the longest text
    members = members.join(parts, "component")
    whole = members.where(F.col("total") <= block_grams).withColumn("block", F.lit("")).withColumn("side", F.lit(0))
    large = (members.where(F.col("total") > block_grams)
             .withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")[F.col("range")]).cast("int")))

    def meet(step: int):
        """Blocks with the parts of the range ``step`` away; side 1 for the later part."""
        other = F.col("range") + step
        count = F.coalesce(F.try_element_at("parts", other), F.lit(0))
        own = F.struct(F.col("range").alias("r"), F.col("part").alias("p"))
        return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
                           lambda q: F.struct(
                               F.concat_ws("/", F.least(own, F.struct(other.alias("r"), q.alias("p"))).cast("string"),
                                           F.greatest(own, F.struct(other.alias("r"), q.alias("p"))).cast("string"))
                               .alias("block"),
                               (own > F.struct(other.alias("r"), q.alias("p"))).cast("int").alias("side")))

    large = large.withColumn("to", F.explode(F.concat(meet(-1), meet(0), meet(1))))
    return whole.select(*columns, "block", "side").unionByName(large.select(*columns, "to.block", "to.side"))


def link_groups(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100,
                block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Null and empty texts have no set and stand alone.  Rows that share a doc_id
    are one document.  A row with a null doc_id keeps its row; it has a null
    component and links nothing.  Other columns are not read.
    """
    common.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = common.cut(docs.mapInArrow(_texts(n, num, den), TEXTS))
    known = texts.where("part is null and n > 0 and doc_id is not null").select("entry", "doc_id", "fp1", "fp2", "n")
    left = common.cut(not_alone(texts, num, den))
    # Tables of their own, so that a join with them can split a digest or gram that very many rows share.
    classes = common.cut(known.groupBy("fp1", "fp2").agg(F.min(F.struct("doc_id", "entry")).alias("first"))
                         .select("fp1", "fp2", F.col("first.doc_id").alias("rep"), F.col("first.entry").alias("entry")))
    entries = common.cut(left.join(classes.select("entry"), "entry").select("entry", "doc_id", "fp1", "fp2"))
    own = common.sketched(docs, entries, ["doc_id"])
    counts = docs.sparkSession.sparkContext.broadcast(gram_counts(own, n))  # CELLS bytes
    # Rows that repeat a text of a doc_id give an entry more than one row; all steps allow for it.
    sets = common.cut(own.mapInArrow(_sets(n, num, den, counts), SETS).drop("entry").join(entries, ["doc_id", "fp1", "fp2"]))
    grams = common.cut(prefixes(sets, num, den))
    shared = common.cut(grams.groupBy("gram").agg(F.min("entry").alias("least"), F.count("*").alias("times"))
                        .where("times > 1").drop("times"))
    stars = grams.join(shared, "gram").where("entry != least")
    candidates = connected_components(stars.select(F.col("entry").alias("a"), F.col("least").alias("b")))
    members = sets.select("entry", "n", "bits").join(candidates.withColumnRenamed("node", "entry"), "entry")
    pairs = (_blocks(members, num, den, BITMAP_BLOCK * block_grams).groupBy("component", "block")
             .applyInArrow(_families(num, den), "a long, b long"))
    families = connected_components(pairs).withColumnRenamed("node", "entry")
    members = common.cut(known.join(families, "entry"))
    placed = _blocks(members, num, den, block_grams).select("component", "block", "side", "doc_id", "fp1", "fp2")
    links = (common.sketched(docs, members, ["doc_id"]).join(placed, "doc_id").groupBy("component", "block")
             .applyInArrow(_linker(n, num, den), "a long, b long"))
    rows = known.join(classes.select("fp1", "fp2", "rep"), ["fp1", "fp2"])
    twice = (rows.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b != most"))
    again = rows.join(twice.select("doc_id", "b"), "doc_id").select(F.col("rep").alias("a"), "b")
    found = connected_components(links.unionByName(again))
    linked = rows.join(found, F.col("rep") == F.col("node"), "left").select(
        "entry", F.coalesce("component", "rep").alias("component_id"))
    return (texts.where("part is null").select("entry", "doc_id", "n").join(linked, "entry", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id")))


def op6_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_groups(common.read_table(spark, sf_dir, "documents"))
