"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Which rows meet at all follows from the pigeonhole principle. Linked sets of a band of sizes
and the next differ in d shingles at most, so of d + 1 or more parts of the hash range one
holds the same shingles in both sets. A part's key is the hash of what the set has there, a
handful of shingles at once. There are some parts more than that, so that those with few
shingles need not give keys: a single common shingle would bring together a share of all
rows, however large the corpus. Any division into parts misses no link; so that passages which
many rows share don't bring them all together, shingles that stand out in a table of hashed
counts over all documents are moved to the range's first parts. The table is of fixed size:
in a larger corpus fewer shingles stand out, but keys still are of several shingles. Sets
with so many parts without a key that all agreeing ones may be among them also get the keys of
a division whose parts need fewer shingles, and at last a prefix of single shingles, those
that stand out last: of linked sets either both do or they already share a key.

Keys are shuffled in blocks by ranges of their hashes, five bytes and a small difference of row
numbers each, as nearly all of them occur once.

Rows that share keys form groups, and groups are put in tiles of bounded weight. A tile
bounds each pair's overlap from above by the counts of differing bits of hashed bitmaps and
by the sizes; what passes is intersected exactly as sorted arrays, and a link is confirmed
on the words themselves. Rows already connected are passed over, so a tile gives at most one
link a row. A group over one tile's weight is first dealt to tiles at random, twice, which
connects what is close; only rows that are still apart meet again, in tiles for each two
blocks of the same or neighbouring bands of sizes. Links are joined to components afterwards.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_lists, prepare, small, stage, table, unused
from .components import components, partitions_for
from .hashes import mix, run_hashes

#: Keys that a task combines at once, and that a bucket of the shuffle is meant to hold at most.
COMBINED_KEYS = 1 << 20
#: Bits of a key that are kept within its bucket.
KEY_BITS = 40
#: The most shingles that a part may need to give a key; how much less telling a key is with each shingle less, and what it costs to have one.
MOST_NEEDED = 4
COMMON, KEY_COST = 0.05, 0.0005
#: Shingles of a tile, and what a row counts for at least.
TILE_SHINGLES = 1 << 18
LEAST_WEIGHT = 128
#: Places of the table of counts, and the part of the hash range that shingles which stand out are moved to (as a shift).
PLACES = 1 << 20
HOT_SHIFT = 4
#: Places whose counts are one record.
BLOCK = 1 << 14
#: The fewest bits of a bitmap.
BITMAP_BITS = 1024
#: Of a row and others of its tile, gives those that it may link with.
Bound = Callable[[int, np.ndarray], np.ndarray]


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lowered; fewer words make one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(run_hashes(words, min(size, len(words)))[0])


def shingle_words(text: bytes, size: int) -> set[bytes]:
    """The shingles of a text as words."""
    words = text.lower().split()
    size = min(size, len(words))
    return {b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)}


@cache
def band_bounds(num: int, den: int, most: int = 1 << 40) -> list[int]:
    """First sizes of the bands: sets that link are in the same band or the next."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-out[-1] * den // num)))
    return out


@cache
def parts_of(family: int, num: int, den: int) -> tuple[int, list[tuple[np.ndarray, int]]]:
    """Of a family (a band and the one below): how many shingles linked sets may differ in, and divisions as (the parts' first hashes, shingles that a part needs to give a key).

    A key is the less telling the fewer shingles it stands for, so the first division's parts
    need most. More parts than differences leave room for some without a key; a set that
    has more of those takes the next division too, and after the last one single shingles.
    What keys of few shingles cost is weighed for sets of the family's sizes, whole and with
    a part of their shingles moved.
    """
    bounds = band_bounds(num, den)
    low, high = bounds[max(0, family - 2)], bounds[family] - 1
    differ = 2 * high * (den - num) // (den + num)
    sizes = [(n, share) for n in (low, (low + high) // 2, high) for share in (1.0, 0.85)]

    def costs(parts: int, needed: int, after: list[float]) -> list[float]:
        out = []
        for (n, share), otherwise in zip(sizes, after, strict=True):
            x = n * share / parts
            of = [math.exp(-x) * x**k / math.factorial(k) for k in range(MOST_NEEDED + 4)]
            weak = parts * sum(of[:needed])
            room = parts - differing(n, differ, num, den) - 0.5
            without = 0.5 * math.erfc((room - weak) / math.sqrt(2 * weak + 1e-9))
            out.append(parts * sum(o * COMMON**k for k, o in enumerate(of) if k >= needed) + without * otherwise + parts * KEY_COST)
        return out

    best = [(n - -(-n * num // den) + 1) * COMMON for n, _ in sizes]
    most, chosen = (differ // 2 + 3 if differ else 1), []
    for needed in range(1, MOST_NEEDED + 1 if differ else 2):
        tried = [(costs(differ + 1 + k, needed, best), differ + 1 + k) for k in range(0, most, 1 + most // 48)]
        found, parts = min(tried, key=lambda t: sum(t[0]))
        if sum(found) < sum(best) or not chosen:
            best = found
            chosen.insert(0, (np.array([(p << 64) // parts for p in range(parts)], dtype=np.uint64), needed))
    return differ, chosen


def differing(n: int, differ: int, num: int, den: int) -> int:
    """How many shingles a set of n may differ in from one that it links with, where a family's sets may in differ."""
    return min(differ, n * (den - num) // num)


def stands_out(docs: DataFrame, size: int) -> np.ndarray:
    """For each place of the hashed counts, packed: whether shingles there are more than chance brings together. docs(text)."""

    def blocks(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
        packed = [zlib.compress(t.astype("<i8"), 1) for t in totals.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])

    def count(batches):
        total = np.zeros(PLACES, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                words = text.lower().split() if text else []
                if words:
                    own = run_hashes(words, min(size, len(words)))[0]
                    np.add.at(total, (own & np.uint64(PLACES - 1)).astype(np.int64), 1)
        yield blocks({k: t for k, t in enumerate(total.reshape(-1, min(BLOCK, PLACES))) if t.any()})

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[block] = totals.get(block, 0) + np.frombuffer(zlib.decompress(counts), dtype="<i8")
        yield blocks(totals)

    schema = "block int, counts binary"
    found = docs.mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).toArrow()  # PLACES counts
    total = np.zeros((max(1, PLACES // BLOCK), min(BLOCK, PLACES)), dtype=np.int64)
    for block, counts in zip(found["block"].to_pylist(), found["counts"].to_pylist(), strict=True):
        total[block] = np.frombuffer(zlib.decompress(counts), dtype="<i8")
    usual = float(np.median(total))
    return np.packbits(total.ravel() > usual + 4 * math.sqrt(usual) + 8)


def moved(own: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Sorted hashes with those that stand out in the first part of the range."""
    place = (own & np.uint64(PLACES - 1)).astype(np.int64)
    out = (hot[place >> 3] >> (7 - (place & 7))) & 1 > 0
    return np.sort(np.where(out, own >> np.uint64(HOT_SHIFT), own))


def part_keys(own: np.ndarray, num: int, den: int) -> np.ndarray:
    """A set's keys: linked sets share one. Of sorted hashes, the last are the first choice where single ones are keys."""
    n = len(own)
    if n == 0:
        return own
    band = int(np.searchsorted(band_bounds(num, den), n, "right"))
    sums, out = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(own))]), []
    for family in (band, band + 1):
        differ, divisions = parts_of(family, num, den)
        for firsts, needed in divisions:
            at = np.append(np.searchsorted(own, firsts), n)
            full = at[1:] - at[:-1] >= needed
            tag = mix(np.arange(len(firsts), dtype=np.uint64) + np.uint64((family << 8 | needed) << 32))
            out.append(mix((sums[at[1:]] - sums[at[:-1]]) ^ tag)[full])
            if int(full.sum()) > differing(n, differ, num, den):  # an agreeing part is among them
                break
        else:
            out.append(mix(own[-(-n * num // den) - 1 :] ^ mix(np.array([(family << 40) - 1], dtype=np.uint64))))
    return np.concatenate(out)


def bitmap(own: np.ndarray) -> np.ndarray:
    """A set's hashed bits, twice as many as it has members at least, so that long texts' maps say something too."""
    size = max(BITMAP_BITS, 1 << (2 * len(own) - 1).bit_length()) if len(own) else BITMAP_BITS
    bits = np.zeros(size, dtype=bool)
    bits[(own & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Maps as rows of one matrix: longer ones folded to the shortest one's bits."""
    least = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, least), axis=0) for m in maps]).view(np.uint64)


def overlaps(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted array with others."""
    flat = np.concatenate(others)
    met = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    return np.add.reduceat(met.astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in others])[:-1]]))


def bitmap_bound(sets: list[np.ndarray], carried: list, num: int, den: int) -> Bound:
    """Which of a tile's rows may link with row x, by the differing bits of their bitmaps."""
    sizes, maps = np.array([len(s) for s in sets]), folded([bitmap(s) for s in sets])

    def may_link(x: int, near: np.ndarray) -> np.ndarray:
        differing = np.bitwise_count(maps[near] ^ maps[x]).sum(axis=1, dtype=np.int64)
        return near[differing * (den + num) <= (sizes[near] + sizes[x]) * (den - num)]

    return may_link


def link_tile(nodes: list[int], labels: list[int], blocks: list[str], texts: list[bytes], num: int, den: int, size: int, every: bool = False, bound=bitmap_bound, carried: list | None = None) -> list[tuple[int, int]]:
    """Links of a tile's rows, each confirmed: at most one a row, of rows of different labels; with every, all.

    Rows meet those of other blocks, or, in a tile without blocks (empty strings), all others.
    bound(sets, carried, num, den) says which may link before sets are intersected; carried
    is what the rows bring along for it.
    """
    sets = [shingle_set(t, size) for t in texts]
    order = sorted(range(len(nodes)), key=lambda k: (len(sets[k]), nodes[k]))
    sets, nodes, texts = [sets[k] for k in order], [nodes[k] for k in order], [texts[k] for k in order]
    sizes = np.array([len(s) for s in sets])
    may_link = bound(sets, [carried[k] for k in order] if carried else [], num, den)
    label = np.unique([labels[k] for k in order], return_inverse=True)[1]
    block = np.unique([blocks[k] for k in order], return_inverse=True)[1]
    crossed, links = blocks[0] != "", []
    for x in range(len(nodes) - 1):
        near = np.arange(x + 1, int(np.searchsorted(sizes, sizes[x] * den // num, "right")))
        if crossed:
            near = near[block[near] != block[x]]
        if not every:
            near = near[label[near] != label[x]]
        near = may_link(x, near)
        if not len(near):
            continue
        both = overlaps(sets[x], [sets[y] for y in near])
        mine = None
        for y in near[den * both >= num * (sizes[near] + sizes[x] - both)].tolist():
            if not every and label[y] == label[x]:
                continue
            mine = shingle_words(texts[x], size) if mine is None else mine
            other = shingle_words(texts[y], size)
            shared = len(mine & other)
            if den * shared >= num * (len(mine) + len(other) - shared):
                label[label == label[y]] = label[x]
                links.append((nodes[x], nodes[y]))
    return links


def as_stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs that connect what links connect, each node with the least that it reaches."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    return [(root(x), x) for x in above if root(x) != x]


def jaccard_groups(docs: DataFrame, num: int = 90, den: int = 100, size: int = 3, id_col: str = "doc_id", text_col: str = "text", with_links: bool = False) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id, head, row_no, text_hash, again; n_links if asked for.

    Two rows link when den * |A and B| >= num * |A or B| for their sets of word shingles
    (A-Z lowered, words between ASCII white space; fewer than size words make one
    shingle). component_id is the least id that links reach; head marks one row of each
    component, which has that id. A text that is null or has no words has an empty set and
    its own component. Rows that repeat an id are rows of their own; null ids are passed
    over unless a component has no other. Texts are read whole. An empty table gives no
    rows; other columns are ignored, whatever their names. n_links counts the other rows
    that a row links with; for it every pair of different sets that the bounds let through
    is verified. again marks rows that have the id and the text of their component's head
    and are not it.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))

    hot = docs.sparkSession.sparkContext.broadcast(stands_out(own.select("text"), size))

    def signatures(batches):
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            keys = [part_keys(moved(s, hot.value), num, den).view(np.int64) for s in sets]
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate([*keys, np.empty(0, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                    batch.column(2),
                ],
                names=["id", "n", "print", "keys", "h"],
            )

    keyed = own.mapInArrow(signatures, f"id {kind}, n long, print binary, keys array<long>, h long")
    tile = partial(link_tile, num=num, den=den, size=size)
    return groups_by_keys(own, keyed, lambda rows: rows.select("row", "keys"), tile, num, den, id_col, with_links)


def groups_by_keys(own: DataFrame, keyed: DataFrame, keys_of: Callable[[DataFrame], DataFrame], tile: Callable, num: int, den: int, id_col: str, with_links: bool = False, carry: str | None = None) -> DataFrame:
    """What jaccard_groups gives: own(id, text, h), keyed(id, n, print, h, ...) with what keys_of makes (row, keys) from.

    tile is link_tile with its parameters; carry names a column of keyed that it gets for
    each row. Rows of equal prints are taken for equal sets: prints are 128-bit digests of
    the 64-bit hashes that sets hold.
    """
    spark = own.sparkSession
    keyed = stage(keyed.withColumn("row", F.monotonically_increasing_id()), "join-sets")
    sets = keyed.select("row", "id", "n", "print", "h", *([carry] if carry else []))  # the scan leaves out the rest
    sets = sets if carry else stage(sets, "join-rows")  # keys go as soon as they have been read
    n_rows = sets.count()

    with partitions_for(spark, n_rows):  # narrow rows from here on, but for keys and tiles
        # equal sets are one: rows of a repeated set point to its first row
        prints = sets.where("print IS NOT NULL").groupBy("print").agg(F.min("row").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
        # aggregates are written before they are joined, so that Spark can split the other side's hot keys
        prints = stage(prints, "join-prints")
        same = stage(sets.select("row", "print").join(prints, "print").where("row <> rep").select("row", "rep"), "join-same")
    alone = keyed.join(small(same.select("row")), "row", "left_anti")
    near = _near(keys_of(alone))
    if not carry:
        discard(keyed)
    links = _links(own, sets, near, tile, num, den, with_links, carry)
    joined = components(links)

    with partitions_for(spark, n_rows):
        rep = sets.select("row", "id", "n", "h").join(small(same), "row", "left").withColumn("rep", F.coalesce("rep", "row"))
        joined = small(joined.select(F.col("node").alias("rep"), "root"))
        rooted = rep.join(joined, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        if with_links:
            copies = prints.select("rep", "copies")
            ends = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(copies, F.col("b") == F.col("rep"), "left")
            ends = ends.groupBy(F.col("a").alias("rep")).agg(F.sum(F.coalesce("copies", F.lit(1))).alias("others"))
            rooted = rooted.join(stage(ends, "join-ends"), "rep", "left").join(copies, "rep", "left")
            rooted = rooted.withColumn("n_links", F.coalesce("others", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1)
        more = ["n_links"] if with_links else []
        rooted = stage(rooted.select("row", "id", "n", "h", "root", *more), "join-rooted")
        groups = stage(rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id"), F.col("row"), F.col("h"))).alias("first")), "join-firsts")
    discard(keyed if carry else sets, prints, same, near, links)
    out = rooted.join(groups, "root")
    head = F.col("row") == F.col("first.row")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("first.id").alias("component_id"),
        head.alias("head"),
        F.col("row").alias("row_no"),
        F.col("h").alias("text_hash"),
        (~head & F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))).alias("again"),
        *more,
    )


def _near(keyed: DataFrame) -> DataFrame:
    """near(node, root), written, of the rows that share keys, directly or through others: keyed(row, keys).

    A key's rows are joined to the least of them. Each task first does so with the rows that
    it has itself and passes on the least, so that a key of very many rows is a row a task
    for the shuffle. Keys go to buckets by their first bits, and a bucket's keys that a task
    has combined are one record. Keys of a bucket that agree in KEY_BITS are taken for equal;
    that may bring rows together which share none, about once a bucket.
    """
    spark = keyed.sparkSession
    held = keyed.agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = min(1 << 16, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // COMBINED_KEYS)))
    width, kept = KEY_BITS // 8, np.uint64((1 << KEY_BITS) - 1)

    def least_of(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, its least row, pairs of least rows and others)."""
        order = np.lexsort((row, key))
        row, key = row[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        least = row[new][np.cumsum(new) - 1]
        return key[new], row[new], np.unique(np.stack([least[~new], row[~new]], axis=1), axis=0)

    def combine(batches):
        rows, keys, held = [], [], 0

        def flush():
            row = np.repeat(np.concatenate(rows), np.concatenate([np.diff(a) for a, _ in keys]))
            key, row, pairs = least_of(np.concatenate([k for _, k in keys]).view(np.uint64), row)
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((row, bucket))
            key, row, bucket = key[order] & kept, row[order], bucket[order]
            at = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)).tolist()
            flat = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
            found = [(int(bucket[a]), flat[a:b].tobytes(), zlib.compress(np.diff(row[a:b], prepend=0).astype("<i8"), 1), None) for a, b in zip(at[:-1], at[1:], strict=True)]
            if len(pairs):
                found.append((int(pairs[0, 0] % buckets), b"", zlib.compress(b"", 1), zlib.compress(pairs.astype("<i8").tobytes(), 1)))
            for k in range(0, len(found), 64):
                columns = list(zip(*found[k : k + 64], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["bucket", "keys", "rows", "pairs"])

        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy()
            if at[-1] == at[0]:
                continue
            rows.append(batch.column(0).to_numpy())
            keys.append((at, lists.values.to_numpy()[at[0] : at[-1]]))
            held += int(at[-1] - at[0])
            if held >= COMBINED_KEYS:
                yield from flush()
                rows, keys, held = [], [], 0
        if held:
            yield from flush()

    def join(batches):
        now, keys, rows = None, [], []

        def pairs_of(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        def settled():
            flat = np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(-1, width)
            key = np.zeros((len(flat), 8), dtype=np.uint8)
            key[:, :width] = flat
            row = [np.cumsum(np.frombuffer(zlib.decompress(r), dtype="<i8")) for r in rows]
            if len(flat):
                yield pairs_of(least_of(key.view("<u8")[:, 0], np.concatenate(row))[2])

        for batch in batches:
            for bucket, some, theirs, pairs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != now:
                    yield from settled()
                    now, keys, rows = bucket, [], []
                if pairs is not None:
                    yield pairs_of(np.frombuffer(zlib.decompress(pairs), dtype="<i8").reshape(-1, 2))
                keys.append(some)
                rows.append(theirs)
        yield from settled()

    met = keyed.mapInArrow(combine, "bucket int, keys binary, rows binary, pairs binary").repartition("bucket").sortWithinPartitions("bucket")
    near = components(met.mapInArrow(join, "a long, b long"))
    with_roots = F.explode(F.array(F.struct("node", "root"), F.struct(F.col("root").alias("node"), "root")))
    with partitions_for(spark, near.count()):
        return stage(near.select(with_roots.alias("x")).select("x.*").distinct(), "join-near")


def _links(own: DataFrame, sets: DataFrame, near: DataFrame, tile: Callable, num: int, den: int, every: bool, carry: str | None = None) -> DataFrame:
    """links(a long, b long), written, among the rows of near(node, root)."""
    bounds = F.array(*[F.lit(b) for b in band_bounds(num, den)])
    member = near.join(sets.select(F.col("row").alias("node"), "id", "h", "n", *([carry] if carry else [])), "node")
    member = member.withColumn("band", F.size(F.filter(bounds, lambda b: b <= F.col("n"))))
    member = stage(member.withColumn("weight", F.greatest("n", F.lit(LEAST_WEIGHT)) / TILE_SHINGLES), "join-members")

    with partitions_for(own.sparkSession, near.count()):
        whole = stage(member.groupBy("root").agg(F.sum("weight").alias("all")), "join-wholes")
    large = whole.where("all > 1").select("root", F.ceil("all").alias("tiles"))  # at most a row a tile's weight
    bins = max(1, math.ceil(whole.agg(F.sum("all")).first()[0] or 0))
    few, most = member.join(small(large.select("root")), "root", "left_anti"), member.join(small(large), "root")
    placed = few.withColumn("tile", F.concat(F.lit("bin "), F.pmod(F.xxhash64("root"), F.lit(bins))))
    placed = placed.withColumn("label", F.col("node")).withColumn("block", F.lit(""))
    if not every:
        for salt in (1, 2):
            dealt = most.withColumn("tile", F.concat_ws(" ", F.lit(f"deal {salt}"), "root", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("tiles"))))
            placed = placed.unionByName(dealt.withColumn("label", F.col("node")).withColumn("block", F.lit("")).select(*placed.columns))
    links = stage(_in_tiles(own, placed, tile, every, carry), "join-links")
    if large.limit(1).count():
        joined = components(links)
        apart = most.join(joined, most["node"] == joined["node"], "left").select(most["*"], F.coalesce(joined["root"], most["node"]).alias("label"))
        with partitions_for(own.sparkSession, near.count()):
            crossed = stage(_crossed(stage(apart, "join-apart"), every), "join-crossed")
        late = stage(_in_tiles(own, crossed, tile, every, carry), "join-late")
        links = stage(links.unionAll(late), "join-links")
    discard(member, whole)
    return links


def _crossed(member: DataFrame, every: bool) -> DataFrame:
    """Tiles for the pairs of different labels in a large group: member(root, label, band, weight, ...) with tile and block.

    A label of a tile's weight or more is a class of its own, the others are one class. A
    class's band is cut into blocks; each two blocks of a band or of neighbouring ones make
    a tile, unless they are of one label.
    """
    classes = member.groupBy("root", "label").agg(F.sum("weight").alias("w"))
    classes = classes.withColumn("class", F.when(F.lit(not every) & (F.col("w") >= 1), F.col("label")).otherwise(-1))
    mixed = classes.groupBy("root").agg(F.count("*").alias("labels")).where("labels > 1").select("root")
    classes = stage(classes.join(mixed, "root").select("root", "label", "class"), "join-classes")
    member = stage(member.join(classes, ["root", "label"]), "join-classed")
    cells = stage(member.groupBy("root", "band", "class").agg(F.ceil(F.sum("weight")).cast("int").alias("blocks")), "join-cells")
    seen = cells.select("root", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("from"), F.struct("band", "class", "blocks").alias("cell"))
    seen = stage(seen.groupBy("root", F.col("from").alias("band")).agg(F.collect_list("cell").alias("cells")), "join-seen")
    own = member.join(cells, ["root", "band", "class"])
    own = own.withColumn("block", F.concat_ws(":", "band", "class", F.pmod(F.xxhash64("node"), F.col("blocks")))).drop("blocks")
    other = F.explode(F.expr("flatten(transform(filter(cells, c -> c.class <> class OR class = -1), c -> transform(sequence(0, c.blocks - 1), j -> concat_ws(':', c.band, c.class, j))))"))
    tiles = own.join(seen, ["root", "band"]).withColumn("other", other)
    tiles = tiles.withColumn("tile", F.concat_ws(" ", F.lit("cross"), "root", F.least("block", "other"), F.greatest("block", "other")))
    return tiles.withColumn("block", F.when(F.col("block") == F.col("other"), "").otherwise(F.col("block"))).drop("cells", "other", "class")


def _in_tiles(own: DataFrame, placed: DataFrame, tile: Callable, every: bool, carry: str | None = None) -> DataFrame:
    """Links of the rows placed(id, h, node, root, label, block, tile), whose texts come from own(id, h, text); without every, pairs that connect the same rows."""

    def link(group: pa.Table) -> pa.Table:
        roots: dict[int, dict] = {}
        columns = [group.column(c).to_pylist() for c in ("node", "root", "label", "block")]
        carried = group.column(carry).to_pylist() if carry else [None] * len(group)
        for node, root, label, block, text, more in zip(*columns, group.column("text").cast(pa.binary()).to_pylist(), carried, strict=True):
            roots.setdefault(root, {})[node] = (label, block, text, more)  # a row that repeats with its id comes once
        pairs = []
        for rows in roots.values():
            if len(rows) > 1:
                labels, blocks, texts, more = map(list, zip(*rows.values(), strict=True))
                found = tile(list(rows), labels, blocks, texts, every=every, carried=more if carry else None)
                pairs += found if every else as_stars(found)
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    more = [carry] if carry else []
    placed = stage(placed.select("id", "h", "node", "root", "label", "block", "tile", *more), "join-tiles")
    filled = join_lists(own, placed).select("tile", "node", "root", "label", "block", "text", *more)
    return filled.groupBy("tile").applyInArrow(link, "a long, b long")


def near_dedup(docs: DataFrame, num: int = 90, den: int = 100, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of jaccard_groups, all columns as they were.

    A row is judged by its id and text, so rows that repeat an id, or have none, stand or
    fall by themselves; of rows that repeat both, one at most stays.
    """
    groups = jaccard_groups(docs, num, den, size, id_col, text_col)
    names = i, of, re, h = [unused(docs, x) for x in ("gone_id", "gone_hash", "gone_again", "own_hash")]
    gone = groups.where("NOT head").select(F.col(id_col).alias(i), F.col("text_hash").alias(of), F.col("again").alias(re))
    gone = stage(gone.distinct(), "join-gone")
    marked = docs.withColumn(h, F.xxhash64(F.col(text_col).cast("string")))
    key = F.col(id_col).eqNullSafe(F.col(i)) & (F.col(h) == F.col(of))
    kept = marked.join(small(gone.where(~F.col(re))), key, "left_anti")
    again = gone.where(F.col(re))
    n_again = again.count()
    if n_again == 0:
        return kept.drop(*names)
    # rows repeated with their id: one of each stays
    again = small(again, n_again)
    once = marked.join(again, key, "left_semi").dropDuplicates([id_col, h])
    return kept.join(again, key, "left_anti").unionByName(once).drop(*names)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component at a similarity of 0.9 over three-word shingles."""
    return jaccard_groups(table(spark, sf_dir, "documents")).drop("head", "row_no", "text_hash", "again")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) r USING (doc_id)
"""
