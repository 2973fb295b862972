"""Similarity join on word shingles by chosen paths.

Texts with equal shingle sets are one class; the join runs over classes.  In each of a few
independent runs a tree splits the classes: a bucket picks ``BRANCHES`` of the minimum
hashes by its own path, and every member goes to a child bucket per picked hash, named by
the hash's value, so sets that share the sampled token stay together.  Buckets with one
member end, small ones are compared, and so are those into which half of the bucket above
came along, as their members are alike; other large ones are split again.  A pair of similarity s
meets in a child with probability 1 - (1 - s)**BRANCHES; down a tree of any depth it meets
with at least the fixed point of q = 1 - (1 - s q)**BRANCHES, which gives the number of
runs for a target recall.  What is still large at the last level is compared too, in
blocks, so no bucket is capped.

In a bucket 8-bit sketches are compared by brute force, and those that may be similar are
linked to the least of their group.  The groups so linked are small islands of like texts;
there the shingle sets themselves are compared, in pairs of blocks, and the exact links of
every class are counted and joined to components.  No pair leaves a task: only counts, and
one edge per class and block.

Results for special rows: null and empty texts, and texts without a word, have no shingles,
no links and a class of their own; a text of fewer than five words has one shingle, all its
words; equal rows are copies of each other; rows with a null key take part, and classes are
named by the least key that is not null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import attach, bound_batches, settled, slices, spread_free
from .components import components
from .membership import may_be_among

#: Similarity as a fraction, so that comparing is exact.
SIMILARITY = (4, 5)
RECALL = 0.9995
BRANCHES = 2
#: Buckets of more members are split again, up to this depth.
SPLIT_ABOVE = 1024
MAX_DEPTH = 12
#: Members of a block of sketches, and of texts; a task compares two blocks.  A bucket that
#: is not split again is one block, so no member is sent twice.
SKETCH_BLOCK = SPLIT_ABOVE
TEXT_BLOCK = 128
#: Shingles of a block of texts.
BLOCK_SHINGLES = 400_000
#: A sketch estimate so many standard deviations below the similarity still counts.
SLACK = 4.5


def runs_for(similarity: float, recall: float) -> int:
    q = 1.0
    for _ in range(1000):
        q = 1 - (1 - similarity * q) ** BRANCHES
    return max(1, ceil(log(1 - recall) / log(1 - q)))


# --- classes ----------------------------------------------------------------------------


def marked(text: Column | str) -> Column:
    """Struct of set (16 bytes), n (its size) and mins (minimum hashes) of a text."""

    bound_batches()

    @F.arrow_udf("struct<set: binary, n: int, mins: binary>")
    def mark(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ids: list[bytes] = []
            sizes: list[int] = []
            mins: list[bytes] = []
            for texts in slices(batch):
                sets = shingles.shingle_sets(texts)
                ids += shingles.set_ids(sets)
                sizes += map(len, sets)
                raw = shingles.minimum_hashes(sets).astype("<u4").tobytes()
                width = 4 * shingles.HASHES
                mins += [raw[i : i + width] for i in range(0, len(raw), width)]
            yield pa.StructArray.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(mins, pa.binary())],
                ["set", "n", "mins"],
            )

    return mark(text)


# --- the tree ---------------------------------------------------------------------------


def children(node: Column | str, mins: Column | str) -> Column:
    """Child buckets of a member: per picked hash a name made of path, place and value."""

    @F.arrow_udf("array<long>")
    def split(nodes: pa.Array, mins: pa.Array) -> pa.Array:
        path = nodes.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        table = np.frombuffer(b"".join(mins.to_pylist()), "<u4").reshape(len(path), -1)
        width = np.uint64(shingles.HASHES)
        first = shingles.mix(path)
        # BRANCHES different places: a start and an odd step
        step = shingles.mix(first) | np.uint64(1)
        found = np.empty((len(path), BRANCHES), np.uint64)
        for b in range(BRANCHES):
            at = (first + np.uint64(b) * step) % width
            value = table[np.arange(len(path)), at.astype(np.int64)].astype(np.uint64)
            found[:, b] = shingles.mix(shingles.mix(path ^ shingles.mix(at)) ^ value)
        flat = pa.array(found.view(np.int64).ravel(), pa.int64())
        stops = pa.array(np.arange(len(path) + 1) * BRANCHES, pa.int32())
        return pa.ListArray.from_arrays(stops, flat)

    return split(node, mins)


def buckets(classes: DataFrame, runs: int, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(node, n, set) of all buckets to compare, with their number of members."""
    # a run starts from a node of its own
    level = classes.select(
        F.explode(F.sequence(F.lit(1).cast("long"), F.lit(runs).cast("long"))).alias("node"),
        F.lit(classes.count()).cast("long").alias("parent"),
        "set",
        "mins",
    )
    hashed = classes.select("set", "mins", F.xxhash64("set").alias("_hash"))
    closed: list[DataFrame] = []
    for depth in range(1, MAX_DEPTH + 1):
        # no array is empty; the outer form spares Spark's own test for that
        split = F.explode_outer(children("node", "mins")).alias("node")
        rows = settled(level.select(split, "set", "parent"), "nodes")
        sizes = settled(
            rows.groupBy("node")
            .agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent"))
            .where("n > 1"),
            "sizes",
        )
        met = settled(
            attach(
                rows.drop("parent"), sizes, "node", "n", ["set"], F.struct("n", "parent"), "of"
            )
            .where("of IS NOT NULL")
            .select("node", "set", "of.n", "of.parent"),
            "met",
        )
        # half of the bucket above came along: its members are alike, and splitting them
        # again would send them to more buckets without making these much smaller
        done = (F.col("n") <= split_above) | (F.col("n") * 2 >= F.col("parent"))
        if depth == MAX_DEPTH:
            done = F.lit(True)
        closed.append(met.where(done).drop("parent"))
        large = met.where(~done).select("node", "set", F.col("n").alias("parent"))
        if large.limit(1).count() == 0:
            break
        some = large.select(F.xxhash64("set").alias("_member")).distinct()
        near = may_be_among(hashed, "_hash", some, "_member", "_near")
        level = large.join(near.where("_near").select("set", "mins"), "set")
    found = closed[0]
    for more in closed[1:]:
        found = found.unionByName(more)
    return found


# --- comparing in blocks ----------------------------------------------------------------


def block_pairs(rows: DataFrame, key: Column, blocks: Column) -> DataFrame:
    """``rows`` once for every pair of blocks that theirs is part of: ``pair`` names the
    pair, ``block`` the row's own block, ``alone`` says that the pair is one block twice."""
    cut = rows.withColumn("_blocks", blocks.cast("long")).withColumn(
        "block", F.pmod(F.xxhash64("set", F.lit(7)), F.col("_blocks"))
    )
    each = cut.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    low, high = F.least("block", "_other"), F.greatest("block", "_other")
    return (
        each.withColumn("pair", F.xxhash64(key, low, high))
        .withColumn("alone", F.col("block") == F.col("_other"))
        .drop("_blocks", "_other")
    )


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups of equal first column of batches that are sorted by it."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        keys = table.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist()
        for begin, end in zip(starts[:-1], starts[1:], strict=True):
            yield table.slice(begin, end - begin)
        rest = table.slice(starts[-1]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def stars(like: np.ndarray) -> list[tuple[int, int]]:
    """(member, least member) for the components of a symmetric matrix, others left out."""
    n = len(like)
    seen = np.zeros(n, bool)
    found = []
    linked = like.any(axis=1)
    for i in np.flatnonzero(linked).tolist():
        if seen[i]:
            continue
        group = np.zeros(n, bool)
        group[i] = True
        front = group
        while front.any():
            front = like[front].any(axis=0) & ~group
            group = group | front
        seen |= group
        found += [(j, i) for j in np.flatnonzero(group).tolist() if j != i]
    return found


EDGE = "u binary, v binary"


def _sketch_links(least_matches: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_u: list[bytes] = []
        out_v: list[bytes] = []
        for group in grouped(batches):
            if group.num_rows < 2:
                continue
            order = group.sort_by("set")
            sets = order.column("set").to_pylist()
            block = order.column("block").to_numpy()
            sketch = np.frombuffer(b"".join(order.column("sketch").to_pylist()), np.uint8)
            sketch = sketch.reshape(len(sets), -1)
            like = np.zeros((len(sets), len(sets)), bool)
            for i in range(len(sets)):
                like[i] = (sketch == sketch[i]).sum(axis=1) >= least_matches
            if not bool(order.column("alone")[0].as_py()):
                like &= block[:, None] != block[None, :]
            np.fill_diagonal(like, False)
            for j, i in stars(like):
                out_u.append(sets[j])
                out_v.append(sets[i])
            if len(out_u) >= 10_000:
                yield pa.RecordBatch.from_pydict(
                    {"u": pa.array(out_u, pa.binary()), "v": pa.array(out_v, pa.binary())}
                )
                out_u, out_v = [], []
        if out_u:
            yield pa.RecordBatch.from_pydict(
                {"u": pa.array(out_u, pa.binary()), "v": pa.array(out_v, pa.binary())}
            )

    return link


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of every pair of ascending sets."""
    n = len(sets)
    out = np.zeros((n, n), np.int64)
    if n <= 3:
        for i in range(n):
            for j in range(i):
                both = np.intersect1d(sets[i], sets[j], assume_unique=True)
                out[i, j] = out[j, i] = len(both)
        np.fill_diagonal(out, [len(s) for s in sets])
        return out
    values, which, count = np.unique(
        np.concatenate(sets), return_inverse=True, return_counts=True
    )
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    # an element of one set is common to nobody; one of all sets is common to all
    some = (count[which] > 1) & (count[which] < n)
    out += int((count == n).sum())
    place = np.cumsum((count > 1) & (count < n)) - 1
    column, owner = place[which[some]], owner[some]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [begin, begin + 4096])
        dense = np.zeros((n, 4096), np.float32)
        dense[owner[a:b], column[a:b] - begin] = 1
        out += (dense @ dense.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


LINK = "set binary, links long, partners long, u binary"


def _exact_links(above: int, below: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            # rows of equal key and text are there twice; another text may have the key
            texts = [t or "" for t in group.column("text").to_pylist()]
            sets = shingles.shingle_sets(texts)
            wanted = group.column("set").to_pylist()
            first: dict[bytes, int] = {}
            for i, (got, want) in enumerate(zip(shingles.set_ids(sets), wanted, strict=True)):
                if got == want:
                    first.setdefault(got, i)
            names = sorted(first)
            if len(names) < 2:
                continue
            at = [first[x] for x in names]
            sets = [sets[i] for i in at]
            block = group.column("block").to_numpy()[at]
            copies = group.column("copies").to_numpy()[at]
            size = np.array([len(s) for s in sets])
            common = common_counts(sets)
            union = size[:, None] + size[None, :] - common
            like = common * below >= above * union
            if not bool(group.column("alone")[0].as_py()):
                like &= block[:, None] != block[None, :]
            np.fill_diagonal(like, False)
            least = dict(stars(like))
            links = like @ copies
            partners = like.sum(axis=1)
            some = np.flatnonzero(partners).tolist()
            yield pa.RecordBatch.from_pydict(
                {
                    "set": pa.array([names[i] for i in some], pa.binary()),
                    "links": pa.array(links[some], pa.int64()),
                    "partners": pa.array(partners[some], pa.int64()),
                    "u": pa.array([names[least.get(i, i)] for i in some], pa.binary()),
                }
            )

    return link


# --- the join ---------------------------------------------------------------------------


def similar(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: tuple[int, int] = SIMILARITY,
    recall: float = RECALL,
    split_above: int = SPLIT_ABOVE,
    sketch_block: int = SKETCH_BLOCK,
    text_block: int = TEXT_BLOCK,
) -> DataFrame:
    """One row per row of ``df``: key, class_id (the least key of its connected component
    of similar texts), copy_id (the least key of its equal sets), n_links (other rows at
    least ``similarity`` alike, copies included), n_partners (different sets among them),
    text_hash (tells rows of equal key apart), class_name (the class, whatever the keys)."""
    above, below = similarity
    share = above / below
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), whole.alias("text"))
    row_hash = F.xxhash64("key", "text")
    marks = settled(
        rows.select("key", row_hash.alias("row"), marked("text").alias("m")).select(
            "key", "row", "m.*"
        ),
        "marks",
    )
    classes = settled(
        marks.where("n > 0")
        .groupBy("set")
        .agg(
            F.min("key").alias("copy_id"),
            F.min("row").alias("row"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n").alias("size"),
            F.first("mins").alias("mins"),
        ),
        "classes",
    )
    met = buckets(classes, runs_for(share, recall), split_above)
    # the low bytes of the minimum hashes; two differing hashes agree in 1 of 256
    sketches = classes.select("set", low_bytes("mins").alias("sketch"))
    t = shingles.HASHES
    chance = share + (1 - share) / 256
    least = ceil(t * chance - SLACK * (t * chance * (1 - chance)) ** 0.5)
    pairs = block_pairs(met, F.col("node"), F.ceil(F.col("n") / sketch_block)).join(sketches, "set")
    ordered = (
        pairs.select("pair", "set", "block", "alone", "sketch")
        .repartition("pair")
        .sortWithinPartitions("pair")
    )
    loose = components(ordered.mapInArrow(_sketch_links(least), EDGE))
    islands = settled(loose.select(F.col("node").alias("set"), "component"), "islands")
    sized = settled(
        islands.join(classes.select("set", "row", "copies", "size"), "set"), "sized"
    )
    extents = settled(
        sized.groupBy("component").agg(
            F.count(F.lit(1)).alias("n"),
            F.greatest(
                F.ceil(F.count(F.lit(1)) / text_block), F.ceil(F.sum("size") / BLOCK_SHINGLES)
            ).alias("blocks"),
        ),
        "extents",
    )
    placed = settled(
        attach(sized, extents, "component", "n", ["set"], F.col("blocks"), "blocks"), "placed"
    )
    # of the texts only those of the islands move
    hashed = rows.select(row_hash.alias("row"), "text")
    near = may_be_among(hashed, "row", placed.select(F.col("row").alias("member")), "member", "_near")
    texts = near.where("_near").drop("_near").join(placed, "row")
    compared = (
        block_pairs(texts, F.col("component"), F.col("blocks"))
        .select("pair", "set", "block", "alone", "copies", "text")
        .repartition("pair")
        .sortWithinPartitions("pair")
    )
    links = settled(compared.mapInArrow(_exact_links(above, below), LINK), "links")
    joined = components(links.select(F.col("set").alias("u"), F.col("u").alias("v")))
    counts = links.groupBy("set").agg(F.sum("links").alias("links"), F.sum("partners").alias("partners"))
    known = classes.select("set", "copy_id", "copies")
    named = settled(
        known.join(counts, "set", "left").join(
            joined.select(F.col("node").alias("set"), "component"), "set", "left"
        ),
        "named",
    )
    least_key = settled(
        named.where("component IS NOT NULL")
        .groupBy("component")
        .agg(F.min("copy_id").alias("class_id"), F.count(F.lit(1)).alias("n")),
        "least-keys",
    )
    final = settled(
        attach(named, least_key, "component", "n", ["set"], F.struct("class_id"), "_of"), "final"
    )
    one = F.lit(0).cast("long")
    value = F.struct(
        F.when(F.col("_of").isNull(), F.col("copy_id")).otherwise(F.col("_of.class_id")).alias("class_id"),
        "copy_id",
        (F.coalesce("links", one) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("partners", one).alias("n_partners"),
        F.hex(F.coalesce("component", "set")).alias("class_name"),
    )
    found = attach(
        marks.select("key", "row", F.when(F.col("n") > 0, F.col("set")).alias("set")),
        final,
        "set",
        "copies",
        ["row"],
        value,
        "_got",
    )
    none = F.col("_got").isNull()
    return found.select(
        F.col("key").alias(key),
        F.when(none, F.col("key")).otherwise(F.col("_got.class_id")).alias("class_id"),
        F.when(none, F.col("key")).otherwise(F.col("_got.copy_id")).alias("copy_id"),
        F.coalesce("_got.n_links", one).alias("n_links"),
        F.coalesce("_got.n_partners", one).alias("n_partners"),
        F.col("row").alias("text_hash"),
        F.coalesce("_got.class_name", F.concat(F.lit("row "), F.col("row"))).alias("class_name"),
    )


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df``, whole, of which one stays for every class of ``similar``: the one
    with the least key, a null key behind all others.  Rows equal in key and text are one."""
    row, name, near = (spread_free(n, df.columns) for n in ("_row", "_name", "_near"))
    found = settled(
        similar(df, key, text, **options).select(
            "class_name", F.col(key).alias("key"), F.col("text_hash").alias("row")
        ),
        "similar",
    )
    order = F.struct(F.col("key").isNull().alias("late"), "key", "row")
    classes = settled(
        found.groupBy("class_name").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"),
        "repeated",
    )
    # rows of classes with one member pass straight through
    shared = attach(found, classes, "class_name", "n", ["row"], F.col("first.row"), "stays")
    members = settled(shared.where("stays IS NOT NULL").select("row", "stays"), "members")
    hashed = df.withColumn(row, F.xxhash64(key, F.coalesce(F.col(text), F.lit(""))))
    tested = may_be_among(hashed, row, members.withColumnRenamed("row", "_member"), "_member", near)
    alone = tested.where(~F.col(near))
    verdicts = members.groupBy(F.col("row").alias(name)).agg(
        F.first(F.col("stays") == F.col("row")).alias("_stays")
    )
    joined = tested.where(F.col(near)).join(verdicts, F.col(row) == F.col(name), "left")
    kept = joined.where(F.coalesce("_stays", F.lit(True))).dropDuplicates([row])
    return alone.select(*df.columns).unionByName(kept.select(*df.columns))


def low_bytes(mins: Column | str) -> Column:
    """The low byte of every minimum hash."""

    @F.arrow_udf("binary")
    def low(batch: pa.Array) -> pa.Array:
        return pa.array([m[::4] for m in batch.to_pylist()], pa.binary())

    return low(mins)
