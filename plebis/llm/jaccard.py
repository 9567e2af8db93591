"""Operator 4: n-gram Jaccard join.

Documents by n-grams is a sparse incidence matrix; the product with its own
transpose counts the n-grams that two documents share.  Size-derived bounds
discard work at each step:

* A linked document of n n-grams shares at least t n of them, so one with more
  than n - ceil(t n) n-grams that stand in no other document links with none.
  N-grams are counted over the whole corpus in packed blocks, a hash sample of
  them, which already tells most documents apart that link with nothing.
* The product is taken in blocks, one an n-gram, and only over the n-grams that a
  pair above the threshold cannot do without: of a set of n, in one fixed order
  of all n-grams, the first n - ceil(t n) + 1.  The order puts the n-grams of many
  documents last, by their exact counts, so that lines and passages which many
  documents share build no blocks.
* Small blocks (``FEW`` members at most) give pairs, whose counts are held against
  bounds that follow from the sizes; what is left is verified on the whole sets.
* Nodes that meet in a large block form a bundle.  A bundle's own product is taken
  dense, side by side of some hundred nodes, and gives a spanning forest of its
  links, so that a group of near copies never becomes a list of its pairs.  In a
  bundle of several sides all members first meet a few pivots; only those outside
  the largest component so found meet all others.

Equal sets are one node from the start.  Components come from alternating
large-star and small-star steps.

Defined results.  Null and empty texts, and texts of white space, have no
n-grams and link with nothing.  A text with fewer words than n has one n-gram,
the whole.  Repeated rows and copies share a component.  Rows with a null key are
their own component.  N-grams and sets are known by 64-bit hashes.  An empty
table gives no rows; other columns of the table are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plebis.llm.common import durable, table

#: Members of a block that gives pairs; larger ones give bundles.
FEW = 16
#: Nodes in a dense block of a bundle's product, and columns multiplied at a time.
SIDE, COLUMNS = 512, 4096
#: Nodes of a large bundle that all its members meet first.
PIVOTS = 64
#: Of this many n-grams one is counted to find documents that link with nothing.
SAMPLED = 4
#: Documents whose n-grams are packed together, and documents to a block of counts.
PACKED, COUNTED = 2048, 1024
#: Above so many keys or n-grams a table is joined by shuffle instead of broadcast.
BROADCAST_KEYS = 1_000_000
WORDS = 4
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and each text's bounds."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    known = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) | 1 if w else 0 for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary)
    )
    words = known[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    kept = words != 0
    before = np.concatenate([[0], np.cumsum(kept)])
    return words[kept], before[offsets - offsets[0]]


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct n-gram hashes; some hundred texts at a time, so
    that a worker holds little beside the sets."""
    return [s for at in range(0, len(texts), 256) for s in _shingle_sets(texts.slice(at, 256), n)]


def _shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    words, bounds = word_hashes(texts)
    total = len(words) - n + 1
    grams = np.zeros(max(0, total), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            grams += _mixed(words[k : k + max(0, total)] * _ODD[k % 8] + np.uint64(k))
        grams = _mixed(grams)
        sets = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= n:
                sets.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                short = (words[a:b] * _ODD[4 : 4 + 1] + np.arange(b - a, dtype=np.uint64) * _ODD[5]).copy()
                sets.append(_mixed(_mixed(short).cumsum(dtype=np.uint64)[-1:] + np.uint64(b - a)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def set_id(grams: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def least_overlap(a, b, percent: int):
    """Fewest shared members of sets of a and b at the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, percent: int):
    return n + (-percent * n // 100) + 1


def prefix_length_of(n: Column, percent: int) -> Column:
    return n + F.floor(-percent * n / 100) + 1


def _sized(side: DataFrame) -> DataFrame:
    """The side of a join, to be broadcast while its rows are few."""
    return F.broadcast(side) if side.count() <= BROADCAST_KEYS else side


def _kind(df: DataFrame, name: str) -> str:
    return next(f.dataType.simpleString() for f in df.schema if f.name == name)


def _bits(count: int) -> int:
    """Leading bits of a hash that tell blocks of counts apart."""
    return min(24, max(0, (count // COUNTED).bit_length()))


def describe(docs: DataFrame, key: str, text: str, n: int, bits: int) -> DataFrame:
    """Rows (key, mark, n, sid, batch, at) for every document, mark a hash of its
    text, and rows (batch, bucket, tags, ats) with the sampled n-grams of each batch
    and the one document each stands in (all ones: several)."""
    schema = f"key {_kind(docs, key)}, mark long, n long, sid long, batch long, at int, bucket int, tags binary, ats binary"
    names = ["key", "mark", "n", "sid", "batch", "at", "bucket", "tags", "ats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            for start in range(0, whole.num_rows, PACKED):
                batch = whole.slice(start, PACKED)
                label = task << 32 | number
                number += 1
                sets = shingle_sets(batch.column(2), n)
                ids = np.array([set_id(s) for s in sets], np.int64)
                _, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
                size, none = len(sets), lambda m, t: pa.nulls(m, t)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids),
                        pa.array(np.full(size, label)), pa.array(first[inverse].astype(np.int32)),
                        none(size, pa.int32()), none(size, pa.binary()), none(size, pa.binary()),
                    ],
                    names=names,
                )
                taken = [sets[i][sets[i] % np.uint64(SAMPLED) == 0] for i in first]
                flat = np.concatenate([np.zeros(0, np.uint64), *taken])
                own = np.repeat(first.astype(np.uint16), [len(t) for t in taken])
                grams, where, hits = np.unique(flat, return_index=True, return_counts=True)
                ats = np.where(hits == 1, own[where], np.uint16(0xFFFF)) if len(grams) else np.zeros(0, np.uint16)
                tags = (grams >> np.uint64(32 - bits)).astype(np.uint32)
                buckets = (grams >> np.uint64(40)).astype(np.int64) >> (24 - bits)
                found, begin = np.unique(buckets, return_index=True)
                parts = list(zip(begin, [*begin[1:], len(grams)], strict=True)) if len(found) else []
                size = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        none(size, batch.schema.field(0).type), *(none(size, pa.int64()) for _ in range(3)),
                        pa.array(np.full(size, label)), none(size, pa.int32()), pa.array(found.astype(np.int32)),
                        pa.array([tags[a:b].tobytes() for a, b in parts], pa.binary()),
                        pa.array([ats[a:b].tobytes() for a, b in parts], pa.binary()),
                    ],
                    names=names,
                )

    mark = F.xxhash64(docs[text])
    return docs.select(docs[key].alias("key"), mark.alias("mark"), docs[text].alias("text")).mapInArrow(run, schema)


def alone(packed: DataFrame) -> DataFrame:
    """Rows (batch, bucket, tags, ats) to (batch, at, lone): how many sampled
    n-grams of a document stand in no other."""

    def count(table_: pa.Table) -> pa.Table:
        tags = np.concatenate([np.frombuffer(t.as_buffer(), np.uint32) for t in table_.column("tags").combine_chunks()])
        ats = np.concatenate([np.frombuffer(t.as_buffer(), np.uint16) for t in table_.column("ats").combine_chunks()])
        labels = table_.column("batch").to_numpy()
        rows = np.repeat(np.arange(len(labels)), pc.binary_length(table_.column("tags")).to_numpy() // 4)
        order = np.argsort(tags, kind="stable")
        ordered = tags[order]
        same = np.concatenate([[False], ordered[1:] == ordered[:-1], [False]])
        single = order[~(same[1:] | same[:-1])]
        single = single[ats[single] != 0xFFFF]
        codes, counts = np.unique(rows[single] << 16 | ats[single], return_counts=True)
        found, begin = np.unique(codes >> 16, return_index=True)
        parts = list(zip(begin, [*begin[1:], len(codes)], strict=True)) if len(found) else []
        return pa.table(
            {
                "batch": pa.array(labels[found]),
                "ats": pa.array([(codes[a:b] & 0xFFFF).astype(np.uint16).tobytes() for a, b in parts], pa.binary()),
                "lone": pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in parts], pa.binary()),
            }
        )

    def total(table_: pa.Table) -> pa.Table:
        lone = np.zeros(1 << 16, np.int64)
        for ats, counts in zip(table_.column("ats").combine_chunks(), table_.column("lone").combine_chunks(), strict=True):
            lone[np.frombuffer(ats.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.uint32)
        at = np.flatnonzero(lone)
        return pa.table({"batch": pa.array(np.full(len(at), table_.column("batch")[0].as_py())), "at": pa.array(at.astype(np.int32)), "lone": pa.array(lone[at])})

    return (
        packed.groupBy("bucket").applyInArrow(count, "batch long, ats binary, lone binary")
        .groupBy("batch").applyInArrow(total, "batch long, at int, lone long")
    )


def frequent(sets: DataFrame, bits: int) -> DataFrame:
    """Rows (gram, hits) of the n-grams that stand in more than ``FEW`` sets."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PACKED):
                flat = np.concatenate([np.frombuffer(g.as_buffer(), np.uint64) for g in whole.column(0).slice(start, PACKED)])
                grams, hits = np.unique(flat, return_counts=True)
                found, begin = np.unique((grams >> np.uint64(40)).astype(np.int64) >> (24 - bits), return_index=True)
                parts = list(zip(begin, [*begin[1:], len(grams)], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.astype(np.int32)),
                        pa.array([grams[a:b].tobytes() for a, b in parts], pa.binary()),
                        pa.array([hits[a:b].astype(np.uint16).tobytes() for a, b in parts], pa.binary()),
                    ],
                    names=["bucket", "grams", "hits"],
                )

    def count(table_: pa.Table) -> pa.Table:
        grams = np.concatenate([np.frombuffer(g.as_buffer(), np.uint64) for g in table_.column("grams").combine_chunks()])
        hits = np.concatenate([np.frombuffer(h.as_buffer(), np.uint16) for h in table_.column("hits").combine_chunks()])
        order = np.argsort(grams, kind="stable")
        grams, begin = np.unique(grams[order], return_index=True)
        sums = np.add.reduceat(hits[order].astype(np.int64), begin)
        often = sums > FEW
        return pa.table({"gram": pa.array(grams[often].view(np.int64)), "hits": pa.array(sums[often])})

    return sets.select("grams").mapInArrow(deal, "bucket int, grams binary, hits binary").groupBy("bucket").applyInArrow(count, "gram long, hits long")


def prefixes(sets: DataFrame, late: DataFrame, percent: int) -> DataFrame:
    """Rows (sid, n, far, near, grams) of sets (sid, grams): the first n-grams of
    each set in the fixed order (rows ``late`` (gram, hits) last, by hits), and the
    order key (far, near) of the last of them.

    The late n-grams are broadcast while they are few; else every n-gram of the
    sets meets its count by a join and each set is ordered by a window."""
    late = late.transform(durable)
    if late.count() > BROADCAST_KEYS:
        return _prefixes_joined(sets, late, percent)
    rows = late.orderBy("gram").toArrow()
    hot = sets.sparkSession.sparkContext.broadcast((rows["gram"].to_numpy(), rows["hits"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hits = hot.value
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            firsts = []
            for sid, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = np.frombuffer(packed.as_buffer(), np.int64)
                size = len(grams)
                far = np.zeros(size, np.int64)
                if len(known):
                    where = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    far = np.where(known[where] == grams, hits[where], 0)
                length = prefix_length(size, percent)
                first = np.lexsort((grams, far))[:length]
                firsts.append(grams[first])
                for c, value in zip(out, (size, far[first[-1]], grams[first[-1]]), strict=True):
                    c.append(int(value))
            ends = np.cumsum([0, *map(len, firsts)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out), lists], names=["sid", "n", "far", "near", "grams"])

    return sets.select("sid", "grams").mapInArrow(run, "sid long, n long, far long, near long, grams array<long>")


def _prefixes_joined(sets: DataFrame, late: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = np.frombuffer(packed.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams), *(pa.array(np.full(len(grams), v, np.int64)) for v in (sid, len(grams)))], names=["gram", "sid", "n"]
                )

    in_order = Window.partitionBy("sid").orderBy("far", "gram")
    placed = (
        sets.select("sid", "grams").mapInArrow(run, "gram long, sid long, n long")
        .join(late, "gram", "left")
        .select("gram", "sid", "n", F.coalesce("hits", F.lit(0)).alias("far"))
        .withColumn("at", F.row_number().over(in_order).cast("long") - 1)
        .where(F.col("at") < prefix_length_of(F.col("n"), percent))
    )
    packed = placed.groupBy("sid", "n").agg(F.max(F.struct("far", "gram")).alias("end"), F.sort_array(F.collect_list(F.struct("at", "gram"))).alias("first"))
    return packed.select("sid", "n", F.col("end.far").alias("far"), F.col("end.gram").alias("near"), F.col("first.gram").alias("grams"))


def _sets_of(docs: DataFrame, key: str, text: str, owners: DataFrame, n: int) -> DataFrame:
    """(sid, grams) of the documents that ``owners`` (key) names, without empty sets;
    the keys are broadcast while they are few, else the texts are joined by shuffle."""
    owners = owners.select("key").transform(durable).transform(_sized)
    texts = docs.select(docs[key].alias("key"), docs[text].alias("text")).join(owners, "key", "left_semi").select("text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in shingle_sets(batch.column(0), n) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["sid", "grams"],
            )

    sets = texts.mapInArrow(sets_of, "sid long, grams binary").transform(durable)
    # Sets that several rows give are rare; only they are shuffled.
    again = sets.groupBy("sid").count().where("count > 1").select("sid").transform(durable)
    if again.isEmpty():
        return sets
    again = _sized(again)
    several = sets.join(again, "sid", "left_semi").dropDuplicates(["sid"]).transform(durable)
    return sets.join(again, "sid", "left_anti").unionByName(several)


def dense_links(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of two lists of sorted sets reach the threshold."""
    left, right = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(left, right)
    rows_a, rows_b = np.repeat(np.arange(len(a)), [len(s) for s in a]), np.repeat(np.arange(len(b)), [len(s) for s in b])
    overlap = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, len(shared), COLUMNS):
        part = shared[start : start + COLUMNS]
        sides = []
        for flat, rows, count in ((left, rows_a, len(a)), (right, rows_b, len(b))):
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            side = np.zeros((count, len(part)), np.float32)
            side[rows[hit], at[hit]] = 1
            sides.append(side)
        overlap += sides[0] @ sides[1].T
    sizes_a, sizes_b = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    both = overlap.astype(np.int64)
    return 100 * both >= percent * (sizes_a[:, None] + sizes_b[None, :] - both)


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the bipartite links of two lists the least index on the left that each
    node of either list is connected with; a node without links on the right gets
    the length of the left list."""
    m = linked.shape[0]
    left = np.arange(m)
    while True:
        right = np.where(linked, left[:, None], m).min(axis=0, initial=m)
        new = np.minimum(left, np.where(linked, right[None, :], m).min(axis=1, initial=m))
        if (new == left).all():
            return left, right
        left = new


def _product(task: DataFrame, percent: int) -> DataFrame:
    """Rows (task, i, j, root, sid, own, grams) to links (x, y): in each group the
    sets with ``own`` meet those without it that have the same root, or, where all
    have it, each other.  No more than a forest comes of each product."""

    def product(table_: pa.Table) -> pa.Table:
        roots, ids = table_.column("root").to_numpy(), table_.column("sid").to_numpy()
        own = table_.column("own").to_numpy(zero_copy_only=False)
        sets_ = [np.frombuffer(g.as_buffer(), np.uint64) for g in table_.column("grams").combine_chunks()]
        out: list[tuple[int, int]] = []
        order = np.argsort(roots, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
            a = members[own[members]]
            b = members[~own[members]] if not own[members].all() else a
            if not len(a):
                continue
            left, right = spanning(dense_links([sets_[k] for k in a], [sets_[k] for k in b], percent))
            out += [(int(ids[a[k]]), int(ids[a[r]])) for k, r in enumerate(left) if r != k]
            out += [(int(ids[b[k]]), int(ids[a[r]])) for k, r in enumerate(right) if r < len(a) and ids[b[k]] != ids[a[r]]]
        return pa.table({"x": pa.array([x for x, _ in out], pa.int64()), "y": pa.array([y for _, y in out], pa.int64())})

    return task.select("task", "i", "j", "root", "sid", "own", "grams").groupBy("task", "i", "j").applyInArrow(product, "x long, y long")


def bundled_links(bundles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) that connect what the true links within each bundle (node,
    root) connect."""
    held = sets.join(_sized(bundles), F.col("node") == F.col("sid")).select("root", "sid", "grams")
    sizes = bundles.groupBy("root").agg(F.count("*").alias("m")).transform(durable)
    zero = F.lit(0)
    small, large = sizes.where(F.col("m") <= SIDE), sizes.where(F.col("m") > SIDE)
    # Small bundles share tasks, packed to about the work of one full side.
    tasks = max(1, small.agg(F.coalesce(F.sum(F.col("m") * F.col("m")), zero)).first()[0] // (SIDE * SIDE))
    links = _product(
        held.join(_sized(small.select("root")), "root").select(
            F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("task"), zero.alias("i"), zero.alias("j"), "root", "sid", F.lit(True).alias("own"), "grams"
        ),
        percent,
    )
    if large.isEmpty():
        return links.distinct().transform(durable)

    sides = F.ceil(F.col("m") / SIDE).cast("int")
    side_of = lambda m: F.pmod(F.xxhash64(F.lit(3), "sid"), m).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    big = held.join(_sized(large.withColumn("sides", sides)), "root")
    big = big.select("root", "sid", "grams", "sides").transform(durable)
    # Every member meets the pivots.
    by_hash = Window.partitionBy("root").orderBy(F.xxhash64(F.lit(4), "sid"), "sid")
    pivots = big.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= PIVOTS)
    pick = lambda i, j, own: (F.col("root").alias("task"), i.alias("i"), j.alias("j"), "root", "sid", F.lit(own).alias("own"), "grams")
    first = _product(
        big.select(*pick(zero, side_of(F.col("sides")), False)).unionByName(
            pivots.select("root", "sid", "grams", every(F.col("sides")).alias("side")).select(*pick(zero, F.col("side"), True))
        ),
        percent,
    )
    links = links.unionByName(first).distinct().transform(durable)

    # Those outside the largest component of their bundle meet all its members.
    placed = _rooted(big.select(F.col("root").alias("bundle"), "sid"), components(links), "sid", "part")
    parts = placed.groupBy("bundle", "part").agg(F.count("*").alias("c")).transform(durable)
    main = parts.groupBy("bundle").agg(F.max(F.struct("c", "part")).alias("main"), F.sum("c").alias("m"))
    outer = main.select("bundle", F.col("main.part").alias("main"), F.ceil((F.col("m") - F.col("main.c")) / SIDE).cast("int").alias("outer")).where("outer > 0")
    rest = placed.join(outer, "bundle").where("part <> main").select("sid", "outer").transform(durable)
    if rest.isEmpty():
        return links
    tiles = big.join(outer.select(F.col("bundle").alias("root"), "outer"), "root")
    second = _product(
        tiles.select("root", "sid", "grams", side_of(F.col("sides")).alias("side"), every(F.col("outer")).alias("other")).select(*pick(F.col("other"), F.col("side"), False)).unionByName(
            big.join(rest, "sid").select("root", "sid", "grams", side_of(F.col("outer")).alias("other"), every(F.col("sides")).alias("side")).select(*pick(F.col("other"), F.col("side"), True))
        ),
        percent,
    )
    return links.unionByName(second.distinct().transform(durable))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y) of set ids those whose whole sets reach the threshold.  While
    the pairs are few they go to the sets, so that one set of each pair is shuffled
    and, once, those that it meets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                where = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int(np.count_nonzero(large[where] == small))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    heads = sets.select(F.col("sid").alias("x"), F.col("grams").alias("a")).join(_sized(pairs), "x")
    met = pairs.select("y").distinct().transform(durable).transform(_sized)
    tails = sets.select(F.col("sid").alias("y"), F.col("grams").alias("b")).join(met, "y", "left_semi")
    return heads.join(tails, "y").select("x", "y", "a", "b").mapInArrow(compare, "x long, y long").transform(durable)


def components(edges: DataFrame) -> DataFrame:
    """Edges (x, y) to rows (node, root), root the smallest node of its component;
    roots have no row of their own."""
    edges = edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    edges = edges.transform(durable)
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct()
            .transform(durable)
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _rooted(df: DataFrame, roots: DataFrame, by: str, into: str) -> DataFrame:
    return df.join(_sized(roots.withColumnsRenamed({"node": by, "root": "__root"})), by, "left").withColumn(
        into, F.coalesce("__root", by)
    ).drop("__root")


def links_of(sets: DataFrame, bits: int, percent: int) -> DataFrame:
    """Links (x, y) that connect what all links between the sets (sid, grams)
    connect."""
    first = prefixes(sets, frequent(sets, bits), percent).transform(durable)
    entries = first.select("sid", "n", "far", "near", F.posexplode("grams").alias("at", "gram"))
    sizes = entries.groupBy("gram").agg(F.count("*").alias("m"), F.min("sid").alias("least")).where("m > 1").transform(durable)
    # Bundles: nodes that meet in a block too large for pairs.
    bundles = components(entries.join(_sized(sizes.where(F.col("m") > FEW)), "gram").select(F.col("sid").alias("x"), F.col("least").alias("y")))
    bundles = bundles.unionByName(bundles.select(F.col("root").alias("node"), "root").distinct()).transform(durable)
    links = bundled_links(bundles, sets, percent)

    # The product over nodes of different bundles, which meet in small blocks only.
    # Both sides of the join read one shuffle by n-gram.
    placed = _rooted(entries.join(sizes.where(F.col("m") <= FEW).select("gram"), "gram"), bundles, "sid", "bundle")
    block = Window.partitionBy("gram")
    open_blocks = placed.withColumn("mixed", F.min("bundle").over(block) < F.max("bundle").over(block)).where("mixed")
    parts = ("sid", "n", "at", "far", "near", "bundle")
    left = open_blocks.select("gram", *[F.col(c).alias(f"x_{c}") for c in parts])
    right = open_blocks.select("gram", *[F.col(c).alias(f"y_{c}") for c in parts])
    col = F.col
    need = F.ceil((col("x_n") + col("y_n")) * percent / (100 + percent))
    in_order = (col("x_n") < col("y_n")) | ((col("x_n") == col("y_n")) & (col("x_sid") < col("y_sid")))
    reach = F.least(col("x_at"), col("y_at")) + F.least(col("x_n") - col("x_at"), col("y_n") - col("y_at"))
    met = left.join(
        right,
        (left["gram"] == right["gram"]) & (col("x_bundle") != col("y_bundle")) & in_order & (col("x_n") * 100 >= col("y_n") * percent) & (reach >= need),
    )
    ends = [f"{side}_{c}" for side in "xy" for c in ("sid", "n", "far", "near")]
    counted = met.groupBy(*ends).agg(F.count("*").alias("shared"))
    # Beyond the place where the shorter-reaching prefix ends, no more than the rest of its set is shared.
    x_first = F.struct(col("x_far"), col("x_near")) <= F.struct(col("y_far").alias("x_far"), col("y_near").alias("x_near"))
    rest = F.when(x_first, col("x_n") - prefix_length_of(col("x_n"), percent)).otherwise(col("y_n") - prefix_length_of(col("y_n"), percent))
    pairs = counted.where(col("shared") + rest >= need).select(col("x_sid").alias("x"), col("y_sid").alias("y"))
    return links.unionByName(verified(pairs.transform(durable), sets, percent))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = 85) -> DataFrame:
    """Rows (key, mark, n_shingles, component, chosen): the component is its
    smallest key, chosen tells the row of that key whose mark is smallest."""
    bits = _bits(docs.count())
    described = describe(docs, key, text, n, bits).transform(durable)
    rows = described.where("tags is null").select("key", "mark", "n", "sid", "batch", "at")
    nodes = rows.where("n > 0 and key is not null")
    holders = nodes.groupBy("sid").agg(F.min(F.struct("key", "mark")).alias("least"))
    lone = alone(described.where("tags is not null").select("batch", "bucket", "tags", "ats"))
    open_sids = (
        nodes.join(lone, ["batch", "at"], "left")
        .where(F.coalesce("lone", F.lit(0)) < prefix_length_of(F.col("n"), percent))
        .select("sid").distinct()
    )
    owners = holders.join(open_sids, "sid").select("sid", F.col("least.key").alias("key"))
    sets = _sets_of(docs, key, text, owners, n)
    roots = components(links_of(sets, bits, percent))

    # The smallest key of each component, through the sets' smallest keys.
    owned = _rooted(holders, roots, "sid", "root").transform(durable)
    smallest = owned.groupBy("root").agg(F.min("least").alias("first"))
    by_set = owned.join(smallest, "root").select("sid", "first")
    all_rows = rows.select("key", "mark", "n", F.when((F.col("n") > 0) & F.col("key").isNotNull(), F.col("sid")).alias("sid"))
    return all_rows.join(by_set, "sid", "left").select(
        "key",
        "mark",
        F.col("n").alias("n_shingles"),
        F.coalesce("first.key", "key").alias("component"),
        (F.col("first").isNull() | ((F.col("first.key") == F.col("key")) & (F.col("first.mark") == F.col("mark")))).alias("chosen"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = 85) -> DataFrame:
    """One document of each component: that of its smallest key, and of several
    texts under this key one; one row of it where rows repeat.  Rows without
    n-grams or key all stay."""
    found = classes(docs, key, text, n, percent).transform(durable)
    inside = found.where("n_shingles > 0 and key is not null")
    gone = inside.where("not chosen").select(F.col("key").alias("__key"), F.col("mark").alias("__mark")).distinct().transform(durable)
    again = inside.where("chosen").groupBy(F.col("key").alias("__key"), F.col("mark").alias("__mark")).count().where("count > 1").drop("count").transform(durable)
    is_ = lambda side: (docs[key] == side["__key"]) & (F.xxhash64(docs[text]) == side["__mark"])
    gone = _sized(gone)
    kept = docs.join(gone, is_(gone), "left_anti")
    # Rows that repeat are rare; only they are told apart.
    if again.isEmpty():
        return kept
    again = _sized(again)
    once = kept.join(again, is_(again), "left_anti")
    several = kept.join(again, is_(again), "left_semi")
    return once.unionByName(several.dropDuplicates([key, text]))


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
