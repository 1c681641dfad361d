"""Self-join of texts on the Jaccard similarity of their five-word shingles, by chosen paths.

A text's shingles are its sets; a shorter text with words is one shingle. Texts that are equal byte by byte are
one text with a number of copies. Each text has a sketch of ``SKETCH`` minimum hashes: shingles sampled so that two texts
share one with the probability of their similarity.

Each run walks a tree. A node draws ``BRANCHES`` positions of the sketch, and texts go on to the child of the
shingle they hold there, so that only texts that share sampled shingles stay together. A node of one text ends; a
small one is a bucket. A node that hardly gets smaller holds texts alike and is a bucket as well. With two branches a
pair at the threshold survives a run of any depth with a probability of 1 - q, where q = (1 - s + s q)^2; runs are
repeated until the expected recall passes ``RECALL``.

Buckets are compared by sketches, block against block, and yield links to a leader instead of pairs; the blocks bound
what a task holds. Texts joined that way form candidate groups. In each group all pairs are then compared exactly on their
full sets, again block by block. Per text the number of linked rows leaves a task, never a list of pairs.

Result: for each row its class (connected component of links; the smallest doc_id in it), its copies' class and
its number of links (other rows of similarity 0.8 or more, copies included). Texts that are null, empty or without
words link to nothing: they are classes of their own. Rows of a class whose ids are all null get a null class.
Repeated rows are copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlytics.llm.common import components, free_name, materialise, may_be_in, sorted_groups, with_text_columns
from playlytics.llm.words import hashed_texts, mix, shingles
from playlytics.sources.storage import scratch_scope

THRESHOLD = 0.8
RECALL = 0.9999
SKETCH = 64
SKETCH_SLACK = 4.75  # standard deviations that a sketch may fall short of the threshold
BRANCHES = 2
SMALL = 128  # texts in a bucket
ALIKE = 0.7  # a child with that share of its parent is a bucket of texts alike
DEPTH = 8
BLOCK_TEXTS = 512
BLOCK_SHINGLES = 1 << 20
_SEEDS = mix(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = (_SEEDS[:SKETCH] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (_SEEDS[SKETCH:] >> np.uint64(32)).astype(np.uint32)


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, branches: int = BRANCHES) -> int:
    """Independent runs after which a pair at the threshold has been in one bucket with probability ``recall``."""
    lost = 0.0
    for _ in range(10_000):  # the smallest root of q = (1 - s + s q)^branches
        lost = (1 - threshold + threshold * lost) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def sketches(texts: list[bytes | None]) -> list[bytes | None]:
    """The sketch of each text, None without words."""
    out: list[bytes | None] = []
    for first, end, hashes, counts in hashed_texts([t or b"" for t in texts]):
        values, number = shingles(hashes, counts)
        some = np.flatnonzero(number)
        rows: list[bytes | None] = [None] * (end - first)
        if len(some):
            low = (values >> np.uint64(32)).astype(np.uint32)
            starts = (np.cumsum(number) - number)[some]
            least = np.empty((len(some), SKETCH), np.uint32)
            for k in range(SKETCH):
                least[:, k] = np.minimum.reduceat(low * _FACTOR[k] + _SHIFT[k], starts)
            for i, row in zip(some, least, strict=True):
                rows[i] = row.tobytes()
        out += rows
    return out


def _unpack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SKETCH)


def _children(nodes: np.ndarray, sketch: np.ndarray, depth: int) -> np.ndarray:
    """The child nodes of each text in its node, one per drawn position of the sketch.

    At the root of run r the positions are 2r and 2r + 1, so that runs are independent; below they are drawn by the node.
    """
    out = np.empty((len(nodes), BRANCHES), np.int64)
    at = np.arange(len(nodes))
    node = nodes.view(np.uint64)
    drawn = mix(node + np.uint64(depth))
    first = (node * np.uint64(BRANCHES) if depth == 0 else drawn) % np.uint64(SKETCH)
    step = np.ones(len(nodes), np.uint64) if depth == 0 else (drawn >> np.uint64(32)) % np.uint64(SKETCH - 1) // np.uint64(BRANCHES) + np.uint64(1)
    for b in range(BRANCHES):
        place = (first + np.uint64(b) * step) % np.uint64(SKETCH)
        child = mix(node * np.uint64(0xD6E8FEB86659FD93) + mix(place + np.uint64(depth << 8)) + sketch[at, place].astype(np.uint64))
        out[:, b] = child.view(np.int64)
    return out


def _descend(rows: DataFrame, depth: int) -> DataFrame:
    """(text, node, sketch, within) to (text, node, within) of all children."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                children = _children(batch.column("node").to_numpy(), _unpack(batch.column("sketch")), depth)
                for b in range(BRANCHES):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("text"), pa.array(children[:, b]), batch.column("within")], names=["text", "node", "within"]
                    )

    return rows.select("text", "node", "sketch", "within").mapInArrow(run, "text string, node bigint, within bigint")


def buckets(texts: DataFrame, runs: int) -> DataFrame:
    """(text, node, n): the texts of every bucket of all runs, n texts each; ``texts`` has text and sketch."""
    roots = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(runs - 1).cast("bigint")))
    whole = texts.count()
    frontier = texts.select("text", "sketch", roots.alias("node"), F.lit(whole).cast("bigint").alias("within"))
    found: DataFrame | None = None
    for depth in range(DEPTH):
        rows = materialise(_descend(frontier, depth), "paths")
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("within").alias("parent")).where("n > 1")
        # at the root all texts are together, and a large child is not yet a sign that they are alike
        done = (F.col("n") <= SMALL) | (F.lit(depth == DEPTH - 1)) | ((F.col("n") >= ALIKE * F.col("parent")) & F.lit(depth > 0))
        sizes = materialise(sizes.select("node", "n", done.alias("done")), "nodes")
        bucket = rows.join(sizes.where("done").drop("done"), "node").select("text", "node", "n")
        found = bucket if found is None else found.unionByName(bucket)
        large = sizes.where("not done")
        if large.isEmpty():
            break
        frontier = rows.drop("within").join(large.select("node", F.col("n").alias("within")), "node").join(texts.select("text", "sketch"), "text")
    return materialise(found, "buckets")


def in_blocks(rows: DataFrame, group: str, blocks: Column, text: str = "text") -> DataFrame:
    """Each row once for every pair of blocks (i <= j) that its own block is in; ``blocks`` counts those of the group."""
    own = F.pmod(F.xxhash64(text, F.lit(7)), F.col("of_blocks"))
    return (
        rows.withColumn("of_blocks", blocks.cast("bigint"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("of_blocks") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .drop("other", "of_blocks")
        .repartition(group, "i", "j")
        .sortWithinPartitions(group, "i", "j", text)
    )


class _Sets:
    """Disjoint sets of the rows of one group."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = int(self.root[x])
        return x

    def join(self, linked: np.ndarray) -> None:
        """Join the ends of a matrix of links, skipping those already together."""
        for a in range(len(linked)):
            mine = self.find(a)
            for b in np.unique(self.root[np.flatnonzero(linked[a])]):
                other = self.find(int(b))
                if other != mine:
                    self.root[max(mine, other)] = min(mine, other)
                    mine = min(mine, other)

    def roots(self) -> list[int]:
        return [self.find(x) for x in range(len(self.root))]


def _cuts(*columns: pa.ChunkedArray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    change = np.zeros(len(columns[0]) + 1, bool)
    change[0] = change[-1] = True
    for column in columns:
        values = column.to_numpy()
        change[1:-1] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def alike(a: np.ndarray, least: int) -> np.ndarray:
    """Which sketches agree in at least ``least`` places, as a symmetric matrix."""
    same = np.zeros((len(a), len(a)), np.uint8)
    for k in range(SKETCH):
        same += a[:, k, None] == a[None, :, k]
    return same >= least


def least_agreement(threshold: float = THRESHOLD) -> int:
    return max(1, math.floor(SKETCH * threshold - SKETCH_SLACK * math.sqrt(SKETCH * threshold * (1 - threshold))))


def candidate_links(found: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): in each bucket the texts whose sketches chain up are linked to one of them."""
    least = least_agreement(threshold)
    edge = pa.schema([("a", pa.string()), ("b", pa.string())])

    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cuts = _cuts(*[table.column(c) for c in ("node", "i", "j")])
        names = table.column("text").to_pylist()
        sketch = _unpack(table.column("sketch"))
        a, b = [], []
        for first, end in zip(cuts[:-1], cuts[1:], strict=True):
            if end - first == 2:
                if names[first] != names[first + 1] and np.count_nonzero(sketch[first] == sketch[first + 1]) >= least:
                    a.append(names[first])
                    b.append(names[first + 1])
            elif end - first > 2:
                sets = _Sets(end - first)
                sets.join(alike(sketch[first:end], least))
                for row, root in enumerate(sets.roots()):
                    if row != root:
                        a.append(names[first + row])
                        b.append(names[first + root])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], schema=edge)

    rows = found.join(texts.select("text", "sketch"), "text")
    dealt = in_blocks(rows, "node", F.ceil(F.col("n") / BLOCK_TEXTS)).select("node", "i", "j", "text", "sketch")
    return dealt.mapInArrow(lambda b: sorted_groups(b, ("node", "i", "j"), edge, handle), "a string, b string")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets; counted in slices of the shared shingles, exact."""
    same = left is right
    values, columns = np.unique(np.concatenate(left if same else [*left, *right]), return_inverse=True)
    often = np.bincount(columns, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    keep = often[columns]
    row = np.repeat(np.arange(len(left) + (0 if same else len(right))), [len(s) for s in (left if same else [*left, *right])])
    row, column = row[keep], place[columns[keep]]
    out = np.zeros((len(left), len(right)), np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(256, (1 << 21) // (len(left) + len(right)))
    for low in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, (low, low + width))
        dense = np.zeros((len(left) + (0 if same else len(right)), width), np.float32)
        dense[row[a:b], column[a:b] - low] = 1
        out += dense[: len(left)] @ (dense if same else dense[len(left) :]).T  # sums below 2**24 are exact
    return out


def exact_links(groups: DataFrame, threshold: float) -> DataFrame:
    """(text, links, leader): in each pair of blocks of a group, linked rows and the text's leader.

    ``groups`` has group, i, j, own, text, copies and the sorted shingles as bytes, sorted by (group, i, j, text).
    """
    schema = pa.schema([("text", pa.string()), ("links", pa.int64()), ("leader", pa.string())])

    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cuts = _cuts(*[table.column(c) for c in ("group", "i", "j")])
        names, copies = table.column("text").to_pylist(), table.column("copies").to_numpy()
        own, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
        packed = table.column("shingles")
        text, links, leader = [], [], []
        for first, end in zip(cuts[:-1], cuts[1:], strict=True):
            sets = [np.frombuffer(packed[k].as_py(), np.uint64) for k in range(first, end)]
            size = np.array([len(s) for s in sets], np.float64)
            weight = copies[first:end]
            if i[first] == j[first]:
                shared = overlaps(sets, sets)
                linked = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
                np.fill_diagonal(linked, False)
            else:
                low = own[first:end] == i[first]
                linked = np.zeros((len(sets), len(sets)), bool)
                if low.any() and not low.all():
                    shared = overlaps([s for s, x in zip(sets, low, strict=True) if x], [s for s, x in zip(sets, low, strict=True) if not x])
                    between = shared >= threshold * (size[low][:, None] + size[~low][None, :] - shared) - 1e-9
                    linked[np.ix_(low, ~low)] = between
                    linked[np.ix_(~low, low)] = between.T
            if linked.any():
                groups_here = _Sets(len(sets))
                groups_here.join(linked)
                number = linked @ weight
                for row, root in enumerate(groups_here.roots()):
                    if number[row]:
                        text.append(names[first + row])
                        links.append(int(number[row]))
                        leader.append(names[first + root])
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(links, pa.int64()), pa.array(leader, pa.string())], schema=schema)

    return groups.mapInArrow(lambda b: sorted_groups(b, ("group", "i", "j"), schema, handle), "text string, links bigint, leader string")


def _with_shingles(rows: DataFrame) -> DataFrame:
    def compute(texts: list[bytes | None]) -> list[pa.Array]:
        packed, number = [], []
        for _, _, hashes, counts in hashed_texts([t or b"" for t in texts]):
            values, sizes = shingles(hashes, counts)
            ends = np.cumsum(sizes)
            for end, size in zip(ends, sizes, strict=True):
                unique = np.unique(values[end - size : end])
                packed.append(unique.tobytes())
                number.append(len(unique))
        return [pa.array(packed, pa.binary()), pa.array(number, pa.int64())]

    return with_text_columns(rows, "shingles binary, n_shingles bigint", compute, "words")


def text_key(text: str, doc_id: str = "doc_id") -> Column:
    """The key of a text; null texts get one of many keys that no text has, so that they do not meet in one task."""
    none = F.concat(F.lit("-"), F.pmod(F.xxhash64(doc_id), F.lit(4096)).cast("string"))
    return F.coalesce(F.md5(F.col(text).cast("binary")), none)


def _linked_texts(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(text, class_key, class_id, copy_id, n_copies, n_links, first_rows) of the texts with copies or links."""
    rows = docs.select("doc_id", text_key("text").alias("key"), "text")
    sketched = with_text_columns(rows, "sketch binary", lambda t: [pa.array(sketches(t), pa.binary())])
    rows = materialise(sketched.select("doc_id", F.col("key").alias("text"), "sketch"), "sketches")
    # first by text and id, so that the rows of a text with many copies are combined in many tasks
    by_id = rows.where("sketch is not null").groupBy("text", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("sketch").alias("sketch"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n"))
    texts = by_id.groupBy("text").agg(F.sum("n").alias("copies"), first.alias("first"), F.first("sketch").alias("sketch"))
    texts = texts.select("text", "copies", F.col("first.doc_id").alias("first_id"), F.col("first.n").alias("first_rows"), "sketch")
    texts = materialise(texts, "texts")
    found = buckets(texts.select("text", "sketch"), runs_needed(threshold, recall))
    groups = components(candidate_links(found, texts, threshold), "candidates")
    members = groups.select(F.col("node").alias("text"), F.col("root").alias("group")).join(texts.drop("sketch"), "text")
    wanted = materialise(members.select("text", "group", "copies", F.col("first_id").alias("doc_id")), "wanted")
    bodies = docs.select("doc_id", F.col("text").alias("words"), text_key("text").alias("text"))
    bodies = may_be_in(bodies, "text", wanted, "wanted").where("wanted").drop("wanted")
    same = (bodies["text"] == wanted["text"]) & bodies["doc_id"].eqNullSafe(wanted["doc_id"])
    bodies = bodies.join(wanted, same).select(wanted["text"], "group", "copies", "words")
    bodies = bodies.groupBy("text", "group", "copies").agg(F.first("words").alias("words"))  # repeated rows
    sets = materialise(_with_shingles(bodies).drop("words"), "sets")
    # written, as the sets would else be dealt by group for both the sums and the join, a large group to one task
    extent = materialise(sets.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total")), "extent")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("total") / BLOCK_SHINGLES))
    dealt = in_blocks(sets.join(extent, "group"), "group", F.least(blocks, F.col("n")))
    dealt = dealt.select("group", "i", "j", "own", "text", "copies", "shingles")
    links = materialise(exact_links(dealt, threshold), "links")
    joined = components(links.select(F.col("text").alias("a"), F.col("leader").alias("b")), "classes")
    linked = (
        joined.select(F.col("node").alias("text"), "root")
        .join(links.groupBy("text").agg(F.sum("links").alias("links")), "text")
        .join(texts.drop("sketch"), "text")
    )
    linked = materialise(linked, "linked")
    classes = linked.groupBy("root").agg(F.min("first_id").alias("class_id"))
    linked = linked.join(classes, "root").select("text", "root", "class_id", "links")
    known = texts.drop("sketch").join(linked, "text", "left").where("copies > 1 or links is not null")
    one = F.col("links").isNull()
    known = known.select(
        "text",
        F.coalesce("root", "text").alias("class_key"),
        F.when(one, F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.col("first_id").alias("copy_id"),
        F.col("copies").alias("n_copies"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        "first_rows",
    )
    return known


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, text, class_key, class_id, copy_id, n_copies, n_links) for every row of ``docs``; text is a key of the text.

    ``docs`` has doc_id and text; it is read for the sketches, for the texts with candidates, and for the result.
    """
    with scratch_scope(docs.sparkSession):
        known = materialise(_linked_texts(docs, threshold, recall), "known", keep=True)
    rows = docs.select("doc_id", text_key("text").alias("text"))
    alone = F.col("n_copies").isNull()
    return rows.join(known, "text", "left").select(
        "doc_id",
        "text",
        F.coalesce("class_key", "text").alias("class_key"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def _decide(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(near_key, near_kept, near_id, near_rows): for each linked text, whether its class keeps it, and the id of the kept row."""
    linked = materialise(_linked_texts(docs, threshold, recall).where("n_links > 0"), "linked-texts")
    order = F.struct(F.col("copy_id").isNull().alias("none"), "copy_id", "text", "first_rows")
    # written, as a join above the aggregation could not split a large class
    first = materialise(linked.groupBy("class_key").agg(F.min(order).alias("first")), "class-firsts")
    return linked.join(first, "class_key").select(
        F.col("text").alias("near_key"),
        (F.col("first.text") == F.col("text")).alias("near_kept"),
        F.col("first.copy_id").alias("near_id"),
        F.col("first.first_rows").alias("near_rows"),
    )


def one_per_class(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id, and of those the first text by key.

    Rows without links are all kept. Of repeated rows one stays. Only texts that may be linked move, to meet the decision on them.
    """
    with scratch_scope(docs.sparkSession):
        decided = materialise(_decide(docs, threshold, recall), "decided", keep=True)
    key, maybe, kept_text, id_, again = (free_name(docs, c) for c in ("near_key", "near_maybe", "near_kept", "near_id", "near_again"))
    decision = decided.select(
        F.col("near_key").alias(key), F.col("near_kept").alias(kept_text), F.col("near_id").alias(id_), (F.col("near_rows") > 1).alias(again)
    )
    marked = may_be_in(docs.withColumn(key, text_key("text")), key, decision, maybe)
    met = marked.where(maybe).join(decision, key, "left")
    kept = met.where(F.col(kept_text).isNull() | (F.col(kept_text) & F.col("doc_id").eqNullSafe(F.col(id_))))
    several = F.coalesce(F.col(again), F.lit(False))
    rest = marked.where(~F.col(maybe)).select(docs.columns)
    if decided.where("near_kept and near_rows > 1").isEmpty():
        return rest.unionByName(kept.select(docs.columns))
    once = kept.where(several).dropDuplicates([key])
    return rest.unionByName(kept.where(~several).select(docs.columns)).unionByName(once.select(docs.columns))
