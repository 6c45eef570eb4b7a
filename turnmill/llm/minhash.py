"""Near-duplicate detection by min-max hashing.

Under each of `PERMUTATIONS` hash functions a document keeps both the smallest
and the largest value of its shingles. Either is an unbiased vote for equality,
so half as many evaluations fill a signature. Bands of `ROWS` values are bucket
keys: two documents of similarity s miss each other in all bands with
probability (1 - s**ROWS)**BANDS, 2e-5 at 0.8 and 4e-8 at 0.85.

Documents with the same set of shingles form a class and count once from then
on. Buckets connect classes to clusters, and links can only be inside a cluster.
Candidates are verified on the full sets, but never all pairs of a bucket: each
cluster's most central class, its hub, is compared with all others, and each
class with the bucket minimum that it meets most often. What differs from the
hub then bounds all other intersections (see `hub_bounds`); only pairs of one
bucket that aren't linked through the same class yet, and that pass the bound,
are verified. So no link that would change a component is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import Shelf, cut_lineage
from turnmill.llm.components import components
from turnmill.llm.filters import FILTER_BITS, doc_slot, passes, slot_filter
from turnmill.llm.words import free_memory, lists, mix, reduce_rows, slices, span_hashes, word_spans

SHINGLE = 5
PERMUTATIONS = 108
ROWS = 6
BANDS = 2 * PERMUTATIONS // ROWS
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLY = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
_FLIP = mix(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64) * _STEP)
_PLACES = mix(np.arange(5001, 5001 + SHINGLE, dtype=np.uint64) * _STEP) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of SHINGLE words of each row (all words, if fewer), and the rows' bounds in them."""
    spans = word_spans(data, offsets)
    words = span_hashes(data, spans)
    counts, bounds = spans.counts, spans.bounds
    n = len(words)
    if not n:
        return words, np.zeros(len(bounds), np.int64)
    last = np.repeat(bounds[1:], counts)
    full = np.arange(n) + SHINGLE <= last
    padded = np.concatenate([words, np.zeros(SHINGLE - 1, np.uint64)])
    values = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        values += padded[k : k + n] * _PLACES[k]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    for row in short:
        own = words[bounds[row] : bounds[row + 1]]
        values[bounds[row]] = (own * _PLACES[: len(own)]).sum() + np.uint64(len(own))
        full[bounds[row]] = True
    at = np.flatnonzero(full)
    return mix(values[at]), np.searchsorted(at, bounds)


def distinct_sets(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [np.unique(values[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


def digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def band_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One key per row and band; rows without shingles have meaningless keys."""
    rows = len(bounds) - 1
    signature = np.empty((2 * PERMUTATIONS, rows), np.uint64)
    for k in range(PERMUTATIONS):
        hashed = (values ^ _FLIP[k]) * _MULTIPLY[k]
        signature[k] = reduce_rows(np.minimum, hashed, bounds, 0)
        signature[PERMUTATIONS + k] = reduce_rows(np.maximum, hashed, bounds, 0)
    banded = signature.reshape(BANDS, ROWS, rows)
    keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], rows, 1)
    for k in range(ROWS):
        keys = mix(keys * _STEP + banded[:, k])
    return keys.T.copy().view(np.int64)


def sketch(texts: DataFrame) -> DataFrame:
    """(doc_id, n, digest, bands) for rows (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                values, bounds = shingles(data, offsets)
                sets = distinct_sets(values, bounds)
                keys = band_keys(values, bounds)
                n = np.array([len(s) for s in sets], np.int64)
                kept = keys[n > 0].ravel()
                edges = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])
                columns = [batch.column(0).slice(low, high - low), pa.array(n), pa.array(map(digest, sets), pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, lists(kept, edges, pa.int64())], ["doc_id", "n", "digest", "bands"]
                )
        free_memory()

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n long, digest binary, bands array<long>")


def full_sets(texts: DataFrame, nodes: DataFrame, shelf: Shelf) -> DataFrame:
    """(id, members): the full sets of `nodes` (id, rep, digest), worked out again from the texts of their `rep`."""
    docs = shelf.broadcast(slot_filter(nodes, doc_slot(F.col("rep"))))
    head = F.conv(F.hex(F.substring("digest", 1, FILTER_BITS // 8)), 16, 10).cast("long") + 1
    names = shelf.broadcast(slot_filter(nodes, head))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(docs.value, batch.column(0).to_numpy() - 1)))
            for _, _, data, offsets in slices(batch.column(1)):
                sets = [(digest(s), s) for s in distinct_sets(*shingles(data, offsets)) if len(s)]
                heads = np.array([int.from_bytes(d[: FILTER_BITS // 8]) for d, _ in sets], np.int64)
                sets = [sets[i] for i in np.flatnonzero(passes(names.value, heads))]
                edges = np.concatenate([[0], np.cumsum([len(s) for _, s in sets], dtype=np.int64)])
                members = np.concatenate([*[s for _, s in sets], np.zeros(0, np.uint64)]).view(np.int64)
                columns = [pa.array([d for d, _ in sets], pa.binary()), lists(members, edges, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "members"])
        free_memory()

    found = texts.select(doc_slot(F.col("doc_id")).alias("slot"), "text").mapInArrow(work, "digest binary, members array<long>")
    named = found.join(nodes.select("id", "digest"), "digest").groupBy("id").agg(F.first("members").alias("members"))
    return shelf.put(named)


def similar(a: Column, b: Column, percent: int) -> Column:
    """Whether two distinct arrays are similar: intersection to union as `percent` to 100."""
    common = F.size(F.array_intersect(a, b))
    return 100 * common >= percent * (F.size(a) + F.size(b) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) that are similar."""
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("right"))
    linked = similar(F.col("left"), F.col("right"), percent)
    return pairs.join(left, "a").join(right, "b").where(linked).select("a", "b")


def compared_with(hubs: DataFrame, placed: DataFrame, sets: DataFrame, shelf: Shelf) -> DataFrame:
    """For each class of `placed` (id, cluster) what differs from its cluster's hub (cluster, hub, classes):
    z, d and a are the sizes of the hub, of what is missing and of what is added."""
    hub_sets = shelf.put(hubs.join(sets.select(F.col("id").alias("hub"), F.col("members").alias("of_hub")), "hub"))
    own = placed.select("id", "cluster").join(sets, "id")
    missing, added = F.array_except("of_hub", "members"), F.array_except("members", "of_hub")
    # What is missing is told from what is added by its flipped bits.
    differences = F.concat(added, F.transform(missing, lambda e: F.bitwise_not(e)))
    sizes = [F.size("of_hub").alias("z"), F.size(missing).alias("d"), F.size(added).alias("a")]
    found = own.join(hub_sets, "cluster").select("id", "cluster", "hub", "classes", *sizes, differences.alias("differences"))
    return shelf.put(found)


def centres(compared: DataFrame, shelf: Shelf) -> DataFrame:
    """(cluster, hub, classes): the class nearest to what most classes of its cluster have in common.

    A difference from the old hub that more than half of the classes have is common. The
    distance from the common set is the number of other differences plus the common ones
    that a class lacks.
    """
    elements = compared.select("id", "cluster", "classes", F.explode("differences").alias("e"))
    common = elements.groupBy("cluster", "e").agg(F.count(F.lit(1)).alias("n"), F.first("classes").alias("classes"))
    common = shelf.put(common.where("2 * n > classes").select("cluster", "e"))
    shared = elements.join(common, ["cluster", "e"]).groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    nearness = 2 * F.coalesce("shared", F.lit(0)) - F.size("differences")
    nearest = F.max(F.struct(nearness.alias("near"), "id")).getField("id")
    return compared.join(shared, "id", "left").groupBy("cluster").agg(nearest.alias("hub"), F.first("classes").alias("classes"))


def hub_bounds(members: DataFrame, sets: DataFrame, percent: int, shelf: Shelf) -> DataFrame:
    """For each class of `members` (key, id, pivot, size): hub, linked (with the hub) and r, g, c, reach.

    If x lacks d elements of the hub z and has a others, two classes x and y of the
    cluster have |x & y| = |z| - d(x) - d(y) + s, where s counts the differences from z
    that both have. They are linked only if s >= g(x) + g(y) - c, with
    t = percent / (100 + percent), g = (1 - t) d + t a and c = (1 - 2 t) |z|. Differences
    that no one else has can't be shared, so with r = d + a less these, s <= min(r(x), r(y)).
    Hence y must have r(y) - g(y) >= g(x) - c: classes for which that exceeds `reach`,
    the cluster's largest r - g, are linked with none but the hub.
    """
    clusters = components(members.select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    places = members.groupBy(F.col("id").alias("node")).agg(F.sum("size").alias("places"))
    placed = cut_lineage(places.join(clusters, "node").select(F.col("node").alias("id"), "places", F.col("label").alias("cluster")))
    hubs = placed.groupBy("cluster").agg(
        F.max(F.struct("places", "id")).getField("id").alias("hub"), F.count(F.lit(1)).alias("classes")
    )
    guess = compared_with(hubs, placed, sets, shelf)
    compared = compared_with(centres(guess, shelf), placed, sets, shelf)
    alone = (
        compared.select("id", "cluster", F.explode("differences").alias("e"))
        .groupBy("cluster", "e")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
        .where("n = 1")
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("alone"))
    )
    t = percent / (100.0 + percent)
    bounds = compared.drop("differences").join(alone, "id", "left")
    bounds = bounds.withColumn("r", F.col("d") + F.col("a") - F.coalesce("alone", F.lit(0)))
    bounds = bounds.withColumn("g", (1 - t) * F.col("d") + t * F.col("a")).withColumn("c", (1 - 2 * t) * F.col("z"))
    bounds = cut_lineage(bounds)
    reach = cut_lineage(bounds.groupBy("cluster").agg(F.max(F.col("r") - F.col("g")).alias("reach")))
    linked = 100 * (F.col("z") - F.col("d")) >= percent * (F.col("z") + F.col("a"))
    return cut_lineage(bounds.join(reach, "cluster").select("id", "hub", linked.alias("linked"), "r", "g", "c", "reach"))


def class_links(nodes: DataFrame, texts: DataFrame, percent: int, shelf: Shelf) -> DataFrame:
    """(a, b): verified links between classes, enough to connect all that the links connect."""
    keyed = nodes.select(F.explode("bands").alias("key"), "id", "n")
    shared = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # Here and below, what is aggregated is written before it is joined, so that Spark can split a hot key's other side.
    members = shelf.put(keyed.join(shelf.put(shared), "key"))
    sets = full_sets(texts, shelf.put(nodes.select("id", "rep", "digest").join(members.select("id").distinct(), "id")), shelf)
    bounds = hub_bounds(members, sets, percent, shelf)
    hub_links = bounds.where("linked and id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    # Classes that the hub doesn't hold: each with the bucket minimum that it meets in most bands.
    met = members.where("id <> pivot").groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("bands"))
    first = met.groupBy("id").agg(F.max_by("pivot", F.struct("bands", "pivot")).alias("pivot"))
    first = first.join(bounds.where("not linked").select("id"), "id", "left_semi")
    first = cut_lineage(verified(first.select(F.col("pivot").alias("a"), F.col("id").alias("b")), sets, percent))
    # Labels: classes with the same one are linked through it.
    held = bounds.join(first.select(F.col("b").alias("id"), F.col("a").alias("by")), "id", "left")
    label = F.when(F.col("linked"), F.col("hub")).otherwise(F.coalesce("by", "id"))
    held = held.where(F.col("g") - F.col("c") <= F.col("reach") + 1e-6).select("id", label.alias("label"), "r", "g", "c")
    open_ = members.select("key", "id", "n").join(held, "id")
    labels = open_.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    main = labels.groupBy("key").agg(F.max(F.struct("size", "label")).getField("label").alias("main"), F.count(F.lit(1)).alias("labels"))
    open_ = cut_lineage(open_.join(cut_lineage(main.where("labels > 1").drop("labels")), "key"))
    # What is outside its bucket's main label with what has another one, where the bounds allow a link.
    x, y = open_.where("label <> main").alias("x"), open_.alias("y")
    enough = F.least("x.r", "y.r") >= F.col("x.g") + F.col("y.g") - F.col("x.c") - 1e-6
    sizes = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    joined = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & enough & sizes)
    pairs = cut_lineage(joined.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    return shelf.put(hub_links.union(first).union(verified(pairs, sets, percent)))


def near_duplicates(
    docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased in A-Z and split at ASCII white space; their sets are the
    distinct runs of five words (all words, if fewer). Documents are linked when
    their intersection is at least `percent` hundredths of their union; the component
    has the smallest id reachable. A text without words, or null, has no set, is
    linked with nothing and stays. Rows with one id but different texts are one
    document with the links of each. A null id is linked only to equal sets; it stays
    if nothing else does. Repeated rows are all marked alike. An empty table gives an
    empty table; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shelf, result = Shelf(docs.sparkSession), Shelf(docs.sparkSession)
    sketched = result.put(sketch(texts))
    filled = sketched.where("n > 0")
    classes = filled.groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    nodes = shelf.put(classes.withColumn("id", F.monotonically_increasing_id()))
    links = class_links(nodes, texts, percent, shelf)
    several = filled.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y")
    first, other = nodes.select(F.col("digest").alias("x"), F.col("id").alias("a")), nodes.select("digest", F.col("id").alias("b"))
    same_id = filled.join(several, "doc_id").select("x", "digest").join(first, "x").join(other, "digest").select("a", "b")
    labels = components(links.union(same_id))
    owners = nodes.select("id", "digest", "rep").join(labels.withColumnRenamed("node", "id"), "id", "left")
    owners = owners.withColumn("label", F.coalesce("label", "id"))
    smallest = cut_lineage(owners.groupBy("label").agg(F.min("rep").alias("component_id")))
    component = result.put(owners.join(smallest, "label").select("digest", "component_id"))
    shelf.clear()
    linked = filled.select("doc_id", "n", "digest").join(component, "digest").select("doc_id", "n", "component_id")
    alone = sketched.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
