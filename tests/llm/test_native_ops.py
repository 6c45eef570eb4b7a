"""Mixing, exact dedup and sharding against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.util import DOCS, SF, awkward_rows, table, words
from turnmill.llm import exact_dedup, mixing, queries, sharding


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Shares by weight; what a source can't take goes round again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / w
        left = sum(max(0, target[s] - most * sizes[s]) for s in open_)
        full = {s for s in open_ if target[s] >= most * sizes[s]}
        for s in full:
            target[s] = most * sizes[s]
        open_ -= full
    return target


def test_mixing_takes_whole_copies_near_the_targets(spark):
    docs = table(spark)
    first = mixing.systematic_mix(docs).select("row.*", "size", "source_size", "target", "copies").collect()
    again = mixing.systematic_mix(docs.repartition(3)).select("row.*", "size", "source_size", "target", "copies").collect()
    assert Counter(first) == Counter(again)
    assert len(first) == len(awkward_rows())
    sizes = defaultdict(int)
    for r in first:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += r["size"]
    targets = brute_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in first:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 2 * largest[s]


def test_mixing_on_real_rows_is_close(spark):
    """Nothing is off by more than the largest document; many documents average out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    rows = queries.op4_mixing(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for own in by.values():
        taken = sum(r["taken"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own)
    assert sum(r["taken"] for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), rel=0.03)


def test_mixed_repeats_rows_and_keeps_clashing_columns(spark):
    docs = table(spark).withColumn("size", F.lit("mine")).withColumn("rank", F.lit(1))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    plan = mixing.systematic_mix(docs).select("row.doc_id", "copies").collect()
    assert out.count() == sum(r["copies"] for r in plan)
    assert mixing.mixed(table(spark, [])).count() == 0


def check_groups(rows, out):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[fold(text)].append(doc_id)
    expected = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, keep, len(ids), i == keep] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out) == expected


def test_exact_duplicates(spark):
    check_groups(awkward_rows(), exact_dedup.exact_duplicates(table(spark).withColumn("recipe", F.lit(1))).collect())
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


def test_exact_dedup_falls_back_when_identifiers_clash(spark):
    weak = (lambda c: F.length(c).cast("string"), lambda c: F.substring(c, 1, 1), lambda c: c)
    rows = [(i, x, None, None, None) for i, x in enumerate(["abc", "abd", "ABC", "xyz", "xyw", ""])]
    check_groups(rows, exact_dedup.exact_duplicates(table(spark, rows), identifiers=weak).collect())


def test_chunks_are_content_defined_and_lossless(spark):
    sentence = "This is one sentence of a text that repeats itself. "
    a = "".join(f"{i} {sentence}" for i in range(300))
    docs = table(spark, [(1, a, None, None, None), (2, "Prefix. " + a, None, None, None), (3, "x" * 10_000, None, None, None)])
    cut = [r[0] for r in docs.orderBy("doc_id").select(exact_dedup.chunks(F.col("text"))).collect()]
    assert ["".join(c) for c in cut] == [a, "Prefix. " + a, "x" * 10_000]
    assert all(len(x) <= exact_dedup.MAX_CHUNK for c in cut for x in c)
    assert len(set(cut[0]) & set(cut[1])) > len(cut[0]) // 2  # cuts realign after an insertion


def greedy(sizes, capacity):
    n, used = 1, 0
    for s in sizes:
        n, used = (n, used + s) if used + s <= capacity else (n + 1, s)
    return n


@pytest.mark.parametrize("sizes,shards", [([5, 1, 9, 2, 2, 7], 3), ([10], 4), ([1] * 20, 6), ([100, 1, 1, 1], 2)])
def test_minimax_capacity(spark, sizes, shards):
    col = F.array(*[F.lit(s).cast("long") for s in sizes])
    got = spark.range(1).select(sharding.minimax_capacity(col, shards)).first()[0]
    best = next(c for c in range(max(sizes), sum(sizes) + 1) if greedy(sizes, c) <= shards)
    assert got == best


def test_shards(spark):
    out = sharding.shard_documents(table(spark).withColumn("unit", F.lit("x")), 5).collect()
    rows = awkward_rows()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows
    )
    slots, homes, bytes_ = defaultdict(list), defaultdict(set), Counter()
    for r in out:
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"]].add(r["shard"])
        bytes_[r["shard"]] += r["size"]
    assert set(slots) <= set(range(5))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert sharding.shard_documents(table(spark, []), 5).count() == 0


@pytest.mark.parametrize("sizes,shards", [([5, 1, 9, 2, 2, 7], 3), ([10], 4), ([1] * 20, 6), ([30] + [1] * 60, 10), ([3, 8, 8, 1, 1, 1, 8], 4)])
def test_cuts_stay_under_the_capacity_and_near_equal_parts(spark, sizes, shards):
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    col = F.array(*[F.lit(e).cast("long") for e in ends])
    capacity = next(c for c in range(max(sizes), sum(sizes) + 1) if greedy(sizes, c) <= shards)
    cuts = spark.range(1).select(sharding.cut_ends(col, F.lit(capacity).cast("long"), shards)).first()[0]
    assert len(cuts) == shards and cuts[-1] == ends[-1] and cuts == sorted(cuts) and set(cuts) <= set(ends)
    assert max(b - a for a, b in zip([0, *cuts], cuts)) <= capacity  # noqa: B905
    if sizes == [30] + [1] * 60:
        assert sorted(Counter(b - a for a, b in zip([0, *cuts], cuts)).items()) == [(6, 3), (7, 6), (30, 1)]  # noqa: B905


@pytest.mark.parametrize("shards,bits,law", [(3, 3, "near"), (7, 16, "near"), (12, 5, "near"), (12, 4, "lumpy"), (5, 6, "lumpy")])
def test_no_shard_is_above_the_best_contiguous_cut(spark, shards, bits, law):
    """The whole operator against brute force over its atomic groups in their order, large ones set apart."""
    rng = random.Random(shards)
    rows = [(i, words(rng, rng.randint(0, 60)), "en", "a", 0) for i in range(80)]
    rows += [(200 + i, rows[i % 5][1], "en", "a", 0) for i in range(40)]
    if law == "lumpy":  # a few groups that are below an equal share, but not by much
        rows += [(300 + i, words(rng, 500 + 60 * i), "en", "a", 0) for i in range(shards)]
    else:
        rows += [(900, "long " * 6000, "en", "a", 0)]
    docs = table(spark, rows)
    unit = {r["doc_id"]: r["u"] for r in docs.select("doc_id", F.xxhash64("text").alias("u")).collect()}
    sizes = Counter()
    for d, t, *_ in rows:
        sizes[unit[d]] += len(t.encode()) + 16
    total, left, hot = sum(sizes.values()), shards, set()
    for u, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if n * left <= total:
            break
        total, left = total - n, left - 1
        hot.add(u)
    cold = [n for u, n in sorted(sizes.items()) if u not in hot]
    best = next(c for c in range(max(cold), sum(cold) + 1) if greedy(cold, c) <= left)
    groups = spark.createDataFrame([(u, n) for u, n in sizes.items() if u not in hot], "hash long, bytes long")
    plan = sharding.narrowed(groups, left, bits).first()
    assert plan["capacity"] == best  # over single groups, though the blocks hold several
    found, home = Counter(), {}
    for r in sharding.shard_documents(docs, shards, bits=bits).collect():
        found[r["shard"]] += r["size"]
        assert home.setdefault(unit[r["doc_id"]], r["shard"]) == r["shard"]
    assert (law == "lumpy" or hot) and sum(found.values()) == sum(sizes.values())
    assert all(found[home[u]] == sizes[u] for u in hot)
    assert max(n for s, n in found.items() if s not in {home[u] for u in hot}) <= best
    order = [home[u] for u in sorted(sizes) if u not in hot]
    assert order == sorted(order)  # contiguous


def test_most_blocks_are_never_split(spark):
    """Ends are searched among few groups: blocks away from them stay whole."""
    groups = spark.range(20_000).select(F.xxhash64("id").alias("hash"), (F.pmod(F.hash("id"), F.lit(900)) + 100).cast("long").alias("bytes"))
    rows = sorted((r["hash"], r["bytes"]) for r in groups.collect())
    plan = sharding.narrowed(groups, 8, 10).first()
    cold = [n for _, n in rows]
    low, high = max(cold), sum(cold)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(cold, mid) <= 8 else (mid + 1, high)
    assert plan["capacity"] == low
    assert sum(b["bytes"] for b in plan["blocks"]) == sum(cold) and len(plan["blocks"]) < 5_000


def test_one_group_with_a_third_of_the_bytes_has_its_own_shard(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 30), "en", "a", 0) for i in range(2000)]
    hot = "the same text again and again"
    rest = sum(len(t.encode()) + 16 for _, t, *_ in rows)
    rows += [(5000 + i, hot, "en", "a", 0) for i in range(rest // 2 // (len(hot) + 16))]
    unit = table(spark, [(1, hot, None, None, None)]).select(F.shiftright(F.xxhash64("text"), 64 - sharding.BITS)).first()[0]
    near = spark.range(1_000_000).select(F.concat(F.lit("t"), "id").alias("t")).where(F.shiftright(F.xxhash64("t"), 64 - sharding.BITS) == unit)
    beside = [r["t"] for r in near.collect()]
    assert beside  # texts that share the hot unit stay with the cold rows
    rows += [(90_000 + i, t, "en", "a", 0) for i, t in enumerate(beside)]
    out = sharding.shard_documents(table(spark, rows), 40).collect()
    size, texts, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in out:
        size[r["shard"]] += r["size"]
        texts[r["shard"]].add(r["text_crc32"])
        slots[r["shard"]].append(r["slot"])
    assert len(out) == len(rows) and set(size) == set(range(40))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    home, = [s for s, t in texts.items() if zlib.crc32(hot.encode()) in t]
    assert len(texts[home]) == 1
    others = [b for s, b in size.items() if s != home]
    largest = max(len(t.encode()) + 16 for _, t, *_ in rows)
    assert max(others) - min(others) <= 2 * largest and max(others) < 1.2 * sum(others) / 39


def test_shards_of_the_documents_are_near_equal(spark):
    out = queries.op10_sharding(spark, "/root/testdata/sf0.1").groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in out]
    assert len(sizes) == 40 and max(sizes) < 1.1 * sum(sizes) / 40


def test_schema_is_the_contract(spark):
    assert queries.op8_exact_dedup(spark, SF).dtypes == [
        ("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")
    ]
    assert [c for c, _ in queries.op10_sharding(spark, SF).dtypes] == "doc_id size text_crc32 law shard slot grown_shard".split()
    assert DOCS
