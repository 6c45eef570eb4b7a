"""Language ID, media columns and packing: held-out accuracy, exact round trips, brute force."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.util import SF, awkward_rows, table
from turnmill.llm import langid, media, packing, queries


def test_language_id_on_held_out_documents(spark):
    rows = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", F.length("text").alias("n")), "doc_id"
    ).collect()
    held = [r for r in rows if r["held_out"] and r["n"] > 40 and r["lang_pred"] != "und"]
    assert len(rows) == 1000 and len(held) > 200
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def brute_bits(texts, query, depth=langid.DEPTH):
    """Code length by the definition: method C with exclusion, one byte at a time."""
    tree = defaultdict(Counter)
    pad = bytes([langid.PAD]) * depth
    for t in texts:
        data = pad + t
        for i in range(depth, len(data)):
            for k in range(depth + 1):
                tree[data[i - k : i]][data[i]] += 1

    def p(context, byte):
        if context is None:
            return 1 / 256
        shorter = context[1:] if context else None
        found = tree.get(context)
        if not found:
            return p(shorter, byte)
        t, d = sum(found.values()), len(found)
        if byte in found:
            return found[byte] / (t + d)
        free = 1 - sum(p(shorter, b) for b in found)
        return d / (t + d) * p(shorter, byte) / free

    data = pad + query
    return sum(-math.log2(p(data[i - depth : i], data[i])) for i in range(depth, len(data)))


def test_code_lengths_are_exact(spark):
    learn = {"x": ["abracadabra abra", "cad abra"], "y": ["zebra zzz é", "brazen"]}
    rows = [(i, t, lang, None, None) for i, (lang, t) in enumerate((k, t) for k, v in learn.items() for t in v)]
    model = langid.train(table(spark, rows).withColumnRenamed("doc_id", "id"))
    assert model.languages == ["x", "y"]
    queries_ = ["abra", "z", "", "brazé\n q", "ab"]
    data = np.frombuffer("".join(queries_).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(q.encode()) for q in queries_])])
    got = model.bits(data, offsets)
    for i, q in enumerate(queries_):
        for k, lang in enumerate(model.languages):
            assert got[i, k] / langid.UNIT == pytest.approx(brute_bits([t.encode() for t in learn[lang]], q.encode()), rel=1e-6, abs=1e-5)


def test_long_texts_are_scored_in_blocks():
    """32 MB of text: equal to the sum over its bytes' own code lengths, wherever blocks and rows end."""
    grams, n = np.unique(langid.byte_runs(np.frombuffer(b"some text to learn from. " * 9, np.uint8), np.array([0, 225]), 0, 225), return_counts=True)
    model = langid.Model(["x", "y"], [langid.build_tree(grams, n.astype(float)), langid.build_tree(grams[:9], n[:9].astype(float))])
    part = np.frombuffer(("learning from text, é " * 50).encode(), np.uint8)
    times = (32 << 20) // len(part)
    long = np.tile(part, times)
    offsets = np.array([0, 3, 3, len(long)])
    got = model.bits(long, offsets)
    one, two, three = (model.bits(np.tile(part, k), np.array([0, k * len(part)]))[0] for k in (1, 2, 3))
    assert (two - one == three - two).all()  # from the second copy on, each costs the same
    tail = model.bits(part, np.array([0, 3, len(part)]))
    assert (got[0] == tail[0]).all() and (got[1] == 0).all()
    assert (got[2] == tail[1] + (times - 1) * (two - one)).all()


def test_language_id_edge_cases(spark):
    docs = table(spark).withColumn("score", F.lit("clash"))
    model = langid.train(docs.withColumnRenamed("doc_id", "id"))
    out = langid.identify(docs, model).collect()
    assert len(out) == len(awkward_rows())
    for r in out:
        text = r["row"]["text"]
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        else:
            assert r["lang_pred"] in ("en", "fr")
    assert langid.identify(table(spark, []), model).count() == 0
    nothing = langid.train(table(spark, []).withColumnRenamed("doc_id", "id"))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


@pytest.mark.parametrize("filter_type", range(5))
def test_png_round_trip(filter_type):
    rng = random.Random(filter_type)
    payload = bytes(rng.randrange(256) for _ in range(media.WIDTH * 3))
    stored = media.encode_png(payload, filter_type=filter_type)
    assert media.decode_png(stored).tobytes() == payload


def test_mixed_filters_in_one_image():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (10, 24), dtype=np.uint8)
    kinds = [2, 1, 2, 2, 3, 2, 4, 0, 1, 2]
    rows = np.zeros((10, 25), np.uint8)
    for y, k in enumerate(kinds):
        rows[y, 0] = k
        rows[y, 1:] = (image - media._predicted(image, k))[y]
    assert (media.unfilter(rows, 24) == image).all()


@pytest.mark.parametrize("seed", range(6))
def test_images_filtered_together_equal_those_filtered_one_by_one(seed):
    """All five filters are chosen, by the least sum of absolute differences, and undone as the definition says."""
    rng = np.random.default_rng(seed)
    width = int(rng.integers(1, 40))
    images = [np.cumsum(rng.integers(-3, 4, (int(rng.integers(1, 9)), width)), axis=int(rng.integers(0, 2))).astype(np.uint8) for _ in range(20)]
    images += [rng.integers(0, 256, (3, width), dtype=np.uint8), np.full((2, width), 255, np.uint8)]
    for image, stored in zip(images, media.encode_all([x.tobytes() for x in images], width), strict=True):
        rows = media.png_rows(stored)
        for y, row in enumerate(rows):
            above = image[y - 1].tolist() if y else [0] * width
            cost = {}
            for kind in range(5):
                left = []
                for x in range(width):
                    a, b, c = (int(image[y, x - 1]) if x else 0), above[x], (above[x - 1] if x else 0)
                    p = a + b - c
                    near = min(((abs(p - v), i) for i, v in enumerate((a, b, c))))[1]
                    left.append((int(image[y, x]) - [0, a, b, (a + b) // 2, (a, b, c)[near]][kind]) % 256)
                cost[kind] = sum(min(v, 256 - v) for v in left), kind, left
            assert (row[0], row[1:].tolist()) == min(cost.values())[1:]
        assert (media.decode_png(stored) == image).all()
        assert stored == media.encode_png(image.tobytes(), width)


def test_features_and_stored_bytes_against_the_definition(spark):
    """The hash by plain sums of cosines, and the stored form's size and digest."""
    for r in media.read_media(media.store_media(table(spark).where("doc_id < 9"))).collect():
        text = next((t or "").encode() for d, t, *_ in awkward_rows() if d == r["doc_id"])
        payload = media.pad(text)
        stored = media.encode_png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        n = len(payload) // 576
        tile = [[sum(payload[k * 576 + y * 24 + x] for k in range(n)) / n for x in range(24)] for y in range(24)]
        wave = [[math.cos(math.pi * u * (2 * x + 1) / 48) for x in range(24)] for u in range(8)]
        low = [round(sum(tile[y][x] * wave[u][y] * wave[v][x] for y in range(24) for x in range(24)), 6) for u in range(8) for v in range(8)]
        middle = sorted(low[1:])[31]
        bits = "".join("1" if v > middle else "0" for v in low)
        assert r["feature"] == f"{int(bits, 2):016x}"


def test_damage_is_found():
    stored = media.encode_png(media.pad(b"some text"))
    for at in (0, 20, len(stored) // 2, len(stored) - 3):
        broken = bytearray(stored)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(broken))
    with pytest.raises(ValueError):
        media.decode_png(stored[:-12])
    for header in (b"", struct.pack(">IIBBBBB", 0, 1, 8, 0, 0, 0, 0), b"\0" * 20):  # checksums fit, the header doesn't
        with pytest.raises(ValueError):
            media.decode_png(media.SIGNATURE + media._chunk(b"IHDR", header) + stored[33:])


def test_stored_rows_are_filtered(spark):
    for r in media.store_media(table(spark)).collect():
        at = r["media"].index(b"IDAT")
        (length,) = struct.unpack_from(">I", r["media"], at - 4)
        first = zlib.decompressobj().decompress(r["media"][at + 4 : at + 4 + length], 1)
        assert first[0] != media.NONE


def test_media_columns(spark):
    stored = media.store_media(table(spark).withColumn("media", F.lit(1)))
    out = {(r["doc_id"], r["n_bytes"]): r for r in media.read_media(stored).collect()}
    for doc_id, text, *_ in awkward_rows():
        payload = media.pad((text or "").encode())
        r = out[doc_id, len((text or "").encode())]
        assert r["payload_bytes"] == len(payload) and len(payload) % 576 == 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["error"] is None
    broken = stored.withColumn("media", F.when(F.col("doc_id").eqNullSafe(1), F.col("media")).otherwise(F.lit(b"x")))
    errors = {r["doc_id"]: r["error"] for r in media.read_media(broken).collect()}
    assert errors[1] is None and all(v for k, v in errors.items() if k != 1)
    assert media.store_media(table(spark, [])).count() == 0


def test_similar_payloads_have_near_hashes():
    text = open(__file__, "rb").read()
    a = media.cosine_hash(np.frombuffer(media.pad(text), np.uint8))
    b = media.cosine_hash(np.frombuffer(media.pad(text[:-40] + b"y" * 40), np.uint8))
    c = media.cosine_hash(np.frombuffer(media.pad(bytes(random.Random(3).randrange(256) for _ in text)), np.uint8))
    bits = lambda x, y: (int(x, 16) ^ int(y, 16)).bit_count()
    assert bits(a, b) < bits(a, c)


def tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    return reference.encode(text or "", add_special_tokens=False).ids


TEXTS = ["", None, "\n", " a", "a ", "  two  spaces ", "don't 12,3!?", "tab\tand\r\nlines\n\n\nend\n", "é  x", "a   b", "a　", "<|endoftext|> x", "x" * 3000]


def test_ids_are_the_vocabularys(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS + [r[1] for r in awkward_rows()])]
    got = defaultdict(dict)
    for r in packing.token_pieces(table(spark, rows), with_ids=True).collect():
        got[r["doc_id"]][r["piece"]] = r
    for i, text, *_ in rows:
        pieces = [got[i][k] for k in range(len(got[i]))]
        ids = list(itertools.chain(*[p["ids"] for p in pieces]))
        assert ids == [*tokens(text), 2]
        assert [p["start"] for p in pieces] == list(itertools.accumulate([0, *[p["length"] for p in pieces[:-1]]]))
        assert all(p["length"] == 1024 for p in pieces[1:]) and 1 <= pieces[0]["length"] <= 1024
        assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in pieces)


@pytest.mark.parametrize("run", [" ", "\n", " \t", "\u3000 "])
def test_long_runs_of_white_space(run, monkeypatch):
    """Ids around long runs are the vocabulary's; two million blanks don't exhaust the pattern."""
    monkeypatch.setattr(packing, "RUN", 50)
    monkeypatch.setattr(packing, "LONG_RUN", re.compile(packing.LONG_RUN.pattern.replace("20000", "50")))
    tokenise = packing.Tokeniser(packing.default_ranks())
    texts = [run * 40, run * 60, "a" + run * 60, run * 60 + "b", f"a{run * 60}b c{run * 90}", f"x {run * 70}\u3000y" + run * 10]
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = tokenise(data, np.array([0, len(data)]))
        assert ids.tolist() == tokens(text)
    monkeypatch.undo()
    data = np.frombuffer((" " * 2_000_000 + "end").encode(), np.uint8)
    ids, _ = tokenise(data, np.array([0, len(data)]))
    assert len(ids) == 2_000_000 and (ids[:-1] == ids[0]).all()


def check_placed(rows, capacity):
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in filled.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(filled)


def test_packing(spark):
    docs = table(spark).withColumn("length", F.lit("x")).withColumn("bin", F.lit(0))
    rows = packing.pack_documents(docs).collect()
    assert len({(r["doc_id"], r["piece"]) for r in rows if r["doc_id"] is not None}) >= len(awkward_rows()) - 2
    check_placed(rows, 1024)
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_packing_of_the_documents(spark):
    rows = queries.op7_packing(spark, "/root/testdata/sf0.01").collect()
    total = sum(r["length"] for r in rows)
    assert check_placed(rows, 1024) <= math.ceil(total / 1024) + 2


def optimum(sizes, capacity):
    """Fewest bins, by trying all placements."""
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= sizes[i]:
                bins[k] -= sizes[i]
                place(i + 1, bins)
                bins[k] += sizes[i]
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(120))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 30])
    sizes = sorted((rng.randint(max(1, capacity // 5), capacity) for _ in range(rng.randint(1, 8))), reverse=True)
    counts = Counter(sizes)
    fixed = packing.reduce_dominated(counts, capacity)
    rest = [s for s, n in counts.items() for _ in range(n)]
    assert all(sum(c) <= capacity for _, c in fixed)
    assert sorted(rest + [p for n, c in fixed for p in c * n]) == sorted(sizes)
    assert sum(n for n, _ in fixed) + (optimum(sorted(rest, reverse=True), capacity) if rest else 0) == optimum(sizes, capacity)


@pytest.mark.parametrize("seed", range(20))
def test_grouped_best_fit_equals_best_fit_one_by_one(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 50) for _ in range(rng.randint(0, 200))]
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= s]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= s
        else:
            bins.append(50 - s)
    packed = packing.best_fit(Counter(sizes), 50)
    assert sum(n for n, _ in packed) == len(bins)
    assert Counter(x for n, c in packed for x in c * n) == Counter(sizes)


def test_contract_columns(spark):
    assert queries.op2_language_id(spark, SF).columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert queries.op3_media(spark, SF).columns == "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()
    assert queries.op7_packing(spark, SF).columns == "doc_id piece start length ids_crc32 sequence_id offset".split()
