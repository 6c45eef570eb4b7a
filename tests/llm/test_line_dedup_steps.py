"""Steps of line dedup that were made cheaper give what they gave."""

import math

import numpy as np

from turnmill.llm import line_dedup, words
from turnmill.llm.common import Shelf


def test_one_sort_orders_like_three():
    draw = np.random.default_rng(5)
    for n, lines in ((0, 1), (1, 1), (5000, 40), (5000, 3)):
        line = np.sort(draw.integers(0, lines, n))
        hashes = draw.integers(0, 1 << 63, n, np.uint64)
        hashes[: n // 2] = hashes[n // 2 : n // 2 * 2]
        often = (hashes >> np.uint64(60)).astype(np.uint8)
        order = line_dedup._sorted_by(line, often, hashes)
        assert [*zip(line[order], often[order], hashes[order])] == sorted(zip(line, often, hashes))
    # Hashes that differ in their last bits only, and very many lines: still exact.
    close = np.array([7, 5, 7, 6, 5], np.uint64)
    for line in (np.zeros(5, np.int64), np.array([0, 1 << 21, 1 << 21, 1 << 21, 1 << 21])):
        order = line_dedup._sorted_by(line, np.zeros(5, np.uint8), close)
        assert [*zip(line[order], close[order])] == sorted(zip(line, close))


def test_counts_come_by_block(spark, monkeypatch):
    """Tasks hand on a row for each block of cells, not one for each cell; the grades are those of the sums."""
    texts = [f"w{k % 7} W{k % 50} only{k}\nw{k % 7}" for k in range(400)]
    seen = []
    plain = type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, *by: seen.append(self.count()) or plain(self, *by))
    grades = line_dedup.token_counts(plain(spark.createDataFrame([(t,) for t in texts], "text string"), 3))
    assert len(seen) == 1 and 0 < seen[0] <= 3 * line_dedup.CELLS // line_dedup.BLOCK
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    spans = words.word_spans(data, np.array([0, len(data)]))
    cells, n = np.unique(line_dedup._cells(words.span_hashes(data, spans)), return_counts=True)
    expected = np.zeros(line_dedup.CELLS, np.uint8)
    expected[cells] = [min(math.floor(math.log2(x) * 8 + 1e-9), 255) for x in n]
    assert (grades == expected).all() and expected.max() > 40


def test_whole_number_bounds_are_the_required_ones():
    """The join's conditions without division let the same pairs through."""
    for percent in (50, 80, 85, 100):
        for total in range(2, 200):
            need = -(-percent * total // (100 + percent))
            for least in range(total):
                assert (least >= need) == ((100 + percent) * least >= percent * total)
            for differ in range(total % 2, total + 1, 2):
                assert (differ <= total - 2 * need) == ((100 + percent) * (total - differ) >= 2 * percent * total)


def test_hashes_do_not_depend_on_the_block():
    """Pieces that cross blocks, and longer ones, hash alike wherever they are."""
    long = b"x" * (3 * words.HASH_BYTES + 5)
    found = []
    for before in (0, 1, words.HASH_BYTES - 3, words.HASH_BYTES):
        data = np.frombuffer(b" " * before + long + b" tail " + b"y" * words.HASH_BYTES + b" tail", np.uint8)
        hashes = words.span_hashes(data, words.word_spans(data, np.array([0, len(data)])))
        assert len(hashes) == 4 and hashes[1] == hashes[3]
        found.append(hashes.tolist())
    assert all(x == found[0] for x in found) and words.HASH_BYTES < words.SLICE_BYTES


def test_tables_of_hashes_have_no_dictionaries(spark, tmp_path):
    shelf = Shelf(spark, **line_dedup.PLAIN)
    rows = shelf.put(spark.range(1000).selectExpr("xxhash64(id) AS h"))
    import pyarrow.parquet as pq

    encodings = [e for f in rows.inputFiles() for e in pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).column(0).encodings]
    assert encodings and not any("DICTIONARY" in e for e in encodings)
    shelf.clear()
