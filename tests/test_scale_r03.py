"""Work that must not grow faster than its tables: blocks, passes over the input, partitions and files."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidemark.operators import boost, network, vectors
from tidemark.plans import models_q
from tidemark.sources import io


def test_sibling_sums_equal_sums_of_all_rows():
    rng = np.random.default_rng(0)
    bins = rng.integers(0, 32, (500, 5)).astype(np.uint8)
    at, g, h = rng.integers(1, 3, 500), np.rint(rng.normal(size=500) * 2**30), np.rint(rng.random(500) * 2**30)
    cell, nodes = boost.cells(bins, np.array([0, 2, 4])), np.array([1, 2])
    whole = boost.histogram(cell, at, nodes, g, h, 32)
    above = np.array([0]), boost.histogram(cell, np.zeros(500, np.int64), np.array([0]), g, h, 32)
    assert np.array_equal(boost.level_sums(cell, at, nodes, g, h, 32, above), whole)
    for n, f, b in ((0, 1, 7), (1, 2, 31)):
        rows = (at == nodes[n]) & (bins[:, [0, 2, 4][f]] == b)
        assert whole[n, f, b].tolist() == [int(g[rows].sum()), int(h[rows].sum())]


def test_booster_blocks_follow_cells_and_cores(spark):
    df = spark.range(70_000).select("id", (F.col("id") % 2).cast("int").alias("y"), F.array(F.col("id").cast("double")).alias("x"))
    edges = boost.bin_edges(df, "x")
    assert boost.make_blocks(df, edges, "x", "y", "id").count() == 1  # 70 kB of bins
    many = boost.make_blocks(df, edges, "x", "y", "id", block_rows=60_000)
    assert many.count() == spark.sparkContext.defaultParallelism and many.rdd.getNumPartitions() == many.count()


def test_configurations_are_dealt_by_their_cost():
    states = [network.State(network.Config(batch=b), np.zeros(n), np.zeros(0), np.zeros(0)) for n in (1_000, 50_000) for b in (32, 64, 128) for _ in range(8)]
    dealt = network.deal(states, range(len(states)), 4)
    assert sorted(k for part in dealt for k in part) == list(range(len(states)))
    load = [sum((1 + len(states[k].flat) / 12_000) / states[k].config.batch for k in part) for part in dealt]
    assert max(load) <= 1.1 * min(load)


def test_slices_train_what_one_task_a_block_trains(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, int(v[0] > 0), [float(a) for a in v], "train" if i % 3 else "valid") for i, v in enumerate(rng.normal(size=(240, 3)))]
    blocks = network.make_blocks(spark.createDataFrame(rows, "id long, y int, x array<double>, split string"), "x", "y", "id", "split", "train", block_rows=120)
    configs = [network.Config((4,), rate=r, batch=16, epochs=3) for r in (0.01, 0.05, 0.1)]
    together = network.fit_many(blocks, configs, 3, 2)
    for c, s in zip(configs, together):
        (one,) = network.fit_many(blocks, [c], 3, 2)  # one configuration: one slice
        assert np.array_equal(one.flat, s.flat) and one.history == s.history


def test_pca_reads_its_rows_twice_and_keeps_digits(spark):
    n, seen = 400, spark.sparkContext.accumulator(0)
    x = np.random.default_rng(1).normal(size=(n, 5)) * [5, 3, 1, 1, 1] + 1e6
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(7)

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = {r.id: (r.pca_0, r.pca_1) for r in vectors.pca2(df.mapInArrow(watched, df.schema), "id", "v").collect()}
    assert seen.value == 2 * n
    xc = x - x.mean(0)
    ref = xc @ np.linalg.eigh(np.cov(xc, rowvar=False))[1][:, ::-1][:, :2]
    g = np.array([got[i] for i in range(n)])
    assert all(min(np.abs(g[:, j] - ref[:, j]).max(), np.abs(g[:, j] + ref[:, j]).max()) < 1e-6 for j in range(2))


@pytest.mark.parametrize("n,rows,want", [(1_000, 97, 11), (150_000, 97, 32), (800_000, 97, 49), (800_000, 16_384, 49), (0, 97, 1)])
def test_small_blocks_do_not_multiply(n, rows, want):
    assert vectors.block_count(n, rows) == want


def test_compressed_tickets_are_read_again(spark, tmp_path):
    rows = [(1, 'a "quoted"\nline', 2.5), (2, None, None), (3, "x,y" * 2000, 0.0)]
    df = spark.createDataFrame(rows, "id long, text string, x double")
    for compression in ("gzip", "none"):
        path = io.write_csv(df, str(tmp_path / compression), compression=compression)
        assert bool(glob.glob(f"{path}/*.csv.gz")) == (compression == "gzip")
        assert sorted(tuple(r) for r in io.read_csv(spark, path, df.schema).collect()) == rows


def test_feature_partitions_follow_the_rows(spark, monkeypatch):
    before = models_q._ticket_rows(spark, SF_SMALL).rdd.getNumPartitions()
    monkeypatch.setattr(models_q, "PART_BYTES", 1 << 16)
    d = models_q._ticket_rows(spark, SF_SMALL)
    assert d.rdd.getNumPartitions() == -(-d.count() * 8 * models_q.N_FEATURES // (1 << 16)) > before
