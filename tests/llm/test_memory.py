"""What a task holds of two large groups that meet must not be many whole pair matrices."""

import tracemalloc

import numpy as np

from tidemark.llm import common, ngram_jaccard as J


def _meeting(half):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 40).astype(np.uint64)
    sets = [np.unique(np.append(base, rng.integers(0, 1 << 60, k % 9).astype(np.uint64))) for k in range(2 * half)]
    return sets, np.arange(2 * half) % 2 == 1


def _plain(sets, side, percent):
    held = [set(s.tolist()) for s in sets]
    return np.array([[i != j and (side is None or side[i] != side[j]) and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(held)] for i, a in enumerate(held)])


def test_links_in_slices_equal_plain_comparison(monkeypatch):
    monkeypatch.setattr(J, "PAIRS", 50)
    sets, side = _meeting(20)
    for s in (None, side):
        link = J.open_group(sets, s, 90)
        assert np.array_equal(link, _plain(sets, s, 90)) and np.array_equal(link, link.T)
        size, samples = np.array([len(x) for x in sets], np.float64), [J._sample(x) for x in sets]
        alive = J._unparted(size, np.array([len(x) for x in samples], np.float64), J._overlaps(samples, s), s, 90)
        assert not (_plain(sets, s, 90).any(axis=1) & ~alive).any()
        root = common.forest(link)
        assert all(root[i] == root[j] for i, j in zip(*np.nonzero(link)))


def test_two_full_groups_meet_in_bounded_memory():
    sets, side = _meeting(J.GROUP_SETS)
    tracemalloc.start()
    link = J.open_group(sets, side, 80)
    common.forest(link)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6


def test_stages_get_their_rows_in_small_batches(spark, monkeypatch):
    """An input split of texts, or of sets, must not come as one Arrow batch."""
    from pyspark.accumulators import AccumulatorParam

    import corpus_pipeline as C
    from tests.llm.helpers import frame

    class Most(AccumulatorParam):
        def zero(self, value):
            return value

        def addInPlace(self, a, b):  # noqa: N802
            return max(a, b)

    most, seen, plain = spark.sparkContext.accumulator(0, Most()), [], common.with_batches

    def watched(df, *rows):
        batched, n = plain(df, *rows), len(seen)
        seen.append(n)

        def watch(batches):
            for b in batches:
                most.add(b.nbytes)
                yield b

        batched.df = batched.df.mapInArrow(watch, batched.df.schema)
        return batched

    monkeypatch.setattr(C.language_id, "with_batches", watched)
    monkeypatch.setattr(J, "with_batches", watched)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 1200)) for _ in range(1000)]
    docs = frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    assert C.identify_language(spark, docs, "").count() > 0 and len(seen) > 1
    assert C.drop_near_copies(spark, docs, "").count() == len(texts) and len(seen) > 3
    assert 1 << 20 < most.value < 6 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
