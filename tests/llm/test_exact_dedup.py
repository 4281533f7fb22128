import hashlib
import re

import numpy as np
import pytest

from tripleforge.llm import binary_fuse, exact_dedup

ROWS = [
    (5, "a  b", "en", "s", 1), (3, "a\tb", None, "s", 1), (9, None, "en", None, 0), (4, "", "en", "s", 0), (7, " ", "en", "s", 1), (8, "A b", "en", "s", 1), (3, "a\tb", None, "s", 1),
    (None, "only null ids", "x", "y", 1), (11, "é" * 5000, "fr", "z", 1), (12, "é" * 5000, "fr", "z", 1),
]
SCHEMA = "doc_id long, text string, lang string, keep_id string, text_sha256 int"  # extra columns with clashing names


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 60_000])
def test_filter_has_no_false_negatives(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    f = binary_fuse.build(keys)
    assert binary_fuse.contains(keys, *f).all()
    if n >= 1000:
        assert len(f[3]) < 1.5 * n
        assert binary_fuse.contains(np.random.default_rng(7).integers(0, 2**63, 20_000).astype(np.uint64), *f).mean() < 0.01


def brute(rows):
    key = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t, *_ in rows]
    out = []
    for (i, *_), k in zip(rows, key):
        ids = [r[0] for r, k2 in zip(rows, key) if k2 == k]
        out.append((i, min((x for x in ids if x is not None), default=None), len(ids), k))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = exact_dedup.exact_dedup(df).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(ROWS)
    kept = [r.doc_id for r in got if r.kept]
    assert sorted(map(str, kept)) == sorted(map(str, [3, 4, 7, 8, None, 11])), "one row of each text"


def test_snapshots_and_batch_do_not_matter(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "KEYS_PER_FILTER", 2)
    df = spark.createDataFrame(ROWS, SCHEMA)
    parts = [(F.lit(0), 1), (F.lit(None).cast("int"), 2), ((F.col("doc_id") > 4).cast("int"), 2), (F.col("doc_id") % 4, 3), (None, 0)]
    all_ = [sorted(map(str, exact_dedup.exact_dedup(df, part=p, snapshots=n).collect())) for p, n in parts]
    assert all(x == all_[0] for x in all_) and len(all_[0]) == len(ROWS)


def test_stored_snapshots_are_opened_again(spark, tmp_path):
    """A batch meets two stored snapshots, one of which is empty; only what they hold passes the filters."""
    from pyspark.sql import functions as F

    groups = exact_dedup.exact_buckets(exact_dedup.digests(spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"))))
    exact_dedup.write_snapshot(groups, str(tmp_path / "a"))
    exact_dedup.write_snapshot(groups.limit(0), str(tmp_path / "b"))
    stored = [exact_dedup.open_snapshot(spark, str(tmp_path / x)) for x in "ba"]
    batch = exact_dedup.exact_buckets(exact_dedup.digests(spark.range(400, 900).select((F.col("id") - 399).alias("doc_id"), F.concat(F.lit("t\t"), "id").alias("text"))))
    screened = exact_dedup.screen(batch, stored[1], 10_000_000)  # by many tasks
    assert 100 <= screened.where("maybe").count() <= 110 and screened.count() == 500
    got = exact_dedup.merge(batch, stored)
    assert got.count() == 900 and got.where("group_size = 2").count() == 100
    assert sorted(r[0] for r in got.where("group_size = 2").select("keep_id").collect()) == list(range(1, 101))


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_texts_of_one_digest_are_compared(spark, monkeypatch, most):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "MOST_BROADCAST", most)
    df = spark.createDataFrame([*ROWS, (30, "a c", None, None, None)], SCHEMA)
    groups = exact_dedup.exact_buckets(exact_dedup.digests(df))
    exact_dedup.verify(df, groups)
    monkeypatch.setattr(exact_dedup, "_sha", lambda text: F.sha2(F.substring(text, 1, 1).cast("binary"), 256))
    with pytest.raises(ValueError):
        exact_dedup.verify(df, exact_dedup.exact_buckets(exact_dedup.digests(df)))


def test_keep_first_keeps_columns_and_empty(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = exact_dedup.keep_first(df)
    assert out.columns == df.columns and out.count() == 6
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0 and exact_dedup.keep_first(df.limit(0)).count() == 0
