"""Hilbert shards and block nearest neighbours."""

import itertools
import math
import zlib
from collections import Counter

from livetick.llm.block_knn import nearest
from livetick.llm.hilbert_shards import hilbert_index, sharded
from pyspark.sql import functions as F


def test_curve_visits_every_cell_and_steps_to_neighbours(spark):
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        names = [f"a{i}" for i in range(axes)]
        cells = list(itertools.product(range(1 << bits), repeat=axes))
        rows = hilbert_index(spark.createDataFrame(cells, names), names, bits, "h").orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(len(cells)))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(a[n] - b[n]) for n in names) == 1


def check(rows, source, shards):
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - (min(sizes.values()) if len(sizes) == shards else 0) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in source)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {(r["law"], r["grown_shard"]) for r in rows} <= {("rows", None)}


def test_shards(spark, odd, none, documents):
    for docs, shards in ((odd, 24), (odd, 3), (documents, 24)):
        check(sharded(docs, shards).collect(), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], shards)
    assert sharded(none).count() == 0
    once = [tuple(r) for r in sharded(documents).orderBy("shard", "slot").collect()]
    again = [tuple(r) for r in sharded(documents.repartition(7)).orderBy("shard", "slot").collect()]
    assert once == again


def test_shards_run_in_the_jvm(documents):
    plan = sharded(documents)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def brute(vectors, queries, k):
    usable = [(i, v) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in usable if i in queries}:
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, v))), i) for i, v in usable if i != q and len(v) == len(x))
        out += [(q, r, i, round(d, 9)) for r, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


def test_neighbours(spark, data_dir, monkeypatch):
    from livetick.llm import block_knn

    odd = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]),
           (7, [None, 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [1e-30, 0.0]), (11, [3e5, -4.0]), (100, [2.0, 2.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in odd], "vec_id bigint, embedding array<double>, q string, dim int")
    got = nearest(frame, frame.where("vec_id % 5 = 0"), 3)
    assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in got.collect()) == brute(odd, {0, 5, 10, 100}, 3)
    assert nearest(frame.limit(0), frame.limit(0)).count() == 0
    monkeypatch.setattr(block_knn, "QUERY_BLOCK", 3)
    monkeypatch.setattr(block_knn, "CANDIDATE_BLOCK", 7)
    table = spark.read.parquet(f"{data_dir}/embeddings.parquet").limit(200)
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in table.collect()]
    got = nearest(table, table.where(F.col("vec_id") % 10 == 0))
    assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in got.collect()) == brute(rows, {i for i, _ in rows if i % 10 == 0}, 10)


def test_neighbours_of_huge_and_tiny_vectors(spark, monkeypatch):
    """Components whose squares leave a double's range; no finite vector is lost and no distance is infinite or 0 for that."""
    from livetick.llm import block_knn

    monkeypatch.setattr(block_knn, "CANDIDATE_BLOCK", 5)
    rows = [(i, [s * (1 + i), -s * i * 0.5]) for i, s in enumerate([1e160, 1e160, -1e160, 1e-170, 1e-170, 3e-170, 1.0, 2.0, 1e160, 1e150, 1e-150, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nearest(frame, frame.where("vec_id % 2 = 0"), 4).collect()
    want = []
    for q, x in rows[::2]:
        near = sorted((math.hypot(x[0] - v[0], x[1] - v[1]), i) for i, v in rows if i != q)[:4]
        want += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted(w[:3] for w in want)
    assert all(abs(g[3] - w[3]) <= 1e-12 * w[3] for g, w in zip(sorted(map(tuple, got)), sorted(want), strict=True))


def test_repeated_vectors_do_not_share_a_block(spark):
    from livetick.llm.block_knn import packed, usable

    frame = spark.range(4000).selectExpr("7L AS vec_id", "array(1D, 2D) AS embedding")
    sizes = [len(r["ids"]) // 8 for r in packed(usable(frame), 8, "c").collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1000


def test_text_classes_follow_whole_values(spark):
    from livetick.llm.hilbert_shards import text_borders

    rows = spark.range(1000).selectExpr("concat('https://example.org/', lpad(id % 100, 3, '0')) AS source").union(spark.sql("SELECT CAST(NULL AS string)"))
    borders = text_borders(rows, "source", 4)
    assert borders == [f"https://example.org/{n:03d}" for n in (24, 49, 74)]
    assert text_borders(rows.limit(0), "source", 4) == [] == text_borders(spark.sql("SELECT 'one' AS source"), "source", 4)
