"""Search and clustering against brute force, and their properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.functions.blocks import Nearest, closest
from themeloom.operators import approx, clusters, search, themes

rng = np.random.default_rng(7)


def collection(spark, vectors, ids=None):
    ids = ids or [f"{i:04d}" for i in range(len(vectors))]
    return spark.createDataFrame(
        [(i, f"n{i}", [float(x) for x in v]) for i, v in zip(ids, vectors)],
        "id string, stock_name string, embedding array<double>",
    )


def as_queries(rows):
    return rows.select(F.col("id").alias("query_id"), "embedding")


def brute(queries, rows, k, skip_self=False):
    out = {}
    for qi, q in queries:
        hits = sorted((float(((q - v) ** 2).sum()), i) for i, v in rows if not (skip_self and i == qi))
        out[qi] = [i for _, i in hits[:k]]
    return out


def by_query(hits, column="code"):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r[column])
    return out


@pytest.mark.parametrize("skip_self", [False, True])
@pytest.mark.parametrize("path", ["sent", "one block", "blocks"])
def test_topk_with_many_copies(spark, monkeypatch, path, skip_self):
    """A third of the rows share one vector, and ties go to the smallest ids."""
    vectors = rng.normal(size=(300, 8))
    vectors[::3] = vectors[0]
    rows = collection(spark, vectors)
    pairs = [(f"{i:04d}", v) for i, v in enumerate(vectors)]
    if path != "sent":
        monkeypatch.setattr(search, "MAX_QUERY_BYTES", 1)
    if path == "blocks":
        monkeypatch.setattr(search, "QUERY_BLOCK", 40)
        monkeypatch.setattr(search, "ROW_BLOCK", 25)
    got = by_query(search.topk(as_queries(rows), rows, 7, skip_self=skip_self))
    assert got == brute(pairs, pairs, 7, skip_self)


def test_topk_limits(spark):
    rows = collection(spark, [[1, 0], [0, 1]])
    hits = search.topk(as_queries(rows), rows, 10).collect()
    assert len(hits) == 4 and all(0 < r.score <= 1 for r in hits)
    assert search.topk(as_queries(rows).where("false"), rows, 3).count() == 0
    assert search.topk(as_queries(rows), rows.where("false"), 3).count() == 0


def test_similar_leaves_itself_out(spark):
    rows = collection(spark, rng.normal(size=(20, 4)))
    got = by_query(search.similar_to(rows, ["0003", "nope"], 5))
    assert list(got) == ["0003"] and len(got["0003"]) == 5 and "0003" not in got["0003"]
    one = [r.code for r in search.similar_to_id(rows, "0003", 5).orderBy("rank").collect()]
    assert one == got["0003"]
    assert search.similar_to_id(rows, "nope", 5).count() == 0


def test_block_kernel_across_slices():
    import pyarrow as pa

    from themeloom.functions import blocks

    q, c = rng.normal(size=(1100, 3)), rng.normal(size=(9000, 3))
    c[4000:7000] = c[0]
    ids = [f"{i:05d}" for i in range(len(c))]
    state = Nearest(pa.array(np.arange(len(q))), q, 5, "l2", False)
    for s in range(0, len(c), 3500):
        state.add(pa.table({"id": ids[s:s + 3500]}), c[s:s + 3500])
    schema = pa.schema([("query_id", pa.int64()), ("d", pa.float64()), ("id", pa.string())])
    got = state.result(schema).to_pandas().sort_values(["query_id", "d", "id"])
    for qi in (0, 511, 512, 1099):
        d = np.sqrt(((q[qi] - c) ** 2).sum(1))
        want = [ids[i] for i in sorted(range(len(c)), key=lambda i: (d[i], ids[i]))[:5]]
        assert got[got.query_id == qi].id.tolist() == want
    assert closest(np.zeros((3, 2)), np.array([[1.0, 0], [0, 1.0]])).tolist() == [0, 0, 0]
    assert blocks.matrix(pa.array([], pa.list_(pa.float64()))).shape == (0, 0)


def numpy_distance(metric, q, v):
    if metric == "cosine":
        return 1 - q @ v / (np.linalg.norm(q) * np.linalg.norm(v) + 1e-8)
    return float(np.sqrt(((q - v) ** 2).sum()))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_blocks_are_pruned_and_lose_nothing(spark, monkeypatch, metric):
    """Far groups, short vectors and zeros; block pairs that cannot matter are left out."""
    centers = rng.normal(size=(8, 6)) * 20
    vectors = np.vstack([c + rng.normal(size=(60, 6)) for c in centers] + [np.zeros((3, 6)), 1e-9 * rng.normal(size=(5, 6))])
    vectors[100:140] = vectors[100]
    rows = collection(spark, vectors)
    monkeypatch.setattr(search, "QUERY_BLOCK", 50)
    monkeypatch.setattr(search, "ROW_BLOCK", 30)
    seen = []
    real = search._surviving
    monkeypatch.setattr(search, "_surviving", lambda *a: seen.append((len(a[0]) * len(a[1]), real(*a))) or seen[-1][1])
    got = by_query(search.topk(as_queries(rows), rows, 5, metric, skip_self=True, query_bytes=1))
    (possible, kept), = seen
    assert len(kept) < possible
    for i, q in enumerate(vectors):
        d = {f"{j:04d}": numpy_distance(metric, q, v) for j, v in enumerate(vectors) if j != i}
        limit = sorted(d.values())[4]
        assert len(got[f"{i:04d}"]) == 5 and all(d[c] <= limit + 1e-7 for c in got[f"{i:04d}"])


def test_queries_never_pass_through_the_driver(spark, monkeypatch):
    rows = collection(spark, rng.normal(size=(200, 4)))
    monkeypatch.setattr(search, "QUERY_BLOCK", 50)
    monkeypatch.setattr(search, "_scan", None)
    assert search.topk(as_queries(rows), rows, 3, query_bytes=1).count() == 600


def sf_vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.lpad(F.col("vec_id").cast("string"), 6, "0").alias("id"), F.lit("n").alias("stock_name"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


@pytest.mark.parametrize("k, metric", [(10, "l2sq"), (30, "l2"), (10, "cosine")])
def test_approximate_search_recall(spark, sf, k, metric):
    rows = sf_vectors(spark, sf)
    exact = search.topk(as_queries(rows), rows, k, metric)
    index = approx.build_index(rows, n_lists=40)
    assert approx.recall(approx.approx_topk(as_queries(rows), index, k, metric=metric), exact).first().recall >= 0.9
    lists, vectors = index.settings_for(k, metric)
    assert lists <= index.model.lists and k <= vectors < index.size
    whole = approx.approx_topk(as_queries(rows), index, k, probes=index.model.lists, metric=metric, rerank=index.size)
    assert approx.recall(whole, exact).first().recall == 1.0


def test_lists_prune_where_vectors_lie_in_groups(spark):
    """With neighbours close together a tenth of the rows is enough."""
    centers = rng.normal(size=(50, 16)) * 5
    vectors = np.vstack([c + 0.3 * rng.normal(size=(40, 16)) for c in centers])
    rows = collection(spark, vectors)
    index = approx.build_index(rows)
    lists, measured = index.settings_for(10, "l2sq")
    sizes = np.sort(index.sizes)[::-1]
    assert measured <= 0.1 * index.size and sizes[:lists].sum() <= 0.35 * index.size
    exact = search.topk(as_queries(rows), rows, 10)
    assert approx.recall(approx.approx_topk(as_queries(rows), index, 10), exact).first().recall >= 0.9


@pytest.mark.parametrize("skip_self", [False, True])
def test_approximate_search_splits_a_large_group(spark, monkeypatch, skip_self):
    monkeypatch.setattr(approx, "ROW_BLOCK", 16)
    monkeypatch.setattr(approx, "LEAST_BLOCK", 30)
    vectors = rng.normal(size=(200, 4))
    vectors[:70] = vectors[0]
    rows = collection(spark, vectors)
    index = approx.build_index(rows, n_lists=3)
    assert index.size == 200
    hits = approx.approx_topk(as_queries(rows), index, 5, probes=4, rerank=200, skip_self=skip_self)
    pairs = [(f"{i:04d}", v) for i, v in enumerate(vectors)]
    assert by_query(hits) == brute(pairs, pairs, 5, skip_self)


def test_approximate_search_probes_until_it_has_k(spark):
    rows = collection(spark, rng.normal(size=(120, 4)))
    index = approx.build_index(rows, n_lists=30)
    got = by_query(approx.approx_topk(as_queries(rows), index, 60, probes=1, rerank=60))
    assert len(got) == 120 and all(len(set(v)) == 60 for v in got.values())
    assert approx.approx_topk(as_queries(rows).limit(2), index, 200, probes=1, rerank=1).count() == 240


def test_approximate_search_of_few_or_no_rows(spark):
    rows = collection(spark, np.eye(3))
    index = approx.build_index(rows)
    assert by_query(approx.approx_topk(as_queries(rows), index, 2, skip_self=True)).keys() == {"0000", "0001", "0002"}
    none = approx.build_index(rows.where("false"))
    assert none.size == 0 and approx.approx_topk(as_queries(rows), none, 2).count() == 0
    assert approx.approx_topk(as_queries(rows).where("false"), index, 2).count() == 0


def test_many_lists_rank_those_of_near_groups(spark, monkeypatch):
    monkeypatch.setattr(approx, "RANKED_LISTS", 10)
    x = rng.normal(size=(3000, 8))
    model = approx.fit(x, 400, 1)
    sizes = np.bincount(model.encode(x)[0], minlength=model.lists)
    near = model.near_lists(x[:50], "l2sq", 20, 10, sizes)
    assert all(len(n) >= 20 and (sizes[n] > 0).all() for n in near)
    deep = model.near_lists(x[:5], "l2sq", 1, 3000, sizes)
    assert all(sizes[n].sum() == 3000 for n in deep)


def test_kmeans_properties(spark):
    centers = rng.normal(size=(4, 6)) * 10
    vectors = np.vstack([c + rng.normal(size=(25, 6)) for c in centers])
    rows = collection(spark, vectors)
    found = clusters.kmeans(rows, 4)
    labels = {r.code: r.cluster_id for r in found.labels.collect()}
    assert len(labels) == 100
    groups = [{labels[f"{i:04d}"] for i in range(s, s + 25)} for s in range(0, 100, 25)]
    assert all(len(g) == 1 for g in groups)
    # Clusters are numbered by their smallest member.
    assert [min(g) for g in groups] == [0, 1, 2, 3]
    assert found.cost <= clusters.kmeans(rows, 4, starts=1).cost + 1e-9
    assert {r.code: r.cluster_id for r in clusters.kmeans(rows, 4).labels.collect()} == labels
    assert sum(r["size"] for r in found.clusters.collect()) == 100


@pytest.mark.parametrize("n, k, want", [(0, 3, 0), (1, 3, 1), (5, 1, 1), (2, 5, 2)])
def test_small_pools(spark, n, k, want):
    rows = collection(spark, np.eye(3)[:2] if n == 2 else rng.normal(size=(5, 3))).orderBy("id").limit(n)
    found = clusters.kmeans(rows, k, starts=2)
    assert found.labels.count() == n
    table = found.clusters.collect()
    assert len(table) == want and all(r.rep_code for r in table)


def test_kmeans_over_several_tasks(spark, monkeypatch):
    """Tasks share the passes; the outcome is that of one task."""
    rows = collection(spark, np.vstack([rng.normal(size=(40, 5)) + 8 * i for i in range(3)]))
    rows = rows.unionByName(rows.limit(1).withColumn("id", F.lit("none")).withColumn(
        "embedding", F.lit(None).cast(rows.schema["embedding"].dataType)))
    one = clusters.kmeans(rows, 3)
    monkeypatch.setattr(clusters, "ROWS_PER_TASK", 10)
    many = clusters.kmeans(rows, 3)
    assert {tuple(r) for r in one.labels.collect()} == {tuple(r) for r in many.labels.collect()}
    assert abs(one.cost - many.cost) < 1e-6 * one.cost and one.labels.count() == 120


def test_coincident_vectors(spark):
    rows = collection(spark, [[1.0, 0.0]] * 6)
    found = clusters.kmeans(rows, 3, starts=2)
    assert found.labels.count() == 6
    assert found.clusters.first().rep_code == "0000"


def test_assign_beyond_the_sent_centers(spark, monkeypatch):
    rows = collection(spark, rng.normal(size=(30, 3)))
    centers = rows.limit(5).select(F.col("id").cast("int").alias("cluster_id"), "embedding")
    near = {r.id: r.cluster_id for r in clusters.assign(rows, centers).collect()}
    monkeypatch.setattr(clusters, "MAX_CENTERS", 2)
    monkeypatch.setattr(search, "MAX_QUERY_BYTES", 1)
    assert {r.id: r.cluster_id for r in clusters.assign(rows, centers).collect()} == near


def test_assign_with_repeated_ids_and_missing_vectors(spark, monkeypatch):
    rows = spark.createDataFrame(
        [("x", "n", [0.0, 1.0]), ("x", "n", [1.0, 0.0]), ("y", "n", None)],
        "id string, stock_name string, embedding array<double>")
    centers = spark.createDataFrame(
        [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [9.0, 9.0])], "cluster_id int, embedding array<double>")

    def found():
        return sorted((r.id, r.cluster_id or 0) for r in clusters.assign(rows, centers).collect())

    want = [("x", 1), ("x", 2), ("y", 0)]
    assert found() == want
    monkeypatch.setattr(clusters, "MAX_CENTERS", 2)
    assert found() == want


@pytest.mark.parametrize("n, k, want", [(0, 5, 1), (2, 5, 1), (5, 1, 1), (6, 5, 2), (100, 5, 5)])
def test_theme_count(n, k, want):
    assert themes.theme_count(n, k) == want


def test_themes_of_a_pool(spark):
    rows = collection(spark, rng.normal(size=(40, 4)))
    words = rows.select(
        F.concat(F.lit("w"), "id").alias("keyword"), F.lit(3).cast("bigint").alias("doc_freq"), "embedding"
    )
    pool = [f"{i:04d}" for i in range(30)] + ["unknown"]
    found = themes.analyze_themes(pool, rows, words, k=3, top=6).collect()
    assert sum(r["size"] for r in found) == 30
    assert [r["size"] for r in found] == sorted((r["size"] for r in found), reverse=True)
    for r in found:
        assert len(r.keywords) == 6 and r.headline == "、".join(k.keyword for k in r.keywords[:5])
        assert r.preview.endswith("...") == (r["size"] > 8)
    one = themes.analyze_themes(pool[:4], rows, words, k=1).collect()
    assert len(one) == 1 and one[0]["size"] == 4
    assert themes.analyze_themes(["unknown"], rows, words).count() == 0


def test_reranking_every_row_passes_on_a_bounded_number_of_rows_a_pair(spark, monkeypatch):
    monkeypatch.setattr(approx, "PASSED_ON", 2000)
    vectors = rng.normal(size=(300, 4))
    vectors[100:110] = vectors[0]
    rows = collection(spark, vectors)
    index = approx.build_index(rows, n_lists=3)
    rank_codes, passed = approx._rank_codes, []

    def counted(*args):
        found = rank_codes(*args)
        passed.append(found.count())
        return found

    monkeypatch.setattr(approx, "_rank_codes", counted)
    pairs = [(f"{i:04d}", v) for i, v in enumerate(vectors)]
    for skip_self in (False, True):
        hits = approx.approx_topk(
            as_queries(rows), index, 5, probes=index.model.lists, rerank=index.size, skip_self=skip_self)
        assert by_query(hits) == brute(pairs, pairs, 5, skip_self)
    # At most the nearest of each query in each of at most three bundles, near ties aside.
    assert passed and max(passed) <= 300 * 16 * 3


def test_kmeans_passes_send_one_sum_a_start_to_the_driver(spark, monkeypatch):
    rows = collection(spark, np.vstack([rng.normal(size=(40, 5)) + 8 * i for i in range(3)]))
    DataFrame = type(rows)
    one = clusters.kmeans(rows, 3, starts=4)
    monkeypatch.setattr(clusters, "ROWS_PER_TASK", 10)
    to_arrow, sent = DataFrame.toArrow, []

    def counted(df):
        table = to_arrow(df)
        if "start" in table.column_names:
            sent.append(table.column("start").to_pylist())
        return table

    monkeypatch.setattr(DataFrame, "toArrow", counted)
    many = clusters.kmeans(rows, 3, starts=4)
    assert sent and all(len(s) == len(set(s)) <= 4 for s in sent)
    assert {tuple(r) for r in one.labels.collect()} == {tuple(r) for r in many.labels.collect()}


def by_blocks(spark, monkeypatch, metric, skip_self=False, moved=False):
    """Hits of a search block by block, and the rows; a third of the vectors are copies, some have no place."""
    vectors = np.random.default_rng(3).normal(size=(300, 6))
    vectors[::3], vectors[1:20:6] = vectors[0], 0.0
    rows = collection(spark, vectors.astype(np.float32) if metric == "l2" else vectors)
    monkeypatch.setattr(search, "QUERY_BLOCK", 40)
    monkeypatch.setattr(search, "ROW_BLOCK", 25)
    if moved:
        monkeypatch.setattr(search, "in_reach", lambda *a: False)
    else:
        # Nothing but hits may be moved: no block of rows is copied for each block of queries.
        monkeypatch.setattr(search, "_compare", None)
    hits = search.topk(as_queries(rows), rows, 7, metric, skip_self=skip_self, query_bytes=1)
    return sorted(tuple(r) for r in hits.collect()), rows


def test_blocks_of_rows_are_read_in_place_l2(spark, monkeypatch):
    got, rows = by_blocks(spark, monkeypatch, "l2")
    assert got == sorted(tuple(r) for r in search.topk(as_queries(rows), rows, 7, "l2").collect())
    assert len(got) == 2100


def test_blocks_of_rows_are_read_in_place_cosine(spark, monkeypatch):
    got, rows = by_blocks(spark, monkeypatch, "cosine")
    assert got == sorted(tuple(r) for r in search.topk(as_queries(rows), rows, 7, "cosine").collect())


def test_blocks_are_shuffled_where_tasks_cannot_open_the_folder(spark, monkeypatch):
    got, rows = by_blocks(spark, monkeypatch, "cosine", moved=True)
    assert got == sorted(tuple(r) for r in search.topk(as_queries(rows), rows, 7, "cosine").collect())


def test_similar_rows_are_read_in_place(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_QUERY_BYTES", 1)
    got, rows = by_blocks(spark, monkeypatch, "l2sq", skip_self=True)
    assert sorted(tuple(r) for r in search.similar_to(rows, rows.select("id"), 7).collect()) == got
    pairs = [(r.id, np.array(r.embedding)) for r in rows.collect()]
    found = {}
    for q, rank, code, *_ in got:
        found.setdefault(q, []).append(code)
    assert found == brute(pairs, pairs, 7, True)


@pytest.mark.parametrize("skip_self", [False, True])
@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_every_row_is_reranked_where_the_index_lies(spark, monkeypatch, metric, skip_self):
    """No code and no vector is moved to the queries; hits are those of exact search."""
    monkeypatch.setattr(approx, "LEAST_BLOCK", 40)
    monkeypatch.setattr(approx, "_rank_moved_codes", None, raising=False)
    vectors = np.random.default_rng(5).normal(size=(300, 4))
    vectors[::3] = vectors[0]
    rows = collection(spark, vectors)
    index = approx.build_index(rows, n_lists=6)
    found = approx.approx_topk(
        as_queries(rows), index, 5, probes=index.model.lists, metric=metric, rerank=index.size, skip_self=skip_self)
    exact = search.topk(as_queries(rows), rows, 5, metric, skip_self=skip_self)
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in exact.collect())
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() or skip_self


def measured_twice(spark, monkeypatch, rows, asked, **more):
    """Hits where the index lies, and with codes moved to the queries."""
    index = approx.build_index(rows)
    here = approx.approx_topk(asked, index, 5, **more).collect()
    monkeypatch.setattr(approx, "in_reach", lambda *a: False)
    moved = approx.approx_topk(asked, index, 5, **more).collect()
    return sorted(tuple(r) for r in here), sorted(tuple(r) for r in moved)


def test_index_is_searched_where_it_lies(spark, monkeypatch):
    """The same hits whether tasks read the index or codes are moved to the queries."""
    monkeypatch.setattr(approx, "LEAST_BLOCK", 40)
    monkeypatch.setattr(approx, "ROWS_AT_ONCE", 20)
    rows = collection(spark, np.random.default_rng(6).normal(size=(400, 6)))
    here, moved = measured_twice(spark, monkeypatch, rows, as_queries(rows), probes=8, rerank=12)
    assert len(here) == 2000 and here == moved


def test_ids_that_come_twice_go_the_former_way(spark, monkeypatch):
    rows = collection(spark, np.random.default_rng(6).normal(size=(60, 6)))
    twice = rows.unionByName(rows)
    for held, asked in ((twice, as_queries(rows)), (rows, as_queries(twice))):
        with monkeypatch.context() as changed:
            changed.setattr(approx, "_rank_codes", None)
            assert approx.approx_topk(asked, approx.build_index(held), 5).count() == 300
