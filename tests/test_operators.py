"""Properties of the operators, and the cases that the sample tables don't hold."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankfold.functions import fuzzy
from rankfold.functions import text as T
from rankfold.functions import vectors as X
from rankfold.functions.numbers import race_key, uniform
from rankfold.operators import features, library, ranking, recommend, search
from rankfold.sources import files as S
from rankfold.sources.sectioned_csv import export_csv, import_csv


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize(("text", "plain"), [("résumé", "resume"), ("hello_world", "hello world"), ("a - b", "a b"), ("", ""), ("Ünï\tcode//x", "uni code x"), (None, None)])
def test_normalize_text(spark, text, plain):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.normalize_text(F.col("t"))).first()[0] == plain


@pytest.mark.parametrize(
    ("value", "bad"),
    [("/etc/passwd", True), ("/ETC/passwd", True), ("/proc/self/environ", True), ("..\\..\\windows\\system32", True), ("%252e%252e/secret", True), ("....flac", False), ("cats", False), ("a/../b", True), ("..", False), ("100%/x", False), ("a+b/c", False)],
)
def test_unsafe(spark, value, bad):
    assert one(spark, T.is_unsafe(F.col("v")), v=value) is bad


@pytest.mark.parametrize(("url", "base", "path"), [("osfs:///mnt/a/../b#c?d", "osfs:///", "/mnt/b#c?d"), ("webdav://h:1/x//y/./z", "webdav://h:1/", "/x/y/z"), ("sftp://h", "sftp://h/", "/"), ("plain/x", "osfs:///", "/plain/x")])
def test_split_url(spark, url, base, path):
    assert one(spark, T.base_url(F.col("u")), u=url) == base
    assert one(spark, T.path_in_fs(F.col("u")), u=url) == path


@pytest.mark.parametrize(("n", "shown"), [(0, "0B"), (1, "1.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1 << 30, "1.0 GB")])
def test_human_size(spark, n, shown):
    assert one(spark, T.human_size(F.col("n").cast("long")), n=n) == shown


@pytest.mark.parametrize(("s", "shown"), [(0.0, "00:00:00"), (3661.0, "01:01:01"), (2.5, "00:00:02"), (3.5, "00:00:04")])
def test_human_length(spark, s, shown):
    assert one(spark, T.human_length(F.col("s")), s=s) == shown


def test_capped_lines(spark):
    text = "".join(f"line {k}\n" for k in range(400)) + "end"
    got = one(spark, T.capped_lines(F.col("t")), t=text)
    assert got == "".join(f"line {k}\n" for k in range(300))
    assert one(spark, T.capped_lines(F.col("t"), 10, 9), t="abcd\nefgh\nx") == "abcd\n"
    assert one(spark, T.capped_lines(F.col("t")), t="") == ""


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert fuzzy.lcs(a, b) == table[-1][-1]
    assert 0 <= fuzzy.weighted_ratio(a, b) <= 100


def test_fuzzy_order(spark):
    assert fuzzy.token_set_ratio("garden cats", "cats in garden") == 100.0
    assert fuzzy.ratio("kitten", "kitten") == 100.0
    paths = ["/media/vacation_photo.jpg", "/media/cat.jpg", "/media/cats_in_garden.jpg"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    scores = {r.path: r.s for r in df.select("path", search.filename_score(F.col("path"), "cat.jpg").alias("s")).collect()}
    assert max(scores, key=scores.get) == "/media/cat.jpg"
    assert all(math.isfinite(s) for s in scores.values())


def test_global_rank_is_a_total_order(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 13).cast("double").alias("score"))
    got = ranking.global_rank(df, [ranking.Down("score"), "id"], partitions=7).toPandas().sort_values("rank")
    want = df.toPandas().sort_values(["score", "id"], ascending=[False, True])
    assert got["rank"].tolist() == list(range(1000))
    assert got["id"].tolist() == want["id"].tolist()


def test_ranks_of_an_empty_frame(spark):
    df = spark.createDataFrame([], "idx long, path string, score double")
    assert ranking.rank_by_score(df).count() == 0
    assert ranking.temperature_shuffle(df, 1.0, 3).count() == 0


def test_least_relevant_is_the_reverse(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, 1.0), (3, None), (4, 2.0)], "idx long, score double")
    order = lambda o: [r.idx for r in ranking.rank_by_score(df, o).orderBy("rank").collect()]
    assert order("most-relevant") == [4, 0, 2]
    assert order("least-relevant") == [2, 0, 4]
    with pytest.raises(ValueError):
        ranking.rank_by_score(df, "odd")


def test_temperature_shuffle(spark):
    df = spark.createDataFrame([(k, f"p{k}", float(k % 5)) for k in range(200)], "idx long, path string, score double")
    a = ranking.temperature_shuffle(df, 1.0, 5).toPandas()
    b = ranking.temperature_shuffle(df.repartition(3), 1.0, 5).toPandas()
    assert sorted(a["rank"]) == list(range(200))
    assert dict(zip(a["idx"], a["rank"], strict=True)) == dict(zip(b["idx"], b["rank"], strict=True))
    zero = ranking.temperature_shuffle(df, 0.0, 5).orderBy("rank").toPandas()
    assert zero["score"].is_monotonic_decreasing


@pytest.mark.parametrize("temperature", [0.5, 1.0, 2.0])
def test_first_draw_frequencies(spark, temperature):
    scores = [1.0, 2.0, 4.0]
    draws = spark.range(20_000).withColumnRenamed("id", "seed").crossJoin(spark.createDataFrame([(k, s) for k, s in enumerate(scores)], "k int, score double"))
    u = (F.shiftrightunsigned(F.xxhash64("k", "seed"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    first = draws.withColumn("key", race_key(F.col("score"), temperature, u)).groupBy("seed").agg(F.max_by("k", "key").alias("k")).groupBy("k").count().toPandas()
    want = np.array(scores) ** (1 / temperature)
    got = first.sort_values("k")["count"].to_numpy() / 20_000
    assert np.abs(got - want / want.sum()).max() < 0.02


def test_uniform(spark):
    u = spark.range(5000).select(uniform(F.col("id"), 1).alias("u")).toPandas()["u"]
    assert u.between(0, 1, inclusive="neither").all() and abs(u.mean() - 0.5) < 0.02


def test_sectioned_csv_round_trip(spark):
    rows = [(1, "h,1", 'say "x"', 2.5), (2, "", "back\\slash", None), (3, "a.b", "é.ü", 0.0)]
    table = spark.createDataFrame(rows, "id long, hash string, file_path string, user_rating double")
    other = spark.createDataFrame([(9, "x")], "n long, v string")
    lines = export_csv({"lib": table, "odd": other}, frozenset({"blob"}))
    texts = [r.line for r in lines.orderBy("section", F.col("key").asc_nulls_first()).collect()]
    numbered = spark.createDataFrame(list(enumerate(texts)), "line_no long, line string")
    back = import_csv(numbered, {"lib": {"id": "long", "hash": "string", "file_path": "string", "user_rating": "double"}})
    assert set(back) == {"lib"}
    assert sorted(tuple(r) for r in back["lib"].collect()) == rows


def test_memory_round_trip(spark, tmp_path):
    rated = spark.createDataFrame([("h1", "osfs:///a.txt", 7.0, "2024-01-02 03:04:05", "some words"), ("h2", "osfs:///b.txt", 3.0, None, None)], "hash string, file_path string, user_rating double, d string, description string").withColumn("user_rating_date", F.col("d").cast("timestamp"))
    records = S.memory_records(rated, "2024-07-01 12:00:00")
    S.write_memory(records, f"{tmp_path}/memory")
    got = {r.file_stem: r for r in S.parse_memory(spark.read.json(f"{tmp_path}/memory").withColumn("day", F.col("day").cast("string"))).collect()}
    assert got["h1"].rating == 7.0 and got["h1"].description.endswith("some words") and got["h1"].day == "2024-01-02"
    assert got["h2"].rating == 3.0 and "not available" in got["h2"].description and got["h2"].day == "2024-07-01"


def test_scan_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.jpg", "b.JPG", "c.txt", "sub/nested.jpg"):
        (tmp_path / name).write_text("x")
    got = S.scan_files(spark, [str(tmp_path), "/no/such/root"], {".jpg"})
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["a.jpg", "b.JPG", "nested.jpg"]
    counts = {r.folder: (r.num_files, r.total_files) for r in library.folder_counts(got.withColumn("path", F.regexp_replace("path", r"^file:/+", "/")), (".jpg",)).collect()}
    top = str(tmp_path).strip("/")
    assert counts[top] == (2, 3) and counts[f"{top}/sub"] == (1, 1)


def test_recommendation_score(spark):
    rows = [(0, "a", 8.0, None, 10, 2, 100), (1, "b", None, 6.0, 5, 1, 50), (2, "c", 9.0, None, 12, 0, 120), (3, "d", None, None, 3, 3, None)]
    df = spark.createDataFrame(rows, "idx long, path string, user_rating double, model_rating double, full_play_count long, skip_count long, t long").withColumn("last_played", F.timestamp_seconds("t"))
    got = {r.idx: r.score for r in recommend.recommendation_score(df).collect()}
    place = {2: 0, 0: 1, 1: 2, 3: 3}
    for i, _, u, m, full, skip, _ in rows:
        rating = u if u is not None else m if m is not None else 8.5
        want = (max(0.1, rating) / 10) ** 2 / (1 + math.exp(-(5 + full - skip) / 5)) * place[i] / 3
        assert got[i] == pytest.approx(want)
    assert recommend.recommendation_score(df.limit(1)).first().score == 0.0
    assert recommend.recommendation_score(df.filter("false")).count() == 0


def test_fingerprint(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.standard_normal(64) for _ in range(5)] + [np.zeros(64), np.full(64, 1e-8)]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "k int, v array<double>")
    got = {r.k: r.f for r in df.select("k", X.fingerprint(F.col("v")).alias("f")).collect()}
    for k, v in enumerate(vectors):
        want = "" if np.linalg.norm(v) < 1e-6 else " ".join(X.SYMBOLS[r * 32 // 64] for r in v.argsort(kind="stable").argsort(kind="stable"))
        assert got[k] == want


def test_nearest_neighbor_blocks_agree_with_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 8))
    v[7] = v[5]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.neighbor, r.distance) for r in search.nearest_neighbor(df, block=64).collect()}
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert [got[k][0] for k in range(300)] == d.argmin(1).tolist()
    assert np.allclose([got[k][1] for k in range(300)], d.min(1))
    near = {r.vec_id: r.neighbor for r in search.nearest_neighbor_lsh(df, width=4.0, tables=8, threshold=5.0).collect()}
    assert np.mean([near.get(k) == got[k][0] for k in range(300)]) > 0.8


def test_lttb_keeps_ends(spark):
    rows = [(s, k, math.sin(k / 9) + (k == 500) * 5) for s in "ab" for k in range(1000)]
    got = search.lttb(spark.createDataFrame(rows, "series string, x long, y double"), 50).toPandas()
    for _, g in got.groupby("series"):
        assert len(g) == 50 and {0, 999, 500} <= set(g["x"])
    short = spark.createDataFrame(rows[:10], "series string, x long, y double")
    assert search.lttb(short, 50).count() == 10


def slow_lttb(x, y, points):
    """The published algorithm over a whole series; places of the chosen points."""
    n = len(x)
    edges = [1 + k * (n - 2) // (points - 2) for k in range(points - 1)]
    chosen = [0]
    for k in range(points - 2):
        lo, hi = edges[k], edges[k + 1]
        nlo, nhi = (hi, edges[k + 2]) if k + 2 < len(edges) else (n - 1, n)
        ax, ay, mx, my = x[chosen[-1]], y[chosen[-1]], x[nlo:nhi].mean(), y[nlo:nhi].mean()
        area = np.abs((ax - mx) * (y[lo:hi] - ay) - (ax - x[lo:hi]) * (my - ay))
        chosen.append(lo + int(area.argmax()))
    return [*chosen, n - 1]


@pytest.mark.parametrize("points", [3, 7, 50])
def test_lttb_equals_the_published_algorithm(spark, points):
    rng = np.random.default_rng(points)
    rows, want = [], set()
    for name, n in (("a", 51), ("b", 333), ("c", 1000), (None, 64)):
        x, y = np.cumsum(rng.integers(1, 5, n)), rng.normal(size=n).cumsum()
        rows += [(name, int(i), float(j)) for i, j in zip(x, y, strict=True)]
        want |= {(name, int(x[k])) for k in slow_lttb(x.astype(float), y, points)}
    df = spark.createDataFrame(rows, "series string, x long, y double").repartition(5)
    assert {(r.series, r.x) for r in search.lttb(df, points).collect()} == want


def test_segments_make_up_the_text(spark):
    text = " ".join(f"w{k}" for k in range(500))
    c = search.text_chunks(spark.createDataFrame([(1, text), (2, "short one"), (3, "")], "k int, t string"), "k", "t", 192, 64).withColumn("score", F.col("chunk_no").cast("double"))
    got = search.segment_scores(c, "k").filter("k = 1").orderBy("start").collect()
    assert "".join(text[r.start : r.end] for r in got) == text
    assert {r.score for r in got if r.part == 1} == {0.5, 1.5, 2.5}
    assert search.text_chunks(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", 100, 100).count() == 5


def test_upsert(spark):
    target = spark.createDataFrame([(1, "h1", "p1", 1.0), (2, "h2", "p2", 2.0), (3, "h3", "p3", 3.0)], "id long, hash string, file_path string, user_rating double")
    new = spark.createDataFrame([(10, "h1", "x", 9.0), (11, "", "p2", 8.0), (12, "", "p9", 7.0), (13, None, None, 6.0)], "idx long, hash string, file_path string, user_rating double")
    got = {r.id: (r.user_rating, r.change) for r in library.upsert_by_hash_or_path(target, new, ["user_rating"]).collect()}
    assert got == {1: (9.0, "updated"), 2: (8.0, "updated"), 3: (3.0, "kept"), 12: (7.0, "inserted"), 13: (6.0, "inserted")}


def test_split_is_exact_and_stable(spark):
    df = spark.range(95).select(F.col("id"), F.lit(1.0).alias("label"))
    a = recommend.train_test_split(df)
    assert Counter(r.split for r in a.collect()) == {"test": 10, "train": 85}
    b = {r.id for r in recommend.train_test_split(df.repartition(5)).filter("split = 'test'").collect()}
    assert b == {r.id for r in a.filter("split = 'test'").collect()}


def test_rater_learns(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(k % 11 == j) + 0.01 * rng.standard_normal() for j in range(11)], float(k % 11)) for k in range(330)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label double")
    rater, log = recommend.train_best_rater(recommend.train_test_split(df), grid=(5, 60))
    assert log.count() == 2
    out = rater.predict(df.withColumn("features", F.when(F.col("id") != 0, F.col("features"))))
    assert out.filter("prediction BETWEEN 0 AND 10").count() == 330
    assert out.filter("id = 0").first().prediction == 0.0
    assert recommend.rating_metrics(out.filter("id > 0"), "prediction", "label").first().mae < 2.0


def test_embed_missing_only_adds(spark):
    e = features.HashingEmbedder(8)
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "k long, t string")
    old = features.embedded(docs.filter("k = 1"), e, "k", "t")
    got = features.embed_missing(docs, old, e, "k", "t").collect()
    assert sorted(r.k for r in got) == [1, 2, 3]
    assert all(len(r.embedding) == 8 for r in got) and sum(next(r for r in got if r.k == 2).embedding) == 0.0


def test_scorers(spark):
    files = spark.createDataFrame([(0, "/a/cat.jpg", 5), (1, "/a/dog.jpg", None)], "idx long, path string, size long")
    s = search.standard_scorers()
    assert {r.score for r in s.score(files, "").collect()} == {0.0}
    assert [r.score for r in s.score(files, "file size").orderBy("idx").collect()] == [5.0, 0.0]
    with pytest.raises(ValueError):
        s.score(files, "cat", mode="nope")


def test_pages_equal_the_whole_ranking(spark, monkeypatch):
    from rankfold.operators import ranking as R

    df = spark.createDataFrame([(k, None if k % 7 == 0 else float(k % 5)) for k in range(200)], "idx long, score double")
    for order in ("most-relevant", "least-relevant"):
        want = {(r["rank"], r.idx) for r in R.page(R.rank_by_score(df, order), 30, 25).collect()}
        assert len(want) == 25
        assert {(r["rank"], r.idx) for r in R.page_by_score(df, 30, 25, order).collect()} == want
        monkeypatch.setattr(R, "DEEP", 10)
        assert {(r["rank"], r.idx) for r in R.page_by_score(df, 30, 25, order).collect()} == want
        monkeypatch.undo()


def test_chunks_of_long_texts(spark):
    from rankfold.operators import search

    texts = [(k, " ".join("w" * (1 + (j * k) % 5) for j in range(n))) for k, n in enumerate([1, 5, 6, 7, 40, 3000])]
    got = {(r.k, r.chunk_no): (r.start, r.end, r.chunk) for r in search.text_chunks(spark.createDataFrame(texts, "k int, t string"), "k", "t", 6, 2).collect()}
    for k, t in texts:
        w = t.split(" ")
        starts = [0] if len(w) <= 6 else list(range(0, 4 * (-(-(len(w) - 6) // 4)) + 1, 4))
        for n, s in enumerate(starts):
            chunk = " ".join(w[s : s + 6])
            at = len(" ".join(w[:s])) + (s > 0)
            assert got.pop((k, n)) == (at, at + len(chunk), chunk)
    assert not got


def test_one_bad_item_spoils_no_other(spark):
    from rankfold.operators import features

    class Picky(features.HashingEmbedder):
        def embed(self, texts):
            if "bad" in texts:
                raise ValueError("bad")
            return super().embed(texts)

    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "k int, t string").coalesce(1)
    got = {r.k: r.embedding for r in features.embedded(rows, Picky(4), "k", "t").collect()}
    assert got[2] == [0.0] * 4 and any(got[1]) and any(got[3])
    done = features.embedded(rows, Picky(4), "k", "t")
    assert features.embed_missing(rows, done, features.HashingEmbedder(4), "k", "t").filter("k = 2 AND forall(embedding, x -> x = 0)").count() == 0


def test_byte_caps(spark):
    from rankfold.functions.text import capped_bytes

    rows = spark.createDataFrame([("aéb",), ("😀😀",), ("",), (None,)], "t string")
    for most in range(0, 9):
        for r in rows.select("t", capped_bytes(F.col("t"), most).alias("c")).collect():
            assert r.c == (None if r.t is None else r.t.encode()[:most].decode(errors="ignore"))


def test_noise_and_pairs(spark):
    from rankfold.operators import features
    from rankfold.operators import recommend as M

    rows = spark.createDataFrame([(k, [0.5] * 4, float(k % 11)) for k in range(100)], "id long, features array<double>, label double")
    out = M.with_noise(M.train_test_split(rows), 4, n=60).toPandas()
    noise = out[out["id"] < 0]
    assert noise.groupby("split")["id"].nunique().to_dict() == {"train": 60, "test": round(10 * 60 / 150)}
    assert noise.groupby("id").size().between(1, 5).all() and (noise["label"] == 0).all()
    records = spark.createDataFrame([("a", 3.0, "a long description of it"), ("b", 4.0, "short"), ("c", 5.0, "x " * 30)], "file_stem string, rating double, description string")
    full = spark.createDataFrame([("b", "full text " * 20)], "file_stem string, text string")
    pairs = lambda **k: {(r.file_stem, r.chunk_no) for r in M.training_pairs(records, features.HashingEmbedder(4), size=10, overlap=0, **k).collect()}
    assert pairs() == {("a", 0), ("c", 0), ("c", 1), ("c", 2), ("c", 3)}
    assert pairs(full=full) == pairs() | {("b", n) for n in range(5)}


def test_only_texts_beyond_ascii_go_to_python(spark):
    df = spark.createDataFrame([("Plain.Text",), ("Café_au-lait",), (None,), ("",)], "t string").select(T.normalize_text(F.col("t")).alias("p"))
    assert [r.p for r in df.collect()] == ["plain text", "cafe au lait", None, ""]
    assert "octet_length" in df._jdf.queryExecution().optimizedPlan().toString()


def test_lsh_recall(spark, sf):
    from rankfold.operators import search
    from rankfold.sources import views

    v = views.vectors(spark, f"{sf}/../sf0.01").filter("vec_id >= 0")
    exact = {r.vec_id: r.neighbor for r in search.nearest_neighbor(v).collect()}
    got = {r.vec_id: r.neighbor for r in search.nearest_neighbor_lsh(v).collect()}
    assert set(got) == set(exact)
    assert sum(got[k] == exact[k] for k in exact) >= 0.9 * len(exact)


def test_equal_and_nearly_equal_vectors(spark):
    from rankfold.operators import search

    rows = [(k, [1.0 + 1e-9 * (k % 3), 1000.0]) for k in range(9)]
    got = {r.vec_id: r.neighbor for r in search.nearest_neighbor(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {k: min(j for j in range(9) if j != k and j % 3 == k % 3) for k in range(9)}
