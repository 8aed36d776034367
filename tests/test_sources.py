"""Text scans, stored results, splits and profiles on hand-sized inputs."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import vectors as vec
from cairn.operators import profile, subsets
from cairn.sources import tables, text


def write(path, body):
    path.write_text(body)
    return str(path)


def test_features_in_one_file(spark, tmp_path):
    p = write(tmp_path / "f.csv", "feature,mfcc,mfcc\nstatistics,mean,std\nnumber,01,02\ntrack_id,,\n2,1.5,x\n3,-2e3,\n")
    df = text.read_features(spark, p)
    assert df.columns == ["track_id", "mfcc-mean-01", "mfcc-std-02"]
    assert [tuple(r) for r in df.orderBy("track_id").collect()] == [("2", 1.5, None), ("3", -2000.0, None)]


def test_tracks_with_line_breaks_quotes_and_empty_header_cells(spark, tmp_path):
    p = write(tmp_path / "t.csv", ',set,track\n,subset,\ntrack_id,,\n2,small,"a\n""b"", c"\n3,large,[1]\n')
    df = text.read_tracks(spark, p)
    assert df.columns == ["track_id", "set-subset", "track-None"]
    assert [tuple(r) for r in df.orderBy("track_id").collect()] == [("2", "small", 'a\n"b", c'), ("3", "large", "[1]")]


def test_ratings_and_header_scans(spark, tmp_path):
    p = write(tmp_path / "u.data", "1\t2\t3\t881250949\n4\t5\t1\t881250950\n")
    assert sorted(map(tuple, text.read_ratings(spark, p).collect())) == [(1, 2, 3), (4, 5, 1)]
    p = write(tmp_path / "g.csv", "genre_id,parent,title\n1,0,Rock\n")
    assert text.read_header_csv(spark, p, "genre_id string, parent string, title string").first().title == "Rock"


def test_materialize_once_and_result_sink(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "once")
    assert tables.materialize_once(spark, path, build).count() == tables.materialize_once(spark, path, build).count() == 3
    assert len(calls) == 1
    out = str(tmp_path / "out")
    for std, rows in ((2.0, 4), (1.5, 2), (2.0, 3)):
        tables.write_result(spark.range(rows), out, {"clusters": 9, "deviations": std})
    back = spark.read.parquet(out).groupBy("clusters", "deviations").count().collect()
    assert {(r.clusters, r.deviations): r["count"] for r in back} == {(9, 2.0): 3, (9, 1.5): 2}


def test_subsets_and_chunks_share_nothing(spark):
    df = spark.range(1000).select(F.col("id").alias("point_id"))
    n = subsets.chunk_count(1000, 4, 32 * 300)
    assert n == 4
    chunks = subsets.assign_chunks(df, n).groupBy("chunk").count().collect()
    assert len(chunks) == 4 and sum(r["count"] for r in chunks) == 1000
    train, test = subsets.hash_split(df, F.col("point_id") % 10)
    assert (train.count(), test.count()) == (900, 100) and train.join(test, "point_id").isEmpty()
    assert sum(d.count() for d in subsets.random_split(df, [9.0, 1.0], 1)) == 1000
    tracks = spark.createDataFrame([("1", "small"), ("1", "small"), ("2", "large")], "track_id string, `set-subset` string")
    feats = spark.createDataFrame([("1",), ("2",), ("3",)], "track_id string")
    assert [r.track_id for r in subsets.in_subset(feats, tracks, "small").collect()] == ["1"]
    assert sorted(r.track_id for r in subsets.not_in_subset(feats, tracks, "small").collect()) == ["2", "3"]


def test_profile_ties_bad_json_and_empty_clusters(spark):
    genres = spark.createDataFrame(
        [("10", "0", "Rock"), ("2", "0", "Jazz"), ("3", "0", "Folk"), ("4", "0", "Pop"), ("5", "2", "Bop"), ("6", "x", "Odd")],
        "genre_id string, parent string, title string")
    assert [r.title for r in profile.sorted_root_genres(genres).collect()] == ["Jazz", "Folk", "Pop", "Rock"]
    tracks = spark.createDataFrame(
        [("1", "[10, 2]"), ("2", "[10, 5]"), ("3", "[3, 4]"), ("4", None), ("5", "no list"), ("6", "[2]")],
        "track_id string, `track-genres_all` string")
    member = spark.createDataFrame([("1", 0), ("2", 0), ("3", 0)], "track_id string, cluster_id int")
    counts = profile.genre_counts(tracks, genres, member)
    got = {(r.cluster_id, r.genre_title): r["count"] for r in counts.collect()}
    assert got == {(0, "Rock"): 2, (0, "Jazz"): 1, (0, "Folk"): 1, (0, "Pop"): 1, (None, "Jazz"): 1}
    top = {r.genre_title: r.portion for r in profile.top_genre_portions(counts).filter("cluster_id = 0").collect()}
    assert top == {"Rock": 0.5, "Folk": 0.25, "Jazz": 0.25}  # Pop loses the tie by name
    m = {r.genre_title: r.asDict() for r in profile.genre_matrix(counts, genres, [0, 1]).collect()}
    assert m["Pop"] == {"genre_title": "Pop", "none": 0, "0": 1, "1": 0} and m["Jazz"]["none"] == 1
    maps = {r.cluster_id: r.genre_counts for r in profile.genre_count_map(counts).collect()}
    assert maps[None] == {"Jazz": 1} and maps[0]["Rock"] == 2
    assert profile.null_portion(tracks, "track-genres_all").first().portion == pytest.approx(1 / 6)


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], 5)], "a array<double>, b array<double>, i int")
    r = df.select(vec.norm("a").alias("n"), vec.distance("a", "b").alias("d"), vec.dot("a", "a").alias("q"),
                  vec.item_at("a", "i").alias("none"), vec.centre("a", F.lit(3.5)).alias("c"),
                  vec.centred_cosine("a", F.lit(3.5), "b", F.lit(0.0)).alias("s")).first()
    assert tuple(r) == (5.0, 5.0, 25.0, None, [-0.5, 0.5], None)
