from datetime import date

import pytest
from pyspark.sql import functions as F

from linkloom import catalog
from linkloom.operators import pageviews, relational, webgraph
from linkloom.sources import adjacency, files


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_adjacency(spark):
    got = adjacency.query_side(lines(spark, "qas\x011\x012\x023\x014\x025", "qas\x019", ""))
    assert rows(got) == [(1, 2, 3), (1, 4, 5)]
    assert rows(adjacency.ad_side(lines(spark, "aqs\x012\x011\x023"))) == [(1, 2, 3)]
    assert rows(adjacency.render_adjacency(got, "qas", "q", "a")) == [("qas\x011\x012\x023\x014\x025",)]
    with pytest.raises(Exception, match="without a click count"):
        adjacency.query_side(lines(spark, "qas\x011\x012")).collect()


def test_dictionaries(spark):
    got = adjacency.parse_dictionary(lines(spark, "qQ\x017\x01k\x03f\x03p", "qQ\x018\x01\x03f\x03", "qQ\x019\x01k\x03f", "qQ\x019"))
    assert rows(got) == [(7, "k", "f", "p"), (8, "", "f", "")]
    assert rows(adjacency.parse_normalised(lines(spark, "nq\x01k\x01raw", "nq\x01k\x01", "nq\x01k"))) == [("k", "raw")]


def test_web_graph(spark):
    got = adjacency.parse_web_graph(lines(spark, "a.com/x -> b.com 2.5", "a.com -> c.com", "lone.com", "a.com -> d.com much", "u -> a b 2.0", "v -> a  3 ", ""))
    assert rows(got) == sorted([("a.com/x", "b.com", 2.5), ("a.com", "c.com", 1.0), ("lone.com", None, 1.0), ("a.com", "d.com much", 1.0), ("u", "a b 2.0", 1.0), ("v", "a", 3.0)], key=str)
    links = spark.createDataFrame([("http://a.com/x", "http://b.com/", 1.0), ("http://a.com/x", "http://b.com/", 3.0), ("http://a.com/x", "http://A.com/y", 2.0), ("lone.com", None, 1.0)], "src string, dst string, weight double")
    assert rows(webgraph.add_links(links)) == [("http://a.com/x", "http://A.com/y", 2.0), ("http://a.com/x", "http://b.com/", 3.0)]
    assert rows(webgraph.without_internal(links).select("dst")) == [("http://b.com/",), ("http://b.com/",)]
    assert webgraph.symmetrised(links).count() == 4 and webgraph.nodes(links).count() == 4
    stop = spark.createDataFrame([("b.com",)], "host string")
    assert rows(webgraph.without_stop_hosts(links, stop)) == [("http://a.com/x", "http://A.com/y", 2.0)]
    assert {r["url"]: (r["n_in"], r["n_out"]) for r in webgraph.degrees(links).collect()}["lone.com"] == (0, 0)
    pairs = spark.createDataFrame([("http://a.com/x", "http://b.com/"), ("z", "y")], "src string, dst string")
    assert rows(webgraph.edge_weights(links, pairs)) == [("http://a.com/x", "http://b.com/", 3.0), ("z", "y", 0.0)]
    assert webgraph.out_links(links, "http://a.com/x").count() == 3 and webgraph.in_links(links, "http://b.com/").count() == 2
    assert rows(webgraph.host_graph(links)) == [("a.com", "b.com", 4.0)]


def test_joins(spark):
    a, b, c = (spark.createDataFrame(x, "key int, value string") for x in ([(1, "a1"), (2, "a2")], [(2, "b2"), (3, None)], [(2, "c2"), (4, "c4")]))
    assert rows(relational.join_many([a, b, c], "key")) == [(2, "a2", "b2", "c2")]
    assert rows(relational.join_many([a, b, c], "key", "outer")) == [(1, "a1", None, None), (2, "a2", "b2", "c2"), (3, None, None, None), (4, None, None, "c4")]
    assert rows(relational.join_many([a, b, c], "key", "override")) == [(1, "a1"), (2, "c2"), (3, None), (4, "c4")]
    assert rows(relational.join_many([a], "key")) == rows(a)
    for bad in (([], "inner"), ([a], "left")):
        with pytest.raises(ValueError):
            relational.join_many(bad[0], "key", bad[1])


def test_sorts(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert [r["k"] for r in relational.sort_total(df, "k", partitions=5).collect()] == list(range(1000))
    assert [r["k"] for r in relational.sort_total(df, "k").collect()] == list(range(1000))
    assert rows(relational.with_ordinal(df, "k").filter("ordinal <> k + 1")) == []
    parts = relational.sort_partitions(df, "k", partitions=3).withColumn("p", F.spark_partition_id()).collect()
    assert all(x["k"] < y["k"] for x, y in zip(parts, parts[1:]) if x["p"] == y["p"]) and len({r["p"] for r in parts}) == 3


def test_row_counts(spark):
    frames = {"a": spark.range(5), "b": spark.range(1)}
    assert rows(relational.row_counts(frames, {"a": 3, "b": 2})) == [("a", 5, 3, True), ("b", 1, 2, False)]
    relational.require_rows(frames, {"a": 5})
    with pytest.raises(ValueError, match="b has 1 of 2"):
        relational.require_rows(frames, {"b": 2})


def test_page_views(spark, tmp_path):
    views = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "k string, b int")
    got = pageviews.roll_up(views, ["k", "b"], {"k": ["k"], "kb": ["k", "b"], "all": []})
    assert rows(got) == sorted([("k", "x", None, 2), ("k", "y", None, 1), ("kb", "x", 1, 1), ("kb", "x", 2, 1), ("kb", "y", 1, 1), ("all", None, None, 3)], key=str)
    assert rows(pageviews.allowed(views, [2], "b")) == [("x", 2)]
    assert rows(pageviews.allowed(views, spark.createDataFrame([(2,)], "z int"), "b")) == [("x", 2)]
    path, last = f"file://{tmp_path}/days", date(2024, 1, 5)

    def make(day):
        if day == date(2024, 1, 4):
            raise RuntimeError("no input")
        return spark.createDataFrame([(day, "x", 2)], "day date, k string, pv bigint")

    assert [d for d, _ in pageviews.build_days(spark, path, last, 3, make)] == [date(2024, 1, 4)]
    assert pageviews.missing_days(spark, path, last, 3) == [last, date(2024, 1, 4)]
    daily = spark.read.parquet(path)
    assert rows(pageviews.accumulate(daily, ["k"], last, 3, min_pv=4)) == [("x", 4)]
    assert rows(pageviews.accumulate(daily, ["k"], last, 3, min_pv=5)) == []
    assert pageviews.delete_expired(spark, path, last, 2) == [date(2024, 1, 3)]
    assert spark.read.parquet(path).count() == 1


def test_files(spark, tmp_path):
    where = f"file://{tmp_path}"
    files.write_text(spark.createDataFrame([("a",), ("b",)], "value string"), f"{where}/t")
    assert rows(files.scan_text(spark, f"{where}/t", split_bytes=1)) == [("a",), ("b",)]
    many = files.scan_text(spark, f"{where}/t", split_bytes=1).filter("value > ''")
    assert many.rdd.getNumPartitions() > files.scan_text(spark, f"{where}/t").filter("value > ''").rdd.getNumPartitions()
    files.write_named({"one": spark.range(3), "two": spark.range(2)}, f"{where}/n")
    assert files.scan_columns(spark, "id long", f"{where}/n/o*").count() == 3
    assert rows(files.scan_tagged(spark, "id long", {"x": f"{where}/n/two"})) == [(0, "x"), (1, "x")]
    files.write_single(spark.createDataFrame([("a",), ("b",)], "value string"), f"{where}/s")
    assert len(list((tmp_path / "s").glob("part-*"))) == 1
    files.write_text(spark.createDataFrame([("c",)], "value string"), f"{where}/t")
    assert rows(spark.read.text(f"{where}/t")) == [("c",)]


def test_stream(spark, tmp_path):
    from linkloom.streaming import pageviews as stream

    spark.sql("select timestamp'2024-01-01 01:00:00' ts, 'a' k union all select timestamp'2024-01-01 02:00:00', 'a' union all select timestamp'2024-01-09', 'b'").coalesce(1).write.parquet(f"{tmp_path}/in")
    events = stream.read_events(spark, f"file://{tmp_path}/in", "ts timestamp, k string")
    stream.write_daily(stream.daily_views(events, ["k"]), f"file://{tmp_path}/out", f"file://{tmp_path}/c").awaitTermination()
    assert [(r["k"], r["pv"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a", 2)]


def test_registered_joins_take_whole_tables(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    a = {r["c_custkey"]: r["c_acctbal"] for r in read("customer").collect()}
    b = {}
    for r in read("orders").collect():
        b[r["o_custkey"]] = max(r["o_totalprice"], b.get(r["o_custkey"], r["o_totalprice"]))
    c = {r["s_suppkey"]: r["s_acctbal"] for r in read("supplier").collect()}
    got = {name: rows(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")) for name in ("join_inner", "join_outer", "join_override")}
    keys = set(a) | set(b) | set(c)
    assert any(k % 2 for k in a)
    assert got["join_inner"] == sorted([(k, a[k], b[k], c[k]) for k in set(a) & set(b) & set(c)], key=str)
    assert got["join_outer"] == sorted([(k, a.get(k), b.get(k), c.get(k)) for k in keys], key=str)
    assert got["join_override"] == sorted([(k, c.get(k, b.get(k, a.get(k)))) for k in keys], key=str)


def test_joins_of_unmatched_keys(spark):
    inputs = [spark.createDataFrame(x, "key long, value double") for x in ([(1, 1.0), (2, 2.0)], [(2, 3.0), (3, 4.0)], [(2, 5.0), (4, 6.0)])]
    assert rows(relational.join_many(inputs, "key")) == [(2, 2.0, 3.0, 5.0)]
    assert rows(relational.join_many(inputs, "key", "outer")) == sorted([(1, 1.0, None, None), (2, 2.0, 3.0, 5.0), (3, None, 4.0, None), (4, None, None, 6.0)], key=str)
    assert rows(relational.join_many(inputs, "key", "override")) == [(1, 1.0), (2, 5.0), (3, 4.0), (4, 6.0)]


def test_command_line(spark, tmp_path):
    from linkloom import cli

    where = f"file://{tmp_path}"
    assert cli.main(["max_ids", "/root/testdata/sf0.001", f"{where}/max", "--format", "json", "spark.x=1"]) == 0
    assert spark.read.json(f"{where}/max").count() == 1
    assert cli.main(["row_count_monitor", "/root/testdata/sf0.001", f"{where}/rows", "--from", "__spark_entry__"]) == 0
    edges = spark.createDataFrame([(0, 0, 4), (0, 1, 2), (1, 0, 1), (2, 0, 3), (2, 1, 3)], "q int, a int, clicks bigint")
    files.write_text(adjacency.render_adjacency(edges, "qas", "q", "a"), f"{where}/lines")
    assert cli.main(["similar", f"{where}/lines", f"{where}/scores", "--param", "iterations=2", "--param", "in_place=true", "--param", "threshold=0.002"]) == 0
    assert spark.read.parquet(f"{where}/scores").columns == ["i", "j", "v"] and spark.read.parquet(f"{where}/scores").count() > 0
    for bad in (["none", "x", "y"], ["similar", "x", "y", "--param", "decay=2"], ["similar", "x", "y", "--param", "z=2"], ["similar", "x", "y", "--param", "in_place=maybe"], ["max_ids", "x", "y", "nosetting"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from linkloom import storage

    def session(master, **conf):
        return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master), conf=SimpleNamespace(get=lambda k, d=None: d))

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(session(master))
        assert storage.shared_dir(session(master, **{"spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
    kept, gone = storage.stage(spark.range(3), "kept", f"file://{tmp_path}/kept"), storage.stage(spark.range(4), "gone")
    assert kept.count() == 3 and gone.count() == 4 and (tmp_path / "kept").exists()
    storage.unstage(gone, spark.range(1))
    with pytest.raises(Exception):
        spark.read.parquet(gone._staged_path)
