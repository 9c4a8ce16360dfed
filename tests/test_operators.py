"""Plans, expressions and streams."""

from __future__ import annotations

from helpers import plan
from pyspark.sql import functions as F

from tempograph import model as M
from tempograph.functions import text as X
from tempograph.functions import viz as V
from tempograph.operators import enrich, ordered, vector
from tempograph.plans import adapters as A
from tempograph.streaming import ingest


def value(spark, c):
    return spark.range(1).select(c).first()[0]


def test_expressions(spark):
    cases = [
        (X.callee_name(F.lit("a.b(x).c")), "b"), (X.callee_name(F.lit("foo(x).bar")), "foo"), (X.first_segment(F.lit(".x")), ""), (X.stripped(F.lit(" \t a b \n")), "a b"),
        (X.lines(F.lit("a\r\nb\x0cc\n")), ["a", "b", "c"]), (X.lines(F.lit("a\n\nb")), ["a", "", "b"]), (X.first_full(F.lit(""), F.lit(None).cast("string"), F.lit("z")), "z"),
        (X.ellipsis(F.lit("abcd"), 3), "abc…"), (X.ellipsis(F.lit("abc"), 3), "abc"), (X.html_escaped(F.lit('<a&"b">')), "&lt;a&amp;&quot;b&quot;&gt;"), (X.html_escaped(F.lit(None)), ""),
        (X.function_name(F.lit("  async def é_x(a):")), "é_x"), (X.function_name(F.lit("x = 1")), None), (X.docstring_line(F.lit('def f():\n  """ A.\n B"""')), "A."), (X.docstring_line(F.lit("x")), ""),
        (X.distinct_sorted(F.array(*map(F.lit, ["b", "", "a", "b"]))), ["a", "b"]), (M.safe_path(F.lit("a/b.py.x\\c.py")), "a_b.x_c"), (M.code_hash(F.lit("")), "da39a3ee5e6b"),
        (V.kind_color(F.lit("Commit")), "#e3b341"), (V.kind_color(F.lit("FileIdentity")), "#484f58"), (V.radius(F.lit("x")), 6), (V.stroke_width(F.lit(0.0)), 1.0), (V.stroke_width(F.lit(0.1)), 0.5),
        (enrich.rationale(F.lit("one\n two \n\nthree"), F.array().cast("array<string>")), "Commit: one\nAuthor notes: two three"),
    ]
    got = spark.range(1).select(*[made.alias(f"c{i}") for i, (made, _) in enumerate(cases)]).first()
    for i, (_, want) in enumerate(cases):
        assert (list(got[i]) if isinstance(want, list) else got[i]) == want, i


def test_conventional_commit(spark):
    assert tuple(value(spark, X.conventional_commit(F.lit("Feat(core)!: go")))) == ("feat", "(core)", True, "go")
    assert value(spark, X.conventional_commit(F.lit("hello"))) is None


def test_iso_strings_and_instants_differ():
    assert "2026-06-24T23:30:00-05:00" < "2026-06-25T00:00:00+00:00"


def test_top_k_is_merged_from_each_task(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert "TakeOrderedAndProject" in plan(vector.knn(e, [0.1] * 64, 5, "embedding", "vec_id"))


def test_latest_is_cut_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(ordered.latest_per_key(A.ordered_states(spark, sf_dir), ["part"], [F.desc("at")]))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    p = plan(A.calls(spark, sf_dir, 30))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,30.0)" in p and "l_comment" not in p and "l_shipdate" not in p


def test_following_crosses_buckets(spark):
    df = spark.createDataFrame([(i, i) for i in (1, 2, 13, 45, 46)], "id long, at long")
    got = ordered.following(df, "id", ["at"], F.floor(F.col("at") / 10)).orderBy("id").collect()
    assert [r.next_id for r in got] == [2, 13, 45, 46, None]


def test_asof_last_with_and_without_buckets(spark):
    defs = spark.createDataFrame([("a", 5, "x"), ("a", 25, "y"), ("b", 7, "z")], "k string, at long, v string").withColumn("bucket", F.floor(F.col("at") / 10))
    uses = spark.createDataFrame([("a", 4, 1), ("a", 5, 2), ("a", 24, 3), ("a", 99, 4), ("c", 9, 5)], "k string, at long, id int").withColumn("bucket", F.floor(F.col("at") / 10))
    for bucket in (None, "bucket"):
        got = {r.id: r.v for r in ordered.asof_last(defs, uses, "k", "at", "v", bucket).collect()}
        assert got == {1: None, 2: "x", 3: "x", 4: "y", 5: None}


def test_version_stream(spark, tmp_path):
    schema = "function_id string, state_id string, commit_seq long, file_seq long, seq long"
    for k, rows in enumerate([[("f", "s1", 0, 0, 1), ("g", "t1", 0, 0, 2)], [("f", "s2", 1, 0, 1), ("f", "s3", 2, 0, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = ingest.version_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.state_id, r.previous, r.version) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("s1", None, 1), ("t1", None, 1), ("s2", "s1", 2), ("s3", "s2", 3)}


def test_graph_table_is_idempotent(spark, tmp_path):
    import corpus

    t = ingest.GraphTable(str(tmp_path / "g"))
    first, both = (spark.createDataFrame(log, M.COMMITS_RAW) for log in (corpus.ONE, corpus.TWO))
    t.append(first, 0)
    t.append(both, 1)
    t.append(both, 1)
    assert t.log(spark).count() == 6
    counts = ingest.status_counts(t.graph(spark).nodes[M.STATE]).first()
    assert (counts.active, counts.superseded) == (10, 10)
