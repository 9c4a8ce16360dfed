"""Registered queries: the graph operators over the driver's tables, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions import text as X
from ..functions import viz as V
from ..functions.patch import patched
from ..operators import enrich, export, fold, keyed, traverse, vector
from ..operators import ordered
from ..operators.ordered import asof_last, first_per_key, following, latest_per_key
from ..sources import graphstore
from ..streaming import ingest
from ..sources.gitlog import SKIPPED, base_name, python_files
from ..workers import importable
from . import adapters as A
from . import history

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ANCHOR, QUANTITY, CUTOFF = 10, 30, "1997-06-01T00:00:00"
#: common table expressions of the SQL side
LI = f"li AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_quantity >= {QUANTITY})"
CALLS = "calls AS (SELECT DISTINCT a.l_partkey AS f, b.l_partkey AS t FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"
STATES = "st AS (SELECT DISTINCT l_partkey AS part, l_orderkey AS ord FROM lineitem)"
ORDERED = STATES + ", os AS (SELECT part, ord, o_orderdate AS dt FROM st JOIN orders ON ord = o_orderkey)"
ISO = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def part(k: int) -> str:
    return f"SELECT {k} AS node_id"


# ---- traversals ---------------------------------------------------------------------------------------------------


def reach_sql(depth: int) -> str:
    return f"""
    WITH RECURSIVE {LI}, {CALLS}, r AS (
        SELECT CAST({ANCHOR} AS BIGINT) AS n, 0 AS hop UNION SELECT c.f, r.hop + 1 FROM r JOIN calls c ON c.t = r.n WHERE r.hop < {depth})
    SELECT n AS node_id, CAST(min(hop) AS INTEGER) AS hop FROM r WHERE hop > 0 AND n <> {ANCHOR} GROUP BY n"""


def reached(spark: SparkSession, sf_dir: str, depth: int, strategy: str) -> DataFrame:
    return traverse.reach(A.calls(spark, sf_dir, QUANTITY), spark.sql(part(ANCHOR)), depth, strategy=strategy)


@query(reach_sql(2))
def blast_radius(spark, d):
    return reached(spark, d, 2, "frontier")


@query(reach_sql(4))
def blast_radius_frontier(spark, d):
    return reached(spark, d, 4, "frontier")


@query(reach_sql(2))
def blast_radius_recursive(spark, d):
    return reached(spark, d, 2, "cte")


@query(reach_sql(3))
def blast_radius_unrolled(spark, d):
    return reached(spark, d, 3, "unrolled")


WALKS = f"""
    w1 AS (SELECT f AS n FROM calls WHERE t = {ANCHOR}), w2 AS (SELECT c.f AS n FROM w1 JOIN calls c ON c.t = w1.n), w3 AS (SELECT c.f AS n FROM w2 JOIN calls c ON c.t = w2.n),
    w AS (SELECT n, 1 AS hop FROM w1 UNION ALL SELECT n, 2 FROM w2 UNION ALL SELECT n, 3 FROM w3)"""


def walked(spark, d) -> DataFrame:
    steps = A.calls(spark, d, QUANTITY).select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    return traverse.walks(steps, spark.sql(part(ANCHOR)), 3)


@query(f"WITH {LI}, {CALLS}, {WALKS} SELECT n AS node_id, count(*) AS walks FROM w GROUP BY n")
def hop_walk_multiset(spark, d):
    return walked(spark, d).groupBy("node_id").agg(F.count("*").alias("walks"))


@query(f"WITH {LI}, {CALLS}, {WALKS} SELECT CAST(hop AS INTEGER) AS hop, count(*) AS callers, count(DISTINCT n) AS distinct_callers FROM w GROUP BY hop")
def callers_per_hop(spark, d):
    return walked(spark, d).groupBy(F.col("hop").cast("int").alias("hop")).agg(F.count("*").alias("callers"), F.count_distinct("node_id").alias("distinct_callers"))


@query(f"WITH {LI}, {CALLS} SELECT f AS node_id, t AS next_id FROM calls JOIN part ON p_partkey = f")
def out_hop(spark, d):
    return traverse.out(A.functions(spark, d).select("node_id"), A.calls(spark, d, QUANTITY))


@query(f"WITH {LI}, {CALLS} SELECT t AS node_id, f AS next_id FROM calls JOIN part ON p_partkey = t")
def in_hop(spark, d):
    return traverse.in_(A.functions(spark, d).select("node_id"), A.calls(spark, d, QUANTITY))


def string_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    return A.functions(spark, d).withColumn("node_id", F.col("node_id").cast("string")), A.edges(spark, d, QUANTITY)


@query(f"""
    WITH {LI}, {CALLS}, s AS (SELECT c.f AS b, p.p_name AS b_name FROM calls c JOIN part p ON p.p_partkey = c.f WHERE c.t = {ANCHOR}),
    t AS (SELECT s.b, p.p_name AS c_name FROM s JOIN calls c ON c.t = s.b JOIN part p ON p.p_partkey = c.f)
    SELECT CAST(s.b AS VARCHAR) AS caller, a.p_name || ' <- ' || b_name || coalesce((SELECT string_agg(' <- ' || c_name, '' ORDER BY c_name) FROM t WHERE t.b = s.b), '') AS chain
    FROM s, part a WHERE a.p_partkey = {ANCHOR}""")  # fmt: skip
def call_chains(spark, d):
    return traverse.call_chains(*string_graph(spark, d), str(ANCHOR))


@query(f"""
    WITH {LI}, {CALLS}, {ORDERED}, h AS (SELECT part, ord, row_number() OVER (PARTITION BY part ORDER BY dt DESC, ord DESC) AS k FROM os)
    SELECT CAST(c.f AS VARCHAR) AS caller, p.p_name AS name, CASE WHEN h.ord IS NULL THEN '' ELSE 'state ' || h.ord END AS ai_summary
    FROM calls c JOIN part p ON p.p_partkey = c.f LEFT JOIN h ON h.part = c.f AND h.k = 1 WHERE c.t = {ANCHOR}""")  # fmt: skip
def callers_with_summary(spark, d):
    f, e = string_graph(spark, d)
    heads = latest_per_key(A.ordered_states(spark, d), ["part"], [F.desc("at"), F.desc("commit")])
    states = heads.select(A.state_key().alias("node_id"), F.concat(F.lit("state "), F.col("commit")).alias("ai_summary"), F.lit("active").alias("status"))
    return traverse.callers_with_summary(f, e, states, str(ANCHOR))


TARGET = "small ring"
def trace_sql(more: str = "") -> str:
    return f"""
    WITH {LI}, {CALLS}, {STATES} SELECT CAST(o_orderkey AS VARCHAR) AS node_id, 'hash' || o_orderkey AS hash, {ISO} AS "timestamp", o_orderpriority AS msg {more}
    FROM part p JOIN calls c ON c.t = p.p_partkey JOIN st ON st.part = c.f JOIN orders ON o_orderkey = st.ord JOIN part q ON q.p_partkey = c.f
    WHERE p.p_name = '{TARGET}' AND {ISO} < '{CUTOFF}'"""


def traced(spark, d, **options) -> DataFrame:
    f, e = string_graph(spark, d)
    return traverse.temporal_trace(f, e, A.commits(spark, d).withColumn("node_id", F.col("node_id").cast("string")), TARGET, CUTOFF, **options)


@query(trace_sql())
def temporal_trace(spark, d):
    return traced(spark, d)


@query(trace_sql().replace("SELECT CAST(o_orderkey", "SELECT DISTINCT CAST(o_orderkey"))
def temporal_trace_distinct(spark, d):
    return traced(spark, d, distinct=True)


@query(trace_sql().replace(f"{ISO} < '{CUTOFF}'", f"o_orderdate < TIMESTAMP '{CUTOFF}'"))
def temporal_trace_instant(spark, d):
    return traced(spark, d, instant=True)


@query(trace_sql(", q.p_name AS caller, CAST(c.f AS VARCHAR) AS caller_node_id, 'state_' || c.f || '_' || st.ord AS state_id, 'hash' || o_orderkey AS commit_hash"))
def temporal_trace_detailed(spark, d):
    return traced(spark, d, detailed=True)


# ---- versions ----------------------------------------------------------------------------------------------------


@query(f"""WITH {ORDERED} SELECT part, ord AS commit, lag(ord) OVER w AS previous, lead(ord) OVER w AS next, row_number() OVER w AS version
    FROM os WINDOW w AS (PARTITION BY part ORDER BY dt, ord)""")  # fmt: skip
def version_chain(spark, d):
    return ordered.chained(A.ordered_states(spark, d), ["part"], ["at", "commit"], "commit").select("part", "commit", "previous", "next", "version")


@query("SELECT o_orderkey AS node_id, lead(o_orderkey) OVER (ORDER BY o_orderdate, o_orderkey) AS next_id FROM orders")
def next_commit(spark, d):
    c = A.commits(spark, d).select("node_id", "o_orderdate")
    return following(c, "node_id", ["o_orderdate", "node_id"], F.date_trunc("month", "o_orderdate")).select("node_id", "next_id")


HEADS = f"WITH {ORDERED}, h AS (SELECT part, ord, row_number() OVER (PARTITION BY part ORDER BY dt DESC, ord DESC) = 1 AS head FROM os)"


@query(HEADS + " SELECT part, ord AS commit, CASE WHEN head THEN 'active' ELSE 'superseded' END AS status FROM h")
def head_status(spark, d):
    return ordered.with_status(A.ordered_states(spark, d), ["part"], ["at", "commit"], "commit", M.ACTIVE, M.SUPERSEDED).select("part", "commit", "status")


@query(HEADS + " SELECT CASE WHEN head THEN 'active' ELSE 'superseded' END AS status, count(*) AS states FROM h GROUP BY 1")
def status_counts(spark, d):
    n = ingest.status_counts(A.touched(spark, d).withColumnRenamed("part", "function_id"))
    return n.select(F.expr("stack(2, 'active', active, 'superseded', superseded) AS (status, states)")).where("states > 0")


@query(HEADS + " SELECT part, ord AS commit FROM h WHERE head")
def latest_state(spark, d):
    return ordered.last_value(A.ordered_states(spark, d), ["part"], ["at", "commit"], "commit")


DIFF_SQL = f"""
    WITH {ORDERED}, h AS (SELECT part, ord, lag(ord) OVER (PARTITION BY part ORDER BY dt, ord) AS prev FROM os)
    SELECT 'state_' || part || '_' || ord AS node_id, CAST(ord AS VARCHAR) AS current_commit, CAST(prev AS VARCHAR) AS previous_commit,
        CASE WHEN prev IS NULL THEN NULL ELSE 'state_' || part || '_' || prev END AS previous_node_id FROM h"""


@query(DIFF_SQL)
def time_travel_diff(spark, d):
    return diffs(A.ordered_states(spark, d))


def diffs(s: DataFrame) -> DataFrame:
    s = ordered.chained(s.withColumn("node_id", A.state_key()), ["part"], ["at", "commit"], "node_id")
    edges = s.where("previous IS NOT NULL").select(F.col("node_id").alias("from_id"), F.lit(M.PREVIOUS_VERSION).alias("label"), F.col("previous").alias("to_id"))
    states = s.select("node_id", F.col("commit").cast("string").alias("commit"))
    out = traverse.version_diff(states, edges, ["node_id", "commit"])
    return out.select("node_id", F.col("current.commit").alias("current_commit"), F.col("previous.commit").alias("previous_commit"), F.col("previous.node_id").alias("previous_node_id"))


@query("""SELECT conv_id, turn, role, substring(sha1(text), 1, 12) AS code_hash,
    coalesce(substring(sha1(text), 1, 12) <> lag(substring(sha1(text), 1, 12)) OVER (PARTITION BY conv_id, role ORDER BY turn), false) AS changed FROM conversations""")  # fmt: skip
def code_changed_versions(spark, d):
    c = A.table(spark, d, "conversations").withColumn("code_hash", M.code_hash("text"))
    return ordered.with_change(c, ["conv_id", "role"], ["turn"], "code_hash").select("conv_id", "turn", "role", "code_hash", "changed")


@query("SELECT doc_id, substring(sha1(text), 1, 12) AS code_hash FROM documents")
def code_hash(spark, d):
    return A.table(spark, d, "documents").select("doc_id", M.code_hash("text").alias("code_hash"))


@query("SELECT substring(sha1(text), 1, 12) AS code_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    return A.table(spark, d, "documents").groupBy(M.code_hash("text").alias("code_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


# ---- the replay's minima, joins and windows ----------------------------------------------------------------------


@query("SELECT p_name AS node_id, arg_min(p_brand, p_partkey) AS file, min(p_partkey) AS ord FROM part GROUP BY p_name")
def node_first_wins(spark, d):
    p = A.table(spark, d, "part").select(F.col("p_name").alias("node_id"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("ord"))
    return first_per_key(p, ["node_id"])


@query("""SELECT l_suppkey AS from_id, l_returnflag AS label, l_partkey AS to_id, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS line, min(l_orderkey) AS first_order
    FROM lineitem GROUP BY 1, 2, 3""")  # fmt: skip
def edge_dedup(spark, d):
    li = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("from_id"), F.col("l_returnflag").alias("label"), F.col("l_partkey").alias("to_id"), F.struct("l_orderkey", "l_linenumber").alias("ord"))
    return first_per_key(li, ["from_id", "label", "to_id"]).select("from_id", "label", "to_id", F.col("ord.l_linenumber").alias("line"), F.col("ord.l_orderkey").alias("first_order"))


@query("""SELECT l_orderkey AS from_id, l_partkey AS to_id, count(*) AS edges FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate <= l_shipdate) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY 1, 2""")  # fmt: skip
def edge_resolution(spark, d):
    li, o, p = (A.table(spark, d, t) for t in ("lineitem", "orders", "part"))
    li = li.select(F.col("l_orderkey").alias("from_id"), F.lit("order").alias("from_kind"), F.col("l_partkey").alias("to_id"), F.lit("part").alias("to_kind"), "l_shipdate")
    known = o.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("since"))
    known = known.unionByName(p.where("p_size < 25").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.expr("TIMESTAMP_NTZ '1900-01-01'").alias("since")))
    return ordered.with_ends(li, known, F.col("l_shipdate")).groupBy("from_id", "to_id").agg(F.count("*").alias("edges"))


@query("""
    WITH o AS (SELECT o_custkey % 100 AS k, o_orderdate AS dt, o_orderkey AS v FROM orders), u AS (SELECT user_id % 100 AS k, date_add(ts, INTERVAL (-9600) DAY) AS dt, event_id FROM events),
    a AS (SELECT k, dt, 0 AS tag, v, NULL AS e FROM (SELECT k, dt, max(v) AS v FROM o GROUP BY k, dt) UNION ALL SELECT k, dt, 1, NULL, event_id FROM u),
    f AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY dt, tag, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS found FROM a)
    SELECT e AS event_id, k AS name, found AS definition FROM f WHERE tag = 1""")  # fmt: skip
def asof_definition(spark, d):
    at = lambda c: F.date_trunc("year", c)
    o = A.table(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("name"), F.col("o_orderdate").alias("at")).agg(F.max("o_orderkey").alias("definition"))
    e = A.table(spark, d, "events").select((F.col("user_id") % 100).alias("name"), F.expr("ts - INTERVAL 9600 DAYS").alias("at"), "event_id")
    found = asof_last(o.withColumn("bucket", at("at")), e.withColumn("bucket", at("at")), "name", "at", "definition", "bucket")
    return found.select("event_id", "name", "definition")


@query("SELECT o_orderkey AS node_id, o_orderstatus AS status, coalesce(CAST(p.l AS VARCHAR), o_orderpriority) AS msg FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS l FROM lineitem WHERE l_quantity > 45 GROUP BY 1) p ON l_orderkey = o_orderkey")
def property_patch(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("msg"))
    patch = A.table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("node_id")).agg(F.max("l_linenumber").cast("string").alias("value"))
    return enrich.patched(o, patch, "msg")


@query("""SELECT conv_id, 'Commit: ' || min(role) || chr(10) || 'Functions touched (' || count(*) || '):' || chr(10) || string_agg('  * ' || left(split_part(text, chr(10), 1), 120), chr(10) ORDER BY turn) AS rationale
    FROM conversations GROUP BY conv_id""")  # fmt: skip
def commit_rationale(spark, d):
    c = A.table(spark, d, "conversations").select("conv_id", "turn", "role", X.left(X.first_line("text"), 120).alias("s"))
    g = c.groupBy("conv_id").agg(F.min("role").alias("msg"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]).alias("s"))
    return g.select("conv_id", enrich.rationale("msg", "s").alias("rationale"))


@query("""SELECT p_name AS node_id, arg_min(p_brand, p_partkey) AS file, min(p_partkey) AS ord FROM part
    WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size < 2) GROUP BY p_name""")  # fmt: skip
def insert_if_absent(spark, d):
    p = A.table(spark, d, "part").select(F.col("p_name").alias("node_id"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("ord"), "p_size")
    return graphstore.new_nodes(p.where("p_size < 2").select("node_id").distinct(), p.drop("p_size"))


@query("""SELECT l_orderkey AS from_id, l_returnflag AS label, l_partkey AS to_id, min(l_linenumber) AS ord FROM lineitem
    WHERE (l_orderkey IN (SELECT o_orderkey FROM orders) OR l_orderkey IN (SELECT p_partkey FROM part)) AND (l_partkey IN (SELECT p_partkey FROM part) OR l_partkey IN (SELECT o_orderkey FROM orders))
    AND (l_orderkey, l_returnflag, l_partkey) NOT IN (SELECT (l_orderkey, l_returnflag, l_partkey) FROM lineitem WHERE l_quantity < 10) GROUP BY 1, 2, 3""")  # fmt: skip
def insert_edges(spark, d):
    li = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_returnflag").alias("label"), F.col("l_partkey").alias("to_id"), F.col("l_linenumber").alias("ord"), "l_quantity")
    nodes = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id")).union(A.table(spark, d, "part").select("p_partkey"))
    return graphstore.new_edges(li.where("l_quantity < 10"), li.drop("l_quantity"), nodes)


@query("""WITH n AS (SELECT o_custkey AS k, max(o_orderkey) AS v, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS k, coalesce(n.v, -1) AS v, coalesce(n.s, c_mktsegment) AS s FROM customer LEFT JOIN n ON n.k = c_custkey""")  # fmt: skip
def keyed_upsert(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("v"), F.col("c_mktsegment").alias("s"))
    w = A.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderstatus").alias("s"))
    return keyed.upserted(c, w, "k", "v")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def keyed_delete(spark, d):
    gone = A.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return keyed.deleted(A.table(spark, d, "customer").select("c_custkey", "c_name"), gone, "c_custkey")


@query("""SELECT e.user_id AS k, any_value(c_name) AS name, bool_or(c_custkey IS NOT NULL) AS "exists", count(*) AS n, regexp_matches('user' || e.user_id, '^[A-Za-z0-9]{6,}$') AS valid
    FROM events e LEFT JOIN customer ON c_custkey = e.user_id * 7 GROUP BY e.user_id""")  # fmt: skip
def keyed_lookup(spark, d):
    keys = A.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("k", F.col("user_id") * 7)
    names = A.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    got = keyed.found(keys, names, "k")
    return got.select(F.col("user_id").alias("k"), "name", "exists", "n", keyed.valid_name(F.concat(F.lit("user"), F.col("user_id")), 6).alias("valid"))


# ---- vectors -----------------------------------------------------------------------------------------------------

SIM = """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
    s AS (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 9) AS sim FROM embeddings, q)"""


def searched(spark, d, **options) -> DataFrame:
    e = A.table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    found = vector.knn(e, q, 5, "embedding", "vec_id", similarity=lambda a, b: F.round(vector.cosine(a, b), 9), **options)
    return found.select("vec_id", "label")


@query(SIM + ", c AS (SELECT * FROM s ORDER BY sim DESC, vec_id LIMIT 15) SELECT vec_id, label FROM c WHERE label <> 3 ORDER BY sim DESC, vec_id LIMIT 5")
def semantic_search(spark, d):
    return searched(spark, d, where=F.col("label") != 3)


@query(SIM + " SELECT vec_id, label FROM s WHERE label <> 3 ORDER BY sim DESC, vec_id LIMIT 5")
def semantic_search_exact(spark, d):
    return searched(spark, d, where=F.col("label") != 3, exact=True)


@query(SIM + " SELECT vec_id, label FROM s ORDER BY sim DESC, vec_id LIMIT 5")
def vector_top_k(spark, d):
    return searched(spark, d)


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), e), 6) AS dot, round(list_distance(CAST(embedding AS DOUBLE[]), e), 6) AS l2 FROM embeddings, q""")
def vector_distances(spark, d):
    e = A.table(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 0").select("embedding").first()[0]])
    return e.select("vec_id", F.round(vector.dot("embedding", q), 6).alias("dot"), F.round(vector.l2("embedding", q), 6).alias("l2"))


@query()
def vector_index_nearest(spark, d):
    """The five nearest rows of each query through the index; approximate, so without SQL (tests measure its recall)."""
    e = A.table(spark, d, "embeddings").select("vec_id", "embedding")
    found = vector.approximate_knn(e, e.where("vec_id % 50 = 0"), 5, "embedding", "vec_id", 64, tables=48, bits=4)
    return found.select("query", "vec_id", "rank", "similarity")


@query("SELECT vec_id, label FROM embeddings ORDER BY label = 7 DESC, vec_id LIMIT 1")
def preferred_row(spark, d):
    return vector.preferred(A.table(spark, d, "embeddings").select("vec_id", "label"), F.col("label") == 7, [F.col("vec_id")])


# ---- scalar expressions ------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, 'func_' || replace(replace(replace('src/' || p_brand || '.py', '/', '_'), chr(92), '_'), '.py', '') || '_' || p_type AS function_id,
    'state_' || replace(replace(replace('src/' || p_brand || '.py', '/', '_'), chr(92), '_'), '.py', '') || '_' || p_type || '_' || substring(sha1(p_name), 1, 7) AS state_id FROM part""")  # fmt: skip
def id_construction(spark, d):
    p = A.table(spark, d, "part")
    safe = M.safe_path(F.concat(F.lit("src/"), F.col("p_brand"), F.lit(".py")))
    return p.select("p_partkey", M.function_id(safe, "p_type").alias("function_id"), M.state_id(safe, "p_type", M.short_hash(F.sha1("p_name"))).alias("state_id"))


@query("""SELECT page_id, split_part(split_part(url, '(', 1), '.', -1) AS callee, split_part(url, '.', 1) AS module FROM pages""")
def callee_normalise(spark, d):
    return A.table(spark, d, "pages").select("page_id", X.callee_name("url").alias("callee"), X.first_segment("url").alias("module"))


@query("SELECT doc_id, split_part(text, chr(10), 1) AS first_line, len(string_split(text, chr(10))) AS n_lines FROM documents")
def first_line(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.first_line("text").alias("first_line"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS short, left(text, 4000) AS stored FROM documents")
def truncate_ellipsis(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.ellipsis("text", 80).alias("short"), X.left("text", M.STORED).alias("stored"))


@query("SELECT page_id, replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def html_escape(spark, d):
    return A.table(spark, d, "pages").select("page_id", X.html_escaped("html").alias("escaped"))


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_size > 25 THEN '' ELSE p_name END, ''), nullif(CASE WHEN p_size > 40 THEN NULL ELSE p_brand END, ''), p_type) AS value FROM part")
def falsy_coalesce(spark, d):
    return A.table(spark, d, "part").select("p_partkey", X.first_full(F.when(F.col("p_size") > 25, "").otherwise(F.col("p_name")), F.when(F.col("p_size") <= 40, F.col("p_brand")), "p_type").alias("value"))


@query("SELECT conv_id, turn, regexp_replace(chr(9) || ' ' || text || chr(9) || chr(10), '^\\s+|\\s+$', '', 'g') AS stripped FROM conversations")
def strip_text(spark, d):
    return A.table(spark, d, "conversations").select("conv_id", "turn", X.stripped(F.concat(F.lit("\t "), F.col("text"), F.lit("\t\n"))).alias("stripped"))


CODE_SQL = "('def ' || replace(p_name, ' ', '_') || '(x):' || chr(10) || '    \"\"\" ' || p_type || chr(10) || '  more \"\"\"' || chr(10))"


@query(f"""SELECT p_partkey, regexp_extract({CODE_SQL}, '^\\s*(?:async\\s+)?def\\s+(\\w+)', 1) AS name, p_type AS summary FROM part""")
def function_summary(spark, d):
    code = F.concat(F.lit("def "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit('(x):\n    """ '), F.col("p_type"), F.lit('\n  more """\n'))
    return A.table(spark, d, "part").select("p_partkey", X.function_name(code).alias("name"), enrich.ingest_summary(code).alias("summary"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'fix' END AS type, CASE WHEN o_orderstatus = 'F' THEN '(' || o_custkey || ')' END AS scope,
    CASE WHEN o_orderstatus = 'F' THEN true END AS breaking, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS subject FROM orders""")  # fmt: skip
def conventional_commits(spark, d):
    msg = F.concat(F.when(F.col("o_orderstatus") == "F", "FIX").otherwise("note"), F.lit("("), F.col("o_custkey"), F.lit(")!: "), F.col("o_orderpriority"))
    return A.table(spark, d, "orders").withColumn("c", X.conventional_commit(msg)).select("o_orderkey", "c.type", "c.scope", "c.breaking", "c.subject")


@query("""SELECT doc_id, list_sort(list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')))[1:5] AS names FROM documents""")
def sorted_distinct_names(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.slice(X.distinct_sorted(F.split(F.lower("text"), " ")), 1, 5).alias("names"))


@query("SELECT doc_id, contains(text, '8') AS has_eight, starts_with(source, 'src1') AS in_src1, replace(source, 'src', 'source-') AS renamed FROM documents")
def substring_tests(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.contains("text", F.lit("8")).alias("has_eight"), F.startswith("source", F.lit("src1")).alias("in_src1"), F.replace("source", F.lit("src"), F.lit("source-")).alias("renamed"))


@query("""SELECT doc_id, left(coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), split_part(text, chr(10), 1)), 60) AS label,
    coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN lang END, ''), nullif(CASE WHEN doc_id % 5 = 0 THEN source END, ''), left(text, 200)) AS summary,
    left(coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN source END, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN lang END, ''), left(text, 200)), 400) AS rebuilt_summary FROM documents""")  # fmt: skip
def viz_label_summary(spark, d):
    t = A.table(spark, d, "documents")
    name, ai, why = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.when(F.col("doc_id") % 5 == 0, F.col("source"))
    return t.select("doc_id", X.viz_label(name, "text", "lang", F.col("doc_id").cast("string")).alias("label"), X.viz_summary(ai, why, F.col("text")).alias("summary"), X.rebuilt_summary(why, ai, F.col("text")).alias("rebuilt_summary"))


def case_sql(col: str, values: dict, default) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in values.items()) + f" ELSE {lit(default)} END"


KINDS_SQL = "(CASE l_linenumber WHEN 1 THEN 'Repo' WHEN 2 THEN 'Commit' WHEN 3 THEN 'Hunk' WHEN 4 THEN 'Symbol' WHEN 5 THEN 'CALLS' WHEN 6 THEN 'CONTAINS' ELSE 'other' END)"


def kinds(spark, d) -> DataFrame:
    names = {1: "Repo", 2: "Commit", 3: "Hunk", 4: "Symbol", 5: "CALLS", 6: "CONTAINS"}
    return A.table(spark, d, "lineitem").withColumn("kind", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("l_linenumber")), F.lit("other")))


@query(f"SELECT {KINDS_SQL} AS kind, {case_sql(KINDS_SQL, V.KIND_COLOR, V.KIND_DEFAULT)} AS color, {case_sql(KINDS_SQL, V.EDGE_COLOR, V.EDGE_DEFAULT)} AS edge_color, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def kind_color(spark, d):
    return kinds(spark, d).groupBy("kind", V.kind_color("kind").alias("color"), V.edge_color("kind").alias("edge_color")).agg(F.count("*").alias("n"))


@query(f"SELECT {KINDS_SQL} AS kind, CAST({case_sql(KINDS_SQL, V.RADIUS, 6)} AS INTEGER) AS radius, CAST({case_sql(KINDS_SQL, V.STRENGTH, 0.2)} AS DOUBLE) AS strength, CAST({case_sql(KINDS_SQL, V.DISTANCE, 100)} AS INTEGER) AS distance, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4")
def radius_tier(spark, d):
    return kinds(spark, d).groupBy("kind", V.radius("kind").alias("radius"), V.link_strength("kind").alias("strength"), V.link_distance("kind").alias("distance")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, greatest(0.5, coalesce(nullif(l_discount * 20, 0), 1.0)) AS width FROM lineitem")
def stroke_width(spark, d):
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.stroke_width(F.col("l_discount") * 20).alias("width"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type || ':' || json_extract_string(props, '$.k') AS shown FROM events")
def json_decode(spark, d):
    e = A.table(spark, d, "events").withColumn("m", F.from_json("props", "k long"))
    return e.select("event_id", F.col("m.k").alias("k"), F.concat_ws(":", "event_type", F.col("m.k").cast("string")).alias("shown"))


@query("SELECT p_partkey, '{\"type\":\"' || p_type || '\",\"id\":\"' || p_partkey || '\",\"name\":\"' || p_name || '\"}' AS doc FROM part")
def json_encode(spark, d):
    return A.table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_type").alias("type"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))).alias("doc"))


@query("SELECT p_partkey, 'brand=' || p_brand || ';name=' || (CASE WHEN length(p_name) > 8 THEN left(p_name, 8) || '…' ELSE p_name END) AS meta FROM part")
def metadata_panel(spark, d):
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("id"), F.col("p_partkey").cast("string"), F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type"))
    shown = V.metadata_rows(V.without_keys(m, "type", "id"), 8, 8)
    return A.table(spark, d, "part").select("p_partkey", F.array_join(F.transform(shown, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("meta"))


# ---- sources and filters -----------------------------------------------------------------------------------------

SKIP_SQL = ", ".join(f"'{s}'" for s in SKIPPED)
PATH_SQL = "('src/' || CASE WHEN p_partkey % 7 = 0 THEN 'graph_tools' ELSE replace(p_name, ' ', '_') END || CASE WHEN p_size % 3 = 0 THEN '.txt' ELSE '.py' END)"


@query(f"SELECT p_partkey, {PATH_SQL} AS path FROM part WHERE ends_with({PATH_SQL}, '.py') AND split_part({PATH_SQL}, '/', -1) NOT IN ({SKIP_SQL})")
def skip_file_filter(spark, d):
    name = F.when(F.col("p_partkey") % 7 == 0, "graph_tools").otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    path = F.concat(F.lit("src/"), name, F.when(F.col("p_size") % 3 == 0, ".txt").otherwise(".py"))
    return python_files(A.table(spark, d, "part").select("p_partkey", path.alias("path")))


@query("SELECT page_id, split_part(split_part(split_part(url, '?', 1), '#', 1), '/', -1) AS base FROM pages")
def base_names(spark, d):
    return A.table(spark, d, "pages").select("page_id", base_name(F.substring_index(F.substring_index("url", "?", 1), "#", 1)).alias("base"))


@query("""SELECT page_id, split_part(m, '.', 1) AS module, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS m FROM pages) GROUP BY 1, 2""")
def imports_extract(spark, d):
    found = A.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("m"))
    return found.groupBy("page_id", X.first_segment("m").alias("module")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_partkey = 42")
def point_lookup(spark, d):
    return spark.sql("SELECT * FROM {part} WHERE p_partkey = :nid", args={"nid": 42}, part=A.table(spark, d, "part"))


@query("SELECT 'Commit' AS kind, 'commit_' || o_orderkey AS node_id FROM orders UNION ALL SELECT 'FunctionIdentity', 'func_' || p_partkey FROM part UNION ALL SELECT 'FileIdentity', 'file_' || s_suppkey FROM supplier")
def label_scan(spark, d):
    one = lambda t, kind, prefix, key: A.table(spark, d, t).select(F.lit(kind).alias("kind"), F.concat(F.lit(prefix), F.col(key)).alias("node_id"))
    return one("orders", M.COMMIT, "commit_", "o_orderkey").unionByName(one("part", M.FUNCTION, "func_", "p_partkey")).unionByName(one("supplier", M.FILE, "file_", "s_suppkey"))


# ---- explorer ----------------------------------------------------------------------------------------------------

GRAPH_SQL = """WITH n AS (
    SELECT 'Repo_' || r_regionkey AS id, 'Repo' AS kind, r_name AS label, 'the ' || lower(r_name) AS summary, 'active' AS status FROM region
    UNION ALL SELECT 'File_' || n_nationkey, 'File', n_name, 'the ' || lower(n_name), 'active' FROM nation
    UNION ALL SELECT 'Symbol_' || s_suppkey, 'Symbol', s_name, 'the ' || lower(s_name), CASE WHEN s_acctbal < 0 THEN 'stale' ELSE 'active' END FROM supplier),
  e AS (SELECT 'Repo_' || n_regionkey AS source, 'File_' || n_nationkey AS target, 'CONTAINS' AS kind FROM nation
    UNION ALL SELECT 'File_' || s_nationkey, 'Symbol_' || s_suppkey, 'DEFINES' FROM supplier WHERE s_acctbal > 1000)"""
SEEN = ", v AS (SELECT * FROM n WHERE status = 'active' AND (contains(lower(label), 'ri') OR contains(lower(summary), 'ri') OR contains(lower(kind), 'ri') OR kind = 'File'))"


@query(GRAPH_SQL + " SELECT * FROM n WHERE kind = 'Symbol' AND status = 'active' AND (contains(lower(label), '00000001') OR contains(lower(summary), '00000001') OR contains(lower(kind), '00000001'))")
def viz_filter(spark, d):
    return traverse.viz_filter(A.contains(spark, d)[0], "Symbol", "active", "00000001")


def seen(spark, d) -> tuple[DataFrame, DataFrame]:
    n, e = A.contains(spark, d)
    active = traverse.viz_filter(n, status="active")
    return traverse.viz_filter(active, query="RI").unionByName(traverse.viz_filter(active, kind="File")).distinct(), e


@query(GRAPH_SQL + SEEN + " SELECT * FROM e WHERE source IN (SELECT id FROM v) AND target IN (SELECT id FROM v)")
def induced_subgraph(spark, d):
    return traverse.induced(*seen(spark, d))


@query(GRAPH_SQL + " SELECT * FROM n WHERE id NOT IN (SELECT source FROM e UNION SELECT target FROM e)")
def isolated_nodes(spark, d):
    return traverse.connected(*A.contains(spark, d), isolated=True)


@query(GRAPH_SQL + " SELECT * FROM n WHERE id IN (SELECT source FROM e UNION SELECT target FROM e)")
def connected_nodes(spark, d):
    return traverse.connected(*A.contains(spark, d))


@query(GRAPH_SQL + """ SELECT '→' AS direction, e.kind AS edge_kind, n.id, n.kind, n.label FROM e JOIN n ON n.id = e.target WHERE e.source = 'File_3'
    UNION ALL SELECT '←', e.kind, n.id, n.kind, n.label FROM e JOIN n ON n.id = e.source WHERE e.target = 'File_3'""")  # fmt: skip
def neighbors(spark, d):
    return traverse.neighbours(*A.contains(spark, d), "File_3")


@query(GRAPH_SQL + " SELECT list_sort(list(DISTINCT kind)) AS kinds, list_sort(list(DISTINCT status)) AS statuses, count(*) AS nodes FROM n")
def distinct_kinds(spark, d):
    return A.contains(spark, d)[0].agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set("status")).alias("statuses"), F.count("*").alias("nodes"))


@query(GRAPH_SQL + " SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges")
def graph_counts(spark, d):
    n, e = A.contains(spark, d)
    count = lambda df, kind: df.select(F.lit(kind).alias("k"))
    both = count(n, "n").unionAll(count(e, "e"))
    return both.agg(F.count_if(F.col("k") == "n").alias("nodes"), F.count_if(F.col("k") == "e").alias("edges"))


@query(GRAPH_SQL + " SELECT id, kind, left(label, 60) AS label, left(summary, 400) AS summary, 'active' AS status FROM n")
def viz_export(spark, d):
    n = A.contains(spark, d)[0]
    props = F.create_map(F.lit("name"), F.col("label"), F.lit("ai_summary"), F.col("summary"), F.lit("status"), F.col("status"))
    return export.viz_nodes(n.select(F.col("kind").alias("type"), "id", props.alias("props"))).drop("metadata")


# ---- the replay of a commit log ----------------------------------------------------------------------------------


def replayed(spark, d) -> M.Graph:
    return fold.replay(history.commit_log(spark, d))


@query(history.NODES_SQL)
def code_graph_nodes(spark, d):
    prop = lambda k: F.try_element_at("props", F.lit(k)).alias(k)
    return replayed(spark, d).nodes_all().select("kind", "node_id", *map(prop, ("name", "file", "status", "code_hash")))


@query(history.EDGES_SQL)
def code_graph_edges(spark, d):
    return replayed(spark, d).edges_all.select("from_id", "from_kind", "label", "to_id", "to_kind")


@query(history.KEPT_SQL)
def code_graph_resolved_edges(spark, d):
    return replayed(spark, d).edges.select("from_id", "from_kind", "label", "to_id", "to_kind")


@query(history.SUMMARY_SQL)
def analyse_summary(spark, d):
    return enrich.enriched(replayed(spark, d)).nodes[M.STATE].select("node_id", "ai_summary", "status")


@query(history.PATCH_SQL)
def edit_patch(spark, d):
    importable(spark)
    done = history.edits(spark, d).withColumn("p", patched("source", "name", "new_code"))
    return done.select("file", "turn", "p.lines_replaced", "p.text")
