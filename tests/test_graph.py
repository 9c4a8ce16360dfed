"""The replayed graph: golden numbers, quirks, and a sequential replay as the reference."""

from __future__ import annotations

import json
import subprocess

import corpus
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempograph import model as M
from tempograph.functions import pycode
from tempograph.functions.patch import replace_function
from tempograph.operators import enrich, export, traverse, vector
from tempograph.operators.fold import replay
from tempograph.sources import gitlog
from tempograph.tools import MANIFEST, Tools

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def graph(spark, log):
    return replay(spark.createDataFrame(log, M.COMMITS_RAW))


def stored(g):
    """The graph with its relations kept, so that tests don't replay it again and again."""
    nodes = {k: v.persist() for k, v in g.nodes.items()}
    return M.Graph(nodes, g.edges.persist(), g.edges_all.persist(), g.states_all, g.diagnostics, g.files_all, g.extra)


@pytest.fixture(scope="module")
def one(spark):
    return stored(graph(spark, corpus.ONE))


@pytest.fixture(scope="module")
def two(spark):
    return stored(graph(spark, corpus.TWO))


def edge_set(df) -> set:
    return {(r.from_id, r.label, r.to_id) for r in df.collect()}


def by_label(df) -> dict:
    return {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}


def test_golden_counts_of_one_commit(one):
    assert {k: v.count() for k, v in one.nodes.items()} == {M.COMMIT: 1, M.FILE: 4, M.CLASS: 3, M.FUNCTION: 10, M.STATE: 10}
    assert by_label(one.edges_all) == {"CONTAINS": 16, "IMPORTS": 1, "INHERITS": 3, "HAS_STATE": 10, "GENERATED": 10, "CALLS": 7}
    assert edge_set(one.edges_all) - edge_set(one.edges) == {("class_auth_service_AuthError", "INHERITS", "class_auth_service_Exception")}
    assert all(M.unique_ids(df) for df in one.nodes.values())


def test_golden_calls(one):
    f = lambda m, n: f"func_auth_{m}_{n}"
    want = {
        ("service_signup", "service_validate_username"), ("service_signup", "models_user_exists"), ("service_signup", "models_create_user"), ("service_login", "models_get_user"),
        ("service_logout", "models_user_exists"), ("service_delete_account", "service_login"), ("service_delete_account", "models_delete_user"),
    }
    assert {(a, b) for a, _, b in edge_set(one.edge(M.CALLS))} == {(f(*a.split("_", 1)), f(*b.split("_", 1))) for a, b in want}


def test_second_commit_adds_versions_only(one, two):
    more = {k: v - by_label(one.edges_all).get(k, 0) for k, v in by_label(two.edges_all).items()}
    assert {k: v for k, v in more.items() if v} == {"NEXT_COMMIT": 1, "CONTAINS": 3, "HAS_STATE": 10, "GENERATED": 10, "PREVIOUS_VERSION": 10}
    assert {r["status"]: r["count"] for r in two.nodes[M.STATE].groupBy("status").count().collect()} == {"active": 10, "superseded": 10}


def test_tools(two):
    t = Tools(two)
    hops = lambda name, **k: {(r.name, r.hop) for r in t.trace_blast_radius(f"func_auth_models_{name}", **k).collect()}
    assert hops("get_user") == {("login", 1), ("delete_account", 2)}
    assert hops("create_user") == {("signup", 1)} and hops("user_exists") == {("signup", 1), ("logout", 1)}
    assert hops("get_user", depth=1) == {("login", 1)}
    trace = t.get_temporal_vulnerability_trace("create_user", "2026-06-25T00:00:00+00:00")
    assert [r.asDict() for r in trace.collect()] == [{"node_id": "commit_623241a", "hash": corpus.V1, "timestamp": corpus.EARLY, "msg": "Change\n\nA note.\n More."}]
    detailed = t.get_temporal_vulnerability_trace("create_user", "2027-01-01T00:00:00+00:00", detailed=True).collect()
    assert {(r.caller, r.state_status) for r in detailed} == {("signup", "active"), ("signup", "superseded")}
    diff = t.call("get_code_time_travel_diff", {"state_node_id": "state_auth_service_signup_eef5695"})
    assert diff["current"]["status"] == "active" and diff["previous"]["commit"] == "623241a" and "status" not in diff["previous"]
    assert t.call("get_code_time_travel_diff", {"state_node_id": "state_auth_service_signup_623241a"})["previous"] is None
    assert t.call("get_code_time_travel_diff", {"state_node_id": "none"}) == {"current": None, "previous": None}
    found = t.search_code_semantics("returns the stored password for a username", 3).collect()
    assert found[0].node_id == "state_auth_models_get_user_eef5695" and len(found) <= 3


def test_dispatch(two):
    t = Tools(two)
    assert t.dispatch("GET", "/manifest") == (200, MANIFEST) and t.dispatch("GET", "/x")[0] == 404
    assert t.dispatch("POST", "/other")[0] == 404 and t.dispatch("POST", "/call", b'{"name": "nope"}')[0] == 404
    assert t.dispatch("POST", "/call", b"not json")[0] == 500
    status, body = t.dispatch("POST", "/call", json.dumps({"name": "trace_blast_radius", "parameters": {"function_identity_id": "func_auth_models_get_user"}}))
    assert status == 200 and [r["name"] for r in body["result"]] == ["login", "delete_account"]


def test_enrichment(two):
    g = enrich.enriched(two)
    first = g.nodes[M.COMMIT].where("node_id = 'commit_623241a'").first()
    lines = first.ai_rationale.split("\n")
    assert lines[:3] == ["Commit: Change", "Author notes: A note. More.", "Functions touched (10):"] and len(lines) == 13
    assert g.nodes[M.STATE].where("ai_summary IS NULL OR size(ai_summary_vec) <> 2048").count() == 0


def test_described():
    code = "def f(self, a, b):\n    if a:\n        raise ValueError(b)\n    g(a); h.k(b)\n    return a\n"
    assert pycode.described(code) == "`f` — accepts (a, b); calls ValueError, g, k; raises ValueError; 1 branch(es); returns a value"
    assert pycode.described("def f(:") == "unparseable function"
    assert pycode.described("x = 1\ny = 2") == "x = 1"
    assert pycode.described("def f():\n    pass") == "`f` — no return value"


CASES = {
    "import numpy as np\nimport os.path\nfrom . import x\nfrom a.b import c\nfrom __future__ import annotations\n": [("import", "numpy as np"), ("import", "os.path"), ("import", "."), ("import", "a.b")],
    "@d(q())\ndef f(x=g()):\n    a.b.c()\n    foo(1).bar()\n": [("function", "f"), ("call", "a.b.c"), ("call", "foo(1).bar"), ("call", "foo")],
    "@d\nclass C:\n    def m(self):\n        z()\n": [("function", "C"), ("call", "z")],
    "class A(B, m.D, E[int], metaclass=M):\n    class I:\n        pass\n    if x:\n        def f(self): pass\n": [("class", "A"), ("base", "B"), ("class", "I"), ("function", "f")],
    "def o():\n    def i():\n        k()\n    i()\n": [("function", "o"), ("call", "k"), ("call", "i")],
    "async def é_x():\n    await y()\n": [("function", "é_x"), ("call", "y")],
}


@pytest.mark.parametrize("source", CASES)
def test_extraction(source):
    assert [(e, name if name is not None else text) for e, _, _, name, text in pycode.events(source)] == CASES[source]


def test_extraction_of_bad_source():
    assert [e[0] for e in pycode.events("def f(:\n")] == ["error"]
    assert [e[0] for e in pycode.events("")] == []


def test_code_text_is_exact():
    source = "x = 'é'\n@dec\ndef f():\n    return 'ü'  # end\n\ny = 1\n"
    assert [t for e, _, _, _, t in pycode.events(source) if e == "function"] == ["def f():\n    return 'ü'"]


def test_quirks(spark):
    log = corpus.commit(0, "1" * 40, {"a.py": "def late():\n    pass\ndef f():\n    later()\n\nclass A:\n    def m(self): pass\nclass B(Z):\n    def m(self): m()\n", "gone.py": None, "graph_tools.py": "def no(): pass\n"})
    log += corpus.commit(1, "2" * 40, {"a.py": "def later():\n    pass\n", "z.py": "class Z:\n    pass\n", "bad.py": "def ("})
    log += corpus.commit(2, "3" * 40, {"a.py": "class B(Z):\n    pass\nclass Z:\n    pass\ndef f():\n    later()\n"})
    g = graph(spark, log)
    every, kept = edge_set(g.edges_all), edge_set(g.edges)
    assert ("state_a_m_1111111", "PREVIOUS_VERSION", "state_a_m_1111111") in every, "equal ids in one commit: a state before itself"
    assert ("func_a_f", "CALLS", "func_a_later") in kept, "a forward reference resolves when the file is replayed"
    assert ("func_a_m", "CALLS", "func_a_m") in kept
    assert ("class_a_B", "INHERITS", "class_a_Z") in every - kept, "an edge that was skipped is never tried again"
    assert {r.path for r in g.diagnostics.collect()} == {"bad.py"}
    files = {r.node_id for r in g.nodes[M.FILE].collect()}
    assert files == {"file_a", "file_z", "file_bad"}, "no node for deleted and skipped files; a file that can't be parsed has one"
    active = {r.node_id for r in g.nodes[M.STATE].where("status = 'active'").collect()}
    assert active == {"state_a_late_1111111", "state_a_later_2222222", "state_a_f_3333333", "state_a_m_1111111"}


def sequential(log) -> tuple[set, dict]:
    """A plain replay with dictionaries: edges and the latest state of each function."""
    known, latest, edges, previous_commit, commits = {}, {}, set(), None, []
    for seq, sha, *_ in log:
        if sha not in commits:
            commits.append(sha)
    for sha in commits:
        short = sha[:7]
        if previous_commit:
            edges.add((f"commit_{previous_commit}", "NEXT_COMMIT", f"commit_{short}"))
        previous_commit = short
        for row in sorted((r for r in log if r[1] == sha and r[6] and r[7] is not None), key=lambda r: r[5]):
            safe = row[6].replace("/", "_").replace(".py", "")
            edges.add((f"commit_{short}", "CONTAINS", f"file_{safe}"))
            current = None
            for event, scope, owner, name, text in pycode.events(row[7]):
                if event == "function":
                    current, state = f"func_{safe}_{name}", f"state_{safe}_{name}_{short}"
                    known[name] = current
                    edges |= {(f"class_{safe}_{scope}" if scope else f"file_{safe}", "CONTAINS", current), (current, "HAS_STATE", state), (f"commit_{short}", "GENERATED", state)}
                    if current in latest:
                        edges.add((state, "PREVIOUS_VERSION", latest[current]))
                    latest[current] = state
                elif event == "call":
                    callee = text.split("(")[0].split(".")[-1]
                    if callee in known:
                        edges.add((current, "CALLS", known[callee]))
    return edges, latest


NAMES = st.sampled_from("abcd")
FUNCTIONS = st.lists(st.tuples(NAMES, st.lists(NAMES, max_size=3)), min_size=1, max_size=4)
HISTORY = st.lists(st.dictionaries(st.sampled_from(["p.py", "q.py", "d/r.py"]), FUNCTIONS, min_size=1, max_size=2), min_size=1, max_size=5)


@FEW
@given(HISTORY)
def test_replay_equals_a_sequential_one(spark, history):
    log = []
    for seq, files in enumerate(history):
        text = {p: "\n".join(f"def {n}():\n    " + ("; ".join(f"{c}()" for c in calls) or "pass") for n, calls in fs) + "\n" for p, fs in files.items()}
        log += corpus.commit(seq, f"{seq + 1:040x}"[::-1], text)
    g = graph(spark, log)
    edges, latest = sequential(log)
    assert edge_set(g.edges_all) == edges
    active = {r.function_id: r.node_id for r in g.nodes[M.STATE].where("status = 'active'").collect()}
    assert active == latest


@FEW
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=16), st.integers(1, 3))
def test_reach_strategies_agree(spark, pairs, depth):
    edges = spark.createDataFrame(list(pairs) or [(8, 8)], "from_id long, to_id long")
    want, level = {}, {0}
    for hop in range(1, depth + 1):
        level = {a for a, b in pairs if b in level}
        for n in level - {0}:
            want.setdefault(n, hop)
    start = spark.createDataFrame([(0,)], "node_id long")
    for strategy in ("cte", "frontier", "unrolled"):
        got = {r.node_id: r.hop for r in traverse.reach(edges, start, depth, strategy=strategy).collect()}
        assert got == want, strategy


def test_reach_through_a_hub(spark):
    """1,200 nodes that call a hub, which calls 1,200 others: 1.4 million walks, 2,401 nodes."""
    n = 1200
    edges = [(i, 0) for i in range(1, n + 1)] + [(0, n + i) for i in range(1, n + 1)] + [(n + i, 5000) for i in range(1, n + 1)]
    df = spark.createDataFrame(edges, "from_id long, to_id long")
    got = traverse.reach(df, spark.createDataFrame([(5000,)], "node_id long"), 3)
    assert {r.hop: r["count"] for r in got.groupBy("hop").count().collect()} == {1: n, 2: 1, 3: n}


def test_recall_of_the_vector_index(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    asked = e.where("vec_id % 50 = 0")
    got = {(r.query, r.vec_id) for r in vector.approximate_knn(e, asked, 5, "embedding", "vec_id", 64, tables=48, bits=4).collect()}
    want = set()
    for r in asked.collect():
        want |= {(r.vec_id, x.vec_id) for x in vector.knn(e.where(F.col("vec_id") != r.vec_id), r.embedding, 5, "embedding", "vec_id").collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_ids_are_unique_on_write(spark, one, tmp_path):
    from tempograph.sources import graphstore

    twice = M.Graph({**one.nodes, M.CLASS: one.nodes[M.CLASS].unionByName(one.nodes[M.CLASS])}, one.edges, one.edges_all)
    with pytest.raises(ValueError, match="ClassIdentity"):
        graphstore.save(twice, str(tmp_path / "g"))


def test_definitions_beside_a_syntax_error():
    source = "import a.b\nclass A(B):\n    x = (\n    def f(self):\n        return g(1)\n    def bad(:\n        pass\ndef h():\n    k()\n"
    got = [(e, scope, owner, name or text) for e, scope, owner, name, text in pycode.events(source)][1:]
    assert got == [("import", None, None, "a.b"), ("class", None, None, "A"), ("base", None, "A", "B"), ("function", "A", None, "f"), ("call", None, "f", "g"), ("function", None, None, "h"), ("call", None, "h", "k")]


def test_empty_graph(spark):
    g = graph(spark, [])
    assert g.edges_all.count() == 0 and all(v.count() == 0 for v in g.nodes.values())


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0])], "id long, v array<float>")
    assert [r.id for r in vector.knn(df, [1.0, 0.0], 3, "v", "id").collect()] == [1, 3, 2]
    assert [r.id for r in vector.knn(df, [1.0, 0.0], 1, "v", "id", F.col("id") > 1, overfetch=1).collect()] == [], "too few are fetched"
    assert [r.id for r in vector.knn(df, [1.0, 0.0], 1, "v", "id", F.col("id") > 1, exact=True).collect()] == [3]
    e = spark.range(1).select(vector.hashed_embedding(F.lit("a b a"), 16).alias("v"), vector.hashed_embedding(F.lit(""), 16).alias("z")).first()
    assert abs(sum(x * x for x in e.v) - 1) < 1e-6 and e.z == [0.0] * 16


def test_edit(spark, tmp_path):
    old = "import x\n\nclass A:\n    @dec\n    def f(self):\n        return 1\n\ndef g(): pass\n"
    text, lines = replace_function(old, "f", "def f(self):\n    return 2")
    assert lines == "5–6" and text == "import x\n\nclass A:\n    @dec\n    def f(self):\n        return 2\n\ndef g(): pass\n"
    for name, code in (("none", "def f(): pass"), ("f", "def (")):
        with pytest.raises(ValueError):
            replace_function(old, name, code)
    (tmp_path / "a.py").write_text(old)
    log = spark.createDataFrame(corpus.commit(0, "1" * 40, {"a.py": old}), M.COMMITS_RAW)
    t = Tools(replay(log), root=str(tmp_path), commits_raw=log, rebuild=replay)
    assert t.edit_code("a.py", "g", "def g():\n    f()")["ingest"] == "ok"
    assert ("func_a_g", "CALLS", "func_a_f") in edge_set(t.graph.edges)
    with pytest.raises(ValueError):
        t.edit_code("../b.py", "g", "def g(): pass")


def test_git_source(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-b", "master")
    (repo / "a.py").write_text("def f(): pass\n")
    (repo / "b.txt").write_text("text")
    run("add", "-A"), run("commit", "-m", "one\n\nbody")
    (repo / "a.py").unlink()
    (repo / "c.py").write_text("def g(): f()\n")
    run("add", "-A"), run("commit", "-m", "two")
    run("commit", "--allow-empty", "-m", "three")
    rows = gitlog.read_git(spark, str(repo)).orderBy("commit_seq", "file_seq").collect()
    assert [(r.commit_seq, r.path, r.source) for r in rows] == [(0, "a.py", "def f(): pass\n"), (0, "b.txt", None), (1, "a.py", None), (1, "c.py", "def g(): f()\n"), (2, None, None)]
    assert rows[0].msg == "one\n\nbody" and rows[0].timestamp.endswith(("+00:00", "-00:00")) or "T" in rows[0].timestamp
    g = replay(gitlog.read_git(spark, str(repo)))
    assert ("func_c_g", "CALLS", "func_a_f") in edge_set(g.edges) and by_label(g.edges)["NEXT_COMMIT"] == 2


def test_export_round_trip(spark, two, tmp_path):
    path = str(tmp_path / "payload.json")
    nodes, edges = export.write_document(export.payload_nodes(two), export.payload_edges(two), path)
    assert (nodes, edges) == (2 + 8 + 6 + 20 + 20, 81), "nodes are repeated for each touch"
    n, e = export.read_payload(spark, path)
    assert n.count() == nodes and e.count() == edges
    vn, ve = export.graph_viz(two)
    export.write_document(export.as_docs(vn, F.col("id")), export.as_docs(ve, F.col("source")), str(tmp_path / "viz.json"))
    rn, re = export.read_viz(spark, str(tmp_path / "viz.json"))
    assert rn.count() == vn.count() == 39 and re.count() == 81
    assert rn.where("status <> 'active'").count() == 0
    assert {r.m for r in rn.where("kind = 'FunctionState'").select(F.col("metadata")["status"].alias("m")).collect()} == {"active", "superseded"}


def test_saved_graph(spark, two, tmp_path):
    from helpers import plan

    from tempograph.sources import graphstore

    graphstore.save(two, str(tmp_path / "g"))
    back = graphstore.load(spark, str(tmp_path / "g"))
    assert edge_set(back.edges) == edge_set(two.edges) and back.nodes[M.STATE].count() == 20
    assert "PartitionFilters: [isnotnull(label" in plan(back.edge(M.CALLS)), "one label is one folder"
    assert Tools(back).trace_blast_radius("func_auth_models_get_user").count() == 2


def test_command_line(spark, tmp_path, capsys):
    from tempograph.__main__ import main

    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-b", "master")
    (repo / "a.py").write_text("def f(): pass\n\ndef g(): f()\n")
    run("add", "-A"), run("commit", "-m", "one")
    out = str(tmp_path / "graph")
    assert main(["ingest", str(repo), out]) == 0 and main(["enrich", out]) == 0
    assert main(["export", f"{out}-enriched", str(tmp_path / "viz.json")]) == 0
    capsys.readouterr()
    assert main(["call", out, "trace_blast_radius", '{"function_identity_id": "func_a_f"}']) == 0
    assert json.loads(capsys.readouterr().out) == [{"node_id": "func_a_g", "name": "g", "file": "a.py"}]
    doc = json.loads((tmp_path / "viz.json").read_text("utf-8"))
    assert any(n["kind"] == "Commit" and n["summary"].startswith("Commit: one") for n in doc["nodes"])
    assert main([]) == 2


def test_settings_and_services(spark, tmp_path):
    from tempograph.sources.config import first_value

    (tmp_path / ".env").write_text("# note\nKEY='a=b'\nX=2\n")
    assert first_value(str(tmp_path / ".env")) == "a=b" and first_value(str(tmp_path / "none")) == ""

    def call(texts):
        if "bad" in texts:
            raise OSError
        return [[float(len(t)), 1.0] for t in texts]

    embed = vector.service_embedding(call, 2, batch=1, attempts=2)
    df = spark.createDataFrame([("abc",), ("bad",), ("",), (None,)], "t string")
    assert [list(r.v) for r in df.select(embed(F.col("t")).alias("v")).collect()] == [[3.0, 1.0], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]
