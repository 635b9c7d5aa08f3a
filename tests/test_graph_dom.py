"""Graph and DOM fixtures."""

from loomspan.operators import dom, graph

NODES = "path string, normalizedPath string, componentName string, sourceStrategy string, hasDynamicSegment boolean, ord bigint"
ADJ = "fromPath string, fromComponent string, toPath string, toComponent string, sourceFile string, transitionType string, ord bigint"


def adj(spark, pairs):
    return spark.createDataFrame([(a, a, b, b, "f", "t", i) for i, (a, b) in enumerate(pairs)], ADJ)


def paths(df):
    return sorted((r.cost, r.toPath) for r in df.collect())


G1 = [("/", "/a"), ("/a", "/b"), ("/", "/c")]


def test_levels_leaves_and_maximal_paths(spark):
    for pairs in (G1, [*G1, ("/b", "/")]):
        a = adj(spark, pairs)
        levels = graph.expand(a)
        assert paths(levels) == [(1, "/a"), (1, "/c"), (2, "/b")] and graph.max_cost(levels).first()[0] == 2
        assert {r[0] for r in graph.leaves(a).collect()} == {"/b", "/c"} and graph.maximal_paths(a, levels).count() == 2


def test_cycles_run_to_the_threshold(spark):
    a = adj(spark, [("/", "/a"), ("/a", "/b"), ("/b", "/a")])
    levels = graph.expand(a)
    last = levels.where("level = 16").first()
    assert levels.count() == 16 and last.cost == -1 and graph.rendered(graph.phase(levels)).where("cost = 'MAX-OVER'").count() == 1
    assert graph.leaves(a).count() == 0 and graph.expand(a, simple_paths=True).count() == 2
    assert graph.repeated_patterns(levels).count() == 2


def test_start_without_edges_and_row_limit(spark):
    assert graph.expand(adj(spark, G1), start="/none").count() == 0
    try:
        graph.expand(adj(spark, [("/", "/a"), ("/a", "/b"), ("/a", "/c"), ("/b", "/a"), ("/c", "/a")]), max_rows=3)
        raise AssertionError("no error")
    except ValueError as e:
        assert "max_rows" in str(e)


def test_design_example(spark):
    pairs = [("1001", "1002"), ("1001", "1003"), ("1002", "1004"), ("1003", "1005"), ("1004", "1006"), ("1005", "END"), ("1006", "1007"), ("1007", "1005")]
    a = adj(spark, pairs)
    best = graph.maximal_paths(a, graph.expand(a, "1001"), "1001")
    assert sorted(r.cost for r in best.collect()) == [3, 6]
    design = graph.phase(graph.expand(a, "1001"), cost_base=0)
    assert {(r.cost, r.testPhase) for r in design.where("toPath = 'END'").collect()} == {(2, graph.INTEGRATION), (5, graph.SYSTEM)}
    assert design.where("cost = 0").first().testPhase == graph.UNIT
    assert all(len(r.path) == r.level + 1 for r in graph.expand(a, "1001").collect())


def test_adjacency(spark):
    nodes = spark.createDataFrame([("/", "/", "Home", "jsx", False, 0), ("/users/:id", "/users", "User", "jsx", True, 1), ("/u", "/u", "U", "jsx", False, 2)], NODES)
    edges = spark.createDataFrame(
        [("src/Home.tsx", "/users/1", "link", 0), ("src/User.tsx", "__back__", "navigate", 1), ("src/Header.tsx", "/users/2", "link", 2), ("src/Header.tsx", "/", "link", 3), ("src/Home.tsx", "/x", "link", 4), ("src/Home.tsx", "/users/1", "open", 5)],
        "sourceFile string, toPath string, transitionType string, ord bigint",
    )
    rows = {(r.fromPath, r.toPath): (r.toComponent, r.transitionType) for r in graph.adjacency(nodes, edges).collect()}
    assert rows == {
        ("/", "/users/1"): ("User", "link"), ("/users/:id", "__back__"): ("__back__", "navigate"), ("__common__", "/users/2"): ("User", "link"),
        ("__common__", "/"): ("Home", "link"), ("/", "/users/2"): ("User", "link"), ("/", "/x"): ("__unresolved__", "link"),
    }
    assert graph.leaves(graph.adjacency(nodes, edges)).where("toPath = '/users/:id'").count() == 0


def test_tiers_by_path_and_by_shortest_way(spark):
    nodes = spark.createDataFrame([("/", "/", "/", "jsx", False, 0)], NODES)
    a = adj(spark, [("/", "/a"), ("/a", "/b"), ("/b", "/c"), ("/a", "/loop"), ("/loop", "/loop")])
    out = {r.screenComponent: r for r in graph.tiers(nodes, a, graph.maximal_paths(a, graph.expand(a, simple_paths=True))).collect()}
    assert out["/"].tier == "tier1" and out["/b"].viaPath == ["/", "/a", "/b"] and out["/b"].pathGroupId.startswith("path-") and out["/b"].viaPathCost == 2
    assert out["/loop"].viaPath == ["/", "/a", "/loop"] and out["/loop"].pathGroupId is None


def rows(html):
    return [(r["tagPath"], r.get("semanticSource")) for r in dom.page_nodes("s", html)]


def test_dom_nodes():
    assert rows("<html><body><form><label for=i>Name</label><input id=i placeholder=p><input></form></body></html>") == [
        ("html", None), ("html>body", None), ("html>body>form", None), ("html>body>form>input[0]", "label"), ("html>body>form>input[1]", None),
    ]
    assert rows("<html><body><a href=x><button>b</button></a></body></html>") == [("html", None), ("html>body", None), ("html>body>a[0]", "text")]
    twice = rows("<html><body><span><button>1</button></span><span><button>2</button></span></body></html>")
    assert [p for p, _ in twice].count("html>body>button[0]") == 2
    assert rows(None) == rows("") == rows("text") == []
    assert rows("<html><body>" + "<div>" * 3000) and len(rows("<html><body>" + "<div>" * 3000)) == 3002


def test_repeated_scopes(spark):
    html = "<html><body><ul>" + "<li class='c d'><button>x</button><button>y</button></li>" * 3 + "</ul></body></html>"
    n = dom.nodes(spark.createDataFrame([("u", html), ("v", None)], "url string, html string"))
    s = dom.scopes(n).collect()
    li = [r for r in s if r.tagPath == "html>body>ul>li.c"]
    assert len(li) == 3 and {(r.role, r.repeatGroupSize) for r in li} == {("current_scope", 3)} and len({r.scopeId for r in li}) == 1
    leaf = next(r for r in s if r.role == "leaf_operation")
    assert leaf.parentScopeId == li[0].scopeId and leaf.contextText and leaf.tagName == "button"
