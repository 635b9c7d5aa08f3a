"""Source scans, type trees, staging."""

import tarfile

import pytest
from pyspark.sql import functions as F

from loomspan.functions.coercion import sqlite_int
from loomspan.functions.packed import packed_agg, unpack
from loomspan.operators import trees
from loomspan.sources import code, staging

JAVA = '''package a; import java.util.List; import java.util.Map;
/** doc with { brace */
@Service public class Svc {
  private static final int MAX = 5; // no { here
  @Size(min = 1, max = 9) @NotNull private String name = "x;{";
  List<String> tags;
  enum Kind { X(1), Y { void f() {} }, Z; Kind() {} Kind(int i) {} }
  public Svc() { this.name = "a"; }
  @Override public Map<String, List<Integer>> go(@Min(3) final int a, String[] b) throws Exception {
    int k = 0;
    if (a > 1) { k++; for (int i = 0; i < 3; i++) { call(i); } } else if (a < 0) return null; else { k--; }
    try { risky(); } catch (Exception e) { log(e); } finally { done(); }
    switch (a) { case 1: one(); break; default: two(); }
    outer: while (true) { break outer; }
    { inner(); }
    return Map.of("k", List.of(k));
  }
  abstract void none();
}
'''


def test_java_file():
    rows = code.parse_file("src/Svc.java", JAVA)
    file = rows[0]
    assert file["className"] == "Svc" and file["importList"] == "import java.util.List / import java.util.Map"
    fields = {(r["methodName"], r["fieldName"]): r for r in rows if r["row"] == "field"}
    assert fields["-", "MAX"]["isFinal"] == 1 and fields["-", "name"]["fieldType"] == "String" and "@Size" in fields["-", "name"]["rawAnnotations"]
    assert fields["-", "tags"]["fieldType"] == "List<String>" and fields["go", "a"]["fieldKind"] == "parameter" and fields["go", "b"]["fieldType"] == "String[]"
    methods = {r["methodName"]: r for r in rows if r["row"] == "method" and r.get("kind") == "signature"}
    assert methods["go"]["returnType"].replace(" ", "") == "Map<String,List<Integer>>" and methods["go"]["args"] == ["@Min(3) final int a", "String[] b"] and "none" in methods
    assert next(r for r in rows if r.get("kind") == "enum")["args"] == ["X", "Y", "Z"]
    steps = {tuple(r["process"][1:]): r["processContent"] for r in rows if r.get("kind") == "step" and r["methodName"] == "go"}
    assert steps[1,] == "int k = 0" and steps[2,].startswith("if (a > 1)") and steps[2, 1] == "k++" and steps[2, 2].startswith("for") and steps[2, 2, 1] == "call(i)"
    assert steps[3,].startswith("else if") and steps[3, 1] == "return null" and steps[4,] == "else" and steps[5,] == "try" and steps[6,].startswith("catch") and steps[7,] == "finally"
    flat = list(steps.values())
    assert any(s.startswith("case 1") for s in flat) and "inner()" in flat and "one()" in flat and any(s.startswith("while") for s in flat)


@pytest.mark.parametrize("text", [None, "", "class", "class A {", "class A { int f( {", "}}}", "class A { void f() { if (x", '"open', "/* open", "class A { @X(" * 50])
def test_broken_files_give_what_could_be_read(text):
    assert code.parse_file("p", text)[0]["row"] == "file"


def test_scan_to_catalogue_rows(spark, tmp_path):
    (tmp_path / "src" / "test").mkdir(parents=True)
    (tmp_path / "src" / "Svc.java").write_text(JAVA)
    (tmp_path / "src" / "test" / "T.java").write_text("class T {}")
    scanned = code.scan(code.sources(spark, str(tmp_path)))
    assert code.source_rows(scanned).first().className == "Svc" and code.source_rows(scanned).count() == 1
    f = {(r.methodName, r.fieldName): r for r in code.field_rows(scanned).collect()}
    assert (f["-", "name"].validationMin, f["-", "name"].validationMax, f["-", "name"].nullable) == (1, 9, 0) and f["go", "a"].validationMin == 3
    m = code.method_rows(scanned)
    args = trees.unpivot_arguments(m).where("methodName = 'go'").orderBy("argIndex").collect()
    assert [(a.argIndex, a.argName, a.rawType) for a in args] == [(1, "a", "int"), (2, "b", "String[]")]
    assert [r.enumIndex for r in trees.unpivot_enums(m).orderBy("enumIndex").collect()] == [1, 2, 3]


def test_typescript_routes_and_elements(spark):
    text = """const r = createBrowserRouter([{ path: "/", element: <Home />, children: [{ path: "a/:id", element: <A x={1} /> }, { path: "/b", Component: B }] }]);
      navigate("/x"); navigate(-1); window.location.href = '/y'; <Link to="/z">z</Link>; window.open(`/w`);
      <Route path="/r" element={<R />} /> <input type="checkbox" aria-label="ok" disabled={a > b} /> <TextField label="L" /> <select multiple>"""
    assert code.object_routes(text) == [("/", "Home"), ("/a/:id", "A"), ("/b", "B")]
    files = spark.createDataFrame([("src/P.tsx", text)], "path string, text string")
    assert [tuple(r)[1:] for r in code.jsx_routes(files).collect()] == [("/r", "R")]
    assert {(r.toPath, r.transitionType) for r in code.transitions(files).collect()} == {("/x", "navigate"), ("__back__", "navigate.back"), ("/y", "location.href"), ("/z", "Link"), ("/w", "window.open")}
    e = {r.tag: r for r in code.jsx_elements(files).collect()}
    assert e["input"].typeAttr == "checkbox" and e["input"].ariaLabel == "ok" and e["TextField"].labelProp == "L" and e["select"].isMultiple and e["input"].componentName == "P"
    ts = code.parse_file("a.ts", "export class S { private readonly n: number = 1; run(a: string, b?: Foo<number>): void { go(); } }")
    assert {(r["fieldName"], r["fieldType"]) for r in ts if r["row"] == "field"} == {("n", "number"), ("a", "string"), ("b", "Foo<number>")}


def test_prompts_and_bundles(tmp_path):
    assert staging.fill_template("a {{X}} b {{Y}}", {"X": "{{Y}}", "Y": "2"}) == "a {{Y}} b 2"
    with pytest.raises(ValueError):
        staging.fill_template("{{X}} {{Z}}", {"X": "1"})
    for name, text in (("a.csv", "x"), ("b.csv", "y"), ("none.csv", "")):
        (tmp_path / name).write_text(text)
    made = staging.bundle([str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], str(tmp_path / "in.tar.gz"))
    with tarfile.open(made) as tar:
        assert sorted(tar.getnames()) == ["a.csv", "b.csv"] and tar.extractfile("b.csv").read() == b"y"
    for missing in ("none.csv", "lost.csv"):
        with pytest.raises(ValueError):
            staging.bundle([str(tmp_path / missing)], str(tmp_path / "bad.tar.gz"))


def test_a_refresh_that_fails_leaves_all_old_tables(spark, tmp_path):
    store = staging.Store(spark, f"{tmp_path}/store")
    store.refresh({"a": spark.range(3), "b": spark.range(4)})
    with pytest.raises(Exception):  # noqa: B017
        store.refresh({"a": spark.range(5), "b": spark.range(4).select(F.raise_error(F.lit("no")).alias("id"))})
    assert (store.table("a").count(), store.table("b").count()) == (3, 4)
    store.refresh({"a": spark.range(7)})
    store.vacuum()
    assert store.table("a").count() == 7 and len([x for x in (tmp_path / "store").iterdir() if not x.name.endswith(".crc")]) == 2
    store.drop()
    assert not (tmp_path / "store").exists()


MODELS = {"int": "NUMBER", "String": "STRING", "List": "COLLECTION", "Map": "MAP", "[]": "COLLECTION"}


@pytest.mark.parametrize("text,model,shape", [
    ("int", "NUMBER", []), ("String", "STRING", []), ("Foo", "OBJECT", [("ROOT", "Foo", "Foo")]), ("int[]", "COLLECTION", [("ROOT", "int[]", "-"), ("ELEMENT", "int", "-")]),
    ("Map<String,List<? extends Foo>>", "MAP", [("ROOT", "Map<String, List<Foo>>", "-"), ("KEY", "String", "-"), ("VALUE", "List<Foo>", "-"), ("ELEMENT", "Foo", "Foo")]),
    ("List<?>", "COLLECTION", [("ROOT", "List<Object>", "-"), ("ELEMENT", "Object", "Object")]), ("a b", "OBJECT", []), (None, "OBJECT", []), ("List<", "OBJECT", []),
])
def test_type_trees(text, model, shape):
    got, rows = trees.type_rows(text, MODELS)
    assert got == model and [(r[2], r[3], r[6]) for r in rows] == shape


def test_object_rows_have_gapless_ids(spark):
    df = spark.createDataFrame([(10, "Map<String,Foo>")], "first bigint, rawType string")
    tree = trees.with_type_tree(df, "rawType", MODELS).select("first", "typeTree", *(F.lit("-").alias(c) for c in ("ownerKind", "filePath", "className", "methodName", "ownerName")), F.lit(1).alias("ownerIndex"))
    assert [(r.objectId, r.parentObjectId) for r in trees.object_rows(tree, F.col("first")).orderBy("objectId").collect()] == [(10, -1), (11, 10), (12, 10)]


def test_coercion_and_packed_lists(spark):
    df = spark.createDataFrame([("",), ("-",), ("12ab",), (" 7",), (None,), ("-3x",)], "c string")
    assert [r[0] for r in df.select(sqlite_int(F.col("c"))).collect()] == [0, 0, 12, 7, None, -3]
    p = spark.createDataFrame([("a / html/script /  b ",)], "c string")
    assert p.select(unpack(F.col("c"))).first()[0] == ["a", "html/script", "b"] and p.select(unpack(F.col("c"), strict=False)).first()[0] == ["a", "html", "script", "b"]
    assert spark.createDataFrame([], "n int, v string").agg(packed_agg(F.col("v"), F.col("n"))).first()[0] is None
    assert trees.ranked(spark.createDataFrame([("1",), ("2",), ("10",)], "t string"), "t").orderBy("n").collect() == [(1, "1"), (2, "10"), (3, "2")]


def test_staged_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿x,y\n1,"a ""q"", b\nc"\n,\n2\n', "utf-8")
    rows = staging.staged(spark, str(tmp_path / "a.csv"), ["x", "y"]).collect()
    assert ("1", 'a "q", b\nc') in [tuple(r) for r in rows] and ("", "") in [tuple(r) for r in rows]
    assert {tuple(r) for r in staging.by_header(spark, str(tmp_path / "a.csv")).collect()} == {("1", 'a "q", b\nc'), ("2", "")}
    df = spark.createDataFrame([("1", 'q"\r\nx'), ("2", None)], "k string, v string")
    back = staging.by_header(spark, staging.written(df, str(tmp_path / "o"))).orderBy("k").collect()
    assert [r.v for r in back] == ['q"\nx', ""]


def test_constraints_and_cleaning(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", -1), (None, 1), ("c", None)], "k string, n int")
    good, bad = staging.constrained(df, ["k"], {"n > 0": F.col("n") > 0}, required=["k"])
    assert {tuple(r) for r in good.collect()} == {("a", 1), ("c", None)}
    assert {(r.k, r.n, tuple(r.reasons)) for r in bad.collect()} == {("a", 2, ("primary key",)), ("b", -1, ("n > 0",)), (None, 1, ("k is null",))}
    fine, broken = staging.cleaned(spark.createDataFrame([("x", "true"), ("", "-"), ("y", "z")], "t string, n string"), ["n"])
    assert sorted(tuple(r) for r in fine.collect()) == [("-", -1), ("x", 1)] and broken.count() == 1


def test_html_folder_and_routes(spark, tmp_path):
    (tmp_path / "s1.html").write_text("<html/>")
    (tmp_path / "s1.txt").write_text("no")
    assert [tuple(r) for r in staging.html_folder(spark, str(tmp_path)).collect()] == [("s1", "<html/>")]
    df = spark.createDataFrame([("app/(g)/u/[id]/page.tsx",), ("docs/[...r].tsx",), ("index.tsx",)], "f string")
    assert [r[0] for r in df.select(code.file_route(F.col("f"))).collect()] == ["/app/u/:id", "/docs/:r*", "/"]
