"""Queries over graphs, pages, UI elements, instructions, wide source rows and staged files."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions.hashes import md5_prefix, poly31
from loomspan.functions.joins import dealt
from loomspan.functions.packed import packed_agg
from loomspan.functions.storage import materialise, new_path
from loomspan.operators import dom, generate, graph, trees, ui
from loomspan.plans.bindings import Tables, with_sql
from loomspan.plans.registry import query
from loomspan.sources import code, staging
from loomspan.streaming import evidence

ROUTES = ["route_nodes", "route_edges"]
ADJACENCY = """named AS (SELECT *, regexp_extract(sourceFile, '([^/]*)\\.[^.]*$', 1) AS stem FROM route_edges),
resolved AS (SELECT e.*, (SELECT arg_min(path, n.ord) FROM route_nodes n WHERE n.componentName = e.stem) AS own,
  CASE WHEN toPath = '__back__' THEN '__back__' ELSE coalesce((SELECT arg_min(componentName, n.ord) FROM route_nodes n WHERE n.path = e.toPath),
    (SELECT arg_min(componentName, {'l': -length(normalizedPath), 'o': n.ord}) FROM route_nodes n WHERE starts_with(e.toPath, n.normalizedPath) AND n.normalizedPath <> '/'), '__unresolved__') END AS toComponent FROM named e),
spread AS (SELECT coalesce(own, '__common__') AS fromPath, stem AS fromComponent, toPath, toComponent, sourceFile, transitionType, 0 AS part, ord FROM resolved
  UNION ALL SELECT '/', 'Home', toPath, toComponent, sourceFile, transitionType, 1, ord FROM resolved WHERE own IS NULL AND stem = 'Header' AND toPath <> '/'),
adj AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY fromPath, toPath ORDER BY part, ord) AS k FROM spread) WHERE k = 1)"""
WALK = ADJACENCY + """,
walk(level, fromPath, toPath, path) AS (SELECT 1::BIGINT, fromPath, toPath, [fromPath, toPath] FROM adj WHERE fromPath = '/'
  UNION ALL SELECT level + 1, w.fromPath, a.toPath, list_append(path, a.toPath) FROM walk w JOIN adj a ON a.fromPath = w.toPath AND a.toPath <> w.fromPath WHERE level < 200),
leaf AS (SELECT DISTINCT toPath FROM adj WHERE toPath <> '__back__' AND toPath NOT IN (SELECT fromPath FROM adj WHERE toPath <> '/')),
phased AS (SELECT *, CASE WHEN level = (SELECT max(level) FROM walk) THEN '総合テスト' ELSE '結合テスト' END AS testPhase FROM walk)"""
BACKWARD = ADJACENCY + """,
flipped AS (SELECT toPath AS fromPath, fromPath AS toPath FROM adj WHERE fromPath <> '__common__'),
walk(level, fromPath, toPath, path) AS (SELECT 1::BIGINT, fromPath, toPath, [fromPath, toPath] FROM flipped WHERE fromPath = '/'
  UNION ALL SELECT level + 1, w.fromPath, a.toPath, list_append(path, a.toPath) FROM walk w JOIN flipped a ON a.fromPath = w.toPath AND a.toPath <> w.fromPath WHERE level < 200)"""


def sql(names: list[str], ctes: str, select: str) -> str:
    return with_sql(names, f"{ctes}\n{select}", recursive=True)


def adjacency(t: Tables):
    if "adj" not in t.made:
        t.made["adj"] = materialise(graph.adjacency(t["route_nodes"], t["route_edges"]))
    return t.made["adj"]


def walked(t: Tables):
    if "walk" not in t.made:
        t.made["walk"] = graph.expand(adjacency(t))
    return t.made["walk"]


@query("gr01_adjacency", sql(ROUTES, ADJACENCY, "SELECT fromPath, fromComponent, toPath, toComponent, sourceFile, transitionType FROM adj"))
def _(t):
    return adjacency(t).drop("ord")


@query("gr02_forward_paths", sql(ROUTES, WALK, "SELECT level, level AS cost, fromPath, toPath, array_to_string(path, '｜') AS path FROM walk"))
def _(t):
    return walked(t).select("level", "cost", "fromPath", "toPath", F.array_join("path", graph.SEPARATOR).alias("path"))


@query("gr03_reverse_paths", sql(ROUTES, BACKWARD, "SELECT level, fromPath, toPath, array_to_string(path, '｜') AS path FROM walk"))
def _(t):
    return graph.expand(graph.reversed_edges(adjacency(t))).select("level", "fromPath", "toPath", F.array_join("path", graph.SEPARATOR).alias("path"))


@query("gr04_max_cost", sql(ROUTES, WALK, "SELECT max(level) AS maxCost FROM walk"))
def _(t):
    return graph.max_cost(walked(t))


@query("gr05_leaves", sql(ROUTES, WALK, "SELECT toPath FROM leaf"))
def _(t):
    return graph.leaves(adjacency(t))


@query("gr05_maximal_paths", sql(ROUTES, WALK, "SELECT level AS cost, toPath, array_to_string(path, '｜') AS path FROM walk WHERE toPath IN (FROM leaf)"))
def _(t):
    return graph.maximal_paths(adjacency(t), walked(t)).select("cost", "toPath", F.array_join("path", graph.SEPARATOR).alias("path"))


@query("gr06_repeated", sql(ROUTES, WALK, "SELECT path[-2] AS fromPath, path[-1] AS toPath, count(*) AS times FROM walk WHERE level > 1 GROUP BY 1, 2 HAVING count(*) >= 3"))
def _(t):
    return graph.repeated_patterns(walked(t))


@query("gr07_phases", sql(ROUTES, WALK, "SELECT level AS cost, fromPath, toPath, testPhase FROM phased"))
def _(t):
    return graph.phase(walked(t)).select("cost", "fromPath", "toPath", "testPhase")


@query("snk04_path_rows", sql(ROUTES, WALK, "SELECT level::VARCHAR AS cost, fromPath, toPath, testPhase FROM phased"))
def _(t):
    return graph.rendered(graph.phase(walked(t)))


@query("so04_paths_by_cost", sql(ROUTES, WALK, "SELECT level AS cost, toPath FROM walk ORDER BY level"))
def _(t):
    return walked(t).orderBy("cost", "level", "ords").select("cost", "toPath")


@query("gr08_tiers", sql(ROUTES, WALK, """, named_screens AS (SELECT DISTINCT c FROM (SELECT fromComponent AS c FROM adj UNION ALL SELECT toComponent FROM adj) WHERE c NOT LIKE '\\_\\_%' ESCAPE '\\')
  SELECT c AS screenComponent, if(n.path IS NULL, 'tier2', 'tier1') AS tier, n.path AS url, NULL::VARCHAR AS viaPath, n.sourceStrategy FROM named_screens LEFT JOIN route_nodes n ON n.componentName = c""".replace(", named_screens", ",\nnamed_screens", 1)))
def _(t):
    out = graph.tiers(t["route_nodes"], adjacency(t), graph.maximal_paths(adjacency(t), walked(t)))
    return out.select("screenComponent", "tier", "url", F.array_join("viaPath", "|").alias("viaPath"), "sourceStrategy")


_BFS = """,
step(c, via, ords) AS (SELECT 'Home', ['Home'], []::BIGINT[] UNION ALL SELECT toComponent, list_append(via, toComponent), list_append(ords, part * 1099511627776 + ord)
  FROM step JOIN adj ON fromComponent = c WHERE toComponent NOT LIKE '\\_\\_%' ESCAPE '\\' AND NOT list_contains(via, toComponent))
SELECT c AS screenComponent, array_to_string(arg_min(via, {'n': len(via), 'o': ords}), '|') AS viaPath FROM step GROUP BY c"""


@query("gr09_shortest_paths", sql(ROUTES, ADJACENCY + _BFS.rsplit("SELECT c AS", 1)[0].rstrip(), "SELECT c AS" + _BFS.rsplit("SELECT c AS", 1)[1]))
def _(t):
    return graph.bfs(adjacency(t), "Home").select("screenComponent", F.array_join("viaPath", "|").alias("viaPath"))


@query("snk05_summary_counts", sql(ROUTES, WALK, "SELECT testPhase, count(*) AS n FROM phased GROUP BY ALL UNION ALL SELECT 'unresolved', count(DISTINCT toPath) FROM adj WHERE toComponent = '__unresolved__'"))
def _(t):
    lost = adjacency(t).where(F.col("toComponent") == graph.UNRESOLVED).agg(F.countDistinct("toPath").alias("n")).select(F.lit("unresolved").alias("testPhase"), "n")
    return graph.phase(walked(t)).groupBy("testPhase").agg(F.count("*").alias("n")).unionByName(lost)


@query("snk05_summary")
def _(t):
    return graph.summary(adjacency(t), graph.phase(walked(t)), graph.phase(graph.expand(graph.reversed_edges(adjacency(t)))))


@query("snk06_reachability", sql(ROUTES, ADJACENCY + _BFS.rsplit("SELECT c AS", 1)[0].rstrip(), "SELECT c AS screenComponent, len(arg_min(via, {'n': len(via), 'o': ords})) - 1 AS viaPathCost FROM step GROUP BY c"))
def _(t):
    return graph.bfs(adjacency(t), "Home").select("screenComponent", (F.size("viaPath") - 1).cast("bigint").alias("viaPathCost"))


@query("jn16_longest_prefix", sql(ROUTES, ADJACENCY, "SELECT DISTINCT toPath, nullif(toComponent, '__unresolved__') AS component FROM resolved WHERE toPath <> '__back__'"))
def _(t):
    return graph.longest_prefix(t["route_edges"].select("toPath").where("toPath <> '__back__'").distinct(), t["route_nodes"])


# --- DOM --------------------------------------------------------------------------------------------------------

SCOPES = """cand AS (SELECT *, regexp_extract(tagPath, '^(.*)>[^>]*$', 1) AS parent, concat_ws('|', tagName, coalesce(classAttr, ''), directGroupingChildCount, directOperationTagCount, containedOperationTagCount) AS shape
  FROM dom_nodes WHERE nodeType = 'grouping' AND (directOperationTagCount >= 2 OR (containedOperationTagCount >= 2 AND directGroupingChildCount <= 1))),
sized AS (SELECT *, greatest(directOperationTagCount, containedOperationTagCount) AS ops, count(*) OVER (PARTITION BY screenName, parent, shape) AS siblings FROM cand),
thing AS (SELECT screenName, tagPath, if(siblings >= 2, 'current_scope', 'static_root') AS role, if(siblings >= 2, siblings, NULL) AS repeatGroupSize, NULL AS textContent FROM sized
  UNION ALL SELECT screenName, tagPath, 'leaf_operation', NULL, textContent FROM dom_nodes WHERE nodeType = 'operation')"""
HASH = "lpad(lower(to_hex(list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (h * 31 + x) & 4294967295))), 8, '0')"


def node_table(t: Tables):
    missing = [c for c in dom.OPERATION_COLUMNS if c not in t["dom_nodes"].columns]
    return t["dom_nodes"].select("*", *(F.lit(None).cast("string").alias(c) for c in missing))


@query("dom01_nodes")
def _(t):
    return dom.nodes(t["pages"])


@query("src14_page_links", "SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) AS toPath FROM pages")
def _(t):
    files = t["pages"].select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    return code.transitions(files).where("transitionType = 'anchor'").select(F.col("sourceFile").cast("bigint").alias("page_id"), "toPath")


@query("dom05_candidates", with_sql(["dom_nodes"], f"{SCOPES} SELECT screenName, tagPath, ops AS operationTagCount, siblings AS siblingScopeCount, ops * 100 + siblings AS priorityScore FROM sized"))
def _(t):
    return dom.candidates(node_table(t))


_SCOPE_SELECT = f"""SELECT screenName, {HASH.format('tagPath')} AS scopeId, tagPath, role, repeatGroupSize, textContent,
  (SELECT {HASH.format('arg_max(s.tagPath, length(s.tagPath))')} FROM sized s WHERE s.screenName = t.screenName AND starts_with(t.tagPath, s.tagPath || '>') HAVING count(*) > 0) AS parentScopeId FROM thing t"""


@query("dom06_scopes", with_sql(["dom_nodes"], f"{SCOPES} {_SCOPE_SELECT}"))
def _(t):
    return dom.scopes(node_table(t)).select("screenName", "scopeId", "tagPath", "role", "repeatGroupSize", "textContent", "parentScopeId")


@query("jn17_nearest_ancestor", with_sql(["dom_nodes"], f"{SCOPES} SELECT screenName, tagPath, (SELECT arg_max(s.tagPath, length(s.tagPath)) FROM sized s WHERE s.screenName = t.screenName AND starts_with(t.tagPath, s.tagPath || '>')) AS scopePath FROM dom_nodes t"))
def _(t):
    return dom.nearest_ancestor(t["dom_nodes"].select("screenName", "tagPath"), dom.candidates(node_table(t)))


@query("dom02_semantic_text", with_sql(["dom_nodes"], "SELECT screenName, tagPath, coalesce(nullif(ariaLabel, ''), nullif(textContent, '')) AS semanticText, CASE WHEN nullif(ariaLabel, '') IS NOT NULL THEN 'aria-label' WHEN nullif(textContent, '') IS NOT NULL THEN 'text' END AS semanticSource FROM dom_nodes WHERE nodeType = 'operation'"))
def _(t):
    return dom.semantic(node_table(t).where("nodeType = 'operation'")).select("screenName", "tagPath", "semanticText", "semanticSource")


@query("dom07_path_hash", f"SELECT page_id, {HASH.format('url')} AS id FROM pages")
def _(t):
    return t["pages"].select("page_id", poly31(F.col("url")).alias("id"))


@query("flt08_scope_filter", with_sql(["dom_nodes"], f"{SCOPES} SELECT screenName, tagPath FROM cand"))
def _(t):
    return dom.candidates(node_table(t)).select("screenName", "tagPath")


@query("src08_html_scan", "SELECT regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS screenName, length(html) AS n FROM pages")
def _(t):
    return t["pages"].select(staging.screen_file_name(F.col("url")).alias("screenName"), F.length("html").cast("bigint").alias("n"))


@query("src17_screen_names", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS fileName FROM pages")
def _(t):
    return t["pages"].select("page_id", staging.screen_file_name(F.col("url")).alias("fileName"))


_FILES = "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'app/(shop)/item/[id].tsx' WHEN page_id % 4 = 1 THEN 'app/docs/[...rest].tsx' WHEN page_id % 4 = 2 THEN 'index.tsx' ELSE 'p' || page_id || '/page.tsx' END AS f FROM pages"


@query("src13_file_routes", f"SELECT page_id, CASE WHEN f LIKE 'app/(%' THEN '/app/item/:id' WHEN f LIKE '%rest%' THEN '/app/docs/:rest*' WHEN f = 'index.tsx' THEN '/' ELSE '/p' || page_id END AS route FROM ({_FILES})")
def _(t):
    n = F.col("page_id")
    f = F.when(n % 4 == 0, "app/(shop)/item/[id].tsx").when(n % 4 == 1, "app/docs/[...rest].tsx").when(n % 4 == 2, "index.tsx").otherwise(F.concat(F.lit("p"), n.cast("string"), F.lit("/page.tsx")))
    return t["pages"].select("page_id", code.file_route(f).alias("route"))


# --- UI elements ------------------------------------------------------------------------------------------------


@query("q22_labels", with_sql(["ui_elements"], "SELECT p_partkey, coalesce(nullif(ariaLabel, ''), nullif(labelProp, ''), nullif(placeholder, ''), nullif(title, '')) AS labelText, labelText IS NULL AND (ariaLabelledBy IS NOT NULL OR htmlFor IS NOT NULL) AS labelUnresolved FROM ui_elements"))
def _(t):
    return ui.labels(t["ui_elements"]).select("p_partkey", "labelText", "labelUnresolved")


@query("q23_scope_groups", with_sql(["ui_elements"], """keyed AS (SELECT p_partkey, componentName, coalesce('form__' || formId, parentScopeTag || '__' || coalesce(parentScopeClass, '')) AS k FROM ui_elements),
  sized AS (SELECT *, count(*) OVER (PARTITION BY componentName, k) AS siblingCount FROM keyed) SELECT p_partkey, siblingCount, if(siblingCount >= 2, substr(md5(componentName || '__' || k), 1, 8), NULL) AS scopeGroupId FROM sized"""))
def _(t):
    return ui.scopes(t["ui_elements"]).select("p_partkey", "siblingCount", "scopeGroupId")


@query("q24_interactions", with_sql(["ui_elements"], """SELECT p_partkey, CASE WHEN tag = 'TextField' THEN 'text_input' WHEN tag = 'input' THEN CASE typeAttr WHEN 'checkbox' THEN 'binary_input' WHEN 'Radio' THEN 'binary_input' WHEN 'file' THEN 'file_input' WHEN 'submit' THEN 'navigation_trigger' ELSE 'text_input' END
  WHEN tag = 'select' THEN 'selection_input' WHEN tag = 'button' THEN 'navigation_trigger' WHEN tag = 'a' THEN if(href IS NULL, 'pseudo_trigger', 'navigation_trigger') WHEN roleAttr = 'button' THEN 'pseudo_trigger' ELSE 'unknown' END AS interactionType,
  CASE WHEN tag = 'TextField' THEN 'text_input' WHEN tag = 'input' THEN CASE typeAttr WHEN 'checkbox' THEN 'input_checkbox' WHEN 'Radio' THEN 'input_radio' WHEN 'file' THEN if(isMultiple, 'input_file_multiple', 'input_file_single') WHEN 'submit' THEN 'button_submit' ELSE 'text_input' END
  WHEN tag = 'select' THEN if(isMultiple, 'select_multiple', 'select_single') WHEN tag = 'button' THEN if(typeAttr = 'submit', 'button_submit', 'button_normal') WHEN tag = 'a' THEN if(href IS NULL, 'pseudo_trigger', 'anchor_link') WHEN roleAttr = 'button' THEN 'div_button' ELSE 'unknown' END AS mirrorAxisX
  FROM ui_elements"""))
def _(t):
    return ui.interactions(t["ui_elements"]).select("p_partkey", "interactionType", "mirrorAxisX")


@query("snk08_elements_csv", """SELECT 'P' || p_partkey AS screenName, tag, line AS lineNumber, if(tag = 'input', p_name, '') AS labelText, 'false' AS labelUnresolved, '3' AS siblingCount, substr(md5('P' || p_partkey || '__form__main'), 1, 8) AS scopeGroupId, kind AS interactionType
  FROM part, (VALUES ('input', '2', 'binary_input'), ('a', '3', 'navigation_trigger'), ('button', '4', 'navigation_trigger')) AS e(tag, line, kind)""")
def _(t):
    rows = ui.element_rows(ui.resolved(code.jsx_elements(tsx_files(t))))
    return staging.by_header(t.spark, staging.written(rows, new_path(t.spark))).select("screenName", "tag", "lineNumber", "labelText", "labelUnresolved", "siblingCount", "scopeGroupId", "interactionType")


@query("snk08_elements_json", """SELECT 'P' || p_partkey AS screenName, 'shop' AS app, 3::BIGINT AS n, 'P' || p_partkey || '.tsx' AS file, p_name AS label, 'anchor_link' AS axis FROM part""")
def _(t):
    rows = ui.screens_json(ui.resolved(code.jsx_elements(tsx_files(t))), "shop")
    get = lambda path: F.expr(f"get_json_object(json, concat('$.screens.', screenName, '{path}'))")
    return rows.select(
        "screenName", F.get_json_object("json", "$.appName").alias("app"), F.json_array_length(get("")).cast("bigint").alias("n"), get("[0].filePath").alias("file"), get("[0].labelText").alias("label"), get("[1].mirrorAxisX").alias("axis")
    )


@query("snk08_elements_markdown", """SELECT 'P' || p_partkey AS screenName, '## P' || p_partkey || chr(10) || chr(10) || '| lineNumber | tag | labelText | interactionType | mirrorAxisX |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10)
  || '| 2 | input | ' || p_name || ' | binary_input | input_checkbox |' || chr(10) || '| 3 | a | - | navigation_trigger | anchor_link |' || chr(10) || '| 4 | button | - | navigation_trigger | button_normal |' || chr(10) AS markdown FROM part""")
def _(t):
    return ui.screens_markdown(ui.resolved(code.jsx_elements(tsx_files(t))))


@query("fun_md5_prefix", "SELECT s_suppkey, substr(md5(s_name), 1, 8) AS id FROM supplier")
def _(t):
    return t["supplier"].select("s_suppkey", md5_prefix(F.col("s_name")).alias("id"))


# --- values -----------------------------------------------------------------------------------------------------

_LOW, _HIGH = "CASE WHEN validationMin IN ('-1', '-', '') THEN NULL ELSE validationMin::BIGINT END", "CASE WHEN validationMax IN ('-1', '-', '') THEN NULL ELSE validationMax::BIGINT END"
VALUES = f"""bounded AS (SELECT *, {_LOW} AS lo, {_HIGH} AS hi, regexp_extract(mirrorY, '^[^:]*:(.*)$', 1) AS y, regexp_extract(mirrorZ, '^[^:]*:(.*)$', 1) AS z,
  CASE convModel WHEN 'STRING' THEN 'test' WHEN 'NUMBER' THEN '1' WHEN 'DECIMAL' THEN '1.0' WHEN 'ENUM' THEN 'X' END AS usual FROM instruction_rows WHERE convModel <> 'COLLECTION'),
limited AS (SELECT *, CASE y WHEN 'length_min' THEN lo WHEN 'length_min_minus_1' THEN lo - 1 WHEN 'length_max' THEN hi WHEN 'length_max_plus_1' THEN hi + 1 END AS lim,
  (mirrorX <> '-')::INT + (mirrorY <> '-')::INT + (mirrorZ <> '-')::INT AS axes FROM bounded),
judged AS (SELECT *, CASE WHEN dataRole = 'FIXED' THEN 'VALUE' WHEN axes > 1 THEN 'UNSUPPORTED' WHEN mirrorX <> '-' THEN 'VALUE'
    WHEN y = 'length_null' THEN 'NULL' WHEN y = 'length_empty' OR z = 'empty' THEN 'EMPTY' WHEN y = 'length_normal_mid' THEN 'VALUE'
    WHEN y <> '' THEN if(convModel = 'ENUM' OR lim IS NULL OR (convModel = 'STRING' AND lim < 0), 'UNSUPPORTED', 'VALUE')
    WHEN z = 'out_of_range' AND lo IS NULL AND hi IS NULL THEN 'UNSUPPORTED' ELSE 'VALUE' END AS valueState,
  CASE WHEN dataRole = 'FIXED' THEN fixedValue WHEN mirrorX <> '-' THEN 'AbC123' WHEN z = 'sql' THEN ''' OR ''1''=''1' WHEN z = 'html/script' THEN '<script>alert(1)</script>' WHEN z = 'out_of_range' THEN coalesce(hi + 1, lo - 1)::VARCHAR
    WHEN y = 'length_normal_mid' THEN CASE WHEN lo IS NULL AND hi IS NULL OR convModel = 'ENUM' THEN usual WHEN convModel = 'STRING' THEN repeat('A', CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo + greatest(hi - lo, 0) // 2 WHEN lo IS NOT NULL THEN greatest(lo, 1) ELSE greatest(0, hi // 2) END)
      WHEN lo IS NOT NULL AND hi IS NOT NULL THEN CASE WHEN (lo + hi) % 2 = 0 THEN ((lo + hi) // 2)::VARCHAR ELSE ((lo + hi) // 2)::VARCHAR || '.5' END ELSE coalesce(lo, hi)::VARCHAR END
    WHEN y <> '' AND convModel = 'STRING' THEN repeat('A', lim) WHEN y <> '' THEN lim::VARCHAR ELSE usual END AS v FROM limited),
valued AS (SELECT CaseNo, dataId, valueState, CASE valueState WHEN 'VALUE' THEN v WHEN 'EMPTY' THEN '' END AS actualValue FROM judged)"""


@query("gen02_values", with_sql(["instruction_rows"], f"{VALUES} SELECT CaseNo, dataId, 0::BIGINT AS elementIndex, valueState, actualValue, CASE valueState WHEN 'VALUE' THEN length(actualValue) WHEN 'EMPTY' THEN 0 ELSE -1 END AS actualLength FROM valued"))
def _(t):
    return generate.scalars(t["instruction_rows"]).select("CaseNo", "dataId", "elementIndex", "valueState", "actualValue", "actualLength")


@query("gen01_rule_ids", with_sql(["instruction_rows"], "SELECT CaseNo, CASE WHEN mirrorY <> '-' THEN regexp_extract(mirrorY, '^[^:]*:(.*)$', 1) END AS rule FROM instruction_rows"))
def _(t):
    return t["instruction_rows"].select("CaseNo", generate.rule_id(F.col("mirrorY")).alias("rule"))


@query("gen04_boundaries", with_sql(["instruction_rows"], f"{VALUES} SELECT y AS rule, convModel, valueState, count(*) AS n FROM judged WHERE mirrorY <> '-' GROUP BY ALL"))
def _(t):
    rows = generate.scalars(t["instruction_rows"]).where("mirrorY <> '-'")
    return rows.groupBy(generate.rule_id(F.col("mirrorY")).alias("rule"), "convModel", "valueState").agg(F.count("*").alias("n"))


@query("gen13_states", with_sql(["instruction_rows"], f"{VALUES} SELECT valueState, count(*) AS n FROM valued GROUP BY ALL"))
def _(t):
    return generate.scalars(t["instruction_rows"]).groupBy("valueState").agg(F.count("*").alias("n"))


SIZES = """sized AS (SELECT *, CASE mirrorY WHEN '2:length_empty' THEN 0 WHEN '3:length_min' THEN nullif(validationMin, '-1')::INT WHEN '6:length_max_plus_1' THEN nullif(validationMax, '-1')::INT + 1
  ELSE least(greatest(3, coalesce(nullif(validationMin, '-1')::INT, 3)), coalesce(nullif(validationMax, '-1')::INT, 99)) END AS size FROM container_rows WHERE convModel IN ('COLLECTION', 'ARRAY', 'MAP'))"""


@query("gen07_container_sizes", with_sql(["container_rows"], f"{SIZES} SELECT CaseNo, dataId, convModel, mirrorY, size, CASE WHEN size IS NULL THEN 'UNSUPPORTED' WHEN size = 0 THEN 'EMPTY' ELSE 'VALUE' END AS valueState FROM sized"))
def _(t):
    return generate.containers(t["container_rows"])


@query("gen08_elements", with_sql(["container_rows"], f"""{SIZES}, item AS (SELECT CaseNo, convModel, unnest(range(size)) AS i FROM sized WHERE size > 0)
  SELECT CaseNo, 'a1[]' AS dataId, i AS elementIndex, 'VALUE' AS valueState, CASE WHEN convModel = 'ARRAY' THEN (1 + i)::VARCHAR ELSE 'test' END AS actualValue, CASE WHEN convModel = 'ARRAY' THEN length((1 + i)::VARCHAR) ELSE 4 END AS actualLength FROM item WHERE convModel <> 'MAP'
  UNION ALL SELECT CaseNo, 'a1{{key}}', i, 'VALUE', CASE WHEN i = 0 THEN 'test' ELSE 'test_' || i END, CASE WHEN i = 0 THEN 4 ELSE 6 END FROM item WHERE convModel = 'MAP'
  UNION ALL SELECT CaseNo, 'a1{{value}}', i, 'VALUE', '2000-01-01', 10 FROM item WHERE convModel = 'MAP'"""))
def _(t):
    return generate.elements(t["container_rows"])


@query("gen09_occurrence", "SELECT l_orderkey AS CaseNo, l_linenumber AS dataId, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) - 1 AS elementIndex FROM lineitem")
def _(t):
    rows = t["lineitem"].select(F.col("l_orderkey").alias("CaseNo"), F.col("l_linenumber").alias("dataId"), "l_partkey", "l_suppkey", "l_extendedprice")
    return generate.occurrence(rows, "l_partkey", "l_suppkey", "l_extendedprice").drop("l_extendedprice")


@query("gen10_replay", "SELECT o_orderkey AS CaseNo, 1 AS dataId, 0::BIGINT AS elementIndex, if(l.k IS NULL, 'MISSING', 'VALUE') AS valueState, l.v AS actualValue FROM orders LEFT JOIN (SELECT l_orderkey AS k, min(l_quantity)::BIGINT::VARCHAR AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) l ON k = o_orderkey")
def _(t):
    wanted = t["orders"].select(F.col("o_orderkey").alias("CaseNo"), F.lit(1).alias("dataId"), F.lit(0).cast("bigint").alias("elementIndex"))
    e = t["lineitem"].where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("CaseNo")).agg(F.min("l_quantity").cast("bigint").cast("string").alias("actualValue"))
    e = e.select("CaseNo", F.lit(1).alias("dataId"), F.lit(0).cast("bigint").alias("elementIndex"), F.lit("VALUE").alias("valueState"), "actualValue", F.length("actualValue").alias("actualLength"))
    return generate.replay(wanted, e).drop("actualLength")


@query("gen11_conversion", "SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN l_quantity < 10 ELSE true END AS fits FROM lineitem")
def _(t):
    value = F.when(F.col("l_quantity") < 10, F.col("l_quantity").cast("bigint").cast("string")).otherwise("many")
    kind = F.when(F.col("l_linestatus") == "O", "java.lang.Integer").otherwise("String")
    return t["lineitem"].select("l_orderkey", "l_linenumber", generate.convertible(kind, value).alias("fits"))


@query("gen12_container_build", with_sql(["container_rows"], f"""{SIZES}, item AS (SELECT CaseNo, dataId, convModel, unnest(range(size)) AS i FROM sized WHERE size > 0),
  shown AS (SELECT CaseNo, dataId, string_agg(CASE convModel WHEN 'MAP' THEN if(i = 0, 'test', 'test_' || i) || '=2000-01-01' WHEN 'ARRAY' THEN (1 + i)::VARCHAR ELSE 'test' END, ', ' ORDER BY i) AS txt FROM item GROUP BY ALL)
  SELECT CaseNo, dataId, convModel, size, if(convModel = 'MAP', '{{', '[') || coalesce(txt, '') || if(convModel = 'MAP', '}}', ']') AS text FROM sized LEFT JOIN shown USING (CaseNo, dataId) WHERE size IS NOT NULL"""))
def _(t):
    return generate.built(t["container_rows"])


# --- wide source rows -------------------------------------------------------------------------------------------

_WIDE = "long AS (SELECT filePath, className, methodName, processContent, process1, process3, unnest([1, 2, 3]) AS i, unnest([arg1, arg2, arg3]) AS item FROM wide_methods)"


@query("tre02_arguments", with_sql(["wide_methods"], f"""{_WIDE} SELECT filePath, className, methodName, process1, i::BIGINT AS argIndex, regexp_extract(item, '(\\w+)$', 1) AS argName, item AS argRaw,
  regexp_replace(regexp_replace(item, '^final ', ''), ' \\w+$', '') AS rawType FROM long WHERE processContent = '引数' AND item NOT IN ('', '-')"""))
def _(t):
    return trees.unpivot_arguments(t["wide_methods"])


@query("tre03_enums", with_sql(["wide_methods"], f"{_WIDE} SELECT filePath, className AS enumName, (process3 * 20 + i)::BIGINT AS enumIndex, item AS enumValue, 'ENUM' AS convModel FROM long WHERE processContent = 'enum' AND item NOT IN ('', '-')"))
def _(t):
    return trees.unpivot_enums(t["wide_methods"])


@query("tre04_imports", "SELECT row_number() OVER (ORDER BY dir, f, x, app) AS n, app AS appName, f AS fileName, dir AS directoryPath, x AS importList FROM (SELECT 'app' AS app, 'N' || s_nationkey AS f, 'd/' AS dir, unnest(['a.' || replace(s_name, '#', ''), 'b.B']) AS x FROM supplier)")
def _(t):
    s = t["supplier"].select(
        F.lit("app").alias("appName"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("fileName"), F.lit("d/").alias("directoryPath"),
        F.concat(F.lit("import a."), F.regexp_replace("s_name", "#", ""), F.lit("; / import b.B;")).alias("importList"),
    )
    return trees.explode_imports(s)


@query("tre05_dto_fields", with_sql(["field_data", "dto_data"], "SELECT className, fieldName, rawType FROM field_data WHERE className IN (SELECT dtoName FROM dto_data)"))
def _(t):
    known = t["dto_data"].select(F.col("dtoName").alias("className"))
    return trees.known_dto_fields(known, t["field_data"].withColumn("fieldKind", F.lit("field"))).select("className", "fieldName", "rawType")


@query("tre06_first_returns", with_sql(["wide_methods"], "SELECT filePath, className, methodName, process1, arg_min(returnType, methodName) AS rawType FROM wide_methods WHERE processContent = '引数' GROUP BY ALL"))
def _(t):
    return trees.first_returns(t["wide_methods"], "methodName")


@query("tre07_fields", with_sql(["field_data"], "SELECT n, filePath, className, fieldName, rawType, convModel, CASE WHEN objectRootId > 0 THEN objectRootId ELSE -1 END AS objectRootId FROM field_data"))
def _(t):
    return t["field_data"].select("n", "filePath", "className", "fieldName", "rawType", "convModel", F.when(F.col("objectRootId") > 0, F.col("objectRootId")).otherwise(-1).alias("objectRootId"))


@query("tre01_type_trees", with_sql(["args_data"], "SELECT n, CASE WHEN rawType LIKE '%MIDDLE EAST%' THEN 'OBJECT' WHEN rawType LIKE 'List%' THEN 'COLLECTION' WHEN rawType LIKE 'Map%' THEN 'MAP' WHEN rawType = 'int' THEN 'NUMBER' WHEN rawType = 'String' THEN 'STRING' ELSE 'OBJECT' END AS convModel, CASE WHEN rawType LIKE '%MIDDLE EAST%' THEN 0 WHEN rawType LIKE 'List%' THEN 2 WHEN rawType LIKE 'Map%' THEN 3 WHEN rawType IN ('int', 'String') THEN 0 ELSE 1 END::BIGINT AS nodes FROM args_data"))
def _(t):
    models = {"int": "NUMBER", "String": "STRING", "List": "COLLECTION", "Map": "MAP"}
    rows = trees.with_type_tree(t["args_data"].select("n", "rawType"), "rawType", models)
    return rows.select("n", "convModel", F.size("typeTree").cast("bigint").alias("nodes"))


@query("tre09_bounds", with_sql(["args_data"], "SELECT n, -1::BIGINT AS low, CASE WHEN rawAnnotations = '-' THEN -1 ELSE regexp_extract(rawAnnotations, 'max=(\\d+)', 1)::BIGINT END AS high, -1::BIGINT AS nullable FROM args_data"))
def _(t):
    return t["args_data"].select("n", trees.bounds_of(F.col("rawAnnotations")).alias("b")).select("n", F.col("b.validationMin").alias("low"), F.col("b.validationMax").alias("high"), "b.nullable")


@query("tre10_enum_pages", "WITH k AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS v FROM orders GROUP BY ALL) SELECT o_custkey::VARCHAR AS className, p AS page, len(v[p * 20 + 1 : p * 20 + 20]) AS n FROM (SELECT *, unnest(range((len(v) - 1) // 20 + 1)) AS p FROM k)")
def _(t):
    k = t["orders"].groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("values"))
    pages = trees.enum_pages(k.select(F.lit("f").alias("filePath"), F.col("o_custkey").cast("string").alias("className"), "values"))
    return pages.select("className", "page", F.size("items").cast("bigint").alias("n"))


# --- staged files: written and read again -----------------------------------------------------------------------


@query("src01_staged_csv", "SELECT n_nationkey::VARCHAR AS a, n_name AS b, n_regionkey::VARCHAR AS c FROM nation")
def _(t):
    path = staging.written(t["nation"], new_path(t.spark))
    return staging.staged(t.spark, path, ["a", "b", "c"])


@query("src03_csv_by_header", "SELECT p_partkey::VARCHAR AS p_partkey, p_name || ', \"' || p_brand || '\"' AS label FROM part")
def _(t):
    label = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    return staging.by_header(t.spark, staging.written(t["part"].select("p_partkey", label.alias("label")), new_path(t.spark)))


@query("src04_strict_csv", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def _(t):
    return staging.by_header(t.spark, staging.written(t["supplier"].select("s_suppkey", "s_name"), new_path(t.spark)), strict=True)


@query("src05_instructions", with_sql(["instruction_rows"], "SELECT CaseNo, dataId, len(string_split(nullif(referenceValues, ''), ' / ')) AS k, n FROM (SELECT *, count(*) OVER (PARTITION BY CaseNo, dataId) AS n FROM instruction_rows) WHERE n > 1"))
def _(t):
    rows, twice = staging.instructions(t["instruction_rows"])
    out = rows.join(twice, ["CaseNo", "dataId"])
    return out.select("CaseNo", "dataId", F.nullif(F.size("referenceValues"), F.lit(0)).cast("bigint").alias("k"), "n")


@query("src06_evidence", "SELECT l_orderkey::VARCHAR AS CaseNo, l_partkey::VARCHAR AS dataId, l_linenumber::BIGINT AS elementIndex, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(t):
    have = {"CaseNo": "l_orderkey", "dataId": "l_partkey", "elementIndex": "l_linenumber"}
    rows = t["lineitem"].select(*(F.col(have[c]).cast("string").alias(c) if c in have else F.lit("-").alias(c) for c in staging.EVIDENCE_COLUMNS))
    return staging.evidence(rows)[1]


@query("src07_dom_csv", with_sql(["dom_nodes"], "SELECT screenName, ord::DOUBLE AS ord, tagPath, nullif(trim(textContent), '') AS textContent, nullif(trim(ariaLabel), '') AS ariaLabel, directOperationTagCount::DOUBLE AS directOperationTagCount, 0.0::DOUBLE AS lost FROM dom_nodes"))
def _(t):
    raw = t["dom_nodes"].withColumn("textContent", F.concat(F.lit(" "), F.coalesce("textContent", F.lit("")))).withColumn("lost", F.lit("none"))
    rows = staging.by_header(t.spark, staging.written(raw, new_path(t.spark)))
    texts, numbers = ("textContent", "ariaLabel"), ("ord", "directOperationTagCount", "lost")
    return rows.select("screenName", "tagPath", *(staging.blank_to_null(F.col(c)).alias(c) for c in texts), *(staging.finite_or_zero(F.col(c)).alias(c) for c in numbers))


@query("src02_constrained_load", with_sql(["test_spec"], """SELECT count(DISTINCT CaseNo) AS accepted, (SELECT count(*) FROM test_spec) - accepted AS rejected FROM test_spec WHERE generatorTarget = targetId AND "確認手順" IS NOT NULL """))
def _(t):
    spec = t["test_spec"]
    rows = staging.judged(spec, ["CaseNo"], {"generatorTarget": F.col("generatorTarget") == F.col("targetId")}, required=["CaseNo", "targetId", "確認手順"])
    return rows.agg(F.count_if(F.size("reasons") == 0).alias("accepted"), F.count_if(F.size("reasons") > 0).alias("rejected"))


@query("snk01_export", "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def _(t):
    return staging.by_header(t.spark, staging.written(t["region"], new_path(t.spark)))


@query("snk09_evidence_append", with_sql(["instruction_rows"], f"{VALUES} SELECT valueState, 'GENERATE' AS runMode, count(*) AS n FROM valued GROUP BY ALL"))
def _(t):
    arriving, path = new_path(t.spark), new_path(t.spark)
    t["instruction_rows"].write.parquet(arriving)
    rows = t.spark.readStream.schema(t["instruction_rows"].schema).parquet(arriving)
    for _ in range(2):  # started again, it finds nothing new and appends nothing twice
        evidence.append_evidence(rows, path, f"{path}-state").awaitTermination()
    return t.spark.read.parquet(path).groupBy("valueState", "runMode").agg(F.count("*").alias("n"))


# --- source scans: the bound methods, written as source text and scanned again ------------------------------------


def java_files(t: Tables):
    """A class for each className of args_data; (path, text)."""
    method = t["args_data"].groupBy("className", "methodName").agg(packed_agg(F.col("argRaw"), F.col("argIndex")).alias("args"))
    body = F.concat(F.lit("  /** { */ public void "), "methodName", F.lit("("), F.regexp_replace("args", " / ", ", "), F.lit(') { if (x) { y("}"); for (int i = 0; i < 3; i++) z(); } else { w(); } return; }\n'))
    head = F.concat(F.lit("package app;\nimport a.B;\n@Service public class "), "className", F.lit(" {\n  private final int size = 1;\n"))
    files = method.groupBy("className").agg(F.array_sort(F.collect_list(body)).alias("m")).select(
        F.concat(F.lit("src/"), "className", F.lit(".java")).alias("path"), F.concat(head, F.array_join("m", ""), F.lit("}\n")).alias("text")
    )
    return dealt(files, "path")  # few files, but long to scan


@query("src09_java_scan", with_sql(["args_data"], "SELECT filePath, className, methodName, argIndex, argName, rawType FROM args_data WHERE argIndex <= 20"))
def _(t):
    return trees.unpivot_arguments(code.method_rows(code.scan(java_files(t), "method"))).select("filePath", "className", "methodName", "argIndex", "argName", "rawType")


_STEPS = """('1', 'if (x)'), ('1.1', 'y("}")'), ('1.2', 'for (int i = 0; i < 3; i++)'), ('1.2.1', 'z()'), ('2', 'else'), ('2.1', 'w()'), ('3', 'return')"""


@query("tre08_control_flow", with_sql(["args_data"], f"SELECT className, methodName, place, processContent FROM (SELECT DISTINCT className, methodName FROM args_data), (VALUES {_STEPS}) AS s(place, processContent)"))
def _(t):
    rows = code.method_rows(code.scan(java_files(t), "method")).where(F.col("processContent") != trees.ARGUMENT_ROW)
    place = F.array_join(F.filter(F.array(*(F.col(f"process{i}") for i in range(2, 10))), lambda x: x != -1), ".")
    return rows.select("className", "methodName", place.alias("place"), "processContent")


@query("ag10_source_counts", with_sql(["args_data"], "SELECT className, count(DISTINCT methodName) AS methodCount, 0::BIGINT AS variableCount, 1::BIGINT AS constantCount, 'import a.B' AS importList FROM args_data GROUP BY ALL"))
def _(t):
    return code.source_rows(code.scan(java_files(t), "file")).select("className", "methodCount", "variableCount", "constantCount", "importList")


@query("src10_ts_scan", with_sql(["args_data"], "SELECT className, methodName, argName AS fieldName, rawType AS fieldType FROM args_data"))
def _(t):
    typed = F.concat("argName", F.lit(": "), "rawType")
    method = t["args_data"].groupBy("className", "methodName").agg(packed_agg(typed, F.col("argIndex")).alias("args"))
    files = method.select(
        F.concat("className", F.lit("_"), "methodName", F.lit(".ts")).alias("path"),
        F.concat(F.lit("export class "), "className", F.lit(" { "), "methodName", F.lit("("), F.regexp_replace("args", " / ", ", "), F.lit("): void { go(); } }")).alias("text"),
    )
    return code.field_rows(code.scan(files, "field")).where("fieldKind = 'parameter'").select("className", "methodName", "fieldName", "fieldType")


def _app(t: Tables):
    """One file with JSX routes, one with route objects, for the nations."""
    n = F.col("n_nationkey").cast("string")
    jsx = F.concat(F.lit('<Route path="/n'), n, F.lit('" element={<Nation'), n, F.lit(" />} />"))
    obj = F.concat(F.lit("{ path: 'o"), n, F.lit("', element: <Page"), n, F.lit(" /> }"))
    one = t["nation"].agg(F.array_join(F.array_sort(F.collect_list(jsx)), "\n").alias("a"), F.array_join(F.array_sort(F.collect_list(obj)), ", ").alias("b"))
    text = F.concat(F.lit("const r = createBrowserRouter([{ path: '/', element: <Home />, children: ["), "b", F.lit("] }]);"))
    return one.select(F.lit("App.tsx").alias("path"), F.col("a").alias("text")).unionByName(one.select(F.lit("router.tsx").alias("path"), text.alias("text")))


@query("src11_jsx_routes", "SELECT 'App.tsx' AS file, '/n' || n_nationkey AS route, 'Nation' || n_nationkey AS component FROM nation")
def _(t):
    return code.jsx_routes(_app(t))


@query("src12_object_routes", "SELECT 'router.tsx' AS file, '/o' || n_nationkey AS route, 'Page' || n_nationkey AS component FROM nation UNION ALL SELECT 'router.tsx', '/', 'Home'")
def _(t):
    return code.object_route_rows(_app(t))


@query("ag06_merged_routes", "SELECT '/n' || n_nationkey AS route, 0 AS strategy FROM nation UNION ALL SELECT '/o' || n_nationkey, 1 FROM nation UNION ALL SELECT '/', 1")
def _(t):
    return code.merged_routes(code.jsx_routes(_app(t)), code.object_route_rows(_app(t))).select("route", "strategy")


_EDGES = "('/n#', 'navigate'), ('__back__', 'navigate.back'), ('/u/', 'location.href'), ('/list', 'Link'), ('/help', 'window.open'), ('/t#', 'Link')"


@query("src14_transitions", f"SELECT 'src/N' || n_nationkey || '.tsx' AS sourceFile, if(p LIKE '%#', replace(p, '#', n_nationkey::VARCHAR), p) AS toPath, transitionType FROM nation, (VALUES {_EDGES}) AS e(p, transitionType)")
def _(t):
    n = F.col("n_nationkey").cast("string")
    text = F.concat(
        F.lit("function P() { navigate('/n"), n, F.lit("?a=1'); navigate(-1); navigate(x); navigate('relative'); other.navigate('/no'); window.location.href = `/u/${id}?q`; window.open(\"/help?x\", '_blank');"
        " return <div><Link className=\"l\" to=\"/list\">l</Link><Link to={`/t"), n, F.lit("`}>t</Link><NavLink to=\"/nav\">n</NavLink><Link to={target}>x</Link></div>; }"),
    )
    return code.transitions(t["nation"].select(F.concat(F.lit("src/N"), n, F.lit(".tsx")).alias("path"), text.alias("text")))


def tsx_files(t: Tables):
    """A component for each part, with an input, a link and buttons made in a loop."""
    text = F.concat(
        F.lit('const X = () => <form id="f1" className="main">\n<input type="checkbox" aria-label="'), "p_name", F.lit('" disabled={a > b} required maxLength={20} min="1" defaultValue={"d"} />\n<a href="/x" target="_blank">go</a>\n{rows.map(r => <button key={r} aria-expanded="true" hidden>b</button>)}\n</form>'),
    )
    part = dealt(t["part"].select("p_partkey", "p_name"), "p_partkey")  # short rows, but long to scan
    return part.select(F.concat(F.lit("src/P"), F.col("p_partkey").cast("string"), F.lit(".tsx")).alias("path"), text.alias("text"))


@query("src15_jsx_elements", """SELECT 'P' || p_partkey AS componentName, 'src/P' || p_partkey || '.tsx' AS filePath, 'input' AS tag, p_name AS ariaLabel, 'checkbox' AS typeAttr, NULL AS href, NULL AS target, 20.0::DOUBLE AS maxLength, 1.0::DOUBLE AS minValue, 'd' AS defaultValue, NULL AS ariaExpanded,
    true AS isRequired, false AS isDisabled, false AS isHidden, false AS isDynamic, 'form' AS parentScopeTag, 'main' AS parentScopeClass, 'f1' AS parentScopeId, 2::BIGINT AS lineNumber FROM part
  UNION ALL SELECT 'P' || p_partkey, 'src/P' || p_partkey || '.tsx', 'a', NULL, NULL, '/x', '_blank', NULL, NULL, NULL, NULL, false, false, false, false, 'form', 'main', 'f1', 3 FROM part
  UNION ALL SELECT 'P' || p_partkey, 'src/P' || p_partkey || '.tsx', 'button', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'true', false, false, true, true, 'form', 'main', 'f1', 4 FROM part""")
def _(t):
    return code.jsx_elements(tsx_files(t)).select(
        "componentName", "filePath", "tag", "ariaLabel", "typeAttr", "href", "target", "maxLength", "minValue", "defaultValue", "ariaExpanded", "isRequired", "isDisabled", "isHidden", "isDynamic",
        "parentScopeTag", "parentScopeClass", "parentScopeId", "lineNumber",
    )


@query("src16_component_files", "SELECT 'src/P' || s_suppkey || '.tsx' AS path FROM supplier WHERE s_nationkey > 5")
def _(t):
    text = F.when(F.col("s_nationkey") > 5, "function Page() { return <div/>; }").otherwise("export const x = 1;")
    files = t["supplier"].select(F.concat(F.lit("src/P"), F.col("s_suppkey").cast("string"), F.lit(".tsx")).alias("path"), text.alias("text"))
    return code.component_files(files).select("path")


# --- the remaining parts of the inventory, each by its own name -----------------------------------------------------


@query("ag11_dom_counters", with_sql(["dom_nodes"], "SELECT screenName, sum(directOperationTagCount)::BIGINT AS direct, sum(directGroupingChildCount)::BIGINT AS children FROM dom_nodes GROUP BY ALL"))
def _(t):
    return t["dom_nodes"].groupBy("screenName").agg(F.sum("directOperationTagCount").alias("direct"), F.sum("directGroupingChildCount").alias("children"))


@query("dml04_truncate_load", "SELECT r_regionkey, r_name FROM region")
def _(t):
    path = new_path(t.spark)
    t["region"].withColumn("r_name", F.lit("old")).write.parquet(path)
    t["region"].write.mode("overwrite").parquet(path)
    return t.spark.read.parquet(path)


@query("snk02_source_csv", with_sql(["args_data"], "SELECT n::VARCHAR AS n, argRaw, rawType FROM args_data"))
def _(t):
    return staging.by_header(t.spark, staging.written(t["args_data"].select("n", "argRaw", "rawType"), new_path(t.spark)))


@query("snk07_dom_csv", with_sql(["dom_nodes"], "SELECT screenName, tagPath, coalesce(classAttr, '') AS classAttr FROM dom_nodes"))
def _(t):
    return staging.by_header(t.spark, staging.written(t["dom_nodes"].select("screenName", "tagPath", "classAttr"), new_path(t.spark)))


@query("so05_by_depth", with_sql(["dom_nodes"], "SELECT screenName, tagPath, len(string_split(tagPath, '>')) AS depth FROM dom_nodes ORDER BY depth, screenName, tagPath"))
def _(t):
    return t["dom_nodes"].select("screenName", "tagPath", F.size(F.split("tagPath", ">")).cast("bigint").alias("depth")).orderBy("depth", "screenName", "tagPath")


@query("gen03_x_values", with_sql(["instruction_rows"], "SELECT CaseNo, 'AbC123' AS actualValue FROM instruction_rows WHERE mirrorX <> '-'"))
def _(t):
    return generate.prepared(t["instruction_rows"].where("mirrorX <> '-'")).withColumn("v", generate.x_value()).select("CaseNo", F.col("v.value").alias("actualValue"))


_LIMITED = VALUES.split("judged AS")[0].rstrip().rstrip(",")


@query("gen05_z_values", with_sql(["instruction_rows"], _LIMITED + " SELECT CaseNo, CASE z WHEN 'sql' THEN ''' OR ''1''=''1' WHEN 'html/script' THEN '<script>alert(1)</script>' WHEN 'empty' THEN '' ELSE coalesce(hi + 1, lo - 1)::VARCHAR END AS actualValue FROM limited WHERE mirrorZ <> '-'"))
def _(t):
    rows = t["instruction_rows"].where("mirrorZ <> '-' and convModel <> 'COLLECTION'")
    return generate.prepared(rows).withColumn("v", generate.z_value()).select("CaseNo", F.col("v.value").alias("actualValue"))


@query("gen06_normal_values", with_sql(["instruction_rows"], _LIMITED + " SELECT CaseNo, usual AS actualValue FROM limited"))
def _(t):
    rows = t["instruction_rows"].where("convModel <> 'COLLECTION'")
    return generate.prepared(rows).withColumn("v", F.col("__normal")).select("CaseNo", F.col("v.value").alias("actualValue"))
