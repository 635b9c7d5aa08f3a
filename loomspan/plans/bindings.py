"""The catalogue tables as projections of the driver's tables, in SQL that Spark and DuckDB both read.

Parts are arguments, brands and sizes are their methods, regions are DTOs and nations their fields,
event types are an enum, suppliers are imports, and every line item is one row of the test
specification (its line number chooses the Y rule; some values make it break rules).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.functions.storage import materialise
from loomspan.plans.targets import Catalogue

_ARG_TYPE = """CASE p_type WHEN 'ECONOMY' THEN 'int' WHEN 'STANDARD' THEN 'String' WHEN 'LARGE' THEN 'List<String>'
  WHEN 'PROMO' THEN 'Map<String, ' || r_name || '>' WHEN 'SMALL' THEN r_name ELSE 'Kind' END"""
_FIELD_TYPE = """CASE floor(n_nationkey / 5.0) WHEN 0 THEN 'int' WHEN 1 THEN 'String' WHEN 2 THEN 'List<String>' WHEN 3 THEN t.r_name ELSE 'Kind' END"""
_FIELDS = "nation JOIN region r ON n_regionkey = r.r_regionkey JOIN region t ON t.r_regionkey = (n_regionkey + 1) % 5"

#: Name to (tables it reads, SQL). Later ones may read earlier ones.
BINDINGS: dict[str, tuple[tuple[str, ...], str]] = {
    "args_data": (("part", "region"), f"""
SELECT n, filePath, className, methodName, process1, argIndex, 'a' || CAST(argIndex AS STRING) AS argName, rawType || ' a' || CAST(argIndex AS STRING) AS argRaw,
       rawType, convModel, validationMin, validationMax, nullable, rawAnnotations, objectRootId
FROM (SELECT CAST(p_partkey AS BIGINT) AS n, 'src/' || replace(p_brand, '#', '') || '.java' AS filePath, replace(p_brand, '#', '') AS className,
  'm' || CAST(p_size AS STRING) AS methodName, CAST(1 AS BIGINT) AS process1,
  CAST(row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS BIGINT) AS argIndex, {_ARG_TYPE} AS rawType,
  CASE p_type WHEN 'ECONOMY' THEN 'NUMBER' WHEN 'STANDARD' THEN 'STRING' WHEN 'LARGE' THEN 'COLLECTION' WHEN 'PROMO' THEN 'MAP' ELSE 'OBJECT' END AS convModel,
  CAST(CASE WHEN p_size < 20 THEN -1 ELSE floor(p_size / 10.0) END AS BIGINT) AS validationMin, CAST(CASE WHEN p_size < 10 OR p_size > 44 THEN -1 ELSE p_size END AS BIGINT) AS validationMax,
  CAST(p_partkey % 3 - 1 AS BIGINT) AS nullable, CASE WHEN p_size > 30 THEN '@Size(max=' || CAST(p_size AS STRING) || ')' ELSE '-' END AS rawAnnotations,
  CAST(CASE WHEN p_type IN ('LARGE', 'PROMO', 'SMALL') THEN (p_partkey + 1) * 10 ELSE -1 END AS BIGINT) AS objectRootId
  FROM {{part}} JOIN {{region}} ON r_regionkey = p_size % 5) a"""),
    "dto_data": (("nation", "region"), f"""
SELECT CAST(n_nationkey + 1 AS BIGINT) AS n, 'dto/' || r.r_name || '.java' AS filePath, r.r_name AS dtoName, lower(n_name) AS fieldName, {_FIELD_TYPE} AS rawType
FROM {_FIELDS.replace("nation JOIN region r", "{nation} JOIN {region} r").replace("JOIN region t", "JOIN {region} t")}"""),
    "field_data": (("nation", "region"), f"""
SELECT CAST(n_nationkey + 1 AS BIGINT) AS n, 'dto/' || r.r_name || '.java' AS filePath, r.r_name AS className, lower(n_name) AS fieldName, {_FIELD_TYPE} AS rawType,
  CASE floor(n_nationkey / 5.0) WHEN 0 THEN 'NUMBER' WHEN 1 THEN 'STRING' WHEN 2 THEN 'COLLECTION' ELSE 'OBJECT' END AS convModel, CAST(0 AS BIGINT) AS isFinal,
  CAST(CASE WHEN n_nationkey % 2 = 0 THEN -1 ELSE 1 END AS BIGINT) AS validationMin, CAST(CASE WHEN n_nationkey % 3 = 0 THEN -1 ELSE n_nationkey END AS BIGINT) AS validationMax,
  CAST(n_nationkey % 3 - 1 AS BIGINT) AS nullable, '-' AS rawAnnotations,
  CAST(CASE WHEN floor(n_nationkey / 5.0) IN (2, 3) THEN 100000000000 + (n_nationkey + 1) * 10 ELSE -1 END AS BIGINT) AS objectRootId
FROM {_FIELDS.replace("nation JOIN region r", "{nation} JOIN {region} r").replace("JOIN region t", "JOIN {region} t")}"""),
    "return_data": (("part", "orders"), """
SELECT CAST(min(p_partkey) + 1 AS BIGINT) AS n, 'src/' || replace(p_brand, '#', '') || '.java' AS filePath, replace(p_brand, '#', '') AS className,
  'm' || CAST(p_size AS STRING) AS methodName, CAST(1 AS BIGINT) AS process1, CASE WHEN p_size > 25 THEN 'List<String>' ELSE 'int' END AS rawType,
  CASE WHEN p_size > 25 THEN 'COLLECTION' ELSE 'NUMBER' END AS convModel, CAST(CASE WHEN p_size > 25 THEN 200000000000 + (min(p_partkey) + 1) * 10 ELSE -1 END AS BIGINT) AS objectRootId
FROM {part} GROUP BY p_brand, p_size HAVING count(*) > 1
UNION ALL SELECT CAST(900000000 + min(o_orderkey) AS BIGINT), 'src/Order.java', 'Order', 'get' || o_orderstatus || substr(o_orderpriority, 1, 1), CAST(1 AS BIGINT), 'int', 'NUMBER', CAST(-1 AS BIGINT)
FROM {orders} GROUP BY o_orderstatus, o_orderpriority"""),
    "object_data": (("args_data", "field_data", "return_data"), """
SELECT CAST(objectId AS BIGINT) AS objectId, CAST(parentObjectId AS BIGINT) AS parentObjectId, ownerKind, filePath, className, methodName, ownerName, CAST(ownerIndex AS BIGINT) AS ownerIndex,
  position, rawType, baseType, convModel, referenceType
FROM (
  SELECT o.root AS objectId, -1 AS parentObjectId, ownerKind, filePath, className, methodName, ownerName, ownerIndex, 'ROOT' AS position, rawType,
    CASE WHEN rawType LIKE 'List<%' THEN 'List' WHEN rawType LIKE 'Map<%' THEN 'Map' ELSE rawType END AS baseType,
    CASE WHEN rawType LIKE 'List<%' THEN 'COLLECTION' WHEN rawType LIKE 'Map<%' THEN 'MAP' ELSE 'OBJECT' END AS convModel,
    CASE WHEN rawType LIKE 'List<%' OR rawType LIKE 'Map<%' THEN '-' ELSE rawType END AS referenceType
  FROM (SELECT objectRootId AS root, 'ARG' AS ownerKind, filePath, className, methodName, argName AS ownerName, argIndex AS ownerIndex, rawType FROM {args_data} WHERE objectRootId > 0
    UNION ALL SELECT objectRootId, 'FIELD', filePath, className, '-', fieldName, -1, rawType FROM {field_data} WHERE objectRootId > 0
    UNION ALL SELECT objectRootId, 'RETURN', filePath, className, methodName, '-', -1, rawType FROM {return_data} WHERE objectRootId > 0) o
  UNION ALL
  SELECT root + 1, root, ownerKind, filePath, className, methodName, ownerName, ownerIndex, 'ELEMENT', inner_type, inner_type,
    CASE WHEN inner_type = 'String' THEN 'STRING' ELSE 'OBJECT' END, CASE WHEN inner_type = 'String' THEN '-' ELSE inner_type END
  FROM (SELECT objectRootId AS root, 'ARG' AS ownerKind, filePath, className, methodName, argName AS ownerName, argIndex AS ownerIndex, replace(substr(rawType, 6), '>', '') AS inner_type FROM {args_data} WHERE rawType LIKE 'List<%'
    UNION ALL SELECT objectRootId, 'FIELD', filePath, className, '-', fieldName, -1, replace(substr(rawType, 6), '>', '') FROM {field_data} WHERE rawType LIKE 'List<%'
    UNION ALL SELECT objectRootId, 'RETURN', filePath, className, methodName, '-', -1, 'String' FROM {return_data} WHERE objectRootId > 0) e
  UNION ALL SELECT objectRootId + 1, objectRootId, 'ARG', filePath, className, methodName, argName, argIndex, 'KEY', 'String', 'String', 'STRING', '-' FROM {args_data} WHERE rawType LIKE 'Map<%'
  UNION ALL SELECT objectRootId + 2, objectRootId, 'ARG', filePath, className, methodName, argName, argIndex, 'VALUE', replace(substr(rawType, 13), '>', ''), replace(substr(rawType, 13), '>', ''),
    'OBJECT', replace(substr(rawType, 13), '>', '') FROM {args_data} WHERE rawType LIKE 'Map<%') t"""),
    "enum_data": (("events",), """
SELECT CAST(row_number() OVER (ORDER BY event_type) AS BIGINT) AS n, 'src/Kind.java' AS filePath, 'Kind' AS enumName, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS enumIndex,
  upper(event_type) AS enumValue, 'STRING' AS convModel FROM (SELECT DISTINCT event_type FROM {events}) k"""),
    "importlist_data": (("supplier",), """
SELECT CAST(s_suppkey + 1 AS BIGINT) AS n, 'app' AS appName, 'Brand' || CAST(s_nationkey + 1 AS STRING) || '.java' AS fileName,
  CASE WHEN s_suppkey % 2 = 0 THEN 'src/' ELSE 'src' END AS directoryPath, 'import app.' || replace(s_name, '#', '') || ';' AS importList FROM {supplier}"""),
    "lang_data_models": ((), """
SELECT CAST(n AS BIGINT) AS n, language, data_model, 'memo' AS memo, conv_model, CAST(min_value AS BIGINT) AS min_value, CAST(max_value AS BIGINT) AS max_value
FROM (VALUES (1, 'Java', 'int', 'NUMBER', 1, 18), (2, 'java', 'String', 'STRING', 1, 255), (3, 'java', 'List', 'COLLECTION', 1, 255), (4, 'JAVA', 'Map', 'MAP', 1, 255),
  (5, 'typescript', 'number', 'NUMBER', 1, 18), (6, 'typescript', 'String', 'STRING', 2, 9)) AS m(n, language, data_model, conv_model, min_value, max_value)"""),
    "mirror_x_axis": ((), """
SELECT CAST(n AS BIGINT) AS n, root_id, branch_id, leaf_id, leaf_edge_id, x_id, x_name FROM (VALUES (1, 'text', 'Nothing', 'Nothing', 'Nothing', 'text', 'any text'),
  (2, 'text', 'wide', 'Nothing', 'Nothing', 'wide', 'wide text'), (10, 'text', 'narrow', 'digits', 'Nothing', 'narrow_digits', 'digits')) AS x(n, root_id, branch_id, leaf_id, leaf_edge_id, x_id, x_name)"""),
    "mirror_y_axis": ((), """
SELECT CAST(n AS BIGINT) AS n, y_id, domains_name, logic FROM (VALUES (1, 'length_null', 'null', 'len = 0 if nullable'), (2, 'length_empty', 'empty', 'len = 0 if not nullable'),
  (3, 'length_min', 'least', 'len = min'), (4, 'length_min_minus_1', 'below least', 'len = min - 1'), (5, 'length_max', 'most', 'len = max'), (6, 'length_max_plus_1', 'above most', 'len = max + 1'),
  (7, 'length_normal_mid', 'middle', 'min < len < max')) AS y(n, y_id, domains_name, logic)"""),
    "mirror_z_axis": ((), """
SELECT CAST(n AS BIGINT) AS n, category_id, group_id, z_type, z_name, z_id, variants FROM (VALUES (1, 'basic', 'Nothing', 'basic', 'basic types', 'Nothing', 'Nothing'),
  (2, 'technical', 'injection', 'injection', 'injection', 'sql', 'SQL'), (3, 'technical', 'injection', 'injection', 'injection', 'html/script', 'HTML'),
  (11, 'technical', 'values', 'values', 'null values', 'null', 'null')) AS z(n, category_id, group_id, z_type, z_name, z_id, variants)"""),
    "test_spec": (("lineitem", "args_data", "dto_data", "mirror_y_axis"), """
SELECT CaseNo, targetId, major AS `大分類`, 'unit' AS `中分類`, 'value' AS `小分類`, x AS `観点ID_X`, y AS `観点ID_Y`, z AS `観点ID_Z`, 'case' AS `ケース内容`, 'call' AS `操作手順`, 'value' AS `確認内容`,
  steps AS `確認手順`, 'as given' AS `想定結果`, 'equal' AS `想定結果判断基準・判断手順`, CASE WHEN l_quantity = 1 THEN 'elsewhere' ELSE targetId END AS generatorTarget,
  CASE WHEN l_tax = 0.05 THEN 'X=' || z || '|Y=' || y || '|Z=' || x || '?' ELSE 'X=' || x || '|Y=' || y || '|Z=' || z END AS generatorRule,
  '-' AS `予定日`, '-' AS `実施日`, '-' AS `実施者`, '-' AS `実施結果`, '-' AS `再実施要否`, '-' AS `再実施判断日`, '-' AS `再実施判断担当者`, '-' AS `再実施テスト仕様書ファイル名ないしファイルパス`, '-' AS `備考`
FROM (SELECT 'C' || lpad(CAST(l_orderkey AS STRING), 9, '0') || '-' || CAST(l_linenumber AS STRING) AS CaseNo, l_quantity, l_tax,
  a.filePath || '::' || a.className || '::' || a.methodName || '::1::' || CASE WHEN d.dtoName IS NULL THEN 'ARG' ELSE 'FIELD' END || '::' || CAST(a.argIndex AS STRING) || '::'
    || coalesce(d.dtoName, '-') || '::' || coalesce(d.fieldName, a.argName) || CASE WHEN l_quantity = 50 THEN '?' ELSE '' END AS targetId,
  CASE WHEN l_discount = 0 THEN ' ' ELSE 'function' END AS major, CASE WHEN l_discount = 0.1 AND l_returnflag = 'A' THEN NULL ELSE 'compare' END AS steps,
  CASE l_suppkey % 4 WHEN 0 THEN '-' WHEN 1 THEN '1:text' WHEN 2 THEN '10:narrow_digits' ELSE CASE WHEN l_tax = 0.08 THEN '4:unknown' ELSE '2:wide' END END AS x,
  CAST(yy.n AS STRING) || ':' || yy.y_id AS y, CASE l_suppkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '2:sql' ELSE '3:html/script' END AS z
  FROM {lineitem} JOIN {args_data} a ON a.n = l_partkey LEFT JOIN {dto_data} d ON d.dtoName = a.rawType AND (d.n - 1 - (d.n - 1) % 5) / 5 = l_suppkey % 5 JOIN {mirror_y_axis} yy ON yy.n = l_linenumber) s"""),
    "route_nodes": (("region", "nation"), """
SELECT path, path AS normalizedPath, componentName, 'jsx' AS sourceStrategy, false AS hasDynamicSegment, CAST(ord AS BIGINT) AS ord FROM (
  SELECT '/' AS path, 'Home' AS componentName, 0 AS ord UNION ALL SELECT '/r' || CAST(r_regionkey AS STRING), 'Region' || CAST(r_regionkey AS STRING), 1 + r_regionkey FROM {region}
  UNION ALL SELECT '/n' || CAST(n_nationkey AS STRING), 'Nation' || CAST(n_nationkey AS STRING), 100 + n_nationkey FROM {nation}) r"""),
    "route_edges": (("region", "nation", "supplier"), """
SELECT 'src/' || f || '.tsx' AS sourceFile, toPath, transitionType, CAST(ord AS BIGINT) AS ord FROM (
  SELECT 'Home' AS f, '/r' || CAST(r_regionkey AS STRING) AS toPath, 'link' AS transitionType, r_regionkey AS ord FROM {region}
  UNION ALL SELECT 'Region' || CAST(n_regionkey AS STRING), '/n' || CAST(n_nationkey AS STRING), 'link', 1000 + n_nationkey FROM {nation}
  UNION ALL SELECT 'Nation' || CAST(a.n_nationkey AS STRING), '/n' || CAST(b.n_nationkey AS STRING), 'navigate', 2000 + a.n_nationkey FROM {nation} a JOIN {nation} b ON b.n_nationkey = a.n_nationkey + 5
  UNION ALL SELECT 'Nation' || CAST(s_nationkey AS STRING), '/n' || CAST(s_nationkey AS STRING) || '/s' || CAST(s_suppkey AS STRING), 'navigate', 10000 + s_suppkey FROM {supplier}
  UNION ALL SELECT 'Region' || CAST(r_regionkey AS STRING), '__back__', 'navigate', 5000 + r_regionkey FROM {region}
  UNION ALL SELECT 'Header', '/n0', 'link', 6000 UNION ALL SELECT 'Header', '/', 'link', 6001 UNION ALL SELECT 'Nation24', '/', 'link', 6002 UNION ALL SELECT 'Footer', '/unknown', 'open', 6003) e"""),
    "dom_nodes": (("region", "nation"), """
SELECT screenName, CAST(ord AS BIGINT) AS ord, tagPath, tagName, classAttr, nodeType, CAST(g AS BIGINT) AS directGroupingChildCount, CAST(c AS BIGINT) AS containedOperationTagCount, CAST(d AS BIGINT) AS directOperationTagCount,
  txt AS textContent, lbl AS ariaLabel FROM (
  SELECT 's' || CAST(r_regionkey AS STRING) AS screenName, 0 AS ord, 'html' AS tagPath, 'html' AS tagName, CAST(NULL AS STRING) AS classAttr, 'grouping' AS nodeType, 1 AS g, 11 AS c, 0 AS d, CAST(NULL AS STRING) AS txt, CAST(NULL AS STRING) AS lbl FROM {region}
  UNION ALL SELECT 's' || CAST(r_regionkey AS STRING), 1, 'html>body', 'body', NULL, 'grouping', 2, 11, 1, NULL, NULL FROM {region}
  UNION ALL SELECT 's' || CAST(r_regionkey AS STRING), 2, 'html>body>ul', 'ul', NULL, 'grouping', 5, 10, 0, NULL, NULL FROM {region}
  UNION ALL SELECT 's' || CAST(n_regionkey AS STRING), 100 + n_nationkey, 'html>body>ul>li' || CASE WHEN n_nationkey > 19 THEN '.last' ELSE '' END, 'li', CASE WHEN n_nationkey > 19 THEN 'last' END, 'grouping', 0, 2, 2, NULL, NULL FROM {nation}
  UNION ALL SELECT 's' || CAST(n_regionkey AS STRING), 1000 + n_nationkey, 'html>body>ul>li' || CASE WHEN n_nationkey > 19 THEN '.last' ELSE '' END || '>button[0]', 'button', NULL, 'operation', 0, 0, 0, n_name, CASE WHEN n_nationkey > 9 THEN lower(n_name) END FROM {nation}
  UNION ALL SELECT 's' || CAST(r_regionkey AS STRING), 5000, 'html>body>div>a[0]', 'a', NULL, 'operation', 0, 0, 0, r_name, NULL FROM {region}
  UNION ALL SELECT 's' || CAST(r_regionkey AS STRING), 5001, 'input[0]', 'input', NULL, 'operation', 0, 0, 0, '', NULL FROM {region}) n"""),
    "instruction_rows": (("lineitem",), """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS CaseNo, 'a1' AS dataId, 't' AS targetId,
  CASE WHEN l_quantity = 7 THEN 'FIXED' WHEN l_returnflag = 'N' THEN 'NORMAL' ELSE 'TARGET' END AS dataRole,
  CASE l_linenumber % 5 WHEN 0 THEN 'STRING' WHEN 1 THEN 'NUMBER' WHEN 2 THEN 'DECIMAL' WHEN 3 THEN 'ENUM' ELSE 'COLLECTION' END AS convModel, CASE WHEN l_quantity = 9 THEN '3:hw_alphanum' ELSE '-' END AS mirrorX,
  CASE WHEN l_returnflag = 'R' THEN CASE l_suppkey % 7 WHEN 0 THEN '1:length_null' WHEN 1 THEN '2:length_empty' WHEN 2 THEN '3:length_min' WHEN 3 THEN '4:length_min_minus_1' WHEN 4 THEN '5:length_max'
    WHEN 5 THEN '6:length_max_plus_1' ELSE '7:length_normal_mid' END ELSE '-' END AS mirrorY,
  CASE WHEN l_returnflag = 'A' THEN CASE l_suppkey % 4 WHEN 0 THEN '2:sql' WHEN 1 THEN '66:html/script' WHEN 2 THEN '70:empty' ELSE '30:out_of_range' END ELSE '-' END AS mirrorZ,
  CASE WHEN l_discount = 0 THEN '-1' ELSE CAST(CAST(l_quantity AS BIGINT) % 5 AS STRING) END AS validationMin, CASE WHEN l_tax = 0 THEN '-' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS validationMax,
  '0' AS nullable, 'String' AS referenceType, CASE WHEN l_quantity = 7 THEN 'fixed' ELSE '' END AS fixedValue, CASE WHEN l_linenumber % 5 = 3 THEN 'X / Y / Z' ELSE '' END AS referenceValues FROM {lineitem}"""),
    "container_rows": (("orders",), """
SELECT CaseNo, dataId, 't' AS targetId, 'NORMAL' AS dataRole, convModel, '-' AS mirrorX, mirrorY, '-' AS mirrorZ, low AS validationMin, high AS validationMax, '0' AS nullable, referenceType, '' AS fixedValue, '' AS referenceValues FROM (
  SELECT CAST(o_orderkey AS STRING) AS CaseNo, 'a1' AS dataId, CASE o_orderstatus WHEN 'F' THEN 'COLLECTION' WHEN 'O' THEN 'ARRAY' ELSE 'MAP' END AS convModel, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '2:length_empty' WHEN '2' THEN '3:length_min'
    WHEN '3' THEN '6:length_max_plus_1' ELSE '-' END AS mirrorY, CASE WHEN o_totalprice > 100000 THEN '2' ELSE '-1' END AS low, CASE WHEN o_totalprice > 300000 THEN '4' ELSE '-1' END AS high, 'List<String>' AS referenceType FROM {orders}
  UNION ALL SELECT CAST(o_orderkey AS STRING), CASE o_orderstatus WHEN 'P' THEN 'a1{{key}}' ELSE 'a1[]' END, CASE o_orderstatus WHEN 'O' THEN 'NUMBER' ELSE 'STRING' END, '-', '-1', '-1', 'String' FROM {orders}
  UNION ALL SELECT CAST(o_orderkey AS STRING), 'a1{{value}}', 'DATE', '-', '-1', '-1', 'LocalDate' FROM {orders} WHERE o_orderstatus = 'P') c"""),
    "ui_elements": (("part",), """
SELECT 'C' || replace(p_brand, '#', '') AS componentName, CASE p_type WHEN 'ECONOMY' THEN 'input' WHEN 'STANDARD' THEN 'a' WHEN 'LARGE' THEN 'button' WHEN 'PROMO' THEN 'TextField' WHEN 'SMALL' THEN 'select' ELSE 'div' END AS tag,
  CASE p_size % 6 WHEN 0 THEN 'checkbox' WHEN 1 THEN 'file' WHEN 2 THEN 'submit' WHEN 3 THEN 'Radio' WHEN 4 THEN 'reset' END AS typeAttr, CASE WHEN p_size % 4 = 0 THEN 'button' END AS roleAttr, p_size % 5 = 0 AS isMultiple,
  CASE WHEN p_size % 3 = 0 THEN '/x' END AS href, CASE WHEN p_size % 7 = 0 THEN p_name END AS ariaLabel, CASE WHEN p_size % 7 = 1 THEN p_type END AS labelProp, CASE WHEN p_size % 7 = 2 THEN 'hint' END AS placeholder,
  CASE WHEN p_size % 7 = 3 THEN '' END AS title, CASE WHEN p_size % 7 = 4 THEN 'l1' END AS ariaLabelledBy, CASE WHEN p_size % 7 = 5 THEN 'l2' END AS htmlFor, CASE WHEN p_size % 8 = 0 THEN 'f' || CAST(p_size AS STRING) END AS formId,
  'div' AS parentScopeTag, CASE WHEN p_size % 2 = 0 THEN 'row' END AS parentScopeClass, p_partkey FROM {part}"""),
    "wide_methods": (("part",), f"""
SELECT 'src/' || replace(p_brand, '#', '') || '.java' AS filePath, replace(p_brand, '#', '') AS className, 'm' || CAST(p_partkey AS STRING) AS methodName, 1 AS process1, CASE WHEN p_type = 'PROMO' THEN p_size % 3 ELSE -1 END AS process3,
  CASE WHEN p_type = 'PROMO' THEN 'enum' WHEN p_type = 'SMALL' THEN 'if (x)' ELSE '引数' END AS processContent, CASE WHEN p_size > 25 THEN 'int' ELSE 'List<String>' END AS returnType,
  CASE WHEN p_type = 'PROMO' THEN 'RED' ELSE 'int a' || CAST(p_size AS STRING) END AS arg1, CASE WHEN p_size % 2 = 0 THEN '-' WHEN p_type = 'PROMO' THEN 'BLUE' ELSE 'Map<String, ' || p_type || '> m' END AS arg2,
  CASE WHEN p_size % 3 = 0 THEN '' WHEN p_type = 'PROMO' THEN 'GREEN' ELSE 'final String[] s' END AS arg3, {", ".join(f"'-' AS arg{i}" for i in range(4, 21))} FROM {{part}}"""),
}

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def needed(*names: str) -> list[str]:
    """The bindings behind the names, in an order in which each can be made."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        if name in BINDINGS and name not in wanted:
            wanted.add(name)
            for n in BINDINGS[name][0]:
                add(n)

    for name in names:
        add(name)
    return [n for n in BINDINGS if n in wanted]


class Tables:
    """The driver's tables of a folder, and the catalogue tables bound to them, each made once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made, self.kept = spark, sf_dir, {}, set()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in BINDINGS:
                inputs, sql = BINDINGS[name]
                self.made[name] = self.spark.sql(sql, **{i: self[i] for i in inputs})
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]

    def keep(self, *names: str) -> None:
        """Write these tables, in this order, as a query is to read them more than once."""
        for name in names:
            if name not in self.kept:
                self.made[name] = materialise(self[name])
                self.kept.add(name)

    def catalogue(self) -> Catalogue:
        return Catalogue(*(self[n] for n in ("args_data", "return_data", "dto_data", "field_data", "object_data", "enum_data", "importlist_data", "lang_data_models")))


def with_sql(names: tuple[str, ...] | list[str], body: str, recursive: bool = False) -> str:
    """DuckDB SQL: the bindings as CTEs, then the body, which begins with SELECT or with further CTEs (``name AS (...), ... SELECT``)."""
    ctes = []
    for name in needed(*names):
        inputs, sql = BINDINGS[name]
        ctes.append(f"{name} AS ({sql.format(**{i: i for i in inputs}).replace('`', chr(34)).strip()})")
    body = body.strip()
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes)
    if not ctes:
        return body if body.startswith("SELECT") else f"WITH {'RECURSIVE ' if recursive else ''}{body}"
    return f"{head}\n{body}" if body.startswith("SELECT") else f"{head},\n{body}"
