"""Test values from data instructions: rules on the axes X, Y and Z, normal values, containers and replay.

Everything is a column expression. What an instruction cannot give is a row with value_state UNSUPPORTED and a
reason; ``strict`` callers check for these (``failures``) instead of losing a job to one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.packed import unpack

# The text for each rule id of the X axis.
X_VALUES = {
    "fw_alphanum": "ＡＢＣ１２３",
    "fw_kanji_common": "日本語",
    "hw_alphanum": "AbC123",
    "hw_symbol": "!@#$%",
    "hw_integer": "123",
    "hw_datetime": "2000-01-01T00:00:00",
    "full_width": "Ａ",
    "half_width": "A",
}
# The text for each rule id of the Z axis.
Z_VALUES = {
    "half-width_only": "ABC123",
    "full-width_only": "ＡＢＣ１２３",
    "letters_only": "AbCd",
    "numbers_only": "1234",
    "symbols_only": "!@#$",
    "mixed_half-width_and_full-width": "AＢ1２",
    "alphanumeric_mix": "Ab12",
    "chaotic_mix": "AＢ1２!＠漢",
    "integer_positive": "1",
    "integer_negative": "-1",
    "integer_zero": "0",
    "decimal_positive": "1.5",
    "decimal_negative": "-1.5",
    "decimal_repeating": "0.3333333333333333",
    "zero-padding_enabled": "0001",
    "zero_padded": "0001",
    "zero-padding_disabled": "1",
    "not_zero_padded": "1",
    "sign_indication_plus_sign_included": "+1",
    "sign_indication_minus_sign_included": "-1",
    "exponential_notation": "1E3",
    "comma-separated": "1,000",
    "invalid_value": "__INVALID__",
    "leap_year": "2000-02-29",
    "with_time_zone": "2000-01-01T00:00:00+09:00",
    "without_time_zone": "2000-01-01T00:00:00",
    "unix_timestamp__seconds": "946684800",
    "unix_timestamp__milliseconds": "946684800000",
    "unix_timestamp__negative": "-1",
    "unix_timestamp__32_bit_boundary": "2147483647",
    "excel_serial__integer": "36526",
    "excel_serial__decimal": "36526.5",
    "excel_serial__negative": "-1",
    "excel_serial__feb_29_1900_bug": "60",
    "half-width@": "@",
    "full-width@": "＠",
    "invalid_domain": "invalid_domain",
    "with_hyphen": "123-4567",
    "without_hyphen": "1234567",
    "insufficient_length": "1",
    "outside_the_definition": "__OUTSIDE_DEFINITION__",
    "space": " ",
    "line_break_code_crlf": "\r\n",
    "line_break_code_lf": "\n",
    "tab": "\t",
    "control_character_null": "\0",
    "surrogate_pair": "😀",
    "environment-dependent_character": "①",
    "character_with_mapping_differences": "髙",
    "sql": "' OR '1'='1",
    "os_command": "echo mirror_test",
    "html/script": "<script>alert(1)</script>",
    "mathematical_formula": "1+1",
    "undefined": "__UNDEFINED__",
}
# The normal text for each model.
NORMAL = {
    "STRING": "test",
    "CHAR": "A",
    "NUMBER": "1",
    "DECIMAL": "1.0",
    "BOOLEAN": "true",
    "DATE": "2000-01-01",
    "DATETIME": "2000-01-01T00:00:00",
}
CONTAINERS = ("COLLECTION", "ARRAY", "MAP")
NORMAL_SIZE = 3


def rule_id(c: Column) -> Column:
    """The text after the first ':'; NULL if blank or '-'."""
    t = F.trim(c)
    return F.when(t.isin("", "-"), None).otherwise(F.nullif(F.regexp_extract(t, r"(?s)^(?:[^:]*:)?(.+)$", 1), F.lit("")))


def bound(c: Column) -> Column:
    """A bound as a decimal; NULL for blank, '-' and -1, which all mean none."""
    t = F.trim(c.cast("string"))
    return F.when(~t.isin("", "-", "-1"), t.try_cast("decimal(38,16)"))


def plain(c: Column) -> Column:
    """A decimal as text without exponent and without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(38,16)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _value(c: Column) -> Column:
    return F.struct(F.lit("VALUE").alias("state"), c.alias("value"), F.lit(None).cast("string").alias("reason"))


def _state(state: str, value: str | None = None, reason: str | None = None) -> Column:
    return F.struct(F.lit(state).alias("state"), F.lit(value).cast("string").alias("value"), F.lit(reason).cast("string").alias("reason"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def references() -> Column:
    return unpack(F.regexp_replace(F.coalesce("referenceValues", F.lit("")), r"\s+/\s+", " / "))


def prepared(instructions: DataFrame) -> DataFrame:
    """Adds what the value expressions share, each computed once a row: bounds, references, rule ids, the normal value."""
    out = instructions.withColumns(
        {
            "__low": bound(F.col("validationMin")), "__high": bound(F.col("validationMax")), "__refs": references(), "__x": rule_id(F.col("mirrorX")),
            "__y": rule_id(F.col("mirrorY")), "__z": rule_id(F.col("mirrorZ")), "__conv": F.upper("convModel"),
        }
    )
    return out.withColumn("__normal", normal_value())


def normal_value() -> Column:
    conv, refs = F.col("__conv"), F.col("__refs")
    return (
        F.when(conv.isin(*NORMAL), _value(_lookup(NORMAL, conv)))
        .when((conv == "ENUM") & (F.size(refs) > 0), _value(F.get(refs, F.lit(0))))
        .when((conv == "ENUM") & (F.coalesce("fixedValue", F.lit("")) != ""), _value(F.col("fixedValue")))
        .when(conv == "ENUM", _state("UNSUPPORTED", reason="enum without values"))
        .when(F.trim(conv).isin("", "-"), _state("NO_VALUE"))
        .otherwise(_state("UNSUPPORTED", reason="no normal value of the model"))
    )


def x_value() -> Column:
    found = _lookup(X_VALUES, F.col("__x"))
    return F.when(found.isNotNull(), _value(found)).otherwise(_state("UNSUPPORTED", reason="unknown X rule"))


def y_value() -> Column:
    """Boundary and middle values: text models by length, numeric models by value."""
    rule, conv, low, high = F.col("__y"), F.col("__conv"), F.col("__low"), F.col("__high")
    textual, numeric = conv.isin("STRING", "CHAR"), conv.isin("NUMBER", "DECIMAL")

    def of_length(n: Column) -> Column:
        n = F.floor(n).cast("int")
        return F.when(n < 0, _state("UNSUPPORTED", reason="negative length")).otherwise(_value(F.repeat(F.lit("A"), n)))

    def at(limit: Column, step: int) -> Column:
        return (
            F.when(limit.isNull() & (textual | numeric), _state("UNSUPPORTED", reason="bound needed")).when(textual, of_length(limit + step))
            .when(numeric, _value(plain(limit + step))).otherwise(_state("UNSUPPORTED", reason="no bounds of the model"))
        )

    both, one = low.isNotNull() & high.isNotNull(), F.coalesce(low, high)
    text_middle = (
        F.when(both, low + F.floor(F.greatest(high - low, F.lit(0)) / 2)).when(low.isNotNull(), F.greatest(low, F.lit(1))).otherwise(F.greatest(F.lit(0), F.floor(high / 2)))
    )
    number_middle = F.when(both, F.round((low + high) / 2, 16)).otherwise(one)
    middle = (
        F.when(one.isNotNull() & textual, of_length(text_middle)).when(one.isNotNull() & numeric, _value(plain(number_middle))).otherwise(F.col("__normal"))
    )
    return (
        F.when(rule == "length_null", _state("NULL")).when(rule == "length_empty", _state("EMPTY", ""))
        .when(rule == "length_min", at(low, 0)).when(rule == "length_min_minus_1", at(low, -1))
        .when(rule == "length_max", at(high, 0)).when(rule == "length_max_plus_1", at(high, 1))
        .when(rule == "length_normal_mid", middle).otherwise(_state("UNSUPPORTED", reason="unknown Y rule"))
    )


def z_value() -> Column:
    rule, refs, low, high = F.col("__z"), F.col("__refs"), F.col("__low"), F.col("__high")
    found = _lookup(Z_VALUES, rule)
    beyond = F.coalesce(plain(high + 1), plain(low - 1))
    return (
        F.when(rule.isin("valid_value", "within_valid_range"), F.col("__normal"))
        .when(rule.isin("db_null", "null"), _state("NULL")).when(rule == "empty", _state("EMPTY", ""))
        .when((rule == "out_of_range") & beyond.isNotNull(), _value(beyond)).when(rule == "out_of_range", _state("UNSUPPORTED", reason="bound needed"))
        .when((rule == "within_definition") & (F.size(refs) > 0), _value(F.get(refs, F.lit(0))))
        .when(rule == "within_definition", _state("UNSUPPORTED", reason="enum without values"))
        .when(found.isNotNull(), _value(found)).otherwise(_state("UNSUPPORTED", reason="unknown Z rule"))
    )


def _named(c: str) -> Column:
    return ~F.coalesce(F.trim(c), F.lit("")).isin("", "-")


def scalar() -> Column:
    """The value of a ``prepared`` instruction: fixed, by its one axis, or normal; more axes than one are unsupported."""
    axes = sum((_named(c).cast("int") for c in ("mirrorX", "mirrorY", "mirrorZ")), F.lit(0))
    return (
        F.when(F.col("dataRole") == "FIXED", _value(F.col("fixedValue"))).when(axes > 1, _state("UNSUPPORTED", reason="more than one axis"))
        .when(_named("mirrorX"), x_value()).when(_named("mirrorY"), y_value()).when(_named("mirrorZ"), z_value()).otherwise(F.col("__normal"))
    )


def container_size() -> Column:
    """Number of elements: -1 is a null container; NULL if the rule can't be met."""
    rule = rule_id(F.coalesce("mirrorY", F.lit("-")))
    low, high = bound(F.col("validationMin")).cast("int"), bound(F.col("validationMax")).cast("int")
    usual = F.lit(NORMAL_SIZE)
    usual = F.when(low.isNotNull() & (usual < low), low).otherwise(usual)
    usual = F.when(high.isNotNull() & (usual > high), high).otherwise(usual)
    size = (
        F.when(rule.isNull() | (rule == "length_normal_mid"), usual).when(rule == "length_null", -1).when(rule == "length_empty", 0)
        .when(rule == "length_min", low).when(rule == "length_min_minus_1", low - 1).when(rule == "length_max", high).when(rule == "length_max_plus_1", high + 1)
    )
    return F.when((size >= 0) | (rule == "length_null"), size)


def unique_sibling(conv: Column, value: Column, refs: Column, i: Column) -> Column:
    """The i-th of siblings that must differ (0: as it is); NULL if the model has no such value."""
    number = plain(value.try_cast("decimal(38,16)") + i)
    conv = F.upper(conv)
    return (
        F.when(i == 0, value).when(conv == "STRING", F.concat(value, F.lit("_"), i.cast("string"))).when(conv == "CHAR", F.chr(F.lit(65) + i))
        .when(conv.isin("NUMBER", "DECIMAL"), number).when(conv == "DATE", F.date_add(value.try_cast("date"), i.cast("int")).cast("string"))
        .when(conv == "DATETIME", F.date_format(value.try_cast("timestamp_ntz") + F.make_dt_interval(secs=i), "yyyy-MM-dd'T'HH:mm:ss"))
        .when(conv == "ENUM", F.get(refs, i.cast("int")))
    )


KEYS = ["CaseNo", "dataId"]


def scalars(instructions: DataFrame) -> DataFrame:
    """Instructions of scalar models with elementIndex 0, valueState, actualValue, actualLength and reason."""
    rows = prepared(instructions.where(~F.upper("convModel").isin(*CONTAINERS))).withColumn("v", scalar())
    return rows.select(
        *instructions.columns, F.lit(0).cast("bigint").alias("elementIndex"), F.col("v.state").alias("valueState"), F.col("v.value").alias("actualValue"),
        actual_length(F.col("v.state"), F.col("v.value")).alias("actualLength"), F.col("v.reason").alias("reason"),
    )


def actual_length(state: Column, value: Column) -> Column:
    """Code points of the value; -1 if there is none."""
    return F.when(state == "VALUE", F.length(value)).when(state == "EMPTY", 0).otherwise(-1).cast("bigint")


def elements(instructions: DataFrame) -> DataFrame:
    """A row for each element, key or value of the top containers: CaseNo, dataId (of the child), elementIndex, valueState, actualValue, actualLength.

    Keys of maps, and elements of sets, are made to differ by their index. The index counts the occurrences
    of a (CaseNo, dataId) from 0.
    """
    top = instructions.where(F.upper("convModel").isin(*CONTAINERS) & ~F.col("dataId").rlike(r"\[\]|\{")).withColumn("size", container_size()).where("size > 0")
    is_map = F.upper("convModel") == "MAP"
    unique = (F.upper("convModel") == "ARRAY") | F.col("referenceType").rlike(r"(^|\.)(Set|HashSet|LinkedHashSet|TreeSet|SortedSet)\b")
    ends = F.when(is_map, F.array(F.struct(F.lit("{key}").alias("end"), F.lit(True).alias("differ")), F.struct(F.lit("{value}").alias("end"), F.lit(False).alias("differ")))).otherwise(
        F.array(F.struct(F.lit("[]").alias("end"), unique.alias("differ")))
    )
    wanted = top.select("CaseNo", F.col("dataId").alias("ownerId"), "size", F.explode(ends).alias("e")).select("CaseNo", F.concat("ownerId", "e.end").alias("dataId"), "size", "e.differ")
    child = prepared(instructions.where(~F.upper("convModel").isin(*CONTAINERS))).withColumn("v", scalar())
    rows = wanted.join(child.select("CaseNo", "dataId", "convModel", "v", F.col("__refs").alias("refs")), KEYS)
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    value = F.when(F.col("differ") & (F.col("v.state") == "VALUE"), unique_sibling(F.col("convModel"), F.col("v.value"), F.col("refs"), F.col("i"))).otherwise(F.col("v.value"))
    rows = rows.withColumn("actualValue", value).withColumn("valueState", F.when((F.col("v.state") == "VALUE") & F.col("actualValue").isNull(), "UNSUPPORTED").otherwise(F.col("v.state")))
    return rows.select("CaseNo", "dataId", F.col("i").cast("bigint").alias("elementIndex"), "valueState", "actualValue", actual_length(F.col("valueState"), F.col("actualValue")).alias("actualLength"))


def containers(instructions: DataFrame) -> DataFrame:
    """Container instructions with size and valueState."""
    rows = instructions.where(F.upper("convModel").isin(*CONTAINERS)).withColumn("size", container_size())
    state = F.when(F.col("size").isNull(), "UNSUPPORTED").when(F.col("size") == -1, "NULL").when(F.col("size") == 0, "EMPTY").otherwise("VALUE")
    return rows.select("CaseNo", "dataId", "convModel", "mirrorY", F.col("size").cast("bigint").alias("size"), state.alias("valueState"))


def occurrence(df: DataFrame, *order: str) -> DataFrame:
    """Adds elementIndex: the count of earlier rows of the same (CaseNo, dataId)."""
    return df.withColumn("elementIndex", (F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order)) - 1).cast("bigint"))


def replay(wanted: DataFrame, evidence: DataFrame) -> DataFrame:
    """Values from evidence by (CaseNo, dataId, elementIndex); a row without evidence is MISSING, never generated anew."""
    key = [*KEYS, "elementIndex"]
    found = evidence.select(*key, "valueState", "actualValue", "actualLength")
    out = wanted.select(*key).join(found, key, "left")
    return out.select(*key, F.coalesce("valueState", F.lit("MISSING")).alias("valueState"), "actualValue", "actualLength")


def failures(values: DataFrame) -> DataFrame:
    """Rows that a strict run must not have."""
    return values.where(F.col("valueState").isin("UNSUPPORTED", "MISSING"))


# Java scalar types to Spark types.
SCALAR_TYPES = {
    "String": "string",
    "char": "string",
    "Character": "string",
    "int": "int",
    "Integer": "int",
    "long": "bigint",
    "Long": "bigint",
    "short": "smallint",
    "Short": "smallint",
    "byte": "tinyint",
    "Byte": "tinyint",
    "double": "double",
    "Double": "double",
    "float": "float",
    "Float": "float",
    "boolean": "boolean",
    "Boolean": "boolean",
    "BigDecimal": "decimal(38,16)",
    "BigInteger": "decimal(38,0)",
    "LocalDate": "date",
    "LocalDateTime": "timestamp_ntz",
}


def convertible(reference_type: Column, value: Column) -> Column:
    """Whether a value can be had as the type; NULL for types outside the runtime's own."""
    out = F.lit(None).cast("boolean")
    for name, spark_type in SCALAR_TYPES.items():
        out = F.when(F.regexp_extract(reference_type, r"([^.]*)$", 1) == name, value.try_cast(spark_type).isNotNull() | value.isNull()).otherwise(out)
    return out


def built(instructions: DataFrame) -> DataFrame:
    """CaseNo, dataId, convModel, size and text of each container that can be built from its elements: [a, b] or {key=value}, in element order; NULL for a null one."""
    sized = containers(instructions).where(F.col("valueState") != "UNSUPPORTED").select("CaseNo", "dataId", "convModel", "size")
    part = F.regexp_extract("dataId", r"(\[\]|\{key\}|\{value\})$", 1)
    items = elements(instructions).select(
        "CaseNo", F.regexp_replace("dataId", r"(?:\[\]|\{key\}|\{value\})$", "").alias("dataId"), "elementIndex", part.alias("part"), F.coalesce("actualValue", F.lit("null")).alias("v")
    ).where("part <> ''")
    entry = items.groupBy("CaseNo", "dataId", "elementIndex").agg(
        F.max(F.when(F.col("part") == "[]", F.col("v"))).alias("item"), F.max(F.when(F.col("part") == "{key}", F.col("v"))).alias("key"), F.max(F.when(F.col("part") == "{value}", F.col("v"))).alias("value")
    )
    shown = F.coalesce("item", F.concat("key", F.lit("="), F.coalesce("value", F.lit("null"))))
    lists = entry.groupBy("CaseNo", "dataId").agg(F.array_sort(F.collect_list(F.struct("elementIndex", shown.alias("v")))).alias("all"))
    inner = F.array_join(F.transform(F.coalesce("all", F.array().cast("array<struct<elementIndex:bigint,v:string>>")), lambda x: x["v"]), ", ")
    is_map = F.col("convModel") == "MAP"
    text = F.concat(F.when(is_map, "{").otherwise("["), inner, F.when(is_map, "}").otherwise("]"))
    return sized.join(lists, ["CaseNo", "dataId"], "left").select("CaseNo", "dataId", "convModel", "size", F.when(F.col("size") >= 0, text).alias("text"))
