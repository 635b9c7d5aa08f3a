"""UI elements: labels, scope groups and the interaction they call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.hashes import md5_prefix

# Custom component to interaction, axis and method prefix.
CUSTOM = [
    ("TextField", "text_input", "text_input", "input"),
    ("Button", "navigation_trigger", "button_normal", "click"),
    ("Select", "selection_input", "select_single", "input"),
    ("Checkbox", "binary_input", "input_checkbox", "check"),
]


def _given(name: str) -> Column:
    """The text, or NULL if it is empty."""
    return F.nullif(F.col(name), F.lit(""))


def labels(elements: DataFrame) -> DataFrame:
    """Adds labelText (aria-label, label, placeholder, title) and labelUnresolved (only a reference to a label is known)."""
    text = F.coalesce(_given("ariaLabel"), _given("labelProp"), _given("placeholder"), _given("title"))
    points = F.coalesce(_given("ariaLabelledBy"), _given("htmlFor")).isNotNull()
    return elements.withColumn("labelText", text).withColumn("labelUnresolved", F.col("labelText").isNull() & points)


def scopes(elements: DataFrame) -> DataFrame:
    """Adds siblingCount and, for two or more, scopeGroupId: by form, else by the parent's tag and class."""
    form = _given("formId")
    key = F.when(form.isNotNull(), F.concat(F.lit("form__"), form)).otherwise(F.concat_ws("__", "parentScopeTag", F.coalesce("parentScopeClass", F.lit(""))))
    keyed = elements.withColumn("__form", form.isNotNull()).withColumn("__key", key)
    out = keyed.withColumn("siblingCount", F.count("*").over(Window.partitionBy("componentName", "__form", "__key")))  # elements are scanned once, and nothing is broadcast
    group = md5_prefix(F.concat(F.col("componentName"), F.lit("__"), F.col("__key")))
    return out.withColumn("scopeGroupId", F.when(F.col("siblingCount") >= 2, group)).select(*elements.columns, "siblingCount", "scopeGroupId")


def interactions(elements: DataFrame, custom: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Adds interactionType, mirrorAxisX and playwrightMethodPrefix; a custom component's entry goes first."""
    tag, kind, role = F.lower("tag"), F.lower(F.coalesce("typeAttr", F.lit(""))), F.lower(F.coalesce("roleAttr", F.lit("")))
    many = F.coalesce("isMultiple", F.lit(False))

    def to(interaction: str, axis: str, prefix: str) -> Column:
        return F.struct(F.lit(interaction).alias("interactionType"), F.lit(axis).alias("mirrorAxisX"), F.lit(prefix).alias("playwrightMethodPrefix"))

    field = (
        F.when(kind == "checkbox", to("binary_input", "input_checkbox", "check")).when(kind == "radio", to("binary_input", "input_radio", "check"))
        .when((kind == "file") & many, to("file_input", "input_file_multiple", "input")).when(kind == "file", to("file_input", "input_file_single", "input"))
        .when(kind.isin("submit", "image"), to("navigation_trigger", "button_submit", "submit")).otherwise(to("text_input", "text_input", "input"))
    )
    rule = (
        F.when(tag == "input", field).when(tag == "textarea", to("text_input", "textarea_multiline", "input"))
        .when((tag == "select") & many, to("selection_input", "select_multiple", "input")).when(tag == "select", to("selection_input", "select_single", "input"))
        .when((tag == "button") & (kind == "submit"), to("navigation_trigger", "button_submit", "submit")).when(tag == "button", to("navigation_trigger", "button_normal", "click"))
        .when((tag == "a") & _given("href").isNotNull(), to("navigation_trigger", "anchor_link", "click")).when(tag == "a", to("pseudo_trigger", "pseudo_trigger", "click"))
        .when(role == "button", to("pseudo_trigger", "div_button", "click")).otherwise(to("unknown", "unknown", "click"))
    )
    for name, *entry in reversed(CUSTOM if custom is None else custom):
        rule = F.when(F.col("tag") == name, to(*entry)).otherwise(rule)
    return elements.withColumn("__rule", rule).select(*elements.columns, "__rule.*")


def group_size(df: DataFrame, *keys: str) -> DataFrame:
    """Each row with the number of rows that share its keys."""
    return df.withColumn("groupSize", F.count("*").over(Window.partitionBy(*keys)))


# Columns of the element file, in order; screenName is the component.
ELEMENT_COLUMNS = (
    "screenName lineNumber tag idAttr nameAttr classNameAttr dataTestId typeAttr roleAttr labelText labelUnresolved placeholder title ariaLabel ariaLabelledBy htmlFor labelProp"
    " maxLength minLength maxValue minValue step pattern inputMode accept autocomplete href target formAction formId isRequired isDisabled isReadonly isHidden isMultiple isChecked defaultValue tabIndex"
    " ariaExpanded ariaControls ariaHaspopup ariaSelected ariaChecked isDynamic parentScopeTag parentScopeClass parentScopeId siblingCount scopeGroupId interactionType mirrorAxisX playwrightMethodPrefix"
).split()


def resolved(elements: DataFrame) -> DataFrame:
    """Scanned elements with labels, scopes and interactions; one shuffle, by component, serves this and what groups by component afterwards."""
    return interactions(scopes(labels(elements.repartition("componentName"))))


def element_rows(elements: DataFrame) -> DataFrame:
    """Rows of the element file: texts, '' for what is missing."""
    rows = elements.withColumn("screenName", F.col("componentName"))
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ELEMENT_COLUMNS))


def screens_json(elements: DataFrame, app: str) -> DataFrame:
    """(screenName, json): a JSON object {appName, screens: {name: [elements]}} for each screen; missing values are null."""
    whole = F.struct(*(F.regexp_extract(c, r"[^/]*$", 0).alias(c) if c == "filePath" else F.col(c) for c in elements.columns))
    ordered = elements.groupBy("componentName").agg(F.array_sort(F.collect_list(F.struct("lineNumber", whole.alias("e")))).alias("es"))
    json = F.to_json(F.struct(F.lit(app).alias("appName"), F.create_map("componentName", F.transform("es", lambda x: x["e"])).alias("screens")), {"ignoreNullFields": "false"})
    return ordered.select(F.col("componentName").alias("screenName"), json.alias("json"))


def screens_markdown(elements: DataFrame) -> DataFrame:
    """(screenName, markdown): a heading and a table of line, tag, label, interaction and axis for each screen."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), r"\|", r"\\|")
    shown = ["lineNumber", "tag", "labelText", "interactionType", "mirrorAxisX"]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in shown)), F.lit(" |"))
    rows = elements.groupBy("componentName").agg(F.array_sort(F.collect_list(F.struct("lineNumber", line.alias("line")))).alias("r"))
    head = f"| {' | '.join(shown)} |\n|{' --- |' * len(shown)}\n"
    return rows.select(
        F.col("componentName").alias("screenName"),
        F.concat(F.lit("## "), "componentName", F.lit("\n\n" + head), F.array_join(F.transform("r", lambda x: x["line"]), "\n"), F.lit("\n")).alias("markdown"),
    )
