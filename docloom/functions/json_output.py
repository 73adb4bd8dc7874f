"""Recovering, validating and rendering a model's JSON answers, as Column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import coerced, strip, to_bool, with_coerced

#: Kinds of sensitive data and the labels they are shown with.
CONFIDENTIAL_LABELS = {
    "first_names": "Imiona",
    "surnames": "Nazwiska",
    "id_numbers": "Numery identyfikacyjne",
    "contact_data": "Dane kontaktowe",
    "financial_data": "Dane finansowe",
    "medical_data": "Dane medyczne",
    "confidential_decisions": "Decyzje poufne",
    "trade_secrets": "Tajemnice handlowe",
    "case_numbers": "Sygnatury akt",
}
MANUAL_REVIEW = "Do ręcznej weryfikacji"


def recovered(raw: Column) -> Column:
    """The JSON value in an answer as ``variant``: without fences, else the outermost braces; null if neither parses."""
    clean = strip(F.regexp_replace(raw, r"(?i)```(?:json)?", ""))
    braces = F.regexp_extract(clean, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(clean), F.when(braces != "", F.try_parse_json(braces)))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def text_field(v: Column, name: str) -> Column:
    """A string member; null when it is absent or of another type."""
    inner = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(_kind(inner) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def bool_field(v: Column, name: str) -> Column:
    """A boolean member, or a yes/no text; numbers do not count."""
    inner = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(_kind(inner) == "BOOLEAN", F.try_variant_get(v, f"$.{name}", "boolean")).when(
        _kind(inner) == "STRING", to_bool(F.try_variant_get(v, f"$.{name}", "string")))


def with_category(df: DataFrame, raw: str, categories: str) -> DataFrame:
    """Adds ``category`` and ``subcategory``, resolved against ``array<struct<name, subs>>``; both null if unresolved.

    The subcategory is required exactly where the category lists any. Steps are columns of
    their own: in one expression each would be evaluated many times over.
    """
    kept = df.columns
    df = df.withColumn("_v", recovered(F.col(raw)))
    df = df.withColumn("_c", text_field(F.col("_v"), "category")).withColumn("_s", text_field(F.col("_v"), "subcategory"))
    df = with_coerced(df.withColumn("_names", F.transform(categories, lambda x: x["name"])), "_name", "_c", "_names")
    df = df.withColumn("_subs", F.try_element_at(F.filter(categories, lambda x: x["name"] == F.col("_name")), F.lit(-1))["subs"])
    df = with_coerced(df, "_sub", "_s", "_subs")
    ok = F.col("_name").isNotNull() & ((F.coalesce(F.size("_subs"), F.lit(0)) <= 0) | F.col("_sub").isNotNull())
    return df.select(*kept, F.when(ok, F.col("_name")).alias("category"), F.when(ok, F.col("_sub")).alias("subcategory"))


def with_department(df: DataFrame, raw: str, departments: str) -> DataFrame:
    """Adds ``department``, resolved against ``array<string>``."""
    kept = df.columns
    df = df.withColumn("_v", recovered(F.col(raw))).withColumn("_d", text_field(F.col("_v"), "department"))
    return with_coerced(df, "department", "_d", departments).select(*kept, "department")


def with_confidential(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``contains_sensitive`` and ``types``; both null if the flag or any listed type cannot be resolved."""
    kept = df.columns
    known = F.array(*[F.lit(t) for t in CONFIDENTIAL_LABELS])
    df = df.withColumn("_v", recovered(F.col(raw)))
    df = df.withColumn("_flag", bool_field(F.col("_v"), "contains_sensitive")).withColumn("_member", F.try_variant_get("_v", "$.types", "variant").isNotNull())
    df = df.withColumn("_listed", F.try_variant_get("_v", "$.types", "array<string>"))
    df = df.withColumn("_types", F.transform(F.coalesce("_listed", F.array().cast("array<string>")), lambda t: coerced(t, known)))
    ok = F.col("_flag").isNotNull() & ~F.exists("_types", lambda t: t.isNull()) & ~(F.col("_member") & F.col("_listed").isNull())
    return df.select(*kept, F.when(ok, F.col("_flag")).alias("contains_sensitive"), F.when(ok, F.col("_types")).alias("types"))


def rendered_confidential(flag: Column, types: Column) -> Column:
    """The report as text: kinds are listed once, and only if the flag is set; an unresolved flag gives no report."""
    label = F.create_map(*[F.lit(x) for pair in CONFIDENTIAL_LABELS.items() for x in pair])
    lines = F.array_join(F.transform(F.array_distinct(types), lambda t: F.concat(F.lit("- "), F.coalesce(F.try_element_at(label, t), t))), "\n")
    listed = F.concat(F.lit("Dane wrażliwe: TAK\nWykryte typy:\n"), lines)
    return F.when(flag.isNull(), F.lit(None)).when(~flag, F.lit("Dane wrażliwe: NIE")).when(F.coalesce(F.size(types), F.lit(0)) <= 0, F.lit("Dane wrażliwe: TAK")).otherwise(listed)


def rendered_extraction(items: Column) -> Column:
    """``field: value`` lines of ``array<struct<field, value>>``, leaving out items without a field."""
    kept = F.filter(items, lambda x: x["field"].isNotNull() & (x["field"] != ""))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(": ", x["field"], F.coalesce(x["value"], F.lit("")))), "\n")


def extraction_of(raw: Column) -> Column:
    """``array<struct<field, value>>`` of a valid extraction answer, null otherwise.

    An object without ``data`` holds an empty list, an empty object is no answer; an item has to have a text
    as field and as value.
    """
    v = recovered(raw)
    data = F.try_variant_get(v, "$.data", "variant")
    items = F.try_variant_get(v, "$.data", "array<variant>")
    valid = F.forall(items, lambda i: (F.coalesce(_kind(F.try_variant_get(i, "$.field", "variant")), F.lit("")) == "STRING") & (F.coalesce(_kind(F.try_variant_get(i, "$.value", "variant")), F.lit("")) == "STRING"))
    empty = F.array().cast("array<struct<field:string,value:string>>")
    return F.when(v.isNull() | ~_kind(v).startswith("OBJECT") | (_kind(v) == "OBJECT<>"), F.lit(None)).when(data.isNull(), empty).when(
        valid, F.try_variant_get(v, "$.data", "array<struct<field:string,value:string>>"))


def payload(document_id: Column, task_id: Column, task_type: Column, results: Column, error: Column) -> Column:
    """The reply of a task as JSON, ``results`` under the task's name, or ``error``; null members are left out."""
    return F.to_json(F.struct(document_id.alias("documentId"), task_id.alias("taskId"), task_type.alias("taskType"), F.when(error.isNull(), results).alias("results"), error.alias("error")))


#: Schemas of the answers with a fixed shape.
CONFIDENTIAL_SCHEMA = json.dumps({"type": "object", "properties": {"contains_sensitive": {"type": "boolean"}, "types": {"type": "array", "items": {"enum": list(CONFIDENTIAL_LABELS)}}},
                                  "required": ["contains_sensitive"], "additionalProperties": False})
EXTRACTION_SCHEMA = json.dumps({"type": "object", "additionalProperties": False, "properties": {"data": {"type": "array", "items": {
    "type": "object", "properties": {"field": {"type": "string"}, "value": {"type": "string"}}, "required": ["field", "value"], "additionalProperties": False}}}})


def category_schema_of(categories: Column) -> Column:
    """The schema of ``category_schema`` for ``array<struct<name, subs>>``, as a Column; null where no category is given."""
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    def branch(c: Column) -> Column:
        has = F.coalesce(F.size(c["subs"]), F.lit(0)) > 0
        return F.concat(F.lit('{"type":"object","properties":{"category":{"const":'), quoted(c["name"]), F.lit("}"),
                        F.when(has, F.concat(F.lit(',"subcategory":{"enum":'), F.to_json(c["subs"]), F.lit('}},"required":["category","subcategory"]'))).otherwise(F.lit('},"required":["category"]')),
                        F.lit(',"additionalProperties":false}'))
    return F.when(F.size(categories) > 0, F.concat(F.lit('{"anyOf":['), F.array_join(F.transform(categories, branch), ","), F.lit("]}")))


def department_schema_of(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit('{"type":"object","properties":{"department":{"enum":'), F.to_json(names), F.lit('}},"required":["department"],"additionalProperties":false}')))


def category_schema(categories: dict[str, list[str]]) -> str:
    """JSON schema with one branch a category, tying its subcategories to it."""
    if not categories:
        raise ValueError("no categories given")

    def branch(name: str, subs: list[str]) -> dict:
        fields = {"category": {"const": name}} | ({"subcategory": {"enum": list(subs)}} if subs else {})
        return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}

    return json.dumps({"anyOf": [branch(n, s) for n, s in categories.items()]}, ensure_ascii=False)


def department_schema(names: list[str]) -> str:
    if not names:
        raise ValueError("no departments given")
    return json.dumps({"type": "object", "properties": {"department": {"enum": list(names)}}, "required": ["department"], "additionalProperties": False}, ensure_ascii=False)
