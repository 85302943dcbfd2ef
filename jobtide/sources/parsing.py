"""Stored records to typed rows and texts: JSON, file metadata, OCR detections, PDF words, table cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtide.functions.text import clean_text
from jobtide.session import checkpointed

IMAGES, DOCUMENTS, RESUMES = ("png", "jpg", "jpeg", "bmp", "webp"), ("pdf",), ("pdf", "doc", "docx")


def file_inventory(files: DataFrame, most_bytes: int = 10 << 20, allowed: tuple[str, ...] = IMAGES + DOCUMENTS) -> DataFrame:
    """``path``, ``length`` to extension, kind and the first reason for refusal (null: accepted).

    For descriptions images and PDF are allowed, for résumés (``RESUMES``) PDF and text documents, by name.
    """
    ext = F.regexp_extract(F.lower("path"), r"\.([a-z0-9]+)$", 1)
    kind = F.when(ext.isin(*IMAGES), "image").when(ext.isin(*DOCUMENTS), "pdf").when(ext.isin(*RESUMES) & F.lit(set(RESUMES) <= set(allowed)), ext).otherwise("unknown")
    reason = F.when(F.col("length").isNull(), "missing").when(F.col("length") > most_bytes, "too large").when(~ext.isin(*allowed), "not allowed")
    return files.select("path", "length", ext.alias("extension"), kind.alias("kind"), reason.alias("reason"))


def read_files(spark, path: str) -> DataFrame:
    """Metadata of the files below a path, without their content; empty files are not listed."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def parse_structured(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON column as typed columns; text that isn't such JSON gives nulls."""
    return rows.withColumn("_x", F.from_json(column, schema)).select(*rows.columns, "_x.*")


def parse_model_json(text: Column, required: dict[str, str]) -> Column:
    """Stored model output as a struct: fences off, parsed, null unless all named fields are there."""
    bare = F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    parsed = F.from_json(bare, ", ".join(f"`{k}` {t}" for k, t in required.items()))
    whole = parsed.isNotNull()
    for name in required:
        whole = whole & parsed[name].isNotNull()
    return F.when(whole, parsed)


def assemble_jd(jd_text: Column, duties: Column, demands: Column) -> Column:
    """The text given, else its parts under their headings."""
    part = lambda head, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(head + ":\n"), x))
    return F.coalesce(F.nullif(jd_text, F.lit("")), F.concat_ws("\n\n", part("岗位职责", duties), part("任职要求", demands)))


def salary_range(low: Column, high: Column) -> Column:
    """``min-max``, only if there is a minimum."""
    return F.when(low.isNotNull(), F.concat_ws("-", low.cast("string"), high.cast("string")))


def ocr_to_text(detections: DataFrame, least: float | None = 0.6) -> DataFrame:
    """Text of each document: its detections in reading order, cleaned."""
    rows = detections if least is None else detections.filter(F.col("confidence") > least)
    lines = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "y", "x", "text"))).alias("r"))
    return lines.select("doc_id", clean_text(F.array_join(F.transform("r", lambda d: d["text"]), "\n")).alias("text"))


def words_to_lines(words: DataFrame, gap: float = 3.0) -> DataFrame:
    """Words of each page to lines: a new line where the top moves by ``gap`` or more; one shuffle by page."""
    order = W.partitionBy("doc_id", "page").orderBy(F.round("top", 1), "x0", "text")
    start = F.coalesce((F.abs(F.col("top") - F.lag("top").over(order)) >= gap).cast("int"), F.lit(1))
    rows = words.withColumn("_n", start).withColumn("line", F.sum("_n").over(order))
    out = rows.groupBy("doc_id", "page", "line").agg(
        F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("_w"), F.min("x0").alias("x0"), F.max_by("x1", "x0").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
        F.mode(F.nullif("fontname", F.lit("")), deterministic=True).alias("fontname"), F.avg(F.nullif("size", F.lit(0.0))).alias("size"),
    )
    return out.withColumn("text", F.array_join(F.transform("_w", lambda w: w["text"]), " ")).drop("_w")


def pdf_kind(pages: DataFrame) -> DataFrame:
    """Per document: scanned, mixed or text, from its page statistics."""
    rows = pages.groupBy("doc_id").agg(F.avg("text_chars").alias("chars"), F.avg("images").alias("images"), F.bool_or("has_fonts").alias("fonts"))
    kind = F.when(~F.col("fonts") & (F.col("images") > 0.7), "scanned").when((F.col("chars") < 100) & (F.col("images") > 0.5), "mixed").otherwise("text")
    return rows.select("doc_id", kind.alias("kind"))


def table_to_text(rows: Column) -> Column:
    """Cells joined by bars, null as empty, rows by line feeds."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ", "")), "\n")


#: Levels of nesting that are opened in one plan; deeper documents are taken up again from a checkpoint.
LEVELS_AT_ONCE = 16


def json_depth(text: Column) -> Column:
    """Levels of nesting of a JSON text, from its brackets outside strings."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), r"[^\[\]{}]", "")
    step = lambda a, c: F.struct((a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(a["most"], a["now"] + 1 * c.isin("[", "{").cast("int")).alias("most"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.split(brackets, ""), start, step)["most"]


def _children(value: Column) -> Column:
    """Members of an object or items of an array with their keys; null for anything else."""
    members, items = F.try_variant_get(value, "$", "map<string,variant>"), F.try_variant_get(value, "$", "array<variant>")
    named = F.transform(F.filter(F.map_entries(members), lambda e: e["key"] != "_confirmed"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    placed = F.transform(items, lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
    return F.coalesce(named, placed)


def _shown(value: Column) -> Column:
    """A leaf as text: null is empty, whole numbers have no fraction."""
    text = F.try_variant_get(value, "$", "string")
    number = F.regexp_like(F.schema_of_variant(value), F.lit("^(?:DECIMAL|DOUBLE|FLOAT|BIGINT)"))
    whole = F.try_variant_get(value, "$", "double")
    plain = F.when(number & (whole == F.floor(whole)) & (F.abs(whole) < 1e15), F.floor(whole).cast("long").cast("string")).otherwise(text)
    return F.when(F.is_variant_null(value), "").otherwise(F.coalesce(plain, F.lit("")))


def flatten_json(rows: DataFrame, ident: str, column: str) -> DataFrame:
    """Leaves of open JSON documents of any depth: path as JSON array and value as text.

    Documents are parsed to VARIANT and opened level by level inside the JVM; the deepest document (found in one pass over
    the brackets) tells how many levels there are. ``_confirmed`` is left out; empty objects and arrays have no leaf;
    text that isn't JSON, names a member twice or is a single value gives none.
    """
    text = rows.select(F.col(ident).alias("_id"), F.col(column).alias("_doc"))
    levels = text.agg(F.max(json_depth(F.col("_doc")))).first()[0] or 0
    value = F.try_parse_json("_doc")
    now = text.select("_id", F.expr("cast(array() as array<string>)").alias("path"), value.alias("v"), _children(value).alias("kids")).filter("kids is not null")
    for level in range(levels):
        if level and level % LEVELS_AT_ONCE == 0:
            now = checkpointed(now.select("_id", "path", "v")).withColumn("kids", _children(F.col("v")))
        itself = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("v").alias("value")))
        opened = now.select("_id", "path", F.explode(F.coalesce("kids", itself)).alias("x"))
        path = F.when(F.col("x.key").isNull(), F.col("path")).otherwise(F.concat("path", F.array("x.key")))
        now = opened.select("_id", path.alias("path"), F.col("x.value").alias("v")).withColumn("kids", _children(F.col("v")))
    leaves = now.filter("kids is null") if levels else now.limit(0)
    return leaves.select(F.col("_id").alias(ident), F.to_json("path").alias("path"), _shown(F.col("v")).alias("value"))
