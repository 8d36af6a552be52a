"""Putting tables together: item pages, leads and people joined back to the rows they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions.text import completed, filled, fold, text


def assemble(rows: DataFrame, items: DataFrame, on: str, single: list[str], expand: tuple[str, list[str]] | None = None, collapse: dict[str, str] | None = None) -> DataFrame:
    """Rows with what their item page says; every row stays. items has a row for each page: scalar fields, and lists as arrays.

    expand: an array of structs and its fields; each entry becomes a row, in order (_member); a row without entries stays with blank cells.
    collapse: output names and arrays of text, joined by "; " without blanks.
    """
    joined = rows.join(items, on, "left")
    cells = [text(c).alias(c) for c in single]
    cells += [F.coalesce(F.array_join(F.filter(c, lambda x: filled(x)), "; "), F.lit("")).alias(n) for n, c in (collapse or {}).items()]
    if not expand:
        return joined.select(*rows.columns, *cells)
    array, fields = expand
    out = joined.select(*rows.columns, *cells, F.posexplode_outer(array).alias("_member", "_entry"))
    return out.select(*rows.columns, *[c for c in out.columns if c not in rows.columns and c not in ("_member", "_entry")], "_member", *[text(F.col("_entry")[f]).alias(f) for f in fields])


def complete_cells(rows: DataFrame, columns: list[str], candidates: str) -> DataFrame:
    """Cells cut off with dots, completed from an array column of full texts."""
    return rows.withColumns({c: completed(c, F.coalesce(candidates, F.array().cast("array<string>"))) for c in columns})


VIA = {"listing": "Listed in the directory", "exhibitor-page": "Exhibitor page", "domain-check": "Name match (check)", "web-search": "Web search", "ai-search": "Web search"}
CONFIDENCE = {"high": "High", "medium": "Medium", "low": "Low"}


def _said(c: Column, names: dict[str, str], other) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), other)


def lead_cells(leads: DataFrame) -> DataFrame:
    """The cells of each lead: id, website, website_source, people (array of structs name, role_raw, email, phone, linkedin, source_url, confidence, best
    first), company_email, company_email_source, company_phone, company_phone_source, company_linkedin, notes (array). Not found is empty."""
    first = lambda f: text(F.get("people", 0)[f])
    label = lambda p: F.array_join(F.filter(F.array(p["name"], p["role_raw"], p["email"], p["linkedin"]), lambda x: filled(x)), ", ")
    source = lambda v, s: F.when(filled(v), text(s)).otherwise("")
    confidence = F.get("people", 0)["confidence"]
    return leads.select(
        "id",
        text("website").alias("Website"),
        F.when(filled("website"), _said(text("website_source"), VIA, F.lit(""))).otherwise("").alias("Website found via"),
        first("name").alias("Decision-maker"),
        first("role_raw").alias("Decision-maker role"),
        first("email").alias("Decision-maker email"),
        first("phone").alias("Decision-maker phone"),
        first("linkedin").alias("Decision-maker LinkedIn"),
        first("source_url").alias("Decision-maker source"),
        F.when(confidence.isNotNull(), _said(confidence, CONFIDENCE, confidence)).otherwise("").alias("Decision-maker confidence"),
        F.coalesce(F.array_join(F.transform(F.slice("people", 2, 5), label), "; "), F.lit("")).alias("Other decision-makers"),
        text("company_email").alias("Company email"),
        source("company_email", "company_email_source").alias("Company email source"),
        text("company_phone").alias("Company phone"),
        source("company_phone", "company_phone_source").alias("Company phone source"),
        text("company_linkedin").alias("Company LinkedIn"),
        F.coalesce(F.array_join("notes", " "), F.lit("")).alias("Lookup notes"),
    )


def lead_names(existing: list[str], fields: list[str]) -> dict[str, str]:
    """A name for each lead field, marked where the rows have it already."""
    taken = {n.lower() for n in existing}
    return {f: f"{f} (lookup)" if f.lower() in taken else f for f in fields}


def join_leads(rows: DataFrame, cells: DataFrame, key: Column) -> DataFrame:
    """Every row of a company gets its cells (by id); rows without a key, or not looked up, get empty ones."""
    fields = [c for c in cells.columns if c != "id"]
    names = lead_names(rows.columns, fields)
    named = cells.select(F.col("id").alias("_lead"), *[F.col(f"`{f}`").alias(names[f]) for f in fields])
    joined = rows.withColumn("_key", key).join(named, F.col("_key") == F.col("_lead"), "left")
    return joined.select(*rows.columns, *[text(F.col(f"`{n}`")).alias(n) for n in names.values()])


def merge_leads(old: DataFrame, new: DataFrame, scalars: list[str], id: str = "id") -> DataFrame:
    """An earlier and a newer lookup as one: a new value where there is one, new people instead of all old ones, pages of both, the old first."""
    o = old.select(F.col(id).alias("_o"), *[F.col(c).alias(f"o_{c}") for c in [*scalars, "people", "pages"]])
    n = new.select(F.col(id).alias("_n"), *[F.col(c).alias(f"n_{c}") for c in [*scalars, "people", "pages"]])
    joined = o.join(n, F.col("_o") == F.col("_n"), "full")
    empty = F.lit(None)
    people = F.when(F.size(F.coalesce("n_people", F.array())) > 0, F.col("n_people")).otherwise(F.coalesce("o_people", "n_people"))
    none = F.array().cast("array<string>")
    value = lambda c: F.coalesce(F.when(filled(f"n_{c}"), F.col(f"n_{c}")).otherwise(empty), F.col(f"o_{c}"))
    return joined.select(F.coalesce("_n", "_o").alias(id), *[value(c).alias(c) for c in scalars], people.alias("people"), F.array_union(F.coalesce("o_pages", none), F.coalesce("n_pages", none)).alias("pages"))


def merge_people(people: DataFrame, by: list[str], name: str = "name", order: str = "_ord", values: tuple[str, ...] = ("email", "phone", "linkedin"), folded=fold) -> DataFrame:
    """One row for each person of a company: the first mention, its blanks filled from the next ones that know, and the confidence high if any is."""
    keyed = people.withColumn("_k", folded(F.col(name)))
    first_known = [F.min_by(c, F.when(filled(c), F.col(order))).alias(c) for c in values]
    firsts = [F.min_by(c, order).alias(c) for c in people.columns if c not in (*by, *values, "confidence", order)]
    sure = F.when(F.max((F.col("confidence") == "high").cast("int")) == 1, "high").otherwise(F.min_by("confidence", order))
    return keyed.groupBy(*by, "_k").agg(*firsts, *first_known, sure.alias("confidence"), F.min(order).alias(order)).drop("_k")


ROLE_ORDER, CONFIDENCE_ORDER = ["owner", "ceo", "md", "purchasing", "decision"], ["high", "medium", "low"]


def person_rank() -> Column:
    """Best lead first: the most senior role, then the most certain, then with an address."""
    at = lambda c, names: F.array_position(F.array(*map(F.lit, names)), F.col(c)) - 1
    return at("role", ROLE_ORDER) * 10 + at("confidence", CONFIDENCE_ORDER) * 2 + F.when(filled("email"), 0).otherwise(1)


def best_people(people: DataFrame, by: list[str], most: int | None = None, order: str = "_ord") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(person_rank(), order))
    out = people.withColumn("rank", rank)
    return out.where(F.col("rank") <= most) if most else out


def keep_best(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first so many rows of each key: links of a page, candidate lists, fields of a catalogue."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def plan_rows(rows: DataFrame, items: list[tuple[str, Column, Column, Column]], company: Column | None = None, keep: Column | None = None, sources: bool = True, limit: int | None = None, order: str = "_ord") -> DataFrame:
    """A plan's output: rows kept by a filter, one for each company (blank ones all stay), with exactly the columns asked for, up to a limit.

    items: label, value, source and confidence; a blank value has neither. The filter comes before the de-duplication, the limit counts output rows.
    """
    out = rows.where(keep) if keep is not None else rows
    if company is not None:
        key = F.lower(F.trim(text(company)))
        out = out.withColumn("_key", key).withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(order))).where("_key = '' OR _r = 1")
    cells = [F.col(order).alias("_order")]
    for label, value, source, confidence in items:
        value = text(value)
        cells.append(value.alias(label))
        if sources:
            cells += [F.when(value != "", text(source)).otherwise("").alias(f"{label} (source)"), F.when(value != "", text(confidence)).otherwise("").alias(f"{label} (confidence)")]
    out = out.select(*cells)
    return (out.orderBy("_order").limit(limit) if limit else out).drop("_order")
