"""Reports of findings: rows of text as DataFrames, and single files."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwire.operators.findings import dedupe, raw_values

HEADER = "Type,Risk,Value,SourceURL,Occurrences,Context,Description"


def format_of(path: str | None) -> str:
    """By the file's ending: json, csv, else txt."""
    ending = os.path.splitext(path or "")[1].lower()
    return {".json": "json", ".csv": "csv"}.get(ending, "txt")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), _escaped(c), F.lit('"'))


def _escaped(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""'))


def csv_lines(deduped: DataFrame) -> DataFrame:
    """``source_url, type, value, line``: a CSV line for each deduplicated finding. Type goes bare, risk too, all else is quoted."""
    cells = [F.col("type"), _escaped(F.col("risk")), _quoted(F.col("value")), _quoted(F.col("source_url")), F.col("occurrences").cast("string"), _quoted(F.array_join("context", " | ")), _quoted(F.col("description"))]
    return deduped.select("source_url", "type", "value", F.concat_ws(",", *cells).alias("line"))


def txt_blocks(deduped: DataFrame, indent: str = "", with_source: bool = True) -> DataFrame:
    """``source_url, type, value, block``: the lines of a text report for each finding; empty fields give none."""
    field = lambda name, c, when: F.when(when, F.concat(F.lit(f"{indent}{name}: "), c))
    lines = [
        F.concat(F.lit(indent + "["), "type", F.lit("] "), "value"),
        field("Risk", F.col("risk"), F.coalesce(F.col("risk"), F.lit("")) != ""),
        field("URL", F.col("source_url"), F.lit(with_source)),
        field("Occurrences", F.col("occurrences").cast("string"), F.col("occurrences") > 1),
        field("Context", F.array_join("context", " | "), F.size("context") > 0),
        field("Description", F.col("description"), F.coalesce(F.col("description"), F.lit("")) != ""),
    ]
    return deduped.select("source_url", "type", "value", F.concat(F.concat_ws("\n", *lines), F.lit("\n\n")).alias("block"))


def json_records(deduped: DataFrame) -> DataFrame:
    """``record``: a JSON object for each finding; empty risk, context, occurrences and description are left out."""
    some = lambda c: F.when(c != "", c)
    item = F.struct("type", some(F.col("risk")).alias("risk"), "value", "source_url", F.when(F.size("context") > 0, F.col("context")).alias("context"), F.when(F.col("occurrences") > 0, F.col("occurrences")).alias("occurrences"), some(F.col("description")).alias("description"))
    return deduped.select("source_url", "type", "value", F.to_json(item).alias("record"))


def json_groups(deduped: DataFrame) -> DataFrame:
    """``source_url, n, records``: a JSON array of the findings of each source, in order of type and value."""
    items = json_records(deduped).groupBy("source_url").agg(F.array_sort(F.collect_list(F.struct("type", "value", "record"))).alias("items"))
    return items.select("source_url", F.size("items").alias("n"), F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["record"]), ","), F.lit("]")).alias("records"))


def raw_lines(findings: DataFrame, kind: str = "txt", group: bool = False) -> DataFrame:
    """``source_url, value, line``: what a raw report says of each deduplicated value; of grouped JSON, ``source_url, line``, one array a source."""
    rows = raw_values(findings, by_source=True)
    if kind == "json" and group:
        return rows.groupBy("source_url").agg(F.to_json(F.array_sort(F.collect_list("value"))).alias("line"))
    if kind == "json":
        line = F.regexp_extract(F.to_json(F.array("value")), r"(?s)\A\[(.*)\]\z", 1)
    elif kind == "csv":
        line = F.concat(_quoted(F.col("source_url")), F.lit(","), _quoted(F.col("value"))) if group else _quoted(F.col("value"))
    else:
        line = F.concat(F.lit("\t"), "value") if group else F.col("value")
    return rows.select("source_url", "value", line.alias("line"))


def _objects(rows, keep_source: bool = True) -> list[dict]:
    out = []
    for r in rows:
        item = {"type": r.type, "risk": r.risk, "value": r.value, "source_url": r.source_url, "context": list(r.context or []), "occurrences": r.occurrences, "description": r.description}
        out.append({k: v for k, v in item.items() if v or k in ("type", "value", "source_url")})
    return out


def _html_safe(text: str) -> str:
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def render(findings: DataFrame, kind: str = "txt", raw: bool = False, group: bool = False) -> str:
    """A whole report as one string, for a file of its own. This gathers all findings on the
    driver, so it is for reports that someone reads; ``write_table`` is for the rest."""
    order = ["source_url", "type", "value"]
    if raw:
        pairs = [(r.source_url, r.value) for r in raw_values(findings.select("type", "value", "source_url"), True).orderBy("source_url", "value").collect()]
        by: dict[str, list[str]] = {}
        for source, value in pairs:
            by.setdefault(source, []).append(value)
        values = [v for _, v in pairs]
        if kind == "json":
            return _html_safe(json.dumps(by if group else values, indent=2, ensure_ascii=False))
        if kind == "csv":
            q = lambda s: '"' + s.replace('"', '""') + '"'
            return "Source,Value\n" + "".join(f"{q(s)},{q(v)}\n" for s, v in pairs) if group else "Value\n" + "".join(f"{q(v)}\n" for v in values)
        return "".join(f"{s}:\n" + "".join(f"\t{v}\n" for v in vs) + "\n" for s, vs in by.items()) if group else "".join(f"{v}\n" for v in values)
    rows = dedupe(findings)
    if kind == "json":
        items = _objects(rows.orderBy(*order).collect())
        if group:
            held: dict[str, list[dict]] = {}
            for item in items:
                held.setdefault(item["source_url"], []).append(item)
            return _html_safe(json.dumps(held, indent=2, ensure_ascii=False))
        return _html_safe(json.dumps(items, indent=2, ensure_ascii=False)) if items else "null"
    if kind == "csv":
        lines = [r.line for r in csv_lines(rows).orderBy(*order).collect()]
        return "".join(f"{x}\n" for x in ([] if group else [HEADER]) + lines)
    blocks = txt_blocks(rows, "\t" if group else "", not group).orderBy(*order).collect()
    if not group:
        return "".join(r.block for r in blocks)
    out, last = [], None
    for r in blocks:
        if r.source_url != last:
            out.append(f"{r.source_url}:\n")
            last = r.source_url
        out.append(r.block)
    return "".join(out)


def write_report(findings: DataFrame, path: str, raw: bool = False, group: bool = False) -> None:
    """Write one report file, its format by the ending; parent folders are made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    text = render(findings, format_of(path), raw, group)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def write_table(findings: DataFrame, path: str, kind: str = "parquet") -> None:
    """Deduplicated findings as a distributed table, or as report lines (csv, txt, json)."""
    rows = dedupe(findings)
    if kind == "parquet":
        rows.write.parquet(path)
    elif kind == "csv":
        csv_lines(rows).select("line").write.text(path)
    elif kind == "json":
        json_records(rows).select("record").write.text(path)
    else:
        txt_blocks(rows).select("block").write.text(path)


def pattern_listing(catalog: DataFrame) -> DataFrame:
    """Enabled patterns by category and name."""
    return catalog.where("enabled and regex <> '' and category <> ''").select("category", "name", "description").orderBy("category", "name")
