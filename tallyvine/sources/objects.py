"""Large JSON objects, written with an indent of two, read by many tasks: the file is split where an element begins.

In such a file a line break, the indent and a brace can only stand at the structure's own lines (breaks within strings are
escaped), so Spark's text source can split it there as it splits any other text at line breaks. Each element becomes a VARIANT by itself.
What stands before, between and after the elements (versions, counts, lists of names) is little, and kept as text. Files in another layout
give nothing here; their readers take them whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The head of a file in this layout, and where an element of a top-level array, and an entry of the top level, begin and end.
HEAD, ELEMENT, ELEMENT_END, ENTRY, ENTRY_END = '{\n  "', "\n    {", "\n    }", '\n  "', "\n  }"


def _cut(spark: SparkSession, path: str, begin: str, end: str) -> DataFrame:
    """body and rest of each piece: what belongs to the element that begins there (null if none does), and what follows it."""
    pieces = spark.read.option("lineSep", begin).text(path)
    at = F.instr("value", end)
    body = F.when(at > 0, F.substring("value", F.lit(1), at - 1))
    return pieces.select(body.alias("body"), F.when(at > 0, F.substr("value", at + len(end))).otherwise(F.col("value")).alias("rest"))


def in_layout(spark: SparkSession, path: str) -> bool:
    return bool(_cut(spark, path, ELEMENT, ELEMENT_END).where(F.startswith("rest", F.lit(HEAD))).take(1))


def elements(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """v (VARIANT): the elements of the top-level array whose elements have the field mark; malformed ones are an error."""
    bodies = _cut(spark, path, ELEMENT, ELEMENT_END).where("body IS NOT NULL")
    found = bodies.select(F.parse_json(F.concat(F.lit("{"), "body", F.lit("}"))).alias("v"))
    return found.where(F.try_variant_get("v", f"$.{mark}", "variant").isNotNull())


def entries(spark: SparkSession, path: str) -> DataFrame:
    """name, v (VARIANT) of each entry of a top-level object of objects."""
    pieces = _cut(spark, path, ENTRY, ENTRY_END).where("body IS NOT NULL")
    name = F.concat(F.lit('"'), F.regexp_extract("body", r'^((?:[^"\\]|\\.)*)": \{', 1), F.lit('"'))
    rest = F.regexp_replace("body", r'^(?:[^"\\]|\\.)*": \{', "{")
    return pieces.select(F.variant_get(F.parse_json(name), "$", "string").alias("name"), F.parse_json(F.concat(rest, F.lit("}"))).alias("v"))


def facts(spark: SparkSession, path: str, patterns: dict[str, str]) -> dict[str, str | None]:
    """The first group of each pattern in what stands beside the elements."""
    rest = _cut(spark, path, ELEMENT, ELEMENT_END).where(F.length("rest") > 3)
    row = rest.agg(*[F.max(F.when(F.regexp_like("rest", F.lit(p)), F.regexp_extract("rest", p, 1))).alias(n) for n, p in patterns.items()]).first()
    return row.asDict()


def strings(spark: SparkSession, path: str, name: str) -> DataFrame:
    """value: the items of a top-level array of strings beside the elements."""
    listed = f'"{name}": (\\[(?:\\s*"(?:[^"\\\\]|\\\\.)*",?)*\\s*\\])'
    found = _cut(spark, path, ELEMENT, ELEMENT_END).where(F.length("rest") > 3).select(F.regexp_extract("rest", listed, 1).alias("x")).where("x <> ''")
    return found.select(F.explode(F.from_json("x", "array<string>", {"mode": "FAILFAST"})).alias("value"))


def faults(rows: DataFrame, key: str, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """key, rule: each path whose value is of none of its kinds (names as Spark gives them; VOID for null, missing for nothing)."""
    seen = {p: F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{p}", "variant")), F.lit("missing")) for p in kinds}
    said = [F.when(~seen[p].isin(*allowed), F.concat(F.lit(f"{p} is "), seen[p])) for p, allowed in kinds.items()]
    name = F.coalesce(F.try_variant_get("v", f"$.{key}", "string"), F.lit(""))
    return rows.select(name.alias("key"), F.explode(F.array_compact(F.array(*said))).alias("rule"))


def typed(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Columns of the given types from the elements; null where a field is missing."""
    return rows.select(*[F.variant_get("v", f"$.{n}", t).alias(n) for n, t in fields.items()])


def write_objects(rows: DataFrame, path: str, array: str, head: dict) -> None:
    """Rows as objects in this layout, one file for each partition: the facts of head and one array of all its rows."""
    columns = rows.columns

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["{", f"  {json.dumps(array)}: ["]})
        last = None
        for batch in batches:
            texts = [t for t in batch["value"] if t]
            out = []
            for text in texts:
                if last is not None:
                    out.append(last + ",")
                last = "    " + json.dumps(json.loads(text), ensure_ascii=False, indent=2).replace("\n", "\n    ")
            if out:
                yield pd.DataFrame({"value": out})
        tail = [last] if last is not None else []
        yield pd.DataFrame({"value": [*tail, "  ],", *json.dumps(head, ensure_ascii=False, indent=2).split("\n")[1:]]})

    whole: Column = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows.select(whole.alias("value")).mapInPandas(lines, "value string").write.text(path)
