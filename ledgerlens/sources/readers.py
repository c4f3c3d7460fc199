"""Sources: delimited bulk files with rejects, multi-record files, landed JSON pages, HTML rows, latest-file scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.text import clean, parse_amount, parse_date


def latest_file(spark: SparkSession, folder: str, prefix: str, suffix: str = ".txt") -> str | None:
    """Path of the newest file by modification time, the last name if tied; reads the listing only."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*{suffix}").load(folder).select("path", "modificationTime")
    found = rows.orderBy(F.desc("modificationTime"), F.desc("path")).limit(1).collect()
    return found[0]["path"] if found else None


def read_delimited(spark: SparkSession, path: str, aliases: dict[str, list[str]] | None = None, sep: str = "\t") -> DataFrame:
    """Header file as strings; columns are renamed by their aliases (case and blanks ignored), blanks become null."""
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False, quote='"', escape='"', multiLine=False, mode="PERMISSIVE")
    known = {c.strip().lower(): c for c in raw.columns}
    out = [clean(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns]
    if aliases:
        out = []
        for name, others in aliases.items():
            hit = next((known[a.strip().lower()] for a in [name, *others] if a.strip().lower() in known), None)
            out.append((clean(F.col(f"`{hit}`")) if hit else F.lit(None).cast("string")).alias(name))
    return raw.select(*out)


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns parsed by kind (money, date, int, bool, text); a bad value is null, never an error."""

    def cast(c: str, kind: str) -> Column:
        col = F.col(c)
        if kind == "money":
            return parse_amount(col)
        if kind == "date":
            return parse_date(col)
        if kind == "int":
            return F.trim(col).try_cast("bigint")
        if kind == "bool":
            low = F.lower(F.trim(col))
            return F.when(low.isin("true", "t", "yes", "y", "1"), True).when(low.isin("false", "f", "no", "n", "0"), False)
        return clean(col)

    return df.select(*[cast(c, kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def split_rejects(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with `reject_reason`): the first rule that holds rejects a row."""
    reason = F.lit(None).cast("string")
    for name, test in reversed(rules):
        reason = F.when(test, F.lit(name)).otherwise(reason)
    marked = df.withColumn("reject_reason", reason)
    return marked.where("reject_reason IS NULL").drop("reject_reason"), marked.where("reject_reason IS NOT NULL")


def read_expenditures(spark: SparkSession, path: str, extreme: float = 10_000_000.0) -> tuple[DataFrame, DataFrame]:
    """Tab-delimited expenditures: typed, with rejects for bad amounts, unknown parts and rows that both support and oppose."""
    aliases = {"committee_id": ["CommitteeID"], "payee": ["LastOnlyName", "PayeeName"], "amount": ["Amount"], "expended_date": ["ExpendedDate"], "d2_part": ["D2Part"], "supporting": ["Supporting"], "opposing": ["Opposing"]}
    rows = typed(read_delimited(spark, path, aliases), {"committee_id": "int", "amount": "money", "expended_date": "date", "supporting": "bool", "opposing": "bool"})
    rules = [
        ("missing_committee", F.col("committee_id").isNull()),
        ("bad_amount", F.col("amount").isNull()),
        ("extreme_amount", F.abs("amount") > extreme),
        ("unknown_part", ~F.coalesce(F.substring("d2_part", 1, 1).isin("6", "7", "8", "9"), F.lit(False))),
        ("supports_and_opposes", F.coalesce(F.col("supporting") & F.col("opposing"), F.lit(False))),
    ]
    return split_rejects(rows, rules)


#: Record types of the multi-record file and the number of fields each needs.
RECORD_FIELDS = {"H": 3, "1": 6, "2": 6, "D": 4, "R": 4, "A": 6, "B": 6, "E": 3}


def read_records(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """(record_type, fields, line, bad): pipe file whose first field names the record type; short or unknown records are marked bad."""
    parts = F.split("value", f"\\{sep}")
    need = F.create_map(*[F.lit(x) for kv in RECORD_FIELDS.items() for x in kv])
    rows = spark.read.text(path).where(F.trim("value") != "")
    kind = F.upper(F.trim(F.get(parts, F.lit(0))))
    return rows.select(kind.alias("record_type"), parts.alias("fields"), F.col("value").alias("line")).withColumn("bad", F.col("record_type").isNull() | F.element_at(need, F.col("record_type")).isNull() | (F.size("fields") < F.element_at(need, F.col("record_type"))))


def records_for_state(records: DataFrame, state: str, state_types: tuple[str, ...] = ("1", "2"), ein_at: int = 2, state_at: int = 5) -> DataFrame:
    """All records of organizations that any registration record places in the state (a semi join, no driver list)."""
    ein = F.trim(F.get("fields", F.lit(ein_at)))
    keyed = records.where("NOT bad").withColumn("ein", ein)
    own = keyed.where(F.col("record_type").isin(*state_types) & (F.upper(F.trim(F.get("fields", F.lit(state_at)))) == state)).select("ein").distinct()
    return keyed.join(own, "ein", "left_semi")


def read_json_pages(spark: SparkSession, path: str, schema: T.StructType | str, key: str, version: str) -> DataFrame:
    """Rows of landed JSON pages, one per key, the latest version; malformed lines go to _corrupt_record when the schema has it."""
    from ledgerlens.operators.filings import pick_first

    return pick_first(spark.read.schema(schema).json(path), [key], [F.col(version).desc_nulls_last()])


def html_table(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keep..., row, cells) of every table row in raw HTML, by regular expressions on the JVM."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))
    found = pages.select(*keep, F.posexplode(rows).alias("row", "markup"))
    cells = F.transform(F.regexp_extract_all("markup", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), plain)
    return found.select(*keep, "row", cells.alias("cells"))
