"""Reading event logs: raw delimited lines, and quoted five-column CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.columns import literal_split, strip, whole_number
from ..operators.lineage import own_session

CSV5 = "user string, item string, category string, behavior string, ts string"


def read_lines(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """``value`` per line, read in at least ``min_partitions`` splits if asked (and if there are as many bytes).

    The scan itself is cut smaller; no line is shuffled. How Spark cuts a scan is a setting of the
    session, so the lines then belong to a session of their own with the same settings else.
    """
    if not min_partitions:
        return spark.read.text(path)
    # with a cost of opening, small files would be one split
    own = own_session(spark, {"spark.sql.files.minPartitionNum": str(min_partitions), "spark.sql.files.openCostInBytes": "1"})
    return own.read.text(path)


def parse(lines: DataFrame, cfg: EngineConfig) -> DataFrame:
    """``user_id, item_id, behavior, status`` for every line of ``lines(value)``.

    The status is decided in this order: blank or short lines are INVALID; then, with
    ``has_header``, a line whose user field holds "user" or item field "item" is HEADER;
    then ids that are no 64-bit numbers are INVALID; then BUY, PV, or FILTERED.
    """
    line = strip(F.col("value"))
    # a generator keeps the optimizer from copying the split into every use of a field
    once = lambda *columns: F.inline(F.array(F.struct(*columns)))
    fields = lines.select(once(F.coalesce(line, F.lit("")).alias("line"))).select(once(F.col("line"), literal_split(F.col("line"), cfg.delimiter).alias("f")))
    at = lambda i: strip(F.get("f", F.lit(i)))
    need = max(cfg.user_index, cfg.item_index, cfg.behavior_index) + 1
    cut = fields.select("line", F.size("f").alias("n"), at(cfg.user_index).alias("u"), at(cfg.item_index).alias("i"), F.lower(at(cfg.behavior_index)).alias("behavior"))
    numbers = cut.select("*", whole_number(F.col("u")).alias("user_id"), whole_number(F.col("i")).alias("item_id"))
    header = F.lower("u").contains("user") | F.lower("i").contains("item")
    status = F.when((F.col("line") == "") | (F.col("n") < need), "INVALID")
    if cfg.has_header:
        status = status.when(header, "HEADER")
    status = status.when(F.col("user_id").isNull() | F.col("item_id").isNull(), "INVALID").when(F.col("behavior") == "buy", "BUY").when(F.col("behavior") == "pv", "PV").otherwise("FILTERED")
    return numbers.select("user_id", "item_id", "behavior", status.alias("status"))


def observations(parsed: DataFrame) -> DataFrame:
    """The valid rows: ``user_id, item_id, behavior`` with behavior buy or pv."""
    return parsed.where(F.col("status").isin("BUY", "PV")).select("user_id", "item_id", "behavior")


#: Quotes are doubled within quoted fields, a backslash is a character like others, nothing is trimmed.
CSV_FORM = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8", "mode": "PERMISSIVE", "maxColumns": "1000000"}
#: A line that is a record of its own: every field without quotes, or quoted with quotes doubled.
WHOLE_RECORD = r'^(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)(?:,(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+))*+$'
MARK = "\ufeff"


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line is not a record of its own, as where a quoted field holds a line end.

    One scan of the text, which ends early where there is such a line.
    """
    line = F.regexp_replace("value", f"^{MARK}", "")
    return not spark.read.text(path).where(~line.rlike(WHOLE_RECORD)).isEmpty()


def detect_header(spark: SparkSession, path: str) -> bool:
    """Whether the first row of a CSV file has fewer than five columns or no numbers for user and item."""
    first = spark.read.csv(path, header=False, multiLine=True, lineSep="\n", **CSV_FORM).limit(1).collect()
    if not first:
        raise ValueError("the input CSV is empty")
    row = [str(x or "").lstrip(MARK).strip() for x in first[0]]
    number = lambda x: x.lstrip("+-").isdigit()
    return len(row) < 5 or not number(row[0]) or not number(row[1])


def read_csv5(spark: SparkSession, path: str, header: str = "auto", multi_line: bool | None = None) -> DataFrame:
    """Events of a five-column CSV: quoted fields, optional byte-order mark, further columns ignored.

    Quotes within a quoted field are doubled, and it may hold commas, backslashes and line ends. Files whose
    lines are all records (found by a scan of the text where ``multi_line`` is None) are read in
    splits; others one file to a task, since only its beginning tells which quotes open a field.
    """
    skip = detect_header(spark, path) if header == "auto" else header == "yes"
    form = dict(CSV_FORM)
    if spans_lines(spark, path) if multi_line is None else multi_line:
        # told the line end, the reader keeps others within fields as they are; a CR before it is trimmed from the last field
        form |= {"multiLine": "true", "lineSep": "\n"}
    return clean_events(spark.read.csv(path, schema=CSV5, header=skip, enforceSchema=True, **form))


def clean_events(raw: DataFrame) -> DataFrame:
    """``user_id, user, item_id, item, behavior, ts`` of rows with numbers for user, item and time and some behavior.

    The category is dropped here. ``user``, ``item`` and ``ts`` keep the text of the source.
    """
    plain = raw.select(strip(F.regexp_replace("user", f"^{MARK}", "")).alias("user"), strip(F.col("item")).alias("item"), F.lower(strip(F.col("behavior"))).alias("behavior"), strip(F.col("ts")).alias("ts"))
    typed = plain.select(whole_number(F.col("user")).alias("user_id"), "user", whole_number(F.col("item")).alias("item_id"), "item", "behavior", "ts")
    return typed.where("user_id is not null and item_id is not null and behavior <> ''").where(whole_number(F.col("ts")).isNotNull())
