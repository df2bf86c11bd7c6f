"""Stored answers of providers as a data source: files by provider and day, pruned and read by the filters that a query pushes down.

    spark.dataSource.register(StoredAnswers)
    spark.read.format("quern_answers").option("path", folder).load().where("provider = 'news' and fetched_at >= timestamp'2024-01-02'")

The session needs spark.sql.python.filterPushdown.enabled. Filters on provider (equality, in) and on fetched_at (bounds) never reach Spark; all others stay with it.
Each file is a partition of its own, read in Arrow batches on an executor. Folders are local ones or what pyarrow's file systems open (hdfs://, s3://).
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "provider string, fetched_at timestamp, place int, url string, title string, snippet string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def store(answers: DataFrame, path: str, mode: str = "append") -> None:
    """Write answers (the columns of SCHEMA) as StoredAnswers reads them. Answers without a provider or a time can't be placed and are refused by a null check."""
    own = answers.select(*[x.split()[0] for x in SCHEMA.split(", ")])
    own = own.withColumns({x: F.when(F.col(x).isNull(), F.raise_error(F.lit(f"an answer needs its {x}"))).otherwise(F.col(x)) for x in ("provider", "fetched_at")})
    own.withColumn("p", F.col("provider")).withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("fetched_at") / 86_400).cast("int"))).repartition("p", "day").write.mode(mode).partitionBy("p", "day").parquet(path)


class AnswerFile(InputPartition):
    def __init__(self, file: str) -> None:
        self.file = file


class AnswerReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.providers: set[str] | None = None
        self.bounds: list[tuple[str, datetime]] = []

    def pushFilters(self, filters):
        for x in filters:
            if isinstance(x, (EqualTo, In)) and x.attribute == ("provider",):
                own = {x.value} if isinstance(x, EqualTo) else set(x.value)
                self.providers = own if self.providers is None else self.providers & own
            elif isinstance(x, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and x.attribute == ("fetched_at",):
                sign = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}[type(x)]
                self.bounds.append((sign, x.value))
            else:
                yield x

    def files(self) -> list[str]:
        """The files that may hold an answer: by the folders' names alone."""
        from urllib.parse import unquote

        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        out = []
        for info in where.get_file_info(fs.FileSelector(base, recursive=True)):
            parts = dict(x.split("=", 1) for x in info.path.split("/") if "=" in x)
            if info.type != fs.FileType.File or not info.path.endswith(".parquet") or "p" not in parts:
                continue
            if self.providers is not None and unquote(parts["p"]) not in self.providers:
                continue
            # A day holds times from its beginning to its end, in UTC.
            day = datetime.strptime(parts["day"], "%Y-%m-%d").date()
            if all(b.astimezone(UTC).date() <= day if s[0] == ">" else day <= b.astimezone(UTC).date() for s, b in self.bounds):
                out.append(info.path)
        return sorted(out)

    def partitions(self):
        return [AnswerFile(x) for x in self.files()] or [AnswerFile("")]

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow import fs

        if not partition.file:
            return
        where = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in pq.ParquetFile(where.open_input_file(partition.file)).iter_batches(columns=names):
            # Spark may write times without their zone: they are UTC.
            at, keep = batch.schema.get_field_index("fetched_at"), None
            own = batch.column(at).cast(pa.timestamp("us", batch.schema.field(at).type.tz))
            batch = batch.set_column(at, pa.field("fetched_at", pa.timestamp("us", "UTC")), own.cast(pa.timestamp("us", "UTC")) if own.type.tz else pc.assume_timezone(own, "UTC"))
            for sign, bound in self.bounds:
                own = {">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}[sign](batch.column(at), pa.scalar(bound.astimezone(UTC), pa.timestamp("us", "UTC")))
                keep = own if keep is None else pc.and_(keep, own)
            yield batch if keep is None else batch.filter(keep)


class StoredAnswers(DataSource):
    """Format quern_answers; option path: the folder of the stored answers."""

    @classmethod
    def name(cls) -> str:
        return "quern_answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AnswerReader:
        return AnswerReader(self.options)


def answers(spark, path: str) -> DataFrame:
    """The stored answers under path; filters on provider and fetched_at choose the files that are read."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(StoredAnswers)
    return spark.read.format("quern_answers").option("path", path).load()
