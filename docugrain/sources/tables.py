"""Sources and sinks: tables, uploads, provisions, usage and reviews."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PROVISION = "id string, source string, article string, title string, text string, keywords array<string>, law_number string, paragraph string, authority string, document_type string, topics array<string>, applicable_documents array<string>, effective_from date, effective_to date, status string, official_url string, content_hash string, verified boolean"
REVIEW = "risk_score int, score_rationale string, summary string, risks array<struct<title:string,severity:string,finding:string,evidence:string>>, recommendations array<string>, key_metrics array<struct<label:string,value:string,note:string>>, advisor_questions array<string>, references array<struct<source:string,article:string,title:string>>"


# The tables of the legal corpus and of usage, with the keys that their rows are unique by.
TABLES = {
    "raw_legal_document": ("id long, source_title string, authority string, official_url string, retrieved_at timestamp, content_hash string, media_type string, raw_content binary", ["official_url", "content_hash"]),
    "legal_provision": ("id long, raw_document_id long, provision_key string, source_title string, law_number string, article string, paragraph string, title string, provision_text string, authority string, document_type string, topics string, applicable_documents string, keywords string, effective_from date, effective_to date, status string, official_url string, content_hash string, verified boolean, embedding array<float>, created_at timestamp, updated_at timestamp", ["provision_key"]),
    "legal_version": ("id long, provision_id long, valid_from date, valid_to date, provision_text string, content_hash string, change_source_url string", ["provision_id", "valid_from"]),
    "legal_relation": ("source_provision_id long, target_provision_id long, relation_type string", ["source_provision_id", "target_provision_id", "relation_type"]),
    "audit_reference": ("audit_id string, provision_id long, retrieval_score double, cited_at timestamp", ["audit_id", "provision_id"]),
    "device_usage": ("device_id string, month string, used_count long", ["device_id", "month"]),
}


@dataclass(frozen=True)
class Settings:
    """Defaults, which the session's configuration replaces: spark.docugrain.<name>."""

    max_pdf_bytes: int = 15_728_640
    audit_rate_limit_per_hour: int = 5
    free_monthly_limit: int = 5
    result_limit: int = 8
    token_secret: str = ""
    usage_database_url: str = ""

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        found = {f.name: spark.conf.get(f"spark.docugrain.{f.name}", None) for f in fields(cls)}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in found.items() if v is not None})


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Makes the tables that aren't there; those that are stay as they are."""
    for name, (columns, _) in TABLES.items():
        spark.sql(f"create table if not exists {database}.{name} ({columns}) using parquet")


def conflicts(rows: DataFrame, name: str) -> DataFrame:
    """Keys of a table's rows that occur more than once, as parquet tables have no unique keys of their own."""
    return rows.groupBy(*TABLES[name][1]).count().where("count > 1")


def provision_rows(stored: DataFrame) -> DataFrame:
    """Rows of the legal_provision table as provisions: 18 columns, JSON texts as arrays; a bad or null array text is an empty array."""
    listed = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return stored.select(
        F.col("provision_key").alias("id"), F.col("source_title").alias("source"), "article", "title", F.col("provision_text").alias("text"), listed("keywords").alias("keywords"), "law_number", "paragraph", "authority", "document_type",
        listed("topics").alias("topics"), listed("applicable_documents").alias("applicable_documents"), "effective_from", "effective_to", "status", "official_url", "content_hash", "verified",
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows of path, length and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)


def provisions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of provisions by its schema, never inferred."""
    return spark.read.schema(PROVISION).option("multiLine", True).option("mode", "FAILFAST").json(path)


def provisions_jdbc(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """The same from a database; filters are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable="legal_provision", **options).load()


def write_reviews(reviews: DataFrame, path: str) -> None:
    reviews.write.mode("append").json(path)


def upsert_usage(batch: DataFrame, path: str, device: str, month: str = "month", lease: float = 3600.0) -> DataFrame:
    """Adds the counts of a batch to the table at path and returns what it holds then.

    The table is a folder for each month with its versions, v=1, v=2 and so on; only months that the batch touches get a new
    one. A writer claims the next version of a month by creating its claim, which only one can, works on the last version that is
    done, moves what it wrote into place and marks it done. Another writer waits for that and goes on from it, so no count is lost; a claim that
    isn't done after ``lease`` seconds counts as that of a writer that is gone. Readers see versions that are done; of those, the last two stay."""
    spark = batch.sparkSession
    added = written(batch.groupBy(device, month).agg(F.count(F.lit(1)).alias("used_count")), "usage")
    # Months are few; in order, so that two writers never wait for each other.
    months = [r[0] for r in added.select(month).where(F.col(month).isNotNull()).distinct().orderBy(month).collect()]
    files = _Files(spark)
    claims = {m: _claim(files, f"{path}/month={m}", lease) for m in months}
    if claims:
        before = [f"{path}/month={m}/v={done}" for m, (_, done) in claims.items() if done]
        both = spark.read.schema(added.schema).parquet(*before).unionByName(added) if before else added
        rows = both.where(F.col(month).isNotNull()).groupBy(device, month).agg(F.sum("used_count").alias("used_count"))
        staged = f"{path}/_staging-{uuid.uuid4().hex}"
        rows.withColumn("_month", F.col(month)).write.partitionBy("_month").parquet(staged)
        for m, (version, done) in claims.items():
            files.move(f"{staged}/_month={m}", f"{path}/month={m}/v={version}")
            files.create(f"{path}/month={m}/v={version}/_SUCCESS")
            for old in (v for v in _versions(files, f"{path}/month={m}")[1] if v < done):
                files.remove(f"{path}/month={m}/v={old}")
        files.remove(staged)
    return usage_table(spark, path, added.schema)


class _Files:
    """The few calls of the table's file system that versions need."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def names(self, path: str) -> list[tuple[str, float]]:
        """Names and times of change in a folder; none if it isn't there."""
        p, system = self.at(path)
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in system.listStatus(p)] if system.exists(p) else []

    def exists(self, path: str) -> bool:
        p, system = self.at(path)
        return system.exists(p)

    def create(self, path: str) -> bool:
        p, system = self.at(path)
        system.mkdirs(p.getParent())
        return system.createNewFile(p)

    def move(self, source: str, target: str) -> None:
        (a, system), (b, _) = self.at(source), self.at(target)
        if not system.rename(a, b):
            raise OSError(f"{source} could not be moved to {target}")

    def remove(self, path: str) -> None:
        p, system = self.at(path)
        system.delete(p, True)


def _versions(files: _Files, folder: str) -> tuple[dict[int, float], list[int]]:
    """Claims of a month with their times, and versions that are done, in order."""
    names = files.names(folder)
    return {int(n[7:]): t for n, t in names if n.startswith("_claim-")}, sorted(int(n[2:]) for n, _ in names if n.startswith("v=") and files.exists(f"{folder}/{n}/_SUCCESS"))


def _claim(files: _Files, folder: str, lease: float) -> tuple[int, int]:
    """(version, last version that is done): a version that is this writer's alone."""
    while True:
        claims, done = _versions(files, folder)
        last, ready = max(claims, default=0), max(done, default=0)
        if last > ready and time.time() - claims[last] < lease:
            time.sleep(0.1)
        elif files.create(f"{folder}/_claim-{max(last, ready) + 1}"):
            # What was done between the look and the claim counts, too.
            return max(last, ready) + 1, max(_versions(files, folder)[1], default=0)


def usage_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What the last version of each month holds."""
    files, last = _Files(spark), []
    for name, _ in files.names(path):
        if name.startswith("month="):
            done = _versions(files, f"{path}/{name}")[1]
            last += [f"{path}/{name}/v={done[-1]}"] if done else []
    return spark.read.schema(schema).parquet(*last) if last else spark.createDataFrame([], schema)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset, a temporary folder in local mode; on a cluster, an error, as executors share no local folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (at or f"file://{tempfile.mkdtemp(prefix='docugrain-')}").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed as the program ends."""
    path = f"{shared_folder(spark)}/docugrain-{uuid.uuid4().hex}/{name}"
    atexit.register(forget, spark, path.rpartition("/")[0])
    return path


def forget(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM ended before us: the cluster's own clean-up has it
        pass


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table in the shared folder: worked out once, whatever reads them."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
