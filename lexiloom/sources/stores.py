"""Tables of state: chunks, graph nodes and edges, manifest, failures, caches, traces, conversations.

Each is a Parquet or JSON folder that Spark appends to; there is no update in
place, so the latest row of a key counts and deletions are anti-joins.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EDGE_TYPES, EMBED_PRICE, MAX_CONVERSATIONS, TRACE_BYTES, TRACE_DAYS

CHUNK_SCHEMA = (
    "id string, text string, embedding array<float>, agency string, document_type string, filename string, citation string, section_number string, subsection_id string, "
    "section_title string, authority_level string, jurisdiction string, effective_date string, last_amended_date string, is_table boolean, table_type string, parent_section string, "
    "chunk_index int, content_type string, key_terms array<string>, has_images boolean, metadata_json string, is_scanned boolean, ocr_confidence double, version int, deprecated boolean, created_at timestamp"
)
EDGE_SCHEMA = "src string, dst string, rel_type string, confidence double, description string, resolution string"


# ---- documents and chunks ----------------------------------------------------------------


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, modificationTime, content of the files below a folder, read by Spark."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def file_hash(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("file_hash"))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, common entities are decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head|nav)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))


def needs_ocr(text: Column, pages: Column, least: int = 50) -> Column:
    """Whether a parse has too few characters a page to be a text layer."""
    return F.length(text) / F.greatest(pages, F.lit(1)) < least


def create_table(spark: SparkSession, name: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")
    return spark.table(name)


def append_chunks(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """Writes chunks with their vectors (joined by id) and version, deprecated, created_at."""
    rows = chunks.join(vectors.select("id", F.col("vector").alias("embedding")), "id")
    rows.withColumns({"version": F.lit(1), "deprecated": F.lit(False), "created_at": F.current_timestamp()}).write.mode("append").parquet(path)


def chunk_id(filename: Column, index: Column) -> Column:
    """A reproducible id in place of a random one."""
    return F.sha2(F.concat_ws("\x1f", filename, index.cast("string")), 256)


def by_ids(rows: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """The named columns of the rows with the given ids."""
    return rows.select("id", *columns).join(ids.select("id").distinct(), "id", "left_semi")


def completeness(chunks: DataFrame, fields: tuple[str, ...] = ("agency", "section_title", "authority_level", "citation")) -> DataFrame:
    """Per agency the share (%) of fields that are filled, over all fields and rows."""
    filled = sum((F.when(F.length(F.trim(c)) > 0, 1).otherwise(0) for c in fields), F.lit(0))
    return chunks.groupBy("agency").agg(F.round(F.avg(filled / F.lit(len(fields))) * 100, 1).alias("complete"), F.count("*").alias("n"))


def cost(tokens: DataFrame) -> DataFrame:
    """Tokens and their price."""
    n = F.coalesce(F.sum("tokens"), F.lit(0))
    return tokens.agg(n.cast("long").alias("tokens"), F.round(n / 1e6 * EMBED_PRICE, 6).alias("dollars"))


# ---- graph store -------------------------------------------------------------------------


def load_edges(rows: DataFrame) -> DataFrame:
    """Edges worth storing: with a target and a known type; write with partitionBy('rel_type')."""
    return rows.where(F.col("dst").isNotNull() & F.col("rel_type").isin(list(EDGE_TYPES)))


def merge_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-if-absent by id; of repeated new ids, one."""
    return nodes.unionByName(new.dropDuplicates(["id"]).join(nodes.select("id"), "id", "left_anti").select(*nodes.columns))


def merge_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Insert-if-absent by (src, dst, rel_type); both ends must be nodes, the type must be known."""
    key = ["src", "dst", "rel_type"]
    bad = new.where(~F.col("rel_type").isin(list(EDGE_TYPES))).limit(1).collect()
    if bad:
        raise ValueError(f"unknown edge type {bad[0]['rel_type']}")
    have = nodes.select("id")
    new = new.join(have.withColumnRenamed("id", "src"), "src", "left_semi").join(have.withColumnRenamed("id", "dst"), "dst", "left_semi")
    new = new.dropDuplicates(key).join(edges.select(*key), key, "left_anti")
    return edges.unionByName(new.select(*edges.columns))


# ---- manifest, failures, caches ----------------------------------------------------------


def latest(events: DataFrame, key: str = "path", at: str = "at") -> DataFrame:
    """The last event of each key."""
    rest = [c for c in events.columns if c not in (key, at)]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("e"), F.max(at).alias(at)).select(key, at, *[f"e.{c}" for c in rest])


def unprocessed(paths: DataFrame, manifest: DataFrame, resume_failed: bool = False) -> DataFrame:
    """Paths to process: not complete, and failed ones only when resuming."""
    rows = paths.join(manifest.select("path", "status"), "path", "left")
    skip = ["complete"] if resume_failed else ["complete", "failed"]
    return rows.where(F.col("status").isNull() | ~F.col("status").isin(skip)).select("path")


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """Counts by status and chunks, in total (agency null) and by agency."""
    manifest.createOrReplaceTempView("__manifest")
    return manifest.sparkSession.sql(
        "SELECT agency, count(*) AS n, count_if(status = 'complete') AS complete, count_if(status = 'failed') AS failed, count_if(status = 'in_progress') AS in_progress, "
        "coalesce(sum(chunk_count), 0) AS chunks FROM __manifest GROUP BY GROUPING SETS ((), (agency))"
    )


def log_failure(spark: SparkSession, path: str, rows: DataFrame) -> None:
    rows.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """Lines of JSON; bad lines are skipped, and of a key the last line (by file and place) counts."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if not key:
        return rows
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__f"), F.desc("__o")))
    rows = rows.select("*", F.col("_metadata.file_name").alias("__f"), F.monotonically_increasing_id().alias("__o"))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n", "__f", "__o")


# ---- traces and conversations ------------------------------------------------------------


def split_traces(traces: DataFrame, most: int = TRACE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(inline, offloaded): trace text of at most ``most`` bytes stays in its row."""
    big = F.octet_length("trace_json") > most
    return traces.where(~big), traces.where(big)


def read_traces(inline: DataFrame, offloaded: DataFrame) -> DataFrame:
    """Traces from either place, the offloaded one first."""
    both = inline.select("id", F.col("trace_json").alias("a")).join(offloaded.select("id", F.col("trace_json").alias("b")), "id", "full")
    return both.select("id", F.coalesce("b", "a").alias("trace_json"))


def stages(events: DataFrame) -> DataFrame:
    """trace_id, stages: its (stage, elapsed_ms, timestamp, data) in order."""
    return events.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "stage", "elapsed_ms", "data"))).alias("stages"))


def expired(rows: DataFrame, now: Column, days: int = TRACE_DAYS) -> DataFrame:
    """Rows older than the retention."""
    return rows.where(F.col("created_at") < now - F.make_dt_interval(F.lit(days)))


def orphans(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    return conversations.join(messages.select(F.col("conversation_id").alias("id")), "id", "left_anti")


def over_cap(conversations: DataFrame, most: int = MAX_CONVERSATIONS) -> DataFrame:
    """Each user's oldest conversations beyond the cap."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.desc("id")))
    return conversations.withColumn("n", n).where(F.col("n") > most).drop("n")


def owned(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows whose conversation belongs to one of the owners."""
    return rows.join(owners.select("user_id"), "user_id", "left_semi")


def cascade_delete(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select("id")
    return conversations.join(ids, "id", "left_anti"), messages.join(ids.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_anti")


def register(users: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) new users by e-mail, case apart; of repeated new ones the first by id."""
    first = F.row_number().over(Window.partitionBy(F.lower("email")).orderBy("id"))
    new = new.withColumn("first", first == 1).withColumn("key", F.lower("email"))
    taken = users.select(F.lower("email").alias("key")).distinct().withColumn("taken", F.lit(True))
    rows = new.join(taken, "key", "left").withColumn("ok", F.col("first") & F.col("taken").isNull()).drop("key", "first", "taken")
    return rows.where("ok").drop("ok"), rows.where("not ok").drop("ok")


def load_nodes(chunks: DataFrame) -> DataFrame:
    """Chunks as graph nodes: missing texts empty, a missing index 0, a missing document type substantive, none deprecated."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("id", "agency", "citation", "section_number", "authority_level")]
    kind = F.coalesce("document_type", F.lit("substantive")) if "document_type" in chunks.columns else F.lit("substantive")
    return chunks.select(*texts, kind.alias("document_type"), F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("chunk_index", F.lit(0)).cast("long").alias("chunk_index"), F.lit(0).cast("tinyint").alias("deprecated"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session on one machine names none (as in tests) a folder is
    made and set; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def drop_store(spark: SparkSession, path: str) -> bool:
    """Deletes a store's folder, in whatever file system it is; whether it was there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def list_conversations(conversations: DataFrame, user: Column) -> DataFrame:
    """A user's conversations, the newest first."""
    return conversations.where(F.col("user_id") == user).orderBy(F.desc("updated_at"), F.desc("id"))


def list_messages(messages: DataFrame, conversation: Column) -> DataFrame:
    """A conversation's messages, the oldest first."""
    return messages.where(F.col("conversation_id") == conversation).orderBy("created_at", "id")


def update_conversations(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """Conversations with the latest change(id, title, at) of each: its title, where it has one, and its time as updated_at."""
    last = changes.groupBy("id").agg(F.max_by("title", "at").alias("__title"), F.max("at").alias("__at"))
    rows = conversations.join(last, "id", "left")
    return rows.withColumns({"title": F.coalesce("__title", "title"), "updated_at": F.greatest("__at", "updated_at")}).drop("__title", "__at")
