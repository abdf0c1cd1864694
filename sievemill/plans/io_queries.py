"""Queries over readers and sinks: what is written to the shared folder is read back and compared with its tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import registry
from ..functions.words import n_words
from ..operators import cleaning as C
from ..operators import formatting as FT
from ..sources import io
from ..session import shared_dir, table
from ..streaming import events as S
from .corpus_queries import _TOK, docs, w


def place(spark, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_dir(spark)}/io-{name}-{uuid.uuid4().hex}"


_PARTS = "(SELECT unnest(string_split(text, '<|endoftext|>')) AS part FROM documents WHERE text IS NOT NULL)"


@query("delimited_texts", rf"SELECT sha256(t) AS digest, count(*)::BIGINT AS n FROM (SELECT regexp_replace(part, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g') AS t FROM {_PARTS}) WHERE length(t) > 0 GROUP BY 1")
def delimited_texts(spark, d):
    """The corpus as texts with separators, read back; a separator inside a text parts it."""
    path = place(spark, "texts")
    io.write_concatenated(docs(spark, d).where(F.col("text").isNotNull()), path)
    return io.read_delimited(spark, path).groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"))


@query("document_folders", "SELECT source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1")
def document_folders(spark, d):
    """One folder per source, read back."""
    path = place(spark, "folders")
    io.write_documents(docs(spark, d).select("doc_id", "text", "n_chars", "source"), path, "source")
    return io.read_tables(spark, path).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("reject_log", f"""SELECT reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN length(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f]+', '', 'g')) = 0 THEN 'empty_text' WHEN len({w('text')}) < 100 THEN 'too_short' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY 1""")
def reject_log(spark, d):
    """Rejects of two stages, added to one log of JSON lines, read back without loss."""
    path, df = place(spark, "rejects"), docs(spark, d)
    empty = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r\f]+", "")) == 0
    io.write_rejects([C.reject(df.where(empty), "doc_id", "source", "clean", F.lit("empty_text"))], path)
    io.write_rejects([C.reject(df.where(~empty & (n_words("text") < 100)), "doc_id", "source", "clean", F.lit("too_short"))], path)
    log, _ = io.read_log(spark, path, "id string, reason string, stage string")
    return log.groupBy("reason").agg(F.count("*").alias("n"))


@query("token_sink", f"SELECT count(*)::BIGINT AS n_rows, sum(len(ids))::BIGINT AS n_tokens, max(list_max(ids))::INT AS largest_id FROM (SELECT {_TOK.format(w('text'))} AS ids FROM documents)")
def token_sink(spark, d):
    rows = docs(spark, d).select(FT.word_ids(F.col("text")).alias("ids"))
    return io.write_tokens(rows, place(spark, "tokens")).select("n_rows", "n_tokens", "largest_id")


@query("baseline_snapshot", "SELECT 1 AS version, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars FROM documents UNION ALL SELECT 2, count(*)::BIGINT, sum(n_chars)::BIGINT FROM documents WHERE lang = 'en'")
def baseline_snapshot(spark, d):
    """Two versions; what is written again under a version changes nothing."""
    path, df = place(spark, "baseline"), docs(spark, d).select("doc_id", "n_chars", "lang")
    for version, rows in (("1", df), ("2", df.where("lang = 'en'")), ("1", df.limit(0))):
        io.snapshot(rows, path, version)
    return io.read_tables(spark, path).groupBy(F.col("version").cast("int").alias("version")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("markdown_stats", "SELECT coalesce(content_tier, '') AS content_tier, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def markdown_stats(spark, d):
    """Statistics as a Markdown table in a text file, read back."""
    path = place(spark, "markdown")
    stats = docs(spark, d).groupBy("content_tier").agg(F.count("*").alias("n"))
    io.to_markdown(stats, "Tiers").select(F.col("text").alias("value")).write.text(path)
    texts = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    return io.parse_markdown(texts, "tiers").select(F.col("row")["content_tier"].alias("content_tier"), F.col("row")["n"].cast("long").alias("n"))


@query("document_files", "SELECT count(*)::BIGINT AS n_files, 2::BIGINT AS n_malformed, count(DISTINCT question_id)::BIGINT AS n_ids FROM eval_questions")
def document_files(spark, d):
    """One JSON file per question and two broken ones, scanned."""
    path = place(spark, "files")
    questions = table(spark, d, "eval_questions").select("question_id", F.to_json(F.struct(F.col("question_id").alias("id"), F.col("question").alias("text")), {"pretty": "true"}).alias("value"))
    broken = spark.createDataFrame([("broken-1", '{"id": '), ("broken-2", "")], "question_id string, value string")
    questions.unionByName(broken).repartition(1).write.partitionBy("question_id").option("maxRecordsPerFile", 1).format("text").save(path)
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    parsed = io.parse_lines(texts, "value", io.RAW)
    return parsed.agg(F.count_if("_ok").alias("n_files"), F.count_if(~F.col("_ok")).alias("n_malformed"), F.count_distinct("id").alias("n_ids"))


@query("sql_functions", "SELECT doc_id, sha256(nfc_normalize(text)) AS digest, CASE WHEN text IS NULL THEN 100.0 ELSE 100.0 END::DOUBLE AS own_ratio FROM documents")
def sql_functions(spark, d):
    """The library's functions called by name in SQL."""
    registry.register(spark)
    docs(spark, d).createOrReplaceTempView("__documents")
    return spark.sql("SELECT doc_id, sha2(nfc_text(text), 256) AS digest, fuzzy_ratio(text, text) AS own_ratio FROM __documents")


@query("stream_first_seen", "SELECT user_id, event_type, count(*)::BIGINT AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events WHERE ts IS NOT NULL) GROUP BY 1, 2")
def stream_first_seen(spark, d):
    """The events as a stream, each user, type and day once, run until all is read."""
    path = place(spark, "stream")
    stream = S.read_events(spark, f"{d}/events.parquet").withColumn("day", F.date_trunc("day", "ts"))
    S.run_available(S.first_seen(stream, ["user_id", "event_type", "day"]), path)
    return spark.read.parquet(path).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
