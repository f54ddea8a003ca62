"""SQL functions equal the Column functions on whole texts of the given tables."""

from pyspark.sql import functions as F

from chatprep.functions import records as RC
from chatprep.functions import text as TX
from chatprep.functions.chat import reply_prefix_content
from chatprep.functions.sql import register_sql_functions
from chatprep.sources.tables import messages_from_events

from .conftest import SF001


def test_sql_functions_match_columns(spark):
    names = register_sql_functions(spark)
    assert "chat_handle" in names
    d = spark.read.parquet(f"{SF001}/documents.parquet").createOrReplaceTempView("docs_t")
    got = spark.sql("""SELECT doc_id, chat_handle(text) AS h, chat_default_sender(substr(text, 1, 0)) AS s,
                              chat_approx_tokens(text) AS n, chat_cut_at_marker(text, '.') AS c,
                              chat_cut_at_newline(text) AS l, chat_strip_prompt(text, substr(text, 1, 5)) AS p
                       FROM docs_t""")
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = docs.select("doc_id", TX.ascii_handle("text").alias("h"), TX.default_sender(F.lit("")).alias("s"),
                       TX.approx_tokens("text").alias("n"), TX.cut_at_marker("text", ".").alias("c"),
                       TX.cut_at_newline("text").alias("l"), TX.strip_prompt("text", F.substr("text", F.lit(1), F.lit(5))).alias("p"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0

    m = messages_from_events(spark, SF001, 3)
    m.createOrReplaceTempView("msgs_t")
    got = spark.sql("""SELECT id, chat_encode_record(id, hhmm, sender, text, reply_to_message_id) AS r,
                              chat_encode_record_prefix(id, hhmm, sender) AS p,
                              chat_reply_prefix_content(text, reply_to_message_id) AS c,
                              chat_iso_to_hhmm(date_format(sent_at, "yyyy-MM-dd'T'HH:mm:ss")) AS t,
                              chat_unix_to_iso(id * 60) AS u, chat_placeholder_text('', sender) AS x FROM msgs_t""")
    want = m.select("id", RC.encode_record("id", "hhmm", "sender", "text", "reply_to_message_id").alias("r"),
                    RC.encode_record_prefix("id", "hhmm", "sender").alias("p"),
                    reply_prefix_content("text", "reply_to_message_id").alias("c"), F.col("hhmm").alias("t"),
                    TX.unix_to_iso(F.col("id") * 60).alias("u"), TX.placeholder_text(F.lit(""), "sender").alias("x"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_sql_iso_edge_cases(spark):
    register_sql_functions(spark)
    got = [r[0] for r in spark.sql("""SELECT chat_iso_to_hhmm(x) FROM VALUES ('2021-3-28T3:30:05'), ('2021-02-30T10:00:00'),
                                      ('2021-01-01T10:00:60'), ('bad') AS t(x)""").collect()]
    assert got == ["03:30", None, None, None]
