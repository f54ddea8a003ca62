import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from chatprep.session import get_spark
    s = get_spark("local[4]", app="chatprep-tests", shuffle_partitions=4)
    yield s
    s.stop()


def messages_df(spark, rows):
    """rows: (chat_id, id, 'YYYY-MM-DD HH:MM:SS', sender, text, reply)"""
    from pyspark.sql import functions as F
    from chatprep import constants as K
    df = spark.createDataFrame(rows, "chat_id bigint, id bigint, ts string, sender string, text string, "
                                     "reply_to_message_id bigint")
    sent = F.col("ts").cast("timestamp_ntz")
    return df.select("chat_id", "id", sent.alias("sent_at"), F.date_format(sent, K.TIME_FORMAT).alias("hhmm"),
                     "sender", "text", "reply_to_message_id")
