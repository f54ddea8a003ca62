"""Hand-written edge cases of the scalar functions."""

from pyspark.sql import functions as F

from chatprep.functions import chat as CH
from chatprep.functions import records as RC
from chatprep.functions import text as TX
from chatprep.operators.responses import parse_responses


def one(spark, col, schema="s string", rows=None):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col).collect()]


def test_default_sender(spark):
    assert one(spark, TX.default_sender("s"), rows=[(None,), ("",), ("Nimi",)]) == ["Anonym", "Anonym", "Nimi"]


def test_ascii_handle(spark):
    rows = [("Mökkiläinen",), ("😀😀",), ("a" * 70 + "b",), ("Åsa Öberg-Ström",), ("x²_y",), (None,)]
    assert one(spark, TX.ascii_handle("s"), rows=rows) == ["Mokkilainen", "", "a" * 60, "AsaObergStrom", "xy", "Anonym"]


def test_chat_name_emoji_only(spark):
    assert one(spark, CH.chat_name("s"), rows=[("😀",), ("Some!",)]) == ["Anonym", "Some"]


def test_clock_functions(spark):
    assert one(spark, TX.iso_to_hhmm("s"), rows=[("2021-11-01T00:08:32",), ("2021-11-01T23:59:59",), ("bad",)]) == \
        ["00:08", "23:59", None]
    assert one(spark, TX.unix_to_iso("x"), "x bigint", [(0,), (1635725312,)]) == \
        ["1970-01-01T00:00:00", "2021-11-01T00:08:32"]
    assert one(spark, TX.unix_to_iso("x", "Europe/Helsinki"), "x bigint", [(1635725312,)]) == ["2021-11-01T02:08:32"]


def test_placeholder(spark):
    rows = [("", "😀"), (None, None), ("hei", "😀"), ("", "")]
    got = one(spark, TX.placeholder_text("t", "e"), "t string, e string", rows)
    assert got == ["😀", "(image or file)", "hei", "(image or file)"]


def test_records_roundtrip_and_decode(spark):
    rows = [(1, "12:00", "Anna", 'quote " ; \\ \n nan 😀', None), (2, "00:01", "", "[1] plain", 1)]
    df = spark.createDataFrame(rows, "id bigint, t string, f string, x string, r bigint")
    enc = df.select(RC.encode_record("id", "t", "f", "x", "r").alias("e"))
    assert enc.first().e == '[MSG]1[FS]12:00[FS]Anna[FS]quote " ; \\ \n nan 😀[FS][MEG]'
    dec = enc.select(RC.decode_record("e").alias("d")).collect()
    assert [tuple(r.d) for r in dec] == [("1", "12:00", "Anna", 'quote " ; \\ \n nan 😀', ""),
                                         ("2", "00:01", "", "[1] plain", "1")]
    bad = ["no markers", "[MSG]1[FS]2[FS]3[MEG]", "[MSG]1[FS]2[FS]3[FS]4[FS]5[FS]6[MEG]", "[MSG]a[FS]b[FS]c[FS]d[MEG]"]
    got = one(spark, RC.decode_record("s"), rows=[(b,) for b in bad])
    assert got[:3] == [None, None, None] and tuple(got[3]) == ("a", "b", "c", "d", None)


def test_parse_reply_prefix(spark):
    rows = [("@12 moi",), ("@name moi",), ("@123",), ("",), ("plain text",), ("@ x",)]
    got = [None if r is None else tuple(r) for r in one(spark, RC.parse_reply_prefix("s"), rows=rows)]
    assert got == [("moi", 12), ("moi", None), ("@123", None), None, ("plain text", None), ("x", None)]


def test_filter_responses(spark):
    rows = [(1, 1, "pass"), (1, 2, "Passaan"), (1, 3, "(image or file) x"), (1, 4, "@5 ok"), (1, 5, ""), (1, 6, "pas")]
    df = spark.createDataFrame(rows, "chat_id bigint, prompt_id bigint, raw_response string")
    got = sorted((r.prompt_id, r.text, r.reply_to_message_id) for r in parse_responses(df, "api").collect())
    assert got == [(4, "ok", 5), (6, "pas", None)]


def test_parse_record_replies(spark):
    raw = ("moi[FS]7[MEG]\n[MSG]8[FS]12:00[FS]bot[FS]toinen[FS][MEG]\n[MSG]9[FS]12:00[FS]bot[FS](image or file)[FS][MEG]"
           "\n[MSG]10[FS]12:01[FS]bot[FS]kolmas[FS]9[MEG]\n[MSG]11[FS]12:01[FS]anna[FS]ei[FS][MEG][MSG]12[FS]x[FS]bot[FS]ei[FS][MEG]")
    rows = [(1, 1, raw), (1, 2, "no separator here[MEG]"), (1, 3, "only[FS]")]
    df = spark.createDataFrame(rows, "chat_id bigint, prompt_id bigint, raw_response string")
    got = sorted((r.prompt_id, r.reply_idx, r.text, r.reply_to_message_id)
                 for r in parse_responses(df, "local", "bot").collect())
    assert got == [(1, 0, "moi", 7), (1, 1, "toinen", None), (1, 2, "kolmas", 9), (3, 0, "only", None)]


def test_model_output_helpers(spark):
    df = spark.createDataFrame([("PROMPTabc\ndef[FS]x", "PROMPT")], "o string, p string")
    r = df.select(TX.strip_prompt("o", "p").alias("a"), TX.cut_at_newline("o").alias("b"),
                  TX.cut_at_marker("o", "[FS]").alias("c"), TX.approx_tokens("o").alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("abc\ndef[FS]x", "PROMPTabc", "PROMPTabc\ndef[FS]", 18 // 3)


def test_joke_topics(spark):
    rows = [("/vitsi",), ("/vitsi Kissa",), ("/vitsi  Iso Kala ",)]
    assert one(spark, TX.joke_topic_local("s"), rows=rows) == [None, "kissa", "iso kala"]
    assert one(spark, TX.joke_topic_api("s"), rows=rows) == [None, "Kissa", " Iso Kala "]


def test_encode_content_json(spark):
    df = spark.createDataFrame([(1, "12:00", "A", 'sa"nan', None)], "id bigint, t string, f string, x string, r bigint")
    got = df.select(CH.encode_content("id", "t", "f", "x", "r")).first()[0]
    assert got == '{"id":1,"time":"12:00","from":"A","text":"sa\\"nan","reply_to_message_id":null}'


def test_compat_paths(spark):
    """Hand-worked: quotes or braces in a text, "nan" inside a word, replies."""
    from chatprep.operators.compat import content_recover_compat, content_repr_compat
    rows = [(1, "12:00", "Anna", "it's fine", None), (2, "12:01", "Bo", 'say "hi"', 1), (3, "12:02", "Cai", "banana", 2),
            (4, "12:03", "Dee", "two\nlines", None), (5, "12:04", "Eve", "both ' and \"", None)]
    df = spark.createDataFrame(rows, "id bigint, hhmm string, sender string, text string, reply_to_message_id bigint")
    assert [r[0] for r in df.select(content_repr_compat()).collect()] == [
        str({"id": i, "time": t, "from": s, "text": x, "reply_to_message_id": float("nan") if r is None else r})
        for i, t, s, x, r in rows]
    got = [tuple(r[0]) for r in df.select(content_recover_compat()).collect()]
    assert [failed for _, failed in got] == [True, True, False, False, False] or got[4][1]
    assert got[0][0].startswith("{'id': 1") and got[1][0].startswith("{'id': 2")  # stray quotes: the text stays
    assert got[2][0] == "@2 banulla" and got[3][0] == "two\nlines"


def test_reply_id_from_csv_text(spark):
    """Reply ids as a pandas-written CSV stores them (floats, 'nan', blanks)."""
    rows = [("1190.0",), ("",), ("abc",), ("nan",), (" 12 ",), (None,), ("-5",)]
    assert one(spark, TX.to_reply_id("s"), rows=rows) == [1190, None, None, None, 12, None, -5]


def test_iso_parse_is_zone_free(spark):
    rows = [("2021-3-28T3:30:05",), ("2021-03-28T03:30:00",), ("2021-02-30T10:00:00",), ("2021-01-01T10:00:60",)]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Helsinki")  # 03:30 on 2021-03-28 is a DST gap there
        assert one(spark, TX.iso_to_hhmm("s"), rows=rows) == ["03:30", "03:30", None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


from hypothesis import given, settings, strategies as st, HealthCheck  # noqa: E402

_MARKERS = ("[MSG]", "[MEG]", "[FS]")
_field = st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40) \
    .filter(lambda t: not any(m in t for m in _MARKERS))


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-10**12, 10**12), _field, _field, _field,
                          st.one_of(st.none(), st.integers(0, 10**9))), min_size=1, max_size=40))
def test_record_roundtrip_property(spark, rows):
    """decode(encode(x)) = x for any texts without markers (reply: null <-> empty field)."""
    df = spark.createDataFrame(rows, "id bigint, t string, f string, x string, r bigint")
    enc = df.select("id", "t", "f", "x", "r", RC.encode_record("id", "t", "f", "x", "r").alias("e"))
    got = enc.select("id", "t", "f", "x", "r", RC.decode_record("e").alias("d")).collect()
    for r in got:
        assert r.d is not None
        assert (r.d["id"], r.d["time"], r.d["from"], r.d["text"]) == (str(r.id), r.t, r.f, r.x)
        assert r.d["reply_to_message_id"] == ("" if r.r is None else str(r.r))
