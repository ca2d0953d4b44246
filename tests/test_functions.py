"""Boundaries of the column expressions."""

import pytest
from pyspark.sql import functions as F

from voxtide import models
from voxtide.config import Settings
from voxtide.functions import scoring, text, vectors


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", type(None): "string", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("title", "masked"),
    [("手机号是13800000000谢谢", "手机号是*谢谢"), ("a1234b", "a1234b"), ("a12345b", "a*b"), ("5元", "*元"), ("19.5元", "*元"), ("12345.67元", "*.*元"), ("账号 ***", "账号*"), ("订单１２３４５６", "订单*"), ("", "")],
)
def test_mask(spark, title, masked):
    assert one(spark, text.mask(F.col("t")), t=title) == masked


@pytest.mark.parametrize(("n", "kept"), [(12, False), (13, True), (79, True), (80, False)])
def test_length_band(spark, n, kept):
    assert one(spark, text.length_band(F.col("t")), t="😀" + "a" * (n - 1)) is kept


def test_rules(spark):
    t = F.col("t")
    assert one(spark, text.prefix_rule(t, [("ab", 4)]), t="abcd") and not one(spark, text.prefix_rule(t, [("ab", 4)]), t="abcde")
    assert one(spark, text.any_keyword(t, ["a.c", "x"]), t="za.cz") and not one(spark, text.any_keyword(t, ["a.c"]), t="abc")
    assert one(spark, text.all_keywords(t, [["a", "b"]]), t="b a") and not one(spark, text.all_keywords(t, [["a", "b"]]), t="a")
    assert one(spark, text.include_exclude(t, [(["a"], ["b"])]), t="a") and not one(spark, text.include_exclude(t, [(["a"], ["b"])]), t="ab")


def test_words_and_cells(spark):
    assert one(spark, text.tokens(F.col("t"), F.array(F.lit("THE"))), t="the red, a Ring!") == ["RED", "RING"]
    assert one(spark, text.keyword_cell(F.col("t")), t=" b ,a^{c}a,,") == ["A", "B", "C"]
    assert one(spark, text.keyword_cell(F.col("t")), t=None) == []
    assert one(spark, text.fallback_title(F.col("t")), t="用户表示 无法，付款。") == "无法付款"
    assert one(spark, text.fallback_title(F.col("t")), t="。。") == "。。"


def test_segmentation(spark):
    words = ["无法付款", "无法", "付款", "订单", "5G套餐", "ring"]
    cut = lambda t, **more: one(spark, text.tokens(F.col("t"), words=words, **more), t=t)
    assert cut("无法付款订单失败") == ["无法付款", "订单"]
    assert cut("订单，无法 付款了 string ring") == ["订单", "无法付款", "STRING", "RING"]
    assert cut("办5g套餐 无法无法", stopwords=F.array(F.lit("订单"))) == ["5G套餐", "无法", "无法"]
    assert cut("", stopwords=F.array(F.lit("x"))) == [] and cut(None) is None
    assert text.all_words((("a", 3),), ["b", ["c", ("a",)]]) == ["a", "b", "c"]


def test_services_over_http(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if "input" in asked:
                out = {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(asked["input"])))]}
            elif "documents" in asked:
                out = {"results": [{"index": i, "relevance_score": len(t)} for i, t in reversed(list(enumerate(asked["documents"])))]}
            else:
                out = {"choices": [{"message": {"content": "<think>x</think> " + asked["messages"][0]["content"].upper()}}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert models.HttpEmbedder(url).embed(["a", "bcd"]) == [[1.0], [3.0]]
    assert models.HttpReranker(url).scores("q", ["abc", "d"]) == [3.0, 1.0]
    df = spark.createDataFrame([(1, "hello")], "id long, title string")
    assert models.summarized(df, "id", "title", lambda: models.HttpModel(url), "$title").first()["initial_summary_text"] == "HELLO"
    server.shutdown()


def test_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert spark.range(1).select(vectors.cosine_distance(a, b, vectors.norm(a), vectors.norm(b))).first()[0] == 1.0
    assert spark.range(1).select(vectors.cosine_distance(a, a, vectors.norm(a), vectors.norm(a))).first()[0] == 0.0


def at(s):
    return F.lit(s).cast("timestamp_ntz")


@pytest.mark.parametrize(("last", "days"), [("2024-01-15", 0), ("2024-01-08", 7), ("2024-01-01", 14), ("2024-02-01", 0), (None, 14)])
def test_decay(spark, last, days):
    got = spark.range(1).select(scoring.decay(at(last) if last else F.lit(None).cast("timestamp_ntz"), at("2024-01-15"))).first()[0]
    assert got == pytest.approx(2.718281828459045 ** (-0.05 * days))


@pytest.mark.parametrize(
    ("known", "breach", "alert", "want"),
    [(False, None, None, "first_alert"), (True, None, None, "first_alert"), (True, "2024-01-01", None, "re_alert"), (True, "2024-01-01", "2024-01-15 10:01:00", None), (True, "2024-01-01", "2024-01-15 10:00:00", None), (True, "2024-01-01", "2024-01-15 09:59:00", "re_alert")],
)
def test_alert_states(spark, known, breach, alert, want):
    null = F.lit(None).cast("timestamp_ntz")
    got = scoring.alert_type(F.lit(known), at(breach) if breach else null, at(alert) if alert else null, at("2024-01-15 12:00:00"))
    assert spark.range(1).select(got).first()[0] == want


@pytest.mark.parametrize(("volume", "want"), [(2, "below_static"), (3, "below_dynamic"), (4, "alert")])
def test_baseline_edges(spark, volume, want):
    s = Settings()
    threshold = scoring.dynamic_threshold(F.lit(0.0), F.lit(0.0), F.lit(3), s)
    assert spark.range(1).select(scoring.verdict(F.lit(volume), F.lit(3), F.lit(7), threshold, s)).first()[0] == want
    assert spark.range(1).select(scoring.verdict(F.lit(3), F.lit(3), F.lit(2), threshold, s)).first()[0] == "alert_without_baseline"


def test_decide_precedence(spark):
    def outcome(fp, top, contexts):
        num = lambda v: F.lit(v).cast("double")
        return spark.range(1).select(scoring.decide(num(fp), num(top), F.lit(contexts))).first()[0]

    assert outcome(0.1, 0.9, 1) == "suppress_as_false_positive"
    assert outcome(None, None, 1) == "create_new:no_candidates"
    assert outcome(0.2, 0.59, 1) == "create_new:below_threshold"
    assert outcome(0.2, 0.6, 0) == "create_new:no_context"
    assert outcome(0.2, 0.6, 1) == "ask"


def test_payload_validation_of_null(spark):
    null = F.lit(None).cast("string")
    row = spark.range(1).select(scoring.valid_summaries(null, F.lit(2), F.lit("f")).alias("s"), scoring.valid_decision(null, F.array(F.lit("E")), F.lit("E"), F.lit(0.1)).alias("d")).first()
    assert row["s"]["success"] == 0 and row["s"]["summaries"][0]["original_indices"] == [0, 1]
    assert row["d"].asDict() == {"decision": "create_new", "matched_risk_event_id": None, "source": "fallback"}


def test_defaults(spark):
    assert one(spark, text.or_default(F.col("a"), F.col("b"), "Unknown Title"), a="", b=None) == "Unknown Title"
