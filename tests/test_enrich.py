"""Replies, prices, prompts, retry, extractor and rules."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from presswatch.functions import scalars
from presswatch.functions.replies import contract_violations, with_price, with_reply_fields, with_token_columns
from presswatch.operators import enrich, skew
from presswatch.operators.rules import Rules, keyword_table, with_rule_replies
from presswatch.plans.enrichment import enrich_delta
from presswatch.sources.tables import append_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

AS_OF = "2024-05-01 12:00:00"


def fields(rows, *texts):
    df = rows([(i, t) for i, t in enumerate(texts)], "i int, LLM_Response string")
    return with_reply_fields(df).orderBy("i").collect()


def test_reply_fields(rows):
    whole, text, missing, null, empty, broken, array, none = fields(
        rows, '{"RelevantKeywords": ["river", "dam"], "Relevance": "Yes", "AlertFlag": "Red"}',
        '{"RelevantKeywords": "as is"}', "{}", '{"RelevantKeywords": null, "Relevance": null}',
        '{"RelevantKeywords": []}', "{oops", "[1]", None)
    assert (whole.RelevantKeywords, whole.Relevance, whole.AlertFlag) == ("river, dam", "Yes", "Red")
    assert whole.ShortSummary == ""
    assert text.RelevantKeywords == "as is"
    assert (missing.RelevantKeywords, missing.NewsCategory) == ("", "")
    assert (null.RelevantKeywords, null.Relevance, null.AlertFlag) == (None, None, "")
    assert empty.RelevantKeywords == ""
    for failed in (broken, array, none):
        assert failed.RelevantKeywords is None and failed.AlertFlag is None


def test_tokens_and_price(rows):
    usage = "struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>"
    df = with_token_columns(rows([((10, 20, 30),)], f"LLM_Token_Usage {usage}"))
    assert df.select("PromptTokens", "CompletionTokens", "TotalTokens").first() == (10, 20, 30)
    df = with_token_columns(rows([((1000, 500, 1500),)], f"LLM_Token_Usage {usage}"))
    prices = {m: with_price(df, m).first().LLM_Price for m in ("openai_chat", "gpt4", "gpt4o", "other")}
    # Prices of 1,000 and 500 tokens.
    assert prices["openai_chat"] == pytest.approx(0.0032)
    assert prices["gpt4"] == pytest.approx(0.096)
    assert prices["gpt4o"] == pytest.approx(0.00995)
    assert prices["other"] is None


def test_template_and_text(rows):
    df = rows([("{b}", None)], "a string, b string")
    filled = scalars.fill_template("{{x}} {a}-{b}", a=F.col("a"), b=F.lit("B"))
    assert df.select(filled).first()[0] == "{x} {b}-B"
    with pytest.raises(KeyError):
        scalars.fill_template("{c}", a=F.col("a"))
    times = rows([("12:30",), ("2024-05-01T12:30:00Z",), ("x",)], "t string").select(
        scalars.iso_timestamp(F.col("t")).isNull())
    assert [r[0] for r in times.collect()] == [True, False, True]
    assert df.select(scalars.article_text(F.col("b"), F.col("b"))).first()[0] == ". "


def test_retry_only_on_rate_limit():
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) == 1:
            raise RuntimeError("Error code: 429")
        return "{}", {"prompt_tokens": 1, "completion_tokens": 1, "total_tokens": 2}

    assert enrich.attempt(flaky, "p", 2, 0.0)["attempts"] == 2

    def limited(prompt):
        raise RuntimeError("429")

    assert enrich.attempt(limited, "p", 2, 0.0) == {"text": None, "usage": None, "attempts": 2, "error": "429"}

    def broken(prompt):
        raise ValueError("no")

    assert enrich.attempt(broken, "p", 2, 0.0)["attempts"] == 1


class Fixed:
    def __call__(self, prompt):
        if "fail" in prompt:
            raise RuntimeError("boom")
        return ('{"RelevantKeywords": ["a", "b", "c"], "Relevance": "Yes", "AlertFlag": "Red"}',
                {"prompt_tokens": 10, "completion_tokens": 20, "total_tokens": 30})


def stored_articles(rows, tmp_path):
    path = str(tmp_path / "articles")
    df = rows([("t1", "u1", "fine"), ("t2", "u2", "fail"), ("t3", None, "fine")],
              "Title string, URL string, Description string").withColumns({
                  "Timestamp": F.lit(AS_OF).cast("timestamp"), "IsTrending": F.lit("no"),
                  "ingest_seq": F.monotonically_increasing_id()})
    append_table(df, path)
    return path


def test_enrich_delta_runs_each_url_once(spark, rows, tmp_path):
    articles, table = stored_articles(rows, tmp_path), str(tmp_path / "enriched")
    first = {r.URL: r for r in enrich_delta(spark, articles, table, AS_OF, Fixed).collect()}
    assert first["u1"].RelevantKeywords == "a, b, c" and first["u1"].TotalTokens == 30
    assert first["u1"].API_Timestamp is not None
    assert first["u2"].LLM_Response is None and first["u2"].API_Timestamp is None
    assert enrich_delta(spark, articles, table, AS_OF, Fixed).count() == 3
    assert enrich_delta(spark, articles, table, AS_OF, Fixed, retry_failed=True).filter("URL = 'u2'").count() == 2


def test_slices_of_a_table_give_the_same_rows(spark, rows, tmp_path, monkeypatch):
    """Slices weight words by the whole table, keep rows of one number together, and leave no shuffle files."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_") and n.endswith(".data")}

    data = [(f"t{i}", f"u{i}", " ".join(f"word{k}" for k in range(i % 7, i % 7 + 3 + i % 5)) + " word1", i % 30 or None)
            for i in range(60)] + [("t", "none", None, 5)]
    df = rows(data, "Title string, URL string, Description string, ingest_seq long").withColumns({
        "Timestamp": F.lit(AS_OF).cast("timestamp") - F.expr("make_interval(0, 0, 0, ingest_seq % 3)"), "IsTrending": F.lit("no")})
    articles, got = str(tmp_path / "articles"), []
    before = shuffled()
    append_table(df, articles)
    assert len(shuffled() - before) == 0
    size = sum(p.stat().st_size for p in (tmp_path / "articles").rglob("*.parquet"))
    for limit in (size, size // 3):
        monkeypatch.setattr(skew, "SLICE_BYTES", limit)
        assert len(skew.in_slices(spark.read.parquet(articles), "ingest_seq")) in ((1,) if limit == size else (3, 4))
        out = enrich_delta(spark, articles, str(tmp_path / f"enriched-{limit}"), AS_OF)
        got.append(sorted(map(str, out.select("URL", "ingest_seq", "RelevantKeywords", "PromptTokens").collect())))
    assert got[0] == got[1] and len(got[0]) == 61
    assert len(shuffled() - before) <= 4  # of the few counts that are not written


def test_common_keys_meet_their_rows_without_a_shuffle(spark):
    rows_of = spark.range(300).selectExpr("id", "CASE WHEN id < 200 THEN 'hot' ELSE concat('k', id % 40) END AS k")
    keys = rows_of.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k <> 'k7'")
    want = sorted(map(str, rows_of.join(keys, "k").select("id", "k", "n").collect()))
    for limit in (1000, 20, 1, 0):
        joined = skew.frequent_join(rows_of, keys, "k", "n", limit)
        assert sorted(map(str, joined.select("id", "k", "n").collect())) == want and len(want) == 297


def test_extractor_concurrency_keeps_rows(rows):
    df = rows([("t", f"u{i}", "fine") for i in range(50)], "Title string, URL string, Description string")
    got = enrich.with_replies(enrich.with_prompt(df), Fixed, partitions=3)
    assert got.count() == 50 and got.rdd.getNumPartitions() == 3


def test_rules(rows):
    rules = Rules(relevant=("nuclear",), red=("leak",), yellow=("strike",),
                  categories={"health": ("hospital",), "supplychain": ("port",)})
    df = rows([(1, "Nuclear leak at hospital. Second one! Third."), (2, "Nuclear strike at port"),
               (3, "Nuclear news"), (4, "Leak at hospital"), (5, None)], "ingest_seq long, Description string")
    got = {r.ingest_seq: r for r in with_reply_fields(with_rule_replies(df, rules)).collect()}
    assert (got[1].AlertFlag, got[1].NewsCategory, got[1].Relevance) == ("Red", "health", "Yes")
    assert got[1].ShortSummary == "Nuclear leak at hospital. Second one"
    assert (got[2].AlertFlag, got[2].NewsCategory) == ("Yellow", "supplychain")
    assert (got[3].AlertFlag, got[3].NewsCategory) == ("Green", "miscellaneous")
    assert (got[4].Relevance, got[4].AlertFlag, got[4].RelevanceReason) == ("No", "Green", "NA")
    assert (got[5].Relevance, got[5].RelevantKeywords) == ("No", "")
    checks = contract_violations(with_reply_fields(with_rule_replies(df, rules))).first()
    assert checks.irrelevant_not_green == 0 and checks.bad_flag == 0


def test_keywords_by_brute_force(rows):
    import math
    import re
    from collections import Counter
    texts = {1: "alpha alpha beta gamma", 2: "beta beta delta", 3: "alpha delta delta epsilon zeta eta theta"}
    got = {r.ingest_seq: r.keywords for r in keyword_table(
        rows(list(texts.items()), "ingest_seq long, Description string"), count=3).collect()}
    words = {k: Counter(re.findall(r"\w{2,}", t)) for k, t in texts.items()}
    for k, c in words.items():
        def score(w):
            return round(c[w] * math.log(4 / (sum(w in x for x in words.values()) + 1)), 10)
        assert got[k] == sorted(c, key=lambda w: (-score(w), w))[:3]


def test_batches_to_an_extractor_are_bounded_by_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(3).select(F.lit("x").alias("prompt"))
    enrich.with_replies(df, lambda: lambda p: ("{}", None))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == enrich.BATCH_BYTES
