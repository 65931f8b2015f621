"""Queries for text functions, news selection and news-to-bar aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barframe.functions.text import ENTITIES, HIDDEN_PATTERN, SPACE_PATTERN, TAG_PATTERN, decode_sentiment, ensemble_score, extract_tickers, scoring_text, signed_score, strip_html, url_id
from barframe.operators import news as N
from barframe.schema import SERIES, TS
from workload.fixtures import BARS, NEWS, TICKERS, bars, news, table
from workload.registry import ms, query, r



@query("f01_extract_tickers", """WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'btc up, Ethereum down. ' WHEN 1 THEN 'RIPPLE and xrp; '
    WHEN 2 THEN 'solid ethics bnb ' WHEN 3 THEN 'Bitcoin/BTC ' WHEN 4 THEN 'sol-solana ' ELSE '' END || text AS body FROM documents),
  w AS (SELECT doc_id, list_transform(regexp_extract_all(body, '(?i)\\b(BTC|BITCOIN|ETH|ETHEREUM|BNB|SOL|SOLANA|XRP|RIPPLE)\\b', 1), lambda x: lower(x)) AS ws FROM t)
  SELECT doc_id::BIGINT AS doc_id, array_to_string(list_sort(list_distinct(list_transform(ws, lambda x: CASE x WHEN 'bitcoin' THEN 'BTC' WHEN 'ethereum' THEN 'ETH'
    WHEN 'solana' THEN 'SOL' WHEN 'ripple' THEN 'XRP' ELSE upper(x) END))), ',') AS tickers FROM w""")
def _(spark, sf):
    lead = F.element_at(
        F.array(*[F.lit(x) for x in ("btc up, Ethereum down. ", "RIPPLE and xrp; ", "solid ethics bnb ", "Bitcoin/BTC ", "sol-solana ", "")]),
        (F.col("doc_id") % 6 + 1).cast("int"),
    )
    return table(spark, sf, "documents").select("doc_id", F.array_join(extract_tickers(lead, F.col("text")), ",").alias("tickers"))


def _entities_sql(text: str) -> str:
    for name, code in ENTITIES.items():
        text = f"replace({text}, '&{name};', chr({code}))"
    return text


@query("f02_strip_html", f"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN_PATTERN}', ' ', 'g'), '{TAG_PATTERN.replace("'", "''")}', ' ', 'g') AS t FROM pages),
  n AS (SELECT *, list_distinct(regexp_extract_all(t, '&#([0-9]{{1,7}});', 1)) AS codes FROM a),
  d AS (SELECT page_id, list_reduce(list_prepend(t, codes), lambda x, c: replace(x, '&#' || c || ';', chr(c::INT))) AS t FROM n),
  e AS (SELECT page_id, trim(regexp_replace({_entities_sql('t')}, '{SPACE_PATTERN.replace("x{00A0}", "x{A0}")}', ' ', 'g'), ' ') AS plain FROM d)
  SELECT page_id, length(plain)::BIGINT AS chars, sha1(plain) AS digest, contains(plain, '<script') AS has_script FROM e""")
def _(spark, sf):
    pages = strip_html(table(spark, sf, "pages"), "html", "plain")
    return pages.select("page_id", F.length("plain").alias("chars"), F.sha1("plain").alias("digest"), F.col("plain").contains("<script").alias("has_script"))


@query("f03_url_id", "SELECT page_id, substr(sha1(url), 1, 16) AS id FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", url_id(F.col("url")).alias("id"))


@query("f04_scoring_text", """SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN trim(source, ' ') ELSE
  trim(trim(source, ' ') || '. ' || trim(text, ' '), ' .') END) AS digest FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    summary = F.when(F.col("doc_id") % 3 != 0, F.col("text"))
    return d.select("doc_id", F.md5(scoring_text(F.col("source"), summary)).alias("digest"))


@query("f05_f06_scores", f"""WITH {NEWS}, x AS (SELECT id, (event_id % 7) / 10e0 AS b, (event_id % 5) / 10e0 AS g, event_id % 9 = 0 AS blank FROM news),
  y AS (SELECT *, greatest(-1, least(1, g - b)) AS a1, greatest(-1, least(1, 3 * g - b)) AS a2 FROM x)
  SELECT id, {r('CASE WHEN blank THEN 0 ELSE a1 END AS cryptobert', 'CASE WHEN blank THEN 0 ELSE a2 END AS finbert',
    'CASE WHEN blank THEN 0 ELSE (a1 + a2) / 2 END AS ensemble', 'CASE WHEN blank THEN 0 ELSE (abs(a1) + abs(a2)) / 2 END AS confidence')} FROM y""")
def _(spark, sf):
    bear, bull = (F.col("event_id") % 7) / F.lit(10.0), (F.col("event_id") % 5) / F.lit(10.0)
    entry = lambda label, p: F.struct(F.lit(label).alias("label"), p.alias("score"))
    first = signed_score(F.array(entry("Bearish", bear), entry("Bullish", bull), entry("Neutral", F.lit(0.5)), entry("odd", F.lit(0.9))))
    second = signed_score(F.array(entry("negative", bear), entry("positive", bull * 3)))
    text = F.when(F.col("event_id") % 9 == 0, F.lit("  ")).otherwise(F.col("title"))
    return news(spark, sf).select("id", ensemble_score(text, first, second).alias("s")).select("id", "s.*")


@query("f07_decode_sentiment", f"""WITH {NEWS} SELECT id, event_id % 4 < 2 AS decoded,
  {r('CASE WHEN event_id % 4 = 0 THEN score WHEN event_id % 4 = 1 THEN 0 END AS ensemble')} FROM news""")
def _(spark, sf):
    n = news(spark, sf)
    payload = F.when(F.col("event_id") % 4 == 0, F.col("sentiment")).when(F.col("event_id") % 4 == 1, F.lit('{"confidence": 1.0}')).when(
        F.col("event_id") % 4 == 2, F.lit("{broken")
    )
    s = decode_sentiment(payload)
    return n.select(
        "id", s.isNotNull().alias("decoded"), F.when(s.isNotNull(), F.coalesce(s["ensemble"], F.lit(0.0))).alias("ensemble")
    )


@query("p03_ticker_filter", f"""WITH {NEWS} SELECT 'macro' AS mode, id FROM news WHERE ticker = 'click' OR ticker IS NULL
  UNION ALL SELECT 'tagged', id FROM news WHERE ticker = 'click' UNION ALL SELECT 'ALL', id FROM news""")
def _(spark, sf):
    n = news(spark, sf)
    parts = [
        N.filter_news_for_pair(n, pair, TICKERS, macro).select(F.lit(mode).alias("mode"), "id")
        for mode, pair, macro in (("macro", "click", True), ("tagged", "click", False), ("ALL", "ALL", True), ("none", "other", True))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("p04_latest_news", f"""WITH {NEWS} SELECT id, {ms('published_at')}, {r('CASE WHEN event_id % 11 <> 0 THEN score END AS score')}
  FROM news WHERE ticker = 'view' ORDER BY news.published_at DESC, id DESC LIMIT 25""")
def _(spark, sf):
    n = N.latest_news(news(spark, sf, unscored=True), 25, "view")
    return n.select("id", "published_at", decode_sentiment(F.col("sentiment"))["ensemble"].alias("score"))


@query("p05_unscored", f"WITH {NEWS} SELECT id FROM news WHERE event_id % 11 = 0")
def _(spark, sf):
    return N.unscored(news(spark, sf, unscored=True)).select("id")


_FIRST, _SECOND = N.MARKET_WORDS, N.FINANCE_WORDS


def _share(words: str, lists) -> str:
    up, down = (f"len(list_filter({words}, lambda x: x IN ({', '.join(repr(w) for w in ws)})))" for ws in lists)
    return f"CASE WHEN {up} + {down} > 0 THEN ({up} - {down}) / ({up} + {down})::DOUBLE ELSE 0e0 END"


# Source and whole text of every document, with some of the scorer's words; every third is scored already.
SCORED_SQL = f"""WITH t AS (SELECT doc_id, doc_id % 3 = 0 AS done, source || '. ' || text || CASE doc_id % 4 WHEN 0 THEN ' rally gain loss' WHEN 1 THEN ' crash fear up'
    WHEN 2 THEN ' bullish growth' ELSE '' END AS body FROM documents),
  w AS (SELECT doc_id, done, string_split_regex(lower(body), '[^a-z]+') AS ws FROM t),
  s AS (SELECT doc_id, done, {_share('ws', _FIRST)} AS a, {_share('ws', _SECOND)} AS b FROM w)"""


def to_score(spark, sf):
    tail = F.element_at(F.array(*[F.lit(x) for x in (" rally gain loss", " crash fear up", " bullish growth", "")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("title"), F.concat("text", tail).alias("summary"),
        F.when(F.col("doc_id") % 3 == 0, F.lit('{"ensemble":0.25,"confidence":0.5}')).alias("sentiment"),
    )


@query("m16_score_news", f"{SCORED_SQL} SELECT doc_id, {r('CASE WHEN done THEN 0.25 ELSE (a + b) / 2 END AS ensemble', 'CASE WHEN done THEN 0.5 ELSE (abs(a) + abs(b)) / 2 END AS confidence')} FROM s")
def _(spark, sf):
    docs = to_score(spark, sf)
    s = decode_sentiment(F.col("sentiment"))
    return N.score_news(docs).select("doc_id", s["ensemble"].alias("ensemble"), s["confidence"].alias("confidence"))


# --------------------------------------------------------------------------- news onto bars
_ROUTED = f"""{BARS}, {NEWS}, j AS (
  SELECT b.pair, b."interval", b.open_time, n.score, n.conf, n.published_at, n.id
  FROM bars b JOIN news n ON (n.ticker = b.pair OR n.ticker IS NULL)
   AND n.published_at >= b.open_time - INTERVAL 24 HOUR AND n.published_at < b.open_time),
  agg AS (SELECT pair, open_time, count(*) AS c, avg(score) AS m, CASE WHEN min(score) = max(score) THEN 0 ELSE stddev_pop(score) END AS sd, min(score) AS lo, max(score) AS hi,
    arg_max(score, {{'a': published_at, 'b': id}}) AS la, avg(conf) AS cm FROM j GROUP BY 1, 2),
  sent AS (SELECT bars.pair, bars."interval", bars.open_time, coalesce(c, 0)::BIGINT AS sent_count, coalesce(m, 0) AS sent_mean, coalesce(sd, 0) AS sent_std,
    coalesce(lo, 0) AS sent_min, coalesce(hi, 0) AS sent_max, coalesce(la, 0) AS sent_last, coalesce(cm, 0) AS sent_conf_mean
    FROM bars LEFT JOIN agg USING (pair, open_time))"""
SENT = ["sent_mean", "sent_std", "sent_min", "sent_max", "sent_last", "sent_conf_mean"]


def sentiment(spark, sf):
    return N.aggregate_news_for_bars(news(spark, sf), bars(spark, sf), tickers=TICKERS)


@query("j01_a01_news_window", f"WITH {_ROUTED} SELECT pair, {ms('open_time')}, sent_count, {r(*SENT, digits=10)} FROM sent", digits=10)
def _(spark, sf):
    return sentiment(spark, sf).select("pair", TS, "sent_count", *SENT)


_LEAK = """count(n.id) FILTER (n.published_at >= b.open_time - INTERVAL 24 HOUR AND n.published_at < b.open_time) AS strict,
  avg(score) FILTER (n.published_at >= b.open_time - INTERVAL 24 HOUR AND n.published_at < b.open_time) AS strict_mean,
  count(n.id) FILTER (n.early >= b.open_time - INTERVAL 24 HOUR AND n.early < b.open_time) AS leaky,
  avg(score) FILTER (n.early >= b.open_time - INTERVAL 24 HOUR AND n.early < b.open_time) AS leaky_mean"""


@query("p07_future_news", f"""WITH {BARS}, {NEWS}, e AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN published_at - INTERVAL 3 HOUR ELSE published_at END AS early FROM news),
  w AS (SELECT b.pair, b.open_time, {_LEAK} FROM bars b LEFT JOIN e n ON (n.ticker = b.pair OR n.ticker IS NULL)
    AND n.published_at >= b.open_time - INTERVAL 24 HOUR AND n.early < b.open_time GROUP BY 1, 2)
  SELECT pair, {ms('open_time')}, leaky::BIGINT AS sent_count, strict::BIGINT AS strict_count FROM w
  WHERE leaky <> strict OR abs(coalesce(leaky_mean, 0) - coalesce(strict_mean, 0)) > 1e-9""")
def _(spark, sf):
    true = news(spark, sf)
    early = F.when(F.col("event_id") % 50 == 0, F.timestamp_micros(F.unix_micros("published_at") - 3 * 3_600_000_000)).otherwise(F.col("published_at"))
    leaky = N.aggregate_news_for_bars(true.withColumn("published_at", early), bars(spark, sf), tickers=TICKERS)
    return N.check_no_future_news(leaky, true, tickers=TICKERS).select("pair", TS, "sent_count", "strict_count")


@query("j02_align_modalities", f"""WITH {_ROUTED} SELECT b.pair, {ms('b.open_time AS open_time')}, CASE WHEN trades % 4 <> 0 THEN sent_count ELSE 0 END::BIGINT AS sent_count,
  {r('CASE WHEN trades % 4 <> 0 THEN sent_mean ELSE 0 END AS sent_mean', 'CASE WHEN trades % 3 <> 0 THEN (b.high)::FLOAT ELSE 0 END AS e0', digits=10)}
  FROM bars b JOIN sent USING (pair, open_time)""", digits=10)
def _(spark, sf):
    b = bars(spark, sf)
    emb = b.filter(F.col("trades") % 3 != 0).select(*SERIES, TS, F.array(F.col("high").cast("float")).alias("embedding"))
    sent = sentiment(spark, sf).join(b.filter(F.col("trades") % 4 != 0).select(*SERIES, TS), [*SERIES, TS], "left_semi")
    out = N.align_modalities(b.select(*SERIES, TS), emb, sent, dim=1)
    return out.select("pair", TS, "sent_count", "sent_mean", F.col("embedding")[0].alias("e0"))


@query("j03_sentiment_only", f"WITH {_ROUTED} SELECT pair, {ms('open_time')}, sent_count, {r('sent_mean', digits=10)} FROM sent WHERE sent_count > 0", digits=10)
def _(spark, sf):
    out = N.align_sentiment_only(bars(spark, sf).select(*SERIES, TS), sentiment(spark, sf))
    return out.select("pair", TS, "sent_count", "sent_mean")


