"""Text Column functions for news."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.functions.vectors import let
from barframe.schema import PAIR_TICKERS, SENTIMENT

# Words naming a ticker, and their symbols.
TICKER_WORDS = {
    "btc": "BTC", "bitcoin": "BTC", "eth": "ETH", "ethereum": "ETH", "bnb": "BNB",
    "sol": "SOL", "solana": "SOL", "xrp": "XRP", "ripple": "XRP",
}

# Contribution of a class label to the signed score.
LABEL_SIGN = {
    "bearish": -1.0, "Bearish": -1.0, "negative": -1.0, "Negative": -1.0,
    "neutral": 0.0, "Neutral": 0.0,
    "bullish": 1.0, "Bullish": 1.0, "positive": 1.0, "Positive": 1.0,
}


def _literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in table.items() for x in item])


def extract_tickers(*texts: Column) -> Column:
    """Sorted distinct symbols of the ticker words in the texts (whole words, any case; nulls skipped)."""
    pattern = r"(?i)\b(" + "|".join(TICKER_WORDS) + r")\b"
    found = [F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(pattern), F.lit(1)) for t in texts]
    symbols = F.transform(F.concat(*found), lambda w: F.element_at(_literal_map(TICKER_WORDS), F.lower(w)))
    return F.array_sort(F.array_distinct(symbols))


def url_id(url: Column) -> Column:
    """Stable 16-character id of a URL."""
    return F.substring(F.sha1(url), 1, 16)


# Elements whose content is not text, and the named characters that are decoded (the ampersand last).
_HIDDEN = ("script", "style", "template")
ENTITIES = {
    "nbsp": 160, "lt": 60, "gt": 62, "quot": 34, "apos": 39, "copy": 169, "reg": 174, "middot": 183, "laquo": 171, "raquo": 187,
    "ndash": 8211, "mdash": 8212, "lsquo": 8216, "rsquo": 8217, "ldquo": 8220, "rdquo": 8221, "bull": 8226, "hellip": 8230,
    "euro": 8364, "trade": 8482, "amp": 38,
}
HIDDEN_PATTERN = "(?is)<!--.*?(?:-->|$)|" + "|".join(rf"<{t}\b.*?(?:</{t}\s*>|$)" for t in _HIDDEN)
TAG_PATTERN = r"""(?s)<[/!?A-Za-z](?:"[^"]*"|'[^']*'|[^'">])*>"""
SPACE_PATTERN = "[ \\t\\n\\r\\f\\x{00A0}]+"


def visible_text(html: Column) -> Column:
    """Visible text of HTML: hidden elements, comments and tags become separators, then characters are decoded.

    Runs of white space become one space. Numbered characters and the names in ``ENTITIES`` are decoded, others stay.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN_PATTERN, " "), TAG_PATTERN, " ")
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit("&#([0-9]{1,7});"), F.lit(1)))

    def decoded(so_far: Column, number: Column) -> Column:
        code = number.cast("int")
        fits = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(fits, F.replace(so_far, F.concat(F.lit("&#"), number, F.lit(";")), character)).otherwise(so_far)

    text = F.when(F.size(numbers) > 0, F.aggregate(numbers, text, decoded)).otherwise(text)
    for name, code in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(chr(code)))
    return F.trim(F.regexp_replace(text, SPACE_PATTERN, " "))


def strip_html(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Visible text of an HTML column (see ``visible_text``); null gives the empty string."""
    return df.withColumn(out or col, visible_text(F.col(col)))


def scoring_text(title: Column, summary: Column) -> Column:
    """``title. summary`` without spaces or dots at the ends; the title alone when there is no summary."""
    t, s = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(summary, F.lit("")))
    return F.when(s != "", F.trim(F.concat(t, F.lit(". "), s), F.lit(" ."))).otherwise(t)


def signed_score(classes: Column) -> Column:
    """Signed score of an ``array<struct<label, score>>``: sum of sign x score, clipped to [-1, 1]."""
    total = F.aggregate(
        classes, F.lit(0.0),
        lambda acc, e: acc + F.coalesce(F.try_element_at(_literal_map(LABEL_SIGN), e["label"]), F.lit(0.0)) * e["score"],
    )
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total))


def ensemble_score(text: Column, first: Column, second: Column) -> Column:
    """Sentiment struct of two model scores, each evaluated once; blank text scores zero."""
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    scores = F.struct(*[F.when(blank, 0.0).otherwise(x).alias(name) for name, x in (("a", first), ("b", second))])

    def struct(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return F.struct(
            a.alias("cryptobert"), b.alias("finbert"), (0.5 * (a + b)).alias("ensemble"), (0.5 * (F.abs(a) + F.abs(b))).alias("confidence"),
        )

    return let(scores, struct)


def decode_sentiment(payload: Column) -> Column:
    """Sentiment struct of a JSON payload; null or malformed JSON gives null.

    Keys missing from a well-formed object are null inside the struct; ``aggregate_news_for_bars``
    reads them as 0.
    """
    is_object = F.json_object_keys(payload).isNotNull()
    return F.when(is_object, F.from_json(payload, SENTIMENT))


def pairs_of(tickers: Column, mapping: dict[str, list[str]] | None = None) -> Column:
    """Pairs an article counts for, by overlap of its tickers with each pair's symbols."""
    table = PAIR_TICKERS if mapping is None else mapping
    hits = [
        F.when(F.arrays_overlap(tickers, F.array(*[F.lit(s) for s in symbols])), F.lit(pair))
        for pair, symbols in table.items() if symbols
    ]
    return F.array_compact(F.array(*hits))
