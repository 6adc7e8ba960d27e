"""Queries over texts, joins on time and files, and row projections."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from tsalign.functions.classes import fear_greed_class, ratio_class, sentiment_class, significance_stars, tone_class
from tsalign.functions.text import (
    asset_list,
    clean_text,
    combine_news_text,
    combine_post_text,
    text_hash,
    token_count,
)
from tsalign.functions.mentions import mention_share, mentions
from tsalign.functions.subwords import BytePairs, WordPieces, token_count_subword
from tsalign.functions.time import floor_hour, from_millis, from_seconds, parse_iso, to_numeric
from tsalign.operators.durable import durable, scratch_folder
from tsalign.operators.dedupe import (
    concat_assets,
    concat_splits,
    dedupe_by_text_hash,
    dedupe_keep_first,
    dedupe_on_first_key,
    head,
    random_sample,
    removed_rows,
    sort_by_time,
)
from tsalign.operators.features import embed_column, embed_with_store, encoder_of, format_prompt, project_vectors, tabular_baseline, xavier_uniform
from tsalign.operators.filters import (
    PLACEHOLDER,
    drop_any_null,
    drop_empty_text,
    drop_null_target,
    fill_missing,
    filter_time_range,
    final_projection,
    image_key,
    project_without,
    select_feature_vector,
)
from tsalign.operators.joins import (
    asset_file_report,
    compare_to_claims,
    join_perp_metrics,
    keep_with_asset_file,
    left_join_on_time,
    missing_asset_files,
    modality_counts_match,
    zip_modalities,
)
from tsalign.operators.profile import macro_hourly
from tsalign.operators.sample import sample_positions
from tsalign.operators.split import chronological_split
from tsalign.operators.texts import (
    asset_mention_share,
    combine_text_sources,
    grouped_text,
    hourly_text,
    text_coverage,
    text_length_stats,
)
from tsalign.plans.registry import query
from tsalign.plans.series_queries import _SPLIT
from tsalign.plans.tables import BARS, STAMP, bars, load, r, stamp
from tsalign.sources import committed
from tsalign.sources.bucketed import write_bucketed, zip_bucketed
from tsalign.sources.files import month_paths

# --- text -------------------------------------------------------------------

# Unicode white space plus U+001C..U+001F, spelled out for RE2.
_SPACE = r"\t-\r \x1c-\x1f"
_WIDE = _SPACE + r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def clean_sql(c: str) -> str:
    url = f"'https?://[^{_WIDE}]+|www\\.[^{_WIDE}]+'"
    bare = f"regexp_replace(regexp_replace(coalesce({c}, ''), {url}, ' ', 'g'), '[^\\x00-\\x7F]', '', 'g')"
    return f"trim(regexp_replace({bare}, '[{_SPACE}]+', ' ', 'g'))"


@query(
    "clean_text",
    f"""SELECT 'document' AS kind, doc_id AS id, {clean_sql('text')} AS cleaned FROM documents
UNION ALL SELECT 'page', page_id, {clean_sql("url || ' ' || html")} FROM pages""",
)
def clean_text_query(spark, folder):
    documents = load(spark, folder, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), clean_text(F.col("text")).alias("cleaned")
    )
    pages = load(spark, folder, "pages").select(
        F.lit("page").alias("kind"),
        F.col("page_id").alias("id"),
        clean_text(F.concat_ws(" ", "url", "html")).alias("cleaned"),
    )
    return documents.unionByName(pages)


@query(
    "combine_text",
    """SELECT doc_id, sha256(trim(source || ' ' || text)) AS post_text, sha256(source || ' ' || text) AS news_text
FROM documents""",
)
def combine_text(spark, folder):
    title, body = F.col("source"), F.col("text")
    return load(spark, folder, "documents").select(
        "doc_id",
        F.sha2(combine_post_text(title, body), 256).alias("post_text"),
        F.sha2(combine_news_text(title, body), 256).alias("news_text"),
    )


PATTERNS = {"AND": [r"\band\b", r"\bet\b"], "THE": [r"\bthe\b"], "UN": [r"\bun\b", r"\bune\b"]}


def _assets_sql() -> str:
    low = f"lower({clean_sql('text')})"
    hit = lambda words, a: f"CASE WHEN regexp_matches({low}, '{'|'.join(words)}') THEN '{a}' END"
    listed = ", ".join(hit(w, a) for a, w in PATTERNS.items())
    return f"SELECT doc_id, coalesce(nullif(concat_ws(',', {listed}), ''), 'OTHER') AS assets FROM documents"


@query("detect_assets", _assets_sql())
def detect_assets_query(spark, folder):
    return load(spark, folder, "documents").select(
        "doc_id", asset_list(clean_text(F.col("text")), PATTERNS).alias("assets")
    )


@query(
    "asset_mention_share",
    f"WITH found AS ({_assets_sql()}) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS asset, round(count(*) FILTER (list_contains(string_split(assets, ','), '{a}')) * 100.0::DOUBLE"
        f" / count(*), 4) AS share_pct FROM found"
        for a in [*PATTERNS, "OTHER"]
    ),
)
def asset_mention_share_query(spark, folder):
    out = asset_mention_share(detect_assets_query(spark, folder), "assets", [*PATTERNS, "OTHER"])
    return out.select("asset", F.round("share_pct", 4).alias("share_pct"))


# Search terms by a rule: every pair of these syllables as one word and as two, named by the first.
_SYLLABLES = [
    "an", "at", "au", "ber", "ble", "ch", "ed", "en", "er", "es", "ge", "he", "ie", "in", "ing", "it",
    "le", "les", "ly", "ment", "nd", "on", "or", "ou", "que", "re", "sch", "st", "th", "ti", "tion", "ung",
]
TERMS = {a: [a + gap + b for b in _SYLLABLES for gap in ("", " ")] for a in _SYLLABLES}


def _mentions_sql() -> str:
    found = ", ".join(f"CASE WHEN regexp_matches(lower(text), '\\b(?:{'|'.join(words)})\\b') THEN '{name}' END" for name, words in TERMS.items())
    return f"SELECT doc_id, list_filter([{found}], lambda x: x IS NOT NULL) AS names FROM documents"


@query("mentions", f"SELECT doc_id, list_aggregate(names, 'string_agg', ',') AS names FROM ({_mentions_sql()})")
def mentions_query(spark, folder):
    """Two thousand terms of 32 names in one pass over each text."""
    found = load(spark, folder, "documents").select("doc_id", mentions(F.col("text"), TERMS).alias("names"))
    return found.select("doc_id", F.when(F.size("names") > 0, F.array_join("names", ",")).alias("names"))


@query(
    "mention_share",
    f"WITH found AS ({_mentions_sql()}), n AS (SELECT unnest({list(TERMS)}) AS name) "
    "SELECT name, (SELECT count(*) FROM found WHERE list_contains(names, name)) AS n, "
    "round((SELECT count(*) FILTER (list_contains(names, name)) * 100.0::DOUBLE / count(*) FROM found), 4) AS share_pct FROM n",
)
def mention_share_query(spark, folder):
    found = load(spark, folder, "documents").select(mentions(F.col("text"), TERMS).alias("names"))
    return mention_share(found, "names", list(TERMS)).withColumn("share_pct", F.round("share_pct", 4))


@query("text_hash", "SELECT doc_id, sha256(lower(text)) AS text_hash FROM documents")
def text_hash_query(spark, folder):
    return load(spark, folder, "documents").select("doc_id", text_hash(F.col("text")).alias("text_hash"))


@query(
    "token_count",
    f"""WITH bare AS (SELECT doc_id, trim(regexp_replace(text, '[{_SPACE}]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS tokens FROM bare""",
)
def token_count_query(spark, folder):
    return load(spark, folder, "documents").select("doc_id", token_count(F.col("text")).cast("long").alias("tokens"))


#: The vocabulary of :func:`token_count_subword_query`; any file of its kind will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("token_count_subword")
def token_count_subword_query(spark, folder):
    count = token_count_subword(F.col("text"), partial(BytePairs.load, VOCABULARY))
    return load(spark, folder, "documents").select("doc_id", count.alias("tokens"))


# A small vocabulary, of letters and common beginnings and ends.
_LETTERS = [*"abcdefghijklmnopqrstuvwxyzäöüßéèêçáíóúñ"]
_BEGINS = ["the", "and", "th", "er", "on", "an", "in", "ein", "ver", "un", "ge", "les", "ré", "eau", "los", "que", "ción", *_LETTERS, *".,|!#$%&*"]
_ENDS = ["tion", "ing", "ed", "er", "on", "an", "lich", "keit", "ung", "heit", "elle", "eux", "ment", "mente", "ción", "ado", *_LETTERS]


def _longest_first(pieces):
    return "|".join("[" + p + "]" if len(p) == 1 else p for p in sorted(pieces, key=len, reverse=True))


@query(
    "token_count_wordpiece",
    rf"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) AS w FROM documents),
cut AS (SELECT w, regexp_extract(w, '^(?:{_longest_first(_BEGINS)})') AS head FROM words),
rest AS (SELECT w, head, regexp_extract_all(substr(w, length(head) + 1), '{_longest_first(_ENDS)}') AS pieces FROM cut),
sized AS (SELECT w, CASE WHEN length(w) <= 100 AND head <> '' AND length(head) + length(array_to_string(pieces, '')) = length(w)
  THEN 1 + len(pieces) ELSE 1 END AS n FROM rest),
met AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) AS w FROM documents),
sums AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS tokens FROM met JOIN sized USING (w) GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(tokens, 0) END AS tokens FROM documents LEFT JOIN sums USING (doc_id)""",
)
def token_count_wordpiece_query(spark, folder):
    pieces = [*_BEGINS, *["##" + p for p in _ENDS]]
    count = token_count_subword(F.col("text"), partial(WordPieces, pieces))
    return load(spark, folder, "documents").select("doc_id", count.alias("tokens"))


@query(
    "text_length_stats",
    """SELECT lang, CAST(min(length(text)) AS BIGINT) AS min_chars, CAST(max(length(text)) AS BIGINT) AS max_chars,
  round(avg(length(text)), 4) AS mean_chars FROM documents GROUP BY 1""",
)
def text_length_stats_query(spark, folder):
    out = text_length_stats(load(spark, folder, "documents"), "text", ["lang"])
    return out.select(
        "lang",
        F.col("min_chars").cast("long").alias("min_chars"),
        F.col("max_chars").cast("long").alias("max_chars"),
        F.round("mean_chars", 4).alias("mean_chars"),
    )


# The kinds of the events.
KINDS = ["view", "click", "purchase", "signup", "error"]


HOURLY = """hourly AS (
  SELECT date_trunc('hour', ts) AS timestamp, coalesce(string_agg(props, ' [SEP] ' ORDER BY event_id), '') AS text_content
  FROM (SELECT ts, event_id, CASE WHEN event_type <> 'error' THEN props END AS props FROM events) GROUP BY 1)"""


def _hourly(spark, folder):
    """Event properties as the news of an hour; error events are articles without text."""
    articles = load(spark, folder, "events")
    articles = articles.withColumn("text", F.when(F.col("event_type") != "error", F.col("props")))
    return hourly_text(articles, "ts", "text", ["event_id"])


@query("hourly_text", f"WITH {HOURLY} SELECT {STAMP} AS timestamp, text_content FROM hourly")
def hourly_text_query(spark, folder):
    return _hourly(spark, folder).select(stamp("timestamp").alias("timestamp"), "text_content")


@query(
    "conversation_text",
    "SELECT conv_id, string_agg(text, ' [SEP] ' ORDER BY turn) AS text_content FROM conversations GROUP BY 1",
)
def conversation_text(spark, folder):
    return grouped_text(load(spark, folder, "conversations"), ["conv_id"], "text", ["turn"])


_FILLED = f"""{BARS}, {HOURLY},
filled AS (SELECT b.*, coalesce(h.text_content, '{PLACEHOLDER}') AS text_content
           FROM bars b LEFT JOIN hourly h USING (timestamp))"""


def _filled(spark, folder):
    joined = left_join_on_time(bars(spark, folder), _hourly(spark, folder))
    return fill_missing(joined, {"text_content": PLACEHOLDER})


@query("text_fill", f"WITH {_FILLED} SELECT asset, {STAMP} AS timestamp, text_content FROM filled")
def text_fill(spark, folder):
    return _filled(spark, folder).select("asset", stamp("timestamp").alias("timestamp"), "text_content")


def _coverage_sql(test: str) -> str:
    return f"""WITH {_FILLED}
SELECT asset, count(*) AS n, count(*) FILTER ({test}) AS no_event, count(*) FILTER (NOT {test}) AS "real",
  round(count(*) FILTER ({test}) * 100.0::DOUBLE / count(*), 4) AS no_event_pct,
  round(count(*) FILTER (NOT {test}) * 100.0::DOUBLE / count(*), 4) AS real_pct FROM filled GROUP BY 1"""


def _coverage(spark, folder, regex_compat):
    out = text_coverage(_filled(spark, folder), "text_content", ["asset"], regex_compat)
    return out.withColumns({c: F.round(c, 4) for c in ("no_event_pct", "real_pct")})


@query("text_coverage", _coverage_sql("contains(text_content, '[NO_EVENT]')"))
def text_coverage_query(spark, folder):
    return _coverage(spark, folder, False)


@query("text_coverage_regex", _coverage_sql("regexp_matches(text_content, '[NO_EVENT]')"))
def text_coverage_regex(spark, folder):
    return _coverage(spark, folder, True)


@query(
    "combine_sources",
    """SELECT 'documents' AS source, doc_id AS id, CAST(NULL AS VARCHAR) AS role, sha256(text) AS digest FROM documents
UNION ALL SELECT 'conversations', conv_id * 1000 + turn, role, sha256(text) FROM conversations""",
)
def combine_sources(spark, folder):
    documents = load(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    talks = load(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.sha2("text", 256).alias("digest")
    )
    return combine_text_sources({"documents": documents, "conversations": talks})


@query(
    "macro_hourly",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS timestamp,
  count(*) FILTER (event_type = 'view') AS gdelt_econ_volume,
  round(avg(value) FILTER (event_type = 'view'), 8) AS gdelt_econ_tone,
  count(*) FILTER (event_type = 'error') AS gdelt_conflict_volume FROM events GROUP BY 1""",
)
def macro_hourly_query(spark, folder):
    kind = F.col("event_type")
    out = macro_hourly(load(spark, folder, "events"), "ts", kind == "view", kind == "error", "value")
    return out.withColumns(
        {"timestamp": stamp("timestamp"), "gdelt_econ_tone": F.round("gdelt_econ_tone", 8)}
    )


# --- deduplication, order, concatenation ------------------------------------


@query(
    "dedupe_hash",
    """SELECT doc_id, sha256(lower(text)) AS text_hash FROM documents
QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) = 1""",
)
def dedupe_hash(spark, folder):
    return dedupe_by_text_hash(load(spark, folder, "documents"), "text", ["doc_id"]).select("doc_id", "text_hash")


@query(
    "dedupe_first",
    """SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) = 1""",
)
def dedupe_first(spark, folder):
    orders = load(spark, folder, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice", "o_orderdate")
    return dedupe_keep_first(orders, ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "dedupe_first_key",
    "SELECT page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1",
)
def dedupe_first_key(spark, folder):
    return dedupe_on_first_key(load(spark, folder, "pages").select("page_id", "url"), ["page_id"])


@query(
    "removed_rows",
    "SELECT CAST(count(*) - count(DISTINCT lower(text)) AS BIGINT) AS removed FROM documents",
)
def removed_rows_query(spark, folder):
    hashed = load(spark, folder, "documents").select(text_hash(F.col("text")).alias("text_hash"))
    return removed_rows(hashed, ["text_hash"])


@query(
    "sorted_head",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500""",
)
def sorted_head(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    first = head(orders, 500, "o_orderdate", "o_orderkey")
    return sort_by_time(first, "o_orderdate", "o_orderkey").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )


@query(
    "random_sample",
    "SELECT * FROM orders ORDER BY ('0x' || substr(md5('42:' || o_orderkey), 1, 15))::BIGINT, o_orderkey LIMIT 100",
)
def random_sample_query(spark, folder):
    return random_sample(load(spark, folder, "orders"), 100, "o_orderkey")


@query(
    "systematic_sample",
    """WITH numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS at_, count(*) OVER () AS n FROM documents),
size AS (SELECT max(n) AS n, least(max(n), 100) AS m FROM numbered),
picks AS (SELECT CASE WHEN k = m - 1 THEN n - 1 ELSE CAST(floor(k * ((n - 1)::DOUBLE / (m - 1))) AS BIGINT) END AS at_
          FROM size, range(m) t(k))
SELECT doc_id, at_ AS sample_pos FROM numbered WHERE at_ IN (SELECT at_ FROM picks)""",
)
def systematic_sample(spark, folder):
    return sample_positions(load(spark, folder, "documents").select("doc_id"), "doc_id", 100)


@query(
    "concat_assets",
    f"""WITH {BARS}
SELECT asset, list_position({KINDS}, asset)::INTEGER - 1 AS ordinal, {STAMP} AS timestamp, close FROM bars""",
)
def concat_assets_query(spark, folder):
    all_bars = durable(bars(spark, folder), "bars")
    parts = {a: all_bars.where(F.col("asset") == a).drop("asset") for a in KINDS}
    return concat_assets(parts).select("asset", "ordinal", stamp("timestamp").alias("timestamp"), "close")


@query(
    "concat_splits",
    f"""WITH {BARS}, {_SPLIT}
SELECT asset, split, {STAMP} AS timestamp FROM parts WHERE split NOT LIKE 'embargo%'""",
)
def concat_splits_query(spark, folder):
    rows = durable(chronological_split(bars(spark, folder), ["asset"], "hour_no"), "splits")
    parts = [rows.where(F.col("split") == s) for s in ("train", "validation", "test_in_domain")]
    out = concat_splits(parts, "asset", "timestamp")
    return out.select("asset", "split", stamp("timestamp").alias("timestamp"))


# --- time, numbers, classes -------------------------------------------------


@query(
    "floor_hour",
    """SELECT event_id, strftime(date_trunc('hour', coalesce(t, TIMESTAMP '2024-01-01 00:00:00')), '%Y-%m-%d %H:%M:%S') AS hour
FROM (SELECT event_id, CASE WHEN event_type <> 'signup' THEN ts END AS t FROM events)""",
)
def floor_hour_query(spark, folder):
    ts = F.when(F.col("event_type") != "signup", F.col("ts").cast("timestamp"))
    default = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return load(spark, folder, "events").select("event_id", stamp(floor_hour(ts, default)).alias("hour"))


@query(
    "parse_time",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S') AS millis,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS seconds, CAST(NULL AS VARCHAR) AS broken FROM events""",
)
def parse_time(spark, folder):
    ts = F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return load(spark, folder, "events").select(
        "event_id",
        stamp(parse_iso(iso)).alias("iso"),
        stamp(from_millis(F.unix_millis(ts).cast("string"))).alias("millis"),
        stamp(from_seconds(F.unix_seconds(ts).cast("string"))).alias("seconds"),
        stamp(parse_iso(F.concat(F.lit("at "), iso))).alias("broken"),
    )


@query(
    "to_numeric",
    """SELECT event_id, TRY_CAST(regexp_extract(props, '"k": (\\d+)', 1) AS DOUBLE) AS number, TRY_CAST(props AS DOUBLE) AS broken
FROM events""",
)
def to_numeric_query(spark, folder):
    number = F.regexp_extract("props", r'"k": (\d+)', 1)
    return load(spark, folder, "events").select(
        "event_id", to_numeric(number).alias("number"), to_numeric(F.col("props")).alias("broken")
    )


@query(
    "sentiment_class",
    """SELECT event_id, CASE WHEN value - 100 <= -20 THEN 'Bearish' WHEN value - 100 >= 20 THEN 'Bullish'
  ELSE 'Neutral' END AS sentiment FROM events""",
)
def sentiment_class_query(spark, folder):
    return load(spark, folder, "events").select("event_id", sentiment_class(F.col("value") - 100).alias("sentiment"))


@query(
    "fear_greed_class",
    """SELECT event_id, CASE WHEN floor(value) < 25 THEN 'Extreme Fear' WHEN floor(value) < 46 THEN 'Fear'
  WHEN floor(value) < 54 THEN 'Neutral' WHEN floor(value) < 75 THEN 'Greed' ELSE 'Extreme Greed' END AS level FROM events""",
)
def fear_greed_class_query(spark, folder):
    return load(spark, folder, "events").select("event_id", fear_greed_class(F.floor("value")).alias("level"))


@query(
    "ratio_class",
    """SELECT c_custkey, CASE WHEN c_acctbal / 2500 > 3 THEN 'Extremely bullish' WHEN c_acctbal / 2500 >= 1.5 THEN 'Moderately bullish'
  WHEN c_acctbal / 2500 >= 1 THEN 'Neutral to slightly bullish' ELSE 'Bearish' END AS reading FROM customer""",
)
def ratio_class_query(spark, folder):
    return load(spark, folder, "customer").select("c_custkey", ratio_class(F.col("c_acctbal") / 2500).alias("reading"))


@query(
    "tone_class",
    """SELECT event_id, CASE WHEN value - 75 < -50 THEN 'Very negative' WHEN value - 75 < -10 THEN 'Negative'
  WHEN value - 75 < 10 THEN 'Neutral' WHEN value - 75 < 50 THEN 'Positive' ELSE 'Very positive' END AS tone FROM events""",
)
def tone_class_query(spark, folder):
    return load(spark, folder, "events").select("event_id", tone_class(F.col("value") - 75).alias("tone"))


@query(
    "significance_stars",
    """SELECT stars, count(*) AS n FROM (SELECT CASE WHEN l_tax < 0.001 THEN '***' WHEN l_tax < 0.01 THEN '**'
  WHEN l_tax < 0.05 THEN '*' ELSE 'ns' END AS stars FROM lineitem) GROUP BY 1""",
)
def significance_stars_query(spark, folder):
    return (
        load(spark, folder, "lineitem")
        .groupBy(significance_stars(F.col("l_tax")).alias("stars"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "month_paths",
    """WITH spans AS (SELECT o_orderstatus, date_trunc('month', min(o_orderdate)) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
SELECT o_orderstatus, strftime(m, '%Y-%m') AS month, 'raw/bars-' || strftime(m, '%Y-%m') || '.csv' AS path
FROM spans, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS t(m)""",
)
def month_paths_query(spark, folder):
    spans = load(spark, folder, "orders").groupBy("o_orderstatus").agg(
        F.trunc(F.min("o_orderdate"), "month").alias("a"), F.max("o_orderdate").alias("b")
    )
    return month_paths(spans, F.col("a"), F.col("b"), "raw/bars-%s.csv").drop("a", "b")


# --- filters and projections ------------------------------------------------


@query(
    "time_range",
    f"""WITH {BARS} SELECT asset, {STAMP} AS timestamp, close FROM bars
WHERE timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""",
)
def time_range(spark, folder):
    edge = lambda t: F.lit(t).cast("timestamp")
    out = filter_time_range(bars(spark, folder), edge("2024-01-05 00:00:00"), edge("2024-01-20 12:00:00"))
    return out.select("asset", stamp("timestamp").alias("timestamp"), "close")


def _with_nulls(spark, folder):
    return load(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax"),
    )


_NULLED = """nulled AS (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax FROM lineitem)"""


@query("drop_null_target", f"WITH {_NULLED} SELECT * FROM nulled WHERE tax IS NOT NULL")
def drop_null_target_query(spark, folder):
    return drop_null_target(_with_nulls(spark, folder), "tax")


@query("drop_any_null", f"WITH {_NULLED} SELECT * FROM nulled WHERE tax IS NOT NULL AND discount IS NOT NULL")
def drop_any_null_query(spark, folder):
    return drop_any_null(_with_nulls(spark, folder))


@query("final_projection", f"WITH {BARS} SELECT {STAMP} AS timestamp, asset, volume, close FROM bars")
def final_projection_query(spark, folder):
    cols = ["timestamp", "asset", "volume", "funding_rate", "close"]
    kept, _ = final_projection(bars(spark, folder), cols)
    return kept.withColumn("timestamp", stamp("timestamp"))


@query("project_without", "SELECT doc_id, lang, source, n_chars FROM documents")
def project_without_query(spark, folder):
    return project_without(load(spark, folder, "documents"), ["text"])


@query(
    "feature_vector",
    """SELECT l_orderkey, l_linenumber, l_quantity::FLOAT::DOUBLE AS f0, l_discount::FLOAT::DOUBLE AS f1, l_tax::FLOAT::DOUBLE AS f2
FROM lineitem""",
)
def feature_vector(spark, folder):
    out = select_feature_vector(load(spark, folder, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return out.select(
        "l_orderkey", "l_linenumber", *[F.col("tabular")[i].cast("double").alias(f"f{i}") for i in range(3)]
    )


@query(
    "nonblank_text",
    f"SELECT doc_id, length(t) AS chars FROM (SELECT doc_id, {clean_sql('text')} AS t FROM documents) WHERE length(trim(t)) > 0",
)
def nonblank_text(spark, folder):
    documents = load(spark, folder, "documents").select("doc_id", "text")
    return drop_empty_text(documents, "t", clean_text(F.col("text"))).select("doc_id", F.length("t").cast("long").alias("chars"))


_IMAGE = "'charts/' || lower(asset) || '/' || CAST(CAST(epoch(timestamp) AS BIGINT) AS VARCHAR) || '.png'"


@query("image_key", f"WITH {BARS} SELECT asset, {STAMP} AS timestamp, {_IMAGE} AS image_path FROM bars")
def image_key_query(spark, folder):
    return bars(spark, folder).select(
        "asset", stamp("timestamp").alias("timestamp"), image_key("asset", "timestamp", "charts").alias("image_path")
    )


# --- joins ------------------------------------------------------------------

_LISTED = f"""{BARS},
listed AS (SELECT DISTINCT event_type AS asset, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS unix_ts
           FROM events WHERE value > 50),
keyed AS (SELECT *, CAST(epoch(timestamp) AS BIGINT) AS unix_ts FROM bars)"""


def _listed(spark, folder):
    """Hours with an event above 50 count as having a chart."""
    hour = F.unix_seconds(F.date_trunc("hour", "ts")).alias("unix_ts")
    events = load(spark, folder, "events").where(F.col("value") > 50)
    manifest = events.select(F.col("event_type").alias("asset"), hour).distinct()
    return bars(spark, folder).withColumn("unix_ts", F.unix_seconds("timestamp")), manifest


@query("semi_files", f"WITH {_LISTED} SELECT asset, unix_ts, close FROM keyed SEMI JOIN listed USING (asset, unix_ts)")
def semi_files(spark, folder):
    return keep_with_asset_file(*_listed(spark, folder), ["asset", "unix_ts"]).select("asset", "unix_ts", "close")


@query("anti_files", f"WITH {_LISTED} SELECT asset, unix_ts, close FROM keyed ANTI JOIN listed USING (asset, unix_ts)")
def anti_files(spark, folder):
    return missing_asset_files(*_listed(spark, folder), ["asset", "unix_ts"]).select("asset", "unix_ts", "close")


@query(
    "file_report",
    f"""WITH {_LISTED} SELECT count(l.unix_ts) AS found, count(*) - count(l.unix_ts) AS missing
FROM keyed k LEFT JOIN listed l USING (asset, unix_ts)""",
)
def file_report(spark, folder):
    return asset_file_report(*_listed(spark, folder), ["asset", "unix_ts"])


_PERP = """hourly AS (SELECT event_type, user_id, date_trunc('hour', ts) AS timestamp, value FROM events),
oi AS (SELECT timestamp, event_type AS asset, max(value) AS high FROM hourly GROUP BY 1, 2),
liq AS (SELECT timestamp, event_type AS asset, count(*) AS longs FROM hourly WHERE value > 10 GROUP BY 1, 2),
ratio AS (SELECT timestamp, event_type AS asset, round(avg(value), 8) AS ratio FROM hourly WHERE value < 100 GROUP BY 1, 2)"""


@query("perp_join", f"WITH {_PERP} SELECT asset, {STAMP} AS timestamp, high, longs, ratio FROM oi JOIN liq USING (timestamp, asset) JOIN ratio USING (timestamp, asset)")
def perp_join(spark, folder):
    events = load(spark, folder, "events").withColumnRenamed("event_type", "asset")
    events = events.withColumn("timestamp", F.date_trunc("hour", "ts"))
    by = ["timestamp", "asset"]
    oi = events.groupBy(*by).agg(F.max("value").alias("high"))
    liq = events.where(F.col("value") > 10).groupBy(*by).agg(F.count(F.lit(1)).alias("longs"))
    ratio = events.where(F.col("value") < 100).groupBy(*by).agg(F.round(F.avg("value"), 8).alias("ratio"))
    return join_perp_metrics(oi, liq, ratio).withColumn("timestamp", stamp("timestamp"))


def _modalities(spark, folder):
    vectors = load(spark, folder, "embeddings").select(
        F.concat(F.lit("A"), F.col("vec_id") % 2).alias("asset"),
        F.lit("train").alias("split"),
        F.floor(F.col("vec_id") / 2).alias("row_idx"),
        "embedding",
        "label",
    )
    keys = ["asset", "split", "row_idx"]
    return [
        vectors.select(*keys, F.slice("embedding", 1, 32).alias("text_embedding")),
        vectors.select(*keys, F.slice("embedding", 33, 32).alias("image_embedding")),
        vectors.select(*keys, F.col("label").alias("target")),
    ]


@query(
    "zip_modalities",
    """SELECT 'A' || (vec_id % 2) AS asset, 'train' AS split, vec_id // 2 AS row_idx, round(list_sum(embedding[1:32]::DOUBLE[]), 5) + 0.0 AS text_sum,
  round(list_sum(embedding[33:64]::DOUBLE[]), 5) + 0.0 AS image_sum, label AS target FROM embeddings""",
)
def zip_modalities_query(spark, folder):
    total = lambda c: r(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double")), 5)
    return zip_modalities(_modalities(spark, folder)).select(
        "asset", "split", "row_idx", total("text_embedding").alias("text_sum"), total("image_embedding").alias("image_sum"), "target"
    )


@query(
    "zip_modalities_bucketed",
    """SELECT 'A' || (vec_id % 2) AS asset, 'train' AS split, vec_id // 2 AS row_idx, round(list_sum(embedding[1:32]::DOUBLE[]), 5) + 0.0 AS text_sum,
  round(list_sum(embedding[33:64]::DOUBLE[]), 5) + 0.0 AS image_sum, label AS target FROM embeddings""",
)
def zip_modalities_bucketed(spark, folder):
    """The same rows from tables that were bucketed by row key when they were written."""
    total = lambda c: r(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double")), 5)
    names = []
    for table in _modalities(spark, folder):
        names.append(f"features_{uuid.uuid4().hex}")
        write_bucketed(table, names[-1], f"{scratch_folder(spark)}/{names[-1]}", ["asset", "split", "row_idx"], buckets=16)
    return zip_bucketed(spark, names).select(
        "asset", "split", "row_idx", total("text_embedding").alias("text_sum"), total("image_embedding").alias("image_sum"), "target"
    )


@query(
    "zip_modalities_nulls",
    """WITH n AS (SELECT nullif(label % 3, 1) AS asset, vec_id AS row_idx, embedding[1] AS x, label FROM embeddings)
SELECT asset, row_idx, x, label AS target FROM n""",
)
def zip_modalities_nulls(spark, folder):
    """Rows of an asset without a name."""
    vectors = load(spark, folder, "embeddings").select(
        F.expr("nullif(label % 3, 1)").alias("asset"), F.col("vec_id").alias("row_idx"), F.col("embedding")[0].alias("x"), F.col("label").alias("target")
    )
    return zip_modalities([vectors.drop("target"), vectors.drop("x")], ["asset", "row_idx"])


@query(
    "modality_counts_nulls",
    """WITH a AS (SELECT nullif(lang, 'fr') AS lang, count(*) AS rows_0 FROM documents GROUP BY 1),
b AS (SELECT nullif(lang, 'fr') AS lang, count(*) AS rows_1 FROM documents WHERE n_chars > 1000 GROUP BY 1)
SELECT a.lang, rows_0, coalesce(rows_1, 0) AS rows_1, rows_0 = coalesce(rows_1, 0) AS equal FROM a LEFT JOIN b ON a.lang IS NOT DISTINCT FROM b.lang""",
)
def modality_counts_nulls(spark, folder):
    named = load(spark, folder, "documents").select(F.expr("nullif(lang, 'fr')").alias("lang"), "n_chars")
    return modality_counts_match([named, named.where("n_chars > 1000")], ["lang"])


@query(
    "claims_nulls",
    """WITH a AS (SELECT nullif(lang, 'fr') AS lang, count(*)::DOUBLE AS actual FROM documents GROUP BY 1),
c AS (SELECT nullif(lang, 'fr') AS lang, count(*)::DOUBLE AS claimed FROM documents WHERE text IS NOT NULL GROUP BY 1 UNION ALL SELECT 'xx', 5.0)
SELECT coalesce(a.lang, c.lang) AS lang, actual, claimed, actual - claimed AS difference, coalesce(abs(actual - claimed) < 0.01, false) AS ok
FROM a FULL JOIN c ON a.lang IS NOT DISTINCT FROM c.lang""",
)
def claims_nulls(spark, folder):
    named = load(spark, folder, "documents").select(F.expr("nullif(lang, 'fr')").alias("lang"), "text")
    count = lambda df, name: df.groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias(name))
    claimed = count(named.where("text IS NOT NULL"), "claimed").unionByName(spark.createDataFrame([("xx", 5.0)], "lang string, claimed double"))
    return compare_to_claims(count(named, "actual"), claimed, ["lang"])


@query(
    "zip_modalities_unequal",
    """WITH a AS (SELECT vec_id % 2 AS asset, vec_id // 2 AS row_idx, embedding[1] AS x FROM embeddings WHERE embedding[1] > -0.1),
b AS (SELECT vec_id % 2 AS asset, vec_id // 2 AS row_idx, label AS target FROM embeddings WHERE embedding[2] > -0.1)
SELECT asset, row_idx, x, target FROM a FULL JOIN b USING (asset, row_idx)""",
)
def zip_modalities_unequal(spark, folder):
    vectors = load(spark, folder, "embeddings").withColumns({"asset": F.col("vec_id") % 2, "row_idx": F.floor(F.col("vec_id") / 2)})
    left = vectors.where("embedding[0] > -0.1").select("asset", "row_idx", F.col("embedding")[0].alias("x"))
    right = vectors.where("embedding[1] > -0.1").select("asset", "row_idx", F.col("label").alias("target"))
    return zip_modalities([left, right], ["asset", "row_idx"], missing="null")


@query(
    "modality_counts",
    """SELECT 'A' || (vec_id % 2) AS asset, 'train' AS split, count(*) AS rows_0, count(*) AS rows_1, count(*) AS rows_2,
  true AS equal FROM embeddings GROUP BY 1""",
)
def modality_counts(spark, folder):
    return modality_counts_match(_modalities(spark, folder))


# --- features ---------------------------------------------------------------


@query(
    "prompt",
    """SELECT o_orderkey, 'Analyze cryptocurrency market sentiment.' || chr(10) || chr(10) || 'Market Data:' || chr(10)
 || '- Price return (1h): ' || printf('%.2f', c_acctbal) || '%' || chr(10)
 || '- Volume: ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || chr(10)
 || '- Funding rate: ' || printf('%.4f', c_acctbal) || chr(10)
 || '- Fear/Greed: ' || (c_nationkey * 4) || '/100' || chr(10) || chr(10)
 || 'Macro Context:' || chr(10) || '- Economy news: ' || o_custkey || ' articles (tone: ' || printf('%.1f', c_nationkey / 2) || ')' || chr(10)
 || '- Conflict news: ' || c_nationkey || ' articles' || chr(10) || chr(10)
 || 'News:' || chr(10) || c_name || ' ' || c_mktsegment || chr(10) || chr(10)
 || 'Predict 24-hour sentiment (-100 to +100).' || chr(10) || chr(10) || 'Answer: ' || printf('%.1f', c_nationkey::DOUBLE) AS prompt
FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def prompt(spark, folder):
    customer = load(spark, folder, "customer")
    rows = load(spark, folder, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.withColumns(
        {
            "whole_price": F.floor("o_totalprice").cast("double"),
            "level": F.col("c_nationkey") * 4,
            "tone": F.col("c_nationkey") / 2,
            "news": F.concat_ws(" ", "c_name", "c_mktsegment"),
            "score": F.col("c_nationkey").cast("double"),
        }
    )
    text = format_prompt(
        text_chars=None,
        return_1h="c_acctbal",
        volume="whole_price",
        funding_rate="c_acctbal",
        fear_greed_value="level",
        gdelt_econ_volume="o_custkey",
        gdelt_econ_tone="tone",
        gdelt_conflict_volume="c_nationkey",
        text_content="news",
        target_score="score",
    )
    return rows.select("o_orderkey", text)


@query("embed_text")
def embed_text(spark, folder):
    documents = load(spark, folder, "documents").select("doc_id", "text")
    return embed_column(documents, "text", encoder=encoder_of(256)).drop("text")


@query(
    "embed_resume",
    """WITH talks AS (SELECT DISTINCT coalesce(text, '') AS t FROM conversations), docs AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents)
SELECT 1 AS run, (SELECT count(*) FROM conversations) AS n_rows, (SELECT count(*) FROM talks) AS encoded
UNION ALL SELECT 2, (SELECT count(*) FROM documents), (SELECT count(*) FROM docs WHERE t NOT IN (SELECT t FROM talks))
UNION ALL SELECT 3, (SELECT count(*) FROM documents) + (SELECT count(*) FROM conversations), 0""",
)
def embed_resume(spark, folder):
    """Turns, then documents, then both once more: how many texts each run had to encode."""
    store = f"{scratch_folder(spark)}/vectors-{uuid.uuid4().hex}"
    turns, documents = load(spark, folder, "conversations").select("text"), load(spark, folder, "documents").select("text")
    out, before = None, 0
    for run, texts in enumerate([turns, documents, documents.unionByName(turns)], 1):
        rows = embed_with_store(texts, "text", store, "vector", encoder_of(64), partial(WordPieces, [*_BEGINS, *["##" + p for p in _ENDS]]), max_tokens=512)
        stored = committed.manifest(spark, store)["rows"]
        counted = rows.agg(F.count("vector").alias("n_rows")).select(F.lit(run).alias("run"), "n_rows", F.lit(stored - before).cast("long").alias("encoded"))
        out, before = counted if out is None else out.unionByName(counted), stored
    return out


_MATRIX = [[float(x) for x in row] for row in xavier_uniform(64, 16, 42)]


@query(
    "project_vectors",
    f"""WITH m AS (SELECT {_MATRIX}::DOUBLE[][] AS m), p AS (
  SELECT vec_id, list_transform(range(1, 17), lambda j: list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * m[i][j]))) AS y FROM embeddings, m)
SELECT vec_id, len(y) AS n, round(y[1], 2) + 0.0 AS first, round(y[16], 2) + 0.0 AS last, round(list_sum(y), 2) + 0.0 AS total FROM p""",
)
def project_vectors_query(spark, folder):
    out = project_vectors(load(spark, folder, "embeddings"), "embedding", "y", 64, 16)
    at = lambda i: r(F.element_at("y", i).cast("double"), 2)
    total = F.aggregate("y", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return out.select("vec_id", F.size("y").cast("long").alias("n"), at(1).alias("first"), at(-1).alias("last"), r(total, 2).alias("total"))


def _baseline(spark, folder, cols, kind="linear"):
    """Lines shipped before 1999 train, the rest is predicted."""
    lines = load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_shipdate"
    )
    early = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    out = tabular_baseline(lines.where(early), lines.where(~early), cols, "l_extendedprice", kind)
    return out.select("l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction"))


@query(
    "tabular_baseline",
    """WITH fit AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
  FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01')
SELECT l_orderkey, l_linenumber, round(a + b * l_quantity, 3) AS prediction FROM lineitem, fit WHERE l_shipdate >= TIMESTAMP '1999-01-01'""",
)
def tabular_baseline_query(spark, folder):
    return _baseline(spark, folder, ["l_quantity"])


@query("tabular_baseline_trees")
def tabular_baseline_trees(spark, folder):
    return _baseline(spark, folder, ["l_quantity", "l_discount", "l_tax"], "trees")
