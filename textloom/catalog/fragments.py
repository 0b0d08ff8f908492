"""Inputs derived from the test tables, and the SQL text that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import CONTROL_CHARS, HTML_TAG, LINE_SPACE_CLASS, SPACE_CLASS
from textloom.session import materialize

NL = "chr(10)"


# ---- documents with one kind of dirt per source ----------------------------

def messy(docs: DataFrame) -> DataFrame:
    """Documents where some sources carry markup, tags, control bytes, URLs or junk."""
    t = F.col("text")
    dirt = {
        "src0": F.concat(t, F.lit(" -{zh-cn:"), F.col("lang"), F.lit(";zh-tw:"), F.col("source"), F.lit("}- end")),
        "src1": F.concat(F.lit('<p class="x">'), t, F.lit("</p>")),
        "src2": F.replace(t, F.lit(" "), F.lit("\x07 ")),
        "src3": F.concat(t, F.lit(" see https://example.org/"), F.col("doc_id").cast("string")),
        "src4": F.regexp_replace(t, "[a-z]", "#"),
        "src5": F.repeat(F.lit("a"), F.length(t)),
        "src6": F.left(t, F.lit(15)),
    }
    dirty = F.coalesce(*[F.when(F.col("source") == s, v) for s, v in dirt.items()], t)
    return docs.select("doc_id", dirty.alias("text"), "lang", "source")


MESSY = """
messy AS (
  SELECT doc_id, lang, source, CASE source
    WHEN 'src0' THEN text || ' -{zh-cn:' || lang || ';zh-tw:' || source || '}- end'
    WHEN 'src1' THEN '<p class="x">' || text || '</p>'
    WHEN 'src2' THEN replace(text, ' ', chr(7) || ' ')
    WHEN 'src3' THEN text || ' see https://example.org/' || doc_id
    WHEN 'src4' THEN regexp_replace(text, '[a-z]', '#', 'g')
    WHEN 'src5' THEN repeat('a', length(text))
    WHEN 'src6' THEN left(text, 15)
    ELSE text END AS text
  FROM documents)"""


# ---- text rules ------------------------------------------------------------

def sql_tidy(x: str) -> str:
    x = f"replace(replace({x}, chr(13) || chr(10), {NL}), chr(13), {NL})"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', {NL} || {NL}, 'g')"
    x = f"regexp_replace({x}, '[{LINE_SPACE_CLASS}]+\\n', {NL}, 'g')"
    return sql_strip(x)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$', '', 'g')"


def sql_controls(x: str) -> str:
    return f"regexp_replace({x}, '{CONTROL_CHARS}', '', 'g')"


def sql_normalize(x: str) -> str:
    x = f"regexp_replace(nfc_normalize({x}), '{HTML_TAG}', ' ', 'g')"
    x = f"regexp_replace({x}, '-\\{{zh-cn:[^;]*;zh-tw:([^}}]*)\\}}-', '\\1', 'g')"
    return sql_tidy(sql_controls(x))


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE_CLASS}]+', ' ', 'g'), ' ')"


def sql_symbols(x: str) -> str:
    content = f"[\\p{{L}}\\p{{N}}{SPACE_CLASS}\\x{{4e00}}-\\x{{9fff}}]+"
    return (
        f"(CASE WHEN length({x}) = 0 THEN 1.0 ELSE "
        f"length(regexp_replace({x}, '{content}', '', 'g'))::DOUBLE / length({x}) END)"
    )


def sql_top_share(table: str, key: str = "doc_id", text: str = "text") -> str:
    """Subquery (key, top_share) for every row with a non-space character."""
    return f"""
(SELECT {key}, max(n)::DOUBLE / sum(n) AS top_share FROM (
   SELECT {key}, ch, count(*) AS n
   FROM (SELECT {key}, unnest(string_split({text}, '')) AS ch FROM {table})
   WHERE ch <> '' AND NOT regexp_matches(ch, '^[{SPACE_CLASS}]$')
   GROUP BY {key}, ch) GROUP BY {key})"""


def sql_judged(table: str, text: str) -> str:
    """CTEs clean and judged (doc_id, lang, source, text, reason) of a document table."""
    return f"""
clean AS (SELECT doc_id, lang, source, {text} AS text FROM {table}),
judged AS (
  SELECT c.*, CASE WHEN length(c.text) < 20 THEN 'too_short'
    WHEN {sql_symbols('c.text')} > 0.3 THEN 'too_many_symbols'
    WHEN coalesce(t.top_share, 1.0) > 0.3 THEN 'too_repetitive' ELSE 'ok' END AS reason
  FROM clean c LEFT JOIN {sql_top_share('clean')} t USING (doc_id))"""


JUDGED_MESSY = f"{MESSY}, {sql_judged('messy', sql_normalize('text'))}"

# ---- the documents as one character stream ---------------------------------

STREAM = f"""
whole AS (SELECT string_agg(text, {NL} || {NL} ORDER BY doc_id) AS body FROM documents),
chars AS MATERIALIZED (SELECT generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS ch FROM (SELECT string_split(body, '') AS c FROM whole)),
sizes AS (
  SELECT total, greatest(1, floor(total * 0.1))::BIGINT AS n_val, greatest(1, floor(total * 0.1))::BIGINT AS n_test
  FROM (SELECT length(body) AS total FROM whole)),
split_chars AS MATERIALIZED (
  SELECT pos, ch, CASE WHEN pos < total - n_val - n_test THEN 'train' WHEN pos < total - n_test THEN 'val' ELSE 'test' END AS split
  FROM chars, sizes)"""

# ---- conversation turns as prompt and response -----------------------------

def exchanges(turns: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows, numbered by position of the answer."""
    ask = turns.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    reply = turns.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("response"))
    pairs = ask.join(reply, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "conv_id", "prompt", "response"
    )
    return materialize(pairs, "exchanges", heavy=True)


EXCHANGES = """
exchanges AS MATERIALIZED (
  SELECT b.conv_id * 1000 + b.turn AS pair_id, b.conv_id, a.text AS prompt, b.text AS response
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""


# ---- events read as serving requests and as training logs ------------------

CANARY_PCT, SHADOW_PCT = 20, 50


def requests(events: DataFrame) -> DataFrame:
    """One request per event: endpoint, status, latency, tokens, batch size, variant."""
    from textloom.operators.telemetry import canary_routing

    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).cast("bigint").alias("status"),
        (F.col("value") / 100).alias("latency"), k.alias("tokens"), (F.pmod(k, F.lit(8)) + 1).alias("batch_size"),
    )
    return canary_routing(rows, CANARY_PCT, SHADOW_PCT)


REQUESTS = f"""
requests AS MATERIALIZED (
  SELECT event_id, ts, user_id, event_type AS endpoint, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
    value / 100 AS latency, (props::JSON->>'k')::BIGINT AS tokens, (props::JSON->>'k')::BIGINT % 8 + 1 AS batch_size,
    CASE WHEN ('0x' || left(sha1(event_id::VARCHAR), 8))::BIGINT % 100 < {CANARY_PCT} THEN 'canary' ELSE 'production' END AS variant,
    ('0x' || left(sha1('shadow:' || event_id), 8))::BIGINT % 100 < {SHADOW_PCT} AS shadowed
  FROM events)"""


def run_log(events: DataFrame) -> DataFrame:
    """Event types as runs and days as steps; the metric columns are daily aggregates."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("step")).agg(
        F.avg(F.log1p("value")).alias("train_loss"), (F.avg(F.log1p("value") * (k + 50)) / 90).alias("val_loss"),
        F.max("value").alias("reward"), (F.countDistinct("user_id") / F.count("*")).alias("diversity"),
        F.avg((k < 50).cast("double")).alias("train_acc"), F.avg((F.col("value") < 50).cast("double")).alias("held_acc"),
    )


RUN_LOG = """
run_log AS MATERIALIZED (
  SELECT event_type AS run, day(ts) AS step, avg(ln(1 + value)) AS train_loss, avg(ln(1 + value) * (k + 50)) / 90 AS val_loss,
    max(value) AS reward, count(DISTINCT user_id)::DOUBLE / count(*) AS diversity,
    avg((k < 50)::INT) AS train_acc, avg((value < 50)::INT) AS held_acc
  FROM (SELECT *, (props::JSON->>'k')::BIGINT AS k FROM events) GROUP BY 1, 2)"""
