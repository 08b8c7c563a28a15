"""Recognised text as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import digits, text
from ..operators.lines import lines_of_rows
from .tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def sanitize_digits(spark, sf_dir):
    """X1 on part names and documents."""
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), digits.sanitize_digits(F.col("p_name")).alias("digits"))
    d = table(spark, sf_dir, "documents").select(F.lit("document"), F.col("doc_id"), F.md5(digits.sanitize_digits(F.col("text"))))
    return p.union(d)


ORACLE_SQL["sanitize_digits"] = """
SELECT 'part' AS kind, p_partkey AS key, regexp_replace(translate(p_name, 'oOiIlL|zZsSbBgGqQ', '00111112255669999'), '[^0-9]', '', 'g') AS digits FROM part
UNION ALL SELECT 'document', doc_id, md5(regexp_replace(translate(text, 'oOiIlL|zZsSbBgGqQ', '00111112255669999'), '[^0-9]', '', 'g')) FROM documents
"""


@_query
def post_process_text(spark, sf_dir):
    """X5 on conversations."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.post_process(F.col("text")).alias("clean"))


ORACLE_SQL["post_process_text"] = r"""
SELECT conv_id, turn, array_to_string(list_transform(list_filter(
  list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(replace(trim(text, ' '), chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), chr(10)),
    lambda l: array_to_string(list_filter(regexp_split_to_array(trim(l, ' '), ' +'), lambda w: regexp_matches(w, '[\p{L}\d]')), ' ')),
  lambda l: len(l) > 0), lambda l: upper(l[1]) || l[2:]), chr(10)) AS clean
FROM conversations
"""


@_query
def text_rows(spark, sf_dir):
    """Lines of a document are spread over four equal rows of a 1000-pixel image; text of each row by its lines' middles, none where no line is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    lines = docs.select("doc_id", F.size("l").alias("n"), F.posexplode("l").alias("i", "line")).select("doc_id", ((F.col("i") + 0.5) * (1000.0 / F.col("n"))).alias("middle"), "line")
    rows = spark.range(4).select(F.col("id").cast("int").alias("row"), (F.col("id") * 250.0).alias("top"), (F.col("id") * 250.0 + 250).alias("bottom"))
    found = lines_of_rows(docs.select("doc_id"), rows, lines, "doc_id")
    return found.groupBy("doc_id", "row").agg(F.count("line").alias("lines"), F.coalesce(F.sum(F.length("line")), F.lit(0)).alias("chars"))


ORACLE_SQL["text_rows"] = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
u AS (SELECT doc_id, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM l),
p AS (SELECT DISTINCT doc_id, r AS row FROM documents, (SELECT CAST(unnest(range(4)) AS INT) AS r))
SELECT p.doc_id, p.row, count(line) AS lines, CAST(coalesce(sum(length(line)), 0) AS BIGINT) AS chars
FROM p LEFT JOIN u ON u.doc_id = p.doc_id AND (i + 0.5) * (1000.0 / n) >= p.row * 250.0 AND (i + 0.5) * (1000.0 / n) < p.row * 250.0 + 250 GROUP BY p.doc_id, p.row
"""


@_query
def fuzzy_similarity(spark, sf_dir):
    """Nations against the regions' names; passes if all of a nation's are at 0.6, partly at two thirds."""
    pairs = table(spark, sf_dir, "nation").crossJoin(F.broadcast(table(spark, sf_dir, "region"))).select("n_nationkey", text.clue_similarity(F.col("n_name"), F.col("r_name")).alias("sim"))
    return pairs.groupBy("n_nationkey").agg(F.round(F.max("sim"), 9).alias("best"), F.count_if(F.col("sim") >= 0.3).alias("good")).withColumn("verdict", F.when(F.col("good") == 5, "PASS").when(F.col("good") >= 4, "PARTIAL").otherwise("FAIL"))


ORACLE_SQL["fuzzy_similarity"] = """
WITH p AS (SELECT n_nationkey, lower(trim(n_name)) AS a, lower(trim(r_name)) AS b FROM nation, region),
s AS (SELECT n_nationkey, CASE WHEN a = b THEN 1.0 ELSE 1 - levenshtein(a, b) / CAST(greatest(len(a), len(b)) AS DOUBLE) END AS sim FROM p),
g AS (SELECT n_nationkey, round(max(sim), 9) AS best, count(*) FILTER (sim >= 0.3) AS good FROM s GROUP BY n_nationkey)
SELECT *, CASE WHEN good = 5 THEN 'PASS' WHEN good >= 4 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM g
"""


@_query
def html_words(spark, sf_dir):
    """X6 on pages marked up as recognised words: links are words, their place the box."""
    pages = table(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit('<a href="/[^"]*">([^<]*)</a>'), F.lit(1))
    marked = F.array_join(F.transform(links, lambda w, i: F.concat(F.lit("<span class='ocrx_word' title='bbox 0 "), (i * 10).cast("string"), F.lit(" 50 "), (i * 10 + 8).cast("string"), F.lit("; x_wconf "), (F.length(w) * 7 % 100).cast("string"), F.lit("'>"), w, F.lit("</span>"))), "")
    words = pages.select("page_id", F.explode(text.hocr_words(marked)).alias("w")).select("page_id", "w.*")
    return words.groupBy("page_id").agg(F.count(F.lit(1)).alias("words"), F.max("y1").alias("bottom"), F.round(F.least(F.lit(1.0), F.coalesce(F.avg("confidence") / 100, F.lit(0.0))), 9).alias("confidence"))


ORACLE_SQL["html_words"] = """
WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1) AS w FROM pages),
u AS (SELECT page_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM l)
SELECT page_id, count(*) AS words, CAST(max(i * 10 + 8) AS INT) AS bottom, round(least(1.0, avg(length(w) * 7 % 100) / 100), 9) AS confidence FROM u GROUP BY page_id
"""


@_query
def ctc_decode(spark, sf_dir):
    """The event types of a user's day as raw symbols, views are blanks; equal neighbours count once."""
    day = F.to_date("ts")
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", day.alias("day"), "ts", "event_id", "event_type").withColumn("before", F.lag("event_type").over(w))
    kept = e.where("event_type <> 'view' and (before is null or before <> event_type)")
    symbols = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.substring("event_type", 1, 1).alias("c"))))
    return kept.groupBy("user_id", "day").agg(F.array_join(F.transform(symbols, lambda x: x["c"]), "").alias("decoded"))


ORACLE_SQL["ctc_decode"] = """
SELECT user_id, day, string_agg(event_type[1], '' ORDER BY ts, event_id) AS decoded
FROM (SELECT *, CAST(ts AS DATE) AS day, lag(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS before FROM events)
WHERE event_type <> 'view' AND (before IS NULL OR before <> event_type) GROUP BY user_id, day
"""


@_query
def clue_lookup(spark, sf_dir):
    """Turns by their place, from 0 to the conversation's last; of texts of one place the later one counts (by role, then text, as the table has no time); missing places are empty."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("row"), (F.length("text") % 100 / 100).alias("confidence"), F.length("text").alias("size"), F.struct("role", "text").alias("ord"))
    found = c.groupBy("conv_id", "row").agg(F.max_by(F.struct("size", "confidence"), "ord").alias("m"))
    places = c.groupBy("conv_id").agg(F.max("row").alias("last")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("row"))
    size = F.coalesce("m.size", F.lit(0))
    return places.join(found, ["conv_id", "row"], "left").select("conv_id", "row", size.alias("size"), F.coalesce(F.col("m.confidence") < 0.6, F.lit(False)).alias("warn"), text.elapsed(size).alias("elapsed"))


ORACLE_SQL["clue_lookup"] = """
WITH l AS (SELECT conv_id, turn AS row, length(text) AS size FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY encode(role) DESC, encode(text) DESC) AS i FROM conversations) WHERE i = 1),
p AS (SELECT conv_id, CAST(unnest(range(0, max(turn) + 1)) AS BIGINT) AS row FROM conversations GROUP BY conv_id)
SELECT p.conv_id, p.row, CAST(coalesce(size, 0) AS INT) AS size, coalesce(size % 100 / 100 < 0.6, false) AS warn, printf('%02d:%02d', coalesce(size, 0) // 60, coalesce(size, 0) % 60) AS elapsed
FROM p LEFT JOIN l ON l.conv_id = p.conv_id AND l.row = p.row
"""


@_query
def formatted(spark, sf_dir):
    """Formats of names, sizes, letters and codes."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.stem(F.concat("p_brand", F.lit(".v1.jpg"))).alias("stem"), text.letter_input(F.col("p_type")).alias("letter"), text.ctc_encode(F.col("p_size").cast("string")).alias("codes"), text.file_stamp(F.lit("2020-01-01T10:20:30")).alias("stamp"))


ORACLE_SQL["formatted"] = """
SELECT p_partkey, p_brand || '.v1' AS stem, right(regexp_replace(upper(p_type), '[^A-ZÀ-Ü]', '', 'g'), 1) AS letter,
  list_concat(list_transform(string_split(CAST(p_size AS VARCHAR), ''), lambda c: CAST(c AS INT) + 1), [0, 0, 0, 0])[1:4] AS codes, '2020-01-01T10-20-30' AS stamp FROM part
"""


@_query
def scalar_rules(spark, sf_dir):
    """Readings, confidences, log lines, similarities and roundings of parts."""
    from ..functions import digits, geometry

    p = table(spark, sf_dir, "part")
    price = F.col("p_retailprice")
    line = F.concat(F.lit("[ocr] pista "), (F.col("p_partkey") % 31).cast("string"), F.lit(': "'), F.col("p_type"), F.lit('" conf='), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 7 > 0, "%").otherwise(""))
    return p.select(
        "p_partkey", digits.strict_number(F.concat(F.lit("n"), (F.col("p_partkey") % 131).cast("string"), F.lit(" x"))).alias("s"), text.log_line(line).alias("l"), text.clamp_confidence(price / 10 - 20).alias("confidence"),
        F.round(geometry.feature_similarity(price / 1000), 9).alias("similarity"), F.round(geometry.hu_log(price / 1000 - 1.2), 7).alias("hu"), digits.js_round(F.col("p_size") / 2 - 12).alias("rounded"),
    ).select("p_partkey", "s.number", "s.digits", F.col("l.number").alias("clue"), "l.text", F.col("l.confidence").alias("percent"), "confidence", "similarity", "hu", "rounded")


ORACLE_SQL["scalar_rules"] = """
WITH p AS (SELECT *, CAST(p_partkey % 131 AS VARCHAR) AS d, p_retailprice / 1000 - 1.2::DOUBLE AS h FROM part)
SELECT p_partkey, CASE WHEN CAST(left(d, 2) AS INT) BETWEEN 1 AND 27 THEN CAST(left(d, 2) AS INT) END AS number, d AS digits,
  CASE WHEN p_partkey % 7 > 0 THEN CAST(p_partkey % 31 AS VARCHAR) END AS clue, CASE WHEN p_partkey % 7 > 0 THEN p_type END AS text, CASE WHEN p_partkey % 7 > 0 THEN CAST(p_size AS VARCHAR) END AS percent,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, (p_retailprice / 10 - 20) / 100)) AS confidence, round(1 / (1 + p_retailprice / 1000), 9) AS similarity, round(-sign(h) * log10(abs(h) + 1), 7) AS hu, CAST(floor(p_size / 2 - 12 + 0.5) AS BIGINT) AS rounded
FROM p
"""
