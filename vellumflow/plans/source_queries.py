"""Queries over sources, sinks, scalar rules, jobs and streams, each with its result in SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import captions, geometry, scalars, text
from ..operators import decisions, document, metrics
from ..sources import sinks, tables
from ..streaming import gate, queue
from . import assemble, chain
from .derive import FRAMES_SQL, WORDS_SQL, frames, table, tokens, words
from .queries import BENCH_SQL, ESCAPE_SQL, GATE_SQL
from .registry import query


@query(f"""WITH {BENCH_SQL}
SELECT item_id, pos + 2 AS pos, token AS text, 90.5::DOUBLE AS conf, CAST(pos % 10 * 60 AS INT) AS left, CAST(pos // 10 AS INT) AS line_num FROM bt WHERE pos % 6 <> 5 AND token <> ''""")
def tsv_words(spark, sf_dir):
    """Passages written as recognisers' word files, a header and rows that are no words among them, and read back."""
    t = tokens(table(spark, sf_dir, "benchmark"), "item_id")
    level = F.when(F.col("pos") % 12 == 5, 4).otherwise(5)
    conf = F.when(F.col("pos") % 12 == 11, "-1").otherwise("90.5")
    body = t.select("item_id", (F.col("pos") + 2).alias("at"), F.concat_ws("\t", level, *[F.lit(1)] * 3, F.expr("pos div 10"), F.expr("pos % 10 + 1"), F.expr("pos % 10 * 60"), F.expr("pos div 10 * 24"), F.lit(50), F.lit(18), conf, F.concat(F.lit(" "), "token")).alias("value"))
    items = table(spark, sf_dir, "benchmark").select("item_id")
    head = items.select("item_id", F.lit(0).alias("at"), F.lit("\t".join(tables.TSV)).alias("value")).union(items.select("item_id", F.lit(1).alias("at"), F.lit("1\t1\t0\t0\t0\t0\t0\t0\t9\t9\t-1\t").alias("value")))
    files = head.unionByName(body).groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s.value), "\n").alias("value"))
    path = sinks.scratch(spark, "tsv")
    files.write.partitionBy("item_id").text(path)
    found = tables.words_tsv(spark, path)
    return found.select(F.regexp_extract("file", "item_id=([0-9]+)", 1).cast("bigint").alias("item_id"), F.col("pos").cast("bigint").alias("pos"), "text", "conf", "left", "line_num")


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 4 * 90 AS INT) END AS rotate, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS conf FROM events""")
def osd_fields(spark, sf_dir):
    """Orientation reports as text, some with fields that are missing or no numbers."""
    lines = F.concat_ws("\n", F.lit("Page number: 0"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("Rotate: "), F.col("event_id") % 4 * 90)).otherwise("Rotate: none"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("Orientation confidence: "), F.col("value").cast("string"))))
    return table(spark, sf_dir, "events").withColumn("o", tables.parse_osd(lines)).select("event_id", "o.rotate", "o.conf")


@query("""SELECT 'img_' || item_id AS image_id, CASE item_id % 3 WHEN 0 THEN 'eng' WHEN 1 THEN 'bul' ELSE 'deu' END AS language, CASE WHEN item_id % 4 = 0 THEN NULL ELSE item_id || '.txt' END AS gt_file, text AS notes FROM benchmark""")
def manifest_rows(spark, sf_dir):
    """A manifest with quoted cells that hold quotes, commas and line ends."""
    b = table(spark, sf_dir, "benchmark")
    cell = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.concat(F.lit("img_"), "item_id"), F.concat("item_id", F.lit(".jpg")), F.expr("CASE item_id % 3 WHEN 0 THEN 'eng' WHEN 1 THEN 'bul' ELSE 'deu' END"), F.when(F.col("item_id") % 4 == 0, "").otherwise(F.concat("item_id", F.lit(".txt"))), F.lit("books"), cell)
    head = F.lit("image_id,file,language,gt_file,category,notes")
    path = sinks.scratch(spark, "manifest")
    b.groupBy().agg(F.concat_ws("\n", head, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", line.alias("line")))), lambda s: s.line), "\n")).alias("value")).write.text(path)
    return tables.manifest(spark, path).select("image_id", "language", "gt_file", "notes")


STAGE_DEFAULTS = {"fuse": {"share": 0.7, "pad": 3}, "split": {"valley": 0.55, "pad": 3}, "dewarp": {"lines": 6}, "layout": {"gap": 12}}


@query("""SELECT r_name AS region, stage, name, CASE WHEN r_regionkey % 2 = 1 AND name IN ('pad', 'gap') THEN (r_regionkey * 10)::DOUBLE ELSE value END AS value
FROM region, (VALUES ('fuse', 'share', 0.7::DOUBLE), ('fuse', 'pad', 3), ('split', 'valley', 0.55), ('split', 'pad', 3), ('dewarp', 'lines', 6), ('layout', 'gap', 12)) d(stage, name, value)""")
def stage_params(spark, sf_dir):
    """Parameters of stages by precedence: defaults, and what a configuration names of them."""
    rows = []
    for r in table(spark, sf_dir, "region").collect():  # five regions stand for configurations
        own = {"pad": r.r_regionkey * 10, "gap": r.r_regionkey * 10, "unknown": 1}
        config = chain.parse_config(json.dumps({s: own for s in STAGE_DEFAULTS}) if r.r_regionkey % 2 else "", ".json")
        for stage, defaults in STAGE_DEFAULTS.items():
            rows += [(r.r_name, stage, k, float(v)) for k, v in chain.resolve_params(defaults, config, stage).items()]
    return spark.createDataFrame(rows, "region string, stage string, name string, value double")


@query("""WITH t AS (SELECT unnest(string_split_regex(text, '[ \\t\\n\\r]+')) AS t FROM benchmark) SELECT DISTINCT lower(regexp_replace(t, '[^0-9a-zA-Zа-яёА-ЯЁ]+', '', 'g')) AS token FROM t WHERE lower(regexp_replace(t, '[^0-9a-zA-Zа-яёА-ЯЁ]+', '', 'g')) <> ''""")
def overlay_words(spark, sf_dir):
    """A word list read from text files, in lexicon form."""
    path = sinks.scratch(spark, "words")
    table(spark, sf_dir, "benchmark").select("text").write.text(path)
    return tables.word_list(spark, path)


CYRILLIC = ("abcdeghiklmnoprstuvy", "абцдегхиклмнопрстувы")


@query(f"""WITH {BENCH_SQL}, l AS (SELECT pos, translate(regexp_replace(lower(token), '[^a-z]', '', 'g'), '{CYRILLIC[0]}', '{CYRILLIC[1]}') AS name FROM bt), n AS (SELECT DISTINCT name AS token FROM l WHERE pos % 2 = 0 OR pos % 3 = 0 UNION SELECT DISTINCT name || 'ово' FROM l WHERE pos % 3 = 0)
SELECT token FROM n WHERE regexp_matches(token, '[Ѐ-ӿ]')""")
def gazetteer_tokens(spark, sf_dir):
    """Names and alternative names of places, as a gazetteer's lines; Latin names and short lines fall out."""
    t = tokens(table(spark, sf_dir, "benchmark"), "item_id")
    name = F.translate(F.regexp_replace(F.lower("token"), "[^a-z]", ""), *CYRILLIC)
    line = F.concat_ws("\t", "pos", F.when(F.col("pos") % 2 == 0, name).otherwise("Plain Name"), F.lit("ascii"), F.when(F.col("pos") % 3 == 0, F.concat(F.lit("Alt,"), name, F.lit(","), name, F.lit("ово"))).otherwise("Other"), F.lit("x"))
    path = sinks.scratch(spark, "places")
    t.select(line.alias("value")).union(t.select(F.concat_ws("\t", "pos", name).alias("value"))).write.text(path)
    return tables.gazetteer(spark, path)


AFFIXES = """SET UTF-8
SFX S Y 2
SFX S 0 s [^y]
SFX S y ies y
PFX U Y 1
PFX U 0 un .
SFX D N 1
SFX D 0 ed [^e]"""


@query(f"""WITH {BENCH_SQL}, s AS (SELECT DISTINCT regexp_replace(lower(token), '[^a-z]', '', 'g') AS w FROM bt), k AS (SELECT w, length(w) % 2 = 0 AS sfx, length(w) % 3 = 0 AS pfx, length(w) % 5 = 0 AS ed FROM s WHERE w <> ''),
p AS (SELECT w, pfx, CASE WHEN ends_with(w, 'y') THEN left(w, length(w) - 1) || 'ies' ELSE w || 's' END AS plural FROM k WHERE sfx)
SELECT w AS token FROM k UNION SELECT plural FROM p UNION SELECT 'un' || w FROM k WHERE pfx UNION SELECT 'un' || plural FROM p WHERE pfx UNION SELECT w || 'ed' FROM k WHERE ed AND NOT ends_with(w, 'e')""")
def affix_forms(spark, sf_dir):
    """Every form of a dictionary's stems under its suffixes and prefixes, which cross where the rules allow it."""
    w = tokens(table(spark, sf_dir, "benchmark"), "item_id").select(F.regexp_replace(F.lower("token"), "[^a-z]", "").alias("w")).filter("w <> ''").distinct()
    n = F.length("w")
    flags = F.concat(*[F.when(n % k == 0, f).otherwise("") for k, f in ((2, "S"), (3, "U"), (5, "D"))])
    dic, aff = sinks.scratch(spark, "dic"), sinks.scratch(spark, "aff")
    w.select(F.concat("w", F.when(flags != "", F.concat(F.lit("/"), flags)).otherwise("")).alias("value")).write.text(dic)
    spark.createDataFrame([(AFFIXES,)], "value string").write.text(aff)
    return tables.hunspell(spark, dic, aff)


@query("""SELECT unnest(['walk', 'walks', 'unwalk', 'unwalks', 'sofia', 'varna']) AS token""")
def loaded_lexicon(spark, sf_dir):
    """The lexicon of the first path that has one: a dictionary with its affixes, and the names beside it."""
    root = sinks.scratch(spark, "lexicons")
    for name, lines in (("en.dic", "1\nwalk/SU"), ("en.aff", AFFIXES), ("en.geo.txt", "Sofia Varna"), ("other.txt", "never")):
        spark.createDataFrame([(lines,)], "value string").write.text(f"{root}/{name}")
    return tables.lexicon(spark, ["", f"{root}/missing.txt", f"{root}/en.txt", f"{root}/other.txt"])


@query(f"""WITH {BENCH_SQL}, t AS (SELECT DISTINCT lower(token) AS token FROM bt), x AS (SELECT DISTINCT CASE WHEN length(token) % 3 = 1 THEN upper(left(token, 1)) || lower(substr(token, 2)) ELSE token END AS w FROM bt WHERE length(token) % 3 <> 0)
SELECT token, EXISTS (SELECT 1 FROM x WHERE w = token) OR EXISTS (SELECT 1 FROM x WHERE w = upper(left(token, 1)) || substr(token, 2)) AS known FROM t WHERE regexp_matches(token, '^[a-z]+$')""")
def lexicon_known(spark, sf_dir):
    """Tokens that a lexicon knows as they are or capitalised."""
    t = tokens(table(spark, sf_dir, "benchmark"), "item_id").select("token")
    lexicon = t.filter("length(token) % 3 <> 0").select(F.when(F.length("token") % 3 == 1, text.capitalized(F.col("token"))).otherwise(F.col("token")).alias("token"))
    return tables.in_lexicon(t.select(F.lower("token").alias("token")).filter("token rlike '^[a-z]+$'").distinct(), lexicon)


@query(f"""WITH {BENCH_SQL}, s AS (SELECT count(DISTINCT token) AS n FROM bt WHERE pos % 2 = 0), o AS (SELECT count(DISTINCT token) AS n FROM bt WHERE pos % 2 = 1) SELECT CAST(s.n + o.n AS BIGINT) AS words, EXISTS (SELECT 1 FROM bt WHERE token IN ('the', 'The')) AS ok FROM s, o""")
def lexicon_facts(spark, sf_dir):
    """How many words a lexicon lists, and whether it knows a word that it must."""
    t = tokens(table(spark, sf_dir, "benchmark"), "item_id")
    size = tables.lexicon_size(t.filter("pos % 2 = 0").select("token").distinct(), t.filter("pos % 2 = 1").select("token").distinct())
    return size.withColumn("ok", F.lit(tables.lexicon_works(t, "the").first().ok))


@query("""WITH f AS (SELECT 'file:/scan/u' || user_id || '/f' || lpad(CAST(event_id AS VARCHAR), 8, '0') || CASE event_id % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.dng' WHEN 3 THEN '.txt' ELSE '.webp' END AS path, user_id, event_id % 5 AS k FROM events)
SELECT path, CAST(row_number() OVER (PARTITION BY user_id ORDER BY path) - 1 AS INT) AS frame, k = 2 AS skipped FROM f WHERE k <> 3""")
def scan_order(spark, sf_dir):
    """Image files of folders in order; raw ones keep their number though they are skipped, other files have none."""
    path = F.expr("concat('file:/scan/u', user_id, '/f', lpad(event_id, 8, '0'), CASE event_id % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.dng' WHEN 3 THEN '.txt' ELSE '.webp' END)")
    return tables.numbered(table(spark, sf_dir, "events").select(path.alias("path"))).select("path", "frame", "skipped")


@query("""SELECT 'img' || p_partkey AS image_id, CASE WHEN p_partkey % 10 = 0 THEN 'fixed/' ELSE 'set/' END || p_partkey || '.jpg' AS path FROM part""")
def anchor_paths(spark, sf_dir):
    """Images of a test set, some at a place of their own."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("img"), "p_partkey").alias("image_id"), "p_partkey")
    return tables.anchors(p.select("image_id", F.concat(F.lit("set/"), "p_partkey", F.lit(".jpg")).alias("path")), p.filter("p_partkey % 10 = 0").select("image_id", F.concat(F.lit("fixed/"), "p_partkey", F.lit(".jpg")).alias("path")))


@query("""SELECT page_id, 'data:image/png;base64,' || to_base64(encode(html)) AS uri FROM pages""")
def data_uris(spark, sf_dir):
    """Bytes as data URIs on one line, however long."""
    return table(spark, sf_dir, "pages").select("page_id", text.data_uri(F.col("html").cast("binary")).alias("uri"))


@query("""WITH f AS (SELECT r_name, string_agg('"' || n_name || '"', ', ' ORDER BY n_name) AS fonts, string_agg('@font-face{font-family:"' || n_name || '";src:url(data:' || n_nationkey || ')}', chr(10) ORDER BY n_name) FILTER (n_nationkey % 2 = 0) AS faces FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name)
SELECT r_name, 'body{font-family:' || fonts || ', serif}.flag{background:#fff3a0}.figure-block{margin:1em 0}' AS css FROM f UNION ALL
SELECT 'faces', string_agg('@font-face{font-family:"' || n_name || '";src:url(data:' || n_nationkey || ')}', chr(10) ORDER BY n_name) FROM nation WHERE n_nationkey % 2 = 0""")
def style_sheets(spark, sf_dir):
    """A style sheet for each region with its nations as fonts, and the rules of fonts that there are."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sheets = n.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("fonts")).select("r_name", document.stylesheet(F.col("fonts")).alias("css"))
    fonts = n.select(F.col("n_name").alias("family"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("data:"), "n_nationkey")).alias("uri"))
    return sheets.union(document.font_faces(fonts).select(F.lit("faces").alias("r_name"), "css"))


@query("""WITH r AS (SELECT lang, avg(CASE WHEN toxic = 1 THEN 1.0 WHEN toxic = 0 THEN 0.0 END) AS share, avg(quality) AS q FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang)
SELECT 0 AS ord, '## Languages' AS line UNION ALL SELECT 1, '| lang | share | q | tau |' UNION ALL SELECT 2, '|---|---|---|---|' UNION ALL
SELECT 3, '| ' || lang || ' | ' || CASE WHEN share IS NULL THEN '—' ELSE printf('%.1f%%', share * 100) END || ' | ' || CASE WHEN q IS NULL THEN '—' ELSE printf('%.3f', q) END || ' | ' || CASE WHEN q IS NULL THEN 'n/a' ELSE printf('%+.2f', q - 0.25) END || ' |' FROM r""")
def report_table(spark, sf_dir):
    """A report's lines: a title, a head, and a row for each language with formatted shares."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    share = F.avg(F.when(F.col("toxic") == 1, 1.0).when(F.col("toxic") == 0, 0.0))
    by = rows.groupBy("lang").agg(share.alias("s"), F.avg("quality").alias("v"))
    return sinks.report_lines(by.select("lang", text.percent(F.col("s")).alias("share"), text.three_places(F.col("v")).alias("q"), text.signed_tau(F.col("v") - 0.25).alias("tau")), "Languages", ["lang", "share", "q", "tau"])


@query("""SELECT '{"lang":"' || lang || '","n":' || count(*) || ',"sources":[' || string_agg(DISTINCT '"' || source || '"', ',' ORDER BY '"' || source || '"') || ']}' AS json FROM documents GROUP BY lang""")
def grades_json(spark, sf_dir):
    """Grouped rows as JSON."""
    by = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"))
    return sinks.as_json(by)


SCALARS_SQL = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'patch' WHEN 1 THEN 'best_guess' WHEN 2 THEN 'flag' WHEN 3 THEN 'best_guess' ELSE 'flag' END AS mode,
  least(CASE WHEN event_id % 3 = 0 THEN 45.0 ELSE value END, CASE WHEN event_id % 2 = 0 THEN 75.0 ELSE 20.0 END)::DOUBLE AS low, greatest(CASE WHEN event_id % 3 = 0 THEN 45.0 ELSE value END, CASE WHEN event_id % 2 = 0 THEN 75.0 ELSE 20.0 END)::DOUBLE AS high,
  CASE WHEN event_type = 'view' THEN 'patch' ELSE 'flag' END AS job_mode, event_id % 4 IN (0, 1) AS valid,
  CASE event_id % 4 WHEN 0 THEN 'eng' WHEN 1 THEN 'ita+bul' WHEN 2 THEN 'klingon+deu' ELSE 'deu' END AS language, CASE event_id % 4 WHEN 0 THEN 'eng' WHEN 1 THEN 'ita' WHEN 2 THEN 'deu' ELSE 'ita' END AS lang_key,
  user_id % 8 IN (2, 4, 5, 7) AS mirrored FROM events"""


@query(SCALARS_SQL)
def scalar_rules(spark, sf_dir):
    """Modes, rails, job names, languages and mirroring, as small rules give them."""
    e, m = table(spark, sf_dir, "events"), F.col("event_id")
    asked = F.when(m % 5 == 0, "patch").when(m % 5 == 1, "best_guess").when(m % 5 == 2, "flag")
    configured = F.when(m % 5 == 3, "best_guess")
    rails = scalars.rails(F.lit(None).cast("double"), F.when(m % 3 != 0, F.col("value")), F.when(m % 2 == 0, 75.0).otherwise(20.0))
    payload = F.when(F.col("event_type") == "view", F.lit('{"mode":"patch"}')).when(F.col("event_type") == "click", F.lit('{"mode":"zap"}')).otherwise(F.lit("{"))
    job = F.when(m % 4 == 0, "a-b_9").when(m % 4 == 1, F.concat(F.lit("x"), m)).when(m % 4 == 2, F.lit("../x")).otherwise(F.lit("a\n"))
    lang = F.when(m % 4 == 0, " English ").when(m % 4 == 1, "it+Bulgarian").when(m % 4 == 2, "klingon+ger").otherwise("")
    return e.withColumn("r", rails).select(
        "event_id", scalars.resolve_mode(asked, configured).alias("mode"), "r.floor", "r.ceiling", scalars.job_mode(payload).alias("job_mode"), scalars.valid_job_id(job).alias("valid"),
        captions.resolve_language(lang, "deu").alias("language"), captions.lang_key(lang).alias("lang_key"), scalars.mirrored(F.col("user_id") % 8).alias("mirrored"),
    ).withColumnsRenamed({"floor": "low", "ceiling": "high"})


@query("""SELECT event_id, CAST(trunc(user_id * 7 / 2.0) AS INT) AS x, CAST(trunc(event_id % 1000 / 2.0) AS INT) AS y, CAST(greatest(1, trunc(event_id % 3 / 2.0)) AS INT) AS w, CAST(greatest(1, trunc(event_id % 50 / 2.0)) AS INT) AS h FROM events""")
def word_boxes(spark, sf_dir):
    """Boxes read at twice the size, on the page's own scale."""
    b = geometry.scaled_back(F.col("user_id") * 7, F.col("event_id") % 1000, F.col("event_id") % 3, F.col("event_id") % 50, F.lit(2.0))
    return table(spark, sf_dir, "events").withColumn("b", b).select("event_id", "b.*")


@query("""WITH p AS (SELECT event_id // 4 AS region, user_id AS x, event_id % 97 AS y FROM events) SELECT region, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM p GROUP BY region""")
def polygon_boxes(spark, sf_dir):
    """The upright box around each polygon of a second reader's region."""
    p = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 4").alias("region")).agg(F.collect_list(F.struct(F.col("user_id").alias("x"), (F.col("event_id") % 97).alias("y"))).alias("points"))
    return p.withColumn("b", geometry.of_polygon(F.col("points"))).select("region", "b.*")


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN false ELSE NOT (turn % 4 = 1) AND NOT (length(text) % 5 = 0) END AS visible FROM conversations""")
def flags_visible(spark, sf_dir):
    """Whether a mark still shows: words kept, edited, or changed by hand have none."""
    c, t = table(spark, sf_dir, "conversations"), F.col("turn")
    decision = F.when(t % 3 == 0, "keep").when(t % 3 == 1, "flag").otherwise("patch")
    read = F.when(F.length("text") % 5 == 0, F.concat("text", F.lit("!"))).when(F.length("text") % 5 == 1, F.lit(None).cast("string")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", decisions.flag_visible(decision, t % 4 == 1, F.col("text"), read).alias("visible"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id % 1000 WHEN event_id % 4 = 1 AND event_id % 2000 < 1000 THEN event_id % 2000 END::INT AS number,
  CASE event_id % 3 WHEN 0 THEN 'фигура' WHEN 1 THEN 'figura' ELSE 'обр' END AS keyword, event_id % 3 <> 1 AS cyrillic FROM events""")
def figure_numbers(spark, sf_dir):
    """Numbers of figures whose text is a label and a number alone; keywords without marks; Cyrillic told from Latin."""
    e, m = table(spark, sf_dir, "events"), F.col("event_id")
    label = F.when(m % 4 == 0, F.concat(F.lit(" Fig. "), m % 1000)).when(m % 4 == 1, (m % 2000).cast("string")).when(m % 4 == 2, F.concat(F.lit("Figura "), m % 9, F.lit(" mare"))).otherwise("")
    keyword = F.when(m % 3 == 0, "Фигура").when(m % 3 == 1, "FÌGURÀ").otherwise("обр")
    return e.select("event_id", captions.figure_number(label).alias("number"), text.plain_keyword(keyword).alias("keyword"), text.has_cyrillic(keyword).alias("cyrillic"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE 1 END AS n_warnings, CASE event_id % 4 WHEN 0 THEN 'ita' WHEN 1 THEN 'bul' ELSE 'eng' END AS lang FROM events""")
def stage_reports(spark, sf_dir):
    """Warnings and languages out of stages' JSON, some of it unreadable."""
    m = F.col("event_id")
    meta = F.when(m % 3 == 2, "broken").otherwise(F.concat(F.lit('{"warnings":["w'), m, F.lit('"]}')))
    params = F.when(m % 4 == 0, '{"params":{"lang":"ita","language":"deu"}}').when(m % 4 == 1, '{"params":{"language":"bul"}}').when(m % 4 == 2, "{}").otherwise("not json")
    return table(spark, sf_dir, "events").select("event_id", F.size(tables.warnings_of(meta)).alias("n_warnings"), tables.ocr_language(params).alias("lang"))


@query("""SELECT 'page_' || r_regionkey AS page, r_regionkey % 2 = 0 AS ok, CASE WHEN r_regionkey % 2 = 1 THEN 'split' END AS failed_stage, CASE WHEN r_regionkey % 2 = 0 THEN 3 ELSE 2 END AS n_stages, r_regionkey AS n_warnings FROM region""")
def page_runs(spark, sf_dir):
    """Stages of five pages in order, ending at the first that fails."""
    def split(fails):
        if fails:
            raise ValueError("no gutter")

    found = None
    for r in table(spark, sf_dir, "region").collect():
        k = r.r_regionkey
        out = chain.run_stages(spark, f"page_{k}", [("fuse", lambda k=k: ["w"] * k), ("split", lambda k=k: split(k % 2)), ("dewarp", lambda: None)])
        found = out if found is None else found.union(out)
    return chain.summary(found).select("page", "ok", "failed_stage", "n_stages", F.col("n_warnings").cast("int").alias("n_warnings"))


@query("""WITH p AS (SELECT 'job' || user_id AS job_id, event_id % 40 AS number, count(*) AS n FROM events GROUP BY ALL)
SELECT job_id, 'page_' || lpad(CAST(max(number) + 1 AS VARCHAR), 3, '0') AS next_page, count(*) AS n_pages, min('page_' || lpad(CAST(number AS VARCHAR), 3, '0')) AS first_page, CASE WHEN job_id < 'job5' THEN 'patch' ELSE 'flag' END AS mode FROM p GROUP BY job_id""")
def job_pages(spark, sf_dir):
    """Each job's pages, the name of its next one, and its mode."""
    p = table(spark, sf_dir, "events").select(F.concat(F.lit("job"), "user_id").alias("job_id"), scalars.page_name(F.col("event_id") % 40).alias("page")).groupBy("job_id", "page").agg(F.count("*").alias("n"))
    jobs = assemble.job_rows(p.select("job_id").distinct().withColumn("mode", F.when(F.col("job_id") < "job5", "patch").otherwise("flag")))
    status = document.job_status(p).select("job_id", F.size("pages").cast("bigint").alias("n_pages"), F.col("pages")[0]["page"].alias("first_page"))
    return document.next_page(p).join(status, "job_id").join(jobs, "job_id")


def _frame_files(spark, sf_dir):
    path = sinks.scratch(spark, "frames")
    frames(spark, sf_dir).selectExpr("cast(device as string) as device", "sharpness", "stability", "timestamp_ms").repartition(4, "device").write.json(path)
    return path


@query(GATE_SQL)
def hover_gate_stream(spark, sf_dir):
    """The gate over a stream of frame files, run until all are taken up."""
    stream = spark.readStream.schema("device string, sharpness double, stability double, timestamp_ms bigint").json(_frame_files(spark, sf_dir))
    out, checkpoint = sinks.scratch(spark, "actions"), sinks.scratch(spark, "checkpoint")
    found = gate.gate_stream(stream, needed=2, interval_ms=3_600_000, burst=3, sharp=5.0, still=8.0)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(gate.OUT).parquet(out)


@query("""SELECT DISTINCT CAST(user_id AS VARCHAR) AS job_id, 'page_' || (event_id % 5) AS page, event_id % 5 <> 3 AS ok FROM events""")
def queue_outcomes(spark, sf_dir):
    """Uploads that may be repeated, taken up once each by a stream; a page of a certain name is refused."""
    e = table(spark, sf_dir, "events").selectExpr("concat(user_id, '-', event_id % 5) as event_id", "cast(user_id as string) as job_id", "concat('page_', event_id % 5) as page", "timestamp'2024-01-01 00:00:00' as ts")
    folder, results, checkpoint = (sinks.scratch(spark, n) for n in ("uploads", "outcomes", "checkpoint"))
    e.repartition(3, "event_id").write.json(folder)
    queue.run_pages(queue.page_events(spark, folder, 100), lambda b: b.select("job_id", "page", (F.col("page") != "page_3").alias("ok")), results, checkpoint).awaitTermination()
    return spark.read.schema("job_id string, page string, ok boolean").json(f"{results}/*").select("job_id", "page", "ok")


@query(f"""WITH {FRAMES_SQL} SELECT device, frame FROM (SELECT device, frame, row_number() OVER (PARTITION BY device ORDER BY sharpness DESC, frame) AS rn FROM f) WHERE rn = 1""")
def sharpest_frames(spark, sf_dir):
    """The sharpest frame of each device."""
    return gate.sharpest(frames(spark, sf_dir), ["device"])


@query(f"""WITH {WORDS_SQL} SELECT doc_id, coalesce(median(CASE WHEN (h + pos % 7 - 20) > 0 THEN h + pos % 7 - 20 END), 0)::DOUBLE AS height FROM w GROUP BY doc_id""")
def median_heights(spark, sf_dir):
    """The median of words' positive heights on each page."""
    w = words(spark, sf_dir).select("doc_id", (F.col("h") + F.col("pos") % 7 - 20).alias("h"))
    return w.groupBy("doc_id").agg(metrics.median_height().alias("height"))


@query(f"""SELECT page_id, '<!doctype html>' || chr(10) || '<html lang="' || CASE WHEN page_id % 3 = 0 THEN 'bul' ELSE 'eng' END || '">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>' || page_id || '</title>' || chr(10)
  || '<style>p</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '<p></p>' || chr(10) || '<hr class="section-sep">' || chr(10) || {ESCAPE_SQL.format(c="url")} || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS html FROM pages""")
def document_pages(spark, sf_dir):
    """Documents of two pages each, in order, under their language."""
    p = table(spark, sf_dir, "pages")
    parts = p.select("page_id", F.lit("p2").alias("page"), text.escape_html(F.col("url")).alias("html")).union(p.select("page_id", F.lit("p1").alias("page"), F.lit("<p></p>").alias("html")))
    docs = p.select("page_id", F.when(F.col("page_id") % 3 == 0, "bul").otherwise("").alias("target_language"), F.lit("eng").alias("source_language"), F.lit("p").alias("css"))
    return document.document_html(parts, docs, "page_id")


@query("""WITH f AS (SELECT 'u' || user_id || '/' || CASE event_id % 3 WHEN 0 THEN 'frame_' WHEN 1 THEN 'frame_x' ELSE 'note_' END || event_id || '.png' AS path, event_id FROM events)
SELECT path FROM f WHERE event_id % 3 = 0 AND event_id % 7 <> 0""")
def stale_frames(spark, sf_dir):
    """Frames of an earlier run that this one did not make again; other files stay out of it."""
    path = F.expr("concat('u', user_id, '/', CASE event_id % 3 WHEN 0 THEN 'frame_' WHEN 1 THEN 'frame_x' ELSE 'note_' END, event_id, '.png')")
    e = table(spark, sf_dir, "events").select(path.alias("path"), "event_id")
    return tables.stale(e.select("path"), e.filter("event_id % 7 = 0"), r"^frame_[0-9]+\.png$")


@query("""SELECT 'p' || user_id AS page, 'dark' AS warning FROM events WHERE event_type = 'view' UNION ALL SELECT 'p' || user_id, 'blur' FROM events WHERE event_type = 'view' UNION ALL SELECT 'p' || user_id, 'dark' FROM events WHERE event_type = 'error'""")
def page_warnings(spark, sf_dir):
    """Warnings of two stages together; what both say stands twice."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("p"), "user_id").alias("page"), "event_type")
    return chain.all_warnings(e.filter("event_type = 'view'").select("page", F.array(F.lit("dark"), F.lit("blur")).alias("warnings")), e.filter("event_type = 'error'").select("page", F.array(F.lit("dark")).alias("warnings")))


@query("""SELECT 'img' || conv_id AS image_id, CASE WHEN turn % 2 = 0 THEN 'left' ELSE 'right' END AS subpage, CAST(turn AS INT) AS ord, 'B' || turn AS gt, CASE WHEN turn % 3 = 0 THEN 'figure' ELSE 'paragraph' END AS type,
  CASE WHEN turn % 3 <> 0 THEN left(text, 20) END AS anchor, CASE WHEN turn % 3 = 0 THEN CAST(turn * 10 AS INT) END AS x FROM conversations""")
def block_truth_rows(spark, sf_dir):
    """Ground truth of block order written as nested JSON and read flat."""
    t, c = F.col("turn"), table(spark, sf_dir, "conversations")
    one = F.struct(t.alias("order"), F.concat(F.lit("B"), t).alias("id"), F.when(t % 3 == 0, "figure").otherwise("paragraph").alias("type"), F.when(t % 3 != 0, F.left("text", F.lit(20))).alias("anchor"), F.when(t % 3 == 0, F.array(t * 10, t, F.lit(5), F.lit(6))).alias("bbox"))
    side = F.when(t % 2 == 0, "left").otherwise("right")
    pages = c.groupBy("conv_id", side.alias("side")).agg(F.struct(F.lit(1).alias("page_number"), F.collect_list(one).alias("reading_order")).alias("p"))
    docs = pages.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("side", "p"))).alias("subpages"))
    path = sinks.scratch(spark, "truth")
    docs.select(F.concat(F.lit("img"), "conv_id").alias("image_id"), "subpages").write.json(path)
    return tables.block_truth(spark, path, True).select("image_id", "subpage", "ord", "gt", "type", "anchor", F.get("bbox", F.lit(0)).alias("x"))


@query("""SELECT 'i' || p_partkey AS image, CASE WHEN p_partkey % 3 <> 0 THEN p_size * 10 END AS gutter_x, CASE WHEN p_partkey % 3 <> 0 THEN 25 END AS tol, p_partkey % 3 = 0 AS single FROM part""")
def gutter_truth_rows(spark, sf_dir):
    """Ground truth of gutters: a place and a tolerance, or a single page."""
    k, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    one = F.struct(F.when(k % 3 != 0, F.col("p_size") * 10).alias("gutter_x"), F.when(k % 3 != 0, 25).alias("tol"), F.when(k % 3 == 0, True).alias("single"))
    path = sinks.scratch(spark, "gutters")
    p.groupBy((k % 7).alias("file")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("i"), k).alias("image"), one.alias("s")))).alias("spreads")).select("spreads").write.json(path)
    return tables.gutter_truth(spark, path, True)


@query("""SELECT 'job' || doc_id AS document_id, 1 AS n_pages, lang AS source_language, CASE WHEN doc_id % 2 = 0 THEN 'second' ELSE 'first' END AS title, CASE WHEN doc_id % 2 = 0 THEN 'first' END AS former FROM documents""")
def saved_documents(spark, sf_dir):
    """Documents saved, some saved again, and read with what was there before."""
    d = table(spark, sf_dir, "documents")

    def docs(rows, said):
        block = F.struct(F.lit(0).alias("id"), F.lit("title").alias("type"), F.lit(said).alias("text"))
        return rows.select(F.concat(F.lit("job"), "doc_id").alias("document_id"), F.concat(F.lit("job"), "doc_id").alias("job_id"), F.struct(F.col("lang").alias("source_language")).alias("settings"), F.array(F.struct(F.lit("p1").alias("page_id"), F.array(block).alias("blocks"))).alias("pages"))

    path = sinks.scratch(spark, "documents")
    sinks.save_documents(docs(d.filter("doc_id % 2 = 0"), "first"), path)
    sinks.save_documents(docs(d.filter("doc_id % 2 = 0"), "second").union(docs(d.filter("doc_id % 2 = 1"), "first")), path)

    def title(c):
        return F.col("pages")[0]["blocks"][0]["text"].alias(c)

    now, old = tables.documents(spark, path, True), tables.documents(spark, f"{path}.bak", True)
    return now.select("document_id", F.size("pages").alias("n_pages"), "settings.source_language", title("title")).join(old.select("document_id", title("former")), "document_id", "left")
