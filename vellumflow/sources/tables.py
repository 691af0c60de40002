"""Sources: word tables, manifests, ground truth, lexicons, documents, captured frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import capitalized, has_cyrillic, normalize_token, strip
from ..plans.schemas import BLOCK, BLOCK_TRUTH, DOC_PAGE, DOCUMENT, DOCUMENT_VERSION, MANIFEST, RESULTS, SETTINGS, TSV, WORD

#: File names of images, and of raw captures that need a decoder of their own.
IMAGES = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".webp")
RAWS = (".dng", ".cr2", ".cr3", ".nef", ".arw", ".raf", ".orf", ".rw2")


def captures(spark: SparkSession, path: str, raw_decoder: bool = False) -> DataFrame:
    """(path, suffix, frame, skipped, content, length): image files, numbered by path in their folder before raw ones are skipped."""
    return numbered(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), raw_decoder)


def numbered(files: DataFrame, raw_decoder: bool = False) -> DataFrame:
    """Files (path, ...) that are images, with suffix, frame and skipped."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kept = files.withColumn("suffix", suffix).filter(suffix.isin(*IMAGES, *RAWS))
    folder = F.regexp_replace("path", r"[^/]+$", "")
    rest = [c for c in files.columns if c != "path"]
    return kept.withColumn("frame", F.row_number().over(Window.partitionBy(folder).orderBy("path")) - 1).select("path", "suffix", "frame", (F.col("suffix").isin(*RAWS) & F.lit(not raw_decoder)).alias("skipped"), *rest)


def stale(found: DataFrame, made: DataFrame, pattern: str) -> DataFrame:
    """Files (path) of an earlier run: those whose names fit the pattern and that this run did not make."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return found.filter(name.rlike(pattern)).join(made.select("path"), "path", "left_anti")


def words_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Recognised words from tab-separated files: level 5, text that is not blank, confidence of 0 or more; text is stripped.

    A header line parses to nulls and so drops out. Quotes mean nothing in these files."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = raw.select("file", F.posexplode(F.split("value", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")).alias("line", "value"))
    return parse_tsv(lines, ["file"], "line", "value")


def parse_tsv(lines: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Words of lines of tab-separated text, with pos as their place among all lines."""
    parts = F.split(F.col(value), "\t")
    rows = lines.filter(F.size(parts) >= 12).select(*by, F.col(order).alias("pos"), *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(TSV)])
    whole = [n for n in TSV if n not in ("conf", "text")]
    typed = rows.select(*by, "pos", *[F.col(n).try_cast("int").alias(n) for n in whole], F.col("conf").try_cast("double").alias("conf"), strip(F.col("text")).alias("text"))
    return typed.filter("level = 5 and text <> '' and conf >= 0").select(*by, "pos", "text", "conf", "left", "top", "width", "height", "block_num", "par_num", "line_num", "word_num")


def parse_osd(text):
    """struct(rotate, conf) of an orientation report; of repeated keys the last counts, bad numbers are null."""
    def last(key):
        return F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?m)^{key}:\s*(.*)$"), 1), F.lit(-1))

    return F.struct(last("Rotate").try_cast("int").alias("rotate"), last("Orientation confidence").try_cast("double").alias("conf"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a test set: text columns alone."""
    return spark.read.schema(MANIFEST).option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)


def json_files(spark: SparkSession, schema: str, path: str, lines: bool) -> DataFrame:
    """JSON with a declared schema: one document in each file, or one in each line; what does not fit is an error."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).option("mode", "FAILFAST").json(path)


def block_truth(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(image_id, subpage, ord, gt, type, anchor, bbox) of block-order ground truth files."""
    docs = json_files(spark, BLOCK_TRUTH, path, lines)
    pages = docs.select("image_id", F.explode("subpages").alias("subpage", "page"))
    return pages.select("image_id", "subpage", F.explode("page.reading_order").alias("b")).select("image_id", "subpage", F.col("b.order").alias("ord"), F.col("b.id").alias("gt"), "b.type", "b.anchor", "b.bbox")


def gutter_truth(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(image, gutter_x, tol, single)."""
    docs = json_files(spark, "spreads map<string,struct<gutter_x:int,tol:int,single:boolean>>", path, lines)
    return docs.select(F.explode("spreads").alias("image", "s")).select("image", "s.gutter_x", "s.tol", F.coalesce("s.single", F.lit(False)).alias("single"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(token): the different words of a text file in lexicon form."""
    return spark.read.text(path).select(F.explode(F.split("value", r"(?U)\s+")).alias("t")).select(normalize_token(F.col("t")).alias("token")).filter("token <> ''").distinct()


def first_usable(candidates: DataFrame) -> DataFrame:
    """Of paths (ord, path, usable) the first that can be used; no row means no lexicon, which disables what needs one."""
    return candidates.filter("usable").agg(F.min_by("path", "ord").alias("path")).filter("path is not null")


def in_lexicon(tokens: DataFrame, lexicon: DataFrame, column: str = "token") -> DataFrame:
    """tokens with known: the token or its capitalised form is in the lexicon; the empty token is not."""
    words = lexicon.select(F.col("token").alias("_w")).distinct()
    forms = tokens.select(column).distinct().filter(F.col(column) != "").select(column, F.explode(F.array(F.col(column), capitalized(F.col(column)))).alias("_w"))
    hits = forms.join(words, "_w", "left_semi").select(column).distinct().withColumn("known", F.lit(True))
    return tokens.join(hits, column, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def hunspell(spark: SparkSession, dic: str, aff: str) -> DataFrame:
    """(token): every form that a dictionary's stems (``stem/flags``) take under its affix rules.

    Suffixes, prefixes, and both at once where the rules allow it (Y). Flags are single characters, or as the
    FLAG line says (long, num). Rules and stems meet in a join on the flag, so nothing is listed on the driver."""
    lines = spark.read.text(aff).select(F.split(F.trim("value"), r"\s+").alias("p"))
    kind = lines.filter(F.col("p")[0] == "FLAG").select(F.col("p")[1].alias("k")).first()
    many = F.size("p") >= 5
    heads = lines.filter(F.col("p")[0].isin("SFX", "PFX") & (F.size("p") == 4) & F.col("p")[2].isin("Y", "N")).select(F.col("p")[0].alias("kind"), F.col("p")[1].alias("flag"), (F.col("p")[2] == "Y").alias("crosses"))
    rules = lines.filter(F.col("p")[0].isin("SFX", "PFX") & many).select(
        F.col("p")[0].alias("kind"), F.col("p")[1].alias("flag"), F.nullif(F.col("p")[2], F.lit("0")).alias("strip"),
        F.regexp_replace(F.when(F.col("p")[3].startswith("0"), "").otherwise(F.col("p")[3]), "/.*$", "").alias("add"), F.nullif(F.col("p")[4], F.lit(".")).alias("when"),
    ).join(heads, ["kind", "flag"])
    entry = F.split(F.regexp_extract("value", r"^\s*(\S+)", 1), "/", 2)
    flags = F.coalesce(F.get(entry, F.lit(1)), F.lit(""))
    split = {"long": F.regexp_extract_all(flags, F.lit("(..)"), 1), "num": F.split(flags, ",")}.get(kind.k.lower() if kind else "", F.filter(F.split(flags, ""), lambda c: c != ""))
    stems = spark.read.text(dic).filter(~F.col("value").rlike(r"^\s*[0-9]*\s*$")).select(entry[0].alias("stem"), split.alias("flags"))

    def formed(words: DataFrame, which: str, only=None) -> DataFrame:
        ends = which == "SFX"
        of = rules.filter(F.col("kind") == which) if only is None else rules.filter(F.col("kind") == which).filter(only)
        met = words.select("*", F.explode("flags").alias("flag")).join(of, "flag")
        strip_, w = F.coalesce("strip", F.lit("")), F.col("form")
        fits = F.when(F.col("when").isNull(), True).otherwise(F.rlike(w, F.concat("when", F.lit("$")) if ends else F.concat(F.lit("^"), "when")))
        met = met.filter(fits & (w.endswith(strip_) if ends else w.startswith(strip_)))
        bare = F.substring(w, F.lit(1), F.length(w) - F.length(strip_)) if ends else F.substring(w, F.length(strip_) + 1, F.length(w))
        return met.select(F.concat(bare, "add").alias("form") if ends else F.concat("add", bare).alias("form"), "flags", "crosses")

    plain = stems.select(F.col("stem").alias("form"), "flags")
    suffixed = formed(plain, "SFX")
    both = formed(suffixed.filter("crosses").drop("crosses"), "PFX", F.col("crosses"))
    forms = plain.select("form").union(suffixed.select("form")).union(formed(plain, "PFX").select("form")).union(both.select("form"))
    return forms.select(F.col("form").alias("token")).distinct()


def lexicon(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """(token): the lexicon of the first path that can be used, or None, which disables what needs one.

    A path stands for a dictionary with its affixes (.dic and .aff), joined by a list of names beside it
    (.geo.txt) if there is one, or for a list of words (.txt); an empty list is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    for path in filter(None, paths):
        base = path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else path
        if there(f"{base}.dic") and there(f"{base}.aff"):
            forms = hunspell(spark, f"{base}.dic", f"{base}.aff")
            return forms.union(word_list(spark, f"{base}.geo.txt")).distinct() if there(f"{base}.geo.txt") else forms
        if path.endswith(".txt") and there(path):
            found = word_list(spark, path)
            return None if found.isEmpty() else found
    return None


def lexicon_size(stems: DataFrame, overlay: DataFrame) -> DataFrame:
    """(words): stems and overlay tokens, as listed; the forms that affixes make are not counted."""
    return stems.agg(F.count("*").alias("n")).union(overlay.agg(F.count("*").alias("n"))).agg(F.sum("n").alias("words"))


def lexicon_works(forms: DataFrame, word: str) -> DataFrame:
    """(ok): whether a word that must be known is, or its capitalised form; an empty one asks nothing."""
    return forms.agg((F.lit(word == "") | F.coalesce(F.bool_or(F.col("token").isin(word, word.capitalize())), F.lit(False))).alias("ok"))


def anchors(images: DataFrame, overrides: DataFrame) -> DataFrame:
    """images (image_id, path) with the path of an override (image_id, path) where there is one."""
    return images.join(overrides.withColumnRenamed("path", "_o"), "image_id", "left").withColumn("path", F.coalesce("_o", "path")).drop("_o")


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(token): Cyrillic tokens of the names and alternative names in tab-separated gazetteer lines, in order."""
    parts = F.split("value", "\t")
    names = F.concat(F.array(F.get(parts, F.lit(1))), F.split(F.get(parts, F.lit(3)), ","))
    tokens = spark.read.text(path).filter(F.size(parts) > 3).select(F.explode(names).alias("n")).select(F.explode(F.split("n", r"(?U)\s+")).alias("token"))
    return tokens.filter(has_cyrillic(F.col("token"))).distinct().orderBy("token")


def documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested documents, fields they leave out at their defaults; a file that does not fit the schema is an error.

    A file holds one document, or, with ``lines``, one in each line, as ``save_documents`` writes them."""
    return with_defaults(json_files(spark, DOCUMENT, path, lines))


def with_defaults(docs: DataFrame) -> DataFrame:
    """Documents with what a file may leave out: no edits, no words, the engine, the settings."""

    def filled(s: Column, **defaults) -> Column:
        for name, value in defaults.items():
            s = s.withField(name, F.coalesce(s[name], F.lit(value)))
        return s

    def listed(c: Column, kind: str) -> Column:
        return F.coalesce(c, F.array().cast(kind))

    def block(b: Column) -> Column:
        of = F.transform(listed(b["words"], f"array<{WORD}>"), lambda w: filled(w, engine="tesseract", engine_disagree=False, edited=False))
        return filled(b, structure_edited=False, order_confirmed=False).withField("words", of)

    pages = F.transform(listed(F.col("pages"), f"array<{DOC_PAGE}>"), lambda p: p.withField("blocks", F.transform(listed(p["blocks"], f"array<{BLOCK}>"), block)))
    settings = filled(F.coalesce("settings", F.from_json(F.lit("{}"), SETTINGS)), source_language="eng", uncertainty_mode="flag", order_mode="auto", strip_running_headers=True, strip_page_numbers=True)
    settings = settings.withField("fonts", listed(settings["fonts"], "array<string>"))
    return docs.withColumns({"schema_version": F.coalesce("schema_version", F.lit(DOCUMENT_VERSION)), "settings": settings, "pages": pages})


def stage_results(spark: SparkSession, path: str, stage: str, lines: bool = False) -> DataFrame:
    """(file, ...): what a stage handed on, of all pages under ``path``: ingest, fuse, split, dewarp, layout, ocr or resolved."""
    return json_files(spark, RESULTS[stage], path, lines).select(F.col("_metadata.file_path").alias("file"), "*")


def warnings_of(text):
    """The warnings of a stage's JSON, none if it cannot be read."""
    return F.coalesce(F.from_json(text, "warnings array<string>")["warnings"], F.array().cast("array<string>"))


def ocr_language(text, default: str = "eng"):
    """The language a stage's JSON names: params.lang, else params.language, else the default."""
    return F.coalesce(F.get_json_object(text, "$.params.lang"), F.get_json_object(text, "$.params.language"), F.lit(default))
