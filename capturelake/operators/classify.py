"""Rule-based classification, site profiles and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions import urls

# Marks of server software in a url, in order.
URL_MARKS = (
    ("PHP", r"(?i)\.php\b"), ("ASP", r"(?i)\.aspx?\b"), ("CGI", r"(?i)\.cgi\b|/cgi-bin/"), ("JSP", r"(?i)\.jsp\b"), ("WordPress", r"(?i)wp-content|wp-includes"), ("phpBB", r"(?i)phpbb|viewtopic\.php"),
)
# Names that a page's clues give, and of a page without any.
CLUES = (
    ("Microsoft FrontPage", "FrontPage|vti_cnf|_vti_bin"), ("Macromedia Dreamweaver", "(?is)generator.*dreamweaver|dreamweaver.*generator"), ("WordPress", "wp-content|(?i:wordpress)"),
    ("phpBB Forum", "phpBB"), ("vBulletin Forum", "vBulletin"),
)
NO_CLUE = "Unknown (likely hand-coded HTML)"

# Words of a topic, in order of precedence at a tie.
TOPICS = (
    ("games", "game games mods emulators patches wad rom level"), ("music", "midi mp3 music radio lyrics soundtrack samples"),
    ("software", "shareware drivers software setup download installer"), ("art", "clipart wallpapers skins fonts cursors sprites gallery"),
    ("hobby", "aquarium telescopes trains recipes maps manuals modems"), ("forum", "forum board thread guestbook reply"),
)


def server_software(page: Column) -> Column:
    """Names of all software that a page shows clues of, joined by comma and blank, with what it says it is powered by or generated with."""
    text = F.coalesce(page, F.lit(""))
    powered = F.substring(F.trim(F.regexp_extract(text, r"Powered by\s+([A-Za-z0-9\s]+)", 1)), 1, 30)
    generator = F.substring(F.trim(F.regexp_extract(text, r"(?i)<meta\s+name=[\"']generator[\"']\s+content=[\"']([^\"']+)", 1)), 1, 40)
    values = [F.when(powered != "", powered), F.when(F.lower(text).contains('<meta name="generator"') & (generator != ""), generator)]
    found = F.concat_ws(", ", *[F.when(text.rlike(p), F.lit(n)) for n, p in CLUES], *values)
    return F.when(found != "", found).otherwise(NO_CLUE)


def site_topic(text: Column, topics: tuple[tuple[str, str], ...] = TOPICS) -> Column:
    """The topic with most of its words present in a text; the first listed at a tie, 'general' if none is."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scores = []
    for k, (name, words) in enumerate(topics):
        score = sum((low.contains(w).cast("int") for w in words.split()), F.lit(0))
        scores.append(F.struct(score.alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, best["name"]).otherwise("general")


def directories(url: Column) -> Column:
    """All folders above the file of a url, from the root down: ``/a/b/c.txt`` gives ``/``, ``/a/``, ``/a/b/``."""
    parts = F.split(F.regexp_extract(urls.path(url), r"^(.*/)?", 1), "/")
    return F.when(
        F.size(parts) >= 2,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))),
    ).otherwise(F.array(F.lit("/")))


def directory_tree(captures: DataFrame) -> DataFrame:
    """(domain, directory, urls): distinct urls at or below each folder of each domain."""
    distinct = captures.select("domain", "url").distinct()
    return distinct.select("domain", F.explode(directories(F.col("url"))).alias("directory")).groupBy("domain", "directory").agg(F.count(F.lit(1)).alias("urls"))


def naming_conventions(captures: DataFrame) -> DataFrame:
    """(domain, numbered, dated, underscores, hyphens, style): how the files of a domain are named, over its distinct urls."""
    name = F.regexp_extract(urls.path(F.col("url")), r"([^/]*)\z", 1)
    rows = captures.select("domain", "url").distinct().withColumn("_n", name).withColumn("_p", urls.path(F.col("url")))
    out = rows.groupBy("domain").agg(
        F.count_if(F.col("_n").rlike(r"\d+\.[A-Za-z0-9]+\z")).alias("numbered"), F.count_if(F.col("_p").rlike(r"/(?:19|20)\d{2}/")).alias("dated"),
        F.count_if(F.col("_n").contains("_")).alias("underscores"), F.count_if(F.col("_n").contains("-")).alias("hyphens"),
    )
    style = F.when(F.col("underscores") > F.col("hyphens"), "underscore").when(F.col("hyphens") > F.col("underscores"), "hyphen").otherwise("mixed")
    return out.withColumn("style", style)


def site_profile(captures: DataFrame) -> DataFrame:
    """One row per domain: urls, extensions, software, topic, first and last year in its urls.

    Only what is asked of a url is combined per domain; marks and topic words are flags and counts, so no
    group's urls are collected. Extensions are a set, which the cap on their length bounds in practice.
    """
    u = F.col("url")
    rows = captures.select("domain", "url").distinct().withColumn("_ext", urls.extension_of_file(u)).withColumn("_years", urls.years_in(u))
    marks = [F.max(u.rlike(p)).alias(f"_m{i}") for i, (_, p) in enumerate(URL_MARKS)]
    words = [(k, w) for k, (_, ws) in enumerate(TOPICS) for w in ws.split()]
    seen = [F.max(F.lower(u).contains(w)).cast("int").alias(f"_w{i}") for i, (_, w) in enumerate(words)]
    per = rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("urls"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_ext") != "", F.col("_ext")))), ",").alias("extensions"),
        F.min("_years.first").alias("first_year"), F.max("_years.last").alias("last_year"), *marks, *seen,
    )
    software = F.concat_ws(", ", *[F.when(F.col(f"_m{i}"), F.lit(n)) for i, (n, _) in enumerate(URL_MARKS)])
    scores = []
    for k, (name, _) in enumerate(TOPICS):
        score = sum((F.col(f"_w{i}") for i, (t, _) in enumerate(words) if t == k), F.lit(0))
        scores.append(F.struct(score.alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    return per.select(
        "domain", "urls", "extensions", F.when(software != "", software).otherwise("unknown").alias("software"),
        F.when(best["score"] > 0, best["name"]).otherwise("general").alias("topic"), "first_year", "last_year",
    )


def additive_score(rules: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """(score, reasons) of additive rules: the points of all tests that hold, and their names joined by '; '."""
    score = sum((F.when(t, p).otherwise(0) for t, p, _ in rules), F.lit(0))
    return score, F.concat_ws("; ", *[F.when(t, F.lit(n)) for t, _, n in rules])


def score_label(score: Column, high: int = 80, medium: int = 40) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def glob_regex(pattern: str) -> str:
    """Unanchored regular expression of a name pattern with ``*``."""
    return pattern.replace(".", r"\.").replace("*", ".*")


def badge(ext: Column, confidence: Column, category: Column, rare: list[str]) -> Column:
    """Class of a discovery, first that applies: rare extension, media category, analysed, image, file."""
    return (
        F.when(ext.isin(rare), "rare").when(category.isin("audio", "video", "flash"), "media").when(confidence > 0, "analysed").when(category == "image", "image").otherwise("file")
    )


#: Neutral places that sites of a kind have: (mark of the software, or '' for any site, path, confidence, reason).
PATH_RULES = (
    ("WordPress", "/wp-content/uploads/", 0.7, "default directory"), ("phpBB", "/attachments/", 0.7, "upload directory"), ("", "/files/", 0.5, "file storage"), ("", "/media/", 0.5, "media files"),
    ("", "/downloads/", 0.5, "downloads section"), ("", "/archive/", 0.45, "archived content"), ("", "/assets/", 0.4, "static assets"),
)


def path_predictions(captures: DataFrame, rules: tuple[tuple[str, str, float, str], ...] = PATH_RULES, year_confidence: float = 0.6) -> DataFrame:
    """(domain, path, confidence, reason): paths that a domain's urls suggest and that it is not known to have.

    Candidates are the rules of the software that its urls show, then the paths of ``year_predictions``; of equal paths the
    first one stays. Known paths are those of the captures; only these are compared, nothing is fetched.
    """
    u = F.col("url")
    known = captures.filter(u.isNotNull()).select("domain", "url").distinct()
    flags = known.groupBy("domain").agg(*[F.max(u.rlike(p)).alias(f"_m{i}") for i, (_, p) in enumerate(URL_MARKS)])
    place = {n: i for i, (n, _) in enumerate(URL_MARKS)}
    row = lambda k, path, conf, why: F.struct(F.lit(k).alias("seq"), F.lit(path).alias("path"), F.lit(conf).alias("confidence"), F.lit(why).alias("reason"))
    held = F.array_compact(F.array(*[F.when(F.col(f"_m{place[m]}") if m else F.lit(True), row(k, p, c, r)) for k, (m, p, c, r) in enumerate(rules)]))
    ruled = flags.select("domain", F.explode(held).alias("x")).select("domain", "x.*")
    years = year_predictions(captures.filter(u.isNotNull())).select(
        "domain", F.lit(len(rules)).alias("seq"), urls.path(F.col("predicted")).alias("path"), F.lit(year_confidence).alias("confidence"), F.lit("year series").alias("reason")
    )
    first = ruled.unionByName(years).groupBy("domain", "path").agg(F.min(F.struct("seq", "confidence", "reason")).alias("x"))
    paths = known.select("domain", urls.path(u).alias("path")).distinct()
    return first.join(paths, ["domain", "path"], "left_anti").select("domain", "path", "x.confidence", "x.reason")


def year_predictions(captures: DataFrame) -> DataFrame:
    """Urls that the years in known urls suggest, two before to two after, that are not known themselves: (domain, url, predicted).

    The first known url (in text order) that leads to a prediction is kept.
    """
    known = captures.select("domain", "url").distinct()
    guesses = known.select("domain", "url", F.explode(urls.year_neighbours(F.col("url"))).alias("predicted"))
    first = guesses.groupBy("domain", "predicted").agg(F.min("url").alias("url"))
    return first.join(known.select(F.col("url").alias("predicted")), "predicted", "left_anti").select("domain", "url", "predicted")
