"""Texts cut off by field limits or in transfer: hidden length limits, and endings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A length is a limit of a source if at least so many distinct texts have it, at least this share of the source's ...
MIN_AT_LIMIT, MIN_SHARE = 8, 0.005
#: ... and so many times the mean of the lengths around it, which are those of its bin of this width and of the two next to that.
SPIKE, BIN = 10, 32
#: ... and of the next so many lengths, which the limit cuts off.
BEYOND = 8
#: A limit in bytes may leave the last character out, which has up to four bytes.
BYTE_SLACK = 3
#: A closing line under at least this share of distinct texts, of all or of one source, and under so many of them, is a footer.
FOOTER_SHARE, FOOTER_TEXTS = 0.005, 5
#: A shape of a footer's numbers that at least this share of its texts have is a usual one.
USUAL_SHARE = 0.1


def measures(text: Column) -> dict[str, Column]:
    """Lengths of a text under the encodings and escapings in which a field may have stored it."""
    lines = F.regexp_count(text, F.lit(r"(?<!\r)\n"))
    quotes = F.regexp_count(text, F.lit(r'["\\]'))
    controls = F.regexp_count(text, F.lit(r"[\n\r\t\x08\x0c]"))
    others = F.regexp_count(text, F.lit(r"[\x00-\x07\x0b\x0e-\x1f]"))
    markup = F.regexp_count(text, F.lit("&")) * 4 + F.regexp_count(text, F.lit("[<>]")) * 3 + F.regexp_count(text, F.lit('"')) * 5
    astral = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10ffff}]"))
    chars, octets = F.length(text), F.octet_length(text)
    return {
        "characters": chars,
        "utf8_bytes": octets,
        "utf16_units": chars + astral,
        "html_characters": chars + markup,
        "json_characters": chars + quotes + controls + others * 5,
        "crlf_characters": chars + lines,
        "crlf_bytes": octets + lines,
    }


MEASURES = (
    "characters", "utf8_bytes", "utf16_units", "html_characters", "json_characters", "crlf_characters", "crlf_bytes",
)


def length_counts(inspected: DataFrame) -> DataFrame:
    """(source, measure, length, texts): distinct texts that are not blank by source and length, however many copies they have."""
    texts = inspected.filter("verdict <> 'blank'").dropDuplicates(["source", "text_key"])
    return texts.select("source", F.posexplode("lengths").alias("measure", "length")).groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("texts"))


def hidden_limits(inspected: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(source, measure, limit, texts, share): lengths at which a source cuts its texts.

    Distinct texts are counted by source, measure and length, map-side combined; a length is a limit if it stands out of
    the lengths around it, so a source may have any number of limits, one for each measure or period. Of the measures
    that stand out at the same number, the one that most texts reach is the limit; it casts the others. The counts, not
    the texts, are what moves: one row per source, measure and length. ``inspected`` is the result of ``inspect``,
    ``counts`` that of ``length_counts``.
    """
    counts = length_counts(inspected) if counts is None else counts
    group = Window.partitionBy("source", "measure")
    seen = counts.select(
        "*", F.sum("texts").over(group).alias("total"), F.sum("texts").over(group.orderBy(F.floor(F.col("length") / BIN)).rangeBetween(-1, 1)).alias("near"),
        F.coalesce(F.sum("texts").over(group.orderBy("length").rangeBetween(1, BEYOND)), F.lit(0)).alias("beyond"),
    )
    standing = seen.filter(
        (F.col("texts") >= MIN_AT_LIMIT) & (F.col("texts") >= MIN_SHARE * F.col("total")) & (F.col("beyond") * SPIKE <= F.col("texts") * BEYOND)
        & ((F.col("near") - F.col("texts")) * SPIKE <= F.col("texts") * (3 * BIN - 1))
    )
    rank = F.row_number().over(Window.partitionBy("source", "length").orderBy(F.desc("texts"), "measure"))  # seven rows at most
    names = F.array(*[F.lit(m) for m in MEASURES])
    return (
        standing.withColumn("_rank", rank).filter("_rank = 1")
        .select("source", F.element_at(names, F.col("measure") + 1).alias("measure"), F.col("length").alias("limit"), "texts", (F.col("texts") / F.col("total")).alias("share"))
    )


#: Letters that UTF-8 bytes become under a code page of one byte.
_MOJIBAKE = re.compile("[\u00c3\u00c2\u00e2\u00e3\u00e5-\u00e9\ufffd\u20ac]")
_TAIL_BLANKS = re.compile("[\\s\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\x00-\x1f\x7f]+\\Z")
_ENDS = re.compile(
    "[.!?\u2026\u3002\uff01\uff0e\uff1f\uff61\u0964\u061f\u06d4\u0f0d\u0f0e\u104a\u104b\u17d4\u17d5]"
    "['\"\u2019\u201d\u00bb\u203a\u3009\u300b\u300d\u300f\u3011\u3015\uff09\uff3d\uff5d\uff63)\\]}*_]*\\Z"
)
#: Letters of scripts that put no blanks between words: Thai, Lao, Tibetan, Burmese, Khmer, kana and Han.
_UNSPACED = {
    "thai": "\u0e01-\u0e4e", "lao": "\u0e81-\u0edf", "tibetan": "\u0f40-\u0fbc", "burmese": "\u1000-\u103f", "khmer": "\u1780-\u17d3",
    "hiragana": "\u3041-\u309f", "katakana": "\u30a1-\u30ff\u31f0-\u31ff\uff66-\uff9f", "han": "\u3005-\u3007\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af",
}
_UNSPACED_ANY = re.compile(f"[{''.join(_UNSPACED.values())}]")
_UNSPACED_ONE = re.compile("(?:" + "|".join(f"[{x}\u30fb\u30fc]+" for x in _UNSPACED.values()) + ")\\Z")
#: Longest single word: of a script with blanks, of one script without blanks, and of a mixture of these.
WORD_SPACED, WORD_ONE_SCRIPT, WORD_MIXED = 64, 12, 6
_ADDRESS_OR_HASH = re.compile(r"(?:(?:https?|ftp)://[!-~]+|[0-9a-f]+)\Z", re.I)
_SEPARATOR = re.compile(r"(?:[-=_*~#+.\u2500-\u257f\u2014]\s?){3,}\Z")
_LOG = re.compile(r".*\s\d+ bytes\Z")
_LISTING = re.compile(r"\S.*\s\d{1,2}-\w{3}-\d{4} \d\d:\d\d\s+(?:[\d.]+[KMGT]?B?|-)\Z")
_OPEN_TAG = re.compile(r"<(?:[a-zA-Z/!][^<>]*)?\Z")
#: The mark of a page at the start of a line or after another tag; in prose that tells of tags it stands elsewhere.
_NAMES, _PLACES, _DIGITS = re.compile(r"\b[A-Z][a-z]{3,}\b"), re.compile(r"(?:https?://|www\.)\S+/(?:\S*\.\w{2,5})?(?=\s|\Z)", re.I), re.compile(r"\d+")
_PAGE_LINE, _PAGE = re.compile(r"(?:^|>)[ \t]{0,99}<(?:html|body)[\s>]", re.I | re.M), re.compile("<(?:html|body)", re.I)
_CLOSED_PAGE = re.compile(r"</(?:html|body)\s*>\Z", re.I)
_SHORT_END = re.compile(r"(?:^|[.!?]\s+|\n)(?:[^\W\d_]+ )?[^\W\d_]+ \d+\.\Z")
_LOG_START = re.compile(r"\d{4}-\d\d-?(?:\d\d)?(?:T[\d:]*Z?)?\b")


def _shape(token: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", token))


def _single_word(end: str) -> bool:
    """Whether a text is one word; a run without blanks that is too long for a word, or holds a sentence's end, is not."""
    if len(end.split()) != 1:
        return False
    word = end.strip()
    if not _UNSPACED_ANY.search(word):
        return len(word) <= WORD_SPACED or bool(_ADDRESS_OR_HASH.match(word))
    return len(word) <= (WORD_ONE_SCRIPT if _UNSPACED_ONE.match(word) else WORD_MIXED) and not re.search("[\u3002\uff01\uff0e\uff1f\uff61!?]", word[:-1])


def _mended(line: str) -> str:
    """A line that was decoded with a wrong code page, decoded again; any other line as it is."""
    for page in ("cp1252", "latin-1"):
        try:
            raw = line.encode(page)
        except UnicodeEncodeError:
            continue
        fixed = raw.decode("utf-8", errors="ignore")
        if fixed and len(fixed) < len(raw):
            return fixed
    return line


def _template(line: str) -> str:
    """A closing line with its addresses, names and numbers taken out, or as it stands if nothing else is left of it."""
    out = _DIGITS.sub("9", _NAMES.sub("A", _PLACES.sub("U", line)))
    return line if re.fullmatch(r"[\WA9]*", out) else out


def _form(line: str) -> str:
    """The template with a 9 for each digit."""
    return re.sub(r"\d", "9", _NAMES.sub("A", _PLACES.sub("U", line)))


def ending(text: str | None) -> tuple[str, str]:
    """(verdict, template) of a text's end.

    verdict: ``blank``; ``complete``; ``cut``: an open tag, a log line that lacks the end which the lines above it
    have, or a sentence that plainly stops in its middle; ``open``: the last line has no end of a sentence, or of a
    line of the listing above it, which is a cut unless many texts close with that line.
    template is the whole last line with addresses, numbers and names taken out.
    """
    return _judged(text)[:2]


def _judged(text: str | None) -> tuple[str, str, str, str]:
    """(verdict, template, what stands above the last line, shape) of a text; the last two are given for open endings only."""
    if text is None:
        return "blank", "", "", ""
    end = _TAIL_BLANKS.sub("", text)
    if not end:
        return "blank", "", "", ""
    start = max(end.rfind(c) for c in "\r\n\x0b\x0c\u2028\u2029") + 1
    if _MOJIBAKE.search(end, start):
        end = _TAIL_BLANKS.sub("", end[:start] + _mended(end[start:])) or end
    if _OPEN_TAG.match(end, max(end.rfind("<"), 0)) and not end.endswith("<>"):
        return "cut", "", "", ""
    lines = [x.strip() for x in re.split(r"[\r\n\x0b\x0c\u2028\u2029]+", end) if x.strip()]
    last = lines[-1]
    template = _template(last)
    if _PAGE_LINE.search(text) or text.lstrip().startswith("<") and _PAGE.search(text):
        if _CLOSED_PAGE.search(end) or end.endswith(">"):
            return "complete", template, "", ""
        return "cut", template, "", ""
    if _SEPARATOR.match(last):
        return "complete", template, "", ""
    if _single_word(end):
        return ("cut" if end[-1] in ",;:\u3001\uff0c\uff1a\uff1b" and len(end) > 1 else "complete"), template, "", ""
    if _LOG.match(last) or _LISTING.match(last):
        return "complete", template, "", ""
    above = lines[-2] if len(lines) > 1 else ""
    if above and (_LOG.match(above) or _LISTING.match(above)):
        first = _LOG_START.match(last)
        if first:
            return "cut", template, "", ""
        if len(last.split()) < len(above.split()) and (_LISTING.match(above) or not _ENDS.search(last)):
            return "open", template, end[: len(end) - len(last)], _form(last)  # a line under the list, or one of it that lacks its end
    if len(lines) > 2 and len(above.split()) > 2:
        a, b, c = (x.split() for x in lines[-3:])
        if len(a) == len(b) and [_shape(x) for x in (a[0], a[-1])] == [_shape(x) for x in (b[0], b[-1])] and re.search(r"\d", a[-1] + a[0]):
            if len(c) == len(b) and _shape(c[-1]) == _shape(b[-1]):
                return "complete", template, "", ""
    if _ENDS.search(end):
        return ("cut" if _SHORT_END.search(last) else "complete"), template, "", ""
    return "open", template, end[: len(end) - len(last)], _form(last)


def _key(text: str) -> int:
    """64 bits that identify a text apart from the kind of its blanks."""
    return int.from_bytes(hashlib.blake2b(" ".join(text.split()).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def inspect(df: DataFrame, *, text: str = "text", row_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(row_id, source, lengths, text_key, verdict, template, above, shape, goes_on) of each row, from its whole text.

    text_key, template and above identify the text and, for open endings, its last line and what stands above it;
    shape is its last line with only the values of its digits taken out, goes_on says whether it ends in a number, which may have been longer.
    """
    id_type = df.schema[row_id].dataType.simpleString()
    names = ["row_id", "source", "lengths", "text_key", "verdict", "template", "above", "shape", "goes_on"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [_judged(t) for t in b.column(4).to_pylist()]
            keys = [pa.array([_key(x[k]) if x[0] == "open" else None for x in seen], pa.int64()) for k in (1, 2, 3)]
            goes_on = pa.array([x[0] == "open" and x[3].endswith("9") for x in seen], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([x[0] for x in seen], pa.string()), *keys, goes_on], names=names)

    lengths = F.array(*[measures(F.col(text))[m].cast("long") for m in MEASURES])
    rows = df.select(F.col(row_id).alias("row_id"), F.col(source).alias("source"), lengths.alias("lengths"), F.xxhash64(text).alias("text_key"), text)
    return rows.mapInArrow(look, f"row_id {id_type}, source string, lengths array<bigint>, text_key bigint, verdict string, template bigint, above bigint, shape bigint, goes_on boolean")


def footers(inspected: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(everywhere, source, template, texts, shapes): closing lines that are no unfinished sentences, learned from their frequencies.

    A line with an open ending is a footer if enough distinct texts close with it under different ones: of the corpus
    (``everywhere``; source is then NULL), or of one source. Copies of one text count once there, and so do all texts of
    that one line. At most ``1 / FOOTER_SHARE`` lines of the corpus, and of each source, can be that frequent. shapes are
    the usual ones of the line, by how many digits its numbers have.
    """
    counts = length_counts(inspected) if counts is None else counts
    totals = counts.filter("measure = 0").groupBy(F.col("source").alias("_source")).agg(F.sum("texts").alias("_own"))
    whole = totals.agg(F.sum("_own").alias("_all"))  # one row
    lines = inspected.filter("verdict = 'open'").select("template", "source", "shape", "above").distinct()
    own = lines.groupBy("template", "source", "shape").agg(F.count(F.lit(1)).alias("texts"))
    both = own.select("template", "shape", F.explode(F.array(F.struct(F.lit(False).alias("everywhere"), "source"), F.struct(F.lit(True).alias("everywhere"), F.lit(None).cast("string").alias("source")))).alias("x"), "texts")
    shaped = both.groupBy("template", "x", "shape").agg(F.sum("texts").alias("_n")).withColumn("texts", F.sum("_n").over(Window.partitionBy("template", "x"))).filter(F.col("texts") >= FOOTER_TEXTS)
    usual = F.collect_list(F.when(F.col("_n") >= USUAL_SHARE * F.col("texts"), F.col("shape"))).alias("shapes")
    summed = shaped.groupBy("template", "x", "texts").agg(usual).select("x.*", "template", "texts", "shapes")
    placed = summed.join(F.broadcast(whole)).join(totals, ~F.col("everywhere") & F.col("source").eqNullSafe(F.col("_source")), "left")
    enough = F.col("texts") >= FOOTER_SHARE * F.when(F.col("everywhere"), F.col("_all")).otherwise(F.col("_own"))
    return placed.filter(enough).select("everywhere", "source", "template", "texts", "shapes")


def judge(inspected: DataFrame) -> DataFrame:
    """(row_id, source, cut, at_limit) of each text that is not blank, from the result of ``inspect``, written as a table.

    Limits are found from the lengths of all texts. An ending that is open is a footer if enough distinct texts of the
    corpus or of its source close with the same whole line under different ones. Where that line ends in a number with
    fewer or more digits than is usual there, a text at a limit of its source is cut, since the limit explains the ending;
    so is any other text with an open ending. A complete ending at a limit is no cut, it may be a
    text that was padded. NULL and blank texts do not come out; repeated rows come out as often as they are stored; an
    empty table gives none.
    """
    seen = inspected.filter("verdict <> 'blank'")
    counts = length_counts(inspected)
    known = hidden_limits(inspected, counts).select(
        F.col("source").alias("_source"), F.struct((F.array_position(F.array(*[F.lit(m) for m in MEASURES]), F.col("measure"))).cast("int").alias("at"), "limit").alias("_limit")
    )
    limits = known.groupBy("_source").agg(F.collect_list("_limit").alias("_limits"))  # at most 1 / MIN_SHARE per measure

    def hit(x: Column) -> Column:
        slack = F.element_at(F.array(*[F.lit(BYTE_SLACK if m.endswith("bytes") else 0) for m in MEASURES]), x["at"])
        return F.element_at(F.col("lengths"), x["at"]).between(x["limit"] - slack, x["limit"])

    learned = footers(inspected, counts)
    own = learned.filter("not everywhere").select(F.col("source").alias("_own"), F.col("template").alias("_t1"), F.col("shapes").alias("_s1"))
    common = learned.filter("everywhere").select(F.col("template").alias("_t2"), F.col("shapes").alias("_s2"))  # at most 1 / FOOTER_SHARE
    rows = (
        seen.join(limits, F.col("source").eqNullSafe(F.col("_source")), "left")
        .join(F.broadcast(common), F.col("template") == F.col("_t2"), "left")
        .join(own, F.col("source").eqNullSafe(F.col("_own")) & (F.col("template") == F.col("_t1")), "left")
    )
    at_limit = F.coalesce(F.exists("_limits", hit), F.lit(False))
    footer = F.col("_t1").isNotNull() | F.col("_t2").isNotNull()
    usual = F.array_contains(F.coalesce("_s2", "_s1"), F.col("shape"))
    cut = (F.col("verdict") == "cut") | (F.col("verdict") == "open") & (~footer | at_limit & F.col("goes_on") & ~usual)
    return rows.select("row_id", "source", cut.alias("cut"), at_limit.alias("at_limit"))
