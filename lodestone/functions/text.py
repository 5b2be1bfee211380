"""Text, path, id and JSON expressions. All are column expressions but NFKC and case folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Names of ids, and the title of a section without one.
UNTITLED = "未命名段落"
PARAGRAPH = "段落"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def slug(c: Column) -> Column:
    """A heading's anchor: letters, digits and hyphens."""
    c = F.lower(strip(nfkc(c)))
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_一-鿿 \-\s]", "")
    c = F.regexp_replace(c, r"(?U)[\s_]+", "-")
    return F.regexp_replace(F.regexp_replace(c, "-+", "-"), "^-|-$", "")


def entity_name(c: Column) -> Column:
    """A name's normal form: NFKC, single spaces, no closing marks, case folded."""
    c = F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")
    return casefold(F.regexp_replace(c, r"^[ \t\r\n,，。.;；:：]+|[ \t\r\n,，。.;；:：]+$", ""))


def entity_type(c: Column) -> Column:
    return F.replace(entity_name(c), F.lit(" "), F.lit("_"))


def predicate(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(F.upper(strip(c)), "[^A-Z0-9_]+", "_"), "^_+|_+$", "")
    return F.coalesce(blank_to_null(c), F.lit("RELATED_TO"))


def bounded(c: Column, low: float, high: float) -> Column:
    """A number kept in a range; what is no number counts as the least."""
    number = c.try_cast("double")
    return F.least(F.lit(high), F.greatest(F.lit(low), F.nanvl(F.coalesce(number, F.lit(low)), F.lit(low))))


def safe_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""), 1, 90)


def unix_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def without_md(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\.md$", "")


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]*$", "")


def parent_dir(c: Column) -> Column:
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit(""))


def url_decoded(c: Column) -> Column:
    """Percent escapes decoded; a plus sign stays, and so does a text with broken escapes."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix:`` and the SHA-256 of the parts, joined by NUL."""
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256))


def document_id(source: Column) -> Column:
    return stable_id("doc", F.lower(unix_path(source)))


def section_id(source: Column, anchor: Column) -> Column:
    return stable_id("section", F.lower(unix_path(source)), anchor)


def chunk_id(source: Column, anchor: Column, index: Column) -> Column:
    return stable_id("chunk", F.lower(unix_path(source)), anchor, index.cast("string"))


def hash8(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 8)


def section_title(title: Column, heading: Column, filename: Column) -> Column:
    return F.coalesce(blank_to_null(title), blank_to_null(heading), blank_to_null(filename), F.lit(UNTITLED))


def quote(content: Column, length: int = 500) -> Column:
    return F.substring(strip(content), 1, length)


def ordered_distinct(c: Column) -> Column:
    return F.array_distinct(c)


def value_list(c: Column) -> Column:
    """Trimmed non-empty values of a text such as ``a|b``."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), strip), lambda x: x != "")


def joined_list(c: Column) -> Column:
    """The flat form of a list; null for an empty one."""
    return blank_to_null(F.array_join(c, "|"))


def bigrams(c: Column) -> Column:
    """The distinct pairs of neighbouring characters of a text, lower-cased and without white space."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")
    n = F.char_length(c)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(n > 0, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def overlap_score(a: Column, b: Column) -> Column:
    """0.45 and half the Jaccard index of two sets, to six places: a text score without a model."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.round(F.lit(0.45) + F.lit(0.5) * F.when(union > 0, shared / union).otherwise(F.lit(0.0)), 6)


def merged_descriptions(c: Column) -> Column:
    """One text from a list of descriptions: a single one as it is, several without their last marks."""
    cut = F.transform(c, lambda x: F.regexp_replace(x, "[。；; ]+$", ""))
    return F.when(F.size(c) == 0, F.lit("")).when(F.size(c) == 1, c[0]).otherwise(F.concat(F.array_join(cut, "；"), F.lit("。")))


def json_object(c: Column) -> Column:
    """The JSON object inside a model's answer: code fences and words around it are cut off; null without braces."""
    c = F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return blank_to_null(F.regexp_extract(c, r"(?s)(\{.*\})", 1))


def spoken(role: Column, text: Column) -> Column:
    """A turn of a history as one line."""
    return F.concat(F.when(role == "user", F.lit("用户")).otherwise(F.lit("助手")), F.lit("："), F.coalesce(text, F.lit("")))


def code_free(c: Column) -> Column:
    """A Markdown text without fenced blocks and inline code. A fence closes with its own mark or the text."""
    c = F.regexp_replace(c, r"(?ms)^[^\S\n]*(```|~~~)[^\n]*\n(?:.*?^[^\S\n]*\1[^\n]*$|.*\z)", "")
    return F.regexp_replace(c, r"`+[^`\r\n]*`+", "")


def is_attachment(target: Column) -> Column:
    kinds = ["avif", "bmp", "gif", "jpeg", "jpg", "pdf", "png", "svg", "webm", "webp", "wav", "mp3", "mp4"]
    return F.regexp_extract(F.lower(base_name(unix_path(target))), r".\.([^.]+)$", 1).isin(kinds)


def wikilinks(c: Column) -> Column:
    """The links of a text outside code: array of raw, target, anchor, alias, embedded."""
    raw = F.regexp_extract_all(code_free(c), F.lit(r"(!?\[\[[^\]\r\n]{1,300}\]\])"), 1)

    def parts(r):
        body = strip(F.regexp_extract(r, r"^!?\[\[(.*)\]\]$", 1))
        place = F.substring_index(body, "|", 1)
        target = unix_path(strip(F.substring_index(place, "#", 1)))
        anchor = F.when(F.instr(place, "#") > 0, strip(F.regexp_replace(place, "^[^#]*#", ""))).otherwise(F.lit(""))
        alias = F.when(F.instr(body, "|") > 0, strip(F.regexp_replace(body, r"^[^|]*\|", ""))).otherwise(F.lit(""))
        return F.struct(r.alias("raw"), body.alias("body"), target.alias("target"), anchor.alias("anchor"), alias.alias("alias"), r.startswith("!").alias("embedded"))

    good = lambda x: (x["body"] != "") & (x["body"] != "...") & ~x["body"].contains("&&") & ~x["body"].contains("\0") & ((x["target"] != "") | (x["anchor"] != ""))
    return F.filter(F.transform(raw, parts), good)


def inline_tags(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)(?<!\S)#([\w一-鿿\-/]+)"), 1))
