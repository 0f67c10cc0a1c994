"""Citations: extraction, normal form, index, resolution, typed relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The forms of citations, in the order in which they are looked for.
_RCW_NUMBER = r"\d{1,2}[A-Z]?\.\d{1,3}[A-Z]?[.-]\d{3,4}"
PATTERNS = {
    "rcw": rf"RCW\s+{_RCW_NUMBER}(?:\(\d+\))*(?:\([a-z]\))*",
    "rcw_chapter": r"(?:chapter|Chapter)\s+\d{1,2}[A-Z]?\.\d{1,3}[A-Z]?\s+RCW",
    "wac": r"WAC\s+\d{2,3}-\d{2,3}[A-Z]?-\d{3,5}(?:\(\d+\))*(?:\([a-z]\))*",
    "smc": r"SMC\s+\d{1,2}\.\d{2,3}\.\d{3}(?:\([A-Za-z]\))*",
    "smc_section": r"Section\s+\d{1,2}\.\d{2,3}\.\d{3}",
    "dir": r"(?:DR|Director'?s?\s+Rule)\s+\d{1,2}-\d{4}",
    "eo": r"(?:Executive Order|EO)\s+\d{2}-\d{2}",
    "ibc": r"IBC\s+(?:Section\s+)?\d{3,4}(?:\.\d+)*",
    "wa_case": r"\w+(?:\s+\w+)?\s+v\.\s+\w+(?:\s+\w+)?,\s+\d+\s+Wn\.(?:2d|App\.)\s+\d+",
    "wa_const": r"WASH\.\s+CONST\.\s+art\.\s+[IVXLC]+,\s+(?:section|§)\s+\d+",
    "ordinance": r"Ord\.\s+\d{6}",
}
_LISTED = rf"{_RCW_NUMBER}(?:\([^)]*\))*"
RCW_LIST = rf"RCW\s+{_LISTED}((?:,\s*(?:and\s+)?{_LISTED})+)"

# Phrases that state a relationship; the last group, where there is one, holds what is cited.
_CODE, _NUMBER = "(?:RCW|WAC|SMC)", r"[\d.\-A-Za-z]+"
RELATIONS = {
    "IMPLEMENTS": (
        r"(?s)\[Statutory Authority:\s*(.*?)\]",
        r"(?i)implement.*?(?:authority granted.*?by\s+)?((?:RCW|chapter[\s\d.]+RCW)[\s\d.A-Za-z]+)",
        r"(?i)purpose of this chapter is to implement.*?((?:chapter[\s\d.]+RCW|RCW[\s\d.A-Za-z]+))",
        r"Code.*?Reference:\s*(.+?)(?:\n|\z)",
    ),
    "SUBJECT_TO": (
        rf"(?:shall be\s+)?subject to (?:the provisions of\s+)?(?:Section\s+)?({_CODE}\s+{_NUMBER})",
        r"as subject to:?\s+((?:RCW|WAC)\s+[\d.,\s]+)",
        r"required.*?under\s+(RCW\s+[\d.A-Za-z]+)",
        rf"(?:pursuant to|in accordance with)\s+({_CODE}\s+{_NUMBER})",
    ),
    "DEFINED_BY": (
        rf"(?:as\s+)?defined\s+in\s+({_CODE}\s+{_NUMBER})",
        r"has the meaning set forth in\s+(?:Section\s+)?([\d.]+)",
        r"as used in this chapter.*?see\s+(WAC\s+[\d\-]+)",
    ),
    "AMENDED_BY": (
        r"Supersedes:\s*(.+?)(?:\n|\z)",
        r"(?:as amended by|amends)\s+((?:RCW|WAC|SMC|Ord\.)\s+[\d.\-]+)",
        r"(?:supersedes|replaces|rescinds)\s+(?:Executive Order|EO)\s+(\d{2}-\d{2})",
    ),
}
CHAPTERS = r"(?i)chapters?\s+([\d.]+[A-Z]?(?:\s+and\s+[\d.]+[A-Z]?)*)\s+RCW"
# which IMPLEMENTS phrases count for which agency, by position above
IMPLEMENTS_OF = {"WAC": (0,), "SMC": (1, 2), "Seattle DIR": (3,)}
PRIORITY = {"IMPLEMENTS": 0, "SUBJECT_TO": 1, "DEFINED_BY": 2, "AMENDED_BY": 3, "CITES": 4}
PREFIX_OF = {"RCW": "RCW", "WAC": "WAC", "SMC": "SMC", "IBC": "IBC", "IBC-WA": "IBC", "DIR": "DIR", "SEATTLE DIR": "DIR", "SPU": "SPU"}


def extract(text: Column) -> Column:
    """Citations of a text as they stand, each once, in order of form and place; bare numbers of a
    comma list after an RCW citation get the prefix."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 0) for p in PATTERNS.values()]))
    listed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(RCW_LIST), 1), lambda x: F.regexp_extract_all(x, F.lit(_LISTED), 0)))
    return F.array_distinct(F.concat(found, F.transform(listed, lambda n: F.concat(F.lit("RCW "), n))))


def normalize(citation: Column) -> Column:
    return F.trim(F.regexp_replace(citation, r"\s+", " "))


def _parts(citation: Column) -> tuple[Column, Column]:
    """Code and number of a normalised citation; the number is null where there is no space."""
    c = normalize(citation)
    return F.substring_index(c, " ", 1), F.when(F.contains(c, F.lit(" ")), F.regexp_replace(c, r"^\S+ ", ""))


def chapter_of(citation: Column) -> Column:
    """Chapter prefix: a WAC number without its last - part, another without its last . part; else null."""
    code, number = _parts(citation)
    wac = F.when((F.upper(code) == "WAC") & number.contains("-"), F.regexp_replace(number, r"-[^-]*$", ""))
    chapter = F.coalesce(wac, F.when(number.contains("."), F.regexp_replace(number, r"\.[^.]*$", "")))
    return F.when(chapter.isNotNull(), F.concat_ws(" ", code, chapter))


def is_section(citation: Column) -> Column:
    """Whether a citation names a section rather than a chapter: three parts, or a part after a chapter."""
    code, number = _parts(citation)
    other = number.contains(".") & ((F.size(F.split(number, r"\.")) >= 3) | number.contains("-"))
    return F.coalesce(F.when(F.upper(code) == "WAC", F.size(F.split(number, "-")) >= 3).otherwise(other), F.lit(False))


def index(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(citation, target): the last row of each citation; (chapter, target): the first of each chapter.

    ``chunks(id, citation, ord)``; blank citations are left out."""
    rows = chunks.where(F.length(F.trim("citation")) > 0).select("id", "ord", normalize(F.col("citation")).alias("citation"))
    exact = rows.groupBy("citation").agg(F.max_by("id", "ord").alias("target"))
    chapters = rows.withColumn("chapter", chapter_of(F.col("citation"))).where("chapter is not null").groupBy("chapter").agg(F.min_by("id", "ord").alias("target"))
    return exact, chapters


_GROUP = r"(?i)\([a-z0-9]+\)"
_KEYS = "array<struct<priority:int,key:string,chapter:boolean>>"


def candidates(citation: Column, chapter_fallback: bool = True) -> Column:
    """Keys to look up in order: (priority, key, chapter).  Exact; without trailing groups, one after
    another; a bare Section as SMC; then, unless it names a section, itself and its chapter as chapters."""
    c = normalize(citation)
    n = F.size(F.regexp_extract_all(c, F.lit(_GROUP + r"(?=(?:\([a-z0-9]+\))*$)"), 0))

    def strips(x: Column, base: int) -> Column:
        cut = lambda i: F.regexp_replace(x, F.concat(F.lit(r"(?i)(?:\([a-z0-9]+\)){"), i.cast("string"), F.lit("}$")), "")
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((F.lit(base) + i).alias("priority"), F.rtrim(cut(i)).alias("key"), F.lit(False).alias("chapter")))

    none = F.array().cast(_KEYS)
    keys = F.concat(strips(c, 0), F.when(c.startswith("Section "), strips(F.concat(F.lit("SMC "), F.substring(c, 9, 10_000)), 100)).otherwise(none))
    if not chapter_fallback:
        return keys
    as_chapter = lambda p, k: F.struct(F.lit(p).alias("priority"), k.alias("key"), F.lit(True).alias("chapter"))
    return F.when(is_section(c), keys).otherwise(F.concat(keys, F.array(as_chapter(200, c), as_chapter(201, chapter_of(c)))))


def resolve(rows: DataFrame, exact: DataFrame, chapters: DataFrame, chapter_fallback: bool = True) -> DataFrame:
    """Adds ``target`` (null if unresolved) to rows with a ``citation``: one equi-join on distinct
    citations' candidate keys, then the candidate with the least priority."""
    keys = rows.select("citation").distinct().select("citation", F.explode(candidates(F.col("citation"), chapter_fallback)).alias("k")).select("citation", "k.*")
    table = exact.select(F.col("citation").alias("key"), "target", F.lit(False).alias("chapter")).union(chapters.select(F.col("chapter").alias("key"), "target", F.lit(True).alias("chapter")))
    best = keys.join(table, ["key", "chapter"]).groupBy("citation").agg(F.min_by("target", "priority").alias("target"))
    return rows.join(best, "citation", "left")


def relations(chunks: DataFrame) -> DataFrame:
    """(source, rel_type, citation) of chunks(id, text, agency): phrases with the citations in what they
    capture, then every other citation as CITES; a citation counts once a chunk, in its strongest type."""
    text = F.col("text")
    none = F.array().cast("array<string>")
    typed = []
    for kind, patterns in RELATIONS.items():
        for i, p in enumerate(patterns):
            whole = F.regexp_extract_all(text, F.lit(p), 0)
            if kind == "IMPLEMENTS":
                agencies = [a for a, ps in IMPLEMENTS_OF.items() if i in ps]
                whole = F.when(F.col("agency").isin(agencies), whole if "SMC" in agencies else F.slice(whole, 1, 1)).otherwise(none)
            typed.append(_tag(_cited(whole, p, kind != "IMPLEMENTS" or i in IMPLEMENTS_OF["SMC"]), kind))
    chapters = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CHAPTERS), 1), lambda x: F.split(x, r"(?i)\s+and\s+")))
    typed.append(_tag(F.when(F.col("agency").isin(list(IMPLEMENTS_OF)), F.transform(chapters, lambda n: F.concat(F.lit("RCW "), n))).otherwise(none), "IMPLEMENTS"))
    typed.append(_tag(extract(text), "CITES"))
    rows = chunks.select(F.col("id").alias("source"), F.explode(F.flatten(F.array(*typed))).alias("r")).select("source", "r.rel_type", normalize(F.col("r.raw")).alias("citation"))
    return strongest(rows.where("citation <> ''"))


def _cited(whole: Column, pattern: str, from_whole: bool) -> Column:
    """Citations within each match's captured text, else (if asked) within the match."""

    def one(match: Column) -> Column:
        caught = extract(F.regexp_extract(match, pattern, 1))
        return F.when(F.size(caught) > 0, caught).otherwise(extract(match)) if from_whole else caught

    return F.flatten(F.transform(whole, one))


def _tag(cited: Column, kind: str) -> Column:
    return F.transform(cited, lambda c: F.struct(F.lit(kind).alias("rel_type"), c.alias("raw")))


def strongest(rows: DataFrame) -> DataFrame:
    """One row of each (source, citation): the type of highest priority."""
    order = F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return rows.groupBy("source", "citation").agg(F.min_by("rel_type", F.try_element_at(order, F.col("rel_type"))).alias("rel_type"))


def split_resolved(rows: DataFrame, exact: DataFrame, chapters: DataFrame, confidence: float = 1.0, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, rel_type, confidence) without self edges, each once; and the unresolved
    (source, citation, rel_type).  ``compat``: of a source's unresolved ones of a type, one."""
    rows = resolve(rows, exact, chapters)
    edges = rows.where("target is not null and target <> source").select(F.col("source").alias("src"), F.col("target").alias("dst"), "rel_type").distinct().withColumn("confidence", F.lit(confidence))
    left = rows.where("target is null").select("source", "citation", "rel_type").distinct()
    if compat:
        left = left.groupBy("source", "rel_type").agg(F.min("citation").alias("citation"))
    return edges, left


def with_prefix(raw: Column, agency: Column) -> Column:
    """Bare Section, Subsection and Chapter references and bare numbers with their agency's prefix;
    prefixed ones, and those of unknown agencies, as they are."""
    prefix = F.try_element_at(F.create_map(*[x for k, v in PREFIX_OF.items() for x in (F.lit(k), F.lit(v))]), F.upper(F.trim(agency)))
    known = "|".join(sorted(set(PREFIX_OF.values())))
    done = F.trim(raw).rlike(rf"(?i)^(?:{known}) ")
    word = r"(?i)^(?:Section|Subsection|Chapter)\s+"
    bare = F.when(raw.rlike(word), F.regexp_replace(raw, word, "")).when(F.trim(raw).rlike(r"^[^\p{L}]"), F.trim(raw))
    return F.when(prefix.isNotNull() & ~done & bare.isNotNull(), F.concat(prefix, F.lit(" "), bare)).otherwise(raw)


def is_grounded(citation: Column, text: Column) -> Column:
    """Whether a proposed citation, or its bare number, stands in the text (case and white space apart)."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    number = F.regexp_extract(citation, r"(\d[\d.\-A-Za-z]*)", 1)
    return F.contains(flat(text), flat(citation)) | ((number != "") & F.contains(flat(text), flat(number)))


def grounded(proposals: DataFrame, chunks: DataFrame, most_chars: int = 3000) -> DataFrame:
    """Proposals (id, citation, rel_type) of an extractor that stand in the part of the chunk it saw and
    are not the chunk's own citation, each once in its strongest type."""
    seen = chunks.select("id", F.substring("text", 1, most_chars).alias("seen"), F.col("citation").alias("own"))
    rows = proposals.join(seen, "id").where(is_grounded(F.col("citation"), F.col("seen")) & ~normalize(F.col("citation")).eqNullSafe(normalize(F.col("own"))))
    return strongest(rows.select(F.col("id").alias("source"), normalize(F.col("citation")).alias("citation"), "rel_type"))


def first_rows(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
