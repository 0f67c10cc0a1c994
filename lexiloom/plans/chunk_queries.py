"""Queries of document chunking, with the same in SQL where its regular expressions reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from . import views
from .search_queries import _values

# ---- sections at table scale: every line of a document under a header of its own ----------

# header with {a}, {b}, {i} for the document's and the line's numbers; number, citation and title of it
_FORMS = {
    "WAC": ("WAC %d-%d-%d Title %d.", "WAC {}-{}-{} Title {}.", "WAC {}-{}-{}"),
    "RCW": ("RCW %d.%dA.%d Title %d.", "RCW {}.{}A.{} Title {}.", "RCW {}.{}A.{}"),
    "SMC": ("%d.%d.%d - Title %d.", "{}.{}.{} - Title {}.", "SMC {}.{}.{}"),
    "SPU": ("## %d.%d.%d Title %d.", "## {}.{}.{} Title {}.", "SPU {}.{}.{}"),
    "IBC-WA": ("WAC 51-%d-%d%d Title %d.", "WAC 51-{}-{}{} Title {}.", "WAC 51-{}-{}{}"),
}
_NUMBERS = {"WAC": ("100 + {d} % 800", "10 + {d} % 90", "100 + {i} % 900"), "RCW": ("10 + {d} % 90", "10 + {d} % 90", "100 + {i} % 900"), "SMC": ("10 + {d} % 90", "10 + {d} % 90", "100 + {i} % 900"), "SPU": ("10 + {d} % 90", "10 + ({i} // 90) % 90", "10 + {i} % 90"), "IBC-WA": ("10 + {d} % 90", "10 + ({i} // 90) % 90", "10 + {i} % 90")}


_BODY = "\ue000"  # in front of the lines of a document, while it is split: only the headers put in are headers
_ENDS = ("\x85", "\u2028", "\u2029")  # where expressions see the end of a line, besides \\n


def _headed(spark: SparkSession, d: str, agency: str) -> DataFrame:
    numbers = [n.replace("//", "div") for n in _NUMBERS[agency]]

    def line(x: F.Column, i: F.Column) -> F.Column:
        return F.struct(x.alias("x"), i.alias("i"))

    rows = views.table(spark, d, "documents").select("doc_id", F.transform(F.split("text", "\n", -1), line).alias("lines"))
    args = ", ".join("CAST(" + n.format(d="doc_id", i="s.i") + " AS INT)" for n in numbers)
    body = f"if(btrim(s.x, ' \t\x0b\f\r') = '', s.x, concat('{_BODY}', s.x))"
    for end in _ENDS:
        body = f"replace({body}, '{end}', '{end}{_BODY}')"
    text = F.expr(f"array_join(transform(lines, s -> concat(format_string('{_FORMS[agency][0]}', {args}, s.i), '\\n', {body})), '\\n')")
    return rows.select(F.col("doc_id").cast("string").alias("filename"), text.alias("text"))


def _split_sql(agency: str) -> str:
    args = ", ".join(n.format(d="doc_id", i="i") for n in _NUMBERS[agency])
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
  s AS (SELECT *, trim(format('{_FORMS[agency][1]}', {args}, i) || chr(10) || x, ' ' || chr(10) || chr(9)) AS t FROM l)
SELECT CAST(doc_id AS VARCHAR) AS filename, CAST(i AS INTEGER) AS chunk_index, format('{_FORMS[agency][2]}', {args}) AS citation, 'Title ' || i AS section_title, CAST(length(t) AS INTEGER) AS n, md5(t) AS hash FROM s"""


def _splitter(agency: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = chunking.chunk_documents(_headed(spark, d, agency), agency, limit=1 << 30)
        for end in ("\n", *_ENDS):
            rows = rows.withColumn("text", F.replace("text", F.lit(end + _BODY), F.lit(end)))
        return rows.select("filename", "chunk_index", "citation", "section_title", F.length("text").alias("n"), F.md5("text").alias("hash"))

    run.__doc__ = f"Sections of {agency} documents, none over the limit."
    return run


# ---- whole strategies on literal documents -------------------------------------------------

_W = "word " * 30
DOCUMENTS = {
    "WAC": f"front\nPart One: General\nWAC 365-196-010 Purpose.\nText a.\n(1) first {_W}\n(2) second {_W}\n[Statutory Authority: RCW 36.70A.050 and 36.70A.190, effective 1/2/2020]\n## WAC 365-196-020 Scope\nshort\nPart Two: More\nWAC 365-197-010 Third\nx",
    "RCW": f"RCW 36.70A.010 Findings.\nThe legislature.\n[1990 c 1; 2004 c 2.]\nRCW 62A.9A-101 Short title\n(1) {_W}\n(2) {_W}",
    "SMC": f'23.45.502 - Scope. <!-- image -->\n"Floor" means x\n(Ord. 123, 2001; Ord. 5, 2015)\nThe Seattle Municipal Code footer\n23.45.504 – Uses\n| fee | x |\nA. {_W}\nB. {_W}',
    "Seattle DIR": f"Director's Rule 31-2017\nSubject: Streets |\nSupersedes: N/A\nEffective: 1/1/2018\nCode/Section Reference: SMC 23\n1.0 Purpose\nbody {_W}\n2.0 Scope\nmore",
    "IBC-WA": f"A preface that is longer than fifty characters for sure, yes.\nWAC 51-50-0101 Scope.\nThis section is added. text\nWAC 51-50-0102 Two\n(1) {_W}\n(2) {_W}",
    "SPU": f"An introduction that is longer than fifty characters, surely so.\n## 10.1 KEY TERMS\n| Term | means |\n| a | b |\nMust do. {_W}{_W}\n10.1.2 Pipes\nsize",
    "Governor Orders": f"EXECUTIVE ORDER 24-01\nCLEAN AIR\nWHEREAS {_W}\nNOW, THEREFORE, I, Jay Inslee, Governor, order the Department of Ecology shall {_W} take effect May 3, 2024. expire June 1, 2025\n\nThis Order is not intended to confer x\n\nend",
    "WA Court Opinions": f"slip\nThis opinion was filed for record\nIN THE MATTER of a case, a caption of more than fifty characters\nFACTS\n{_W * 8}\nANALYSIS\nA. {_W * 8}\nB. {_W * 8}\nDISSENT\nno",
}
_EXPECTED = [
    ("Governor Orders", 0, "EO 24-01", "CLEAN AIR", None, "substantive"),
    ("IBC-WA", 0, "", "Preface", None, "preface"), ("IBC-WA", 1, "WAC 51-50-0101", "Scope", None, "substantive"), ("IBC-WA", 2, "WAC 51-50-0102", "Two", "51-50-0102(1)", "substantive"), ("IBC-WA", 3, "WAC 51-50-0102", "Two", "51-50-0102(2)", "substantive"),
    ("RCW", 0, "RCW 36.70A.010", "Findings", None, "substantive"), ("RCW", 1, "RCW 62A.9A-101", "Short title", "62A.9A-101(1)", "substantive"), ("RCW", 2, "RCW 62A.9A-101", "Short title", "62A.9A-101(2)", "substantive"),
    ("SMC", 0, "SMC 23.45.502", "Scope", None, "definition"), ("SMC", 1, "SMC 23.45.504", "Uses", "23.45.504(A)", "substantive"), ("SMC", 2, "SMC 23.45.504", "Uses", "23.45.504(B)", "substantive"),
    ("SPU", 0, "", "Introduction", None, "substantive"), ("SPU", 1, "SPU 10.1", "KEY TERMS (Table 1)", "10.1_table1", "definition"), ("SPU", 2, "SPU 10.1", "KEY TERMS", "10.1_part1", "definition"), ("SPU", 3, "SPU 10.1", "KEY TERMS", "10.1_part2", "definition"), ("SPU", 4, "SPU 10.1.2", "Pipes", None, "substantive"),
    ("Seattle DIR", 0, "DR 12-2017", "Streets", None, "header_metadata"), ("Seattle DIR", 1, "DR 12-2017", "Streets", None, "substantive"),
    ("WAC", 0, "WAC 365-196-010", "Purpose", "365-196-010(1)", "substantive"), ("WAC", 1, "WAC 365-196-010", "Purpose", "365-196-010(2)", "substantive"), ("WAC", 2, "WAC 365-196-020", "Scope", None, "substantive"), ("WAC", 3, "WAC 365-197-010", "Third", None, "substantive"),
]


def chunk_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Seven strategies on literal documents with a limit of 60 tokens."""
    out = None
    for agency in sorted(set(DOCUMENTS) - {"WA Court Opinions"}):
        docs = spark.createDataFrame([("12-2017 f.pdf", DOCUMENTS[agency])], "filename string, text string")
        rows = chunking.chunk_documents(docs, agency, 60).select("agency", "chunk_index", "citation", "section_title", "subsection_id", "content_type")
        out = rows if out is None else out.union(rows)
    return out


def chunk_court_opinion(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.createDataFrame([("case.pdf", DOCUMENTS["WA Court Opinions"])], "filename string, text string")
    rows = chunking.chunk_documents(docs, "WA Court Opinions", 300)
    return rows.select("chunk_index", "section_title", "content_type", F.col("metadata")["opinion_type"].alias("opinion_type"))


_COURT = [(0, "Case Caption", "case_caption", "majority"), (1, "FACTS", "substantive", "majority"), (2, "ANALYSIS (A.)", "substantive", "majority"), (3, "ANALYSIS (B.)", "substantive", "majority")]


def chunk_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Documents without headers, by size: tokens of each piece are at most 200."""
    docs = views.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("filename"), "text")
    from ..functions import token_count

    rows = chunking.chunk_documents(docs, "WAC", 200)
    return rows.select("filename", "chunk_index", "content_type", token_count(F.col("text")).alias("tokens"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" <!-- Image -->\r\n"), F.replace("text", F.lit("\n"), F.lit("\r\n\n\n\n")), F.lit("<unknown>​ \n"))
    rows = views.table(spark, d, "documents").select("doc_id", raw.alias("raw"))
    t = chunking.normalize_text(F.col("raw"))
    return rows.select("doc_id", F.md5(t).alias("hash"), F.length(t).alias("n"), chunking.has_images(F.col("raw")).alias("images"))


_TABLES = [(1, "prose\n| a |\n| b |\nmore\n| c |"), (2, "| x |\n\nonly"), (3, "none"), (4, "a\n  | y |")]


def table_separation(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(_TABLES, "id long, text string").select("id", chunking.separate_tables(F.col("text")).alias("s"))
    return rows.select("id", F.size("s.tables").alias("n"), F.array_join("s.tables", "//").alias("tables"), "s.prose")


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import token_count

    return views.table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))


QUERIES = {f"chunk_split_{a.split('-')[0].lower()}": _splitter(a) for a in _FORMS} | {
    f.__name__: f for f in (chunk_strategies, chunk_court_opinion, chunk_fallback, normalize_text, table_separation, token_counts)
}

SQL = {f"chunk_split_{a.split('-')[0].lower()}": _split_sql(a) for a in _FORMS} | {
    "chunk_strategies": f"SELECT a AS agency, b AS chunk_index, c AS citation, d AS section_title, e AS subsection_id, f AS content_type FROM (VALUES {_values(_EXPECTED)}) t(a, b, c, d, e, f)",
    "chunk_court_opinion": f"SELECT a AS chunk_index, b AS section_title, c AS content_type, d AS opinion_type FROM (VALUES {_values(_COURT)}) t(a, b, c, d)",
    "normalize_text": r"""WITH r AS (SELECT doc_id, ' <!-- Image -->' || chr(13) || chr(10) || replace(text, chr(10), chr(13) || chr(10) || chr(10) || chr(10) || chr(10)) || '<unknown>' || chr(8203) || ' ' || chr(10) AS raw FROM documents),
  t AS (SELECT doc_id, trim(regexp_replace(replace(regexp_replace(replace(regexp_replace(raw, '(?i)<!--\s*image\s*-->', '', 'g'), '<unknown>', ''), '[\x{200b}\x{200c}\x{200d}\x{feff}\x{ad}]', '', 'g'), chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS t FROM r)
SELECT doc_id, md5(t) AS hash, CAST(length(t) AS INTEGER) AS n, TRUE AS images FROM t""",
    "table_separation": "SELECT CAST(a AS BIGINT) AS id, b AS n, replace(c, '~', chr(10)) AS tables, replace(d, '~', chr(10)) AS prose FROM (VALUES (1, 2, '| a |~| b |//| c |', 'prose~more'), (2, 1, '| x |', 'only'), (3, 0, '', 'none'), (4, 1, '  | y |', 'a')) t(a, b, c, d)",
    "token_counts": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\w+|[^\w\s]')) AS INTEGER) AS tokens FROM documents",
}
