"""Documents to chunks: normal form, section strategies of eight source families, size bounds.

A strategy is an expression from a text (and file name) to an array of chunks,
so that a document is split where it lies: no shuffle, no Python, and the
chunk's index is its place in the array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AUTHORITY_OF, CHUNK_TOKENS, MIN_CHUNK_TOKENS
from ..functions import strip, token_count
from .citations import extract

FIELDS = (
    ("text", "string"), ("citation", "string"), ("section_number", "string"), ("section_title", "string"), ("subsection_id", "string"), ("parent_section", "string"),
    ("content_type", "string"), ("effective_date", "string"), ("last_amended_date", "string"), ("is_table", "boolean"), ("table_type", "string"), ("metadata", "map<string,string>"),
)
CHUNKS = "array<struct<" + ",".join(f"{n}:{t}" for n, t in FIELDS) + ">>"


def normalize_text(text: Column) -> Column:
    """Without image and unknown marks and invisible characters, line ends as \\n, at most one blank line."""
    t = _replaced(text, "<!--", r"(?i)<!--\s*image\s*-->", "")
    for mark in ("<unknown>", *"\u200b\u200c\u200d\ufeff\xad"):
        t = F.replace(t, F.lit(mark), F.lit(""))
    return strip(_replaced(_replaced(t, "\r", "\r\n?", "\n"), "\n\n\n", "\n{3,}", "\n\n"))


def _replaced(text: Column, needed: str, pattern: str, by: str) -> Column:
    """regexp_replace of a pattern that no text without ``needed`` has: such texts are only looked through for it."""
    return let(text, lambda t: F.when(F.contains(t, F.lit(needed)), F.regexp_replace(t, pattern, by)).otherwise(t))


def has_images(text: Column) -> Column:
    """Whether the raw text has an image mark (asked before it is normalised)."""
    return text.rlike(r"(?i)<!--\s*image\s*-->")


# ---- parts of strategies -----------------------------------------------------------------


def _null() -> Column:
    return F.lit(None).cast("string")


def _chunk(text: Column, **fields: Column) -> Column:
    """One chunk; blank strings in fields are null, the content is substantive unless said."""
    given = {"content_type": F.lit("substantive"), "is_table": F.lit(False), "metadata": F.create_map().cast("map<string,string>"), **fields, "text": text}
    return F.struct(*[given.get(n, _null()).cast(t).alias(n) for n, t in FIELDS])


def _some(value: Column) -> Column:
    """Null for the empty string, which is what a regular expression gives without a match."""
    return F.when(value != "", value)


def _meta(**fields: Column) -> Column:
    """A map of the fields that are there."""
    pairs = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    return F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != ""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: inside higher-order functions Catalyst shares no expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(text: Column, mark: str) -> Column:
    """Pieces of a text, cut in front of each line that matches, stripped, without blank ones."""
    return F.filter(F.transform(F.split(text, rf"(?m)(?={mark})", -1), strip), lambda p: p != "")


def _marked(piece: Column, mark: str) -> Column:
    return piece.rlike(rf"(?m)\A(?:{mark})")


def _sections(text: Column, mark: str) -> Column:
    return F.filter(_cut(text, mark), lambda p: _marked(p, mark))


def _with_sections(text: Column, mark: str, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of the sections and of what precedes the first one (null if there is nothing, or no section); the text is cut once."""

    def of(parts: Column) -> Column:
        first = F.get(parts, F.lit(0))
        sections = F.filter(parts, lambda p: _marked(p, mark))
        both = lambda found: F.struct(found.alias("found"), F.when((F.size(found) > 0) & ~_marked(first, mark), first).alias("before"))
        return let(let(sections, both), lambda s: use(s["found"], s["before"]))

    return let(_cut(text, mark), of)


def _group(piece: Column, mark: str, n: int) -> Column:
    return strip(F.regexp_extract(piece, rf"(?m)\A(?:{mark})", n))


def _title(value: Column) -> Column:
    return F.rtrim(strip(value), F.lit("."))


def sub_split(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` tokens: whole sentences while they fit, long sentences by tokens."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+|\n{2,}"), lambda s: s != "")

    def windows(s: Column) -> Column:
        tokens = F.regexp_extract_all(s, F.lit(r"(?:\w+|[^\w\s])\s*"), 0)
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / limit).cast("int")), lambda i: strip(F.array_join(F.slice(tokens, i * limit + 1, F.lit(limit)), "")))

    sized = lambda s, n: F.struct(s.alias("text"), n.alias("n"))
    parts = F.flatten(F.transform(sentences, lambda s: let(token_count(s), lambda n: F.when(n <= limit, F.array(sized(s, n))).otherwise(F.transform(windows(s), lambda w: sized(w, token_count(w)))))))
    state = lambda out, cur, n: F.struct(out.alias("out"), cur.alias("cur"), n.alias("n"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["n"] == 0, s["text"]).otherwise(F.concat(acc["cur"], F.lit(" "), s["text"]))
        fits = (acc["n"] == 0) | (acc["n"] + s["n"] <= limit)
        return F.when(fits, state(acc["out"], joined, acc["n"] + s["n"])).otherwise(state(F.array_append(acc["out"], acc["cur"]), s["text"], s["n"]))

    start = state(F.array().cast("array<string>"), F.lit(""), F.lit(0))
    return F.aggregate(parts, start, step, lambda acc: F.when(acc["n"] > 0, F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"]))


def _glued(text: Column, mark: str) -> Column:
    """Pieces at the marks, what precedes the first glued to it; empty with fewer than two marks."""

    def glued(parts: Column) -> Column:
        first = F.get(parts, F.lit(0))
        whole = F.when(_marked(first, mark), parts).otherwise(F.concat(F.array(F.concat(first, F.lit("\n\n"), F.get(parts, F.lit(1)))), F.slice(parts, 3, 1_000_000)))
        return F.when(F.size(F.filter(parts, lambda p: _marked(p, mark))) >= 2, whole).otherwise(F.array().cast("array<string>"))

    return let(_cut(text, mark), glued)


def _at_most(text: Column, limit: int) -> Column:
    """Whether a text has at most ``limit`` tokens; none is shorter than a character, so short texts need no count."""
    return (F.coalesce(F.length(text), F.lit(0)) <= limit) | (token_count(text) <= limit)


def _pieces(text: Column, limit: int, mark: str | None, name: Callable[[Column], Column], base: Column) -> Column:
    """array of (id, text): whole (id null), by subsections named by their place, or by size."""
    pair = lambda i, t: F.struct(i.cast("string").alias("id"), t.alias("text"))
    parts = lambda t, b: F.transform(sub_split(t, limit), lambda p, j: pair(F.concat(b, F.lit("_part"), (j + 1).cast("string")), p))
    smaller = parts(text, base)
    if mark:
        by = lambda subs: F.flatten(F.transform(subs, lambda t, k: F.when(token_count(t) <= limit, F.array(pair(name(k), t))).otherwise(parts(t, name(k)))))
        smaller = let(_glued(text, mark), lambda subs: F.when(F.size(subs) >= 2, by(subs)).otherwise(parts(text, base)))
    return F.when(_at_most(text, limit), F.array(pair(_null(), text))).otherwise(smaller)


_NUMBERED = r"^[ \t]*\(\d+\)"
_LETTERED = r"^[ \t]*[A-Z]\.\s+"


def _by_number(base: Column) -> Callable[[Column], Column]:
    return lambda k: F.concat(base, F.lit("("), (k + 1).cast("string"), F.lit(")"))


def _letter(k: Column) -> Column:
    return F.char(k + 65)


def fallback(text: Column, limit: int) -> Column:
    """A text without sections, by size; pieces of fewer than 20 tokens are dropped."""
    pieces = F.filter(sub_split(text, limit), lambda p: token_count(p) >= MIN_CHUNK_TOKENS)
    return F.transform(pieces, lambda p: _chunk(p, content_type=F.lit("fallback"), citation=F.lit(""), section_title=F.lit("")))


def _or_fallback(text: Column, found: Column, chunks: Column, limit: int) -> Column:
    none = F.array().cast(CHUNKS)
    return F.when(F.size(found) > 0, chunks.cast(CHUNKS)).when(strip(text) != "", fallback(strip(text), limit).cast(CHUNKS)).otherwise(none)


# ---- strategies --------------------------------------------------------------------------
# The forms of headers, histories, dates and labels of each source family.

_HASH = r"(?:#{1,6}\s+)?"
WAC_HEADER = rf"^{_HASH}WAC\s+(\d{{3}}-\d{{2,3}}-\d{{3}})\s+(.+)$"
_PART = r"(?m)^(Part\s+\w+[:\s]+.+)$"
_AUTHORITY_BLOCK = r"(?ms)^\[Statutory Authority:.*?(?:\]|\z)"
_BLOCK_RCW = r"RCW\s+[\d.]+(?:\s*(?:,\s*and\s+|and\s+|,\s*)[\d.]+)*"
_EFFECTIVE = r"(?i)effective\s+(\d{1,2}/\d{1,2}/\d{2,4})"


def wac(text: Column, filename: Column, limit: int = CHUNK_TOKENS["WAC"]) -> Column:
    """Administrative code: sections with their statutory authority and the Part they stand under."""

    def carried(pieces: Column) -> Column:
        """The Part in force in front of each piece: the last one of any earlier piece."""
        own = F.transform(pieces, lambda p: F.try_element_at(F.regexp_extract_all(p, F.lit(_PART), 1), F.lit(-1)))
        state = lambda out, part: F.struct(out.alias("out"), part.alias("part"))
        return F.aggregate(own, state(F.array().cast("array<string>"), _null()), lambda a, x: state(F.array_append(a["out"], a["part"]), F.coalesce(x, a["part"])), lambda a: a["out"])

    def section(p: Column, number: Column, part: Column) -> Column:
        def one(x: Column) -> Column:
            return let(F.regexp_extract(x["text"], _AUTHORITY_BLOCK, 0), lambda block: _chunk(
                x["text"], citation=F.concat(F.lit("WAC "), number), section_number=number, section_title=_title(_group(p, WAC_HEADER, 2)), subsection_id=x["id"],
                parent_section=F.coalesce(part, F.concat(F.lit("WAC "), F.substring_index(number, "-", 2))), effective_date=_some(F.regexp_extract(block, _EFFECTIVE, 1)),
                metadata=_meta(statutory_authority=F.regexp_extract(block, _BLOCK_RCW, 0), part_group=part),
            ))

        return F.transform(let(strip(p), lambda s: _pieces(s, limit, _NUMBERED, _by_number(number), number)), one)

    def sections(pieces: Column) -> Column:
        found = lambda parts: F.transform(pieces, lambda p, i: F.when(_marked(p, WAC_HEADER), let(_group(p, WAC_HEADER, 1), lambda number: section(p, number, strip(F.element_at(parts, i + 1))))).otherwise(F.array().cast(CHUNKS)))
        return F.flatten(let(carried(pieces), found))

    marked = lambda pieces: F.filter(pieces, lambda p: _marked(p, WAC_HEADER))
    return let(F.split(text, rf"(?m)(?={WAC_HEADER})", -1), lambda pieces: _or_fallback(text, marked(pieces), sections(pieces), limit))


_RCW_NUMBER = r"\d{1,2}[A-Z]?\.\d{1,3}[A-Z]?[.-]\d{3,4}"
RCW_HEADER = rf"^{_HASH}RCW\s+({_RCW_NUMBER})\s+(.+)$"


def rcw(text: Column, filename: Column, limit: int = CHUNK_TOKENS["RCW"]) -> Column:
    """Statutes: sections with legislative history; a long preamble of cross references is an index chunk."""

    def section(p: Column, number: Column) -> Column:
        history = _some(F.regexp_extract(p, r"(?s)(\[\d{4}\s+.*?\])\s*\z", 1))

        def all_of(x: Column, title: Column, history: Column) -> Column:
            return _chunk(
                x["text"], citation=F.concat(F.lit("RCW "), number), section_number=number, section_title=title, subsection_id=x["id"],
                parent_section=F.concat(F.lit("RCW "), F.regexp_replace(number, r"\.[^.]*$", "")), last_amended_date=_some(F.regexp_extract(history, r"\[(\d{4})\s+", 1)), metadata=_meta(legislative_history=history),
            )

        return let(F.struct(_title(_group(p, RCW_HEADER, 2)).alias("title"), history.alias("history")), lambda s: F.transform(_pieces(p, limit, _NUMBERED, _by_number(number), number), lambda x: all_of(x, s["title"], s["history"])))

    def chunks(marked: Column, before: Column) -> Column:
        references = F.size(F.regexp_extract_all(before, F.lit(rf"(?m)^\s+.*?(?:RCW\s+{_RCW_NUMBER}|{_RCW_NUMBER})"), 0))
        is_index = (F.length(before) > 500) & (references >= 5)
        title = lambda x: F.when(x["id"].isNull(), F.lit("Cross-Reference Index")).otherwise(F.concat(F.lit("Cross-Reference Index (part "), F.regexp_extract(x["id"], r"(\d+)$", 1), F.lit(")")))
        index = F.transform(_pieces(before, limit, None, _letter, F.lit("")), lambda x: _chunk(x["text"], content_type=F.lit("cross_reference_index"), citation=F.lit(""), section_title=title(x)))
        found = F.flatten(F.transform(marked, lambda p: let(_group(p, RCW_HEADER, 1), lambda number: section(p, number)))).cast(CHUNKS)
        return _or_fallback(text, marked, let(found, lambda c: F.when(F.coalesce(is_index, F.lit(False)), F.concat(index.cast(CHUNKS), c)).otherwise(c)), limit)

    return _with_sections(text, RCW_HEADER, chunks)


SMC_HEADER = rf"^{_HASH}(\d{{1,2}}\.\d{{2,3}}\.\d{{3}})\s*[-–—]\s*(.+)$"
_SMC_TABLE = r"(?m)(?:Table\s+[A-Z\d]|^\|)"
_SMC_TABLES = (("fee", "fee_schedule"), ("dimension", "dimensional"), ("zone", "zoning"), ("height", "dimensional"), ("setback", "dimensional"), ("parking", "dimensional"))


def _table_type(text: Column) -> Column:
    out = F.lit("other")
    for word, kind in reversed(_SMC_TABLES):
        out = F.when(F.contains(F.lower(text), F.lit(word)), kind).otherwise(out)
    return F.when(text.rlike(_SMC_TABLE), out)


def smc(text: Column, filename: Column, limit: int = CHUNK_TOKENS["SMC"]) -> Column:
    """Municipal code: sections without web footers, with ordinance history, definitions and table types."""
    clean = F.regexp_replace(text, r"(?m)The Seattle Municipal Code.*?$|^\d{1,2}/\d{1,2}/\d{4}.*?$", "")

    def section(p: Column, number: Column) -> Column:
        history = F.try_element_at(F.regexp_extract_all(p, F.lit(r"(?s)\(Ord\.\s+\d+.*?\)"), 0), F.lit(-1))
        kind = F.when(p.rlike(r'"[^"]+"\s+means\b'), "definition").otherwise("substantive")
        one = lambda x: _chunk(
            x["text"], citation=F.concat(F.lit("SMC "), number), section_number=number, section_title=_title(_group(p, SMC_HEADER, 2)), subsection_id=x["id"],
            parent_section=F.concat(F.lit("SMC "), F.substring_index(number, ".", 2)), content_type=kind, last_amended_date=F.array_max(F.regexp_extract_all(history, F.lit(r"(\d{4})\s*[;)]"), 1)),
            is_table=x["text"].rlike(_SMC_TABLE), table_type=_table_type(x["text"]), metadata=_meta(ordinance_history=history),
        )
        name = lambda k: F.concat(number, F.lit("("), _letter(k), F.lit(")"))
        return F.transform(_pieces(p, limit, _LETTERED, name, number), one)

    chunks = lambda marked: F.flatten(F.transform(marked, lambda p: let(_group(p, SMC_HEADER, 1), lambda number: section(p, number))))
    return let(clean, lambda t: let(_sections(t, SMC_HEADER), lambda marked: _or_fallback(t, marked, chunks(marked), limit)))


_DIR_FIELDS = {"supersedes": "Supersedes", "publication_date": "Publication", "effective_date": "Effective", "subject": "Subject", "code_reference": "Code/Section Reference", "rule_type": "Type of Rule", "ordinance_authority": "Ordinance Authority", "department": "Applicant"}
DIR_BODY, DIR_HEADER, WHOLE = rf"^{_HASH}1\.0\s+", rf"^{_HASH}(\d+\.\d*)\s+(.+)$", 1500


def director_rule(text: Column, filename: Column, limit: int = CHUNK_TOKENS["Seattle DIR"]) -> Column:
    """Director's rules: a header chunk of labelled fields, then the body, by decimal sections if it is long."""

    def field(label: str) -> Column:
        value = strip(F.regexp_replace(strip(F.regexp_extract(text, rf"(?i){label}:\s*(.+?)(?:\n|\z)", 1)), r"[|\s]+\z", ""))
        return F.when(~F.lower(value).isin("n/a", "na", "none", ""), value)

    fields = {k: field(v) for k, v in _DIR_FIELDS.items()}
    body_no, file_no = F.regexp_extract(text, r"(?i)(?:DR|Director.?s?\s+Rule)\s+(\d{1,2}-\d{4})", 1), F.regexp_extract(F.regexp_extract(filename, r"([^/]*)$", 1), r"^(\d{1,2}-\d{4})", 1)
    number = F.coalesce(_some(file_no), _some(body_no))
    citation = F.coalesce(F.concat(F.lit("DR "), number), F.lit(""))
    more = dict(citation=citation, effective_date=fields["effective_date"], parent_section=citation, metadata=_meta(**{k: v for k, v in fields.items() if k not in ("effective_date", "subject")}))
    subject = F.coalesce(fields["subject"], F.lit(""))
    at = F.regexp_instr(text, F.lit(rf"(?m){DIR_BODY}"))
    head = F.when(at > 1, strip(F.substring(text, F.lit(1), at - 1)))
    body = F.when(at > 0, strip(F.substring(text, at, F.length(text)))).otherwise(strip(text))
    sections = _sections(body, DIR_HEADER)

    def section(p: Column) -> Column:
        n = _group(p, DIR_HEADER, 1)
        return F.transform(_pieces(p, limit, None, _letter, n), lambda x: _chunk(x["text"], section_number=n, section_title=_group(p, DIR_HEADER, 2), subsection_id=x["id"], **more))

    parts = F.transform(sub_split(body, limit), lambda p, j: _chunk(p, section_title=subject, subsection_id=F.concat(F.lit("part"), (j + 1).cast("string")), **more))
    long = F.when(F.size(sections) > 0, F.flatten(F.transform(sections, section)).cast(CHUNKS)).otherwise(parts.cast(CHUNKS))
    short = F.when(body != "", F.array(_chunk(body, section_title=subject, **more)).cast(CHUNKS)).otherwise(F.array().cast(CHUNKS))
    header = F.when(head != "", F.array(_chunk(head, section_title=subject, **{**more, "content_type": F.lit("header_metadata")})).cast(CHUNKS)).otherwise(F.array().cast(CHUNKS))
    return F.concat(header, F.when(token_count(body) <= WHOLE, short).otherwise(long))


HEADING, MIN_SECTION = rf"^{_HASH}([A-Z][A-Z\s]{{3,}})$", 200


def merge_short(sections: Column, least: int = MIN_SECTION) -> Column:
    """sections (heading, body): those of fewer than ``least`` tokens go to the next, what is left to the last."""
    state = lambda out, h, b: F.struct(out.alias("out"), h.alias("h"), b.alias("b"))
    pair = lambda h, b: F.struct(h.alias("heading"), b.alias("body"))

    def step(acc: Column, s: Column) -> Column:
        carrying = acc["b"] != ""
        heading = F.when(carrying, acc["h"]).otherwise(s["heading"])
        body = F.when(carrying, F.concat(acc["b"], F.lit("\n\n"), s["body"])).otherwise(s["body"])
        return F.when(token_count(body) < least, state(acc["out"], heading, body)).otherwise(state(F.array_append(acc["out"], pair(heading, body)), F.lit(""), F.lit("")))

    def finish(acc: Column) -> Column:
        out, last = acc["out"], F.element_at(acc["out"], -1)
        joined = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(pair(last["heading"], F.concat(last["body"], F.lit("\n\n"), acc["b"]))))
        return F.when(acc["b"] == "", out).when(F.size(out) > 0, joined).otherwise(F.array(pair(acc["h"], acc["b"])))

    start = state(F.array().cast("array<struct<heading:string,body:string>>"), F.lit(""), F.lit(""))
    return F.aggregate(sections, start, step, finish)


def court_opinion(text: Column, filename: Column, limit: int = CHUNK_TOKENS["WA Court Opinions"]) -> Column:
    """Opinions: without the slip notice, a caption chunk, sections at capital headings with short ones merged."""
    slip, direct = F.regexp_instr(text, F.lit("(?i)This opinion was filed for record")), F.regexp_instr(text, F.lit(r"(?m)^IN THE\b"))
    rest = F.substring(text, slip + 35, F.length(text))
    after = F.regexp_instr(rest, F.lit(r"(?m)^IN THE\b"))
    text = F.when((slip > 0) & (after > 0), F.substring(rest, after, F.length(rest))).when(direct > 101, F.substring(text, direct, F.length(text))).otherwise(text)
    top = F.substring(text, 1, 2000)
    court = F.upper(F.regexp_extract(top, r"(?is)(SUPREME COURT|COURT OF APPEALS.*?DIVISION\s+[IV]+)", 1))
    division = F.when(F.contains(court, F.lit("DIVISION")), F.trim(F.substring_index(court, "DIVISION", -1))).otherwise("")
    caption = dict(
        case_number=F.regexp_extract(top, r"No\.\s+(\d{5,}-\d)", 1), filing_date=F.regexp_extract(top, r"[Ff]iled\s+(\w+\s+\d{1,2},\s+\d{4})", 1), author_justice=F.regexp_extract(top, r"(?m)^(\w+),\s+J\.", 1),
        court=F.when(F.contains(court, F.lit("SUPREME")), "WA Supreme Court").when(court != "", F.concat(F.lit("WA Court of Appeals "), division)),
    )
    case = F.filter(extract(F.substring(text, 1, 3000)), lambda c: F.contains(c, F.lit(" v. ")))
    number = _some(caption["case_number"])
    citation = F.coalesce(F.get(case, F.lit(0)), F.concat(F.lit("No. "), number), F.regexp_replace(F.regexp_extract(filename, r"([^/]*)$", 1), r"\.[^.]*$", ""))
    same = dict(citation=citation, parent_section=citation)
    parts = _with_sections(text, HEADING, lambda marked, before: F.struct(marked.alias("marked"), before.alias("before")))
    marked, before = parts["marked"], parts["before"]
    head = F.when(F.length(before) > 50, F.array(_chunk(before, section_title=F.lit("Case Caption"), **{**same, "content_type": F.lit("case_caption"), "metadata": _meta(**caption, opinion_type=F.lit("majority"))})).cast(CHUNKS)).otherwise(F.array().cast(CHUNKS))
    pairs = F.transform(marked, lambda p: F.struct(_group(p, HEADING, 1).alias("heading"), p.alias("body")))

    def section(s: Column) -> Column:
        kind = F.when(s["heading"].rlike(r"(?i)\b(?:concurring|concurrence)\b"), "concurrence").when(s["heading"].rlike(r"(?i)\b(?:dissenting|dissent)\b"), "dissent").otherwise("majority")
        by_letter = F.contains(F.upper(s["heading"]), F.lit("ANALYSIS"))
        part = lambda x: F.regexp_extract(x["id"], r"_part(\d+)$", 1)
        letter = lambda x: F.regexp_extract(x["id"], r"^([A-Z])", 1)
        label = lambda x: F.when(x["id"].isNull(), "").otherwise(F.concat(F.lit(" ("), F.concat_ws(", ", _some(F.concat(_some(letter(x)), F.lit("."))), F.concat(F.lit("part "), _some(part(x)))), F.lit(")")))
        pieces = F.when(by_letter, _pieces(s["body"], limit, _LETTERED, _letter, F.lit(""))).otherwise(_pieces(s["body"], limit, None, _letter, F.lit("")))
        return F.transform(pieces, lambda x: _chunk(x["text"], section_title=F.concat(s["heading"], label(x)), **same, metadata=_meta(**caption, opinion_type=kind)))

    chunks = F.flatten(F.transform(merge_short(pairs), section)).cast(CHUNKS)
    plain = F.transform(F.filter(sub_split(strip(text), limit), lambda p: token_count(p) >= MIN_CHUNK_TOKENS), lambda p: _chunk(p, section_title=citation, **{**same, "content_type": F.lit("fallback")})).cast(CHUNKS)
    return F.concat(head, F.when(F.size(marked) > 0, chunks).otherwise(plain))


NOW = r"(?i)NOW,?\s+THEREFORE"


def governor_order(text: Column, filename: Column, limit: int = CHUNK_TOKENS["Governor Orders"]) -> Column:
    """Executive orders: number, title, dates, agency; whole if short, else recitals and directives."""
    number = _some(F.regexp_extract(text, r"(?i)EXECUTIVE ORDER\s+(\d{2}-\d{2})", 1))
    stem = F.trim(F.regexp_replace(F.replace(filename, F.lit(".pdf"), F.lit("")), "_", " "))
    title = F.coalesce(_some(strip(F.regexp_extract(text, r"(?m)EXECUTIVE ORDER\s+\d{2}-\d{2}\s*\n+\s*([A-Z][A-Z\s,;:\-]+)$", 1))), stem)
    more = dict(
        citation=F.coalesce(F.concat(F.lit("EO "), number), F.lit("")), parent_section=F.coalesce(F.concat(F.lit("EO "), number), F.lit("")),
        effective_date=_some(strip(F.regexp_extract(text, r"(?i)(?:take effect|signed).*?(\w+\s+\d{1,2},?\s+\d{4})", 1))),
    )
    body = strip(F.regexp_replace(text, r"(?s)This (?:Order|order) (?:is not|shall not be) intended to confer.*?(?=\n\n|\z)", ""))
    agency = F.regexp_replace(strip(F.regexp_extract(text, r"(?:Department of|Office of|Commission on|Board of)\s+([A-Z][A-Za-z\s]+?)(?:\s*[,;.]|\s+(?:shall|is|to|and)\b)", 0)), r"[,.;]+$", "")
    more["metadata"] = _meta(
        governor=strip(F.regexp_extract(text, rf"{NOW},?\s+I,?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", 1)), expiration_date=strip(F.regexp_extract(text, r"(?i)(?:expire|sunset|terminate).*?(\w+\s+\d{1,2},?\s+\d{4})", 1)),
        implementing_agency=agency, cross_citations=F.array_join(extract(body), "; "),
    )
    at = F.regexp_instr(body, F.lit(NOW))
    named = lambda t, label, part: F.transform(_pieces(t, limit, None, _letter, F.lit("")), lambda x: _chunk(x["text"], section_title=F.concat(title, F.lit(" - "), F.when(x["id"].isNull(), label).otherwise(F.concat(F.lit(part + " (part "), F.regexp_extract(x["id"], r"(\d+)$", 1), F.lit(")")))), **more)).cast(CHUNKS)
    none = F.array().cast(CHUNKS)
    recitals, directives = strip(F.substring(body, F.lit(1), at - 1)), strip(F.substring(body, at, F.length(body)))
    halves = F.concat(F.when(recitals != "", named(recitals, "WHEREAS Recitals", "WHEREAS")).otherwise(none), named(directives, "Directives", "Directives"))
    parts = F.transform(sub_split(body, limit), lambda p, j: _chunk(p, section_title=F.concat(title, F.lit(" (part "), (j + 1).cast("string"), F.lit(")")), **more)).cast(CHUNKS)
    whole = F.array(_chunk(body, section_title=title, **more)).cast(CHUNKS)
    out = F.when(token_count(body) <= WHOLE, whole).when(at > 0, halves).otherwise(parts)
    return F.filter(out, lambda c: token_count(c["text"]) >= MIN_CHUNK_TOKENS)


IBC_HEADER = r"^#{0,6}\s*WAC\s+(51-\d{2,3}[A-Z]?-\d{3,4})\s+(.+?)\s*\.?\s*$"
ENERGY_HEADER = rf"^{_HASH}SECTION\s+([CA]\d{{3}})\s+(.+)$"
_AMENDMENTS = (("added", r"(?i)is\s+added"), ("amended", r"(?i)is\s+amended"), ("deleted", r"(?i)is\s+deleted"), ("replaced", r"(?i)replaces"))


def building_code(text: Column, filename: Column, limit: int = CHUNK_TOKENS["IBC-WA"]) -> Column:
    """Building code amendments by section with their kind; energy codes by SECTION C101 headers."""
    parent = F.coalesce(_some(F.replace(filename, F.lit(".pdf"), F.lit(""))), F.lit("IBC-WA"))
    chapter = F.coalesce(_some(F.regexp_extract(F.substring(text, 1, 1000), r"(?i)CHAPTER\s+(51-\d{2,3}[A-Z]*)\s+WAC", 1)), F.lit("51-11C"))
    none = F.array().cast(CHUNKS)

    def preface(before: Column, citation: Column, meta: Column) -> Column:
        title = lambda x: F.when(x["id"].isNull(), "Preface").otherwise(F.concat(F.lit("Preface (part "), F.regexp_extract(x["id"], r"(\d+)$", 1), F.lit(")")))
        return F.when(F.length(before) > 50, F.transform(_pieces(before, limit, None, _letter, F.lit("")), lambda x: _chunk(x["text"], citation=citation, section_title=title(x), content_type=F.lit("preface"), parent_section=parent, metadata=meta)).cast(CHUNKS)).otherwise(none)

    def section(p: Column, number: Column) -> Column:
        def kind(top: Column) -> Column:
            out = F.lit("amended")
            for name, sign in reversed(_AMENDMENTS):
                out = F.when(top.rlike(sign), name).otherwise(out)
            return out

        meta = _meta(ibc_section=F.substring_index(number, "-", -1), amendment_type=let(F.substring(p, 1, 500), kind), base_code=F.lit("IBC"))
        return F.transform(_pieces(p, limit, _NUMBERED, _by_number(number), number), lambda x: _chunk(x["text"], citation=F.concat(F.lit("WAC "), number), section_number=number, section_title=_title(_group(p, IBC_HEADER, 2)), subsection_id=x["id"], parent_section=parent, metadata=meta))

    def energy_section(p: Column, number: Column) -> Column:
        return F.transform(_pieces(p, limit, None, _letter, number), lambda x: _chunk(x["text"], citation=F.concat(F.lit("WAC "), chapter, F.lit(" §"), number), section_number=number, section_title=_title(_group(p, ENERGY_HEADER, 2)), subsection_id=x["id"], parent_section=parent))

    def each(sections: Column, mark: str, one: Callable[[Column, Column], Column]) -> Column:
        return F.flatten(F.transform(sections, lambda p: let(_group(p, mark, 1), lambda number: one(p, number)))).cast(CHUNKS)

    def adopted(energy: Column, before: Column) -> Column:
        found = F.concat(preface(before, F.concat(F.lit("WAC "), chapter), F.create_map().cast("map<string,string>")), each(energy, ENERGY_HEADER, energy_section))
        return _or_fallback(text, energy, found, limit)

    def amended(marked: Column, before: Column) -> Column:
        found = F.concat(preface(before, F.lit(""), _meta(base_code=F.lit("IBC"))), each(marked, IBC_HEADER, section))
        return F.when(F.size(marked) > 0, found).otherwise(_with_sections(text, ENERGY_HEADER, adopted))

    return _with_sections(text, IBC_HEADER, amended)


SPU_HEADER = rf"^{_HASH}(\d{{1,2}}(?:\.\d{{1,2}}){{1,3}})\s+(.+)$"
_SPU_TABLES = ((r"(?i)\b(?:abbreviation|acronym)\b", "abbreviation"), (r"(?i)\b(?:definition|means|defined\s+as)\b", "definition"), (r"(?i)\b(?:diameter|dimension|size|width)\b", "dimensional"), (r"(?i)\b(?:material|specification)\b", "specification"))


def separate_tables(text: Column) -> Column:
    """(tables, prose): runs of lines that start with a pipe, and the other lines."""
    lines = F.split(text, "\n", -1)
    state = lambda tables, prose, now: F.struct(tables.alias("tables"), prose.alias("prose"), now.alias("now"))
    none = F.array().cast("array<string>")
    close = lambda acc: F.when(F.size(acc["now"]) > 0, F.array_append(acc["tables"], F.array_join(acc["now"], "\n"))).otherwise(acc["tables"])
    step = lambda acc, line: F.when(F.ltrim(line).startswith("|"), state(acc["tables"], acc["prose"], F.array_append(acc["now"], line))).otherwise(state(close(acc), F.array_append(acc["prose"], line), none))
    return F.aggregate(lines, state(none, none, none), step, lambda acc: F.struct(close(acc).alias("tables"), strip(F.array_join(acc["prose"], "\n")).alias("prose")))


def _spu_type(text: Column) -> Column:
    out = F.lit("other")
    for sign, kind in reversed(_SPU_TABLES):
        out = F.when(text.rlike(sign), kind).otherwise(out)
    return out


def design_standard(text: Column, filename: Column, limit: int = CHUNK_TOKENS["SPU"]) -> Column:
    """Design standards: decimal sections; of oversized ones tables and prose apart; mandatory language."""
    none = F.array().cast(CHUNKS)
    must = lambda t: _meta(mandatory=F.when(t.rlike(r"(?i)\b(?:must|shall)\b"), "true"))
    intro = lambda before: F.when((F.length(before) > 50) & _at_most(before, limit), F.array(_chunk(before, citation=F.lit(""), section_title=F.lit("Introduction"))).cast(CHUNKS)).otherwise(none)

    def section(p: Column) -> Column:
        number, title, table = _group(p, SPU_HEADER, 1), _title(_group(p, SPU_HEADER, 2)), p.rlike(r"(?m)(?:Table\s+\d|^\|)")
        known = F.struct(number.alias("number"), title.alias("title"), table.alias("table"), F.when(table, _spu_type(p)).alias("kind"))
        return let(known, lambda s: chunks(p, s["number"], s["title"], s["table"], s["kind"]))

    def chunks(p: Column, number: Column, title: Column, table: Column, kind: Column) -> Column:
        content = F.when((kind == "definition") | F.contains(F.lower(title), F.lit("definition")), "definition").when(kind == "specification", "specification").otherwise("substantive")
        more = dict(citation=F.concat(F.lit("SPU "), number), section_number=number, parent_section=F.concat(F.lit("SPU "), F.regexp_replace(number, r"\.[^.]*$", "")))
        whole = F.array(_chunk(p, section_title=title, content_type=content, is_table=table, table_type=kind, metadata=must(p), **more)).cast(CHUNKS)
        split = separate_tables(p)

        def one_table(t: Column, i: Column) -> Column:
            n, sort = (i + 1).cast("string"), _spu_type(t)
            label = lambda x: F.concat(title, F.lit(" (Table "), n, F.when(x["id"].isNull(), "").otherwise(F.concat(F.lit(", part "), F.regexp_extract(x["id"], r"(\d+)$", 1))), F.lit(")"))
            base = F.concat(number, F.lit("_table"), n)
            return F.transform(_pieces(t, limit, None, _letter, base), lambda x: _chunk(x["text"], section_title=label(x), subsection_id=F.coalesce(x["id"], base), content_type=F.when(sort == "definition", "definition").otherwise("substantive"), is_table=F.lit(True), table_type=sort, **more))

        tables = F.flatten(F.transform(split["tables"], one_table)).cast(CHUNKS)
        prose = F.when(split["prose"] != "", F.transform(_pieces(split["prose"], limit, None, _letter, number), lambda x: _chunk(x["text"], section_title=title, subsection_id=x["id"], content_type=content, metadata=must(x["text"]), **more)).cast(CHUNKS)).otherwise(none)
        return F.when(_at_most(p, limit), whole).otherwise(F.concat(tables, prose))

    return _with_sections(text, SPU_HEADER, lambda marked, before: _or_fallback(text, marked, F.concat(intro(before), F.flatten(F.transform(marked, section)).cast(CHUNKS)), limit))


#: The registry of strategies; a new family is a new entry.
STRATEGIES: dict[str, Callable[..., Column]] = {
    "WAC": wac, "RCW": rcw, "SMC": smc, "Seattle DIR": director_rule, "IBC-WA": building_code, "SPU": design_standard, "WA Court Opinions": court_opinion, "Governor Orders": governor_order,
}


def chunk_documents(docs: DataFrame, agency: str, limit: int | None = None) -> DataFrame:
    """Chunks of docs(filename, text) of one agency, with index, agency and authority; raises on an unknown agency."""
    if agency not in STRATEGIES:
        raise ValueError(f"unknown agency {agency}")
    limit = limit or CHUNK_TOKENS[agency]
    rows = docs.where("text is not null").withColumn("has_images", has_images(F.col("text"))).withColumn("text", normalize_text(F.col("text")))
    rows = rows.select("filename", "has_images", F.posexplode(STRATEGIES[agency](F.col("text"), F.col("filename"), limit)).alias("chunk_index", "c"))
    return rows.select(F.lit(agency).alias("agency"), F.lit(AUTHORITY_OF[agency]).alias("authority_level"), "filename", "has_images", "chunk_index", "c.*")
