"""Report pages of many roots and days: flags, dates and canonical rows.

Reports are rows of ``path, root, date, content`` (the date of the file name). Flags and dates
are column expressions; only the tables of a page go through a vectorized helper, which gives
text by canonical name, and the numbers are read by Spark again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import scalars as S
from ..operators.merge import dedupe_contract_rows

PARSER_VERSION = 1
# fixed values: the notice of a day without data; the stamp before a report's date
NO_DATA_PHRASE = "DADOS PARA A DATA CONSULTADA"
DATE_STAMP = "[Aa][Tt][Uu][Aa][Ll][Ii][Zz][Aa][Dd][Oo] EM"


def page_text(content: Column) -> Column:
    """Bytes as Latin-1 text: markup and letters are the same as in cp1252."""
    return F.decode(content, "ISO-8859-1")


def _has_phrase(parts: Column) -> Column:
    squeezed = lambda x: F.regexp_replace(F.upper(S.fold_accents(F.regexp_replace(x, "(?i)&nbsp;", " "))), "[^A-Z0-9]+", " ")
    return F.exists(parts, lambda x: squeezed(x).contains(NO_DATA_PHRASE))


def no_data(content: Column) -> Column:
    """True when one text node, or one line, holds the notice."""
    raw = content.cast("string")
    hint = F.upper(S.fold_accents(page_text(content))).contains("CONSULTADA")  # most pages lack its last word and need no more
    found = _has_phrase(F.split(page_text(content), "<[^>]*>")) | _has_phrase(F.split(raw, "<[^>]*>")) | _has_phrase(F.split(raw, r"\R"))
    return F.coalesce(F.when(hint, found), F.lit(False))


def root_options(html: Column) -> Column:
    """Roots in the page's list of choices; an empty array without a list."""
    block = r"(?is)<select(?=[^>]*(?:\bname\s*=\s*['\"]?cboMercadoria\b|\bid\s*=\s*['\"]?comboMerc1\b))[^>]*>(.*?)(?:</select|\z)"
    inner = F.array_join(F.regexp_extract_all(html, F.lit(block), 1), " ")
    tag = r"(?is)<option([^>]*)>([^<]*)"
    value = F.transform(F.regexp_extract_all(inner, F.lit(tag), 1), lambda a: F.regexp_extract(a, r"(?is)\bvalue\s*=\s*(?:'([^']*)'|\"([^\"]*)\"|([^\s'\">]+))", 0))
    value = F.transform(value, lambda v: F.regexp_replace(v, r"(?is)^value\s*=\s*|['\"]", ""))
    text = F.transform(F.regexp_extract_all(inner, F.lit(tag), 2), lambda t: F.substring_index(t, ":", 1))
    both = F.transform(F.array_union(value, text), lambda v: F.upper(F.regexp_replace(F.regexp_replace(v, "&nbsp;|\u00a0", " "), r"\s+", "")))
    return F.array_distinct(F.filter(both, lambda v: v != ""))


def root_available(html: Column, root: Column) -> Column:
    options = root_options(html)
    return (F.size(options) == 0) | F.array_contains(options, S.normalize_root(root))


def report_date(html: Column, from_name: Column) -> Column:
    """The date of the first stamped cell that has one; else the file name's."""
    cells = F.regexp_extract_all(html, F.lit(r"(?is)<td\b[^>]*>(.*?)(?=<td\b|</td|\z)"), 1)
    cells = F.transform(cells, lambda c: F.regexp_replace(c, "<[^>]*>", ""))
    stamped = F.filter(cells, lambda c: c.rlike(DATE_STAMP))
    dates = F.transform(stamped, lambda c: F.try_to_date(F.regexp_extract(c, r"(\d{2}/\d{2}/\d{4})", 1), "dd/MM/yyyy"))
    return F.coalesce(F.try_element_at(F.filter(dates, lambda d: d.isNotNull()), F.lit(1)), from_name)


def flag_reports(reports: DataFrame) -> DataFrame:
    """Adds ``no_data``, ``root_options``, ``root_available`` and ``report_date``."""
    html = page_text(F.col("content"))
    return reports.withColumns({
        "no_data": no_data(F.col("content")), "root_options": root_options(html),
        "root_available": root_available(html, F.col("root")), "report_date": report_date(html, F.col("date")),
    })


_PARSED = "path string, root string, date date, report_date date, status string, message string, row_no int, cells map<string,string>"


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from .page_tables import page_rows

    for frame in frames:
        out = []
        for path, root, date, stamped, usable, content in frame.itertuples(index=False):
            rows, status, message = None, "no_data", None
            if usable:
                try:
                    rows = page_rows(bytes(content or b"").decode("cp1252", "replace"))
                    status = "ok" if rows else "no_data"
                except Exception as error:  # whatever is wrong with one page, the others are read
                    status, message = "error", f"{type(error).__name__}: {error}"
            for i, cells in enumerate(rows or [None]):
                out.append((path, root, date, stamped, status, message, i, cells))
        yield pd.DataFrame(out, columns=["path", "root", "date", "report_date", "status", "message", "row_no", "cells"])


def parse_reports(reports: DataFrame) -> DataFrame:
    """A row for each contract of each page, or one row with status ``no_data`` or ``error``.

    Pages with the notice, without their root among the choices, without tables or without contracts
    have no data. Columns: path, root, date (of the file), report_date, status, message,
    row_no, cells (text by canonical name) and the parser's version. Null content is an empty page.
    """
    html = page_text(F.col("content"))
    root = S.normalize_root(F.col("root"))
    usable = F.coalesce(~no_data(F.col("content")) & root_available(html, root), F.lit(False))
    pages = reports.select("path", root.alias("root"), "date", report_date(html, F.col("date")).alias("report_date"), usable.alias("usable"), "content")
    return pages.mapInPandas(_parse, _PARSED).withColumn("parser_version", F.lit(PARSER_VERSION))


def bulletin_rows(parsed: DataFrame, extras: bool = False) -> DataFrame:
    """Canonical rows of the parsed pages, one for each date and ticker; other columns in ``extras`` if asked for."""
    cell = lambda c: F.col("cells")[c]
    code = S.contract_code(cell("contract_code"))
    keys = [F.coalesce("report_date", "date").alias("date"), "root", code.alias("contract_code"), S.ticker_of(code, F.col("root")).alias("ticker")]
    known = [*N.KEYS, *N.NUMBERS]
    rest = [F.map_filter("cells", lambda k, v: ~k.isin(known) & (F.btrim(v, F.lit(S.SPACE)) != "")).alias("extras")] if extras else []
    rows = parsed.where("status = 'ok'").select(*keys, *(S.pt_number(cell(c)).alias(c) for c in N.NUMBERS), *rest, F.col("row_no").cast("long").alias("arrival_seq"))
    return dedupe_contract_rows(rows).drop("arrival_seq")


def no_data_reports(parsed: DataFrame) -> DataFrame:
    """(filename, root, date) of the pages without data, as the registry has them."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    return parsed.where("status = 'no_data'").select(name.alias("filename"), "root", "date").distinct()
