"""The tables of one report page: a small helper for the vectorized parser, free of Spark.

A page has up to three tables (contracts, volumes, prices), each below an element with a fixed
identifier or put together by the page's script. Markup is often broken: a new cell or row
closes an open one, and what doesn't parse is skipped.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from ..functions.names import sanitize, spread

# fixed values: element identifiers of the tables
TABLE_IDS = ["MercadoFut0", "MercadoFut1", "MercadoFut2"]
# fixed values: header texts that pages run together
HEADER_NAMES = [
    "ULT. OF. COMPRA", "ULT. OF. VENDA", "ULT. PRECO", "VAR. PTOS.", "PRECO ABERT.", "PRECO MIN.", "PRECO MAX.", "PRECO MED.",
    "ÚLT. OF. COMPRA", "ÚLT. OF. VENDA", "ÚLT. PREÇO", "PREÇO ABERT.", "PREÇO MIN.", "PREÇO MAX.", "PREÇO MED.", "PREÇO MÍN.", "PREÇO MÁX.",
    "PREÇO MÉD.", "AJUSTE ANTER.", "AJUSTE CORRIG.", "AJUSTE", "OSCIL.", "VENCTO", "VOL.",
]
# fixed values: names below the spanning header
SPANNING, SPANNED = "Cotacoes", ["PRECO ABERT.", "PRECO MIN.", "PRECO MAX.", "ULT. PRECO", "AJUSTE"]
VOID = {"br", "img", "input", "meta", "link", "hr", "col", "base", "area"}

_NAME = "(?:" + "|".join(re.escape(n).replace(r"\ ", r"\s+") for n in HEADER_NAMES) + r")(?:\s*\(\d\))?"
_NAMES = re.compile(rf"(?:\s*{_NAME})+\s*")
_PRICE_LIKE = re.compile("PRECO|ULT|AJUSTE|VAR", re.I)

Rows = list[list[str]]
Table = tuple[list[str], Rows]


class _Page(HTMLParser):
    """Rows of the first table below each identifier, of the first table at all, and all script text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []
        self.tables: dict[str, Rows] = {}
        self.first: Rows | None = None
        self.into: Rows | None = None
        self.depth = 0
        self.cell = False
        self.scripts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            if self.depth == 0:
                self.into = []
                self.first = self.into if self.first is None else self.first
                for _, name in self.open:
                    if name:
                        self.tables.setdefault(name, self.into)
            self.depth += 1
        elif self.into is not None and tag == "tr":
            self.into.append([])
            self.cell = False
        elif self.into is not None and tag in ("td", "th"):
            if not self.into:
                self.into.append([])
            self.into[-1].append("")
            self.cell = True
        if tag not in VOID:
            self.open.append((tag, dict(attrs).get("id")))

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
            if self.depth == 0:
                self.into, self.cell = None, False
        elif tag in ("td", "th", "tr"):
            self.cell = False
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "script":
            self.scripts.append(data)
        elif self.into is not None and self.cell:
            self.into[-1][-1] += data


def _read(html: str) -> _Page:
    page = _Page()
    page.feed(html)
    page.close()
    return page


def _scripted(script: str, name: str) -> Rows | None:
    """Rows of a table that the script collects in a variable and puts into the element."""
    for var in dict.fromkeys(re.findall(rf"{name}\s*\.innerHTML\s*=\s*(\w+);", script)):
        v = re.escape(var)
        for quote in "'\"":
            pieces = re.findall(rf"\b{v}\s*=\s*{v}\s*\+\s*{quote}([^{quote}]*){quote};", script)
            if pieces:
                text = re.sub(r"\\(['\"])", r"\1", "".join(pieces))
                rows = _read(re.sub(r"(?i)</tr>\s*<td", "<tr><td", text)).first
                if rows and any(c.strip() for r in rows[1:] for c in r):
                    return rows
                break
    return None


def _name_list(header: str) -> list[str]:
    """The names that a header runs together; the header itself when it isn't made of known names only."""
    return [re.sub(r"\s+", " ", n) for n in re.findall(_NAME, header)] if _NAMES.fullmatch(header) else [header]


def _unique_tail(names: list[str]) -> list[str]:
    """Without repeated names where all repeats stand in the second half."""
    repeats = [i for i, n in enumerate(names) if n in names[:i]]
    return list(dict.fromkeys(names)) if repeats and repeats[0] + 1 > len(names) / 2 else names


def _is_header(row: list[str]) -> bool:
    filled = [c for c in row if c]
    lettered = sum(bool(re.search("[A-Za-z]", c)) for c in filled)
    return lettered >= 2 and lettered * 2 >= len(filled)


def tidy(rows: Rows) -> Table | None:
    """Header names and data rows of equal width; None without data."""
    rows = [[c.replace("\xa0", " ").strip() for c in r] for r in rows]
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    if len(rows) < 2 or not width:
        return None
    names = _unique_tail([c or f"V{i + 1}" for i, c in enumerate(rows[0])])
    data = rows[1:]
    if _is_header(data[0][: len(names)]):
        over, names = names, _unique_tail([c or old for c, old in zip(data[0], names, strict=False)])
        data = data[1:]
        if not re.fullmatch(rf"V\d+|{SPANNING}", over[0]) and _PRICE_LIKE.match(names[0]):
            names = [over[0], *names[:-1]]  # the first column spans both header rows
    width = len(names)
    single = [_name_list(n) for n in names]
    every = [n for part in single for n in part]
    if len(every) == width:
        names = every
    elif len(every) > width and any(len(p) > 1 and all(re.fullmatch(r"V\d+", n) for n in names[i + 1 : i + len(p)]) for i, p in enumerate(single)):
        names = [n for i, p in enumerate(single) for n in (p if len(p) > 1 or not re.fullmatch(r"V\d+", names[i]) else [])][:width]
        names += [f"V{i + 1}" for i in range(len(names), width)]
    if SPANNING in names:
        at = names.index(SPANNING)
        names[at : at + len(SPANNED)] = SPANNED[: width - at]
    return names, [r[:width] for r in data]


def _key(names: list[str]) -> int | None:
    return next((i for i, n in enumerate(names) if sanitize(n) in ("vencto", "contract_code")), None)


def merge(tables: list[Table]) -> Table:
    """The first table's rows with the new columns of the others, matched by contract (first match), else by position."""
    names, data = list(tables[0][0]), [list(r) for r in tables[0][1]]
    at = _key(names)
    keys = [r[at].upper() for r in data] if at is not None else None
    for other, rows in tables[1:]:
        k = _key(other)
        if keys is not None and k is not None:
            by = {r[k].upper(): r for r in reversed(rows)}
            rows = [by.get(key) for key in keys]
        new = [i for i, n in enumerate(other) if n not in names]
        names += [other[i] for i in new]
        for j, r in enumerate(data):
            match = rows[j] if j < len(rows) else None
            r += [match[i] if match else None for i in new]
    return names, data


def page_tables(html: str) -> list[Table]:
    page = _read(html)
    script = "\n".join(page.scripts)
    found = []
    for name in TABLE_IDS:
        table = tidy(page.tables.get(name) or []) or tidy(_scripted(script, name) or [])
        if table:
            found.append(table)
    return found


def page_rows(html: str) -> list[dict[str, str]] | None:
    """Canonical name to text for each row with a contract code; None without tables.

    Raises ValueError where tables have no contract column.
    """
    tables = page_tables(html)
    if not tables:
        return None
    headers, data = merge(tables)
    names = spread(headers)
    if "contract_code" not in names:
        raise ValueError("no contract column")
    out = []
    for r in data:
        row: dict[str, str] = {}
        for n, v in zip(names, r, strict=False):
            if v is not None:
                row.setdefault(n, v)
        if re.sub(r"\s+", "", row.get("contract_code") or ""):
            out.append(row)
    return out
