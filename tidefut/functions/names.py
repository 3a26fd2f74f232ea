"""Column names of bulletins: headers, canonical names and their order."""

from __future__ import annotations

import re
import unicodedata

KEYS = ["date", "root", "contract_code", "ticker"]
# fixed values: numeric columns of the canonical table, in order
NUMBERS = [
    "open_interest", "close_interest", "trade_count", "contracts_traded", "volume", "open", "low", "high", "average_price", "close",
    "settlement_price", "previous_settlement", "corrected_settlement", "change_percent", "change_points", "last_bid", "last_ask",
]
# fixed values: canonical name of each sanitized header
CANONICAL = {
    "vencto": "contract_code", "contr": "contracts_traded", "negoc": "contracts_traded", "num": "volume",
    "contr_abert_1": "open_interest", "abert_1": "open_interest", "contr_fech_2": "close_interest", "fech_2": "close_interest",
    "num_negoc": "trade_count", "contr_negoc": "contracts_traded", "vol": "volume",
    "preco_abert": "open", "preco_abertu": "open", "preco_min": "low", "preco_max": "high", "preco_med": "average_price",
    "ult_preco": "close", "ajuste": "settlement_price",
    "ajuste_anter": "previous_settlement", "ajuste_anter_3": "previous_settlement", "ajuste_ant": "previous_settlement", "ajuste_ant_3": "previous_settlement",
    "ajuste_corrig": "corrected_settlement", "ajuste_corrig_4": "corrected_settlement",
    "oscil": "change_percent", "osc": "change_percent", "var_ptos": "change_points", "ult_of_compra": "last_bid", "ult_of_venda": "last_ask",
}
# fixed values: names that a longer header may contain, most significant first
CONTAINED = ["preco_med", "ult_preco", "ajuste", "var_ptos", "ult_of_compra", "ult_of_venda"]
#: Sanitized names of columns that hold localized numbers: headers with a meaning of their own, and canonical names.
NUMERIC = (set(CANONICAL) - {"vencto", "contr", "negoc", "num", "abert_1", "fech_2"}) | set(NUMBERS)
_PARTS = re.compile("ajuste_anter|ajuste_corrig|" + "|".join(CONTAINED))


def sanitize(name: str) -> str:
    """Accents folded, other characters than letters and digits to single underscores, lower case."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return re.sub("[^A-Za-z0-9]+", "_", plain).strip("_").lower()


def canonical(name: str) -> str:
    """Canonical name of a header: exact, else by a name that it contains, else the name itself."""
    s = sanitize(name)
    return CANONICAL.get(s) or next((CANONICAL[p] for p in CONTAINED if p in s), name)


def spread(headers: list[str]) -> list[str]:
    """Canonical names by position; a header made of several names also names the columns after it."""
    out = [sanitize(canonical(h)) or h for h in headers]
    for i, h in enumerate(headers):
        s = sanitize(h)
        parts = [] if s in CANONICAL else _PARTS.findall(s)
        if len(parts) > 1:
            names = [CANONICAL[p] for p in parts][: len(headers) - i]
            out[i : i + len(names)] = names
    return out
