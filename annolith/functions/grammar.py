"""A grammar for times and quantities in Spanish and English text: a documented subset of what such parsers know.

``parse`` returns results as dictionaries: start, end, body, dim and value, where value has the shape that the annotators
read (``value`` and ``grain``; ``value`` and ``unit``; ``from`` and ``to``). Times depend on an explicit reference time.

Covered: relative days, (next or last) weekdays, "in N units", "N units ago", durations, months with day and year, ISO and
slashed dates, bare years after "en"/"in"; numbers in digits (with thousands and decimals as the language writes them) and
words up to a hundred, ordinals, money, weights with "de"/"of" and a product, distances, volumes and temperatures.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

_DAYS = {
    "es": ["lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo"],
    "en": ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"],
}
_MONTHS = {
    "es": ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"],
    "en": ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"],
}
_RELATIVE = {
    "es": {"anteayer": -2, "ayer": -1, "hoy": 0, "mañana": 1, "pasado mañana": 2},
    "en": {"yesterday": -1, "today": 0, "tomorrow": 1, "the day after tomorrow": 2, "the day before yesterday": -2},
}
_UNITS = {
    "es": {"segundo": "second", "minuto": "minute", "hora": "hour", "día": "day", "dia": "day", "semana": "week", "mes": "month", "meses": "month", "año": "year"},
    "en": {"second": "second", "minute": "minute", "hour": "hour", "day": "day", "week": "week", "month": "month", "year": "year"},
}
_NUMBERS = {
    "es": {w: i for i, w in enumerate("cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte".split())}
    | {"un": 1, "una": 1, "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90, "cien": 100},
    "en": {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())}
    | {"thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100},
}
_ORDINALS = {
    "es": {"primero": 1, "primera": 1, "primer": 1, "segunda": 2, "segundo": 2, "tercero": 3, "tercera": 3, "tercer": 3, "cuarto": 4, "cuarta": 4, "quinto": 5, "quinta": 5},
    "en": {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10},
}
_MONEY = {"€": "EUR", "euros": "EUR", "euro": "EUR", "eur": "EUR", "$": "$", "dólares": "$", "dólar": "$", "dollars": "$", "dollar": "$", "usd": "USD", "£": "GBP", "libras": "GBP", "pounds": "GBP", "gbp": "GBP"}
_MEASURES = {
    "quantity": {"gramos": "gram", "gramo": "gram", "grams": "gram", "gram": "gram", "g": "gram", "kilos": "kilogram", "kilo": "kilogram", "kg": "kilogram", "kilogramos": "kilogram", "kilograms": "kilogram"},
    "distance": {"kilómetros": "kilometre", "kilómetro": "kilometre", "km": "kilometre", "kilometers": "kilometre", "kilometres": "kilometre", "metros": "metre", "metro": "metre", "meters": "metre", "metres": "metre", "m": "metre", "cm": "centimetre", "centímetros": "centimetre", "centimeters": "centimetre", "millas": "mile", "miles": "mile"},
    "volume": {"litros": "litre", "litro": "litre", "liters": "litre", "litres": "litre", "l": "litre", "ml": "millilitre", "mililitros": "millilitre"},
    "temperature": {"grados": "degree", "degrees": "degree", "°c": "celsius", "ºc": "celsius", "°f": "fahrenheit", "°": "degree"},
}
_OF = {"es": "de", "en": "of"}
_IN = {"es": "en|dentro de", "en": "in"}
_NEXT = {"es": "(?:el\\s+)?próximo|la\\s+próxima|próxima", "en": "next"}
_LAST = {"es": "(?:el\\s+)?pasado|la\\s+pasada", "en": "last"}
_AGO = {"es": "hace", "en": None}


def language_of(language: str) -> str:
    """The grammar's language, without a region; one that there is no grammar for is an error."""
    short = language.lower().split("-")[0]
    if short not in _DAYS:
        raise ValueError(f"No grammar for the language {language!r}; there are {', '.join(sorted(_DAYS))}")
    return short


def locale_of(language: str) -> str:
    """The locale that results name for a language."""
    return {"es": "ES_ES", "en": "EN_US"}.get(language, language.upper())


def _alternatives(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def _number(text: str, lang: str) -> float | int | None:
    low = text.lower()
    if low in _NUMBERS[lang]:
        return _NUMBERS[lang][low]
    thousands, decimal = (".", ",") if lang == "es" else (",", ".")
    plain = low.replace(thousands, "").replace(decimal, ".")
    try:
        x = float(plain)
    except ValueError:
        return None
    return int(x) if x == int(x) else x


def _digits(lang: str) -> str:
    t, d = (r"\.", ",") if lang == "es" else (",", r"\.")
    return rf"\d{{1,3}}(?:{t}\d{{3}})+(?:{d}\d+)?|\d+(?:{d}\d+)?"


def _shift(t: datetime, n: int, grain: str) -> datetime:
    if grain in ("second", "minute", "hour", "day", "week"):
        return t + timedelta(**{grain + "s": n})
    months = t.year * 12 + t.month - 1 + n * (12 if grain == "year" else 1)
    year, month = divmod(months, 12)
    last = (datetime(year + month // 11, (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return t.replace(year=year, month=month + 1, day=min(t.day, last))


def iso(t: datetime) -> str:
    offset = t.strftime("%z")
    return t.strftime("%Y-%m-%dT%H:%M:%S.000") + f"{offset[:3]}:{offset[3:]}"


def _floor(t: datetime, grain: str) -> datetime:
    if grain == "week":
        t -= timedelta(days=t.weekday())
    keep = {"second": 6, "minute": 5, "hour": 4, "day": 3, "week": 3, "month": 2, "year": 1}[grain]
    return datetime(*(list(t.timetuple()[:keep]) + [1] * (3 - keep if keep < 3 else 0)), tzinfo=t.tzinfo)


def _rules(lang: str):
    num = rf"(?:{_digits(lang)}|{_alternatives(_NUMBERS[lang])})"
    units = "|".join(re.escape(u) + ("(?:e?s)?" if not u.endswith("es") else "") for u in sorted(_UNITS[lang], key=lambda u: -len(u)))
    days, months = _alternatives(_DAYS[lang]), _alternatives(_MONTHS[lang])
    edge = lambda x: re.compile(rf"(?<!\w)(?:{x})(?!\w)", re.I)
    of = _OF[lang]
    return {
        "relative": edge(f"(?P<word>{_alternatives(_RELATIVE[lang])})"),
        "next_day": edge(rf"(?P<which>(?:{_NEXT[lang]})|(?:{_LAST[lang]}))\s+(?P<day>{days})"),
        "next_unit": edge(rf"(?P<which>(?:{_NEXT[lang]})|(?:{_LAST[lang]}))\s+(?P<unit>{units})"),
        "day": edge(rf"(?:el\s+)?(?P<day>{days})" if lang == "es" else rf"(?:on\s+)?(?P<day>{days})"),
        "in": edge(rf"(?:{_IN[lang]})\s+(?P<n>{num})\s+(?P<unit>{units})"),
        "ago": edge(rf"hace\s+(?P<n>{num})\s+(?P<unit>{units})" if lang == "es" else rf"(?P<n>{num})\s+(?P<unit>{units})\s+ago"),
        "duration": edge(rf"(?P<n>{num})\s+(?P<unit>{units})"),
        "date": edge(rf"(?P<d>\d{{1,2}})\s+(?:{of}\s+)?(?P<month>{months})(?:\s+(?:{of}\s+)?(?P<y>\d{{4}}))?" if lang == "es" else rf"(?P<month>{months})\s+(?P<d>\d{{1,2}})(?:,?\s+(?P<y>\d{{4}}))?"),
        "month": edge(rf"(?P<month>{months})(?:\s+(?:{of}\s+)?(?P<y>\d{{4}}))?"),
        "iso": edge(r"(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})"),
        "slashed": edge(r"(?P<d>\d{1,2})/(?P<m>\d{1,2})/(?P<y>\d{4})"),
        "year": edge(rf"(?:{'en' if lang == 'es' else 'in'})\s+(?P<y>(?:1[5-9]|20)\d{{2}})"),
        "grain": edge(f"(?P<unit>{units})"),
        "number": edge(rf"(?P<n>{num})"),
        "ordinal": edge(rf"(?P<o>{_alternatives(_ORDINALS[lang])})" + ("" if lang == "es" else r"|(?P<k>\d+)(?:st|nd|rd|th)")),
        "money": re.compile(rf"(?<![\w.,])(?:(?P<n>{num})\s*(?P<c>{_alternatives(_MONEY)})(?!\w)|(?P<c2>[€$£])\s*(?P<n2>{_digits(lang)}))", re.I),
        "measure": re.compile(rf"(?<![\w.,])(?P<n>{num})\s*(?P<u>{_alternatives({u for x in _MEASURES.values() for u in x})})(?!\w)(?:\s+{of}\s+(?P<product>\w+))?", re.I),
    }


#: Characters that match a letter when case is ignored though their lower case isn't that letter; texts with one are searched from end to end.
_ODD = re.compile("[İıſK]")
_DIGITS = re.compile(r"\d+")
_SIGN = re.compile("[€$£]")


class _Finder:
    """The rules of a language for some dimensions, and the words that a match of each can begin with.

    A match begins at the beginning of a word (or, for money, at a sign), so that a rule is tried where one of its words is and
    nowhere else: the matches are those of ``finditer``, at the cost of one pass over the text for all rules.
    """

    def __init__(self, lang: str, dims: frozenset[str]):
        import ahocorasick

        self.rules = _rules(lang)
        wanted = {name for d in dims for name in _RULES_OF.get(d, ())}
        firsts = lambda words: {w.split()[0] for w in words}
        numbers = set(_NUMBERS[lang])
        units = {u + end for u in _UNITS[lang] for end in ("", "s", "es")}
        turns = {"el", "la", "próximo", "próxima", "pasado"} if lang == "es" else {"next", "last"}
        months, days = set(_MONTHS[lang]), set(_DAYS[lang])
        glued = lambda marks: {n + m for n in numbers for m in marks} | numbers
        starts = {
            "relative": firsts(_RELATIVE[lang]),
            "next_day": turns,
            "next_unit": turns,
            "day": days | ({"el"} if lang == "es" else {"on"}),
            "in": {"en", "dentro"} if lang == "es" else {"in"},
            "ago": {"hace"} if lang == "es" else numbers,
            "duration": numbers,
            "date": set() if lang == "es" else months,
            "month": months,
            "iso": set(),
            "slashed": set(),
            "year": {"en"} if lang == "es" else {"in"},
            "grain": units,
            "number": numbers,
            "ordinal": firsts(_ORDINALS[lang]),
            "money": glued(_MONEY),
            "measure": glued({u for x in _MEASURES.values() for u in x}),
        }
        digits = {"ago", "duration", "date", "iso", "slashed", "number", "ordinal", "money", "measure"} - ({"ago"} if lang == "es" else {"date"})
        self.digits = sorted(digits & wanted)
        self.money = "money" in wanted
        rules_of: dict[str, list[str]] = {}
        for name in sorted(wanted):
            for w in starts[name]:
                rules_of.setdefault(w, []).append(name)
        self.machine = ahocorasick.Automaton()
        for w, names in rules_of.items():
            self.machine.add_word(w, (len(w), names))
        if rules_of:
            self.machine.make_automaton()
        self.any = bool(rules_of)

    def matches(self, text: str) -> Callable[[str], Iterable[re.Match]]:
        """A function from a rule's name to its matches in the text."""
        if _ODD.search(text):
            return lambda name: self.rules[name].finditer(text)
        places: dict[str, list[int]] = {}
        n, is_word = len(text), lambda c: c.isalnum() or c == "_"
        for last, (size, names) in self.machine.iter(text.lower()) if self.any else ():
            at = last + 1 - size
            if (at and is_word(text[at - 1])) or (last + 1 < n and is_word(text[last + 1])):
                continue
            for name in names:
                places.setdefault(name, []).append(at)
        signs = [m.start() for m in _SIGN.finditer(text)] if self.money else []
        digits = [at for m in _DIGITS.finditer(text) if not (at := m.start()) or not is_word(text[at - 1])] if self.digits else []
        for name in self.digits:
            more = digits + signs if name == "money" else digits
            if more:
                places[name] = sorted(places.get(name, []) + more)

        def find(name: str) -> list[re.Match]:
            match, end, out = self.rules[name].match, 0, []
            for at in places.get(name, ()):
                if at >= end and (m := match(text, at)):
                    out.append(m)
                    end = m.end()
            return out

        return find


_TIMES = ("relative", "next_day", "day", "next_unit", "in", "ago", "date", "month", "iso", "slashed", "year")
#: The rules that a dimension's results come from.
_RULES_OF = {"time": _TIMES, "duration": ("duration",), "time-grain": ("grain",), "number": ("number",), "ordinal": ("ordinal",), "amount-of-money": ("money",)} | {d: ("measure",) for d in _MEASURES}
_CACHE: dict[tuple[str, frozenset[str]], _Finder] = {}


def parse(text: str, dims: set[str], language: str, ref: datetime) -> list[dict]:
    """Results of the wanted dimensions in text order: none inside another, and within a dimension no overlaps (longest first)."""
    lang = language_of(language)
    key = (lang, frozenset(dims))
    if key not in _CACHE:
        _CACHE[key] = _Finder(*key)
    find = _CACHE[key].matches(text)
    out: list[dict] = []

    def unit(word: str) -> str:
        low = word.lower()
        return _UNITS[lang].get(low) or _UNITS[lang].get(low.removesuffix("s")) or _UNITS[lang][low.removesuffix("es")]

    def add(m: re.Match, dim: str, value: dict) -> None:
        out.append({"start": m.start(), "end": m.end(), "body": m.group(), "dim": dim, "value": value})

    def when(m: re.Match, t: datetime, grain: str) -> None:
        add(m, "time", {"type": "value", "value": iso(_floor(t, grain)), "grain": grain})

    if "time" in dims:
        for m in find("relative"):
            when(m, ref + timedelta(days=_RELATIVE[lang][m["word"].lower()]), "day")
        for name in ("next_day", "day"):
            for m in find(name):
                ahead = (_DAYS[lang].index(m["day"].lower()) - ref.weekday()) % 7 or 7
                back = name == "next_day" and re.fullmatch(_LAST[lang], m["which"], re.I)
                when(m, ref + timedelta(days=ahead - (7 if back else 0) if not back or ahead < 7 else -7), "day")
        for m in find("next_unit"):
            g = unit(m["unit"])
            when(m, _shift(ref, -1 if re.fullmatch(_LAST[lang], m["which"], re.I) else 1, g), g)
        for name, sign in (("in", 1), ("ago", -1)):
            for m in find(name):
                n, g = _number(m["n"], lang), unit(m["unit"])
                if isinstance(n, int) and n < 10_000:
                    when(m, _shift(ref, sign * n, g), g)
        for name in ("date", "month", "iso", "slashed", "year"):
            for m in find(name):
                got = m.groupdict()
                month = _MONTHS[lang].index(got["month"].lower()) + 1 if got.get("month") else int(got.get("m") or 1)
                grain = "day" if got.get("d") else "month" if got.get("month") else "year"
                try:
                    t = datetime(int(got["y"]) if got.get("y") else ref.year, month, int(got.get("d") or 1), tzinfo=ref.tzinfo)
                except ValueError:
                    continue
                if not got.get("y") and t < _floor(ref, "day"):
                    t = _shift(t, 1, "year")
                when(m, t, grain)
    if "duration" in dims:
        for m in find("duration"):
            n, g = _number(m["n"], lang), unit(m["unit"])
            add(m, "duration", {"type": "value", "value": n, "unit": g, g: n})
    if "time-grain" in dims:
        for m in find("grain"):
            add(m, "time-grain", {"type": "value", "value": unit(m["unit"]), "grain": unit(m["unit"])})
    if "number" in dims:
        for m in find("number"):
            add(m, "number", {"type": "value", "value": _number(m["n"], lang)})
    if "ordinal" in dims:
        for m in find("ordinal"):
            o = m["o"]
            add(m, "ordinal", {"type": "value", "value": _ORDINALS[lang][o.lower()] if o else int(m["k"])})
    if "amount-of-money" in dims:
        for m in find("money"):
            add(m, "amount-of-money", {"type": "value", "value": _number(m["n"] or m["n2"], lang), "unit": _MONEY[(m["c"] or m["c2"]).lower()]})
    measures = list(find("measure")) if not dims.isdisjoint(_MEASURES) else []
    for dim, table in _MEASURES.items():
        if dim in dims:
            for m in measures:
                u = m["u"].lower()
                if u not in table:
                    continue
                value = {"type": "value", "value": _number(m["n"], lang), "unit": table[u]}
                if dim == "quantity" and m["product"]:
                    value["product"] = m["product"]
                    add(m, dim, value)
                else:
                    end = m.end("u")
                    out.append({"start": m.start(), "end": end, "body": text[m.start() : end], "dim": dim, "value": value})
    kept: list[dict] = []
    taken: dict[str, tuple[list[int], list[int]]] = {}  # by dimension, starts and ends in text order: they don't overlap
    for r in sorted(out, key=lambda r: r["start"] - r["end"]):
        start, end = r["start"], r["end"]
        for dim, (starts, ends) in taken.items():
            at = bisect_left(starts, end) - 1  # the last that begins before the end
            if at >= 0 and ends[at] > start and dim == r["dim"]:
                break
            at = bisect_right(starts, start) - 1  # the only one that can hold it
            if at >= 0 and end <= ends[at] and (starts[at], ends[at]) != (start, end):
                break
        else:
            kept.append(r)
            starts, ends = taken.setdefault(r["dim"], ([], []))
            at = bisect_left(starts, start)
            starts.insert(at, start)
            ends.insert(at, end)
    return sorted(kept, key=lambda r: (r["start"], r["end"], r["dim"]))


def reference_time(ref: str | None, timezone: str) -> datetime:
    """An ISO time (its own offset, or else in ``timezone``); now if there is none."""
    zone = ZoneInfo(timezone)
    if ref is None:
        return datetime.now(zone).replace(microsecond=0)
    t = datetime.fromisoformat(ref)
    return t.astimezone(zone) if t.tzinfo else t.replace(tzinfo=zone)
