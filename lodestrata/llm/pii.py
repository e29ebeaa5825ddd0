r"""Personal information in free text: e-mail addresses, phone and identity numbers, street addresses and names.

Method: anchor expansion. One Aho-Corasick pass over the lower-case text finds anchors: at-signs and their spelled
forms, words before identity numbers, opening brackets, digits, street words, titles, and the parts of personal names.
From each anchor a small deterministic parser expands to both sides and validates what it finds: a digit that no number
before it took to a group of digits, which is a phone number if the numbering plans of the countries at hand allow it, a
bracket to an identity number in it. To the left an address is sought in ``LOCAL`` characters, more than the 64 that a
local part may have, and the number and first words of a street in ``AHEAD``.

Names are known by a lexicon that is learned here from all mail headers of the corpus (``From``, ``To`` and the like):
first names and parts of surnames seen at least ``LEAST`` times. A title makes a name of any capitalised word after it.

Text may be wrapped and quoted: white space within an item may hold a line end, quote marks and soft breaks.

Scale: one map over the texts without a shuffle; only the narrow spans are made distinct. The lexicon is the only thing
that is broadcast. It is a vocabulary, which grows far slower than the corpus; more than ``MOST`` parts are an error.

Defined results: null and empty texts give no span; replayed records count once; spans don't overlap, and of those that
would the kind that comes first in ``KINDS`` is kept. start_char counts code points from 0.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL = 90
AHEAD = 120
KINDS = ("email", "identity", "address", "phone", "name")
LEAST = 2
MOST = 2_000_000

#: What stands for an at-sign and a dot.
AT = ("@", "＠", "(at)", "[at]", "{at}")
DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|punto|point)\s?[\])}]\s?)"
#: Words before identity numbers, street words, titles, particles.
IDENTITY = ("number", "no.", "nummer", "nr.", "passport", "ausweis", "ausweisnummer", "personalausweis", "steuer-id", "pièce", "identité", "documento", "documento n.º", "dni", "nie", "nif", "nir", "pasaporte", "gave", "gab", "ssn", "número", "numéro")
STREET = ("street", "road", "lane", "avenue", "terrace", "bank", "hill", "close", "drive", "court", "square", "gardens", "crescent", "row", "way", "place", "grove", "mews", "yard", "walk", "rise", "view", "quay", "wharf", "green", "park road")
RUE = ("rue", "boulevard", "avenue", "allée", "impasse", "place", "quai", "chemin", "cours", "passage", "square", "route", "sentier", "ruelle")
CALLE = ("calle", "camino", "plaza", "avenida", "paseo", "ronda", "travesía", "cuesta", "callejón", "glorieta", "carretera", "rambla", "pasaje")
STRASSE = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ufer", "damm", "ring", "hof", "markt", "steig", "pfad", "wall", "grund", "kamp", "speicher", "graben", "chaussee", "winkel", "stieg")
TITLES = ("ms", "mr", "mrs", "miss", "dr", "dr.", "mr.", "ms.", "mrs.", "herr", "herrn", "frau", "madame", "monsieur", "mme", "mlle", "señor", "señora", "sr.", "sra.", "don", "doña")
PARTICLES = r"(?:v[ao]n|de[nrlms]?|la|las|los|da|do|dos|di|du|le|ten|ter|zu|zum|zur|St\.|Mc|Mac)"

_SP = r"(?:[ \t\xa0]|(?:=20)?=?\r?\n(?:[ \t>|]|(?<![^\W_])[A-ZÀ-Þ]\w{0,2}>)*)"
_GAP = _SP + "+"
_S = rf"(?:[.\-]|{_SP})?"
_ID = re.compile(
    "(?:%s)(?![A-Za-z0-9])"
    % "|".join(
        (
            rf"\d{_S}\d\d{_S}\d\d{_S}\d\d{_S}\d{{3}}{_S}\d{{3}}{_S}\d\d",
            rf"\d\d{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}",
            rf"\d{{3}}{_S}\d\d{_S}\d{{4}}",
            rf"[A-Z]{{2}}{_S}\d\d{_S}\d\d{_S}\d\d{_S}[A-Z]",
            r"[A-Z]{2}\d{6}[A-Z]\d",
            r"[A-Z]{2}\d{7}",
            r"[A-Z]\d\d[A-Z]\d{4}[A-Z]\d",
            r"(?=[A-Z0-9]*[A-Z])[A-Z0-9]{9,10}(?<=\d)",
            r"\d\d[A-Z]{2}\d{5}",
            rf"[XYZ]{_S}\d{{7}}{_S}[A-Z]",
            rf"\d\d\.?\d{{3}}\.?\d{{3}}{_S}[A-Z]",
        )
    )
)
_BRACKET = re.compile(r"\((?=[A-Z]{0,3}\d|[A-Z]{2} \d)")
_DIGITS = re.compile(rf"(?<![\w@.])(?<!\d[-/])[+(]{{0,2}}\d(?:(?:[ \xa0.()/\-]|{_SP}){{0,4}}\d){{6,17}}(?![\w@])(?!-\w)")
_WRAP = re.compile(r"(?:\r?\n(?:[ \t>|]|[A-ZÀ-Þ]\w{0,2}>)*)+")
_NANP = re.compile(r"(?:\+?1[ .\-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}|(?:\+?1[ .\-]?)?[2-9]\d{9}")
_PLANS = re.compile(
    r"(?:\+|00)[ ]?(?:44[ ]?(?:\(0\))?[ ]?\d{2,4}[ \-]?\d{3,4}[ \-]?\d{3,4}|33[ .]?(?:\(0\))?[ .]?[1-9](?:[ .\-]?\d\d){4}|49[ ]?(?:\(0\))?[ ]?\d{2,5}[ /\-]?\d{2,8}(?:[ \-]?\d{1,5}){0,3}|34[ ]?[6-9]\d\d(?:[ .\-]?\d\d\d){2}|[1-9]\d{0,2}[ .\-]?(?:\(0\))?(?:[ .\-/]?\d{2,5}){2,5})"
    r"|0[1-9](?:[ .\-]?\d\d){4}"
    r"|0\d{1,4}[ /\-]\d{2,5}(?:[ \-]?\d{1,5}){0,3}"
    r"|0\d{9,10}"
    r"|[6789]\d\d([ .\-]?)\d\d\d\1\d\d\d"
)
_LOCAL = re.compile(r"[A-Za-z0-9À-ÿ_%+'\-](?:[A-Za-z0-9À-ÿ._%+'\-]*[A-Za-z0-9À-ÿ_%+\-])?$")
_DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{DOT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+")
_NUMBER_BEFORE = re.compile(rf"(?:(?:Flat|Apartment|Apt\.?|Suite|Unit){_GAP}\d+[a-z]?,?{_GAP})?(?<![\w.,/-])\d{{1,4}}[ ]?[a-d]?{_GAP}(?:[A-ZÀ-Þ][\w'’.\-]*{_GAP}){{1,3}}$")
_RUE_BEFORE = re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?:[ ]?(?:bis|ter|quater|[a-d]))?,?{_GAP}$")
_CALLE_AFTER = re.compile(rf"(?:{_GAP}[\w'’.\-]+){{1,5}}?,?{_GAP}(?:n\.?º{_SP}*)?\d{{1,4}}\b")
_NUMBER_AFTER = re.compile(rf"\.?(?:[ ]+|(?<=[.\w]){_GAP})\d{{1,4}}[ ]?[a-d]?(?![\w%€])")
_STRASSE_BEFORE = re.compile(rf"(?:(?:Am|An{_GAP}de[rmn]|Im|In{_GAP}de[rmn]|Zum|Zur|Auf{_GAP}de[rmn]|Unter{_GAP}de[rmn]|Hinter{_GAP}de[rmn]|Alte[rsn]?|Neue[rsn]?|Große[rsn]?|Kleine[rsn]?|Obere[rsn]?|Untere[rsn]?|Hohe[rsn]?){_GAP}(?:[A-ZÄÖÜ][\wäöüß]+{_GAP})?)?[A-ZÄÖÜ]?[\wäöüß\-]*$")
_PLACE = r"[A-ZÀ-Þ](?:[^\W\d_]|['’\-])+"
_TOWN = re.compile(rf"(?:,{_SP}*\d\.?[ºª°]?[ ]*[A-Z]?\b(?=,))?(?:,{_SP}*(?:(?:[A-Z]-)?\d{{5}}{_GAP})?{_PLACE}(?:[ ]+(?:del|de|la|am|an|der|{_PLACE})){{0,3}}(?<![ ])(?![\w]))?(?:[ ]+[A-Z]{{1,2}}\d\w?[ ]+\d[A-Z]{{2}}\b)?")
_BETWEEN = re.compile(rf"(?:{_GAP}(?:[A-ZÀ-Þ]\.|{PARTICLES}|{PARTICLES.upper()}))*{_GAP}$|-$")
_LEFT = re.compile(rf"(?:(?<![\w.'’-])(?:[A-ZÀ-Þ]\.|{PARTICLES}|{PARTICLES.upper()}){_GAP})+$")
_HYPHEN_LEFT = re.compile(r"(?<![\w])(?:[A-ZÀ-Þ]['’])?[A-ZÀ-Þ][\w'’]*-$")
_PREFIX = re.compile(r"(?<![\w])(?:[OoDdLl]['’]|Mc|Mac|Al-|el-)$")
_WORD_RIGHT = re.compile(r"(?:-[A-ZÀ-Þ][\w'’]*)*")
_SURNAME_AFTER = re.compile(rf"(?:{_SP}*)((?:(?:[A-ZÀ-Þ]\.|{PARTICLES}){_GAP})*(?:[A-ZÀ-Þ]['’])?[A-ZÀ-Þ][\w'’]+(?:-[A-ZÀ-Þ][\w'’]*)*)")
_COMPANY = re.compile(r"(?:[ ](?:&|and|und|et|y)[ ](?:Sons|Co\b|Partners?|Söhne|Fils|Hijos|Associates|Brothers|Cie)|,?[ ](?:Ltd|Inc|GmbH|AG|KG|SARL|SAS|SA|S\.A\.|S\.L\.|LLC|LLP|Group|Holdings?|Logistics|Industries|Consulting|Services|Foundation|Institute)\b|[ ](?:Street|Road|Lane|Avenue|Terrace|Hill|Close|Park|House|Tower|Square|Bridge|Building|Hall|Centre|Center|Valley|Bay|Works|Yard|Mill|Wharf)\b|-?(?:straße|weg|gasse|platz)\b)")
_BEFORE_NOT = re.compile(r"(?:\b(?:Project|Projekt|Projet|Proyecto|Operation|Room|Hall|Raum|Salle|Sala|rue|Rue|calle|Calle|Plaza|plaza|avenue|Saint|San|Santa|Sankt|Programme|Program|Port|Fort|Lake|Mount)(?:\s(?:de|del|des|du|la|l'))?\s)$")


@functools.cache
def _cues() -> list[tuple[str, str]]:
    out = [(w, "@") for w in AT] + [(str(i), "d") for i in range(10)] + [("(", "b")]
    for words, kind in ((IDENTITY, "i"), (STREET, "e"), (RUE, "r"), (CALLE, "c"), (STRASSE, "g"), (TITLES, "t")):
        out += [(w, kind) for w in words]
    return out


def automaton(names: dict[str, str]):
    """Of all cues, and of the name parts (lower case -> f, s or fs)."""
    import ahocorasick

    kinds: dict[str, str] = {}
    for w, k in _cues():
        kinds[w] = kinds.get(w, "") + k
    for w, k in names.items():
        kinds[w] = kinds.get(w, "") + ("N" if k == "s" else "F" if k == "f" else "FN")
    a = ahocorasick.Automaton()
    for w, k in kinds.items():
        a.add_word(w, (len(w), k))
    a.make_automaton()
    return a


def _lower(t: str) -> str:
    low = t.lower()
    return low if len(low) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)


def _is_phone(raw: str) -> bool:
    v = _WRAP.sub(" ", raw)
    v = re.sub(r"[ \xa0]+", " ", v).strip()
    n = sum(c.isdigit() for c in v)
    if v.startswith("(") and not re.match(r"\(\d{2,5}\)", v):
        v = v[1:]
    return 9 <= n <= 15 and bool(_NANP.fullmatch(v) or _PLANS.fullmatch(v) or re.fullmatch(r"\(0\d{1,4}\) ?\d{2,5}(?:[ \-]?\d{1,5}){0,3}", v))


def _phones(t: str, s: int, e: int) -> list[tuple[int, int, str]]:
    """The phone numbers of a group of digits, which may run over line ends into other numbers."""
    bounds = [s, *(m.end() for m in _WRAP.finditer(t, s, e)), e]
    out, i = [], 0
    while i + 1 < len(bounds):
        for j in range(i + 1, len(bounds)):
            raw = t[bounds[i] : bounds[j]]
            raw = _WRAP.sub("", raw) if j == i + 1 else raw
            if _is_phone(raw):
                at = bounds[i] + (raw[0] == "(" and ")" not in raw)
                out.append((at, bounds[i] + len(raw.rstrip()), "phone"))
                i = j
                break
        else:
            i += 1
    return out


def _digits_at(t: str, p: int, after: int) -> re.Match | None:
    """The group of digits that begins with the digit at ``p`` and what may stand before it, not before ``after``."""
    s = p
    while s > after and s > p - 2 and t[s - 1] in "+(":
        s -= 1
    for i in range(s, p + 1):
        if m := _DIGITS.match(t, i):
            return m
    return None


def _french(low: str) -> bool:
    return sum(low.count(w) for w in (" le ", " les ", " dans ", " avec ", " pour ", " sous ")) > sum(low.count(w) for w in (" el ", " los ", " con ", " para ", " por ", " the ", " der ", " die "))


def find(t: str, a) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of one text, by the automaton ``a``."""
    low = _lower(t)
    n = len(t)
    ats: list[int] = []
    ids: list[int] = []
    streets: list[tuple[int, int, str]] = []
    parts: list[tuple[int, int, str]] = []
    titles: list[tuple[int, int]] = []
    spans: list[tuple[int, int, str]] = []
    after = 0  # the end of the last group of digits
    for end, (size, kinds) in a.iter(low):
        start, end = end - size + 1, end + 1
        if kinds == "d":
            if start >= after and (m := _digits_at(t, start, after)):
                spans += _phones(t, *m.span())
                after = m.end()
            continue
        if kinds == "@":
            ats.append((start, end))
            continue
        if kinds == "b":
            m = _BRACKET.match(t, start)
            if m and (d := _ID.match(t, m.end())) and d.end() < n and t[d.end()] == ")":
                spans.append((d.start(), d.end(), "identity"))
            continue
        if end < n and low[end].isalnum():
            continue
        inside = start > 0 and low[start - 1].isalnum()
        for k in kinds:
            if k == "g":
                streets.append((start, end, k))
            elif inside:
                continue
            elif k in "FN":
                if t[start].isupper():
                    parts.append((start, end, k))
            elif k == "i":
                ids.append(end)
            elif k == "t":
                titles.append((start, end))
            else:
                streets.append((start, end, k))

    for start, end in ats:
        spelled = end - start > 1
        left = t[max(0, start - LOCAL) : start]
        left = left.rstrip(" ") if spelled else left
        m = _LOCAL.search(left)
        if not m:
            continue
        gap = 0
        while spelled and end + gap < n and t[end + gap] == " ":
            gap += 1
        d = _DOMAIN.match(t, end + gap)
        if d:
            spans.append((max(0, start - LOCAL) + m.start(), d.end(), "email"))
    for end in ids:
        m = re.compile(rf"(?:{_SP}|[:#(])*").match(t, end)
        d = _ID.match(t, m.end())
        if d and sum(c.isdigit() for c in d.group()) >= 5:
            spans.append((d.start(), d.end(), "identity"))
    for start, end, k in streets:
        at = max(0, start - AHEAD)
        if k == "e" and t[start].isupper():
            m = _NUMBER_BEFORE.search(t[at:start])
            if m:
                spans.append((at + m.start(), _TOWN.match(t, end).end(), "address"))
        elif k == "r":
            m = _RUE_BEFORE.search(t[at:start])
            if m and (name := re.compile(rf"(?:{_GAP}(?:d[eu]s?|la|l['’]|[A-ZÀ-Þ][\w'’\-]*|d['’]\w+)(?:(?<=['’])[\wÀ-ÿ\-]+)?)+").match(t, end)):
                spans.append((at + m.start(), _TOWN.match(t, name.end()).end(), "address"))
        elif k == "c" and t[start].isupper():
            m = _CALLE_AFTER.match(t, end)
            if m:
                spans.append((start, _TOWN.match(t, m.end()).end(), "address"))
        elif k == "g":
            m = _NUMBER_AFTER.match(t, end)
            if m and "\n" in m.group() and not _wrapped(t, end):
                continue
            if m and (b := _STRASSE_BEFORE.search(t[at:start])):
                s = at + b.start()
                if t[s].isupper() and (s < start or t[s - 4 : s - 1] in ("Am ", "Im ")):
                    spans.append((s, _TOWN.match(t, m.end()).end(), "address"))
    order = {k: i for i, k in enumerate(KINDS)}
    taken: list[tuple[int, int, str]] = []
    held = bytearray(n)
    for s, e, k in sorted(spans, key=lambda x: (order[x[2]], x[0], -x[1])):
        if not any(held[s:e]):
            held[s:e] = b"\1" * (e - s)
            taken.append((s, e, k))
    free = [p for p in parts if not any(held[p[0] : p[1]])]
    taken += [x for x in _names(t, low, free, titles, held) if not any(held[x[0] : x[1]])]
    return sorted(taken)


def _names(t: str, low: str, parts: list[tuple[int, int, str]], titles: list[tuple[int, int]], held: bytearray) -> list[tuple[int, int, str]]:
    known = {s: (e, k) for s, e, k in sorted(parts, key=lambda p: p[1])}
    for s, e, k in parts:
        if known[s] == (e, "N") and k == "F" or known[s] == (e, "F") and k == "N":
            known[s] = (e, "FN")
    for _, end in titles:
        m = _SURNAME_AFTER.match(t, end)
        if m and m.start(1) > end and not any(m.start(1) <= s < m.end(1) for s in known):
            word = re.search(r"[^\s]+$", m.group(1))
            known[m.start(1) + word.start()] = (m.end(1), "N")
    french: bool | None = None
    out: list[tuple[int, int, str]] = []
    cur: list | None = None  # start, end, kinds
    for s in sorted(known):
        e, k = known[s]
        if cur and s < cur[1]:
            continue
        e = _WORD_RIGHT.match(t, e).end()
        start = s
        if (m := _HYPHEN_LEFT.search(t[max(0, s - 40) : s])) or (m := _PREFIX.search(t[max(0, s - 4) : s])):
            start = s - (m.end() - m.start())
        if cur and start < cur[1]:
            start = s
        if cur:
            gap = t[cur[1] : start]
            if len(gap) < 60 and _BETWEEN.fullmatch(gap) and (gap.count("\n") == 0 or _wrapped(t, cur[1])):
                if not (cur[2][-1] == "N" and k == "F" and "\n" in gap):
                    cur = [cur[0], e, cur[2] + [k]]
                    continue
            if re.fullmatch(r",[ \t]?[ \t]?", gap) and "F" not in cur[2] and "F" in k and not _followed(t, e, known):
                cur = [cur[0], e, cur[2] + [k]]
                continue
            out.append(tuple(cur))
        cur = [start, e, [k]]
    if cur:
        out.append(tuple(cur))
    spans = []
    for s, e, kinds in out:
        at = max(0, s - 40)
        if m := _LEFT.search(t[at:s]):
            left = at + m.start()
            if re.match(r"M\.", t[left:]) and "F" not in kinds[0]:
                if french is None:
                    french = _french(low)
                if french:
                    left = left + re.match(rf"M\.{_GAP}", t[left:]).end()
            if left < s and not any(held[left:s]) and (m.group().count("\n") == 0 or _wrapped(t, left)):
                if not (t[left].islower() and "F" in kinds[0] and "N" not in kinds[0]) and not (t[left:s].strip().lower() in ("de", "du", "le", "la", "los", "las") and kinds == ["F"]):
                    s = left
        if _COMPANY.match(t, e) or _BEFORE_NOT.search(t[max(0, s - 20) : s]):
            continue
        spans.append((s, e, "name"))
    return spans


def _wrapped(t: str, at: int) -> bool:
    """Whether the line that ``at`` lies in is long enough to have been wrapped."""
    return at - (t.rfind("\n", 0, at) + 1) >= 40


def _followed(t: str, e: int, known: dict[int, tuple[int, str]]) -> bool:
    m = re.compile(rf"{_GAP}(?:(?:[A-ZÀ-Þ]\.|{PARTICLES}){_GAP})*").match(t, e)
    return bool(m) and "\n" not in m.group() and m.end() in known


def lexicon(documents: DataFrame, least: int = LEAST, most: int = MOST) -> dict[str, str]:
    """Lower-case name parts -> f (first name), s (surname) or fs, of the header lines of all mails."""
    field = r"(?m)^[>| \t]{0,12}\*?(?:From|To|Cc|Von|An|De|Para|À):\*?[ \t]*\"?([\p{L}\p{M}'’ .,\-]{3,60}?)\"?[ \t]*(?:<|\r?$)"
    x = documents.where(F.length("text_content") > 0).select(F.explode(F.regexp_extract_all("text_content", F.lit(field), F.lit(1))).alias("n"))
    x = x.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    name = F.trim("n")
    swapped = F.concat_ws(" ", F.trim(F.element_at(F.split(name, ","), -1)), F.trim(F.element_at(F.split(name, ","), 1)))
    x = x.select(F.when(name.contains(","), swapped).otherwise(name).alias("n"), "k")
    word = r"(?:\p{Lu}[\p{L}\p{M}'’.-]*)"
    x = x.where(F.col("n").rlike(rf"^{word}(?: (?:{word}|{PARTICLES}))*(?: {word})$"))
    w = F.split("n", " ")
    first = F.struct(F.element_at(w, 1).alias("w"), F.lit("f").alias("kind"))
    last = F.transform(F.split(F.element_at(w, -1), "-"), lambda y: F.struct(y.alias("w"), F.lit("s").alias("kind")))
    x = x.select(F.explode(F.concat(F.array(first), last)).alias("p"), "k").select(F.lower(F.regexp_replace("p.w", r"^\p{L}['’]", "")).alias("w"), "p.kind", "k")
    x = x.where(F.col("w").rlike(r"^\p{L}[\p{L}\p{M}'’]{2,}$")).groupBy("w", "kind").agg(F.sum("k").alias("k")).where(F.col("k") >= least)
    x = x.groupBy("w").agg(F.array_join(F.array_sort(F.collect_set("kind")), "").alias("kind"))
    rows = x.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("the lexicon of names is too large to broadcast")
    return {r["w"]: r["kind"] for r in rows}


_built: dict[int, object] = {}


def _automaton_of(held) -> object:
    """One automaton in each worker process for each broadcast lexicon."""
    if held.value_id not in _built:
        _built.clear()
        _built[held.value_id] = automaton(held.names.value)
    return _built[held.value_id]


class _Held:
    def __init__(self, spark, names: dict[str, str]):
        self.names = spark.sparkContext.broadcast(names)
        self.value_id = hash(frozenset(names.items()))


def spans(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """(tbl, record_key, start_char, end_char, kind) of ``df`` (tbl, record_key, text)."""
    held = _Held(df.sparkSession, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton_of(held)
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for tbl, key, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                for s, e, k in find(text, a):
                    for c, v in zip(cols, (tbl, key, s, e, k)):
                        c.append(v)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], ["tbl", "record_key", "start_char", "end_char", "kind"])

    rows = df.where(F.length("text") > 0).select("tbl", "record_key", "text")
    return rows.mapInArrow(run, "tbl string, record_key long, start_char long, end_char long, kind string").distinct()


def placeholder(kind: str) -> str:
    return f"[{kind.upper()}]"


def redact(text: str | None, a) -> str | None:
    """The text with each span replaced by the placeholder of its kind, the rest unchanged."""
    if not text:
        return text
    out, at = [], 0
    for s, e, k in find(text, a):
        out += [text[at:s], placeholder(k)]
        at = e
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """(tbl, record_key, text): every record once, null and empty texts as they are."""
    held = _Held(df.sparkSession, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton_of(held)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([redact(t, a) for t in b.column(2).to_pylist()], pa.string())], ["tbl", "record_key", "text"])

    return df.select("tbl", "record_key", "text").mapInArrow(run, "tbl string, record_key long, text string").dropDuplicates(["tbl", "record_key"])
