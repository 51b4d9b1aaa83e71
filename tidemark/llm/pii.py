"""Personal information in free text: finding it and putting surrogates in its place.

Detection works on whole texts: mail addresses (also spelled out), phone numbers, identity numbers
behind their labels, street addresses of four countries' forms, and person names. Names come from a
lexicon of first and last names that Spark collects from the known people and from the display
names of headers; words that are names as well as plain words count only where their surroundings
speak for a person.

Replacement gives every distinct entity a keyed surrogate of the same kind, format, script and (for
first names) gender. Surrogates are checked for collisions over the whole corpus: of two entities
with one surrogate the smaller keeps it and the other draws again, until all are distinct. Equal
entities get equal surrogates everywhere, so references stay recognisable.

Defined results: null and empty texts have no entities and stay as they are; a null record id is left
out; repeated rows give each place once; an empty table gives none; null names in the table of people
are skipped; an empty table of people leaves the names of the headers; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut, stage, table

# --- fixed values -------------------------------------------------------------------------------
#: Names that are also everyday words; alone they need a context that speaks for a person.
PLAIN_WORDS = frozenset("April August Autumn Baker Bell Bill Bishop Carter Chance Christian Cook Dale Dawn Dean Drew Faith Field Fisher Forest Frank Gene Glen Grace Grant Hall Heath Hill Holly Hope Hunter Iris Ivy Jack Jasmine Joy June King Lake Lane Lily March Mark Mason May Miles Mill Miller Norm Olive Page Park Parker Pearl Penny Pierce Pool Price Ray Rich Rob Robin Rose Ruby Sky Smith Stone Summer Taylor Violet Wade Walker Ward Will Wood Young".split())
TITLES = r"Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herrn?|Frau|M|Mme|Mlle|Monsieur|Madame|Señora?|señora?|Sra?|Don|Doña|Monsieur"
COMPANY = re.compile(r"[ \t]*(?:,[ \t]*)?(?:&[ \t]*(?:Co|Sons|Söhne|Partners?|Fils|Cie)\b|(?:AG|GmbH|KG|Ltd|Limited|LLC|Inc|Corp|PLC|plc|S\.?L\.?|S\.?A\.?|SARL|SAS|BV|Oy|AB|Trust|Labs|Freight|Studio|Group|Holdings?|Partners|Brothers|Bros|Foundation|Institute|University|Street|Road|Lane|Avenue|Court|Close|Drive|Square|Yard|Row|Quay)\b)")
STREET = r"Street|Road|Lane|Avenue|Court|Close|Drive|Square|Yard|Row|Quay|Way|Place|Terrace|Crescent|Gardens|Grove|Hill|Walk|Mews|Boulevard|Parade|Wharf|Green|Gate|Park|St\.|Rd\.|Ave\.|Ln\.|Dr\."
LABELS = (
    r"passport(?: (?:no\.?|number))?|national insurance(?: (?:no\.?|number))?|NI (?:no\.?|number)|NINO|social security(?: (?:no\.?|number))?|SSN|(?:driving|driver'?s) licen[cs]e(?: (?:no\.?|number))?|ID (?:card )?(?:no\.?|number)|identity (?:card )?(?:no\.?|number)|tax (?:ID|id|no\.?|number)"
    r"|Ausweis(?:nummer|-Nr\.?)?|Personalausweis(?:nummer)?|Reisepass(?:nummer)?|Pass(?:nummer|-Nr\.?)|Steuer-?(?:ID|Id|nummer|Identifikationsnummer|-IdNr\.?)|Führerschein(?:nummer)?|Sozialversicherungsnummer"
    r"|num[ée]ro de s[ée]curit[ée] sociale|s[ée]curit[ée] sociale|n[°º] (?:de )?s[ée]curit[ée] sociale|NIR|num[ée]ro de passeport|passeport(?: n[°º])?|carte d'identité(?: n[°º])?|permis de conduire(?: n[°º])?"
    r"|DNI|NIE|NIF|n[úu]mero de la seguridad social|pasaporte(?: n[.ºo°]+)?|permiso de conducir"
)

SPACE = r"[ \t ]"
GAP = rf"(?:{SPACE}|\n[ \t]*(?:[>|][ \t]*)*)"
#: Between the words of one name: spaces, or one line break of a wrapped line.
JOIN = rf"(?:{SPACE}+|{SPACE}*\n[ \t]*(?:[>|][ \t]*)*)"
EMAIL = re.compile(r"(?<![\w.+%-])[\w](?:[\w.+%'-]*[\w+])?@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w@])")
_PART = r"[\w+-]+"
_AT = rf"(?:{GAP}*[\[({{]{SPACE}?(?:at|AT|arroba|chez){SPACE}?[\])}}]{GAP}*|{GAP}+at{GAP}+)"
_DOT = rf"(?:{GAP}*[\[({{]{SPACE}?(?:dot|DOT|punkt|point|punto){SPACE}?[\])}}]{GAP}*|{GAP}+dot{GAP}+)"
SPELLED = re.compile(rf"(?<![\w.@+-]){_PART}(?:(?:\.|{_DOT}){_PART})*{_AT}(?:{_PART}(?:\.|{_DOT}))+[^\W\d_]{{2,}}(?![\w@])")
NUMBER = re.compile(r"(?<![\w@#/.+-])(?:\+|\(|\d)[\d()/.\-  ]*\d(?![\w@])")
EXTENSION = re.compile(rf",?{GAP}?(?:ext\.?|extension|x|Durchwahl|Dw\.?|poste|extensión){GAP}?\d{{1,5}}\b")
PHONE = re.compile(
    r"\+\d{10,14}(?!\d)|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ ./-]?\d){5,12}|00[1-9]\d{9,12}(?!\d)|00[1-9]\d{1,2} ?\d(?:[ .]?\d){6,11}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|1[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
    r"|555-\d{4}"
    r"|07\d{3} ?\d{6}|0\d{2} \d{4} \d{4}|0\d{3} \d{3} \d{4}|0\d{4} \d{5,6}"
    r"|0\d{2,4}[/-] ?\d{3,8}(?:[ -]\d{1,6})?"
    r"|0[1-9](?:[ .]\d\d){4}|[679]\d{2} \d{3} \d{3}"
)
LABELLED = re.compile(rf"(?<![\w])(?:{LABELS}){GAP}?(?:is|ist|est|es|lautet|:|=|#|no\.?|nr\.?|n\.?º)?{GAP}?(?=[A-Z0-9])", re.I)
_ID = re.compile(r"[A-ZÀ-Þ0-9](?:[A-ZÀ-Þ0-9]|[ -](?=[A-ZÀ-Þ]?\d|[A-Z]\b(?![a-z])))*")
_TOWN = r"[A-ZÀ-Þ](?:[^\W\d_]|['’-])+(?!\w)(?: [A-ZÀ-Þ](?:[^\W\d_]|['’-])+(?!\w))?"
_C = rf",{GAP}?"
_UNIT = r"(?:Unit|Flat|Suite|Apt\.?|Apartment|Floor|Room)"
ADDRESS = re.compile(
    # number before the street: unit, number, street, unit, town, postcode
    rf"(?<![\w/-])(?:{_UNIT}{GAP}\d+\w?{_C})?\d{{1,4}}[A-Za-z]?{GAP}(?:[A-ZÀ-Þ][\w'’-]+{GAP}){{1,3}}(?:{STREET})(?![\w])(?:{_C}{_UNIT}{GAP}\d+\w?)?(?:{_C}{_TOWN}(?:(?:{_C}|{GAP})[A-Z]{{1,2}}\d[\dA-Z]?{GAP}\d[A-Z]{{2}}(?!\w)|(?:{_C}|{GAP})[A-Z]{{2}}{GAP}\d{{5}}(?!\d))?)?"
    # number, bis/ter, kind of street in small letters, postcode and town
    rf"|(?<![\w/-])\d{{1,4}}(?:{GAP}?(?:bis|ter|quater))?,?{GAP}(?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|cours|route|square|passage){GAP}(?:(?:de|du|des|la|le|les|l'|d')(?:{GAP})?)*(?:[A-ZÀ-Þ][\w'’-]+(?:{GAP}|-)?){{1,4}}(?:,?{GAP}?(?:F-)?\d{{5}}{GAP}{_TOWN})?"
    # kind of street, name, number, floor and door, postcode and town
    rf"|(?<![\w])(?:Calle|C/|Avenida|Avda\.|Av\.|Plaza|Pza\.|Paseo|P\.º|Camino|Ronda|Travesía|Carrer|Glorieta){GAP}?(?:(?:de|del|la|las|los|el){GAP})*(?:[A-ZÀ-Þ][\w'’-]+{GAP}?){{1,3}},?{GAP}?(?:n\.?º{GAP}?)?\d{{1,4}}(?!\d)(?:{_C}\d{{1,2}}\.?[ºª°]{GAP}?(?:[A-Z]|\w+)?(?![\w]))?(?:{_C}(?:\d{{5}}{GAP})?{_TOWN})?"
    # street and number, postcode and town
    rf"|(?<![\w])(?:(?:Am|An der|Auf dem|Im|In der|Zum|Zur|Alte|Alter|Neue|Neuer|Unter den){GAP}(?:[A-ZÀ-Þ][\w-]+{GAP}){{1,3}}(?=\d{{1,4}}{SPACE}?[a-z]?{_C}(?:D-)?\d{{5}}{GAP}[A-ZÀ-Þ])|[A-ZÀ-Þ][\w-]*(?:straße|strasse|str\.|weg|allee|gasse|platz|damm|ufer){GAP}|(?:[A-ZÀ-Þ][\w-]+{GAP})(?:Straße|Str\.|Weg|Allee|Gasse|Platz|Ring|Damm|Ufer){GAP})\d{{1,4}}{SPACE}?[a-z]?(?![\w])(?:{_C}(?:D-)?\d{{5}}{GAP}{_TOWN})?"
)
_CAPITAL = re.compile(r"[^\W\d_][\w]*(?:[’'-][^\W\d_]\w*)*")
_INITIAL_BEFORE = re.compile(rf"(?<![\w.])(?:[A-ZÀ-Þ]\.(?:{SPACE}|-)?){{1,3}}$")
_PERSON_BEFORE = re.compile(
    rf"(?:^|[\n>|({SPACE[1:-1]}\"'])(?:Hi|Hello|Hey|Dear|Hallo|Good morning|Good afternoon|Good evening|Guten Tag|Guten Morgen|Liebe[rs]?|Bonjour|Bonsoir|Salut|Ch[eè]re?|Hola|Buenos días|Buenas tardes|Estimad[oa]|Querid[oa]|(?:{TITLES})\.?"
    r"|spoke with|talked to|[Cc]all|[Rr]ing|Both|Contact:|from|to|by|with|for|of|and|bei|von|an|mit|für|appeler|à|pour|de|avec|et|con|a|por|y|und|al|Llamad a|From:|To:|Cc:|Von:|An:|De :|À :|De:|Para:"
    rf"|(?:[Rr]egards|[Bb]est|[Cc]heers|[Tt]hanks|bye|sincerely|Grüßen?|Gruß|Cordialement|vous|bientôt|cordiales|[Ss]aludos?)[,.!]?)(?:{GAP}|\n)+$"
)
_PERSON_AFTER = re.compile(r"(?:[’']s\b| (?:signed|wrote|called|said|asked|schrieb|hat|a écrit|a signé|escribió|firmó|<)|\s*\|\s|\s*<)")
_ALONE = re.compile(r"^[ \t>|~/*–—-]*$")


class Names:
    """A lexicon of first and last names; lookups ignore case."""

    def __init__(self, first: set[str], last: set[str]):
        self.first = {x.casefold() for x in first}
        self.last = {x.casefold() for x in last if " " not in x}
        self.long: dict[str, list[tuple[str, ...]]] = {}
        for x in last:
            if len(words := tuple(x.casefold().split())) > 1:
                self.long.setdefault(words[0], []).append(words)
        self.plain = {x.casefold() for x in PLAIN_WORDS}


def _names(text: str, taken: list[tuple[int, int]], names: Names, header: bool) -> Iterator[tuple[int, int]]:
    words = [(m.start(), m.start() + len(w), w) for m in _CAPITAL.finditer(text) if (w := re.sub(r"['’][sS]$", "", m.group()))]
    blocked = iter(sorted(taken))
    at, stop = next(blocked, (len(text) + 1, 0))
    units: list[tuple[int, int, str, bool]] = []  # start, end, F or L or B, certain
    i = 0
    while i < len(words):
        a, b, w = words[i]
        while stop and a >= stop:
            at, stop = next(blocked, (len(text) + 1, 0))
        low = w.casefold()
        if (a >= at and a < stop) or b > at:
            i += 1
            continue
        for long in names.long.get(low, ()):
            got = [x[2].casefold() for x in words[i : i + len(long)]]
            if tuple(got) == long and words[i + len(long) - 1][2][0].isupper() and not re.search(r"[^\s>|]", "".join(text[words[j][1] : words[j + 1][0]] for j in range(i, i + len(long) - 1))):
                units.append((a, words[i + len(long) - 1][1], "L", True))
                i += len(long)
                break
        else:
            i += 1
            if not w[0].isupper() or (len(w) > 1 and not w[1:].islower() and not w.isupper() and "'" not in w and "’" not in w and "-" not in w):
                continue
            f, last = low in names.first, low in names.last
            if f or last:
                units.append((a, b, "B" if f and last else "F" if f else "L", low not in names.plain))
    k = 0
    while k < len(units):
        a, b, kind, sure = units[k]
        j = k + 1
        if j < len(units):
            c, d, other, _ = units[j]
            between = text[b:c]
            if kind in "FB" and other in "LB" and (units[j][3] or "\n" not in between) and re.fullmatch(rf"{JOIN}(?:(?:[A-ZÀ-Þ]\.){GAP}?){{0,2}}", between):
                b, sure, j = d, True, j + 1
                kind = "N"
            elif kind in "LB" and other in "FB" and re.fullmatch(rf",{JOIN}", between) and (sure or units[j][3] or header):
                b, sure, j = d, True, j + 1
                kind = "N"
            elif kind == "L" and other == "F" and sure and units[j][3] and re.fullmatch(rf"{SPACE}", between) and (text[a:b].isupper() or header):
                b, sure, j = d, True, j + 1
                kind = "N"
        if kind != "N" and kind in "LB" and (m := _INITIAL_BEFORE.search(text, max(0, a - 12), a)):
            a, sure = m.start(), True
        if kind == "L" and (m := re.match(rf",{SPACE}(?:[A-ZÀ-Þ]\.{SPACE}?){{1,2}}(?![\w])", text[b : b + 10])):
            b, sure = b + len(m.group().rstrip()), True
        k = j
        if COMPANY.match(text, b):
            continue
        if not sure and not header:
            line_start = text.rfind("\n", 0, a) + 1
            end = text.find("\n", b)
            rest = text[b : len(text) if end < 0 else end]
            alone = _ALONE.match(text[line_start:a]) and re.fullmatch(r"[ \t]*[,.!]?[ \t]*", rest)
            starts = _ALONE.match(text[line_start:a]) and re.match(r"[ \t]*(?:,[ \t]|,?$)", rest)
            before = _PERSON_BEFORE.search(text[max(0, a - 24) : a])
            if not (alone or starts or before or _PERSON_AFTER.match(text, b)):
                continue
        yield a, b


def find_entities(text: str, names: Names, header: bool = False) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every entity; positions count code points, the end is exclusive."""
    found: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    def add(kind: str, a: int, b: int) -> None:
        if a < b and free(a, b):
            found.append((kind, a, b))
            taken.append((a, b))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add("email", m.start(), m.end())
    if re.search(r"\b(?:at|AT|arroba|chez)\b", text):
        for m in SPELLED.finditer(text):
            if "dot" in m.group().lower() or re.search(r"[\[({]", m.group()):
                add("email", m.start(), m.end())
    if header:
        for a, b in _names(text, taken, names, True):
            add("person_name", a, b)
        return sorted(found, key=lambda x: x[1])
    for m in LABELLED.finditer(text):
        if (v := _ID.match(text, m.end())) and sum(c.isdigit() for c in v.group()) >= 4 and len(v.group().replace(" ", "")) >= 6:
            add("id_number", v.start(), v.end())
    for m in ADDRESS.finditer(text):
        if m.group().strip():
            a, b = m.start(), m.end()
            while text[b - 1] in " \t\n,>|":
                b -= 1
            add("street_address", a, b)
    for m in NUMBER.finditer(text):
        digits = sum(c.isdigit() for c in m.group())
        if digits >= 7:
            for p in PHONE.finditer(m.group()):
                a, b = m.start() + p.start(), m.start() + p.end()
                if (p.start() and m.group()[p.start() - 1] not in " (") or (p.end() < len(m.group()) and m.group()[p.end()] not in " )"):
                    continue
                if e := EXTENSION.match(text, b):
                    b = e.end()
                add("phone", a, b)
    for a, b in _names(text, taken, names, False):
        add("person_name", a, b)
    return sorted(found, key=lambda x: x[1])


def name_lexicon(people: DataFrame, headers: DataFrame) -> DataFrame:
    """(part, name) with part F or L, from known people and from display names of headers.

    Only names that the mail address beside them confirms teach the lexicon which part is which.
    """
    known = people.select(F.col("display_name").alias("d"), F.col("normalized_identifier").alias("e"))
    shown = headers.select(F.regexp_extract("sender_header", r"^\s*[\"']?([^\"'<(|@]+?)[\"']?\s*(?:\||\(|<)", 1).alias("d"), F.regexp_extract("sender_header", r"([\w.+'-]+@[\w.-]+)", 1).alias("e"))
    rows = known.unionByName(shown.where("d <> ''").distinct())
    rows = rows.where("d IS NOT NULL").select(F.trim("d").alias("d"), F.coalesce(F.lower("e"), F.lit("")).alias("e"))
    comma = F.col("d").contains(",")
    first = F.when(comma, F.trim(F.regexp_extract("d", r",\s*(.+)$", 1))).otherwise(F.regexp_extract("d", r"^(\S+)\s", 1))
    last = F.when(comma, F.trim(F.regexp_extract("d", r"^([^,]+),", 1))).otherwise(F.trim(F.regexp_extract("d", r"^\S+\s+(.+)$", 1)))
    rows = rows.select(first.alias("f"), last.alias("l"), "e")
    # single words with a letter start; first names of one word only
    good = rows.where(F.col("f").rlike(r"^[\p{Lu}][\p{L}'’-]+$") & F.col("l").rlike(r"^[\p{L}'’-]+( [\p{L}'’-]+){0,3}$") & ~F.col("f").rlike(r"^(Dr|Mr|Ms|Mrs|Prof|Frau|Herr)$"))
    plain = F.translate(F.lower(F.col("l")), "áàâäãåçéèêëíìîïñóòôöõøúùûüýł'’ -", "aaaaaaceeeeiiiinoooooouuuuyl")
    good = good.where((F.col("e") == "") | F.col("e").contains(F.substring(plain, 1, 4)))
    both = good.select(F.lit("F").alias("part"), F.col("f").alias("name")).unionByName(good.select(F.lit("L").alias("part"), F.col("l").alias("name")))
    return both.groupBy("part", F.lower("name").alias("name")).agg(F.count("*").alias("n"))


def load_names(lexicon: DataFrame, bound: int = 500_000) -> Names | None:
    """The lexicon for the tasks, or None if it has more than ``bound`` names: then it stays a table
    and :func:`detect` joins it to the words of the records."""
    lexicon = cut(lexicon)
    if lexicon.count() > bound:
        return None
    rows = lexicon.collect()
    return Names({r.name for r in rows if r.part == "F"}, {r.name for r in rows if r.part == "L"})


_FOUND = "field string, record_id string, kind string, start_pos int, end_pos int, value string"


def _entities(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 6
    types = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["field", "record_id", "kind", "start_pos", "end_pos", "value"])


def detect(records: DataFrame, names: Names | DataFrame) -> DataFrame:
    """(field, record_id, kind, start_pos, end_pos, value) over rows (field, record_id, text)."""
    if isinstance(names, DataFrame):
        return _detect_by_join(records, names)
    shared = records.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            rows = []
            for field, record, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows += [(field, record, kind, a, b, text[a:b]) for kind, a, b in find_entities(text, lexicon, field.endswith("_header"))]
            yield _entities(rows)

    return records.select("field", "record_id", "text").mapInArrow(run, _FOUND)


def _detect_by_join(records: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Detection with a lexicon of any size: each record gets the names that its words can be."""
    records = records.select("field", "record_id", "text").distinct().withColumn("uid", F.xxhash64("field", "record_id", "text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, key = [], []
            for u, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = [re.sub(r"['’]s$", "", m.group().casefold()) for m in _CAPITAL.finditer(text)]
                own = {*w, *map(" ".join, zip(w, w[1:]))}  # names of several words are found by their first two
                uid += [u] * len(own)
                key += own
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(key, pa.string())], ["uid", "key"])

    asked = records.select("uid", "text").mapInArrow(words, "uid long, key string")
    keyed = lexicon.select("part", "name", F.array_join(F.slice(F.split("name", " "), 1, 2), " ").alias("key"))
    held = asked.join(keyed, "key").groupBy("uid").agg(F.collect_set(F.struct("part", "name")).alias("names"))  # bounded by the words of a text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for field, record, text, known in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = Names({n["name"] for n in known or () if n["part"] == "F"}, {n["name"] for n in known or () if n["part"] == "L"})
                rows += [(field, record, kind, a, b, text[a:b]) for kind, a, b in find_entities(text, own, field.endswith("_header"))]
            yield _entities(rows)

    return records.join(held, "uid", "left").select("field", "record_id", "text", "names").mapInArrow(run, _FOUND)


def project_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, record_id, text) of the three fields; rows repeat as in the tables."""
    mail, chunks = table(spark, sf_dir, "email_messages"), table(spark, sf_dir, "chunks")
    rows = [
        mail.select(F.lit("text").alias("field"), F.col("message_id").alias("record_id"), "text"),
        mail.select(F.lit("sender_header").alias("field"), F.col("message_id").alias("record_id"), F.col("sender_header").alias("text")),
        chunks.select(F.lit("content").alias("field"), F.col("chunk_id").alias("record_id"), F.col("content").alias("text")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).where("record_id IS NOT NULL AND text <> ''")


def project_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(name_lexicon(table(spark, sf_dir, "people"), table(spark, sf_dir, "email_messages")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of personal information in mails, sender headers and chunks."""
    lexicon = project_lexicon(spark, sf_dir)
    found = detect(project_records(spark, sf_dir), load_names(lexicon) or lexicon)
    return found.select("field", "record_id", "kind", "start_pos", "end_pos").distinct()


# --- surrogates ---------------------------------------------------------------------------------
_SYLLABLES = ("bra", "del", "fen", "gar", "hol", "kes", "lin", "mor", "nar", "pel", "ros", "sil", "tor", "vel", "wen", "zor")
_FEMALE, _MALE = ("a", "ine", "ys", "ette"), ("o", "rik", "an", "us")
_ENDS = ("berg", "dale", "feld", "ford", "garde", "holm", "lund", "mont", "quist", "stad", "vik", "wick")


def _bytes(key: bytes, *parts: object) -> Iterator[int]:
    """An endless keyed stream of small numbers."""
    block = 0
    while True:
        yield from hmac.new(key, "\x1f".join(map(str, (*parts, block))).encode(), hashlib.sha256).digest()
        block += 1


def _female(first: str) -> bool:
    """The usual ending of female first names; only the surrogate's choice depends on it."""
    return first.casefold()[-1:] in "aeiyë" and first.casefold()[-2:] not in ("fi", "ri", "di", "ki", "mi")


def canonical(kind: str, value: str) -> str:
    """What makes two mentions the same entity: case, wraps and spelled-out signs do not."""
    v = re.sub(r"[\s>|]+", " ", value).strip()
    if kind == "email":
        v = re.sub(r" ?[\[({]?\b(?:at|arroba|chez)\b[\])}]? ?", "@", v, count=1) if "@" not in v else v
        return re.sub(r" ?[\[({]?\b(?:dot|punkt|punto)\b[\])}]? ?", ".", v).casefold().replace(" ", "")
    if kind in ("phone", "id_number"):
        return re.sub(r"[^\w+]", "", v).casefold()
    if kind == "person_name" and "," in v:
        last, first = v.split(",", 1)
        v = f"{first.strip()} {last.strip()}"
    return v.casefold()


#: Words of addresses that say what kind of place it is; they stay (fixed values).
_KINDS = frozenset(f"{STREET}|rue|avenue|boulevard|chemin|impasse|allée|quai|cours|route|passage|calle|avenida|avda|plaza|paseo|camino|ronda|straße|str|weg|allee|gasse|platz|ring|unit|flat|suite|apt|apartment|floor|room|bis|ter".casefold().replace(".", "").split("|"))


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """A stand-in of the same kind and format, drawn from the keyed stream of the entity; kinds F and L
    are a first and a last name by themselves."""
    draw = _bytes(key, kind, value, attempt)
    pick = lambda seq: seq[next(draw) % len(seq)]
    if kind == "F":
        return (pick(_SYLLABLES) + pick(_SYLLABLES) + pick(_SYLLABLES) + pick(_FEMALE if _female(value) else _MALE)).capitalize()
    if kind == "L":
        return (pick(_SYLLABLES) + pick(_SYLLABLES) + pick(_ENDS)).capitalize()
    if kind == "email":
        return "".join(pick(_SYLLABLES) for _ in range(3)) + f"{next(draw):02x}@" + pick(_SYLLABLES) + pick(_ENDS) + ".example"

    def sign(c: str) -> str:
        return str(next(draw) % 10) if c.isdigit() else chr(97 + next(draw) % 26) if c.isalpha() else c

    if kind == "street_address":
        def word(m: re.Match) -> str:
            w = m.group()
            if any(map(str.isdigit, w)) or len(w) == 1:
                return "".join(map(sign, w))
            return w if w in _KINDS else pick(_SYLLABLES) if len(w) < 4 else pick(_SYLLABLES) + pick(_ENDS)

        return re.sub(r"[^\W_]+", word, value)
    return "".join(map(sign, value)) if kind == "id_number" else "".join(sign(c) if c.isdigit() else c for c in value)


def initial(letter: str, key: bytes) -> str:
    """Initials are exchanged by a keyed shift, so different ones stay different."""
    at = "abcdefghijklmnopqrstuvwxyz".find(letter)
    return chr(97 + (at + 1 + next(_bytes(key, "initial")) % 25) % 26) if at >= 0 else letter


def name_parts(name: str) -> list[tuple[str, str]]:
    """(role, word) of a canonical name: F first, L last, I initial, ? a single word."""
    words = name.split()
    lone = [w for w in words if not (len(w) == 2 and w[1] == ".")]
    out = [("I", w[0]) for w in words[: len(words) - len(lone)]] if words[:1] != lone[:1] else []
    if len(lone) == 1 and not out:
        return [("?" if len(words) == 1 else "L", lone[0])] + [("I", w[0]) for w in words if w not in lone]
    if not out:
        out = [("F", lone[0]), *(("I", w[0]) for w in words if w not in lone)]
        lone = lone[1:]
    return [*out, ("L", " ".join(lone))] if lone else out


def _like_case(model: str, word: str) -> str:
    return word.upper() if model.isupper() and len(model) > 1 else word.capitalize() if model[:1].isupper() else word.lower()


def fit(kind: str, value: str, stand_in: str) -> str:
    """The stand-in in the shape of this mention: capitals, order of names, spelled-out signs, script."""
    if kind == "person_name":
        if "," in value and " " in stand_in:
            first, last = stand_in.split(" ", 1)
            stand_in = f"{last}, {first}"
        letters = [c for c in value if c.isalpha()]
        for low, high in (("α", "ω"), ("а", "я")):  # Greek and Cyrillic mentions stay in their script
            if letters and all(low <= c.lower() <= high for c in letters):
                span = ord(high) - ord(low) + 1
                stand_in = "".join((chr(ord(low) + ord(c.lower()) * 7 % span).upper() if c.isupper() else chr(ord(low) + ord(c) * 7 % span)) if c.isalpha() else c for c in stand_in)
        return stand_in.upper() if len(value) > 2 and value.isupper() else stand_in
    if kind in ("phone", "id_number"):
        drawn = iter([c for c in stand_in if c.isalnum()])
        return "".join((next(drawn, c).upper() if c.isupper() else next(drawn, c)) if c.isalnum() else c for c in value)
    if kind == "street_address":
        drawn = iter(re.findall(r"[^\W_]+", stand_in))

        def put(m: re.Match) -> str:
            own, new = m.group(), next(drawn, "")
            return "".join(n.upper() if o.isupper() else n for o, n in zip(own, new)) if any(map(str.isdigit, own)) else _like_case(own, new)

        return re.sub(r"[^\W_]+", put, value)
    if kind == "email" and "@" not in value:
        return stand_in.replace("@", " [at] " if "[" in value else " at ").replace(".", " dot " if " dot " in value.lower() else ".")
    return stand_in


def assign_surrogates(found: DataFrame, key: bytes, lexicon: DataFrame | None = None, rounds: int = 40) -> DataFrame:
    """(kind, entity, surrogate): one surrogate per distinct entity, all distinct within their kind.

    Names get theirs part by part, so a first or a last name alone stays linked to the full name;
    ``lexicon`` says which of the two a single word is. What shares a surrogate is found by one window
    over the surrogates: all but the smallest draw again, as does what was given a real entity's
    value, until none is left. Numbers too short to stay distinct get a digit more.
    """

    def entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([canonical(k, v) for k, v in zip(kinds, values)], pa.string())], ["kind", "entity"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            rows = [(e, n, role, word) for e, last in names for n, (role, word) in enumerate([("L", e)] if last else name_parts(e))]
            c = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.string(), pa.int32(), pa.string(), pa.string()))], ["entity", "n", "role", "word"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
            drawn = [initial(e, key).upper() + "." if k == "I" else surrogate(k, e, key, n) for k, e, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(drawn, pa.string())], ["kind", "entity", "attempt", "surrogate"])

    every = cut(found.select("kind", "value").distinct().mapInArrow(entities, "kind string, entity string").distinct())
    person = every.where("kind = 'person_name'").select("entity", F.lit(False).alias("last"))
    if lexicon is not None:  # last names by themselves, of one word or more
        role = lexicon.groupBy(F.col("name").alias("entity")).agg((F.min("part") == "L").alias("known"))
        person = person.join(role, "entity", "left").select("entity", F.coalesce("known", F.lit(False)).alias("last"))
    part = person.mapInArrow(parts, "entity string, n int, role string, word string")
    part = cut(part.select("entity", "n", F.when(F.col("role") == "?", "F").otherwise(F.col("role")).alias("role"), "word"))
    shape = "kind string, entity string, attempt int, surrogate string"
    now = every.where("kind <> 'person_name'").unionByName(part.select(F.col("role").alias("kind"), F.col("word").alias("entity")).distinct()).withColumn("attempt", F.lit(0))
    real = now.where("kind <> 'I'").select("kind", F.col("entity").alias("low"), F.lit(True).alias("real"))
    if lexicon is not None:
        real = real.unionByName(lexicon.select(F.col("part").alias("kind"), F.col("name").alias("low"), F.lit(True).alias("real"))).distinct()
    real = cut(real)
    for _ in range(rounds):
        now = now.select("kind", "entity", "attempt").mapInArrow(draw, shape).withColumn("low", F.lower("surrogate")).join(real, ["kind", "low"], "left")
        place = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("entity"))
        now = cut(now.withColumn("n", F.when(F.col("kind") == "I", 1).otherwise(place + F.coalesce(F.col("real").cast("int"), F.lit(0)))).drop("low", "real"))
        if now.where("n > 1").isEmpty():
            break
        now = now.withColumn("attempt", F.col("attempt") + F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0))
    now = now.select("kind", "entity", F.when(F.col("n") > 1, F.concat("surrogate", F.col("n").cast("string"))).otherwise(F.col("surrogate")).alias("surrogate"))
    words = now.select(F.col("kind").alias("role"), F.col("entity").alias("word"), "surrogate")
    whole = part.join(words, ["role", "word"]).groupBy("entity").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "surrogate"))), lambda x: x["surrogate"]), " ").alias("surrogate"))
    return now.where("kind NOT IN ('F', 'L', 'I')").unionByName(whole.select(F.lit("person_name").alias("kind"), "entity", "surrogate"))


def replace(records: DataFrame, names: Names | DataFrame, key: bytes, lexicon: DataFrame | None = None) -> DataFrame:
    """(field, record_id, replaced) of records with entities: each entity as ``[kind: surrogate]``."""
    found = stage(detect(records, names), "entities")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entity = [canonical(k, v) for k, v in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(entity, pa.string())], ["field", "record_id", "kind", "start_pos", "end_pos", "entity"])

    places = found.mapInArrow(keyed, "field string, record_id string, kind string, start_pos int, end_pos int, entity string")
    places = places.join(assign_surrogates(found, key, lexicon), ["kind", "entity"])
    texts = records.select("field", "record_id", "text", F.xxhash64("text").alias("h"))
    # entities of one record are few; a record is identified by its text too, as rows repeat
    per_record = places.distinct().groupBy("field", "record_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "kind", "surrogate"))).alias("places"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spots in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                parts, at = [], 0
                for s in spots:
                    if s["start_pos"] >= at and s["end_pos"] <= len(text):
                        parts += [text[at : s["start_pos"]], f"[{s['kind']}: {fit(s['kind'], text[s['start_pos'] : s['end_pos']], s['surrogate'])}]"]
                        at = s["end_pos"]
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["field", "record_id", "replaced"])

    one = texts.groupBy("field", "record_id", "h").agg(F.first("text").alias("text"))
    return one.join(per_record, ["field", "record_id"]).select("field", "record_id", "text", "places").mapInArrow(put, "field string, record_id string, replaced string")


def p6_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with a typed surrogate in place of every entity; the key is the session's setting
    ``spark.tidemark.surrogateKey``."""
    lexicon = project_lexicon(spark, sf_dir)
    key = spark.conf.get("spark.tidemark.surrogateKey", "a key for tests only")
    return replace(project_records(spark, sf_dir), load_names(lexicon) or lexicon, key.encode(), lexicon)
