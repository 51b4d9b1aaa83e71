"""The lines of an email that its sender newly wrote.

1. Every sentence of every message (quote marks taken off, wrapped lines joined) gets a SimHash over
   its words and letter groups. Eight tables of eight bits bring together sentences of one
   conversation whose hashes differ in at most seven bits; the edit distance (a fifth of the length;
   other numbers make another sentence) confirms them. A sentence whose wording an earlier message
   of the conversation has, or an earlier message from one of its addressees in any conversation,
   is inherited. Sentences of under 25 characters, and phrases of several conversations, count only
   beside an inherited one.
2. Lines get fingerprints too, the sender's own name left out. A wording is boilerplate if it ends
   messages wherever it stands: in ``common`` or more conversations of all senders, or in two or more
   conversations and a fifth of those of one sender, below the first line and with nothing newly
   worded below it in nine of ten places. Lines within three bits and a tenth of the length of boilerplate are boilerplate as well.
3. Inherited lines are not new. From the end of the message (or of the part before a quotation) up,
   boilerplate, the sender's name and lines of bare facts are signature. Closing formulas of four
   languages are a fallback for wordings the corpus is too small to know; marks, introductions and
   header blocks of mail programs show quotations whose source is not among the messages.

Defined results: null, empty and blank texts have no new lines; of several rows of one message the
one fetched last counts (null first, then the longest text); a null message id is left out; null
conversations are one of their own; null headers only mean that the sender's name is unknown; the
flags of earlier passes are not read; an empty table gives an empty result; very long texts are
read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stage, table

MARK = re.compile(r"^\s*[>|]")
MARKS = re.compile(r"^(?:\s*[>|])+ ?")

# --- fixed values: how mail programs introduce quotations -------------------------------------
_WHEN = r"(?:\d{4}-\d\d?-\d\d?|\d\d?[./]\d\d?[./]\d{2,4}|\d\d?\.? [^\W\d_]{3,12}\.? \d{4}|[^\W\d_]{3,12} \d\d?,? \d{4})"
_AT = r",?(?: (?:at|um|à|a las))? \d\d?[:.h]\d\d(?::\d\d)?(?: ?[AP]M)?"
_STAMP = rf"(?:[^\W\d_]{{2,10}}\.?,? )?{_WHEN}{_AT}(?: (?:GMT|UTC)?[+-]\d\d:?\d\d)?"
INTRO = re.compile(
    rf"^\s*\W{{0,2}}(?:(?:On|Am|Le|El) {_STAMP}.* ?(?:wrote|schrieb|a écrit|escribió)\b.*:"
    rf"|.*\b(?:wrote on|schrieb am|a écrit le|escribió el) {_STAMP} ?:"
    rf"|(?:In reply to|Als Antwort auf|En réponse à|En respuesta a) .*{_STAMP} ?:"
    rf"|{_STAMP} .*(?:@|\b[A-ZÀ-Þ]).*:)\s*$"
)
RULE = re.compile(
    r"^\s*(?:-{2,}\s*(?:Original [Mm]essage|Forwarded [Mm]essage|Ursprüngliche Nachricht|Weitergeleitete Nachricht|Originalnachricht|Message d'origine|Message original|Message transféré|Mensaje original|Mensaje reenviado)\s*-{2,}"
    r"|(?:Begin forwarded message|Anfang der weitergeleiteten Nachricht|Début du message (?:réexpédié|transféré)|Inicio del mensaje reenviado|Comienzo del mensaje reenviado)\s?:)\s*$"
)
HEADER = re.compile(r"^\s*\*?(From|Sent|Date|To|Cc|Subject|Reply-To|Von|Gesendet|Datum|An|Kopie|Betreff|De|Envoyé|À|Objet|Copie|Enviado|Enviada|Fecha|Para|Asunto|CC) ?:\*? ?")
#: Any titled rule counts as an introduction right above a header block.
ANY_RULE = re.compile(r"^\s*-{2,}[^-].*[^-]-{2,}\s*$")
LONG_RULE = re.compile(r"^\s*[_-]{8,}\s*$")
# --- fixed values: how people and programs end a mail -----------------------------------------
CLOSING = re.compile(
    r"^(?:(?:with )?(?:kind|best|warm|many|warmest|kindest)?\s?(?:regards|wishes)|best|cheers|(?:many )?thanks(?: and bye| again)?|thank you|yours(?: sincerely| faithfully| truly)?|sincerely|all the best|take care"
    r"|(?:mit )?(?:viele[n]?|beste[n]?|liebe[n]?|freundliche[n]?|herzliche[n]?|schöne[n]?)?\s?(?:grüße[n]?|grüsse[n]?|gruß|gruss)|mfg|vielen dank|danke und gruß"
    r"|(?:bien )?cordialement|bien à vous|merci(?: et à bientôt)?|bonne journée|salutations|sincères salutations|à bientôt|amicalement"
    r"|(?:un )?(?:cordial )?saludos?(?: cordiales)?|gracias(?: y saludos)?|atentamente|un abrazo|muchas gracias)\b",
    re.I,
)
GREETING = re.compile(r"^(?:hi|hello|hey|dear|good (?:morning|afternoon|evening)|hallo|guten (?:tag|morgen|abend)|liebe[rs]?|sehr geehrte[r]?|moin|bonjour|bonsoir|salut|ch[eè]re?s?|madame|monsieur|hola|buen[oa]s (?:días|tardes|noches)|estimad[oa]s?|querid[oa]s?)\b", re.I)
DELIMITER = re.compile(r"^\s*(?:-{1,4}|—|–|_{2,}|\*{2,}|={2,}|~{2,})\s*$")
_SMALL = {"de", "del", "la", "las", "los", "le", "les", "du", "des", "van", "den", "der", "von", "of", "and", "y", "et", "und", "the", "bis", "ter", "für", "for", "ext", "m", "a", "o", "no", "via", "c", "t", "am", "an", "im", "zum", "zur", "piso"}
NEAR = 25


def _short_fact(line: str) -> bool:
    """A name, title, firm, phone, mail or street line: few words, none of them a small plain word, no sentence end."""
    s = line.strip().lstrip("-–—/*• ").strip()
    if not s:
        return True
    if re.fullmatch(r"<?[\w.+'-]+@[\w.-]+>?(?:\s*\|.*)?", s) or re.fullmatch(r"(?:[^\W\d_]{1,10}\.?:?\s*)?[+(]?\d[\d\s()./+-]{5,}(?:\s*(?:ext|x|Durchwahl|poste)\.?\s*\d+)?", s):
        return True
    words = re.findall(r"[^\W\d_ºª]+", s)
    if len(words) > 12 or len(s) > 90 or (re.search(r"[.!?;,:]$", s) and not re.search(r"\b(?:S\.L\.|S\.A\.|Inc\.|Ltd\.|Co\.|e\.V\.)$", s)):
        return False
    plain = [w for w in words if not w[0].isupper() and w.lower() not in _SMALL and not any(c.isdigit() for c in w)]
    return not plain or bool(re.search(r"\d", s) and len(words) <= 8 and len(plain) <= 2)


def _closing(line: str) -> bool:
    """A closing formula, alone or with the name behind it."""
    s = line.strip()
    if not (m := CLOSING.match(s)) or len(s) > 60:
        return False
    rest = s[m.end() :].strip(" ,.!–—-")
    return all(w[0].isupper() or w.lower() in _SMALL for w in re.findall(r"[^\W\d_]+", rest)) and len(rest.split()) <= 4 and not re.search(r"\d", rest)


def new_lines(text: str, inherited: set[int] = frozenset(), boilerplate: set[int] = frozenset(), known: set[int] = frozenset()) -> list[int]:
    """Numbers (from 1) of the lines that the sender newly wrote. ``boilerplate`` are lines whose wording
    ends messages, ``known`` those common enough to say that it does not: no pattern speaks for them."""
    lines = text.split("\n")
    n = len(lines)
    blank = [not x.strip() for x in lines]
    marked = [bool(MARK.match(x)) for x in lines]
    quoted = [False] * n

    def following(i: int) -> int:
        while i < n and blank[i]:
            i += 1
        return i

    end = n  # first line of a quotation that runs to the end
    i = 0
    while i < n:
        if marked[i] or blank[i]:
            i += 1
            continue
        last = i + 1 if INTRO.match(lines[i]) else 0
        if not last and i + 1 < n and not marked[i + 1] and re.match(r"^(?:On|Am|Le|El) ", lines[i]) and re.match(r"^\s*<?\S+@\S+>? ?(?:wrote|schrieb|a écrit|escribió)\b.*:\s*$|.*\b(?:wrote|schrieb|a écrit|escribió) ?:\s*$", lines[i + 1]) and re.search(_WHEN, lines[i]):
            last = i + 2
        if last:
            quoted[i:last] = [True] * (last - i)
            after = following(last)
            if after < n and not marked[after]:
                end = i
                break
            i = last
            continue
        if RULE.match(lines[i]):
            after = following(i + 1)
            quoted[i] = True
            if after >= n or not marked[after]:
                end = i
                break
        elif HEADER.match(lines[i]) or LONG_RULE.match(lines[i]):
            j = following(i + 1) if LONG_RULE.match(lines[i]) else i
            k = j
            while k < n and HEADER.match(lines[k]):
                k += 1
            if k - j >= 2 and len({HEADER.match(x).group(1) for x in lines[j:k]}) >= 2:
                above = next((x for x in range(i - 1, -1, -1) if not blank[x]), None)
                if above is not None and not marked[above] and ANY_RULE.match(lines[above]):
                    i = above
                quoted[i:k] = [True] * (k - i)
                after = following(k)
                if after >= n or not marked[after]:
                    end = i
                    break
                i = k
                continue
        i += 1
    for i in range(end, n):
        quoted[i] = True
    seen = [i for i in range(n) if marked[i]]
    for i in seen:
        lone = re.match(r"^\s*> ?\d", lines[i]) and not any(j != i and abs(i - j) <= 4 for j in seen) and not any(quoted[max(0, i - 3) : i])
        quoted[i] = quoted[i] or not lone
    for i in range(n):
        if i + 1 in inherited and not marked[i]:
            quoted[i] = True

    new = [not quoted[i] and not blank[i] for i in range(n)]
    first = next((i for i in range(n) if not blank[i]), n)
    # signatures end the message or stand right before a quotation
    stops = [i for i in range(1, n + 1) if (i == n or quoted[i]) and not quoted[i - 1]]
    outset = next((i for i in range(n) if quoted[i]), n)  # inline answers further down have no signature of their own
    stops = [s for s in stops if s == n or not marked[s] or s in (end, outset)] + [n]
    for stop in sorted({min(s, n) for s in stops} | {end}):
        i, begin = stop - 1, stop
        while i >= 0 and not quoted[i]:
            line = lines[i]
            if blank[i]:
                i -= 1
                continue
            greeting = bool(GREETING.match(line.strip())) or (i == first and line.rstrip().endswith(","))
            closing = i + 1 in boilerplate or (i + 1 not in known and _closing(line))
            if not (closing and not GREETING.match(line.strip()) or DELIMITER.match(line) or (_short_fact(line) and not greeting)):
                break
            begin = i
            i -= 1
        for j in range(begin, stop):
            new[j] = False
    return [i + 1 for i in range(n) if new[i]]


_SENTENCE = re.compile(r"\S.*?(?:[.!?](?=\s|$)|$)", re.S)


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(first line, last line, words) of every sentence; quote marks do not count, wraps are joined."""
    out, block, start = [], [], 1

    def flush() -> None:
        whole, ends, at = " ".join(block), [], 0
        for b in block:
            at += len(b) + 1
            ends.append(at)
        for m in _SENTENCE.finditer(whole):
            s = m.group().strip()
            if s:
                out.append((start + int(np.searchsorted(ends, m.start(), side="right")), start + int(np.searchsorted(ends, m.end() - 1, side="right")), s))
        block.clear()

    depth = None
    for no, line in enumerate(text.split("\n"), 1):
        bare = MARKS.sub("", line)
        d = len(line) - len(line.lstrip(">| "))
        if not bare.strip() or (block and (d > 0) != (depth > 0)):
            flush()
        if bare.strip():
            if not block:
                start, depth = no, d
            block.append(bare.strip())
    flush()
    return out


def simhash(parts: list[str]) -> np.ndarray:
    """64-bit SimHash over the words and the groups of four letters of each part."""
    words, owner = [], []
    for i, p in enumerate(parts):
        w = set(re.findall(r"\w+", p.lower()))
        words += w
        owner += [i] * len(w)
    distinct = {w: xxhash.xxh3_64_intdigest(w) for w in dict.fromkeys(words)}
    h, o = np.fromiter(map(distinct.__getitem__, words), dtype=np.uint64, count=len(words)), np.asarray(owner, dtype=np.int64)
    raw = [" ".join(p.lower().split()).encode() for p in parts]
    flat, size = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64), np.asarray([len(r) for r in raw], dtype=np.int64)
    if len(flat) >= 4:
        gram = flat[:-3] | flat[1:-2] << np.uint64(8) | flat[2:-1] << np.uint64(16) | flat[3:] << np.uint64(24)
        at = np.repeat(np.arange(len(parts)), size)
        whole = at[:-3] == at[3:]
        gram = (gram[whole] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        gram = (gram ^ gram >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        h, o = np.concatenate([h, gram ^ gram >> np.uint64(32)]), np.concatenate([o, at[:-3][whole]])
    total = np.zeros((len(parts), 64), dtype=np.int32)
    order = np.argsort(o, kind="stable")
    h, o = h[order], o[order]
    for at in range(0, len(h), 1 << 17):  # long texts take no more memory than short ones
        part, own = h[at : at + (1 << 17)], o[at : at + (1 << 17)]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.int8) * np.int8(2) - np.int8(1)
        total[own[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    return np.packbits(total >= 0, axis=1, bitorder="little").view(np.int64).ravel()


def _hashes(text: list[str]) -> np.ndarray:
    """SimHashes of the texts long enough to have near ones, each computed once, and 0 for the rest."""
    place = {t: i for i, t in enumerate(dict.fromkeys(t for t in text if len(t) >= NEAR))}
    known = np.r_[simhash(list(place)), 0] if place else np.zeros(1, np.int64)
    return known[[place.get(t, -1) for t in text]]


def wording(line: str, names: set[str]) -> str:
    """Words and digits of a line without the sender's name at its end."""
    words = re.findall(r"\w+", line.casefold())
    while words and words[-1] in names:
        words.pop()
    return " ".join(words)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per message its sentences (``run`` null) and the sentences of its unmarked lines (``first`` is the
    line, ``last`` the place in it): ``run`` numbers the stretches between marked lines, introductions
    and header blocks, ``bare`` says that a line is a name or a fact. ``w`` hashes the wording, ``d`` its digits, ``h`` is the SimHash."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            row, first, last, run, bare, text = [], [], [], [], [], []
            for i, (t, header) in enumerate(zip(part.column(4).to_pylist(), part.column(5).to_pylist())):
                names = {w for w in re.findall(r"[^\W\d_]+", (header or "").casefold()) if len(w) > 1}
                for a, b, s in sentences(t):
                    row.append(i), first.append(a), last.append(b), run.append(None), bare.append(False), text.append(s)
                stretch, open_ = 0, ""
                for no, line in enumerate(t.split("\n"), 1):
                    if MARK.match(line) or INTRO.match(line) or RULE.match(line) or HEADER.match(line):
                        stretch = no
                    elif line.strip():
                        fact = _short_fact(line) or bool(DELIMITER.match(line))
                        for n, piece in enumerate(_SENTENCE.findall(line)):
                            words = wording(piece, names)
                            words, open_ = f"{open_} {words}" if open_ else words, ""
                            row.append(i), first.append(no), last.append(n), run.append(stretch), text.append(words)
                            bare.append(fact or not words)
                        if len(line) >= 50 and line.rstrip()[-1] not in ".!?:;,":
                            open_ = words  # a wrapped sentence goes on in the next line
                    if not line.strip():
                        open_ = ""
            take = pa.array(row, pa.int64())
            digits = [xxhash.xxh3_64_intdigest("".join(c for c in s if c.isdigit())) for s in text]
            w = [xxhash.xxh3_64_intdigest(s) for s in text]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i).take(take) for i in range(4)), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(run, pa.int32()), pa.array(bare), pa.array(text, pa.string())]
                + [pa.array(np.asarray(x, dtype=np.uint64).view(np.int64)) for x in (w, digits)]
                + [pa.array(_hashes(text))],
                ["message_id", "thread", "sender", "sent_at", "first", "last", "run", "bare", "s", "w", "d", "h"],
            )


def _coded(rows: DataFrame, bits: int) -> DataFrame:
    """One row for each table of ``bits`` bits of the SimHash."""
    tables = [F.struct(F.lit(i).alias("t"), F.shiftrightunsigned("h", bits * i).bitwiseAND(F.lit((1 << bits) - 1)).alias("v")) for i in range(64 // bits)]
    return rows.withColumn("p", F.explode(F.array(*tables))).select(*rows.columns, "p.t", "p.v")


def _like(a: str, b: str, share: float) -> F.Column:
    most = F.ceil(F.greatest(F.length(a), F.length(b)) * share).cast("int")
    return F.abs(F.length(a) - F.length(b)) <= most, F.levenshtein(a, b) <= F.greatest(F.length(a), F.length(b)) * share


def inherited_lines(s: DataFrame, recipients: DataFrame, common: int = 3) -> DataFrame:
    """(message_id, inherited, short): spans of sentences that an earlier message has, long and short ones."""
    s = s.where("run IS NULL")
    # phrases of several conversations prove no inheritance alone, nor do short sentences
    phrase = s.groupBy("w").agg(F.approx_count_distinct("thread").alias("n")).where(F.col("n") >= common).select("w", F.lit(True).alias("phrase"))
    s = stage(s.join(phrase, "w", "left").withColumn("long", (F.length("s") >= NEAR) & F.col("phrase").isNull()).drop("phrase"), "spread")
    long = F.col("long")
    # earliest place of a wording in a conversation: copies of it need no pairs of their own
    earliest = s.groupBy("thread", "w").agg(F.first("h").alias("h"), F.first("d").alias("d"), F.first("s").alias("s"), F.first("long").alias("long"), F.min(F.struct("sent_at", "message_id")).alias("e"))
    earliest = stage(earliest, "earliest")
    coded = _coded(earliest.where(long).select("thread", "d", "w", "h"), 8)
    near = coded.join(coded.select("thread", "d", "t", "v", F.col("w").alias("w2"), F.col("h").alias("h2")), ["thread", "d", "t", "v"])
    near = stage(near.where((F.col("w") < F.col("w2")) & (F.bit_count(F.col("h").bitwiseXOR(F.col("h2"))) <= 7)).select("thread", "w", "w2").distinct(), "near")
    source = earliest.select("thread", "w", "s", "e")
    both = near.join(source, ["thread", "w"]).join(source.select("thread", F.col("w").alias("w2"), F.col("s").alias("s2"), F.col("e").alias("e2")), ["thread", "w2"])
    for rule in _like("s", "s2", 0.2):
        both = both.where(rule)
    both = stage(both.select("thread", "w", "w2", "e", "e2"), "alike")
    # each wording with the earliest message that has it or a near wording
    first = source.select("thread", "w", "e").unionByName(both.select("thread", "w", F.col("e2").alias("e"))).unionByName(both.select("thread", F.col("w2").alias("w"), "e"))
    first = first.groupBy("thread", "w").agg(F.min("e").alias("e"))
    place = s.select("message_id", "thread", "sent_at", "w", "long", "first", "last")
    older = (F.col("e.message_id") != F.col("message_id")) & (F.col("e.sent_at") < F.col("sent_at"))
    own = place.join(first, ["thread", "w"]).where(older).select("message_id", "long", "first", "last")
    # wordings that one of the addressees sent before, in any conversation
    sent = s.where(long & F.col("sender").isNotNull()).groupBy(F.col("sender").alias("other"), "w").agg(F.min("sent_at").alias("before"))
    asked = place.where("long").join(recipients, "message_id").join(sent, ["other", "w"]).where("before < sent_at").select("message_id", "long", "first", "last")
    span = F.struct("first", "last")
    # bounded by the lines of a message
    return own.unionByName(asked).groupBy("message_id").agg(F.collect_set(F.when(F.col("long"), span)).alias("inherited"), F.collect_set(F.when(~F.col("long"), span)).alias("short"))


def boilerplate_lines(s: DataFrame, common: int = 3, ends: float = 0.9) -> DataFrame:
    """(message_id, boilerplate, known): numbers of the lines that are boilerplate, and of those whose
    wording is common but does not end messages."""
    lines = s.where("run IS NOT NULL").select("message_id", "thread", "sender", "run", F.col("first").alias("no"), F.col("last").alias("at"), "bare", "s", "w", "h")
    spread = lines.groupBy("w").agg((F.min("thread") != F.max("thread")).alias("again"))
    lines = lines.join(spread, "w")
    # newly worded lines below: counted within the stretch
    below = Window.partitionBy("message_id", "run").orderBy(F.desc("no"), F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("tail", F.coalesce(F.max((~F.col("again") & ~F.col("bare")).cast("int")).over(below), F.lit(0)) == 0)
    lines = stage(lines.withColumn("tail", F.col("tail") & (F.col("no") > F.min("no").over(Window.partitionBy("message_id")))), "lines")
    per = lines.where("again").groupBy("w", "sender").agg(F.approx_count_distinct("thread").alias("n"), F.count("*").alias("places"), F.count_if("tail").alias("tails"))
    per = stage(per, "wordings")
    everywhere = lines.where("again").groupBy("w").agg(F.approx_count_distinct("thread").alias("n"), F.avg(F.col("tail").cast("int")).alias("share")).where(F.col("n") >= common)
    everywhere = stage(everywhere.select("w", (F.col("share") >= ends).alias("closes")), "common")
    mails = lines.where("sender IS NOT NULL").groupBy("sender").agg(F.approx_count_distinct("thread").alias("all"))
    habit = per.join(mails, "sender").where((F.col("n") >= F.greatest(F.lit(2), F.col("all") * 0.2)) & (F.col("tails") >= F.col("places") * ends)).select("sender", "w", F.lit(True).alias("habit"))
    judged = lines.join(everywhere, "w", "left").join(habit, ["sender", "w"], "left")
    judged = stage(judged.select("message_id", "no", "bare", "w", "h", "s", "closes", (F.coalesce("closes", F.lit(False)) | F.coalesce("habit", F.lit(False))).alias("boiler")), "judged")
    # longer lines near to common boilerplate
    text = judged.where(F.col("boiler") & (F.length("s") >= NEAR)).groupBy("w").agg(F.first("h").alias("h"), F.first("s").alias("s"))
    other = judged.where(~F.col("boiler") & (F.length("s") >= NEAR)).groupBy("w").agg(F.first("h").alias("h"), F.first("s").alias("s"))
    pairs = _coded(other, 16).join(_coded(text.select(F.col("h").alias("h2"), F.col("s").alias("s2"), "h"), 16).drop("h"), ["t", "v"])
    pairs = pairs.where(F.bit_count(F.col("h").bitwiseXOR(F.col("h2"))) <= 3)
    for rule in _like("s", "s2", 0.1):
        pairs = pairs.where(rule)
    rows = judged.join(pairs.select("w", F.lit(True).alias("close")).distinct(), "w", "left").withColumn("boiler", F.col("boiler") | F.col("close").isNotNull())
    # a line is boilerplate if all its sentences are, known if one of them does not end messages
    of_line = rows.groupBy("message_id", "no").agg(F.bool_and(F.col("boiler") | F.col("bare")).alias("all"), F.bool_or("boiler").alias("some"), F.bool_or(~F.col("boiler") & F.col("closes").isNotNull()).alias("known"))
    of_line = of_line.select("message_id", "no", (F.col("all") & F.col("some")).alias("boiler"), "known").where("boiler OR known")
    return of_line.groupBy("message_id").agg(F.collect_set(F.when(F.col("boiler"), F.col("no"))).alias("boilerplate"), F.collect_set(F.when(F.col("known") & ~F.col("boiler"), F.col("no"))).alias("known"))


def known_lines(messages: DataFrame) -> DataFrame:
    """(message_id, inherited, short, boilerplate, known), see the two functions above."""
    texts = messages.select("message_id", "thread", "sender", "sent_at", "text", "sender_header")
    s = texts.mapInArrow(_split, "message_id string, thread string, sender string, sent_at timestamp, first int, last int, run int, bare boolean, s string, w long, d long, h long")
    s = stage(s.withColumn("thread", F.xxhash64("thread")), "sentences")
    recipients = messages.select("message_id", F.explode("recipients").alias("other"))
    return inherited_lines(s, recipients).join(boilerplate_lines(s), "message_id", "full")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _new(text: pd.Series, inherited: pd.Series, short: pd.Series, boilerplate: pd.Series, known: pd.Series) -> pd.Series:
    def taken(t, long, few) -> set[int]:
        lines = {i for r in (long if long is not None else ()) for i in range(r["first"], r["last"] + 1)}
        if lines:  # marked lines are quotations anyway and speak for no line beside them
            lines -= {i for i, x in enumerate(t.split("\n"), 1) if MARK.match(x)}
        spans = sorted((r["first"], r["last"]) for r in (few if few is not None and lines else ()))
        for way in (spans, spans[::-1]):  # short sentences beside inherited ones, going down and up
            for a, b in way:
                if any(x in lines for x in (a - 2, a - 1, a, b, b + 1, b + 2)):
                    lines.update(range(a, b + 1))
        return lines

    numbers = lambda x: set(x) if x is not None else set()
    return pd.Series([new_lines(t, taken(t, a, b), numbers(c), numbers(d)) for t, a, b, c, d in zip(text, inherited, short, boilerplate, known)])


def current_messages(emails: DataFrame) -> DataFrame:
    """One row per message with a text."""
    for header in ("to_header", "cc_header"):  # without addressees sentences are only followed within their conversation
        emails = emails if header in emails.columns else emails.withColumn(header, F.lit(None).cast("string"))
    newest = F.max(F.struct("fetched_at", F.length("text").alias("n"), "text", "thread_id", "sender_header", "sent_at", "to_header", "cc_header")).alias("m")
    m = emails.where("message_id IS NOT NULL").groupBy("message_id").agg(newest).select("message_id", "m.*")
    address = r"([\w.+'-]+@[\w.-]+)"
    sender = F.lower(F.regexp_extract("sender_header", address, 1))
    others = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "to_header", "cc_header")), F.lit(address), F.lit(1)))
    m = m.where("trim(text) <> ''").select("message_id", F.coalesce("thread_id", F.concat(F.lit("message "), "message_id")).alias("thread"), F.when(sender != "", sender).alias("sender"), F.col("sent_at").cast("timestamp").alias("sent_at"), "text", "sender_header", others.alias("recipients"))
    return stage(m, "messages")


def new_line_numbers(emails: DataFrame) -> DataFrame:
    """(message_id, line_no) of every line newly written."""
    messages = current_messages(emails)
    rows = messages.select("message_id", "text").join(known_lines(messages), "message_id", "left")
    return rows.select("message_id", F.explode(_new("text", "inherited", "short", "boilerplate", "known")).alias("line_no"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines newly written by the sender of each message."""
    return new_line_numbers(table(spark, sf_dir, "email_messages"))
