"""Recognising, redacting and checking personal data."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .redaction import redact_terms

#: Recognisers of the generic profile: type, pattern (group 1 is the value), score.
RULES: tuple[tuple[str, str, float], ...] = (
    ("email", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 0.95),
    ("ipv4", r"(?:^|[^0-9.])((?:[0-9]{1,3}\.){3}[0-9]{1,3})", 0.8),
    ("iban", r"\b([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7})\b", 0.9),
    ("phone", r"(?:^|[^0-9])(\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4})", 0.7),
    ("short_phone", r"(?:^|[^0-9-])([0-9]{3}-[0-9]{4})", 0.5),
    ("birth_date", r"(?:geboren am|geb\.|born) ([0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})", 0.9),
    ("long_number", r"(?:^|[^0-9])([0-9]{6,})", 0.4),
    ("secret", r"(?:password|token|secret|api_key)\s*[:=]\s*(\S+)", 0.85),
)
#: Ordered redaction: long identifiers before short ones.
REDACTIONS: tuple[tuple[str, str], ...] = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"https?://[^\s]+", "[URL]"),
    (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}\b", "[IBAN]"),
    (r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", "[IP]"),
    (r"\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}", "[PHONE]"),
    (r"[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}", "[DATE]"),
    (r"[0-9]{6,}", "[NUMBER]"),
)


# Labels of the case profile's recognisers and the scores of what they find.
_FILE_LABEL = r"(?:Az\.?|Aktenzeichen|Geschäftszeichen|Dolmetscher(?:-Nr\.?|nummer)?)"
_PAPER_LABEL = r"(?:Dolmetscher(?:-Nr\.?|nummer)?|Pass(?:nummer|-Nr\.?)?|Ausweis(?:nummer|-Nr\.?)?|Dokument(?:nummer|-Nr\.?)?|ID(?:-Nr\.?)?)"
_OFFICE_LABEL = r"(?:Gesch(?:äft|ae?ft|a?ft)szeichen|Gesch\.?-?Z\.?|Geschäftsz\.?|Geschaeftsz\.?|Geschaftsz\.?)"
_BIRTH = r"(?:geboren\s+am|geb\.?\s*am|geburtsdatum|jahrgang|geboren|geb\.(?=[\s,;:)]))"
_DAY = r"\d{1,2}\.\s*\d{1,2}\.\s*(?:19|20)\d{2}"
_CITED_BEFORE = r"(?:urteil|beschluss|beschl\.|entscheidung|gerichtsbescheid|[UB]\.)\s*(?:vom|v\.)\s*\d{1,2}\.\d{1,2}\.\d{2,4}\s*[,;]?\s*"
_COURT_FILE = r"(?:[A-Z]{0,4}\s*\d{1,4}\s*[A-ZÄÖÜa-zäöüß]{0,8}\s*\d{1,5}/\d{2,4}|[A-Z]{1,4}\s*\d{1,5}/\d{2,4})"
_TOWN = r"[A-ZÄÖÜ][A-Za-zÄÖÜäöüß]+(?:[ \t-]+[A-ZÄÖÜ][A-Za-zÄÖÜäöüß]+){0,2}"
#: Recognisers of the case profile: type, pattern (group 1 is the value, without its label), score. A birth date counts beside a word of
#: birth only; a court's file number does not where a published decision is cited: that alternative comes first and has no group.
CASE_RULES: tuple[tuple[str, str, float], ...] = (
    ("birth_date", rf"(?i){_BIRTH}[^\n]{{0,40}}?\b({_DAY})\b", 0.55),
    ("birth_date", rf"(?i)\b({_DAY})\b\s*(?:,|\)|;)?\s*(?:geboren|geburtsdatum|jahrgang)\b", 0.55),
    ("birth_date", r"(?i)\b((?:jahrgang|geboren)\s*:?\s*(?:19|20)\d{2})\b", 0.55),
    ("postal_code", rf"\b(\d{{5}})[ \t]+{_TOWN}\b", 0.65),
    ("city", rf"\b\d{{5}}[ \t]+({_TOWN})\b", 0.65),
    ("street", r"\b([A-ZÄÖÜ][A-Za-zÄÖÜäöüß.\-]+(?:straße|strabe|str\.|weg|platz|allee|gasse|ring|damm|ufer)\s*\d+\s*[A-Za-z]?)\b", 0.7),
    ("azr_number", r"(?i)\bAZR(?:-Nummer|-Nr\.?)?\s*[:#-]?\s*([A-Z0-9][A-Z0-9./\-]{5,})\b", 0.85),
    ("residence_permit", r"(?i)\bAufenthaltsgestattung\s*[:#-]?\s*([A-Z0-9][A-Z0-9./\-]{4,})\b", 0.85),
    ("case_number", rf"(?i)\b{_FILE_LABEL}\s*[:#-]?\s*([A-Z0-9./]*-[A-Z0-9./\-]{{2,}}|[A-Z]\d[A-Z0-9./\-]{{3,}})\b", 0.8),
    ("case_number", r"\b(\d{6,10}\s*-\s*\d{2,5})\b", 0.7),
    ("case_number", r"\b([A-Z]\d[A-Z0-9][A-Z0-9./\-]{3,})\b", 0.65),
    ("office_file", rf"(?i)\b{_OFFICE_LABEL}\s*[:#-]?\s*([A-Z0-9][A-Z0-9./\-\s]{{3,30}})\b", 0.85),
    ("court_file", rf"(?i){_CITED_BEFORE}(?:Az\.?|Aktenzeichen|Geschäftsnummer)\s*[:#-]?\s*{_COURT_FILE}\b|\b(?:Az\.?|Aktenzeichen|Geschäftsnummer)\s*[:#-]?\s*({_COURT_FILE})\b", 0.8),
    ("document_id", rf"(?i)\b{_PAPER_LABEL}\s*[:#-]?\s*([A-Z0-9][A-Z0-9./\-]{{3,}})\b", 0.8),
    ("file_number", r"(?i)\b(?:Akte|Az\.?|Aktenzeichen|Gesch(?:äfts|aefts)?-?z(?:eichen)?\.?)\s*[:#-]?\s*(\d{6,10})\b", 0.8),
)


def case_entities(df: DataFrame, key: str, text: str, rules: Sequence[tuple[str, str, float]] = CASE_RULES) -> DataFrame:
    """(key, type, value, score): what the case profile finds, each value once per text and type with its best score."""
    c = F.coalesce(F.col(text), F.lit(""))
    found = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(s).alias("score"), F.regexp_extract_all(c, F.lit(p), F.lit(1)).alias("values")) for t, p, s in rules))
    # dealt by key before the patterns, so that finds are counted where they are made
    each = spread(df.select(key, text), key).select(key, F.inline(found)).select(key, "type", "score", F.explode("values").alias("value"))
    each = each.withColumn("value", F.regexp_replace("value", r"^[ \t\r\n,;:]+|[ \t\r\n,;:]+$", "")).where("value <> ''")
    # the end of one label can look like the beginning of another: an identifier has a digit
    each = each.where(F.col("type").isin("city", "street") | F.col("value").rlike("[0-9]"))
    return each.groupBy(key, "type", "value").agg(F.max("score").alias("score"))


def merge_entities(found: DataFrame, keys: list[str], kind: str, value: str, order: str) -> DataFrame:
    """Per key and type the values of all chunks in order, each once, compared without case and outer blanks."""
    clean = found.withColumn("_v", F.trim(F.col(value))).where("_v <> ''")
    one = clean.groupBy(*keys, kind, F.lower("_v").alias("_k")).agg(F.min(F.struct(order, "_v")).alias("_f"))
    values = F.transform(F.array_sort(F.collect_list("_f")), lambda x: x["_v"])
    return one.groupBy(*keys, kind).agg(values.alias("values"))


def scrub_values(values: Column, terms: Column, token: str) -> Column:
    """An array of texts with every literal term replaced, longer terms first."""
    ordered = F.array_sort(F.filter(terms, lambda t: F.length(t) > 0), lambda a, b: F.length(b) - F.length(a))
    return F.transform(values, lambda v: F.aggregate(ordered, v, lambda s, t: F.replace(s, t, F.lit(token))))


def recognise(df: DataFrame, key: str, text: str, rules: Sequence[tuple[str, str, float]] = RULES) -> DataFrame:
    """(key, type, value, score): what each rule finds, every value once per text and type."""
    c = F.coalesce(F.col(text), F.lit(""))

    def values(pattern: str) -> Column:
        found = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)))
        # long runs without the sign take the square of their length
        return F.when(F.contains(c, F.lit("@")), found).otherwise(F.array().cast("array<string>")) if pattern == RULES[0][1] else found

    found = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(s).alias("score"), values(p).alias("values")) for t, p, s in rules))
    each = spread(df.select(key, text), key).select(key, F.inline(found))
    return each.select(key, "type", "score", F.explode("values").alias("value"))


def exclusive(entities: DataFrame, key: str) -> DataFrame:
    """A value belongs to one type only: that of the highest score."""
    from .merge import first_by

    norm = F.lower(F.regexp_replace("value", r"[^\p{L}\p{N}]", ""))
    return first_by(entities.withColumn("norm", norm), [key, "norm"], [F.col("score").desc(), F.col("type"), F.col("value")])


def redact(text: Column, rules: Sequence[tuple[str, str]] = REDACTIONS) -> Column:
    for pattern, token in rules:
        text = F.regexp_replace(text, pattern, token)
    return text


def redact_entities(df: DataFrame, text: str, terms: str, token: str = "[PERSON]") -> DataFrame:
    """``df`` with ``redacted``: the text without the names in an array column, in Arrow batches (see :mod:`.redaction`)."""
    return redact_terms(df, text, {terms: ("person", token)})


def leaks(text: Column, expected: Column) -> Column:
    """Expected values that are still there, compared without case and punctuation."""
    norm = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    held = norm(text)
    return F.size(F.filter(expected, lambda x: held.contains(norm(x))))


def pseudonymised(df: DataFrame, text: str, names: str, places: str | None = None, out: str = "pseudonymised") -> DataFrame:
    """``df`` with ``out``: the text without the names and places of its case, or an empty text where that is not sure.

    It is not sure where the case's names are unknown (null), where replacing fails, and where one of them or of their words is still there in any spelling of case and
    punctuation, also within a word; names of up to four letters and digits are whole words only and not looked for again. Null texts are empty.
    """
    from .redaction import NO_NAMES, TITLES

    kinds = {names: ("person", "[PERSON]")} | ({places: ("place", "[ORT]")} if places else {})
    clean = redact_terms(df, text, kinds, "_clean", strict=False)
    known = F.filter(F.col(names), lambda x: x.isNotNull())
    words = F.filter(F.flatten(F.transform(known, lambda x: F.split(x, r"[\s,]+"))), lambda w: ~F.lower(w).isin(*sorted(TITLES | NO_NAMES)))
    left = leaks(F.col("_clean"), F.filter(F.array_union(known, words), lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) > 4))
    sure = F.col(names).isNotNull() & F.col("_clean").isNotNull() & (left == 0)
    return clean.withColumn(out, F.when(F.coalesce(sure, F.lit(False)), F.col("_clean")).otherwise("")).drop("_clean")


#: Context rules that hold even when no entity was extracted, in order: long identifiers come before postal codes.
CONTEXT_RULES: tuple[tuple[str, str], ...] = (
    (r"(?m)^[A-Z0-9<]{30,}$", "[MRZ-REDACTED]"),
    (r"(?m)^([0-9]+[.)] )[A-ZÄÖÜ][a-zäöüß]+ [A-ZÄÖÜ][a-zäöüß]+,? (geb|geboren)", "$1[PERSON], $2"),
    (r"(?m)((?:AZR-?(?:Nummer|Nr\.?)|Aktenzeichen|Az\.|Kennzeichen|Referenz)\s*:?\s*)[A-Z0-9][A-Z0-9./ -]{3,}[A-Z0-9]", "$1[AKTENZEICHEN]"),
    (r"((?:Pass|Visum|Ausweis|ID)(?:nummer|-Nr\.?| No\.?)\s*:?\s*)[A-Z0-9]{6,}", "$1[DOKUMENTENNUMMER]"),
    (r"((?:geboren am|geb\. am|geb\.|Geburtsdatum:?)\s*)[0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)?[0-9]{2}", "$1[GEBURTSDATUM]"),
    (r"(?m)((?:Name|Vorname|Familienname|Mutter|Vater|Kläger(?:in)?|Antragsteller(?:in)?)\s*:\s*)[^\n,]+", "$1[PERSON]"),
    (r"[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|platz|allee|gasse) [0-9]{1,4}[a-z]?", "[ADRESSE]"),
    (r"\b[0-9]{5} [A-ZÄÖÜ][a-zäöüß]+(?:[ -][A-ZÄÖÜ][a-zäöüß]+)?", "[PLZ] [ORT]"),
    (r"(?m)^(gez\.|Im Auftrag|Unterschrift:?)\s+[A-ZÄÖÜ][^\n]*$", "$1 [PERSON]"),
)


def redact_context(text: Column) -> Column:
    """The context rules as one chain of expressions."""
    return redact(text, CONTEXT_RULES)


_PAGE_MARK = re.compile(r"--- (?:Page|Seite) (\d+) ---")
_RESIDUE = re.compile(r"(?m)^[ \t]*-{2,}[ \t]*\[[A-Z\-]+\][ \t]*-{2,}[ \t]*$")


def restore_markers(before: str, after: str) -> str:
    """``after`` with the page markers of ``before`` that a rewrite lost; nothing else is changed.

    If as many lines are left of markers whose words were replaced (``--- [ORT] ---``) as there are lost ones, these are they. Otherwise a marker
    goes back in front of the line with its page's anchor, the longest run without digits in the page's first 800 characters, behind the
    marker before it. Without such a line it stays away: a wrong page number is worse than none.
    """
    marks = list(_PAGE_MARK.finditer(before or ""))
    there = {m[1] for m in _PAGE_MARK.finditer(after or "")}
    if not marks or not after:
        return after
    ends = [m.start() for m in marks[1:]] + [len(before)]
    lost = sorted(((int(m[1]), m[0], before[m.end() : end]) for m, end in zip(marks, ends, strict=True) if m[1] not in there), key=lambda x: x[0])
    if not lost:
        return after
    if len(_RESIDUE.findall(after)) == len(lost):
        names = iter(lost)
        return _RESIDUE.sub(lambda _: next(names)[1], after)
    out, at = [], 0
    for _, mark, page in lost:
        anchor = max((x.strip() for x in re.findall(r"[^\W\d_][^\d\n]{19,}", page[:800])), key=len, default="")[:60]
        spot = after.find(anchor, at) if anchor else -1
        if spot >= 0:
            line = max(after.rfind("\n", 0, spot) + 1, at)
            out += [after[at:line], mark + "\n", after[line : spot + len(anchor)]]
            at = spot + len(anchor)
    return "".join(out) + after[at:]


_HONORIFIC = {"herr", "frau", "dr", "dr.", "prof", "prof.", "der", "die", "das"}


def plausible_names(text: str, names: Sequence[str], group_words: Sequence[str] = ("kläger", "behörde", "gericht", "amt", "familie"), context: int = 100, reference: str = r"(?i)(urteil|beschluss|rn\.|juris)") -> list[str]:
    """Names of one to four capitalised words without digits that are no honorifics, groups or organisations, occur in the text, and not only beside citations."""
    keep = []
    for name in dict.fromkeys(n.strip() for n in names if n and n.strip()):
        words = name.split()
        if not 1 <= len(words) <= 4 or any(c.isdigit() for c in name) or any(not w[0].isupper() for w in words):
            continue
        if all(w.lower() in _HONORIFIC for w in words) or any(g in name.lower() for g in group_words):
            continue
        spots = [m.start() for m in re.finditer(re.escape(name), text)]
        if spots and not all(re.search(reference, text[max(0, s - context) : s + len(name) + context]) for s in spots):
            keep.append(name)
    return keep


# Words before a name in signatures, functions behind it, and labels of fields that hold one.
_NAME = r"[A-ZÄÖÜ][A-Za-zÄÖÜäöüßẞÉé'\-]{2,}"
_ROLE = r"im\s+auftrag|geschlossen:|anhörender\s+entscheider(?:/in)?|einzelentscheider(?:/in)?|sachbearbeiter(?:in)?|unterzeichner(?:in)?"
_FUNCTION = r"gründer(?:in)?|inhaber(?:in)?|ceo|geschäftsführer(?:in)?"
_FIELD = r"name|vorname(?:n)?|nachname|familienname|geburtsname|name\s+des\s+(?:antragstellers?|antragstellerin|kl[äa]gers?|kl[äa]gerin|kindes|sohnes|tochter|ehepartners?|ehegatten?)"
NAME_MARKS = (
    rf"\b(?iu:{_ROLE}|gez\.)[ \t]*[:\-]?[ \t]*({_NAME}(?:[ \t]+{_NAME}){{0,2}})\b",
    rf"(?m)^[ \t]*(?iu:{_ROLE}|(?:\(ggf\.\)\s*)?unterschrift[^\n]*)[ \t]*:?[ \t]*\n\s*({_NAME}(?:[ \t]+{_NAME}){{0,2}})[ \t]*$",
    rf"\b(?iu:hr\.?|herr|frau)\s+({_NAME}(?:\s+{_NAME}){{1,2}})\s*,?\s*(?iu:der|die)?\s*(?iu:{_FUNCTION})\b",
)
NAME_FIELD = rf"(?m)^[ \t]*(?iu:{_FIELD})[ \t]*[:\-][ \t]*([^\n]{{2,120}})$"


def marked_names(text: Column, known: Column, group_words: Sequence[str] = ("kläger", "behörde", "gericht", "amt", "familie")) -> Column:
    """The names beside signatures, functions and field labels of a text that ``known`` (array, may be null) lacks in any case of letters.

    A name has one to four words, no digit, slash or colon, and none of ``group_words`` in it. Null texts have none.
    """
    t = F.coalesce(text, F.lit(""))
    fields = F.transform(F.regexp_extract_all(t, F.lit(NAME_FIELD), F.lit(1)), lambda v: F.regexp_replace(F.regexp_replace(v, r"(?i)\bgeb\b.*$", ""), r"\([^)]*\)", " "))
    found = F.concat(*(F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in NAME_MARKS), fields)
    plain = F.transform(found, lambda v: F.regexp_replace(F.regexp_replace(v, r"\s+", " "), r"^[ .,:;/\-]+|[ .,:;/\-]+$", ""))
    held = F.transform(F.coalesce(known, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v)))

    def fits(v: Column) -> Column:
        ok = (v != "") & ~v.rlike(r"[0-9/:]") & (F.size(F.split(v, " ")) <= 4)
        for w in group_words:
            ok = ok & ~F.contains(F.lower(v), F.lit(w))
        return ok & ~F.array_contains(held, F.lower(v))

    named = F.filter(plain, fits)
    # of spellings that differ in the case of letters the first stays
    lower = F.transform(named, lambda v: F.lower(v))
    return F.filter(named, lambda v, i: F.array_position(lower, F.lower(v)) == i + 1)
