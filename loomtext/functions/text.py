"""Text functions as Column expressions; patterns stay in the subset that Java and RE2 read alike."""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond ASCII that documents carry.
BLANK = r"[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]"
#: Accented Latin letters and their base letters, in step.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return strip(F.regexp_replace(c, f"{BLANK}+", " "))


def hash_form(c: Column) -> Column:
    """The form that content hashes are taken of: no soft hyphens, line-end hyphens closed, white space collapsed, lower case."""
    joined = F.regexp_replace(F.regexp_replace(c, r"\x{00AD}", ""), r"-[ \t]*\n[ \t]*", "")
    return F.lower(collapse(joined))


def content_sha(c: Column, boilerplate: str | None = None) -> Column:
    """Hash of a text's form; lines that ``boilerplate`` matches do not count."""
    return F.sha2(hash_form(drop_lines(c, boilerplate) if boilerplate else c), 256)


def fold(c: Column) -> Column:
    """Lower case with umlauts spelled out, for matching."""
    out = F.lower(c)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unaccent(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def drop_lines(c: Column, pattern: str) -> Column:
    """Without the lines that a pattern matches."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(pattern)), "\n")


def scrub(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered replacements."""
    for pattern, token in rules:
        c = F.regexp_replace(c, pattern, token)
    return c


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def codes(c: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that match, in the order given."""
    return F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(name)) for name, p in patterns.items())))


_SIX = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _character(code: Column) -> Column:
    """The character of a code point; of the control range the one that browsers show, the replacement character for what is none."""
    shown = {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)} | {0: "\ufffd"}
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    odd = F.element_at(F.create_map(*(F.lit(x) for k, v in shown.items() for x in (k, v))), code.cast("int"))
    return F.when(code.between(0x80, 0x9F) | (code == 0), odd).when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd").otherwise(plain)


def unescape(c: Column) -> Column:
    """Character references decoded: all names of HTML 5, decimal and hexadecimal ones; of names without a semicolon those that need none.

    Texts with no others than the six most common take a shorter way.
    """
    names = json.dumps({n: v for n, v in sorted(html5.items(), key=lambda x: (x[0] not in ("amp;", "nbsp;", "quot;", "lt;", "gt;"), x[0])) if n.endswith(";")})
    known = F.from_json(F.lit(names), "map<string,string>")
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    bare_known = F.from_json(F.lit(json.dumps({n: html5[n] for n in bare})), "map<string,string>")

    def decoded(part: Column) -> Column:
        number, hexed = F.regexp_extract(part, r"^#([0-9]{1,10})", 1), F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]{1,8})", 1)
        name, short = F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*;)", 1), F.regexp_extract(part, f"^({'|'.join(bare)})", 1)
        rest = lambda n: F.substring(part, n + 1, F.length(part))
        numeric = lambda code, pattern: F.concat(_character(code), F.regexp_replace(part, pattern, ""))
        return (
            F.when(number != "", numeric(number.cast("long"), r"^#[0-9]{1,10};?"))
            .when(hexed != "", numeric(F.conv(hexed, 16, 10).cast("long"), r"^#[xX][0-9a-fA-F]{1,8};?"))
            .when((name != "") & F.map_contains_key(known, name), F.concat(F.try_element_at(known, name), rest(F.length(name))))
            .when(short != "", F.concat(F.try_element_at(bare_known, short), rest(F.length(short))))
            .otherwise(F.concat(F.lit("&"), part))
        )

    def every(x: Column) -> Column:
        parts = F.split(x, "&")
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), decoded), ""))

    def plain(x: Column) -> Column:
        six = x
        for a, b in _SIX:
            six = F.replace(six, F.lit(a), F.lit(b))
        return F.when(x.rlike(r"&(?!(?:nbsp|lt|gt|quot|amp|#39);)[#A-Za-z]"), every(x)).otherwise(six)

    # bound once, as what gives the text would otherwise be repeated
    return F.get(F.transform(F.array(c), plain), F.lit(0))


def visible_text(html: Column) -> Column:
    """Text of an HTML page: without scripts, styles, comments and tags, character references decoded, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return collapse(unescape(out))


def trim_url(url: Column) -> Column:
    """Without blanks at the ends and trailing closing punctuation."""
    return F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"[).,;]+$", "")


#: Query parameters that are dropped when their name starts with one of these.
TRACKING = ("utm_", "gclid", "fbclid", "mc_", "ref", "source")


def _form_encoded(c: Column) -> Column:
    """As a form sends it: a space as plus, everything but letters, digits and ``_.-~`` by its bytes."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Scheme, host in lower case without ``www.``, path, and the query without tracking parameters; no fragment.

    Parameters are decoded and encoded again, so that ``q=%C3%A4`` and ``q=ä`` are one; one without ``=`` has an empty value. What cannot be
    decoded stays as it is.
    """
    u = F.regexp_replace(trim_url(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r"^www\.", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    plain = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    pairs = F.transform(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: p != ""), lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), plain(F.when(F.contains(p, F.lit("=")), F.substring(p, F.position(F.lit("="), p) + 1, F.length(p))).otherwise("")).alias("v")))
    own = F.filter(pairs, lambda p: ~F.lower(p["k"]).rlike("^(" + "|".join(TRACKING) + ")"))
    kept = F.array_join(F.transform(own, lambda p: F.concat(_form_encoded(p["k"]), F.lit("="), _form_encoded(p["v"]))), "&")
    return F.when(host == "", u).otherwise(F.concat(scheme, F.lit("://"), host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def url_identity(url: Column) -> Column:
    """What two citations of one page share: host in lower case without ``www.`` and the scheme's default port, path without trailing slashes, query.

    Case of path and query stays, as these tell decisions apart. Without ``//`` there is no host, as a URL parser has it.
    """
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    part = lambda k: F.regexp_extract(u, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?]*))?([^?]*)(\?.+)?", k)
    scheme, host = F.lower(part(1)), F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    host = F.when(scheme.isin("https", ""), F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    return F.concat(host, F.regexp_replace(part(3), "/+$", ""), part(4))


def title_key(title: Column) -> Column:
    """Letters and digits of a title with single spaces, 160 characters at most."""
    return F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9äöüß]+", " ")), 1, 160)


def contains_any(c: Column, tokens: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | c.contains(t)
    return out
