"""Text of office files, mails, HTML, wiki markup and law XML, by the standard library, in Arrow batches."""

from __future__ import annotations

import email
import email.policy
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .tables import files


def office_text(data: bytes) -> str:
    """Paragraphs of an ODT or DOCX file, one a line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        member = "content.xml" if "content.xml" in z.namelist() else "word/document.xml"
        root = ElementTree.fromstring(z.read(member))
    out = ["".join(node.itertext()) for node in root.iter() if node.tag.rsplit("}", 1)[-1] in ("p", "h")]
    return "\n".join(x for x in (t.strip() for t in out) if x)


def mail_text(data: bytes) -> str:
    """Header lines, attachments and body of a mail."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    lines = [f"{h}: {message[h]}" for h in ("From", "To", "Date", "Subject") if message[h]]
    lines += [f"Attachment: {a.get_filename()}" for a in message.iter_attachments() if a.get_filename()]
    body = message.get_body(("plain", "html"))
    text = body.get_content().strip() if body else ""
    if body is not None and body.get_content_subtype() == "html":
        text = html_to_markdown(text)
    return "\n".join(lines) + "\n\n" + text


class _Markdown(HTMLParser):
    hidden = {"script", "style", "noscript", "head"}

    def __init__(self):
        super().__init__()
        self.blocks: list[str] = [""]
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.hidden:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.blocks.append("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.blocks.append("- ")
        elif tag in ("p", "div", "ul", "ol", "table", "tr", "br"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag in self.hidden:
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]|p|div|li|ul|ol|tr|table", tag):
            self.blocks.append("")

    def handle_data(self, data):
        if not self.skip:
            self.blocks[-1] += data


def html_to_markdown(page: str) -> str:
    """Headings, paragraphs and list items of a page."""
    parser = _Markdown()
    parser.feed(page)
    return "\n\n".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in parser.blocks) if x.strip("#- "))


def _plain(node: ElementTree.Element | None) -> str:
    return "" if node is None else " ".join("".join(node.itertext()).replace("\xa0", " ").split())


def law_xml(data: str, abbreviation: str = "", provision: str = r"(?:§|Art)") -> tuple[str, str]:
    """(Markdown, version) of a law: its title and each provision under its number and title; the version is the build date.

    Files that declare entities are refused, as such declarations can grow without bound. Norms whose number does not begin like a
    ``provision`` (tables of contents, annexes) are left out.
    """
    if re.search("<!ENTITY", data, re.IGNORECASE):
        raise ValueError("a law file must not declare entities")
    root = ElementTree.fromstring(data)
    built = re.match(r"(\d{4})(\d\d)(\d\d)", (root.get("builddate") or "").strip())
    norms = root.findall("norm")
    if root.tag != "dokumente" or not built or not norms:
        raise ValueError("not a law file: no <dokumente> with a build date and norms")
    title = _plain(norms[0].find("metadaten/langue")) or abbreviation
    out = [f"# {title} ({abbreviation})" if abbreviation else f"# {title}"]
    for norm in norms:
        number = _plain(norm.find("metadaten/enbez"))
        if not re.match(provision, number):
            continue
        out.append(f"### {number} {_plain(norm.find('metadaten/titel'))}".rstrip())
        content = norm.find("textdaten/text/Content")
        out += [p for p in map(_plain, content.iter("P") if content is not None and content.find(".//P") is not None else [content]) if p]
    return "\n\n".join(out), "-".join(built.groups())


def law_xml_to_markdown(data: str) -> str:
    return law_xml(data)[0]


def _link(m: re.Match) -> str:
    """A link's name; an outside target stays beside it, an inside one without a name gives its last part."""
    target, name = (m[1] or "").strip(), (m[2] or "").strip()
    if re.match("https?://", target):
        return f"{name} ({target})" if name else target
    return name or target.rsplit(":", 1)[-1].split("#")[0].replace("_", " ").strip() or target


#: Inline markup in the order in which it is taken away.
_INLINE: tuple[tuple[str, object], ...] = (
    (r"(?is)<(code|file|nowiki|html)\b[^>]*>(.*?)</\1>", r"\2"),
    (r"(?is)<note\b[^>]*>(.*?)</note>", lambda m: f"Hinweis: {m[1].strip()}"),
    (r"\{\{([^}]*)\}\}", lambda m: m[1].partition("|")[2].strip()),
    (r"\[\[([^\]|]+?)(?:\|([^\]]*))?\]\]", _link),
    (r"(?s)\(\((.+?)\)\)", lambda m: f" (Fn: {m[1].strip()})"),
    (r"(?s)\*\*(.+?)\*\*", r"\1"),
    (r"(?s)__(.+?)__", r"\1"),
    (r"(?s)''(.+?)''", r"\1"),
    (r"(?s)(?<!:)//(.+?)(?<!:)//", r"\1"),  # not the slashes of a URL
    (r"</?[A-Za-z][^>\n]*>", ""),
)


def _line(line: str) -> str | None:
    if head := re.fullmatch(r"\s*(={2,6})\s*(.+?)\s*=+\s*", line):
        return f"{'#' * (7 - len(head[1]))} {head[2]}"
    if line.strip()[:1] in ("^", "|") and line.strip():
        return " | ".join(c for c in map(str.strip, re.split(r"[\^|]", line)) if c not in ("", ":::")) or None
    return re.sub(r"^\s{2,}[*-]\s+", "- ", line).rstrip()


def clean_markup(text: str) -> str:
    """Wiki markup as plain text with ``#`` headings: notes, footnotes, captions and outside link targets stay, unknown tags lose their brackets only."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    for pattern, to in _INLINE:
        text = re.sub(pattern, to, text)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x for x in map(_line, text.split("\n")) if x is not None)).strip()


def salvage_json(text: str) -> list[dict]:
    """The complete objects of a JSON array, also of one that is cut off or surrounded by prose."""
    decoder, out, at = json.JSONDecoder(), [], text.find("[") + 1
    while (at := text.find("{", at)) >= 0:
        try:
            value, at = decoder.raw_decode(text, at)
            out.append(value)
        except json.JSONDecodeError:
            at += 1
    return out


_READERS = {"odt": office_text, "docx": office_text, "eml": mail_text, "html": lambda b: html_to_markdown(b.decode("utf-8", "replace")), "xml": lambda b: law_xml_to_markdown(b.decode("utf-8", "replace")), "txt": lambda b: b.decode("utf-8", "replace")}


def extract(spark: SparkSession, folder: str, more: dict | None = None) -> DataFrame:
    """(path, sha, text, error) of every file below a folder that some reader knows; ``more`` adds readers, such as one for PDF or scans."""
    readers = _READERS | (more or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, hashlib.sha256(data).hexdigest(), readers[path.rsplit(".", 1)[-1].lower()](data), None))
                except Exception as x:  # noqa: BLE001  a broken file is a row with its error
                    rows.append((path, hashlib.sha256(data).hexdigest(), None, f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(rows, columns=["path", "sha", "text", "error"])

    return files(spark, folder, sorted(readers)).select("path", "content").mapInPandas(run, "path string, sha string, text string, error string")
