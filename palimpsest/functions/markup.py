"""Text of an HTML page, prepared for the contact matchers."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

DROPPED = ("script", "style", "svg", "noscript")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

# A company's or security's number after its label. Labels that are words as well ("ein", "inn", "nip") and the country before
# a number count in capitals only, or prose before digits would go.
REGISTERED = (
    r"\b(?:EIN|INN|NIP|(?i:UEN|ACRA|(?:Co(?:mpany)?[.\s]*)?Reg(?:istration)?[.\s]*(?:No|Number)?|Co(?:mpany)?[.\s]+(?:No|Number)|HR[BA]|Handelsregister|"
    r"VAT(?:[.\s]*(?:No|Number|Id))?|USt[\s.\-]?Id(?:Nr|N)?|ИНН|ОГРН|КПП|ОКПО|БИК|Tax\s*ID|CIN|BRN|ISIN|WKN|CUSIP|SEDOL|FIGI|"
    r"NIF|CIF|CNPJ|CPF|I[ČC]O|DI[ČC]|REGON|KvK|СНИЛС))[\s.:№#\-]*(?:[A-Z]{2,3})?[\s.:№#\-]*\d{6,}[A-Za-z]?\b",
    0,
)
# Shapes that phone matchers mistake for numbers, in the order in which they are blanked.
BLANKS = tuple(
    re.compile(p, f)
    for p, f in (
        (r"\b(?:UA|AW|DC)-\d{2,}(?:-\d+)?\b", 0),
        (
            r"\b(?:\d{1,2}\s*[./\-]\s*\d{1,2}\s*[./\-]\s*(?:19|20)\d{2}|(?:19|20)\d{2}\s*[./\-]\s*\d{1,2}\s*[./\-]\s*\d{1,2})"
            r"(?:\s*[T,;/\-]?\s*\d{1,2}\s*[:.]\s*\d{2}(?:\s*[:.]\s*\d{2})?)?\b|\b\d{1,2}:\d{2}(?::\d{2})?\b",
            0,
        ),
        (r"\(\s*\d{1,3}\s*\)\s*(?:19|20)\d{2}\b", 0),
        (r"\b((?:19|20)\d{2})\s+\1\b", 0),
        (r"\b\d{1,6}\s*/\s*(?:19|20)\d{2}\b", 0),
        (r"\b(?:19|20)\d{2}(?:\s+\d{1,2}){1,3}\b", 0),
        (r"(?<![\d.])-?\d{1,3}\.\d{4,}(?![\d.])", 0),
        REGISTERED,
        (r"\b[A-Z]{2}[A-Z0-9]{9}\d\b", 0),
        (r"\b\d{1,4}\s+\d{5}\b(?=\s+[A-ZÄÖÜ])", 0),
    )
)
SLASHED = (re.compile(r"\+\d[\d\s\-()/]{6,}\d"), re.compile(r"(?<!\d)\d{2,4}\s*/\s*\d{6,}(?!\d)"))
SPACE, DIGIT = re.compile(r"\s+"), re.compile(r"\d")


class _Page(HTMLParser):
    """Text nodes outside dropped elements, link targets, and protected addresses."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.links: list[str] = []
        self.protected: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        target = (given.get("href") or "").strip()
        if tag == "a" and target.lower().startswith("mailto:"):
            self.links.append(target[7:].partition("?")[0])
        elif tag == "a" and target.lower().startswith("tel:"):
            self.links.append(target[4:])
        if given.get("data-cfemail"):
            self.protected.append(given["data-cfemail"])
        if tag in DROPPED or self.inside and tag not in VOID:
            self.inside.append(tag)

    def handle_startendtag(self, tag, attrs):
        depth = len(self.inside)
        self.handle_starttag(tag, attrs)
        del self.inside[depth:]

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.inside:
            self.texts.append(data)


def decode_protected(token: str) -> str | None:
    """The address in a protected attribute, or None."""
    try:
        codes = bytes.fromhex(token)
    except ValueError:
        return None
    text = "".join(chr(c ^ codes[0]) for c in codes[1:])
    return text if "@" in text else None


def blanked(text: str) -> str:
    """text, of the same length, with the misleading shapes replaced by spaces."""
    for shape in BLANKS:
        text = shape.sub(lambda m: " " * len(m[0]), text)
    return text


def normalise(content: str | None) -> str:
    page = _Page()
    if content and "<" not in content and "&" not in content:
        page.texts.append(content)  # plain text is its own only node
    else:
        page.feed(content or "")
        page.close()
    text = html.unescape(" ".join(page.texts)).translate({0xFF20: "@", 0xFF0E: "."})
    text = " ".join(SPACE.split(text))
    if DIGIT.search(text):  # every shape holds one
        text = blanked(text)
        for shape in SLASHED:
            text = shape.sub(lambda m: m[0].replace("/", " "), text)
    return "\n".join([text, *page.links, *filter(None, map(decode_protected, page.protected))])
