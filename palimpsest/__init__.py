"""Spark-native mining of contacts in archived web pages."""

from typing import NamedTuple

from .operators.contacts import extract_contacts
from .plans.scan import Scan, scan


class Contact(NamedTuple):
    """A contact as it stands in a page: its canonical value and its literal form."""

    kind: str
    value: str
    raw: str


__all__ = ["Contact", "Scan", "extract_contacts", "scan"]
