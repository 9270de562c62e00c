"""Phone numbers in text, without a phone library: a subset of the public numbering plans.

Every region that a domain can name has its calling code, lengths and a pattern of its numbers; most have a grouping. A number written
with + only has to be of a possible length; one without must be valid for a region, and hold the prefix that is dialled within the country
where that isn't left out in writing. Patterns are by leading digits, so they say what can be a number there, not which are in use.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from . import vocabulary as V


@dataclass(frozen=True)
class Plan:
    code: str
    lengths: tuple[int, ...]
    #: National numbers that can be in use.
    valid: str
    #: What is dialled before a national number; which numbers count when written without it (all, none, or a pattern).
    trunk: str = "0"
    bare: bool | str = True
    local: tuple[int, ...] = ()
    #: Pattern of the leading digits, and the sizes of groups with what follows each.
    groups: tuple[tuple[str, str], ...] = ()
    abroad: str = "00"


# Numbering plans.
CODES = {
    "RU": "7", "BY": "375", "UA": "380", "KZ": "7", "MD": "373", "UZ": "998", "TJ": "992", "KG": "996", "TM": "993", "AM": "374", "AZ": "994", "GE": "995", "GB": "44", "IE": "353",
    "DE": "49", "AT": "43", "CH": "41", "FR": "33", "BE": "32", "LU": "352", "NL": "31", "IT": "39", "ES": "34", "PT": "351", "GR": "30", "PL": "48", "CZ": "420", "SK": "421",
    "HU": "36", "RO": "40", "BG": "359", "HR": "385", "SI": "386", "RS": "381", "BA": "387", "MK": "389", "AL": "355", "EE": "372", "LV": "371", "LT": "370", "SE": "46", "NO": "47",
    "FI": "358", "DK": "45", "IS": "354", "US": "1", "CA": "1", "AU": "61", "NZ": "64", "ZA": "27", "TR": "90", "IL": "972", "AE": "971", "SA": "966", "QA": "974", "KW": "965",
    "BH": "973", "OM": "968", "JO": "962", "LB": "961", "EG": "20", "JP": "81", "CN": "86", "HK": "852", "TW": "886", "KR": "82", "SG": "65", "MY": "60", "TH": "66", "VN": "84",
    "ID": "62", "PH": "63", "IN": "91", "PK": "92", "BD": "880", "LK": "94", "MX": "52", "BR": "55", "AR": "54", "CL": "56", "PE": "51", "VE": "58", "UY": "598", "PY": "595",
    "BO": "591", "EC": "593", "NG": "234", "KE": "254", "GH": "233", "MA": "212", "TN": "216", "DZ": "213",
}
NANP = Plan("1", (10,), r"[2-9]\d{2}[2-9]\d{6}", "1", local=(7,), groups=(("", "3-3-4"),), abroad="011")
FULL = {
    "RU": Plan("7", (10,), r"(?:3(?:0[12]|4[1-35-79]|5[1-3]|65|8[1-58]|9[0145])|4(?:01|1[1356]|2[13467]|7[1-5]|8[1-7]|9[1-689])|8(?:0[04]|1[1-8]|2[01]|3[13-6]|4[0-8]|5[15]|6[0-35-79]|7[1-37-9])|9\d\d)\d{7}", "8", groups=(("", "3 3-2-2"),), abroad="810"),
    "KZ": Plan("7", (10, 14), r"(?:33622|7\d{4})\d{5}", "8", local=(5, 6, 7), groups=(("", "3 3-2-2"),), abroad="810"),
    "BY": Plan("375", (6, 7, 8, 9, 10, 11), r"(?:1[5-7]\d|2(?:1\d|2[1-6]|3[2-5])|25\d|29[1-9]|(?:33|44)\d)\d{6}", "8", False, (5,), (("(?:25|29|33|44|17)", "2 3-2-2"), ("", "3 2-2-2")), "810"),
    "UA": Plan("380", (9, 10), r"(?:[3-6]\d|7[37]|9[1-9]|89)\d{7}", "0", False, (5, 6, 7), (("(?:39|44|50|6[36-8]|7[37]|9[1-9])", "2 3 4"), ("", "3 3 3"))),
    "US": NANP,
    "CA": NANP,
    "GB": Plan("44", (9, 10), r"(?:1\d{8,9}|[23]\d{9}|7[1-57-9]\d{8}|8\d{9}|9[018]\d{8})", "0", False, (4, 5, 6, 7, 8), (("2", "2 4 4"), ("(?:11|1\\d1|3|8|9)", "3 3 4"), ("", "4 6"))),
    "DE": Plan("49", tuple(range(4, 16)), r"(?:1(?:5\d{9}|6[023]\d{7,8}|7\d{8,9})|[2-9]\d{5,12})", "0", False, (2, 3), (("15", "4 *"), ("1[67]", "3 *"), ("(?:30|40|69|89)", "2 *"), ("[2-9]\\d1", "3 *"), ("", "4 *"))),
    "FR": Plan("33", (9,), r"[1-9]\d{8}", "0", False, groups=(("8", "3 2 2 2"), ("", "1 2 2 2 2"))),
    "SG": Plan("65", (8, 10, 11), r"[3689]\d{7}", "", groups=(("", "4 4"),), abroad="000"),
}
#: The other regions: lengths, national numbers, prefix, numbers written without it ("all", "none" or a pattern), grouping by leading digits.
OTHERS = {
    "MD": ("8", r"[2-9]\d{7}", "0", "none", "2[12]:2 3 3;:3 2 3"),
    "UZ": ("9", r"(?:20|33|50|55|6[125-79]|7[1-79]|88|9[0-57-9])\d{7}", "", "all", ":2 3 2 2"),
    "TJ": ("9", r"(?:00|1[179]|2[0-2]|3\d|4\d|5[05]|7[0-8]|8[0-8]|9\d)\d{7}", "", "all", ":2 3 4"),
    "KG": ("9", r"(?:[2357]\d\d|880|99\d)\d{6}", "0", "none", ":3 3 3"),
    "TM": ("8", r"[1-7]\d{7}", "8", "none", "6:2 6;:2 2-2-2"),
    "AM": ("8", r"(?:[1-49]\d|55|60|77|80)\d{6}", "0", "none", ":2 6"),
    "AZ": ("9", r"(?:1[28]|2[0-6]|36|4[04]|5[015]|60|70|77|88|99)\d{7}", "0", "none", ":2 3 2 2"),
    "GE": ("9", r"(?:[34]\d\d|5\d\d|7\d\d|800)\d{6}", "0", r"5\d{8}", ":3 2 2 2"),
    "IE": ("7 8 9", r"(?:1\d{7}|[24-79]\d{6,8}|8[35-9]\d{7})", "0", "none", "1:1 3 4;:2 3 4"),
    "AT": ("4 5 6 7 8 9 10 11 12 13", r"(?:1\d{6,12}|[2-57-9]\d{5,11}|6\d{6,12})", "0", "none", "1:1 *;:3 *"),
    "CH": ("9", r"(?:2[12467]|3[1-4]|4[134]|5[1256]|6[12]|7[46-9]|8[01478]|9[01])\d{7}", "0", "none", ":2 3 2 2"),
    "BE": ("8 9", r"(?:4[5-9]\d{7}|[1-35-9]\d{7})", "0", "none", "4[5-9]:3 2 2 2;[23]:1 3 2 2;:2 2 2 2"),
    "LU": ("5 6 8 9", r"(?:2[2-9]\d{4}(?:\d\d)?|6[2679][18]\d{6}|[3-57-9]\d{5})", "", "all", "6:3 3 3;:2 2 2 *"),
    "NL": ("9", r"(?:[1-57]\d|6[1-58]|8[58])\d{7}", "0", "none", "6:1 8;[1-57][035]:2 3 4;:3 3 3"),
    "IT": ("6 7 8 9 10 11", r"(?:0[1-9]\d{4,9}|3[1-9]\d{7,8}|80[03]\d{6})", "", "all", "0[26]:2 4 *;:3 3 *"),
    "ES": ("9", r"(?:6\d|7[1-4]|[89][1-9]|[89]0)\d{7}", "", "all", ":3 2 2 2"),
    "PT": ("9", r"(?:2\d|9[1-36]|[78]0)\d{7}", "", "all", "2[12]:2 3 4;:3 3 3"),
    "GR": ("10", r"(?:2[1-8]\d|6[89]\d|800)\d{7}", "", "all", "21:2 4 4;:3 3 4"),
    "PL": ("9", r"(?:1[2-8]|2[2-69]|3[2-4]|4[1-468]|5[0-9]|6[0-35-9]|7[1-9]|8[1-9]|9[145])\d{7}", "", "all", "(?:5[013]|6[069]|7[2389]|88):3 3 3;:2 3 2 2"),
    "CZ": ("9", r"(?:[2-5]\d|60|7[02-9]|80|9[0-7])\d{7}", "", "all", ":3 3 3"),
    "SK": ("9", r"(?:[2-5]\d|9[0-24-9]|80)\d{7}", "0", "none", "2:1 *;:3 3 3"),
    "HU": ("8 9", r"(?:1\d{7}|[2-9]\d{7}|(?:20|30|31|50|70)\d{7})", "06", "none", "1:1 3 4;:2 3 *"),
    "RO": ("9", r"(?:[23]\d|7[0-8]|[89]0)\d{7}", "0", "none", "[23]1:2 3 4;:3 3 3"),
    "BG": ("7 8 9", r"(?:2\d{5,7}|[3-7]\d{6,7}|8[789]\d{7}|98[89]\d{6}|800\d{5})", "0", "none", "2:1 3 *;[89]:2 3 *;:2 3 *"),
    "HR": ("8 9", r"(?:[1-5]\d{7}|9[1-9]\d{6,7}|800\d{5,6})", "0", "none", "1:1 4 3;:2 3 *"),
    "SI": ("8", r"(?:[1-57][2-8]|[34][01]|51|6[4-9]|7[01]|80)\d{6}", "0", "none", "[37][01]|4[01]|51|6[4-9]:2 3 3;:1 3 2 2"),
    "RS": ("8 9", r"(?:[1-3]\d{6,8}|6[0-689]\d{6,7}|800\d{5})", "0", "none", ":2 *"),
    "BA": ("8 9", r"(?:[35]\d{7}|6[0-7]\d{6,7}|80\d{6})", "0", "none", "6[1-7]:2 3 *;:2 3-3"),
    "MK": ("8", r"(?:2\d|3[1-4]|4[2-8]|7\d|[58]0)\d{6}", "0", "none", "2:1 3 4;:2 3 3"),
    "AL": ("8 9", r"(?:4\d{7}|[2358]\d{7}|6[6-9]\d{7})", "0", "none", "4:1 3 4;6:2 3 4;:2 *"),
    "EE": ("7 8", r"(?:3[23589]|4[3-8]|6\d|7[1-9]|88)\d{5}|5\d{6,7}|800\d{4,5}", "", "all", "5:4 *;:3 4"),
    "LV": ("8", r"(?:2\d|6[3-8]|8[01]|90)\d{6}", "", "all", ":2 3 3"),
    "LT": ("8", r"(?:[3-6]\d|7[08]|800)\d{5,6}", "0", "none", "6:3 5;:2 6"),
    "SE": ("7 8 9", r"(?:1\d{7,8}|[2-6]\d{6,8}|7[02369]\d{7}|8\d{6,8}|9\d{7,8})", "0", "none", "8:1 *;:2 3 2 *"),
    "NO": ("8", r"(?:2[1-4]|3[1-35-8]|4\d|5[1-35-9]|6\d|7[0-8]|80|9\d)\d{6}", "", "all", "[489]:3 2 3;:2 2 2 2"),
    "FI": ("5 6 7 8 9 10 11", r"(?:[1-35689]\d{5,9}|4\d{5,9}|50\d{4,8}|7\d{4,8})", "0", "none", "[45]:2 *;:2 *"),
    "DK": ("8", r"[2-9]\d{7}", "", "all", ":2 2 2 2"),
    "IS": ("7 9", r"(?:[4-8]\d{6}|38\d{7})", "", "all", "[4-8]:3 4;:3 3 3"),
    "AU": ("9 10", r"(?:[2378]\d{8}|4\d{8}|1[38]00\d{6})", "0", r"1[38]00\d{6}", "4:3 3 3;1:4 3 3;:1 4 4"),
    "NZ": ("8 9 10", r"(?:[34679]\d{7}|2\d{7,9}|800\d{6,7})", "0", "none", "2:2 3 *;:1-3 4"),
    "ZA": ("9", r"[1-8]\d{8}", "0", "none", ":2 3 4"),
    "TR": ("10", r"(?:[2-4]\d|50|5[1-6]|59|8[05])\d{8}", "0", "none", ":3 3 2 2"),
    "IL": ("8 9", r"(?:[2-489]\d{7}|5\d{8}|7[2-9]\d{7})", "0", "none", "[57]:2-3-4;:1-3-4"),
    "AE": ("8 9", r"(?:[2-4679][2-8]\d{6}|5[024-68]\d{7}|800\d{5,6})", "0", "none", "5:2 3 4;:1 3 4"),
    "SA": ("9", r"(?:1[1-7]|5\d|80)\d{7}", "0", "none", ":2 3 4"),
    "QA": ("8", r"(?:3[0-9]|4[04]|5[0-9]|6[0-9]|7[0-9])\d{6}", "", "all", ":4 4"),
    "KW": ("8", r"(?:2[2-5]|[4569]\d)\d{6}", "", "all", "2:4 4;:3 5"),
    "BH": ("8", r"(?:1[3678]|3\d|6[0-9]|77)\d{6}", "", "all", ":4 4"),
    "OM": ("8", r"(?:2[1-6]|7[1-9]|9[1-9])\d{6}", "", "all", "2:2 6;:4 4"),
    "JO": ("8 9", r"(?:[2356]\d{7}|7[0789]\d{7})", "0", "none", "7:1 4 4;:1 3 4"),
    "LB": ("7 8", r"(?:[14-9]\d{6}|3\d{6}|7[01689]\d{6}|81\d{6})", "0", "none", "(?:7|81):2 3 3;:1 3 3"),
    "EG": ("8 9 10", r"(?:1[0-25]\d{8}|[23]\d{8}|[4-69]\d{7,8}|800\d{7})", "0", "none", "1:2 *;[23]:1 *;:2 *"),
    "JP": ("9 10", r"(?:[789]0\d{8}|[1-9]\d{8})", "0", "none", "[789]0:2-4-4;[36]:1-4-4;:2-3-4"),
    "CN": ("10 11", r"(?:1[3-9]\d{9}|10\d{8}|2\d{9}|[3-9]\d{9,10})", "0", r"1[3-9]\d{9}", "1[3-9]:3 4 4;(?:10|2):2 4 4;:3 4 *"),
    "HK": ("8", r"[235-9]\d{7}", "", "all", ":4 4"),
    "TW": ("8 9", r"(?:[2-8]\d{7,8}|9\d{8})", "0", "none", "9:3 3 3;2:1 4 4;:1 *"),
    "KR": ("8 9 10", r"(?:2\d{7,8}|[3-6][1-5]\d{7,8}|1[016-9]\d{7,8}|70\d{8})", "0", "none", "2:1-4-4;:2-4-4"),
    "MY": ("8 9 10", r"(?:1\d{8,9}|3\d{8}|[4-79]\d{7}|8\d{7})", "0", "none", "1[02-46-9]:2-3 4;3:1-4 4;:1-3 4"),
    "TH": ("8 9", r"(?:[2-57]\d{7}|[689]\d{8})", "0", "none", "[689]:2 3 4;2:1 3 4;:2 3 3"),
    "VN": ("9 10", r"(?:2\d{9}|[35789]\d{8})", "0", "none", "2[48]:2 4 4;2:3 4 3;:3 3 3"),
    "ID": ("8 9 10 11 12", r"(?:8\d{8,10}|[2-79]\d{7,9})", "0", "none", "8:3-4-*;2[124]|31:2 *;:3 *"),
    "PH": ("8 9 10", r"(?:2\d{7,8}|[3-8]\d{7,8}|9\d{9})", "0", "none", "9:3 3 4;2:1 4 4;:2 3 4"),
    "IN": ("10", r"[1-9]\d{9}", "0", r"[6-9]\d{9}", "[6-9]:5 5;:2 4 4"),
    "PK": ("9 10", r"(?:3\d{9}|[2-9]\d{8,9})", "0", "none", "3:3 7;:2 *"),
    "BD": ("8 9 10", r"(?:1[3-9]\d{8}|[2-9]\d{7,8})", "0", "none", "1:4-6;:1-*"),
    "LK": ("9", r"(?:[1-6]\d|7[0-8]|8[17]|91)\d{7}", "0", "none", "7:2 3 4;:2 3 4"),
    "MX": ("10", r"[2-9]\d{9}", "", "all", "(?:33|5[56]|81):2 4 4;:3 3 4"),
    "BR": ("10 11", r"[1-9][1-9](?:9\d{8}|[2-5]\d{7})", "0", "all", "..9:2 5-4;:2 4-4"),
    "AR": ("10 11", r"(?:9\d{10}|11\d{8}|[23]\d{9})", "0", "none", "911:1 2 4-4;9:1 3 3-4;11:2 4-4;:3 3-4"),
    "CL": ("9", r"(?:2\d|[3-7]\d|9[2-9])\d{7}", "", "all", "9:1 4 4;2:1 4 4;:2 3 4"),
    "PE": ("8 9", r"(?:9\d{8}|1\d{7}|[4-8]\d{7})", "0", r"9\d{8}", "9:3 3 3;1:1 7;:2 6"),
    "VE": ("10", r"(?:2\d\d|4[12]\d|[58]00)\d{7}", "0", "none", ":3-7"),
    "UY": ("8", r"(?:[24]\d|9[1-9])\d{6}", "0", r"[24]\d{7}", "9:2 3 3;:4 4"),
    "PY": ("9", r"(?:9[6-9]\d|[2-8]\d\d)\d{6}", "0", "none", "9:3 6;:2 3 4"),
    "BO": ("8", r"[2-467]\d{7}", "0", "all", "[67]:8;:1 7"),
    "EC": ("8 9", r"(?:[2-7]\d{7}|9\d{8})", "0", "none", "9:2 3 4;:1-3-4"),
    "NG": ("8 10", r"(?:[7-9][01]\d{8}|[1-9]\d{7})", "0", "none", "[7-9][01]:3 3 4;:1 3 4"),
    "KE": ("9", r"(?:[17]\d{8}|[2-6]\d{8})", "0", "none", "[17]:3 6;:2 7"),
    "GH": ("9", r"[235]\d{8}", "0", "none", ":2 3 4"),
    "MA": ("9", r"[5-8]\d{8}", "0", "none", "[67]:3-6;:3-6"),
    "TN": ("8", r"[2-57-9]\d{7}", "", "all", ":2 3 3"),
    "DZ": ("8 9", r"(?:[1-4]\d{7}|[5-7]\d{8}|9[68]\d{6})", "0", "none", "[5-7]:3 2 2 2;:2 2 2 2"),
}


def _other(region: str) -> Plan:
    lengths, valid, trunk, bare, shapes = OTHERS[region]
    groups = tuple(tuple(g.rsplit(":", 1)) for g in shapes.split(";"))
    return Plan(CODES[region], tuple(map(int, lengths.split())), valid, trunk, {"all": True, "none": False}.get(bare, bare), groups=groups)


PLANS = {r: FULL.get(r) or _other(r) for r in CODES}
REGIONS_BY_CODE: dict[str, list[str]] = {}
for _region, _plan in sorted(PLANS.items(), key=lambda p: (p[0] not in ("RU", "US"), p[0])):
    REGIONS_BY_CODE.setdefault(_plan.code, []).append(_region)

_GAP = r"[-x‐-―−ー－／  ­​⁠　()（）［］.\[\]/~⁓∼～]{0,4}"
CANDIDATE = re.compile(rf"(?:[(\[（［+＋]{_GAP}){{0,2}}\d{{1,20}}(?:{_GAP}\d{{1,20}}){{0,20}}")
#: Where a candidate that isn't a number as a whole may be cut.
INNER = (re.compile(r"/+"), re.compile(r"\s+-\s*|-\s+"), re.compile(r"\.\.+"), re.compile(r"\s+"))
DATE = re.compile(r"\s*(?:\d{1,2}[./\-]\d{1,2}[./\-]\d{4}|\d{4}[./\-]\d{1,2}[./\-]\d{1,2})\s*")
BARE = re.compile(r"(?<!\d)\d{2,4}\s+\d{6,}(?!\d)")
IN_WORD = re.compile(r"[A-Za-zÀ-ɏ%$£€¥]")
SLASH_DATE = re.compile(r"(?:[0-3]?\d/[01]?\d|[01]?\d/[0-3]?\d)/(?:[12]\d)?\d{2}")


def is_date(text: str) -> bool:
    """Whether a text as a whole is a calendar date with a year of four digits."""
    return DATE.fullmatch(text) is not None


@dataclass(frozen=True)
class Number:
    code: str
    national: str
    #: Whether the text held the prefix that is dialled within the country.
    trunk: bool = False

    @property
    def e164(self) -> str:
        return f"+{self.code}{self.national}"

    def plans(self) -> list[Plan]:
        return [PLANS[r] for r in REGIONS_BY_CODE[self.code]]

    def possible(self, local: bool = True) -> bool:
        """Whether a number may be as long as this; `local` counts what can be dialled within an area only."""
        return any(len(self.national) in (p.lengths + p.local * local) for p in self.plans())

    def valid(self) -> bool:
        return any(re.fullmatch(p.valid, self.national) and len(self.national) in p.lengths for p in self.plans())


def _split_code(digits: str) -> tuple[str, str] | None:
    for n in (1, 2, 3):
        if digits[:n] in REGIONS_BY_CODE:
            return digits[:n], digits[n:]
    return None


def parse(text: str, region: str | None) -> Number | None:
    """The number that a text is: international, or in the plan of `region`; None if it is neither."""
    digits = re.sub(r"\D", "", text)
    plan = PLANS.get(region or "")
    foreign = bool(re.match(r"\s*[(\[]?\s*[+＋]", text))
    if not foreign and plan and plan.abroad and digits.startswith(plan.abroad) and _split_code(digits[len(plan.abroad) :]):
        digits, foreign = digits[len(plan.abroad) :], True
    if foreign:
        cut = _split_code(digits)
        if not cut or not 2 <= len(cut[1]) <= 17:
            return None
        code, national = cut
        own = PLANS[REGIONS_BY_CODE[code][0]]
        if own.trunk and own.trunk != "1" and national.startswith(own.trunk) and not Number(code, national).valid() and Number(code, national[len(own.trunk) :]).possible():
            national = national[len(own.trunk) :]
        return Number(code, national)
    if plan is None or not 2 <= len(digits) <= 17:
        return None
    whole = Number(plan.code, digits)
    if digits.startswith(plan.code) and not re.fullmatch(plan.valid, digits):
        rest = digits[len(plan.code) :]
        if re.fullmatch(plan.valid, rest) or len(digits) > max(plan.lengths):
            return Number(plan.code, rest)
    if plan.trunk and digits.startswith(plan.trunk):
        rest = digits[len(plan.trunk) :]
        if plan.code == "375" and rest.startswith("0"):
            rest = rest[1:]
        if re.fullmatch(plan.valid, rest) or not re.fullmatch(plan.valid, digits):
            return Number(plan.code, rest, True)
    return whole


def _accept(text: str, start: int, raw: str, region: str | None, strict: bool) -> Number | None:
    if SLASH_DATE.fullmatch(raw):
        return None
    number, plus = parse(raw, region), raw.lstrip("([（［ ").startswith(("+", "＋"))
    if number is None or not number.possible(local=not plus):
        return None
    if not strict:
        return number
    before, after = text[start - 1 : start], text[start + len(raw) : start + len(raw) + 1]
    foreign = number.code != PLANS[region].code or plus
    if not foreign and before and IN_WORD.match(before) or after and IN_WORD.match(after) or not number.valid():
        return None
    bare = PLANS[region].bare
    if not foreign and bare is not True and not number.trunk and number.national == re.sub(r"\D", "", raw) and not (bare and re.fullmatch(bare, number.national)):
        # Digits that want the prefix and lack it are a number only where they begin with the calling code.
        after = Number(number.code, number.national.removeprefix(number.code))
        return after if after != number and after.valid() else None
    return number


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches of a text that can hold numbers: six digits or more, or three with a plus. Found once, for all regions."""
    found: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        if found and found[-1][1] == m.start():
            found[-1] = (found[-1][0], m.end())
        else:
            found.append(m.span())
    return [(s, e) for s, e in found if (n := sum(map(str.isdigit, text[s:e]))) >= 6 or n >= 3 and ("+" in text[s:e] or "＋" in text[s:e])]


def matches(text: str, region: str | None, strict: bool, where: list[tuple[int, int]] | None = None) -> Iterable[tuple[int, str, Number]]:
    """start, text, number of all numbers in a text: of valid ones if strict, else of possible ones."""
    for at, end in zones(text) if where is None else where:
        while m := CANDIDATE.search(text, at, end):
            raw = m[0].rstrip("([（［ ")
            found = _accept(text, m.start(), raw, region, strict)
            if found:
                yield m.start(), raw, found
                at = m.start() + len(raw)
                continue
            hit = next(((m.start() + s, part, n) for s, part in _parts(raw) if (n := _accept(text, m.start() + s, part, region, strict))), None)
            if hit:
                yield hit
                at = hit[0] + len(hit[1])
            else:
                at = m.end()


def _parts(raw: str) -> Iterable[tuple[int, str]]:
    for cut in INNER:
        ends = [(0, 0), *(m.span() for m in cut.finditer(raw)), (len(raw), len(raw))]
        if len(ends) == 2:
            continue
        for (_, a), (b, _) in zip(ends, ends[1:], strict=False):
            if part := raw[a:b].strip(" -./"):
                yield raw.index(part, a), part
        # What comes after a number with a plus can be several groups of digits.
        for end, _ in ends[-2 : 0 if cut is INNER[-1] and "+" in raw else -3 : -1]:
            yield 0, raw[:end]


def phones(text: str, regions: Iterable[str] = V.PAGE_REGIONS) -> list[tuple[str, str]]:
    """E.164 form and literal text of each number of a normalised text, in order of the passes, once each."""
    found: dict[str, str] = {}
    where = zones(text)
    if not where:
        return []
    for _, raw, number in matches(text, None, False, where):
        if "+" in raw and not is_date(raw):
            found.setdefault(number.e164, raw)
    spans: list[tuple[int, int]] = []
    free = lambda s, e: all(e <= a or b <= s for a, b in spans)
    regions = [r for r in regions if r in PLANS]
    for region in regions:
        for start, raw, number in matches(text, region, True, where):
            if not is_date(raw) and free(start, start + len(raw)):
                spans.append((start, start + len(raw)))
                found.setdefault(number.e164, raw)
    for m in BARE.finditer(text):
        if free(*m.span()) and not is_date(m[0]):
            number = next((n for r in regions if (n := parse(m[0], r)) and n.possible()), None)
            if number:
                spans.append(m.span())
                found.setdefault(number.e164, m[0])
    return list(found.items())


def human(e164: str | None) -> str | None:
    """International grouping of an E.164 number; what isn't one stays as it is."""
    cut = _split_code(e164[1:]) if e164 and re.fullmatch(r"\+\d{4,17}", e164) else None
    if not cut:
        return e164
    code, national = cut
    plans = [PLANS[r] for r in REGIONS_BY_CODE[code]]
    plan = next((p for p in plans if re.fullmatch(p.valid, national)), plans[0])
    shape = next((g for lead, g in plan.groups if re.match(lead, national)), "*")
    sizes = re.findall(r"\d+|\*", shape)
    if "*" not in sizes and sum(map(int, sizes)) != len(national):
        return f"+{code} {national}"
    pieces, at = [], 0
    for size, after in re.findall(r"(\d+|\*)([ -]?)", shape):
        n = len(national) - at if size == "*" else int(size)
        pieces.append(national[at : at + n] + (after if at + n < len(national) else ""))
        at += n
    return f"+{code} " + "".join(pieces) + national[at:]
