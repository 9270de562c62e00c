import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest import extract_contacts
from palimpsest.functions import emails, markup, phones, urls
from palimpsest.operators import contacts
from palimpsest.operators.contacts import extract_emails, possible


def values(html, kind, regions=("RU", "US", "GB", "DE", "FR")):
    return [c["value"] for c in extract_contacts(html, regions) if c["kind"] == kind]


@pytest.mark.parametrize(
    ("html", "found"),
    [
        ("write to Sales@Example.com.", ["sales@example.com"]),
        ('<a href="MAILTO:shop@example.test?subject=x">mail</a>', ["shop@example.test"]),
        ("desk&#64;example.com and desk&amp;#64;example.org", ["desk@example.com", "desk@example.org"]),
        ("desk＠example．com", ["desk@example.com"]),
        ("desk [at] example [dot] com", ["desk@example.com"]),
        ("desk собака example точка com", ["desk@example.com"]),
        ("<b>desk</b><i>x@example.com</i>", ["x@example.com"]),
        ("pictures logo@2x.png and hero@3x.jpg", []),
        ("found at www.example.com", []),
        ("available at example.com", []),
        ("<script>a@example.com</script><style>b@example.com</style><svg><text>c@example.com</text></svg>", []),
        ("<!-- d@example.com -->", []),
    ],
)
def test_emails(html, found):
    assert values(html, "email") == found


def test_protected_addresses():
    token = "4a" + "".join(f"{ord(c) ^ 0x4A:02x}" for c in "info@example.com")
    assert markup.decode_protected(token) == "info@example.com"
    assert markup.decode_protected("zz") is None
    assert markup.decode_protected("") is None
    assert values(f'<span data-cfemail="{token}">x</span>', "email") == ["info@example.com"]


@pytest.mark.parametrize(
    ("text", "regions", "found"),
    [
        ("+1 (212) 555-0100", ("RU",), ["+12125550100"]),
        ("+375-33-354518", ("RU",), ["+37533354518"]),
        ("8 (495) 123-45-67", ("RU",), ["+74951234567"]),
        ("8-0162-51-12-54", ("BY",), ["+375162511254"]),
        ("+49175/5604673", ("DE",), ["+491755604673"]),
        ("020 7946 0958", ("GB",), ["+442079460958"]),
        ("01 42 68 53 00", ("FR",), ["+33142685300"]),
        ("12.05.2007", ("RU", "US"), []),
        ("opened 2020 / 06 / 19, 12:48", ("RU", "DE"), []),
        ("case 596/2014 and (75) 2018 and 2012 2012", ("DE", "RU"), []),
        ("UA-36441709-1", ("UA",), []),
        ("UEN: 200604351D and ИНН 7707083893", ("SG", "RU"), []),
        ("37.476600, -122.144000", ("US", "RU"), []),
        ("DE0007472060", ("DE",), []),
        ("postal code 225006", ("BY",), []),
        ("order 4567891, sku 998877 and 31337001", ("PL",), []),
        ("order 123456789, stock 4567891, sku 998877 and 31337001", ("IT",), []),
        ("order 123456789, stock 4567891, sku 998877 and 31337001", ("HU", "TR", "CN", "IN", "AR"), []),
        ("order 123456789", ("PL",), ["+48123456789"]),
        ("card 4785380592391139 from 198.51.100.7", ("RU", "US", "GB", "DE", "FR"), []),
    ],
)
def test_phones(text, regions, found):
    assert values(text, "phone", regions) == found


def test_phone_links_and_repeats():
    html = '<a href="tel:+12125550100">call</a> +1 212 555 0100 <script>+1 212 555 0199</script>'
    assert values(html, "phone") == ["+12125550100"]


@pytest.mark.parametrize(
    ("e164", "shown"),
    [("+12125550100", "+1 212-555-0100"), ("+74951234567", "+7 495 123-45-67"), ("+375291234567", "+375 29 123-45-67"), ("+442079460958", "+44 20 7946 0958"), ("+33142685300", "+33 1 42 68 53 00"), ("no number", "no number"), (None, None)],
)
def test_human_phone(e164, shown):
    assert phones.human(e164) == shown


def test_every_region_has_a_plan():
    for region, plan in phones.PLANS.items():
        assert plan.code == phones.CODES[region] and plan.lengths and phones.re.compile(plan.valid)
        assert not phones.re.fullmatch(plan.valid, "1") and not phones.re.fullmatch(plan.valid, "9" * 20), region
        assert all(phones.human(f"+{plan.code}{'2' * n}").replace(" ", "").replace("-", "") == f"+{plan.code}{'2' * n}" for n in plan.lengths), region


@given(st.text(alphabet="0123456789 +-./()a", max_size=60))
def test_zones_lose_no_number(text):
    whole = [(0, len(text))]
    for region, strict in ((None, False), ("RU", True), ("US", True), ("DE", True)):
        assert [m for m in phones.matches(text, region, strict, whole) if strict or "+" in m[1]] == [m for m in phones.matches(text, region, strict) if strict or "+" in m[1]]


def test_possible_loses_no_contact(spark):
    texts = ["a@b.example", "a＠b．example", "x at y.example", "x собака y точка com", "x sobaka y.example", "&#43;7 495", "+7 495 1234567", "＋74951234567", "1234567", "look at me", "v. 2.0", "x at y dot example", "x (at) y [.] example", "a at b", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("p", possible("t")).collect()
    assert all(r.p for r in rows if extract_contacts(r.t, ("RU", "US", "DE"))) and not any(r.p for r in rows if r.t in ("look at me", "a at b", "v. 2.0", ""))


@given(st.text(alphabet="0123456789 ./-:()+UAINHRBTaxDE\n", max_size=80))
def test_blanking_keeps_length(text):
    assert len(markup.blanked(text)) == len(text)


@given(st.text(max_size=120))
def test_any_text_is_read(text):
    extract_contacts(text)
    extract_emails(text)


def test_native_and_python_emails_agree(spark):
    texts = ["a@example.com A@Example.com", "x [at] example [dot] com or y (at) test.org", "logo@2x.png", "published at example.com", "", "sobaka u003ea@b.com c@www.d.com .@x.yz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", emails.contacts("t").alias("c")).orderBy("id").collect()
    assert [[(c.value, c.raw) for c in r.c] for r in rows] == [extract_emails(t) for t in texts]


def test_scores(spark):
    cases = {"http://a.ru": 5, "http://a.ru/": 5, "http://a.ru/?q=contact": 5, "http://a.ru/contacts.html": 13, "http://a.ru/x/y/about-us": 10, "http://a.ru/logo.png": 0, "http://a.ru/blog/tag/x": -5, "http://a.ru/tag/contact": 8, "http://a.ru/%D0%BA%D0%BE%D0%BD%D1%82%D0%B0%D0%BA%D1%82%D1%8B": 13, "http://a.ru/x;p=1": 3, "http://a.ru/aboutface": 3, "http://a.ru/a|b%zz": 3}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.score("u").alias("s")).collect()
    assert {r.u: r.s for r in rows} == cases


@pytest.mark.parametrize(
    ("text", "kept"),
    [("einsch 4336147440738033 x", True), ("ein von 4334232956157448 x", True), ("Ein 4334232956157448 x", True), ("EIN 433423295 x", False), ("Vat no. 259047752 x", False), ("INN: 7707083893 x", False), ("uen 200604351d x", False), ("USt-IdNr. DE259047752 x", False)],
)
def test_prose_before_digits_is_no_label(text, kept):
    assert (markup.blanked(text) == text) is kept
    assert markup.blanked(text).endswith(" x")


@pytest.mark.parametrize("after", ["", " 53.121.55.90", " 4913187196670932 53.121.55.90", " 4913187196670932 53.121.55.90 4080166431094600"])
def test_number_before_other_digits(after):
    assert ("+18365559331", "+1 (836) 555-9331") in phones.phones(f"a +1 (836) 555-9331{after} b", ())


@pytest.mark.parametrize(
    ("text", "region", "found"),
    [
        ("49.242.246.194", "DE", [("+49242246194", "49.242.246.194")]), ("49.154.250.187", "DE", []), ("499288", "DE", []), ("033 76117893", "DE", [("+493376117893", "033 76117893")]),
        ("33.76.117.89", "FR", []), ("33 1 42 68 53 00", "FR", [("+33142685300", "33 1 42 68 53 00")]), ("+1 (978) 555-1", "US", []), ("+1 (978) 555-1234", "US", [("+19785551234", "+1 (978) 555-1234")]),
    ],
)
def test_digits_without_prefix_need_the_calling_code(text, region, found):
    assert phones.phones(text, (region,)) == found


def test_few_pages_are_texts_at_a_time(spark):
    held, most = [], []

    def read(i):
        if i % contacts.PAGES == 0:
            held.clear()
        held.append(i)
        most.append(len(held))
        return f"text {i}"

    assert contacts.by_slices(read, 100, pa.string()).to_pylist() == [f"text {i}" for i in range(100)] and max(most) == contacts.PAGES
    assert contacts.by_slices(read, 0, pa.string()).to_pylist() == []
    rows = spark.createDataFrame([(i, None if i == 7 else f"a{i}@example.com") for i in range(200)], "id int, t string").coalesce(1)
    found = rows.select("id", contacts.page_contacts("t", F.array(F.lit("RU"))).alias("c"), contacts.normalised("t").alias("n")).collect()
    assert all([c.value for c in r.c] == ([] if r.id == 7 else [r.n]) for r in found) and found[7].n == ""
