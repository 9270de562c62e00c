"""Surrogates for personal data: keyed replacements of the same kind and form; DataFrame functions only.

Detected are e-mail addresses, international phone numbers, IPv4 addresses, payment cards of 16 digits, numbers like 123-45-6789, and
names of persons: capitalised words after a title, a listed given name or a phrase like "my name is", or before one like "called". Given names
that are met in this way anywhere in the corpus are then recognised before any capitalised word, in all documents. Other names stay.

Each distinct entity of the corpus gets one surrogate, a function of the key, its kind and its canonical form, so all its mentions, however
written, are replaced alike (case, separators, titles and phrases stay as they are; given name, surname, and an address's domain are entities of their own).
Numbers are permuted by a keyed Feistel network within those of their shape: calling code and length stay, cards keep their first digit and what their check digit
is off by; private addresses stay in their block. Other IPv4 addresses move to a reserved block and domains to reserved names. Names keep script and gender, which titles and
lists tell (by the more frequent in the corpus); they are put together from syllables, apart from the names that detection lists.

Collision check: over the distinct entities of all documents, a surrogate that another one has, or that is itself an original of the
same kind, is drawn again (the smallest canonical form keeps a shared one), ROUNDS times at most. What is left then, because nearly all numbers of
a shape are originals, trades places: each gets the original of another of its shape, so surrogates stay distinct, no entity keeps its own form, and it always ends.
Entities, never documents, are grouped for this; mentions meet surrogates in an inner join, of which adaptive execution splits hot entities.

Nulls: a null text is empty, a null doc_id is returned as null. Rows that repeat are replaced alike. An empty table gives no
rows. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

KEY = "palimpsest"
# Names by gender and script, titles, phrases beside names, and words that begin no name.
MALE = "James John Robert Michael William David Richard Joseph Thomas Charles Hans Peter Klaus Stefan Jean Pierre Louis Carlos Juan Miguel Pablo".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Greta Ingrid Marie Claire Sophie Maria Lucia Carmen Elena Isabel".split()
MALE_CYRILLIC = "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Павел Олег".split()
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split()
MALE_TITLES = "Mr Herr Señor Monsieur".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Señora Madame".split()
TITLES = [*MALE_TITLES, *FEMALE_TITLES, "Dr", "Prof"]
BEFORE = ["[Mm]y name is", "[Nn]ame:", "[Dd]ear", "[Ss]igned", "[Cc]ontact", "[Ss]incerely,", "[Ii]ch heiße", "[Mm]ein Name ist", "[Jj]e m'appelle", "[Mm]e llamo", "[Мм]еня зовут"]
AFTER = "called calls said says wrote writes told asked replied answered phoned emailed signed lives works sagte schrieb rief dit dijo llamó сказал сказала".split()
NO_NAMES = "The A An This That These Those He She It We They I You My Our Your His Her Their Its If In On At As But And Or For From With When Der Die Das Ein Eine Er Sie Es Wir Ich Le La Les Un Une Il Elle Nous Je El Los Las Una Yo Él Ella".split()
# Syllables of surrogate names.
HEADS = "Al Bar Cor Dan El Fen Gar Hal Ing Jar Kel Lan Mor Nor Ost Per Quin Ros Sel Tor Ul Van Wal York Zel".split()
TAILS = "man son ford well ton berg feld ley ner wick ham dale more stein er".split()
GIVEN_M, GIVEN_F, GIVEN_N = "ric bert mund ward fred win gar dor vin mar".split(), "ira ella ine etta lyn ora ina issa wen ia".split(), "en is ory ane ay ey ex ul".split()
HEADS_CYRILLIC = "Бел Вор Гор Дан Ел Жар Зар Кор Лан Мор Нов Орл Пет Ром Сав Тар Фед Хар Чер Шар".split()
TAILS_CYRILLIC = "ов ев ин енков овин".split()
GIVEN_M_CYRILLIC, GIVEN_F_CYRILLIC = "мир слав мил дан рад гор".split(), "мира слава мила дана рада ина".split()

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*(?<=\.[A-Za-z]{2,24})(?![A-Za-z0-9\-])"
PHONE = r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}(?!\w)"
CARD = r"(?<![\d.])\d{4}([ \-]?)\d{4}\1\d{4}\1\d{4}(?![\d])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)"
NUMBER = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
WORD = r"\p{Lu}[\p{Ll}'’]+(?:-\p{Lu}\p{Ll}+)*"
TITLE, CUE = rf"(?:{'|'.join(TITLES)})\.? ", rf"(?:{'|'.join(BEFORE)}) "
PAIR = rf"(?!(?:{'|'.join(NO_NAMES)}) ){WORD} {WORD}"
PERSON = rf"(?<!\p{{L}})(?:{TITLE}{WORD}(?: {WORD})?|{CUE}{PAIR}|(?=\p{{Lu}}){PAIR}(?: (?:{'|'.join(AFTER)}))?)(?!\p{{L}})"
#: The parts of a person's mention: what stands before, first and second word, what stands after.
PARTS = rf"^((?:{TITLE}|{CUE})?)({WORD})(?: ({WORD}))?((?: (?:{'|'.join(AFTER)}))?)$"
DIGITS = "|".join((PHONE, CARD, IPV4, NUMBER))
#: The draw from which surrogates get longer or leave their reserved block, and the number of draws.
LONGER, ROUNDS = 4, 12
#: Entities that trade places in one task.
TRADED = 100_000


def mentions(text: Column) -> tuple[Column, Column]:
    """All mentions in a text, and what stands between them; patterns that can't match a text aren't tried on it."""
    at, digits = text.contains("@"), text.rlike(r"(?:\d\D*+){4}")
    choices = [(at & digits, f"{EMAIL}|{DIGITS}|{PERSON}"), (at, f"{EMAIL}|{PERSON}"), (digits, f"{DIGITS}|{PERSON}"), (F.lit(True), PERSON)]
    return (F.coalesce(*(F.when(c, F.regexp_extract_all(text, F.lit(p), F.lit(0))) for c, p in choices)), F.coalesce(*(F.when(c, F.split(text, p, -1)) for c, p in choices)))


def _hashed(*parts: Column | str) -> Column:
    """48 bits of a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 12), 16, 10).cast("long")


def _pick(names: list[str], n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in names)), (n % len(names) + 1).cast("int"))


def _permuted(n: Column, high: Column, low: Column, seed: Column) -> Column:
    """A keyed permutation of the numbers under high * low, by four rounds of a Feistel network."""
    a, b = F.floor(n / low).cast("long"), n % low
    for turn in ("1", "2"):
        a = (a + _hashed(seed, F.lit(f"a{turn}"), b.cast("string"))) % high
        b = (b + _hashed(seed, F.lit(f"b{turn}"), a.cast("string"))) % low
    return a * low + b


def _permuted_digits(digits: Column, seed: Column) -> Column:
    """Digits, one to 15 of them, permuted among those of their length; a first digit of 2 or more stays so."""
    lead, rest = F.substring(digits, 1, 1).cast("long"), F.substring(digits, 2, 15)
    size = F.length(rest)
    half = F.floor(size / 2)
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    made = F.when(size > 0, F.lpad(_permuted(F.coalesce(rest.cast("long"), F.lit(0)), ten(size - half), ten(half), seed).cast("string"), size, "0")).otherwise("")
    turn = _hashed(seed, F.lit("lead"), made)
    return F.concat(F.when(lead >= 2, (lead - 2 + turn) % 8 + 2).otherwise((lead + turn) % 2).cast("string"), made)


def _masked(text: Column, seed: Column) -> Column:
    """text with each letter and digit drawn anew, of the same class and case."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def draw(c: Column, i: Column) -> Column:
        n = _hashed(seed, i.cast("string"))
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (n % 26 + 1).cast("int"), F.lit(1))
        return F.when(c.rlike("^[0-9]$"), (n % 10).cast("string")).when(c.rlike("^[a-z]$"), letter).when(c.rlike("^[A-Z]$"), F.upper(letter)).otherwise(c)

    return F.array_join(F.transform(chars, draw), "")


def _luhn(digits: Column) -> Column:
    """Sum of a payment card's digits as its check digit counts them; right if divisible by ten."""
    each = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def _octets(n: Column, count: int) -> Column:
    return F.concat_ws(".", *((F.shiftrightunsigned(n, 8 * k).bitwiseAND(F.lit(255))).cast("string") for k in reversed(range(count))))


def with_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """entities (kind, canon, gender, attempt) with `made`, the canonical form of each one's surrogate at its attempt-th draw."""
    kind, canon, gender, attempt = (F.col(c) for c in ("kind", "canon", "gender", "attempt"))
    # Numbers of a shape are permuted together, so the seed must not hold them; what is drawn for each alone is seeded by it.
    draw = F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"))
    own = F.concat_ws("\x1f", draw, canon)
    more = F.greatest(F.lit(0), attempt - LONGER + 1)
    extra = F.when(more > 0, _masked(F.repeat(F.lit("a"), more.cast("int")), F.concat(own, F.lit("+")))).otherwise("")
    ending = F.regexp_extract(canon, r"\.(com|net|org)$", 1)
    domain = F.concat(_masked(F.substring_index(canon, ".", 1), own), extra, F.lit(".example."), F.when(ending != "", ending).otherwise("com"))
    email = F.concat(_masked(F.substring_index(canon, "@", 1), own), extra, F.lit("@"), F.substring_index(canon, "@", -1))
    code = F.when(canon.rlike(r"^\+[17]"), 2).otherwise(3)
    prefix, rest = F.substring(canon, F.lit(1), code), F.substring(canon, code + 1, F.lit(15))
    phone = F.concat(prefix, _permuted_digits(rest, F.concat_ws("\x1f", draw, prefix, F.length(rest).cast("string"))))
    part = lambda i: F.element_at(F.split(canon, r"\."), i).cast("long")
    block = lambda n, half, name: _permuted(n, F.lit(1 << half), F.lit(1 << half), F.concat_ws("\x1f", draw, F.lit(name)))
    last = part(3) * 256 + part(4)
    ip = (
        F.when(canon.startswith("10."), F.concat(F.lit("10."), _octets(block(part(2) * 65536 + last, 12, "10"), 3)))
        .when(canon.startswith("192.168."), F.concat(F.lit("192.168."), _octets(block(last, 8, "192"), 2)))
        .when(canon.rlike(r"^172\.(1[6-9]|2\d|3[01])\."), _octets(block((part(2) - 16) * 65536 + last, 10, "172") + (172 * 256 + 16) * 65536, 4))
        .otherwise(_octets(F.when(attempt < LONGER, _hashed(own) % (15 << 24) + (240 << 24)).otherwise(block(part(1) * (1 << 24) + part(2) * 65536 + last, 16, "all")), 4))
    )
    body = F.concat(F.substring(canon, 1, 1), F.lpad(_permuted(F.substring(canon, 2, 14).cast("long"), F.lit(10**7), F.lit(10**7), F.concat_ws("\x1f", draw, F.substring(canon, 1, 1))).cast("string"), 14, "0"))
    # The check digit is off by as much as the original's.
    card = F.concat(body, ((20 - _luhn(F.concat(body, F.lit("0"))) % 10 + _luhn(canon) % 10) % 10).cast("string"))
    figures = F.regexp_replace(canon, "-", "")
    nine = F.when(attempt < LONGER, F.concat(F.lit("9"), F.lpad((_hashed(own) % 10**8).cast("string"), 8, "0"))).otherwise(F.lpad(_permuted(figures.cast("long"), F.lit(10**5), F.lit(10**4), draw).cast("string"), 9, "0"))
    number = F.concat_ws("-", F.substring(nine, 1, 3), F.substring(nine, 4, 2), F.substring(nine, 6, 4))

    def name(heads: list[str], tails: list[str]) -> Column:
        """Two syllables and an ending, and a syllable more for every other draw."""
        middle = F.transform(F.sequence(F.lit(0), F.floor(attempt / 2)), lambda i: F.lower(_pick(heads, _hashed(own, F.lit("middle"), i.cast("string")))))
        return F.concat(_pick(heads, _hashed(own, F.lit("head"))), F.array_join(middle, ""), _pick(tails, _hashed(own, F.lit("tail"))))

    by_kind = {
        "email": email, "domain": domain, "phone": phone, "ip": ip, "card": card, "number": number,
        "given latin": F.when(gender == "m", name(HEADS, GIVEN_M)).when(gender == "f", name(HEADS, GIVEN_F)).otherwise(name(HEADS, GIVEN_N)),
        "given cyrillic": F.when(gender == "f", name(HEADS_CYRILLIC, GIVEN_F_CYRILLIC)).otherwise(name(HEADS_CYRILLIC, GIVEN_M_CYRILLIC)),
        "surname latin": name(HEADS, TAILS),
        "surname cyrillic": F.concat(name(HEADS_CYRILLIC, TAILS_CYRILLIC), F.when(canon.rlike("[ая]$"), "а").otherwise("")),
    }
    return entities.select("kind", "canon", "gender", "attempt", F.coalesce(*(F.when(kind == k, made) for k, made in by_kind.items())).alias("made"))


def _is_person(raw: Column) -> Column:
    return raw.rlike(r"^\p{L}[^@0-9]*$")


def _plain_kind(raw: Column) -> Column:
    return F.when(raw.contains("@"), "email").when(raw.startswith("+"), "phone").when(raw.rlike(r"^\d{3}-\d{2}-\d{4}$"), "number").when(raw.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").otherwise("card")


def _canon(raw: Column, kind: Column) -> Column:
    return F.when(kind == "email", F.lower(raw)).when(kind == "phone", F.concat(F.lit("+"), F.regexp_replace(raw, r"\D", ""))).when(kind == "card", F.regexp_replace(raw, r"\D", "")).otherwise(raw)


def _words(raw: Column) -> tuple[Column, Column, Column, Column]:
    """What stands before a person's name, the given name (empty after a title alone), the surname and what stands after."""
    before, first, second, after = (F.regexp_extract(raw, PARTS, k) for k in (1, 2, 3, 4))
    return before, F.when(second == "", "").otherwise(first), F.when(second == "", first).otherwise(second), after


def _name_kind(which: str, word: Column) -> Column:
    return F.concat(F.lit(f"{which} "), F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin"))


def _entities(raws: Column) -> Column:
    """kind, canon, gender, sure, given of all entities of a document's mentions. What isn't sure is one only if `given` is a given name elsewhere."""
    fields = "array<struct<kind:string,canon:string,gender:string,sure:boolean,given:string>>"

    def of(raw: Column) -> Column:
        before, given, surname, after = _words(raw)
        title = F.regexp_replace(before, r"\.? $", "")
        listed = F.when(given.isin(MALE + MALE_CYRILLIC), "m").when(given.isin(FEMALE + FEMALE_CYRILLIC), "f")
        gender = F.coalesce(listed, F.when(title.isin(MALE_TITLES), "m").when(title.isin(FEMALE_TITLES), "f"))
        sure = (before != "") | (after != "") | listed.isNotNull()
        person = F.filter(
            F.array(
                F.struct(_name_kind("given", given).alias("kind"), F.initcap(given).alias("canon"), gender.alias("gender"), sure.alias("sure"), F.initcap(given).alias("given")),
                F.struct(_name_kind("surname", surname).alias("kind"), F.initcap(surname).alias("canon"), F.lit(None).cast("string").alias("gender"), sure.alias("sure"), F.initcap(given).alias("given")),
            ),
            lambda e: e["canon"] != "",
        ).cast(fields)
        kind = _plain_kind(raw)
        one = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"), F.lit(None).cast("string").alias("gender"), F.lit(True).alias("sure"), F.lit("").alias("given"))
        plain = F.when(kind == "email", F.array(one(F.lit("email"), _canon(raw, kind)), one(F.lit("domain"), F.substring_index(F.lower(raw), "@", -1)))).otherwise(F.array(one(kind, _canon(raw, kind)))).cast(fields)
        return F.when(_is_person(raw), person).otherwise(plain)

    return F.array_distinct(F.flatten(F.transform(raws, of)))


def _fill_digits(raw: Column, digits: Column) -> Column:
    """raw with its digits replaced in order by those of `digits`."""
    chars = F.filter(F.split(raw, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(a: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(a["out"], F.when(digit, F.substring(digits, a["at"], F.lit(1))).otherwise(c)).alias("out"), (a["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(chars, start, step, lambda a: a["out"])


def _key(kind: Column, canon: Column) -> Column:
    return F.concat_ws("\x1f", kind, canon)


def _replaced(raw: Column, made: Column) -> Column:
    """A mention's replacement; made: surrogates by _key. What has none stays."""
    kind = _plain_kind(raw)
    own = F.element_at(made, _key(kind, _canon(raw, kind)))
    address = F.concat(F.substring_index(own, "@", 1), F.lit("@"), F.element_at(made, _key(F.lit("domain"), F.substring_index(F.lower(raw), "@", -1))))
    plain = F.when(kind.isin("phone", "card"), _fill_digits(raw, F.regexp_replace(own, r"\D", ""))).when(kind == "email", F.when(raw.rlike("^[^a-z]+$"), F.upper(address)).otherwise(address)).otherwise(own)
    before, given, surname, after = _words(raw)
    new = lambda which, word: F.element_at(made, _key(_name_kind(which, word), F.initcap(word)))
    both = F.concat(before, F.when(given == "", "").otherwise(F.concat(new("given", given), F.lit(" "))), new("surname", surname), after)
    return F.coalesce(F.when(_is_person(raw), both).otherwise(plain), raw)


def known(found: DataFrame) -> DataFrame:
    """The distinct entities (kind, canon, gender) among found ones (kind, canon, gender, sure, given): sure ones, and surnames beside a given name that is sure elsewhere."""
    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("kind", "canon").agg(F.count_if(F.col("gender") == "m").alias("m"), F.count_if(F.col("gender") == "f").alias("f"))

    sure = merged(found.where("sure"))
    names = sure.where("startswith(kind, 'given')").select(F.col("canon").alias("given"), F.substring_index("kind", " ", -1).alias("script"))
    beside = found.where("not sure and startswith(kind, 'surname')").withColumn("script", F.substring_index("kind", " ", -1)).join(names, ["given", "script"], "left_semi")
    both = sure.unionByName(merged(beside.drop("script"))).groupBy("kind", "canon").agg(F.sum("m").alias("m"), F.sum("f").alias("f"))
    return both.select("kind", "canon", F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > 0, "f").alias("gender"))


def draws(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canon, made: a surrogate for each distinct entity that no other has, and no original of its kind wherever there is room."""
    gender = F.col("gender") if "gender" in entities.columns else F.lit(None).cast("string")
    all_of_them = common.materialise(entities.select("kind", "canon", gender.alias("gender")).dropDuplicates(["kind", "canon"]), "entities")
    originals = all_of_them.select("kind", F.col("canon").alias("made"))
    pending, taken = all_of_them.withColumn("attempt", F.lit(0)), None
    for attempt in range(ROUNDS):
        made = with_surrogates(pending, key)
        first = made.groupBy("kind", "made").agg(F.min("canon").alias("canon")).join(originals, ["kind", "made"], "left_anti")
        if taken is not None:
            first = first.join(taken.select("kind", "made"), ["kind", "made"], "left_anti")
        new = common.materialise(first.select("kind", "canon", "made"), "drawn")
        taken = new if taken is None else taken.unionByName(new)
        pending = common.materialise(pending.join(new, ["kind", "canon"], "left_anti").withColumn("attempt", F.lit(attempt + 1)), "collisions")
        if pending.isEmpty():
            return taken
    return taken.unionByName(traded(pending.select("kind", "canon"), all_of_them.join(pending, ["kind", "canon"], "left_anti"), key))


def traded(left: DataFrame, others: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canon, made where there was no room: each takes the original of another of its shape, none of which is a surrogate yet.

    Those of a shape go round in circles of about TRADED; those alone in theirs go round together, and one alone of its kind takes the least of `others`.
    """
    canon, kind = F.col("canon"), F.col("kind")
    block = F.when(canon.rlike(r"^(?:10|172|192)\."), F.substring_index(canon, ".", 1)).otherwise("")
    shape = F.when(kind == "phone", F.concat(F.substring(canon, 1, 3), F.length(canon).cast("string"))).when(kind == "ip", block).when(kind == "card", F.substring(canon, 1, 1)).otherwise("")
    shaped = left.withColumn("shape", shape)
    counted = shaped.groupBy("kind", "shape").agg(F.ceil(F.count(F.lit(1)) / TRADED).alias("circles"))
    dealt = shaped.join(counted, ["kind", "shape"]).withColumn("circle", F.pmod(F.xxhash64("canon"), F.col("circles")))

    def round_(rows: DataFrame, *by: str) -> DataFrame:
        group = Window.partitionBy(*by).orderBy(F.sha2(F.concat_ws("\x1f", F.lit(key), "canon"), 256), "canon")
        first = F.first("canon").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return rows.select("kind", "canon", F.coalesce(F.lead("canon").over(group), first).alias("made"))

    once = round_(dealt, "kind", "shape", "circle")
    twice = round_(once.where("made = canon"), "kind")
    last = twice.where("made = canon").select("kind", "canon").join(others.groupBy("kind").agg(F.min("canon").alias("made")), "kind").select("kind", "canon", "made")
    return once.where("made <> canon").unionByName(twice.where("made <> canon")).unionByName(last)


def surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with every entity replaced, n_replaced of every row of docs (doc_id, text)."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    marked = common.materialise(marked.withColumn("raws", mentions(F.col("text"))[0]), "mentions")
    held = marked.where(F.size("raws") > 0)
    found = held.select("doc_id", F.xxhash64("text").alias("row"), F.explode(_entities(F.col("raws"))).alias("e")).select("doc_id", "row", "e.*")
    found = common.materialise(found, "found")
    made = draws(known(found.drop("doc_id", "row")), key)
    later = found.select("doc_id", "row", "kind", "canon").join(made, ["kind", "canon"])
    later = later.groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_set(F.struct(_key(F.col("kind"), F.col("canon")), "made"))).alias("made"))
    later = later.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "made")
    joined = held.join(later, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("r")), "left")
    changed = joined.where("made is not null").withColumn("new", F.transform("raws", lambda r: _replaced(r, F.col("made"))))
    pieces = F.zip_with(mentions(F.col("text"))[1], "new", lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    count = F.size(F.filter(F.zip_with("raws", "new", lambda a, b: a != b), lambda x: x))
    changed = changed.select("doc_id", F.array_join(pieces, "").alias("text"), count.alias("n_replaced"))
    same = joined.where("made is null").select("doc_id", "text").unionByName(marked.where(F.size("raws") == 0).select("doc_id", "text"))
    return changed.unionByName(same.withColumn("n_replaced", F.lit(0)))


def op2_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return surrogates(common.table(spark, sf_dir, "documents"))
