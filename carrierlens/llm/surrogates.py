"""Personal data and secrets, replaced by keyed surrogates. DataFrame and SQL functions only.

Detection is one alternation of patterns; card numbers must also pass their check digit. A run of numbers that is no
card as a whole is searched for cards between its separators, from the left, the longest first. Every distinct entity of the
corpus gets one surrogate, drawn from a keyed hash of its type, canonical form and attempt number: digits become
digits, letters letters of the same case, separators stay, cards keep their first digit and a valid check digit, mail
goes to reserved domains (a label for each host), addresses to a reserved block, names to names of the same script and
gender. A name is several entities, its given names and its family name, so that "Mr. John Smith", "MR. SMITH", "Dr. J.
Smith" and, in a document that has one of these, "John Smith" and "Smith" stay the same person. The table of distinct
entities then is checked: a surrogate that two entities share, or that is itself an entity of the corpus,
stays with the first only (earlier attempts, then smaller forms, go first), the others are drawn again until none is
left; where a format is used up, later attempts are longer. So an entity has the same surrogate everywhere, and different entities have different ones.

Only documents with entities meet their replacements; the others pass by without an exchange of their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carrierlens.llm.common import cut, drop, with_rest

KEY = "surrogate-key"
ROUNDS = 40

#: Titles by the gender they tell.
TITLES = {
    "f": "Mrs Ms Miss Madam Frau Señora Sra Madame Mme Mlle Госпожа Κυρία MRS MS MISS FRAU MADAME".split(),
    "m": "Mr Sir Herr Señor Sr Monsieur Господин Κύριος MR SIR HERR MONSIEUR".split(),
    "x": "Mx Dr Prof Professor Доктор Δρ DR PROF".split(),
}
_TITLE = "(?:" + "|".join(sorted((t for own in TITLES.values() for t in own), key=len, reverse=True)) + ")"
_WORD = r"(?:\p{Lu}['’])?(?:\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?|\p{Lu}{2,})(?:-(?:\p{Lu}\p{Ll}+|\p{Lu}{2,}))*"
#: Patterns by type, in order of precedence. Runs are possessive and start at a boundary, so a long text costs one pass.
PATTERNS = {
    "EMAIL": r"(?<![A-Za-z0-9_%+-])(?<![A-Za-z0-9_%+-]\.)[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "SECRET": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?=[a-fA-F]{0,63}[0-9])(?=[0-9]{0,63}[a-fA-F])[0-9a-fA-F]{32,64}+)(?![A-Za-z0-9])",
    "IBAN": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "IP": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9])(?!\.[0-9])",
    "PHONE": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[2-9][0-9]{2}\.[2-9][0-9]{2}\.[0-9]{4}|0[1-9](?:[ .-][0-9]{2}){4}|\(?0[1-9][0-9]{1,3}\)?[ -][0-9]{3,4}[ -]?[0-9]{3,4})(?![0-9])(?!-[0-9])",
    "SSN": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "CARD": r"(?<![0-9])(?=4|(?:5[ -]?[1-5]|2[ -]?[2-7]|3[ -]?[457]|6[ -]?(?:0[ -]?1[ -]?1|5)))[0-9](?:(?:[ -](?![0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9])))?[0-9]){12,}+",
    "NAME": rf"(?<!\p{{L}})(?:{_TITLE}\.? )+(?:(?:{_WORD}|\p{{Lu}}\.) ){{0,2}}{_WORD}(?!\p{{L}})",
}
ANY = "|".join(PATTERNS.values())
#: What every entity has, for a cheap first look.
HINT = rf"[0-9@]|AKIA|gh[pousr]_|{_TITLE}\.? \p{{Lu}}"
#: Prefixes of card numbers in use, and how many digits they have.
ISSUER = r"^(?=[0-9]{13,19}$)(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)"
#: How a card is written that stands beside other numbers.
SHAPE = r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"

#: Given names by script and gender, and syllables of family names by script.
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Emma Flora Ida Julia Laura Lena Maria Nina Olivia Paula Rosa Sara Vera".split(),
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Karl Leo Martin Oscar Paul Simon Victor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Полина Раиса Софья Тамара Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей".split(),
    ("greek", "f"): "Άννα Βασιλική Δήμητρα Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Κατερίνα Λυδία Μαρία Νίκη Ξένια Όλγα Σοφία Χλόη".split(),
    ("greek", "m"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Ιάσων Κώστας Λουκάς Μάρκος Νίκος Ορέστης Πέτρος Σπύρος Τάσος Φώτης".split(),
}
#: Last letters of names made of syllables, by script and gender.
ENDINGS = {"latin": {"f": "a", "m": "n", "x": "i"}, "cyrillic": {"f": "а", "m": "н", "x": "и"}, "greek": {"f": "α", "m": "ς", "x": "ι"}}
SYLLABLES = {
    "latin": "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo wa we".split(),
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во за зе".split(),
    "greek": "βα βε βο δα δε δο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το πα πε πο ζα ζε".split(),
}


def _card(value: Column) -> Column:
    """Whether the digits of value are those of a card."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return digits.rlike(ISSUER) & F.call_function("luhn_check", digits)


def split_cards(token: Column) -> Column:
    """The parts of a match: itself, or the cards in a run of numbers and what lies between them."""
    def parts(runs: Column) -> Column:
        join = lambda i, n: F.array_join(F.slice(runs, i, n), "")
        span = lambda i, j: F.regexp_replace(join(i, j - i + 1), "[ -]$", "")
        ours = lambda i, j: span(i, j).rlike(SHAPE) & _card(span(i, j))
        last = lambda i: F.array_max(F.filter(F.sequence(i, F.least(i + 4, F.size(runs))), lambda j: ours(i, j)))
        spans = F.filter(F.transform(F.sequence(F.lit(1), F.size(runs)), lambda i: F.struct(i.alias("a"), last(i).alias("b"))), lambda x: x["b"].isNotNull())
        apart = lambda chosen, x: F.when(F.coalesce(F.try_element_at(chosen, F.lit(-1))["b"] < x["a"], F.lit(True)), F.concat(chosen, F.array(x))).otherwise(chosen)
        return _once(F.aggregate(spans, F.array().cast("array<struct<a:int,b:int>>"), apart), lambda chosen: between(join, span, runs, chosen))

    def between(join, span, runs: Column, chosen: Column) -> Column:
        after = lambda k: F.coalesce(F.try_element_at(chosen, k)["b"], F.lit(0)) + 1
        before = lambda x, k: join(F.when(k == 0, F.lit(1)).otherwise(after(F.greatest(k, F.lit(1)))), x["a"] - F.when(k == 0, F.lit(1)).otherwise(after(F.greatest(k, F.lit(1)))))
        each = F.flatten(F.transform(chosen, lambda x, k: F.array(before(x, k), span(x["a"], x["b"]), F.regexp_extract(F.element_at(runs, x["b"]), "[ -]?$", 0))))
        return F.concat(each, F.array(join(after(F.lit(-1)), F.size(runs))))

    runs = F.regexp_extract_all(token, F.lit("[0-9]+[ -]?"), 0)
    return F.when(token.rlike(rf"\A(?:{PATTERNS['CARD']})\z") & ~_card(token), _once(runs, parts)).otherwise(F.array(token))


def _once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _plain(value: Column) -> Column:
    return F.regexp_replace(value, " ", "")


def _mod97(value: Column) -> Column:
    """The rest of a string of digits and capital letters (as 10 to 35) by 97."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(value, ""), F.lit(0), step)


def kind(value: Column) -> Column:
    """The type of a match: the first pattern that takes the whole of it. Null for numbers that are no card."""
    out = None
    for name, pattern in PATTERNS.items():
        ours = value.rlike(rf"\A(?:{pattern})\z")
        if name == "CARD":
            ours = ours & _card(value)
        if name == "IBAN":
            ours = ours & (_mod97(F.concat(F.substring(_plain(value), F.lit(5), F.length(value)), F.substring(_plain(value), 1, 4))) == 1)
        out = F.when(ours, F.lit(name)) if out is None else out.when(ours, F.lit(name))
    return out


def canonical(type_: Column, value: Column) -> Column:
    """What mentions of one entity have in common: digits of numbers, lower case of mail and secrets."""
    numbers = F.regexp_replace(value, "[^0-9]", "")
    return F.when(type_.isin("PHONE", "SSN", "CARD"), numbers).when(type_.isin("EMAIL", "SECRET"), F.lower(value)).when(type_ == "IBAN", _plain(value)).otherwise(value)


def _draw(stream: Column, i: Column) -> Column:
    """The i-th number of a stream of hexadecimal digits, 0..65535; it starts over every 200 places."""
    return F.conv(F.substring(stream, (i % 200) + 1, F.lit(4)), 16, 10).cast("int")


def _pick(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), (at % len(letters)) + 1, F.lit(1))


def _reshape(value: Column, stream: Column, letters: str) -> Column:
    """Digits become digits, letters letters, of the stream; the rest stays."""
    one = lambda c, i: F.when(c.rlike("[0-9]"), _pick("0123456789", _draw(stream, i))).when(c.rlike("[a-z]"), _pick(letters, _draw(stream, i))).otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _check_digit(body: Column) -> Column:
    """body with the digit that makes it pass Luhn's check."""
    tens = lambda d: F.when(d > 9, d - 9).otherwise(d)
    reversed_ = F.split(F.reverse(body), "")
    total = F.aggregate(F.transform(reversed_, lambda c, i: F.when(i % 2 == 0, tens(c.cast("int") * 2)).otherwise(c.cast("int"))), F.lit(0), lambda a, d: a + d)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def surrogate(type_: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical form, in canonical form (names: as they are written)."""
    seed = F.concat_ws("\x1f", F.lit(key), type_, attempt.cast("string"), canon)
    stream = F.concat(*[F.sha2(F.concat(F.lit(f"{k}\x1f"), seed), 256) for k in range(4)])
    n = F.length(canon)
    digits = _reshape(canon, stream, "a")
    reserved = lambda at: F.element_at(F.array(*[F.lit(x) for x in ("example.com", "example.net", "example.org")]), (at % 3) + 1)
    host = F.substring_index(canon, "@", -1)
    more = (F.floor(attempt / 3) % 40).cast("int")  # letters that later attempts add
    local = F.concat(_reshape(F.substring_index(canon, "@", 1), stream, "abcdefghijklmnopqrstuvwxyz"), F.substring(F.translate(F.substring(stream, F.lit(150), F.lit(40)), "0123456789", "ghijklmnop"), F.lit(1), more))
    label = F.regexp_replace(host, r"\.[^.]+$", "")  # all but the last label, or but the last two where there are more
    under = F.when(label.contains("."), F.regexp_replace(label, r"\.[^.]+$", "")).otherwise(label)
    hosts = F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(f"{k}"), F.lit(key), F.lit("HOST"), host), 256) for k in range(4)])
    mail = F.concat(local, F.lit("@"), _reshape(under, hosts, "abcdefghijklmnopqrstuvwxyz"), F.lit("."), reserved(_draw(hosts, F.lit(190))))
    secret = F.when(canon.rlike("^[0-9a-f]+$"), F.substring(stream, F.lit(1), n)).otherwise(F.concat(F.substring(canon, 1, 4), _reshape(F.substring(canon, F.lit(5), n), stream, "abcdefghijklmnopqrstuvwxyz")))
    octet = lambda k: (_draw(stream, F.lit(10 * k)) % 256).cast("string")
    first = F.when(attempt < 6, 240 + _draw(stream, F.lit(0)) % 15).otherwise(1 + _draw(stream, F.lit(0)) % 254)
    address = F.concat_ws(".", first.cast("string"), octet(1), octet(2), octet(3))
    exchange = F.when(attempt < 4, F.lit("555")).otherwise(F.concat(_pick("23456789", _draw(stream, F.lit(30))), F.substring(digits, F.lit(6), F.lit(2))))
    nanp = F.concat(F.lit("1"), _pick("23456789", _draw(stream, F.lit(0))), F.substring(digits, F.lit(2), F.lit(2)), exchange, F.substring(digits, F.lit(8), F.lit(4)))
    longer = F.substring(F.translate(F.substring(stream, F.lit(200), F.lit(16)), "abcdef", "012345"), F.lit(1), F.greatest(F.floor(attempt / 4).cast("int") - 1, F.lit(0)))  # digits that later attempts add
    phone = F.when(canon.rlike("^1[2-9]?[0-9]{2}555[0-9]{4}$") | canon.rlike("^1[0-9]{10}$"), nanp).otherwise(F.concat(F.substring(canon, 1, 2), F.substring(digits, F.lit(3), n)))
    phone, ssn = F.concat(phone, longer), F.concat(F.lit("9"), F.substring(digits, F.lit(2), n), longer)
    bban = _reshape(F.translate(F.substring(canon, F.lit(5), n), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), stream, "abcdefghijklmnopqrstuvwxyz")
    iban = F.concat(F.substring(canon, 1, 2), F.lpad((98 - _mod97(F.concat(F.upper(bban), F.substring(canon, 1, 2), F.lit("00")))).cast("string"), 2, "0"), F.upper(bban))
    card = _check_digit(F.concat(F.substring(canon, 1, 1), F.substring(digits, F.lit(2), n - 2)))
    return F.when(type_ == "EMAIL", mail).when(type_ == "SECRET", secret).when(type_ == "IP", address).when(type_ == "PHONE", phone).when(type_ == "SSN", ssn).when(type_ == "CARD", card).when(type_ == "IBAN", iban).when(type_.startswith("GIVEN") | (type_ == "FAMILY"), _name(type_, canon, stream, attempt))


def _name(type_: Column, value: Column, stream: Column, attempt: Column) -> Column:
    """A family name, or a given name of the gender in type_, in the script of value and in small letters."""
    words = lambda names: F.array(*[F.lit(x.lower()) for x in names])
    out = None
    for s, parts in SYLLABLES.items():
        made = F.array(*[F.element_at(words(parts), _draw(stream, F.lit(5 + 5 * k)) % len(parts) + 1) for k in range(12)])
        syllables = lambda n: F.array_join(F.slice(made, F.lit(1), F.least(n, F.lit(12))), "")  # noqa: B023, E731
        name = F.when(type_ == "FAMILY", syllables(4 + F.floor(attempt / 4).cast("int")))
        for gender in "fmx":
            known = GIVEN[s, gender] if gender != "x" else GIVEN[s, "f"] + GIVEN[s, "m"]
            longer = F.concat(syllables(1 + F.floor(attempt / 3).cast("int")), F.lit(ENDINGS[s][gender]))
            name = name.when(type_ == f"GIVEN-{gender}", F.when(attempt < 3, F.element_at(words(known), _draw(stream, F.lit(0)) % len(known) + 1)).otherwise(longer))
        ours = {"cyrillic": value.rlike(r"\p{IsCyrillic}"), "greek": value.rlike(r"\p{IsGreek}")}.get(s, F.lit(True))
        out = [(ours, name), *(out or [])]
    last = out.pop()[1]
    chosen = F.when(*out[0])
    for ours, name in out[1:]:
        chosen = chosen.when(ours, name)
    return chosen.otherwise(last)


def _cased(word: Column, drawn: Column) -> Column:
    """A name in the case of a word."""
    return F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(drawn)).otherwise(F.initcap(drawn))


def lay_out(type_: Column, value: Column, drawn: Column) -> Column:
    """A surrogate in the format of one mention: its separators, its case."""
    before = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), "[^0-9]", ""))
    numbers = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(drawn, before(i) + 1, F.lit(1))).otherwise(c)), "")
    numbers = F.concat(numbers, F.substring(drawn, before(F.length(value)) + 1, F.length(drawn)))  # digits of later attempts
    ahead = lambda i: F.length(_plain(F.substring(value, F.lit(1), i)))
    spaced = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(drawn, ahead(i) + 1, F.lit(1)))), "")
    upper = (value == F.upper(value)) & (value != F.lower(value))
    return F.when(type_.isin("PHONE", "SSN", "CARD"), numbers).when(type_ == "IBAN", spaced).when(type_.isin("EMAIL", "SECRET") & upper, F.upper(drawn)).otherwise(drawn)


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """type, canon, attempt, drawn of distinct entities(type, canon): no surrogate twice, none that is an entity itself."""
    have = cut(entities.withColumn("attempt", F.lit(0)).withColumn("drawn", surrogate(F.col("type"), F.col("canon"), F.col("attempt"), key)), "entities")
    for _ in range(ROUNDS):
        # the first of each surrogate keeps it: one ordered string, so the choice is a partial aggregate
        order = F.concat(F.lpad(F.col("attempt").cast("string"), 4, "0"), F.lit(":"), F.col("canon"))
        shared = have.groupBy("type", "drawn").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")
        taken = have.select("type", F.col("canon").alias("drawn")).withColumn("real", F.lit(True))
        clash = have.join(shared, ["type", "drawn"], "left").join(taken, ["type", "drawn"], "left")
        clash = cut(clash.select("type", "canon", "attempt", "drawn", (F.col("real").isNotNull() | (F.col("first").isNotNull() & (F.col("first") != order))).alias("again")), "clashes")
        drop(have)
        if clash.where("again").isEmpty():
            return clash.drop("again")
        attempt = F.col("attempt") + F.col("again").cast("int")
        fresh = F.when(F.col("again"), surrogate(F.col("type"), F.col("canon"), F.col("attempt") + 1, key)).otherwise(F.col("drawn"))
        have = cut(clash.select("type", "canon", attempt.alias("attempt"), fresh.alias("drawn")), "entities")
        drop(clash)
    raise ValueError(f"surrogates of some type are used up: entities still clash after {ROUNDS} rounds")


def _names(found: DataFrame) -> DataFrame:
    """_key, value, at, word, initial (whether it is one), type and canon of each word of the names found, titles left out."""
    titles = F.regexp_extract("value", rf"^(?:{_TITLE}\.? )+", 0)
    own = found.where("type = 'NAME'").select("_key", "value", titles.alias("titles"), F.split(F.substring(F.col("value"), F.length(titles) + 1, F.length("value")), " ").alias("words"))
    tells = lambda g: F.col("titles").rlike(r"(?:^| )(?:" + "|".join(TITLES[g]) + r")\.? ")
    own = own.withColumn("gender", F.when(tells("f"), "f").when(tells("m"), "m").otherwise("x"))
    own = own.select("_key", "value", "titles", "gender", F.element_at("words", -1).alias("family"), F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    own = own.withColumn("initial", F.col("word").rlike(r"^\p{Lu}\.$")).withColumn("canon", F.lower("word"))
    # a given name has one gender in the corpus, or none
    genders = own.where("at < n - 1").groupBy("canon").agg(F.max(F.when(F.col("gender") == "f", 1)).alias("f"), F.max(F.when(F.col("gender") == "m", 1)).alias("m"))
    genders = genders.select("canon", F.when(F.col("f").isNotNull() & F.col("m").isNull(), "f").when(F.col("m").isNotNull() & F.col("f").isNull(), "m").otherwise("x").alias("of"))
    own = own.join(genders, "canon", "left")
    return own.withColumn("type", F.when(F.col("at") == F.col("n") - 1, F.lit("FAMILY")).otherwise(F.concat(F.lit("GIVEN-"), F.col("of"))))


def _named(parts: DataFrame, drawn: DataFrame) -> DataFrame:
    """_key, type, value, surrogate of names, and bare: the forms without titles, longest first, with theirs."""
    parts = parts.join(drawn.select("type", "canon", "drawn"), ["type", "canon"])
    # an initial is that of a name of the document which it may stand for, or else its own surrogate's
    same = Window.partitionBy("_key", F.lower("family"), F.substring("canon", 1, 1))
    whole = F.max(F.when((F.col("at") < F.col("n") - 1) & ~F.col("initial"), F.substring("drawn", 1, 1))).over(same)
    word = F.when(F.col("initial"), F.concat(F.upper(F.coalesce(whole, F.substring("drawn", 1, 1))), F.lit("."))).otherwise(_cased(F.col("word"), F.col("drawn")))
    parts = parts.withColumn("made", word).groupBy("_key", "value", "titles").agg(F.sort_array(F.collect_list(F.struct("at", "word", "made"))).alias("words"))
    join = lambda field, k=1: F.array_join(F.transform(F.slice("words", F.lit(k), F.size("words")) if k == 1 else F.slice("words", -1, 1), lambda w: w[field]), " ")
    form = lambda k: F.struct(F.lit("NAME").alias("type"), join("word", k).alias("value"), join("made", k).alias("surrogate"))
    return parts.select("_key", F.lit("NAME").alias("type"), "value", F.concat("titles", join("made")).alias("surrogate"), F.array(form(1), form(-1)).alias("bare"))


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with text replaced, and n_replaced (int) and entities (array of type, value, surrogate) beside its columns.

    Null text: null, nothing replaced. Empty text: empty. Null doc_id, repeated rows, other columns: kept as they are,
    whatever their names; columns named n_replaced or entities are replaced by ours. No rows: no rows.
    """
    rows, columns = with_rest(docs, ("text", "string"))
    some = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(ANY), F.lit(False))
    kinds = "array<struct<type:string,value:string,surrogate:string>>"
    empty = F.array().cast(kinds)
    text_key = F.xxhash64("text", F.octet_length("text"))
    tokens = F.regexp_extract_all("text", F.lit(ANY), 0)
    found = rows.where(some).select(text_key.alias("_key"), F.explode(F.array_distinct(F.flatten(F.transform(tokens, split_cards)))).alias("value"))
    found = found.select("_key", "value", kind(F.col("value")).alias("type")).where("type is not null").distinct()
    found = cut(found.withColumn("canon", canonical(F.col("type"), F.col("value"))), "mentions")
    names = cut(_names(found), "names")
    others = found.where("type <> 'NAME'")
    drawn = assign(others.select("type", "canon").unionByName(names.select("type", "canon")).distinct(), key)
    mapped = others.join(drawn, ["type", "canon"]).select("_key", "type", "value", lay_out(F.col("type"), F.col("value"), F.col("drawn")).alias("surrogate"), empty.alias("bare"))
    mapped = mapped.unionByName(_named(names, drawn)).groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("type", "value", "surrogate"))).alias("entities"), F.array_distinct(F.flatten(F.collect_list("bare"))).alias("bare"))
    # names without titles: a document's own pattern; of equal forms the first counts
    longest = F.array_sort(F.array_distinct(F.transform("bare", lambda e: F.struct((-F.length(e["value"])).alias("n"), e["value"].alias("value")))))
    pattern = F.when(F.size("bare") > 0, F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.array_join(F.transform(longest, lambda e: e["value"]), "|"), F.lit(r")(?!\p{L})"))).otherwise(F.lit(ANY))
    touched = rows.where(some).withColumn("_key", text_key).join(mapped.withColumn("pattern", pattern), "_key", "left").withColumn("pattern", F.coalesce("pattern", F.lit(ANY)))
    everything = F.concat(F.coalesce("entities", empty), F.coalesce("bare", empty))
    touched = touched.withColumn("parts", F.transform(F.regexp_extract_all("text", F.col("pattern"), 0), split_cards)).withColumn("gaps", F.split("text", F.col("pattern"), -1))
    touched = touched.withColumn("entities", F.filter(everything, lambda e: F.array_contains(F.flatten("parts"), e["value"])))
    once = F.aggregate("entities", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, e: F.when(F.map_contains_key(m, e["value"]), m).otherwise(F.map_concat(m, F.create_map(e["value"], e["surrogate"]))))
    touched = touched.withColumn("map", once)
    replaced = lambda t: F.array_join(F.transform(t, lambda p: F.coalesce(F.element_at(F.col("map"), p), p)), "")
    pieces = F.zip_with("gaps", "parts", lambda g, t: F.concat(g, F.coalesce(replaced(t), F.lit(""))))
    many = F.size(F.filter(F.flatten("parts"), lambda p: F.map_contains_key(F.col("map"), p)))
    touched = touched.select("_rest", F.when(F.size("map") == 0, F.col("text")).otherwise(F.array_join(pieces, "")).alias("text"), many.alias("n_replaced"), "entities")
    out = rows.where(~some).select("_rest", "text", F.lit(0).alias("n_replaced"), empty.alias("entities")).unionByName(touched)
    kept = [F.col("text") if c == "text" else F.col("_rest")[c].alias(c) for c in columns if c not in ("n_replaced", "entities")]
    return out.select(*kept, "n_replaced", F.col("entities").cast(kinds).alias("entities"))
