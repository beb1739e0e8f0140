"""Replacement of personal data by keyed surrogates, in DataFrame functions only.

Entities are found by one pattern: e-mail addresses, IP addresses of both versions, IBANs, phone numbers, social security numbers,
payment card numbers, access tokens, dates of birth, and names: capitalised words after a title, or after one of the first names
listed here (Latin, Greek and Cyrillic). Other names, postal addresses and other dates are not found. A surrogate is drawn from a
keyed SHA-512 stream of the entity and keeps its type: digits stay digits, letters stay letters of their case and script,
separators stay; card numbers and IBANs that pass their check do so again, the latter keep their country, phone numbers their
country code; mail gets a reserved domain, addresses a reserved range, dates stay dates.

Names are replaced word by word: one table of all words of names gives every word its surrogate, by script and, for first names, by
gender, so ``Mrs Bell``, ``Anna Bell`` and ``Anna-Lena Bell`` still share what they shared. Equal entities get equal surrogates.

Distinct entities must stay distinct, and no surrogate may be an entity that occurs: the distinct entities of all documents
are drawn with a nonce; of those that share a surrogate the earliest keeps it, the others and those that hit a real entity
draw again, until none is left. Where a type's space gets crowded, surrogates grow by a sign every ``WIDEN`` rounds. Each round is
two aggregations over distinct entities and is checkpointed.

Only rows with entities are shuffled: their entity lists meet the surrogates by entity (entities that fill many texts are dealt
over tasks), are gathered again per distinct text, and the text is put together from its plain parts and the surrogates.

Defined cases: null and empty texts and texts without entities are returned as they are; repeated rows and equal texts get
equal results, ids are never used; long texts are carried whole; an empty table gives no rows; other columns are kept, whatever
their names (those starting with ``_pii`` are refused).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators.skew import hot_values, salted_join
from scoreloom.session import reliable_checkpoints

KEY = "surrogate-key"
MAX_ROUNDS, WIDEN = 256, 16

# Titles before a name, by gender, and those of any gender.
TITLES_M = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr"]
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Señorita"]
TITLES_ANY = ["Dr", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Professeur", "Mx"]

# Common first names, by gender, that are hardly ever other words.
FIRST_M = [
    "Alexander", "Andrew", "Anthony", "Benjamin", "Carlos", "Charles", "Christopher", "Daniel", "David", "Edward", "Francisco", "François", "Frédéric", "George", "Günther", "Hans", "Heinrich", "Henry",
    "James", "Javier", "Jean", "Johannes", "John", "José", "Joseph", "Jürgen", "Klaus", "Louis", "Luis", "Manuel", "Martin", "Matthew", "Michael", "Miguel", "Nicolas", "Oliver", "Patrick", "Paul", "Pedro",
    "Peter", "Philippe", "Pierre", "Richard", "Robert", "Stefan", "Stephen", "Thomas", "Walter", "William", "Wolfgang",
    "Александр", "Алексей", "Андрей", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей", "Γιώργος", "Γιάννης", "Δημήτρης", "Κώστας", "Νίκος",
]
FIRST_F = [
    "Alice", "Amélie", "Andrea", "Ana", "Anna", "Anne", "Barbara", "Carmen", "Catherine", "Charlotte", "Christine", "Claudia", "Elena", "Elisabeth", "Elizabeth", "Emily", "Emma", "Françoise", "Gabriele",
    "Hannah", "Helen", "Helga", "Isabel", "Jane", "Jennifer", "Jessica", "Julia", "Karen", "Karin", "Katharina", "Laura", "Linda", "Lucía", "Margaret", "María", "Maria", "Marie", "Mary", "Monika", "Nathalie",
    "Nicole", "Olivia", "Patricia", "Rebecca", "Sabine", "Sarah", "Sofia", "Sophie", "Susan", "Ursula",
    "Анна", "Екатерина", "Елена", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία",
]
# What stands before a date of birth.
BORN = ["born", "born on", "date of birth", "DOB", "geboren", "geboren am", "né le", "née le", "nacido el", "nacida el"]

_WORD = r"[\p{L}\p{N}._%+-]"
_any = lambda words: "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"
_TITLE, _FIRST, _BORN = _any([*TITLES_M, *TITLES_F, *TITLES_ANY]), _any([*FIRST_M, *FIRST_F]), _any(BORN)
_CAP, _OCTET = r"\p{Lu}\p{Ll}+", r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})"
#: By type, in the order in which they are tried. Each begins with a look at the next sign, which is cheap where it fails.
KINDS = {
    "email": rf"(?<!{_WORD}){_WORD}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ipv6": r"(?=[0-9A-Fa-f]{1,4}:)(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "ip": rf"(?=\d)(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "birth": rf"(?=[bdDgn])(?<!\w){_BORN}:? {_DATE}(?!\w)",
    "iban": r"(?=[A-Z]{2}\d)(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?=\d)(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?=[\d+(])(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{5,8}|00\d{2}[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){2,3})(?![\w-])",
    "card": r"(?=\d)(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w|-\d)",
    "secret": r"(?=[0-9a-gsA-F])(?<!\w)(?:(?=[a-f]*+\d)[0-9a-f]{32,}+|(?=[A-F]*+\d)[0-9A-F]{32,}+|AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)(?!\w)",
    "name": rf"(?=\p{{Lu}})(?<!\w)(?:(?:{_TITLE}\.? )+{_CAP}(?:[ -]{_CAP}){{0,2}}|{_FIRST}(?:[ -]{_CAP}){{1,3}})(?!\w)",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Cheap test that every text with an entity passes.
_MAYBE = rf"[0-9@]|::|(?=\p{{Lu}})(?:{_TITLE}\.?|{_FIRST})[ -]\p{{Lu}}|AKIA[A-Z]{{16}}|gh[pousr]_[A-Za-z]{{36}}|sk-[A-Za-z]{{20}}|[A-Fa-f]{{1,4}}:[A-Fa-f]"


def entities(text: Column) -> Column:
    """All entities of a text in order, repeats included."""
    return F.when(text.rlike(_MAYBE), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(entity: Column) -> Column:
    """The type of an entity."""
    return reduce(lambda chain, item: chain.when(entity.rlike(rf"\A(?:{item[1]})\z"), F.lit(item[0])), KINDS.items(), F.when(entity.isNull(), F.lit(None).cast("string")))


def _pick(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), (at % len(letters)).cast("int") + 1, F.lit(1))


def _byte(stream: Column, i: Column) -> Column:
    """Byte i (taken round) of a stream of 128 bytes in hexadecimal."""
    return F.conv(F.substring(stream, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


# Letters of the scripts that keep theirs, and the parts that made-up names are put together from.
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ACCENTED = "àáâäåèéêëìíîïòóôöùúûüñç"
_CYRILLIC, _GREEK = "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
_HEAD = ["B", "D", "F", "G", "H", "K", "L", "M", "N", "P", "R", "S", "T", "V", "W", "Z"]
_MIDDLE = ["al", "an", "ar", "el", "en", "er", "il", "in", "ir", "ol", "on", "or", "ul", "un", "ur", "am"]
_JOIN = ["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "z", "st"]


def _redraw(text: Column, stream: Column, shift: int = 0) -> Column:
    """Every digit and letter replaced by another of its class."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i + shift)
        low = (
            F.when(c.rlike("[0-9]"), _pick("0123456789", b))
            .when(c.rlike("[a-z]"), _pick(_LOWER, b))
            .when(c.rlike("[A-Z]"), _pick(_UPPER, b))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(_CYRILLIC, b))
            .when(c.rlike(r"\p{IsGreek}"), _pick(_GREEK, b))
            .when(c.rlike(r"\p{L}"), _pick(_ACCENTED, b))
            .otherwise(c)
        )
        return F.when(c.rlike(r"\p{Lu}"), F.upper(low)).otherwise(low)

    return F.array_join(F.transform(F.split(text, "(?!^)(?=.)"), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits; 0 is valid."""

    def weigh(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    return F.aggregate(F.transform(F.split(F.reverse(digits), "(?!^)(?=.)"), weigh), F.lit(0), lambda a, x: a + x) % 10


def _titles(name: Column) -> Column:
    return F.regexp_extract(name, rf"\A(?:{_TITLE}\.? )+(?=\p{{Lu}}\p{{Ll}})", 0)


def name_words(name: Column) -> Column:
    """The words of a name after its titles, each with whether it is a first name, and the gender that title or name tells."""
    title = _titles(name)
    words = F.regexp_extract_all(F.substring(name, F.length(title) + 1, F.length(name)), F.lit(r"\p{L}+"), F.lit(0))
    titled = lambda some: F.arrays_overlap(F.split(F.regexp_replace(title, r"\.", ""), " "), F.array(*[F.lit(t) for t in some]))
    gender = F.when(titled(TITLES_F) | words[0].isin(FIRST_F), "f").when(titled(TITLES_M) | words[0].isin(FIRST_M), "m").otherwise("x")
    return F.transform(words, lambda w, i: F.struct(w.alias("word"), (i + 1 < F.size(words)).alias("first"), F.when(i + 1 < F.size(words), gender).alias("gender")))


def _name_word(word: Column, kind: Column, s: Column, nonce: Column) -> Column:
    """A made-up word of a name: kind is ``last`` or ``first`` with a gender, which its ending shows; its script stays."""
    at = lambda k: _byte(s, F.lit(k))
    end = F.when(kind == "last", _of(["er", "sen", "ov", "ell"], at(4))).when(kind == "first f", F.lit("a")).when(kind == "first m", F.lit("o")).otherwise(F.lit("e"))
    more = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(nonce / WIDEN).cast("int")), lambda k: F.when(k > 0, _of(_MIDDLE, _byte(s, k + 5))).otherwise("")), "")
    made = F.concat(_of(_HEAD, at(0)), _of(_MIDDLE, at(1)), _of(_JOIN, at(2)), _of(_MIDDLE, at(3)), more, _of(_JOIN, at(5)), end)
    in_script = lambda letters: F.initcap(F.translate(F.lower(made), "abdefghiklmnoprstuvwz", letters))
    return F.when(word.rlike(r"\p{IsCyrillic}"), in_script("абдефгхиклмнопрстувуз")).when(word.rlike(r"\p{IsGreek}"), in_script("αβδεφγχικλμνοπρστυβωζ")).otherwise(made)


def _of(parts: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in parts]), (at % len(parts)).cast("int") + 1)


def _remainder(text: Column) -> Column:
    """An IBAN's remainder modulo 97, its first four signs moved to the end and letters counted from 10; 1 is valid."""
    plain = F.regexp_replace(text, " ", "")
    moved = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "(?!^)(?=.)")

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), a * 10 + F.try_to_number(c, F.lit("9")).cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(moved, F.lit(0), lambda a, c: step(a, c).cast("int"))


def _checked_iban(made: Column, entity: Column) -> Column:
    """Check digits that are right where the entity's are."""
    open_ = F.concat(F.substring(made, 1, 2), F.lit("00"), F.substring(made, F.lit(5), F.length(made)))
    digits = F.lpad((98 - _remainder(open_)).cast("string"), 2, "0")
    return F.when(_remainder(entity) == 1, F.concat(F.substring(made, 1, 2), digits, F.substring(made, F.lit(5), F.length(made)))).otherwise(made)


def surrogates(rows: DataFrame, key: str) -> DataFrame:
    """(entity, kind, nonce, surrogate): the nonce-th surrogate of every (entity, kind, nonce).

    The stream and what is redrawn by it are columns of their own: as one expression it would hold the stream's hashes over a
    thousand times, which the driver keeps for each round, and hash an entity anew for every sign."""
    entity, kind, nonce = F.col("entity"), F.col("kind"), F.col("nonce")
    person = kind.isin("last", "first f", "first m", "first x")
    seeded = lambda half: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, nonce.cast("string"), F.lit(half), entity).cast("binary"), 512)
    named = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("name"), nonce.cast("string"), entity).cast("binary"), 512)
    rows = rows.select("entity", "kind", "nonce", F.when(person, named).otherwise(F.concat(seeded("a"), seeded("b"))).alias("stream"))
    stream = F.col("stream")
    # What is redrawn: a mail's two parts, or all but the first signs of the others.
    domain = F.substring_index(entity, "@", -1)
    code = F.regexp_extract(entity, r"\A(?:\+\d{1,3}(?=[ .(-])|0+)", 0)
    head = F.regexp_extract(entity, r"\A(?:AKIA|gh[pousr]_|sk-)", 0)
    kept = F.when(kind == "phone", F.length(code)).when(kind == "card", 1).when(kind == "iban", 2).when(kind == "secret", F.length(head)).otherwise(0)
    other = F.concat(F.substring(entity, F.lit(1), kept), _redraw(F.substring(entity, kept + 1, F.length(entity)), stream))
    redrawn = F.when(kind == "email", _redraw(F.substring_index(entity, "@", 1), stream)).when(~person & ~kind.isin("ip", "ipv6", "birth"), other)
    host = F.when(kind == "email", _redraw(F.substring_index(domain, ".", 1), stream, 64))
    rows = rows.select("entity", "kind", "nonce", "stream", redrawn.alias("redrawn"), host.alias("host"))
    redrawn, host = F.col("redrawn"), F.col("host")
    tld = F.lower(F.substring_index(domain, ".", -1))
    email = F.concat(redrawn, F.lit("@"), host, F.lit(".example."), F.when(tld.isin("com", "net", "org"), tld).otherwise(F.lit("org")))
    # 240.0.0.0/4 and 2001:db8::/32 are reserved and belong to nobody.
    ip = F.array_join(F.array((_byte(stream, F.lit(0)) % 15 + 240).cast("string"), *[_byte(stream, F.lit(i)).cast("string") for i in range(1, 4)]), ".")
    ipv6 = F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring(stream, 4 * i + 1, 4)) for i in range(6)])
    day = F.date_add(F.lit("1930-01-01").cast("date"), (_byte(stream, F.lit(0)) * 256 + _byte(stream, F.lit(1))) % 29000)
    when_ = F.regexp_extract(entity, _DATE, 0)
    dotted = F.when(when_.rlike(r"\A\d\d.\d\d."), F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "d.M.yyyy"))
    written = F.when(when_.contains("-"), F.date_format(day, "yyyy-MM-dd")).when(when_.contains("/"), F.translate(dotted, ".", "/")).otherwise(dotted)
    birth = F.concat(F.substring(entity, F.lit(1), F.length(entity) - F.length(when_)), written)
    digits = F.regexp_replace(redrawn, "[^0-9]", "")
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    # Valid numbers get the valid check digit, others one that is not.
    last = F.when(_luhn(F.regexp_replace(entity, "[^0-9]", "")) == 0, check).otherwise((check + 1 + _byte(stream, F.lit(100)) % 9) % 10)
    card = F.concat(F.substring(redrawn, F.lit(1), F.length(redrawn) - 1), last.cast("string"))
    iban = _checked_iban(redrawn, entity)
    hexed = F.array_join(F.transform(F.split(entity, "(?!^)(?=.)"), lambda c, i: F.when(c.rlike("[A-F]"), _pick("ABCDEF", _byte(stream, i))).when(c.rlike("[a-f]"), _pick("abcdef", _byte(stream, i))).otherwise(_pick("0123456789", _byte(stream, i)))), "")
    secret = F.when(entity.rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z"), hexed).otherwise(redrawn)
    # A crowded type grows by a sign every WIDEN rounds.
    more = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(nonce / WIDEN).cast("int")), lambda k: F.when(k > 0, (_byte(stream, k + 60) % 10).cast("string")).otherwise("")), "")
    made = (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "birth", birth).when(kind == "card", card).when(kind == "iban", iban)
        .when(kind == "secret", secret).otherwise(redrawn)
    )
    return rows.select("entity", "kind", "nonce", F.when(person, _name_word(entity, kind, stream, nonce)).otherwise(F.concat(made, more)).alias("surrogate"))


def _one_to_one(base: DataFrame, key: str) -> DataFrame:
    """(entity, kind, surrogate) of distinct entities with kinds: one to one, and never onto an entity of the table."""
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = surrogates(base.withColumn("nonce", F.lit(0)).repartition(tasks, "entity"), key).checkpoint()
    real = table.select(F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
    for _ in range(MAX_ROUNDS):
        owner = table.groupBy("surrogate").agg(F.min(F.struct("nonce", "entity")).alias("o"), F.count("*").alias("shared"))
        clash = owner.join(real, "surrogate", "left").where((F.col("shared") > 1) | F.col("real"))
        again = table.join(clash, "surrogate").where(F.col("real") | (F.col("o.entity") != F.col("entity"))).select("entity", "kind", (F.col("nonce") + 1).alias("nonce")).checkpoint()
        if again.isEmpty():
            return table.select("entity", "kind", "surrogate")
        table = table.join(again.select("entity"), "entity", "left_anti").unionByName(surrogates(again, key)).checkpoint()
    raise ValueError("surrogates do not get distinct")


def surrogate_table(found: DataFrame, key: str = KEY) -> DataFrame:
    """(entity, kind, surrogate) for a DataFrame of distinct entities: one to one, and never onto an entity of the table."""
    reliable_checkpoints(found.sparkSession)
    base = found.select("entity", F.coalesce(kind_of(F.col("entity")), F.lit("other")).alias("kind")).checkpoint()
    names = base.where("kind = 'name'").select("entity", F.posexplode(name_words(F.col("entity"))).alias("at", "w")).select("entity", "at", "w.*")
    if names.isEmpty():
        return _one_to_one(base, key)
    # A word is a first name if it is one anywhere, and has the gender that is told for it first in the order f, m, x.
    words = names.groupBy(F.col("word").alias("entity")).agg(F.when(F.max("first"), F.concat(F.lit("first "), F.min("gender"))).otherwise("last").alias("kind"), F.count("*").alias("count")).checkpoint()
    table = _one_to_one(base.where("kind <> 'name'").unionByName(words.select("entity", "kind").join(base.select("entity"), "entity", "left_anti")), key)
    drawn = table.where("kind = 'last' or startswith(kind, 'first ')").select(F.col("entity").alias("word"), F.col("surrogate").alias("new"))
    joined = salted_join(names.select("entity", "at", "word"), drawn, "word", hot_values(words, "entity", "count"), [F.col("entity")])
    rest = F.substring(F.col("entity"), F.length(_titles(F.col("entity"))) + 1, F.length("entity"))
    gaps = F.split(rest, r"\p{L}+", -1)
    woven = F.array_join(F.flatten(F.zip_with(gaps, F.concat(F.transform("news", lambda x: x["new"]), F.array(F.lit(""))), lambda g, n: F.array(g, n))), "")
    whole = joined.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("news"))
    people = whole.select("entity", F.lit("name").alias("kind"), F.concat(_titles(F.col("entity")), woven).alias("surrogate"))
    return table.where("kind <> 'last' and not startswith(kind, 'first ')").unionByName(people)


def replace_personal_data(docs: DataFrame, *, text_col: str = "text", key: str = KEY, count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text_col``; ``count_col``, if named, gets the number of replaced entities. Who can read ``key``
    can draw the same surrogates again: hand in a secret one."""
    if any(c.startswith("_pii") for c in docs.columns) or count_col in docs.columns:
        raise ValueError("a column name clashes")
    reliable_checkpoints(docs.sparkSession)
    spotted = docs.withColumn("_pii", entities(F.col(text_col)))
    some = F.coalesce(F.size("_pii") > 0, F.lit(False))
    dirty = spotted.where(some).withColumn("_pii_key", F.sha2(F.col(text_col).cast("binary"), 256)).checkpoint()
    clean = spotted.where(~some)
    listed = dirty.select("_pii_key", F.posexplode("_pii").alias("at", "entity")).distinct()
    seen = listed.groupBy("entity").count().checkpoint()
    table = surrogate_table(seen.select("entity"), key)
    met = salted_join(listed, table.select("entity", "surrogate"), "entity", hot_values(seen, "entity"), [F.col("_pii_key"), F.col("at")])
    parts = met.groupBy("_pii_key").agg(F.sort_array(F.collect_list(F.struct("at", "surrogate"))).alias("_pii_new"))
    plain = F.split(F.col(text_col), PATTERN, -1)
    new = F.concat(F.transform("_pii_new", lambda x: x["surrogate"]), F.array(F.lit("")))
    rebuilt = F.array_join(F.flatten(F.zip_with(plain, new, lambda a, b: F.array(a, b))), "")
    extra = [] if count_col is None else [F.greatest(F.size("_pii"), F.lit(0)).alias(count_col)]
    copies = dirty.groupBy("_pii_key").count()
    joined = salted_join(dirty, parts, "_pii_key", hot_values(copies, "_pii_key"), [F.monotonically_increasing_id()])
    done = joined.select(*[rebuilt.alias(c) if c == text_col else F.col(c) for c in docs.columns], *extra)
    return clean.select(*docs.columns, *extra).unionByName(done)


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_personal_data(docs, count_col="n_replaced")
