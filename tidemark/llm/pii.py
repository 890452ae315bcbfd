"""PII surrogates in SQL functions alone: detected entities get keyed replacements of the same type and format.

Entities are normalised (case, separators), so that all writings of one get the same surrogate, over the whole corpus. A
name is two entities, its first and its last part: whoever is named with and without a first name keeps one last name. A
surrogate is drawn from a keyed hash (HMAC): digits for digits and letters for letters of the same case, in the same
places; octets for octets; a valid check digit for a valid one; names of the same script and gender. Distinctness is
checked on the table of distinct entities: of those that drew the same surrogate the first keeps it and the others draw
again, as do those that drew one already taken or one that is itself an entity of the corpus, until none is left. Every
few draws the form grows by a sign, so that this ends even where the entities fill their form.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import bound, materialise, row_key

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TITLES_M, TITLES_F = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н"], ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа"]
NAME = r"[\p{Lu}][\p{Ll}]+(?:-[\p{Lu}][\p{Ll}]+)?"
#: Kinds with their patterns, the first that fits deciding.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name_m": rf"(?<![\p{{L}}])(?:{'|'.join(TITLES_M)})\.? {NAME}(?: {NAME})?",
    "name_f": rf"(?<![\p{{L}}])(?:{'|'.join(TITLES_F)})\.? {NAME}(?: {NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has: a text without either has none, and is told so without trying all patterns.
SIGN, TITLE = "[@0-9]", rf"(?:{'|'.join(TITLES_M + TITLES_F)})\.? \p{{Lu}}"
#: First names by gender and script, and the syllables of last names; a second syllable group makes the space large.
FIRST = {
    ("m", "latin"): ["Adam", "Boris", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul"],
    ("f", "latin"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Frida", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей", "Тимур"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Кира", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zu"],
    "cyrillic": ["ба", "де", "фи", "го", "ха", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ве", "ви", "зу"],
}
#: Draws before the form grows by a sign.
DRAWS = 3


def kind_of(hit: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, p in reversed(PATTERNS.items()):
        out = F.when(hit.rlike(f"^(?:{p})$"), k).otherwise(out)
    return out


def _titleless(hit: Column) -> Column:
    return F.regexp_replace(hit, rf"^(?:{'|'.join(TITLES_M + TITLES_F)})\.? ", "")


def normal_form(kind: Column, hit: Column) -> Column:
    """What all writings of one entity have in common."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    return F.when(kind.isin("card", "ssn"), digits).when(kind == "phone", F.when(F.length(digits) == 10, F.concat(F.lit("1"), digits)).otherwise(digits)).when(kind.startswith("name"), F.lower(_titleless(hit))).otherwise(F.lower(hit))


def entities_of(kind: Column, hit: Column) -> Column:
    """array<struct<kind, norm>>: the entity of a hit; of a name its first part, if there, and its last."""
    norm = normal_form(kind, hit)
    one = lambda k, n: F.struct(k.alias("kind"), n.alias("norm"))
    words = F.split(norm, " ")
    last = one(F.lit("last"), F.element_at(words, -1))
    name = F.when(F.size(words) > 1, F.array(one(F.replace(kind, F.lit("name"), F.lit("first")), F.element_at(words, 1)), last)).otherwise(F.array(last))
    return F.when(kind.startswith("name"), name).otherwise(F.array(one(kind, norm)))


def keyed(key: bytes, message: Column) -> Column:
    """HMAC-SHA512 of a string, as hex digits."""
    block = (key if len(key) <= 128 else hashlib.sha512(key).digest()).ljust(128, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in block))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 512))), 512)


def _checksum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, its last digit being the check digit's place."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda d, i: F.when((n - i) % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


#: Endings of first names that are put together, by gender and script; no ending of one gender ends a name of the other.
ENDINGS = {
    ("m", "latin"): ["ron", "tor", "dan", "vik", "mas", "len", "gar", "bert", "nik", "lor", "ric", "mir", "wald", "ken", "pol", "sten"],
    ("f", "latin"): ["ra", "tia", "dana", "via", "lena", "gara", "nika", "lora", "zana", "rica", "mira", "bela", "kena", "pola", "sia", "lia"],
    ("m", "cyrillic"): ["рон", "тор", "дан", "вик", "мас", "лен", "гар", "берт", "ник", "лор", "рик", "мир", "вальд", "кен", "пол", "стен"],
    ("f", "cyrillic"): ["ра", "тия", "дана", "вия", "лена", "гара", "ника", "лора", "зана", "рика", "мира", "бела", "кена", "пола", "сия", "лия"],
}


def _draw(key: bytes, kind: Column, norm: Column, attempt: int) -> Column:
    """The surrogate's normal form that an entity draws at an attempt."""
    stream, grown = keyed(key, F.concat_ws("|", kind, norm, F.lit(str(attempt)))), attempt // DRAWS
    number = lambda i: F.conv(F.substring(stream, (i % 42) * 3 + 1, F.lit(3)), 16, 10).cast("int")
    low, figures = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def letter(c: Column, i: Column) -> Column:
        pick = lambda a: F.substring(F.lit(a), number(i) % len(a) + 1, F.lit(1))
        return F.when(c.rlike("[a-z]"), pick(low)).when(c.rlike("[0-9]"), pick(figures)).otherwise(c)

    spell = lambda x: F.array_join(F.transform(F.split(x, ""), letter), "")
    spelled = spell(F.concat(norm, F.lit("0" * grown)))
    last_dot = F.length(norm) - F.locate(".", F.reverse(norm)) + 1
    own = F.regexp_replace(F.substring(norm, F.lit(1), last_dot - 1), "@", "a" * grown + "@")
    email = F.concat(spell(own), F.substring(norm, last_dot, F.length(norm)))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (number(i) % 254 + 1).cast("string")), ".")
    head = F.substring(spelled, F.lit(1), F.length(spelled) - 1)
    check = F.concat(head, F.pmod(-_checksum(F.concat(head, F.lit("0"))), F.lit(10)).cast("string"))
    card = F.when(_checksum(norm) % 10 == 0, check).otherwise(spelled)
    country = F.substring(norm, F.lit(1), F.length(norm) - 10)
    area = F.lit("555") if attempt < DRAWS else F.substring(spelled, F.length(country) + 1, F.lit(3))
    phone = F.concat(country, area, F.substring(spelled, F.length(country) + 4, F.length(spelled)))
    script = F.when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")

    def syllables(s: str, n: int) -> Column:
        return F.concat(*[F.element_at(F.array(*[F.lit(x) for x in SYLLABLES[s]]), number(F.lit(i)) % 16 + 1) for i in range(1, n + 1)])

    name = F.lit("")
    for s in SYLLABLES:
        made = syllables(s, 5 + grown)
        for gender in "mf":
            listed = F.element_at(F.array(*[F.lit(x.lower()) for x in FIRST[gender, s]]), number(F.lit(0)) % 16 + 1)
            ending = F.element_at(F.array(*[F.lit(x) for x in ENDINGS[gender, s]]), number(F.lit(40)) % len(ENDINGS[gender, s]) + 1)
            name = F.when((kind == f"first_{gender}") & (script == s), listed if attempt == 0 else F.concat(syllables(s, 2 + grown), ending)).otherwise(name)
        name = F.when((kind == "last") & (script == s), made).otherwise(name)
    named = kind.isin("first_m", "first_f", "last")
    return F.when(kind == "ip", octets).when(named, name).when((kind == "email") & norm.contains("@"), email).when(kind == "phone", phone).when(kind == "card", card).otherwise(spelled)


def surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, norm, surrogate of the distinct entities(kind, norm): no two of a kind share a surrogate, and none is an entity.

    A round of draws each time, on those still without one; the form's growth makes the rounds few. No entities: no rows."""
    known = materialise(entities.distinct(), "entities")
    left, done, attempt = known, None, 0
    while attempt == 0 or not left.isEmpty():
        drawn = left.withColumn("surrogate", _draw(key, F.col("kind"), F.col("norm"), attempt))
        free = drawn.join(known.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = materialise(free.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm")).select("kind", "norm", "surrogate"), "surrogates")
        done = won if done is None else done.unionAll(won)
        left = materialise(left.join(won, ["kind", "norm"], "left_anti"), "undrawn")
        attempt += 1
    return done


def _written(hit: Column, kind: Column, norm: Column, surrogate: Column) -> Column:
    """The surrogate written as the hit is: its separators and capitals, a name's title. What it has grown by stands at the end."""
    title = F.regexp_extract(hit, rf"^((?:{'|'.join(TITLES_M + TITLES_F)})\.? )", 1)
    chars = F.split(hit, "")
    is_mark = lambda c: ~c.rlike("[0-9]")
    skip = F.length(norm) - F.length(F.regexp_replace(hit, "[^0-9]", ""))  # a country code that isn't written
    zero = F.struct(skip.alias("at"), F.lit("").alias("out"))
    step = lambda acc, c: F.struct((acc["at"] + F.when(is_mark(c), 0).otherwise(1)).alias("at"), F.concat(acc["out"], F.when(is_mark(c), c).otherwise(F.substring(surrogate, acc["at"] + 1, F.lit(1)))).alias("out"))
    spaced = F.aggregate(chars, zero, step, lambda acc: F.concat(acc["out"], F.substring(surrogate, acc["at"] + 1, F.length(surrogate))))
    cased = F.array_join(F.zip_with(chars, F.split(surrogate, ""), lambda c, s: F.when(c.rlike("[A-Z]"), F.upper(s)).otherwise(s)), "")
    return F.when(kind.startswith("name"), F.concat(title, F.initcap(surrogate))).when(kind == "ip", surrogate).when(kind == "email", cased).otherwise(spaced)


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with every entity of the text replaced, and n_pii, the number replaced, in place of a column of that name; all others as they are.

    key: a secret of the run; who has it can draw the surrogates again. Kinds: e-mail and IP addresses, card, phone and social
    security numbers, and names after a title (a last name that stands alone is no entity). Null texts stay null. Repeated
    rows stay and read alike; an empty table gives no rows. Texts without entities aren't shuffled. n_chars, if there, is set
    anew."""
    has = F.coalesce((F.col("text").rlike(SIGN) | F.col("text").rlike(TITLE)) & F.col("text").rlike(ANY), F.lit(False))
    rows = docs.where(has).select(*row_key(), F.expr("regexp_extract_all(text, '{}', 0)".format(ANY.replace("\\", "\\\\").replace("'", "\\'"))).alias("hits"))
    hit = rows.distinct().select("rk_id", "rk_text", F.posexplode("hits").alias("place", "hit")).withColumn("hit_kind", kind_of(F.col("hit")))
    hits = materialise(hit.select("*", F.posexplode(entities_of(F.col("hit_kind"), F.col("hit"))).alias("part", "e")).select("*", "e.kind", "e.norm").drop("e"), "pii")
    table = surrogates(hits.select("kind", "norm"), key)
    same = ["rk_id", "rk_text", "place", "hit", "hit_kind"]
    joined = hits.join(table, ["kind", "norm"]).groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("part", "norm", "surrogate"))).alias("p"))
    whole = lambda c: F.array_join(F.col(f"p.{c}"), " ")
    new = joined.select("rk_id", "rk_text", F.struct("place", _written(F.col("hit"), F.col("hit_kind"), whole("norm"), whole("surrogate")).alias("new")).alias("s"))
    of = new.groupBy("rk_id", "rk_text").agg(F.array_sort(F.collect_list("s")).alias("news"))
    docs = docs.drop("n_pii")
    names = [(c, f"__{i}") for i, c in enumerate(docs.columns)]  # docs may have columns of any name
    marked = docs.where(has).select(*[F.col(f"`{c}`").alias(n) for c, n in names], *[k.alias(f"__{n}") for k, n in zip(row_key(), ("id", "hash"), strict=True)])
    both = marked.join(of, F.expr("__id <=> rk_id AND __hash = rk_text"))
    text = dict(names)["text"]
    pieces = bound(F.col("news.new"), lambda n: F.array_join(F.transform(F.split(text, ANY, -1), lambda p, i: F.concat(p, F.coalesce(F.get(n, i), F.lit("")))), ""))
    changed = both.withColumn(text, pieces)
    if "n_chars" in docs.columns:
        changed = changed.withColumn(dict(names)["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
    found = changed.select(*[F.col(n).alias(c) for c, n in names], F.size("news").cast("long").alias("n_pii"))
    return found.unionAll(docs.where(~has).select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).cast("long").alias("n_pii")))
