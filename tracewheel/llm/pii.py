r"""Personal data replaced by surrogates: keyed, of the same type and format, one-to-one.

Entities are found by one pattern. Over the whole corpus each distinct entity gets one
surrogate, drawn from a keyed digest of its type and canonical form, so it is the same wherever
the entity occurs. Entities whose surrogate equals another's, or equals a value that stands in
the corpus, draw again until none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewheel.llm.common import stage, text_key

KEY = "tracewheel-surrogates"

# Forms of address and given names by gender.
MALE_TITLES = "Mr Herr Monsieur Señor Sr Mister".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Sra Señorita".split()
MALE_GIVEN = "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Peter Paul Hans Jürgen Pierre Jean Jacques Carlos José Juan Miguel Pedro Luis".split()
FEMALE_GIVEN = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Karen Nancy Lisa Anna Maria Ursula Monika Marie Claire Sophie Carmen Isabel Lucía Rosa Elena Julia".split()
MALE_CYRILLIC = "Иван Пётр Алексей Дмитрий Сергей Николай Михаил Андрей".split()
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split()
FAMILY_HEADS = "Bar Cal Dor Fen Gal Har Kel Lan Mor Nor Pel Ros Sel Tor Val Wil".split()
FAMILY_MIDS = "a e i o an en in on ar er ir or al el il ol".split()
FAMILY_TAILS = "by den dale ford gard ham land ley lock man mont sen ström ton well wick".split()
FAMILY_CYRILLIC = ("Вол Кор Мор Нов Пет Сок Тар Фед".split(), "а е и о".split(), "ков нов рин сов шин ин ев ёв".split())

#: Words before a name that is in no list; they stay.
LEADS = ("name is", "Name:", "Dear", "Sincerely,", "Regards,", "signed by", "Signed by", "Contact:", "Attn:")

_NAME = r"\p{Lu}[\p{L}'’-]*\p{Ll}"
_TITLE = "|".join(sorted(MALE_TITLES + FEMALE_TITLES + ["Dr", "Prof"], key=len, reverse=True))
_LEAD = "|".join(LEADS)
#: What stands before a name and is no part of it.
_BEFORE = rf"(?:(?:{_TITLE})\.?|{_LEAD}) "
_GIVEN = "|".join(sorted(MALE_GIVEN + FEMALE_GIVEN + MALE_CYRILLIC + FEMALE_CYRILLIC, key=len, reverse=True))

#: (type, pattern) in order of preference; together they are one alternation. Each starts where a run does, so a
#: long run without an entity is tried once.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"),
    ("ip6", r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+[1-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,5}|0[1-9](?:[ .-][0-9]{2}){4}|[2-9][0-9]{9})(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])"),
    ("key", r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255}|glpat-[A-Za-z0-9_-]{20,255}|xox[abprs]-[A-Za-z0-9-]{10,255}|sk-[A-Za-z0-9_-]{20,255}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])"),
    ("person", rf"(?<!\p{{L}})(?:(?:{_TITLE})\.? (?:{_NAME}(?: {_NAME})?)|(?:{_LEAD}) (?!(?:{_TITLE})(?!\p{{L}})){_NAME} {_NAME}|(?:{_GIVEN}) {_NAME})(?!\p{{L}})"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)


def entity_type(raw: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS):
        # The look-arounds hold at either end of the entity itself.
        out = F.when(raw.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def canonical(kind: Column, raw: Column) -> Column:
    """What makes two spellings one entity: letter case of addresses, separators of numbers, titles of names."""
    return (
        F.when(kind.isin("email", "ip6"), F.lower(raw))
        .when(kind.isin("phone", "card", "ssn", "iban"), F.regexp_replace(raw, "[ ().-]", ""))
        .when(kind == "person", F.regexp_replace(raw, f"^{_BEFORE}", ""))
        .otherwise(raw)
    )


def gender_of(raw: Column) -> Column:
    first = F.regexp_extract(F.regexp_replace(raw, rf"^(?:{_LEAD}) ", ""), r"^(\p{L}+)", 1)
    return F.when(first.isin(MALE_TITLES + MALE_GIVEN + MALE_CYRILLIC), "m").when(first.isin(FEMALE_TITLES + FEMALE_GIVEN + FEMALE_CYRILLIC), "f").otherwise("n")


def digits_of(digest: Column) -> Column:
    """128 decimal digits of a hex digest."""
    return F.translate(digest, "abcdef", "135792")


def same_format(value: Column, digest: Column) -> Column:
    """``value`` with its digits, small and capital ASCII letters replaced by others of their class; the rest stays."""
    digits, small = digits_of(digest), F.translate(digest, "0123456789abcdef", "bcdfghjklmnprstv")

    def turn(c: Column, i: Column) -> Column:
        at = F.pmod(i, F.lit(128)) + 1
        return F.when(c.rlike("[0-9]"), F.substr(digits, at, F.lit(1))).when(c.rlike("[a-z]"), F.substr(small, at, F.lit(1))).when(c.rlike("[A-Z]"), F.upper(F.substr(small, at, F.lit(1)))).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), turn), "")


def same_hex(value: Column, digest: Column) -> Column:
    """``value`` with its hexadecimal digits replaced by others, the first of a group never by 0."""

    def turn(c: Column, i: Column) -> Column:
        drawn = F.substr(digest, F.pmod(i, F.lit(128)) + 1, F.lit(1))
        return F.when(c == ":", c).otherwise(F.when(drawn == "0", "1").otherwise(drawn))

    return F.array_join(F.transform(F.split(value, ""), turn), "")


#: What a key begins with says whose it is; the rest is secret.
KEY_HEAD = r"^(A[KS]IA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|AIza|eyJ)"


def key_like(value: Column, digest: Column) -> Column:
    head = F.regexp_extract(value, KEY_HEAD, 1)
    return F.concat(head, same_format(F.substr(value, F.length(head) + 1), digest))


def luhn_sum(number: Column) -> Column:
    """The Luhn sum of a string of digits, its last digit at weight one."""
    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(F.pmod(i, F.lit(2)) == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), weigh), F.lit(0), lambda a, d: a + d)


def card_like(value: Column, digest: Column) -> Column:
    """Digits of the same number and first digit; the check digit holds if the entity's does."""
    drawn = F.concat(F.left(value, F.lit(1)), F.substr(digits_of(digest), F.lit(1), F.length(value) - 2))
    check = F.pmod(10 - F.pmod(luhn_sum(F.concat(drawn, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    return F.concat(drawn, F.when(F.pmod(luhn_sum(value), F.lit(10)) == 0, check).otherwise(F.substr(digits_of(digest), F.lit(100), F.lit(1))))


def phone_head(value: Column) -> Column:
    """What of a number without separators stays: the country's code, of which two digits tell, or the first zero."""
    return F.regexp_extract(value, r"^(\+(?:[17]|[2-9][0-9])|0?)", 1)


def pick(names: list[str], digest: Column, at: int) -> Column:
    number = F.conv(F.substr(digest, F.lit(at), F.lit(7)), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(number, F.lit(len(names))) + 1).cast("int"))


def person_like(value: Column, gender: Column, keyed, attempt: Column) -> Column:
    """A name of as many parts, of the gender and script. Parts are drawn by part, so a family keeps one name."""
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    family, given = F.element_at(F.split(value, " "), -1), F.when(value.contains(" "), F.substring_index(value, " ", 1))
    fd, gd = keyed(F.lit("family"), family, F.when(given.isNull(), attempt).otherwise(F.lit(0))), keyed(F.lit("given"), F.concat_ws(" ", given, F.when(attempt > 0, value)), attempt)
    latin = F.concat(pick(FAMILY_HEADS, fd, 1), pick(FAMILY_MIDS, fd, 9), pick(FAMILY_MIDS, fd, 17), pick(FAMILY_TAILS, fd, 25))
    cyr = F.concat(pick(FAMILY_CYRILLIC[0], fd, 1), pick(FAMILY_CYRILLIC[1], fd, 9), pick(FAMILY_CYRILLIC[1], fd, 17), pick(FAMILY_CYRILLIC[2], fd, 25))
    # Beyond the first draws the family name grows, so draws never run out.
    more = F.when((attempt > 3) & given.isNull(), F.concat(F.lit("-"), latin)).otherwise("")
    male, female = (F.when(cyrillic, pick(c, gd, 1)).otherwise(pick(n, gd, 1)) for c, n in ((MALE_CYRILLIC, MALE_GIVEN), (FEMALE_CYRILLIC, FEMALE_GIVEN)))
    first = F.when(gender == "m", male).when(gender == "f", female).otherwise(F.when(F.substr(gd, F.lit(40), F.lit(1)) < "8", male).otherwise(female))
    middle = F.when(attempt > 3, F.concat(pick(FAMILY_HEADS, gd, 33), F.lit(" "))).otherwise("")
    return F.concat(F.when(given.isNotNull(), F.concat(first, F.lit(" "), middle)).otherwise(""), F.when(cyrillic, cyr).otherwise(latin), more)


def draw(key: str) -> Column:
    """The surrogate of (kind, value, gender) at ``attempt``; numbers without separators, names without title."""
    kind, value, attempt = F.col("kind"), F.col("value"), F.col("attempt")

    def keyed(*parts: Column) -> Column:
        return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 512)

    d = keyed(kind, value, attempt)
    octet = lambda at, low, n: (F.pmod(F.conv(F.substr(d, F.lit(at), F.lit(7)), 16, 10).cast("long"), F.lit(n)) + low).cast("string")
    user, host = F.substring_index(value, "@", 1), F.substring_index(F.substring_index(value, "@", -1), ".", 1)
    domain = F.element_at(F.array(*map(F.lit, ("example.com", "example.org", "example.net"))), (F.pmod(F.conv(F.substr(d, F.lit(120), F.lit(7)), 16, 10).cast("long"), F.lit(3)) + 1).cast("int"))
    return (
        F.when(kind == "email", F.concat(same_format(user, d), F.lit("@"), same_format(host, F.reverse(d)), F.lit("."), domain))
        .when(kind == "ip", F.concat_ws(".", octet(1, 1, 223), octet(9, 0, 256), octet(17, 0, 256), octet(25, 1, 254)))
        .when(kind == "card", card_like(value, d))
        .when(kind == "ip6", same_hex(value, d))
        .when(kind == "key", key_like(value, d))
        .when(kind == "secret", F.when(value.rlike("[a-f]") | ~value.rlike("[A-F]"), F.substr(d, F.lit(1), F.length(value))).otherwise(F.upper(F.substr(d, F.lit(1), F.length(value)))))
        .when(kind == "iban", F.concat(F.left(value, F.lit(2)), same_format(F.substr(value, F.lit(3)), d)))
        .when(kind == "person", person_like(value, F.col("gender"), keyed, attempt))
        .when(kind == "phone", F.concat(phone_head(value), same_format(F.substr(value, F.length(phone_head(value)) + 1), d)))
        .otherwise(same_format(value, d))
    )


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value, gender, surrogate) of the distinct entities (kind, value, gender), one-to-one within a kind.

    Round by round, surrogates that several entities drew, but for one of them, or that are an
    entity's own value, are drawn again. Each round works on tables of entities only.
    """
    left = stage(entities.withColumn("attempt", F.lit(0)), "entities")
    own = left.select("kind", F.col("value").alias("drawn")).distinct()
    done: DataFrame | None = None
    while True:
        drawn = left.withColumn("drawn", draw(key))
        # One entity keeps each drawn value; which one is settled by order, not by chance.
        keeps = drawn.groupBy("kind", "drawn").agg(F.min(F.struct("value", "gender")).alias("first"))
        keeps = keeps.join(own.withColumn("taken", F.lit(True)), ["kind", "drawn"], "left")
        if done is not None:
            used = done.select("kind", F.col("surrogate").alias("drawn")).withColumn("used", F.lit(True))
            keeps = keeps.join(used, ["kind", "drawn"], "left")
        else:
            keeps = keeps.withColumn("used", F.lit(None).cast("boolean"))
        free = keeps.where("taken is null and used is null").select("kind", "drawn", "first.value", "first.gender", F.lit(True).alias("ok"))
        judged = stage(drawn.join(free, ["kind", "drawn", "value", "gender"], "left"), "drawn")
        good = judged.where("ok").select("kind", "value", "gender", F.col("drawn").alias("surrogate"))
        done = good if done is None else stage(done.unionByName(good), "surrogates")
        left = stage(judged.where("ok is null").select("kind", "value", "gender", (F.col("attempt") + 1).alias("attempt")), "entities")
        if not left.limit(1).count():
            return done


def dressed(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the spelling of ``raw``: separators of numbers and titles of names as they stand there."""
    slots = F.split(raw, "")
    # The k-th character that is no separator becomes the surrogate's k-th.
    filled = F.aggregate(slots, F.struct(F.lit(0).alias("k"), F.lit("").alias("s")), lambda a, c: F.struct((a["k"] + F.when(c.rlike("[ ().-]"), 0).otherwise(1)).alias("k"), F.concat(a["s"], F.when(c.rlike("[ ().-]"), c).otherwise(F.substr(surrogate, a["k"] + 1, F.lit(1)))).alias("s")), lambda a: a["s"])
    title = F.regexp_extract(raw, f"^({_BEFORE})", 1)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), filled).when(kind == "person", F.concat(title, surrogate)).otherwise(surrogate)


def with_gender(named: DataFrame) -> DataFrame:
    """Settles gender (m, f, n or empty) of distinct (raw, kind, value, gender), so that it tells persons apart.

    A mention of unknown gender is of the one gender that other mentions of the name have. Mentions
    of either gender are two persons, and one of unknown gender is a third. A family name alone
    is one entity, whoever bears it.
    """
    known = named.where("kind = 'person' and gender in ('m', 'f')").groupBy("value").agg(F.min("gender").alias("low"), F.max("gender").alias("high"))
    settled = F.when((F.col("kind") != "person") | ~F.col("value").contains(" "), "").when((F.col("gender") == "n") & (F.col("low") == F.col("high")), F.col("low")).otherwise(F.col("gender"))
    return named.join(known, "value", "left").select("raw", "kind", "value", settled.alias("gender"))


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, text, n_entities) of every row, each entity replaced by its surrogate.

    A text without entities, null included, stays as it is. Rows that repeat are each returned.
    Other columns are ignored; an empty table gives an empty one. Texts are read and searched
    once; only texts with entities are joined with the surrogates.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = found.withColumn("raws", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    found = stage(found, "found")
    some = F.coalesce(F.size("raws"), F.lit(0)) > 0
    having = found.where(some).withColumn("_key", text_key(F.col("text"))).withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    raws = stage(having.select("_id", "_key", F.explode("raws").alias("raw")).distinct(), "raws")
    # What is settled of a spelling is settled once, however many texts it stands in.
    kinds = raws.select("raw").distinct().withColumn("kind", entity_type(F.col("raw")))
    named = stage(kinds.withColumns({"value": canonical(F.col("kind"), F.col("raw")), "gender": F.when(F.col("kind") == "person", gender_of(F.col("raw"))).otherwise("")}), "spellings")
    named = stage(with_gender(named), "named")
    chosen = surrogates(named.select("kind", "value", "gender").distinct(), key)
    spelled = named.join(chosen, ["kind", "value", "gender"]).select("raw", dressed(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("new"))
    spelled = stage(spelled, "spelled")  # a plain table, so that a spelling of very many texts can be split
    maps = raws.join(spelled, "raw").groupBy("_id", "_key").agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("news"))
    joined = having.join(maps, ["_id", "_key"]).withColumn("_pieces", F.split("text", PATTERN, -1))
    text = F.array_join(F.transform("_pieces", lambda p, i: F.concat(p, F.coalesce(F.try_element_at("news", F.get("raws", i)), F.lit("")))), "")
    new = joined.select("doc_id", text.alias("text"), F.size("raws").cast("long").alias("n_entities"))
    return new.unionByName(found.where(~some).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents with surrogates; edge cases are those of ``replace_entities``."""
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet"))
