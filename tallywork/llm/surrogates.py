"""Personal data replaced by surrogates, in DataFrame operations only.

Emails, phone numbers, IP addresses, payment cards, IBANs, social security numbers and names after a form of address or an
introduction are found by patterns, in one pass over the texts that cuts each at its entities. Each distinct entity, told
by its type and its form without punctuation and case, gets one surrogate from a keyed hash: as many digits or letters,
country code or first digit kept, valid check digits where there were. It is then written in the format of each occurrence.

Names are replaced word by word: a family name by an invented word, a first name by one for its gender, each in its own
script. The gender is that of any form of address with which the name occurs, so Mr and Dr John Smith are one person; a
name with both male and female forms is two, and a third where the form tells neither.

Surrogates are compared over the whole corpus. One that equals another value's or any real value of its type is drawn
again, longer after some rounds so that they can't run out, until all differ: rounds over a table of what still collides,
which shrinks fast. Of two values that draw one surrogate the smaller keeps it.

Nulls and texts without personal data come back as they are. Repeated rows are treated alike. An empty table gives an
empty result. Very long texts and texts with very many entities take time in proportion. Other columns are carried along
by replaced(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import stored, unused

#: Forms of address by the gender that they tell.
MALE = ("Mr", "Herr", "Sr", "Don", "Monsieur", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Doña", "Mme", "Madame", "Mlle", "Госпожа")
EITHER = ("Dr", "Prof")
TITLES = "|".join((*MALE, *FEMALE, *EITHER))
CUES = "[Mm]y name is|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo|[Мм]еня зовут"
#: The same in scripts without capitals, where one word after them is taken for a name.
MALE_PLAIN, FEMALE_PLAIN = ("السيد", "श्री", "מר", "ბატონი"), ("السيدة", "श्रीमती", "גברת", "ქალბატონი")
PLAIN = "|".join((*FEMALE_PLAIN, *MALE_PLAIN))
#: What comes before a name, up to the blank.
BEFORE = rf"(?:{TITLES}|{CUES}|{PLAIN})\.? "
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])"
#: Global, local and link-local addresses of version 6.
IPV6 = r"(?<![0-9A-Za-z:.])(?:[23][0-9A-Fa-f]{3}|[Ff][CcDd][0-9A-Fa-f]{2}|[Ff][Ee]80)(?:(?::[0-9A-Fa-f]{1,4}){7}|(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?)(?![0-9A-Za-z:])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9])"
PHONE = r"(?<![A-Za-z0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![A-Za-z0-9])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
#: All capitalized words after the title, up to another title.
WORD = rf"(?!(?:{TITLES})\.? \p{{Lu}})\p{{Lu}}[\p{{L}}'-]++"
PERSON = rf"(?<![\p{{L}}])(?:(?:(?:{TITLES})\.?|{CUES}) {WORD}(?: {WORD})*+|(?:{PLAIN}) [\p{{L}}\p{{M}}]++)"
ANY = "|".join((EMAIL, IP, IPV6, SSN, CARD, PHONE, IBAN, PERSON))
#: No entity without one of these.
HINT = rf"[0-9@]|::|{TITLES}|{CUES}|{PLAIN}"
#: Put around entities to cut a text there.
MARK = "\u0001"
#: Rounds after which a surrogate gets a digit more, and after which an address becomes one of version 6.
LONGER, WIDER = 8, 16
#: Syllables of invented names, by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ja jo ka ke la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te to va ve".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ла ле ли ло ма ме ми мо на не но па пе ра ре ри ро са се со та те то ва ве".split(),
    "greek": "βα βε βο γα γε γο δα δε δο θα θε ζα ζη κα κε κο λα λε λι λο μα με μι μο να νε νο πα πε ρα ρε ρι ρο σα σε σο τα τε το φα φο χα".split(),
    "armenian": "բա բե բո գա գե գո դա դե դո կա կե կո լա լե լի լո մա մե մի մո նա նե նո պա պե ռա ռե ռի ռո սա սե սո տա տե տո վա վե".split(),
    "georgian": "ბა ბე ბო გა გე გო და დე დო კა კე კო ლა ლე ლი ლო მა მე მი მო ნა ნე ნო პა პე რა რე რი რო სა სე სო ტა ტე ტო ვა ვე".split(),
    "arabic": "با بو بي تا تو تي دا دو دي را رو ري سا سو سي فا فو في كا كو كي لا لو لي ما مو مي نا نو ني ها هو".split(),
    "hebrew": "בא בו בי גא גו גי דא דו די לא לו לי מא מו מי נא נו ני סא סו סי רא רו רי שא שו שי תא תו תי".split(),
    "devanagari": "का की को गा गी गो ता ती तो दा दी दो ना नी नो पा पी पो मा मी मो रा री रो ला ली लो सा सी सो".split(),
}
ENDS = {
    "latin": {"female": "na", "male": "rd", "either": "ly"}, "cyrillic": {"female": "на", "male": "слав", "either": "енко"}, "greek": {"female": "να", "male": "δης", "either": "κη"}, "armenian": {"female": "նա", "male": "րդ", "either": "լի"},
    "georgian": {"female": "ნა", "male": "რდი", "either": "ლი"}, "arabic": {"female": "ية", "male": "ان", "either": "ي"}, "hebrew": {"female": "ית", "male": "ון", "either": "י"}, "devanagari": {"female": "ती", "male": "राज", "either": "जी"},
}


def signs(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def kind(entity: Column) -> Column:
    whole = [("email", EMAIL), ("ip", IP), ("ipv6", IPV6), ("ssn", SSN), ("card", CARD), ("phone", PHONE), ("iban", IBAN)]
    out = F.lit("person")
    for name, pattern in reversed(whole):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def expanded(address: Column) -> Column:
    """An address of version 6 as eight groups of four digits."""
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(address, "::", 1)), groups(F.when(address.contains("::"), F.substring_index(address, "::", -1)).otherwise(""))
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), ":")


def norm(type_: Column, entity: Column) -> Column:
    """What stays of an entity however it is written."""
    return (
        F.when(type_.isin("phone", "card", "ssn"), F.regexp_replace(entity, "[^0-9]", ""))
        .when(type_ == "iban", F.upper(F.regexp_replace(entity, " ", "")))
        .when(type_ == "ipv6", expanded(F.lower(entity)))
        .when(type_ == "person", F.lower(F.regexp_replace(entity, f"^{BEFORE}", "")))
        .otherwise(F.lower(entity))
    )


def told(entity: Column) -> Column:
    """The gender that a form of address tells, or null."""
    title = F.regexp_replace(F.regexp_extract(entity, f"^{BEFORE}", 0), r"\.? $", "")
    return F.when(title.isin(*MALE, *MALE_PLAIN), "male").when(title.isin(*FEMALE, *FEMALE_PLAIN), "female")


def byte(of: Column, i: Column) -> Column:
    """Byte i of a keyed hash, which goes on for as long as it is asked."""
    block = F.sha2(F.concat_ws("\x1f", of, F.floor(i / 32).cast("string")), 256)
    return F.conv(F.substring(block, (i % 32 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def scrambled(text: Column, of: Column, keep: Column) -> Column:
    """text with digits for digits and small letters for letters from a keyed hash, its first keep characters as they are."""

    def one(hashed: Column, c: Column, i: Column) -> Column:
        b = byte(hashed, i)
        small = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), b % 26 + 1, F.lit(1))
        return F.when(i < keep, c).when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), small).when(c.rlike("[A-Z]"), F.upper(small)).otherwise(c)

    # An array of one, so that the hash of the whole is worked out once and not for each character.
    return F.get(F.transform(F.array(F.md5(of.cast("binary"))), lambda h: F.array_join(F.transform(signs(text), lambda c, i: one(h, c, i)), "")), F.lit(0))


def luhn(digits: Column) -> Column:
    """Sum of a card's digits, every second from the right doubled and cast out; divisible by ten if the number is valid."""
    d = F.transform(signs(F.reverse(digits)), lambda c, i: c.cast("int") * (i % 2 + 1))
    return F.aggregate(d, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))


def iban_rest(number: Column) -> Column:
    """What an IBAN leaves when divided by 97, letters as two digits and its first four signs last; 1 if it is valid."""
    moved = F.concat(F.substring(number, 5, 64), F.substring(number, 1, 4))
    value = F.transform(signs(moved), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(value, F.lit(0), lambda s, x: (s * F.when(x > 9, 100).otherwise(10) + x) % 97)


def script_of(word: Column) -> Column:
    """The script of a name; those without syllables of their own get Latin ones."""
    out = F.lit("latin")
    for name in SYLLABLES.keys() - {"latin"}:
        out = F.when(word.rlike(rf"\p{{Is{name.capitalize()}}}"), name).otherwise(out)
    return out


def invented(of: Column, script: Column, gender: Column, syllables: int) -> Column:
    """A name of syllables, with an ending for a first name, small letters."""
    table, end = F.array(*map(F.lit, SYLLABLES["latin"])), F.lit("")
    for name, parts in SYLLABLES.items():
        table = F.when(script == name, F.array(*map(F.lit, parts))).otherwise(table)
        for sex, sign in ENDS[name].items():
            end = F.when((script == name) & (gender == sex), sign).otherwise(end)
    part = lambda k: F.element_at(table, (byte(of, F.lit(k)) * 256 + byte(of, F.lit(k + 1))) % F.size(table) + 1)
    return F.concat(*[part(k) for k in range(0, 2 * syllables, 2)], end)


def surrogate(type_: Column, value: Column, gender: Column, key: str, attempt: int) -> Column:
    """The surrogate's normal form; another for each attempt, and longer ones in time, so that they don't run out."""
    of = F.concat_ws("\x1f", F.lit(key), type_, value, F.lit(str(attempt)))
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    site, top = F.regexp_replace(domain, r"\.[^.]*$", ""), F.substring_index(domain, ".", -1)
    again = [F.lit(str(attempt))] if attempt else []
    longer = F.concat(local, F.lit("a" * (attempt // 2)))
    email = F.concat(scrambled(longer, of, F.lit(0)), F.lit("@"), scrambled(site, F.concat_ws("\x1f", F.lit(key), F.lit("site"), site, *again), F.lit(0)), F.lit("."), top)
    hexes = F.sha2(of, 256)
    wide = F.concat_ws(":", F.lit("2001"), F.lit("0db8"), *[F.substring(hexes, 4 * k + 1, 4) for k in range(6)])
    ip = F.concat_ws(".", *[(byte(of, F.lit(k)) % 254 + 1).cast("string") for k in range(4)]) if attempt < WIDER else wide
    ipv6 = F.concat_ws(":", F.substring(value, 1, 4), *[F.substring(hexes, 4 * k + 1, 4) for k in range(7)])
    more = F.concat(value, F.lit("0" * (attempt // LONGER)))
    digits = scrambled(more, of, F.when(type_ == "card", 1).when(type_ == "iban", 2).when(type_ == "phone", F.greatest(F.length(value) - 10, F.lit(0))).otherwise(0))
    body = F.regexp_replace(digits, ".$", "")
    card = F.concat(body, F.pmod(-luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    land, account = F.substring(digits, 1, 2), F.substring(digits, 5, 64)
    iban = F.concat(land, F.lpad((98 - iban_rest(F.concat(land, F.lit("00"), account))).cast("string"), 2, "0"), account)
    name = invented(F.concat_ws("\x1f", of, gender), script_of(value), gender, 3 + attempt)
    return (
        F.when(type_ == "email", email).when(type_ == "ip", ip).when(type_ == "ipv6", ipv6).when(type_ == "name", name)
        .when((type_ == "card") & (luhn(value) % 10 == 0), card).when((type_ == "iban") & (iban_rest(value) == 1), iban).otherwise(digits)
    )


def written_like(entity: Column, type_: Column, new: Column) -> Column:
    """new, a surrogate's normal form, in the format of entity: its punctuation and spaces, its capitals."""
    gaps = F.split(entity, "[0-9A-Za-z]", -1)
    joined = F.zip_with(signs(new), F.slice(gaps, 1, F.size(gaps) - 1), lambda c, g: F.concat(F.coalesce(g, F.lit("")), F.coalesce(c, F.lit(""))))
    filled = F.concat(F.array_join(joined, ""), F.element_at(gaps, -1))
    cased = F.array_join(F.zip_with(signs(new), signs(entity), lambda c, o: F.when(o.rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    rest = F.regexp_replace(entity, f"^{BEFORE}", "")
    person = F.concat(F.regexp_extract(entity, f"^{BEFORE}", 0), F.when((F.upper(rest) == rest) & (F.lower(rest) != rest), F.upper(new)).otherwise(F.initcap(new)))
    return F.when(type_ == "person", person).when(type_ == "email", cased).when(type_.isin("ip", "ipv6"), new).otherwise(filled)


def cut(text: Column) -> Column:
    """text cut at its entities: what is before the first, the first, what is between it and the next, and so on to the end."""
    marked = F.split(F.regexp_replace(text, ANY, f"{MARK}$0{MARK}"), MARK, -1)
    gaps, own = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    apart = F.array_compact(F.flatten(F.zip_with(gaps, own, lambda g, e: F.array(g, e))))
    return F.when(text.rlike(HINT), F.when(text.contains(MARK), apart).otherwise(marked))


def forms(found: DataFrame) -> DataFrame:
    """entity, type, norm and gender of the distinct entities of found (entity); a person's gender is that told anywhere."""
    typed = found.select("entity").distinct().withColumn("type", kind(F.col("entity")))
    known = stored(typed.withColumn("norm", norm(F.col("type"), F.col("entity"))).withColumn("told", F.when(F.col("type") == "person", told(F.col("entity")))), "forms")
    genders = known.where("type = 'person'").groupBy(F.col("norm").alias("of")).agg(F.min("told").alias("one"), F.max("told").alias("other"))
    people = known.where("type = 'person'").join(genders, F.col("norm") == F.col("of"))
    either = F.coalesce(F.when(F.col("one") == F.col("other"), F.col("one")).otherwise(F.col("told")), F.lit("either"))
    return known.where("type != 'person'").select("entity", "type", "norm", F.lit("").alias("gender")).union(people.select("entity", "type", "norm", either.alias("gender")))


def words_of(people: DataFrame) -> DataFrame:
    """person (a digest of the norm) and gender of people, with at, word and of (the word's role) for each word of their names."""
    each = people.select(F.md5(F.col("norm").cast("binary")).alias("person"), "gender", F.col("norm").contains(" ").alias("several"), F.posexplode(F.split("norm", " ")).alias("at", "word"))
    return each.select("person", "gender", "at", "word", F.when((F.col("at") == 0) & F.col("several"), F.col("gender")).otherwise("family").alias("of"))


def assigned(values: DataFrame, key: str) -> DataFrame:
    """type, norm, gender and new for distinct values, with no new like another or like any norm of its type."""
    real = stored(values.select("type", "norm", "gender").distinct(), "values")
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    open_, done, attempt = real, None, 0
    while True:
        # The table is small in bytes and would be read by few tasks, but a surrogate takes many hashes.
        tried = stored(open_.repartition(tasks, "type", "norm").withColumn("new", surrogate(F.col("type"), F.col("norm"), F.col("gender"), key, attempt)), "tried")
        first = tried.groupBy("type", "new").agg(F.min(F.struct("norm", "gender")).alias("owner"))
        taken = real.select("type", F.col("norm").alias("new"))
        taken = taken if done is None else taken.union(done.select("type", "new"))
        good = stored(first.join(taken, ["type", "new"], "left_anti").select("type", "owner.norm", "owner.gender", "new"), "good")
        done = good if done is None else stored(done.union(good), "assigned")
        open_ = stored(open_.join(good.select("type", "norm", "gender"), ["type", "norm", "gender"], "left_anti"), "open")
        attempt += 1
        if not open_.limit(1).count():
            return done


def renamed(known: DataFrame, key: str) -> DataFrame:
    """entity and new, its surrogate as it is to be written, for forms (entity, type, norm, gender)."""
    people, others = known.where("type = 'person'"), known.where("type != 'person'")
    words = stored(words_of(people.select("norm", "gender").distinct()), "words")
    values = others.select("type", "norm", "gender").union(words.select(F.lit("name"), "word", "of"))
    news = assigned(values, key)
    by_word = news.where("type = 'name'").select(F.col("norm").alias("word"), F.col("gender").alias("of"), "new")
    named = words.join(by_word, ["word", "of"]).groupBy("person", "gender").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda x: x.new), " ").alias("new"))
    both = others.join(news, ["type", "norm", "gender"]).select("entity", "type", "new").union(people.withColumn("person", F.md5(F.col("norm").cast("binary"))).join(named, ["person", "gender"]).select("entity", "type", "new"))
    return both.select("entity", written_like(F.col("entity"), F.col("type"), F.col("new")).alias("new"))


def replaced(docs: DataFrame, text: str = "text", secret: str = "tallywork", count: str | None = None) -> DataFrame:
    """docs with surrogates in their texts; count names a new column with the number of entities replaced.

    The texts are searched once: documents are written with their texts cut, and put together from that.
    """
    row, parts, news = (unused(docs, n) for n in ("of_row", "parts", "news"))
    t = F.col(text).cast("string")
    # Generated, so that the patterns run once for all that follows from them.
    once = docs.withColumn(row, F.monotonically_increasing_id()).select("*", F.explode_outer(F.array(cut(t))).alias(parts))
    has = F.size(parts) > 1
    kept = [F.when(has, F.lit(None)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == text else F.col(c) for c in docs.columns]
    scanned = stored(once.select(*kept, row, F.when(has, F.col(parts)).alias(parts)), "cut")
    entities = F.filter(parts, lambda _, i: i % 2 == 1)
    found = stored(scanned.where(F.col(parts).isNotNull()).select(F.col(row).alias("of_row"), F.posexplode(entities).alias("at", "entity")), "found")
    new = stored(renamed(stored(forms(found), "known"), secret), "renamed")
    per = stored(found.join(new, "entity").groupBy(F.col("of_row").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias(news)), "replacements")
    met = scanned.where(F.col(parts).isNotNull()).join(per.hint("merge"), F.col(row) == F.col("_of"))
    gaps = F.filter(parts, lambda _, i: i % 2 == 0)
    whole = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(news, i)["new"], F.lit("")))), "")
    number = lambda n: [n.cast("long").alias(count)] if count else []
    changed = met.select(*[whole.alias(c) if c == text else F.col(c) for c in docs.columns], *number(F.size(news)))
    return scanned.where(F.col(parts).isNull()).select(*docs.columns, *number(F.lit(0))).unionByName(changed)
