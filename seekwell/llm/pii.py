"""PII: keyed surrogates of the same type, gender, script and format, with collision checks.

An entity is a type and a normal form (letters in lower case, numbers as digits), so all its spellings share one
surrogate. Of a name, the given name and the family name are entities of their own: `Jane Doe` and `Mrs. Doe` keep one
family name. A surrogate is drawn from a keyed hash of the entity and an attempt number. All entities of the corpus are
compared: where two would look alike, or one would look like an entity that exists, the later one takes its next
attempt. Entities whose first attempt stands, nearly all of them, need no lookup when texts are rewritten.
DataFrame functions only.
"""

from __future__ import annotations

import hashlib
import os
import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekwell.functions.arrays import let
from seekwell.functions.barrier import once
from seekwell.llm.matches import gaps
from seekwell.session import materialize

#: Titles that tell a gender, or none, and given names by gender; surrogates of given names are taken
#: from the latter.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Lady", "Dame", "Frau", "Madame", "Mme", "Señora", "Sra", "Dra", "Doña", "Госпожа", "Κυρία"],
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"],
    "n": ["Dr", "Doctor", "Prof", "Professor"],
}
GIVEN = {
    ("f", "latin"): [
        "Alice", "Barbara", "Carmen", "Charlotte", "Claire", "Clara", "Diana", "Elena", "Elizabeth", "Emily", "Emma", "Hannah", "Isabel", "Jane", "Jennifer", "Jessica",
        "Julia", "Katharina", "Laura", "Linda", "Margaret", "Maria", "Marie", "Mary", "Monika", "Nina", "Olivia", "Patricia", "Paula", "Sabine", "Sarah", "Sofia", "Susan",
    ],
    ("m", "latin"): [
        "Adam", "Alexander", "Antonio", "Bruno", "Carlos", "Charles", "Christopher", "Daniel", "David", "Felix", "Francisco", "Hans", "Hugo", "James", "John", "Joseph",
        "Juan", "Leo", "Lucas", "Martin", "Matthew", "Michael", "Miguel", "Nicolas", "Oscar", "Pedro", "Peter", "Philippe", "Pierre", "Robert", "Simon", "Stefan", "Thomas", "William",
    ],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Роман"],
    ("f", "greek"): ["Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
    ("m", "greek"): ["Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Παύλος"],
}
SYLLABLES = {
    "latin": ["bar", "cal", "den", "fal", "gor", "hal", "ken", "lar", "mor", "nel", "par", "ren", "sal", "tor", "ver", "wil"],
    "cyrillic": ["бар", "вол", "гор", "дан", "зор", "кал", "лар", "мор", "нел", "пар", "рен", "сал", "тор", "фал", "хол", "чер"],
    "greek": ["βαρ", "γορ", "δαν", "ζορ", "θαλ", "καλ", "λαρ", "μορ", "νελ", "παρ", "ριν", "σαλ", "τορ", "φαλ", "χελ", "ψιρ"],
    "han": ["安", "白", "晨", "东", "方", "国", "海", "佳", "康", "林", "明", "宁", "平", "青", "山", "文"],
}
#: What ends a family name, by gender.
ENDINGS = {("f", "cyrillic"): "ова", ("m", "cyrillic"): "ов", ("f", "greek"): "ίδου", ("m", "greek"): "ίδης"}
#: Letters of a script, and its name in patterns.
SCRIPTS = {"cyrillic": "IsCyrillic", "greek": "IsGreek", "han": "IsHan"}

_TITLE = "|".join(t for g in sorted(TITLES) for t in TITLES[g])
_NAME = r"\p{Lu}\p{L}++(?:-\p{Lu}\p{L}++)?"
_GIVEN = "|".join(n for k in sorted(GIVEN) for n in GIVEN[k])
#: type -> pattern. Each begins where no longer run could have begun, and runs never give back, so scans are linear.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{1,4}:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]?){3}[0-9]{4}(?:[0-9]{1,3})?(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}|0[1-9](?:[\x20.-][0-9]{2}){4})(?![0-9])",
    "name": rf"(?=\p{{Lu}})(?<![\p{{L}}])(?:(?:{_TITLE})\.?\x20(?:{_NAME}(?:\x20{_NAME})?|\p{{IsHan}}{{2,4}})|(?:{_GIVEN})\x20{_NAME})",
}
ANY = "|".join(PATTERNS.values())
#: What every entity holds: a digit, an at sign, two colons or the start of a name. Texts without it are not scanned further.
HINT = rf"[0-9@]|::|(?=\p{{Lu}})(?<![\p{{L}}])(?:{_TITLE}|{_GIVEN})\.?\x20"
TYPES = tuple(PATTERNS)
ROUNDS = 50
#: Syllables of names. Every so many attempts names take one more, and addresses a character, so their spaces grow.
FAMILY_SYLLABLES, GIVEN_SYLLABLES, GROW_EVERY = 4, 3, 4
#: The setting, and the environment's variable, that hold the key.
KEY_SETTING, KEY_VARIABLE = "spark.seekwell.pii.key", "SEEKWELL_PII_KEY"


def session_key(spark: SparkSession) -> str:
    """The key of surrogates from the configuration; where it names none, one drawn at random for this session, so
    nobody can recompute surrogates, but those of another session differ."""
    key = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE)
    if not key:
        spark.conf.set(KEY_SETTING, key := secrets.token_hex(32))
    return key


def entity_type(match: Column) -> Column:
    """The first type whose whole pattern the match fits, in the order in which the scan tries them."""
    whole = lambda p: match.rlike(f"^(?:{p})$")
    return reduce(lambda rest, t: F.when(whole(PATTERNS[t]), F.lit(t)).otherwise(rest), reversed(TYPES[:-1]), F.lit("name"))


def entities_of(match: Column) -> Column:
    """A match as (front, parts): what stays in front, and the entities (kind, text) that a space parts. Names have a
    title, perhaps, and a given and a family name or only the latter; all else is one entity."""
    title = F.regexp_extract(match, rf"^(?:{_TITLE})\.?\x20", 0)
    listed = [n for k, names in GIVEN.items() if k[0] == "f" for n in names]

    def named(x: Column) -> Column:
        given = F.when(F.contains(x["back"], F.lit(" ")), F.substring_index(x["back"], " ", 1))
        told = x["front"].rlike(rf"^(?:{'|'.join(TITLES['m'])})\b")
        female = x["front"].rlike(rf"^(?:{'|'.join(TITLES['f'])})\b") | (~told & given.isin(listed))
        gender = F.when(female, F.lit("f")).otherwise("m")
        family = F.substring_index(x["back"], " ", -1)
        both = F.array(
            F.struct(F.concat(F.lit("given_"), gender).alias("kind"), given.alias("text")),
            F.struct(F.concat(F.lit("family_"), gender).alias("kind"), family.alias("text")),
        )
        return F.struct(x["front"].alias("front"), F.filter(both, lambda e: e["text"].isNotNull()).alias("parts"))

    def parted(x: Column) -> Column:
        alone = F.struct(F.lit("").alias("front"), F.array(F.struct(x["kind"].alias("kind"), match.alias("text"))).alias("parts"))
        split = F.struct(title.alias("front"), F.substring(match, F.length(title) + 1, F.length(match)).alias("back"))
        return F.when(x["kind"] == "name", let(split, named)).otherwise(alone)

    return let(F.struct(entity_type(match).alias("kind")), parted)


def normal_form(kind: Column, text: Column) -> Column:
    """What spellings of one entity share: digits of numbers, lower case of addresses and names, family names without
    the ending that tells a gender."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    family = F.regexp_replace(F.lower(text), "(?<=ов|ев|ин)а$", "")
    return (
        F.when(kind.isin("email", "ip6"), F.lower(text))
        .when(kind == "iban", F.regexp_replace(text, r"\x20", ""))
        .when(kind == "ip", text)
        .when(kind.startswith("family"), family)
        .when(kind.startswith("given"), F.lower(text))
        .otherwise(digits)
    )


def entity_kind(kind: Column) -> Column:
    """Family names of either gender are one kind of entity."""
    return F.when(kind.startswith("family"), F.lit("family")).otherwise(kind)


def _draw(key: str, kind: Column, normal: Column, attempt: Column, part: str) -> Column:
    """64 hexadecimal digits, twice, that nobody without the key can foresee: a nested hash, so texts can't be extended."""
    said = F.concat_ws("\x1f", F.lit(part), kind, attempt.cast("string"), normal)
    inner = F.sha2(F.concat(F.lit(f"{key}\x1f"), F.encode(said, "UTF-8")), 256)
    return F.repeat(F.sha2(F.concat(F.lit(f"{key}\x1e"), inner), 256), 2)


def _number(draw: Column, at: Column, digits: int = 4) -> Column:
    """Some digits of a draw, which is written twice, as a number; counting goes round at its end."""
    return F.conv(F.substring(draw, F.pmod(at * digits, F.lit(64)) + 1, digits), 16, 10).cast("int")


def _spelled(match: Column, draw: Column, kept: Column, letters: Column | None = None) -> Column:
    """`match` with letters and digits after the first `kept` characters drawn anew, each within its kind and script.

    Draws are counted by letters and digits only, so separators don't change the surrogate. `letters` is how many of
    the alphabet are used.
    """
    most = F.lit(26) if letters is None else letters
    chars = F.filter(F.split(match, ""), lambda c: c != "")
    pick = lambda c, n: (
        F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
        .when(c.rlike("[a-z]"), F.char(97 + F.pmod(n, most)))
        .when(c.rlike("[A-Z]"), F.char(65 + F.pmod(n, most)))
        .otherwise(c)
    )
    state = lambda i, n, out: F.struct(i.alias("i"), n.alias("n"), out.alias("out"))

    def step(s: Column, c: Column) -> Column:
        keep, counts = s["i"] < kept, c.rlike("[0-9A-Za-z]")
        return state(
            s["i"] + 1,
            s["n"] + F.when(keep | ~counts, F.lit(0)).otherwise(F.lit(1)),
            F.concat(s["out"], F.when(keep | ~counts, c).otherwise(pick(c, _number(draw, s["n"])))),
        )

    return F.aggregate(chars, state(F.lit(0), F.lit(0), F.lit("")), step, lambda s: s["out"])


def luhn(digits: Column) -> Column:
    """The sum whose last digit is zero for valid card numbers."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(digit(i))).otherwise(digit(i)))


def mod97(compact: Column) -> Column:
    """The remainder that is one for valid IBANs: the first four characters go last, letters count from ten."""
    chars = F.filter(F.split(F.concat(F.substring(compact, 5, 1 << 30), F.substring(compact, 1, 4)), ""), lambda c: c != "")
    value = lambda r, c: F.when(c.rlike("[0-9]"), r * 10 + c.cast("int")).otherwise(r * 100 + F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda r, c: value(r, c) % 97)


def _card(match: Column, drawn: Column) -> Column:
    """A drawn card number; its last digit makes it valid if the original is."""
    bare = lambda x: F.regexp_replace(x, "[^0-9]", "")
    check = F.pmod(-luhn(F.regexp_replace(bare(drawn), ".$", "0")), F.lit(10)).cast("string")
    return F.when(luhn(bare(match)) % 10 == 0, F.regexp_replace(drawn, F.lit("[0-9](?=[^0-9]*$)"), check)).otherwise(drawn)


def _iban(match: Column, drawn: Column) -> Column:
    """A drawn IBAN; its check digits are right if the original's are."""
    bare = lambda x: F.regexp_replace(x, r"\x20", "")
    zero = F.concat(F.substring(drawn, 1, 2), F.lit("00"), F.substring(drawn, 5, 1 << 30))
    right = F.concat(F.substring(drawn, 1, 2), F.lpad((98 - mod97(bare(zero))).cast("string"), 2, "0"), F.substring(drawn, 5, 1 << 30))
    return F.when(mod97(bare(match)) == 1, right).otherwise(drawn)


def _by_script(text: Column, of: Callable[[str], Column]) -> Column:
    """A value for the script that a text begins with; all others count as Latin."""
    return reduce(lambda rest, k: F.when(text.rlike(rf"^\p{{{SCRIPTS[k]}}}"), of(k)).otherwise(rest), SCRIPTS, of("latin"))


def _syllables(text: Column, draw: Column, n: Column) -> Column:
    words = lambda script: F.array(*map(F.lit, SYLLABLES[script]))
    one = lambda list_, i: F.element_at(list_, 1 + F.pmod(_number(draw, i), F.size(list_)))
    return let(_by_script(text, words), lambda w: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: one(w, i)), ""))


def _next_names(key: str) -> dict[str, str]:
    """Each listed given name with another of its gender and script: the next in an order that only the key tells."""
    out = {}
    for kind, names in GIVEN.items():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x1f{kind}\x1f{n}".encode()).digest())
        out |= {f"{kind[0]}{n.lower()}": order[(i + 1) % len(order)] for i, n in enumerate(order)}
    return out


def _surrogate(x: Column, key: str) -> Column:
    """The replacement of one entity: x has its kind, text, normal form, attempt and draws."""
    kind, text, draw = x["kind"], x["text"], x["draw"]
    more = F.floor(x["attempt"] / GROW_EVERY).cast("int")
    front, back = F.substring_index(text, "@", 1), F.regexp_replace(F.substring_index(text, "@", -1), r"\.[^.]*$", "")
    email = F.concat(_spelled(F.lower(front), draw, F.lit(0)), F.substring(F.reverse(draw), F.lit(1), more), F.lit("@"), _spelled(F.lower(back), x["other"], F.lit(0)), F.lit(".example"))
    ip = F.concat_ws(".", *[(1 + F.pmod(_number(draw, F.lit(i)), F.lit(254))).cast("string") for i in range(4)])
    ending = lambda script: F.when(kind == "family_f", F.lit(ENDINGS.get(("f", script), ""))).otherwise(F.lit(ENDINGS.get(("m", script), "")))
    short = F.when(text.rlike(r"^\p{IsHan}"), F.length(text) - FAMILY_SYLLABLES).otherwise(0)  # a character is a syllable
    family = F.initcap(F.concat(_syllables(text, draw, FAMILY_SYLLABLES + more + short), _by_script(text, ending)))
    listed = F.element_at(F.create_map(*[F.lit(y) for pair in _next_names(key).items() for y in pair]), F.concat(F.substring(kind, -1, 1), x["normal"]))
    given = F.coalesce(listed, F.initcap(_syllables(text, draw, GIVEN_SYLLABLES + more)))
    prefix = F.length(F.regexp_extract(text, r"^\+[0-9]{1,3}(?=[^0-9])", 0))
    spelled = _spelled(text, draw, F.when(kind == "iban", 4).otherwise(prefix), F.when(kind == "ip6", 6).otherwise(26))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind.startswith("family"), family)
        .when(kind.startswith("given"), given)
        .when(kind == "card", let(spelled, lambda s: _card(text, s)))
        .when(kind == "iban", let(spelled, lambda s: _iban(text, s)))
        .otherwise(spelled)
    )


def surrogates(parts: Column, attempt: Callable[[Column, Column], Column], key: str) -> Column:
    """An array of replacements for an array of entities (kind, text); `attempt` tells the attempt of (kind, normal form).

    Each step adds fields that the next ones read, so nothing is computed or planned more than once.
    """

    def add(made: Column, names: list[str], more: Callable[[Column], dict[str, Column]]) -> Column:
        return F.transform(made, lambda x: F.struct(*[x[n].alias(n) for n in names], *[v.alias(k) for k, v in more(x).items()]))

    normal = add(parts, ["kind", "text"], lambda x: {"normal": normal_form(x["kind"], x["text"])})
    tried = add(normal, ["kind", "text", "normal"], lambda x: {"attempt": attempt(entity_kind(x["kind"]), x["normal"])})
    domain = lambda x: F.lower(F.substring_index(x["text"], "@", -1))
    drawn = add(
        tried, ["kind", "text", "normal", "attempt"],
        # Addresses in other case stay one person, and one domain stays one domain in every attempt.
        lambda x: {
            "draw": _draw(key, entity_kind(x["kind"]), x["normal"], x["attempt"], "s"),
            "other": F.when(x["kind"] == "email", _draw(key, x["kind"], domain(x), F.lit(0), "d")),
        },
    )
    return F.transform(drawn, lambda x: _surrogate(x, key))


def _entities(docs: DataFrame, text: Column) -> DataFrame:
    """(id, kind, normal, part): the entities of each text, part as one of its spellings has it."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    exploded = docs.select("id", F.explode(F.array_distinct(found)).alias("match"))
    parts = exploded.select("id", F.explode(entities_of(F.col("match"))["parts"]).alias("part"))
    return parts.select("id", entity_kind(F.col("part.kind")).alias("kind"), normal_form(F.col("part.kind"), F.col("part.text")).alias("normal"), "part")


def _attempts(entities: DataFrame, key: str) -> DataFrame:
    """(kind, normal, attempt) of entities whose first attempt is taken; usually none. What a surrogate looks like
    follows from the normal form but for separators, case and endings, which normal forms leave out; so one spelling
    stands for all."""
    named = materialize(entities.groupBy("kind", "normal").agg(F.min("part").alias("part")).withColumn("attempt", F.lit(0)))
    # Given names are taken from lists of real ones; that they differ from each other is enough.
    real = named.where("NOT startswith(kind, 'given')").select("kind", F.col("normal").alias("looks"))
    for _ in range(ROUNDS):
        drawn = once(named, "made", F.get(surrogates(F.array("part"), lambda kind, normal: F.col("attempt"), key), F.lit(0)))
        drawn = drawn.withColumn("looks", normal_form(F.col("part.kind"), F.col("made")))
        first = drawn.groupBy("kind", "looks").agg(F.min(F.struct("attempt", "normal")).alias("first"), F.count("*").alias("n"))
        clash = first.where("n > 1").select("kind", "looks", F.lit(None).cast("string").alias("owner"), F.col("first.normal").alias("stays"))
        taken = first.join(real, ["kind", "looks"], "left_semi").select("kind", "looks", F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("stays"))
        bad = materialize(clash.unionByName(taken).groupBy("kind", "looks").agg(F.count_if(F.col("stays").isNull()).alias("real"), F.max("stays").alias("stays")))
        if bad.isEmpty():
            return named.where("attempt > 0").select("kind", "normal", "attempt")
        again = (F.col("real") > 0) | (F.col("normal") != F.col("stays"))
        named = materialize(
            drawn.join(bad, ["kind", "looks"], "left").select(
                "kind", "normal", "part", (F.col("attempt") + F.coalesce(again, F.lit(False)).cast("int")).alias("attempt")
            )
        )
    raise RuntimeError("no distinct surrogates found; a surrogate space is too small for the corpus")


def replace(
    docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_entities"
) -> DataFrame:
    """`docs` with every detected entity of `text_col` replaced, plus the number of places in `count_col` (None: without
    it); a column of that name gives way, all others are unchanged.

    `key` is a secret; without one the configuration's is taken (see `session_key`). Null texts stay null and have no
    entities, empty ones stay empty; repeated rows and ids are rewritten alike, null ids too, and an empty table stays
    empty. One scan finds the distinct entities, which meet only in aggregations by value, and one rewrites; texts are
    shuffled only if some entities need a later attempt and those are too many to broadcast.
    """
    key = key or session_key(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("__t"))
    entities = _entities(read, F.col("__t"))
    later = _attempts(entities, key)
    own = [c for c in docs.columns if c != count_col]
    df = docs.drop(count_col) if count_col else docs
    if later.isEmpty():
        df = df.withColumn("__later", F.lit(None).cast("map<string,int>"))
    else:
        label = F.concat_ws("\x1f", "kind", "normal")
        per_doc = (
            entities.join(later, ["kind", "normal"])
            .groupBy("id")
            .agg(F.map_from_entries(F.collect_set(F.struct(label, F.col("attempt")))).alias("__later"))
            .withColumnRenamed("id", "__id")
        )
        df = df.join(per_doc, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")), "left").drop("__id")
    df = once(df, "__m", F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    tried = lambda kind, normal: F.coalesce(F.element_at("__later", F.concat_ws("\x1f", kind, normal)), F.lit(0))
    made = F.transform("__m", lambda m: let(entities_of(m), lambda e: F.concat(e["front"], F.array_join(surrogates(e["parts"], tried, key), " "))))
    pieces = F.zip_with(gaps(text, ANY), made, lambda g, s: F.concat(g, F.coalesce(s, F.lit(""))))
    has = F.coalesce(F.size("__m") > 0, F.lit(False))
    new = F.when(has, F.array_join(pieces, "")).otherwise(F.col(f"`{text_col}`"))
    columns = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in own]
    count = F.when(has, F.size("__m")).otherwise(F.lit(0)).cast("bigint")
    return df.select(*columns, *([count.alias(count_col)] if count_col else []))
