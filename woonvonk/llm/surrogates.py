"""Personal data replaced by keyed surrogates of the same kind and form.

Entities are found by one pattern. Each distinct (kind, value) gets one surrogate, made from a keyed digest of it, so a
value has the same surrogate wherever it stands (coreference) and nobody without the key can lead it back. Surrogates
keep form: digits stay digits, letters stay letters of their case, separators stay, cards pass their check digit,
addresses stay addresses, names keep gender (from the title) and script. A name is found behind a title: initials and
capitalised words, of which the last is the family name; wherever a text has one of these words alone, it is replaced too. Collisions, that is two values with one surrogate
or a surrogate that is itself a value of the corpus, are made again from the next digest until none is left, so distinct
values stay distinct.

Only built-in column functions are used. Only documents with entities leave the scan; distinct entities are counted on
the map side, so one address in a third of all documents is one row per task. Null texts stay null; documents without
entities are returned as they are; repeated rows are treated alike. All other columns are kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from woonvonk.llm.common import table, written

# The key of registered queries; a real run passes its own secret.
KEY = "surrogates of the registered query"

# Titles that tell a gender.
MALE_TITLES = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа"]
# A capitalised word without the ending of a genitive, and initials; possessive, so that long runs need no stack.
WORD = r"\p{Lu}(?=['’-]?\p{L})\p{L}*+(?:['’-](?!s(?!\p{L}))\p{L}++)*+"
INITIAL = r"\p{Lu}(?:\.-?\p{Lu})*+\.?"
TITLED = (
    rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(MALE_TITLES + FEMALE_TITLES)})\.? "
    rf"(?:{INITIAL} )*+{WORD}(?: (?:{INITIAL} )*+{WORD})*+"
)

# Kind and pattern, most specific first: where two could start, the first takes the text.
KINDS: list[tuple[str, str]] = [
    ("email", r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"),
    ("secret", r"(?<=(?:password|passwd|secret|token|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"']?)[^\s\"'=:]{6,}"),
    ("key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("hex", r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])"),
    ("card", r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
              r"|(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
              r"|(?<![\p{L}\p{N}.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
    ("name", TITLED),
]
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
# Every entity has a digit, an at sign, an assignment or a title; most texts have none of these.
HINT = rf"[0-9@=:]|(?:{'|'.join(MALE_TITLES + FEMALE_TITLES)})\.? \p{{Lu}}"

# Given names by script and gender; family names are made of the syllables.
GIVEN = {
    ("latin", "m"): "Adrian Bruno Conrad Daniel Edgar Felix Gregor Hugo Julian Konrad Leon Martin Oscar Paul Robin Simon".split(),
    ("latin", "f"): "Alma Berta Clara Diana Elena Flora Greta Helena Irma Julia Karla Laura Marta Nora Olga Paula".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Ирина Клара Лидия".split(),
}
SYLLABLES = {"latin": "ba del fen gor hal kem lin mor ned pol ras sten tor vil wen zan".split(), "cyrillic": "ба вел гор ден жар кол лин мор нед пол рас сан тор фед хол чер".split()}


def kind_of(value: Column) -> Column:
    """The first kind that matches the whole value (the context that a pattern looks at is not part of it)."""
    out = F.when(value.rlike("@"), "email").when(value.rlike(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$"), "key")
    out = out.when(value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip").when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
    out = out.when(value.rlike(r"^[0-9](?:[ -]?[0-9]){12,18}$"), "card").when(value.rlike(r"^[+(0-9][0-9 ().+-]{7,}$"), "phone")
    out = out.when(value.rlike(rf"^{TITLED}$"), "name").when(value.rlike("^[0-9a-f]+$"), "hex")
    return out.when(value.rlike(r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3}"), "iban").otherwise("secret")


def _number(key: str, kind: Column, value: Column, attempt: Column, label: str) -> Column:
    """A keyed number of 48 bits."""
    text = F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"), F.lit(label))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def _pick(items: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(number, F.lit(len(items))) + 1).cast("int"))


def _same_form(value: Column, digest: Column, hexadecimal: bool = False) -> Column:
    """``value`` with each letter and digit replaced by one of its class, from a digest of 128 hex characters."""
    place = lambda i: F.conv(F.substr(digest, F.pmod(i * 2, F.lit(127)) + 1, F.lit(2)), 16, 10).cast("int")
    among = lambda letters, i: F.substr(F.lit(letters), F.pmod(place(i), F.lit(len(letters))) + 1, F.lit(1))
    if hexadecimal:
        one = lambda c, i: F.when(c.rlike("[0-9a-f]"), among("0123456789abcdef", i)).otherwise(c)
    else:
        one = lambda c, i: (
            F.when(c.rlike("[0-9]"), among("0123456789", i))
            .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), among("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", i)).otherwise(among("абвгдежзиклмнопрстуфхцчшэюя", i)))
            .when(c.rlike(r"\p{Lu}"), among("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i))
            .when(c.rlike(r"\p{L}"), among("abcdefghijklmnopqrstuvwxyz", i))
            .otherwise(c)
        )
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _check_sum(card: Column) -> Column:
    """The sum of a number's digits with every second one, from the last but one, doubled and its own digits added."""
    digits = F.reverse(F.transform(F.split(F.regexp_replace(card, "[^0-9]", ""), ""), lambda c: c.cast("int")))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _with_check_digit(card: Column) -> Column:
    """A number whose last digit makes the usual check sum right."""
    zero = F.concat(F.substr(card, F.lit(1), F.length(card) - 1), F.lit("0"))
    return F.concat(F.substr(card, F.lit(1), F.length(card) - 1), F.pmod(10 - _check_sum(zero) % 10, F.lit(10)).cast("string"))


def surrogate(key: str) -> Column:
    """The surrogate of columns kind, value, attempt."""
    kind, value, attempt = F.col("kind"), F.col("value"), F.col("attempt")
    seed = F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"))
    digest = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|more")), 256))
    number = lambda label: _number(key, kind, value, attempt, label)
    local = F.regexp_extract(value, "^[^@]+", 0)
    email = F.concat(_same_form(local, digest), F.lit("@mail"), F.pmod(number("host"), F.lit(1000)).cast("string"), F.lit(".example.org"))
    ip = F.concat_ws(".", *[(F.pmod(number(f"o{i}"), F.lit(n)) + m).cast("string") for i, (n, m) in enumerate([(116, 11), (256, 0), (256, 0), (254, 1)])])
    formed = _same_form(value, digest)
    card = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(formed, F.lit(2)))
    card = F.when(_check_sum(value) % 10 == 0, _with_check_digit(card)).otherwise(card)
    phone = F.when(value.rlike(r"^\+"), F.concat(F.regexp_extract(value, r"^\+[0-9]{1,3}", 0), F.regexp_replace(formed, r"^\+[0-9]{1,3}", ""))).otherwise(formed)
    # later attempts make longer names, so there are always more of them than values
    size = F.lit(1) + (attempt / 4).cast("int")
    syllables = lambda script, n: F.array_join(
        F.transform(F.sequence(F.lit(1), n), lambda i: _pick(SYLLABLES[script], F.conv(F.substr(digest, F.pmod(i * 3, F.lit(120)), F.lit(3)), 16, 10).cast("long"))), ""
    )

    def name_in(script: str) -> Column:
        more = F.when(attempt > 3, syllables(script, size)).otherwise("")
        given = F.when(kind == "given_f", _pick(GIVEN[script, "f"], number("given"))).otherwise(_pick(GIVEN[script, "m"], number("given")))
        return F.when(kind == "family", F.initcap(syllables(script, size + 2))).otherwise(
            F.when(more == "", given).otherwise(F.concat(given, F.lit("-"), F.initcap(more)))
        )

    name = F.when(value.rlike(r"\p{IsCyrillic}"), name_in("cyrillic")).otherwise(name_in("latin"))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
        .when(kind == "hex", _same_form(value, digest, True))
        .when(kind == "key", F.concat(F.substr(value, F.lit(1), F.lit(4)), F.substr(formed, F.lit(5))))
        .when(kind == "iban", F.concat(F.substr(value, F.lit(1), F.lit(2)), F.substr(formed, F.lit(3))))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substr(formed, F.lit(2))))
        .when(kind.isin("family", "given_m", "given_f"), name)
        .otherwise(formed)
    )


def other_initials(value: Column, key: str) -> Column:
    """Initials moved along their alphabet by a keyed step, so none stays and different ones stay different; others count as X."""
    step = int(hashlib.sha256(f"{key}|initials".encode()).hexdigest(), 16)
    moved = F.regexp_replace(value, r"[\p{Lu}&&[^A-ZА-Я]]", "X")
    for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"):
        by = step % (len(letters) - 1) + 1
        moved = F.translate(moved, letters, letters[by:] + letters[:by])
    return moved


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value), all surrogates distinct and none of them a value."""
    open_ = entities.select("kind", "value", F.lit(0).alias("attempt"))
    done = None
    values = entities.select(F.col("value").alias("surrogate")).distinct()
    while True:
        tried = written(open_.withColumn("surrogate", surrogate(key)), "surrogates-tried")
        # a surrogate goes to the smallest value that has it, unless it is taken or is itself a value
        first = F.row_number().over(Window.partitionBy("surrogate").orderBy("kind", "value")) == 1
        taken = values if done is None else values.union(done.select("surrogate"))
        good = tried.withColumn("first", first).where("first").drop("first").join(taken, "surrogate", "left_anti")
        good = written(good.select("kind", "value", "surrogate"), "surrogates-good")
        done = good if done is None else done.union(good)
        open_ = tried.join(good, ["kind", "value"], "left_anti").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        open_ = written(open_, "surrogates-open")
        if not open_.limit(1).count():
            return done


def replaced(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text`` and ``n_entities``; an input column of that name is replaced."""
    docs = docs.drop("n_entities")
    t = F.col(text)
    has = F.coalesce(t.rlike(HINT) & t.rlike(PATTERN), F.lit(False))
    clean = docs.where(~has).withColumn("n_entities", F.lit(0))
    hits = docs.where(has).select(
        "*", F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)).alias("__found"), F.split(t, PATTERN, -1).alias("__parts")
    )
    hits = written(hits.withColumn("__row", F.monotonically_increasing_id()), "surrogates-hits")
    spots = hits.select("__row", F.posexplode("__found").alias("pos", "found")).withColumn("kind", kind_of(F.col("found")))
    # a titled name is its given and its family names, so that "Frau Anna Weber" and "Frau Weber" keep one family name
    found, w = F.col("found"), F.split("found", " ")
    given = F.when(found.rlike(rf"^(?:{'|'.join(FEMALE_TITLES)})"), "given_f").otherwise("given_m")
    piece = lambda sub, kind, value, before: F.struct(sub.alias("sub"), kind.alias("kind"), value.alias("value"), before.alias("before"))
    title, last = F.concat(w[0], F.lit(" ")), F.size(w) - 1
    # nothing that splits the name stands where it would be done for each of its words
    before = F.transform(
        F.slice(w, 2, last - 1), lambda x, i: piece(i + 1, F.when(x.rlike(f"^{INITIAL}$"), "initial").otherwise(given), x, F.when(i == 0, title).otherwise(" "))
    )
    named = F.concat(before, F.array(piece(last, F.lit("family"), F.element_at(w, -1), F.when(last == 1, title).otherwise(" "))))
    parts = F.when(F.col("kind") == "name", named).otherwise(F.array(piece(F.lit(0), F.col("kind"), found, F.lit(""))))
    spots = written(spots.select("__row", "pos", F.inline(parts)), "surrogates-spots")
    initial = F.col("kind") == "initial"
    entities = written(spots.where(~initial).select("kind", "value").distinct(), "surrogates-entities")
    mapping = assigned(entities, key)
    put = spots.where(~initial).join(mapping, ["kind", "value"]).select("__row", "pos", "sub", "kind", "value", "before", "surrogate")
    put = put.union(spots.where(initial).select("__row", "pos", "sub", "kind", "value", "before", other_initials(F.col("value"), key)))
    new = F.struct("pos", "sub", F.concat("before", "surrogate").alias("text"))
    name = F.when(F.col("kind").isin("family", "given_m", "given_f"), F.struct("value", "kind", "surrogate"))
    # a text's own entities and names: bounded by the text
    per_row = put.groupBy("__row").agg(F.collect_list(new).alias("__new"), F.array_sort(F.collect_set(name)).alias("__names"))
    # a word that is both a family and a given name goes as the family name
    once = F.filter("__names", lambda x, i: (i == 0) | (F.get("__names", i - 1)["value"] != x["value"]))
    known = F.map_from_entries(F.transform(once, lambda x: F.struct(x["value"], x["surrogate"])))
    joined_rows = hits.join(per_row, "__row").withColumn("__known", F.when(F.size("__names") > 0, known))
    bare = rf"(?<![\p{{L}}\p{{N}}]){WORD}(?![\p{{L}}\p{{N}}])"

    def again(word: Column) -> Column:
        """A bare word, or what hyphens and apostrophes part in it, by the names of its text."""
        own = F.transform(F.split(word, "(?=['’-])|(?<=['’-])"), lambda x: F.coalesce(F.element_at("__known", x), x))
        return F.coalesce(F.element_at("__known", word), F.array_join(own, ""))

    words = lambda x: F.regexp_extract_all(x, F.lit(bare), F.lit(0))
    mended = lambda x: F.array_join(
        F.zip_with(F.split(x, bare, -1), words(x), lambda gap, word: F.concat(gap, F.coalesce(again(word), F.lit("")))), ""
    )
    between = F.transform(
        "__parts", lambda x, i: F.struct(i.alias("pos"), F.lit(-1).alias("sub"), F.when(F.col("__known").isNull(), x).otherwise(mended(x)).alias("text"))
    )
    mentions = F.when(
        F.col("__known").isNotNull(),
        F.aggregate(F.transform("__parts", lambda x: F.size(F.filter(words(x), lambda v: again(v) != v))), F.lit(0), lambda a, n: a + n),
    ).otherwise(0)
    joined = F.array_join(F.transform(F.array_sort(F.concat(between, "__new")), lambda x: x["text"]), "")
    out = joined_rows.select(
        *[joined.alias(text) if c == text else F.col(c) for c in docs.columns], (F.size("__found") + mentions).alias("n_entities")
    )
    return clean.unionByName(out)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(table(spark, sf_dir, "documents").select("doc_id", "text"))
