"""PII surrogates: detected entities get keyed, type-consistent replacements, with DataFrame functions only.

1. One pattern finds e-mail addresses, IP addresses (4 and 6), international and national phone numbers,
   cards, social security numbers, IBANs, secrets (well-known key formats, private key blocks, and long
   values after ``token =`` and the like), and titled names. A mention's kind is told once, and it is taken
   apart into entities (a name into given name and surname) in a canonical form, so that spellings of one
   entity corefer: ``A@B.C`` and ``a@b.c``, ``+1 555`` and ``+1-555``, ``Ms Ada Hall`` and ``Ms HALL``.
2. Within a text that has titled names, their parts are replaced where they stand without a title too. A
   given name after a title without gender takes the gender that the name has elsewhere, if it has one.
3. Each distinct entity draws a surrogate from an HMAC-SHA256 digest: characters keep their kind (digit,
   hexadecimal digit, Latin, Cyrillic or Greek letter), a phone number its first digit, a card its Luhn
   validity, an IBAN its country and valid check digits, an address its last label, a key its prefix, and
   given names come from a list of the gender and the name's script. The key travels as data, not in plans.
4. Collisions are checked over the whole table: of entities that drew the same surrogate one keeps it, and
   no surrogate equals an entity that occurs. The others draw again from spaces that grow with the draw
   (longer names, more digits), so draws end however many entities there are.
5. Mentions are replaced in their own spelling: separators stay, capitals stay capitals.

Only entities, and the texts that have any, are shuffled; all other rows pass through the last scan.
Defined cases: a null text stays null and has no entities; repeated rows are treated alike; an empty table
gives an empty result; a mention may be of any length; a national number and its international form are
two entities; a column of the input named ``n_entities`` is replaced, others are left alone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop_shared, filter_table, maybe_in, shared_table

#: Draws after which surrogates of numbers and addresses grow longer.
SHORT_DRAWS = 4

# Titles by gender, names by gender and script, words before a secret.
MALE_TITLES = ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа", "Κυρία"]
OTHER_TITLES = ["Dr", "Doctor", "Prof", "Professor", "Доктор", "Δρ"]
NAMES = {
    "given_m_latin": "Adam Albert Anton Bruno Carl Daniel David Edgar Erik Felix Frank George Hugo Ivan Jonas Karl Leo Louis Marco Martin Oscar Paul Peter Robert Simon Thomas Victor Walter".split(),
    "given_f_latin": "Ada Alice Anna Berta Carla Clara Diana Elena Ella Emma Eva Flora Frida Greta Helena Ida Irene Julia Laura Lena Lucia Maria Nora Olga Paula Rosa Sara Vera".split(),
    "given_m_cyrillic": "Алексей Андрей Антон Борис Виктор Глеб Денис Егор Иван Игорь Кирилл Лев Максим Николай Олег Павел Роман Семён".split(),
    "given_f_cyrillic": "Алла Анна Вера Галина Дарья Елена Жанна Зоя Инна Ирина Клара Лариса Мария Нина Ольга Полина Раиса Тамара".split(),
    "given_m_greek": "Αλέξης Ανδρέας Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Μάριος Νίκος Πέτρος Σπύρος Στέφανος".split(),
    "given_f_greek": "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split(),
    "surname_latin": "Abbot Adler Baker Barnes Becker Bishop Brandt Carver Castle Cooper Dalton Draper Ebner Fischer Fowler Garner Glover Hartmann Hayward Keller Lambert Lindner Marsh Mercer Miller Norton Palmer Porter Sander Tanner Turner Weaver".split(),
    "surname_cyrillic": "Белов Волков Громов Дроздов Ершов Жуков Зайцев Климов Козлов Лебедев Макаров Морозов Орлов Павлов Соколов Титов Фролов Чернов".split(),
    "surname_greek": "Αγγέλου Αντωνίου Βλάχος Γεωργίου Δήμου Ιωάννου Καρράς Λάμπρου Μακρής Νικολάου Παππάς Στάμου".split(),
}
NAMES |= {f"given_n_{s}": NAMES[f"given_m_{s}"] + [x for x in NAMES[f"given_f_{s}"] if x not in NAMES[f"given_m_{s}"]] for s in ("latin", "cyrillic", "greek")}
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
SECRET_WORDS = "token|secret|passw(?:or)?d|api.?key|access.?key|auth.?key"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Repetitions of groups without a bound are possessive: Java runs those in a loop, all others by recursion.
_NAME = r"\p{Lu}(?:\p{L}++|(?=['’]\p{Lu}))(?:['’\-]\p{Lu}\p{L}++)*+"
#: Patterns of mentions that start where no letter or digit goes before.
WORD_PATTERNS = {
    "email": r"(?<![._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++",
    "secret": r"(?<![_\-/+])(?:AKIA[0-9A-Z]{16}|sk-[\w\-]{20,}+|gh[pousr]_\w{36,}+|xox[abpr]-[\w\-]{10,}+)(?!\w)"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^\-]++-----END [A-Z ]{0,20}PRIVATE KEY-----"
    rf"|(?<![_\-/+])(?=[\w+/\-]{{16}})(?<=(?i:{SECRET_WORDS})[\"' ]{{0,3}}[=:][\"' ]{{0,3}})[\w+/\-]{{16,}}+={{0,2}}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ipv6": rf"(?<![:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}:(?:{_HEX}(?::{_HEX}){{0,4}})?)(?![0-9A-Fa-f:])",
    "name": rf"(?<!['’\-])(?:{'|'.join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)})\.? {_NAME}(?: {_NAME})?",
}
#: Patterns of mentions that start with a digit or a sign.
NUMBER_PATTERNS = {
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)"
    r"|(?<![\d+\-.(])(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\d\-])|(?<![\d+\-./])0\d{2,4}[ /]\d{5,8}(?![\d\-/])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d])",
}
#: Every mention, in the order in which kinds are tried at a place.
PATTERN = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(WORD_PATTERNS.values())})|(?=[\d+(])(?:{'|'.join(NUMBER_PATTERNS.values())})"
#: The same, and every capitalised word that begins no mention: in texts with names, those may repeat one.
WIDE_PATTERN = rf"{PATTERN}|(?<![\p{{L}}\p{{N}}]){_NAME}(?![\p{{L}}\p{{N}}_])(?![\p{{L}}\p{{N}}._%+\-]*+@)"


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kind(value: str) -> str:
    """SQL for the kind of a mention. What none of the tests knows is a secret."""
    tests = [
        ("email", f"contains({value}, '@')"),
        ("name", f"{value} RLIKE {_q('^(?:' + '|'.join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES) + r')\.? \p{Lu}')}"),
        ("phone", f"startswith({value}, '+')"),
        ("ssn", f"{value} RLIKE {_q(r'^\d{3}-\d{2}-\d{4}$')}"),
        ("ip", f"{value} RLIKE {_q(r'^\d{1,3}(?:\.\d{1,3}){3}$')}"),
        ("phone", f"{value} RLIKE {_q(r'^[\d ()./\-]{7,16}$')} AND length(regexp_replace({value}, '[^0-9]', '')) < 13"),
        ("card", f"{value} RLIKE {_q(r'^\d(?:[ \-]?\d){12,18}$')}"),
        ("ipv6", f"{value} RLIKE {_q('^[0-9A-Fa-f:]+$')} AND contains({value}, ':')"),
        ("iban", f"{value} RLIKE {_q(r'^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$')}"),
    ]
    return "CASE " + " ".join(f"WHEN {t} THEN '{k}'" for k, t in tests) + " ELSE 'secret' END"


def _script(word: str) -> str:
    return f"CASE WHEN {word} RLIKE '^\\\\p{{IsCyrillic}}' THEN 'cyrillic' WHEN {word} RLIKE '^\\\\p{{IsGreek}}' THEN 'greek' ELSE 'latin' END"


def _entities(kind: str, value: str) -> str:
    """SQL for the entities of a mention, an array of (kind, canonical form)."""
    words = f"split({value}, ' ')"
    titled = lambda titles: f"{value} RLIKE {_q('^(?:' + '|'.join(titles) + r')\.? ')}"
    gender = f"CASE WHEN {titled(FEMALE_TITLES)} THEN 'f_' WHEN {titled(MALE_TITLES)} THEN 'm_' ELSE 'n_' END"
    given = f"named_struct('kind', concat('given_', {gender}, {_script(f'{words}[1]')}), 'canonical', lower({words}[1]))"
    surname = f"named_struct('kind', concat('surname_', {_script(f'element_at({words}, -1)')}), 'canonical', lower(element_at({words}, -1)))"
    plain = f"named_struct('kind', {kind}, 'canonical', {_canonical(kind, value)})"
    return f"CASE WHEN {kind} <> 'name' THEN array({plain}) WHEN size({words}) > 2 THEN array({given}, {surname}) ELSE array({surname}) END"


def _canonical(kind: str, value: str) -> str:
    return (
        f"CASE WHEN {kind} IN ('email', 'ipv6') THEN lower({value}) WHEN {kind} IN ('ip', 'secret') THEN {value} "
        f"WHEN {kind} = 'iban' THEN replace({value}, ' ', '') ELSE regexp_replace({value}, '[^0-9]', '') END"
    )


def _scrambled(text: str, latin: str = LATIN) -> str:
    """SQL for ``text`` with each character redrawn among its kind; draws hang on the column ``seed``."""
    pick = lambda letters: f"substring({_q(letters)}, cast(pmod(xxhash64(seed, i), {len(letters)}) as int) + 1, 1)"
    char = (
        f"CASE WHEN c RLIKE '[0-9]' THEN {pick('0123456789')} WHEN c RLIKE '[a-z]' THEN {pick(latin)} WHEN c RLIKE '[A-Z]' THEN upper({pick(latin)}) "
        f"WHEN c RLIKE '\\\\p{{IsCyrillic}}' THEN {pick(CYRILLIC)} WHEN c RLIKE '\\\\p{{IsGreek}}' THEN {pick(GREEK)} "
        f"WHEN c RLIKE '\\\\p{{L}}' THEN {pick(LATIN)} ELSE c END"
    )
    return f"array_join(transform(split({text}, ''), (c, i) -> {char}), '')"


def _luhn(digits: str) -> str:
    """SQL for the Luhn sum of a string of digits."""
    n = f"length({digits})"
    d = f"cast(substring({digits}, {n} - i, 1) as int)"
    return f"aggregate(transform(sequence(0, {n} - 1), i -> if(i % 2 = 1, {d} * 2 - if({d} > 4, 9, 0), {d})), 0, (a, x) -> a + x)"


def _mod97(text: str) -> str:
    """SQL for a string of digits and capitals modulo 97, letters counting from 10."""
    return f"aggregate(split({text}, ''), 0, (a, c) -> if(c RLIKE '[0-9]', (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97))"


def _surrogate(draw: int) -> Column:
    """The surrogate that an entity (kind, canonical) draws with ``seed``."""
    more = str(draw) if draw >= SHORT_DRAWS else ""
    tail = "concat('.', substring_index(canonical, '.', -1))"
    head = f"substring(canonical, 1, length(canonical) - length({tail}))"
    body = _scrambled("substring(canonical, 1, length(canonical) - 1)")
    card = f"if({_luhn('canonical')} % 10 = 0, concat({body}, cast(pmod(-{_luhn(f"concat({body}, '0')")}, 10) as string)), {_scrambled('canonical')})"
    six = "concat_ws(':', transform(sequence(0, 7), i -> lower(hex(pmod(xxhash64(seed, i), 65536)))))"
    four = "concat_ws('.', transform(sequence(0, 3), i -> cast(1 + pmod(xxhash64(seed, i), 254) as string)))"
    account = f"upper({_scrambled('substring(canonical, 5)')})"
    country = "substring(canonical, 1, 2)"
    prefix = r"regexp_extract(canonical, '^(?:AKIA|sk-|gh[pousr]_|xox[abpr]-|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)', 0)"
    ending = r"regexp_extract(canonical, '(?:-----END [A-Z ]{0,20}PRIVATE KEY-----|=+)$', 0)"
    inner = f"substring(canonical, 1 + length({prefix}), length(canonical) - length({prefix}) - length({ending}))"
    cases = {
        "email": f"concat('{more}', {_scrambled(head)}, {tail})",
        "ip": six if more else four,
        "ipv6": six if more else _scrambled("canonical", "abcdef"),
        "phone": f"concat(substring(canonical, 1, 1), {_scrambled('substring(canonical, 2)')}, '{more}')",
        "ssn": f"concat({_scrambled('canonical')}, '{more}')",
        "card": f"concat({card}, '{more}')",
        "iban": f"concat({country}, lpad(cast(98 - {_mod97(f"concat({account}, '{more}', {country}, '00')")} as string), 2, '0'), {account}, '{more}')",
        "secret": f"concat({prefix}, if({inner} RLIKE '^[0-9a-fA-F]+$', {_scrambled(inner, 'abcdef')}, {_scrambled(inner)}), '{more}', {ending})",
    }
    for kind, names in NAMES.items():
        listed = "array(" + ", ".join(_q(x) for x in names) + ")"
        cases[kind] = f"array_join(transform(sequence(0, {draw // 2}), i -> {listed}[cast(pmod(xxhash64(seed, i), {len(names)}) as int)]), '-')"
    return F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + " END")


def _secret_pads(entities: DataFrame, key: str) -> tuple[Column, Column]:
    """The two pads of HMAC-SHA256 for ``key``, as scalar subqueries: plans show where they are read, not what they are."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pads = [bytearray(b ^ x for b in raw) for x in (0x36, 0x5C)]
    table = entities.sparkSession.createDataFrame([tuple(pads)], "inner binary, outer binary")
    return table.select("inner").scalar(), table.select("outer").scalar()


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) for distinct ``entities`` (kind, canonical): one-to-one within a kind,
    and no surrogate among the entities. ``key`` is the secret; without it surrogates can't be retraced."""
    entities = shared_table(entities.select("kind", "canonical").distinct(), "pii-entities")
    inner, outer = _secret_pads(entities, key)
    waiting, done, draw = entities, [], 0
    # Names are compared without regard to capitals, as canonical forms are.
    compared = F.when(F.col("kind").rlike("^(given|surname)_"), F.lower("surrogate")).otherwise(F.col("surrogate"))
    while True:
        message = F.concat_ws("\u0001", "kind", "canonical", F.lit(str(draw))).cast("binary")
        seed = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
        drawn = waiting.select("kind", "canonical", seed.alias("seed")).withColumn("surrogate", _surrogate(draw)).withColumn("form", compared)
        drawn = drawn.select("kind", "canonical", "surrogate", "form")
        drawn = shared_table(drawn, "pii-drawn")
        taken = entities.select("kind", F.col("canonical").alias("form"))
        for table in done:
            taken = taken.unionByName(table.select("kind", "form"))
        # Of those that drew one surrogate the least keeps it: a minimum, not a window, so no group is gathered.
        least = drawn.groupBy("kind", "form").agg(F.min("canonical").alias("canonical"))
        good = least.join(taken, ["kind", "form"], "left_anti").withColumn("settled", F.lit(True))
        judged = shared_table(drawn.join(good, ["kind", "form", "canonical"], "left"), "pii-judged")
        drop_shared(drawn)
        done.append(judged.where("settled").select("kind", "canonical", "surrogate", "form"))
        waiting = judged.where("settled IS NULL").select("kind", "canonical")
        draw += 1
        if waiting.isEmpty():
            break
    out = done[0]
    for table in done[1:]:
        out = out.unionByName(table)
    return out.select("kind", "canonical", "surrogate")


def _laid(value: str, surrogate: str) -> str:
    """SQL for ``surrogate``'s letters and digits between the separators of ``value``; what is left over follows."""
    put = f"named_struct('o', concat(a.o, substring({surrogate}, a.k, 1)), 'k', a.k + 1)"
    return (
        f"aggregate(split({value}, ''), named_struct('o', '', 'k', 1), (a, c) -> if(c RLIKE '[\\\\p{{L}}\\\\p{{N}}]', {put}, "
        f"named_struct('o', concat(a.o, c), 'k', a.k)), a -> concat(a.o, substring({surrogate}, a.k)))"
    )


def _cased(value: str, surrogate: str) -> str:
    """SQL for ``surrogate`` with the capitals of ``value``, character by character where they are as long."""
    paired = f"zip_with(split({value}, ''), split({surrogate}, ''), (c, s) -> if(c = upper(c) AND c <> lower(c), upper(s), s))"
    return f"if(length({value}) = length({surrogate}), array_join({paired}, ''), {surrogate})"


def _named(word: str, surrogate: str) -> str:
    """SQL for a name's surrogate, in capitals if the word is."""
    return f"if(length({word}) > 1 AND {word} = upper({word}), upper({surrogate}), {surrogate})"


def _replaced(kind: str, value: str) -> str:
    """SQL for a mention's replacement, from the row's map ``__map`` of kind and canonical form to surrogates;
    null for a capitalised word that is no part of a name of the text."""
    get = lambda kind, form: f"try_element_at(__map, concat({kind}, '\\u0001', {form}))"
    words = f"split({value}, ' ')"
    first, last = f"{words}[1]", f"element_at({words}, -1)"
    any_given = lambda w: "coalesce(" + ", ".join(get(f"concat('given_{g}_', {_script(w)})", f"lower({w})") for g in "fmn") + ")"
    entity = f"element_at({_entities(kind, value)}, 1)"
    given = get(f"{entity}.kind", f"{entity}.canonical")
    surname = lambda w: get(f"concat('surname_', {_script(w)})", f"lower({w})")
    name = f"concat({words}[0], ' ', if(size({words}) > 2, concat({_named(first, given)}, ' '), ''), {_named(last, surname(last))})"
    # A capitalised word may also be a secret of letters alone.
    bare = f"coalesce({_named(value, f'coalesce({surname(value)}, {any_given(value)})')}, {get("'secret'", value)})"
    found = get(kind, _canonical(kind, value))
    return (
        f"CASE WHEN {kind} = 'name' THEN {name} WHEN {kind} = 'word' THEN {bare} WHEN {kind} IN ('email', 'ipv6') THEN {_cased(value, found)} "
        f"WHEN {kind} IN ('ip', 'secret') THEN {found} ELSE {_laid(value, found)} END"
    )


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities of ``text_col`` replaced, and ``n_entities`` mentions."""
    columns = [c for c in docs.columns if c != "n_entities"]
    keyed = docs.select(*columns, F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__h"))
    found = keyed.select("__id", "__h", F.regexp_extract_all(text_col, F.lit(PATTERN), F.lit(0)).alias("__m")).where(F.size("__m") > 0)
    found = shared_table(found, "pii-found")

    mention = found.select("__id", "__h", F.explode(F.array_distinct("__m")).alias("value")).withColumn("kind", F.expr(_kind("value")))
    parts = mention.select("__id", "__h", F.explode(F.expr(_entities("kind", "value"))).alias("e")).select("__id", "__h", "e.kind", "e.canonical").distinct()
    parts = shared_table(parts, "pii-parts")
    # A given name of unknown gender is the same entity as that of the one gender known for it.
    given = parts.select("kind", "canonical").where("kind LIKE 'given%'").distinct()
    script, gender = F.substring_index("kind", "_", -1), F.substring("kind", 7, 1)
    known = given.groupBy("canonical", script.alias("script")).agg(F.max(F.when(gender == "f", 1)).alias("f"), F.max(F.when(gender == "m", 1)).alias("m"))
    resolved = F.when(F.col("f").isNotNull() & F.col("m").isNull(), "f").when(F.col("m").isNotNull() & F.col("f").isNull(), "m")
    known = known.select(F.concat(F.lit("given_n_"), "script").alias("kind"), "canonical", F.concat(F.lit("given_"), resolved, F.lit("_"), "script").alias("taken"))
    entities = parts.select("kind", "canonical").distinct().join(known, ["kind", "canonical"], "left")
    entities = entities.select("kind", "canonical", F.coalesce("taken", "kind").alias("taken"))
    drawn = assign_surrogates(entities.select(F.col("taken").alias("kind"), "canonical"), key)
    table = entities.join(drawn.withColumnRenamed("kind", "taken"), ["taken", "canonical"]).select("kind", "canonical", "surrogate")
    entry = F.struct(F.concat_ws("\u0001", "kind", "canonical").alias("k"), F.col("surrogate").alias("v"))
    maps = parts.join(table, ["kind", "canonical"]).groupBy("__id", "__h").agg(
        F.map_from_entries(F.collect_list(entry)).alias("__map"), F.max(F.col("kind").startswith("surname")).alias("__names")
    )

    flagged = maybe_in(keyed, ["__id", "__h"], filter_table(found.select("__id", "__h")), "__f")
    none = F.lit(0).cast("long").alias("n_entities")
    clean = flagged.where("NOT __f").select(*columns, none)
    marked = maps.select(F.col("__id").alias("__i"), F.col("__h").alias("__k"), "__map", "__names")
    rest = flagged.where("__f").join(marked, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__k")), "left")
    # Names may stand without their title: where a text has any, its capitalised words are looked up as well.
    pattern = F.when(F.col("__names"), F.lit(WIDE_PATTERN)).otherwise(F.lit(PATTERN))
    rest = rest.withColumn("__m", F.when(F.col("__map").isNotNull(), F.regexp_extract_all(text_col, pattern, F.lit(0))))
    rest = rest.withColumn("__b", F.when(F.col("__map").isNotNull(), F.split(text_col, pattern, -1)))
    word = f"__names AND v RLIKE {_q(f'^{_NAME}$')}"
    rest = rest.withColumn("__m", F.expr(f"transform(__m, v -> named_struct('kind', if({word}, 'word', {_kind('v')}), 'value', v))"))
    rest = rest.withColumn("__s", F.expr(f"transform(__m, x -> {_replaced('x.kind', 'x.value')})"))
    woven = F.expr("concat(element_at(__b, 1), array_join(zip_with(zip_with(__s, __m, (s, m) -> coalesce(s, m.value)), slice(__b, 2, size(__s)), (s, b) -> concat(s, b)), ''))")
    text = F.when(F.col("__map").isNull(), F.col(text_col)).otherwise(woven).alias(text_col)
    count = F.when(F.col("__map").isNull(), F.lit(0)).otherwise(F.size(F.filter("__s", lambda s: s.isNotNull()))).cast("long").alias("n_entities")
    return clean.unionByName(rest.select(*[text if c == text_col else F.col(c) for c in columns], count))
