"""PII: detected entities get surrogates by a key, of their own type, script, gender and format.

Types: e-mail addresses, IPv4 addresses, phone, card, social security and account (IBAN) numbers, access keys, secrets after
a label such as ``password=``, and persons named behind a title. A surrogate depends on the key and the entity only, so
one entity has one surrogate in all documents (coreference). Distinct entities keep distinct surrogates:

* numbers and IPv4 addresses go through a keyed Feistel network over their digits (bits), a step of one, and the network's
  inverse, which is a bijection that maps none to itself; the digits alone decide, so two spellings of a number stay
  one number; the punctuation, a country code and a card's first digit stay;
* all others are spelled from 60 bits of a keyed SHA-256, each letter as a letter of its case, each digit as a digit;
  local parts and secrets with few letters and digits are lengthened;
* a family name is eight syllables of its script and depends on the family name alone; a given name is one of a list of
  the title's gender and the name's script with three syllables after it, and depends on the person (given and family
  name, and gender). So "Mr. John Smith" and "Mr. Smith" keep one family name in all documents, and in a document that
  names a person behind a title, the bare full, family and given name become the same. A title without gender (Dr.)
  takes the gender that the same name has elsewhere, if that is but one;
* a check over all distinct entities, families and persons looks for those that share a surrogate, or are their own; all
  but one of them take their next salt, round by round until none is left. If any is left after `ROUNDS`, as where more
  entities than surrogates of a format exist, an error is raised.

Texts are taken apart by one regular expression and put together again within the row, so they aren't shuffled;
only distinct entities are. All is done by SQL functions. The key has no default: who knows it can undo the surrogates of
numbers.

Null texts stay null, empty texts empty; very long ones are read whole. Texts without entities stay as they are.
Repeated rows give equal rows. Where two persons of a document have one given name (ties), the bare given name is the
first one's. An empty table gives an empty table. Other columns stay as they are, whatever their names, but for
`n_entities`, which is replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.llm import common
from taproot.llm.decontaminate import let

#: The key of the queries over test data; any real use brings its own, secret one.
QUERY_KEY = "queries over test data"
ROUNDS = 64

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_LABEL = r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key))\s{0,3}[=:]\s{0,3}[\x22\x27]?"
_MEN, _WOMEN, _ANY = "Mr|Herr|Herrn|Monsieur|Señor|Sr|господин", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа", "Dr|Prof"
_TITLE = rf"(?:{_MEN}|{_WOMEN}|{_ANY})"
ENTITY = "|".join(
    (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
        r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
        _LABEL + r"[A-Za-z0-9+/_.-]{8,}",
        rf"(?<![\d.]){_IP}(?!\d|\.\d)",
        r"(?<!\d)\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)",
        r"(?<!\d)\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)",
        r"(?<![\d+(.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])",
        r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
        r"(?<!\d)(?:\d{4}[ -]){3}\d{1,7}(?!\d)|(?<!\d)\d{13,18}(?!\d)",
        r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        rf"(?<!\p{{L}}){_TITLE}\.? \p{{Lu}}\p{{Ll}}{{1,24}}(?: \p{{Lu}}\p{{Ll}}{{1,24}})?(?!\p{{L}})",
    )
)
_TITLE_HINT = rf"(?<!\p{{L}}){_TITLE}\.? \p{{Lu}}"
#: A text without any of these has no entity.
HINT = rf"[0-9@]|(?<!\p{{L}}){_TITLE}\.? \p{{Lu}}|(?i:password|passwd|pwd|secret|token|api[_-]?key)"

NAMES = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nico Oscar Paul Ralf Simon Tomas Viktor",
    ("latin", "f"): "Anna Berta Clara Diana Elena Frida Greta Helena Irma Julia Karla Laura Maria Nora Olivia Paula Rosa Sara Tina Vera",
    ("latin", "x"): "Alex Robin Kim Sascha Toni Noa Jules Mika Charlie Andrea Dominique Jean Luca Max Nikola Pat Rene Sam Sidney Vivian",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Степан Тимур Фёдор Юрий Яков Артём",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Клара Лидия Мария Нина Ольга Полина Раиса Софья Тамара Ульяна Юлия Яна",
    ("cyrillic", "x"): "Саша Женя Валя Слава Шура Тоня Паша Миша Юля Вика Лёша Стася Рита Гера Лёля Дина Тася Кира Оля Сима",
}
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne", "cyrillic": "ба бе би бо да де ди до фа фе га го ка ке ки ко ла ле ли ло ма ме ми мо на не"}


def _lit(s: str) -> str:
    """An SQL string literal of ``s``."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(parts: str) -> str:
    """SQL: 60 bits of SHA-256 of a string expression."""
    return f"cast(conv(substring(sha2({parts}, 256), 1, 15), 16, 10) as bigint)"


def _feistel(high: str, low: str, high_size: str, low_size: str, secret: str, then: str) -> str:
    """SQL: ``then`` with x and y bound to two halves after keyed rounds, a step of one, and the same rounds undone.

    Each round adds to one half what the other and the key give. As the step moves every value, so does the whole.
    """
    sql = then
    steps = [(r, "+") for r in range(4)] + [(None, "+")] + [(r, "-") for r in reversed(range(4))]
    for r, sign in reversed(steps):
        if r is None:
            sql = let("x", f"pmod(x + 1L, {high_size})", sql)
            continue
        moved, other, size_ = ("x", "y", high_size) if r % 2 == 0 else ("y", "x", low_size)
        added = f"pmod({moved} {sign} pmod({_number(f'concat({secret}, {_lit(str(r))}, {other})')}, {size_}), {size_})"
        sql = let(moved, added, sql)
    return let("x", high, let("y", low, sql))


def _spelled(value: str, base: str, hexadecimal: str = "false") -> str:
    """SQL: ``value`` with each letter and digit drawn anew from ``base``; all else stays."""
    draw = lambda n: f"cast(pmod(xxhash64({base}, i), {n}) as int)"
    c = f"substring({value}, i, 1)"
    lower = f"if({hexadecimal}, substring('abcdef', 1 + {draw(6)}, 1), substring('abcdefghijklmnopqrstuvwxyz', 1 + {draw(26)}, 1))"
    return f"array_join(transform(sequence(1, greatest(length({value}), 1)), i -> CASE WHEN {c} BETWEEN '0' AND '9' THEN cast({draw(10)} as string) WHEN {c} BETWEEN 'a' AND 'z' THEN {lower} WHEN {c} BETWEEN 'A' AND 'Z' THEN upper({lower}) ELSE {c} END), '')"


_ACCESS, _VALUE = "^(?:AKIA|ASIA)[A-Z0-9]{16}$", r"([A-Za-z0-9+/_.-]{8,})$"
_TITLED = rf"^(?:{_TITLE})[.]? (?=\p{{Lu}})"


def identity(e: str) -> str:
    """SQL: what makes two spelled entities one, whatever their case, spaces or label. Numbers stand for themselves."""
    return f"CASE WHEN {e} LIKE '%@%' THEN lower({e}) WHEN {e} RLIKE {_lit(_ACCESS)} THEN {e} WHEN {e} RLIKE {_lit('^' + _LABEL)} THEN concat('=', regexp_extract({e}, {_lit(_VALUE)}, 1)) WHEN {e} RLIKE '^[A-Z]{{2}}[0-9]{{2}}' THEN replace({e}, ' ', '') ELSE {e} END"


def surrogate(e: str, key: str, salt: str = "'0'") -> str:
    """SQL for the surrogate of an entity (a bound name) that is no person; ``salt`` is SQL of a string, which domains and numbers ignore."""
    secret = lambda kind: _lit(f"{key}|0|{kind}|") if kind in ("domain", "ip", "number") else f"concat({_lit(f'{key}|')}, {salt}, {_lit(f'|{kind}|')})"
    base = lambda kind, value: _number(f"concat({secret(kind)}, {value})")
    extract = lambda pattern, group: f"regexp_extract({e}, {_lit(pattern)}, {group})"

    domain = let("d", extract(r"@(.*)\.[^.]*$", 1), let("b", base("domain", "lower(d)"), _spelled("d", "b")))
    longer = lambda value, n: f"concat({value}, repeat('x', greatest({n} - length(regexp_replace({value}, '[^A-Za-z0-9]', '')), 0)))"
    local = let("v", longer(extract("^([^@]*)@", 1), 12), let("b", base("mail", f"lower({e})"), _spelled("v", "b")))
    mail = f"concat({local}, '@', {domain}, {extract(r'(\.[^.]*)$', 1)})"

    octets = let("o", f"transform(split({e}, '[.]'), p -> cast(p as bigint))", _feistel("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536L", "65536L", secret("ip"), "concat_ws('.', cast(x div 256 as string), cast(x % 256 as string), cast(y div 256 as string), cast(y % 256 as string))"))

    # What a number keeps: a country code, or a card's first digit.
    kept = f"CASE WHEN {e} RLIKE {_lit(r'^[+]?[0-9]{1,3}[ .-]?[(]')} THEN {extract(r'^([+]?[0-9]{1,3}[ .-]?)', 1)} WHEN {e} LIKE '+%' THEN {extract(r'^([+][0-9]{1,3})', 1)} WHEN length(regexp_replace({e}, '[^0-9]', '')) >= 13 THEN substring({e}, 1, 1) ELSE '' END"
    power = lambda n: f"cast(rpad('1', {n} + 1, '0') as bigint)"
    spread = "concat(k, array_join(transform(sequence(1, greatest(length(t), 1)), i -> if(substring(t, i, 1) BETWEEN '0' AND '9', substring(z, length(regexp_replace(substring(t, 1, i), '[^0-9]', '')), 1), substring(t, i, 1))), ''))"
    digits = _feistel("cast(substring(g, 1, n div 2) as bigint)", "cast(substring(g, n div 2 + 1) as bigint)", power("n div 2"), power("(n - n div 2)"), secret("number"), let("z", "concat(lpad(cast(x as string), n div 2, '0'), lpad(cast(y as string), n - n div 2, '0'))", spread))
    number = let("k", kept, let("t", f"substring({e}, length(k) + 1)", let("g", "regexp_replace(t, '[^0-9]', '')", let("n", "length(g)", digits))))

    access = let("b", base("key", e), f"concat(substring({e}, 1, 4), {_spelled(f'substring({e}, 5)', 'b')})")
    account = let("b", base("account", f"replace({e}, ' ', '')"), let("s", f"replace({e}, ' ', '')", let("q", f"concat(substring(s, 1, 2), {_spelled('substring(s, 3)', 'b')})", f"array_join(transform(sequence(1, length({e})), i -> if(substring({e}, i, 1) = ' ', ' ', substring(q, length(replace(substring({e}, 1, i), ' ', '')), 1))), '')")))
    value = extract(_VALUE, 1)
    secret_value = let("v", value, let("b", base("secret", "v"), f"concat(substring({e}, 1, length({e}) - length(v)), {let('u', longer('v', 8), _spelled('u', 'b', 'v RLIKE ' + _lit('^[0-9a-f]+$')))})"))

    return f"CASE WHEN {e} LIKE '%@%' THEN {mail} WHEN {e} RLIKE {_lit(_ACCESS)} THEN {access} WHEN {e} RLIKE {_lit('^' + _LABEL)} THEN {secret_value} WHEN {e} RLIKE {_lit('^' + _IP + '$')} THEN {octets} WHEN {e} RLIKE '^[A-Z]{{2}}[0-9]{{2}}' THEN {account} ELSE {number} END".replace("{{2}}", "{2}")


def gender(e: str) -> str:
    """SQL: m, f, or x where the title tells none."""
    return f"CASE WHEN {e} RLIKE {_lit(rf'^(?:{_WOMEN})[. ]')} THEN 'f' WHEN {e} RLIKE {_lit(rf'^(?:{_MEN})[. ]')} THEN 'm' ELSE 'x' END"


def titled(e: str) -> str:
    """SQL: whether an entity is a person behind a title."""
    return f"{e} RLIKE {_lit(_TITLED)}"


def person_of(e: str) -> str:
    """SQL: struct(given or null, family, g) of a titled entity."""
    return let("w", f"split(regexp_replace({e}, {_lit(_TITLED)}, ''), ' ')", f"struct(if(size(w) > 1, w[0], NULL) AS given, element_at(w, -1) AS family, {gender(e)} AS g)")


def person_id(p: str) -> str:
    return f"concat({p}.given, ' ', {p}.family, '|', {p}.g)"


def _syllables(base: str, script: str, n: int) -> str:
    parts = "map(" + ", ".join(f"{_lit(s)}, split({_lit(v)}, ' ')" for s, v in SYLLABLES.items()) + ")"
    return f"array_join(transform(sequence(1, {n}), i -> {parts}[{script}][cast(pmod(xxhash64({base}, i), 26) as int)]), '')"


def _script(name: str) -> str:
    return f"if({name} RLIKE {_lit(r'[\p{IsCyrillic}]')}, 'cyrillic', 'latin')"


def family_name(family: str, key: str, salt: str) -> str:
    """SQL for the surrogate of a family name (a bound name)."""
    base = _number(f"concat({_lit(f'{key}|')}, {salt}, '|family|', {family})")
    return let("b", base, f"initcap({_syllables('b', _script(family), 8)})")


def given_name(p: str, g: str, key: str, salt: str) -> str:
    """SQL for the given name of a person (a bound name) of resolved gender ``g``."""
    base = _number(f"concat({_lit(f'{key}|')}, {salt}, '|given|', {p}.given, ' ', {p}.family, '|', {g})")
    names = "map(" + ", ".join(f"{_lit(s + of)}, split({_lit(n)}, ' ')" for (s, of), n in NAMES.items()) + ")"
    return let("b", base, let("s", _script(f"{p}.given"), f"concat({names}[concat(s, {g})][cast(pmod(b, 20) as int)], {_syllables('b', 's', 3)})"))


_HELD = "map<string, struct<salt: int, g: string>>"


def replacement(e: str, people: str, held: str, key: str) -> str:
    """SQL for the surrogate of an entity or bare name, from the titled persons of its text and the ids held in a map."""
    at = lambda i: f"if(size({held}) = 0, NULL, try_element_at({held}, {i}))"
    salt = lambda i: f"cast(coalesce({at(i)}.salt, 0) as string)"
    family = lambda f: let("sf", salt(f"concat('#', {f})"), family_name(f, key, "sf"))
    given = let("k", at(person_id("p")), let("sg", "cast(coalesce(k.salt, 0) as string)", given_name("p", "coalesce(k.g, p.g)", key, "sg")))
    whole = f"concat(if(p.given IS NULL, '', concat({given}, ' ')), {let('fam', 'p.family', family('fam'))})"
    behind = let("p", person_of(e), f"concat(regexp_extract({e}, {_lit(_TITLED)}, 0), {whole})")
    first = lambda test: f"filter({people}, q -> {test})[0]"
    full = let("p", first(f"concat(q.given, ' ', q.family) = {e}"), whole)
    alone = let("p", first(f"q.given = {e}"), given)
    bare = f"CASE WHEN {e} LIKE '% %' THEN {full} WHEN exists({people}, q -> q.family = {e}) THEN {family(e)} ELSE {alone} END"
    other = let("so", salt(identity(e)), surrogate(e, key, "so"))
    return f"CASE WHEN {titled(e)} THEN {behind} WHEN {e} RLIKE {_lit(_BARE)} THEN {bare} ELSE {other} END"


#: Names as they stand without a title: letters only, which no other entity is.
_BARE = r"^\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?$"


def entities(docs: DataFrame) -> DataFrame:
    """(value) of every entity, as often as it occurs."""
    own = docs.where(F.col("text").rlike(HINT)).select(F.explode(F.array(F.regexp_extract_all("text", F.lit(ENTITY), 0))).alias("found"))
    return own.select(F.explode("found").alias("value"))


def held_ids(docs: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(id, salt, g) of the entities, families ('#' before) and persons that need another salt than 0 or a gender of
    their own, so that none share a surrogate and none is its own."""
    values = common.Stored(entities(docs).distinct())
    own = values.read()
    row = lambda kind, i, g="cast(NULL as string)": [f"'{kind}' AS kind", f"{i} AS id", f"{g} AS g"]
    no_person = "cast(NULL as struct<given: string, family: string, g: string>) AS p"
    others = own.where(f"NOT {titled('value')}").selectExpr(*row("other", identity("value")), "value", no_person)
    named = own.where(titled("value")).selectExpr(f"{person_of('value')} AS p")
    families = named.selectExpr(*row("family", "concat('#', p.family)"), "p.family AS value", no_person).distinct()
    known = named.where("p.given IS NOT NULL").groupBy(F.expr("p.given").alias("given"), F.expr("p.family").alias("family")).agg(F.collect_set("p.g").alias("gs"))  # three at most
    # Without a gender of its own, a name takes the one that it has elsewhere.
    alias = "if(array_contains(gs, 'x') AND size(gs) = 2, filter(gs, g -> g <> 'x')[0], NULL)"
    known = common.Stored(known.selectExpr("given", "family", "gs", f"{alias} AS alias"))
    people = known.read().selectExpr("given", "family", "explode(filter(gs, g -> alias IS NULL OR g <> 'x')) AS g").selectExpr("struct(given, family, g) AS p")
    people = people.selectExpr(*row("person", person_id("p"), "p.g"), "concat(p.given, ' ', p.family) AS value", "p")
    salted = "cast(salt as string)"
    made = f"CASE kind WHEN 'other' THEN {surrogate('value', key, salted)} WHEN 'family' THEN {family_name('value', key, salted)} ELSE concat({given_name('p', 'g', key, salted)}, ' ', p.family) END"
    drawn = lambda df: df.select("kind", "id", "g", "value", "p", "salt", F.explode(F.array(F.expr(made))).alias("made"))
    held = common.Stored(drawn(others.unionByName(families).unionByName(people).withColumn("salt", F.lit(0))))
    for turn in range(rounds):
        now = held.read()
        # One of those that share a surrogate keeps it.
        shared = now.groupBy("kind", "made").agg(F.min("id").alias("first"), F.max("id").alias("other")).where("first <> other").select("kind", "made", "first")
        again = common.Stored(now.join(shared, ["kind", "made"]).where("id <> first").select("id").union(now.where("value = made").select("id")).distinct())
        if not again.read().limit(1).count():
            again.drop()
            break
        bad = common.small(again.read())
        following = common.Stored(now.join(bad, "id", "left_anti").unionByName(drawn(now.join(bad, "id", "left_semi").withColumn("salt", F.lit(turn + 1)))))
        again.drop()
        held.drop()
        held = following
    else:
        raise ValueError(f"entities still share surrogates after {rounds} rounds")
    moved = held.read().where("salt > 0")
    aliases = known.read().where("alias IS NOT NULL").selectExpr("concat(given, ' ', family, '|x') AS id", "concat(given, ' ', family, '|', alias) AS of", "alias AS g")
    aliases = aliases.join(moved.selectExpr("id AS of", "salt"), "of", "left").selectExpr("id", "coalesce(salt, 0) AS salt", "g")
    found = common.stored(moved.select("id", "salt", "g").distinct().unionByName(aliases))
    for t in (values, known, held):
        t.drop()
    return found


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in text, n_chars set anew if there, and n_entities: how many were replaced."""
    if not key:
        raise ValueError("surrogates need a key")
    names = [c for c in docs.columns if c.lower() != "n_entities"]
    held, made, mark = (f"_{x}_{uuid.uuid4().hex}" for x in ("held", "made", "mark"))
    whole_name = "concat_ws(' ', p.given, p.family)"
    bare = f"array_sort(array_distinct(flatten(transform(people, p -> filter(array({whole_name}, p.family, p.given), x -> x IS NOT NULL)))), (x, y) -> length(y) - length(x))"
    before, behind = _lit(r"|(?<!\p{L})(?:"), _lit(r")(?!\p{L})")
    pattern = f"if(size(people) = 0, r0, concat(r0, {before}, array_join({bare}, '|'), {behind}))"
    joined = f"array_join(zip_with(split(text, r, -1), transform(regexp_extract_all(text, r, 0), e -> {replacement('e', 'people', held, key)}), (a, b) -> concat(a, coalesce(b, ''))), '')"
    counted = f"struct(size(regexp_extract_all(text, r, 0)) AS n, {joined} AS made)"
    people = f"if(text RLIKE {_lit(_TITLE_HINT)}, transform(filter(regexp_extract_all(text, r0, 0), e -> {titled('e')}), e -> {person_of('e')}), cast(array() as array<struct<given: string, family: string, g: string>>))"
    whole = f"if(text RLIKE {_lit(HINT)}, {let('r0', _lit(ENTITY), let('people', people, let('r', pattern, counted)))}, struct(0 AS n, text AS made))"
    docs = _with_held(docs, held_ids(docs.select("text"), key), held, mark)
    own = docs.withColumn(made, F.explode(F.array(F.expr(whole))))
    text, n = F.col(f"{made}.made"), F.col(f"{made}.n")
    columns = [text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names]
    return own.select(*columns, F.coalesce(n, F.lit(0)).alias("n_entities"))


def _with_held(docs: DataFrame, ids: DataFrame, held: str, mark: str) -> DataFrame:
    """``docs`` with a map column of the held ids: one map for all rows while they are few, else for each text its own."""
    entry = F.map_from_entries(F.collect_list(F.struct("id", F.struct("salt", "g"))))
    few = ids.limit(common.BROADCAST_ROWS + 1).count()
    if not few:
        return docs.withColumn(held, F.expr(f"cast(map() as {_HELD})"))
    if few <= common.BROADCAST_ROWS:
        return docs.crossJoin(F.broadcast(ids.agg(entry.alias(held))))  # one row
    texts = docs.select(F.xxhash64("text").alias(mark), "text").where(F.col("text").rlike(HINT))
    found = texts.select(mark, F.explode(F.array(F.regexp_extract_all("text", F.lit(ENTITY), 0))).alias("x")).select(mark, F.explode("x").alias("value"))
    asked = found.selectExpr(mark, f"explode(if({titled('value')}, {let('p', person_of('value'), f'array({person_id("p")}, concat({_lit("#")}, p.family))')}, array({identity('value')}))) AS id").distinct()
    maps = asked.join(ids, "id").groupBy(mark).agg(entry.alias(held))
    own = docs.withColumn(mark, F.xxhash64("text")).join(maps, mark, "left").drop(mark)
    return own.withColumn(held, F.coalesce(held, F.expr(f"cast(map() as {_HELD})")))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(common.table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
