"""Surrogate generation for personal data, in DataFrame functions only.

Entities are found by one pattern; each distinct entity gets one keyed surrogate of its own type, shape, script and (for
names) gender, so equal entities stay equal everywhere: a name whatever its title, a domain whatever its user, a full name also where it
is repeated without its title in the same text. Surrogates are checked against each other and against every
original found; losers of a collision draw again until all are distinct. Texts are rebuilt from the gaps between
entities and the surrogates, in the order of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, let, materialize

#: Letter-led titles that announce a person, by the gender they state.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Госпожа", "г-жа")
NEUTRAL = ("Dr", "Prof")
_TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))

#: What announces a secret; it is part of the match and stays in the text.
_LABEL = r"(?i:token|secret|password|passwd|api_key|apikey|access_key)\s?[=:]\s?[\"']?"

#: Signs right before an address; matched with it, so that a run of characters is read from its start only, and kept in the text.
_LEAD = r"[._%+\-]*+"

#: type -> pattern, in order of precedence where two could start at one place.
PATTERNS = {
    "email": rf"(?:(?<![A-Za-z0-9._%+\-])|\G){_LEAD}[A-Za-z0-9][A-Za-z0-9._%+\-]*+@[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{{2,}}",
    "secret": rf"{_LABEL}[A-Za-z0-9+/_\-]{{16,}}={{0,2}}"
    r"|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)",
    "ip6": r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?![\w-])|(?<![\w.])\+\d{8,15}(?!\w)",
    "card": r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w\-])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?(?![\p{{L}}])",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: Surrogate names are put together from these, by script: onsets, middles, then endings by gender or for families.
SYLLABLES = {
    "latin": ("Bel Cor Dan El Fel Gar Hol Jor Kal Lor Mar Nor Per Ros Sel Tav".split(), "a e i o u an en in on ar er or al el il am".split(),
              {"m": "do mus tor ric vin bert ton lan".split(), "f": "dia lina rissa tta nelle via ria mira".split(), "u": "dy ney ry ley kit lin rin sky".split(), "last": "sen man berg ford wood stein field well".split()}),
    "cyrillic": ("Бел Вар Гор Дан Жел Зор Кал Лев Мир Нов Пол Рад Сел Тим Фед Яр".split(), "а е и о у ан ен ин он ар ер ор ал ел ил ам".split(),
                 {"m": "дор мир слав тон лан рик вин кар".split(), "f": "дия лина рина ника вия мира сия нара".split(), "u": "ша ня ся ля ка ря тя зя".split(), "last": "ко чук дзе ян ник вич лис гай".split()}),
}
#: Draws of one surrogate before the format is held to have fewer members than there are entities, which is an error.
ROUNDS = 200
#: A text without any of these characters or secrets' prefixes, nor a title, holds no entity; most texts are told by this alone.
SIGNS = "[0-9@=:]|AKIA|gh[pousr]_|sk-"


def kind_of(e: Column) -> Column:
    """The first type whose whole pattern an entity matches; a secret is what is left."""
    out = F.lit("secret")
    for name in reversed([n for n in PATTERNS if n != "secret"]):
        out = F.when(e.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


def _has_entity(text: Column) -> Column:
    """Whether the pattern matches; the cheap signs are looked for first."""
    sign = text.rlike(SIGNS)
    for t in MALE + FEMALE + NEUTRAL:
        sign = sign | text.contains(t)
    return F.coalesce(F.when(sign, text.rlike(PATTERN)), F.lit(False))


def _hex(key: str, *parts: Column, blocks: int = 1) -> Column:
    """64 * blocks hex digits that depend on the key and the parts."""
    text = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(*[F.sha2(F.concat_ws("\x1f", text, F.lit(str(i))), 256) for i in range(blocks)])


def _byte(h: Column, i: Column | int, width: int = 4) -> Column:
    """A number below 16 ** width from place i of a hex string, places wrapping around."""
    n = F.length(h) - width
    at = F.pmod(F.lit(i) * width if isinstance(i, int) else i * width, n) + 1
    return F.conv(F.substr(h, at.cast("int"), F.lit(width)), 16, 10).cast("int")


def _shape(e: Column, h: Column, hexadecimal: Column) -> Column:
    """The same string with each digit and ASCII letter redrawn within its class; hex strings stay hex."""
    pick = lambda s, n: F.substr(F.lit(s), F.pmod(n, F.lit(len(s))) + 1, F.lit(1))

    def one(c: Column, i: Column, h: Column, hexadecimal: Column) -> Column:
        n = _byte(h, i)
        return (
            F.when(c.between("0", "9"), pick("0123456789", n))
            .when(hexadecimal & c.between("a", "f"), pick("abcdef", n))
            .when(hexadecimal & c.between("A", "F"), pick("ABCDEF", n))
            .when(c.between("a", "z"), pick("abcdefghijklmnopqrstuvwxyz", n))
            .when(c.between("A", "Z"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
            .otherwise(c)
        )

    chars = lambda p: F.transform(F.split(p["e"], ""), lambda c, i: one(c, i, p["h"], p["x"]))
    return F.array_join(let(F.struct(e.alias("e"), h.alias("h"), hexadecimal.alias("x")), chars), "")


def _luhn(number: Column) -> Column:
    """The number with its last digit set so that the Luhn sum holds; separators stay."""
    digits = F.reverse(F.split(F.regexp_replace(number, r"\D", ""), ""))

    def worth(d: Column, i: Column) -> Column:
        n = F.coalesce(d.try_cast("int"), F.lit(0))
        two = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.when(i == 0, F.lit(0)).when(F.pmod(i, F.lit(2)) == 1, two).otherwise(n)

    total = F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, b: a + b)
    check = F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")
    return F.concat(F.substr(number, F.lit(1), F.length(number) - 1), check)


def _iban(number: Column) -> Column:
    """The number with its two check digits set so that the remainder by 97 is 1; spaces stay."""
    body, country = F.substr(number, F.lit(5), F.length(number)), F.substr(number, F.lit(1), F.lit(2))
    letters = F.filter(F.split(F.concat(F.translate(body, " ", ""), country, F.lit("00")), ""), lambda c: c != "")
    add = lambda n, c: F.pmod(F.when(c.between("0", "9"), n * 10 + F.ascii(c) - 48).otherwise(n * 100 + F.ascii(c) - 55), F.lit(97))
    check = F.lpad((98 - F.aggregate(letters, F.lit(0), add)).cast("string"), 2, "0")
    return F.concat(country, check, body)


def _name(part: Column, kind: Column, h: Column) -> Column:
    """A name of the part's script; kind is first_m, first_f, first_u or last."""
    out = None
    for script, (onsets, middles, ends) in SYLLABLES.items():
        pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), F.pmod(_byte(h, i), F.lit(len(xs))))
        end = pick(ends["u"], 2)
        for g, k in (("m", "first_m"), ("f", "first_f"), ("last", "last")):
            end = F.when(kind == k, pick(ends[g], 2)).otherwise(end)
        # after a few collisions the family of names is widened by one more syllable
        made = F.concat(pick(onsets, 0), pick(middles, 1), end)
        out = made if out is None else F.when(part.rlike(r"^\p{IsCyrillic}"), made).otherwise(out)
    return out


def surrogate(kind: Column, value: Column, key: str, attempt: Column, host: Column) -> Column:
    """One draw of a surrogate; drawn again with a higher attempt where it collides. ``host``: the surrogate of an address's domain."""
    return let(_hex(key, kind, F.lower(value), attempt.cast("string"), blocks=2), lambda h: _drawn(kind, value, attempt, host, h))


def _drawn(kind: Column, value: Column, attempt: Column, host: Column, h: Column) -> Column:
    hexadecimal = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    shaped = _shape(value, h, hexadecimal | (kind == "ip6"))
    more = lambda first, step: F.when(attempt >= first, F.translate(F.substr(h, F.lit(5), 1 + F.floor((attempt - first) / step).cast("int")), "0123456789", "ghijklmnop")).otherwise("")
    # formats of free length grow a little after some collisions
    user = F.concat(_shape(F.substring_index(value, "@", 1), h, F.lit(False)), more(8, 4))
    top = F.regexp_extract(value, r"(\.[A-Za-z]+)$", 1)
    domain = F.concat(_shape(F.substr(value, F.lit(1), F.length(value) - F.length(top)), h, F.lit(False)), more(8, 4), top)
    octet = lambda i, low, n: (F.pmod(_byte(h, i), F.lit(n)) + low).cast("string")
    ip = F.concat_ws(".", octet(0, 1, 223), octet(1, 0, 256), octet(2, 0, 256), octet(3, 0, 256))
    first_digit = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(shaped, F.lit(2), F.length(value)))
    country = F.concat(F.substr(value, F.lit(1), F.lit(2)), F.substr(shaped, F.lit(3), F.length(value)))
    code = F.regexp_extract(value, r"^(\+\d{1,3}[ .\-])", 1)
    phone = F.concat(code, F.substr(shaped, F.length(code) + 1, F.length(value)))
    long = F.when(attempt >= 8, F.concat(shaped, F.substr(h, F.lit(1), F.lit(4)))).otherwise(shaped)
    return (
        F.when(kind == "email", F.concat(user, F.lit("@"), host)).when(kind == "domain", domain).when(kind == "ip", ip)
        .when(kind == "card", _luhn(first_digit)).when(kind == "iban", _iban(country)).when(kind == "phone", phone)
        .when(kind.isin("ssn", "ip6"), shaped).when(kind == "secret", long)
        .otherwise(F.concat(_name(value, kind, h), F.translate(more(2, 4), "ghijklmnop", "aeiouaeiou")))
    )


def units(match: Column) -> Column:
    """The parts of a match that get a surrogate of their own: the whole, or each part of a name, so that
    "Mrs Ann Lee" and "Mrs Lee" keep sharing a family name."""
    kind = kind_of(match)
    secret = F.regexp_replace(match, rf"^(?:{_LABEL})", "")
    address = F.regexp_replace(match, rf"^{_LEAD}", "")
    part = F.split(F.regexp_replace(match, rf"^(?:{_TITLES})\.? ", ""), " ")
    title = F.regexp_extract(match, rf"^({_TITLES})", 1)
    gender = F.when(title.isin(*MALE), "first_m").when(title.isin(*FEMALE), "first_f").otherwise("first_u")
    unit = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    last = F.lit("last")
    return F.when(
        kind == "name",
        F.when(F.size(part) == 2, F.array(unit(gender, F.get(part, 0)), unit(last, F.get(part, 1)))).otherwise(F.array(unit(last, F.get(part, 0)))),
    ).otherwise(F.array(unit(kind, F.when(kind == "secret", secret).when(kind == "email", address).otherwise(match))))


def _pool(kind: Column) -> Column:
    """What surrogates are told apart within: first names of all genders together, else the kind."""
    return F.when(kind.startswith("first"), F.lit("first")).otherwise(kind)


def draw_surrogates(distinct: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value[, host]): no surrogate twice in a pool of kinds, none equal to any original of it.

    Spelling variants of one value that differ in case only are one entity when drawn, and two when they collide. An address is
    drawn with ``host``, its domain's surrogate. An empty table gives an empty one.
    """
    if "host" not in distinct.columns:
        distinct = distinct.withColumn("host", F.lit(None).cast("string"))
    distinct = distinct.withColumn("pool", _pool(F.col("kind")))
    left, done = distinct.withColumn("attempt", F.lit(0)), None
    originals = distinct.select("pool", F.col("value").alias("surrogate"))
    for _ in range(ROUNDS):
        drawn = materialize(left.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), key, F.col("attempt"), F.col("host"))), "drawn")
        taken = originals if done is None else originals.unionByName(done.select("pool", "surrogate"))
        # the first of those that drew alike keeps it, unless it is an original or given away before
        keeps = drawn.groupBy("pool", "surrogate").agg(F.min(F.struct("value", "kind")).alias("x")).join(taken, ["pool", "surrogate"], "left_anti")
        won = keeps.select("pool", F.col("x")["kind"].alias("kind"), F.col("x")["value"].alias("value"), "surrogate")
        done = materialize(won if done is None else done.unionByName(won), "surrogates")
        lost = drawn.join(done.select("kind", "value"), ["kind", "value"], "left_anti").withColumn("attempt", F.col("attempt") + 1)
        left = materialize(lost.drop("surrogate"), "redraw")
        if left.isEmpty():
            return done.select("kind", "value", "surrogate")
    raise RuntimeError(f"a format has too few members for its entities: {[r['kind'] for r in left.select('kind').distinct().limit(20).collect()]}")


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, entities of the text column replaced; adds ``entities`` (count, 0 for none or null).

    Null and empty texts stay as they are, as do texts without an entity, which are never shuffled. Repeated rows stay repeated
    and equal. An empty table gives no rows. Work columns avoid the caller's names; an input column called ``entities`` is replaced.
    """
    taken = docs.columns
    found, sig, joined = fresh("_found", taken), fresh("_sig", taken), fresh("_new", taken)
    docs = docs.drop("entities")
    has = _has_entity(F.col(text))
    plain = docs.where(~has).withColumn("entities", F.lit(0))
    both = let(
        F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)),
        lambda m: F.struct(m.alias("found"), F.md5(F.concat_ws("\x1f", m).cast("binary")).alias("sig"), F.size(m).alias("n")),
    )
    held = docs.where(has).withColumn(found, both)

    # one row for each distinct sequence of matches: copies of a document cost nothing here
    seqs = materialize(held.select(F.col(found)["sig"].alias("sig"), F.col(found)["found"].alias("found")).groupBy("sig").agg(F.first("found").alias("found")), "sequences")
    spots = seqs.select("sig", F.posexplode("found").alias("pos", "match"))
    matches = materialize(spots.groupBy("match").agg(F.count(F.lit(1)).alias("n")).select("match", units(F.col("match")).alias("units")), "matches")
    parts = matches.select("match", F.posexplode("units").alias("i", "u")).select("match", "i", "u.kind", "u.value", _pool(F.col("u.kind")).alias("pool"))
    # a first name has the gender that all its titles agree on
    man, woman = F.bool_or(F.col("kind") == "first_m"), F.bool_or(F.col("kind") == "first_f")
    gender = F.when(man & ~woman, F.lit("first_m")).when(woman & ~man, F.lit("first_f")).otherwise(F.lit("first_u"))
    host = F.when(F.col("pool") == "email", F.lower(F.substring_index("value", "@", -1)))
    entities = parts.groupBy("pool", "value").agg(gender.alias("gender")).select("pool", "value", F.when(F.col("pool") == "first", F.col("gender")).otherwise(F.col("pool")).alias("kind"), host.alias("domain"))
    entities = materialize(entities, "entities")
    domains = entities.where("domain is not null").select(F.lit("domain").alias("kind"), F.col("domain").alias("value")).distinct()
    domains = draw_surrogates(materialize(domains, "domains"), key).select(F.col("value").alias("domain"), F.col("surrogate").alias("host"))
    made = draw_surrogates(materialize(entities.join(domains, "domain", "left").select("kind", "value", "host"), "hosted"), key)
    made = made.select(_pool(F.col("kind")).alias("pool"), "value", "surrogate")
    titled = rf"^((?:{_TITLES})\.? )"
    title, name = F.regexp_extract(F.col("match"), titled, 1), F.regexp_replace(F.col("match"), titled, "")
    label = F.regexp_extract(F.col("match"), rf"^({_LABEL})", 1)
    lead = F.regexp_extract(F.col("match"), rf"^({_LEAD})", 1)
    whole = parts.join(made, ["pool", "value"]).groupBy("match").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "surrogate"))), lambda x: x["surrogate"]), " ").alias("s"),
        F.max("pool").alias("pool"), F.count(F.lit(1)).alias("parts"),
    )  # two parts at most
    full = F.when(F.col("parts") == 2, F.struct(name.alias("old"), F.col("s").alias("new")))
    before = F.when(F.col("pool") == "secret", label).when(F.col("pool") == "email", lead).when(F.col("pool").isin("first", "last"), title).otherwise("")
    whole = materialize(whole.select("match", F.concat(before, "s").alias("s"), full.alias("full")), "replacements")
    new_names = fresh("_names", taken)
    lists = spots.join(whole, "match").groupBy("sig").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias(joined), F.collect_set("full").alias(new_names)
    )
    held = held.withColumns({sig: F.col(found)["sig"], "entities": F.col(found)["n"]}).drop(found).join(lists.withColumnRenamed("sig", sig), sig)
    # full names also go where they stand without a title; gaps hold no other entity
    alone = lambda n: F.concat(F.lit(r"(?<!\p{L})"), n["old"], F.lit(r"(?!\p{L})"))
    names = F.col(new_names)
    renamed = lambda g: F.aggregate(names, g, lambda t, n: F.regexp_replace(t, alone(n), n["new"]))
    again = lambda g: F.aggregate(names, F.lit(0), lambda k, n: k + F.regexp_count(g, alone(n)))
    gaps = F.split(F.col(text), PATTERN, -1)
    with_names = F.size(names) > 0
    repeats = F.when(with_names, F.aggregate(gaps, F.lit(0), lambda k, g: k + again(g))).otherwise(0)
    new = F.array_join(F.zip_with(F.when(with_names, F.transform(gaps, renamed)).otherwise(gaps), F.array_append(F.col(joined), F.lit("")), lambda g, s: F.concat(g, s)), "")
    held = held.withColumns({text: new, "entities": F.col("entities") + repeats}).drop(sig, joined, new_names)
    return plain.unionByName(held.select(plain.columns))
