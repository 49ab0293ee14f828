"""Surrogates for personal data, in built-in functions only.

Entities are found by rules: addresses, numbers, and the names behind a title, of any number of parts, with initials, small
words as in "von Braun", or a line end behind the title.  A name's parts are then looked for in the whole document, with or
without title, so that every mention is replaced; initials and small words stay.  An entity is keyed in its plain form
(phone, card and bank numbers without separators, an American number without its +1, e-mail addresses and names in lower
case, a Russian family name in its masculine nominative), gets one surrogate of the same type wherever it stands
(coreference), and the surrogate takes the format of each mention: separators, capitals, the ending by gender and case.
Digits become digits and letters letters; the country code of a phone number and of a bank account is kept, the latter
gets right check digits; a valid card number becomes a valid one; an e-mail address gets a reserved example domain; an
address of version 6 one of the documentation's; a given name becomes one of the same gender and script, the gender by the
title or, behind one that tells none, by its ending.  Rounds over the table of distinct entities give those whose surrogate is
already in use, or is itself an entity of the text, another one, until all are distinct.

A name without any title in its document is not found, nor is a Russian given name in another case than the one behind the
title; a given name has a surrogate for each gender that titles give it.  The key is the caller's secret: without one
``replace`` raises.

Nulls and odd cases: a null or empty text has no entities and stays as it is; a null doc_id is kept; repeated rows get
equal results; texts are searched whole; an empty table gives an empty result; further input columns are kept by
``replace`` whatever their names, but for one named pii_spans, which is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import table, written
from locusframe.llm.secrets import Rule, matches, pattern_spans, told

#: Key of the registered query alone; who publishes its result must take a secret of their own.
QUERY_KEY = "opened-by-design"
ROUNDS = 25
# Titles, and the gender that they tell of the name behind them; those in small letters need their point.
TITLES = {
    "m": r"(?:Mr|MR|Mister|Herrn?|Monsieur|Señor|Signor|[Гг]осподин(?:а|у|ом|е)?)\.?|mr\.",
    "f": r"(?:Mrs|MRS|Ms|MS|Miss|Frau|Madame|Señora|Signora|[Гг]оспож(?:а|и|е|у|ой))\.?|(?:mrs|ms)\.",
    "x": r"(?:Dr|DR|Prof|PROF|Doctor|Professor)\.?|(?:dr|prof)\.",
}
ANY_TITLE = "(?:" + "|".join(TITLES.values()) + r")(?!\p{L})"
# Small words within names.
PARTICLE = r"(?:von|van|vom|zu|zum|zur|de|der|den|del|della|di|da|do|dos|das|du|la|le|ter|ten|af|av|bin|ibn|al|el)(?!\p{L})"
#: A part of a name: letters, with apostrophes and hyphens between them, but no possessive ending.
NAME = r"\p{Lu}(?:[\p{L}\p{M}]|['’-](?=\p{L})(?![sS](?![\p{L}\p{M}'’-])))+"
GAP = "[ \u00a0]"
#: Between a title and its name a line may end; between the parts of a name it may not.
TITLE_GAP = "(?:[ \u00a0]|\r?\n)"
SMALL = rf"(?:\p{{Lu}}\.{GAP}?|\p{{Lu}}{GAP}|{PARTICLE}{GAP})*"
WHOLE_NAME = rf"{SMALL}(?!{ANY_TITLE}){NAME}(?:{GAP}{SMALL}(?!{ANY_TITLE}){NAME})*"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
RULES = (
    Rule("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    Rule("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    Rule("phone", r"(?<![A-Za-z0-9])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"),
    Rule("phone", r"(?<![A-Za-z0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"),
    Rule("phone", r"(?<![A-Za-z0-9+])(?<![0-9] )[0-9]{3} [0-9]{3} [0-9]{4}(?! ?[0-9])"),
    Rule("card", r"(?<![A-Za-z0-9])(?:[0-9]{4}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![A-Za-z0-9])"),
    Rule("ssn", r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"),
    Rule("ip", rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"),
    Rule("ip6", r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![0-9A-Za-z:])"),
    # the title is matched too and cut off afterwards: to look behind at every word for it costs several times as much
    *[Rule(f"person_{g}", rf"\b(?:{titles}){TITLE_GAP}{WHOLE_NAME}") for g, titles in TITLES.items()],
)
#: What a text must hold for a rule of the kind to match: a plain search before the dear one.
GUARDS = {
    "email": "@", "iban": "[A-Z]{2}[0-9]{2}", "phone": "[+][0-9]|[0-9][.-][0-9]{4}|[0-9] [0-9]{3} [0-9]{4}", "card": "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}", "ssn": "[0-9]-[0-9]{2}-[0-9]",
    "ip": r"[0-9]\.[0-9]{1,3}\.[0-9]", "ip6": ":[0-9A-Fa-f]{1,4}:|::[0-9A-Fa-f]", **{f"person_{g}": rf"\b(?:{titles}){TITLE_GAP}(?:\p{{Lu}}|{PARTICLE})" for g, titles in TITLES.items()},
}
# Calling codes of one and two digits; all others have three.
CALLING = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
# What surrogate names are put together from.
STEMS = {
    "latin": "Al Ber Cor Dan El Fer Gal Hen Is Jor Kar Lor Mar Nor Ol Per Ros Sal Tor Val Wil Yor Zel Bel".split(),
    "cyrillic": "Ал Бор Вал Ган Дар Ел Жан Зар Ил Кар Лар Мир Нор Ол Пав Рос Сал Тар Ур Фел".split(),
}
ENDINGS = {
    ("given_m", "latin"): "in o us ert an on ard as".split(), ("given_f", "latin"): "ia ena ine ela a isa ette ora".split(), ("given_x", "latin"): "el is en ary".split(), ("family", "latin"): "son man ley berg well ford ton rick".split(),
    ("given_m", "cyrillic"): "ан ий он ей".split(), ("given_f", "cyrillic"): "ия ена ина а".split(), ("given_x", "cyrillic"): "и эль".split(), ("family", "cyrillic"): "ов ев ин".split(),
}
SPANS = "cast(array() as array<struct<start:int, no:int, end:int, kind:string>>)"


# The endings of Russian family names by case, and those of a name in -ов for one in -ый.
CASES = "(?:а|у|ым|ом|е|ой|ы|ых|ыми)"
ADJECTIVES = {"ая": "а", "ую": "у", "ого": "а", "ому": "у", "ым": "ым", "им": "ым", "ом": "е", "ой": ""}
ADJECTIVE = "(?:ая|ую|ого|ому|ым|им|ом|ой|ый|ий)"


def _cut(text: Column, span: Column) -> Column:
    return F.substr(text, span["start"] + 1, span["end"] - span["start"])


def name_parts(text: Column, spans: Column) -> Column:
    """Array of (plain, kind, part): the parts of the names behind a title.  The last one is the family name."""
    people = F.filter(spans, lambda s: s["kind"].startswith("person_"))

    def parts(s: Column) -> Column:
        words = F.filter(F.split(_cut(text, s), rf"{GAP}|(?<=\p{{Lu}}\.)"), lambda w: w.rlike(f"^{NAME}$"))  # no initials, no particles
        title = F.right(s["kind"], F.lit(1))
        # a title that tells no gender leaves it to the given name's ending
        told_ = lambda x: F.when((title == "x") & F.lower(x).rlike("(?:[aа]|ия|elle|ette|ine)$"), "f").otherwise(title)
        return F.transform(words, lambda x, i: F.struct(F.when(i == F.size(words) - 1, plain(F.lit("family"), x)).otherwise(F.lower(x)).alias("plain"), F.when(i == F.size(words) - 1, F.lit("family")).otherwise(F.concat(F.lit("given_"), told_(x))).alias("kind"), x.alias("part")))

    return F.array_distinct(F.flatten(F.transform(people, parts)))


def _in_order(spans: Column) -> Column:
    """None of them overlapping: the earlier start, then the earlier rule, wins."""

    def step(acc: Column, s: Column) -> Column:
        fits = s["start"] >= acc["at"]
        return F.struct(F.when(fits, s["end"]).otherwise(acc["at"]).alias("at"), F.when(fits, F.array_append(acc["kept"], s)).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("at"), F.expr(SPANS).alias("kept")), step, lambda acc: acc["kept"])


def _spelled(p: Column, capitals: bool) -> Column:
    """An expression for a part as it may stand elsewhere: a Russian family name in any case and gender."""
    part = F.upper(p["part"]) if capitals else p["part"]
    up = (lambda t: t.upper()) if capitals else (lambda t: t)
    possessive, adjective = f"(?<={up('ов|ев|ёв|ин|ын')}){up(CASES)}?$", rf"(?<=\p{{IsCyrillic}}{{3}}){up(ADJECTIVE)}$"
    family = p["kind"] == "family"
    named = F.when(family & part.rlike(possessive), F.concat(F.regexp_replace(part, f"(?<={up('ов|ев|ёв|ин|ын')}){up(CASES)}$", ""), F.lit(f"{up(CASES)}?")))
    return named.when(family & part.rlike(adjective), F.concat(F.regexp_replace(part, adjective, ""), F.lit(up(ADJECTIVE)))).otherwise(part)


def with_spans(docs: DataFrame) -> DataFrame:
    """docs: text and more.  Adds names, the parts of names, and pii_spans, an array of (start, no, end, kind)."""
    text = F.col("text")

    def found(r: Rule, i: int) -> Column:
        spans = matches(text, r, i)
        if not r.kind.startswith("person_"):
            return spans
        title = rf"^(?:{TITLES[r.kind[-1]]}){TITLE_GAP}"
        return F.transform(spans, lambda s: s.withField("start", s["start"] + F.length(F.regexp_extract(_cut(text, s), title, 0))))

    rules = F.concat(*[F.coalesce(F.when(text.rlike(GUARDS[r.kind]), found(r, i)), F.expr(SPANS)) for i, r in enumerate(RULES)])
    docs = docs.withColumn("pii_spans", rules).withColumn("names", name_parts(text, F.col("pii_spans")))
    words = F.array_distinct(F.concat(F.transform("names", lambda p: _spelled(p, False)), F.transform("names", lambda p: _spelled(p, True))))
    mention = F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    mentions = F.coalesce(F.when(F.size("names") > 0, pattern_spans(text, mention, len(RULES), "name")), F.expr(SPANS))
    return docs.withColumn("pii_spans", _in_order(F.concat(F.filter("pii_spans", lambda s: ~s["kind"].startswith("person_")), mentions)))


def plain(kind: Column, entity: Column) -> Column:
    """What equal entities have in common."""
    digits = F.regexp_replace(F.regexp_replace(entity, "[^0-9+]", ""), r"^\+1(?=[0-9]{10}$)", "")  # one number with and without its country
    numbers = F.when(kind == "phone", digits).when(kind.isin("iban", "card", "ssn"), F.regexp_replace(entity, "[^A-Z0-9]", ""))
    family = F.regexp_replace(F.lower(entity), f"(?<=ов|ев|ёв|ин|ын){CASES}$", "")
    family = F.regexp_replace(family, "(?<=ск|цк)(?:ая|ую|ого|ому|им|ом|ой)$", "ий")
    family = F.regexp_replace(family, r"(?<=\p{IsCyrillic}{3})(?:ая|ую|ого|ому|ой)$", "ый")
    return F.coalesce(numbers, F.when(kind.isin("email", "ip6"), F.lower(entity)).when(kind == "family", family).when(kind.startswith("given"), F.lower(entity)), entity)


def shaped(kind: Column, entity: Column, made: Column) -> Column:
    """The surrogate in the format of one mention."""
    signs = F.regexp_replace(made, "[^A-Z0-9]", "")
    signs = F.when((kind == "phone") & entity.startswith("+1") & (F.length(signs) == 10), F.concat(F.lit("1"), signs)).otherwise(signs)

    def one(i: Column) -> Column:
        c = F.substr(entity, i, F.lit(1))
        return F.when(c.rlike("[A-Z0-9]"), F.substr(signs, F.length(F.regexp_replace(F.substr(entity, F.lit(1), i), "[^A-Z0-9]", "")), F.lit(1))).otherwise(c)

    number = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(entity), F.lit(1))), one), "")
    low = F.lower(entity)
    ending = F.when(low.rlike(f"(?:ов|ев|ёв|ин|ын){CASES}$"), F.regexp_extract(low, f"(?:ов|ев|ёв|ин|ын)({CASES})$", 1))
    ending = ending.when(low.rlike("(?:ск|цк)ой$"), "ой")
    for of, to in ADJECTIVES.items():
        ending = ending.when(low.rlike(rf"\p{{IsCyrillic}}{{3}}{of}$"), to)
    word = F.concat(made, F.when((kind == "family") & made.rlike(r"\p{IsCyrillic}"), F.coalesce(ending, F.lit(""))).otherwise(""))
    word = F.when((entity == F.upper(entity)) & entity.rlike(r"\p{Lu}"), F.upper(word)).otherwise(word)
    return F.when(kind.isin("phone", "iban", "card", "ssn"), number).when(kind.isin("ip", "ip6"), made).otherwise(word)


def _byte(stream: Column, i: Column) -> Column:
    """The i-th of the 64 bytes that a hexadecimal digest holds, again from the start after the last."""
    return F.conv(F.substr(stream, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letters(entity: Column, stream: Column) -> Column:
    """Digits become digits, letters letters of the same case, the rest stays."""

    def one(i: Column) -> Column:
        c, b = F.substr(entity, i, F.lit(1)), _byte(stream, i)
        swapped = F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), F.char(b % 26 + 97)).when(c.rlike("[A-Z]"), F.char(b % 26 + 65))
        return F.coalesce(swapped, c)

    return F.when(F.length(entity) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(entity)), one), "")).otherwise("")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _mod97(signs: Column) -> Column:
    """The number that digits and letters (10 to 35) spell, modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(signs, ""), F.lit(0), lambda acc, c: (acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _pick(words: list[str], b: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), b % len(words) + 1)


def surrogate(kind: Column, entity: Column, tries: Column, key: str) -> Column:
    """The surrogate of a plain ``entity`` at its ``tries``-th try."""
    stream = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity, tries.cast("string")), 512)
    swapped = _letters(entity, stream)
    domain = F.regexp_extract(entity, "@(.*)$", 1)
    own = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 512)
    label = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.char(_byte(own, i) % 26 + 97)), "")
    tail = F.when(domain.rlike("\\.(com|org|net)$"), F.regexp_extract(domain, "([a-z]+)$", 1)).otherwise("com")
    email = F.concat(_letters(F.regexp_extract(entity, "^([^@]*)@", 1), stream), F.lit("@"), label, F.lit(".example."), tail)
    code = F.regexp_extract(entity, CALLING, 0)
    phone = F.concat(code, F.substr(swapped, F.length(code) + 1))
    country, account = F.substring(entity, 1, 2), F.substr(swapped, F.lit(5))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    body, digits = F.substr(swapped, F.lit(1), F.length(swapped) - 1), F.sequence(F.lit(0), F.lit(9))
    valid = F.filter(digits, lambda d: _luhn(F.concat(body, d.cast("string"))))
    card = F.when(_luhn(entity), F.concat(body, valid[0].cast("string"))).otherwise(swapped)
    ip = F.concat_ws(".", *[(_byte(stream, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
    ip6 = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[F.substr(stream, F.lit(4 * i + 1), F.lit(4)) for i in range(6)])
    out = F.when(kind == "ip6", ip6).when(kind == "email", email).when(kind == "iban", iban).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip).when(kind == "ssn", swapped)
    for (which, script), endings in ENDINGS.items():
        extra = _middle(stream, tries, STEMS[script])
        name = F.concat(_pick(STEMS[script], _byte(stream, F.lit(1))), F.lower(_pick(STEMS[script], _byte(stream, F.lit(2)))) if which == "family" else F.lit(""), extra, _pick(endings, _byte(stream, F.lit(3))))
        fits = entity.rlike(r"\p{IsCyrillic}") if script == "cyrillic" else ~entity.rlike(r"\p{IsCyrillic}")
        out = out.when((kind == which) & fits, name)
    return out


def _middle(stream: Column, tries: Column, stems: list[str]) -> Column:
    """One more syllable for each try."""
    more = F.transform(F.sequence(F.lit(1), F.greatest(tries, F.lit(1))), lambda i: F.lower(_pick(stems, _byte(stream, i + 8))))
    return F.when(tries > 0, F.array_join(more, "")).otherwise("")


def surrogates(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """entities: distinct (kind, entity), plain.  (kind, entity, surrogate) with distinct surrogates of a kind, none of them an
    entity of that kind."""
    made = written(entities.withColumn("tries", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.col("tries"), key)), "surrogates")
    for _ in range(rounds):
        shared = made.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("entity").alias("first")).filter("n > 1")
        again = made.join(shared, ["kind", "surrogate"]).filter("entity <> first").select("kind", "entity")
        again = again.union(made.alias("a").join(entities.alias("b"), (F.col("a.kind") == F.col("b.kind")) & (F.lower("a.surrogate") == F.lower("b.entity")), "left_semi").select("kind", "entity"))
        again = written(again.distinct().withColumn("again", F.lit(1)), "again")
        if again.isEmpty():
            return made.drop("tries")
        raised = made.join(again, ["kind", "entity"], "left").select("kind", "entity", (F.col("tries") + F.coalesce("again", F.lit(0))).alias("tries"))
        made = written(raised.withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.col("tries"), key)), "surrogates")
    raise ValueError(f"surrogates still collide after {rounds} rounds")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """docs: at least doc_id and text.  Adds pii_spans (start, no, end, kind; of the old text) and replaces the text.

    Only documents with an entity are shuffled.  Their key is a hash of the row: rows that share one hold the same text
    or are told apart by it again, so equal rows share one list of surrogates.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    columns = [c for c in docs.columns if c != "pii_spans"]
    names = {c: c if c in ("doc_id", "text") else f"extra{i}__" for i, c in enumerate(columns)}
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    any_rule = F.coalesce(reduce(lambda a, b: a | b, [F.col("text").rlike(GUARDS[r.kind]) & F.col("text").rlike(r.pattern) for r in RULES]), F.lit(False))
    marked = docs.withColumn("_any", any_rule)
    hit = with_spans(marked.filter("_any").drop("_any")).withColumn("_key", F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), "text"), 256))
    hit = written(hit, "with-entities")
    entity = hit.select("_key", F.posexplode("pii_spans").alias("at", "span"), "text", "names")
    entity = entity.select("_key", "at", F.col("span.kind").alias("kind"), _cut(F.col("text"), F.col("span")).alias("entity"), "names")
    # a part that is a family name somewhere in the document is one everywhere in it
    own = lambda p: F.when(p["kind"] == "family", plain(F.lit("family"), F.col("entity"))).otherwise(F.lower("entity"))
    role = F.array_min(F.transform(F.filter("names", lambda p: p["plain"] == own(p)), lambda p: p["kind"]))
    entity = entity.withColumn("kind", F.when(F.col("kind") == "name", role).otherwise(F.col("kind"))).drop("names").withColumn("plain", plain(F.col("kind"), F.col("entity")))
    table_ = surrogates(written(entity.select("kind", F.col("plain").alias("entity")).distinct(), "entities"), key)
    chosen = entity.join(table_.withColumnRenamed("entity", "plain"), ["kind", "plain"])
    chosen = chosen.select("_key", "at", shaped(F.col("kind"), F.col("entity"), F.col("surrogate")).alias("surrogate"))
    chosen = chosen.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("at", "surrogate")))["surrogate"].alias("_new"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, x["s"]["start"] - acc["at"]), x["new"]).alias("out"), x["s"]["end"].alias("at"))

    pairs = F.arrays_zip(F.col("pii_spans").alias("s"), F.col("_new").alias("new"))
    text = F.aggregate(pairs, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1)))
    replaced = hit.join(chosen, "_key", "left").withColumn("text", F.coalesce(text, "text")).select(*names.values(), "pii_spans")
    rest = marked.filter(~F.col("_any")).select(*names.values(), F.expr(SPANS).alias("pii_spans"))
    return rest.unionByName(replaced).select(*[F.col(n).alias(c) for c, n in names.items()], "pii_spans")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with surrogates, how many entities it held, and where (kind:start:end of the old text)."""
    done = replace(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    return done.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_entities"), told(F.col("pii_spans")).alias("entities"))
