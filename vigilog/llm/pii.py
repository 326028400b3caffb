"""PII surrogates; DataFrame functions only.

Detected entities (e-mail, phone, card of 15 or 16 digits, IPv4 and IPv6 address,
social security number, IBAN, titled names of up to three parts) are replaced by keyed surrogates of the same type and
format: digits stay digits, letters keep their case, separators stay, cards keep
issuer digit and Luhn remainder, IBANs their check digits, phones their country code, names the
gender of their titles and their script.  A surrogate is a function of the key and the entity's
normal form, so all mentions agree across texts and formats (a phone with or
without separators or country code 1, a first name under any title); first and last
names are mapped apart, so a short mention follows the long one.  All distinct
entities are then checked against each other and against the originals, and
those that clash move on to their next surrogate until none does; names are drawn
from some hundred thousand, so few do.  Names without a title, national phone
numbers without separators and other identifiers aren't detected.

Null and empty texts stay as they are; repeated rows and null ids keep a row
each; other columns are kept, but an input column n_entities is replaced by the
operator's own.  A text is searched by the full pattern only where a cheap
necessary condition holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialise

# Titles by gender.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Г-жа", "Госпожа"],
    "m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Г-н", "Господин"],
    "n": ["Dr", "Prof"],
}
# Syllables of surrogate names by script: first, inner and last ones by gender, and those that end family names.
SYLLABLES = {
    "latin": {
        "start": ["Al", "Be", "Cla", "Da", "El", "Fe", "Gre", "Ha", "Ir", "Jo", "Ka", "Le", "Mar", "Na", "Ol", "Pa", "Qui", "Ro", "Sa", "Te", "Ul", "Va", "Wi", "Ze"],
        "inner": ["ba", "co", "di", "fe", "ga", "lo", "mi", "na", "ne", "ni", "po", "ra", "re", "ri", "sa", "se", "ta", "te", "ti", "to", "va", "ve", "vi", "zo"],
        "f": ["la", "lina", "nne", "tta", "ria", "sa", "ya", "da"],
        "m": ["l", "no", "rd", "s", "to", "ck", "n", "ro"],
        "n": ["ly", "ry", "sh", "x", "ris", "der", "lin", "ren"],
        "last": ["mann", "sen", "ler", "dez", "well", "gard", "ton", "ski", "berg", "holm", "vale", "ric"],
    },
    "cyrillic": {
        "start": ["Ан", "Бо", "Ве", "Га", "Да", "Еле", "За", "Ива", "Ка", "Ла", "Ми", "Ни", "Оле", "Па", "Ро", "Са", "Та", "Фе", "Ха", "Ю"],
        "inner": ["ба", "ве", "ги", "до", "жи", "ка", "ле", "ми", "на", "не", "по", "ра", "ри", "са", "се", "та", "ти", "фо"],
        "f": ["на", "ра", "ла", "са", "та", "рия"],
        "m": ["р", "н", "л", "с", "й", "слав"],
        "n": ["ша", "ля", "ня", "ка", "ся", "ня"],
        "last": ["енко", "чук", "дарь", "ник", "вич", "ляк", "бой", "рук"],
    },
}
_TITLE = "|".join(t for group in TITLES.values() for t in sorted(group, key=len, reverse=True))
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\w.-])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|\d{4}([ -]?)\d{6}\2\d{5})(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "ipv6": r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


# The telephone country codes of one and two digits; all others have three.
COUNTRIES = r"1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"


def kind_of(surface: Column) -> Column:
    whole = lambda k: surface.rlike(f"^(?:{PATTERNS[k]})$")
    return reduce(lambda rest, k: F.when(whole(k), F.lit(k)).otherwise(rest), reversed(PATTERNS), F.lit("name"))


def _byte(stream: Column, i) -> Column:
    return F.conv(F.substring(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(base: int, value: Column) -> Column:
    return F.char(F.lit(base) + value % 26)


def substitute(text: Column, stream: Column, keep: Column) -> Column:
    """Each digit and ASCII letter past the first ``keep`` characters drawn anew by the keyed stream, class by class."""

    def one(ch: Column, i: Column) -> Column:
        b = _byte(stream, i)
        drawn = F.when(ch.rlike("^[1-9]$") & (i == keep), (b % 9 + 1).cast("string")).when(ch.rlike("^[0-9]$"), (b % 10).cast("string"))
        drawn = drawn.when(ch.rlike("^[a-z]$"), _letter(97, b)).when(ch.rlike("^[A-Z]$"), _letter(65, b)).otherwise(ch)
        return F.when(i < keep, ch).otherwise(drawn)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn(digits: Column) -> Column:
    """Luhn sum modulo 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def mod97(text: Column) -> Column:
    """The number a text stands for (letters as 10 to 35) modulo 97."""

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(norm: Column, stream: Column) -> Column:
    """Country kept, the account drawn anew, check digits such that the remainder modulo 97 (1 if valid) stays."""
    country, account = F.substring(norm, 1, 2), F.substring(norm, F.lit(5), F.lit(40))
    drawn = substitute(account, stream, F.lit(0))
    old = mod97(F.concat(account, country, F.substring(norm, 3, 2)))
    check = F.pmod(old - mod97(F.concat(drawn, country, F.lit("00"))), F.lit(97))
    return F.concat(country, F.lpad(F.when(check < 2, check + 97).otherwise(check).cast("string"), 2, "0"), drawn)


def _name(parts: dict[str, list[str]], last: str, stream: Column, rounds: Column) -> Column:
    """A name of four syllables, one of some hundred thousand; every third round adds a syllable."""

    def pick(names: list[str], i) -> Column:
        return F.element_at(F.array(*map(F.lit, names)), F.pmod(_byte(stream, i * 2) * 256 + _byte(stream, i * 2 + 1), F.lit(len(names))) + 1)

    inner = F.transform(F.sequence(F.lit(1), F.lit(2) + F.floor(rounds / 3).cast("int")), lambda i: pick(parts["inner"], i + 1))
    return F.concat(pick(parts["start"], F.lit(0)), F.array_join(inner, ""), pick(parts[last], F.lit(1)))


def surrogate(kind: Column, norm: Column, rounds: Column, key: str) -> Column:
    """The surrogate's normal form for an entity's normal form, in its ``rounds``-th try."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, rounds.cast("string")), 512)
    local = F.substring_index(norm, "@", 1)
    mail = F.concat(substitute(local, stream, F.lit(0)), F.when(rounds > 2, F.substring(stream, F.lit(1), rounds.cast("int"))).otherwise(F.lit("")), F.lit("@"), substitute(F.substring_index(F.substring_index(norm, "@", -1), ".", 1), F.reverse(stream), F.lit(0)), F.lit(".example."), F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), _byte(stream, F.lit(63)) % 3 + 1))
    head = substitute(F.substring(norm, F.lit(1), F.char_length(norm) - 1), stream, F.lit(1))
    card = F.concat(head, F.pmod(luhn(norm) - luhn(F.concat(head, F.lit("0"))), F.lit(10)).cast("string"))
    hexes = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex(_byte(stream, i) % 15 + 1)))), "")
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(stream, i) % 254 + 1).cast("string")), ".")
    phone = F.concat(F.substring_index(norm, "|", 1), F.lit("|"), substitute(F.substring_index(norm, "|", -1), stream, F.lit(0)))
    out = F.when(kind == "email", mail).when(kind == "card", card).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "ipv6", hexes)
    out = out.when(kind == "iban", _iban(norm, stream)).when(kind == "ssn", substitute(norm, stream, F.lit(0)))
    for script, parts in SYLLABLES.items():
        for part in ("f", "m", "n", "last"):
            # the original's normal form is in lower case, and so are all comparisons
            out = out.when(kind == f"name:{script}:{part}", F.lower(_name(parts, part, stream, rounds)))
    return out


def _forms(surface: Column) -> Column:
    """array of (kind, norm): what of a surface is mapped; a name is two entities."""
    kind = kind_of(surface)
    digits = F.regexp_replace(surface, r"\D", "")
    # with or without separators; numbers without a country code are in the form of country code 1
    country = F.when(surface.startswith("+"), F.regexp_extract(digits, f"^(?:{COUNTRIES})", 0)).otherwise("")
    phone = F.concat(F.when(country == "", "1").otherwise(country), F.lit("|"), F.substring(digits, F.char_length(country) + 1, F.lit(40)))
    norm = F.when(kind == "email", F.lower(surface)).when(kind == "phone", phone).when(kind == "iban", F.replace(surface, F.lit(" "), F.lit(""))).when(kind == "ip", surface).when(kind == "ipv6", F.lower(surface)).otherwise(digits)
    title = F.regexp_extract(surface, rf"^({_TITLE})\.? ", 1)
    gender = reduce(lambda rest, g: F.when(title.isin(TITLES[g]), F.lit(g)).otherwise(rest), TITLES, F.lit("n"))
    names = F.split(F.lower(F.regexp_replace(surface, rf"^(?:{_TITLE})\.? ", "")), " ")
    script = lambda n: F.when(n.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    part = lambda n, i: F.struct(F.concat_ws(":", F.lit("name"), script(n), F.when(i == F.size(names) - 1, F.lit("last")).otherwise(gender)).alias("kind"), n.alias("norm"))
    return F.when(kind == "name", F.transform(names, part)).otherwise(F.array(F.struct(kind.alias("kind"), norm.alias("norm"))))


def _render(surface: Column, subs: Column) -> Column:
    """The surface with its entity's surrogate: digits, or digits and letters, filled in place by place."""
    kind = kind_of(surface)
    first = F.get(subs, F.lit(0))

    def fill(source: Column, cls: str) -> Column:
        place = lambda i: F.char_length(F.regexp_replace(F.substring(surface, F.lit(1), i), f"[^{cls}]", ""))
        return F.array_join(F.transform(F.split(surface, ""), lambda c, i: F.when(c.rlike(f"^[{cls}]$"), F.substring(source, place(i) + 1, F.lit(1))).otherwise(c)), "")

    title = F.regexp_extract(surface, rf"^(?:{_TITLE})\.? ", 0)
    return F.when(kind == "name", F.concat(title, F.initcap(F.array_join(subs, " ")))).when(kind.isin("email", "ip"), first).when(kind == "ipv6", F.when(surface == F.upper(surface), F.upper(first)).otherwise(first)).when(kind == "iban", fill(first, "A-Z0-9")).otherwise(fill(F.when((kind == "phone") & ~surface.startswith("+"), F.substring_index(first, "|", -1)).otherwise(F.replace(first, F.lit("|"), F.lit(""))), "0-9"))


def assign(entities: DataFrame, key: str, max_rounds: int = 30) -> DataFrame:
    """kind, norm, sub for distinct (kind, norm): surrogates that differ from each other and from every original."""
    current = materialise(entities.select("kind", "norm").distinct().withColumn("rounds", F.lit(0)), "entities")
    for _ in range(max_rounds):
        tried = materialise(current.withColumn("sub", surrogate(F.col("kind"), F.col("norm"), F.col("rounds"), key)), "surrogates")
        originals = current.select("kind", F.col("norm").alias("sub"), F.lit(True).alias("real"))
        place = F.row_number().over(Window.partitionBy("kind", "sub").orderBy("rounds", "norm"))
        marked = tried.join(originals, ["kind", "sub"], "left").withColumn("again", F.col("real").isNotNull() | (place > 1))
        marked = materialise(marked.select("kind", "norm", "rounds", "sub", "again"), "checked")
        if not marked.filter("again").limit(1).count():
            return marked.select("kind", "norm", "sub")
        current = marked.select("kind", "norm", (F.col("rounds") + F.col("again").cast("int")).alias("rounds"))
    raise ValueError("surrogates still clash: enlarge the pools or max_rounds")


def maybe(text: Column) -> Column:
    """False only for texts without any entity: a cheap necessary condition (an at sign, a digit run with its separators, or a title)."""
    titled = reduce(lambda a, b: a | b, [text.contains(t) for group in TITLES.values() for t in group])
    return F.coalesce(text.contains("@") | text.contains("::") | text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]") | text.rlike(r"[0-9][0-9A-Z .()-]{6}") | (titled & text.rlike(rf"(?:{_TITLE})\.? \p{{Lu}}")), F.lit(False))


def replace_entities(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every entity of ``text_col`` replaced, and n_entities (long)."""
    ents, mapped, row, between = (free_name(df, x) for x in ("_ents", "_map", "_row", "_between"))
    kept = [c for c in df.columns if c != "n_entities"]
    base = df.select(*[F.col(f"`{c}`") for c in kept])
    some = materialise(base.filter(maybe(F.col(text_col))).withColumn(ents, F.regexp_extract_all(text_col, F.lit(ANY), F.lit(0))).withColumn(between, F.split(text_col, ANY, -1)).withColumn(row, F.monotonically_increasing_id()), "matched")
    surfaces = some.filter(F.size(ents) > 0).select(F.col(row).alias("row"), F.explode(F.array_distinct(ents)).alias("surface"))
    parts = surfaces.select("surface").distinct().select("surface", F.posexplode(_forms(F.col("surface"))).alias("place", "form")).select("surface", "place", "form.kind", "form.norm")
    # a first name has the gender of its titles, whichever of them a mention has; of both, or none, it is neutral
    script = F.regexp_extract("kind", "^name:([a-z]+):[fmn]$", 1)
    seen = F.collect_set(F.when(F.col("kind").rlike(":[fm]$"), F.substring("kind", -1, 1))).over(Window.partitionBy(script, "norm"))
    one = F.when(F.size("seen") == 1, F.get("seen", F.lit(0))).otherwise("n")
    parts = parts.withColumn("seen", seen).withColumn("kind", F.when(script != "", F.concat_ws(":", F.lit("name"), script, one)).otherwise(F.col("kind"))).drop("seen")
    parts = materialise(parts, "forms")
    subs = parts.join(assign(parts, key), ["kind", "norm"]).groupBy("surface").agg(F.array_sort(F.collect_list(F.struct("place", "sub"))).alias("subs"))
    known = subs.select("surface", _render(F.col("surface"), F.transform("subs", lambda s: s["sub"])).alias("new"))
    maps = surfaces.join(known, "surface").groupBy(F.col("row").alias(row)).agg(F.map_from_entries(F.collect_list(F.struct("surface", "new"))).alias(mapped))
    joined = some.filter(F.size(ents) > 0).join(maps, row)
    filled = F.concat(F.array_join(F.flatten(F.transform(ents, lambda e, i: F.array(F.get(between, i), F.element_at(mapped, e)))), ""), F.element_at(between, -1))
    changed = joined.withColumn(text_col, filled).withColumn("n_entities", F.size(ents).cast("long"))
    none = F.lit(0).cast("long").alias("n_entities")
    same = base.filter(~maybe(F.col(text_col))).select("*", none).unionByName(some.filter(F.size(ents) == 0).select(*kept, none))
    return changed.select(*kept, "n_entities").unionByName(same)
