"""PII surrogates with DataFrame functions only.

Entities are found by one pattern.  Each distinct entity gets a keyed surrogate of its
own type: e-mail addresses, numbers, addresses and keys keep their format character by
character in the same script; names keep their title, the gender it tells and their
script.  Surrogates are checked against each other and against all entities found, and
drawn again until they are distinct, so that different entities stay different; one
entity has one surrogate wherever and however it is written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import forget, written

_LOCAL = r"[\p{L}\p{N}._%+\-]"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Titles by the gender they tell, n for none (fixed values).
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа", "Κυρία"], "n": ["Dr", "Prof"]}
_TITLE = "|".join(t for g in TITLES.values() for t in g)
#: Patterns in the order in which they are tried; each also tells the type of a match.
#: Only single characters repeat without a bound: Java's matcher recurses for each round of a group.
PATTERNS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@[\p{{L}}\p{{N}}\-][\p{{L}}\p{{N}}\-.]*\.\p{{L}}{{2,}}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?:sk|ghp|gho|xoxb|xoxp)[\-_][A-Za-z0-9_\-]{16,})(?![A-Za-z0-9])",
    "secret": r"(?<![0-9A-Za-z])(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[\-. ]\d{4}|\d{3}[\-.]\d{3}[\-.]\d{4})(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'’\-]+(?: \p{{Lu}}[\p{{L}}'’\-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What any match has; texts without it skip the large pattern.
_HINT = rf"[@\d]|AKIA|(?:sk|ghp|gho|xoxb|xoxp)[\-_]|{_TITLE}"

#: Letters that stand in for a letter of the same kind (fixed values).
_ALPHABETS = [
    (r"[0-9]", "0123456789"),
    (r"[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    (r"[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"[а-яё]", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"[А-ЯЁ]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"[α-ωά-ώ]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[Α-Ω]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{IsHan}", "安白陈丁方高何江林马宁钱任孙王徐杨张周朱"),
    (r"[\p{IsLatin}&&\p{Ll}]", "àâäçéèêëîïñôöùûü"),
    (r"[\p{IsLatin}&&\p{Lu}]", "ÀÂÄÇÉÈÊËÎÏÑÔÖÙÛÜ"),
]
#: Kinds of letters and numbers of all other scripts.
_KINDS = [r"\p{Lu}", r"\p{Ll}", r"\p{L}", r"\p{N}"]
#: Given names by script and gender, and syllables of surnames by script (fixed values).
_GIVEN = {
    "latin": {"m": ["Adrian", "Bruno", "Carl", "David", "Emil", "Felix", "Gregor", "Hugo", "Ivan", "Julian", "Leo", "Martin", "Oscar", "Paul", "Robert", "Simon"], "f": ["Alice", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria", "Nina", "Olivia", "Paula", "Sofia"], "n": ["Alex", "Chris", "Jo", "Kim", "Noel", "Robin", "Sascha", "Toni"]},
    "cyrillic": {"m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Игорь", "Кирилл", "Максим"], "f": ["Алла", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения", "Мария"], "n": ["Валя", "Женя", "Саша", "Шура"]},
    "greek": {"m": ["Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας"], "f": ["Άννα", "Ελένη", "Κατερίνα", "Μαρία"], "n": ["Άλεξ", "Κρις"]},
}
_SYLLABLES = {"latin": ["bar", "den", "fal", "gor", "hem", "kin", "lor", "man", "nel", "pet", "ros", "sen", "tal", "ver", "wil", "zan"], "cyrillic": ["бар", "ден", "вол", "гор", "зим", "кор", "лав", "мир", "нов", "пет", "рос", "сав", "тар", "чер", "шан", "юр"], "greek": ["βαρ", "γερ", "δημ", "ζαν", "θεο", "καλ", "λαμ", "μαν", "νικ", "παπ", "ρουσ", "σταμ", "τρικ", "φιλ", "χατζ", "ψαρ"]}


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _byte(digest: Column, i: Column | int) -> Column:
    """The i-th byte (from 0, modulo 64) of a hexadecimal 512-bit digest."""
    at = (F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(64)) * 2 + 1).cast("int")
    return F.conv(F.substring(digest, at, F.lit(2)), 16, 10).cast("int")


def _neighbour(c: Column, value: Column) -> Column:
    """Another letter or number of the kind of ``c`` from its sixteen code points, which are of one script; others are kept."""
    units = F.hex(F.encode(c, "UTF-16BE"))
    stem = F.substring(units, F.lit(1), F.length(units) - 1)
    near = F.transform(F.array(*map(F.lit, "0123456789ABCDEF")), lambda d: F.decode(F.unhex(F.concat(stem, d)), "UTF-16BE"))
    out = c
    alike_of = lambda kind: F.filter(near, lambda x: x.rlike(f"^{kind}$") & (x != c))
    for kind in reversed(_KINDS):
        alike = alike_of(kind)
        out = F.when(c.rlike(f"^{kind}$"), F.when(F.size(alike) > 0, F.element_at(alike, (F.pmod(value, F.greatest(F.size(alike), F.lit(1))) + 1).cast("int"))).otherwise("x")).otherwise(out)
    return out


def _respelt(text: Column, digest: Column, hexadecimal: bool = False) -> Column:
    """Each letter or digit exchanged for one of its kind, others kept."""

    def one(c: Column, i: Column) -> Column:
        value = _byte(digest, i)
        if hexadecimal:
            return F.substring(F.lit("0123456789abcdef"), (F.pmod(value, F.lit(16)) + 1).cast("int"), F.lit(1))
        out = F.when(c.rlike(r"^[\p{L}\p{N}]$"), _neighbour(c, value)).otherwise(c)
        for pattern, letters in reversed(_ALPHABETS):
            out = F.when(c.rlike(f"^{pattern}$"), F.substring(F.lit(letters), (F.pmod(value, F.lit(len(letters))) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def kind_of(match: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())):
        out = F.when(match.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _country(match: Column) -> Column:
    """The country digits of a phone number, which are kept: +1, those before a separator, or two."""
    return F.regexp_extract(match, r"^\+(1|\d{1,3}(?=[ .\-(])|\d{2})", 1)


def parts_of(match: Column) -> Column:
    """The entities of a match, as (kind, form): one, or for a name its given name and surname.

    The form is what all spellings of one entity share.
    """
    kind = kind_of(match)
    digits = F.regexp_replace(match, r"\D", "")
    form = (
        F.when(kind == "phone", F.substring(digits, F.length(_country(match)) + 1, F.length(digits)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "email", F.lower(match))
        .when(kind == "iban", F.replace(match, F.lit(" ")))
        .otherwise(match)
    )
    words = F.slice(F.split(match, " "), 2, 3)
    told = lambda g: match.rlike(f"^(?:{'|'.join(TITLES[g])})[. ]")
    gender = F.when(told("f"), "f").when(told("n"), "n").otherwise("m")
    surname = F.element_at(words, -1)
    family = F.struct(F.concat(F.lit("surname:"), _script(surname)).alias("kind"), F.lower(surname).alias("form"))
    given = F.struct(F.concat(F.lit("given:"), gender, F.lit(":"), _script(words[0])).alias("kind"), F.lower(words[0]).alias("form"))
    name = F.when(F.size(words) > 1, F.array(given, family)).otherwise(F.array(family))
    return F.when(kind == "name", name).otherwise(F.array(F.struct(kind.alias("kind"), form.alias("form"))))


def _grown(syllables: list[str], digest: Column, attempt: Column, extra: Column) -> Column:
    """``extra`` keyed syllables, and one more with each attempt after the fifth, so that a free form always comes."""
    n = extra + F.greatest(attempt - 5, F.lit(0))
    # Every 24 syllables a digest of its own, so that long forms don't repeat.
    more = F.transform(F.sequence(F.lit(1), n), lambda i: _pick(syllables, _byte(F.sha2(F.concat(digest, F.floor(i / 24).cast("string")).cast("binary"), 512), i + 7)))
    return F.when(n > 0, F.array_join(more, "")).otherwise("")


def _draw(entities: DataFrame, key: str, extra: Column, again: Column | None = None) -> DataFrame:
    """``kind, form, attempt, surrogate``: what is drawn, or drawn ``again``, at each entity's attempt.

    The keyed digest is a column of its own: within a loop over characters it would be computed for each.
    """
    digest = F.sha2(F.concat_ws("\x01", F.lit(key), "kind", "form", F.col("attempt").cast("string")).cast("binary"), 512)
    out = _drawn(F.col("kind"), F.col("form"), F.col("attempt"), F.col("digest"), extra)
    out = out if again is None else F.when(again, out).otherwise(F.col("surrogate"))
    return entities.withColumn("digest", digest).select("kind", "form", "attempt", out.alias("surrogate"))


def _drawn(kind: Column, form: Column, attempt: Column, digest: Column, extra: Column) -> Column:
    """The surrogate form of an entity at one attempt; names get ``extra`` syllables."""
    kept = (
        F.when(kind == "key", F.regexp_extract(form, r"^(?:AKIA|[a-z]+[\-_])", 0))
        .when(kind.isin("card"), F.substring(form, 1, 1))
        .when(kind == "iban", F.substring(form, 1, 2))
        .otherwise("")
    )
    body = F.substring(form, F.length(kept) + 1, F.length(form))
    top = F.regexp_extract(form, r"\.\p{L}{2,}$", 0)
    mail = F.concat(_respelt(F.substring(form, F.lit(1), F.length(form) - F.length(top)), digest), top)
    longer = F.when(attempt > 3, F.concat(F.substring(digest, F.lit(1), attempt), mail)).otherwise(mail)
    # A format without a free form left: keyed digits follow it.
    surplus = F.when(attempt > 12, F.translate(F.substring(digest, F.lit(60), attempt - 12), "abcdef", "012345")).otherwise("")
    octets = F.concat_ws(".", *[(F.pmod(_byte(digest, i) + _byte(digest, i + 8) * 7, F.lit(223)) + 1).cast("string") for i in range(4)])
    out = F.when(kind == "email", longer).when(kind == "ipv4", octets).when(kind == "secret", _respelt(form, digest, hexadecimal=True)).otherwise(F.concat(kept, _respelt(body, digest)))
    out = F.when(kind == "email", out).otherwise(F.concat(out, surplus))
    for script, syllables in _SYLLABLES.items():
        grown = _grown(syllables, digest, attempt, extra)
        two = F.when(attempt > 2, F.concat(*[_pick(syllables, _byte(digest, i)) for i in (3, 4)])).otherwise("")
        out = F.when(kind == f"surname:{script}", F.concat(*[_pick(syllables, _byte(digest, i)) for i in range(3)], two, grown)).otherwise(out)
        for gender, names in _GIVEN[script].items():
            plain = F.lower(_pick(names, _byte(digest, 0)))
            both = F.when(attempt > 1, F.concat(plain, F.lit("-"), F.lower(_pick(names, _byte(digest, 1))))).otherwise(plain)
            more = F.when(attempt > 4, F.concat(both, F.lit("-"), F.lower(_pick(names, _byte(digest, 2))))).otherwise(both)
            out = F.when(kind == f"given:{gender}:{script}", F.concat(more, grown)).otherwise(out)
    return out


def _leaks(kind: Column, form: Column, surrogate: Column) -> Column:
    """Whether an address still shows its name or its domain: as it was, or within a longer one."""
    local, domain = F.substring_index(form, "@", 1), F.regexp_extract(form, r"@(.*)\.\p{L}{2,}$", 1)
    shown = lambda part, now: part.rlike(r"[\p{L}\p{N}]") & ((part == now) | ((F.length(part) > 3) & surrogate.contains(part)))
    found = shown(local, F.substring_index(surrogate, "@", 1)) | shown(domain, F.regexp_extract(surrogate, r"@(.*)\.\p{L}{2,}$", 1))
    return (kind == "email") & F.coalesce(found, F.lit(False))


def _syllables_needed(entities: DataFrame) -> Column:
    """Syllables that a kind of names needs besides its pool, by the number of its entities (one row a kind)."""
    pools = {f"surname:{s}": len(v) ** 3 for s, v in _SYLLABLES.items()} | {f"given:{g}:{s}": len(v) for s, x in _GIVEN.items() for g, v in x.items()}
    extra = F.lit(0)
    for r in entities.filter(F.col("kind").isin(list(pools))).groupBy("kind").count().collect():
        more = math.ceil(math.log(max(1.0, 8 * r["count"] / pools[r["kind"]]), 16))
        extra = F.when(F.col("kind") == r["kind"], F.lit(more)).otherwise(extra)
    return extra


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """``kind, form, surrogate`` of distinct entities, all surrogates distinct within a kind.

    Those that equal another surrogate (all but the least form) or an entity that was
    found, and addresses that still show the original's name or domain, are drawn again, until none is left; forms grow with the attempts, so that ends.
    Each round is one grouping and one join of the entities.
    """
    extra = _syllables_needed(entities)
    now = written(_draw(entities.withColumn("attempt", F.lit(0)), key, extra), "surrogates")
    while True:
        owner = now.groupBy("kind", "surrogate").agg(F.min("form").alias("owner"))
        real = entities.select("kind", F.col("form").alias("surrogate"), F.lit(True).alias("real"))
        met = now.join(owner, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        again = F.coalesce("real", F.lit(False)) | (F.col("form") != F.col("owner")) | _leaks(F.col("kind"), F.col("form"), F.col("surrogate"))
        checked = written(met.select("kind", "form", "attempt", "surrogate", again.alias("again")), "surrogates")
        forget(now)
        if checked.filter("again").isEmpty():
            return checked.select("kind", "form", "surrogate")
        now = written(_draw(checked.withColumn("attempt", F.col("attempt") + F.col("again").cast("int")), key, extra, F.col("again")), "surrogates")
        forget(checked)


def _filled(match: Column, digits: Column) -> Column:
    """The match with its digits, in turn, replaced by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda acc, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(acc["out"], F.substring(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at")))
    filled = F.aggregate(F.filter(F.split(match, ""), lambda c: c != ""), start, step)
    return F.concat(filled["out"], F.substring(digits, filled["at"], F.length(digits)))


def _written_as(match: Column, found: Column) -> Column:
    """A surrogate in the format of the match; ``found`` are the surrogates of its parts."""
    kind, first = kind_of(match), found[0]
    plain = F.concat(F.when(kind == "phone", _country(match)).otherwise(""), first)
    spaced = F.when(match.contains(" "), F.trim(F.regexp_replace(first, "(.{4})", "$1 "))).otherwise(first)
    mail = F.when(match == F.upper(match), F.upper(first)).otherwise(first)
    title = F.split(match, " ")[0]
    return (
        F.when(kind.isin("phone", "card", "ssn"), _filled(match, plain))
        .when(kind == "email", mail)
        .when(kind == "iban", spaced)
        .when(kind == "name", F.concat_ws(" ", title, F.transform(found, lambda w: F.array_join(F.transform(F.split(w, "-"), F.initcap), "-"))))
        .otherwise(first)
    )


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with entities replaced in the text, and ``n_entities``.

    Null and empty texts stay as they are, with 0 entities; texts without an entity are
    untouched.  ``key`` decides the surrogates: with the same key and the same entities
    they are the same.  Repeated rows are treated alike.  An empty table gives an empty
    result.  A column ``n_entities`` of the input is replaced.  Texts of any length are
    searched whole; the patterns' stack does not grow with them.

    Plan: texts are searched where they lie.  Only those with entities are written with
    their matches; their distinct entities (summed up within tasks) are the table of
    surrogates, which is joined to the matches; AQE splits a hot entity.
    """
    text = F.col(text_col)
    has = F.coalesce(text.rlike(_HINT) & text.rlike(ANY), F.lit(False))
    names = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*names)
    clean = docs.filter(~has).withColumn("n_entities", F.lit(0).cast("bigint"))
    hits = docs.filter(has).select(F.struct(*names).alias("doc"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("found"))
    hits = written(hits.withColumn("row", F.monotonically_increasing_id()), "pii-texts")
    parts = hits.select("row", F.posexplode("found").alias("at", "match")).select("row", "at", "match", F.posexplode(parts_of(F.col("match"))).alias("part", "entity"))
    parts = parts.select("row", "at", "match", "part", "entity.kind", "entity.form")
    table = surrogate_table(written(parts.select("kind", "form").distinct(), "pii-entities"), key)
    of_match = parts.join(table, ["kind", "form"]).groupBy("row", "at").agg(F.first("match").alias("match"), F.transform(F.sort_array(F.collect_list(F.struct("part", "surrogate"))), lambda s: s["surrogate"]).alias("forms"))
    of_row = of_match.select("row", F.struct("at", _written_as(F.col("match"), F.col("forms")).alias("text")).alias("new")).groupBy("row").agg(F.sort_array(F.collect_list("new")).alias("new"))
    met = hits.select("row", "doc").join(of_row, "row")
    pieces = F.split(F.col(f"doc.{text_col}"), ANY, -1)
    padded = F.concat(F.transform("new", lambda n: n["text"]), F.array(F.lit("")))
    done = F.array_join(F.zip_with(pieces, padded, lambda a, b: F.concat(a, b)), "")
    changed = met.select(*[done.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in names], F.size("new").cast("bigint").alias("n_entities"))
    return clean.unionByName(changed)
