"""Surrogates for personal data: keyed, of the same type and format, distinct and consistent.

One pattern finds e-mail addresses, phone numbers, IPv4 and IPv6 addresses, card and
social-security numbers, IBANs, secrets and titled names. A text is split at the matches
and put together again with a surrogate for each, in DataFrame expressions only.

* A surrogate depends on a key, the type and the canonical value (letters in lower case,
  digits without separators), so the same value has the same surrogate in all documents
  and in all its formats.
* Numbers go through a keyed permutation of their digits (a Feistel network on two
  halves), so distinct values stay distinct; separators and the country code stay, and a
  card number with a valid check digit gets a valid one. Public IPv4 addresses stay in
  1.0.0.0 to 223.255.255.255, private ones in their range. IPv6 addresses keep their zero
  groups, so a compressed one stays compressed; with a dotted end, only that end is replaced.
* Other values are redrawn letter by letter within their classes (digit, lower and upper
  case, hexadecimal), secrets to their end. Mail domains become names under ``.example``.
* Names follow the title: given name and ending by gender, letters by script. A name is all
  capitalised words after the title, particles between them included; one of several words
  becomes a given name and a surname.
* Collisions are checked over all documents: where a surrogate equals another one or a
  value that occurs, the later values are drawn again with a further attempt number, until
  none is left. Names grow by a syllable with each attempt. Where more than a quarter of all
  addresses or numbers of a range occurs, they are only permuted. Only these exceptions are joined to the documents.

Defined results: null and empty texts stay as they are. Rows keep their order of columns
and all other columns. Repeated rows are replaced alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import settled

# Titles by gender and given names by script and gender.
TITLES = {
    ("latin", "m"): ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Mister", "Sir", "Don"),
    ("latin", "f"): ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Doña"),
    ("cyrillic", "m"): ("господин", "Господин", "г-н"),
    ("cyrillic", "f"): ("госпожа", "Госпожа", "г-жа"),
    ("greek", "m"): ("Κύριος", "κύριος"),
    ("greek", "f"): ("Κυρία", "κυρία"),
}
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Leo"),
    ("latin", "f"): ("Anna", "Clara", "Diana", "Elena", "Greta", "Julia", "Laura", "Nora"),
    ("cyrillic", "m"): ("Иван", "Павел", "Олег", "Юрий"),
    ("cyrillic", "f"): ("Анна", "Вера", "Ольга", "Нина"),
    ("greek", "m"): ("Νίκος", "Πέτρος", "Γιώργος", "Αλέξης"),
    ("greek", "f"): ("Μαρία", "Ελένη", "Άννα", "Σοφία"),
}
SYLLABLES = {
    "latin": ("ba", "cor", "del", "fen", "gar", "hol", "jas", "kir", "lam", "mor", "nel", "pra", "ros", "sil", "tor", "ven"),
    "cyrillic": ("ба", "вор", "гар", "дел", "жар", "зин", "кор", "лам", "мор", "нел", "пар", "рос", "сил", "тор", "фед", "хол"),
    "greek": ("βα", "γαρ", "δελ", "ζιν", "θορ", "καλ", "λαμ", "μορ", "νελ", "ξεν", "παρ", "ροσ", "σιλ", "τορ", "φεν", "χολ"),
}
ENDINGS = {
    ("latin", "m"): "", ("latin", "f"): "", ("cyrillic", "m"): "ов", ("cyrillic", "f"): "ова",
    ("greek", "m"): "ης", ("greek", "f"): "η",
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SIGNS = r"\p{L}\p{N}._%+\-"
_TITLE = "|".join(sorted({t for titles in TITLES.values() for t in titles}, key=len, reverse=True))
# Few words start like a title or a secret's name, so the others need not be compared with each.
_INITIALS = "".join(sorted({title[0] for titles in TITLES.values() for title in titles}))
_NAME = r"\p{Lu}[\p{L}'’\-]++"
# Particles that may stand between the words of a name.
_PARTICLES = "de|del|della|di|da|das|dos|do|du|des|la|le|las|los|el|al|van|von|vom|der|den|ter|ten|zu|zur|af|av|bin|ibn|y|e"
_HOST = r"[\p{L}\p{N}\-]"
_HEX = r"[0-9A-Fa-f]{1,4}"
# All places of the '::' among at most seven groups.
_COMPRESSED = "|".join(
    [rf"(?:{_HEX}:){{1,{7 - n}}}(?::{_HEX}){{1,{n}}}" for n in range(1, 7)]
    + [rf"(?:{_HEX}:){{1,7}}:", rf":(?::{_HEX}){{1,7}}"]
)
# type: pattern; the first that matches the whole of a find names its type.
PATTERNS = {
    "email": rf"(?<![{_SIGNS}])[{_SIGNS}]++@(?:{_HOST}++(?:\.{_HOST}++)++(?<=\.\p{{L}}{_HOST}{{1,62}})"
    r"|(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24})",
    "secret": r"\b(?=[AaBbPpSsTt])(?:(?i:password|passwd|pwd|token|secret|api[_\-]?key)"
    r"(?:[ ]{0,3}[=:][ ]{0,3}[\"']?|[ ]{1,3}(?i:is)[ ]{1,3}[\"']?(?=[^\s\"',;]*\d))[^\s\"',;]{6,}+"
    r"|(?i:bearer)[ ]{1,3}(?=[^\s\"',;]*\d)[^\s\"',;]{16,}+)",
    "key": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}+|sk-[0-9A-Za-z]{20,}+)\b",
    "ipv6": r"(?<![0-9A-Fa-f:])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:])"
    rf"(?:(?:{_HEX}:){{7}}{_HEX}(?![0-9A-Fa-f]|:[0-9A-Fa-f:])"
    rf"|(?:{_COMPRESSED})(?![\p{{L}}\p{{N}}_]|:[0-9A-Fa-f:]|\.\d))",
    "ipv4": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}"
    r"|\+(?=(?:[ .\-()]{0,2}\d){8})\d{1,3}(?:[ .\-]\(?\d{1,4}\)?){2,6}"
    r"|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[\-.]\d{3}[\-.]\d{4})(?![\d])",
    "card": r"(?<!\d)(?:\d{4}(?:[ \-]\d{4}){3}|\d{13,19})(?!\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?=[{_INITIALS}])(?:{_TITLE})\.? {_NAME}(?:(?: (?:{_PARTICLES})){{0,3}}+ {_NAME})*+",
}
# Finds start at the edge of a word, or at a number after a letter; elsewhere the
# alternatives need not be tried, which is most of the text.
_EDGE = r"(?:(?<![\p{L}\p{N}])|(?<=\p{L})(?=[\d+(]))"
ANY = _EDGE + "(?:" + "|".join(f"(?:{pattern})" for pattern in PATTERNS.values()) + ")"
ATTEMPTS = 32


def finds(text: Column) -> Column:
    """All matches in a text, in order."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def type_of(find: Column) -> Column:
    return F.coalesce(
        *(F.when(find.rlike(rf"\A(?:{p})\z"), F.lit(name)) for name, p in PATTERNS.items()),
        F.lit("card"),
    )


_SECRET_HEAD = (
    r"\A(?i:(?:password|passwd|pwd|token|secret|api[_\-]?key)(?:[ ]{0,3}[=:][ ]{0,3}|[ ]{1,3}is[ ]{1,3})"
    r"|bearer[ ]{1,3})[\"']?"
)
# The country codes in use are told apart without a separator; others have three digits.
_COUNTRY = r"\A\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_NAME_HEAD = rf"\A(?:{_TITLE})\.? "


def head_of(find: Column, kind: Column) -> Column:
    """What stays in front of the value: a secret's name, a title, a country code."""
    return (
        F.when(kind == "secret", F.regexp_extract(find, _SECRET_HEAD, 0))
        .when(kind == "name", F.regexp_extract(find, _NAME_HEAD, 0))
        .when(kind == "phone", F.regexp_extract(find, _COUNTRY, 0))
        .otherwise("")
    )


def _tail(find: Column, head: Column) -> Column:
    return F.substring(find, F.length(head) + 1, F.length(find))


def canonical(find: Column, kind: Column) -> Column:
    """Equal for all formats of a value. Titles tell gender and script, so they belong to it."""
    value = _tail(find, head_of(find, kind))
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, r"\D", ""))
        .when(kind == "email", F.lower(find))
        .when(kind == "ipv6", _eight_groups(find))
        .when(kind == "iban", F.regexp_replace(find, " ", ""))
        .when(kind == "name", F.concat(_style(find), F.lit(":"), value))
        .otherwise(value)
    )


def _groups(find: Column, side: int) -> Column:
    """The groups of an IPv6 address before (0) and after (1) its '::'."""
    half = F.coalesce(F.get(F.split(F.lower(find), "::", -1), F.lit(side)), F.lit(""))
    return F.filter(F.split(half, ":", -1), lambda group: group != "")


def _eight_groups(find: Column) -> Column:
    """An IPv6 address written out, without zeros in front."""
    before, after = _groups(find, 0), _groups(find, 1)
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(before) - F.size(after))
    groups = F.transform(
        F.concat(before, zeros, after), lambda group: F.regexp_replace(group, "^0+(?=.)", "")
    )
    return F.array_join(groups, ":")


def _as_written(find: Column, groups: Column) -> Column:
    """Eight groups with the '::' where a find has it."""
    parts = F.split(groups, ":")
    before, after = F.size(_groups(find, 0)), F.size(_groups(find, 1))
    compressed = F.concat(
        F.array_join(F.slice(parts, F.lit(1), before), ":"), F.lit("::"),
        F.array_join(F.slice(parts, F.lit(9) - after, after), ":"),
    )
    return F.when(find.contains("::"), compressed).otherwise(groups)


def _style(find: Column) -> Column:
    """Script and gender by the title; the first given-name list for a title in none."""
    found = F.lit("latin_m")
    for (script, gender), titles in TITLES.items():
        pattern = rf"\A(?:{'|'.join(titles)})\.? "
        found = F.when(find.rlike(pattern), F.lit(f"{script}_{gender}")).otherwise(found)
    return found


def _draw(*parts: Column) -> Column:
    """60 keyed bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 15), 16, 10).cast("long")


def _permute(high: Column, low: Column, a: Column, b: Column, *parts: Column) -> tuple[Column, Column]:
    """A keyed permutation of the pairs (high < a, low < b)."""
    for turn in range(2):
        mark = F.lit(str(turn))
        high = (high + F.pmod(_draw(*parts, mark, F.lit("h"), low.cast("string")), a)) % a
        low = (low + F.pmod(_draw(*parts, mark, F.lit("l"), high.cast("string")), b)) % b
    return high, low


def _permuted_digits(digits: Column, *parts: Column) -> Column:
    """Another string of as many digits."""
    size = F.length(digits)
    first = (size / 2).cast("int")
    a, b = F.pow(F.lit(10.0), first).cast("long"), F.pow(F.lit(10.0), size - first).cast("long")
    high, low = _permute(
        F.coalesce(F.substring(digits, F.lit(1), first).try_cast("long"), F.lit(0)),
        F.substring(digits, first + 1, size).cast("long"), a, b, *parts, size.cast("string"),
    )
    return F.concat(
        F.when(first > 0, F.lpad(high.cast("string"), first, F.lit("0"))).otherwise(""),
        F.lpad(low.cast("string"), size - first, F.lit("0")),
    )


def _luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled (and its digits added)."""
    places = F.sequence(F.lit(1), F.length(digits))
    reverse = F.reverse(digits)

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(reverse, place, F.lit(1)).cast("int")
        doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(place % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(places, F.lit(0), add)


def _card(digits: Column, *parts: Column) -> Column:
    body = _permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), *parts)
    check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    valid = F.pmod(_luhn_sum(digits), F.lit(10)) == 0
    return F.when(valid, F.concat(body, check.cast("string"))).otherwise(
        _permuted_digits(digits, *parts)
    )


def _ipv4(value: Column, *parts: Column) -> Column:
    octets = F.split(value, r"\.")
    one, two, three, four = (F.get(octets, F.lit(i)).cast("long") for i in range(4))
    rest = (two * 256 + three) * 256 + four
    public = (one >= 1) & (one <= 223) & ~one.isin(10, 127)
    high, low = _permute(one - 1, rest, F.lit(223), F.lit(1 << 24), *parts)
    kept = F.pmod(rest + F.pmod(_draw(*parts, one.cast("string")), F.lit(1 << 24)), F.lit(1 << 24))
    near = F.pmod(rest % 65536 + F.pmod(_draw(*parts, F.lit("near")), F.lit(65536)), F.lit(65536))
    local = (one == 192) & (two == 168)
    first = F.when(local | ~public, one).otherwise(high + 1)
    last = F.when(local, 168 * 65536 + near).when(~public, kept).otherwise(low)
    bytes_ = [F.shiftright(last, shift).bitwiseAND(F.lit(255)) for shift in (16, 8, 0)]
    return F.concat_ws(".", *(x.cast("string") for x in (first, *bytes_)))


def _ipv6(value: Column, *parts: Column) -> Column:
    """Zero groups stay, so that a '::' does; the others are shifted by the rest of the
    address, each twice, which is a keyed permutation."""
    groups = F.transform(F.split(value, ":"), lambda group: F.conv(group, 16, 10).cast("long"))

    def turned(now: Column, turn: Column) -> Column:
        def shifted(group: Column, at: Column) -> Column:
            others = F.transform(now, lambda other, i: F.when(i == at, F.lit(-1)).otherwise(other))
            mark = F.array_join(others.cast("array<string>"), ":")
            moved = 1 + F.pmod(group - 1 + _draw(*parts, turn.cast("string"), mark), F.lit(65535))
            return F.when((at == turn % 8) & (group > 0), moved).otherwise(group)

        return F.transform(now, shifted)

    mixed = F.aggregate(F.sequence(F.lit(0), F.lit(15)), groups, turned)
    return F.array_join(F.transform(mixed, lambda group: F.lower(F.conv(group.cast("string"), 10, 16))), ":")


def _redrawn(value: Column, *parts: Column) -> Column:
    """Each digit and letter becomes another of its class; other signs stay."""
    hexadecimal = value.rlike(r"\A[0-9a-f]+\z")
    letters = F.when(hexadecimal, F.lit("abcdef")).otherwise("abcdefghijklmnopqrstuvwxyz")

    def redraw(bound: Column, character: Column, at: Column) -> Column:
        # 32 characters a digest, so values may have any length
        digest = F.sha2(F.concat_ws("\0", bound["seed"], F.floor(at / 32).cast("string")), 256)
        number = F.conv(F.substring(digest, 2 * (at % 32) + 1, F.lit(2)), 16, 10).cast("int")

        def one_of(letters: Column) -> Column:
            return F.substring(letters, F.pmod(number, F.length(letters)) + 1, F.lit(1))

        return (
            F.when(character.rlike(r"\d"), one_of(F.lit("0123456789")))
            .when(character.rlike(r"\p{Lu}"), F.upper(one_of(bound["letters"])))
            .when(character.rlike(r"\p{L}"), one_of(bound["letters"]))
            .otherwise(character)
        )

    def whole(bound: Column) -> Column:
        return F.array_join(F.transform(F.split(value, ""), lambda c, at: redraw(bound, c, at)), "")

    # Bound by a lambda, so that they are made once a value and not once a character.
    once = F.struct(F.sha2(F.concat_ws("\0", *parts), 256).alias("seed"), letters.alias("letters"))
    return F.get(F.transform(F.array(once), whole), F.lit(0))


def _letters(count: Column, *parts: Column) -> Column:
    """That many lower-case letters (at most 64)."""
    digest = F.sha2(F.concat_ws("\0", *parts, F.lit("letters")), 256)
    return F.substring(F.translate(digest, "0123456789", "ghijklmnop"), F.lit(1), count)


def _name(value: Column, attempt: Column, *parts: Column) -> Column:
    """value is ``style:name``; one word is a surname, more are given name and surname.

    Each attempt adds a syllable, so surnames don't run out.
    """
    drawn = None
    digest = F.sha2(F.concat_ws("\0", *parts), 256)
    drawn_syllables = F.split(F.substring(digest, F.lit(17), F.least(attempt + 4, F.lit(48))), "")
    for (script, gender), given in GIVEN.items():
        chosen = F.get(F.array(*map(F.lit, given)), F.pmod(_draw(*parts), F.lit(len(given))).cast("int"))
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        surname = F.array_join(
            F.transform(drawn_syllables, lambda c: F.get(syllables, F.conv(c, 16, 10).cast("int"))), ""
        )
        surname = F.concat(F.initcap(surname), F.lit(ENDINGS[script, gender]))
        two = F.locate(" ", value) > 0
        made = F.when(two, F.concat(chosen, F.lit(" "), surname)).otherwise(surname)
        styled = value.startswith(f"{script}_{gender}:")
        drawn = F.when(styled, made).otherwise(drawn if drawn is not None else made)
    return drawn


def surrogate_of(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """The canonical surrogate of a canonical value."""
    parts = (F.lit(key), kind, attempt.cast("string"))
    own = (*parts, value)
    user, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    email = F.concat(
        _redrawn(user, *own),
        _letters(F.least(attempt * 4, F.lit(64)), *own),
        F.lit("@"),
        _letters(F.lit(8), F.lit(key), F.lit("domain"), domain),
        F.lit(".example"),
    )
    return (
        F.when(kind == "email", email)
        .when(kind == "card", _card(value, *parts))
        .when(kind.isin("phone", "ssn"), _permuted_digits(value, *parts))
        .when(kind == "ipv4", _ipv4(value, *parts))
        .when(kind == "ipv6", _ipv6(value, *parts))
        .when(kind == "name", _name(value, attempt, *own))
        .when(kind == "key", F.concat(F.substring(value, 1, 4), _redrawn(F.substring(value, F.lit(5), F.length(value)), *own)))
        .when(kind == "iban", F.concat(F.substring(value, 1, 2), _redrawn(F.substring(value, 3, 64), *own)))
        .otherwise(F.concat(_redrawn(value, *own), _letters(F.least(attempt * 4, F.lit(64)), *own)))
    )


def _poured(into: Column, signs: Column, sign: str) -> Column:
    """A format with its signs (a pattern for one) replaced by others, in order."""
    return F.array_join(
        F.zip_with(
            F.split(into, sign, -1),
            F.split(signs, ""),
            lambda gap, one: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(one, F.lit(""))),
        ),
        "",
    )


def formatted(find: Column, kind: Column, surrogate: Column) -> Column:
    """The canonical surrogate in the format of a find."""
    head = head_of(find, kind)
    return (
        F.when(
            kind.isin("phone", "card", "ssn"),
            F.concat(head, _poured(_tail(find, head), surrogate, r"\d")),
        )
        .when(kind == "iban", _poured(find, surrogate, "[A-Z0-9]"))
        .when(kind == "ipv6", _as_written(find, surrogate))
        .otherwise(F.concat(head, surrogate))
    )


def _typed(text: Column) -> Column:
    """array<struct<find, kind, value>> of the finds in a text."""
    kinds = F.transform(finds(text), lambda m: F.struct(m.alias("find"), type_of(m).alias("kind")))
    return F.transform(
        kinds,
        lambda m: F.struct(
            m["find"].alias("find"),
            m["kind"].alias("kind"),
            canonical(m["find"], m["kind"]).alias("value"),
        ),
    )


def _name_of(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), value)


def replaced(text: Column, key: str, attempts: Column) -> Column:
    """The text with a surrogate for every find; ``attempts`` maps ``type:value`` to the
    attempt of a value that isn't on its first."""

    def drawn(m: Column) -> Column:
        attempt = F.coalesce(F.try_element_at(attempts, _name_of(m["kind"], m["value"])), F.lit(0))
        return F.struct(
            m["find"].alias("find"), m["kind"].alias("kind"), m["value"].alias("value"),
            attempt.alias("attempt"),
        )

    tried = F.transform(_typed(text), drawn)
    surrogates = F.transform(
        tried,
        lambda m: F.struct(
            m["find"].alias("find"),
            m["kind"].alias("kind"),
            surrogate_of(m["kind"], m["value"], key, m["attempt"]).alias("surrogate"),
        ),
    )
    written = F.transform(surrogates, lambda m: formatted(m["find"], m["kind"], m["surrogate"]))
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(
        F.zip_with(gaps, written, lambda gap, one: F.concat(gap, F.coalesce(one, F.lit("")))), ""
    )
    return F.when(text.rlike(ANY), joined).otherwise(text)


def mentions_of(documents: DataFrame) -> DataFrame:
    """Distinct (text_key, kind, value): what each text mentions."""
    text = F.col("text")
    found = documents.where(text.isNotNull()).select(
        F.xxhash64(text).alias("text_key"), F.explode(_typed(text)).alias("m")
    )
    return found.select("text_key", "m.kind", "m.value").distinct()


def _pool(kind: Column, value: Column) -> tuple[Column, Column]:
    """Which values a permuted value is dealt among, and how many these are; null for others."""
    mask = F.regexp_replace(value, "[1-9a-f][0-9a-f]*", "x")
    first = F.substring_index(value, ".", 1)
    local = value.startswith("192.168.")
    private = (kind == "ipv4") & first.isin("0", "10", "127", *map(str, range(224, 256)))
    digits = kind.isin("phone", "ssn")
    name = (
        F.when(kind == "ipv6", mask).when((kind == "ipv4") & local, "192.168").when(private, first)
        .when(kind == "ipv4", "public").when(digits, F.length(value).cast("string"))
    )
    size = (
        F.when(kind == "ipv6", F.pow(F.lit(65535.0), F.length(mask) - F.length(F.translate(mask, "x", ""))))
        .when((kind == "ipv4") & local, 65536.0).when(private, float(1 << 24))
        .when(kind == "ipv4", 223.0 * (1 << 24)).when(digits, F.pow(F.lit(10.0), F.length(value)))
    )
    return name, size


def _crowded(entities: DataFrame) -> DataFrame:
    """(kind, pool) of the pools of which more than a quarter occurs."""
    name, size = _pool(F.col("kind"), F.col("value"))
    pools = entities.select("kind", name.alias("pool"), size.alias("size")).where("pool IS NOT NULL")
    return pools.groupBy("kind", "pool").agg(F.count("*").alias("n"), F.max("size").alias("size")).where(
        "n > size / 4"
    ).select("kind", "pool")


def attempts_of(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt > 0) of the entities whose first surrogates collide.

    A surrogate collides with an equal surrogate of another value of its type (the
    smallest value keeps it) or with a value that occurs. Values that collide draw again
    with the next attempt; the others hold theirs. In a crowded pool few values are free,
    so its values all hold their first surrogates: a permutation, distinct among themselves,
    which may equal values that occur.
    """

    def drawn(frame: DataFrame, attempt: int) -> DataFrame:
        made = surrogate_of(F.col("kind"), F.col("value"), key, F.lit(attempt))
        return frame.select("kind", "value", made.alias("surrogate"), F.lit(attempt).alias("attempt"))

    plain = F.when(F.col("kind") == "name", F.regexp_replace("value", "^[a-z_]+:", ""))
    real = entities.select("kind", F.coalesce(plain, "value").alias("surrogate")).distinct()
    held, asking = None, entities
    crowded = settled(_crowded(entities), "crowded")
    if not crowded.isEmpty():
        pool, _ = _pool(F.col("kind"), F.col("value"))
        pooled = entities.withColumn("pool", pool)
        held = settled(drawn(pooled.join(crowded, ["kind", "pool"], "left_semi"), 0), "held")
        asking = pooled.join(crowded, ["kind", "pool"], "left_anti").select("kind", "value")
    for attempt in range(ATTEMPTS):
        asked = settled(drawn(asking, attempt), "asked")
        first = asked.groupBy("kind", "surrogate").agg(F.min("value").alias("first"))
        taken = real if held is None else real.unionByName(held.select("kind", "surrogate"))
        free = first.join(taken, ["kind", "surrogate"], "left_anti")
        judged = asked.join(free, ["kind", "surrogate"], "left")
        won = F.coalesce(F.col("first") == F.col("value"), F.lit(False))
        lost = settled(judged.where(~won).select("kind", "value"), "asking")
        passed = judged.where(won).select("kind", "value", "surrogate", "attempt")
        held = passed if held is None else held.unionByName(passed)
        if lost.isEmpty():
            return held.where("attempt > 0").select("kind", "value", "attempt")
        held, asking = settled(held, "held"), lost
    raise ValueError(f"values without a surrogate of their own after {ATTEMPTS} attempts")


def replace_pii(documents: DataFrame, key: str) -> DataFrame:
    """The documents, all columns, with surrogates in ``text``."""
    mentions = settled(mentions_of(documents), "mentions")
    # The values are few bytes, but drawing costs: by a number of tasks, not by size.
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = mentions.select("kind", "value").distinct().repartition(tasks, "kind", "value")
    again = attempts_of(values, key)
    exceptions = (
        mentions.join(again, ["kind", "value"])
        .groupBy("text_key")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct(_name_of(F.col("kind"), F.col("value")), F.col("attempt")))
            ).alias("attempts")
        )
    )
    # Few or none: Spark broadcasts the table where its size on disk allows.
    exceptions = settled(exceptions, "exceptions")
    rows = documents.select(
        F.struct(*documents.columns).alias("row"), F.xxhash64("text").alias("text_key")
    ).join(exceptions, "text_key", "left")
    text = replaced(F.col("row.text"), key, F.col("attempts")).alias("text")
    return rows.select(
        *(text if name == "text" else F.col("row")[name].alias(name) for name in documents.columns)
    )


